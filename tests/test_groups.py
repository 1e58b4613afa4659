"""Events of grouped findings and chains against brute force over all events."""

import datetime as dt
import random
import time
from collections import Counter

from emberlog.operators.correlate import compromised_account, compromised_account_events
from emberlog.operators.detectors import Settings, new_user_additions, new_user_hits, new_users
from emberlog.plans import queries as Q
from emberlog.plans.adapter import log_events
from emberlog.plans.analyze import analyze, finding_events
from emberlog.schema import as_events


def test_every_grouped_finding_has_all_its_events(spark, sf_dir):
    ev = log_events(spark, sf_dir).persist()
    found, members = Q.grouped_findings(ev)
    found, got = found.collect(), members.collect()
    grouped = [f for f in found if f.group_key is not None]
    have = Counter((m.rule_name, m.title, m.group_key, m.first_us) for m in got)
    assert {f.rule_name for f in grouped} >= {"FailedLogon", "BruteForce", "SuccessfulLogon"}
    for f in grouped:  # the logon that follows a burst is the finding's own event
        won = f.title == "Possible successful brute force authentication"
        assert have[f.rule_name, f.title, f.group_key, f.first_us] == f.n_related - won, f
    new = [f for f in found if f.rule_name == "NewUser" and f.n_related > 1]
    assert new
    for f in new:
        assert have["NewUser", f.title, str(f.event_row_id), f.first_us] == f.n_related - 1
    assert len(set(got)) == len(got)

    highest = {r.row_id: 0 for r in ev.select("row_id").collect()}
    for f in found:
        for row in f.related_event_row_ids:
            highest[row] = max(highest[row], f.severity_rank)
    few = dict(highest)
    for m in got:
        highest[m.row_id] = max(highest[m.row_id], m.severity_rank)
    assert highest != few
    names = ("Info", "Low", "Medium", "High", "Critical")
    assert {r.event_row_id: r.severity for r in Q.QUERIES["jn1b_group_timeline"](spark, sf_dir).collect()} == {k: names[v] for k, v in highest.items()}
    related = {r.row_id for r in Q.QUERIES["set1b_group_related_ids"](spark, sf_dir).collect()}
    chain = {r.row_id for r in Q.QUERIES["cor1b_compromised_account_events"](spark, sf_dir).collect()}
    assert related == {m.row_id for m in got} | {i for f in found for i in f.related_event_row_ids} | chain


def at(seconds):
    return dt.datetime(2026, 1, 1) + dt.timedelta(seconds=seconds)


def test_new_user_has_all_additions(spark):
    rows = [(1, 4720, at(0), "eve", {})] + [(i, 4732, at(i), "Administrators", {"membername": "LAB\\\\eve", "targetusername": "Administrators"}) for i in (2, 3, 4, 2000)]
    ev = as_events(spark.createDataFrame(rows, "row_id long, event_id int, time_created_utc timestamp, target_user_name string, properties map<string,string>"))
    found = new_users(ev)
    assert [(r.n_related, r.severity) for r in found.collect()] == [(4, "High")]
    assert sorted(r.row_id for r in finding_events(ev, found).collect()) == [2, 3, 4]


EVENTS_DDL = "row_id long, event_id int, time_created_utc timestamp, target_user_name string, properties map<string,string>"


def test_hits_of_new_users_equal_those_of_all_pairs(spark):
    rnd = random.Random(7)
    rows = [(i, 4720, at(rnd.randrange(5000)), rnd.choice(["eve", "bob", None]), {}) for i in range(1, 200)]
    rows += [(i, 4732, at(rnd.randrange(5000)), "Administrators", {"membername": rnd.choice(["LAB\\\\eve", "LAB\\\\bob", "LAB\\\\bobeve"]), "targetusername": "Administrators"}) for i in range(200, 400)]
    ev, s = as_events(spark.createDataFrame(rows, EVENTS_DDL)), Settings(new_user_window_us=600_000_000)
    want = {}
    for c, g, us in new_user_additions(ev, s).select("row_id", "g_row", "g_us").collect():
        n, least, last = want.get(c, (0, g, us))
        want[c] = (n + 1, min(least, g), max(last, us))
    brute = Counter(c for c, e, t, name, _ in rows if e == 4720 and name for _, f, u, _, p in rows if f == 4732 and name in p["membername"] and 0 <= (u - t).total_seconds() <= 600)
    assert {c: n for c, (n, _, _) in want.items()} == brute
    assert {r.row_id: (r.hits, r.hit_row, r.hit_us) for r in new_user_hits(ev, s).collect()} == want


def test_many_new_users_and_additions_of_one_name_take_seconds(spark):
    """50 000 creations of one name and 50 000 additions within a window: linear, where pairs would be 1.25 * 10^9."""
    one = spark.range(100_000).selectExpr("id + 1 as row_id", "if(id % 2 = 0, 4720, 4732) as event_id", "timestamp_micros(1767225600000000 + id * 1000) as time_created_utc", "if(id % 2 = 0, 'eve', 'Administrators') as target_user_name",
        "if(id % 2 = 0, map(), map('membername', 'LAB/eve', 'targetusername', 'Administrators')) as properties")
    began = time.monotonic()
    got = new_users(as_events(one)).selectExpr("count(*)", "sum(n_related - 1)", "sum(last_us - first_us)").first()
    assert tuple(got) == (50_000, 50_000 * 50_001 // 2, sum((99_999 - i) * 1000 for i in range(0, 100_000, 2)))
    assert time.monotonic() - began < 60


def test_chain_has_all_failures(spark):
    rows = [(i + 1, 4625, at(i // 2), "bob", "bob", "10.0.0.1") for i in range(40)] + [(50, 4624, at(30), "bob", "bob", "10.0.0.1"), (51, 4672, at(40), "bob", None, None), (60, 4625, at(5), "eve", "eve", "10.0.0.2")]
    ev = as_events(spark.createDataFrame(rows, "row_id long, event_id int, time_created_utc timestamp, user_name string, target_user_name string, source_ip string"))
    assert [r.details for r in compromised_account(ev).collect()] == ["failures=40; account=bob|10.0.0.1"]
    assert sorted(r.row_id for r in compromised_account_events(ev).collect()) == [*range(1, 41), 50, 51]


def test_analysis_shows_all_events_of_a_group(spark):
    rows = [(i, 4625, at(i), "bob", "bob", "10.0.0.1") for i in range(1, 8)]
    ev = as_events(spark.createDataFrame(rows, "row_id long, event_id int, time_created_utc timestamp, user_name string, target_user_name string, source_ip string"))
    iocs = spark.createDataFrame([], "type string, value string, comment string, source string")
    cves = spark.createDataFrame([], "cve_id string, vulnerability_name string, short_description string, vendor_project string, product string, known_ransomware_use string")
    got = analyze(ev, iocs, cves)
    assert {r.event_row_id: r.severity for r in got["timeline"].collect()} == {i: "Medium" for i in range(1, 8)}
    assert sorted(r.row_id for r in got["related"].collect()) == list(range(1, 8))
