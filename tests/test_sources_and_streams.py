"""Readers, normalisation, merging and streams on small fixtures."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from emberlog.operators import merge, normalize
from emberlog.schema import as_events
from emberlog.sources import readers
from emberlog.streaming import jobs

HEAD = '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="{p}"/><EventID>{i}</EventID><Level>0</Level><TimeCreated SystemTime="2024-01-02T03:04:05.1234567Z"/><EventRecordID>{r}</EventRecordID><Channel>{c}</Channel><Computer>WS-01</Computer><Security UserID="S-1-5-18"/></System>'


def xml(data: str, i=4625, p="Microsoft-Windows-Security-Auditing", c="Security", r=7) -> str:
    return HEAD.format(i=i, p=p, c=c, r=r) + data + "</Event>"


FAILED = xml("<EventData><Data Name='TargetUserName'>labuser</Data><Data Name='TargetDomainName'>LAB</Data><Data Name='IpAddress'>10.0.0.50</Data><Data Name='LogonType'>3</Data><Data Name='ProcessName'>-</Data><Data>one</Data><Data>two</Data></EventData>")
START = xml("<EventData><Data Name='NewProcessName'>C:\\Windows\\cmd.exe</Data><Data Name='NewProcessId'>0x2e0</Data><Data Name='ProcessId'>0x4</Data><Data Name='SubjectUserName'>bob</Data></EventData>", i=4688, r=8)
CLEARED = xml("<UserData><LogFileCleared xmlns='x'><SubjectUserName>eve &amp; co</SubjectUserName><Channel>System</Channel></LogFileCleared></UserData>", i=104, p="Microsoft-Windows-Eventlog", c="System", r=9)


def test_event_xml(spark):
    raw = spark.createDataFrame([(FAILED,), (START,), (CLEARED,), ("<Event><broken",)], "raw_xml string")
    got = {r.event_id: r for r in normalize.normalize_xml(raw).collect()}
    assert set(got) == {4625, 4688, 104}
    f = got[4625]
    assert (f.target_user_name, f.user_name, f.domain, f.source_ip, f.logon_type, f.process_name, f.level, f.event_record_id) == ("labuser", "labuser", "LAB", "10.0.0.50", 3, None, "LogAlways", 7)
    assert f.properties["data0"] == "one" and f.properties["data1"] == "two" and f.properties["securityuserid"] == "S-1-5-18"
    assert f.event_key == "ws-01|security|microsoft-windows-security-auditing|4625|record:7"
    assert (got[4688].process_name, got[4688].process_id, got[4688].parent_process_id, got[4688].user_name) == ("cmd.exe", 736, 4, "bob")
    assert got[104].properties["subjectusername"] == "eve & co"


def test_feeds_and_catalogues(spark, tmp_path):
    text = tmp_path / "ips.txt"
    text.write_text("# no\n\n1.2.3.4 x\n127.0.0.1 bad.example.test\n5.6.7.8,y\n")
    assert {(r.type, r.value) for r in readers.read_ioc_text(spark, str(text), "ip", "s").collect()} == {("ip", "1.2.3.4"), ("domain", "bad.example.test"), ("ip", "5.6.7.8")}
    nets = tmp_path / "nets.json"
    nets.write_text('{"cidr":"1.10.16.0/20"}\n\nnot-json\n{"cidr":"2.26.75.0/24"}\n')
    assert {r.value for r in readers.read_ioc_cidr_ndjson(spark, str(nets), "s").collect()} == {"1.10.16.0", "2.26.75.0"}
    mixed = tmp_path / "mixed.txt"
    mixed.write_text("1.2.3.4\n" + "a" * 32 + "\nhttp://x.test/a\nevil.test\n")
    assert {r.type for r in readers.read_ioc_mixed(spark, str(mixed), "s").collect()} == {"ip", "hash", "url", "domain"}
    csv = tmp_path / "urls.csv"
    csv.write_text('# c\n"1","http://h.test/p?q","x"\nshort\n')
    assert {(r.type, r.value) for r in readers.read_ioc_url_csv(spark, str(csv), "s").collect()} == {("url", "http://h.test/p?q"), ("domain", "h.test")}
    cve = tmp_path / "cve.json"
    cve.write_text(json.dumps({"vulnerabilities": [{"cveID": " cve-2024-1234 ", "product": "p", "dateAdded": "2024-01-02"}, {"cveID": " "}]}))
    assert [(r.cve_id, str(r.date_added)) for r in readers.read_cve_catalog(spark, str(cve)).collect()] == [("CVE-2024-1234", "2024-01-02")]
    bundle = tmp_path / "attack.json"
    ref = [{"source_name": "mitre-attack", "external_id": "T1033", "url": "u"}]
    bundle.write_text(json.dumps({"objects": [{"type": "attack-pattern", "name": "n", "external_references": ref, "kill_chain_phases": [{"phase_name": "Discovery"}, {"phase_name": "discovery"}]}, {"type": "attack-pattern", "name": "old", "revoked": True, "external_references": ref}, {"type": "x-mitre-tactic", "name": "Discovery", "x_mitre_shortname": "discovery", "external_references": [{"source_name": "mitre-attack", "external_id": "TA0007", "url": "v"}]}]}))
    techniques, tactics = readers.read_attack_bundle(spark, str(bundle))
    assert [(r.technique_id, r.tactic_short_names) for r in techniques.collect()] == [("T1033", ["discovery"])] and tactics.count() == 1


def test_merge_keeps_rich_values(spark):
    rows = [("k", 3, "a", None, 1), ("k", 5, None, "b", 2), ("k", 5, "late", "late", 3), ("k", 2, "poor", "poor", 4)]
    d = spark.createDataFrame(rows, "event_key string, completeness_score int, user_name string, process_name string, n long")
    assert [tuple(r) for r in merge.upsert_events(None, d, "n").collect()] == [("k", 5, "a", "b")]


def test_stream_equals_batch(spark, tmp_path):
    raw = spark.createDataFrame([(FAILED,), (START,)], "raw_xml string")
    events = as_events(normalize.normalize_xml(raw))
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    events.write.parquet(source)
    for _ in range(2):
        q = jobs.collect_incrementally(normalize.with_identity(jobs.stream_events(spark, source)), table, str(tmp_path / "cp"))
        q.awaitTermination(60)
        events.where("event_id = 4625").withColumn("user_name", F.lit("again")).write.mode("append").parquet(source)
    got = jobs.collected(spark, table)
    assert got.count() == 2 and {r.user_name for r in got.collect()} == {"labuser", "bob"}


def test_a_job_that_dies_between_its_writes_loses_nothing(spark, tmp_path, monkeypatch):
    events = as_events(normalize.normalize_xml(spark.createDataFrame([(FAILED,), (START,)], "raw_xml string")))
    more = events.withColumn("user_name", F.lit("richer")).withColumn("script_block", F.lit("x"))

    def run(name, dies=()):
        source, table, at = (str(tmp_path / name / part) for part in ("in", "table", "cp"))
        for n, part in enumerate((events, more)):
            part.write.mode("append").parquet(source)
            for how in ("commit", "write"):
                if (n, how) in dies:
                    with monkeypatch.context() as m:
                        real = getattr(jobs.EventTable, how)

                        def fail(self, *args, how=how, real=real):
                            if how == "write":
                                real(self, *args)  # all is written, and the job dies before it says so
                            raise OSError("lost")

                        m.setattr(jobs.EventTable, how, fail)
                        with pytest.raises(Exception, match="lost"):
                            jobs.collect_incrementally(normalize.with_identity(jobs.stream_events(spark, source)), table, at).awaitTermination(120)
            jobs.collect_incrementally(normalize.with_identity(jobs.stream_events(spark, source)), table, at).awaitTermination(120)
        return sorted(str(r.asDict()) for r in jobs.collected(spark, table).collect())

    clean = run("clean")
    assert len(clean) == 2 and run("killed", {(0, "commit"), (1, "write"), (1, "commit")}) == clean


def test_a_table_that_cannot_be_read_is_no_empty_table(spark, tmp_path):
    table = jobs.EventTable(spark, str(tmp_path / "t"))
    assert table.days() is None and jobs.collected(spark, str(tmp_path / "t")) is None
    day = datetime.date(2024, 1, 2)
    table.commit([day], "q", 0, "batch=gone")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        table.days([day])
    assert table.has("q", 0) and not table.has("q", 1) and not table.has("other", 0)


def test_another_stream_into_the_table_and_events_without_a_day(spark, tmp_path):
    events = as_events(normalize.normalize_xml(spark.createDataFrame([(FAILED,)], "raw_xml string")))
    table = str(tmp_path / "t")
    for n, user in enumerate(("a", "b")):
        rows = normalize.with_identity(events.withColumn("user_name", F.lit(user)).withColumn("computer_name", F.lit(f"h{n}")))
        rows.write.parquet(str(tmp_path / f"in{n}"))
        keyed = spark.readStream.schema(rows.schema).parquet(str(tmp_path / f"in{n}")).withColumn("event_date", F.lit(None).cast("date"))
        for _ in range(2):  # both begin with batch 0
            jobs.collect_incrementally(keyed, table, str(tmp_path / f"cp{n}")).awaitTermination(120)
    assert sorted(r.user_name for r in jobs.collected(spark, table).collect()) == ["a", "b"]
