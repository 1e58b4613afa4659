"""Rules, text helpers and stateless streams."""

import base64
import datetime as dt

from pyspark.sql import functions as F

from emberlog.functions import text as T
from emberlog.operators import filters, intel, sigma
from emberlog.plans.adapter import log_events
from emberlog.plans.queries import RULES_YAML
from emberlog.sources.readers import parse_rules
from emberlog.streaming import jobs

ODD = """
title: All
logsource: {product: windows}
detection:
  s: {CommandLine|contains|all: [a, b]}
  t: [{EventID: 1}, {EventID: 2}]
  condition: s or t
---
title: [broken
---
title: Them
detection: {s: {EventID: 1}, condition: 1 of them}
"""


def test_rule_parsing():
    strict, full = parse_rules(ODD), parse_rules(ODD, strict=False)
    assert [r.title for r in strict] == ["All", "Them"]
    assert strict[0].selections["s"].fields[0].modifier == "equals" and strict[0].selections["t"] == sigma.Selection()
    assert full[0].selections["s"].fields[0].every and len(full[0].selections["t"].options) == 2
    assert [r.id for r in sigma.select_rules(parse_rules(RULES_YAML))] == ["r1", "r2", "r3", "r4"]
    assert [r.id for r in sigma.select_rules(parse_rules(RULES_YAML), experimental=True)][-1] == "r5"
    assert sigma.attack_tags(["x", "attack.t1033", "attack.discovery", "ATTACK.T1033"])[:2] == ("attack.discovery", "attack.t1033")


def test_conditions(spark):
    d = spark.createDataFrame([(True, False, True)], "a boolean, b boolean, ab boolean")
    names = {c: c for c in d.columns}
    cases = {"a and not b": True, "b or (a and ab)": True, "2 of a*": True, "all of a*": True, "3 of a*": False, "1 of them": False, "not (a or b)": False, "a | count() > 5": True, "": False, "nobody": False}
    got = d.select(*(F.expr(sigma.condition_sql(c, names)).alias(str(i)) for i, c in enumerate(cases))).first()
    assert list(got) == list(cases.values())


def test_base64_preview(spark):
    wide = base64.b64encode("IEX".encode("utf-16-le")).decode()
    rows = [(wide,), (base64.b64encode(b"abc").decode(),), ("!!",), (None,), ("'" + wide.rstrip("=") + "'",)]
    got = [r.p for r in spark.createDataFrame(rows, "t string").select(T.decode_base64_preview(F.col("t")).alias("p")).collect()]
    assert got == ["IEX", "abc", None, None, "IEX"]


def test_date_expressions():
    day = lambda *a: dt.datetime(2024, 1, *a)
    end = dt.timedelta(days=1) - dt.timedelta(microseconds=1)
    assert [(r.start, r.end) for r in filters.parse_date_expression("2024-01-02,2024-01-03, 2024-01-09/2024-01-10")] == [(day(2), day(3) + end), (day(9), day(10) + end)]
    assert filters.build_filter(ids="1, x;4688").event_ids == (1, 4688)


def test_indicators_that_overlap_are_all_found(spark):
    events = spark.createDataFrame([(1, "xaBcdx", None), (2, None, "zz"), (3, "b", "ABC")], "row_id long, command_line string, raw_xml string")
    patterns = spark.createDataFrame([(v,) for v in ("abc", "bcd", "B", "")], "value string")
    got = intel.contains_scan(events, patterns, ["command_line", "raw_xml"]).collect()
    assert sorted(map(tuple, got)) == sorted([(1, "command_line", "abc"), (1, "command_line", "b"), (1, "command_line", "bcd"), (3, "command_line", "b"), (3, "raw_xml", "abc"), (3, "raw_xml", "b")])


def test_stateless_stream_equals_batch(spark, sf_dir, tmp_path):
    events = log_events(spark, sf_dir)
    source = str(tmp_path / "events")
    events.write.parquet(source)
    chosen = {k: jobs.STATELESS[k] for k in ("log_clearing", "service_install")}
    q = jobs.stream_findings(jobs.stream_events(spark, source), detectors=chosen).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("found").count() == jobs.stream_findings(events, detectors=chosen).count() > 0


def test_windowed_counts_stream(spark, sf_dir, tmp_path):
    source = str(tmp_path / "events")
    log_events(spark, sf_dir).write.parquet(source)
    q = jobs.failed_logon_windows(jobs.stream_events(spark, source), 1, "1 day", "1 day").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("windows").where("n >= 1").count() > 0
