"""Exports of all events and all sections against brute force."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberlog.plans import queries as Q
from emberlog.operators.detectors import log_clearing
from emberlog.plans import analyze as A
from emberlog.plans.adapter import PROPERTIES, log_events, spread


def test_all_events_are_exported(spark, sf_dir):
    ev = log_events(spark, sf_dir).collect()
    got = {r.EventRowId: r for r in Q.QUERIES["snk3b_export_all_events"](spark, sf_dir).collect()}
    assert len(got) == len(ev) and any(len(r.properties) > 1 for r in ev)
    for r in ev:
        told = got[r.row_id].PropertiesJson
        assert (list(json.loads(told).items()) if told else []) == [(k, r.properties[k]) for k in PROPERTIES if k in r.properties]
        assert got[r.row_id].LogonType == r.logon_type


def test_all_sections_are_exported(spark, sf_dir):
    ev = log_events(spark, sf_dir).selectExpr("*", "date_format(time_created_utc, 'HH') AS hour").collect()
    found = Q.QUERIES["d22_all_detectors"](spark, sf_dir).collect()
    top = lambda values, k=None: sorted(Counter(v for v in values if v).items(), key=lambda x: (-x[1], x[0]))[:k]
    want = {
        "EventIdCounts": top((str(r.event_id) for r in ev), 30), "UserCounts": top((r.user_name or r.target_user_name or "(unknown)" for r in ev), 20),
        "ProcessCounts": top((r.process_name for r in ev), 20), "SourceIpCounts": top((r.source_ip for r in ev), 20), "EventsByHour": top(f"{r.hour}:00" for r in ev),
        "FindingsBySeverity": top(r.severity for r in found), "Summary": [("TotalEvents", len(ev)), ("TotalFindings", len(found))],
    }
    got = Q.QUERIES["snk4b_export_all_statistics"](spark, sf_dir).collect()
    assert sorted((r.section, r.key, r.value) for r in got if r.section != "Filter") == sorted((s, k, str(n)) for s, rows in want.items() for k, n in rows)
    assert sum(r.section == "Filter" for r in got) == 9


def test_detectors_read_events_that_are_written_once(spark, sf_dir, monkeypatch):
    seen, real = [], Q.run_detectors

    def one(ev, settings, **more):
        seen.append(ev.inputFiles())
        return real(ev, settings, detectors={"log_clearing": log_clearing}, **more)

    monkeypatch.setattr(Q, "run_detectors", one)
    Q.QUERIES["snk4b_export_all_statistics"](spark, sf_dir)
    assert seen[0] and not any("events.parquet" in f for f in seen[0])


def test_events_of_one_file_are_spread_over_the_cores(spark, sf_dir):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    assert log_events(spark, sf_dir).rdd.getNumPartitions() >= cores


@pytest.mark.parametrize("broken", [
    lambda ev, s: log_clearing(ev, s).withColumn("title", F.raise_error(F.lit("no")).cast("string")),
    lambda ev, s: ev.select("nothing of that name"),
], ids=["runs", "planned"])
def test_a_detector_that_fails_is_no_result(spark, sf_dir, monkeypatch, broken):
    monkeypatch.setattr(A, "DETECTORS", {"log_clearing": log_clearing, "broken": broken})
    for name in ("snk4b_export_all_statistics", "d22_all_detectors"):
        with pytest.raises(RuntimeError, match="detector broken failed"):
            Q.QUERIES[name](spark, sf_dir).collect()


def test_an_analysis_leaves_a_detector_out_only_if_told(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(A, "DETECTORS", {"log_clearing": log_clearing, "broken": lambda ev, s: ev.select("nothing of that name")})
    ev = log_events(spark, sf_dir)
    iocs = spark.createDataFrame([], "type string, value string, comment string, source string")
    cves = spark.createDataFrame([], "cve_id string, vulnerability_name string, short_description string, vendor_project string, product string, known_ransomware_use string")
    with pytest.raises(RuntimeError, match="detector broken failed"):
        A.analyze(ev, iocs, cves)
    assert {r.rule_name for r in A.analyze(ev, iocs, cves, whole=False)["findings"].collect()} == {"LogClearing"}
