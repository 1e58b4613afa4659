"""Registered queries against their SQL on DuckDB, and on one against many partitions."""

import os

import duckdb
import pandas as pd
import pytest

from emberlog.plans import registry as Q

#: One or two of each family; the driver compares them all.
NAMES = (
    "fn7_parse_hashes", "nrm9_event_key", "nrm11_completeness", "mrg1_upsert", "flt1_fields", "flt7_merge_ranges", "agg1_statistics", "det1_classify", "d1_failed_logon",
    "d3_brute_force", "d3c_password_spray", "d4_new_user", "d7_powershell", "d15_defenseevasion", "d14_own_signatures", "sig_rules", "cor3_task_persistence", "cor5_remote_logon",
    "ioc3_matches", "cve1_matches", "jn2_enrich_attack", "snk3_export_events", "nrm8_fallback", "src3_ioc_json", "src9_attack_bundle", "src11_rules", "mrg5_attack_dimension", "d8_preview",
    "d14b_validated_signatures", "sig9b_rule_matches", "snk3b_export_all_events", "str3_windows",
)


def rows(pdf: pd.DataFrame) -> list:
    pdf = pdf[sorted(pdf.columns)].astype(object).where(pdf.notna(), None)
    return sorted(tuple(str(v) if not isinstance(v, float) else str(int(v)) if v.is_integer() else f"{v:.6g}" for v in r) for r in pdf.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("events", "customer", "nation", "pages", "documents"):
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert rows(Q.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(Q.ORACLES[name]).df())


def test_result_does_not_depend_on_partitions(spark, sf_dir):
    from emberlog.operators.detectors import brute_force
    from emberlog.plans.adapter import log_events
    from emberlog.plans.queries import SETTINGS

    ev = log_events(spark, sf_dir)
    got = [sorted(map(str, brute_force(ev.repartition(n), SETTINGS).select("title", "event_row_id", "n_related").collect())) for n in (1, 7)]
    assert got[0] == got[1] and got[0]


def test_a_detector_that_fails_is_left_out(spark, sf_dir):
    from pyspark.sql import functions as F

    from emberlog.operators.detectors import log_clearing, service_installs
    from emberlog.plans.adapter import log_events
    from emberlog.plans.analyze import run_detectors

    def broken(ev, s):
        return service_installs(ev, s).withColumn("title", F.raise_error(F.lit("no")).cast("string"))

    def unplanned(ev, s):
        return ev.select("nothing of that name")

    ev = log_events(spark, sf_dir)
    got = run_detectors(ev, detectors={"a": broken, "b": unplanned, "c": log_clearing})
    assert {r.rule_name for r in got.collect()} == {"LogClearing"}
    assert run_detectors(ev, detectors={"a": broken}).count() == 0


def test_a_rule_with_a_broken_pattern_is_left_out():
    from emberlog.sources.readers import parse_rules

    text = "title: A\ndetection: {s: {CommandLine|re: '(['}, condition: s}\n---\ntitle: B\ndetection: {s: {CommandLine|re: 'a+'}, condition: s}"
    assert [r.title for r in parse_rules(text)] == ["B"]
