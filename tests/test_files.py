"""Sinks read back, the assignment log, the one-call run."""

import json

import pytest
from pyspark.sql import functions as F

from slaframe import dims
from slaframe.operators import filters, queue
from slaframe.plans.pipeline import run_pipeline
from slaframe.session import fresh_dir
from slaframe.sources import files
from slaframe.sources.tickets import ticket_folders, tickets

from conftest import SF_SMALL


def test_csv_round_trip(spark):
    odd = ["a,b", 'say "hi"', "line\nbreak", "dos\r\nbreak", "  padded ", "", None, '"', '""', ",", "é✓", "\\", 'back\\"slash', "tab\t"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, note string").selectExpr(
        "i", "note", "timestamp_ntz '2025-11-26 10:11:12.123456' AS at", "CASE WHEN i % 2 = 0 THEN i / 3.0D END AS x", "i % 3 = 0 AS b").repartition(3)
    path = fresh_dir(spark, "test-csv")
    files.write_csv(df, path)
    assert sorted(files.read_csv(spark, path, df.schema).collect()) == sorted(df.collect())


def test_help_text_survives_parquet(spark):
    path = fresh_dir(spark, "test-help")
    filters.with_display_names(tickets(spark, SF_SMALL).select("ticket_id", "severity")).write.parquet(path)
    got = {r.column: (r.label, r.help, r.filled) for r in filters.column_help(spark.read.parquet(path)).collect()}
    n = tickets(spark, SF_SMALL).count()
    assert got == {"ticket_id": ("Ticket Id", "", n), "severity": ("Severity", dims.help_of("severity"), n)}


def test_date_folders_are_pruned(spark):
    t = ticket_folders(spark, SF_SMALL)
    spec = filters.FilterSpec(date_from="2025-08-01", date_to="2025-11-30", prob_min=0.3)
    for df in (filters.filter_dates(t, "2025-09-01", "2025-10-15"), filters.apply_filters(t, spec)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scan = next(x for x in plan.splitlines() if "PartitionFilters" in x)
        assert "created_date" in scan.split("PartitionFilters: [")[1].split("]")[0]
    want = tickets(spark, SF_SMALL).where(filters.filter_predicate(spec)).count()
    assert filters.apply_filters(t, spec).count() == want > 0


def test_log_append_again_and_clear(spark):
    log = queue.assignments_from(tickets(spark, SF_SMALL)).checkpoint()
    path, n = fresh_dir(spark, "test-log"), log.count()
    assert queue.read_assignments(spark, path).count() == 0
    assert queue.clear_assignments(spark, path).count() == 0
    queue.append_assignments(log, path, 0)
    queue.append_assignments(log, path, 0)
    assert queue.read_assignments(spark, path).count() == n > 0
    queue.append_assignments(log, path, 1)
    assert queue.read_assignments(spark, path).count() == 2 * n
    assert queue.clear_assignments(spark, path).count() == 0
    queue.append_assignments(log.limit(3), path, 2)
    assert queue.read_assignments(spark, path).count() == 3


def _counted(spark, df):
    """``df`` and an accumulator of the rows that were read from it."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_one_call_run_reads_its_table_once(spark):
    rows = tickets(spark, SF_SMALL).checkpoint()
    df, seen = _counted(spark, rows)
    out = fresh_dir(spark, "test-run")
    got = run_pipeline(df, out, fit=lambda train: __import__("slaframe.operators.model", fromlist=["m"]).train_gbt(train, max_iter=5), repeats=1)
    n = rows.count()
    assert seen.value == n == got["tickets"] == got["predicted"]
    assert got["verdict"] == "PASS" and got["auc"] > 0.7 and 0 < got["brier"] < 0.25
    assert got["breach_rate"] == pytest.approx(rows.agg(F.avg("sla_breach")).first()[0])
    assert set(got["dashboard_readiness"]) == {"already_breached_pct", "critical_count", "dire_count", "high_risk_count"}
    assert json.loads(spark.read.text(f"{out}/summary").first().value) == got
    assert files.load_predictions(spark, got["predictions"]).count() == n
    assert files.read_importance(spark, got["feature_importance"]).count() == 16
    assert files.load_model(got["model"]).stages


@pytest.mark.parametrize("label", ["0", "1", "CAST(NULL AS INT)"])
def test_one_call_run_stops_on_a_constant_label(spark, label):
    def never(train):
        raise AssertionError("fitted")

    df = tickets(spark, SF_SMALL).withColumn("sla_breach", F.expr(label))
    got = run_pipeline(df, fresh_dir(spark, "test-stop"), fit=never)
    assert got["verdict"] == "FATAL" and "model" not in got and files.read_tickets(spark, got["data"]).count() == got["tickets"]


def test_one_call_run_on_no_rows(spark):
    got = run_pipeline(tickets(spark, SF_SMALL).where("false"), fresh_dir(spark, "test-empty"))
    assert got["verdict"] == "FATAL" and got["tickets"] == 0
