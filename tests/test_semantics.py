"""Edge cases of the reference's semantics on hand-made rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slaframe import dims
from slaframe.functions.exprs import clean_number, round_half_even
from slaframe.operators import checks, enrich, filters, impact, kpis, queue, urgency
from slaframe.operators import model as M

AS_OF = dt.datetime(2025, 11, 26)


def ticket_rows(spark, rows):
    """rows: dicts with a subset of ticket columns; others get defaults."""
    base = {"ticket_id": "t", "created_at": AS_OF, "district": "Pune", "ward": "W01", "dept": "Health",
            "category": "clinic_wait", "severity": 2, "citizen_sentiment": 0.0, "vulnerable_population": 0,
            "historical_backlog": 10, "resource_availability": 0.5, "weather_rain_mm": 1.0, "traffic_index": 50,
            "festival_season": 0, "created_hour": 0, "is_business_hours": 0, "is_weekend": 0,
            "sla_deadline_hours": 168, "sla_breach": 0, "resolution_hours": 10.0, "escalated": 0,
            "escalation_level": 0, "escalation_days": 0.5, "pred_sla_breach_prob": 0.5, "priority_score": 50.0,
            "reported_via": "app"}
    data = [tuple({**base, **r}[c] for c in dims.PREDICTION_COLUMNS) for r in rows]
    return spark.createDataFrame(data, dims.TICKET_SCHEMA)


def test_round_half_even_matches_numpy(spark):
    vals = [0.25, 0.35, 0.15, 2.5, 98.45, 12.05, -0.25, 0.05, 33.333, 1e-9]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_half_even("x", 1)).collect()]
    assert got == list(np.round(np.array(vals), 1))


def test_clean_number(spark):
    df = spark.createDataFrame([("abc",), (None,), ("NaN",), ("1.5",), ("-0.2",), ("0.42",)], "x string")
    got = [r[0] for r in df.select(clean_number("x", 0.0, 1.0)).collect()]
    assert got == [0.0, 0.0, 0.0, 1.0, 0.0, 0.42]


def test_urgency_bounds(spark):
    # 72 h window: created exactly 72 h before as_of -> 0 h left.
    rows = [
        {"ticket_id": "zero", "created_at": AS_OF - dt.timedelta(hours=72), "pred_sla_breach_prob": 0.9},
        {"ticket_id": "left24", "created_at": AS_OF - dt.timedelta(hours=48), "pred_sla_breach_prob": 0.9},
        {"ticket_id": "left72", "created_at": AS_OF, "pred_sla_breach_prob": 0.9},
        {"ticket_id": "left10", "created_at": AS_OF - dt.timedelta(hours=62), "pred_sla_breach_prob": 0.81},
        {"ticket_id": "late", "created_at": AS_OF - dt.timedelta(hours=73), "pred_sla_breach_prob": 0.9},
    ]
    u = urgency.with_urgency(ticket_rows(spark, rows))
    got = {r.ticket_id: (r.already_breached, r.c, r.d) for r in u.select(
        "ticket_id", "already_breached", urgency.critical().alias("c"), urgency.dire().alias("d")).collect()}
    assert got["zero"] == (False, False, False)
    assert got["left24"] == (False, False, True)
    assert got["left72"] == (False, False, True)
    assert got["left10"] == (False, True, False)
    assert got["late"] == (True, False, False)


def test_idxmax_and_mode_ties(spark):
    rows = [
        {"ticket_id": "1", "dept": "Water", "district": "Thane", "category": "b", "pred_sla_breach_prob": 0.5},
        {"ticket_id": "2", "dept": "Health", "district": "Pune", "category": "a", "pred_sla_breach_prob": 0.5},
        {"ticket_id": "3", "dept": None, "district": "Pune", "category": "b", "pred_sla_breach_prob": 0.9},
        {"ticket_id": "4", "dept": "Roads", "district": "Thane", "category": "a", "pred_sla_breach_prob": 0.1},
    ]
    df = ticket_rows(spark, rows)
    summary = kpis.executive_summary(df).collect()[0]
    # Health and Water tie at 0.5; the null department is not a candidate.
    assert summary.top_dept == "Health"
    assert summary.top_category == "a"  # a and b tie at 2
    assert summary.dept_count == 4  # null counts as a value, like pandas unique()
    assert kpis.top_dept(df).collect()[0].dept == "Health"
    assert kpis.top_category(df).collect()[0].category == "a"
    assert kpis.dept_count(df).collect()[0].dept_count == 4


def test_empty_kpis(spark):
    df = ticket_rows(spark, [{"severity": 1}]).where(F.col("severity") > 5)
    k = kpis.kpis(df).collect()[0]
    assert (k.tickets, k.mean_risk, k.breach_rate, k.risk_status) == (0, 0.0, 0.0, "LOW")


def test_status_and_band_boundaries(spark):
    from slaframe.functions.exprs import risk_band, risk_status
    df = spark.createDataFrame([(0.2,), (0.3,), (0.19,), (0.31,)], "x double")
    got = [(r.s, r.b) for r in df.select(risk_status("x").alias("s"), risk_band("x").alias("b")).collect()]
    assert got == [("LOW", "medium"), ("MEDIUM", "high"), ("LOW", "low"), ("HIGH", "high")]


def test_search_is_regex_and_null_safe(spark):
    rows = [{"ticket_id": "A1", "category": None, "ward": "W10"},
            {"ticket_id": "b2", "category": "pipe_leak", "ward": "W02"}]
    df = ticket_rows(spark, rows)
    assert {r.ticket_id for r in df.where(filters.search_pred("LEAK|w1")).collect()} == {"A1", "b2"}
    assert df.where(filters.search_pred("   ")).count() == 2


def test_scenarios_ignore_dept_picker(spark):
    rows = [{"ticket_id": "1", "festival_season": 1, "dept": "Health"},
            {"ticket_id": "2", "festival_season": 1, "dept": "Roads"}]
    df = ticket_rows(spark, rows)
    spec = filters.FilterSpec(scenario="Festival Period", depts=["Health"])
    assert df.where(filters.filter_predicate(spec)).count() == 2
    spec = filters.FilterSpec(scenario="Custom Filters", depts=["Health"])
    assert df.where(filters.filter_predicate(spec)).count() == 1


def test_zero_weights_fall_back_to_defaults():
    w = queue.normalised_weights({"risk": 0, "severity": 0, "vuln": 0, "sent": 0, "fest": 0})
    assert w == (0.50, 0.20, 0.15, 0.10, 0.05)


def _roi_row(spark, tickets, breaches, dept, pct):
    rows = [{"ticket_id": str(i), "dept": dept, "sla_breach": 1 if i < breaches else 0} for i in range(tickets)]
    return impact.roi_grid(ticket_rows(spark, rows), steps=[pct]).collect()


def test_roi_unit_row(spark):
    (r,) = _roi_row(spark, 150, 60, "Roads", 20)
    assert (r.new_staff, r.monthly_cost, r.breaches_prevented, r.monthly_savings) == (1, 26449, 5, 24250)
    assert round(r.roi_percentage, 4) == -8.3176
    assert r.payback_months is None and r.verdict == "NOT VIABLE"


def test_roi_guards_and_zone4(spark):
    assert _roi_row(spark, 19, 5, "Roads", 20) == []
    assert _roi_row(spark, 150, 60, "Roads", 0) == []
    (r,) = _roi_row(spark, 1500, 600, "Health", 60)
    # zone 4: (31.5 + 2) * 1 - (60 - 50) * 0.1 = 32.5, times 0.9
    assert abs(r.reduction_pct - 29.25) < 1e-9


def test_floor_raises_low_rate(spark):
    rows = [{"ticket_id": str(i), "dept": "Education", "sla_breach": 0} for i in range(300)]
    (r,) = impact.roi_grid(ticket_rows(spark, rows), steps=[10]).collect()
    assert r.new_breach_rate == 0.05 and r.breaches_prevented == -15
    (c,) = impact.roi_grid(ticket_rows(spark, rows), steps=[10], floor_mode="cap").collect()
    assert c.new_breach_rate == 0.0 and c.breaches_prevented == 0


def test_quotas_sum_to_n():
    for n in (5000, 1, 17, 99999):
        q = enrich.quotas(n)
        assert sum(q.values()) == n
    assert enrich.quotas(5000) == {"Health": 1100, "Roads": 1350, "Water": 1000, "Education": 850, "Safety": 700}


def test_exact_stratified_flag_matches_brute_force(spark):
    from slaframe.functions.strata import exact_stratified_flag, hash_order
    n = 3000
    df = spark.createDataFrame([(str(i), ["a", "b", "c"][i % 3 if i < 2000 else 0]) for i in range(n)],
                               "ticket_id string, g string")
    quota = spark.createDataFrame([("a", 700), ("b", 10), ("c", 5000)], "g string, quota long")
    # One hex digit a level: the buckets hold many rows, the descent goes deep.
    got = exact_stratified_flag(df, "g", quota, hash_order(F.col("ticket_id")), "take", digits=1)
    pdf = df.withColumn("h", hash_order(F.col("ticket_id"))).toPandas()
    pdf = pdf.sort_values(["h", "ticket_id"])
    pdf["rn"] = pdf.groupby("g").cumcount() + 1
    limits = {"a": 700, "b": 10, "c": 5000}
    want = set(pdf[pdf.rn <= pdf.g.map(limits)].ticket_id)
    assert {r.ticket_id for r in got.where("take").collect()} == want
    assert got.count() == n


def test_exact_selection_with_all_keys_in_one_bucket(spark):
    """Keys that share 28 digits, and a repeated id that would exceed the quota."""
    from slaframe.functions.strata import exact_stratified_flag
    df = spark.range(5000).select(F.col("id"), F.lit("a").alias("g"), F.concat(F.lit("0" * 28), F.lpad(F.hex("id"), 4, "0")).alias("o"))
    quota = spark.createDataFrame([("a", 1234)], "g string, quota long")
    got = exact_stratified_flag(df, "g", quota, F.lower("o"), "take")
    assert sorted(r.id for r in got.where("take").collect()) == list(range(1234))
    rows = spark.createDataFrame([("x" if i < 60 else str(i),) for i in range(100)], "k string").withColumn("g", F.lit(1))
    got = exact_stratified_flag(rows, "g", lambda n: n * 0 + 50, F.md5("k"), "take")
    assert got.where("take and k = 'x'").count() == 0 and got.where("take").count() <= 50
    assert exact_stratified_flag(rows, "g", lambda n: n, F.md5("k"), "take").where("take").count() == 100
    assert exact_stratified_flag(rows, "g", lambda n: n * 0, F.md5("k"), "take").where("take").count() == 0
    assert exact_stratified_flag(rows.where("false"), "g", lambda n: n, F.md5("k"), "take").count() == 0


def _auc_brute(scores, labels):
    s = pd.Series(scores)
    ranks = s.rank(method="average")
    pos = np.array(labels) == 1
    n_pos, n_neg = pos.sum(), (~pos).sum()
    return (ranks[pos].sum() - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg)


def test_auc_matches_rank_formula(spark):
    rng = np.random.default_rng(7)
    scores = np.round(rng.random(2000), 3)  # many ties
    labels = (rng.random(2000) < scores).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(scores, labels)], "p double, sla_breach int")
    got = M.auc(df, "p", buckets=64).collect()[0].auc
    assert abs(got - _auc_brute(scores, labels)) < 1e-12


def test_permutation_pairing_is_a_permutation(spark):
    rows = [{"ticket_id": str(i), "severity": i % 3 + 1, "traffic_index": i} for i in range(500)]
    test = M.features(ticket_rows(spark, rows))
    paired = M._pairing(test, repeats=2, seed=42).toPandas()
    for r in (0, 1):
        part = paired[paired.repeat == r]
        assert sorted(part.ticket_id) == sorted(str(i) for i in range(500))
        assert sorted(part._p_traffic_index) == list(range(500))
        assert (part._p_traffic_index != part.traffic_index).mean() > 0.9


def test_dept_distribution_and_readiness(spark):
    rows = [{"ticket_id": str(i), "dept": d, "created_at": AS_OF - dt.timedelta(hours=h)}
            for i, (d, h) in enumerate([("Health", 1), ("Health", 100), ("Roads", 200), ("Water", 10)])]
    df = ticket_rows(spark, rows)
    dist = {r.dept: (r.tickets, r.pct) for r in checks.dept_distribution(df).collect()}
    assert dist["Health"] == (2, 50.0)
    r = checks.readiness(df).collect()[0]
    assert (r.total, r.already_breached, r.breached_verdict) == (4, 2, "PASS")


def test_labels():
    assert dims.label_of("pred_sla_breach_prob") == "Risk Score"
    assert dims.label_of("ticket_id") == "Ticket Id"


def test_urgency_against_a_column_of_windows(spark):
    df = spark.createDataFrame([("a", dt.datetime(2025, 11, 25), 168), ("b", dt.datetime(2025, 11, 25), 24),
                                ("c", dt.datetime(2025, 11, 25), 23), ("d", dt.datetime(2025, 11, 25), None)],
                               "ticket_id string, created_at timestamp_ntz, sla_deadline_hours int")
    got = {r.ticket_id: (r.hours_until_breach, r.already_breached)
           for r in urgency.with_urgency(df, "2025-11-26 00:00:00", F.col("sla_deadline_hours")).collect()}
    assert got == {"a": (144.0, False), "b": (0.0, False), "c": (-1.0, True), "d": (None, None)}
