"""Registry of named queries: a Spark callable and, where SQL can express it,
the equivalent DuckDB oracle SQL.

Every query reads the whole given tables (through ``tickets`` or ``events``);
none samples, caps or filters by id to stay cheap. Limits appear only where
the limit is the feature (top-k reports, the queue, the quota sample).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import risk_band
from ..operators import checks, enrich, filters, impact, kpis, monitor, queue, urgency
from ..session import fresh_dir
from ..sources import files
from ..sources.tickets import stored_tickets as tickets
from ..sources.tickets import ticket_folders
from .sql import AS_OF_SQL, age_days, case_map, d, hours_since, round_even, s, str_list, with_tickets


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _bigint_counts(sql: str) -> str:
    """DuckDB's ``count_if`` is HUGEINT; cast it to BIGINT like Spark's."""
    out, i = [], 0
    while True:
        j = sql.find("count_if(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len("count_if")
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, _bigint_counts(sql) if sql else None)
        return fn
    return deco


def r6(c):
    """Spark side of the 6-decimal rounding used for exp- and sum-order-
    sensitive doubles."""
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


T = tickets  # (spark, sf_dir) -> tickets DataFrame

# ---------------------------------------------------------------- sources


@register("s09_tickets", with_tickets(
    "SELECT * EXCLUDE (pred_sla_breach_prob, resolution_hours, escalation_days), "
    "round(pred_sla_breach_prob, 6) AS pred_sla_breach_prob, round(resolution_hours, 6) AS resolution_hours, "
    "round(escalation_days, 6) AS escalation_days FROM tickets"))
def s09_tickets(spark, sf):
    t = T(spark, sf)
    return t.withColumns({c: r6(c) for c in ("pred_sla_breach_prob", "resolution_hours", "escalation_days")})


@register("s04_predictions_projection", with_tickets(
    "SELECT ticket_id, created_at, dept, sla_breach, round(pred_sla_breach_prob, 6) AS pred_sla_breach_prob, "
    "priority_score, reported_via FROM tickets"))
def s04_predictions_projection(spark, sf):
    t = T(spark, sf).select(*dims.PREDICTION_COLUMNS)
    return t.select("ticket_id", "created_at", "dept", "sla_breach", r6("pred_sla_breach_prob")
                    .alias("pred_sla_breach_prob"), "priority_score", "reported_via")


# ---------------------------------------------------------------- enrichment

@register("e01_time_features", with_tickets(
    "SELECT ticket_id, CAST(hour(created_at) AS INTEGER) AS created_hour, "
    "CASE WHEN hour(created_at) BETWEEN 9 AND 17 THEN 1 ELSE 0 END AS is_business_hours, "
    "CASE WHEN isodow(created_at) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend FROM tickets"))
def e01_time_features(spark, sf):
    t = T(spark, sf).select("ticket_id", "created_at")
    return enrich.time_features(t).drop("created_at")


@register("e02_severity_lookup", with_tickets(
    f"SELECT ticket_id, category, CAST({case_map('category', dims.SEVERITY)} AS INTEGER) AS severity FROM tickets"))
def e02_severity_lookup(spark, sf):
    return enrich.severity_lookup(T(spark, sf).select("ticket_id", "category"))


@register("e03_sla_deadline", with_tickets(
    f"SELECT ticket_id, dept, CAST({case_map('dept', dims.SLA_HOURS)} AS INTEGER) AS sla_deadline_hours FROM tickets"))
def e03_sla_deadline(spark, sf):
    return enrich.sla_deadline(T(spark, sf).select("ticket_id", "dept"))


def _category_dim_sql() -> str:
    rows = ", ".join(f"({s(dep)}, {s(c)})" for dep, cs in dims.CATEGORIES.items() for c in cs)
    return f"_cat(dept, category) AS (VALUES {rows})"


@register("e04_category_domain", with_tickets(
    "SELECT t.dept, t.category, count(*) AS tickets, "
    "bool_or(_cat.category IS NOT NULL) AS in_domain "
    "FROM tickets t LEFT JOIN _cat ON t.dept = _cat.dept AND t.category = _cat.category "
    "GROUP BY t.dept, t.category", _category_dim_sql()))
def e04_category_domain(spark, sf):
    return enrich.category_domain(T(spark, sf))


@register("e05_district_pressure", with_tickets(
    f"SELECT ticket_id, district, {case_map('district', dims.DISTRICT_PRESSURE)} AS district_pressure FROM tickets"))
def e05_district_pressure(spark, sf):
    return enrich.district_pressure(T(spark, sf).select("ticket_id", "district"))


@register("e06_festival_flag", with_tickets(
    "SELECT ticket_id, CASE WHEN month(created_at) IN "
    f"({', '.join(map(str, dims.FESTIVAL_MONTHS))}) THEN 1 ELSE 0 END AS festival_month FROM tickets"))
def e06_festival_flag(spark, sf):
    return enrich.festival_flag(T(spark, sf).select("ticket_id", "created_at")).drop("created_at")


def _logit_sql(intercept: float = -1.5) -> str:
    return (f"({d(intercept)} + {d(0.8)} * severity + {d(1.2)} * vulnerable_population"
            f" + {d(0.8)} * (-citizen_sentiment) + {d(0.01)} * historical_backlog"
            f" + {d(1.0)} * ({d(1.0)} - resource_availability) + {d(0.005)} * weather_rain_mm"
            f" + {d(0.006)} * traffic_index + {d(0.6)} * {case_map('district', dims.DISTRICT_PRESSURE)}"
            f" + {d(0.5)} * festival_season + {d(0.4)} * ({d(1.0)} - is_business_hours)"
            f" + {d(0.5)} * is_weekend)")


@register("e07_breach_propensity", with_tickets(
    f"SELECT ticket_id, round(least(greatest({d(1)} / ({d(1)} + exp(-{_logit_sql()})), {d(0.001)}), {d(0.999)}), 6)"
    " AS breach_propensity FROM tickets"))
def e07_breach_propensity(spark, sf):
    return enrich.breach_propensity(T(spark, sf)).select("ticket_id", r6("breach_propensity").alias("breach_propensity"))


_EXPECTED_SQL = (f"({d(48)} + severity * {d(24)} + vulnerable_population * {d(36)}"
                 f" + (historical_backlog / {d(100)}) * {d(24)} + ({d(1)} - resource_availability) * {d(48)}"
                 f" + ({d(1)} - is_business_hours) * {d(12)} + is_weekend * {d(24)}"
                 f" + (weather_rain_mm / {d(50)}) * {d(12)} + (traffic_index / {d(100)}) * {d(6)})")


@register("e08_expected_resolution", with_tickets(
    f"SELECT ticket_id, {_EXPECTED_SQL} AS expected_resolution_hours FROM tickets"))
def e08_expected_resolution(spark, sf):
    return enrich.expected_resolution(T(spark, sf)).select("ticket_id", "expected_resolution_hours")


_RAW_SQL = f"(greatest({d(24)}, {_EXPECTED_SQL}) * ({d(1)} + pred_sla_breach_prob * {d(0.8)}))"


def _resolution(spark, sf):
    t = enrich.expected_resolution(T(spark, sf))
    return enrich.resolution_hours(t, "expected_resolution_hours")


@register("e09_resolution_hours", with_tickets(
    f"SELECT ticket_id, round(raw_hours, 6) AS raw_hours, raw_breach, round(least(raw_hours, "
    "CAST(sla_deadline_hours * 3 AS DOUBLE)), 6) AS capped_hours FROM (SELECT *, "
    f"{_RAW_SQL} AS raw_hours, CASE WHEN {_RAW_SQL} > sla_deadline_hours THEN 1 ELSE 0 END AS raw_breach FROM tickets)"))
def e09_resolution_hours(spark, sf):
    return _resolution(spark, sf).select("ticket_id", r6("raw_hours").alias("raw_hours"), "raw_breach",
                                         r6("capped_hours").alias("capped_hours"))


@register("e10_sla_breach_flag", with_tickets(
    "SELECT ticket_id, CASE WHEN resolution_hours > sla_deadline_hours THEN 1 ELSE 0 END AS breach_now FROM tickets"))
def e10_sla_breach_flag(spark, sf):
    t = T(spark, sf)
    return t.select("ticket_id", enrich.sla_breach_flag(F.col("resolution_hours"), F.col("sla_deadline_hours"))
                    .alias("breach_now"))


@register("e11_escalation_probability", with_tickets(
    f"SELECT ticket_id, round(least(greatest({d(0.1)} + {d(0.3)} * CASE WHEN pred_sla_breach_prob > 0.6 THEN "
    f"{d(1)} ELSE {d(0)} END + {d(0.2)} * (-citizen_sentiment) + {d(0.15)} * (severity / {d(3)}), {d(0)}), "
    f"{d(0.7)}), 6) AS p_escalate FROM tickets"))
def e11_escalation_probability(spark, sf):
    return enrich.escalation_probability(T(spark, sf)).select("ticket_id", r6("p_escalate").alias("p_escalate"))


@register("e12_escalation_speedup", with_tickets(
    "SELECT ticket_id, round(escalated_hours, 6) AS escalated_hours, CASE WHEN escalated = 1 THEN "
    "CASE WHEN escalated_hours > sla_deadline_hours THEN 1 ELSE 0 END ELSE raw_breach END AS escalated_breach FROM "
    "(SELECT *, CASE WHEN escalated = 1 THEN capped_hours * (CASE WHEN escalation_level = 1 THEN "
    f"{d(0.7)} WHEN escalation_level = 2 THEN {d(0.7)} * {d(0.7)} WHEN escalation_level = 3 THEN {d(0.7)} * {d(0.7)} * "
    f"{d(0.7)} ELSE {d(1)} END) ELSE capped_hours END AS escalated_hours FROM (SELECT *, "
    f"least({_RAW_SQL}, CAST(sla_deadline_hours * 3 AS DOUBLE)) AS capped_hours, CASE WHEN {_RAW_SQL} > "
    "sla_deadline_hours THEN 1 ELSE 0 END AS raw_breach FROM tickets))"))
def e12_escalation_speedup(spark, sf):
    t = enrich.escalation_speedup(_resolution(spark, sf))
    return t.select("ticket_id", r6("escalated_hours").alias("escalated_hours"), "escalated_breach")


@register("e13_escalation_days", with_tickets(
    f"SELECT ticket_id, round(resolution_hours / {d(24)}, 6) AS escalation_days FROM tickets"))
def e13_escalation_days(spark, sf):
    t = T(spark, sf).drop("escalation_days")
    return enrich.escalation_days(t).select("ticket_id", r6("escalation_days").alias("escalation_days"))


@register("e14_escalation_label", with_tickets(
    f"SELECT {case_map('escalation_level', dims.ESCALATION_LABELS)} AS escalation_label, count(*) AS tickets "
    "FROM tickets GROUP BY 1"))
def e14_escalation_label(spark, sf):
    t = enrich.escalation_label(T(spark, sf))
    return t.groupBy("escalation_label").agg(F.count(F.lit(1)).alias("tickets"))


def _quota_sql(n: int) -> str:
    q = enrich.quotas(n)
    rows = ", ".join(f"({s(k)}, {v})" for k, v in q.items())
    return f"_quota(dept, quota) AS (VALUES {rows})"


@register("e15_dept_quota_sample", with_tickets(
    "SELECT ticket_id, dept FROM (SELECT t.ticket_id, t.dept, _quota.quota, row_number() OVER (PARTITION BY t.dept "
    "ORDER BY md5(t.ticket_id || '42'), t.ticket_id) AS rn FROM tickets t JOIN _quota ON t.dept = _quota.dept) "
    "WHERE rn <= quota", _quota_sql(5000)))
def e15_dept_quota_sample(spark, sf):
    return enrich.dept_quota_sample(T(spark, sf).select("ticket_id", "dept"), 5000)


@register("e16_recency_tier", with_tickets(
    f"SELECT tier, tickets, tickets * {d(100)} / sum(tickets) OVER () AS pct FROM (SELECT CASE "
    f"WHEN {age_days()} < 7 THEN '0-6' WHEN {age_days()} < 30 THEN '7-29' WHEN {age_days()} < 90 THEN '30-89' "
    "ELSE '90+' END AS tier, count(*) AS tickets FROM tickets GROUP BY 1)"))
def e16_recency_tier(spark, sf):
    return enrich.recency_tier(T(spark, sf))


# ---------------------------------------------------------------- checks

@register("v01_dept_distribution", with_tickets(
    f"SELECT dept, tickets, tickets * {d(100)} / sum(tickets) OVER () AS pct FROM "
    "(SELECT dept, count(*) AS tickets FROM tickets WHERE dept IS NOT NULL GROUP BY dept) ORDER BY dept"))
def v01_dept_distribution(spark, sf):
    return checks.dept_distribution(T(spark, sf))


@register("v02_recency_split", with_tickets(
    f"SELECT total, recent, older, recent * {d(100)} / total AS recent_pct, older * {d(100)} / total AS older_pct "
    f"FROM (SELECT count(*) AS total, count_if({age_days()} <= 30) AS recent, count_if({age_days()} > 30) AS older "
    "FROM tickets)"))
def v02_recency_split(spark, sf):
    return checks.recency_split(T(spark, sf))


@register("v03_label_check", with_tickets(
    "SELECT total, breach_rate, breaches, non_breaches, CASE WHEN breach_rate IS NULL OR breach_rate = 0 OR "
    "breach_rate = 1 THEN 'FATAL' ELSE 'PASS' END AS verdict FROM (SELECT count(*) AS total, avg(sla_breach) AS "
    "breach_rate, count_if(sla_breach = 1) AS breaches, count_if(sla_breach = 0) AS non_breaches FROM tickets)"))
def v03_label_check(spark, sf):
    return checks.label_check(T(spark, sf))


_HUB = f"({d(72)} - {hours_since('created_at')})"


def _urgency_sql_cols() -> dict[str, str]:
    return {
        "already_breached": f"count_if({_HUB} < 0)",
        "critical": f"count_if(pred_sla_breach_prob > 0.80 AND {_HUB} < 24 AND {_HUB} > 0)",
        "dire": f"count_if(pred_sla_breach_prob > 0.80 AND {_HUB} BETWEEN 24 AND 72)",
        "high_risk": "count_if(pred_sla_breach_prob > 0.60 AND pred_sla_breach_prob <= 0.80)",
        "vulnerable_critical": f"count_if(pred_sla_breach_prob > 0.80 AND {_HUB} < 24 AND {_HUB} > 0 "
                               "AND vulnerable_population = 1)",
        "vulnerable_total": "count_if(vulnerable_population = 1)",
    }


def _alert_sql(c: str = "critical", dr: str = "dire", h: str = "high_risk") -> str:
    return (f"CASE WHEN {c} > 50 THEN 'CRISIS MODE' WHEN {c} > 20 THEN 'HIGH ALERT' WHEN {c} > 0 THEN 'URGENT' "
            f"WHEN {dr} > 50 THEN 'ELEVATED ALERT' WHEN {dr} > 0 THEN 'ATTENTION' WHEN {h} > 30 THEN "
            f"'PROACTIVE MODE' WHEN {h} > 0 THEN 'STABLE' ELSE 'OPTIMAL' END")


@register("v04_readiness", with_tickets(
    "SELECT *, CASE WHEN already_breached_pct > 60 THEN 'FAIL' WHEN already_breached_pct < 20 THEN 'WARNING' "
    "ELSE 'PASS' END AS breached_verdict, CASE WHEN critical = 0 AND dire = 0 THEN 'WARNING' ELSE 'PASS' END AS "
    f"urgent_verdict FROM (SELECT *, already_breached * {d(100)} / total AS already_breached_pct FROM ("
    "SELECT count(*) AS total, " + ", ".join(f"{v} AS {k}" for k, v in list(_urgency_sql_cols().items())[:4])
    + " FROM tickets))"))
def v04_readiness(spark, sf):
    return checks.readiness(T(spark, sf))


# ---------------------------------------------------------------- filters

@register("f01_date_bounds", with_tickets(
    "SELECT CAST(min(created_at) AS DATE) AS min_date, CAST(max(created_at) AS DATE) AS max_date FROM tickets"))
def f01_date_bounds(spark, sf):
    return filters.date_bounds(T(spark, sf))


_FILTER_COLS = "ticket_id, dept, district, ward, category, severity, priority_score"


def _filtered(spark, sf, pred):
    return T(spark, sf).where(pred).select(*[c.strip() for c in _FILTER_COLS.split(",")])


@register("f02_filter_dates", with_tickets(
    f"SELECT {_FILTER_COLS} FROM tickets WHERE created_at >= TIMESTAMP '2025-09-01' AND "
    "created_at < TIMESTAMP '2025-10-16'"))
def f02_filter_dates(spark, sf):
    """On the table stored in date folders: folders outside the range are not read."""
    return filters.filter_dates(ticket_folders(spark, sf), "2025-09-01", "2025-10-15").select(*_FILTER_COLS.split(", "))


@register("f03_filter_severity", with_tickets(f"SELECT {_FILTER_COLS} FROM tickets WHERE severity >= 3"))
def f03_filter_severity(spark, sf):
    return _filtered(spark, sf, filters.severity_pred(3))


@register("f04_filter_risk", with_tickets(
    f"SELECT {_FILTER_COLS} FROM tickets WHERE pred_sla_breach_prob BETWEEN {d(0.4)} AND {d(0.6)}"))
def f04_filter_risk(spark, sf):
    return _filtered(spark, sf, filters.risk_pred(0.4, 0.6))


@register("f05_filter_priority", with_tickets(
    f"SELECT {_FILTER_COLS} FROM tickets WHERE priority_score BETWEEN {d(60)} AND {d(80)}"))
def f05_filter_priority(spark, sf):
    return _filtered(spark, sf, filters.priority_pred(60, 80))


@register("f06_scenario_monsoon", with_tickets(
    f"SELECT {_FILTER_COLS} FROM tickets WHERE district IN ({', '.join(map(s, filters.MONSOON_DISTRICTS))}) "
    f"AND dept IN ({', '.join(map(s, filters.MONSOON_DEPTS))}) AND severity >= 2"))
def f06_scenario_monsoon(spark, sf):
    return _filtered(spark, sf, filters.monsoon_pred())


@register("f07_scenario_festival", with_tickets(f"SELECT {_FILTER_COLS} FROM tickets WHERE festival_season = 1"))
def f07_scenario_festival(spark, sf):
    return _filtered(spark, sf, filters.festival_pred())


@register("f08_scenario_vulnerable", with_tickets(
    f"SELECT {_FILTER_COLS} FROM tickets WHERE vulnerable_population = 1"))
def f08_scenario_vulnerable(spark, sf):
    return _filtered(spark, sf, filters.vulnerable_pred())


@register("f09_filter_custom", with_tickets(
    f"SELECT {_FILTER_COLS} FROM tickets WHERE district IN ('Pune', 'Nagpur') AND dept IN ('Health')"))
def f09_filter_custom(spark, sf):
    return _filtered(spark, sf, filters.custom_pred(["Pune", "Nagpur"], ["Health"], []))


@register("f10_filter_refine", with_tickets(
    f"SELECT {_FILTER_COLS} FROM tickets WHERE festival_season = 1 AND ward IN ('W01', 'W02', 'W03')"))
def f10_filter_refine(spark, sf):
    return _filtered(spark, sf, filters.festival_pred() & filters.refine_pred([], ["W01", "W02", "W03"]))


@register("f11_search", with_tickets(
    f"SELECT {_FILTER_COLS} FROM tickets WHERE regexp_matches(lower(coalesce(ticket_id, '')), 'water|leak') OR "
    "regexp_matches(lower(coalesce(category, '')), 'water|leak') OR "
    "regexp_matches(lower(coalesce(ward, '')), 'water|leak')"))
def f11_search(spark, sf):
    return _filtered(spark, sf, filters.search_pred("Water|Leak"))


_SPEC = filters.FilterSpec(date_from="2025-08-01", date_to="2025-11-30", severity_min=2, prob_min=0.3,
                           prob_max=0.95, prio_min=40.0, prio_max=100.0, scenario="Monsoon Crisis",
                           wards=["W05", "W06", "W07", "W08", "W09", "W10", "W11", "W12"], search="")


@register("f12_apply_filters", with_tickets(
    f"SELECT {_FILTER_COLS} FROM tickets WHERE created_at >= TIMESTAMP '2025-08-01' AND created_at < "
    f"TIMESTAMP '2025-12-01' AND severity >= 2 AND pred_sla_breach_prob BETWEEN {d(0.3)} AND {d(0.95)} AND "
    f"priority_score BETWEEN {d(40)} AND {d(100)} AND district IN ({', '.join(map(s, filters.MONSOON_DISTRICTS))}) "
    f"AND dept IN ({', '.join(map(s, filters.MONSOON_DEPTS))}) AND severity >= 2 AND ward IN "
    f"({', '.join(map(s, _SPEC.wards))})"))
def f12_apply_filters(spark, sf):
    return filters.apply_filters(ticket_folders(spark, sf), _SPEC).select(*_FILTER_COLS.split(", "))


@register("f13_option_lists", with_tickets(
    "SELECT field, value FROM (SELECT DISTINCT 'district' AS field, district AS value FROM tickets UNION "
    "SELECT DISTINCT 'dept', dept FROM tickets UNION SELECT DISTINCT 'ward', ward FROM tickets) "
    "WHERE value IS NOT NULL ORDER BY field, value"))
def f13_option_lists(spark, sf):
    return filters.option_lists(T(spark, sf))


@register("f14_routing_options", with_tickets(
    "SELECT DISTINCT kind, value FROM (SELECT 'ministry' AS kind, unnest("
    f"{str_list(list(dims.MINISTRY.values()) + [dims.CROSS_MINISTRY])}) AS value UNION ALL "
    f"SELECT 'dept', dept FROM tickets WHERE dept IS NOT NULL UNION ALL SELECT 'dept', {s(dims.CROSS_DEPARTMENT)}) "
    "ORDER BY kind, value"))
def f14_routing_options(spark, sf):
    return filters.routing_options(T(spark, sf))


@register("f15_empty_guard", with_tickets(
    "SELECT count(*) AS tickets, coalesce(avg(pred_sla_breach_prob), 0.0::DOUBLE) AS mean_risk FROM tickets "
    "WHERE severity >= 4"))
def f15_empty_guard(spark, sf):
    k = kpis.kpis(T(spark, sf).where(filters.severity_pred(4)))
    return k.select("tickets", "mean_risk")


@register("f16_labels", with_tickets(
    "SELECT ticket_id AS \"Ticket Id\", round(pred_sla_breach_prob, 6) AS \"Risk Score\", sla_breach AS "
    "\"Actual Breach Rate\", priority_score AS \"Priority (Baseline)\", severity AS \"Severity\", "
    "historical_backlog AS \"Backlog\", resource_availability AS \"Staff Available\" FROM tickets"))
def f16_labels(spark, sf):
    t = T(spark, sf).select("ticket_id", r6("pred_sla_breach_prob").alias("pred_sla_breach_prob"), "sla_breach",
                            "priority_score", "severity", "historical_backlog", "resource_availability")
    return filters.with_display_names(t)


_HELP_COLUMNS = ["ticket_id", *dims.GLOSSARY]


@register("f16_column_help", with_tickets(" UNION ALL ".join(
    f"SELECT {s(c)} AS \"column\", {s(dims.label_of(c))} AS label, {s(dims.help_of(c))} AS help, count({c}) AS filled FROM _shown"
    for c in _HELP_COLUMNS), f"_shown AS (SELECT *, CASE WHEN severity > 1 THEN priority_score END AS priority_dynamic FROM tickets)"))
def f16_column_help(spark, sf):
    """Labels and help texts from the schema of a table that was written and read back."""
    path = fresh_dir(spark, "labels")
    shown = T(spark, sf).withColumn("priority_dynamic", F.when(F.col("severity") > 1, F.col("priority_score")))
    filters.with_display_names(shown.select(*_HELP_COLUMNS)).write.parquet(path)
    return filters.column_help(spark.read.parquet(path))


# ---------------------------------------------------------------- urgency

@register("u01_u03_urgency", with_tickets(
    f"SELECT ticket_id, round({hours_since('created_at')}, 6) AS hours_since_creation, "
    f"round({_HUB}, 6) AS hours_until_breach, {_HUB} < 0 AS already_breached FROM tickets"))
def u01_u03_urgency(spark, sf):
    u = urgency.with_urgency(T(spark, sf))
    return u.select("ticket_id", r6("hours_since_creation").alias("hours_since_creation"),
                    r6("hours_until_breach").alias("hours_until_breach"), "already_breached")


@register("u04_critical", with_tickets(
    f"SELECT ticket_id, dept FROM tickets WHERE pred_sla_breach_prob > 0.80 AND {_HUB} < 24 AND {_HUB} > 0"))
def u04_critical(spark, sf):
    return urgency.with_urgency(T(spark, sf)).where(urgency.critical()).select("ticket_id", "dept")


@register("u05_dire", with_tickets(
    f"SELECT ticket_id, dept FROM tickets WHERE pred_sla_breach_prob > 0.80 AND {_HUB} BETWEEN 24 AND 72"))
def u05_dire(spark, sf):
    return urgency.with_urgency(T(spark, sf)).where(urgency.dire()).select("ticket_id", "dept")


@register("u06_high_risk", with_tickets(
    "SELECT ticket_id, dept FROM tickets WHERE pred_sla_breach_prob > 0.60 AND pred_sla_breach_prob <= 0.80"))
def u06_high_risk(spark, sf):
    return T(spark, sf).where(urgency.high_risk()).select("ticket_id", "dept")


@register("u07_vulnerable_critical", with_tickets(
    f"SELECT ticket_id, dept FROM tickets WHERE pred_sla_breach_prob > 0.80 AND {_HUB} < 24 AND {_HUB} > 0 "
    "AND vulnerable_population = 1"))
def u07_vulnerable_critical(spark, sf):
    return urgency.with_urgency(T(spark, sf)).where(urgency.vulnerable_critical()).select("ticket_id", "dept")


@register("u08_u09_urgency_by_dept", with_tickets(
    f"SELECT *, {_alert_sql()} AS capacity_alert FROM (SELECT dept, count(*) AS tickets, "
    + ", ".join(f"{v} AS {k}" for k, v in _urgency_sql_cols().items())
    + " FROM tickets WHERE dept IS NOT NULL GROUP BY dept)"))
def u08_u09_urgency_by_dept(spark, sf):
    return urgency.urgency_by(T(spark, sf), "dept")


_HUD = f"(CAST(sla_deadline_hours AS DOUBLE) - {hours_since('created_at')})"  # against each department's deadline


@register("u01_u03_urgency_by_deadline", with_tickets(
    f"SELECT ticket_id, round({_HUD}, 6) AS hours_until_breach, {_HUD} < 0 AS already_breached FROM tickets"))
def u01_u03_urgency_by_deadline(spark, sf):
    u = urgency.with_urgency(T(spark, sf), window_hours=F.col("sla_deadline_hours"))
    return u.select("ticket_id", r6("hours_until_breach").alias("hours_until_breach"), "already_breached")


@register("u08_u09_urgency_by_deadline", with_tickets(
    f"SELECT *, {_alert_sql()} AS capacity_alert FROM (SELECT dept, count(*) AS tickets, "
    + ", ".join(f"{v} AS {k}" for k, v in _urgency_sql_cols().items()).replace(_HUB, _HUD)
    + " FROM tickets WHERE dept IS NOT NULL GROUP BY dept)"))
def u08_u09_urgency_by_deadline(spark, sf):
    return urgency.urgency_by(T(spark, sf), "dept", window_hours=F.col("sla_deadline_hours"))


# ---------------------------------------------------------------- KPIs

_P = "pred_sla_breach_prob"


def _status_sql(c: str) -> str:
    return f"CASE WHEN {c} > 0.30 THEN 'HIGH' WHEN {c} > 0.20 THEN 'MEDIUM' ELSE 'LOW' END"


@register("k01_k02_kpis", with_tickets(
    f"SELECT tickets, round(mean_risk, 6) AS mean_risk, round(breach_rate, 6) AS breach_rate, "
    f"round(avg_priority, 6) AS avg_priority, round(avg_backlog, 6) AS avg_backlog, {_status_sql('mean_risk')} AS "
    f"risk_status, {_status_sql('breach_rate')} AS breach_status FROM (SELECT count(*) AS tickets, "
    f"coalesce(avg({_P}), {d(0)}) AS mean_risk, coalesce(avg(sla_breach), {d(0)}) AS breach_rate, "
    f"coalesce(avg(priority_score), {d(0)}) AS avg_priority, coalesce(avg(historical_backlog), {d(0)}) AS "
    "avg_backlog FROM tickets)"))
def k01_k02_kpis(spark, sf):
    k = kpis.kpis(T(spark, sf))
    return k.withColumns({c: r6(c) for c in ("mean_risk", "breach_rate", "avg_priority", "avg_backlog")})


def _top_sql(key: str, measure: str, name: str) -> str:
    return with_tickets(f"SELECT {key}, round({name}, 6) AS {name} FROM (SELECT {key}, {measure} AS {name} FROM "
                        f"tickets WHERE {key} IS NOT NULL GROUP BY {key}) ORDER BY {name} DESC, {key} LIMIT 1")


@register("k03_top_dept", _top_sql("dept", f"avg({_P})", "mean_risk"))
def k03_top_dept(spark, sf):
    return kpis.top_dept(T(spark, sf)).select("dept", r6("mean_risk").alias("mean_risk"))


@register("k04_worst_district", _top_sql("district", "avg(sla_breach)", "breach_rate"))
def k04_worst_district(spark, sf):
    return kpis.worst_district(T(spark, sf)).select("district", r6("breach_rate").alias("breach_rate"))


@register("k05_top_district_risk", _top_sql("district", f"avg({_P})", "mean_risk"))
def k05_top_district_risk(spark, sf):
    return kpis.top_district_risk(T(spark, sf)).select("district", r6("mean_risk").alias("mean_risk"))


@register("k06_top_category", with_tickets(
    "SELECT category, tickets FROM (SELECT category, count(*) AS tickets FROM tickets WHERE category IS NOT NULL "
    "GROUP BY category) ORDER BY tickets DESC, category LIMIT 1"))
def k06_top_category(spark, sf):
    return kpis.top_category(T(spark, sf))


@register("k07_dept_count", with_tickets(
    "SELECT count(DISTINCT dept) + max(CASE WHEN dept IS NULL THEN 1 ELSE 0 END) AS dept_count FROM tickets"))
def k07_dept_count(spark, sf):
    return kpis.dept_count(T(spark, sf))


def _pick_sql(key: str, measure: str) -> str:
    return (f"(SELECT {key} FROM (SELECT {key}, {measure} AS m FROM tickets WHERE {key} IS NOT NULL GROUP BY {key})"
            f" ORDER BY m DESC, {key} LIMIT 1)")


@register("k08_executive_summary", with_tickets(
    f"SELECT *, {_alert_sql()} AS capacity_alert FROM (SELECT count(*) AS tickets, "
    "(SELECT count(*) FROM (SELECT DISTINCT dept FROM tickets)) AS dept_count, "
    + ", ".join(f"{v} AS {k}" for k, v in _urgency_sql_cols().items())
    + f", {_pick_sql('dept', f'avg({_P})')} AS top_dept, {_pick_sql('district', 'avg(sla_breach)')} AS "
    f"worst_district, {_pick_sql('district', f'avg({_P})')} AS top_district_risk, "
    f"{_pick_sql('category', 'count(*)')} AS top_category FROM tickets)"))
def k08_executive_summary(spark, sf):
    return kpis.executive_summary(T(spark, sf))


# ---------------------------------------------------------------- group-bys

def _risk_by_sql(key: str) -> str:
    return with_tickets(f"SELECT {key}, round(avg({_P}), 6) AS mean_risk FROM tickets WHERE {key} IS NOT NULL "
                        f"GROUP BY {key} ORDER BY mean_risk DESC, {key}")


@register("g01_risk_by_ward", _risk_by_sql("ward"))
def g01_risk_by_ward(spark, sf):
    return kpis.risk_by(T(spark, sf), "ward").withColumn("mean_risk", r6("mean_risk"))


@register("g02_risk_by_district", _risk_by_sql("district"))
def g02_risk_by_district(spark, sf):
    return kpis.risk_by(T(spark, sf), "district").withColumn("mean_risk", r6("mean_risk"))


@register("g03_risk_by_dept", _risk_by_sql("dept"))
def g03_risk_by_dept(spark, sf):
    return kpis.risk_by(T(spark, sf), "dept").withColumn("mean_risk", r6("mean_risk"))


def _cat_top_sql(key: str, k: int) -> str:
    return with_tickets(
        f"SELECT {key}, category, tickets, round(risk, 6) AS risk FROM (SELECT {key}, category, count(ticket_id) AS "
        f"tickets, avg({_P}) AS risk FROM tickets WHERE {key} IS NOT NULL AND category IS NOT NULL GROUP BY {key}, "
        f"category) ORDER BY risk DESC, tickets DESC, {key}, category LIMIT {k}")


@register("g04_ward_category_top20", _cat_top_sql("ward", 20))
def g04_ward_category_top20(spark, sf):
    return kpis.category_top(T(spark, sf), "ward", 20).withColumn("risk", r6("risk"))


@register("g05_dept_category_top15", _cat_top_sql("dept", 15))
def g05_dept_category_top15(spark, sf):
    return kpis.category_top(T(spark, sf), "dept", 15).withColumn("risk", r6("risk"))


_DAILY_SQL = (f"SELECT CAST(created_at AS DATE) AS day, count(ticket_id) AS tickets, avg({_P}) AS risk, "
              "avg(sla_breach) AS breaches FROM tickets GROUP BY 1")


@register("g06_daily_trend", with_tickets(
    f"SELECT day, tickets, round(risk, 6) AS risk, round(breaches, 6) AS breaches FROM ({_DAILY_SQL}) "
    "WHERE day IS NOT NULL ORDER BY day"))
def g06_daily_trend(spark, sf):
    return kpis.daily_trend(T(spark, sf)).withColumns({"risk": r6("risk"), "breaches": r6("breaches")})


@register("g07_peak_day", with_tickets(
    f"SELECT day, tickets FROM ({_DAILY_SQL}) WHERE day IS NOT NULL ORDER BY tickets DESC, day LIMIT 1"))
def g07_peak_day(spark, sf):
    return kpis.peak_day(T(spark, sf))


@register("g08_trend_long", with_tickets(
    f"SELECT day, variable, round(value, 6) AS value FROM (SELECT day, 'risk' AS variable, risk AS value FROM "
    f"({_DAILY_SQL}) UNION ALL SELECT day, 'breaches', breaches FROM ({_DAILY_SQL})) WHERE day IS NOT NULL"))
def g08_trend_long(spark, sf):
    return kpis.trend_long(T(spark, sf)).withColumn("value", r6("value"))


@register("g09_weekly_dept", with_tickets(
    "SELECT date_trunc('week', created_at) AS week, dept, count(ticket_id) AS tickets FROM tickets "
    "WHERE dept IS NOT NULL AND created_at IS NOT NULL GROUP BY 1, 2 ORDER BY week, dept"))
def g09_weekly_dept(spark, sf):
    return kpis.weekly_dept(T(spark, sf))


def _band_sql(c: str) -> str:
    return f"CASE WHEN {c} < 0.2 THEN 'low' WHEN {c} < 0.3 THEN 'medium' ELSE 'high' END"


@register("g10_dept_stats", with_tickets(
    f"SELECT *, {_band_sql('ai_risk_score')} AS risk_band, {_band_sql('actual_breach_rate')} AS breach_band FROM "
    "(SELECT dept, count(ticket_id) AS total_tickets, round_even(avg(sla_breach), 3) AS actual_breach_rate, "
    f"round_even(avg({_P}), 3) AS ai_risk_score, round_even(avg(resolution_hours), 3) AS avg_resolution_hrs "
    "FROM tickets WHERE dept IS NOT NULL GROUP BY dept) ORDER BY ai_risk_score DESC, dept"))
def g10_dept_stats(spark, sf):
    return kpis.dept_stats(T(spark, sf))


_DEPT_STATE_SQL = ("SELECT dept, count(*) AS current_tickets, avg(sla_breach) AS current_breach_rate, "
                   f"count_if({_P} > 0.60) AS high_risk_count, count_if(vulnerable_population = 1) AS "
                   "vulnerable_count FROM tickets WHERE dept IS NOT NULL GROUP BY dept")


@register("g11_dept_state", with_tickets(
    "SELECT dept, current_tickets, current_breach_rate, high_risk_count, vulnerable_count, "
    f"round(current_tickets * {d(100)} / sum(current_tickets) OVER (), 6) AS share_pct FROM ({_DEPT_STATE_SQL})"))
def g11_dept_state(spark, sf):
    return kpis.dept_state(T(spark, sf)).withColumn("share_pct", r6("share_pct"))


@register("g12_risk_band", with_tickets(
    f"SELECT {_band_sql(_P)} AS risk_band, count(*) AS tickets FROM tickets GROUP BY 1"))
def g12_risk_band(spark, sf):
    return T(spark, sf).groupBy(risk_band(_P).alias("risk_band")).agg(F.count(F.lit(1)).alias("tickets"))


# ---------------------------------------------------------------- impact

@register("i01_penalty", with_tickets(
    "SELECT ticket_id, dept, least(CAST(greatest(floor((resolution_hours - sla_deadline_hours) / 24.0::DOUBLE), 0) "
    "AS BIGINT) * 10, 200) AS penalty FROM tickets"))
def i01_penalty(spark, sf):
    t = T(spark, sf)
    delay = F.greatest(F.floor((F.col("resolution_hours") - F.col("sla_deadline_hours")) / F.lit(24.0)), F.lit(0))
    return t.select("ticket_id", "dept", impact.penalty(F.col("dept"), delay.cast("long")).alias("penalty"))


def _roi_sql(steps: list[int], extra_select: str = "") -> tuple[str, str]:
    """CTE list for the ROI grid over dept_state x steps."""
    steps_list = ", ".join(str(x) for x in steps)
    m = f"least({d(1)}, {d(0.5)} + scaling * {d(0.5)})"
    pct = "CAST(staff_increase_pct AS DOUBLE)"
    zone1 = f"{pct} * {d(0.9)} * {m}"
    zone2 = f"{d(25)} * {d(0.9)} * {m} + ({pct} - {d(25)}) * {d(0.6)} * {m}"
    zone3 = f"({d(25)} * {d(0.9)} + {d(15)} * {d(0.6)}) * {m} + ({pct} - {d(40)}) * {d(0.2)} * {m}"
    zone4 = (f"greatest({d(0)}, ({d(25)} * {d(0.9)} + {d(15)} * {d(0.6)} + {d(10)} * {d(0.2)}) * {m} - "
             f"({pct} - {d(50)}) * {d(0.1)})")
    red = (f"(CASE WHEN {pct} <= 25 THEN {zone1} WHEN {pct} <= 40 THEN {zone2} WHEN {pct} <= 50 THEN {zone3} "
           f"ELSE {zone4} END) * {d(0.9)}")
    ctes = [
        f"_state AS ({_DEPT_STATE_SQL})",
        f"_grid AS (SELECT *, unnest([{steps_list}]) AS staff_increase_pct FROM _state)",
        f"_g1 AS (SELECT *, least({d(1)}, current_tickets / {d(1000)}) AS scaling, "
        f"coalesce({case_map('dept', dims.BASELINE_STAFF)}, {dims.DEFAULT_BASELINE_STAFF}) AS base_staff "
        "FROM _grid WHERE staff_increase_pct <> 0 AND current_tickets >= 20)",
        "_g2 AS (SELECT *, greatest(1, CAST(trunc(base_staff * scaling) AS BIGINT)) AS effective FROM _g1)",
        f"_g3 AS (SELECT *, greatest(1, CAST(trunc(effective * (staff_increase_pct / {d(100)})) AS BIGINT)) AS "
        f"new_staff, {red} AS reduction_pct FROM _g2)",
        f"_g4 AS (SELECT *, new_staff * {dims.MONTHLY_SALARY} AS salary, new_staff * {dims.TRAINING_COST} AS training, "
        f"CASE WHEN staff_increase_pct <= 25 THEN {d(1)} WHEN staff_increase_pct <= 40 THEN {d(1.1)} WHEN "
        f"staff_increase_pct <= 50 THEN {d(1.2)} ELSE {d(1.2)} + (staff_increase_pct - 50) * {d(0.03)} END AS coord, "
        f"greatest({d(0.05)}, current_breach_rate * ({d(1)} - reduction_pct / {d(100)})) AS new_breach_rate FROM _g3)",
        f"_g5 AS (SELECT *, (salary + training) * {d(1.15)} * coord AS cost, "
        "CAST(trunc((current_breach_rate - new_breach_rate) * current_tickets) AS BIGINT) AS breaches_prevented, "
        "least(7 * 10, 200) + 3000 + CASE WHEN current_tickets < 200 THEN 480 ELSE 800 END + 1000 + "
        "CASE WHEN current_tickets < 200 THEN 300 ELSE 500 END AS breach_cost FROM _g4)",
        "_g6 AS (SELECT *, breaches_prevented * breach_cost AS savings FROM _g5)",
        "_g7 AS (SELECT *, savings - cost AS net FROM _g6)",
    ]
    return ctes


_ROI_SELECT = (
    "dept, staff_increase_pct, current_tickets, current_breach_rate, new_staff, CAST(trunc(cost) AS BIGINT) AS "
    "monthly_cost, CAST(savings AS BIGINT) AS monthly_savings, CAST(trunc(net) AS BIGINT) AS net_benefit, "
    f"CASE WHEN cost > 0 THEN net / cost * {d(100)} ELSE {d(0)} END AS roi_percentage, "
    "CASE WHEN net > 0 THEN training / net END AS payback_months, breaches_prevented, new_breach_rate, "
    "reduction_pct")


@register("i02_i05_roi_grid", with_tickets(
    f"SELECT *, CASE WHEN roi_percentage > 50 THEN 'RECOMMENDED' WHEN roi_percentage > 0 THEN 'MARGINAL' "
    f"ELSE 'NOT VIABLE' END AS verdict FROM (SELECT {_ROI_SELECT} FROM _g7)", *_roi_sql(impact.STAFF_STEPS)))
def i02_i05_roi_grid(spark, sf):
    return impact.roi_grid(T(spark, sf))


@register("i04_staffing_grid_zone4", with_tickets(
    f"SELECT {_ROI_SELECT} FROM _g7", *_roi_sql([55, 60, 80, 100])))
def i04_staffing_grid_zone4(spark, sf):
    return impact.roi_grid(T(spark, sf), steps=[55, 60, 80, 100]).drop("verdict")


@register("i06_citizen_impact", with_tickets(
    "SELECT dept, staff_increase_pct, breaches_prevented, breaches_prevented * 3 * 2 AS citizen_hours_saved, "
    f"CAST(trunc(breaches_prevented * 3 * 2 / {d(8)}) AS BIGINT) AS citizen_days_saved, "
    f"CAST(trunc(breaches_prevented * 3 * 2 / {d(8)} * {d(500)}) AS BIGINT) AS economic_value, "
    f"CASE WHEN current_tickets > 0 THEN breaches_prevented / current_tickets * {d(10)} * {d(0.2)} ELSE {d(0)} END "
    "AS satisfaction_delta, vulnerable_count AS vulnerable_helped FROM _g7", *_roi_sql(impact.STAFF_STEPS)))
def i06_citizen_impact(spark, sf):
    return impact.impact_grid(T(spark, sf))


def _bench_sql() -> str:
    rows = ", ".join(f"({s(n)}, CAST({a} AS BIGINT), {d(r)}, {dd})" for n, a, r, dd in dims.BENCHMARKS)
    return f"_bench(programme, applications, programme_breach_rate, programme_days) AS (VALUES {rows})"


@register("i07_benchmark_compare", with_tickets(
    "SELECT programme, applications, round(our_breach_rate, 6) AS our_breach_rate, programme_breach_rate, "
    "round(our_breach_rate - programme_breach_rate, 6) AS breach_rate_gap, round(avg_resolution_days, 6) AS "
    "avg_resolution_days, programme_days, round(avg_resolution_days - programme_days, 6) AS days_gap FROM "
    f"(SELECT avg(sla_breach) AS our_breach_rate, avg(resolution_hours) / {d(24)} AS avg_resolution_days FROM "
    "tickets), _bench", _bench_sql()))
def i07_benchmark_compare(spark, sf):
    b = impact.benchmark_compare(T(spark, sf))
    return b.withColumns({c: r6(c) for c in ("our_breach_rate", "breach_rate_gap", "avg_resolution_days",
                                             "days_gap")})


# ---------------------------------------------------------------- queue

def _prio_sql(ws) -> str:
    return round_even(
        f"{d(100)} * least(greatest({d(ws[0])} * {_P} + {d(ws[1])} * (severity / {d(3)}) + {d(ws[2])} * "
        f"CAST(vulnerable_population AS DOUBLE) + {d(ws[3])} * ((-citizen_sentiment + {d(1)}) / {d(2)}) + "
        f"{d(ws[4])} * CAST(festival_season AS DOUBLE), {d(0)}), {d(1)})", 1)


_W_CUSTOM = {"risk": 0.3, "severity": 0.3, "vuln": 0.2, "sent": 0.1, "fest": 0.1}


@register("q01_dynamic_priority", with_tickets(
    f"SELECT ticket_id, {_prio_sql(queue.normalised_weights(_W_CUSTOM))} AS priority_dynamic FROM tickets"))
def q01_dynamic_priority(spark, sf):
    return queue.dynamic_priority(T(spark, sf), _W_CUSTOM).select("ticket_id", "priority_dynamic")


@register("q02_route_ministry", with_tickets(
    f"SELECT ticket_id, dept, coalesce({case_map('dept', dims.MINISTRY)}, {s(dims.CROSS_MINISTRY)}) AS "
    "ministry_default FROM tickets"))
def q02_route_ministry(spark, sf):
    return queue.route_ministry(T(spark, sf).select("ticket_id", "dept"))


_QUEUE_CTE = (
    f"_queue AS (SELECT false AS \"select\", false AS escalate, dept AS route_dept, coalesce("
    f"{case_map('dept', dims.MINISTRY)}, {s(dims.CROSS_MINISTRY)}) AS route_ministry, ticket_id, created_at, "
    "district, ward, dept, category, severity, vulnerable_population = 1 AS vulnerable_population, "
    f"{_P}, priority_dynamic, historical_backlog FROM (SELECT *, "
    f"{_prio_sql(queue.normalised_weights(None))} AS priority_dynamic FROM tickets) ORDER BY priority_dynamic "
    f"DESC, {_P} DESC, ticket_id LIMIT {dims.QUEUE_SIZE})")


@register("q03_action_queue", with_tickets(
    f"SELECT \"select\", escalate, route_dept, route_ministry, ticket_id, created_at, district, ward, dept, "
    f"category, severity, vulnerable_population, round({_P}, 6) AS {_P}, priority_dynamic, historical_backlog "
    "FROM _queue", _QUEUE_CTE))
def q03_action_queue(spark, sf):
    return queue.action_queue(T(spark, sf)).withColumn(_P, r6(_P))


_SELECTED_CTE = (
    "_sel AS (SELECT CAST(ticket_id AS BIGINT) % 2 = 0 AS \"select\", CAST(ticket_id AS BIGINT) % 3 = 0 AS escalate, "
    f"CASE WHEN CAST(ticket_id AS BIGINT) % 10 = 0 THEN {s(dims.CROSS_DEPARTMENT)} ELSE route_dept END AS "
    "route_dept, route_ministry, ticket_id, created_at, district, ward, dept, category, severity, "
    f"vulnerable_population, {_P}, priority_dynamic, historical_backlog FROM _queue "
    "WHERE CAST(ticket_id AS BIGINT) % 2 = 0)")


@register("q04_select_rows", with_tickets(
    f"SELECT \"select\", escalate, route_dept, route_ministry, ticket_id, dept, round({_P}, 6) AS {_P}, "
    "priority_dynamic FROM _sel", _QUEUE_CTE, _SELECTED_CTE))
def q04_select_rows(spark, sf):
    sel = queue.fixture_selection(T(spark, sf))
    return sel.select("select", "escalate", "route_dept", "route_ministry", "ticket_id", "dept",
                      r6(_P).alias(_P), "priority_dynamic")


_PAYLOAD_CTE = (
    "_log AS (SELECT ticket_id, route_ministry AS ministry, route_dept AS department, escalate AS escalated, "
    f"'In Progress' AS status, {AS_OF_SQL} - to_hours(CAST(CAST(ticket_id AS BIGINT) % 96 AS BIGINT)) AS "
    f"assigned_at, priority_dynamic AS priority_score, {_P} AS risk_score, district, ward, category, severity, "
    "vulnerable_population AS vulnerable_household FROM _sel)")


def _flat_payload(p: DataFrame) -> DataFrame:
    return p.select("ticket_id", F.col("assignment.ministry").alias("ministry"),
                    F.col("assignment.department").alias("department"),
                    F.col("assignment.escalated").alias("escalated"), "status", "assigned_at", "priority_score",
                    r6("risk_score").alias("risk_score"), "metadata.*")


_FLAT_SQL = ("SELECT ticket_id, ministry, department, escalated, status, assigned_at, priority_score, "
             "round(risk_score, 6) AS risk_score, district, ward, category, severity, vulnerable_household FROM _log")


@register("q05_build_payload", with_tickets(_FLAT_SQL, _QUEUE_CTE, _SELECTED_CTE, _PAYLOAD_CTE))
def q05_build_payload(spark, sf):
    return _flat_payload(queue.assignments_from(T(spark, sf)))


def _log_path(spark, sf) -> str:
    path = fresh_dir(spark, "assignments")
    queue.append_assignments(queue.assignments_from(T(spark, sf)), path)
    return path


@register("q06_append_assignments", with_tickets(_FLAT_SQL, _QUEUE_CTE, _SELECTED_CTE, _PAYLOAD_CTE))
def q06_append_assignments(spark, sf):
    """The same batch is added twice, as after a failure."""
    path = _log_path(spark, sf)
    queue.append_assignments(queue.read_assignments(spark, path).checkpoint(), path)
    return _flat_payload(queue.read_assignments(spark, path))


@register("q07_assignment_log", with_tickets(
    "SELECT ticket_id, ministry, status, assigned_at, (SELECT count(*) FROM _log) AS total_assigned FROM _log "
    "ORDER BY assigned_at DESC, ticket_id LIMIT 20", _QUEUE_CTE, _SELECTED_CTE, _PAYLOAD_CTE))
def q07_assignment_log(spark, sf):
    log = queue.assignments_from(T(spark, sf))
    return queue.assignment_log(log).select("ticket_id", F.col("assignment.ministry").alias("ministry"), "status",
                                            "assigned_at", "total_assigned")


@register("q08_clear_assignments", with_tickets(
    "SELECT (SELECT count(*) FROM _log) AS rows_before, CAST(0 AS BIGINT) AS rows_after, "
    "(SELECT count(*) FROM _log WHERE severity >= 2) AS rows_added", _QUEUE_CTE, _SELECTED_CTE, _PAYLOAD_CTE))
def q08_clear_assignments(spark, sf):
    """Rows of the log before a clear, after it, and after a further batch."""
    path = _log_path(spark, sf)
    log = queue.read_assignments(spark, path).checkpoint()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    before = count(log, "rows_before")
    after = count(queue.clear_assignments(spark, path), "rows_after").checkpoint()
    queue.append_assignments(log.where("metadata.severity >= 2"), path, batch=1)
    added = count(queue.read_assignments(spark, path), "rows_added")
    return before.select("rows_before", after.scalar().alias("rows_after"), added.scalar().alias("rows_added"))


_NOTE_SQL = "district || ', \"' || ward || '\"' || chr(13) || chr(10) || category || ','"


@register("s07_export_selection", with_tickets(
    f"SELECT escalate, route_dept, route_ministry, ticket_id, created_at, district, ward, dept, category, severity, "
    f"vulnerable_population, round({_P}, 6) AS {_P}, priority_dynamic, historical_backlog, {_NOTE_SQL} AS note FROM _sel",
    _QUEUE_CTE, _SELECTED_CTE))
def s07_export_selection(spark, sf):
    """The selection as CSV, read back; ``note`` holds commas, quotes and a line end."""
    out = queue.export_selection(queue.fixture_selection(T(spark, sf)))
    out = out.withColumn("note", F.concat("district", F.lit(', "'), "ward", F.lit('"\r\n'), "category", F.lit(",")))
    path = fresh_dir(spark, "selection")
    files.write_csv(out, path)
    return files.read_csv(spark, path, out.schema).withColumn(_P, r6(_P))


# ---------------------------------------------------------------- monitoring

_FLAT_CTE = (f"_flat AS (SELECT ticket_id, status, priority_score, risk_score, coalesce(ministry, 'Unknown') AS "
             f"ministry, coalesce(department, 'Unknown') AS department, assigned_at AS assigned_at_dt, "
             f"{hours_since('assigned_at')} AS hours_since_assignment FROM _log)")
_MON = (_QUEUE_CTE, _SELECTED_CTE, _PAYLOAD_CTE, _FLAT_CTE)


def _flat(spark, sf):
    return monitor.flatten_assignments(queue.assignments_from(T(spark, sf)))


@register("o01_o02_flatten_assignments", with_tickets(
    "SELECT ticket_id, status, priority_score, round(risk_score, 6) AS risk_score, ministry, department, "
    "assigned_at_dt, round(hours_since_assignment, 6) AS hours_since_assignment FROM _flat", *_MON))
def o01_o02_flatten_assignments(spark, sf):
    return _flat(spark, sf).withColumns({"risk_score": r6("risk_score"),
                                        "hours_since_assignment": r6("hours_since_assignment")})


@register("o03_assignment_overview", with_tickets(
    "SELECT *, CASE WHEN total_assigned > 0 THEN in_progress * 100.0::DOUBLE / total_assigned ELSE 0.0::DOUBLE END "
    "AS in_progress_pct FROM (SELECT count(*) AS total_assigned, count_if(status = 'In Progress') AS in_progress, "
    "count_if(status = 'Pending') AS pending, count_if(status = 'Resolved') AS resolved FROM _flat)", *_MON))
def o03_assignment_overview(spark, sf):
    return monitor.assignment_overview(_flat(spark, sf))


@register("o04_o05_ministry_performance", with_tickets(
    "SELECT ministry, assigned_tickets, round(avg_hours_since_assignment, 6) AS avg_hours_since_assignment, "
    "round(avg_risk_score, 6) AS avg_risk_score, stuck_tickets, CASE WHEN avg_hours_since_assignment < 24 THEN "
    "'On Track' WHEN avg_hours_since_assignment < 48 THEN 'Monitor' ELSE 'Attention Needed' END AS status FROM "
    "(SELECT ministry, count(ticket_id) AS assigned_tickets, avg(hours_since_assignment) AS "
    "avg_hours_since_assignment, avg(risk_score) AS avg_risk_score, count_if(hours_since_assignment > 72) AS "
    "stuck_tickets FROM _flat WHERE ministry IS NOT NULL GROUP BY ministry) ORDER BY assigned_tickets DESC, "
    "ministry", *_MON))
def o04_o05_ministry_performance(spark, sf):
    m = monitor.ministry_performance(_flat(spark, sf))
    return m.withColumns({"avg_hours_since_assignment": r6("avg_hours_since_assignment"),
                          "avg_risk_score": r6("avg_risk_score")})


@register("o06_stuck_tickets", with_tickets(
    "SELECT ticket_id, ministry, round(hours_since_assignment, 6) AS hours_since_assignment FROM _flat "
    "WHERE hours_since_assignment > 72", *_MON))
def o06_stuck_tickets(spark, sf):
    return monitor.stuck_tickets(_flat(spark, sf)).select(
        "ticket_id", "ministry", r6("hours_since_assignment").alias("hours_since_assignment"))


@register("o07_stuck_by_ministry", with_tickets(
    "SELECT ministry, count(ticket_id) AS stuck FROM _flat WHERE hours_since_assignment > 72 GROUP BY ministry "
    "ORDER BY stuck DESC, ministry", *_MON))
def o07_stuck_by_ministry(spark, sf):
    return monitor.stuck_by_ministry(_flat(spark, sf))


@register("o08_recent_assignments", with_tickets(
    "SELECT ticket_id AS \"Ticket ID\", ministry AS \"Ministry\", department AS \"Department\", status AS "
    "\"Status\", round(risk_score, 6) AS \"Risk Score\", priority_score AS \"Priority\", "
    "round(hours_since_assignment, 6) AS \"Hours Since Assignment\" FROM _flat ORDER BY assigned_at_dt DESC, "
    "ticket_id LIMIT 20", *_MON))
def o08_recent_assignments(spark, sf):
    r = monitor.recent_assignments(_flat(spark, sf))
    return r.withColumns({"Risk Score": r6("Risk Score"), "Hours Since Assignment": r6("Hours Since Assignment")})
