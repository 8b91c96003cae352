"""DuckDB oracle SQL for the ``tickets`` derivation.

This is the oracle side of the correctness check: plain ANSI SQL text that
DuckDB runs on the same parquet views. Constants come from ``dims`` so both
engines use one definition. Expressions are written in the same order as the
Spark ones so floating-point results agree bit for bit (except ``exp``, which
may differ in the last place; those outputs are rounded to 6 decimals on both
sides).
"""

from __future__ import annotations

from .. import dims

AS_OF_SQL = f"TIMESTAMP '{dims.AS_OF}'"


def d(x: float) -> str:
    """A DOUBLE literal (a bare 0.5 is DECIMAL in DuckDB)."""
    return f"{float(x)!r}::DOUBLE"


def s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {s(k) if isinstance(k, str) else k} THEN "
                     f"{s(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def str_list(xs) -> str:
    return "[" + ", ".join(s(x) for x in xs) + "]"


def hours_since(ts: str, as_of: str = AS_OF_SQL) -> str:
    return f"(CAST(epoch_us({as_of}) - epoch_us({ts}) AS DOUBLE) / 3600000000.0::DOUBLE)"


def age_days(ts: str = "created_at", as_of: str = AS_OF_SQL) -> str:
    return f"CAST(floor(date_diff('second', {ts}, {as_of}) / 86400.0::DOUBLE) AS INTEGER)"


def round_even(x: str, n: int) -> str:
    return f"round_even({x}, {n})"


_PRESS = case_map("district", dims.DISTRICT_PRESSURE)
# E07 as SQL: the generator's breach propensity.
PROPENSITY_SQL = (
    f"least(greatest({d(1)} / ({d(1)} + exp(-({d(-1.5)} + {d(0.8)} * severity + "
    f"{d(1.2)} * vulnerable_population + {d(0.8)} * (-citizen_sentiment) + {d(0.01)} * historical_backlog + "
    f"{d(1)} * ({d(1)} - resource_availability) + {d(0.005)} * weather_rain_mm + {d(0.006)} * traffic_index + "
    f"{d(0.6)} * {_PRESS} + {d(0.5)} * festival_season + {d(0.4)} * ({d(1)} - is_business_hours) + "
    f"{d(0.5)} * is_weekend))), {d(0.001)}), {d(0.999)})")


def _ticket_ctes() -> str:
    cat_case = "CASE dept " + " ".join(
        f"WHEN {s(dep)} THEN {str_list(cs)}[k % 3 + 1]" for dep, cs in dims.CATEGORIES.items()) + " END"
    z = (f"({d(-1.5)} + {d(0.8)} * severity + {d(1.2)} * vulnerable_population - {d(0.8)} * citizen_sentiment"
         f" + {d(0.01)} * historical_backlog + ({d(1.0)} - resource_availability)"
         f" + {d(0.005)} * weather_rain_mm + {d(0.006)} * traffic_index"
         f" + {d(0.5)} * festival_season + {d(0.4)} * ({d(1.0)} - is_business_hours)"
         f" + {d(0.5)} * is_weekend - {d(2.5)})")
    expected = (f"({d(48)} + {d(24)} * severity + {d(36)} * vulnerable_population"
                f" + {d(24)} * historical_backlog / {d(100)} + {d(48)} * ({d(1)} - resource_availability)"
                f" + {d(12)} * ({d(1)} - is_business_hours) + {d(24)} * is_weekend"
                f" + {d(12)} * weather_rain_mm / {d(50)} + {d(6)} * traffic_index / {d(100)})")
    speed = (f"CASE WHEN escalation_level = 1 THEN {d(0.7)} WHEN escalation_level = 2 THEN {d(0.7)} * {d(0.7)}"
             f" WHEN escalation_level = 3 THEN {d(0.7)} * {d(0.7)} * {d(0.7)} ELSE {d(1.0)} END")
    capped = "least(_raw_h, CAST(sla_deadline_hours * 3 AS DOUBLE))"
    priority = (f"{round_even(f'{d(100)} * least(greatest({d(0.5)} * pred_sla_breach_prob + {d(0.2)} * (severity / {d(3)})'
                              f' + {d(0.15)} * vulnerable_population + {d(0.1)} * (({d(1)} - citizen_sentiment) / {d(2)})'
                              f' + {d(0.05)} * festival_season, {d(0)}), {d(1)})', 1)}")
    return f"""_li AS (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey),
_b AS (SELECT o.o_orderkey AS k, o.o_custkey, o.o_orderstatus, o.o_orderpriority, c.c_nationkey, c.c_mktsegment, _li.qty
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN _li ON o.o_orderkey = _li.l_orderkey),
_s1 AS (SELECT k,
  CAST(k AS VARCHAR) AS ticket_id,
  {AS_OF_SQL} + to_minutes(CAST(-(CASE WHEN k % 100 < 30 THEN k % 7 WHEN k % 100 < 65 THEN 8 + k % 22
      WHEN k % 100 < 90 THEN 31 + k % 59 ELSE 91 + k % 89 END) * 1440 + (k % 24) * 60 + (k * 7) % 60 AS BIGINT)) AS created_at,
  {str_list(dims.DISTRICTS)}[c_nationkey % 10 + 1] AS district,
  'W' || lpad(CAST(o_custkey % 30 + 1 AS VARCHAR), 2, '0') AS ward,
  {case_map('c_mktsegment', dims.SEGMENT_DEPT)} AS dept,
  {case_map('o_orderstatus', dims.STATUS_CHANNEL)} AS reported_via,
  CAST((k * 37) % 201 - 100 AS DOUBLE) / {d(100)} AS citizen_sentiment,
  CASE WHEN o_orderpriority = {s(dims.URGENT_PRIORITY)} THEN 1 ELSE 0 END AS vulnerable_population,
  CAST(o_custkey % 121 AS INTEGER) AS historical_backlog,
  CAST((k * 53) % 101 AS DOUBLE) / {d(100)} AS resource_availability,
  coalesce(qty, {d(0)}) / {d(10)} AS weather_rain_mm,
  CAST((k * 29) % 101 AS INTEGER) AS traffic_index,
  CAST((k * 31) % 61 - 30 AS DOUBLE) / {d(100)} AS _noise
  FROM _b),
_s2 AS (SELECT *, {cat_case} AS category,
  CAST(hour(created_at) AS INTEGER) AS created_hour,
  CASE WHEN month(created_at) IN ({", ".join(str(m) for m in dims.FESTIVAL_MONTHS)}) AND k % 4 = 0 THEN 1 ELSE 0 END
    AS festival_season,
  CAST({case_map('dept', dims.SLA_HOURS)} AS INTEGER) AS sla_deadline_hours
  FROM _s1),
_s3 AS (SELECT *, CAST({case_map('category', dims.SEVERITY)} AS INTEGER) AS severity,
  CASE WHEN created_hour BETWEEN 9 AND 17 THEN 1 ELSE 0 END AS is_business_hours,
  CASE WHEN isodow(created_at) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend
  FROM _s2),
_s4 AS (SELECT *, {d(1)} / ({d(1)} + exp(-{z})) AS pred_sla_breach_prob, {expected} AS _expected FROM _s3),
_s5 AS (SELECT *,
  greatest({d(24)}, _expected * ({d(1)} + _noise)) * ({d(1)} + {d(0.8)} * pred_sla_breach_prob) AS _raw_h,
  CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS escalated,
  CASE WHEN k % 4 <> 0 THEN 0 WHEN k % 40 < 24 THEN 1 WHEN k % 40 < 36 THEN 2 ELSE 3 END AS escalation_level
  FROM _s4),
_s6 AS (SELECT *, CASE WHEN escalation_level = 0 THEN {capped} ELSE {capped} * ({speed}) END AS resolution_hours
  FROM _s5),
tickets AS (SELECT {", ".join(_out_cols())} FROM (SELECT *,
  CASE WHEN (CASE WHEN escalated = 1 THEN resolution_hours ELSE _raw_h END) > sla_deadline_hours THEN 1 ELSE 0 END
    AS sla_breach,
  resolution_hours / {d(24)} AS escalation_days,
  {priority} AS priority_score
  FROM _s6))"""


def _out_cols() -> list[str]:
    return list(dims.PREDICTION_COLUMNS)


def with_tickets(body: str, *ctes: str) -> str:
    """``WITH <ticket derivation>[, extra CTEs] <body>``."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {_ticket_ctes()}{extra}\n{body}"
