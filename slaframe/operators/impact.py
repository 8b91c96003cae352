"""Impact and resource planning.

The reference evaluates its calculators for one department and one slider
value at a time. Here they are column expressions over a (department x
staffing step) grid: ``dept_state`` is one aggregate row per department, the
grid is a fixed list of steps, and their cross product has
(#departments x #steps) rows whatever the ticket volume. Multiplication order
follows the reference so integer truncations land on the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import dbl
from .kpis import dept_state

STAFF_STEPS = list(range(0, 51, 5))  # the 0..50 % slider in steps of 5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def penalty(dept: Column, delay_days: Column) -> Column:
    """min(days * per-day penalty, cap); unknown departments use 10 / 200."""
    per_day = F.coalesce(dims.lookup({d: v[1] for d, v in dims.PENALTY.items()}, dept),
                         F.lit(dims.DEFAULT_PENALTY_PER_DAY))
    cap = F.coalesce(dims.lookup({d: v[2] for d, v in dims.PENALTY.items()}, dept),
                     F.lit(dims.DEFAULT_MAX_PENALTY))
    return F.least(delay_days * per_day, cap)


def breach_reduction(rate: Column, pct: Column, scaling: Column, floor_mode: str = "reference") -> tuple[Column, Column]:
    """Four-zone diminishing returns; returns (new rate, reduction %).

    ``floor_mode="reference"`` keeps the 5 % floor even when it raises a rate
    that was already lower; ``"cap"`` never raises the rate.
    """
    m = F.least(dbl(1.0), dbl(0.5) + scaling * dbl(0.5))
    pct = pct.cast("double")
    zone1 = pct * dbl(0.9) * m
    zone2 = dbl(25.0) * dbl(0.9) * m + (pct - dbl(25.0)) * dbl(0.6) * m
    zone3 = (dbl(25.0) * dbl(0.9) + dbl(15.0) * dbl(0.6)) * m + (pct - dbl(40.0)) * dbl(0.2) * m
    zone4 = F.greatest(dbl(0.0), (dbl(25.0) * dbl(0.9) + dbl(15.0) * dbl(0.6) + dbl(10.0) * dbl(0.2)) * m
                       - (pct - dbl(50.0)) * dbl(0.1))
    reduction = (F.when(pct <= 25, zone1).when(pct <= 40, zone2).when(pct <= 50, zone3)
                 .otherwise(zone4)) * dbl(0.90)
    new_rate = F.greatest(dbl(0.05), rate * (dbl(1.0) - reduction / dbl(100.0)))
    if floor_mode == "cap":
        new_rate = F.least(rate, new_rate)
    return new_rate, reduction


def roi_columns(pct: Column, tickets: Column, rate: Column, dept: Column,
                floor_mode: str = "reference") -> dict[str, Column]:
    """I03 for one (pct, tickets, rate, dept) row, as named columns."""
    base_staff = F.coalesce(dims.lookup(dims.BASELINE_STAFF, dept), F.lit(dims.DEFAULT_BASELINE_STAFF))
    scaling = F.least(dbl(1.0), tickets / dbl(float(dims.BASELINE_TICKETS)))
    effective = F.greatest(F.lit(1), (base_staff * scaling).cast("long"))
    new_staff = F.greatest(F.lit(1), (effective * (pct / dbl(100.0))).cast("long"))
    salary = new_staff * dims.MONTHLY_SALARY
    training = new_staff * dims.TRAINING_COST
    coord = (F.when(pct <= 25, dbl(1.0)).when(pct <= 40, dbl(1.1)).when(pct <= 50, dbl(1.2))
             .otherwise(dbl(1.2) + (pct - 50) * dbl(0.03)))
    cost = (salary + training) * dbl(dims.OVERHEAD_MULTIPLIER) * coord
    new_rate, reduction = breach_reduction(rate, pct, scaling, floor_mode)
    prevented = ((rate - new_rate) * tickets).cast("long")
    small = tickets < 200
    admin = F.when(small, F.lit(int(800 * 0.6))).otherwise(F.lit(800))
    litigation = F.when(small, F.lit(int(500 * 0.6))).otherwise(F.lit(500))
    breach_cost = penalty(dept, F.lit(7)) + F.lit(3000) + admin + F.lit(1000) + litigation
    savings = prevented * breach_cost
    net = savings - cost
    roi = F.when(cost > 0, net / cost * dbl(100.0)).otherwise(dbl(0.0))
    payback = F.when(net > 0, training / net)
    return {
        "new_staff": new_staff,
        "monthly_cost": cost.cast("long"),
        "monthly_savings": savings.cast("long"),
        "net_benefit": net.cast("long"),
        "roi_percentage": roi,
        "payback_months": payback,
        "breaches_prevented": prevented,
        "new_breach_rate": new_rate,
        "reduction_pct": reduction,
    }


def roi_verdict(roi: Column) -> Column:
    """I05."""
    return F.when(roi > 50, "RECOMMENDED").when(roi > 0, "MARGINAL").otherwise("NOT VIABLE")


def staffing_grid(df: DataFrame, steps: list[int] | None = None) -> DataFrame:
    """Department state crossed with the staffing steps."""
    steps = STAFF_STEPS if steps is None else steps
    state = dept_state(df)
    return state.withColumn("staff_increase_pct", F.explode(F.array(*[F.lit(int(s)) for s in steps])))


def _roi_frame(df: DataFrame, steps: list[int] | None, floor_mode: str) -> DataFrame:
    grid = staffing_grid(df, steps).where((F.col("staff_increase_pct") != 0) & (F.col("current_tickets") >= 20))
    cols = roi_columns(F.col("staff_increase_pct"), F.col("current_tickets"), F.col("current_breach_rate"),
                       F.col("dept"), floor_mode)
    return grid.select("dept", "staff_increase_pct", "current_tickets", "current_breach_rate",
                       "vulnerable_count", *[v.alias(k) for k, v in cols.items()])


def roi_grid(df: DataFrame, steps: list[int] | None = None, floor_mode: str = "reference") -> DataFrame:
    """I03 + I04 + I05: ROI for every department and staffing step.

    Rows the reference answers with ``None`` (0 % or fewer than 20 tickets)
    are absent; an infinite payback is null.
    """
    out = _roi_frame(df, steps, floor_mode).drop("vulnerable_count")
    return out.withColumn("verdict", roi_verdict(F.col("roi_percentage")))


def citizen_impact(prevented: Column, tickets: Column, vulnerable: Column) -> dict[str, Column]:
    """Citizen hours and days saved, their value, satisfaction change."""
    hours = prevented * 3 * 2
    days = hours / dbl(8.0)
    value = days * dbl(500.0)
    satisfaction = F.when(tickets > 0, prevented / tickets * dbl(10.0) * dbl(0.2)).otherwise(dbl(0.0))
    return {
        "citizen_hours_saved": hours.cast("long"),
        "citizen_days_saved": days.cast("long"),
        "economic_value": value.cast("long"),
        "satisfaction_delta": satisfaction,
        "vulnerable_helped": vulnerable,
    }


def impact_grid(df: DataFrame, steps: list[int] | None = None) -> DataFrame:
    """I06 applied to every row of the ROI grid (same single scan)."""
    g = _roi_frame(df, steps, "reference")
    cols = citizen_impact(F.col("breaches_prevented"), F.col("current_tickets"), F.col("vulnerable_count"))
    return g.select("dept", "staff_increase_pct", "breaches_prevented", *[v.alias(k) for k, v in cols.items()])


def benchmark_compare(df: DataFrame) -> DataFrame:
    """The data's breach rate and mean resolution days against the
    published programmes. The fixed 4-row table is inlined as literals next
    to the one-row aggregate, so no join is planned."""
    k = df.agg(F.avg("sla_breach").alias("our_breach_rate"),
               (F.avg("resolution_hours") / dbl(24.0)).alias("avg_resolution_days"))
    programmes = F.array(*[
        F.struct(F.lit(n).alias("programme"), F.lit(a).cast("long").alias("applications"),
                 F.lit(r).alias("programme_breach_rate"), F.lit(d).alias("programme_days"))
        for n, a, r, d in dims.BENCHMARKS])
    return (k.select("*", F.inline(programmes))
            .select("programme", "applications", "our_breach_rate", "programme_breach_rate",
                    (F.col("our_breach_rate") - F.col("programme_breach_rate")).alias("breach_rate_gap"),
                    "avg_resolution_days", "programme_days",
                    (F.col("avg_resolution_days") - F.col("programme_days")).alias("days_gap")))
