"""Projections, filters and predicates.

``apply_filters`` turns a ``FilterSpec`` into ONE boolean ``Column``. Catalyst
combines it with any other predicate, pushes the parts that touch only base
columns below joins and into the parquet scan (date bounds are written on the
raw timestamp so they stay pushable), and evaluates the rest in codegen.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims

SCENARIOS = ("Custom Filters", "Monsoon Crisis", "Festival Period", "Vulnerable Households")
# Fixed values of the monsoon scenario.
MONSOON_DISTRICTS = ["Mumbai City", "Mumbai Suburban", "Thane"]
MONSOON_DEPTS = ["Roads", "Water"]
MONSOON_MIN_SEVERITY = 2


@dataclass
class FilterSpec:
    date_from: _dt.date | str | None = None
    date_to: _dt.date | str | None = None
    severity_min: int = 1
    prob_min: float = 0.0
    prob_max: float = 1.0
    prio_min: float = 0.0
    prio_max: float = 100.0
    scenario: str = "Custom Filters"
    districts: list[str] = field(default_factory=list)
    depts: list[str] = field(default_factory=list)
    wards: list[str] = field(default_factory=list)
    search: str = ""


def _day(d) -> str:
    return d.isoformat() if isinstance(d, _dt.date) else str(d)


def date_bounds(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """first and last creation date."""
    return df.agg(F.to_date(F.min(ts)).alias("min_date"), F.to_date(F.max(ts)).alias("max_date"))


def date_range_pred(date_from, date_to, ts: str = "created_at") -> Column:
    """inclusive calendar-date range, as bounds on the raw timestamp."""
    pred = F.lit(True)
    if date_from is not None:
        pred = pred & (F.col(ts) >= F.lit(_day(date_from)).cast("timestamp_ntz"))
    if date_to is not None:
        upper = F.date_add(F.lit(_day(date_to)).cast("date"), 1).cast("timestamp_ntz")
        pred = pred & (F.col(ts) < upper)
    return pred


def date_folder_pred(date_from, date_to, folder: str = "created_date") -> Column:
    """F02 on a table stored in date folders: the range as bounds on the folder
    column, which Spark answers from the folder names."""
    pred = F.lit(True)
    if date_from is not None:
        pred = pred & (F.col(folder) >= F.lit(_day(date_from)).cast("date"))
    if date_to is not None:
        pred = pred & (F.col(folder) <= F.lit(_day(date_to)).cast("date"))
    return pred


def filter_dates(df: DataFrame, date_from, date_to, folder: str = "created_date") -> DataFrame:
    """F02 of a table: by date folders too where it has them."""
    pred = date_range_pred(date_from, date_to)
    return df.where(pred & date_folder_pred(date_from, date_to, folder)) if folder in df.columns else df.where(pred)


def severity_pred(min_severity: int) -> Column:
    """F03."""
    return F.col("severity") >= F.lit(min_severity)


def risk_pred(lo: float, hi: float) -> Column:
    """inclusive both ends."""
    return F.col("pred_sla_breach_prob").between(F.lit(float(lo)), F.lit(float(hi)))


def priority_pred(lo: float, hi: float) -> Column:
    """inclusive both ends."""
    return F.col("priority_score").between(F.lit(float(lo)), F.lit(float(hi)))


def monsoon_pred() -> Column:
    """F06."""
    return (F.col("district").isin(MONSOON_DISTRICTS) & F.col("dept").isin(MONSOON_DEPTS)
            & (F.col("severity") >= MONSOON_MIN_SEVERITY))


def festival_pred() -> Column:
    """F07."""
    return F.col("festival_season") == 1


def vulnerable_pred() -> Column:
    """F08."""
    return F.col("vulnerable_population") == 1


def _in(c: str, values: list[str]) -> Column:
    return F.col(c).isin(list(values)) if values else F.lit(True)


def custom_pred(districts=(), depts=(), wards=()) -> Column:
    """each non-empty list restricts; an empty list means all."""
    return _in("district", districts) & _in("dept", depts) & _in("ward", wards)


def refine_pred(districts=(), wards=()) -> Column:
    """inside a scenario only district and ward refine."""
    return _in("district", districts) & _in("ward", wards)


def search_pred(text: str, columns=("ticket_id", "category", "ward")) -> Column:
    """the lower-cased text as a regular expression against the
    lower-cased, null-as-empty columns, OR-ed."""
    s = text.strip().lower()
    if not s:
        return F.lit(True)
    return reduce(lambda a, b: a | b,
                  [F.lower(F.coalesce(F.col(c), F.lit(""))).rlike(s) for c in columns])


def filter_predicate(spec: FilterSpec) -> Column:
    """every filter of the spec as one conjunction."""
    pred = (date_range_pred(spec.date_from, spec.date_to) & severity_pred(spec.severity_min)
            & risk_pred(spec.prob_min, spec.prob_max) & priority_pred(spec.prio_min, spec.prio_max))
    if spec.scenario == "Monsoon Crisis":
        pred = pred & monsoon_pred()
    elif spec.scenario == "Festival Period":
        pred = pred & festival_pred()
    elif spec.scenario == "Vulnerable Households":
        pred = pred & vulnerable_pred()
    else:
        pred = pred & custom_pred(spec.districts, spec.depts, spec.wards)
    if spec.scenario != "Custom Filters":
        pred = pred & refine_pred(spec.districts, spec.wards)
    return pred & search_pred(spec.search)


def apply_filters(df: DataFrame, spec: FilterSpec, folder: str = "created_date") -> DataFrame:
    """F12 of a table; only the date folders in the spec's range are read."""
    df = df.where(filter_predicate(spec))
    return df.where(date_folder_pred(spec.date_from, spec.date_to, folder)) if folder in df.columns else df


def option_list(df: DataFrame, c: str) -> DataFrame:
    """sorted distinct non-null values of one column."""
    return df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)


def option_lists(df: DataFrame, columns=("district", "dept", "ward")) -> DataFrame:
    """F13 for several columns in one pass: (field, value), sorted."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("o")).select("o.*")
    return stacked.where(F.col("value").isNotNull()).distinct().orderBy("field", "value")


def routing_options(df: DataFrame) -> DataFrame:
    """ministry choices (known ministries plus Cross-Ministry) and
    department choices (departments in the data plus Cross-Department)."""
    spark = df.sparkSession
    ministries = spark.createDataFrame([(m,) for m in dims.MINISTRY.values()] + [(dims.CROSS_MINISTRY,)],
                                       "value string").select(F.lit("ministry").alias("kind"), "value")
    depts = (df.select(F.col("dept").alias("value")).where(F.col("value").isNotNull())
             .unionByName(spark.createDataFrame([(dims.CROSS_DEPARTMENT,)], "value string"))
             .select(F.lit("dept").alias("kind"), "value"))
    return ministries.unionByName(depts).distinct().orderBy("kind", "value")


def with_display_names(df: DataFrame) -> DataFrame:
    """F16: rename columns to their display labels. Column name, label and help
    text also go into the column's metadata, which Parquet keeps."""
    return df.select(*[F.col(c).alias(dims.label_of(c), metadata={"column": c, "label": dims.label_of(c), "help": dims.help_of(c)})
                       for c in df.columns])


def column_help(df: DataFrame) -> DataFrame:
    """F16: (column, label, help, filled) of a table with display names, read from
    its schema; ``filled`` counts the values that are not null."""
    about = [(f.name, f.metadata) for f in df.schema.fields]
    counts = df.agg(*[F.count(F.col(f"`{name}`")).alias(f"c{i}") for i, (name, _) in enumerate(about)])
    rows = F.array(*[F.struct(F.lit(m.get("column", name)).alias("column"), F.lit(m.get("label", name)).alias("label"),
                              F.lit(m.get("help", "")).alias("help"), F.col(f"c{i}").alias("filled"))
                     for i, (name, m) in enumerate(about)])
    return counts.select(F.inline(rows))
