"""Column expressions shared by the operators.

Everything here builds a ``Column`` from built-in functions, so it is
evaluated in the JVM inside whole-stage codegen; nothing calls into Python
per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(x: float) -> Column:
    return F.lit(float(x))


def round_half_even(c: str | Column, digits: int) -> Column:
    """NumPy/pandas ``round``: scale, round half to even, unscale.

    ``F.round`` rounds half up (0.25 -> 0.3); NumPy gives 0.2.
    """
    scale = float(10 ** digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """``np.clip`` for non-null, non-NaN input."""
    return F.least(F.greatest(col(c), dbl(lo)), dbl(hi))


def clean_number(c: str | Column, lo: float, hi: float, fill: float = 0.0) -> Column:
    """``pd.to_numeric(errors='coerce').clip(lo, hi).fillna(fill)``.

    Text that does not parse, null and NaN all become ``fill``; Spark's
    ``greatest`` ranks NaN highest, so NaN is turned into null first.
    """
    parsed = col(c).cast("string").try_cast("double")
    parsed = F.when(F.isnan(parsed), F.lit(None).cast("double")).otherwise(parsed)
    return F.coalesce(clip(parsed, lo, hi), dbl(fill))


def as_of_ts(as_of: str = dims.AS_OF) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(as_of).cast("timestamp_ntz")


def hours_between(start: str | Column, end: str | Column) -> Column:
    """Fractional hours from ``start`` to ``end`` (exact to the microsecond)."""
    micros = F.timestamp_diff("MICROSECOND", col(start), col(end))
    return micros.cast("double") / F.lit(3.6e9)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def priority_formula(p: str | Column, severity: str | Column, vulnerable: str | Column,
                     sentiment: str | Column, festival: str | Column,
                     w: tuple[float, float, float, float, float]) -> Column:
    """100 * clip(weighted sum, 0, 1), rounded half-even to one decimal."""
    raw = (dbl(w[0]) * col(p)
           + dbl(w[1]) * (col(severity) / F.lit(3.0))
           + dbl(w[2]) * col(vulnerable).cast("double")
           + dbl(w[3]) * ((-col(sentiment) + F.lit(1.0)) / F.lit(2.0))
           + dbl(w[4]) * col(festival).cast("double"))
    return round_half_even(F.lit(100.0) * clip(raw, 0.0, 1.0), 1)


def risk_status(c: str | Column) -> Column:
    """HIGH above 0.30, MEDIUM above 0.20, else LOW (strict bounds)."""
    c = col(c)
    return F.when(c > 0.30, "HIGH").when(c > 0.20, "MEDIUM").otherwise("LOW")


def risk_band(c: str | Column) -> Column:
    """Colour band: low below 0.2, medium below 0.3, else high (0.20 is medium)."""
    c = col(c)
    return F.when(c < 0.2, "low").when(c < 0.3, "medium").otherwise("high")
