"""Connected components by smallest label, with pointer jumping.

Labels go over the edges (a grouped minimum, combined map-side), then each
label is replaced by its own label. Every step is written to the shared
folder; nothing but one sum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """v, c: for every vertex of ``edges`` (a, b) the smallest vertex that it
    reaches. Self-loops and repeated edges do no harm; no edges, no rows."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                    .select("v", F.least("v", "m").alias("c")), "labels")
    total = labels.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        seen = (both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m")))
        hooked = stored(labels.join(seen, F.col("v") == F.col("a")).select("v", F.least("c", "m").alias("c")), "hooked")
        labels = stored(hooked.join(hooked.select(F.col("v").alias("c"), F.col("c").alias("cc")), "c")
                        .select("v", F.col("cc").alias("c")), "labels")
        now = labels.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total = now
    return labels
