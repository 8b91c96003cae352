"""Merkle manifest of a dataset by nested-struct rollup.

Every row is a leaf: the SHA-256 of its fields, each with its length in front.
Leaves are ordered inside their group (source), every ``ARITY`` consecutive
nodes become one, level by level up to the group's subroot, and the subroots,
ordered by group, likewise give the root.

* Ranks: a range partitioning by (group, key, leaf, row) and a sort inside each
  partition number the rows; counts of (group, partition) turn those numbers
  into ranks inside the group. No window or task spans a group, so a group or
  a key with a third of all rows costs no more than others.
* Rollup: the rank's digits in base ``ARITY`` are grouped away, last digit
  first. All rows of a block of ``ARITY ** DIGITS`` ranks meet in one partition
  (one shuffle of digests); three groupings nest the nodes' structs as arrays
  of children. Block nodes are ranked by their block number and go through the
  same step until each group has one node. A row holds one block at most.
* Proofs: from the top down each block's nested structs are taken apart by
  ``transform`` and ``explode``, which put the siblings left and right of each
  child beside it. What a block needs from above comes by a union and a grouping on
  (group, block); there is no join in this step.

Defined cases: a null field enters the leaf as ``-``; a null group is a group
of its own and comes first; null keys come first in their group; rows with
equal keys are ordered by leaf, then by row; rows whose key is null are never
tampered with; an empty table gives an empty result; columns other than the
five fields are not read, and their names are free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stored, table

ARITY = 16
DIGITS = 3
BLOCK = ARITY ** DIGITS
LEVELS = 15          # 16 ** 15 ranks fit in a long
TAMPER = 5           # of so many keys, one is checked with a changed text
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_PATH = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaves(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source",
           fields: tuple[str, ...] = ("lang", "n_chars"), text_col: str = "text") -> DataFrame:
    """grp, key, row, digest, tampered: one leaf a row; ``tampered`` is the leaf
    after lower-casing the text's A-Z, null for rows that stay as they are."""
    head = [field(F.col(c)) for c in (id_col, group_col, *fields)]
    text = F.col(text_col).cast("string")
    marked = F.crc32(F.col(id_col).cast("string")) % TAMPER == 0
    return docs.select(
        F.col(group_col).alias("grp"), F.col(id_col).alias("key"), F.monotonically_increasing_id().alias("row"),
        F.sha2(F.concat(*head, field(text)), 256).alias("digest"),
        F.when(marked, F.sha2(F.concat(*head, field(F.translate(text, UPPER, UPPER.lower()))), 256)).alias("tampered"))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with rank (from 0, inside grp by ``order``) and n, the rows of
    the group. ``order`` must tell any two rows of a group apart."""
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    rows = stored(nodes.repartitionByRange(partitions(nodes.sparkSession), *by).sortWithinPartitions(*by)
                  .withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", 33)
    spans = rows.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("grp")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("grp").alias("g"), "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                         F.sum("n").over(group).alias("n"))
    return (rows.join(spans, rows["grp"].eqNullSafe(spans["g"]) & (part == spans["part"]))
            .withColumn("rank", F.col("at") + F.col("shift")).drop("at", "shift", "g", "part"))


def height(n: Column) -> Column:
    """Levels of hashing above n nodes."""
    return sum(((n > ARITY ** k).cast("int") for k in range(LEVELS)), F.lit(0))


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def rollup(nodes: DataFrame, level: int) -> DataFrame:
    """grp, height, rank (of the block), digest, kids from nodes (grp, height,
    rank, digest, item) whose ranks count at ``level``."""
    digit = [F.floor(F.col("rank") / ARITY ** k).cast("long") % ARITY for k in range(DIGITS)]
    out = (nodes.select("grp", "height", F.floor(F.col("rank") / BLOCK).cast("long").alias("block"),
                        *[d.cast("int").alias(f"d{k}") for k, d in enumerate(digit)], "digest", F.struct("item").alias("kids"))
           .repartition("grp", "block"))
    for k in range(DIGITS):
        rest = [f"d{j}" for j in range(DIGITS - 1, k, -1)]
        out = out.groupBy("grp", "height", "block", *rest).agg(
            F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("digit"), "digest", "kids"))).alias("kids"))
        own = F.col("kids.digest")
        out = out.withColumn("digest", F.when(F.col("height") > level + k, F.sha2(_joined(own), 256)).otherwise(own[0]))
    return out.select("grp", "height", F.col("block").alias("rank"), "digest", "kids")


def _apart(rows: DataFrame, level: int, keep: list[str]) -> DataFrame:
    """A row for each child in ``kids``, its siblings put before ``path``."""
    own = F.transform("kids", lambda c: c["digest"])
    out = rows.withColumn("own", own)
    child = F.explode(F.transform("kids", lambda c, i: F.struct(
        c["digit"].alias("digit"), c["digest"].alias("digest"), c["kids"].alias("kids"),
        _joined(F.slice("own", F.lit(1), i)).alias("left"), _joined(F.slice("own", i + 2, F.lit(ARITY))).alias("right"))))
    out = out.select(*keep, "height", "rank", "path", child.alias("c"))
    here = F.when(F.col("height") > level, F.array(F.struct("c.left", "c.right"))).otherwise(F.array().cast(NO_PATH))
    return out.select(*keep, "height", (F.col("rank") * ARITY + F.col("c.digit")).alias("rank"),
                      F.concat(here, F.col("path")).alias("path"), F.col("c.digest").alias("digest"), F.col("c.kids").alias("kids"))


def unfold(nested: DataFrame, above: DataFrame, level: int) -> DataFrame:
    """grp, rank, digest, item, path and top (digests above the group) of the
    nodes in ``nested`` (a ``rollup``), given grp, rank, path, top of each block."""
    kinds = dict(above.dtypes) | dict(nested.dtypes)
    both = nested.select("grp", "rank", "height", "kids", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("path", "top")])
    both = both.unionByName(above.select("grp", "rank", "path", "top", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("height", "kids")]))
    rows = both.groupBy("grp", "rank").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("height", "kids", "path", "top")])
    for k in reversed(range(DIGITS)):
        rows = _apart(rows, level + k, ["grp", "top"])
    return rows.select("grp", "rank", "digest", F.col("kids.item").alias("item"), "path", "top")


def forest(nodes: DataFrame) -> list[DataFrame]:
    """Stored rollups of (grp, rank, n, digest, item), lowest first, until each
    group has one node."""
    nodes = nodes.select("grp", height(F.col("n")).alias("height"), "rank", "digest", "item")
    layers = []
    while True:
        layers.append(stored(rollup(nodes, DIGITS * len(layers)), "rollup"))
        if not layers[-1].agg(F.max("rank")).first()[0]:  # none, or block 0 alone
            return layers
        nodes = layers[-1].select("grp", "height", "rank", "digest", F.lit(None).cast("int").alias("item"))


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source",
                    fields: tuple[str, ...] = ("lang", "n_chars"), text_col: str = "text") -> DataFrame:
    """key, grp, rank, leaf, tampered, subroot, root and path (siblings left
    and right, from the leaf's level to the root) per row."""
    rows = stored(leaves(docs, id_col, group_col, fields, text_col), "leaves")
    lower = forest(ranked(rows, ["key", "digest", "row"]).withColumn("item", F.struct("key", "tampered")))
    one = F.lit(0).alias("grp")
    subroots = lower[-1].select(one, F.col("grp").alias("name"), "digest")
    upper = forest(ranked(subroots, ["name"]).withColumn("item", F.struct("name")))
    top = upper[-1].select("grp", "rank", F.array().cast(NO_PATH).alias("path"), F.array("digest").alias("top"))
    for k in reversed(range(len(upper))):
        top = unfold(upper[k], top, DIGITS * k)
    above = top.select(F.col("item.name").alias("grp"), F.lit(0).cast("long").alias("rank"), "path",
                       F.concat(F.array("digest"), "top").alias("top"))
    above = stored(above, "subroots")
    for k in reversed(range(len(lower))):
        above = unfold(lower[k], above, DIGITS * k)
    return above.select(F.col("item.key").alias("key"), "grp", "rank", F.col("digest").alias("leaf"),
                        F.col("item.tampered").alias("tampered"), F.col("top")[0].alias("subroot"), F.col("top")[1].alias("root"), "path")


def proof_digest(path: Column) -> Column:
    """SHA-256 of a path's siblings, level by level, left to right."""
    return F.sha2(_joined(F.transform(path, lambda x: F.concat(x["left"], x["right"]))), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    proofs = merkle_manifest(table(spark, sf_dir, "documents"))
    return (proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                          fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


_CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), "
        "lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
        "lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))")
SQL_LEVELS = 6  # of either tree: 16 ** 6 leaves a source


def _sql_field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


def _sql_tree(name: str, start: str) -> str:
    """CTEs name_k (grp, rank, n, digest): the nodes of level k, n to a group;
    name_s_k: each node's siblings. ``start`` gives level 0."""
    out = [f"{name}_0 AS ({start})"]
    for k in range(SQL_LEVELS):
        run = f"PARTITION BY grp, rank // {ARITY} ORDER BY rank ROWS BETWEEN"
        out.append(f"{name}_s_{k} AS (SELECT grp, rank, n, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                   f"coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_{k})")
        out.append(f"{name}_{k + 1} AS (SELECT grp, rank // {ARITY} AS rank, (any_value(n) + {ARITY - 1}) // {ARITY} AS n, "
                   f"CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY rank)) ELSE min(digest) END AS digest "
                   f"FROM {name}_{k} GROUP BY grp, rank // {ARITY})")
    return ", ".join(out)


def _sql_folds() -> str:
    """CTEs f_j: what a leaf folds to, and its siblings so far, level by level."""
    out, j = [], 0
    for name, grp, rank in (("t", "f.grp", "f.rank"), ("u", "0", "f.place")):
        for k in range(SQL_LEVELS):
            out.append(f"f_{j + 1} AS (SELECT f.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || f.folded || s.r) ELSE f.folded END AS folded, "
                       f"CASE WHEN s.n > 1 THEN f.proof || s.l || s.r ELSE f.proof END AS proof) FROM f_{j} f JOIN {name}_s_{k} s "
                       f"ON s.grp IS NOT DISTINCT FROM {grp} AND s.rank = {rank} // {ARITY ** k})")
            j += 1
    return ", ".join(out)


_HEAD = " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
SQL = f"""WITH leaf AS (SELECT doc_id, source AS grp, sha256({_HEAD} || {_sql_field("text")}) AS digest,
    CASE WHEN {_CRC} % {TAMPER} = 0 THEN sha256({_HEAD} || {_sql_field(_LOWERED)}) END AS tampered FROM documents),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS rank,
    count(*) OVER (PARTITION BY grp) AS n FROM leaf),
  {_sql_tree("t", "SELECT grp, rank, n, digest FROM numbered")},
  roots AS (SELECT grp AS name, digest, row_number() OVER (ORDER BY encode(grp) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM t_{SQL_LEVELS}),
  {_sql_tree("u", "SELECT 0 AS grp, place AS rank, n, digest FROM roots")},
  f_0 AS (SELECT doc_id, x.grp, rank, place, x.digest AS leaf, roots.digest AS subroot, coalesce(tampered, x.digest) AS folded, '' AS proof
    FROM numbered x JOIN roots ON roots.name IS NOT DISTINCT FROM x.grp),
  {_sql_folds()}
  SELECT doc_id, leaf, subroot, (SELECT digest FROM u_{SQL_LEVELS}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
    folded = (SELECT digest FROM u_{SQL_LEVELS}) AS verified FROM f_{2 * SQL_LEVELS}"""
