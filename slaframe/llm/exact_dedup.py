"""Exact dedup by deterministic block naming (DataFrame operations only).

Every normalised text is cut into blocks of ``block_bytes`` bytes. The
distinct blocks are sorted and numbered; a document becomes a sequence of
integer names. Adjacent names are paired, the distinct pairs are sorted and
numbered again, and so on until one name is left. Two documents get the same
(depth, name) if and only if their texts are equal: a name stands for exactly
one block or one pair of names, and documents of unlike depth differ in length.

Scale:

* Block texts cross the network once, for the distinct step, which combines
  map-side, so a block that a third of all rows share costs one row a task.
  Occurrences then find their block's name by a 128-bit key of the block. The
  named table holds each distinct block once, so it proves that no two blocks
  share a key; if two do, other seeds are taken.
* Names hold the number of the task that sorted the block, so numbering needs
  no global window. Each name table is written once to the shared folder
  before use: a lost executor cannot renumber.
* Joins have plain exchanges on both sides, so AQE splits hot names.
* There are log2(longest text / block_bytes) levels, each on half the rows.

Defined cases: null text counts as empty; empty texts equal one another. Null
ids sort last, so a null id stays only where its group has no other. Of rows
that repeat id and text one stays. Columns other than id and text are not
read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stored, table

BLOCK_BYTES = 1024


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _blocks(text: Column, size: int) -> Column:
    """Blocks of the UTF-8 bytes; an empty text has one empty block."""
    raw = text.cast("binary")
    last = F.greatest(F.ceil(F.octet_length(text) / size) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _key(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("k1"), F.xxhash64(F.lit(2 * seed + 1), block).alias("k2"))


def _numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """Sort distinct rows and give each an integer name."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _block_names(texts: DataFrame, size: int) -> tuple[int, DataFrame]:
    """Seed, and (k1, k2, name) with one row per distinct block."""
    blocks = texts.select(F.explode(_blocks(F.col("t"), size)).alias("block")).distinct()
    seed = 0
    while True:
        names = stored(_numbered(blocks, "block").select(_key(F.col("block"), seed).alias("k"), "name")
                       .select("k.k1", "k.k2", "name"), "block-names")
        if names.groupBy("k1", "k2").count().where("count > 1").isEmpty():
            return seed, names
        seed += 1


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``base`` (row, id, sha) with a row per document and ``ident`` (row,
    depth, name) with its collision-free identity."""
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    seed, names = _block_names(texts, block_bytes)
    rows = stored(texts.select(
        F.monotonically_increasing_id().alias("row"), "id", F.sha2(F.col("t").cast("binary"), 256).alias("sha"),
        F.transform(_blocks(F.col("t"), block_bytes), lambda b: _key(b, seed)).alias("ks")), "dedup-rows")
    longest = rows.agg(F.max(F.size("ks"))).first()[0] or 1
    cur = stored(rows.select("row", F.size("ks").alias("n"), F.posexplode("ks").alias("pos", "k"))
                 .select("row", "n", "pos", "k.k1", "k.k2").join(names, ["k1", "k2"])
                 .select("row", "n", "pos", "name"), "level")
    done = [cur.where("n = 1").select("row", F.lit(0).alias("depth"), "name")]
    for depth in range(1, ceil(log2(longest)) + 1):
        even = F.col("pos") % 2 == 0
        pairs = (cur.where("n > 1").groupBy("row", "n", F.floor(F.col("pos") / 2).cast("int").alias("half"))
                 .agg(F.max(F.when(even, F.col("name"))).alias("l"),
                      F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r")))
        names = stored(_numbered(pairs.select("l", "r").distinct(), "l", "r"), "pair-names")
        cur = stored(pairs.join(names, ["l", "r"])
                     .select("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("pos"), "name"),
                     "level")
        done.append(cur.where("n = 1").select("row", F.lit(depth).alias("depth"), "name"))
    ident = done[0]
    for d in done[1:]:
        ident = ident.unionByName(d)
    return rows.drop("ks"), ident


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    base, ident = identities(docs, id_col, text_col, block_bytes)
    named = stored(base.join(ident, "row"), "named")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    keep = stored(named.groupBy("depth", "name").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
                  .select("depth", "name", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"),
                          "group_size"), "keep")
    return named.join(keep, ["depth", "name"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row that stays, all its columns. Rows
    are told apart by their number in a stored copy, so repeated and null ids
    come back only where the operator keeps them. The number's column has a
    name that the documents do not use."""
    row = free_name(docs, "_row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "dedup-docs")
    key = free_name(numbered, "_key")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))  # exact_dedup's order of rows
    kept = exact_dedup(numbered.select(order.alias(key), "text"), key).where("kept").select(F.col("doc_id.row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
