"""I-Match document fingerprints (DataFrame operations only).

The lexicon holds the terms (lower-cased runs of letters and digits) whose
document frequency lies within a band, that is, whose inverse document
frequency is neither too low nor too high; frequencies count all documents. A
document keeps its distinct terms of the lexicon, sorted, and hashes them once
for each of ``SUBSETS`` randomised sub-lexicons. Sub-lexicons come at four
rates (1/4, 1/16, 1/64, 1/256 of the lexicon), so that a short and a long
document both have some with a term or two: those survive a partial edit.
Likeness is the share of equal sub-lexicon hashes at the best rate.

Scale: the band's lower end is a share of all documents, so the lexicon has at
most (mean distinct terms of a document) / ``LOW`` terms, whatever the corpus;
it goes into the plan as a literal hash table, and fingerprints need no join
and no shuffle. The next document in falling id comes from a window over id
ranges: texts are dealt once by range, and the highest document of a range is
also dealt to the range above it. Ranges are exact ids from an approximate
percentile (at most ``RANGES``); windows spill.

Defined cases: null text counts as empty. A text without a term of the lexicon
uses all its terms; a text without terms has the empty fingerprint, which is
like 1.0 to itself only. Null ids sort after all others. Rows that share an id
follow one another by a hash of the text. The only document is its own next.
Columns other than id and text are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

import json
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

LOW, HIGH = 0.001, 0.1   # band of the document frequency, as shares of all documents
SCALES = ((0, 4, 4), (2, 16, 16), (6, 64, 16), (12, 256, 16))  # first hash bit, one in so many terms, sub-lexicons
SUBSETS = sum(n for _, _, n in SCALES)
RANGES, RANGE_ROWS = 4096, 1024
LEAST = -(1 << 63)


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def lexicon(docs: DataFrame, text: Column, low: float = LOW, high: float = HIGH) -> list[int]:
    """Hashes of the terms within the band; bounded as the module says."""
    n = docs.count()
    counts = docs.select(F.explode(F.array_distinct(terms(text))).alias("term")).groupBy("term").count()
    band = counts.where((F.col("count") >= max(2, low * n)) & (F.col("count") <= high * n))
    return sorted(r[0] for r in band.select(F.xxhash64("term")).distinct().collect())


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def keeper(words: list[int]):
    """Column function: text -> sorted distinct term hashes in the lexicon."""
    size = 1
    while size < len(words):
        size *= 2
    buckets: list[list[int]] = [[] for _ in range(size)]
    for h in words:
        buckets[h & (size - 1)].append(h)
    lit = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<bigint>>")

    def keep(text: Column) -> Column:
        hashes = F.array_distinct(F.transform(terms(text), lambda t: F.xxhash64(t)))
        return _let(hashes, lambda hs: _let(
            F.filter(hs, lambda h: F.array_contains(lit[h.bitwiseAND(size - 1).cast("int")], h)),
            lambda own: F.array_sort(F.when(F.size(own) > 0, own).otherwise(hs))))

    return keep


def fingerprint(kept: Column) -> Column:
    """array<array<bigint>>: per rate a hash for each sub-lexicon, 0 if the
    document has none of its terms."""
    def scale(bit: int, rate: int, n: int) -> Column:
        def slot(h: Column) -> Column:
            return F.shiftright(h, bit).bitwiseAND(rate - 1)

        few = F.filter(kept, lambda h: slot(h) < n) if n < rate else kept
        return _let(few, lambda own: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: _let(
            F.filter(own, lambda h: slot(h) == j),
            lambda x: F.when(F.size(x) == 0, F.lit(0).cast("bigint")).otherwise(
                F.xxhash64(x).bitwiseAND(0xFFFFFFFF).bitwiseOR(1)))))

    return F.array(*[scale(*s) for s in SCALES])


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(F.flatten(fp), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """1.0 for equal fingerprints, else the largest share of equal hashes
    among the sub-lexicons of a rate that either document has terms of."""
    def share(s: int) -> Column:
        same = F.size(F.filter(F.zip_with(a[s], b[s], lambda x, y: (x == y) & (x != 0)), lambda t: t))
        some = F.size(F.filter(F.zip_with(a[s], b[s], lambda x, y: (x != 0) | (y != 0)), lambda t: t))
        return same / F.greatest(some, F.lit(4))

    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(*[share(s) for s in range(len(SCALES))]))


def _ranges(keys: DataFrame, rows: int) -> list[int]:
    """Upper ends of id ranges: ids that exist, the largest last."""
    n = max(1, min(RANGES, ceil(rows / RANGE_ROWS)))
    found = keys.agg(F.percentile_approx("key", [(i + 1) / n for i in range(n)], 20 * RANGES), F.max("key")).first()
    return sorted({*(found[0] or []), *([found[1]] if found[1] is not None else [])})


def followed(docs: DataFrame, *more: str) -> DataFrame:
    """docs (key, id, text, ...) plus next_<column> for text and ``more``."""
    bounds = _ranges(docs.select("key"), docs.count()) or [0]
    width = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    ends = F.from_json(F.lit(json.dumps([c[-1] for c in chunks])), "array<bigint>")
    inner = F.from_json(F.lit(json.dumps(chunks)), "array<array<bigint>>")
    key = F.col("key")
    placed = (docs.withColumn("_c", F.size(F.filter(ends, lambda e: e < key)))
              .withColumn("_f", F.size(F.filter(inner[F.col("_c")], lambda e: e < key)))
              .withColumn("_range", F.col("_c") * width + F.col("_f")))
    above = F.struct(((F.col("_range") + 1) % len(bounds)).alias("r"), F.lit(True).alias("guest"))
    home = F.struct(F.col("_range").alias("r"), F.lit(False).alias("guest"))
    dealt = placed.withColumn("_at", F.explode(F.when(
        inner[F.col("_c")][F.col("_f")] == key, F.array(home, above)).otherwise(F.array(home))))
    order = Window.partitionBy("_at.r").orderBy("_at.guest", key.desc(), F.xxhash64("text"), "text")
    return (dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *more)])
            .where(~F.col("_at.guest")).drop("_c", "_f", "_range", "_at"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW,
                 high: float = HIGH) -> DataFrame:
    """Fingerprints of every text and of its edited text (second half replaced
    by the beginning of the next document), and their likeness."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("key"), F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keep = keeper(lexicon(base, F.col("text"), low, high))
    printed = base.withColumn("kept", keep(F.col("text"))).withColumn("fp", fingerprint(F.col("kept"))).drop("kept")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    both = (followed(printed, "fp").withColumn("n_chars", n.cast("long"))
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
            .withColumn("kept", keep(F.col("edited"))).withColumn("efp", fingerprint(F.col("kept"))))
    return both.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
