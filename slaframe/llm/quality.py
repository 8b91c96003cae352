"""Quality classifier: a byte-level convolutional network in numpy.

The UTF-8 bytes of the whole text are embedded, cut into chunks of ``WIDTH``
bytes that overlap by half, and every learned filter is applied to every
chunk. Each filter keeps its strongest response (max-pooling over the
document); a logistic layer combines the pooled responses into one
probability. Nothing but the text enters a score.

The network is fitted by Adam in one task on at most ``FIT_ROWS`` labelled
documents whose crc32(doc_id) mod 5 is not 0 (the documented bound of the fit;
which rows is decided by a hash of the id). Scoring is a narrow map. Fit and
scores read whole texts in segments of bounded memory: max-pooling needs only
the running maximum.

Defined cases: null and empty texts score as one chunk of padding; texts
shorter than a chunk are padded; ties, repeated rows and null ids are scored
like any other (``held_out`` is null for a null id); an empty table gives an
empty result; without labelled rows, or with one class only, every score is
the share of label 1 (0.5 without labels). Columns other than id and text are
not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, utf8_column

FIT_ROWS = 4000
FIT_BYTES = 64 << 20  # of texts that it is fitted on
THRESHOLD = 0.3
EMBED, WIDTH, STRIDE, FILTERS = 4, 32, 16, 24
SEGMENT = 1 << 19
PAD = 0


def chunk_starts(n_bytes: int) -> int:
    """Number of overlapping chunks that cover ``n_bytes`` bytes."""
    return max(1, -(-(n_bytes - WIDTH) // STRIDE) + 1) if n_bytes > WIDTH else 1


def init_net(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    return {"E": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "W": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "v": r.normal(0, FILTERS ** -0.5, FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32)}


def _responses(net: dict, raw: np.ndarray) -> np.ndarray:
    """Filter responses of the chunks of ``raw`` (padded to whole chunks)."""
    k = chunk_starts(len(raw))
    padded = np.full((k - 1) * STRIDE + WIDTH, PAD, np.uint8)
    padded[:len(raw)] = raw
    halves = net["E"][padded].reshape(-1, STRIDE * EMBED)  # a chunk is two adjacent halves
    both = halves @ net["W"].reshape(2, STRIDE * EMBED, FILTERS).transpose(1, 0, 2).reshape(STRIDE * EMBED, -1)
    return both[:-1, :FILTERS] + both[1:, FILTERS:]


def strongest(net: dict, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response over the whole text and the byte where
    that chunk starts, by segments that overlap by one stride."""
    best, arg = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
    at = 0
    while True:
        resp = _responses(net, raw[at:at + SEGMENT])
        k = resp.argmax(0)
        top = resp[k, np.arange(FILTERS)]
        arg = np.where(top > best, at + k * STRIDE, arg)
        best = np.maximum(best, top)
        if at + SEGMENT >= len(raw):
            return best, arg
        at += SEGMENT - STRIDE  # the chunk across the cut is in the next segment


def probability(net: dict, raw: np.ndarray) -> float:
    if "share" in net:
        return float(net["share"][0])
    z = float(np.maximum(strongest(net, raw)[0] + net["b"], 0) @ net["v"] + net["c"][0])
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[bytes], labels: list[int], epochs: int = 24, batch: int = 32, rate: float = 0.004,
        seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the logistic loss. The gradient of a max goes to one chunk, so
    the backward pass touches FILTERS chunks a document."""
    y = np.asarray(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return {"share": np.array([y.mean() if len(y) else 0.5])}
    net, rng = init_net(seed), np.random.default_rng(seed)
    raws = [np.frombuffer(t, np.uint8) for t in texts]
    m = {k: np.zeros_like(x) for k, x in net.items()}
    s = {k: np.zeros_like(x) for k, x in net.items()}
    step = 0
    steps = epochs * -(-len(raws) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(raws))
        for lo in range(0, len(order), batch):
            ids = order[lo:lo + batch]
            g = {k: np.zeros_like(x) for k, x in net.items()}
            for i in ids:
                raw = raws[i]
                top, arg = strongest(net, raw)
                pre = top + net["b"]
                h = np.maximum(pre, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ net["v"] + net["c"][0], -30, 30)))
                d = np.float32((p - y[i]) / len(ids))
                g["v"] += d * h
                g["c"] += d
                dh = d * net["v"] * (pre > 0)
                g["b"] += dh
                live = np.flatnonzero(dh)
                if len(live) == 0:
                    continue
                where = arg[live, None] + np.arange(WIDTH)
                chunk = np.where(where < len(raw), raw[np.minimum(where, len(raw) - 1)], PAD) if len(raw) else where * 0
                x = net["E"][chunk].reshape(len(live), -1)
                g["W"][:, live] += x.T * dh[live]
                np.add.at(g["E"], chunk, (net["W"][:, live].T * dh[live, None]).reshape(len(live), WIDTH, EMBED))
            step += 1
            lr = rate * (1 - 0.9 * step / steps)
            for k in net:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                net[k] = net[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in net.items()}


def _packed(net: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **net)
    return out.getvalue()


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 5; fold 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "quality", fit_bytes: int = FIT_BYTES) -> DataFrame:
    """_id, y, t (bytes): at most ``fit_rows`` labelled ids outside fold 0, one row
    each. Of the rows that share an id the one of the least text hash counts, and
    ids are taken in hash order until their texts have ``fit_bytes``, so neither a
    repeated id nor very long texts fill the task that fits."""
    rows = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
            .where(F.col("_id").isNotNull() & F.col("y").isNotNull()).where(fold("_id") != 0)
            .groupBy("_id").agg(F.max("y").alias("y"))
            .orderBy(F.xxhash64("_id"), "_id").limit(fit_rows))
    picked = (docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
              .join(F.broadcast(rows), "_id")  # at most fit_rows rows
              .groupBy("_id", "y").agg(F.min(F.struct(F.xxhash64("t"), "t"))["t"].alias("t")))
    so_far = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)  # over at most fit_rows rows
    return picked.withColumn("bytes", F.sum(F.octet_length("t")).over(so_far)).where(F.col("bytes") <= fit_bytes).drop("bytes")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", fit_bytes: int = FIT_BYTES) -> dict[str, np.ndarray]:
    """Fit on ``labelled_sample`` in one task; the driver gets the fitted weights only."""
    picked = labelled_sample(docs, labels, fit_rows, id_col, text_col, label_col, fit_bytes).select(F.lit(0).alias("one"), "_id", "y", "t")

    def fitted(key, frame):
        import pandas as pd

        frame = frame.sort_values(["_id", "t"])
        return pd.DataFrame({"net": [_packed(fit([bytes(t) for t in frame["t"]], list(frame["y"])))]})

    got = picked.groupBy("one").applyInPandas(fitted, "net binary").collect()
    if not got:
        return {"share": np.array([0.5])}
    return dict(np.load(io.BytesIO(bytes(got[0]["net"]))))


def score(docs: DataFrame, net: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8_column(b.column(1))
            p = np.array([probability(net, data[offs[i]:offs[i + 1]]) for i in range(b.num_rows)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])

    ids = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"doc_id {ids}, score double")
    return got.select("doc_id", (fold() == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier accepts, all columns. The
    keep flag is computed beside the row, so no join is needed."""
    net = train(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8_column(b.column(at))
            keep = [probability(net, data[offs[i]:offs[i + 1]]) >= THRESHOLD for i in range(b.num_rows)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
