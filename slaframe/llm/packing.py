"""Best-fit packing of tokenized documents by vector best-fit.

Tokenizing is a narrow map. White space separates pre-tokens in this
tokenizer, so texts are split at ASCII white space by Arrow, and every distinct
chunk of a block of texts is encoded once by the ``tokenizers`` library. ASCII
chunks are further split into the tokenizer's own pre-tokens, lower-cased as its
normalizer does; new pre-tokens are encoded many at a time, joined by spaces, and
told apart by the tokens that end a word. Other chunks, with letters beyond ASCII or
control characters, go to the library as they are. Only (id, piece, start, length, crc) leaves the task.

Packing deals pieces by hash into groups of about ``GROUP`` pieces, as many
groups as the count asks for. Inside a group, pieces go by falling size to the
open bin that fits best under every capacity (tokens, documents, attention
cost): by the least residual norm or the largest weighted dot product of need
and residual. Bins that stay emptier than ``FULL`` go on as units to further
rounds with fewer groups, so the waste is about one bin in all, not one a
group. A bin that cannot hold the least open amount of every resource besides
its own joins no other and is final; the rounds end when one group holds all
units or when a round leaves as many open units as it found. A group's size is bounded by the hash, whatever sources or lengths
repeat; no task sees more than a group.

Defined cases: null text counts as empty (one end token); pieces of the full
capacity are sequences of their own; rows that repeat an id are packed each; a
null id is kept as it is. Columns other than id and text are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import doc_blocks, stored, table

CAPACITY = 4096
END_ID = 1
GROUP = 8192
FULL = 0.99
RESOURCES = ["tokens", "documents", "attention"]
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CACHE_BYTES = 64 << 20  # of pre-tokens and other chunks that a worker keeps, also from task to task
ENTRY_BYTES = 210       # what an entry takes besides its key
STEP = 20_000     # chunks handled at once
JOINED = 500      # pre-tokens encoded in one call
BLOCK_BYTES = 8 << 20  # texts encoded at once inside a task
_TAIL = r"([a-z0-9])([!-&(-/:-@\[-`{-~]+)([\x09-\x0d\x20]|$)"
# The tokenizer's pre-tokens, for lower-case ASCII.
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_CACHES: dict[str, _Cache] = {}
_TOKENIZERS: dict[str, tuple[object, np.ndarray]] = {}


def _tokenizer(path: str):
    """The tokenizer, and for each id whether its token ends a word."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = t.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        _TOKENIZERS[path] = t, ends
    return _TOKENIZERS[path]


def _id_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _encode_each(words: list[str], path: str) -> Iterator[bytes]:
    tok, _ = _tokenizer(path)
    for lo in range(0, len(words), 20_000):
        for e in tok.encode_batch_fast(words[lo:lo + 20_000], add_special_tokens=False):
            yield _id_bytes(e.ids)


def _encode_joined(words: list[str], path: str) -> Iterator[bytes]:
    """Ids of pre-tokens, by calls for ``JOINED`` of them."""
    tok, ends = _tokenizer(path)
    for lo in range(0, len(words), JOINED):
        part = words[lo:lo + JOINED]
        ids = np.asarray(tok.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
        cut = (np.flatnonzero(ends[ids]) + 1) * 4
        if len(cut) != len(part) or cut[-1] != 4 * len(ids):  # not a tokenizer with word ends
            yield from _encode_each(part, path)
            continue
        raw, at = ids.tobytes(), 0
        for end in cut.tolist():
            yield raw[at:end]
            at = end


class _Cache:
    """Ids by pre-token and by odd chunk, in two generations of about half of
    ``CACHE_BYTES``: a full young one becomes the old one, and what is used
    again of that moves back."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def add(self, words: list[str], ids: Iterator[bytes]) -> None:
        self.young.update(zip(words, ids))
        self.size += sum(map(len, words)) + len(words) * ENTRY_BYTES

    def missing(self, words: list[str]) -> list[str]:
        """Those of distinct words that are unknown; the others are young now."""
        new = [w for w in words if w not in self.young]
        again = [w for w in new if w in self.old]
        self.add(again, map(self.old.__getitem__, again))
        return [w for w in new if w not in self.old] if again else new

    def trim(self) -> None:
        if self.size > CACHE_BYTES // 2:
            self.young, self.old, self.size = {}, self.young, 0


def _encode_chunks(chunks: list[str], path: str) -> list[bytes]:
    """Ids of distinct chunks without ASCII white space."""
    cache = _CACHES.setdefault(path, _Cache())
    out: list[bytes] = []
    for lo in range(0, len(chunks), STEP):
        cache.trim()
        step = chunks[lo:lo + STEP]
        cut = [(w,) if w.isascii() and w.isalpha() else _PRE_TOKEN.findall(w) if w.isascii() and w.isprintable() else None for w in step]
        new = cache.missing([w for w, ps in zip(step, cut) if ps is None])
        cache.add(new, _encode_each(new, path))
        new = cache.missing(list({p for ps in cut if ps for p in ps}))
        cache.add(new, _encode_joined(new, path))
        known = cache.young
        out += [known[w] if ps is None else known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])
                for w, ps in zip(step, cut)]
    return out


def encode_bytes(texts: pa.Array, path: str = VOCABULARY) -> Iterator[bytes]:
    """Unsigned little-endian 32-bit ids of each text of an Arrow string array,
    without an end token; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    # A copy whose text bytes begin at 0: Arrow lower-cases the cast of a slice wrongly.
    texts = pa.concat_arrays([texts, pa.array([], texts.type)])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[:len(texts) + 1]
    for lo, hi in doc_blocks(offsets, BLOCK_BYTES):
        # Punctuation that ends a chunk is a pre-token of its own.
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts.slice(lo, hi - lo)), _TAIL, r"\1 \2\3"))
        stop = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))
        words = split.flatten().dictionary_encode()
        del split
        raw = _encode_chunks(words.dictionary.to_pylist(), path)
        of = words.indices.to_numpy()
        for x, y in zip(stop[:-1].tolist(), stop[1:].tolist()):
            yield b"".join(map(raw.__getitem__, of[x:y].tolist()))


def encode(texts: pa.Array, path: str = VOCABULARY) -> Iterator[np.ndarray]:
    """The ids of each text as an array."""
    return (np.frombuffer(raw, "<u4") for raw in encode_bytes(texts, path))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY,
           capacity: int = CAPACITY) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32: documents longer than
    ``capacity`` are cut. ``row`` tells rows that repeat an id apart."""
    end = _id_bytes([END_ID])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                out = [(r, p, p * capacity, len(raw) // 4, zlib.crc32(raw)) for r, ids in enumerate(encode_bytes(b.column(2), path))
                       for p, raw in enumerate(_cut(ids + end, 4 * capacity))]
                cols = list(zip(*out)) or [()] * 5
                at = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(cols[1], pa.int32()),
                     *[pa.array(c, pa.int64()) for c in cols[2:]]],
                    names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])
        finally:
            pa.default_memory_pool().release_unused()

    ids = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                        F.col(text_col).cast("string").alias("t"))
            .mapInArrow(run, f"doc_id {ids}, row long, piece int, start long, length long, ids_crc32 long"))


def _cut(ids: bytes, size: int) -> list[bytes]:
    return [ids[i:i + size] for i in range(0, len(ids), size)]


def best_fit(need: np.ndarray, capacity: np.ndarray, rule: str = "norm") -> np.ndarray:
    """Bin of each item. ``need``: items x resources, as shares of a bin are
    taken by ``capacity``. Items go by falling norm, ties in the given order;
    among the bins that fit every resource, ``norm`` takes the least norm of
    what would be left and ``dot`` the largest product of need and residual,
    both weighted by how scarce each resource is over the items."""
    n = len(need)
    bins = np.full(n, -1, np.int64)
    if n == 0:
        return bins
    share = need / capacity
    weight = share.sum(0) / max(share.sum(), 1e-12)
    left = np.empty((64, need.shape[1]))
    of = np.empty(64, np.int64)   # rows of ``left`` are the open bins
    used = made = 0
    least = share.min(0)
    for i in np.argsort(-(share * share * weight).sum(1), kind="stable"):
        x = share[i]
        fit = (left[:used] >= x - 1e-12).all(1)
        if fit.any():
            at = np.flatnonzero(fit)
            if rule == "dot":
                j = at[np.argmax((left[at] * x * weight).sum(1))]
            else:
                j = at[np.argmin(((left[at] - x) ** 2 * weight).sum(1))]
        else:
            if used == len(left):
                left, of = np.resize(left, (2 * used, left.shape[1])), np.resize(of, 2 * used)
            j, left[used], of[used] = used, 1.0, made
            used, made = used + 1, made + 1
        left[j] -= x
        bins[i] = of[j]
        if (left[j] < least - 1e-12).any():  # nothing fits any more: close it
            used -= 1
            left[j], of[j] = left[used], of[used]
    return bins


def _round(units: DataFrame, groups: int, turn: int, capacity: list[float], rule: str) -> DataFrame:
    """Pack units (unit, tokens, documents, attention) into bins, by group."""
    caps = np.asarray(capacity, float)

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("unit", kind="stable")
        bins = best_fit(frame[RESOURCES].to_numpy(float), caps, rule)
        units = frame["unit"].to_numpy()
        first = np.unique(bins, return_index=True)[1]
        return pd.DataFrame({"unit": units, "bin": units[first[bins]]})  # a bin has the name of its first unit

    dealt = units.withColumn("g", F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(packed, "unit long, bin long")


def pack(lengths: DataFrame, capacity: int = CAPACITY, max_documents: int | None = None,
         max_attention: int | None = None, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """unit, sequence_id for units (unit long, tokens long). A sequence holds
    at most ``capacity`` tokens, ``max_documents`` units and an attention cost
    (sum of squared lengths) of ``max_attention``; by default the latter two
    are what ``capacity`` tokens can reach at most. One unit fits always."""
    caps = [float(capacity), float(max_documents or capacity), float(max_attention or capacity ** 2)]
    units = lengths.select("unit", F.col("tokens").cast("long").alias("tokens"), F.lit(1).cast("long").alias("documents"),
                           (F.col("tokens") * F.col("tokens")).cast("long").alias("attention"))
    bad = units.where((F.col("tokens") > caps[0]) | (F.col("attention") > caps[2])).count()
    if bad:
        raise ValueError(f"{bad} units exceed a sequence")
    placed = None  # unit -> bin so far
    turn = 0
    n = units.count()
    while True:
        groups = max(1, ceil(n / group))
        got = stored(_round(units, groups, turn, caps, rule), "bins")
        placed = got.select("unit", F.col("bin").alias("sequence_id")) if placed is None else (
            placed.join(got.select(F.col("unit").alias("sequence_id"), "bin"), "sequence_id", "left")
            .select(placed["unit"], F.coalesce("bin", "sequence_id").alias("sequence_id")))
        placed = stored(placed, "placed")
        if groups == 1:
            return placed
        full = (F.col("tokens") >= FULL * caps[0]) | (F.col("documents") >= caps[1]) | (F.col("attention") >= FULL * caps[2])
        units = stored(units.join(got, "unit").groupBy("bin").agg(*[F.sum(c).alias(c) for c in RESOURCES]).where(~full)
                       .withColumnRenamed("bin", "unit"), "open")
        least = units.agg(*[F.min(c) for c in RESOURCES]).first()
        for c, m, cap in zip(RESOURCES, least, caps):
            units = units.where(F.col(c) + F.lit(m) <= cap)  # beside what is least, or alone for good
        before, n = n, units.count()
        if n in (0, before):
            return placed
        turn += 1


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY,
                     capacity: int = CAPACITY, **limits) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    cut = stored(pieces(docs, id_col, text_col, path, capacity), "pieces")
    whole = cut.where(F.col("length") == capacity)
    rest = cut.where(F.col("length") < capacity)
    rest = stored(rest.select("*", F.monotonically_increasing_id().alias("unit")), "rest")
    placed = pack(rest.select("unit", F.col("length").alias("tokens")), capacity, **limits)
    order = Window.partitionBy("sequence_id").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    shared = (rest.join(placed, "unit")
              .withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")))
    alone = whole.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return shared.select(cols).unionByName(alone.select(cols))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (last): the pieces of all documents and their places."""
    return best_fit_packing(docs)
