"""Periodic runs of words, by recompression.

A run is a stretch of consecutive words with smallest period q and a length of
at least ``max(LEAST, POWER * q)`` that no neighbouring word extends.

Texts go by a narrow map through a block of bounded size: its words become
numbers, and all its texts one sequence with a separator of its own after
each. Recompression turns the sequence into a run-length grammar, level by level: a
block level replaces every maximal repetition of a symbol by one symbol, a pair
level deals the symbols by hash into left and right ones and replaces each
left-right pair by one symbol. Both depend on neighbouring symbols only, so equal
stretches get equal symbols but for their ends. A query for the longest common
extension of two places climbs the levels while the symbols agree, passing what sticks out of
its parent, and comes down where they differ: exact, in a number of steps that
follows the levels. All queries of a block climb together, as arrays.

Any run holds a place i of the grid of step ``(POWER - 1) * q`` of its
text, i + q included; where the words at both are the same, the extensions to
the right and (on the mirrored grammar) to the left give the whole stretch. A
stretch found for several periods keeps the smallest. The grids of all q have
n log n places together; they are looked through in chunks.

No shuffle. Memory is bounded by the block, or by the longest text if that is longer.

Defined cases: words are what is between the white space bytes 9 to 13 and 32;
null and empty texts have no words and no run; null ids and rows that repeat
are handled each; an empty table gives an empty result; columns other than id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_blocks, table

LEAST = 6
POWER = 4
BLOCK_BYTES = 1 << 20
CHUNK = 1 << 20   # grid places looked at together
BLANK = pa.scalar(" ", pa.large_string())
SPACE = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"


class Level(NamedTuple):
    """A string of the grammar; ``symbols`` ends with -1. ``parent`` and
    ``first`` (child of each parent) lead to the next level and back; ``blocks``
    tells whether that level compresses blocks or pairs."""
    symbols: np.ndarray
    parent: np.ndarray | None
    first: np.ndarray | None
    blocks: bool


def _left(symbols: np.ndarray, turn: int) -> np.ndarray:
    """Which symbols are left ones at this turn."""
    x = (symbols.astype(np.uint64) + np.uint64(turn * 7919 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(bool)


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels of the recompression of a sequence of integers from 0."""
    levels, turn = [], 0
    symbols = np.asarray(symbols, np.int64)
    while len(symbols) > 1:
        start = np.concatenate(([True], symbols[1:] != symbols[:-1]))
        blocks = not start.all()
        if blocks:
            first = np.flatnonzero(start)
            second = np.diff(first, append=len(symbols))
        else:
            turn += 1
            left = _left(symbols, turn)
            pair = left[:-1] & ~left[1:]
            if not pair.any():
                continue
            start[1:] = ~pair
            first = np.flatnonzero(start)
            second = np.where(np.concatenate((pair, [False]))[first], symbols[np.minimum(first + 1, len(symbols) - 1)] + 1, 0)
        parent = np.cumsum(start) - 1
        levels.append(Level(np.append(symbols, -1), np.append(parent, len(first)), np.append(first, len(symbols)), blocks))
        symbols = pd.factorize(symbols[first] * (second.max() + 1) + second)[0].astype(np.int64)
    return [*levels, Level(np.append(symbols, -1), None, None, False)]


def mirrored(levels: list[Level]) -> list[Level]:
    """The grammar of the reversed sequence."""
    out = []
    for symbols, parent, first, blocks in levels:
        turned = np.append(symbols[-2::-1], -1)
        if parent is not None:
            parent = np.append(parent[-1] - 1 - parent[-2::-1], parent[-1])
            first = first[-1] - first[::-1]
        out.append(Level(turned, parent, first, blocks))
    return out


def _step(level: Level, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far two places with one symbol go together before a parent's end."""
    if not level.blocks:
        return np.ones(len(x), np.int64)
    last = len(level.first) - 1
    return np.minimum(*(level.first[np.minimum(level.parent[z] + 1, last)] - z for z in (x, y)))


def common_extension(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of what begins at x and at y > x."""
    begin, at, fallen = x, np.arange(len(x)), []
    for level in levels:  # up
        same = level.symbols[x] == level.symbols[y]
        if level.parent is not None:
            px, py = level.parent[x], level.parent[y]
            inside = same & ((level.first[px] != x) | (level.first[py] != y))
            if inside.any():
                by = _step(level, x[inside], y[inside])
                x, y = x.copy(), y.copy()
                x[inside] += by
                y[inside] += by
                px, py = level.parent[x], level.parent[y]
                same &= (level.first[px] == x) & (level.first[py] == y)
        fallen.append((at[~same], x[~same], y[~same]))
        at = at[same]
        if level.parent is None or not len(at):
            break
        x, y = px[same], py[same]
    at, x, y = (np.zeros(0, np.int64),) * 3
    for depth in reversed(range(len(fallen))):  # down
        level = levels[depth]
        if len(at):
            x, y = level.first[x], level.first[y]
            by = np.where(level.symbols[x] == level.symbols[y], _step(level, x, y), 0)
            x, y = x + by, y + by
        at, x, y = (np.concatenate(z) for z in zip((at, x, y), fallen[depth]))
    out = np.empty(len(begin), np.int64)
    out[at] = x
    return out - begin


def find_runs(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, start, length, period of all runs, in this order, from the word
    numbers of texts one after the other and how many each has."""
    texts = np.arange(len(lengths))
    place = np.cumsum(lengths + 1) - (lengths + 1)  # of each text in the sequence with separators
    sequence = np.empty(len(words) + len(lengths), np.int64)
    inner = np.ones(len(sequence), bool)
    inner[place + lengths] = False
    sequence[inner] = words
    sequence[~inner] = (words.max() + 1 if len(words) else 0) + texts
    most = np.where(lengths >= LEAST, lengths // POWER, 0)  # the largest period of each text
    text = np.repeat(texts, most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = (lengths[text] - period - 1) // ((POWER - 1) * period) + 1
    ends = np.cumsum(count)
    levels, back, found, lo = None, None, [np.zeros((0, 3), np.int64)], 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, side="right")))
        n, q = count[lo:hi], np.repeat(period[lo:hi], count[lo:hi])
        nth = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(place[text[lo:hi]], n) + (POWER - 1) * q * nth
        lo, hit = hi, sequence[i] == sequence[i + q]
        i, q = i[hit], q[hit]
        if not len(i):
            continue
        if levels is None:
            levels = grammar(sequence)
            back = mirrored(levels)
        ahead = common_extension(levels, i, i + q)
        behind = common_extension(back, len(sequence) - i - q, len(sequence) - i)
        long = ahead + behind + q >= np.maximum(LEAST, POWER * q)
        found.append(np.stack(((i - behind)[long], (i + q + ahead)[long], q[long]), 1))
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)  # a stretch keeps its smallest period
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    start, end, period = found[new].T
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    text = np.searchsorted(place, start, side="right") - 1
    return text, start - place[text], end - start, period


def kept(lengths: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Mask of the words that no run holds behind its first period."""
    begins = np.cumsum(lengths) - lengths
    change = np.zeros(int(lengths.sum()) + 1, np.int64)
    np.add.at(change, begins[text] + start + period, 1)
    np.add.at(change, begins[text] + start + length, -1)
    return np.cumsum(change)[:-1] == 0


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and
    collapsed: the words that no run repeats, joined by single spaces."""
    kind = docs.schema[id_col].dataType.simpleString()
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            for lo, hi in doc_blocks(offsets, block_bytes):
                split = pc.ascii_split_whitespace(texts.slice(lo, hi - lo))
                flat = split.flatten()
                of = np.repeat(np.arange(hi - lo), pc.list_value_length(split).to_numpy())
                full = pc.not_equal(flat, "")  # a text's edges may leave empty words
                flat, of = flat.filter(full), of[full.to_numpy(zero_copy_only=False)]
                lengths = np.bincount(of, minlength=hi - lo)
                words = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
                text, *spans = find_runs(words, lengths)
                mask = kept(lengths, text, *spans)
                left = pa.ListArray.from_arrays(_offsets(np.bincount(of[mask], minlength=hi - lo)), flat.filter(pa.array(mask)))
                runs = pa.ListArray.from_arrays(_offsets(np.bincount(text, minlength=hi - lo)),
                                                pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in spans], fields=list(triple)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(lengths, pa.int64()), runs, pc.binary_join(left, BLANK).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
            .mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string"))


def repeated(text: Column, key: Column) -> Column:
    """The query's texts: for a tenth of the keys, the words from a place on
    repeat with a period; place and period follow from the key's crc32."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)).cast("long") + 1
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(
            words, lambda w, i: F.when(i < a, w).otherwise(words[(a + (i - a) % p).cast("int")])), " "))

    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.when(h % 10 == 0, F.transform(F.array(words), repeat)[0]).otherwise(text)


def highest(runs: Column) -> Column:
    """The run of the greatest length / period, the first of several."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256."""
    docs = table(spark, sf_dir, "documents")
    runs = periodic_runs(docs.select("doc_id", repeated(F.col("text"), F.col("doc_id")).alias("text")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = highest(F.col("runs"))
    return runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[top[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
