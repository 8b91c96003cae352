"""Byte-level BPE encoding and decoding with Spark higher-order functions.

A narrow map splits whole texts by the public pattern. For each block of documents
it cuts the distinct pre-tokens where no merge can cross (``_cuts``), gives the
distinct segments of the block as arrays of parts, ``WORDS`` a row, and then a row
of the documents as numbers of pre-tokens and these as numbers of segments. Spark
folds the ranked merges over every distinct segment: ``aggregate`` keeps the parts,
each with the rank of its pair above it, merges the leftmost pair of least rank and
looks up only the two new neighbours. The rank map is a literal whose slot for
a pair is found by one addition. Decoding joins the pieces of the ids, again a
literal. A second narrow map, which gets the rows of its
partition in their order, puts the documents together. No shuffle, no
broadcast of data; a block has at most ``BLOCK_CHARS`` characters (or one
document) and a folded row ``WORDS`` segments, so memory is bounded.

The fold works on pairs of ranks: a pair may merge if its bytes together are
a token, as in the tiktoken library. Tokens that the merges cannot reach from
single bytes are matched whole, as that library does. A step copies the array of
parts, so a segment of n bytes costs n steps of n: seconds for 10,000 letters
without a space or a cut, hours for a million.

Two bytes a, b are settled if their rank is below that of every merge that could
take a from the left or b from the right, given the bytes beside them: (a, b) can
be merged until one of those is, so it comes first. A merge across a boundary thus
holds both its neighbours, a settled pair or else a byte on either side; if no
token contains them, none ever crosses, and what lies left and right is merged as
if alone. This holds for any text and any ranks. A settled pair is also given to
the fold as one part, if no pair with it has a lower rank than it, as such a pair
would else be merged too early.

Defined cases: null and empty texts have no tokens (sha256 of nothing); null
ids and rows that repeat are encoded each; an empty table gives an empty
result; columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
BLOCK_CHARS = 32 << 20
WORDS = 10_000  # pre-tokens in a row
SHIFTS, SLOTS = 1 << 15, 1 << 18
NONE = 1 << 20  # ranks are below; a pair that is no token has this or more


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _hashes(left, right):
    """Bucket and place of a pair; numpy arrays or columns."""
    a, b = left * 40_503 + right * 7, left * 2_659 + right * 30_011
    if isinstance(left, Column):
        return a.bitwiseAND(SHIFTS - 1), b
    return a & (SHIFTS - 1), b


def _merge(parts: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    while len(parts) > 1:
        ranks = [pairs.get(p, NONE) for p in zip(parts, parts[1:])]
        least = min(ranks)
        if least == NONE:
            break
        i = ranks.index(least)
        parts = [*parts[:i], least, *parts[i + 2:]]
    return parts


@lru_cache(maxsize=2)
def rank_tables(path: str = VOCABULARY) -> tuple[str, str, str, str, str]:
    """JSON of: rank of each byte; shifts and slots of the pair table;
    pieces by id; tokens out of reach of the merges (bytes -> rank).

    The pairs have a perfect hash: pair (l, r) falls into a bucket, the
    bucket's shift puts it into a slot of its own, and the slot holds l, r and
    the rank of the merged pair, 20 bits each."""
    ranks = read_ranks(path)
    pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t))
             if t[:i] in ranks and t[i:] in ranks}
    size = max(ranks.values()) + 1
    keys = np.array(list(pairs), np.int64)
    values = np.array(list(pairs.values()), np.int64)
    bucket, place = _hashes(keys[:, 0], keys[:, 1])
    if len(np.unique(bucket << 40 | place)) < len(keys):
        raise ValueError("two pairs share bucket and place: choose other factors")
    slots, shift = np.full(SLOTS, -1, np.int64), np.zeros(SHIFTS, np.int64)
    rng = np.random.default_rng(0)
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by])) + 1
    for rows in sorted(np.split(by, cuts), key=lambda x: (-len(x), int(x[0]))):
        free = np.zeros(0, int)
        while not len(free):
            tries = rng.integers(0, SLOTS, 64)
            free = np.flatnonzero((slots[(tries[:, None] + place[rows]) & (SLOTS - 1)] < 0).all(1))
        shift[bucket[rows[0]]] = at = tries[free[0]]
        slots[(at + place[rows]) & (SLOTS - 1)] = keys[rows, 0] << 40 | keys[rows, 1] << 20 | values[rows]
    slots[slots < 0] = (NONE - 1) << 40  # a left rank that does not exist
    size = max(ranks.values()) + 1
    single = [ranks[bytes([b])] for b in range(256)]
    pieces = [""] * size
    for t, r in ranks.items():
        pieces[r] = base64.b64encode(t).decode()
    apart = {" ".join(map(str, t)): r for t, r in ranks.items() if _merge([single[b] for b in t], pairs) != [r]}
    return tuple(json.dumps(x, separators=(",", ":")) for x in (single, shift.tolist(), slots.tolist(), pieces, apart))


def _key(token: bytes) -> int:
    """Bytes below a one, so that lengths differ."""
    return int.from_bytes(b"\x01" + token, "big")


@lru_cache(maxsize=2)
def cut_tables(path: str = VOCABULARY) -> dict:
    """By bytes a << 8 | b: rank of the pair, least rank of a merge that takes b
    from the left after a or a from the right before b, least rank of a pair with
    the merged two as a part. Keys of tokens of 2 to 4 bytes with their ranks, keys
    of all strings of 2 to 4 bytes inside tokens. Rank of each byte, tokens out of
    reach of the merges."""
    ranks = read_ranks(path)
    pair, left, right, after = (np.full(1 << 16, NONE, np.int64) for _ in range(4))
    inside = set()
    for t, r in ranks.items():
        for n in (2, 3, 4):
            inside.update(_key(t[i:i + n]) for i in range(len(t) - n + 1))
        for i in range(1, len(t)):
            if t[:i] not in ranks or t[i:] not in ranks:
                continue
            if len(t) == 2:
                pair[_key(t) & 0xFFFF] = r
            if len(t) - i == 1:
                left[_key(t[-2:]) & 0xFFFF] = min(left[_key(t[-2:]) & 0xFFFF], r)
            if i == 1:
                right[_key(t[:2]) & 0xFFFF] = min(right[_key(t[:2]) & 0xFFFF], r)
            for two in (t[:i], t[i:]):
                if len(two) == 2:
                    after[_key(two) & 0xFFFF] = min(after[_key(two) & 0xFFFF], r)
    short = sorted((_key(t), r) for t, r in ranks.items() if 2 <= len(t) <= 4)
    single, _, _, _, apart = rank_tables(path)
    return {"pair": pair, "left": left, "right": right, "after": after, "inside": np.array(sorted(inside), np.int64),
            "keys": np.array([k for k, _ in short], np.int64), "ranks": np.array([r for _, r in short], np.int64),
            "single": np.array(json.loads(single), np.int64),
            "apart": {bytes(map(int, t.split())): r for t, r in json.loads(apart).items()}}


def _place(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x is in sorted keys, and if it is."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def _settled(words: list[bytes], tables: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words in a row, then at each byte: is it the last of a word, the
    two from here, do they merge whatever else does."""
    by = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    last = np.zeros(len(by), bool)
    last[np.cumsum([len(w) for w in words]) - 1] = True
    two = by << 8 | np.append(by[1:], 0)
    rank, left, right = (np.where(last, NONE, tables[k][two]) for k in ("pair", "left", "right"))
    return by, last, two, (rank < NONE) & (rank < np.append(NONE, left[:-1])) & (rank < np.append(right[1:], NONE))


def _cuts(words: list[bytes], tables: dict) -> tuple[list[bytes], np.ndarray]:
    """Segments of all words in a row, and how many each word has."""
    if tables["apart"]:  # those are matched as whole pre-tokens only
        return words, np.ones(len(words), np.int32)
    by, last, two, safe = _settled(words, tables)
    before, behind = np.append(False, safe[:-1]), np.append(safe[1:], False)
    key = np.where(before, np.append(0, by[:-1]) << 16 | two, two)
    key = np.where(behind, key << 8 | np.append(by[2:], [0, 0])[:len(by)], key) | 1 << (16 + 8 * before + 8 * behind)
    cut = last | ~(safe | _place(tables["inside"], key)[1])
    ends = np.flatnonzero(cut) + 1
    data, stops = by.astype(np.uint8).tobytes(), ends.tolist()
    return ([data[i:j] for i, j in zip([0, *stops[:-1]], stops)],
            np.diff(np.searchsorted(ends, np.cumsum([len(w) for w in words]), "right"), prepend=0).astype(np.int32))


def _parts(segments: list[bytes], tables: dict) -> pa.ListArray:
    """Per segment its parts, a byte or two settled ones, each below the rank of the
    pair that it begins (NONE if that is no token or there is none)."""
    by, last, two, safe = _settled(segments, tables)
    pair = safe & (tables["pair"][two] < tables["after"][two])
    first = ~np.append(False, pair[:-1])
    key = np.where(pair, two | 1 << 16, by | 1 << 8)[first]
    part = np.where(pair, tables["pair"][two], tables["single"][by])[first]
    ends = np.cumsum(first)[np.cumsum([len(w) for w in segments]) - 1]
    wide = np.append(pair[first][1:], False)
    nxt = np.append(key[1:], 0)
    at, known = _place(tables["keys"], np.where(wide, key << 16 | nxt & 0xFFFF, key << 8 | nxt & 0xFF))
    known[ends - 1] = False
    rank = np.full(len(part), NONE, np.int64)
    rank[known] = tables["ranks"][at[known]]
    packed, starts = rank << 40 | part, np.append(0, ends)
    if tables["apart"]:
        whole = [tables["apart"].get(w) for w in segments]
        rows = [packed[i:j] if r is None else np.array([NONE << 40 | r]) for i, j, r in zip(starts, ends, whole)]
        packed, starts = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(packed, pa.int64()))


def _literal(text: str, kind: str) -> Column:
    """A constant of any shape; the optimizer folds it once."""
    return F.from_json(F.lit(text), kind)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def encoder(path: str = VOCABULARY):
    """Column function: array<bigint> of parts (``_parts``) -> array<bigint> of ids."""
    _, shifts, slots, _, _ = rank_tables(path)
    shift, slot = _literal(shifts, "array<bigint>"), _literal(slots, "array<bigint>")
    empty = F.array().cast("array<bigint>")
    last = NONE << 40

    def part(x: Column) -> Column:
        return x.bitwiseAND(NONE - 1)

    def packed(left: Column, right: Column) -> Column:
        """A part with the rank of its pair 40 bits above it: NONE if the pair is
        no token, which shows as a slot that holds another pair."""
        bucket, place = _hashes(left, right)
        at = (shift[bucket.cast("int")] + place).bitwiseAND(SLOTS - 1).cast("int")
        rank = slot[at].bitwiseXOR(F.shiftleft(F.shiftleft(left, 20).bitwiseOR(right), 20))
        return F.shiftleft(F.least(rank, F.lit(NONE).cast("bigint")), 40).bitwiseOR(left)

    def step(a: Column) -> Column:
        def at(k: Column) -> Column:
            i, m = k.bitwiseAND((1 << 40) - 1).cast("int"), F.shiftright(k, 40)
            left = F.when(i > 0, F.array(packed(part(a[i - 1]), m))).otherwise(empty)
            new = F.when(i + 2 < F.size(a), packed(m, part(a[i + 2]))).otherwise(m.bitwiseOR(last))
            return F.when(k < last, F.flatten(F.array(F.slice(a, F.lit(1), F.greatest(i - 1, F.lit(0))), left, F.array(new),
                                                      F.slice(a, i + 3, F.lit(NONE))))).otherwise(a)

        # the least rank with its place: array_position leaves its loop by an exception
        return _let(F.array_min(F.transform(a, lambda x, i: x.bitwiseAND(-1 << 40).bitwiseOR(i.cast("bigint")))), at)

    def encode(parts: Column) -> Column:
        return F.when(F.size(parts) < 2, F.transform(parts, part)).otherwise(F.aggregate(
            F.sequence(F.lit(2), F.size(parts)), parts, lambda a, _: step(a), lambda a: F.transform(a, part)))

    return encode


def decoder(path: str = VOCABULARY):
    """Column function: array<bigint> of ids -> binary, the pieces in a row."""
    pieces = _literal(json.dumps([base64.b64decode(x).hex() for x in json.loads(rank_tables(path)[3])]), "array<string>")
    return lambda ids: F.unhex(F.array_join(F.transform(ids, lambda i: pieces[i.cast("int")]), ""))


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _split(docs: DataFrame, id_col: str, text_col: str, path: str, block_chars: int) -> DataFrame:
    """Per block: rows of at most ``WORDS`` distinct segments as parts, then one
    row of documents: ids, starts and uses (numbers of pre-tokens), and for each
    pre-token how many segments it has and their numbers, all little-endian."""
    kind = docs.schema[id_col].dataType.simpleString()
    tables = cut_tables(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(public_tokenizers.PATTERN).findall
        names = ["ids", "starts", "uses", "counts", "segments", "words"]
        id_type = None
        ids, starts, uses, words, chars = [], [0], [], _Numbers(), 0

        def rows():
            known, own, counts, segments = list(words), _Numbers(), [], []
            for lo in range(0, len(known), WORDS):
                cut, n = _cuts([w.encode() for w in known[lo:lo + WORDS]], tables)
                counts.append(n.astype("<i4").tobytes())
                segments.append(np.fromiter(map(own.__getitem__, cut), "<i4", len(cut)).tobytes())
            known = list(own)
            for lo in range(0, len(known), WORDS):
                parts = _parts(known[lo:lo + WORDS], tables)
                part = pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts)
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.list_(id_type)), *[pa.array([None], pa.binary())] * 4, part], names=names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(id_type)), *(pa.array([x], pa.binary()) for x in (
                    np.asarray(starts, "<i8").tobytes(), b"".join(uses), b"".join(counts), b"".join(segments))),
                 pa.array([None], pa.list_(pa.list_(pa.int64())))], names=names)

        for b in batches:
            id_type = b.column(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                used = np.fromiter(map(words.__getitem__, find(text or "")), "<i4")
                ids.append(i)
                uses.append(used.tobytes())
                starts.append(starts[-1] + len(used))
                chars += len(text or "")
                if chars >= block_chars:
                    yield from rows()
                    ids, starts, uses, words, chars = [], [0], [], _Numbers(), 0
        if ids:
            yield from rows()

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"ids array<{kind}>, starts binary, uses binary, counts binary, segments binary, words array<array<bigint>>"))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY,
                     block_chars: int = BLOCK_CHARS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked."""
    kind = docs.schema[id_col].dataType.simpleString()
    encode, decode = encoder(path), decoder(path)

    def word(w: Column) -> Column:
        return _let(encode(w), lambda c: F.struct(F.array_join(c.cast("array<string>"), " ").alias("text"),
                                                  F.size(c).alias("n"), decode(c).alias("decoded")))

    coded = _split(docs, id_col, text_col, path, block_chars).select(
        "ids", "starts", "uses", "counts", "segments", F.transform("words", word).alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, counts, parts = [], [], []  # of the block's segments so far; rows come in their order
        for b in batches:
            for k in range(b.num_rows):
                if b.column(0)[k].as_py() is None:
                    codes = b.column(5).slice(k, 1).flatten()
                    texts += [x.encode() for x in codes.field("text").to_pylist()]
                    counts.append(codes.field("n").to_numpy(zero_copy_only=False))
                    parts += codes.field("decoded").to_pylist()
                    continue
                ids = b.column(0).slice(k, 1).flatten()
                starts = np.frombuffer(b.column(1)[k].as_py(), "<i8")
                uses = np.frombuffer(b.column(2)[k].as_py(), "<i4")
                own = np.frombuffer(b.column(4)[k].as_py(), "<i4")
                ends = np.cumsum(np.frombuffer(b.column(3)[k].as_py(), "<i4"), dtype=np.int64)
                size = np.concatenate([np.zeros(0, np.int64), *counts])[own]
                size = np.diff(np.append(0, np.cumsum(size, dtype=np.int64))[ends], prepend=0)
                cuts, own = [0, *ends.tolist()], own.tolist()
                # from here of the block's words
                texts, parts = ([glue.join([x[j] for j in own[lo:hi]]) for lo, hi in zip(cuts, cuts[1:])]
                                for glue, x in ((b" ", texts), (b"", parts)))
                for lo in range(0, len(ids), 1000):
                    hi = min(lo + 1000, len(ids))
                    n, coded_sha, decoded_sha, all_ids = [], [], [], []
                    for i in range(lo, hi):
                        use = uses[starts[i]:starts[i + 1]]
                        own = use.tolist()
                        n.append(int(size[use].sum()))
                        text = b" ".join(map(texts.__getitem__, own))
                        coded_sha.append(hashlib.sha256(text).hexdigest())
                        decoded_sha.append(hashlib.sha256(b"".join(map(parts.__getitem__, own))).hexdigest())
                        all_ids.append([int(x) for x in text.split()] if with_ids else None)
                    cols = [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(coded_sha, pa.string()),
                            pa.array(decoded_sha, pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        cols, names = [*cols, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                texts, counts, parts = [], [], []

    return coded.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                            + (", ids array<int>" if with_ids else ""))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
