"""Edit-aware token counts: a segment tree over each document's pre-tokens.

A text is cut into leaves of about ``LEAF`` characters, only where a single
space stands between two characters that are no white space: the public
pattern never matches across such a place, so counts of leaves add up. The
tree holds sums of tokens and characters. An edit finds its leaves by the sums,
takes in neighbours while the place between them is no longer a safe one
(boundary context), re-encodes the new text of those leaves alone and updates
the sums on their paths.

A narrow map; a document's edits travel with it as an array, so nothing is
shuffled. Memory is bounded by one document.

Defined cases: null text counts as empty; null edits as none; null insertions
as empty; starts and lengths outside the text are clipped to it (null: 0);
edits apply in array order, each to the text that the earlier ones left.
Null ids and repeated rows are counted each. Columns other than id, text and
edits are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCABULARY, read_ranks
from .common import table

LEAF = 256
_CUT = re.compile(r"[\s\S]{%d,}?(?<=\S)(?= \S)|[\s\S]+" % LEAF)
_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        _ENCODINGS[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path),
                                             special_tokens={})
    return _ENCODINGS[path]


def _safe(left: str, right: str) -> bool:
    """Whether the pattern surely breaks between two stretches of text."""
    return bool(left) and len(right) > 1 and not left[-1].isspace() and right[0] == " " and not right[1].isspace()


class TokenTree:
    """Token and character sums over the leaves of one text."""

    def __init__(self, text: str, path: str = VOCABULARY):
        self.encoding = _encoding(path)
        self.leaves = _CUT.findall(text) or [""]
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.leaves += [""] * (self.size - len(self.leaves))
        self.tokens = [0] * (2 * self.size)
        self.chars = [0] * (2 * self.size)
        self.encoded = 0
        for i, leaf in enumerate(self.leaves):
            self._count(i, leaf)
        for i in range(self.size - 1, 0, -1):
            self._add(i)
        self.built = self.encoded

    def _count(self, i: int, leaf: str) -> None:
        self.leaves[i] = leaf
        self.tokens[self.size + i] = len(self.encoding.encode_ordinary(leaf)) if leaf else 0
        self.chars[self.size + i] = len(leaf)
        self.encoded += len(leaf)

    def _add(self, i: int) -> None:
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def _leaf_at(self, pos: int) -> tuple[int, int]:
        """Leaf that holds character ``pos`` (the last filled one for the end)
        and the number of characters before it."""
        i, before = 1, 0
        pos = min(pos, self.chars[1] - 1)
        while i < self.size:
            i *= 2
            if pos >= before + self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace ``length`` characters from ``start`` by ``insert``."""
        n = self.chars[1]
        start = max(0, min(start, n))
        end = max(start, min(start + length, n))
        if n == 0:
            lo, hi, before = 0, 0, 0
        else:
            lo, before = self._leaf_at(start)
            hi, _ = self._leaf_at(max(start, end - 1))
        text = "".join(self.leaves[lo:hi + 1])
        text = text[:start - before] + insert + text[end - before:]
        left, right = lo - 1, hi + 1
        while True:  # boundary context
            while left >= 0 and not self.leaves[left]:
                left -= 1
            if left < 0 or _safe(self.leaves[left], text):
                break
            text, lo, left = self.leaves[left] + text, left, left - 1
        while True:
            while right < self.size and not self.leaves[right]:
                right += 1
            if right >= self.size or _safe(text, self.leaves[right]):
                break
            text, hi, right = text + self.leaves[right], right, right + 1
        new = _CUT.findall(text)
        room = hi - lo + 1
        if len(new) > room:
            new = [*new[:room - 1], "".join(new[room - 1:])]
        new += [""] * (room - len(new))
        for i, leaf in enumerate(new, lo):
            if leaf != self.leaves[i]:
                self._count(i, leaf)
        a, b = (self.size + lo) // 2, (self.size + hi) // 2
        while a:
            for i in range(a, b + 1):
                self._add(i)
            a, b = a // 2, b // 2

    @property
    def text(self) -> str:
        return "".join(self.leaves)


def edit_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits",
                path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, chars_encoded (by the edits), and
    chars_edited. ``edits``: array<struct<start, length, insert>>."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, edits in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                tree = TokenTree(text or "", path)
                before = tree.tokens[1]
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "")
                out.append((before, tree.tokens[1], tree.encoded - tree.built, tree.chars[1]))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols]],
                                             names=["doc_id", "n_tokens", "n_tokens_edited", "chars_encoded", "chars_edited"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.col(edits_col).alias("e")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_tokens_edited long, chars_encoded long, chars_edited long")


def sample_edits(docs: DataFrame) -> DataFrame:
    """Three edits a document, derived from its text: at each quarter some
    characters are replaced by the text's first ones."""
    text, n = F.coalesce("text", F.lit("")), F.char_length(F.coalesce("text", F.lit("")))
    return docs.withColumn("edits", F.array(*[F.struct(
        F.floor(n * k / 4).cast("int").alias("start"), F.lit(7 * k).alias("length"),
        F.substring(text, F.lit(1), F.lit(11 * k)).alias("insert")) for k in (1, 2, 3)]))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts(sample_edits(table(spark, sf_dir, "documents").select("doc_id", "text")))
