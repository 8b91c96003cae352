"""Chat formatting: transcripts are parsed by a hidden Markov model.

A line is emitted by one of six states, a role at the first line of a turn or
inside it. What is observed of a line is its speaker marker (system, user,
assistant or none, over common marker styles) and line features: does it end
with a question mark, how long is it, is it blank. Transitions and emissions
are smoothed counts over labelled conversations; Spark adds them up, so the
driver gets a table of fixed size. Viterbi decoding then recovers the roles
of each transcript, also of turns without a marker, and the turns are rendered
in one canonical form with markers stripped.

Parsing is a narrow map: conversations may be dealt in any way. A transcript
is one row; its turns are gathered by conversation, as they make one text.

Defined cases: null or empty transcripts have no turns and render as the empty
string; unknown or null roles count as user when counts are made; turns are in
order of turn number, then of text; repeated rows stay repeated turns; rows
with a null conversation id form one conversation. Other columns are not read.
An empty table gives an empty result; without labelled rows all counts are the
smoothing alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role * 2, + 1 inside a turn
#: Speaker names in use for each role.
NAMES = {"system": ("system", "instruction", "context"), "user": ("user", "human", "customer", "q"),
         "assistant": ("assistant", "ai", "bot", "agent", "a")}
_ROLE_OF = {n: r for r, ns in enumerate(NAMES.values()) for n in ns}
_MARK = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|\[|<\|?)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True))
                   + r")(?:\*\*:?|\]:?|\|?>|:)\s*", re.IGNORECASE)
FEATURES = 2 * 3 * 2  # question, length class, blank
SMOOTH = 0.5


def observe(line: str) -> tuple[int, int, str]:
    """Marker class (0 none, 1 + role), feature class, line without marker."""
    m = _MARK.match(line)
    mark = 1 + _ROLE_OF[m[1].lower()] if m else 0
    rest = line[m.end():] if m else line
    n = len(rest)
    return mark, (rest.rstrip().endswith("?") * 3 + (n >= 60) + (n >= 200)) * 2 + (not rest.strip()), rest


def _lines(text: str) -> list[str]:
    return text.split("\n")


class Model:
    """Log-probabilities from counts (table, row, column, n)."""

    def __init__(self, counts: list[tuple[str, int, int, int]]):
        shape = {"first": (1, STATES), "next": (STATES, STATES), "mark": (STATES, 1 + len(ROLES)), "feat": (STATES, FEATURES)}
        self.log = {}
        for name, (rows, cols) in shape.items():
            n = np.full((rows, cols), SMOOTH)
            for kind, i, j, c in counts:
                if kind == name:
                    n[i, j] += c
            if name == "first":
                n[0, 1::2] = 1e-9          # a transcript begins with a turn
            if name == "next":
                for s in range(STATES):    # the inside of a turn follows its own role only
                    for t in range(1, STATES, 2):
                        if t // 2 != s // 2:
                            n[s, t] = 1e-9
            if name == "mark":
                for s in range(1, STATES, 2):
                    n[s, 1:] *= 0.1
            self.log[name] = np.log(n / n.sum(1, keepdims=True))

    def viterbi(self, seen: list[tuple[int, int]]) -> list[int]:
        log = self.log
        best = log["first"][0] + log["mark"][:, seen[0][0]] + log["feat"][:, seen[0][1]]
        back = []
        for mark, feat in seen[1:]:
            via = best[:, None] + log["next"]
            back.append(via.argmax(0))
            best = via.max(0) + log["mark"][:, mark] + log["feat"][:, feat]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def parse(self, text: str | None) -> tuple[list[str], list[str], list[str]]:
        """Role of every line; role and text of every turn."""
        if not text:
            return [], [], []
        seen = [observe(x) for x in _lines(text)]
        path = self.viterbi([(m, f) for m, f, _ in seen])
        roles: list[str] = []
        turns: list[list[str]] = []
        for state, (_, _, rest) in zip(path, seen):
            if state % 2 == 0:
                roles.append(ROLES[state // 2])
                turns.append([rest])
            else:
                turns[-1].append(rest)
        return [ROLES[s // 2] for s in path], roles, ["\n".join(t) for t in turns]


def render(roles: list[str], texts: list[str]) -> str:
    """Canonical turns."""
    return "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in zip(roles, texts))


def fit(labelled: DataFrame) -> Model:
    """``labelled``: transcript string, line_roles array<string> (null or
    missing roles: user), line_starts array<boolean>."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {"first": np.zeros((1, STATES), np.int64), "next": np.zeros((STATES, STATES), np.int64),
                  "mark": np.zeros((STATES, 1 + len(ROLES)), np.int64), "feat": np.zeros((STATES, FEATURES), np.int64)}
        for b in batches:
            for text, roles, starts in zip(*(b.column(c).to_pylist() for c in range(3))):
                last = None
                for line, role, begin in zip(_lines(text or ""), roles or [], starts or []):
                    s = 2 * (ROLES.index(role) if role in ROLES else 1) + (not begin)
                    mark, feat, _ = observe(line)
                    tables["first" if last is None else "next"][last or 0, s] += 1
                    tables["mark"][s, mark] += 1
                    tables["feat"][s, feat] += 1
                    last = s
        rows = [(k, int(i), int(j), int(t[i, j])) for k, t in tables.items() for i, j in zip(*np.nonzero(t))]
        cols = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                                         names=["kind", "i", "j", "n"])

    counts = (labelled.select("transcript", "line_roles", "line_starts").mapInArrow(run, "kind string, i long, j long, n long")
              .groupBy("kind", "i", "j").agg(F.sum("n").alias("n")).collect())
    return Model([tuple(r) for r in counts])


def format_chats(transcripts: DataFrame, model: Model, id_col: str = "conv_id", text_col: str = "transcript") -> DataFrame:
    """conv_id, n_turns, line_roles, turn_roles, turn_texts, rendered."""
    kind = transcripts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.parse(t) for t in b.column(1).to_pylist()]
            text = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(r) for _, r, _ in got], pa.int64()), pa.array([x for x, _, _ in got], text),
                 pa.array([r for _, r, _ in got], text), pa.array([t for _, _, t in got], text),
                 pa.array([render(r, t) for _, r, t in got], pa.string())],
                names=["conv_id", "n_turns", "line_roles", "turn_roles", "turn_texts", "rendered"])

    return transcripts.select(F.col(id_col).alias("conv_id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"conv_id {kind}, n_turns long, line_roles array<string>, turn_roles array<string>, "
             "turn_texts array<string>, rendered string")


def _marker(role: Column, style: Column) -> Column:
    name = F.when(role == "system", F.lit("System")).when(role == "assistant", F.lit("Assistant")).otherwise(F.lit("User"))
    other = F.when(role == "system", F.lit("Context")).when(role == "assistant", F.lit("AI")).otherwise(F.lit("Human"))
    return (F.when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), other, F.lit(": ")))
            .when(style == 2, F.concat(F.lit("["), name, F.lit("] "))).otherwise(F.concat(F.lit("**"), other, F.lit("**: "))))


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, transcript, line_roles, line_starts from conversation turns.
    The marker style changes by conversation; a fifth of later turns lack one."""
    style = F.pmod(F.xxhash64(F.coalesce("conv_id", F.lit(-1))), F.lit(4))
    bare = (F.pmod(F.xxhash64("conv_id", "turn", F.lit(1)), F.lit(5)) == 0) & (F.col("turn") > 0)
    text = F.coalesce("text", F.lit(""))
    n = F.size(F.split(text, "\n"))
    turns = conversations.select("conv_id", F.struct(
        "turn", F.concat(F.when(bare, F.lit("")).otherwise(_marker(F.col("role"), style)), text).alias("text"),
        F.array_repeat(F.coalesce("role", F.lit("user")), n).alias("roles"),
        F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), n - 1)).alias("starts")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select(
        "conv_id", F.array_join(F.transform("ts", lambda t: t["text"]), "\n").alias("transcript"),
        F.flatten(F.transform("ts", lambda t: t["roles"])).alias("line_roles"),
        F.flatten(F.transform("ts", lambda t: t["starts"])).alias("line_starts"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts come from four fifths of the conversations (by a hash of the
    id); all transcripts are parsed. line_roles_right is against the table."""
    told = stored(transcripts(table(spark, sf_dir, "conversations")), "transcripts")
    model = fit(told.where(~held_out_of(F.col("conv_id"))))
    truth = told.select(F.col("conv_id").alias("told_id"), F.col("line_roles").alias("truth"))
    right = F.filter(F.zip_with("line_roles", "truth", lambda a, b: a == b), lambda same: same)
    return (format_chats(told, model).join(truth, F.col("conv_id").eqNullSafe(F.col("told_id")))
            .select("conv_id", held_out_of(F.col("conv_id")).alias("held_out"), "n_turns",
                    F.size("line_roles").cast("long").alias("n_lines"),
                    F.size(right).cast("long").alias("line_roles_right"), "turn_roles", "rendered"))


def held_out_of(conv: Column) -> Column:
    return F.pmod(F.xxhash64(conv, F.lit(9)), F.lit(5)) == 0
