"""Quality rules as a short-circuit cascade.

A rule rejects a document by a few of its measures; a document is kept if no rule
rejects it. What the rules cost and reject is estimated on a sample: each
measure is timed by itself, and each rule is put to every document of the sample.
The cascade is then built greedily: next comes the rule that rejects most of what
the rules before it leave, for the time of the measures that none of them has taken
(rules share measures, so what a rule costs depends on its place). Documents go
through the rules in that order up to the first that rejects them; measures are
taken when a rule first asks for them. The sample decides on the order alone,
and so on the time: which documents are kept is the same in any order.

One map over the documents does it all, nothing is shuffled but the sample's
counts, a row for each set of rules that reject together.

Measures (all of the UTF-8 text; words are [^\\x20\\x09-\\x0D]+, lines are what
\\n parts, with a word): n_words; word_chars, code points in words; n_symbols,
characters of [#*$%&|<>]; n_lines; n_dup_lines, lines equal to an earlier one;
n_repeat_words, words in windows of three words that occur twice or more;
n_letter_words, words with a letter (A-Z, a-z or beyond ASCII); n_capitals and
n_letters, of A-Z and of A-Z and a-z; n_ellipsis_lines, lines that end with ... or
the ellipsis; n_bullet_lines, lines that begin with a bullet; top_pair, how often
the commonest two words follow each other.

Defined results: a null text is an empty one, which has no words; repeated rows are
judged alike; no rows give no rows. The caller's columns are passed on inside a
struct, so their names can't clash.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property
from time import thread_time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import as_binary, sampled

CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
WHITE = b"\t\n\v\f\r "
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
NO_LETTER = bytes(b for b in range(0x80) if b not in LETTERS + WHITE)
ELLIPSES = (b"...", "…".encode())
BULLETS = tuple(c.encode() for c in "-*•‣▪◦–")


class Measures:
    """Measures of one text, each taken when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def ids(self) -> np.ndarray:
        number = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        return np.fromiter(map(number.__getitem__, self.words), np.int64, len(self.words))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, WHITE + CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        ids = self.ids
        if len(ids) < 4:
            return 0
        pairs = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
        # Numbers of pairs, so that the number of three words always fits.
        pairs = np.unique(pairs, return_inverse=True)[1] if len(ids) > 1 << 20 else pairs
        windows = pairs[:-1] * (int(ids.max()) + 1) + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        often = np.zeros(len(windows), bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        within = np.zeros(len(ids), bool)
        for k in range(3):
            within[k : len(windows) + k] |= often
        return int(within.sum())

    @cached_property
    def n_letter_words(self) -> int:
        return len(self.raw.translate(None, NO_LETTER).split())

    @cached_property
    def n_capitals(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, CAPITALS))

    @cached_property
    def n_letters(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, LETTERS))

    @cached_property
    def n_ellipsis_lines(self) -> int:
        return sum(x.rstrip().endswith(ELLIPSES) for x in self.lines)

    @cached_property
    def n_bullet_lines(self) -> int:
        return sum(x.lstrip().startswith(BULLETS) for x in self.lines)

    @cached_property
    def top_pair(self) -> int:
        ids = self.ids
        if len(ids) < 2:
            return 0
        return int(np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_counts=True)[1].max())


#: What a measure needs beside the text: it is timed without them, and they are timed by themselves.
NEEDS = {
    "n_words": ("words",), "ids": ("words",), "n_lines": ("lines",), "n_dup_lines": ("lines",), "n_repeat_words": ("ids", "words"), "n_ellipsis_lines": ("lines",),
    "n_bullet_lines": ("lines",), "top_pair": ("ids", "words"),
}


@dataclass(frozen=True)
class Rule:
    """A name, the measures it looks at, and when it rejects."""

    name: str
    uses: tuple[str, ...]
    rejects: Callable[..., bool]

    def says(self, m: Measures) -> bool:
        return self.rejects(*[getattr(m, x) for x in self.uses])

    def parts(self) -> list[str]:
        """All that is computed for it."""
        return list(dict.fromkeys(p for x in self.uses for p in (*NEEDS.get(x, ()), x)))


RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: c < 3 * n or c > 10 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("letters", ("n_letter_words", "n_words"), lambda k, n: 5 * k < 4 * n),
    Rule("dup_lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 3 * n),
    Rule("capitals", ("n_capitals", "n_letters"), lambda c, n: 2 * c > n),
    Rule("ellipses", ("n_ellipsis_lines", "n_lines"), lambda e, n: 10 * e > 3 * n),
    Rule("bullets", ("n_bullet_lines", "n_lines"), lambda b, n: 10 * b > 9 * n),
    Rule("top_pair", ("top_pair", "n_words"), lambda t, n: 10 * t > n),
)


@dataclass(frozen=True)
class Estimate:
    """What a sample says: rows, seconds a row of each part, and how many rows each set of rules rejects together."""

    rows: int
    seconds: dict[str, float]
    rejected: dict[frozenset[str], int]


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", id_col: str = "doc_id", rows: int = 2000) -> Estimate:
    """Measures cost and selectivity on about so many rows, at most twice as many, taken by a hash of the id."""
    parts = list(dict.fromkeys(p for r in rules for p in r.parts()))
    only = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    sample = sampled(only, docs.count(), rows, "id").select("text")

    def put(batches):
        for batch in batches:
            said, spent = [], []
            for raw in as_binary(batch.column(0)):
                m, took = Measures(raw.as_py()), []
                for p in parts:  # what a part needs comes before it
                    began = thread_time()
                    getattr(m, p)
                    took.append(thread_time() - began)
                spent.append(took)
                said.append(",".join(r.name for r in rules if r.says(m)))
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string()), pa.array(spent, pa.list_(pa.float64()))], ["said", "spent"])

    found = sample.mapInArrow(put, "said string, spent array<double>").groupBy("said").agg(F.count("*").alias("n"), *[F.sum(F.col("spent")[i]).alias(f"s{i}") for i in range(len(parts))]).collect()
    n = sum(r["n"] for r in found)
    return Estimate(n, {p: sum(r[f"s{i}"] for r in found) / n if n else 0.0 for i, p in enumerate(parts)}, {frozenset(filter(None, r["said"].split(","))): r["n"] for r in found})


def cascade(rules: Sequence[Rule], e: Estimate, given: Sequence[str] = ()) -> list[Rule]:
    """The rules in the order of what they reject of what is left for what they cost there; of parts ``given`` are there anyway."""
    have, left, out = {p for x in given for p in (*NEEDS.get(x, ()), x)}, list(rules), []
    alive = dict(e.rejected)
    while left:
        def worth(r: Rule):
            cost = sum(e.seconds.get(p, 0.0) for p in r.parts() if p not in have)
            gone = sum(n for said, n in alive.items() if r.name in said)
            return (gone / (cost + 1e-9), -cost, r.name)

        best = max(left, key=worth)
        out.append(best)
        left.remove(best)
        have |= set(best.parts())
        alive = {said: n for said, n in alive.items() if best.name not in said}
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, measures: Sequence[str] = (), text_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The columns of keep, the measures asked for, and rejected_by: the first rule of the cascade that rejects the document,
    null if none does. Which rule that is of several depends on their order; whether there is one does not."""
    order = cascade(rules, estimate(docs, rules, text_col, id_col, sample_rows), measures)
    kept = list(docs.columns if keep is None else keep)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.struct(F.lit(0)).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def put(batches):
        for batch in batches:
            said, taken = [], []
            for raw in as_binary(batch.column(1)):
                m = Measures(raw.as_py())
                taken.append([getattr(m, x) for x in measures])
                said.append(next((r.name for r in order if r.says(m)), None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([t[i] for t in taken], pa.int64()) for i in range(len(measures))), pa.array(said, pa.string())], ["row", *measures, "rejected_by"])

    out = StructType([rows.schema["row"], *[StructField(x, LongType()) for x in measures], StructField("rejected_by", StringType())])
    return rows.mapInArrow(put, out).select(*[F.col("row")[c].alias(c) for c in kept], *[f"`{x}`" for x in measures], "rejected_by")
