"""Quality rules with risk-controlled thresholds.

Each rule is a share computed from a whole text; a document is rejected if a
rule's value exceeds its cutoff. Cutoffs come from labelled documents, per stratum
(language), as a plan: a cutoff of a fixed grid for each of some rules. A plan is
certified by an exact binomial (Clopper-Pearson) upper bound on the share of good
documents that any of its rules rejects. Plans are tested along fixed sequences,
from the most lenient grid point to stricter ones up to the first that fails, so
that the grid costs no confidence. The sequences of a stratum share its part of
``delta``, as all strata do: half for all rules with one cutoff, a quarter for the
smaller sets of rules with one cutoff (a rule that good documents often break
holds up only the sets it is in), a quarter for each rule alone at ``alpha /
rules``, whose cutoffs may differ and go together by a union bound. So with
probability 1 - ``delta`` the rules reject at most the share ``alpha`` of any
stratum's good documents. Of the certified plans the one with the most labelled
rejects beyond its false ones is taken, and the most lenient of equals. Where
nothing can be certified no rule applies.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm import text as T
from convlake.llm.frames import record, stored

WINDOW = 8
SYMBOLS = T.byte_table(b"#*$%&|<>")
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ALPHA = 0.05
DELTA = 0.05
GRID = tuple(round(0.05 * k, 2) for k in range(1, 13))
#: Rule name -> SQL of its value, in [0, 1] or null where it does not apply.
RULES = {
    "symbols": "n_symbols / nullif(word_chars, 0)",
    "dup_lines": "n_dup_lines / nullif(n_lines, 0)",
    "repeats": "n_repeat_words / nullif(n_words, 0)",
    "capitals": "n_capitals / nullif(word_chars, 0)",
    "marked_words": "n_marked / nullif(n_words, 0)",
}

_U = np.uint64
_UPPER = T.byte_table(bytes(range(65, 91)))
_LETTER = T.byte_table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_MORE = ("n_lines", "n_capitals", "n_marked")


def repeated_words(h: np.ndarray, woff: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Words of each row inside a ``size``-word window found twice in the row."""
    starts, off = T.windows(woff, size)
    if not len(starts):
        return np.zeros(len(woff) - 1, np.int64)
    own = T.mix(T.combine(h, starts, size) + T.mix(T.row_of(off).astype(np.uint64)))
    ordered = np.sort(own)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(woff) - 1, np.int64)
    at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
    return T.per_row(T.covered(starts[twice[at] == own], size, len(h)), woff)


def text_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` and further ones for every row."""
    starts, ends, woff = T.words(data, off)
    sums = T.Spans(data)
    h = sums.hash(starts, ends)
    word = T.NOT_SPACE[data]
    # lines: between \n bytes inside each row
    newline = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([off[:-1], newline + 1]))
    finish = np.sort(np.concatenate([newline, off[1:]]))
    loff = np.searchsorted(newline, off) + np.arange(len(off))
    words_to = np.concatenate([[0], np.cumsum(word, dtype=np.int64)])
    has_word = words_to[finish] > words_to[begin]
    row = T.row_of(loff)
    line = T.mix(sums.hash(begin, finish) + T.mix((finish - begin).astype(np.uint64)) + T.mix(row.astype(np.uint64) ^ _U(0x5555)))
    kept = np.flatnonzero(has_word)
    order = kept[np.argsort(line[kept], kind="stable")]
    again = np.zeros(len(begin), bool)
    again[order[1:]] = line[order[1:]] == line[order[:-1]]
    letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    marks = np.concatenate([[0], np.cumsum(SYMBOLS[data] | (data == 33), dtype=np.int64)])
    marked = (marks[ends] - marks[starts] > 0) | (letters[ends] == letters[starts])
    return {
        "n_words": np.diff(woff),
        "word_chars": T.per_row(word & ((data & 0xC0) != 0x80), off),
        "n_symbols": T.per_row(SYMBOLS[data], off),
        "n_dup_lines": T.per_row(again, loff),
        "n_repeat_words": repeated_words(h, woff),
        "n_lines": T.per_row(has_word, loff),
        "n_capitals": T.per_row(_UPPER[data], off),
        "n_marked": T.per_row(marked, woff),
    }


def _with_counts(names: list[str], text_col: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in T.slices(T.column(batch, text_col)):
                counts = text_counts(data, off)
                part = batch.slice(lo, hi - lo)
                yield record(schema, *(part.column(n) for n in names), *(counts[c] for c in COUNTS + _MORE))
    return run


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts of each row's text (null: empty)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    names = list(dict.fromkeys([*keep, text_col]))
    base = docs.select(*names)
    fields = [base.schema[k] for k in keep] + [StructField(c, LongType()) for c in COUNTS + _MORE]
    schema = StructType(fields)
    return base.mapInArrow(_with_counts(keep, text_col, to_arrow_schema(schema)), schema)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(at most k of n) by summed logs, exact to rounding."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    i = np.arange(k + 1)
    logs = (math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i])
            + i * math.log(p) + (n - i) * math.log1p(-p))
    return min(1.0, float(np.exp(logs).sum()))


def certified(k: int, n: int, limit: float, level: float) -> bool:
    """True if the exact upper confidence bound at ``level`` for a rate seen k
    times in n is at most ``limit``; equivalently P(at most k of n | limit) <= level."""
    return n > 0 and k < limit * n and binomial_cdf(k, n, limit) <= level


def strictest(over: np.ndarray, n: int, limit: float, level: float) -> int:
    """The last certified point of the sequence from the end of the grid to its
    start, ``over`` good values of n being above each; the grid's length if none."""
    at = len(over)
    while at and certified(int(over[at - 1]), n, limit, level):
        at -= 1
    return at


def plan(steps: np.ndarray, counts: np.ndarray, good: np.ndarray, alpha: float, level: float) -> dict[int, int]:
    """Rule number -> grid point of the best certified plan of a stratum, empty if
    none. ``steps`` has for every row and rule how many grid points the value
    exceeds, ``counts`` how many labelled documents are like the row."""
    n, points, rules = int(counts[good].sum()), len(GRID), range(len(RULES))

    def rejects(highest: np.ndarray, which: np.ndarray) -> np.ndarray:
        seen = np.bincount(highest[which], counts[which], points + 1)
        return np.rint(seen[::-1].cumsum()[::-1][1:]).astype(np.int64)

    found: list[tuple[int, float, dict[int, int]]] = []
    sets = [s for k in rules for s in itertools.combinations(rules, k + 1)]
    for s in sets:
        highest = steps[:, s].max(axis=1)
        false = rejects(highest, good)
        gain = rejects(highest, ~good) - false
        share = level / 2 if len(s) == len(rules) else level / 4 / (len(sets) - 1)
        found += [(int(gain[i]), GRID[i], dict.fromkeys(s, i)) for i in range(strictest(false, n, alpha, share), points)]
    own = {}
    for r in rules:
        false = rejects(steps[:, r], good)
        gain = rejects(steps[:, r], ~good) - false
        ends = [(int(gain[i]), i) for i in range(strictest(false, n, alpha / len(rules), level / 4 / len(rules)), points)]
        if ends and max(ends)[0] > 0:
            own[r] = max(ends)[1]
    if own:
        hit = np.any([steps[:, r] > i for r, i in own.items()], axis=0)
        found.append((int(counts[hit & ~good].sum() - counts[hit & good].sum()), min(GRID[i] for i in own.values()), own))
    best = max(found, key=lambda f: (f[0], f[1], -len(f[2])), default=(0, 0.0, {}))
    return best[2] if best[0] > 0 else {}


def learn_cutoffs(labelled: DataFrame, stratum: str, label: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the certified cutoffs. ``labelled`` has the counts,
    the stratum and the label (1 good, 0 bad; others are left out). A stratum's
    task reads one row for each combination of passed grid points, however many
    documents there are."""
    names = [f"s{i}" for i in range(len(RULES))]
    grid = "array(" + ", ".join(f"{g}D" for g in GRID) + ")"
    table = (labelled.filter(F.col(label).isin(0, 1))
             .select(F.col(stratum).alias("stratum"), F.col(label).cast("int").alias("good"),
                     *(F.expr(f"size(filter({grid}, g -> coalesce({sql} > g, false)))").alias(s) for s, sql in zip(names, RULES.values())))
             .groupBy("stratum", "good", *names).agg(F.count(F.lit(1)).alias("n")))
    n_strata = labelled.select(stratum).distinct().count()
    level = delta / max(1, n_strata)

    def best(t: pa.Table) -> pa.Table:
        counts = [t.column(c).to_numpy() for c in (*names, "n", "good")]
        got = plan(np.column_stack(counts[:-2]), counts[-2], counts[-1] == 1, alpha, level)
        rules = list(RULES)
        of = t.column("stratum").take(pa.array([0] * len(got), pa.int64()))
        return pa.table({"stratum": of, "rule": pa.array([rules[r] for r in got], pa.string()),
                         "cutoff": pa.array([GRID[i] for i in got.values()], pa.float64())})

    kind = labelled.schema[stratum].dataType.simpleString()
    return table.groupBy("stratum").applyInArrow(best, f"stratum {kind}, rule string, cutoff double")


def judge(counts: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``counts`` with base_failed and kept."""
    wide = (cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut"))
            .withColumnRenamed("stratum", "_stratum"))
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    rejected = F.lit(False)
    for rule, sql in RULES.items():
        rejected = rejected | F.coalesce(F.expr(sql) > F.col("_cut").getItem(rule), F.lit(False))
    return (counts.join(wide, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
            .withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected).drop("_stratum", "_cut"))


def _cutoffs_of(docs: DataFrame, labels: DataFrame, stratum: str, id_col: str, label: str, text_col: str, alpha: float,
                delta: float) -> tuple[DataFrame, DataFrame]:
    """(counts of every row as _id and _stratum, certified cutoffs)."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(stratum).alias("_of"), F.col(text_col).alias("_text"))
    counts = stored(measured(base, ["_id", "_of"], "_text"), "counts")
    marks = labels.select(F.col(id_col).alias("_l"), F.col(label).alias("_label"))
    known = counts.join(marks, F.col("_id") == F.col("_l"))
    return counts, stored(learn_cutoffs(known, "_of", "_label", alpha, delta), "cutoffs")


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", label: str = "quality",
                     text_col: str = "text", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(id, counts, base_failed, kept) of every row.

    Null and empty texts count nothing and fail the base rule. A null stratum is
    a stratum of its own. Labels with a null id or value, or of no document, are
    left out; a document labelled twice counts twice. Repeated rows are judged
    one by one and alike. An empty table gives an empty result; without labels
    only the base rule rejects.
    """
    counts, cutoffs = _cutoffs_of(docs, labels, stratum, id_col, label, text_col, alpha, delta)
    return judge(counts, cutoffs, "_of").select(F.col("_id").alias(id_col), *COUNTS, "base_failed", "kept")


def passing(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", label: str = "quality",
            text_col: str = "text", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. They are
    measured again in place, so that no text is shuffled or stored."""
    _, cutoffs = _cutoffs_of(docs, labels, stratum, id_col, label, text_col, alpha, delta)
    names = {c: f"_k{i}" for i, c in enumerate(docs.columns)}
    base = docs.select(*(F.col(c).alias(k) for c, k in names.items()))
    judged = judge(measured(base, list(names.values()), names[text_col]), cutoffs, names[stratum])
    return judged.filter("kept").select(*(F.col(k).alias(c) for c, k in names.items()))
