"""Benchmark decontamination with one FM-index per training shard.

A shard is a slice of documents of a few MB. Its words that occur in the
benchmark are numbered; any other word ends a segment, because no phrase can
contain it, and segments shorter than the shortest phrase are left out. The
Burrows-Wheeler transform of the segments is held in a wavelet matrix. All
phrases are searched backward at once by rank queries, occurrences are found by
walking to sampled suffix positions, and their word spans are merged.

The benchmark is a stated set of phrases: it is searched in blocks of about
``BLOCK_BYTES`` of text, one after the other. With several blocks each one's hits
are written to the shared folder and its broadcast is destroyed before the next
is built, so driver and workers hold one block whatever the table holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm import text as T
from convlake.llm.frames import RID, attach, ints, keyed, plain, record, stored

WINDOW = 13
MIN_SHARE = 20
BLOCK_BYTES = 8 << 20
SAMPLE = 8


class Wavelet:
    """Wavelet matrix over small integers: access and rank, vectorised."""

    def __init__(self, seq: np.ndarray, top: int) -> None:
        self.levels = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(cur) - bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``upto`` values."""
        lo, hi = np.zeros(len(symbol), np.int64), np.asarray(upto, np.int64).copy()
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = ((symbol >> level) & 1).astype(bool)
            ones_lo, ones_hi = self.ones[i][lo], self.ones[i][hi]
            lo = np.where(bit, self.zeros[i] + ones_lo, lo - ones_lo)
            hi = np.where(bit, self.zeros[i] + ones_hi, hi - ones_hi)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(at), np.int64), np.asarray(at, np.int64).copy()
        for i in range(self.levels):
            before = self.ones[i][at]
            bit = self.ones[i][at + 1] - before
            out = out * 2 + bit
            at = np.where(bit == 1, self.zeros[i] + before, at - before)
        return out


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; every 0 is a separator smaller than all
    symbols, and separators are ordered by position."""
    n = len(seq)
    zero = seq == 0
    rank = np.where(zero, np.cumsum(zero) - 1, zero.sum() + seq)
    order = np.argsort(rank, kind="stable")
    rank_of = np.empty(n, np.int64)
    step = 0
    while True:
        second = np.zeros(n, np.int64)
        if step:
            second[: n - step] = rank[step:] + 1
            order = np.lexsort((second, rank))
        new = np.ones(n, bool)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank_of[order] = np.cumsum(new) - 1
        rank = rank_of.copy()
        if new.all():
            return order
        step = max(1, step * 2)


class FMIndex:
    """Backward search and location over a sequence whose segments are each
    preceded by a 0."""

    def __init__(self, seq: np.ndarray, top: int) -> None:
        self.n = len(seq)
        order = suffix_order(seq)
        self.bwt = Wavelet(seq[order - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        # positions kept: every SAMPLE-th, and all that follow a separator, where walks must end
        position = np.arange(self.n)
        kept = (position % SAMPLE == 0) | (np.concatenate([[0], seq[:-1]]) == 0)
        self.sampled = kept[order]
        self.slot = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high) of the rows of ``phrases`` that occur."""
        which = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[which, j]
            lo, hi = self.before[c] + self.bwt.rank(c, lo), self.before[c] + self.bwt.rank(c, hi)
            ok = lo < hi
            which, lo, hi = which[ok], lo[ok], hi[ok]
            if not len(which):
                break
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows, walking left to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            r = rows[walking]
            c = self.bwt.access(r)
            rows[walking] = self.before[c] + self.bwt.rank(c, r)
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.samples[self.slot[rows]] + steps


class Phrases:
    """The benchmark's windows as word numbers, by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int) -> None:
        arr = pa.array([t or "" for _, t in items], pa.large_string())
        data, off = T.utf8(arr)
        data = T.LOWER[data]
        s, e, woff = T.words(data, off, T.ALNUM)
        h = T.Spans(data).hash(s, e)
        self.names = [i for i, _ in items]
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        ids = ids.reshape(-1).astype(np.int64) + 1
        self.top = len(self.vocabulary)
        #: length -> (different phrases, phrase and item of every window)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i in range(len(items)):
            n = int(woff[i + 1] - woff[i])
            if not n:
                continue
            w = min(n, size)
            at = woff[i] + np.arange(n - w + 1)
            rows.setdefault(w, []).append((ids[at[:, None] + np.arange(w)], np.full(len(at), i)))
        for w, parts in rows.items():
            phrases, which = np.unique(np.concatenate([p for p, _ in parts]), axis=0, return_inverse=True)
            self.by_length[w] = (phrases, which.reshape(-1), np.concatenate([i for _, i in parts]))
        self.shortest = min(self.by_length, default=0)


def shard_hits(p: Phrases, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set]]:
    """Words of each row (offsets), merged hit spans as word indices (start, end)
    of the shard, and the items found in each row."""
    data = T.LOWER[data]
    s, e, woff = T.words(data, off, T.ALNUM)
    items: list[set] = [set() for _ in range(len(off) - 1)]
    none = np.zeros(0, np.int64)
    if not len(s) or not p.top:
        return woff, none, none, items
    h = T.Spans(data).hash(s, e)
    j = np.minimum(np.searchsorted(p.vocabulary, h), p.top - 1)
    known = p.vocabulary[j] == h
    row = T.row_of(woff)
    first = known.copy()
    first[1:] &= ~(known[:-1] & (row[1:] == row[:-1]))
    begin = np.flatnonzero(first)
    if not len(begin):
        return woff, none, none, items
    inside = np.flatnonzero(known)
    count = np.diff(np.append(np.searchsorted(inside, begin), len(inside)))
    long = count >= p.shortest
    begin, count = begin[long], count[long]
    if not len(begin):
        return woff, none, none, items
    # 0, segment, 0, segment, ..., 0
    at = np.concatenate([[0], np.cumsum(count + 1)])
    seq = np.zeros(at[-1] + 1, np.int64)
    word = np.zeros(at[-1] + 1, np.int64)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(at[:-1] + 1, count) + inner
    word[place] = np.repeat(begin, count) + inner
    seq[place] = j[word[place]] + 1
    index = FMIndex(seq, p.top)
    cover = np.zeros(len(s) + 1, np.int64)
    for w, (phrases, which, owner) in p.by_length.items():
        found, lo, hi = index.search(phrases)
        if not len(found):
            continue
        n = hi - lo
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        start = word[index.locate(rows)]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + w, -1)
        # items of each found phrase, once for each document
        order = np.argsort(which, kind="stable")
        left, right = np.searchsorted(which[order], [found, found + 1])
        seen = np.unique(np.stack([np.repeat(np.arange(len(found)), n), row[start]], 1), axis=0)
        for f, r in seen:
            items[r].update(owner[order[left[f]: right[f]]].tolist())
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    # spans end with their row
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = woff[1:-1][(woff[1:-1] > 0) & (woff[1:-1] < len(s))]
    cuts = np.unique(cuts[hit[cuts] & hit[cuts - 1]]) if len(cuts) else cuts
    return woff, np.sort(np.concatenate([lo, cuts])), np.sort(np.concatenate([hi, cuts])), items


_HIT = pa.schema([(RID, pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
                  ("items", pa.list_(pa.string()))])
_HIT_DDL = f"{RID} long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _hits(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Phrases = block.value
        for batch in batches:
            rid = ints(batch, RID)
            for a, b, data, off in T.slices(T.column(batch, "text")):
                woff, lo, hi, items = shard_hits(p, data, off)
                at = np.searchsorted(lo, woff)
                base = np.repeat(woff[:-1], np.diff(at))
                o = pa.array(at, pa.int32())
                yield record(_HIT, rid[a:b], np.diff(woff), pa.ListArray.from_arrays(o, pa.array(lo - base, pa.int64())),
                             pa.ListArray.from_arrays(o, pa.array(hi - base, pa.int64())),
                             pa.array([[p.names[i] for i in sorted(x)] for x in items], pa.list_(pa.string())))
    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int, block_bytes: int) -> tuple[int, Iterator[Phrases]]:
    """The number of blocks of bounded text, and the blocks, each built when asked for."""
    base = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct()
    total = base.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    dealt = base.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))

    def block(b: int) -> Phrases:
        rows = dealt.filter(F.col("b") == b).select("i", "t").orderBy(F.asc_nulls_first("i"), "t").collect()
        return Phrases([(r["i"], r["t"]) for r in rows], size)

    return n, map(block, range(n))


def contamination(texts: DataFrame, benchmark: DataFrame, item_col: str = "item_id", bench_text: str = "text",
                  size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_rid, n_words, starts, ends, items): hit word spans of every text, merged,
    and the items with a window in it. ``texts`` has unique ``_rid`` and ``text``."""
    spark = texts.sparkSession
    n, blocks = _blocks(benchmark, item_col, bench_text, size, block_bytes)
    if n == 1:
        return texts.select(RID, "text").mapInArrow(_hits(spark.sparkContext.broadcast(next(blocks))), _HIT_DDL)
    every = None
    for phrases in blocks:
        sent = spark.sparkContext.broadcast(phrases)
        found = texts.select(RID, "text").mapInArrow(_hits(sent), _HIT_DDL)
        # the first block keeps a row for every text, the others those with hits
        found = stored(found if every is None else found.filter(F.size("items") > 0), "block_hits")
        sent.destroy()
        every = found if every is None else every.unionByName(found)
    return every.groupBy(RID).agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).mapInArrow(_merge, _HIT_DDL)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several benchmark blocks as one."""
    for batch in batches:
        starts, ends = [], []
        for lo, hi in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist()):
            a, b = [], []
            for x, y in sorted(zip(lo, hi)):
                if b and x <= b[-1]:
                    b[-1] = max(b[-1], y)
                else:
                    a.append(x)
                    b.append(y)
            starts.append(a)
            ends.append(b)
        yield record(_HIT, batch.column(RID), batch.column("n_words"), pa.array(starts, pa.list_(pa.int64())),
                     pa.array(ends, pa.list_(pa.int64())), batch.column("items").cast(pa.list_(pa.string())))


def n_hit() -> Column:
    """Hit words: total length of the spans."""
    return F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(RID, pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                        ("items_sha256", pa.string())])
    for batch in batches:
        items = batch.column("items").to_pylist()
        yield record(schema, ints(batch, RID), ints(batch, "n_words"), ints(batch, "n_hit"),
                     np.array([len(x) for x in items], np.int64),
                     pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()))


def contamination_report(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                         item_col: str = "item_id", bench_text: str = "text", size: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row.

    Null and empty texts have no words and no hits. Benchmark rows without words
    have no window; a null item id counts as the empty string; repeated benchmark
    rows count once. Rows repeated with id and text get the same result.
    """
    texts, rows = keyed(docs, text_col, id_col)
    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.col(bench_text).alias("text"))
    out = (contamination(texts, bench, "item_id", "text", size).withColumn("n_hit", n_hit())
           .select(RID, "n_words", "n_hit", "items")
           .mapInArrow(_digest, f"{RID} long, n_words long, n_hit long, n_items long, items_sha256 string")
           .withColumn("contaminated", F.expr(f"n_hit > 0 and {MIN_SHARE} * n_hit >= n_words")))
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    if rows is None:
        return out.select(F.col(RID).alias(id_col), *cols)
    return rows.join(out, RID).select(F.col("_id").alias(id_col), *cols)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                   item_col: str = "item_id", bench_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as often as they occur. Null
    and empty texts stay. Ids may be of any type, and further columns of any name."""
    base, names = plain(docs)
    rows, unique = attach(base, names[text_col], names[id_col])
    texts = rows.select(RID, F.col(names[text_col]).alias("text"))
    bad = (contamination(texts if unique else texts.dropDuplicates([RID]), benchmark, item_col, bench_text, size)
           .withColumn("n_hit", n_hit()).filter(f"n_hit > 0 and {MIN_SHARE} * n_hit >= n_words").select(RID))
    return rows.join(bad, RID, "left_anti").select(*base.columns).toDF(*names)
