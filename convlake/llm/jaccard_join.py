"""Exact n-gram Jaccard self-join with multiple-global-order filtering.

A text's set holds the hashes of its ``n``-word shingles. Texts with one set form
a class, and classes link when 100 * |A and B| >= percent * |A or B|. If they
link, they share a token among their first few (their prefixes) under ANY order
of all tokens, so candidates must share one under several orders:

* order 1 puts the tokens that repeat in a slice of the corpus last, by their
  count; prefixes are matched by shuffling the prefix tokens, and a pair counts
  only if the shared token lies in both prefixes for the pair's own sizes;
* orders 2 and 3 are hash orders; their prefixes are compared for the pairs left;
* what passes all three is verified on the whole sets.

A token's list of up to ``SMALL`` classes gives its pairs. Each class of a longer
list is compared with the list's most central class c (its pivot). Classes u and v
that link, but not both with c, differ from c in the same places: with D(x) the
tokens that only one of x and c has, |u ^ v| = |D(u)| + |D(v)| - 2 |D(u) & D(v)| may
be at most (100 - percent) (|u| + |v|) / (100 + percent), while one of |D(u)| and
|D(v)| alone is above its own bound; so D(u) and D(v) share tokens, and how many is
known. A second prefix filter on the differences, tokens outside c first, gives the
candidates between the components found so far. What the whole list has in common
(a copied text, a shared passage) is in no difference, so a large group costs its
size. The links are a connecting subset: components are exact, but two similar texts
of one component may have no link of their own where every list they share is long,
and links are not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlake.llm import text as T
from convlake.llm.components import components
from convlake.llm.frames import RID, attach, ints, keyed, plain, record, runs, stored

SHINGLE = 4
PERCENT = 85
SMALL = 32
#: Tokens whose order is learnt: at most so many (16 bytes each are broadcast), from
#: those that occur in several texts of one slice. Any table gives the same result.
REPEATED = 1 << 20
MIN_IN_SLICE = 2
#: Ids (16 bytes each) that are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of text hashed at once, and pairs compared at once: bounds of a worker's memory.
HASH_BYTES = T.SLICE_BYTES // 4
PAIRS = 256
ORDER_SALTS = (0x51A7, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_U = np.uint64
_PRO = pa.schema([("kind", pa.int8()), (RID, pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])
_PRO_DDL = f"kind byte, {RID} long, n long, k1 long, k2 long"
_PRE = pa.schema([("t", pa.int64()), (RID, pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])
_PRE_DDL = f"t long, {RID} long, n long, pos long"
_SKETCH = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("p2", pa.binary()), ("p3", pa.binary())])
_SKETCH_DDL = "cid long, n long, p2 binary, p3 binary"
_DIF = pa.schema([(c, pa.int64()) for c in ("pivot", "t", "cid", "component", "n", "d", "pos")])
_DIF_DDL = "pivot long, t long, cid long, component long, n long, d long, pos long"
_SET = pa.schema([("cid", pa.int64()), ("whole", pa.binary())])
_SET_DDL = "cid long, whole binary"


def overlap_needed(a, b, percent: int):
    """Smallest |A and B| of linked sets of sizes a and b."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def prefix_length(n, percent: int):
    """Longest prefix any partner may need: n less the smallest overlap, plus 1."""
    return n - (percent * n + 99) // 100 + 1


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer words has its
    whole sequence as its one shingle, a row without words none."""
    data = T.LOWER[data]
    starts, ends, woff = T.words(data, off)
    h = T.Spans(data).hash(starts, ends)
    at, soff = T.windows(woff, size)
    grams = T.combine(h, at, size)
    out = []
    for i in range(len(off) - 1):
        if soff[i + 1] > soff[i]:
            out.append(np.unique(grams[soff[i]: soff[i + 1]]))
        elif woff[i + 1] > woff[i]:
            out.append(T.combine(h, woff[i: i + 1], int(woff[i + 1] - woff[i])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slice_sets(arr: pa.Array, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, end row, their sets) for slices of four times the usual bytes:
    the sets are small, the hashing takes ``HASH_BYTES`` at a time."""
    for lo, hi, _, _ in T.slices(arr, 4 * T.SLICE_BYTES):
        yield lo, hi, [s for _, _, data, off in T.slices(arr.slice(lo, hi - lo), HASH_BYTES) for s in shingle_sets(data, off, size)]


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    m = T.mix(s)
    return int(m.sum(dtype=np.uint64).astype(np.int64)), int(T.mix(m ^ _U(0xA5A5)).sum(dtype=np.uint64).astype(np.int64))


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = ints(batch, RID)
            for lo, hi, sets in slice_sets(T.column(batch, "text"), size):
                n = np.array([len(s) for s in sets], np.int64)
                keys = np.array([set_key(s) for s in sets], np.int64).reshape(-1, 2)
                yield record(_PRO, np.zeros(hi - lo, np.int8), rid[lo:hi], n, keys[:, 0], keys[:, 1])
                one = np.unique(keys, axis=0, return_index=True)[1]
                token, count = np.unique(np.concatenate([sets[i] for i in one]), return_counts=True)
                often = count >= MIN_IN_SLICE
                token, count = token[often].view(np.int64), count[often]
                zero = np.zeros(len(token), np.int64)
                yield record(_PRO, np.ones(len(token), np.int8), zero, count, token, zero)
    return run


def _packed_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens in their order, 8 bytes each: a row for each batch, not each token."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([ints(batch, "t").astype("<i8").tobytes()], pa.binary())], ["t"])


def _late(s: np.ndarray, token: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of tokens in the learnt order; 0, before all others, of those not in it."""
    if not len(token):
        return np.zeros(len(s), np.int64)
    j = np.minimum(np.searchsorted(token, s), len(token) - 1)
    return np.where(token[j] == s, rank[j], 0)


def _prefixes(size: int, percent: int, repeated):
    """First tokens of each different set of a slice under order 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, rank = repeated.value
        for batch in batches:
            rid = ints(batch, RID)
            for lo, hi, sets in slice_sets(T.column(batch, "text"), size):
                done = set()
                out: list[tuple[np.ndarray, int, int]] = []
                for i in np.argsort(rid[lo:hi], kind="stable"):
                    s = sets[i]
                    if not len(s) or (key := set_key(s)) in done:
                        continue
                    done.add(key)
                    first = np.lexsort((T.mix(s ^ _U(ORDER_SALTS[0])), _late(s, token, rank)))[: prefix_length(len(s), percent)]
                    out.append((s[first], int(rid[lo + i]), len(s)))
                if out:
                    k = np.array([len(o[0]) for o in out])
                    yield record(_PRE, np.concatenate([o[0] for o in out]).view(np.int64),
                                 np.repeat([o[1] for o in out], k), np.repeat([o[2] for o in out], k),
                                 np.concatenate([np.arange(x) for x in k]))
    return run


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by t: those whose token another row has."""
    carry, given = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [ints(batch, f.name) for f in _PRE]
        if carry is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(carry, cols)]
        group = np.cumsum(runs(cols[0])) - 1
        several = np.bincount(group) > 1
        several[0] |= given
        give = several[group]
        if given:
            give[0] = False
        if give.any():
            yield record(_PRE, *(c[give] for c in cols))
        given = bool(several[-1])
        carry = [c[-1:] for c in cols]


def _sketches(size: int, percent: int):
    """Prefixes under orders 2 and 3, as the upper halves of the ordering hashes:
    equal tokens stay equal, and the order stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = ints(batch, RID)
            for lo, hi, data, off in T.slices(T.column(batch, "text"), HASH_BYTES):
                sets = shingle_sets(data, off, size)
                cols: list[list] = [[], []]
                for s in sets:
                    for c, salt in zip(cols, ORDER_SALTS[1:]):
                        h = T.mix(s ^ _U(salt))
                        h.sort()
                        c.append((h[: prefix_length(len(s), percent)] >> _U(32)).astype(np.uint32).tobytes())
                yield record(_SKETCH, rid[lo:hi], np.array([len(s) for s in sets], np.int64), *(pa.array(c, pa.binary()) for c in cols))
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = ints(batch, RID)
            for lo, hi, data, off in T.slices(T.column(batch, "text"), HASH_BYTES):
                yield record(_SET, rid[lo:hi], pa.array([s.tobytes() for s in shingle_sets(data, off, size)], pa.binary()))
    return run


def _picked(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ``ids`` (one column): by broadcast while the ids are few."""
    ids = stored(ids.toDF(RID).distinct(), "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, RID, "left_semi")


def _some_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, PAIRS):
            yield batch.slice(lo, PAIRS)


def _orders_agree(percent: int):
    """Pairs whose prefixes, cut to the pair's sizes, meet under orders 2 and 3."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some_pairs(batches):
            na, nb = ints(batch, "na"), ints(batch, "nb")
            need = overlap_needed(na, nb, percent)
            keep = np.ones(batch.num_rows, bool)
            for p in ("p2", "p3"):
                pairs = zip(batch.column("a" + p).to_pylist(), batch.column("b" + p).to_pylist())
                for i, (x, y) in enumerate(pairs):
                    if keep[i]:
                        x = np.frombuffer(x, np.uint32)[: na[i] - need[i] + 1]
                        y = np.frombuffer(y, np.uint32)[: nb[i] - need[i] + 1]
                        keep[i] = np.isin(x, y).any()
            yield record(schema, ints(batch, "a")[keep], ints(batch, "b")[keep])
    return run


def _verified(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some_pairs(batches):
            keep = []
            for x, y in zip(batch.column("awhole").to_pylist(), batch.column("bwhole").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = np.array(keep, bool)
            yield record(schema, ints(batch, "a")[keep], ints(batch, "b")[keep])
    return run


def _differences(percent: int, repeated):
    """(pivot, t, cid, component, n, d, pos): the first tokens of each class's
    difference from its pivot, d its size; tokens that the pivot lacks come first,
    then order 1. A partner's difference is smaller by at most the spare difference
    of a linked pair, so one token more than that is enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, rank = repeated.value
        for batch in batches:
            for some in _some_pairs([batch]):
                out: list[np.ndarray] = []
                sizes, ds = [], []
                for x, c in zip(some.column("whole"), some.column("pwhole")):
                    x, c = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(c.as_py(), np.uint64)
                    new, gone = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
                    d = np.concatenate([new, gone])
                    own = np.repeat([0, 1], [len(new), len(gone)])
                    spare = (100 - percent) * (len(x) + 100 * len(x) // percent) // (100 + percent)
                    out.append(d[np.lexsort((T.mix(d ^ _U(ORDER_SALTS[0])), _late(d, token, rank), own))[: spare + 1]])
                    sizes.append(len(x))
                    ds.append(len(d))
                k = np.array([len(o) for o in out])
                yield record(_DIF, np.repeat(ints(some, "pivot"), k), np.concatenate(out).view(np.int64), np.repeat(ints(some, "cid"), k),
                             np.repeat(ints(some, "component"), k), np.repeat(sizes, k), np.repeat(ds, k),
                             np.concatenate([np.arange(i) for i in k]))
    return run


def _need_sql(x: str, y: str, percent: int) -> str:
    return f"(({percent} * ({x} + {y}) + {99 + percent}) div {100 + percent})"


def similar_classes(texts: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (_rid, n, cid) gives every text's set size and
    class (the smallest _rid with the same set; itself without words); links
    (a, b) are enough linked class pairs to connect all that are linked."""
    spark = texts.sparkSession
    texts = texts.select(RID, "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    profile = stored(texts.mapInArrow(_profile(size), _PRO_DDL), "profile")
    own = profile.filter("kind = 0")
    classes = own.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min(RID).alias("cid"))
    members = stored(own.filter("n > 0").join(classes, ["n", "k1", "k2"]).select(RID, "n", "cid")
                     .unionByName(own.filter("n = 0").select(RID, "n", F.col(RID).alias("cid"))), "members")
    often = (profile.filter("kind = 1").groupBy(F.col("k1").alias("t")).agg(F.sum("n").alias("c"))
             .orderBy(F.desc("c"), "t").limit(REPEATED).select("t").mapInArrow(_packed_tokens, "t binary").collect())
    token = np.frombuffer(b"".join(r["t"] for r in often), np.uint64)
    rank = len(token) - np.arange(len(token), dtype=np.int64)  # the most frequent comes last
    o = np.argsort(token)
    repeated = spark.sparkContext.broadcast((token[o], rank[o]))
    postings = stored(
        texts.mapInArrow(_prefixes(size, percent, repeated), _PRE_DDL).repartition(parts, "t").sortWithinPartitions("t")
        .mapInArrow(_shared_tokens, _PRE_DDL).join(members.select(RID, "cid"), RID)
        .select("t", "cid", "n", "pos").distinct(), "postings")
    lists = postings.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1")
    listed = postings.join(lists, "t")
    # short lists: all pairs whose sizes and positions allow a link
    short = listed.filter(F.col("c") <= SMALL).drop("c")
    x, y = short.alias("x"), short.alias("y")
    need = _need_sql("x.n", "y.n", percent)
    fits = F.expr(f"x.cid < y.cid and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
                  f" and x.pos <= x.n - {need} and y.pos <= y.n - {need}")
    pairs = x.join(y, (F.col("x.t") == F.col("y.t")) & fits).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    # long lists: every class against the list's pivot
    central = postings.groupBy("cid").agg(F.count("*").alias("central"))
    long = listed.filter(F.col("c") > SMALL).select("t", "cid", "n").join(central, "cid")
    pivots = long.groupBy("t").agg(F.max(F.struct("central", -F.col("cid"), "n")).alias("m")).select(
        "t", (-F.col("m.col2")).alias("pivot"), F.col("m.n").alias("pn"))
    around = stored(long.join(pivots, "t").filter("cid <> pivot").select("cid", "n", "pivot", "pn").distinct(), "around")
    stars = around.filter(f"100 * least(n, pn) >= {percent} * greatest(n, pn)").select(
        F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b"))
    first = stored(pairs.union(stars).distinct(), "pairs")
    wanted = first.select("a").union(first.select("b")).union(around.select("cid"))
    sketches = stored(_picked(texts, wanted).mapInArrow(_sketches(size, percent), _SKETCH_DDL), "sketches")
    links = stored(_links(first, texts, sketches, size, percent), "links")
    # pairs between components around one pivot: those whose differences from it agree
    placed = around.join(components(links).withColumnRenamed("node", "cid"), "cid", "left").select(
        "pivot", "cid", F.coalesce("component", "cid").alias("component"))
    apart = (placed.groupBy("pivot").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
             .filter("c0 < c1").select("pivot"))
    open_ = stored(placed.join(apart, "pivot"), "open")
    whole = stored(_picked(texts, open_.select("cid").union(open_.select("pivot"))).mapInArrow(_sets(size), _SET_DDL), "sets")
    differ = stored(
        open_.join(whole, "cid").join(whole.toDF("pivot", "pwhole"), "pivot")
        .select("pivot", "cid", "component", "whole", "pwhole").mapInArrow(_differences(percent, repeated), _DIF_DDL), "differences")
    repeated.unpersist()
    shared = differ.groupBy("pivot", "t").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1")
    met = differ.join(shared.select("pivot", "t"), ["pivot", "t"])
    u, v = met.alias("u"), met.alias("v")
    spare = f"(({100 - percent} * (u.n + v.n)) div {100 + percent})"
    common = f"greatest(1, (u.d + v.d - {spare} + 1) div 2)"
    rest = (u.join(v, F.expr("u.pivot = v.pivot and u.t = v.t and u.cid < v.cid and u.component <> v.component"
                             f" and 100 * least(u.n, v.n) >= {percent} * greatest(u.n, v.n)"
                             f" and u.pos <= u.d - {common} and v.pos <= v.d - {common}"))
            .select(F.col("u.cid").alias("a"), F.col("v.cid").alias("b")).distinct()
            .join(first, ["a", "b"], "left_anti"))
    return members, links.union(_links(rest, texts, sketches, size, percent))


def _links(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """The linked ones of candidate pairs: the other orders' prefixes first, then
    the whole sets of what is left."""
    def side(s: str) -> DataFrame:
        return sketches.select(F.col("cid").alias(s), F.col("n").alias("n" + s), F.col("p2").alias(s + "p2"), F.col("p3").alias(s + "p3"))

    left = stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ap2", "bp2", "ap3", "bp3")
                  .mapInArrow(_orders_agree(percent), "a long, b long"), "agreed")
    whole = stored(_picked(texts, left.select("a").union(left.select("b"))).mapInArrow(_sets(size), _SET_DDL), "sets")
    return (left.join(whole.toDF("a", "awhole"), "a").join(whole.toDF("b", "bwhole"), "b").select("a", "b", "awhole", "bwhole")
            .mapInArrow(_verified(percent), "a long, b long"))


def similar_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = SHINGLE,
                   percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, is_first) of every row: the size of the
    text's shingle set, the smallest id reachable by links, and whether the row
    stands for its component.

    Texts without words (null, empty, blank) have an empty set, link with nothing
    and are their own component. Rows repeated with id and text count as one (all
    but one of them are not first); different texts under one id are different
    documents. A null id sorts first.
    """
    texts, rows = keyed(docs, text_col, id_col)
    members, links = similar_classes(texts, size, percent)
    labels = components(links).withColumnsRenamed({"node": "cid"})
    out = (members.join(labels, "cid", "left")
           .select(RID, F.col("n").alias("n_shingles"), F.coalesce("component", "cid").alias("component")))
    if rows is None:
        return out.select(F.col(RID).alias(id_col), "n_shingles", F.col("component").alias("component_id"),
                          (F.col(RID) == F.col("component")).alias("is_first"))
    names = rows.groupBy(RID).agg(F.min("_id").alias("component_id")).withColumnRenamed(RID, "component")
    copy = F.row_number().over(Window.partitionBy(RID).orderBy(RID))
    return (rows.withColumn("copy", copy).join(out, RID).join(names, "component")
            .select(F.col("_id").alias(id_col), "n_shingles", "component_id",
                    ((F.col(RID) == F.col("component")) & (F.col("copy") == 1)).alias("is_first")))


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = SHINGLE,
                percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their component, once each: of each group
    the row with the smallest id (null first; of one id, by the text's hash).
    Texts without words are groups of their own. Ids may be of any type, and
    further columns of any name."""
    base, names = plain(docs)
    rows, unique = attach(base, names[text_col], names[id_col])
    texts = rows.select(RID, F.col(names[text_col]).alias("text"))
    members, links = similar_classes(texts if unique else texts.dropDuplicates([RID]), size, percent)
    labels = components(links).withColumnsRenamed({"node": "cid"})
    first = (members.join(labels, "cid", "left").filter(F.coalesce("component", "cid") == F.col(RID)).select(RID))
    kept = rows.join(first, RID, "left_semi")
    return (kept if unique else kept.dropDuplicates([RID])).select(*base.columns).toDF(*names)
