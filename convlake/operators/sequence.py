"""Skew-safe building blocks for per-key ordered computations.

A single session, client or model may hold a third of all rows, so no helper
here partitions by the bare key:

* ``top_k`` / ``top_k_multi`` - exact top-k per group in two stages: first per
  (group, salt) bucket, then over the at most ``k * salt`` survivors per group;
  the salt count adapts to the largest group.
* ``time_buckets`` - rows get a (key, time bucket) partition plus copies of the
  last ``halo`` microseconds of the previous bucket, so sliding windows and
  gaps of width <= halo are exact inside each bucket.
* ``carry_last`` / ``prefix_count`` - running "last non-null" values and
  running counts computed inside (key, bucket) partitions and then carried
  across buckets through a small per-(key, bucket) table (two-level scan).
* ``sliding_counts_sorted`` / ``sessionize_sorted`` / ``carry_last_sorted`` -
  the same results when a key is dense even within one bucket: a
  range-partitioned global sort bounds every task by row count, and the state
  carried between partitions is a table of at most one row per partition.
  The rows are checkpointed once with a number of their own, by which results
  come back, so ids may be null, repeated or of any type; keys travel as text.

A row without a time has no neighbours in any plan: its window holds itself only,
it has no gap, and it is a session of its own with an unknown start.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.session import cut_lineage

DEFAULT_SALT = 64
SALT_TARGET_ROWS = 5_000_000
MAX_SALT = 1 << 20


def adaptive_salt(df: DataFrame, group: Sequence[str], minimum: int = DEFAULT_SALT) -> int:
    """Salt buckets so that no (group, salt) slice exceeds ~SALT_TARGET_ROWS rows:
    one partial aggregation finds the largest group."""
    biggest = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).collect()[0][0] or 0
    return int(min(MAX_SALT, max(minimum, -(-biggest // SALT_TARGET_ROWS))))


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00:00 of a TIMESTAMP_NTZ column; no time
    zone is involved, so the result does not depend on the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            ts.cast("timestamp_ntz"))


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "_rk",
          salt_of: Sequence[str] | None = None, salt: int | None = None) -> DataFrame:
    """Rows ranked 1..k within each group by ``order`` (ties broken by ``order``
    itself, so give a unique last key), with the exact rank in ``rank_col``.

    Stage 1 ranks inside (group, salt) buckets, stage 2 inside the group over
    the <= k*salt survivors: no group is ever sorted whole in one task.
    """
    # Deterministic salt (a task retry must see the same buckets): a hash of
    # the given columns, by default of the whole row. The number of buckets
    # grows with the largest group (``adaptive_salt``) unless given.
    salt = salt or adaptive_salt(df, group)
    salt_expr = F.pmod(F.hash(*(salt_of or df.columns)), F.lit(salt))
    s = df.withColumn("_salt", salt_expr)
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    s = s.withColumn(rank_col, F.row_number().over(w1)).filter(F.col(rank_col) <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return s.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k).drop("_salt")


def top_k_multi(df: DataFrame, group: Sequence[str], rankings: dict, salt_of: Sequence[str] | None = None,
                salt: int | None = None) -> DataFrame:
    """Several exact top-k rankings per group in one salted two-stage pass.

    ``rankings`` maps an output column to ``(order, k)`` or ``(order, k, cond)``;
    with a condition only rows satisfying it are ranked. A row survives when
    it is within the top k of any ranking; each rank column holds the exact
    rank (1..k) or null. Exact because the global top k of every ranking is
    inside its (group, salt) bucket's top k, so stage 2 sees all of them.
    """
    salt = salt or adaptive_salt(df, group)
    salt_expr = F.pmod(F.hash(*(salt_of or df.columns)), F.lit(salt))
    specs = {name: (r[0], r[1], r[2] if len(r) > 2 else F.lit(True)) for name, r in rankings.items()}
    d = df.withColumn("_salt", salt_expr)
    for name, (_, _, cond) in specs.items():
        d = d.withColumn("_ok" + name, F.coalesce(cond, F.lit(False)))

    def ranked(d, parts):
        keep = None
        for name, (order, k, _) in specs.items():
            w = Window.partitionBy(*parts, "_ok" + name).orderBy(*order)
            d = d.withColumn(name, F.when(F.col("_ok" + name), F.row_number().over(w)))
            d = d.withColumn(name, F.when(F.col(name) <= k, F.col(name)))
            c = F.col(name).isNotNull()
            keep = c if keep is None else (keep | c)
        return d.filter(keep)

    d = ranked(d, [*group, "_salt"])
    d = ranked(d, list(group))
    return d.drop("_salt", *["_ok" + n for n in specs])


def time_buckets(df: DataFrame, us: str, bucket_us: int, halo_us: int) -> DataFrame:
    """Add ``_b`` (bucket of the row) and ``_own``; rows in the last ``halo_us``
    of a bucket are also emitted into the next bucket with ``_own = false``.
    One pass: the copy is a generator over the same scan (no union, no re-read)."""
    if halo_us > bucket_us:
        raise ValueError("halo must not exceed the bucket width")
    b = F.floor(F.col(us) / F.lit(bucket_us)).cast("bigint")
    if halo_us <= 0:
        return df.withColumn("_b", b).withColumn("_own", F.lit(True))
    in_halo = F.col(us) >= (b + 1) * F.lit(bucket_us) - F.lit(halo_us)
    shifts = F.when(in_halo, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (df.select("*", F.explode(shifts).alias("_shift"))
              .withColumn("_b", b + F.col("_shift")).withColumn("_own", F.col("_shift") == 0).drop("_shift"))


def bucket_width(window_us: int, factor: int = 8, floor_us: int = 3_600_000_000) -> int:
    """Bucket width for a sliding window: several windows wide (halo copies stay
    a small fraction), never below an hour."""
    return max(window_us * factor, floor_us)


def sliding_count(df: DataFrame, keys: Sequence[str], us: str, window_us: int, out: str,
                  bucket_us: int | None = None) -> DataFrame:
    """Rows of the same key with ``us - window_us < other.us <= us`` (range frame,
    peers included, the row itself included)."""
    bw = bucket_us or bucket_width(window_us)
    t = time_buckets(df, us, bw, window_us)
    w = Window.partitionBy(*keys, "_b").orderBy(F.col(us)).rangeBetween(-(window_us - 1), 0)
    return t.withColumn(out, _timed(F.count(F.lit(1)).over(w), us)).filter("_own").drop("_b", "_own")


def _timed(n: Column, us: str) -> Column:
    """A window count, or 1 for a row without a time."""
    return F.when(F.col(us).isNotNull(), n).otherwise(F.lit(1)).cast("bigint")


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with a unique ``_row``, checkpointed so that the numbers are fixed."""
    return cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))


def _key_text(key: str) -> Column:
    """Any key as text that is never null and differs where keys differ."""
    return F.to_json(F.array(F.col(key).cast("string")))


def _end_segments(new: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of a batch's first and last key; ``new`` marks where keys begin."""
    bounds = np.unique(np.r_[0, np.flatnonzero(new), len(new)])
    return [(int(bounds[i]), int(bounds[i + 1])) for i in sorted({0, len(bounds) - 2})]


DENSE_ROWS = 2_000_000


def densest_bucket(df: DataFrame, keys: Sequence[str], us: str, bucket_us: int) -> int:
    """Rows in the fullest (key, time bucket): one partial aggregation, used to
    pick between bucketed windows and the sorted plans."""
    b = F.floor(F.col(us) / F.lit(bucket_us))
    r = df.groupBy(*keys, b.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).collect()[0][0]
    return int(r or 0)


def sliding_counts(df: DataFrame, keys: Sequence[str], us: str, windows: dict[str, int],
                   bucket_us: int | None = None) -> DataFrame:
    """Several range-frame counts over one (key, bucket) partitioning: a single
    shuffle whatever the number of windows."""
    widest = max(windows.values())
    bw = bucket_us or bucket_width(widest)
    t = time_buckets(df, us, bw, widest)
    for out, w_us in windows.items():
        w = Window.partitionBy(*keys, "_b").orderBy(F.col(us)).rangeBetween(-(w_us - 1), 0)
        t = t.withColumn(out, _timed(F.count(F.lit(1)).over(w), us))
    return t.filter("_own").drop("_b", "_own")


def prev_gap(df: DataFrame, keys: Sequence[str], us: str, tiebreak: str, horizon_us: int, out: str,
             bucket_us: int | None = None, keep_bucket: str | None = None) -> DataFrame:
    """Microseconds since the previous row of the key (ordered by us, tiebreak);
    null when there is none within ``horizon_us``. ``keep_bucket`` names a column
    keeping the row's bucket, so a following per-(key, bucket) step reuses the
    partitioning instead of shuffling again."""
    bw = bucket_us or bucket_width(horizon_us)
    t = time_buckets(df, us, bw, horizon_us)
    w = Window.partitionBy(*keys, "_b").orderBy(F.col(us), F.col(tiebreak))
    gap = F.col(us) - F.lag(us).over(w)
    t = (t.withColumn(out, gap).filter("_own")
          .withColumn(out, F.when(F.col(out) <= horizon_us, F.col(out))).drop("_own"))
    return t.withColumnRenamed("_b", keep_bucket) if keep_bucket else t.drop("_b")


def carry_last(df: DataFrame, keys: Sequence[str], order: str, tiebreak: str, values: Sequence[str],
               bucket: int, suffix: str = "_last", bucket_col: str | None = None) -> DataFrame:
    """For each value column: the last non-null value at or before the row
    (ordered by ``order``, ``tiebreak``) within the key, across all buckets.

    Level 1: running last inside (key, bucket). Level 2: last non-null per
    (key, bucket) -> running last over earlier buckets (one row per bucket, so a
    hot key costs one row per bucket) -> joined back on (key, bucket).
    """
    d = (df.withColumnRenamed(bucket_col, "_b") if bucket_col
         else df.withColumn("_b", F.floor(F.col(order) / F.lit(bucket)).cast("bigint")))
    w = Window.partitionBy(*keys, "_b").orderBy(order, tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    for v in values:
        d = d.withColumn(v + suffix, F.last(v, ignorenulls=True).over(w))
    ordk = F.struct(F.col(order), F.col(tiebreak))
    per_b = d.groupBy(*keys, "_b").agg(
        *[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), ordk)).alias("_pb_" + v) for v in values])
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_b.select(*keys, "_b", *[F.last("_pb_" + v, ignorenulls=True).over(wb).alias("_c_" + v)
                                         for v in values])
    d = _join_buckets(d, carried, keys)
    for v in values:
        d = d.withColumn(v + suffix, F.coalesce(F.col(v + suffix), F.col("_c_" + v))).drop("_c_" + v)
    return d.drop("_b")


def prefix_count(df: DataFrame, keys: Sequence[str], order: str, tiebreak: str, bucket: int,
                 out: str) -> DataFrame:
    """1-based position of the row within its key (ordered by order, tiebreak),
    via per-bucket row numbers plus the counts of all earlier buckets."""
    d = df.withColumn("_b", F.floor(F.col(order) / F.lit(bucket)).cast("bigint"))
    w = Window.partitionBy(*keys, "_b").orderBy(order, tiebreak)
    d = d.withColumn(out, F.row_number().over(w).cast("bigint"))
    per_b = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = per_b.select(*keys, "_b", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_before"))
    return (_join_buckets(d, before, keys)
              .withColumn(out, F.col(out) + F.col("_before")).drop("_before", "_b"))


def _join_buckets(d: DataFrame, per_b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach per-(key, bucket) values. Every (key, bucket) of ``d`` has a row in
    ``per_b`` (it was aggregated from ``d``), so a null-safe inner join keeps all
    rows; being inner, both sides share the same scan and exchange subtree,
    which Spark reuses instead of recomputing."""
    r = per_b.select(*[F.col(k).alias("_j_" + k) for k in [*keys, "_b"]],
                     *[c for c in per_b.columns if c not in (*keys, "_b")])
    cond = [d[k].eqNullSafe(r["_j_" + k]) for k in [*keys, "_b"]]
    return d.join(r, cond, "inner").drop(*["_j_" + k for k in [*keys, "_b"]])


def sliding_count_sorted(df: DataFrame, key: str, us: str, id_col: str, window_us: int, out: str,
                         partitions: int | None = None) -> DataFrame:
    """One window of ``sliding_counts_sorted``."""
    return sliding_counts_sorted(df, key, us, id_col, {out: window_us}, partitions)


def sliding_counts_sorted(df: DataFrame, key: str, us: str, id_col: str, windows: dict[str, int],
                          partitions: int | None = None) -> DataFrame:
    """Exact ``sliding_count`` whatever the density of a key: P(t) - P(t - w),
    where P(x) counts the key's rows at or before x.

    Every row becomes a data point and query points (t and t - w per window). The
    points are range-partitioned on (key, time, kind) - the sampled range
    boundaries split even a single dense key over many partitions - and sorted
    within partitions. A first pass counts data points per (partition, key);
    only the first key of a partition can continue from earlier partitions, so
    the carried-in counts form a table of at most one row per partition. A
    second pass turns running counts into P for every query point. Counts need no
    order among ties, so ``id_col`` may hold anything.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _numbered(df)
    base = rows.filter(F.col(us).isNotNull()).select(_key_text(key).alias("k"), F.col(us).cast("long").alias("t"), F.col("_row").alias("rid"))
    data = base.select("k", "t", F.lit(0).alias("kind"), "rid", F.lit(0).alias("tag"))
    pts = data.unionByName(base.select("k", "t", F.lit(1).alias("kind"), "rid", F.lit(1).alias("tag")))
    names = list(windows)
    for i, name in enumerate(names):
        pts = pts.unionByName(base.select("k", (F.col("t") - F.lit(windows[name])).alias("t"), F.lit(1).alias("kind"),
                                          "rid", F.lit(2 + i).alias("tag")))
    pts = pts.repartitionByRange(n, "k", "t", "kind").sortWithinPartitions("k", "t", "kind")
    pts = cut_lineage(pts.withColumn("pid", F.spark_partition_id()))
    # Every (partition, key) with any point, data or query: a partition may hold
    # only query points of a key that continues from earlier partitions.
    counts = pts.groupBy("pid", "k").agg(F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).alias("c"))
    w = Window.partitionBy("k").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("off", F.coalesce(F.sum("c").over(w), F.lit(0))).filter("off > 0")
    # Bounded: one continuing key per partition at most.
    offsets = {r["pid"]: (r["k"], r["off"]) for r in carried.collect()}

    def run(batches):
        cur, run_count = None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            ks, is_data = pdf["k"].to_numpy(), (pdf["kind"].to_numpy() == 0).astype(np.int64)
            pid = int(pdf["pid"].iloc[0])
            starts = np.r_[True, ks[1:] != ks[:-1]]
            grp = np.cumsum(starts) - 1
            csum = np.cumsum(is_data)
            first_idx = np.flatnonzero(starts)
            before = np.r_[0, csum][first_idx]          # data points before each key group in this batch
            p = csum - before[grp]
            # base of each group: carry-over for the key continuing from the previous batch/partition
            bases = np.zeros(len(first_idx), dtype=np.int64)
            if cur is not None and ks[0] == cur:
                bases[0] = run_count
            elif cur is None and pid in offsets and offsets[pid][0] == ks[0]:
                bases[0] = offsets[pid][1]
            p = p + bases[grp]
            cur, run_count = ks[-1], int(p[-1])
            q = pdf["kind"].to_numpy() == 1
            yield pd.DataFrame({"rid": pdf["rid"].to_numpy()[q], "tag": pdf["tag"].to_numpy()[q], "p": p[q]})

    pv = pts.mapInPandas(run, "rid long, tag int, p long")
    hi_p = F.max(F.when(F.col("tag") == 1, F.col("p")))
    res = pv.groupBy("rid").agg(*[(hi_p - F.max(F.when(F.col("tag") == 2 + i, F.col("p")))).alias(name)
                                  for i, name in enumerate(names)])
    out = rows.join(res.withColumnRenamed("rid", "_row"), "_row", "left").drop("_row")
    return out.withColumns({name: F.coalesce(name, F.lit(1)).cast("bigint") for name in names})


def sessionize_sorted(df: DataFrame, key: str, us: str, id_col: str, gap_us: int,
                      partitions: int | None = None) -> DataFrame:
    """Ordered per-key scan whatever the density of a key. Adds ``gap_us`` (time
    since the previous row of the key, null for its first row), ``is_start``
    (a gap of more than ``gap_us`` opens a session), ``session_start_us`` and
    ``seq_in_session`` (1-based position inside the session).

    Rows are range-partitioned and sorted on (key, time, id), so every task
    holds a bounded slice even of a single dense key. Pass 1 summarises each
    (partition, key): first and last time, row count, the last session start
    inside and the rows from it on. Only the first and the last key of a partition
    can span several, so that table has at most two rows per partition and is
    resolved in order on the driver. Pass 2 carries time, session start and
    position along each partition.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _numbered(df)
    pts = (rows.filter(F.col(us).isNotNull())
               .select(_key_text(key).alias("k"), F.col(us).cast("long").alias("t"), F.col(id_col).alias("tb"), F.col("_row").alias("rid"))
               .repartitionByRange(n, "k", "t", "tb", "rid").sortWithinPartitions("k", "t", "tb", "rid").drop("tb"))
    pts = cut_lineage(pts.withColumn("pid", F.spark_partition_id()))

    def summary(batches):
        # Only the first and the last key of a partition can span partitions.
        first = cur = None
        for pdf in batches:
            if not len(pdf):
                continue
            ks, ts = pdf["k"].to_numpy(dtype=object), pdf["t"].to_numpy(dtype=np.int64)
            new = np.r_[cur is None or ks[0] != cur["k"], ks[1:] != ks[:-1]]
            opens = ~new & (ts - np.r_[cur["last_t"] if cur else 0, ts[:-1]] > gap_us)
            for a, b in _end_segments(new):
                if new[a]:
                    first = first or cur
                    cur = {"pid": int(pdf["pid"].iloc[0]), "k": ks[a], "first_t": int(ts[a]), "last_t": 0, "n": 0,
                           "last_int": 0, "after": -1}
                cur["n"] += b - a
                cur["last_t"] = int(ts[b - 1])
                at = np.flatnonzero(opens[a:b])
                if len(at):
                    cur["last_int"], cur["after"] = int(ts[a + at[-1]]), b - a - int(at[-1])
                elif cur["after"] >= 0:
                    cur["after"] += b - a
        if cur:
            yield pd.DataFrame([r for r in (first, cur) if r])

    summ = pts.mapInPandas(summary, "pid int, k string, first_t long, last_t long, n long, last_int long, after long")
    boundary = sorted(summ.collect(), key=lambda r: (r["k"], r["pid"]))   # at most two rows a partition
    carry: dict[int, tuple] = {}   # pid -> (key, last time, session start, rows of the session so far)
    prev_k = last_t = last_start = cnt = None
    for r in boundary:
        if r["k"] != prev_k:
            prev_k, last_t, last_start, cnt = r["k"], None, None, 0
        else:
            carry[r["pid"]] = (r["k"], last_t, last_start, cnt)
        first_is_start = last_t is None or r["first_t"] - last_t > gap_us
        if r["after"] >= 0:
            last_start, cnt = r["last_int"], r["after"]
        elif first_is_start:
            last_start, cnt = r["first_t"], r["n"]
        else:
            cnt += r["n"]
        last_t = r["last_t"]

    def mark(batches):
        # Vectorised per batch; (key, time, session start, position) carry over
        # from the previous batch or, for the first one, from the carry table.
        cur_k = cur_t = cur_start = None
        cur_n = 0
        for pdf in batches:
            m = len(pdf)
            if not m:
                continue
            pid = int(pdf["pid"].iloc[0])
            if cur_k is None and pid in carry:
                cur_k, cur_t, cur_start, cur_n = carry[pid]
            ks = pdf["k"].to_numpy(dtype=object)
            ts = pdf["t"].to_numpy().astype(np.int64)
            prev_k = np.empty(m, dtype=object)
            prev_k[0], prev_k[1:] = cur_k, ks[:-1]
            same = prev_k == ks
            if cur_t is None:
                same[0] = False
            prev_t = np.r_[np.int64(cur_t if cur_t is not None else 0), ts[:-1]]
            gap = ts - prev_t
            start = ~same | (gap > gap_us)
            pos = np.arange(m)
            last = np.maximum.accumulate(np.where(start, pos, -1))
            has = last >= 0
            sess = np.where(has, ts[np.maximum(last, 0)], np.int64(cur_start if cur_start is not None else 0))
            seq = np.where(has, pos - last + 1, cur_n + pos + 1)
            gaps = pd.array(gap, dtype="Int64")
            gaps[~same] = pd.NA
            cur_k, cur_t, cur_start, cur_n = ks[-1], int(ts[-1]), int(sess[-1]), int(seq[-1])
            yield pd.DataFrame({"rid": pdf["rid"], "gap_us": gaps, "is_start": start,
                                "session_start_us": sess, "seq_in_session": seq})

    res = pts.mapInPandas(mark, "rid long, gap_us long, is_start boolean, session_start_us long, seq_in_session long")
    return (rows.join(res.withColumnRenamed("rid", "_row"), "_row", "left").drop("_row")
                .withColumns({"is_start": F.coalesce("is_start", F.lit(True)), "seq_in_session": F.coalesce("seq_in_session", F.lit(1))}))


def carry_last_sorted(df: DataFrame, key: str, order: str, tiebreak: str, values: Sequence[str],
                      suffix: str = "_last", inclusive: bool = True, partitions: int | None = None) -> DataFrame:
    """``carry_last`` whatever the density of a key: for each value column the
    last non-null value at (``inclusive``) or strictly before the row, along
    (order, tiebreak) within the key.

    Range-partitioned sort on (key, order, tiebreak); pass 1 keeps, per
    (partition, key), the last non-null value of each column; the carry into a
    partition exists only for its first key (at most one row per partition),
    resolved on the driver; pass 2 forward-fills each partition.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, vals = _numbered(df), list(values)
    vcols = [f"v{i}" for i in range(len(vals))]
    pts = (rows.select(_key_text(key).alias("k"), F.col(order).alias("o"), F.col(tiebreak).alias("tb"), F.col("_row").alias("rid"),
                       *[F.col(v).alias(c) for v, c in zip(vals, vcols)])
               .repartitionByRange(n, "k", "o", "tb", "rid").sortWithinPartitions("k", "o", "tb", "rid").drop("o", "tb"))
    pts = cut_lineage(pts.withColumn("pid", F.spark_partition_id()))
    types = ", ".join(f"{c} {pts.schema[c].dataType.simpleString()}" for c in vcols)

    def summary(batches):
        # Last value of each column for the first and the last key of a partition.
        first = cur = schema = None
        for b in batches:
            if not b.num_rows:
                continue
            ks, schema = b.column("k").to_numpy(zero_copy_only=False), b.schema
            new = np.r_[cur is None or ks[0] != cur["k"], ks[1:] != ks[:-1]]
            for lo, hi in _end_segments(new):
                if new[lo]:
                    first = first or cur
                    cur = {"pid": b.column("pid")[0].as_py(), "k": ks[lo], **dict.fromkeys(vcols)}
                for c in vcols:
                    known = b.column(c).slice(lo, hi - lo).drop_null()
                    if len(known):
                        cur[c] = known[-1].as_py()
        if cur:
            recs = [r for r in (first, cur) if r]
            names = ["pid", "k", *vcols]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in recs], schema.field(c).type) for c in names], names=names)

    boundary = sorted(pts.mapInArrow(summary, "pid int, k string, " + types).toArrow().to_pylist(), key=lambda r: (r["k"], r["pid"]))
    carry: dict[int, tuple] = {}
    prev_k, lastv = None, None
    for r in boundary:
        if r["k"] != prev_k:
            prev_k, lastv = r["k"], [None] * len(vcols)
        else:
            carry[r["pid"]] = (r["k"], list(lastv))
        lastv = [r[c] if r[c] is not None else lastv[i] for i, c in enumerate(vcols)]

    def fill(batches):
        # Forward fill per Arrow batch by positions; the current key's last values
        # come from the batch before or, for the first one, from the carry table.
        cur_k, cur = None, [None] * len(vcols)
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            pid = b.column("pid")[0].as_py()
            if cur_k is None and pid in carry:
                cur_k, cur = carry[pid][0], list(carry[pid][1])
            ks = b.column("k").to_numpy(zero_copy_only=False)
            new = np.r_[cur_k is None or ks[0] != cur_k, ks[1:] != ks[:-1]]
            pos = np.arange(m)
            begin = np.maximum.accumulate(np.where(new, pos, -1))   # -1: still the carried key
            out = [b.column("rid")]
            for j, c in enumerate(vcols):
                col = b.column(c)
                last = np.maximum.accumulate(np.where(col.is_valid().to_numpy(zero_copy_only=False), pos, -1))
                at = last if inclusive else np.r_[-1, last[:-1]]
                own = at >= np.maximum(begin, 0)
                pick = pa.array(np.where(own, at + 1, 0), pa.int64(), mask=~own & (begin >= 0))
                out.append(pa.concat_arrays([pa.array([cur[j]], col.type), col]).take(pick))   # 0 is the carried value
                end = int(last[-1])
                if end >= max(int(begin[-1]), 0):
                    cur[j] = col[end].as_py()
                elif begin[-1] >= 0:
                    cur[j] = None
            cur_k = ks[-1]
            yield pa.RecordBatch.from_arrays(out, names=["_row", *vcols])

    res = pts.mapInArrow(fill, "_row long, " + types).withColumnsRenamed({c: v + suffix for v, c in zip(vals, vcols)})
    return rows.join(res, "_row").drop("_row")
