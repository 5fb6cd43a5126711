"""Suffix-array dedup: depth-limited most-significant-digit radix sort.

Every ``depth``-byte string that starts earlier in the corpus (smaller document,
or the same document further left) is a repeat, and all bytes it covers go. The
suffixes are sorted only as deep as ``depth`` bytes and only as finely as needed:
each pass deals them by one more digit of their first ``depth`` bytes, groups of
one drop out, and the groups after the last pass are exactly the repeated
strings. A digit is the hash of a part of the window, from a short to the whole:

1. the window's smallest 32-byte gram (its anchor). Neighbouring windows share
   an anchor, so they travel as one segment; segments equal as a whole are
   settled at once, only segments that share the anchor but differ go on;
2. the 85 bytes common to an aligned block of 16 windows around the anchor;
3. the whole window.

Before a pass shuffles, each slice of about 2 MB settles what repeats inside it
and sends one row for each digit, so a passage in a third of all documents gives
one row for each slice and no hot group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm import text as T
from convlake.llm.frames import RID, attach, ints, keyed, plain, record, runs, stored

DEPTH = 100
ANCHOR = 32
BLOCK = 16
#: Kinds of rows in the passes; within a digit, a witness sorts first.
WITNESS, SINGLE, SHARED, REQUEST, SPAN = range(5)

_U = np.uint64
_LOW = _U(0xFFFFFF)
#: Rows of the widest shuffle: shape packs length, anchor offset and kind.
_ROW = pa.schema([("key", pa.int64()), ("tag", pa.int64()), (RID, pa.int64()), ("lo", pa.int64()), ("shape", pa.int64())])
_ROW_DDL = f"key long, tag long, {RID} long, lo long, shape long"
_OUT = pa.schema([("kind", pa.int8()), (RID, pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("at", pa.int32())])
_OUT_DDL = f"kind byte, {RID} long, lo long, hi long, at int"
_BLK = pa.schema([("key", pa.int64()), ("kind", pa.int8()), (RID, pa.int64()), ("lo", pa.int64()),
                  ("hi", pa.int64()), ("core", pa.int64()), ("mask", pa.int32()), ("context", pa.binary())])
_BLK_DDL = f"key long, kind byte, {RID} long, lo long, hi long, core long, mask int, context binary"
_WIN = pa.schema([("key", pa.int64()), ("kind", pa.int8()), (RID, pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_WIN_DDL = f"key long, kind byte, {RID} long, lo long, hi long"
_SPN = pa.schema([(RID, pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_SPN_DDL = f"{RID} long, lo long, hi long"


def merged(rid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each row; touching spans join."""
    if not len(rid):
        return rid, lo, hi
    o = np.lexsort((lo, rid))
    rid, lo, hi = rid[o], lo[o], hi[o]
    new = runs(rid)
    first = np.flatnonzero(new)
    # running maximum of hi inside each row: lift rows apart, then accumulate
    lift = (np.cumsum(new) - 1) * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + lift) - lift
    new[1:] |= lo[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return rid[first], lo[first], np.maximum.reduceat(hi, first)


def slide_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    span = 1
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = size - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _pieces(rid: np.ndarray, arr: pa.Array, depth: int):
    """(rids, bytes, offsets, shift): slices of rows; a text far longer than a
    slice comes in pieces that overlap by depth - 1 bytes."""
    for lo, hi, data, off in T.slices(arr):
        if hi - lo == 1 and len(data) > 2 * T.SLICE_BYTES:
            for a in range(0, len(data) - depth + 1, T.SLICE_BYTES):
                part = data[a: a + T.SLICE_BYTES + depth - 1]
                yield rid[lo: hi], part, np.array([0, len(part)]), a
        else:
            yield rid[lo: hi], data, off, 0


def segments(data: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one anchor: (row, start, windows, anchor
    offset from the start, anchor hash, hash of the whole run)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < depth:
        return none, none, none, none, none, none
    sums = T.Spans(data)
    grams = T.mix((sums.sum[ANCHOR:] - sums.sum[: n - ANCHOR + 1]) * sums.down[: n - ANCHOR + 1])
    best = slide_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), depth - ANCHOR + 1)
    edge = np.zeros(n - depth + 2, np.int8)
    full = np.diff(off) >= depth
    edge[off[:-1][full]] += 1
    edge[off[1:][full] - depth + 1] -= 1
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    turn = best[1:] != best[:-1]
    first, last = valid.copy(), valid.copy()
    first[1:] &= turn | ~valid[:-1]
    last[:-1] &= turn | ~valid[1:]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    anchor = (best[s] & _LOW).astype(np.int64)
    shape = ((anchor - s) * 1024 + (e - s)).astype(np.uint64)
    whole = T.mix(sums.hash(s, e + depth) + T.mix(shape))
    row = np.searchsorted(off, s, "right") - 1
    return row, s - off[row], e - s + 1, anchor - s, grams[anchor].view(np.int64), whole.view(np.int64)


def _shape(length: np.ndarray, at: np.ndarray, kind) -> np.ndarray:
    return (length << 20) | (at << 4) | kind


def _unpacked(rid: np.ndarray, lo: np.ndarray, shape: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    return record(_OUT, kind.astype(np.int8), rid, lo, lo + (shape >> 20), ((shape >> 4) & 0xFFFF).astype(np.int32))


def _cut_segments(depth: int):
    if depth > 60_000:
        raise ValueError("depth must be at most 60000 bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rids, data, off, shift in _pieces(ints(batch, RID), T.column(batch, "text"), depth):
                row, lo, n, at, key, tag = segments(data, off, depth)
                if not len(row):
                    continue
                rid, lo = rids[row], lo + shift
                o = np.lexsort((lo, rid, tag, key))
                rid, lo, n, at, key, tag = (x[o] for x in (rid, lo, n, at, key, tag))
                new = runs(key)
                rep = runs(key, tag)
                group = np.cumsum(new) - 1
                several = np.bincount(group, weights=rep)[group] > 1
                length = n + depth - 1
                spread = T.mix((rid * 1048573 + lo).astype(np.uint64)).view(np.int64)
                shape = _shape(length, at, np.where(several, REQUEST, SINGLE))
                r = np.flatnonzero(rep)
                yield record(_ROW, np.where(several, spread, key)[r], np.where(several, 0, tag)[r], rid[r], lo[r], shape[r])
                w = np.flatnonzero(new & several)
                zero = np.zeros(len(w), np.int64)
                yield record(_ROW, key[w], zero, zero, zero, zero + WITNESS)
                g = np.flatnonzero(~rep)
                sr, sl, sh = merged(rid[g], lo[g], (lo + length)[g])
                zero = np.zeros(len(sr), np.int64)
                yield record(_ROW, T.mix(sr.astype(np.uint64)).view(np.int64), zero, sr, sl, _shape(sh - sl, zero, SPAN))
    return run


def _match_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, tag, rid, lo). A segment equal to an earlier one is a
    span; if an anchor has different segments, or a slice's witness says so, the
    first of each is a request. Only one row and its group's state pass to the
    next batch."""
    carry, shared_before = None, False
    for batch in batches:
        cols = [ints(batch, f.name) for f in _ROW]
        kind = cols[4] & 15
        through = kind >= REQUEST
        if through.any():
            yield _unpacked(*(c[through] for c in cols[2:]), kind[through])
        cols = [c[~through] for c in cols]
        if not len(cols[0]):
            continue
        if carry is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(carry, cols)]
        key, tag, rid, lo, shape = cols
        kind = shape & 15
        new = runs(key)
        rep = runs(key, tag, kind) & (kind == SINGLE)
        again = ~rep & (kind == SINGLE)
        if shared_before:
            rep[0] = again[0] = False  # passed on already
        group = np.cumsum(new) - 1
        several = (np.bincount(group, weights=rep) > 1) | (np.bincount(group, weights=kind == WITNESS) > 0)
        several[0] |= shared_before
        for mask, what in ((rep & several[group], REQUEST), (again, SPAN)):
            i = np.flatnonzero(mask)
            if len(i):
                yield _unpacked(rid[i], lo[i], shape[i], np.full(len(i), what))
        shared_before = bool(several[-1])
        # of an open group with one segment so far, the first row is still pending
        keep = len(key) - 1 if shared_before else int(np.flatnonzero(new)[-1])
        carry = [c[keep: keep + 1] for c in cols]


def _lists(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and the flattened integer fields of a list<struct> column."""
    n = np.diff(np.asarray(col.offsets))
    flat = col.flatten()
    return np.concatenate([[0], np.cumsum(n)]), [f.to_numpy(zero_copy_only=False) for f in flat.flatten()]


def _cut_blocks(depth: int):
    pad = BLOCK - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid_all = ints(batch, RID)
            loff, (lo_all, hi_all, at_all) = _lists(batch.column("requests"))
            for a, b, data, off in T.slices(T.column(batch, "text")):
                r = slice(loff[a], loff[b])
                row = T.row_of(loff[a: b + 1] - loff[a])
                lo, n, at = lo_all[r], hi_all[r] - lo_all[r] - depth + 1, at_all[r].astype(np.int64)
                if not len(lo):
                    continue
                # aligned blocks of each request: x = anchor - start runs over [at - n + 1, at]
                first, last = (at - n + 1) // BLOCK, at // BLOCK
                k = last - first + 1
                q = np.repeat(np.arange(len(lo)), k)
                blk = np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k) + first[q]
                jmin = np.maximum((at - n + 1)[q] - BLOCK * blk, 0)
                jmax = np.minimum(at[q] - BLOCK * blk, pad)
                base = off[row[q]]
                origin = base + (lo + at)[q] - BLOCK * blk  # where the core starts
                sums = T.Spans(data)
                core = T.mix(sums.hash(origin, origin + depth - pad) + blk.astype(np.uint64))
                # every window of every block; a window seen further left or in a smaller row goes now
                m = jmax - jmin + 1
                p = np.repeat(np.arange(len(q)), m)
                j = np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m) + jmin[p]
                start = origin[p] - j
                h = sums.hash(start, start + depth)
                rid = rid_all[a:b][row[q]]
                wrid, wlo = rid[p], start - base[p]
                o = np.lexsort((wlo, wrid, h))
                seen = np.empty(len(p), bool)
                seen[o] = ~runs(h[o])
                sr, sl, sh = merged(wrid[seen], wlo[seen], wlo[seen] + depth)
                z = np.zeros(len(sr), np.int64)
                yield record(_BLK, T.mix(sr.astype(np.uint64)).view(np.int64), np.full(len(sr), SPAN, np.int8), sr, sl, sh, z,
                             z.astype(np.int32), pa.array([b""] * len(sr), pa.binary()))
                mask = np.bincount(p[~seen], weights=(1 << j[~seen]).astype(float), minlength=len(q)).astype(np.int64)
                live = np.flatnonzero(mask)
                if not len(live):
                    continue
                core, mask, rid, origin, base = core[live], mask[live], rid[live], origin[live], base[live]
                jmin, jmax = jmin[live], jmax[live]
                # pad bytes left and right of the core; those outside the block's windows are zero
                i = np.arange(pad)
                left = origin[:, None] - pad + i
                right = origin[:, None] + (depth - pad) + i
                inside_l = i[None, :] >= pad - jmax[:, None]
                inside_r = i[None, :] < pad - jmin[:, None]
                context = np.concatenate([np.where(inside_l, data[np.clip(left, 0, len(data) - 1)], 0),
                                          np.where(inside_r, data[np.clip(right, 0, len(data) - 1)], 0)], axis=1)
                o = np.argsort(core, kind="stable")
                core, mask, rid, pos, context = core[o], mask[o], rid[o], (origin - base)[o], context[o]
                new = runs(core)
                shared = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
                spread = T.mix((rid * 1048573 + pos).astype(np.uint64)).view(np.int64)
                ckey = core.view(np.int64)
                blob = pa.Array.from_buffers(pa.binary(), len(pos), [
                    None, pa.py_buffer((np.arange(len(pos) + 1) * 2 * pad).astype(np.int32)),
                    pa.py_buffer(np.ascontiguousarray(context, np.uint8))])
                yield record(_BLK, np.where(shared, spread, ckey), np.where(shared, SHARED, SINGLE).astype(np.int8), rid, pos, pos,
                             ckey, mask.astype(np.int32), blob)
                w = np.flatnonzero(new & shared)
                z = np.zeros(len(w), np.int64)
                yield record(_BLK, ckey[w], np.full(len(w), WITNESS, np.int8), z, z, z, z, z.astype(np.int32),
                             pa.array([b""] * len(w), pa.binary()))
    return run


def _match_blocks(depth: int):
    """Rows sorted by (key, kind): blocks whose core another block has become
    window rows; others drop out."""
    pad = BLOCK - 1
    bits = 1 << np.arange(BLOCK)

    def expand(rid, pos, core, mask, context) -> pa.RecordBatch:
        ctx = np.frombuffer(b"".join(context), np.uint8)
        p, j = np.nonzero(mask[:, None] & bits)
        sums = T.Spans(ctx)
        mid = p * 2 * pad + pad
        h = T.mix(sums.hash(mid - j, mid) * _U(3) + sums.hash(mid, mid + pad - j) * _U(7)
                  + core[p].view(np.uint64) + T.mix(j.astype(np.uint64)))
        lo = pos[p] - j
        return record(_WIN, h.view(np.int64), np.full(len(p), SINGLE, np.int8), rid[p], lo, lo + depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, shared_before = None, False
        for batch in batches:
            kind = ints(batch, "kind")
            spans = np.flatnonzero(kind == SPAN)
            if len(spans):
                s = batch.take(pa.array(spans))
                yield record(_WIN, *(ints(s, f.name) for f in _WIN))
            shared = np.flatnonzero(kind == SHARED)
            names = (RID, "lo", "core", "mask")
            if len(shared):
                s = batch.take(pa.array(shared))
                yield expand(*(ints(s, c) for c in names), s.column("context").to_pylist())
            rest = np.flatnonzero(kind <= SINGLE)
            if not len(rest):
                continue
            s = batch.take(pa.array(rest))
            if carry is not None:
                s = pa.Table.from_batches([carry, s]).combine_chunks().to_batches()[0]
            new = runs(ints(s, "key"))
            group = np.cumsum(new) - 1
            several = np.bincount(group) > 1
            if carry is not None and shared_before:
                several[0] = True
            give = several[group] & (ints(s, "kind") == SINGLE)
            if carry is not None and shared_before:
                give[0] = False
            t = np.flatnonzero(give)
            if len(t):
                x = s.take(pa.array(t))
                yield expand(*(ints(x, c) for c in names), x.column("context").to_pylist())
            shared_before = bool(several[-1])
            carry = s.slice(len(new) - 1)
    return run


def _match_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, rid, lo): every window but the first of a key."""
    last = None
    for batch in batches:
        key, kind, rid, lo, hi = (ints(batch, f.name) for f in _WIN)
        span = kind == SPAN
        if span.any():
            yield record(_SPN, rid[span], lo[span], hi[span])
        key, rid, lo, hi = key[~span], rid[~span], lo[~span], hi[~span]
        if not len(key):
            continue
        again = ~runs(key)
        again[0] = last is not None and key[0] == last
        last = key[-1]
        if again.any():
            yield record(_SPN, *merged(rid[again], lo[again], hi[again]))


def repeated_spans(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(_rid, lo, hi): byte ranges covered by a ``depth``-byte string that also
    starts earlier. Spans of a row may touch or overlap.

    ``texts`` has unique, not null ``_rid`` and ``text`` (null: empty). A text
    shorter than ``depth`` bytes has none.
    """
    if depth < ANCHOR + BLOCK + 2:
        raise ValueError(f"depth must be at least {ANCHOR + BLOCK + 2} bytes")
    texts = _dealt(texts)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = stored(texts.mapInArrow(_cut_segments(depth), _ROW_DDL).repartition(n, "key")
                   .sortWithinPartitions("key", "tag", RID, "lo").mapInArrow(_match_segments, _OUT_DDL), "segments")
    asked = (first.filter(F.col("kind") == REQUEST).groupBy(RID)
             .agg(F.collect_list(F.struct("lo", "hi", "at")).alias("requests")))
    windows = (texts.join(asked, RID).mapInArrow(_cut_blocks(depth), _BLK_DDL).repartition(n, "key")
               .sortWithinPartitions("key", "kind").mapInArrow(_match_blocks(depth), _WIN_DDL).repartition(n, "key")
               .sortWithinPartitions("key", RID, "lo").mapInArrow(_match_windows, _SPN_DDL))
    return first.filter(F.col("kind") == SPAN).select(RID, "lo", "hi").unionByName(windows)


def _dealt(texts: DataFrame) -> DataFrame:
    """One form of the texts for both joins, so that Spark shuffles them once."""
    return texts.select(RID, "text").filter(F.col(RID).isNotNull())


def _with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(_rid, text, spans): spans of a row as an array, null if none."""
    per = spans.groupBy(RID).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return _dealt(texts).join(per, RID, "left")


def _kept(batches: Iterator[pa.RecordBatch], whole_chars: bool):
    """(rid, text bytes, merged spans) of every row; with ``whole_chars`` spans
    shrink to whole UTF-8 characters."""
    for batch in batches:
        data, off = T.utf8(T.column(batch, "text"))
        rids = ints(batch, RID)
        col = batch.column("spans").fill_null([])
        loff, (lo, hi) = _lists(col)
        row, lo, hi = merged(T.row_of(loff), lo, hi)
        at = np.searchsorted(row, np.arange(len(rids) + 1))
        for i in range(len(rids)):
            raw = data[off[i]: off[i + 1]]
            a, b = lo[at[i]: at[i + 1]], hi[at[i]: at[i + 1]]
            if whole_chars and len(a):
                a, b = a.copy(), b.copy()
                for _ in range(3):  # at most three continuation bytes
                    a += (a < len(raw)) & ((raw[np.minimum(a, len(raw) - 1)] & 0xC0) == 0x80)
                    b -= (b < len(raw)) & ((raw[np.minimum(b, len(raw) - 1)] & 0xC0) == 0x80)
                ok = a < b
                a, b = a[ok], b[ok]
            yield rids[i], raw, a, b


def _rest(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    cuts = np.concatenate([[0], np.stack([lo, hi], 1).ravel(), [len(raw)]])
    whole = raw.tobytes()
    return b"".join(whole[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for rid, raw, lo, hi in _kept(batches, False):
        out.append((int(rid), len(raw), int((hi - lo).sum()), len(lo), hashlib.sha256(_rest(raw, lo, hi)).hexdigest()))
        if len(out) == 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(_REPORT.names, r)) for r in out], schema=_REPORT)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(_REPORT.names, r)) for r in out], schema=_REPORT)


_REPORT = pa.schema([(RID, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept_sha256", pa.string())])


def dedup_report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Null and empty texts give 0 bytes and the digest of nothing. Rows repeated
    with id and text count as one document and get the same result; different
    texts under one id (or under a null id, which sorts first) are ordered by the
    hash of the text. Other columns are ignored.
    """
    texts, rows = keyed(docs, text_col, id_col)
    report = _with_spans(texts, repeated_spans(texts, depth)).mapInArrow(
        _report, f"{RID} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    cols = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    if rows is None:
        return report.select(F.col(RID).alias(id_col), *cols)
    return rows.join(report, RID).select(F.col("_id").alias(id_col), *cols)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(RID, pa.int64()), ("text", pa.string()), ("n_removed", pa.int64())])
    out: list[dict] = []
    size = 0
    for rid, raw, lo, hi in _kept(batches, True):
        left = _rest(raw, lo, hi)
        out.append({RID: int(rid), "text": left.decode("utf-8", "replace"), "n_removed": len(raw) - len(left)})
        size += len(left)
        if size > 4 * T.SLICE_BYTES:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def without_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """``docs`` with repeated spans cut out of the texts; a span that would cut a
    UTF-8 character leaves the whole character in place. Rows left without a word
    go, so null and empty texts do. Rows repeated with id and text are one document
    and are cut alike. Ids may be of any type, and further columns of any name."""
    base, names = plain(docs)
    rows, unique = attach(base, names[text_col], names[id_col])
    texts = rows.select(RID, F.col(names[text_col]).alias("text"))
    texts = texts if unique else texts.dropDuplicates([RID])
    cut = (_with_spans(texts, repeated_spans(texts, depth)).mapInArrow(_texts, f"{RID} long, text string, n_removed long")
           .filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(RID, F.col("text").alias("_rest")))
    return (rows.drop(names[text_col]).join(cut, RID).withColumnRenamed("_rest", names[text_col]).select(*base.columns).toDF(*names))
