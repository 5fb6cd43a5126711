"""Importance resampling towards a target by hashed n-gram features.

Words are found by an Aho-Corasick automaton. Its dictionary holds the different
words of a slice of texts, each between delimiters, with the word's CRC-32 and
length as payload; as keys begin and end with a delimiter, a scan emits exactly one
payload for every word, in order. The CRC of a run of words follows from the
payloads of its words: crc(a + b) is crc(a) shifted by the bytes of b, xor crc(b).
So no n-gram is ever built as a string. A feature's bucket is its CRC modulo the
number of buckets.

Counts per bucket are summed by Spark (at most one row per bucket and slice is
shuffled); a bucket's gain is the scaled logarithm of its share in the target
against its share in the documents. The documents' buckets are written once, in the
shared folder, and scored from there. Documents are drawn by their weight plus a
Gumbel number from a hash of the id, so reruns agree, ranked by one global sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm import text as T
from convlake.llm.frames import stored

BUCKETS = 10_000
NGRAM = 1
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Text handled at once by one automaton.
DICTIONARY_BYTES = 4 << 20

_OFF = np.full(256, 32, np.uint8)
_OFF[48:58] = np.arange(48, 58)
_OFF[65:91] = np.arange(97, 123)
_OFF[97:123] = np.arange(97, 123)
_OFF[128:] = np.arange(128, 256)

_WORD = _OFF != 32
_U32 = np.uint32


def _zero_byte() -> np.ndarray:
    """CRC-32's table: the register after one more zero byte, by its low byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> _U32(1)) ^ _U32(0xEDB88320), t >> _U32(1))
    return t


def _shift_tables() -> list[np.ndarray]:
    """For k = 0, 1, ...: tables (4, 256) that shift a CRC by 2 ** k zero bytes."""
    first = _zero_byte()
    step = lambda c: (c >> _U32(8)) ^ first[c & _U32(255)]
    bytes_ = np.arange(256, dtype=np.uint32)
    out = [np.stack([step(bytes_ << _U32(8 * j)) for j in range(4)])]
    while len(out) < 31:
        t = out[-1]
        out.append(np.stack([_through(t, t[j]) for j in range(4)]))
    return out


def _through(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & _U32(255)] ^ t[1][(c >> _U32(8)) & _U32(255)] ^ t[2][(c >> _U32(16)) & _U32(255)] ^ t[3][c >> _U32(24)]


SHIFTS = _shift_tables()


def crc_join(left: np.ndarray, right: np.ndarray, right_size: np.ndarray) -> np.ndarray:
    """CRC-32 of a + b for arrays of crc(a), crc(b) and b's bytes."""
    out, size, k = left.astype(np.uint32), np.asarray(right_size, np.int64), 0
    while (size >> k).any():
        odd = (size >> k & 1).astype(bool)
        out[odd] = _through(SHIFTS[k], out[odd])
        k += 1
    return out ^ right.astype(np.uint32)


def words_of(arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, crc and size of every word, the words' offsets by
    row) for slices of the texts."""
    import ahocorasick

    for lo, hi, data, off in T.slices(arr, DICTIONARY_BYTES):
        flat = _OFF[data]
        # each row between spaces: row i's bytes move by i + 1
        rows = np.diff(off)
        out = np.full(len(flat) + len(rows) + 1, 32, np.uint8)
        out[np.arange(len(flat)) + np.repeat(np.arange(1, len(rows) + 1), rows)] = flat
        raw = out.tobytes()
        automaton = ahocorasick.Automaton()
        payloads = []
        for word in set(raw.decode().split(" ")):
            if word:
                b = word.encode()
                automaton.add_word(f" {word} ", len(payloads))
                payloads.append((zlib.crc32(b), len(b)))
        starts, _, woff = T.words(data, off, _WORD)
        if not payloads:
            yield lo, hi, np.zeros(0, np.uint32), np.zeros(0, np.int64), woff
            continue
        automaton.make_automaton()
        found = np.fromiter((k for _, k in automaton.iter(raw.decode())), np.int64, len(starts))
        crc, size = np.array(payloads, np.int64).T
        yield lo, hi, crc[found].astype(np.uint32), size[found], woff


def features(crc: np.ndarray, size: np.ndarray, woff: np.ndarray, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to ``ngram`` words of each row, row by row, and their
    offsets."""
    if ngram == 1 or not len(crc):
        return crc, woff
    space = _U32(zlib.crc32(b" "))
    spaced = crc_join(np.full(len(crc), space), crc, size)  # " " + word
    parts, rows = [crc], [T.row_of(woff)]
    for n in range(2, ngram + 1):
        at, off = T.windows(woff, n)
        whole = crc[at]
        for j in range(1, n):
            whole = crc_join(whole, spaced[at + j], size[at + j] + 1)
        parts.append(whole)
        rows.append(T.row_of(off))
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return np.concatenate(parts)[order], np.searchsorted(rows[order], np.arange(len(woff)))


def _bucketed(ngram: int, buckets: int, schema: pa.Schema):
    kind = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, crc, size, woff in words_of(T.column(batch, "_text")):
                f, off = features(crc, size, woff, ngram)
                packed = (f % _U32(buckets)).astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(lo, hi - lo), pa.array(np.diff(woff), pa.int64()), pa.array(np.diff(off), pa.int64()),
                     pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((off * kind.itemsize).astype(np.int32)), pa.py_buffer(packed)])],
                    schema=schema)
    return run


def feature_table(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ngram: int = NGRAM,
                  buckets: int = BUCKETS) -> DataFrame:
    """(_id, n_words, n_features, buckets) of every row; ``buckets`` holds the
    bucket of each feature, repeats included, as little-endian integers of 16 bits
    (32 above 65,536 buckets). Null and empty texts have none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    if not 1 <= buckets <= 1 << 22:
        raise ValueError("from 1 to 4,194,304 buckets: one gain for each is broadcast")
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = StructType([base.schema["_id"], StructField("n_words", LongType()), StructField("n_features", LongType()),
                         StructField("buckets", BinaryType())])
    return base.mapInArrow(_bucketed(ngram, buckets, to_arrow_schema(schema)), schema)


def _packed(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a batch's rows end to end, and the rows' offsets."""
    kind = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")
    col = batch.column("buckets").cast(pa.large_binary())
    n = len(col)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset: col.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw).view(kind), (off - off[0]) // kind.itemsize


def _sums(buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_packed(batch, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], schema=schema)
    return run


def bucket_counts(table: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the buckets that a ``feature_table`` holds."""
    return (table.select("buckets").mapInArrow(_sums(buckets), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_gains(table: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln) of its smoothed share in
    ``target`` over that in ``table`` (two feature tables)."""
    all_ = table.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = (all_.join(bucket_counts(table, buckets).withColumnRenamed("n", "s"), "bucket", "left")
            .join(bucket_counts(target, buckets).withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"]))
    both = stored(both, "buckets")
    whole, wanted = both.agg(F.sum("s"), F.sum("t")).first()
    d = lambda c, k: (F.col(c) + F.lit(k)).cast("double")
    share = d("t", 1) * F.lit(float(whole + buckets)) / (d("s", 1) * F.lit(float(wanted + buckets)))
    return both.select("bucket", F.floor(1000 * F.ln(share)).cast("long").alias("gain"))


def _weighed(gains, buckets: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, off = _packed(batch, buckets)
            weight = T.per_row(gains.value[found], off)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("n_words"), batch.column("n_features"),
                                              pa.array(weight, pa.int64())], schema=schema)
    return run


def noise(id_: Column, seed: int = SEED) -> Column:
    """floor(1000 g) of a Gumbel number g from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        k = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(k, part), pa.int32()), pa.array(np.arange(n, n + k), pa.int64())],
                                         [*batch.schema.names, "_part", "_pos"])
        n += k


def globally_ranked(df: DataFrame, order: list[Column], rank_col: str = "rank") -> DataFrame:
    """``df`` with its rows' places 1, 2, 3, ... under ``order``, which is to end
    with a unique key: sorted by ranges, written once, and each range's rows
    numbered after those before it (one count per range is collected)."""
    schema = df.selectExpr("*", "0 as _part", "0L as _pos").schema
    placed = stored(df.orderBy(*order).mapInArrow(_positions, schema), "ranked")
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for part, n in counts:
        rows.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(rows, "_part int, _before long")
    return (placed.join(F.broadcast(starts), "_part").withColumn(rank_col, F.col("_before") + F.col("_pos") + 1)
            .drop("_part", "_pos", "_before"))


def resample(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_text_col: str = "text",
             ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT,
             min_words: int = MIN_WORDS) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``.

    Of the N rows with at least ``min_words`` words, the floor(percent * N / 100)
    of the highest scores are drawn and ranked, ties by the smaller id (null
    first); the others have no rank. Null and empty texts have weight 0. Repeated
    rows are rows of their own with one score. An empty target leaves smoothed
    gains; an empty table gives an empty result.
    """
    table = stored(feature_table(docs, text_col, id_col, ngram, buckets), "features")
    wanted = stored(feature_table(target.select(F.lit(0).alias("_t"), F.col(target_text_col).alias("_x")), "_x", "_t", ngram, buckets), "target")
    gain = np.zeros(buckets, np.int64)
    for r in bucket_gains(table, wanted, buckets).collect():  # one row per bucket
        gain[r["bucket"]] = r["gain"]
    gains = docs.sparkSession.sparkContext.broadcast(gain)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([table.schema["_id"], *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))])
    scored = (table.mapInArrow(_weighed(gains, buckets, to_arrow_schema(schema)), schema)
              .withColumn("score", F.col("weight") + noise(F.col("_id"), seed)).withColumn("_open", F.col("n_words") >= min_words))
    out = globally_ranked(scored, [F.desc("_open"), F.desc("score"), F.asc_nulls_first("_id"), "weight", "n_features"])
    drawn = percent * out.filter("_open").count() // 100
    return out.select(F.col("_id").alias(id_col), "n_features", "weight", "score",
                      F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def oracle() -> str:
    """DuckDB SQL of ``resample`` with its defaults: a CRC-32 by table over each
    different word's bytes."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def found(table: str, key: str) -> str:
        return (f"SELECT {key} AS k, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), "
                rf"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM {table}")

    return f"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, b FROM range(256) r(b) UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS entries FROM bits WHERE k = 8),
d AS MATERIALIZED ({found('documents', 'doc_id')}), b AS MATERIALIZED ({found('benchmark', '0')}),
voc AS MATERIALIZED (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM d UNION SELECT word FROM b)),
steps(word, h, i, c) AS (
  SELECT word, h, 0, 4294967295::BIGINT FROM voc UNION ALL
  SELECT word, h, i + 1, xor(c >> 8, (SELECT entries FROM crc)[1 + (xor(c, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) & 255)])
  FROM steps WHERE 2 * i < length(h)),
bucket AS MATERIALIZED (SELECT word, xor(c, 4294967295) % {BUCKETS} AS bucket FROM steps WHERE 2 * i = length(h)),
s AS (SELECT bucket, count(*) AS s FROM d JOIN bucket USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN bucket USING (word) GROUP BY bucket),
counts AS (SELECT r.bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t
  FROM range({BUCKETS}) r(bucket) LEFT JOIN s ON s.bucket = r.bucket LEFT JOIN t ON t.bucket = r.bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (S_ + {BUCKETS}) / ((s + 1) * (T_ + {BUCKETS}))))::BIGINT AS gain
  FROM counts, (SELECT sum(s) AS S_, sum(t) AS T_ FROM counts)),
w AS (SELECT k AS doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM d JOIN bucket USING (word) JOIN gains USING (bucket) GROUP BY k),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN w USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_features >= {MIN_WORDS}) AS rows_ FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= {MIN_WORDS} AND place <= {PERCENT} * rows_ // 100 THEN place END AS rank FROM ranked"""
