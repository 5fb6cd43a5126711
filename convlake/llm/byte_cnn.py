"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes run over the whole text. A byte has a learned vector
for each place in a filter, so a filter's value is a sum of table entries. The
values are rectified and averaged inside chunks that overlap by half and cover
the text from its first to its last byte; each filter's largest chunk is kept
(max-pooling) and a logistic layer gives one probability. The network is fitted
on the driver on a bounded sample of labelled rows (``SAMPLE``), and scores every
row inside Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm import text as T

WIDTH, FILTERS = 6, 16
STRIDE, CHUNK = 2, 128  # a chunk is CHUNK filter places, STRIDE bytes apart
#: Labelled rows of each class that the network is fitted on, at most, of texts up to so many bytes.
SAMPLE, SAMPLE_BYTES = 400, 16_384
EPOCHS, RATE, SEED = 12, 0.02, 7
THRESHOLD = 0.3


def chunk_means(tables: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean rectified filter values of all chunks, and the chunks' offsets by row.
    Rows are laid out with zero bytes after them, up to whole half chunks."""
    half = CHUNK // 2
    n = np.diff(off)
    halves = np.maximum(-(-n // (half * STRIDE)), 1) + 1  # the last half is padding, so every place has its chunk
    size = halves * half * STRIDE
    at = np.cumsum(size) - size
    padded = np.zeros(int(size.sum()) + WIDTH, np.uint8)
    padded[np.arange(len(data)) + np.repeat(at - off[:-1], n)] = data
    places = np.arange(0, int(size.sum()), STRIDE)
    value = tables[0][padded[places]]
    for j in range(1, WIDTH):
        value += tables[j][padded[places + j]]
    np.maximum(value, 0, out=value)
    sums = value.reshape(-1, half, FILTERS).sum(1)
    # places that hold text, so that padding does not thin out the means
    real = np.clip(np.repeat(n, halves) - (np.arange(len(sums)) - np.repeat(np.cumsum(halves) - halves, halves)) * half * STRIDE, 0, half * STRIDE)
    count = -(-real // STRIDE)
    held = np.arange(len(places)).reshape(-1, half) % half < count[:, None]
    sums = (value.reshape(-1, half, FILTERS) * held[:, :, None]).sum(1) if not held.all() else sums
    coff = np.concatenate([[0], np.cumsum(halves - 1)])
    first = np.arange(coff[-1]) + np.repeat(np.arange(len(n)), halves - 1)
    total = np.maximum(count[first] + count[first + 1], 1)
    return (sums[first] + sums[first + 1]) / total[:, None], coff


def pooled(tables: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Largest chunk of every filter for each row."""
    means, coff = chunk_means(tables, data, off)
    return np.maximum.reduceat(means, coff[:-1], axis=0)


class ByteCNN:
    def __init__(self, tables: np.ndarray, weight: np.ndarray, bias: float, scale: np.ndarray) -> None:
        self.tables, self.weight, self.bias, self.scale = tables, weight, bias, scale

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = (pooled(self.tables, data, off) / self.scale) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, prior: float) -> ByteCNN:
    """Adam on the logistic loss; classes weigh the same in it, and ``prior`` (the
    share of label 1 among all labelled rows) shifts the result back."""
    rng = np.random.default_rng(SEED)
    tables = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
    weight = rng.normal(0, 0.1, FILTERS).astype(np.float32)
    bias = np.zeros(1, np.float32)
    if not len(texts) or len(set(labels.tolist())) < 2:
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return ByteCNN(tables, np.zeros(FILTERS, np.float32), float(np.log(p / (1 - p))), np.ones(FILTERS, np.float32))
    params = [tables, weight, bias]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    share = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    step, half = 0, CHUNK // 2
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 32)):
            data = np.frombuffer(b"".join(texts[i] for i in batch), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in batch])])
            means, coff = chunk_means(tables, data, off)
            best = np.stack([coff[i] + means[coff[i]: coff[i + 1]].argmax(0) for i in range(len(batch))])
            x = np.take_along_axis(means, best, 0)
            d = (1 / (1 + np.exp(-(x @ weight + bias))) - labels[batch]) * share[batch] / len(batch)
            grads = [np.zeros_like(tables), x.T @ d, np.array([d.sum()], np.float32)]
            # only the winning chunks pass a gradient on, at places where the filter is open
            row = np.repeat(np.arange(len(batch)), FILTERS)
            begin = off[row] + (best.ravel() - coff[row]) * half * STRIDE
            place = begin[:, None] + np.arange(CHUNK) * STRIDE
            inside = place + WIDTH <= off[row + 1][:, None]
            bytes_at = data[np.minimum(place[:, :, None] + np.arange(WIDTH), len(data) - 1)]
            f = np.tile(np.arange(FILTERS), len(batch))
            value = tables[np.arange(WIDTH), bytes_at, f[:, None, None]].sum(2)
            g = np.where(inside & (value > 0), (d[row] * weight[f] / np.maximum(inside.sum(1), 1))[:, None], 0)
            np.add.at(grads[0], (np.broadcast_to(np.arange(WIDTH), bytes_at.shape), bytes_at,
                                 np.broadcast_to(f[:, None, None], bytes_at.shape)), np.broadcast_to(g[:, :, None], bytes_at.shape))
            step += 1
            for p, gr, a, b in zip(params, grads, m, v):
                a *= 0.9
                a += 0.1 * gr
                b *= 0.999
                b += 0.001 * gr * gr
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    p = min(max(prior, 1e-3), 1 - 1e-3)
    return ByteCNN(tables, weight, float(bias[0] + np.log(p / (1 - p))), np.ones(FILTERS, np.float32))


def is_held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label: str = "quality") -> ByteCNN:
    """A network fitted on up to SAMPLE rows of each label (by hash of the id)
    that are not held out."""
    marks = (labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_l"), F.col(label).alias("_y"))
             .filter(~is_held_out(F.col("_l"))).distinct())
    counts = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    order = F.xxhash64(F.col("_l").cast("string"))
    # some more than needed, as texts may be too long or missing
    picked = [marks.filter(F.col("_y") == y).orderBy(order, "_l").limit(2 * SAMPLE) for y in (0, 1)]
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
            .join(F.broadcast(picked[0].union(picked[1])), F.col("_id") == F.col("_l"))
            .filter(F.octet_length("_t") <= SAMPLE_BYTES)
            .select("_y", "_t", F.xxhash64(F.col("_id").cast("string")).alias("_o")).collect())
    rows.sort(key=lambda r: (r["_o"], r["_y"], r["_t"]))
    chosen = [r for y in (0, 1) for r in [r for r in rows if r["_y"] == y][:SAMPLE]]
    return fit([r["_t"].encode() for r in chosen], np.array([r["_y"] for r in chosen], np.float32), prior)


def _scores(net, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in T.slices(T.column(batch, "_text"), T.SLICE_BYTES // 4):
                s = net.value.score(data, off)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_held"), pa.array(s.astype(np.float64))], schema=schema)
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label: str = "quality",
                   threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    The score depends on the text alone; null counts as empty, and empty texts
    get the score of no evidence. Without labels of both kinds every row gets the
    share of label 1. A null id is held out by its empty text form.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col, id_col, label))
    base = docs.select(F.col(id_col).alias("_id"), is_held_out(F.col(id_col)).alias("_held"), F.col(text_col).alias("_text"))
    schema = StructType([base.schema["_id"], StructField("_held", BooleanType()), StructField("score", DoubleType())])
    out = base.mapInArrow(_scores(net, to_arrow_schema(schema)), schema)
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
