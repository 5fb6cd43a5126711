"""DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import IntegralType

from convlake.session import checkpoint_dir

RID = "_rid"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared ``spark.checkpoint.dir`` and read
    it back: cuts the lineage, survives lost executors, evaluates once."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, bool]:
    """``docs`` with a long column ``_rid``, and whether it is unique.

    ``_rid`` is the id itself when ids are integers, unique and not null.
    Otherwise it numbers the different (id, text) pairs in the order null id first, id, text
    hash, so repeated rows share a number and get the same result.
    """
    ids = docs.select(F.col(id_col).alias("_id"))
    integers = isinstance(ids.schema["_id"].dataType, IntegralType)
    if integers and not ids.groupBy("_id").count().filter("count > 1 or _id is null").limit(1).count():
        return docs.withColumn(RID, F.col(id_col).cast("long")), True
    tagged = docs.withColumn("_rid_h", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    order = (tagged.select(F.col(id_col).alias("_id"), F.col("_rid_h").alias("_h")).distinct()
             .orderBy(F.asc_nulls_first("_id"), "_h"))
    numbers = (order.rdd.zipWithIndex().map(lambda p: (p[0][0], p[0][1], p[1]))
               .toDF(f"_rid_id {ids.schema['_id'].dataType.simpleString()}, _rid_k string, {RID} long"))
    joined = tagged.join(numbers, F.col(id_col).eqNullSafe(F.col("_rid_id")) & (F.col("_rid_h") == F.col("_rid_k")))
    return stored(joined.drop("_rid_h", "_rid_id", "_rid_k"), "numbered"), False


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named _c0, _c1, ..., which no helper column is, and
    these names by the columns' own."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def keyed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """(texts, rows): ``texts`` has one row (_rid, text) for each different
    document row; ``rows`` is (_rid, _id) for every input row, or None where _rid
    is the id. See ``attach``."""
    base, unique = attach(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")), "text", "_id")
    if unique:
        return base.select(RID, "text"), None
    return base.dropDuplicates([RID]).select(RID, "text"), base.select(RID, "_id")


def record(schema: pa.Schema, *cols) -> pa.RecordBatch:
    """A record batch from numpy arrays or Arrow arrays in schema order."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c), f.type)
         for c, f in zip(cols, schema, strict=True)], schema=schema)


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def runs(*keys: np.ndarray) -> np.ndarray:
    """True where any of the sorted key arrays differs from the row before."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new
