"""Mixing sources to target token weights by entropy balancing.

Each document gets a rate between 0 and ``MAX_COPIES``. The rates are the closest
to 1 (least relative entropy) for which every source yields its target number of
tokens; that solution is exponentially tilted, rate = min(MAX_COPIES,
exp(lambda_source * size / mean size)). The duals solve one concave equation per
source by safeguarded Newton steps. Gradient and curvature are summed by Spark on
the table of (source, size, documents), which equal documents share, and only one
row for each source goes from step to step. Rates become copies by carrying the
rounding error from larger to smaller documents inside (source, bucket) groups of
bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm.frames import plain, stored

MAX_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one rounding group, about.
GROUP_ROWS = 20_000
STEPS = 60
TOLERANCE = 1e-6


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, mean, target): sources by code point, null last, take
    the weights in turn and share all tokens; a target stops at ``most`` times its
    source's tokens and the excess goes to the others by weight."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg(F.when(F.col("size") > 0, F.col("size"))).alias("mean"))
    kind = sizes.schema["source"].dataType.simpleString()
    k = len(weights)
    ranked = (by.orderBy(F.asc_nulls_last("source")).rdd.zipWithIndex()
              .map(lambda p: (*p[0], float(weights[p[1] % k])))
              .toDF(f"source {kind}, source_size long, mean double, weight double"))
    # a source without tokens can take none; level: tokens for each unit of weight of the sources below their stop
    ranked = stored(ranked, "sources")
    level = 0.0
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.col("weight") * level >= most * F.col("source_size")
        sums = ranked.agg(F.sum(F.when(full, most * F.col("source_size")).otherwise(0)).alias("taken"),
                          F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not sums["open"]:
            break
        step = (total - sums["taken"]) / sums["open"]
        if step <= level:
            break
        level = step
    target = F.least(F.col("weight") * F.lit(float(level)), (most * F.col("source_size")).cast("double"))
    return ranked.select("source", "source_size", "mean", target.alias("target"))


def balance(sizes: DataFrame, targets: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """(source, dual): solves sum(size * min(most, exp(dual * size / mean))) =
    target for each source; a source whose target is ``most`` times its tokens
    has an infinite dual."""
    held = stored(sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("docs")), "sizes")
    top = float(np.log(most))
    state = stored(targets.select("source", "mean", "target", F.lit(0.0).alias("dual"),
                                  F.coalesce(-60.0 * F.col("mean"), F.lit(0.0)).alias("low"),
                                  (top * F.col("mean")).alias("high"),
                                  (F.col("target") >= most * F.col("source_size")).alias("done"))
                   .withColumn("high", F.coalesce("high", F.lit(0.0))), "duals")
    # sizes are at least 1: at the bounds every rate is next to 0, or at its stop
    for _ in range(STEPS):
        if not state.filter(~F.col("done")).limit(1).count():
            break
        x = F.col("size") / F.col("mean")
        z = F.col("dual") * x
        open_ = z < top
        rate = F.when(open_, F.exp(z)).otherwise(F.lit(float(most)))
        w = F.col("docs") * F.col("size")
        sums = (held.alias("h").join(state.filter(~F.col("done")).alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
                .groupBy("s.source").agg(F.sum(w * rate).alias("got"), F.sum(F.when(open_, w * x * rate).otherwise(0.0)).alias("slope"))
                .withColumnRenamed("source", "of"))
        gap = F.col("target") - F.col("got")
        low = F.when(gap > 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("high")).otherwise(F.col("dual"))
        newton = F.col("dual") + gap / F.nullif(F.col("slope"), F.lit(0.0))
        nxt = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        close = F.abs(gap) <= TOLERANCE * F.col("target")
        state = stored(
            state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
            .select("source", "mean", "target",
                    F.when(F.col("done") | close | F.col("got").isNull(), F.col("dual")).otherwise(nxt).alias("dual"),
                    F.coalesce(low, "low").alias("low"), F.coalesce(high, "high").alias("high"),
                    (F.col("done") | F.coalesce(close, F.lit(True))).alias("done")), "duals")
    return state.join(targets.select(F.col("source").alias("of"), "source_size", F.col("target").alias("goal")),
                      F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "mean", F.when(F.col("goal") >= most * F.col("source_size"), F.lit(float("inf"))).otherwise(F.col("dual")).alias("dual"))


def _rounded(most: int):
    """Copies of one group's documents, larger first: each takes the whole number
    that leaves the smallest error in tokens so far."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "tie", "n"], ascending=[False, True, True], kind="stable")
        copies = np.zeros(len(g), np.int64)
        error = 0.0
        for i, (size, rate) in enumerate(zip(g["size"].to_numpy(float), g["rate"].to_numpy(float))):
            c = min(max(int(np.floor(error / size + rate + 0.5)), 0), most)
            error += (rate - c) * size
            copies[i] = c
        return pd.DataFrame({"n": g["n"], "copies": copies})
    return run


def mixture(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), id_col: str = "doc_id", source_col: str = "source",
            text_col: str = "text", most: int = MAX_COPIES) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies) of every row.

    Size is the number of words of the text (null: 0). A row without words has
    copies 1 and takes nothing. A null source is the last source. Rows repeated
    with id, source and size are equal documents and are rounded one by one. An
    empty table gives an empty result.
    """
    sized = stored(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
                   .withColumn("n", F.monotonically_increasing_id()), "words")
    targets = stored(source_targets(sized, weights, most), "targets")
    duals = balance(sized, targets, most)
    counts = sized.groupBy("source").agg(F.count("*").alias("rows"))
    known = (targets.alias("t").join(duals.alias("d"), F.col("t.source").eqNullSafe(F.col("d.source")))
             .join(counts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")))
             .select(F.col("t.source").alias("of"), "source_size", "target", "t.mean", "dual", "rows"))
    raw = F.exp(F.least(F.col("dual") * F.col("size") / F.col("mean"), F.lit(float(np.log(most)))))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("dual") == float("inf"), float(most)).otherwise(F.least(raw, F.lit(float(most))))
    tie = F.xxhash64(F.col("_id").cast("string"))
    bucket = F.pmod(tie, F.ceil(F.col("rows") / GROUP_ROWS).cast("long"))
    rated = stored(sized.join(known, F.col("source").eqNullSafe(F.col("of")))
                   .select("n", "_id", "source", "size", "source_size", "target", rate.alias("rate"), tie.alias("tie"), bucket.alias("bucket")),
                   "rates")
    copies = (rated.filter("size > 0").groupBy("source", "bucket").applyInPandas(
        lambda g: _rounded(most)(g[["n", "size", "rate", "tie"]]), "n long, copies long"))
    return rated.join(copies, "n", "left").select(
        F.col("_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate",
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), id_col: str = "doc_id", source_col: str = "source",
          text_col: str = "text", most: int = MAX_COPIES) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their ``copies`` (a column of
    that name is replaced). Rows that repeat an id take the largest number of
    copies that any of them got. Rows without words stay once. Ids may be of any
    type, and further columns of any name."""
    base, names = plain(docs.drop("copies"))
    copies = (mixture(base, weights, names[id_col], names[source_col], names[text_col], most).groupBy(F.col(names[id_col]).alias("_of"))
              .agg(F.max("copies").alias("copies")).filter("copies > 0"))
    return (base.join(copies, F.col(names[id_col]).eqNullSafe(F.col("_of"))).select(*base.columns, "copies")
            .toDF(*names, "copies"))
