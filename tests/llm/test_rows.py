"""Ids of any type, repeated and null ids, empty tables and clashing columns: every
operator on documents, and every stage of the pipeline, answers as with plain rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from convlake.llm import collocations, decontaminate, importance, jaccard_join, mixing, quality_rules, suffix_dedup

ODD = "_rid string, _of int, copies string, _copies int, _k0 int, _c0 int, _id string, n_words int, component double, cid int"
BENCH = [("b1", " ".join(f"quiz{i}" for i in range(30))), ("b2", "too short"), ("b3", None)]


def texts() -> list:
    rng = random.Random(12)
    def prose(n):
        return " ".join(rng.choice(["river", "stone", "Grün", "the", "of", "lamp"]) + str(rng.randrange(40)) for _ in range(n))
    long = prose(120)
    out = [prose(rng.randint(25, 60)) for _ in range(20)]
    out += [long, long + " end", long, BENCH[0][1] + " and more", None, "", " \n", "one", prose(30) + "\n" + long]
    return out


def table(spark, kind: str):
    rows = [(i, t, "en", ["a", "b", None][i % 3], 1) for i, t in enumerate(texts())]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    if kind == "string":
        plain = plain.withColumn("doc_id", F.format_string("d%03d", "doc_id"))
    if kind == "decimal":
        plain = plain.withColumn("doc_id", F.col("doc_id").cast("decimal(30,0)"))
    if kind != "long":
        for c in ODD.split(", "):
            name, type_ = c.split(" ")
            plain = plain.withColumn(name, F.lit("7").cast(type_))
    return plain.repartition(3)


def operators(spark):
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    return {
        "op2": lambda d: mixing.mixture(d).select("doc_id", "size", "source_size", "target"),
        "op4": lambda d: quality_rules.quality_verdicts(d, labels(spark, d)).select("doc_id", "n_words", "kept"),
        "op5": lambda d: decontaminate.contamination_report(d, bench),
        "op6": lambda d: suffix_dedup.dedup_report(d),
        "op8": lambda d: jaccard_join.similar_groups(d),
        "op12": lambda d: importance.resample(d, bench).select("doc_id", "n_features", "weight"),
        "op13": lambda d: collocations.collocations(d, min_count=3),
    }


def labels(spark, docs):
    return docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))


def number(x):
    return int(str(x).lstrip("d")) if x is not None else None


def result(df):
    names = df.columns
    return sorted((tuple(number(v) if c in ("doc_id", "component_id") else v for c, v in zip(names, r)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op2", "op4", "op5", "op6", "op8", "op12", "op13"])
def test_operators(spark, name):
    run = operators(spark)[name]
    want = result(run(table(spark, "long")))
    for kind in ("string", "decimal") if name == "op6" else ("string",):
        assert result(run(table(spark, kind))) == want, kind
    assert want
    empty = run(table(spark, "string").limit(0))
    assert empty.collect() == []


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages(spark, tmp_path, name):
    def run(docs):
        labels(spark, docs).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(BENCH, "item_id string, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        out = STAGES[name](spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        return out

    cols = ["doc_id", "text", "lang", "source"]
    docs = table(spark, "long")
    want = result(run(docs).select(cols))
    for kind in ("string",):
        out = run(table(spark, kind))
        rows = out.collect()
        assert result(out.sparkSession.createDataFrame(rows, out.schema).select(cols)) == want, kind
        if name != "mix_sources":
            assert out.columns == table(spark, kind).columns and {r._rid for r in rows} == {"7"}
    assert 0 < len(want) <= docs.count()
    assert run(table(spark, "string").limit(0)).collect() == []
    ids = {r[0] for r in want}
    if name == "jaccard_join":
        assert 20 in ids and 21 not in ids and 22 not in ids and ids >= set(range(20))
    if name == "decontaminate":
        assert set(range(docs.count())) - ids == {23}
    if name == "suffix_dedup":
        t = {r[0]: r[1] for r in want}
        assert 22 not in t and t[20] == texts()[20] and len(t[28]) < len(texts()[28])
    if name == "mix_sources":
        assert {r.copies for r in run(docs).collect()} <= {1, 2, 3}


def test_repeated_rows(spark):
    docs = table(spark, "string")
    twice = docs.union(docs)
    once = result(suffix_dedup.dedup_report(docs))
    assert result(suffix_dedup.dedup_report(twice)) == sorted(once * 2, key=repr)
    assert result(jaccard_join.one_of_each(twice).select("doc_id")) == result(jaccard_join.one_of_each(docs).select("doc_id"))


def test_run_is_its_stages(spark, tmp_path):
    docs = table(spark, "long").drop("n_chars").withColumn("n_chars", F.length("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, docs).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    step = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        step.write.parquet(f"{tmp_path}/step{k}")
        step = stage(spark, spark.read.parquet(f"{tmp_path}/step{k}"), str(tmp_path))
    assert result(got) == result(step) and got.count()
    assert all(r.n_chars == len(r.text) for r in got.collect())
