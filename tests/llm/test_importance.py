"""Importance resampling against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from convlake.llm import importance

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score string, _id int, buckets int"


def grams(t, n):
    w = WORD.findall((t or "").translate(LOWER))
    return len(w), [" ".join(w[i: i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def corpus():
    rng = random.Random(8)
    voc = ["the", "Of", "été", "x1", "中文", "Zeta", "q"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(voc) + rng.choice(["", ",", "\n", "--", "\x00"]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " .,! "), (203, "long" * 5000), (204, "a b " * 9000), (5, rows[5][1]), (5, rows[5][1]), (None, "the of " * 15)]
    return [(i, t, "s", 1, 2) for i, t in rows]


def expected(rows, target, n, buckets, percent, least):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    feats = [grams(r[1], n) for r in rows]
    s = collections.Counter(crc(f) for _, fs in feats for f in fs)
    t = collections.Counter(crc(f) for x in target for f in grams(x, n)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets))))
    out = []
    for (i, *_), (words, fs) in zip(rows, feats):
        w = sum(gain(crc(f)) for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("ngram, buckets, percent, least", [(1, 10_000, 10, 20), (3, 70_000, 40, 0), (2, 7, 100, 5)])
def test_resample(spark, ngram, buckets, percent, least):
    rows, target = corpus(), ["the of the x1", None, "", "zeta Q q w3 w4", "été " * 30]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, goal, ngram=ngram, buckets=buckets, percent=percent, min_words=least).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows, target, ngram, buckets, percent, least)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    goal = spark.createDataFrame([("the",)], "text string")
    assert importance.resample(none, goal).collect() == []
    got = importance.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), goal.limit(0)).first()
    assert got.n_features == 2 and got["rank"] is None


def test_joined_crc():
    rng = random.Random(2)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 5, 1000, 70_000]))) for _ in range(60)]
    a, b = parts[:30], parts[30:]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = importance.crc_join(crc(a), crc(b), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_scan_emits_every_word_once(monkeypatch):
    monkeypatch.setattr(importance, "DICTIONARY_BYTES", 300)
    texts = [r[1] or "" for r in corpus()]
    found = []
    for lo, hi, crc, size, off in importance.words_of(pa.array(texts, pa.large_string())):
        found += [list(zip(crc[a:b].tolist(), size[a:b].tolist())) for a, b in zip(off[:-1], off[1:])]
    assert found == [[(zlib.crc32(w.encode()), len(w.encode())) for w in grams(t, 1)[1]] for t in texts]
