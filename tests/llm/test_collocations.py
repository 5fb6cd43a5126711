"""Collocations against plain Python."""

import collections
import random
import re

import pytest

from convlake.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, phrase string, n int, h int"


def corpus():
    rng = random.Random(6)
    voc = ["the", "Of", "été", "x#", "中文", "a\x00b", "q", "new", "York"]
    def line():
        return "".join(rng.choice(voc) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "! "]) for _ in range(rng.randint(0, 60)))
    rows = [(i, line() + rng.choice(["", "big red york mill ", "new york city hall. "]) * rng.randint(0, 3),
             rng.choice(["en", "en", "en", "de", None])) for i in range(400)]
    rows += [(500, None, "en"), (501, "", None), (502, " .;, ", "fr"), (503, "z" * 4000, "fr"), (504, "same same " * 400, "fr"), (0, *rows[0][1:])]
    return [(*r, "p", 1, 2) for r in rows]


def counted(rows, most):
    f = collections.defaultdict(collections.Counter)
    for _, t, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i: i + k]) for i in range(len(w) - k + 1))
    return f


def expected(rows, most=4, least=30, covered=80, top=2000):
    out = []
    for lang, f in counted(rows, most).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        best = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * c >= covered * a and any(q[i: i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, c in cand.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("args", [{}, {"min_count": 5, "covered_percent": 60, "top": 40}, {"max_words": 2, "min_count": 2}, {"max_words": 6, "min_count": 12}])
def test_collocations(spark, args):
    rows = corpus()
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), **args).collect()
    names = dict(zip(("max_words", "min_count", "covered_percent", "top"), ("most", "least", "covered", "top")))
    assert sorted(tuple(r) for r in got) == expected(rows, **{names[k]: v for k, v in args.items()})
    assert got


def test_every_count_of_every_part(spark):
    rows = corpus()
    f = counted(rows, 4)
    found, sizes = collocations.phrases(spark.createDataFrame(rows, SCHEMA).repartition(3), min_count=7)
    got = {(r.lang, tuple(r.phrase.split(" "))): r for r in found.collect()}
    assert set(got) == {(g, p) for g in f for p, c in f[g].items() if c >= 7}
    for (g, p), r in got.items():
        assert r.f == f[g][p]
        assert r.heads == [f[g][p[:k]] for k in range(1, len(p) + 1)] and r.tails == [f[g][p[-k:]] for k in range(1, len(p) + 1)]
    assert {r.lang: r.n for r in sizes.collect()} == {g: n for g in f if (n := sum(c for p, c in f[g].items() if len(p) == 1))}


def test_a_full_map_changes_nothing(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(collocations, "bit_map", lambda hashes: __import__("numpy").full(1 << 24, 255, "u1"))
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), min_count=9).collect()
    assert sorted(tuple(r) for r in got) == expected(rows, least=9)


def test_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", 1, 2)], SCHEMA)).collect() == []
