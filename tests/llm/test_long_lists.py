"""op8 where token lists are longer than ``SMALL``: families of edited copies and
a shared passage, against all pairs."""

import random

from convlake.llm import jaccard_join


def shingles(text, n=4):
    w = text.lower().split()
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def family(rng):
    base = [f"w{rng.randrange(5000)}" for _ in range(110)]

    def edited(words, edits):
        words = list(words)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
        return words

    texts = [edited(base, rng.randrange(1, 5)) for _ in range(150)]
    # far from the rest, yet near each other: their differences from any pivot agree
    for _ in range(12):
        far = edited(base, 6)
        texts += [edited(far, rng.randrange(2)) for _ in range(3)]
    texts += [far[: rng.randrange(80, 110)] for far in (edited(base, 1) for _ in range(30))]
    passage = [f"p{i}" for i in range(60)]
    own = [[f"o{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(4, 60))] for _ in range(60)]
    texts += [o[: len(o) // 2] + passage + o[len(o) // 2:] for o in own]
    texts += [passage + o[:4] for o in own[:20]]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def components(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def test_components_of_long_lists(spark):
    for seed, percent in ((1, 85), (2, 85), (3, 80)):
        texts = family(random.Random(seed))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(docs, percent=percent).collect()}
        want = components([shingles(t) for t in texts], percent)
        assert got == dict(enumerate(want))
        assert 20 < len(set(want)) < len(texts) - 50


def test_links_that_only_the_differences_show(spark, monkeypatch):
    """With every list long, all links between texts outside the pivot's component
    come from the differences; whatever the learnt order, components are exact."""
    monkeypatch.setattr(jaccard_join, "SMALL", 1)
    texts = family(random.Random(4))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(components([shingles(t) for t in texts], 85)))
    for repeated in (jaccard_join.REPEATED, 1):
        monkeypatch.setattr(jaccard_join, "REPEATED", repeated)
        assert {r.doc_id: r.component_id for r in jaccard_join.similar_groups(docs).collect()} == want
