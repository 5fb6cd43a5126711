"""Operators against brute force on small rows: nulls, empty and long texts, ties,
repeated rows, empty tables and clashing column names."""

import collections
import hashlib
import html
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlake.llm import (byte_cnn, decontaminate, html_text, jaccard_join, licenses, mixing, quality_rules, suffix_dedup,
                          token_counts, url_rules)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    voc = ["ab", "Cde", "éà", "the", "of", "zzz", "q", "##", "x!!"]
    def prose(n):
        return " ".join(rng.choice(voc) + rng.choice("abcdefgh") for _ in range(n))
    base = [prose(70) for _ in range(4)]
    rows = []
    for i in range(60):
        t = prose(rng.randint(0, 40)) + "\n" + rng.choice(base)[: rng.randint(0, 300)] + "\n" + rng.choice(base)
        t = {0: None, 1: "", 2: "x" * 500, 3: base[1], 4: base[1], 5: " \n\t", 6: "one", 7: "w " * 4000}.get(i, t)
        rows.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "Z", None]), 7))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_words int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_suffix_dedup(docs):
    seen, want = set(), {}
    for i, t, *_ in sorted(corpus()):
        b, gone = (t or "").encode(), set()
        for p in range(len(b) - 99):
            w = b[p: p + 100]
            if w in seen:
                gone.update(range(p, p + 100))
            seen.add(w)
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        want[i] = (len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest())
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(suffix_dedup.dedup_report(docs)).items()}
    assert got == want


def shingles(t):
    w = WORD.findall((t or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[k: k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def test_jaccard_join(docs):
    sets = {r[0]: shingles(r[1]) for r in corpus()}
    root = {i: i for i in sets}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(jaccard_join.similar_groups(docs)).items()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "other words here now"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.similar_groups(df).collect()
    assert len(got) == 5 and sum(r.is_first for r in got) == 3
    assert jaccard_join.one_of_each(df).count() == 3
    assert suffix_dedup.dedup_report(df).count() == 5


@pytest.mark.parametrize("run", [
    lambda d, s: suffix_dedup.dedup_report(d), lambda d, s: jaccard_join.similar_groups(d), lambda d, s: mixing.mixture(d),
    lambda d, s: licenses.scan(d), lambda d, s: quality_rules.quality_verdicts(d, s.createDataFrame([], "doc_id long, quality int")),
    lambda d, s: decontaminate.contamination_report(d, s.createDataFrame([], "item_id long, text string")),
    lambda d, s: byte_cnn.quality_scores(d, s.createDataFrame([], "doc_id long, quality int"))])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA), spark).count() == 0


def test_quality_counts_and_verdicts(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 9 != 0)) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = by_id(quality_rules.quality_verdicts(docs, labels))
    for i, t, *_ in corpus():
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = collections.Counter(tuple(w[k: k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if n[tuple(w[k: k + 8])] > 1 for j in range(k, k + 8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert set(quality_rules.passing(docs, labels).columns) == set(docs.columns)


def test_certified_is_the_exact_bound():
    # with none seen in n, the upper bound 1 - level ** (1 / n) is exact
    n, level = 500, 1e-3
    bound = 1 - level ** (1 / n)
    assert quality_rules.certified(0, n, bound * 1.001, level) and not quality_rules.certified(0, n, bound * 0.999, level)
    assert not quality_rules.certified(0, 0, 0.5, level)


def test_rule_cuts_only_what_is_certified(spark):
    rows = [(i, "word " * 30 if i % 10 else "w### " * 30 + "y", "en") for i in range(4000)]
    rows = [(i, " ".join(f"{w}{k}" for k, w in enumerate(t.split())), g) for i, t, g in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(4000)], "doc_id long, quality int")
    got = by_id(quality_rules.quality_verdicts(df, labels))
    assert all(r.kept == (i % 10 != 0) for i, r in got.items())


def test_rules_of_small_strata(spark):
    # 150 good labels without a language, 300 a language; in "d" many good texts repeat one line
    rows = [(i, " ".join(f"word{k}" if i % 6 else f"w##{k}#" for k in range(30)), None if i < 180 else "abcd"[i // 6 % 4]) for i in range(1620)]
    rows = [(i, t + "\nsame" * 12 if g == "d" and i % 6 in (1, 2) else t, g) for i, t, g in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(1620)], "doc_id long, quality int")
    got = by_id(quality_rules.quality_verdicts(df, labels))
    assert all(r.kept == (i % 6 != 0) and not r.base_failed for i, r in got.items())


def test_plan_is_certified():
    rng = np.random.default_rng(3)
    steps = rng.integers(0, 13, (400, 5)) * (rng.random((400, 5)) < 0.3)
    good = np.arange(400) % 2 == 0
    counts = rng.integers(1, 4, 400)
    # all rules together, sets of them and each alone reject too many good ones
    assert quality_rules.plan(steps, counts, good, 0.05, 0.05) == {}
    steps[good, 2:4] = 0
    got = quality_rules.plan(steps, counts, good, 0.05, 0.05)
    assert got == {2: 0, 3: 0}
    assert quality_rules.plan(steps[:60], counts[:60] * 0 + 1, good[:60], 0.05, 0.05) == {}
    assert quality_rules.plan(steps[:0], counts[:0], good[:0], 0.05, 0.05) == {}


def test_mixture(docs):
    got = mixing.mixture(docs).collect()
    size = collections.Counter()
    for _, t, _, s, _ in corpus():
        size[s] += len(WORD.findall(t or ""))
    names = sorted(s for s in size if s) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, target, full = sum(size.values()), {}, set()
    while True:
        free = total - sum(3 * size[s] for s in full)
        level = free / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * level > 3 * size[s]}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for r in got:
        goal = 3 * size[r.source] if r.source in full else weight[r.source] * level
        assert r["size"] == len(WORD.findall(dict((x[0], x[1]) for x in corpus())[r.doc_id] or "")) and r.source_size == size[r.source]
        assert abs(r.target - goal) < 1e-6 * total and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] + 60 for s in names if size[s] < 4000)


def test_decontaminate(spark, docs):
    items = [(1, corpus()[20][1][:120]), (2, "onea"), (3, None), (4, " .. "), (5, corpus()[4][1]), (5, corpus()[4][1])]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    def words(t):
        return word.findall((t or "").translate(ASCII_LOWER))
    found = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(0, len(w) - min(13, len(w)) + 1) if w else 0):
            found[tuple(w[k: k + 13])].add(str(i))
    df = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 100):
        spans = decontaminate.contamination(docs.select(F.col("doc_id").alias("_rid"), "text"), df, block_bytes=block).withColumn("h", decontaminate.n_hit())
        got = {r["_rid"]: (r.n_words, r.h, sorted(r["items"])) for r in spans.collect()}
        for i, t, *_ in corpus():
            w, hit, its = words(t), set(), set()
            for k in range(len(w)):
                for n in {len(p) for p in found}:
                    if tuple(w[k: k + n]) in found and k + n <= len(w):
                        hit.update(range(k, k + n))
                        its |= found[tuple(w[k: k + n])]
            assert got[i] == (len(w), len(hit), sorted(its))


def test_fm_index():
    rng = np.random.default_rng(5)
    seq = rng.integers(0, 4, 300)
    seq[0] = seq[-1] = 0
    index = decontaminate.FMIndex(seq, 3)
    for p in ([1, 2], [3], [1, 1, 1], [2, 3, 1, 2]):
        which, lo, hi = index.search(np.array([p]))
        want = [k for k in range(300 - len(p) + 1) if seq[k: k + len(p)].tolist() == p]
        got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if len(which) else []
        assert got == want


def test_token_prefixes(spark):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece
    path = public.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["a  b\nc", " a", "", None, "\n", "ﬁ Å é", "▁x <s>", "日本 ½\r\n\tx", "naïve tokenization of words " * 20, "ab" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_counts.token_counts(df, path, limit=10, prefixes=True).collect():
        t = texts[r.doc_id] or ""
        assert r.prefix_tokens == [len(sp.encode(t[: k + 1])) for k in range(len(t))]
        assert r.n_bytes == len(t.encode()) and r.n_tokens == len(sp.encode(t)) and r.over_limit == (r.n_tokens > 10)
        assert r.limit_chars == max([k for k in range(len(t) + 1) if len(sp.encode(t[:k])) <= 10])


def test_html(spark):
    page = ("<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav>"
            "<div class='cookie-notice'>We use cookies</div><article><h1>Title &amp; more</h1><p>First  para\n with <b>bold<br>"
            "<p>Short.<aside>side</aside><p>Long enough text to be the content of the page, surely it is.</p>"
            "<form>name</form><section id='comments'><p>reader comment</p></section></article><footer>(c)</footer>")
    want = "\n\n".join(["Title & more", "First para with bold", "Short.", "Long enough text to be the content of the page, surely it is."])
    plain = "<body><ul><li><a href=a>x</a><li><a href=b>y</a></ul><div>" + "words of the main text here. " * 10 + "</div>"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, plain), (5, "<p")], "page_id long, html string")
    got = {r.page_id: r for r in html_text.extract_text(df, ["page_id"]).collect()}
    assert got[1].text == want and got[2].text == got[3].text == "" and got[1].n_chars == len(want)
    assert got[4].text == html.unescape(("words of the main text here. " * 10).strip())


def test_html_keeps_all_of_the_text():
    def p(k, n):
        return f"<p>{(str(k) + ' word ') * (n // 7)}</p>"
    long = "<body><div>" + "".join(p(10 + k, 200) for k in range(30)) + p(99, 20000) + "".join(p(50 + k, 200) for k in range(30)) + "</div>"
    assert html_text.main_text(long).count("\n\n") == 60
    menu = "<ul>" + "".join(f"<li>item {k}</li>" for k in range(30)) + "</ul>"
    text = html_text.main_text(f"<body>{menu}<div><p>Intro.</p>" + p(99, 20000) + p(98, 200) * 3 + "<p>Last.</p></div>")
    assert "\n\nIntro.\n\n" in text and text.endswith("Last.") and "item 0" not in text
    parts = "<body><main><h1>Title</h1><p>Intro</p><article>" + p(1, 300) + "</article><article>" + p(2, 60) + "</article><p>End</p></main>"
    got = html_text.main_text(parts).split("\n\n")
    assert len(got) == 5 and got[:2] == ["Title", "Intro"] and got[4] == "End"
    assert html_text.main_text("<article>a b</article><div><article>c d</article></div>") == "a b\n\nc d"


def test_licences(spark):
    texts = ["intro\nReleased under the MIT License!\nend", "licensed UNDER cc-by nc 4.0", "nothing", None, licenses.TEMPLATES["MIT-text"].replace(". ", ".\n")]
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].best for i in range(5)] == ["MIT", "CC-BY-NC-4.0", None, None, "MIT-text"]


def test_licences_in_longer_texts(spark):
    other = "\n\n".join(f"Paragraph {k} says {k * 7} other things about matter {k}." for k in range(10))
    gpl = licenses.TEMPLATES["GPL-3.0-notice"].replace(" This program is dist", "\n\n  This program is dist") + (
        "\n\n  You should have received a copy of the GNU General Public License\n  along with this program. If not, see <x>.\n\n")
    apache = "".join(f"# {x}\n" for x in licenses.TEMPLATES["Apache-2.0-notice"].replace("; you", ";\nyou").replace("LICENSE-2.0 ", "LICENSE-2.0\n\n").split("\n"))
    texts = [gpl + other, "# Copyright 2020 X\n#\n" + apache + "\n" + other, "This project is released under the MIT License.",
             "Code is available under the Apache License, Version 2.0.", "One sentence. Released under the MIT License. And one more here.",
             other, "the mit license under released", "Permission is hereby granted to the Software License."]
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].best for i in range(8)] == ["GPL-3.0-notice", "Apache-2.0-notice", "MIT", "Apache-2.0", "MIT", None, None, None]
    # brute force: all stretches from a bigram of the template on
    for i, t in enumerate(texts):
        seq = licenses.pairs(t)
        for name, x in licenses.TEMPLATES.items():
            g, size = set(licenses.bigrams(x)), len(licenses.pairs(x))
            runs = [set(seq[k: k + size]) for k in range(len(seq)) if seq[k] in g]
            if any(200 * len(r & g) >= 80 * (len(r) + len(g)) for r in runs):
                assert name in got[i].licenses.split(",")


def test_classifier_holds_out(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice("abcdefg") for _ in range(5)) + ("%%%" if i % 4 == 0 else "") for _ in range(60))) for i in range(300)]
    rows += [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)], "doc_id long, quality int")
    got = by_id(byte_cnn.quality_scores(df, labels))
    held = [r for i, r in got.items() if r.held_out and i < 300]
    assert held and np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    assert got[300].score == got[301].score and all(0 <= r.score <= 1 for r in got.values())


def test_url_rules(spark):
    urls = [(1, "http://A.example.com/en/1"), (2, "https://www.example.com/en/2?x=/"), (3, "http://b.com"), (4, "http://b.net/es/3#f"),
            (5, None), (6, "no host"), (7, "http://notexample.com/en/"), (8, "x://y://z/en")]
    urls += [(100 + i, f"http://{'spam.casino' if i % 4 == 1 else 'good'}.org/p{i % 3}/{i}") for i in range(200)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 1) for i in range(10, 150)], "label_id long, bad boolean")
    got = {r.page_id: r for r in url_rules.verdicts(df, labels).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(1, 8)] == [
        ("example.com/en/", "block"), ("www.example.com/en/", "allow"), (None, "allow"), ("net/es/", "block"), (None, "allow"),
        (None, "allow"), ("com/", "allow")]
    assert (got[2].host, got[2].path, got[8].host) == ("www.example.com", "/en/2", "y:")
    assert all(got[100 + i].verdict == ("block" if i % 4 == 1 else "allow") for i in range(200))


def _mined_by_hand(rows, min_count=20, min_confidence=0.6, min_lift=2.0):
    """Every set of tokens that passes, without those that hold a passing part as confident."""
    n, n_bad = len(rows), sum(b for _, b in rows)
    of, bad = collections.Counter(), collections.Counter()
    for tokens, b in rows:
        for k in range(1, len(tokens) + 1):
            for part in itertools.combinations(sorted(tokens), k):
                of[part] += 1
                bad[part] += b
    rules = {s: bad[s] / of[s] for s in of
             if bad[s] >= (min_count if len(s) == 1 else max(min_count, 0.004 * n)) and bad[s] / of[s] >= min_confidence and bad[s] * n >= min_lift * n_bad * of[s]}
    alone = {s[0] for s in rules if len(s) == 1}
    return {s: c for s, c in rules.items() if (len(s) == 1 or not alone & set(s))
            and not any(set(o) < set(s) and rules[o] >= c for o in rules)}


@pytest.mark.parametrize("good", [300, 6000])
def test_url_rules_mined(spark, good):
    """Two tokens that are bad only together, a wholly bad host of 20 URLs, one of 19: the same rules at either size."""
    rnd = random.Random(3)
    rows = [(["a", "b", f"x{rnd.randrange(3)}"], True) for _ in range(40)] + [(["bad", "c"], True)] * 20 + [(["less", "c"], True)] * 19
    rows += [([rnd.choice("ab"), f"x{rnd.randrange(3)}", "c"], False) for _ in range(good)] + [(["a", "b", "x1"], False)] * 5 + [([], False), ([], True)]
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    got = {tuple(r.tokens): r.confidence for r in url_rules.mine(df).collect()}
    assert got == pytest.approx(_mined_by_hand(rows))
    assert ("bad",) in got and ("a", "b") in got and not any("less" in r for r in got)


def test_url_rules_without_any(spark):
    df = spark.createDataFrame([(["a"], False), (["b"], True)], "tokens array<string>, bad boolean")
    assert url_rules.mine(df).count() == 0 and url_rules.mine(df, min_count=1).count() == 1
    assert url_rules.mine(df.limit(0)).count() == 0
