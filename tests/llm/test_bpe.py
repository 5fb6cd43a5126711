"""Byte-level encoding and decoding, and prefix counts, against the libraries."""

import hashlib
import random

import numpy as np
import pytest

from convlake.llm import bpe_codec, text, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "don't", "the", " the", "é", "ß", "中文", "1", "12345", "!!", "#",
         "<|endoftext|>", "<|endof", "\xa0", "　", "🙂", "a", "Zq", "ing", "tion", "͸", "\U0001e5f1", "\x00", "\x1c",
         "\x85", "I'VE", "''s", "\r\n", "'d'", "'t\n"]


def texts() -> list:
    rng = random.Random(4)
    out = [None, "", " ", "<|endoftext|>", " <|endoftext|><|endoftext|> x", "a" * 5000, "x9q" * 40_000, "the cat " * 3000]
    out += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(600)]
    out += ["".join(rng.choice("abcdefghilmnorstuy") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    out += [x * k for x in ("a", "aab", " ", "=-", "\n") for k in range(40)]
    return out + out[:20]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


def test_codec_equals_the_library(spark, library):
    rows = [(i // 2, t, "x", i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, _k0 int").repartition(3)
    ids = bpe_codec.encode(docs, PATH)
    assert ids.columns == ["doc_id", "_k0", "ids"]
    got = {r["_k0"]: (r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in bpe_codec.decode(ids, PATH).collect()}
    arrays = {r["_k0"]: r.ids for r in bpe_codec.encode(docs, PATH, arrays=True).collect()}
    for i, t, _, k in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[k] == (i, want, library.decode(want, skip_special_tokens=False)), t
        assert got[k][2] == (t or "") and arrays[k] == want


def test_digests(spark, library):
    rows = [(str(i), t) for i, t in enumerate(texts()[:60])] + [(None, "a b"), (None, "a b")]
    got = bpe_codec.codec_digests(spark.createDataFrame(rows, "doc_id string, text string"), PATH).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                  for i, t in rows for e in [library.encode(t or "", add_special_tokens=False).ids])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe_codec.codec_digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_decoding_any_ids(spark, library):
    rng = random.Random(9)
    rows = [(i, np.array([rng.choice([rng.randrange(300), rng.randrange(50257), 50256, 70000]) for _ in range(rng.randint(0, 30))],
                         "<u4").tobytes()) for i in range(300)] + [(300, None)]
    got = {r.i: r.text for r in bpe_codec.decode(spark.createDataFrame(rows, "i int, ids binary"), PATH).collect()}
    for i, x in rows:
        assert got[i] == library.decode(np.frombuffer(x or b"", "<u4").tolist(), skip_special_tokens=False)


def test_prefix_counts_equal_the_library_at_every_prefix():
    import pyarrow as pa

    sentencepiece = pytest.importorskip("sentencepiece")
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    table = token_counts.SegmentTable(model)
    some = [t for t in texts()[8:] if t][:150] + [" " * 40, "a,b.c;  d--e (f) \"g\" h's", "x9q" * 50]
    for t in some:
        t = t.replace("▁", " ")
        for lo, hi, data, off in text.slices(pa.array([t], pa.large_string())):
            counts, _ = token_counts.prefix_counts(table, data, off)
            assert counts.tolist() == [len(sp.encode(t[: k + 1])) for k in range(len(t))], t
