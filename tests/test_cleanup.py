import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convlake.functions.chunking import chunk_reply, chunk_sentences
from convlake.functions.cleanup import clean_markdown, clean_transcript
from convlake.plans.views import view
from tests import pyref
from tests.conftest import SF_MID, SF_SMALL


def _apply(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.r for r in df.select("i", fn(F.col("t")).alias("r")).orderBy("i").collect()]


def test_voice_cleanup_pairs(spark):
    got = _apply(spark, [t for t, _ in pyref.SPOKEN], lambda c: clean_markdown(c, "voice"))
    assert got == [r for _, r in pyref.SPOKEN]


def test_voice_cleanup_leaves_no_markup_in_documents(spark):
    docs = view(spark, SF_MID, "documents").select("doc_id", "text",
                                                   clean_markdown(F.col("text"), "voice").alias("r")).collect()
    for d in docs:
        assert d.r == " ".join(d.r.split()), d.doc_id
        assert "```" not in d.r and "https://" not in d.r, d.doc_id
        assert len(d.r) <= 5003 and (len(d.r) <= 5000 or d.r.endswith("...")), d.doc_id
        if not set(d.text) & set("[]()`#*_~+-") and "http" not in d.text and len(d.r) < 5000:
            said = [" ".join(line.split()) for line in re.split("\n\n+", d.text.strip())]
            assert d.r == " ".join(". ".join(said).split()), d.doc_id


def test_transcript_matches_python(spark):
    texts = ["the the cat", "I want to I want to go", "what us the plan", "What us up", "a  b\n\nc",
             "hello hello hello world", "go go go go", "New York New York is big", ""]
    assert _apply(spark, texts, clean_transcript) == [pyref.transcript(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["the", "The", "cat", "sat", "what", "us", "it's", "a1", "\n", "  "]), max_size=14))
def test_transcript_property(spark, words):
    t = " ".join(words)
    assert _apply(spark, [t], clean_transcript) == [pyref.transcript(t)]


def test_transcript_on_documents(spark):
    docs = view(spark, SF_SMALL, "documents").select("doc_id", "text", clean_transcript(F.col("text")).alias("r")).collect()
    assert [d.doc_id for d in docs if d.r != pyref.transcript(d.text)] == []


def test_chunker_boundaries():
    assert chunk_reply("") == []
    assert chunk_reply("Short reply.") == ["Short reply."]
    text = "This is the first sentence here. " + "Second sentence is a bit longer than sixty characters in total! Third."
    chunks = chunk_reply(text)
    assert chunks[0] == "This is the first sentence here."
    assert "".join(chunks).replace(" ", "") == text.replace(" ", "")


def test_chunk_sentences_job(spark):
    d = view(spark, SF_SMALL, "documents")
    got = chunk_sentences(d, "doc_id", "text")
    exp = {(r.doc_id, i, c) for r in d.collect() for i, c in enumerate(chunk_reply(r.text))}
    assert {(r.doc_id, r.chunk_no, r.chunk) for r in got.collect()} == exp


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(pyref.SPOKEN_PARTS), max_size=5), min_size=1, max_size=4))
def test_voice_cleanup_property(spark, lines):
    written = "\n\n".join("# Say " + " ".join(w for w, _ in line) for line in lines)
    spoken = ". ".join(" ".join(["Say"] + [x for _, x in line if x]) for line in lines)
    got = _apply(spark, [written], lambda c: clean_markdown(c, "voice"))
    assert [got[0].replace(" . ", ". ")] == [spoken]
