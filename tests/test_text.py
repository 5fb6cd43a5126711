import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convlake.functions.text import extract_contacts, redact
from convlake.operators import leads as L
from convlake.plans.views import view
from tests import pyref
from tests.conftest import SF_MID

EDGE = [
    ("ab@x.com", "***@x.com"),
    ("john.doe@mail.example.com", "jo***@mail.example.com"),
    ("(904) 555-6593", "904-***-****"),
    ("+1 (743) 555-3824", "+1 743-***-****"),
    ("9045556593", "904-***-****"),
    ("key sk-abcdefghijklmnopqrstu end", "key [REDACTED_API_KEY] end"),
    ("Bearer abcdefghij0123456789xyz", "[REDACTED_API_KEY]"),
    ("", ""),
    (None, ""),
]


def _redact_all(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.r for r in df.select("i", redact(F.col("t")).alias("r")).orderBy("i").collect()]


def test_redaction_edge_rows(spark):
    assert _redact_all(spark, [t for t, _ in EDGE]) == [e for _, e in EDGE]


def test_redaction_matches_python_on_documents(spark):
    docs = view(spark, SF_MID, "documents").select("doc_id", "text", redact(F.col("text")).alias("r")).collect()
    bad = [d.doc_id for d in docs if d.r != pyref.redact(d.text)]
    assert bad == []


local = st.text(alphabet="abcxyz019._%+-", min_size=1, max_size=6)
dom = st.text(alphabet="abmx-.", min_size=1, max_size=6)
piece = st.one_of(
    st.builds(lambda a, b, c: f"{a}@{b}.{c}", local, dom, st.sampled_from(["com", "io", "x", "org"])),
    st.from_regex(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}", fullmatch=True),
    st.sampled_from(["sk-abcdefghijABCDEFGHIJ12", "gsk_aaaaaaaaaaaaaaaaaaaaaaa", "Bearer ab.cd-ef_gh1234567890xx"]),
    st.text(alphabet="ab @.-()1é\n", max_size=8),
)


@settings(max_examples=30, deadline=None)
@given(st.lists(piece, min_size=1, max_size=6))
def test_redaction_property(spark, parts):
    text = " ".join(parts)
    assert _redact_all(spark, [text]) == [pyref.redact(text)]


def test_lead_edges(spark):
    texts = ["mail a@b.co. thanks", "my name is Ann Lee and I work at: Foo & Sons",
             "Hello, my name is Bob", "call +1 (305) 555-0199 now", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    ex = L.extract_leads(df).orderBy("i").collect()
    assert ex[0].email == "a@b.co."
    assert ex[1].contact_name == "Ann Lee and I work at"
    assert ex[1].company_name == "Foo & Sons"
    assert ex[3].phone == "+1 (305) 555-0199"
    leads = {r.i for r in L.contact_leads(L.extract_leads(df)).collect()}
    assert leads == {0, 1, 3}  # a name alone is not a lead


@pytest.mark.parametrize("name", ["documents", "v_msg"])
def test_extraction_matches_python(spark, name):
    d = view(spark, SF_MID, name)
    idc = "doc_id" if name == "documents" else "msg_id"
    got = d.select(idc, "text", *[c.alias(k) for k, c in extract_contacts(F.col("text")).items()]).collect()
    for r in got:
        exp = pyref.contacts(r.text)
        assert {k: r[k] for k in exp} == exp, (r[idc], r.text[:200])


def test_flagship_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    out = df.collect()
    assert len(out) > 0
    assert {"doc_id", "email", "phone", "redacted_text", "metadata"} <= set(df.columns)
    assert set(E.oracle_sql()) <= set(E.queries())


lead_piece = st.one_of(
    st.builds(lambda a, b: f"{a}@{b}.co", st.text(alphabet="ab_.+-1", min_size=1, max_size=5),
              st.text(alphabet="xy-", min_size=1, max_size=4)),
    st.from_regex(r"(\+?1[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}", fullmatch=True),
    st.sampled_from(["my name is", "I'm", "This is", "work at:", "Company", "representing", "org", "firm:"]),
    st.text(alphabet="Ab &.,'-\n9é", max_size=10),
)


@settings(max_examples=30, deadline=None)
@given(st.lists(lead_piece, min_size=1, max_size=6))
def test_extraction_property(spark, parts):
    text = " ".join(parts)
    df = spark.createDataFrame([(0, text)], "i int, text string")
    r = df.select(*[c.alias(k) for k, c in extract_contacts(F.col("text")).items()]).collect()[0]
    exp = pyref.contacts(text)
    assert {k: r[k] for k in exp} == exp
