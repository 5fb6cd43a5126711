"""JOIN-1: the automaton plan answers as the other plans do."""

import random
import re

from convlake.functions import dictionaries as D
from convlake.operators import geo as G

COLS = ["i", "loc_kind", "loc_city", "loc_region", "loc_state"]


def result(df):
    return sorted((tuple(r) for r in df.select(COLS).collect()), key=repr)


def test_plans_agree(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(2, 6)))
    terms = [(k, rng.choice(["region", "city", "state"]), word(), f"C{k}", f"R{k}", None) for k in range(300)]
    terms += [(300, "city", "", "E", None, None), (301, "city", None, "N", None, None), (302, "state", "x" * 300, None, None, "S")]
    texts = [rng.choice(["", "i'm in ", "Here in "]) + "".join(rng.choice("ABÉ zq") for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    texts += [None, "", "x" * 700, "zq" * 40000 + "x" * 300]
    gaz = spark.createDataFrame(terms, G.GAZ_SCHEMA)
    msgs = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    want = result(G._tag_literal(msgs, gaz.collect(), "text", D.LOCATION_PHRASES))
    assert result(G._tag_automaton(msgs, gaz, "text", D.LOCATION_PHRASES)) == want
    assert result(G.tag_location(msgs, gaz)) == want
    assert len({r[1:] for r in want}) > 20 and any(r[4] == "S" for r in want)
    none = result(G._tag_automaton(msgs, gaz.limit(0), "text", D.LOCATION_PHRASES))
    assert len(none) == len(texts) and all(r[1:] == (None,) * 4 for r in none)
    assert result(G._tag_automaton(msgs.limit(0), gaz, "text", D.LOCATION_PHRASES)) == []


def test_texts_are_made_once_and_not_for_each_term(spark):
    msgs = spark.createDataFrame([(1, "I'm in Riverton")], "i long, text string")
    got = G._tag_literal(msgs, G.default_gazetteer(spark).collect(), "text", D.LOCATION_PHRASES)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"(?i)contains\((\w+)", plan)) == {"lambda"}  # a variable, no expression of the text
    assert result(got) == [(1, "city", "Riverton", "North Shore", "Homeland")]
