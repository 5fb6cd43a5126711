"""Location tagging against a gazetteer (JOIN-1) and running location (WIN-4).

The gazetteer is a DataFrame (priority, kind, term, city, region, state);
kind is 'region', 'city' or 'state'. The first term (lowest priority) found
as a substring of the lower-cased text wins. Before that scan, location
phrases ("i'm in ...", "here in ...") are tried in order; the text captured by
the last matched group is searched for a city only.

Plan by dictionary size (checked, never assumed):
  <= LITERAL_MAX terms  -> literal array + higher-order ``filter`` (narrow, no shuffle)
  <= AUTOMATON_BYTES    -> the terms as one broadcast automaton, one pass over each
                           text in Arrow batches (narrow, no shuffle)
  larger                -> equi-join of text slices with the terms on the first
                           characters

All plans answer per row, whatever the ids: a null text has no location, and
an empty or null term never matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions import dictionaries as D
from convlake.operators.lookup import checked_broadcast
from convlake.operators.sequence import DENSE_ROWS, carry_last, carry_last_sorted, densest_bucket

LITERAL_MAX = 256
#: Characters of terms and hit fields, and terms, that one automaton may hold: it is
#: built once in each worker, from broadcast rows (about 100 bytes a character).
AUTOMATON_BYTES = 1 << 20
AUTOMATON_TERMS = 100_000
ANCHOR = 3
BLOCK = 256
HIT_FIELDS = ("kind", "city", "region", "state")
GAZ_SCHEMA = "priority int, kind string, term string, city string, region string, state string"


def default_gazetteer(spark) -> DataFrame:
    return spark.createDataFrame(D.gazetteer_rows(), GAZ_SCHEMA)


def _phrase_texts(low: Column, phrases) -> list[Column]:
    """Text captured by the last participating group of each phrase, or null."""
    out = []
    for rx in phrases:
        jrx = "(?U)" + rx
        n_groups = rx.count("(") - rx.count("(?")
        cands = [F.nullif(F.regexp_extract(low, jrx, g), F.lit("")) for g in range(n_groups, 0, -1)]
        out.append(F.when(low.rlike(jrx), F.coalesce(*cands)))
    return out


def tag_location(msgs: DataFrame, gazetteer: DataFrame, text: str = "text",
                 phrases=D.LOCATION_PHRASES) -> DataFrame:
    """Adds loc_kind, loc_city, loc_region, loc_state (null when nothing matched)."""
    # One bounded read decides the literal plan: at most LITERAL_MAX + 1 small
    # rows ever reach the driver.
    head = gazetteer.limit(LITERAL_MAX + 1).collect()
    if len(head) <= LITERAL_MAX:
        return _tag_literal(msgs, head, text, phrases)
    width = sum((F.coalesce(F.length(c), F.lit(0)) for c in ("term", *HIT_FIELDS)), F.lit(0))
    rows, chars = gazetteer.agg(F.count("*"), F.sum(width)).first()
    if rows <= AUTOMATON_TERMS and chars <= AUTOMATON_BYTES:
        return _tag_automaton(msgs, gazetteer, text, phrases)
    return _tag_join(msgs, gazetteer, text, phrases)


def _tag_literal(msgs, gazetteer_rows, text, phrases):
    """The texts to search are the elements of one array, so each is made once per row
    and not once per term that is compared with it."""
    rows = sorted((r for r in gazetteer_rows if r["term"]), key=lambda r: r["priority"])

    def first(s: Column, terms) -> Column:
        if not terms:
            return F.lit(None)
        known = F.array(*[F.struct(F.lit(r["term"]).alias("term"),
                                   *[F.lit(r[f]).cast("string").alias(f) for f in HIT_FIELDS]) for r in terms])
        return F.get(F.filter(known, lambda g: F.contains(s, g["term"])), 0)

    cities = [r for r in rows if r["kind"] == "city"]
    low = F.lower(F.col(text))
    texts = F.array(*_phrase_texts(low, phrases), low)
    hits = F.transform(texts, lambda s, slot: F.when(slot < len(phrases), first(s, cities)).otherwise(first(s, rows)))
    hit = F.get(F.filter(hits, lambda h: h.isNotNull()), 0)
    return msgs.select("*", F.inline(F.array(hit)).alias("_term", *["loc_" + f for f in HIT_FIELDS])).drop("_term")


def _automaton(rows) -> ahocorasick.Automaton:
    """Every term with its best row overall and its best city row (row numbers in
    order of priority; None without a city)."""
    found = ahocorasick.Automaton()
    for i, (term, kind, *_) in enumerate(rows):
        first, city = found.get(term, (i, None))
        found.add_word(term, (first, i if city is None and kind == "city" else city))
    found.make_automaton()
    return found


def _tag_automaton(msgs: DataFrame, gazetteer: DataFrame, text: str, phrases) -> DataFrame:
    """All terms are sought at once in one pass over a text; time follows the text's
    length and its hits, whatever the longest term."""
    terms = gazetteer.filter(F.length("term") > 0).select("priority", "term", *HIT_FIELDS).collect()
    rows = [tuple(r)[1:] for r in sorted(terms, key=lambda r: r["priority"])]
    known = msgs.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf(", ".join(f"{f} string" for f in HIT_FIELDS))
    def hits(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rows = known.value
        automaton = _automaton(rows) if rows else None
        for part in parts:
            out = []
            for texts in part:
                best = None
                for slot, s in enumerate(texts if automaton else ()):
                    which = 0 if slot == len(phrases) else 1  # phrases name cities only
                    best = min((v[which] for _, v in automaton.iter(s or "") if v[which] is not None), default=None)
                    if best is not None:
                        break
                out.append(rows[best][1:] if best is not None else (None,) * len(HIT_FIELDS))
            yield pd.DataFrame(out, columns=list(HIT_FIELDS), dtype=object)

    low = F.lower(F.col(text))
    return msgs.withColumn("_hit", hits(F.array(*_phrase_texts(low, phrases), low))).select(
        *msgs.columns, *[F.col("_hit")[f].alias("loc_" + f) for f in HIT_FIELDS])


def _slots(msgs: DataFrame, text: str, phrases) -> DataFrame:
    """The texts to search, by (``_key``, slot): equal texts share their key."""
    low = F.lower(F.col(text))
    slots = [F.struct(F.lit(i).alias("slot"), t.alias("s")) for i, t in enumerate(_phrase_texts(low, phrases))]
    slots.append(F.struct(F.lit(len(phrases)).alias("slot"), low.alias("s")))
    return (msgs.select("_key", F.explode(F.array(*slots)).alias("_x"))
                .select("_key", "_x.slot", "_x.s").filter(F.length("s") > 0))


def _tag_join(msgs: DataFrame, gazetteer: DataFrame, text: str, phrases, broadcast: bool | None = None) -> DataFrame:
    """``broadcast``: None checks the size of the terms, True or False decides."""
    g = gazetteer.select("priority", "term", *HIT_FIELDS).filter(F.length("term") > 0)
    longest = g.agg(F.max(F.length("term"))).first()[0] or 1
    keyed = msgs.withColumn("_key", F.sha2(F.col(text), 256))
    hits = _gram_hits(_slots(keyed, text, phrases), g, longest, broadcast)
    best = hits.filter((F.col("slot") == len(phrases)) | (F.col("kind") == "city")).groupBy("_key").agg(
        F.min_by(F.struct(*HIT_FIELDS), F.struct("slot", "priority")).alias("_hit"))
    return keyed.join(best, "_key", "left").select(
        *msgs.columns, *[F.col("_hit")[f].alias("loc_" + f) for f in HIT_FIELDS])


def _gram_hits(sl: DataFrame, g: DataFrame, longest: int, broadcast: bool | None) -> DataFrame:
    """Exact substring join without a cross product.

    A text is cut into blocks, each with the start of what follows it, and a
    block into one slice per position, as long as the longest term: bytes grow
    with the text times that length. A term is anchored by its first ANCHOR
    characters (all of a shorter one); slices meet terms on the anchor and the
    rest of the term is compared in place. Broadcast terms need no shuffle."""
    g = g.withColumn("_k", F.least(F.length("term"), F.lit(ANCHOR))).withColumn("_a", F.expr("left(term, _k)"))
    if broadcast is None:
        g = checked_broadcast(g)
    elif broadcast:
        g = F.broadcast(g)
    size = max(BLOCK, longest)
    blocks = sl.withColumn("_b", F.regexp_extract_all("s", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).select(
        "_key", "slot", F.explode(F.transform("_b", lambda b, i: F.struct(
            b.alias("b"), F.concat(b, F.coalesce(F.substring(F.get("_b", i + 1), 1, longest - 1), F.lit(""))).alias("t")))
        ).alias("_x"))
    at = F.explode(F.sequence(F.lit(1), F.length("_x.b"))).alias("_i")
    slices = blocks.select("_key", "slot", "_x", at).select(
        "_key", "slot", F.substring("_x.t", F.col("_i"), F.lit(longest)).alias("_s"))
    sizes = F.array(*[F.struct(F.lit(k).alias("_k"), F.substring("_s", 1, k).alias("_a")) for k in range(1, ANCHOR + 1)])
    grams = slices.select("_key", "slot", "_s", F.inline(sizes))
    return grams.join(g, ["_k", "_a"]).filter(F.startswith("_s", "term"))


def running_location(tagged: DataFrame, session: str = "session_id", turn: str = "turn",
                     msg_id: str = "msg_id", bucket: int = 1 << 20, plan: str = "auto") -> DataFrame:
    """WIN-4: city, region and state each keep their last non-null value along
    the session (a region-only hit leaves the older city in place).

    Uses the two-level prefix scan, so a huge session is split into turn buckets.
    """
    t = tagged.withColumn("city", F.col("loc_city")).withColumn("region", F.col("loc_region")) \
              .withColumn("state", F.col("loc_state"))
    if plan == "auto":
        plan = "sorted" if densest_bucket(t, [session], turn, bucket) > DENSE_ROWS else "buckets"
    if plan == "sorted":
        out = carry_last_sorted(t, session, turn, msg_id, ["city", "region", "state"], suffix="_now")
        return out.drop("city", "region", "state")
    out = carry_last(t, [session], turn, msg_id, ["city", "region", "state"], bucket, suffix="_now")
    return out.drop("city", "region", "state")
