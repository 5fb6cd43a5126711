"""Phrases whose words go together, by stripes.

A stripe is the associative counter of what follows one prefix. Every task turns
its texts into stripes, and stripes are merged element by element: the elements of
all stripes are one table (prefix, suffix, n), grouped by both, so that the stripe
of a very common prefix is spread over all tasks. Everything is read off it:

* extensions: an element is a phrase of one word more, and n its occurrences;
* totals: those of a prefix are its own element in the stripe of its first words,
  and the stripe of the empty prefix sums to the words of a language;
* subsumption: the largest element of a phrase as prefix, and as suffix, is the
  most frequent longer phrase around it (longer ones still are no more frequent).

An element is named by the phrase that ends with the next word and is as long as
the prefix, so the two together name the longer phrase and are its two parts.
A phrase is counted only if both its parts are frequent: frequent ones set bits in
a map of a fixed size, which is broadcast. A bit that is set in vain costs a count
that is dropped later, so the map's size changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm import text as T
from convlake.llm.frames import ints, record, stored
from convlake.operators.sequence import top_k

MAX_WORDS = 4
MIN_COUNT = 30
COVERED_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
NO_LANG = "und"
#: The broadcast map: 2 ** MAP_BITS bits (16 MB), in 2 ** (MAP_BITS - BLOCK_BITS) blocks.
MAP_BITS = 27
BLOCK_BITS = 19
#: Pairs of a prefix and what follows that a task turns into stripes at once.
PAIRS = 2_000_000

_U = np.uint64
_ENDS = T.byte_table(b".,;:!?\n\x0b\x0c\r")
_WORD = ~(_ENDS | T.byte_table(b" \t"))
_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("n", pa.int64())])
_COUNTS_DDL = "lang string, word string, h long, n long"
_STRIPES = pa.schema([(c, pa.list_(pa.int64())) for c in ("prefix", "suffix", "n")])
_STRIPES_DDL = "prefix array<long>, suffix array<long>, n array<long>"
#: Elements of one row of stripes end to end.
ROW_ELEMENTS = 4096


def grow(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of the phrase of which these are all but the last and the first word."""
    return T.mix(prefix * _U(0xC2B2AE3D27D4EB4F) + suffix)


def _slices(batches: Iterator[pa.RecordBatch]):
    """For slices of texts: (bytes in lower case, starts, ends, piece, hash and row
    of every word, the rows' languages)."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        salt = np.array([int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little") for x in langs.dictionary.to_pylist()], np.uint64)
        code = langs.indices.to_numpy(zero_copy_only=False)
        for lo, hi, data, off in T.slices(T.column(batch, "text")):
            data = T.LOWER[data]
            starts, ends, woff = T.words(data, off, _WORD)
            row = T.row_of(woff)
            # a piece ends at a mark and with its row
            piece = np.concatenate([[0], np.cumsum(_ENDS[data], dtype=np.int64)])[starts] + row
            h = T.mix(T.Spans(data).hash(starts, ends) ^ salt[code[lo:hi]][row])
            yield data, starts, ends, piece, h, row, batch.column("lang").slice(lo, hi - lo)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stripe of the empty prefix: words and their counts by language, and the
    sum of all of them without a word."""
    for data, starts, ends, _, h, row, lang in _slices(batches):
        key, first, n = np.unique(h, return_index=True, return_counts=True)
        size = (ends - starts)[first]
        to = np.concatenate([[0], np.cumsum(size)])
        raw = np.ascontiguousarray(data[T.ragged(starts[first], size)])
        word = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(raw)])
        yield record(_COUNTS, lang.take(pa.array(row[first])), word.cast(pa.string()), key.view(np.int64), n)
        sums = pc.value_counts(lang.take(pa.array(row)))
        k = len(sums)
        yield record(_COUNTS, sums.field("values"), pa.nulls(k, pa.string()), np.zeros(k, np.int64), sums.field("counts").cast(pa.int64()))


def _set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (T.mix(h) >> _U(64 - MAP_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _stripe_rows(prefix: np.ndarray, suffix: np.ndarray) -> pa.RecordBatch:
    """Stripes of these pairs, end to end: a stripe of its own row would mostly
    hold one element."""
    _, first, n = np.unique(grow(prefix, suffix), return_index=True, return_counts=True)
    o = np.argsort(prefix[first], kind="stable")
    to = pa.array(np.append(np.arange(0, len(o), ROW_ELEMENTS), len(o)), pa.int32())
    return record(_STRIPES, *(pa.ListArray.from_arrays(to, pa.array(x, pa.int64()))
                              for x in (prefix[first][o].view(np.int64), suffix[first][o].view(np.int64), n[o])))


def _stripes(size: int, frequent):
    """Stripes of frequent prefixes of ``size`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for _, _, _, piece, h, _, _ in _slices(batches):
            for _ in range(size - 1):
                h = grow(h[:-1], h[1:])
            if len(h) < 2:
                continue
            # phrase i and phrase i + 1 make one of size + 1 words inside a piece
            some = _set(bits, h)
            some = some[:-1] & some[1:] & (piece[:-size] == piece[size:])
            held.append((h[:-1][some], h[1:][some]))
            count += len(held[-1][0])
            if count >= PAIRS:
                yield _stripe_rows(*(np.concatenate(x) for x in zip(*held)))
                held, count = [], 0
        if count:
            yield _stripe_rows(*(np.concatenate(x) for x in zip(*held)))
    return run


def _block(table: pa.Table) -> pa.Table:
    bit = table.column("bit").to_numpy()
    flags = np.zeros(1 << BLOCK_BITS, np.uint8)
    flags[bit & ((1 << BLOCK_BITS) - 1)] = 1
    return pa.table({"block": pa.array([int(bit[0]) >> BLOCK_BITS], pa.int64()),
                     "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = np.unique((T.mix(ints(batch, "h").astype(np.int64).view(np.uint64)) >> _U(64 - MAP_BITS)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(bit), pa.array(bit >> BLOCK_BITS)], ["bit", "block"])


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Bits of the column ``h``; blocks are built by tasks, and the whole map, of
    2 ** MAP_BITS bits whatever the number of hashes, comes to the driver."""
    blocks = (hashes.select("h").mapInArrow(_bits, "bit long, block long").distinct()
              .groupBy("block").applyInArrow(_block, "block long, bits binary"))
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    step = 1 << (BLOCK_BITS - 3)
    for r in blocks.collect():
        out[r["block"] * step: (r["block"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return out


def _own_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p, s = (ints(batch, c).astype(np.int64).view(np.uint64) for c in ("prefix", "suffix"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grow(p, s).view(np.int64))], [*batch.schema.names, "own"])


def stripes(texts: DataFrame, frequent: DataFrame, size: int, min_count: int) -> DataFrame:
    """(prefix, suffix, n, own) of the elements of at least ``min_count`` of all
    merged stripes of the ``frequent`` (h) prefixes of ``size`` words."""
    bits = texts.sparkSession.sparkContext.broadcast(bit_map(frequent))
    merged = (texts.mapInArrow(_stripes(size, bits), _STRIPES_DDL).selectExpr("inline(arrays_zip(prefix, suffix, n))")
              .groupBy("prefix", "suffix").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))
    out = stored(merged.mapInArrow(_own_hash, "prefix long, suffix long, n long, own long"), "stripes")
    bits.unpersist()
    return out


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS,
            min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(found, sizes): ``found`` has every phrase of up to ``max_words`` words with
    at least ``min_count`` occurrences in a language: h, lang, phrase, words, f
    (occurrences), heads and tails (those of its first and of its last 1, 2, ...
    words), longer (the most of a found phrase with one word more around it);
    ``sizes`` (lang, n) counts all words.

    Null texts are empty, a null language is ``und``. Repeated rows count again.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    words = stored(texts.mapInArrow(_words, _COUNTS_DDL).groupBy("lang", "word").agg(F.min("h").alias("h"), F.sum("n").alias("n"))
                   .filter((F.col("n") >= min_count) | F.col("word").isNull()), "words")
    sizes = words.filter("word is null").select("lang", "n")
    here = words.filter((F.col("n") >= min_count) & F.col("word").isNotNull()).select(
        "h", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.lit(1).alias("words"), F.col("n").alias("f"),
        F.array("n").alias("heads"), F.array("n").alias("tails"))
    levels = []
    for size in range(1, max_words):
        s = stripes(texts, here, size, min_count)
        longer = (s.select(F.col("prefix").alias("h"), "n").unionByName(s.select(F.col("suffix").alias("h"), "n"))
                  .groupBy("h").agg(F.max("n").alias("longer")))
        levels.append(here.join(longer, "h", "left"))
        head = here.select(F.col("h").alias("prefix"), "lang", "phrase", "heads")
        tail = here.select(F.col("h").alias("suffix"), "last", "tails")
        here = stored(s.join(head, "prefix").join(tail, "suffix").select(
            F.col("own").alias("h"), "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.lit(size + 1).alias("words"),
            F.col("n").alias("f"), F.concat("heads", F.array("n")).alias("heads"), F.concat("tails", F.array("n")).alias("tails")), "phrases")
    levels.append(here.withColumn("longer", F.lit(None).cast("long")))
    found = levels[0]
    for x in levels[1:]:
        found = found.unionByName(x)
    return found.drop("last"), sizes


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS,
                 min_count: int = MIN_COUNT, covered_percent: int = COVERED_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each
    language.

    A phrase of 2 to ``max_words`` words with a occurrences scores floor(SCALE * a
    / (l + r)) at its weakest cut (ties: the first), whose parts occur l and r
    times. Phrases inside a longer one with at least ``covered_percent`` of their
    occurrences are left out. Order: score and a descending, phrase by its bytes.
    Products are taken in decimals of 38 digits. Null and empty texts have no
    phrases; a table without phrases gives an empty result.
    """
    found, sizes = phrases(docs, text_col, lang_col, max_words, min_count)
    part = "transform(sequence(1, words - 1), k -> named_struct('score', (CAST({s} AS DECIMAL(10, 0)) * CAST(f AS DECIMAL(19, 0)))" \
           " div CAST(heads[k - 1] + tails[words - k - 1] AS DECIMAL(20, 0)), 'k', k, 'l', heads[k - 1], 'r', tails[words - k - 1]))"
    covered = F.expr(f"coalesce(CAST(longer AS DECIMAL(19, 0)) * 100 >= CAST(f AS DECIMAL(19, 0)) * {int(covered_percent)}, false)")
    scored = stored(found.filter("words > 1").filter(~covered).withColumn("cut", F.array_min(F.expr(part.format(s=SCALE))))
                    .select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"), "scored")
    best = top_k(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank", salt_of=["phrase"])
    return best.join(F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """DuckDB SQL of ``collocations`` with its defaults (phrases of up to 4 words)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, p, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM numbered),
four AS MATERIALIZED (SELECT lang, w1, lead(w1, 1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3, lead(w1, 3) OVER piece AS w4
  FROM words WINDOW piece AS (PARTITION BY p ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM four
  UNION ALL SELECT lang, 2, concat_ws(' ', w1, w2) FROM four WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3) FROM four WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4) FROM four WHERE w4 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= {MIN_COUNT}),
keyed AS MATERIALIZED (SELECT lang || chr(10) || phrase AS key, f FROM f),
parts AS MATERIALIZED (SELECT lang, phrase, f AS a, cut, lang || chr(10) || array_to_string(w[1:cut], ' ') AS first_,
    lang || chr(10) || array_to_string(w[cut + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)),
cuts AS (SELECT lang, phrase, a, cut, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * a // (l.f + r.f))::BIGINT AS score
  FROM parts JOIN keyed l ON l.key = first_ JOIN keyed r ON r.key = rest),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, f FROM (
  SELECT lang, w, k, m, f, unnest(range(1, k - m + 2)) AS i FROM cand, range(2, {MAX_WORDS}) r(m) WHERE m < k)),
longest AS (SELECT lang, phrase, max(f) AS longer FROM inner_ GROUP BY ALL),
kept AS (SELECT weakest.* FROM weakest LEFT JOIN longest USING (lang, phrase)
  WHERE coalesce(100::HUGEINT * longer < {COVERED_PERCENT}::HUGEINT * a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= {TOP}"""
