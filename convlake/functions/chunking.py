"""Sentence chunking of a reply for speech (SCL-3).

The cursor is sequential (the minimum length of the next chunk depends on
whether earlier chunks survived cleanup), so the per-reply logic is a small
Python helper; Spark partitions the replies and ``mapInArrow`` streams them
through in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from convlake.functions.cleanup import WEB_CAP, WEB_RULES

# FIXED VALUES: chunk boundaries and minimum lengths.
BOUNDARY = re.compile(r"""([.!?]["')\]]*)\s|\n""")
FIRST_MIN, NEXT_MIN, MIN_SPOKEN = 20, 60, 2


def _py_rule(rx: str) -> str:
    return rx.replace("(?U)(?md)", "(?m)").replace("(?U)", "").replace("(?md)", "(?m)")


_WEB_PY = [(re.compile(_py_rule(rx)), re.sub(r"\$(\d)", r"\\\1", rep)) for rx, rep in WEB_RULES]


def speech_text(raw: str) -> str:
    """Python twin of ``clean_markdown(..., 'web')``."""
    s = raw
    for rx, rep in _WEB_PY:
        s = rx.sub(rep, s)
    s = s.strip()
    if len(s) > WEB_CAP:
        s = s[:WEB_CAP].strip()
    return s


def iter_chunks(text: str | None) -> Iterator[str]:
    """Chunks of a whole reply, as a stream speaker fed every token would cut it."""
    if not text:
        return
    at, min_len = 0, FIRST_MIN
    while len(text) - at > min_len and (m := BOUNDARY.search(text, at + min_len)):
        spoken = speech_text(text[at:m.end()])
        at = m.end()
        if len(spoken) >= MIN_SPOKEN:
            min_len = NEXT_MIN
            yield spoken
    if text[at:].strip():
        spoken = speech_text(text[at:])
        if len(spoken) >= MIN_SPOKEN:
            yield spoken


def chunk_reply(text: str | None) -> list[str]:
    return list(iter_chunks(text))


#: Characters of chunks, and chunks, that a worker gathers before it hands them on.
OUT_CHARS, OUT_ROWS = 1 << 20, 10_000


def chunk_sentences(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, chunk_no, chunk) for every reply. A worker holds its Arrow batch, one
    text of it and at most about ``OUT_CHARS`` of chunks, however many the batch has."""
    schema = pa.schema([(id_col, pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.string())])

    def run(batches):
        rows, chars = [], 0
        for batch in batches:
            for i, t in zip(*batch.columns):
                i = i.as_py()
                for n, chunk in enumerate(iter_chunks(t.as_py())):
                    rows.append((i, n, chunk))
                    chars += len(chunk)
                    if chars >= OUT_CHARS or len(rows) >= OUT_ROWS:
                        yield pa.record_batch([*zip(*rows)], schema=schema)
                        rows, chars = [], 0
        if rows:
            yield pa.record_batch([*zip(*rows)], schema=schema)

    return df.select(id_col, text).mapInArrow(run, f"{id_col} long, chunk_no int, chunk string")


class SentenceChunks:
    """Table function: the chunks of one reply as (chunk_no, chunk) rows."""

    def eval(self, text: str | None):
        yield from enumerate(chunk_reply(text))


def register_chunk_function(spark: SparkSession, name: str = "chunk_sentences") -> None:
    """UDF-2: ``SELECT id, chunk_no, chunk FROM t, LATERAL chunk_sentences(text)``.
    Null and empty texts give no rows. Rows travel in Arrow batches."""
    spark.udtf.register(name, udtf(SentenceChunks, returnType="chunk_no int, chunk string", useArrow=True))
