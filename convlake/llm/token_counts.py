"""Exact token counts at every prefix by dynamic programming.

The tokens of a BPE model's encoding of a prefix are decided by its last token:
of all pieces that end there, one follows the last token of what is left of it as
in the model's own merges. So last token and count at each prefix follow from
those at shorter prefixes, and the stored counts answer truncation and budget
questions without encoding again.

The model's pieces never cross a line break and hold spaces only in front, and
most pairs of ASCII characters stand side by side in no piece, so a text falls into
segments (words with the spaces before them, punctuation, line breaks) that are
encoded apart. Segments seen before are looked up; new ones are sorted, so that
each continues from the prefix it shares with the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm import text as T
from convlake.llm.bpe_prefix import Merges, PrefixTokens

LIMIT = 4096
SPACE = "▁"
#: Segments remembered in a worker, about 100 bytes each.
REMEMBERED = 400_000
#: Longer segments are not remembered.
LONGEST = 64


def merged(parts: list[str], score: dict[str, float], stop: int = 1) -> list[str]:
    """The model's merges on a short list of strings, until ``stop`` are left."""
    while len(parts) > stop:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            break
        parts[at: at + 2] = [parts[at] + parts[at + 1]]
    return parts


def score_merges(score: dict[str, float]) -> tuple[list[str], Merges]:
    """Pieces, and their merges: of neighbours that together are a piece, those of
    the highest score come first, from the left. The halves of a piece are what
    its own last merge joins; a piece that the model cannot build is left out."""
    place = {x: r for r, x in enumerate(sorted(set(score.values()), reverse=True))}
    halves = {p: merged(list(p), score, 2) for p in score}
    names = sorted(p for p in score if len(p) == 1 or len(halves[p]) == 2 and all(x in score for x in halves[p]))
    index = {p: k for k, p in enumerate(names)}
    rank = [place[score[p]] if len(p) > 1 else -1 for p in names]
    left, right = ([index.get(halves[p][-2 + i], 0) if len(p) > 1 else 0 for p in names] for i in (0, 1))

    def joined(x: int, y: int) -> int | None:
        k = index.get(names[x] + names[y])
        return None if k is None else rank[k]

    def direct(pieces: list[int]) -> list[int]:
        return [index.get(p, -1) for p in merged(list("".join(names[k] for k in pieces)), score)]

    return names, Merges(rank, left, right, joined, direct)


class PrefixCounter:
    """Token counts of a sentencepiece BPE model at every prefix of a segment."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = [i for i in range(sp.get_piece_size())
                 if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if any(SPACE in p[1:].lstrip(SPACE) or "\n" in p and len(p) > 1 for p in score):
            raise ValueError("a piece crosses a word or a line")
        if len(sp.encode("Å ﬁ")) and sp.decode(sp.encode("Å")) != "Å":
            raise ValueError("the model changes characters")
        names, merges = score_merges(score)
        self.tokens = PrefixTokens([[ord(c) for c in p] for p in names], merges)
        # ASCII characters that stand side by side in no piece; a space is SPACE there
        inside = {p[i: i + 2].replace(SPACE, " ") for p in names for i in range(len(p) - 1)}
        self.cut = np.array([[chr(x) + chr(y) not in inside for y in range(128)] for x in range(128)])

    def prefixes(self, s: str) -> list[int]:
        """Tokens of s[:0], s[:1], ..., s."""
        self.tokens.run(list(map(ord, s)))
        return self.tokens.count


class SegmentTable:
    """Prefix counts of segments by hash, remembered between slices."""

    def __init__(self, model: bytes) -> None:
        self.counter = PrefixCounter(model)
        self.known: dict[int, bytes] = {}

    def counts(self, keys: np.ndarray, raw: list[bytes], heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts at the 1st, 2nd, ... character of each segment end to end, and
        the segments' characters. A segment at a text's head follows SPACE."""
        out: list = [self.known.get(k) for k in keys.tolist()]
        todo = [(SPACE + raw[i].decode().replace(" ", SPACE) if heads[i] else raw[i].decode().replace(" ", SPACE), i)
                for i, x in enumerate(out) if x is None]
        if len(self.known) + len(todo) > REMEMBERED:
            self.known.clear()
        todo.sort()
        flat: list[int] = []
        ends = []
        for s, i in todo:
            c = self.counter.prefixes(s)
            flat += c[2:] if heads[i] else c[1:]
            ends.append(len(flat) * 4)
        packed, at = np.array(flat, np.int32).tobytes(), 0
        for (s, i), end in zip(todo, ends):
            out[i] = packed[at:end]
            at = end
            if len(s) <= LONGEST:
                self.known[int(keys[i])] = out[i]
        return np.frombuffer(b"".join(out), np.int32), np.fromiter(map(len, out), np.int64, len(out)) // 4


def segment_starts(data: np.ndarray, head_at: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """True at each byte where a segment starts: no piece crosses there."""
    space, line, ascii_ = data == 32, data == 10, data < 128
    start = line.copy()
    start[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
    start[1:] |= ascii_[1:] & ascii_[:-1] & cut[data[:-1] & 127, data[1:] & 127]
    start[head_at] = True
    return start


def prefix_counts(table: SegmentTable, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token count at every character of the rows end to end (that is, of the
    prefix that ends with it), and the characters' offsets by row."""
    n = len(data)
    char = (data & 0xC0) != 0x80
    chars_to = np.concatenate([[0], np.cumsum(char, dtype=np.int64)])
    coff = chars_to[off]
    if not n:
        return np.zeros(0, np.int64), coff
    head_at = off[:-1][np.diff(off) > 0]
    s = np.flatnonzero(segment_starts(data, head_at, table.counter.cut))
    e = np.append(s[1:], n)
    heads = np.zeros(n, bool)
    heads[head_at] = True
    heads = heads[s]
    key = T.Spans(data).hash(s, e) ^ np.where(heads, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
    key, first, of = np.unique(key, return_index=True, return_inverse=True)
    of = of.reshape(-1)
    whole = data.tobytes()
    flat, size = table.counts(key.view(np.int64), [whole[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())], heads[first])
    ends = np.cumsum(size)
    # ragged gather of each segment's counts, plus the tokens of the segments before it in its row
    k = size[of]
    place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat((ends - size)[of], k)
    total = flat[ends - 1].astype(np.int64)[of]
    before = np.cumsum(total) - total
    row = np.searchsorted(off, s, "right") - 1
    # the first segment of each row begins at its offset
    base = before[np.searchsorted(s, off[row])]
    return flat[place] + np.repeat(before - base, k), coff


_TABLES: dict[int, SegmentTable] = {}


def _table(model: bytes) -> SegmentTable:
    """One table for each worker and model."""
    key = hash(model)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = SegmentTable(model)
    return _TABLES[key]


def _count(model, limit: int, prefixes: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model.value)
        for batch in batches:
            arr = pc.replace_substring(T.column(batch, "_text"), SPACE, " ")
            size = pc.coalesce(pc.binary_length(batch.column("_text")), pa.scalar(0, pa.int32()))
            for lo, hi, data, off in T.slices(arr):
                counts, coff = prefix_counts(table, data, off)
                full = np.diff(coff) > 0
                total = np.zeros(hi - lo, np.int64)
                total[full] = counts[coff[1:][full] - 1]
                # counts can fall by a merge, so the longest prefix within the limit is the last such
                within = np.where(counts <= limit, np.arange(1, len(counts) + 1), 0)
                last = np.zeros(hi - lo, np.int64)
                if full.any():
                    last[full] = np.maximum.reduceat(within, coff[:-1][full])
                    last = np.where(last > coff[:-1], last - coff[:-1], 0)
                cols = [batch.column("_id").slice(lo, hi - lo), size.slice(lo, hi - lo).cast(pa.int64()), pa.array(total), pa.array(last)]
                if prefixes:
                    cols.append(pa.ListArray.from_arrays(pa.array(coff, pa.int32()), pa.array(counts, pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT, text_col: str = "text", id_col: str = "doc_id",
                 prefixes: bool = False) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, limit_chars) of every row, and with
    ``prefixes`` the count at every character in ``prefix_tokens``.

    limit_chars is the longest prefix, in code points, of at most ``limit``
    tokens. Null and empty texts have no tokens. Repeated rows agree. The model
    file (under 1 MB for the public ones) is broadcast.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    fields = [base.schema["_id"], *(StructField(c, LongType()) for c in ("n_bytes", "n_tokens", "limit_chars"))]
    if prefixes:
        fields.append(StructField("prefix_tokens", ArrayType(LongType())))
    schema = StructType(fields)
    out = base.mapInArrow(_count(model, limit, prefixes, to_arrow_schema(schema)), schema)
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
                      "limit_chars", *(["prefix_tokens"] if prefixes else []))


def tokens_of_prefix(counted: DataFrame, n_chars: int) -> DataFrame:
    """``counted`` (with prefix_tokens) and the tokens of each first ``n_chars``."""
    at = F.least(F.lit(n_chars), F.size("prefix_tokens"))
    return counted.withColumn("tokens", F.when(at > 0, F.element_at("prefix_tokens", at)).otherwise(0).cast("long"))
