"""Byte-level BPE encoding and decoding by last tokens of prefixes.

A text is split at the tokenizer's added tokens and then, as its ByteLevel
pre-tokenizer does, into segments of letters, digits or other characters, with one
space in front, contractions and white space. Segment borders are found on whole
slices at once. A different segment is encoded once (``bpe_prefix``) and looked up
by its 64-bit hash after that; the ids of a text are its segments' ids end to end.
Decoding lays the ids' bytes end to end; what is not UTF-8 becomes U+FFFD.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm import text as T
from convlake.llm.bpe_prefix import Merges, PrefixTokens

#: Different segments whose ids a worker remembers, about 150 bytes each.
REMEMBERED = 400_000
#: Longer segments are not remembered.
LONGEST = 64
OTHER, LETTER, DIGIT, WHITE = range(4)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself
    if printable in Latin-1, else the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    out |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return out


def character_classes() -> np.ndarray:
    r"""Class of each code point: letters (\p{L}), digits (\p{N}), white space (\s)
    as the installed tokenizers library has them, for its version of Unicode
    decides the segments. Above U+3FFFF there are none."""
    from tokenizers import Regex, pre_tokenizers

    points = np.array([*range(0xD800), *range(0xE000, 0x40000)])
    text = "".join(map(chr, points))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (WHITE, r"\s+")):
        here = np.ones(len(points), bool)
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text):
            here[a:b] = False
        out[points[here]] = kind
    return out


class Codec:
    """Vocabulary, merges and added tokens of a byte-level BPE tokenizer file."""

    def __init__(self, spec: bytes, classes: bytes | None) -> None:
        d = json.loads(spec)
        model, pre = d["model"], d["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
               if model.get(k)]
        if (model["type"] != "BPE" or odd or d["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or (d["decoder"] or {}).get("type") != "ByteLevel"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        added = d["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("an added token takes more than its own characters")
        self.added = {t["content"].encode(): t["id"] for t in sorted(added, key=lambda t: -len(t["content"]))}
        alphabet, vocab = byte_alphabet(), model["vocab"]
        names = sorted(vocab, key=vocab.get)
        index = {s: k for k, s in enumerate(names)}
        self.ids = np.array([vocab[s] for s in names], np.uint32)
        pieces = [bytes(alphabet[c] for c in s) for s in names]
        rank, left, right = ([-1] * len(names) for _ in range(3))
        at: dict[int, int] = {}
        n = len(names)
        for r, merge in enumerate(model["merges"]):
            a, b = (index[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            k = index[names[a] + names[b]]
            if rank[k] >= 0:
                raise ValueError("two merges give one token")
            rank[k], left[k], right[k] = r, a, b
            at[a * n + b] = r
        if any(r < 0 and len(p) > 1 for r, p in zip(rank, pieces)):
            raise ValueError("a token has no merge")
        self.known: dict[int, bytes] = {}
        if classes is not None:
            self.classes = np.frombuffer(classes, np.uint8)
            self.prefixes = PrefixTokens(pieces, Merges(rank, left, right, lambda x, y: at.get(x * n + y)))
        # bytes of every id end to end
        whole = dict(zip(self.ids.tolist(), pieces)) | {i: t for t, i in self.added.items()}
        rows = [whole.get(i, b"") for i in range(max(whole) + 1)]
        self.size = np.array([*map(len, rows), 0], np.int64)  # the last entry: ids outside the vocabulary
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(rows), np.uint8)

    def encoded(self, segments: list[tuple[bytes, int]]) -> dict[int, bytes]:
        """Ids (little-endian) of different segments (bytes, hash) by hash."""
        out, flat, ends = {}, [], []
        if len(self.known) + len(segments) > REMEMBERED:
            self.known.clear()
        segments.sort()
        run, tokens = self.prefixes.run, self.prefixes.tokens
        for s, _ in segments:
            run(s)
            flat += tokens(len(s))
            ends.append(len(flat) * 4)
        packed, at = self.ids[flat].astype("<u4").tobytes(), 0
        for (s, key), end in zip(segments, ends):
            out[key] = packed[at:end]
            at = end
            if len(s) <= LONGEST:
                self.known[key] = out[key]
        return out


def segment_starts(cp: np.ndarray, new: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """True where a segment starts, for the code points of texts end to end;
    ``new`` marks the first of each text."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    kind = classes[cp]
    run = new.copy()
    run[1:] |= kind[1:] != kind[:-1]
    ends_run = np.append(run[1:], True)
    ends_text = np.append(new[1:], True)
    space = cp == 32
    white = kind == WHITE
    after_space = np.zeros(n, bool)
    after_space[1:] = space[:-1] & ~new[1:]
    start = run & (white | ~after_space)
    # the last white space before another character stands alone, or in front of it if it is a space
    start |= white & ends_run & ~ends_text
    # contractions: an apostrophe that begins a segment, with its letters
    a = np.flatnonzero((cp == 39) & start)
    if len(a):
        left = np.searchsorted(np.flatnonzero(new), a, "right")
        stop = np.append(np.flatnonzero(new), n)[left]
        padded = np.append(cp, [0, 0])
        one, two = padded[a + 1], padded[a + 2]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for x, y in ("re", "ve", "ll"):
            size = np.where((one == ord(x)) & (two == ord(y)) & (a + 2 < stop), 3, size)
        size = np.where(a + size <= stop, size, 0)
        a, size, stop = a[size > 0], size[size > 0], stop[size > 0]
        start[a + 1] = False
        end = a + size
        start[end[end < stop]] = True
    return start


def _parts(raw: bytes, off: np.ndarray, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows cut at added tokens: (starts, ends, id of the added token or -1)."""
    found: list[tuple[int, int, int]] = []
    if any(t in raw for t in added):
        for lo, hi in zip(off[:-1].tolist(), off[1:].tolist()):
            while True:
                hits = [(at, -len(t), i) for t, i in added.items() if (at := raw.find(t, lo, hi)) >= 0]
                if not hits:
                    break
                at, size, i = min(hits)
                found.append((at, at - size, i))
                lo = at - size
    cut = np.unique(np.concatenate([off, [x for f in found for x in f[:2]]]).astype(np.int64))
    ids = np.full(max(len(cut) - 1, 0), -1, np.int64)
    ids[np.searchsorted(cut, [f[0] for f in found])] = [f[2] for f in found]
    return cut[:-1], cut[1:], ids


def encode_slice(codec: Codec, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows end to end, and the rows' offsets among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    raw = data.tobytes()
    begin, end, special = _parts(raw, off, codec.added)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # bytes at which characters start
    cp = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    new = np.zeros(n, bool)
    new[begin] = True
    start = segment_starts(cp, new[at], codec.classes)
    if (special >= 0).any():
        inside = np.zeros(n + 1, np.int64)
        inside[begin[special >= 0]] += 1
        inside[end[special >= 0]] -= 1
        start &= ~(np.cumsum(inside[:n]) > 0)[at]
        start[np.searchsorted(at, begin[special >= 0])] = True
    s = at[start]
    e = np.append(s[1:], n)
    key = T.Spans(data).hash(s, e)
    if (special >= 0).any():
        # an added token is no segment: a key of its own
        k = np.searchsorted(s, begin[special >= 0])
        key[k] = T.mix(special[special >= 0].astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
    key, first, of = np.unique(key.view(np.int64), return_index=True, return_inverse=True)
    keys = key.tolist()
    per = [codec.known.get(k) for k in keys]
    fixed = {}
    if (special >= 0).any():
        by_start = dict(zip(begin[special >= 0].tolist(), special[special >= 0].tolist()))
        fixed = {k: np.uint32(by_start[p]).tobytes() for k, p in zip(keys, s[first].tolist()) if p in by_start}
    fresh = codec.encoded([(raw[a:b], k) for k, a, b, x in zip(keys, s[first].tolist(), e[first].tolist(), per)
                           if x is None and k not in fixed])
    per = [fixed.get(k) or x or fresh[k] for k, x in zip(keys, per)]
    size = np.array([len(x) // 4 for x in per], np.int64)
    flat = np.frombuffer(b"".join(per), "<u4")
    many = size[of.reshape(-1)]
    ids = flat[T.ragged((np.cumsum(size) - size)[of.reshape(-1)], many)]
    return ids, np.concatenate([[0], np.cumsum(many)])[np.searchsorted(s, off)]


def decode_slice(codec: Codec, ids: np.ndarray, off: np.ndarray) -> pa.Array:
    """Texts of rows of ids; ids outside the vocabulary have no characters."""
    known = np.minimum(ids, len(codec.size) - 1).astype(np.int64)
    size = codec.size[known]
    data = codec.bytes[T.ragged(codec.begin[known], size)]
    to = np.concatenate([[0], np.cumsum(size)])[off]
    raw = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data)])
    try:
        return raw.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())


_CODECS: dict[int, Codec] = {}


def _codec(spec, classes) -> Codec:
    """One codec for each worker and tokenizer file."""
    key = hash((spec.value, classes is None))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec.value, None if classes is None else classes.value)
    return _CODECS[key]


def _file(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _column_names(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns _k0, _k1, ..., and their own names."""
    return df.toDF(*(f"_k{i}" for i in range(len(df.columns)))), df.columns


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", arrays: bool = False) -> DataFrame:
    """``docs`` with its texts replaced by ``ids_col``: their token ids as
    unsigned 32-bit little-endian integers (what ``decode`` takes), or with
    ``arrays`` as an array of longs.

    Nothing is added, cut or padded. Added tokens inside a text get their own id.
    Null and empty texts have no ids. Rows are handled one by one, so repeated
    rows agree; all other columns are kept, one that is named ``ids_col`` is
    replaced. The tokenizer file (a few MB for the public ones) is broadcast.
    """
    kept = docs.drop(*({ids_col} - {text_col}))
    base, names = _column_names(kept.select(*(f"`{c}`" for c in kept.columns if c != text_col), text_col))
    fields = base.columns
    last = fields[-1]
    spec = _file(docs, tokenizer_path)
    classes = docs.sparkSession.sparkContext.broadcast(character_classes().tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec, classes)
        for batch in batches:
            for lo, hi, data, off in T.slices(T.column(batch, last)):
                ids, to = encode_slice(codec, data, off)
                out = (pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids, pa.int64())) if arrays else
                       pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((to * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in fields[:-1]), out], fields)

    schema = base.select(*fields[:-1], (F.array().cast("array<long>") if arrays else F.lit(b"")).alias(last)).schema
    return base.mapInArrow(run, schema).toDF(*names[:-1], ids_col)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the column ``text_col``: the text of its ids, added tokens
    with theirs. Null ids have the empty text. All columns are kept, one that is
    named ``text_col`` is replaced."""
    kept = encoded.drop(text_col)
    base, names = _column_names(kept)
    fields = base.columns
    source = fields[names.index(ids_col)]
    spec = _file(encoded, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec, None)
        for batch in batches:
            rows = batch.column(source).cast(pa.large_binary()).fill_null(b"")
            for lo, hi, data, off in _binary_slices(rows):
                text = decode_slice(codec, data.view("<u4"), off // 4)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in fields), text.cast(pa.string())],
                                                 [*fields, "_text"])

    schema = base.select("*", F.lit("").alias("_text")).schema
    return base.mapInArrow(run, schema).toDF(*names, text_col)


def _binary_slices(rows: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    n = len(rows)
    if not n:
        return
    _, off, data = rows.buffers()
    off = np.frombuffer(off, np.int64)[rows.offset: rows.offset + n + 1]
    flat = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + T.SLICE_BYTES, "right")) - 1)
        yield lo, hi, np.ascontiguousarray(flat[off[lo]: off[hi]]), off[lo: hi + 1] - off[lo]
        lo = hi


def codec_digests(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, and its
    ids decoded again."""
    ids = encode(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), tokenizer_path, "_text")
    both = decode(ids, tokenizer_path)
    return both.select(F.col("_id").alias(id_col), F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
