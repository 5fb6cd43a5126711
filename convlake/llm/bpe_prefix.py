"""Last BPE token at every prefix, by dynamic programming over suffix matches.

The tokens of the encoding of a prefix are fixed by its last token: among all
pieces that end there it is the only one that can stand after the last token of
what is left of it. So one pass over a segment stores one token for each prefix,
and following the stored tokens back from any prefix gives its exact encoding.

* ``PieceAutomaton``: its state is the longest suffix of the symbols read that
  begins a piece, suffix links lead to shorter ones, and so to all pieces that
  end here, longest first.
* ``Merges.apart``: whether two pieces stay apart side by side. The pieces'
  merges are undone from the latest to the earliest; at any time the two that
  face each other must have no merge that would come first.
* ``PrefixTokens``: the pass itself. Segments in sorted order go on from the
  prefix they share with the one before.
"""

from __future__ import annotations

from collections.abc import Sequence

SYMBOL_BITS = 21
#: Pairs remembered in a worker, about 100 bytes each.
REMEMBERED = 400_000
NEVER = 1 << 60


class PieceAutomaton:
    """Suffix matches of pieces (sequences of symbols below 2 ** 21)."""

    def __init__(self, pieces: Sequence[Sequence[int]]) -> None:
        self.edge: dict[int, int] = {}
        self.depth, self.piece, up = [0], [-1], [(0, 0)]
        for k, symbols in enumerate(pieces):
            q = 0
            for x in symbols:
                key = q << SYMBOL_BITS | x
                nxt = self.edge.get(key)
                if nxt is None:
                    nxt = self.edge[key] = len(self.depth)
                    self.depth.append(self.depth[q] + 1)
                    self.piece.append(-1)
                    up.append((q, x))
                q = nxt
            self.piece[q] = k
        n = len(self.depth)
        self.fail = [0] * n
        #: The longest piece that is a suffix of the state (as a state, 0 if none), and the next shorter one of a piece.
        self.out, self.shorter = [0] * n, [0] * n
        for q in sorted(range(1, n), key=self.depth.__getitem__):
            p, x = up[q]
            if p:
                self.fail[q] = self.step(self.fail[p], x)
            self.shorter[q] = self.out[self.fail[q]]
            self.out[q] = q if self.piece[q] >= 0 else self.shorter[q]

    def step(self, q: int, x: int) -> int:
        edge, fail = self.edge, self.fail
        nxt = edge.get(q << SYMBOL_BITS | x)
        while nxt is None and q:
            q = fail[q]
            nxt = edge.get(q << SYMBOL_BITS | x)
        return nxt or 0


class Merges:
    """Merges of a BPE model: ``rank`` of each piece's own merge (single symbols:
    -1), its two halves, and ``joined(x, y)``, the rank of merging x and y or None.
    Pieces that are merged no later than one of their halves have no such order
    (runs of spaces of one score); for these ``direct`` encodes a list of pieces."""

    def __init__(self, rank: Sequence[int], left: Sequence[int], right: Sequence[int], joined, direct=None) -> None:
        self.rank, self.left, self.right, self.joined, self.direct = rank, left, right, joined, direct
        self.odd: set[int] = set()

        def is_odd(k: int) -> bool:
            return k in self.odd or rank[k] >= 0 and max(rank[left[k]], rank[right[k]]) >= rank[k]

        todo = [k for k in range(len(rank)) if rank[k] >= 0]
        while more := [k for k in todo if k not in self.odd and (is_odd(k) or left[k] in self.odd or right[k] in self.odd)]:
            self.odd.update(more)
        if self.odd and direct is None:
            raise ValueError("a piece is merged before its halves")

    def apart(self, x: int, y: int, before: int = NEVER) -> bool:
        """True if no merge of a rank under ``before`` joins across x and y side by side."""
        if x in self.odd or y in self.odd:
            return self.direct([x, y]) == [x, y]
        rank, left, right, joined = self.rank, self.left, self.right, self.joined
        over_x = over_y = NEVER  # when the piece at hand goes into a longer one on its own side
        while True:
            m = joined(x, y)
            # equal ranks are merged from the left
            if m is not None and m < before and m < over_x and m <= over_y:
                return False
            if rank[x] > rank[y]:
                over_x, x = rank[x], right[x]
            elif rank[y] >= 0:
                over_y, y = rank[y], left[y]
            else:
                return True

    def whole(self) -> list[bool]:
        """For each piece: the model encodes its string as this one piece."""
        ok = [True] * len(self.rank)
        for k in sorted(range(len(ok)), key=self.rank.__getitem__):
            if self.rank[k] >= 0:
                a, b = self.left[k], self.right[k]
                ok[k] = self.direct([k]) == [k] if k in self.odd else ok[a] and ok[b] and self.apart(a, b, self.rank[k])
        return ok


class PrefixTokens:
    """The last token at each prefix of a segment; -1 stands for a symbol that no
    piece ends with, which is a token by itself and joins nothing."""

    def __init__(self, pieces: Sequence[Sequence[int]], merges: Merges) -> None:
        whole = merges.whole()
        self.names = [k for k, w in enumerate(whole) if w]
        self.auto = PieceAutomaton([pieces[k] for k in self.names])
        #: State of each last token -> piece and length.
        self.piece = [self.names[p] if p >= 0 else -1 for p in self.auto.piece]
        self.merges = merges
        self.pairs: dict[int, bool] = {}
        self.symbols: Sequence[int] = ()
        self.states, self.last, self.count = [0], [0], [0]

    def run(self, s: Sequence[int]) -> int:
        """Fills ``last`` (states of ``auto``; 0: an unknown symbol) and ``count``
        (tokens; an unknown symbol takes one for each byte of its UTF-8) for s[:1],
        s[:2], ... at 1, 2, ...; returns the length shared with the segment before."""
        auto, pairs, apart, piece = self.auto, self.pairs, self.merges.apart, self.piece
        edge, fail, out, shorter, depth = auto.edge, auto.fail, auto.out, auto.shorter, auto.depth
        shared, most, old = 0, min(len(s), len(self.symbols)), self.symbols
        while shared < most and s[shared] == old[shared]:
            shared += 1
        states, last, count = self.states[: shared + 1], self.last[: shared + 1], self.count[: shared + 1]
        q, n = states[-1], len(piece)
        for i in range(shared, len(s)):
            x = s[i]
            nxt = edge.get(q << SYMBOL_BITS | x)
            while nxt is None and q:
                q = fail[q]
                nxt = edge.get(q << SYMBOL_BITS | x)
            q = nxt or 0
            t = out[q]
            while t:
                j = i + 1 - depth[t]
                b = last[j]
                if not b:  # at the start, or after an unknown symbol
                    break
                key = b * n + t
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= REMEMBERED:
                        pairs.clear()
                    ok = pairs[key] = apart(piece[b], piece[t])
                if ok:
                    break
                t = shorter[t]
            states.append(q)
            last.append(t)
            count.append(count[j] + 1 if t else count[i] + len(chr(x).encode()))
        self.symbols, self.states, self.last, self.count = s, states, last, count
        return shared

    def tokens(self, n: int) -> list[int]:
        """Pieces of the first ``n`` symbols, back from the last token."""
        out, last, depth, piece = [], self.last, self.auto.depth, self.piece
        while n > 0:
            t = last[n]
            out.append(piece[t])
            n -= depth[t] or 1
        out.reverse()
        return out
