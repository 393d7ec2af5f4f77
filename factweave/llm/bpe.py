"""Exact byte-pair encoding by dynamic programming over prefixes.

The encoding of a byte string by merges in rank order is the only token sequence that decodes to it and in which every
two neighbours are *compatible*: encoding the bytes of the pair gives the pair. So every prefix has one last token that
can end its encoding. The candidates for a prefix are the tokens that are suffixes of it, which an automaton over the
vocabulary lists; the one that is compatible with the last token of the prefix before it is stored, and following these
back from the end gives the ids. A compatibility test splits both tokens along their inner edge, last merge first, and
never looks at the rest of the text.
"""

from __future__ import annotations

import base64
from array import array
from pathlib import Path

#: Pieces remembered per worker; the table starts anew when it is full, so memory is bounded whatever the texts.
CACHE_PIECES = 400_000


class Vocabulary:
    """Tokens by rank from a ``.tiktoken`` file: one line per token, base64 of its bytes and the rank."""

    def __init__(self, path: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self._automaton = None
        self._pairs: dict[tuple[int, int], int] | None = None
        self._split: dict[int, tuple[int, int]] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def _build(self) -> None:
        """For each token the two tokens whose merge makes it, in rank order, and the automaton of all tokens merges make."""
        import ahocorasick

        self._pairs, self._automaton = {}, ahocorasick.Automaton()
        for rank in sorted(self.bytes):
            token = self.bytes[rank]
            if len(token) > 1:
                pair = self._halves(token, rank)
                if pair is None:
                    continue  # only ever a whole piece
                self._split[rank] = pair
                self._pairs[pair] = rank
            self._automaton.add_word(token.decode("latin-1"), rank)
        self._automaton.make_automaton()

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The encoding of ``token`` by the merges before ``rank``, if it has two tokens."""
        for i in range(1, len(token)):
            a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
            if a is not None and b is not None and a < rank and b < rank and self._keeps_apart(a, b):
                return a, b
        return None

    def _keeps_apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses the edge between the tokens ``a`` and ``b``.

        The merges at the edge are undone from the last to the first. While a part stood there, a crossing merge would
        have run if it came before the merge just undone: of equal ranks the left one comes first.
        """
        limit = 1 << 62
        while True:
            crossing = self._pairs.get((a, b))
            if crossing is not None and crossing < limit:
                return False
            left, right = self._split.get(a), self._split.get(b)
            if left and (a > b or not right):
                limit, a = a, left[1]
            elif right:
                limit, b = b + 1, right[0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of the two tokens gives just these two."""
        fits = self._fits.get((left, right))
        if fits is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            fits = self._fits[left, right] = self._keeps_apart(left, right)
        return fits

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if self._automaton is None:
            self._build()
        n = len(piece)
        last: list[int | None] = [None] * (n + 1)
        for end, rank in self._automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] is not None:
                continue
            start = end - len(self.bytes[rank])
            before = last[start]
            if start == 0 or (before is not None and self.compatible(before, rank)):
                last[end] = rank
        ids = []
        while n:
            rank = last[n]
            ids.append(rank)
            n -= len(self.bytes[rank])
        return tuple(reversed(ids))


class Encoder:
    """Texts to ids: split by the pattern of the vocabulary, each new piece by :meth:`Vocabulary.encode`."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian 32-bit integers; of an empty or null text none."""
        if not text:
            return b""
        known = self.known
        pieces = self.split(text)
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > CACHE_PIECES:
            known.clear()
        encode = self.vocabulary.encode
        for p in pieces:
            if p not in known:
                known[p] = array("i", encode(p.encode("utf-8", "replace"))).tobytes()
        return b"".join(map(known.__getitem__, pieces))
