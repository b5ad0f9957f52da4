"""A subword lattice over words: every way to cut a word into vocabulary pieces, weighted by scores.

A word is read with a space in front, as the vocabulary marks word starts. A character without a piece
is spelt in byte pieces. All sums run over arrays of words of one length at a time, in log space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces (a space stands for the mark of a word start), numbered; 256 byte pieces; the end piece."""

    pieces: list[str]
    byte_of: np.ndarray
    end: int

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_of = [], np.zeros(256, np.int64)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_of[int(piece[3:5], 16)] = i
            # control, unknown and byte pieces are no text
            pieces.append("" if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) else piece.replace("▁", " "))
        return cls(pieces, byte_of, sp.eos_id())


def _hash(codes: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """Hash of a string of characters, grown by one character."""
    x = (codes.astype(np.uint64) + np.uint64(1)) if before is None else before * _BASE + codes.astype(np.uint64) + np.uint64(1)
    return x


class Lattice:
    def __init__(self, vocabulary: Vocabulary, log_p: np.ndarray | None = None):
        """log_p: natural logarithm of each piece's probability; equal for all at first."""
        self.vocabulary = vocabulary
        n = len(vocabulary.pieces)
        self.log_p = np.full(n, -np.log(n)) if log_p is None else log_p
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, piece in enumerate(vocabulary.pieces):
            if piece:
                codes, h = np.array(list(map(ord, piece)), np.uint32), None
                for c in codes:
                    h = _hash(np.array([c], np.uint32), h)
                by_length.setdefault(len(piece), []).append((int(h[0]), i))
        self.tables = {}
        for length, rows in by_length.items():
            rows.sort()
            self.tables[length] = np.array([h for h, _ in rows], np.uint64), np.array([i for _, i in rows], np.int64)
        self.longest = max(self.tables, default=1)

    def _piece(self, h: np.ndarray, length: int) -> np.ndarray:
        """Number of the piece with each hash; -1 for none."""
        if length not in self.tables:
            return np.full(len(h), -1)
        hashes, numbers = self.tables[length]
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return np.where(hashes[at] == h, numbers[at], -1)

    def _spelt(self, code: int) -> np.ndarray:
        return self.vocabulary.byte_of[list(chr(code).encode("utf-8", "surrogatepass"))]

    def _arcs(self, codes: np.ndarray):
        """(start, end, rows, pieces, spelt) of every cut of words of one length, by start."""
        m, n = codes.shape
        for i in range(n):
            h = None
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = _hash(codes[:, j - 1], h)
                number = self._piece(h, j - i)
                rows = np.flatnonzero(number >= 0)
                if len(rows):
                    yield i, j, rows, number[rows], None
                if j == i + 1 and len(rows) < m:
                    rows = np.flatnonzero(number < 0)
                    yield i, j, rows, None, [self._spelt(c) for c in codes[rows, i].tolist()]

    def _score(self, numbers, spelt) -> np.ndarray:
        return self.log_p[numbers] if spelt is None else np.array([self.log_p[x].sum() for x in spelt])

    @staticmethod
    def _by_length(words: list[str]):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            joined = "".join([" " + words[i] for i in at.tolist()])
            yield at, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n + 1)

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of the probability of each word, summed over all ways to cut it."""
        out = np.zeros(len(words))
        for at, codes in self._by_length(words):
            forward = np.full((codes.shape[1] + 1, len(at)), -np.inf)
            forward[0] = 0
            for i, j, rows, numbers, spelt in self._arcs(codes):
                forward[j, rows] = np.logaddexp(forward[j, rows], forward[i, rows] + self._score(numbers, spelt))
            out[at] = forward[-1]
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each piece is expected over all cuts of all words, each word once."""
        counts = np.zeros(len(self.log_p))
        for _, codes in self._by_length(words):
            arcs = [(i, j, rows, numbers, spelt, self._score(numbers, spelt)) for i, j, rows, numbers, spelt in self._arcs(codes)]
            forward = np.full((codes.shape[1] + 1, codes.shape[0]), -np.inf)
            backward = forward.copy()
            forward[0] = backward[-1] = 0
            for i, j, rows, _, _, score in arcs:
                forward[j, rows] = np.logaddexp(forward[j, rows], forward[i, rows] + score)
            for i, j, rows, _, _, score in reversed(arcs):
                backward[i, rows] = np.logaddexp(backward[i, rows], backward[j, rows] + score)
            for i, j, rows, numbers, spelt, score in arcs:
                share = np.exp(forward[i, rows] + score + backward[j, rows] - forward[-1, rows])
                if spelt is None:
                    counts += np.bincount(numbers, share, len(counts))
                else:
                    for x, s in zip(spelt, share.tolist(), strict=True):
                        np.add.at(counts, x, s)
        return counts
