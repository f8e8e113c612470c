"""Recompression of word sequences, for whole chunks of texts, in numpy.

A round replaces every run of equal symbols by one symbol, then every pair
``ab`` whose ``a`` is of the left and ``b`` of the right half of the alphabet.
Halves and new names are hashes of what they stand for and of the round, so
every task of a cluster gives equal runs and pairs equal names without asking
another. Whether a symbol appears depends on the words around it only as far as
its context (``lo`` to ``hi``) reaches, so equal stretches of words hold equal
symbols, but for those near their ends.

Words are numbered with a gap of ``GAP`` between texts. What lies outside a text
counts as unknown: a symbol that depends on it has a context that no window of
the text contains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from obsflow.llm.words import Chunk, chunks, mix, power

_U = np.uint64
#: Numbers between the last word of a text and the first of the next.
GAP = 16
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@dataclass
class Words:
    """The words of a chunk: hashes by number (zero in gaps), and for each text its first number and its count."""

    chunk: Chunk
    hashes: np.ndarray
    firsts: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    begins: np.ndarray

    def numbers(self) -> np.ndarray:
        """The numbers of all words, in order."""
        return np.arange(len(self.starts)) + np.repeat(self.firsts - self.begins[:-1], self.counts)

    def windows(self, width: int) -> np.ndarray:
        """The numbers of the first words of all windows of ``width`` words."""
        n = np.maximum(self.counts - width + 1, 0)
        at = np.cumsum(n) - n
        return np.arange(n.sum()) + np.repeat(self.firsts - at, n)

    def texts(self, numbers: np.ndarray) -> np.ndarray:
        """The text of each word number, counted within the chunk."""
        return np.searchsorted(self.firsts, numbers, side="right") - 1


def word_chunks(texts: pa.Array) -> Iterator[Words]:
    """The words of a batch of texts, chunk by chunk; chunks hold whole texts. Null counts as empty."""
    for chunk in chunks(texts):
        starts, ends, begins = chunk.words()
        counts = np.diff(begins)
        firsts = begins[:-1] + GAP * np.arange(1, len(counts) + 1)
        hashes = np.zeros(len(starts) + GAP * (len(counts) + 2), dtype=_U)
        out = Words(chunk, hashes, firsts, counts, starts, ends, begins)
        hashes[out.numbers()] = chunk.hashes(chunk.sums(lower=False), starts, ends)
        yield out


class Stretches:
    """64-bit hashes of stretches of words, from running sums; ``which`` picks one of two independent ones."""

    def __init__(self, hashes: np.ndarray, which: int):
        base = _BASES[which]
        self.shift = power(pow(base, -1, 1 << 64), len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, dtype=_U)
        np.cumsum(mix(hashes + _U(base)) * power(base, len(hashes)), out=self.sums[1:], dtype=_U)

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.shift[lo] + (hi - lo).astype(_U) * _U(0xD6E8FEB86659FD93))


@dataclass
class Symbols:
    """Symbols in order: names, the words they stand for (start to end), and the words they depend on (lo to hi)."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def _around(s: Symbols, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts that take in the neighbours of the stretches ``first`` to ``last``; beyond a text's end nothing is known."""
    n = len(s.name)
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    lo = np.where((first > 0) & (s.end[before] == s.start[first]), s.lo[before], s.start[first] - 1)
    hi = np.where((last < n - 1) & (s.start[after] == s.end[last]), s.hi[after], s.end[last] + 1)
    return lo, hi


def name_runs(s: Symbols, turn: int) -> Symbols:
    """Every run of a symbol becomes one symbol, named by the symbol and the run's length."""
    joined = (s.name[1:] == s.name[:-1]) & (s.end[:-1] == s.start[1:])
    first = np.flatnonzero(np.r_[True, ~joined])
    last = np.r_[first[1:], len(s.name)] - 1
    long = last > first
    name = s.name[first]
    name[long] = mix(name[long] * _U(0xA24BAED4963EE407) + (last - first + 1)[long].astype(_U) * _U(0x9FB21C651E98DF25) + _U(2 * turn))
    lo, hi = _around(s, first, last)
    return Symbols(name, s.start[first], s.end[last], lo, hi)


def name_pairs(s: Symbols, turn: int) -> Symbols:
    """Every left symbol before a right symbol becomes one symbol with it, named by both."""
    left = (mix(s.name + _U(turn * 0x51_7CC1)) & _U(1)).astype(bool)
    pair = left[:-1] & ~left[1:] & (s.end[:-1] == s.start[1:])
    first = np.flatnonzero(np.r_[True, ~pair])
    paired = np.r_[pair, False][first]
    last = first + paired
    name = s.name[first]
    name[paired] = mix(name[paired] * _U(0x8CB92BA72F3D8DD7) + mix(s.name[last[paired]]) + _U(2 * turn + 1))
    lo, hi = _around(s, first, last)
    # A pair depends on itself alone; a single left symbol on what follows, a single right one on what is before.
    lo = np.where(paired | left[first], s.lo[first], lo)
    hi = np.where(paired | ~left[first], s.hi[last], hi)
    return Symbols(name, s.start[first], s.end[last], lo, hi)


def compress(words: Words, rounds: int) -> Symbols:
    """The symbols after so many rounds."""
    at = words.numbers()
    s = Symbols(words.hashes[at], at, at + 1, at, at + 1)
    for turn in range(rounds):
        if not len(s.name):
            break
        s = name_pairs(name_runs(s, turn), turn)
    return s


def anchors(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``width`` words its first word's number, its anchor and the anchor's key.

    The anchor is that symbol of the first round, among those whose context lies
    inside the window, whose hashed name is smallest (the leftmost of equals). It
    is a function of the window's words alone, and neighbouring windows mostly
    share it. Its key is the hash of its context. A window without one (inside a
    long run) is its own anchor, with a negative number.
    """
    at = words.windows(width)
    s = compress(words, 1)
    stretch = Stretches(words.hashes, 0)
    if not len(at):
        return at, at, np.zeros(0, dtype=_U)
    low = np.searchsorted(s.lo, at, side="left")
    count = np.searchsorted(s.hi, at + width, side="right") - low
    rank = mix(s.name ^ _U(0x2545F4914F6CDD1D))
    better = lambda i, j: np.where(rank[j] < rank[i], j, i)
    best, chosen, step = np.arange(len(s.name)), -1 - np.arange(len(at)), 1
    while step <= width:
        fits = (count >= step) & (count < 2 * step)
        chosen[fits] = better(best[low[fits]], best[low[fits] + count[fits] - step])
        best = better(best, best[np.minimum(np.arange(len(best)) + step, len(best) - 1)])
        step *= 2
    own = chosen < 0
    picked = np.maximum(chosen, 0)
    lo, hi = np.where(own, at, s.lo[picked]), np.where(own, at + width, s.hi[picked])
    return at, chosen, stretch(lo, hi)
