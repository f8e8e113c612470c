"""Words, lines and their hashes for whole Arrow batches of texts, in numpy.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashes are 64 bit: a polynomial over table
values of the bytes, taken from one running sum for each chunk of texts, then
mixed. Texts are never cut; a chunk holds whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finisher)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE)) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = 1 << max(19, int(n - 1).bit_length())
        steps = np.full(size, _U(base), dtype=_U)
        steps[0] = _U(1)
        got = _powers[base] = np.cumprod(steps, dtype=_U)
    return got[:n]


@dataclass
class Chunk:
    """Some whole texts: rows ``lo`` to ``hi`` of the batch, their bytes one after another."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def sums(self, lower: bool) -> np.ndarray:
        """Running sums whose differences give the hash of any stretch of bytes."""
        data = _LOWER[self.data] if lower else self.data
        out = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(_VALUES[data] * power(_BASE, len(data)), out=out[1:], dtype=_U)
        return out

    def hashes(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the stretches from ``starts`` to ``ends``."""
        shift = power(_BASE_INVERSE, len(self.data) + 1)[starts]
        return mix((sums[ends] - sums[starts]) * shift + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and where each text's words begin (one entry more than texts)."""
        inside = _IS_WORD[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        n = len(self.data)
        edge = self.offsets[:-1][self.offsets[:-1] < n]
        first[edge] = inside[edge]
        edge = self.offsets[1:][self.offsets[1:] > 0] - 1
        last[edge] = inside[edge]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.offsets)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def chunks(texts: pa.Array, limit: int = 1 << 18) -> Iterator[Chunk]:
    """Cut a batch between texts, at about ``limit`` bytes; a longer text is a chunk of its own. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def windows(hashes: np.ndarray, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, by first word, and where each text's runs begin."""
    counts = np.maximum(np.diff(begins) - width + 1, 0)
    at = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=at[1:])
    first = np.arange(at[-1]) + np.repeat(begins[:-1] - at[:-1], counts)
    out = np.zeros(at[-1], dtype=_U)
    for k in range(width):
        out = mix(out + hashes[first + k] * _U(2 * k + 3))
    return out, at


def shingles(chunk: Chunk, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct hashes of ``width`` lower-cased words; a shorter text is one shingle."""
    starts, ends, begins = chunk.words()
    hashes = chunk.hashes(chunk.sums(lower=True), starts, ends)
    runs, at = windows(hashes, begins, width)
    for i in range(len(begins) - 1):
        if at[i + 1] > at[i]:
            own = np.sort(runs[at[i] : at[i + 1]])
            yield own[np.r_[True, own[1:] != own[:-1]]]
        elif begins[i + 1] > begins[i]:
            own = hashes[begins[i] : begins[i + 1]]
            whole = mix(own + np.arange(1, len(own) + 1, dtype=_U) * _U(_BASE)).sum(dtype=_U, keepdims=True)
            yield mix(whole + _U(len(own)))
        else:
            yield np.zeros(0, dtype=_U)
