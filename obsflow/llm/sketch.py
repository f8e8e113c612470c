"""A count-min screen: which keys surely occur once in a whole corpus.

Every key has a cell in each of ``DEPTH`` rows; a cell counts the keys that fall
into it, up to two. A key's estimate is its smallest cell, which is never below
its true count, so an estimate of one proves that the key occurs once. Estimates
of two may be chance. Cells are counted inside tasks, merged by blocks in Spark,
and only the bits "two or more" are broadcast: at most ``DEPTH << MAX_BITS``
bits, whatever the corpus (beyond that many keys more are taken for repeated,
and callers, who look at those exactly, do more work for the same result).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from obsflow.llm.common import map_batches
from obsflow.llm.words import mix

_U = np.uint64
DEPTH = 2
#: Cells of a row: four for each key, a power of two from 2^MIN_BITS to 2^MAX_BITS.
MIN_BITS, MAX_BITS = 12, 30
#: Cells of a block, as bits, and keys that a task holds before it hands its cells on.
BLOCK_BITS, HELD = 20, 1 << 20


@dataclass
class Screen:
    """The merged cells: a bit is set where two or more keys fell into the cell."""

    bits: int
    twice: Broadcast

    def once(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key's estimate is one."""
        table = self.twice.value
        found = np.zeros(len(keys), dtype=bool)
        for row in range(DEPTH):
            cell = cells(keys, row, self.bits)
            found |= (table[row][cell >> _U(3)] >> (cell & _U(7)).astype(np.uint8)) & 1 == 0
        return found


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each key in one row."""
    return mix(keys ^ _U(0x632BE59BD9B4E019 * (row + 1) & (1 << 64) - 1)) >> _U(64 - bits)


def _counted(keys: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """(block, cells) of some keys: cells in order as differences, each with a bit for two or more."""
    block_bits = min(bits, BLOCK_BITS)
    for row in range(DEPTH):
        cell, n = np.unique(cells(keys, row, bits), return_counts=True)
        block = (cell >> _U(block_bits)).astype(np.int64)
        value = ((cell & _U((1 << block_bits) - 1)) << _U(1) | (n > 1).astype(_U)).astype(np.uint32)
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield (row << (bits - block_bits)) + int(block[lo]), zlib.compress(np.diff(value[lo:hi], prepend=np.uint32(0)).tobytes(), 1)


def screen(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected: int) -> Screen:
    """Screen the keys that ``keys`` finds in the batches of ``df``; ``expected`` is about how many there are."""
    bits = min(max(MIN_BITS, int(4 * expected).bit_length()), MAX_BITS)
    block_bits = min(bits, BLOCK_BITS)

    def pack(found: list[np.ndarray]) -> pa.RecordBatch:
        blocks, held = zip(*_counted(np.concatenate(found), bits), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(held, pa.binary())], ["block", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            for some in keys(batch):
                if len(some):
                    found.append(some)
                    n += len(some)
                if n >= HELD:
                    yield pack(found)
                    found, n = [], 0
        if n:
            yield pack(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their blocks; one block's cells are held at a time."""
        now, sums = -1, np.zeros(0, dtype=np.uint8)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(sums > 1, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])
        for batch in batches:
            for block, held in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if block != now:
                    if now >= 0:
                        yield done()
                    now, sums = block, np.zeros(1 << block_bits, dtype=np.uint8)
                value = np.cumsum(np.frombuffer(zlib.decompress(held), dtype=np.uint32), dtype=np.uint32)
                at = value >> 1
                sums[at] = np.minimum(sums[at] + 1 + (value & 1).astype(np.uint8), 2)
        if now >= 0:
            yield done()

    counted = map_batches(df, count, "block long, cells binary")
    merged = counted.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary")
    table = np.zeros((DEPTH, (1 << bits) >> 3), dtype=np.uint8)
    flat = table.reshape(-1)
    for row in merged.toLocalIterator():
        at = row.block << (block_bits - 3)
        flat[at : at + len(row.bits)] = np.frombuffer(row.bits, dtype=np.uint8)
    return Screen(bits, df.sparkSession.sparkContext.broadcast(table))
