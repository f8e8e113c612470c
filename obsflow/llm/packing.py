"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' tokens. In every round each queue's
credit grows by its quantum (its target share of a window); it serves what the
credit allows in whole tokens and carries the rest, its deficit, to the next
round. Queues with a quantum below ``SMALLEST`` save up until they can serve
that many at once. Exhausted queues are passed over. What the rounds serve is
one line of tokens, cut into windows, so every window but the last is full and
holds the target proportions up to the carried deficits.

Credit after ``r`` rounds is ``r * quantum``, so what a queue has served before
a round is a closed form, and the place of any token follows from its place in
its queue alone. Deficits therefore carry across windows and partitions
without a sequential pass: a task needs only its own tokens, the number of
tokens before them in their queue, and the table of queues.

Edge cases: null text is empty and its document is the end token alone; null
sources are a queue. Repeated rows are packed each. An empty table gives no
pieces. Of more than ``QUEUES`` sources the smallest share the last queue.
Sources of one size are queues in the order of their names. Very long texts are
tokenized whole and cut into as many pieces as they need. Columns other than
doc_id, source and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsflow.llm import tokens
from obsflow.llm.common import BATCH, bounded_broadcast, map_batches, stage, table

WINDOW = 2048
#: The id at the end of every document.
END_ID = 1
#: Fewest tokens that a queue serves at once.
SMALLEST = 64
#: The table of queues is broadcast and has at most so many rows.
QUEUES = 1024
#: Starts of (task, source) are broadcast up to so many rows, and else joined by shuffle.
BROADCAST_ROWS = 200_000
#: Quanta are counted in these parts of a token.
PARTS = 1 << 16


def _tokenize(path: str, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, coder = TaskContext.get().partitionId(), tokens.encoder(path, width)
        before: dict[str | None, int] = {}
        end = np.array([END_ID], dtype=width).tobytes()
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                ids = [x + end for x in coder.encode(batch.column("text").to_pylist())]
                counts = [len(x) // len(end) for x in ids]
                at = []
                for source, n in zip(batch.column("source").to_pylist(), counts, strict=True):
                    at.append(before.get(source, 0))
                    before[source] = at[-1] + n
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array([task] * len(ids), pa.int32()), pa.array(at, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "task", "task_start", "doc_tokens", "ids"])

    return run


class Queues:
    """Sizes and quanta of all queues, and where the round-robin puts their tokens."""

    def __init__(self, sizes: list[int], shares: list[float], window: int):
        self.window = window
        self.size = np.array(sizes, dtype=np.int64)
        self.quantum = np.maximum(np.rint(np.array(shares) * window * PARTS).astype(np.int64), 1)
        self.grain = np.where(self.quantum >= SMALLEST * PARTS, 1, SMALLEST).astype(np.int64)

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue has served before each of ``rounds`` (round by queue)."""
        return np.minimum(rounds[:, None] * self.quantum // (self.grain * PARTS) * self.grain, self.size)

    def round_of(self, queue: int, place: np.ndarray) -> np.ndarray:
        """The round that serves the token at each place of a queue."""
        grain, quantum = int(self.grain[queue]), int(self.quantum[queue])
        need = (place // grain + 1) * (grain * PARTS)
        return -(-need // quantum) - 1

    def pieces(self, queue: int, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pieces of documents that hold tokens ``start`` to ``start + n`` of a queue.

        For each piece: which document, its place in the line, its length and how many of the document's tokens come before.
        """
        grain = int(self.grain[queue])
        if grain > 1:
            first, last = start // grain, (start + n - 1) // grain
        else:
            first, last = self.round_of(queue, start), self.round_of(queue, start + n - 1)
        doc, nth = _spread(last - first + 1)
        rounds = first[doc] + nth
        if grain > 1:
            rounds = self.round_of(queue, rounds * grain)
        now, then = self.served(rounds), self.served(rounds + 1)
        lo = np.maximum(now[:, queue], start[doc])
        hi = np.minimum(then[:, queue], (start + n)[doc])
        at = then[:, :queue].sum(axis=1) + now[:, queue:].sum(axis=1) + lo - now[:, queue]
        keep = hi > lo
        doc, at, size = doc[keep], at[keep], (hi - lo)[keep]
        # Cut at window ends.
        of, nth = _spread((at + size - 1) // self.window - at // self.window + 1)
        doc, window = doc[of], at[of] // self.window + nth
        begin = np.maximum(at[of], window * self.window)
        stop = np.minimum((at + size)[of], (window + 1) * self.window)
        # Pieces of a document that follow one another in one window are one piece.
        new = np.ones(len(begin), dtype=bool)
        new[1:] = (begin[1:] != stop[:-1]) | (window[1:] != window[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        length = np.add.reduceat(stop - begin, heads)
        doc, before = doc[heads], np.cumsum(length) - length
        own = np.searchsorted(doc, np.arange(len(start)))
        return doc, begin[heads], length, before - before[own][doc]


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` that many entries: whose they are, and the how-manieth each is."""
    whose = np.repeat(np.arange(len(counts)), counts)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts)


def _deal(queues: Queues, width: str):
    step = max(1, 8192 // max(len(queues.size), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            whole = whole.take(pa.array(np.argsort(np.asarray(whole.column("queue")), kind="stable")))
            own = np.asarray(whole.column("queue"))
            cuts = sorted({*np.flatnonzero(own[1:] != own[:-1]) + 1, *range(0, len(own), step), len(own)})
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                batch = whole.slice(lo, hi - lo)
                start, n = (np.asarray(batch.column(c)) for c in ("queue_start", "doc_tokens"))
                doc, line, length, before = queues.pieces(int(own[lo]), start, n)
                # Pieces come in the order of the tokens, so their ids are one run of bytes.
                data = np.concatenate([np.frombuffer(x.as_buffer(), width) for x in batch.column("ids")]).astype("<u4")
                ends = np.zeros(len(length) + 1, dtype=np.int32)
                np.cumsum(4 * length, out=ends[1:])
                ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("source").take(take), pa.array(before), pa.array(length), batch.column("doc_tokens").take(take), pa.array(line // queues.window), pa.array(line % queues.window), ids], ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Pack all documents (doc_id, source, text) into sequences of ``window`` tokens.

    One row for each piece: doc_id, source, start, length, doc_tokens,
    sequence_id, offset and ``ids`` (little-endian unsigned 32 bit). ``weights``
    are the target proportions by source (1 where a source has none); without
    them the target is the corpus's own, which lasts to the last window.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    path = tokenizer_path or tokens.default_path()
    width = "<u2" if tokens.vocabulary_size(path) <= 1 << 16 else "<u4"
    coded = map_batches(rows, _tokenize(path, width), f"doc_id {kind}, source string, task int, task_start long, doc_tokens long, ids binary")
    coded = stage(coded, "pack-ids", "zstd")
    parts = stage(coded.groupBy("task", "source").agg(F.max(F.col("task_start") + F.col("doc_tokens")).alias("n")), "pack-parts")
    sizes = parts.groupBy("source").agg(F.sum("n").alias("n"))
    ranked = sizes.withColumn("queue", F.least(F.row_number().over(W.orderBy(F.col("n").desc(), F.col("source").asc_nulls_last())) - 1, F.lit(QUEUES - 1)))
    by_queue = ranked.groupBy("queue").agg(F.sum("n").alias("n"), F.min("source").alias("source")).orderBy("queue").collect()
    share = [float(r["n"]) if weights is None else float(weights.get(r["source"], 1.0)) for r in by_queue]
    queues = Queues([r["n"] for r in by_queue], [x / sum(share) for x in share], window)
    upto = W.partitionBy("queue").orderBy("task", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    starts = parts.join(ranked.select(F.col("source").alias("_s"), "queue"), F.col("source").eqNullSafe(F.col("_s")))
    starts = starts.select(F.col("task").alias("_t"), "_s", "queue", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    starts = bounded_broadcast(starts, parts.count(), BROADCAST_ROWS)
    placed = coded.join(starts, (F.col("task") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_s")))
    placed = placed.select("doc_id", "source", "queue", (F.col("before") + F.col("task_start")).alias("queue_start"), "doc_tokens", "ids")
    return map_batches(placed, _deal(queues, width), f"doc_id {kind}, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
