"""Removal of repeated word sequences, by recompression (see :mod:`obsflow.llm.recompress`).

A window is ``WINDOW`` consecutive words of one document. A word is removed if a
window over it also starts in a document with a smaller doc_id. Three rounds of
names find those windows, each on what the round before left open:

1. Low symbols. Every window has an anchor, a symbol of the first round of
   recompression inside it, so equal windows have equal anchors. A count-min
   screen over all anchors proves most to be single; windows at those occur once
   and are settled. What is left of a document are segments of text.
2. High symbols. Segments are recompressed ``ROUNDS`` times; equal stretches
   consist of equal symbols inside. A symbol with the words that its windows
   reach is a unit. Units that also stand in a smaller doc_id are long repeats:
   all their windows are settled, and so covered.
3. Windows that no such unit holds are named one by one and verified.

The result is exact: a unit or window is only taken for a repeat by 128 bits of
the hash of its words, and each window is open in the smallest document that has
it. Only counts of names meet by key, after partial aggregation; what finds its
name again by join are rows, which Spark can split. The screen's size is bounded.

Edge cases: null text is empty; rows with a null doc_id are neither smaller nor
larger than others, so they lose nothing and make others lose nothing. Rows that
share a doc_id don't repeat one another. Repeated rows have the same result
each. Texts of fewer words than a window lose nothing; texts are never cut short,
however long. Empty tables give no rows. Other columns aren't read, whatever
their names; kept columns may have any name but n_words, n_removed, removed, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.llm.common import discard, map_batches, stage, table
from obsflow.llm.recompress import Stretches, Words, anchors, compress, word_chunks
from obsflow.llm.sketch import Screen, screen
from obsflow.llm.words import mix

WINDOW = 13
#: Rounds of recompression of the units: symbols of about nine words.
ROUNDS = 7
#: Open windows so near to one another are cut out together.
NEAR = 4
#: For the size of the screen alone: characters for each anchor.
CHARS = 30

_U = np.uint64
_SEGMENT = ["doc_id", "text_hash", "first"]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The keys of all anchors, each once for a document."""
    for words in word_chunks(batch.column("text")):
        at, chosen, keys = anchors(words, WINDOW)
        if len(at):
            new = np.r_[True, chosen[1:] != chosen[:-1]]
            _, one = np.unique(mix(keys[new] + words.texts(at[new]).astype(_U)), return_index=True)
            yield keys[new][one]


def _segments(found: Screen):
    """Stretches of documents whose windows may occur elsewhere: segment key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_chunks(batch.column("text")):
                at, _, keys = anchors(words, WINDOW)
                at = at[~found.once(keys)]
                if not len(at):
                    continue
                apart = np.diff(at) > NEAR
                first, last = at[np.r_[True, apart]], at[np.r_[apart, True]]
                text = words.texts(first)
                word = first - words.firsts[text] + words.begins[text]
                ends = words.ends[word + last - first + WINDOW - 1]
                data = words.chunk.data
                row = pa.array(words.chunk.lo + text)
                cut = pa.array([data[a:b].tobytes() for a, b in zip(words.starts[word], ends, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("text_hash").take(row), pa.array((first - words.firsts[text]).astype(np.int32)), cut], [*_SEGMENT, "segment"])

    return run


def _rows(words: Words, batch: pa.RecordBatch, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Stretches from word number ``at`` that hold ``n`` windows: 128 bits of hash, segment key, first window and count."""
    text = words.texts(at)
    row = pa.array(words.chunk.lo + text)
    first = batch.column("first").take(row)
    place = (at - words.firsts[text]).astype(np.int32) + first.to_numpy()
    hashes = [_signed(Stretches(words.hashes, which)(at, at + n + WINDOW - 1)) for which in (0, 1)]
    return pa.RecordBatch.from_arrays([*hashes, batch.column("doc_id").take(row), batch.column("text_hash").take(row), first, pa.array(place), pa.array(n.astype(np.int32))], ["h1", "h2", *_SEGMENT, "window", "n"])


_NAMED = "h1 long, h2 long, doc_id long, text_hash long, first int, window int, n int"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every high symbol in which windows start."""
    for batch in batches:
        for words in word_chunks(batch.column("segment")):
            s = compress(words, ROUNDS)
            text = words.texts(s.start)
            n = np.minimum(s.end, words.firsts[text] + words.counts[text] - WINDOW + 1) - s.start
            yield _rows(words, batch, s.start[n > 0], n[n > 0])


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every window of a segment that no unit in ``done`` holds."""
    for batch in batches:
        rows, spans = _spans(batch.column("done"))
        for words in word_chunks(batch.column("segment")):
            mine = slice(*np.searchsorted(rows, [words.chunk.lo, words.chunk.hi]))
            row = rows[mine] - words.chunk.lo
            base = words.firsts[row] - batch.column("first").to_numpy()[rows[mine]]
            settled = _cover(len(words.hashes), base + spans[mine, 0], spans[mine, 1])
            at = words.windows(WINDOW)
            at = at[~settled[at]]
            yield _rows(words, batch, at, np.ones(len(at), dtype=np.int64))


def _spans(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows and (window, n) of all entries of a column of lists; null is empty."""
    counts = np.array(lists.value_lengths().fill_null(0))
    held = lists.flatten()
    pairs = np.stack([held.field("window").to_numpy(zero_copy_only=False), held.field("n").to_numpy(zero_copy_only=False)], axis=1).astype(np.int64) if len(held) else np.zeros((0, 2), dtype=np.int64)
    return np.repeat(np.arange(len(lists)), counts), pairs


def _cover(size: int, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of ``size`` numbers lie in one of the stretches."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + n, -1)
    return np.cumsum(steps[:-1]) > 0


def _kept(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Each document's words without the windows in ``spans``."""
    for batch in batches:
        rows, spans = _spans(batch.column("spans"))
        for words in word_chunks(batch.column("text")):
            c = words.chunk
            mine = slice(*np.searchsorted(rows, [c.lo, c.hi]))
            gone = _cover(len(words.hashes), words.firsts[rows[mine] - c.lo] + spans[mine, 0], spans[mine, 1] + WINDOW - 1)
            number = words.numbers()
            gone = gone[number]
            text = words.texts(number)
            # Kept words with one whitespace byte after each, but for the last of a text, become the kept text.
            stay = np.flatnonzero(~gone)
            last = np.r_[text[stay][1:] != text[stay][:-1], True] if len(stay) else np.zeros(0, dtype=bool)
            bytes_kept = np.zeros(len(c.data) + 1, dtype=np.int8)
            np.add.at(bytes_kept, words.starts[stay], 1)
            np.add.at(bytes_kept, words.ends[stay] + ~last, -1)
            held = np.cumsum(bytes_kept[:-1], dtype=np.int8) > 0
            data = np.where((c.data == 0x20) | (c.data - np.uint8(9) < 5), np.uint8(0x20), c.data)[held]
            sizes = np.zeros(len(held) + 1, dtype=np.int64)
            np.cumsum(held, out=sizes[1:])
            kept = pa.LargeStringArray.from_buffers(c.hi - c.lo, pa.py_buffer(sizes[c.offsets]), pa.py_buffer(data)).cast(pa.string())
            lost = np.bincount(text[gone], minlength=c.hi - c.lo)
            # Removed words that follow one another are one stretch.
            out = np.flatnonzero(gone)
            edge = (np.diff(out) > 1) | (np.diff(text[out]) > 0)
            begin, end = (out[np.r_[True, edge]], out[np.r_[edge, True]]) if len(out) else (out, out)
            where = text[begin]
            ranges = pa.StructArray.from_arrays([pa.array((begin - words.begins[where]).astype(np.int32)), pa.array((end + 1 - words.begins[where]).astype(np.int32))], ["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(where, np.arange(c.hi - c.lo + 1)).astype(np.int32)), ranges)
            some = [batch.column(k).slice(c.lo, c.hi - c.lo) for k in keep]
            yield pa.RecordBatch.from_arrays([*some, pa.array(words.counts.astype(np.int64)), pa.array(lost.astype(np.int64)), lists, kept], [*keep, "n_words", "n_removed", "removed", "kept"])


def _repeated(named: DataFrame, name: str) -> DataFrame:
    """Rows of ``named`` whose words also stand in a smaller doc_id: segment key, window and n."""
    least = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = stage(least.where("least < most").drop("most"), f"{name}-names")
    return stage(named.join(least, ["h1", "h2"]).where("least < doc_id").select(*_SEGMENT, "window", "n"), name)


def remove_repeats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document, n_words, n_removed, removed (ranges of words: start, end) and kept.

    ``kept`` is the text of the words that stay, with one space between them.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    with_id = rows.where("doc_id is not null")
    chars = with_id.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    found = screen(with_id.select("text"), _anchor_keys, chars // CHARS)
    segments = stage(map_batches(with_id, _segments(found), "doc_id long, text_hash long, first int, segment string"), "repeat-segments")
    units = _repeated(map_batches(segments, _units, _NAMED), "repeat-units")
    done = units.groupBy(*_SEGMENT).agg(F.collect_list(F.struct("window", "n")).alias("done"))
    open_windows = map_batches(segments.join(done, _SEGMENT, "left"), _open_windows, _NAMED)
    windows = _repeated(open_windows, "repeat-windows")
    discard(segments)
    spans = units.unionByName(windows).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("window", "n")).alias("spans"))
    kept = [f"_keep{i}" for i in range(len(keep))]
    own = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    joined = own.join(spans, ["doc_id", "text_hash"], "left").select(*kept, "text", "spans")
    fields = ", ".join(f"{k} {joined.schema[k].dataType.simpleString()}" for k in kept)
    out = map_batches(joined, lambda batches: _kept(batches, kept), f"{fields}, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string")
    return out.select(*(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)), "n_words", "n_removed", "removed", "kept")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
