"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the failure
bits and the measurements; policies are versioned masks over those bits, so
that a changed policy or an ablation reads the small ledger and no text.

Edge cases: null text counts as empty (no words; fails ``few_words``). Empty
tables give empty ledgers. Repeated rows each get a row. Columns of the input
with the names of measurements are not read. Very long texts are measured whole,
each as a chunk of its own. Lines and runs of words count as equal where their
64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.llm.common import map_batches, table
from obsflow.llm.words import chunks, windows

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_marked_words")


@dataclass(frozen=True)
class Rule:
    """A named bit that is set where ``fails`` holds."""

    bit: int
    name: str
    fails: str


#: The rules, as SQL over the measurements. Bits are never reused.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "4 * n_symbols > n_words"),
    Rule(3, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule(4, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(5, "shouted_words", "100 * n_marked_words > 50 * n_words"),
)
BASE = 0b000011
#: Policies by version: a document is kept if none of the mask's bits is set.
POLICIES = {"base": BASE, "v1": 0b111111}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, dtype=bool)
    symbol[list(b"#*$%&|<>")] = True
    for batch in batches:
        parts = []
        for c in chunks(batch.column("text")):
            starts, ends, begins = c.words()
            n = np.diff(begins)
            text_of = np.repeat(np.arange(len(n)), n)
            inside = np.zeros(len(c.data) + 1, dtype=np.int8)
            inside[starts] += 1
            inside[ends] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
            sums = c.sums(lower=False)
            # Lines: from each text's begin or newline to the next; those with a word count.
            breaks = np.flatnonzero(c.data == 10)
            heads = np.sort(np.concatenate([c.offsets[:-1], breaks + 1]))
            line_text = np.searchsorted(c.offsets[1:], breaks, side="right")
            line_of = np.sort(np.concatenate([np.arange(len(n)), line_text]))
            tails = np.sort(np.concatenate([c.offsets[1:], breaks]))
            filled = np.searchsorted(starts, tails) > np.searchsorted(starts, heads)
            heads, tails, line_of = heads[filled], tails[filled], line_of[filled]
            lines = np.bincount(line_of, minlength=len(n))
            order = np.lexsort((h := c.hashes(sums, heads, tails), line_of))
            again = np.zeros(len(order), dtype=bool)
            again[1:] = (h[order][1:] == h[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
            dup = np.bincount(line_of[order][again], minlength=len(n))
            # Words inside 3-word windows that occur twice or more in their text.
            words = c.hashes(sums, starts, ends)
            runs, at = windows(words, begins, 3)
            run_of = np.repeat(np.arange(len(n)), np.diff(at))
            order = np.lexsort((runs, run_of))
            same = np.zeros(len(order) + 1, dtype=bool)
            same[1:-1] = (runs[order][1:] == runs[order][:-1]) & (run_of[order][1:] == run_of[order][:-1])
            twice = np.zeros(len(order), dtype=bool)
            twice[order] = same[1:] | same[:-1]
            first = np.flatnonzero(twice) + np.repeat(begins[:-1] - at[:-1], np.diff(at))[twice]
            covered = np.zeros(len(starts), dtype=bool)
            for k in range(3):
                covered[first + k] = True
            # Words that end in two exclamation marks.
            marked = (ends - starts > 2) & (c.data[ends - 1] == 33) & (c.data[np.maximum(ends - 2, 0)] == 33)
            count = lambda flags: np.bincount(text_of[flags], minlength=len(n))
            parts.append((n, c.per_text(inside & ((c.data & 0xC0) != 0x80)), c.per_text(symbol[c.data]), dup, lines, count(covered), count(marked)))
        found = [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), *map(pa.array, found)], [*batch.schema.names[:-1], *MEASURES])


def _measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` as _k0, _k1 and so on, and the measurements, so that no name clashes."""
    kept = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)]
    rows = docs.select(*kept, F.col("text").alias("text"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return map_batches(rows, _measure, ", ".join([*fields, *(f"{m} long" for m in MEASURES)]))


def _named(out: DataFrame, keep: list[str], more: tuple[str, ...]) -> DataFrame:
    """Kept columns under their own names; what clashes with them is called ``measured_...``."""
    return out.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)), *(F.col(m).alias(f"measured_{m}" if m in keep else m) for m in more))


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document and its measurements."""
    return _named(_measured(docs, keep), keep, MEASURES)


def failure_bits() -> Column:
    """All rules' bits as one number, over the measurements."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each document: ``keep``, the measurements and ``failed_bits``."""
    return _named(_measured(docs, keep).withColumn("failed_bits", failure_bits()), keep, (*MEASURES, "failed_bits"))


def keep_passing(docs: DataFrame, policy: str) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns."""
    names = docs.columns
    rows = _measured(docs, names).withColumn("failed_bits", failure_bits())
    return _named(rows.where(passes(policy)), names, ())


def passes(policy: str) -> Column:
    """Whether a ledger row has none of the policy's bits."""
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: how many documents fail it, and fail nothing else of that policy.

    The ledger is first summed by its bit pattern, of which there are at most
    two to the number of rules, so the rest works on a bounded table.
    """
    mask = POLICIES[policy]
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).count()
    own = F.explode(F.array(*(F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule")) for r in RULES if mask >> r.bit & 1))).alias("r")
    hit = F.expr("(bits & shiftleft(1L, r.bit)) != 0")
    only = F.expr("bits = shiftleft(1L, r.bit)")
    return patterns.select("bits", "count", own).groupBy("r.rule").agg(F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("failing"), F.sum(F.when(only, F.col("count")).otherwise(0)).alias("only_this"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"), ["doc_id"])
    base_failed = F.col("failed_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), passes("v1").alias("kept"), "failed_bits", "n_lines", "n_marked_words")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of the policy ``v1`` how many documents fail it, and fail it alone."""
    return ablations(ledger(table(spark, sf_dir, "documents"), ["doc_id"]), "v1")
