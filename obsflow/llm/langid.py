"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; n-grams of one to three code points are hashed into
``BUCKETS`` buckets. Counts by language and bucket are summed by Spark over a
bounded sample of the labelled texts; the log-probability matrix, whose size
depends on the number of languages alone, is broadcast, and batches of whole
texts are scored in numpy by gathering the matrix at the n-grams present.

Edge cases: null texts and texts without a letter are ``und`` with score 0.
With nothing to learn from, every text is ``und``. Equal scores go to the
language first by name. Repeated rows each get a row; a null doc_id counts as
the empty text for the fold and is held out. A letter is what Unicode calls one:
digits, fractions and roman numerals aren't. Texts are scored whole; a very long
one is a group of its own. Columns that are neither kept nor ``text`` are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.llm.common import map_batches, table

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: The model is fitted on about so many texts of each language, drawn by hash.
SAMPLE = 5_000
#: More languages than this in a label column are a mistake.
MOST_LANGUAGES = 1_000
#: Added to each count.
SMOOTHING = 0.5
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts one after another, a space after each, and where each begins."""
    lowered = [t.lower() + " " for t in texts]
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in lowered], out=at[1:])
    return np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), at


def _grams(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that ends at each code point (from ``order - 1`` on)."""
    n = len(points) - order + 1
    h = np.full(max(n, 0), order, dtype=np.uint32)
    for k in range(order):
        h = (h ^ points[k : k + n]) * _MULTIPLIERS[k]
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def _groups(texts: list[str], limit: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield lo, texts[lo : i + 1]
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) over a task's texts."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, own in by.items():
            total = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for _, some in _groups(own):
                points, _ = _code_points(some)
                for order in ORDERS:
                    total += np.bincount(_grams(points, order), minlength=BUCKETS)
    for lang, total in counts.items():
        present = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(present), pa.string()), pa.array(present.astype(np.int32)), pa.array(total[present])], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the matrix of log probabilities (language by bucket).

    ``labelled`` has text, lang and ``key`` (any hash in 0 to 2**31 - 1). Where
    a language has more than ``sample`` texts, those with the smallest keys
    are used, up to a bound that lets through about that many.
    """
    labelled = labelled.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return [], np.zeros((0, BUCKETS))
    bounds = labelled.sparkSession.createDataFrame([(k, min(1.0, sample / n) * 2**31) for k, n in sizes.items()], "lang string, bound double")
    chosen = labelled.join(F.broadcast(bounds), "lang").where("key < bound").select("lang", "text")
    rows = map_batches(chosen, _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    counts = np.full((len(langs), BUCKETS), SMOOTHING)
    place = np.array([langs.index(x) for x in rows.column("lang").to_pylist()], dtype=np.int64)
    counts[place, rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` of every document, ``lang_pred`` and ``score`` (the posterior under equal priors)."""
    n_kept = len(keep)
    model = docs.sparkSession.sparkContext.broadcast(matrix.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value
        for batch in batches:
            texts = [t if t and any(map(str.isalpha, t)) else "" for t in batch.column("text").to_pylist()]
            best, certain = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for lo, some in _groups(texts) if langs else ():
                points, at = _code_points(some)
                total = np.zeros((len(some), len(langs)))
                for order in ORDERS:
                    grams = _grams(points, order)
                    # N-grams that reach into the next text begin in its last places and are left out.
                    ends = np.maximum(at[1:] - order + 1, at[:-1])
                    text_of = np.repeat(np.arange(len(some)), ends - at[:-1])
                    at_most = np.arange(len(text_of)) + np.repeat(at[:-1] - np.r_[0, np.cumsum(ends - at[:-1])[:-1]], ends - at[:-1])
                    grams = grams[at_most]
                    for k in range(len(langs)):
                        total[:, k] += np.bincount(text_of, logs[k][grams], minlength=len(some))
                total -= total.max(axis=1, keepdims=True)
                odds = np.exp(total)
                best[lo : lo + len(some)] = odds.argmax(axis=1)
                certain[lo : lo + len(some)] = 1 / odds.sum(axis=1)
            found = [langs[k] if t and langs else "und" for k, t in zip(best, texts, strict=True)]
            certain[[x == "und" for x in found]] = 0
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_kept)), pa.array(found, pa.string()), pa.array(certain)], [*batch.schema.names[:n_kept], "lang_pred", "score"])

    rows = docs.select(*keep, "text")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_batches(rows, score, f"{kept}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = F.pmod(F.xxhash64("doc_id"), F.lit(2**31))
    langs, matrix = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang", key.alias("key")))
    return predict(docs, langs, matrix, [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])
