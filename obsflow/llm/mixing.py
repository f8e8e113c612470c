"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key. Keys order the documents of a source;
a prefix sum of sizes in that order places every document in its source's
token line, and the line is cut at exactly the source's budget. A budget above
the source's size goes round the line again, in the same order, as often as
needed (at most ``max_epochs`` times).

The prefix sum is distributed: the key's high bits are a bucket, rows are
summed inside a bucket, and bucket totals are summed inside a source, so a
source that holds a third of all rows is spread over ``BUCKETS`` groups.

Only in the buckets where a budget ends does a document's own place matter. The
others are taken whole or not at all, which a table of bucket totals tells, so
:func:`take_words` moves the texts of those few buckets alone.

Edge cases: null text has size 0 and is never taken; a null source is a source
(last in order); a null doc_id has the key of the empty string. Repeated rows
count each. Rows that tie in key, doc_id and size are alike in every result.
An empty table gives an empty mix. A source of size 0 has target 0. A very long
text is cut at a word like any other, and counted whole. Other columns go
through :func:`take_words` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from obsflow.llm.common import bounded_broadcast, stage, table

#: Groups that each source's rows are dealt to for the prefix sum.
BUCKETS = 4096
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"
#: Totals by source and bucket, and documents where a budget ends, are broadcast up to so many rows, and else joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bits of the hash-random key: 15 hex digits of an MD5.
KEY_BITS = 60


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column) -> Column:
    """A 60-bit number that depends on the id alone, so reruns agree."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """For each source (``source``, ``source_size``) its weight and target.

    Targets are ``level * weight``, but at most ``max_epochs`` times the
    source's size, with the level set so that they add up to the total size.
    Sources whose cap binds are those with the smallest ``cap / weight``, so
    the level follows from running sums in that order.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    rows = rows.withColumn("level", F.max(fits).over(everything))
    return rows.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _bucket(key: Column) -> Column:
    return F.shiftright(key, KEY_BITS - (BUCKETS.bit_length() - 1))


def _totals(sized: DataFrame) -> DataFrame:
    """(_g, _b, _n, _before): for each source and bucket the sizes in it and in the buckets before it."""
    totals = sized.groupBy(F.col("source").alias("_g"), _bucket(F.col("key")).alias("_b")).agg(F.sum("size").alias("_n"))
    upto = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    return totals.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))


def place(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Add ``line_start``: the sizes of all rows before this one in its source, in the order of key, doc_id and size."""
    rows = rows.withColumn("_bucket", _bucket(F.col("key")))
    inside = W.partitionBy("source", "_bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_inside", F.sum("size").over(inside) - F.col("size"))
    joined = rows.join(totals, F.col("source").eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("line_start", F.col("_before") + F.col("_inside")).drop("_bucket", "_b", "_g", "_n", "_inside", "_before")


def _taken(rows: DataFrame, targets: DataFrame, max_epochs: int) -> DataFrame:
    """Placed rows with source_size, target, taken and ``cuts``."""
    rows = rows.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    budget = F.round("target").cast("long")
    cut = lambda e: F.least(F.greatest(budget - e * F.col("source_size") - F.col("line_start"), F.lit(0)), F.col("size")).cast("long")
    rows = rows.withColumn("cuts", F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), cut), lambda c: c > 0))
    return rows.withColumn("taken", F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + c))


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key and a hash of the text of every document."""
    return stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id")).alias("key"), F.xxhash64("text").alias("hash")), "mix-sizes")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken and ``cuts``.

    ``cuts`` holds the words taken in each epoch, where the mix takes any:
    the whole size, or at the source's budget the first words.
    """
    sized = _sized(docs)
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    rows = _taken(place(sized, _totals(sized)), targets, max_epochs)
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "cuts")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    ends = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    return F.array_join(F.slice(F.split(text, ends), F.lit(1), n.cast("int")), "")


def take_words(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """The mixed corpus: the columns of ``docs`` with a row for each epoch that takes from it.

    A document that the budget cuts keeps its first words; ``n_chars`` follows
    the text.
    """
    sized = _sized(docs)
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    totals = _totals(sized).join(targets.withColumnRenamed("source", "_s"), F.col("_g").eqNullSafe(F.col("_s"))).drop("_s")
    left = lambda e: F.round("target").cast("long") - e * F.col("source_size") - F.col("_before")
    # Of each bucket: the epochs that take all of it, and whether one takes a part.
    full = sum(((left(e) >= F.col("_n")).cast("int") for e in range(max_epochs)), F.lit(0))
    part = F.lit(False)
    for e in range(max_epochs):
        part = part | ((left(e) > 0) & (left(e) < F.col("_n")))
    totals = stage(totals.select("_g", "_b", "_n", "_before", full.alias("_full"), part.alias("_part")), "mix-buckets")
    n = totals.count()
    by_bucket = bounded_broadcast(totals.select(F.col("_g").alias("_src"), F.col("_b").alias("_bkt"), "_full", "_part"), n, BROADCAST_ROWS)
    own = {c: f"_d{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*(F.col(c).alias(x) for c, x in own.items())).withColumn("_size", word_count(F.col(own["text"])))
    named = named.withColumn("_bucket", _bucket(random_key(F.col(own["doc_id"]))))
    named = named.join(by_bucket, F.col(own["source"]).eqNullSafe(F.col("_src")) & (F.col("_bucket") == F.col("_bkt"))).where("_size > 0")
    whole = named.where("not _part and _full > 0").withColumn("_cut", F.explode(F.array_repeat(F.col("_size"), F.col("_full"))))
    # Where budgets end, rows meet their cuts; rows alike in id, source and text are numbered on both sides.
    ends = totals.where("_part").select(F.col("_g").alias("_src"), F.col("_b").alias("_bkt"))
    few = sized.join(F.broadcast(ends) if n <= BROADCAST_ROWS else ends, F.col("source").eqNullSafe(F.col("_src")) & (_bucket(F.col("key")) == F.col("_bkt")), "left_semi")
    plan = _taken(place(few, totals.select("_g", "_b", "_n", "_before")), targets, max_epochs).where("taken > 0")
    alike = ["doc_id", "source", "hash"]
    plan = plan.withColumn("nth", F.row_number().over(W.partitionBy(*alike).orderBy("taken"))).select(*(F.col(c).alias(f"_p_{c}") for c in [*alike, "nth"]), "cuts")
    met = named.where("_part").withColumn("_hash", F.xxhash64(own["text"]))
    met = met.withColumn("_nth", F.row_number().over(W.partitionBy(own["doc_id"], own["source"], "_hash").orderBy(F.lit(0))))
    on = F.col(own["doc_id"]).eqNullSafe(F.col("_p_doc_id")) & F.col(own["source"]).eqNullSafe(F.col("_p_source")) & (F.col("_hash") == F.col("_p_hash")) & (F.col("_nth") == F.col("_p_nth"))
    cut = met.join(plan, on).withColumn("_cut", F.explode("cuts"))
    rows = whole.select(*own.values(), "_size", "_cut").unionByName(cut.select(*own.values(), "_size", "_cut"))
    text = F.when(F.col("_cut") >= F.col("_size"), F.col(own["text"])).otherwise(first_words(F.col(own["text"]), F.col("_cut")))
    fresh = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in own else {})
    return rows.select(*((fresh[c] if c in fresh else F.col(x)).alias(c) for c, x in own.items()))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
