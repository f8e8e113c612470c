"""N-gram Jaccard self-join of documents, by R-trees over count vectors. Exact.

A document's set is its distinct shingles of five lower-cased words, as 64-bit
hashes; documents link at a Jaccard similarity of 0.8. Equal sets are one
class from the start. What remains is a join of classes:

1. *Routing.* Two sets that are similar share ``m`` of their rarest
   ``n - ceil(0.8 n) + m`` shingles, in any common order and for any ``m``. The
   order is by how often a shingle's cell of a fixed-size count table occurs
   in the corpus, then by hash. Documents are dealt to buckets by these
   shingles, and shingles that a single class has are gone after that; so are
   classes that share fewer than ``m`` (see :func:`_must_share`).
2. *Areas.* Each shingle has a center, that class of its classes which shares
   most of its rare shingles. The classes that meet at the shingles of one
   center are its area. Two classes that share a rare shingle both are in the
   area of its center, so no link is lost; near copies have few centers between
   them, so a class is in few areas.
3. *R-tree join.* The classes of an area meet in pairs of blocks. A block's
   count vectors are packed into an R-tree; the points of the other block are
   searched in it, all at once, with the bound of summed coordinate minima.
   Surviving pairs are verified on the sets in the same task. A pair that
   shares several areas counts in the smallest.

What leaves a task is one row for each class of a pair of blocks: the number of
documents that it links with, and the smallest class that verified links lead
to. So all links are searched, verified and counted, and no list of pairs is
written; components follow from the second.

Edge cases: null and empty texts have no shingles, link with nothing and are
their own component. A null doc_id gets the smallest doc_id of its component,
null if there is none. Repeated rows each get a row; rows that share a doc_id
but not a text are documents of their own. Texts are never cut: a very long one
has as many shingles as it has, and blocks are cut by shingles too. Ties between
centers go to the larger class. Empty tables give none. Other columns than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.llm.common import bounded_broadcast, map_batches, stage, table
from obsflow.llm.components import components
from obsflow.llm.count_tree import CountTree, similar
from obsflow.llm.words import chunks, mix, shingles

#: Cells of the count table (its size doesn't depend on the corpus), in parts.
CELLS, PARTS = 1 << 20, 16
#: Routed entries of a bucket, about; cells with more than that in the corpus, and with four times the mean, are salted.
BUCKET = 500_000
#: Wanted documents (some 100 bytes each) and areas of several blocks are broadcast up to so many, and else joined by shuffle.
BROADCAST_ROWS = 200_000
#: Shingles with more classes than this are joined to their centers by broadcast.
HOT = 100_000
#: Classes and shingles of a block, about.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Classes, and shingles, that are counted in one matrix product.
ROWS, PRODUCT = 512, 2048
#: Classes that a task of the routing step remembers, so as to send their copies on once.
REMEMBERED = 100_000
#: Similar sets of n shingles share more than n / STRICT of their routed ones: the routed part grows by that, and chance meetings go.
STRICT = 40
_ENTRY = np.dtype([("token", "<u8"), ("class", "<i8"), ("n", "<u4")])


def _must_share(n):
    """How many of their routed shingles a set of ``n`` and a similar one share: that of the smallest set that can be similar."""
    return 4 * n // 5 // STRICT + 1


def _class_of(own: np.ndarray) -> int:
    """A 64-bit name for a set."""
    total = int(own.sum(dtype=np.uint64)) + len(own) * 0x9E3779B97F4A7C15
    return int(mix(np.array([total % (1 << 64)], dtype=np.uint64)).view(np.int64)[0])


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row and set of every text of a batch."""
    for chunk in chunks(batch.column("text")):
        for i, own in enumerate(shingles(chunk)):
            yield chunk.lo + i, own


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (doc_id, key, n, class), and at the end the task's counts by cell."""
    counts = np.zeros(CELLS, dtype=np.int64)
    names = ["doc_id", "key", "n", "class", "part", "counts"]
    kind = pa.int64()
    for batch in batches:
        kind = batch.column("doc_id").type
        n, classes = [], []
        for _, own in _sets(batch):
            n.append(len(own))
            classes.append(_class_of(own))
            np.add.at(counts, (own >> np.uint64(44)).astype(np.int64), 1)
        rows = len(n)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
    parts = [x.tobytes() for x in counts.reshape(PARTS, -1)]
    yield pa.RecordBatch.from_arrays([pa.nulls(PARTS, kind), *(pa.nulls(PARTS, pa.int64()) for _ in range(3)), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names)


def _cell_counts(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' counts: parts are added in groups of bounded size first."""

    def add(tables: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer(), np.int64) for x in tables.column("counts")], axis=0)
        return pa.table({"part": tables.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, counts binary"
    n = rows.count() // PARTS
    if n > 64:
        rows = rows.groupBy("part", F.pmod(F.xxhash64("counts"), F.lit(n // 64 + 1)).alias("some")).applyInArrow(lambda t: add(t.select(["part", "counts"])), schema)
    got = {r["part"]: r["counts"] for r in rows.groupBy("part").applyInArrow(add, schema).collect()}
    return np.concatenate([np.frombuffer(got[i], np.int64) for i in range(PARTS)]) if got else np.zeros(CELLS, np.int64)


def _route(order, hot, buckets: int):
    """Entries of the rarest shingles, packed by bucket: a row holds many entries."""

    def pack(held: list[np.ndarray], cells: np.ndarray) -> pa.RecordBatch:
        all_ = np.concatenate(held)
        salted = cells[(all_["token"] >> np.uint64(44)).astype(np.int64)]
        salt = np.where(salted, all_["class"].view(np.uint64), np.uint64(0))
        to = (mix(all_["token"] + salt) % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.r_[True, to[by][1:] != to[by][:-1]])
        data = [x.tobytes() for x in np.split(all_[by], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(to[by][cuts]), pa.array(data, pa.binary())], ["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, salted = order.value, hot.value
        seen: set[int] = set()
        held, size = [], 0
        for batch in batches:
            for _, own in _sets(batch):
                name = _class_of(own)
                if not len(own) or name in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name)
                n = len(own)
                rare = np.argsort(rank[(own >> np.uint64(44)).astype(np.int64)], kind="stable")[: n - -(-4 * n // 5) + n // STRICT + 1]
                entries = np.empty(len(rare), _ENTRY)
                entries["token"], entries["class"], entries["n"] = own[rare], name, n
                held.append(entries)
                size += len(rare)
                if size >= 100_000:
                    yield pack(held, salted)
                    held, size = [], 0
        if held:
            yield pack(held, salted)

    return run


def _shared(hot):
    """Entries whose shingle another class of fitting size has (salted shingles: all entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salted = hot.value
        held = [np.frombuffer(x.as_buffer(), _ENTRY) for batch in batches for x in batch.column("entries")]
        if not held:
            return
        rows = np.concatenate(held)
        del held
        rows = rows[np.lexsort((rows["class"], rows["n"], rows["token"]))]
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = rows[1:] != rows[:-1]
        rows = rows[fresh]
        n = rows["n"].astype(np.int64)
        follows = (rows["token"][1:] == rows["token"][:-1]) & (5 * n[:-1] >= 4 * n[1:])
        keep = salted[(rows["token"] >> np.uint64(44)).astype(np.int64)]
        keep[1:] |= follows
        keep[:-1] |= follows
        rows = rows[keep]
        for lo in range(0, len(rows), 100_000):
            part = rows[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[c].astype(np.uint64).view(np.int64)) for c in ("token", "class", "n")], ["token", "class", "n"])

    return run


def _areas(shared: DataFrame) -> DataFrame:
    """(area, class, n): every class in the area of each of its shingles' centers."""
    # How much of its rare shingles a class shares: an original shares all, an edited copy few.
    held = shared.groupBy("class").agg(F.count(F.lit(1)).alias("held"), F.max("n").alias("of"))
    enough = F.col("held") > F.floor(F.floor(4 * F.col("of") / 5) / STRICT)  # _must_share
    rows = stage(shared.join(held.where(enough).select("class", (F.col("held") / F.col("of")).alias("ties")), "class"), "near-rows")
    centers = rows.groupBy("token").agg(F.max(F.struct("ties", "class"))["class"].alias("area"), F.count(F.lit(1)).alias("of"))
    centers = stage(centers.where("of > 1"), "near-centers")
    hot = centers.where(F.col("of") > HOT)
    n_hot = hot.count()
    met = rows.join(centers.where(F.col("of") <= HOT), "token")
    if n_hot:
        met = met.unionByName(rows.join(bounded_broadcast(hot, n_hot, BROADCAST_ROWS), "token"))
    return stage(met.select("area", "class", "n").distinct(), "near-areas")


def _blocks(members: DataFrame) -> DataFrame:
    """(class, places): the areas of each class, with the number of their blocks and the class's own block."""
    sizes = members.groupBy("area").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("k"))
    many = stage(sizes.where("k > 1"), "near-many")
    rows = members.join(bounded_broadcast(many, many.count(), BROADCAST_ROWS), "area", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64("class"), F.col("k")).cast("int").alias("own")
    return rows.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("area", own, "k"))).alias("places"))


_PLACES = "places array<struct<area:long,own:int,k:int>>"


def _dealt(docs: DataFrame, rows: DataFrame, members: DataFrame) -> DataFrame:
    """The columns of _JOINED and data (the set) of every class, for each pair of blocks that it takes part in.

    Sets are made from one document of each class, where that is found, and move once.
    """
    chosen = rows.groupBy("class").agg(F.min(F.struct("doc_id", "key")).alias("d"), F.count(F.lit(1)).alias("copies"))
    wanted = _blocks(members).join(chosen, "class").select(F.col("d.doc_id").alias("_near_id"), F.col("d.key").alias("_near_key"), "class", "copies", "places")
    wanted = stage(wanted, "near-wanted")
    wanted = bounded_broadcast(wanted, wanted.count(), BROADCAST_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("class").to_pylist()
            found = [(i, own.tobytes()) for i, own in _sets(batch) if _class_of(own) == names[i]]
            kept = batch.select(["class", "copies", "places"]).take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x for _, x in found], pa.binary())], ["class", "copies", "places", "data"])

    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_near_id")) & F.col("key").eqNullSafe(F.col("_near_key"))).select("text", "class", "copies", "places")
    sets = map_batches(texts, run, f"class long, copies long, {_PLACES}, data binary")
    met = F.flatten(F.transform("places", lambda p: F.transform(F.sequence(F.lit(0), p["k"] - 1), lambda x: F.struct(p["area"].alias("area"), F.least(x, p["own"]).alias("i"), F.greatest(x, p["own"]).alias("j"), p["own"].alias("own")))))
    areas = F.transform("places", lambda p: p["area"]).alias("areas")
    return sets.withColumn("p", F.explode(met)).select("p.area", "p.i", "p.j", "p.own", "class", "copies", areas, "data")


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each left set, how many shingles it shares with each right set."""
    m = len(right)
    tokens = np.concatenate(right)
    by = np.argsort(tokens, kind="stable")
    owner = np.repeat(np.arange(m), [len(x) for x in right])[by]
    known, starts = np.unique(tokens[by], return_index=True)
    sizes = np.diff(np.r_[starts, len(tokens)])
    # Shingles that many sets have are counted by matrix products, and the others along their lists.
    common = sizes * 16 >= m
    column = np.cumsum(common) - 1
    dense = np.flatnonzero(common)
    for lo in range(0, len(left), ROWS):
        some = left[lo : lo + ROWS]
        at = [np.minimum(np.searchsorted(known, x), len(known) - 1) for x in some]
        at = [i[known[i] == x] for i, x in zip(at, some, strict=True)]
        total = np.zeros((len(some), m), np.float32)
        columns = [column[i[common[i]]] for i in at]
        for first in range(0, len(dense), PRODUCT):
            part = dense[first : first + PRODUCT]
            a, b = np.zeros((len(some), len(part)), np.float32), np.zeros((len(part), m), np.float32)
            for k, c in enumerate(columns):
                a[k, c[(c >= first) & (c < first + PRODUCT)] - first] = 1
            for k, i in enumerate(part):
                b[k, owner[starts[i] : starts[i] + sizes[i]]] = 1
            total += a @ b
        for k, i in enumerate(at):
            i = i[~common[i]]
            ends = np.cumsum(sizes[i])
            lists = np.repeat(starts[i] - ends + sizes[i], sizes[i]) + np.arange(ends[-1] if len(ends) else 0)
            yield total[k].astype(np.int64) + np.bincount(owner[lists], minlength=m)


def _verified(left: list[np.ndarray], right: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a of the left sets, b of the right ones) are similar; ``a`` is sorted."""
    shared = np.zeros(len(a), np.int64)
    cuts = np.searchsorted(a, np.arange(len(left) + 1))
    if len(a) * 8 > len(left) * len(right):
        for k, row in enumerate(_shared_counts(left, right)):
            shared[cuts[k] : cuts[k + 1]] = row[b[cuts[k] : cuts[k + 1]]]
    else:
        for k in np.flatnonzero(np.diff(cuts)):
            others = [right[i] for i in b[cuts[k] : cuts[k + 1]]]
            flat, own = np.concatenate(others), left[k]
            hits = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            ends = np.cumsum([len(x) for x in others])
            shared[cuts[k] : cuts[k + 1]] = np.add.reduceat(hits.astype(np.int64), np.r_[0, ends[:-1]])
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    return similar(shared, n[a], m[b])


def _met_before(area: int, left: list[list[int]], right: list[list[int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs share an area smaller than ``area``."""
    out = np.zeros(len(a), bool)
    lesser = [[[x for x in own if x < area] for own in side] for side in (left, right)]
    known = sorted({x for own in lesser[0] for x in own} & {x for own in lesser[1] for x in own})
    for lo in range(0, len(known), PRODUCT):
        column = {x: k for k, x in enumerate(known[lo : lo + PRODUCT])}
        sides = [np.zeros((len(side), len(column)), np.float32) for side in lesser]
        for own, side in zip(sides, lesser, strict=True):
            for k, areas in enumerate(side):
                own[k, [column[x] for x in areas if x in column]] = 1
        out |= (sides[0] @ sides[1].T)[a, b] > 0
    return out


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest one that the links (a, b) lead to."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            return low


_JOINED = ("area", "i", "j", "own", "class", "copies", "areas")


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, links, root, found) of each class in each pair of blocks; rows come sorted by area and pair of blocks.

    ``found`` is how many verified pairs the tree's proposals held, on one row of each pair of blocks.
    """

    def joined(rows: list[tuple]) -> pa.RecordBatch | None:
        area, i, j = rows[0][:3]
        # Repeated rows of the document that a class was made from come next to each other.
        rows = [r for k, r in enumerate(rows) if not k or r[4] != rows[k - 1][4]]
        left = [r for r in rows if r[3] == i]
        right = left if i == j else [r for r in rows if r[3] == j]
        if not left or not right or len(rows) < 2:
            return None
        mine, theirs = [r[7] for r in left], [r[7] for r in right]
        a, b = CountTree(theirs).pairs(mine)
        if i == j:
            a, b = a[a < b], b[a < b]
        fresh = ~_met_before(area, [r[6] for r in left], [r[6] for r in right], a, b)
        a, b = a[fresh], b[fresh]
        good = _verified(mine, theirs, a, b)
        a, b = a[good], b[good]
        rows = left if i == j else left + right
        b = b + (0 if i == j else len(left))
        copies = np.array([r[5] for r in rows], np.int64)
        links = np.bincount(a, copies[b], minlength=len(rows)) + np.bincount(b, copies[a], minlength=len(rows))
        names = np.array([r[4] for r in rows], np.int64)
        found = np.zeros(len(rows), np.int64)
        found[0] = len(a)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(links.astype(np.int64)), pa.array(names[_lowest(len(rows), a, b)]), pa.array(found)], ["class", "links", "root", "found"])

    held: list[tuple] = []
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("data")]
        for row in zip(*(batch.column(c).to_pylist() for c in _JOINED), sets, strict=True):
            if held and held[0][:3] != row[:3]:
                out = joined(held)
                if out is not None:
                    yield out
                held = []
            held.append(row)
    if held:
        out = joined(held)
        if out is not None:
            yield out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``key``, a hash that tells apart texts with one doc_id."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("key"))


def join_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key, n, class) of every document, (class, links, root, found) by pair of blocks, and (node, root) of every class that has a link.

    ``docs`` is as :func:`keyed` makes it.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    profile = stage(map_batches(docs, _profile, f"doc_id {kind}, key long, n long, class long, part int, counts binary"), "near-profile")
    rows = profile.where("part is null").select("doc_id", "key", "n", "class")
    counts = _cell_counts(profile.where("part is not null").select("part", "counts"))
    order = spark.sparkContext.broadcast(np.floor(4 * np.log2(counts + 1.0)).astype(np.uint8))
    hot = spark.sparkContext.broadcast((counts > BUCKET) & (counts > 4 * counts.mean()))
    buckets = int(counts.sum() // 5 // BUCKET) + 16
    routed = map_batches(docs.select("text"), _route(order, hot, buckets), "bucket int, entries binary").repartitionById(buckets, "bucket")
    shared = stage(map_batches(routed, _shared(hot), "token long, class long, n long"), "near-shared")
    members = _areas(shared)
    dealt = _dealt(docs, rows, members).repartition("area", "i", "j").sortWithinPartitions("area", "i", "j", "class")
    found = stage(map_batches(dealt.select(*_JOINED, "data"), _join, "class long, links long, root long, found long"), "near-links")
    return rows, found, components(found.select(F.col("class").alias("a"), F.col("root").alias("b")).where("a != b"))


def _named(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The classes (class, least) with their component_id."""
    named = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(smallest, "root").drop("root")


def near_links(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (its smallest doc_id), class_id (the smallest doc_id with an equal set) and links of every document.

    Links are the other documents at the similarity, equal sets included.
    """
    rows, found, roots = join_classes(keyed(docs))
    classes = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = _named(classes, roots).join(found.groupBy("class").agg(F.sum("links").alias("links")), "class", "left")
    named = stage(named.select("class", "component_id", F.col("least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "near-named")
    n, own = F.col("n").alias("n_shingles"), F.col("doc_id")
    empty = rows.where("n = 0").select("doc_id", n, own.alias("component_id"), own.alias("class_id"), F.lit(0).cast("long").alias("links"))
    return rows.where("n > 0").join(named, "class").select("doc_id", n, "component_id", "class_id", "links").union(empty)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and all without words.

    That is the row with the smallest doc_id (null last), and of rows that share
    it the one with the smallest hash of its text; of equal rows one stays.
    """
    rows, _, roots = join_classes(keyed(docs))
    named = rows.where("n > 0").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("d"))
    first = first.select(F.col("d.doc_id").alias("_near_id"), F.col("d.key").alias("_near_key"))
    # Rows that repeat in id and text are few, if any; only they need to meet.
    again = rows.groupBy(F.col("doc_id").alias("_r_id"), F.col("key").alias("_r_key")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    first = stage(first.join(again, F.col("_near_id").eqNullSafe(F.col("_r_id")) & (F.col("_near_key") == F.col("_r_key")), "left").select("_near_id", "_near_key", F.col("_rows").isNotNull().alias("_near_repeats")), "near-first")
    first = bounded_broadcast(first, first.count(), BROADCAST_ROWS)
    texts = docs.withColumn("_near_text", F.xxhash64("text"))
    stay = texts.join(first, F.col("doc_id").eqNullSafe(F.col("_near_id")) & (F.col("_near_text") == F.col("_near_key")))
    once = stay.where("not _near_repeats").select(*docs.columns)
    one = stay.where("_near_repeats").dropDuplicates(["doc_id", "_near_text"]).select(*docs.columns)
    wordless = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return once.unionByName(one).unionByName(wordless)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(table(spark, sf_dir, "documents"))
