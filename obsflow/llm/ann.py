"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

*Start.* Every row goes through ``TREES`` random-projection trees; hyperplanes
come from a bounded sample, rows from all. Rows of a leaf are compared with one
another and keep their nearest. Leaves are small, so that the lists are only a
start; a leaf beyond ``LEAF`` rows is dealt into parts by hash, other parts for
each tree, so no group is unbounded.

*Descent.* In each round every node is sent to its neighbours and its
neighbours to it, with their vectors, by joins. A node compares all that it was
sent and tells each the nearest of the others: neighbours of neighbours. A node
that more than ``REVERSE`` others name is dealt into parts, each with its own
neighbours and a share of the others, so none is left out. Lists are merged,
and rounds go on until few entries change.

*Search.* A query keeps a list of the nearest nodes seen. It expands the
nearest nodes that it hasn't expanded, whose neighbours come with their
vectors by a join, until a round brings nothing into the part of the list that
counts; there is no bound on the rounds. Lists found are then scored in double
precision on the original vectors.

Nearness is the inner product. Vectors in messages are bytes with one scale, so
that a node's neighbourhood is small; the last scoring is exact. What happens
doesn't depend on the number of rows; a table that fits into one leaf is simply
compared whole before the first round.

Edge cases: rows whose vec_id or vector is null, or whose vector is all zero,
holds null, NaN or infinite components, or has another length than most, take
no part (vectors of two lengths have no inner product). Finite components of
any size do: vectors are divided by the largest component for all but the last
scoring. Rows that repeat a vec_id count once, with the smallest vector. Ties
go to the smaller vec_id. Empty tables give no rows; a query with fewer others
gets them all. Columns other than vec_id and embedding are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsflow.llm.common import bounded_broadcast, discard, stage, table

DEGREE = 64
#: Neighbours that each tree gives a row to start from.
FROM_TREE = 24
#: Reverse neighbours of a part of a node.
REVERSE = 512
TREES = 8
LEAF = 256
#: Rows that hyperplanes are drawn from, and the fewest of them below a hyperplane.
SAMPLE, FEWEST = 20_000, 16
#: A node tells each neighbour at most so many others in a round; what it keeps back can come in the next.
TELL = 8
#: Rounds end when less than this share of the entries changes.
SETTLED = 0.05
#: Nodes that a query expands in a round.
EXPAND = 24
#: Nodes named by more than REVERSE others are broadcast up to so many, and else joined by shuffle.
BROADCAST_ROWS = 200_000


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null").where(sound)
    rows = stage(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-rows")
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["n"] if sizes else 0))


def _matrix(column: pa.Array, largest: float) -> np.ndarray:
    """A batch's vectors as a matrix, divided by ``largest``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (flat / largest).astype(np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def _short(x: np.ndarray) -> list[bytes]:
    """Each row as its scale and bytes."""
    scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    codes = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale, codes, strict=True)]


def _long(data: bytes, rows: int) -> np.ndarray:
    """The matrix of what :func:`_short` made, row after row."""
    flat = np.frombuffer(data, np.uint8).reshape(rows, -1)
    return np.ascontiguousarray(flat[:, 4:]).view(np.int8).astype(np.float32) * np.ascontiguousarray(flat[:, :4]).view(np.float32)


def _tops(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` largest scores."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def _merge(owner: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, other) with the ``k`` largest scores of each owner, in order."""
    order = np.lexsort((-score, other, owner))
    owner, other, score = owner[order], other[order], score[order]
    first = np.r_[True, (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])] & (owner != other) if len(owner) else np.zeros(0, bool)
    owner, other, score = owner[first], other[first], score[first]
    order = np.lexsort((other, -score, owner))
    owner, other, score = owner[order], other[order], score[order]
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    rank = np.arange(len(owner)) - np.repeat(heads, np.diff(np.r_[heads, len(owner)]))
    return owner[rank < k], other[rank < k], score[rank < k]


class Trees:
    """Random-projection trees over a sample: hyperplanes through medians."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        deepest = int(np.log2(max(len(sample) / FEWEST, 1)))
        self.depth = min(deepest, max(0, int(np.ceil(np.log2(max(rows, 1) / LEAF)))))
        nodes = (1 << self.depth) - 1
        width = sample.shape[1] if sample.size else 0
        self.normal = rng.standard_normal((trees, nodes, width)).astype(np.float32)
        self.offset = np.zeros((trees, nodes), dtype=np.float32)
        for t in range(trees):
            at = np.zeros(len(sample), dtype=np.int64)
            for level in range(self.depth):
                first = (1 << level) - 1
                for node in range(first, 2 * first + 1):
                    own = sample[at == node]
                    if len(own):
                        self.offset[t, node] = np.median(own @ self.normal[t, node])
                at = self.down(t, sample, at)

    def down(self, t: int, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The child that each row goes to."""
        right = np.einsum("ij,ij->i", x, self.normal[t][at]) > self.offset[t][at]
        return 2 * at + 1 + right

    def leaves(self, t: int, x: np.ndarray) -> np.ndarray:
        """Each row's leaf in a tree."""
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            at = self.down(t, x, at)
        return at


_LIST = ["id", "others", "scores"]
_LISTS = "id long, others binary, scores binary"


def _pack(owner: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """Sorted entries as one row for each owner."""
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    tails = np.r_[heads[1:], len(owner)].astype(int) if len(owner) else heads
    return pa.RecordBatch.from_arrays([
        pa.array(owner[heads], pa.int64()),
        pa.array([other[a:b].astype(np.int64).tobytes() for a, b in zip(heads, tails, strict=True)], pa.binary()),
        pa.array([score[a:b].astype(np.float32).tobytes() for a, b in zip(heads, tails, strict=True)], pa.binary()),
    ], _LIST)


def _unpack(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of packed lists."""
    ids = np.concatenate([np.asarray(b.column("id")) for b in batches])
    others = [x for b in batches for x in b.column("others").to_pylist()]
    scores = b"".join(x for b in batches for x in b.column("scores").to_pylist())
    return np.repeat(ids, [len(x) // 8 for x in others]), np.frombuffer(b"".join(others), np.int64), np.frombuffer(scores, np.float32)


def _best(k: int):
    """Merge all lists of an id; a task holds the lists of its share of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield _pack(*_merge(*_unpack(held), k))

    return run


def _start(rows: DataFrame, n: int, largest: float, parts: int) -> DataFrame:
    """Lists of neighbours inside the leaves of all trees."""
    spark = rows.sparkSession
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").toArrow()
    sample = _matrix(drawn.column("embedding"), largest) if drawn.num_rows else np.zeros((0, 0), np.float32)
    trees = spark.sparkContext.broadcast(Trees(sample, n, TREES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                x = _matrix(batch.column("embedding"), largest)
                if not len(x):
                    continue
                vectors = pa.array([v.tobytes() for v in x], pa.binary())
                for t in range(len(own.normal)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(own.leaves(t, x)), batch.column("vec_id"), vectors], ["tree", "leaf", "id", "vector"])

    leaves = stage(rows.select("vec_id", "embedding").mapInArrow(deal, "tree int, leaf long, id long, vector binary"), "ann-leaves")
    sizes = leaves.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / LEAF).alias("pieces"))
    dealt = leaves.join(F.broadcast(sizes), ["tree", "leaf"])  # at most TREES * SAMPLE / FEWEST rows
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("tree", "id"), F.col("pieces")))

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        x = np.frombuffer(b"".join(group.column("vector").to_pylist()), np.float32).reshape(len(ids), -1)
        owners, others, scores = [], [], []
        for lo in range(0, len(ids), 512):
            s = x[lo : lo + 512] @ x.T
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
            top = _tops(s, FROM_TREE)
            owners.append(np.repeat(ids[lo : lo + 512], top.shape[1]))
            others.append(ids[top].ravel())
            scores.append(np.take_along_axis(s, top, 1).ravel())
        return pa.Table.from_batches([_pack(*_merge(np.concatenate(owners), np.concatenate(others), np.concatenate(scores), DEGREE))])

    found = dealt.select("tree", "leaf", "piece", "id", "vector").groupBy("tree", "leaf", "piece").applyInArrow(compare, _LISTS)
    lists = stage(found.repartition(parts, "id").mapInArrow(_best(DEGREE), _LISTS), "ann-lists")
    discard(leaves)
    return lists


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(center, member, back) both ways for every entry."""
    for batch in batches:
        if not batch.num_rows:
            continue
        owner, other, _ = _unpack([batch])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[owner, other]), pa.array(np.r_[other, owner]), pa.array(np.r_[np.zeros(len(owner), bool), np.ones(len(owner), bool)])], ["center", "member", "back"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each center and part: center, members, least, vectors. Rows come sorted by center, part and member."""

    def pack(rows: pa.RecordBatch) -> pa.RecordBatch:
        center, part, member = (np.asarray(rows.column(c)) for c in ("center", "part", "member"))
        new = np.ones(len(center), bool)
        new[1:] = (center[1:] != center[:-1]) | (part[1:] != part[:-1])
        fresh = new.copy()
        fresh[1:] |= member[1:] != member[:-1]
        heads = np.flatnonzero(new[fresh])
        cuts = np.r_[heads, int(fresh.sum())]
        least = np.asarray(rows.column("least"))[fresh]
        column = rows.column("vector")
        data = np.frombuffer(column.buffers()[2], np.uint8)[np.frombuffer(column.buffers()[1], np.int32)[column.offset] :]
        width = len(column[0].as_buffer())
        vectors = data[: len(center) * width].reshape(-1, width)[fresh]
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(center[fresh][heads]), cut(member[fresh]), cut(least), cut(vectors)], ["center", "members", "least", "vectors"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        center, part = np.asarray(batch.column("center")), np.asarray(batch.column("part"))
        heads = np.flatnonzero((center[1:] != center[:-1]) | (part[1:] != part[:-1])) + 1
        if held and (held[-1].column("center")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (center[0], part[0]):
            heads = np.r_[0, heads]
        if len(heads):
            whole = [*held, batch.slice(0, int(heads[-1]))]
            yield pack(pa.concat_batches([b for b in whole if b.num_rows]))
            held = [batch.slice(int(heads[-1]))]
        else:
            held.append(batch)
    if held:
        yield pack(pa.concat_batches(held))


def neighbourhoods(lists: DataFrame, rows: DataFrame, largest: float, parts: int) -> DataFrame:
    """Each node's neighbours and reverse neighbours, with their vectors: center, members, least, vectors.

    ``least`` is the score that a candidate must beat to enter the member's own
    list. A node with many reverse neighbours has several rows.
    """

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(_short(_matrix(batch.column("embedding"), largest)), pa.binary())], ["member", "vector"])

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [np.frombuffer(s, np.float32) for s in batch.column("scores").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([float(s[-1]) if len(s) >= DEGREE else -np.inf for s in full], pa.float32())], ["member", "least"])

    edges = lists.mapInArrow(_edges, "center long, member long, back boolean")
    hubs = edges.where("back").groupBy(F.col("center").alias("_c")).agg(F.ceil(F.count(F.lit(1)) / REVERSE).cast("int").alias("pieces"))
    hubs = stage(hubs.where("pieces > 1"), "ann-hubs")
    n_hubs = hubs.count()
    edges = edges.withColumn("part", F.lit(0))
    if n_hubs:
        dealt = edges.join(bounded_broadcast(hubs, n_hubs, BROADCAST_ROWS), F.col("center") == F.col("_c"), "left")
        own = F.when(F.col("back"), F.array(F.pmod(F.xxhash64("member"), F.col("pieces")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("pieces") - 1))
        edges = dealt.withColumn("part", F.explode(F.when(F.col("pieces").isNull(), F.array(F.lit(0))).otherwise(own)))
    vectors = rows.mapInArrow(shorten, "member long, vector binary").join(lists.mapInArrow(farthest, "member long, least float"), "member", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")).cast("float")))
    sent = edges.join(vectors, "member").select("center", "part", "member", "least", "vector")
    return sent.repartition(parts, "center", "part").sortWithinPartitions("center", "part", "member").mapInArrow(_gather, "center long, members binary, least binary, vectors binary")


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all that meet at a node, the nearest others of each, where they beat its list."""
    for batch in batches:
        owners, others, scores = [], [], []
        for members, least, vectors in zip(*(batch.column(c).to_pylist() for c in ("members", "least", "vectors")), strict=True):
            ids = np.frombuffer(members, np.int64)
            if len(ids) < 2:
                continue
            bar = np.frombuffer(least, np.float32)
            x = _long(vectors, len(ids))
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            top = _tops(s, TELL)
            got = np.take_along_axis(s, top, 1)
            good = (got > bar[:, None]) & np.isfinite(got)
            owners.append(np.repeat(ids, top.shape[1])[good.ravel()])
            others.append(ids[top].ravel()[good.ravel()])
            scores.append(got[good])
        if owners:
            owner = np.concatenate(owners)
            if len(owner):
                yield _pack(*_merge(owner, np.concatenate(others), np.concatenate(scores), DEGREE))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fresh) of each pair of lists: how many entries of the one aren't in the other."""
    for batch in batches:
        counts = [int((~np.isin(np.frombuffer(a, np.int64), np.frombuffer(b or b"", np.int64))).sum()) for a, b in zip(batch.column("others").to_pylist(), batch.column("before").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["fresh"])


def build(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The graph of usable rows: lists (id, others, scores; nearest first), neighbourhoods with vectors, and the rounds of descent."""
    n, largest = rows.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).collect()[0]
    largest = largest or 1.0
    parts = max(8, n // 4_000)
    lists = _start(rows, n, largest, parts)
    done = 0
    while True:
        near = stage(neighbourhoods(lists, rows, largest, parts), "ann-near")
        told = near.mapInArrow(_tell, _LISTS)
        merged = stage(told.unionByName(lists).repartition(parts, "id").mapInArrow(_best(DEGREE), _LISTS), "ann-lists")
        both = merged.join(lists.select("id", F.col("others").alias("before")), "id", "left").where("before is null or others != before")
        fresh = both.select("others", "before").mapInArrow(_entries, "fresh long").agg(F.sum("fresh")).collect()[0][0] or 0
        # All that comes later starts from the merged lists.
        discard(near)
        discard(lists)
        lists, done = merged, done + 1
        # Lists only get better, so rounds end; without rows there is nothing to settle.
        if fresh <= SETTLED * n * DEGREE:
            return lists, stage(neighbourhoods(lists, rows, largest, parts), "ann-near"), done


def search(lists: DataFrame, near: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id) candidates by greedy search, at least the ``k`` nearest seen of each query (vec_id, embedding).

    Queries are rows of the index and start at their own node.
    """
    beam = 2 * k
    largest = queries.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).collect()[0][0] or 1.0
    parts = max(8, queries.count() // 2_000)

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of a node's neighbours for a query."""
        for batch in batches:
            owners, others, scores = [], [], []
            for query, vector, members, vectors in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vector", "members", "vectors")), strict=True):
                ids = np.frombuffer(members, np.int64)
                s = _long(vectors, len(ids)) @ np.frombuffer(vector, np.float32)
                owners.append(np.full(len(ids), query))
                others.append(ids)
                scores.append(s)
            if owners:
                yield _pack(*_merge(np.concatenate(owners), np.concatenate(others), np.concatenate(scores), beam))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States with what was found: the beam, which of it is expanded, and what to expand next."""
        state = [b for b in batches if b.num_rows]
        if not state:
            return
        owner, other, score = _unpack(state)
        owner, other, score = _merge(owner, other, score, beam)
        old = {q: (np.frombuffer(d, np.int64), o[: 8 * k]) for b in state for q, o, d in zip(*(b.column(c).to_pylist() for c in ("id", "others", "done")), strict=True) if d is not None}
        packed = _pack(owner, other, score)
        done, todo = [], []
        for q, o in zip(packed.column("id").to_pylist(), packed.column("others").to_pylist(), strict=True):
            seen, before = old[q]
            ids = np.frombuffer(o, np.int64)
            # A query is settled when what it expanded brought nothing into the part that counts.
            settled = len(seen) and o[: 8 * k] == before
            fresh = ids[:0] if settled else ids[~np.isin(ids, seen)][:EXPAND]
            todo.append(fresh.tolist())
            done.append(np.r_[seen, fresh].tobytes())
        yield pa.RecordBatch.from_arrays([*packed.columns, pa.array(done, pa.binary()), pa.array(todo, pa.list_(pa.int64()))], [*_LIST, "done", "todo"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in _matrix(batch.column("embedding"), largest)], pa.binary())], ["query_id", "vector"])

    vectors = stage(queries.mapInArrow(plain, "query_id long, vector binary"), "ann-queries")
    schema = f"{_LISTS}, done binary, todo array<long>"
    own = lists.join(queries.select(F.col("vec_id").alias("id")), "id", "left_semi").withColumn("done", F.lit(b"").cast("binary"))
    state = stage(own.repartition(parts, "id").mapInArrow(fold, schema), "ann-state")
    while state.where("size(todo) > 0").limit(1).count():
        ahead = state.select(F.col("id").alias("query_id"), F.explode("todo").alias("center")).join(vectors, "query_id")
        found = ahead.join(near.select("center", "members", "vectors"), "center").select("query_id", "vector", "members", "vectors").mapInArrow(widen, _LISTS)
        both = state.select(*_LIST, "done").unionByName(found.withColumn("done", F.lit(None).cast("binary")))
        before, state = state, stage(both.repartition(parts, "id").mapInArrow(fold, schema), "ann-state")
        discard(before)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                owner, other, _ = _unpack([batch])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(other)], ["query_id", "vec_id"])

    return state.select(*_LIST).mapInArrow(listed, "query_id long, vec_id long")


def nearest(rows: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the (query_id, vec_id) pairs by inner product in double precision: query_id, rank, vec_id, score."""
    one = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"))
    both = pairs.join(one, "query_id").join(rows.select("vec_id", "embedding"), "vec_id")
    score = F.aggregate(F.zip_with("_q", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    ranked = both.select("query_id", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    lists, near, _ = build(rows)
    queries = rows.where("vec_id % 20 = 0")
    return nearest(rows, search(lists, near, queries, 20), 20)
