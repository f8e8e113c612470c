"""A trie of conversation prefixes, with count-min screening of their digests.

A conversation is a chain of prefixes, each named by a digest of the one before
and its turn. A count-min screen over all digests proves most prefixes to belong
to one conversation: such tails are emitted where they are, and only possibly
shared prefixes are shuffled to be grouped exactly (after partial sums, so a
prefix that a third of all conversations share is a few rows).

Sums over subtrees need no walk of the trie. The smallest member of a node owns
it, and what a conversation owns is the end of its chain. So the tokens saved
below a node are, over its members, the bytes between the node and where the
member's own part begins; and a node's leaves are counted with their owners.

Edge cases: rows with a null conv_id belong to no conversation and are left out.
Null turns come first, ties are ordered by role and text, and repeated rows are
turns of their own. Null role and text are empty. A conversation is read in its
turns' order by one task that holds one turn at a time, however many there are;
the ids that end at one node are joined in pieces by many tasks, and only the
digest of the pieces, which has to go in order, is left to one. Empty tables give
no nodes. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.llm.common import discard, map_batches, stage, table
from obsflow.llm.sketch import Screen, screen

#: Of ``SHARES`` neighbouring conversations each begins with up to ``MOST - 1`` turns of the first.
SHARES, MOST = 5, 9
#: Bytes of a digest, and ids of a piece.
DIGEST, PIECE = 16, 4096


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, nth (from 1), name (a digest of role and text) and bytes of every turn, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, nth = None, 0
        for batch in batches:
            names, sizes, places = [], [], []
            for c, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                conv, nth = c, nth + 1 if c == conv else 1
                role, text = role.encode(), text.encode()
                names.append(hashlib.sha256(b"%d:%b%b" % (len(role), role, text)).digest())
                sizes.append(len(text))
                places.append(nth)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(names, pa.binary()), pa.array(sizes, pa.int64())], ["conv_id", "nth", "name", "bytes"])

    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return stage(map_batches(rows, run, "conv_id long, nth long, name binary, bytes long"), "trie-turns")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its neighbours."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST))


def rebuild(turns: DataFrame) -> DataFrame:
    """The turns of every rebuilt conversation, and a row with nth 0 and no name for its root."""
    convs = turns.groupBy("conv_id").agg(F.lit(0).cast("long").alias("nth"))
    first = turns.where((F.col("conv_id") % SHARES == 0) & (F.col("nth") < MOST))
    near = F.filter(F.transform(F.sequence(F.lit(1 - SHARES), F.lit(SHARES - 1)), lambda i: F.try_add(F.col("conv_id"), i.cast("long"))), lambda c: c - c % SHARES == F.col("conv_id"))
    taken = first.select(F.explode(near).alias("conv_id"), "nth", "name", "bytes").where(shared_turns(F.col("conv_id")) >= F.col("nth"))
    taken = taken.join(convs.select("conv_id"), "conv_id", "left_semi")
    own = turns.where(F.col("nth") > shared_turns(F.col("conv_id")))
    roots = convs.select("conv_id", "nth", F.lit(None).cast("binary").alias("name"), F.lit(0).cast("long").alias("bytes"))
    return taken.unionByName(own).unionByName(roots)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth, node, parent, bytes (of its last text), before (of the texts before that), last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the row before, until it is known whether it is the last of its conversation
        for batch in batches:
            out = []
            for c, name, size in zip(batch.column("conv_id").to_pylist(), batch.column("name").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if held:
                    out.append((*held, name is None))
                if name is None:
                    held = [c, 0, bytes(DIGEST), None, 0, 0]
                else:
                    _, depth, node, _, last, before = held
                    held = [c, depth + 1, hashlib.sha256(node + name).digest()[:DIGEST], node, size, before + last]
            yield pack(out)
        if held:
            yield pack([(*held, True)])

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "depth", "node", "parent", "bytes", "before", "last"])

    rows = rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "nth")
    return stage(map_batches(rows, run, "conv_id long, depth long, node binary, parent binary, bytes long, before long, last boolean"), "trie-prefixes")


def _keys(column: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest (of a null: zero)."""
    digests = column.fill_null(bytes(DIGEST)).cast(pa.binary(DIGEST))
    return np.frombuffer(digests.buffers()[1], dtype=np.uint64)[2 * digests.offset :][: 2 * len(digests) : 2]


def screened(rows: DataFrame) -> DataFrame:
    """``prefixes`` with alone and parent_alone: proven to belong to one conversation only."""
    found: Screen = screen(rows.select("node"), lambda batch: iter([_keys(batch.column("node"))]), rows.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [pa.array(found.once(_keys(batch.column(c)))) for c in ("node", "parent")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *flags], [*batch.schema.names, "alone", "parent_alone"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return stage(map_batches(rows, run, f"{schema}, alone boolean, parent_alone boolean"), "trie-screened")


def _ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the ids (node, conv_id): ascending, comma-joined."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of up to PIECE ids of one node."""
        for batch in batches:
            nodes, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
            cuts = [i for i in range(len(ids)) if i == 0 or nodes[i] != nodes[i - 1]]
            pieces = [(nodes[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*pieces, strict=True)) or [[]] * 3, (pa.binary(), pa.int64(), pa.string()), strict=True)], ["node", "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, hashlib.sha256(), []
        for batch in batches:
            out = []
            for n, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if n == node:
                    state.update(b",")
                else:
                    out += [(node, state.hexdigest())] if node is not None else []
                    node, state = n, hashlib.sha256()
                state.update(piece.encode())
            yield packed(out)
        yield packed([(node, state.hexdigest())] if node is not None else [])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])

    # By ranges first, so that many tasks share the ids of one node.
    ordered = rows.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = stage(map_batches(ordered, join, "node binary, first long, piece string"), "trie-ends")
    return map_batches(pieces.repartition("node").sortWithinPartitions("node", "first"), digest, "node binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of ``screened`` prefixes."""
    maybe, alone = rows.where("not alone"), rows.where("alone")
    shared = stage(
        maybe.groupBy("node").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
            F.min("before").alias("before"), F.min("parent_alone").alias("parent_alone"), F.count_if("last").alias("n_ends"),
        ),
        "trie-shared",
    )
    # Where each conversation's own part begins, whether that has a leaf, and the bytes of all its texts.
    part = lambda leaf: F.struct("depth", "before", leaf.alias("leaf"))
    total = F.when(F.col("last"), F.col("before") + F.col("bytes"))
    owned = shared.select("conv_id", part(F.col("n_ends") == F.col("n_convs")).alias("part"), F.lit(None).cast("long").alias("total"))
    owned = owned.unionByName(rows.select("conv_id", F.when(F.col("alone"), part(F.col("last"))).alias("part"), total.alias("total")).where("part is not null or total is not null"))
    owners = owned.groupBy("conv_id").agg(F.coalesce(F.min("part")["before"], F.max("total")).alias("own"), F.coalesce(F.max("part.leaf"), F.lit(False)).cast("int").alias("leaf"))
    sums = maybe.join(owners, "conv_id").groupBy("node").agg(F.sum(F.greatest(F.col("own") - F.col("before"), F.lit(0))).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    below = shared.select("parent", "parent_alone").unionByName(alone.select("parent", "parent_alone"))
    below = below.where("parent is not null and not parent_alone").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = _ends(maybe.where("last").select("node", "conv_id"))
    none = F.sha2(F.lit(b"").cast("binary"), 256)
    nodes = shared.join(sums, "node").join(below, "node", "left").join(ends, "node", "left").select(
        "conv_id", "depth", "parent", "parent_alone", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    one = lambda n: F.lit(n).cast("long")
    tails = alone.select(
        "conv_id", "depth", "parent", "parent_alone", one(1).alias("n_convs"), F.when(F.col("last"), one(0)).otherwise(one(1)).alias("n_children"), one(1).alias("n_leaves"), one(0).alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"),
    )
    # A parent that is alone is of the same conversation. Other parents are looked up; Spark splits the children of one that has very many.
    parents = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    every = nodes.unionByName(tails)
    local = every.where("parent is null or parent_alone").withColumn("parent_conv_id", F.when(F.col("parent").isNotNull(), F.col("conv_id")))
    found = every.where("parent is not null and not parent_alone").join(parents, "parent", "left")
    return local.unionByName(found.select(*local.columns)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turns_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    rows = prefixes(rebuild(turns))
    marked = screened(rows)
    discard(rows)
    return trie(marked)
