"""A Merkle manifest of a dataset, by butterfly exchange.

Every row is a leaf; the rows of a language, in order, are a tree, and the
trees' roots, in order of their languages, are the leaves of one more. A tree is
cut into aligned blocks of ``BLOCK`` leaves, whose roots tasks hash by
themselves. Then blocks exchange: in round ``r`` each block meets, lane by lane,
the blocks of the ``FANOUT`` aligned subtrees of ``FANOUT ** r`` blocks around it,
they swap the subtrees' roots, and each hashes the ancestors for itself and
notes the siblings on its way. After log(blocks) rounds every block holds its
whole upper proof and the root, and nothing has to be sent down again. A subtree
at the end of a tree, with fewer blocks than lanes, serves the other lanes from
the blocks that it has.

Edge cases: null values are leaves' values (``-``). A null language is a tree,
the first. Rows that share a doc_id are ordered by their leaves; equal rows are
equal leaves, which may take each other's place. A null doc_id comes first and is
not tampered with. An empty table gives no rows. Texts are hashed whole. Other
columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsflow.llm.common import map_batches, stage, table

#: Leaves of a block and blocks of a group, as powers of two.
BLOCK_BITS, FANOUT_BITS = 10, 4
HEX = 64


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(*values: Column) -> Column:
    """The hash of a row's values: each ``-`` if null, else its byte count, a colon and itself."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*(part(v.cast("string")) for v in values)).cast("binary"), 256)


def parents(nodes: list[str]) -> list[str]:
    """Every two consecutive nodes as one; a last one alone also becomes its own hash."""
    return [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    return (n - 1).bit_length()


def climb(nodes: list[str], levels: int) -> tuple[str, list[list[str]]]:
    """The node ``levels`` above, and for each of ``nodes`` its siblings on the way (empty where there is none)."""
    siblings: list[list[str]] = [[] for _ in nodes]
    for level in range(levels):
        for i, found in enumerate(siblings):
            beside = (i >> level) ^ 1
            found.append(nodes[beside] if beside < len(nodes) else "")
        nodes = parents(nodes)
    return nodes[0], siblings


def fold(node: str, pos: int, n: int, proof: str) -> str:
    """The root that ``node``, as leaf ``pos`` of ``n``, has with these siblings."""
    at = 0
    while n > 1:
        if pos ^ 1 < n:
            beside = proof[at : at + HEX]
            at += HEX
            node = sha(node + beside if pos % 2 == 0 else beside + node)
        else:
            node = sha(node)
        pos, n = pos >> 1, (n + 1) >> 1
    return node


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with the partition and their place in the part of their tree that it holds."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column("tree")
        new = np.r_[tree[0].as_py() != last, pc.not_equal(tree[1:], tree[:-1]).to_numpy(zero_copy_only=False)]
        begins = np.maximum.accumulate(np.where(new, np.arange(len(tree)), -1))
        at = np.where(begins < 0, np.arange(len(tree)) + n, np.arange(len(tree)) - begins)
        last, n = tree[-1].as_py(), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(tree), part, dtype=np.int64)), pa.array(at.astype(np.int64))], [*batch.schema.names, "part", "at"])


def numbered(leaves: DataFrame, by: list[str]) -> DataFrame:
    """``leaves`` (tree, ...) with pos, their place in their tree in the order of ``by``, n, the tree's size, and block.

    Rows are sorted by ranges, counted inside them, and begin after the counts of the ranges before.
    """
    order = ["tree", *by, "_tie"]
    rows = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = stage(map_batches(rows, _count, f"{fields}, part long, at long"), "merkle-sorted")
    parts = rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("held"))
    # A row for each range and tree: a window over ranges, not over rows.
    whole = W.partitionBy("tree")
    before = F.coalesce(F.sum("held").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "part", before.alias("before"), F.sum("held").over(whole).alias("n"))
    rows = rows.join(parts, ["tree", "part"]).withColumn("pos", F.col("before") + F.col("at"))
    return stage(rows.withColumn("block", F.shiftright("pos", BLOCK_BITS)).drop("part", "at", "before"), "merkle-numbered")


def _block_root(found: pa.Table) -> pa.Table:
    found = found.sort_by("pos")
    n = found["n"][0].as_py()
    top, _ = climb(found["leaf"].to_pylist(), min(BLOCK_BITS, height(n)))
    return pa.table({"tree": found["tree"][:1], "block": found["block"][:1], "blocks": pa.array([(n - 1 >> BLOCK_BITS) + 1], pa.int64()), "top": [top], "proof": [""]})


_UPPER = "tree string, block long, blocks long, top string, proof string"


def _swap(turn: int):
    """The members of a group climb from each other's subtree roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for tree, met in zip(batch.column("tree").to_pylist(), batch.column("met").to_pylist(), strict=True):
                met.sort(key=lambda m: m["subtree"])
                levels = min(FANOUT_BITS, height(met[0]["blocks"]) - FANOUT_BITS * turn)
                top, siblings = climb([m["top"] for m in met], levels)
                out += [(tree, m["block"], m["blocks"], top, m["proof"] + "".join(s)) for m, s in zip(met, siblings, strict=True) if m["own"]]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tree", "block", "blocks", "top", "proof"])

    return run


def exchange(blocks: DataFrame) -> DataFrame:
    """Blocks (tree, block, blocks, top, proof) with the tree's root as ``top`` and their whole upper proof."""
    most = blocks.agg(F.max("blocks")).collect()[0][0] or 1
    turn = 0
    while 1 << FANOUT_BITS * turn < most:
        lanes, bits = 1 << FANOUT_BITS * turn, FANOUT_BITS * turn
        going = F.col("blocks") > lanes
        subtree, lane = F.shiftright("block", bits), F.col("block") % lanes
        # A last subtree with fewer blocks than lanes serves lane l from its block l % size.
        size = F.least(F.col("blocks") - F.shiftleft(subtree, bits), F.lit(lanes))
        served = F.when((size < lanes) & (subtree % (1 << FANOUT_BITS) > 0), F.sequence(lane, F.lit(lanes - 1).cast("long"), size)).otherwise(F.array(lane))
        sent = blocks.where(going).select("*", subtree.alias("subtree"), lane.alias("from"), F.explode(served).alias("lane"))
        own = F.col("from") == F.col("lane")
        proof = F.when(own, F.col("proof")).otherwise("")
        met = sent.groupBy("tree", F.shiftright("subtree", FANOUT_BITS).alias("group"), "lane").agg(F.collect_list(F.struct("subtree", "block", "blocks", "top", own.alias("own"), proof.alias("proof"))).alias("met"))
        blocks = stage(map_batches(met, _swap(turn), _UPPER).unionByName(blocks.where(~going)), "merkle-exchange")
        turn += 1
    return blocks


def block_proofs(leaves: DataFrame) -> DataFrame:
    """For every block of numbered leaves (tree, pos, n, block, leaf): tree, block, top (the tree's root) and proof."""
    roots = leaves.select("tree", "block", "pos", "n", "leaf").groupBy("tree", "block").applyInArrow(_block_root, _UPPER)
    return exchange(stage(roots, "merkle-blocks"))


def _prove(key: tuple, found: pa.Table, upper: pa.Table) -> pa.Table:
    """All rows of a block with their proofs, from the block's own leaves and its upper proof."""
    found = found.sort_by("pos")
    names = [*found.schema.names, "subroot", "proof"]
    if not found.num_rows:
        return pa.table([*found.columns, pa.array([], pa.string()), pa.array([], pa.string())], names)
    top = upper.to_pylist()[0]
    _, siblings = climb(found["leaf"].to_pylist(), min(BLOCK_BITS, height(found["n"][0].as_py())))
    proofs = ["".join(s) + top["proof"] for s in siblings]
    return pa.table([*found.columns, pa.array([top["top"]] * len(proofs)), pa.array(proofs)], names)


def with_proofs(leaves: DataFrame, upper: DataFrame) -> DataFrame:
    """Numbered leaves with subroot (their tree's root) and proof (siblings up to it, joined)."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in leaves.schema)
    own, above = leaves.groupBy("tree", "block"), upper.select("tree", "block", "top", "proof").groupBy("tree", "block")
    return own.cogroup(above).applyInArrow(_prove, f"{fields}, subroot string, proof string")


def manifest(leaves: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The trees of ``leaves`` (tree, leaf, and columns ``by`` that order them).

    Two tables: the leaves with pos, n, block, subroot and proof up to it; and
    the trees with subroot, tree_pos, trees, root and top_proof up to the root.
    """
    rows = numbered(leaves, by)
    upper = block_proofs(rows)
    tops = numbered(upper.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("leaf")), ["name"])
    proven = with_proofs(tops, block_proofs(tops))
    trees = proven.select(F.col("name").alias("tree"), F.col("leaf").alias("subroot"), F.col("pos").alias("tree_pos"), F.col("n").alias("trees"), F.col("subroot").alias("root"), F.col("proof").alias("top_proof"))
    return with_proofs(rows, upper), stage(trees, "merkle-trees")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the digest of their whole proof and the root that the shown leaf folds to."""
    for batch in batches:
        get = lambda c: batch.column(c).to_pylist()  # noqa: B023, E731
        low, high = get("proof"), get("top_proof")
        folded = [fold(fold(leaf, pos, n, a), tree_pos, trees, b) for leaf, pos, n, a, tree_pos, trees, b in zip(get("shown"), get("pos"), get("n"), low, get("tree_pos"), get("trees"), high, strict=True)]
        digests = [sha(a + b) for a, b in zip(low, high, strict=True)]
        kept = ["doc_id", "leaf", "subroot", "root"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(digests, pa.string()), pa.array(folded, pa.string())], [*kept, "proof_sha256", "folded_root"])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    own = lambda n_chars: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    shown = F.when(tampered, own(more)).otherwise(own(F.col("n_chars")))
    # The empty name, before all others, is the null language's.
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    leaves = stage(docs.select("doc_id", tree.alias("tree"), own(F.col("n_chars")).alias("leaf"), shown.alias("shown")), "merkle-leaves")
    rows, trees = manifest(leaves, ["doc_id", "leaf"])
    # Every row meets its tree's one row: Spark splits the rows of a large tree.
    joined = rows.join(trees.drop("subroot"), "tree")
    return map_batches(joined, _verify, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string").withColumn("verified", F.col("folded_root") == F.col("root"))
