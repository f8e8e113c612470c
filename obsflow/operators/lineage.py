"""Hash chains, Merkle roots, incident bundles and delivery audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsflow.functions import exprs as X
from obsflow.operators.changes import changes_near
from obsflow.operators.numbering import numbered
from obsflow.operators.tables import validate


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


#: Leaves of a subtree that one aggregate folds, as a power of two.
SUBTREE_BITS = 12


def _folded(nodes: Column, levels: Column) -> Column:
    """An array of nodes ``levels`` levels up: SHA-256 of pairs, an odd last one paired with itself."""

    def up(row: Column) -> Column:
        digest = lambda i: F.sha2(F.concat(F.unhex(row[2 * i]), F.unhex(row[F.least(2 * i + 1, F.size(row) - 1)])), 256)
        return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(row) - 1, 1)), digest)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SUBTREE_BITS)), nodes, lambda row, k: F.when(k <= levels, up(row)).otherwise(row))


def merkle_root(df: DataFrame, keys: list[str], order: list[str], leaf: str) -> DataFrame:
    """Root of each group's ordered leaves (hex digests): SHA-256 of pairs, an odd last one paired with itself.

    A round folds whole subtrees of 2^SUBTREE_BITS nodes, each in one aggregate, so
    a million leaves take two. A group that fits one subtree ends at its own height.
    """
    if dict(df.dtypes)[order[0]] == "timestamp" and len(order) == 2:
        rows = numbered(df, keys, *order, "_i")
    else:
        rows = df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    rows = rows.select(*keys, (F.col("_i") - 1).cast("long").alias("_i"), F.col(leaf).alias("_root"), F.col(leaf).alias("_node"))
    most = rows.agg(F.max("_i")).collect()[0][0] or 0
    while most > 0:
        found = F.sort_array(F.collect_list(F.struct("_i", "_root", "_node"))).alias("_found")
        rows = rows.groupBy(*keys, F.shiftright("_i", SUBTREE_BITS).alias("_i")).agg(found)
        n = F.size("_found")
        levels = F.when(n > 1, F.length(F.bin((n - 1).cast("long")))).otherwise(0)
        rows = rows.withColumn("_levels", levels).withColumn("_own", _folded(F.transform("_found", lambda x: x["_node"]), F.col("_levels"))[0])
        # A lone first subtree is a finished group's root; all others go up to the height of a whole subtree.
        lone = (n == 1) & (F.col("_i") == 0)
        whole = _folded(F.array("_own"), SUBTREE_BITS - F.col("_levels"))[0]
        rows = rows.select(*keys, "_i", F.when(lone, F.col("_found")[0]["_root"]).otherwise(F.col("_own")).alias("_root"), whole.alias("_node"))
        most >>= SUBTREE_BITS
    return rows.select(*keys, F.col("_root").alias("root"))


def seal_records(ev: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Records with their sequence, payload hash, previous record's hash and own hash.

    A record's hash covers its payload and place; the previous hash is kept beside it.
    """
    rows = numbered(ev, keys, *order, "sequence").withColumn("payload_sha256", _sha(X.canonical_text()))
    rows = rows.withColumn("record_hash", _sha(F.concat_ws("|", *keys, F.col("sequence").cast("string"), "payload_sha256")))
    return _with_previous(rows, keys, {"record_hash": "previous_record_hash"}, {"record_hash": F.lit("")})


#: Records of a block in which each looks at the one before.
BLOCK = 4096


def _with_previous(rows: DataFrame, keys: list[str], names: dict[str, str], empty: dict[str, Column]) -> DataFrame:
    """Adds columns of the record before (by sequence): inside blocks of sequences, and for a block's first one from the last before the block."""
    rows = rows.withColumn("_block", F.floor(F.col("sequence") / BLOCK))
    last = rows.groupBy(*keys, "_block").agg(F.max_by(F.struct(*names), "sequence").alias("_last"))
    last = last.withColumn("_carried", F.lag("_last").over(W.partitionBy(*keys).orderBy("_block"))).drop("_last")
    inside = W.partitionBy(*keys, "_block").orderBy("sequence")
    rows = rows.withColumn("_before", F.lag(F.struct(*names)).over(inside)).join(last, [*keys, "_block"])
    before = F.coalesce("_before", "_carried")
    return rows.select(*(c for c in rows.columns if c not in ("_block", "_before", "_carried")), *(F.coalesce(before[a], empty[a]).alias(b) for a, b in names.items()))




def verify_chain(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records that break the chain, with the reason: payload, record hash, link or sequence."""
    rows = records.withColumn("_p", _sha(X.canonical_text())).withColumn("_h", _sha(F.concat_ws("|", *keys, F.col("sequence").cast("string"), "payload_sha256")))
    rows = _with_previous(rows, keys, {"record_hash": "_link", "sequence": "_seq"}, {"record_hash": F.lit(""), "sequence": F.lit(0).cast("long")})
    why = F.when(F.col("_p") != F.col("payload_sha256"), "payload").when(F.col("_h") != F.col("record_hash"), "record_hash").when(F.col("_link") != F.col("previous_record_hash"), "link").when(F.col("_seq") + 1 != F.col("sequence"), "sequence")
    return rows.withColumn("reason", why).where("reason is not null").select(*keys, "sequence", "reason")


def seal_segments(records: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Segments of ``size`` records with count, first and last sequence, Merkle root and the previous segment's root."""
    rows = records.withColumn("segment", F.floor((F.col("sequence") - 1) / size))
    roots = merkle_root(rows, [*keys, "segment"], ["sequence"], "record_hash")
    out = rows.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("records"), F.min("sequence").alias("first_seq"), F.max("sequence").alias("last_seq")).join(roots, [*keys, "segment"])
    return out.withColumn("previous_root", F.coalesce(F.lag("root").over(W.partitionBy(*keys).orderBy("segment")), F.lit("")))


def verify_segments(seals: DataFrame, records: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Seals that the records don't bear out, or that don't follow the seal before, with the reason."""
    again = seal_segments(records, keys, size).select(*keys, "segment", F.col("records").alias("_n"), F.col("first_seq").alias("_f"), F.col("last_seq").alias("_l"), F.col("root").alias("_r"))
    w = W.partitionBy(*keys).orderBy("segment")
    rows = seals.withColumn("_pr", F.coalesce(F.lag("root").over(w), F.lit(""))).withColumn("_next", F.coalesce(F.lag("last_seq").over(w) + 1, F.col("first_seq"))).join(again, [*keys, "segment"], "left")
    same = F.col("records").eqNullSafe(F.col("_n")) & F.col("first_seq").eqNullSafe(F.col("_f")) & F.col("last_seq").eqNullSafe(F.col("_l"))
    why = F.when(~same, "range").when(~F.col("root").eqNullSafe(F.col("_r")), "root").when(F.col("previous_root") != F.col("_pr"), "previous_root").when(F.col("first_seq") != F.col("_next"), "gap")
    return rows.withColumn("reason", why).where("reason is not null").select(*keys, "segment", "reason")


def quorum_audit(acks: DataFrame, quorum: int, zones: int = 1, regions: int = 1, clouds: int = 1) -> DataFrame:
    """Whether each record reached enough distinct nodes, zones, regions and clouds."""
    distinct = lambda c, name: F.size(F.collect_set(c)).cast("long").alias(name)
    # The members of a quorum are few, so sets of their names combine before the shuffle and no row is expanded.
    rows = acks.groupBy("sequence").agg(distinct("node_id", "nodes"), distinct("zone", "zones"), distinct("region", "regions"), distinct("cloud", "clouds"))
    return rows.withColumn("durable", (F.col("nodes") >= quorum) & (F.col("zones") >= zones) & (F.col("regions") >= regions) & (F.col("clouds") >= clouds))


def delivery_accounting(offered: DataFrame, accepted: DataFrame, delivered: DataFrame, retained: DataFrame) -> DataFrame:
    """How many offered events were rejected, delivered, retained or lost, and how many deliveries were duplicates."""
    key = ["tenant_id", "event_id"]
    mark = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    rows = mark(offered, "_o").join(mark(accepted, "_a"), key, "left").join(mark(delivered, "_d"), key, "left").join(mark(retained, "_r"), key, "left")
    fate = F.when(F.col("_a").isNull(), "rejected").when(F.col("_d").isNotNull(), "delivered").when(F.col("_r").isNotNull(), "retained").otherwise("lost")
    out = rows.withColumn("fate", fate).groupBy("tenant_id")
    return out.agg(*(F.count_if(F.col("fate") == f).alias(f) for f in ("rejected", "delivered", "retained", "lost")), F.coalesce(F.sum(F.when(F.col("_d") > 1, F.col("_d") - 1)), F.lit(0)).alias("duplicates"))


def rendezvous(keys: DataFrame, nodes: list[tuple[str, str, str, str]], local: tuple[str, str, str], policy: str = "locality", states: dict[str, dict] | None = None, stale_after: float = 30.0, max_pressure: float = 0.95) -> DataFrame:
    """The node of each key: nearest tier first (zone, region, cloud, any), then the largest hash of key and node, then the name.

    ``nodes`` are (id, cloud, region, zone): a short list of the mesh's members.
    Under another policy than ``locality`` all nodes are one tier. ``states``
    says of a node whether it is ``ready`` (if not told, yes), ``draining``
    (no), ``local`` (no), its ``pressure`` (0) and ``age`` in seconds (0); a node
    that is not ready, draining, at the pressure bound or, unless local, older
    than ``stale_after`` takes no keys. Where none is left the node is null.
    """
    cloud, region, zone = local
    options = []
    for name, c, r, z in nodes:
        now = (states or {}).get(name, {})
        stale = not now.get("local", False) and now.get("age", 0.0) > stale_after
        if not now.get("ready", True) or now.get("draining", False) or now.get("pressure", 0.0) >= max_pressure or stale:
            continue
        tier = 0 if (c, r, z) == local else 1 if region and (c, r) == (cloud, region) else 2 if cloud and c == cloud else 3
        tier = tier if policy == "locality" else 0
        options.append(F.struct(F.lit(tier).alias("tier"), F.translate(X.hash64_hex(F.concat(F.col("key"), F.lit("|" + name))), "0123456789abcdef", "fedcba9876543210").alias("least"), F.lit(name).alias("node")))
    return keys.withColumn("node", F.array_min(F.array(*options))["node"] if options else F.lit(None).cast("string"))


def bundle(incidents: DataFrame, members: dict[str, DataFrame], by_pair: dict[str, DataFrame] | None = None, markers: DataFrame | None = None) -> dict[str, DataFrame]:
    """The chosen incidents' rows of every member table.

    ``by_pair`` are tables by (tenant_id, source, event_type), as schemas and drifts: an incident takes the rows of
    its events' pairs. ``markers`` are changes: it takes those near its events. Both need the member ``events``.
    """
    key = ["tenant_id", "incident_id"]
    chosen = incidents.select(*key).distinct()
    out = {"incidents": incidents} | {name: df.join(chosen, key, "left_semi") for name, df in members.items()}
    if by_pair:
        pairs = out["events"].select(*key, "source", "event_type").distinct()
        out |= {name: df.join(pairs, ["tenant_id", "source", "event_type"]) for name, df in by_pair.items()}
    if markers is not None:
        spans = out["events"].groupBy(*key).agg(F.min("event_time").alias("first_at"), F.max("event_time").alias("last_at"))
        out["changes"] = changes_near(spans, markers)
    return out


def manifest(members: dict[str, DataFrame]) -> DataFrame:
    """Row count, bytes and an order-free content digest of each member.

    The digest is the SHA-256 of the sums of all rows' hash words, which Spark adds in any order.
    """
    out = None
    for name, df in sorted(members.items()):
        text = F.to_json(F.struct(*sorted(df.columns)))
        digest = _sha(text)
        words = [F.coalesce(F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(8)]
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"), _sha(F.concat_ws("|", *words)).alias("digest")).select(F.lit(name).alias("member"), "rows", "bytes", "digest")
        out = row if out is None else out.union(row)
    return out


def verify_bundle(members: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """Members that are missing, extra or differ from a manifest."""
    now = manifest(members).select("member", F.struct("rows", "bytes", "digest").alias("_n"))
    rows = expected.select("member", F.struct("rows", "bytes", "digest").alias("_e")).join(now, "member", "full_outer")
    why = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_n") != F.col("_e"), "mismatch")
    return rows.withColumn("reason", why).where("reason is not null").select("member", "reason")


def import_bundle(members: dict[str, DataFrame], tenant: str, existing: DataFrame, digest: str, imported: DataFrame) -> dict[str, DataFrame]:
    """The bundle under another tenant, without incidents that it already has; nothing if this archive was imported before.

    Of the member ``events`` only valid ones come in.
    """
    fresh = imported.where(F.col("digest") == digest).limit(1).count() == 0
    out = {}
    for name, df in members.items():
        rows = df.withColumn("tenant_id", F.lit(tenant)).join(existing.select("tenant_id", "incident_id"), ["tenant_id", "incident_id"], "left_anti")
        rows = validate(rows)[0] if name == "events" else rows
        out[name] = rows.withColumn("imported_from", F.lit(digest)).where(F.lit(fresh))
    return out
