"""Payload schemas: description, registry, drift and version differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsflow.functions import exprs as X
from obsflow.staging import stage

KEY = ["tenant_id", "source", "event_type", "schema_version"]
DEEPEST, MOST_FIELDS, MOST_PATHS = 5, 512, 2048
#: Seconds of a bin of time.
BIN = 3600
#: A path is required after so many observations, where it was in so many percent.
FLOOR, PERCENT = 20, 95
#: Legacy attribute names with their replacement, and the JSON types of current ones.
LEGACY = {"http.method": "http.request.method", "http.status_code": "http.response.status_code", "net.protocol.name": "network.protocol.name", "deployment.environment": "deployment.environment.name"}
EXPECTED = {
    "service.name": "string", "service.namespace": "string", "service.instance.id": "string", "service.version": "string", "deployment.environment.name": "string",
    "http.request.method": "string", "http.response.status_code": "number", "network.protocol.version": "string", "server.address": "string", "server.port": "number", "url.scheme": "string",
}
SEVERITY = ("info", "warning", "breaking")


def _kind(v: Column) -> Column:
    def of(name: Column) -> Column:
        return (
            F.when(name.isNull() | (name == "VOID"), "null").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
            .when(name == "BOOLEAN", "boolean").when(name.rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)"), "number").otherwise("string")
        )

    return X.let(F.upper(F.schema_of_variant(v)), of)


_FIELD = "array<struct<keys:array<string>,type:string>>"


def _payload_walk(value: Column) -> Column:
    """The paths below a payload as ``found`` (keys, type), and the nodes below the deepest of them as ``level``.

    Only objects are walked into, level by level, each once. Text that isn't JSON is one string.
    """
    node = lambda keys, v: F.struct(keys.alias("keys"), v.alias("value"))
    field = lambda n: F.struct(n["keys"].alias("keys"), n["type"].alias("type"))
    below = lambda n: F.transform(F.map_entries(n["value"].cast("map<string,variant>")), lambda e: node(F.concat(n["keys"], F.array(e["key"])), e["value"]))

    def deeper(acc: Column, _: Column) -> Column:
        typed = F.transform(acc["level"], lambda n: F.struct(n["keys"].alias("keys"), n["value"].alias("value"), _kind(n["value"]).alias("type")))
        grown = lambda ns: F.struct(F.concat(acc["found"], F.transform(ns, field)).alias("found"), F.flatten(F.transform(F.filter(ns, lambda n: n["type"] == "object"), below)).alias("level"))
        return F.when(F.size(acc["level"]) > 0, X.let(typed, grown)).otherwise(acc)

    none = F.expr(f"cast(array() as {_FIELD})")
    start = F.struct(none.alias("found"), F.array(node(F.array(F.lit("payload")), value)).alias("level"))
    broken = F.struct(F.array(F.struct(F.array(F.lit("payload")).alias("keys"), F.lit("string").alias("type"))).alias("found"), F.expr("cast(array() as array<struct<keys:array<string>,value:variant>>)").alias("level"))
    return F.when(value.isNull(), broken).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(DEEPEST)), start, deeper))


def describe(df: DataFrame) -> DataFrame:
    """One row for each event: KEY, sorted fields (path, type), fingerprint and whether fields were cut.

    Fields are taken in the order metric, tags, payload up to MOST_FIELDS, and
    sorted after that. An event without any has an empty array.

    Describing an event takes far longer than reading it, so events are dealt
    anew by id: a table of one file would be described by as few tasks as read it.
    """
    name = lambda path, kind: F.struct(F.array(F.lit(path)).alias("keys"), F.lit(kind).alias("type"))
    fixed = F.array_compact(F.array(F.when(F.col("metric_value").isNotNull(), name("metric.value", "number")), F.when(X.filled(F.col("metric_unit")).isNotNull(), name("metric.unit", "string"))))
    tags = F.transform(F.array_sort(F.map_keys("tags")), lambda k: F.struct(F.array(F.concat(F.lit("tags."), k)).alias("keys"), F.lit("string").alias("type")))
    none = F.expr(f"cast(array() as {_FIELD})")
    df = df.select("event_id", "event_time", *KEY, "schema_url", "metric_value", "metric_unit", "tags", "payload").repartition("event_id")
    rows = df.select("event_id", "event_time", *KEY, "schema_url", F.concat(fixed, F.coalesce(tags, none)).alias("_own"), F.when(F.length("payload") > 0, F.col("payload")).alias("_payload"))
    room = MOST_FIELDS - F.size("_own")
    json = F.when(room > 0, F.expr("try_parse_json(_payload)"))
    rows = rows.withColumn("_walk", X.let(json, _payload_walk)).withColumn("_json", json.isNotNull())
    rows = rows.withColumn("_below", F.when(F.col("_payload").isNotNull() & (room > 0), F.when(F.size("_walk.found") > room, F.array_sort("_walk.found")).otherwise(F.col("_walk.found"))).otherwise(none))
    cut = (room < 0) | (F.col("_json") & ((F.size("_below") >= room) | (F.size("_walk.level") > 0)))
    told = F.transform(F.slice(F.concat("_own", "_below"), 1, MOST_FIELDS), lambda f: F.struct(F.array_join(f["keys"], ".").alias("path"), f["type"].alias("type")))
    rows = rows.select("event_id", "event_time", *KEY, "schema_url", F.array_sort(told).alias("fields"), F.coalesce(cut, F.lit(False)).alias("truncated"))
    return rows.withColumn("fingerprint", fingerprint())


def fingerprint(c: str = "fields") -> Column:
    """SHA-256 of the sorted ``path:type`` lines."""
    return F.sha2(F.array_join(F.array_sort(F.transform(c, lambda f: F.concat(f["path"], F.lit(":"), f["type"]))), "\n").cast("binary"), 256)


def semantic_findings(rows: DataFrame) -> DataFrame:
    """Legacy attribute names, and payload attributes of an unexpected type: path, kind, replacement."""
    key = F.regexp_replace("path", r"^(tags|payload)\.", "")
    legacy, expected = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, new in LEGACY.items():
        legacy = F.when(key == name, new).otherwise(legacy)
    for name, kind in EXPECTED.items():
        expected = F.when(key == name, kind).otherwise(expected)
    out = rows.withColumn("replacement", legacy).withColumn("_e", expected)
    wrong = F.col("_e").isNotNull() & (F.col("type") != F.col("_e")) & F.col("path").startswith("payload.")
    out = out.withColumn("kind", F.when(F.col("replacement").isNotNull(), "legacy_semantic_attribute").when(wrong, "semantic_type_mismatch"))
    return out.where("kind is not null").drop("_e")


def _at() -> Column:
    """The place of an observation in its version's order."""
    return F.struct("event_time", "event_id")


def states(described: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable states: for each group and set of fields how often it was observed, first and last.

    Observations of a version have few different sets of fields, so this is
    small after the partial aggregation, and only sets are laid out by path.
    """
    # Pairs of time and id are aggregated by sorting; a hash in front of the wide keys makes that cheap.
    key = F.xxhash64(*KEY, *by, "fields").alias("_hash")
    return described.groupBy(key, *KEY, *by, "fields").agg(F.count(F.lit(1)).alias("n"), F.min(_at()).alias("born"), F.max(_at()).alias("last")).drop("_hash")


def merge_states(found: DataFrame) -> DataFrame:
    """One state of each group and set of fields from those of several batches."""
    return found.groupBy(*KEY, "fields").agg(F.sum("n").alias("n"), F.min("born").alias("born"), F.max("last").alias("last"))


def _by_path(found: DataFrame, by: list[str]) -> DataFrame:
    """States of each path and type: n, born, last."""
    rows = found.select(*KEY, *by, F.explode("fields").alias("_f"), "n", "born", "last")
    return rows.groupBy(*KEY, *by, F.col("_f.path").alias("path"), F.col("_f.type").alias("type")).agg(F.sum("n").alias("n"), F.min("born").alias("born"), F.max("last").alias("last"))


def _by_field(kinds: DataFrame) -> DataFrame:
    """Each path with its first type, how often it was seen, and how often in that type."""
    first = F.min(F.struct("born", "type", "n")).alias("_f")
    out = kinds.groupBy(*KEY, "path").agg(first, F.sum("n").alias("seen"), F.max("last").alias("last"))
    return out.select(*KEY, "path", F.col("_f.type").alias("type"), "seen", F.col("_f.n").alias("first_type_seen"), F.col("_f.born").alias("born"), "last")


def schema_registry(described: DataFrame) -> DataFrame:
    """State of each path of each version: first type, seen and conflict counts, required, first and last seen."""
    return registry_of(stage(states(described, []), "schema-sets"))


def registry_of(found: DataFrame) -> DataFrame:
    """The registry from :func:`states`, of one table or of several batches."""
    out = _by_field(_by_path(found, []))
    out = out.withColumn("_k", F.row_number().over(W.partitionBy(*KEY).orderBy("born", "path"))).where(F.col("_k") <= MOST_PATHS)
    out = out.select(*KEY, "path", "type", "seen", (F.col("seen") - F.col("first_type_seen")).alias("conflicts"), F.col("born.event_time").alias("first_seen"), F.col("last.event_time").alias("last_seen"))
    out = out.join(found.groupBy(*KEY).agg(F.sum("n").alias("observations")), KEY)
    return out.withColumn("required", (F.col("observations") >= FLOOR) & (F.col("seen") * 100 >= F.col("observations") * PERCENT))


def _bin(at: Column) -> Column:
    return F.floor(F.unix_micros(at) / (BIN * 1_000_000))


class History:
    """Observations of each version by bins of time: what drift findings are made of.

    Only states of bins are merged in order, in windows over bins. Findings that
    depend on the order inside a bin look at the rows of that bin alone, and only
    where its states tell that something changed there.
    """

    def __init__(self, described: DataFrame):
        self.rows = described.withColumn("bin", _bin(F.col("event_time")))
        found = stage(states(self.rows, ["bin"]), "schema-states")
        self.kinds = _by_path(found, ["bin"])
        self.first = _by_field(self.kinds.groupBy(*KEY, "path", "type").agg(F.sum("n").alias("n"), F.min("born").alias("born"), F.max("last").alias("last")))
        bins = found.groupBy(*KEY, "bin").agg(F.sum("n").alias("held"), F.min("born").alias("opened"))
        earlier = W.partitionBy(*KEY).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        #: Observations of a bin (held), before it, and of the whole version; the version's first observation.
        self.bins = bins.select(*KEY, "bin", "held", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"), F.sum("held").over(W.partitionBy(*KEY)).alias("total"), F.min("opened").over(W.partitionBy(*KEY)).alias("start"))

    def numbered(self, bins: DataFrame) -> DataFrame:
        """The observations of the given (KEY, bin), with obs_no from 1 in their version."""
        inside = W.partitionBy(*KEY, "bin").orderBy("event_time", "event_id")
        rows = self.rows.join(bins.select(*KEY, "bin").distinct(), [*KEY, "bin"], "left_semi").withColumn("_in", F.row_number().over(inside))
        return rows.join(self.bins.select(*KEY, "bin", "before"), [*KEY, "bin"]).withColumn("obs_no", F.col("before") + F.col("_in"))

    def added(self) -> DataFrame:
        """Paths that a version's first observation lacks, with their birth."""
        starts = self.bins.groupBy(*KEY).agg(F.min("start").alias("start"))
        return self.first.join(starts, KEY).where("born > start").select(*KEY, "path", "type", "born", _bin(F.col("born.event_time")).alias("bin"))


def fields_added(described: DataFrame) -> DataFrame:
    """Paths that a version's first observation lacks: where they first came."""
    history = History(described)
    added = history.added()
    at = history.numbered(added).select(*KEY, "bin", _at().alias("born"), "obs_no")
    return added.join(at, [*KEY, "bin", "born"]).select(*KEY, "path", "type", "obs_no", F.col("born.event_time").alias("event_time"))


def type_conflicts(described: DataFrame) -> DataFrame:
    """Observations of a path in another type than its first."""
    history = History(described)
    first = history.first.select(*KEY, "path", F.col("type").alias("previous_type"))
    changed = history.kinds.join(first, [*KEY, "path"]).where("type != previous_type").select(*KEY, "bin", "path", "previous_type", "type")
    rows = history.numbered(changed).select(*KEY, "bin", "event_time", "obs_no", F.explode("fields").alias("_f")).select("*", "_f.path", "_f.type")
    return rows.join(changed, [*KEY, "bin", "path", "type"]).select(*KEY, "path", "previous_type", "type", "obs_no", "event_time")


def required_missing(described: DataFrame) -> DataFrame:
    """For each established path how often it was missing while required, and when last.

    A path is missing at observation o while o - 1 >= FLOOR, and it was in at
    least PERCENT of the o - 1 before. In bins without it, and there alone, its count stands
    still, so the hits are whole numbers in a range. Bins that hold some
    observations with and some without it are walked, unless their counts tell
    that it can't be required there.
    """
    history = History(described)
    held = history.kinds.groupBy(*KEY, "bin", "path").agg(F.sum("n").alias("with_it")).join(history.bins, [*KEY, "bin"])
    by_path = W.partitionBy(*KEY, "path").orderBy("bin")
    held = held.withColumn("seen", F.coalesce(F.sum("with_it").over(by_path.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    held = held.withColumn("next", F.coalesce(F.lead("before").over(by_path), "total"))
    # After a bin, up to the next one with the path: observations before + held + 1 to next.
    count = F.col("seen") + F.col("with_it")
    low = F.greatest(F.col("before") + F.col("held") + 1, F.lit(FLOOR + 1))
    high = F.least(F.col("next"), F.floor(count * 100 / PERCENT) + 1)
    gaps = held.withColumn("_n", high - low + 1).where("_n > 0").select(*KEY, "path", "_n", high.alias("_at"))
    mixed = held.where("with_it < held").where(count * 100 >= F.greatest(F.col("before"), F.lit(FLOOR)) * PERCENT).select(*KEY, "bin", "path", "seen")
    rows = history.numbered(mixed).join(mixed, [*KEY, "bin"]).withColumn("_has", F.exists("fields", lambda f: f["path"] == F.col("path")).cast("int"))
    earlier = W.partitionBy(*KEY, "bin", "path").orderBy("obs_no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_k", F.col("seen") + F.coalesce(F.sum("_has").over(earlier), F.lit(0)))
    hits = rows.where("_has = 0").where((F.col("obs_no") > FLOOR) & (F.col("_k") * 100 >= (F.col("obs_no") - 1) * PERCENT))
    every = gaps.union(hits.groupBy(*KEY, "path").agg(F.count(F.lit(1)).alias("_n"), F.max("obs_no").alias("_at")))
    return every.groupBy(*KEY, "path").agg(F.sum("_n").cast("long").alias("occurrences"), F.max("_at").cast("long").alias("last_obs"))


def schema_url_changes(described: DataFrame) -> DataFrame:
    """Observations whose schema URL differs from the last one told.

    The last URL is looked for inside a bin of time, and carried on from bin to bin.
    """
    rows = described.withColumn("schema_url", X.filled(F.col("schema_url"))).where("schema_url is not null").withColumn("_bin", _bin(F.col("event_time")))
    bins = rows.groupBy(*KEY, "_bin").agg(F.max_by("schema_url", _at()).alias("_told"))
    bins = bins.withColumn("_carried", F.lag("_told").over(W.partitionBy(*KEY).orderBy("_bin"))).drop("_told")
    inside = F.lag("schema_url").over(W.partitionBy(*KEY, "_bin").orderBy("event_time", "event_id"))
    rows = rows.withColumn("_inside", inside).join(bins, [*KEY, "_bin"]).withColumn("previous_url", F.coalesce("_inside", "_carried"))
    return rows.where("previous_url is not null and schema_url != previous_url").select(*KEY, "event_id", "event_time", "previous_url", "schema_url")


def schema_drifts(described: DataFrame) -> DataFrame:
    """Findings by signature: kind, path, severity, occurrences."""
    found = stage(states(described, []), "schema-sets")
    kinds = _by_path(found, [])
    first = _by_field(kinds)
    start = found.groupBy(*KEY).agg(F.min("born").alias("start"))
    added = first.join(start, KEY).where("born > start").select(*KEY, F.lit("field_added").alias("kind"), "path", F.lit("info").alias("severity"), "type", F.lit(1).cast("long").alias("occurrences"))
    changed = kinds.join(first.select(*KEY, "path", F.col("type").alias("_first")), [*KEY, "path"]).where("type != _first")
    changed = changed.select(*KEY, F.lit("type_changed").alias("kind"), "path", F.lit("breaking").alias("severity"), F.concat_ws(">", "_first", "type").alias("type"), F.col("n").alias("occurrences"))
    missing = required_missing(described).select(*KEY, F.lit("required_field_missing").alias("kind"), "path", F.lit("breaking").alias("severity"), F.lit("").alias("type"), "occurrences")
    out = added.union(changed).union(missing)
    return out.withColumn("signature", F.sha2(F.concat_ws("|", *KEY, "kind", "path", "type").cast("binary"), 256))


def schema_health(drifts: DataFrame) -> DataFrame:
    """The worst severity that each version ever showed."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("severity"))
    worst = drifts.groupBy(*KEY).agg(F.max(rank).alias("_r"))
    return worst.select(*KEY, F.element_at(F.array(F.lit("healthy"), F.lit("warning"), F.lit("breaking")), F.col("_r").cast("int")).alias("health"))


def schema_diff(registry: DataFrame, old: str, new: str) -> DataFrame:
    """Changes of each (tenant, source, type) between two versions, with the compatibility of the whole."""
    key = KEY[:3]
    a = registry.where(F.col("schema_version") == old).select(*key, "path", F.col("type").alias("_a"), "required")
    b = registry.where(F.col("schema_version") == new).select(*key, "path", F.col("type").alias("_b"))
    both = a.select(*key).distinct().join(b.select(*key).distinct(), key)
    rows = a.join(both, key, "left_semi").join(b.join(both, key, "left_semi"), [*key, "path"], "full_outer")
    kind = F.when(F.col("_b").isNull(), "field_removed").when(F.col("_a").isNull(), "field_added").when(F.col("_a") != F.col("_b"), "type_changed")
    severity = F.when(kind == "field_removed", F.when(F.col("required"), "breaking").otherwise("warning")).when(kind == "type_changed", "breaking").when(kind == "field_added", "info")
    rows = rows.withColumn("kind", kind).withColumn("severity", severity)
    worst = F.max(F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("severity"))).over(W.partitionBy(*key))
    rows = rows.withColumn("compatibility", F.when(worst == 3, "breaking").when(worst == 2, "review").otherwise("compatible"))
    return rows.where("kind is not null").select(*key, "path", "kind", "severity", F.col("_a").alias("previous_type"), F.col("_b").alias("current_type"), "compatibility")


def newest_version(registry: DataFrame) -> DataFrame:
    """The version of each (tenant, source, type) that was seen last."""
    last = registry.groupBy(*KEY).agg(F.max("last_seen").alias("last_seen"))
    w = W.partitionBy(*KEY[:3]).orderBy(F.col("last_seen").desc(), F.col("schema_version").desc())
    return last.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def previous_version(described: DataFrame) -> DataFrame:
    """For each version the other one that was seen last before its first observation.

    All that came before a version's first observation is another version. It is
    looked for in the first observation's own bin of time, and otherwise carried
    on from the bins before.
    """
    key = KEY[:3]
    seen = F.struct("event_time", "event_id", "schema_version")
    rows = described.select(*key, seen.alias("_seen"), _bin(F.col("event_time")).alias("_bin"))
    first = described.groupBy(*KEY).agg(F.min(_at()).alias("_f"))
    first = first.select(*KEY, F.struct("_f.event_time", "_f.event_id", F.lit("").alias("schema_version")).alias("_first"), _bin(F.col("_f.event_time")).alias("_bin"))
    bins = rows.groupBy(*key, "_bin").agg(F.max("_seen").alias("_last"))
    bins = bins.withColumn("_carried", F.lag("_last").over(W.partitionBy(*key).orderBy("_bin"))).drop("_last")
    inside = first.join(rows, [*key, "_bin"]).where("_seen < _first").groupBy(*KEY).agg(F.max("_seen").alias("_inside"))
    out = first.join(bins, [*key, "_bin"]).join(inside, KEY, "left")
    return out.select(*KEY, F.coalesce("_inside", "_carried")["schema_version"].alias("previous"))
