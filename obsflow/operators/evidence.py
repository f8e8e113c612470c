"""Incidents, frozen evidence, and the evidence graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsflow.functions import exprs as X
from obsflow.operators.folds import spaced
from obsflow.operators.intervals import interval_join
from obsflow.operators.stats import sliding_error_count
from obsflow.schema import CONTROL
from obsflow.staging import stage

KEY = ["tenant_id", "incident_id"]
SUPPORTING, RELATED, CONTRADICTING = "supporting", "related", "contradicting"
#: Relations that speak for (and against) each hypothesis.
HYPOTHESES = {
    "recent-change-associated": ("change-precedes-error", "structured-change-precedes-error", "recovery-after-rollback"),
    "latency-before-errors": ("latency-precedes-error",),
    "sustained-degradation": ("latency-precedes-error", "recovery-signal", "recovery-after-rollback"),
}


def _seconds(n: float) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


def detect_incidents(df: DataFrame, latency_ms: float = 1000.0, errors: int = 5, window: int = 60, cooldown: int = 600, lookback: int = 900) -> DataFrame:
    """Incidents from latency breaches and error bursts, spaced by the cooldown of each (tenant, source, category)."""
    rows = sliding_error_count(df, window, latency_ms)
    slow = X.high_latency(latency_ms)
    burst = ~slow & X.is_error() & (F.col("recent_errors") >= errors)
    rows = rows.withColumn("category", F.when(slow, "latency").when(burst, "errors")).where("category is not null")
    rows = rows.select("tenant_id", "source", "category", "event_time", "event_id", "metric_value", "recent_errors")
    rows = spaced(rows, ["tenant_id", "source", "category"], "event_time", "event_id", cooldown)
    return as_incidents(rows, latency_ms, window, lookback)


def as_incidents(rows: DataFrame, latency_ms: float = 1000.0, window: int = 60, lookback: int = 900) -> DataFrame:
    """Incidents of the events that trigger them: tenant_id, source, category, event_time, event_id, metric_value, recent_errors."""
    slow = F.concat(F.lit("latency threshold breached: "), X.one_decimal(F.col("metric_value")), F.lit(f"ms >= {latency_ms:.1f}ms"))
    burst = F.concat(F.lit("error threshold breached: "), F.col("recent_errors").cast("string"), F.lit(f" errors within {X.duration_text(window)}"))
    at = F.col("event_time")
    return rows.select(
        "tenant_id", F.concat(F.lit("AUTO-"), F.unix_millis(at).cast("string"), F.lit("-"), X.slug(F.col("source")), F.lit("-"), "category").alias("incident_id"),
        F.concat(F.lit("Automatic incident: "), "source").alias("title"), "source", "category", F.when(F.col("category") == "latency", slow).otherwise(burst).alias("reason"), (at - _seconds(lookback)).alias("frozen_from"), at.alias("frozen_to"), "event_id",
    )


#: Incidents up to this many (each in a few bins of time, some 100 bytes) are broadcast to the captures.
FEW = 100_000


def freeze(incidents: DataFrame, captures: DataFrame) -> DataFrame:
    """Captured events of each incident's window, from all sources of its tenant; of each event the earliest capture.

    A capture is the earliest in a window if the event's capture before it lies
    before the window. So repeated captures are told apart before the windows are
    laid out, and nothing is sorted by incident.
    """
    spans = incidents.select("tenant_id", "incident_id", "frozen_from", "frozen_to")
    few = spans.limit(FEW + 1).count() <= FEW
    before = F.lag("captured_at").over(W.partitionBy("tenant_id", "event_id").orderBy("captured_at"))
    rows = interval_join(spans, captures.withColumn("_before", before), ["tenant_id"], F.col("frozen_from"), F.col("frozen_to"), F.col("captured_at"), 900, few=few)
    return rows.where("_before is null or _before < frozen_from").drop("_before", "frozen_from", "frozen_to")


def incident_counts(incidents: DataFrame, frozen: DataFrame) -> DataFrame:
    """Incidents with the number of their frozen events, also if none."""
    n = frozen.groupBy(*KEY).agg(F.count_distinct("event_id").alias("events"))
    return incidents.join(n, KEY, "left").withColumn("events", F.coalesce("events", F.lit(0)))


#: What each relation says for or against a hypothesis, and why.
RELATIONS = {
    "captured-in": (RELATED, "Event is part of the frozen incident evidence window."),
    "evaluated-by-replay": (RELATED, "Replay evaluated this incident under a recorded policy version."),
    "evaluated-by-cost-simulation": (RELATED, "Cost simulation used the frozen incident as its comparison sample."),
    "change-near-incident": (RELATED, "A structured operational change occurred near the frozen incident window."),
    "shared-correlation": (SUPPORTING, "Events share a captured correlation_id, supporting membership in the same application flow."),
    "shared-trace": (SUPPORTING, "Events share a captured trace_id, supporting membership in the same distributed trace."),
    "same-source-sequence": (RELATED, "Events occurred on the same source within 30 seconds; this is temporal context, not causality."),
    "latency-precedes-error": (SUPPORTING, "A high-latency signal preceded an error on the same source within 60 seconds."),
    "recovery-signal": (CONTRADICTING, "A later normal-latency signal contradicts a hypothesis of continuously sustained degradation."),
    "change-precedes-error": (SUPPORTING, "A captured deployment/change marker preceded an error on the same source within five minutes. Temporal association does not prove the change caused the error."),
    "structured-change-precedes-error": (SUPPORTING, "A structured change marker preceded an error on the same source within ten minutes. Temporal association does not prove the change caused the error."),
    "explicit-rollback-of": (RELATED, "The rollback marker explicitly references the earlier change ID."),
    "recovery-after-rollback": (CONTRADICTING, "A normal-latency signal followed the rollback. This contradicts uninterrupted degradation but does not prove the rollback caused recovery."),
}
EDGE = [*KEY, "from", "to", "relation"]
#: Relations that hypotheses are counted from.
TOLD = ("latency-precedes-error", "recovery-signal", "change-precedes-error", "structured-change-precedes-error", "recovery-after-rollback")


def _explained(edges: DataFrame) -> DataFrame:
    """Edges with the assessment and reason of their relation."""
    of = lambda i: F.create_map(*(F.lit(x) for r, told in RELATIONS.items() for x in (r, told[i])))[F.col("relation")]
    return edges.select(*EDGE, of(0).alias("assessment"), of(1).alias("reason"))


def facts(ev: DataFrame) -> DataFrame:
    """What links are made of: a narrow row for each event, captured (before they are frozen, which repeats them) or frozen."""
    if "correlation" in ev.columns:
        return ev
    own = [c for c in (*KEY, "captured_at") if c in ev.columns]
    return ev.select(
        *own, "event_id", "event_time", "source", "event_type", X.filled(F.col("correlation_id")).alias("correlation"), X.first_tag("trace_id").alias("trace"), X.first_tag("version").alias("version"),
        X.is_error(trim=True).alias("error"), X.high_latency().alias("high"), X.normal_latency().alias("normal"), X.is_change_graph().alias("change"), _attributes(F.col("tags")).alias("attributes"),
    )


def frozen_facts(incidents: DataFrame, captures: DataFrame) -> DataFrame:
    """The facts of the frozen events of all incidents, dealt by incident and written once, for the many that read them."""
    return stage(freeze(incidents, facts(captures)).drop("captured_at").repartition(*KEY), "evidence-facts")


#: Tags that nodes show; those of changes also with the control prefix.
SHOWN = ("deployment_id", "version", "release", "git_sha", "build_id")
SHOWN_CONTROL = ("change_id", "change_kind", "environment", "version", "git_sha", "build_id", "rollback_of")


def _attributes(tags: Column) -> Column:
    """The shown tags with a value. Correlation and trace ids are never among them."""
    names = F.array(*(F.lit(n) for n in (*SHOWN, *(CONTROL + n for n in SHOWN_CONTROL))))
    return F.map_filter(tags, lambda k, v: F.array_contains(names, k) & (F.trim(v) != ""))


def _event(c: str | Column) -> Column:
    return F.concat(F.lit("event:"), c)


def _linked(rows: DataFrame, start: str | Column, end: str | Column, relation: str | Column) -> DataFrame:
    return rows.select(*KEY, _event(start).alias("from"), _event(end).alias("to"), (F.lit(relation) if isinstance(relation, str) else relation).alias("relation"))


def source_links(f: DataFrame, sequence: int = 30, error: int = 60, calm: int = 120, only: tuple[str, ...] | None = None) -> DataFrame:
    """Links between events of one source, in one pass over its events from the last to the first.

    Each event links back to the one before it within ``sequence`` seconds; a high
    latency to the next error within ``error``; an error to the next normal latency within ``calm``.
    """
    w = W.partitionBy(*KEY, "source").orderBy(F.col("event_time").desc(), F.col("event_id").desc())
    later = w.rowsBetween(W.unboundedPreceding, -1)
    following = lambda flag: F.last(F.when(F.col(flag), F.struct("event_time", "event_id")), ignorenulls=True).over(later)
    rows = f.select(
        *KEY, "event_id", "event_time", F.struct("event_time", "event_id").alias("_own"), F.lead(F.struct("event_time", "event_id")).over(w).alias("_before"),
        F.when(F.col("high"), following("error")).alias("_error"), F.when(F.col("error"), following("normal")).alias("_calm"),
    )
    link = lambda a, b, seconds, relation: F.when(F.col(b)["event_time"] <= F.col(a)["event_time"] + _seconds(seconds), F.struct(F.col(a)["event_id"].alias("a"), F.col(b)["event_id"].alias("b"), F.lit(relation).alias("relation")))
    made = {"same-source-sequence": ("_before", "_own", sequence), "latency-precedes-error": ("_own", "_error", error), "recovery-signal": ("_own", "_calm", calm)}
    chosen = [link(*args, relation) for relation, args in made.items() if only is None or relation in only]
    return _linked(rows.select(*KEY, F.explode(F.array_compact(F.array(*chosen))).alias("l")).select(*KEY, "l.*"), "a", "b", F.col("relation"))


def id_links(f: DataFrame, kinds: tuple[str, ...] = ("correlation", "trace")) -> DataFrame:
    """From each event to the next that shares its correlation or trace id; both kinds in one shuffle."""
    ids = F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.struct(F.lit(f"shared-{k}").alias("relation"), F.col(k).alias("id"))) for k in kinds)))
    rows = f.select(*KEY, "event_id", "event_time", F.explode(ids).alias("_i")).select(*KEY, "event_id", "event_time", "_i.*")
    w = W.partitionBy(*KEY, "relation", "id").orderBy("event_time", "event_id")
    rows = rows.withColumn("_before", F.lag("event_id").over(w)).where("_before is not null")
    return _linked(rows, "_before", "event_id", F.col("relation"))


def change_links(f: DataFrame, within: int = 300) -> DataFrame:
    """From each change event to every later error of its source within five minutes."""
    spans = f.where("change").select(*KEY, "source", F.col("event_id").alias("_c"), F.col("event_time").alias("_t"))
    errors = f.where("error").select(*KEY, "source", "event_id", "event_time")
    rows = interval_join(spans, errors, [*KEY, "source"], F.col("_t"), F.col("_t") + _seconds(within), F.col("event_time"), within)
    rows = rows.where((F.col("event_time") > F.col("_t")) | (F.col("event_id") > F.col("_c")))
    return _linked(rows, "_c", "event_id", "change-precedes-error")


def link_correlation(ev: DataFrame) -> DataFrame:
    return _explained(id_links(facts(ev), ("correlation",)))


def link_trace(ev: DataFrame) -> DataFrame:
    return _explained(id_links(facts(ev), ("trace",)))


def link_source_sequence(ev: DataFrame, gap: int = 30) -> DataFrame:
    return _explained(source_links(facts(ev), sequence=gap, only=("same-source-sequence",)))


def latency_then_error(ev: DataFrame, within: int = 60) -> DataFrame:
    """From each high latency to the first later error of its source, if it comes in time."""
    return _explained(source_links(facts(ev), error=within, only=("latency-precedes-error",)))


def error_then_recovery(ev: DataFrame, within: int = 120) -> DataFrame:
    """From each error to the first later normal latency of its source, if it comes in time."""
    return _explained(source_links(facts(ev), calm=within, only=("recovery-signal",)))


def change_precedes_error(ev: DataFrame, within: int = 300) -> DataFrame:
    return _explained(change_links(facts(ev), within))


def marker_nodes(markers: DataFrame, ev: DataFrame) -> DataFrame:
    """Markers of each incident with their ``node``: the captured event's, or one of their own."""
    # Of the events only those that are markers go on.
    held = ev.select(*KEY, "event_id").join(markers.select(*KEY, "event_id"), [*KEY, "event_id"], "left_semi").distinct()
    held = held.select(F.col("tenant_id").alias("_tenant"), F.col("incident_id").alias("_incident"), F.col("event_id").alias("_e"))
    same = (F.col("tenant_id") == F.col("_tenant")) & (F.col("incident_id") == F.col("_incident")) & (F.col("event_id") == F.col("_e"))
    rows = markers.join(held, same, "left").drop("_tenant", "_incident")
    return rows.withColumn("node", F.when(F.col("_e").isNotNull(), F.concat(F.lit("event:"), "_e")).otherwise(F.concat(F.lit("change:"), "change_id")))


def _marked(spans: DataFrame, f: DataFrame, flag: str, within: int) -> DataFrame:
    """Each marker with the flagged events of its source in the ``within`` seconds after it."""
    events = f.where(flag).select(*KEY, "source", "event_id", "event_time")
    return interval_join(spans, events, [*KEY, "source"], F.col("changed_at"), F.col("changed_at") + _seconds(within), F.col("event_time"), within)


def marker_links(nodes: DataFrame, f: DataFrame, within: int = 600) -> DataFrame:
    """From each structured marker to every error of its source within ten minutes."""
    rows = _marked(nodes.select(*KEY, "source", "node", "changed_at"), f, "error", within)
    return rows.select(*KEY, F.col("node").alias("from"), _event("event_id").alias("to"), F.lit("structured-change-precedes-error").alias("relation")).distinct()


def rollback_links(nodes: DataFrame, f: DataFrame, within: int = 600) -> DataFrame:
    """From each rollback that names a change to the first normal latency of its source within ten minutes."""
    spans = nodes.where("kind = 'rollback' and coalesce(rollback_of, '') != ''").select(*KEY, "source", "node", "change_id", "changed_at")
    rows = _marked(spans, f, "normal", within)
    first = rows.groupBy(*KEY, "node", "change_id").agg(F.min(F.struct("event_time", "event_id")).alias("_f"))
    return first.select(*KEY, F.col("node").alias("from"), _event(F.col("_f.event_id")).alias("to"), F.lit("recovery-after-rollback").alias("relation")).distinct()


def named_links(nodes: DataFrame) -> DataFrame:
    """From a change to the rollback that names it."""
    rolls = nodes.where("kind = 'rollback' and rollback_of is not null").select(*KEY, F.col("rollback_of").alias("change_id"), F.col("node").alias("to"))
    rows = nodes.select(*KEY, "change_id", F.col("node").alias("from")).join(rolls, [*KEY, "change_id"])
    return rows.select(*KEY, "from", "to", F.lit("explicit-rollback-of").alias("relation")).distinct()


def marker_precedes_error(nodes: DataFrame, ev: DataFrame, within: int = 600) -> DataFrame:
    return _explained(marker_links(nodes, facts(ev), within))


def recovery_after_rollback(nodes: DataFrame, ev: DataFrame, within: int = 600) -> DataFrame:
    return _explained(rollback_links(nodes, facts(ev), within))


def explicit_rollback(nodes: DataFrame) -> DataFrame:
    return _explained(named_links(nodes))


#: Families of relations in the order in which the cap admits them.
ORDER = ("change-near-incident", "shared-correlation", "shared-trace", "same-source-sequence", "latency-precedes-error", "recovery-signal", "change-precedes-error", "structured-change-precedes-error", "explicit-rollback-of", "recovery-after-rollback")

#: Relations of an incident to its runs, by the kind of the run's node.
RUNS = {"replay": "evaluated-by-replay", "cost-simulation": "evaluated-by-cost-simulation"}


#: Edges of an incident beyond which they are first capped in parts.
BUSY, PARTS = 100_000, 64


def relation_rank() -> Column:
    """The place of a relation in the order in which the cap admits edges."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ORDER)), F.col("relation")), F.lit(0))


def cap_edges(edges: DataFrame, cap: int = 2000, busy: DataFrame | None = None) -> DataFrame:
    """Distinct edges, at most ``cap`` of an incident, in the order of relation, from and to; captures and runs don't count.

    ``busy`` names incidents (tenant_id, incident_id) whose edges are capped in PARTS
    parts first, so that one task gets no more than PARTS caps of them.
    """
    exempt = F.col("relation").isin("captured-in", *RUNS.values())
    rows = edges.where(~exempt)
    rank = relation_rank()
    same = F.struct("relation", "from", "to")

    def capped(rows: DataFrame, *by: str) -> DataFrame:
        w = W.partitionBy(*KEY, *by).orderBy(rank, "relation", "from", "to")
        rows = rows.withColumn("_new", (~F.lag(same).over(w).eqNullSafe(same)).cast("int"))
        rows = rows.withColumn("_k", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        return rows.where((F.col("_new") == 1) & (F.col("_k") <= cap)).drop("_new", "_k")

    if busy is not None:
        many = rows.join(busy, KEY, "left_semi").withColumn("_part", F.pmod(F.xxhash64("from", "to", "relation"), F.lit(PARTS)))
        rows = rows.join(busy, KEY, "left_anti").unionByName(capped(many, "_part").drop("_part"))
    return edges.where(exempt).unionByName(capped(rows))


def evidence_edges(f: DataFrame, nodes: DataFrame | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """Edges of ``facts`` and of markers (see :func:`marker_nodes`), all or ``only`` some relations. Each is there once."""
    wanted = lambda *names: only is None or any(n in only for n in names)
    root = F.concat(F.lit("incident:"), "incident_id")
    parts = []
    if wanted("captured-in"):
        parts.append(f.select(*KEY, root.alias("from"), _event("event_id").alias("to"), F.lit("captured-in").alias("relation")))
    if wanted("shared-correlation", "shared-trace"):
        parts.append(id_links(f))
    if wanted("same-source-sequence", "latency-precedes-error", "recovery-signal"):
        parts.append(source_links(f, only=only))
    if wanted("change-precedes-error"):
        parts.append(change_links(f))
    if nodes is not None:
        if wanted("change-near-incident"):
            parts.append(nodes.where("_e is null").select(*KEY, root.alias("from"), F.col("node").alias("to"), F.lit("change-near-incident").alias("relation")))
        if wanted("structured-change-precedes-error"):
            parts.append(marker_links(nodes, f))
        if wanted("explicit-rollback-of"):
            parts.append(named_links(nodes))
        if wanted("recovery-after-rollback"):
            parts.append(rollback_links(nodes, f))
    return _explained(reduce(DataFrame.unionByName, (p.select(*EDGE) for p in parts)))


def evidence_nodes(incidents: DataFrame, f: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes of every incident: id, kind, label, source, event_type, version, event_time and attributes."""
    none = lambda kind: F.lit(None).cast(kind)
    kind = F.when(F.col("change"), "change").when(F.col("error"), "error").when(F.col("high"), "latency").otherwise("event")
    no = F.expr("cast(map() as map<string,string>)")
    out = incidents.select(
        *KEY, F.concat(F.lit("incident:"), "incident_id").alias("id"), F.lit("incident").alias("kind"), F.col("incident_id").alias("label"), none("string").alias("source"), none("string").alias("event_type"),
        none("string").alias("version"), none("timestamp").alias("event_time"), no.alias("attributes"),
    )
    out = out.union(f.select(*KEY, _event("event_id"), kind, F.concat_ws(" · ", "source", "event_type"), "source", "event_type", "version", "event_time", F.coalesce("attributes", no)))
    if nodes is not None:
        told = F.create_map(*(x for n in ("change_id", "kind", "environment", "version", "previous_version", "git_sha", "build_id", "rollback_of") for x in (F.lit(n), F.col(n))))
        own = nodes.where("_e is null")
        out = out.union(own.select(*KEY, "node", F.lit("change"), F.concat_ws(" · ", "source", "kind"), "source", "kind", "version", "changed_at", F.map_filter(told, lambda _, v: F.trim(v) != "")))
    return out


def evidence_graph(incidents: DataFrame, ev: DataFrame, markers: DataFrame | None = None, cap: int | None = 2000, replays: DataFrame | None = None, costs: DataFrame | None = None, only: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every incident. ``ev`` are frozen events or their facts, ``markers`` changes near an incident; both carry incident_id.

    ``cap`` bounds the edges of an incident; None leaves them all, which is what counts are taken from.
    ``only`` names the relations to make. ``replays`` and ``costs`` are runs of incidents: tenant_id, incident_id, run_id. Runs of other incidents make nothing.

    Correlation and trace ids make edges and are never exported.
    """
    f = ev if "correlation" in ev.columns else stage(facts(ev), "evidence-facts")
    m = None if markers is None else stage(marker_nodes(markers, f), "evidence-markers")
    nodes, edges = evidence_nodes(incidents, f, m), evidence_edges(f, m, only)
    root, none = F.concat(F.lit("incident:"), "incident_id"), F.lit(None)
    for node_kind, prefix, runs in (("replay", "replay:", replays), ("cost-simulation", "cost:", costs)):
        if runs is not None:
            own = runs.join(incidents.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, F.concat(F.lit(prefix), "run_id").alias("id"), "run_id")
            nodes = nodes.union(own.select(*KEY, "id", F.lit(node_kind), "run_id", none, none, none, none, F.expr("cast(map() as map<string,string>)")))
            edges = edges.unionByName(_explained(own.select(*KEY, root.alias("from"), F.col("id").alias("to"), F.lit(RUNS[node_kind]).alias("relation"))))
    if cap is None:
        return nodes, edges
    # Few incidents have more edges than the cap; only theirs are sorted.
    exempt = F.col("relation").isin("captured-in", *RUNS.values())
    rows = stage(edges.where(~exempt).select(*EDGE), "evidence-edges")
    over = stage(rows.groupBy(*KEY).count().where(F.col("count") > cap), "evidence-over")
    most = over.agg(F.max("count")).collect()[0][0] or 0
    busy = over.where(F.col("count") > BUSY).select(*KEY) if most > BUSY else None
    kept = cap_edges(rows.join(over, KEY, "left_semi"), cap, busy) if most else rows.where("false")
    return nodes, edges.where(exempt).unionByName(_explained(rows.join(over, KEY, "left_anti").unionByName(kept)))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of each incident's graph."""
    e = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("assessment") == SUPPORTING).alias("supporting"), F.count_if(F.col("assessment") == CONTRADICTING).alias("contradicting"), F.count_if(F.col("assessment") == RELATED).alias("related"))
    n = nodes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("nodes"))
    return n.join(e, KEY, "left").fillna(0, ["edges", "supporting", "contradicting", "related"])


def hypotheses(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each incident the hypotheses that its edges speak for or against; one ``insufficient-evidence`` if none."""
    n = lambda *names: F.count_if(F.col("relation").isin(*names))
    counts = edges.groupBy(*KEY).agg(n("change-precedes-error", "structured-change-precedes-error").alias("change"), n("latency-precedes-error").alias("latency"), n("recovery-signal", "recovery-after-rollback").alias("calm"))
    counts = nodes.where("kind = 'incident'").select(*KEY).distinct().join(counts, KEY, "left").fillna(0)
    row = lambda name, yes, no: F.struct(F.lit(name).alias("hypothesis"), yes.cast("long").alias("supporting"), no.cast("long").alias("contradicting"))
    c, zero = F.col, F.lit(0)
    all_ = F.array(row("recent-change-associated", c("change"), zero), row("latency-before-errors", c("latency"), zero), row("sustained-degradation", c("latency"), c("calm")))
    told = F.filter(all_, lambda h: (h["supporting"] > 0) | (h["contradicting"] > 0))
    told = F.when(F.size(told) > 0, told).otherwise(F.array(row("insufficient-evidence", zero, zero)))
    rows = counts.select(*KEY, F.explode(told).alias("h")).select(*KEY, "h.*")
    status = F.when((c("supporting") > 0) & (c("contradicting") > 0), "mixed").when(c("supporting") > 0, "supported").when(c("contradicting") > 0, "contradicted").otherwise("insufficient")
    return rows.withColumn("status", status)


def investigate(edges: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """Findings with their counts, confidence and rank within the incident.

    Counts are taken from all ``edges``, and are sums alone. With ``cited``, edges
    under a cap, each finding also has the edges and nodes that it cites among those.
    """
    known = [(h, r) for h, rs in HYPOTHESES.items() for r in rs]
    relations = F.array(*(F.struct(F.lit(h).alias("finding"), F.lit(r).alias("_r")) for h, r in known))

    def told(edges: DataFrame) -> DataFrame:
        rows = edges.where(F.col("relation").isin(*{r for _, r in known}) & F.col("assessment").isin(SUPPORTING, CONTRADICTING))
        return rows.withColumn("_f", F.explode(F.filter(relations, lambda x: x["_r"] == F.col("relation")))).select("*", "_f.finding")

    rows = told(edges)
    yes, no = F.col("assessment") == SUPPORTING, F.col("assessment") == CONTRADICTING
    out = rows.groupBy(*KEY, "finding").agg(F.count_if(yes).alias("support"), F.count_if(no).alias("contradiction"), F.count_if(F.col("relation").isin("change-precedes-error", "structured-change-precedes-error")).alias("_change"))
    # A hypothesis stands only if one of its own counts does; rollback recovery alone makes no change hypothesis.
    out = out.where("finding != 'recent-change-associated' or _change > 0").drop("_change")
    s, c = F.col("support"), F.col("contradiction")
    status = F.when(s == 0, "insufficient").when(c > 0, "mixed").otherwise("supported")
    sure = F.when(s == 0, "insufficient").when(c > 0, "mixed").when(s >= 4, "high").when(s >= 2, "medium").otherwise("low")
    out = out.withColumn("status", status).withColumn("confidence", sure)
    out = out.withColumn("score", s * 10 - c * 4 + F.when(sure == "high", 3).when(sure == "medium", 2).when(sure == "low", 1).otherwise(0))
    place = F.array_position(F.array(*map(F.lit, HYPOTHESES)), F.col("finding"))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy(*KEY).orderBy(F.col("score").desc(), place)))
    if cited is None:
        return out
    cite = F.concat_ws("|", "from", "to", "relation")
    lists = told(cited).groupBy(*KEY, "finding").agg(F.array_sort(F.collect_set(cite)).alias("citations"), F.array_sort(F.array_union(F.collect_set("from"), F.collect_set("to"))).alias("cited_nodes"))
    return out.join(lists, [*KEY, "finding"], "left")


def features(nodes: DataFrame, hypotheses_: DataFrame) -> DataFrame:
    """(incident, family, feature) that incidents are compared by."""
    family = lambda name, value, cond: F.when(cond & value.isNotNull(), F.struct(F.lit(name).alias("family"), value.alias("feature")))
    yes, c = F.lit(True), F.col
    told = F.array_compact(F.array(family("source", c("source"), yes), family("type", c("event_type"), yes), family("change", F.concat(F.lit("version:"), "version"), c("kind") == "change")))
    # Nodes repeat few features, which are told apart before they are laid out.
    rows = nodes.select(*KEY, "source", "event_type", F.when(c("kind") == "change", c("kind")).alias("kind"), F.when(c("kind") == "change", c("version")).alias("version")).distinct()
    rows = rows.select(*KEY, F.explode(told).alias("f")).select(*KEY, "f.*")
    return rows.union(hypotheses_.where("status != 'insufficient'").select(*KEY, F.lit("hypothesis"), "hypothesis")).distinct()


WEIGHTS = {"source": 0.30, "type": 0.25, "hypothesis": 0.35, "change": 0.10}


def feature_sets(feats: DataFrame) -> DataFrame:
    """Each incident with its array of features in every family, and its set: the smallest incident of the tenant with the same."""
    own = feats.groupBy(*KEY).agg(*(F.array_sort(F.collect_set(F.when(F.col("family") == f, F.col("feature")))).alias(f) for f in WEIGHTS))
    first = own.groupBy("tenant_id", *WEIGHTS).agg(F.min("incident_id").alias("set"))
    return own.join(first, ["tenant_id", *WEIGHTS]).select(*KEY, "set", *WEIGHTS)


def _jaccard(f: str) -> tuple[Column, Column]:
    """Features of a family that both sides share, and their share of the union."""
    both = F.size(F.array_intersect(f"left_{f}", f"right_{f}"))
    union = F.size(f"left_{f}") + F.size(f"right_{f}") - both
    return both, F.when(union > 0, both / union).otherwise(0.0)


def _side(df: DataFrame, side: str, families: tuple[str, ...], *more: str) -> DataFrame:
    return df.select("tenant_id", *(F.col(c).alias(f"{side}_{c}") for c in (*more, *families)))


def _judged(pairs: DataFrame) -> DataFrame:
    """Shared features, similarity and status of pairs (left_<family>, right_<family>)."""
    total = F.lit(0.0)
    for f, weight in WEIGHTS.items():
        pairs = pairs.withColumn(f"s_{f}", _jaccard(f)[0].cast("long"))
        total = total + _jaccard(f)[1] * weight
    rows = pairs.withColumn("similarity", F.round(F.round(total, 9), 3))  # the first rounding takes away the order of the sum
    return rows.withColumn("status", _status())


def _status() -> Column:
    similarity = F.col("similarity")
    return F.when(similarity >= 0.70, "strong_overlap").when(similarity >= 0.40, "partial_overlap").when(similarity > 0, "limited_overlap").otherwise("insufficient_evidence")


#: Families whose sets many incidents have in common.
CORE = ("source", "type", "hypothesis")


#: Sets of a core in a block, and pairs of sets for each task of the join.
BLOCK, PAIRS = 1024, 4_000_000


def similar_sets(sets: DataFrame, least: float = 0.0) -> DataFrame:
    """Links between different feature sets of a tenant with a similarity of ``least`` or more (above 0): left < right.

    Sets are told apart by their core (the set without changes) first. Cores that
    are ``least`` similar by themselves link all their sets, which meet block by
    block, so that a task has a bounded number of pairs however large a core is.
    Other sets must share a change, and meet by it.
    The weights add up to one, so two cores that are ``least`` similar have a family
    whose Jaccard is at least that. In it they share one of the rarest features of
    each: so many that the others alone can't reach it.
    """
    one = sets.groupBy("tenant_id", "set").agg(*(F.first(f).alias(f) for f in WEIGHTS))
    one = one.join(one.groupBy("tenant_id", *CORE).agg(F.min("set").alias("core")), ["tenant_id", *CORE])
    one = stage(one, "similar-sets")
    cores = one.where("set = core").select("tenant_id", "core", *CORE)

    def candidates(rows: DataFrame, name: str, families: tuple[str, ...], least: float) -> DataFrame:
        """Pairs of ``name`` that share a feature among the rarest of a family; any feature, if ``least`` is small."""
        named = lambda f: F.transform(f, lambda x: F.struct(F.lit(f).alias("family"), x.alias("feature"), F.size(f).alias("n")))
        spread = F.explode(F.flatten(F.array(*map(named, families))))
        tokens = rows.select("tenant_id", F.col(name).alias("x"), spread.alias("t")).select("tenant_id", "x", "t.*")
        key = ["tenant_id", "family", "feature"]
        if least > WEIGHTS["change"]:
            common = tokens.groupBy(*key).agg(F.count(F.lit(1)).alias("held"))
            rare = W.partitionBy("tenant_id", "x", "family").orderBy("held", "feature")
            tokens = tokens.join(common, key).withColumn("k", F.row_number().over(rare)).where(F.col("k") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
        a, b = (tokens.select(*key, F.col("x").alias(side)) for side in ("left", "right"))
        return a.join(b, key).where("left < right").select("tenant_id", "left", "right").distinct()

    def sides(rows: DataFrame, of: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
        """Pairs with both sides' columns as left_<column> and right_<column>."""
        for side in ("left", "right"):
            rows = rows.join(_side(of, side, columns, name).withColumnRenamed(f"{side}_{name}", side), ["tenant_id", side])
        return rows

    rounded = lambda c: F.round(F.round(c, 9), 3)
    near = candidates(cores, "core", CORE, least - WEIGHTS["change"]).unionByName(cores.select("tenant_id", F.col("core").alias("left"), F.col("core").alias("right")))
    near = sides(near, cores, "core", CORE)
    base = sum((_jaccard(f)[1] * WEIGHTS[f] for f in CORE), F.lit(0.0))
    near = near.select("tenant_id", F.col("left").alias("left_core"), F.col("right").alias("right_core"), *(_jaccard(f)[0].cast("long").alias(f"s_{f}") for f in CORE), base.alias("base"), rounded(base).alias("plain"))
    near = stage(near.where(F.col("base") + WEIGHTS["change"] >= F.lit(least) - 1e-3), "similar-cores")
    alone = (F.col("plain") > 0) & (F.col("plain") >= least)
    told = [*(f"s_{f}" for f in CORE), "base", "plain"]
    met = _blocks(one.select("tenant_id", "core", "set", "change"), near.where(alone)).select("tenant_id", "left", "right", "left_change", "right_change", *told)
    # Where the cores alone aren't enough, or share nothing, sets share a change.
    more = sides(candidates(one, "set", ("change",), 0.0), one, "set", ("core", "change"))
    more = more.withColumns({"left_core": F.least("left_core", "right_core"), "right_core": F.greatest("left_core", "right_core")})
    more = more.join(near, ["tenant_id", "left_core", "right_core"], "left").where(~F.coalesce(alone, F.lit(False)))
    more = more.select("tenant_id", "left", "right", "left_change", "right_change", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in told))
    met = met.unionByName(more)
    # Changes are sorted: arrays that lie apart share none.
    apart = (F.size("left_change") == 0) | (F.size("right_change") == 0) | (F.element_at("left_change", -1) < F.col("right_change")[0]) | (F.element_at("right_change", -1) < F.col("left_change")[0])
    shared, part = _jaccard("change")
    rows = met.withColumn("s_change", F.when(apart, 0).otherwise(shared).cast("long"))
    rows = rows.withColumn("similarity", F.when(apart, F.col("plain")).otherwise(rounded(F.col("base") + part * WEIGHTS["change"])))
    rows = rows.where((F.col("similarity") > 0) & (F.col("similarity") >= least))
    return rows.select("tenant_id", "left", "right", *(f"s_{f}" for f in WEIGHTS), "similarity", _status().alias("status"))


def _blocks(own: DataFrame, near: DataFrame) -> DataFrame:
    """All pairs left < right of the sets (tenant_id, core, set, change) of near cores, by pairs of blocks of at most some BLOCK sets."""
    spark = own.sparkSession
    held = own.groupBy("tenant_id", "core").agg(F.count(F.lit(1)).alias("_held"))
    n = lambda side: held.select("tenant_id", F.col("core").alias(f"{side}_core"), F.col("_held").alias(f"{side}_held"))
    cells = near.join(n("left"), ["tenant_id", "left_core"]).join(n("right"), ["tenant_id", "right_core"])
    blocks = lambda c: F.ceil(F.col(c) / BLOCK)
    cells = cells.withColumns({f"{side}_blocks": blocks(f"{side}_held") for side in ("left", "right")})
    for side in ("left", "right"):
        cells = cells.withColumn(f"{side}_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{side}_blocks") - 1)))
    cells = stage(cells.where("left_core != right_core or left_block <= right_block").drop("left_blocks", "right_blocks"), "similar-cells")
    total = near.join(n("left"), ["tenant_id", "left_core"]).join(n("right"), ["tenant_id", "right_core"]).agg(F.sum(F.col("left_held") * F.col("right_held"))).collect()[0][0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, min(100_000, -(-total // PAIRS)))
    own = own.join(held, ["tenant_id", "core"]).withColumn("_block", F.pmod(F.xxhash64("set"), blocks("_held"))).drop("_held")
    key = ["tenant_id", "left_core", "right_core", "left_block", "right_block"]

    def side(name: str, *more: str) -> DataFrame:
        mine = own.select("tenant_id", F.col("core").alias(f"{name}_core"), F.col("_block").alias(f"{name}_block"), F.col("set").alias(name), F.col("change").alias(f"{name}_change"))
        return cells.select(*key, *more).join(mine, ["tenant_id", f"{name}_core", f"{name}_block"]).repartition(tasks, *key)

    rows = side("left", *(f"s_{f}" for f in CORE), "base", "plain").join(side("right").hint("shuffle_hash"), key)
    same = (F.col("left_core") == F.col("right_core")) & (F.col("left_block") == F.col("right_block"))
    rows = rows.where(~same | (F.col("left") < F.col("right")))
    return rows.select("tenant_id", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "left_change", "right_change", *(f"s_{f}" for f in CORE), "base", "plain")


def compare(feats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similarity of the given pairs of a tenant's incidents (tenant_id, left, right) that share a feature."""
    own = feature_sets(feats)
    families = tuple(WEIGHTS)
    rows = pairs.select("tenant_id", "left", "right")
    for side in ("left", "right"):
        rows = rows.join(_side(own, side, families, "incident_id").withColumnRenamed(f"{side}_incident_id", side), ["tenant_id", side])
    rows = _judged(rows).where("similarity > 0")
    return rows.select("tenant_id", "left", "right", *(f"s_{f}" for f in WEIGHTS), "similarity", "status")


def recommend(costs: DataFrame, replays: DataFrame) -> DataFrame:
    """Incidents whose latest shadow cost run saves at least 5 % of bytes or series, with their latest replay.

    costs: tenant_id, incident_id, run_id, started_at, active_bytes, shadow_bytes, active_series, shadow_series.
    """
    last = costs.groupBy(*KEY).agg(F.max_by(F.struct("run_id", "active_bytes", "shadow_bytes", "active_series", "shadow_series"), F.struct("started_at", "run_id")).alias("c")).select(*KEY, "c.*")
    saved = lambda a, b: F.when(F.abs((F.col(a) - F.col(b)) / F.col(a) * 100) < 0.05, 0.0).otherwise(F.round((F.col(a) - F.col(b)) / F.col(a) * 100, 1))
    last = last.where("active_bytes > 0 and active_series > 0").withColumn("bytes_saved", saved("active_bytes", "shadow_bytes")).withColumn("series_saved", saved("active_series", "shadow_series"))
    runs = replays.groupBy(*KEY).agg(F.max_by(F.struct(F.col("run_id").alias("replay_id"), "quarantined"), F.struct("started_at", "run_id")).alias("r")).select(*KEY, "r.*")
    return last.where("bytes_saved >= 5 or series_saved >= 5").join(runs, KEY, "left").select(*KEY, "run_id", "bytes_saved", "series_saved", "replay_id", F.coalesce(F.col("quarantined") > 0, F.lit(False)).alias("review_quarantined"))
