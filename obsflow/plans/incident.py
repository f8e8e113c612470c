"""Queries of changes, incidents and the evidence graph."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsflow.functions import exprs as X
from obsflow.operators import changes as C
from obsflow.operators import evidence as E
from obsflow.operators import folds
from obsflow.operators.window_graph import Graph, event_facts
from obsflow.plans.basic import query
from obsflow.plans.views import CHANGE, ERR, HIGH, LAT, NORMAL, events
from obsflow.staging import stage

MK = f"""mk as (select tenant_id, 'CHG-'||event_id change_id, event_id, source,
 case when contains(event_type,'rollback') then 'rollback' else 'deployment' end kind, 'completed' status, tag_environment environment, tag_version as version, tag_rollback_of rollback_of, event_time changed_at, n from ev where {CHANGE})"""
BA = f"""ba as (select m.tenant_id, m.change_id, m.source change_source, e.source,
 count_if(e.event_time<m.changed_at) before_events, count_if(e.event_time>=m.changed_at) after_events,
 count_if(e.event_time<m.changed_at and {{ERR}}) before_errors, count_if(e.event_time>=m.changed_at and {{ERR}}) after_errors,
 coalesce(quantile_cont(case when e.event_time<m.changed_at and {{LAT}} then e.metric_value end,0.95),0) before_p95,
 coalesce(quantile_cont(case when e.event_time>=m.changed_at and {{LAT}} then e.metric_value end,0.95),0) after_p95
 from {{M}} m join ev e on e.tenant_id=m.tenant_id and e.event_time>=m.changed_at-interval 15 minute and e.event_time<m.changed_at+interval {{A}} minute group by all)"""
LAT_E = LAT.replace("metric_", "e.metric_").replace("event_type", "e.event_type")
ERR_E = ERR.replace("event_type", "e.event_type").replace("tag_severity", "e.tag_severity")


def ba(name: str, markers: str, minutes: int) -> str:
    body = BA.format(ERR=ERR_E, LAT=LAT_E, M=markers, A=minutes).replace("ba as", f"{name} as", 1)
    rates = f"{name}r as (select *, case when before_events>0 then before_errors/before_events else 0 end before_error_rate, case when after_events>0 then after_errors/after_events else 0 end after_error_rate from {name})"
    judged = f"""{name}a as (select *, after_error_rate-before_error_rate error_rate_delta, after_p95-before_p95 p95_delta, case when before_events<5 or after_events<5 then 'insufficient'
 when (before_p95>0 and after_p95-before_p95>=100 and after_p95>=before_p95*1.25) or (after_error_rate-before_error_rate>=0.05 and after_errors>=before_errors+2) then 'regressed'
 when (before_p95>0 and after_p95-before_p95<=-100 and after_p95<=before_p95*0.75) or (after_error_rate-before_error_rate<=-0.05 and before_errors>=after_errors+2) then 'improved' else 'unchanged' end assessment from {name}r)"""
    return f"{body}, {rates}, {judged}"


BLAST = """bl as (select *, case when assessable_sources>0 then regressed_sources/assessable_sources*100 else 0 end blast_radius_percent,
 case when primary_assessment='regressed' then 'regression-associated' when regressed_sources>0 and improved_sources>0 then 'mixed' when regressed_sources>0 then 'regression-observed'
 when primary_assessment='improved' then 'improvement-associated' when assessable_sources=0 then 'insufficient-evidence' else 'no-material-regression' end overall from (
 select tenant_id, change_id, count(*) observed_sources, count_if(assessment<>'insufficient') assessable_sources, count_if(assessment='regressed') regressed_sources, count_if(assessment='improved') improved_sources,
 max(case when source=change_source then assessment end) primary_assessment from baa group by all))"""
RB = """rb as (select tenant_id, change_id, change_source, rollback_id, rolled_at, named from (select m.tenant_id, m.change_id, m.source change_source, r.change_id rollback_id, r.changed_at rolled_at, coalesce(r.rollback_of=m.change_id,false) named,
 row_number() over (partition by m.tenant_id, m.change_id order by coalesce(r.rollback_of=m.change_id,false) desc, r.changed_at, r.change_id) k
 from mk m join mk r on m.tenant_id=r.tenant_id and r.kind='rollback' and r.changed_at>m.changed_at and r.changed_at<=m.changed_at+interval 2 hour and (coalesce(r.rollback_of=m.change_id,false) or r.source=m.source)) where k=1)"""


def markers(spark, sf_dir):
    return C.change_markers(events(spark, sf_dir))


@query(f"with {MK} select tenant_id, change_id, event_id, source, kind, status, environment, version, rollback_of, epoch_us(changed_at) changed_us, true as valid from mk")
def d18_change_markers(spark, sf_dir):
    return markers(spark, sf_dir).select("tenant_id", "change_id", "event_id", "source", "kind", "status", "environment", "version", "rollback_of", F.unix_micros("changed_at").alias("changed_us"), "valid")


@query(f"with {MK}, tw as (select tenant_id, 'G'||(n//200) change_id, * exclude (tenant_id, change_id) from mk) select tenant_id, change_id, min_by(event_id, changed_at) event_id, min_by(source, changed_at) source, max_by(kind, changed_at) kind, epoch_us(max(changed_at)) changed_us, max_by(rollback_of, changed_at) filter (rollback_of is not null) rollback_of from tw group by all")
def d19_merge_markers(spark, sf_dir):
    n = F.regexp_extract("event_id", "[0-9]+", 0).cast("long")
    rows = markers(spark, sf_dir).withColumn("change_id", F.concat(F.lit("G"), F.floor(n / 200).cast("string")))
    return C.merge_markers(rows).select("tenant_id", "change_id", "event_id", "source", "kind", F.unix_micros("changed_at").alias("changed_us"), "rollback_of")


IMPACT = ["tenant_id", "change_id", "source", "before_events", "after_events", "before_errors", "after_errors", "before_p95", "after_p95"]


@query(f"with {MK}, {ba('ba', 'mk', 15)} select {','.join(IMPACT)} from baa")
def j4_before_after(spark, sf_dir):
    return C.before_after(markers(spark, sf_dir), events(spark, sf_dir)).select(*IMPACT)


@query(f"with {MK}, {ba('ba', 'mk', 15)} select tenant_id, change_id, source, round(error_rate_delta,6) error_rate_delta, round(p95_delta,4) p95_delta, assessment from baa")
def d20_assess(spark, sf_dir):
    rows = C.assess(C.before_after(markers(spark, sf_dir), events(spark, sf_dir)))
    return rows.select("tenant_id", "change_id", "source", F.round("error_rate_delta", 6).alias("error_rate_delta"), F.round("p95_delta", 4).alias("p95_delta"), "assessment")


@query(f"with {MK}, {ba('ba', 'mk', 15)}, {BLAST} select tenant_id, change_id, observed_sources, assessable_sources, regressed_sources, improved_sources, primary_assessment, blast_radius_percent, overall from bl")
def a15_blast_radius(spark, sf_dir):
    return C.blast_radius(C.assess(C.before_after(markers(spark, sf_dir), events(spark, sf_dir))))


@query(f"with {MK}, {RB} select tenant_id, change_id, rollback_id, named from rb")
def j5_recovery_rollback(spark, sf_dir):
    return C.recovery_rollback(markers(spark, sf_dir)).select("tenant_id", "change_id", "rollback_id", "named")


@query(f"""with {MK}, {ba('ba', 'mk', 15)}, {BLAST}, {RB}, rm as (select tenant_id, change_id, change_source source, rolled_at changed_at from rb), {ba('ra', 'rm', 10)}
 select m.tenant_id, m.change_id, coalesce(overall,'insufficient-evidence') overall, coalesce(regressed_sources,0) regressed_sources, coalesce(blast_radius_percent,0) blast_radius_percent, rollback_id,
 coalesce(a.assessment='improved' or (a.after_error_rate<0.05 and (a.after_p95=0 or a.after_p95<500)),false) recovered
 from mk m left join bl using (tenant_id, change_id) left join rb using (tenant_id, change_id) left join raa a on a.tenant_id=m.tenant_id and a.change_id=m.change_id and a.source=a.change_source""")
def d21_analyze_changes(spark, sf_dir):
    return C.analyze_changes(markers(spark, sf_dir), events(spark, sf_dir)).select("tenant_id", "change_id", "overall", "regressed_sources", "blast_radius_percent", "rollback_id", "recovered")


CAND = f"""cand as (select *, case when {HIGH} then 'latency' else 'errors' end category from (select *, count(case when {ERR} and not {HIGH} then 1 end) over (partition by tenant_id,source order by epoch_us(event_time) range between 59999999 preceding and current row) recent from ev) where {HIGH} or ({ERR} and recent>=5)),
 walk as (select tenant_id, source, category, min(epoch_us(event_time)) us from cand group by all union all
  select w.tenant_id, w.source, w.category, (select min(epoch_us(c.event_time)) from cand c where c.tenant_id=w.tenant_id and c.source=w.source and c.category=w.category and epoch_us(c.event_time)>=w.us+600000000) from walk w where w.us is not null),
 inc as (select c.tenant_id, 'AUTO-'||epoch_ms(c.event_time)||'-'||c.source||'-'||c.category incident_id, c.source, c.category, c.event_id, c.event_time frozen_to, c.event_time-interval 15 minute frozen_from,
  case when c.category='latency' then printf('latency threshold breached: %.1fms >= %.1fms', c.metric_value, 1000.0) else printf('error threshold breached: %d errors within 1m0s', c.recent) end reason
  from walk w join cand c on w.us=epoch_us(c.event_time) and w.tenant_id=c.tenant_id and w.source=c.source and w.category=c.category)"""
FZ = "fz as (select i.incident_id, e.* from inc i join ev e on e.tenant_id=i.tenant_id and e.event_time between i.frozen_from and i.frozen_to)"


def incidents(spark, sf_dir):
    return E.detect_incidents(events(spark, sf_dir))


def captured(spark, sf_dir):
    """The incidents, which are made once, and the events that their windows take."""
    return stage(incidents(spark, sf_dir), "incidents"), events(spark, sf_dir).withColumn("captured_at", F.col("event_time"))


def frozen(spark, sf_dir):
    """Frozen events of all incidents, and the incidents, which are made once."""
    inc, captures = captured(spark, sf_dir)
    return E.freeze(inc, captures), inc


@query(f"with {CAND} select tenant_id, incident_id, source, category, event_id, reason, epoch_us(frozen_from) from_us, epoch_us(frozen_to) to_us from inc")
def d15_detect_incidents(spark, sf_dir):
    return incidents(spark, sf_dir).select("tenant_id", "incident_id", "source", "category", "event_id", "reason", F.unix_micros("frozen_from").alias("from_us"), F.unix_micros("frozen_to").alias("to_us"))


@query(f"""with {CAND}, thr as (select tenant_id, source, min(n) n from ev where {ERR} group by all union all select t.tenant_id, t.source, (select min(e.n) from ev e where e.tenant_id=t.tenant_id and e.source=t.source and contains(e.event_type,'error') and e.n*720000>=t.n*720000+60000000) from thr t where t.n is not null)
 select tenant_id, source, 'evt-'||n event_id from thr where n is not null""")
def d4_throttle(spark, sf_dir):
    rows = events(spark, sf_dir).where(X.is_error()).select("tenant_id", "source", "event_time", "event_id")
    return folds.throttle(rows, ["tenant_id", "source"]).select("tenant_id", "source", "event_id")


@query(f"with {CAND}, {FZ} select tenant_id, incident_id, count(*) events, min(n) first_n, max(n) last_n from fz group by all")
def j1_freeze(spark, sf_dir):
    return frozen(spark, sf_dir)[0].groupBy("tenant_id", "incident_id").agg(F.count(F.lit(1)).alias("events"), F.min("n").alias("first_n"), F.max("n").alias("last_n"))


@query(f"with {CAND}, {FZ} select tenant_id, incident_id, count(distinct fz.event_id) events from inc left join fz using (tenant_id, incident_id) group by all")
def j2_incident_counts(spark, sf_dir):
    fz, inc = frozen(spark, sf_dir)
    return E.incident_counts(inc, fz).select("tenant_id", "incident_id", "events")


@query(f"with {CAND}, {FZ} select tenant_id, incident_id, coalesce(count(distinct fz.event_id),0) events from inc left join fz using (tenant_id, incident_id) group by all")
def j2_incident_counts_all(spark, sf_dir):
    return j2_incident_counts(spark, sf_dir)


NEAR = "nr as (select s.incident_id, m.* from (select tenant_id, incident_id, min(event_time) a, max(event_time) b from fz group by all) s join mk m on m.tenant_id=s.tenant_id and m.changed_at between s.a-interval 15 minute and s.b+interval 5 minute)"


def near_markers(spark, sf_dir, fz):
    spans = fz.groupBy("tenant_id", "incident_id").agg(F.min("event_time").alias("first_at"), F.max("event_time").alias("last_at"))
    return C.changes_near(spans, markers(spark, sf_dir))


@query(f"with {CAND}, {FZ}, {MK}, {NEAR} select tenant_id, incident_id, change_id from nr")
def j3_changes_near(spark, sf_dir):
    return near_markers(spark, sf_dir, frozen(spark, sf_dir)[0]).select("tenant_id", "incident_id", "change_id")


def _lag(cols: str, extra: str = "true", where: str = "true") -> str:
    return f"select tenant_id, incident_id, 'event:'||p \"from\", 'event:'||event_id \"to\" from (select *, lag(event_id) over w p, lag(event_time) over w pt from fz where {where} window w as (partition by tenant_id, incident_id, {cols} order by event_time, event_id)) where p is not null and {extra}"


def _first(start: str, wanted: str, seconds: int) -> str:
    return f"select tenant_id, incident_id, 'event:'||event_id \"from\", 'event:'||nx.e \"to\" from (select *, min(case when {wanted} then {{'t': event_time, 'e': event_id}} end) over (partition by tenant_id, incident_id, source order by event_time, event_id rows between 1 following and unbounded following) nx from fz) where {start} and nx.t<=event_time+to_seconds({seconds})"


def _every() -> str:
    c, e = CHANGE.replace("event_type", "c.event_type").replace("tag_", "c.tag_"), ERR_E
    return f"select c.tenant_id, c.incident_id, 'event:'||c.event_id \"from\", 'event:'||e.event_id \"to\" from fz c join fz e on c.tenant_id=e.tenant_id and c.incident_id=e.incident_id and c.source=e.source where {c} and {e} and e.event_time<=c.event_time+interval 5 minute and (e.event_time>c.event_time or (e.event_time=c.event_time and e.event_id>c.event_id))"


MN = "mn as (select nr.*, case when f.event_id is not null then 'event:'||nr.event_id else 'change:'||nr.change_id end node, f.event_id is null own from nr left join fz f on f.tenant_id=nr.tenant_id and f.incident_id=nr.incident_id and f.event_id=nr.event_id)"
MARKED = f"select m.tenant_id, m.incident_id, node \"from\", 'event:'||e.event_id \"to\" from mn m join fz e on e.tenant_id=m.tenant_id and e.incident_id=m.incident_id and e.source=m.source where {ERR_E} and e.event_time between m.changed_at and m.changed_at+interval 10 minute"
NORMAL_E = NORMAL.replace("metric_", "e.metric_").replace("event_type", "e.event_type")
ROLLED = f"select m.tenant_id, m.incident_id, node \"from\", 'event:'||arg_min(e.event_id, e.event_time) \"to\" from mn m join fz e on e.tenant_id=m.tenant_id and e.incident_id=m.incident_id and e.source=m.source where m.kind='rollback' and m.rollback_of is not null and {NORMAL_E} and e.event_time between m.changed_at and m.changed_at+interval 10 minute group by m.tenant_id, m.incident_id, node"
EXPLICIT = "select a.tenant_id, a.incident_id, a.node \"from\", b.node \"to\" from mn a join mn b on a.tenant_id=b.tenant_id and a.incident_id=b.incident_id and b.rollback_of=a.change_id where b.kind='rollback'"
BASE = f"with {CAND}, {FZ}"
PARTS = {
    "shared-correlation": (_lag("correlation_id"), "supporting"), "shared-trace": (_lag("tag_trace_id"), "supporting"),
    "same-source-sequence": (_lag("source", "event_time<=pt+interval 30 second"), "related"), "latency-precedes-error": (_first(HIGH, ERR, 60), "supporting"),
    "recovery-signal": (_first(ERR, NORMAL, 120), "contradicting"), "change-precedes-error": (_every(), "supporting"),
    "structured-change-precedes-error": (MARKED, "supporting"), "explicit-rollback-of": (EXPLICIT, "related"), "recovery-after-rollback": (ROLLED, "contradicting"),
    "change-near-incident": ("select tenant_id, incident_id, 'incident:'||incident_id \"from\", node \"to\" from mn where own", "related"),
}
EDGE = ["tenant_id", "incident_id", "from", "to"]


def _link(name: str, relation: str, make):
    def run(spark, sf_dir):
        return make(frozen(spark, sf_dir)[0]).select(*EDGE)

    run.__name__ = name
    query(f"{BASE} {PARTS[relation][0]}")(run)


_link("w4_link_correlation", "shared-correlation", E.link_correlation)
_link("w5_link_trace", "shared-trace", E.link_trace)
_link("w6_source_sequence", "same-source-sequence", E.link_source_sequence)
_link("w7_latency_then_error", "latency-precedes-error", E.latency_then_error)
_link("w8_error_then_recovery", "recovery-signal", E.error_then_recovery)
_link("j6_change_precedes_error", "change-precedes-error", E.change_precedes_error)
MBASE = f"{BASE}, {MK}, {NEAR}, {MN}"


def nodes_of(spark, sf_dir):
    fz = frozen(spark, sf_dir)[0]
    return E.marker_nodes(near_markers(spark, sf_dir, fz), fz), fz


@query(f"{MBASE} {MARKED}")
def j7_marker_precedes_error(spark, sf_dir):
    return E.marker_precedes_error(*nodes_of(spark, sf_dir)).select(*EDGE)


@query(f"{MBASE} {ROLLED}")
def j8_recovery_after_rollback(spark, sf_dir):
    return E.recovery_after_rollback(*nodes_of(spark, sf_dir)).select(*EDGE)


@query(f"{MBASE} {EXPLICIT}")
def j9_explicit_rollback(spark, sf_dir):
    return E.explicit_rollback(nodes_of(spark, sf_dir)[0]).select(*EDGE)


_RANK = "case relation " + " ".join(f"when '{r}' then {i + 1}" for i, r in enumerate(E.ORDER)) + " else 0 end"
EG = "eg as (" + " union all ".join(f"select tenant_id, incident_id, \"from\", \"to\", '{r}' relation, '{a}' assessment from ({sql})" for r, (sql, a) in PARTS.items()) + """),
 ed as (select tenant_id, incident_id, "from", "to", relation, assessment from (select *, row_number() over (partition by tenant_id, incident_id order by RANK, relation, "from", "to") k from (select distinct * from eg)) where k<=CAP union all select tenant_id, incident_id, 'incident:'||incident_id, 'event:'||event_id, 'captured-in', 'related' from fz),
 nd as (select tenant_id, incident_id, 'incident:'||incident_id id, 'incident' kind, null source, null event_type, null as version, incident_id as "label", null::bigint event_us, '' attributes from inc union all
  select tenant_id, incident_id, 'event:'||event_id, case when CHANGE then 'change' when ERR then 'error' when HIGH then 'latency' else 'event' end, source, event_type, tag_version, source||' · '||event_type, epoch_us(event_time), coalesce('version='||tag_version,'') from fz union all
  select tenant_id, incident_id, node, 'change', source, kind, version, source||' · '||kind, epoch_us(changed_at), concat_ws(',','change_id='||change_id,'environment='||environment,'kind='||kind,'rollback_of='||rollback_of,'version='||version) from mn where own)""".replace("RANK", _RANK).replace("CHANGE", CHANGE).replace("ERR", ERR).replace("HIGH", HIGH)
GBASE = f"{MBASE}, " + EG.replace("CAP", "2000")
#: Without a cap: what counts are taken from.
GFULL = f"{MBASE}, " + EG.replace("CAP", "1000000000")
REASONS = "rs(relation, reason) as (values " + ", ".join(f"('{r}', '{reason}')" for r, (_, reason) in E.RELATIONS.items()) + ")"


def graph(spark, sf_dir, only=None):
    """The evidence graph; events are captured at their own time."""
    inc = stage(incidents(spark, sf_dir), "incidents")
    return Graph(inc, event_facts(events(spark, sf_dir)), markers(spark, sf_dir), only)


@query(f"{GBASE}, {REASONS} select tenant_id, incident_id, \"from\", \"to\", relation, assessment, reason from ed join rs using (relation)")
def d22_evidence_edges(spark, sf_dir):
    return graph(spark, sf_dir).edges(2000).select(*EDGE, "relation", "assessment", "reason")


@query(f"{GBASE} select tenant_id, incident_id, id, kind, \"label\", source, event_type, version, event_us, attributes from nd")
def d22_evidence_nodes(spark, sf_dir):
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return graph(spark, sf_dir).nodes().select("tenant_id", "incident_id", "id", "kind", "label", "source", "event_type", "version", F.unix_micros("event_time").alias("event_us"), shown.alias("attributes"))


@query(f"{MBASE}, {EG.replace('CAP', '100')} select tenant_id, incident_id, relation, count(*) n from ed group by all")
def t7_cap_edges(spark, sf_dir):
    """What the cap leaves of each relation, told by the counts: edges are there once and admitted by relation."""
    return graph(spark, sf_dir).counts(100).where("kept > 0").select("tenant_id", "incident_id", "relation", F.col("kept").alias("n"))


@query(f"{GFULL} select tenant_id, incident_id, nodes, edges, supporting, contradicting, related from (select tenant_id, incident_id, count(*) nodes from nd group by all) join (select tenant_id, incident_id, count(*) edges, count_if(assessment='supporting') supporting, count_if(assessment='contradicting') contradicting, count_if(assessment='related') related from ed group by all) using (tenant_id, incident_id)")
def a17_graph_summary(spark, sf_dir):
    return E.graph_summary((g := graph(spark, sf_dir)).nodes(), g.edges()).select("tenant_id", "incident_id", "nodes", "edges", "supporting", "contradicting", "related")


HY = """hc as (select tenant_id, incident_id, count_if(relation in ('change-precedes-error','structured-change-precedes-error')) c, count_if(relation='latency-precedes-error') l, count_if(relation in ('recovery-signal','recovery-after-rollback')) r from ed group by all),
 hy as (select *, case when supporting>0 and contradicting>0 then 'mixed' when supporting>0 then 'supported' when contradicting>0 then 'contradicted' else 'insufficient' end status from (
  select tenant_id, incident_id, 'recent-change-associated' hypothesis, c supporting, 0 contradicting from hc where c>0 union all select tenant_id, incident_id, 'latency-before-errors', l, 0 from hc where l>0
  union all select tenant_id, incident_id, 'sustained-degradation', l, r from hc where l+r>0 union all select tenant_id, incident_id, 'insufficient-evidence', 0, 0 from hc where c+l+r=0))"""


@query(f"{GFULL}, {HY} select tenant_id, incident_id, hypothesis, supporting, contradicting, status from hy")
def a18_hypotheses(spark, sf_dir):
    return E.hypotheses((g := graph(spark, sf_dir, E.TOLD)).nodes(), g.edges())


@query(f"""{GFULL}, {HY}, rl as (select * from (values {','.join(f"('{h}','{r}')" for h, rs in E.HYPOTHESES.items() for r in rs)}) t(finding, relation)),
 fi as (select tenant_id, incident_id, finding, count_if(assessment='supporting') support, count_if(assessment='contradicting') contradiction from ed join rl using (relation) join hy on hy.tenant_id=ed.tenant_id and hy.incident_id=ed.incident_id and hy.hypothesis=finding group by ed.tenant_id, ed.incident_id, finding)
 select tenant_id, incident_id, finding, support, contradiction, case when support=0 then 'insufficient' when contradiction>0 then 'mixed' else 'supported' end status,
 case when support=0 then 'insufficient' when contradiction>0 then 'mixed' when support>=4 then 'high' when support>=2 then 'medium' else 'low' end confidence,
 support*10-contradiction*4+case when support=0 or contradiction>0 then 0 when support>=4 then 3 when support>=2 then 2 else 1 end score from fi""".replace("ed.tenant_id, ed.incident_id, finding, count", "ed.tenant_id, ed.incident_id, finding, count").replace("fi as (select tenant_id, incident_id,", "fi as (select ed.tenant_id, ed.incident_id,"))
def d23_investigate(spark, sf_dir):
    return E.investigate(graph(spark, sf_dir, E.TOLD).edges()).select("tenant_id", "incident_id", "finding", "support", "contradiction", "status", "confidence", "score")


FT = """ft as (select distinct * from (select tenant_id, incident_id, 'source' family, source feature from nd where source is not null union all select tenant_id, incident_id, 'type', event_type from nd where event_type is not null
  union all select tenant_id, incident_id, 'hypothesis', hypothesis from hy where status<>'insufficient' union all select tenant_id, incident_id, 'change', 'version:'||version from nd where kind='change' and version is not null)),
 se as (select *, min(incident_id) over (partition by tenant_id, k) sid from (select tenant_id, incident_id, string_agg(family||':'||feature, '|' order by family, feature) k from ft group by all)),
 fs as (select tenant_id, incident_id, family, count(*) n from ft group by all),
 sh as (select a.tenant_id, a.incident_id l, b.incident_id r, family, count(*) s from ft a join ft b using (tenant_id, family, feature) where a.incident_id<b.incident_id group by all),
 sj as (select sh.tenant_id, sh.l, sh.r, sum(s/(a.n+b.n-s)*case sh.family when 'source' then 0.30 when 'type' then 0.25 when 'hypothesis' then 0.35 else 0.10 end) v from sh join fs a on a.tenant_id=sh.tenant_id and a.incident_id=sh.l and a.family=sh.family join fs b on b.tenant_id=sh.tenant_id and b.incident_id=sh.r and b.family=sh.family group by all),
 si as (select tenant_id, l as "left", r as "right", round(round(v,9),3) similarity from sj),
 sr as (select *, case when similarity>=0.7 then 'strong_overlap' when similarity>=0.4 then 'partial_overlap' else 'limited_overlap' end status from si where similarity>0),
 sl as (select sr.* from sr join se a on a.tenant_id=sr.tenant_id and a.incident_id="left" join se b on b.tenant_id=sr.tenant_id and b.incident_id="right" where a.sid=a.incident_id and b.sid=b.incident_id)"""


def feature_sets(spark, sf_dir):
    g = graph(spark, sf_dir, E.TOLD)
    nodes, edges = g.nodes(), g.edges()
    return E.feature_sets(E.features(nodes, E.hypotheses(nodes, edges)))


@query(f"{GFULL}, {HY}, {FT} select tenant_id, \"left\", \"right\", similarity, status from sl")
def d25_compare(spark, sf_dir):
    """Links between the different feature sets of a tenant's incidents; ``d25_feature_sets`` has who belongs to each."""
    return E.similar_sets(feature_sets(spark, sf_dir)).select("tenant_id", "left", "right", "similarity", "status")


@query(f"{GFULL}, {HY}, {FT} select tenant_id, \"left\", \"right\", similarity, status from sl where similarity>=0.7")
def d25_strong_overlap(spark, sf_dir):
    return E.similar_sets(feature_sets(spark, sf_dir), 0.7).select("tenant_id", "left", "right", "similarity", "status")


@query(f"{GFULL}, {HY}, {FT} select tenant_id, incident_id, sid as \"set\" from se")
def d25_feature_sets(spark, sf_dir):
    return feature_sets(spark, sf_dir).select("tenant_id", "incident_id", "set")


@query(f"{GFULL}, {HY}, {FT} select p.tenant_id, p.l as \"left\", p.r as \"right\", similarity, status from (select tenant_id, incident_id l, lead(incident_id) over (partition by tenant_id order by incident_id) r from inc) p join sr on sr.tenant_id=p.tenant_id and sr.\"left\"=p.l and sr.\"right\"=p.r")
def d25_compare_pairs(spark, sf_dir):
    """Every incident with the next one of its tenant."""
    g = graph(spark, sf_dir, E.TOLD)
    nodes, edges = g.nodes(), g.edges()
    own = g.incidents.select("tenant_id", F.col("incident_id").alias("left"))
    pairs = own.withColumn("right", F.lead("left").over(W.partitionBy("tenant_id").orderBy("left"))).where("right is not null")
    return E.compare(E.features(nodes, E.hypotheses(nodes, edges)), pairs).select("tenant_id", "left", "right", "similarity", "status")
