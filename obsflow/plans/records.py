"""Queries of schemas, replay, cost, lineage, sources and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsflow.functions import exprs as X
from obsflow.operators import evidence as E
from obsflow.operators import lineage as L
from obsflow.operators import replay as P
from obsflow.operators import schemas as S
from obsflow.plans.basic import POLICY, SHADOW, query
from obsflow.plans.control import ACT, RUN
from obsflow.operators.window_graph import Graph, event_facts
from obsflow.plans.incident import CAND, EDGE, FZ, GBASE, GFULL, MK, NEAR, captured, frozen, markers
from obsflow.plans.views import ERR, TAGS, events
from obsflow.sources import export, ingest
from obsflow.staging import stage

VERSION = ["tenant_id", "source", "event_type", "schema_version"]
#: DuckDB: fields of the view's events; its payloads are flat objects.
FLD = """fl as (select tenant_id,source,event_type,schema_version,event_id,event_time,n,'metric.value' path,'number' typ from ev where metric_value is not null union all select tenant_id,source,event_type,schema_version,event_id,event_time,n,'metric.unit','string' from ev where metric_unit is not null
 union all select e.tenant_id,e.source,e.event_type,e.schema_version,e.event_id,e.event_time,e.n,'tags.'||t.k,'string' from ev e join tg t using (event_id) union all select tenant_id,source,event_type,schema_version,event_id,event_time,n,'payload','object' from ev
 union all select tenant_id,source,event_type,schema_version,event_id,event_time,n,'payload.k', case json_type(payload,'$.k') when 'VARCHAR' then 'string' else 'number' end from ev where json_type(payload,'$.k') is not null),
 nb as (select event_id eid, row_number() over (partition by tenant_id,source,event_type,schema_version order by event_time,event_id) ono from ev), ft as (select * from ev),
 fn as (select fl.*, ono from fl join nb on eid=event_id),
 fk as (select *, first_value(typ) over w ftyp, row_number() over w kk, lead(ono) over w nx from fn window w as (partition by tenant_id,source,event_type,schema_version,path order by ono)),
 tt as (select tenant_id,source,event_type,schema_version,count(*) total from ev group by all),
 rg as (select tenant_id,source,event_type,schema_version,path,arg_min(typ,ono) typ,count(*) seen,count_if(typ<>ftyp) conflicts,any_value(total) observations, any_value(total)>=20 and count(*)*100>=any_value(total)*95 required, min(event_time) first_seen, max(event_time) last_seen from fk join tt using (tenant_id,source,event_type,schema_version) group by tenant_id,source,event_type,schema_version,path)"""


def described(spark, sf_dir):
    return S.describe(events(spark, sf_dir))


@query(f"with {FLD} select event_id, sha256(string_agg(path||':'||typ, chr(10) order by path||':'||typ)) fingerprint, count(*) fields from fl group by event_id")
def d27_fingerprint(spark, sf_dir):
    return described(spark, sf_dir).select("event_id", "fingerprint", F.size("fields").alias("fields"))


@query(f"with {FLD} select event_id, path, typ as type from fl")
def d26_describe(spark, sf_dir):
    # Outer, as below; events without fields are left out after it.
    return described(spark, sf_dir).select("event_id", F.explode_outer("fields").alias("f")).where("f is not null").select("event_id", "f.path", "f.type")


@query(f"with {FLD} select path, typ as type, count(*) n from (select * replace (case path when 'tags.environment' then 'tags.deployment.environment' when 'payload.k' then 'payload.server.address' else path end as path) from fl) where path='tags.deployment.environment' or (path='payload.server.address' and typ<>'string') group by all")
def d28_semantic_findings(spark, sf_dir):
    # Events have few different sets of fields, which are counted before they are laid out.
    sets = described(spark, sf_dir).groupBy("fields").agg(F.count(F.lit(1)).alias("events"))
    # Outer, since Spark filters before a plain explode, and would describe every event several times for that.
    rows = sets.select("events", F.explode_outer("fields").alias("f")).select("events", "f.path", "f.type")
    path = F.when(F.col("path") == "tags.environment", "tags.deployment.environment").when(F.col("path") == "payload.k", "payload.server.address").otherwise(F.col("path"))
    return S.semantic_findings(rows.withColumn("path", path)).groupBy("path", "type").agg(F.sum("events").alias("n"))


@query(f"with {FLD} select tenant_id,source,event_type,schema_version,path,typ as type,seen,conflicts,observations,required,epoch_us(first_seen) first_us,epoch_us(last_seen) last_us from rg")
def a13_schema_registry(spark, sf_dir):
    return S.schema_registry(described(spark, sf_dir)).select(*VERSION, "path", "type", "seen", "conflicts", "observations", "required", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


@query(f"with {FLD} select tenant_id,source,event_type,schema_version,path,ono obs_no from fk where kk=1 and ono>1")
def w9_fields_added(spark, sf_dir):
    return S.fields_added(described(spark, sf_dir)).select(*VERSION, "path", "obs_no")


@query(f"with {FLD} select tenant_id,source,event_type,schema_version,path,ftyp previous_type,typ as type,ono obs_no from fk where typ<>ftyp")
def w10_type_conflicts(spark, sf_dir):
    return S.type_conflicts(described(spark, sf_dir)).select(*VERSION, "path", "previous_type", "type", "obs_no")


MISS = "ms as (select p.tenant_id,p.source,p.event_type,p.schema_version,p.path,count(*) occurrences,max(o.ono) last_obs from (select distinct tenant_id,source,event_type,schema_version,path from fk) p join (select tenant_id,source,event_type,schema_version,ono from ev join nb on eid=event_id) o using (tenant_id,source,event_type,schema_version) left join fk f on f.tenant_id=p.tenant_id and f.source=p.source and f.event_type=p.event_type and f.schema_version=p.schema_version and f.path=p.path and f.ono=o.ono where f.path is null and o.ono>20 and (select count(*) from fk g where g.tenant_id=p.tenant_id and g.source=p.source and g.event_type=p.event_type and g.schema_version=p.schema_version and g.path=p.path and g.ono<o.ono)*100>=(o.ono-1)*95 group by all)"


@query(f"with {FLD}, {MISS} select tenant_id,source,event_type,schema_version,path,occurrences,last_obs from ms")
def w11_required_missing(spark, sf_dir):
    return S.required_missing(described(spark, sf_dir)).select(*VERSION, "path", "occurrences", "last_obs")


@query("select event_id, pu previous_url, u schema_url from (select *, last_value(u ignore nulls) over (partition by tenant_id,source,event_type,schema_version order by event_time,event_id rows between unbounded preceding and 1 preceding) pu from (select *, case when n%3<>0 then 'https://s/'||(n//200) end u from ev)) where u is not null and pu is not null and u<>pu")
def w12_schema_url_changes(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("schema_url", F.when(F.col("n") % 3 != 0, F.concat(F.lit("https://s/"), F.floor(F.col("n") / 200).cast("string"))))
    return S.schema_url_changes(rows).select("event_id", "previous_url", "schema_url")


DRIFT = f"{FLD}, {MISS}, dr as (select tenant_id,source,event_type,schema_version,'field_added' kind,path,'info' severity,typ as type,count(*) occurrences from fk where kk=1 and ono>1 group by all union all select tenant_id,source,event_type,schema_version,'type_changed',path,'breaking',ftyp||'>'||typ,count(*) from fk where typ<>ftyp group by all union all select tenant_id,source,event_type,schema_version,'required_field_missing',path,'breaking','',occurrences from ms)"


@query(f"with {DRIFT} select *, sha256(concat_ws('|',tenant_id,source,event_type,schema_version,kind,path,type)) signature from dr")
def a14_schema_drifts(spark, sf_dir):
    return S.schema_drifts(described(spark, sf_dir)).select(*VERSION, "kind", "path", "severity", "type", "occurrences", "signature")


@query(f"with {DRIFT} select tenant_id,source,event_type,schema_version, case when bool_or(severity='breaking') then 'breaking' else 'healthy' end health from dr group by all")
def d29_schema_health(spark, sf_dir):
    return S.schema_health(S.schema_drifts(described(spark, sf_dir)))


@query(f"""with {FLD}, a as (select * from rg where schema_version='1.0'), b as (select * from rg where schema_version='2.0'), bo as (select distinct a.tenant_id,a.source,a.event_type from a join b using (tenant_id,source,event_type)),
 df as (select coalesce(a.tenant_id,b.tenant_id) tenant_id, coalesce(a.source,b.source) source, coalesce(a.event_type,b.event_type) event_type, coalesce(a.path,b.path) path, case when b.path is null then 'field_removed' when a.path is null then 'field_added' when a.typ<>b.typ then 'type_changed' end kind, a.required from a full join b on a.tenant_id=b.tenant_id and a.source=b.source and a.event_type=b.event_type and a.path=b.path),
 dg as (select df.*, case kind when 'field_removed' then case when required then 'breaking' else 'warning' end when 'type_changed' then 'breaking' when 'field_added' then 'info' end severity from df join bo using (tenant_id,source,event_type))
 select tenant_id,source,event_type,path,kind,severity,compatibility from (select *, case when bool_or(severity='breaking') over w then 'breaking' when bool_or(severity='warning') over w then 'review' else 'compatible' end compatibility from dg window w as (partition by tenant_id,source,event_type)) where kind is not null""")
def j11_schema_diff(spark, sf_dir):
    return S.schema_diff(S.schema_registry(described(spark, sf_dir)), "1.0", "2.0").select("tenant_id", "source", "event_type", "path", "kind", "severity", "compatibility")


@query("with f as (select tenant_id,source,event_type,schema_version,min(n) f from ev group by all) select f.tenant_id,f.source,f.event_type,f.schema_version,(select arg_max(e.schema_version,e.n) from ev e where e.tenant_id=f.tenant_id and e.source=f.source and e.event_type=f.event_type and e.n<f.f) previous from f")
def j12_previous_version(spark, sf_dir):
    return S.previous_version(events(spark, sf_dir))


@query("select tenant_id,source,event_type,arg_max(schema_version,n) schema_version from ev group by all")
def w14_newest_version(spark, sf_dir):
    return S.newest_version(S.schema_registry(described(spark, sf_dir))).select("tenant_id", "source", "event_type", "schema_version")


#: DuckDB: the running counts of frozen events, each incident apart, and what both policies decide of them.
SCOPED = f"""{CAND}, {FZ}, {RUN[RUN.index('hs as'):].replace('from tr)', 'from tr)')}"""
SCOPED = SCOPED.replace("hs as", "tr as (select f.tenant_id||chr(31)||f.incident_id tenant_id, f.source, f.event_type, f.event_id, f.event_time, f.n, t.k, t.v, date_trunc('hour', f.event_time) hr from fz f join tg t using (event_id)), hs as", 1)
SCOPED += f""", {ACT.replace('dc as (', 'dc as materialized (')},
 ds as materialized (select *, case when observed>=threshold or projected>=threshold then act when dangerous and observed>=greatest(3,threshold//10) then 'allow' end decided from (select *, case when k='request_id' then 25 when k='user_id' then 30 else 40 end threshold, case when k in ('request_id','user_id') then 'drop_tag' else 'allow' end act, k in ('user_id','request_id') dangerous from pj))"""
THROTTLED = """fnd as materialized (select tenant_id, source, event_type, k, decided, event_id, epoch_us(event_time) us from dc where decided is not null),
 wk as (select tenant_id, source, event_type, k, decided, min(us) us from fnd group by all union all select w.tenant_id, w.source, w.event_type, w.k, w.decided, (select min(c.us) from fnd c where c.tenant_id=w.tenant_id and c.source=w.source and c.event_type=w.event_type and c.k=w.k and c.decided=w.decided and c.us>=w.us+60000000) from wk w where w.us is not null)"""
REPLAYED = f"""{SCOPED}, {THROTTLED},
 rf as (select tenant_id, event_id, count(*) findings from fnd join wk using (tenant_id, source, event_type, k, decided, us) group by all),
 rd as (select tenant_id, event_id, count_if(decided in ('drop_tag','quarantine')) dropped, coalesce(bool_or(decided='quarantine'),false) quarantined from dc group by all),
 rs as (select tenant_id, event_id, count(*) shadow_diffs from (select *, coalesce(decided,'allow') a, case when observed>=st or projected>=st then sa else 'allow' end b from (select *, case when k='request_id' then 25 when k='user_id' then 30 else 40 end st, case when k in ('request_id','user_id') then 'drop_tag' else 'allow' end sa from dc)) where a<>b group by all),
 rp as (select f.tenant_id, f.incident_id, f.event_id, coalesce(dropped,0)>0 or coalesce(quarantined,false) changed, coalesce(dropped,0) dropped, coalesce(quarantined,false) quarantined, coalesce(findings,0) findings, coalesce(shadow_diffs,0) shadow_diffs
  from fz f left join rd on rd.tenant_id=f.tenant_id||chr(31)||f.incident_id and rd.event_id=f.event_id left join rf on rf.tenant_id=f.tenant_id||chr(31)||f.incident_id and rf.event_id=f.event_id left join rs on rs.tenant_id=f.tenant_id||chr(31)||f.incident_id and rs.event_id=f.event_id)"""
TOTALS = "select tenant_id, incident_id, count(*) events, count_if(changed) changed, cast(sum(dropped) as bigint) dropped, count_if(quarantined) quarantined, cast(sum(findings) as bigint) findings, cast(sum(shadow_diffs) as bigint) shadow_diffs from rp group by all"


@query(f"with {REPLAYED} select * from rp")
def d16_replay(spark, sf_dir):
    return P.replay_incidents(*captured(spark, sf_dir), POLICY, SHADOW)


@query(f"with {REPLAYED} {TOTALS}")
def a12_replay_totals(spark, sf_dir):
    return P.replay_incident_totals(*captured(spark, sf_dir), POLICY, SHADOW)


def _profile_sql(name: str, tags: str) -> str:
    """DuckDB: bytes and series of each incident with the tags of a table (scope, event_id, k, v)."""
    return f"""p{name} as (select scope, sum(octet_length(encode('event_id='||event_id||chr(10)||'tenant_id='||tenant_id||chr(10)||'source='||source||chr(10)||'event_type='||event_type||chr(10)||'event_time='||epoch_us(event_time)||chr(10)||coalesce(ts,'')
  ||coalesce('payload='||payload||chr(10),'')||coalesce('metric_value='||cast(cast(metric_value as decimal(28,6)) as varchar)||chr(10),'')||coalesce('metric_unit='||metric_unit||chr(10),'')||'schema_version='||schema_version||chr(10)||'correlation_id='||correlation_id||chr(10)))) {name}_bytes,
  count(distinct source||'|'||event_type||coalesce(ss,'')) {name}_series from (select f.*, f.tenant_id||chr(31)||f.incident_id scope, g.ts, g.ss from fz f left join (select scope, event_id, string_agg('tag.'||k||'='||v||chr(10),'' order by k) ts, string_agg('|'||k||'='||v,'' order by k) filter (not starts_with(k,'ctl.')) ss from {tags} group by all) g on g.scope=f.tenant_id||chr(31)||f.incident_id and g.event_id=f.event_id) group by scope)"""


COSTS = f"""{SCOPED},
 t0 as (select tenant_id scope, event_id, k, v from dc),
 held as (select tenant_id scope, event_id, string_agg(k, ',' order by k) dims from dc where decided='quarantine' group by all),
 ta as (select tenant_id scope, event_id, k, v from dc where decided is null or decided not in ('drop_tag','quarantine') union all select scope, event_id, 'ctl.quarantined', 'true' from held union all select scope, event_id, 'ctl.quarantine_dimensions', dims from held),
 tb as (select tenant_id scope, event_id, k, v from ds where decided is null or decided <> 'drop_tag'),
 {_profile_sql('baseline', 't0')}, {_profile_sql('active', 'ta')}, {_profile_sql('shadow', 'tb')},
 cs as (select f.tenant_id, f.incident_id, f.events, f.window_seconds, cast(baseline_bytes as bigint) baseline_bytes, baseline_series, cast(active_bytes as bigint) active_bytes, active_series, coalesce(ca,0) active_changed, cast(shadow_bytes as bigint) shadow_bytes, shadow_series, coalesce(cb,0) shadow_changed
  from (select tenant_id, incident_id, tenant_id||chr(31)||incident_id scope, count(*) events, greatest((epoch_us(max(event_time))-epoch_us(min(event_time)))/1e6,1) window_seconds from fz group by all) f join pbaseline using (scope) join pactive using (scope) join pshadow using (scope)
  left join (select tenant_id scope, count(distinct event_id) ca from dc where decided in ('drop_tag','quarantine') group by all) using (scope) left join (select tenant_id scope, count(distinct event_id) cb from ds where decided='drop_tag' group by all) using (scope))"""
COST = ["tenant_id", "incident_id", "events", "window_seconds", "baseline_bytes", "baseline_series", "active_bytes", "active_series", "active_changed", "shadow_bytes", "shadow_series", "shadow_changed"]


@query(f"with {COSTS} select * from cs")
def a11_cost_simulation(spark, sf_dir):
    return P.cost_incidents(*captured(spark, sf_dir), POLICY, SHADOW).select(*COST)


_MONTH = ", ".join(f"round({n}_bytes*(2592000/window_seconds)/1073741824, 9) {n}_gb_month, round({n}_bytes*(2592000/window_seconds)/1073741824*2.5+{n}_series/1000*8.0, 6) {n}_cost_month" for n in ("baseline", "active", "shadow"))


@query(f"with {COSTS} select tenant_id, incident_id, {_MONTH} from cs")
def d17_cost_pricing(spark, sf_dir):
    out = P.cost_incidents(*captured(spark, sf_dir), POLICY, SHADOW, per_gb=2.5, per_1000_series=8.0)
    return out.select("tenant_id", "incident_id", *(x for n in ("baseline", "active", "shadow") for x in (F.round(f"{n}_gb_month", 9).alias(f"{n}_gb_month"), F.round(f"{n}_cost_month", 6).alias(f"{n}_cost_month"))))


def _saved_sql(what: str) -> str:
    share = f"(active_{what}-shadow_{what})/active_{what}*100"
    return f"case when abs({share})<0.05 then 0.0 else round({share},1) end {what}_saved"


@query(f"""with {COSTS}, fq as (select tenant_id, count_if(decided='quarantine') q from dc group by all), sv as (select tenant_id, incident_id, {_saved_sql('bytes')}, {_saved_sql('series')} from cs where active_bytes>0 and active_series>0)
 select sv.tenant_id, sv.incident_id, 'c1' run_id, bytes_saved, series_saved, 'r1' replay_id, coalesce(q,0)>0 review_quarantined from sv left join fq on fq.tenant_id=sv.tenant_id||chr(31)||sv.incident_id where bytes_saved>=5 or series_saved>=5""")
def d24_recommend(spark, sf_dir):
    inc, captures = captured(spark, sf_dir)
    now = F.timestamp_micros(F.lit(1704067200000000))
    costs = P.cost_incidents(inc, captures, POLICY, SHADOW).withColumn("run_id", F.lit("c1")).withColumn("started_at", now)
    runs = P.replay_incident_totals(inc, captures, POLICY, SHADOW).withColumn("run_id", F.lit("r1")).withColumn("started_at", now)
    return E.recommend(costs, runs)


#: DuckDB: the graph with a replay and a cost run of each incident that has events.
RUN_GRAPH = f"""{GBASE}, rs as (select distinct tenant_id, incident_id, kind, prefix||incident_id id, relation from fz, (values ('replay', 'replay:', 'evaluated-by-replay'), ('cost-simulation', 'cost:', 'evaluated-by-cost-simulation')) k(kind, prefix, relation)),
 wn as (select * from nd union all select tenant_id, incident_id, id, kind, null, null, null, incident_id, null, '' from rs),
 we as (select * from ed union all select tenant_id, incident_id, 'incident:'||incident_id, id, relation, 'related' from rs)"""


def run_graph(spark, sf_dir):
    """The evidence graph with a replay and a cost run of each incident, named by it."""
    inc, captures = captured(spark, sf_dir)
    # Staged, since the plans of both and of the graph are large.
    runs = lambda df, name: stage(df.select("tenant_id", "incident_id", F.col("incident_id").alias("run_id")), name)
    replays, costs = runs(P.replay_incident_totals(inc, captures, POLICY, SHADOW), "replay-runs"), runs(P.cost_incidents(inc, captures, POLICY, SHADOW), "cost-runs")
    return Graph(inc, event_facts(captures), markers(spark, sf_dir), runs={"replay": ("replay:", replays), "cost-simulation": ("cost:", costs)})


@query(f"{RUN_GRAPH} select tenant_id, incident_id, id, kind, source, event_type, version from wn")
def d22_evidence_nodes_runs(spark, sf_dir):
    return run_graph(spark, sf_dir).nodes().select("tenant_id", "incident_id", "id", "kind", "source", "event_type", "version")


@query(f"{RUN_GRAPH} select tenant_id, incident_id, \"from\", \"to\", relation, assessment from we")
def d22_evidence_edges_runs(spark, sf_dir):
    return run_graph(spark, sf_dir).edges(2000).select(*EDGE, "relation", "assessment")


@query(f"{RUN_GRAPH.replace(GBASE, GFULL)} select tenant_id, incident_id, nodes, edges, supporting, contradicting, related from (select tenant_id, incident_id, count(*) nodes from wn group by all) join (select tenant_id, incident_id, count(*) edges, count_if(assessment='supporting') supporting, count_if(assessment='contradicting') contradicting, count_if(assessment='related') related from we group by all) using (tenant_id, incident_id)")
def a17_graph_summary_runs(spark, sf_dir):
    return E.graph_summary((g := run_graph(spark, sf_dir)).nodes(), g.edges()).select("tenant_id", "incident_id", "nodes", "edges", "supporting", "contradicting", "related")


#: DuckDB: the canonical text of every event.
CANON = """cn as (select e.event_id, 'event_id='||e.event_id||chr(10)||'tenant_id='||e.tenant_id||chr(10)||'source='||e.source||chr(10)||'event_type='||e.event_type||chr(10)||'event_time='||epoch_us(e.event_time)||chr(10)
 ||coalesce(string_agg('tag.'||t.k||'='||t.v||chr(10),'' order by t.k),'')||coalesce('payload='||any_value(e.payload)||chr(10),'')||coalesce('metric_value='||cast(cast(any_value(e.metric_value) as decimal(28,6)) as varchar)||chr(10),'')||coalesce('metric_unit='||any_value(e.metric_unit)||chr(10),'')
 ||'schema_version='||any_value(e.schema_version)||chr(10)||'correlation_id='||any_value(e.correlation_id)||chr(10) txt from ev e left join tg t using (event_id) group by e.event_id,e.tenant_id,e.source,e.event_type,e.event_time)"""


@query(f"with {CANON}, mr as (select tenant_id, source, list(sha256(txt) order by event_time, event_id) l from ev join cn using (event_id) group by all union all select tenant_id, source, list_transform(range(0, len(l), 2), lambda i: sha256(unhex(l[i+1])||unhex(l[least(i+2, len(l))]))) from mr where len(l)>1) select tenant_id, source, l[1] root from mr where len(l)=1")
def a16_merkle_root(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("leaf", F.sha2(X.canonical_text().cast("binary"), 256))
    return L.merkle_root(rows, ["tenant_id", "source"], ["event_time", "event_id"], "leaf")


SEALED = ["tenant_id", "source"]


@query("""with sq as (select tenant_id, source, n, payload, row_number() over (partition by tenant_id, source order by event_time, event_id) as sequence from ev), kp as (select *, coalesce(lag(sequence) over (partition by tenant_id, source order by sequence),0) p from sq where n%150<>11)
 select tenant_id, source, sequence, case when n%100=7 and payload<>'{}' then 'payload' else 'link' end reason from kp where (n%100=7 and payload<>'{}') or p<>sequence-1""")
def w15_verify_chain(spark, sf_dir):
    records = L.seal_records(events(spark, sf_dir), SEALED, ["event_time", "event_id"])
    broken = records.withColumn("payload", F.when(F.col("n") % 100 == 7, "{}").otherwise(F.col("payload"))).where("n % 150 != 11")
    return L.verify_chain(broken, SEALED)


@query("select tenant_id, source, cast((sequence-1)//64 as bigint) segment, 'range' reason from (select tenant_id, source, n, row_number() over (partition by tenant_id, source order by event_time, event_id) as sequence from ev) where n%500=11 group by all")
def w16_verify_segments(spark, sf_dir):
    records = L.seal_records(events(spark, sf_dir), SEALED, ["event_time", "event_id"])
    return L.verify_segments(L.seal_segments(records, SEALED, 64), records.where("n % 500 != 11"), SEALED, 64)


@query("select n as sequence, 1+n%3 nodes, 1+n%3>=2 durable from ev")
def a20_quorum_audit(spark, sf_dir):
    ev = events(spark, sf_dir)
    acks = ev.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") % 3))).select(F.col("n").alias("sequence"), F.concat(F.lit("node"), F.col("i").cast("string")).alias("node_id"), F.concat(F.lit("z"), F.col("i").cast("string")).alias("zone"), F.lit("r").alias("region"), F.lit("c").alias("cloud"))
    return L.quorum_audit(acks, 2, zones=2).select("sequence", "nodes", "durable")


@query("select tenant_id, count_if(n%5=0) rejected, count_if(n%5<>0 and n%3<>0) delivered, count_if(n%5<>0 and n%3=0 and n%2=0) retained, count_if(n%5<>0 and n%3=0 and n%2=1) lost, count_if(n%7=0 and n%3<>0) duplicates from ev group by all")
def a21_delivery_accounting(spark, sf_dir):
    ev = events(spark, sf_dir).select("tenant_id", "event_id", "n")
    sent = ev.where("n % 3 != 0")
    return L.delivery_accounting(ev, ev.where("n % 5 != 0"), sent.union(sent.where("n % 7 = 0")), ev.where("n % 2 = 0"))


NODES = [("n1", "c1", "r1", "z1"), ("n2", "c1", "r1", "z1"), ("n3", "c1", "r1", "z2"), ("n4", "c2", "r9", "z9")]


@query("select distinct correlation_id as key, case when substr(sha256(correlation_id||'|n1'),1,16)>substr(sha256(correlation_id||'|n2'),1,16) then 'n1' else 'n2' end node from ev")
def d30_rendezvous(spark, sf_dir):
    return L.rendezvous(events(spark, sf_dir).select(F.col("correlation_id").alias("key")).distinct(), NODES, ("c1", "r1", "z1"))


@query("select event_id, source from ev where n%11<>0")
def s3_decode_split(spark, sf_dir):
    value = F.when(F.col("n") % 11 == 0, "{oops").otherwise(F.to_json(F.struct("event_id", "tenant_id", "source", "event_type", "event_time")))
    raw = events(spark, sf_dir).select(value.alias("value"), F.lit("raw").alias("topic"), F.lit(0).alias("partition"), F.col("n").alias("offset"))
    return ingest.decode_split(raw)[0].select("event_id", "source")


@query("select n as \"offset\", 'permanent' as class from ev where n%11=0")
def s3_dead_letters(spark, sf_dir):
    value = F.when(F.col("n") % 11 == 0, "{oops").otherwise(F.to_json(F.struct("event_id")))
    raw = events(spark, sf_dir).select(value.alias("value"), F.lit("raw").alias("topic"), F.lit(0).alias("partition"), F.col("n").alias("offset"))
    return ingest.decode_split(raw)[1].select("offset", "class")


def _attr(key, c):
    return F.struct(F.lit(key).alias("key"), F.struct(c.cast("string").alias("stringValue")).alias("value"))


@query("select source, event_type, epoch_us(event_time) event_us, tag_user_id user_id, 'prod' env, case when n%2=0 then 'error' end severity from ev")
def s4_flatten_otlp_logs(spark, sf_dir):
    record = F.struct((F.unix_micros("event_time") * 1000).cast("string").alias("timeUnixNano"), F.when(F.col("n") % 2 == 0, "error").alias("severityText"), F.array(_attr("event.name", F.col("event_type")), _attr("user_id", X.tag("user_id")), _attr("env", F.lit("prod"))).alias("attributes"))
    request = F.struct(F.array(F.struct(F.struct(F.array(_attr("service.name", F.col("source")), _attr("env", F.lit("none"))).alias("attributes")).alias("resource"), F.array(F.struct(F.struct(F.lit("scope").alias("name")).alias("scope"), F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    out = ingest.flatten_otlp_logs(events(spark, sf_dir).select(F.to_json(request).alias("value")))
    return out.select("source", "event_type", F.unix_micros("event_time").alias("event_us"), X.tag("user_id").alias("user_id"), X.tag("env").alias("env"), X.tag("severity").alias("severity"))


def _metrics(spark, sf_dir):
    point = F.struct((F.unix_micros("event_time") * 1000).cast("string").alias("timeUnixNano"), F.when(F.col("n") % 9 == 0, "NaN").otherwise(F.col("metric_value").cast("string")).alias("asDouble"))
    metric = F.struct(F.col("event_type").alias("name"), F.lit("ms").alias("unit"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))
    request = F.struct(F.array(F.struct(F.struct(F.array(_attr("service.name", F.col("source"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    return ingest.flatten_otlp_metrics(events(spark, sf_dir).where("metric_value is not null").select(F.to_json(request).alias("value")))


@query("select source, event_type, epoch_us(event_time) event_us, metric_value from ev where metric_value is not null and n%9<>0")
def s5_flatten_otlp_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)[0].select("source", "event_type", F.unix_micros("event_time").alias("event_us"), "metric_value")


@query("select count_if(metric_value is not null and n%9=0) rejected from ev")
def s5_rejected_points(spark, sf_dir):
    return _metrics(spark, sf_dir)[1]


@query("select event_id, case when n%2=0 then 'deployment.completed' else 'feature_flag.changed' end event_type, case when n%4=0 then 'C'||n else 'CHG-'||event_id end change_id from ev")
def s6_changes_to_events(spark, sf_dir):
    return _changes(events(spark, sf_dir))


@query("select event_id, case when n%2=0 then 'deployment.completed' else 'feature_flag.changed' end event_type, case when n%4=0 then 'C'||n else 'CHG-'||event_id end change_id from ev")
def s6_changes_to_events_all(spark, sf_dir):
    return _changes(events(spark, sf_dir))


def _changes(ev):
    n = F.col("n")
    rows = ev.select("tenant_id", "event_id", "source", F.when(n % 2 == 0, "deployment").otherwise("feature_flag").alias("kind"), F.lit(None).cast("string").alias("status"), "tags", F.col("event_time").alias("changed_at"), F.when(n % 4 == 0, F.concat(F.lit("C"), n.cast("string"))).alias("change_id"), F.lit("v1").alias("version"), F.lit(None).cast("string").alias("rollback_of"))
    return ingest.changes_to_events(rows, "2030-01-01")[0].select("event_id", "event_type", X.tag("ctl.change_id").alias("change_id"))


#: DuckDB: an event's tags as JSON text, its time as JSON has it, and its envelope.
_TAGS_JSON = "'{'||concat_ws(','," + ",".join(f"'\"{t}\":'||to_json(tag_{t})" for t in TAGS) + ")||'}'"
_TIME_JSON = "'\"'||strftime(event_time,'%Y-%m-%dT%H:%M:%S.%g')||'Z\"'"
JSON = f"""js as (select *, '{{'||concat_ws(',','"event_id":'||to_json(event_id),'"tenant_id":'||to_json(tenant_id),'"source":'||to_json(source),'"event_type":'||to_json(event_type),'"event_time":'||{_TIME_JSON},'"tags":'||{_TAGS_JSON},
 '"payload":'||to_json(payload),'"metric_value":'||cast(metric_value as varchar),'"metric_unit":'||to_json(metric_unit),'"schema_version":'||to_json(schema_version),'"correlation_id":'||to_json(correlation_id))||'}}' envelope, {_TAGS_JSON} tags_json from ev)"""


@query(f"with {JSON} select tenant_id||'|'||source as key, envelope as \"value\", 'event_id='||event_id||',tenant_id='||tenant_id||',schema_version='||schema_version headers from js")
def s10_kafka_rows(spark, sf_dir):
    headers = F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), ",")
    return export.to_kafka_rows(events(spark, sf_dir)).select("key", "value", headers.alias("headers"))


@query(f"with {JSON} select tenant_id, event_id, 1717200000000000 captured_us, epoch_us(event_time) event_us, source, event_type, envelope from js")
def s9_capture(spark, sf_dir):
    out = export.capture(events(spark, sf_dir), "2024-06-01T00:00:00Z")
    return out.select("tenant_id", "event_id", F.unix_micros("captured_at").alias("captured_us"), F.unix_micros("event_time").alias("event_us"), "source", "event_type", "envelope")


@query(f"with {JSON} select tenant_id||':'||event_id idempotency_key, envelope body from js")
def s11_http_json(spark, sf_dir):
    return export.export_http_json(events(spark, sf_dir))


@query("""with atr as (select e.event_id, '['||coalesce(string_agg('{"key":'||to_json(t.k)||',"value":{"stringValue":'||to_json(t.v)||'}}', ',' order by t.k),'')||']' a from ev e left join tg t using (event_id) group by all)
 select tenant_id, source, case when metric_value is not null then 'metrics' else 'logs' end signal, event_id, case when metric_value is not null then '{"name":'||to_json(event_type)||',"unit":'||to_json(metric_unit)||',"gauge":{"dataPoints":[{"timeUnixNano":"'||(epoch_us(event_time)*1000)||'","asDouble":'||cast(metric_value as varchar)||',"attributes":'||a||'}]}}'
 else '{"timeUnixNano":"'||(epoch_us(event_time)*1000)||'","severityText":'||to_json(coalesce(lower(nullif(trim(tag_severity),'')), case when contains(event_type,'error') then 'error' end, ''))||',"body":{"stringValue":'||to_json(coalesce(payload,event_type))||'},"attributes":'||a||'}' end item from ev join atr using (event_id)""")
def s12_otlp(spark, sf_dir):
    return export.export_otlp(events(spark, sf_dir))


@query("select event_id, '__name__='||replace(event_type,'.','_')||',environment='||tag_environment||',source='||source||',tenant_id='||tenant_id labels, metric_value as value, epoch_ms(event_time) timestamp_ms from ev where metric_value is not null")
def s13_prometheus(spark, sf_dir):
    return export.export_prom(events(spark, sf_dir), ("environment",))


@query(f"with {JSON} select event_id, '{{\"time\":'||(epoch_ms(event_time)//1000)||'.'||lpad(cast(epoch_ms(event_time)%1000 as varchar),3,'0')||',\"source\":'||to_json(source)||',\"sourcetype\":'||to_json(event_type)||',\"event\":{{'||concat_ws(',','\"event_id\":'||to_json(event_id),'\"tenant_id\":'||to_json(tenant_id),'\"tags\":'||tags_json,'\"payload\":'||to_json(payload),'\"metric_value\":'||cast(metric_value as varchar))||'}}}}' body from js")
def s14_hec(spark, sf_dir):
    return export.export_hec(events(spark, sf_dir))


@query(f"select event_id, payload message, case when {ERR} then 'error' else 'info' end status, source service, (select string_agg(t.k||':'||t.v, ',' order by t.k) from tg t where t.event_id=ev.event_id) ddtags from ev")
def s15_datadog(spark, sf_dir):
    return export.export_dd(events(spark, sf_dir))


@query(f"with {CAND}, {FZ} select tenant_id, incident_id, event_id from fz")
def s17_bundle(spark, sf_dir):
    fz, inc = frozen(spark, sf_dir)
    return L.bundle(inc, {"events": fz.drop("n")})["events"].select("tenant_id", "incident_id", "event_id")


def whole_bundle(spark, sf_dir):
    """All members of all incidents' bundle; a replay and a cost run of each incident."""
    inc, captures = captured(spark, sf_dir)
    fz = E.freeze(inc, captures)
    shape = described(spark, sf_dir)
    # Staged, since the plans of the members are large.
    members = {"events": fz.drop("n"), "replays": stage(P.replay_incident_totals(inc, captures, POLICY, SHADOW), "bundle-replays"), "costs": stage(P.cost_incidents(inc, captures, POLICY, SHADOW), "bundle-costs")}
    by_pair = {"schemas": stage(S.schema_registry(shape), "bundle-schemas"), "drifts": stage(S.schema_drifts(shape), "bundle-drifts")}
    return L.bundle(inc, members, by_pair, markers(spark, sf_dir))


#: DuckDB: rows of every member; replays and costs have one row of each incident with events.
_COUNTED = " union all ".join(f"select tenant_id, incident_id, '{member}' member, count(*) \"rows\" from {rows} group by all" for member, rows in (
    ("events", "fz"), ("incidents", "inc"), ("changes", "nr"), ("schemas", "pr join rg using (tenant_id, source, event_type)"), ("drifts", "pr join dr using (tenant_id, source, event_type)"),
    ("replays", "(select distinct tenant_id, incident_id from fz)"), ("costs", "(select distinct tenant_id, incident_id from fz)"),
))


@query(f"with {CAND}, {FZ}, {MK}, {NEAR}, {DRIFT}, pr as (select distinct tenant_id, incident_id, source, event_type from fz) {_COUNTED}")
def s17_bundle_all(spark, sf_dir):
    out = None
    for name, df in sorted(whole_bundle(spark, sf_dir).items()):
        rows = df.groupBy("tenant_id", "incident_id").agg(F.lit(name).alias("member"), F.count(F.lit(1)).alias("rows"))
        out = rows if out is None else out.union(rows)
    return out


def _manifest_sql(member: str, rows: str, fields: list[tuple[str, str]]) -> str:
    """DuckDB: a member's line of the manifest; fields are (name, JSON) in the order of names."""
    json = "'{'||concat_ws(','," + ",".join(f"'\"{n}\":'||{x}" for n, x in fields) + ")||'}'"
    words = ",".join(f"cast(sum(cast('0x'||substr(h,{1 + 8 * i},8) as bigint)) as varchar)" for i in range(8))
    return f"select '{member}' member, count(*) \"rows\", cast(sum(octet_length(encode(j))) as bigint) bytes, sha256(concat_ws('|',{words})) digest from (select j, sha256(j) h from (select {json} j from {rows}))"


_text = lambda c: (c, f"to_json({c})")
_time = lambda c: (c, _TIME_JSON.replace("event_time", c))
_MEMBERS = " union all ".join([
    _manifest_sql("events", "(select *, event_time captured_at from fz)", [_time("captured_at"), _text("correlation_id"), _text("event_id"), _time("event_time"), _text("event_type"), _text("incident_id"), _text("metric_unit"), ("metric_value", "cast(metric_value as varchar)"), ("n", "n"), _text("payload"), _text("schema_version"), _text("source"), ("tags", _TAGS_JSON), _text("tenant_id")]),
    _manifest_sql("incidents", "(select *, 'Automatic incident: '||source title from inc)", [_text("category"), _text("event_id"), _time("frozen_from"), _time("frozen_to"), _text("incident_id"), _text("reason"), _text("source"), _text("tenant_id"), _text("title")]),
])


@query(f"with {CAND}, {FZ} {_MEMBERS}")
def s18_manifest(spark, sf_dir):
    fz, inc = frozen(spark, sf_dir)
    return L.manifest(L.bundle(inc, {"events": fz}))


@query(f"with {CAND}, {FZ} select 'other' tenant_id, incident_id, event_id from fz where incident_id not like '%-errors'")
def s19_import_bundle(spark, sf_dir):
    fz, inc = frozen(spark, sf_dir)
    none = fz.sparkSession.createDataFrame([], "digest string")
    there = inc.where("category = 'errors'").select(F.lit("other").alias("tenant_id"), "incident_id")
    return L.import_bundle({"events": fz}, "other", there, "d1", none)["events"].select("tenant_id", "incident_id", "event_id")
