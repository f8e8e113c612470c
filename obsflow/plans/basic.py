"""Queries of predicates, tables, statistics and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.functions import exprs as X
from obsflow.operators import stats, tables
from obsflow.plans.views import CHANGE, ERR, HIGH, LAT, NORMAL, duck, events
from obsflow.schema import CardinalityRule, Match, Policy

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None, raw: bool = False):
    """Register a function under its name, with its SQL over the canonical view."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if raw else duck(sql)
        return f

    return add


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with blank fields at fixed places, for validation."""
    ev = events(spark, sf_dir)
    every = lambda m, c, v: F.when(F.col("n") % m == 0, v).otherwise(F.col(c))
    return ev.withColumn("source", every(13, "source", F.lit("  "))).withColumn("event_type", every(17, "event_type", F.lit(""))).withColumn("event_time", every(19, "event_time", F.lit(None))).withColumn("schema_version", every(23, "schema_version", F.lit(" "))).withColumn("metric_value", every(29, "metric_value", F.lit(None)))


DAMAGED = """bad as (select * replace (case when n%13=0 then '  ' else source end as source, case when n%17=0 then '' else event_type end as event_type,
 case when n%19=0 then null else event_time end as event_time, case when n%23=0 then ' ' else schema_version end as schema_version,
 case when n%29=0 then null else metric_value end as metric_value) from ev)"""
END = "make_timestamp(1704067200000000 + (select max(event_id) from events)*720000)"


def last_time(ev: DataFrame):
    """The newest event's time: one row."""
    return ev.agg(F.max("event_time")).collect()[0][0]


@query("select event_id, tenant_id, source, event_type, epoch_us(event_time) event_us, metric_value, correlation_id, payload from ev")
def s1_read_events(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "tenant_id", "source", "event_type", F.unix_micros("event_time").alias("event_us"), "metric_value", "correlation_id", "payload")


@query(f"with {DAMAGED} select event_id, case when trim(source)='' then 'source is required' when trim(event_type)='' then 'type is required' when event_time is null then 'timestamp is required' when trim(schema_version)='' then 'schema_version is required' when metric_unit is not null and metric_value is null then 'metric value is required' end reason from bad")
def p1_validate(spark, sf_dir):
    ok, bad = tables.validate(damaged(spark, sf_dir))
    return ok.select("event_id", F.lit(None).cast("string").alias("reason")).union(bad.select("event_id", "reason"))


@query(f"with {DAMAGED} select event_id, trim(source) source, trim(event_type) event_type, trim(source)='' or trim(event_type)='' failed from bad")
def p2_normalize(spark, sf_dir):
    return tables.normalize(damaged(spark, sf_dir)).select("event_id", "source", "event_type", "failed")


@query("select event_id, tenant_id from ev where tenant_id='t1'")
def p3_for_tenant(spark, sf_dir):
    return tables.for_tenant(events(spark, sf_dir), "t1").select("event_id", "tenant_id")


@query(f"select event_id, {ERR} is_error from ev")
def p4_is_error(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", X.is_error().alias("is_error"))


@query(f"select event_id, {LAT} is_latency, {HIGH} high, {NORMAL} normal from ev")
def p5_latency(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", X.is_latency().alias("is_latency"), X.high_latency().alias("high"), X.normal_latency().alias("normal"))


@query("select event_id, coalesce(lower(nullif(trim(tag_severity),'')), case when contains(event_type,'error') then 'error' end, '') severity from ev")
def p6_severity(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", X.severity().alias("severity"))


@query("select event_id, regexp_full_match(event_type,'[^/]*\\.[a-e][^/]*') a, event_type like 'debug.clic_' b, true c from ev")
def p7_glob(spark, sf_dir):
    kind = F.col("event_type")
    return events(spark, sf_dir).select("event_id", X.glob("*.[a-e]*", kind).alias("a"), X.glob("debug.clic?", kind).alias("b"), X.glob(" * ", kind).alias("c"))


RULE = Match("r", tenant="t[01]", source="svc-*", type="*.*", severity=("", "error"), tags={"environment": "prod*"})


@query("select event_id from ev where tenant_id in ('t0','t1') and contains(event_type,'.') and coalesce(tag_severity, case when contains(event_type,'error') then 'error' else '' end) in ('','error') and tag_environment='production'")
def p8_rule_matches(spark, sf_dir):
    return events(spark, sf_dir).where(X.rule_matches(RULE)).select("event_id")


@query(f"select event_id, {CHANGE} is_change, {CHANGE} is_change_graph from ev")
def p9_is_change(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", X.is_change().alias("is_change"), X.is_change_graph().alias("is_change_graph"))


SERIES = "source||'|'||event_type||coalesce((select string_agg('|'||k||'='||v,'' order by k) from tg where tg.event_id=ev.event_id),'')"
SERIES_CTE = "ser as (select e.event_id, e.source||'|'||e.event_type||coalesce(string_agg('|'||t.k||'='||t.v,'' order by t.k),'') series from ev e left join tg t using (event_id) group by e.event_id, e.source, e.event_type)"


@query(f"with {SERIES_CTE} select event_id, sha256(series) series from ser")
def p10_series_id(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.sha2(X.series_id().cast("binary"), 256).alias("series"))


BYTES_CTE = """siz as (select e.event_id, octet_length(encode(
 'event_id='||e.event_id||chr(10)||'tenant_id='||e.tenant_id||chr(10)||'source='||e.source||chr(10)||'event_type='||e.event_type||chr(10)||'event_time='||epoch_us(e.event_time)||chr(10)
 ||coalesce(string_agg('tag.'||t.k||'='||t.v||chr(10),'' order by t.k),'')||coalesce('payload='||any_value(e.payload)||chr(10),'')
 ||coalesce('metric_value='||cast(cast(any_value(e.metric_value) as decimal(28,6)) as varchar)||chr(10),'')||coalesce('metric_unit='||any_value(e.metric_unit)||chr(10),'')
 ||'schema_version='||any_value(e.schema_version)||chr(10)||'correlation_id='||any_value(e.correlation_id)||chr(10))) bytes
 from ev e left join tg t using (event_id) group by e.event_id,e.tenant_id,e.source,e.event_type,e.event_time)"""


@query(f"with {BYTES_CTE} select event_id, cast(bytes as bigint) bytes from siz")
def p11_canonical_bytes(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", X.canonical_bytes().alias("bytes"))


@query("select event_id, '[REDACTED]' user_id, '[REDACTED]' trace_id, tag_k k, case when payload is not null then '{\"redacted\":true}' end payload from ev")
def p12_redact(spark, sf_dir):
    rows = tables.redact(events(spark, sf_dir), ("USER_ID", "trace_id"), payload=True)
    return rows.select("event_id", X.tag("user_id").alias("user_id"), X.tag("trace_id").alias("trace_id"), X.tag("k").alias("k"), "payload")


POLICY = Policy("base", "1", 50, "allow", ("user_id", "request_id", "trace_id"), (CardinalityRule("svc-1", "*", "request_id", 20, "drop_tag"), CardinalityRule("*", "checkout.*", "user_id", 10, "quarantine"), CardinalityRule("*", "*", "user_id", 30, "drop_tag"), CardinalityRule("*", "*", "trace_id", 15, "allow")))
SHADOW = Policy("next", "2", 40, "allow", ("user_id", "request_id"), (CardinalityRule("*", "*", "request_id", 25, "drop_tag"), CardinalityRule("*", "*", "user_id", 30, "drop_tag")))
DECIDE = """case when source='svc-1' and k='request_id' then 20 when event_type like 'checkout.%' and k='user_id' then 10 when k='user_id' then 30 when k='trace_id' then 15 else 50 end threshold,
 case when source='svc-1' and k='request_id' then 'drop_tag' when event_type like 'checkout.%' and k='user_id' then 'quarantine' when k='user_id' then 'drop_tag' when k='trace_id' then 'allow' else 'allow' end act,
 k in ('user_id','request_id','trace_id') dangerous"""


@query("select k dimension, count(*) n, bool_or(k in ('user_id','request_id','trace_id')) dangerous from tg group by k")
def p13_is_dangerous(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.explode("tags").alias("dimension", "v"))
    return rows.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.bool_or(X.is_dangerous(POLICY, F.col("dimension"))).alias("dangerous"))


@query("select distinct event_type, coalesce(nullif(rtrim(left(ltrim(regexp_replace(lower(trim(event_type||' / ÄB'||tenant_id)),'[^a-z0-9]','-','g'),'-'),64),'-'),''),'unknown') slug from ev")
def p14_slug(spark, sf_dir):
    return events(spark, sf_dir).select("event_type", X.slug(F.concat("event_type", F.lit(" / ÄB"), "tenant_id")).alias("slug")).distinct()


@query(f"select source, event_type, k dimension, threshold, act, count(*) n from (select *, {DECIDE} from tg) group by all")
def p15_decision(spark, sf_dir):
    rows = events(spark, sf_dir).select("source", "event_type", F.explode("tags").alias("dimension", "v"))
    threshold, action = X.decision(POLICY, F.col("dimension"))
    return rows.groupBy("source", "event_type", "dimension", threshold.alias("threshold"), action.alias("act")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select tenant_id, count(*) events, count(distinct source) sources, count_if({ERR}) errors, coalesce(quantile_cont(case when {LAT} then metric_value end, 0.95),0) p95_ms, count(*)/3600 events_per_second, count_if({ERR})/count(*) error_rate from ev where event_time>={END}-interval 1 hour and event_time<={END} group by tenant_id")
def a1_summary(spark, sf_dir):
    ev = events(spark, sf_dir)
    return stats.summary(ev, last_time(ev), 3600)


@query(f"select tenant_id, source, count(*) events, count_if({ERR}) errors, coalesce(quantile_cont(case when {LAT} then metric_value end, 0.95),0) p95_ms, count_if({ERR})/count(*) error_rate from ev group by all")
def a2_window_stats(spark, sf_dir):
    return stats.window_stats(events(spark, sf_dir), ["tenant_id", "source"])


@query(f"select event_type, coalesce(quantile_cont(metric_value, 0.95) filter ({LAT} and metric_value<1000),0) p95 from ev group by event_type")
def a3_percentile(spark, sf_dir):
    return stats.exact_p95(events(spark, sf_dir), ["event_type"], [], {"p95": X.is_latency() & (F.col("metric_value") < 1000)})


@query(f"select event_id, count(case when {ERR} and not {HIGH} then 1 end) over (partition by tenant_id,source order by epoch_us(event_time) range between 59999999 preceding and current row) recent_errors from ev")
def w3_sliding_error_count(spark, sf_dir):
    return stats.sliding_error_count(events(spark, sf_dir)).select("event_id", "recent_errors")


COUNTER = "c as (select tenant_id, source, event_time, n, cast((n*7)%1000 as bigint) total from ev)"


@query(f"with {COUNTER} select tenant_id, source, n, case when total<p then total else total-p end delta from (select *, coalesce(lag(total) over (partition by tenant_id,source order by event_time),0) p from c) where case when total<p then total else total-p end>0")
def s7_counter_delta(spark, sf_dir):
    rows = events(spark, sf_dir).select("tenant_id", "source", "event_time", "n", ((F.col("n") * 7) % 1000).cast("long").alias("total"))
    return stats.counter_delta(rows, ["tenant_id", "source"], "total", "event_time").select("tenant_id", "source", "n", "delta")


@query(f"with {COUNTER} select tenant_id, source, n, case when total<p then total else total-p end delta from (select *, coalesce(lag(total) over (partition by tenant_id,source order by event_time),0) p from c) where case when total<p then total else total-p end>0")
def s7_counter_delta_all(spark, sf_dir):
    rows = events(spark, sf_dir).select("tenant_id", "source", "event_time", "n", ((F.col("n") * 7) % 1000).cast("long").alias("total"))
    return stats.counter_delta(rows, ["tenant_id", "source"], "total", "event_time").select("tenant_id", "source", "n", "delta")


@query("""with p as (select tenant_id, source, event_time, epoch_us(event_time)/1e6 x, least(greatest(metric_value/1000,0),1) y, event_id from ev where metric_value is not null),
 q as (select *, list(x) over w xs, list(y) over w ys from p window w as (partition by tenant_id, source order by event_time rows 11 preceding)),
 r as (select event_id, y, len(xs) m, list_sum([a-xs[1] for a in xs]) sx, list_sum(ys) sy, list_sum([(xs[i]-xs[1])*ys[i] for i in range(1,len(xs)+1)]) sxy, list_sum([(a-xs[1])*(a-xs[1]) for a in xs]) sxx from q),
 s as (select *, case when abs(m*sxx-sx*sx)<1e-12 then 0 else (m*sxy-sx*sy)/(m*sxx-sx*sx) end slope from r)
 select event_id, m samples, round(slope,8) slope, round(least(greatest(y+slope*30,0),1),6) projected, case when m>=8 then 'high' when m>=4 then 'medium' when m>=2 then 'low' else 'insufficient' end confidence,
 case when round(least(greatest(y+slope*30,0),1),9)>=0.95 then 0.5 when round(least(greatest(y+slope*30,0),1),9)>=0.9 then 0.6 when round(least(greatest(y+slope*30,0),1),9)>=0.82 then 0.75 else 1.0 end multiplier from s""")
def w17_forecast_pressure(spark, sf_dir):
    rows = events(spark, sf_dir).where("metric_value is not null").select("tenant_id", "source", F.col("event_time").alias("at"), (F.col("metric_value") / 1000).alias("queue_pressure"), "event_id")
    out = stats.forecast_pressure(rows, ["tenant_id", "source"])
    return out.select("event_id", "samples", F.round("slope", 8).alias("slope"), F.round("projected", 6).alias("projected"), "confidence", "multiplier")


@query(f"select event_id from ev where tenant_id='t1' and source='svc-2' and metric_value is not null and event_time<={END} order by event_time desc, event_id desc limit 50")
def t1_search_events(spark, sf_dir):
    ev = events(spark, sf_dir)
    return tables.search_events(ev, "t1", source="svc-2", t1=last_time(ev), metrics_only=True, limit=50).select("event_id")


@query("select event_id from ev where tenant_id='t0' and (event_time>make_timestamp(1704067200000000+720000*100) or (event_time=make_timestamp(1704067200000000+720000*100) and event_id>'evt-100')) order by event_time, event_id limit 40")
def t2_live_page(spark, sf_dir):
    return tables.live_page(events(spark, sf_dir), "t0", "2024-01-01 00:01:12", "evt-100", 40, "event_time").select("event_id")


@query("select event_id, tenant_id, source from (select *, row_number() over (partition by tenant_id, source order by event_time desc, event_id desc) r from ev) where r<=5")
def t5_newest(spark, sf_dir):
    return tables.newest(events(spark, sf_dir), "event_time", 5, ["tenant_id", "source"], "event_id").select("event_id", "tenant_id", "source")


@query("select tenant_id, event_id, epoch_us(min(event_time+to_seconds((n%3)+1))) captured_us from ev group by all")
def w13_earliest_capture(spark, sf_dir):
    ev = events(spark, sf_dir)
    first = ev.select("tenant_id", "event_id", (F.col("event_time") + F.make_dt_interval(secs=F.col("n") % 3 + 1)).alias("captured_at"))
    again = ev.where("n % 2 = 0").select("tenant_id", "event_id", (F.col("event_time") + F.expr("interval 10 seconds")).alias("captured_at"))
    return tables.earliest_capture(first.union(again)).select("tenant_id", "event_id", F.unix_micros("captured_at").alias("captured_us"))


@query("select tenant_id, event_id, event_type from ev where n%3<>0")
def s8_append_dedup(spark, sf_dir):
    ev = events(spark, sf_dir)
    return tables.append_dedup(ev.unionByName(ev.where("n % 5 = 0")), ev.where("n % 3 = 0")).select("tenant_id", "event_id", "event_type")


@query("select tenant_id, count(*) n_removed from ev where event_time<make_timestamp(1704067200000000+720000*500) group by tenant_id")
def s16_prune(spark, sf_dir):
    return tables.prune(events(spark, sf_dir), "event_time", "2024-01-01 00:06:00")[1]


@query("select tenant_id, event_id, case when n%4=0 then 'old' else 'new' end origin from ev")
def j13_insert_absent(spark, sf_dir):
    ev = events(spark, sf_dir).select("tenant_id", "event_id", "n")
    old = ev.where("n % 4 = 0").withColumn("origin", F.lit("old"))
    new = ev.unionAll(ev.where("n % 7 = 0")).withColumn("origin", F.lit("new"))
    return tables.insert_absent(new, old, ["tenant_id", "event_id"], ["n"]).select("tenant_id", "event_id", "origin")


@query("select tenant_id, source, max_by(event_type, n) status, max_by(tag_version, n) filter (tag_version is not null) as version, min_by(event_id, n) first_event, count(*) total from ev group by all")
def j14_upsert(spark, sf_dir):
    ev = events(spark, sf_dir).select("tenant_id", "source", "n", F.col("event_type").alias("status"), X.tag("version").alias("version"), F.col("event_id").alias("first_event"), F.lit(1).cast("long").alias("total"))
    return tables.upsert(ev.where("n % 2 = 1"), ev.where("n % 2 = 0"), ["tenant_id", "source"], "n", {"status": "last", "version": "coalesce", "first_event": "first", "total": "add"})


@query("select distinct event_type as name from ev union select distinct source from ev")
def u1_union_names(spark, sf_dir):
    ev = events(spark, sf_dir)
    return tables.union_names(ev.select(F.col("event_type").alias("name")), ev.select("source"))


@query("with t as (select tenant_id, source, list_sort(list_distinct(list(event_type) filter (n%2=0))) a, list_sort(list_distinct(list(event_type) filter (n%3=0))) b from ev group by all) select tenant_id, source, array_to_string(list_sort(list_filter(b, lambda x: not list_contains(a,x))),',') added, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b,x))),',') removed from t")
def u2_set_changes(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("tenant_id", "source").agg(F.collect_set(F.when(F.col("n") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("n") % 3 == 0, F.col("event_type"))).alias("b"))
    added, removed = tables.set_changes(F.col("a"), F.col("b"))
    return rows.select("tenant_id", "source", F.array_join(added, ",").alias("added"), F.array_join(removed, ",").alias("removed"))


@query("with f as (select distinct tenant_id||'/'||source s, tag_k u from ev) select l, r, shared, shared/(nl+nr-shared) jaccard from (select a.s l, b.s r, count(*) shared from f a join f b using (u) where a.s<b.s group by all) join (select s l, count(*) nl from f group by s) using (l) join (select s r, count(*) nr from f group by s) using (r)")
def u3_jaccard(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.concat_ws("/", "tenant_id", "source").alias("s"), X.tag("k").alias("u"))
    out = tables.jaccard(rows.withColumnRenamed("s", "l"), rows.withColumnRenamed("s", "r"), ["l"], ["r"], "u")
    return out.where("l < r").select("l", "r", "shared", "jaccard")


@query("with t as (select tenant_id, source, list_sort(list_distinct(list(event_type) filter (n%2=0))) a, list_sort(list_distinct(list(event_type) filter (n%3=0))) b from ev group by all) select tenant_id, source, a=b same from t")
def u4_same_effects(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("tenant_id", "source").agg(F.collect_set(F.when(F.col("n") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("n") % 3 == 0, F.col("event_type"))).alias("b"))
    return rows.select("tenant_id", "source", tables.same_effects(F.col("a"), F.col("b")).alias("same"))
