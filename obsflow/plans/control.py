"""Queries of cardinality, shaping and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsflow.functions import exprs as X
from obsflow.operators import cardinality as K
from obsflow.operators import routing as R
from obsflow.operators import shaping as S
from obsflow.plans.basic import BYTES_CTE, DECIDE, POLICY, SERIES_CTE, SHADOW, query
from obsflow.plans.views import ERR, HIGH, events
from obsflow.schema import Budget, Destination, Policy, Pressure, Protection, RoutingConfig, RoutingRule, ShapingConfig, ShapingRule

#: DuckDB: hash, register and rank of a value in column ``v``.
HASH = "('0x'||substr(sha256(v),1,16))::ubigint"
REG = f"hs as (select *, cast({HASH} & 63 as int) idx, {HASH} >> 6 m from ROWS), rk as (select *, case when m=0 then 59 else least(59, length(bin(m))-length(rtrim(bin(m),'0'))+1) end rank from hs)"
EST = "greatest(1, round(case when 0.709*4096/S<=160 and Z>0 then 64*ln(64/Z) else 0.709*4096/S end))"
RUN = f"""tr as (select tenant_id, source, event_type, event_id, event_time, n, k, v, date_trunc('hour', event_time) hr from tg), {REG.replace('ROWS', 'tr')},
 r1 as (select *, coalesce(max(rank) over (partition by tenant_id,source,event_type,k,hr,idx order by event_time,event_id rows between unbounded preceding and 1 preceding),0) prev, row_number() over (partition by tenant_id,source,event_type,k,hr,v order by event_time,event_id)=1 fresh from rk),
 r2 as (select *, 64+sum(case when rank>prev then pow(2.0,-rank)-pow(2.0,-prev) else 0 end) over w S, 64-sum(case when rank>prev and prev=0 then 1 else 0 end) over w Z, sum(case when fresh then 1 else 0 end) over w exact, count(*) over w samples, min(event_time) over w first_seen from r1 window w as (partition by tenant_id,source,event_type,k,hr order by event_time,event_id rows unbounded preceding)),
 r3 as (select *, cast({EST} as bigint) sketched, (epoch_us(event_time)-epoch_us(first_seen))/1e6 el from r2),
 ob as (select *, cast(case when exact<=16 then exact else sketched end as bigint) observed from r3),
 pj as (select *, cast(case when el>=30 and el<3600 and samples>=10 then greatest(ceil(observed*3600.0/el),observed) else observed end as bigint) projected from ob)"""
ACT = f"""dc as (select *, case when observed>=threshold or projected>=threshold then act when dangerous and observed>=greatest(3,threshold//10) then 'allow' end decided, observed>=threshold or projected>=threshold crossed from (select *, {DECIDE} from pj))"""
HKEY = ["tenant_id", "source", "event_type", "dimension"]


@query(f"with {RUN} select event_id, k dimension, exact from r2")
def w1_running_distinct(spark, sf_dir):
    return K.running(events(spark, sf_dir)).select("event_id", "dimension", "exact")


@query(f"with {RUN} select event_id, k dimension, sketched from r3")
def w2_running_hll(spark, sf_dir):
    return K.running(events(spark, sf_dir)).select("event_id", "dimension", "sketched")


HOURLY = f"""tr as (select tenant_id, source, event_type, event_time, k, v, date_trunc('hour', event_time) hr from tg), {REG.replace('ROWS', 'tr')},
 hr1 as (select tenant_id,source,event_type,k,hr,idx, max(rank) rank, count(distinct v) d, count(*) n, min(event_time) a, max(event_time) b from rk group by all),
 hr2 as (select tenant_id,source,event_type,k,hr, sum(d) d, sum(n) samples, min(a) a, max(b) b, sum(pow(2.0,-rank))+64-count(*) S, 64-count(*) Z from hr1 group by all),
 ho as (select *, cast(case when d<=16 then d else {EST} end as bigint) observed from hr2),
 hp as (select *, cast(case when (epoch_us(b)-epoch_us(a))/1e6 between 30 and 3599.999999 and samples>=10 then greatest(ceil(observed*3600.0/((epoch_us(b)-epoch_us(a))/1e6)),observed) else observed end as bigint) projected from ho)"""


def hourly(spark, sf_dir):
    rows = K.cardinality_hourly(K.tag_rows(events(spark, sf_dir)))
    return rows.withColumn("projected", K.project(F.col("observed"), F.col("samples"), F.col("first_seen"), F.col("last_seen")))


@query(f"with {HOURLY} select tenant_id, source, event_type, k dimension, epoch_us(hr) hour_us, observed, cast(samples as bigint) samples from ho")
def a4_cardinality_hourly(spark, sf_dir):
    return hourly(spark, sf_dir).select(*HKEY, F.unix_micros("hour").alias("hour_us"), "observed", "samples")


@query("select tenant_id, source, event_type, k dimension, epoch_us(date_trunc('hour', event_time)) hour_us, count(distinct v) observed, count(*) samples from tg group by all")
def a4_cardinality_exact(spark, sf_dir):
    rows = K.cardinality_hourly(K.tag_rows(events(spark, sf_dir)), tracker="exact")
    return rows.select(*HKEY, F.unix_micros("hour").alias("hour_us"), "observed", "samples")


@query(f"with {HOURLY} select tenant_id, source, event_type, k dimension, epoch_us(hr) hour_us, observed from ho")
def a5_merge_cardinality(spark, sf_dir):
    rows = K.tag_rows(events(spark, sf_dir))
    even = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    return K.merge_cardinality(K.sketch(rows.where(even)), K.sketch(rows.where(~even))).select(*HKEY, F.unix_micros("hour").alias("hour_us"), "observed")


@query(f"with {HOURLY} select tenant_id, source, event_type, k dimension, epoch_us(hr) hour_us, projected from hp")
def a6_project(spark, sf_dir):
    return hourly(spark, sf_dir).select(*HKEY, F.unix_micros("hour").alias("hour_us"), "projected")


@query(f"with {HOURLY} select tenant_id, source, event_type, k dimension, epoch_us(hr) hour_us, observed, projected from hp order by projected-observed desc, projected desc, tenant_id, source, event_type, k, hr limit 20")
def t3_top_dimensions(spark, sf_dir):
    return K.top_dimensions(hourly(spark, sf_dir), 20).select(*HKEY, F.unix_micros("hour").alias("hour_us"), "observed", "projected")


BUDGETS = Policy("b", budgets=(Budget("all", series_limit=500), Budget("checkout", type="checkout.*", series_limit=5000, warning_percent=20, critical_percent=40), Budget("svc-1", source="svc-1", series_limit=100000)))
BUD = f"""{SERIES_CTE}, bm as (select e.tenant_id, b.budget, date_trunc('hour',e.event_time) hr, e.event_time, s.series v, b.lim, b.wn, b.cr from ev e join ser s using (event_id)
 join (values ('all','%','%',500,70.0,90.0),('checkout','%','checkout.%',5000,20.0,40.0),('svc-1','svc-1','%',100000,70.0,90.0)) b(budget,src,typ,lim,wn,cr) on e.source like b.src and e.event_type like b.typ), {REG.replace('ROWS', 'bm')},
 b1 as (select tenant_id,budget,hr,idx,any_value(lim) lim, any_value(wn) wn, any_value(cr) cr, max(rank) rank, count(distinct v) d, count(*) n, min(event_time) a, max(event_time) b from rk group by tenant_id,budget,hr,idx),
 b2 as (select tenant_id,budget,hr,any_value(lim) lim, any_value(wn) wn, any_value(cr) cr, sum(d) d, sum(n) samples, min(a) a, max(b) b, sum(pow(2.0,-rank))+64-count(*) S, 64-count(*) Z from b1 group by tenant_id,budget,hr),
 b3 as (select *, cast(case when d<=16 then d else {EST} end as bigint) observed from b2),
 b4 as (select *, cast(case when (epoch_us(b)-epoch_us(a))/1e6 between 30 and 3599.999999 and samples>=10 then greatest(ceil(observed*3600.0/((epoch_us(b)-epoch_us(a))/1e6)),observed) else observed end as bigint) projected from b3),
 b5 as (select *, 100.0*greatest(observed,projected)/lim pc from b4), b6 as (select *, case when pc>=100 then 'exceeded' when pc>=cr then 'critical' when pc>=wn then 'warning' else 'healthy' end status from b5)"""


@query(f"with {BUD} select tenant_id, budget, count(*) n from bm group by all")
def j15_match_budgets(spark, sf_dir):
    return K.match_budgets(events(spark, sf_dir), BUDGETS).groupBy("tenant_id", "budget").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {BUD} select tenant_id, budget, epoch_us(hr) hour_us, observed, projected, round(pc,4) consumption, status from b6")
def a7_budget_status(spark, sf_dir):
    return K.budget_status(events(spark, sf_dir), BUDGETS).select("tenant_id", "budget", F.unix_micros("hour").alias("hour_us"), "observed", "projected", F.round("consumption_percent", 4).alias("consumption"), "status")


@query(f"with {BUD} select tenant_id, budget, status from b6 where b>=(select max(event_time)-interval 2 hour from ev) order by list_position(['healthy','warning','critical','exceeded'],status) desc, pc desc, b desc, tenant_id, budget limit 5")
def t4_top_budgets(spark, sf_dir):
    ev = events(spark, sf_dir)
    since = ev.agg(F.max("event_time") - F.expr("interval 2 hours")).collect()[0][0]
    return K.top_budgets(K.budget_status(ev, BUDGETS), since, 5).select("tenant_id", "budget", "status")


@query(f"with {RUN}, {ACT} select event_id, k dimension, observed, projected, decided act from dc where decided is not null")
def d1_apply_policy_findings(spark, sf_dir):
    return K.decisions(events(spark, sf_dir), POLICY).where("act is not null").select("event_id", "dimension", "observed", "projected", "act")


@query(f"with {RUN}, {ACT}, ls as (select event_id, list(k) filter (decided in ('drop_tag','quarantine')) lost, string_agg(k, ',' order by k) filter (decided='quarantine') held from dc group by event_id) select e.event_id, coalesce((select string_agg(t.k||'='||t.v, ',' order by t.k) from tg t where t.event_id=e.event_id and not list_contains(coalesce(lost,[]), t.k)),'') kept, held from ev e left join ls using (event_id)")
def d1_apply_policy_events(spark, sf_dir):
    out, _, _ = K.apply_policy(events(spark, sf_dir), POLICY)
    kept = F.array_join(F.transform(X.sorted_tags(), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("event_id", kept.alias("kept"), X.tag("ctl.quarantine_dimensions").alias("held"))


@query(f"with {RUN}, {ACT} select event_id, string_agg(printf('estimated cardinality %d (projected %d) meets policy threshold %d', observed, projected, threshold), '; ' order by k) reason from dc where decided='quarantine' group by event_id")
def d2_quarantine(spark, sf_dir):
    return K.apply_policy(events(spark, sf_dir), POLICY)[2].select("event_id", "reason")


@query(f"with {RUN}, {ACT}, sh as (select *, coalesce(decided,'allow') active_action, case when observed>=st or projected>=st then sa else 'allow' end shadow_action from (select *, case when k='request_id' then 25 when k='user_id' then 30 else 40 end st, case when k in ('request_id','user_id') then 'drop_tag' else 'allow' end sa from dc)) select event_id, k dimension, active_action, shadow_action from sh where active_action<>shadow_action")
def d3_policy_diffs(spark, sf_dir):
    return K.policy_diffs(events(spark, sf_dir), POLICY, SHADOW).select("event_id", "dimension", "active_action", "shadow_action")


SHAPE = ShapingConfig("shape", "3", 0.8, Protection(errors=True, types=("payment.*",), latency_threshold_ms=1000), Pressure(True, 0.7, 0.9, 0.5, 0.2), (
    ShapingRule("debug", type="debug.*", sample_rate=0.25, min_sample_rate=0.1, drop_tags=("request_id",), rename_tags={"k": "key"}),
    ShapingRule("staging", tags={"environment": "staging"}, sample_rate=0.5, min_sample_rate=0.3, drop_tags=("trace_id",), payload_max_bytes=8, payload_action="drop"),
    ShapingRule("audit", type="audit.*", stop=True),
    ShapingRule("rest", drop_tags=("user_id",), shape_protected=True),
))
SHAPE2 = ShapingConfig("shape", "4", 0.8, SHAPE.protection, SHAPE.pressure, SHAPE.rules[:2])
#: DuckDB: the same configs, with queue pressure 0.75 (factor one half).
SHD = f"""sp as (select *, case when {ERR} then 'error/severe telemetry' when event_type like 'payment.%' then 'protected event type payment.*' when {HIGH} then 'high-latency telemetry' end why,
  event_type like 'debug.%' h1, tag_environment='staging' h2, event_type like 'audit.%' h3 from ev),
 sq as (select *, why is not null prot, case when h2 then 0.5 when h1 then 0.25 else 0.8 end base, case when h2 then 0.3 when h1 then 0.1 else 0.0 end low, concat_ws(',', case when h1 then 'debug' end, case when h2 then 'staging' end, case when h3 then 'audit' end, case when not h3 then 'rest' end) rules from sp),
 sr as (select *, greatest(base*0.5, low) eff, ('0x'||substr(sha256('shape|3|'||event_id),1,16))::ubigint::double/18446744073709551615.0::double fr, ('0x'||substr(sha256('shape|4|'||event_id),1,16))::ubigint::double/18446744073709551615.0::double fr2 from sq),
 ss as (select *, prot or fr<eff keep, prot or fr2<eff keep2, h1 and not prot d1, h2 and not prot d2, h2 and not prot and octet_length(encode(payload))>8 pd, not h3 d4 from sr)"""


@query(f"with {SHD} select event_id, keep from ss")
def d6_keep(spark, sf_dir):
    return S.shape(events(spark, sf_dir), SHAPE, 0.75).select("event_id", F.col("decision.keep").alias("keep"))


@query(f"with {SHD} select event_id, base base_rate, eff effective_rate from ss")
def d7_effective_rate(spark, sf_dir):
    return S.shape(events(spark, sf_dir), SHAPE, 0.75).select("event_id", F.col("decision.base_rate").alias("base_rate"), F.col("decision.effective_rate").alias("effective_rate"))


@query(f"with {SHD} select event_id, prot protected, why from ss")
def d8_protection(spark, sf_dir):
    return S.shape(events(spark, sf_dir), SHAPE, 0.75).select("event_id", F.col("decision.protected").alias("protected"), F.col("decision.protection_reason").alias("why"))


@query(f"with {SHD} select event_id, rules, concat_ws(',', case when d1 then 'request_id' end, case when d2 then 'trace_id' end, case when d4 then 'user_id' end) dropped, case when d1 then 'k>key' else '' end renamed, pd payload_dropped, case when not pd then payload end payload from ss")
def d5_shape(spark, sf_dir):
    d = F.col("decision")
    return S.shape(events(spark, sf_dir), SHAPE, 0.75).select("event_id", d["rules"].alias("rules"), F.array_join(d["dropped_tags"], ",").alias("dropped"), F.array_join(d["renamed_tags"], ",").alias("renamed"), d["payload_dropped"].alias("payload_dropped"), F.col("new_payload").alias("payload"))


@query(f"with {SHD} select event_id, keep active_keep, keep2 shadow_keep from ss where keep<>keep2 or d4")
def d9_shaping_diffs(spark, sf_dir):
    return S.shaping_diffs(events(spark, sf_dir), SHAPE, SHAPE2, 0.75).select("event_id", "active_keep", "shadow_keep")


SHB = f"{SHD}, {BYTES_CTE}"
CNT = "count(*) observed, count_if(keep) kept, count_if(not keep) sampled_out, count_if(prot) protected, count_if(d1 or d2 or pd or d4) transformed, count_if(pd) payload_dropped, cast(sum(bytes) as bigint) original_bytes"


@query(f"with {SHB} select tenant_id, epoch_us(date_trunc('minute', event_time)) minute_us, rules, source, event_type, {CNT} from ss join siz using (event_id) group by all")
def a8_shaping_minutes(spark, sf_dir):
    rows = S.shaping_minutes(S.shape(events(spark, sf_dir), SHAPE, 0.75))
    return rows.select("tenant_id", F.unix_micros("minute").alias("minute_us"), "rules", "source", "event_type", "observed", "kept", "sampled_out", "protected", "transformed", "payload_dropped", "original_bytes")


@query(f"with {SHB} select tenant_id, {CNT} from ss join siz using (event_id) where date_trunc('minute', event_time)>=make_timestamp(1704067200000000+300000000) group by tenant_id")
def a9_shaping_summary(spark, sf_dir):
    return S.shaping_summary(S.shaping_minutes(S.shape(events(spark, sf_dir), SHAPE, 0.75)), "2024-01-01 00:05:00").drop("shaped_bytes")


@query(f"with {SHB} select tenant_id, source, {CNT}, count_if(keep)*100.0/count(*) event_retention, case when count_if(prot)=0 then 100.0 else count_if(prot and keep)*100.0/count_if(prot) end protected_retention, count(distinct case when keep then event_type end)*100.0/count(distinct event_type) coverage from ss join siz using (event_id) group by all")
def a10_shaping_preview(spark, sf_dir):
    out = S.shaping_preview(events(spark, sf_dir), SHAPE, 0.75, ["tenant_id", "source"])
    return out.select("tenant_id", "source", "observed", "kept", "sampled_out", "protected", "transformed", "payload_dropped", "original_bytes", "event_retention", "protected_retention", "coverage")


ROUTES = RoutingConfig("r", "1", (Destination("archive", max_attempts=3), Destination("alerts", failure_fallback="archive"), Destination("metrics", base_delay_ms=100, max_delay_ms=900), Destination("off", enabled=False)), (
    RoutingRule("errors", severity=("error",), destinations=("alerts", "archive", "off")), RoutingRule("slow", type="*.duration", destinations=("metrics",), stop=True),
    RoutingRule("prod", tags={"environment": "production"}, destinations=("archive", "metrics")),
), "archive")
ROUTES2 = RoutingConfig("r", "2", ROUTES.destinations, ROUTES.rules[:2], "metrics")
RT = """rr as (select *, coalesce(tag_severity, case when contains(event_type,'error') then 'error' else '' end)='error' m1, event_type like '%.duration' m2, event_type not like '%.duration' and tag_environment='production' m3 from ev),
 rp as (select tenant_id, event_id, 'alerts' destination, 'errors' rules from rr where m1 union all select tenant_id, event_id, 'archive', concat_ws(',', case when m1 then 'errors' end, case when m3 then 'prod' end) from rr where m1 or m3
  union all select tenant_id, event_id, 'metrics', concat_ws(',', case when m2 then 'slow' end, case when m3 then 'prod' end) from rr where m2 or m3 union all select tenant_id, event_id, 'archive', 'fallback' from rr where not (m1 or m2 or m3))"""


@query(f"with {RT} select tenant_id, event_id, destination, rules, case destination when 'archive' then 3 else 5 end max_attempts from rp")
def d10_route(spark, sf_dir):
    return R.route(events(spark, sf_dir), ROUTES).select("tenant_id", "event_id", "destination", "rules", "max_attempts")


@query(f"with {RT}, ra as (select *, list_sort(list_distinct(list_filter([case when m1 then 'alerts' end, case when m1 or m3 or not (m1 or m2 or m3) then 'archive' end, case when m2 or m3 then 'metrics' end], lambda x: x is not null))) a, list_sort(list_distinct(list_filter([case when m1 then 'alerts' end, case when m1 then 'archive' end, case when m2 or not (m1 or m2) then 'metrics' end], lambda x: x is not null))) s from rr) select event_id, array_to_string(list_sort(list_filter(s, lambda x: not list_contains(a,x))),',') added, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(s,x))),',') removed from ra where a<>s")
def d11_route_diffs(spark, sf_dir):
    return R.route_diffs(events(spark, sf_dir), ROUTES, ROUTES2).select("event_id", "added", "removed")


def outbox(spark, sf_dir):
    """Deliveries with attempts behind them, and the outcomes of the next."""
    rows = R.route(events(spark, sf_dir), ROUTES)
    n = F.regexp_extract("event_id", "[0-9]+", 0).cast("long")
    at = F.timestamp_micros(F.lit(1704067200000000) + n * 720000)
    status = F.when(n % 3 == 0, "pending").when(n % 3 == 1, "retry").otherwise("leased")
    rows = rows.withColumns({"attempts": (n % 5).cast("int"), "status": status, "created_at": at, "next_attempt_at": at, "lease_until": at, "last_error": F.lit(None).cast("string")})
    outcomes = rows.where(n % 4 != 0).select("tenant_id", "event_id", "destination", (n % 4 == 1).alias("ok"), (n % 7 != 0).alias("retryable"), F.lit("timeout").alias("error"))
    return rows, outcomes


OB = f"""{RT}, ob as (select *, cast(substr(event_id,5) as bigint) n, case destination when 'archive' then 3 else 5 end ma, case destination when 'metrics' then 100 else 500 end bd, case destination when 'metrics' then 900 else 60000 end md, case destination when 'alerts' then 'archive' else '' end fb from rp),
 oa as (select *, n%5 attempts, case n%3 when 0 then 'pending' when 1 then 'retry' else 'leased' end st, n%4<>0 tried, n%4=1 ok, n%7<>0 retryable from ob),
 oc as (select *, attempts+case when tried then 1 else 0 end at2 from oa), od as (select *, case when not tried then st when ok then 'delivered' when not retryable or at2>=ma then 'dead_letter' else 'retry' end s2 from oc)"""


@query(f"with {OB} select event_id, destination, s2 status, at2 attempts, case when tried and s2='retry' then 1704070800000000+1000*cast(least(bd*pow(2,greatest(at2,1)-1), md) as bigint) else 1704067200000000+n*720000 end next_us from od")
def d12_advance(spark, sf_dir):
    out, _ = R.advance(*outbox(spark, sf_dir), ROUTES, "2024-01-01 01:00:00")
    return out.select("event_id", "destination", "status", "attempts", F.unix_micros("next_attempt_at").alias("next_us"))


@query(f"with {OB} select event_id, fb destination, 'failure_fallback:'||destination rules from od where tried and s2='dead_letter' and fb<>''")
def d12_fallbacks(spark, sf_dir):
    return R.advance(*outbox(spark, sf_dir), ROUTES, "2024-01-01 01:00:00")[1].select("event_id", "destination", "rules")


@query(f"with {OB} select event_id, destination, cast(least(bd*pow(2,greatest(attempts,1)-1), md) as bigint) delay_ms from oa")
def d13_retry_delay(spark, sf_dir):
    rows, _ = outbox(spark, sf_dir)
    return rows.select("event_id", "destination", X.retry_delay_ms(F.col("attempts"), F.col("base_delay_ms"), F.col("max_delay_ms")).alias("delay_ms"))


@query(f"with {OB} select event_id, destination from (select *, row_number() over (partition by destination order by n, tenant_id, event_id) k from oa where n*720000<=1800000000 and (st in ('pending','retry') or (st='leased' and n*720000<1800000000))) where k<=25")
def t6_due_deliveries(spark, sf_dir):
    return R.due_deliveries(outbox(spark, sf_dir)[0], "2024-01-01 00:30:00", 25).select("event_id", "destination")


@query(f"with {OB}, hf as (select tenant_id, destination, ok, n from oa where tried), hl as (select tenant_id, destination, max(n) filter (ok) l from hf group by all) select tenant_id, destination, count_if(not ok and n>coalesce(l,-1)) consecutive_failures, count_if(ok) successes, case when count_if(not ok and n>coalesce(l,-1))>=5 then 'unhealthy' when count_if(not ok and n>coalesce(l,-1))>0 then 'degraded' else 'healthy' end health from hf join hl using (tenant_id, destination) group by all")
def a19_health_fold(spark, sf_dir):
    return R.health_fold(attempts(spark, sf_dir))


def attempts(spark, sf_dir):
    _, outcomes = outbox(spark, sf_dir)
    n = F.regexp_extract("event_id", "[0-9]+", 0).cast("long")
    return outcomes.select("tenant_id", "destination", "ok", n.alias("at"), n.alias("seq"))


@query(f"with {OB} select tenant_id, destination, count_if(s2='pending') pending, count_if(s2='retry') retrying, count_if(s2='delivered') delivered, count_if(s2='dead_letter') dead_letters from od group by all")
def j10_destination_health(spark, sf_dir):
    out, _ = R.advance(*outbox(spark, sf_dir), ROUTES, "2024-01-01 01:00:00")
    dlq = out.where("status = 'dead_letter'").select("tenant_id", "destination")
    return R.destination_health(out, R.health_fold(attempts(spark, sf_dir)), dlq).select("tenant_id", "destination", "pending", "retrying", "delivered", "dead_letters")


@query(f"with {OB} select event_id, destination target from od where s2='dead_letter' and n%5<>0 and n%2=0")
def d14_requeue(spark, sf_dir):
    out, _ = R.advance(*outbox(spark, sf_dir), ROUTES, "2024-01-01 01:00:00")
    n = F.regexp_extract("event_id", "[0-9]+", 0).cast("long")
    dlq = out.where("status = 'dead_letter'").select("event_id", F.when(n % 6 != 0, F.col("destination")).alias("destination"), F.col("destination").alias("topic"), F.concat_ws("/", "event_id", "destination").alias("letter_id"), F.when(n % 5 != 0, F.lit("{}")).alias("event"))
    sent, _ = R.requeue(dlq, dlq.where(n % 2 == 0).select("letter_id"))
    return sent.select("event_id", "target")
