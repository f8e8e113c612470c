"""The canonical view of the ``events`` table, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FLAT = """
select concat('t',cast(user_id%3 as {S})) tenant_id,
 concat('evt-',cast(event_id as {S})) event_id,
 concat('svc-',cast(user_id%4 as {S})) source,
 case event_type when 'error' then 'checkout.error' when 'view' then 'request.duration'
  when 'purchase' then 'payment.latency'
  when 'signup' then case when event_id%50=0 then 'deployment.completed'
                          when event_id%50=25 then 'rollback.completed' else 'audit.signup' end
  else 'debug.click' end event_type,
 {TS} event_time,
 case when event_type in ('view','purchase') then value*5 end metric_value,
 case when event_type in ('view','purchase') then 'ms' end metric_unit,
 case when event_id%10 < 9 then '1.0' else '2.0' end schema_version,
 concat('c-',cast(cast(floor(event_id/5) as bigint) as {S})) correlation_id,
 concat('tr-',cast(cast(floor(event_id/7) as bigint) as {S})) tag_trace_id,
 concat('r-',cast(event_id as {S})) tag_request_id,
 cast(user_id as {S}) tag_user_id,
 {K} tag_k,
 case when user_id%5<3 then 'production' else 'staging' end tag_environment,
 case when event_type='error' then 'error' end tag_severity,
 case when event_type='signup' and event_id%50 in (0,25)
  then concat('v',cast(cast(floor(event_id/50) as bigint) as {S})) end tag_version,
 case when event_type='signup' and event_id%50=25
  then concat('CHG-evt-',cast(event_id-25 as {S})) end tag_rollback_of,
 case when event_id%101=0 then '{{}}' when event_id%97=0
  then concat('{{"k": "',{K},'"}}') else props end payload,
 event_id n
from events
"""
TAGS = ("trace_id", "request_id", "user_id", "k", "environment", "severity", "version", "rollback_of")

DUCK_EV = _FLAT.format(S="varchar", TS="make_timestamp(1704067200000000 + event_id*720000)", K="json_extract_string(props,'$.k')")
_SPARK_EV = _FLAT.format(S="string", TS="timestamp_micros(1704067200000000 + event_id*720000)", K="get_json_object(props,'$.k')").replace("{", "{{").replace("}", "}}").replace("from events", "from {events}")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with a column for each tag."""
    return spark.sql(_SPARK_EV, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as canonical events, with ``n`` (the event's number) at the end."""
    rows = flat(spark, sf_dir)
    pairs = [x for t in TAGS for x in (F.lit(t), F.col(f"tag_{t}"))]
    tags = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return rows.select("event_id", "tenant_id", "source", "event_type", "event_time", tags.alias("tags"), "payload", "metric_value", "metric_unit", "schema_version", F.lit(None).cast("string").alias("schema_url"), "correlation_id", "n")


#: DuckDB predicates over the flat view.
ERR = "(contains(lower(event_type),'error') or coalesce(lower(tag_severity) in ('error','critical','fatal'),false))"
LAT = "(metric_value is not null and lower(metric_unit)='ms' and (contains(lower(event_type),'latency') or contains(lower(event_type),'duration')))"
HIGH = f"({LAT} and metric_value>=1000)"
NORMAL = f"({LAT} and metric_value<500)"
CHANGE = "(contains(event_type,'deploy') or contains(event_type,'rollback') or tag_version is not null or tag_rollback_of is not null)"


def duck(sql: str) -> str:
    """SQL over ``ev`` (the flat view) and ``tg`` (a row for each tag: k, v)."""
    tags = " union all ".join(f"select tenant_id,event_id,source,event_type,event_time,n,'{t}' k,tag_{t} v from ev where tag_{t} is not null" for t in TAGS)
    body = sql.strip()
    head = f"with recursive ev as ({DUCK_EV}), tg as ({tags})"
    return f"{head}, {body[5:]}" if body.lower().startswith("with ") else f"{head} {body}"
