"""Sources: canonical events, OTLP JSON, change records; decoding with dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.functions import exprs as X
from obsflow.schema import CONTROL, EVENT

_ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
_LOGS = f"struct<resourceLogs:array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeLogs:array<struct<scope:struct<name:string>,schemaUrl:string,logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityText:string,traceId:string,spanId:string,body:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>,attributes:{_ATTRIBUTES}>>>>>>>"
_POINTS = f"struct<dataPoints:array<struct<timeUnixNano:string,asDouble:string,asInt:string,attributes:{_ATTRIBUTES}>>>"
_METRICS = f"struct<resourceMetrics:array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeMetrics:array<struct<scope:struct<name:string>,schemaUrl:string,metrics:array<struct<name:string,unit:string,description:string,gauge:{_POINTS},sum:{_POINTS}>>>>>>>"


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Canonical events from Parquet or JSON lines, with their schema declared."""
    return spark.read.schema(EVENT).format(fmt).load(path)


def stream_events(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream of files."""
    return spark.readStream.schema(EVENT).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Raw records of a topic, for :func:`decode_split`; needs Spark's Kafka package."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset")


def decode_split(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, topic, partition, offset) as events, and dead letters of what isn't JSON."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT) + ", _corrupt string"
    rows = raw.withColumn("_e", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_e").isNull() | F.col("_e._corrupt").isNotNull()
    ok = rows.where(~bad).select(*(F.col(f"_e.{f.name}").alias(f.name) for f in EVENT))
    letters = rows.where(bad).select(F.col("value").alias("raw"), "topic", "partition", "offset", F.lit("permanent").alias("class"), F.lit("undecodable JSON").alias("error"), F.lit(1).alias("attempts"))
    return ok, letters


def _text(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))


def _tags(attributes: Column) -> Column:
    """Attributes as a map; of a repeated key the last value."""
    named = F.filter(F.coalesce(attributes, F.expr(f"cast(array() as {_ATTRIBUTES})")), lambda a: a["key"].isNotNull() & _text(a["value"]).isNotNull())
    keys = F.array_distinct(F.transform(named, lambda a: a["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: _text(F.element_at(F.filter(named, lambda a: a["key"] == k), -1)["value"])))


def _time(*nanos: Column) -> Column:
    told = F.coalesce(*(F.when(n.cast("decimal(20,0)") > 0, n.cast("decimal(20,0)")) for n in nanos))
    return F.timestamp_micros(F.floor(told / 1000).cast("long"))


def _source(tags: Column, scope: Column) -> Column:
    return F.coalesce(X.filled(tags["service.name"]), X.filled(scope), F.lit("otlp"))


def flatten_otlp_logs(df: DataFrame) -> DataFrame:
    """One event for each log record of the requests in ``value``. A record's attributes override its resource's."""
    rows = df.select(F.explode(F.from_json("value", _LOGS)["resourceLogs"]).alias("r")).withColumn("rt", _tags(F.col("r.resource.attributes")))
    rows = rows.select("rt", F.explode("r.scopeLogs").alias("s")).select("rt", "s", F.explode("s.logRecords").alias("l"))
    own = _tags(F.col("l.attributes"))
    rows = rows.withColumn("own", own)
    extra = F.map_filter(F.create_map(F.lit("severity"), X.filled(F.col("l.severityText")), F.lit("trace_id"), F.col("l.traceId"), F.lit("span_id"), F.col("l.spanId")), lambda k, v: v.isNotNull() & (v != ""))
    kind = F.coalesce(*(X.filled(F.col("own")[k]) for k in ("event.name", "event.type", "log.type")), F.lit("otel.log"))
    return rows.select(
        _source(F.col("rt"), F.col("s.scope.name")).alias("source"), kind.alias("event_type"), _time(F.col("l.timeUnixNano"), F.col("l.observedTimeUnixNano")).alias("event_time"),
        X.overlay(X.overlay(F.col("rt"), F.col("own")), extra).alias("tags"), F.to_json(F.struct(_text(F.col("l.body")).alias("body"))).alias("payload"),
        F.lit("otlp-json-v1").alias("schema_version"), F.col("s.schemaUrl").alias("schema_url"), F.trim("l.traceId").alias("correlation_id"),
    )


def flatten_otlp_metrics(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of gauge and sum points, and the number of rejected points and metrics."""
    rows = df.select(F.explode(F.from_json("value", _METRICS)["resourceMetrics"]).alias("r")).withColumn("rt", _tags(F.col("r.resource.attributes")))
    rows = rows.select("rt", F.explode("r.scopeMetrics").alias("s")).select("rt", "s", F.explode("s.metrics").alias("m"))
    points = F.coalesce(F.col("m.gauge.dataPoints"), F.col("m.sum.dataPoints"))
    rows = rows.withColumn("p", F.explode_outer(points)).withColumn("v", F.coalesce(F.expr("try_cast(p.asDouble as double)"), F.expr("try_cast(p.asInt as double)")))
    good = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")) & X.filled(F.col("m.name")).isNotNull()
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    told = F.map_filter(F.create_map(F.lit("otel.metric.description"), F.col("m.description")), lambda k, v: v.isNotNull() & (v != ""))
    events = rows.where("good").select(
        _source(F.col("rt"), F.col("s.scope.name")).alias("source"), F.trim("m.name").alias("event_type"), _time(F.col("p.timeUnixNano")).alias("event_time"),
        X.overlay(X.overlay(F.col("rt"), _tags(F.col("p.attributes"))), told).alias("tags"), F.col("v").alias("metric_value"), F.col("m.unit").alias("metric_unit"),
        F.lit("otlp-json-v1").alias("schema_version"), F.col("s.schemaUrl").alias("schema_url"),
    )
    return events, rows.agg(F.count_if(~F.col("good")).alias("rejected"))


def changes_to_events(df: DataFrame, now, control: str = CONTROL) -> tuple[DataFrame, DataFrame]:
    """Change records (tenant_id, event_id, source, kind, status, tags, changed_at, ...) as events, and those refused: more than five minutes ahead."""
    late = F.col("changed_at") > F.lit(now).cast("timestamp") + F.expr("interval 5 minutes")
    status = F.coalesce(X.filled(F.lower("status")), F.lit("completed"))
    kind = F.when(F.col("kind").isin("feature_flag", "configuration"), F.concat("kind", F.lit("."), F.when(status == "completed", "changed").otherwise(status))).otherwise(F.concat("kind", F.lit("."), status))
    own = F.map_filter(
        F.create_map(F.lit(control + "change_id"), F.coalesce(X.filled(F.col("change_id")), F.concat(F.lit("CHG-"), "event_id")), F.lit(control + "change_kind"), F.col("kind"), F.lit(control + "change_status"), status, F.lit(control + "version"), F.col("version"), F.lit(control + "rollback_of"), F.col("rollback_of")),
        lambda k, v: v.isNotNull() & (v != ""),
    )
    tags = X.overlay(F.coalesce("tags", F.create_map().cast("map<string,string>")), own)
    ok = df.where(~late).select("tenant_id", "event_id", "source", kind.alias("event_type"), F.col("changed_at").alias("event_time"), tags.alias("tags"), F.lit("change-v1").alias("schema_version"))
    return ok, df.where(late)
