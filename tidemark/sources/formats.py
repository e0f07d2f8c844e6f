"""Input formats: NDJSON, plain text, bulk bodies, OTLP logs and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KV = "array<struct<key: string, value: struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>>>"
OTLP_LOGS = f"resourceLogs array<struct<resource: struct<attributes: {_KV}>, scopeLogs: array<struct<scope: struct<name: string, version: string>, logRecords: array<struct<timeUnixNano: string, observedTimeUnixNano: string, severityNumber: int, severityText: string, body: struct<stringValue: string>, attributes: {_KV}, traceId: string, spanId: string, flags: int>>>>>>"
OTLP_TRACES = f"resourceSpans array<struct<resource: struct<attributes: {_KV}>, scopeSpans: array<struct<scope: struct<name: string, version: string>, spans: array<struct<traceId: string, spanId: string, parentSpanId: string, name: string, kind: int, startTimeUnixNano: string, endTimeUnixNano: string, attributes: {_KV}, status: struct<code: int, message: string>>>>>>>"
CORRUPT = "_corrupt_record"


def ndjson(spark: SparkSession, path: str, schema: T.StructType | str | None = None, stream: bool = False, **options) -> DataFrame:
    """JSON lines; lines that fit no schema keep their text in ``_corrupt_record``."""
    if schema is not None:
        own = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if CORRUPT not in own.fieldNames():
            own = T.StructType([*own.fields, T.StructField(CORRUPT, T.StringType())])
        reader = (spark.readStream if stream else spark.read).schema(own)
    else:
        reader = spark.readStream if stream else spark.read
    return reader.options(columnNameOfCorruptRecord=CORRUPT, **options).json(path)


def valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents, and the lines that are none."""
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def plain_text(spark: SparkSession, path: str, name: str = "plain_text", stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).text(path).withColumnRenamed("value", name)


def bulk(lines: DataFrame, line: str = "value", order: str = "n") -> DataFrame:
    """(action, index, id, source) of a bulk body: action lines each followed by a document line.

    ``order`` numbers the lines of the one body, which is read as a whole; it comes from a request, not from a table.
    """
    from pyspark.sql import Window

    own = lines.filter(F.length(F.trim(line)) > 0)
    own = own.withColumn("_doc", F.lead(line).over(Window.orderBy(order)))
    act = F.from_json(line, "create struct<_index: string, _id: string>, index struct<_index: string, _id: string>")
    own = own.withColumn("_k", F.row_number().over(Window.orderBy(order)) % 2).filter("_k = 1").withColumn("_a", act)
    which = F.coalesce("_a.create", "_a.index")
    return own.select(F.when(F.col("_a.create").isNotNull(), "create").otherwise("index").alias("action"), which["_index"].alias("index"), which["_id"].alias("id"), F.col("_doc").alias("source"))


def _attributes(c: Column) -> Column:
    text = lambda kv: F.coalesce(kv["value"]["stringValue"], kv["value"]["intValue"], kv["value"]["doubleValue"].cast("string"), kv["value"]["boolValue"].cast("string"))
    return F.map_from_entries(F.transform(F.coalesce(c, F.array().cast(_KV)), lambda kv: F.struct(kv["key"].alias("key"), text(kv).alias("value"))))


def otlp_logs(df: DataFrame, column: str = "value") -> DataFrame:
    """One row a log record from OTLP JSON requests."""
    own = df.select(F.explode(F.from_json(column, OTLP_LOGS)["resourceLogs"]).alias("r"))
    own = own.select(_attributes(F.col("r.resource.attributes")).alias("resource_attributes"), F.explode("r.scopeLogs").alias("s"))
    own = own.select("resource_attributes", "s.scope", F.explode("s.logRecords").alias("l"))
    return own.select(
        F.col("l.timeUnixNano").cast("long").alias("timestamp_nanos"), F.col("l.observedTimeUnixNano").cast("long").alias("observed_timestamp_nanos"), F.coalesce(F.col("resource_attributes")["service.name"], F.lit("unknown_service")).alias("service_name"),
        F.col("l.severityText").alias("severity_text"), F.col("l.severityNumber").alias("severity_number"), F.col("l.body.stringValue").alias("body"), _attributes(F.col("l.attributes")).alias("attributes"), "resource_attributes",
        F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"), F.col("l.flags").alias("trace_flags"), F.col("scope.name").alias("scope_name"), F.col("scope.version").alias("scope_version"),
    )


def otlp_traces(df: DataFrame, column: str = "value") -> DataFrame:
    """One row a span from OTLP JSON requests."""
    own = df.select(F.explode(F.from_json(column, OTLP_TRACES)["resourceSpans"]).alias("r"))
    own = own.select(_attributes(F.col("r.resource.attributes")).alias("resource_attributes"), F.explode("r.scopeSpans").alias("s"))
    own = own.select("resource_attributes", "s.scope", F.explode("s.spans").alias("p"))
    start, end = F.col("p.startTimeUnixNano").cast("long"), F.col("p.endTimeUnixNano").cast("long")
    return own.select(
        F.col("p.traceId").alias("trace_id"), F.col("p.spanId").alias("span_id"), F.col("p.parentSpanId").alias("parent_span_id"), F.coalesce(F.col("resource_attributes")["service.name"], F.lit("unknown_service")).alias("service_name"),
        F.col("p.name").alias("span_name"), F.col("p.kind").alias("span_kind"), start.alias("span_start_timestamp_nanos"), end.alias("span_end_timestamp_nanos"), F.floor((end - start) / 1_000_000).alias("span_duration_millis"),
        _attributes(F.col("p.attributes")).alias("attributes"), "resource_attributes", F.coalesce(F.col("p.parentSpanId"), F.lit("")).isin("", "0" * 16).alias("is_root"), F.col("p.status.code").alias("status_code"),
    )
