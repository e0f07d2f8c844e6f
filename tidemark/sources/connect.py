"""Sources by configuration: one function from a source's settings to a batch or streaming DataFrame with a ``value`` column.

Files and plain tables need nothing beyond Spark. Message queues use Spark's connectors, which have to be on the class path;
without them Spark names the missing format when the stream starts. Their payload arrives as ``value``, their position as
``_partition`` and ``_offset`` where the connector gives one; the stream's checkpoint keeps positions, so each message is
taken once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, p: dict[str, Any], stream: bool) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    if stream:
        # A notification queue tells which files are new; Spark finds that by listing, a batch at a time.
        reader = reader.option("maxFilesPerTrigger", p.get("files_per_batch", 1000))
    if p.get("pattern"):
        reader = reader.option("pathGlobFilter", p["pattern"])
    return reader.text(p["filepath"]).select("value")


def _kafka(spark: SparkSession, p: dict[str, Any], stream: bool) -> DataFrame:
    client = dict(p.get("client_params", {}))
    options = {"kafka.bootstrap.servers": client.pop("bootstrap.servers"), "subscribe": p["topic"], "startingOffsets": client.pop("auto.offset.reset", "earliest")}
    options |= {f"kafka.{k}": v for k, v in client.items()}
    reader = spark.readStream if stream else spark.read
    if stream and p.get("messages_per_batch"):
        options["maxOffsetsPerTrigger"] = p["messages_per_batch"]
    rows = reader.format("kafka").options(**options).load()
    return rows.select(F.col("value").cast("string").alias("value"), F.col("partition").alias("_partition"), F.col("offset").alias("_offset"))


def _kinesis(spark: SparkSession, p: dict[str, Any], stream: bool) -> DataFrame:
    options = {"kinesis.streamName": p["stream_name"], "kinesis.region": p.get("region", ""), "kinesis.endpointUrl": p.get("endpoint", ""), "kinesis.startingPosition": p.get("start", "TRIM_HORIZON")}
    rows = spark.readStream.format("aws-kinesis").options(**{k: v for k, v in options.items() if v}).load()
    return rows.select(F.col("data").cast("string").alias("value"))


def _pubsub(spark: SparkSession, p: dict[str, Any], stream: bool) -> DataFrame:
    rows = spark.readStream.format("pubsub").options(subscription=p["subscription"], **({"projectId": p["project_id"]} if p.get("project_id") else {})).load()
    return rows.select(F.col("payload").cast("string").alias("value"))


def _pulsar(spark: SparkSession, p: dict[str, Any], stream: bool) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    rows = reader.format("pulsar").options(**{"service.url": p["address"], "topics": ",".join(p["topics"]), "startingOffsets": p.get("start", "earliest")}).load()
    return rows.select(F.col("value").cast("string").alias("value"))


def _stdin(spark: SparkSession, p: dict[str, Any], stream: bool) -> DataFrame:
    lines = p.get("lines")
    return _rows(spark, {"docs": [x.rstrip("\n") for x in (sys.stdin if lines is None else lines)]}, stream)


def _rows(spark: SparkSession, p: dict[str, Any], stream: bool) -> DataFrame:
    return spark.createDataFrame([(d,) for d in p.get("docs", ())], "value string")


def _void(spark: SparkSession, p: dict[str, Any], stream: bool) -> DataFrame:
    if stream:
        return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.col("value").cast("string")).filter(F.lit(False))
    return spark.createDataFrame([], "value string")


KINDS: dict[str, Callable[[SparkSession, dict[str, Any], bool], DataFrame]] = {
    "file": _files, "ingest": _files, "kafka": _kafka, "kinesis": _kinesis, "pubsub": _pubsub, "pulsar": _pulsar,
    "stdin": _stdin, "ingest-cli": _stdin, "ingest-api": _rows, "vec": _rows, "void": _void,
}


def open_source(spark: SparkSession, config: dict[str, Any], stream: bool = False) -> DataFrame:
    """``config``: source_type, params, and optionally transform, a list of SQL expressions.

    A transform that is a boolean keeps the rows for which it is true; any other replaces ``value``.
    """
    kind = config.get("source_type")
    if kind not in KINDS:
        raise ValueError(f"unknown source type {kind!r}; known: {', '.join(sorted(KINDS))}")
    out = KINDS[kind](spark, config.get("params") or {}, stream)
    for expression in config.get("transform") or ():
        if out.select(F.expr(expression).alias("x")).schema["x"].dataType.simpleString() == "boolean":
            out = out.filter(F.expr(expression))
        else:
            out = out.withColumn("value", F.expr(expression).cast("string"))
    return out
