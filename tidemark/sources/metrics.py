"""Metric points and sketches: OTLP input, tables whose files may differ in their tag columns, and SQL names for them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import _KV, _attributes

POINTS = "metric_name string, metric_type smallint, timestamp_secs bigint, value double"
SKETCHES = "metric_name string, timestamp_secs bigint, count bigint, sum double, min double, max double, flags int, keys array<smallint>, counts array<bigint>"
#: Tags that are columns of their own; the order is that of the sort key.
TAGS = ("service", "env", "datacenter", "region", "host")
TYPES = {"gauge": 0, "sum": 1}

_NUMBER = f"array<struct<timeUnixNano: string, asDouble: double, asInt: string, attributes: {_KV}>>"
_METRICS = f"resourceMetrics array<struct<resource: struct<attributes: {_KV}>, scopeMetrics: array<struct<metrics: array<struct<name: string, gauge: struct<dataPoints: {_NUMBER}>, sum: struct<dataPoints: {_NUMBER}>>>>>>>"


def otlp_metrics(df: DataFrame, column: str = "value", tags: tuple[str, ...] = TAGS) -> DataFrame:
    """One row a data point of gauges and sums in OTLP JSON requests; a point's attribute wins over its resource's."""
    own = df.select(F.explode(F.from_json(column, _METRICS)["resourceMetrics"]).alias("r"))
    own = own.select(_attributes(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeMetrics").alias("s"))
    own = own.select("resource", F.explode("s.metrics").alias("m"))

    def tagged(kind: str) -> Column:
        points = F.coalesce(F.col(f"m.{kind}.dataPoints"), F.array().cast(_NUMBER))
        return F.transform(points, lambda p: F.struct(F.lit(TYPES[kind]).cast("smallint").alias("kind"), p.alias("p")))

    points = F.concat(*[tagged(k) for k in TYPES])
    own = own.select("resource", F.col("m.name").alias("metric_name"), F.explode(points).alias("d"))
    own = own.select("metric_name", F.col("d.kind").alias("metric_type"), F.col("d.p").alias("p"), F.map_concat(F.map_filter("resource", lambda k, _: ~F.array_contains(F.map_keys(_attributes(F.col("d.p.attributes"))), k)), _attributes(F.col("d.p.attributes"))).alias("tag"))
    values = [F.floor(F.col("p.timeUnixNano").cast("long") / 1_000_000_000).alias("timestamp_secs"), F.coalesce(F.col("p.asDouble"), F.col("p.asInt").cast("double")).alias("value")]
    named = [F.coalesce(F.col("tag")["service.name"], F.col("tag")[t]).alias(t) if t == "service" else F.col("tag")[t].alias(t) for t in tags]
    return own.select("metric_name", "metric_type", *values, *named)


def read_table(spark: SparkSession, paths: list[str], kind: str = "metrics", declared: str | None = None) -> DataFrame:
    """Files of one table. Tag columns that a file lacks are null; declared columns, if any, are all that is read.

    Without a declaration the files' columns are united, which reads every footer once.
    """
    base = {"metrics": POINTS, "sketches": SKETCHES}[kind]
    if declared is not None:
        return spark.read.schema(declared or base).parquet(*paths)
    if not paths:
        return spark.createDataFrame([], base)
    return spark.read.option("mergeSchema", "true").parquet(*paths)


_CREATE = re.compile(r"\s*CREATE\s+(?:OR\s+REPLACE\s+)?EXTERNAL\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"`]+)\s*(?:\((.*?)\))?\s*STORED\s+AS\s+(metrics|sketches)\s+LOCATION\s+'([^']+)'\s*;?\s*$", re.I | re.S)
_TYPES = {"VARCHAR": "STRING", "TEXT": "STRING", "UTF8": "STRING", "TINYINT UNSIGNED": "SMALLINT", "BIGINT UNSIGNED": "BIGINT", "INT UNSIGNED": "BIGINT", "SMALLINT UNSIGNED": "INT"}


def create_external_table(spark: SparkSession, sql: str, resolve=None) -> DataFrame | None:
    """Run ``CREATE EXTERNAL TABLE ... STORED AS metrics|sketches LOCATION '...'``; None if the text is no such statement.

    ``resolve`` turns a location, such as an index's name, into paths.
    """
    m = _CREATE.match(sql)
    if not m:
        return None
    columns = None
    if m[2]:
        parts = []
        for part in re.split(r",(?![^<(]*[>)])", m[2]):
            name, _, kind = re.sub(r"\s+NOT\s+NULL\s*$", "", part.strip(), flags=re.I).partition(" ")
            parts.append(f"{name.strip('`').strip(chr(34))} {_TYPES.get(kind.strip().upper(), kind.strip())}")
        columns = ", ".join(parts)
    out = read_table(spark, resolve(m[4]) if resolve else [m[4]], m[3].lower(), columns)
    out.createOrReplaceTempView(m[1].strip('"`').split(".")[-1].strip('"`'))
    return out


def sort_key(schema: str) -> list[tuple[str, bool]]:
    """``a|-b|timestamp_secs/V2`` -> [(column, ascending)]: a sign sets the direction; time columns descend without one."""
    text, _, version = schema.partition("/")
    if version and not re.fullmatch(r"V\d+", version):
        raise ValueError(f"unknown version of a sort schema: {version}")
    out = []
    for part in text.split("|"):
        name = part.strip("+-")
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"{part!r} is no sort column")
        signs = part.replace(name, "")
        out.append((name, signs == "+" if signs else not name.startswith("timestamp")))
    return out


def sorted_for(df: DataFrame, schema: str) -> DataFrame:
    """Rows of each partition in the order of a sort schema, nulls last; columns that the table lacks are passed over."""
    keys = [(c, up) for c, up in sort_key(schema) if c in df.columns]
    return df.sortWithinPartitions(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys])


def series_key(df: DataFrame, schema: str) -> Column:
    """A binary key whose order, byte by byte, is that of a sort schema's columns, nulls last; for sorts and range splits by
    one column, and for streams that group rows of a series as they come.

    A column is a byte for null or not, then its value: text with a 0 1 for each zero byte and 0 0 at its end, numbers as
    eight bytes that sort as they do; of a descending column all bytes of the value are turned over.
    """
    kinds, parts = dict(df.dtypes), []
    for name, up in sort_key(schema):
        if name not in kinds:
            continue
        c = F.col(f"`{name}`")
        if kinds[name] == "string":
            text = F.hex(F.encode(F.replace(c, F.lit("\0"), F.lit("\0\1")), "utf-8"))
            digits = F.concat(text, F.lit("0000"))
        elif kinds[name] in ("tinyint", "smallint", "int", "bigint"):
            digits = F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
        else:
            raise ValueError(f"{name}: keys of {kinds[name]} columns are not defined")
        if not up:
            digits = F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210")
        parts.append(F.when(c.isNull(), F.lit("02")).otherwise(F.concat(F.lit("01"), digits)))
    return F.unhex(F.concat(*parts)) if parts else F.unhex(F.lit(""))
