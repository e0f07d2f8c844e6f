"""Terms, fields, counts; traces; metric rollups."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analyzers
from ..functions.datetimes import window_start
from ..plans.mapping import Mapping


def list_terms(df: DataFrame, field: str, mapping: Mapping, start: str | None = None, end: str | None = None, most: int | None = None) -> DataFrame:
    """Distinct terms of a field in order, within [start, end)."""
    f = mapping.fields[field]
    c = F.col(f"`{field}`")
    own = df.select((F.explode(analyzers.analyze(f.tokenizer, c)) if f.type == "text" and not f.array else F.explode(c) if f.array else c).alias("term")).filter("term IS NOT NULL")
    if start is not None:
        own = own.filter(F.col("term") >= F.lit(start))
    if end is not None:
        own = own.filter(F.col("term") < F.lit(end))
    own = own.distinct().orderBy("term")
    return own.limit(most) if most is not None else own


def field_caps(df: DataFrame, mapping: Mapping, patterns: tuple[str, ...] = ("*",)) -> DataFrame:
    """name, type, searchable, aggregatable of the fields that a pattern selects."""
    kinds = {"text": "text", "i64": "long", "u64": "unsigned_long", "f64": "double", "bool": "boolean", "datetime": "date", "ip": "ip", "bytes": "binary", "json": "object"}
    rows = [(n, kinds[f.type], f.type != "bytes", f.fast and f.type != "json") for n, f in sorted(mapping.fields.items()) if any(fnmatchcase(n, p) for p in patterns)]
    return df.sparkSession.createDataFrame(rows, "name string, type string, searchable boolean, aggregatable boolean")


def find_trace_ids(spans: DataFrame, trace: str, time: str, most: int) -> DataFrame:
    """The most recent distinct traces: latest time of each, newest first."""
    return spans.filter(F.col(trace).isNotNull()).groupBy(trace).agg(F.max(time).alias("latest")).orderBy(F.desc("latest"), F.asc(trace)).limit(most)


def trace_spans(spans: DataFrame, trace: str, time: str, most: int) -> DataFrame:
    """All spans of the most recent traces; ``most`` bounds the broadcast side."""
    return spans.join(F.broadcast(find_trace_ids(spans, trace, time, most).select(trace)), trace, "left_semi")


def services(spans: DataFrame, service: str) -> DataFrame:
    return spans.select(service).filter(F.col(service).isNotNull()).distinct().orderBy(service)


def operations(spans: DataFrame, service: str, name: str, kind: str | None = None) -> DataFrame:
    own = spans.filter(F.col("service_name") == service) if "service_name" in spans.columns else spans
    keys = [name] + ([kind] if kind else [])
    return own.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys).orderBy(*keys)


_AGGS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def rollup(points: DataFrame, series: list[str], by: list[str], time: Column, value: str, inner: str, outer: str, seconds: int) -> DataFrame:
    """Two levels: each series' ``inner`` in each bin of time, then ``outer`` over the series of a group."""
    bins = points.withColumn("bin", window_start(time, seconds))
    first = bins.groupBy(*dict.fromkeys([*series, *by]), "bin").agg(_AGGS[inner](value).alias("_v"))
    return first.groupBy(*by, "bin").agg(_AGGS[outer]("_v").alias("value"))


def series_id(name: str, tags: list[str]) -> Column:
    """A stable id of a time series over its name and its tags that are not null."""
    pairs = F.array_sort(F.filter(F.array(*[F.when(F.col(t).isNotNull(), F.concat(F.lit(t + "="), F.col(t).cast("string"))) for t in tags]), lambda x: x.isNotNull()))
    return F.xxhash64(F.col(name), F.array_join(pairs, "\x01"))


def routing(expression: str) -> Column:
    """A partition key such as ``tenant,hash_mod((a,b),100)`` as one long column."""
    import re

    parts = []
    for m in re.finditer(r"hash_mod\(\s*(\([^)]*\)|[\w.]+)\s*,\s*(\d+)\s*\)|([\w.]+)", expression):
        if m[1]:
            names = [x.strip() for x in m[1].strip("()").split(",")]
            parts.append(F.pmod(F.xxhash64(*[F.col(n) for n in names]), F.lit(int(m[2]))).cast("string"))
        else:
            parts.append(F.coalesce(F.col(m[3]).cast("string"), F.lit("")))
    if not parts:
        raise ValueError(f"{expression!r} is no routing expression")
    return F.xxhash64(*parts)


def log_shape(c: Column) -> Column:
    """A log line with its numbers, addresses and ids replaced by their kind."""
    for pattern, name in ((r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"), (r"\b\d{1,3}(\.\d{1,3}){3}\b", "<ip>"), (r"\b0x[0-9a-fA-F]+\b", "<hex>"), (r"\d+(\.\d+)?", "<num>")):
        c = F.regexp_replace(c, pattern, name)
    return c
