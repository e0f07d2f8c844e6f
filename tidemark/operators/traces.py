"""Traces over spans with the columns that ``sources.formats.otlp_traces`` gives."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .discovery import operations, services

START, TRACE = "span_start_timestamp_nanos", "trace_id"
KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")


@dataclass
class TraceQuery:
    """Times in nanoseconds, start inclusive and end exclusive; durations in milliseconds, both inclusive."""

    service: str | None = None
    operation: str | None = None
    tags: dict[str, str] = field(default_factory=dict)
    start: int | None = None
    end: int | None = None
    shortest: int | None = None
    longest: int | None = None
    limit: int = 20


def _condition(q: TraceQuery) -> Column:
    out = F.lit(True)
    if q.service:
        out &= F.col("service_name") == q.service
    if q.operation:
        out &= F.col("span_name") == q.operation
    for k, v in q.tags.items():
        if k == "error":
            out &= (F.col("status_code") == 2) if str(v).lower() == "true" else (F.coalesce(F.col("status_code"), F.lit(0)) != 2)
        else:
            out &= (F.col("attributes")[k] == str(v)) | (F.col("resource_attributes")[k] == str(v))
    for c, low, high in ((START, q.start, None if q.end is None else q.end - 1), ("span_duration_millis", q.shortest, q.longest)):
        if low is not None:
            out &= F.col(c) >= low
        if high is not None:
            out &= F.col(c) <= high
    return F.coalesce(out, F.lit(False))


def find_trace_ids(spans: DataFrame, q: TraceQuery) -> DataFrame:
    """The traces with a span that matches, newest first by their latest such span; ids break ties."""
    return spans.filter(_condition(q)).groupBy(TRACE).agg(F.max(START).alias("latest")).orderBy(F.desc("latest"), TRACE).limit(q.limit)


def find_traces(spans: DataFrame, q: TraceQuery) -> DataFrame:
    """All spans of the traces found; the list of ids has ``limit`` rows at most, so it is broadcast."""
    return spans.join(F.broadcast(find_trace_ids(spans, q).select(TRACE)), TRACE, "left_semi")


def get_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.filter(F.col(TRACE) == trace_id).orderBy(START, "span_id")


def summaries(spans: DataFrame) -> DataFrame:
    """One row a trace: its root's service and name, its times, how many spans and services, whether any failed."""
    root = F.when(F.col("is_root"), F.struct("service_name", "span_name"))
    return spans.groupBy(TRACE).agg(
        F.min(START).alias("start"), F.max("span_end_timestamp_nanos").alias("end"), F.count("*").alias("n_spans"), F.count_distinct("service_name").alias("n_services"),
        F.max(root).alias("root"), F.coalesce(F.bool_or(F.col("status_code") == 2), F.lit(False)).alias("failed"),
    )


def kinds(spans: DataFrame, service: str) -> DataFrame:
    """(span_name, kind) of a service."""
    own = operations(spans, service, "span_name", "span_kind")
    return own.select("span_name", F.get(F.array(*[F.lit(k) for k in KINDS]), F.coalesce(F.col("span_kind"), F.lit(0))).alias("kind"))


__all__ = ["TraceQuery", "find_trace_ids", "find_traces", "get_trace", "summaries", "kinds", "services"]
