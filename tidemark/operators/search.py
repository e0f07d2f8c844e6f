"""Search requests: filter, sort, page, project; scores and snippets."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from fnmatch import fnmatchcase
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import analyzers
from ..plans import ast as A
from ..plans.dsl import lower
from ..plans.mapping import Mapping
from ..plans.querystring import parse
from .filter import compile_query, split_term_sets

MOST = 10_000
NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


@dataclass
class SearchRequest:
    """``query`` is a query string (native grammar, AND by default) or a JSON query; ``sort`` a list of (field, asc|desc).

    Rows without a sort value come last in either direction; ties fall to ``tie`` in the first sort's direction.
    """

    query: str | dict | None = None
    sort: list[tuple[str, str]] = field(default_factory=list)
    size: int = 20
    start: int = 0
    after: tuple | None = None
    fields: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    start_timestamp: int | None = None
    end_timestamp: int | None = None
    tie: str | None = None
    extra_filters: tuple[str, ...] = ()


def to_ast(query: str | dict | None, mapping: Mapping) -> A.Node:
    if isinstance(query, str):
        return parse(query, mapping.default_fields, "and")
    return lower(query)


def order_by(sort: list[tuple[str, str]], tie: str | None) -> list[Column]:
    if len(sort) > 2:
        raise ValueError("at most two sort fields")
    way = sort[0][1] if sort else "desc"
    every = [*sort, *([(tie, way)] if tie and tie not in dict(sort) else [])]
    return [F.col(f).asc_nulls_last() if w == "asc" else F.col(f).desc_nulls_last() for f, w in every]


def keyset(sort: list[tuple[str, str]], tie: str | None, after: tuple) -> Column:
    """Rows behind the given sort values, with nulls last."""
    way = sort[0][1] if sort else "desc"
    every = [*sort, *([(tie, way)] if tie and tie not in dict(sort) else [])]
    out, same = F.lit(False), F.lit(True)
    for (f, w), v in zip(every, after, strict=True):
        c = F.col(f)
        later = F.lit(False) if v is None else c.isNull() | ((c > F.lit(v)) if w == "asc" else (c < F.lit(v)))
        out |= same & F.coalesce(later, F.lit(False))
        same &= c.eqNullSafe(F.lit(v))
    return out


def matching(df: DataFrame, request: SearchRequest, mapping: Mapping) -> DataFrame:
    """All rows that the request selects, unsorted."""
    node, sets = split_term_sets(to_ast(request.query, mapping), mapping)
    for column, values in sets:
        df = df.join(F.broadcast(df.sparkSession.createDataFrame([(v,) for v in values], f"_term {dict(df.dtypes)[column]}")), F.col(f"`{column}`") == F.col("_term"), "left_semi")  # a request's values
    df = df.filter(compile_query(node, mapping))
    for extra in request.extra_filters:
        df = df.filter(compile_query(parse(extra, mapping.default_fields, "and"), mapping))
    if request.start_timestamp is not None or request.end_timestamp is not None:
        if not mapping.timestamp:
            raise ValueError("the index has no timestamp field")
        t = F.col(mapping.timestamp)
        if request.start_timestamp is not None:
            df = df.filter(t >= F.timestamp_seconds(F.lit(request.start_timestamp)).cast("timestamp_ntz"))
        if request.end_timestamp is not None:
            df = df.filter(t < F.timestamp_seconds(F.lit(request.end_timestamp)).cast("timestamp_ntz"))
    return df


def search(df: DataFrame, request: SearchRequest, mapping: Mapping) -> DataFrame:
    """One page of hits."""
    return page(matching(df, request, mapping), request)


def page(df: DataFrame, request: SearchRequest) -> DataFrame:
    """One page of rows that match."""
    if not (0 <= request.size <= MOST and 0 <= request.start <= MOST):
        raise ValueError(f"size and start lie between 0 and {MOST}")
    if request.after is not None:
        df = df.filter(keyset(request.sort, request.tie, request.after))
    if request.sort or request.tie:
        df = df.orderBy(*order_by(request.sort, request.tie))
    df = df.offset(request.start).limit(request.size) if request.start else df.limit(request.size)
    if request.fields or request.exclude:
        own = [c for c in df.columns if (not request.fields or any(fnmatchcase(c, p) for p in request.fields)) and not any(fnmatchcase(c, p) for p in request.exclude)]
        df = df.select(*own)
    return df


def hits(df: DataFrame, request: SearchRequest, mapping: Mapping, index: str = "", count: bool = True) -> dict[str, Any]:
    """The response envelope; the total costs a second pass and can be left out."""
    rows = [r.asDict(True) for r in search(df, request, mapping).collect()]
    total = matching(df, request, mapping).count() if count else len(rows)
    return {"hits": {"total": {"value": total, "relation": "eq" if count else "gte"}, "hits": [{"_index": index, "_source": r, "sort": [r.get(f) for f, _ in request.sort]} for r in rows]}}


class Scroll:
    """A snapshot of ordered results, read page by page from a written table.

    The rows are sorted once, by a range of sort keys a file, and numbered as they are written; a page is a range of numbers,
    which the statistics of files and row groups find, so that it costs what it holds, wherever it stands.
    """

    PLACE = "_place"

    def __init__(self, df: DataFrame, request: SearchRequest, mapping: Mapping, folder: str):
        own = matching(df, request, mapping)
        if request.after is not None:
            own = own.filter(keyset(request.sort, request.tie, request.after))
        # Numbers are those of the partition, times 2**33, and of the row in it: in order, with gaps between partitions.
        own.orderBy(*order_by(request.sort, request.tie)).withColumn(self.PLACE, F.monotonically_increasing_id()).write.mode("errorifexists").parquet(folder)
        self.spark, self.folder, self.size, self.at = df.sparkSession, folder, request.size, 0
        rows = self.spark.read.parquet(folder)
        self.schema = rows.schema
        parts = rows.groupBy(F.shiftright(self.PLACE, 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a file
        self.parts = [(r["part"] << 33, r["n"]) for r in parts]
        self.total = sum(n for _, n in self.parts)

    def next(self) -> DataFrame:
        low, self.at = self.at, min(self.at + self.size, self.total)
        ranges, begin = [], 0
        for first, n in self.parts:
            a, b = max(low, begin), min(self.at, begin + n)
            if a < b:
                ranges.append(F.col(self.PLACE).between(first + a - begin, first + b - begin - 1))
            begin += n
        rows = self.spark.read.schema(self.schema).parquet(self.folder)
        return rows.filter(reduce(lambda x, y: x | y, ranges) if ranges else F.lit(False)).orderBy(self.PLACE).drop(self.PLACE)


def union_indexes(indexes: dict[str, DataFrame], pattern: str) -> DataFrame:
    """Rows of all indexes that a list like ``a,b*,-c`` selects, with ``_index``; a missing plain name is an error.

    Numbers of several types are widened; a column that is text in one index and something else in another is text in all.
    """
    chosen: list[str] = []
    for p in pattern.split(","):
        if p.startswith("-"):
            chosen = [n for n in chosen if not fnmatchcase(n, p[1:])]
            continue
        own = [n for n in sorted(indexes) if fnmatchcase(n, p)]
        if not own and "*" not in p:
            raise KeyError(f"no index {p}")
        chosen += [n for n in own if n not in chosen]
    if not chosen:
        raise KeyError(f"no index matches {pattern}")
    kinds: dict[str, set[str]] = {}
    for n in chosen:
        for c, kind in indexes[n].dtypes:
            kinds.setdefault(c, set()).add(kind)
    mixed = {c for c, k in kinds.items() if len(k) > 1 and not k <= NUMBERS}
    alike = [indexes[n].select(*[F.col(f"`{c}`").cast("string").alias(c) if c in mixed else F.col(f"`{c}`") for c in indexes[n].columns], F.lit(n).alias("_index")) for n in chosen]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alike)


def _equals(term: str):
    return lambda x: x == F.lit(term)


def bm25(df: DataFrame, column: str, text: str, key: str, analyzer: str = "default", k1: float = 1.2, b: float = 0.75, top: int | None = None) -> DataFrame:
    """(key, score) of rows with any of the terms, or of the ``top`` best (ties by the key); statistics are those of the whole
    table.

    One pass cuts the texts, counts the terms of each, keeps the few rows that have one and observes the statistics, of
    which one row reaches the driver. Rows kept are cached, spilling to disk, and cut again if an executor is lost.
    """
    terms = list(dict.fromkeys(analyzers.tokens_of(analyzer, text)))
    if not terms:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    tokens = analyzers.analyze(analyzer, F.coalesce(F.col(column), F.lit("")))
    # One lambda over the tokens gives length and frequencies, so they are cut once a row.
    counted = F.transform(F.array(tokens), lambda t: F.struct(F.size(t).alias("_len"), *[F.size(F.filter(t, _equals(x))).alias(f"_f{i}") for i, x in enumerate(terms)]))
    seen, places = Observation(), range(len(terms))
    own = df.select(key, F.inline(counted)).observe(seen, F.count(F.lit(1)).alias("n"), F.sum("_len").alias("words"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in places])
    found = own.filter(reduce(lambda x, y: x | y, [F.col(f"_f{i}") > 0 for i in places])).persist()
    found.count()
    s, parts = seen.get, []
    mean = (s["words"] or 0) / max(1, s["n"]) or 1.0
    for i in places:
        f, d = F.col(f"_f{i}").cast("double"), s[f"d{i}"]
        parts.append(F.lit(math.log(1 + (s["n"] - d + 0.5) / (d + 0.5))) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_len") / mean)))
    out = found.select(key, reduce(lambda x, y: x + y, parts).alias("score"))
    return out if top is None else out.orderBy(F.desc(F.round("score", 6)), key).limit(top)


def snippet(column: str, terms: list[str], width: int = 150) -> Column:
    """The text around the first term, with all terms in bold."""
    import re

    any_term = "(?i)(?<![\\p{L}\\p{N}])(" + "|".join(re.escape(t) for t in terms) + ")(?![\\p{L}\\p{N}])"
    c = F.col(column)
    first = F.length(F.regexp_substr(c, F.lit(f"(?is)^.*?(?<![\\p{{L}}\\p{{N}}])(?:{'|'.join(re.escape(t) for t in terms)})(?![\\p{{L}}\\p{{N}}])")))
    start = F.greatest(F.lit(1), first - width // 2)
    return F.when(first.isNotNull(), F.regexp_replace(c.substr(start, F.lit(width)), any_term, "<b>$1</b>"))
