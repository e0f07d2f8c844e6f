"""The engine's entry points: indexes, documents, search, SQL and traces, as methods over DataFrames.

An engine is a folder: ``indexes/<name>/`` holds an index's files and manifest, and ``configs/`` one row of JSON for each
change of a configuration, so that the latest row of a name tells what holds. Nothing is kept in memory between calls.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import replace
from fnmatch import fnmatchcase
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions import analyzers, sketch
from .functions.datetimes import literal_time, output
from .operators import aggs, discovery, docs, scoring
from .operators.filter import compile_query
from .operators.search import Scroll, SearchRequest, matching, page, snippet, to_ast, union_indexes
from .plans import ast as A
from .plans import config as C
from .plans import sqltext
from .plans.dsl import lower
from .plans.mapping import Field, Mapping
from .plans.querystring import parse
from .sources import formats, metrics
from .sources.catalog import Index
from .sources.connect import open_source
from .streaming.ingest import ingest

MOST = 10_000
#: Where a row lies: its file and its place there. No two rows have the same.
ADDRESS = "_address"


class SearchError(ValueError):
    pass


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- indexes and templates
    def _log(self, kind: str, name: str, body: dict | None) -> None:
        row = [(kind, name, json.dumps(body) if body is not None else None, time.time_ns())]
        self.spark.createDataFrame(row, "kind string, name string, body string, at long").coalesce(1).write.mode("append").parquet(f"{self.root}/configs")

    def _known(self, kind: str) -> dict[str, dict]:
        index = Index(self.spark, self.root)
        if not index.exists("configs"):
            return {}
        rows = self.spark.read.parquet(f"{self.root}/configs").filter(F.col("kind") == kind).groupBy("name").agg(F.max_by("body", "at").alias("body"))
        return {r["name"]: json.loads(r["body"]) for r in rows.collect() if r["body"] is not None}  # configurations, not data

    def create_index(self, config: dict[str, Any]) -> None:
        name = C.load(config).name
        if name in self._known("index"):
            raise C.ConfigError(f"index {name} exists")
        self._log("index", name, config)

    def update_index(self, config: dict[str, Any]) -> None:
        name = C.load(config).name
        self.config(name)
        self._log("index", name, config)

    def delete_index(self, name: str, dry: bool = False) -> list[str]:
        """Forget an index and delete its files; returns their names, and with ``dry`` does no more."""
        index = self.index(name)
        files = [r["file"] for r in index.manifest().select("file").collect()] if index.exists() else []
        if not dry:
            self._log("index", name, None)
            fs, p = index._path(index.path)
            fs.delete(p, True)
        return files

    def indexes(self, pattern: str = "*") -> list[str]:
        return sorted(n for n in self._known("index") if fnmatchcase(n, pattern))

    def config(self, name: str) -> C.IndexConfig:
        known = self._known("index")
        if name not in known:
            raise KeyError(f"no index {name}")
        return C.load(known[name])

    def put_template(self, template: dict[str, Any]) -> None:
        self._log("template", template["template_id"], template)

    def delete_template(self, name: str) -> None:
        self._log("template", name, None)

    def templates(self) -> dict[str, dict]:
        return self._known("template")

    def index(self, name: str) -> Index:
        c = self.config(name)
        return self._index(name, c)

    def _index(self, name: str, c: C.IndexConfig) -> Index:
        texts = {n: f.tokenizer for n, f in c.mapping.fields.items() if f.type == "text" and not f.array and not f.path and f.tokenizer != "raw"}
        return Index(self.spark, f"{self.root}/indexes/{name}", c.mapping.timestamp, c.tags, texts=texts)

    def add_source(self, name: str, source: dict[str, Any]) -> None:
        raw = dict(self.config(name).raw)
        raw["sources"] = [s for s in raw.get("sources", ()) if s["source_id"] != source["source_id"]] + [source]
        self._log("index", name, raw)

    def delete_source(self, name: str, source_id: str) -> None:
        raw = dict(self.config(name).raw)
        raw["sources"] = [s for s in raw.get("sources", ()) if s["source_id"] != source_id]
        self._log("index", name, raw)

    # -- documents
    def _prepared(self, raw: DataFrame, c: C.IndexConfig) -> DataFrame:
        return docs.parse(raw, c.mapping)

    def ingest(self, name: str, documents: DataFrame | Iterable[str | dict], commit: str = "auto") -> dict[str, int]:
        """Documents as JSON text (a DataFrame with ``value``, or a list); how many were taken and refused.

        An unknown index is made if a template fits its name. ``commit`` is auto, wait_for or force: a call ends when its
        files stand in the manifest, so what it wrote is visible at its end in either case. Running streams are waited for
        with ``wait``.
        """
        if commit not in ("auto", "wait_for", "force"):
            raise SearchError(f"unknown commit {commit!r}")
        if name not in self._known("index"):
            config = C.from_template(name, list(self.templates().values()))
            if config is None:
                raise KeyError(f"no index {name}, and no template for it")
            self.create_index(config)
        c = self.config(name)
        if not isinstance(documents, DataFrame):
            documents = self.spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in documents], "value string")
        seen = Observation()
        good, _ = docs.split(self._prepared(documents, c), seen)
        if c.partition_key:
            good = docs.partitioned(good, discovery.routing(c.partition_key), c.max_partitions)
        self.index(name).append(good)
        return {"valid": seen.get["valid"], "refused": seen.get["refused"]}

    def bulk(self, body: str, default_index: str | None = None) -> dict[str, Any]:
        """A bulk body: action and document lines in turn. Returns counts by index."""
        lines = self.spark.createDataFrame([(k, x) for k, x in enumerate(body.split("\n")) if x.strip()], "n long, value string")
        rows = formats.bulk(lines).withColumn("index", F.coalesce("index", F.lit(default_index))).collect()  # one request's lines
        out: dict[str, Any] = {"errors": False, "items": {}}
        for name in dict.fromkeys(r["index"] for r in rows):
            if name is None:
                raise SearchError("a bulk action names no index")
            counts = self.ingest(name, [r["source"] for r in rows if r["index"] == name])
            out["items"][name] = counts
            out["errors"] |= counts["refused"] > 0
        return out

    def start_source(self, name: str, source_id: str, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Run a source of an index as a stream; refused documents go to the index's ``quarantine/``."""
        c = self.config(name)
        raw = open_source(self.spark, c.sources[source_id], stream=True).select("value")
        parsed = self._prepared(raw, c).withColumn(formats.CORRUPT, F.when(F.col(docs.ERROR).isNotNull(), F.col(docs.SOURCE))).drop(docs.ERROR)
        return ingest(parsed, self.index(name), checkpoint, once=once, every=f"{c.commit_seconds} seconds")

    @staticmethod
    def wait(query: StreamingQuery) -> None:
        """Until all that a stream's source holds now is visible."""
        query.processAllAvailable()

    # -- reading
    def table(self, pattern: str, start=None, end=None, query: A.Node | None = None) -> tuple[DataFrame, Mapping]:
        """The rows of all indexes a pattern selects, with ``_index`` and ``_address``, and the union of their mappings.

        Files that cannot hold rows of the time range, the query's tags or the terms that it needs are left out.
        """
        for p in pattern.split(","):
            C.check_pattern(p)
        known = {n: C.load(b) for n, b in self._known("index").items()}
        lazy: dict[str, DataFrame] = {}
        for n in known:
            if any(fnmatchcase(n, p.removeprefix("-")) for p in pattern.split(",")):
                index = self._index(n, known[n])
                if index.exists():
                    low, high = _time_bounds(query, known[n].mapping)
                    rows = index.scan(start or low, end or high, _tag_values(query, known[n]), _terms(query, known[n].mapping))
                    place = F.concat_ws(":", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"))
                else:
                    rows, place = docs.split(docs.parse(self.spark.createDataFrame([], "value string"), known[n].mapping))[0], F.lit(None).cast("string")
                lazy[n] = rows.withColumn(ADDRESS, place)
        df = union_indexes(lazy, pattern)
        return df, self._united([known[n].mapping for n in sorted(lazy)])

    def mapping(self, pattern: str) -> Mapping:
        """The union of the mappings of all indexes a pattern selects."""
        return self._united([self.config(n).mapping for n in sorted(self.resolve(pattern))])

    @staticmethod
    def _united(chosen: list[Mapping]) -> Mapping:
        fields = {k: f for m in reversed(chosen) for k, f in m.fields.items()}
        for k in fields:  # as ``union_indexes`` unites the columns
            kinds = {m.fields[k].type for m in chosen if k in m.fields}
            if len(kinds) > 1:
                fields[k] = Field("f64") if kinds <= {"i64", "f64"} else Field("text", "raw")
        defaults = tuple(dict.fromkeys(f for m in chosen for f in m.default_fields))
        mode = "strict" if all(m.mode == "strict" for m in chosen) else "dynamic"
        return Mapping(fields, mode, defaults, chosen[0].timestamp if chosen else None, "_source")

    def search(self, pattern: str, request: SearchRequest | None = None, aggregations: dict | None = None, count_all: bool = True, snippet_fields: tuple[str, ...] = ()) -> dict[str, Any]:
        """The native search: hits, their number, aggregations and snippets."""
        request = request or SearchRequest()
        began = time.perf_counter()
        start = end = None
        if request.start_timestamp is not None:
            start = str(self.spark.sql(f"SELECT CAST(timestamp_seconds({request.start_timestamp}) AS STRING)").first()[0])
        if request.end_timestamp is not None:
            end = str(self.spark.sql(f"SELECT CAST(timestamp_seconds({request.end_timestamp}) AS STRING)").first()[0])
        df, mapping = self.table(pattern, start, end, to_ast(request.query, Mapping(default_fields=("_",))))
        matched = matching(df, request, mapping)
        # First the addresses of the page's rows, by the columns that select and sort; then the documents there.
        if not request.tie:
            request = replace(request, tie=ADDRESS)
        found = [r[0] for r in page(matched, replace(request, fields=None, exclude=())).select(ADDRESS).collect()]
        sources = self._fetch(found)
        out: dict[str, Any] = {"num_hits": matched.count() if count_all else len(found), "hits": [json.loads(sources[a]) for a in found], "errors": []}
        if snippet_fields:
            terms = [t for s in A.leaves(to_ast(request.query, mapping)) if isinstance(s, A.FullText) for t in analyzers.tokens_of("default", s.text)]
            marked = page(matched, request).select(*[snippet(f, terms).alias(f) for f in snippet_fields]) if terms else None
            out["snippets"] = [r.asDict() for r in marked.collect()] if terms else [{} for _ in found]
        if aggregations:
            out["aggregations"] = aggs.response(matched, aggregations, self.table(pattern, start, end)[0])
        out["elapsed_time_micros"] = int((time.perf_counter() - began) * 1e6)
        return out

    def _fetch(self, addresses: list[str]) -> dict[str, str]:
        """The documents at the addresses of one page (10 000 at most); only their files are read."""
        if not addresses:
            return {}
        rows = [(a, *a.rsplit(":", 1)) for a in addresses]
        wanted = self.spark.createDataFrame([(a, f, int(n)) for a, f, n in rows], "a string, f string, n long")
        own = self.spark.read.parquet(*dict.fromkeys(f for _, f, _ in rows)).select("_source", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("n"))
        return {r["a"]: r["_source"] for r in own.join(F.broadcast(wanted), ["f", "n"]).select("a", "_source").collect()}

    def scroll(self, pattern: str, request: SearchRequest) -> Scroll:
        """A snapshot of all hits in order, to be read page by page; it lies under ``scrolls/`` until it is deleted."""
        df, mapping = self.table(pattern)
        return Scroll(df, request, mapping, f"{self.root}/scrolls/{time.time_ns():x}")

    def plan(self, pattern: str, request: SearchRequest | None = None) -> str:
        """Spark's plan of a search."""
        request = request or SearchRequest()
        df, mapping = self.table(pattern)
        out = page(matching(df, request, mapping), request)
        return sqltext.explain(out)

    def parse_query(self, text: str, fields: tuple[str, ...] = ()) -> A.Node:
        return parse(text, fields or None)

    def analyze(self, text: str, analyzer: str = "default") -> list[str]:
        return self.spark.range(1).select(analyzers.analyze(analyzer, F.lit(text))).first()[0]

    # -- the JSON DSL
    def es_search(self, pattern: str, body: dict[str, Any] | None = None, **url: Any) -> dict[str, Any]:
        """A search with a JSON body; ``q``, ``size``, ``from``, ``sort``, ``track_total_hits``, ``extra_filters`` may come by URL and then win."""
        body = dict(body or {})
        allowed = {"query", "from", "size", "sort", "aggs", "aggregations", "_source", "search_after", "track_total_hits", "fields", "stored_fields", "highlight", "timeout", "docvalue_fields", "pit"}
        if extra := set(body) - allowed:
            raise SearchError(f"unknown keys {sorted(extra)}")
        mapping = self.mapping(pattern)
        node = parse(url["q"], mapping.default_fields, url.get("default_operator", "or")) if url.get("q") else lower(body.get("query"))
        for f in url.get("extra_filters", ()):
            node = A.Bool(must=(node,), filter=(parse(f, mapping.default_fields, "and"),))
        sort = _sorts(url.get("sort", body.get("sort")))
        scored = any(f == "_score" for f, _, _ in sort)
        df, mapping = self.table(pattern, query=None if scored else node)  # scores count the terms of all files
        size, first = int(url.get("size", body.get("size", 10))), int(url.get("from", body.get("from", 0)))
        if not (0 <= size <= MOST and 0 <= first <= MOST):
            raise SearchError(f"from and size lie between 0 and {MOST}")
        matched = scoring.scored(df, node, mapping) if scored else df.filter(compile_query(node, mapping))
        rows, keys = self._hits(matched, sort, size, first, body.get("search_after"))
        track = url.get("track_total_hits", body.get("track_total_hits", True))
        total = {"value": matched.count(), "relation": "eq"} if track is not False else {"value": first + len(rows), "relation": "gte"}
        hits = []
        for r in rows:
            hit = {"_index": r["_index"], "_id": r["_id"], "_score": r.get("_score")}
            if (source := _filtered(json.loads(r["_source"]), body.get("_source", True))) is not None:
                hit["_source"] = source
            if sort:
                hit["sort"] = [r[k] for k in keys]
            hits.append(hit)
        out: dict[str, Any] = {"timed_out": False, "hits": {"total": total, "max_score": max((h["_score"] for h in hits if h["_score"] is not None), default=None), "hits": hits}}
        if wanted := body.get("aggs") or body.get("aggregations"):
            out["aggregations"] = aggs.response(matched, wanted, df)
        return out

    def _hits(self, matched: DataFrame, sort: list[tuple[str, str, str | None]], size: int, first: int, after: list | None) -> tuple[list[dict], list[str]]:
        """One page, found by sort keys and addresses alone; the documents are fetched after.

        A hit's ``_id`` is made of its address, which also breaks ties, so pages follow each other and copies are kept apart.
        """
        own = matched.withColumn("_id", F.concat(F.lower(F.hex(F.xxhash64(F.substring_index(ADDRESS, ":", -2)))), F.lit("-"), F.substring_index(ADDRESS, ":", -1)))
        order, keys, seen, same = [], [], F.lit(False), F.lit(True)
        plan = list(sort)
        if after is not None and len(after) == len(plan) + 1 or not any(f in ("_doc", "_shard_doc") for f, _, _ in plan):
            plan = [*plan, ("_doc", plan[0][1] if plan else "desc", None)]
        for k, (f, way, style) in enumerate(plan):
            name = f"_k{k}"
            c = F.col("_id") if f in ("_doc", "_shard_doc") else F.col("_score") if f == "_score" else _sortable(own, f, style)
            own = own.withColumn(name, c)
            order.append(F.col(name).asc_nulls_last() if way == "asc" else F.col(name).desc_nulls_last())
            if k < len(sort):
                keys.append(name)
            if after is not None and k < len(after):
                v = after[k]
                later = F.lit(False) if v is None else F.col(name).isNull() | ((F.col(name) > F.lit(v)) if way == "asc" else (F.col(name) < F.lit(v)))
                seen |= same & F.coalesce(later, F.lit(False))
                same &= F.col(name).eqNullSafe(F.lit(v))
        if after is not None:
            if len(after) < len(sort):
                raise SearchError("search_after needs a value for each sort field")
            own = own.filter(seen)
        kept = ["_index", "_id", ADDRESS, *keys, *(["_score"] if "_score" in own.columns else [])]
        page = own.orderBy(*order)
        page = (page.offset(first) if first else page).limit(size)
        rows = [r.asDict(True) for r in page.select(*kept).collect()]
        sources = self._fetch([r[ADDRESS] for r in rows])
        return [r | {"_source": sources[r[ADDRESS]]} for r in rows], keys

    def es_msearch(self, requests: Iterable[tuple[dict, dict]]) -> dict[str, Any]:
        """Several searches; one that fails has an error in its place."""
        out = []
        for header, body in requests:
            try:
                index = header.get("index") or "*"
                out.append(self.es_search(index if isinstance(index, str) else ",".join(index), body) | {"status": 200})
            except (KeyError, ValueError) as e:
                out.append({"status": 404 if isinstance(e, KeyError) else 400, "error": {"reason": str(e)}})
        return {"responses": out}

    def es_count(self, pattern: str, body: dict | None = None) -> int:
        """Matching rows; without a query from the manifests alone."""
        if not (body or {}).get("query"):
            return sum(i.count() for i in map(self.index, self.resolve(pattern)) if i.exists())
        node = lower(body["query"])
        df, mapping = self.table(pattern, query=node)
        return df.filter(compile_query(node, mapping)).count()

    def resolve(self, pattern: str) -> list[str]:
        out: list[str] = []
        for p in pattern.split(","):
            own = self.indexes(p.removeprefix("-"))
            if not own and "*" not in p:
                raise KeyError(f"no index {p}")
            out = [n for n in out if n not in own] if p.startswith("-") else out + [n for n in own if n not in out]
        return out

    def field_caps(self, pattern: str, fields: tuple[str, ...] = ("*",)) -> DataFrame:
        df, mapping = self.table(pattern)
        return discovery.field_caps(df, mapping, fields)

    def list_terms(self, pattern: str, field: str, start: str | None = None, end: str | None = None, most: int | None = None) -> DataFrame:
        df, mapping = self.table(pattern)
        return discovery.list_terms(df, field, mapping, start, end, most)

    def cat_indices(self, pattern: str = "*") -> list[dict[str, Any]]:
        """Name, documents, files and bytes of each index, from the manifests."""
        out = []
        for n in self.resolve(pattern):
            index = self.index(n)
            row = index.manifest().agg(F.coalesce(F.sum("num_docs"), F.lit(0)).alias("docs"), F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first().asDict() if index.exists() else {"docs": 0, "files": 0, "bytes": 0}
            out.append({"index": n, "health": "green", "status": "open"} | row)
        return out

    def stats(self, pattern: str = "*") -> dict[str, Any]:
        rows = self.cat_indices(pattern)
        total = {k: sum(r[k] for r in rows) for k in ("docs", "files", "bytes")}
        return {"_all": total, "indices": {r["index"]: {k: r[k] for k in ("docs", "files", "bytes")} for r in rows}}

    def es_mapping(self, pattern: str = "*") -> dict[str, Any]:
        """The fields of each index with their types, nested by their dots."""
        kinds = {"text": "text", "i64": "long", "u64": "unsigned_long", "f64": "double", "bool": "boolean", "datetime": "date", "ip": "ip", "bytes": "binary", "json": "object", "concatenate": "text"}
        out = {}
        for n in self.resolve(pattern):
            top: dict[str, Any] = {}
            for name, f in self.config(n).mapping.fields.items():
                at = top
                *above, last = name.split(".")
                for part in above:
                    at = at.setdefault(part, {"properties": {}}).setdefault("properties", {})
                at[last] = {"type": "keyword" if f.type == "text" and f.tokenizer == "raw" else kinds[f.type]}
            out[n] = {"mappings": {"properties": top}}
        return out

    def es_aliases(self, pattern: str = "*") -> dict[str, Any]:
        """Each index with its aliases, of which there are none."""
        return {n: {"aliases": {}} for n in self.resolve(pattern)}

    def health(self) -> dict[str, Any]:
        return {"status": "green", "timed_out": False, "number_of_indices": len(self.indexes())}

    # -- files and lifecycle
    def splits(self, name: str, start=None, end=None, tags: dict[str, list[str]] | None = None) -> DataFrame:
        return self.index(name).prune(start, end, tags)

    def delete_by_query(self, name: str, query: str | dict) -> None:
        mapping = self.config(name).mapping
        c, node = self.config(name), to_ast(query, mapping)
        self.index(name).delete(compile_query(node, mapping), *_time_bounds(node, mapping), _tag_values(node, c), _terms(node, mapping))

    def retain(self, name: str, now) -> None:
        c = self.config(name)
        if c.retention_seconds is not None:
            self.index(name).retain(now, c.retention_seconds)

    def merge(self, name: str, now=None) -> int:
        c = self.config(name)
        return self.index(name).merge(c.merge, now, c.target_docs)

    def collect_garbage(self, name: str) -> int:
        return self.index(name).collect_garbage()

    # -- SQL
    def sql(self, text: str, explain: bool | str = False) -> DataFrame | str | None:
        """One or several statements over the indexes, each a view of its name; the last one's result or its plan, with
        ``explain="analyze"`` after it ran."""
        for n in self.indexes():
            if n.replace("-", "_").lower() in text.lower().replace("-", "_"):
                self.table(n)[0].drop(ADDRESS).createOrReplaceTempView(n.replace("-", "_"))
        out = None
        sketch.register(self.spark)
        for s in map(sketch.expand, sqltext.statements(text)):
            made = metrics.create_external_table(self.spark, s, self._paths)
            out = made if made is not None else self.spark.sql(s)
        if explain and out is not None:
            return sqltext.analyze(out) if explain == "analyze" else sqltext.explain(out)
        return out

    def _paths(self, location: str) -> list[str]:
        """A location: an index's name, else a path."""
        if location not in self._known("index"):
            return [location]
        return [r["file"] for r in self.index(location).manifest().select("file").collect()]

    def register(self, name: str, function: Callable, returns: str) -> None:
        """A function of one's own for SQL (an Arrow-batched one should be given as a pandas UDF)."""
        self.spark.udf.register(name, function, None if hasattr(function, "evalType") else returns)


def _tag_values(node: A.Node | None, c: C.IndexConfig) -> dict[str, list[str]]:
    """Values that every match has in a raw text field that is a tag: the terms of the outermost conjunction."""
    out: dict[str, list[str]] = {}
    for x in _required(node):
        value = x.value if isinstance(x, A.Term) else x.text if isinstance(x, A.FullText) else None
        if value is not None and x.field in c.tags and c.mapping.fields[x.field].type == "text" and c.mapping.fields[x.field].tokenizer == "raw":
            out.setdefault(x.field, [str(value)])
    return out


def _required(node: A.Node | None) -> tuple[A.Node, ...]:
    """What every match of a query fulfils: the clauses of the outermost conjunctions."""
    if isinstance(node, A.Bool):
        return tuple(y for x in node.must + node.filter for y in _required(x))
    if isinstance(node, A.Boost):
        return _required(node.query)
    return () if node is None else (node,)


def _terms(node: A.Node | None, mapping: Mapping) -> dict[str, list[str]]:
    """Of text fields, the terms that every match has."""
    out: dict[str, list[str]] = {}
    for x in _required(node):
        if isinstance(x, A.FullText) and x.field in mapping.fields and mapping.fields[x.field].type == "text":
            field = mapping.fields[x.field]
            own = analyzers.tokens_of(field.tokenizer, x.text) if x.analyzer in (None, field.tokenizer) else []
            if x.mode in ("and", "phrase", "phrase_or_and") or len(own) == 1 and x.mode == "or":
                out.setdefault(x.field, []).extend(own)
    return out


def _time_bounds(node: A.Node | None, mapping: Mapping) -> tuple[str | None, str | None]:
    """Bounds of the timestamp field that every match keeps, as text; the upper one is exclusive."""
    low = high = None
    for x in _required(node):
        if isinstance(x, A.Range) and x.field == mapping.timestamp and mapping.timestamp and not x.format:
            for bound, side in ((x.lower, "low"), (x.upper, "high")):
                if bound is None:
                    continue
                try:
                    t = literal_time(bound[0])
                except ValueError:
                    continue
                if side == "low":
                    low = max(low or t, t)
                else:
                    t += dt.timedelta(seconds=1)  # whatever the precision
                    high = min(high or t, t)
    return tuple(None if t is None else t.isoformat(sep=" ") for t in (low, high))


def _sorts(spec: Any) -> list[tuple[str, str, str | None]]:
    """(field, direction, format): fields ascend and scores descend by default."""
    if not spec:
        return []
    out = []
    for item in spec.split(",") if isinstance(spec, str) else spec if isinstance(spec, list) else [spec]:
        if isinstance(item, str):
            name, _, way = item.partition(":")
            style = None
        else:
            ((name, body),) = item.items()
            way = body if isinstance(body, str) else body.get("order", "")
            style = None if isinstance(body, str) else body.get("format")
        way = way or ("desc" if name == "_score" else "asc")
        if way not in ("asc", "desc"):
            raise SearchError(f"unknown sort order {way}")
        out.append((name, way, style))
    if len(out) > 2 + any(f in ("_doc", "_shard_doc") for f, *_ in out):
        raise SearchError("at most two sort fields")
    return out


def _sortable(df: DataFrame, field: str, style: str | None):
    kinds = dict(df.dtypes)
    if field not in kinds:
        return F.lit(None).cast("long")  # an unknown field sorts last
    c = F.col(f"`{field}`")
    if kinds[field].startswith("array"):
        return F.get(c, F.lit(0))
    if kinds[field].startswith("timestamp"):
        return output(c, "unix_timestamp_nanos" if style == "epoch_nanos_int" else "unix_timestamp_millis")
    return c


def _filtered(source: dict, spec: Any) -> dict | None:
    """The part of a document that ``_source`` asks for."""
    if spec is False:
        return None
    if spec is True or spec is None:
        return source
    if isinstance(spec, dict):
        keep, drop = spec.get("includes") or spec.get("include") or ["*"], spec.get("excludes") or spec.get("exclude") or []
    else:
        keep, drop = spec, []
    keep, drop = ([p] if isinstance(p, str) else list(p) for p in (keep, drop))

    def walk(node: dict, path: str) -> dict:
        out = {}
        for k, v in node.items():
            name = path + k
            if any(fnmatchcase(name, p) or name.startswith(p + ".") for p in drop):
                continue
            inside = any(fnmatchcase(name, p) or name.startswith(p + ".") for p in keep)
            if isinstance(v, dict):
                below = walk(v, name + ".")
                if below or (inside and not v):
                    out[k] = below
            elif inside:
                out[k] = v
        return out

    return walk(source, "")
