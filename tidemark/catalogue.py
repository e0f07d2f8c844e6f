"""Registry of the engine's demonstration queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analyzers, datetimes, sketch
from .operators import aggs, discovery, docs, scoring, traces
from .operators.filter import compile_query
from .operators.search import Scroll, SearchRequest, bm25, keyset, search, snippet, union_indexes
from .plans import ast as A
from .plans.dsl import lower
from .plans.mapping import Field, Mapping
from .plans.querystring import parse
from .sources import metrics
from .sources.catalog import Index
from .sources.connect import open_source
from .streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
EVENTS = Mapping({"event_id": Field("i64"), "ts": Field("datetime"), "user_id": Field("i64"), "event_type": Field("text", "raw"), "value": Field("f64"), "props": Field("json")}, default_fields=("event_type",), timestamp="ts")
DOCUMENTS = Mapping({"doc_id": Field("i64"), "text": Field("text"), "lang": Field("text", "raw"), "source": Field("text", "raw"), "n_chars": Field("i64")}, default_fields=("text",))

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '' AND strlen(x) <= 255)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, make: Query, sql: str | None = None) -> None:
    _QUERIES[name] = make
    if sql:
        _SQL[name] = sql


def _found(name: str, tbl: str, mapping: Mapping, query: str | dict, where: str, keys: str) -> None:
    """A query over a table whose hits are named by a key."""
    node = (lambda: parse(query, mapping.default_fields, "and")) if isinstance(query, str) else (lambda: lower(query))
    add(name, lambda s, d: table(s, d, tbl).filter(compile_query(node(), mapping)).select(keys), f"SELECT {keys} FROM {tbl} WHERE {where}")


def _events(name: str, query: str | dict, where: str) -> None:
    _found(name, "events", EVENTS, query, where, "event_id")


def _docs(name: str, query: str | dict, where: str) -> None:
    _found(name, "documents", DOCUMENTS, query, where, "doc_id")


def _has(*words: str, how: str = "AND") -> str:
    return "(" + f" {how} ".join(f"list_contains({TOKENS}, '{w}')" for w in words) + ")"


def _phrase(text: str, close: str = "chr(1)") -> str:
    return "contains(chr(1) || array_to_string(" + TOKENS + ", chr(1)) || chr(1), chr(1) || '" + "' || chr(1) || '".join(text.split()) + f"' || {close})"


_events("search_term", "event_type:error", "event_type = 'error'")
_events("search_bool", "event_type:error AND value:>=100 OR event_type:signup", "(event_type = 'error' AND value >= 100) OR event_type = 'signup'")
_events("search_must_not", "-event_type:click AND NOT event_type:view", "event_type NOT IN ('click', 'view')")
_events("search_term_set", "event_type:IN [error purchase]", "event_type IN ('error', 'purchase')")
_events("search_range_num", "value:[10 TO 20}", "value >= 10 AND value < 20")
_events("search_range_date", {"range": {"ts": {"gte": "2024-01-05", "lt": "2024-02-01T00:00:00Z"}}}, "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-02-01'")
_events("search_json_path", "props.k:>=50", "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
_events("search_json_term", {"term": {"props.k": 7}}, "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) = 7")
_events("search_exists", "props.k:*", "json_extract_string(props, '$.k') IS NOT NULL")
_events("search_exists_unknown", "nothing.here:*", "false")
_events("search_bool_msm", {"bool": {"should": [{"term": {"event_type": "error"}}, {"range": {"value": {"gte": 50}}}, {"range": {"user_id": {"lt": 100}}}], "minimum_should_match": 2}}, "CAST(event_type = 'error' AS INT) + CAST(value >= 50 AS INT) + CAST(user_id < 100 AS INT) >= 2")
_events("search_match_none", {"match_none": {}}, "false")
_events("search_prefix", {"prefix": {"event_type": {"value": "pur"}}}, "starts_with(event_type, 'pur')")
_docs("search_fulltext_and", {"match": {"text": {"query": "the of that", "operator": "and"}}}, _has("the", "of", "that"))
_docs("search_fulltext_or", {"match": {"text": "ciónos thenti"}}, _has("ciónos", "thenti", how="OR"))
_docs("search_phrase", 'text:"of the"', _phrase("of the"))
_docs("search_phrase_prefix", 'text:"of the an"*', _phrase("of the an", "''"))
_docs("search_bool_prefix", {"match_bool_prefix": {"text": {"query": "that the an", "operator": "and"}}}, f"{_has('that', 'the')} AND len(list_filter({TOKENS}, lambda x: starts_with(x, 'an'))) > 0")
_docs("search_wildcard", "text:th?re*", f"len(list_filter({TOKENS}, lambda x: regexp_full_match(x, 'th.re.*'))) > 0")
_docs("search_regex", "text:/(ea|nd|er)+/", f"len(list_filter({TOKENS}, lambda x: regexp_full_match(x, '(ea|nd|er)+'))) > 0")
_docs("search_multi_match", {"multi_match": {"query": "en", "fields": ["text", "lang"]}}, f"{_has('en')} OR lang = 'en'")
_docs("search_query_string", {"query_string": {"query": "the -of lang:fr", "fields": ["text"]}}, f"({_has('the')} OR lang = 'fr') AND NOT {_has('of')}")
_docs("search_range_text", {"range": {"lang": {"gt": "en"}}}, "lang > 'en'")
_docs("search_phrase_slop", 'text:"the of"~1', f"""EXISTS (SELECT 1 FROM (SELECT unnest({TOKENS}) AS t, generate_subscripts({TOKENS}, 1) AS p) a, (SELECT unnest({TOKENS}) AS t, generate_subscripts({TOKENS}, 1) AS p) b WHERE a.t = 'the' AND b.t = 'of' AND abs(b.p - 1 - a.p) <= 1)""")
add("search_extra_filters", lambda s, d: search(table(s, d, "events"), SearchRequest("event_type:click", size=10_000, tie="event_id", extra_filters=("value:<5",)), EVENTS).select("event_id"), "SELECT event_id FROM events WHERE event_type = 'click' AND value < 5 ORDER BY event_id DESC LIMIT 10000")

_NULLED = "CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END"


def _nulled(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("value", F.expr(_NULLED))


add("search_not_null", lambda s, d: _nulled(s, d).filter(compile_query(parse("NOT value:>=10"), EVENTS)).select("event_id"), f"SELECT event_id FROM events WHERE NOT coalesce({_NULLED} >= 10, false)")
add("sort_topk", lambda s, d: search(table(s, d, "events"), SearchRequest(sort=[("value", "desc")], size=50, tie="event_id"), EVENTS).select("event_id", "value"), "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id DESC LIMIT 50")
add("sort_two_fields_nulls", lambda s, d: search(_nulled(s, d), SearchRequest(sort=[("event_type", "asc"), ("value", "desc")], size=3000, tie="event_id"), EVENTS).select("event_id", "value"), f"SELECT event_id, {_NULLED} AS value FROM events ORDER BY event_type ASC NULLS LAST, {_NULLED} DESC NULLS LAST, event_id ASC LIMIT 3000")
add("search_after", lambda s, d: _nulled(s, d).filter(keyset([("value", "desc")], "event_id", (50.0, 1000))).select("event_id"), f"SELECT event_id FROM events WHERE {_NULLED} < 50 OR {_NULLED} IS NULL OR ({_NULLED} = 50 AND event_id < 1000)")
add("from_size", lambda s, d: search(table(s, d, "events"), SearchRequest(sort=[("ts", "asc")], size=30, start=40, tie="event_id"), EVENTS).select("event_id"), "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 30 OFFSET 40")
add("bm25_topk", lambda s, d: bm25(table(s, d, "documents"), "text", "instan onheed", "doc_id", top=20).select("doc_id", F.round("score", 6).alias("score")), f"""
WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents), f AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'instan')) AS a, len(list_filter(t, lambda x: x = 'onheed')) AS b FROM t),
s AS (SELECT count(*) AS c, avg(n) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f)
SELECT doc_id, round(ln(1 + (c - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (c - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)), 6) AS score FROM f, s WHERE a > 0 OR b > 0 ORDER BY score DESC, doc_id LIMIT 20""")


def _agg(name: str, request: dict, path: str, sql: str, source: Callable = lambda s, d: table(s, d, "events"), columns: tuple[str, ...] | None = None, rounded: tuple[str, ...] = ()) -> None:
    def make(s: SparkSession, d: str) -> DataFrame:
        out = aggs.aggregate(source(s, d), request)[path]
        return out.select(*[F.round(c, 4).alias(c) if c in rounded else c for c in (columns or out.columns)])

    add(name, make, sql)


_agg("agg_terms", {"kinds": {"terms": {"field": "event_type"}, "aggs": {"v": {"stats": {"field": "value"}}}}}, "kinds", "SELECT event_type AS kinds, count(*) AS doc_count, count(value) AS v_count, min(value) AS v_min, max(value) AS v_max, round(avg(value), 4) AS v_avg, round(sum(value), 4) AS v_sum FROM events GROUP BY 1", rounded=("v_avg", "v_sum"))
_agg("agg_terms_missing", {"b": {"terms": {"field": "value", "missing": -1.0, "size": 20}}}, "b", f"SELECT coalesce({_NULLED}, -1.0) AS b, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", _nulled)
_agg("agg_terms_order_submetric", {"u": {"terms": {"field": "user_id", "size": 5, "order": {"m": "desc"}}, "aggs": {"m": {"max": {"field": "value"}}}}}, "u", "SELECT user_id AS u, count(*) AS doc_count, max(value) AS m FROM events GROUP BY 1 ORDER BY m DESC NULLS LAST, u LIMIT 5")
_agg("agg_multi_terms", {"k": {"multi_terms": {"terms": [{"field": "l_returnflag"}, {"field": "l_linestatus"}]}}}, "k", "SELECT l_returnflag || '|' || l_linestatus AS k, count(*) AS doc_count FROM lineitem GROUP BY 1", lambda s, d: table(s, d, "lineitem"))
_agg("agg_histogram", {"h": {"histogram": {"field": "value", "interval": 50}}}, "h", "WITH g AS (SELECT CAST(floor(value / 50) * 50 AS DOUBLE) AS h, count(*) AS n FROM events GROUP BY 1), e AS (SELECT CAST(unnest(range(CAST(min(h) / 50 AS BIGINT), CAST(max(h) / 50 AS BIGINT) + 1)) * 50 AS DOUBLE) AS h FROM g) SELECT h, coalesce(n, 0) AS doc_count FROM e LEFT JOIN g USING (h)")
_agg("agg_histogram_bounds", {"h": {"histogram": {"field": "value", "interval": 100, "extended_bounds": {"min": -200, "max": 100}}}}, "h", "WITH g AS (SELECT CAST(floor(value / 100) * 100 AS DOUBLE) AS h, count(*) AS n FROM events GROUP BY 1), e AS (SELECT CAST(unnest(range(least(-2, CAST(min(h) / 100 AS BIGINT)), greatest(1, CAST(max(h) / 100 AS BIGINT)) + 1)) * 100 AS DOUBLE) AS h FROM g) SELECT h, coalesce(n, 0) AS doc_count FROM e LEFT JOIN g USING (h)")
_agg("agg_date_histogram", {"d": {"date_histogram": {"field": "ts", "fixed_interval": "30d", "offset": "-4d", "min_doc_count": 1}}}, "d", "SELECT CAST(floor((epoch_ms(ts) + 345600000) / 2592000000) * 2592000000 - 345600000 AS BIGINT) AS d, count(*) AS doc_count FROM events GROUP BY 1")
_agg("agg_date_histogram_gapfill", {"d": {"date_histogram": {"field": "ts", "fixed_interval": "1m"}}}, "d", "WITH g AS (SELECT epoch_ms(ts) // 60000 AS k, count(*) AS n FROM events GROUP BY 1), e AS (SELECT unnest(range(min(k), max(k) + 1)) AS k FROM g) SELECT k * 60000 AS d, coalesce(n, 0) AS doc_count FROM e LEFT JOIN g USING (k)")
_agg("agg_range", {"r": {"range": {"field": "value", "ranges": [{"to": 20}, {"from": 20, "to": 80}, {"from": 80, "to": 1e9, "key": "high"}, {"from": 1e9}]}}}, "r", "SELECT * FROM (SELECT '*-20.0' AS r, count(*) FILTER (value < 20) AS doc_count FROM events UNION ALL SELECT '20.0-80.0', count(*) FILTER (value >= 20 AND value < 80) FROM events UNION ALL SELECT 'high', count(*) FILTER (value >= 80 AND value < 1e9) FROM events UNION ALL SELECT '1000000000.0-*', count(*) FILTER (value >= 1e9) FROM events)")
_COMPOSITE = [{"kind": {"terms": {"field": "event_type"}}}, {"v": {"histogram": {"field": "value", "interval": 100}}}]
_agg("agg_composite_page1", {"c": {"composite": {"sources": _COMPOSITE, "size": 5}}}, "c", "SELECT event_type AS c_kind, CAST(floor(value / 100) * 100 AS DOUBLE) AS c_v, count(*) AS doc_count FROM events GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 5")
_agg("agg_composite_after", {"c": {"composite": {"sources": [{"kind": {"terms": {"field": "event_type"}}}, {"v": {"terms": {"field": "value", "missing_bucket": True}}}], "size": 8, "after": {"kind": "click", "v": None}}}}, "c", f"SELECT event_type AS c_kind, {_NULLED} AS c_v, count(*) AS doc_count FROM events GROUP BY 1, 2 HAVING c_kind > 'click' OR (c_kind = 'click' AND c_v IS NOT NULL) ORDER BY 1, 2 NULLS FIRST LIMIT 8", _nulled)
_agg("agg_stats", {"v": {"stats": {"field": "value"}}}, "", f"SELECT count({_NULLED}) AS v_count, min({_NULLED}) AS v_min, max({_NULLED}) AS v_max, round(avg({_NULLED}), 4) AS v_avg, round(sum({_NULLED}), 4) AS v_sum FROM events", _nulled, rounded=("v_avg", "v_sum"))
_agg("agg_extended_stats", {"q": {"extended_stats": {"field": "l_quantity"}}}, "", "SELECT count(l_quantity) AS q_count, min(l_quantity) AS q_min, max(l_quantity) AS q_max, round(avg(l_quantity), 4) AS q_avg, round(sum(l_quantity), 4) AS q_sum, round(sum(l_quantity * l_quantity), 4) AS q_sum_of_squares, round(var_pop(l_quantity), 4) AS q_variance_population, round(var_samp(l_quantity), 4) AS q_variance_sampling, round(stddev_pop(l_quantity), 4) AS q_std_deviation_population, round(stddev_samp(l_quantity), 4) AS q_std_deviation_sampling, round(avg(l_quantity) + 2 * stddev_pop(l_quantity), 4) AS q_upper, round(avg(l_quantity) - 2 * stddev_pop(l_quantity), 4) AS q_lower FROM lineitem", lambda s, d: table(s, d, "lineitem"), rounded=tuple(f"q_{x}" for x in ("avg", "sum", "sum_of_squares", "variance_population", "variance_sampling", "std_deviation_population", "std_deviation_sampling", "upper", "lower")))
_agg("agg_percentiles", {"p": {"percentiles": {"field": "value", "percents": [50, 95, 99], "exact": True}}}, "", "SELECT round(quantile_cont(value, 0.5), 4) AS p_p50, round(quantile_cont(value, 0.95), 4) AS p_p95, round(quantile_cont(value, 0.99), 4) AS p_p99 FROM events", rounded=("p_p50", "p_p95", "p_p99"))
_agg("agg_cardinality", {"u": {"cardinality": {"field": "user_id", "exact": True}}}, "", "SELECT count(DISTINCT user_id) AS u FROM events")
_agg("agg_cardinality_approx", {"u": {"cardinality": {"field": "user_id", "exact": False}}}, "", "")
_agg("agg_nested_3level", {"a": {"terms": {"field": "o_orderstatus"}, "aggs": {"b": {"terms": {"field": "o_orderpriority", "size": 3}, "aggs": {"c": {"histogram": {"field": "o_totalprice", "interval": 100000, "min_doc_count": 1}}}}}}}, "a>b>c", "WITH r AS (SELECT o_orderstatus AS a, o_orderpriority AS b, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS k FROM orders GROUP BY 1, 2) SELECT a, b, CAST(floor(o_totalprice / 100000) * 100000 AS DOUBLE) AS c, count(*) AS doc_count FROM orders JOIN r ON a = o_orderstatus AND b = o_orderpriority WHERE k <= 3 GROUP BY 1, 2, 3", lambda s, d: table(s, d, "orders"))
_agg("agg_top_hits", {"t": {"terms": {"field": "event_type"}, "aggs": {"h": {"top_hits": {"size": 2, "sort": [{"value": "desc"}, {"event_id": "asc"}]}}}}}, "t>h", "SELECT t, event_id, value FROM (SELECT event_type AS t, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) AS k FROM events) WHERE k <= 2", columns=("t", "event_id", "value"))


def _flagship(s: SparkSession, d: str) -> DataFrame:
    hits = table(s, d, "events").filter(compile_query(parse("event_type:error AND value:>=10", EVENTS.default_fields), EVENTS))
    out = aggs.aggregate(hits, {"kind": {"terms": {"field": "event_type"}, "aggs": {"v": {"stats": {"field": "value"}}}}})["kind"]
    return out.select("kind", "doc_count", "v_count", "v_min", "v_max", F.round("v_avg", 4).alias("v_avg"), F.round("v_sum", 4).alias("v_sum"))


add("flagship", _flagship, "SELECT event_type AS kind, count(*) AS doc_count, count(value) AS v_count, min(value) AS v_min, max(value) AS v_max, round(avg(value), 4) AS v_avg, round(sum(value), 4) AS v_sum FROM events WHERE event_type = 'error' AND value >= 10 GROUP BY 1")
add("trace_find_ids", lambda s, d: discovery.find_trace_ids(table(s, d, "events"), "user_id", "ts", 10), "SELECT user_id, max(ts) AS latest FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
add("trace_spans", lambda s, d: discovery.trace_spans(table(s, d, "events"), "user_id", "ts", 10).select("event_id", "user_id"), "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 10)")
add("trace_services", lambda s, d: discovery.services(table(s, d, "events"), "event_type"), "SELECT DISTINCT event_type FROM events")
add("list_terms", lambda s, d: discovery.list_terms(table(s, d, "documents"), "text", DOCUMENTS, "th", "thf"), f"SELECT DISTINCT term FROM (SELECT unnest({TOKENS}) AS term FROM documents) WHERE term >= 'th' AND term < 'thf'")
add("list_fields", lambda s, d: discovery.field_caps(table(s, d, "documents"), DOCUMENTS, ("*",)), "SELECT * FROM (VALUES ('doc_id', 'long', true, true), ('lang', 'text', true, true), ('n_chars', 'long', true, true), ('source', 'text', true, true), ('text', 'text', true, true)) t(name, type, searchable, aggregatable)")
for _name, _token_sql in (("default", TOKENS), ("whitespace", r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"), ("lowercase", "list_filter([lower(text)], lambda x: strlen(x) <= 255 AND x <> '')")):
    add(f"tokens_{_name}", lambda s, d, n=_name: table(s, d, "documents").select("doc_id", F.size(analyzers.analyze(n, F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(analyzers.analyze(n, F.col("text")), " ")).alias("h")), f"SELECT doc_id, CAST(len({_token_sql}) AS BIGINT) AS n, md5(array_to_string({_token_sql}, ' ')) AS h FROM documents")
add("tokens_ngram", lambda s, d: table(s, d, "events").select("event_id", F.array_join(analyzers.ngram(2, 3)(F.col("event_type")), " ").alias("grams")), "SELECT event_id, array_to_string(flatten([list_filter([substr(event_type, CAST(i AS INT), 2), substr(event_type, CAST(i AS INT), 3)], lambda x, k: len(x) = k + 1) FOR i IN range(1, len(event_type) + 1)]), ' ') AS grams FROM events")
add("tokens_regex", lambda s, d: table(s, d, "documents").select("doc_id", F.size(analyzers.regex("[a-z]{3,}")(F.lower("text"))).cast("long").alias("n")), "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z]{3,}')) AS BIGINT) AS n FROM documents")
add("tokens_source_code", lambda s, d: table(s, d, "documents").select("doc_id", F.size(analyzers.analyze("source_code_default", F.col("text"))).cast("long").alias("n")))
add("tokens_chinese_compatible", lambda s, d: table(s, d, "documents").select("doc_id", F.size(analyzers.analyze("chinese_compatible", F.col("text"))).cast("long").alias("n")), f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n FROM documents")


def _points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))


add("metrics_rollup_avg_of_max", lambda s, d: discovery.rollup(_points(s, d), ["event_type", "user_id"], ["event_type"], F.col("t"), "value", "max", "avg", 3600).withColumn("value", F.round("value", 8)), "SELECT event_type, bin, round(avg(m), 8) AS value FROM (SELECT event_type, user_id, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bin, max(value) AS m FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2")
add("window_start", lambda s, d: _points(s, d).select("event_id", datetimes.window_start(F.col("t") - 1_800_000_000, 900).alias("w")), "SELECT event_id, CAST(floor((floor(epoch(ts)) - 1800000000) / 900) * 900 AS BIGINT) AS w FROM events")
add("series_id", lambda s, d: table(s, d, "events").select("event_id", discovery.series_id("event_type", ["user_id"]).alias("series")))
add("route_hash_mod", lambda s, d: table(s, d, "events").select("event_id", discovery.routing("event_type,hash_mod((user_id),16)").alias("route")))
add("log_shape", lambda s, d: table(s, d, "events").select("event_id", discovery.log_shape(F.col("props")).alias("shape")), r"SELECT event_id, regexp_replace(props, '\d+(\.\d+)?', '<num>', 'g') AS shape FROM events")


def _sketches(s: SparkSession, d: str) -> DataFrame:
    return sketch.build(table(s, d, "events"), ["event_type", "user_id"], "value")


_KEYS = f"CAST(CASE WHEN value < 1 THEN 0 ELSE floor(ln(value) / ln({sketch.GAMMA})) + {sketch.BIAS} END AS BIGINT)"
add("dd_sketch_merge", lambda s, d: sketch.merge(_sketches(s, d), ["event_type"]).select("event_type", F.explode(F.arrays_zip("keys", "counts")).alias("b")).select("event_type", F.col("b.keys").cast("long").alias("key"), F.col("b.counts").alias("n")), f"SELECT event_type, {_KEYS} AS key, count(*) AS n FROM events WHERE value >= 0 GROUP BY 1, 2")
add("dd_quantile", lambda s, d: sketch.merge(_sketches(s, d), ["event_type"]).select("event_type", *[F.round(sketch.quantile(*[F.col(c) for c in ("keys", "counts", "count", "min", "max")], q), 6).alias(n) for n, q in (("p0", 0.0), ("p50", 0.5), ("p99", 0.99), ("p100", 1.0))]), f"""
WITH b AS (SELECT event_type, {_KEYS} AS key, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events WHERE value >= 0 GROUP BY 1, 2),
c AS (SELECT event_type, key, sum(n) OVER (PARTITION BY event_type ORDER BY key) AS seen, sum(n) OVER (PARTITION BY event_type) AS total, min(lo) OVER (PARTITION BY event_type) AS lo, max(hi) OVER (PARTITION BY event_type) AS hi FROM b),
v AS (SELECT event_type, q, min(lo) AS lo, min(hi) AS hi, min(key) AS key FROM c, (VALUES (0.5), (0.99)) t(q) WHERE seen >= floor(q * (total - 1)) + 1 GROUP BY 1, 2),
r AS (SELECT event_type, q, lo, hi, greatest(lo, least(hi, CASE WHEN key = 0 THEN 0 ELSE pow({sketch.GAMMA}, key - {sketch.BIAS}) END)) AS x FROM v)
SELECT event_type, round(min(lo), 6) AS p0, round(max(x) FILTER (q = 0.5), 6) AS p50, round(max(x) FILTER (q = 0.99), 6) AS p99, round(max(hi), 6) AS p100 FROM r GROUP BY 1""")


def _sql_query(name: str, sql: str, tables: tuple[str, ...], duck: str | None = None) -> None:
    def make(s: SparkSession, d: str) -> DataFrame:
        for t in tables:
            table(s, d, t).createOrReplaceTempView(t)
        return s.sql(sql)

    add(name, make, duck or sql)


_sql_query("join_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000", ("orders", "customer", "nation"))
_sql_query("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", ("orders", "customer"))
_sql_query("join_full", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT * FROM nation WHERE n_regionkey < 3) a FULL JOIN (SELECT * FROM nation WHERE n_regionkey > 1) b ON a.n_nationkey = b.n_nationkey", ("nation",))
_sql_query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", ("orders", "customer"))
_sql_query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", ("orders", "customer"))
_sql_query("join_theta", "SELECT r_regionkey, count(*) AS n FROM region JOIN nation ON n_regionkey <= r_regionkey GROUP BY r_regionkey", ("region", "nation"))
_sql_query("window_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders", ("orders",))
_sql_query("window_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s FROM events", ("events",))
_sql_query("window_ntile_first_last", "SELECT n_nationkey, ntile(3) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS t, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS f, round(cume_dist() OVER (PARTITION BY n_regionkey ORDER BY n_name), 4) AS c FROM nation", ("nation",))
_sql_query("setop_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", ("customer", "supplier"))
_sql_query("setop_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", ("customer", "supplier"))
_sql_query("setop_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000", ("nation", "supplier"))
_sql_query("grouping_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", ("lineitem",))
_sql_query("grouping_rollup", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", ("lineitem",))
_sql_query("grouping_sets", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())", ("events",))
_sql_query("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", ("orders",))
_sql_query("subquery_corr", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)", ("part",))
_sql_query("having", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 5", ("events",))
_sql_query("metrics_filter_clause", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS n, max(value) FILTER (WHERE user_id < 100) AS m FROM events GROUP BY event_type", ("events",))
_sql_query("metrics_inlist_group", "SELECT event_type, user_id, max(value) AS m FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' GROUP BY event_type, user_id", ("events",), "SELECT event_type, user_id, max(value) AS m FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY event_type, user_id")


# -- operators on stored indexes: each call writes an index of its own into the shared folder

def _folder(s: SparkSession, name: str) -> str:
    """A new folder where executors and driver both see it: under the shared one, or, on one machine alone, a temporary one."""
    import tempfile
    import uuid

    where = s.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not s.sparkContext.master.startswith("local[") and s.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        where = "file://" + tempfile.gettempdir()
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _indexed(s: SparkSession, d: str, name: str) -> Index:
    """The events as an index with a file or more for each kind and month."""
    index = Index(s, _folder(s, name), "ts", ("event_type",), sort=("event_type", "ts"))
    rows = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    index.append(rows.repartition(16, "event_type", F.month("ts")))
    return index


def _pruned(s: SparkSession, d: str) -> DataFrame:
    index = _indexed(s, d, "prune")
    hits = index.scan("2024-01-10", "2024-02-01", {"event_type": ["error"]})
    return hits.filter("event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-02-01'").select("event_id")


def _retained(s: SparkSession, d: str) -> DataFrame:
    """Files of old and of new events, of which the old ones go."""
    index = Index(s, _folder(s, "retain"), "ts")
    rows = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    index.append(rows.filter("ts < TIMESTAMP '2024-01-15'"))
    index.append(rows.filter("ts >= TIMESTAMP '2024-01-15'"))
    index.retain("2024-01-16", 86_400)
    return index.scan().select("event_id")


def _deleted(s: SparkSession, d: str) -> DataFrame:
    index = _indexed(s, d, "delete")
    index.delete(compile_query(parse("event_type:view AND value:<50", ("event_type",)), EVENTS))
    return index.scan().select("event_id", "event_type")


def _compacted(s: SparkSession, d: str) -> DataFrame:
    index = _indexed(s, d, "compact")
    index.compact(1_000_000, ["event_type", "ts"])
    return index.scan().groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines in a landing folder, streamed into an index and searched."""
    where = _folder(s, "stream")
    table(s, d, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value")).write.text(f"{where}/in")
    raw = open_source(s, {"source_type": "file", "params": {"filepath": f"{where}/in"}}, stream=True)
    mapping = Mapping({"event_id": Field("i64"), "event_type": Field("text", "raw"), "value": Field("f64")})
    index = Index(s, f"{where}/index")
    ingest(docs.split(docs.parse(raw, mapping))[0], index, f"{where}/checkpoint").awaitTermination()
    return search(index.scan(), SearchRequest("event_type:error AND value:>=100", size=10_000, tie="event_id"), mapping).select("event_id", "value")


def _scrolled(s: SparkSession, d: str) -> DataFrame:
    scroll = Scroll(table(s, d, "events"), SearchRequest("event_type:error", sort=[("value", "desc")], size=40, tie="event_id"), EVENTS, _folder(s, "scroll"))
    scroll.next()
    return scroll.next().select("event_id", "value")


add("prune_tags_time", _pruned, "SELECT event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-02-01'")
add("count_metadata", lambda s, d: s.createDataFrame([(_indexed(s, d, "count").count(),)], "n long"), "SELECT count(*) AS n FROM events")
add("list_splits", lambda s, d: _indexed(s, d, "splits").scan(tags={"event_type": ["view"]}).filter("event_type = 'view'").agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("first")), "SELECT count(*) AS n, min(ts) AS first FROM events WHERE event_type = 'view'")
add("retention", _retained, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
add("delete_by_query", _deleted, "SELECT event_id, event_type FROM events WHERE NOT (event_type = 'view' AND value < 50)")
add("compact_equivalence", _compacted, "SELECT event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1")
add("stream_ingest_then_search", _streamed, "SELECT event_id, value FROM events WHERE event_type = 'error' AND value >= 100 ORDER BY event_id DESC LIMIT 10000")
add("scroll_page", _scrolled, "SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY value DESC NULLS LAST, event_id DESC LIMIT 40 OFFSET 40")
_SOURCE = Mapping({"id": Field("i64"), "kind": Field("text", "raw"), "v": Field("f64"), "at": Field("datetime")}, timestamp="at")
add("doc_mapping", lambda s, d: docs.parse(table(s, d, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.col("value").alias("v"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))).alias("value")), _SOURCE).select("id", "kind", "v", F.unix_seconds("at").alias("at"), "_error"), "SELECT event_id AS id, event_type AS kind, value AS v, CAST(floor(epoch(ts)) AS BIGINT) AS at, CAST(NULL AS VARCHAR) AS _error FROM events")
add("dynamic_fields", lambda s, d: table(s, d, "events").withColumn("_source", F.to_json(F.struct(F.struct(F.col("user_id").alias("id")).alias("user")))).filter(compile_query(parse("user.id:17"), Mapping({}, source="_source"))).select("event_id"), "SELECT event_id FROM events WHERE user_id = 17")
add("search_ip_range", lambda s, d: table(s, d, "events").withColumn("ip", F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".7"))).filter(compile_query(parse("ip:[10.0.9.0 TO 10.0.20.255]"), Mapping({"ip": Field("ip")}))).select("event_id"), "SELECT event_id FROM events WHERE user_id % 256 BETWEEN 9 AND 20")
_ALL = Field("concatenate", array=True, of=("event_type", "user_id"))
add("search_concatenate", lambda s, d: table(s, d, "events").withColumn("all", docs.concatenated("all", _ALL, EVENTS)).filter(compile_query(parse("all:(error 17)", operator="and"), Mapping({"all": _ALL}))).select("event_id"), "SELECT event_id FROM events WHERE event_type = 'error' AND user_id = 17")
add("score_bool_boost", lambda s, d: scoring.scored(table(s, d, "documents"), parse("text:instan^2 OR lang:fr^3", operator="or"), DOCUMENTS).select("doc_id", F.round("_score", 6).alias("score")), f"""
WITH t AS (SELECT doc_id, lang, {TOKENS} AS t FROM documents), f AS (SELECT doc_id, lang, len(t) AS n, len(list_filter(t, lambda x: x = 'instan')) AS a FROM t),
s AS (SELECT count(*) AS c, avg(n) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (lang = 'fr') AS dl FROM f)
SELECT doc_id, round(2 * ln(1 + (c - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + CASE WHEN lang = 'fr' THEN 3 * ln(1 + (c - dl + 0.5) / (dl + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75)) ELSE 0 END, 6) AS score FROM f, s WHERE a > 0 OR lang = 'fr'""")
add("snippets", lambda s, d: table(s, d, "documents").filter(F.array_contains(analyzers.default(F.col("text")), "instan")).select("doc_id", snippet("text", ["instan"]).contains("<b>").alias("marked")), f"SELECT doc_id, true AS marked FROM documents WHERE {_has('instan')}")
add("multi_index", lambda s, d: union_indexes({"n-a": table(s, d, "nation").select(F.col("n_name").alias("name")), "n-b": table(s, d, "region").select(F.col("r_name").alias("name"), F.lit(1).alias("extra")), "x": s.range(1)}, "n-*,-x").select("_index", "name", F.col("extra").cast("long").alias("extra")), "SELECT 'n-a' AS _index, n_name AS name, CAST(NULL AS BIGINT) AS extra FROM nation UNION ALL SELECT 'n-b', r_name, 1 FROM region")


def _spans(s: SparkSession, d: str) -> DataFrame:
    """Conversations as traces: a turn is a span."""
    start = F.col("conv_id") * 1000 + F.col("turn")
    return table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("trace_id"), F.concat_ws("-", "conv_id", "turn").alias("span_id"), F.col("role").alias("service_name"), F.lit("turn").alias("span_name"), start.alias("span_start_timestamp_nanos"), (start + 1).alias("span_end_timestamp_nanos"), F.length("text").alias("span_duration_millis"), (F.col("turn") == 0).alias("is_root"), F.lit(1).alias("status_code"), F.create_map(F.lit("role"), "role").alias("attributes"), F.create_map(F.lit("a"), F.lit("b")).alias("resource_attributes"))


add("trace_find_by_tags", lambda s, d: traces.find_trace_ids(_spans(s, d), traces.TraceQuery(tags={"role": "assistant"}, shortest=40, limit=15)).select("trace_id", "latest"), "SELECT CAST(conv_id AS VARCHAR) AS trace_id, max(conv_id * 1000 + turn) AS latest FROM conversations WHERE role = 'assistant' AND length(text) >= 40 GROUP BY conv_id ORDER BY 2 DESC, 1 LIMIT 15")
add("trace_summaries", lambda s, d: traces.summaries(_spans(s, d)).select("trace_id", "n_spans", "n_services"), "SELECT CAST(conv_id AS VARCHAR) AS trace_id, count(*) AS n_spans, count(DISTINCT role) AS n_services FROM conversations GROUP BY conv_id")


def _partial(s: SparkSession, d: str) -> DataFrame:
    """Metric files whose tags differ, read under a declared schema."""
    where = _folder(s, "metrics")
    points = _points(s, d).select(F.col("event_type").alias("metric_name"), F.lit(0).cast("smallint").alias("metric_type"), F.col("t").alias("timestamp_secs"), "value", F.col("user_id").cast("string").alias("host"))
    points.filter("metric_name = 'click'").write.parquet(f"{where}/a")
    points.filter("metric_name = 'view'").drop("host").write.parquet(f"{where}/b")
    return metrics.read_table(s, [f"{where}/a", f"{where}/b"], declared="metric_name string, timestamp_secs bigint, value double, host string, env string")


add("metrics_partial_schema", lambda s, d: _partial(s, d).groupBy("metric_name").agg(F.count("*").alias("n"), F.count("host").alias("with_host"), F.count("env").alias("with_env")), "SELECT event_type AS metric_name, count(*) AS n, CASE WHEN event_type = 'click' THEN count(*) ELSE 0 END AS with_host, CAST(0 AS BIGINT) AS with_env FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
_sql_query("metrics_time_range", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS v FROM events WHERE ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-20 00:00:00' GROUP BY event_type", ("events",), "SELECT event_type, count(*) AS n, round(sum(value), 4) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY event_type")
add("agg_range_open_ends", lambda s, d: aggs.aggregate(table(s, d, "events"), {"r": {"range": {"field": "value", "ranges": [{"from": 20, "to": 80}]}}})["r"], "SELECT * FROM (SELECT '*-20.0' AS r, count(*) FILTER (value < 20) AS doc_count FROM events UNION ALL SELECT '20.0-80.0', count(*) FILTER (value >= 20 AND value < 80) FROM events UNION ALL SELECT '80.0-*', count(*) FILTER (value >= 80) FROM events)")
_agg("agg_metrics", {"a": {"avg": {"field": "value"}}, "s": {"sum": {"field": "value", "missing": 2}}, "n": {"value_count": {"field": "value"}}}, "", f"SELECT round(avg({_NULLED}), 4) AS a, round(sum(coalesce({_NULLED}, 2)), 4) AS s, count({_NULLED}) AS n FROM events", _nulled, rounded=("a", "s"))
add("partition_overflow", lambda s, d: docs.partitioned(table(s, d, "events"), F.col("event_type"), 3).groupBy(F.when(F.col("_partition") == 0, "OTHER").otherwise(F.col("event_type")).alias("part")).agg(F.count("*").alias("n")), "WITH k AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC) AS i FROM k) SELECT CASE WHEN i <= 3 THEN event_type ELSE 'OTHER' END AS part, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")


def _more() -> None:
    from . import catalogue_more  # noqa: F401  adds its queries here


def queries() -> dict[str, Query]:
    _more()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _more()
    return dict(_SQL)
