"""Further registered queries: clauses of the JSON DSL, golden rows of the semantics, formats, functions, joins, engine calls."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import EVENTS, TOKENS, _docs, _events, _folder, _has, _phrase, _sql_query, add, table
from .engine import Engine
from .functions import analyzers, datetimes
from .operators import aggs, discovery, docs
from .operators.filter import compile_query
from .operators.search import SearchRequest, search, snippet
from .plans.dsl import lower
from .plans.mapping import Field, Mapping
from .plans.querystring import parse
from .plans.sqltext import run
from .sources import formats, metrics
from .sources.catalog import Index
from .sources.connect import open_source
from .streaming.ingest import with_window

# -- clauses of the DSL
_events("dsl_terms", {"terms": {"event_type": ["error", "signup"]}}, "event_type IN ('error', 'signup')")
_events("dsl_exists", {"exists": {"field": "props.k"}}, "json_extract_string(props, '$.k') IS NOT NULL")
_events("dsl_exists_json_root", {"exists": {"field": "props"}}, "props IS NOT NULL AND props <> '{}'")
_events("dsl_term_any_case", {"term": {"event_type": {"value": "ERROR", "case_insensitive": True}}}, "lower(event_type) = 'error'")
_events("dsl_bool_all_parts", {"bool": {"must": [{"range": {"value": {"gt": 20}}}], "filter": [{"term": {"event_type": "click"}}], "must_not": [{"range": {"user_id": {"gte": 10}}}], "should": [{"term": {"event_type": "view"}}]}}, "value > 20 AND event_type = 'click' AND user_id < 10")
_events("dsl_range_legacy", {"range": {"value": {"from": 10, "to": 20, "include_lower": False, "include_upper": True}}}, "value > 10 AND value <= 20")
_events("dsl_range_format", {"range": {"ts": {"gte": "10/01/2024", "format": "dd/MM/yyyy"}}}, "ts >= TIMESTAMP '2024-01-10'")
_events("dsl_match_number", {"match": {"user_id": "7"}}, "user_id = 7")
_events("dsl_match_lenient", {"match": {"user_id": {"query": "many", "lenient": True}}}, "false")
_events("dsl_zero_terms_all", {"match": {"event_type": {"query": "", "zero_terms_query": "all"}}}, "true")
_events("dsl_extra_must_not_only", {"bool": {"must_not": [{"term": {"event_type": "click"}}, {"term": {"event_type": "view"}}]}}, "event_type NOT IN ('click', 'view')")
_docs("dsl_match_phrase", {"match_phrase": {"text": {"query": "of the"}}}, _phrase("of the"))
_docs("dsl_match_phrase_prefix", {"match_phrase_prefix": {"text": {"query": "of the an"}}}, _phrase("of the an", "''"))
_docs("dsl_regexp", {"regexp": {"text": {"value": "(ea|nd|er)+"}}}, f"len(list_filter({TOKENS}, lambda x: regexp_full_match(x, '(ea|nd|er)+'))) > 0")
_docs("dsl_wildcard", {"wildcard": {"text": {"value": "th?re*"}}}, f"len(list_filter({TOKENS}, lambda x: regexp_full_match(x, 'th.re.*'))) > 0")
_docs("dsl_multi_match_phrase", {"multi_match": {"query": "of the", "type": "phrase", "fields": ["text", "lang"]}}, _phrase("of the"))
_docs("dsl_multi_match_bare_field", {"multi_match": {"query": "the", "fields": "text"}}, _has("the"))
_docs("dsl_boosted", {"bool": {"should": [{"match": {"text": {"query": "instan", "boost": 2}}}, {"term": {"lang": {"value": "fr", "boost": 3}}}]}}, f"{_has('instan')} OR lang = 'fr'")
_SHOULD = [({"term": {"event_type": "error"}}, "event_type = 'error'"), ({"range": {"value": {"gte": 50}}}, "value >= 50"), ({"range": {"user_id": {"lt": 7}}}, "user_id < 7"), ({"term": {"event_type": "click"}}, "event_type = 'click'")]
_COUNT = " + ".join(f"CAST({x} AS INT)" for _, x in _SHOULD)
for _name, _wanted, _least in (("1", 1, 1), ("3", 3, 3), ("half", "50%", 2), ("35_percent", "35%", 1), ("minus_2", -2, 2), ("minus_3", -3, 1), ("minus_35_percent", "-35%", 3)):
    _events(f"msm_{_name}", {"bool": {"should": [q for q, _ in _SHOULD], "minimum_should_match": _wanted}}, f"{_COUNT} >= {_least}")
_events("msm_too_many", {"bool": {"should": [q for q, _ in _SHOULD], "minimum_should_match": 5}}, "false")
_events("msm_too_negative_with_must", {"bool": {"must": [{"term": {"event_type": "view"}}], "should": [q for q, _ in _SHOULD], "minimum_should_match": -10}}, "event_type = 'view'")

# -- query strings and dynamic fields
_events("search_date_with_slashes", "ts:>=2024/01/10", "ts >= TIMESTAMP '2024-01-10'")
_events("search_negatives_alone", "-event_type:click AND NOT event_type:view OR event_type:click", "event_type <> 'view'")
_DAYS = Mapping({}, source="_source")


def _dynamic(s: SparkSession, d: str) -> DataFrame:
    """Events whose day, number and word are in an undeclared object."""
    word = F.when(F.col("user_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.col("event_type"))
    return table(s, d, "events").withColumn("_source", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("value").alias("number"), word.alias("mixed"))))


for _name, _query, _where in (
    ("date", "day:>=2024/01/20", "CAST(ts AS DATE) >= DATE '2024-01-20'"),
    ("date_interval", "day:[2024-01-05 TO 2024-01-10T00:00:00Z}", "CAST(ts AS DATE) >= DATE '2024-01-05' AND CAST(ts AS DATE) < DATE '2024-01-10'"),
    ("number", "number:[10 TO 20.5]", "value BETWEEN 10 AND 20.5"),
    ("text", "mixed:>=purchase", "user_id % 2 = 1 AND event_type >= 'purchase'"),
    ("date_among_words", "mixed:<2024-01-11", "user_id % 2 = 0 AND CAST(ts AS DATE) < DATE '2024-01-11'"),
):
    add(f"dynamic_range_{_name}", lambda s, d, q=_query: _dynamic(s, d).filter(compile_query(parse(q), _DAYS)).select("event_id"), f"SELECT event_id FROM events WHERE {_where}")
add("search_time_bounds", lambda s, d: search(table(s, d, "events"), SearchRequest("*", size=10_000, tie="event_id", start_timestamp=1704844800, end_timestamp=1705708800), EVENTS).select("event_id"), "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' ORDER BY event_id DESC LIMIT 10000")

_IDS = [3 * k for k in range(4000)]
add("dsl_terms_large", lambda s, d: search(table(s, d, "orders"), SearchRequest({"bool": {"filter": [{"terms": {"o_orderkey": _IDS}}, {"range": {"o_totalprice": {"gte": 1000}}}]}}, size=10_000, tie="o_orderkey"), Mapping({"o_orderkey": Field("i64"), "o_totalprice": Field("f64")})).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey < 12000 AND o_totalprice >= 1000")
_events("dsl_terms_numbers", {"terms": {"user_id": [3, "5", 7, "x"]}}, "user_id IN (3, 5, 7)")


def _scroll_all(s: SparkSession, d: str) -> DataFrame:
    """All pages of a scroll, with the page that each row came on."""
    from .operators.search import Scroll

    scroll = Scroll(table(s, d, "events"), SearchRequest("event_type:purchase", sort=[("value", "desc")], size=60, tie="event_id"), EVENTS, _folder(s, "scroll"))
    out, page = None, 0
    while scroll.at < min(scroll.total, 300):
        own = scroll.next().select("event_id", F.lit(page).alias("page"))
        out, page = own if out is None else out.unionAll(own), page + 1
    return out


add("scroll_all_pages", _scroll_all, "SELECT event_id, CAST((row_number() OVER (ORDER BY value DESC, event_id DESC) - 1) // 60 AS INT) AS page FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id DESC LIMIT 300")

# -- aggregations
_TAGGED = "CASE WHEN user_id % 3 = 0 THEN ['a', 'b', 'a'] WHEN user_id % 3 = 1 THEN ['b'] END"


def _tagged(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("tags", F.when(F.col("user_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).when(F.col("user_id") % 3 == 1, F.array(F.lit("b"))))


def _more_agg(name: str, request: dict, path: str, sql: str, source=lambda s, d: table(s, d, "events"), base=None) -> None:
    add(name, lambda s, d: aggs.aggregate(source(s, d), request, base=base(s, d) if base else None)[path], sql)


_more_agg("agg_range_nested", {"k": {"terms": {"field": "event_type"}, "aggs": {"r": {"range": {"field": "value", "ranges": [{"to": 20}, {"from": 20, "to": 1e9}, {"from": 1e9, "key": "none"}]}, "aggs": {"m": {"max": {"field": "value"}}}}}}}, "k>r", """
WITH k AS (SELECT DISTINCT event_type AS k FROM events), r AS (SELECT * FROM (VALUES ('*-20.0', -1e300, 20), ('20.0-1000000000.0', 20, 1e9), ('none', 1e9, 1e300)) t(r, low, high))
SELECT k, r, count(event_id) AS doc_count, max(value) AS m FROM k CROSS JOIN r LEFT JOIN events ON event_type = k AND value >= low AND value < high GROUP BY k, r""")
_more_agg("agg_multi_terms_arrays", {"k": {"multi_terms": {"terms": [{"field": "event_type"}, {"field": "tags"}], "size": 50}}}, "k", f"SELECT event_type || '|' || t AS k, count(*) AS doc_count FROM (SELECT event_type, unnest(list_distinct({_TAGGED})) AS t FROM events) GROUP BY 1", _tagged)
_more_agg("agg_composite_arrays", {"c": {"composite": {"sources": [{"t": {"terms": {"field": "tags", "missing_bucket": True}}}, {"k": {"terms": {"field": "event_type"}}}], "size": 50}}}, "c", f"SELECT t AS c_t, event_type AS c_k, count(*) AS doc_count FROM (SELECT event_type, unnest(coalesce(list_distinct({_TAGGED}), [NULL])) AS t FROM events) GROUP BY 1, 2", _tagged)
_more_agg("agg_terms_arrays", {"t": {"terms": {"field": "tags"}}}, "t", f"SELECT t, count(*) AS doc_count FROM (SELECT unnest(list_distinct({_TAGGED})) AS t FROM events) GROUP BY 1", _tagged)
_more_agg("agg_terms_min0", {"k": {"terms": {"field": "event_type", "min_doc_count": 0}}}, "k", "SELECT event_type AS k, count(*) FILTER (event_type LIKE '%e%' AND value > 20) AS doc_count FROM events GROUP BY 1", lambda s, d: table(s, d, "events").filter("event_type LIKE '%e%' AND value > 20"), lambda s, d: table(s, d, "events"))
_more_agg("agg_terms_min_count", {"u": {"terms": {"field": "user_id", "min_doc_count": 60, "size": None}}}, "u", "SELECT user_id AS u, count(*) AS doc_count FROM events GROUP BY 1 HAVING count(*) >= 60")
_more_agg("agg_histogram_hard_bounds", {"h": {"histogram": {"field": "value", "interval": 10, "offset": 5, "hard_bounds": {"min": 20, "max": 60}, "min_doc_count": 1}}}, "h", "SELECT floor((value - 5) / 10) * 10 + 5 AS h, count(*) AS doc_count FROM events WHERE value BETWEEN 20 AND 60 GROUP BY 1")
_more_agg("agg_composite_dates", {"c": {"composite": {"sources": [{"d": {"date_histogram": {"field": "ts", "fixed_interval": "1d"}}}, {"k": {"terms": {"field": "event_type"}}}], "size": 20, "after": {"d": 1704326400000, "k": "purchase"}}}}, "c", "SELECT epoch_ms(ts) // 86400000 * 86400000 AS c_d, event_type AS c_k, count(*) AS doc_count FROM events GROUP BY 1, 2 HAVING c_d > 1704326400000 OR (c_d = 1704326400000 AND c_k > 'purchase') ORDER BY 1, 2 LIMIT 20")


def _near_percentiles(s: SparkSession, d: str) -> DataFrame:
    """How the sketch's percentiles rank among the values, against the ranks that were asked for."""
    events, asked = table(s, d, "events"), (5, 50, 95, 99)
    found = aggs.aggregate(events, {"p": {"percentiles": {"field": "value", "percents": list(asked)}}})[""].first()
    ranks = events.agg(*[(F.abs(F.count_if(F.col("value") <= found[f"p_p{p}"]) / F.count("value") - p / 100) < 0.01).alias(f"p{p}") for p in asked])
    return ranks


add("agg_percentiles_sketch", _near_percentiles, "SELECT true AS p5, true AS p50, true AS p95, true AS p99")


def _near_cardinality(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders")
    found = aggs.aggregate(orders, {"c": {"cardinality": {"field": "o_custkey"}}})[""].first()["c"]
    return orders.agg((F.abs(F.count_distinct("o_custkey") - found) <= 0.06 * F.count_distinct("o_custkey")).alias("near"))


add("agg_cardinality_sketch", _near_cardinality, "SELECT true AS near")


def _keyed(s: SparkSession, d: str) -> DataFrame:
    """A keyed response, read as rows."""
    out = aggs.response(table(s, d, "events"), {"k": {"terms": {"field": "event_type"}, "aggs": {"h": {"histogram": {"field": "value", "interval": 100, "keyed": True}}}}})
    return s.createDataFrame([(b["key"], k, x["doc_count"]) for b in out["k"]["buckets"] for k, x in b["h"]["buckets"].items()], "kind string, bucket string, n long")


add("agg_keyed_response", _keyed, """
WITH g AS (SELECT event_type AS kind, CAST(floor(value / 100) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY 1, 2), e AS (SELECT kind, unnest(range(min(h), max(h) + 1)) AS h FROM g GROUP BY 1)
SELECT kind, CAST(CAST(h * 100 AS DOUBLE) AS VARCHAR) AS bucket, coalesce(n, 0) AS n FROM e LEFT JOIN g USING (kind, h)""")

# -- analyzers and dates
_TOKEN_SQL = "SELECT event_id, {} AS tokens FROM events"


def _tokens(name: str, analyzer: str, text, sql: str) -> None:
    add(name, lambda s, d: table(s, d, "events").select("event_id", F.array_join(analyzers.analyze(analyzer, text()), " ").alias("tokens")), _TOKEN_SQL.format(sql))


_upper = lambda: F.concat(F.initcap("event_type"), F.lit("HTTPServer"), F.col("user_id"))
_mixed = lambda: F.concat(F.col("event_type"), F.lit(" 日本語, x "), F.col("user_id"), F.lit("中"))
_tokens("tokens_raw", "raw", lambda: F.initcap("event_type"), "upper(event_type[1]) || substr(event_type, 2)")
_tokens("tokens_raw_lowercase", "raw_lowercase", lambda: F.upper("event_type"), "event_type")
_tokens("tokens_cjk", "chinese_compatible", _mixed, "event_type || ' 日 本 語 x ' || user_id || ' 中'")
_tokens("tokens_source_code_camel", "source_code_default", _upper, "event_type || ' http server ' || user_id")
_tokens("tokens_source_code_hex", "source_code_with_hex", lambda: F.concat(F.lit("getUser 0af3b2c9 "), F.col("event_type")), "'get user 0af3b2c9 ' || event_type")
_tokens("tokens_segments", "unicode_segmenter", lambda: F.concat(F.col("event_type"), F.lit(", and then "), F.col("user_id"), F.lit(".")), "event_type || ' and then ' || user_id")


def _registered(s: SparkSession, d: str) -> DataFrame:
    analyzers.register("catalogue_folded", "regex", lower=False, filters=("lower_caser", "ascii_folding"), pattern=r"\S+")
    analyzers.register("catalogue_prefixes", "ngram", min_gram=1, max_gram=3, prefix_only=True)
    text = F.concat(F.lit("Été "), F.upper("event_type"))
    return table(s, d, "events").select("event_id", F.array_join(analyzers.analyze("catalogue_folded", text), " ").alias("folded"), F.array_join(analyzers.analyze("catalogue_prefixes", F.col("event_type")), " ").alias("prefixes"))


add("tokens_registered", _registered, "SELECT event_id, 'ete ' || event_type AS folded, substr(event_type, 1, 1) || ' ' || substr(event_type, 1, 2) || ' ' || substr(event_type, 1, 3) AS prefixes FROM events")


def _written_dates(s: SparkSession, d: str) -> DataFrame:
    """Each event's second, written in several styles and read again."""
    t = F.date_trunc("second", F.col("ts").cast("timestamp"))
    styles = {"iso": F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "plain": F.date_format(t, "yyyy-MM-dd HH:mm:ss"), "mail": F.date_format(t, "EEE, d MMM yyyy HH:mm:ss Z"), "secs": F.unix_seconds(t).cast("string"), "millis": F.unix_millis(t).cast("string"), "nanos": (F.unix_micros(t) * 1000).cast("string"), "bad": F.lit("no date")}
    written = table(s, d, "events").select("event_id", *[c.alias(n) for n, c in styles.items()])
    return written.select("event_id", *[F.unix_seconds(datetimes.parse(F.col(n))).alias(n) for n in styles])


add("date_parse", _written_dates, "SELECT event_id, " + ", ".join(f"CAST(floor(epoch(ts)) AS BIGINT) AS {n}" for n in ("iso", "plain", "mail", "secs", "millis", "nanos")) + ", CAST(NULL AS BIGINT) AS bad FROM events")
add("date_output", lambda s, d: table(s, d, "events").select("event_id", *[datetimes.output(F.col("ts"), x).alias(x) for x in ("rfc3339", "unix_timestamp_secs", "unix_timestamp_millis", "unix_timestamp_micros", "unix_timestamp_nanos")]), "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339, CAST(floor(epoch(ts)) AS BIGINT) AS unix_timestamp_secs, epoch_us(ts) // 1000 AS unix_timestamp_millis, epoch_us(ts) AS unix_timestamp_micros, epoch_us(ts) * 1000 AS unix_timestamp_nanos FROM events")
add("date_truncate", lambda s, d: table(s, d, "events").select("event_id", *[F.unix_micros(datetimes.truncate(F.col("ts").cast("timestamp"), p)).alias(p) for p in ("s", "ms", "us")]), "SELECT event_id, epoch_us(ts) // 1000000 * 1000000 AS s, epoch_us(ts) // 1000 * 1000 AS ms, epoch_us(ts) AS us FROM events")
add("metric_windows", lambda s, d: with_window(table(s, d, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp"))), "t", 900).groupBy("window_start").agg(F.count("*").alias("n")), "SELECT CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY 1")


# -- hashes: an id names one series, and a route one of so many
def _series(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").withColumn("none", F.lit(None).cast("string")).withColumn("series", discovery.series_id("event_type", ["user_id", "none"]))
    return rows.groupBy("series").agg(F.min("event_type").alias("kind"), F.max("event_type").alias("last_kind"), F.min("user_id").alias("user"), F.max("user_id").alias("last_user"), F.count("*").alias("n")).drop("series")


add("series_id_names_one_series", _series, "SELECT event_type AS kind, event_type AS last_kind, user_id AS user, user_id AS last_user, count(*) AS n FROM events GROUP BY event_type, user_id")


def _routes(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").withColumn("route", discovery.routing("event_type,hash_mod((user_id),4)"))
    by_user = rows.groupBy("event_type", "user_id").agg(F.count_distinct("route").alias("k"), F.first("route").alias("route"))
    return by_user.groupBy("event_type").agg(F.max("k").alias("routes_of_a_user"), (F.count_distinct("route") <= 4).alias("few"), F.count("*").alias("users"))


add("route_of_a_key", _routes, "SELECT event_type, 1 AS routes_of_a_user, true AS few, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
add("log_shape_kinds", lambda s, d: table(s, d, "events").select("event_id", discovery.log_shape(F.concat(F.lit("user "), F.col("user_id"), F.lit(" at 10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(" did "), F.col("event_type"), F.lit(" 123e4567-e89b-12d3-a456-426614174000 in 0xff"))).alias("shape")), "SELECT event_id, 'user <num> at <ip> did ' || event_type || ' <uuid> in <hex>' AS shape FROM events")
add("snippet_parts", lambda s, d: table(s, d, "documents").filter(F.array_contains(analyzers.default(F.col("text")), "instan")).select("doc_id", "text", snippet("text", ["instan"]).alias("x")).select("doc_id", F.lower("x").contains("<b>instan</b>").alias("bold"), (F.length(F.regexp_replace("x", "</?b>", "")) <= 150).alias("short"), F.expr("contains(text, regexp_replace(x, '</?b>', ''))").alias("verbatim")), f"SELECT doc_id, true AS bold, true AS short, true AS verbatim FROM documents WHERE {_has('instan')}")

# -- SQL
_sql_query("join_right", "SELECT n_name, r_name FROM (SELECT * FROM nation WHERE n_regionkey < 3) RIGHT JOIN region ON n_regionkey = r_regionkey", ("nation", "region"))
_sql_query("join_cross", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b", ("region",))
_sql_query("setop_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", ("nation", "region"))
_sql_query("window_lead_nth", "SELECT o_orderkey, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS second, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS d FROM orders", ("orders",))
_sql_query("window_percent_rank", "SELECT n_nationkey, round(percent_rank() OVER (PARTITION BY n_regionkey ORDER BY n_name), 6) AS p, last_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM nation", ("nation",))
_sql_query("window_range_frame", "SELECT n_nationkey, count(*) OVER (ORDER BY n_nationkey RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM nation", ("nation",))
_sql_query("sql_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30", ("orders",))
_sql_query("sql_cte_case", "WITH b AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS band FROM customer) SELECT band, count(*) AS n FROM b GROUP BY band", ("customer",))
_sql_query("sql_text_functions", "SELECT n_nationkey, lower(substr(n_name, 1, 3)) || '-' || length(n_name) AS a, replace(n_name, 'A', '_') AS b, coalesce(nullif(n_regionkey, 0), -1) AS c FROM nation", ("nation",))
add("sql_json_map", lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


def _statements(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "nation").createOrReplaceTempView("nation")
    return run(s, "CREATE OR REPLACE TEMPORARY VIEW few AS SELECT * FROM nation WHERE n_name <> ';'; -- a comment; with a semicolon\nSELECT n_regionkey, count(*) AS n, ';' AS mark FROM few GROUP BY n_regionkey;")


add("sql_statements", _statements, "SELECT n_regionkey, count(*) AS n, ';' AS mark FROM nation GROUP BY 1")


def _external(s: SparkSession, d: str) -> DataFrame:
    where = _folder(s, "external")
    table(s, d, "events").select(F.col("event_type").alias("metric_name"), F.lit(0).cast("smallint").alias("metric_type"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp_secs"), "value", F.col("user_id").cast("string").alias("host")).write.parquet(where)
    metrics.create_external_table(s, f"CREATE EXTERNAL TABLE points (metric_name VARCHAR NOT NULL, timestamp_secs BIGINT UNSIGNED, value DOUBLE, host VARCHAR, env VARCHAR) STORED AS metrics LOCATION '{where}'")
    return s.sql("SELECT metric_name, count(*) AS n, max(value) AS most, count(env) AS with_env FROM points WHERE timestamp_secs >= 1704844800 GROUP BY metric_name")


add("sql_external_table", _external, "SELECT event_type AS metric_name, count(*) AS n, max(value) AS most, CAST(0 AS BIGINT) AS with_env FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")


# -- input formats
def _attribute(key: str, c) -> object:
    return F.struct(F.lit(key).alias("key"), F.struct(c.cast("string").alias("stringValue")).alias("value"))


def _requests(s: SparkSession, d: str, outer: str, scope: str, inner: object) -> DataFrame:
    """A request of OTLP JSON for each event."""
    resource = F.struct(F.array(_attribute("service.name", F.col("event_type"))).alias("attributes"))
    body = F.struct(F.array(F.struct(resource.alias("resource"), F.array(inner).alias(scope))).alias(outer))
    return table(s, d, "events").select(F.to_json(body).alias("value"))


def _nanos(more: int = 0):
    return (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + more).cast("string")


def _logs(s: SparkSession, d: str) -> DataFrame:
    log = F.struct(_nanos().alias("timeUnixNano"), F.lit(9).alias("severityNumber"), F.struct(F.concat(F.lit("user "), F.col("user_id")).alias("stringValue")).alias("body"), F.array(_attribute("id", F.col("event_id"))).alias("attributes"))
    found = formats.otlp_logs(_requests(s, d, "resourceLogs", "scopeLogs", F.struct(F.struct(F.lit("x").alias("name")).alias("scope"), F.array(log).alias("logRecords"))))
    return found.select(F.col("attributes")["id"].cast("long").alias("event_id"), "service_name", "body", "severity_number", "scope_name", F.expr("timestamp_nanos div 1000").alias("micros"))


def _spans(s: SparkSession, d: str) -> DataFrame:
    span = F.struct(F.col("user_id").cast("string").alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.col("event_type").alias("name"), F.lit(2).alias("kind"), _nanos().alias("startTimeUnixNano"), _nanos(5_000_000).alias("endTimeUnixNano"))
    found = formats.otlp_traces(_requests(s, d, "resourceSpans", "scopeSpans", F.struct(F.array(span).alias("spans"))))
    return found.select(F.col("span_id").cast("long").alias("event_id"), "trace_id", "service_name", "span_name", "span_duration_millis", "is_root")


def _gauges(s: SparkSession, d: str) -> DataFrame:
    point = F.struct(_nanos().alias("timeUnixNano"), F.col("value").alias("asDouble"), F.array(_attribute("host", F.col("user_id"))).alias("attributes"))
    gauge = F.struct(F.lit("m").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))
    found = metrics.otlp_metrics(_requests(s, d, "resourceMetrics", "scopeMetrics", F.struct(F.array(gauge).alias("metrics"))))
    return found.groupBy("metric_name", "service", "host").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.min("timestamp_secs").alias("first"))


add("otlp_logs", _logs, "SELECT event_id, event_type AS service_name, 'user ' || user_id AS body, 9 AS severity_number, 'x' AS scope_name, epoch_us(ts) AS micros FROM events")
add("otlp_traces", _spans, "SELECT event_id, CAST(user_id AS VARCHAR) AS trace_id, event_type AS service_name, event_type AS span_name, 5 AS span_duration_millis, true AS is_root FROM events")
add("otlp_metrics", _gauges, "SELECT 'm' AS metric_name, event_type AS service, CAST(user_id AS VARCHAR) AS host, count(*) AS n, max(value) AS most, min(CAST(floor(epoch(ts)) AS BIGINT)) AS first FROM events GROUP BY 2, 3")


def _bulk(s: SparkSession, d: str) -> DataFrame:
    """A body with an action and a document for each nation."""
    own = table(s, d, "nation").select("n_nationkey", F.to_json(F.struct(F.struct(F.lit("nations").alias("_index"), F.col("n_nationkey").cast("string").alias("_id")).alias("index"))).alias("a"), F.to_json(F.struct("n_name")).alias("b"))
    lines = own.select(F.posexplode(F.array("a", "b")).alias("k", "value"), "n_nationkey").select((F.col("n_nationkey") * 2 + F.col("k")).alias("n"), "value")
    return formats.bulk(lines).select("action", "index", F.col("id").cast("int").alias("id"), F.get_json_object("source", "$.n_name").alias("name"))


add("bulk_body", _bulk, "SELECT 'index' AS action, 'nations' AS index, n_nationkey AS id, n_name AS name FROM nation")
_STRICT = Mapping({"id": Field("i64"), "v": Field("f64")}, "strict")


def _refused(s: SparkSession, d: str) -> DataFrame:
    """Documents of which some are broken, some have a wrong type and some an unknown field."""
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.lit("{oops")).when(k == 1, F.to_json(F.struct(F.lit("x").alias("id")))).when(k == 2, F.to_json(F.struct(F.lit(1).alias("z")))).otherwise(F.to_json(F.struct(F.col("event_id").alias("id"))))
    return docs.errors(docs.parse(table(s, d, "events").select(text.alias("value")), _STRICT))


add("ingest_reasons", _refused, "SELECT ['json', 'type:id', 'unknown'][CAST(event_id % 5 AS INT) + 1] AS reason, count(*) AS n FROM events WHERE event_id % 5 < 3 GROUP BY 1")


def _from_source(s: SparkSession, d: str) -> DataFrame:
    """A source of given lines, of which a transform drops some and changes the rest."""
    names = [r[0] for r in table(s, d, "region").select("r_name").collect()]
    return open_source(s, {"source_type": "vec", "params": {"docs": names}, "transform": ["value <> 'ASIA'", "lower(value)"]})


add("source_transform", _from_source, "SELECT lower(r_name) AS value FROM region WHERE r_name <> 'ASIA'")


# -- the engine: an index of the events, written as documents
def _engine(s: SparkSession, d: str) -> Engine:
    engine = Engine(s, _folder(s, "engine"))
    engine.create_index({"index_id": "events", "doc_mapping": {"timestamp_field": "ts", "tag_fields": ["event_type"], "field_mappings": [
        {"name": "event_id", "type": "i64"}, {"name": "ts", "type": "datetime"}, {"name": "event_type", "type": "text", "tokenizer": "raw"}, {"name": "value", "type": "f64"}, {"name": "note", "type": "text", "record": "position"}]},
        "search_settings": {"default_search_fields": ["note"]}})
    note = F.concat(F.lit("User "), F.col("user_id"), F.lit(" did "), F.col("event_type"))
    rows = table(s, d, "events").select(F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "event_type", "value", note.alias("note"))).alias("value"), "event_type")
    for kind in ("error", "click"):
        engine.ingest("events", rows.filter(F.col("event_type") == kind).select("value"))
    engine.ingest("events", rows.filter(~F.col("event_type").isin("error", "click")).select("value"))
    return engine


def _rows(s: SparkSession, hits: list[dict], *names: str) -> DataFrame:
    kinds = {"event_id": "long", "value": "double", "event_type": "string"}
    return s.createDataFrame([tuple(h[n] for n in names) for h in hits], ", ".join(f"{n} {kinds[n]}" for n in names))


def _native(s: SparkSession, d: str) -> DataFrame:
    out = _engine(s, d).search("events", SearchRequest('"did error" AND value:>=100', sort=[("value", "desc"), ("event_id", "asc")], size=50))
    return _rows(s, out["hits"], "event_id", "value")


add("engine_search", _native, "SELECT event_id, value FROM events WHERE event_type = 'error' AND value >= 100 ORDER BY value DESC, event_id LIMIT 50")


def _dsl_page(s: SparkSession, d: str) -> DataFrame:
    engine, seen, after = _engine(s, d), [], None
    body = {"query": {"bool": {"filter": [{"term": {"event_type": "purchase"}}, {"range": {"ts": {"gte": "2024-01-10", "lt": "2024-01-15"}}}]}}, "sort": [{"value": "asc"}, {"event_id": "asc"}], "size": 7, "_source": ["event_id"]}
    for _ in range(3):
        hits = engine.es_search("ev*", body | ({"search_after": after} if after else {}))["hits"]["hits"]
        if not hits:
            break
        seen += [h["_source"] for h in hits]
        after = hits[-1]["sort"]
    return _rows(s, seen, "event_id")


add("engine_dsl_pages", _dsl_page, "SELECT event_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15' ORDER BY value, event_id LIMIT 21")


def _copies(s: SparkSession, d: str) -> DataFrame:
    """Paging over documents of which each stands there three times, all equal in the sort key."""
    engine = Engine(s, _folder(s, "copies"))
    engine.create_index({"index_id": "copies", "doc_mapping": {"field_mappings": [{"name": "name", "type": "text", "tokenizer": "raw"}, {"name": "same", "type": "i64"}]}})
    rows = table(s, d, "region").select(F.to_json(F.struct(F.col("r_name").alias("name"), F.lit(1).alias("same"))).alias("value"))
    for _ in range(3):
        engine.ingest("copies", rows)
    seen, ids, after = [], set(), None
    while hits := engine.es_search("copies", {"sort": [{"same": "asc"}, "_doc"], "size": 4} | ({"search_after": after} if after else {}))["hits"]["hits"]:
        seen += [(h["_source"]["name"],) for h in hits]
        ids |= {h["_id"] for h in hits}
        after = hits[-1]["sort"]
    return s.createDataFrame(seen, "name string").groupBy("name").agg(F.count("*").alias("n")).withColumn("ids", F.lit(len(ids)))


add("search_after_duplicates", _copies, "SELECT r_name AS name, 3 AS n, 15 AS ids FROM region")


def _pruned_terms(s: SparkSession, d: str) -> DataFrame:
    """Rows found where the term filters leave only files that may hold the words."""
    engine = _engine(s, d)
    df, mapping = engine.table("events", query=lower({"match_phrase": {"note": "did error"}}))
    every = engine.index("events").manifest().count()
    left = engine.index("events").prune(terms={"note": ["did", "error"]}).count()
    found = df.filter(compile_query(lower({"match_phrase": {"note": "did error"}}), mapping))
    return found.select("event_id", F.lit(left < every).alias("pruned"))


add("prune_terms", _pruned_terms, "SELECT event_id, true AS pruned FROM events WHERE event_type = 'error'")


def _counts(s: SparkSession, d: str) -> DataFrame:
    engine = _engine(s, d)
    many = engine.es_msearch([({"index": "events"}, {"query": {"term": {"event_type": "view"}}, "size": 0}), ({"index": "none"}, {})])["responses"]
    rows = [("all", engine.es_count("events")), ("error", engine.es_count("events", {"query": {"term": {"event_type": "error"}}})), ("view", many[0]["hits"]["total"]["value"]), ("absent", many[1]["status"]), ("docs", engine.cat_indices()[0]["docs"]), ("stats", engine.stats()["_all"]["docs"])]
    return s.createDataFrame(rows, "what string, n long")


add("engine_counts", _counts, "SELECT 'all' AS what, count(*) AS n FROM events UNION ALL SELECT 'docs', count(*) FROM events UNION ALL SELECT 'stats', count(*) FROM events UNION ALL SELECT 'error', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'view', count(*) FROM events WHERE event_type = 'view' UNION ALL SELECT 'absent', 404")


def _deleted_by_query(s: SparkSession, d: str) -> DataFrame:
    engine = _engine(s, d)
    engine.delete_by_query("events", "event_type:click AND value:<20")
    engine.merge("events")
    engine.collect_garbage("events")
    return engine.sql("SELECT event_type, count(*) AS n, max(value) AS most FROM events GROUP BY event_type")


add("engine_delete_merge_sql", _deleted_by_query, "SELECT event_type, count(*) AS n, max(value) AS most FROM events WHERE NOT (event_type = 'click' AND value < 20) GROUP BY 1")


def _terms(s: SparkSession, d: str) -> DataFrame:
    return _engine(s, d).list_terms("events", "note", "c", "u")


add("engine_list_terms", _terms, "SELECT DISTINCT t AS term FROM (SELECT unnest(string_split('user ' || user_id || ' did ' || event_type, ' ')) AS t FROM events) WHERE t >= 'c' AND t < 'u'")


def _splits(s: SparkSession, d: str) -> DataFrame:
    """Files of one kind of event each, listed by their tag."""
    index = Index(s, _folder(s, "files"), "ts", ("event_type",))
    rows = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for kind in ("error", "view", "click"):
        index.append(rows.filter(F.col("event_type") == kind), files=1)
    return index.prune(tags={"event_type": ["view", "error"]}).select(F.element_at("tag_event_type", 1).alias("kind"), "num_docs", F.unix_micros("time_start").alias("first"), F.unix_micros("time_end").alias("last"))


add("list_splits_by_tag", _splits, "SELECT event_type AS kind, count(*) AS num_docs, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM events WHERE event_type IN ('view', 'error') GROUP BY 1")


def _stream_windows(s: SparkSession, d: str) -> DataFrame:
    """Counts of event-time windows over a stream of files, with a watermark."""
    import uuid

    from .streaming.ingest import windowed_counts

    where, name = _folder(s, "windows"), f"windows_{uuid.uuid4().hex}"
    rows = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows.write.parquet(f"{where}/in")
    stream = windowed_counts(s.readStream.schema(rows.schema).parquet(f"{where}/in"), "ts", "event_type", "1 day", "1 hour")
    stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.table(name).select(F.unix_seconds("window.start").alias("day"), "event_type", F.col("count").alias("n"))


add("stream_windows", _stream_windows, "SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")


def _clash(s: SparkSession, d: str) -> DataFrame:
    """Two indexes of which one has numbers and the other words under one name."""
    engine = Engine(s, _folder(s, "clash"))
    for name, kind, rows in (("clash-a", {"type": "i64"}, table(s, d, "nation").select(F.col("n_nationkey").alias("id"))), ("clash-b", {"type": "text", "tokenizer": "raw"}, table(s, d, "region").select(F.col("r_name").alias("id")))):
        engine.create_index({"index_id": name, "doc_mapping": {"field_mappings": [{"name": "id"} | kind]}})
        engine.ingest(name, rows.select(F.to_json(F.struct("id")).alias("value")))
    found = [engine.es_search("clash-*", {"query": {"terms": {"id": ["7", "ASIA", "none"]}}})["hits"]["hits"], engine.es_search("clash-*,-clash-a", {"query": {"match_all": {}}})["hits"]["hits"]]
    return s.createDataFrame([(k, h["_index"], str(h["_source"]["id"])) for k, hits in enumerate(found) for h in hits], "k int, index string, id string")


add("multi_index_clash", _clash, "SELECT 0 AS k, 'clash-a' AS index, '7' AS id UNION ALL SELECT 0, 'clash-b', 'ASIA' UNION ALL SELECT 1, 'clash-b', r_name FROM region")


def _json_out(s: SparkSession, d: str) -> DataFrame:
    """Documents as they come back: the JSON that went in, with the fields that were asked for."""
    hits = _engine(s, d).es_search("events", {"query": {"range": {"value": {"gte": 150}}}, "_source": {"includes": ["e*"], "excludes": ["event_type"]}, "sort": [{"event_id": "desc"}], "size": 30})["hits"]["hits"]
    return s.createDataFrame([(json.dumps(h["_source"]), h["sort"][0]) for h in hits], "source string, event_id long")


add("engine_source_filter", _json_out, """SELECT '{"event_id": ' || event_id || '}' AS source, event_id FROM events WHERE value >= 150 ORDER BY event_id DESC LIMIT 30""")
