"""The engine: parsers, truth tables, aggregations on small fixtures, and every catalogue query against DuckDB."""

import math
import os

import pytest
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.functions import datetimes, sketch
from tidemark.operators import aggs, discovery
from tidemark.operators.filter import compile_query
from tidemark.operators.search import Scroll, SearchRequest, search, union_indexes
from tidemark.plans import ast as A
from tidemark.plans import sqltext
from tidemark.plans.dsl import DslError, lower
from tidemark.plans.mapping import Field, Mapping
from tidemark.plans.querystring import QueryError, parse
from tidemark.sources import formats
from tidemark.sources.catalog import Index, plan_merges
from tidemark.streaming.ingest import ingest


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_catalogue(spark, sf, name):
    import duckdb

    found = catalogue.queries()[name](spark, sf)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert found.count() > 0
        return
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    rel = con.sql(sql)
    names, rows = list(rel.columns), rel.fetchall()
    columns = sorted(found.columns)
    assert sorted(names) == columns
    assert sorted(repr(tuple(norm(r[c]) for c in columns)) for r in found.collect()) == sorted(repr(tuple(norm(r[names.index(c)]) for c in columns)) for r in rows)


@pytest.fixture(scope="module")
def sorted_rows(spark):
    return spark.createDataFrame([(10.0, 1), (10.0, 2), (15.0, 2), (None, 3), (10.0, 0), (-2.5, 4), (None, 5)], "count double, id long")


def test_negation_matches_rows_without_the_field(sorted_rows):
    m = Mapping.infer(sorted_rows)
    ids = lambda q: sorted(r[0] for r in sorted_rows.filter(compile_query(parse(q, ()), m)).select("id").collect())
    assert ids("NOT count:10") == [2, 3, 4, 5]
    assert ids("-count:10 AND -count:15") == [3, 4, 5]
    assert ids("count:*") == [0, 1, 2, 2, 4]


@pytest.mark.parametrize("way", ["asc", "desc"])
def test_nulls_come_last_either_way(sorted_rows, way):
    rows = search(sorted_rows, SearchRequest(sort=[("count", way)], tie="id"), Mapping.infer(sorted_rows)).collect()
    assert [r["count"] for r in rows][-2:] == [None, None]
    assert [r["id"] for r in rows][-2:] == ([3, 5] if way == "asc" else [5, 3])


def test_scroll_reads_every_row_once(sorted_rows, tmp_path):
    s = Scroll(sorted_rows.dropDuplicates(["id"]), SearchRequest(sort=[("count", "desc")], size=2, tie="id"), Mapping.infer(sorted_rows), str(tmp_path / "s"))
    seen = []
    while rows := s.next().collect():
        seen += [r["id"] for r in rows]
    assert sorted(seen) == [0, 1, 2, 3, 4, 5]


def test_bool_matrix(sorted_rows):
    m, none, every = Mapping.infer(sorted_rows), {"match_none": {}}, {"match_all": {}}
    n = lambda b: sorted_rows.filter(compile_query(lower({"bool": b}), m)).count()
    assert [n({}), n({"must_not": [none]}), n({"should": [none]}), n({"should": [none], "must_not": [none]}), n({"must": [every], "should": [none]})] == [7, 7, 0, 0, 7]


@pytest.mark.parametrize(("wanted", "least"), [(1, 1), ("50%", 2), (-2, 2), (-3, 1), (-10, None), ("35%", 1), ("-35%", 3), (5, 5)])
def test_minimum_should_match(wanted, least):
    assert A.required_should(wanted, 4) == least


def test_slop(spark):
    # Texts and counts that define what slop means.
    df = spark.createDataFrame([(x,) for x in ("a red bike", "a small blue bike", "a small, rusty, and yellow bike", "fred's small bike", "a tiny shelter")], "body string")
    n = lambda q: df.filter(compile_query(parse("body:" + q), Mapping.infer(df))).count()
    assert [n(q) for q in ('"small bike"', '"small bike"~1', '"small bike"~2', '"small bike"~3', '"red bike"~2', '"small blue bike"~3', '"small bird"~2', '"tiny shelter"~3')] == [1, 2, 2, 3, 1, 1, 0, 1]


def test_parser_errors_and_precedence():
    for bad in ("a AND", "(a", "a)", '"a', "OR a", "f:IN a", "f:[1 TO"):
        with pytest.raises(QueryError):
            parse(bad, ("f",))
    with pytest.raises(QueryError):
        parse("word")
    node = parse("a:1 OR b:2 AND c:3")
    assert isinstance(node, A.Bool) and len(node.should) == 2 and len(node.should[1].must) == 2
    assert parse("a:1^2.5") == A.Boost(A.FullText("a", "1", "phrase_or_and"), 2.5)
    for bad in ({"x": {}}, {"range": {"a": {"gt": 1, "gte": 2}}}, {"bool": {"oops": []}}, {"multi_match": {"query": "a", "fields": []}}):
        with pytest.raises(DslError):
            lower(bad)


def test_aggregation_response(spark):
    # Rows whose buckets and statistics are given.
    rows = [("Albert", 100, ["nice"]), ("Fred", 100, ["nice"]), ("Manfred", 120, ["nice"]), ("Horst", None, ["nice", "cool"]), ("Fritz", 30, ["nice", "cool"]), ("Fritz", 30, None), ("Fritz", 30, None), ("Holger", 30, None), ("Werner", 20, None), ("Bernhard", 130, None)]
    df = spark.createDataFrame(rows, "name string, response long, tags array<string>")
    out = aggs.response(df, {"tags": {"terms": {"field": "tags"}}, "h": {"histogram": {"field": "response", "interval": 50}}, "e": {"extended_stats": {"field": "response"}}, "r": {"range": {"field": "response", "ranges": [{"to": 50}, {"from": 50, "to": 80}, {"from": 80}]}, "aggs": {"m": {"max": {"field": "response"}}}}})
    assert [(b["key"], b["doc_count"]) for b in out["tags"]["buckets"]] == [("nice", 5), ("cool", 2)]
    assert [(b["key"], b["doc_count"]) for b in out["h"]["buckets"]] == [(0.0, 5), (50.0, 0), (100.0, 4)]
    assert sorted(b["doc_count"] for b in out["r"]["buckets"]) == [0, 4, 5]
    assert out["e"]["count"] == 9 and out["e"]["sum"] == 590 and abs(out["e"]["variance_population"] - 1846.9135802) < 1e-6


def test_sketch_golden(spark):
    rows = [("a", [1338, 1400], [3, 1], 4, 50.0, 0.5, 20.0, 0), ("a", [1338, 1450], [2, 1], 3, 45.0, 0.5, 18.0, 0), ("b", [1338, 1500], [4, 1], 5, 70.0, 0.5, 22.0, 0)]
    df = spark.createDataFrame(rows, "s string, keys array<smallint>, counts array<bigint>, count long, sum double, min double, max double, flags int")
    q = lambda d, p: sketch.merge(d, []).select(sketch.quantile(*[F.col(c) for c in ("keys", "counts", "count", "min", "max")], p)).first()[0]
    assert abs(q(df, 0.5) - 1.0) < 1e-9 and abs(q(df, 0.99) - 5.677260965422914) < 1e-9
    assert abs(q(df.filter("max <= 20"), 0.99) - 2.614988148096247) < 1e-9
    assert q(df, 0.0) == 0.5 and q(df, 1.0) == 22.0


def test_windows_and_dates(spark):
    w = lambda t, d: spark.range(1).select(datetimes.window_start(F.lit(t), d)).first()[0]
    assert [w(-1, 900), w(-3601, 3600), w(900, 900)] == [-900, -7200, 900]
    got = spark.createDataFrame([("2023/05/25",), ("1432568400",), ("nope",)], "d string").select(datetimes.parse(F.col("d")).cast("string")).collect()
    assert [r[0] for r in got] == ["2023-05-25 00:00:00", "2015-05-25 15:40:00", None]


def test_rollup_golden(spark):
    rows = [("web", h, 15 * i, v * (i + 1.0)) for h, v in (("web-01", 1), ("web-02", 10)) for i in range(6)] + [("api", "api-01", 15 * i, 100.0 * (i + 1)) for i in range(6)]
    df = spark.createDataFrame(rows, "service string, host string, t long, value double")
    out = discovery.rollup(df, ["service", "host"], ["service"], F.col("t"), "value", "max", "avg", 30).orderBy("service", "bin").collect()
    assert [r["value"] for r in out] == [200, 400, 600, 11, 22, 33]


def test_statements():
    assert sqltext.statements("select ';' as a; -- x;y\nselect 1 /* ; */; ;") == ["select ';' as a", "-- x;y\nselect 1 /* ; */"]


def test_index_lifecycle(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    index = Index(spark, str(tmp_path / "i"), "ts", ("event_type",))
    for kind in ("click", "view", "error"):
        index.append(events.filter(F.col("event_type") == kind), files=1)
    total = events.filter(F.col("event_type").isin("click", "view", "error")).count()
    assert index.count() == total == index.scan().count()
    assert index.prune(tags={"event_type": ["error"]}).count() == 1
    index.delete(F.col("event_type") == "view")
    kept = events.filter(F.col("event_type").isin("click", "error")).count()
    assert index.scan().count() == index.count() == kept
    assert index.compact(10_000, ["ts"]) >= 2 and index.manifest().count() == 1 and index.scan().count() == kept
    assert index.collect_garbage() > 0 and index.scan().count() == kept
    index.retain("2100-01-01", 60)
    assert index.count() == 0 and index.scan().count() == 0
    assert plan_merges([("a", 5), ("b", 5), ("c", 100)], 50) == [["a", "b"]]


def test_stream_ingest_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "v": 2.5}\n{broken\n{"id": 2, "v": 3.5}\n')
    index = Index(spark, str(tmp_path / "i"))
    for _ in range(2):
        ingest(formats.ndjson(spark, str(tmp_path / "in"), "id long, v double", stream=True), index, str(tmp_path / "c"), {"w": "v * 2"}).awaitTermination()
    assert sorted((r["id"], r["w"]) for r in index.scan().collect()) == [(1, 5.0), (2, 7.0)] and index.count() == 2
    assert spark.read.parquet(str(tmp_path / "i/quarantine")).count() == 1


def test_formats(spark):
    log = '{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"api"}}]},"scopeLogs":[{"scope":{"name":"x"},"logRecords":[{"timeUnixNano":"5","severityText":"INFO","body":{"stringValue":"hi"},"attributes":[{"key":"n","value":{"intValue":"3"}}]}]}]}]}'
    r = formats.otlp_logs(spark.createDataFrame([(log,)], "value string")).first()
    assert (r["service_name"], r["body"], r["attributes"]) == ("api", "hi", {"n": "3"})
    lines = ['{"index": {"_index": "a", "_id": "1"}}', '{"x": 1}', '{"create": {"_index": "b"}}', '{"x": 2}']
    got = formats.bulk(spark.createDataFrame(list(enumerate(lines)), "n long, value string")).collect()
    assert [(r["action"], r["index"], r["source"]) for r in got] == [("index", "a", '{"x": 1}'), ("create", "b", '{"x": 2}')]


def test_union_of_indexes(spark):
    both = {"a1": spark.createDataFrame([(1,)], "x long"), "a2": spark.createDataFrame([("t",)], "y string"), "b": spark.range(1)}
    out = union_indexes(both, "a*,-a3")
    assert sorted(r["_index"] for r in out.collect()) == ["a1", "a2"] and set(out.columns) == {"x", "y", "_index"}
    with pytest.raises(KeyError):
        union_indexes(both, "zzz")


def test_strict_mapping_and_typed_errors(sorted_rows):
    with pytest.raises(KeyError):
        compile_query(parse("nope:1"), Mapping({"id": Field("i64")}, "strict"))
    with pytest.raises(ValueError):
        compile_query(lower({"range": {"ok": {"gt": 1}}}), Mapping({"ok": Field("bool")}))


def test_simplified_queries_select_the_same_rows(sorted_rows):
    """Random trees, compiled as they are and simplified, all in one pass."""
    import random

    from tidemark.operators.filter import Compiler

    r, compiler = random.Random(3), Compiler(Mapping.infer(sorted_rows))
    leaf = lambda: r.choice((A.MatchAll(), A.MatchNone(), A.Term("id", r.randint(0, 5)), A.Range("count", (r.randint(-3, 12), True), None), A.Exists("count")))

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return leaf()
        if r.random() < 0.15:
            return A.Boost(tree(depth - 1), 2.0)
        some = lambda: tuple(tree(depth - 1) for _ in range(r.choice((0, 0, 1, 2))))
        return A.Bool(some(), some(), some(), some(), r.choice((None, None, 1, 2, "50%", -1)))

    trees = [tree(3) for _ in range(60)]
    columns = [c.alias(f"{k}{w}") for k, t in enumerate(trees) for w, c in (("a", compiler.visit(t)), ("b", compiler.visit(A.simplify(t))))]
    for row in sorted_rows.select(*columns).collect():
        assert [row[f"{k}a"] for k in range(60)] == [row[f"{k}b"] for k in range(60)]


def test_results_do_not_depend_on_files(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    request = {"k": {"terms": {"field": "event_type"}, "aggs": {"v": {"extended_stats": {"field": "value"}}, "h": {"date_histogram": {"field": "ts", "fixed_interval": "30d"}}}}}
    seen = []
    for files in (1, 7):
        index = Index(spark, str(tmp_path / f"i{files}"), "ts", ("event_type",), bloom=("event_type",))
        index.append(events.repartition(files))
        rows = index.scan()
        page = search(rows, SearchRequest("value:>=10", sort=[("value", "desc")], size=25, tie="event_id"), catalogue.EVENTS)
        buckets = aggs.response(rows, request)["k"]["buckets"]
        seen.append(([r["event_id"] for r in page.collect()], [(b["key"], b["doc_count"], round(b["v"]["sum"], 4), [x["doc_count"] for x in b["h"]["buckets"]]) for b in buckets]))
    assert seen[0] == seen[1]


def test_words_found_in_the_text_equal_its_tokens(spark):
    """Patterns at the places of terms against the arrays of tokens."""
    from tidemark.functions import analyzers
    from tidemark.operators.filter import in_words, phrase

    long = "x" * 300
    texts = ["of the end", "OF, THE; end", f"of {long} the end", f"of{long}the", "soft he", "often the", "the of", "", None, "été of-the été", "of\nthe", "a1 of the2 the", "Of THE\u0307 x", "of the" + long]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    tokens, c = analyzers.default(F.col("t")), F.col("t")
    cases = {"one": (["the"], "and", F.array_contains(tokens, "the")), "and": (["of", "the"], "and", F.array_contains(tokens, "of") & F.array_contains(tokens, "the")), "or": (["end", "été"], "or", F.arrays_overlap(tokens, F.array(F.lit("end"), F.lit("été")))), "phrase": (["of", "the"], "phrase", phrase(tokens, ["of", "the"])), "prefix": (["of", "th"], "bool_prefix_and", F.array_contains(tokens, "of") & F.exists(tokens, lambda t: t.startswith("th")))}
    rows = df.select("i", *[F.coalesce(x, F.lit(False)).alias(f"{n}{k}") for n, (terms, mode, slow) in cases.items() for k, x in enumerate((in_words(c, terms, mode, tokens), slow))]).collect()
    assert [(r["i"], n) for r in rows for n in cases if r[n + "0"] != r[n + "1"]] == []
