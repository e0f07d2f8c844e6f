"""Whole results where a limit or a size cut them, on small tables."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggs

MINUTE = 60_000


def test_gaps_over_more_buckets_than_a_response_takes(spark):
    last = 140_000
    rows = spark.createDataFrame([("a", 0), ("a", 7), ("a", last), ("b", 3), ("b", 5)], "k string, m long").withColumn("ts", F.timestamp_millis(F.col("m") * MINUTE))
    request = {"d": {"date_histogram": {"field": "ts", "fixed_interval": "1m"}}}
    out = aggs.aggregate(rows, request)["d"]
    got = out.agg(F.count("*"), F.count_distinct("d"), F.min("d"), F.max("d"), F.sum("doc_count")).first()
    assert tuple(got) == (last + 1, last + 1, 0, last * MINUTE, 5)
    assert {(r.d // MINUTE, r.doc_count) for r in out.filter("doc_count > 0").collect()} == {(0, 1), (3, 1), (5, 1), (7, 1), (last, 1)}
    nested = aggs.aggregate(rows, {"k": {"terms": {"field": "k"}, "aggs": request}})["k>d"]
    assert sorted(map(tuple, nested.groupBy("k").agg(F.count("*"), F.sum("doc_count")).collect())) == [("a", last + 1, 3), ("b", 3, 2)]
    with pytest.raises(Exception, match="more than 65000 buckets"):  # what is collected stays bounded
        aggs.response(rows, request)


def test_terms_of_no_size_are_all_terms(spark, tmp_path):
    from tidemark import catalogue

    rows = spark.range(1300 * 60).select((F.col("id") % 1300).alias("user_id"), (F.col("id") % 2).alias("v")).unionAll(spark.createDataFrame([(5000, 1)], "user_id long, v long"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.queries()["agg_terms_min_count"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(u, 60) for u in range(1300)]
    nested = {"u": {"terms": {"field": "user_id", "min_doc_count": 60, "size": None}, "aggs": {"v": {"terms": {"field": "v", "size": None}}}}}
    assert sorted(map(tuple, aggs.aggregate(rows, nested)["u>v"].collect())) == [(u, u % 2, 60) for u in range(1300)]
    with pytest.raises(aggs.AggError):
        aggs.aggregate(rows, {"u": {"terms": {"field": "user_id", "size": 0}}})


def test_dates_are_tried_by_their_shape_with_the_same_results(spark):
    from tidemark.functions import datetimes

    texts = [
        "2024-01-05T10:00:00Z", "2024-01-05t10:00:00z", "+12024-01-05T10:00:00", "2024-01-05T10:00:00.123+05:30", "2024-01-05T10:00:00.5Z", "2024-01-05T10:00:00.123456Z", "2024-01-05T10:00:00.123456.123Z", "2024-01-05T24:00:00Z", "2024-01-05 10:00:00",
        "2024-01-05 10:00:00.123456", "2024-01-05", "-2024-01-05", "0005-01-01", "2024-1-5", "2024-02-30", " 2024-01-05", "2024-01-05 ", "2024-01-05\n", "2024/01/05", "2024/13/05", "5 Jan 2024 10:00:00 +0000", "Fri, 5 jan 2024 10:00:00 +0100", "fri, 2024-01-05",
        "Fri, Fri, 2024-01-05", "Fri, ", "000005 Jan 2024 10:00:00 +0000", "5 Sept 2024 10:00:00 +0000", "1 January 2024 10:00:00 +0000", "1704448800", "1704448800000", "-1704448800000000000", "1234567", "20240105", "12345678901234567890", "20240105101112", "05.01.2024 10h11",
        "no date", "", None, "9" * 300, "٢٠٢٤-01-05", "2024-ſ", "Fri, 1704448800", "2024-01", "2024", "5 January 2024 10:00:00 +0000", "5.1.2024 3:04 PM", "05.01.2024 10H11", "20240105[101112", "2024-12", "1 May 2024 10:00:00 +0000",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    custom = ("yyyyMMdd[HHmmss]", "dd.MM.yyyy HH'h'mm", "yyyy[-MM]", "d MMMM yyyy HH:mm:ss Z", "d.M.yyyy h:mm a")
    for formats in (datetimes.FORMATS, custom):
        bare = F.regexp_replace("t", r"^[A-Za-z]{3}, ", "")
        want = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats], F.when(F.col("t").rlike(r"^-?\d{8,19}$"), datetimes.from_unix(F.col("t").try_cast("long"))))
        got = rows.select("t", datetimes.parse(F.col("t"), formats).alias("got"), want.alias("want"))
        assert got.filter("NOT got <=> want").collect() == [] and got.filter("got IS NOT NULL").count() >= 8
    # Of the formats, none is tried on numbers and words, and one at most on a date.
    tried = rows.select("t", sum(F.when(F.col("t").rlike(datetimes._shape(f)), 1).otherwise(0) for f in datetimes.FORMATS).alias("n"))
    assert max(r.n for r in tried.collect()) == 1 and tried.filter("t IN ('no date', '1704448800', '1704448800000', '') AND n > 0").count() == 0


def test_merges_are_bounded_by_bytes_and_rows(spark, tmp_path, monkeypatch):
    from tidemark.plans import config as C
    from tidemark.sources import catalog

    def plan(sizes, rows=300_000, kind="stable_log", target=10_000_000):
        files = [{"file": f"f{k:02}", "num_docs": rows, "bytes": n, "merges": 0, "age": 0, "time_end": None} for k, n in enumerate(sizes)]
        return [sorted(r["bytes"] for r in g) for g in catalog.plan_policy(files, C.MergePolicy(kind), target)]

    mb = 1 << 20
    for kind in ("stable_log", "limit_merge"):
        assert plan([20 * mb] * 12, kind=kind) == [[20 * mb] * 3] * 3  # the rest waits for more
        assert plan([20 * mb] * 5 + [40 * mb] * 20, kind=kind) == [[20 * mb] * 3]  # large files are mature
        assert plan([mb] * 12, kind=kind) == [[mb] * 12] and plan([mb] * 9, kind=kind) == []
        assert plan([mb] * 12, 3_000_000, kind) == [[mb] * 4] * 3 and plan([mb] * 12, kind=kind, target=300_000) == []
    assert [len(g) for g in catalog.plan_merges([(f"f{k}", 10) for k in range(12)], 1000, sizes={f"f{k}": 20 * mb for k in range(12)})] == [3] * 4

    index = catalog.Index(spark, f"{tmp_path}/index")
    for k in range(12):
        index.append(spark.range(k * 100, k * 100 + 100).select("id", F.md5(F.col("id").cast("string")).alias("text")), files=1)
    most = max(r.bytes for r in index.manifest().select("bytes").collect())
    monkeypatch.setattr(catalog, "MERGE_BYTES", 4 * most)
    assert index.merge(C.MergePolicy()) == 8
    files = index.manifest().select("num_docs", "merges").collect()
    assert sorted(r.id for r in index.scan().collect()) == list(range(1200))
    assert sorted(r.num_docs for r in files) == [100] * 4 + [400] * 2 and sum(r.merges for r in files) == 2


def test_secrets_in_bytes_that_are_no_text(spark):
    import hashlib
    import random

    from tidemark.llm import secrets

    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("CAST(concat(X'ff41', CAST(concat(' password=abcdefg', id) AS BINARY)) AS STRING)").alias("text"))
    model = secrets.CRF(secrets.FEATURES, 3)
    want = hashlib.sha256(b"assign:12:20").hexdigest()
    got = secrets.scan(rows, model).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    assert sorted(map(tuple, got)) == [(k, 1, 0, 0, want) for k in range(3)]
    assert sorted(r.text for r in secrets.redact(rows, model).collect()) == ["�A password=[SECRET]"] * 3
    assert len(secrets.train(rows).weight) == secrets.FEATURES

    r = random.Random(3)
    for _ in range(500):
        base = sorted((s, r.randrange(3), s + r.randint(1, 9)) for s in (r.randrange(60) for _ in range(r.randrange(6))))
        found = [(s, s + r.randint(1, 9)) for s in range(0, 60, 5)]
        assert secrets._apart(found, base) == [(s, e) for s, e in found if not any(b[0] < e and s < b[2] for b in base)]


def test_secrets_of_a_text_with_very_many_are_found_in_step_with_its_length():
    import time

    from tidemark.llm import secrets

    text = "password=abcdef1x " * 60_000
    base, found = secrets.base_spans(text), [(k * 18 + 9, k * 18 + 17) for k in range(60_000)]
    model = secrets.CRF(secrets.FEATURES, 3)
    model_spans, secrets.field_spans = secrets.field_spans, lambda texts, model: [found]
    began = time.process_time()
    try:
        assert secrets.find(text, model) == (base, [])
    finally:
        secrets.field_spans = model_spans
    assert time.process_time() - began < 20  # compared each with each, a third as many took 11 s
