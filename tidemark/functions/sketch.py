"""DDSketch rows as DataFrame operations: merging sparse buckets and reading quantiles, by built-in functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAMMA = 1 + 2 / 128
BIAS = 1 - math.floor(math.log(1e-9) / math.log(GAMMA))


def bucket_key(c: Column) -> Column:
    """The bucket of a value that is not negative: 0 below 1, else by its logarithm."""
    return F.when(c < 1, 0).otherwise(F.floor(F.log(c) / F.log(F.lit(GAMMA))) + BIAS).cast("smallint")


def build(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A sketch row for each group: keys, counts, count, sum, min, max, flags. Null and negative values are left out."""
    c = F.col(f"`{value}`").cast("double")
    rows = df.filter(c >= 0).withColumn("_key", bucket_key(c)).groupBy(*by, "_key").agg(F.count("*").alias("_n"), F.sum(c).alias("_s"), F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    pairs = F.array_sort(F.collect_list(F.struct("_key", "_n")))
    return rows.groupBy(*by).agg(pairs.alias("_b"), F.sum("_n").alias("count"), F.sum("_s").alias("sum"), F.min("_lo").alias("min"), F.max("_hi").alias("max")).select(*by, F.col("_b._key").alias("keys"), F.col("_b._n").alias("counts"), "count", "sum", "min", "max", F.lit(0).alias("flags"))


SKETCH = "STRUCT<keys: ARRAY<SMALLINT>, counts: ARRAY<BIGINT>, total_count: BIGINT, global_min: DOUBLE, global_max: DOUBLE, flags: INT>"


def register(spark) -> None:
    """SQL functions of the session: ``dd_quantile(sketch, q)`` and ``date_bin(interval, time)``."""
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION dd_quantile(s {SKETCH}, q DOUBLE) RETURNS DOUBLE RETURN
CASE WHEN s.total_count IS NULL OR s.total_count <= 0 THEN NULL WHEN q < 0 OR q > 1 THEN raise_error('a quantile lies between 0 and 1')
WHEN q = 0 THEN s.global_min WHEN q = 1 THEN s.global_max
ELSE greatest(s.global_min, least(s.global_max, aggregate(zip_with(s.keys, s.counts, (k, n) -> struct(CAST(k AS INT) AS k, n AS n)), struct(0L AS seen, CAST(NULL AS INT) AS k),
  (a, b) -> struct(a.seen + b.n AS seen, coalesce(a.k, IF(a.seen + b.n >= floor(q * (s.total_count - 1)) + 1, b.k, NULL)) AS k),
  a -> IF(a.k = 0, 0D, pow({GAMMA}D, CAST(abs(a.k) - {BIAS} AS DOUBLE)) * signum(CAST(a.k AS DOUBLE)))))) END""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION date_bin(step INTERVAL DAY TO SECOND, t TIMESTAMP) RETURNS TIMESTAMP RETURN timestamp_micros(unix_micros(t) - pmod(unix_micros(t), CAST(extract(DAY FROM step) * 86400000000 + extract(HOUR FROM step) * 3600000000 + extract(MINUTE FROM step) * 60000000 + extract(SECOND FROM step) * 1000000 AS BIGINT)))")


#: A call of the aggregate in SQL text: its arguments are columns, so that they hold no brackets.
_CALL = re.compile(r"\bdd_sketch\s*\(([^()]*)\)", re.I)


def expand(sql: str) -> str:
    """``dd_sketch(keys, counts, count, min, max, flags)`` in SQL text, written with built-in aggregates.

    The buckets of a group meet in one array there, which suits dashboards; for groups of millions of rows ``merge``
    sums buckets before the shuffle.
    """

    def built(m: re.Match) -> str:
        k, c, n, low, high, flags = (x.strip() for x in m[1].split(","))
        good = f"{k} IS NOT NULL AND {c} IS NOT NULL AND {n} > 0"
        checked = f"IF(size({k}) <> size({c}) OR aggregate({c}, 0L, (a, x) -> a + x) <> {n} OR coalesce({flags}, 0) <> 0 OR {low} > {high}, raise_error('malformed sketch row'), zip_with({k}, {c}, (x, y) -> struct(CAST(x AS SMALLINT) AS k, CAST(y AS BIGINT) AS n)))"
        pairs = f"flatten(collect_list({checked}) FILTER (WHERE {good}))"
        merged = f"map_from_entries(transform(array_distinct(transform({pairs}, p -> p.k)), k -> struct(k, aggregate(filter({pairs}, p -> p.k = k), 0L, (a, p) -> a + p.n))))"
        entries = f"array_sort(map_entries({merged}))"
        return f"named_struct('keys', transform({entries}, e -> e.key), 'counts', transform({entries}, e -> e.value), 'total_count', coalesce(sum({n}) FILTER (WHERE {good}), 0L), 'global_min', min({low}) FILTER (WHERE {good}), 'global_max', max({high}) FILTER (WHERE {good}), 'flags', 0)"

    return _CALL.sub(built, sql)


def merge(df: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group: keys, counts (by key), count, sum, min, max.

    Rows with nulls and empty sketches are left out; rows whose arrays or counts disagree, or with flags, are errors.
    Buckets are summed by key before the shuffle, so a group of any number of rows is safe.
    """
    good = df.filter(F.col("keys").isNotNull() & F.col("counts").isNotNull() & F.col("count").isNotNull() & (F.col("count") > 0))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    fault = (F.size("keys") != F.size("counts")) | (total != F.col("count")) | (F.coalesce(F.col("flags"), F.lit(0)) != 0) | (F.col("min") > F.col("max"))
    good = good.withColumn("keys", F.when(fault, F.raise_error(F.lit("malformed sketch row"))).otherwise(F.col("keys")))
    # The totals of a row travel with its first bucket, so the rows are read once.
    first = lambda c: F.when(F.col("pos") == 0, F.col(c))
    buckets = good.select(*by, "count", "sum", "min", "max", F.posexplode(F.arrays_zip("keys", "counts"))).groupBy(*by, F.col("col.keys").alias("key")).agg(F.sum("col.counts").alias("n"), F.sum(first("count")).alias("count"), F.sum(first("sum")).alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))
    rows = buckets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("b"), F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))
    return rows.filter("count > 0").select(*by, "count", "sum", "min", "max", F.col("b.key").alias("keys"), F.col("b.n").alias("counts"))


def quantile(keys: Column, counts: Column, count: Column, low: Column, high: Column, q: float) -> Column:
    """The value at rank floor(q (n - 1)) + 1, within [min, max]; null for an empty sketch."""
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    if q == 0:
        return F.when(count > 0, low)
    if q == 1:
        return F.when(count > 0, high)
    rank = F.floor(F.lit(q) * (count - 1)) + 1
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("key"))
    step = lambda a, b: F.struct((a["seen"] + b["n"]).alias("seen"), F.coalesce(a["key"], F.when(a["seen"] + b["n"] >= rank, b["key"].cast("int"))).alias("key"))
    pairs = F.zip_with(keys, counts, lambda k, n: F.struct(k.alias("key"), n.cast("long").alias("n")))
    key = F.aggregate(pairs, start, step)["key"]
    value = F.when(key == 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), (F.abs(key) - BIAS).cast("double")) * F.signum(key.cast("double")))
    return F.when(count > 0, F.greatest(low, F.least(high, value)))
