"""Aggregation trees: nested JSON requests become one ``groupBy`` for each path.

A bucket aggregation gives a DataFrame with the keys of its ancestors (k0, k1, ...), its own key, doc_count and a column for
each metric below it. Counts are exact: there is no shard size and no error bound. Percentiles and cardinalities are estimated
by sketches of bounded size, which are combined before the shuffle; ``"exact": true`` computes them from all values instead.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = {"terms", "multi_terms", "histogram", "date_histogram", "range", "composite"}
METRICS = {"avg", "sum", "min", "max", "value_count", "stats", "extended_stats", "percentiles", "cardinality", "top_hits"}
MOST_BUCKETS = 65_000
#: Buckets that ``fill_gaps`` makes of one row.
GAP_BLOCK = 50_000
_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


class AggError(ValueError):
    pass


def interval_ms(text: str) -> int:
    m = re.fullmatch(r"(-?\d+)(ms|s|m|h|d)", text.strip())
    if not m:
        raise AggError(f"{text!r} is not a fixed interval")
    return int(m[1]) * _UNITS[m[2]]


def _value(body: dict) -> Column:
    c = F.col(f"`{body['field']}`")
    return F.coalesce(c, F.lit(body["missing"])) if body.get("missing") is not None else c


def millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def metric_columns(name: str, kind: str, body: dict) -> list[Column]:
    """The aggregate columns of a metric, named name or name.part (with _ for .)."""
    if kind == "top_hits":
        raise AggError("top_hits is read with top_hits()")
    c = _value(body)
    d = c.cast("double")
    simple = {"avg": lambda: F.avg(d), "sum": lambda: F.coalesce(F.sum(d), F.lit(0.0)), "min": lambda: F.min(d), "max": lambda: F.max(d), "value_count": lambda: F.count(c)}
    if kind in simple:
        return [simple[kind]().alias(name)]
    if kind == "cardinality":
        return [(F.count_distinct(c) if body.get("exact") else F.approx_count_distinct(c, 0.02)).alias(name)]
    if kind == "percentiles":
        percents = body.get("percents", [1, 5, 25, 50, 75, 95, 99])
        make = (lambda p: F.percentile(d, p / 100)) if body.get("exact") else (lambda p: F.percentile_approx(d, p / 100, 10_000))
        return [make(p).alias(f"{name}_p{str(p).replace('.', '_')}") for p in percents]
    stats = [F.count(c).alias(f"{name}_count"), F.min(d).alias(f"{name}_min"), F.max(d).alias(f"{name}_max"), F.avg(d).alias(f"{name}_avg"), F.coalesce(F.sum(d), F.lit(0.0)).alias(f"{name}_sum")]
    if kind == "stats":
        return stats
    if kind == "extended_stats":
        sigma = float(body.get("sigma", 2))
        return stats + [
            F.sum(d * d).alias(f"{name}_sum_of_squares"), F.var_pop(d).alias(f"{name}_variance_population"), F.var_samp(d).alias(f"{name}_variance_sampling"),
            F.stddev_pop(d).alias(f"{name}_std_deviation_population"), F.stddev_samp(d).alias(f"{name}_std_deviation_sampling"),
            (F.avg(d) + sigma * F.stddev_pop(d)).alias(f"{name}_upper"), (F.avg(d) - sigma * F.stddev_pop(d)).alias(f"{name}_lower"),
        ]
    raise AggError(f"unknown metric {kind}")


def split_request(request: dict) -> tuple[str, dict, dict]:
    subs = request.get("aggs") or request.get("aggregations") or {}
    kinds = [k for k in request if k not in ("aggs", "aggregations", "meta")]
    if len(kinds) != 1:
        raise AggError("an aggregation has exactly one type")
    return kinds[0], request[kinds[0]], subs


def _key(df: DataFrame, kind: str, body: dict, name: str) -> DataFrame:
    """``df`` with the bucket key; rows outside of all buckets are dropped."""
    if kind == "terms":
        if dict(df.dtypes).get(body["field"], "").startswith("array"):
            own = F.explode(F.array_distinct(F.col(body["field"])))
            return df.withColumn(name, own)
        return df.withColumn(name, _value(body)).filter(F.col(name).isNotNull())
    if kind == "multi_terms":
        # Of multi-valued fields, each combination of values is a key. A null in one part drops the row, so concat, not concat_ws.
        parts = []
        for k, t in enumerate(body["terms"]):
            df = _exploded(df, t, f"_{name}_{k}", False)
            parts += [F.col(f"_{name}_{k}").cast("string"), F.lit("|")]
        return df.withColumn(name, F.concat(*parts[:-1])).filter(F.col(name).isNotNull()).drop(*[f"_{name}_{k}" for k in range(len(body["terms"]))])
    if kind == "histogram":
        step, offset = float(body["interval"]), float(body.get("offset", 0))
        if step <= 0:
            raise AggError("an interval is positive")
        d = _value(body).cast("double")
        out = df.withColumn(name, F.floor((d - offset) / step).cast("double") * step + offset).filter(F.col(name).isNotNull())
        if hard := body.get("hard_bounds"):
            out = out.filter(d.between(hard["min"], hard["max"]))
        return out
    if kind == "date_histogram":
        if "calendar_interval" in body:
            raise AggError("calendar intervals are not supported")
        step, offset = interval_ms(body["fixed_interval"]), interval_ms(body["offset"]) if body.get("offset") else 0
        ms = millis(_value(body))
        return df.withColumn(name, ((ms - offset) - F.pmod(ms - offset, F.lit(step)) + offset)).filter(F.col(name).isNotNull())
    if kind == "range":  # rows in no range keep their parents' keys in the result until empty ranges are filled in
        return df.withColumn(name, F.explode_outer(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c, _, _ in range_parts(body)]))))
    if kind == "composite":
        for part, spec, of, skip in composite_sources(body):
            df = _exploded(df, spec, f"{name}_{part}", not skip)
            df = df.withColumn(f"{name}_{part}", of(F.col(f"{name}_{part}")))
            if skip:
                df = df.filter(F.col(f"{name}_{part}").isNotNull())
        return df
    raise AggError(f"unknown aggregation {kind}")


def _exploded(df: DataFrame, body: dict, name: str, outer: bool) -> DataFrame:
    """``df`` with a field's value as ``name``, a row for each distinct value of a multi-valued one."""
    if dict(df.dtypes).get(body["field"], "").startswith("array"):
        values = F.array_distinct(F.col(f"`{body['field']}`"))
        return df.withColumn(name, F.explode_outer(values) if outer else F.explode(values))
    return df.withColumn(name, _value(body))


def range_parts(body: dict) -> list[tuple[str, Column, float | None, float | None]]:
    """The buckets [from, to), and those below the first and above the last, so that every value has one."""
    c, out = _value(body).cast("double"), []
    ranges = sorted(body["ranges"], key=lambda r: float("-inf") if r.get("from") is None else r["from"])
    for a, b in zip(ranges, ranges[1:], strict=False):
        if b.get("from") is None or a.get("to") is None or b["from"] < a["to"]:
            raise AggError("ranges overlap")
    if ranges and ranges[0].get("from") is not None:
        ranges.insert(0, {"to": ranges[0]["from"]})
    if ranges and ranges[-1].get("to") is not None:
        ranges.append({"from": ranges[-1]["to"]})
    for r in ranges:
        low, high = r.get("from"), r.get("to")
        key = r.get("key") or f"{'*' if low is None else float(low)}-{'*' if high is None else float(high)}"
        inside = c.isNotNull()
        if low is not None:
            inside &= c >= float(low)
        if high is not None:
            inside &= c < float(high)
        out.append((key, inside, low, high))
    return out


def composite_sources(body: dict) -> list[tuple[str, dict, Callable[[Column], Column], bool]]:
    """Of each source its name, its body, how a value becomes a key, and whether rows without one are left out."""
    out = []
    for source in body["sources"]:
        ((part, own),) = source.items()
        ((kind, spec),) = own.items()
        if kind == "histogram":
            step = float(spec["interval"])
            of = lambda c, step=step: F.floor(c.cast("double") / step).cast("double") * step
        elif kind == "date_histogram":
            step = interval_ms(spec["fixed_interval"])
            of = lambda c, step=step: millis(c) - F.pmod(millis(c), F.lit(step))
        elif kind == "terms":
            of = lambda c: c
        else:
            raise AggError(f"{kind} is no composite source")
        out.append((part, spec, of, not spec.get("missing_bucket", False)))
    return out


def _after(body: dict, name: str) -> Column | None:
    """Rows after the given key, nulls first."""
    if not body.get("after"):
        return None
    out = F.lit(False)
    same = F.lit(True)
    for source in body["sources"]:
        ((part, _),) = source.items()
        c, v = F.col(f"{name}_{part}"), body["after"].get(part)
        later = c.isNotNull() if v is None else F.coalesce(c > F.lit(v), F.lit(False))
        out |= same & later
        same &= c.eqNullSafe(F.lit(v))
    return out


def _order(body: dict, key: str) -> list[Column]:
    order = body.get("order") or {"_count": "desc"}
    out = []
    for item in order if isinstance(order, list) else [order]:
        for k, way in item.items():
            c = F.col({"_count": "doc_count", "_key": key}.get(k, k.replace(".", "_")))
            out.append(c.asc_nulls_last() if way == "asc" else c.desc_nulls_last())
    return [*out, F.col(key).asc()]


def bucket(df: DataFrame, name: str, request: dict, parents: tuple[str, ...] = (), base: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """Buckets of one aggregation, the rows with their key, and the key columns so far."""
    kind, body, subs = split_request(request)
    keyed = _key(df, kind, body, name)
    keys = [f"{name}_{part}" for part, *_ in composite_sources(body)] if kind == "composite" else [name]
    metrics = [c for n, r in subs.items() if split_request(r)[0] in METRICS - {"top_hits"} for c in metric_columns(n, *split_request(r)[:2])]
    out = keyed.groupBy(*parents, *keys).agg(F.count("*").alias("doc_count"), *metrics)
    least = body.get("min_doc_count", 0 if kind in ("histogram", "date_histogram") else 1)
    if kind in ("terms", "multi_terms"):
        if least > 1:
            out = out.filter(F.col("doc_count") >= least)
        if least == 0:
            if base is None or parents:
                raise AggError("min_doc_count 0 needs the rows that a query leaves out, and no parent")
            absent = _key(base, kind, body, name).select(name).distinct().join(out.select(name), name, "left_anti")
            out = out.unionByName(absent.withColumn("doc_count", F.lit(0).cast("long")), allowMissingColumns=True)
        size = body.get("size", 10)  # null: all buckets
        if size is not None and not 0 < (size := int(size)) <= MOST_BUCKETS:  # which also bounds the broadcast below
            raise AggError(f"size lies between 1 and {MOST_BUCKETS}")
        if parents and size is not None:
            w = Window.partitionBy(*parents).orderBy(*_order(body, name))
            out = out.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= size).drop("_rank")
        else:
            out = out.orderBy(*_order(body, name))
            out = out if size is None else out.limit(size)
        if (size is not None or least > 1) and any(split_request(r)[0] in BUCKETS for r in subs.values()):
            chosen = out.select(*parents, name)
            keyed = keyed.join(chosen if parents or size is None else F.broadcast(chosen), [*parents, name], "left_semi")
    elif kind in ("histogram", "date_histogram"):
        if body.get("extended_bounds") and least > 0:
            raise AggError("extended_bounds need min_doc_count 0")
        out = fill_gaps(out, name, kind, body, parents, most) if least == 0 else out.filter(F.col("doc_count") >= least)
    elif kind == "range":
        # One row of each parent, with its ranges as a map, takes every range; so no join is needed to find the empty ones.
        rest = [c for c in out.columns if c not in (*parents, name)]
        found = F.map_from_entries(F.collect_list(F.when(F.col(name).isNotNull(), F.struct(name, F.struct(*rest)))))
        every = out.groupBy(*parents).agg(found.alias("_ranges")).select(*parents, "_ranges", F.explode(F.array(*[F.lit(k) for k, *_ in range_parts(body)])).alias(name))
        values = {c: F.try_element_at("_ranges", F.col(name))[c] for c in rest}
        out = every.select(*parents, name, F.coalesce(values["doc_count"], F.lit(0).cast("long")).alias("doc_count"), *[v.alias(c) for c, v in values.items() if c != "doc_count"])
        keyed = keyed.filter(F.col(name).isNotNull())
    elif kind == "composite":
        if (later := _after(body, name)) is not None:
            out = out.filter(later)
        out = out.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).limit(int(body.get("size", 10)))
    return out, keyed, (*parents, *keys)


def fill_gaps(out: DataFrame, name: str, kind: str, body: dict, parents: tuple[str, ...], most: int | None = None) -> DataFrame:
    """Empty buckets between the first and the last, and out to the extended bounds; with ``most``, more are an error.

    Buckets are made in blocks that are dealt out, so that no array and no task holds a long range of them.
    """
    dated = kind == "date_histogram"
    step = interval_ms(body["fixed_interval"]) if dated else float(body["interval"])
    offset = (interval_ms(body["offset"]) if body.get("offset") else 0) if dated else float(body.get("offset", 0))
    ends = out.groupBy(*parents).agg(F.min(name).alias("_low"), F.max(name).alias("_high"))
    if bounds := body.get("extended_bounds"):
        low, high = (F.floor((F.lit(bounds[k]) - offset) / step) * step + offset for k in ("min", "max"))
        kind_of = "long" if dated else "double"
        ends = ends.withColumn("_low", F.least("_low", low.cast(kind_of))).withColumn("_high", F.greatest("_high", high.cast(kind_of)))
    last = F.round((F.col("_high") - F.col("_low")) / step).cast("long")
    if most is not None:
        last = F.when(last >= most, F.raise_error(F.lit(f"more than {most} buckets")).cast("long")).otherwise(last)
    ends = ends.filter("_low IS NOT NULL").select(*parents, "_low", last.alias("_last"))
    blocks = ends.select(*parents, "_low", "_last", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_last div {GAP_BLOCK}"))).alias("_block")).repartition(*parents, "_block")
    first = F.col("_block") * GAP_BLOCK
    every = blocks.select(*parents, "_low", F.explode(F.sequence(first, F.least(first + (GAP_BLOCK - 1), F.col("_last")))).alias("_k")).select(*parents, (F.col("_low") + F.col("_k") * F.lit(step).cast("long" if dated else "double")).alias(name))
    if parents:
        joined = every.join(out, [*parents, name], "left")
    else:
        joined = every.join(out, name, "left")
    return joined.withColumn("doc_count", F.coalesce("doc_count", F.lit(0)).cast("long"))


def aggregate(df: DataFrame, request: dict[str, dict], parents: tuple[str, ...] = (), path: str = "", base: DataFrame | None = None, most: int | None = None) -> dict[str, DataFrame]:
    """All aggregations of a request: path (a>b) to DataFrame. Metrics at the top are one row under the path ``''``.

    ``base`` has the rows of the index whether or not the query selects them; ``min_doc_count`` 0 finds terms there.
    ``most`` bounds the buckets that a histogram fills in.
    """
    out: dict[str, DataFrame] = {}
    metrics = []
    for name, r in request.items():
        kind, body, subs = split_request(r)
        if kind == "filter":
            raise AggError("filter aggregations are not supported; filter the query")
        if kind in METRICS:
            if not parents and kind != "top_hits":
                metrics += metric_columns(name, kind, body)
            if kind == "top_hits":
                out[f"{path}{name}"] = top_hits(df, parents, body)
            continue
        found, keyed, keys = bucket(df, name, r, parents, base, most)
        out[f"{path}{name}"] = found
        nested = {n: s for n, s in subs.items() if split_request(s)[0] in BUCKETS | {"top_hits"}}
        if nested:
            out |= aggregate(keyed, nested, keys, f"{path}{name}>", most=most)
    if metrics:
        out[path] = df.agg(*metrics)
    return out


def top_hits(df: DataFrame, parents: tuple[str, ...], body: dict) -> DataFrame:
    """The first rows of each bucket, by a window that sorts a bucket's rows; Spark drops all but ``size`` rows of each bucket in
    each task before the shuffle (a limit on the rank), so a large bucket is not moved."""
    size = int(body.get("size", 3))
    order = []
    for item in body.get("sort") or [{"_doc": "asc"}]:
        ((k, way),) = item.items() if isinstance(item, dict) else ((item, "asc"),)
        way = way["order"] if isinstance(way, dict) else way
        order.append(F.col(k).asc_nulls_last() if way == "asc" else F.col(k).desc_nulls_last())
    rank = F.row_number().over(Window.partitionBy(*parents).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= size)


def response(df: DataFrame, request: dict[str, dict], base: DataFrame | None = None) -> dict[str, Any]:
    """The nested response. Results are collected; more than ``MOST_BUCKETS`` buckets are an error."""
    flat = {}
    for path, own in aggregate(df, request, base=base, most=MOST_BUCKETS).items():
        rows = [r.asDict(True) for r in own.limit(MOST_BUCKETS + 1).collect()]
        if len(rows) > MOST_BUCKETS:
            raise AggError(f"more than {MOST_BUCKETS} buckets")
        flat[path] = rows
    return _nest(flat, request, {}, "")


def _nest(flat: dict, request: dict, outer: dict, path: str) -> dict:
    out: dict[str, Any] = {}
    for name, r in request.items():
        kind, body, subs = split_request(r)
        if kind in METRICS:
            if kind == "top_hits":
                out[name] = {"hits": [x for x in flat.get(path + name, ()) if all(x[k] == v for k, v in outer.items())]}
            elif path == "":
                row = flat[""][0]
                own = {k[len(name) :].lstrip("_") or "value": v for k, v in row.items() if k == name or k.startswith(name + "_")}
                out[name] = {"values": own} if kind == "percentiles" else own
            continue
        rows = [x for x in flat[path + name] if all(x[k] == v for k, v in outer.items())]
        keys = [f"{name}_{p}" for p, *_ in composite_sources(body)] if kind == "composite" else [name]
        buckets = []
        for x in rows if kind not in ("histogram", "date_histogram") else sorted(rows, key=lambda x: x[name]):
            b: dict[str, Any] = {"key": {k[len(name) + 1 :]: x[k] for k in keys} if kind == "composite" else x[name], "doc_count": x["doc_count"]}
            if kind == "date_histogram":
                b["key_as_string"] = dt.datetime.fromtimestamp(x[name] / 1000, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
            if body.get("show_term_doc_count_error"):
                b["doc_count_error_upper_bound"] = 0  # counts are exact
            for n, s in subs.items():
                if split_request(s)[0] in METRICS - {"top_hits"}:
                    b[n] = {k[len(n) :].lstrip("_") or "value": v for k, v in x.items() if k == n or k.startswith(n + "_")}
            nested = {n: s for n, s in subs.items() if split_request(s)[0] in BUCKETS | {"top_hits"}}
            b |= _nest(flat, nested, outer | {k: x[k] for k in keys}, f"{path}{name}>")
            buckets.append(b)
        own = {str(b["key"]): b for b in buckets} if body.get("keyed") else buckets
        out[name] = {"buckets": own} | ({"after_key": buckets[-1]["key"]} if kind == "composite" and buckets else {}) | ({"doc_count_error_upper_bound": 0} if kind == "terms" else {})
    return out
