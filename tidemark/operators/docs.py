"""Documents from JSON text: typed columns by a mapping, and a reason for each document that is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import analyzers, datetimes
from ..functions.addresses import ip_key
from ..plans.mapping import Field, Mapping

SOURCE, ERROR = "_source", "_error"
RESERVED = {SOURCE, "_dynamic", "_field_presence"}
_BROKEN = "_broken"


def _leaf_schema(mapping: Mapping) -> str:
    """All leaves as strings, dotted names as nested structs, so that one parse serves every field."""
    tree: dict = {}
    for name, field in mapping.fields.items():
        if field.type == "concatenate":
            continue
        at = tree
        *above, last = name.split(".")
        for part in above:
            at = at.setdefault(part, {})
        at[last] = None

    def spec(node: dict, colon: str) -> str:
        return ", ".join(f"`{k}`{colon}" + ("string" if v is None else f"struct<{spec(v, ': ')}>") for k, v in node.items())

    return ", ".join(x for x in (spec(tree, " "), f"{_BROKEN} string") if x)


def typed(c: Column, field: Field) -> Column:
    """A JSON leaf's text in the field's type; null if it is none of it."""
    if field.type in ("text", "json"):
        return c
    if field.type == "i64":
        return c.try_cast("long")
    if field.type == "u64":
        return F.when(c.rlike(r"^\d+$"), c.try_cast("decimal(20,0)"))
    if field.type == "f64":
        return c.try_cast("double")
    if field.type == "bool":
        return F.when(F.lower(c).isin("true", "false"), F.lower(c) == "true")
    if field.type == "datetime":
        return datetimes.truncate(datetimes.parse(c, field.formats or datetimes.FORMATS), field.precision)
    if field.type == "ip":
        return F.when(ip_key(c).isNotNull(), c)
    if field.type == "bytes":
        return F.try_to_binary(c, F.lit(field.formats[0] if field.formats else "base64"))
    raise ValueError(f"unknown type {field.type}")


def _column(leaf: Column, field: Field) -> Column:
    if not field.array:
        return typed(leaf, field)
    # A single value counts as a list of one.
    many = F.when(leaf.startswith("["), F.from_json(leaf, "array<string>")).when(leaf.isNotNull(), F.array(leaf))
    return F.transform(many, lambda x: typed(x, field))


def parse(raw: DataFrame, mapping: Mapping, column: str = "value") -> DataFrame:
    """One row a document: the mapping's columns, the text as ``_source``, and ``_error`` (null for good ones).

    Errors, the first that applies: ``json`` (no object), ``unknown`` (a field that a strict mapping lacks), ``timestamp``
    (missing), ``type:<field>``. Null and missing are the same. Empty text is no document.
    """
    if taken := RESERVED & set(mapping.fields):
        raise ValueError(f"reserved field names: {sorted(taken)}")
    own = raw.select(F.col(f"`{column}`").alias(SOURCE))
    own = own.withColumn("_p", F.from_json(SOURCE, _leaf_schema(mapping), {"columnNameOfCorruptRecord": _BROKEN}))
    leaves = {n: F.col("_p." + ".".join(f"`{p}`" for p in n.split("."))) for n, f in mapping.fields.items() if f.type != "concatenate"}
    own = own.select(SOURCE, "_p", *[_column(leaf, mapping.fields[n]).alias(n) for n, leaf in leaves.items()])
    wrong = []
    for n, leaf in leaves.items():
        c = F.col(f"`{n}`")
        bad = F.exists(c, lambda x: x.isNull()) & c.isNotNull() if mapping.fields[n].array else leaf.isNotNull() & c.isNull()
        wrong.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(f"type:{n}")))
    broken = F.col(SOURCE).isNull() | ~F.col(SOURCE).rlike(r"^\s*\{") | F.col(f"_p.{_BROKEN}").isNotNull()
    reasons = [F.when(broken, F.lit("json"))]
    if mapping.mode == "strict":
        tops = F.array(*[F.lit(t) for t in sorted({n.split(".")[0] for n in leaves})])
        reasons.append(F.when(F.size(F.array_except(F.json_object_keys(SOURCE), tops)) > 0, F.lit("unknown")))
    if mapping.timestamp:
        reasons.append(F.when(leaves[mapping.timestamp].isNull(), F.lit("timestamp")))
    error = F.coalesce(*reasons, *wrong, F.lit(None).cast("string"))
    joined = [concatenated(n, f, mapping).alias(n) for n, f in mapping.fields.items() if f.type == "concatenate"]
    return own.select(*[F.col(f"`{n}`") for n in leaves], *joined, SOURCE, error.alias(ERROR))


def concatenated(name: str, field: Field, mapping: Mapping) -> Column:
    """The tokens of several fields by the virtual field's own tokenizer; numbers and booleans are tokens too."""
    parts = []
    for n in field.of:
        c = F.col(f"`{n}`")
        if mapping.fields[n].array:
            parts.append(F.flatten(F.transform(c, lambda x: analyzers.analyze(field.tokenizer, x.cast("string")))))
        elif mapping.fields[n].type == "json":
            parts.append(analyzers.analyze(field.tokenizer, F.regexp_replace(c, r'"[^"]*"\s*:|[{}\[\],"]', " ")))
        else:
            parts.append(analyzers.analyze(field.tokenizer, c.cast("string")))
    if field.with_dynamic:
        known = F.array(*[F.lit(n.split(".")[0]) for n in mapping.fields])
        rest = F.map_filter(F.from_json(SOURCE, "map<string, string>"), lambda k, _: ~F.array_contains(known, k))
        parts.append(F.flatten(F.transform(F.map_values(rest), lambda v: analyzers.analyze(field.tokenizer, v))))
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(p, empty) for p in parts]) if parts else empty


def split(parsed: DataFrame, observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Good documents, and refused ones as (_source, _error); the observation counts both in the same pass."""
    if observation is not None:
        parsed = parsed.observe(observation, F.count_if(F.col(ERROR).isNull()).alias("valid"), F.count_if(F.col(ERROR).isNotNull()).alias("refused"))
    return parsed.filter(F.col(ERROR).isNull()).drop(ERROR), parsed.filter(F.col(ERROR).isNotNull()).select(SOURCE, ERROR)


def errors(parsed: DataFrame) -> DataFrame:
    """How many documents each reason refuses."""
    return parsed.filter(F.col(ERROR).isNotNull()).groupBy(F.col(ERROR).alias("reason")).agg(F.count("*").alias("n"))


def partitioned(df: DataFrame, key: Column, most: int = 200, other: int = 0) -> DataFrame:
    """``df`` with ``_partition``: the key's hash for the ``most`` largest keys, ``other`` for the rest.

    The list of keys that keep their own is at most ``most`` rows.
    """
    keyed = df.withColumn("_partition", F.coalesce(F.xxhash64(key), F.lit(other)))
    largest = keyed.groupBy("_partition").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_partition").limit(most).select("_partition", F.lit(True).alias("_own"))
    kept = keyed.join(F.broadcast(largest), "_partition", "left")
    return kept.withColumn("_partition", F.when(F.col("_own"), F.col("_partition")).otherwise(F.lit(other).cast("long"))).drop("_own")
