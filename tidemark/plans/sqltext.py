"""Several SQL statements in one text."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_PART = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^;'\"`/-]+|.", re.S)


def statements(text: str) -> list[str]:
    """Split at semicolons outside of literals, identifiers and comments; comments alone are no statement."""
    out, own = [], []
    for m in _PART.finditer(text):
        if m[0] == ";":
            out.append("".join(own))
            own = []
        else:
            own.append(m[0])
    out.append("".join(own))
    bare = lambda s: re.sub(r"--[^\n]*|/\*.*?\*/", "", s, flags=re.S).strip()
    return [s.strip() for s in out if bare(s)]


def run(spark: SparkSession, text: str) -> DataFrame | None:
    """Run all statements; the last one's result."""
    out = None
    for s in statements(text):
        out = spark.sql(s)
    return out


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def analyze(df: DataFrame) -> str:
    """The plan that ran, after a run whose rows are counted and dropped, with the rows and the seconds it took."""
    seen, began = Observation(), time.perf_counter()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return f"{explain(df)}\nrows: {seen.get['rows']}, seconds: {time.perf_counter() - began:.3f}"
