"""Quality rules: a threshold table compiled into Spark projections, without user functions.

The table ``RULES`` names a numerator, a denominator and the bounds of their ratio. ``compile_rules`` turns it into one
boolean column; the measures below are built-in SQL functions only, so the whole operator is a chain of projections over
the scan, without a shuffle.

Nulls, empty texts: no words, so the base rule fails and ``kept`` is false. Every row is judged alone: repeated rows, ties
and null ids are returned as they are. Long texts are measured whole. Extra columns are ignored by the query and carried
by ``keep`` and ``judge``; measures stand beside them under a prefix that no column of the input has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh_prefix, quoted, table

SYMBOLS = "#*$%&|<>"
SQL_SPACE = r"[ \\t-\\r]+"
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from or an not have "
    "de la que el en y los las se del por un con su una no para es al lo le et les des du est qui dans sur par au pas avec pour "
    "der die und den von zu das sich mit auf für im ist dem nicht ein eine als ich er sie"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text while ``least <= numerator / denominator <= most``."""

    name: str
    numerator: str
    denominator: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 1.5, 16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("stop_words", "n_stop", "n_words", 0.02, None),
    Rule("capitals", "n_upper", "word_chars", None, 0.6),
)


def with_measures(df: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """Add the measure columns. Each step is a projection of its own, so no measure is evaluated twice.

    Windows that occur twice or more: a text whose window hashes all differ has none. Only where two agree are the windows
    themselves sorted with their places, so that the places of equal neighbours can be kept.
    """
    own, white = quoted(df.columns), r" \t\n\u000b\u000c\r"
    df = df.select(*own, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(f"{prefix}text"))

    def add(name: str, expression: str) -> None:
        nonlocal df
        df = df.withColumn(prefix + name, F.expr(expression.replace("@", prefix)))

    add("bare", f"trim(BOTH '{white}' FROM @text)")
    add("words", f"IF(@bare = '', CAST(array() AS array<string>), split(@bare, '{SQL_SPACE}'))")
    add("lines", f"filter(split(@text, '\\n'), x -> trim(BOTH '{white}' FROM x) <> '')")
    add("n_words", "CAST(size(@words) AS BIGINT)")
    add("hashes", "IF(@n_words < 4, NULL, transform(slice(@words, 1, size(@words) - 2), (w, i) -> xxhash64(w, @words[i + 1], @words[i + 2])))")
    add("some", "coalesce(size(array_distinct(@hashes)) < size(@hashes), false)")
    add("pairs", "IF(@some, sort_array(transform(slice(@words, 1, size(@words) - 2), (w, i) -> struct(concat(w, ' ', @words[i + 1], ' ', @words[i + 2]) AS t, i AS i))), NULL)")
    add(
        "places",
        """sort_array(array_distinct(flatten(filter(transform(slice(@pairs, 1, size(@pairs) - 1),
            (p, k) -> IF(p.t = @pairs[k + 1].t, array(p.i, @pairs[k + 1].i), NULL)), x -> x IS NOT NULL))))""",
    )
    add("repeat", "coalesce(aggregate(transform(@places, (p, k) -> IF(k + 1 < size(@places), least(3, get(@places, k + 1) - p), 3)), 0L, (a, x) -> a + x), 0L)")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    whole, c = F.col(f"{prefix}text"), prefix + "{}"
    return df.select(
        *own,
        c.format("n_words"),
        F.length(F.array_join(c.format("words"), "")).cast("long").alias(c.format("word_chars")),
        (F.length(whole) - F.length(F.regexp_replace(whole, f"[{SYMBOLS}]+", ""))).cast("long").alias(c.format("n_symbols")),
        (F.size(c.format("lines")) - F.size(F.array_distinct(c.format("lines")))).cast("long").alias(c.format("n_dup_lines")),
        F.col(c.format("repeat")).alias(c.format("n_repeat_words")),
        F.size(c.format("lines")).cast("long").alias(c.format("n_lines")),
        F.expr(f"CAST(size(filter({prefix}words, w -> lower(rtrim('.,', w)) IN ({stop}))) AS BIGINT)").alias(c.format("n_stop")),
        (F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]+", ""))).cast("long").alias(c.format("n_upper")),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES, prefix: str = "_q_") -> Column:
    """The conjunction of all rules as one column; products instead of quotients, so no division by zero arises."""
    kept = F.lit(True)
    for r in rules:
        top, under = F.col(prefix + r.numerator).cast("double"), F.col(prefix + r.denominator).cast("double")
        if r.least is not None:
            kept &= top >= under * F.lit(float(r.least))
        if r.most is not None:
            kept &= top <= under * F.lit(float(r.most))
    return kept


BASE_FAILED = "({0}n_words < 50 OR 100 * {0}n_repeat_words > 50 * {0}n_words)"


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, prefix: str = "_q_") -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``, all with the prefix."""
    df = with_measures(docs, prefix=prefix)
    df = df.withColumn(f"{prefix}base_failed", F.expr(BASE_FAILED.format(prefix)))
    return df.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & compile_rules(rules, prefix))


def keep(docs: DataFrame) -> DataFrame:
    """The rows that pass, with the columns they came with, whatever their names.

    The row number is a barrier: without it the optimizer moves the filter below the projections and copies every measure
    into it.
    """
    p = fresh_prefix(docs.columns, "_q_")
    judged = judge(docs, prefix=p).withColumn(f"{p}row", F.monotonically_increasing_id())
    return judged.filter(f"{p}kept AND {p}row >= 0").select(*quoted(docs.columns))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return df.select("doc_id", *[F.col(f"_q_{n}").alias(n) for n in names])


def _sql() -> str:
    checks = []
    for r in RULES:
        top, under = f"CAST({r.numerator} AS DOUBLE)", f"CAST({r.denominator} AS DOUBLE)"
        if r.least is not None:
            checks.append(f"{top} >= {under} * CAST({r.least} AS DOUBLE)")
        if r.most is not None:
            checks.append(f"{top} <= {under} * CAST({r.most} AS DOUBLE)")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
tri AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
tr AS (SELECT rid, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS g FROM tri),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tr) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(0, 3) AS r(k) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  len(lines) AS n_lines, len(list_filter(words, lambda x: lower(rtrim(x, '.,')) IN ({stop}))) AS n_stop,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
  FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {' AND '.join(checks)}) AS kept FROM b"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL = {"op7_quality_rules": _sql()}
