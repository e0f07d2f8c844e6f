"""Scores of matching rows: BM25 for terms and phrases, summed over the query's tree, multiplied by boosts.

``must`` and ``should`` clauses add their scores where they match; ``filter`` and ``must_not`` add nothing. Leaves without
term statistics (ranges, patterns, presence) score 1. Statistics are those of the whole table: one aggregate with a column
for each distinct term, one row of which reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analyzers
from ..plans import ast as A
from ..plans.dsl import resolve
from ..plans.mapping import Mapping
from .filter import Compiler

SCORE = "_score"
K1, B = 1.2, 0.75
_OPEN, _CLOSE = "\x01", "\x02"


@dataclass(frozen=True)
class Scored:
    """What is counted: a sequence of terms in a field as an analyzer cuts it."""

    field: str
    kind: str
    terms: tuple[str, ...]


def _leaf_terms(node: A.Node, compiler: Compiler) -> list[Scored]:
    """The counted sequences of a leaf; none if it has no statistics."""
    if not isinstance(node, A.Term | A.FullText) or not (found := compiler.mapping.find(node.field)):
        return []
    field, _, path = found
    if field.type not in ("text", "concatenate") or path:
        return []
    if isinstance(node, A.Term):
        return [Scored(node.field, field.tokenizer, (str(node.value),))]
    if node.mode.startswith("bool_prefix"):
        return []
    kind = node.analyzer or field.tokenizer
    terms = analyzers.tokens_of(kind, node.text)
    phrase = len(terms) > 1 and not node.slop and (node.mode == "phrase" or (node.mode == "phrase_or_and" and field.record == "position"))
    return [Scored(node.field, kind, tuple(terms))] if phrase else [Scored(node.field, kind, (t,)) for t in dict.fromkeys(terms)]


def _frequency(tokens: Column, terms: tuple[str, ...]) -> Column:
    if len(terms) == 1:
        return F.size(F.filter(tokens, lambda t: t == terms[0]))
    # Occurrences of a phrase that overlap each other count once.
    text = F.concat(F.lit(_OPEN), F.array_join(tokens, _CLOSE + _OPEN), F.lit(_CLOSE))
    wanted = _OPEN + (_CLOSE + _OPEN).join(terms) + _CLOSE
    return ((F.length(text) - F.length(F.replace(text, F.lit(wanted), F.lit("")))) / len(wanted)).cast("int")


def scored(df: DataFrame, node: A.Node, mapping: Mapping) -> DataFrame:
    """The rows that match, with ``_score``. A null or missing text has length 0 in the statistics."""
    compiler = Compiler(mapping)
    node = A.simplify(resolve(node, mapping.default_fields))
    wanted = list(dict.fromkeys(s for leaf in A.leaves(node) for s in _leaf_terms(leaf, compiler)))
    kept = [F.col(f"`{c}`") for c in df.columns]
    if not wanted:
        return df.filter(compiler.visit(node)).withColumn(SCORE, F.coalesce(_score(node, compiler, {}), F.lit(0.0)))
    texts = {key: f"_tokens{k}" for k, key in enumerate(dict.fromkeys((s.field, s.kind) for s in wanted))}
    own = df
    for (field, kind), name in texts.items():
        own = own.withColumn(name, F.coalesce(compiler.tokens(field, kind)[0], F.array().cast("array<string>")))
    own = own.select(*kept, *[F.size(n).alias(f"{n}_size") for n in texts.values()], *[_frequency(F.col(texts[s.field, s.kind]), s.terms).alias(f"_f{k}") for k, s in enumerate(wanted)])
    sums = own.agg(F.count("*").alias("n"), *[F.avg(f"{n}_size").alias(n) for n in texts.values()], *[F.count_if(F.col(f"_f{k}") > 0).alias(f"d{k}") for k in range(len(wanted))]).first()
    parts = {}
    for k, s in enumerate(wanted):
        name = texts[s.field, s.kind]
        f, mean = F.col(f"_f{k}").cast("double"), sums[name] or 1.0
        idf = F.log(F.lit(1 + (sums["n"] - sums[f"d{k}"] + 0.5) / (sums[f"d{k}"] + 0.5)))
        parts[s] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col(f"{name}_size") / mean))
    return own.filter(compiler.visit(node)).withColumn(SCORE, _score(node, compiler, parts)).select(*kept, SCORE)


def _score(node: A.Node, compiler: Compiler, parts: dict[Scored, Column]) -> Column:
    if isinstance(node, A.Boost):
        return _score(node.query, compiler, parts) * float(node.boost)
    if isinstance(node, A.MatchNone):
        return F.lit(0.0)
    if isinstance(node, A.Bool):
        counted = [_score(x, compiler, parts) for x in node.must + node.should]
        total = reduce(lambda a, b: a + b, counted) if counted else F.lit(0.0)
    else:
        terms = _leaf_terms(node, compiler)
        total = reduce(lambda a, b: a + b, [parts[s] for s in terms]) if terms else F.lit(1.0)
    return F.when(compiler.visit(node), total).otherwise(F.lit(0.0))
