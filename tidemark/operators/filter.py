"""AST to Column: each query becomes one boolean column, which Catalyst pushes down like any other.

The search semantics has two truth values, so every leaf is coalesced to false before it is negated.
"""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analyzers
from ..functions.addresses import ip_key, literal_key
from ..functions.datetimes import parse as parse_date
from ..functions.datetimes import parse_literal
from ..plans import ast as A
from ..plans.dsl import resolve
from ..plans.mapping import Field, Mapping, json_value

_MARK = "\x01"
_BEGIN, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def _safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _numbers(field: Field) -> bool:
    return field.type in ("i64", "u64", "f64")


class Compiler:
    def __init__(self, mapping: Mapping):
        self.mapping = mapping

    def __call__(self, node: A.Node) -> Column:
        return self.visit(A.simplify(resolve(node, self.mapping.default_fields)))

    def visit(self, node: A.Node) -> Column:
        return getattr(self, "on_" + type(node).__name__.lower())(node)

    def on_matchall(self, _: A.MatchAll) -> Column:
        return F.lit(True)

    def on_matchnone(self, _: A.MatchNone) -> Column:
        return F.lit(False)

    def on_boost(self, node: A.Boost) -> Column:
        return self.visit(node.query)

    def on_bool(self, node: A.Bool) -> Column:
        if not (node.must or node.must_not or node.should or node.filter):
            return F.lit(True)
        parts = [self.visit(x) for x in node.must + node.filter] + [~self.visit(x) for x in node.must_not]
        least = A.required_should(node.minimum_should_match, len(node.should))
        should = [self.visit(x) for x in node.should]
        if least is None and should and not (node.must or node.filter):
            parts.append(reduce(lambda a, b: a | b, should))
        elif least is not None and least > len(should):
            return F.lit(False)
        elif least:
            parts.append(reduce(lambda a, b: a + b, [s.cast("int") for s in should]) >= least)
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def tokens(self, name: str, analyzer: str | None = None) -> tuple[Column, str]:
        field, column, path = self.mapping.find(name)
        c = json_value(column, path) if path else F.col(f"`{column}`")
        kind = analyzer or ("raw" if path else field.tokenizer)
        return (c if field.array and not path else analyzers.analyze(kind, c)), kind

    def text(self, name: str) -> Column:
        _, column, path = self.mapping.find(name)
        return json_value(column, path) if path else F.col(f"`{column}`")

    def on_term(self, node: A.Term) -> Column:
        found = self.mapping.find(node.field)
        if not found:
            return F.lit(False)
        field, column, path = found
        if path:
            c, text = json_value(column, path), str(node.value).lower() if isinstance(node.value, bool) else str(node.value)
            own = c == text
            if re.fullmatch(r"-?\d+(\.\d+)?", text):
                own = _safe(own) | _safe(c.try_cast("double") == float(text))
            return _safe(own)
        c = F.col(f"`{column}`")
        if field.type in ("text", "concatenate"):
            if field.array:
                return _safe(F.array_contains(c, str(node.value)))
            if field.tokenizer == "raw":
                return _safe(c == str(node.value))
            return _safe(F.array_contains(self.tokens(node.field)[0], str(node.value)))
        value = self.literal(field, node.value)
        if field.type == "ip":
            c = F.transform(c, ip_key) if field.array else ip_key(c)
        return F.lit(False) if value is None else _safe(F.array_contains(c, value) if field.array else c == value)

    @staticmethod
    def literal(field: Field, value: Any, format: str | None = None) -> Column | None:
        """A query literal in the field's type; None if it is none of it."""
        try:
            if field.type in ("i64", "u64"):
                number = float(value)
                return F.lit(int(value) if str(value).lstrip("-").isdigit() else int(number)) if number == int(number) else F.lit(number)
            if field.type == "f64":
                return F.lit(float(value))
            if field.type == "bool":
                return F.lit({"true": True, "false": False}[str(value).lower()])
            if field.type == "datetime":
                return parse_literal(value, field.precision, format)
            if field.type == "ip":
                return F.lit(literal_key(str(value)))
        except (ValueError, KeyError, OverflowError):
            return None
        return F.lit(str(value))

    def on_termset(self, node: A.TermSet) -> Column:
        out = []
        for name, values in node.terms:
            found = self.mapping.find(name)
            if not found or not values:
                continue
            field, column, path = found
            if field.type == "text" and not path and field.tokenizer == "raw" and not field.array:
                out.append(_safe(F.col(f"`{column}`").isin([str(v) for v in values])))
            elif field.type == "text" and not path:
                out.append(_safe(F.arrays_overlap(self.tokens(name)[0], F.array(*[F.lit(str(v)) for v in values]))))
            elif field.type in ("i64", "u64", "f64", "bool", "datetime") and not path and not field.array:
                literals = [c for c in (self.literal(field, v) for v in values) if c is not None]
                out.append(_safe(F.col(f"`{column}`").isin(literals)) if literals else F.lit(False))
            else:
                out += [self.visit(A.Term(name, v)) for v in values]
        return reduce(lambda a, b: a | b, out) if out else F.lit(False)

    def on_exists(self, node: A.Exists) -> Column:
        found = self.mapping.find(node.field)
        if not found:
            below = [n for n in self.mapping.fields if n.startswith(node.field + ".")]
            return reduce(lambda a, b: a | b, [self.visit(A.Exists(n)) for n in below]) if below else F.lit(False)
        field, column, path = found
        c = F.col(f"`{column}`")
        if path:
            return json_value(column, path).isNotNull()
        if field.type == "json":
            return _safe(c.isNotNull() & ~c.cast("string").isin("{}", "null"))
        return _safe(F.exists(c, lambda x: x.isNotNull())) if field.array else c.isNotNull()

    def on_fulltext(self, node: A.FullText) -> Column:
        found = self.mapping.find(node.field)
        if not found:
            return F.lit(False)
        field, _, path = found
        if field.type not in ("text", "concatenate") and not path:
            value = self.literal(field, node.text)
            if value is None:
                if node.lenient or node.mode == "phrase_or_and":
                    return F.lit(False)
                raise ValueError(f"{node.text!r} is not a {field.type}")
            return self.visit(A.Term(node.field, node.text))
        tokens, kind = self.tokens(node.field, node.analyzer)
        terms = analyzers.tokens_of(kind, node.text)
        if not terms:
            return F.lit(node.zero_terms == "all")
        mode = node.mode
        if mode == "phrase_or_and":
            mode = "phrase" if field.record == "position" else "and"
        if kind == "default" and not field.array and not (mode == "phrase" and (node.slop or field.record != "position")):
            return _safe(in_words(self.text(node.field), terms, mode, tokens))
        if mode.startswith("bool_prefix"):
            parts = [F.array_contains(tokens, t) for t in terms[:-1]] + [F.exists(tokens, lambda t: t.startswith(terms[-1]))]
            return _safe(reduce((lambda a, b: a & b) if mode.endswith("and") else (lambda a, b: a | b), parts))
        if len(terms) == 1:
            return _safe(F.array_contains(tokens, terms[0])) if path is None or kind != "raw" else self.visit(A.Term(node.field, node.text))
        if mode == "and":
            return _safe(reduce(lambda a, b: a & b, [F.array_contains(tokens, t) for t in dict.fromkeys(terms)]))
        if mode == "or":
            return _safe(F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in dict.fromkeys(terms)])))
        if field.record != "position":
            raise ValueError(f"{node.field} keeps no positions, so it has no phrases")
        return _safe(phrase(tokens, terms, node.slop))

    def on_phraseprefix(self, node: A.PhrasePrefix) -> Column:
        if not self.mapping.find(node.field):
            return F.lit(False)
        tokens, kind = self.tokens(node.field, node.analyzer)
        terms = analyzers.tokens_of(kind, node.text)
        if not terms:
            return F.lit(False)
        return _safe(F.contains(_joined(tokens), F.lit(_MARK + _MARK.join(terms))))

    def on_range(self, node: A.Range) -> Column:
        found = self.mapping.find(node.field)
        if not found:
            return F.lit(False)
        field, column, path = found
        if field.type == "bool":
            raise ValueError("a range over a bool is not defined")
        if path:
            return self.dynamic_range(json_value(column, path), node)
        bounds = []
        for b in (node.lower, node.upper):
            value = None if b is None else self.literal(field, b[0], node.format)
            if b is not None and value is None:
                raise ValueError(f"{b[0]!r} is not a {field.type}")
            bounds.append(None if b is None else (value, b[1]))
        c = F.col(f"`{column}`")
        key = ip_key if field.type == "ip" else (lambda x: x)
        if field.array:
            return _safe(F.exists(c, lambda x: _between(key(x), *bounds)))
        return _safe(_between(key(c), *bounds))

    def dynamic_range(self, c: Column, node: A.Range) -> Column:
        """A range over a value without a declared type: as numbers if the bounds are numbers, else as dates if they are
        dates, and as text for values that are neither."""
        ends = (node.lower, node.upper)
        number, date = c.try_cast("double"), parse_date(c).cast("timestamp_ntz")
        if all(b is None or re.fullmatch(r"-?\d+(\.\d+)?", str(b[0])) for b in ends):
            return _safe(_between(number, *[b and (F.lit(float(b[0])), b[1]) for b in ends]))
        as_text = _safe(_between(c, *[b and (F.lit(str(b[0])), b[1]) for b in ends]) & number.isNull())
        try:
            dates = [b and (parse_literal(b[0], "us", node.format), b[1]) for b in ends]
        except ValueError:
            return as_text
        return _safe(_between(date, *dates)) | (as_text & date.isNull())

    def on_wildcard(self, node: A.Wildcard) -> Column:
        if not self.mapping.find(node.field):
            return F.lit(False)
        tokens, kind = self.tokens(node.field)
        fold = kind != "raw" and kind != "whitespace"
        value = node.value.lower() if fold else node.value
        if not node.case_insensitive and (m := re.fullmatch(r"((?:[^*?\\]|\\.)+)\*", value)):
            start = re.sub(r"\\(.)", r"\1", m[1])
            return _safe(F.exists(tokens, lambda t: t.startswith(start)))
        pattern, at = [], 0
        while at < len(value):
            if value[at] == "\\" and at + 1 < len(value):
                pattern.append(re.escape(value[at + 1]))
                at += 2
                continue
            pattern.append({"*": ".*", "?": "."}.get(value[at]) or re.escape(value[at]))
            at += 1
        flags = "(?is)" if node.case_insensitive else "(?s)"
        return _safe(F.exists(tokens, lambda t: t.rlike(f"{flags}^(?:{''.join(pattern)})$")))

    def on_regex(self, node: A.Regex) -> Column:
        found = self.mapping.find(node.field)
        if not found:
            return F.lit(False)
        if found[0].type not in ("text", "json"):
            raise ValueError("a regex needs a text field")
        if re.search(r"(?<!\\)\$|(?<![\\\[])\^|\\b", node.regex):
            raise ValueError("a regex is anchored by itself and takes no anchors")
        tokens, kind = self.tokens(node.field)
        flag = "(?i)" if kind not in ("raw", "whitespace") and not node.regex.startswith("(?i)") else ""
        return _safe(F.exists(tokens, lambda t: t.rlike(f"{flag}^(?:{node.regex})$")))


def in_words(c: Column, terms: list[str], mode: str, tokens: Column) -> Column:
    """Terms among the words that the default analyzer finds, without cutting the text into an array.

    A word is a longest run of letters and digits, so its ends can be looked at where the term stands; texts that lack a
    term even as a part of a word are out before any pattern is tried. Only texts with words too long to be terms, which
    phrases step over, are cut.
    """
    text = F.lower(c)
    has = lambda t: F.contains(text, F.lit(t)) & text.rlike(f"{_BEGIN}{t}{_END}")
    every = lambda parts: reduce(lambda a, b: a & b, parts)
    some = lambda parts: reduce(lambda a, b: a | b, parts)
    long = text.rlike(r"[\p{L}\p{N}]{64}")
    if mode.startswith("bool_prefix"):
        start = F.contains(text, F.lit(terms[-1])) & text.rlike(_BEGIN + terms[-1]) & (~long | F.exists(tokens, lambda t: t.startswith(terms[-1])))
        parts = [has(t) for t in terms[:-1]] + [start]
        return (every if mode.endswith("and") else some)(parts)
    once = list(dict.fromkeys(terms))
    if mode != "phrase" or len(terms) == 1:
        return (some if mode == "or" else every)([has(t) for t in once])
    near = text.rlike(_BEGIN + r"[^\p{L}\p{N}]+".join(terms) + _END)
    return every([F.contains(text, F.lit(t)) for t in once]) & (near | (long & phrase(tokens, terms)))


def _joined(tokens: Column) -> Column:
    return F.concat(F.lit(_MARK), F.array_join(tokens, _MARK), F.lit(_MARK))


def _between(c: Column, low, high) -> Column:
    out = c.isNotNull()
    if low is not None:
        out &= (c >= low[0]) if low[1] else (c > low[0])
    if high is not None:
        out &= (c <= high[0]) if high[1] else (c < high[0])
    return out


def phrase(tokens: Column, terms: list[str], slop: int = 0) -> Column:
    """The terms in order. With slop, the terms' shifts against the phrase may spread by that much."""
    if not slop:
        return F.contains(_joined(tokens), F.lit(_MARK + _MARK.join(terms) + _MARK))
    n = len(terms)

    def near(own: Column) -> Column:
        def at(b: Column) -> Column:
            hit = []
            for i, t in enumerate(terms):
                first, last = F.greatest(b + (i + 1), F.lit(1)), b + (i + slop + 1)
                hit.append((last >= 1) & F.array_contains(F.slice(own, first, F.greatest(last - first + 1, F.lit(0))), t))
            return reduce(lambda x, y: x & y, hit)

        every = reduce(lambda x, y: x & y, [F.array_contains(own, t) for t in dict.fromkeys(terms)])
        return every & F.exists(F.sequence(F.lit(-n), F.size(own)), at)

    # The tokens are the one element of an array, so that the lambda has them computed once.
    return F.exists(F.array(tokens), near)


#: Sets of more values are joined instead of being part of the plan.
MOST_LITERALS = 1000


def split_term_sets(node: A.Node, mapping: Mapping) -> tuple[A.Node, list[tuple[str, list]]]:
    """A query without the large term sets that each match has to meet, and those as (column, distinct values)."""
    out = []

    def large(x: A.Node) -> bool:
        if not isinstance(x, A.TermSet) or len(x.terms) != 1 or len(x.terms[0][1]) <= MOST_LITERALS:
            return False
        name, values = x.terms[0]
        found = mapping.find(name)
        if not found or found[2] or found[0].array or not (found[0].type == "i64" or found[0].type == "text" and found[0].tokenizer == "raw"):
            return False
        if found[0].type == "i64":
            values = [int(v) for v in values if re.fullmatch(r"-?\d{1,18}", str(v))]
        out.append((found[1], list(dict.fromkeys(values if found[0].type == "i64" else map(str, values)))))
        return True

    if large(node):
        return A.MatchAll(), out
    if isinstance(node, A.Bool) and not node.should:
        node = replace(node, must=tuple(x for x in node.must if not large(x)), filter=tuple(x for x in node.filter if not large(x)))
    return node, out


def compile_query(node: A.Node, mapping: Mapping) -> Column:
    return Compiler(mapping)(node)


def search(df: DataFrame, node: A.Node, mapping: Mapping) -> DataFrame:
    """The rows that match."""
    return df.filter(compile_query(node, mapping))
