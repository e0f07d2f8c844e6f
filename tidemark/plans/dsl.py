"""The JSON query DSL, lowered to the same AST as query strings. Unknown keys are errors."""

from __future__ import annotations

from typing import Any

from . import ast as A
from .querystring import parse


class DslError(ValueError):
    pass


def _known(body: dict, allowed: set[str], clause: str) -> None:
    if extra := set(body) - allowed:
        raise DslError(f"{clause}: unknown keys {sorted(extra)}")


def _boost(node: A.Node, body: Any) -> A.Node:
    return A.Boost(node, float(body["boost"])) if isinstance(body, dict) and body.get("boost") is not None else node


def _single(body: dict, clause: str, short: str) -> tuple[str, dict]:
    """{field: value} or {field: {short: value, ...}}."""
    if not isinstance(body, dict) or len(body) != 1:
        raise DslError(f"{clause} takes exactly one field")
    ((field, own),) = body.items()
    return field, own if isinstance(own, dict) else {short: own}


def escape(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def lower(query: dict | None) -> A.Node:
    if not query:
        return A.MatchAll()
    if len(query) != 1:
        raise DslError("a query has exactly one clause")
    ((name, body),) = query.items()
    make = _CLAUSES.get(name)
    if make is None:
        raise DslError(f"unknown clause {name}")
    return make(body if body is not None else {})


def _many(x: Any) -> tuple[A.Node, ...]:
    return tuple(lower(q) for q in (x if isinstance(x, list) else [x] if x else []))


def _bool(b: dict) -> A.Node:
    _known(b, {"must", "must_not", "should", "filter", "minimum_should_match", "boost"}, "bool")
    return _boost(A.Bool(_many(b.get("must")), _many(b.get("must_not")), _many(b.get("should")), _many(b.get("filter")), b.get("minimum_should_match")), b)


def _term(b: dict) -> A.Node:
    import re

    field, own = _single(b, "term", "value")
    _known(own, {"value", "boost", "case_insensitive"}, "term")
    node = A.Regex(field, "(?i)" + re.escape(str(own["value"]))) if own.get("case_insensitive") else A.Term(field, own["value"])
    return _boost(node, own)


def _terms(b: dict) -> A.Node:
    fields = {k: v for k, v in b.items() if k != "boost"}
    if len(fields) != 1:
        raise DslError("terms takes exactly one field")
    ((field, values),) = fields.items()
    return _boost(A.TermSet(((field, tuple(values if isinstance(values, list) else [values])),)), b)


def _match(b: dict) -> A.Node:
    field, own = _single(b, "match", "query")
    _known(own, {"query", "operator", "zero_terms_query", "lenient", "boost", "analyzer"}, "match")
    return _boost(A.FullText(field, str(own["query"]), own.get("operator", "or").lower(), 0, own.get("zero_terms_query", "none"), own.get("analyzer"), own.get("lenient", False)), own)


def _match_bool_prefix(b: dict) -> A.Node:
    field, own = _single(b, "match_bool_prefix", "query")
    return _boost(A.FullText(field, str(own["query"]), "bool_prefix_" + own.get("operator", "or").lower(), 0, own.get("zero_terms_query", "none"), own.get("analyzer")), own)


def _match_phrase(b: dict) -> A.Node:
    field, own = _single(b, "match_phrase", "query")
    _known(own, {"query", "slop", "analyzer", "zero_terms_query", "boost"}, "match_phrase")
    return _boost(A.FullText(field, str(own["query"]), "phrase", int(own.get("slop", 0)), own.get("zero_terms_query", "none"), own.get("analyzer")), own)


def _match_phrase_prefix(b: dict) -> A.Node:
    field, own = _single(b, "match_phrase_prefix", "query")
    return _boost(A.PhrasePrefix(field, str(own["query"]), own.get("analyzer")), own)


def _multi_match(b: dict) -> A.Node:
    fields = b.get("fields") or []
    fields = [fields] if isinstance(fields, str) else fields
    if not fields:
        raise DslError("multi_match needs fields")
    if any("^" in f or "*" in f for f in fields):
        raise DslError("multi_match takes plain field names")
    kind = b.get("type", "most_fields")
    clause = {"phrase": _match_phrase, "phrase_prefix": _match_phrase_prefix, "bool_prefix": _match_bool_prefix}.get(kind, _match)
    own = {k: v for k, v in b.items() if k in ("query", "operator", "slop", "analyzer")}
    if clause is _match:
        own.pop("slop", None)
    elif clause is _match_phrase:
        own.pop("operator", None)
    return _boost(A.Bool(should=tuple(clause({f: own}) for f in fields)), b)


def _range(b: dict) -> A.Node:
    field, own = _single(b, "range", "gte")
    _known(own, {"gt", "gte", "lt", "lte", "from", "to", "include_lower", "include_upper", "format", "boost"}, "range")
    if {"gt", "gte"} <= set(own) or {"lt", "lte"} <= set(own):
        raise DslError("range has two bounds on one side")
    low = (own["gte"], True) if own.get("gte") is not None else (own["gt"], False) if own.get("gt") is not None else (own["from"], own.get("include_lower", True)) if own.get("from") is not None else None
    high = (own["lte"], True) if own.get("lte") is not None else (own["lt"], False) if own.get("lt") is not None else (own["to"], own.get("include_upper", True)) if own.get("to") is not None else None
    return _boost(A.Range(field, low, high, own.get("format")), own)


def _pattern(b: dict, clause: str) -> A.Node:
    field, own = _single(b, clause, "value")
    value, fold = str(own.get("value", own.get("wildcard"))), bool(own.get("case_insensitive"))
    if clause == "regexp":
        return _boost(A.Regex(field, ("(?i)" if fold else "") + value), own)
    return _boost(A.Wildcard(field, escape(value) + "*" if clause == "prefix" else value, fold), own)


def _query_string(b: dict) -> A.Node:
    _known(b, {"query", "fields", "default_field", "default_operator", "boost", "lenient"}, "query_string")
    fields = b.get("fields") or ([b["default_field"]] if b.get("default_field") else None)
    return _boost(A.UserInput(b["query"], tuple(fields) if fields else None, b.get("default_operator", "or").lower(), b.get("lenient", False)), b)


_CLAUSES = {
    "bool": _bool, "term": _term, "terms": _terms, "match": _match, "match_bool_prefix": _match_bool_prefix, "match_phrase": _match_phrase,
    "match_phrase_prefix": _match_phrase_prefix, "multi_match": _multi_match, "range": _range, "query_string": _query_string,
    "match_all": lambda b: _boost(A.MatchAll(), b), "match_none": lambda b: A.MatchNone(), "exists": lambda b: A.Exists(b["field"]),
    "regexp": lambda b: _pattern(b, "regexp"), "wildcard": lambda b: _pattern(b, "wildcard"), "prefix": lambda b: _pattern(b, "prefix"),
}


def resolve(node: A.Node, default_fields: tuple[str, ...] = ()) -> A.Node:
    """Parse user input below, with the index's default fields where none are named."""
    from dataclasses import replace

    if isinstance(node, A.UserInput):
        return parse(node.text, node.fields or default_fields, node.operator)
    if isinstance(node, A.Boost):
        return replace(node, query=resolve(node.query, default_fields))
    if isinstance(node, A.Bool):
        return replace(node, **{p: tuple(resolve(x, default_fields) for x in getattr(node, p)) for p in ("must", "must_not", "should", "filter")})
    return node
