"""Query AST: what a search asks for, independent of the front end it came from."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class MatchAll(Node):
    pass


@dataclass(frozen=True)
class MatchNone(Node):
    pass


@dataclass(frozen=True)
class Term(Node):
    field: str
    value: Any


@dataclass(frozen=True)
class TermSet(Node):
    terms: tuple[tuple[str, tuple[Any, ...]], ...]


@dataclass(frozen=True)
class Exists(Node):
    field: str


@dataclass(frozen=True)
class FullText(Node):
    """mode: and, or, bool_prefix_and, bool_prefix_or, phrase, phrase_or_and."""

    field: str
    text: str
    mode: str = "or"
    slop: int = 0
    zero_terms: str = "none"
    analyzer: str | None = None
    lenient: bool = False


@dataclass(frozen=True)
class PhrasePrefix(Node):
    field: str
    text: str
    analyzer: str | None = None


@dataclass(frozen=True)
class Range(Node):
    """Bounds are (value, included) or None."""

    field: str
    lower: tuple[Any, bool] | None = None
    upper: tuple[Any, bool] | None = None
    format: str | None = None


@dataclass(frozen=True)
class Wildcard(Node):
    field: str
    value: str
    case_insensitive: bool = False


@dataclass(frozen=True)
class Regex(Node):
    field: str
    regex: str


@dataclass(frozen=True)
class Bool(Node):
    must: tuple[Node, ...] = ()
    must_not: tuple[Node, ...] = ()
    should: tuple[Node, ...] = ()
    filter: tuple[Node, ...] = ()
    minimum_should_match: int | str | None = None


@dataclass(frozen=True)
class Boost(Node):
    query: Node
    boost: float


@dataclass(frozen=True)
class UserInput(Node):
    text: str
    fields: tuple[str, ...] | None = None
    operator: str = "or"
    lenient: bool = False


def required_should(wanted: int | str | None, count: int) -> int | None:
    """How many should clauses must match; None if the parameter asks nothing, count + 1 if more than there are.

    Percentages are cut towards zero; negative numbers count what may be missing and are ignored below zero.
    """
    if wanted is None:
        return None
    text = str(wanted).strip()
    n = int(float(text[:-1]) * count / 100) if text.endswith("%") else int(text)
    if text.startswith("-"):
        n = count + n
        return n if n >= 0 else None
    return n if n <= count else count + 1


def simplify(node: Node) -> Node:
    """Fold constants and flatten: the result matches the same rows."""
    if isinstance(node, Boost):
        own = simplify(node.query)
        if isinstance(own, MatchNone):
            return own
        return Boost(own.query, own.boost * node.boost) if isinstance(own, Boost) else Boost(own, node.boost)
    if not isinstance(node, Bool):
        return node
    must, must_not, should, only = ([simplify(x) for x in part] for part in (node.must, node.must_not, node.should, node.filter))
    if not (must or must_not or should or only):
        return MatchAll()
    if any(isinstance(x, MatchNone) for x in must + only) or any(isinstance(x, MatchAll) for x in must_not):
        return MatchNone()
    least = required_should(node.minimum_should_match, len(should))
    if least is not None and least > len(should):
        return MatchNone()
    if should and least is None and not (must or only) and all(isinstance(x, MatchNone) for x in should):
        return MatchNone()
    return replace(node, must=tuple(must), must_not=tuple(x for x in must_not if not isinstance(x, MatchNone)), should=tuple(should), filter=tuple(only))


def leaves(node: Node):
    """All nodes below, depth first."""
    yield node
    if isinstance(node, Boost):
        yield from leaves(node.query)
    if isinstance(node, Bool):
        for part in (node.must, node.must_not, node.should, node.filter):
            for x in part:
                yield from leaves(x)


__all__ = [n for n, v in list(globals().items()) if isinstance(v, type)] + ["required_should", "simplify", "leaves", "field"]
