"""The user's query language: a recursive-descent parser from text to AST.

expr := and-chain (OR and-chain)*; AND binds tighter than OR, NOT and - tightest. Clauses side by side are joined by the
default operator. Leaves: word, field:word, "phrase"~slop, "prefix phrase"*, 'all of these', wildcards, field:IN [a b],
field:[a TO b}, field:>=1, field:*, *, /regex/, (group), each with ^boost.
"""

from __future__ import annotations

import re

from . import ast as A


class QueryError(ValueError):
    pass


_WORD_END = set(" \t\r\n()\"'")
_FIELD = re.compile(r"((?:[^\s:\"'()\[\]{}^~/*?\\<>=!+-]|\\.)(?:[^\s:\"'()\[\]{}^~/*?\\]|\\.)*):(?!//)")


class _Parser:
    def __init__(self, text: str, fields: tuple[str, ...] | None, operator: str):
        self.s, self.at, self.fields, self.operator = text, 0, fields, operator

    # -- helpers
    def space(self) -> None:
        while self.at < len(self.s) and self.s[self.at].isspace():
            self.at += 1

    def peek(self, n: int = 1) -> str:
        return self.s[self.at : self.at + n]

    def keyword(self, word: str) -> bool:
        self.space()
        end = self.at + len(word)
        if self.s[self.at : end] == word and (end >= len(self.s) or self.s[end].isspace() or self.s[end] == "("):
            self.at = end
            return True
        return False

    def ahead(self, word: str) -> bool:
        at = self.at
        found = self.keyword(word)
        self.at = at
        return found

    # -- grammar
    def expression(self, nested: bool = False) -> A.Node:
        groups: list[list[tuple[str, A.Node]]] = [[]]
        explicit = False
        while True:
            self.space()
            if self.at >= len(self.s):
                if nested:
                    raise QueryError("a parenthesis is not closed")
                break
            if self.peek() == ")":
                if not nested:
                    raise QueryError("unexpected )")
                break
            if self.keyword("OR"):
                if not groups[-1]:
                    raise QueryError("OR without a left side")
                groups.append([])
                explicit = True
                continue
            if self.keyword("AND"):
                if not groups[-1]:
                    raise QueryError("AND without a left side")
                self.and_next = True
                groups[-1].append(self.clause(joined=True))
                left = groups[-1][-2]
                groups[-1][-2:] = [self.join(left, groups[-1][-1])]
                continue
            groups[-1].append(self.clause())
        groups = [g for g in groups if g]
        if not groups:
            return A.MatchNone() if nested else A.MatchAll()
        if explicit:
            own = [self.group(g) for g in groups]
            return own[0] if len(own) == 1 else A.Bool(should=tuple(own))
        return self.group(groups[0])

    @staticmethod
    def join(left: tuple[str, A.Node], right: tuple[str, A.Node]) -> tuple[str, A.Node]:
        must, must_not = [], []
        for sign, x in (left, right):
            if sign == "and":
                must += x.must
                must_not += x.must_not
            else:
                (must_not if sign == "-" else must).append(x)
        return "and", A.Bool(must=tuple(must), must_not=tuple(must_not))

    def group(self, clauses: list[tuple[str, A.Node]]) -> A.Node:
        if len(clauses) == 1:
            sign, x = clauses[0]
            return A.Bool(must_not=(x,)) if sign == "-" else x
        must = tuple(x for sign, x in clauses if sign == "+" or (sign != "-" and self.operator == "and"))
        should = tuple(x for sign, x in clauses if sign in ("", "and") and self.operator == "or")
        return A.Bool(must=must, must_not=tuple(x for sign, x in clauses if sign == "-"), should=should)

    def clause(self, joined: bool = False) -> tuple[str, A.Node]:
        self.space()
        if self.keyword("NOT"):
            sign, x = self.clause()
            return ("", x) if sign == "-" else ("-", x)
        if self.peek() == "-" and self.peek(2)[1:].strip():
            self.at += 1
            return "-", self.clause()[1]
        if self.peek() == "+" and self.peek(2)[1:].strip():
            self.at += 1
            return "+", self.clause()[1]
        return "", self.boosted(self.leaf(None))

    def boosted(self, node: A.Node) -> A.Node:
        if m := re.compile(r"\^(\d+(?:\.\d+)?)").match(self.s, self.at):
            self.at = m.end()
            return A.Boost(node, float(m[1]))
        return node

    def leaf(self, field: str | None) -> A.Node:
        self.space()
        c = self.peek()
        if not c:
            raise QueryError("a clause is missing")
        if c == "(":
            self.at += 1
            old = self.fields
            if field:
                self.fields = (field,)
            out = self.expression(nested=True)
            self.fields = old
            self.at += 1
            return out
        if field is None and (m := _FIELD.match(self.s, self.at)):
            self.at = m.end()
            return self.leaf(re.sub(r"\\(.)", r"\1", m[1]))
        if c in "[{" or self.peek(1) in "<>":
            return self.range(field)
        if c in "\"'":
            return self.phrase(field, c)
        if c == "/" and (m := re.compile(r"/((?:[^/\\]|\\.)*)/").match(self.s, self.at)):
            self.at = m.end()
            return self.each(field, lambda f: A.Regex(f, m[1].replace("\\/", "/")))
        if self.keyword("IN"):
            self.space()
            m = re.compile(r"\[([^\]]*)\]").match(self.s, self.at)
            if not m or field is None:
                raise QueryError("IN needs a field and a list in brackets")
            self.at = m.end()
            values = tuple(a or b for a, b in re.findall(r'"([^"]*)"|(\S+)', m[1]))
            return A.TermSet(((field, values),)) if values else A.MatchNone()
        return self.word(field)

    def each(self, field: str | None, make) -> A.Node:
        if field is not None:
            return make(field)
        if not self.fields:
            raise QueryError("no default field to search in")
        own = [make(f) for f in self.fields]
        return own[0] if len(own) == 1 else A.Bool(should=tuple(own))

    def one(self, field: str | None) -> str:
        if field is not None:
            return field
        if not self.fields or len(self.fields) != 1:
            raise QueryError("a range needs a field")
        return self.fields[0]

    def range(self, field: str | None) -> A.Node:
        field = self.one(field)
        if m := re.compile(r"(>=|<=|>|<)\s*(\"[^\"]*\"|[^\s()]+)").match(self.s, self.at):
            self.at = m.end()
            bound = (m[2].strip('"'), m[1].endswith("="))
            return A.Range(field, lower=bound) if m[1][0] == ">" else A.Range(field, upper=bound)
        m = re.compile(r"([\[{])\s*(\"[^\"]*\"|\S+)\s+TO\s+(\"[^\"]*\"|[^\s\]}]+)\s*([\]}])").match(self.s, self.at)
        if not m:
            raise QueryError(f"a range is malformed at {self.at}")
        self.at = m.end()
        low, high = m[2].strip('"'), m[3].strip('"')
        return A.Range(field, None if low == "*" else (low, m[1] == "["), None if high == "*" else (high, m[4] == "]"))

    def phrase(self, field: str | None, quote: str) -> A.Node:
        at, out = self.at + 1, []
        while at < len(self.s) and self.s[at] != quote:
            if self.s[at] == "\\" and at + 1 < len(self.s):
                at += 1
            out.append(self.s[at])
            at += 1
        if at >= len(self.s):
            raise QueryError("a quote is not closed")
        self.at, text = at + 1, "".join(out)
        if quote == "'":
            return self.each(field, lambda f: A.FullText(f, text, "and"))
        if self.peek() == "*":
            self.at += 1
            return self.each(field, lambda f: A.PhrasePrefix(f, text))
        slop = 0
        if m := re.compile(r"~(\d+)").match(self.s, self.at):
            self.at, slop = m.end(), int(m[1])
        return self.each(field, lambda f: A.FullText(f, text, "phrase", slop))

    def word(self, field: str | None) -> A.Node:
        at, out, wild = self.at, [], False
        while at < len(self.s) and self.s[at] not in _WORD_END and not re.compile(r"\^\d").match(self.s, at):
            if self.s[at] == "\\" and at + 1 < len(self.s):
                out.append(self.s[at : at + 2])
                at += 2
                continue
            wild |= self.s[at] in "*?"
            out.append(self.s[at])
            at += 1
        if at == self.at:
            raise QueryError(f"unexpected {self.s[at]} at {at}")
        self.at, raw = at, "".join(out)
        if raw == "*":
            return A.MatchAll() if field is None else A.Exists(field)
        if wild:
            return self.each(field, lambda f: A.Wildcard(f, raw))
        text = re.sub(r"\\(.)", r"\1", raw)
        return self.each(field, lambda f: A.FullText(f, text, "phrase_or_and"))


def parse(text: str, fields: tuple[str, ...] | list[str] | None = None, operator: str = "and") -> A.Node:
    """The AST of a query string. ``operator`` joins clauses that stand side by side (native API: and; DSL: or)."""
    p = _Parser(text, tuple(fields) if fields else None, operator.lower())
    return p.expression()
