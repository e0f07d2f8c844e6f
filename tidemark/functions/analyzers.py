"""Analyzers: a name and a string column give an array of tokens, by built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 255
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}"


def _short(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: (t != "") & (F.octet_length(t) <= LONGEST))


def raw(c: Column) -> Column:
    return _short(F.array(c))


def default(c: Column) -> Column:
    return _short(F.split(F.lower(c), r"[^\p{L}\p{N}]+"))


def whitespace(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def chinese_compatible(c: Column) -> Column:
    return _short(F.regexp_extract_all(F.lower(c), F.lit(rf"([{CJK}]|[\p{{L}}\p{{N}}&&[^{CJK}]]+)"), F.lit(1)))


def source_code(c: Column) -> Column:
    """Words cut at case and digit boundaries: HTTPServer2 -> http server 2."""
    return F.transform(_short(F.regexp_extract_all(c, F.lit(r"(\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+|\p{L})"), F.lit(1))), F.lower)


def source_code_with_hex(c: Column) -> Column:
    return F.transform(_short(F.regexp_extract_all(c, F.lit(r"(\b(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{6,}\b|\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+|\p{L})"), F.lit(1))), F.lower)


def unicode_segmenter(c: Column) -> Column:
    return F.filter(F.flatten(F.sentences(c)), lambda t: t != "")


def ngram(low: int, high: int, prefix_only: bool = False) -> Callable[[Column], Column]:
    def tokens(c: Column) -> Column:
        starts = F.array(F.lit(1)) if prefix_only else F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))).otherwise(F.array().cast("array<int>"))
        every = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(i + n - 1 <= F.length(c), c.substr(i, n)))))
        return F.filter(every, lambda t: t.isNotNull())

    return tokens


def regex(pattern: str) -> Callable[[Column], Column]:
    return lambda c: F.filter(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda t: t != "")


REGISTRY: dict[str, Callable[[Column], Column]] = {
    "raw": raw, "raw_lowercase": lambda c: raw(F.lower(c)), "lowercase": lambda c: raw(F.lower(c)), "default": default, "whitespace": whitespace,
    "chinese_compatible": chinese_compatible, "source_code_default": source_code, "source_code_with_hex": source_code_with_hex, "unicode_segmenter": unicode_segmenter,
}


def _folds() -> tuple[str, str]:
    """Latin letters with marks and the plain letters they decompose to, by Unicode's own decompositions."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    kept = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


def ascii_folding(c: Column) -> Column:
    """Letters with marks become plain ones; ligatures two letters."""
    c = F.translate(c, *_folds())
    for a, b in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


FILTERS: dict[str, Callable[[Column], Column]] = {
    "remove_long": _short,
    "lower_caser": lambda tokens: F.transform(tokens, F.lower),
    "ascii_folding": lambda tokens: F.transform(tokens, ascii_folding),
}


def register(name: str, kind: str, lower: bool = True, filters: tuple[str, ...] = (), **options) -> None:
    """A tokenizer of one's own: kind is ngram, regex, simple or source_code; ``filters`` change its tokens in order."""
    if unknown := set(filters) - set(FILTERS):
        raise ValueError(f"unknown token filters {sorted(unknown)}")
    make = {"ngram": lambda: ngram(options["min_gram"], options["max_gram"], options.get("prefix_only", False)), "regex": lambda: regex(options["pattern"]), "simple": lambda: default, "source_code": lambda: source_code}[kind]()

    def tokens(c: Column) -> Column:
        out = make(F.lower(c) if lower else c)
        for f in filters:
            out = FILTERS[f](out)
        return out

    REGISTRY[name] = tokens


def analyze(name: str, c: Column) -> Column:
    if name not in REGISTRY:
        raise ValueError(f"unknown analyzer {name}")
    return REGISTRY[name](c)


def tokens_of(name: str, text: str) -> list[str]:
    """The same analysis of one query text, on the driver."""
    import re

    if name in ("raw",):
        return [text] if text and len(text.encode()) <= LONGEST else []
    if name in ("raw_lowercase", "lowercase"):
        return tokens_of("raw", text.lower())
    if name == "default":
        return [t for t in re.split(r"[\W_]+", text.lower()) if t and len(t.encode()) <= LONGEST]
    if name == "whitespace":
        return text.split()
    from pyspark.sql import SparkSession

    return SparkSession.active().range(1).select(analyze(name, F.lit(text))).first()[0]
