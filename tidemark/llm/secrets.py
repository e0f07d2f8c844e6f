"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans.

Base spans are those of the three patterns: for ``assign`` that of group 2, the secret itself, for the others that of the
match.

The field tags every token of every text as begin, inside or outside of a secret. Tokens are words of ``[A-Za-z0-9+/_=-]``
and single other signs. A text is one sequence, whatever its length; the texts of a batch are laid end to end and decoded
together. Features: length, character classes and their changes, entropy, all over the whole token; the signs beside the
token and the names of secrets before it; and of the file, its length, how much of it stands in long tokens with a digit,
and whether it names secrets.

Labels for training are the base spans of a bounded sample of ``TRAIN_DOCS`` documents (by a hash of the id) and generated
examples with a fixed seed, which show kinds of secrets and of harmless tokens that a sample may lack. Of a document,
windows of ``WINDOW`` tokens are learned, of any tokens: one about a base span, and of every third document one by a hash.
A field's span is added unless it meets a base span; its kind is ``crf``.

Null and empty texts have no spans. Bytes that are no UTF-8 are read as U+FFFD. Positions are code points, ends exclusive. Repeated rows are scanned each for itself.
Long texts are read whole. Extra columns are carried by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded, map_rows, table
from ._crf import CRF

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")

TRAIN_DOCS = 4000
WINDOW = 24
PIECE = 1 << 19
_NAMES = (b"key", b"token", b"secret", b"passw", b"pwd", b"bearer", b"auth", b"cred")
O, B, I = range(3)  # noqa: E741
SPACE, DIGIT, UPPER, LOWER, JOIN, SIGN = range(6)
_CLASS = np.array([SPACE if c in b" \t\n\v\f\r\x1c\x1d\x1e\x1f" else DIGIT if 48 <= c <= 57 else UPPER if 65 <= c <= 90 else LOWER if 97 <= c <= 122 else JOIN if c in b"+/_=-" else SIGN for c in range(129)], np.int8)
_SMALL = np.array([c + 32 if 65 <= c <= 90 else c for c in range(129)], np.uint8)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    small = text.lower() if text.isascii() else text.encode().lower().decode()
    if any(w in small for w in NAMED):
        out += [(m.start(2), 0, m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of fewer than 24 fails as a whole, so the length can stand in the pattern.
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Tokens:
    """Every token of some texts, end to end: ``start`` and ``end`` within its text, ``doc``, ``head`` (the first of a text)."""

    def __init__(self, texts: list[str]):
        size = np.array([len(t) + 1 for t in texts])
        code = np.minimum(np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4"), 128).astype(np.uint8)
        kind = _CLASS[code]
        word = (kind != SPACE) & (kind != SIGN)
        begin, close = kind == SIGN, kind == SIGN
        begin[0] |= word[0]
        begin[1:] |= word[1:] & ~word[:-1]
        close[:-1] |= word[:-1] & ~word[1:]  # the last place of all is a space
        self.at, self.stop = np.flatnonzero(begin), np.flatnonzero(close) + 1
        offset = np.cumsum(size) - size
        self.doc = np.searchsorted(offset, self.at, "right") - 1
        self.start, self.end = self.at - offset[self.doc], self.stop - offset[self.doc]
        self.head = np.diff(self.doc, prepend=-1) > 0
        self.code, self.kind, self.word, self.begin, self.size = code, kind, word, begin, size

    def __len__(self) -> int:
        return len(self.at)

    def _back(self, x: np.ndarray) -> np.ndarray:
        """The value of the token before, 0 at the head of a text."""
        out = np.zeros_like(x)
        out[1:] = x[:-1]
        out[self.head] = 0
        return out

    def _ahead(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        out[:-1] = x[1:]
        out[:-1][self.head[1:]] = 0
        return out

    def _share(self, marks: np.ndarray) -> np.ndarray:
        """How many of each token's characters are marked."""
        total = np.zeros(len(marks) + 1, np.int32)
        np.cumsum(marks, out=total[1:])
        return total[self.stop] - total[self.at]

    def _entropy(self, n: np.ndarray) -> np.ndarray:
        keys = (np.cumsum(self.begin, dtype=np.int64) - 1)[self.word] << 7
        keys |= self.code[self.word]
        if len(self) < 1 << 24:
            keys = keys.astype(np.int32)
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        count = np.diff(first, append=len(keys))
        return np.log2(n) - np.bincount(keys[first] >> 7, count * np.log2(count), len(self)) / n

    def file(self, digits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        long = np.bincount(self.doc, n * ((n >= 12) & (digits > 0)), len(self.size)) / self.size
        named = np.bincount(self.doc, self.names, len(self.size)) > 0
        return np.log1p(self.size - 1) / 12, long, named

    def features(self, file: list[float] | None = None) -> Iterator[np.ndarray]:
        """``FEATURES`` columns, each of a value a token; ``file`` stands for the features of the file."""
        n = (self.stop - self.at).astype(float)
        digits, uppers, lowers, joins = (self._share(self.kind == k) for k in (DIGIT, UPPER, LOWER, JOIN))
        signs = self.kind[self.at] == SIGN
        small = _SMALL[self.code]
        self.names, text = np.zeros(len(self), bool), small.tobytes()
        for name in _NAMES:
            found, where = [], text.find(name)
            while where >= 0:
                found.append(where)
                where = text.find(name, where + 1)
            self.names[np.searchsorted(self.at, found, "right") - 1] |= True
        before, after = self.code[self.stop - 1], self.code[self.at]
        before, ahead = self._back(before), self._ahead(after)
        is_in = lambda x, chars: np.isin(x, np.frombuffer(chars, np.uint8))
        touch = np.zeros(len(self), bool)
        touch[1:] = self.stop[:-1] == self.at[1:]
        touch[self.head] = False
        next_touch = self._ahead(touch)
        quote = is_in(before, b"\"'")
        assigned = is_in(before, b"=:") | (quote & is_in(self._back(before), b"=:"))
        wordless = (signs & (after < 128)) | (joins == n)
        named = np.zeros(len(self), bool)
        for _ in range(5):
            named = self._back(self.names | (wordless & named))
        changes = np.zeros(len(self.kind), bool)
        changes[1:] = self.kind[1:] != self.kind[:-1]
        changes[self.at] = False
        changes = self._share(changes) / n
        entropy = self._entropy(n) / 4
        digit, upper, lower, join = digits / n, uppers / n, lowers / n, joins / n
        word = ~signs
        key = word & (n >= 6)
        mixed = (digits > 0) & (uppers + lowers > 0)
        yield np.ones(len(self))
        yield np.minimum(n, 64) / 32
        for low, high in ((1, 2), (2, 6), (6, 8), (8, 12), (12, 16), (16, 24), (24, 129)):
            yield word & (n >= low) & (n < high)
        yield n > 128
        yield from (digit, upper, lower, join, changes, entropy, entropy * (n >= 16), changes * (n >= 16))
        yield digits == n
        yield mixed
        yield lowers == n
        yield word & (uppers + lowers == n) & (uppers <= 1)
        yield word & (self._share(((small >= 97) & (small <= 102) & (self.kind != UPPER)) | (self.kind == DIGIT)) == n)
        yield self._share(self.code == 45) >= 2
        yield (self._share(self.code == 47) > 0) & is_in(ahead, b".") & next_touch
        yield signs
        yield after >= 128
        yield touch
        yield next_touch
        yield assigned
        yield quote & touch
        yield is_in(ahead, b"\"'") & next_touch
        yield named
        yield named & assigned
        yield named & key
        yield named & assigned & key
        yield named & assigned & key & mixed
        yield named & key & (changes > 0.2)
        yield named & key & (changes > 0.2) & (n >= 16)
        yield is_in(before, b"@") & touch
        yield is_in(ahead, b"@") & next_touch
        yield is_in(ahead, b"@") & next_touch & is_in(before, b":") & touch
        yield is_in(ahead, b"@") & next_touch & is_in(before, b":") & touch & key
        yield is_in(ahead, b".") & next_touch
        yield self.names
        yield self.names & (self._share(self.code == 61) > 0) & key & mixed
        own = self.file(digits, n) if file is None else tuple(np.full(len(self.size), v) for v in file)
        yield from (v[self.doc] for v in own)


FEATURES = sum(1 for _ in Tokens(["a"]).features())


def matrix(tokens: Tokens, file: list[float] | None = None, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Features of all tokens, or of those at ``rows``."""
    return np.stack([np.asarray(c[rows], np.float32) for c in tokens.features(file)], 1)


def _labels(tokens: Tokens, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Labels of the tokens of one text."""
    y = np.full(len(tokens), O)
    for s, _, e in reversed(spans):  # where spans meet, the first holds
        a, b = np.searchsorted(tokens.end, s, "right"), np.searchsorted(tokens.start, e)
        y[a:b] = I
        y[a : min(a + 1, b)] = B
    return y


def generated(count: int = 900, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]], list[float]]]:
    """Texts with one token in known context, as (text, spans, features of the file): secrets of several makes, letter-only and
    short ones among them, and words, numbers, dates, names that are none."""
    r = random.Random(seed)
    small = "abcdefghijklmnopqrstuvwxyz"
    abc = small.upper() + small
    full = abc + "0123456789"
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    plain = lambda: pick(small, r.randint(2, 9)).capitalize() if r.random() < 0.2 else pick(small, r.randint(2, 9))
    some = lambda: r.choice(("the", "value", "with", "and", "note", "field", "see", plain(), plain(), plain()))
    out = []
    for k in range(count):
        word, good = some(), k % 2
        if good:
            make = k // 2 % 5
            name = r.choice(("auth", "credential", "bearer", "Bearer", "access_key", "client_key", "pwd"))
            head = r.choice((f'{word} {name} = "', f"{word} {name}: ", f"{word} {name} ", f'"{name}": "', f"Authorization: {name} "))
            if make < 2:
                token = r.choice((lambda: pick(full, r.randint(24, 44)), lambda: pick("0123456789abcdef", r.choice((32, 40, 64))), lambda: "ghp_" + pick(full, 36), lambda: "sk-" + pick(full, 40), lambda: pick(full + "+/", 43) + "="))() + "7"
            elif make == 2:
                token = pick(abc, r.randint(16, 40))
            else:
                token = r.choice((lambda: pick(small, r.randint(4, 7)) + pick("0123456789", r.randint(1, 4)), lambda: pick(full, r.randint(5, 10)) + "7a", lambda: pick(small, 3) + pick("0123456789", 2) + pick(small, 3)))()
                if make == 3:
                    head = r.choice((f"{word} {name}: ", f'{word} {name} = "', f"{name}: ", f'"{name}": "', f"{word} {name}=", f"Authorization: {name} ", "Authorization: Bearer "))
            tail = '" ' if head.endswith('"') else " "
            if make == 4:
                head, tail = f"{word} {r.choice(('postgres', 'mysql', 'https', 'amqp', 'redis'))}://{pick(small, r.randint(1, 6))}:", f"@{pick(small, r.randint(1, 8))}{r.choice(('', '.com', ':5432/db'))} "
            if head.endswith("="):
                head, token = head[: -len(name) - 1], f"{name}={token}"
        else:
            name = r.choice(("auth", "author", "authority", "key", "keys", "monkey", "token", "tokens", "secret", "password", "pwd", "bearer", "credit", "sacred"))
            token = r.choice((
                lambda: pick("0123456789", r.randint(1, 19)), lambda: f"2024-0{r.randint(1, 9)}-1{r.randint(0, 9)}T10-20", lambda: f"chapter-{r.randint(10, 99)}-of-the-{r.randint(1, 9)}",
                lambda: f"file_name_{r.randint(1, 99)}_draft", lambda: f"{r.randint(100, 999)}-555-01{r.randint(10, 99)}-{r.randint(10, 99)}", plain, lambda: pick(small, r.randint(10, 30)), lambda: f"{plain()}{r.randint(1, 99)}",
                lambda: f"https://{plain()}.com:8080/{plain()}/{r.randint(1, 999)}", lambda: f"{plain()}@{plain()}.com", lambda: f"{plain()}.{plain()}{r.randint(1, 99)}@{plain()}.org", lambda: f"{r.randint(0, 23)}:{r.randint(10, 59)}", lambda: pick(small.upper(), r.randint(2, 8)),
                lambda: f"{name} {plain()} {plain()}", lambda: f"{name}, {plain()}", lambda: f"{name} of {plain()}", lambda: f"{name}: {r.randint(1, 999)}", lambda: f"{plain()}: {plain()}", lambda: f"{plain()} = {r.randint(1, 99)}",
            ))()
            head, tail = r.choice((f"{word} ", f"{word} (", f"{word}, no. ")), " "
        lead, rest = " ".join(some() for _ in range(r.randint(0, 4))), " ".join(some() for _ in range(r.randint(0, 4)))
        head = f"{lead} {head}" if lead else head
        text = f"{head}{token}{tail}{rest}."
        # Of any file, so that a short one is no sign of a secret.
        out.append((text, [(len(head), 0, len(head) + len(token))] if good else [], [r.uniform(0.3, 0.9), r.choice((0.0, r.random() / 5)), float(r.random() < 0.5)]))
    return out


def examples(text: str, spans: list[tuple[int, int, int]], file: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all tokens of a text."""
    tokens = Tokens([text])
    return matrix(tokens, file), _labels(tokens, spans)


def windows(text: str, seed: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """What training sees of a document, as (place, features, labels); which windows these are depends on text and seed alone."""
    tokens = Tokens([text])
    y = _labels(tokens, base_spans(text))
    marked, places = np.flatnonzero(y == B), []
    if len(marked):
        places.append(max(0, int(marked[zlib.crc32(b"%d" % seed) % len(marked)]) - WINDOW // 2))
    if len(y) and zlib.crc32(b"plain %d" % seed) % 3 == 0:
        places.append(zlib.crc32(b"place %d" % seed) % max(1, len(y) - WINDOW + 1))
    if not places:
        return []
    x = matrix(tokens, rows=np.concatenate([np.arange(at, min(at + WINDOW, len(y))) for at in places]))  # a long text has many tokens
    cut = np.cumsum([min(WINDOW, len(y) - at) for at in places])[:-1]
    return [(at, own, y[at : at + WINDOW]) for at, own in zip(places, np.split(x, cut), strict=True)]


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> CRF:
    """Fit on windows of at most about ``most`` documents; their features, not their texts, reach the driver."""
    every = max(1, docs.count() // most)
    seed = F.xxhash64("doc_id")
    sample = docs.filter(F.pmod(seed, F.lit(every)) == 0).select(F.col("text").cast("string"), seed.alias("seed"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(zlib.crc32(b"%d %d" % (seed, at)), at, x.tobytes(), y.astype(np.int8).tobytes()) for text, seed in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True) for at, x, y in windows(text or "", seed)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["turn", "place", "x", "y"])

    # Ordered by hash and place, so that the bounded sample does not depend on which task is first.
    rows = bounded(sample).mapInArrow(work, "turn long, place long, x binary, y binary").orderBy("turn", "place", "x", "y").limit(most // 2).collect()
    sequences = [(np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES).astype(float), np.frombuffer(r["y"], np.int8).astype(int)) for r in rows]
    sequences += [examples(*g) for g in generated()]
    return CRF(FEATURES, 3).fit(sequences, rounds=120, penalty=1e-4)


def field_spans(texts: list[str], model: CRF) -> list[list[tuple[int, int]]]:
    """For each text the field's spans."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    tokens = Tokens(texts)
    if not len(tokens):
        return out
    e, scaled = np.zeros((3, len(tokens))), np.empty(len(tokens))
    for weight, column in zip(model.weight, tokens.features(), strict=True):  # a column at a time bounds the memory of long texts
        column = np.asarray(column, np.float32).astype(float)
        for own, w in zip(e, weight, strict=True):
            own += np.multiply(column, w, out=scaled)
    best = model.decode(e.T, tokens.head)
    begin = (best == B) | ((best == I) & ((np.append(O, best[:-1]) == O) | tokens.head))
    stops = np.append(np.flatnonzero((best != I) | begin), len(best))
    first = np.flatnonzero(begin)
    last = stops[np.searchsorted(stops, first, "right")] - 1
    for doc, s, t in zip(tokens.doc[first].tolist(), tokens.start[first].tolist(), tokens.end[last].tolist(), strict=True):
        out[doc].append((s, t))
    return out


def _apart(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans that meet no base span, which are sorted by start."""
    starts, reach = [s for s, _, _ in base], [0, *accumulate((e for _, _, e in base), max)]
    return [(s, e) for s, e in found if reach[bisect_left(starts, e)] <= s]


def strings(column: pa.Array) -> list[str | None]:
    """A column's texts, whatever their bytes."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [b if b is None else b.decode(errors="replace") for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def find_all(texts: list[str | None], model: CRF) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int]]]]:
    """For each text the base spans, and the field's spans that meet none of them."""
    own, at = [t or "" for t in texts], 0
    while at < len(own):  # pieces of about one size bound the memory; a long text is one
        end, size = at, 0
        while end < len(own) and (end == at or size + len(own[end]) <= PIECE):
            size += len(own[end])
            end += 1
        for text, found in zip(own[at:end], field_spans(own[at:end], model), strict=True):
            base = base_spans(text)
            yield base, _apart(found, base)
        at = end


def find(text: str, model: CRF) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    return next(find_all([text], model))


def scan(docs: DataFrame, model: CRF | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added."""
    own_model = model or train(docs)  # some hundred numbers, sent with the function

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, (base, added) in zip(batch.column(0).to_pylist(), find_all(strings(batch.column(1)), own_model), strict=True):
                named = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
                every = sorted([(s, k, e) for s, k, e in base] + [(s, len(KINDS), e) for s, e in added])
                row = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((doc_id, *row, hashlib.sha256(",".join(named).encode()).hexdigest(), ",".join(f"{(*KINDS, 'crf')[k]}:{s}:{e}" for s, k, e in every), len(added)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, model: CRF | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span (overlapping ones joined) replaced by ``mark``; ``n_chars`` follows where it is a column."""
    own_model = model or train(docs)

    def clean(text: str | None, base: list[tuple[int, int, int]], added: list[tuple[int, int]]) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s, e in sorted([(s, e) for s, _, e in base] + added):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(place)
            texts = strings(own)
            yield batch.set_column(place, batch.schema.field(place), pa.array([clean(t, *found) for t, found in zip(texts, find_all(texts, own_model), strict=True)], own.type))

    cleaned = map_rows(docs, work)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op2_secrets": op2_secrets}
ORACLE_SQL: dict[str, str] = {}
