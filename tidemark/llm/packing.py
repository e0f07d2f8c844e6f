"""Packing by power-of-two decomposition.

A document of n ids (its text's ids and one end id) is cut into whole sequences of ``max_len`` ids and, for the rest, one
piece for each binary digit of its length, longest first. Every piece is a sequence of its own: its length is a power of
two, so it needs no padding, holds one document only, and goes to the bucket of its length, from which a trainer draws
batches of equal shape.

``sequence_id`` is ``monotonically_increasing_id``: it depends on the input partition and the row's place in it, so a task
that runs again after an executor is lost gives the same ids. There is no shuffle and no state across tasks.

Null and empty texts have the end id alone: one piece of length 1. Repeated rows are packed each for itself; null ids are
carried. Texts of any length are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded, runs_of, table

MAX_LEN = 2048
END_ID = 1
#: Pieces that a task remembers.
MEMORY = 1 << 18
#: Characters that are tokenized at once.
CHUNK = 1 << 20
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
#: A piece of a lower-case text of simple characters.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}\t\n\r \xA0]+")
#: Characters of Latin, with dashes, quotes, the euro and the trade mark.
_SIMPLE = re.compile(r"[\t\n\r\x20-\x7E\xA0-\xFF\u2010-\u2027\u2030-\u205E\u20AC\u2122]*")
_SPACE = re.compile(r"[\t\n\r ]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceMerger:
    """Byte-pair merges of many pieces at once.

    A round finds, in each piece, the leftmost pair of the least rank and joins it; pieces without a pair that has a rank are
    done. Pieces lie end to end in arrays, and pairs are looked up in a hash table of arrays.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict):
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.outer = np.array([vocabulary[letters[b] + end] for b in range(256)], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pair = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in merges], np.int64)
        joined = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        self.bits = max(4, (4 * len(merges)).bit_length())
        self.pair, self.rank, self.joined = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE), np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(merges)), self._slot(pair)
        while len(left):  # those that find a free slot, one a slot, take it; the rest go on to the next
            free = np.flatnonzero(self.pair[at[left]] < 0)
            _, first = np.unique(at[left[free]], return_index=True)
            won = left[free[first]]
            self.pair[at[won]], self.rank[at[won]], self.joined[at[won]] = pair[won], won, joined[won]
            left = np.delete(left, free[first])
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, pair: np.ndarray) -> np.ndarray:
        """The slot of each pair, or a free one."""
        at = self._slot(pair)
        have = self.pair[at]
        odd = np.flatnonzero((have != pair) & (have >= 0))
        while len(odd):
            at[odd] = (at[odd] + 1) & ((1 << self.bits) - 1)
            have = self.pair[at[odd]]
            odd = odd[(have != pair[odd]) & (have >= 0)]
        return at

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces (none is empty), end to end, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        own, last = self.inner[data], np.cumsum(size) - 1
        own[last] = self.outer[data[last]]
        of = np.repeat(np.arange(len(size)), size)
        final = np.zeros(len(own), bool)
        final[last] = True
        done: list[tuple[np.ndarray, np.ndarray]] = []
        slot = np.zeros(len(own), np.int64)
        slot[:-1] = self._find(own[:-1] << 20 | own[1:])
        rank = np.where(final, self.NONE, self.rank[slot])
        while len(own):
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(own)))
            ended = least == self.NONE
            if ended.any():
                gone = np.repeat(ended, length)
                done.append((of[gone], own[gone]))
                own, of, final, slot, rank = (x[~gone] for x in (own, of, final, slot, rank))
                least, length = least[~ended], length[~ended]
                if not len(own):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, length))
            at = hit[np.concatenate(([True], of[hit[1:]] != of[hit[:-1]]))]
            own[at], final[at] = self.joined[slot[at]], final[at + 1]
            stay = np.ones(len(own), bool)
            stay[at + 1] = False
            own, of, final, slot, rank = (x[stay] for x in (own, of, final, slot, rank))
            at -= np.arange(len(at))
            before = at[at > 0] - 1
            for place in (before[~final[before]], at[~final[at]]):  # pairs with the new symbol
                slot[place] = self._find(own[place] << 20 | own[place + 1])
                rank[place] = self.rank[slot[place]]
            rank[at[final[at]]] = self.NONE
        every = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        ids = np.concatenate([i for _, i in done])[order] if done else np.zeros(0, np.int64)
        return ids.astype(np.uint32), np.bincount(every, minlength=len(pieces))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next free one."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordTokenizer:
    """Ids of texts, equal to those of the tokenizer's ``encode`` without special tokens.

    The tokenizer composes and lower-cases a text, cuts it into pieces (letters, single digits, signs; white space is
    dropped) and merges the bytes of each piece. For texts of the characters in ``_SIMPLE``, which composition leaves alone
    and which lower-casing takes one by one, all of this is done here: pieces by a pattern, their numbers by one dictionary,
    new pieces merged together. Texts with other characters, or with a special token written out, go to the tokenizer.

    The dictionary holds ``MEMORY`` pieces about at most; it is emptied between blocks of texts.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:  # a file of the installed package, on every machine
            found = json.load(f)
        self.special = [t["content"] for t in found["added_tokens"]]
        self.merger = PieceMerger(found["model"])
        self._clear()

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _clear(self) -> None:
        self.new: list[str] = []
        self.known = _Numbers(self.new)
        self.ids, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        for at in range(0, len(self.new), 1 << 16):
            ids, count = self.merger.merge([p.encode() for p in self.new[at : at + (1 << 16)]])
            self.ids = np.concatenate((self.ids, ids))
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(count)))
        self.new.clear()

    def _simple(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of simple texts end to end, and how many each has."""
        numbers, counts, get = [], [], self.known.__getitem__
        for text in parts:
            pieces = _PIECE.findall(text.lower())
            numbers.append(np.fromiter(map(get, pieces), np.int64, len(pieces)))
            counts.append(len(pieces))
        self._learn()
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        start = self.start[number]
        size = self.start[number + 1] - start
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        if len(self.known) > MEMORY:
            self._clear()
        return ids, np.diff(ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (32-bit). Texts of more than ``CHUNK`` characters are cut at white space, which no piece spans."""
        parts, odd = [], {}
        for k, text in enumerate(texts):
            if not _SIMPLE.fullmatch(text) or any(t in text for t in self.special):
                odd[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            at = 0
            while len(text) - at > CHUNK and (space := _SPACE.search(text, at + CHUNK)):
                parts.append((k, text[at : space.start()]))
                at = space.start()
            parts.append((k, text[at:] if at else text))
        found: list[list[np.ndarray]] = [[odd[k]] if k in odd else [] for k in range(len(texts))]
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end][1]) <= CHUNK):
                size += len(parts[end][1])
                end += 1
            ids, counts = self._simple([t for _, t in parts[at:end]])
            for (k, _), own in zip(parts[at:end], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                found[k].append(own)
            at = end
        return [f[0] if len(f) == 1 else np.concatenate(f) if f else np.zeros(0, np.uint32) for f in found]


class _Numbers(dict):
    """Numbers pieces in the order in which they are first asked for; new ones are noted."""

    def __init__(self, new: list[str]):
        self.new = new

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = number = len(self)
        return number


def cuts(n: int, max_len: int = MAX_LEN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; ``max_len`` is a power of two."""
    out = [(s, max_len) for s in range(0, n - n % max_len, max_len)]
    at, rest = n - n % max_len, n % max_len
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def pieces(docs: DataFrame, tokenizer: str | None = None, max_len: int = MAX_LEN, with_ids: bool = False, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket (log2 of the length) and, on demand, the ids."""
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = tokenizer or default_tokenizer()
    fields = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("bucket", "int")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(n, kinds[k]) for n, k in fields] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = WordTokenizer(path), np.array([end_id], np.uint32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in runs_of(texts):
                rows: list[tuple] = []
                data: list[np.ndarray] = []
                for doc_id, own in zip(ids[a:b], tok.encode([t or "" for t in texts[a:b].to_pylist()]), strict=True):
                    own = np.concatenate((own, end))
                    raw = memoryview(own).cast("B")
                    rows += [(doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(own), length.bit_length() - 1) for start, length in cuts(len(own), max_len)]
                    if with_ids:
                        data.append(own)
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)]
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum([r[2] for r in rows]))).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(data).view(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    spec = ", ".join(f"{n} {k}" for n, k in fields) + (", ids array<int>" if with_ids else "")
    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, spec)


def pack(docs: DataFrame, tokenizer: str | None = None, max_len: int = MAX_LEN, with_ids: bool = False) -> DataFrame:
    """Pieces with the sequence that each one fills. Write it with ``partitionBy('bucket')`` to get one folder per length."""
    return pieces(docs, tokenizer, max_len, with_ids).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
    return pack(table(spark, sf_dir, "documents")).select(*names)


QUERIES = {"op10_packing": op10_packing}
ORACLE_SQL: dict[str, str] = {}
