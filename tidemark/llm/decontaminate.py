"""Benchmark decontamination with suffix arrays over the training texts.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. Each task cuts its texts into shards of about
``SHARD_WORDS`` words. In a shard, words that the benchmark knows have numbers, others are 0; a suffix that begins with 0
cannot match anything and is left out. The suffix array holds the places of the rest, sorted by their first words (as many
as fit 62 bits); a range of equal beginnings is sorted further, by the next words, only when a search enters it. Every test
suffix is looked up by binary search, which gives all its occurrences at once; neighbouring occurrences on one diagonal
join into the longest verbatim match and its place.

Search unit: a window of ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window.
Words of a document inside an occurrence of a window are hit. Matches never cross documents: a 0 stands between them.

The benchmark is cut into blocks of at most ``BLOCK_BYTES`` of text, each collected (a bounded size) and searched in one
pass; the usual benchmark is one block. With more, the hits of all blocks meet by document in a sum of spans.

Nulls have no words: such documents have no hits and such items no windows. Null item ids are named as empty strings.
Items that repeat a text all count. Repeated rows are judged each for itself. Extra columns are ignored (``remove`` carries
them). Long texts are read whole; a text longer than a shard is a shard of its own.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import binary, bounded, fresh_prefix, map_rows, quoted, runs_of, table

WINDOW = 13
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 16 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class _Numbers(dict):
    def __missing__(self, _):
        return 0


class Queries:
    """The windows of a block of items, as numbered words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.numbers = _Numbers()
        found: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        self.names = [name for name, _ in items]
        self.sizes = []
        for k, (_, text) in enumerate(items):
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            self.sizes.append(min(window, len(own)))
            for at in range(max(1, len(own) - window + 1)) if own else ():
                found[tuple(own[at : at + window])].append((k, at))
        self.windows = list(found)
        self.items = list(found.values())
        self.bits = max(1, (len(self.numbers) + 1).bit_length())
        self.per_key = 62 // self.bits

    def pack(self, own: np.ndarray, at: np.ndarray, skip: int) -> np.ndarray:
        """The words skip .. skip + per_key of the suffixes at ``at`` as one number each; beyond the end are zeros."""
        key = np.zeros(len(at), np.int64)
        for j in range(skip, skip + self.per_key):
            key = (key << self.bits) | own[at + j]
        return key

    def bounds(self, window: tuple[int, ...], skip: int) -> tuple[int, int]:
        """The least and greatest key of suffixes that go on with this window's words from ``skip``."""
        part = window[skip : skip + self.per_key]
        low = 0
        for w in part:
            low = (low << self.bits) | w
        free = (self.per_key - len(part)) * self.bits
        return low << free, ((low + 1) << free) - 1


class SuffixArray:
    """Sorted suffixes of one shard, refined where searches go."""

    def __init__(self, own: np.ndarray, queries: Queries):
        self.q = queries
        self.own = np.concatenate((own, np.zeros(queries.per_key * (WINDOW // queries.per_key + 2), np.int64)))
        at = np.flatnonzero(own)
        key = queries.pack(self.own, at, 0)
        order = np.argsort(key)
        self.at, self.key = at[order], key[order]
        self.deeper: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def find(self) -> Iterator[tuple[int, np.ndarray]]:
        """(window, places of its occurrences) for each window that occurs."""
        q = self.q
        both = np.array([q.bounds(w, 0) for w in q.windows], np.int64).reshape(-1, 2)
        low, high = np.searchsorted(self.key, both[:, 0], "left"), np.searchsorted(self.key, both[:, 1], "right")
        for k in np.flatnonzero(high > low):
            at, window, skip = self.at[low[k] : high[k]], q.windows[k], q.per_key
            name = (int(low[k]), int(high[k]))
            while skip < len(window) and len(at):
                place = (*name, skip)
                if place not in self.deeper:
                    key = q.pack(self.own, at, skip)
                    order = np.argsort(key)
                    self.deeper[place] = at[order], key[order]
                at, key = self.deeper[place]
                lo, hi = q.bounds(window, skip)
                a, b = np.searchsorted(key, lo, "left"), np.searchsorted(key, hi, "right")
                at, name, skip = at[a:b], (*place, int(a), int(b)), skip + q.per_key
            if len(at):
                yield int(k), at


class Shard:
    """The numbered words of some texts, a 0 behind each, and their suffix array."""

    def __init__(self, texts: list[bytes], queries: Queries):
        split = [words(t) for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + 1)))
        self.own = np.zeros(int(self.starts[-1]), np.int64)
        get = queries.numbers.__getitem__
        for s, w in zip(self.starts, split, strict=False):
            self.own[s : s + len(w)] = np.fromiter(map(get, w), np.int64, len(w))
        self.found = SuffixArray(self.own, queries).find()

    def docs(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def hit_words(texts: list[bytes], queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """For each text its number of words and how many of them are hit."""
    shard = Shard(texts, queries)
    edge = np.zeros(len(shard.own) + 1, np.int64)
    for k, at in shard.found:
        np.add.at(edge, at, 1)
        np.add.at(edge, at + len(queries.windows[k]), -1)
    hit = np.flatnonzero(np.cumsum(edge[:-1]))
    return shard.sizes, np.bincount(shard.docs(hit), minlength=len(texts))


def search(texts: list[bytes], queries: Queries) -> list[tuple[int, np.ndarray, list[int], list[tuple[int, int, int, int]]]]:
    """For each text: its number of words, which of them are hit, the items found, and the longest match of each of them
    as (item, place in the text, place in the item, words)."""
    shard = Shard(texts, queries)
    sizes, starts, own = shard.sizes, shard.starts, shard.own
    edge = np.zeros(len(own) + 1, np.int64)
    diagonals: list[dict[tuple[int, int], list[int]]] = [defaultdict(list) for _ in texts]
    for k, at in shard.found:
        size = len(queries.windows[k])
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        for place, doc in zip(at.tolist(), shard.docs(at).tolist(), strict=True):
            for item, within in queries.items[k]:
                diagonals[doc][item, place - int(starts[doc]) - within].append(within)
    hit = np.cumsum(edge[:-1]) > 0
    out = []
    for i, n in enumerate(sizes):
        longest: dict[int, tuple[int, int, int, int]] = {}
        for (item, shift), places in diagonals[i].items():
            places.sort()
            run = first = places[0]
            for p in [*places[1:], None]:
                if p is not None and p <= run + 1:
                    run = p
                    continue
                size = run - first + queries.sizes[item]
                if item not in longest or size > longest[item][3]:
                    longest[item] = (item, first + shift, first, size)
                if p is not None:
                    run = first = p
        out.append((int(n), hit[starts[i] : starts[i] + n], sorted(longest), list(longest.values())))
    return out


def _blocks(benchmark: DataFrame) -> list[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size: ids as strings and texts."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    out, size = [[]], 0
    for r in items.toLocalIterator():
        data = r["text"].encode()
        if out[-1] and size + len(data) > BLOCK_BYTES:
            out.append([])
            size = 0
        out[-1].append((r["id"], data))
        size += len(data)
    return out


RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>, longest long"


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]


def shards(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in runs of about ``SHARD_WORDS`` words."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) // 4 <= SHARD_WORDS):
            size += len(texts[end]) // 4
            end += 1
        yield texts[at:end]
        at = end


def contamination(docs: DataFrame, benchmark: DataFrame, spans: bool = False, blocks: list[list[tuple[str, bytes]]] | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items, longest (words of the longest match) and, on demand, the hit spans; one row a document.

    ``digest`` adds th, the MD5 of the text, where there are several blocks.
    """
    blocks = blocks or _blocks(benchmark)
    spark = docs.sparkSession
    several = len(blocks) > 1
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("longest", pa.int64())])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if several:
        # Each pass must name the same row alike; equal rows have equal answers, so id and text hash will do, with a count.
        # Null and empty texts have one hash, so they are one here too.
        own = own.withColumn("text", F.coalesce("text", F.lit(""))).groupBy("doc_id", "text").agg(F.count("*").alias("n"))

    def one(items: list[tuple[str, bytes]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)  # BLOCK_BYTES at most

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = Queries(sent.value)
            for batch in batches:
                texts, ids, at = binary(batch.column(1)), batch.column(0).to_pylist(), 0
                copies = batch.column(2).to_pylist() if several else None
                for part in shards(texts):
                    rows = []
                    for k, (n, hit, found, best) in enumerate(search(part, queries), at):
                        row = {"doc_id": ids[k], "n_words": n, "n_hit": int(hit.sum()), "items": [queries.names[i] for i in found], "longest": max((b[3] for b in best), default=0)}
                        row["spans"] = [{"start": a, "end": b} for a, b in _runs(hit)] if spans or several else None
                        if several:
                            row |= {"n": copies[k], "th": hashlib.md5(texts[k]).hexdigest()}
                        rows.append(row)
                    fields = kinds.append(pa.field("n", pa.int64())).append(pa.field("th", pa.string())) if several else kinds
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)
                    at += len(part)

        return bounded(own).mapInArrow(work, "doc_id long, " + RESULT + ", n long, th string" * several)

    if not several:
        return one(blocks[0])
    every = one(blocks[0])
    for b in blocks[1:]:
        every = every.unionByName(one(b))
    # Spans of a text meet in one row, whose size is bounded by the text's.
    merged = every.groupBy("doc_id", "th").agg(F.first("n").alias("n"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.max("longest").alias("longest"))
    covered = F.expr("aggregate(spans, struct(0L AS hit, 0L AS far), (a, s) -> struct(a.hit + greatest(0L, s.end - greatest(s.start, a.far)) AS hit, greatest(a.far, s.end) AS far), a -> a.hit)")
    return merged.withColumn("n_hit", covered).withColumn("_", F.explode(F.expr("sequence(1, n)"))).select("doc_id", "n_words", "n_hit", "items", "spans", "longest", *["th"] * digest)


#: Of op5's column of that name; ``remove`` drops every affected document unless it is told otherwise.
CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def remove(docs: DataFrame, benchmark: DataFrame, share: float = 0.0) -> DataFrame:
    """``docs`` without affected documents: those with a hit and with at least ``share`` of their words hit.

    A benchmark of one block is searched where the rows are, and batches lose their affected rows without a shuffle. With
    more blocks the hits have to meet first; then the digests of affected texts are joined (equal texts have equal
    answers, so a text's digest is enough to name it). Columns may have any names.
    """
    blocks = _blocks(benchmark)
    columns, p = quoted(docs.columns), fresh_prefix(docs.columns, "_d_")
    if len(blocks) > 1:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        named = docs.select(*columns, F.md5(text).alias(f"{p}h"))
        # A number of 64 bits will do within the search: texts are told apart by their digests.
        found = contamination(docs.select(F.xxhash64(text).alias("doc_id"), "text"), benchmark, blocks=blocks, digest=True)
        bad = found.filter(F.col("n_hit") > 0).filter(F.col("n_hit") >= F.lit(float(share)) * F.col("n_words")).select(F.col("th").alias(f"{p}h")).distinct()
        return named.join(bad, f"{p}h", "left_anti").select(*columns)
    sent = docs.sparkSession.sparkContext.broadcast(blocks[0])  # BLOCK_BYTES at most
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(sent.value)
        for batch in batches:
            for a, b in runs_of(batch.column(place)):
                own = batch.slice(a, b - a)
                n, hit = hit_words(binary(own.column(place)), queries)
                yield own.filter(pa.array(~((hit > 0) & (hit >= share * n)), pa.bool_()))

    return map_rows(docs, work)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"))


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLE_SQL = {
    "op5_decontamination": r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT item, words, unnest(range(1, greatest(2, len(words) - 11))) AS i FROM b WHERE len(words) > 0),
win AS (SELECT DISTINCT item, words[i : i + 12] AS g FROM bw),
sizes AS (SELECT DISTINCT len(g) AS k FROM win),
dw AS (SELECT rid, k, unnest(range(1, len(words) - k + 2)) AS i, words FROM w, sizes WHERE len(words) >= k),
dg AS (SELECT rid, k, i, words[i : i + k - 1] AS g FROM dw),
hits AS (SELECT rid, k, i, item FROM dg JOIN win USING (g)),
cov AS (SELECT rid, count(DISTINCT i + o) AS n_hit FROM (SELECT rid, i, unnest(range(0, k)) AS o FROM hits) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words)) AS contaminated
FROM w LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)"""
}
