"""Windows that also start in a document with a smaller id: the plan that the two substring operators share.

Every window gets a *key* that its content alone decides, so equal windows have equal keys wherever they stand, and
neighbouring windows mostly share one. The plan, in one lineage without driver-side data:

1. Documents are dealt into buckets of about ``BUCKET_BYTES`` by a hash of id and text (one shuffle of the texts, whose
   exchange all three passes reuse). Texts that repeat an earlier one whole are told by a digest; they need no more. Of the
   others, a bucket gives each of its keys once.
2. By part of the key space: keys that one document alone has are dropped; the rest go back to their buckets. A key of a
   third of all documents is one entry a bucket, so no key is larger than the number of buckets.
3. Each bucket sends what stands under shared keys, once for each distinct content, to be verified by content.
4. What is found (least id over all buckets) goes back to the buckets, which mark and cut their own documents.

Ids: null counts as greater than all others. Rows with equal ids never remove each other's words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary, input_bytes, staged

BUCKET_BYTES = 8 << 20
PARTITION_BYTES = 32 << 20
#: Texts are handled in chunks of about this many bytes; longer texts in overlapping segments of it.
CHUNK_BYTES = 1 << 20
LAST_ID = (1 << 63) - 1
#: A key that more buckets have is hot: with a fragment or two of some hundred bytes from each, its shard would pass 10 MB. Its
#: windows get finer keys.
HOT_BUCKETS = 50_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
BYTE_NAMES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i up to n."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size, out = max(n + 1, 2 * CHUNK_BYTES), []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[base] = tuple(out)
    return _POWERS[base]


class RangeHash:
    """64-bit hashes of ranges of a sequence of 64-bit names; equal content gives equal hashes at any place.

    They are polynomials, so long ranges of a regular pattern can agree by construction; ranges under 1024 names do not.
    """

    def __init__(self, names: np.ndarray, base: int = _BASE):
        up, self.down = powers(base, len(names))
        self.sums = np.zeros(len(names) + 1, np.uint64)
        np.cumsum(names * up[: len(names)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def chunks(texts: list[bytes], wanted: np.ndarray | None = None) -> Iterator[list[int]]:
    """Places of the documents of each chunk."""
    own, size = [], 0
    for i, t in enumerate(texts):
        if wanted is not None and not wanted[i]:
            continue
        if own and size + len(t) > CHUNK_BYTES:
            yield own
            own, size = [], 0
        own.append(i)
        size += len(t)
    if own:
        yield own


def least_and_greatest(name: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names with the least of ``low`` and the greatest of ``high``."""
    if not len(name):
        return name, low, high
    order = np.argsort(name)
    name, low, high = name[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    return name[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``, as places, else -1."""
    if not len(known):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(LAST_ID).to_numpy().astype(np.int64) if len(column) else np.zeros(0, np.int64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Deal:
    """The documents dealt into buckets, and for each bucket the marks of its texts that an earlier id has word for word.

    ``notes`` has rows (bucket, mark, data): a copy's mark, or shared keys packed into ``data``. A mark is a hash of text and
    id, so rows that share an id but not the text are told apart. Copies are whole repeats: they send nothing and lose every
    window, so a large group of copies costs one row of marks each.
    """

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        size = input_bytes(spark, docs, "text")
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(least, -(-size // BUCKET_BYTES))
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        own = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")).withColumn("mark", F.xxhash64("text", "doc_id"))
        self.partitions = max(least, -(-size // PARTITION_BYTES))
        self.rows = own.repartition(self.partitions, "bucket")
        # New names for columns, so that a bucket's own rows can meet its notes.
        named = own.select(F.expr("bucket + 0").cast("int").alias("bucket"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.expr("mark + 0").alias("mark"), F.md5("text").alias("name"))
        first = staged(named.groupBy("name").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).filter("least < most").select("name", "least", "n"), "copies")
        # Texts that make up more than a partition's share of the copies, fewer than there are partitions, are broadcast; rows
        # with such a text are then dealt out by their marks, so that no group of copies meets in one task.
        share = (first.agg(F.sum("n")).first()[0] or 0) // self.partitions + 1
        hot = F.broadcast(first.filter(F.col("n") > share).select("name", F.col("least").alias("hot")))
        dealt = named.join(hot, "name", "left").withColumn("name", F.when(F.col("hot").isNull(), F.col("name")).otherwise(F.concat(F.lit("hot "), F.col("mark").cast("string"))))
        found = dealt.join(first.filter(F.col("n") <= share).select("name", "least"), "name", "left").filter(F.col("id") > F.coalesce("hot", "least"))
        self.copies = found.select("bucket", "mark", F.lit(None).cast("binary").alias("data"))
        # A key is cut to as many bits as keep chance meetings rare; they would cost work, not correctness.
        self.shift = 64 - min(64, max(40, size.bit_length() + 12))
        self.parts = max(least, -(-size // (16 << 20)))

    def shared_keys(self, keys_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """Notes: the copies, and the keys of each bucket that other documents have too; in ``hot``, those of them that more than
        ``HOT_BUCKETS`` buckets have.

        ``keys_of`` takes the texts of a chunk and gives the keys of their windows and the text that each belongs to.
        A bucket sends each key once, packed by part of the key space, with a bit that says if several of its own ids have it.
        """
        shift, parts = self.shift, self.parts
        width = max(1, ((64 - shift) - (parts.bit_length() - 1) + 7) // 8)

        def send(group: pa.Table, notes: pa.Table) -> pa.Table:
            found = []
            for own, ids, texts in unrepeated(group, notes):
                key, doc = keys_of(texts)
                if len(key):  # runs of one key in one text are one row
                    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
                    found.append(least_and_greatest(key[first] >> _U(shift), ids[doc[first]], ids[doc[first]]))
            out: dict[str, list] = {"part": [], "keys": [], "several": []}
            if found:
                key, low, high = least_and_greatest(*(np.concatenate(x) for x in zip(*found, strict=True)))
                part = (key % _U(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                key, part, several = (key // _U(parts))[order], part[order], (low < high)[order]
                first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                packed = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
                    out["part"].append(int(part[a]))
                    out["keys"].append(packed[a:b].tobytes())
                    out["several"].append(np.packbits(several[a:b]).tobytes())
            bucket = bucket_of(group, notes)
            return pa.table({"bucket": pa.array([bucket] * len(out["part"]), pa.int32()), "part": pa.array(out["part"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "several": pa.array(out["several"], pa.binary())})

        def meet(group: pa.Table) -> pa.Table:
            keys = [unpack(k, width) for k in group["keys"].to_pylist()]
            several = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[: len(k)] for m, k in zip(group["several"].to_pylist(), keys, strict=True)])
            every = np.concatenate(keys)
            order = np.argsort(every)
            key = every[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(np.append(first, len(key)))
            good = np.zeros(len(key), bool)
            good[order] = np.repeat((count > 1) | (np.maximum.reduceat(several[order], first) > 0), count)
            full = every * _U(parts) + _U(group["part"][0].as_py())
            ends = np.cumsum([len(k) for k in keys])
            often = np.zeros(len(key), bool)
            often[order] = np.repeat(count > HOT_BUCKETS, count)
            data = [full[e - len(k) : e][good[e - len(k) : e]].tobytes() for k, e in zip(keys, ends.tolist(), strict=True)]
            hot = [full[e - len(k) : e][often[e - len(k) : e]].tobytes() for k, e in zip(keys, ends.tolist(), strict=True)]
            return pa.table({"bucket": group["bucket"].combine_chunks(), "mark": pa.nulls(len(data), pa.int64()), "data": pa.array(data, pa.binary()), "hot": pa.array(hot, pa.binary())})

        sent = self.rows.groupBy("bucket").cogroup(self.copies.groupBy("bucket")).applyInArrow(send, "bucket int, part int, keys binary, several binary")
        return sent.groupBy("part").applyInArrow(meet, "bucket int, mark long, data binary, hot binary").filter("octet_length(data) > 0").unionByName(self.copies.withColumn("hot", F.lit(None).cast("binary")))


def unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def bucket_of(*tables: pa.Table) -> int:
    return next(t["bucket"][0].as_py() for t in tables if t.num_rows)


def known_keys(notes: pa.Table, column: str = "data") -> np.ndarray:
    """The shared keys of a bucket, or the hot ones of them, sorted."""
    data = [d for d in notes[column].to_pylist() if d]
    return np.sort(np.frombuffer(b"".join(data), np.uint64))


def copied(group: pa.Table, notes: pa.Table) -> np.ndarray:
    """Which rows of the bucket are copies of an earlier text."""
    marks = notes["mark"].drop_null().to_numpy().astype(np.int64)
    return np.isin(group["mark"].to_numpy(), marks) if len(marks) else np.zeros(group.num_rows, bool)


def unrepeated(group: pa.Table, notes: pa.Table) -> Iterator[tuple[list[int], np.ndarray, list[bytes]]]:
    """Rows, ids and texts of the bucket's documents that are not copies, by chunk."""
    ids, texts, skip = _ids(group["doc_id"]), binary(group["text"]), copied(group, notes)
    for own in chunks(texts, ~skip):
        yield own, ids[np.array(own)], [texts[i] for i in own]
