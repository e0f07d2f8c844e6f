"""SimHash near-duplicates by pivot distance tables.

Each text has a 64-bit fingerprint; two fingerprints link at ``RADIUS`` or fewer differing bits. Only distinct fingerprints
are compared. The pivot table holds, for each fingerprint, its Hamming distances to reference fingerprints:

* axis pivots, a base fingerprint with one bit turned over. The difference of the distances to such a pivot and to the
  base is -1 or +1, that is, one bit of the fingerprint, so the coordinates on a block of axis pivots are read off with
  a shift. Two fingerprints within 2 bits agree on the coordinates of at least two of the four 16-bit blocks; the six
  pairs of blocks are the keys that candidates share. Nothing is missed and no pair without such a key is looked at.
* ``PIVOTS`` spread over the space. A distance moves by one a bit at most, so a candidate pair with a coordinate
  difference over ``RADIUS`` (the maximum norm) is discarded; survivors are verified bit by bit.

A key that more than ``BUCKET`` distinct fingerprints share is not paired: its fingerprints take the exact other way. Each
one emits itself and its single-bit changes within the key's other 32 bits; two of them are within 2 bits exactly if
they emit a common value, and a value has at most 33 emitters, who are linked to the least of them. So neither a hot key
nor a large group of near copies makes a number of pairs that grows with its square, and no link is lost.

Fingerprints: A-Z are lower-cased, words are runs of other than ASCII white space, shingles are three words joined by one
space with repeats (fewer words: the whole sequence), each hashed with XXH64, seed 42. A bit is set if over half of the
hashes set it. Null and empty texts have fingerprint zero, which links like any other. Repeated rows link as equal
fingerprints. A null doc_id never names a component unless all ids in it are null. Long texts are read whole, in blocks of
shingles. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import binary, bounded, fresh_prefix, quoted, runs_of, staged, table
from .components import components

RADIUS = 2
BUCKET = 64
SHINGLE = 3
#: Reference fingerprints, drawn once.
PIVOTS = tuple(int(x) for x in np.random.default_rng(20240607).integers(-(2**63), 2**63, 12, dtype=np.int64))
BLOCKS = tuple((a, b) for a in range(4) for b in range(a + 1, 4))
_CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - SHINGLE + 1
    first, last = starts[:n].tolist(), ends[SHINGLE - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        own = [digest(joined[s:e], 42) for s, e in zip(first[at : at + _CHUNK], last[at : at + _CHUNK], strict=True)]
        bits = np.unpackbits(np.array(own, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Bytes hold sums of up to 255 rows; add them in such steps.
        whole = len(bits) // 255 * 255
        counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, with_hash: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. ``with_hash`` adds th, Spark's xxhash64 of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            own = np.array([fingerprint(t) for a, b in runs_of(texts) for t in binary(texts[a:b])], np.uint64).view(np.int64)
            rest = {"th": batch.column(2)} if with_hash else {}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(own)} | rest)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if with_hash:
        columns.append(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"))
    return bounded(docs).select(*columns).mapInArrow(work, "doc_id long, fp long" + ", th long" * with_hash)


def _block_key(fp: Column, blocks: tuple[int, int]) -> Column:
    """The axis-pivot coordinates on two blocks, as 32 bits."""
    low, high = (F.shiftrightunsigned(fp, 16 * b).bitwiseAND(0xFFFF) for b in blocks)
    return low + high * 65536


def _flips(fp: Column, blocks: tuple[int, int]) -> Column:
    """The fingerprint and its single-bit changes outside the key's blocks."""
    masks = [0] + [1 << (16 * b + i) for b in range(4) if b not in blocks for i in range(16)]
    return F.array(*[fp.bitwiseXOR(F.lit(m - 2**64 if m >= 2**63 else m)) for m in masks])


def fingerprint_links(distinct: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, int]:
    """Links (a, b) between the distinct fingerprints ``fp`` that give the same components as all links do, and about how many
    there are."""
    fp = F.col("fp")
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), _block_key(fp, b).alias("key")) for j, b in enumerate(BLOCKS)])).alias("k")).select("fp", "k.*")
    shared = keyed.groupBy("j", "key").count().filter("count > 1")
    live = staged(keyed.join(shared, ["j", "key"]), "keys", len(BLOCKS) * distinct.count())
    pivots = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("tinyint").alias(f"p{i}") for i, p in enumerate(PIVOTS)]
    few = live.filter(F.col("count") <= bucket).select("j", "key", "fp", *pivots)
    x, y = few.alias("x"), few.alias("y")
    spread = F.greatest(*[F.abs(F.col(f"x.p{i}") - F.col(f"y.p{i}")) for i in range(len(PIVOTS))])
    differing = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    on = (F.col("x.j") == F.col("y.j")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp"))
    pairs = x.join(y, on & (spread <= RADIUS) & (differing <= RADIUS)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = live.filter(F.col("count") > bucket)
    by_j = F.coalesce(*[F.when(F.col("j") == j, _flips(fp, b)) for j, b in enumerate(BLOCKS)])
    near = many.select("j", "fp", F.explode(by_j).alias("value"))
    stars = near.groupBy("j", "value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    spokes = near.join(stars, ["j", "value"]).select("a", F.col("fp").alias("b")).filter("a <> b")
    return pairs.union(spokes).distinct(), 2 * live.count()


def fingerprint_components(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(fp, label, component_id) for the distinct fingerprints of ``rows`` (doc_id, fp).

    ``label`` names the component by its least fingerprint; ``component_id`` is the least id, which two components can share
    where ids repeat.
    """
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", rows.count())
    links, most = fingerprint_links(distinct.select("fp"), bucket)
    labels = components(links, most=most)
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    linked = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return named.select("fp", "label").join(linked, "label").select("fp", "label", "component_id")


def groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    rows = staged(fingerprints(docs), "fingerprints")
    return rows.join(fingerprint_components(rows, bucket), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row of each group stays: that of the least doc_id (null ids last), then of the least text hash.

    Rows that repeat both id and text count once; of those the least by a hash of all columns stays. The choice is made
    on ids and hashes: first the best row of each fingerprint, then of each group, both as aggregates that are combined
    before the shuffle, so that no group of copies meets in one task. Texts meet only the list of what stays. Columns may
    have any names.
    """
    columns, p = quoted(docs.columns), fresh_prefix(docs.columns, "_k_")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(fingerprints(own, with_hash=True), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = rows.groupBy("fp").agg(F.min(place).alias("best"))
    best = staged(first.join(fingerprint_components(rows, bucket), "fp").groupBy("label").agg(F.min("best").alias("best")).select("best.doc_id", "best.th"), "best", rows.count())
    tagged = docs.select(*columns, F.col("doc_id").cast("long").alias(f"{p}id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(f"{p}th"))

    def of(which: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        which = which.select(F.col("doc_id").alias(f"{p}i"), F.col("th").alias(f"{p}t"))
        return rows.join(which, F.col(f"{p}id").eqNullSafe(F.col(f"{p}i")) & (F.col(f"{p}th") == F.col(f"{p}t")), how)

    kept = of(best, "left_semi", tagged)
    several = rows.groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1")
    several = several.join(best.select(F.col("doc_id").alias("i"), F.col("th").alias("t")), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left_semi").select("doc_id", "th")
    if (several := staged(several, "several", rows.count())).limit(1).count():
        every = F.struct(*columns)
        once = of(several, "left_semi", kept).groupBy(f"{p}id", f"{p}th").agg(F.min_by(every, F.xxhash64(every)).alias(f"{p}row")).select(f"{p}row.*")
        return of(several, "left_anti", kept).select(*columns).unionByName(once)
    return kept.select(*columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLE_SQL: dict[str, str] = {}
