"""Indexes as folders of Parquet files with a manifest table, and pruning by it.

The manifest has a row for each file: its rows, time range and the values of its tag fields. It is a DataFrame; only the
paths of the files that a query needs reach the driver.

Beside it, ``terms/`` has for each file and text field a bitmap of ``TERM_BITS`` bits, set at the hashes of the terms that the
file holds. A query that needs a term reads only files whose bit for it is set; a file without bitmaps is always read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import analyzers
from ..plans.config import MergePolicy

MOST_TAG_VALUES = 1000
PARTITION = "_partition"
#: Bits of a file's term filter: 32 blocks of 4096 bytes.
BLOCK_BITS = 32_768
TERM_BITS = 32 * BLOCK_BITS
#: Bytes of files that a merge takes at most, as one task makes a file of them; a file of half as many is merged no more.
MERGE_BYTES = 64 << 20
#: How files are written: compression, and row groups and pages small enough to skip within a file.
WRITE = {"compression": "zstd", "parquet.block.size": str(64 << 20), "parquet.page.size": str(1 << 20)}


def term_bit(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BITS)).cast("long")


class Index:
    """An index under ``path``: ``data/`` holds the files, ``manifest/`` a row for each.

    ``sort`` orders the rows of each file, and Bloom filters on ``bloom`` columns let a scan skip row groups by equality.
    ``texts`` names the text fields that have term filters, with their analyzers.
    """

    def __init__(self, spark: SparkSession, path: str, timestamp: str | None = None, tags: tuple[str, ...] = (), sort: tuple[str, ...] = (), bloom: tuple[str, ...] = (), texts: dict[str, str] | None = None):
        self.spark, self.path, self.timestamp, self.tags = spark, path.rstrip("/"), timestamp, tags
        self.sort, self.bloom, self.texts = sort, bloom, texts or {}
        self.options = WRITE | {f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom} | {f"parquet.bloom.filter.fpp#{c}": "0.05" for c in bloom}

    @property
    def data(self) -> str:
        return f"{self.path}/data"

    def _path(self, name: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str = "manifest") -> bool:
        fs, p = self._path(f"{self.path}/{name}")
        return fs.exists(p)

    def append(self, df: DataFrame, files: int | None = None, merges: int = 0) -> None:
        """Write the rows, then their manifest entries: a reader never sees files that the manifest lacks."""
        import uuid

        self.remember(df)
        batch = f"{self.data}/batch={uuid.uuid4().hex}"
        self.write(df.coalesce(files) if files else df, batch)
        self.publish(batch, merges)

    def publish(self, batch: str, merges: int = 0) -> None:
        """Term filters of a folder's files, then their manifest entries."""
        if self.texts:
            self.term_filters(batch).write.mode("append").parquet(f"{self.path}/terms")
        self.describe(batch, merges).write.mode("append").parquet(f"{self.path}/manifest")

    def term_filters(self, folder: str) -> DataFrame:
        """(file, field, block, bits): set bits are combined in each task before the shuffle, so a block is one small row."""
        df, out = self.spark.read.parquet(folder), None
        for field, analyzer in self.texts.items():
            terms = analyzers.analyze(analyzer, F.col(f"`{field}`"))
            own = df.select(F.col("_metadata.file_path").alias("file"), F.lit(field).alias("field"), F.explode(F.array_distinct(terms)).alias("term")).withColumn("bit", term_bit(F.col("term")))
            own = own.groupBy("file", "field", F.floor(F.col("bit") / BLOCK_BITS).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.col("bit") % BLOCK_BITS).alias("bits"))
            out = own if out is None else out.unionByName(own)
        return out

    def write(self, df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
        """Rows with a ``_partition`` go to files of their partition alone, under a folder that is named after it."""
        own = df.sortWithinPartitions(*[c for c in (PARTITION,) if c in df.columns], *self.sort) if self.sort else df
        writer = own.withColumn("_part", F.col(PARTITION)).write.partitionBy("_part") if PARTITION in df.columns else own.write
        writer.mode(mode).options(**self.options).parquet(folder)

    def remember(self, df: DataFrame) -> None:
        """Keep the schema, for an index whose files are all gone."""
        if not self.exists("schema"):
            self.spark.createDataFrame([], df.schema).write.parquet(f"{self.path}/schema")

    def describe(self, folder: str, merges: int = 0) -> DataFrame:
        """Manifest rows of the files in a folder; ``merges`` is how often their rows were merged."""
        df = self.spark.read.parquet(folder)
        t = F.col(self.timestamp).cast("timestamp") if self.timestamp else F.lit(None).cast("timestamp")
        aggs = [F.count("*").alias("num_docs"), F.min(t).alias("time_start"), F.max(t).alias("time_end")]
        aggs += [F.first("_metadata.file_size").alias("bytes"), F.current_timestamp().alias("created"), F.lit(merges).alias("merges")]
        out = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(*aggs)
        for c in self.tags:
            # Of a file's distinct values one more than the limit are kept at most, so that no large set is ever built.
            pairs = df.select(F.col("_metadata.file_path").alias("file"), F.col(f"`{c}`").cast("string").alias("v")).filter("v IS NOT NULL").distinct()
            few = pairs.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("v"))).filter(F.col("k") <= MOST_TAG_VALUES + 1)
            lists = few.groupBy("file").agg(F.array_sort(F.collect_list("v")).alias("vs"))
            tag = F.when(F.size(F.coalesce("vs", F.array())) <= MOST_TAG_VALUES, F.coalesce("vs", F.array().cast("array<string>")))
            out = out.join(lists, "file", "left").withColumn(f"tag_{c}", tag).drop("vs")
        return out

    def manifest(self) -> DataFrame:
        """Entries that no tombstone removes."""
        own = self.spark.read.parquet(f"{self.path}/manifest")
        if self.exists("removed"):
            own = own.join(self.spark.read.schema("file string").parquet(f"{self.path}/removed"), "file", "left_anti")
        return own

    def prune(self, start=None, end=None, tags: dict[str, list[str]] | None = None, terms: dict[str, list[str]] | None = None) -> DataFrame:
        """Entries of files that may hold rows in [start, end) with the tags, and of each field all of the terms.

        A file without tag values or term filters is kept.
        """
        own = self.manifest()
        if start is not None:
            own = own.filter(F.col("time_end").isNull() | (F.col("time_end") >= F.lit(start).cast("timestamp")))
        if end is not None:
            own = own.filter(F.col("time_start").isNull() | (F.col("time_start") < F.lit(end).cast("timestamp")))
        for c, values in (tags or {}).items():
            if f"tag_{c}" in own.columns:
                own = own.filter(F.col(f"tag_{c}").isNull() | F.arrays_overlap(f"tag_{c}", F.array(*[F.lit(str(v)) for v in values])))
        wanted = [(f, t) for f, ts in (terms or {}).items() if f in self.texts for t in dict.fromkeys(ts)]
        if wanted and self.exists("terms"):
            filters = self.spark.read.parquet(f"{self.path}/terms")
            places = self.spark.createDataFrame(wanted, "field string, term string").withColumn("bit", term_bit(F.col("term"))).collect()  # the query's terms
            tests = []
            for r in places:
                at = r["bit"] % BLOCK_BITS
                byte = F.conv(F.hex(F.expr(f"substring(bits, {at // 8 + 1}, 1)")), 16, 10).cast("int")
                tests.append((F.col("field") == r["field"]) & (F.col("block") == r["bit"] // BLOCK_BITS) & (byte.bitwiseAND(F.lit(1 << at % 8)) != 0))
            needed = reduce(lambda x, y: x | y, [(F.col("field") == r["field"]) & (F.col("block") == r["bit"] // BLOCK_BITS) for r in places])
            has = filters.filter(needed).groupBy("file").agg(*[F.max(t).alias(f"h{k}") for k, t in enumerate(tests)])
            # A file that is known but lacks a block holds no term of it.
            known = filters.select("file").distinct().join(has, "file", "left").filter(~reduce(lambda x, y: x & y, [F.coalesce(f"h{k}", F.lit(False)) for k in range(len(tests))]))
            own = own.join(known.select("file"), "file", "left_anti")
        return own

    def scan(self, start=None, end=None, tags: dict[str, list[str]] | None = None, terms: dict[str, list[str]] | None = None) -> DataFrame:
        files = [r[0] for r in self.prune(start, end, tags, terms).select("file").collect()]
        if not files:
            return self.spark.read.parquet(f"{self.path}/schema")
        return self.spark.read.parquet(*files)

    def count(self) -> int:
        """Rows, from the manifest alone."""
        return self.manifest().agg(F.coalesce(F.sum("num_docs"), F.lit(0))).first()[0]

    def remove(self, files: DataFrame) -> None:
        files.select("file").write.mode("append").parquet(f"{self.path}/removed")

    def retain(self, now, period_seconds: int) -> None:
        """Drop files whose last row is older than the period."""
        limit = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(period_seconds))
        self.remove(self.manifest().filter(F.col("time_end") <= limit))

    def rewrite(self, old: DataFrame, rows: DataFrame, merges: int = 0) -> None:
        """Replace files by rows: the new files first, then the tombstones."""
        files = self.spark.createDataFrame(old.select("file").collect(), T.StructType([T.StructField("file", T.StringType())]))
        self.append(rows, merges=merges)
        self.remove(files)

    def merge(self, policy: MergePolicy, now=None, target_docs: int = 10_000_000) -> int:
        """Merge files as the policy plans; returns how many were merged. Each group becomes one file."""
        own = self.manifest().withColumn("age", F.unix_seconds(F.lit(now).cast("timestamp") if now else F.current_timestamp()) - F.unix_seconds("created"))
        # Files of one partition of the index and one schema merge with each other alone.
        scope = F.regexp_extract("file", r"/_part=([^/]*)/", 1)
        plan: list[list[dict]] = []
        for (part,) in own.select(scope).distinct().collect():
            rows = [r.asDict() for r in own.filter(scope == part).select("file", "num_docs", "bytes", "merges", "age", "time_end").collect()]  # file entries, not rows
            plan += plan_policy(rows, policy, target_docs)
        groups = [([r["file"] for r in group], 1 + max(r["merges"] for r in group)) for group in plan]
        for merges in sorted({m for _, m in groups}):
            self._merge([files for files, m in groups if m == merges], merges)
        return sum(len(g) for g in plan)

    def _merge(self, groups: list[list[str]], merges: int, sort: list[str] | None = None) -> None:
        """Each group of files becomes one file, all groups in one job; a group has as many rows and bytes as its plan allows."""
        of = self.spark.createDataFrame([(f, k) for k, files in enumerate(groups) for f in files], "_file string, _group int")
        rows = self.spark.read.parquet(*[f for files in groups for f in files]).withColumn("_file", F.col("_metadata.file_path"))
        rows = rows.join(F.broadcast(of), "_file").repartitionById(len(groups), F.col("_group")).drop("_file", "_group")  # a row a file
        self.rewrite(of.select(F.col("_file").alias("file")), rows.sortWithinPartitions(*sort) if sort else rows, merges)

    def delete(self, condition, start=None, end=None, tags: dict[str, list[str]] | None = None, terms: dict[str, list[str]] | None = None) -> None:
        """Delete by query: files with matches are written again without them. The bounds, where every match has them, spare
        the other files a scan."""
        hit = self.scan(start, end, tags, terms).filter(condition).select(F.col("_metadata.file_path").alias("file")).distinct()
        files = [r[0] for r in hit.collect()]
        if files:
            self.rewrite(self.spark.createDataFrame([(f,) for f in files], "file string"), self.spark.read.parquet(*files).filter(~F.coalesce(condition, F.lit(False))))

    def compact(self, target_docs: int, sort: list[str] | None = None) -> int:
        """Merge files smaller than the target; returns how many were merged."""
        own = self.manifest().select("file", "num_docs", "bytes").collect()
        plan = plan_merges([(r["file"], r["num_docs"]) for r in own], target_docs, sizes={r["file"]: r["bytes"] for r in own})
        if plan:
            self._merge(plan, 1, sort)
        return sum(len(g) for g in plan)

    def collect_garbage(self) -> int:
        """Delete removed files from storage."""
        if not self.exists("removed"):
            return 0
        n = 0
        for r in self.spark.read.schema("file string").parquet(f"{self.path}/removed").distinct().toLocalIterator():
            fs, p = self._path(r[0])
            n += bool(fs.delete(p, False))
        return n


def plan_policy(files: list[dict], policy: MergePolicy, target: int = 10_000_000) -> list[list[dict]]:
    """Groups of files to merge. Mature files are left alone: old ones, and those of ``target`` rows or half of ``MERGE_BYTES``.

    stable_log: files of one level of size, the level growing by the merge factor from ``min_level_num_docs`` on, newest
    first. limit_merge: files that underwent as many merges. A group has ``merge_factor`` files at least and
    ``max_merge_factor`` at most, or fewer where the next one would take it past the target or ``MERGE_BYTES``.
    """
    if policy.kind == "no_merge":
        return []
    if policy.kind not in ("stable_log", "limit_merge"):
        raise ValueError(f"unknown merge policy {policy.kind}")
    levels: dict[int, list[dict]] = {}
    for r in files:
        if r["age"] is not None and r["age"] >= policy.maturation_seconds or r["num_docs"] >= target or 2 * _bytes(r) >= MERGE_BYTES:
            continue
        if policy.kind == "limit_merge":
            if r["merges"] < policy.max_merge_ops:
                levels.setdefault(r["merges"], []).append(r)
            continue
        level, bound = 0, policy.min_level_num_docs
        while r["num_docs"] >= bound:
            level, bound = level + 1, bound * policy.merge_factor
        levels.setdefault(level, []).append(r)
    out = []
    for own in levels.values():
        group: list[dict] = []
        for r in sorted(own, key=lambda r: (str(r["time_end"]), r["file"]), reverse=True):
            full = len(group) >= policy.max_merge_factor or sum(x["num_docs"] for x in group) >= target or sum(map(_bytes, group)) + _bytes(r) > MERGE_BYTES
            if group and full:
                out.append(group)
                group = []
            group.append(r)
        if len(group) >= policy.merge_factor or len(group) > 1 and sum(x["num_docs"] for x in group) >= target:
            out.append(group)
    return out


def _bytes(entry: dict) -> int:
    return entry.get("bytes") or 0


def plan_merges(files: list[tuple[str, int]], target: int, least: int = 2, most: int = 12, sizes: dict[str, int] | None = None) -> list[list[str]]:
    """Groups of files to merge: small ones first, up to ``most`` a group, about ``target`` rows and ``MERGE_BYTES`` of ``sizes``."""
    out: list[list[str]] = []
    own: list[str] = []
    rows = size = 0
    sizes = sizes or {}
    for name, n in sorted((f for f in files if f[1] < target and 2 * (sizes.get(f[0]) or 0) < MERGE_BYTES), key=lambda f: (f[1], f[0])):
        if own and (len(own) >= most or rows + n > target or size + (sizes.get(name) or 0) > MERGE_BYTES):
            out.append(own)
            own, rows, size = [], 0, 0
        own.append(name)
        rows, size = rows + n, size + (sizes.get(name) or 0)
    out.append(own)
    return [g for g in out if len(g) >= least]
