"""WARC archives with an externally merged capture index.

Writing. Rows are joined with the response of their payload group (the least page_id that has the payload), so each task
knows for its own rows which are responses and which revisits. A task writes gzip members, one a record, to files that are
closed at ``FILE_BYTES`` or ``FILE_RECORDS``, and for each file a *run*: its captures, sorted by (URL key, timestamp,
page_id, place). File names are unique to an attempt; only the manifest, which Spark commits, says which files count, so a
task that runs again leaves stray files at worst, never a wrong archive.

Merging. Each range of keys is one task. It opens the runs at its lower bound, which each run's directory of first keys
finds, and merges them with a loser tree (log2 k comparisons a capture) up to its upper bound. A task opens about ``FAN_IN``
runs at most: with more, groups of runs are merged into longer runs first, by ranges too. Range bounds come from a bounded sample of keys; they
only decide how evenly tasks are filled. The keys are whole capture keys, so one host or one URL with a third of all
captures is still cut into many ranges.

Payloads are the html in UTF-8; null html counts as empty. Payloads under ``LEAST_REVISIT`` bytes are always responses.
Every row that bears the group's least page_id is a response (repeated rows); a null page_id is never a response for
others, and if all ids of a group are null, all its rows are responses. A null or empty URL is written as ``unknown:``. Long
payloads are held once a task. Extra columns are ignored.

Paths go through pyarrow's file systems, by the scheme of the shared folder.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import binary, bounded, shared_dir, staged, table

LEAST_REVISIT = 100
FILE_BYTES = 64 << 20
FILE_RECORDS = 200_000
FAN_IN = 256
RANGE_ROWS = 200_000
LEVEL_ROWS = 1_000_000
SAMPLE_KEYS = 50_000
EPOCH = 946_684_800  # page 0 was captured at 2000-01-01T00:00:00Z, page n n seconds later
_MAX_ID = (1 << 62) - 1

RUN_SCHEMA = pa.schema([("urlkey", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
RUN_BATCH = 4096
_KEY = pa.struct([("urlkey", pa.string()), ("ts", pa.string()), ("page_id", pa.int64())])
MANIFEST_SCHEMA = pa.schema([("file", pa.string()), ("run", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sample", pa.list_(_KEY))])
MANIFEST = "file string, run string, records long, bytes long, sample array<struct<urlkey: string, ts: string, page_id: long>>"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then the path, lower-cased, without scheme, port 80/443 or ``www``."""
    m = re.match(r"(?s)^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)(.*)$", url)
    if not m:
        return url.lower()
    host = re.sub(r":(80|443)$", "", m[1].rpartition("@")[2].lower())
    host = host.removeprefix("www.")
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (":" + port if port else "") + ")" + (m[2].lower() or "/")


def timestamp(page_id: int | None) -> str:
    """WARC-Date of a page; the table has no capture time, so it follows from the id."""
    import datetime as dt

    seconds = (page_id or 0) % (1 << 32)
    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=EPOCH + seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _urn(page_id: int | None) -> str:
    return f"<urn:capture:{'none' if page_id is None else page_id}>"


def _of_urn(urn: str) -> int | None:
    name = urn.rpartition(":")[2].rstrip(">")
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit has headers only; X-Payload-Length keeps the full payload's length."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "unknown:"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {timestamp(page_id)}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Archive:
    """One archive file and its run."""

    def __init__(self, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}"
        fs, path = _fs(self.name)
        self.fs, self.path = fs, path
        self.out = fs.open_output_stream(path + ".warc.gz", compression=None)
        self.at, self.captures = 0, []

    def add(self, data: bytes, urlkey: str, ts: str, page_id: int | None) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.captures.append((urlkey, ts, _MAX_ID if page_id is None else page_id, self.name + ".warc.gz", self.at, len(member)))
        self.at += len(member)

    def close(self) -> dict:
        self.out.close()
        self.captures.sort()
        run = self.name + ".run"
        with RunWriter(run) as w:
            for c in self.captures:
                w.add(c)
        return {"file": self.name + ".warc.gz", "run": run, "records": len(self.captures), "bytes": self.at, "sample": _sample([c[:3] for c in self.captures])}


def _sample(keys: list[tuple]) -> list[dict]:
    step = max(1, len(keys) // 32)
    return [dict(zip(("urlkey", "ts", "page_id"), k, strict=True)) for k in keys[::step]]


class RunWriter:
    """A sorted run: an Arrow file in batches, with the first key of each batch in a file beside it."""

    def __init__(self, name: str):
        self.fs, self.path = _fs(name)
        self.sink = self.fs.open_output_stream(self.path)
        self.file = pa.ipc.new_file(self.sink, RUN_SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.rows, self.first = [], []

    def __enter__(self):
        return self

    def add(self, capture: tuple) -> None:
        self.rows.append(capture)
        if len(self.rows) == RUN_BATCH:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.first.append(self.rows[0][:5])
            self.file.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), RUN_SCHEMA, strict=True)], schema=RUN_SCHEMA))
            self.rows = []

    def __exit__(self, *_):
        self.flush()
        self.file.close()
        self.sink.close()
        with self.fs.open_output_stream(self.path + ".keys") as out:
            out.write(json.dumps(self.first).encode())


def read_run(name: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """The captures of a run with low <= key < high, one batch in memory."""
    fs, path = _fs(name)
    with fs.open_input_stream(path + ".keys") as f:
        first = [tuple(k) for k in json.loads(f.read())]
    start = 0 if low is None else max(0, bisect.bisect_left(first, low) - 1)
    with fs.open_input_file(path) as source:
        reader = pa.ipc.open_file(source)
        for i in range(start, reader.num_record_batches):
            if high is not None and first[i] >= high:
                return
            batch = reader.get_batch(i)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if low is not None and row < low:
                    continue
                if high is not None and row >= high:
                    return
                yield row


class LoserTree:
    """K-way merge. Inner nodes hold the loser of their match, node 0 the winner; the next winner replays one path."""

    def __init__(self, runs: Iterable[Iterator[tuple]]):
        self.runs = list(runs)
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.node = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _replay(self, winner: int) -> None:
        at = (winner + self.k) // 2
        while at > 0:
            if self.node[at] == -1:  # still building: wait here for an opponent
                self.node[at] = winner
                return
            if self._beats(self.node[at], winner):
                self.node[at], winner = winner, self.node[at]
            at //= 2
        self.node[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            winner = self.node[0]
            if (row := self.heads[winner]) is None:
                return
            yield row
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, bytes, refers_to, revisit for each row.

    Payload groups are summed before the shuffle and written. Groups of more than a partition's share of the rows, of which
    there are at most as many as partitions, are broadcast; their rows then need no partner in the shuffle, are dealt out by
    their ids, and meet in no one task, however many copies a payload has.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    spark = pages.sparkSession
    shared = staged(rows.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1 AND least IS NOT NULL"), "shared")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = (shared.agg(F.sum("n")).first()[0] or 0) // partitions + 1
    hot = F.broadcast(shared.filter(F.col("n") > share).select("digest", F.col("least").alias("hot")))  # under one a partition
    dealt = rows.join(hot, "digest", "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("hot "), F.coalesce("page_id", F.lit(-1)).cast("string"))))
    joined = dealt.join(shared.filter(F.col("n") <= share).select(F.col("digest").alias("key"), "least"), "key", "left")
    least = F.coalesce("hot", "least")
    revisit = least.isNotNull() & ~F.col("page_id").eqNullSafe(least)
    return joined.select("page_id", "url", "html", "digest", "bytes", F.when(revisit, least).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives and their runs under ``folder``; the manifest, one row a file, as a committed table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            html = binary(batch.column("html"))
            rest = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "revisit")), strict=True)
            for payload, (page_id, url, digest, refers_to, revisit) in zip(html, rest, strict=True):
                archive = archive or _Archive(folder)
                archive.add(record(page_id, url, payload, digest, refers_to, revisit), url_key(url or "unknown:"), timestamp(page_id), page_id)
                if archive.at >= FILE_BYTES or len(archive.captures) >= FILE_RECORDS:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=MANIFEST_SCHEMA)

    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    return staged(bounded(decide(pages)).mapInArrow(work, MANIFEST), "manifest")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one uncompressed record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {"": lines[0]} | dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset.

    Digests of responses are computed from the payload that was read and must equal the header's.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])

    def records(name: str) -> Iterator[tuple]:
        fs, path = _fs(name)
        with fs.open_input_stream(path, compression=None) as source:
            data, at = b"", 0
            while True:
                unpack, out, begin = zlib.decompressobj(31), [], at
                while not unpack.eof:
                    if not data and not (data := source.read(1 << 20)):
                        if out:
                            raise EOFError(f"{name} ends within a record")
                        return
                    out.append(unpack.decompress(data))
                    at += len(data) - len(unpack.unused_data)
                    data = unpack.unused_data
                fields, payload = parse(b"".join(out))
                said, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and (hashlib.sha256(payload).hexdigest() != said or len(payload) != size):
                    raise ValueError(f"{name} at {begin}: the payload does not match its digest")
                yield _of_urn(fields["WARC-Record-ID"]), size, said, fields["WARC-Type"], _of_urn(fields["WARC-Refers-To"]) if revisit else None, name, begin

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for row in records(name):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    n = max(1, manifest.count())
    return manifest.select("file").repartition(min(n, 10_000), "file").mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def merge_index(manifest: DataFrame, folder: str, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The global index: urlkey, ts, page_id, file, offset, length, index_range, index_pos; ordered by (index_range, index_pos).

    While a range of keys has more than ``fan_in`` runs, they are merged in groups, each group in as many key ranges as keep
    a task's rows bounded; a level's output lies in the finer ranges of the next. Every level has about total / ``LEVEL_ROWS``
    tasks, so neither many runs nor long ones meet in one task.
    """
    head = manifest.agg(F.sum("records"), F.count("*")).first()
    total, files = head[0] or 0, head[1]
    keys = manifest.select(F.explode("sample").alias("s")).select("s.*")
    if files * 33 > SAMPLE_KEYS:
        keys = keys.sample(SAMPLE_KEYS / (files * 33), 7)
    sampled = sorted(tuple(r) for r in keys.limit(2 * SAMPLE_KEYS).collect())

    def edges(ranges: int) -> list[tuple | None]:
        """Bounds of so many ranges; those of a multiple contain them."""
        return [None, *[(*sampled[i * len(sampled) // ranges], "", -1) for i in range(1, ranges)], None]

    runs, ranges = manifest.select(F.lit(0).alias("part"), "run"), 1
    most = 10_000 if sampled else 1
    while (k := runs.groupBy("part").count().agg(F.max("count")).first()[0] or 0) > fan_in:
        groups = min(k - 1, -(-5 * k // (4 * fan_in)))  # dealt by a hash, so with some room
        split = max(1, min(most // ranges, -(-total // (ranges * groups * LEVEL_ROWS))))
        bounds = edges(ranges * split)

        def longer(batches: Iterator[pa.RecordBatch], bounds=bounds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rows = iter(LoserTree(read_run(n, bounds[part], bounds[part + 1]) for n in names))
                    if (row := next(rows, None)) is None:
                        continue
                    name = f"{folder}/{uuid.uuid4().hex}.run"
                    with RunWriter(name) as w:
                        w.add(row)
                        for row in rows:
                            w.add(row)
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name])], names=["part", "run"])

        grouped = runs.groupBy("part", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("g")).agg(F.collect_list("run").alias("runs"))
        tasks = grouped.select(F.explode(F.expr(f"transform(sequence(0, {split - 1}), i -> part * {split} + i)")).alias("part"), "g", "runs")
        tasks = tasks.repartition(min(10_000, ranges * split * groups), "part", "g").select("part", "runs")
        runs, ranges = staged(tasks.mapInArrow(longer, "part int, run string"), "runs"), ranges * split
    split = max(1, min(most // ranges, -(-total // (ranges * range_rows))))
    bounds = edges(ranges * split)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = RUN_SCHEMA.append(pa.field("index_range", pa.int64())).append(pa.field("index_pos", pa.int64()))
        for batch in batches:
            for r, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                for at, row in enumerate(LoserTree(read_run(n, bounds[r], bounds[r + 1]) for n in names)):
                    rows.append((*row, r, at))
                    if len(rows) == 10_000:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    spec = "urlkey string, ts string, page_id long, file string, offset long, length long, index_range long, index_pos long"
    own = runs.groupBy("part").agg(F.sort_array(F.collect_list("run")).alias("runs"))  # fan_in at most
    tasks = own.select(F.explode(F.expr(f"transform(sequence(0, {split - 1}), i -> part * {split} + i)")).alias("part"), "runs")
    return tasks.repartition(ranges * split, "part").mapInArrow(merge, spec)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write(table(spark, sf_dir, "pages"), folder)
    # Each record is found through the index: one that the merge lost would be missing here.
    index = merge_index(manifest, folder).select("file", "offset")
    return read(manifest).join(index.hint("merge"), ["file", "offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc": op3_warc}
ORACLE_SQL = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS least FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN least IS NULL OR least = page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN least <> page_id THEN least END AS refers_to FROM d LEFT JOIN g USING (payload_digest)"""
}
