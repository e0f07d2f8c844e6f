"""Substring dedup with suffix arrays: bytes under 50-byte strings that an earlier document has too.

The key of a 50-byte window is the least hash of its 16-byte strings, a choice that its bytes alone decide (see
``_repeats`` for the plan). Windows under a key that documents of different ids share are candidates. Neighbouring windows
of one key form a fragment; each bucket sends each distinct fragment once, and all fragments of a key meet in one shard. A
bucket tells its own fragments apart by a 64-bit hash and the 64-bit key together. Windows of a hot key, which very many
buckets have, take the least hash of their 32-byte strings as a finer key, so that a common phrase in ever new surroundings
does not meet in one shard.

Equal fragments of a shard, told by their bytes, are sorted once; a key that has one distinct fragment needs no order. A
shard sorts its suffixes in two stages. Suffixes smaller than their successors (S) are sorted directly, by their first
56 bytes. The rest (L) is induced: buckets are scanned by first byte, from small to great; each suffix that is met places
its predecessor, if that is an L suffix, next in the bucket of the predecessor's first byte. An L suffix is greater than
its successor, so the scan meets the successor first. Buckets are scanned as arrays, not byte by byte. Only window starts
and the suffixes that induce them are sorted. Adjacent common prefixes of 50 bytes or more then bound the groups of equal
windows, exactly and without hashes; the least id of a group decides for its members.

A text is its UTF-8 bytes; null is empty. Texts under 50 bytes lose nothing. Long texts are read whole, in segments that
overlap by a window, and long runs of one key are cut into fragments of ``PIECE`` windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import binary, mix, table
from ._repeats import BYTE_NAMES, CHUNK_BYTES, LAST_ID, Deal, RangeHash, _ids, bucket_of, chunks, copied, known_keys, member, signed, unrepeated

WINDOW = 50
GRAM = 16
PIECE = 256
SHARD_BYTES = 1 << 20
_U = np.uint64


def _words_at(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The 8-byte number at every place of ``data`` (uint8, contiguous)."""
    return np.ndarray(max(0, len(data) - 7), kind, data.data, strides=(1,))


def window_keys(data: np.ndarray) -> np.ndarray:
    """The key of the window at each place of ``data``, documents disregarded."""
    if len(data) < WINDOW:
        return np.zeros(0, np.uint64)
    return _least(_grams(data), WINDOW - GRAM + 1)


def fine_keys(data: np.ndarray) -> np.ndarray:
    """Finer keys of the same windows: the least hash of their 32-byte strings."""
    if len(data) < WINDOW:
        return np.zeros(0, np.uint64)
    v = _grams(data)
    return _least(mix(v[:-GRAM] * _U(0xD6E8FEB86659FD93) ^ v[GRAM:]), WINDOW - 2 * GRAM + 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes at each place."""
    w = _words_at(data)
    v = w[:-8] * _U(0x9E3779B97F4A7C15) + (w[8:] ^ (w[8:] >> _U(31))) * _U(0xC2B2AE3D27D4EB4F)
    v ^= v >> _U(29)
    v *= _U(0xBF58476D1CE4E5B9)
    v ^= v >> _U(32)
    return v


def _least(v: np.ndarray, count: int) -> np.ndarray:
    """The least of each ``count`` neighbours."""
    width = 1
    while 2 * width <= count:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    rest = count - width
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def _join(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    return b"".join(texts), np.cumsum([0] + [len(t) for t in texts])


def _runs(data: bytes, starts: np.ndarray, hot: np.ndarray | None = None, shift: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """(coarse key, key, text, place, count) of the runs of neighbouring windows that lie within one text and share both keys, in
    segments. Under ``hot`` coarse keys the key is a finer one."""
    every = np.frombuffer(data, np.uint8)
    # Where a text begins and where its last window ends, windows stop to be within one text.
    borders = np.concatenate((starts[:-1], np.maximum(starts[1:] - WINDOW + 1, starts[:-1])))
    for at in range(0, max(0, len(data) - WINDOW + 1), CHUNK_BYTES):
        own = every[at : at + CHUNK_BYTES + WINDOW - 1]
        key = fine = window_keys(own)
        edge = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=edge[1:])
        if hot is not None and len(hot):
            fine = np.where(member(key >> _U(shift), hot) >= 0, mix(key ^ fine_keys(own)), key)
            edge[1:] |= fine[1:] != fine[:-1]
        edge[borders[(borders >= at) & (borders < at + len(key))] - at] = True
        first = np.flatnonzero(edge)
        place = first + at
        doc = np.searchsorted(starts, place, "right") - 1
        inside = np.flatnonzero(place + WINDOW <= starts[doc + 1])
        first, size = first[inside], np.diff(np.append(first, len(key)))[inside]
        yield key[first], fine[first], doc[inside], place[inside], size


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [(key, doc) for key, _, doc, _, _ in _runs(*_join(texts))]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _fragments(texts: list[bytes], known: np.ndarray | None = None, shift: int = 0, hot: np.ndarray | None = None):
    """The joined texts; key, text, first byte, end and name of their fragments, of ``known`` keys only if given.

    Fragments of ``hot`` keys have finer keys.
    """
    data, starts = _join(texts)
    hashes = RangeHash(BYTE_NAMES[np.frombuffer(data, np.uint8)])
    out = []
    for coarse, key, doc, place, size in _runs(data, starts, hot, shift):
        if known is not None and len(key):
            own = member(coarse >> _U(shift), known) >= 0
            key, doc, place, size = key[own], doc[own], place[own], size[own]
        if not len(key):
            continue
        parts = -(-size // PIECE)
        of = np.repeat(np.arange(len(size)), parts)
        step = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * PIECE
        begin = place[of] + step
        end = begin + np.minimum(PIECE, size[of] - step) + WINDOW - 1
        out.append((key[of], doc[of], begin, end, mix(hashes.of(begin, end) + (end - begin).astype(np.uint64))))
    if not out:
        return data, starts, *(np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, np.int64, np.uint64))
    return data, starts, *(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_order(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places i with ``wanted[i]`` (and those that induce them), in the order of the suffixes' first 56 bytes.

    ``data`` ends with 64 bytes of 255, which occur nowhere else.
    """
    n = len(data) - 64
    # S: smaller than the successor. Equal neighbours share a type, so the next change decides.
    change = np.flatnonzero(data[:-1] != data[1:])
    small = np.repeat(data[change] < data[change + 1], np.diff(change, prepend=-1))[:n]
    need = wanted.copy()
    while len(more := np.flatnonzero(need[:-1] & ~small[:-1] & ~need[1:])):
        need[more + 1] = True
    direct = np.flatnonzero(need & small)
    big = _words_at(data, ">u8")
    direct = direct[np.lexsort([big[direct + at].astype(np.uint64) for at in range(48, -1, -8)])]
    firsts = data[direct]
    edge = np.searchsorted(firsts, np.arange(257))
    parts: list[list[np.ndarray]] = [[] for _ in range(256)]
    large = need & ~small
    out = []
    for c in range(256):
        own = np.concatenate(parts[c]) if parts[c] else np.zeros(0, np.int64)
        new = own
        while len(new):  # equal neighbours, further into a run each time
            new = new[new > 0] - 1
            new = new[large[new] & (data[new] == c)]
            if len(new):
                own = np.concatenate((own, new))
        every = np.concatenate((own, direct[edge[c] : edge[c + 1]]))
        if not len(every):
            continue
        out.append(every)
        before = every[every > 0] - 1
        before = before[large[before] & (data[before] > c)]
        if len(before):
            first = data[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cut = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
            for a, b in zip(cut, np.append(cut[1:], len(first)), strict=True):
                parts[first[a]].append(before[a:b])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def same_prefix(data: np.ndarray, order: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """Whether each suffix in ``order`` has the first ``length`` bytes of the one before it."""
    w = _words_at(data)
    same = np.ones(max(0, len(order) - 1), bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        own = w[order + at]
        same &= own[:-1] == own[1:]
    return np.concatenate(([False], same)) if len(order) else same


def _least_runs(low: np.ndarray, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one least id: fragment, first window, count and the least of ``low`` over all fragments with the window."""
    size = np.array([len(f) for f in fragments], np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(fragments) + b"\xff" * 64, np.uint8)
    of = np.repeat(np.arange(len(size)), size)
    wanted = np.arange(len(of)) <= ends[of] - WINDOW
    order = suffix_order(data, wanted)
    order = order[wanted[order]]
    group = np.flatnonzero(~same_prefix(data, order))
    least = np.zeros(len(of), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[of[order]], group), np.diff(np.append(group, len(order))))
    place = np.flatnonzero(wanted)
    f, least = of[place], least[place]
    first = np.flatnonzero(np.concatenate(([True], (f[1:] != f[:-1]) | (least[1:] != least[:-1]))))
    return f[first], place[first] - (ends - size)[f[first]], np.diff(np.append(first, len(place))), least[first]


def _shard(bucket: np.ndarray, name: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray, fragments: pa.Array) -> pa.Table:
    """The runs of windows of each fragment that have a smaller id elsewhere. Rows of a key are neighbours.

    Fragments of equal bytes are sorted once, for the least id of all. Where a key has no second one, nothing is sorted: all
    its windows have that id.
    """
    coded = fragments.dictionary_encode()
    code, distinct = coded.indices.to_numpy(), coded.dictionary
    least = np.full(len(distinct), LAST_ID)
    np.minimum.at(least, code, low)
    own = np.empty(len(distinct), np.int64)  # distinct fragments are in the order of their first rows
    own[code] = key
    other = own[1:] != own[:-1]
    alone = np.concatenate(([True], other)) & np.concatenate((other, [True]))
    one, several = np.flatnonzero(alone), np.flatnonzero(~alone)
    of, at, count = one, np.zeros(len(one), np.int64), pc.binary_length(distinct).to_numpy()[one].astype(np.int64) - WINDOW + 1
    by = least[one]
    if len(several):
        f, *found = _least_runs(least[several], distinct.take(pa.array(several)).to_pylist())
        of, at, count, by = (np.concatenate(x) for x in zip((of, at, count, by), (several[f], *found), strict=True))
        order = np.argsort(of, kind="stable")
        of, at, count, by = of[order], at[order], count[order], by[order]
    runs = np.bincount(of, minlength=len(distinct))
    n, start = runs[code], (np.cumsum(runs) - runs)[code]
    row = np.repeat(np.arange(len(code)), n)
    run = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[row]
    hit = by[run] < high[row]
    row, run = row[hit], run[hit]
    return pa.table({"bucket": pa.array(bucket[row].astype(np.int32)), "name": pa.array(name[row]), "key": pa.array(key[row]), "at": pa.array(at[run].astype(np.int32)), "count": pa.array(count[run].astype(np.int32)), "least": pa.array(by[run])})


def new_pairs(name: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a sorted pair differs from the one before."""
    return np.concatenate(([True], (name[1:] != name[:-1]) | (key[1:] != key[:-1])))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on demand, the kept bytes (a cut may fall within a character)."""
    deal = Deal(docs)
    notes, shift = deal.shared_keys(keys_of), deal.shift

    def candidates(group: pa.Table, notes: pa.Table) -> pa.Table:
        known, hot = known_keys(notes), known_keys(notes, "hot")
        names, found, fragments = [], [], []
        for _, ids, texts in unrepeated(group, notes) if len(known) else ():
            data, _, key, doc, begin, end, name = _fragments(texts, known, shift, hot)
            if len(key):
                of = ids[doc]
                order = np.lexsort((key, name))
                first = new_pairs(name[order], key[order])
                place, at = order[first], np.empty(len(name), np.int64)
                at[order] = len(fragments) + np.cumsum(first) - 1
                fragments += [data[a:b] for a, b in zip(begin[place].tolist(), end[place].tolist(), strict=True)]
                names.append(name)
                found.append((key, of, at))
        if not names:
            return pa.table({"bucket": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "name": pa.array([], pa.int64()), "low": pa.array([], pa.int64()), "high": pa.array([], pa.int64()), "fragment": pa.array([], pa.binary())})
        name = np.concatenate(names)
        key, of, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((key, name))
        name, of = name[order], of[order]
        first = np.flatnonzero(new_pairs(name, key[order]))
        bucket = pa.array(np.full(len(first), bucket_of(group), np.int32))
        own = [fragments[i] for i in at[order][first].tolist()]
        return pa.table({"bucket": bucket, "key": signed(key[order][first]), "name": signed(name[first]), "low": np.minimum.reduceat(of, first), "high": np.maximum.reduceat(of, first), "fragment": pa.array(own, pa.binary())})

    rows = deal.rows.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(candidates, "bucket int, key long, name long, low long, high long, fragment binary")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def sort(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            columns = (t[c].to_numpy() for c in ("bucket", "name", "key", "low", "high"))
            yield from _shard(*columns, t["fragment"].combine_chunks()).to_batches()

        for batch in batches:
            at = 0
            while batch.num_rows > at:  # cut between keys once a shard is full
                rest = batch.slice(at)
                if size < SHARD_BYTES:
                    sizes = np.cumsum(np.fromiter((len(f.as_buffer()) for f in rest["fragment"]), np.int64, rest.num_rows))
                    take = min(rest.num_rows, int(np.searchsorted(sizes, SHARD_BYTES - size)) + 1)
                    held.append(rest.slice(0, take))
                    size += int(sizes[take - 1])
                    at += take
                    continue
                key = rest["key"].to_numpy()
                same = int(np.argmax(key != held[-1]["key"][-1].as_py())) if (key != held[-1]["key"][-1].as_py()).any() else len(key)
                if same:
                    held.append(rest.slice(0, same))
                    at += same
                if same < len(key):
                    yield from sort(held)
                    held, size = [], 0
        if held:
            yield from sort(held)

    runs = rows.repartition(deal.partitions, "key").sortWithinPartitions("key").mapInArrow(shards, "bucket int, name long, key long, at int, count int, least long")

    def cut(group: pa.Table, runs: pa.Table) -> pa.Table:
        ids, texts, whole = _ids(group["doc_id"]), binary(group["text"]), copied(group, runs)
        hot = known_keys(runs, "hot")
        runs = runs.filter(pc.is_valid(runs["name"]))
        names = runs["name"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(names)
        names, keys, at, count, least = names[order], *(runs[c].to_numpy()[order] for c in ("key", "at", "count", "least"))
        keys = keys.astype(np.int64).view(np.uint64)
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for own in chunks(texts):
            data, starts, key, doc, begin, _, name = _fragments([texts[i] for i in own], None, shift, hot) if len(names) else (*_join([texts[i] for i in own]), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
            edge = np.zeros(len(data) + 1, np.int32)
            left, right = np.searchsorted(names, name, "left"), np.searchsorted(names, name, "right")
            hit = np.flatnonzero(right > left)
            of = np.repeat(hit, (right - left)[hit])
            row = left[of] + np.arange(len(of)) - np.repeat(np.cumsum((right - left)[hit]) - (right - left)[hit], (right - left)[hit])
            ok = (least[row] < ids[np.array(own)][doc[of]]) & (keys[row] == key[of]) if len(of) else np.zeros(0, bool)
            a = begin[of[ok]] + at[row[ok]]
            np.add.at(edge, a, 1)
            np.add.at(edge, a + count[row[ok]] + WINDOW - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            every = np.frombuffer(data, np.uint8)
            for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                mask = np.ones(b - a, bool) if whole[own[i]] and b - a >= WINDOW else gone[a:b]
                lost = int(mask.sum())
                kept = every[a:b][~mask].tobytes() if lost else texts[own[i]]
                out["n_bytes"].append(b - a)
                out["n_removed"].append(lost)
                out["n_spans"].append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if lost else 0)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if with_text else None)
        columns = {c: pa.array(v, pa.string() if c == "kept_sha256" else pa.binary() if c == "kept" else pa.int64()) for c, v in out.items()}
        return pa.table({"doc_id": group["doc_id"].combine_chunks()} | columns)

    runs = runs.withColumn("mark", F.lit(None).cast("long")).withColumn("hot", F.lit(None).cast("binary"))
    # The bucket's hot keys and copies go with the runs.
    rest = notes.filter("mark IS NOT NULL OR octet_length(hot) > 0").select("bucket", *[F.lit(None).cast(k).alias(c) for c, k in (("name", "long"), ("key", "long"), ("at", "int"), ("count", "int"), ("least", "long"))], "mark", "hot")
    result = deal.rows.groupBy("bucket").cogroup(runs.unionByName(rest).groupBy("bucket")).applyInArrow(cut, RESULT)
    return result if with_text else result.drop("kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
