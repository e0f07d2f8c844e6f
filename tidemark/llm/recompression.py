"""Substring dedup by recompression: words under 13-word windows that an earlier document has too.

Words get global names, 64-bit hashes of their bytes, and rounds rename on: first a run of one word becomes one symbol
(word, count), then in each round symbols fall into two classes by a bit of their name and every neighbouring pair (first
class, second class) becomes a symbol named after both. A name depends on content alone, so all executors give equal
substrings the same symbols without a dictionary to exchange, except near their ends, where a neighbour outside decides.
Each symbol therefore carries its *support*, the words on which it and its name depend. A symbol whose support lies inside
a window is in every copy of that window: these are the consistent interior symbols. The key of a window is the longest of
them (ties: greatest name); windows without any, such as the inside of a long run, take a word's name.

Symbols that documents of different ids share reveal candidates (see ``_repeats``); candidates are verified window by
window, by 128 bits that are computed anew from the words: two hashes of the window, each over word hashes of a seed of its
own. Every step of them mixes, none is linear, so no pattern of bytes or words makes different windows agree; by chance,
1e12 different windows have a pair that does once in 1e14 corpora.

Words are runs of other than ASCII white space, unchanged. Null and short texts have no windows and lose nothing; empty
texts keep the empty string. Long texts are read whole, in segments that overlap by a window.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import binary, mix, table
from ._repeats import CHUNK_BYTES, Deal, _ids, bucket_of, chunks, copied, known_keys, member, signed, unrepeated

WINDOW = 13
ROUNDS = 6
SPAN = 10  # words in a symbol at most: longer ones have no support within a window
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


#: Two seeds: names of words, and a second name of each for the verification.
SEEDS = (_U(0x8CB92BA72F3D8DD7), _U(0x2545F4914F6CDD1D))
LONG_WORD = 64


def hash_words(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word. Eight bytes at a time are mixed in, so no step is linear; words of more than
    ``LONG_WORD`` bytes are hashed one by one."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the number that begins at each place
    size = end - start
    first, second = (mix(size.astype(np.uint64) ^ s) for s in SEEDS)
    own = np.flatnonzero(size <= LONG_WORD)
    at = start[own]
    while len(own):
        rest = end[own] - at
        lane = words[at] & np.where(rest >= 8, ~_U(0), (_U(1) << (_U(8) * np.minimum(rest, 7).astype(np.uint64))) - _U(1))
        first[own], second[own] = mix(first[own] ^ lane), mix((second[own] + lane) * _U(0x9FB21C651E98DF25))
        more = rest > 8
        own, at = own[more], at[more] + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        word = data[start[i] : end[i]]
        first[i], second[i] = xxhash.xxh64_intdigest(word, int(SEEDS[0])), xxhash.xxh64_intdigest(word, int(SEEDS[1]))
    return first, second


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both names of the words of all texts, and the text of each word. Works through the texts in pieces of a chunk."""
    names, others, docs, part, size = [], [], [], [], 0

    def flush() -> None:
        joined = b" ".join([b for _, b in part]) + b" " * 8
        space = _SPACE[np.frombuffer(joined, np.uint8)]
        inside = ~space
        start = np.flatnonzero(inside & np.concatenate(([True], space[:-1])))
        end = np.flatnonzero(space & np.concatenate(([False], inside[:-1])))
        for own, found in zip((names, others), hash_words(joined, start, end), strict=True):
            own.append(found)
        at = np.cumsum([len(b) + 1 for _, b in part])
        docs.append(np.array([d for d, _ in part], np.int64)[np.searchsorted(at, start, "right")])

    for d, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = min(len(text), at + CHUNK_BYTES)
            while stop < len(text) and not _SPACE[text[stop]]:  # a piece ends between words
                stop += 1
            part.append((d, text[at:stop]))
            size += stop - at
            at = stop
            if size >= CHUNK_BYTES:
                flush()
                part, size = [], 0
    if part:
        flush()
    return tuple(np.concatenate(x) for x in (names, others, docs)) if names else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def window_hash(name: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``WINDOW`` names from each start: hashes of 2, 4 and 8 names, joined as 8 + 4 + 1."""
    two = mix(name[:-1] * _U(0xA24BAED4963EE407) ^ name[1:])
    four = mix(two[:-2] * _U(0x9FB21C651E98DF25) ^ two[2:])
    eight = mix(four[:-4] * _U(0xD6E8FEB86659FD93) ^ four[4:])
    return mix(mix(eight[start] * _U(0xCA5A826395121157) ^ four[start + 8]) * _U(0xA24BAED4963EE407) ^ name[start + 12])


def window_keys(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each window, and the windows' first words."""
    n = len(name)
    if n < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best = np.zeros((WINDOW + 1, n), np.uint64)  # by length of the support and its first word
    best[1] = name >> _U(4)
    fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
    # Runs of one word.
    first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | fresh[1:])))
    count = np.diff(np.append(first, n))
    x = np.where(count > 1, mix(name[first] + count.astype(np.uint64) * _U(0xA24BAED4963EE407)), name[first])
    s, e = first, first + count
    lo, hi = s - 1, e + 1
    fresh = fresh[first]
    for t in range(1, ROUNDS + 1):
        kind = (mix(x ^ _U(t * 0x632BE59BD9B4E019 % 2**64)) >> _U(63)).astype(bool)
        pair = np.zeros(len(x), bool)  # with the next symbol
        pair[:-1] = ~kind[:-1] & kind[1:] & ~fresh[1:] & (e[1:] - s[:-1] <= SPAN)
        second = np.concatenate(([False], pair[:-1]))
        # What stays alone depends on the neighbour that could have taken it.
        alone = ~pair & ~second
        low = np.where(alone & kind, np.minimum(lo, np.concatenate((lo[:1] - 1, lo[:-1]))), lo)
        high = np.where(alone & ~kind, np.maximum(hi, np.concatenate((hi[1:], hi[-1:] + 1))), hi)
        at = np.flatnonzero(pair)
        low[at], high[at] = np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
        x, e = x.copy(), e.copy()
        x[at] = mix(x[at] * _U(0x9FB21C651E98DF25) + (x[at + 1] ^ _U(t)))
        e[at] = e[at + 1]
        size = high[at] - low[at]
        good = (size <= WINDOW) & (low[at] >= 0)
        g = at[good]
        np.maximum.at(best, (size[good], low[g]), ((e[g] - s[g]).astype(np.uint64) << _U(60)) | (x[g] >> _U(4)))
        stay = ~second
        x, s, e, lo, hi, fresh = x[stay], s[stay], e[stay], low[stay], high[stay], fresh[stay]
    key = best[1]
    for size in range(2, WINDOW + 1):  # the best symbol within [i, i + size)
        wider = np.maximum(key[:-1], key[1:])
        key = np.maximum(wider, best[size][: len(wider)])
    start = np.flatnonzero(doc[WINDOW - 1 :] == doc[: n - WINDOW + 1])
    return mix(key[start]), start


def _segments(names: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Long stretches of words, cut with an overlap, so that arrays stay small."""
    step = CHUNK_BYTES // 2
    for at in range(0, max(1, len(names[0]) - WINDOW + 1), step):
        yield at, *(x[at : at + step + WINDOW - 1] for x in names)


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for _, name, _, doc in _segments(word_names(texts)):
        key, start = window_keys(name, doc)
        found.append((key, doc[start]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _named(texts: list[bytes], known: np.ndarray | None = None, shift: np.uint64 = _U(0)):
    """(window hash, second hash, text, first word) of all windows, or of those under ``known`` keys."""
    found = []
    for at, name, other, doc in _segments(word_names(texts)):
        key, start = window_keys(name, doc)
        if known is not None:
            start = start[member(key >> shift, known) >= 0]
        found.append((window_hash(name, start), window_hash(other, start), doc[start], start + at) if len(start) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), doc[:0], start))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, on demand, the kept text; one row a document."""
    deal = Deal(docs)
    notes, shift = deal.shared_keys(keys_of), np.uint64(deal.shift)

    def candidates(group: pa.Table, notes: pa.Table) -> pa.Table:
        known = known_keys(notes)
        found = []
        for _, ids, texts in unrepeated(group, notes) if len(known) else ():
            name, tag, doc, _ = _named(texts, known, shift)
            found.append((name, tag, ids[doc]))
        if found:
            name, tag, of = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((tag, name))
            name, tag, of = name[order], tag[order], of[order]
        if not found or not len(name):
            return pa.table({"bucket": pa.array([], pa.int32()), "name": pa.array([], pa.int64()), "tag": pa.array([], pa.int64()), "low": pa.array([], pa.int64()), "high": pa.array([], pa.int64())})
        first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (tag[1:] != tag[:-1]))))
        bucket = pa.array(np.full(len(first), bucket_of(group), np.int32))
        return pa.table({"bucket": bucket, "name": signed(name[first]), "tag": signed(tag[first]), "low": np.minimum.reduceat(of, first), "high": np.maximum.reduceat(of, first)})

    rows = deal.rows.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(candidates, "bucket int, name long, tag long, low long, high long")
    # Rows of a window: one a bucket at most.
    least = F.min("low").over(Window.partitionBy("name", "tag"))
    earlier = rows.select("bucket", "name", "tag", "high", least.alias("least")).filter("least < high").select("bucket", "name", "tag", "least", F.lit(None).cast("long").alias("mark"))
    copies = deal.copies.select("bucket", *[F.lit(None).cast(k).alias(c) for c, k in (("name", "long"), ("tag", "long"), ("least", "long"))], "mark")

    def cut(group: pa.Table, windows: pa.Table) -> pa.Table:
        ids, texts, whole = _ids(group["doc_id"]), binary(group["text"]), copied(group, windows)
        windows = windows.filter(pc.is_null(windows["mark"]))
        name, tag, least = (windows[c].to_numpy() for c in ("name", "tag", "least"))
        order = np.argsort(name.view(np.uint64))
        name, tag, least = name[order].view(np.uint64), tag[order].view(np.uint64), least[order]
        out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "text")}
        for own in chunks(texts):
            split = [texts[i].split() for i in own]
            ends = np.cumsum([len(w) for w in split])
            gone = np.zeros(int(ends[-1]) + 1, np.int64)
            if len(name):
                of, own_tag, doc, start = _named([texts[i] for i in own])
                left, right = np.searchsorted(name, of, "left"), np.searchsorted(name, of, "right")
                mine = ids[np.array(own)][doc]
                ok = (right > left) & False
                for step in range(int((right - left).max(initial=0))):  # names that second hashes tell apart are rare
                    at = np.minimum(left + step, len(name) - 1)
                    ok |= (left + step < right) & (tag[at] == own_tag) & (least[at] < mine)
                np.add.at(gone, start[ok], 1)
                np.add.at(gone, start[ok] + WINDOW, -1)
            gone = np.cumsum(gone)[:-1] > 0
            for i, w, end in zip(own, split, ends.tolist(), strict=True):
                mask = np.ones(len(w), bool) if whole[i] and len(w) >= WINDOW else gone[end - len(w) : end]
                lost = int(mask.sum())
                kept = b" ".join(compress(w, (~mask).tolist()) if lost else w)
                out["n_words"].append(len(w))
                out["n_removed"].append(lost)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["text"].append(kept.decode() if with_text else None)
        return pa.table({"doc_id": group["doc_id"].combine_chunks(), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "text": pa.array(out["text"], pa.string())})

    result = deal.rows.groupBy("bucket").cogroup(earlier.union(copies).groupBy("bucket")).applyInArrow(cut, RESULT)
    return result if with_text else result.drop("text")


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op6_recompression": op6_recompression}
ORACLE_SQL = {
    "op6_recompression": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT rid, doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM d WHERE len(words) >= 13),
g AS (SELECT rid, doc_id, i, array_to_string(words[i : i + 12], ' ') AS win FROM w),
f AS (SELECT win, min(doc_id) AS least FROM g GROUP BY win),
hit AS (SELECT rid, i FROM g JOIN f USING (win) WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
cov AS (SELECT DISTINCT rid, i + k AS i FROM hit, range(0, 13) AS r(k)),
gone AS (SELECT rid, list(i) AS gone FROM cov GROUP BY rid),
flat AS (SELECT rid, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM flat ANTI JOIN cov USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)"""
}
