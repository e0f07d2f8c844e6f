"""Quality classifier: a linear-chain conditional random field labels each line good or bad.

A line's features are its length, word lengths, shares of signs, capitals, digits and stop words, how many of its words and
whether the line itself repeats, and the same shares of the lines before and after it. Forward-backward gives each line the
probability of good; the mean over lines, weighted by their length, is the document's raw quality, and a logistic curve
fitted on the training documents turns its log odds into the score.

Training: at most ``TRAIN_DOCS`` labelled documents (by a hash of the id) whose crc32(doc_id as text) mod 5 is not 0. Lines
first take their document's label; after a first fit, lines of bad documents that look good are set to good, except the
worst of each, and the field is fitted again. Only features reach the driver. Scores never see labels, lang, source or id.

Lines without a word are left out. Null and empty texts have no lines and take the raw quality 0, so their score is the
curve's lowest. A null id is in no fold, so never held out. Without usable labels every score is 0.5. Of several labels of a document the least counts. Repeated rows are
scored alike. Long texts are read whole; one of more than ``BLOCK`` lines is a batch of its own. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import binary, bounded, table
from ._crf import CRF
from .quality_rules import STOP_WORDS

TRAIN_DOCS = 4000
THRESHOLD = 0.3
BLOCK = 2000
STOP = frozenset(w.encode() for w in STOP_WORDS)
_UPPER, _DIGITS, _SIGNS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>~^_=+{}[]\\/@", b"!?"
OWN = 12
FEATURES = OWN + 8 + 1
Model = tuple[CRF, float, float]


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines that have a word, and their lengths."""
    lines = [x for x in text.split(b"\n") if x.strip(b"\x20\x09\x0a\x0b\x0c\x0d")]
    if not lines:
        return np.zeros((0, FEATURES)), np.zeros(0)
    seen, rows = Counter(lines), []
    for x in lines:
        words = x.split()
        n, k = len(x), len(words)
        distinct = len(set(words)) / k
        size = min(n, 2000)
        stop = sum(w in STOP for w in words) / k
        rows.append((
            1.0, math.log1p(size) / 8, min((n - k + 1) / k, 30) / 10, (n - len(x.translate(None, _SIGNS))) / n * 4, (n - len(x.translate(None, _UPPER))) / n,
            (n - len(x.translate(None, _DIGITS))) / n, (n - len(x.translate(None, _MARKS))) / n * 4, stop, distinct, float(k >= 8 and distinct < 0.5), float(seen[x] > 1), float(x.endswith(b".")),
        ))
    own = np.array(rows)
    near = own[:, [3, 4, 6, 8]]
    before = np.vstack((np.zeros((1, 4)), near[:-1]))
    after = np.vstack((near[1:], np.zeros((1, 4))))
    share = np.full((len(own), 1), np.log1p(len(own)) / 8)
    return np.hstack((own, before, after, share)), np.array([len(x) for x in lines], float)


def raw_quality(model: CRF, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The length-weighted mean probability of good of each document (0 without lines)."""
    out = np.zeros(len(documents))
    order = sorted((i for i, (x, _) in enumerate(documents) if len(x)), key=lambda i: len(documents[i][0]))
    at = 0
    while at < len(order):
        if len(documents[order[at]][0]) > BLOCK:
            x, w = documents[order[at]]
            p = model.marginals(x[None], np.array([len(x)]))[0, :, 1]
            out[order[at]] = (p * w).sum() / w.sum()
            at += 1
            continue
        end = at
        while end < len(order) and end - at < 256 and len(documents[order[end]][0]) <= min(BLOCK, 2 * len(documents[order[at]][0]) + 4):
            end += 1
        own = order[at:end]
        size = np.array([len(documents[i][0]) for i in own])
        x = np.zeros((len(own), size.max(), FEATURES))
        for k, i in enumerate(own):
            x[k, : size[k]] = documents[i][0]
        p = model.marginals(x, size)[:, :, 1]
        for k, i in enumerate(own):
            w = documents[i][1]
            out[i] = (p[k, : size[k]] * w).sum() / w.sum()
        at = end
    return out


def _odds(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def fit(documents: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """The field and the curve from documents as (features, lengths, label)."""
    documents = [d for d in documents if len(d[0])]
    field = CRF(FEATURES, 2)
    if len({y for *_, y in documents}) < 2:
        return field, 0.0, 0.0
    labels = [np.full(len(x), y) for x, _, y in documents]
    field.fit([(x, y) for (x, _, _), y in zip(documents, labels, strict=True)], rounds=80)
    for i, (x, _, y) in enumerate(documents):
        if y == 0:
            good = field.marginals(x[None], np.array([len(x)]))[0, :, 1]
            labels[i] = (good > 0.5).astype(int)
            labels[i][good.argmin()] = 0
    field = CRF(FEATURES, 2).fit([(x, y) for (x, _, _), y in zip(documents, labels, strict=True)], rounds=120)
    odds, y = _odds(raw_quality(field, [d[:2] for d in documents])), np.array([d[2] for d in documents], float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one variable, slightly penalised
        p = 1 / (1 + np.exp(-(a * odds + b)))
        r, s = y - p, p * (1 - p) + 1e-9
        h = np.array([[(s * odds * odds).sum() + 1, (s * odds).sum()], [(s * odds).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(r * odds).sum() - (a - 1), r.sum()]))
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return field, a, b


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """Features of at most ``most`` labelled documents outside the held-out fold."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    chosen = usable.filter(fold != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", F.col("y").cast("long"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features(t) for t in binary(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist() for x, _ in found], pa.list_(pa.float64())), pa.array([w.tolist() for _, w in found], pa.list_(pa.float64())), batch.column(1)], names=["x", "w", "y"])

    return bounded(rows).mapInArrow(work, "x array<double>, w array<double>, y long")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels).toArrow()
    own = [(x.values.to_numpy().reshape(-1, FEATURES), w.values.to_numpy(), y.as_py()) for x, w, y in zip(rows["x"], rows["w"], rows["y"], strict=True)]
    own.sort(key=lambda d: (len(d[1]), d[0].tobytes(), d[2]))  # the order of rows differs between runs
    return fit(own)


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    field, a, b = model
    odds = _odds(raw_quality(field, [line_features(t) for t in texts]))
    return 1 / (1 + np.exp(-(a * odds + b)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted; one row a document."""
    own_model = model  # some hundred numbers, sent with the function

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), binary(batch.column(1))
            every, at = [], 0
            while at < len(texts):  # blocks of bounded size
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 2 << 20):
                    size += len(texts[end])
                    end += 1
                every.append(scores(own_model, texts[at:end]))
                at = end
            own = np.concatenate(every) if every else np.zeros(0)
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(own), pa.array((own >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL: dict[str, str] = {}
