"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian whose covariance is shrunk towards the pooled one and then towards a multiple of the identity.
Fitting needs only counts, sums and sums of products per class: one pass over all labelled rows, no sample. A score is the
logistic of the difference of log densities plus log priors, from Mahalanobis distances by Cholesky factors that are
inverted once and reused.

Defined cases: null text counts as empty; empty texts get a score like any other; a row without label, or with a label
other than 0 and 1, is not learned from; if the labels do not hold both classes (or fewer than two rows of either), every
score is the share of label 1, or 0.5 without labels; null id: not held out, never learned from; columns of the input that
are named like a result are left out of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize, prepare, runs, utf8_views
from .textbytes import ASCII_LOWER, RUN, segment_sums, word_hashes, word_spans

THRESHOLD = 0.3
SHRINK_POOLED = 0.1
SHRINK_IDENTITY = 0.02

# byte classes: lower, upper, digit, space, line end, sentence mark, other mark, UTF-8 lead, UTF-8 continuation, control
_CLASS = np.full(256, 9, np.uint8)
_CLASS[0x21:0x7F] = 6
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[[0x0A, 0x0D]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[0xC0:] = 7
_CLASS[0x80:0xC0] = 8
N_CLASSES = 10

FEATURES = (
    "log_words", "log_bytes_word", "word_len_sd", "distinct_words", "repeat_next", "repeat_second", "lower", "upper", "digit", "line",
    "sentence", "symbol", "non_ascii", "symbol_word", "upper_word", "top_word",
)


CHARS, WORDS, FLOOR = 50.0, 10.0, 0.005


def _share(part: np.ndarray, whole: np.ndarray, typical: float, weight: float) -> np.ndarray:
    """Log odds of a share. A short text has `weight` units at the typical share added, so that it is judged by what it
    shows and not by its length; FLOOR keeps long texts without any such unit from standing apart."""
    p = (part + weight * typical) / (whole + weight)
    return np.log((p + FLOOR) / (1 - p + FLOOR))


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES a text."""
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)
    kind = _CLASS[raw]
    counts = np.stack([segment_sums(kind == k, off) for k in range(N_CLASSES)]).astype(np.float64)
    chars = size - counts[8]
    starts, ends, first = word_spans(raw, off)
    words = np.diff(first).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    mean = segment_sums(length, first) / np.maximum(words, 1)
    square = segment_sums(length * length, first) / np.maximum(words, 1)
    h = word_hashes(ASCII_LOWER[raw], starts, ends)
    text = np.repeat(np.arange(n), np.diff(first))
    same = np.zeros(len(h), bool)
    second = np.zeros(len(h), bool)
    if len(h) > 2:
        same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        second[2:] = (h[2:] == h[:-2]) & (text[2:] == text[:-2])
    order = np.lexsort((h, text))
    hs, ts = h[order], text[order]
    new = np.ones(len(h), bool)
    if len(h) > 1:
        new[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
    distinct = segment_sums(new, first).astype(np.float64)
    top = np.zeros(n)
    if len(h):
        places = np.flatnonzero(new)
        often = np.diff(np.append(places, len(h)))
        np.maximum.at(top, ts[places], often)
    mark = np.isin(kind[ends - 1], (6,)) if len(ends) else np.zeros(0, bool)
    ending = segment_sums(mark, first).astype(np.float64)
    caps = (kind[starts] == 1) & (kind[np.minimum(starts + 1, ends - 1)] == 1) & (ends - starts > 1) if len(starts) else np.zeros(0, bool)
    capital = segment_sums(caps, first).astype(np.float64)
    per_word = (size + WORDS * 6.0) / (words + WORDS)
    spread = (np.maximum(square - mean * mean, 0) * words + WORDS * 10.0) / (words + WORDS)
    # fixed values: shares that are typical of prose in any language with spaces
    return np.column_stack([
        np.log1p(words), np.log(per_word), 0.5 * np.log(spread), np.log((distinct + WORDS) / (words + WORDS)),
        _share(segment_sums(same, first), words, 0.01, WORDS), _share(segment_sums(second, first), words, 0.01, WORDS),
        _share(counts[0], chars, 0.78, CHARS), _share(counts[1], chars, 0.02, CHARS), _share(counts[2], chars, 0.005, CHARS),
        _share(counts[4], chars, 0.005, CHARS), _share(counts[5], chars, 0.03, CHARS), _share(counts[6], chars, 0.002, CHARS),
        _share(counts[7], chars, 0.03, CHARS), _share(ending, words, 0.005, WORDS), _share(capital, words, 0.005, WORDS),
        _share(np.maximum(top - 1, 0), words, 0.05, WORDS),
    ])


def batch_statistics(column: pa.Array) -> np.ndarray:
    off, raw = utf8_views(column)
    parts = [statistics(raw[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in runs(off, RUN)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    """Per class: mean, inverse Cholesky factor, log determinant and log prior; or a constant share if not both are known."""

    means: np.ndarray | None = None
    inverses: np.ndarray | None = None
    logdets: np.ndarray | None = None
    log_priors: np.ndarray | None = None
    share: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        logs = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.inverses[k].T
            logs.append(self.log_priors[k] - 0.5 * (self.logdets[k] + np.einsum("ij,ij->i", z, z)))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = SHRINK_POOLED, identity: float = SHRINK_IDENTITY) -> Model:
    """moments: class to (count, sums, sums of products)."""
    n = np.array([moments[k][0] if k in moments else 0.0 for k in (0, 1)])
    if n.min() < 2:
        return Model(share=float(n[1] / n.sum()) if n.sum() else 0.5)
    means = np.stack([moments[k][1] / n[k] for k in (0, 1)])
    own = np.stack([moments[k][2] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)])
    shared = (n[:, None, None] * own).sum(0) / n.sum()
    p = means.shape[1]
    inverses, logdets = [], []
    for k in (0, 1):
        cov = (1 - pooled) * own[k] + pooled * shared
        cov = (1 - identity) * cov + (identity * max(np.trace(cov) / p, 1e-9)) * np.eye(p)
        factor = np.linalg.cholesky(cov)
        inverses.append(np.linalg.inv(factor))
        logdets.append(2 * np.log(np.diag(factor)).sum())
    return Model(means, np.stack(inverses), np.array(logdets), np.log(n / n.sum()), float(n[1] / n.sum()))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, held_out, x (FEATURES as an array), stored in the shared folder: a few percent of the text's size."""
    source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch_statistics(batch.column("text"))
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), values], ["doc_id", "held_out", "x"])

    return materialize(source.mapInArrow(frugal(work), f"doc_id {kind}, held_out boolean, x array<double>"), "quality-features")


def learn(feats: DataFrame, labels: DataFrame, label_id: str = "doc_id", label: str = "quality") -> Model:
    """Moments of all labelled rows that are not held out, summed on the executors; 2 (p^2 + p + 1) numbers come back."""
    p = len(FEATURES)
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    rows = feats.where("not held_out").join(known, "doc_id").select("y", "x")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: [0.0, np.zeros(p), np.zeros((p, p))] for k in (0, 1)}
        for batch in batches:
            y = np.asarray(batch.column("y"))
            x = np.asarray(batch.column("x").flatten()).reshape(-1, p)
            for k in (0, 1):
                own = x[y == k]
                sums[k][0] += len(own)
                sums[k][1] += own.sum(0)
                sums[k][2] += own.T @ own
        for k, (n, s, ss) in sums.items():
            flat = np.concatenate([[n], s, ss.ravel()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["y", "i", "v"]
            )

    total = rows.mapInArrow(frugal(work), "y int, i int, v double").groupBy("y", "i").agg(F.sum(F.col("v").cast("decimal(38,12)")).cast("double").alias("v")).collect()  # exact, so in any order
    flat = {k: np.zeros(1 + p + p * p) for k in (0, 1)}
    for r in total:
        flat[r["y"]][r["i"]] = r["v"]
    return fit({k: (v[0], v[1 : 1 + p], v[1 + p :].reshape(p, p)) for k, v in flat.items() if v[0]})


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold)."""
    prepare(docs.sparkSession)
    feats = features(docs, id_col, text)
    model = learn(feats, labels)
    kind = feats.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.asarray(batch.column("x").flatten()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return feats.mapInArrow(frugal(work), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of `threshold` or more, all columns as they were. Texts are not shuffled."""
    prepare(docs.sparkSession)
    model = learn(features(docs, id_col, text), labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch_statistics(batch.column(text))) >= threshold))

    return docs.mapInArrow(frugal(work), docs.schema)
