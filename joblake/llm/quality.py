"""Operator 6: document quality from a linear-chain conditional random field
over lines.

Every line is good or bad. Its own features (length, symbols, digits, repeated
words, ...) and those of the lines before and after it give the line's score;
two weights reward staying good and staying bad from one line to the next.
Forward-backward gives each line's marginal probability of being good, and the
mean of the marginals, weighted by line length, is the document's quality. A
logistic curve over that mean turns it into the probability of label 1.

The field is fitted on a documented, bounded sample: the ``max_docs`` labels with
the smallest hash of their document's id, and of a document with more than
``run_lines`` lines one run of so many, its place by a hash of the text. So the
sample has at most ``max_docs * run_lines`` lines, and no document is left out for
its size. Only the labels are sampled before the join, so the join broadcasts at
most ``max_docs`` rows and no text is moved. A document's label is the label of
all its lines. Scoring covers every line of every document.

Lines are ``text`` split at newlines. Null and empty texts have one empty line
and are scored like any other. Without both labels in the sample every score
is the share of label 1 (0.5 with no label at all). Repeated rows are scored
alike; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from joblake.llm.hashing import chunks, hash_words, mix

_OWN = 14
N_FEATURES = 3 * _OWN + 3
_CLASS = np.zeros((256,), np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 usual punctuation, 5 other symbol, 6 not ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 5
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4


def line_features(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(features per line, length of each line, line offsets per document)``."""
    joined = b"\n".join(docs) + b"\n"
    a = np.frombuffer(joined, np.uint8)
    line_end = np.flatnonzero(a == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    n = len(line_end)
    doc_end = np.cumsum([len(d) + 1 for d in docs])
    off = np.concatenate(([0], np.searchsorted(line_end, doc_end - 1) + 1))
    size = (line_end - line_start).astype(float)
    kind = _CLASS[a]

    def per_line(mask):
        c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (c[line_end] - c[line_start]).astype(float)

    lower, upper, digit, usual, odd, high = (per_line(kind == k) for k in range(1, 7))
    start, end, h = hash_words(joined)
    line = np.searchsorted(line_end, start)
    words = np.bincount(line, minlength=n).astype(float)

    def of_words(mask):
        return np.bincount(line, weights=mask, minlength=n)

    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    with np.errstate(over="ignore"):
        _, first = np.unique(h ^ mix(line.astype(np.uint64)), return_index=True)
    distinct = np.zeros(len(h), bool)
    distinct[first] = True
    last = a[np.maximum(line_end - 1, 0)]
    chars, many = np.maximum(size, 1.0), np.maximum(words, 1.0)
    own = np.stack([
        np.log1p(words) / 5, np.minimum((size - words) / many / 10, 3.0), odd / chars * 5, digit / chars * 5,
        upper / np.maximum(lower + upper, 1.0) * 2, high / chars, np.minimum(usual / many, 2.0), of_words(again) / many,
        of_words(end - start == 1) / many, of_words(end - start <= 3) / many,
        ((last == 46) | (last == 33) | (last == 63)) * (size > 0) * 1.0, (size == 0) * 1.0,
        of_words(kind[start] == 2) / many, of_words(distinct) / many], axis=1) if n else np.zeros((0, _OWN))
    edge_first, edge_last = np.zeros(n), np.zeros(n)
    edge_first[off[:-1]], edge_last[off[1:] - 1] = 1, 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[edge_first == 1] = 0
    after[edge_last == 1] = 0
    return np.concatenate([np.ones((n, 1)), own, before, after, edge_first[:, None], edge_last[:, None]], axis=1), size, off


def _softplus(x):
    return np.logaddexp(0.0, x)


def forward_backward(u: np.ndarray, off: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of good: ``(forward with the line's own score, backward, after)``
    per line; ``stay`` rewards bad-bad and good-good. All documents advance
    together, a line at a time, the longest ones last."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    start, n = off[:-1][order], n[order]
    a, b = u.copy(), np.zeros_like(u)

    def step(x):  # log odds of the next line, from the log odds of this one
        return np.logaddexp(stay[1] + x, 0.0) - np.logaddexp(x, stay[0])

    live = len(n)
    for t in range(1, int(n[0]) if len(n) else 0):
        while live and n[live - 1] <= t:
            live -= 1
        at = start[:live] + t
        a[at] = u[at] + step(a[at - 1])
    live = len(n)
    for t in range(1, int(n[0]) if len(n) else 0):
        while live and n[live - 1] <= t:
            live -= 1
        at = start[:live] + n[:live] - 1 - t
        b[at] = step(u[at + 1] + b[at + 1])
    return a, b, a + b


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class LineField:
    weights: np.ndarray
    stay: np.ndarray
    curve: tuple[float, float]

    def means(self, x: np.ndarray, size: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean marginal of good lines per document, weighted by length."""
        p = _sigmoid(forward_backward(x @ self.weights, off, self.stay)[2])
        w = size + 1.0
        return np.add.reduceat(p * w, off[:-1]) / np.add.reduceat(w, off[:-1])

    def score(self, docs: list[bytes]) -> np.ndarray:
        m = np.clip(self.means(*line_features(docs)), 1e-6, 1 - 1e-6)
        return _sigmoid(self.curve[0] * np.log(m / (1 - m)) + self.curve[1])


def fit_field(x: np.ndarray, size: np.ndarray, off: np.ndarray, label: np.ndarray, rounds: int = 150, l2: float = 1e-3) -> LineField:
    """Maximum likelihood of the line labels by Adam, then the curve by Newton
    steps. ``stay`` is kept at 2 at most: labels of documents never change from
    line to line, and would drive it up without bound."""
    y = np.repeat(label, np.diff(off)).astype(float)
    share = min(max(float(label.mean()) if len(label) else 0.5, 0.0), 1.0)
    if not len(label) or share in (0.0, 1.0):
        odds = np.clip(np.log(max(share, 1e-3) / max(1 - share, 1e-3)), -7, 7)
        return LineField(np.zeros(N_FEATURES), np.zeros(2), (0.0, float(odds)))
    # a document counts as much as any other, and a line by its length
    w = (size + 20.0) / np.repeat(np.add.reduceat(size + 20.0, off[:-1]), np.diff(off))
    inner = np.ones(len(y), bool)
    inner[off[1:] - 1] = False
    at = np.flatnonzero(inner)
    theta, m1, m2 = np.zeros(N_FEATURES + 2), 0.0, 0.0
    for r in range(1, rounds + 1):
        wts, stay = theta[:-2], theta[-2:]
        u = x @ wts
        a, b, both = forward_backward(u, off, stay)
        g = np.empty_like(theta)
        g[:-2] = x.T @ (w * (y - _sigmoid(both))) / len(label) - l2 * wts
        fore, back = a[at], u[at + 1] + b[at + 1]
        z = np.logaddexp(np.logaddexp(stay[1] + fore + back, stay[0]), np.logaddexp(fore, back))
        pw = w[at] / len(label)
        g[-2] = (pw * ((1 - y[at]) - np.exp(stay[0] - z))).sum() - l2 * stay[0]
        g[-1] = (pw * (y[at] - np.exp(stay[1] + fore + back - z))).sum() - l2 * stay[1]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + 0.15 * (m1 / (1 - 0.9 ** r)) / (np.sqrt(m2 / (1 - 0.99 ** r)) + 1e-8)
        theta[-2:] = np.clip(theta[-2:], 0.0, 2.0)
    field = LineField(theta[:-2], theta[-2:], (1.0, 0.0))
    m = np.clip(field.means(x, size, off), 1e-6, 1 - 1e-6)
    f = np.stack([np.log(m / (1 - m)), np.ones(len(m))], axis=1)
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(f @ c)
        c = c + np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 0.05 * np.eye(2), f.T @ (label - p) - 0.05 * (c - [1.0, 0.0]))
        c[0] = max(c[0], 0.05)
    field.curve = (float(c[0]), float(c[1]))
    return field


def fit_quality(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, run_lines: int = 200) -> LineField:
    """``docs(doc_id, text)`` and ``labels(doc_id, label)`` with label 0 or 1."""

    def features(it):
        for batch in it:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            at = 0
            for part in chunks(batch.column(0).to_pylist()):
                x, size, off = line_features(part)
                for i in range(len(part)):
                    lines = int(off[i + 1] - off[i])
                    first = off[i] + (zlib.crc32(part[i]) % (lines - run_lines + 1) if lines > run_lines else 0)
                    s = slice(first, first + min(lines, run_lines))
                    yield pa.RecordBatch.from_arrays([pa.array([x[s].astype(np.float32).tobytes()]), pa.array([size[s].tobytes()]), pa.array([int(label[at + i])], pa.int32())], names=["x", "size", "label"])
                at += len(part)

    chosen = (labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_docs))
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    rows = sample.mapInArrow(features, "x binary, size binary, label int").toPandas()
    if not len(rows):
        return fit_field(np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(1, int), np.zeros(0))
    size = [np.frombuffer(b) for b in rows["size"]]
    x = np.concatenate([np.frombuffer(b, np.float32) for b in rows["x"]]).reshape(-1, N_FEATURES).astype(float)
    return fit_field(x, np.concatenate(size), np.concatenate(([0], np.cumsum([len(s) for s in size]))), rows["label"].to_numpy(float))


def score_quality(docs: DataFrame, model: LineField, keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` with ``score``, the probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(*keep, F.col("text").alias("__text"))
    kept = narrow.drop("__text")
    names = kept.columns

    def run(it):
        m = held.value
        for batch in it:
            at = 0
            for part in chunks(batch.column(len(names)).to_pylist()):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(part)) for i in range(len(names))), pa.array(m.score(part))], names=[*names, "score"])
                at += len(part)

    return narrow.mapInArrow(run, kept.schema.add("score", "double"))
