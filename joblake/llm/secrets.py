"""Operator 9: secret scans with character Markov models.

Base rules find the secrets that have a known form (three kinds, below). Every
other token, a run of at least ``MIN_TOKEN`` of ``[A-Za-z0-9+/_=-]``, is read
by two first-order character Markov models, one of random strings and one of
ordinary identifiers; when the log-likelihood ratio of the two is at least
``min_ratio`` (and ``min_mean`` per character), the token is a span of kind
``markov``.

The models are trained from labelled samples: random strings are the values
that the base rules find, ordinary identifiers all other tokens, and to both
come the labelled strings that the caller hands in. Character
pairs are counted over all documents in every task and summed by Spark; the
result is one table of fixed size. Without a single random sample no span is
added.

Positions are code points, end exclusive; a span of the base rules is the whole
match. Added spans that touch a base span are left out. Null text is empty and
has no spans. Repeated rows are answered alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from joblake.llm.hashing import chunks

# The base rules (kind, pattern, group whose length counts, least length).
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")

MIN_TOKEN = 16
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN)
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_N = len(_ALPHABET) + 1
_CODE = np.zeros(256, np.int64)  # 0: outside a token
_CODE[list(_ALPHABET)] = np.arange(1, _N)
# Classes of characters: upper, lower, digits, the others. A pair seldom seen falls back on its classes.
_CLASS = np.repeat(np.arange(4), [26, 26, 10, len(_ALPHABET) - 62])
_PRIOR = 8.0
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def base_matches(text: str, lower: bytes, long_run: bool) -> Iterator[tuple[int, int, int, str]]:
    """``(start, kind number, end, value)``. ``lower`` and ``long_run`` (whether
    a run of token characters is long enough) only say which rules can match."""
    if any(w in lower for w in _ASSIGN_WORDS):
        for m in BASE[0][1].finditer(text):
            if len(m[2]) >= BASE[0][3]:
                yield m.start(), 0, m.end(), m[2]
    if long_run:
        if "AKIA" in text:
            for m in BASE[1][1].finditer(text):
                if m.end() - m.start() >= BASE[1][3]:
                    yield m.start(), 1, m.end(), m[0]
        for m in _LONG_HEX.finditer(text):  # a maximal run of hex digits is one match of the rule
            yield m.start(), 2, m.end(), m[0]


def _scan(part: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int, str]], str]]:
    """``(index, base matches, text)`` of the texts of a chunk that any rule or
    the models can say something about."""
    joined = b"\n".join(part) + b"\n"
    code = _CODE[np.frombuffer(joined, np.uint8)] > 0
    edge = np.flatnonzero(code[1:] != code[:-1]) + 1
    if code[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(b) + 1 for b in part])
    runs = np.zeros(len(part), bool)
    runs[np.searchsorted(ends, start[end - start >= MIN_TOKEN], side="right")] = True
    for i, b in enumerate(part):
        lower = b.translate(_LOWER)
        if runs[i] or any(w in lower for w in _ASSIGN_WORDS):
            text = b.decode("utf-8", "surrogatepass")
            yield i, sorted(base_matches(text, lower, bool(runs[i]))), text


def _pairs(data: bytes) -> np.ndarray:
    c = _CODE[np.frombuffer(data, np.uint8)]
    return np.bincount((c[:-1] * _N + c[1:])[c[1:] > 0], minlength=_N * _N)


@dataclass
class MarkovModels:
    """``ratio[a, b]``: log odds, random to ordinary, of ``b`` after ``a``."""

    ratio: np.ndarray | None

    def of(self, token: str) -> float:
        c = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
        return float(self.ratio[np.concatenate(([0], c[:-1])), c].sum())


def conditional(counts: np.ndarray) -> np.ndarray:
    """Pair counts (row: the character before, 0 for the start) to probabilities.
    A pair falls back, with the weight of ``_PRIOR`` sightings, on the share of its
    class after the class before times the character's share of its class, and
    these on equal shares. So a few numbers in prose already tell that digits are
    followed by digits, whichever digits they were."""
    of = np.eye(4)[_CLASS]  # character × class
    before = np.concatenate([np.eye(5)[:1], np.eye(5)[_CLASS + 1]])  # the start is a class of its own
    turn = before.T @ counts @ of
    turn = (turn + 1 / 4) / (turn.sum(1, keepdims=True) + 1)
    single = counts.sum(0)
    within = (single + 0.5) / ((single @ of)[_CLASS] + 0.5 * of.sum(0)[_CLASS])
    back = (before @ turn)[:, _CLASS] * within
    return (counts + _PRIOR * back) / (counts.sum(1, keepdims=True) + _PRIOR)


def learn_secrets(docs: DataFrame, samples: DataFrame | None = None) -> MarkovModels:
    """``docs(text)``: the two models, from all documents. ``samples(value string,
    random boolean)`` are further labelled strings, counted in the model that
    ``random`` names; nulls are left out."""

    def count(it):
        total = np.zeros((2, _N * _N), np.int64)
        for batch in it:
            for part in chunks(batch.column(0).to_pylist()):
                total[0] += _pairs(b"\n" + b"\n".join(part) + b"\n")
                found = {(i, s, v) for i, spans, _ in _scan(part) for s, _, _, v in spans}
                if found:
                    got = _pairs(b"\n" + b"\n".join(v.encode() for _, _, v in sorted(found)) + b"\n")
                    total[1] += got
                    total[0] -= got
        for label in (0, 1):
            at = np.flatnonzero(total[label])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label)), pa.array(at), pa.array(total[label][at])], names=["label", "pair", "n"])

    def count_samples(it):
        for batch in it:
            for label in (0, 1):
                own = batch.filter(pc.equal(batch.column(1), bool(label))).column(0).to_pylist()
                total = _pairs(b"\n" + b"\n".join(v.encode("utf-8", "surrogatepass") for v in own) + b"\n")
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label)), pa.array(at), pa.array(total[at])], names=["label", "pair", "n"])

    form = "label long, pair long, n long"
    counted = docs.select("text").mapInArrow(count, form)
    if samples is not None:
        counted = counted.unionByName(samples.select("value", "random").where("value is not null and random is not null").mapInArrow(count_samples, form))
    rows = counted.groupBy("label", "pair").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((2, _N * _N))
    n[rows["label"].to_numpy(int), rows["pair"].to_numpy(int)] = np.maximum(rows["n"].to_numpy(float), 0)
    n = n.reshape(2, _N, _N)[:, :, 1:]
    if not n[1].sum():
        return MarkovModels(None)
    p = [conditional(m) for m in n]
    return MarkovModels(np.concatenate([np.zeros((_N, 1)), np.log(p[1] / p[0])], axis=1))


def find_secrets(docs: DataFrame, model: MarkovModels, keep: list[str | Column] = ("doc_id",), min_ratio: float = 12.0, min_mean: float = 0.6) -> DataFrame:
    """``keep`` columns of ``docs`` with ``n_assign``, ``n_access``, ``n_hex``,
    ``n_markov``, ``base`` (the spans of the base rules) and ``spans`` (all),
    both as ``kind:start:end``, by start, then kind, joined by commas."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(*keep, F.col("text").alias("__text"))
    kept = narrow.drop("__text")
    names = kept.columns
    kinds = [k for k, *_ in BASE] + ["markov"]

    def told(spans):
        return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)

    def run(it):
        m = held.value
        for batch in it:
            at = 0
            for part in chunks(batch.column(len(names)).to_pylist()):
                counts = np.zeros((4, len(part)), np.int64)
                base, every = [""] * len(part), [""] * len(part)
                for i, found, text in _scan(part):
                    spans = [(s, k, e) for s, k, e, _ in found]
                    more = []
                    if m.ratio is not None:
                        for t in _TOKEN.finditer(text):
                            if any(s < t.end() and t.start() < e for s, _, e in spans):
                                continue
                            r = m.of(t[0])
                            if r >= min_ratio and r >= min_mean * len(t[0]):
                                more.append((t.start(), 3, t.end()))
                    base[i], every[i] = told(spans), told(sorted(spans + more))
                    for _, k, _ in spans + more:
                        counts[k, i] += 1
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(part)) for i in range(len(names))), *(pa.array(c) for c in counts), pa.array(base, pa.string()), pa.array(every, pa.string())],
                                                 names=[*names, *(f"n_{k}" for k in kinds), "base", "spans"])
                at += len(part)

    schema = kept.schema
    for k in kinds:
        schema = schema.add(f"n_{k}", "long")
    return narrow.mapInArrow(run, schema.add("base", "string").add("spans", "string"))
