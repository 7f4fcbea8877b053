"""Operator 3: language identification with language-bitmask n-gram filters.

Words are lower-cased runs of letters between blanks; their n-grams are the
character trigrams of a word with one blank on either side, packed exactly into
63 bits. Trigrams are counted per language over all training documents. A
trigram belongs to every language in which its share is at least ``ratio`` of
its largest share in any language.

The filter is one Bloom filter per language, bit-sliced: word ``w`` of the
table holds bit ``w`` of all languages' filters, so the words (``HASHES`` at most) of a
trigram, and-ed, give all languages that contain it at once. A document's score
for a language is the number of its trigrams that the language contains, less
the false positives expected from how full the language's filter is. The best
score decides (ties: the smaller name); ``score`` is its share of the
document's trigrams.

``und`` with score 0: null text, text without a letter, and any text when no
labelled row was given. Letters of which no trigram is known give the language
with the most training text, score 0. Rows with a null language are not learned
from. Extra columns are ignored; repeated rows are answered alike.

The filters hold every trigram that passes ``ratio``, however seldom it was seen,
so a language with little text keeps its own. The executors set their bits, and the table grows with the largest
language up to ``MAX_WORDS`` words of 64 languages. From there on the filters
only get fuller, with fewer hashes, and the false positives taken off a score
account for it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from joblake.llm.hashing import mix
from joblake.session import drop_scratch, scratch_table as written

MAX_WORDS = 1 << 22
HASHES = 4
BUFFER = 1 << 21
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once per worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, document of each code, has a letter per document)``."""
    lower = [("" if t is None else t.lower()) for t in texts]
    a = np.frombuffer("".join(f" {t} \0" for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[a]
    doc = np.cumsum(a == 0) if a.size else np.empty(0, np.int64)
    if doc.size and doc[-1] != len(texts):  # a text with NUL characters of its own
        ends = np.cumsum([len(t) + 3 for t in lower])
        doc = np.searchsorted(ends, np.arange(len(a)), side="right")
    # a run of other characters is one blank
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    c = np.where(letter, a, np.uint32(32))[keep].astype(np.int64)
    doc = doc[keep]
    mid = c[1:-1] != 32
    # the blanks on both sides of one gap may both be there; a trigram has a letter in the middle
    codes = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[mid]
    has = np.zeros(len(texts), bool)
    where = doc[1:-1][mid]
    has[where] = True
    return codes, where, has


def _parts(texts: list[str | None], limit: int = 1 << 20):
    """Index ranges of about ``limit`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _places(codes: np.ndarray, n_words: int, hashes: int):
    """The words of a table of ``n_words`` (a power of two) that trigrams set,
    one array per hash."""
    m = np.uint64(n_words - 1)
    h = mix(codes)
    step = h >> np.uint64(33) | np.uint64(1)
    with np.errstate(over="ignore"):
        for _ in range(hashes):
            yield (h & m).astype(np.int64)
            h = h + step


@dataclass
class LanguageFilters:
    """Bit-sliced Bloom filters: ``table[w]`` has one bit per language."""

    languages: list[str]
    table: np.ndarray  # (words, slabs) uint64
    false_positive: np.ndarray
    most_common: int
    hashes: int = HASHES

    def masks(self, codes: np.ndarray, slabs: slice = slice(None)) -> np.ndarray:
        out = None
        for at in _places(codes, len(self.table), self.hashes):
            hit = self.table[at, slabs]
            out = hit if out is None else out & hit
        return out

    def identify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        codes, doc, has = trigrams(texts)
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        total = np.bincount(doc, minlength=n)
        best, top = np.full(n, self.most_common), np.zeros(n)
        for l, false in enumerate(self.false_positive):
            if l & 63 == 0:
                masks = self.masks(codes, slice(l >> 6, (l >> 6) + 1))[:, 0]
            bit = masks >> np.uint64(l & 63) & np.uint64(1)
            score = (np.bincount(doc, weights=bit, minlength=n) - total * false) / max(1.0 - false, 1e-9)
            better = score > top
            best[better], top[better] = l, score[better]
        return ([self.languages[b] if ok else "und" for b, ok in zip(best, has)],
                np.where(has, np.minimum(1.0, top / np.maximum(total, 1)), 0.0))


def learn_languages(train: DataFrame, ratio: float = 0.5) -> LanguageFilters:
    """``train(text, lang)``: the filters of all its languages."""

    def count(it):
        for batch in it:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            held, size = {}, 0
            for s, e in _parts(texts):
                codes, doc, _ = trigrams(texts[s:e])
                lang = np.array([number[x] for x in langs[s:e]])[doc]
                for l in range(len(names)):
                    u, c = np.unique(codes[lang == l], return_counts=True)
                    held.setdefault(l, []).append((u, c))
                    size += len(u)
                if size > BUFFER:
                    yield from emit(held, names)
                    held, size = {}, 0
            yield from emit(held, names)

    def emit(held, names):
        for l, got in held.items():
            u, at = np.unique(np.concatenate([u for u, _ in got]), return_inverse=True)
            c = np.bincount(at, weights=np.concatenate([c for _, c in got]), minlength=len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([names[l]] * len(u), pa.string()), pa.array(u), pa.array(c)], names=["lang", "g", "c"])

    train = train.where("lang is not null and text is not null").select("text", "lang")
    counts = train.mapInArrow(count, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    counts = written(counts, "trigrams")
    try:
        totals = counts.groupBy("lang").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("m"))
        sizes = totals.orderBy("lang").collect()
        if not sizes:
            return LanguageFilters([], np.zeros((1, 1), np.uint64), np.zeros(0), 0)
        names = [r.lang for r in sizes]
        number = {x: l for l, x in enumerate(names)}
        slabs = -(-len(names) // 64)
        # eight words per trigram of the largest language, as far as they go
        most = max(16, *(r.m for r in sizes))
        n_words = max(1 << 12, min(1 << int(np.ceil(np.log2(8 * most))), 1 << int(np.log2(max(1, MAX_WORDS // slabs)))))
        hashes = int(np.clip(round(np.log(2) * n_words / most), 1, HASHES))

        def bits(it):
            for batch in it:
                lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
                codes = batch.column(1).to_numpy()
                v = pa.array(np.left_shift(np.uint64(1), (lang & 63).astype(np.uint64)).view(np.int64))
                for at in _places(codes, n_words, hashes):
                    yield pa.RecordBatch.from_arrays([pa.array(at * slabs + (lang >> 6)), v], names=["w", "v"])

        shares = counts.join(totals, "lang").select("lang", "g", "c", (F.col("c") / F.col("n").cast("double")).alias("p"))
        top = shares.groupBy("g").agg(F.max("p").alias("most"))
        chosen = shares.join(top, "g").where(F.col("p") >= ratio * F.col("most")).select("lang", "g")
        rows = chosen.mapInArrow(bits, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    finally:
        drop_scratch(counts)
    table = np.zeros(n_words * slabs, np.uint64)
    table[rows["w"].to_numpy()] = rows["v"].to_numpy().view(np.uint64)
    table = table.reshape(n_words, slabs)
    fill = np.array([(table[:, l >> 6] >> np.uint64(l & 63) & np.uint64(1)).mean() for l in range(len(names))])
    return LanguageFilters(names, table, fill ** hashes, int(np.argmax([r.n for r in sizes])), hashes)


def identify_languages(docs: DataFrame, model: LanguageFilters, keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(*keep, F.col("text").alias("__text"))
    kept = narrow.drop("__text")
    names = kept.columns

    def run(it):
        m = held.value
        for batch in it:
            texts = batch.column(len(names)).to_pylist()
            for s, e in _parts(texts):
                lang, score = m.identify(texts[s:e])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(s, e - s) for i in range(len(names))), pa.array(lang, pa.string()), pa.array(score)],
                                                 names=[*names, "lang_pred", "score"])

    out = kept.schema.add("lang_pred", "string").add("score", "double")
    return narrow.mapInArrow(run, out)
