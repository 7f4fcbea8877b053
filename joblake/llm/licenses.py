"""Operator 4: license scans by patience alignment with license templates.

A document carries a license when a passage of it, aligned with the template,
covers at least ``threshold`` of the template's words.

* Places: runs of ``seed`` words that a text shares with a template (two words
  for templates under ten words, else three) name a diagonal, the place in the
  text less the place in the template. Around each diagonal lies a window of
  the template's length and a slack on both sides. A window with too few words
  of the template's vocabulary to reach the threshold is dropped unaligned.
* Patience alignment of a window: equal words at both ends are matched; of the
  words that occur once in the text and once in the template, the longest
  subsequence that increases in both are the anchors; the gaps between anchors
  are aligned in the same way.

* Templates of one family (a license and its notice, versions of a license, the
  GNU licenses) can cover the same words. A place of which another template of
  its family that aligns better covers half or more does not count; the better
  one has more words matched, less the words of its template and of its span
  that are not.

Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased A-Z.
Null and empty texts carry nothing. A license that a text holds several times
is one row with its number of places (windows that reach the threshold and do
not overlap, from left to right); coverage and span are those of the best
(ties: the first). Rows with the same id are answered one by one. Templates with
fewer than two words are ignored. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from joblake.llm.hashing import chunks, gram_hashes, hash_words

_TEXTS = Path(__file__).with_name("license_texts")
# Statements of one line; whole license texts, as published, and
# the notices that they ask to be put into files. Titles and copyright lines of
# the short licenses, which every project fills in, are left out. The AGPL-3.0
# is the GPL-3.0 with the AGPL's own preamble, sections and end.
TEMPLATES = {
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "MIT statement": "Released under the MIT License.",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    **{p.name[:-4]: p.read_text("utf-8") for p in sorted(_TEXTS.glob("*.txt"))},
}
# Templates that may cover the same words of a text.
FAMILIES = {"GPL": "GNU", "LGPL": "GNU", "AGPL": "GNU", "CC0": "CC"}


def family(name: str) -> str:
    """What a license's name begins with, the GNU licenses as one."""
    first = name.split(" ")[0].split("-")[0]
    return FAMILIES.get(first, first)


_BLANK = np.ones(256, bool)
_BLANK[48:58] = _BLANK[65:91] = _BLANK[97:123] = _BLANK[128:] = False

Pairs = list[tuple[int, int]]


def _increasing(pairs: Pairs) -> Pairs:
    """The longest part of ``pairs``, sorted by the first, that increases in
    the second as well (patience sorting)."""
    piles: list[int] = []
    top: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        p = bisect_left(piles, y)
        back.append(top[p - 1] if p else -1)
        if p == len(piles):
            piles.append(y)
            top.append(i)
        else:
            piles[p], top[p] = y, i
    out, i = [], top[-1] if top else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> Pairs:
    """Matched places ``(in a, in b)`` of a patience alignment, ascending."""
    out: Pairs = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: i for i, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        anchors = _increasing([(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if na[w] == 1 and w in at])
        if not anchors:
            continue
        out.extend(anchors)
        for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            if x1 - x0 > 1 and y1 - y0 > 1:
                todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


class Templates:
    """Templates as word hashes, with their seeds."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.names, self.words, self.least, self.slack, self.seed = [], [], [], [], []
        grams: dict[int, list[tuple[int, int, int]]] = {2: [], 3: []}
        for name, text in texts.items():
            w = hash_words(text.encode() + b" ", _BLANK)[2]
            if len(w) < 2:
                continue
            k = 2 if len(w) < 10 else 3
            t = len(self.names)
            self.names.append(name)
            self.words.append(w.tolist())
            self.least.append(int(np.ceil(threshold * len(w) - 1e-9)))
            self.slack.append(max(2, len(w) // 4))
            self.seed.append(k)
            grams[k].extend((int(g), t, i) for i, g in enumerate(gram_hashes(w, k)))
        self.grams = {}
        for k, rows in grams.items():
            rows.sort()
            self.grams[k] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1:] for r in rows], np.int64).reshape(-1, 2))
        self.vocabulary = [Counter(w) for w in self.words]
        self.known = np.unique(np.array([x for w in self.words for x in w], np.uint64))
        # which words each template has; the last column stands for all others
        self.member = np.zeros((len(self.words), len(self.known) + 1), bool)
        for t, w in enumerate(self.words):
            self.member[t, np.searchsorted(self.known, np.array(w, np.uint64))] = True

    def seeds(self, words: np.ndarray):
        """``(place, template, place in template)`` of all seeds."""
        for k, (keys, rows) in self.grams.items():
            g = gram_hashes(words, k)
            if not len(keys) or not len(g):
                continue
            lo = np.searchsorted(keys, g)
            for p in np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == g):
                j = lo[p]
                while j < len(keys) and keys[j] == g[p]:
                    yield int(p), int(rows[j, 0]), int(rows[j, 1])
                    j += 1

    def windows(self, words: list[int], number: np.ndarray, seeds: list[tuple[int, int, int]]):
        """Per template the windows of a text in which it may be, as
        ``(template, start, end)``; near diagonals share one. ``number`` are
        the words' columns of ``member``."""
        by: dict[int, set[int]] = {}
        for p, t, i in seeds:
            by.setdefault(t, set()).add(p - i)
        for t, diagonals in by.items():
            held = known = None
            for d in sorted(diagonals):
                if held is not None and d - held <= self.slack[t] // 2:
                    continue
                held = d
                start, end = max(0, d - self.slack[t]), min(len(words), d + len(self.words[t]) + self.slack[t])
                if end - start < self.least[t]:
                    continue
                if known is None:  # words of the template's vocabulary so far
                    known = np.concatenate(([0], np.cumsum(self.member[t][number])))
                if known[end] - known[start] >= self.least[t] and sum((Counter(words[start:end]) & self.vocabulary[t]).values()) >= self.least[t]:
                    yield t, start, end

    def best(self, found: dict[int, list[tuple[int, int, int]]], n_words: int) -> dict[int, list[tuple[int, int, int]]]:
        """The places left when better ones of the same family are kept."""
        families: dict[str, list[int]] = {}
        for t in found:
            families.setdefault(family(self.names[t]), []).append(t)
        out: dict[int, list[tuple[int, int, int]]] = {}
        for ts in families.values():
            if len(ts) == 1:
                out[ts[0]] = found[ts[0]]
                continue
            owner = np.full(n_words, -1)
            hits = [(3 * n - len(self.words[t]) - (e - s + 1), t, s, e, n) for t in ts for s, e, n in found[t]]
            for _, t, s, e, n in sorted(hits, key=lambda h: (-h[0], h[1:])):
                span = owner[s : e + 1]
                if 2 * np.count_nonzero((span >= 0) & (span != t)) < len(span):
                    span[span < 0] = t
                    out.setdefault(t, []).append((s, e, n))
        return out

    def licenses(self, words: np.ndarray, seeds: list[tuple[int, int, int]]) -> list[tuple[str, float, int, int, int]]:
        """``(license, coverage, places, first word, last word)``."""
        text = words.tolist()
        at = np.searchsorted(self.known, words)
        number = np.where(self.known[np.minimum(at, len(self.known) - 1)] == words, at, len(self.known))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for t, start, end in self.windows(text, number, seeds):
            pairs = patience(text[start:end], self.words[t])
            if len(pairs) >= self.least[t]:
                found.setdefault(t, []).append((start + pairs[0][0], start + pairs[-1][0], len(pairs)))
        out = []
        for t, hits in sorted(self.best(found, len(text)).items()):
            places, last = 0, -1
            for s, e, _ in sorted(hits, key=lambda h: (h[1], h[0])):
                if s > last:
                    places, last = places + 1, e
            s, e, n = min(hits, key=lambda h: (-h[2], h[0], h[1]))
            out.append((self.names[t], n / len(self.words[t]), places, s, e))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` with ``(license, coverage, places,
    first_word, last_word)``: one row per document and license it carries."""
    held = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES, threshold))
    narrow = docs.select(*keep, docs["text"].alias("__text"))
    kept = narrow.drop("__text")
    names = kept.columns

    def run(it):
        known = held.value
        for batch in it:
            at = 0
            for part in chunks(batch.column(len(names)).to_pylist()):
                joined = b"\n".join(part) + b"\n"
                start, _, h = hash_words(joined, _BLANK)
                off = np.concatenate(([0], np.searchsorted(start, np.cumsum([len(b) + 1 for b in part]))))
                per: dict[int, list[tuple[int, int, int]]] = {}
                for p, t, i in known.seeds(h):
                    d = int(np.searchsorted(off, p, side="right")) - 1
                    if p + known.seed[t] <= off[d + 1]:
                        per.setdefault(d, []).append((p - int(off[d]), t, i))
                rows = [(at + d, *x) for d, s in sorted(per.items()) for x in known.licenses(h[off[d] : off[d + 1]], s)]
                if rows:
                    row, name, coverage, places, first, last = zip(*rows)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row)) for i in range(len(names))), pa.array(name), pa.array(coverage), pa.array(places, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                                                     names=[*names, "license", "coverage", "places", "first_word", "last_word"])
                at += len(part)

    schema = kept.schema.add("license", "string").add("coverage", "double")
    for c in ("places", "first_word", "last_word"):
        schema = schema.add(c, "long")
    return narrow.mapInArrow(run, schema)
