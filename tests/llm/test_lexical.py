"""Ranked lexical search against every document's score."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from joblake.llm import lexical as lx

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, want in wanted.items():
        scored = []
        for doc, c, n in bags:
            m = 25 + 75 * n * n_docs // length
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in want.items() if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def items(spark, pairs):
    return spark.createDataFrame(pairs, "item_id long, text string").withColumn("n", F.lit("x")).withColumn("score", F.lit("y"))


def test_equals_plain_python(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lx, "_MERGE", 2)
    rng = random.Random(1)
    words = ["Cat", "cat", "İstanbul", "naïve", "x1", "B2b", "東京", "the", "the", "the", "ZÉ", "zé"]
    texts = [rng.choice([" ", "-", "\n", "\0", "_"]).join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(200)] + [None, "", "...", "the the"] * 3
    ids = [None if i % 50 == 7 else i % 150 for i in range(len(texts))]
    docs = make_docs(texts, ids, clash=True).repartition(7)
    asked = [(i, " ".join(rng.choice(words) for _ in range(5))) for i in range(8)] + [(3, "cat zebra"), (None, "the cat"), (20, None), (21, ""), (22, "unseen"), (23, "cat cat cat")]
    for block in (1 << 18, 6):
        assert rows(lx.ranked_documents(docs, items(spark, asked), k=4, block_terms=block)) == plain(list(zip(ids, texts)), asked, 4)


def test_heaps_in_small_parts(monkeypatch):
    monkeypatch.setattr(lx, "_CELLS", 16)
    rng = np.random.default_rng(1)
    index = lx.ItemIndex.of([{"item_id": i, "term": b"%d" % t, "times": 1 + t % 2} for i in range(5) for t in range(i, 9, 2)])
    n_terms, docs = len(index.number), []
    for doc in range(80):
        t = rng.permutation(n_terms)[: rng.integers(0, n_terms)]
        docs.append((None if doc % 9 == 0 else doc % 30, 20, t, rng.integers(1, 3, len(t))))
    weight = np.arange(1, n_terms + 1) * 10
    top = lx.TopItems(index, weight, 80, 1600, 3)
    for s in range(0, 80, 20):
        part = docs[s : s + 20]
        top.offer([d[0] for d in part], np.array([d[1] for d in part]), np.concatenate([d[2] for d in part]), np.concatenate([d[3] for d in part]), np.array([len(d[2]) for d in part]))
    got, want = sorted(top.entries(), key=repr), []
    for item in range(5):
        own = {t: int(index.times[p]) for t in range(n_terms) for p in range(index.start[t], index.start[t + 1]) if index.items[p] == item}
        scored = [(sum(own.get(t, 0) * int(weight[t]) * (10 ** 9 * f // (1000 * f + 8 * 100)) for t, f in zip(x.tolist(), tf.tolist())), i) for i, _, x, tf in docs]
        want += [(item, i, s) for s, i in sorted(scored, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:3] if s > 0]
    assert got == sorted(want, key=repr)


def test_many_equal_scores_go_by_id(spark, make_docs):
    docs = make_docs(["same words here"] * 500 + ["other"], ids=[*range(500, 0, -1), 0]).repartition(5)
    got = lx.ranked_documents(docs, items(spark, [(1, "same words")])).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 11)) and len({r.score for r in got}) == 1


def test_long_text_counts_as_a_whole(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lx, "_PIECE", 10)
    text = "alpha beta-gamma " * 40 + "x" * 100 + " alpha"
    assert lx.term_counts(text) == (122, Counter({"alpha".encode(): 41, b"beta": 40, b"gamma": 40, b"x" * 100: 1}))
    assert b"".join(lx.pieces(text)) == text.encode()


def test_empty_tables(spark, make_docs):
    docs, asked = make_docs(["a b"]), items(spark, [(1, "a")])
    assert lx.ranked_documents(docs.limit(0), asked).count() == 0
    assert lx.ranked_documents(docs, asked.limit(0)).count() == 0
    assert lx.ranked_documents(docs, items(spark, [(1, "?!")])).columns == ["item_id", "rank", "doc_id", "score"]
