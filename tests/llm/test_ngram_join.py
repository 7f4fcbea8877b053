"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from joblake.llm import ngram_join as nj
from joblake.llm.hashing import chunks, shingle_sets


def brute(rows, k, threshold):
    tab = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").translate(tab).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    par = list(range(len(rows)))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                    par[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return out


def family(rng, n_words, copies, edits):
    base = [f"w{rng.randrange(4000)}" for _ in range(n_words)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(n_words)] = f"x{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,threshold", [(3, 90), (5, 80)])
def test_components_equal_all_pairs(spark, make_docs, k, threshold):
    rng = random.Random(k)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = ["", None, "  \n\t ", "One", "one", "a b", "A  b", "É b", "é b", "a b c d"]
    texts += family(rng, 150, 25, 6) + family(rng, 20, 8, 1) + family(rng, 900, 6, 30) + family(rng, 60, 12, 2)
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(3, 80))) for _ in range(20)]
    texts += texts[10:14] + ["chain " + " ".join(f"c{i + j}" for i in range(80)) for j in range(12)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(1000 + i, texts[o]) for i, o in enumerate(order)] + [(None, texts[10]), (1003, "a b c d"), (None, "lone words here now")]
    rows += [rows[0], rows[5]]
    got = nj.ngram_jaccard_classes(make_docs([t for _, t in rows], [i for i, _ in rows], clash=True), k, threshold)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=key) == sorted(brute(rows, k, threshold), key=key)


def test_one_per_group_keeps_smallest(spark, make_docs):
    t = " ".join(f"w{i}" for i in range(100))
    docs = make_docs([t + " z", t, t, "other", "other", "", "", None], [9, 4, 7, 2, 2, 5, 6, 8], clash=True)
    out = nj.one_per_group(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted([(4, t), (2, "other"), (5, ""), (6, ""), (8, "")])


def test_empty_table(spark, make_docs):
    assert nj.ngram_jaccard_classes(make_docs([])).count() == 0


def test_every_order_shares_a_prefix_token():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(1, 1 << 63, 200, dtype=np.uint64))
    orders = nj.Orders(np.sort(base[:150]), rng.integers(2, 5, 150))
    for _ in range(50):
        b = np.unique(np.concatenate([rng.permutation(base)[:190], rng.integers(1, 1 << 63, 5, dtype=np.uint64)]))
        both = len(np.intersect1d(base, b))
        if 100 * both >= 90 * (len(base) + len(b) - both):
            for o in range(3):
                a, c = (orders.prefix(s, nj.prefix_length(len(s), 90), o) for s in (base, b))
                assert len(np.intersect1d(a, c))


def test_hashes_do_not_depend_on_chunks():
    texts = ["The quick  brown\tfox", "", "the QUICK brown fox jumps", None, "É a b c"] * 5
    one = [s.tolist() for c in chunks(texts) for s in shingle_sets(c, 3)]
    many = [s.tolist() for c in chunks(texts, 8) for s in shingle_sets(c, 3)]
    assert one == many and one[0] == one[2][:0] + one[0] and set(one[0]) < set(one[2])
