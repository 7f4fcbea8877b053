"""Tokenizer alignment against a token-by-token version, and its sparse products."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from joblake.llm import alignment as al

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i])))
        at = out[-1][1]
    return out


def plain(texts):
    """Per text: counts, overlap links by positions, groups as text."""
    enc = al.Encoders.of(A, B)
    out = []
    for t in texts:
        a = enc.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = enc.b.encode(t) if t else []
        whole = (" " + t).encode() if t else b""
        if b"".join(enc.a_bytes[i] for i in a) != whole or b"".join(enc.b_bytes[i] for i in b) != whole:
            a = b = []
        sa, sb = spans(a, enc.a_bytes), spans(b, enc.b_bytes)
        links = [(i, a[i], j, b[j], min(e, f) - max(s, r)) for i, (s, e) in enumerate(sa) for j, (r, f) in enumerate(sb) if max(s, r) < min(e, f)]
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([i for i, (_, e) in enumerate(sa) if lo < e <= hi], [j for j, (_, e) in enumerate(sb) if lo < e <= hi]) for lo, hi in zip([0, *ends], ends)]
        out.append((a, b, links, groups))
    return out


def expected(ids, texts):
    told = plain(texts)
    count = Counter((x[1], x[3]) for _, _, links, _ in told for x in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for i, (a, b, links, groups) in zip(ids, told):
        spelled = ";".join(",".join(str(a[x]) for x in p) + "|" + ",".join(str(b[y]) for y in q) for p, q in groups)
        rows.append((i, len(a), len(b), len(groups), len(links), spelled, hashlib.sha256(spelled.encode()).hexdigest() if spelled else "",
                     sum(count[x[1], x[3]] == most[x[3]] for x in links), sum(count[x[1], x[3]] for x in links)))
    return rows


TEXTS = ["The cat sat.", None, "", " ", "x", "The cat sat.", "naïve café — 東京 🙂🙂", "a▁b", "<|endoftext|> <s> <0x41>", "tab\tand\n\nlines  two   blanks ",
         "\0 zero", "ﬁ ligature ½", "é combining", "don't we'll I've 1234567", "日本語" * 20]


def as_key(rows):
    return sorted(rows, key=repr)


def test_documents_equal_plain_python(spark, make_docs):
    texts = TEXTS * 2
    ids = [None if i == 3 else i % 20 for i in range(len(texts))]
    for chunk in (1, 60, 1 << 20):
        got = al.align_tokenizers(make_docs(texts, ids, clash=True).repartition(3), A, B, chunk_bytes=chunk, keep_groups=True)
        assert as_key(tuple(r) for r in got.collect()) == as_key(expected(ids, texts))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "n_best", "count_sum"]


def test_pieces_are_cut_where_no_token_reaches_over(spark, make_docs):
    rng = random.Random(2)
    words = ["cat", "dogs", "naïve", "東京", "'ll", "9a", "Zed", "un\nder", "x  y", "...", "ñu", "e\u0301", "½", "a\u00a0b", "\u0301x", "_", "don't", "1 2"]
    enc = al.Encoders.of(A, B)
    assert enc.cuts
    for n in (1, 3, 8, 30) * 60 + (40000,):
        text = " ".join(rng.choice(words) for _ in range(n))
        a, b = enc.encode_text(text)
        whole = enc.a.encode(" " + text, add_special_tokens=False).ids, enc.b.encode(text)
        spelled = b"".join(enc.b_bytes[i] for i in whole[1]) == b" " + text.encode()
        assert (a.tolist(), b.tolist()) == (whole if spelled else ([], []))
    solid = "abc" * 20000  # nowhere to cut
    got = al.align_tokenizers(make_docs([text, solid]), A, B).orderBy("doc_id").collect()
    assert [r.n_a for r in got] == [len(a), len(enc.a.encode(" " + solid, add_special_tokens=False).ids)]
    x = al.Alignment(enc, a, np.array([len(a)]), b, np.array([len(b)]))
    entries = [np.concatenate(c) for c in zip(*x.overlap_links())]
    assert len(entries[0]) == got[0].n_links and (not len(a) or entries[2].sum() == len(text.encode()) + 1)


def test_link_rows(spark, make_docs):
    docs = make_docs(TEXTS)
    told = plain(TEXTS)
    got = al.token_links(docs, A, B).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *x) for i, t in enumerate(told) for x in t[2])
    got = al.token_links(docs, A, B, groups=True).collect()
    assert sorted((r.doc_id, r.a_pos, r.b_pos) for r in got) == sorted((i, x, y) for i, t in enumerate(told) for p, q in t[3] for x in p for y in q)


def test_empty_table(spark, make_docs):
    got = al.align_tokenizers(make_docs(["a"]).limit(0), A, B)
    assert got.count() == 0 and got.schema["count_sum"].dataType.simpleString() == "bigint"
    assert al.token_links(make_docs(["a"]).where(F.lit(False)), A, B).count() == 0


def test_products_equal_dense(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(al, "_ROWS", 7)
    for _ in range(50):
        n, k, m = rng.integers(1, 12, 3)
        a, b = rng.integers(0, 3, (n, k)) * rng.integers(0, 2, (n, k)), rng.integers(0, 3, (k, m)) * rng.integers(0, 2, (k, m))
        got = np.zeros((n, m), np.int64)
        for i, j, v in al.gustavson(csr(a), csr(b)):
            got[i, j] += v
        assert (got == a @ b).all()
        t = csr(a).transpose()
        assert (dense(t) == a.T).all()
        v = rng.integers(0, 9, k)
        assert (csr(a).times(v) == a @ v).all()


def csr(x):
    r, c = np.nonzero(x)
    return al.Csr(np.searchsorted(r, np.arange(len(x) + 1)), c, x[r, c], x.shape[1])


def dense(x):
    out = np.zeros((len(x.start) - 1, x.width), np.int64)
    out[np.repeat(np.arange(len(x.start) - 1), np.diff(x.start)), x.col] = x.val
    return out
