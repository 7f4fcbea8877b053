"""Line de-duplication, chat formatting and mixing: DataFrame functions only,
checked against plain Python and against their SQL."""

import heapq
import random
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from joblake.llm import chat, line_dedup, mixing


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def in_duck(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    return sorted(map(repr, con.sql(sql).fetchall())), con.sql(sql).columns


def brute_lines(rows, min_words):
    """Every pair of places, extended line by line."""
    docs = sorted({(i is None, i if i is not None else 0, t) for i, t in rows if t is not None})
    seqs = [[(p, l) for p, l in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", l)] for _, _, t in docs]
    words = lambda l: len(re.findall(r"[^\x20\x09-\x0D]+", l))
    gone = [set() for _ in docs]
    for a in range(len(docs)):
        for b in range(a + 1):
            for i in range(len(seqs[a])):
                for j in range(len(seqs[b])):
                    if (b, j) >= (a, i) or seqs[a][i][1] != seqs[b][j][1]:
                        continue
                    if i and j and seqs[a][i - 1][1] == seqs[b][j - 1][1]:
                        continue
                    n = 0
                    while i + n < len(seqs[a]) and j + n < len(seqs[b]) and seqs[a][i + n][1] == seqs[b][j + n][1]:
                        n += 1
                    if sum(words(seqs[a][i + x][1]) for x in range(n)) >= min_words:
                        gone[a].update(range(seqs[a][i][0], seqs[a][i + n - 1][0] + 1))
    clean = {(None if d[0] else d[1], d[2]): "\n".join(l for p, l in enumerate(d[2].split("\n")) if p not in g) for d, g in zip(docs, gone)}
    return sorted(((i, clean[i, t] if t is not None else None) for i, t in rows), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_lines(spark, make_docs, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 5, 12]))) for _ in range(13)] + ["", "  ", "\t \r", "a\tb\tc\td\te\x0bf", "    x"]
    runs = [[rng.choice(pool) for _ in range(rng.randrange(2, 7))] for _ in range(4)]
    rows = []
    for i in range(25):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            lines += rng.choice(runs) if rng.random() < 0.6 else [rng.choice(pool)]
        rows.append((100 - i, "\n".join(lines)))
    rows += [(None, rows[0][1]), (3, None), (4, ""), rows[2], rows[2], (200, "\n".join(runs[0] * 3))]
    docs = make_docs([t for _, t in rows], [i for i, _ in rows], clash=True)
    out = line_dedup.drop_repeated_lines(docs, 10)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == brute_lines(rows, 10)
    assert out.columns[: len(docs.columns)] == docs.columns
    no_python(out)
    plain = out.select("doc_id", "text", "n_lines", "n_removed")
    sql = f"SELECT doc_id, text, n_lines, n_removed FROM ({line_dedup.oracle(10)})"
    assert sorted(repr(tuple(r)) for r in plain.collect()) == in_duck(plain, sql, documents=docs.select("doc_id", "text"))[0]


def test_line_dedup_empty_and_long(spark, make_docs):
    assert line_dedup.drop_repeated_lines(make_docs([])).count() == 0
    long = "\n".join(f"line {i} of a very long text" for i in range(20000))
    out = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(make_docs([long, "x y\n" + long])).collect()}
    assert out == {0: long, 1: "x y"}


def test_tables_and_indents_count_words(spark, make_docs):
    tab = "\n".join("\t".join(f"c{r}{c}" for c in range(6)) for r in range(4))  # 24 words, hardly a blank
    code = "\n".join(" " * 12 + f"x{i}" for i in range(9))  # nine words behind many blanks
    docs = make_docs(["one\n" + tab, "two\n" + tab, "three\n" + code, "four\n" + code])
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs, 20).collect()}
    assert got == {0: "one\n" + tab, 1: "two", 2: "three\n" + code, 3: "four\n" + code}


def test_many_runs_in_a_very_long_text(spark, make_docs):
    block = ["alpha beta gamma delta", "epsilon zeta eta theta"]
    long = [x for i in range(50000) for x in (*block, f"only {i}")]
    docs = make_docs(["\n".join(block), "\n".join(long)])
    got = {r.doc_id: (r.text, r.n_removed, len(r.removed_runs or [])) for r in line_dedup.drop_repeated_lines(docs, 8).collect()}
    assert got[0][1] == 0 and got[1] == ("\n".join(f"only {i}" for i in range(50000)), 100000, 50000)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def brute_chats(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    by = {c: tuple(t[1:] for t in sorted(v)) for c, v in by.items()}
    first = {}
    for c, v in sorted(by.items(), key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(v, c)
    keep = [v for v in first if not any(len(o) > len(v) and o[: len(v)] == v for o in first)]
    return sorted(((first[v], len(v), "".join(f"<|im_start|>{r[1]}\n{x[1]}<|im_end|>\n" for r, x in v)) for v in keep), key=repr)


def test_snapshots_collapse(spark):
    rng = random.Random(5)
    rows = []
    for c in range(60):
        base = random.Random(rng.randrange(6))
        turns = [("user" if i % 2 == 0 else "assistant", f"say {base.randrange(3)}") for i in range(8)]
        n = rng.randrange(1, 9)
        rows += [(c, i, *turns[i]) for i in range(n)]
    rows += [(None, 0, "user", "alone"), (70, None, "user", "x"), (70, 0, None, None), (71, 0, "user", ""), (72, 0, "user", None), (73, 0, "user", "dup"), (73, 0, "user", "dup"),
             (74, 0, "user", "dup"), (75, 5, "user", "say 0"), (-1, 0, "user", "zz" * 5000)]
    df = conversations(spark, rows).withColumn("h", F.lit(1)).withColumn("c", F.lit(2)).withColumn("place", F.lit(3)).withColumn("b", F.lit(4))
    for block in (1024, 2):
        out = chat.format_chats(df, block_turns=block)
        assert sorted(((r.conv_id, r.n_turns, r.rendered) for r in out.collect()), key=repr) == brute_chats(rows)
    no_python(out)
    parts = chat.format_chats(df, part_turns=3)
    whole = {}
    for r in sorted(parts.collect(), key=lambda r: r.part):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.rendered
    assert whole == {c: t for c, _, t in brute_chats(rows)}
    known = [r for r in rows if r[0] is not None]
    out = chat.format_chats(conversations(spark, known)).select("conv_id", "part", "n_turns", "rendered")
    sql = f"SELECT conv_id, part, n_turns, rendered FROM ({chat.oracle()})"
    assert sorted(repr(tuple(r)) for r in out.collect()) == in_duck(out, sql, conversations=conversations(spark, known))[0]
    assert chat.format_chats(conversations(spark, [])).count() == 0


def test_schedule_is_pfair(spark):
    for shares in ([5, 3, 2], [1], [7, 7, 1, 30, 2], [1, 1, 1]):
        df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(shares)], "source string, share long")
        rows = sorted(mixing.schedule(df).collect(), key=lambda r: r.slot)
        total = sum(shares)
        assert [r.slot for r in rows] == list(range(total))
        done = dict.fromkeys((f"s{i}" for i in range(len(shares))), 0)
        for t, r in enumerate(rows, 1):
            assert r.k == done[r.source] and r.period == total
            done[r.source] += 1
            for i, s in enumerate(shares):
                assert abs(done[f"s{i}"] - Fraction(t * s, total)) < 1


def test_mix_keeps_all_rows_and_weights(spark, make_docs):
    rng = random.Random(2)
    sources = [rng.choice(["a"] * 8 + ["b", "c", None]) for _ in range(400)]
    texts = [rng.choice(["x", "", None]) for _ in sources]
    ids = [rng.choice([None, i, 7]) if i % 40 == 0 else i for i in range(len(sources))]
    docs = make_docs(texts, ids, sources=sources, clash=True)
    out = mixing.mix_sources(docs, block_rows=4)
    no_python(out)
    rows = out.collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in rows), key=repr) == sorted(zip(ids, texts, sources), key=repr)
    assert all(x == f"extra {c}" for r in rows for c, x in r.asDict().items() if c in ("s", "p", "m", "key", "d"))
    assert len({(r.slot, r.place) for r in rows}) == len(rows) and all(0 <= r.place < 4 for r in rows)
    n = {s: sources.count(s) for s in set(sources)}
    share = {s: max(1, int(64 * (n[s] / max(n.values())) ** 0.5)) for s in n}
    blocks = sorted({(r.slot, r.source or "") for r in rows if r.in_mix})
    for t, _ in enumerate(blocks, 1):
        for s in n:
            have = sum(1 for b in blocks[:t] if b[1] == (s or ""))
            assert abs(have - Fraction(t * share[s], sum(share.values()))) < 1
    plain = out.select("doc_id", "source", "block", "slot", "place", "in_mix")
    sql = f"SELECT doc_id, source, block, slot, place, in_mix FROM ({mixing.oracle(4)})"
    assert sorted(repr(tuple(r)) for r in plain.collect()) == in_duck(plain, sql, documents=docs.select("doc_id", "text", "source"))[0]
    assert mixing.mix_sources(make_docs([])).count() == 0
    given = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), (None, 1)], "source string, share long")
    assert mixing.mix_sources(docs, given, 4).count() == len(sources)


def test_schedule_of_many_sources(spark, make_docs):
    for n in (300, 4096):  # periods of 19,200 and 262,144 slots
        df = spark.range(n).select(F.format_string("s%04d", "id").alias("source"), F.lit(64).alias("share"))
        rows = mixing.schedule(df).agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"),
                                       F.sum((F.col("slot") != F.col("k") * n + F.substring("source", 2, 4).cast("int")).cast("int")).alias("wrong")).first()
        assert tuple(rows) == (64 * n, 64 * n, 64 * n - 1, 0)
        docs = make_docs(["x"] * (2 * n), sources=[f"s{i % n:04d}" for i in range(2 * n)])
        out = mixing.mix_sources(docs, block_rows=1)
        no_python(out)
        got = sorted((r.slot, r.source, r.in_mix) for r in out.collect())
        assert got == [(i, f"s{i % n:04d}", True) for i in range(2 * n)]


def test_common_divisor_changes_no_slot(spark, make_docs):
    shares = [("a", 12), ("b", 6), ("c", 18), (None, 6)]
    df = spark.createDataFrame(shares, "source string, share long")
    small = mixing.reduced(df)
    assert sorted((r.source or "", r.share) for r in small.collect()) == [("", 1), ("a", 2), ("b", 1), ("c", 3)]
    whole, part = (sorted((r.slot, r.source or "") for r in mixing.schedule(x).collect()) for x in (df, small))
    assert whole == [(s + 7 * i, x) for i in range(6) for s, x in part]
    assert mixing.reduced(df.limit(0)).count() == 0
    n = 20000  # equal sources: one slot each
    docs = make_docs(["x"] * n, sources=[f"s{i:05d}" for i in range(n)])
    assert mixing.mix_sources(docs, block_rows=1).where("slot <> cast(substring(source, 2) as int)").count() == 0


def test_a_long_schedule_is_joined(spark, make_docs, monkeypatch):
    docs = make_docs(["x"] * 200, sources=[f"s{i % 7}" for i in range(200)])
    want = sorted(map(tuple, mixing.mix_sources(docs, block_rows=4).select("doc_id", "slot", "place").collect()))
    monkeypatch.setattr(mixing, "_SLOTS", 0)
    assert sorted(map(tuple, mixing.mix_sources(docs, block_rows=4).select("doc_id", "slot", "place").collect())) == want


def test_schedule_of_many_shares_is_earliest_deadline_first(spark):
    rng = random.Random(11)
    shares = [rng.randrange(1, 65) for _ in range(600)]
    total = sum(shares)
    assert total > 1 << 14
    released, ready, want = {}, [], []
    for i, s in enumerate(shares):
        for k in range(s):
            released.setdefault(k * total // s, []).append((-(-(k + 1) * total // s), i, k))
    for t in range(total):
        for x in released.get(t, []):
            heapq.heappush(ready, x)
        _, i, k = heapq.heappop(ready)
        want.append((t, f"s{i:03d}", k))
    df = spark.createDataFrame([(f"s{i:03d}", s) for i, s in enumerate(shares)], "source string, share long")
    assert sorted((r.slot, r.source, r.k) for r in mixing.schedule(df).collect()) == want
