"""The ingestion stream: restarts, and what a micro-batch reads."""

import json
import os

from pyspark.sql import functions as F

from joblake.sources import pages as PG
from joblake.streaming import ingest_stream as S

BODY = "Works with spark in Big Harbour Tools daily. " * 40


def listing(i, title, company):
    return {"title": title, "company_name": company, "location": "X", "via": "v", "description": BODY, "job_id": f"id{i}"}


def land(folder, n, lines):
    path = folder / f"{n}.json"
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    os.utime(path, (1_000_000 + n, 1_000_000 + n))


def page(q, n, rows, err=None):
    return {"query_name": q, "page_no": n, "error": err, "jobs_results": rows}


def test_restart_equals_batch_and_leaves_the_store_unread(spark, tmp_path):
    from joblake.plans.ingest import ingest_batch
    kw = spark.createDataFrame([(1, "framework", "Spark", None, 0, None)], "id long, kind string, name string, domain string, is_candidate int, user_level string")
    al = spark.createDataFrame([], "kind string, alias string, id long")
    folder, store, ckpt = tmp_path / "landing", str(tmp_path / "store"), str(tmp_path / "ckpt")
    folder.mkdir()
    first = [page("a", 1, [listing(1, "data engineer", "Acme"), listing(2, "data engineering", "Acme Inc"), listing(3, "nurse", "Clinic North")]),
             page("a", 2, [listing(4, "late", "Late")], "rate limited"), '{"query_name": "a", "page_no": 1, "jobs_resu', "[1]"]
    # like a kept one, like a dropped one only, equal, same title elsewhere, and a page after the query's failed one
    second = [page("b", 1, [listing(5, "data engineer ii", "ACME Inc"), listing(6, "data engineering lead", "Acme"), listing(7, "Nurse", "Clinic North"),
                            listing(8, "nurse", "Harbour"), listing(9, "nurses", "Clinic Nord")]), page("a", 3, [listing(10, "later", "Later")])]
    land(folder, 0, first)
    S.stream_ingest(spark, str(folder), store, ckpt, kw, al, as_of="2001-08-01")
    before = {r.job_id for r in S.read_store(spark, store).collect()}
    assert before == {"id1", "id3"}
    hidden = [os.path.join(d, f) for t in ("jobs", "job_keywords") for d, _, names in os.walk(f"{store}/{t}") for f in names if f.endswith(".parquet")]
    held = {f: open(f, "rb").read() for f in hidden}
    for f in hidden:  # whoever reads a listing of the first run now fails
        open(f, "wb").write(b"PAR1 not a file PAR1")
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.rename(crc, crc + ".held")
    land(folder, 1, second)
    S.stream_ingest(spark, str(folder), store, ckpt, kw, al, as_of="2001-08-01")
    for f, b in held.items():
        open(f, "wb").write(b)
    got = {r.job_id: r for r in S.read_store(spark, store).collect()}

    everything = PG.landed_pages(PG.read_landing(spark, str(folder))[0], 10)
    batch = ingest_batch(S.number_listings(everything), spark.createDataFrame([], S.STORE_SCHEMA), kw, al, as_of="2001-08-01")
    assert {r.dedup_hash for r in got.values()} == {r.dedup_hash for r in batch.jobs.collect()}
    assert "id7" not in got and "id8" in got and "id10" not in got
    assert len({r.seq for r in got.values()}) == len(got) and all(r.batch.endswith("000001") for i, r in got.items() if i not in before)
    assert sorted(r.reason for r in S.read_rejected(spark, store).collect()) == ["not JSON", "not an object"]
    assert {r.record for r in S.read_rejected(spark, store).collect()} == {first[2], "[1]"}
    assert S.read_junction(spark, store).where(F.col("kind") == "framework").count() == len(got)
    # with nothing new, nothing happens
    S.stream_ingest(spark, str(folder), store, ckpt, kw, al, as_of="2001-08-01")
    assert S.read_store(spark, store).count() == len(got)


def test_a_batch_run_again_replaces_its_rows(spark, tmp_path):
    rows = spark.createDataFrame([("h1", "x"), ("h2", "y")], "dedup_hash string, batch string")
    S._write(rows, str(tmp_path / "t"), "batch")
    S._write(rows.where("batch = 'y'").withColumn("dedup_hash", F.lit("h3")), str(tmp_path / "t"), "batch")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("dedup_hash", "batch").collect()) == [("h1", "x"), ("h3", "y")]


def test_titles_of_a_trigram_are_not_compared_one_by_one(monkeypatch):
    """Links as by comparing every pair, with a ratio computed for few of them."""
    import random
    from types import SimpleNamespace

    from joblake.functions.text import token_sort_ratio_py
    from joblake.streaming import state as ST
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(300)]
    titles = ["", "数据 工程师", "数据 工程", "x" * 200, "x" * 190 + "y" * 10]
    while len(titles) < 300:
        titles.append(" ".join(sorted(rng.choices(words, k=3))) if rng.random() < 0.8 else rng.choice(titles) + rng.choice(["", "s", " ii"]))
    companies = [("acme a", ["  a", "acm", "cme"]), ("acme b", ["  a", "acm", "cme", "  b"]), ("other", ["  a", "oth", "the", "her", "er ", "  o"])]
    rows = []
    for i, t in enumerate(titles):
        name, grams = rng.choice(companies)
        rows.append(SimpleNamespace(company_name=name, tkey=t, dedup_hash=f"h{i}", grams=grams, prefix=grams[:2], query="q", page_no=1, position=i))

    asked = []
    monkeypatch.setattr(ST, "token_sort_ratio_py", lambda a, b: asked.append(1) or token_sort_ratio_py(a, b))
    held = rows[:40]  # of an earlier batch
    first = {(r.company_name, r.tkey): (r.dedup_hash, r.grams, r.prefix) for r in reversed(held)}
    arrivals = ST.Arrivals()
    arrivals.titles = SimpleNamespace(iterator=lambda: iter(first.items()), updateValue=lambda k, v: None)
    got = {(x.dedup_hash, x.other, x.same) for x in arrivals._by_gram("  a", rows[40:])}

    known, want = dict(first), set()
    for r in rows[40:]:
        if (r.company_name, r.tkey) in known:
            want.add((r.dedup_hash, known[r.company_name, r.tkey][0], True))
            continue
        for (_, tkey), (other, grams, _) in known.items():
            shared = len(set(grams) & set(r.grams))
            if shared >= arrivals.company * (len(grams) + len(r.grams) - shared) and token_sort_ratio_py(r.tkey, tkey) >= arrivals.title:
                want.add((r.dedup_hash, other, False))
        known[r.company_name, r.tkey] = (r.dedup_hash, r.grams, r.prefix)
    assert got == want and len(want) > 20
    assert len(asked) < len(rows) * len(rows) / 40
