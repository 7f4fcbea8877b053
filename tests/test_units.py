"""Golden cases on literal frames, and set-based operators against plain
sequential loops."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from joblake.functions.text import normalise_text, token_sort_ratio_py, trigram_similarity
from joblake.operators import changes as CH
from joblake.operators import curation as C
from joblake.operators import dedup as D
from joblake.operators import keywords as K
from joblake.operators import listing as L
from joblake.operators.extract import extract_fields
from joblake.sources import pages as PG


def test_parse_posted_at(spark):
    cases = [("3 hours ago", "2024-03-31"), ("Just posted", "2024-03-31"), ("yesterday", "2024-03-30"),
             ("5 days ago", "2024-03-26"), ("2 weeks ago", "2024-03-17"), ("1 month ago", "2024-03-01"),
             ("30+ days ago", None), ("", None), (None, None)]
    df = spark.createDataFrame(cases, "p string, want string")
    got = df.select("want", L.parse_posted_at("p", "2024-03-31").cast("string").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_normalise_text(spark):
    df = spark.createDataFrame([("Sr. Software Eng., Acme Inc.",), ("VP of Dev  Ops",), (None,),
                                ("café-bar Ltd",)], "t string")
    got = [r[0] for r in df.select(normalise_text("t")).collect()]
    assert got == ["senior software engineer acme", "vice president of developer ops", "", "café bar"]


def test_flatten_highlights_and_url(spark):
    schema = ("qualifications string, job_highlights array<struct<title:string,items:array<string>>>, "
              "apply_options array<struct<title:string,link:string>>, share_link string")
    rows = [
        (None, [("Qualifications and Responsibilities", ["a", "b"]), ("Responsibilities", ["c"])],
         [("x", ""), ("y", "https://y")], "https://s"),
        ("given", [("Qualifications", [])], None, "https://s2"),
        (None, [("Qualifications", []), ("Qualifications", ["q2"])], [("x", None)], None),
    ]
    df = L.flatten_highlights(spark.createDataFrame(rows, schema)).select(
        "qualifications", "responsibilities", L.primary_url().alias("url"))
    got = [tuple(r) for r in df.collect()]
    assert got == [("a\nb", "c", "https://y"), ("given", "", "https://s2"), ("q2", "", "")]


def test_filter_valid_listing(spark):
    long, short = "x" * 1000, "x" * 999
    rows = [("t", "c", "via LinkedIn", long), ("t", "c", "via LinkedIn", short), ("t", "Mercor", "v", long),
            ("Upwork", "c", "v", long), ("t", "c", "BeBee", long), ("t", "c", "jobs via dice.com", long)]
    df = spark.createDataFrame(rows, "title string, company_name string, via string, description string")
    assert L.filter_valid_listing(df).count() == 2
    assert L.filter_valid_listing(df, mode="substring").count() == 1


def test_clean_extraction(spark):
    from joblake.schemas import EXTRACTION
    row = ("freelance", "remote", "senior", 5, None, 1, 2, "USD", "weekly", ["a", " ", None], None)
    df = spark.createDataFrame([(row,)], f"e {EXTRACTION.simpleString()}")
    r = df.select(L.clean_extraction("e").alias("c")).first().c
    assert r.employment_type is None and r.attendance == "remote" and r.salary_period is None
    assert r.skills == ["a"] and r.frameworks == []


def test_extract_fields_golden(spark):
    rows = [("Senior Data Scientist",
             "Requirements: 5+ years Python. Full-time remote position. Salary: $160,000–$200,000/year.", ""),
            ("Data Engineer (Contract)",
             "Must have Apache Airflow. 3–5 years required. Hybrid in Seattle, WA. $75–95/hr.", "")]
    df = spark.createDataFrame(rows, "title string, description string, qualifications string")
    got = [r.e for r in extract_fields(df).select(F.col("extraction").alias("e")).collect()]
    a, b = got
    assert (a.employment_type, a.attendance, a.seniority) == ("full-time", "remote", "senior")
    assert (a.experience_years_min, a.experience_years_max) == (5, None)
    assert (a.salary_min, a.salary_max, a.salary_currency, a.salary_period) == (160000, 200000, "USD", "yearly")
    assert (b.employment_type, b.attendance, b.seniority) == ("contract", "hybrid", "mid")
    assert (b.experience_years_min, b.experience_years_max) == (3, 5)
    assert (b.salary_min, b.salary_max, b.salary_currency, b.salary_period) == (75, 95, "USD", "hourly")


def test_token_sort_ratio():
    assert token_sort_ratio_py("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert token_sort_ratio_py("new york mets", "new york meats") == 96
    assert token_sort_ratio_py("", "") == 100 and token_sort_ratio_py("abc", "") == 0


def test_trigram_similarity(spark):
    r = spark.range(1).select(trigram_similarity(F.lit("word"), F.lit("two words"))).first()[0]
    assert abs(r - 0.363636) < 1e-5


def _plan(spark, rows):
    return spark.createDataFrame(rows, "kind string, id long, name string, action string, into_id long, into_name string")


def test_resolve_merge_chains(spark):
    rows = [
        ("skill", 1, "a", "merge", 2, "b"), ("skill", 2, "b", "merge", 3, "c"), ("skill", 3, "c", "promote", None, None),
        ("skill", 10, "x", "merge", 11, "y"), ("skill", 11, "y", "merge", 10, "x"),           # two-cycle
        ("skill", 12, "t", "merge", 10, "x"),                                                   # tail into cycle
        ("skill", 20, "p", "merge", 21, "q"), ("skill", 21, "q", "delete", None, None),         # ends in deleted
        ("framework", 1, "fa", "merge", 2, "fb"), ("framework", 2, "fb", "promote", None, None),  # same ids, other kind
        ("skill", 30, "u", "merge", 31, "v"), ("skill", 31, "v", "merge", 32, "w"), ("skill", 32, "w", "merge", 33, "z"),
    ]
    got = {(r.kind, r.id): (r.action, r.into_id) for r in C.resolve_merge_chains(_plan(spark, rows)).collect()}
    assert got[("skill", 1)] == ("merge", 3) and got[("skill", 2)] == ("merge", 3)
    assert got[("skill", 10)] == ("promote", None) and got[("skill", 11)] == ("promote", None)
    assert got[("skill", 12)] == ("merge", 10)
    assert got[("skill", 20)] == ("promote", None) and got[("skill", 21)] == ("delete", None)
    assert got[("framework", 1)] == ("merge", 2)
    assert got[("skill", 30)] == ("merge", 33) and got[("skill", 32)] == ("merge", 33)


def test_route_keywords_first_mention(spark):
    kw = spark.createDataFrame([(1, "skill", "SQL", None, 0, None), (2, "framework", "Spark", None, 0, None)],
                               "id long, kind string, name string, domain string, is_candidate int, user_level string")
    al = spark.createDataFrame([("skill", "structured query language", 1), ("framework", "pyspark", 2)],
                               "kind string, alias string, id long")
    m = spark.createDataFrame([(1, 1, "skill", "Foo"), (1, 2, "skill", "pyspark"), (2, 1, "framework", "foo"),
                               (2, 2, "framework", " sql "), (2, 3, "skill", "  ")],
                              "job_id long, pos int, tag string, raw_name string")
    res, cands = K.route_keywords(m, kw, al)
    got = {(r.job_id, r.pos): (r.kind, r.id) for r in res.collect()}
    assert got == {(1, 1): ("skill", 3), (1, 2): ("framework", 2), (2, 1): ("skill", 3), (2, 2): ("skill", 1)}
    assert [(r.kind, r.id, r.name) for r in cands.collect()] == [("skill", 3, "Foo")]


def test_dedup_fuzzy_order(spark):
    titles = {"A": "data engineer", "B": "data engineering", "C": "data engineering lead"}
    empty = spark.createDataFrame([], "title string, company_name string")

    def run(order):
        rows = [(i, titles[k], "Acme", "X") for i, k in enumerate(order)]
        df = spark.createDataFrame(rows, "seq long, title string, company_name string, location string")
        out = D.dedup_fuzzy(df, empty).collect()
        return {order[r.seq] for r in out if r.keep}

    assert run("ABC") == {"A", "C"}
    assert run("BAC") == {"B"}


def _py_trigrams(s):
    words = [w for w in re.split(r"[^0-9A-Za-zÀ-￿]+", (s or "").lower()) if w]
    return {("  " + w + " ")[i:i + 3] for w in words for i in range(len(w) + 1)}


def _py_greedy(rows, stored):
    kept = [(t, c) for t, c in stored]
    keep = {}
    for seq, t, c in sorted(rows):
        dup = False
        for kt, kc in kept:
            ga, gb = _py_trigrams(c), _py_trigrams(kc)
            if c and kc and ga | gb and len(ga & gb) / len(ga | gb) >= 0.3 and token_sort_ratio_py(
                    D_norm(t), D_norm(kt)) >= 85:
                dup = True
                break
        keep[seq] = not dup
        if not dup:
            kept.append((t, c))
    return keep


def D_norm(t):
    from joblake.functions.text import ABBREVIATIONS
    x = (t or "").lower()
    for p, r in ABBREVIATIONS:
        x = re.sub(p, r, x)
    x = re.sub(r"[^\w\s]", " ", x)
    return re.sub(r"\s+", " ", x).strip()


def test_dedup_fuzzy_matches_sequential_loop(spark):
    rnd = random.Random(5)
    words = ["data", "engineer", "senior", "analyst", "platform", "ml", "lead", "sr.", "cloud", "ops"]
    comps = ["Acme Inc", "Acme", "Globex", "Globex Corp", "Initech", "Umbrella"]
    rows = [(i, " ".join(rnd.sample(words, rnd.randint(2, 4))), rnd.choice(comps)) for i in range(60)]
    stored = [(" ".join(rnd.sample(words, 3)), rnd.choice(comps)) for _ in range(8)]
    df = spark.createDataFrame([(s, t, c, "X") for s, t, c in rows],
                               "seq long, title string, company_name string, location string")
    st = spark.createDataFrame(stored, "title string, company_name string")
    got = {r.seq: r.keep for r in D.dedup_fuzzy(df, st).collect()}
    assert got == _py_greedy(rows, stored)


def test_pages_array_object_error(spark, tmp_path):
    page1 = {"_query_name": "q1", "jobs_results": [{"title": "t1"}, {"title": "t2"}]}
    page2 = {"jobs_results": [{"title": "t3"}]}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "arr.json").write_text(json.dumps([page1, page2]))
    (tmp_path / "a" / "obj.json").write_text(json.dumps({"_query_name": "q2", "jobs_results": [{"title": "t4"}]}))
    got = sorted((r.query, r.title) for r in PG.scan_pages(spark, str(tmp_path / "a")).collect())
    assert got == [("q1", "t1"), ("q1", "t2"), ("q2", "t4"), ("unknown query", "t3")]
    landing = tmp_path / "land"
    landing.mkdir()
    lines = [{"query_name": "q", "page_no": i, "error": "boom" if i == 3 else None,
              "jobs_results": [{"title": f"p{i}"}]} for i in range(1, 6)]
    (landing / "p.json").write_text("\n".join(json.dumps(x) for x in lines))
    got = sorted(r.title for r in PG.scan_landing(spark, str(landing), max_pages=10).collect())
    assert got == ["p1", "p2"]
    assert [r.title for r in PG.scan_landing(spark, str(landing), max_pages=1).collect()] == ["p1"]


def test_expiry_boundaries(spark):
    jobs = spark.createDataFrame([(1, "active", "2024-03-01"), (2, "active", "2024-03-02"), (3, "applied", "2000-01-01")],
                                 "job_id long, status string, date_listed string").withColumn(
        "date_listed", F.col("date_listed").cast("date"))
    got = {r.job_id: r.status for r in CH.expire_jobs(jobs, "2024-03-31 09:00:00", 30).collect()}
    assert got == {1: "expired", 2: "active", 3: "applied"}  # exactly 30 days old expires
    apps = spark.createDataFrame([(1, "submitted", "2024-03-01"), (2, "submitted", "2024-02-29")],
                                 "application_id long, state string, date_applied string").withColumn(
        "date_applied", F.col("date_applied").cast("date"))
    got = {r.application_id: r.state for r in CH.expire_applications(apps, "2024-03-31").collect()}
    assert got == {1: "submitted", 2: "expired"}


def test_update_application_sparse(spark):
    apps = spark.createDataFrame([(1, "submitted", 0, "ai"), (2, "submitted", 0, "human")],
                                 "application_id long, state string, offer int, assistance_level string")
    ch = spark.createDataFrame([(1, ["state"], "offer", None), (2, ["assistance_level"], "rejected", None)],
                               "application_id long, set_fields array<string>, state string, assistance_level string")
    got = {r.application_id: (r.state, r.offer, r.assistance_level) for r in CH.update_application(apps, ch).collect()}
    assert got == {1: ("offer", 1, "ai"), 2: ("submitted", 0, None)}


def test_profile_sections(spark):
    md = "\n".join(["# Target Role", "Data engineer", "<!-- comment -->", "## Skills", "SQL, Spark",
                    "- Airflow", "### Tools", "dbt • Kafka", "# Skills", "Python"])
    rows = L.parse_profile(spark.createDataFrame([(1, md), (2, None), (3, "no heading")], "profile_id long, text string")).collect()
    r = {x.profile_id: x for x in rows}
    assert len(rows) == 3 and r[1].target_role == "Data engineer"
    assert r[1].skills == ["Python"]  # a repeated heading restarts its section
    assert r[1].frameworks == ["dbt", "Kafka"]
    assert r[2].skills == r[3].skills == [] and r[2].target_role == ""


def test_embedding_text_budget(spark):
    df = spark.createDataFrame([("t " * 10, "q " * 300, "r " * 200, ["s"] * 50, ["f"] * 50)],
                               "title string, qualifications string, responsibilities string, "
                               "skills array<string>, frameworks array<string>")
    text = df.select(L.compose_embedding_text(max_tokens=L.EMBEDDING_MAX_TOKENS).alias("x")).first().x
    parts = text.split(" | ")
    assert len(parts[0].split()) == 10 and len(parts[1].split()) == 300
    assert len(parts[2].split()) == 384 - 10 - 12 - 300 and parts[3] == "" and parts[4] == ""
    whole = df.select(L.compose_embedding_text().alias("x")).first().x.split(" | ")
    assert [len(p.split()) for p in whole] == [10, 300, 200, 50, 50]


def _pages_lines(tmp_path, pages):
    folder = tmp_path / "landing"
    folder.mkdir()
    for i, batch in enumerate(pages):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(p) for p in batch))
        os.utime(folder / f"{i}.json", (1_000_000 + i, 1_000_000 + i))  # the order of arrival
    return str(folder)


def _listing(i, title, company, text):
    return {"title": title, "company_name": company, "location": "X", "via": "v", "description": text, "job_id": f"eyJ{i}==",
            "detected_extensions": {"posted_at": "2 days ago"}}


def _landing(tmp_path):
    body = "Works with spark in Big Harbour Tools daily. " * 40
    page = lambda q, n, rows, err=None: {"query_name": q, "page_no": n, "error": err, "jobs_results": rows}
    return _pages_lines(tmp_path, [
        [page("a", 1, [_listing(1, "data engineer", "Acme", body), _listing(2, "数据工程师", "Acme", body)]),
         page("a", 2, [_listing(3, "data engineering", "Acme Inc", body), _listing(4, "会计", "Acme", body)]),
         page("a", 3, [_listing(5, "late", "Late", body)], "rate limited"), page("a", 4, [_listing(6, "later", "Later", body)])],
        [page("b", 1, [_listing(7, "data engineering lead", "Acme", body), _listing(8, "data engineer", "", body),
                       _listing(9, "data engineer", None, body), _listing(10, "Data Engineer", "Acme", body), _listing(11, "short", "S", "few")])]])


def test_stream_equals_batch(spark, tmp_path):
    from joblake.plans.ingest import ingest_batch
    from joblake.streaming import ingest_stream as S
    kw = spark.createDataFrame([(1, "framework", "Spark", None, 0, None)], "id long, kind string, name string, domain string, is_candidate int, user_level string")
    al = spark.createDataFrame([], "kind string, alias string, id long")
    landing = _landing(tmp_path)
    store, ckpt = str(tmp_path / "store"), str(tmp_path / "ckpt")
    S.stream_ingest(spark, landing, store, ckpt, kw, al, as_of="2001-08-01", max_files_per_trigger=1)
    got = {r.job_id: r for r in S.read_store(spark, store).collect()}

    pages = PG.landed_pages(PG.read_pages(spark, landing, PG.LANDED_PAGE, multiline=False), 10)
    batch = ingest_batch(S.number_listings(pages), spark.createDataFrame([], S.STORE_SCHEMA), kw, al, as_of="2001-08-01")
    assert {r.dedup_hash for r in got.values()} == {r.dedup_hash for r in batch.jobs.collect()}
    # greedy in order of arrival; other scripts and empty companies are kept, pages after a failed one and short texts are not read
    assert set(got) == {f"eyJ{i}==" for i in (1, 2, 4, 7, 8)}
    one = got["eyJ1=="]
    assert one.date_listed.isoformat() == "2001-07-30" and one.frameworks == ["Spark"] and one.skills == ["Big Harbour Tools"]
    assert json.loads(one.raw_json)["title"] == "data engineer" and len(one.embedding["indices"]) > 5
    assert {(r.kind, r.id) for r in S.read_junction(spark, store).where(F.col("dedup_hash") == one.dedup_hash).collect()} == {("framework", 1), ("skill", 2)}
    assert [(r.kind, r.id, r.name) for r in S.read_candidates(spark, store).collect()] == [("skill", 2, "Big Harbour Tools")]
    # a replay of the same files appends nothing
    S.stream_ingest(spark, landing, store, str(tmp_path / "ckpt2"), kw, al, as_of="2001-08-01")
    assert S.read_store(spark, store).count() == len(got) and S.read_junction(spark, store).count() == 2 * len(got)


def test_stream_raises_on_a_broken_store(spark, tmp_path):
    from joblake.streaming import ingest_stream as S
    (tmp_path / "store" / "jobs").mkdir(parents=True)
    (tmp_path / "store" / "jobs" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        S.read_store(spark, str(tmp_path / "store")).count()
    assert S.read_store(spark, str(tmp_path / "none")).count() == 0


def test_ingest_accounts_for_every_listing(spark, entry):
    from joblake.plans.bindings import Tables
    from joblake.plans.q_jobs import _ingest
    T = Tables(spark, "/root/testdata/sf0.001")
    r = _ingest(T)
    valid = L.filter_valid_listing(T.doc_listings)
    out = r.outcomes.collect()
    assert sorted(x.seq for x in out) == sorted(x.seq for x in valid.select("seq").collect())
    s = r.summary.first()
    assert s.inserted + s.duplicates + s.failed == len(out) and s.failed > 0 and s.inserted == r.jobs.count()
    assert r.quarantine.count() == s.failed and all(json.loads(x.raw_json)["description"] for x in r.quarantine.collect())
    assert r.jobs.where("t2_score is null or embedding is null").count() == 0
    assert r.tier3.join(r.jobs.where("status = 'active'"), "seq").count() == r.tier3.count()


def test_ingest_deep_scores_its_queue(spark):
    """F8: active listings from 70 on are scored in depth and their scores written; the others are not."""
    from joblake.plans.ingest import ingest_batch
    from joblake.streaming.ingest_stream import STORE_SCHEMA
    body = "Remote work with spark, 6 years of experience. " * 30
    rows = [(i, f"{name} engineer", f"{name} works", "X", "v", body) for i, name in enumerate(("azure", "birch", "cobalt", "dunes", "ember"))]
    listings = spark.createDataFrame(rows, "seq long, title string, company_name string, location string, via string, description string")
    kw = spark.createDataFrame([(1, "framework", "Spark", None, 0, None)], "id long, kind string, name string, domain string, is_candidate int, user_level string")
    al = spark.createDataFrame([], "kind string, alias string, id long")
    scores = spark.createDataFrame([(0, 90.0), (1, 70.0), (2, 69.0), (3, 40.0), (4, None)], "seq long, t2_score double")
    profile = spark.createDataFrame([(["spark"], "remote", "junior", None)], "profile_keywords array<string>, pref_attendance string, pref_seniority string, pref_salary int")
    store = spark.createDataFrame([], STORE_SCHEMA)
    r = ingest_batch(listings, store, kw, al, as_of="2001-08-01", scores=scores, profile=profile)
    # keywords 100 %, of the preferences attendance agrees and seniority does not: (0.8 + 0.2 * 0.5) * 100
    assert {x.seq: (x.t3_qualification, x.t3_fit, x.t3_score) for x in r.jobs.collect()} == {
        0: (100.0, 50.0, 90.0), 1: (100.0, 50.0, 90.0), **{i: (None, None, None) for i in (2, 3, 4)}}
    assert {(x.seq, x.t3_score) for x in r.tier3.collect()} == {(0, 90.0), (1, 90.0)}
    alone = ingest_batch(listings, store, kw, al, as_of="2001-08-01", scores=scores)  # no profile: the queue waits
    assert {(x.seq, x.t3_score) for x in alone.tier3.collect()} == {(0, None), (1, None)} and alone.jobs.where("t3_score is not null").count() == 0


def test_reprocess_replaces_embedding_last_wins(spark):
    jobs = spark.createDataFrame([(1, "h1", "old", [1.0]), (2, "h2", "old", [2.0])], "job_id long, dedup_hash string, description string, embedding array<double>")
    upd = spark.createDataFrame([("h1", "z first", [5.0], 1), ("h1", "a last", [6.0], 2)], "dedup_hash string, description string, embedding array<double>, at int")
    jk = spark.createDataFrame([(1, "skill", 3), (2, "skill", 4)], "job_id long, kind string, id long")
    new = spark.createDataFrame([("h1", "skill", 9)], "dedup_hash string, kind string, id long")
    out, jk2 = CH.reprocess_upsert(jobs, upd, jk, new, ["description", "embedding"], order="at")
    assert {r.job_id: (r.description, r.embedding) for r in out.collect()} == {1: ("a last", [6.0]), 2: ("old", [2.0])}
    assert {tuple(r) for r in jk2.collect()} == {(1, "skill", 9), (2, "skill", 4)}


def test_repeated_changes_do_not_repeat_rows(spark):
    jobs = spark.createDataFrame([(1, "active", None, None)], "job_id long, status string, t2_score double, t2_explanation string")
    sc = spark.createDataFrame([(1, 40.0, "a", 1), (1, 30.0, "b", 2)], "job_id long, t2_score double, t2_explanation string, at int")
    assert [(r.t2_score, r.t2_explanation) for r in CH.write_tier2(jobs, sc, order="at").collect()] == [(30.0, "b")]
    st = spark.createDataFrame([(1, "closed"), (1, "applied")], "job_id long, status string")
    assert CH.update_status(jobs, st, "2001-01-01")[0].count() == 1
    kw = spark.createDataFrame([("skill", 1, None)], "kind string, id long, user_level string")
    lv = spark.createDataFrame([("skill", 1, "Novice"), ("skill", 1, "Expert")], "kind string, id long, level string")
    assert C.set_level(kw, lv)[0].count() == 1


def test_dedup_fuzzy_keeps_what_it_cannot_compare(spark):
    rows = [(0, "数据工程师", "Acme"), (1, "会计", "Acme"), (2, "数据工程师", "Acme"), (3, "data engineer", ""), (4, "data engineer", None),
            (5, "data engineer", "--"), (6, "data engineer", "--"), (7, "", "Acme"), (8, None, "Acme")]
    df = spark.createDataFrame(rows, "seq long, title string, company_name string")
    out = D.dedup_fuzzy(df, spark.createDataFrame([("data engineer", "")], "title string, company_name string")).collect()
    assert {r.seq: r.keep for r in out} == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: True, 8: False}


def test_fuzzy_candidates_by_letters_and_by_bigrams(spark):
    """F2 F3 F4: companies of few titles are compared where they meet, larger ones by bigrams; no true pair is lost,
    and stored rows of other companies are not looked at."""
    import random
    from joblake.functions.text import token_sort_ratio_py
    rng = random.Random(5)
    words = "data senior engineer azure cloud web analyst lead".split()
    rows = [(i, float(i), "acme" if i % 3 else "acme inc", " ".join(sorted(rng.choices(words, k=rng.randint(0, 4)))) + "x" * rng.randint(0, 2)) for i in range(90)]
    df = spark.createDataFrame(rows, "rid long, order double, company_name string, tkey string")
    pairs = spark.createDataFrame([(a, b) for a in ("acme", "acme inc") for b in ("acme", "acme inc")], "a string, b string")
    true = {(r[0], c[0]) for r in rows for c in rows if c[1] < r[1] and token_sort_ratio_py(r[3], c[3]) >= D.FUZZY_THRESHOLD}
    for direct in (1000, 40, 0):
        found = [tuple(x) for x in D.fuzzy_candidates(df, pairs, direct=direct).select("r", "c").collect()]
        assert len(found) == len(set(found)) < 90 * 89 / 2 / 2 and true <= set(found)


def test_similar_company_deals_no_idle_grams(spark, monkeypatch):
    """F2 F3: a stored name is dealt only by trigrams that an incoming name has."""
    tables = {}
    real = D.scratch_table
    monkeypatch.setattr(D, "scratch_table", lambda df, name: tables.setdefault(name, real(df, name)))
    names = spark.createDataFrame([("blue harbour",), ("blue harbor",), ("zzz qqq",), (None,), ("--",)], "company_name string")
    got = D.similar_company(names, left=names.limit(1)).collect()
    assert [(r.a, r.b) for r in got] == [("blue harbor", "blue harbour")]
    idle = {r.name: (r.idle, r.n) for r in tables["name-grams"].collect()}
    assert idle["blue harbour"][0] == 0 and idle["zzz qqq"] == (8, 8) and set(idle) == {"blue harbour", "blue harbor", "zzz qqq"}


def test_sparse_entries_are_not_spread_out(spark):
    """entries come from the stored vector, without its zeros; dense and null vectors as well."""
    from pyspark.ml.linalg import Vectors
    from joblake.operators.vectors import sparse
    df = spark.createDataFrame([(0, Vectors.sparse(1 << 30, [3, 1 << 29], [2.0, 1.0])), (1, Vectors.sparse(5, [1, 4], [0.0, 3.0])), (2, Vectors.dense([0.0, 7.0])), (3, Vectors.sparse(4, [], []))], ["i", "v"])
    got = {r.i: (r.s.size, r.s.indices, r.s.values) for r in df.select("i", sparse("v").alias("s")).collect()}
    assert got == {0: (1 << 30, [3, 1 << 29], [2.0, 1.0]), 1: (5, [4], [3.0]), 2: (2, [1], [7.0]), 3: (4, [], [])}


def test_greedy_follows_long_chains_in_few_rounds(spark):
    n = 400
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, n)] + [(1000, -1), (1001, 1000)], "r long, c long")
    stats = {}
    dropped = {r.r for r in D.greedy_drops(edges, stats).collect()}
    assert dropped == set(range(1, n, 2)) | {1000} and stats["rounds"] <= 4


def test_scorer_failure_costs_one_row(spark):
    from joblake.operators import scoring as SC

    def fn(pdf):
        if (pdf["x"] == 13).any():
            raise ValueError("bad")
        return pd.DataFrame({"t2_score": pdf["x"] * 1.0, "t2_explanation": "ok"}, index=pdf.index)
    import pandas as pd
    out = SC.batch_score(spark.range(1000).select(F.col("id").alias("x")), fn).collect()
    assert len(out) == 1000 and [r.x for r in out if r.t2_score is None] == [13]
    assert all(r.t2_score == r.x for r in out if r.x != 13)


def test_parse_score_replies(spark):
    from joblake.operators import scoring as SC
    cases = {'{"score": 7, "explanation": "x"}': (7.0, "x"), '{\n "score": 7.9\n}': (7.0, ""), '{"score": -1.5}': (-1.0, ""), '{"explanation": "y"}': (0.0, "y"),
             '{"score": null}': (None, None), '{broken json}': (None, None), "text": (None, None), "[1]": (None, None), "": (None, None), '{"score": "8"}': (8.0, "")}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "r string")
    got = {r.r: (r.p.score, r.p.explanation) for r in df.select("r", SC.parse_score("r").alias("p")).collect()}
    assert got == {**cases, None: (None, None)}
    zero = {r.r: r.p.score for r in df.select("r", SC.parse_score("r", "zero").alias("p")).collect()}
    assert zero["text"] == 0 and zero['{"score": null}'] == 0 and zero['{"score": "8"}'] == 8


def test_block_product_does_not_depend_on_blocks(spark):
    from joblake.operators import vectors as V
    from joblake.plans.bindings import Tables
    T = Tables(spark, "/root/testdata/sf0.001")
    jobs = T.embeddings.select(F.col("vec_id").alias("job_id"), F.col("embedding").alias("vec"))
    q = T.embeddings.where("label = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))

    def run(jobs=jobs, q=q, **kw):
        r = V.top_k_by_dot(jobs, q, large_key="job_id", small_key="query_id", k=5, **kw)
        return {tuple(x) for x in r.select("query_id", "job_id", "rank").collect()}

    assert run() == run(query_block=8, large_block=50)
    as_sparse = F.struct(F.size("vec").alias("size"), F.sequence(F.lit(0), F.size("vec") - 1).alias("indices"), F.col("vec").alias("values"))
    assert run() == run(jobs.withColumn("vec", as_sparse), q.withColumn("vec", as_sparse))


def test_dense_ids_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("y").alias("y"))
    got = {r.x: r.new_id for r in K.dense_ids(df, ["x"], spark.range(1).select(F.lit(10).alias("s"))).collect()}
    assert got == {x: x + 11 for x in range(1000)}


def test_unknown_names(spark):
    kw = spark.createDataFrame([(1, "skill", "Known Tool")], "id long, kind string, name string")
    al = spark.createDataFrame([], "kind string, alias string, id long")
    df = spark.createDataFrame([(1, "We use Blue Harbour and Known Tool. This starts a sentence, with Blue Harbour again")], "job_id long, text string")
    assert [(r.pos, r.raw_name) for r in K.unknown_names(df, kw, al).collect()] == [(0, "Blue Harbour")]


def test_similar_company_pairs_meet_once(spark):
    from joblake.functions.text import trigrams
    rnd = random.Random(5)
    names = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))) + rnd.choice(["", ", Inc.", " co", " ünï"]) for _ in range(150)] + ["", "--", None, "a"]
    df = spark.createDataFrame([(n,) for n in names * 2], "company_name string")
    grams = {r.company_name: set(r.g) for r in df.where("company_name is not null").select("company_name", trigrams("company_name").alias("g")).collect() if r.g}
    real = sorted(grams)
    want = {(a, b) for a in real for b in real if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.3}
    got = D.similar_company(df)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)
    some = set(real[::3])
    left = D.similar_company(df, left=spark.createDataFrame([(n,) for n in some], "company_name string"))
    assert sorted((r.a, r.b) for r in left.collect()) == sorted(p for p in want if some & set(p))
    # no table of candidate pairs is made different: a pair comes out of the join once
    assert not re.search(r"Aggregate \[a#\d+, b#\d+", got._jdf.queryExecution().optimizedPlan().toString())


def test_plan_behind_a_chain_is_computed_once(spark):
    rows = [("skill", i, f"n{i}", "merge" if i % 3 else "delete" if i % 2 else "promote", i - 1 if i % 3 else None, None) for i in range(1, 40)]
    read = spark.sparkContext.accumulator(0)

    def counted(it):
        for pdf in it:
            read.add(len(pdf))
            yield pdf
    schema = "kind string, id long, name string, action string, into_id long, into_name string"
    assert C.resolve_merge_chains(spark.createDataFrame(rows, schema).mapInPandas(counted, schema)).count() == len(rows)
    assert read.value == len(rows)


def test_block_product_deals_a_row_a_fixed_number_of_times(spark):
    from joblake.operators import vectors as V
    for n in (70_000, 300_000):
        r = spark.range(n).select("id", F.array(F.rand(1), F.rand(2)).alias("vec"))
        assert V._blocks(r, "vec", None, V.LARGE_BLOCK).first()["n"] == V.GRID
    wide = spark.range(40).select("id", F.sequence(F.lit(1), F.lit(1_000_000)).alias("vec"))
    assert V._blocks(wide, "vec", None, V.LARGE_BLOCK).first()["n"] == -(-40_000_000 // V.BLOCK_ENTRIES)


def test_block_product_in_chunks_of_a_block(spark, monkeypatch):
    from joblake.operators import vectors as V
    rnd = random.Random(8)
    sparse = [(i, {"size": 600, "indices": (ix := sorted(rnd.sample(range(600), 5))), "values": [float(rnd.randint(1, 2)) for _ in ix]}) for i in range(9_000)]
    df = spark.createDataFrame(sparse, "id long, vec struct<size:int,indices:array<int>,values:array<double>>").cache()
    q = spark.createDataFrame(sparse[:20], "qid long, vec struct<size:int,indices:array<int>,values:array<double>>")

    def run(**how):
        got = V.top_k_by_dot(df, q, large_key="id", small_key="qid", k=6, cosine=False, exclude_self=True, **how).collect()
        return sorted((r.qid, r["rank"], r.id, r.similarity) for r in got)
    vecs = [dict(zip(v["indices"], v["values"])) for _, v in sparse]
    want = []
    for a in range(20):
        near = sorted((-sum(x * vecs[b].get(i, 0.0) for i, x in vecs[a].items()), b) for b in range(9_000) if b != a)[:6]
        want += [(a, r, b, -s) for r, (s, b) in enumerate(near, 1)]
    assert run(large_block=10_000) == run() == want


def test_scorer_failures_leave_one_frame_a_batch(spark):
    from unittest import mock
    import pandas as pd
    from joblake.operators import scoring as SC

    def fn(pdf):
        if (pdf["id"] % 10 == 7).any():
            raise ValueError("no reply")
        return pd.DataFrame({"t2_score": pdf["id"] * 1.0, "t2_explanation": "ok"})
    taken = []
    with mock.patch("pyspark.sql.classic.dataframe.DataFrame.mapInPandas", lambda self, f, schema: taken.append(f) or self.select("id", F.lit(0.0).alias("t2_score"))):
        SC.batch_score(spark.range(1), fn)
    frames = list(taken[0](iter([pd.DataFrame({"id": range(100)}), pd.DataFrame({"id": range(100, 130)})])))
    assert [len(f) for f in frames] == [100, 30] and list(frames[0]["id"]) == list(range(100))
    assert list(frames[1]["t2_score"].isna()) == [i % 10 == 7 for i in range(100, 130)]


def test_reprocess_hashes_the_snapshot_once(spark, entry):
    """The hash is computed before the joins, not again at each of them."""
    out = entry.queries()["reprocess_upsert"](spark, "/root/testdata/sf0.001")
    assert "sha2" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("status = 'active' and description like 'reprocessed: %'").count() > 0


def test_abbreviations_are_found_where_a_rewrite_would(spark):
    from joblake.functions import text as TX
    texts = ["Sr. Eng", "sr.x", "x.sr", "sr_", "isr", "Eng.", "dev.ops", "Acme, Inc.", "inc", "Incorporated", "plain  words!", "jr-dev", "数据 sr", "vp2", "a.eng.b", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    x = F.lower(F.coalesce(F.col("t"), F.lit("")))
    for pat, rep in TX.ABBREVIATIONS:
        x = F.regexp_replace(x, pat, rep)
    x = F.trim(F.regexp_replace(F.regexp_replace(x, TX.PUNCT, " "), r"\s+", " "))
    assert all(r.a == r.b for r in rows.select(TX.normalise_text("t").alias("a"), x.alias("b")).collect())
    rewritten = rows.where(F.lower("t").rlike(TX.ANY_ABBREVIATION)).count()
    assert rewritten == sum(any(re.search(p, (t or "").lower()) for p, _ in TX.ABBREVIATIONS) for t in texts)
