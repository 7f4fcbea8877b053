"""Dictionary terms in texts against looking for every term at every word."""

import random

import pytest
from pyspark.sql import functions as F

from joblake.operators import automaton as A
from joblake.operators import keywords as K

WORDS = ["a", "b", "c", "c++", "d"]


def plain_hits(terms, words):
    return sorted((i, len(t), n) for t, n in terms for i in range(len(words)) if words[i:i + len(t)] == t)


def plain_longest(hits):
    best = {}
    for i, n, _ in hits:
        for p in range(i, i + n):
            best[p] = max(best.get(p, 0), n)
    return sorted(h for h in hits if max(best[p] for p in range(h[0], h[0] + h[1])) == h[1])


def cases(rng):
    terms = {tuple(rng.choice(WORDS) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))}
    return [(list(t), n) for n, t in enumerate(sorted(terms))], [[rng.choice(WORDS) for _ in range(rng.randrange(30))] for _ in range(4)]


def test_hits_and_longest_equal_plain_loops():
    rng = random.Random(1)
    for _ in range(200):
        terms, texts = cases(rng)
        automaton = A.WordAutomaton(terms)
        for words in texts:
            hits = automaton.hits(words)
            assert sorted(hits) == plain_hits(terms, words)
            assert sorted(A.longest(hits)) == plain_longest(hits)


@pytest.mark.parametrize("shard", [1 << 20, 5])
def test_shards_give_the_same(spark, shard):
    rng = random.Random(2)
    terms, texts = cases(rng)
    texts += [[], ["a"] * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, t array<string>")
    got = A.find_terms(rows, spark.createDataFrame(terms, "words array<string>, t long"), shard).collect()
    want = {i: plain_longest(plain_hits(terms, t)) for i, t in enumerate(texts)}
    assert {r.row: sorted(map(tuple, r.hits)) for r in got} == {i: h for i, h in want.items() if h}
    assert A.find_terms(rows, spark.createDataFrame([], "words array<string>, t long"), shard).count() == 0


def test_keywords_of_texts(spark):
    kw = spark.createDataFrame([("skill", 1, "Big Data"), ("framework", 1, "big data"), ("skill", 2, "Data"), ("skill", 3, "C++"), ("skill", 4, "--"),
                                ("skill", 5, " ".join(["very"] * 60))], "kind string, id long, name string")
    al = spark.createDataFrame([("skill", "BD", 1)], "kind string, alias string, id long")
    texts = spark.createDataFrame([("x", "Data, big-data; c++ bd"), ("y", None), ("z", ""), ("w", "very " * 61), ("x", "data")], "job_id string, text string")
    got = sorted((r.job_id, r.kind, r.id, r.first_pos) for r in K.extract_keywords(texts, kw, al).collect())
    assert got == [("w", "skill", 5, 0), ("x", "framework", 1, 1), ("x", "skill", 1, 1), ("x", "skill", 2, 0), ("x", "skill", 3, 3)]


def test_ids_of_two_kinds_do_not_mix(spark):
    from joblake.operators import analytics as AN
    from joblake.operators import joins as J
    kw = spark.createDataFrame([("skill", 1, "Go", 0, None), ("framework", 1, "Docker", 0, None), ("framework", 2, "Vim", 1, None)],
                               "kind string, id long, name string, is_candidate int, user_level string")
    jk = spark.createDataFrame([(10, "skill", 1), (11, "framework", 1), (11, "skill", 1), (11, "framework", 2), (12, "skill", 2)], "job_id long, kind string, id long")
    jobs = spark.createDataFrame([(j, "active", None, 50.0, 60.0, 55.0, 100, "yearly") for j in (10, 11, 12)],
                                 "job_id long, status string, application_id long, t3_qualification double, t3_fit double, t3_score double, salary_max int, salary_period string")
    apps = spark.createDataFrame([], "application_id long, state string, date_applied date, assistance_level string, cold_calls int, reached_human int, interviews int, offer int")
    assert {(r.job_id, tuple(r.skills), tuple(r.frameworks)) for r in J.job_detail(jobs, apps, kw, jk).collect()} == {
        (10, ("Go",), ()), (11, ("Go",), ("Docker",)), (12, (), ())}
    assert {(r.job_id, r.name) for r in J.keyword_jobs(kw, jk, jobs).collect()} == {(10, "Go"), (11, "Go"), (11, "Docker"), (11, "Vim")}
    assert [(r.name, r.job_count) for r in AN.candidate_usage(kw, jk).collect()] == [("Vim", 1)]
    jobs = jobs.withColumn("date_listed", F.lit("2001-01-01").cast("date"))
    assert {(r.name, r.raw_count) for r in AN.keyword_market(jobs, kw, jk, listing_mode="all", min_jobs=1).collect()} == {("Go", 2), ("Docker", 1)}


def test_a_name_may_be_in_both_kinds(spark, tmp_path):
    from joblake.schemas import KEYWORDS
    from joblake.sources import taxonomy as TX
    (tmp_path / "skills.csv").write_text("domain,core_competency,competency,skill\nops,,,Docker\nlang,,,Go\nlang,,,Old\n")
    have = spark.createDataFrame([(1, "framework", "Docker", "ops", None, None, 0, None), (2, "skill", "Old", "x", None, None, 0, None)], KEYWORDS)
    got = TX.scan_taxonomy(spark, str(tmp_path / "skills.csv"), "skill", have).collect()
    assert [(r.id, r.kind, r.name) for r in sorted(got, key=lambda r: r.id)] == [(1, "framework", "Docker"), (2, "skill", "Old"), (3, "skill", "Docker"), (4, "skill", "Go")]


def test_bad_pages_are_rejected_not_lost(spark, tmp_path):
    from joblake.sources import pages as PG
    land = tmp_path / "land"
    land.mkdir()
    (land / "p.json").write_text('{"query_name":"q","page_no":1,"jobs_results":[{"title":"one","new":1}],"extra":{}}\n{"query_name":"q","page_no":2,"jobs_res\n\n'
                                 '[1]\n{"page_no":"two"}\n{"query_name":"q","page_no":4,"error":null,"jobs_results":[{"title":"four"}]}\n')
    pages, bad = PG.read_landing(spark, str(land))
    assert sorted(r.title for r in PG.explode_listings(pages).collect()) == ["four", "one"]
    assert sorted(r.reason for r in bad.collect()) == ["not JSON", "not an object", "page_no is of another type"]
    assert all(r.file.endswith("p.json") and r.record for r in bad.collect())
    (tmp_path / "saved").mkdir()
    (tmp_path / "saved" / "a.json").write_text('[{"_query_name":"q","jobs_results":[{"title":"t"}]}]')
    (tmp_path / "saved" / "b.json").write_text('{"_query_name":"q","jobs_res')
    pages, bad = PG.read_page_files(spark, str(tmp_path / "saved"))
    assert [r.title for r in PG.explode_listings(pages).collect()] == ["t"]
    assert [(r.file.endswith("b.json"), r.reason) for r in bad.collect()] == [(True, "not JSON")]
