"""Kept keyword sums against the whole query, after any sequence of changes."""

import os
import random

import pytest

from joblake.operators import analytics as A
from joblake.operators.market_state import KeptMarket

JOB = "job_id long, status string, t3_score int, t3_fit int, t3_qualification int, salary_max int, salary_period string, date_listed date"
LINK = "job_id long, kind string, id long"


def a_job(rng, i):
    return (i, rng.choice(["active", "active", "applied", "expired", None]), rng.choice([None, 70, 80]), rng.choice([None, 10, 33, 77]),
            rng.choice([None, 49, 50, 79, 80]), rng.choice([None, 90_000, 123_457]), rng.choice(["yearly", "hourly", None]), None)


def plain(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_kept_sums_equal_the_whole_query(spark, tmp_path):
    rng = random.Random(5)
    # ids that stand in both kinds, and a keyword without a listing
    keywords = spark.createDataFrame([(k, i, f"{k} {i}", lv, i % 4 == 3) for k in ("skill", "framework") for i, lv in enumerate(["Novice", "Expert", None, "Novice", "Novice"])],
                                     "kind string, id long, name string, user_level string, c boolean").selectExpr("kind", "id", "name", "user_level", "cast(c as int) as is_candidate")
    jobs, links = {}, {}
    kept = KeptMarket(spark, str(tmp_path))
    assert kept.market(keywords).count() == 0

    def rows(ids, table, ddl, many=False):
        return spark.createDataFrame([r for i in sorted(ids) if i in table for r in (table[i] if many else [table[i]])], ddl)

    for batch in range(4):
        ids = set(range(30)) if batch == 0 else set(rng.sample(range(40), 9))
        before, links_before = rows(ids, jobs, JOB), rows(ids, links, LINK, True)
        for i in ids:
            if batch and rng.random() < 0.2:  # deleted
                jobs.pop(i, None), links.pop(i, None)
            else:
                jobs[i] = a_job(rng, i)
                links[i] = [(i, k, x) for k in ("skill", "framework") for x in rng.sample(range(4), 2)]
        args = before, rows(ids, jobs, JOB), links_before, rows(ids, links, LINK, True)
        kept.apply(batch, *args)
        if batch == 1:
            kept.apply(batch, *args)  # a replay
            kept.fold()
        whole = A.keyword_market(rows(jobs, jobs, JOB), keywords, rows(links, links, LINK, True))
        assert plain(kept.market(keywords)) == plain(whole)
    assert plain(kept.market(keywords, show_candidates=True, name="skill", min_jobs=1)) == plain(
        A.keyword_market(rows(jobs, jobs, JOB), keywords, rows(links, links, LINK, True), show_candidates=True, name="skill", min_jobs=1))

    want = plain(kept.market(keywords))
    with pytest.raises(ValueError):
        kept.apply(1, *args)
    kept.apply(9, *args)  # written, but not finished
    os.remove(f"{kept.path}/deltas/batch=9/_SUCCESS")
    assert plain(kept.market(keywords)) == want
    nothing = rows((), jobs, JOB)
    kept.apply(10, nothing, nothing, rows((), links, LINK, True))
    kept.fold()
    assert plain(kept.market(keywords)) == want
