"""Snapshot changes on the listing and application bindings (queries + oracles).
Change frames are derived from the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblake.operators import changes as CH
from joblake.plans.registry import register
from joblake.session import scratch_path
from joblake.sources.bucket_store import BucketStore

_NOW = "2001-08-01 12:00:00"


@register("expire_jobs", f"""
SELECT job_id, CASE WHEN status = 'active' AND CAST(date_listed AS TIMESTAMP) < TIMESTAMP '{_NOW}' - INTERVAL 30 DAY
                    THEN 'expired' ELSE status END AS status
FROM b_jobs
""")
def expire_jobs(T):
    return CH.expire_jobs(T.jobs.select("job_id", "status", "date_listed"), _NOW, 30).select("job_id", "status")


@register("expire_applications", """
SELECT application_id, CASE WHEN state = 'submitted' AND date_applied < DATE '2001-08-01' - INTERVAL 30 DAY
                            THEN 'expired' ELSE state END AS state
FROM b_applications
""")
def expire_applications(T):
    return CH.expire_applications(T.applications, "2001-08-01").select("application_id", "state")


_STATUS_SQL = f"""
WITH ch AS (SELECT job_id, CASE job_id % 20 WHEN 0 THEN 'closed' WHEN 1 THEN 'bogus' ELSE 'bad_fit' END AS status
            FROM b_jobs WHERE job_id % 10 = 0 OR job_id % 20 = 1),
ok AS (SELECT * FROM ch WHERE status IN ('active', 'applied', 'expired', 'closed', 'bad_listing', 'bad_fit'))
SELECT j.job_id, coalesce(ok.status, j.status) AS status,
       CASE WHEN ok.status IS NOT NULL THEN TIMESTAMP '{_NOW}' END AS date_updated
FROM b_jobs j LEFT JOIN ok ON j.job_id = ok.job_id
"""


def _status_changes(jobs):
    return jobs.where((F.col("job_id") % 10 == 0) | (F.col("job_id") % 20 == 1)).select(
        "job_id", F.when(F.col("job_id") % 20 == 0, "closed").when(F.col("job_id") % 20 == 1, "bogus")
        .otherwise("bad_fit").alias("status"))


@register("update_status", _STATUS_SQL)
def update_status(T):
    jobs = T.jobs.select("job_id", "status")
    out, _ = CH.update_status(jobs, _status_changes(jobs), _NOW)
    return out.select("job_id", "status", "date_updated")


@register("update_status_stored", _STATUS_SQL)
def update_status_stored(T):
    """The same change on a stored table: only the buckets touched are rewritten."""
    jobs = T.jobs.select("job_id", "status", F.lit(None).cast("timestamp").alias("date_updated"))
    store = BucketStore(jobs.sparkSession, scratch_path(jobs.sparkSession, "listings"), "job_id")
    store.create(jobs)
    changes = _status_changes(jobs)
    store.update(changes, lambda rows: CH.update_status(rows, changes, _NOW)[0])
    return store.read().select("job_id", "status", "date_updated")


@register("write_tier2", """
SELECT j.job_id, coalesce(s.t2_score, j.t2_score) AS t2_score, s.t2_explanation
FROM b_jobs j LEFT JOIN (
  SELECT job_id, CAST((job_id * 31) % 101 AS DOUBLE) AS t2_score, 'scored by rule' AS t2_explanation
  FROM b_jobs WHERE t2_score IS NULL) s ON j.job_id = s.job_id
""")
def write_tier2(T):
    jobs = T.jobs.select("job_id", "t2_score")
    s = jobs.where(F.col("t2_score").isNull()).select(
        "job_id", ((F.col("job_id") * 31) % 101).cast("double").alias("t2_score"),
        F.lit("scored by rule").alias("t2_explanation"))
    return CH.write_tier2(jobs, s).select("job_id", "t2_score", "t2_explanation")


@register("write_tier3", """
SELECT j.job_id, coalesce(s.q, j.t3_qualification) AS t3_qualification, coalesce(s.f, j.t3_fit) AS t3_fit,
       coalesce(s.sc, j.t3_score) AS t3_score
FROM b_jobs j LEFT JOIN (
  SELECT job_id, CAST(50 AS DOUBLE) AS q, CAST(60 AS DOUBLE) AS f, CAST(44.8 AS DOUBLE) AS sc
  FROM b_jobs WHERE t3_score IS NULL AND status = 'active') s ON j.job_id = s.job_id
""")
def write_tier3(T):
    jobs = T.jobs.select("job_id", "status", "t3_qualification", "t3_fit", "t3_score")
    s = jobs.where(F.col("t3_score").isNull() & (F.col("status") == "active")).select(
        "job_id", F.lit(50.0).alias("t3_qualification"), F.lit(60.0).alias("t3_fit"), F.lit(44.8).alias("t3_score"))
    return CH.write_scores(jobs, s, ["t3_qualification", "t3_fit", "t3_score"]).select(
        "job_id", "t3_qualification", "t3_fit", "t3_score")


@register("create_application", f"""
WITH new AS (SELECT job_id AS seq, job_id, DATE '2001-08-01' AS date_applied,
                    CASE WHEN job_id % 3 = 0 THEN 'robot' ELSE 'human' END AS assistance_level
             FROM b_jobs WHERE status = 'active' AND t2_score >= 95),
good AS (SELECT *, (SELECT max(application_id) FROM b_applications) + row_number() OVER (ORDER BY seq) AS application_id
         FROM new WHERE assistance_level IN ('ai', 'assisted', 'human'))
SELECT j.job_id, coalesce(g.application_id, j.application_id) AS application_id,
       CASE WHEN g.application_id IS NOT NULL THEN 'applied' ELSE j.status END AS status
FROM b_jobs j LEFT JOIN good g ON g.job_id = j.job_id
""")
def create_application(T):
    jobs = T.jobs.select("job_id", "status", "t2_score", "application_id")
    new = jobs.where((F.col("status") == "active") & (F.col("t2_score") >= 95)).select(
        F.col("job_id").alias("seq"), "job_id", F.lit("2001-08-01").cast("date").alias("date_applied"),
        F.when(F.col("job_id") % 3 == 0, "robot").otherwise("human").alias("assistance_level"))
    _, j, _ = CH.create_application(T.applications, jobs, new, _NOW)
    return j.select("job_id", "application_id", "status")


@register("update_application", """
SELECT a.application_id,
  CASE WHEN a.application_id % 5 = 0 THEN 'offer' WHEN a.application_id % 5 = 1 THEN 'interviewing' ELSE a.state END AS state,
  CASE WHEN a.application_id % 5 = 0 THEN 1 ELSE a.offer END AS offer,
  CASE WHEN a.application_id % 5 = 1 THEN NULL ELSE a.assistance_level END AS assistance_level,
  a.interviews
FROM b_applications a
""")
def update_application(T):
    apps = T.applications
    aid = F.col("application_id")
    ch = apps.where((aid % 5 == 0) | (aid % 5 == 1)).select(
        "application_id",
        F.when(aid % 5 == 0, F.array(F.lit("state"), F.lit("not_a_field")))
        .otherwise(F.array(F.lit("state"), F.lit("assistance_level"))).alias("set_fields"),
        F.when(aid % 5 == 0, "offer").otherwise("interviewing").alias("state"),
        F.lit(None).cast("string").alias("assistance_level"),
        F.lit(99).alias("interviews"))
    return CH.update_application(apps, ch).select("application_id", "state", "offer", "assistance_level", "interviews")


@register("coerce_form_fields", """
SELECT event_id,
  CASE WHEN regexp_matches(trim(raw), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(raw) AS INTEGER) ELSE 0 END AS cold_calls,
  CASE WHEN raw IN ('1', 'true', 'on', 'yes') THEN 1 ELSE 0 END AS offer,
  CASE WHEN raw IS NULL OR raw = '' THEN NULL ELSE TRY_CAST(trim(raw) AS DOUBLE) END AS effort
FROM (SELECT event_id,
        CASE event_type WHEN 'view' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
             WHEN 'click' THEN 'yes' WHEN 'signup' THEN CAST(round(value, 2) AS VARCHAR)
             WHEN 'error' THEN '' ELSE 'n/a' END AS raw FROM events) e
""")
def coerce_form_fields(T):
    ev = T.events
    raw = (F.when(F.col("event_type") == "view", F.floor("value").cast("bigint").cast("string"))
           .when(F.col("event_type") == "click", "yes")
           .when(F.col("event_type") == "signup", F.round("value", 2).cast("string"))
           .when(F.col("event_type") == "error", "").otherwise("n/a"))
    e = ev.select("event_id", raw.alias("raw"))
    return e.select("event_id", CH.coerce_int("raw").alias("cold_calls"), CH.coerce_flag("raw").alias("offer"),
                    CH.coerce_effort("raw").alias("effort"))


@register("backfill_state", """
SELECT application_id, coalesce(state, CASE WHEN offer = 1 THEN 'offer' ELSE 'submitted' END) AS state
FROM b_applications
""")
def backfill_state(T):
    return CH.backfill_state(T.applications).select("application_id", "state")
