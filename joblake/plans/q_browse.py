"""Listing browser and application tracker: filters, joins, pages, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblake.functions import scores as S
from joblake.operators import filters as FL
from joblake.operators import joins as J
from joblake.operators import paging as P
from joblake.plans.bindings import AS_OF_DATE, AS_OF_EVENTS
from joblake.plans.registry import register

_JOB_COLS = ", ".join(J.JOB_ROW)


@register("filter_jobs", f"""
SELECT {_JOB_COLS} FROM b_jobs
WHERE status IN ('active', 'applied') AND t2_score >= 40 AND seniority IN ('senior', 'lead', 'junior')
  AND attendance IN ('remote', 'hybrid') AND location ILIKE '%a%' AND title ILIKE '%s%'
  AND company_name ILIKE '%customer#%'
  AND (description ILIKE '%steel%' OR qualifications ILIKE '%steel%' OR responsibilities ILIKE '%steel%')
  AND date_listed >= DATE '1996-01-01' AND date_listed <= DATE '2000-12-31'
  AND application_id IS NOT NULL
""")
def filter_jobs(T):
    """Every predicate of the listing browser at once; the internal status
    passed in is stripped."""
    return FL.filter_jobs(
        T.jobs.select(*J.JOB_ROW), statuses=["active", "applied", "extraction_failed"], t2_min=40,
        seniority=["senior", "lead", "junior"], attendance=["remote", "hybrid"], location="a",
        title="s", company="customer#", description="steel", date_from="1996-01-01",
        date_to="2000-12-31", has_application=True)


@register("filter_jobs_default", f"SELECT {_JOB_COLS} FROM b_jobs WHERE status = 'active' AND application_id IS NULL")
def filter_jobs_default(T):
    """No status → active; has_application False."""
    return FL.filter_jobs(T.jobs.select(*J.JOB_ROW), has_application=False)


_APPS_WITH_JOB = """
SELECT a.*, j.title AS job_title, j.company_name, j.location, j.salary_min, j.salary_max,
       j.salary_currency, j.salary_period, j.t2_score, j.t3_score, j.url AS job_url, j.status AS job_status
FROM b_applications a JOIN b_jobs j ON a.job_id = j.job_id
"""


@register("applications_with_job", _APPS_WITH_JOB)
def applications_with_job(T):
    return J.applications_with_job(T.applications, T.jobs)


@register("filter_applications", f"""
SELECT * FROM ({_APPS_WITH_JOB}) x
WHERE state IN ('submitted', 'interviewing', 'offer') AND date_applied >= DATE '1995-06-01'
  AND date_applied <= DATE '2000-06-30' AND company_name ILIKE '%00001%'
  AND assistance_level IN ('ai', 'human') AND offer = 0
""")
def filter_applications(T):
    return FL.filter_applications(
        J.applications_with_job(T.applications, T.jobs), states=["submitted", "interviewing", "offer"],
        date_from="1995-06-01", date_to="2000-06-30", company="00001", assistance=["ai", "human"],
        has_offer=False)


@register("filter_keywords", """
SELECT job_id, status, date_listed, t3_score FROM b_jobs
WHERE t3_score IS NOT NULL AND status IN ('active', 'applied', 'closed', 'expired')
  AND date_listed >= DATE '1997-01-01' AND date_listed <= DATE '1999-12-31'
""")
def filter_keywords(T):
    return FL.filter_keywords(T.jobs.select("job_id", "status", "date_listed", "t3_score"),
                              listing_mode="all", date_from="1997-01-01", date_to="1999-12-31")


@register("filter_by_ids", """
SELECT job_id, title, status FROM b_jobs
WHERE job_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)
""")
def filter_by_ids(T):
    ids = T.lineitem.where(F.col("l_quantity") >= 49).select(F.col("l_orderkey").alias("job_id"))
    return FL.filter_by_ids(T.jobs.select("job_id", "title", "status"), ids)


@register("filter_recent", f"""
SELECT job_id, date_listed FROM b_jobs WHERE date_listed >= DATE '{AS_OF_DATE}' - INTERVAL 30 DAY
""")
def filter_recent(T):
    return FL.filter_recent(T.jobs.select("job_id", "date_listed"), AS_OF_DATE, mode="backfill")


@register("filter_recent_daily", f"""
SELECT job_id, date_listed FROM b_jobs WHERE date_listed >= DATE '{AS_OF_DATE}' - INTERVAL 1 DAY
""")
def filter_recent_daily(T):
    return FL.filter_recent(T.jobs.select("job_id", "date_listed"), AS_OF_DATE, mode="daily")


@register("filter_t3_scored", """
SELECT job_id, status, t2_score, t3_score FROM b_jobs
WHERE t3_score IS NOT NULL AND status IN ('active', 'expired')
""")
def filter_t3_scored(T):
    return FL.filter_t3_scored(T.jobs.select("job_id", "status", "t2_score", "t3_score"),
                               active_only=False, statuses=["active", "expired"])


@register("jobs_with_application", f"""
SELECT {", ".join("j." + c for c in J.JOB_ROW)}, a.state AS application_state
FROM b_jobs j LEFT JOIN b_applications a ON j.application_id = a.application_id
""")
def jobs_with_application(T):
    return J.jobs_with_application(T.jobs, T.applications)


@register("job_detail", """
WITH names AS (
  SELECT jk.job_id,
         list_sort(list(k.name) FILTER (WHERE k.kind = 'skill')) AS skills,
         list_sort(list(k.name) FILTER (WHERE k.kind = 'framework')) AS frameworks
  FROM b_job_keywords jk JOIN b_keywords k ON jk.id = k.id
  WHERE k.is_candidate = 0 GROUP BY jk.job_id)
SELECT j.*, a.state AS application_state, a.date_applied, a.assistance_level, a.cold_calls,
       a.reached_human, a.interviews, a.offer,
       coalesce(n.skills, CAST([] AS VARCHAR[])) AS skills,
       coalesce(n.frameworks, CAST([] AS VARCHAR[])) AS frameworks
FROM b_jobs j LEFT JOIN b_applications a ON j.application_id = a.application_id
LEFT JOIN names n ON j.job_id = n.job_id
""")
def job_detail(T):
    return J.job_detail(T.jobs, T.applications, T.keywords, T.job_keywords)


@register("latest_application", """
SELECT * EXCLUDE (rn) FROM (
  SELECT a.*, row_number() OVER (PARTITION BY job_id ORDER BY application_id DESC) AS rn
  FROM b_applications a) x WHERE rn = 1
""")
def latest_application(T):
    return J.latest_application(T.applications)


@register("page_jobs", f"""
SELECT {_JOB_COLS} FROM b_jobs WHERE status IN ('active', 'expired')
ORDER BY t3_score DESC NULLS LAST, job_id LIMIT 50 OFFSET 50
""")
def page_jobs(T):
    jobs = FL.filter_jobs(T.jobs.select(*J.JOB_ROW), statuses=["active", "expired"])
    return P.page_jobs(jobs, sort="t3_score", page=2, page_size=50)


@register("page_jobs_salary", f"""
SELECT {_JOB_COLS} FROM b_jobs WHERE status = 'active'
ORDER BY salary_max DESC NULLS LAST, job_id LIMIT 25
""")
def page_jobs_salary(T):
    return P.page_jobs(FL.filter_jobs(T.jobs.select(*J.JOB_ROW)), sort="salary_max", page=1, page_size=25)


@register("page_applications", f"""
SELECT * FROM ({_APPS_WITH_JOB}) x
ORDER BY CASE state WHEN 'offer' THEN 0 WHEN 'interviewing' THEN 1 WHEN 'submitted' THEN 2
         WHEN 'rejected' THEN 3 ELSE 4 END, application_id LIMIT 40 OFFSET 80
""")
def page_applications(T):
    return P.page_applications(J.applications_with_job(T.applications, T.jobs), sort="state",
                               page=3, page_size=40)


@register("all_applications", f"SELECT * FROM ({_APPS_WITH_JOB}) x ORDER BY date_applied DESC NULLS LAST, application_id DESC")
def all_applications(T):
    return P.all_applications(J.applications_with_job(T.applications, T.jobs))


@register("top_scored", """
SELECT job_id, title, t2_score, t3_qualification FROM b_jobs
WHERE status = 'active' AND t2_score IS NOT NULL AND t2_score >= 60 AND t3_qualification IS NULL
ORDER BY t2_score DESC, job_id LIMIT 20
""")
def top_scored(T):
    return P.top_scored(T.jobs.select("job_id", "title", "t2_score", "t3_qualification", "status"),
                        20, 60).drop("status")


@register("tier2_top", """
SELECT job_id, t2_score FROM b_jobs WHERE status = 'active'
ORDER BY t2_score DESC NULLS LAST, job_id LIMIT 15
""")
def tier2_top(T):
    return P.tier2_top(FL.filter_jobs(T.jobs).select("job_id", "t2_score"), 15, by=None)


@register("tier3_rank", "SELECT job_id, t3_score FROM b_jobs WHERE t2_score >= 70 ORDER BY t3_score DESC NULLS LAST, job_id")
def tier3_rank(T):
    return P.tier3_rank(T.jobs.where(F.col("t2_score") >= 70).select("job_id", "t3_score"))


@register("tier3_queue", "SELECT job_id, t2_score FROM b_jobs WHERE status = 'active' AND t2_score >= 70")
def tier3_queue(T):
    return P.tier3_queue(T.jobs).select("job_id", "t2_score")


@register("match_score", """
SELECT job_id,
  round(round(((CAST(0.8 AS DOUBLE) + CAST(0.2 AS DOUBLE) * t3_fit / 100) * (t3_qualification / 100)) * 100, 10), 1) AS score_b02,
  round(round(((CAST(0.0 AS DOUBLE) + CAST(1.0 AS DOUBLE) * t3_fit / 100) * (t3_qualification / 100)) * 100, 10), 1) AS score_b1
FROM b_jobs
""")
def match_score(T):
    j = T.jobs
    return j.select("job_id", S.match_score("t3_qualification", "t3_fit", 0.2).alias("score_b02"),
                    S.match_score("t3_qualification", "t3_fit", 1.0).alias("score_b1"))


@register("route_status", """
SELECT job_id, CASE WHEN t2_score < 50 THEN 'bad_fit' ELSE 'active' END AS routed FROM b_jobs
""")
def route_status(T):
    return T.jobs.select("job_id", S.route_status("t2_score").alias("routed"))


@register("salary_label", """
SELECT job_id,
  CASE WHEN coalesce(salary_min, 0) <> 0 AND coalesce(salary_max, 0) <> 0
         THEN '$' || CAST(floor(salary_min / 1000) AS BIGINT) || 'k–$' || CAST(floor(salary_max / 1000) AS BIGINT) || 'k'
       WHEN coalesce(salary_max, 0) <> 0 THEN 'up to $' || CAST(floor(salary_max / 1000) AS BIGINT) || 'k'
       WHEN coalesce(salary_min, 0) <> 0 THEN 'from $' || CAST(floor(salary_min / 1000) AS BIGINT) || 'k'
       ELSE '—' END AS salary
FROM (SELECT job_id,
        CASE WHEN job_id % 6 = 1 THEN NULL ELSE salary_min END AS salary_min,
        CASE WHEN job_id % 6 = 2 THEN NULL ELSE salary_max END AS salary_max FROM b_jobs) x
""")
def salary_label(T):
    j = T.jobs.select(
        "job_id",
        F.when(F.col("job_id") % 6 == 1, None).otherwise(F.col("salary_min")).alias("salary_min"),
        F.when(F.col("job_id") % 6 == 2, None).otherwise(F.col("salary_max")).alias("salary_max"))
    return j.select("job_id", S.salary_label("salary_min", "salary_max").alias("salary"))


def _band_sql(col: str, hi: int, mid: int, alias: str) -> str:
    return (f"CASE WHEN {col} IS NULL THEN 'none' WHEN {col} >= {hi} THEN 'high' "
            f"WHEN {col} >= {mid} THEN 'mid' ELSE 'low' END AS {alias}")


@register("score_band", f"""
SELECT job_id, {_band_sql('t2_score', 75, 50, 't2_band')}, {_band_sql('t3_score', 75, 50, 't3_band')},
       {_band_sql('t3_qualification', 70, 50, 'qual_band')}, {_band_sql('t3_fit', 70, 40, 'fit_band')}
FROM b_jobs
""")
def score_band(T):
    return T.jobs.select("job_id", S.score_band("t2_score").alias("t2_band"),
                         S.score_band("t3_score").alias("t3_band"),
                         S.score_band("t3_qualification", 70, 50).alias("qual_band"),
                         S.score_band("t3_fit", 70, 40).alias("fit_band"))


_EV_NOW = f"TIMESTAMP '{AS_OF_EVENTS}'"


@register("age_label", f"""
SELECT event_id,
  CASE WHEN ts IS NULL THEN 'never'
       WHEN epoch({_EV_NOW}) - epoch(ts) < 3600
         THEN CAST(greatest(floor((epoch({_EV_NOW}) - epoch(ts)) / 60), 1) AS BIGINT) || 'm ago'
       WHEN epoch({_EV_NOW}) - epoch(ts) < 86400
         THEN CAST(floor((epoch({_EV_NOW}) - epoch(ts)) / 3600) AS BIGINT) || 'h ago'
       ELSE CAST(floor((epoch({_EV_NOW}) - epoch(ts)) / 86400) AS BIGINT) || 'd ago' END AS ago
FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events) e
""")
def age_label(T):
    now = F.lit(AS_OF_EVENTS).cast("timestamp")
    ev = T.events.select("event_id", F.date_trunc("second", "ts").alias("ts"))
    return ev.select("event_id", S.age_label("ts", now).alias("ago"))
