"""Keyword market and dashboard statistics (queries + oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblake.functions.scores import age_label
from joblake.operators import analytics as A
from joblake.operators.filters import filter_canonical, job_predicate
from joblake.operators.joins import keyword_jobs
from joblake.operators.market_state import KeptMarket
from joblake.plans.bindings import AS_OF_DATE
from joblake.plans.registry import register
from joblake.session import scratch_path

_LEVEL_SQL = ("CASE user_level WHEN 'Unskilled' THEN 5 WHEN 'Novice' THEN 4 WHEN 'Intermediate' THEN 3 "
              "WHEN 'Advanced' THEN 2 WHEN 'Expert' THEN 1 ELSE 5 END")


def _market_sql(job_where: str, entry_where: str, min_jobs: int = 3) -> str:
    return f"""
WITH scope AS (
  SELECT job_id, t3_qualification, t3_fit, salary_max, salary_period FROM b_jobs WHERE {job_where}),
g AS (SELECT avg(CASE WHEN salary_period = 'yearly' THEN salary_max END) AS gs FROM scope),
agg AS (
  SELECT k.kind, k.id, k.name, k.user_level,
         count(*) AS raw_count,
         count(*) FILTER (WHERE j.t3_qualification >= 50 AND j.t3_qualification < 80) AS actionable_count,
         avg(j.t3_fit) AS f, avg(j.t3_qualification) AS q,
         avg(CASE WHEN j.salary_period = 'yearly' THEN j.salary_max END) AS s
  FROM b_keywords k JOIN b_job_keywords jk ON k.id = jk.id JOIN scope j ON jk.job_id = j.job_id
  WHERE {entry_where}
  GROUP BY k.kind, k.id, k.name, k.user_level
  HAVING count(*) >= {min_jobs}),
withp AS (
  SELECT agg.*, coalesce(s, (SELECT gs FROM g)) AS sal,
         coalesce(s, (SELECT gs FROM g)) * f * actionable_count * ({_LEVEL_SQL}) AS p
  FROM agg)
SELECT kind, id, name, user_level, raw_count, actionable_count,
       round(round(f, 10), 1) AS avg_fit, round(round(q, 10), 1) AS avg_qual,
       round(round(sal, 10), 0) AS avg_salary,
       CASE WHEN actionable_count = 0 THEN NULL
            ELSE round(round(CASE WHEN p > 0 THEN ln(p) END - 15, 10), 1) END AS improvement_priority
FROM withp
"""


_ACTIVE_SCOPE = "t3_score IS NOT NULL AND status = 'active'"
_ALL_SCOPE = ("t3_score IS NOT NULL AND status IN ('active', 'applied', 'closed', 'expired') "
              "AND date_listed >= DATE '1996-01-01' AND date_listed <= DATE '2000-12-31'")


@register("keyword_market", _market_sql(_ACTIVE_SCOPE, "k.is_candidate = 0"))
def keyword_market(T):
    """Flagship: skill/framework market over active deep-scored listings."""
    return A.keyword_market(T.jobs, T.keywords, T.job_keywords)


@register("keyword_market_kept", _market_sql(_ACTIVE_SCOPE, "k.is_candidate = 0"))
def keyword_market_kept(T):
    """The same market from kept sums: all listings as they come in, active; then
    a batch that takes those to their present status; then both folded."""
    state = KeptMarket(T.jobs.sparkSession, scratch_path(T.jobs.sparkSession, "market"))
    incoming = T.jobs.withColumn("status", F.lit("active"))
    state.apply(0, incoming.where(F.lit(False)), incoming, T.job_keywords)
    moved = ~F.col("now").eqNullSafe("active")
    state.apply(1, T.jobs.withColumn("now", F.col("status")).withColumn("status", F.lit("active")).where(moved),
                T.jobs.withColumn("now", F.col("status")).where(moved), T.job_keywords)
    state.fold()
    return state.market(T.keywords)


@register("improvement_priority",
          _market_sql(_ALL_SCOPE, "k.name ILIKE '%e%'", min_jobs=5))
def improvement_priority(T):
    """Market in 'all listings' mode with a date window, candidates shown,
    name filter, stricter HAVING."""
    return A.keyword_market(T.jobs, T.keywords, T.job_keywords, listing_mode="all",
                            date_from="1996-01-01", date_to="2000-12-31", show_candidates=True,
                            name="e", min_jobs=5)


@register("sort_keywords", "SELECT * FROM (" + _market_sql(_ACTIVE_SCOPE, "k.is_candidate = 0")
          + ") m ORDER BY avg_salary DESC NULLS LAST, kind, id")
def sort_keywords(T):
    """The market sorted by mean salary."""
    return A.sort_keywords(A.keyword_market(T.jobs, T.keywords, T.job_keywords), "avg_salary")


_USAGE_SQL = """
SELECT k.kind, k.id, k.name, CAST(count(jk.job_id) AS BIGINT) AS job_count
FROM b_keywords k LEFT JOIN b_job_keywords jk ON k.id = jk.id
WHERE k.is_candidate = 1
GROUP BY k.kind, k.id, k.name
"""


@register("candidate_usage", _USAGE_SQL)
def candidate_usage(T):
    return A.candidate_usage(T.keywords, T.job_keywords)


@register("candidates_above", f"SELECT * FROM ({_USAGE_SQL}) u WHERE job_count >= 300")
def candidates_above(T):
    return A.candidates_above(T.keywords, T.job_keywords, 300)


@register("candidates_by_usage", f"SELECT * FROM ({_USAGE_SQL}) u ORDER BY job_count DESC, kind, id")
def candidates_by_usage(T):
    return A.candidates_by_usage(A.candidate_usage(T.keywords, T.job_keywords))


@register("taxonomy_listing", """
SELECT kind, coalesce(domain, 'Other') AS domain, array_to_string(list_sort(list(name)), ', ') AS names
FROM b_keywords WHERE is_candidate = 0 GROUP BY kind, coalesce(domain, 'Other')
""")
def taxonomy_listing(T):
    return A.taxonomy_listing(T.keywords)


@register("filter_canonical", "SELECT kind, id, name FROM b_keywords WHERE is_candidate = 0")
def filter_canonical_q(T):
    return filter_canonical(T.keywords)


@register("keyword_jobs", """
SELECT jk.job_id, jk.id, k.kind, k.name, k.is_candidate, k.user_level, j.title, j.status, j.t3_score
FROM b_job_keywords jk JOIN b_keywords k ON jk.id = k.id JOIN b_jobs j ON jk.job_id = j.job_id
""")
def keyword_jobs_q(T):
    return keyword_jobs(T.keywords, T.job_keywords,
                        T.jobs.select("job_id", "title", "status", "t3_score"))


_NOW = "TIMESTAMP '2001-08-01 00:00:00'"


@register("freshness_stats", f"""
WITH s AS (
SELECT max(date_ingested) AS last_ingested,
       count(*) FILTER (WHERE status = 'active') AS active_total,
       count(*) FILTER (WHERE status = 'active' AND date_ingested > {_NOW} - INTERVAL 24 HOUR) AS ingested_today,
       count(*) FILTER (WHERE status = 'applied') AS applied_total,
       count(*) FILTER (WHERE status = 'expired') AS expired_total,
       count(*) FILTER (WHERE status IN ('bad_fit', 'bad_listing')) AS bad_fit_total
FROM b_jobs)
SELECT s.*,
  CASE WHEN last_ingested IS NULL THEN 'never'
       WHEN epoch({_NOW}) - epoch(last_ingested) < 3600
         THEN CAST(greatest(floor((epoch({_NOW}) - epoch(last_ingested)) / 60), 1) AS BIGINT) || 'm ago'
       WHEN epoch({_NOW}) - epoch(last_ingested) < 86400
         THEN CAST(floor((epoch({_NOW}) - epoch(last_ingested)) / 3600) AS BIGINT) || 'h ago'
       ELSE CAST(floor((epoch({_NOW}) - epoch(last_ingested)) / 86400) AS BIGINT) || 'd ago' END AS last_ingested_ago
FROM s
""")
def freshness_stats(T):
    now = F.lit(f"{AS_OF_DATE} 00:00:00").cast("timestamp")
    return (A.freshness_stats(T.jobs, f"{AS_OF_DATE} 00:00:00")
            .withColumn("last_ingested_ago", age_label("last_ingested", now)))


@register("application_stats", """
SELECT count(*) AS app_total,
       count(*) FILTER (WHERE state = 'submitted') AS app_awaiting,
       count(*) FILTER (WHERE reached_human = 1) AS app_reached_human,
       count(*) FILTER (WHERE interviews > 0) AS app_interviewed,
       count(*) FILTER (WHERE offer = 1) AS app_offers,
       count(*) FILTER (WHERE state = 'rejected') AS app_rejected,
       count(*) FILTER (WHERE state = 'expired') AS app_expired
FROM b_applications
""")
def application_stats(T):
    return A.application_stats(T.applications)


@register("active_count", "SELECT count(*) AS active_count FROM b_jobs WHERE status = 'active'")
def active_count(T):
    return A.active_count(T.jobs)


@register("filtered_count", """
SELECT count(*) AS total FROM b_jobs
WHERE status IN ('active', 'applied') AND t2_score >= 30 AND location ILIKE '%an%'
""")
def filtered_count(T):
    return A.filtered_count(T.jobs, job_predicate(statuses=["active", "applied"], t2_min=30, location="an"))


@register("status_counts", """
SELECT status, count(*) AS n FROM b_jobs WHERE t3_score IS NOT NULL GROUP BY status
""")
def status_counts(T):
    from joblake.operators.filters import filter_t3_scored
    return A.status_counts(filter_t3_scored(T.jobs, active_only=False))
