"""Aggregations: keyword market, dashboard statistics, candidate usage.

All aggregates are decomposable (count, count_if, sum/avg, max), so Spark
combines them map-side before the shuffle: a keyword or status holding a third
of all rows costs one partial row per task, not a hot reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblake.functions.scores import decimal_round, level_weight
from joblake.operators.filters import keyword_entry_predicate, keyword_job_predicate
from joblake.schemas import CANDIDATE_MIN_JOBS

# fixed values: sort keys of the keyword view (column, nullable)
KEYWORD_SORTS = {
    "improvement_priority": True,
    "avg_salary": True,
    "avg_fit": True,
    "avg_qual": True,
    "raw_count": False,
    "actionable_count": False,
}


def keyword_market(jobs: DataFrame, keywords: DataFrame, job_keywords: DataFrame, *,
                   listing_mode: str = "active", date_from=None, date_to=None,
                   show_candidates: bool = False, name: str | None = None,
                   min_jobs: int = CANDIDATE_MIN_JOBS) -> DataFrame:
    """Per keyword (skills and frameworks at once, told apart by ``kind``):
    listing count, actionable count (50 <= qualification < 80), mean fit and
    qualification, mean yearly salary falling back to the global mean, and the
    improvement priority. Keeps keywords named by at least ``min_jobs``."""
    scope = jobs.where(keyword_job_predicate(listing_mode=listing_mode, date_from=date_from,
                                             date_to=date_to))
    scope = scope.select("job_id", "t3_qualification", "t3_fit", "salary_max", "salary_period")
    yearly = F.when(F.col("salary_period") == "yearly", F.col("salary_max"))
    # global fallback: a scalar subquery over the same listings (one row, computed once)
    global_salary = scope.agg(F.avg(yearly)).scalar()

    entries = keywords.where(keyword_entry_predicate(show_candidates=show_candidates, name=name))
    entries = entries.select("kind", "id", "name", "user_level")

    actionable = (F.col("t3_qualification") >= 50) & (F.col("t3_qualification") < 80)
    grouped = (job_keywords.select("job_id", "kind", "id")
               .join(entries, ["kind", "id"])
               .join(scope, "job_id")
               .groupBy("kind", "id", "name", "user_level")
               .agg(F.count(F.lit(1)).alias("raw_count"),
                    F.count_if(actionable).alias("actionable_count"),
                    F.avg("t3_fit").alias("_fit"),
                    F.avg("t3_qualification").alias("_qual"),
                    F.avg(yearly).alias("_salary"))
               .where(F.col("raw_count") >= min_jobs))
    return finish_market(grouped, global_salary)


def finish_market(grouped: DataFrame, global_salary) -> DataFrame:
    """Rounded means and the priority from one row per keyword with the plain
    means ``_fit``, ``_qual`` and ``_salary``."""
    # the fallback is bound once to a column, so the subquery is planned once
    grouped = grouped.withColumn("_sal", F.coalesce(F.col("_salary"), global_salary))
    salary = F.col("_sal")
    product = salary * F.col("_fit") * F.col("actionable_count") * level_weight("user_level")
    priority = F.when(F.col("actionable_count") == 0, F.lit(None).cast("double")).otherwise(
        decimal_round(F.when(product > 0, F.ln(product)) - 15, 1))
    return grouped.select(
        "kind", "id", "name", "user_level", "raw_count", "actionable_count",
        decimal_round("_fit", 1).alias("avg_fit"),
        decimal_round("_qual", 1).alias("avg_qual"),
        decimal_round(salary, 0).alias("avg_salary"),
        priority.alias("improvement_priority"))


def sort_keywords(market: DataFrame, sort: str = "improvement_priority") -> DataFrame:
    """Order of the keyword view; unknown key → improvement priority; the id
    is the last key so ties are stable."""
    if sort not in KEYWORD_SORTS:
        sort = "improvement_priority"
    key = F.col(sort).desc_nulls_last() if KEYWORD_SORTS[sort] else F.col(sort).desc()
    return market.orderBy(key, "kind", "id")


def freshness_stats(jobs: DataFrame, now) -> DataFrame:
    """One row: last ingest, active, ingested in the last 24 h and active,
    applied, expired, bad fit + bad listing."""
    now_ts = F.lit(now).cast("timestamp")
    st = F.col("status")
    return jobs.agg(
        F.max("date_ingested").alias("last_ingested"),
        F.count_if(st == "active").alias("active_total"),
        F.count_if((st == "active") & (F.col("date_ingested") > now_ts - F.expr("INTERVAL 24 HOURS")))
        .alias("ingested_today"),
        F.count_if(st == "applied").alias("applied_total"),
        F.count_if(st == "expired").alias("expired_total"),
        F.count_if(st.isin("bad_fit", "bad_listing")).alias("bad_fit_total"))


def application_stats(apps: DataFrame) -> DataFrame:
    st = F.col("state")
    return apps.agg(
        F.count(F.lit(1)).alias("app_total"),
        F.count_if(st == "submitted").alias("app_awaiting"),
        F.count_if(F.col("reached_human") == 1).alias("app_reached_human"),
        F.count_if(F.col("interviews") > 0).alias("app_interviewed"),
        F.count_if(F.col("offer") == 1).alias("app_offers"),
        F.count_if(st == "rejected").alias("app_rejected"),
        F.count_if(st == "expired").alias("app_expired"))


def candidate_usage(keywords: DataFrame, job_keywords: DataFrame) -> DataFrame:
    """Candidates with the number of listings naming them; unused ones count 0.
    The junction is pre-aggregated per entry before it meets the candidates."""
    per_id = job_keywords.groupBy("kind", "id").agg(F.count("job_id").alias("job_count"))
    cands = keywords.where(F.col("is_candidate") == 1).select("kind", "id", "name")
    return (cands.join(per_id, ["kind", "id"], "left")
            .select("kind", "id", "name", F.coalesce("job_count", F.lit(0)).cast("bigint").alias("job_count")))


def candidates_above(keywords: DataFrame, job_keywords: DataFrame, min_jobs: int) -> DataFrame:
    return candidate_usage(keywords, job_keywords).where(F.col("job_count") >= min_jobs)


def candidates_by_usage(usage: DataFrame) -> DataFrame:
    return usage.orderBy(F.col("job_count").desc(), "kind", "id")


def active_count(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == "active").agg(F.count(F.lit(1)).alias("active_count"))


def filtered_count(df: DataFrame, predicate) -> DataFrame:
    """Total behind a page: the same predicate as the page, counted."""
    return df.where(predicate).agg(F.count(F.lit(1)).alias("total"))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def taxonomy_listing(keywords: DataFrame) -> DataFrame:
    """Canonical names per (kind, domain); NULL domain → 'Other'; names sorted
    and joined by ', '."""
    canon = keywords.where(F.col("is_candidate") == 0)
    return (canon.groupBy("kind", F.coalesce("domain", F.lit("Other")).alias("domain"))
            .agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names")))


def batch_summary(outcomes: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    """One row per batch (or one row overall): inserted / duplicate / failed."""
    o = F.col(outcome_col)
    keys = [c for c in ("batch_id",) if c in outcomes.columns]
    aggs = [F.count_if(o == "inserted").alias("inserted"),
            F.count_if(o == "duplicate").alias("duplicates"),
            F.count_if(o == "failed").alias("failed")]
    return outcomes.groupBy(*keys).agg(*aggs) if keys else outcomes.agg(*aggs)
