"""Joins of listings, applications and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOB_ROW = ["job_id", "title", "company_name", "location", "attendance", "seniority",
           "employment_type", "salary_min", "salary_max", "salary_currency", "salary_period",
           "date_listed", "status", "url", "t2_score", "t2_explanation", "t3_score", "application_id"]


def jobs_with_application(jobs: DataFrame, apps: DataFrame) -> DataFrame:
    """Listings ⟕ applications on the listing's back-pointer."""
    a = apps.select("application_id", F.col("state").alias("application_state"))
    cols = [c for c in JOB_ROW if c in jobs.columns]
    return jobs.select(*cols).join(a, "application_id", "left")


def job_detail(jobs: DataFrame, apps: DataFrame, keywords: DataFrame,
               job_keywords: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Listing rows with application fields and the sorted names of their
    non-candidate skills and frameworks. ``ids`` (column job_id) restricts it
    to a set of listings by semi join; None means all."""
    if ids is not None:
        jobs = jobs.join(ids.select("job_id").distinct(), "job_id", "left_semi")
    a = apps.select("application_id", F.col("state").alias("application_state"),
                    "date_applied", "assistance_level", "cold_calls", "reached_human",
                    "interviews", "offer")
    base = jobs.join(a, "application_id", "left")
    canon = keywords.where(F.col("is_candidate") == 0).select("id", "kind", "name")
    names = (job_keywords.select("job_id", "kind", "id").join(canon, ["kind", "id"])
             .groupBy("job_id")
             .agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "skill", F.col("name"))))
                  .alias("skills"),
                  F.array_sort(F.collect_list(F.when(F.col("kind") == "framework", F.col("name"))))
                  .alias("frameworks")))
    empty = F.array().cast("array<string>")
    return (base.join(names, "job_id", "left")
            .withColumn("skills", F.coalesce("skills", empty))
            .withColumn("frameworks", F.coalesce("frameworks", empty)))


def applications_with_job(apps: DataFrame, jobs: DataFrame) -> DataFrame:
    j = jobs.select("job_id", F.col("title").alias("job_title"), "company_name", "location",
                    "salary_min", "salary_max", "salary_currency", "salary_period",
                    "t2_score", "t3_score", F.col("url").alias("job_url"),
                    F.col("status").alias("job_status"))
    return apps.join(j, "job_id")


def keyword_jobs(keywords: DataFrame, job_keywords: DataFrame, jobs: DataFrame) -> DataFrame:
    """keywords ⨝ junction (job_id, kind, id) ⨝ listings."""
    return (job_keywords.select("job_id", "kind", "id")
            .join(keywords.select("kind", "id", "name", "is_candidate", "user_level"), ["kind", "id"])
            .join(jobs, "job_id"))


def latest_application(apps: DataFrame) -> DataFrame:
    """Newest application (largest id) per listing. A grouped max over a
    struct led by the id: combined map-side, so a listing with very many
    applications is not sorted in one task as a window would."""
    rest = [c for c in apps.columns if c not in ("job_id", "application_id")]
    best = F.max(F.struct("application_id", *rest)).alias("_m")
    return apps.groupBy("job_id").agg(best).select("job_id", "_m.*")
