"""Row filters of the listing browser, application tracker and keyword views.

Each builder returns a ``Column`` predicate (so callers can share one plan
between the page and its count) or applies it. Predicates are plain
comparisons, so Catalyst pushes them into the parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblake.schemas import INTERNAL_STATUSES


def _and(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def _contains_ci(col: str, text: str) -> Column:
    # ILIKE '%text%': '%' and '_' typed by the user stay wildcards
    return F.col(col).ilike(f"%{text}%")


def job_predicate(*, statuses=None, t2_min=None, t3_min=None, seniority=None, attendance=None,
                  location=None, title=None, company=None, description=None,
                  date_from=None, date_to=None, has_application=None) -> Column:
    """Predicate of the listing browser. Internal statuses are never shown;
    no status given means 'active'; only internal ones given means no rows."""
    safe = [s for s in statuses if s not in INTERNAL_STATUSES] if statuses else ["active"]
    preds = [F.col("status").isin(safe) if safe else F.lit(False)]
    if t2_min is not None:
        preds.append(F.col("t2_score") >= t2_min)
    if t3_min is not None:
        preds.append(F.col("t3_score") >= t3_min)
    if seniority:
        preds.append(F.col("seniority").isin(list(seniority)))
    if attendance:
        preds.append(F.col("attendance").isin(list(attendance)))
    if location:
        preds.append(_contains_ci("location", location))
    if title:
        preds.append(_contains_ci("title", title))
    if company:
        preds.append(_contains_ci("company_name", company))
    if description:
        preds.append(_contains_ci("description", description)
                     | _contains_ci("qualifications", description)
                     | _contains_ci("responsibilities", description))
    if date_from:
        preds.append(F.col("date_listed") >= F.lit(date_from).cast("date"))
    if date_to:
        preds.append(F.col("date_listed") <= F.lit(date_to).cast("date"))
    if has_application is True:
        preds.append(F.col("application_id").isNotNull())
    elif has_application is False:
        preds.append(F.col("application_id").isNull())
    return _and(preds)


def filter_jobs(jobs: DataFrame, **kw) -> DataFrame:
    return jobs.where(job_predicate(**kw))


def application_predicate(*, states=None, date_from=None, date_to=None, company=None,
                          assistance=None, has_offer=None) -> Column:
    preds = []
    if states:
        preds.append(F.col("state").isin(list(states)))
    if date_from:
        preds.append(F.col("date_applied") >= F.lit(date_from).cast("date"))
    if date_to:
        preds.append(F.col("date_applied") <= F.lit(date_to).cast("date"))
    if company:
        preds.append(_contains_ci("company_name", company))
    if assistance:
        preds.append(F.col("assistance_level").isin(list(assistance)))
    if has_offer is True:
        preds.append(F.col("offer") == 1)
    elif has_offer is False:
        preds.append(F.col("offer") == 0)
    return _and(preds)


def filter_applications(apps_with_job: DataFrame, **kw) -> DataFrame:
    return apps_with_job.where(application_predicate(**kw))


def keyword_job_predicate(*, listing_mode: str = "active", date_from=None, date_to=None) -> Column:
    """Listings that count in the keyword views: deep-scored, and active only
    in 'active' mode, else any of active/applied/closed/expired."""
    preds = [F.col("t3_score").isNotNull()]
    if listing_mode == "active":
        preds.append(F.col("status") == "active")
    else:
        preds.append(F.col("status").isin("active", "applied", "closed", "expired"))
    if date_from:
        preds.append(F.col("date_listed") >= F.lit(date_from).cast("date"))
    if date_to:
        preds.append(F.col("date_listed") <= F.lit(date_to).cast("date"))
    return _and(preds)


def keyword_entry_predicate(*, show_candidates: bool = False, name: str | None = None) -> Column:
    preds = []
    if not show_candidates:
        preds.append(F.col("is_candidate") == 0)
    if name:
        preds.append(_contains_ci("name", name))
    return _and(preds)


def filter_keywords(jobs: DataFrame, **kw) -> DataFrame:
    return jobs.where(keyword_job_predicate(**kw))


def filter_by_ids(df: DataFrame, ids: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows whose key is in ``ids`` (a frame with column ``key``): a left-semi
    join, planned as broadcast when the id frame is small at run time."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def filter_canonical(keywords: DataFrame, kind: str | None = None) -> DataFrame:
    kw = keywords.where(F.col("is_candidate") == 0)
    if kind:
        kw = kw.where(F.col("kind") == kind)
    return kw.select("kind", "id", "name").orderBy("kind", "name", "id")


def filter_recent(jobs: DataFrame, as_of, mode: str = "daily") -> DataFrame:
    """Recency of a run: daily = posted since yesterday, backfill = past month."""
    days = 1 if mode == "daily" else 30
    return jobs.where(F.col("date_listed") >= F.date_sub(F.lit(as_of).cast("date"), days))


def filter_reprocessable(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.col("status") == "extraction_failed") & F.col("raw_json").isNotNull())


def filter_t3_scored(jobs: DataFrame, active_only: bool = True, statuses=None) -> DataFrame:
    pred = F.col("t3_score").isNotNull()
    if active_only:
        pred = pred & (F.col("status") == "active")
    if statuses:
        pred = pred & F.col("status").isin(list(statuses))
    return jobs.where(pred)


# fixed value: the marker of an unedited profile template
PROFILE_PLACEHOLDER = "<!-- Fill in your"


def filter_profiles(profiles: DataFrame, text_col: str = "text",
                    marker: str = PROFILE_PLACEHOLDER) -> DataFrame:
    """Usable profiles: not blank and not the unedited template."""
    t = F.col(text_col)
    return profiles.where(t.isNotNull() & (F.trim(t) != "") & ~t.contains(marker))
