"""Schemas and fixed domain values.

Every source is read with an explicit schema, never by inference.
"""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType)

# --- fixed values (must equal the reference's for equal results) ------------
EMPLOYMENT_TYPES = ["full-time", "part-time", "contract", "internship"]
ATTENDANCE = ["remote", "hybrid", "onsite"]
SENIORITY = ["junior", "mid", "senior", "lead", "staff", "principal"]
SALARY_PERIODS = ["yearly", "hourly", "monthly", "contract"]
JOB_STATUSES = ["active", "applied", "expired", "closed", "bad_listing", "bad_fit"]
INTERNAL_STATUSES = ["extraction_failed", "duplicate"]
APPLICATION_STATES = ["submitted", "rejected", "interviewing", "offer", "withdrawn", "expired"]
ASSISTANCE_LEVELS = ["ai", "assisted", "human"]
USER_LEVELS = ["Unskilled", "Novice", "Intermediate", "Advanced", "Expert"]
# user level → multiplier in the improvement priority (NULL counts as Unskilled)
LEVEL_WEIGHT = {"Unskilled": 5, "Novice": 4, "Intermediate": 3, "Advanced": 2, "Expert": 1}
# sort rank of application states (anything else ranks 4)
STATE_RANK = {"offer": 0, "interviewing": 1, "submitted": 2, "rejected": 3}
# blocked listing sources, compared lowercased
BLOCKED_SOURCES = ["ai salary map", "mercor", "upwork", "synergisticit",
                   "diversityjobs", "bebee", "jobs via dice"]
MIN_DESCRIPTION_CHARS = 1000
CANDIDATE_MIN_JOBS = 3
FAILED_TITLE = "(extraction failed)"
UNKNOWN_QUERY = "unknown query"
# --------------------------------------------------------------------------

HIGHLIGHT = StructType([
    StructField("title", StringType()),
    StructField("items", ArrayType(StringType())),
])
APPLY_OPTION = StructType([
    StructField("title", StringType()),
    StructField("link", StringType()),
])
DETECTED = StructType([
    StructField("posted_at", StringType()),
    StructField("schedule_type", StringType()),
    StructField("work_from_home", BooleanType()),
])
LISTING = StructType([
    StructField("title", StringType()),
    StructField("company_name", StringType()),
    StructField("location", StringType()),
    StructField("via", StringType()),
    StructField("share_link", StringType()),
    StructField("description", StringType()),
    StructField("extensions", ArrayType(StringType())),
    StructField("detected_extensions", DETECTED),
    StructField("job_highlights", ArrayType(HIGHLIGHT)),
    StructField("apply_options", ArrayType(APPLY_OPTION)),
    StructField("job_id", StringType()),
])
PAGE = StructType([
    StructField("_query_name", StringType()),
    StructField("error", StringType()),
    StructField("jobs_results", ArrayType(LISTING)),
    StructField("serpapi_pagination", StructType([StructField("next_page_token", StringType())])),
])

EXTRACTION = StructType([
    StructField("employment_type", StringType()),
    StructField("attendance", StringType()),
    StructField("seniority", StringType()),
    StructField("experience_years_min", IntegerType()),
    StructField("experience_years_max", IntegerType()),
    StructField("salary_min", IntegerType()),
    StructField("salary_max", IntegerType()),
    StructField("salary_currency", StringType()),
    StructField("salary_period", StringType()),
    StructField("skills", ArrayType(StringType())),
    StructField("frameworks", ArrayType(StringType())),
])

PLAN = StructType([
    StructField("kind", StringType()),
    StructField("id", LongType()),
    StructField("name", StringType()),
    StructField("action", StringType()),
    StructField("into_id", LongType()),
    StructField("into_name", StringType()),
])

SKILL_CSV = StructType([
    StructField("domain", StringType()),
    StructField("core_competency", StringType()),
    StructField("competency", StringType()),
    StructField("skill", StringType()),
])
FRAMEWORK_CSV = StructType([
    StructField("domain", StringType()),
    StructField("subdomain", StringType()),
    StructField("service", StringType()),
    StructField("framework", StringType()),
])
ALIAS_CSV = StructType([
    StructField("alias", StringType()),
    StructField("canonical_name", StringType()),
])

KEYWORDS = StructType([
    StructField("id", LongType()),
    StructField("kind", StringType()),
    StructField("name", StringType()),
    StructField("domain", StringType()),
    StructField("l2", StringType()),
    StructField("l3", StringType()),
    StructField("is_candidate", IntegerType()),
    StructField("user_level", StringType()),
])

SCORE_REPLY = StructType([
    StructField("score", DoubleType()),
    StructField("explanation", StringType()),
])
DEEP_REPLY = StructType([
    StructField("qual_score", DoubleType()),
    StructField("fit_score", DoubleType()),
    StructField("qual_explanation", StringType()),
    StructField("fit_explanation", StringType()),
])
