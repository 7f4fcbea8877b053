"""Listing transforms and composed texts (queries + oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblake.functions.text import dedup_hash, normalise_sql, normalise_text
from joblake.operators import listing as L
from joblake.operators.filters import filter_profiles
from joblake.plans.bindings import AS_OF_DATE
from joblake.plans.registry import register


@register("normalise_text", f"SELECT doc_id, {normalise_sql('text')} AS norm FROM documents")
def normalise_text_q(T):
    """Normalising the whole text of every (multilingual) document."""
    return T.documents.select("doc_id", normalise_text("text").alias("norm"))


@register("dedup_hash", f"""
SELECT seq, sha256({normalise_sql('title')} || '|' || {normalise_sql('company_name')} || '|'
                  || {normalise_sql('location')}) AS dedup_hash FROM b_listings
""")
def dedup_hash_q(T):
    return T.listings.select("seq", dedup_hash("title", "company_name", "location").alias("dedup_hash"))


_BLOCKED_SQL = "('ai salary map', 'mercor', 'upwork', 'synergisticit', 'diversityjobs', 'bebee', 'jobs via dice')"


@register("filter_valid_listing", f"""
SELECT seq, title, company_name, via FROM b_doc_listings
WHERE lower(coalesce(via, '')) NOT IN {_BLOCKED_SQL} AND lower(coalesce(company_name, '')) NOT IN {_BLOCKED_SQL}
  AND lower(coalesce(title, '')) NOT IN {_BLOCKED_SQL} AND length(coalesce(description, '')) >= 1000
""")
def filter_valid_listing(T):
    return L.filter_valid_listing(T.doc_listings).select("seq", "title", "company_name", "via")


@register("route_by_length", """
SELECT doc_id, CASE WHEN len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) <= 10
                    THEN 'small' ELSE 'large' END AS space
FROM (SELECT doc_id, text FROM documents
      UNION ALL SELECT -1 - event_id AS doc_id, event_type || ' ' || props AS text FROM events) d
""")
def route_by_length(T):
    texts = T.documents.select("doc_id", "text").unionByName(
        T.events.select((F.lit(-1) - F.col("event_id")).alias("doc_id"),
                        F.concat_ws(" ", "event_type", "props").alias("text")))
    return texts.select("doc_id", L.route_by_length("text").alias("space"))


_SAL_T2 = """CASE WHEN coalesce(salary_min, 0) <> 0 AND coalesce(salary_max, 0) <> 0
  THEN chr(10) || 'Salary: ' || coalesce(nullif(salary_currency, ''), 'USD') || ' ' || format('{:,}', salary_min)
       || '–' || format('{:,}', salary_max) || ' (' || coalesce(nullif(salary_period, ''), 'yearly') || ')' ELSE '' END"""


@register("compose_scoring_text", f"""
SELECT job_id,
  'CAREER PROFILE:' || chr(10) || coalesce(location, '') || chr(10) || chr(10) || '---' || chr(10) || 'JOB:' || chr(10)
  || 'Title: ' || coalesce(title, '') || chr(10) || 'Company: ' || coalesce(company_name, '') || chr(10)
  || 'Location: ' || coalesce(location, '') || ' | Attendance: ' || coalesce(nullif(attendance, ''), 'unknown')
  || ' | Seniority: ' || coalesce(nullif(seniority, ''), 'unknown') || {_SAL_T2} || chr(10)
  || 'Description: ' || substr(coalesce(description, ''), 1, 1500) || chr(10)
  || 'Qualifications: ' || substr(coalesce(qualifications, ''), 1, 800) AS tier2_text,
  'Title: ' || coalesce(title, '') || chr(10) || chr(10) || 'Company: ' || coalesce(company_name, '') || chr(10) || chr(10)
  || 'Location: ' || coalesce(location, '')
  || CASE WHEN coalesce(description, '') <> '' THEN chr(10) || chr(10) || 'Description:' || chr(10) || description ELSE '' END
  || CASE WHEN coalesce(qualifications, '') <> '' THEN chr(10) || chr(10) || 'Qualifications:' || chr(10) || qualifications ELSE '' END
  || CASE WHEN coalesce(responsibilities, '') <> '' THEN chr(10) || chr(10) || 'Responsibilities:' || chr(10) || responsibilities ELSE '' END
  AS extraction_text
FROM (SELECT job_id, title, company_name, location, attendance, seniority, salary_currency, salary_period,
             description, qualifications, responsibilities,
             CASE WHEN job_id % 4 = 1 THEN NULL ELSE salary_min END AS salary_min,
             CASE WHEN job_id % 4 = 2 THEN 0 ELSE salary_max END AS salary_max FROM b_jobs) j
""")
def compose_scoring_text(T):
    j = T.jobs.select(
        "job_id", "title", "company_name", "location", "attendance", "seniority", "salary_currency",
        "salary_period", "description", "qualifications", "responsibilities",
        F.when(F.col("job_id") % 4 == 1, None).otherwise(F.col("salary_min")).alias("salary_min"),
        F.when(F.col("job_id") % 4 == 2, 0).otherwise(F.col("salary_max")).alias("salary_max"))
    return j.select("job_id", L.scoring_text_tier2(F.col("location"), description_chars=1500, qualification_chars=800).alias("tier2_text"),
                    L.extraction_input_text().alias("extraction_text"))


@register("compose_tier3_text")
def compose_tier3_text(T):
    """Tier-3 text (salary when min set); rows-only: same pattern as tier 2."""
    return T.jobs.select("job_id", L.scoring_text_tier3(F.col("location")).alias("tier3_text"))


@register("parse_posted_at", f"""
SELECT event_id,
  CASE WHEN posted_at IS NULL OR posted_at = '' THEN NULL
       WHEN contains(lower(posted_at), 'today') OR contains(lower(posted_at), 'just')
         OR contains(lower(posted_at), 'hour') OR contains(lower(posted_at), 'minute') THEN DATE '{AS_OF_DATE}'
       WHEN contains(lower(posted_at), 'yesterday') THEN CAST(DATE '{AS_OF_DATE}' - INTERVAL 1 DAY AS DATE)
       WHEN regexp_extract(lower(posted_at), '(\\d+)\\s+day', 1) <> ''
         THEN CAST(DATE '{AS_OF_DATE}' - to_days(CAST(regexp_extract(lower(posted_at), '(\\d+)\\s+day', 1) AS INT)) AS DATE)
       WHEN regexp_extract(lower(posted_at), '(\\d+)\\s+week', 1) <> ''
         THEN CAST(DATE '{AS_OF_DATE}' - to_days(7 * CAST(regexp_extract(lower(posted_at), '(\\d+)\\s+week', 1) AS INT)) AS DATE)
       WHEN regexp_extract(lower(posted_at), '(\\d+)\\s+month', 1) <> ''
         THEN CAST(DATE '{AS_OF_DATE}' - to_days(30 * CAST(regexp_extract(lower(posted_at), '(\\d+)\\s+month', 1) AS INT)) AS DATE)
       END AS date_listed
FROM b_posted
""")
def parse_posted_at(T):
    return T.posted.select("event_id", L.parse_posted_at("posted_at", AS_OF_DATE).alias("date_listed"))


def _profiles(T):
    """One markdown text per profile, blocks in turn order (a group is one
    conversation, so bounded)."""
    blocks = T.profile_blocks
    return (blocks.groupBy("profile_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))),
                                          lambda x: x["block"]), "\n").alias("text")))


@register("filter_profiles", """
SELECT profile_id FROM (
  SELECT profile_id, string_agg(block, chr(10) ORDER BY turn) AS text FROM b_profile_blocks GROUP BY profile_id) p
WHERE text IS NOT NULL AND trim(text) <> '' AND NOT contains(text, '<!-- Fill in your')
""")
def filter_profiles_q(T):
    return filter_profiles(_profiles(T)).select("profile_id")


@register("profile_sections")
def profile_sections(T):
    """Profile markdown → the five embedding fields (rows-only; unit-tested)."""
    return L.parse_profile(_profiles(T))


@register("compose_profile_text")
def compose_profile_text(T):
    return L.parse_profile(_profiles(T)).select("profile_id", L.compose_profile_text().alias("text"))


@register("compose_embedding_text")
def compose_embedding_text(T):
    """Documents as qualifications (long texts exercise the token budget),
    keyword names of the listing as skills/frameworks."""
    d = T.documents.select(F.col("doc_id").alias("job_id"), F.col("source").alias("title"),
                           F.col("text").alias("qualifications"), F.col("lang").alias("responsibilities"),
                           F.split(F.col("source"), "c").alias("skills"),
                           F.array(F.col("lang")).alias("frameworks"))
    return d.select("job_id", L.compose_embedding_text(max_tokens=L.EMBEDDING_MAX_TOKENS).alias("text"))


@register("raw_payload")
def raw_payload(T):
    """Whole listing record as JSON text, read back with the same schema: how
    many come back unchanged."""
    j = L.raw_payload(T.jobs.select("job_id", "title", "company_name", "date_listed", "t2_score"))
    schema = "job_id BIGINT, title STRING, company_name STRING, date_listed DATE, t2_score DOUBLE"
    back = F.from_json("raw_json", schema)
    same = F.struct("job_id", "title", "company_name", "date_listed", "t2_score").eqNullSafe(back)
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_same"))
