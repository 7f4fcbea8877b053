"""Remaining inventory keys registered on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblake.operators import analytics as A
from joblake.operators import changes as CH
from joblake.operators import curation as C
from joblake.operators import dedup as D
from joblake.operators import filters as FL
from joblake.operators import listing as L
from joblake.operators import vectors as V
from joblake.plans.registry import register
from joblake.session import scratch_path, scratch_table
from joblake.sources import pages as PG
from joblake.sources import sinks as SK


@register("global_salary", """
SELECT avg(CASE WHEN salary_period = 'yearly' THEN salary_max END) AS global_salary
FROM b_jobs WHERE t3_score IS NOT NULL AND status = 'active'
""")
def global_salary(T):
    """The one-row fallback of the keyword market."""
    scope = FL.filter_keywords(T.jobs)
    return scope.agg(F.avg(F.when(F.col("salary_period") == "yearly", F.col("salary_max"))).alias("global_salary"))


@register("filter_reprocessable", """
SELECT job_id, raw_json FROM (
  SELECT job_id, status, CASE WHEN job_id % 2 = 0 THEN url END AS raw_json FROM b_jobs) j
WHERE status = 'extraction_failed' AND raw_json IS NOT NULL
""")
def filter_reprocessable(T):
    j = T.jobs.select("job_id", "status", F.when(F.col("job_id") % 2 == 0, F.col("url")).alias("raw_json"))
    return FL.filter_reprocessable(j).select("job_id", "raw_json")


@register("batch_summary", """
SELECT year(date_listed) AS batch_id,
       count(*) FILTER (WHERE status NOT IN ('extraction_failed', 'bad_listing')) AS inserted,
       count(*) FILTER (WHERE status = 'bad_listing') AS duplicates,
       count(*) FILTER (WHERE status = 'extraction_failed') AS failed
FROM b_jobs GROUP BY year(date_listed)
""")
def batch_summary(T):
    """Outcomes per yearly batch of the listing binding."""
    o = T.jobs.select(F.year("date_listed").alias("batch_id"),
                      F.when(F.col("status") == "extraction_failed", "failed")
                      .when(F.col("status") == "bad_listing", "duplicate").otherwise("inserted").alias("outcome"))
    return A.batch_summary(o)


@register("plan_union")
def plan_union(T):
    """Plans made per kind and concatenated."""
    from joblake.plans.q_curation import DELETE_BELOW, MERGE_AT
    best = V.knn_keywords(T.entries.withColumn("is_candidate", F.lit(1)), k=1)
    parts = [C.classify_candidates(best.where(F.col("kind") == k), T.entries.where(F.col("kind") == k),
                                   MERGE_AT, DELETE_BELOW) for k in ("skill", "framework")]
    return parts[0].unionByName(parts[1])


@register("scan_plan")
def scan_plan(T):
    from joblake.plans.q_curation import _plan
    path = scratch_path(T.spark, "plan_scan")
    SK.sink_plan(C.resolve_merge_chains(_plan(T)), path)
    return SK.scan_plan(T.spark, path)


@register("reprocess_upsert")
def reprocess_upsert(T):
    """Quarantined listings replaced by reprocessed fields (matched by hash),
    scores and dates kept, their junction rows rebuilt. The snapshot is read four
    times, so it is hashed and written once."""
    jobs = scratch_table(D.with_hash(T.jobs.select("job_id", "title", "company_name", "location", "description", "status",
                                                   "t2_score", "date_listed")), "snapshot")
    upd = jobs.where(F.col("status") == "extraction_failed").select(
        "dedup_hash", F.concat(F.lit("reprocessed: "), F.col("description")).alias("description"),
        F.lit("active").alias("status"))
    jk = T.job_keywords
    new_kw = (jobs.where(F.col("status") == "extraction_failed")
              .select("dedup_hash", F.lit("skill").alias("kind"), F.lit(2).cast("long").alias("id")))
    out, jk2 = CH.reprocess_upsert(jobs, upd, jk, new_kw, ["description", "status"])
    n = jk2.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_keywords"))
    return out.join(n, "job_id", "left").select("job_id", "status", "description", "t2_score", "n_keywords")


def _landed(T, name):
    from joblake.plans.q_jobs import _doc_pages
    path = scratch_path(T.spark, name)
    PG.write_page_files(_doc_pages(T).drop("query_name", "page_no"), path)
    return PG.scan_pages(T.spark, path)


@register("flatten_highlights")
def flatten_highlights(T):
    return L.flatten_highlights(_landed(T, "hl")).select("job_id", "qualifications", "responsibilities")


@register("primary_url")
def primary_url(T):
    return _landed(T, "url").select("job_id", L.primary_url().alias("url"))


@register("sink_jobs")
def sink_jobs(T):
    """Rows of a landed batch to append to the store: new hashes only."""
    store = D.with_hash(T.jobs.select("title", "company_name", "location"))
    batch = D.with_hash(T.doc_listings)
    return SK.sink_jobs(batch, store).select("seq", "dedup_hash")


@register("sink_failed")
def sink_failed(T):
    """Quarantine rows for listings whose extraction failed (short descriptions)."""
    from joblake.operators.extract import extract_fields
    b = L.raw_payload(D.with_hash(T.doc_listings))
    ext = extract_fields(b).where(F.length("description") < 1000)
    return SK.sink_failed(ext).drop("raw_json")


@register("sink_results_json")
def sink_results_json(T):
    """Ranked vector-search results written as JSON and read back."""
    from joblake.plans.q_vectors import vector_search
    path = scratch_path(T.spark, "results")
    SK.sink_results_json(vector_search(T), path)
    return T.spark.read.schema("query_id long, job_id long, similarity double, rank int").json(path)
