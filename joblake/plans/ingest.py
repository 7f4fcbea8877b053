"""Batch ingestion: the stages of one run as one lazy plan per stage group,
written to the scratch folder after dedup, the expensive step.

landed listings (payload kept) → valid → flattened → hashed → exact / in-batch
/ fuzzy dedup → extracted fields → quarantine of what could not be extracted →
keywords and unknown names → routed keyword ids and new candidates → embedding
→ tier-2 score → routed status → tier-3 queue → deep scores of the queue, written
to its listings. Every valid listing ends as inserted, duplicate or failed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblake.functions.scores import route_status
from joblake.operators import dedup as D
from joblake.operators import keywords as K
from joblake.operators import listing as L
from joblake.operators import scoring as SC
from joblake.operators import vectors as V
from joblake.operators.analytics import batch_summary
from joblake.operators.changes import write_tier3
from joblake.operators.extract import extract_fields
from joblake.operators.paging import tier3_queue
from joblake.session import scratch_table
from joblake.sources.sinks import sink_failed

EXTRACTED = ["employment_type", "attendance", "seniority", "experience_years_min", "experience_years_max",
             "salary_min", "salary_max", "salary_currency", "salary_period"]
TIER3 = ["t3_score", "t3_qualification", "t3_fit", "t3_explanation"]


@dataclass
class IngestResult:
    jobs: DataFrame          # new listing rows, with payload, embedding, scores and status
    job_keywords: DataFrame  # (seq, kind, id)
    candidates: DataFrame    # new keyword candidates (kind, id, name)
    quarantine: DataFrame    # rows of listings whose extraction failed
    tier3: DataFrame         # (seq, t2_score, t3_…): active listings from the threshold on, deep-scored if there is a profile
    outcomes: DataFrame      # seq, outcome, reason
    summary: DataFrame       # inserted / duplicates / failed


def ingest_batch(listings: DataFrame, store: DataFrame, keywords: DataFrame, aliases: DataFrame, *,
                 as_of, fuzzy: bool = True, scores: DataFrame | None = None, profile: DataFrame | None = None,
                 extract: Callable[[DataFrame], DataFrame] = extract_fields, mode: str = "equals") -> IngestResult:
    """``listings`` needs seq (unique), title, company_name, location, via,
    description (job_highlights / apply_options / detected_extensions when
    present); ``store`` is the current listing table with title,
    company_name, dedup_hash. ``extract`` adds the ``extraction`` struct; a
    listing for which it is NULL goes to quarantine. Tier 2 comes from
    ``scores`` (seq, t2_score, t2_explanation), or from a one-row ``profile``
    (profile_keywords, pref_attendance, pref_seniority, pref_salary); without
    either it stays NULL, which counts as passing. The tier-3 queue is scored in
    depth against the ``profile``, and the scores are written to the listings;
    without a profile nothing is, and they stay NULL."""
    landed = L.raw_payload(listings) if "raw_json" not in listings.columns else listings
    valid = L.filter_valid_listing(landed, mode)
    if "job_highlights" in valid.columns:
        valid = L.flatten_highlights(valid)
    for c in ("qualifications", "responsibilities"):
        if c not in valid.columns:
            valid = valid.withColumn(c, F.lit(""))
    hashed = scratch_table(D.with_hash(valid), "hashed")

    # the store is read once: what of the batch it holds already
    known = scratch_table(store.select("dedup_hash").join(hashed.select("dedup_hash").distinct(), "dedup_hash", "left_semi").distinct(), "known")
    fresh, exact = D.dedup_exact(hashed, known)
    first = scratch_table(D.first_seen_in_batch(fresh), "first")
    repeats = fresh.select("seq").join(first.select("seq"), "seq", "left_anti")
    if fuzzy:
        kept = scratch_table(D.dedup_fuzzy(first.select("seq", "title", "company_name"), store.select("title", "company_name"))
                             .select("seq", "keep"), "fuzzy")
        survivors = first.join(kept.where("keep").select("seq"), "seq", "left_semi")
        fuzzy_dups = kept.where("not keep").select("seq")
    else:
        survivors, fuzzy_dups = first, first.limit(0).select("seq")
    tried = scratch_table(extract(survivors), "extracted")
    ext, lost = tried.where(F.col("extraction").isNotNull()), tried.where(F.col("extraction").isNull())

    texts = ext.select(F.col("seq").alias("job_id"), F.concat_ws("\n", "title", "description", "qualifications").alias("text"))
    found = K.extract_keywords(texts, keywords, aliases)
    mentions = (found.join(keywords.select("kind", "id", "name"), ["kind", "id"])
                .select("job_id", F.col("first_pos").alias("pos"), F.col("kind").alias("tag"), F.col("name").alias("raw_name")))
    # unknown names come after the known ones of a listing
    unknown = K.unknown_names(texts, keywords, aliases).select(
        "job_id", (F.col("pos") + (1 << 30)).alias("pos"), F.lit("skill").alias("tag"), "raw_name")
    resolved, cands = K.route_keywords(mentions.unionByName(unknown), keywords, aliases)
    jk = scratch_table(resolved.select(F.col("job_id").alias("seq"), "kind", "id").dropDuplicates(), "keywords")
    cands = cands.select("kind", "id", "name")

    if "detected_extensions" in ext.columns:
        jobs = L.compose_job(ext, as_of)
    else:
        jobs = ext.select("seq", "title", "company_name", "location", "description", "qualifications", "responsibilities",
                          F.lit("").alias("url"), F.lit(None).cast("date").alias("date_listed"),
                          *[F.col(f"extraction.{f}").alias(f) for f in EXTRACTED], "dedup_hash", "raw_json")
    names = keywords.select("kind", "id", "name").unionByName(cands)
    lists = (jk.join(names, ["kind", "id"]).groupBy("seq").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))).alias(col)
          for kind, col in (("skill", "skills"), ("framework", "frameworks"))]))
    empty = F.array().cast("array<string>")
    jobs = jobs.join(lists, "seq", "left").withColumns({c: F.coalesce(c, empty) for c in ("skills", "frameworks")})
    jobs = V.embed_hashed(jobs.withColumn("_emb", L.compose_embedding_text()), "_emb", "embedding").drop("_emb")
    if scores is not None:
        cols = [c for c in ("t2_score", "t2_explanation") if c in scores.columns]
        jobs = jobs.join(scores.select("seq", *cols), "seq", "left")
    one = None if profile is None else profile.select("profile_keywords", "pref_attendance", "pref_seniority", "pref_salary").limit(1)
    if scores is None and one is not None:
        jobs = SC.score_tier2(jobs.withColumn("job_keywords", F.concat("skills", "frameworks")).crossJoin(F.broadcast(one)))
        jobs = jobs.drop("job_keywords", *one.columns)
    for c, t in (("t2_score", "double"), ("t2_explanation", "string")):
        if c not in jobs.columns:
            jobs = jobs.withColumn(c, F.lit(None).cast(t))
    jobs = scratch_table(jobs.withColumn("status", route_status("t2_score")), "jobs")
    queue = tier3_queue(jobs)
    if one is not None:
        deep = SC.score_tier3(queue.select("seq", "dedup_hash", "t2_score", "attendance", "seniority", "salary_max", F.concat("skills", "frameworks").alias("job_keywords"))
                              .crossJoin(F.broadcast(one)))
        queue = scratch_table(deep.select("seq", "dedup_hash", "t2_score", *TIER3), "tier3")
        # a hash is one listing of the batch, also where numbers repeat
        jobs = write_tier3(jobs.withColumn("job_id", F.col("dedup_hash")), queue.withColumn("job_id", F.col("dedup_hash"))).drop("job_id")
    else:
        empty_scores = {c: F.lit(None).cast("string" if c == "t3_explanation" else "double") for c in TIER3}
        queue, jobs = queue.withColumns(empty_scores), jobs.withColumns(empty_scores)

    def outcome(rows, what, reason):
        return rows.select("seq", F.lit(what).alias("outcome"), F.lit(reason).cast("string").alias("reason"))

    outcomes = (outcome(ext, "inserted", None).unionByName(outcome(lost, "failed", "extraction"))
                .unionByName(outcome(exact, "duplicate", "exact_hash")).unionByName(outcome(repeats, "duplicate", "exact_hash"))
                .unionByName(outcome(fuzzy_dups, "duplicate", "fuzzy")))
    return IngestResult(jobs, jk, cands, sink_failed(lost).join(known, "dedup_hash", "left_anti"),
                        queue.select("seq", "t2_score", *TIER3), outcomes, batch_summary(outcomes))
