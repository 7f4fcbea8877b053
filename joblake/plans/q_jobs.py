"""Sources, sinks, extraction, scoring, matching, ingestion and streaming
run end to end on data derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblake.operators import listing as L
from joblake.operators import scoring as SC
from joblake.operators.extract import extract_fields
from joblake.plans.bindings import AS_OF_DATE
from joblake.plans.registry import register
from joblake.session import scratch_path, scratch_table
from joblake.sources import pages as PG
from joblake.sources import sinks as SK
from joblake.sources import taxonomy as TX


def _doc_pages(T):
    """Listings of the documents ten to a page and up to twelve pages to a
    query, written the way a fetch run lands them: a query is a language and a
    range of ids, so their number grows with the table."""
    d = T.spread("b_doc_listings")
    listing = F.struct(
        F.col("title"), F.col("company_name"), F.col("location"), F.col("via"),
        F.concat(F.lit("https://share.example.org/"), F.col("seq").cast("string")).alias("share_link"),
        F.col("description"), F.array(F.lit("Full-time")).alias("extensions"),
        F.struct(F.concat((F.col("seq") % 40).cast("string"), F.lit(" days ago")).alias("posted_at"),
                 F.lit("Full-time").alias("schedule_type"), (F.col("seq") % 2 == 0).alias("work_from_home"))
        .alias("detected_extensions"),
        F.array(F.struct(F.lit("Qualifications").alias("title"),
                         F.array(F.col("location"), F.col("via")).alias("items"))).alias("job_highlights"),
        F.array(F.struct(F.lit("Apply").alias("title"),
                         F.concat(F.lit("https://apply.example.org/"), F.col("seq").cast("string")).alias("link")))
        .alias("apply_options"),
        F.col("seq").cast("string").alias("job_id"))
    query = F.concat("location", F.lit("-"), F.floor(F.col("seq") / 120).cast("string")).alias("query_name")
    return (d.select(query, (F.floor(F.col("seq") / 10) % 12 + 1).cast("int").alias("page_no"), listing.alias("job"))
            .groupBy("query_name", "page_no").agg(F.array_sort(F.collect_list("job"), lambda x, y: F.when(
                x["job_id"].cast("long") < y["job_id"].cast("long"), -1).otherwise(1)).alias("jobs_results"))
            .select(F.col("query_name").alias("_query_name"), F.lit(None).cast("string").alias("error"),
                    "jobs_results", F.struct(F.lit(None).cast("string").alias("next_page_token"))
                    .alias("serpapi_pagination"), "query_name", "page_no"))


@register("scan_pages")
def scan_pages(T):
    """Pages written as JSON arrays (several per file) and read back → listings."""
    path = scratch_path(T.spark, "pages")
    PG.write_page_files(_doc_pages(T).drop("query_name", "page_no"), path)
    return PG.scan_pages(T.spark, path).select("query", "title", "company_name", "job_id")


@register("scan_landing")
def scan_landing(T):
    """Landed pages with an error page per query; a query stops at its first
    failed page and after ``max_pages``."""
    path = scratch_path(T.spark, "landing")
    pages = _doc_pages(T).withColumn("error", F.when(F.col("page_no") == 7, F.lit("rate limited")))
    pages.write.json(path)
    return PG.scan_landing(T.spark, path, max_pages=10).select("query", "title", "job_id")


@register("quarantine_pages", """
WITH l AS (SELECT CAST(seq AS VARCHAR) AS job_id, location || '-' || CAST(CAST(floor(seq / 120) AS BIGINT) AS VARCHAR) AS query_name,
                  CAST(floor(seq / 10) AS BIGINT) % 12 + 1 AS page_no FROM b_doc_listings),
p AS (SELECT DISTINCT query_name, page_no FROM l)
SELECT 'listing' AS outcome, CAST(NULL AS VARCHAR) AS reason, job_id, 1 AS n FROM l WHERE page_no NOT IN (2, 3, 5, 6)
UNION ALL SELECT 'rejected', reason, NULL, count(*) FROM (
  SELECT CASE page_no WHEN 2 THEN 'not an object' WHEN 6 THEN 'jobs_results is of another type' ELSE 'not JSON' END AS reason FROM p WHERE page_no IN (2, 3, 5, 6))
GROUP BY reason
""")
def quarantine_pages(T):
    """A landing folder in which some lines are cut off, no JSON, no object, of
    another type, or have fields that are not known: listings, and rejected
    lines by reason."""
    path = scratch_path(T.spark, "landing_bad")
    pages = _doc_pages(T).withColumn("unknown_field", F.col("page_no"))
    line = F.to_json(F.struct(*pages.columns))
    bad = (F.when(F.col("page_no") == 2, F.concat(F.lit("["), line, F.lit("]"))).when(F.col("page_no") == 3, F.expr("left(line, cast(length(line) / 2 as int))"))
           .when(F.col("page_no") == 5, "<html>Service unavailable</html>").when(F.col("page_no") == 6, F.regexp_replace("line", '"jobs_results":.*', '"jobs_results":"none"}')))
    pages.withColumn("line", line).select(F.coalesce(bad, "line").alias("value")).write.text(path)
    good, rejected = PG.read_landing(T.spark, path)
    return (PG.explode_listings(good).select(F.lit("listing").alias("outcome"), F.lit(None).cast("string").alias("reason"), "job_id", F.lit(1).cast("long").alias("n"))
            .unionByName(rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("outcome"), "reason", F.lit(None).cast("string").alias("job_id"), "n")))


@register("union_pages")
def union_pages(T):
    a = scratch_path(T.spark, "pages_a")
    b = scratch_path(T.spark, "pages_b")
    p = _doc_pages(T).drop("query_name", "page_no")
    PG.write_page_files(p.where(F.col("_query_name") < "f"), a)
    PG.write_page_files(p.where(F.col("_query_name") >= "f"), b)
    return PG.scan_pages(T.spark, [a, b]).select("query", "job_id")


@register("filter_flatten_url")
def filter_flatten_url(T):
    """Validity filter, highlight flattening, primary url and posted date on landed listings."""
    path = scratch_path(T.spark, "pages_f")
    PG.write_page_files(_doc_pages(T).drop("query_name", "page_no"), path)
    ls = L.flatten_highlights(L.filter_valid_listing(PG.scan_pages(T.spark, path)))
    return ls.select("job_id", "qualifications", "responsibilities", L.primary_url().alias("url"),
                     L.parse_posted_at(F.col("detected_extensions.posted_at"), AS_OF_DATE).alias("date_listed"))


@register("scan_taxonomy")
def scan_taxonomy(T):
    """Keyword names written as a seed CSV (with blank hierarchy fields) and
    loaded on top of an existing table holding half of them."""
    path = scratch_path(T.spark, "skills_csv")
    kw = T.keywords
    (kw.select("domain", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("domain")).alias("core_competency"),
               F.lit("").alias("competency"), F.col("name").alias("skill"))
     .write.option("header", True).csv(path))
    existing = kw.where(F.col("id") % 2 == 0).select("id", "kind", "name", "domain", F.lit(None).cast("string").alias("l2"),
                                                     F.lit(None).cast("string").alias("l3"), "is_candidate", "user_level")
    return TX.scan_taxonomy(T.spark, path, "skill", existing).drop("l3")


@register("scan_aliases")
def scan_aliases(T):
    path = scratch_path(T.spark, "aliases_csv")
    kw = T.keywords
    (kw.select(F.upper(F.col("name")).alias("alias"),
               F.when(F.col("id") % 4 == 0, F.concat(F.col("name"), F.lit("?"))).otherwise(F.col("name"))
               .alias("canonical_name"))
     .write.option("header", True).csv(path))
    ok, unknown = TX.scan_aliases(T.spark, path, "skill", kw)
    return ok.select("alias", "id").unionByName(unknown.select("alias", F.lit(None).cast("long").alias("id")))


@register("sink_plan")
def sink_plan(T):
    """Plan written as JSON and read back (scan_plan)."""
    from joblake.plans.q_curation import _plan
    path = scratch_path(T.spark, "plan")
    SK.sink_plan(_plan(T), path)
    return SK.scan_plan(T.spark, path)


@register("union_pool", """
SELECT kind, id, name, CASE WHEN is_candidate = 1 THEN 'candidate' ELSE 'canonical' END AS pool
FROM b_keywords
""")
def union_pool(T):
    kw = T.keywords
    canon = kw.where(F.col("is_candidate") == 0).select("kind", "id", "name", F.lit("canonical").alias("pool"))
    cand = kw.where(F.col("is_candidate") == 1).select("kind", "id", "name", F.lit("candidate").alias("pool"))
    return canon.unionByName(cand)


@register("extract_fields")
def extract_fields_q(T):
    """Rule extraction over the listing texts of the job binding and the documents."""
    a = T.jobs.select(F.col("job_id").alias("seq"), "title", "description", "qualifications")
    b = T.doc_listings.select((-1 - F.col("seq")).alias("seq"), "title", "description",
                              F.lit("").alias("qualifications"))
    return extract_fields(a.unionByName(b)).select("seq", "extraction.*")


@register("clean_extraction")
def clean_extraction(T):
    """Extractions with out-of-domain values and blank list entries, cleaned."""
    raw = T.jobs.select("job_id", F.struct(
        F.when(F.col("job_id") % 5 == 0, F.lit("freelance")).otherwise(F.col("employment_type")).alias("employment_type"),
        F.col("attendance").alias("attendance"),
        F.when(F.col("job_id") % 7 == 0, F.lit("intern")).otherwise(F.col("seniority")).alias("seniority"),
        F.lit(None).cast("int").alias("experience_years_min"), F.lit(None).cast("int").alias("experience_years_max"),
        F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"),
        F.when(F.col("salary_period").isNull(), F.lit("weekly")).otherwise(F.col("salary_period")).alias("salary_period"),
        F.array(F.col("title"), F.lit("  "), F.lit(None).cast("string")).alias("skills"),
        F.when(F.col("job_id") % 2 == 0, F.lit(None).cast("array<string>")).otherwise(F.array(F.col("location")))
        .alias("frameworks")).alias("raw"))
    return raw.select("job_id", L.clean_extraction("raw").alias("e")).select("job_id", "e.*")


@register("compose_job")
def compose_job(T):
    path = scratch_path(T.spark, "pages_c")
    PG.write_page_files(_doc_pages(T).drop("query_name", "page_no"), path)
    ls = L.flatten_highlights(PG.scan_pages(T.spark, path))
    return L.compose_job(extract_fields(ls), AS_OF_DATE)


@register("report_dry_run")
def report_dry_run(T):
    path = scratch_path(T.spark, "pages_r")
    PG.write_page_files(_doc_pages(T).drop("query_name", "page_no"), path)
    ls = extract_fields(PG.scan_pages(T.spark, path))
    ls = ls.withColumn("extraction", F.when(F.length("description") >= 1000, F.col("extraction")))
    return SK.report_dry_run(ls).drop("extraction")


def _pairs(T):
    """(profile, listing) pairs: the listings dealt over all conversation
    profiles; a profile's keywords are those of the listing with its id (an
    equi-join, no cross product)."""
    jobs = T.jobs
    names = T.job_keywords.join(T.keywords.select("kind", "id", "name"), ["kind", "id"]).groupBy("job_id").agg(
        F.collect_set("name").alias("job_keywords"))
    prof = T.conversations.groupBy(F.col("conv_id").alias("profile_id")).agg(F.count(F.lit(1)).alias("turns"))
    p = prof.join(names.select(F.col("job_id").alias("profile_id"), F.col("job_keywords").alias("profile_keywords")),
                  "profile_id", "left")
    n = T.conversations.agg(F.count_distinct("conv_id").alias("n"))  # one row
    j = jobs.crossJoin(F.broadcast(n)).select("job_id", "attendance", "seniority", "salary_max", (F.col("job_id") % F.col("n")).alias("profile_id"))
    return (j.join(names, "job_id").join(p, "profile_id")
            .withColumn("pref_attendance", F.lit("remote")).withColumn("pref_seniority", F.lit("senior"))
            .withColumn("pref_salary", F.lit(200000)))


@register("score_tier2")
def score_tier2(T):
    return SC.score_tier2(_pairs(T)).select("profile_id", "job_id", "t2_score", "t2_explanation")


@register("score_tier3")
def score_tier3(T):
    return SC.score_tier3(_pairs(T)).select("profile_id", "job_id", "t3_qualification", "t3_fit", "t3_score")


@register("batch_score")
def batch_score(T):
    """A user scorer (pandas) run over Arrow batches. It fails on one listing
    in a hundred; only those rows lose their score."""
    def fn(pdf):
        import pandas as pd
        if (pdf["job_id"] % 100 == 7).any():
            raise ValueError("no reply")
        s = pd.Series([len(set(a if a is not None else []) & set(b if b is not None else [])) * 10.0 for a, b in
                       zip(pdf["job_keywords"], pdf["profile_keywords"])], index=pdf.index)
        return pd.DataFrame({"t2_score": s.clip(upper=100), "t2_explanation": "shared keywords x10"})
    return SC.batch_score(_pairs(T).select("profile_id", "job_id", "job_keywords", "profile_keywords"), fn).select(
        "profile_id", "job_id", "t2_score", "t2_explanation")


# replies of a scorer: one line, several lines, a null score, no score, a negative fraction, text, broken JSON, a list
_REPLIES = [
    '{"score": %d, "explanation": "good fit"}', '{\n  "score": %d.75,\n  "explanation": "over\ntwo lines"\n}',
    '{"score": null, "explanation": "unsure"}', '{"explanation": "none given"}', '{"score": -%d.5}',
    'model timed out', '{broken json}', '[%d]', '{"score": "%d"}', ' {"score": %d} ',
]
_REPLY_SQL = "CASE event_id % 10 " + " ".join(
    f"WHEN {i} THEN replace('" + r.replace("\n", "~") + "', '%d', CAST(user_id AS @string))" for i, r in enumerate(_REPLIES)) + " END"


@register("parse_score", f"""
WITH r AS (SELECT event_id, replace({_REPLY_SQL.replace('@string', 'VARCHAR')}, '~', CASE WHEN event_id % 10 = 1 THEN chr(10) ELSE '~' END) AS reply FROM events),
j AS (SELECT event_id, reply, json_valid(reply) AND json_type(TRY_CAST(reply AS JSON)) = 'OBJECT' AS ok FROM (
        SELECT event_id, replace(reply, 'over' || chr(10) || 'two', 'over two') AS reply FROM r) x),
s AS (SELECT event_id, ok, json_exists(CASE WHEN ok THEN reply ELSE '{{}}' END, '$.score') AS has,
             TRY_CAST(json_extract_string(CASE WHEN ok THEN reply ELSE '{{}}' END, '$.score') AS DOUBLE) AS v,
             json_extract_string(CASE WHEN ok THEN reply ELSE '{{}}' END, '$.explanation') AS e FROM j)
SELECT event_id,
       CASE WHEN NOT ok THEN NULL WHEN NOT has THEN 0.0 ELSE trunc(v) END AS score,
       CASE WHEN NOT ok OR (has AND v IS NULL) THEN NULL ELSE coalesce(e, '') END AS explanation
FROM s
""")
def parse_score(T):
    r = F.replace(F.expr(_REPLY_SQL.replace("@string", "STRING")), F.lit("~"), F.when(F.col("event_id") % 10 == 1, "\n").otherwise("~"))
    r = F.replace(r, F.lit("over\ntwo"), F.lit("over two"))
    return T.events.select("event_id", SC.parse_score(r).alias("p")).select("event_id", "p.score", "p.explanation")


@register("parse_deep_score")
def parse_deep_score(T):
    ev = T.events
    reply = F.when(F.col("event_type") == "error", "not json").otherwise(
        F.concat(F.lit('{"qual_score": '), F.floor("value").cast("string"), F.lit(', "fit_score": '),
                 (F.col("user_id") % 100).cast("string"), F.lit(', "qual_explanation": "'), F.col("event_type"),
                 F.lit('"}')))
    return ev.select("event_id", SC.parse_deep_score(reply).alias("p")).select("event_id", "p.*")


def _match_inputs(T):
    names = T.job_keywords.join(T.keywords.select("id", "kind", "name"), ["kind", "id"])
    kw = names.groupBy("job_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "skill", F.col("name")))).alias("skills"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "framework", F.col("name")))).alias("frameworks"))
    jobs = T.jobs.join(kw, "job_id", "left").select("job_id", "status", "title", "qualifications",
                                                    "responsibilities", "skills", "frameworks", "attendance",
                                                    "seniority", "salary_max")
    blocks = T.profile_blocks
    profiles = (blocks.groupBy("profile_id")
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))),
                                              lambda x: x["block"]), "\n").alias("text")))
    return jobs, profiles


@register("match_profiles")
def match_profiles(T):
    """Funnel for every conversation profile: vector top 100 → tier 2 → top 15 → tier 3."""
    from joblake.plans.matching import match_profiles as run
    jobs, profiles = _match_inputs(T)
    return run(jobs, profiles)


@register("rescore")
def rescore(T):
    from joblake.plans.matching import rescore as run
    return run(T.jobs, lambda chosen: _pairs(T).join(chosen.select("job_id"), "job_id", "left_semi"),
               active_only=False, statuses=["active", "expired"]).select("job_id", "profile_id", "t3_score")


def _extract_some(df):
    """Rule extraction that fails on one listing in 29, as a remote model may."""
    return extract_fields(df).withColumn("extraction", F.when(F.col("seq") % 29 != 0, F.col("extraction")))


def _ingest(T):
    from joblake.operators.dedup import with_hash
    from joblake.plans.ingest import ingest_batch as run
    # the store as it is kept: with its hashes, worked out once and by all tasks
    store = scratch_table(with_hash(T.jobs.select("job_id", "title", "company_name", "location").repartition("job_id")).drop("location"), "store")
    listings = scratch_table(T.spread("b_doc_listings"), "landed")  # titles and companies are cut from the texts once
    profile = T.spark.createDataFrame([(["ink", "paper"], "remote", "senior", 100000)],
                                      "profile_keywords array<string>, pref_attendance string, pref_seniority string, pref_salary int")
    return run(listings, store, T.keywords, T.aliases, as_of=AS_OF_DATE, profile=profile, extract=_extract_some)


@register("ingest_batch")
def ingest_batch(T):
    """Documents as one landed batch against the listing store of the job
    binding: every valid listing with its outcome."""
    return _ingest(T).outcomes


@register("ingest_jobs")
def ingest_jobs(T):
    """The listings that the batch adds, with score, status and keywords."""
    r = _ingest(T)
    n = r.job_keywords.groupBy("seq").agg(F.count(F.lit(1)).alias("n_keywords"))
    return r.jobs.join(n, "seq", "left").select("seq", "title", "company_name", "t2_score", "t2_explanation", "status", "skills", "frameworks",
                                                F.size("embedding.indices").alias("n_terms"), F.coalesce("n_keywords", F.lit(0)).alias("n_keywords"))


@register("stream_ingest")
def stream_ingest(T):
    """Landed pages consumed by a file stream (availableNow); returns the store."""
    from joblake.streaming.ingest_stream import read_store
    from joblake.streaming.ingest_stream import stream_ingest as run
    spark = T.spark
    landing = scratch_path(spark, "stream_landing")
    PG.write_landing(_doc_pages(T), landing)
    store = scratch_path(spark, "stream_store")
    ckpt = scratch_path(spark, "stream_ckpt")
    run(spark, landing, store, ckpt, T.keywords, T.aliases, as_of=AS_OF_DATE, max_pages=12)
    return read_store(spark, store).select("job_id", "title", "company_name", "location", "url", "date_listed", "status", "dedup_hash")
