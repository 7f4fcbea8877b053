"""Incremental ingestion with Structured Streaming.

Landed pages are read as a file stream. Keyed state (``streaming.state``) applies
the page rules and finds exact duplicates and the earlier listings that a new one
resembles, so a micro-batch does not read the store. ``foreachBatch`` then
settles the greedy order of arrival, runs the batch ingestion on what is left and
writes the batch's rows.

Every table of the store is a folder of batches (``batch=<run>-<epoch>``), and a
batch that is run again replaces its own folder, so nothing is written twice.
What a batch reads beside its own rows is bounded by the batch: the last batch's
number and, of the listings dropped as similar, the hash buckets of those that
its listings resemble. A new checkpoint on a store that has rows already takes
its state from them, once.

``rejected`` holds landed lines that are no pages, with file and reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblake.operators.dedup import greedy_drops, with_hash
from joblake.operators.keywords import dense_ids
from joblake.operators.listing import filter_valid_listing
from joblake.plans.ingest import ingest_batch
from joblake.schemas import LISTING
from joblake.session import drop_scratch, scratch_table
from joblake.sources.pages import explode_listings, landed_records
from joblake.streaming.state import ARRIVAL_ROWS, PAGE_ROWS, Arrivals, PageRules, arrival_keys, page_keys

STORE_SCHEMA = ("seq long, job_id string, title string, company_name string, location string, description string, "
                "qualifications string, responsibilities string, url string, date_listed date, employment_type string, "
                "attendance string, seniority string, experience_years_min int, experience_years_max int, salary_min int, "
                "salary_max int, salary_currency string, salary_period string, raw_json string, skills array<string>, "
                "frameworks array<string>, embedding struct<size:int,indices:array<int>,values:array<double>>, "
                "t2_score double, t2_explanation string, t3_score double, t3_qualification double, t3_fit double, "
                "t3_explanation string, status string, dedup_hash string, batch string, bucket int")
JUNCTION_SCHEMA = "dedup_hash string, kind string, id long"
CANDIDATE_SCHEMA = "kind string, id long, name string"
DROPPED_SCHEMA = "dedup_hash string, bucket int, batch string"
REJECTED_SCHEMA = "file string, reason string, record string"
BUCKETS = 256
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the store; a path that does not exist yet is an empty one.
    Any other failure to read is raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_store(spark: SparkSession, store_path: str) -> DataFrame:
    return _read(spark, f"{store_path}/jobs", STORE_SCHEMA)


def read_junction(spark: SparkSession, store_path: str) -> DataFrame:
    return _read(spark, f"{store_path}/job_keywords", JUNCTION_SCHEMA)


def read_candidates(spark: SparkSession, store_path: str) -> DataFrame:
    return _read(spark, f"{store_path}/candidates", CANDIDATE_SCHEMA)


def number_listings(pages: DataFrame) -> DataFrame:
    """Listings with ``seq``, their order of arrival: query, page, place in the
    page. The source's own id is opaque text and is kept as ``job_id``."""
    rows = explode_listings(pages, positions=True)
    return dense_ids(rows.withColumn("_row", F.xxhash64(F.to_json(F.struct(*rows.columns)))), ["query", "page_no", "position", "_row"], 0).withColumnRenamed("new_id", "seq").drop("_row", "position", "page_no")


def read_rejected(spark: SparkSession, store_path: str) -> DataFrame:
    return _read(spark, f"{store_path}/rejected", REJECTED_SCHEMA)


def _bucket(c: str):
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _write(rows: DataFrame, path: str, *parts: str) -> None:
    """Replace the batch's own folders."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def stream_ingest(spark: SparkSession, landing: str, store_path: str, checkpoint: str, keywords: DataFrame,
                  aliases: DataFrame, *, as_of, fuzzy: bool = True, max_pages: int = 10,
                  max_files_per_trigger: int = 100, mode: str = "equals", **options) -> None:
    """Process every page file under ``landing`` not yet seen, then stop
    (``availableNow``). The store under ``store_path`` has listings, junction
    rows, keyword candidates, hashes dropped as similar, and rejected lines."""
    lines = (spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(landing)
             .select("value", F.col("_metadata.file_path").alias("file")))
    listings = (page_keys(landed_records(lines)).groupBy("key")
                .transformWithState(PageRules(max_pages), PAGE_ROWS, "Append", "None"))
    job = F.from_json("body", LISTING)
    known = listings.withColumn("job", F.when(F.col("what") == "listing", job))
    valid = filter_valid_listing(known.select("what", "query", "page_no", "position", "body", "job.*").where("what = 'listing'"), mode)
    columns = ["what", "dedup_hash", "title", "company_name", "query", "page_no", "position", "body"]
    hashed = with_hash(valid).select(*columns)
    rejected = known.where("what = 'rejected'").select("what", F.md5("body").alias("dedup_hash"), F.lit("").alias("title"), F.lit("").alias("company_name"),
                                                       "query", "page_no", "position", "body")
    keyed = arrival_keys(hashed.unionByName(rejected))
    fresh_state = not _exists(spark, checkpoint)
    store = read_store(spark, store_path)
    initial = None
    if fresh_state and _exists(spark, f"{store_path}/jobs"):
        none = F.lit(None)
        initial = arrival_keys(store.select(F.lit("listing").alias("what"), "dedup_hash", "title", "company_name", none.cast("string").alias("query"),
                                            none.cast("int").alias("page_no"), none.cast("int").alias("position"), none.cast("string").alias("body"))).groupBy("key")
    arrived = keyed.groupBy("key").transformWithState(Arrivals(), ARRIVAL_ROWS, "Append", "None", initialState=initial)
    # one run of batches per checkpoint
    run_id = spark.range(1).select(F.substring(F.md5(F.lit(checkpoint)), 1, 8)).first()[0]
    schema = spark.createDataFrame([], STORE_SCHEMA).schema

    def settle(rows: DataFrame, numbered: DataFrame) -> DataFrame:
        """Numbers of the listings to drop: those like a kept earlier one."""
        place = ["dedup_hash", "query", "page_no", "position"]
        links = (rows.where("what = 'link'").join(numbered.select(*place, F.col("seq").alias("r")), place)
                 .join(numbered.select(F.col("dedup_hash").alias("other"), F.col("seq").alias("c")), "other", "left").select("r", "c", "other", "same"))
        links = scratch_table(links.distinct(), "links")
        old = links.where("c is null and not same").select(F.col("other").alias("dedup_hash")).distinct()
        buckets = [r[0] for r in old.select(_bucket("dedup_hash")).distinct().collect()]  # at most BUCKETS
        gone = _read(spark, f"{store_path}/dropped", DROPPED_SCHEMA).where(F.col("bucket").isin(buckets)).select(F.col("dedup_hash").alias("other")).distinct()
        open_ = links.where("same or c is not null").unionByName(links.where("not same and c is null").join(gone, "other", "left_anti").select(*links.columns))
        return greedy_drops(open_.select("r", F.when(F.col("same"), F.lit(-1)).otherwise(F.coalesce("c", F.lit(-1))).cast("long").alias("c")).distinct())

    def run(batch: DataFrame, epoch: int) -> None:
        name = f"{run_id}-{epoch:06d}"
        before = f"{store_path}/progress/batch={run_id}-{epoch - 1:06d}" if epoch else f"{store_path}/progress"
        start = _read(spark, before, "last long").agg(F.coalesce(F.max("last"), F.lit(0)).alias("s")).first()["s"]
        rows = scratch_table(batch, "micro-batch")
        numbered = scratch_table(dense_ids(rows.where("what = 'listing'").select("dedup_hash", "query", "page_no", "position", "body"),
                                           ["query", "page_no", "position", "dedup_hash"], start).withColumnRenamed("new_id", "seq"), "numbered")
        drops = settle(rows, numbered).withColumnRenamed("r", "seq").distinct() if fuzzy else numbered.select("seq").limit(0)
        drops = scratch_table(drops, "similar")
        kept = numbered.join(drops, "seq", "left_anti").select("seq", "query", job.alias("job")).select("seq", "query", "job.*")
        kept = scratch_table(kept, "kept")
        vocabulary = keywords.unionByName(read_candidates(spark, store_path), allowMissingColumns=True)
        res = ingest_batch(kept, store.limit(0).select("title", "company_name", "dedup_hash"), vocabulary, aliases, as_of=as_of, fuzzy=False, mode=mode, **options)
        new = (res.jobs.join(kept.select("seq", "job_id"), "seq", "left").unionByName(res.quarantine, allowMissingColumns=True)
               .withColumn("bucket", _bucket("dedup_hash")).withColumn("batch", F.lit(name)))
        new = scratch_table(new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]), "new-listings")
        own = F.lit(name).alias("batch")
        _write(res.job_keywords.join(new.select("seq", "dedup_hash"), "seq").select("dedup_hash", "kind", "id", own), f"{store_path}/job_keywords", "batch")
        _write(res.candidates.select("kind", "id", "name", own), f"{store_path}/candidates", "batch")
        _write(numbered.join(drops, "seq").select("dedup_hash", _bucket("dedup_hash").alias("bucket"), own), f"{store_path}/dropped", "bucket", "batch")
        bad = rows.where("what = 'rejected'")
        _write(bad.select(F.col("query").alias("file"), F.substring_index("body", "\n", 1).alias("reason"), F.expr("substr(body, instr(body, '\n') + 1)").alias("record"), own),
               f"{store_path}/rejected", "batch")
        _write(new, f"{store_path}/jobs", "batch", "bucket")
        # last: the batch is whole
        _write(numbered.agg(F.coalesce(F.max("seq"), F.lit(start)).alias("last")).select("last", own), f"{store_path}/progress", "batch")
        drop_scratch(rows, numbered, drops, kept, new)

    provider = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        q = (arrived.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, provider) if provider else spark.conf.unset(STATE_STORE)
