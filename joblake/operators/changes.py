"""Table changes as snapshots: ``old snapshot + change frame → new snapshot``.

Plain parquet has no in-place update; each function is pure and the caller
writes the result to a new versioned path (``write_snapshot``). Changes are
keyed left joins, so they never shuffle more than the two sides once, and
rerunning a change on its own output gives the same snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblake.schemas import ASSISTANCE_LEVELS, JOB_STATUSES

# fixed values: the fields of an application that may be changed, and form texts that count as true
APP_FIELDS = ["date_applied", "state", "assistance_level", "cover_letter", "resume",
              "cold_calls", "reached_human", "interviews", "offer", "effort"]
TRUTHY = ["1", "true", "on", "yes"]


def latest(changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One change per key: the one with the largest ``order`` (a column of the
    changes; the later change wins), or without an order the largest by value,
    so that a repeated key never repeats a row of the snapshot."""
    rest = [c for c in changes.columns if c not in keys]
    first = [order] if order else []
    return (changes.groupBy(*keys).agg(F.max(F.struct(*first, *[c for c in rest if c not in first])).alias("_m"))
            .select(*keys, *[F.col("_m").getField(c).alias(c) for c in rest]))


def _ts(now):
    return now if isinstance(now, F.Column) else F.lit(now).cast("timestamp")


def expire_jobs(jobs: DataFrame, now, days: int) -> DataFrame:
    """Active listings whose date (as midnight) is before now - days → expired."""
    cut = _ts(now) - F.make_dt_interval(F.lit(days))
    hit = (F.col("status") == "active") & (F.col("date_listed").cast("timestamp") < cut)
    return jobs.withColumn("status", F.when(hit, F.lit("expired")).otherwise(F.col("status")))


def expire_applications(apps: DataFrame, today, days: int = 30) -> DataFrame:
    """Submitted applications dated before today - days → expired (exactly
    ``days`` old does not expire)."""
    d = today if isinstance(today, F.Column) else F.lit(today).cast("date")
    hit = (F.col("state") == "submitted") & (F.col("date_applied") < F.date_sub(d, days))
    return apps.withColumn("state", F.when(hit, F.lit("expired")).otherwise(F.col("state")))


def update_status(jobs: DataFrame, changes: DataFrame, now, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, rejects): set status by job_id when the value is one of
    the user-settable statuses, stamping date_updated."""
    ok = latest(changes.where(F.col("status").isin(JOB_STATUSES)), ["job_id"], order).select("job_id", F.col("status").alias("_new"))
    rejects = changes.where(~F.col("status").isin(JOB_STATUSES) | F.col("status").isNull())
    out = jobs.join(ok, "job_id", "left")
    out = (out.withColumn("date_updated", F.when(F.col("_new").isNotNull(), _ts(now))
                          .otherwise(F.col("date_updated") if "date_updated" in jobs.columns else F.lit(None).cast("timestamp")))
           .withColumn("status", F.coalesce("_new", "status")).drop("_new"))
    return out, rejects


def write_scores(jobs: DataFrame, scores: DataFrame, cols: list[str], order: str | None = None) -> DataFrame:
    """Write score columns by job_id (new value, else the old one); one score
    per listing, the last in ``order``."""
    s = latest(scores.select("job_id", *cols, *([order] if order and order not in cols else [])), ["job_id"], order).select("job_id", *[F.col(c).alias(f"_n_{c}") for c in cols])
    out = jobs.join(s, "job_id", "left")
    for c in cols:
        old = F.col(c) if c in jobs.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.col(f"_n_{c}"), old)).drop(f"_n_{c}")
    return out


def write_tier2(jobs: DataFrame, scores: DataFrame, order: str | None = None) -> DataFrame:
    return write_scores(jobs, scores, ["t2_score", "t2_explanation"], order)


def write_tier3(jobs: DataFrame, scores: DataFrame, order: str | None = None) -> DataFrame:
    return write_scores(jobs, scores, ["t3_score", "t3_qualification", "t3_fit", "t3_explanation"], order)


def reprocess_upsert(jobs: DataFrame, updates: DataFrame, job_keywords: DataFrame,
                     new_keywords: DataFrame, fields: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace listing ``fields`` of stored rows matched by dedup_hash (scores
    and date_listed kept); junction rows of those listings are rebuilt from
    ``new_keywords`` (dedup_hash, kind, id). When a batch repeats a hash, the
    last update in ``order`` wins. ``fields`` may hold the embedding: it is
    replaced like any other field."""
    u = (latest(updates.select("dedup_hash", *fields, *([order] if order and order not in fields else [])), ["dedup_hash"], order)
         .select("dedup_hash", *[F.col(c).alias(f"_u_{c}") for c in fields], F.lit(True).alias("_hit")))
    out = jobs.join(u, "dedup_hash", "left")
    for c in fields:
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c))).drop(f"_u_{c}")
    out = out.drop("_hit")
    touched = jobs.join(updates.select("dedup_hash"), "dedup_hash", "left_semi").select("job_id", "dedup_hash")
    kept = job_keywords.join(touched.select("job_id"), "job_id", "left_anti")
    # listings of one hash send their keywords once, or each would meet those of all the others
    rebuilt = (new_keywords.select("dedup_hash", "kind", "id").distinct().join(touched, "dedup_hash").select("job_id", "kind", "id")
               .dropDuplicates(["job_id", "kind", "id"]))
    return out, kept.unionByName(rebuilt.select(*kept.columns))


def create_application(apps: DataFrame, jobs: DataFrame, new: DataFrame, now,
                       order: str = "seq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(applications, listings, rejects): new application rows get ids after
    the largest one in ``order``; a listing gets the back-pointer of its
    newest application, status 'applied' and a stamp. Rows with an invalid
    assistance level are rejected."""
    from joblake.operators.keywords import dense_ids

    valid = F.col("assistance_level").isNull() | F.col("assistance_level").isin(ASSISTANCE_LEVELS)
    rejects = new.where(~valid)
    good = new.where(valid)
    start = apps.agg(F.coalesce(F.max("application_id"), F.lit(0)).alias("start"))
    numbered = dense_ids(good, [order], start).withColumnRenamed("new_id", "application_id")
    defaults = {"state": F.lit("submitted"), "cold_calls": F.lit(0), "reached_human": F.lit(0),
                "interviews": F.lit(0), "offer": F.lit(0)}
    cols = []
    for c in apps.columns:
        if c in numbered.columns:
            col = F.col(c)
            if c in defaults:
                col = F.coalesce(col, defaults[c])
            cols.append(col.cast(dict(apps.dtypes)[c]).alias(c))
        else:
            cols.append(defaults.get(c, F.lit(None)).cast(dict(apps.dtypes)[c]).alias(c))
    apps2 = apps.unionByName(numbered.select(*cols))
    latest = numbered.groupBy("job_id").agg(F.max("application_id").alias("_aid"))
    j = jobs.join(latest, "job_id", "left")
    j = (j.withColumn("application_id", F.coalesce("_aid", "application_id"))
         .withColumn("status", F.when(F.col("_aid").isNotNull(), F.lit("applied")).otherwise(F.col("status")))
         .withColumn("date_updated", F.when(F.col("_aid").isNotNull(), _ts(now)).otherwise(
             F.col("date_updated") if "date_updated" in jobs.columns else F.lit(None).cast("timestamp")))
         .drop("_aid"))
    return apps2, j, rejects


def update_application(apps: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Sparse update: ``changes`` has application_id, ``set_fields`` (names
    of the fields being set, so 'set to NULL' differs from 'absent') and one
    column per field. Only whitelisted fields change; state 'offer' forces
    offer = 1. Of several changes to one application the last in ``order`` wins."""
    present = [c for c in APP_FIELDS if c in changes.columns]
    changes = latest(changes, ["application_id"], order)
    ch = changes.select("application_id", "set_fields", *[F.col(c).alias(f"_c_{c}") for c in present])
    out = apps.join(ch, "application_id", "left")
    for c in present:
        is_set = F.coalesce(F.array_contains("set_fields", c), F.lit(False))
        out = out.withColumn(c, F.when(is_set, F.col(f"_c_{c}").cast(dict(apps.dtypes)[c])).otherwise(F.col(c)))
    if "state" in present and "offer" in apps.columns:
        offer_now = F.coalesce(F.array_contains("set_fields", "state"), F.lit(False)) & (F.col("_c_state") == "offer")
        out = out.withColumn("offer", F.when(offer_now, F.lit(1)).otherwise(F.col("offer")))
    return out.drop("set_fields", *[f"_c_{c}" for c in present])


def coerce_int(c) -> F.Column:
    """Form text → integer; anything unparsable → 0."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int")).otherwise(F.lit(0)).alias("_i")


def coerce_flag(c) -> F.Column:
    """Form text → 1 when one of 1/true/on/yes (exact), else 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(TRUTHY), F.lit(1)).otherwise(F.lit(0))


def coerce_effort(c) -> F.Column:
    """Form text → double, or NULL when empty or unparsable."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("double")).otherwise(F.trim(c).try_cast("double"))


def backfill_state(apps: DataFrame) -> DataFrame:
    """A missing state becomes 'offer' when offer = 1, else 'submitted'."""
    return apps.withColumn("state", F.coalesce(
        F.col("state"), F.when(F.col("offer") == 1, F.lit("offer")).otherwise(F.lit("submitted"))))


def write_snapshot(df: DataFrame, base_path: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write a table version to ``base_path/v=<version>`` (never over an
    existing version) and return its path."""
    path = f"{base_path.rstrip('/')}/v={version:06d}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
