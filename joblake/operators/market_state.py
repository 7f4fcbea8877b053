"""The keyword market kept up to date by changes.

Per keyword the market needs counts and means, which are sums of what single
listings contribute. :meth:`KeptMarket.apply` takes the listings that changed,
as they were and as they are, and writes one small table: what the new rows
contribute less what the old ones did. :meth:`KeptMarket.market` adds the
tables up; no listing is read for it. A refresh so costs what has changed, and
reading costs the number of keywords, whatever the number of listings.

Layout, one folder per scope (listing mode and dates)::

    deltas/batch=N      contributions of batch N; a replay replaces the folder
    folded/upto=N       all batches up to N, added up

A folder counts once its ``_SUCCESS`` marker is there, so a crash between
writes leaves the state before it. Sums are decimals with six places: what a
listing has put in is taken out again exactly.

Edge cases: null scores and salaries count in no mean; a listing outside the
scope contributes nothing; a listing that is new has no row in ``before``, one
that is deleted none in ``after``; repeated rows count as often as they stand
there, as in the whole query; without any batch the market is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblake.operators.analytics import finish_market
from joblake.operators.filters import keyword_entry_predicate, keyword_job_predicate
from joblake.schemas import CANDIDATE_MIN_JOBS

_MEANS = ["fit", "qual", "salary"]
_COUNTS = ["raw_count", "actionable_count", *[f"{m}_n" for m in _MEANS]]
_SUMS = [f"{m}_sum" for m in _MEANS]
_STATE = "kind string, id long, " + ", ".join([f"{c} long" for c in _COUNTS] + [f"{c} decimal(38,6)" for c in _SUMS])


def _added(rows: DataFrame) -> DataFrame:
    """Contributions per keyword; the row without a keyword is the scope's own."""
    return rows.groupBy("kind", "id").agg(*[F.sum(c).cast("long").alias(c) for c in _COUNTS],
                                          *[F.sum(c).cast("decimal(38,6)").alias(c) for c in _SUMS])


def contributions(listings: DataFrame, job_keywords: DataFrame, sign: int = 1, **scope) -> DataFrame:
    """What ``listings`` add to (``sign`` -1: take from) every keyword's sums."""
    q = F.col("t3_qualification")
    value = {"fit": F.col("t3_fit"), "qual": q, "salary": F.when(F.col("salary_period") == "yearly", F.col("salary_max"))}
    rows = listings.where(keyword_job_predicate(**scope)).select(
        "job_id", F.lit(sign).alias("raw_count"),
        F.when((q >= 50) & (q < 80), sign).otherwise(0).alias("actionable_count"),
        *[F.when(v.isNotNull(), sign).otherwise(0).alias(f"{m}_n") for m, v in value.items()],
        *[(F.coalesce(v.cast("decimal(18,6)"), F.lit(0)) * sign).cast("decimal(18,6)").alias(f"{m}_sum") for m, v in value.items()])
    own = rows.drop("job_id").select(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("id"), *_COUNTS, *_SUMS)
    per = rows.join(job_keywords.select("job_id", "kind", F.col("id").cast("long").alias("id")), "job_id").drop("job_id")
    return _added(per).unionByName(_added(own))


class KeptMarket:
    """The state under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, *, listing_mode: str = "active", date_from=None, date_to=None):
        self.spark = spark
        self.scope = {"listing_mode": listing_mode, "date_from": date_from, "date_to": date_to}
        self.path = f"{path.rstrip('/')}/{listing_mode}-{date_from or 'any'}-{date_to or 'any'}"

    def _committed(self, folder: str, key: str) -> list[int]:
        """The numbers of the finished folders ``folder/key=N``, ascending."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/{key}=*/_SUCCESS")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def _upto(self) -> int:
        return max(self._committed("folded", "upto"), default=-1)

    def apply(self, batch: int, before: DataFrame, after: DataFrame, keywords_before: DataFrame,
              keywords_after: DataFrame | None = None) -> None:
        """One batch of changes: the changed listings' old and new rows, and
        their junction rows (``keywords_after`` where these changed too). Batches
        are numbered from 0 in any order; the same number again replaces the
        batch, unless it is folded already."""
        if batch <= self._upto():
            raise ValueError(f"batch {batch} is folded already")
        new = contributions(after, keywords_before if keywords_after is None else keywords_after, **self.scope)
        old = contributions(before, keywords_before, -1, **self.scope)
        _added(new.unionByName(old)).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")

    def state(self) -> DataFrame:
        """The sums per keyword over all finished batches."""
        upto = self._upto()
        paths = [f"{self.path}/deltas/batch={n}" for n in self._committed("deltas", "batch") if n > upto]
        if upto >= 0:
            paths.append(f"{self.path}/folded/upto={upto}")
        if not paths:
            return self.spark.createDataFrame([], _STATE)
        return _added(self.spark.read.schema(_STATE).parquet(*paths))

    def fold(self) -> None:
        """Add up all finished batches into one table, so that reading does not
        grow with their number. Every batch below the last must be finished."""
        done = self._committed("deltas", "batch")
        if done and done[-1] > self._upto():
            some = F.lit(False)
            for c in [*_COUNTS, *_SUMS]:
                some |= F.col(c) != 0
            self.state().where(some).write.mode("overwrite").parquet(f"{self.path}/folded/upto={done[-1]}")

    def market(self, keywords: DataFrame, *, show_candidates: bool = False, name: str | None = None,
               min_jobs: int = CANDIDATE_MIN_JOBS) -> DataFrame:
        """The rows of ``keyword_market`` for the state's scope."""
        state = self.state()
        mean = {m: F.when(F.col(f"{m}_n") > 0, F.col(f"{m}_sum").cast("double") / F.col(f"{m}_n")) for m in _MEANS}
        overall = state.where(F.col("kind").isNull()).agg(F.max(mean["salary"])).scalar()
        entries = keywords.where(keyword_entry_predicate(show_candidates=show_candidates, name=name)).select("kind", "id", "name", "user_level")
        grouped = (entries.join(state, ["kind", "id"]).where(F.col("raw_count") >= min_jobs)
                   .select("kind", "id", "name", "user_level", "raw_count", "actionable_count",
                           mean["fit"].alias("_fit"), mean["qual"].alias("_qual"), mean["salary"].alias("_salary")))
        return finish_market(grouped, overall)
