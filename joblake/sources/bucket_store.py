"""A table in hash buckets, of which a change rewrites only those it touches.

Layout under one folder that all executors share::

    data/v=N/_bucket=B   the rows of bucket B as of version N
    versions/v=N         per bucket the version that holds it, and the schema

A version is what its finished ``versions`` folder says (``_SUCCESS`` marker),
so a crash between the two writes leaves the version before readable, and the
next write takes the number again. Buckets that a change does not touch keep
their files. One writer at a time; readers need no lock.

The key hash deals rows evenly, whatever other columns are skewed; choose the
number of buckets so that one fits a task (the files of a bucket are written by
one). What passes the driver is one row per bucket.

Edge cases: a null key is a key like any other; repeated keys stay repeated
until an upsert replaces all their rows; an emptied bucket leaves the version;
columns that a change adds are null in the buckets it does not touch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class BucketStore:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _found(self, pattern: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        return [f.getPath() for f in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p) or []]

    def version(self) -> int:
        """The newest finished version, -1 without any."""
        return max((int(p.getParent().getName()[2:]) for p in self._found("versions/v=*/_SUCCESS")), default=-1)

    def _manifest(self, version: int) -> tuple[dict[int, int], StructType]:
        import json

        rows = self.spark.read.parquet(f"{self.path}/versions/v={version}").collect()
        return {r.bucket: r.written for r in rows if r.bucket is not None}, StructType.fromJson(json.loads(rows[0].schema))

    def _rows(self, held: dict[int, int], schema: StructType) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/v={v}/_bucket={b}" for b, v in sorted(held.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """The whole table, as of the newest version or an earlier one."""
        return self._rows(*self._manifest(self.version() if version is None else version))

    def _commit(self, rows: DataFrame, version: int, kept: dict[int, int]) -> int:
        schema = StructType([f for f in rows.schema if f.name != "_bucket"])
        data = f"{self.path}/data/v={version}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(data)
        held = kept | {int(p.getName().split("=")[1]): version for p in self._found(f"data/v={version}/_bucket=*")}
        lines = [(b, v, schema.json()) for b, v in sorted(held.items())] or [(None, None, schema.json())]
        (self.spark.createDataFrame(lines, "bucket int, written long, schema string").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/versions/v={version}"))
        return version

    def create(self, rows: DataFrame) -> int:
        """Write the whole table as the next version."""
        return self._commit(rows, self.version() + 1, {})

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Rewrite the buckets of ``keys`` as ``change`` of their rows, which may
        change, add or drop rows of these keys only. Without keys nothing is
        written. Returns the version that holds the result."""
        now = self.version()
        held, schema = self._manifest(now)
        touched = {r[0] for r in keys.select(self._bucket()).distinct().collect()}
        if not touched:
            return now
        rows = self._rows({b: v for b, v in held.items() if b in touched}, schema)
        return self._commit(change(rows), now + 1, {b: v for b, v in held.items() if b not in touched})

    def upsert(self, rows: DataFrame) -> int:
        """Rows of known keys take the place of the stored ones, others are added."""
        return self.update(rows, lambda old: self._without(old, rows).unionByName(rows, allowMissingColumns=True))

    def delete(self, keys: DataFrame) -> int:
        return self.update(keys, lambda old: self._without(old, keys))

    def _without(self, old: DataFrame, keys: DataFrame) -> DataFrame:
        gone = keys.select(F.col(self.key).alias("_gone")).distinct()
        return old.join(gone, F.col(self.key).eqNullSafe(F.col("_gone")), "left_anti")

    def vacuum(self) -> None:
        """Delete the files that the newest version does not use. Earlier
        versions cannot be read afterwards."""
        held, _ = self._manifest(self.version())
        for p in self._found("data/v=*/_bucket=*"):
            if held.get(int(p.getName().split("=")[1])) != int(p.getParent().getName()[2:]):
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
