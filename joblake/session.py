"""Spark session helpers.

Library functions never create a session themselves: every operator takes and
returns DataFrames. These helpers are for scripts, the bench and tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at any scale: adaptive execution re-plans joins from
# runtime sizes (checked broadcast with sort-merge fallback), splits skewed
# shuffle partitions and coalesces small ones.
_ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "joblake", extra: dict | None = None) -> SparkSession:
    """A local session configured like the cluster one, sized for one host."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("JOBLAKE_DRIVER_MEMORY", "16g")))
    for k, v in {**_ADAPTIVE, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Only a local session, whose executors share the
    driver's disk, gets a temporary folder when it is unset; on a cluster that
    would be a folder no executor sees, so it is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="joblake-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a
    machine-local temp folder on a cluster)."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/joblake-scratch/{name}-{uuid.uuid4().hex[:12]}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared scratch folder
    and read it back. Survives lost executors, unlike cached blocks, and is
    smaller than a checkpoint."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables that :func:`scratch_table` returned, once everything made
    from them has itself been written."""
    for t in tables:
        _delete(t.sparkSession, t._scratch_path)


def clean_scratch(spark: SparkSession) -> None:
    """Delete the scratch folder of this library. Call it when no DataFrame
    that came from an operator is needed any more."""
    _delete(spark, ensure_checkpoint_dir(spark).rstrip("/") + "/joblake-scratch")
