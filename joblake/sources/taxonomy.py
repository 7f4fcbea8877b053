"""Taxonomy seed files: keyword CSVs and alias CSVs (header row, quoted
fields allowed), read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblake.operators.keywords import dense_ids
from joblake.schemas import ALIAS_CSV, FRAMEWORK_CSV, SKILL_CSV


def _blank_to_null(c: str) -> F.Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def scan_taxonomy(spark: SparkSession, path: str, kind: str, existing: DataFrame) -> DataFrame:
    """Seed rows of one kind appended to ``existing`` keywords: empty
    hierarchy fields (not the domain) become NULL; a name that its kind already
    has is skipped (the other kind may have it too); new ids continue after the largest one in file order."""
    schema = SKILL_CSV if kind == "skill" else FRAMEWORK_CSV
    raw = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    l2, l3, name = schema.fieldNames()[1:]
    rows = (raw.select(F.col("domain"), _blank_to_null(l2).alias("l2"), _blank_to_null(l3).alias("l3"),
                       F.col(name).alias("name"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
            .where(F.col("name").isNotNull()))
    first = rows.groupBy("name").agg(F.min(F.struct("_file", "_row", "domain", "l2", "l3")).alias("_f")).select(
        "name", "_f.*")
    fresh = first.join(existing.where(F.col("kind") == kind).select("name"), "name", "left_anti")
    start = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("start"))
    numbered = dense_ids(fresh, ["_file", "_row"], start)
    new = numbered.select(F.col("new_id").alias("id"), F.lit(kind).alias("kind"), "name", "domain", "l2", "l3",
                          F.lit(0).alias("is_candidate"), F.lit(None).cast("string").alias("user_level"))
    return existing.unionByName(new, allowMissingColumns=True)


def scan_aliases(spark: SparkSession, path: str, kind: str, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, unknown): alias trimmed and lowercased; the canonical name
    is matched exactly (trimmed, case kept) among keywords of the kind;
    aliases whose canonical is unknown are reported, not loaded."""
    raw = spark.read.schema(ALIAS_CSV).option("header", True).option("escape", '"').csv(path)
    a = raw.select(F.lower(F.trim("alias")).alias("alias"), F.trim("canonical_name").alias("name"))
    names = keywords.where(F.col("kind") == kind).select("name", "id")
    ok = a.join(names, "name").select(F.lit(kind).alias("kind"), "alias", "id").dropDuplicates(["kind", "alias"])
    unknown = a.join(names, "name", "left_anti")
    return ok, unknown
