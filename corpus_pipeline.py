"""The corpus pipeline: from raw documents to a training mix, in five stages,
each one operator of ``joblake.llm``.

A stage takes ``(spark, docs, sf_dir)``, works on all rows that the one before
kept, and returns the columns of ``documents``; the last adds each document's
place in the mix. ``run`` writes every stage's rows as Parquet into the shared
scratch folder and reads them back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from joblake.llm.common import table
from joblake.llm.decontaminate import decontaminate
from joblake.llm.langid import identify_languages, learn_languages
from joblake.llm.line_dedup import drop_repeated_lines
from joblake.llm.mixing import mix_sources
from joblake.llm.ngram_join import one_per_group
from joblake.session import scratch_table as written

#: Least share of a document's trigrams that must belong to its language.
MIN_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the rows are labelled with; text
    in no language (null, no letters, or letters that fit none) goes."""
    model = learn_languages(docs)
    told = identify_languages(docs, model, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")])
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("d.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut; a document of which
    nothing is left goes."""
    cut = drop_repeated_lines(docs)
    changed = F.col("n_removed") > 0
    cut = cut.where(~changed | (F.trim("text") != ""))
    chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return cut.select(*[chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8)."""
    return one_per_group(docs, k=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their place in the interleaved sources."""
    return mix_sources(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing)]

#: Learned filters and greedy tiling have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
