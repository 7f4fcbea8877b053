"""The registered queries of this folder: each applies one operator to its
whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from joblake.llm import alignment, chat, decontaminate, langid, lattice, lexical, licenses, line_dedup, mixing, nearest, quality, secrets
from joblake.llm.common import table
from joblake.llm.ngram_join import ngram_jaccard_classes

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_classes(table(spark, sf_dir, "documents"), k=3, threshold=90).select("doc_id", "n_shingles", "component_id")


def fold(n: int) -> Column:
    """The document's fold: crc32 of its id as text, mod ``n``."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))
    model = langid.learn_languages(docs.where(fold(4) != 2))  # a document without an id is in no fold
    return langid.identify_languages(docs, model, ["doc_id", "held_out"])


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed_runs")


ORACLE["op5_line_dedup"] = line_dedup.oracle(50)


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where((fold(5) != 0) & F.col("quality").isNotNull())
    model = quality.fit_quality(docs, labels.select("doc_id", F.col("quality").alias("label")))
    scored = quality.score_quality(docs, model, ["doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


ORACLE["op7_chat_format"] = chat.oracle()


@query
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.learn_secrets(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_markov")


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")


ORACLE["op10_mix_sources"] = mixing.oracle(16)


TOKENIZERS = "/opt/tokenizers"


@query
def op11_align_tokenizers(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align_tokenizers(docs, f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model").drop("groups")


@query
def op12_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op13_ranked_search"] = lexical.oracle(10)
