"""The pipeline on the smallest tables: every stage against a brute-force
version of its decision."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

from joblake.llm import decontaminate, line_dedup, ngram_join
from .test_models import brute_tiles
from .test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, SF).persist()
        kept[name] = (before, docs)
        if name != "mixing":
            assert docs.columns == columns
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "mixing"]

    before, after = kept["line_dedup"]
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0
    cut = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(before).collect() if r.n_removed == 0 or r.text.strip(" ")}
    assert {r.doc_id: r.text for r in after.collect()} == cut

    before, after = kept["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, _, c in brute(rows, 5, 80) if c == d)

    before, after = kept["decontamination"]
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = set()
    for r in before.collect():
        words = r.text.lower().split()
        for item in items:
            if len(set(item) & set(words)) >= 0.5 * len(set(item)) and sum(n for _, _, n in brute_tiles(words, item, 5)) >= 0.8 * len(item) >= 4:
                bad.add(r.doc_id)
                break
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == bad

    before, after = kept["mixing"]
    assert after.select(*columns).exceptAll(before).count() == 0 and after.count() == before.count()


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_language_stage_rejects_text_without_a_language(spark, make_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(make_docs([None, "", "123 456 !!", "жзийклмнопрст уфхцчш"], [-1, -2, -3, -4], langs=[None] * 4))
    out = cp.language_id(spark, docs, SF)
    gone = {r.doc_id for r in docs.select("doc_id").subtract(out.select("doc_id")).collect()}
    assert gone == {-1, -2, -3, -4}


def test_run_returns_the_last_stage(spark):
    assert cp.run(spark, SF).columns[-4:] == ["block", "slot", "place", "in_mix"]
