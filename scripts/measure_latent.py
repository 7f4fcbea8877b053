"""Do learned vectors find a listing's other half better than term weights do?

Listings with crc32(doc_id) mod 5 = 0 are held out of fitting; their words at even
and at odd places make two texts, and each first half ranks all second halves
(one listing per different text, 20 words at least).

    python scripts/measure_latent.py /root/testdata/sf0.01 64 128
"""

import sys
import time

sys.path.insert(0, ".")

from pyspark.sql import functions as F  # noqa: E402

from joblake.operators import latent as LT, vectors as V  # noqa: E402
from joblake.session import local_session  # noqa: E402

FEATURES = 1 << 13
spark = local_session(8)
docs = spark.read.parquet(f"{sys.argv[1]}/documents.parquet").where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
fit = docs.where(~held)
asked = docs.where(held).withColumn("w", F.filter(F.split("text", r"\s+"), lambda w: w != "")).where("size(w) >= 20")


def half(odd):
    words = F.filter("w", lambda w, i: i % 2 == odd)
    return asked.select("doc_id", F.array_join(words, " ").alias("text"))


first, second = half(0), half(1)


def score(a, b):
    found = V.top_k_by_dot(b.select(F.col("doc_id").alias("job_id"), "vec"), a.select(F.col("doc_id").alias("query_id"), "vec"),
                           large_key="job_id", small_key="query_id", k=50)
    return LT.rank_of_partner(found).first().asDict()


terms = V.text_features(FEATURES).fit(fit)
print("term weights", score(*(V.embed(terms, h, as_sparse=True) for h in (first, second))), flush=True)
for rank in map(int, sys.argv[2:] or ["64"]):
    t = time.time()
    model = LT.fit_latent(fit, rank=rank, num_features=FEATURES)
    print("learned", rank, "passes", model.space.passes, "fitted in", round(time.time() - t, 1), score(model.embed(first), model.embed(second)), flush=True)
