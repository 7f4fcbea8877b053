"""Vector search, keyword neighbours and embeddings on the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblake.operators import graph_index as GI
from joblake.operators import latent as LT
from joblake.operators import neighbour_graph as NG
from joblake.operators import vectors as V
from joblake.plans.registry import register
from joblake.session import scratch_table

# query vectors: one centroid per label, computed from the whole table
_CENTROIDS_SQL = """
centroids AS (
  SELECT label AS query_id, list(a ORDER BY i) AS q FROM (
    SELECT label, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS a
    FROM (SELECT label, embedding, unnest(range(len(embedding))) AS i FROM embeddings) x
    GROUP BY label, i) y
  GROUP BY label)"""


def _centroids(T):
    e = T.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    per = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    return (per.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("_l"))
            .select(F.col("label").alias("query_id"), F.transform("_l", lambda s: s["a"]).alias("embedding")))


def _jobs(T):
    return T.embeddings.select(F.col("vec_id").alias("job_id"), "embedding",
                               F.when(F.col("label") < 5, "active").otherwise("expired").alias("status"))


@register("vector_search", f"""
WITH {_CENTROIDS_SQL},
jobs AS (SELECT vec_id AS job_id, embedding FROM embeddings WHERE label < 5 AND embedding IS NOT NULL),
s AS (SELECT c.query_id, j.job_id,
             list_cosine_similarity(CAST(j.embedding AS DOUBLE[]), c.q) AS similarity
      FROM centroids c, jobs j)
SELECT query_id, job_id, round(similarity, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, job_id) AS rank FROM s) r
WHERE rank <= 10
""")
def vector_search(T):
    """Exact cosine top 10 active listings per label centroid."""
    r = V.vector_search(_jobs(T), _centroids(T), k=10)
    return r.select("query_id", "job_id", F.round("similarity", 6).alias("similarity"), "rank")


_KNN_SQL = """
WITH e AS (SELECT kind, id, is_candidate, CAST(vec AS DOUBLE[]) AS v FROM b_entries),
s AS (SELECT c.kind, c.id, p.id AS nid, list_cosine_similarity(c.v, p.v) AS similarity
      FROM e c JOIN e p ON c.kind = p.kind AND c.id <> p.id WHERE c.is_candidate = 1),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY similarity DESC, nid DESC) AS rank
                       FROM s) r WHERE rank <= 8)
"""


@register("knn_keywords", _KNN_SQL + "SELECT kind, id, nid, round(similarity, 6) AS similarity, rank FROM knn")
def knn_keywords(T):
    r = V.knn_keywords(T.entries, k=8)
    return r.select("kind", "id", "nid", F.round("similarity", 6).alias("similarity"), "rank")


@register("rank_by_similarity", _KNN_SQL + """
SELECT kind, id, round(max(similarity), 6) AS best_similarity FROM knn GROUP BY kind, id
ORDER BY best_similarity DESC, kind, id
""")
def rank_by_similarity(T):
    r = V.rank_by_similarity(V.knn_keywords(T.entries, k=8))
    return r.select("kind", "id", F.round("best_similarity", 6).alias("best_similarity"))


@register("vector_search_approx")
def vector_search_approx(T):
    """Nearest active listings of the label centroids from the graph index, with
    each query's recall against the exact search over all rows. A second run
    reads the index that the first has written."""
    jobs = _jobs(T).where(F.col("status") == "active").select("job_id", F.col("embedding").alias("vec"))
    q = _centroids(T).select("query_id", F.col("embedding").alias("vec"))
    found = scratch_table(GI.open_index(jobs, "listings").search(q, k=10), "approx")
    recall = GI.recall_of(found, V.top_k_by_dot(jobs, q, large_key="job_id", small_key="query_id", k=10))
    return found.join(recall, "query_id")


@register("knn_keywords_descent")
def knn_keywords_descent(T):
    """The neighbours of ``knn_keywords`` from an NN-descent graph, with each
    entry's recall against that exact result."""
    found = scratch_table(NG.knn_keywords_descent(T.entries, k=8), "descent-knn")
    exact = V.knn_keywords(T.entries, k=8).select(F.col("id").alias("query_id"), F.col("nid").alias("job_id"))
    recall = GI.recall_of(found.select(F.col("id").alias("query_id"), F.col("nid").alias("job_id")), exact)
    return found.join(recall.withColumnRenamed("query_id", "id"), "id").select("kind", "id", "nid", "similarity", "rank", "recall")


@register("embed_jobs")
def embed_jobs(T):
    """Unit TF-IDF vectors of every document (as listing text)."""
    docs = T.documents.select(F.col("doc_id").alias("job_id"), "text")
    model = V.text_features().fit(docs)
    return V.embed(model, docs).select("job_id", "vec")


def _profiles(T):
    return T.conversations.groupBy(F.col("conv_id").alias("profile_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]),
                     "\n").alias("text"))


@register("embed_profiles")
def embed_profiles(T):
    """Profiles embedded with the model fitted on the listings: one space."""
    model = V.text_features().fit(T.documents.select("text"))
    return V.embed(model, _profiles(T)).select("profile_id", "vec")


@register("embed_jobs_learned")
def embed_jobs_learned(T):
    """Dense unit vectors of every document in the subspace learned from all of them."""
    docs = T.documents.select(F.col("doc_id").alias("job_id"), "text")
    return LT.fit_latent(docs).embed(docs).select("job_id", "vec")


@register("embed_profiles_learned")
def embed_profiles_learned(T):
    """Profiles in the subspace learned from the listings."""
    return LT.fit_latent(T.documents.select("text")).embed(_profiles(T)).select("profile_id", "vec")


@register("embed_short")
def embed_short(T):
    return V.embed_short(T.keywords.select("kind", "id", "name")).select("kind", "id", "vec")
