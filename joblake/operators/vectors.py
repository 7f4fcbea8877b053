"""Vectors: embeddings from Spark ML features, exact and approximate search.

Exact top-k is a block product: blocks of queries meet blocks of rows in
bounded tasks, each keeps its k best per query, and only those survivors meet
in a final per-query rank.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, NGram, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unit(col) -> F.Column:
    """L2-normalised array<double> (NULL for NULL or zero vectors)."""
    c = F.col(col) if isinstance(col, str) else col
    v = F.transform(c, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def dot(a, b) -> F.Column:
    """Dot product of two array<double> columns, summed in double."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, x: s + x)


QUERY_BLOCK, LARGE_BLOCK = 2048, 8192  # rows for which a further block is worth it
GRID = 8  # blocks of a side that has enough rows for them, so that what is dealt out grows with the rows
BLOCK_ENTRIES, BLOCK_ROWS = 1 << 22, 1 << 17  # numbers and rows of a block at most: above, a side gets more blocks
BLOCK_FOUND = 1 << 21  # rows times k of a block of queries
CELLS = 1 << 21  # cells of a dense tile


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the entries of a sparse (struct of size, indices, values) column."""
    idx, val = column.field("indices"), column.field("values")
    row = np.repeat(np.arange(len(column)), pc.list_value_length(idx).to_numpy(zero_copy_only=False).astype(np.int64))
    return row, idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64), val.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _pair(va: pa.Array, vb: pa.Array, cosine: bool) -> tuple[int, Callable[[int, int], np.ndarray], Callable[[int, int], np.ndarray]]:
    """The vectors of two blocks, to unit length if ``cosine``: how many features are compared,
    and for each block rows ``a`` to ``b`` as a matrix. Of sparse vectors only features that both blocks
    have are put into the matrices: the others add nothing to a product."""
    if not pa.types.is_struct(va.type):
        def dense(v):
            m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(v), len(va[0]))

            def rows(a, b):
                n = np.linalg.norm(m[a:b], axis=1, keepdims=True)
                return np.divide(m[a:b], n, out=np.zeros_like(m[a:b]), where=n > 0) if cosine else m[a:b]
            return rows
        return len(va[0]), dense(va), dense(vb)
    dim, sides = va.field("size")[0].as_py(), [_entries(va), _entries(vb)]
    has = [np.bincount(i[x != 0], minlength=dim)[:dim] > 0 for _, i, x in sides]
    shared = np.flatnonzero(has[0] & has[1])
    place = np.full(dim, -1)
    place[shared] = np.arange(len(shared))

    def sparse_rows(n, row, idx, val):
        if cosine:
            norm = np.sqrt(np.bincount(row, weights=val * val, minlength=n))[row]
            val = np.divide(val, norm, out=np.zeros_like(val), where=norm > 0)
        kept = place[idx] >= 0
        row, idx, val = row[kept], place[idx[kept]], val[kept]

        def rows(a, b):
            lo, hi = np.searchsorted(row, (a, b))
            out = np.zeros((b - a, len(shared)))
            out[row[lo:hi] - a, idx[lo:hi]] = val[lo:hi]
            return out
        return rows
    return len(shared), *(sparse_rows(len(v), *s) for v, s in zip((va, vb), sides))


def _blocks(rows: DataFrame, vec: str, size: int | None, least: int, k: int = 1) -> DataFrame:
    """(n): into how many blocks a side is dealt: blocks of about ``size`` rows, or of
    ``least`` rows up to ``GRID`` blocks, and more only where a block would be too large to hold."""
    count = F.count(F.lit(1))
    if size is not None:
        return rows.agg(F.greatest(F.lit(1), F.ceil(count / size)).cast("int").alias("n"))
    numbers = F.size(f"{vec}.indices") if dict(rows.dtypes)[vec].startswith("struct") else F.size(vec)
    held = F.greatest(F.ceil(F.coalesce(F.sum(numbers), F.lit(0)) / BLOCK_ENTRIES), F.ceil(count / min(BLOCK_ROWS, max(1, BLOCK_FOUND // k))))
    return rows.agg(F.greatest(F.lit(1), F.least(F.lit(GRID), F.ceil(count / least)), held).cast("int").alias("n"))


def top_k_by_dot(large: DataFrame, small: DataFrame, *, large_key: str, small_key: str, vec: str = "vec",
                 k: int = 10, cosine: bool = True, exclude_self: bool = False, ties: str = "asc",
                 query_block: int | None = None, large_block: int | None = None) -> DataFrame:
    """For every small-side row (a query), the k large-side rows of highest
    similarity (cosine, or plain dot product), ties by large key (``ties``:
    'asc' or 'desc'). Returns (small_key, large_key, similarity, rank).

    A block product: both sides are dealt into blocks by a hash
    of their key, every block of queries meets every block of the large side in
    one task, tile by tile, and passes on its k best per query; Spark merges
    those per task before they are ranked. A side has ``GRID`` blocks until they
    would be too large for a task, so a row is dealt out a fixed number of times.
    Neither side goes through the driver, and no count is taken before the query
    runs. ``vec`` is an array of numbers or a sparse struct (size, indices,
    values); NULL vectors take no part."""
    if small_key == large_key:
        raise ValueError("use distinct key names for the two sides")
    q = small.select(small_key, vec).where(F.col(vec).isNotNull())
    x = large.select(large_key, vec).where(F.col(vec).isNotNull())
    nq, nx = _blocks(q, vec, query_block, QUERY_BLOCK, k), _blocks(x, vec, large_block, LARGE_BLOCK)  # one row each

    def dealt(side, key, own, own_n, other, other_n):
        side = side.crossJoin(F.broadcast(own_n.withColumnRenamed("n", "_own"))).crossJoin(F.broadcast(other_n.withColumnRenamed("n", "_other")))
        return (side.withColumn(own, F.pmod(F.xxhash64(key), "_own").cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_other") - 1))).drop("_own", "_other"))

    left = dealt(q, small_key, "_q", nq, "_x", nx)
    right = dealt(x, large_key, "_x", nx, "_q", nq)
    schema = f"`{small_key}` {dict(small.dtypes)[small_key]}, `{large_key}` {dict(large.dtypes)[large_key]}, similarity double"

    def best(sims):
        """Row by row: all above the k-th best, then its ties in column order up to k."""
        kk = min(k, sims.shape[1])
        kth = -np.partition(-sims, kk - 1, axis=1)[:, kk - 1:kk]
        above, tie = sims > kth, sims == kth
        room = kk - above.sum(axis=1, keepdims=True)
        return np.nonzero((above | (tie & (np.cumsum(tie, axis=1) <= room))) & np.isfinite(sims))

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks()
        rows_q, rows_x, sims_out = [], [], []
        if len(a) and len(b):
            b = b.take(pc.sort_indices(b, sort_keys=[(large_key, "ascending" if ties == "asc" else "descending")], null_placement="at_end")).combine_chunks()
            qk, lk = (t.column(key).to_numpy(zero_copy_only=False) for t, key in ((a, small_key), (b, large_key)))
            va, vb = (t.column(vec).chunk(0) for t in (a, b))
            dim, queries, cands = _pair(va, vb, cosine)
            step = max(1, CELLS // max(1, dim))
            tile = max(1, min(256, CELLS // min(step, len(lk))))
            kept = [(np.empty((0,), int), np.empty((0,), int), np.empty((0,)))] * -(-len(qk) // tile)
            least = np.full(len(qk), -np.inf)  # the k-th best so far
            for c in range(0, len(lk), step):
                xm = cands(c, min(c + step, len(lk)))
                for t, s in enumerate(range(0, len(qk), tile)):
                    e = min(s + tile, len(qk))
                    sims = queries(s, e) @ xm.T
                    if exclude_self:
                        sims[qk[s:e, None] == lk[None, c:c + step]] = -np.inf
                    if np.isneginf(least[s:e]).any():
                        r, j = best(sims)
                    else:  # an equal one comes after those there are
                        r, j = np.nonzero(sims > least[s:e, None])
                        finite = np.isfinite(sims[r, j])
                        r, j = r[finite], j[finite]
                        if not len(r):
                            continue
                    r0, j0, s0 = kept[t]
                    r1, j1, s1 = np.concatenate((r0, r)), np.concatenate((j0, j + c)), np.concatenate((s0, sims[r, j]))
                    if len(r0):  # the best of the chunks so far, ties to the earlier one
                        by = np.lexsort((j1, -s1, r1))
                        r1, j1, s1 = r1[by], j1[by], s1[by]
                        place = np.arange(len(r1)) - np.searchsorted(r1, r1)
                        r1, j1, s1, place = r1[place < k], j1[place < k], s1[place < k], place[place < k]
                        least[s + r1[place == k - 1]] = s1[place == k - 1]
                    kept[t] = (r1, j1, s1)
            for t, (r, j, s) in enumerate(kept):
                rows_q.append(r + t * tile), rows_x.append(j), sims_out.append(s)
        at = [np.concatenate(v) if v else np.empty(0, int) for v in (rows_q, rows_x)]
        return pa.table({small_key: a.column(small_key).take(pa.array(at[0], pa.int64())), large_key: b.column(large_key).take(pa.array(at[1], pa.int64())),
                         "similarity": pa.array(np.concatenate(sims_out) if sims_out else np.empty(0), pa.float64())})

    found = left.groupBy("_q", "_x").cogroup(right.groupBy("_q", "_x")).applyInArrow(score, schema)
    by_key = F.col(large_key).asc() if ties == "asc" else F.col(large_key).desc()
    # a query has at most k rows of each block: they are ranked where they come together, after a first cut in the tasks
    w = Window.partitionBy(small_key).orderBy(F.col("similarity").desc(), by_key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_search(jobs: DataFrame, queries: DataFrame, k: int = 100, status: str | None = "active",
                  vec: str = "embedding") -> DataFrame:
    """Exact cosine top-k listings per query vector; NULL vectors skipped."""
    if status is not None and "status" in jobs.columns:
        jobs = jobs.where(F.col("status") == status)
    return top_k_by_dot(jobs.select("job_id", F.col(vec).alias("vec")),
                        queries.select("query_id", F.col(vec).alias("vec")),
                        large_key="job_id", small_key="query_id", k=k)


def knn_keywords(entries: DataFrame, k: int = 8, vec: str = "vec") -> DataFrame:
    """For each candidate entry (is_candidate = 1), the k most similar
    entries of the same kind (canonicals and candidates, itself excluded) by
    dot product of unit vectors; ties by neighbour id descending."""
    results = []
    for kind in ("skill", "framework"):
        pool = entries.where(F.col("kind") == kind).select(F.col("id").alias("nid"), unit(vec).alias("vec"))
        cands = entries.where((F.col("kind") == kind) & (F.col("is_candidate") == 1)).select(
            "id", unit(vec).alias("vec"))
        r = top_k_by_dot(pool, cands, large_key="nid", small_key="id", k=k, cosine=False, exclude_self=True, ties="desc")
        results.append(r.withColumn("kind", F.lit(kind)))
    out = results[0].unionByName(results[1])
    return out.select("kind", "id", "nid", "similarity", F.col("rank").cast("int").alias("rank"))


def rank_by_similarity(knn: DataFrame) -> DataFrame:
    """Candidates ordered by the similarity of their best neighbour."""
    best = knn.groupBy("kind", "id").agg(F.max("similarity").alias("best_similarity"))
    return best.orderBy(F.col("best_similarity").desc(), "kind", "id")


# --- embeddings -----------------------------------------------------------------

def text_features(num_features: int = 1 << 12, min_doc_freq: int = 0) -> Pipeline:
    """Unit TF-IDF vectors of word tokens (the same fitted model embeds
    listings and profiles, so both live in one space)."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_tok", pattern=r"[^\p{L}\p{N}#+]+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=min_doc_freq),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ])


def sparse(vector) -> F.Column:
    """ML vector column → struct(size, indices, values) of its non-zero entries."""
    own, dense = F.unwrap_udt(vector), vector_to_array(vector)

    def entries(indices, values):
        e = F.filter(F.arrays_zip(indices.alias("i"), values.alias("x")), lambda e: e["x"] != 0)
        return F.struct(F.transform(e, lambda e: e["i"]).alias("indices"), F.transform(e, lambda e: e["x"]).alias("values"))

    # a vector stored by its entries (type 0) is never spread out
    places = F.sequence(F.lit(0), F.size(dense) - 1)
    kept = F.when(own["type"] == 0, F.when(F.exists(own["values"], lambda x: x == 0), entries(own["indices"], own["values"]))
                  .otherwise(F.struct(own["indices"].alias("indices"), own["values"].alias("values")))).otherwise(entries(places, dense))
    return F.struct(F.when(own["type"] == 0, own["size"]).otherwise(F.size(dense)).alias("size"), kept["indices"].alias("indices"), kept["values"].alias("values"))


def embed(model, df: DataFrame, text_col: str = "text", out: str = "vec", as_sparse: bool = False) -> DataFrame:
    """Apply a fitted feature pipeline; the vector comes back as array<double>,
    or as its non-zero entries with ``as_sparse``."""
    src = df.withColumnRenamed(text_col, "text") if text_col != "text" else df
    res = model.transform(src)
    res = res.withColumn(out, sparse("_unit") if as_sparse else vector_to_array("_unit")).drop("_tok", "_tf", "_tfidf", "_unit")
    return res.withColumnRenamed("text", text_col) if text_col != "text" else res


def embed_hashed(df: DataFrame, text_col: str, out: str = "vec", num_features: int = 1 << 12) -> DataFrame:
    """Unit hashed term-frequency vectors (nothing is fitted), as their
    non-zero entries; the same words as :func:`text_features`."""
    src = df.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    tok = RegexTokenizer(inputCol="_t", outputCol="_tok", pattern=r"[^\p{L}\p{N}#+]+", toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    nz = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0)
    res = nz.transform(tf.transform(tok.transform(src)))
    return res.withColumn(out, sparse("_unit")).drop("_t", "_tok", "_tf", "_unit")


def embed_short(df: DataFrame, text_col: str = "name", out: str = "vec", num_features: int = 1 << 10) -> DataFrame:
    """Unit vectors of character trigrams for short names."""
    chars = df.withColumn("_chars", F.filter(F.split(F.lower(F.concat(F.lit(" "), F.col(text_col), F.lit(" "))), ""),
                                             lambda x: x != ""))
    ng = NGram(n=3, inputCol="_chars", outputCol="_grams")
    tf = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=num_features)
    nz = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0)
    res = nz.transform(tf.transform(ng.transform(chars)))
    return res.withColumn(out, vector_to_array("_unit")).drop("_chars", "_grams", "_tf", "_unit")


def top_k_per_group(df: DataFrame, group: str, order: list, k: int, salt_key: str, salts: int = 64) -> DataFrame:
    """k best rows per group without ranking a whole hot group in one task:
    first per (group, salt) — salt from a hash of ``salt_key`` — then per
    group over at most ``salts * k`` survivors. Adds ``rank``."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_key), F.lit(salts)))
    w1 = Window.partitionBy(group, "_salt").orderBy(*order)
    pre = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(group).orderBy(*order)
    return pre.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)
