"""A graph of nearest neighbours without all pairs, by NN-descent.

Every node starts with ``k`` random neighbours. A round looks among the neighbours
of neighbours: around each node, its neighbours in both directions are compared
with one another where at least one of the two is new since the last round, and
what is nearer than a node's furthest neighbour takes its place. A node that is
very many others' neighbour takes part with ``k`` of them, drawn anew each
round. It ends when a round changes less than ``delta`` of all entries. The
pairs compared grow with the number of nodes and of rounds, not with its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblake.operators.vectors import top_k_per_group, unit
from joblake.session import drop_scratch, scratch_table

NODES = 256  # nodes whose neighbourhoods one call compares


def _around(t: pa.Table) -> pa.Table:
    """``t(u, v, new, vec, worst)``: the pairs around each node ``u``, at least one of them
    new, that are near enough to enter either list."""
    u, v = (t.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in "uv")
    new = t.column("new").to_numpy().astype(bool)
    by = np.lexsort((~new, v, u))
    first = np.ones(len(by), bool)
    first[1:] = (u[by][1:] != u[by][:-1]) | (v[by][1:] != v[by][:-1])
    by = by[first]
    vec = t.column("vec").combine_chunks()
    x = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)[by]
    new, worst, ends = new[by], t.column("worst").to_numpy()[by], np.flatnonzero(np.diff(u[by], append=-1)) + 1
    rows, cols, sims_out, a = [], [], [], 0
    for b in ends.tolist():
        sims = x[a:b] @ x[a:b].T
        near = (sims > worst[a:b, None]) & (new[a:b, None] | new[None, a:b])
        np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        rows.append(i + a), cols.append(j + a), sims_out.append(sims[i, j])
        a = b
    ids = t.column("v").combine_chunks().take(pa.array(by))
    return pa.table({"u": ids.take(pa.array(np.concatenate(rows))), "v": ids.take(pa.array(np.concatenate(cols))), "sim": pa.array(np.concatenate(sims_out), pa.float64())})


def nn_descent(rows: DataFrame, k: int = 24, delta: float = 0.002, max_rounds: int = 30, seed: int = 1, stats: dict | None = None) -> DataFrame:
    """``rows(id, vec)`` to ``(id, nid, similarity)``: about the ``k`` nearest of every
    row by cosine, itself excluded. Null and zero vectors take no part."""
    kind = dict(rows.dtypes)["id"]
    x = scratch_table(rows.select("id", unit("vec").alias("vec")).where(F.col("vec").isNotNull()), "descent-rows")
    n = x.count()
    if n < 2:
        return x.sparkSession.createDataFrame([], f"id {kind}, nid {kind}, similarity double")
    k = min(k, n - 1)
    # random neighbours: the rows of small random groups, dealt again until there are about k
    start = None
    for r in range(-(-k // 4) + 1):
        place = x.select("id", F.pmod(F.xxhash64("id", F.lit(seed * 1000 + r)), F.lit(max(1, n // 5))).alias("g"))
        pairs = place.alias("a").join(place.alias("b"), "g").where("a.id <> b.id").select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
        start = pairs if start is None else start.unionByName(pairs)
    vec_u, vec_v = (x.select(F.col("id").alias(c), F.col("vec").alias(f"vec_{c}")) for c in "uv")
    sim = F.aggregate(F.zip_with("vec_u", "vec_v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    graph = start.distinct().join(vec_u, "u").join(vec_v, "v").select("u", "v", sim.alias("sim"), F.lit(True).alias("new"))
    best = [F.col("sim").desc(), F.col("v")]
    graph = scratch_table(top_k_per_group(graph, "u", best, k, salt_key="v").drop("rank"), "descent")
    rounds = 0
    while rounds < max_rounds:
        rounds += 1
        both = (graph.select("u", "v", "new").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "new")))
        drawn = top_k_per_group(both.distinct().withColumn("g", F.struct("u", "new")), "g", [F.xxhash64("u", "v", F.lit(rounds)), F.col("v")], 2 * k, salt_key="v").select("u", "v", "new")
        worst = graph.groupBy(F.col("u").alias("v")).agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(-2.0).alias("worst"))
        drawn = scratch_table(drawn, "descent-drawn")
        # around a node without a new neighbour there is nothing to compare: no vector goes there
        sides = (drawn.join(drawn.where("new").select("u").distinct(), "u", "left_semi")
                 .join(x.select(F.col("id").alias("v"), "vec"), "v").join(worst, "v", "left").fillna({"worst": -2.0}))
        # some hundred nodes to a group: a call a node would cost more than its pairs
        dealt = sides.withColumn("g", F.pmod(F.xxhash64("u"), F.lit(max(1, n // NODES))))
        found = dealt.groupBy("g").applyInArrow(_around, f"u {kind}, v {kind}, sim double")
        # the same pair met around two nodes may differ in the last digit: it takes one place
        found = found.groupBy("u", "v").agg(F.max("sim").alias("sim"))
        known = graph.select("u", "v", "sim", F.lit(False).alias("new"))
        fresh = found.join(known.select("u", "v"), ["u", "v"], "left_anti").withColumn("new", F.lit(True))
        old, graph = graph, scratch_table(top_k_per_group(known.unionByName(fresh), "u", best, k, salt_key="v").drop("rank"), "descent")
        changed = graph.agg(F.count_if("new")).first()[0]
        drop_scratch(old, drawn)
        if changed <= delta * n * k:
            break
    if stats is not None:
        stats.update(rounds=rounds, n=n)
    return graph.select(F.col("u").alias("id"), F.col("v").alias("nid"), F.col("sim").alias("similarity"))


def knn_keywords_descent(entries: DataFrame, k: int = 8, width: int = 24) -> DataFrame:
    """As ``vectors.knn_keywords``, from the neighbour graph of each kind: for each
    candidate entry the ``k`` most similar entries of its kind."""
    out = None
    for kind in ("skill", "framework"):
        own = entries.where(F.col("kind") == kind)
        graph = nn_descent(own.select("id", "vec"), max(width, k))
        cands = graph.join(own.where(F.col("is_candidate") == 1).select("id"), "id", "left_semi")
        top = top_k_per_group(cands, "id", [F.col("similarity").desc(), F.col("nid").desc()], k, salt_key="nid").withColumn("kind", F.lit(kind))
        out = top if out is None else out.unionByName(top)
    return out.select("kind", "id", "nid", "similarity", F.col("rank").cast("int").alias("rank"))
