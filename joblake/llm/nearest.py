"""Operator 8: approximate nearest neighbours with a hierarchical k-means tree
searched best bin first.

* Tree: k-means with ``branch`` centres, again within each of them, fitted on a
  bounded sample (the ``sample`` vectors with the smallest hash) until a leaf
  stands for about ``leaf_rows`` rows of the table. Every row is indexed: it
  descends to the nearest centre, level by level.
* Search: a priority queue holds the open nodes by the query's distance to
  their centre; the nearest is opened, and the leaves come out best bin first.
  A query visits the first ``visits`` leaves, and more until they hold enough
  rows to fill its list.
* Calibration: for ``calibrate`` vectors of the sample the true neighbours
  among *all* rows are found by brute force; the visits are widened until the
  visited leaves hold ``recall`` of them.

Vectors that are null, zero or hold null or non-finite components take no part,
nor do null ids and vectors of another length than most have. Rows with the
same id and vector are one. Of equal vectors only the ``k + 1`` smallest ids
are indexed: no other can be in a list of ``k`` with ties to the smaller id, so
a vector that a third of all rows share costs no more than any other. A leaf
with many rows or many visitors is split into blocks of about ``BLOCK`` of
either. Distances are Euclidean, in double precision, over the vectors as given.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from joblake.session import scratch_table as written

BLOCK = 4096
MAX_LEAVES = 1 << 15
_TILE = 1 << 22  # doubles held at a time while distances are computed


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from differences, a tile of rows at a time."""
    out = np.empty((len(a), len(b)))
    n = max(1, _TILE // max(1, b.size))
    for i in range(0, len(a), n):
        d = a[i : i + n, None, :] - b[None, :, :]
        out[i : i + n] = np.sqrt((d * d).sum(-1))
    return out


@dataclass
class KMeansTree:
    """``children[node]`` and ``centres[node]`` (of the children); a node
    without children is a leaf, numbered by ``leaf[node]``."""

    children: list[list[int]] = field(default_factory=lambda: [[]])
    centres: list[np.ndarray | None] = field(default_factory=lambda: [None])
    leaf: dict[int, int] = field(default_factory=dict)

    @staticmethod
    def fit(x: np.ndarray, leaves: int, branch: int = 8, rounds: int = 12) -> KMeansTree:
        tree = KMeansTree()
        rng = np.random.Generator(np.random.PCG64(1))
        # always split the leaf with the most points
        heap = [(-len(x), 0, np.arange(len(x)))]
        n_leaves, whole = 1, []
        while heap:
            n, node, at = heapq.heappop(heap)
            if n_leaves >= leaves or -n < 2:
                whole.append(node)
                continue
            part = x[at]
            distinct = np.unique(part, axis=0)
            k = min(branch, len(distinct), leaves - n_leaves + 1)
            if k < 2:
                whole.append(node)
                continue
            c = distinct[rng.choice(len(distinct), k, replace=False)]
            for _ in range(rounds):
                own = _squared(part, c).argmin(1)
                for j in range(k):
                    if (own == j).any():
                        c[j] = part[own == j].mean(0)
            own = _squared(part, c).argmin(1)
            used = [j for j in range(k) if (own == j).any()]
            if len(used) < 2:
                whole.append(node)
                continue
            tree.centres[node] = c[used]
            for j in used:
                tree.children.append([])
                tree.centres.append(None)
                tree.children[node].append(len(tree.children) - 1)
                heapq.heappush(heap, (-int((own == j).sum()), len(tree.children) - 1, at[own == j]))
            n_leaves += len(used) - 1
        tree.leaf = {node: i for i, node in enumerate(sorted(whole))}
        return tree

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``x``."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node in self.leaf:
                out[at] = self.leaf[node]
                continue
            own = _squared(x[at], self.centres[node]).argmin(1)
            todo.extend((child, at[own == j]) for j, child in enumerate(self.children[node]))
        return out

    def bins(self, q: np.ndarray):
        """The leaves, best bin first."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if node in self.leaf:
                yield self.leaf[node]
                continue
            d = ((self.centres[node] - q) ** 2).sum(1)
            for child, x in zip(self.children[node], d.tolist()):
                heapq.heappush(heap, (x, child))


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def usable_vectors(table: DataFrame) -> tuple[DataFrame, int]:
    """``(vec_id, v)`` of the rows that take part, the vectors as doubles in
    bytes, and their length."""
    whole = F.expr("""embedding is not null and size(embedding) > 0 and vec_id is not null
        and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)""")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(whole)
    dims = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return rows.select("vec_id", F.lit(None).cast("binary").alias("v")).limit(0), 1
    dim = dims["d"]

    def pack(it):
        for b in it:
            flat = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64) + 0.0  # -0 as 0
            v = flat.reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in v], pa.binary())], names=["vec_id", "v"])

    return rows.where(F.size("embedding") == dim).mapInArrow(pack, "vec_id long, v binary"), dim


def _true_neighbours(index: DataFrame, queries: pd.DataFrame, dim: int, k: int) -> DataFrame:
    """``(q, leaf)``: for each calibration query the leaves of its ``k`` nearest
    rows, by brute force over all rows."""
    qv, qid = _matrix(queries["v"], dim), queries["vec_id"].to_numpy()
    held = index.sparkSession.sparkContext.broadcast((qv, qid))

    def near(it):
        qv, qid = held.value
        for b in it:
            if not b.num_rows:
                continue
            ids, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
            d = _squared(qv, _matrix(b.column(1).to_pylist(), dim))
            d[qid[:, None] == ids[None, :]] = np.inf
            n = min(k, d.shape[1])
            top = np.argpartition(d, n - 1, axis=1)[:, :n]
            r = np.repeat(np.arange(len(qid)), n)
            c = top.ravel()
            ok = np.isfinite(d[r, c])
            yield pa.RecordBatch.from_arrays([pa.array(r[ok]), pa.array(leaf[c[ok]]), pa.array(d[r, c][ok]), pa.array(ids[c[ok]])], names=["q", "leaf", "d", "vec_id"])

    w = Window.partitionBy("q").orderBy("d", "vec_id")
    return index.select("vec_id", "v", "leaf").mapInArrow(near, "q long, leaf long, d double, vec_id long").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "leaf")


def nearest(table: DataFrame, is_query: Column, k: int = 10, recall: float = 0.95, sample: int = 20000, calibrate: int = 256,
            leaf_rows: int = 256, branch: int = 8) -> DataFrame:
    """``table(vec_id, embedding, ...)``: the ``k`` nearest rows of every row
    for which ``is_query`` (an expression of ``vec_id``) holds: ``(query_id,
    rank, vec_id, score)``, nearest first, ties to the smaller id."""
    sc = table.sparkSession.sparkContext
    rows, dim = usable_vectors(table)
    rows = written(rows.dropDuplicates(["vec_id", "v"]), "vectors")
    top = Window.partitionBy("v").orderBy("vec_id")
    distinct = written(rows.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).drop("r"), "distinct-vectors")
    n = distinct.count()
    fit = distinct.orderBy(F.xxhash64("v"), "vec_id").limit(sample).toPandas()
    tree = KMeansTree.fit(_matrix(fit["v"], dim), int(min(MAX_LEAVES, max(1, n // leaf_rows), max(1, len(fit) // 8))), branch)
    held = sc.broadcast(tree)

    def place(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.assign(_matrix(b.column(1).to_pylist(), dim)))], names=["vec_id", "v", "leaf"])

    index = written(distinct.mapInArrow(place, "vec_id long, v binary, leaf long"), "vector-index")
    size = np.zeros(max(1, len(tree.leaf)), np.int64)
    for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        size[r["leaf"]] = r["n"]

    probe = fit.iloc[:calibrate]
    visits = 1
    if len(probe):
        truth = _true_neighbours(index, probe, dim, k).toPandas()
        place_of = [{leaf: i for i, leaf in enumerate(tree.bins(q))} for q in _matrix(probe["v"], dim)]
        depth = np.sort([place_of[q][leaf] + 1 for q, leaf in zip(truth["q"], truth["leaf"])])
        while visits < len(tree.leaf) and len(depth) and np.searchsorted(depth, visits, side="right") < recall * len(depth):
            visits += 1
    counts = sc.broadcast(size)

    def visit(it):
        for b in it:
            ids, vecs, out_i, out_l = b.column(0).to_numpy(), b.column(1).to_pylist(), [], []
            for i, q in enumerate(_matrix(vecs, dim)):
                seen = 0
                for m, leaf in enumerate(held.value.bins(q)):
                    if m >= visits and seen > 2 * k:
                        break
                    seen += counts.value[leaf]
                    out_i.append(i)
                    out_l.append(leaf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[out_i] if out_i else np.empty(0, np.int64)), b.column(1).take(pa.array(out_i, pa.int64())), pa.array(out_l, pa.int64())], names=["query_id", "q", "leaf"])

    visited = written(rows.where(is_query).mapInArrow(visit, "query_id long, q binary, leaf long"), "visits")
    blocks = (index.groupBy("leaf").agg(F.count(F.lit(1)).alias("ni"))
              .join(visited.groupBy("leaf").agg(F.count(F.lit(1)).alias("nq")), "leaf")
              .select("leaf", F.expr(f"cast((ni + {BLOCK - 1}) div {BLOCK} as int)").alias("bi"), F.expr(f"cast((nq + {BLOCK - 1}) div {BLOCK} as int)").alias("bq")))
    blocks = F.broadcast(blocks)  # one row per leaf, MAX_LEAVES at most
    left = (visited.join(blocks, "leaf").withColumn("sq", F.pmod(F.xxhash64("query_id", "q"), "bq").cast("int"))
            .withColumn("si", F.explode(F.sequence(F.lit(0), F.col("bi") - 1))).select("leaf", "si", "sq", "query_id", "q"))
    right = (index.join(blocks, "leaf").withColumn("si", F.pmod(F.xxhash64("vec_id", "v"), "bi").cast("int"))
             .withColumn("sq", F.explode(F.sequence(F.lit(0), F.col("bq") - 1))).select("leaf", "si", "sq", "vec_id", "v"))

    def measured(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            ids = b["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], _matrix(b["v"].iloc[order], dim)
            step = max(1, _TILE // max(1, len(ids)))
            for s in range(0, len(a), step):
                qid = a["query_id"].to_numpy()[s : s + step]
                d = exact_distances(_matrix(a["q"].iloc[s : s + step], dim), v)
                d[qid[:, None] == ids[None, :]] = np.inf
                first = np.argsort(d, axis=1, kind="stable")[:, :k]  # ids ascend, so ties go to the smaller
                r = np.repeat(np.arange(len(qid)), first.shape[1])
                c = first.ravel()
                ok = np.isfinite(d[r, c])
                out.append(pd.DataFrame({"query_id": qid[r[ok]], "vec_id": ids[c[ok]], "score": d[r, c][ok]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})

    found = (left.groupBy("leaf", "si", "sq").cogroup(right.groupBy("leaf", "si", "sq"))
             .applyInPandas(measured, "query_id long, vec_id long, score double"))
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
