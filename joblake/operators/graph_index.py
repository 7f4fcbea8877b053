"""Approximate nearest listings by navigable small-world graphs, kept as Parquet.

The listings are dealt by a hash of their id into parts of about ``part_rows``,
and one task builds each part's graph: a listing is linked with up to ``m`` of the
nearest found by searching the graph so far (a neighbour that another one
already chosen is nearer to is passed over, which keeps links in all directions),
and lists that grow beyond ``2 m`` are pruned by the same rule. A search goes
greedily from the part's first listing: a heap of candidates is opened nearest
first, and it ends when the nearest open one is further than the ``width`` best
found. Every query searches every part, and the parts' best are ranked together.

The index is a folder: ``nodes`` (part, node, job_id, vec, links) and, written last,
``meta`` (width, recall). ``width`` is doubled until the neighbours of ``probes``
listings, found by the exact block product over all rows, are found again to
``recall``. An index without ``meta`` was not finished and is built anew.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblake.operators.vectors import QUERY_BLOCK, top_k_by_dot, top_k_per_group, unit
from joblake.session import ensure_checkpoint_dir, scratch_table


class SmallWorld:
    """One part: unit vectors as rows, and each row's links."""

    def __init__(self, vecs: np.ndarray, links: list[np.ndarray] | None = None):
        self.vecs, self.links = vecs, links if links is not None else []

    @staticmethod
    def build(vecs: np.ndarray, m: int, width: int) -> SmallWorld:
        g = SmallWorld(vecs, [np.empty(0, np.int64)] if len(vecs) else [])
        for i in range(1, len(vecs)):
            near = [j for _, j in g.search(vecs[i], width)]
            g.links.append(g._spread(i, near, m))
            for j in g.links[i].tolist():
                mine = np.append(g.links[j], i)
                if len(mine) > 2 * m:
                    sims = vecs[mine] @ vecs[j]
                    mine = g._spread(j, mine[np.argsort(-sims, kind="stable")].tolist(), 2 * m)
                g.links[j] = mine
        return g

    def _spread(self, i: int, near: list[int], m: int) -> np.ndarray:
        """Of ``near`` (nearest first) up to ``m``: first those nearer to ``i`` than
        to any chosen one, then the nearest of the others."""
        if len(near) <= m:
            return np.array(near, np.int64)
        own = self.vecs[near] @ self.vecs[i]
        between = self.vecs[near] @ self.vecs[near].T
        chosen, others = [], []
        for p in range(len(near)):
            if len(chosen) < m and (not chosen or between[p, chosen].max() < own[p]):
                chosen.append(p)
            else:
                others.append(p)
        return np.array(near, np.int64)[chosen + others[: m - len(chosen)]]

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        """Up to ``width`` rows as ``(similarity, row)``, nearest first."""
        if not self.links:
            return []
        seen = np.zeros(len(self.links), bool)
        seen[0] = True
        first = float(self.vecs[0] @ q)
        open_, best = [(-first, 0)], [(first, 0)]
        while open_:
            s, row = heapq.heappop(open_)
            if len(best) >= width and -s < best[0][0]:
                break
            new = self.links[row]
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            for sim, j in zip((self.vecs[new] @ q).tolist(), new.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (sim, j))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, j))
                else:
                    continue
                heapq.heappush(open_, (-sim, j))
        return sorted(best, key=lambda x: (-x[0], x[1]))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def index_path(jobs: DataFrame, name: str) -> str:
    """A folder named by the table's content, in the shared checkpoint folder, so
    that the same table finds its index again."""
    r = jobs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("job_id", "vec")), F.bit_xor(F.xxhash64("vec", "job_id"))).first()
    return f"{ensure_checkpoint_dir(jobs.sparkSession).rstrip('/')}/joblake-index/{name}-{'-'.join(f'{(x or 0) & (2**64 - 1):x}' for x in r)}"


class GraphIndex:
    """An index on disk."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.meta = spark.read.parquet(f"{path}/meta").first()
        self.nodes = spark.read.parquet(f"{path}/nodes")

    def search(self, queries: DataFrame, k: int, width: int | None = None) -> DataFrame:
        """``queries(query_id, vec)``: ``(query_id, job_id, similarity, rank)``."""
        return _search(self.nodes, queries, self.meta["parts"], k, width or self.meta["width"])


def _search(nodes: DataFrame, queries: DataFrame, parts: int, k: int, width: int) -> DataFrame:
    q = queries.select("query_id", unit("vec").alias("q")).where(F.col("q").isNotNull())
    blocks = q.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / QUERY_BLOCK)).cast("int").alias("nb"))  # one row
    left = (q.crossJoin(F.broadcast(blocks)).withColumn("b", F.pmod(F.xxhash64("query_id"), "nb").cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).drop("nb"))
    right = nodes.crossJoin(F.broadcast(blocks)).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb")
    kinds = dict(nodes.dtypes), dict(queries.dtypes)

    def find(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "job_id": [], "similarity": []}
        if len(a) and len(b):
            b = b.sort_values("node")
            ids = b["job_id"].to_numpy()
            g = SmallWorld(np.stack(b["vec"].to_list()), [np.asarray(x, np.int64) for x in b["links"]])
            for query, v in zip(a["query_id"], a["q"]):
                for sim, row in g.search(np.asarray(v), max(width, k))[:k]:
                    out["query_id"].append(query)
                    out["job_id"].append(ids[row])
                    out["similarity"].append(sim)
        return pd.DataFrame(out)

    found = left.groupBy("part", "b").cogroup(right.groupBy("part", "b")).applyInPandas(
        find, f"query_id {kinds[1]['query_id']}, job_id {kinds[0]['job_id']}, similarity double")
    return top_k_per_group(found, "query_id", [F.col("similarity").desc(), F.col("job_id")], k, salt_key="job_id").select("query_id", "job_id", "similarity", "rank")


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(query_id, recall)``: the share of the exact neighbours that were found."""
    hit = exact.select("query_id", "job_id").join(found.select("query_id", "job_id").withColumn("_hit", F.lit(1)), ["query_id", "job_id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


def build_index(jobs: DataFrame, path: str, part_rows: int = 10_000, m: int = 16, width: int = 64, k: int = 10,
                recall: float = 0.97, probes: int = 64) -> GraphIndex:
    """Index ``jobs(job_id, vec)`` (null and zero vectors take no part) at ``path``."""
    spark = jobs.sparkSession
    rows = scratch_table(jobs.select("job_id", unit("vec").alias("vec")).where(F.col("vec").isNotNull()), "unit-vectors")
    n = rows.count()
    parts = max(1, -(-n // part_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")  # an order that has nothing to do with the vectors
        g = SmallWorld.build(np.stack(pdf["vec"].to_list()), m, width)
        return pd.DataFrame({"part": pdf["part"].to_numpy(), "node": np.arange(len(pdf)), "job_id": pdf["job_id"].to_numpy(), "vec": pdf["vec"].to_numpy(), "links": [x.tolist() for x in g.links]})

    dealt = rows.withColumn("h", F.xxhash64("job_id", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("job_id"), F.lit(parts)).cast("int"))
    built = dealt.groupBy("part").applyInPandas(build, f"part int, node int, job_id {dict(jobs.dtypes)['job_id']}, vec array<double>, links array<int>")
    built.write.mode("overwrite").parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")

    probe = scratch_table(rows.orderBy(F.xxhash64("job_id", F.lit(2))).limit(probes).select(F.col("job_id").alias("query_id"), "vec"), "probes")
    exact = scratch_table(top_k_by_dot(rows, probe, large_key="job_id", small_key="query_id", k=k), "probe-neighbours")
    while True:
        got = recall_of(_search(nodes, probe, parts, k, width), exact).agg(F.avg("recall")).first()[0]
        if got is None or got >= recall or width >= part_rows:
            break
        width *= 2
    spark.createDataFrame([(parts, width, n, got)], "parts int, width int, n long, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return GraphIndex(spark, path)


def open_index(jobs: DataFrame, name: str, **options) -> GraphIndex:
    """The index of ``jobs``, read where it was built before."""
    path = index_path(jobs, name)
    if _exists(jobs.sparkSession, f"{path}/meta/_SUCCESS"):
        return GraphIndex(jobs.sparkSession, path)
    return build_index(jobs, path, **options)
