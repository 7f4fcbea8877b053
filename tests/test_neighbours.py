"""Graph index and NN-descent against all similarities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from joblake.operators import graph_index as GI
from joblake.operators import neighbour_graph as NG


def rows(spark, x, key="job_id"):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], f"{key} long, vec array<double>")


def exact(x, q, k, same=False):
    x, q = (np.asarray(m) / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, q))
    s = q @ x.T
    if same:
        np.fill_diagonal(s, -np.inf)
    return [set(np.argsort(-r, kind="stable")[:k].tolist()) for r in s]


def test_small_world_search_finds_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = GI.SmallWorld.build(x, 12, 48)
    assert max(len(v) for v in g.links) <= 24
    want = exact(x, x[:100], 10)
    got = [{j for _, j in g.search(v, 96)[:10]} for v in x[:100]]
    assert np.mean([len(a & b) / 10 for a, b in zip(got, want)]) > 0.95
    whole = g.search(x[3], 600)  # as wide as the part: every row that can be reached, in order
    assert whole[0][1] == 3 and [s for s, _ in whole] == sorted((s for s, _ in whole), reverse=True)
    assert GI.SmallWorld.build(x[:0], 4, 8).search(x[0], 5) == []


def test_index_is_written_once_and_read_again(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = list(rng.normal(size=(500, 16))) + [np.zeros(16), None] + [rng.normal(size=16)] * 30
    jobs = rows(spark, x)
    index = GI.open_index(jobs, "test-listings", part_rows=150)
    assert index.meta["parts"] == 4 and index.meta["n"] == 530 and index.meta["recall"] >= 0.95
    monkeypatch.setattr(GI, "build_index", None)  # from now on it can only be read
    again = GI.open_index(jobs, "test-listings", part_rows=150)
    assert again.path == index.path
    q = rng.normal(size=(20, 16))
    got = again.search(rows(spark, q, "query_id"), 10).collect()
    known = [v for v in x if v is not None and np.any(v)]
    ids = [i for i, v in enumerate(x) if v is not None and np.any(v)]
    want = exact(known, q, 10)
    hits = [len({r.job_id for r in got if r.query_id == i} & {ids[j] for j in w}) / 10 for i, w in enumerate(want)]
    assert np.mean(hits) > 0.95
    assert sorted(r.rank for r in got if r.query_id == 0) == list(range(1, 11))
    with pytest.raises(TypeError):  # another table has another index
        GI.open_index(jobs.where("job_id < 400"), "test-listings")


def test_unfinished_index_is_built_anew(spark):
    jobs = rows(spark, np.random.default_rng(3).normal(size=(40, 4)))
    path = GI.index_path(jobs, "half")
    jobs.limit(1).write.parquet(f"{path}/nodes")
    assert GI.open_index(jobs, "half").search(rows(spark, np.eye(4), "query_id"), 3).count() == 12


def test_descent_finds_the_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 12))
    stats = {}
    got = NG.nn_descent(rows(spark, x, "id"), k=16, stats=stats).collect()
    assert stats["rounds"] < 20 and all(r.id != r.nid for r in got)
    near = {}
    for r in got:
        near.setdefault(r.id, []).append((-r.similarity, r.nid))
    want = exact(x, x, 8, same=True)
    assert np.mean([len({j for _, j in sorted(near[i])[:8]} & w) / 8 for i, w in enumerate(want)]) > 0.95
    a, b = got[0].id, got[0].nid
    assert abs(got[0].similarity - x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b])) < 1e-12


def test_descent_small_and_odd_tables(spark):
    assert NG.nn_descent(rows(spark, [[1.0, 0.0]], "id")).count() == 0
    got = NG.nn_descent(rows(spark, [[1.0, 0.0], [2.0, 0.1], None, [0.0, 0.0], [0.0, 1.0]], "id"), k=5)
    assert sorted((r.id, r.nid) for r in got.collect()) == [(0, 1), (0, 4), (1, 0), (1, 4), (4, 0), (4, 1)]
    hub = [[1.0, 0.0, 0.0]] + [[1.0, 0.001 * i, 1.0] for i in range(200)]  # the same vector nearly, one in the middle
    assert NG.nn_descent(rows(spark, hub, "id"), k=4).groupBy("id").count().where("count <> 4").count() == 0


def test_queries_reach_their_recall(spark, entry):
    for name in ("vector_search_approx", "knn_keywords_descent"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.01").agg(F.avg("recall")).first()[0] >= 0.95


def test_descent_lists_a_neighbour_once(spark):
    x = np.random.default_rng(6).normal(size=(300, 10))
    got = NG.nn_descent(rows(spark, x, "id"), k=12)
    assert got.groupBy("id", "nid").count().where("count > 1").count() == 0


def test_descent_compares_a_group_of_nodes_in_arrays():
    """F5 F6: one table holds many nodes; pairs are those of each node's neighbours, one of them new, nearer than the furthest."""
    import pyarrow as pa
    from joblake.operators.neighbour_graph import _around
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(9, 4))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    rows = [(u, v, bool(rng.integers(2)), 0.1 * v - 0.5) for u in ("n", "m") for v in rng.permutation(9)[:6].tolist()]
    rows += [("m", r[1], False, r[3]) for r in rows if r[0] == "m"][:2]  # a neighbour of both directions
    t = pa.table({"u": [r[0] for r in rows], "v": [r[1] for r in rows], "new": [r[2] for r in rows], "vec": [vec[r[1]].tolist() for r in rows], "worst": [r[3] for r in rows], "g": [0] * len(rows)})
    want = []
    for node in "nm":
        own = {}
        for u, v, new, worst in rows:
            if u == node:
                own[v] = (own.get(v, (False,))[0] or new, worst)
        want += [(a, b) for a in own for b in own if a != b and (own[a][0] or own[b][0]) and vec[a] @ vec[b] > own[a][1]]
    got = _around(t).to_pylist()
    assert sorted((r["u"], r["v"]) for r in got) == sorted(want) and all(abs(r["sim"] - vec[r["u"]] @ vec[r["v"]]) < 1e-12 for r in got)
