"""Lattice hashing against all cosines."""

import itertools

import numpy as np
from pyspark.sql import functions as F, types as T

from joblake.llm import lattice as la

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def plain(ids, vectors, threshold):
    """Rows as the operator gives them, from all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(vectors)
    links = [set() for _ in range(n)]
    for i, j in itertools.combinations(range(n), 2):
        if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
            x, y = np.array(vectors[i], float), np.array(vectors[j], float)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    rows = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min((ids[j] for j in seen if ids[j] is not None), default=None)
        rows.append((ids[i], len(links[i]), low, ids[i] == low))
    return sorted(rows, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_nearest_lattice_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    at = la.nearest_e8(x)
    assert ((at.sum(1) % 2 == 0) & ((2 * at) % 1 == 0).all(1)).all()
    assert len(la.SHORTEST) == 240 and (np.abs((la.SHORTEST ** 2).sum(1) - 2) < 1e-12).all()
    # no neighbour is nearer, so it is the nearest: a point's Voronoi cell is bounded by its shortest vectors and those of length 2
    longer = np.array([v for v in itertools.product((-2, -1, 0, 1, 2), repeat=8) if sum(x * x for x in v) == 4 and sum(v) % 2 == 0], float)
    for moves in (la.SHORTEST, longer):
        assert (((x - at) ** 2).sum(1)[:, None] <= ((x[:, None] - at[:, None] - moves) ** 2).sum(2) + 1e-9).all()


def test_families_and_singles(spark, monkeypatch):
    monkeypatch.setattr(la, "BLOCK", 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    vectors = [c + rng.normal(size=24) * s for c in centres for s in (0, .1, .1, .15, .2, .25)] + list(rng.normal(size=(60, 24)))
    vectors += [vectors[0]] * 9 + [vectors[7] * 2.5, -vectors[9]]
    ids = [int(x) for x in rng.permutation(len(vectors))]
    assert rows(la.near_duplicate_vectors(table(spark, vectors, ids), recall=0.99999)) == plain(ids, vectors, 0.95)


def test_one_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(la, "BLOCK", 16)
    rng = np.random.default_rng(3)
    c = rng.normal(size=16)
    vectors = [c + rng.normal(size=16) * 0.24 for _ in range(150)]
    want = plain(list(range(150)), vectors, 0.95)
    got = rows(la.near_duplicate_vectors(table(spark, vectors), recall=0.99999))
    assert 0 < sum(r[1] for r in want) < 150 * 149
    assert got == want


def test_cells_met_before(monkeypatch):
    monkeypatch.setattr(la, "_COLUMNS", 3)
    rng = np.random.default_rng(5)
    lists = [[np.unique(rng.integers(0, 40, rng.integers(0, 9))) for _ in range(n)] for n in (6, 6, 8, 8)]
    # a home cell is among a vector's cells, as in the operator
    lists = [lists[0], [np.union1d(h, m) for h, m in zip(*lists[:2])], lists[2], [np.union1d(h, m) for h, m in zip(*lists[2:])]]
    want = [[len(set(hx[hx < 30]) & set(my)) + len(set(mx[mx < 30]) & set(hy)) for hy, my in zip(*lists[2:])] for hx, mx in zip(*lists[:2])]
    assert la._shared(*lists, 30).tolist() == want


def test_groups_reach_their_smallest_member():
    ok = np.zeros((4, 5), bool)
    for i, j in ((3, 0), (3, 4), (1, 4), (0, 2)):
        ok[i, j] = True
    row, col = la._groups(ok)
    assert row.tolist() == [0, 1, 2, 1] and col.tolist() == [1, 5, 0, 7, 1]


def test_recall_at_the_threshold_itself(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.9501 * x + np.sqrt(1 - 0.9501 ** 2) * z
    got = la.near_duplicate_vectors(table(spark, [*x, *y])).where("vec_id < 400").agg(F.avg((F.col("n_links") > 0).cast("int"))).first()[0]
    assert got >= 0.95


def test_edge_cases(spark):
    big = [1e300, 1e300, 1e292]
    vectors = [None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [1.0, 2.0, 0.0],
               [-1.0, -2.0], big, [1e-300, 1e-300, 1e-308], [-0.0, 1.0], [0.0, 1.0]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 6, 9, 10, 11, None, None, None]
    got = la.near_duplicate_vectors(table(spark, vectors, ids).withColumn("cls", F.lit("x")).withColumn("v", F.lit(1)))
    want = []
    for i, n, low, kept in plain(ids, [[x * 2.0 ** -990 for x in v] if v is big else v if i != 12 else [1.0, 1.0, 1e-8] for i, v in enumerate(vectors)], 0.95):
        want.append((i, n, low, kept if i is not None or low is not None else True))
    assert rows(got) == sorted(want, key=repr)
    empty = la.near_duplicate_vectors(table(spark, [[1.0]]).limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]
