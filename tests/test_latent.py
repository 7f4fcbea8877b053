"""Learned dense vectors against a dense singular value decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from joblake.operators import latent as LT

SCHEMA = "id long, vec struct<size:int,indices:array<int>,values:array<double>>"


def sparse_rows(spark, m):
    rows = []
    for i, r in enumerate(m):
        at = np.flatnonzero(r)
        rows.append((i, (len(r), [int(a) for a in at], [float(r[a]) for a in at])))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(5)
    topics = np.abs(rng.normal(size=(6, 90))) * (rng.random((6, 90)) < 0.3)
    weight = rng.dirichlet(np.full(6, 0.3), size=150) * np.array([9, 7, 5, 4, 3, 2])
    m = weight @ topics
    m[rng.random(m.shape) < 0.4] = 0
    m[17] = 0
    return m


def test_subspace_is_that_of_a_dense_decomposition(spark, matrix):
    got = LT.fit_subspace(sparse_rows(spark, matrix), 90, 5, tolerance=1e-7, max_passes=15)
    _, s, vt = np.linalg.svd(matrix)
    assert np.allclose(got.values, s[:5], rtol=1e-4)
    assert np.allclose(got.basis.T @ got.basis, np.eye(5), atol=1e-9)
    # sine of the largest angle between the two subspaces
    assert np.linalg.norm(got.basis - vt[:5].T @ (vt[:5] @ got.basis), 2) < 1e-2


def test_signs_and_seeds_do_not_matter(spark, matrix):
    rows = sparse_rows(spark, matrix)
    a, b = (LT.fit_subspace(rows, 90, 3, tolerance=1e-7, max_passes=15, seed=s) for s in (1, 2))
    assert np.allclose(a.basis, b.basis, atol=1e-3)


def test_projection(spark, matrix):
    rows = sparse_rows(spark, matrix)
    space = LT.fit_subspace(rows, 90, 5)
    got = {r.id: r.vec for r in LT.project(rows, space).collect()}
    z = matrix @ space.basis
    assert got[17] is None and len(got) == 150
    for i, v in got.items():
        if v is not None:
            assert np.allclose(v, z[i] / np.linalg.norm(z[i]))
    plain = {r.id: r.z for r in LT.project(rows, space, out="z", unit=False).select("id", "z").collect()}
    assert np.allclose(plain[3], z[3])


def test_slices_cover_every_row_once(spark, matrix, monkeypatch):
    rows = sparse_rows(spark, matrix).coalesce(1)
    whole = LT.fit_subspace(rows, 90, 4)
    # the same in steps of one row: forked workers do not see a patch, so the slices themselves
    import pyarrow as pa
    monkeypatch.setattr(LT, "ENTRIES", 1)
    cells = [{"size": 90, "indices": [int(a) for a in np.flatnonzero(r)], "values": [float(r[a]) for a in np.flatnonzero(r)]} for r in matrix] + [None]
    col = pa.array(cells, pa.struct([("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))
    parts = list(LT._slices(col, 4))
    assert [(s.start, s.stop) for *_, s in parts] == [(i, i + 1) for i in range(151)]
    z = np.concatenate([LT._times(a, i, v, whole.basis) for a, i, v, _ in parts])
    assert np.allclose(z[:150], matrix @ whole.basis) and not z[150].any()


def test_rank_is_never_more_than_the_matrix_has(spark):
    m = np.outer([1.0, 2, 0, 4], [1.0, 0, 3, 0, 0, 1])
    got = LT.fit_subspace(sparse_rows(spark, m), 6, 4)
    assert got.basis.shape == (6, 1)
    none = LT.fit_subspace(spark.createDataFrame([(1, None)], SCHEMA), 6, 4)
    assert none.basis.shape == (6, 0)
    assert LT.project(sparse_rows(spark, m), none).where("vec is not null").count() == 0
    empty = LT.fit_subspace(spark.createDataFrame([], SCHEMA), 6, 4)
    assert empty.basis.shape == (6, 0)
    with pytest.raises(ValueError):
        LT.fit_subspace(spark.createDataFrame([], SCHEMA), 1 << 20, 64)


def test_words_that_never_meet_are_near_when_their_company_is_the_same(spark):
    """'car' and 'auto' stand in no text together but with the same words."""
    texts = [f"{a} engine wheel road {x}" for a in ("car", "auto") for x in ("fast", "slow", "red", "blue")]
    texts += [f"{a} oven pan kitchen {x}" for a in ("bread", "cake") for x in ("warm", "cold", "sweet", "big")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    model = LT.fit_latent(docs, rank=2, num_features=512, tolerance=1e-5)
    asked = spark.createDataFrame([(0, "car"), (1, "auto"), (2, "cake"), (3, None), (4, "")], "id long, text string")
    v = {r.id: r.vec for r in model.embed(asked).collect()}
    assert np.dot(v[0], v[1]) > 0.95 and abs(np.dot(v[0], v[2])) < 0.3
    assert v[3] is None and v[4] is None


def test_partner_ranks(spark):
    found = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 9, 1), (2, 2, 2), (3, 9, 1)], "query_id long, job_id long, rank int")
    r = LT.rank_of_partner(found).first()
    assert (r.n, r.mean_reciprocal) == (3, 0.5) and abs(r.found_first - 1 / 3) < 1e-12
    assert LT.rank_of_partner(found.where(F.lit(False))).first().n == 0


def test_a_block_of_short_rows_stays_bounded():
    """Dense cells of a block are rows × distinct features, whatever the rows hold."""
    import pyarrow as pa
    rng = np.random.default_rng(2)
    cells = [{"size": 8192, "indices": sorted(rng.choice(8192, n, replace=False).tolist()), "values": [1.0] * n} for n in [2] * 3000 + [8000, 0, 300]]
    col = pa.array(cells, pa.struct([("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))
    for starts, idx, _, span in LT._slices(col, 80):
        assert len(starts) == 1 or len(starts) * len(np.unique(idx)) <= LT.ENTRIES


def test_block_product_adds_up_entry_by_entry():
    starts, idx, val = np.array([0, 0, 3, 3]), np.array([4, 1, 4, 0]), np.array([1.0, 2.0, 0.5, 3.0])
    basis = np.random.default_rng(3).normal(size=(6, 2))
    want = np.array([[0, 0], 1.5 * basis[4] + 2 * basis[1], [0, 0], 3 * basis[0]])
    assert np.allclose(LT._times(starts, idx, val, basis), want)


def test_texts_of_one_partition_are_dealt_to_every_pass(spark, monkeypatch):
    """However few parts the texts are stored in, the term matrix has as many as there are cores."""
    parts, table = {}, LT.scratch_table

    def kept(df, name):
        parts[name] = df.select(F.spark_partition_id().alias("p")).distinct().count()
        return table(df, name)

    monkeypatch.setattr(LT, "scratch_table", kept)
    texts = spark.range(200).select(F.concat_ws(" ", F.lit("word"), F.col("id") % 7, F.col("id") % 11).alias("text")).coalesce(1)
    LT.fit_latent(texts, rank=2, num_features=64)
    assert parts["term-matrix"] > 1
