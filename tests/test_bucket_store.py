"""The bucketed table against a plain dict, and what a change leaves alone."""

import glob
import os
import random

from pyspark.sql import functions as F

from joblake.sources.bucket_store import BucketStore

DDL = "id long, v string"


def files(path):
    return {f for f in glob.glob(f"{path}/data/*/*/*.parquet")}


def test_changes_rewrite_only_their_buckets(spark, tmp_path):
    path, rng = str(tmp_path / "t"), random.Random(3)
    store = BucketStore(spark, path, "id", 8)
    want = {i: f"v{i}" for i in [None, *range(60)]}
    store.create(spark.createDataFrame(list(want.items()), DDL))
    assert store.version() == 0 and dict(map(tuple, store.read().collect())) == want

    for step in range(2):
        rows = {rng.choice([None, *range(80)]): f"s{step}" for _ in range(3)}
        frame = spark.createDataFrame(list(rows.items()), DDL)
        hit = {r[0] for r in frame.select(store._bucket()).collect()}
        held = store._manifest(store.version())[0]
        store.upsert(frame)
        want |= rows
        now = store._manifest(store.version())[0]
        assert {b for b in now if now[b] != held.get(b)} == hit and len(hit) < 8
        assert sorted(map(repr, map(tuple, store.read().collect()))) == sorted(map(repr, want.items()))

    before = files(path)
    assert store.update(spark.createDataFrame([], DDL), lambda r: r) == 2 and files(path) == before
    store.delete(spark.createDataFrame([(i,) for i in (None, 1, 999)], "id long"))
    for i in (None, 1):
        want.pop(i)
    assert dict(map(tuple, store.read().collect())) == want
    assert store.read(0).count() == 61

    # data written, version not finished: the version before stays, and the number is taken again
    store.upsert(spark.createDataFrame([(5, "lost")], DDL))
    os.remove(f"{path}/versions/v=4/_SUCCESS")
    assert store.version() == 3 and dict(map(tuple, store.read().collect())) == want
    store.upsert(spark.createDataFrame([(6, "new", 1.5)], DDL + ", extra double"))
    got = {r.id: (r.v, r.extra) for r in store.read().collect()}
    assert got.pop(6) == ("new", 1.5) and all(got[i] == (want[i], None) for i in got) and len(got) == len(want) - 1
    store.vacuum()
    assert store.read().where(F.col("id") == 5).first().v == want[5]

    store.delete(store.read().select("id"))
    assert store.read().count() == 0 and store.read().columns == ["id", "v", "extra"]
