"""Constrained clustering against the links taken one by one."""

import random
from collections import defaultdict

import pytest

from joblake.operators import clustering as CL
from joblake.operators import curation as C
from joblake.plans.bindings import Tables
from joblake.plans import q_curation as Q

from conftest import SMALL


def one_by_one(links, anchors):
    """The rule as it is stated: best link first, no cluster with two anchors."""
    best = {}
    for a, b, s in links:
        if a is not None and b is not None and s is not None and a != b:
            k = (min(a, b), max(a, b))
            best[k] = max(s, best.get(k, s))
    parts = {n: frozenset([n]) for k in best for n in k}
    for (a, b), s in sorted(best.items(), key=lambda e: (-e[1], e[0])):
        p, q = parts[a], parts[b]
        if p is not q and not (p & anchors and q & anchors):
            for n in p | q:
                parts[n] = p | q
            joined = p | q
            for n in joined:
                parts[n] = joined
    return {frozenset(p) for p in parts.values()}


def clusters_of(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.cluster].add(r.node)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_equals_links_taken_one_by_one(spark, seed):
    rng = random.Random(seed)
    n = 60
    # few different similarities: many ties; links in both directions, repeated, with nulls and to itself
    links = [(rng.randrange(n), rng.randrange(n), rng.choice([0.3, 0.5, 0.6, 0.9])) for _ in range(95)]
    links += [(b, a, s) for a, b, s in links[:20]] + [(a, b, 0.4) for a, b, _ in links[:10]] + [(None, 1, 0.9), (2, None, 0.9), (3, 4, None), (5, 5, 1.0)]
    anchors = set(rng.sample(range(n), 12))
    got = clusters_of(CL.constrained_clusters(spark.createDataFrame(links, "a long, b long, similarity double"),
                                              spark.createDataFrame([(a,) for a in anchors] + [(None,)], "node long")))
    assert {frozenset(v) for v in got.values()} == one_by_one(links, anchors)
    for name, nodes in got.items():
        assert name in nodes and len(nodes & anchors) <= 1 and (not nodes & anchors or name in anchors)


def test_a_long_chain_between_two_anchors_is_cut_at_its_weakest_link(spark):
    links = [(i, i + 1, 0.9 - (0.2 if i == 37 else 0.0)) for i in range(80)]
    got = clusters_of(CL.constrained_clusters(spark.createDataFrame(links, "a long, b long, similarity double"), spark.createDataFrame([(0,), (80,)], "node long")))
    assert {k: (min(v), max(v)) for k, v in got.items()} == {0: (0, 37), 80: (38, 80)}


def test_one_anchor_that_most_entries_are_near_to(spark):
    links = [(0, i, 0.8) for i in range(1, 400)] + [(i, 1000 + i, 0.9) for i in range(1, 50)]
    got = clusters_of(CL.constrained_clusters(spark.createDataFrame(links, "a long, b long, similarity double"), spark.createDataFrame([(0,), (1001,)], "node long")))
    assert got[1001] == {1, 1001} and len(got) == 2 and len(got[0]) == 399 - 1 + 1 + 48


def test_no_links(spark):
    none = spark.createDataFrame([], "a long, b long, similarity double")
    assert CL.constrained_clusters(none, spark.createDataFrame([(1,)], "node long")).count() == 0


ENTRIES = [("skill", 1, "sql", 0), ("skill", 2, "python", 0), ("skill", 3, "pyton", 1), ("skill", 4, "pythn", 1), ("skill", 5, "go", 1), ("skill", 6, "golang", 1),
           ("skill", 7, "knitting", 1), ("skill", 8, "no vector", 1), ("skill", 9, "so-so", 1), ("framework", 3, "spark", 0), ("framework", 4, "apache spark", 1)]


def test_verdicts(spark):
    entries = spark.createDataFrame(ENTRIES, "kind string, id long, name string, is_candidate int")
    near = spark.createDataFrame([("skill", 3, 2, 0.8), ("skill", 4, 3, 0.9), ("skill", 3, 1, 0.5), ("skill", 5, 6, 0.7), ("skill", 6, 5, 0.7), ("skill", 7, 1, 0.1),
                                  ("skill", 9, 1, 0.25), ("framework", 4, 3, 0.6), ("skill", 1, 2, 0.95)], "kind string, id long, nid long, similarity double")
    got = {(r.kind, r.id): (r.action, r.into_id, r.into_name) for r in CL.classify_by_clusters(near, entries).collect()}
    assert got == {("skill", 3): ("merge", 2, "python"), ("skill", 4): ("merge", 2, "python"), ("skill", 5): ("promote", None, None),
                   ("skill", 6): ("merge", 5, "go"), ("skill", 7): ("delete", None, None), ("skill", 8): ("promote", None, None),
                   ("skill", 9): ("promote", None, None), ("framework", 4): ("merge", 3, "spark")}


def test_plan_needs_no_resolving(spark):
    """On the whole dictionary: one verdict per candidate, no merge into a merged or deleted entry."""
    T = Tables(spark, SMALL)
    plan = Q.classify_by_clusters(T).collect()
    entries = {(r.kind, r.id): r for r in T.entries.select("kind", "id", "name", "is_candidate").collect()}
    assert sorted((r.kind, r.id) for r in plan) == sorted(k for k, r in entries.items() if r.is_candidate == 1)
    action = {(r.kind, r.id): r.action for r in plan}
    merges = [r for r in plan if r.action == "merge"]
    assert merges and all(action.get((r.kind, r.into_id), "canonical") in ("canonical", "promote") for r in merges)
    assert all(entries[r.kind, r.into_id].name == r.into_name for r in merges)
    df = spark.createDataFrame(plan, "kind string, id long, name string, action string, into_id long, into_name string")
    assert sorted(C.resolve_merge_chains(df).collect(), key=str) == sorted(df.collect(), key=str)
