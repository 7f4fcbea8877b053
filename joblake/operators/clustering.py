"""Agglomerative clustering over a neighbour graph in which some entries must not
come together: no cluster holds two anchors (for the taxonomy, two canonicals).

The rule: links are taken from the most similar to the least (ties by their ends);
a link joins the clusters of its two ends unless both hold an anchor. That greedy
order is Kruskal's, and with all anchors seen as one node it gives a maximum
spanning forest, so its result need not be computed in that order: in a round every
cluster without an anchor joins across its best remaining link, all of them at once.
At least every second cluster without an anchor is gone after a round. Clusters with an anchor
never choose, so one that most entries belong to is no group of its own, and a
link between two of them is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblake.session import drop_scratch, scratch_table


def _roots(pointers: DataFrame) -> DataFrame:
    """``pointers(c, p, anchored)`` without cycles: each ``c`` with the end of its chain,
    by pointer doubling."""
    while True:
        up = pointers.select(F.col("c").alias("p"), F.col("p").alias("pp"), F.col("anchored").alias("pa"))
        stepped = pointers.join(up, "p", "left")
        if stepped.where("pp is not null").isEmpty():
            return pointers
        old = pointers
        pointers = scratch_table(stepped.select("c", F.coalesce("pp", "p").alias("p"), F.coalesce("pa", "anchored").alias("anchored")), "cluster-pointers")
        drop_scratch(old)


def constrained_clusters(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """``links(a, b, similarity)`` and ``anchors(node)`` to ``(node, cluster)`` for every
    node that has a link; a cluster is named by one of its nodes, by its anchor if
    it has one. Nodes are of any type that can be ordered. Links in both
    directions or repeated count once, with the higher similarity; links of a node with
    itself, or with a null, are left out.

    Every round is one grouped maximum and a few joins by cluster; links, members
    and pointers are written, so the lineage stays short."""
    ends = links.where("a is not null and b is not null and similarity is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    ends = ends.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    held = anchors.select("node").where("node is not null").distinct().withColumn("anchored", F.lit(True))

    def marked(df, c, flag):
        return (df.join(held.withColumnRenamed("node", c).withColumnRenamed("anchored", flag), c, "left").fillna({flag: False}))

    # order: the link by which a pair of clusters is compared; its original ends break ties
    order = F.struct((-F.col("similarity")).alias("s"), F.col("a").alias("x"), F.col("b").alias("y")).alias("link")
    edges = scratch_table(marked(marked(ends, "a", "fa"), "b", "fb").select(F.col("a").alias("ca"), "fa", F.col("b").alias("cb"), "fb", order)
                          .where("not (fa and fb)"), "cluster-links")
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    members = scratch_table(nodes.select("node", F.col("node").alias("cluster")), "cluster-members")
    while not edges.isEmpty():
        ways = (edges.select(F.col("ca").alias("c"), F.col("fa").alias("f"), F.col("cb").alias("p"), F.col("fb").alias("anchored"), "link")
                .unionByName(edges.select(F.col("cb").alias("c"), F.col("fb").alias("f"), F.col("ca").alias("p"), F.col("fa").alias("anchored"), "link")))
        best = ways.where("not f").groupBy("c").agg(F.min(F.struct("link", "p", "anchored")).alias("m")).select("c", "m.p", "m.anchored")
        best = scratch_table(best, "cluster-choice")
        # two clusters may choose each other, by the same link: the smaller stays; no longer cycle exists
        back = best.select(F.col("c").alias("p"), F.col("p").alias("c"), F.lit(True).alias("mutual"))
        pointers = scratch_table(best.join(back, ["c", "p"], "left").where("mutual is null or c > p").select("c", "p", "anchored"), "cluster-pointers")
        root = _roots(pointers)

        def moved(df, c, flag=None):
            to = root.select(F.col("c").alias(c), F.col("p").alias("__to"), F.col("anchored").alias("__flag"))
            out = df.join(to, c, "left").withColumn(c, F.coalesce("__to", c))
            return (out.withColumn(flag, F.coalesce("__flag", flag)) if flag else out).drop("__to", "__flag")

        left = moved(moved(edges, "ca", "fa"), "cb", "fb").where("ca <> cb and not (fa and fb)")
        # of the links between two clusters only the best can ever be taken
        turn = F.col("ca") < F.col("cb")
        left = (left.select(F.when(turn, F.col("ca")).otherwise(F.col("cb")).alias("ca"), F.when(turn, F.col("fa")).otherwise(F.col("fb")).alias("fa"),
                            F.when(turn, F.col("cb")).otherwise(F.col("ca")).alias("cb"), F.when(turn, F.col("fb")).otherwise(F.col("fa")).alias("fb"), "link")
                .groupBy("ca", "fa", "cb", "fb").agg(F.min("link").alias("link")))
        old, edges, members = (edges, members), scratch_table(left, "cluster-links"), scratch_table(moved(members, "cluster"), "cluster-members")
        drop_scratch(*old, best, root)
    drop_scratch(edges)
    return members


def representatives(clusters: DataFrame, links: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(cluster, representative)``: its anchor, otherwise the member with the largest
    sum of similarities within the cluster, ties to the smallest."""
    one = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    ca = clusters.select(F.col("node").alias("a"), F.col("cluster").alias("ca"))
    cb = clusters.select(F.col("node").alias("b"), F.col("cluster").alias("cb"))
    inside = one.join(ca, "a").join(cb, "b").where("ca = cb")
    # decimals: the sum does not depend on the order of adding
    support = (inside.select(F.explode(F.array("a", "b")).alias("node"), F.col("similarity").cast("decimal(24,12)").alias("s"))
               .groupBy("node").agg(F.sum("s").alias("support")))
    held = anchors.select("node").distinct().withColumn("anchored", F.lit(1))
    rated = clusters.join(support, "node", "left").join(held, "node", "left")
    first = F.struct((-F.coalesce("anchored", F.lit(0))).alias("k"), (-F.coalesce("support", F.lit(0))).alias("s"), F.col("node"))
    return rated.groupBy("cluster").agg(F.min(first).alias("m")).select("cluster", F.col("m.node").alias("representative"))


def classify_by_clusters(neighbours: DataFrame, entries: DataFrame, merge_at: float = 0.35, delete_below: float = 0.2) -> DataFrame:
    """A verdict per candidate, as ``curation.classify_candidates`` returns them, from
    clusters instead of the best neighbour alone.

    ``neighbours(kind, id, nid, similarity)`` are links within a kind, ``entries(kind,
    id, name, is_candidate)`` all entries. Links of at least ``merge_at`` are clustered;
    canonicals (``is_candidate`` 0) never come together. A candidate that is not its
    cluster's representative is merged into it. A candidate that is in no cluster
    is deleted when its best neighbour is below ``delete_below``; every other one,
    also one without any neighbour, is promoted. A merge's target is a canonical or
    a promoted candidate, so the plan has neither chains nor cycles."""
    key = F.struct("kind", "id")
    near = scratch_table(neighbours.select(key.alias("a"), F.struct("kind", F.col("nid").alias("id")).alias("b"), "similarity"), "cluster-near")
    links = near.where(F.col("similarity") >= merge_at)
    anchors = entries.where("is_candidate = 0").select(key.alias("node"))
    clusters = constrained_clusters(links, anchors)
    rep = representatives(clusters, links, anchors)
    best = (near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
            .groupBy(F.col("a").alias("node")).agg(F.max("similarity").alias("best")))
    names = entries.groupBy(key.alias("representative")).agg(F.min("name").alias("into_name"))
    asked = entries.where("is_candidate = 1").select("kind", "id", "name", key.alias("node"))
    rated = asked.join(clusters.join(rep, "cluster"), "node", "left").join(best, "node", "left").join(names, "representative", "left")
    merged = F.col("representative").isNotNull() & (F.col("representative") != F.col("node"))
    action = (F.when(merged, "merge").when(F.col("representative").isNull() & (F.col("best") < delete_below), "delete").otherwise("promote"))
    return rated.select("kind", "id", "name", action.alias("action"), F.when(merged, F.col("representative.id")).alias("into_id"),
                        F.when(merged, F.col("into_name")).alias("into_name"))
