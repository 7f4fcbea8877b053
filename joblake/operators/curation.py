"""Taxonomy curation: review verdicts, merge-chain resolution, plan application.

A plan is a frame (kind, id, name, action, into_id, into_name) with action in
promote / merge / delete; (kind, id) is the key. Applying a plan maps one
snapshot of (keywords, aliases, job_keywords) to the next; every step is an
anti-join or a keyed update, so re-running a plan is harmless (resume).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblake.operators.changes import latest
from joblake.schemas import USER_LEVELS
from joblake.session import scratch_table

K = ["kind", "id"]


def parse_review(text) -> F.Column:
    """Verdict line → struct(action, target): PROMOTE / DELETE / 'MERGE <id>';
    a merge without an id, or anything else, is a promote."""
    t = F.upper(F.trim(F.col(text) if isinstance(text, str) else text))
    num = F.regexp_extract(t, r"(\d+)", 1)
    action = (F.when(t.startswith("PROMOTE"), "promote").when(t.startswith("DELETE"), "delete")
              .when(t.startswith("MERGE") & (num != ""), "merge").otherwise("promote"))
    target = F.when(action == "merge", num.cast("long"))
    return F.struct(action.alias("action"), target.alias("target"))


def classify_candidates(best: DataFrame, names: DataFrame, merge_at: float = 0.35,
                        delete_below: float = 0.2) -> DataFrame:
    """Rule verdict per entry from its best neighbour (kind, id, nid,
    similarity): merge into it at or above ``merge_at``, delete when even the
    best neighbour is below ``delete_below`` (an isolated term), else promote."""
    n = names.select("kind", "id", "name")
    into = names.select("kind", F.col("id").alias("nid"), F.col("name").alias("into_name"))
    s = F.col("similarity")
    action = F.when(s >= merge_at, "merge").when(s < delete_below, "delete").otherwise("promote")
    return (best.join(n, K).join(into, ["kind", "nid"], "left")
            .select("kind", "id", "name", action.alias("action"),
                    F.when(action == "merge", F.col("nid")).alias("into_id"),
                    F.when(action == "merge", F.col("into_name")).alias("into_name")))


def resolve_merge_chains(plan: DataFrame) -> DataFrame:
    """Collapse merge chains A→B→C to A→C. Members of a merge cycle are
    promoted; a chain whose next target is deleted is promoted; a chain that
    runs into a cycle stops at the first cycle member.

    Two pointer-jumping passes over the merge graph (each merge node has one
    out-edge): (1) doubling until a step drops no pointer lands every node on a
    cycle or a sink, and the nodes landed on are exactly the cycle members
    (it stops early once no pointer leads on);
    (2) jumping until a stop node (non-merge target, deleted, or cycle
    member) gives each other node its terminal. O(log n) self-joins, lineage
    cut by reliable checkpoints. The plan is read many times here: it is
    written first, so that the neighbour search behind it runs once."""
    plan = scratch_table(plan, "plan")
    merges = scratch_table(plan.where(F.col("action") == "merge").select("kind", "id", "into_id"), "merges")
    deleted = scratch_table(plan.where(F.col("action") == "delete").select("kind", "id"), "deleted")

    is_merge = merges.select("kind", F.col("id").alias("into_id"), F.lit(True).alias("_m"))
    ptr = scratch_table(merges.join(is_merge, ["kind", "into_id"], "left")
                        .select("kind", "id", F.when(F.col("_m"), F.col("into_id")).alias("p")), "pointers")
    # pointers that still lead on; sinks (NULL) leave, so this ends with the cycles' members and what leads into them
    alive, steps = ptr.where("p is not null").count(), 0
    while alive:
        nxt = ptr.select("kind", F.col("id").alias("p"), F.col("p").alias("pp"))
        ptr = scratch_table(ptr.join(nxt, ["kind", "p"], "left").select("kind", "id", F.col("pp").alias("p")), "pointers")
        steps, before, alive = steps + 1, alive, ptr.where("p is not null").count()
        if alive == before and 2 ** steps > alive:
            break
    cycle = scratch_table(ptr.where(F.col("p").isNotNull()).select("kind", F.col("p").alias("id")).distinct(), "cycles")

    stop = (merges.select("kind", F.col("into_id").alias("id"))
            .join(merges.select("kind", "id"), K, "left_anti")
            .unionByName(deleted).unionByName(cycle).distinct()
            .withColumn("_stop", F.lit(True)))
    walk = scratch_table(merges.join(cycle, K, "left_anti")
                         .join(stop.withColumnRenamed("id", "into_id"), ["kind", "into_id"], "left")
                         .select("kind", "id", F.col("into_id").alias("ptr"), F.coalesce("_stop", F.lit(False)).alias("done")), "walk")
    while not walk.where(~F.col("done")).isEmpty():
        t = walk.select("kind", F.col("id").alias("ptr"), F.col("ptr").alias("t_ptr"), F.col("done").alias("t_done"))
        walk = scratch_table(walk.join(t, ["kind", "ptr"], "left")
                             .select("kind", "id",
                                     F.when(F.col("done"), F.col("ptr")).otherwise(F.col("t_ptr")).alias("ptr"),
                                     (F.col("done") | F.coalesce("t_done", F.lit(False))).alias("done")), "walk")

    names = (plan.select("kind", "id", "name")
             .unionByName(plan.where(F.col("into_id").isNotNull())
                          .select("kind", F.col("into_id").alias("id"), F.col("into_name").alias("name")))
             .groupBy("kind", "id").agg(F.min("name").alias("tname")))
    dead = deleted.withColumn("_dead", F.lit(True)).withColumnRenamed("id", "ptr")
    resolved = (walk.join(dead, ["kind", "ptr"], "left")
                .join(names.withColumnRenamed("id", "ptr"), ["kind", "ptr"], "left")
                .select("kind", "id", F.when(F.col("_dead"), None).otherwise(F.col("ptr")).alias("t"),
                        "tname"))
    base = plan.join(resolved, K, "left").join(cycle.withColumn("_cyc", F.lit(True)), K, "left")
    is_m = F.col("action") == "merge"
    promote_instead = is_m & (F.coalesce(F.col("_cyc"), F.lit(False)) | F.col("t").isNull())
    return base.select(
        "kind", "id", "name",
        F.when(promote_instead, "promote").otherwise(F.col("action")).alias("action"),
        F.when(is_m & ~promote_instead, F.col("t")).alias("into_id"),
        F.when(is_m & ~promote_instead, F.col("tname")).alias("into_name"))


def apply_promote(keywords: DataFrame, plan: DataFrame) -> DataFrame:
    ids = plan.where(F.col("action") == "promote").select("kind", "id", F.lit(True).alias("_p"))
    out = keywords.join(ids, K, "left")
    return out.withColumn("is_candidate", F.when(F.col("_p"), F.lit(0)).otherwise(F.col("is_candidate"))).drop("_p")


def apply_merge(keywords: DataFrame, aliases: DataFrame, job_keywords: DataFrame,
                plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repoint junction rows of each merged entry to its target (dropping
    those that would collide), add the entry's lowercase name as an alias of
    the target when absent, and remove the entry. Merges whose entry is gone
    are skipped."""
    m = (plan.where(F.col("action") == "merge").select("kind", "id", "into_id")
         .join(keywords.select("kind", "id", "name"), K))
    jk = job_keywords.join(m.select("kind", "id", "into_id"), K, "left")
    new_jk = (jk.select("job_id", "kind", F.coalesce("into_id", "id").alias("id"))
              .dropDuplicates(["job_id", "kind", "id"]))
    new_alias = m.select("kind", F.lower("name").alias("alias"), F.col("into_id").alias("id"))
    new_alias = new_alias.join(aliases.select("kind", "alias"), ["kind", "alias"], "left_anti")
    new_alias = new_alias.groupBy("kind", "alias").agg(F.min("id").alias("id"))
    aliases2 = aliases.select("kind", "alias", "id").unionByName(new_alias)
    keywords2 = keywords.join(m.select("kind", "id"), K, "left_anti")
    return keywords2, aliases2, new_jk


def apply_delete(keywords: DataFrame, job_keywords: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = plan.where(F.col("action") == "delete").select("kind", "id")
    return keywords.join(d, K, "left_anti"), job_keywords.join(d, K, "left_anti")


def apply_plan(keywords: DataFrame, aliases: DataFrame, job_keywords: DataFrame,
               plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains resolved again, then promote, merge, delete on one snapshot."""
    p = resolve_merge_chains(plan)
    kw = apply_promote(keywords, p)
    kw, al, jk = apply_merge(kw, aliases, job_keywords, p)
    kw, jk = apply_delete(kw, jk, p)
    return kw, al, jk


def plan_preview(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def set_level(keywords: DataFrame, changes: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply (kind, id, level) changes: a valid level or NULL (clear) is set;
    any other value goes to the reject frame."""
    valid = F.col("level").isNull() | F.col("level").isin(USER_LEVELS)
    ok = latest(changes.where(valid), ["kind", "id"], order).select("kind", "id", F.col("level").alias("_lvl"), F.lit(True).alias("_hit"))
    rejects = changes.where(~valid)
    out = (keywords.join(ok, K, "left")
           .withColumn("user_level", F.when(F.col("_hit"), F.col("_lvl")).otherwise(F.col("user_level")))
           .drop("_lvl", "_hit"))
    return out, rejects
