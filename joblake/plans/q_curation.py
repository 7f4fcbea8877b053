"""Taxonomy curation on the keyword binding: verdicts from nearest
neighbours, chain resolution, plan application (queries + oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblake.operators import clustering as CL
from joblake.operators import curation as C
from joblake.operators import neighbour_graph as NG
from joblake.operators import vectors as V
from joblake.plans.registry import register

MERGE_AT, DELETE_BELOW = 0.26, 0.19

# every keyword's best neighbour of its kind → a verdict; merges form chains and cycles
_PLAN_SQL = f"""
WITH e AS (SELECT kind, id, name, CAST(vec AS DOUBLE[]) AS v FROM b_entries),
s AS (SELECT c.kind, c.id, p.id AS nid, list_cosine_similarity(c.v, p.v) AS similarity
      FROM e c JOIN e p ON c.kind = p.kind AND c.id <> p.id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY similarity DESC, nid DESC) AS rk
                        FROM s) r WHERE rk = 1),
plan AS (
  SELECT b.kind, b.id, k.name,
         CASE WHEN similarity >= {MERGE_AT} THEN 'merge' WHEN similarity < {DELETE_BELOW} THEN 'delete' ELSE 'promote' END AS action,
         CASE WHEN similarity >= {MERGE_AT} THEN nid END AS into_id,
         CASE WHEN similarity >= {MERGE_AT} THEN n.name END AS into_name
  FROM best b JOIN b_entries k ON k.id = b.id LEFT JOIN b_entries n ON n.id = b.nid)
"""

_RESOLVE_SQL = _PLAN_SQL + """,
merges AS (SELECT kind, id, into_id FROM plan WHERE action = 'merge'),
deleted AS (SELECT kind, id FROM plan WHERE action = 'delete'),
walk AS (SELECT * FROM (WITH RECURSIVE w(kind, src, cur, depth, path) AS (
    SELECT kind, id, into_id, 1, [id] FROM merges
    UNION ALL
    SELECT w.kind, w.src, m.into_id, w.depth + 1, list_append(w.path, w.cur)
    FROM w JOIN merges m ON m.kind = w.kind AND m.id = w.cur
    WHERE NOT list_contains(w.path, w.cur))
  SELECT * FROM w)),
cycle AS (SELECT DISTINCT kind, src AS id FROM walk WHERE cur = src),
stops AS (SELECT kind, into_id AS id FROM merges WHERE (kind, into_id) NOT IN (SELECT kind, id FROM merges)
          UNION SELECT kind, id FROM deleted UNION SELECT kind, id FROM cycle),
term AS (SELECT kind, src AS id, arg_min(cur, depth) AS t
         FROM walk w WHERE (kind, src) NOT IN (SELECT kind, id FROM cycle)
           AND (kind, cur) IN (SELECT kind, id FROM stops)
         GROUP BY kind, src),
names AS (SELECT kind, id, min(name) AS tname FROM (
            SELECT kind, id, name FROM plan UNION ALL
            SELECT kind, into_id AS id, into_name AS name FROM plan WHERE into_id IS NOT NULL) x GROUP BY kind, id),
resolved AS (
  SELECT p.kind, p.id, p.name,
    CASE WHEN p.action = 'merge' AND ((p.kind, p.id) IN (SELECT kind, id FROM cycle)
                                      OR (t.kind, t.t) IN (SELECT kind, id FROM deleted)) THEN 'promote'
         ELSE p.action END AS action,
    CASE WHEN p.action = 'merge' AND NOT ((p.kind, p.id) IN (SELECT kind, id FROM cycle)
                                          OR coalesce((t.kind, t.t) IN (SELECT kind, id FROM deleted), false))
         THEN t.t END AS into_id,
    CASE WHEN p.action = 'merge' AND NOT ((p.kind, p.id) IN (SELECT kind, id FROM cycle)
                                          OR coalesce((t.kind, t.t) IN (SELECT kind, id FROM deleted), false))
         THEN nm.tname END AS into_name
  FROM plan p LEFT JOIN term t ON p.kind = t.kind AND p.id = t.id
  LEFT JOIN names nm ON nm.kind = t.kind AND nm.id = t.t)
"""


def _plan(T):
    best = V.knn_keywords(T.entries.withColumn("is_candidate", F.lit(1)), k=1)
    return C.classify_candidates(best, T.entries, MERGE_AT, DELETE_BELOW)


@register("classify_candidates", _PLAN_SQL + "SELECT * FROM plan")
def classify_candidates(T):
    return _plan(T)


@register("classify_by_clusters")
def classify_by_clusters(T):
    """Verdicts of every candidate from constrained clusters of the neighbour graph."""
    return CL.classify_by_clusters(NG.knn_keywords_descent(T.entries, k=8), T.entries, MERGE_AT, DELETE_BELOW)


@register("resolve_merge_chains", _RESOLVE_SQL + "SELECT * FROM resolved")
def resolve_merge_chains(T):
    return C.resolve_merge_chains(_plan(T))


@register("plan_preview", _RESOLVE_SQL + "SELECT action, count(*) AS n FROM resolved GROUP BY action")
def plan_preview(T):
    return C.plan_preview(C.resolve_merge_chains(_plan(T)))


def _jk(T):
    return T.job_keywords.select("job_id", "id").join(T.entries.select("id", "kind"), "id").select("job_id", "kind", "id")


@register("apply_promote", _RESOLVE_SQL + """
SELECT k.kind, k.id, k.name, CASE WHEN r.action = 'promote' THEN 0 ELSE k.is_candidate END AS is_candidate
FROM b_entries k LEFT JOIN resolved r ON r.kind = k.kind AND r.id = k.id
""")
def apply_promote(T):
    return C.apply_promote(T.entries, C.resolve_merge_chains(_plan(T))).select("kind", "id", "name", "is_candidate")


_MERGED_JK = """,
jk AS (SELECT jk.job_id, k.kind, jk.id FROM b_job_keywords jk JOIN b_entries k ON k.id = jk.id),
mg AS (SELECT kind, id, into_id FROM resolved WHERE action = 'merge'),
new_jk AS (SELECT DISTINCT jk.job_id, jk.kind, coalesce(mg.into_id, jk.id) AS id
           FROM jk LEFT JOIN mg ON mg.kind = jk.kind AND mg.id = jk.id)
"""


@register("apply_merge", _RESOLVE_SQL + _MERGED_JK + "SELECT job_id, kind, id FROM new_jk")
def apply_merge(T):
    _, _, jk = C.apply_merge(T.entries, T.aliases, _jk(T), C.resolve_merge_chains(_plan(T)))
    return jk


@register("apply_delete", _RESOLVE_SQL + """
SELECT kind, id, name FROM b_entries WHERE (kind, id) NOT IN (SELECT kind, id FROM resolved WHERE action = 'delete')
""")
def apply_delete(T):
    kw, _ = C.apply_delete(T.entries, _jk(T), C.resolve_merge_chains(_plan(T)))
    return kw.select("kind", "id", "name")


@register("apply_plan", _RESOLVE_SQL + _MERGED_JK + """
SELECT n.kind, n.id, k.name, CASE WHEN r.action = 'promote' THEN 0 ELSE k.is_candidate END AS is_candidate,
       count(*) AS n_jobs
FROM new_jk n JOIN b_entries k ON k.kind = n.kind AND k.id = n.id
LEFT JOIN resolved r ON r.kind = n.kind AND r.id = n.id
WHERE (n.kind, n.id) NOT IN (SELECT kind, id FROM resolved WHERE action IN ('delete', 'merge'))
GROUP BY n.kind, n.id, k.name, CASE WHEN r.action = 'promote' THEN 0 ELSE k.is_candidate END
""")
def apply_plan(T):
    """Final keyword table with listing counts after the whole plan."""
    kw, al, jk = C.apply_plan(T.entries, T.aliases, _jk(T), _plan(T))
    counts = jk.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n_jobs"))
    return kw.join(counts, ["kind", "id"]).select("kind", "id", "name", "is_candidate", "n_jobs")


@register("parse_review", """
SELECT event_id,
  CASE WHEN starts_with(upper(trim(txt)), 'PROMOTE') THEN 'promote'
       WHEN starts_with(upper(trim(txt)), 'DELETE') THEN 'delete'
       WHEN starts_with(upper(trim(txt)), 'MERGE') AND regexp_extract(upper(trim(txt)), '(\\d+)', 1) <> '' THEN 'merge'
       ELSE 'promote' END AS action,
  CASE WHEN starts_with(upper(trim(txt)), 'PROMOTE') OR starts_with(upper(trim(txt)), 'DELETE') THEN NULL
       WHEN starts_with(upper(trim(txt)), 'MERGE') AND regexp_extract(upper(trim(txt)), '(\\d+)', 1) <> ''
         THEN CAST(regexp_extract(upper(trim(txt)), '(\\d+)', 1) AS BIGINT) END AS target
FROM (SELECT event_id,
        CASE event_type WHEN 'view' THEN 'PROMOTE' WHEN 'click' THEN 'merge into ' || CAST(user_id AS VARCHAR)
             WHEN 'signup' THEN 'Merge it with the other one' WHEN 'error' THEN '  delete: noise'
             ELSE 'not sure' END AS txt FROM events) e
""")
def parse_review(T):
    txt = (F.when(F.col("event_type") == "view", "PROMOTE")
           .when(F.col("event_type") == "click", F.concat(F.lit("merge into "), F.col("user_id").cast("string")))
           .when(F.col("event_type") == "signup", "Merge it with the other one")
           .when(F.col("event_type") == "error", "  delete: noise").otherwise("not sure"))
    return T.events.select("event_id", C.parse_review(txt).alias("v")).select("event_id", "v.action", "v.target")


@register("set_level", """
SELECT k.kind, k.id,
  CASE WHEN k.id % 3 = 0 THEN (CASE k.id % 7 WHEN 0 THEN 'Expert' WHEN 1 THEN NULL WHEN 2 THEN 'Guru'
                                WHEN 3 THEN 'Novice' ELSE k.user_level END)
       ELSE k.user_level END AS user_level_raw
FROM b_keywords k
""")
def set_level(T):
    """Level changes for every third keyword; 'Guru' is rejected, NULL clears."""
    kw = T.keywords
    lvl = (F.when(F.col("id") % 7 == 0, "Expert").when(F.col("id") % 7 == 1, F.lit(None))
           .when(F.col("id") % 7 == 2, "Guru").when(F.col("id") % 7 == 3, "Novice").otherwise(F.col("user_level")))
    changes = kw.where(F.col("id") % 3 == 0).select("kind", "id", lvl.alias("level"))
    out, rejects = C.set_level(kw, changes)
    rej = rejects.select("kind", "id", F.col("level").alias("_bad"))
    # rejected changes keep the old level; report the raw requested value for comparison
    return (out.join(rej, ["kind", "id"], "left")
            .select("kind", "id", F.coalesce("_bad", "user_level").alias("user_level_raw")))
