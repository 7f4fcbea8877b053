"""Keyword resolution queries (mentions binding) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblake.operators import keywords as K
from joblake.plans.registry import register

_J = """
WITH m AS (
  SELECT job_id, pos, tag, CASE WHEN tag = 'skill' THEN 0 ELSE 1 END AS tag_order, raw_name,
         lower(trim(raw_name)) AS key
  FROM b_mentions WHERE lower(trim(raw_name)) <> ''),
dict AS (SELECT lower(alias) AS key, kind, id, 0 AS prio FROM b_aliases
         UNION ALL SELECT lower(name) AS key, kind, id, 1 AS prio FROM b_keywords),
best AS (SELECT key, kind, arg_min(id, prio) AS id FROM dict GROUP BY key, kind),
bk AS (SELECT key, max(id) FILTER (WHERE kind = 'skill') AS skill_id,
              max(id) FILTER (WHERE kind = 'framework') AS framework_id FROM best GROUP BY key),
j AS (SELECT m.*, CASE WHEN tag = 'skill' THEN bk.framework_id ELSE bk.skill_id END AS other_id,
             CASE WHEN tag = 'skill' THEN bk.skill_id ELSE bk.framework_id END AS own_id
      FROM m LEFT JOIN bk ON m.key = bk.key),
cands AS (
  SELECT key, tag AS kind, trim(raw_name) AS name,
         (SELECT max(id) FROM b_keywords) + row_number() OVER (ORDER BY job_id, tag_order, pos, raw_name, key) AS id
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY job_id, tag_order, pos, raw_name) AS rn
        FROM j WHERE other_id IS NULL AND own_id IS NULL) f
  WHERE rn = 1),
resolved AS (
  SELECT j.job_id, j.pos, j.tag, j.tag_order, j.raw_name,
         coalesce(CASE WHEN other_id IS NOT NULL THEN CASE WHEN tag = 'skill' THEN 'framework' ELSE 'skill' END
                       WHEN own_id IS NOT NULL THEN tag END, c.kind) AS kind,
         coalesce(other_id, own_id, c.id) AS id
  FROM j LEFT JOIN cands c ON j.key = c.key)
"""

_J_SINGLE = """
WITH m AS (
  SELECT job_id, pos, tag, CASE WHEN tag = 'skill' THEN 0 ELSE 1 END AS tag_order, raw_name,
         lower(trim(raw_name)) AS key
  FROM b_mentions WHERE lower(trim(raw_name)) <> ''),
dict AS (SELECT lower(alias) AS key, kind, id, 0 AS prio FROM b_aliases
         UNION ALL SELECT lower(name) AS key, kind, id, 1 AS prio FROM b_keywords),
best AS (SELECT key, kind, arg_min(id, prio) AS id FROM dict GROUP BY key, kind),
j AS (SELECT m.*, b.id AS own_id FROM m LEFT JOIN best b ON m.key = b.key AND m.tag = b.kind),
cands AS (
  SELECT key, tag AS kind, trim(raw_name) AS name,
         (SELECT max(id) FROM b_keywords) + row_number() OVER (ORDER BY job_id, tag_order, pos, raw_name, key) AS id
  FROM (SELECT *, row_number() OVER (PARTITION BY key, tag ORDER BY job_id, tag_order, pos, raw_name) AS rn
        FROM j WHERE own_id IS NULL) f
  WHERE rn = 1)
"""


def _route(T, cross=True):
    return K.route_keywords(T.mentions, T.keywords, T.aliases, cross_kind=cross)


@register("route_keywords", _J + "SELECT job_id, pos, tag, kind, id FROM resolved")
def route_keywords(T):
    return _route(T)[0].select("job_id", "pos", "tag", "kind", "id")


@register("new_candidate_ids", _J + "SELECT key, kind, id, name FROM cands")
def new_candidate_ids(T):
    return _route(T)[1]


@register("resolve_keywords", _J_SINGLE + """
SELECT j.job_id, j.pos, j.tag, j.tag AS kind, coalesce(own_id, c.id) AS id
FROM j LEFT JOIN cands c ON j.key = c.key AND j.tag = c.kind
""")
def resolve_keywords(T):
    return K.resolve_keywords(T.mentions, T.keywords, T.aliases)[0].select("job_id", "pos", "tag", "kind", "id")


_DISTINCT = _J + """,
firsts AS (SELECT job_id, kind, id, min({'t': tag_order, 'p': pos, 'r': raw_name}) AS o FROM resolved GROUP BY job_id, kind, id)
"""


@register("distinct_keywords", _DISTINCT + "SELECT job_id, kind, list(id ORDER BY o) AS ids FROM firsts GROUP BY job_id, kind")
def distinct_keywords(T):
    return K.distinct_keywords(_route(T)[0])


@register("ids_to_names", _DISTINCT + """,
names AS (SELECT kind, id, lower(name) AS lname FROM b_keywords)
SELECT f.job_id, f.kind, list(coalesce(n.lname, CAST(f.id AS VARCHAR)) ORDER BY f.o) AS names
FROM firsts f LEFT JOIN names n ON f.kind = n.kind AND f.id = n.id
GROUP BY f.job_id, f.kind
""")
def ids_to_names(T):
    return K.ids_to_names(K.distinct_keywords(_route(T)[0]), T.keywords)


@register("extract_keywords", """
WITH dict AS (SELECT lower(alias) AS key, kind, id, 0 AS prio FROM b_aliases
              UNION ALL SELECT lower(name) AS key, kind, id, 1 AS prio FROM b_keywords),
best0 AS (SELECT key, kind, arg_min(id, prio) AS id FROM dict GROUP BY key, kind),
best AS (SELECT array_to_string(list_filter(regexp_split_to_array(key, '[^\\p{L}\\p{N}#+]+'), lambda x: x <> ''), ' ') AS key,
                kind, id FROM best0),
toks AS (SELECT job_id, list_filter(regexp_split_to_array(lower(description), '[^\\p{L}\\p{N}#+]+'), lambda x: x <> '') AS t
         FROM b_jobs),
pos AS (SELECT job_id, t, generate_subscripts(t, 1) - 1 AS i FROM toks),
grams AS (
  SELECT job_id, i, 1 AS n, t[i + 1] AS key FROM pos
  UNION ALL
  SELECT job_id, i, 2 AS n, t[i + 1] || ' ' || t[i + 2] AS key FROM pos WHERE i + 2 <= len(t)),
hits AS (SELECT g.job_id, g.i, g.n, b.kind, b.id FROM grams g JOIN best b ON g.key = b.key),
cover AS (SELECT job_id, p, max(n) AS best FROM (SELECT job_id, n, unnest(range(i, i + n)) AS p FROM hits) x GROUP BY job_id, p),
chk AS (SELECT h.job_id, h.i, h.n, h.kind, h.id, max(c.best) AS best
        FROM (SELECT *, unnest(range(i, i + n)) AS p FROM hits) h JOIN cover c ON h.job_id = c.job_id AND h.p = c.p
        GROUP BY h.job_id, h.i, h.n, h.kind, h.id)
SELECT job_id, kind, id, min(i) AS first_pos FROM chk WHERE best = n GROUP BY job_id, kind, id
""")
def extract_keywords(T):
    return K.extract_keywords(T.jobs.select("job_id", F.col("description").alias("text")), T.keywords, T.aliases)
