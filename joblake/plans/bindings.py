"""Bindings: the driver's generic tables reshaped into this library's tables.

Each binding is one portable SQL template, valid in Spark and in DuckDB. Table
references are ``{placeholders}``: Spark fills them with DataFrames read from
parquet (``spark.sql(text, orders=df, ...)``), the oracle fills them with the
plain view names and puts the bindings in a ``WITH`` prefix. So the library's
operators and the oracle SQL start from identical rows.

These are fixtures, not operators: the operators under test are the DataFrame
functions applied to them.
"""

from __future__ import annotations

import re
from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# fixed clocks of the fixtures
AS_OF_DATE = "2001-08-01"
AS_OF_EVENTS = "2024-01-31 00:00:00"

_B_JOBS_BASE = """
SELECT o.o_orderkey AS job_id,
       concat(p.p_name, ' ', lower(p.p_type)) AS title,
       c.c_name AS company_name,
       n.n_name AS location,
       CASE c.c_mktsegment WHEN 'BUILDING' THEN 'onsite' WHEN 'MACHINERY' THEN 'onsite'
            WHEN 'HOUSEHOLD' THEN 'remote' WHEN 'FURNITURE' THEN 'hybrid' END AS attendance,
       CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'principal' WHEN '2' THEN 'lead'
            WHEN '3' THEN 'senior' WHEN '4' THEN 'mid' ELSE 'junior' END AS seniority,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'full-time' WHEN 1 THEN 'part-time'
            WHEN 2 THEN 'contract' ELSE 'internship' END AS employment_type,
       CAST(floor(o.o_totalprice / 2) AS INT) AS salary_min,
       CAST(floor(o.o_totalprice) AS INT) AS salary_max,
       'USD' AS salary_currency,
       CASE WHEN o.o_orderkey % 5 = 0 THEN 'hourly' WHEN o.o_orderkey % 7 = 0 THEN NULL
            ELSE 'yearly' END AS salary_period,
       concat('Build ', p.p_name, ' parts for ', lower(c.c_mktsegment), ' clients in ', n.n_name, '. ',
              CAST(o.o_orderkey % 12 AS STRING),
              CASE o.o_orderkey % 3 WHEN 0 THEN '+ years' WHEN 1 THEN concat('–', CAST(o.o_orderkey % 12 + 3 AS STRING), ' years')
                   ELSE ' years' END,
              ' of experience. ',
              CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'Remote' WHEN 'FURNITURE' THEN 'Hybrid' ELSE 'On-site' END, ', ',
              CASE o.o_orderkey % 4 WHEN 0 THEN 'full-time' WHEN 1 THEN 'part-time' WHEN 2 THEN 'contract role' ELSE 'paid internship' END,
              '. Pay $', CAST(CAST(floor(o.o_totalprice / 2) AS BIGINT) AS STRING), '–$',
              CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS STRING),
              CASE WHEN o.o_orderkey % 5 = 0 THEN '/hr' ELSE '/year' END, '.') AS description,
       concat(lower(p.p_type), ' experience') AS qualifications,
       concat('Own the ', p.p_brand, ' line') AS responsibilities,
       concat('https://jobs.example.org/', CAST(o.o_orderkey AS STRING)) AS url,
       CAST(o.o_orderdate AS DATE) AS date_listed,
       CAST(o.o_orderdate AS TIMESTAMP) AS date_ingested,
       CASE WHEN o.o_orderkey % 13 = 0 THEN 'bad_fit'
            WHEN o.o_orderkey % 17 = 0 THEN 'extraction_failed'
            WHEN o.o_orderkey % 19 = 0 THEN 'bad_listing'
            WHEN o.o_orderstatus = 'O' THEN 'active'
            WHEN o.o_orderstatus = 'F' THEN 'expired' ELSE 'applied' END AS status,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
            ELSE CAST((o.o_orderkey * 37) % 101 AS DOUBLE) END AS t2_score,
       CASE WHEN o.o_orderkey % 11 <> 0 THEN concat('scored ', CAST((o.o_orderkey * 37) % 101 AS STRING)) END AS t2_explanation,
       CASE WHEN o.o_orderkey % 3 = 0 THEN NULL
            ELSE CAST(1 + (o.o_orderkey * 7) % 100 AS DOUBLE) END AS t3_qualification,
       CASE WHEN o.o_orderkey % 3 = 0 THEN NULL
            ELSE CAST(1 + (o.o_orderkey * 13) % 100 AS DOUBLE) END AS t3_fit,
       CASE WHEN o.o_orderstatus = 'P' THEN o.o_orderkey * 10 + 1 END AS application_id
FROM (SELECT x.*, 1 + x.o_orderkey % np.n_parts AS pk FROM {orders} x CROSS JOIN (SELECT count(*) AS n_parts FROM {part}) np) o
JOIN {part} p ON p.p_partkey = o.pk
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

# t3_score = match_score(qualification, fit) with beta 0.2, written out in SQL
_B_JOBS = """
SELECT b.*,
       round(round(((CAST(0.8 AS DOUBLE) + CAST(0.2 AS DOUBLE) * b.t3_fit / 100)
              * (b.t3_qualification / 100)) * 100, 10), 1) AS t3_score
FROM {b_jobs_base} b
"""

_B_APPLICATIONS = """
SELECT o.o_orderkey * 10 + k.k AS application_id,
       o.o_orderkey AS job_id,
       CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS date_applied,
       CASE o.o_custkey % 7 WHEN 0 THEN 'submitted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'interviewing'
            WHEN 3 THEN 'offer' WHEN 4 THEN 'withdrawn' WHEN 5 THEN 'submitted' END AS state,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'ai' WHEN 1 THEN 'assisted' WHEN 2 THEN 'human' END AS assistance_level,
       CAST(o.o_orderkey % 3 AS INT) AS cold_calls,
       CAST(o.o_orderkey % 2 AS INT) AS reached_human,
       CAST(o.o_custkey % 4 AS INT) AS interviews,
       CASE WHEN o.o_custkey % 7 = 3 THEN 1 ELSE 0 END AS offer,
       CAST(o.o_custkey % 5 AS DOUBLE) / 2 AS effort
FROM {orders} o
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) k
WHERE o.o_orderstatus = 'P' AND (k.k = 1 OR o.o_orderkey % 4 = 0)
"""

# the keyword dictionary: one entry per distinct part name (a bounded vocabulary)
_B_KEYWORDS = """
SELECT CAST(rn AS BIGINT) AS id,
       CASE WHEN rn % 2 = 0 THEN 'skill' ELSE 'framework' END AS kind,
       p_name AS name,
       split_part(p_name, ' ', 1) AS domain,
       CASE WHEN rn % 5 = 0 THEN 1 ELSE 0 END AS is_candidate,
       CASE rn % 6 WHEN 0 THEN 'Unskilled' WHEN 1 THEN 'Novice' WHEN 2 THEN 'Intermediate'
            WHEN 3 THEN 'Advanced' WHEN 4 THEN 'Expert' END AS user_level
FROM (SELECT p_name, row_number() OVER (ORDER BY p_name) AS rn
      FROM (SELECT DISTINCT p_name FROM {part}) d) r
"""

_B_JOB_KEYWORDS = """
SELECT DISTINCT l.l_orderkey AS job_id, k.kind AS kind, k.id AS id
FROM {lineitem} l
JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN {b_keywords} k ON p.p_name = k.name
"""

_B_MENTIONS = """
SELECT l.l_orderkey AS job_id,
       l.l_linenumber AS pos,
       CASE WHEN l.l_suppkey % 2 = 0 THEN 'skill' ELSE 'framework' END AS tag,
       CASE l.l_partkey % 5 WHEN 0 THEN upper(p.p_name) WHEN 1 THEN concat('  ', p.p_name, ' ')
            WHEN 2 THEN replace(p.p_name, ' ', '-') WHEN 3 THEN concat(p.p_name, ' pro')
            ELSE p.p_name END AS raw_name
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
"""

_B_ALIASES = """
SELECT kind, lower(replace(name, ' ', '-')) AS alias, id
FROM {b_keywords}
"""

_B_LISTINGS = """
SELECT p_partkey AS seq,
       concat(CASE p_partkey % 4 WHEN 0 THEN 'Sr. ' WHEN 1 THEN 'senior ' WHEN 2 THEN 'Jr ' ELSE '' END,
              p_name, ' ', p_type) AS title,
       CASE WHEN p_partkey % 37 = 0 THEN '' WHEN p_partkey % 41 = 0 THEN NULL
            ELSE concat(substr(md5(CAST(CAST(floor(p_partkey / 7) AS BIGINT) AS STRING)), 1, 9),
                        CASE WHEN p_partkey % 2 = 0 THEN ', Inc.' ELSE '' END) END AS company_name,
       CASE p_partkey % 3 WHEN 0 THEN 'EUROPE' WHEN 1 THEN 'ASIA' ELSE NULL END AS location
FROM {part}
"""

# profile markdown blocks: one per conversation turn, a level-1..3 heading
# naming a profile section, then the turn text
_B_PROFILES = """
SELECT conv_id AS profile_id, turn,
       concat(CASE turn % 3 WHEN 0 THEN '# ' WHEN 1 THEN '## ' ELSE '### ' END,
              CASE turn % 6 WHEN 0 THEN 'Target Role' WHEN 1 THEN 'Summary' WHEN 2 THEN 'Work Experience'
                   WHEN 3 THEN 'Skills' WHEN 4 THEN 'Tools and Frameworks' ELSE role END,
              chr(10), text) AS block
FROM {conversations}
"""

# documents as listings: the description is the document text; some rows
# carry a blocked source in via, company or title
_B_DOC_LISTINGS = """
SELECT doc_id AS seq,
       CASE WHEN doc_id % 17 = 0 THEN 'Jobs via Dice'
            ELSE concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2), ' ', split_part(text, ' ', 3)) END AS title,
       CASE WHEN doc_id % 13 = 0 THEN 'BeBee' WHEN doc_id % 31 = 0 THEN ''
            ELSE concat(split_part(text, ' ', 5), ' ', split_part(text, ' ', 7)) END AS company_name,
       CASE WHEN doc_id % 9 = 0 THEN 'Upwork' ELSE concat('via ', source) END AS via,
       lang AS location,
       concat(text, chr(10), 'Works with ', p_name, '.') AS description
FROM (SELECT x.*, 1 + x.doc_id % np.n_parts AS pk FROM {documents} x CROSS JOIN (SELECT count(*) AS n_parts FROM {part}) np) d
JOIN {part} p ON p.p_partkey = d.pk
"""

# relative posting phrases derived from the event log
_B_POSTED = """
SELECT event_id,
       CASE event_type
         WHEN 'view' THEN concat(CAST(CAST(floor(value / 10) AS INT) AS STRING), ' days ago')
         WHEN 'click' THEN concat(CAST(CAST(floor(value / 100) AS INT) AS STRING), ' weeks ago')
         WHEN 'signup' THEN concat(CAST(CAST(floor(value / 100) AS INT) AS STRING), ' months ago')
         WHEN 'error' THEN concat(CAST(CAST(floor(value) AS INT) AS STRING), ' hours ago')
         ELSE CASE WHEN value < 50 THEN 'Just posted' WHEN value < 100 THEN 'Yesterday'
                   WHEN value < 150 THEN '30+ days ago' WHEN value < 200 THEN '' ELSE 'Today' END
       END AS posted_at
FROM {events}
"""

# a larger taxonomy with vectors: the dictionary continued by one term per embedding
_B_ENTRIES = """
SELECT e.vec_id AS id,
       CASE WHEN e.vec_id % 2 = 0 THEN 'skill' ELSE 'framework' END AS kind,
       coalesce(k.name, concat('term ', CAST(e.vec_id AS STRING))) AS name,
       coalesce(k.domain, 'other') AS domain,
       CASE WHEN e.vec_id % 5 = 0 THEN 1 ELSE 0 END AS is_candidate,
       k.user_level AS user_level,
       e.embedding AS vec
FROM {embeddings} e LEFT JOIN {b_keywords} k ON k.id = e.vec_id
"""

BINDINGS: dict[str, str] = {
    "b_jobs_base": _B_JOBS_BASE,
    "b_jobs": _B_JOBS,
    "b_applications": _B_APPLICATIONS,
    "b_keywords": _B_KEYWORDS,
    "b_entries": _B_ENTRIES,
    "b_job_keywords": _B_JOB_KEYWORDS,
    "b_mentions": _B_MENTIONS,
    "b_aliases": _B_ALIASES,
    "b_listings": _B_LISTINGS,
    "b_profile_blocks": _B_PROFILES,
    "b_doc_listings": _B_DOC_LISTINGS,
    "b_posted": _B_POSTED,
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def _deps(name: str) -> list[str]:
    return [d for d in _PLACEHOLDER.findall(BINDINGS[name]) if d in BINDINGS]


def _render_plain(text: str) -> str:
    return _PLACEHOLDER.sub(lambda m: m.group(1), text)


def with_bindings(body: str) -> str:
    """Oracle SQL: the bindings ``body`` mentions, as a WITH prefix, in
    dependency order, then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _deps(n):
            visit(d)
        if n not in order:
            order.append(n)

    for n in BINDINGS:
        if re.search(rf"\b{n}\b", body):
            visit(n)
    body = body.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({_render_plain(BINDINGS[n]).strip()})" for n in order)
    if re.match(r"(?i)with\s", body):  # merge the body's own CTE list
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """Lazy parquet tables of one scale-factor folder plus the bindings on
    them. Nothing is read until an action runs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[name]

    def binding(self, name: str) -> DataFrame:
        if name not in self._frames:
            text = BINDINGS[name]
            args = {}
            for ref in set(_PLACEHOLDER.findall(text)):
                args[ref] = self.binding(ref) if ref in BINDINGS else self.table(ref)
            self._frames[name] = self.spark.sql(text, **args)
        return self._frames[name]

    def spread(self, name: str) -> DataFrame:
        """The binding over documents dealt out by their id: a file of few row
        groups would otherwise be cut into listings by as few tasks."""
        args = {ref: self.binding(ref) if ref in BINDINGS else self.table(ref) for ref in set(_PLACEHOLDER.findall(BINDINGS[name]))}
        return self.spark.sql(BINDINGS[name], **{**args, "documents": self.documents.repartition("doc_id")})

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if f"b_{name}" in BINDINGS:
            return self.binding(f"b_{name}")
        raise AttributeError(name)
