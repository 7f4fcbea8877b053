"""Oracle SQL for queries registered elsewhere whose results SQL can state
directly (file round trips whose content is known, plan round trips)."""

from __future__ import annotations

from joblake.functions.text import normalise_sql
from joblake.plans.bindings import AS_OF_DATE, with_bindings
from joblake.plans.registry import ORACLE

_QUERY = "location || '-' || CAST(CAST(floor(seq / 120) AS BIGINT) AS VARCHAR)"
_PAGES = f"SELECT {_QUERY} AS query, title, company_name, CAST(seq AS VARCHAR) AS job_id FROM b_doc_listings"

ORACLE["scan_pages"] = with_bindings(_PAGES)
ORACLE["union_pages"] = with_bindings(f"SELECT {_QUERY} AS query, CAST(seq AS VARCHAR) AS job_id FROM b_doc_listings")
ORACLE["flatten_highlights"] = with_bindings(
    "SELECT CAST(seq AS VARCHAR) AS job_id, location || chr(10) || via AS qualifications, '' AS responsibilities "
    "FROM b_doc_listings")
ORACLE["primary_url"] = with_bindings(
    "SELECT CAST(seq AS VARCHAR) AS job_id, 'https://apply.example.org/' || CAST(seq AS VARCHAR) AS url FROM b_doc_listings")
_BLOCKED = "('ai salary map', 'mercor', 'upwork', 'synergisticit', 'diversityjobs', 'bebee', 'jobs via dice')"
ORACLE["filter_flatten_url"] = with_bindings(f"""
SELECT CAST(seq AS VARCHAR) AS job_id, location || chr(10) || via AS qualifications, '' AS responsibilities,
       'https://apply.example.org/' || CAST(seq AS VARCHAR) AS url,
       CAST(DATE '{AS_OF_DATE}' - to_days(CAST(seq % 40 AS INTEGER)) AS DATE) AS date_listed
FROM b_doc_listings
WHERE lower(via) NOT IN {_BLOCKED} AND lower(company_name) NOT IN {_BLOCKED} AND lower(title) NOT IN {_BLOCKED}
  AND length(description) >= 1000
""")
ORACLE["scan_aliases"] = with_bindings(
    "SELECT lower(upper(name)) AS alias, CASE WHEN kind = 'skill' AND id % 4 <> 0 THEN id END AS id FROM b_keywords")
ORACLE["parse_deep_score"] = with_bindings("""
SELECT event_id,
  CASE WHEN event_type = 'error' THEN 0 ELSE floor(value) END AS qualification,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(user_id % 100 AS DOUBLE) END AS fit,
  'Qualification:' || chr(10) || CASE WHEN event_type = 'error' THEN '' ELSE event_type END
    || chr(10) || chr(10) || 'Fit:' || chr(10) AS explanation
FROM events
""")
ORACLE["clean_extraction"] = with_bindings("""
SELECT job_id,
  CASE WHEN job_id % 5 = 0 THEN NULL ELSE employment_type END AS employment_type,
  attendance,
  CASE WHEN job_id % 7 = 0 THEN NULL ELSE seniority END AS seniority,
  CAST(NULL AS INTEGER) AS experience_years_min, CAST(NULL AS INTEGER) AS experience_years_max,
  salary_min, salary_max, salary_currency, salary_period,
  list_filter([title], lambda x: trim(x) <> '') AS skills,
  CASE WHEN job_id % 2 = 0 THEN CAST([] AS VARCHAR[]) ELSE list_filter([location], lambda x: trim(x) <> '') END AS frameworks
FROM b_jobs
""")


def attach(classify_sql: str, resolve_sql: str, vector_sql: str) -> None:
    ORACLE["sink_plan"] = classify_sql
    ORACLE["plan_union"] = classify_sql
    ORACLE["scan_plan"] = resolve_sql
    ORACLE["sink_results_json"] = vector_sql


def _extract_sql() -> str:
    from joblake.operators import extract as X

    def ex(p, g):
        return f"regexp_extract(allt, '{p}', {g})"

    def has(col, p):
        return f"regexp_matches({col}, '{p}')"

    def amount(n, k):
        v = f"CAST(replace({n}, ',', '') AS DOUBLE)"
        return (f"CASE WHEN {n} = '' THEN NULL ELSE CAST(trunc(CASE WHEN lower({k}) = 'k' THEN {v} * 1000 "
                f"ELSE {v} END) AS INTEGER) END")

    plus, rlo, rhi, one = ex(X._YEARS_PLUS, 1), ex(X._YEARS_RANGE, 1), ex(X._YEARS_RANGE, 2), ex(X._YEARS_ONE, 1)
    ymin = (f"CAST(CASE WHEN {plus} <> '' THEN {plus} WHEN {rlo} <> '' THEN {rlo} WHEN {one} <> '' THEN {one} END "
            f"AS INTEGER)")
    ymax = f"CAST(CASE WHEN {plus} = '' AND {rhi} <> '' THEN {rhi} END AS INTEGER)"
    lo = amount(ex(X._SALARY, 1), ex(X._SALARY, 2))
    hi = amount(ex(X._SALARY, 3), ex(X._SALARY, 4))
    unit = ex(X._SALARY, 5)
    return f"""
WITH src AS (
  SELECT job_id AS seq, title, description, qualifications FROM b_jobs
  UNION ALL SELECT -1 - seq AS seq, title, description, '' AS qualifications FROM b_doc_listings),
x AS (SELECT seq, lower(coalesce(title, '')) AS t,
             lower(coalesce(title, '')) || chr(10) || lower(coalesce(description, '') || chr(10) || coalesce(qualifications, '')) AS allt
      FROM src),
y AS (SELECT seq, t, allt, {ymin} AS ymin, {ymax} AS ymax, {lo} AS lo, {hi} AS hi, {unit} AS unit FROM x)
SELECT seq,
  CASE WHEN {has('allt', r'\bintern(ship)?\b')} THEN 'internship' WHEN {has('allt', r'\bcontract(or)?\b')} THEN 'contract'
       WHEN {has('allt', r'\bpart[- ]time\b')} THEN 'part-time' WHEN {has('allt', r'\bfull[- ]time\b')} THEN 'full-time'
  END AS employment_type,
  CASE WHEN {has('allt', r'\bhybrid\b')} THEN 'hybrid' WHEN {has('allt', r'\bremote\b')} THEN 'remote'
       WHEN {has('allt', r'\bon[- ]?site\b|\bin[- ]office\b')} THEN 'onsite' END AS attendance,
  coalesce(CASE WHEN {has('t', r'\bprincipal\b')} THEN 'principal' WHEN {has('t', r'\bstaff\b')} THEN 'staff'
                WHEN {has('t', r'\blead\b')} THEN 'lead' WHEN {has('t', r'\b(senior|sr)\b')} THEN 'senior'
                WHEN {has('t', r'\b(junior|jr|entry)\b')} THEN 'junior' WHEN {has('t', r'\bmid\b')} THEN 'mid' END,
           CASE WHEN ymin IS NULL THEN NULL WHEN ymin < 2 THEN 'junior' WHEN ymin < 5 THEN 'mid' ELSE 'senior' END)
    AS seniority,
  ymin AS experience_years_min, ymax AS experience_years_max, lo AS salary_min, hi AS salary_max,
  CASE WHEN lo IS NOT NULL THEN 'USD' END AS salary_currency,
  CASE WHEN unit IN ('hour', 'hr', 'hourly') THEN 'hourly' WHEN unit IN ('month', 'mo') THEN 'monthly'
       WHEN unit <> '' THEN 'yearly' WHEN lo IS NULL THEN NULL WHEN hi < 1000 THEN 'hourly' ELSE 'yearly' END
    AS salary_period,
  CAST([] AS VARCHAR[]) AS skills, CAST([] AS VARCHAR[]) AS frameworks
FROM y
"""


ORACLE["extract_fields"] = with_bindings(_extract_sql())

_SAL3 = """CASE WHEN coalesce(salary_min, 0) <> 0
  THEN chr(10) || 'Salary: ' || coalesce(nullif(salary_currency, ''), 'USD') || ' ' || format('{:,}', salary_min)
       || CASE WHEN coalesce(salary_max, 0) <> 0 THEN '–' || format('{:,}', salary_max) ELSE '' END
       || ' (' || coalesce(nullif(salary_period, ''), 'yearly') || ')' ELSE '' END"""
ORACLE["compose_tier3_text"] = with_bindings(f"""
SELECT job_id,
  '=== CAREER PROFILE ===' || chr(10) || coalesce(location, '') || chr(10) || chr(10) || '=== JOB LISTING ===' || chr(10)
  || 'Title: ' || coalesce(title, '') || chr(10) || 'Company: ' || coalesce(company_name, '') || chr(10)
  || 'Location: ' || coalesce(location, '') || ' | Attendance: ' || coalesce(nullif(attendance, ''), 'unknown')
  || ' | Seniority: ' || coalesce(nullif(seniority, ''), 'unknown')
  || ' | Employment: ' || coalesce(nullif(employment_type, ''), 'unknown') || {_SAL3} || chr(10) || chr(10)
  || 'Description:' || chr(10) || coalesce(description, '') || chr(10) || chr(10)
  || 'Qualifications:' || chr(10) || coalesce(qualifications, '') || chr(10) || chr(10)
  || 'Responsibilities:' || chr(10) || coalesce(responsibilities, '') AS tier3_text
FROM b_jobs
""")

# tier-2 and tier-3 rule scores over the (profile, listing) pairs of q_jobs._pairs
def _sr(c):
    return (f"CASE {c} WHEN 'junior' THEN 0 WHEN 'mid' THEN 1 WHEN 'senior' THEN 2 WHEN 'lead' THEN 3 "
            f"WHEN 'staff' THEN 4 WHEN 'principal' THEN 5 END")


_PAIRS = f"""
WITH names AS (
  SELECT jk.job_id, list_distinct(list(k.name)) AS job_keywords
  FROM b_job_keywords jk JOIN b_keywords k ON jk.id = k.id GROUP BY jk.job_id),
prof AS (
  SELECT c.conv_id AS profile_id, n.job_keywords AS profile_keywords
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN names n ON n.job_id = c.conv_id),
pairs AS (
  SELECT p.profile_id, j.job_id, j.attendance, j.seniority, j.salary_max, n.job_keywords, p.profile_keywords,
         'remote' AS pref_attendance, 'senior' AS pref_seniority, 200000 AS pref_salary
  FROM b_jobs j JOIN names n ON n.job_id = j.job_id JOIN prof p ON p.profile_id = j.job_id % (SELECT count(DISTINCT conv_id) FROM conversations)),
parts AS (
  SELECT *,
    list_distinct(list_transform(coalesce(job_keywords, []), lambda x: lower(x))) AS req,
    list_transform(coalesce(profile_keywords, []), lambda x: lower(x)) AS offered,
    CASE WHEN pref_attendance IS NULL OR attendance IS NULL THEN NULL
         WHEN pref_attendance = attendance THEN 1.0 ELSE 0.0 END AS att,
    CASE WHEN ({_sr('pref_seniority')}) IS NULL OR ({_sr('seniority')}) IS NULL THEN NULL
         WHEN abs(({_sr('pref_seniority')}) - ({_sr('seniority')})) <= 1 THEN 1.0 ELSE 0.0 END AS sen,
    CASE WHEN pref_salary IS NULL OR salary_max IS NULL THEN NULL
         WHEN salary_max >= pref_salary THEN 1.0 ELSE 0.0 END AS sal
  FROM pairs),
scored AS (
  SELECT profile_id, job_id,
    coalesce(CASE WHEN len(req) = 0 THEN NULL
                  ELSE len(list_filter(req, lambda x: list_contains(offered, x))) / len(req) END, 0.0) AS cov,
    coalesce(CASE WHEN (att IS NOT NULL)::INT + (sen IS NOT NULL)::INT + (sal IS NOT NULL)::INT = 0 THEN NULL
                  ELSE (coalesce(att, 0.0) + coalesce(sen, 0.0) + coalesce(sal, 0.0))
                       / ((att IS NOT NULL)::INT + (sen IS NOT NULL)::INT + (sal IS NOT NULL)::INT) END, 0.5) AS agr
  FROM parts)
"""
ORACLE["score_tier3"] = with_bindings(_PAIRS + """
SELECT profile_id, job_id, round(cov * 100) AS t3_qualification, round(agr * 100) AS t3_fit,
  round(round(((CAST(0.8 AS DOUBLE) + CAST(0.2 AS DOUBLE) * round(agr * 100) / 100) * (round(cov * 100) / 100)) * 100, 10), 1)
    AS t3_score
FROM scored""")
ORACLE["score_tier2"] = with_bindings(_PAIRS + """
SELECT profile_id, job_id, CAST(round(60 * cov + 40 * agr) AS DOUBLE) AS t2_score,
  'keywords ' || CAST(CAST(floor(cov * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%; preferences '
    || CAST(CAST(floor(agr * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS t2_explanation
FROM scored""")
ORACLE["rescore"] = with_bindings(_PAIRS + """
SELECT job_id, profile_id,
  round(round(((CAST(0.8 AS DOUBLE) + CAST(0.2 AS DOUBLE) * round(agr * 100) / 100) * (round(cov * 100) / 100)) * 100, 10), 1)
    AS t3_score
FROM scored
WHERE job_id IN (SELECT job_id FROM b_jobs WHERE t3_score IS NOT NULL AND status IN ('active', 'expired'))""")


def _embedding_text_sql() -> str:
    from joblake.operators.listing import EMBEDDING_MAX_TOKENS, SEPARATOR_TOKENS

    def toks(x):
        return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '\\s+'), lambda w: w <> '')"

    parts = ["trim(coalesce(qualifications, ''))", "trim(coalesce(responsibilities, ''))",
             "coalesce(array_to_string(skills, ', '), '')", "coalesce(array_to_string(frameworks, ', '), '')"]
    budget = f"({EMBEDDING_MAX_TOKENS} - len({toks('t')}) - {SEPARATOR_TOKENS})"
    total = "(n0 + n1 + n2 + n3)"
    cur = f"""SELECT *, {', '.join(f'len({toks(f"p{i}")}) AS n{i}' for i in range(4))} FROM (
  SELECT doc_id AS job_id, trim(coalesce(source, '')) AS t, {', '.join(f'{p} AS p{i}' for i, p in enumerate(parts))}
  FROM (SELECT doc_id, source, text AS qualifications, lang AS responsibilities,
               string_split(source, 'c') AS skills, [lang] AS frameworks FROM documents))"""
    # cut order frameworks, skills, responsibilities, qualifications: one projection level per cut
    done: list[int] = []
    for i in (3, 2, 1, 0):
        rest = "".join(f" - c{j}" for j in done)
        cur = f"SELECT *, least(greatest({total} - {budget}{rest}, 0), n{i}) AS c{i} FROM ({cur})"
        done.append(i)
    outs = [f"CASE WHEN {total} > {budget} THEN CASE WHEN n{i} - c{i} <= 0 THEN '' "
            f"ELSE array_to_string(list_slice({toks(f'p{i}')}, 1, greatest(n{i} - c{i}, 1)), ' ') END "
            f"ELSE p{i} END" for i in range(4)]
    return f"SELECT job_id, concat_ws(' | ', t, {', '.join(outs)}) AS text FROM ({cur})"


ORACLE["compose_embedding_text"] = with_bindings(_embedding_text_sql())

_PAGE_NO = "CAST(floor(seq / 10) AS BIGINT) % 12 + 1"
# a query stops at its first failed page (7), if it has that page, and after ten pages
ORACLE["scan_landing"] = with_bindings(f"""
WITH l AS (SELECT {_QUERY} AS query, title, CAST(seq AS VARCHAR) AS job_id, {_PAGE_NO} AS page_no FROM b_doc_listings),
f AS (SELECT DISTINCT query FROM l WHERE page_no = 7)
SELECT l.query, title, job_id FROM l LEFT JOIN f ON l.query = f.query WHERE page_no <= CASE WHEN f.query IS NULL THEN 10 ELSE 6 END
""")

_EXTRACTED = ["employment_type", "attendance", "seniority", "experience_years_min", "experience_years_max", "salary_min", "salary_max"]
_DOC_QUAL = "location || chr(10) || via"


def _doc_extract() -> str:
    """Field extraction over the landed documents, whose qualifications come
    from the highlights."""
    return (_extract_sql().replace("""SELECT job_id AS seq, title, description, qualifications FROM b_jobs
  UNION ALL SELECT -1 - seq AS seq, title, description, '' AS qualifications FROM b_doc_listings""",
                                   f"SELECT seq, title, description, {_DOC_QUAL} AS qualifications FROM b_doc_listings"))


ORACLE["compose_job"] = with_bindings(f"""
WITH e AS ({_doc_extract()})
SELECT title, company_name, location, description, {_DOC_QUAL} AS qualifications, '' AS responsibilities,
       'https://apply.example.org/' || CAST(d.seq AS VARCHAR) AS url,
       CAST(DATE '{AS_OF_DATE}' - to_days(CAST(d.seq % 40 AS INTEGER)) AS DATE) AS date_listed,
       {', '.join(f'e.{c}' for c in _EXTRACTED)}, coalesce(e.salary_currency, 'USD') AS salary_currency, e.salary_period
FROM b_doc_listings d JOIN e ON e.seq = d.seq
""")
ORACLE["report_dry_run"] = with_bindings(f"""
SELECT {_QUERY} AS query, title, company_name, location, 'https://apply.example.org/' || CAST(seq AS VARCHAR) AS url,
       CASE WHEN length(description) >= 1000 THEN 'OK' ELSE 'FAILED' END AS status
FROM b_doc_listings
""")
_DOC_HASH = (f"sha256({normalise_sql('title')} || '|' || {normalise_sql('company_name')} || '|' || {normalise_sql('location')})")
ORACLE["sink_jobs"] = with_bindings(f"""
SELECT min(seq) AS seq, h AS dedup_hash FROM (SELECT seq, {_DOC_HASH} AS h FROM b_doc_listings) d
WHERE h NOT IN (SELECT {_DOC_HASH} FROM b_jobs) GROUP BY h
""")
ORACLE["sink_failed"] = with_bindings(f"""
SELECT seq, {_DOC_HASH} AS dedup_hash, '(extraction failed)' AS title, '' AS url, '' AS company_name, 'extraction_failed' AS status
FROM b_doc_listings WHERE length(description) < 1000
""")
ORACLE["batch_score"] = with_bindings(_PAIRS + """
SELECT profile_id, job_id,
       CASE WHEN job_id % 100 = 7 THEN NULL
            ELSE least(100.0, 10.0 * len(list_filter(job_keywords, lambda x: list_contains(coalesce(profile_keywords, []), x)))) END AS t2_score,
       CASE WHEN job_id % 100 = 7 THEN 'scoring failed: no reply' ELSE 'shared keywords x10' END AS t2_explanation
FROM pairs""")
ORACLE["raw_payload"] = with_bindings("SELECT count(*) AS n, count(*) AS n_same FROM b_jobs")

_FIELDS = {"target_role": ["target", "objective", "role"], "qualifications_summary": ["summary", "qualif", "profile"],
           "experience_summary": ["experience", "work", "employ"], "skills": ["skill"], "frameworks": ["framework", "tool", "technolog"]}


def _profile_sql() -> str:
    """The profile fields from the blocks, line by line."""
    def rank(keys):
        return "CASE " + " ".join(f"WHEN contains(h, '{k}') THEN {i}" for i, k in enumerate(keys)) + " END"

    fields = ", ".join(f"arg_min(body, {rank(k)} * 100000000 + place) FILTER (WHERE {rank(k)} IS NOT NULL) AS {f}" for f, k in _FIELDS.items())
    items = r"list_filter(list_transform(regexp_split_to_array(coalesce({}, ''), '[,\n•\-\*]+'), lambda x: trim(x)), lambda x: x <> '')"
    out = ", ".join(f"{items.format(f)} AS {f}" if f in ("skills", "frameworks") else f"coalesce({f}, '') AS {f}" for f in _FIELDS)
    return rf"""
WITH texts AS (SELECT profile_id, string_agg(block, chr(10) ORDER BY turn) AS text FROM b_profile_blocks GROUP BY profile_id),
lines AS (SELECT profile_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|\n|\r'), 1) AS p FROM texts),
marked AS (SELECT *, regexp_matches(line, '^#{{1,3}}\s+.') AS head,
                  max(CASE WHEN regexp_matches(line, '^#{{1,3}}\s+.') THEN p END) OVER (PARTITION BY profile_id ORDER BY p) AS opened_at FROM lines),
heads AS (SELECT profile_id, p AS opened_at, lower(trim(regexp_extract(line, '^#{{1,3}}\s+(.+)', 1))) AS h FROM marked WHERE head),
opened AS (SELECT h.profile_id, h.h, h.opened_at,
                  coalesce(string_agg(trim(m.line), ' ' ORDER BY m.p) FILTER (WHERE NOT m.head AND trim(m.line) <> '' AND NOT starts_with(trim(m.line), '<!--')), '') AS body
           FROM heads h JOIN marked m ON m.profile_id = h.profile_id AND m.opened_at = h.opened_at GROUP BY h.profile_id, h.h, h.opened_at),
secs AS (SELECT profile_id, h, min(opened_at) AS place, arg_max(body, opened_at) AS body FROM opened GROUP BY profile_id, h),
found AS (SELECT t.profile_id, {fields} FROM texts t LEFT JOIN secs s ON s.profile_id = t.profile_id GROUP BY t.profile_id)
SELECT profile_id, {out} FROM found"""


ORACLE["profile_sections"] = with_bindings(_profile_sql())
ORACLE["compose_profile_text"] = with_bindings(f"""
SELECT profile_id, concat_ws(' | ', trim(target_role), trim(qualifications_summary), trim(experience_summary),
       coalesce(array_to_string(skills, ', '), ''), coalesce(array_to_string(frameworks, ', '), '')) AS text
FROM ({with_bindings(_profile_sql())}) p""")
ORACLE["scan_taxonomy"] = with_bindings("""
WITH old AS (SELECT id, kind, name, domain, NULL AS l2, is_candidate, user_level FROM b_keywords WHERE id % 2 = 0),
new AS (SELECT row_number() OVER (ORDER BY name) + (SELECT max(id) FROM old) AS id, 'skill' AS kind, name, domain,
               CASE WHEN id % 3 <> 0 THEN domain END AS l2, 0 AS is_candidate, NULL AS user_level FROM b_keywords WHERE id % 2 = 1)
SELECT * FROM old UNION ALL SELECT * FROM new""")
