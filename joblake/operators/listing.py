"""Per-listing transforms: validity, flattening, derived fields, composed texts.

All are row-local native expressions (higher-order array functions, regex,
``when`` chains): no shuffle, whole-stage codegen where Spark supports it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblake.schemas import (ATTENDANCE, BLOCKED_SOURCES, EMPLOYMENT_TYPES, MIN_DESCRIPTION_CHARS,
                             SALARY_PERIODS, SENIORITY)

EMBEDDING_MAX_TOKENS = 384
SEPARATOR_TOKENS = 12
SHORT_TEXT_WORDS = 10


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_listing(mode: str = "equals", min_chars: int = MIN_DESCRIPTION_CHARS) -> Column:
    """Predicate: no blocked source in via / company / title (lowercased
    equality, or substring with ``mode='substring'``) and a description of at
    least ``min_chars`` characters."""
    fields = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("via", "company_name", "title")]
    if mode == "substring":
        blocked = [f.contains(b) for f in fields for b in BLOCKED_SOURCES]
    else:
        blocked = [f.isin(BLOCKED_SOURCES) for f in fields]
    any_blocked = reduce(lambda a, b: a | b, blocked)
    return ~any_blocked & (F.length(F.coalesce(F.col("description"), F.lit(""))) >= min_chars)


def filter_valid_listing(df: DataFrame, mode: str = "equals", min_chars: int = MIN_DESCRIPTION_CHARS) -> DataFrame:
    return df.where(valid_listing(mode, min_chars))


def _section_text(highlights: Column, pred) -> Column:
    texts = F.transform(F.filter(F.coalesce(highlights, F.array()), pred),
                        lambda h: F.array_join(F.coalesce(h["items"], F.array().cast("array<string>")), "\n"))
    return F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(1))


def flatten_highlights(df: DataFrame) -> DataFrame:
    """qualifications / responsibilities from ``job_highlights``: the first
    non-empty section whose lowercased title contains 'qualif' (resp.
    'responsib', and not 'qualif'); an existing non-empty field wins."""
    def title(h):
        return F.lower(F.coalesce(h["title"], F.lit("")))

    qual = _section_text(F.col("job_highlights"), lambda h: title(h).contains("qualif"))
    resp = _section_text(F.col("job_highlights"),
                         lambda h: ~title(h).contains("qualif") & title(h).contains("responsib"))
    existing_q = F.col("qualifications") if "qualifications" in df.columns else F.lit(None).cast("string")
    existing_r = F.col("responsibilities") if "responsibilities" in df.columns else F.lit(None).cast("string")
    return (df.withColumn("qualifications", F.coalesce(F.nullif(existing_q, F.lit("")), qual, F.lit("")))
            .withColumn("responsibilities", F.coalesce(F.nullif(existing_r, F.lit("")), resp, F.lit(""))))


def primary_url(apply_options="apply_options", share_link="share_link") -> Column:
    """First non-empty apply link, else the share link, else ''."""
    links = F.filter(F.transform(F.coalesce(_c(apply_options), F.array()), lambda o: o["link"]),
                     lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.try_element_at(links, F.lit(1)), _c(share_link), F.lit(""))


def parse_posted_at(posted, as_of) -> Column:
    """Relative phrase → date, against the ``as_of`` date. Tests in order:
    today/just/hour/minute → as_of; yesterday → -1; 'N day' → -N;
    'N week' → -7N; 'N month' → -30N; else NULL."""
    p = F.lower(_c(posted))
    d = F.lit(as_of).cast("date") if not isinstance(as_of, Column) else as_of.cast("date")

    def num(unit):
        return F.regexp_extract(p, rf"(\d+)\s+{unit}", 1)

    return (F.when(p.isNull() | (p == ""), F.lit(None).cast("date"))
            .when(p.contains("today") | p.contains("just") | p.contains("hour") | p.contains("minute"), d)
            .when(p.contains("yesterday"), F.date_sub(d, 1))
            .when(num("day") != "", F.date_sub(d, num("day").cast("int")))
            .when(num("week") != "", F.date_sub(d, num("week").cast("int") * 7))
            .when(num("month") != "", F.date_sub(d, num("month").cast("int") * 30))
            .otherwise(F.lit(None).cast("date")))


def clean_extraction(ext) -> Column:
    """Out-of-domain enums → NULL; keyword lists keep non-blank strings; NULL list → []."""
    e = _c(ext)
    empty = F.array().cast("array<string>")

    def enum(field, domain):
        return F.when(e[field].isin(domain), e[field])

    def lst(field):
        return F.filter(F.coalesce(e[field], empty), lambda x: x.isNotNull() & (F.trim(x) != ""))

    return F.when(e.isNull(), F.lit(None)).otherwise(F.struct(
        enum("employment_type", EMPLOYMENT_TYPES).alias("employment_type"),
        enum("attendance", ATTENDANCE).alias("attendance"),
        enum("seniority", SENIORITY).alias("seniority"),
        e["experience_years_min"].alias("experience_years_min"),
        e["experience_years_max"].alias("experience_years_max"),
        e["salary_min"].alias("salary_min"),
        e["salary_max"].alias("salary_max"),
        e["salary_currency"].alias("salary_currency"),
        enum("salary_period", SALARY_PERIODS).alias("salary_period"),
        lst("skills").alias("skills"),
        lst("frameworks").alias("frameworks")))


def compose_job(df: DataFrame, as_of, extraction: str = "extraction") -> DataFrame:
    """Listing record: listing fields + extraction + derived url and date."""
    e = F.col(extraction)
    return df.select(
        "title", "company_name", "location", "description", "qualifications", "responsibilities",
        primary_url().alias("url"),
        parse_posted_at(F.col("detected_extensions.posted_at"), as_of).alias("date_listed"),
        e["employment_type"].alias("employment_type"), e["attendance"].alias("attendance"),
        e["seniority"].alias("seniority"),
        e["experience_years_min"].alias("experience_years_min"),
        e["experience_years_max"].alias("experience_years_max"),
        e["salary_min"].alias("salary_min"), e["salary_max"].alias("salary_max"),
        F.coalesce(e["salary_currency"], F.lit("USD")).alias("salary_currency"),
        e["salary_period"].alias("salary_period"),
        *[c for c in ("dedup_hash", "raw_json", "seq") if c in df.columns])


def _thousands(c: Column) -> Column:
    return F.regexp_replace(F.format_number(c, 0), r"\.0*$", "")


# The labels and separators of the composed texts below are fixed values.


def scoring_text_tier2(profile, jobcol_prefix: str = "", description_chars: int | None = None,
                       qualification_chars: int | None = None) -> Column:
    """Tier-2 prompt body: salary only when min and max are both set.
    ``description_chars`` and ``qualification_chars`` cut the two texts for a
    scorer with an input limit (fixed values of the remote one: 1500 and 800);
    without them the texts are whole."""
    def j(c):
        return F.col(jobcol_prefix + c)

    def cut(c, limit):
        return F.coalesce(j(c), F.lit("")) if limit is None else F.substring(F.coalesce(j(c), F.lit("")), 1, limit)

    truthy = lambda c: c.isNotNull() & (c != 0)
    salary = F.when(truthy(j("salary_min")) & truthy(j("salary_max")), F.concat(
        F.lit("\nSalary: "), F.coalesce(F.nullif(j("salary_currency"), F.lit("")), F.lit("USD")), F.lit(" "),
        _thousands(j("salary_min")), F.lit("–"), _thousands(j("salary_max")), F.lit(" ("),
        F.coalesce(F.nullif(j("salary_period"), F.lit("")), F.lit("yearly")), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("CAREER PROFILE:\n"), F.coalesce(_c(profile), F.lit("")), F.lit("\n\n---\nJOB:\nTitle: "),
        F.coalesce(j("title"), F.lit("")), F.lit("\nCompany: "), F.coalesce(j("company_name"), F.lit("")),
        F.lit("\nLocation: "), F.coalesce(j("location"), F.lit("")), F.lit(" | Attendance: "),
        F.coalesce(F.nullif(j("attendance"), F.lit("")), F.lit("unknown")), F.lit(" | Seniority: "),
        F.coalesce(F.nullif(j("seniority"), F.lit("")), F.lit("unknown")), salary,
        F.lit("\nDescription: "), cut("description", description_chars),
        F.lit("\nQualifications: "), cut("qualifications", qualification_chars))


def scoring_text_tier3(profile) -> Column:
    """Tier-3 prompt body: salary when min is set (max optional), no cuts."""
    truthy = lambda c: c.isNotNull() & (c != 0)
    lo, hi = F.col("salary_min"), F.col("salary_max")
    salary = F.when(truthy(lo), F.concat(
        F.lit("\nSalary: "), F.coalesce(F.nullif(F.col("salary_currency"), F.lit("")), F.lit("USD")), F.lit(" "),
        _thousands(lo), F.when(truthy(hi), F.concat(F.lit("–"), _thousands(hi))).otherwise(F.lit("")),
        F.lit(" ("), F.coalesce(F.nullif(F.col("salary_period"), F.lit("")), F.lit("yearly")), F.lit(")"))
    ).otherwise(F.lit(""))

    def val(c, default):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))

    return F.concat(
        F.lit("=== CAREER PROFILE ===\n"), F.coalesce(_c(profile), F.lit("")), F.lit("\n\n=== JOB LISTING ===\nTitle: "),
        F.coalesce(F.col("title"), F.lit("")), F.lit("\nCompany: "), F.coalesce(F.col("company_name"), F.lit("")),
        F.lit("\nLocation: "), F.coalesce(F.col("location"), F.lit("")),
        F.lit(" | Attendance: "), val("attendance", "unknown"), F.lit(" | Seniority: "), val("seniority", "unknown"),
        F.lit(" | Employment: "), val("employment_type", "unknown"), salary,
        F.lit("\n\nDescription:\n"), F.coalesce(F.col("description"), F.lit("")),
        F.lit("\n\nQualifications:\n"), F.coalesce(F.col("qualifications"), F.lit("")),
        F.lit("\n\nResponsibilities:\n"), F.coalesce(F.col("responsibilities"), F.lit("")))


def extraction_input_text() -> Column:
    """Extraction input: title, company, location, then the non-empty blocks."""
    def block(label, c):
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}:\n"), F.col(c)))

    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Title: "), F.coalesce(F.col("title"), F.lit(""))),
        F.concat(F.lit("Company: "), F.coalesce(F.col("company_name"), F.lit(""))),
        F.concat(F.lit("Location: "), F.coalesce(F.col("location"), F.lit(""))),
        block("Description", "description"), block("Qualifications", "qualifications"),
        block("Responsibilities", "responsibilities"))


def _tokens(c: Column) -> Column:
    """Blank-separated tokens (empty text → no tokens)."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def compose_embedding_text(title="title", qualifications="qualifications",
                           responsibilities="responsibilities", skills="skills",
                           frameworks="frameworks", max_tokens: int | None = None) -> Column:
    """'title | qualifications | responsibilities | skills | frameworks',
    whole, or for an encoder with an input limit within a budget of
    ``max_tokens`` (``EMBEDDING_MAX_TOKENS`` blank-separated tokens): the title is never cut;
    12 tokens are kept for separators; over budget, frameworks are cut first,
    then skills, responsibilities, qualifications."""
    empty = F.array().cast("array<string>")
    t = F.trim(F.coalesce(_c(title), F.lit("")))
    parts = [F.trim(F.coalesce(_c(qualifications), F.lit(""))),
             F.trim(F.coalesce(_c(responsibilities), F.lit(""))),
             F.array_join(F.coalesce(_c(skills), empty), ", "),
             F.array_join(F.coalesce(_c(frameworks), empty), ", ")]
    if max_tokens is None:
        return F.concat_ws(" | ", t, *parts)
    toks = [_tokens(p) for p in parts]
    n = [F.size(x) for x in toks]
    budget = F.lit(max_tokens) - F.size(_tokens(t)) - SEPARATOR_TOKENS
    total = n[0] + n[1] + n[2] + n[3]
    # cut order: frameworks (3), skills (2), responsibilities (1), qualifications (0)
    excess = total - budget
    keep = [None] * 4
    for i in (3, 2, 1, 0):
        cut = F.least(F.greatest(excess, F.lit(0)), n[i])
        keep[i] = n[i] - cut
        excess = excess - cut
    over = total > budget
    out = [F.when(over, F.when(keep[i] <= 0, F.lit("")).otherwise(
        F.array_join(F.slice(toks[i], 1, F.greatest(keep[i], F.lit(1))), " "))).otherwise(parts[i])
        for i in range(4)]
    return F.concat_ws(" | ", t, *out)


def compose_profile_text(target_role="target_role", qualifications="qualifications_summary",
                         experience="experience_summary", skills="skills", frameworks="frameworks",
                         max_tokens: int | None = None) -> Column:
    """The five profile fields joined, whole or cut to ``max_tokens``."""
    empty = F.array().cast("array<string>")
    text = F.concat_ws(" | ", F.trim(F.coalesce(_c(target_role), F.lit(""))),
                       F.trim(F.coalesce(_c(qualifications), F.lit(""))),
                       F.trim(F.coalesce(_c(experience), F.lit(""))),
                       F.array_join(F.coalesce(_c(skills), empty), ", "),
                       F.array_join(F.coalesce(_c(frameworks), empty), ", "))
    if max_tokens is None:
        return text
    toks = _tokens(text)
    return F.when(F.size(toks) > max_tokens, F.array_join(F.slice(toks, 1, max_tokens), " ")).otherwise(text)


def route_by_length(text, limit: int = SHORT_TEXT_WORDS) -> Column:
    """'small' feature space for texts of at most ``limit`` words, else 'large'."""
    return F.when(F.size(_tokens(_c(text))) <= limit, F.lit("small")).otherwise(F.lit("large"))


# --- profile markdown ---------------------------------------------------------
# fixed values: section keys tried in order for each profile field
PROFILE_KEYS = {
    "target_role": ["target", "objective", "role"],
    "qualifications_summary": ["summary", "qualif", "profile"],
    "experience_summary": ["experience", "work", "employ"],
    "skills": ["skill"],
    "frameworks": ["framework", "tool", "technolog"],
}
LIST_SPLIT = r"[,\n•\-\*]+"


def profile_sections(profiles: DataFrame, key: str = "profile_id", text: str = "text") -> DataFrame:
    """Markdown → (key, h, lines, place): headings of levels 1-3 open a section
    (lowercased); a repeated heading starts its section anew, in the first
    one's place; non-blank lines that are not comments are kept, trimmed, and
    joined by blanks. One row per line, the last heading carried on; linear in
    the number of lines."""
    lines = profiles.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\n|\r")).alias("p", "line"))
    head = F.lower(F.trim(F.regexp_extract("line", r"^#{1,3}\s+(.+)", 1)))
    is_head = F.col("line").rlike(r"^#{1,3}\s+.")
    last = F.last(F.when(is_head, F.struct(F.col("p").alias("at"), head.alias("h"))), ignorenulls=True).over(
        Window.partitionBy(key).orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("s", last).where(F.col("s").isNotNull()).select(
        key, F.col("s.h").alias("h"), F.col("s.at").alias("at"), "p", F.trim("line").alias("line"), is_head.alias("head"))
    kept = ~F.col("head") & (F.col("line") != "") & ~F.col("line").startswith("<!--")
    opened = rows.groupBy(key, "h", "at").agg(F.array_sort(F.collect_list(F.when(kept, F.struct("p", "line")))).alias("l"))
    return (opened.groupBy(key, "h").agg(F.min("at").alias("place"), F.max_by("l", "at").alias("l"))
            .select(key, "h", F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("lines"), "place"))


def parse_profile(profiles: DataFrame, key: str = "profile_id", text: str = "text") -> DataFrame:
    """Profile markdown → (key, the five embedding fields). A field is the text
    of the first section whose heading holds one of its keys, the keys tried in
    order; skills and frameworks are split into items."""
    secs = profile_sections(profiles, key, text)
    aggs = []
    for f, keys in PROFILE_KEYS.items():
        rank = F.coalesce(*[F.when(F.col("h").contains(k), F.lit(i)) for i, k in enumerate(keys)])
        aggs.append(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), "place", "lines"))).alias(f"_{f}"))
    found = profiles.select(key).join(secs.groupBy(key).agg(*aggs), key, "left")

    def field(f):
        t = F.coalesce(F.col(f"_{f}.lines"), F.lit(""))
        if f not in ("skills", "frameworks"):
            return t.alias(f)
        return F.filter(F.transform(F.split(t, LIST_SPLIT), lambda x: F.trim(x)), lambda x: x != "").alias(f)

    return found.select(key, *[field(f) for f in PROFILE_KEYS])


def raw_payload(df: DataFrame, col: str = "raw_json") -> DataFrame:
    """Keep the whole source record as JSON text for reprocessing."""
    return df.withColumn(col, F.to_json(F.struct(*[F.col(c) for c in df.columns])))
