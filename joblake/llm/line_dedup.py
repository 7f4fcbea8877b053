"""Operator 5: line de-duplication by winnowing over line hashes.

A line is deleted when it lies in a run of consecutive lines of at least
``min_words`` words in total that also occurs earlier: in an earlier document
(by id) or earlier in the same one. DataFrame functions only.

From each line, a window runs forward over the fewest lines that hold
``min_words`` words, and one runs backward likewise. The smallest line hash of
a window is its fingerprint. Equal windows choose the same fingerprint at the
same offset, so every repeated run of ``min_words`` words is found from a
fingerprint that occurs twice, and windows with a fingerprint that occurs once
are dropped before anything is compared. From a repeated fingerprint the match
is extended both ways over its windows: the hash of the lines on either side of
it, up to the window's ends, must agree as well. Of each group of equal windows
all but the first occurrence are deleted. Forward and backward windows together
cover a repeated run from its first to its last line.

Positions are joined with the *first* occurrence only, found by a grouped
minimum that each task pre-aggregates; no pairs within a group of copies arise.

Lines are ``text`` split at newlines. A line's words are its runs of characters
other than blanks, tabs and the like (``[^\\x20\\x09-\\x0D]+``); lines without words
take no part in windows, and go with a deleted run that they lie in. Null text stays null; empty text has one blank line. Rows with the
same id and text are one document and are cleaned alike; null ids come last in
order. Extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from joblake.session import scratch_table as written


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def _words(line: Column) -> Column:
    """Runs of characters that are no white space. All white space becomes
    blanks; a word is a character that is no blank after one that is."""
    flat = F.concat(F.lit(" "), F.translate(line, "\t\x0b\x0c\r", "    "))
    return F.regexp_count(flat, F.lit(" [^ ]")).cast("long")


def line_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """``(key, null_id, doc_id, first, last, fingerprint, at, ext)`` for every
    full window: its first and last line, the smallest line hash in it, that
    line's position, and the hash of all its lines."""
    line = F.col("line")
    lines = (docs.select(_row_key().alias("key"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
             .select("key", "doc_id", "pos", F.xxhash64(line).alias("h"), _words(line).alias("words")).where("words > 0")
             .repartition("key").dropDuplicates(["key", "pos"]))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    ahead = Window.partitionBy("key").orderBy("before").rangeBetween(0, min_words - 1)
    behind = Window.partitionBy("key").orderBy("upto").rangeBetween(1 - min_words, 0)

    def over(w):
        return F.struct(F.min("pos").over(w).alias("first"), F.max("pos").over(w).alias("last"), F.sum("words").over(w).alias("words"),
                        F.min(F.struct("h", "pos")).over(w).alias("low"), F.xxhash64(F.collect_list("h").over(w)).alias("ext"))

    both = lines.select("key", "doc_id", over(ahead).alias("ahead"), over(behind).alias("behind"))
    return (both.select("key", "doc_id", F.explode(F.array("ahead", "behind")).alias("w"))
            .where(F.col("w.words") >= min_words)
            .select("key", F.col("doc_id").isNull().alias("null_id"), "doc_id", "w.first", "w.last",
                    F.col("w.low.h").alias("fingerprint"), F.col("w.low.pos").alias("at"), "w.ext"))


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``(key, runs)``: per document the line ranges to delete, in order and
    not overlapping."""
    windows = written(line_windows(docs, min_words), "windows")
    places = windows.select("fingerprint", "key", "at").distinct()
    repeated = places.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    near = windows.join(repeated, "fingerprint", "left_semi")
    place = F.struct("null_id", "doc_id", "key", "first")
    lowest = near.groupBy("fingerprint", "ext").agg(F.min(place).alias("lowest"), F.max(place).alias("highest")).where("lowest <> highest").drop("highest")
    later = near.join(lowest, ["fingerprint", "ext"]).where(place > F.col("lowest"))
    # ranges that touch are one: a new one begins where the ones before it have all ended
    by_first = Window.partitionBy("key").orderBy("first", "last")
    reach = F.max("last").over(by_first.rowsBetween(Window.unboundedPreceding, -1))
    ranges = later.groupBy("key", "first").agg(F.max("last").alias("last")).withColumn("new", F.coalesce(F.col("first") > reach + 1, F.lit(True)))
    merged = (ranges.withColumn("g", F.count_if("new").over(by_first.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("key", "g").agg(F.min("first").alias("first"), F.max("last").alias("last")))
    return merged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def drop_repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the later copies of repeated runs cut
    from ``text``, plus ``n_lines``, ``n_removed`` and ``removed_runs``."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed_runs")]
    runs = repeated_runs(docs.select("doc_id", "text"), min_words)
    rows = docs.select(_row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("d")).join(runs, "key", "left")
    rows = rows.withColumn("lines", F.when(F.col("runs").isNotNull(), F.split("d.text", "\n", -1)))
    # the lines before the first run, between runs and after the last one
    kept = F.expr("""array_join(flatten(transform(sequence(0, size(runs)), i -> slice(lines, if(i = 0, 0, runs[i - 1].last + 1) + 1,
        if(i = size(runs), size(lines), runs[i].first) - if(i = 0, 0, runs[i - 1].last + 1)))), '\\n')""")
    removed = F.expr("aggregate(runs, 0, (n, r) -> n + r.last - r.first + 1)")
    return rows.select(*[F.when(F.col("runs").isNull(), F.col("d.text")).otherwise(kept).alias("text") if c == "text" else F.col(f"d.`{c}`") for c in names],
                       F.coalesce(F.size(F.split("d.text", "\n", -1)), F.lit(0)).alias("n_lines"), F.coalesce(removed, F.lit(0)).alias("n_removed"), F.col("runs").alias("removed_runs"))


def oracle(min_words: int, docs: str = "documents") -> str:
    """The same lines in SQL, from whole windows of line texts."""
    return f"""
WITH split AS (SELECT DISTINCT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {docs}),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM split),
lines AS (SELECT * FROM counted WHERE words > 0),
sums AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, text ORDER BY pos) AS upto FROM lines),
wins AS (
  SELECT doc_id, text, min(pos) OVER w AS a, max(pos) OVER w AS b, sum(words) OVER w AS n, list(line) OVER w AS content FROM (SELECT *, upto - words AS before FROM sums)
  WINDOW w AS (PARTITION BY doc_id, text ORDER BY before RANGE BETWEEN CURRENT ROW AND {min_words - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, text, min(pos) OVER w, max(pos) OVER w, sum(words) OVER w, list(line) OVER w FROM sums
  WINDOW w AS (PARTITION BY doc_id, text ORDER BY upto RANGE BETWEEN {min_words - 1} PRECEDING AND CURRENT ROW)),
ranked AS (SELECT doc_id, text, a, b, dense_rank() OVER (PARTITION BY content ORDER BY doc_id NULLS LAST, text, a) AS r FROM wins WHERE n >= {min_words}),
gone AS (SELECT DISTINCT doc_id, text, p FROM (SELECT doc_id, text, unnest(range(a, b + 1)) AS p FROM ranked WHERE r > 1)),
cleaned AS (
  SELECT s.doc_id, s.text AS old, count(*) AS n_lines, count(*) FILTER (WHERE p IS NOT NULL) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE p IS NULL), '') AS text
  FROM split s LEFT JOIN gone g ON s.doc_id IS NOT DISTINCT FROM g.doc_id AND s.text = g.text AND s.pos = g.p GROUP BY s.doc_id, s.text)
SELECT d.doc_id, c.text AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM {docs} d LEFT JOIN cleaned c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.text = c.old"""
