"""Duplicate detection: exact hash, first-seen in batch, similar companies,
fuzzy titles, and the arrival-order greedy keep.

Nothing here forms all pairs of a group. Similar companies come from an
equi-join on trigrams restricted to each name's *prefix* (its rarest grams
under one global order), which provably contains every pair reaching the
Jaccard threshold; similar titles come from the same idea on character
bigrams with an overlap bound derived from the ratio threshold. Only the
surviving candidates are scored exactly.
"""

from __future__ import annotations

import math
import time as _time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblake.functions.text import dedup_hash, normalise_text, token_sort_ratio, trigrams
from joblake.operators.graph import components
from joblake.session import scratch_table

FUZZY_THRESHOLD = 85
TRIGRAM_THRESHOLD = 0.3


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("dedup_hash", dedup_hash("title", "company_name", "location"))


def dedup_exact(incoming: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fresh, duplicates): incoming rows whose hash is already stored are
    duplicates with reason 'exact_hash'. One join with the store's hashes
    serves both."""
    known = stored.select("dedup_hash").distinct().withColumn("_stored", F.lit(True))
    flagged = incoming.join(known, "dedup_hash", "left")
    fresh = flagged.where(F.col("_stored").isNull()).drop("_stored")
    dups = flagged.where(F.col("_stored")).drop("_stored").withColumn("reason", F.lit("exact_hash"))
    return fresh, dups


def first_seen_in_batch(df: DataFrame, key: str = "dedup_hash", order: str = "seq") -> DataFrame:
    """First row (smallest ``order``) per key. A grouped min over a struct led
    by the order column: partial aggregation map-side, so a key holding a
    third of the rows is reduced in every task before the shuffle."""
    rest = [c for c in df.columns if c not in (key, order)]
    return (df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_m"))
            .select(key, "_m.*").select(*df.columns))


# --- prefix filtering ---------------------------------------------------------

def _prefix_tokens(items: DataFrame, id_col: str, tokens_col: str, prefix_len: Column) -> DataFrame:
    """(id, token) for the ``prefix_len`` rarest tokens of each item, rarity
    by a global token count (ties by token text)."""
    exploded = items.select(id_col, F.explode(tokens_col).alias("tok"))
    freq = exploded.groupBy("tok").agg(F.count(F.lit(1)).alias("freq"))
    ranked = (exploded.join(freq, "tok")
              .groupBy(id_col)
              .agg(F.array_sort(F.collect_list(F.struct("freq", "tok"))).alias("_sorted")))
    return (ranked.join(items.select(id_col, prefix_len.alias("_plen")), id_col)
            .select(id_col, F.explode(F.slice("_sorted", 1, F.greatest(F.col("_plen"), F.lit(1)))).alias("_t"))
            .select(id_col, F.col("_t.tok").alias("tok")))


def _gram_number(gram: Column) -> Column:
    """A gram of three characters as one number: its code points, 21 bits each."""
    a, b, c = (F.ascii(F.substring(gram, i, 1)).cast("long") for i in (1, 2, 3))
    return F.shiftleft(a, 42) + F.shiftleft(b, 21) + c


def _has_gram(name: str) -> Column:
    """Whether a name has a trigram: it has one if it has a letter or digit."""
    return F.lower(F.coalesce(F.col(name), F.lit(""))).rlike(r"[\p{L}\p{N}]")


def similar_company(names: DataFrame, threshold: float = TRIGRAM_THRESHOLD, col: str = "company_name",
                    left: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of different names with trigram similarity >= threshold
    (every name with a gram is similar to itself; those pairs are left out).
    With ``left``, at least one of the two is among its names. Exact: names of
    x and y grams reach the threshold only with ``least(x, y)`` common grams,
    so under one global gram order their first common gram leaves that many
    in each of them. A name is therefore dealt by (gram, own size, partner's
    size) for its leading grams only, and carries its grams: a pair is scored
    where it meets at its first common gram, and no candidate is written."""
    comp = names.select(F.col(col).alias("name")).where(F.col("name").isNotNull()).distinct()
    if left is None:
        comp = comp.withColumn("lead", F.lit(True))
    else:  # only the names of left look for partners; the others never meet each other
        ours = left.select(F.col(col).alias("name")).where(F.col("name").isNotNull()).distinct().withColumn("lead", F.lit(True))
        comp = comp.join(ours, "name", "left").fillna({"lead": False})
    comp = scratch_table(comp.where(_has_gram("name")).withColumn("grams", F.transform(trigrams("name"), _gram_number)), "names")
    exploded = comp.select("name", "lead", F.explode("grams").alias("tok"))
    # rare on both sides first; what no leading name has comes before all others and is not dealt
    freq = exploded.groupBy("tok").agg((F.count(F.lit(1)) * F.count_if("lead")).alias("freq"))
    ordered = (exploded.join(freq, "tok").groupBy("name", "lead")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("freq", "tok"))), lambda t: t["tok"]).alias("grams"),
                    F.count_if(F.col("freq") == 0).cast("int").alias("idle"))
               .withColumn("n", F.size("grams")))
    ordered = scratch_table(ordered, "name-grams")
    sizes = ordered.select(F.col("n").alias("m")).distinct()
    # rounding down a little only lets more pairs meet; the score decides
    need = F.greatest(F.lit(1), F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("m")) - F.lit(1e-6)).cast("int"))
    dealt = (ordered.join(F.broadcast(sizes), F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m") - F.lit(1e-6))
             .withColumn("need", need).withColumn("tok", F.explode(F.slice("grams", F.col("idle") + 1, F.greatest(F.col("n") - F.col("need") + 1 - F.col("idle"), F.lit(0))))))
    x, y = dealt.where("lead").alias("x"), dealt.alias("y")
    common = F.array_intersect("x.grams", "y.grams")
    shared = F.size(common)
    sim = shared / (F.col("x.n") + F.col("y.n") - shared)
    met = x.join(y, F.expr("x.tok = y.tok and x.n = y.m and x.m = y.n and x.name <> y.name and (x.name < y.name or not y.lead)")
                 & (shared >= F.col("x.need")) & (F.element_at(common, 1) == F.col("x.tok")) & (sim >= F.lit(threshold)))
    return met.select(F.least("x.name", "y.name").alias("a"), F.greatest("x.name", "y.name").alias("b"), sim.alias("similarity"))


def sort_key(title) -> Column:
    """Token-sort form of a normalised title: all but letters and digits (of
    any script) to blanks, lowercase, tokens sorted, joined by one blank."""
    t = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N}]", " "))
    return F.array_join(F.array_sort(F.filter(F.split(t, " "), lambda x: x != "")), " ")


def _bigram_tokens(s: Column) -> Column:
    """Bigrams of '\\x02' + s + '\\x03', each tagged with its occurrence number,
    so that multiset overlap becomes set overlap."""
    p = F.concat(F.lit("\x02"), s, F.lit("\x03"))
    grams = F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, 2))
    return F.transform(grams, lambda g, i: F.concat(
        g, F.lit("#"), F.size(F.filter(F.slice(grams, 1, i + 1), lambda h: h == g)).cast("string")))


def _lcs_min(total: Column, threshold: int) -> Column:
    """Smallest LCS with round(200 * LCS / total) >= threshold (half-even
    rounding needs 200 * LCS / total >= threshold - 0.5)."""
    return F.floor(((2 * threshold - 1) * total + 399) / 400)


def _need(la: Column, lb: Column, threshold: int) -> Column:
    """Bigram tokens two titles of lengths la, lb must share to reach the
    threshold: each indel removes at most two bigrams of the padded string,
    so shared >= max(la, lb) + 1 - 2d with d = la + lb - 2 * LCS_min; NULL
    when no LCS that large fits (the pair cannot reach the threshold)."""
    m = _lcs_min(la + lb, threshold)
    d = la + lb - 2 * m
    return F.when(m <= F.least(la, lb), F.greatest(la, lb) + 1 - 2 * d)


def _length_bounds(threshold: int) -> float:
    s = (threshold - 0.5) / 100.0
    return s / (2 - s)  # a partner is at least r times and at most 1/r times as long


def _title_prefix_len(length: Column, threshold: int) -> Column:
    """Prefix size per title: its bigram-token count minus the least overlap
    any admissible partner length requires, plus one (minimum over the
    partner lengths the ratio allows, computed in the row)."""
    r = _length_bounds(threshold)
    length = length.cast("bigint")
    lo = F.greatest(F.floor(length * F.lit(r)) - 1, F.lit(0).cast("bigint"))
    hi = F.floor(length / F.lit(r)) + 1
    big = F.lit(1 << 40)
    tau = F.aggregate(F.sequence(lo, hi), big,
                      lambda acc, lb: F.least(acc, F.coalesce(_need(length, lb, threshold), big)))
    tau = F.when(tau >= big, F.lit(1)).otherwise(F.greatest(tau, F.lit(1)))
    return (length + 1) - tau + 1


def _odd_letters(text: str) -> Column:
    """64 bits: which kinds of characters (code points modulo 64) a text holds an odd number of."""
    return F.expr(f"aggregate(split({text}, ''), 0L, (s, c) -> if(c = '', s, s ^ shiftleft(1L, ascii(c) % 64)))")


DIRECT = 64  # titles of a company up to which they are compared one by one


def fuzzy_candidates(rows: DataFrame, company_pairs: DataFrame, threshold: int = FUZZY_THRESHOLD, direct: int = DIRECT) -> DataFrame:
    """Pairs (r, c, tr, tc) of row ids and their titles, c earlier than r, r
    incoming, companies similar, that may reach the ratio threshold: a
    superset of the true pairs. Titles of the common subsequence that the ratio asks
    for differ in at most d characters, so in as many kinds of odd number; a company of up to
    ``direct`` titles is compared by that where the rows meet. The titles of a
    larger one are found by their bigrams, see ``_by_bigrams``."""
    items = scratch_table(rows.select("rid", "company_name", "tkey", "order", F.length("tkey").alias("len"), _odd_letters("tkey").alias("odd")), "title-rows")
    large = scratch_table(items.groupBy("company_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > direct).select("company_name"), "large-companies")
    split = not large.isEmpty()
    near = company_pairs.select(F.col("a").alias("company_name"), "b")
    left = (items.where(F.col("order") > F.lit(-math.inf)).join(near, "company_name")
            .select(F.col("rid").alias("r"), F.col("order").alias("r_order"), F.col("len").alias("r_len"), F.col("odd").alias("r_odd"), F.col("tkey").alias("tr"), "b"))
    small = items.join(large, "company_name", "left_anti") if split else items
    right = small.select(F.col("rid").alias("c"), F.col("order").alias("c_order"), F.col("len").alias("c_len"), F.col("odd").alias("c_odd"), F.col("tkey").alias("tc"),
                         F.col("company_name").alias("c_company"))
    total, common = F.col("r_len") + F.col("c_len"), _lcs_min(F.col("r_len") + F.col("c_len"), threshold)
    found = left.join(right, (F.col("b") == F.col("c_company")) & (F.col("c_order") < F.col("r_order")) & (common <= F.least("r_len", "c_len"))
                      & (F.bit_count(F.col("r_odd").bitwiseXOR(F.col("c_odd"))) <= total - 2 * common)).select("r", "c", "tr", "tc")
    if not split:
        return found
    keys = items.select("rid", "tkey")
    others = (_by_bigrams(items, near.join(large.withColumnRenamed("company_name", "b"), "b", "left_semi"), threshold)
              .join(keys.select(F.col("rid").alias("r"), F.col("tkey").alias("tr")), "r").join(keys.select(F.col("rid").alias("c"), F.col("tkey").alias("tc")), "c"))
    return found.unionByName(others)


def _by_bigrams(items: DataFrame, near: DataFrame, threshold: int) -> DataFrame:
    """Pairs (r, c) as ``fuzzy_candidates`` finds them, by a shared prefix bigram: their
    lengths are within the ratio's bound, and they share at least the
    bigram tokens the bound requires."""
    rmin = _length_bounds(threshold)
    met = near.select("company_name").unionByName(near.select(F.col("b").alias("company_name"))).distinct()
    items = items.join(met, "company_name", "left_semi")
    # a title is cut into tokens once
    toks = scratch_table(items.select("tkey", "len").distinct().withColumn("toks", _bigram_tokens(F.col("tkey"))).withColumn("plen", _title_prefix_len(F.col("len"), threshold)), "title-tokens")
    pre = _prefix_tokens(toks, "tkey", "toks", F.col("plen")).join(items, "tkey").select("rid", "company_name", "order", "len", "tok")
    left = (pre.where(F.col("order") > F.lit(-math.inf)).join(near, "company_name")
            .select(F.col("rid").alias("r"), F.col("order").alias("r_order"), F.col("len").alias("r_len"), "b", "tok"))
    right = pre.select(F.col("rid").alias("c"), F.col("order").alias("c_order"), F.col("len").alias("c_len"),
                       F.col("company_name").alias("b"), "tok")
    lo, hi = F.least("r_len", "c_len"), F.greatest("r_len", "c_len")
    pairs = (left.join(right, ["b", "tok"])
             .where((F.col("c_order") < F.col("r_order")) & (lo >= F.floor(F.lit(rmin) * hi) - 1)
                    & _need(F.col("r_len"), F.col("c_len"), threshold).isNotNull())
             .select("r", "c").distinct())
    each = items.join(toks.select("tkey", "toks"), "tkey").select("rid", "toks", "len")
    both = (pairs.join(each.select(F.col("rid").alias("r"), F.col("toks").alias("tr"), F.col("len").alias("lr")), "r")
            .join(each.select(F.col("rid").alias("c"), F.col("toks").alias("tc"), F.col("len").alias("lc")), "c"))
    return both.where(F.size(F.array_intersect("tr", "tc")) >= _need(F.col("lr"), F.col("lc"), threshold)).select("r", "c")


def dedup_fuzzy(incoming: DataFrame, stored: DataFrame, *, threshold: int = FUZZY_THRESHOLD,
                trigram_threshold: float = TRIGRAM_THRESHOLD, stats: dict | None = None) -> DataFrame:
    """Arrival-order greedy fuzzy dedup. ``incoming`` has seq (unique), title,
    company_name; ``stored`` has title, company_name (every stored row counts
    as kept; quarantined rows carry an empty company and never match).

    A row is a duplicate when an earlier *kept* row (stored, or incoming and
    itself kept) has a similar company and a title ratio >= threshold. With
    A~B, B~C, A≁C and arrival A, B, C: A kept, B dropped, C kept. A company
    without a trigram (NULL, empty, punctuation only) is similar to nothing:
    such rows are kept. Returns every incoming row with ``keep``."""
    gram = _has_gram("company_name")
    _t0 = _time.perf_counter()
    inc = incoming.where(gram).select(F.col("seq").alias("rid"), F.col("seq").cast("double").alias("order"), "company_name",
                                      sort_key(normalise_text("title")).alias("tkey"))
    # companies first: of the stored rows only those of a company like an incoming one are looked at
    ours = inc.select("company_name").distinct()
    pairs = scratch_table(similar_company(ours.unionByName(stored.select("company_name").distinct()), trigram_threshold, left=ours).select("a", "b"), "company-pairs")
    met = pairs.select(F.explode(F.array("a", "b")).alias("company_name")).unionByName(ours).distinct()
    # stored rows get negative ids and come before every incoming row; equal ones are one
    st = (stored.select("company_name", "title").join(met, "company_name", "left_semi")
          .select("company_name", sort_key(normalise_text("title")).alias("tkey")).distinct()
          .withColumn("rid", -1 - F.monotonically_increasing_id())
          .withColumn("order", F.lit(-math.inf)))
    rows = inc.unionByName(st.select("rid", "order", "company_name", "tkey"))
    # rows with the same company and title key as an earlier row are always
    # duplicates (ratio 100, similarity 1 with a kept row, or with whatever
    # dropped the earlier one); only the first of each such group is paired
    firsts = scratch_table(rows.groupBy("company_name", "tkey").agg(F.min(F.struct("order", "rid")).alias("_f"))
                           .select("company_name", "tkey", F.col("_f.order").alias("order"), F.col("_f.rid").alias("rid")), "titles")
    _t1 = _time.perf_counter()

    own = ours.select(F.col("company_name").alias("a"), F.col("company_name").alias("b"))
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(own)
    scored = scratch_table(fuzzy_candidates(firsts, pairs, threshold), "title-candidates")
    titles = scored.select("tr", "tc").distinct().withColumn("ratio", token_sort_ratio("tr", "tc")).where(F.col("ratio") >= threshold)
    edges = scratch_table(scored.join(titles.select("tr", "tc"), ["tr", "tc"]).select("r", "c"), "title-links")
    _t2 = _time.perf_counter()

    dropped = greedy_drops(edges, stats)
    if stats is not None:
        stats.update(rows_sec=round(_t1 - _t0, 2), edges_sec=round(_t2 - _t1, 2), rounds_sec=round(_time.perf_counter() - _t2, 2))
    first = firsts.where(F.col("rid") >= 0).select(F.col("rid").alias("seq")).join(dropped.select(F.col("r").alias("seq")), "seq", "left_anti")
    out = incoming.withColumn("_gram", gram).join(first.withColumn("_first", F.lit(True)), "seq", "left")
    return out.withColumn("keep", ~F.col("_gram") | F.coalesce("_first", F.lit(False))).drop("_gram", "_first")


GREEDY_ROUNDS = 3
GREEDY_LINKS = 200_000


def greedy_drops(edges: DataFrame, stats: dict | None = None) -> DataFrame:
    """``(r)``: the rows dropped when links ``(r, c)``, c earlier than r (a
    negative c is kept from the start), are resolved in arrival order: a row is
    dropped if an earlier row it links with is kept.

    A few rounds decide most rows at once: rows with a link to a kept row go,
    rows without any open link to an earlier one are kept. What is left are
    chains; each connected component of up to ``GREEDY_LINKS`` links is walked
    in order in one task, so the number of rounds does not follow the length of
    a chain. Larger components go on in rounds: the result is the same."""
    dropped = scratch_table(edges.where("c < 0").select("r").distinct(), "dropped")
    open_ = edges.where("c >= 0").join(dropped, "r", "left_anti").join(dropped.select(F.col("r").alias("c")), "c", "left_anti").select("r", "c")
    open_ = scratch_table(open_, "open")
    rounds, left = 0, open_.count()
    while left:
        if rounds >= GREEDY_ROUNDS:
            size = components(open_.select(F.col("r").alias("a"), F.col("c").alias("b")))
            labelled = open_.join(size.withColumnRenamed("node", "r"), "r")
            small = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= GREEDY_LINKS).select("label")
            walked = (labelled.join(small, "label").select("label", "r", "c").groupBy("label")
                      .applyInPandas(_walk, "r long"))
            dropped = scratch_table(dropped.unionByName(walked), "dropped")
            open_ = scratch_table(labelled.join(small, "label", "left_anti").select("r", "c"), "open")
            rounds = 0
            left = open_.count()
            continue
        rounds += 1
        kept = open_.select("c").distinct().join(open_.select(F.col("r").alias("c")), "c", "left_anti")
        gone = scratch_table(open_.join(kept, "c", "left_semi").select("r").distinct(), "dropped")
        dropped = dropped.unionByName(gone)
        open_ = scratch_table(open_.join(gone, "r", "left_anti").join(gone.select(F.col("r").alias("c")), "c", "left_anti")
                              .select("r", "c"), "open")
        left = open_.count()
    if stats is not None:
        stats.update(rounds=rounds)
    return dropped


def _walk(links: pd.DataFrame) -> pd.DataFrame:
    """One component in arrival order."""
    out, gone = [], set()
    for r, c in links.sort_values(["r", "c"])[["r", "c"]].itertuples(index=False):
        if c not in gone and r not in gone:
            gone.add(r)
            out.append(r)
    return pd.DataFrame({"r": pd.Series(out, dtype="int64")})


def insert_if_absent(store: DataFrame, new: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Append rows whose key is absent (the first per key inside ``new`` by
    ``order``); existing rows win, as ON CONFLICT DO NOTHING does."""
    fresh = first_seen_in_batch(new, key, order).join(store.select(key).distinct(), key, "left_anti")
    return store.unionByName(fresh.select(*store.columns))
