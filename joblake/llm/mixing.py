"""Operator 10: mixing sources to target weights by Pfair scheduling.

The documents of each source are cut into blocks of ``block_rows``. With the
integer share ``s`` of a source and the sum ``W`` of all shares, its weight is
``w = s / W``; its block ``j`` is released at slot ``floor(j / w)`` and due by
slot ``ceil((j + 1) / w)``. One block runs per slot: of the released blocks the
one with the earliest deadline (ties: smaller source name). Release times keep
a source from running ahead and deadlines from lagging, so after every slot
each source has had its share to within less than one block. The schedule
repeats after ``W`` slots, so one period is worked out, and a block's slot is
that of its place in the period plus its number of periods. DataFrame functions
only.

Sources of equal share have the same release times and deadlines, so they run
in turn, by name: the ``q``-th block of such a class of ``m`` sources is block
``q div m`` of its source ``q mod m``. The schedule is therefore stepped with
one counter per distinct share, however many sources there are, and the slots
are gathered in short lists of ``_STEP``. A common divisor of all shares is taken
out first, which changes no slot: the schedule repeats that much sooner. The
schedule is broadcast up to ``_SLOTS`` slots and joined beyond.

Every document keeps a place: when a source runs out, its slots stay empty and
the others keep their order. ``in_mix`` marks the blocks before the first
source's end, up to where the target weights hold.

Within a source documents are ordered by the MD5 of their id (a fixed shuffle;
of the text where the id is null), ties by id and text. Their ranks come from counts per leading digits of the MD5,
so a source with a third of all rows is ranked in many tasks. A null source is
a source of its own. Neither the
number of sources nor the length of a period is bounded. An empty table gives an
empty result; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from joblake.session import scratch_table as written

_STEP = 512
_SLOTS = 1 << 20
_DIGITS = 3


def size_shares(scale: int = 64) -> Column:
    """Share of a source of ``n`` rows where the largest has ``top``: ``scale``
    times the square root of the ratio, rounded down, one at least."""
    return F.greatest(F.lit(1), F.floor(scale * F.sqrt(F.col("n") / F.col("top")))).cast("long")


def schedule(shares: DataFrame) -> DataFrame:
    """``shares(source, share)`` (one row per source) to one period:
    ``(source, k, share, period, slot)``, block ``k`` of the source at ``slot``."""
    src = F.array_sort(F.collect_list(F.struct(F.col("source").isNotNull().alias("known"), "source", F.col("share").cast("long").alias("share"))))
    numbered = shares.agg(src.alias("src")).select(F.posexplode("src").alias("i", "x")).select("i", "x.source", "x.share")
    one = (numbered.groupBy("share").agg(F.array_sort(F.collect_list("i")).alias("members"))
           .agg(F.array_sort(F.collect_list(F.struct("share", "members", F.size("members").cast("long").alias("m")))).alias("cls"))
           .withColumn("period", F.expr("aggregate(cls, 0L, (n, x) -> n + x.share * x.m)")).where("period > 0"))
    # of the classes' next blocks, those released by slot t: the first deadline, then the first source
    due = """array_min(transform(st.done, (q, c) -> if((q div cls[c].m) * period div cls[c].share <= t,
        named_struct('due', ((q div cls[c].m + 1) * period + cls[c].share - 1) div cls[c].share, 'i', cls[c].members[cast(q % cls[c].m as int)], 'c', c), null)))"""
    # state: blocks placed so far per class, and the source of every slot of this step
    step = f"""aggregate(sequence(lo, least(lo + {_STEP}, period) - 1), named_struct('done', all.done, 'pick', cast(array() as array<int>)),
        (st, t) -> transform(array({due}), n -> named_struct('done', transform(st.done, (q, c) -> if(c = n.c, q + 1, q)), 'pick', concat(st.pick, array(n.i))))[0])"""
    walk = f"""aggregate(sequence(0L, period - 1, {_STEP}L), named_struct('done', transform(cls, x -> 0L), 'picks', cast(array() as array<array<int>>)),
        (all, lo) -> transform(array({step}), r -> named_struct('done', r.done, 'picks', concat(all.picks, array(r.pick))))[0])"""
    picked = (one.select("period", F.expr(walk).getField("picks").alias("picks")).select("period", F.posexplode("picks").alias("step", "pick"))
              .select("period", "step", F.posexplode("pick").alias("at", "i")).withColumn("slot", F.col("step").cast("long") * _STEP + F.col("at")))
    return (picked.join(numbered, "i").select("source", "share", "period", "slot")
            .withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("slot")).cast("long") - 1))


def reduced(shares: DataFrame) -> DataFrame:
    """The same weights in the smallest integers."""
    divisor = shares.where("share > 0").groupBy("share").agg(F.count(F.lit(1))).agg(F.collect_list(F.col("share").cast("long")).alias("s"))  # one row
    gcd = F.expr("""aggregate(s, 0L, (a, b) -> aggregate(sequence(1, 96), named_struct('a', a, 'b', b),
        (x, i) -> if(x.b = 0, x, named_struct('a', x.b, 'b', x.a % x.b))).a)""")
    return shares.crossJoin(F.broadcast(divisor.select(F.greatest(gcd, F.lit(1)).alias("gcd")))).select("source", F.expr("cast(share as long) div gcd").alias("share"))


def mix_sources(docs: DataFrame, shares: DataFrame | None = None, block_rows: int = 16) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with ``block`` (number within its
    source), ``slot`` (its block's place in the mix), ``place`` (within the
    block) and ``in_mix``. ``shares(source, share)`` are the target weights as
    integers; by default they follow the square root of the sources' sizes."""
    names = [c for c in docs.columns if c not in ("block", "slot", "place", "in_mix")]
    # a null source joins as its own
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s")
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit(""))).alias("m")
    rows = docs.select(key, md5, F.struct(*[F.col(f"`{c}`") for c in names]).alias("d")).withColumn("p", F.substring("m", 1, _DIGITS))

    part = rows.groupBy("s", "p").agg(F.count(F.lit(1)).alias("c"), F.first("d.source").alias("source"))
    earlier = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offset = part.select("s", "p", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("o"))
    sizes = part.groupBy("s").agg(F.sum("c").alias("n"), F.first("source").alias("source"))
    if shares is None:
        shares = sizes.crossJoin(F.broadcast(sizes.agg(F.max("n").alias("top")))).select("source", size_shares().alias("share"))  # one row, one column
    per = shares.select(key, F.col("share").cast("long").alias("share")).crossJoin(F.broadcast(shares.agg(F.sum("share").cast("long").alias("period"))))
    # slots before the first source has no block left
    end = (sizes.join(per, "s").select(F.expr(f"((n + {block_rows - 1}) div {block_rows}) * period div share").alias("e"))
           .agg(F.min("e").alias("end")))

    rank = F.col("o") + F.row_number().over(Window.partitionBy("s", "p").orderBy("m", "d.doc_id", F.md5(F.coalesce("d.text", F.lit(""))))) - 1
    ranked = (rows.join(offset, ["s", "p"]).withColumn("r", rank)
              .withColumn("block", F.expr(f"r div {block_rows}")).withColumn("place", (F.col("r") % block_rows).cast("int")))
    # one row per source, eight bytes per slot; and one row
    slots = written(schedule(reduced(shares)), "schedule")
    plan = (slots.select(key, "share", "period", F.struct("k", "slot").alias("x"))
            .groupBy("s", "share", "period").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["slot"]).alias("at")))
    placed = ranked.join(F.broadcast(plan) if slots.count() <= _SLOTS else plan, "s")
    out = placed.withColumn("slot", F.expr("(block div share) * period + at[cast(block % share as int)]")).crossJoin(F.broadcast(end))
    return out.select(*[F.col(f"d.`{c}`") for c in names], "block", "slot", "place", (F.col("slot") < F.col("end")).alias("in_mix"))


def oracle(block_rows: int, docs: str = "documents") -> str:
    """The same in SQL, with the schedule simulated slot by slot."""
    return f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
shares AS (SELECT source, n, greatest(1, floor(64 * sqrt(n / (SELECT max(n) FROM sizes))))::BIGINT AS share FROM sizes),
src AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST) AS i, * FROM shares),
total AS (SELECT sum(share)::BIGINT AS period, count(*) AS n, list(share ORDER BY i) AS s FROM src),
sim AS (
  SELECT -1::BIGINT AS t, list_transform(s, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick, s, period, n FROM total
  UNION ALL
  SELECT t, list_transform(done, lambda c, j: CASE WHEN j = best THEN c + 1 ELSE c END), best, s, period, n
  FROM (SELECT t + 1 AS t, done, s, period, n,
          list_min(list_transform(list_filter(range(1, n + 1), lambda j: (done[j] * period) // s[j] <= t + 1),
                                  lambda j: ((done[j] + 1) * period + s[j] - 1) // s[j] * 100000 + j)) % 100000 AS best FROM sim WHERE t + 1 < period)),
plan AS (SELECT source, share, period, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM sim JOIN src ON pick = i),
cut AS (SELECT min(((n + {block_rows - 1}) // {block_rows}) * (SELECT period FROM total) // share) AS e FROM shares),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, text, '')), doc_id, md5(coalesce(text, ''))) - 1 AS r FROM {docs}),
blocks AS (SELECT doc_id, source, r // {block_rows} AS block, r % {block_rows} AS place FROM ranked)
SELECT doc_id, b.source, block, (block // share) * period + slot AS slot, place, (block // share) * period + slot < (SELECT e FROM cut) AS in_mix
FROM blocks b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source AND block % share = k"""
