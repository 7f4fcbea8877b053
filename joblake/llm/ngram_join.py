"""Operator 1: n-gram Jaccard join, with prefix filters under several global
token orders.

A document is the set of its distinct ``k``-word shingles. Two documents link
when the Jaccard similarity of their sets is at least ``threshold`` (a
percentage). In a fixed order of all shingles, two linked sets of size n share
one of their first ``n - ceil(t * n) + 1`` shingles, whatever the order: so a
pair is a candidate only if it shares a prefix shingle under *each* of several
orders, and only what is left after that intersection is verified. The prefixes
of the first order are joined; for the pairs that come out of that, the other
orders' prefixes are intersected where the pair's sets meet.

* The orders put frequent shingles last and are otherwise by hash, with another
  seed each. The frequent shingles are counted over all documents; at most
  ``MAX_FREQUENT`` of them (the most frequent) are told apart, which bounds the
  broadcast list. A shingle outside the list only sorts earlier: the orders
  stay the same for all documents, so the filter stays exact.
* Documents with the same set are one class from the start, so copies are never
  joined with one another.
* Within a prefix shingle's documents, all are first compared with one of them
  (a star, linear in the group). After the components of those links are known,
  only pairs of different components remain, which drops the pairs inside a
  family of near copies without losing a component. Two near copies share many
  prefix shingles; of shingles that the very same classes share (compared by two
  64-bit hashes and their number) only one is joined, and a pair comes out at the
  first shingle it shares, as far as the ``FIRST`` first shingles of both show it.
* Before any whole sets are moved, a pair must pass the size bound and parity
  sketches, of 256 bits and, for larger sets, of 2,048 and 16,384: each shingle
  flips one bit, so the sketches of two sets differ in at most as many bits as
  the sets differ in shingles (an exact bound).

Edge cases: null or empty text and text without words give an empty set,
``n_shingles`` 0, linked with nothing. Fewer than ``k`` words are one shingle.
Repeated rows and repeated ids are rows of their own; the component id is the
smallest non-null id of the component's rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from joblake.llm.common import batches, bloom_bits, bloom_has, has_bit
from joblake.llm.hashing import chunks, mix, shingle_sets, texts_of
from joblake.operators.graph import components
from joblake.session import drop_scratch, scratch_table as written

MAX_FREQUENT = 1 << 18
BUFFER = 1 << 21
BLOOM_BITS = 1 << 24
FIRST = 32
# set size from which a class has a sketch of so many bits
SKETCHES = {"wide": (400, 2048), "widest": (1600, 16384)}
ORDER_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)

_SETS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()),
                   ("s0", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("s3", pa.int64()),
                   ("prefix", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in SKETCHES)])
_SETS_DDL = "key long, doc_id long, n long, cls long, s0 long, s1 long, s2 long, s3 long, prefix array<long>, wide array<long>, widest array<long>"


def _row_key():
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), "text")


def class_of(s: np.ndarray) -> int:
    """A 64-bit hash of a whole set."""
    with np.errstate(over="ignore"):
        h = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([h]))[0].astype(np.int64))


def sketch(s: np.ndarray, bits: int) -> list[int]:
    """Parity bits: bit ``h mod bits`` of every shingle, exclusive-or."""
    odd = (np.bincount((s >> np.uint64(17)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def prefix_length(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


class Orders:
    """The global orders: frequent shingles last, by their frequency class,
    else by hash."""

    def __init__(self, frequent: np.ndarray, rank: np.ndarray):
        self.frequent, self.rank = frequent, rank

    def prefix(self, s: np.ndarray, length: int, order: int) -> np.ndarray:
        f = np.zeros(len(s), np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
            hit = self.frequent[at] == s
            f[hit] = self.rank[at[hit]]
        key = mix(s ^ np.uint64(ORDER_SEEDS[order]))
        cold = np.flatnonzero(f == 0)
        if len(cold) > length:
            return s[cold[np.argpartition(key[cold], length - 1)[:length]]]
        warm = np.flatnonzero(f)
        return s[np.concatenate((cold, warm[np.lexsort((key[warm], f[warm]))[: length - len(cold)]]))]


def _frequent(docs: DataFrame, k: int) -> Orders:
    """The most frequent shingles and the power of two of their frequency. A
    task counts a buffer of shingles at a time and passes on those of three or
    more documents; the sums are made by Spark."""

    def count(it):
        held, size = [], 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= 3
            return pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], names=["t", "c"])

        for batch in it:
            for part in chunks(texts_of(batch.column(0))):
                for s in shingle_sets(part, k):
                    if len(s):
                        held.append(s)
                        size += len(s)
                    if size >= BUFFER:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    counts = written(docs.select("text").mapInArrow(count, "t long, c long")
                     .groupBy("t").agg(F.sum("c").alias("c")).select("t", F.floor(F.log2("c")).cast("int").alias("f")), "frequent")
    per = sorted(((r.f, r.n) for r in counts.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = 1 << 30, 0
    for f, n in per:  # whole frequency classes, from the top, as many as fit
        if total + n > MAX_FREQUENT:
            break
        least, total = f, total + n
    top = counts.where(F.col("f") >= least).toPandas()
    drop_scratch(counts)
    t = top["t"].to_numpy(np.int64).view(np.uint64)
    o = np.argsort(t)
    return Orders(t[o], top["f"].to_numpy(np.int64)[o])


def document_sets(docs: DataFrame, k: int, threshold: int, orders) -> DataFrame:
    """One row per document: class, size, sketches and prefix in the first
    order. A task gives a class's prefix and wide sketch with the first of its
    documents only, so copies do not multiply what is joined."""

    def rows(it):
        seen: set[int] = set()
        for batch in it:
            keys, ids = (batch.column(i).to_pylist() for i in (0, 1))
            at = 0
            for part in chunks(texts_of(batch.column(2))):
                for s in shingle_sets(part, k):
                    if len(s):
                        c = class_of(s)
                        prefix, wide = None, [None] * len(SKETCHES)
                        if c not in seen:
                            seen.add(c)
                            prefix = orders.value.prefix(s, prefix_length(len(s), threshold), 0).view(np.int64)
                            wide = [sketch(s, bits) if len(s) >= least else None for least, bits in SKETCHES.values()]
                        yield (keys[at], ids[at], len(s), c, *sketch(s, 256), prefix, *wide)
                    else:
                        yield (keys[at], ids[at], 0, None, 0, 0, 0, 0, None, *[None] * len(SKETCHES))
                    at += 1

    return docs.select(_row_key(), F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: batches(rows(it), _SETS), _SETS_DDL)


def _whole_sets(docs: DataFrame, pairs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """``(cls, s)``: the whole sets of the classes in ``pairs``, from the texts
    again. A Bloom filter of the representatives' ids (of fixed size) keeps the
    other documents out before they are shingled; what it lets through in error
    may repeat a class, never change a set."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(reps.select("cls", "key"), "cls").select("key")
    bits = docs.sparkSession.sparkContext.broadcast(bloom_bits(need, "key", BLOOM_BITS))

    def rows(it):
        for batch in it:
            ok = has_bit(bits.value, batch.column(1).to_numpy()) & has_bit(bits.value, batch.column(2).to_numpy())
            for part in chunks(texts_of(batch.column(0).filter(pa.array(ok)))):
                for s in shingle_sets(part, k):
                    if len(s):
                        yield class_of(s), s.tobytes()

    schema = pa.schema([("cls", pa.int64()), ("s", pa.binary())])
    return (docs.withColumn("key", _row_key()).select("text", *bloom_has(F.col("key"), BLOOM_BITS))
            .mapInArrow(lambda it: batches(rows(it), schema, 500), "cls long, s binary"))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, wide: DataFrame, orders, k: int, threshold: int) -> DataFrame:
    """The candidate pairs that pass the wide sketch, share a prefix shingle in
    the other orders too, and whose whole sets are similar enough."""
    x, y = (reps.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"))
            .join(wide.select(F.col("cls").alias(c), *[F.col(w).alias(f"{w}_{c}") for w in SKETCHES]), c, "left") for c in "ab")
    near = F.lit(True)
    for w in SKETCHES:
        differ = F.expr(f"aggregate(zip_with({w}_a, {w}_b, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")
        near &= F.col(f"{w}_a").isNull() | F.col(f"{w}_b").isNull() | (differ * (100 + threshold) <= (100 - threshold) * (F.col("na") + F.col("nb")))
    kept = written(pairs.join(x, "a").join(y, "b").where(near).select("a", "b"), "candidates")
    sets = written(_whole_sets(docs, kept, reps, k), "sets")

    def similar(x, y):
        for o in range(1, len(ORDER_SEEDS)):
            if not len(np.intersect1d(*(orders.value.prefix(s, prefix_length(len(s), threshold), o) for s in (x, y)))):
                return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= threshold * (len(x) + len(y) - both)

    def check(it):
        for batch in it:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    both = (kept.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("x")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y"))
    links = written(both.mapInArrow(check, "a long, b long").distinct(), "links")
    drop_scratch(kept, sets)
    return links


def _may_link(threshold: int):
    """The size bound and the sketch bound, for rows with a's and b's columns."""
    differ = " + ".join(f"bit_count(a.s{i} ^ b.s{i})" for i in range(4))
    return F.expr(f"100 * least(a.n, b.n) >= {threshold} * greatest(a.n, b.n) and "
                  f"({differ}) * {100 + threshold} <= {100 - threshold} * (a.n + b.n)")


def ngram_jaccard_classes(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row per row of ``docs``: ``(key,
    doc_id, n_shingles, component_id, class_id, leader)``. ``threshold`` is the least
    Jaccard similarity in percent, ``class_id`` the smallest id of the
    documents with the same set. ``key`` hashes id and text; ``leader`` is the key
    of the component's document with the smallest id."""
    orders = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k))
    sets = written(document_sets(docs, k, threshold, orders), "doc-sets")
    rest = ["n", "s0", "s1", "s2", "s3"]
    reps = written(sets.where("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", *rest)).alias("r"))
                   .select("cls", F.col("r.doc_id").alias("id"), "r.key", *[f"r.{c}" for c in rest]), "classes")
    wide = written(sets.where("wide is not null").select("cls", *SKETCHES).dropDuplicates(["cls"]), "sketches")
    member_of = written(sets.select("key", "doc_id", "n", "cls"), "members")
    small = reps.select("cls", "n", "s0", "s1", "s2", "s3")

    spread = sets.select(F.explode("prefix").alias("token"), "cls").repartition("token")
    shared = spread.groupBy("token").agg(F.min("cls").alias("pivot"), F.max("cls").alias("other")).where("pivot <> other").drop("other")
    rows = written(spread.join(shared, "token").distinct(), "shared")
    drop_scratch(sets)

    star = rows.where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct()
    a, b = small.alias("a"), small.alias("b")
    star = (star.alias("p").join(a, F.expr("p.a = a.cls")).join(b, F.expr("p.b = b.cls"))
            .where(_may_link(threshold)).select("p.a", "p.b"))
    first = _verified(star, docs, reps, wide, orders, k, threshold)

    label = components(first)
    placed = (rows.drop("pivot").join(label.withColumnRenamed("node", "cls"), "cls", "left")
              .select("token", "cls", F.coalesce("label", "cls").alias("label")))
    # of the shingles that the same classes share, one
    open_ = (placed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("c"),
                                         *[F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"x{i}") for i in range(2)])
             .where("lo <> hi").groupBy("c", "x0", "x1").agg(F.min("token").alias("token")).select("token"))
    left = written(placed.join(open_, "token", "left_semi"), "open-classes")
    place = F.row_number().over(Window.partitionBy("cls").orderBy("token"))
    first_of = left.select("cls", "token").withColumn("r", place).where(F.col("r") <= FIRST).groupBy("cls").agg(F.collect_list("token").alias("low"))
    rest_rows = written(left.join(small.join(first_of, "cls"), "cls").withColumn("low", F.expr("filter(low, x -> x < token)")), "open")
    drop_scratch(rows, left)
    # a smaller shingle in both lists is where the pair came out; the condition treats
    # both sides alike, so that they are one shuffle
    meet = (F.expr("a.token = b.token and a.cls < b.cls and a.label <> b.label") & _may_link(threshold)
            & F.expr("not arrays_overlap(a.low, b.low)"))
    cross = (rest_rows.alias("a").join(rest_rows.alias("b"), meet)
             .select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct())
    links = first.unionByName(_verified(cross, docs, reps, wide, orders, k, threshold))
    label = written(components(links), "components").withColumnRenamed("node", "cls")
    drop_scratch(rest_rows, wide)

    member = reps.select("cls", "id", "key").join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    lowest = member.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("low"))
    member = member.join(lowest, "label").select("cls", F.col("low.id").alias("component_id"), F.col("low.key").alias("leader"), F.col("id").alias("class_id"))
    own = member_of.join(member, "cls", "left")
    some = F.col("n") > 0
    return own.select("key", "doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.when(some, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(some, F.col("leader")).otherwise(F.col("key")).alias("leader"))


def one_per_group(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """The documents with the smallest id of their component; of repeated rows
    (same id and text) one."""
    groups = ngram_jaccard_classes(docs.select("doc_id", "text"), k, threshold)
    lead = groups.where("key = leader").select("key").distinct()
    rows = docs.select(_row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    return rows.join(lead, "key", "left_semi").withColumn("id", F.col("d.doc_id")).dropDuplicates(["key", "id"]).select("d.*")
