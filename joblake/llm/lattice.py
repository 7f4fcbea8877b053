"""Operator 12: near-duplicate embeddings by lattice hashing.

A table projects each vector, scaled to length one, on ``8 * points`` random
directions and decodes every eight coordinates to the nearest point of the E8
lattice; the points together are the vector's home cell. A vector also probes
the ``probes`` cells next to it that it lies nearest to, each with one of its
points moved by one of the 240 shortest lattice vectors. Two vectors meet where
one of them is at home in a cell that the other is at home in or probes, in any
table; their cosine is then computed from the original vectors in double precision.

* The cells' size follows the threshold. How often two vectors of just that
  cosine meet in one table is worked out by simulation (projections of a pair
  depend on its cosine only), and ``tables`` is the least number that finds
  ``recall`` of them. ``points`` grows with the logarithm of the number of
  different vectors, so cells stay small.
* Equal vectors are one class from the start. Cells without a possible pair go
  before any vector moves.
* A cell's vectors are dealt into blocks of about ``BLOCK``, and a task compares
  one block of vectors at home with one block of members. It passes on, for each
  vector, how many partners it has and one link to the smallest vector of its
  group there: never the pairs. A pair that meets in several cells counts in
  the first of them, which its two lists of cells show.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing, nor do vectors of different length. Every row is a vector of its
own, repeated ids and rows too; a component's id is its smallest non-null id.
``kept`` is false only where that is another id than the row's. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from joblake.llm.common import batches
from joblake.llm.hashing import mix
from joblake.operators.graph import components
from joblake.session import drop_scratch, scratch_table as written

BLOCK = 1024
_ROWS = 2048  # vectors hashed at a time
_COLUMNS = 1024  # cells of an incidence matrix at a time


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2
    with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


SHORTEST = _shortest()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where rounding gives an odd
    one, the coordinate furthest from its integer is rounded the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: of D8 or of D8 moved by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _cell(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit name for the cells ``(rows, points, 8)``."""
    h = np.full(len(points), salt, np.uint64)
    with np.errstate(over="ignore"):
        for x in np.rint(2 * points).astype(np.int64).reshape(len(points), -1).T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x.view(np.uint64))
    return h.view(np.int64)


def _home_and_probes(x: np.ndarray, probes: int, salt: int) -> np.ndarray:
    """``(rows, 1 + probes)`` cells of projections ``(rows, points, 8)``, the
    home cell first."""
    rows, points = x.shape[:2]
    at = nearest_e8(x.reshape(-1, 8)).reshape(x.shape)
    # distance to a moved point, less that to the nearest one
    gain = (2.0 - 2.0 * (x - at) @ SHORTEST.T).reshape(rows, -1)
    best = np.argpartition(gain, probes - 1, axis=1)[:, :probes] if probes else np.empty((rows, 0), np.int64)
    out = np.empty((rows, 1 + probes), np.int64)
    out[:, 0] = _cell(at, salt)
    for p in range(probes):
        moved = at.copy()
        moved[np.arange(rows), best[:, p] // 240] += SHORTEST[best[:, p] % 240]
        out[:, p + 1] = _cell(moved, salt)
    return out


class Lattice:
    """The tables: ``cells(v)`` gives ``(rows, tables, 1 + probes)`` cells."""

    def __init__(self, threshold: float, n: int, probes: int = 8, recall: float = 0.98):
        self.points = max(2, round(math.log(max(n, 1)) / math.log(128)))
        self.probes = probes
        self.size = 7.0 * math.sqrt(2.0 * (1.0 - threshold)) if threshold < 1 else 0.01
        meet = self._meet(threshold)
        self.tables = max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - meet)))
        self._turns: dict[tuple[int, int], tuple] = {}

    def _meet(self, cosine: float, pairs: int = 4000) -> float:
        rng = np.random.Generator(np.random.PCG64(7))
        x, z = rng.standard_normal((2, pairs, self.points, 8))
        y = cosine * x + math.sqrt(max(0.0, 1.0 - cosine * cosine)) * z
        shift = rng.uniform(0, 1, (self.points, 8))
        a, b = (_home_and_probes(v / self.size + shift, self.probes, 0) for v in (x, y))
        met = (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
        return min(1 - 1e-9, max(1e-3, float(met.mean())))

    def _turn(self, table: int, dim: int):
        if (table, dim) not in self._turns:
            rng = np.random.Generator(np.random.PCG64([11, table, dim]))
            self._turns[table, dim] = rng.standard_normal((dim, 8 * self.points)) / self.size, rng.uniform(0, 1, 8 * self.points)
        return self._turns[table, dim]

    def cells(self, v: np.ndarray) -> np.ndarray:
        """For vectors of length one."""
        out = np.empty((len(v), self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            turn, shift = self._turn(t, v.shape[1])
            out[:, t] = _home_and_probes((v @ turn + shift).reshape(len(v), self.points, 8), self.probes, t * 1_000_003 + v.shape[1])
        return out


def _vectors(column: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as doubles, scaled by a power of two."""
    v = np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None])


def _usable(table: DataFrame) -> tuple[DataFrame, str]:
    """``(vec_id, v)``: the vector's components in bytes, null where it takes no
    part; and their type."""
    kind = "<f4" if table.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    whole = F.expr("""embedding is not null and size(embedding) > 0
        and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)""")

    def pack(it):
        for b in it:
            v = [None if x is None else (np.asarray(x, kind) + 0).tobytes() for x in b.column(1).to_pylist()]  # -0 as 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary())], names=["vec_id", "v"])

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(whole, F.col("embedding").cast("array<double>")).alias("e"))
    return rows.mapInArrow(pack, "vec_id long, v binary"), kind


def _memberships(classes: DataFrame, lattice, kind: str) -> DataFrame:
    """``(cell, cls, home)``: the cells of every class."""

    def rows(it):
        for batch in it:
            for s in range(0, batch.num_rows, _ROWS):
                cls, v = batch.column(0).slice(s, _ROWS).to_numpy(), batch.column(1).slice(s, _ROWS).to_pylist()
                size = np.array([len(x) for x in v])
                for n in np.unique(size):
                    at = np.flatnonzero(size == n)
                    x = _vectors([v[i] for i in at], kind)
                    cells = lattice.value.cells(x / np.sqrt((x * x).sum(1))[:, None])
                    home = np.zeros(cells.shape, bool)
                    home[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.repeat(cls[at], cells[0].size)), pa.array(home.ravel())],
                                                     names=["cell", "cls", "home"])

    return classes.select("cls", "v").mapInArrow(rows, "cell long, cls long, home boolean")


def _groups(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest position (of rows, then columns) that each row and column
    reaches by the links ``ok``."""
    n, m = ok.shape
    row, col = np.arange(n), np.arange(n, n + m)
    while True:
        new_row = np.minimum(row, np.where(ok, col[None, :], n + m).min(1, initial=n + m))
        new_col = np.minimum(col, np.where(ok, new_row[:, None], n + m).min(0, initial=n + m))
        if (new_row == row).all() and (new_col == col).all():
            return row, col
        row, col = new_row, new_col


def _shared(hx: list, mx: list, hy: list, my: list, before: int) -> np.ndarray:
    """How often each ``x`` and each ``y`` meet in cells before this one, from
    their lists of home cells and of all cells."""
    out = np.zeros((len(hx), len(hy)), np.float32)

    def earlier(lists):
        size = np.array([len(x) for x in lists])
        flat = np.concatenate(lists) if len(lists) else np.empty(0, np.int64)
        row, keep = np.repeat(np.arange(len(lists)), size), flat < before
        return row[keep], flat[keep]

    parts = [earlier(x) for x in (hx, mx, hy, my)]
    cells = np.intersect1d(parts[1][1], parts[3][1])
    for s in range(0, len(cells), _COLUMNS):
        own = cells[s : s + _COLUMNS]
        inc = []
        for (row, cell), n in zip(parts, (len(hx), len(hx), len(hy), len(hy))):
            m = np.zeros((n, len(own)), np.float32)
            at = np.minimum(np.searchsorted(own, cell), len(own) - 1)
            hit = own[at] == cell
            m[row[hit], at[hit]] = 1
            inc.append(m)
        out += inc[0] @ inc[3].T + inc[1] @ inc[2].T
    return out


def _compare(rows: list[tuple], threshold: float, kind: str, cell: int) -> Iterator[tuple[int, int, int]]:
    """Rows ``(cls, home, left, right, v, times, homes, all)`` of one task to
    ``(class, smallest class of its group here, partners counted here)``."""
    left, right = [r for r in rows if r[2]], [r for r in rows if r[3]]
    if not left or not right:
        return
    x, y = _vectors([r[4] for r in left], kind), _vectors([r[4] for r in right], kind)
    cos = (x @ y.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((y * y).sum(1))[None, :]
    a, b = np.array([r[0] for r in left]), np.array([r[0] for r in right])
    # two vectors at home here meet once, as (smaller, larger)
    ok = (cos >= threshold) & ~(np.array([r[1] for r in right])[None, :] & (a[:, None] >= b[None, :])) & (a[:, None] != b[None, :])
    i, j = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    if not len(i):
        return
    ok = ok[np.ix_(i, j)]
    lists = [[np.frombuffer(r[k], np.int64) for r in side] for side in ([left[q] for q in i], [right[q] for q in j]) for k in (6, 7)]
    new = ok & (_shared(*lists, cell) == 0)
    by_left = new @ np.array([right[q][5] for q in j])
    by_right = np.array([left[q][5] for q in i]) @ new
    row, col = _groups(ok)
    name = np.concatenate((a[i], b[j]))
    yield from zip(a[i].tolist(), name[row].tolist(), by_left.tolist())
    yield from zip(b[j].tolist(), name[col].tolist(), by_right.tolist())


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def near_duplicate_vectors(table: DataFrame, threshold: float = 0.95, recall: float = 0.98, probes: int = 8) -> DataFrame:
    """``table(vec_id, embedding, ...)`` to one row per row: ``(vec_id, n_links,
    component_id, kept)``. ``recall`` is the share of pairs of just ``threshold``
    that the tables are made to find; nearer pairs are found more often."""
    spark = table.sparkSession
    rows, kind = _usable(table)
    rows = written(rows, "vectors")
    classes = written(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("times"))
                      .withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    lattice = spark.sparkContext.broadcast(Lattice(threshold, classes.count(), probes, recall))
    member = written(_memberships(classes, lattice, kind), "cells")

    # cells in which two classes can meet, and their blocks
    cells = (member.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.count_if("home").alias("h")).where("h > 0 and m > 1")
             .select("cell", F.expr(f"cast((m + {BLOCK - 1}) div {BLOCK} as int)").alias("nm"), F.expr(f"cast((h + {BLOCK - 1}) div {BLOCK} as int)").alias("nh")))
    open_ = written(member.join(cells, "cell"), "open-cells")
    lists = open_.groupBy("cls").agg(F.collect_list(F.when(F.col("home"), F.col("cell"))).alias("hs"), F.collect_list("cell").alias("ms"))

    def packed(it):
        for b in it:
            cols = [pa.array([np.array(x, np.int64).tobytes() for x in b.column(i).to_pylist()], pa.binary()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, b.column(3), b.column(4)], names=["cls", "hs", "ms", "v", "times"])

    whole = written(lists.join(classes.select("cls", "v", "times"), "cls").select("cls", "hs", "ms", "v", "times")
                    .mapInArrow(packed, "cls long, hs binary, ms binary, v binary, times long"), "vector-cells")
    # a member goes to its block against all blocks at home; one at home, also to its own there against all members
    as_member = "transform(sequence(0, nh - 1), i -> struct(i as i, mb as j))"
    as_home = "transform(sequence(0, nm - 1), j -> struct(hb as i, j as j))"
    tasks = (open_.withColumn("hb", F.pmod(F.xxhash64("cls"), "nh").cast("int")).withColumn("mb", F.pmod(F.xxhash64("cls", F.lit(1)), "nm").cast("int"))
             .withColumn("t", F.explode(F.expr(f"if(home, array_union({as_member}, {as_home}), {as_member})")))
             .select("cls", "cell", "t.i", "t.j", "home", (F.col("home") & (F.col("hb") == F.col("t.i"))).alias("l"), (F.col("mb") == F.col("t.j")).alias("r"))
             .join(whole, "cls").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j"))

    def compared(it):
        held, now = [], None
        for batch in it:
            c = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for k, *row in zip(zip(c[1], c[2], c[3]), c[0], c[4], c[5], c[6], c[9], c[10], c[7], c[8]):
                if k != now:
                    if held:
                        yield from _compare(held, threshold, kind, now[0])
                    held, now = [], k
                held.append(row)
        if held:
            yield from _compare(held, threshold, kind, now[0])

    found = written(tasks.mapInArrow(lambda it: batches(compared(it), _FOUND), "a long, b long, n long")
                    .groupBy("a", "b").agg(F.sum("n").alias("n")), "vector-links")
    label = components(found.select("a", "b"))
    degree = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    known = classes.select("cls", "id", "times").join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    lowest = known.groupBy("label").agg(F.min("id").alias("component"))
    per_class = known.join(lowest, "label").join(degree, "cls", "left").select("cls", "component", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"))
    out = written(rows.join(classes.select("v", "cls").join(per_class, "cls"), "v", "left")
                  .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                          F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id")), "near-duplicates")
    drop_scratch(rows, classes, member, open_, whole, found)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
