"""Dense vectors learned from the texts: the leading right singular vectors of the
sparse term matrix, by randomised subspace iteration.

The rows of the term matrix stay where Spark put them. A pass multiplies every
row block by the present basis and back (``Aᵀ(A Q)``); each task adds up its own
rows, Spark adds up the tasks' sums feature block by feature block, and what comes
to the driver is one matrix of ``num_features × width`` numbers. Its size is fixed by
these two parameters (``MAX_BASIS`` entries at most), not by the corpus. The QR
factorisation of that matrix gives the next basis; a small symmetric eigenproblem
(Rayleigh-Ritz) turns the last one into singular vectors. Passes end when the singular
values asked for no longer change by more than ``tolerance``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from joblake.operators.vectors import text_features
from joblake.session import drop_scratch, scratch_table

FEATURE_BLOCK = 64
ENTRIES = 1 << 20  # cells of a block of rows, or of its product, a task holds at a time
BLOCK_ENTRIES = 1 << 14  # non-zero entries of such a block: it stays in the processor's cache
MAX_BASIS = 1 << 24  # entries of a basis: 128 MB on the driver and in every executor


def _slices(column: pa.StructArray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
    """``(row starts, indices, values, rows)`` of an Arrow batch of sparse rows, a
    bounded number of entries at a time; null rows are empty ones."""
    keep = column.is_valid()
    if column.type.get_field_index("type") >= 0 and pc.any(pc.equal(column.field("type"), 1)).as_py():
        raise ValueError("dense vectors: only sparse ones have indices")
    lists = pc.if_else(keep, column.field("indices"), pa.scalar([], column.field("indices").type))
    values = pc.if_else(keep, column.field("values"), pa.scalar([], column.field("values").type))
    ptr = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    idx = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    val = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at, most = 0, max(1, min(ENTRIES // max(1, width), BLOCK_ENTRIES))
    while at < len(column):
        # at least one row; rows are added while their entries, times the width, and the cells of their block stay bounded
        end = int(np.searchsorted(ptr, ptr[at] + most, side="right")) - 1
        end = min(max(end, at + 1), at + max(1, ENTRIES // most), len(column))
        a, b = ptr[at], ptr[end]
        yield ptr[at:end] - a, idx[a:b], val[a:b], slice(at, end)
        at = end


def _block(starts: np.ndarray, idx: np.ndarray, val: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """A few sparse rows as ``(features, rows × features)``, of the features they have only:
    one matrix product over them takes a fraction of the time of adding up entry by entry."""
    seen = np.zeros(d, dtype=bool)
    seen[idx] = True
    features = np.flatnonzero(seen)
    place = np.empty(d, dtype=np.int64)
    place[features] = np.arange(len(features))
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(idx))))
    cells = np.bincount(row * len(features) + place[idx], weights=val, minlength=len(starts) * len(features))
    return features, cells.reshape(len(starts), len(features))


def _times(starts: np.ndarray, idx: np.ndarray, val: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``A Q`` for a few sparse rows."""
    features, block = _block(starts, idx, val, len(basis))
    return block @ basis[features]


def _gram_times(rows: DataFrame, vec: str, basis: np.ndarray) -> np.ndarray:
    """``Aᵀ(A Q)`` over all rows."""
    d, width = basis.shape
    held = rows.sparkSession.sparkContext.broadcast(basis)

    def part(it):
        q = held.value
        total, seen = np.zeros(q.shape), False
        for batch in it:
            for starts, idx, val, _ in _slices(batch.column(0), q.shape[1]):
                seen = True
                features, block = _block(starts, idx, val, len(q))
                total[features] += block.T @ (block @ q[features])
        if seen:
            blocks = [total[b:b + FEATURE_BLOCK].ravel() for b in range(0, len(total), FEATURE_BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.array(blocks, pa.list_(pa.float64()))], names=["block", "x"])

    sums = (rows.select(vec).mapInArrow(part, "block long, x array<double>")
            .groupBy("block").agg(vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("x")))
    out = np.zeros((d, width))
    for r in sums.toLocalIterator():
        b = r["block"] * FEATURE_BLOCK
        out[b:b + FEATURE_BLOCK] = np.reshape(r["x"], (-1, width))
    held.destroy()
    return out


@dataclass
class Subspace:
    """``basis``: features × rank, orthonormal columns; ``values``: the singular
    values, largest first; ``passes``: how often the rows were read."""

    basis: np.ndarray
    values: np.ndarray
    passes: int


def fit_subspace(rows: DataFrame, num_features: int, rank: int, vec: str = "vec", extra: int = 16,
                 tolerance: float = 1e-3, max_passes: int = 12, seed: int = 1) -> Subspace:
    """The ``rank`` leading right singular vectors of the matrix whose rows are the
    sparse column ``vec`` (a sparse ML vector, or a struct with indices and values). Null and empty rows
    count as zero rows; without any other the rank is 0, and it is never more than
    the matrix has. Signs are set so that a vector's largest entry is positive."""
    width = min(num_features, rank + extra)
    if num_features * width > MAX_BASIS:
        raise ValueError(f"num_features * (rank + extra) is over {MAX_BASIS}: take fewer features or a smaller rank")
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((num_features, width)))[0]
    before, passes = None, 0
    while True:
        y = _gram_times(rows, vec, q)
        passes += 1
        small = q.T @ y
        eig, turn = np.linalg.eigh((small + small.T) / 2)
        values = np.sqrt(np.maximum(eig[::-1][:rank], 0.0))
        done = before is not None and np.all(np.abs(values - before) <= tolerance * max(values[0], 1e-300))
        if done or passes >= max_passes:
            break
        before, q = values, np.linalg.qr(y)[0]
    kept = int(np.sum(values > 1e-9 * max(values[0], 1e-300))) if len(values) else 0
    basis = (q @ turn[:, ::-1])[:, :kept]
    if kept:
        top = basis[np.abs(basis).argmax(axis=0), np.arange(kept)]
        basis = basis * np.where(top < 0, -1.0, 1.0)
    return Subspace(basis, values[:kept], passes)


def project(rows: DataFrame, space: Subspace, vec: str = "vec", out: str = "vec", unit: bool = True) -> DataFrame:
    """``rows`` with their sparse column ``vec`` replaced by its coordinates in the
    subspace, as ``out`` (array<double>), of length 1 with ``unit``. NULL for null
    and zero rows and for rows outside the subspace."""
    held = rows.sparkSession.sparkContext.broadcast(space.basis)
    rest = [c for c in rows.columns if c not in (vec, out)]
    at = len(rest)

    def run(it):
        q = held.value
        for batch in it:
            for starts, idx, val, span in _slices(batch.column(at), max(1, q.shape[1])):
                z = _times(starts, idx, val, q)
                size = np.linalg.norm(z, axis=1)
                gone = size <= 1e-12
                if unit:
                    z = z / np.where(gone, 1.0, size)[:, None]
                cells = pa.array([None if g else r for g, r in zip(gone, z)], pa.list_(pa.float64()))
                held_back = [batch.column(i).slice(span.start, span.stop - span.start) for i in range(at)]
                yield pa.RecordBatch.from_arrays([*held_back, cells], names=[*rest, out])

    asked = rows.select(*rest, F.col(vec).alias("__vec"))
    return asked.mapInArrow(run, rows.select(*rest).schema.add(out, ArrayType(DoubleType())))


@dataclass
class LatentModel:
    """Term weights and the subspace learned with them: one space for listings,
    profiles and any other text."""

    terms: PipelineModel
    space: Subspace

    def embed(self, df: DataFrame, text_col: str = "text", out: str = "vec") -> DataFrame:
        """``df`` with the unit vector of its text; NULL where no word is known."""
        kept = F.struct(*[c for c in df.columns if c != out]).alias("__row")
        src = df.select(kept, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        rows = self.terms.transform(src).select("__row", "_unit")
        return project(rows, self.space, "_unit", "__vec").select("__row.*", F.col("__vec").alias(out))


def fit_latent(texts: DataFrame, rank: int = 64, num_features: int = 1 << 13, text_col: str = "text", **how) -> LatentModel:
    """Fit term weights and subspace on all ``texts``. The texts are read into term counts
    once; counts and term matrix are written to the shared scratch folder, since every pass
    reads the matrix, and dropped. Counts are dealt out evenly, so that the passes keep every
    core busy however the texts are stored."""
    src = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words, tf, idf, unit = text_features(num_features).getStages()
    evenly = 2 * texts.sparkSession.sparkContext.defaultParallelism
    counts = scratch_table(tf.transform(words.transform(src)).select("_tf").repartition(evenly), "term-counts")
    weights = idf.fit(counts)
    rows = scratch_table(unit.transform(weights.transform(counts)).select("_unit"), "term-matrix")
    drop_scratch(counts)
    space = fit_subspace(rows, num_features, rank, vec="_unit", **how)
    drop_scratch(rows)
    return LatentModel(PipelineModel([words, tf, weights, unit]), space)


def rank_of_partner(found: DataFrame) -> DataFrame:
    """``found(query_id, job_id, rank)``, where a query's right answer carries its own
    id: (n, found_first, mean_reciprocal), a query without the answer counting 0."""
    best = found.groupBy("query_id").agg(F.max(F.when(F.col("job_id") == F.col("query_id"), 1.0 / F.col("rank")).otherwise(0.0)).alias("r"))
    return best.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("r") == 1.0).cast("double")).alias("found_first"), F.avg("r").alias("mean_reciprocal"))
