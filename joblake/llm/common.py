"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bit_table(bits: DataFrame, n_bits: int) -> np.ndarray:
    """A bit array of ``n_bits`` (a power of two) in which every value of the
    long column ``bit`` is set, built by the executors; at most ``n_bits / 64``
    words come to the driver, however many rows there are."""
    rows = (bits.groupBy(F.shiftright("bit", 6).cast("int").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
            .toPandas())
    out = np.zeros(n_bits // 64, np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64).view(np.uint64)
    return out


def has_bit(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the bit positions ``at`` are set."""
    at = at.astype(np.int64, copy=False)
    return (table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def bloom_bits(ids: DataFrame, col: str, n_bits: int) -> np.ndarray:
    """The bit table of a Bloom filter, with two bits set per value of ``col``."""
    return bit_table(ids.select(F.explode(F.array(*bloom_has(F.col(col), n_bits))).alias("bit")), n_bits)


def bloom_has(col: Column, n_bits: int) -> tuple[Column, Column]:
    """The two bit positions that :func:`bloom_bits` sets for a value."""
    return tuple(F.pmod(F.xxhash64(col, F.lit(s)), F.lit(n_bits)) for s in (1, 2))


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
