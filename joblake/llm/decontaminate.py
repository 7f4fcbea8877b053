"""Operator 2: benchmark decontamination by greedy string tiling.

A benchmark item contaminates a document when tiles, word runs of at least
``min_match`` words that the two texts share, cover at least ``threshold`` of
the item's words. Tiles do not overlap in either text and may come in any
order, so a reordered passage is caught like a verbatim one.

* Seeds: rolling (Karp-Rabin) hashes of every ``min_match`` words. A Bloom
  filter of the benchmark's seeds, of fixed size, lets a document's seeds pass;
  those few are joined with the benchmark's seeds on the hash.
* Tiling: a common run of words is a run of seeds on one diagonal (place in the
  document minus place in the item). The longest run is marked first; runs that
  it cuts are trimmed to their unmarked pieces and compete again, until none
  of ``min_match`` words is left.

Words are ``[^\\x20\\x09-\\x0D]+``, lower-cased A-Z. Null or empty texts, on
either side, share nothing. An item with fewer than ``min_match`` words is one seed of
its own length, so a verbatim copy of it is found (its first place counts).
Repeated rows (same id and text) are one document or one item; null ids are
carried as they are. Extra columns of the documents are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from joblake.llm.common import batches, bit_table, has_bit
from joblake.llm.hashing import chunks, gram_hashes, texts_of, word_hashes
from joblake.session import scratch_table as written

BLOOM_BITS = 1 << 24
_GRAMS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("pos", pa.int64()), ("gram", pa.int64())])
_GRAMS_DDL = "key long, id long, n_words long, pos long, gram long"


def _bits(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = gram.view(np.uint64)
    return tuple((g >> np.uint64(s) & np.uint64(BLOOM_BITS - 1)).astype(np.int64) for s in (3, 37))


def _grams(rows: DataFrame, k: int, bloom=None, short: Iterable[int] = ()) -> DataFrame:
    """``rows(key, id, text)`` to one row per seed (that may be the
    benchmark's, with ``bloom``). ``short`` are lengths under ``k``: with
    ``bloom`` their seeds are taken too, once per text, else a text of such a
    length is one seed."""

    def run(it):
        table = bloom.value if bloom is not None else None
        for batch in it:
            keys, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            at = 0
            for part in chunks(texts_of(batch.column(2))):
                words, off = word_hashes(part)
                for n in (k, *short):
                    grams = gram_hashes(words, n)
                    start = np.arange(len(grams))
                    doc = np.searchsorted(off, start, side="right") - 1
                    keep = start + n <= off[doc + 1]
                    if table is not None:
                        one, two = _bits(grams)
                        keep &= has_bit(table, one)
                        keep[keep] = has_bit(table, two[keep])
                    elif n < k:
                        keep &= off[doc + 1] - off[doc] == n
                    start, doc, grams = start[keep], doc[keep], grams[keep]
                    if n < k and len(start):
                        order = np.lexsort((start, grams, doc))
                        new = np.append(True, (np.diff(doc[order]) != 0) | (grams[order][1:] != grams[order][:-1]))
                        start, doc, grams = start[order][new], doc[order][new], grams[order][new]
                    if len(start):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(keys[at + doc]), ids.take(pa.array(at + doc)), pa.array(off[doc + 1] - off[doc]),
                            pa.array(start - off[doc]), pa.array(grams.view(np.int64))], schema=_GRAMS)
                at += len(part)

    return rows.mapInArrow(run, _GRAMS_DDL)


def tiles(seeds: Iterable[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from the seeds ``(place in document, place in
    item)``: the tiles ``(place in document, place in item, words)``. Longest
    first; ties go to the earlier place in the document, then in the item."""
    diagonals: dict[int, list[int]] = {}
    for d, i in set(seeds):
        diagonals.setdefault(d - i, []).append(d)
    heap: list[tuple[int, int, int]] = []
    for off, places in diagonals.items():
        places.sort()
        first = prev = places[0]
        for p in [*places[1:], None]:
            if p != prev + 1:
                heap.append((first - prev - k, first, first - off))
                first = p
            prev = p if p is not None else prev
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    out = []
    while heap:
        n, d, i = heapq.heappop(heap)
        free = [d + j not in in_doc and i + j not in in_item for j in range(-n)]
        if all(free):
            in_doc.update(range(d, d - n))
            in_item.update(range(i, i - n))
            out.append((d, i, -n))
            continue
        start = None
        for j, ok in enumerate([*free, False]):
            if ok and start is None:
                start = j
            elif not ok and start is not None:
                if j - start >= k:
                    heapq.heappush(heap, (start - j, d + start, i + start))
                start = None
    return out


def contaminations(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(key, doc_id, item_id, n_words, covered, coverage, tiles)``: one row
    per document and benchmark item whose tiles cover ``threshold`` of it.
    ``tiles`` lists ``place in document:place in item:words``."""
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").where("text is not null").distinct()
    items = _grams(items.select(F.xxhash64(F.col("id").isNull(), "id", "text").alias("key"), "id", "text"), min_match, short=range(1, min_match))
    items = written(items, "item-seeds")
    short = sorted(r.n_words for r in items.where(F.col("n_words") < min_match).select("n_words").distinct().collect())
    spread = F.explode(F.array(*[F.shiftrightunsigned("gram", s).bitwiseAND(F.lit(BLOOM_BITS - 1)) for s in (3, 37)])).alias("bit")
    bloom = docs.sparkSession.sparkContext.broadcast(bit_table(items.select(spread), BLOOM_BITS))
    seeds = _grams(docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("id"), "text"), min_match, bloom, short)
    item = items.select("gram", F.col("key").alias("item"), F.col("id").alias("item_id"), F.col("n_words").alias("m"), F.col("pos").alias("at"))
    met = seeds.select("key", F.col("id").alias("doc_id"), "pos", "gram").join(item, "gram")

    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int64()),
                        ("covered", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.string())])

    def judged(group, seeds) -> Iterator[tuple]:
        key, _, doc_id, item_id, m = group
        found = tiles(seeds, min(min_match, m))
        covered = sum(t[2] for t in found)
        if covered >= threshold * m:
            yield key, doc_id, item_id, m, covered, covered / m, ",".join(f"{d}:{i}:{n}" for d, i, n in sorted(found))

    def rows(it):
        group, seeds = None, []
        for batch in it:
            for key, item, doc_id, item_id, m, pos, at in zip(*(c.to_pylist() for c in batch.columns)):
                if group is None or (key, item) != group[:2]:
                    if group is not None:
                        yield from judged(group, seeds)
                    group, seeds = (key, item, doc_id, item_id, m), []
                seeds.append((pos, at))
        if group is not None:
            yield from judged(group, seeds)

    # one document and item at a time, from rows sorted by Spark
    return (met.select("key", "item", "doc_id", "item_id", "m", "pos", "at").repartition("key", "item").sortWithinPartitions("key", "item", "pos")
            .mapInArrow(lambda it: batches(rows(it), schema), "key long, doc_id long, item_id long, n_words long, covered long, coverage double, tiles string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents that no benchmark item contaminates."""
    bad = contaminations(docs.select("doc_id", "text"), benchmark, min_match, threshold).select("key").distinct()
    rows = docs.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    return rows.join(bad, "key", "left_anti").select("d.*")
