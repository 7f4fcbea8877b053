"""Operator 13: ranked lexical search, reversed: the items are indexed and the
documents stream through the index.

Terms are the maximal runs of digits, ASCII letters (lower-cased) and characters
beyond ASCII. The items' terms make an inverted index ``term -> (item, times)``
that every task holds. A first pass counts, per document, its terms and those of
them that some item has, and writes that small table; its sums give the
statistics ``N``, ``L`` and ``df`` over all documents. A second pass streams the
documents' counts through the index: a document's score for all items at once,
offered to one bounded heap per item. The tasks' heaps are merged in two steps.

Score: ``sum of w * ((10^9 * tf) div (1000 * tf + 8 * m))`` over the item's
terms, repeats included, with ``w = floor(1000 * ln((2N + 2) / (2 df + 1)))`` and
``m = 25 + (75 * n * N) div L``, in 64-bit integers.

The index is cut into blocks of about ``block_terms`` postings by a hash of the
item, and the documents are read once per block, so what a task holds does not
grow with the number of items (a single item's terms stay together). A text is
cut into pieces of ``_PIECE`` bytes at the end of a term, so a very long one
costs its distinct terms only.

Rows of one item id are one item with all their terms; a null id is an id of
its own. Every row of ``docs`` is a document, repeated ids too; a null id comes
last among equal scores. Null and empty texts have no terms: such a document
is not counted and an item without terms finds nothing. An empty table on either
side gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from joblake.llm.common import batches
from joblake.llm.hashing import texts_of
from joblake.session import drop_scratch, scratch_table as written

_PIECE = 1 << 20
_CELLS = 1 << 21  # scores or postings worked on at a time
_MERGE = 256  # tasks whose heaps are merged in the first step
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")

RESULT = "item_id long, rank int, doc_id long, score long"


def pieces(text: str | None) -> Iterator[bytes]:
    """The lower-cased text in UTF-8, cut between terms."""
    b = (text or "").encode("utf-8", "surrogatepass").lower()
    at = 0
    while len(b) - at > _PIECE:
        gap = _GAP.search(b, at + _PIECE)
        if gap is None:
            break
        yield b[at : gap.start()]
        at = gap.start()
    yield b[at:] if at else b


def term_counts(text: str | None, number=None) -> tuple[int, Counter]:
    """How many terms the text has, and how often each of them; with a mapping
    ``number``, only those in it, by their number."""
    n, out = 0, Counter()
    for piece in pieces(text):
        terms = _TERM.findall(piece)
        n += len(terms)
        out.update(terms if number is None else map(number.get, terms))
    if number is not None:
        out.pop(None, None)
    return n, out


@dataclass
class ItemIndex:
    """Postings by term: those of term ``t`` are ``items`` and ``times`` from
    ``start[t]`` to ``start[t + 1]``."""

    number: dict[bytes, int]
    ids: list
    start: np.ndarray
    items: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(rows) -> ItemIndex:
        """From ``(item_id, term, times)`` rows."""
        ids = sorted({r["item_id"] for r in rows}, key=lambda x: (x is None, x or 0))
        place = {x: i for i, x in enumerate(ids)}
        number = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        term = np.fromiter((number[bytes(r["term"])] for r in rows), np.int64, len(rows))
        order = np.argsort(term, kind="stable")
        return ItemIndex(number, ids, np.searchsorted(term[order], np.arange(len(number) + 1)),
                         np.fromiter((place[r["item_id"]] for r in rows), np.int64, len(rows))[order],
                         np.fromiter((r["times"] for r in rows), np.int64, len(rows))[order])


class TopItems:
    """A heap of the ``k`` best documents for each item."""

    def __init__(self, index: ItemIndex, weight: np.ndarray, docs: int, terms: int, k: int):
        self.index, self.weight, self.docs, self.terms, self.k = index, weight, docs, terms, k
        self.heaps: list[list] = [[] for _ in index.ids]
        self.floor = np.ones(len(index.ids), np.int64)  # the least score that can still enter

    def offer(self, doc_ids: list, n: np.ndarray, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> None:
        """Documents with their number of terms ``n`` and, one document after the
        other, ``size`` terms of the index each."""
        x = self.index
        cost = np.add.reduceat(np.append(x.start[term + 1] - x.start[term], 0), np.append(0, np.cumsum(size))[:-1]) if len(size) else size
        cost = np.where(size > 0, cost, 0) + len(x.ids)
        upto, part, first = np.append(0, np.cumsum(size)), np.cumsum(cost) // _CELLS, 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(part, part[first], side="right")))
            s = slice(upto[first], upto[last])
            self._offer(doc_ids[first:last], n[first:last], term[s], tf[s], size[first:last])
            first = last

    def _offer(self, doc_ids, n, term, tf, size) -> None:
        x, width = self.index, len(self.index.ids)
        doc = np.repeat(np.arange(len(n)), size)
        m = 25 + 75 * n * self.docs // self.terms
        gain = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        many = x.start[term + 1] - x.start[term]
        at = np.repeat(x.start[term] - np.append(0, np.cumsum(many))[:-1], many) + np.arange(many.sum())
        score = np.zeros(len(n) * width, np.int64)
        np.add.at(score, np.repeat(doc, many) * width + x.items[at], np.repeat(gain, many) * x.times[at])
        score = score.reshape(len(n), width)
        least = self.floor
        if len(n) > self.k:
            least = np.maximum(least, np.partition(score, len(n) - self.k, axis=0)[len(n) - self.k])
        d, i = np.nonzero(score >= least)
        known = np.array([v is not None for v in doc_ids])[d]
        ids = np.array([v or 0 for v in doc_ids], np.int64)[d]
        order = np.lexsort((ids, ~known, -score[d, i], i))
        d, i = d[order], i[order]
        within = np.arange(len(i)) - np.searchsorted(i, i)  # of equal scores at the end of the list, the smallest ids
        for d, i in zip(d[within < self.k].tolist(), i[within < self.k].tolist()):
            entry = (int(score[d, i]), doc_ids[d] is not None, -(doc_ids[d] or 0))
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.floor[i] = heap[0][0]

    def entries(self) -> Iterator[tuple]:
        for item, heap in zip(self.index.ids, self.heaps):
            for score, known, doc in heap:
                yield item, -doc if known else None, score


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
_TERMS = pa.schema([("item_id", pa.int64()), ("term", pa.binary()), ("times", pa.int64())])
_TOP = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _item_terms(items: DataFrame) -> DataFrame:
    def rows(it):
        for batch in it:
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                for term, times in term_counts(text)[1].items():
                    yield item, term, times

    return (items.select(F.col("item_id").cast("long"), "text").mapInArrow(lambda it: batches(rows(it), _TERMS), "item_id long, term binary, times long")
            .groupBy("item_id", "term").agg(F.sum("times").alias("times")))


def _document_counts(docs: DataFrame, held) -> DataFrame:
    def rows(it):
        number = held.value.number
        for batch in it:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                n, found = term_counts(text, number)
                if n:
                    yield doc, n, list(found.keys()), list(found.values())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: batches(rows(it), _COUNTS, 500), "doc_id long, n long, terms array<int>, tfs array<long>")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 1 << 18) -> DataFrame:
    """``docs(doc_id, text, ...)`` and ``items(item_id, text, ...)``: each item's
    ``k`` highest-scoring documents with a score above 0 (all, if fewer), equal
    scores by the smaller id: ``(item_id, rank, doc_id, score)``."""
    spark = docs.sparkSession
    terms = written(_item_terms(items), "item-terms")
    blocks = -(-terms.count() // block_terms)
    found = spark.createDataFrame([], RESULT)
    totals = None
    for b in range(blocks):
        index = ItemIndex.of(terms.where(F.pmod(F.xxhash64(F.col("item_id").isNull(), "item_id"), F.lit(blocks)) == b).collect())
        if not index.ids:
            continue
        held = spark.sparkContext.broadcast(index)
        counts = written(_document_counts(docs, held), "term-counts")
        totals = totals or counts.agg(F.count(F.lit(1)), F.sum("n")).first()  # N and L; the same for every block
        df = np.zeros(len(index.number), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).collect():
            df[r["t"]] = r["c"]
        weight = np.floor(1000 * np.log((2 * totals[0] + 2) / (2 * df + 1))).astype(np.int64)

        def best(it, held=held, weight=weight):
            top = TopItems(held.value, weight, *totals, k)
            for batch in it:
                top.offer(batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64),
                          batch.column(3).flatten().to_numpy(), pc.list_value_length(batch.column(2)).to_numpy())
            yield from batches(top.entries(), _TOP)

        heaps = counts.mapInArrow(best, "item_id long, doc_id long, score long").withColumn("part", F.expr(f"spark_partition_id() div {_MERGE}"))
        by = [F.desc("score"), F.asc_nulls_last("doc_id")]
        some = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*by))).where(F.col("rank") <= k)
        rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*by))
        found = found.unionByName(written(some.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked"))
        drop_scratch(counts)
    drop_scratch(terms)
    return found


def oracle(k: int, docs: str = "documents", items: str = "benchmark") -> str:
    """The same by a join of all terms."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = rf"unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM {docs}),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, {terms} AS term FROM numbered) GROUP BY r, doc_id, term),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
item AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {terms} AS term FROM {items}) GROUP BY item_id, term),
scored AS (
  SELECT item_id, tf.r, tf.doc_id,
         sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM item JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.r = tf.r CROSS JOIN total GROUP BY item_id, tf.r, tf.doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= {k}"""
