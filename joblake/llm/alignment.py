"""Operator 11: cross-tokenizer alignment by sparse products.

Each text is encoded by tokenizer A (a byte-level BPE file of ``tokenizers``, on a
space and the text) and tokenizer B (a byte-fallback BPE model of
``sentencepiece``, on the text, adding the space itself). A tokenizer's tokens by
the bytes they cover are a 0/1 incidence matrix, kept in hand-built CSR arrays.
Gustavson's row product ``A . B^T`` merges, for each A token, the B tokens of its
bytes: its entries are the overlap links, its values the bytes shared. Offsets at
which tokens of both end cut the text into groups; the incidences of tokens and
groups give, by the same product, the shared-group links.

No token of either tokenizer reaches over a blank between a visible character and
a letter or digit (for B this is looked up in its pieces; a model that has such
pieces gets whole texts). Texts are cut there, and as pieces repeat, each
different piece of a chunk of about ``chunk_bytes`` is encoded and aligned once.
The documents by pieces and the pieces by id pairs are matrices too, and their
product says how often each document links each pair.

Corpus-wide, a link's pair of ids counts how many links hold it. A chunk adds its
pairs' counts up before the shuffle. The corpus-wide counts come back to each
chunk as one vector, sorted to its rows, and a product of matrix and vector gives
every document's sums. Nothing is broadcast but one row per B id. A very long
text is taken a window at a time and costs its different pieces.

Null and empty texts, and texts whose A or B bytes differ from the space and the
text (normalised, or holding B's blank sign), have no tokens: zeros and an empty
string. Strings of special tokens in a text are plain text. Every row is a
document of its own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from joblake.llm.common import batches
from joblake.llm.hashing import texts_of
from joblake.session import drop_scratch, scratch_table as written

_CUT = re.compile(r"(?<=\S) (?=[^\W_])")
_WINDOW = 1 << 18  # characters cut at a time
_BATCH = 1 << 17  # characters encoded and aligned at a time
_ROWS = 1 << 16  # rows of a product at a time
_LIST = 4096  # pairs in a row of the written table


@dataclass
class Csr:
    """Row ``i`` has the columns ``col[start[i]:start[i + 1]]`` with ``val``."""

    start: np.ndarray
    col: np.ndarray
    val: np.ndarray
    width: int

    def transpose(self) -> Csr:
        order = np.argsort(self.col, kind="stable")
        row = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        return Csr(np.searchsorted(self.col[order], np.arange(self.width + 1)), row[order], self.val[order], len(self.start) - 1)

    def times(self, vector: np.ndarray) -> np.ndarray:
        """The product with a column vector."""
        total = np.append(0, np.cumsum(self.val * vector[self.col]))
        return total[self.start[1:]] - total[self.start[:-1]]


def incidence(column: np.ndarray, width: int) -> Csr:
    """Rows with one entry each."""
    return Csr(np.arange(len(column) + 1), column, np.ones(len(column), np.int64), width)


def covering(ends: np.ndarray) -> Csr:
    """Tokens by the bytes that they cover, from the offsets at which they end."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.append(0, ends), np.arange(n), np.ones(n, np.int64), n)


def gustavson(a: Csr, b: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries ``(row, column, value)`` of ``a . b``, a range of rows of ``a`` at
    a time: every entry of a row of ``a`` adds that row of ``b``, and what falls on
    the same column is added up."""
    size = np.diff(b.start)
    work = np.append(0, np.cumsum(size[a.col]))[a.start]  # products up to each row
    first, rows = 0, len(a.start) - 1
    while first < rows:
        last = max(first + 1, min(rows, int(np.searchsorted(work, work[first] + _ROWS, side="right")) - 1))
        s = slice(a.start[first], a.start[last])
        k, n = a.col[s], size[a.col[s]]
        row = np.repeat(np.repeat(np.arange(first, last), np.diff(a.start[first : last + 1])), n)
        at = np.repeat(b.start[k] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
        key, val = row * b.width + b.col[at], np.repeat(a.val[s], n) * b.val[at]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, val = key[order], val[order]
        if len(key):
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            yield key[new] // b.width, key[new] % b.width, np.add.reduceat(val, new)
        first = last


def _byte_signs() -> dict[str, int]:
    """The characters by which byte-level vocabularies write the 256 bytes:
    printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoders:
    """Both tokenizers, and the bytes of every id."""

    _loaded: dict[tuple[str, str], Encoders] = {}

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        sign = _byte_signs()
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(sign[c] for c in token) if all(c in sign for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self._encode_a = getattr(self.a, "encode_batch_fast", self.a.encode_batch)  # without offsets, where there is one
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        # an id in decimals and what follows it in a group: a comma, a bar or a semicolon
        self.words = [f"{i}{c}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for c in ",|;"]

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Encoders:
        """Loaded once per worker."""
        if (a_path, b_path) not in cls._loaded:
            cls._loaded[a_path, b_path] = cls(a_path, b_path)
        return cls._loaded[a_path, b_path]

    def pieces(self, text: str | None) -> Iterator[list[str]]:
        """The text in pieces that both tokenizers encode independently, some at
        a time; every piece stands for a blank and itself."""
        at = 0
        while text and self.cuts and len(text) - at > _WINDOW:
            m = _CUT.search(text, at + _WINDOW)
            if m is None:
                break
            yield _CUT.split(text[at : m.start()])
            at = m.end()
        if text:
            yield _CUT.split(text[at:] if at else text) if self.cuts else [text]

    def _ids_of_a(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of A, and how many each piece has. Pieces that begin and end
        as cuts do are encoded as one text and told apart by their bytes."""
        inner = [i for i, p in enumerate(pieces) if self.cuts and p[0].isalnum() and not p[-1].isspace()]
        size = np.array([len(pieces[i].encode("utf-8", "surrogatepass")) + 1 for i in inner], np.int64)
        ids = np.array(self._encode_a(["".join([" " + pieces[i] for i in inner])], add_special_tokens=False)[0].ids if inner else [], np.int64)
        ends = np.cumsum(self.a_size[ids])
        count = np.zeros(len(pieces), np.int64)
        if inner and int(ends[-1]) == int(size.sum()):
            count[inner] = np.diff(np.append(0, np.searchsorted(ends, np.cumsum(size), side="right")))
            rest = np.setdiff1d(np.arange(len(pieces)), inner).tolist()
        else:
            ids, inner, rest = ids[:0], [], list(range(len(pieces)))
        if not rest:
            return ids, count
        other = [e.ids for e in self._encode_a([" " + pieces[i] for i in rest], add_special_tokens=False)]
        count[rest] = [len(x) for x in other]
        first = np.append(0, np.cumsum(count))
        out = np.empty(first[-1], np.int64)
        own = np.zeros(len(out), bool)
        for i, x in zip(rest, other):
            out[first[i] : first[i + 1]] = x
            own[first[i] : first[i + 1]] = True
        out[~own] = ids
        return out, count

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(spelled, a, n_a, b, n_b)``: the ids of A and of B, one piece after the
        other, and how many each has; none for a piece that they do not spell."""
        a, n_a = self._ids_of_a(pieces)
        lists = self.b.encode(pieces, num_threads=1) if pieces else []
        b, n_b = np.fromiter(itertools.chain.from_iterable(lists), np.int64), np.array([len(x) for x in lists], np.int64)
        whole = [b" " + p.encode("utf-8", "surrogatepass") for p in pieces]
        size, joined, ok = np.array([len(w) for w in whole], np.int64), b"".join(whole), np.ones(len(pieces), bool)
        for ids, n, sizes, table in ((a, n_a, self.a_size, self.a_bytes), (b, n_b, self.b_size, self.b_bytes)):
            spelled = b"".join(map(table.__getitem__, ids.tolist()))
            got = np.diff(np.append(0, np.cumsum(sizes[ids]))[np.append(0, np.cumsum(n))])
            if spelled != joined or (got != size).any():
                ends = np.cumsum(got).tolist()
                ok &= [spelled[s:e] == w for s, e, w in zip([0, *ends], ends, whole)]
        return ok, a[np.repeat(ok, n_a)], n_a * ok, b[np.repeat(ok, n_b)], n_b * ok

    def encode_text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of A and of B for a whole text."""
        parts = [self.encode(pieces) for pieces in self.pieces(text)]
        none = [np.empty(0, np.int64)]
        if not all(x[0].all() for x in parts):
            return none[0], none[0]
        return np.concatenate(none + [x[1] for x in parts]), np.concatenate(none + [x[3] for x in parts])


class Alignment:
    """The tokens of some texts, one after the other, and their matrices."""

    def __init__(self, enc: Encoders, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray):
        self.a, self.n_a, self.b, self.n_b = a, n_a, b, n_b
        self.doc_a = np.repeat(np.arange(len(n_a)), n_a)
        self.a_ends, self.b_ends = np.cumsum(enc.a_size[self.a]), np.cumsum(enc.b_size[self.b])
        self.group_ends = np.intersect1d(self.a_ends, self.b_ends)
        self.a_group, self.b_group = (np.searchsorted(self.group_ends, e) for e in (self.a_ends, self.b_ends))
        self._words = enc.words

    def overlap_links(self):
        """``(A token, B token, bytes shared)``."""
        return gustavson(covering(self.a_ends), covering(self.b_ends).transpose())

    def group_links(self):
        """``(A token, B token, 1)`` for the tokens of one group."""
        n = len(self.group_ends)
        return gustavson(incidence(self.a_group, n), incidence(self.b_group, n).transpose())

    def n_groups(self) -> np.ndarray:
        """Groups per text."""
        first = np.append(True, self.a_group[1:] != self.a_group[:-1]) if len(self.a_group) else np.empty(0, bool)
        return np.bincount(self.doc_a, weights=first, minlength=len(self.n_a)).astype(np.int64)

    def spelled(self) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        n = len(self.group_ends)
        in_a, in_b = (np.searchsorted(g, np.arange(n + 1)) for g in (self.a_group, self.b_group))
        word = np.empty(len(self.a) + len(self.b), np.int64)
        last_a = np.append(self.a_group[1:] != self.a_group[:-1], True) if len(self.a) else np.empty(0, bool)
        last_b = np.append(self.b_group[1:] != self.b_group[:-1], True) if len(self.b) else np.empty(0, bool)
        word[np.arange(len(self.a)) + in_b[self.a_group]] = self.a * 3 + last_a
        word[np.arange(len(self.b)) + in_a[self.b_group + 1]] = self.b * 3 + 2 * last_b
        words = list(map(self._words.__getitem__, word.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(words[s:e])[:-1] for s, e in zip([0, *ends], ends)]


def _some(texts: list[str], limit: int = _BATCH) -> Iterator[list[str]]:
    """Consecutive texts of about ``limit`` characters, or one longer text."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > limit:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


_LINKS = "doc_id long, a_pos long, a_id int, b_pos long, b_id int, n_bytes int"


def token_links(docs: DataFrame, a_path: str, b_path: str, groups: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row per link: the positions and ids of
    an A and a B token, and the bytes that they share (with ``groups``: the
    tokens of one group, 1)."""

    def rows(it):
        enc = Encoders.of(a_path, b_path)
        for batch in it:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                a, b = enc.encode_text(text)
                x = Alignment(enc, a, np.array([len(a)]), b, np.array([len(b)]))
                for i, j, v in (x.group_links() if groups else x.overlap_links()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(i), pa.int64()), pa.array(i), pa.array(x.a[i].astype(np.int32)), pa.array(j), pa.array(x.b[j].astype(np.int32)), pa.array(v.astype(np.int32))],
                        names=["doc_id", "a_pos", "a_id", "b_pos", "b_id", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, _LINKS)


_CHUNK = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                    ("n_links", pa.int64()), ("groups", pa.string()), ("groups_sha256", pa.string()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
                    ("first", pa.int32()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_CHUNK_DDL = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, at array<int>, "
              "times array<int>, first int, pairs array<long>, counts array<long>")
_DOCUMENT = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


class Chunk:
    """Some documents as rows of different pieces."""

    def __init__(self, enc: Encoders):
        self.enc, self.number, self.ids, self.rows, self.size = enc, {}, [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        number, row = self.number, [np.empty(0, np.int64)]
        for pieces in self.enc.pieces(text):
            row.append(np.array([number.setdefault(p, len(number)) for p in pieces], np.int64))
        self.ids.append(doc_id)
        self.rows.append(np.concatenate(row))
        self.size += len(text or "")

    def _aligned(self):
        """Per piece: whether it is spelled, its counts of A and B tokens and of
        groups, its groups as text; and the matrix of pieces by id pairs."""
        ok, counts, spelled, of, pair, first = [np.empty(0, bool)], [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for part in _some(list(self.number)):
            spells, *tokens = self.enc.encode(part)
            ok.append(spells)
            x = Alignment(self.enc, *tokens)
            counts.append(np.stack([x.n_a, x.n_b, x.n_groups()]))
            spelled += x.spelled()
            for i, j, _ in x.overlap_links():
                of.append(first + x.doc_a[i])
                pair.append(x.a[i] << 32 | x.b[j])
            first += len(part)
        pairs, col = np.unique(np.concatenate(pair), return_inverse=True)
        of = np.concatenate(of)
        links = Csr(np.searchsorted(of, np.arange(first + 1)), col, np.ones(len(col), np.int64), len(pairs))
        return np.concatenate(ok), np.concatenate([np.zeros((3, 0), np.int64), *counts], axis=1), spelled, links, pairs

    def finished(self, chunk: int, keep_groups: bool) -> Iterator[tuple]:
        """The rows of the written table."""
        ok, counts, spelled, links, pairs = self._aligned()
        rows = [r if ok[r].all() else r[:0] for r in self.rows]
        held = [np.unique(r, return_counts=True) for r in rows]
        none = np.empty(0, np.int64)
        docs = Csr(np.append(0, np.cumsum([len(c) for c, _ in held])), np.concatenate([none, *(c for c, _ in held)]), np.concatenate([none, *(n for _, n in held)]), len(ok))
        n_a, n_b, n_groups, n_links = (docs.times(v) for v in (*counts, np.diff(links.start)))
        total, d = np.zeros(len(pairs), np.int64), 0
        at, times = [none], [none]  # of document d, so far

        def row():
            r = rows[d].tolist()
            digest = hashlib.sha256()
            for s in range(0, len(r), _ROWS):
                digest.update((";" * (s > 0) + ";".join([spelled[i] for i in r[s : s + _ROWS]])).encode())
            return (chunk, self.ids[d], int(n_a[d]), int(n_b[d]), int(n_groups[d]), int(n_links[d]), ";".join([spelled[i] for i in r]) if keep_groups else None,
                    digest.hexdigest() if r else "", np.concatenate(at), np.concatenate(times), None, None, None)

        for i, j, n in gustavson(docs, links):
            np.add.at(total, j, n)
            edge = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(i)]):
                while d < i[s]:
                    yield row()
                    d, at, times = d + 1, [none], [none]
                at.append(j[s:e])
                times.append(n[s:e])
        while d < len(rows):
            yield row()
            d, at, times = d + 1, [none], [none]
        for s in range(0, len(pairs), _LIST):
            yield (chunk, *[None] * 9, s, pairs[s : s + _LIST], total[s : s + _LIST])


def _chunks(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int, keep_groups: bool) -> DataFrame:
    """Rows of two kinds. Of a document: its counts and its row of the matrix of
    documents by id pairs (``at``, ``times``). Of a chunk: its different pairs
    from number ``first`` on, with their counts in the chunk."""

    def rows(it):
        enc = Encoders.of(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk(enc)
        for batch in it:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                chunk.add(doc, text)
                if chunk.size >= chunk_bytes:
                    yield from chunk.finished(number, keep_groups)
                    chunk, number = Chunk(enc), number + 1
        if chunk.ids:
            yield from chunk.finished(number, keep_groups)

    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(lambda it: batches(rows(it), _CHUNK, 200), _CHUNK_DDL))


_SUMS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                   ("groups", pa.string()), ("groups_sha256", pa.string()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = 4 << 20, keep_groups: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row per document: ``(doc_id, n_a, n_b,
    n_groups, n_links, groups, groups_sha256, n_best, count_sum)``. ``n_best``
    counts the links whose pair is its B id's most frequent in the corpus (ties
    included), ``count_sum`` adds up the pairs' counts over the links. ``groups``
    is the text of the groups where ``keep_groups`` asks for it, else null."""
    held = written(_chunks(docs, a_path, b_path, chunk_bytes, keep_groups), "alignment")
    parts = held.where("first is not null").select("chunk", "first", "pairs", "counts")
    one = parts.select("chunk", "first", F.posexplode(F.arrays_zip("pairs", "counts")).alias("i", "p")).select("chunk", (F.col("first") + F.col("i")).alias("first"), "p.pairs", "p.counts")
    counts = written(one.groupBy("pairs").agg(F.sum("counts").alias("n")), "pair-counts")
    b_id = F.col("pairs").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # a row per B id
    told = counts.join(F.broadcast(most), b_id == F.col("b")).select("pairs", "n", (F.col("n") == F.col("most")).alias("best"))
    looked = one.join(told, "pairs").select("chunk", "first", "n", "best", *[F.lit(None).cast(t).alias(c) for c, t in _ROW])
    rows = held.where("first is null").select("chunk", F.lit(-1).alias("first"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("best"), *[c for c, _ in _ROW])
    # a chunk's counts, then its documents
    sorted_ = looked.unionByName(rows).repartition("chunk").sortWithinPartitions("chunk", F.col("first") < 0, "first")

    def sums(it):
        now, n, best = None, [], []
        for batch in it:
            chunk, first = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s, e in _runs(chunk * 2 + (first < 0)):
                if chunk[s] != now:
                    now, n, best = chunk[s], [], []
                if first[s] >= 0:
                    n.append(batch.column(2).slice(s, e - s).to_numpy())
                    best.append(batch.column(3).slice(s, e - s).to_numpy(zero_copy_only=False).astype(np.int64))
                    continue
                n, best = ([np.concatenate([np.empty(0, np.int64), *x])] for x in (n, best))
                col = [c.slice(s, e - s) for c in batch.columns[4:]]
                start = np.append(0, np.cumsum(pc.list_value_length(col[-2]).to_numpy()))
                matrix = Csr(start, col[-2].flatten().to_numpy().astype(np.int64), col[-1].flatten().to_numpy().astype(np.int64), len(n[0]))
                yield pa.RecordBatch.from_arrays([*col[:-2], pa.array(matrix.times(best[0])), pa.array(matrix.times(n[0]))], schema=_SUMS)

    out = written(sorted_.mapInArrow(sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, n_best long, count_sum long"), "aligned")
    drop_scratch(held, counts)
    return out


_ROW = [*((c, "long") for c in _DOCUMENT), ("groups", "string"), ("groups_sha256", "string"), ("at", "array<int>"), ("times", "array<int>")]


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    yield from zip(edge.tolist(), [*edge[1:].tolist(), len(key)])
