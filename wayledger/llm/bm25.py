"""Exact BM25 top-k with block-max WAND pruning, per shard, merged exactly.

A shard is a bounded run of documents with its inverted index: per term the documents (by
their place in a block) and frequencies, and per block of ``BLOCK`` documents that hold it the
number of its postings, the largest frequency and the smallest length. From these a bound on
the term's contribution to the block follows once the global statistics are known, without
touching a posting. Shards are searched with global statistics, so their scores compare, and
the best k of all shards are the answer.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Scratch, single_rows, stored, table

SHARD_BYTES, SHARD_DOCS = 8 << 20, 20_000
BLOCK = 64
K1, B = 1.2, 0.75
#: Queries and their words that go to the tasks together; more take further passes.
MAX_QUERIES, MAX_WORDS = 4096, 1 << 20
#: Scores are compared after rounding to so many digits; pruning keeps this margin.
DIGITS, MARGIN = 6, 1e-5

INDEX = "shard string, ids array<bigint>, sizes array<bigint>, terms binary, dfs binary, docs binary, tfs binary, n_blocks binary, blocks binary, block_lens binary, block_tfs binary, block_sizes binary"
HITS = "query bigint, id bigint, score double"


def _packed(a: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the largest takes; that many come first."""
    width = np.min_scalar_type(a.max(initial=0)).itemsize
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def _shard(ids: list, sizes: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
    n = np.concatenate(sizes)
    h = np.concatenate(parts)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    term, first = np.unique(h[at], return_index=True)
    raw = lambda b: pa.array([b], pa.binary())
    d, which = doc[at], np.repeat(np.arange(len(term)), np.diff(np.append(first, len(at))))
    begin = np.ones(len(d), bool)
    begin[1:] = (which[1:] != which[:-1]) | (d[1:] // BLOCK != d[:-1] // BLOCK)
    b = np.flatnonzero(begin)
    most, least = (np.maximum.reduceat(tf, b), np.minimum.reduceat(n[d], b)) if len(b) else (b, b)
    arrays = [
        pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), raw(term.astype("<u8").tobytes()),
        *(raw(_packed(x)) for x in (np.diff(np.append(first, len(at))), d % BLOCK, tf, np.bincount(which[b], minlength=len(term)), d[b] // BLOCK, np.diff(np.append(b, len(d))), most, least)),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split(" ")[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", store=stored) -> DataFrame:
    """The shards of every document, written to the shared folder. Null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, parts, held = [], [], [], 0
        for batch in batches:
            for lo, hi, data, off in tb.blocks(batch.column(1)):
                w = tb.words(data, off, tb.WORD_CHARS)
                ids += batch.column(0)[lo:hi].to_pylist()
                sizes.append(np.diff(w.first))
                parts.append(w.hash)
                held += len(data)
                if held >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield _shard(ids, sizes, parts)
                    ids, sizes, parts, held = [], [], [], 0
        if ids:
            yield _shard(ids, sizes, parts)

    return store(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, INDEX), "bm25", large_rows=True)


def _gain(tf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


class Shard:
    """One row of the index; the lists of ``vocab`` words with their global weights."""

    def __init__(self, row: dict, vocab: np.ndarray, weight: np.ndarray, mean: float):
        ints = {c: _unpacked(row[c]) for c in ("docs", "tfs", "n_blocks", "blocks", "block_lens", "block_tfs", "block_sizes")}
        term = np.frombuffer(row["terms"], "<u8")
        _, mine, have = np.intersect1d(vocab, term, assume_unique=True, return_indices=True)
        last = np.cumsum(ints["n_blocks"])
        self.ids, self.sizes, self.mean = row["ids"], np.asarray(row["sizes"], np.int64), mean
        self.docs, self.tfs = np.repeat(ints["blocks"] * BLOCK, ints["block_lens"]) + ints["docs"], ints["tfs"]
        self.count = -(-len(self.sizes) // BLOCK)
        ends = np.cumsum(ints["block_lens"])
        begins = np.concatenate([[0], ends])
        self.lists = {}
        for i, j in zip(mine, have, strict=True):
            own = slice(last[j] - ints["n_blocks"][j], last[j])
            bound = weight[i] * _gain(ints["block_tfs"][own], ints["block_sizes"][own], mean)
            self.lists[int(vocab[i])] = (weight[i], ints["blocks"][own], bound, begins[own], ends[own])

    def top(self, words: np.ndarray, k: int) -> tuple[list[tuple[float, int]], int, int]:
        """The best k (score, document), and all that tie with the k-th; postings scored, and
        postings of the words in all.

        The block with the highest bound gives a first threshold. Then the document pointer
        moves to the next block whose bounds can reach the threshold (the pivot), past all
        others. In a block the words go from the highest bound down, and it is left as soon as
        the bounds that remain lift none of its documents over the threshold.
        """
        lists = [self.lists[int(t)] for t in words if int(t) in self.lists]
        if not lists:
            return [], 0, 0
        which = np.repeat(np.arange(len(lists)), [len(x[1]) for x in lists])
        block, bound, begin, end = (np.concatenate([x[c] for x in lists]) for c in (1, 2, 3, 4))
        total = np.bincount(block, weights=bound, minlength=self.count)
        order = np.lexsort((-bound, block))
        at = np.searchsorted(block[order], np.arange(self.count + 1))
        heap: list[float] = []
        found: list[tuple[float, int]] = []
        scored = 0

        def visit(b: int, floor: float) -> None:
            nonlocal scored
            score, alive, rest = np.zeros(BLOCK), np.ones(BLOCK, bool), total[b]
            for e in order[at[b] : at[b + 1]]:
                p = slice(begin[e], end[e])
                docs = self.docs[p]
                score[docs - b * BLOCK] += lists[which[e]][0] * _gain(self.tfs[p], self.sizes[docs], self.mean)
                scored += len(docs)
                rest -= bound[e]
                alive = score + rest >= floor - MARGIN
                if not alive.any():
                    return
            for d in np.flatnonzero(alive & (score > 0)):
                found.append((float(score[d]), int(b * BLOCK + d)))
                if len(heap) < k:
                    heapq.heappush(heap, float(score[d]))
                elif score[d] > heap[0]:
                    heapq.heapreplace(heap, float(score[d]))

        first = int(np.argmax(total))
        visit(first, -1.0)
        pointer = 0
        while True:
            floor = heap[0] if len(heap) == k else -1.0
            pivot = np.flatnonzero(total[pointer:] >= max(floor - MARGIN, 1e-12))
            if not len(pivot):
                break
            pointer += int(pivot[0])
            if pointer != first:
                visit(pointer, floor)
            pointer += 1
        floor = heap[0] if len(heap) == k else 0.0
        return [x for x in found if x[0] >= floor - MARGIN], scored, int((end - begin).sum())


def _asked(queries: DataFrame) -> DataFrame:
    """(query, terms): the distinct words of every query that has any, hashed in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tb.blocks(batch.column(1)):
                w = tb.words(data, off, tb.WORD_CHARS)
                terms = [np.unique(w.hash[a:b]).view(np.int64) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(terms, pa.list_(pa.int64()))], names=["query", "terms"])

    return queries.mapInArrow(run, "query bigint, terms array<bigint>").where("size(terms) > 0")


def _query_blocks(asked: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(query, distinct words) of all queries, at most MAX_QUERIES and MAX_WORDS at a time;
    a query of more words is a block of its own. No text comes to the driver."""
    block, held = [], 0
    for query, terms in asked.toLocalIterator():
        words = np.asarray(terms, np.int64).view(np.uint64)
        if block and (len(block) >= MAX_QUERIES or held + len(words) > MAX_WORDS):
            yield block
            block, held = [], 0
        block.append((query, words))
        held += len(words)
    if block:
        yield block


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(index: DataFrame, asked: list[tuple[int, np.ndarray]], n_docs: int, mean: float, k: int) -> DataFrame:
    """``(query, id, score)``: the best of all shards for a block of queries."""
    vocab = np.unique(np.concatenate([q for _, q in asked]))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, n in zip(batch.column(0), batch.column(1), strict=True):
                _, mine, theirs = np.intersect1d(vocab, np.frombuffer(t.as_py(), "<u8"), assume_unique=True, return_indices=True)
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(_unpacked(n.as_py())[theirs])], names=["term", "n"])

    df = {r["term"]: r["n"] for r in index.select("terms", "dfs").mapInArrow(frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = np.array([df.get(i, 0) for i in range(len(vocab))])
    weight = np.log(1 + (n_docs - n + 0.5) / (n + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[r].as_py() for c in batch.schema.names}, vocab, weight, mean)
                out = [(q, shard.ids[d], s) for q, words in asked for s, d in shard.top(words, k)[0]]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query", "id", "score"])

    return index.mapInArrow(run, HITS).withColumn("score", F.round("score", DIGITS))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``(query_id, rank, id, score)``: the exact best ``k`` documents of every query.

    A query is the set of its distinct words; idf is log(1 + (N - df + 0.5) / (df + 0.5)) over
    all documents. Scores are rounded to ``DIGITS`` and ties go to the smaller id; documents
    without any query word are never returned. Null or wordless queries find nothing. Rows
    repeating an id are ranked on their own. Queries are searched in blocks of bounded size
    against the one stored index, so more queries cost more passes, not more memory. A task
    holds one shard at a time: shards, some MB each, are read and sent to Python one by one.
    """
    with Scratch(docs.sparkSession) as scratch:
        index = build_index(docs, id_col, text_col, scratch.stored)
        size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
        n_docs, n_words = index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
        mean = n_words / n_docs if n_words else 1.0
        rows = queries.select(F.col(query_id).cast("long"), F.col(query_text)).where(F.col(query_id).isNotNull())
        asked = scratch.stored(_asked(rows), "asked")
        found = []
        for block in _query_blocks(asked):
            with single_rows(docs.sparkSession):
                found.append(scratch.stored(_best(_search_block(index, block, n_docs, mean, k), k).drop("rank"), "hits"))
        hits = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], HITS)
        return scratch.result(_best(hits, k).select(F.col("query").alias(query_id), "rank", F.col("id").alias(id_col), "score"), "best")


def op5_bm25(spark, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0")
    return search(table(spark, sf_dir, "documents"), queries)


def op5_bm25_documents(spark, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20, whole, against all documents."""
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"), query_id="query_id")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
n AS (SELECT count(*) AS nd, sum(len(w)) / count(*)::DOUBLE AS mean FROM d),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS t FROM benchmark WHERE item_id % 20 = 0),
p AS (SELECT doc_id, t, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, unnest(w) AS t, len(w) AS size FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
f AS (SELECT t, ln(1 + (nd - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM p, n GROUP BY t, nd),
s AS (
  SELECT item_id, doc_id, round(sum(idf * tf * {K1 + 1}e0 / (tf + {K1}e0 * ({1 - B}e0 + {B}e0 * size / mean))), {DIGITS}) AS score
  FROM q JOIN p USING (t) JOIN f USING (t), n GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s QUALIFY rank <= 10
"""
OP5_DOCUMENTS_SQL = OP5_SQL.replace("DISTINCT item_id", "DISTINCT doc_id AS query_id").replace("benchmark WHERE item_id", "documents WHERE doc_id").replace("item_id", "query_id")
