"""Ranked lexical search over posting lists that are cut into blocks of similar documents.

A forward index (documents with their terms) is written once. For a block of queries the
documents are projected on the queries' words and indexed shard by shard: the shard's
documents are laid into a similarity tree, every posting list is cut along that tree into
blocks of its own documents, and each block stores the coordinatewise maximum of its
documents. The product of a query with it bounds the score of every document of the block in
exact integers, so a block is skipped only if none of its documents can be among the best.

    g(document, term) = (10**9 * tf) div (1000 * tf + 20 * m),  m = 50 + (50 * n * N) div L
    score = sum of w(term) * g(document, term),  w = floor(1000 * ln((2N + 2) / (2df + 1)))
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Scratch, single_rows, table
from .phrase_index import _planes, _unplanes

#: Text bytes and documents of one shard; they bound a row of the index.
SHARD_BYTES, SHARD_DOCS = 2 << 20, 20_000
#: Postings of one block at most, and of a list that is read without a look at summaries.
BLOCK, SHORT = 256, 64
#: Documents of a leaf of the similarity tree, its depth, and the dimensions it looks at.
LEAF, DEPTH, DIMENSIONS = 16, 20, 16
#: Queries and their words that are searched together; more take further passes.
MAX_QUERIES, MAX_WORDS = 4096, 1 << 18
#: Cells of the dense table in which summaries are gathered.
CELLS = 1 << 20
NO_ID = np.iinfo(np.int64).max

FORWARD = "shard string, ids array<bigint>, sizes array<bigint>, terms binary, counts binary, places binary, tfs binary"
_INTS = ("counts", "words", "gains", "lists", "list_sizes", "list_blocks", "docs", "block_sizes", "summary_sizes", "coordinates", "maxima")
BLOCKS = "shard string, ids array<bigint>, " + ", ".join(f"{c} binary" for c in _INTS)
HITS = "query bigint, id bigint, score bigint"


def _forward(ids: list, sizes: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
    n, h = np.concatenate(sizes), np.concatenate(parts)
    term, place = np.unique(h, return_inverse=True)
    key, tf = np.unique(np.repeat(np.arange(len(n)), n) * max(len(term), 1) + place, return_counts=True)
    doc, place = np.divmod(key, max(len(term), 1))
    counts = np.bincount(doc.astype(np.int64), minlength=len(n))
    raw = [pa.array([x], pa.binary()) for x in (term.tobytes(), _planes(counts), _planes(place), _planes(tf))]
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), *raw], names=[c.split(" ")[0] for c in FORWARD.split(", ")])


def forward_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, store) -> DataFrame:
    """Shards of whole documents: their lengths and, by document, terms with frequencies.
    A null text has no terms; a null id is kept as such."""

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
                    yield _forward(ids, sizes, parts)
                    ids, sizes, parts, held = [], [], [], 0
        if ids:
            yield _forward(ids, sizes, parts)

    return store(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, FORWARD), "forward", True)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of every pair, end to end."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)


def similarity_codes(sketch: np.ndarray) -> np.ndarray:
    """The leaf of each document in a tree that halves the documents, as a path of DEPTH bits:
    documents with a longer common prefix are nearer to each other."""
    codes = np.zeros(len(sketch), np.int64)
    todo = [(np.arange(len(sketch)), DEPTH - 1)]
    while todo:
        own, bit = todo.pop()
        if len(own) <= LEAF or bit < 0:
            continue
        x = sketch[own]
        spread = x.max(0) - x.min(0)
        along = int(np.argmax(spread))
        if spread[along] <= 0:
            continue
        half = np.argpartition(x[:, along], len(own) // 2)
        left, right = own[half[: len(own) // 2]], own[half[len(own) // 2 :]]
        codes[right] |= 1 << bit
        todo += [(left, bit - 1), (right, bit - 1)]
    return codes


def cut_lists(term: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which postings (sorted by term and code) begin a block: the largest subtrees that hold
    at most BLOCK postings of the term; documents of one leaf beyond that are counted off."""
    begins, done = np.zeros(len(term), bool), np.zeros(len(term), bool)
    for shift in range(DEPTH, -1, -1):
        start = np.ones(len(term), bool)
        start[1:] = (term[1:] != term[:-1]) | (code[1:] >> shift != code[:-1] >> shift)
        group = np.cumsum(start) - 1
        small = (np.bincount(group) <= BLOCK)[group] & ~done
        begins |= small & start
        done |= small
        if done.all():
            return begins
    first = np.flatnonzero(start)[group]
    return begins | (~done & ((np.arange(len(term)) - first) % BLOCK == 0))


def _summaries(block_of: np.ndarray, doc: np.ndarray, first: np.ndarray, count: np.ndarray, word: np.ndarray, gain: np.ndarray, n_blocks: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries a block, coordinates, maxima): of the documents of every block."""
    sizes, coordinates, maxima = [], [], []
    step = max(1, CELLS // max(width, 1))
    bounds = np.searchsorted(block_of, np.arange(0, n_blocks + step, step))
    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        own = min(step, n_blocks - i * step)
        dense = np.zeros(own * width, np.int64)
        for a in range(lo, hi, 1 << 14):
            d = doc[a : min(hi, a + (1 << 14))]
            at = _ranges(first[d], count[d])
            np.maximum.at(dense, np.repeat((block_of[a : a + len(d)] - i * step) * width, count[d]) + word[at], gain[at])
        found = np.flatnonzero(dense)
        sizes.append(np.bincount(found // width, minlength=own))
        coordinates.append(found % width)
        maxima.append(dense[found])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (sizes, coordinates, maxima))


def _blocked(row: dict, vocab: np.ndarray, weight: np.ndarray, n_docs: int, n_words: int) -> pa.RecordBatch:
    """A shard's blocks and summaries for the words of ``vocab``."""
    ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
    n = np.asarray(row["sizes"], np.int64)
    term = np.frombuffer(row["terms"], np.uint64)
    at = np.minimum(np.searchsorted(vocab, term), len(vocab) - 1)
    here = np.where(vocab[at] == term, at, -1)
    place, tf = (_unplanes(row[c]).astype(np.int64) for c in ("places", "tfs"))
    doc = np.repeat(np.arange(len(n)), _unplanes(row["counts"]).astype(np.int64))
    word = here[place] if len(place) else place
    keep = word >= 0
    doc, word, tf = doc[keep], word[keep], tf[keep]
    m = 50 + (50 * n * n_docs) // max(n_words, 1)
    gain = (10**9 * tf) // (1000 * tf + 20 * m[doc])
    # Words of the shard by their place among them keep the dense tables narrow.
    lists, local = np.unique(word, return_inverse=True)
    count = np.bincount(doc, minlength=len(n))
    first = np.cumsum(count) - count
    sketch = np.zeros((len(n), DIMENSIONS), np.float32)
    if len(word):
        random = np.random.default_rng(1).standard_normal((len(lists), DIMENSIONS), np.float32)
        full = np.flatnonzero(count)
        sketch[full] = np.add.reduceat(random[local] * (weight[word] * gain).astype(np.float32)[:, None], first[full])
        sketch /= np.maximum(np.sqrt((sketch**2).sum(1, keepdims=True)), 1e-9)
    code = similarity_codes(sketch)
    order = np.lexsort((ids[doc], code[doc], local))
    pdoc, pterm = doc[order], local[order]
    begin = cut_lists(pterm, code[pdoc])
    block_of = np.cumsum(begin) - 1
    start = np.flatnonzero(begin)
    list_sizes = np.bincount(pterm, minlength=len(lists))
    summed = (list_sizes > SHORT)[pterm]
    n_blocks, width = len(start), len(lists)
    # Lists that are read whole have blocks without entries.
    sizes, coordinates, maxima = _summaries(block_of[summed], pdoc[summed], first, count, local, gain, n_blocks, width)
    ints = {
        "counts": count, "words": word, "gains": gain, "lists": lists, "list_sizes": list_sizes, "list_blocks": np.bincount(pterm[start], minlength=len(lists)),
        "docs": pdoc, "block_sizes": np.diff(np.append(start, len(pdoc))), "summary_sizes": sizes, "coordinates": lists[coordinates], "maxima": maxima,
    }
    return pa.RecordBatch.from_arrays([pa.array([row["shard"]]), pa.array([row["ids"]], pa.list_(pa.int64())), *[pa.array([_planes(ints[c])], pa.binary()) for c in _INTS]], names=["shard", "ids", *_INTS])


def block_index(forward: DataFrame, vocab: np.ndarray, weight: np.ndarray, n_docs: int, n_words: int, store) -> DataFrame:
    """The blocked posting lists of every shard for a sorted vocabulary with its weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield _blocked({c: batch.column(c)[r].as_py() for c in batch.schema.names}, vocab, weight, n_docs, n_words)

    return store(forward.mapInArrow(run, BLOCKS), "blocks", True)


class Best:
    """The best ``k`` (score, id) of one query so far: higher scores, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> tuple[int, int]:
        """The score and id that a document must beat."""
        return (int(self.score[-1]), int(self.id[-1])) if len(self.score) >= self.k else (0, -NO_ID - 1)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        low, last = self.floor()
        better = (score > low) | ((score == low) & (ids < last))
        if better.any():
            s, i = np.concatenate([self.score, score[better]]), np.concatenate([self.id, ids[better]])
            order = np.lexsort((i, -s))[: self.k]
            self.score, self.id = s[order], i[order]


class Shard:
    """One row of the blocked index."""

    def __init__(self, row: dict, size: int):
        v = {c: _unplanes(row[c]).astype(np.int64) for c in _INTS}
        ends = lambda a: np.concatenate([[0], np.cumsum(a)])
        self.ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
        self.count, self.first, self.words, self.gains = v["counts"], ends(v["counts"]), v["words"], v["gains"]
        self.lists, self.docs, self.list_size = v["lists"], v["docs"], v["list_sizes"]
        self.list_at, self.blocks_at, self.block_at = ends(v["list_sizes"]), ends(v["list_blocks"]), ends(v["block_sizes"])
        self.summary_at, self.coordinates, self.maxima = ends(v["summary_sizes"]), v["coordinates"], v["maxima"]
        self.top = np.zeros(len(self.lists), np.int64)
        at = np.searchsorted(self.lists, self.words)
        np.maximum.at(self.top, at, self.gains)
        self.least = np.minimum.reduceat(self.ids[self.docs], self.block_at[:-1]) if len(self.docs) else np.zeros(0, np.int64)
        self.weights, self.ahead, self.seen = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(len(self.ids), bool)

    def _score(self, docs: np.ndarray, best: Best) -> int:
        docs = docs[~self.seen[docs]]
        if len(docs):
            self.seen[docs] = True
            at = _ranges(self.first[docs], self.count[docs])
            start = np.cumsum(self.count[docs]) - self.count[docs]
            score = np.add.reduceat(self.weights[self.words[at]] * self.gains[at], start)
            best.add(score[score > 0], self.ids[docs][score > 0])
        return len(docs)

    def search(self, words: np.ndarray, weight: np.ndarray, best: Best) -> int:
        """Add what the shard has to the best of a query; the number of documents scored.

        Lists go from the largest possible gain down, until what is left together can't reach
        the floor. In a list, blocks go from the highest bound down. A bound leaves out the
        words whose lists are done: a document with such a word has been scored, or a bound
        has shown there that it isn't among the best.
        """
        at = np.searchsorted(self.lists, words)
        at[at == len(self.lists)] = 0
        have = self.lists[at] == words if len(self.lists) else np.zeros(len(words), bool)
        at, words = at[have], words[have]
        self.weights[words] = self.ahead[words] = weight[words]
        most = weight[words] * self.top[at]
        order = np.argsort(-most, kind="stable")
        rest = np.cumsum(most[order][::-1])[::-1]
        scored, touched, short = 0, [], []

        def read(docs: np.ndarray) -> None:
            nonlocal scored
            touched.append(docs)
            scored += self._score(docs, best)

        for t, left in zip(at[order].tolist(), rest.tolist(), strict=True):
            if left < best.floor()[0]:
                break
            if self.list_size[t] <= SHORT:  # short lists are read together
                short.append(self.docs[self.list_at[t] : self.list_at[t + 1]])
                self.ahead[self.lists[t]] = 0
                continue
            if short:
                read(np.unique(np.concatenate(short)))
                short = []
                if left < best.floor()[0]:
                    break
            b = np.arange(self.blocks_at[t], self.blocks_at[t + 1])
            lo, hi = self.summary_at[b[0]], self.summary_at[b[-1] + 1]
            bound = np.add.reduceat(self.ahead[self.coordinates[lo:hi]] * self.maxima[lo:hi], self.summary_at[b] - lo)
            by = np.argsort(-bound, kind="stable")
            b, bound, done, step = b[by], bound[by], 0, 4
            while done < len(b):
                low, last = best.floor()
                own, high = b[done : done + step], bound[done : done + step]
                own = own[(high > low) | ((high == low) & (self.least[own] < last))]
                if high[0] < low:
                    break
                if len(own):
                    read(self.docs[_ranges(self.block_at[own], self.block_at[own + 1] - self.block_at[own])])
                done, step = done + step, 2 * step
            self.ahead[self.lists[t]] = 0
        if short:
            read(np.unique(np.concatenate(short)))
        self.weights[words] = self.ahead[words] = 0
        for docs in touched:
            self.seen[docs] = False
        return scored


def _asked(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """(query, item, terms): every different (item, distinct words) with any words, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tb.blocks(batch.column(1)):
                w = tb.words(data, off, tb.WORD_CHARS)
                terms = [np.unique(w.hash[a:b]).view(np.int64) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(terms, pa.list_(pa.int64()))], names=["item", "terms"])

    rows = queries.select(F.col(query_id).alias("item"), F.col(query_text).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    found = rows.where("item IS NOT NULL").mapInArrow(run, f"item {kind}, terms array<bigint>").where("size(terms) > 0").dropDuplicates(["item", "terms"])
    return found.select(F.monotonically_increasing_id().alias("query"), "item", "terms")


def _query_blocks(asked: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(query, words) in blocks of bounded size; a query of more words is a block of its own."""
    block, held = [], 0
    for query, terms in asked.select("query", "terms").toLocalIterator():
        words = np.asarray(terms, np.int64).view(np.uint64)
        if block and (len(block) >= MAX_QUERIES or held + len(words) > MAX_WORDS):
            yield block
            block, held = [], 0
        block.append((query, words))
        held += len(words)
    if block:
        yield block


def _frequencies(forward: DataFrame, vocab: np.ndarray) -> np.ndarray:
    """In how many documents each word of the vocabulary occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(vocab), np.int64)
        for batch in batches:
            for t, p in zip(batch.column(0), batch.column(1), strict=True):
                term = np.frombuffer(t.as_py(), np.uint64)
                df = np.bincount(_unplanes(p.as_py()), minlength=len(term))
                _, mine, theirs = np.intersect1d(vocab, term, assume_unique=True, return_indices=True)
                sums[mine] += df[theirs]
        got = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(sums[got])], names=["term", "n"])

    out = np.zeros(len(vocab), np.int64)
    for r in forward.select("terms", "places").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def _search_block(blocks: DataFrame, asked: list[tuple[int, np.ndarray]], weight: np.ndarray, k: int) -> DataFrame:
    """The best of each task's shards; what it has found is the floor of its next shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[r].as_py() for c in batch.schema.names}, len(weight))
                for (_, words), b in zip(asked, best, strict=True):
                    shard.search(words, weight, b)
        n = [len(b.id) for b in best]
        if sum(n):
            ids = np.concatenate([b.id for b in best])
            arrays = [pa.array(np.repeat([q for q, _ in asked], n)), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([b.score for b in best]))]
            yield pa.RecordBatch.from_arrays(arrays, names=["query", "id", "score"])

    # A task takes many shards one after the other, so that its floor rises and few hits leave it.
    return blocks.coalesce(2 * blocks.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, HITS)


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``(query_id, rank, id, score)``: the exact best ``k`` documents of every query.

    Scores above 0 only, equal scores by ascending id (a null id last). A query is the set of
    its words. Null, empty or wordless queries find nothing, nor do queries without id; a
    query row that repeats another is asked once, and rows that repeat an id with other words
    are ranked on their own. Documents that repeat an id are ranked on their own. An empty
    table on either side gives no rows. Further columns are ignored.

    N and L count all documents with words. Queries are hashed in tasks and searched in blocks
    of at most MAX_QUERIES and MAX_WORDS: the driver holds the word hashes of one block.
    """
    with Scratch(docs.sparkSession) as scratch:
        asked = scratch.stored(_asked(queries, query_id, query_text), "asked")
        forward = forward_index(docs, id_col, text_col, store=scratch.stored)
        words = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
        n_docs, n_words = forward.agg(F.coalesce(F.sum(F.size(F.filter("sizes", lambda x: x > 0))), F.lit(0)), F.coalesce(F.sum(words), F.lit(0))).first()
        found = []
        for block in _query_blocks(asked):
            vocab = np.unique(np.concatenate([t for _, t in block]))
            local = [(q, np.searchsorted(vocab, t)) for q, t in block]
            with single_rows(docs.sparkSession):
                df = _frequencies(forward, vocab)
                weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
                blocks = block_index(forward, vocab, weight, n_docs, n_words, scratch.stored)
                found.append(scratch.stored(_best(_search_block(blocks, local, weight, k), k).drop("rank"), "hits"))
            scratch.drop(blocks)
        hits = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], HITS)
        named = _best(hits, k).join(asked.select("query", "item"), "query")
        return scratch.result(named.select(F.col("item").alias(query_id), "rank", F.col("id").alias(id_col), "score"), "best")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op11_ranked(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS nw FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS t FROM benchmark),
p AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, unnest(w) AS t, len(w) AS n FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
f AS (SELECT t, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t),
g AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nw)) AS g FROM p, s),
r AS (SELECT item_id, doc_id, sum(w * g)::BIGINT AS score FROM q JOIN g USING (t) JOIN f USING (t) GROUP BY item_id, doc_id HAVING sum(w * g) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r QUALIFY rank <= 50
"""
