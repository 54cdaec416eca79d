"""Benchmark decontamination over a distributed positional inverted index.

The index is a table with one row per shard, a bounded run of training documents whose
token positions are numbered through: its sorted terms, the length of each term's posting
list, and all lists (ascending positions) end to end. A phrase is answered shard by shard:
the lists of its terms are taken from the globally rarest term on, shifted by the term's
offset in the phrase, and intersected. No token leaves its shard, so nothing is shuffled
but the matches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Scratch, single_rows, stored, table

#: Text bytes and documents of one shard; they bound a row of the index.
SHARD_BYTES = 4 << 20
SHARD_DOCS = 20_000
#: Items and words of one block of queries; a block is what every task receives.
BLOCK_ITEMS = 4096
BLOCK_WORDS = 1 << 20

INDEX = "shard string, terms binary, lengths binary, steps binary, ids array<bigint>, words array<bigint>"
MATCH = "shard string, doc_row int, id bigint, item string, spans array<struct<s:bigint,e:bigint>>"


def _planes(a: np.ndarray) -> bytes:
    """uint32 values as four byte planes, which compress well when values are small."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _shard(ids: list, counts: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable").astype(np.int64)
    term, first = np.unique(h[order], return_index=True)
    step = np.diff(order, prepend=0)
    step[first] = order[first]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([uuid.uuid4().hex]),
            pa.array([term.tobytes()], pa.binary()),
            pa.array([_planes(np.diff(np.append(first, len(h))))], pa.binary()),
            pa.array([_planes(step)], pa.binary()),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([np.concatenate(counts)], pa.list_(pa.int64())),
        ],
        names=["shard", "terms", "lengths", "steps", "ids", "words"],
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", store=stored) -> DataFrame:
    """The positional index of every document, written to the shared folder.

    Words are runs of digits, ASCII letters and non-ASCII characters, A-Z lower-cased; a
    null text has none. Shards are named anew by each task attempt. Rows that repeat an id
    stay separate documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        counts: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for lo, hi, data, off in tb.blocks(batch.column(1)):
                w = tb.words(data, off, tb.WORD_CHARS)
                ids += batch.column(0)[lo:hi].to_pylist()
                counts.append(np.diff(w.first))
                hashes.append(w.hash)
                size += len(data)
                if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield _shard(ids, counts, hashes)
                    ids, counts, hashes, size = [], [], [], 0
        if ids:
            yield _shard(ids, counts, hashes)

    return store(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, INDEX), "positions", True)


def _item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, terms): the words of every query item that has any, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tb.blocks(batch.column(1)):
                w = tb.words(data, off, tb.WORD_CHARS)
                terms = pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), pa.array(w.hash.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], terms], names=["item", "terms"])

    found = items.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "item string, terms array<bigint>")
    return found.where("size(terms) > 0 AND item IS NOT NULL").dropDuplicates(["item", "terms"])


class Windows:
    """The windows of a block of items, over their words end to end."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.words = np.concatenate([t for _, t in items])
        size = np.array([len(t) for _, t in items], np.int64)
        width = np.minimum(size, window)
        count = size - width + 1
        self.item = np.repeat(np.arange(len(items)), count)
        first = np.cumsum(size) - size
        self.start = np.arange(len(self.item)) + np.repeat(first - (np.cumsum(count) - count), count)
        self.end = self.start + width[self.item]

    def present(self, term: np.ndarray) -> np.ndarray:
        """Windows all of whose words are among the sorted ``term``: one look-up of all words."""
        at = np.minimum(np.searchsorted(term, self.words), max(len(term) - 1, 0))
        here = term[at] == self.words if len(term) else np.zeros(len(self.words), bool)
        missing = np.concatenate([[0], np.cumsum(~here)])
        return np.flatnonzero(missing[self.end] == missing[self.start])


def _starts(phrase: np.ndarray, lists: dict[int, np.ndarray], total: dict[int, int], bounds: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, document) where the phrase begins: intersect offset-adjusted lists from the
    rarest term on. With ``slop`` every other term may be that many words off its place.
    All terms must be in the document of the rarest one."""
    order = sorted(range(len(phrase)), key=lambda j: (total[int(phrase[j])], j))
    rarest = lists[int(phrase[order[0]])]
    at, doc = rarest - order[0], np.searchsorted(bounds, rarest, side="right") - 1
    for j in order[1:]:
        other = lists[int(phrase[j])]
        least, most = np.maximum(at + j - slop, bounds[doc]), np.minimum(at + j + slop, bounds[doc + 1] - 1)
        i = np.searchsorted(other, least)
        ok = i < len(other)
        ok[ok] = other[i[ok]] <= most[ok]
        at, doc = at[ok], doc[ok]
        if not len(at):
            break
    return at, doc


def _spans(hits: list[tuple[np.ndarray, np.ndarray, int]], bounds: np.ndarray, slop: int) -> list[tuple[int, list[dict]]]:
    """(document, merged word ranges) of the phrase starts; none crosses documents."""
    at, doc = (np.concatenate([h[i] for h in hits]) for i in (0, 1))
    end = np.concatenate([h[0] + h[2] for h in hits])
    at, end = np.maximum(at - slop, bounds[doc]), np.minimum(end + slop, bounds[doc + 1])
    order = np.lexsort((end, at, doc))
    found: list[tuple[int, list[dict]]] = []
    for d, a, b in zip(doc[order], at[order], end[order], strict=True):
        a, b = int(a - bounds[d]), int(b - bounds[d])
        if not found or found[-1][0] != d:
            found.append((int(d), []))
        spans = found[-1][1]
        if spans and a <= spans[-1]["e"]:
            spans[-1]["e"] = max(spans[-1]["e"], b)
        else:
            spans.append({"s": a, "e": b})
    return found


def _blocks(asked: DataFrame) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The items in blocks of at most BLOCK_ITEMS and BLOCK_WORDS, one at a time; an item of
    more words is a block of its own."""
    block: list[tuple[str, np.ndarray]] = []
    held = 0
    for item, terms in asked.select("item", "terms").toLocalIterator():
        words = np.asarray(terms, np.int64).view(np.uint64)
        if block and (len(block) >= BLOCK_ITEMS or held + len(words) > BLOCK_WORDS):
            yield block
            block, held = [], 0
        block.append((item, words))
        held += len(words)
    if block:
        yield block


def _search_block(index: DataFrame, items: list[tuple[str, np.ndarray]], window: int, slop: int) -> DataFrame:
    vocab = np.unique(np.concatenate([t for _, t in items]))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(vocab), np.int64)
        for batch in batches:
            for t, n in zip(batch.column(0), batch.column(1), strict=True):
                term = np.frombuffer(t.as_py(), np.uint64)
                _, mine, theirs = np.intersect1d(vocab, term, assume_unique=True, return_indices=True)
                sums[mine] += _unplanes(n.as_py())[theirs]
        got = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(sums[got])], names=["term", "n"])

    per_task = index.select("terms", "lengths").mapInArrow(lengths, "term bigint, n bigint")
    total = {int(vocab[r["term"]]): int(r["n"]) for r in per_task.groupBy("term").agg(F.sum("n").alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(items, window)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f: batch.column(f)[i].as_py() for f in ("shard", "terms", "lengths", "steps", "words")}
                term = np.frombuffer(row["terms"], np.uint64)
                ends = np.cumsum(_unplanes(row["lengths"]), dtype=np.int64)
                steps = _unplanes(row["steps"])
                _, _, have = np.intersect1d(vocab, term, assume_unique=True, return_indices=True)
                lists = {int(term[j]): np.cumsum(steps[ends[j - 1] if j else 0 : ends[j]], dtype=np.int64) for j in have}
                bounds = np.concatenate([[0], np.cumsum(row["words"], dtype=np.int64)])
                ids = batch.column("ids")[i].as_py()
                seen: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
                hits: dict[int, list] = {}
                for k in windows.present(term).tolist():
                    phrase = windows.words[windows.start[k] : windows.end[k]]
                    name = phrase.tobytes()
                    if name not in seen:
                        seen[name] = _starts(phrase, lists, total, bounds, slop)
                    if len(seen[name][0]):
                        hits.setdefault(int(windows.item[k]), []).append((*seen[name], len(phrase)))
                out = [{"shard": row["shard"], "doc_row": d, "id": ids[d], "item": items[i][0], "spans": s} for i, found in hits.items() for d, s in _spans(found, bounds, slop)]
                yield pa.RecordBatch.from_pylist(out, schema=_MATCH)

    return index.mapInArrow(run, MATCH)


_MATCH = pa.schema([("shard", pa.string()), ("doc_row", pa.int32()), ("id", pa.int64()), ("item", pa.string()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))])


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, window: int = 10, slop: int = 0, store=stored) -> DataFrame:
    """Matches of the items' windows: ``(shard, doc_row, id, item, spans)``.

    A window is ``window`` consecutive item words; an item of fewer is one window. ``spans``
    are the merged half-open word ranges of its occurrences in the document. ``slop`` 0 is
    exact phrase search; above 0 it is proximity search: every word at most ``slop`` words
    off its place relative to the rarest one, in one document. Items go to the shards in
    blocks of bounded size, so a larger item set costs more passes, not more memory.
    """
    with Scratch(index.sparkSession) as scratch:
        asked = scratch.stored(_item_words(items, id_col, text_col), "items")
        with single_rows(index.sparkSession):
            found = [store(_search_block(index, block, window, slop), "matches") for block in _blocks(asked)]
    return reduce(DataFrame.unionByName, found) if found else index.sparkSession.createDataFrame([], MATCH)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, window: int = 10) -> DataFrame:
    """One row per document: its words, those inside benchmark windows, and the items.

    Columns: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and
    ``hits`` (merged word ranges). Null or wordless documents and items match nothing; an
    empty table on either side gives documents without hits. Rows repeating an id are
    searched and returned on their own.
    """
    with Scratch(docs.sparkSession) as scratch:
        index = build_index(docs, id_col, text_col, scratch.stored)
        matches = search(index, benchmark, item_col, item_text, window=window, store=scratch.stored)
        return scratch.result(_hits(index, matches, id_col), "hits")


def _hits(index: DataFrame, matches: DataFrame, id_col: str) -> DataFrame:
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    found = matches.groupBy("shard", "doc_row").agg(F.array_sort(F.collect_set("item")).alias("items"), spans.alias("hits"))
    rows = index.select("shard", F.posexplode(F.arrays_zip("ids", "words")).alias("doc_row", "d")).select("shard", "doc_row", F.col("d.ids").alias(id_col), F.col("d.words").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    covered = F.aggregate(
        F.coalesce("hits", F.array().cast("array<struct<s:bigint,e:bigint>>")),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["e"]))).alias("n"), F.greatest(acc["e"], x["e"]).alias("e")),
        lambda acc: acc["n"],
    )
    out = rows.join(found, ["shard", "doc_row"], "left").withColumn("n_hit", covered)
    return out.select(id_col, "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "hits")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")
