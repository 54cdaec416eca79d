"""Compression of vectors to codes of their parts by a dual-tree Lloyd iteration in integers.

Vectors are scaled to integers and cut into equal consecutive parts; each part position has a
codebook. Rows lie in blocks of bounded size, each with one tree per part position that halves
the block along its widest side; the entries of a codebook have a tree of their own. Both
trees are walked together: if the least distance of an entry node's box from a data node's box
exceeds the largest distance that some other entry node can have from it, the pair is dropped.
A data node that is left with one entry goes to it as a whole, by the sum and the number of
rows that it holds; the rows of leaves with more compare distances to those entries alone.

All figures are integers below 2**53 in absolute value; they are held in doubles where
products are summed, which is exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block, components of a block, and rows of a tree's leaf at most.
BLOCK_ROWS, BLOCK_CELLS, LEAF = 8192, 1 << 20, 64
#: Salts of a join with a table of labels that is too large to go to every task.
SALTS = 16


def halves(n: int, depth: int) -> list[np.ndarray]:
    """The borders of the nodes of every level of a tree over n places."""
    levels = [np.array([0, n])]
    for _ in range(depth):
        b = levels[-1]
        out = np.empty(2 * len(b) - 1, np.int64)
        out[::2], out[1::2] = b, (b[:-1] + b[1:]) // 2
        levels.append(out)
    return levels


def tree_order(x: np.ndarray, depth: int) -> np.ndarray:
    """The rows in an order whose halves, halves of halves and so on lie close together."""
    order = np.arange(len(x))
    for borders in halves(len(x), depth)[:-1]:
        for lo, hi in zip(borders[:-1], borders[1:], strict=True):
            if hi - lo > 1:
                own = order[lo:hi]
                side = x[own]
                along = int(np.argmax(side.max(0) - side.min(0)))
                order[lo:hi] = own[np.argpartition(side[:, along], (hi - lo) // 2)]
    return order


class Tree:
    """Boxes of all nodes, by level, over rows in tree order; ``sums`` and ``sizes`` too."""

    def __init__(self, x: np.ndarray, depth: int):
        self.x, self.depth, self.borders = x, depth, halves(len(x), depth)
        leaf = self.borders[-1]
        size = np.diff(leaf)
        at = np.minimum(leaf[:-1], max(len(x) - 1, 0))
        none = (size == 0)[:, None]
        low, high = np.where(none, np.inf, np.minimum.reduceat(x, at)), np.where(none, -np.inf, np.maximum.reduceat(x, at))
        total = np.where(none, 0.0, np.add.reduceat(x, at))
        self.levels = [(low, high, total, size)]
        for _ in range(depth):
            low, high, total, size = self.levels[0]
            self.levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), total[::2] + total[1::2], size[::2] + size[1::2]))


def _groups(d: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, d[1:] != d[:-1]))


def _near(data: Tree, i: int, entries: Tree, j: int, d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drop the pairs (data node, entry node) that can't hold a nearest entry."""
    some = entries.levels[j][3][e] > 0
    d, e = d[some], e[some]
    low, high = (data.levels[i][k][d] for k in (0, 1))
    elow, ehigh = (entries.levels[j][k][e] for k in (0, 1))
    least = (np.maximum(np.maximum(elow - high, low - ehigh), 0) ** 2).sum(1)
    most = (np.maximum(ehigh - low, high - elow) ** 2).sum(1)
    first = _groups(d)
    bound = np.repeat(np.minimum.reduceat(most, first), np.diff(np.append(first, len(d))))
    keep = least <= bound
    return d[keep], e[keep]


def walk(data: Tree, entries: Tree) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """(whole data nodes as (level, node, entry), leaves and entries that are left as pairs).

    Entry nodes go down two levels for one of the data nodes, so that data nodes of several
    sizes meet single entries.
    """
    i = j = 0
    d = e = np.zeros(1, np.int64)
    whole = []
    while True:
        for _ in range(2):
            if j < entries.depth:
                j += 1
                d, e = np.repeat(d, 2), np.repeat(2 * e, 2) + np.tile([0, 1], len(e))
                d, e = _near(data, i, entries, j, d, e)
        if j == entries.depth:
            first = _groups(d)
            single = np.diff(np.append(first, len(d))) == 1
            alone = np.zeros(len(d), bool)
            alone[first[single]] = True
            whole += [(i, int(a), int(entries.borders[-1][b])) for a, b in zip(d[alone], e[alone], strict=True)]
            d, e = d[~alone], e[~alone]
            if i == data.depth or not len(d):
                return whole, d, entries.borders[-1][e]
        if i < data.depth:
            i += 1
            d, e = np.concatenate([2 * d, 2 * d + 1]), np.concatenate([e, e])
            some = data.levels[i][3][d] > 0
            order = np.argsort(d[some], kind="stable")
            d, e = d[some][order], e[some][order]
            d, e = _near(data, i, entries, j, d, e)


class Codebook:
    """The entries of one part position with their tree."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.float64)
        depth = max(len(entries) - 1, 0).bit_length()
        self.order = tree_order(self.entries, depth)
        self.tree = Tree(self.entries[self.order], depth)
        self.norms = (self.entries**2).sum(1)


def assign(data: Tree, book: Codebook, want_rows: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sums and counts by entry, nearest entry and squared distance of each row in tree order).

    Ties go to the lower entry. Rows of whole nodes get their figures only if wanted.
    """
    n, width = data.x.shape
    sums, counts = np.zeros((len(book.entries), width)), np.zeros(len(book.entries), np.int64)
    near, error = np.zeros(n, np.int64), np.zeros(n)
    whole, leaf, entry = walk(data, book.tree)
    for level, node, place in whole:
        own = int(book.order[place])
        total, size = data.levels[level][2][node], data.levels[level][3][node]
        sums[own] += total
        counts[own] += size
        if want_rows:
            lo, hi = data.borders[level][node], data.borders[level][node + 1]
            near[lo:hi] = own
            error[lo:hi] = ((data.x[lo:hi] - book.entries[own]) ** 2).sum(1)
    first = _groups(leaf) if len(leaf) else []
    unsure = np.zeros(n, bool)
    for a, b in zip(first, np.append(first[1:], len(leaf)) if len(leaf) else [], strict=True):
        lo, hi = data.borders[-1][leaf[a]], data.borders[-1][leaf[a] + 1]
        own = np.sort(book.order[entry[a:b]])
        x = data.x[lo:hi]
        far = book.norms[own] - 2 * (x @ book.entries[own].T)
        best = np.argmin(far, 1)
        near[lo:hi] = own[best]
        unsure[lo:hi] = True
        if want_rows:
            error[lo:hi] = far[np.arange(hi - lo), best] + (x**2).sum(1)
    if unsure.any():
        at, x = near[unsure], data.x[unsure]
        order = np.argsort(at, kind="stable")
        start = _groups(at[order])
        sums[at[order][start]] += np.add.reduceat(x[order], start)
        counts += np.bincount(at, minlength=len(counts))
    return sums, counts, near, error


def _scaled(vectors: pa.ListArray, width: int, most: int) -> np.ndarray:
    """floor(SCALE * x) of every component as int32 rows of ``width``."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    out = np.zeros((len(size), width), np.int32)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), place] = np.clip(flat, -most, most)
    return out


def kept(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is whole: not null, and without null or non-finite components."""
    inf = F.lit(float("inf"))
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < inf))
    return vectors.where(F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False)))


def _blocks(rows: DataFrame, width: int, parts: int, most: int) -> DataFrame:
    """Blocks of rows: ids, labels, integers, and the tree order of every part."""
    ids, labels = rows.dtypes[0][1], rows.dtypes[1][1]
    step, cut = max(LEAF, min(BLOCK_ROWS, BLOCK_CELLS // width)), width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            one = [t.column(c).chunk(0) for c in range(3)]
            x, ends = _scaled(one[2], width, most), pa.array([0, t.num_rows], pa.int32())
            orders = [tree_order(x[:, p * cut : (p + 1) * cut].astype(np.float64), _depth(len(x))) for p in range(parts)]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, one[0]), pa.ListArray.from_arrays(ends, one[1]), pa.array([x.tobytes()]), pa.array([np.concatenate(orders).astype("<u2").tobytes()])], names=["ids", "labels", "cells", "orders"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, step - size)
                held.append(take)
                size, batch = size + take.num_rows, batch.slice(take.num_rows)
                if size == step:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return rows.mapInArrow(run, f"ids array<{ids}>, labels array<{labels}>, cells binary, orders binary")


def _depth(n: int) -> int:
    return max(0, math.ceil(math.log2(n / LEAF))) if n else 0


def _trees(cells: bytes, orders: bytes, width: int, parts: int) -> Iterator[tuple[np.ndarray, Tree]]:
    """(order, tree) of every part of a block."""
    x = np.frombuffer(cells, np.int32).reshape(-1, width)
    order = np.frombuffer(orders, "<u2").reshape(parts, len(x)).astype(np.int64)
    cut = width // parts
    for p in range(parts):
        yield order[p], Tree(x[order[p], p * cut : (p + 1) * cut].astype(np.float64), _depth(len(x)))


def _moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; an entry that no part chose stays. What comes to the
    driver is a sum per component of an entry, whatever the number of rows."""
    parts, entries, cut = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Codebook(b) for b in books]
        out = np.zeros((parts, entries, cut + 1), np.int64)
        for batch in batches:
            for cells, orders in zip(batch.column(0), batch.column(1), strict=True):
                for p, (_, tree) in enumerate(_trees(cells.as_py(), orders.as_py(), parts * cut, parts)):
                    sums, counts, _, _ = assign(tree, trees[p], False)
                    out[p, :, :cut] += sums.astype(np.int64)
                    out[p, :, cut] += counts
        flat = out.reshape(-1)
        got = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(flat[got])], names=["slot", "value"])

    total = np.zeros(parts * entries * (cut + 1), np.int64)
    for r in blocks.select("cells", "orders").mapInArrow(run, "slot bigint, value bigint").groupBy("slot").agg(F.sum("value").alias("value")).collect():
        total[r["slot"]] = r["value"]
    total = total.reshape(parts, entries, cut + 1)
    count = total[..., cut:]
    return np.where(count > 0, total[..., :cut] // np.maximum(count, 1), books)


def _codes(blocks: DataFrame, books: np.ndarray, ids: str, labels: str) -> DataFrame:
    parts, _, cut = books.shape
    digits = np.array([f"{i:02x}" for i in range(books.shape[1])] or ["00"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Codebook(b) for b in books] if books.shape[1] else []
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                n = len(row.column(0).flatten())
                error, code = np.zeros(n, np.int64), np.full(n, "", "U1")
                for p, (order, tree) in enumerate(_trees(row.column(2)[0].as_py(), row.column(3)[0].as_py(), parts * cut, parts)):
                    _, _, near, far = assign(tree, trees[p], True)
                    own = np.empty(n, np.int64)
                    own[order] = near
                    error[order] += far.astype(np.int64)
                    code = np.char.add(code, digits[own])
                yield pa.RecordBatch.from_arrays([row.column(0).flatten(), row.column(1).flatten(), pa.array(code.tolist(), pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"id {ids}, label {labels}, code string, error bigint")


def _with_label_error(codes: DataFrame, scratch: Scratch) -> DataFrame:
    """The errors are summed before the shuffle; rows meet their label's sum in a broadcast
    where the labels are few, else by label and salt, so a common label is dealt out."""
    totals = scratch.stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    small = sized(totals)
    if small is not totals:
        return codes.join(small.withColumnRenamed("label", "l"), F.col("label").eqNullSafe(F.col("l")), "left").drop("l")
    dealt = totals.select(F.col("label").alias("l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    own = codes.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return own.join(dealt, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s")), "left").drop("l", "s", "salt")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of all whole vectors: id, ``code``, ``error``, ``label_error``, ``codebooks_sha256``.

    Rows with a null vector, or one with null or non-finite components, are left out. A
    component becomes floor(1024 * x). The codebooks start as the parts of the ``entries``
    rows (at most 256) with the smallest ids (null ids last, equal ids by vector); each of
    ``rounds`` rounds assigns every part to its nearest entry (the lower of equals) and moves
    entries to floor(sum / count). Vectors shorter than the longest, or than a multiple of
    ``parts``, go on with zeros. Integers beyond isqrt(2**51 / d) in absolute value, d the
    components of a part (11.8 million at 16, a component of 11,585), are held at that bound.
    Repeated rows and ids are coded on their own; fewer rows than entries make codebooks of
    as many entries; an empty table gives no rows. Further columns are ignored.

    A round reads the blocks once and brings one sum per codebook component to the driver.
    """
    rows = kept(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    ids, labels = rows.dtypes[0][1], rows.dtypes[1][1]
    with Scratch(vectors.sparkSession) as scratch:
        longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
        width = max(1, -(-longest // parts)) * parts
        cut = width // parts
        most = math.isqrt(2**51 // cut)
        first = rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
        seeds = _scaled(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width, most).astype(np.int64)
        books = np.ascontiguousarray(seeds.reshape(len(first), parts, cut).transpose(1, 0, 2))
        blocks = scratch.stored(_blocks(rows, width, parts, most), "vectors")
        if first:
            for _ in range(rounds):
                books = _moved(blocks, books)
        codes = scratch.stored(_codes(blocks, books, ids, labels), "codes")
        sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
        out = _with_label_error(codes, scratch).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
        return scratch.result(out, "compressed")


def op12_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by comparing every part with every entry, a round per table expression."""
    whole = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    cut = f"(len(v) // {parts})"
    nearest = """SELECT {cols}, min_by(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (
  SELECT {cols}, b{r}.e, list_sum(list_transform(list_zip(u, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM pt JOIN b{r} USING (p)) GROUP BY {cols}"""
    text = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS n, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {whole}),
pt AS MATERIALIZED (SELECT n, p, v[p * {cut} + 1 : (p + 1) * {cut}] AS u FROM k, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, n - 1 AS e, u AS w FROM pt WHERE n <= {entries})"""
    for r in range(rounds):
        text += f""",
a{r} AS MATERIALIZED ({nearest.format(cols="n, p", r=r)}),
c{r} AS (SELECT p, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT p, e, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM a{r} JOIN pt USING (n, p)) GROUP BY p, e, i),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(x, w) AS w FROM b{r} LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS x FROM c{r} GROUP BY p, e) USING (p, e))"""
    return text + f""",
z AS ({nearest.format(cols="n, p", r=rounds)}),
o AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM z GROUP BY n),
h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o JOIN k USING (n), h
"""


OP12_SQL = _sql()
