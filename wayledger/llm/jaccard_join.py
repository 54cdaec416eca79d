"""N-gram Jaccard join by vertical partitioning.

One global order of the word n-grams (common ones last, else by hash) serves twice. The
prefix of a set in that order finds candidates: two sets with similarity t share an n-gram
within their first ``n - ceil(t * n) + 1``. The same order is cut into ranges
("fragments"); the overlap of a candidate pair is counted in each fragment on its own and
summed per pair, so the similarity test is on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Scratch, sized
from .components import components

#: Cells of the frequency sketch that decides which n-grams come last in the order.
CELLS = 1 << 22
#: Most cells that may be marked as common; the table of them is sent to every task.
MAX_COMMON_CELLS = 1 << 16
#: Members of a component that travel together in a candidate group.
CHUNK = 256
#: Least number of parity bits of a set; a larger set has as many as n-grams, rounded up to a
#: power of two. Each n-gram flips one, so sets differ in at least as many n-grams as bits.
BITS = 512
#: Words of parity bits that are compared at a time.
COMPARED = 1 << 20


def _ids(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((node, id, text) of every row, (node, text) of every node). The id itself is the
    node where ids are unique and not null; else rows are told apart by a hash of id and
    text, so equal rows are one node."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    odd = base.groupBy("id").agg(F.count("*").alias("c")).where("id IS NULL OR c > 1").limit(1).count()
    rows = base.select((F.xxhash64("id", "text") if odd else F.col("id")).alias("node"), "id", "text")
    texts = rows.select("node", "text")
    return rows, texts.dropDuplicates(["node"]) if odd else texts


def _summaries(k: int):
    """One row per document (set size and two 64-bit set sums) plus rows (cell, count) of
    this task's frequent sketch cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for lo, hi, data, off in tb.blocks(batch.column(2)):
                d, h = tb.shingles(tb.words(data, off, tb.NON_SPACE), k)
                n = np.bincount(d, minlength=hi - lo)
                c = np.zeros((2, len(h) + 1), np.uint64)
                np.cumsum(tb.mix(h), out=c[0, 1:])
                np.cumsum(tb.mix(h ^ np.uint64(0xA5A5A5A5DEADBEEF)), out=c[1, 1:])
                at = np.concatenate([[0], np.cumsum(n)])
                s = (c[:, at[1:]] - c[:, at[:-1]]).view(np.int64)
                np.add.at(cells, (h & np.uint64(CELLS - 1)).astype(np.int64), 1)
                yield _summary(batch.column(0)[lo:hi], batch.column(1)[lo:hi], n, s[0], s[1])
        often = np.flatnonzero(cells > 3 + 4 * cells.mean())
        nulls = pa.nulls(len(often), pa.int64())
        yield _summary(nulls, nulls, cells[often], often, np.zeros(len(often), np.int64))

    return run


def _summary(node, ids, n, s1, s2) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [node, ids, pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())],
        names=["node", "id", "n", "s1", "s2"],
    )


def _ordered(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The global order: how common the n-gram's cell is, then the hash."""
    return (level[(h & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (h >> np.uint64(7))


def _keys(k: int, level: np.ndarray, cut, column: int):
    """Rows (node, n, keys, bits, fold): the ordered set keys of each document, shortened by
    ``cut``, the parity bits of the whole set, and these folded to the least number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tb.blocks(batch.column(column)):
                d, h = tb.shingles(tb.words(data, off, tb.NON_SPACE), k)
                key = _ordered(h, level)
                order = np.lexsort((key, d))
                d, key = d[order], key[order].view(np.int64)
                n = np.bincount(d, minlength=hi - lo)
                at = np.concatenate([[0], np.cumsum(n)])
                take = cut(n)
                rank = np.arange(len(d)) - at[d]
                keep = rank < take[d]
                offsets = np.concatenate([[0], np.cumsum(take)])
                width = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
                begin = np.concatenate([[0], np.cumsum(width // 64)])
                spot = tb.mix(key.view(np.uint64)) & (width[d] - 1).astype(np.uint64)
                bits = np.zeros(begin[-1], np.uint64)
                np.bitwise_xor.at(bits, begin[d] + (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
                packed = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(8 * begin), pa.py_buffer(bits)])
                small = BITS // 64
                fold = np.zeros((hi - lo) * small, np.uint64)
                row = np.repeat(np.arange(hi - lo), width // 64)
                np.bitwise_xor.at(fold, row * small + (np.arange(len(row)) - begin[row]) % small, bits)
                folded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), hi - lo, [None, pa.py_buffer(fold)])
                keys = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(key[keep], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(n, pa.int64()), keys.cast(pa.list_(pa.int64())), packed.cast(pa.binary()), folded.cast(pa.binary())],
                    names=["node", "n", "keys", "bits", "fold"],
                )

    return run


def _near(a: Column, b: Column, percent: int) -> Column:
    """Sizes that similarity ``percent`` allows."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


class Parities:
    """The parity bits of a column of sets; sets of similar sizes compare at the smaller of
    their widths, to which the larger folds."""

    def __init__(self, column: pa.Array):
        col = column.cast(pa.large_binary())
        _, off, data = col.buffers()
        off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        self.words = np.frombuffer(data, np.uint64) if data is not None and data.size else np.zeros(0, np.uint64)
        self.at, self.size = off[:-1] // 8, np.diff(off) // 8

    def folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        place = self.at[rows][:, None] + np.arange(width)
        out = self.words[place]
        for part in range(1, int((self.size[rows] // width).max(initial=1))):
            more = self.size[rows] > part * width
            out[more] ^= self.words[place[more] + part * width]
        return out

    def apart(self, other: Parities, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits rows ``a`` differ from the other column's rows ``b``."""
        out, least = np.zeros(len(a), np.int64), np.minimum(self.size[a], other.size[b])
        for width in np.unique(least):
            mine = np.flatnonzero(least == width)
            for k in range(0, len(mine), step := max(1, COMPARED // int(width))):
                i = mine[k : k + step]
                out[i] = np.bitwise_count(self.folded(a[i], width) ^ other.folded(b[i], width)).sum(axis=1, dtype=np.int64)
        return out


def _unlike(percent: int):
    """The pairs (a, b) of batches (a, b, na, nb, bits of a, bits of b) that the parity bits
    don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.arange(batch.num_rows)
            apart = Parities(batch.column(4)).apart(Parities(batch.column(5)), every, every)
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = pa.array((100 + percent) * apart <= (100 - percent) * n)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return run


def _plausible(pairs: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and parity bits allow the similarity."""
    bits = parities.select("node", "n", "bits")
    both = pairs.join(bits.toDF("a", "na", "ba"), "a").join(bits.toDF("b", "nb", "bb"), "b")
    return both.where(_near(F.col("na"), F.col("nb"), percent)).select("a", "b", "na", "nb", "ba", "bb").mapInArrow(_unlike(percent), "a bigint, b bigint")


def _segments(texts: DataFrame, nodes: DataFrame, k: int, level: np.ndarray, fragments: int) -> DataFrame:
    """(node, n, frag, keys): whole sets of the given nodes, cut by ranges of the order.

    Within a level the order is the hash, so cutting by its low range is even.
    """
    text = texts.join(sized(nodes), "node", "left_semi").select("node", "text")
    keyed = text.mapInArrow(_keys(k, level, lambda n: n, 1), "node bigint, n bigint, keys array<bigint>, bits binary, fold binary")
    cut = F.lit(fragments)
    by_fragment = F.transform(
        F.sequence(F.lit(0), cut - 1),
        lambda f: F.struct(f.alias("frag"), F.filter("keys", lambda x: F.shiftright(x.bitwiseAND((1 << 57) - 1) * cut, 57) == f).alias("keys")),
    )
    return keyed.select("node", "n", F.inline(by_fragment))


def _verified(scratch: Scratch, texts: DataFrame, pairs: DataFrame, k: int, level: np.ndarray, fragments: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose fragment overlaps, counted apart and summed, reach the threshold."""
    nodes = scratch.stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    segments = scratch.stored(_segments(texts, nodes, k, level, fragments), "segments")
    left = segments.toDF("a", "na", "frag", "ka")
    right = segments.toDF("b", "nb", "frag", "kb")
    partial = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ka", "kb")).alias("hits"))
    total = partial.groupBy("a", "b").agg(F.sum("hits").alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    links = scratch.stored(total.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"), "links")
    scratch.drop(nodes, segments)
    return links


def _roots(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, part) of every b of ``links``, which has one smaller a for each b: the root of
    its tree, by doubling the steps up until nothing moves."""
    up = scratch.stored(links.select(F.col("b").alias("node"), F.col("a").alias("part")), "roots")
    while True:
        above = up.toDF("part", "top")
        old = up
        up = scratch.stored(old.join(above, "part", "left").select("node", F.coalesce("top", "part").alias("part"), F.col("top").isNotNull().alias("moved")), "roots")
        moved = up.where("moved").limit(1).count()
        scratch.drop(old)
        up_parts = up.select("node", "part")
        if not moved:
            return up_parts
        old, up = up, scratch.stored(up_parts, "roots")
        scratch.drop(old)


def _between(scratch: Scratch, shared: DataFrame, parts: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes that share a key, lie in different parts and may be similar.

    The members under a key travel in chunks of bounded length with their folded parity bits,
    whose number doesn't grow with the set, and only pairs that these don't rule out become
    rows; each pair is then compared by all its bits. A part of more than CHUNK members has
    chunks of its own, which are never compared with each other.
    """
    labelled = scratch.stored(shared.select("key", "node").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "labelled")
    counts = labelled.groupBy("key", "part").agg(F.count("*").alias("c"))
    small = F.sum(F.when(F.col("c") <= CHUNK, F.col("c")).otherwise(0)).alias("small")
    totals = scratch.stored(counts.groupBy("key").agg(F.count("*").alias("parts"), small, F.sum("c").alias("all")).where("parts > 1").drop("parts"), "totals")
    large = counts.where(F.col("c") > CHUNK)
    sized_ = labelled.join(totals, "key").join(large, ["key", "part"], "left")
    own = F.when(F.col("c").isNotNull(), F.col("part"))
    number = F.when(own.isNotNull(), F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / CHUNK))).otherwise(F.pmod(F.xxhash64("part"), F.ceil(F.col("small") / CHUNK)))
    alone = (F.col("all") <= CHUNK).alias("alone")
    placed = sized_.select("key", "node", "part", own.alias("own"), number.alias("chunk"), alone).join(parities.select("node", "n", "fold"), "node")
    chunks = scratch.stored(placed.groupBy("key", "own", "chunk", "alone").agg(F.collect_list(F.struct("node", "n", "part", "fold")).alias("members")), "open")
    scratch.drop(labelled, totals)
    single = chunks.where("alone").select("members", F.lit(None).cast(chunks.schema["members"].dataType).alias("others"))
    left = chunks.where("NOT alone")
    right = left.select("key", F.col("own").alias("own_b"), F.col("chunk").alias("chunk_b"), F.col("members").alias("others"))
    place, place_b = F.struct(F.col("own"), F.col("chunk")), F.struct(F.col("own_b"), F.col("chunk_b"))
    crossed = left.join(right, "key").where((place <= place_b) & ~F.coalesce(F.col("own") == F.col("own_b"), F.lit(False)))
    same = (place == place_b) & F.col("own").isNull()
    paired = crossed.select("members", F.when(~same, F.col("others")).alias("others"))
    out = scratch.stored(single.unionByName(paired).mapInArrow(_near_bits(percent), "a bigint, b bigint").distinct(), "rest")
    scratch.drop(chunks)
    return out


def _near_bits(percent: int):
    """Pairs (a, b) of members and others (of members among themselves where others is
    null) that differ in part and whose sizes and parity bits allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, x_bits, x_at, _), (y, y_bits, y_at, none) = _members(batch.column(0)), _members(batch.column(1))
            found = [np.zeros((2, 0), np.int64)]
            for i in range(batch.num_rows):
                p = [v[x_at[i] : x_at[i + 1]] for v in x]
                q = p if none[i] else [v[y_at[i] : y_at[i + 1]] for v in y]
                n = p[1][:, None] + q[1][None, :]
                low = np.minimum(p[1][:, None], q[1][None, :])
                ok = (p[2][:, None] != q[2][None, :]) & (100 * low >= percent * (n - low))
                r, c = np.nonzero(np.triu(ok) if none[i] else ok)
                apart = x_bits.apart(x_bits if none[i] else y_bits, x_at[i] + r, (x_at if none[i] else y_at)[i] + c)
                keep = (100 + percent) * apart <= (100 - percent) * n[r, c]
                found.append(np.sort(np.stack([p[0][r[keep]], q[0][c[keep]]]), axis=0))
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _members(column: pa.Array) -> tuple[list[np.ndarray], Parities, np.ndarray, np.ndarray]:
    """([node, n, part], bits, bounds of each row's members, rows that are null)."""
    flat = column.flatten()
    length = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(length.astype(np.int64))])
    return [flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)], Parities(flat.field(3)), at, column.is_null().to_numpy(zero_copy_only=False)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, percent: int = 80, fragments: int = 8) -> DataFrame:
    """One row per input row: ``(id, n_shingles, component_id)``.

    Words are runs of non-white-space bytes, A-Z lower-cased; the set of a document is its
    distinct ``k``-word n-grams (its whole word sequence when shorter). Documents link when
    ``100 * |both| >= percent * |either|``; ``component_id`` is the smallest id reachable.

    * Equal sets are one node before any candidate is made, so copies cost one row each.
    * Candidates share a prefix n-gram. First each is checked against one first member of
      its groups, the one it meets most; what that connects is one part, and then only
      pairs from different parts of a group are still checked. No link between parts is
      lost, and a group of near copies costs a number of checks linear in its size.
    * Common n-grams are last in the order, so they are in the prefix only of documents
      that consist of them.

    Null or wordless text: empty set, no links, own id. A null id is a component of its
    own unless linked, then the smallest id that is not null. Rows that repeat an id with
    other texts are separate nodes; equal rows get equal results. Other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _components(scratch, docs, id_col, text_col, k, percent, fragments)


def _components(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, fragments: int) -> DataFrame:
    rows, texts = _ids(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    seen = scratch.stored(rows.mapInArrow(_summaries(k), f"node bigint, id {kind}, n bigint, s1 bigint, s2 bigint"), "sets")
    level = _levels(seen)

    sets = seen.where("node IS NOT NULL AND n > 0")
    classes = scratch.stored(sets.groupBy("n", "s1", "s2").agg(F.min("node").alias("rep"), F.max("node").alias("last")), "classes")
    copies = scratch.stored(sets.join(classes.where("rep != last"), ["n", "s1", "s2"]).where("node != rep").select("node").distinct(), "copies")

    def prefix(n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)

    first_texts = texts.join(sized(copies), "node", "left_anti").select("node", "text")
    prefixes = scratch.stored(first_texts.mapInArrow(_keys(k, level, prefix, 1), "node bigint, n bigint, keys array<bigint>, bits binary, fold binary").where("n > 0"), "prefixes")
    parities = prefixes.select("node", "n", "bits", "fold")
    exploded = prefixes.select("node", "n", F.explode("keys").alias("key"))
    common = scratch.stored(exploded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "keys")
    shared = scratch.stored(exploded.join(common, "key"), "shared")
    scratch.drop(common, copies)

    first = shared.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"))
    star = shared.join(first, "key").where((F.col("node") != F.col("first.node")) & _near(F.col("n"), F.col("first.n"), percent))
    met = star.groupBy(F.col("first.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("keys"))
    best = met.groupBy("b").agg(F.max(F.struct("keys", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    chosen = scratch.stored(best, "star")
    likely = scratch.stored(_plausible(chosen, parities, percent), "likely")
    links = _verified(scratch, texts, likely, k, level, fragments, percent)
    parts = _roots(scratch, links)

    rest = _between(scratch, shared, parts, parities, percent)
    scratch.drop(shared, likely)
    open_pairs = scratch.stored(_plausible(rest.join(chosen, ["a", "b"], "left_anti"), parities, percent), "likely")
    scratch.drop(prefixes, rest)
    more = _verified(scratch, texts, open_pairs, k, level, fragments, percent)
    for side in ("a", "b"):
        more = more.join(parts.toDF(side, f"part_{side}"), side, "left").withColumn(side, F.coalesce(f"part_{side}", side)).drop(f"part_{side}")
    merged = components(more, scratch)

    top = merged.toDF("part", "component")
    final = parts.join(top, "part", "left").select("node", F.coalesce("component", "part").alias("component"))
    alone = merged.join(parts.select("node"), "node", "left_anti").select("node", "component")
    final = scratch.stored(final.unionByName(alone), "parts")
    found = sets.join(classes.drop("last"), ["n", "s1", "s2"]).join(final.withColumnRenamed("node", "rep"), "rep", "left")
    part = scratch.stored(found.select("id", "n", F.coalesce("component", "rep").alias("part")), "members")
    lowest = scratch.stored(part.groupBy("part").agg(F.min("id").alias("component_id")), "lowest")
    out = part.join(lowest, "part").select("id", F.col("n").alias("n_shingles"), "component_id")
    empty = seen.where("node IS NOT NULL AND n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return scratch.result(out.unionByName(empty).withColumnRenamed("id", id_col), "components")


def _levels(seen: DataFrame) -> np.ndarray:
    """How common each sketch cell is: 0, or from 1 on by powers of two. Cells whose count
    is too low for the table of at most MAX_COMMON_CELLS are found by a histogram of counts."""
    cells = seen.where("node IS NULL").groupBy(F.col("s1").alias("cell")).agg(F.sum("n").alias("c"))
    step = F.floor(F.log2("c") * 8)
    held, least = 0, None
    for r in sorted(cells.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        held += r["n"]
        if held > MAX_COMMON_CELLS:
            break
        least = r["step"]
    common = None if least is None else cells.where(step >= least).toPandas()
    level = np.zeros(CELLS, np.uint8)
    if common is not None:
        base = common["c"].to_numpy()
        level[common["cell"].to_numpy()] = 1 + np.floor(np.log2(base / base.min())).astype(np.uint8)
    return level


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return jaccard_components(table(spark, sf_dir, "documents"))
