"""Long repeats by a run-length index: what a 100-byte string repeats is removed.

Texts are bytes. Every ``LENGTH``-byte string belongs to an anchor, the leftmost of its short
strings with the least hash. Copies of a string have the same anchor, so the work is dealt out
by anchor, and the stretches that belong to anchors ("contexts") carry all matches. Contexts
that are alike as a whole need no index. Two others can only share a string if they also agree
on the ``HALF`` bytes left or on the ``HALF`` bytes right of the anchor; contexts that agree
with no other go. Each bucket of the rest gets a run-compressed Burrows-Wheeler transform with
sampled run ends. The contexts stream through it from right to left, every position's
matching statistic (is it at least LENGTH?) is read off its row, and the earliest occurrence
is located from the samples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Scratch, table

#: Bytes of a repeat, and of an anchor; a window has LENGTH - ANCHOR + 1 anchors.
LENGTH, ANCHOR = 100, 32
SIDE = LENGTH - ANCHOR
#: Of the SIDE bytes that a string has besides its anchor, at least HALF are on one side.
HALF = SIDE // 2
#: Contexts of one group beyond which its strings are compared by hash, spread over tasks.
HOT = 8192
#: Contexts that share a bucket on average.
BUCKET = 4096

ANCHORS = "id bigint, tie bigint, pos bigint, ext int, h bigint, ctx bigint"


def _sliding(x: np.ndarray, width: int, fold) -> np.ndarray:
    """fold over x[j : j + width] for each j."""
    done, out = 1, x
    while 2 * done <= width:
        out = fold(out[:-done], out[done:])
        done *= 2
    return fold(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, position in the block, hash, begin, end) of the anchors of a block of
    documents; begin to end is the stretch of the strings that belong to the anchor."""
    n = len(data)
    start = np.arange(max(n - LENGTH + 1, 0))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(start)]
    start = start[start + LENGTH <= off[doc + 1]]
    if not len(start):
        return tuple(np.zeros(0, np.uint64 if i == 2 else np.int64) for i in range(5))
    at = np.arange(n - ANCHOR + 1)
    h = tb.span_hashes(data, at, at + ANCHOR)
    low = np.uint64((1 << max(20, n.bit_length())) - 1)
    owner = (_sliding((h & ~low) | at.astype(np.uint64), SIDE + 1, np.minimum)[start] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.append(new[1:], len(owner)) - 1
    pos = owner[new]
    return doc[start[new]], pos, h[pos], start[new], start[last] + LENGTH


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every anchor with the hash of its context and its place in it: ``ext`` has the bytes of
    the context before the anchor's start, times 128, and those from there on."""
    for batch in batches:
        for lo, hi, data, off in tb.blocks(batch.column(2)):
            doc, pos, h, s, e = anchors(data, off)
            ext = (pos - s) * 128 + (e - pos)
            ctx = tb.mix(tb.span_hashes(data, s, e) + ext.astype(np.uint64)) if len(pos) else h
            take = lambda i: batch.column(i)[lo:hi].take(pa.array(doc))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([take(0), take(1), pa.array(pos - off[doc]), pa.array(ext, pa.int32()), *[pa.array(x.view(np.int64)) for x in (h, ctx)]], names=["id", "tie", "pos", "ext", "h", "ctx"])


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of pieces, each with an end of its own.

    It keeps one row per run (where it begins, its backward step, and a sample of the text
    places at the step's row and the row above), the rows at which the first LENGTH symbols
    change (with the text place of the last row before each), and no suffix array.
    """

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1]
        ends = self.first + self.size
        total = int((self.size + 1).sum())
        symbol = np.zeros(total, np.int64)
        body = np.ones(total, bool)
        body[ends] = False
        symbol[body] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
        order, common = _suffixes(symbol, ends)
        self.bounds = np.concatenate([[0], np.flatnonzero(~common) + 1, [total]])
        self.tops = order[self.bounds[1:] - 1]
        before = symbol[order - 1]
        heads = np.concatenate([[0], np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1])
        length = np.diff(np.append(heads, total))
        by_symbol = np.argsort(before[heads], kind="stable")
        self.heads, self.step = heads, np.empty(len(heads), np.int64)
        self.step[by_symbol] = np.concatenate([[0], np.cumsum(length[by_symbol])])[:-1]
        # Samples: the text place one step back from each run's first row, and the place that
        # stands a row above that one.
        back, over_end = (order[heads] - 1) % total, before[heads] == 0
        end_before = np.concatenate([[-1], ends])[np.searchsorted(ends, back)]
        above = np.where(over_end, end_before, order[np.maximum(self.step, 1) - 1])
        at = np.argsort(back)
        self.sampled, self.above = back[at], above[at]

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(text place, class) of every position whose matching statistic against the other
        positions is LENGTH or more, all pieces stepping left together; positions of one
        class start with the same LENGTH symbols."""
        many = np.diff(self.bounds) > 1
        order = np.argsort(-self.size, kind="stable")
        row, longest = order.copy(), self.size[order]  # the row of a piece's end is its number
        places, classes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t in range(1, int(longest[0] if len(longest) else 0) + 1):
            live = int(np.searchsorted(-longest, -t, side="right"))
            run = np.searchsorted(self.heads, row[:live], side="right") - 1
            row = self.step[run] + row[:live] - self.heads[run]
            if t >= LENGTH:
                cls = np.searchsorted(self.bounds, row, side="right") - 1
                hit = np.flatnonzero(many[cls])
                places.append(self.first[order[hit]] + longest[hit] - t)
                classes.append(cls[hit])
        return np.concatenate(places), np.concatenate(classes)

    def earliest(self, code: np.ndarray) -> np.ndarray:
        """The least ``code`` (by text place) of every class: from the sampled last row of the
        class upwards. The place in the row above follows from the next sample on: nearer
        places of the two rows run in parallel."""
        size = np.diff(self.bounds)
        first = code[self.tops]
        live = np.flatnonzero(size > 1)
        at = self.tops[live]
        for t in range(1, int(size.max(initial=1))):
            keep = size[live] > t
            live, at = live[keep], at[keep]
            j = np.searchsorted(self.sampled, at)
            at = self.above[j] - (self.sampled[j] - at)
            first[live] = np.minimum(first[live], code[at])
        return first


def _suffixes(symbol: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, does each row but the first share LENGTH symbols with the row before).

    Ends (symbol 0) rank by their place. Ranks by the first symbols double in depth; the
    suffixes of a piece all differ by its end at the latest.
    """
    total, bits = len(symbol), len(ends).bit_length()
    depth = min(5, (63 - bits) // 9)
    piece = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
    left = ends[piece] - np.arange(total)  # symbols before the end
    wide = np.concatenate([symbol, np.zeros(depth, np.int64)])
    key = np.zeros(total, np.int64)
    for i in range(depth):
        key <<= 9
        key += wide[i : i + total] * (left > i)
    # A suffix that ends within its key differs from all others by the number of its end.
    key <<= bits
    key += np.where(left < depth, piece, 0)
    half = None
    while True:
        order = np.argsort(key)
        key = key[order]
        new = np.zeros(total, np.int64)
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        rank = np.empty(total, np.int64)
        rank[order] = new
        if depth <= LENGTH:
            half, reach = rank, depth
        if new[-1] == total - 1:
            break
        key = rank * (total + 1)
        key[: max(total - depth, 0)] += rank[depth:] + 1
        depth *= 2
    # Two ranks of the depth below LENGTH, overlapping, cover LENGTH symbols; where all
    # suffixes differ before that depth, none share so many.
    if 2 * reach < LENGTH:
        return order, np.zeros(total - 1, bool)
    padded = np.concatenate([half, np.full(LENGTH, -1, np.int64)])
    a, b = order[:-1], order[1:]
    return order, (half[a] == half[b]) & (padded[a + LENGTH - reach] == padded[b + LENGTH - reach])


def _alone(hashes: pd.Series) -> np.ndarray:
    """Rows whose value no other has, or that have none."""
    return ~(hashes.notna() & hashes.duplicated(keep=False)).to_numpy()


def _indexed(frame: pd.DataFrame) -> pd.DataFrame:
    """Spans of a bucket's contexts that an earlier string covers."""
    frame = frame[~(_alone(frame["left"]) & _alone(frame["right"]))]
    frame = frame.sort_values(["id", "tie", "lo"], kind="stable").reset_index(drop=True)
    if not len(frame):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("id", "tie", "s", "e")})
    doc = np.cumsum(((frame["id"].diff().fillna(1) != 0) | (frame["tie"].diff().fillna(1) != 0)).to_numpy())
    index = RunIndex(list(frame["piece"]))
    place, cls = index.statistics()
    lo = frame["lo"].to_numpy(np.int64)
    code = np.repeat((doc.astype(np.int64) << 34) + lo - index.first, index.size + 1) + np.arange(int((index.size + 1).sum()))
    hit = place[index.earliest(code)[cls] < code[place]]
    owner = np.searchsorted(index.first, hit, side="right") - 1
    return _merged(frame, owner, lo[owner] + hit - index.first[owner])


def _merged(frame: pd.DataFrame, owner: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + LENGTH)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(owner))[: len(at)] - 1
    o = owner[at]
    return pd.DataFrame({"id": frame["id"].to_numpy()[o], "tie": frame["tie"].to_numpy()[o], "s": start[at], "e": start[last] + LENGTH})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of each document as bytes, with the hashes of the anchor and HALF bytes
    to its left and to its right (null where the context has fewer)."""
    for batch in batches:
        places = batch.column(3)
        for lo, hi, data, off in tb.blocks(batch.column(2)):
            mine = places[lo:hi]
            flat = mine.flatten()
            pos, ext = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "ext"))
            doc = np.repeat(np.arange(hi - lo), np.diff(np.asarray(mine.offsets)))
            at = pos + off[doc]
            s, e = at - (ext >> 7), at + (ext & 127)
            half = []
            for number, a, b in ((1, at - HALF, at + ANCHOR), (2, at, at + ANCHOR + HALF)):
                ok = (a >= s) & (b <= e)
                h = np.zeros(len(at), np.uint64)
                h[ok] = tb.mix(tb.span_hashes(data, a[ok], b[ok]) ^ np.uint64(number)) if ok.any() else h[ok]
                half.append(pa.array(h.view(np.int64), mask=~ok))
            raw = data.tobytes()
            piece = pa.array([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())
            take = lambda i: batch.column(i)[lo:hi].take(pa.array(doc))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([take(0), take(1), pa.array(s - off[doc]), *[flat.field(c) for c in ("h", "n", "ctx")], *half, piece], names=["id", "tie", "lo", "h", "n", "ctx", "left", "right", "piece"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every LENGTH-byte string of the contexts of crowded anchors, by two hashes."""
    for batch in batches:
        for i, t, lo, piece in zip(*(batch.column(c).to_pylist() for c in ("id", "tie", "lo", "piece")), strict=True):
            data = np.frombuffer(piece, np.uint8)
            s = np.arange(len(data) - LENGTH + 1)
            if len(s):
                a, b = tb.span_hashes(data, s, s + LENGTH), tb.span_hashes(data[::-1].copy(), s, s + LENGTH)[::-1]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(s), pa.int64()), pa.array([t] * len(s), pa.int64()), pa.array(s + lo), pa.array(a.view(np.int64)), pa.array(b.view(np.int64).copy())], names=["id", "tie", "s", "a", "b"])


def _finish(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, at, kept, merged = text.encode(), 0, [], []
                for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                for s, e in merged:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                ids.append(i)
                rows.append((len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]][: len(names)], names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, with_text: bool = False) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256[, kept])`` for every row.

    Each byte covered by a LENGTH-byte string that also starts earlier (smaller id, or same
    document and smaller start) goes; judged on the input. Null texts are empty. Rows that
    repeat an id with other texts are ordered by a hash of the text; equal rows are not
    earlier than each other. A null id comes first. ``kept`` may hold replacement
    characters where a cut fell inside a character.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _removed(scratch, docs, id_col, text_col, with_text)


def _removed(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    odd = base.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    rows = base.select("id", (F.xxhash64("text") if odd else F.lit(0).cast("long")).alias("tie"), "text")

    found = scratch.stored(rows.where(F.octet_length("text") >= LENGTH).mapInArrow(_anchor_rows, ANCHORS), "anchors")
    again = scratch.stored(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "again")
    met = scratch.stored(found.join(again, "h"), "met")
    scratch.drop(found, again)
    place = F.struct("id", "tie", "pos")
    firsts = scratch.stored(met.groupBy("h", "ctx").agg(F.min(F.struct("id", "tie", "pos", "ext")).alias("first"), F.count("*").alias("c")), "firsts")
    copies = met.join(firsts.where("c > 1").select("h", "ctx", F.struct("first.id", "first.tie", "first.pos").alias("first")), ["h", "ctx"]).where(place != F.col("first"))
    begin, end = F.col("pos") - F.shiftright("ext", 7), F.col("pos") + F.col("ext").bitwiseAND(127)
    whole = scratch.stored(copies.select("id", "tie", begin.alias("s"), end.alias("e")), "whole")
    scratch.drop(met)

    crowd = firsts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    places = firsts.join(crowd, "h").groupBy(F.col("first.id").alias("id"), F.col("first.tie").alias("tie")).agg(F.collect_list(F.struct("first.pos", "first.ext", "h", "n", "ctx")).alias("places"))
    text = rows.dropDuplicates(["id", "tie"]) if odd else rows
    cut = text.join(places, ["id", "tie"]).select("id", "tie", "text", "places")
    pieces = scratch.stored(cut.mapInArrow(_cut, "id bigint, tie bigint, lo bigint, h bigint, n bigint, ctx bigint, left bigint, right bigint, piece binary"), "contexts")
    scratch.drop(firsts)

    span = "id bigint, tie bigint, s bigint, e bigint"
    buckets = max(1, pieces.where(F.col("n") <= HOT).count() // BUCKET)
    few = pieces.where(F.col("n") <= HOT).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    # The contexts of a crowded anchor are dealt out by its halves; of what is crowded even so,
    # the strings are compared by hash.
    halves = pieces.where(F.col("n") > HOT).withColumn("g", F.explode(F.array("left", "right"))).where("g IS NOT NULL")
    groups = halves.groupBy("g").agg(F.min("ctx").alias("a"), F.max("ctx").alias("b"), F.count("*").alias("m")).where("a != b").select("g", "m")
    near = scratch.stored(halves.join(groups, "g"), "near")
    many = near.where(F.col("m") <= HOT).withColumn("bucket", -1 - F.pmod(F.xxhash64("g"), F.lit(buckets)))
    columns = ["bucket", "id", "tie", "lo", "left", "right", "piece"]
    indexed = few.select(columns).unionByName(many.select(columns)).groupBy("bucket").applyInPandas(_indexed, span)
    strings = near.where(F.col("m") > HOT).select("id", "tie", "lo", "piece").mapInArrow(_windows, "id bigint, tie bigint, s bigint, a bigint, b bigint").dropDuplicates()
    earliest = strings.groupBy("a", "b").agg(F.min(F.struct("id", "tie", "s")).alias("first"), F.count("*").alias("c")).where("c > 1")
    crowded = strings.join(earliest, ["a", "b"]).where(F.struct("id", "tie", "s") > F.col("first")).select("id", "tie", "s", (F.col("s") + LENGTH).alias("e"))
    spans = whole.unionByName(indexed).unionByName(crowded).groupBy("id", "tie").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    spans = scratch.stored(spans, "spans")
    scratch.drop(near, pieces, whole)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5]
    kinds = ["bigint", "bigint", "bigint", "bigint", "string", "string"]
    done = rows.join(spans, ["id", "tie"], "left").select("id", "text", "spans").mapInArrow(_finish(names), ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=False)))
    return scratch.result(done.withColumn("id", F.when(F.col("id") != -(2**63), F.col("id"))).withColumnRenamed("id", id_col), "kept")


def op4_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
