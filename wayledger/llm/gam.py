"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are counted on byte arrays in Spark tasks. Cyclic boosting fits
shallow trees, one feature after the other, on binned features; the trees of a feature add
up to a lookup table. Then the strongest feature pairs get tables of their own on coarser
bins. A score is a sum of table entries, taken by vectorised bin lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import crc_mod, small_batches, table

#: Most labelled rows the model is fitted on, those with the least hashes of the id.
MAX_TRAIN = 20_000
BINS, PAIR_BINS, PAIRS = 48, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST_ROWS = 120, 60, 0.1, 20

FEATURES = (
    "log_words", "word_bytes", "long_words", "upper", "digit", "space", "newline", "comma", "stop", "quote",
    "bang", "hash_dollar", "percent_amp_star", "pipe", "other_symbol", "non_ascii", "distinct", "repeated_bigrams", "symbol_words", "one_byte_words",
)


def _classes() -> np.ndarray:
    """Byte -> class number; the classes are counted per text."""
    c = np.zeros(256, np.uint8)
    groups = [bytes(range(65, 91)), b"0123456789", b" \t", b"\n\r", b",;", b".:?", b"\"'()", b"!", b"#$", b"%&*", b"|", b"+-/<=>@[\\]^_`{}~"]
    for i, g in enumerate(groups, 1):
        c[list(g)] = i
    c[128:] = len(groups) + 1
    return c


_CLASS = _classes()
_KINDS = 14


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x FEATURES of a block of texts."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * _KINDS + _CLASS[data], minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    share = counts / np.maximum(size, 1)[:, None]
    w = tb.words(data, off, tb.NON_SPACE)
    words = np.diff(w.first)
    wdoc = w.doc()
    at_least = np.maximum(words, 1)
    length = w.end - w.start
    per = lambda x: np.bincount(wdoc, weights=x.astype(float), minlength=n) / at_least
    order = np.lexsort((w.hash, wdoc))
    d, h = wdoc[order], w.hash[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    distinct = np.bincount(d[new], minlength=n) / at_least
    bd, _ = tb.shingles(w, 2)
    repeated = 1 - np.bincount(bd, minlength=n) / np.maximum(words - 1, 1)
    last = _CLASS[w.data[w.end - 1]] if len(w.end) else np.zeros(0, np.uint8)
    marked = np.isin(last, (7, 8, 9, 10, 11, 12))
    x = [
        np.log1p(words), per(length), per(length > 12), share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6], share[:, 7],
        share[:, 8], share[:, 9], share[:, 10], share[:, 11], share[:, 12], share[:, 13], distinct, np.clip(repeated, 0, 1), per(marked), per(length == 1),
    ]
    return np.stack(x, axis=1)


def featurise(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row and ``x``, the features of its whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tb.blocks(batch.column(len(keep))):
                x = features(data, off)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(i)[lo:hi] for i in range(len(keep))] + [flat], names=[*keep, "x"])

    rows = docs.select(*keep, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, x array<double>")


@dataclass
class Additive:
    """The fitted tables: cut points and one table per feature, and one per chosen pair."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (cut, tab) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += tab[np.searchsorted(cut, x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_cuts[j], x[:, j], side="right") for p in self.pairs for j in p[:2]}
        for i, j, tab in self.pairs:
            out += tab[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) if len(v) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of two levels over one feature's histogram."""
    value = np.zeros(len(g))

    def split(lo: int, hi: int, depth: int) -> None:
        cg, ch, cn = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi]), np.cumsum(n[lo:hi])
        tg, th, tn = cg[-1], ch[-1], cn[-1]
        ok = (cn[:-1] >= LEAST_ROWS) & (tn - cn[:-1] >= LEAST_ROWS)
        if depth == 0 or not ok.any():
            value[lo:hi] = tg / (th + 1.0)
            return
        gain = np.where(ok, _gain(cg[:-1], ch[:-1]) + _gain(tg - cg[:-1], th - ch[:-1]), -np.inf)
        at = lo + 1 + int(np.argmax(gain))
        split(lo, at, depth - 1)
        split(at, hi, depth - 1)

    split(0, len(g), 2)
    return value


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best quadrant split of a pair's histogram."""
    best, value = 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    base = _gain(cg[-1, -1], ch[-1, -1])
    for a in range(g.shape[0] - 1):
        for b in range(g.shape[1] - 1):
            q = [(c[a, b], c[a, -1] - c[a, b], c[-1, b] - c[a, b], c[-1, -1] - c[a, -1] - c[-1, b] + c[a, b]) for c in (cg, ch)]
            gain = sum(_gain(x, y) for x, y in zip(*q, strict=True)) - base
            if gain > best:
                best, v = gain, [x / (y + 1.0) for x, y in zip(*q, strict=True)]
                value = np.empty_like(g)
                value[: a + 1, : b + 1], value[: a + 1, b + 1 :], value[a + 1 :, : b + 1], value[a + 1 :, b + 1 :] = v
    return best, value


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boost feature by feature in turn, then the strongest pairs; ties by feature order.

    With no rows the score is 0.5 for every text; with one class it is that class.
    """
    m = x.shape[1]
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Additive(float(np.log(rate / (1 - rate))), [_cuts(x[:, j], BINS) for j in range(m)], [], [_cuts(x[:, j], PAIR_BINS) for j in range(m)], [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if len(y) < 2 * LEAST_ROWS:
        return model
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    count = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    f = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j in range(m):
            if len(model.tables[j]) > 1:
                p = 1 / (1 + np.exp(-f))
                g = np.bincount(bins[j], weights=y - p, minlength=len(count[j]))
                h = np.bincount(bins[j], weights=p * (1 - p), minlength=len(count[j]))
                step = RATE * _tree(g, h, count[j])
                model.tables[j] += step
                f += step[bins[j]]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]
    width = [len(c) + 1 for c in model.pair_cuts]

    def histograms(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        at = coarse[i] * width[j] + coarse[j]
        return tuple(np.bincount(at, weights=v, minlength=width[i] * width[j]).reshape(width[i], width[j]) for v in (y - p, p * (1 - p)))

    found = sorted((-_pair_tree(*histograms(i, j))[0], i, j) for i in range(m) for j in range(i) if width[i] > 1 and width[j] > 1)
    model.pairs = [(i, j, np.zeros((width[i], width[j]))) for gain, i, j in found[:PAIRS] if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, tab in model.pairs:
            step = RATE * _pair_tree(*histograms(i, j))[1]
            tab += step
            f += step[coarse[i], coarse[j]]
    return model


def training_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y) of at most MAX_TRAIN ids outside the held-out third, those with the least
    hashes. Repeated labels of an id count as their mean, rounded; null labels and ids are
    left out. The hash bound is four deviations below MAX_TRAIN, so nothing is sorted."""
    y = labels.where(F.col(label_col).isNotNull() & (crc_mod(id_col, 3) != 1)).groupBy(id_col).agg(F.round(F.avg(label_col)).cast("double").alias("y"))
    n = y.count()
    if n <= MAX_TRAIN:
        return y
    bound = int((MAX_TRAIN - 4 * MAX_TRAIN**0.5) / n * 2**63)
    return y.where(F.shiftrightunsigned(F.xxhash64(id_col), 1) < bound).limit(MAX_TRAIN)


def fit_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Additive:
    """Fit on the labelled rows that ``training_ids`` chooses: their features alone come to
    the driver, MAX_TRAIN rows at most."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(training_ids(labels, id_col, label_col).withColumnRenamed(id_col, "id")), "id")
    sample = featurise(chosen, ["id", "y"]).limit(MAX_TRAIN).toPandas().sort_values("id", kind="stable")
    x = np.stack(sample["x"].to_numpy()) if len(sample) else np.zeros((0, len(FEATURES)))
    return fit(x, sample["y"].to_numpy(float))


def scorer(model: Additive, text_col: str = "text") -> Column:
    """Column of the probability of label 1 of each whole text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(model.score(features(data, off)) for _, _, data, off in tb.blocks(texts))]))

    return score(text_col)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``held_out``, ``score`` and ``predicted`` for every row.

    Labels are learnt only from rows whose crc32(id) mod 3 is not 1. Empty and null texts
    are scored like any other; rows repeating an id are scored on their own. Without labels
    every score is 0.5. Kept columns with the names of the new ones are left out.
    """
    small_batches(docs.sparkSession)
    model = fit_labels(docs, labels, id_col, text_col)
    new = ["held_out", "score", "predicted"]
    keep = [c for c in keep if c not in new]
    scored = docs.select(*dict.fromkeys([*keep, id_col, text_col])).withColumn("held_out", F.coalesce(crc_mod(id_col, 3) == 1, F.lit(False))).withColumn("score", scorer(model, text_col))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(*keep, *new)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
