"""Hidden Markov language model: latent states over word classes, exact likelihoods.

A word's class is itself if it is among the most frequent ``OWN`` words, else one of
``BUCKETS`` spelling buckets (first two and last two bytes). The hidden chain emits
classes; within a bucket a word has an add-one share of the bucket's corpus counts, one
share kept for unseen words, so the model is a proper distribution over word sequences.
Class tables have a fixed size; word counts stay a distributed table that grows with the
corpus. At most ``HEAD`` of the most frequent counts also go to every task, and words beyond
them are looked up by a join. Texts are read twice, to count and to encode; training and
scoring read the encoded classes.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Scratch, crc_mod, stored, table

OWN = 4096
BUCKETS = 4096
HEAD = 1 << 17
STATES = 8
#: Rounds of clustering that the first states come from, and of Baum-Welch; each is a pass
#: over all training documents.
SEED_ROUNDS = 3
ROUNDS = 3
#: Words of a training window. Scores are over whole documents.
WINDOW = 512
#: Tokens that are stepped through together.
STEP_TOKENS = 1 << 18
#: Tokens from which a sequence is scored by segments of so many.
LONG = 2048
#: Distinct words a counting task holds before it hands them on.
HELD = 1 << 20
END = np.uint64(0x0E0E0E0E0E0E0E0E)
SMOOTH = 20.0


def _buckets(w: tb.Words) -> np.ndarray:
    """The spelling bucket of each word."""
    d = w.data.astype(np.uint64)
    n = w.end - w.start
    key = d[w.start] + (d[np.minimum(w.start + 1, w.end - 1)] << np.uint64(8)) + (d[w.end - 1] << np.uint64(16)) + (d[np.maximum(w.end - 2, w.start)] << np.uint64(24))
    return (tb.mix(key + (np.minimum(n, 4).astype(np.uint64) << np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def _tokens(batch_texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, token hashes, buckets, first token of each row); every
    document ends in END, whose bucket is -1."""
    for lo, hi, data, off in tb.blocks(batch_texts):
        w = tb.words(data, off, tb.NON_SPACE)
        first = w.first + np.arange(len(w.first))
        h = np.full(first[-1], END, np.uint64)
        b = np.full(first[-1], -1, np.int64)
        at = np.arange(len(w.hash)) + w.doc()
        h[at], b[at] = w.hash, _buckets(w)
        yield lo, hi, h, b, first


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
        u, at, inv = np.unique(h, return_index=True, return_inverse=True)
        return u, b[at], np.bincount(inv, weights=n).astype(np.int64)

    for batch in batches:
        for _, _, h, b, _ in _tokens(batch.column(0)):
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, b[at], n))
            size += len(u)
            if size > 2 * HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD:
                    yield _rows(word=held[0][0].view(np.int64), bucket=held[0][1], n=held[0][2])
                    held, size = [], 0
    if held:
        u, b, n = merged()
        yield _rows(word=u.view(np.int64), bucket=b, n=n)


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


class Vocabulary:
    """What every task knows of the counts: the head words, and totals of the buckets."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, bucket_mass: np.ndarray, own_mass: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        rank = np.arange(len(words))
        self.own = np.where(rank < OWN, rank, -1)[order]
        self.bucket_mass = bucket_mass
        self.prior = np.concatenate([own_mass, bucket_mass]) + 0.5
        self.prior /= self.prior.sum()

    def lookup(self, h: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, count, known to be in the head) of each token."""
        if not len(self.words):
            return OWN + np.maximum(b, 0), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        head = self.words[at] == h
        own = np.where(head, self.own[at], -1)
        return np.where(own >= 0, own, OWN + np.maximum(b, 0)), np.where(head, self.counts[at], 0), head


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # K, K x K, classes x K

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
        emit = emit + SMOOTH * prior[:, None]
        move = move + 0.1
        start = start + 0.1
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def loglik(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log likelihood of each sequence by the scaled forward recursion. Sequences
        of more than LONG tokens go by segments, so that one text isn't as many steps as it
        has tokens."""
        n = np.diff(first)
        out = np.zeros(len(n))
        for long in (False, True):
            mine = np.flatnonzero((n > LONG) == long)
            if len(mine):
                out[mine] = (self._by_segments if long else self._by_steps)(symbols, first[mine], n[mine])
        return out

    def _by_segments(self, symbols: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each segment's product of steps, all segments stepping together; then each
        sequence's segments in turn."""
        k = len(self.start)
        at = [np.arange(b + 1, b + m, LONG) for b, m in zip(begin, n, strict=True)]
        count = np.array([len(x) for x in at])
        end = np.repeat(begin + n, count)
        at = np.concatenate(at)
        size = np.minimum(end - at, LONG)
        order = np.argsort(-size, kind="stable")
        at, size = at[order], size[order]
        product = np.broadcast_to(np.eye(k), (len(at), k, k)).copy()
        logs = np.zeros(len(at))
        for t in range(int(size[0])):
            live = int(np.searchsorted(-size, -t, side="left"))
            step = (product[:live] @ self.move) * self.emit[symbols[at[:live] + t]][:, None, :]
            scale = step.sum((1, 2))
            product[:live] = step / scale[:, None, None]
            logs[:live] += np.log(scale)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        out, seen = np.zeros(len(n)), 0
        for i, c in enumerate(count):
            v = self.start * self.emit[symbols[begin[i]]]
            for j in back[seen : seen + c]:
                out[i] += np.log(v.sum()) + logs[j]
                v = (v / v.sum()) @ product[j]
            out[i] += np.log(v.sum())
            seen += c
        return out

    def _by_steps(self, symbols: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """All sequences stepping together, longest first."""
        order = np.argsort(-n, kind="stable")
        at, n = begin[order], n[order]
        out = np.zeros(len(n))
        live = int((n > 0).sum())
        alpha = np.broadcast_to(self.start, (live, len(self.start)))
        t = 0
        while live:
            alpha = alpha[:live] @ self.move if t else alpha
            alpha = alpha * self.emit[symbols[at[:live] + t]]
            scale = alpha.sum(1)
            alpha = alpha / scale[:, None]
            out[:live] += np.log(scale)
            t += 1
            live = int(np.searchsorted(-n, -t, side="left"))
        back = np.empty(len(n))
        back[order] = out
        return back

    def expected(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts (start, move, emit) of windows of at most WINDOW tokens."""
        k = len(self.start)
        at = np.concatenate([np.arange(a, b, WINDOW) for a, b in zip(first[:-1], first[1:], strict=True)]) if len(first) > 1 else np.zeros(0, np.int64)
        n = np.minimum(np.append(at[1:], first[-1]) - at, WINDOW)
        order = np.argsort(-n, kind="stable")
        at, n = at[order], n[order]
        top = int(n[0]) if len(n) else 0
        width = [int(np.searchsorted(-n, -t, side="left")) for t in range(top + 1)]  # sequences longer than t
        alphas, scales = [], []
        alpha = np.broadcast_to(self.start, (len(n), k))
        for t in range(top):
            live = width[t]
            alpha = alpha[:live] @ self.move if t else alpha
            alpha = alpha * self.emit[symbols[at[:live] + t]]
            s = alpha.sum(1, keepdims=True)
            alpha = alpha / s
            alphas.append(alpha)
            scales.append(s)
        move = np.zeros((k, k))
        emit = np.zeros_like(self.emit)
        gammas, places = [], []
        beta = np.ones((0, k))
        for t in range(top - 1, -1, -1):
            live = width[t]
            if t + 1 < top:
                nxt = width[t + 1]
                eb = self.emit[symbols[at[:nxt] + t + 1]] * beta / scales[t + 1]
                move += alphas[t][:nxt].T @ eb
                beta = np.concatenate([eb @ self.move.T, np.ones((live - nxt, k))])
            else:
                beta = np.ones((live, k))
            gammas.append(alphas[t] * beta)
            places.append(symbols[at[:live] + t])
        if gammas:
            sym, g = np.concatenate(places), np.concatenate(gammas)
            for j in range(k):
                emit[:, j] = np.bincount(sym, weights=g[:, j], minlength=len(emit))
            start = gammas[-1].sum(0)
        else:
            start = np.zeros(k)
        return start, move * self.move, emit


def _encode(vocabulary: Vocabulary) -> Callable:
    """Task function over (id, train, text): each document's classes, the part of its scores
    that doesn't depend on the model, and its words beyond the head with their numbers."""
    logs = np.log10(vocabulary.bucket_mass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, b, first in _tokens(batch.column(2)):
                symbol, count, head = vocabulary.lookup(h, b)
                m, n = hi - lo, np.diff(first)
                doc = np.repeat(np.arange(m), n)
                log_count = np.log10(count + 1.0)
                inside = symbol >= OWN
                part = np.where(inside & head, log_count, 0.0) - np.where(inside, logs[np.maximum(b, 0)], 0.0)
                rest = np.flatnonzero(~head)
                order = rest[np.lexsort((h[rest], doc[rest]))]
                d, w = doc[order], h[order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
                begin = np.flatnonzero(new)
                offsets = pa.array(np.searchsorted(d[begin], np.arange(m + 1)), pa.int32())
                symbols = pa.Array.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(2 * first), pa.py_buffer(symbol.astype("<u2"))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((secrets.randbits(62) + np.arange(m)).astype(np.int64)),
                        batch.column(0)[lo:hi],
                        batch.column(1)[lo:hi],
                        pa.array(n, pa.int64()),
                        pa.array(np.bincount(doc[head], minlength=m), pa.int64()),
                        pa.array(np.bincount(doc, weights=log_count, minlength=m)),
                        pa.array(np.bincount(doc, weights=part, minlength=m)),
                        pa.ListArray.from_arrays(offsets, pa.array(w[begin].view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(begin, len(d))), pa.int64())),
                        symbols.cast(pa.binary()),
                    ],
                    names=["row", "id", "train", "n_tokens", "n_known", "base", "part", "rest", "times", "symbols"],
                )

    return run


ENCODED = "row bigint, id bigint, train boolean, n_tokens bigint, n_known bigint, base double, part double, rest array<bigint>, times array<bigint>, symbols binary"


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, store: Callable = stored) -> DataFrame:
    """The encoded documents, written to the shared folder. Null text: an end alone."""
    rows = docs.select(F.col(id_col).cast("long"), F.lit(True) if train is None else train, F.col(text_col))
    return store(rows.mapInArrow(_encode(vocabulary), ENCODED), "encoded")


def _sequences(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their classes end to end, first class of each row) of about STEP_TOKENS."""
    for batch in batches:
        col = batch.column(column).cast(pa.large_binary())
        _, off, data = col.buffers()
        off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] // 2
        every = np.frombuffer(data, "<u2") if data is not None and data.size else np.zeros(0, np.uint16)
        lo = 0
        while lo < len(col):
            hi = min(len(col), max(lo + 1, int(np.searchsorted(off, off[lo] + STEP_TOKENS, side="right")) - 1))
            yield batch.slice(lo, hi - lo), every[off[lo] : off[hi]].astype(np.int64), off[lo : hi + 1] - off[lo]
            lo = hi


def _clusters(weights: np.ndarray) -> Callable:
    """Task function: this partition's class counts by state as (place, value) rows. A
    document belongs to the state in which its tokens' weights have the highest sum."""
    states = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weights.size, np.int64)
        for _, symbols, first in _sequences(batches, 0):
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            fit = [np.bincount(doc, weights=weights[symbols, j], minlength=len(n)) for j in range(states)]
            total += np.bincount(symbols * states + np.argmax(fit, axis=0)[doc], minlength=weights.size)
        at = np.flatnonzero(total)
        yield _rows(place=at, value=total[at].astype(float))

    return run


def _summed(encoded: DataFrame, task: Callable, size: int) -> np.ndarray:
    """The (place, value) rows of all partitions, summed by place."""
    got = encoded.select("symbols").mapInArrow(task, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    flat = np.zeros(size)
    flat[got["place"].to_numpy()] = got["value"].to_numpy()
    return flat


def _seed(encoded: DataFrame, vocabulary: Vocabulary, states: int, rounds: int) -> Model:
    """States from clusters of all documents: first by random directions from the corpus'
    class shares, then by the class shares of the clusters of the round before. No rounds
    give a uniform model."""
    classes = OWN + BUCKETS
    weights = np.random.default_rng(7).standard_normal((classes, states))
    weights -= vocabulary.prior @ weights
    emit = np.zeros((classes, states))
    for _ in range(rounds):
        emit = _summed(encoded, _clusters(weights), classes * states).reshape(classes, states)
        shares = emit + SMOOTH * vocabulary.prior[:, None]
        weights = np.log(shares / shares.sum(0))
    return Model.of_counts(np.ones(states), np.full((states, states), 2.0) + 100 * np.eye(states), emit, vocabulary.prior)


def _baum_welch(model: Model) -> Callable:
    """Task function: this partition's expected counts as (place, value) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, symbols, first in _sequences(batches, 0):
            got = np.concatenate([c.ravel() for c in model.expected(symbols, first)])
            total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total > 1e-9)
            yield _rows(place=at, value=total[at])

    return run


def count(docs: DataFrame, text_col: str = "text", store: Callable = stored) -> tuple[DataFrame, Vocabulary, int, int]:
    """(word counts, vocabulary, tokens, distinct tokens) of every word of every document.

    The head is the words that occur more often than a bound, which a histogram of the
    counts gives, so that the driver receives those words alone, HEAD at most.
    """
    counted = docs.select(text_col).mapInArrow(_count_words, "word bigint, bucket bigint, n bigint")
    counts = store(counted.groupBy("word").agg(F.first("bucket").alias("bucket"), F.sum("n").alias("n")), "counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log2("n") * 8)
    held, least = 1, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("c")).collect(), key=lambda r: -r["step"]):
        held += r["c"]
        if held > HEAD:
            break
        least = r["step"]
    often = F.col("bucket") < 0 if least is None else (F.col("bucket") < 0) | (step >= least)
    head = counts.where(often).toPandas()
    head = head.assign(end=head["bucket"] >= 0, back=-head["n"]).sort_values(["end", "back", "word"])
    words, n = head["word"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64)
    own = np.zeros(OWN)
    own[: min(OWN, len(n))] = n[:OWN]
    mass = np.zeros(BUCKETS)
    for r in counts.where("bucket >= 0").groupBy("bucket").agg((F.sum("n") + F.count("*")).alias("m")).collect():
        mass[r["bucket"]] = r["m"]
    inside = head["bucket"].to_numpy()[:OWN]
    np.subtract.at(mass, inside[inside >= 0], (n[:OWN] + 1)[inside >= 0])
    return counts, Vocabulary(words, n, mass + 1, own), int(tokens), int(distinct)


def fit(encoded: DataFrame, vocabulary: Vocabulary, *, states: int = STATES, seed_rounds: int = SEED_ROUNDS, rounds: int = ROUNDS) -> Model:
    """First states and Baum-Welch rounds over every token of every encoded document. Each
    round's counts are summed across partitions; what the driver receives has the size of
    the model."""
    model = _seed(encoded, vocabulary, states, seed_rounds)
    classes = OWN + BUCKETS
    for _ in range(rounds):
        flat = _summed(encoded, _baum_welch(model), states + states * states + classes * states)
        start, move, emit = np.split(flat, [states, states + states * states])
        model = Model.of_counts(start, move.reshape(states, states), emit.reshape(classes, states), vocabulary.prior)
    return model


def train(docs: DataFrame, text_col: str = "text", *, states: int = STATES, rounds: int = ROUNDS) -> tuple[DataFrame, Vocabulary, Model, int, int]:
    """(word counts, vocabulary, model, tokens, distinct tokens) of the training documents.
    An empty table gives a uniform model."""
    counts, vocabulary, tokens, distinct = count(docs, text_col)
    with Scratch(docs.sparkSession) as scratch:
        encoded = encode(docs.withColumn("none", F.lit(None).cast("long")), vocabulary, "none", text_col, store=scratch.stored)
        model = fit(encoded, vocabulary, states=states, seed_rounds=SEED_ROUNDS if distinct else 0, rounds=rounds if distinct else 0)
    return counts, vocabulary, model, tokens, distinct


def _likelihoods(model: Model) -> Callable:
    """Task function: the model's part of every document's score in place of its classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, symbols, first in _sequences([batch], batch.num_columns - 1):
                own = pa.array(model.loglik(symbols, first) / np.log(10))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], own], names=[*rows.schema.names[:-1], "own"])

    return run


def score_encoded(encoded: DataFrame, counts: DataFrame, model: Model, tokens: int, distinct: int, id_col: str = "doc_id") -> DataFrame:
    """Scores of encoded documents, with the ``train`` flag."""
    known = encoded.select("row", "id", "train", "n_tokens", "n_known", "base", "part", "symbols").mapInArrow(_likelihoods(model), "row bigint, id bigint, train boolean, n_tokens bigint, n_known bigint, base double, part double, own double")
    rest = encoded.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    found = rest.join(counts.select("word", "n"), "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    return known.join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "train",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))).alias("base_score"),
        (F.col("part") + F.col("own") + more).alias("score"),
    )


def score(docs: DataFrame, fitted: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    Both scores are log10 probabilities of the whole text with its end: ``base_score`` by
    add-one word frequencies, ``score`` by the model. Null texts are empty: an end alone.
    Rows repeating an id are scored on their own; an empty table gives no rows; other columns
    are ignored.
    """
    counts, vocabulary, model, tokens, distinct = fitted
    return score_encoded(encode(docs, vocabulary, id_col, text_col), counts, model, tokens, distinct, id_col).drop("train")


def op6_hmm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    with Scratch(spark) as scratch:
        counts, vocabulary, tokens, distinct = count(docs.where(~held), store=scratch.stored)
        encoded = encode(docs, vocabulary, train=~held, store=scratch.stored)
        rounds = {"seed_rounds": SEED_ROUNDS, "rounds": ROUNDS} if distinct else {"seed_rounds": 0, "rounds": 0}
        model = fit(encoded.where("train"), vocabulary, **rounds)
        scored = score_encoded(encoded, counts, model, tokens, distinct).withColumn("held_out", ~F.col("train"))
        return scratch.result(scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), "scores")
