"""Ranked search, vector codes and byte-level BPE against plain versions."""

from __future__ import annotations

import base64
import math
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from wayledger.llm import byte_bpe, dual_tree, geometric

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _terms(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def _ranked(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    held = [(i, _terms(t)) for i, t in docs]
    n_docs, n_words = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    out = []
    for item, terms in sorted({(i, frozenset(_terms(t))) for i, t in items}, key=str):
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in w for _, w in held) + 1))) for t in terms}
        scores = []
        for doc, words in held:
            m = 50 + (50 * len(words) * n_docs) // max(n_words, 1)
            score = sum(weight[t] * ((10**9 * words.count(t)) // (1000 * words.count(t) + 20 * m)) for t in terms if t in words)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search_equals_scoring_everything(spark, monkeypatch, small):
    """Null and empty texts, a null id, ties, repeated ids and rows, long texts, passages; with
    small blocks, shards and query blocks every list has summaries and many blocks are skipped."""
    if small:
        for name, value in (("BLOCK", 3), ("SHORT", 2), ("LEAF", 2), ("SHARD_BYTES", 2000), ("MAX_QUERIES", 3), ("CELLS", 64)):
            monkeypatch.setattr(geometric, name, value)
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice((0, 1, 5, 30, 80))))) for i in range(400)]
    docs += [(i, "same Words w1 w2 w3") for i in range(500, 900)]
    docs += [(None, "w1 w2 w3"), (7, "w1 É w2"), (7, "w1 É w2"), (901, None), (902, ""), (903, " ".join(rng.choices(words, k=20_000)))]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)] + [(20, "SAME words"), (20, "SAME words"), (21, None), (22, "..."), (23, "É w1"), (24, "unknown")]
    left = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, query string, rank int").repartition(3)
    got = geometric.search(left, spark.createDataFrame(items, "item_id long, text string"), k=10)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(_ranked(docs, items, 10), key=str)


def test_ranked_search_of_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    ask = lambda df: df.withColumnRenamed("doc_id", "item_id")
    for docs, items in ((some, none), (none, some), (none, none)):
        assert geometric.search(docs, ask(items)).collect() == []


def test_blocks_are_skipped_and_bounds_hold():
    """On documents of separate subjects the search leaves most of them unscored."""
    rng = np.random.default_rng(5)
    n, vocab = 4000, 400
    subject = rng.integers(0, 20, n)
    ids = list(range(n))
    parts = [np.concatenate([20 * s + rng.integers(0, 20, 30), np.full(rng.integers(1, 4), 399)]).astype(np.uint64) for s in subject]
    forward = geometric._forward(ids, [np.array([len(p) for p in parts])], parts)
    words = np.arange(vocab, dtype=np.uint64)
    df = np.bincount(np.concatenate([np.unique(p) for p in parts]).astype(int), minlength=vocab)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df], np.int64)
    row = {c: forward.column(c)[0].as_py() for c in forward.schema.names}
    blocked = geometric._blocked(row, words, weight, n, sum(map(len, parts)))
    shard = geometric.Shard({c: blocked.column(c)[0].as_py() for c in blocked.schema.names}, vocab)
    best = geometric.Best(5)
    scored = shard.search(np.array([3, 4, 399]), weight, best)
    assert scored < n / 5
    full = geometric.Best(5)
    every = np.arange(n)
    shard.weights[[3, 4, 399]] = weight[[3, 4, 399]]
    shard._score(every[shard.count > 0], full)
    assert best.score.tolist() == full.score.tolist() and best.id.tolist() == full.id.tolist()


def _compressed(rows: list[tuple], entries: int, rounds: int, parts: int = 4) -> dict[int, tuple]:
    """By comparing every part with every entry, in Python integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}
    width = -(-max(1, *[len(v) for _, v, _ in kept]) // parts)
    cut = [[[math.floor(1024 * x) for x in (*v, *[0.0] * (parts * width))][p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    seeds = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p: [min((far(c[p], e), k) for k, e in enumerate(books[p])) for c in cut]
    for _ in range(rounds):
        for p in range(parts):
            own = [k for _, k in nearest(p)]
            for k in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own, strict=True) if o == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [nearest(p) for p in range(parts)]
    errors = [sum(f[r][0] for f in found) for r in range(len(kept))]
    return sorted((str(i), "".join(f"{f[r][1]:02x}" for f in found), errors[r], sum(e for e, (_, _, x) in zip(errors, kept, strict=True) if x == label)) for r, (i, _, label) in enumerate(kept))


@pytest.mark.parametrize("salted", [False, True])
def test_vector_codes_equal_plain_lloyd(spark, monkeypatch, salted):
    """Null, ragged, empty and non-finite vectors, null labels and ids, many equal vectors and ties."""
    monkeypatch.setattr(dual_tree, "LEAF", 4)
    monkeypatch.setattr(dual_tree, "BLOCK_ROWS", 100)
    if salted:
        monkeypatch.setattr(dual_tree, "sized", lambda df: df)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(10)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], i % 3) for i in range(300)]
    rows += [(1000 + i, [0.5] * 10, 1) for i in range(200)]
    rows += [(1, [0.25] * 10, None), (None, [0.125] * 10, None), (2000, [1.0, 2.0], 2), (2001, [], 2), (2002, None, 2), (2003, [0.0, None], 2), (2004, [float("nan")], 1), (2005, [float("inf")], 1), (2006, [-0.001] * 10, None)]
    df = spark.createDataFrame([(i, v, x, "z") for i, v, x in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in dual_tree.compress(df, entries=8, rounds=3).collect())
    assert got == _compressed(rows, 8, 3)


def test_vector_codes_of_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(5, [1.0, 2.0, 3.0, 4.0], 1), (3, [0.0, 0.0, 0.0, 1e30], 1)], schema)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in dual_tree.compress(few).collect()) == [(3, "00000000", 0), (5, "01010101", 0)]
    assert dual_tree.compress(spark.createDataFrame([], schema)).collect() == []


def test_tree_walk_prunes():
    """Apart from their borders, far groups are assigned as whole nodes."""
    rng = np.random.default_rng(1)
    x = np.concatenate([1000.0 * g + rng.integers(0, 50, (500, 4)) for g in range(8)])
    order = dual_tree.tree_order(x, 6)
    book = dual_tree.Codebook(np.array([[1000 * g + 25] * 4 for g in range(8)]))
    whole, leaf, _ = dual_tree.walk(dual_tree.Tree(x[order], 6), book.tree)
    assert len(whole) >= 8 and len(leaf) < 20


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Transducer(byte_bpe.vocabulary(open(RANKS, "rb").read()), public_tokenizers.PATTERN)


def _ids(coder, text: str) -> list[int]:
    return np.frombuffer(coder.encode(text), "<u4").tolist()


def test_encoding_equals_the_library(coder, library):
    rng = random.Random(2)
    kinds = ("ab", "abc \n", "aeiou nrst", "éà한국абв ", "0123456789 .,!", "🙂🙃日本語‍", "aA'sS tT'll", "\x00\t\r\n ")
    for _ in range(1500):
        text = "".join(rng.choices(rng.choice(kinds), k=rng.randint(0, 60)))
        assert _ids(coder, text) == library.encode_ordinary(text)


def test_long_pieces_take_time_in_proportion(coder, library):
    for text in ("a" * 100_000, "한" * 50_000, " " * 100_000, "ab" * 50_000):
        began = time.time()
        got = _ids(coder, text)
        assert time.time() - began < 5
        assert got == library.encode_ordinary(text)


def test_encoding_goes_on_when_states_are_forgotten(library, monkeypatch):
    for name in ("STATES", "PAIRS", "REMEMBERED"):
        monkeypatch.setattr(byte_bpe, name, 20)
    coder = byte_bpe.Transducer(byte_bpe.vocabulary(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    rng = random.Random(6)
    for text in ["".join(rng.choices("etaoin shrdlu", k=300)), "".join(rng.choices("etaoinshrdlu", k=500))]:
        assert _ids(coder, text) == library.encode_ordinary(text)


def test_any_ranks_give_what_the_merges_give():
    """Also ranks that no training gives: parts of a higher rank than the whole."""
    rng = random.Random(8)
    for _ in range(60):
        words = {"".join(rng.choices("abc", k=rng.randint(2, 5))).encode() for _ in range(12)}
        tokens = [bytes([b]) for b in range(256)] + sorted(words, key=lambda _: rng.random())
        coder = byte_bpe.Transducer(tokens, r"\w+")
        for _ in range(60):
            text = "".join(rng.choices("abc", k=rng.randint(1, 12)))
            plain = [coder.rank[text.encode()]] if text.encode() in coder.rank else [coder.rank[p] for p in coder.merged(text.encode())]
            assert _ids(coder, text) == plain


def test_streaming_decode_holds_back_open_characters(coder):
    vocab = byte_bpe.Vocabulary(coder.tokens)
    text = "naïve 日本語 🙂🙂 ok"
    ids = np.array([coder.rank[bytes([b])] for b in text.encode()], np.uint32)
    for step in (1, 2, 3, 7):
        pieces = list(byte_bpe.decode_stream(vocab, [ids[i : i + step] for i in range(0, len(ids), step)]))
        assert "".join(pieces) == text and not any("�" in p for p in pieces)
    for raw in (b"\xff", b"\xc3", b"a\xe2\x82", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xc0\xaf"):
        assert byte_bpe._decoded(vocab, np.array([coder.rank[bytes([b])] for b in raw], "<u4").tobytes()) == (raw, False)
    assert byte_bpe._decoded(vocab, np.array([10**6], "<u4").tobytes()) == (b"", False)
    assert byte_bpe._decoded(vocab, None) == (b"", True)


def test_encode_and_decode_as_columns(spark, library):
    texts = [None, "", "Hello  wörld 123", "x" * 70_000, "Hello  wörld 123"]
    docs = spark.createDataFrame([(i, t, "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    coded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    once = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded_col="decoded")
    for r in coded.collect() + once.collect():
        plain = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"]).decode(), r["valid"]) == (len(plain), plain, texts[r["doc_id"]] or "", True)
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
