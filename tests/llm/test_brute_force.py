"""Registered queries and operators against plain versions of their definitions."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from wayledger.llm import bm25, gam, hmm_lm, phrase_index, pii, rlbwt, warc
from wayledger.llm import queries as Q

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_op2_equals_brute_force(spark, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = {str(r["item_id"]): word.findall(lower(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    windows = collections.defaultdict(set)
    for item, w in items.items():
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    sizes = {len(w) for w in windows}
    want = {}
    for doc, text in docs:
        w = word.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        want[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in Q.QUERIES["op2_decontamination"](spark, SF).collect()}
    assert got == want and any(w[4] for w in want.values())


def removed(docs):
    """id -> (bytes, removed, spans, digest of the rest) by a table of all 100-byte strings."""
    texts, first = {i: (t or "").encode() for i, t in docs}, {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - 99):
            first.setdefault(texts[i][p : p + 100], (i, p))
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (i, p):
                gone[p : p + 100] = b"\x01" * 100
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out[i] = (len(b), sum(gone), sum(1 for j, x in enumerate(gone) if x and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


def by_id(rows):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}


def test_op4_equals_brute_force(spark, docs):
    want = removed(docs)
    assert by_id(Q.QUERIES["op4_repeats"](spark, SF).collect()) == want and any(w[1] for w in want.values())


@pytest.mark.parametrize("hot", [rlbwt.HOT, 3])
def test_repeats_of_a_repetitive_corpus(spark, monkeypatch, hot):
    """Short alphabets, shifted and overlapping repeats, edits; also with every group crowded."""
    monkeypatch.setattr(rlbwt, "HOT", hot)
    rng = np.random.default_rng(2)
    base = ["".join(chr(97 + c) for c in rng.integers(0, k, 700)) for k in (2, 26)]
    docs = []
    for i in range(60):
        t = list(base[i % 2][rng.integers(0, 80) : 700 - rng.integers(0, 300)])
        for _ in range(rng.integers(0, 4)):
            t[rng.integers(len(t))] = "Z"
        docs.append((i, "".join(t) * (1 + (i % 7 == 0))))
    docs += [(60, "ab" * 400), (61, "é" * 120), (62, None), (63, "x" * 99), (64, "x" * 100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = rlbwt.remove_repeats(frame, with_text=True).collect()
    assert by_id(got) == removed(docs)


def test_run_index_finds_the_earliest_occurrence():
    rng = np.random.default_rng(3)
    line = bytes(rng.integers(97, 101, 220).astype(np.uint8))
    pieces = [line[:168], line[30:198], bytes(rng.integers(97, 123, 168).astype(np.uint8)), line[52:220], line[:168]]
    index = rlbwt.RunIndex(pieces)
    place, cls = index.statistics()
    text = b"\x00".join(pieces) + b"\x00"
    code = rng.permutation(len(text)).astype(np.int64)
    least = index.earliest(code)
    strings = collections.defaultdict(list)
    for n, first in zip(index.size, index.first, strict=True):
        for p in range(first, first + n - 99):
            strings[text[p : p + 100]].append(p)
    want = {p: min(code[q] for q in ps) for ps in strings.values() if len(ps) > 1 for p in ps}
    assert dict(zip(place.tolist(), least[cls].tolist(), strict=True)) == want and want


def test_op6_base_columns_equal_brute_force(spark, docs):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    tokens = {i: [*word.findall(lower(t)), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in Q.QUERIES["op6_hmm"](spark, SF).collect()}
    assert got.keys() == tokens.keys()
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in count for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in ws), rel=1e-9)
    out = [i for i in tokens if held[i]]
    assert sum(got[i]["score"] for i in out) > sum(got[i]["base_score"] for i in out)


def test_long_texts_score_alike_by_segments(monkeypatch):
    rng = np.random.default_rng(4)
    m = hmm_lm.Model.of_counts(rng.random(5), rng.random((5, 5)), rng.random((30, 5)), np.full(30, 1 / 30))
    first = np.concatenate([[0], np.cumsum([1, 7, 64, 65, 129, 300, 0])])
    symbols = rng.integers(0, 30, first[-1])
    whole = m.loglik(symbols, first)
    monkeypatch.setattr(hmm_lm, "LONG", 64)
    assert m.loglik(symbols, first) == pytest.approx(whole, rel=1e-10)


def base_spans(text):
    """The four patterns as they are defined."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_op10_base_columns_equal_brute_force(spark, docs):
    odd = ["a.b@c.d@e.f", "1.2.3.4.5.6.7.8", "+1 23 4567 8901-", "4111 1111 1111 1111 4111-1111", "@x.y", "é@é.com joe@x-.a", "00256.1.1.1 0001.1.1.1", "++12345678901", "0" * 14 + " " + "0" * 20, "+1(2).3-4 5678901 2 3"]
    want = {-i - 1: base_spans(t) for i, t in enumerate(odd)} | {i: base_spans(t or "") for i, t in docs}
    frame = spark.createDataFrame([*[(-i - 1, t) for i, t in enumerate(odd)], *docs], "doc_id long, text string")
    for r in pii.detect(frame).collect():
        spans = want[r["doc_id"]]
        count = collections.Counter(s[0] for s in spans)
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [count[k] for k in pii.KINDS[:4]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(r["spans"].split(",")) | {""}


def test_added_spans_on_a_planted_set(spark):
    """Personal data in forms without an exact pattern, beside look-alikes: precision, recall."""
    rng = np.random.default_rng(6)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    key = lambda: hashlib.sha1(digits(12).encode()).hexdigest()
    rows, planted = [], []
    for i in range(400):
        kind, value, text = [
            ("secret", v := key(), f'set token = "{v}" before the run'), ("phone", v := f"({rng.integers(201, 990)}) {rng.integers(201, 999)}-{digits(4)}", f"call me at {v} or write"),
            ("email", v := f"joe{digits(3)} [at] mail.example [dot] com", f"contact {v} please"), (None, None, f"version 2.{rng.integers(0, 9)} of part {digits(5)}, section {digits(3)}"),
            (None, None, f"order {rng.integers(100, 999)} {rng.integers(100, 999)} {digits(3)} shipped; password = {'x' * 14}"), ("ip", v := f"{rng.integers(1, 250)}.{rng.integers(1, 250)}.7.9", f"host {v} answers"),
        ][i % 6]
        rows.append((i, text))
        if kind:
            planted.append((i, f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"))
    found = [(r["doc_id"], s) for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r["spans"].split(",") if s]
    right = set(found) & set(planted)
    assert len(right) / len(planted) >= 0.95 and len(right) / len(found) >= 0.95


def test_reliabilities_tell_good_labelers_from_bad():
    rng = np.random.default_rng(7)
    truth = rng.random(4000) < 0.6
    votes = np.stack([np.where(rng.random(4000) < p, np.where(truth == (rng.random(4000) < a), 1, 2), 0) for p, a in ((1, 0.95), (0.8, 0.9), (0.6, 0.85), (0.9, 0.5))], axis=1)
    post, right = pii.reliabilities(np.zeros(4000, int), votes, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.9
    assert right[0] > right[2] > 0.75 and right[3] < 0.65


def test_features_and_scores_equal_plain_loops():
    texts = ["Hello, world! 42% (ok)\n", "", "aaa aaa aaa bbb", "É# $x | y <b>", "word " * 500]
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    x = gam.features(data, off)
    name = gam.FEATURES.index
    for i, t in enumerate(texts):
        words, raw = re.findall(r"[^\x20\x09-\x0D]+", t), t.encode()
        share = lambda chars: sum(c in chars for c in raw) / max(len(raw), 1)  # noqa: B023, E731
        assert x[i, name("log_words")] == pytest.approx(np.log1p(len(words)))
        assert x[i, name("word_bytes")] == pytest.approx(sum(len(w.encode()) for w in words) / max(len(words), 1))
        assert x[i, name("distinct")] == pytest.approx(len({lower(w) for w in words}) / max(len(words), 1))
        assert x[i, name("upper")] == pytest.approx(share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        assert x[i, name("digit")] == pytest.approx(share(b"0123456789"))
        assert x[i, name("non_ascii")] == pytest.approx(share(bytes(range(128, 256))))
        pairs = [tuple(map(lower, words[j : j + 2])) for j in range(len(words) - 1)]
        known = len(set(pairs)) or int(bool(words))  # one word is its own only sequence
        assert x[i, name("repeated_bigrams")] == pytest.approx(1 - known / max(len(words) - 1, 1))
    rng = np.random.default_rng(8)
    rows = rng.random((600, 4))
    y = (rows[:, 0] + rows[:, 1] * rows[:, 2] > 0.8).astype(float)
    model = gam.fit(rows, y)
    at = lambda cuts, v: sum(v >= c for c in cuts)
    for r, s in zip(rows[:40], model.score(rows[:40]), strict=True):
        total = model.base + sum(tab[at(cut, v)] for cut, tab, v in zip(model.cuts, model.tables, r, strict=True))
        total += sum(tab[at(model.pair_cuts[i], r[i]), at(model.pair_cuts[j], r[j])] for i, j, tab in model.pairs)
        assert s == pytest.approx(1 / (1 + np.exp(-total)))


def test_op1_learns_what_the_labels_mark(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in Q.QUERIES["op1_quality"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    right = [(labels[r["doc_id"]], r["predicted"]) for r in rows]
    for quality in (0, 1):
        own = [p for y, p in right if y == quality]
        assert sum(p == quality for p in own) / len(own) > 0.9


def test_training_rows_are_bounded_and_not_held_out(spark, monkeypatch):
    monkeypatch.setattr(gam, "MAX_TRAIN", 400)
    labels = spark.range(30_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    got = [r["doc_id"] for r in gam.training_ids(labels, "doc_id", "quality").collect()]
    assert 200 < len(got) <= 400 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in got)


def test_pruning_is_exact_and_leaves_postings_unscored():
    rng = np.random.default_rng(9)
    ids, sizes, parts = list(range(3000)), [], []
    for i in ids:
        words = rng.zipf(1.4, rng.integers(20, 120)).astype(np.uint64) % np.uint64(5000)
        if i % 500 == 7:
            words[:6] = 4000 + i // 500
        sizes.append(np.array([len(words)]))
        parts.append(words)
    row = bm25._shard(ids, sizes, parts)
    row = {c: row.column(c)[0].as_py() for c in row.schema.names}
    query = np.unique(np.concatenate([np.arange(1, 12), np.arange(4000, 4006)])).astype(np.uint64)
    df = {int(t): sum(t in p for p in parts) for t in query}
    weight = np.array([np.log(1 + (3000 - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) for t in query])
    mean = float(np.concatenate(sizes).mean())
    best, scored, postings = bm25.Shard(row, query, weight, mean).top(query, 10)
    plain = [sum(w * bm25._gain(tf, len(p), mean) for t, w in zip(query, weight, strict=True) if (tf := int((p == t).sum()))) for p in parts]
    order = sorted(range(3000), key=lambda i: (-round(plain[i], bm25.DIGITS), i))[:10]
    assert sorted(best, key=lambda x: (-round(x[0], bm25.DIGITS), x[1]))[:10] == [(pytest.approx(plain[i]), i) for i in order]
    assert scored < 0.8 * postings


def test_proximity_stays_in_one_document(spark):
    index = phrase_index.build_index(spark.createDataFrame([(1, "a b x"), (2, "c d"), (3, "a x b c")], "doc_id long, text string"))
    ask = spark.createDataFrame([(0, "a b c")], "item_id long, text string")
    assert {r["id"] for r in phrase_index.search(index, ask, slop=1).collect()} == {3}


def test_archives_read_back_as_written(spark):
    html = "<p>é</p>" * 40
    rows = [(1, "http://a/1\n2", html), (2, None, html), (2, None, html), (3, "http://a/%0A", "short"), (None, "u", html), (4, "u", None), (5, "v", html + "x"), (5, "v", html + "x")]
    index = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"] and r["payload"].decode()) for r in warc.read_warc(index).collect()), key=repr)
    size = len(html.encode())
    want = [
        (1, "http://a/1\n2", "response", None, size, html), (2, None, "revisit", 1, size, None), (2, None, "revisit", 1, size, None), (3, "http://a/%0A", "response", None, 5, "short"),
        (None, "u", "revisit", 1, size, None), (4, "u", "response", None, 0, None), (5, "v", "response", None, size + 1, html + "x"), (5, "v", "response", None, size + 1, html + "x"),
    ]
    assert [(*g[:5], g[5] or None) for g in got] == sorted(want, key=repr)
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
