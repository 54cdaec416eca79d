"""Every operator on awkward tables and against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wayledger.llm import bm25, gam, hmm_lm, jaccard_join, mixing, phrase_index, pii, rlbwt, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, n long"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven"
LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing names."""
    rows = [
        (1, BASE, "en", "a", 1), (2, BASE, None, "a", 1), (3, BASE + " tail", "en", None, None), (4, "", "en", "b", 0), (5, None, "en", "b", None), (6, "a" * 5000, "en", "c", 1),
        (7, "Mail joe@example.com or +1 (377) 555-0271, 10.0.0.1", "en", "c", 1), (8, LONG, "en", "a", 1), (8, LONG, "en", "a", 1), (9, "x", "en", "a", 1), (None, "some text of a row without id", "en", "a", 1), (10, "   ", "", "", 0),
    ]
    return spark.createDataFrame([(*r, 0.5, 1, 2) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_phrases(spark, odd, empty):
    bench = items(spark, [BASE, None, "", "x", "nothing of this occurs"])
    got = {(r["doc_id"], r["n_words"]): r for r in phrase_index.decontaminate(odd, bench).collect()}
    assert (got[1, 31]["n_hit"], got[3, 32]["n_hit"], got[9, 1]["n_hit"], got[4, 0]["contaminated"]) == (31, 31, 1, False)
    assert got[1, 31]["items_sha256"] == hashlib.sha256(b"0").hexdigest()
    assert phrase_index.decontaminate(odd, items(spark, [])).where("contaminated").count() == 0
    assert phrase_index.decontaminate(empty, bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x c"), (2, "a x y z b c")], "doc_id long, text string")
    index = phrase_index.build_index(docs)
    ask = items(spark, ["a b c"])
    assert {r["id"] for r in phrase_index.search(index, ask, slop=0).collect()} == set()
    assert {r["id"] for r in phrase_index.search(index, ask, slop=1).collect()} == {1}


def test_jaccard(spark, odd, empty):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.jaccard_components(odd).collect()}
    assert (got[1, 27], got[2, 27], got[3, 28], got[4, 0], got[10, 0]) == (1, 1, 1, 4, 10)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_in_chunks_is_exact(spark, monkeypatch):
    """Groups of near copies around the threshold, in chunks of four, against all pairs."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 4)
    rng = np.random.default_rng(5)
    texts = []
    for base in range(3):
        words = [f"w{base}x{i}" for i in range(60)]
        for _ in range(40):
            copy = list(words)
            for at in rng.choice(60, rng.integers(0, 4), replace=False):
                copy[at] = f"e{rng.integers(1 << 40)}"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    part = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = [low if x == high else x for x in part]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == dict(enumerate(part)) and len(set(part)) > 3


def test_repeats(spark, odd, empty):
    got = [r for r in rlbwt.remove_repeats(odd).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 12
    assert (by[1]["n_removed"], by[2]["n_removed"], by[3]["n_removed"], by[6]["n_removed"]) == (0, len(BASE), len(BASE), 4999)
    assert {r["n_removed"] for r in got if r["doc_id"] == 8} == {0}
    assert rlbwt.remove_repeats(empty).count() == 0


def test_crowded_anchor_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(1)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 40))
    line = "".join(word() for _ in range(4))
    texts = [f"{word()}{word()}{word()} {line} {word()}{word()}{word()}" for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = sorted(tuple(r) for r in rlbwt.remove_repeats(docs).collect())
    monkeypatch.setattr(rlbwt, "HOT", 3)
    assert sorted(tuple(r) for r in rlbwt.remove_repeats(docs).collect()) == plain
    assert min(r[2] for r in plain if r[0]) >= 162


def test_tokens(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [r["text"] or "" for r in odd.collect()] + ["ΑΣ <|endoftext|>İ don't 12½", "aaaa" * 900]
    rules = token_counts.merger(path)
    assert rules(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    got = token_counts.count_tokens(odd, path).where("doc_id = 8").first()
    assert got["over_limit"] and got["n_bytes"] == len(LONG)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_language_model(odd, empty):
    fitted = hmm_lm.train(odd, states=3, rounds=1)
    rows = hmm_lm.score(odd, fitted).collect()
    assert len(rows) == 12 and all(r["score"] < 0 and r["n_known"] == r["n_tokens"] for r in rows)
    assert hmm_lm.score(empty, fitted).count() == 0
    assert all(r["n_known"] == 0 for r in hmm_lm.score(odd, hmm_lm.train(empty, states=2)).collect())


def test_first_states_come_from_all_documents(spark):
    """A group of copies that any order by hash puts first leaves room for the other texts."""
    rng = np.random.default_rng(11)
    text = lambda kind: " ".join(f"{kind}{i}" for i in rng.integers(0, 12, 30))
    first = spark.range(20_000).select(F.format_string("many copies of one text %d", "id").alias("text")).orderBy(F.xxhash64("text")).first()["text"]
    docs = spark.createDataFrame([(first,)] * 1600 + [(text(kind),) for kind in "ab" for _ in range(100)], "text string")
    _, vocabulary, model, _, _ = hmm_lm.train(docs, states=4, rounds=0)
    best = []
    for kind in "ab":
        _, _, h, b, _ = next(hmm_lm._tokens(hmm_lm.pa.array([" ".join(f"{kind}{i}" for i in range(12))])))
        share = model.emit[vocabulary.lookup(h[:-1], b[:-1])[0]].sum(0)
        best.append(int(share.argmax()))
        assert share.max() > 0.5
    assert best[0] != best[1]


def test_forward_is_exact():
    rng = np.random.default_rng(3)
    m = hmm_lm.Model.of_counts(rng.random(2), rng.random((2, 2)), rng.random((3, 2)), np.full(3, 1 / 3))
    sequences = [np.array(s) for s in ([0, 1, 2, 1], [2], [1, 1])]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    for s, got in zip(sequences, m.loglik(np.concatenate(sequences), first), strict=True):
        total = 0.0
        for path in np.ndindex(*(2,) * len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
        assert np.isclose(np.log(total), got)


def test_mixing(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 12 and all(0 <= r["copies"] <= 2 for r in rows)
    assert mixing.mix(empty).count() == 0
    docs = spark.createDataFrame([(i, "w " * (i % 50 + 1), f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    per = mixing.mix(docs).groupBy(F.col("target").alias("t")).agg(F.sum(F.col("size") * F.col("copies")).alias("w")).collect()
    assert all(abs(r["w"] - r["t"]) <= 50 for r in per)


def test_warc(spark):
    rows = [(1, "http://a", "x" * 200), (2, None, "x" * 200), (3, "http://b\r\nX: y", "short"), (4, "", "short"), (5, "u", None), (None, "v", "x" * 200), (2, "w", "é" * 70)]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, file int")
    index = warc.write_warc(pages)
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(index).collect())
    assert got == [(-1, 200, "revisit", 1), (1, 200, "response", None), (2, 140, "response", None), (2, 200, "revisit", 1), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None)]
    assert warc.read_warc(index.where("page_id = 3")).first()["payload"] == b"short"
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_pii(odd, empty):
    got = {r["doc_id"]: r for r in pii.detect(odd).collect()}
    assert [got[7][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 0, 1]
    assert got[7]["spans"].startswith("email:5:20,phone:24:41")
    assert pii.detect(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redact(odd).collect()}
    assert clean[7] == "Mail <EMAIL> or <PHONE>, <IP>" and clean[5] is None


@pytest.mark.parametrize("text", ["a@b.c.d@e.f", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 1.2.3.999", "4111 1111 1111 1111-4111-1111-1111-1111", "+1 (5) 1234567890 +12", "@@a@b.co", "9" * 400 + ".1.1.1"])
def test_base_patterns(text):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda s: re.sub(r"\D", "", s)
    checks = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 10 <= len(digits(s)) <= 15]
    want = [(k, m.start(), m.end()) for k, (p, ok) in enumerate(zip(kinds, checks, strict=True)) for m in re.finditer(p, text) if ok(m[0])]
    assert sorted(pii.base_spans(text)) == sorted(want)


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (4, 0), (5, None), (None, 1)], "doc_id long, quality int")
    rows = gam.classify(odd, labels, ["doc_id", "source"]).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert gam.classify(empty, labels.limit(0), ["doc_id"]).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def test_bm25(spark, odd, empty):
    ask = items(spark, ["alpha beta omega", None, "zzz"])
    got = [(r["item_id"], r["rank"], r["doc_id"]) for r in bm25.search(odd, ask, k=2).orderBy("item_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert bm25.search(empty, ask).count() == 0
    assert bm25.search(odd, items(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [("MAX_QUERIES", 3), ("MAX_WORDS", 5)])
def test_bm25_in_blocks_is_exact(spark, odd, monkeypatch, limit):
    ask = items(spark, [*BASE.split(), BASE, None, "zzz", "Mail w7919 alpha"])
    plain = sorted(tuple(r) for r in bm25.search(odd, ask, k=2).collect())
    monkeypatch.setattr(bm25, *limit)
    assert sorted(tuple(r) for r in bm25.search(odd, ask, k=2).collect()) == plain
    assert len({r[0] for r in plain}) == len(BASE.split()) + 2


def test_bm25_shards_travel_one_at_a_time(spark, monkeypatch):
    docs = spark.range(2 * bm25.SHARD_DOCS + 5).coalesce(1).selectExpr("id AS doc_id", "concat('w', id % 100) AS text")
    held, plain = [], bm25._search_block

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    def seen(index, *rest):
        held.extend(r["n"] for r in index.mapInArrow(rows, "n long").collect())
        return plain(index, *rest)

    monkeypatch.setattr(bm25, "_search_block", seen)
    found = bm25.search(docs, items(spark, ["w7"]), k=3).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == [7, 107, 207] and held == [1, 1, 1]


def test_bm25_row_groups_hold_few_shards(spark):
    docs = spark.range(6).coalesce(1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 600000), i -> hex(i * 8 + id))) AS text")
    (file,) = bm25.build_index(docs).inputFiles()
    found = pq.ParquetFile(file.removeprefix("file:")).metadata
    groups = [found.row_group(i) for i in range(found.num_row_groups)]
    assert found.num_rows > 1 and all(g.num_rows == 1 or g.total_byte_size <= 32 << 20 for g in groups)


def test_bm25_postings_take_few_bytes():
    often = [np.full(300, 5, np.uint64), np.arange(40, dtype=np.uint64)]
    parts = often + [np.arange(i % 7, 200, dtype=np.uint64) for i in range(20_000)]
    sizes = [np.array([len(p)]) for p in parts]
    batch = bm25._shard(list(range(len(parts))), sizes, parts)
    row = {c: batch.column(c)[0].as_py() for c in batch.schema.names}
    vocab = np.arange(200, dtype=np.uint64)
    shard = bm25.Shard(row, vocab, np.ones(200), 200.0)
    *_, begin, end = shard.lists[5]
    want = [d for d, p in enumerate(parts) if 5 in p]
    assert shard.docs[begin[0] : end[-1]].tolist() == want and shard.tfs[begin[0] : end[-1]].tolist() == [300] + [1] * (len(want) - 1)
    assert sum(len(v) for v in row.values() if isinstance(v, bytes)) < 4 * len(shard.docs)


def test_bm25_of_documents_matches_brute_force(spark, tmp_path):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 30, rng.integers(1, 25))) for _ in range(70)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = [t.split() for t in texts]
    mean = sum(map(len, words)) / len(words)
    df = {w: sum(w in x for x in words) for x in words for w in x}
    want = set()
    for q in range(0, 70, 20):
        score = {d: sum(np.log(1 + (70 - df[t] + 0.5) / (df[t] + 0.5)) * 2.2 * x.count(t) / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in set(words[q])) for d, x in enumerate(words)}
        best = sorted((-round(s, 6), d) for d, s in score.items() if s > 0)[:10]
        want |= {(q, rank, d, -s) for rank, (s, d) in enumerate(best, 1)}
    got = {tuple(r) for r in bm25.op5_bm25_documents(spark, str(tmp_path)).collect()}
    assert {r[:3] for r in got} == {r[:3] for r in want} and np.allclose(sorted(r[3] for r in got), sorted(r[3] for r in want))
