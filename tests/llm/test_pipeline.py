"""The pipeline's stages on a planted table, each against a plain version of its definition."""

import re

import numpy as np
import pytest

import corpus_pipeline as P
from wayledger.llm import gam, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, copies int"
rng = np.random.default_rng(11)
VOCABULARY = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(900)]


def prose(n=60):
    words = list(rng.choice(VOCABULARY, n))
    return " ".join(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w for i, w in enumerate(words))


def junk(n=60):
    return " ".join("".join(rng.choice(list("#$%&*|!<>=+0123456789"), rng.integers(2, 8))) for _ in range(n))


PASSAGE = " ".join(rng.choice(VOCABULARY, 14))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(rows, folder): good and bad texts, exact and near copies, benchmark passages, personal
    data, nulls, empty and long texts, repeated ids and rows."""
    rows = [(i, prose() if i % 4 else junk(), "en", f"s{i % 3}", 1) for i in range(240)]
    good = [r for r in rows if r[0] % 4]
    rows += [(1000 + i, r[1], "en", "s0", 1) for i, r in enumerate(good[:10])]
    rows += [(2000 + i, r[1] + " tail", "en", "s1", 1) for i, r in enumerate(good[10:20])]
    rows += [(3000 + i, f"{prose(20)} {PASSAGE.upper()} {prose(20)}", "en", "s1", 1) for i in range(5)]
    rows += [(4000 + i, f"{prose(25)} joe{i}@example.com {prose(25)}", "en", "s2", 1) for i in range(5)]
    rows += [(5000, prose(30_000), "en", "s0", 1), (5001, None, "en", "s0", 1), (5002, "", None, None, None), (5003, "", "en", "s0", 0), (None, prose(), "en", "s0", 1)]
    rows += [(5004, good[30][1], "en", "s2", 1), (5005, x := prose(), "en", "s2", 1), (5005, x, "en", "s2", 1), (5006, prose(), "en", "s2", 1), (5006, f"{prose(30)} {PASSAGE} end", "en", "s2", 1)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, 0.1, 7, 9) for r in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(r[0] % 4 != 0)) for r in rows if r[0] is not None and r[0] < 240]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, str(folder)


def run(spark, stage, rows, folder):
    docs = spark.createDataFrame([(*r, 0.1, 7, 9) for r in rows], DOCS)
    out = stage(spark, docs, folder)
    return out.columns, [tuple(r) for r in out.collect()]


def order(rows):
    return sorted(rows, key=repr)


@pytest.fixture(autouse=True)
def small_leaves(monkeypatch):
    monkeypatch.setattr(gam, "LEAST_ROWS", 5)


def test_quality_keeps_the_good(spark, corpus):
    rows, folder = corpus
    columns, got = run(spark, P.quality, rows, folder)
    labelled = [r for r in rows if r[0] is not None and r[0] < 240]
    assert columns == P.COLUMNS
    assert {r[0] for r in got if r[0] is not None and r[0] < 240} == {r[0] for r in labelled if r[0] % 4}
    assert sum(r[0] == 5005 for r in got) == 2 and {r[0] for r in got} >= {*range(1000, 1010), *range(3000, 3005), None}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def test_near_duplicates_keep_the_first_of_each_group(spark, corpus):
    rows, folder = corpus
    columns, got = run(spark, P.near_duplicates, rows, folder)
    distinct = list(dict.fromkeys(rows))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (words(r[1]) for r in distinct)]
    part = list(range(len(distinct)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * max(len(sets[a] | sets[b]), 1):
                x, y = part[a], part[b]
                part = [min(x, y) if p in (x, y) else p for p in part]
    best = {}
    for p, r in zip(part, distinct, strict=True):
        best[p] = min(best.get(p, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    assert columns == P.COLUMNS and order(got) == order(best.values())
    assert len(got) == len(distinct) - 21


def test_decontamination_drops_rows_not_ids(spark, corpus):
    rows, folder = corpus
    columns, got = run(spark, P.decontamination, rows, folder)
    want = [r for r in dict.fromkeys(rows) if PASSAGE not in " ".join(words(r[1]))]
    assert columns == P.COLUMNS and order(got) == order(want) and sum(r[0] == 5006 for r in got) == 1


def test_personal_data_is_replaced_in_place(spark, corpus):
    rows, folder = corpus
    columns, got = run(spark, P.personal_data, rows, folder)
    want = [(r[0], t := None if r[1] is None else re.sub(r"joe\d@example\.com", "<EMAIL>", r[1]), *r[2:4], None if t is None else len(t)) for r in rows]
    assert columns == P.COLUMNS and order(got) == order(want)
    assert not any(pii.base_spans(r[1] or "") for r in got)


def test_mixing_comes_near_its_targets(spark, corpus):
    rows, folder = corpus
    columns, got = run(spark, P.mixing, rows, folder)
    assert columns[:-1] == P.COLUMNS
    size = lambda r: len(words(r[1]))
    total = sum(map(size, rows))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    own = {s: sum(size(r) for r in rows if r[3] == s) for s in sources}
    target, open_, left = {}, dict(zip(sources, (5, 2, 1, 5), strict=True)), 1.5 * total
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if level * w >= 2 * own[s]]
        for s in full or list(open_):
            target[s] = 2 * own[s] if full else level * open_[s]
        left -= sum(2 * own[s] for s in full)
        open_ = {s: w for s, w in open_.items() if full and s not in full}
    for s in sources:
        taken = sum(size(r) for r in got if r[3] == s)
        assert abs(taken - target[s]) <= max(size(r) for r in rows if r[3] == s)
    copies = {}
    for r in got:
        copies.setdefault(r[:-1], []).append(r[-1])
    times = {r: rows.count(r) for r in copies}
    assert all(len(c) <= 2 * times[r] for r, c in copies.items()) and copies.keys() <= set(rows)
    assert order(run(spark, P.mixing, rows, folder)[1]) == order(got)


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES])
def test_empty_table_passes_through(spark, corpus, stage):
    assert run(spark, stage, [], corpus[1])[1] == []


def test_run_equals_its_stages_one_by_one(spark, corpus):
    rows, folder = corpus
    out = P.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
    assert order(tuple(r) for r in out.collect()) == order(tuple(r) for r in docs.collect())
    ids = {r["doc_id"] for r in out.collect()}
    assert not ids & {*range(1000, 1010), *range(2000, 2010), *range(3000, 3005)}
