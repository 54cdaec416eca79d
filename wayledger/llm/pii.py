"""Personal data by weak supervision.

Exact patterns give the base spans. Wider patterns propose more spans; regex, gazetteer and
context labelers vote on every candidate, expectation-maximisation estimates how reliable
each labeler is from the vote counts of the whole corpus, and a logistic span classifier is
trained on the resulting labels. Spans that it accepts are added; base spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored, table

#: The kinds that have exact patterns, then those that are only ever proposed.
KINDS = ("email", "ip", "card", "phone", "secret")
EXACT = 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is entered at its first digit only; it would fail the same way further in.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

# Wider patterns, which only propose.
WIDE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{2,63}){1,4}", re.I)
WIDE_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
WIDE_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
WIDE_SECRET = re.compile(r"(?:token|secret|password|passwd|api[ _-]?key|access[ _-]?key|private[ _-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.~-]{12,128}={0,2})", re.I)
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")

# Fixed word lists of the gazetteer and context labelers.
DOMAINS = ("com", "net", "org", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "biz", "co")
CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "pay", "credit", "karte", "carte", "tarjeta"),
    "phone": ("call", "phone", "tel", "fax", "mobile", "contact"),
    "secret": ("token", "secret", "password", "passwd", "key", "auth", "credential"),
}
COUNTER_CUES = ("version", "isbn", "order", "invoice", "serial", "sku", "build", "part no", "section", "example", "placeholder", "checksum", "commit", "sha1", "md5")

LABELERS = 6
#: Probability from which a proposed span is added.
ACCEPT = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact patterns: leftmost, not overlapping within a kind."""
    out: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def _wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Proposed spans clear of the base spans and of each other."""
    found = []
    if "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        found += [(0, m.start(), m.end()) for m in WIDE_EMAIL.finditer(text)]
    if DIGIT.search(text):
        if ":" in text:
            found += [(1, m.start(), m.end()) for m in WIDE_IP.finditer(text)]
        found += [(3, m.start(), m.end()) for m in WIDE_PHONE.finditer(text)]
    if "=" in text or ":" in text:
        found += [(4, m.start(1), m.end(1)) for m in WIDE_SECRET.finditer(text)]
    found.sort(key=lambda x: (x[1], x[0]))
    taken = sorted((s, e) for _, s, e in base)
    out, end, i = [], 0, 0
    for kind, s, e in found:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= end and (i == len(taken) or taken[i][0] >= e):
            out.append((kind, s, e))
            end = e
    return out


def _votes(text: str, kind: int, s: int, e: int, exact: bool) -> tuple[int, ...]:
    """One vote per labeler: 1 for, 2 against, 0 none."""
    span, before = text[s:e], text[max(0, s - 48) : s].lower()
    digits = NOT_DIGIT.sub("", span)
    edge = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
    if kind == 0:
        shape = 1 if re.search(r"[A-Za-z0-9]", span[:1]) else 2
        known = 1 if span.lower().rstrip(" )]").endswith(DOMAINS) else 0
    elif kind == 1:
        shape = 1
        known = 2 if span.startswith(("0.", "127.", "255.")) else 1
    elif kind == 2:
        shape = 2 if len(set(digits)) <= 2 else 1
        known = 1 if digits[0] in "3456" else 0
    elif kind == 3:
        shape = 2 if len(set(digits)) <= 2 else 1
        known = 2 if digits[:3] in ("000", "123") else 1
    else:
        shape = 1 if digits and len(set(span)) >= 8 and not span.isdigit() else 2
        known = 1 if len(span) in (32, 40, 64) and HEX.fullmatch(span) else 2 if span.isalpha() else 0
    cue = 1 if any(c in before for c in CUES[KINDS[kind]]) else 0
    counter = 2 if any(c in before for c in COUNTER_CUES) else 0
    return (1 if exact else 0, shape, known, cue, counter, 1 if edge else 2)


def _pattern(kind: int, votes: tuple[int, ...], length: int) -> int:
    code = kind
    for v in (*votes, min(length // 8, 3)):
        code = code * 4 + v
    return code


def _unpacked(code: int) -> tuple[int, tuple[int, ...], int]:
    parts = []
    for _ in range(LABELERS + 1):
        code, v = divmod(code, 4)
        parts.append(v)
    return code, tuple(reversed(parts[1:])), parts[0]


def candidates(text: str) -> list[tuple[int, int, int, int, bool]]:
    """(kind, start, end, pattern, is base) of every span that is voted on."""
    base = base_spans(text)
    both = [(*x, True) for x in base] + [(*x, False) for x in _wide_spans(text, base)]
    return [(k, s, e, _pattern(k, _votes(text, k, s, e, exact), e - s), exact) for k, s, e, exact in both]


SPAN = "array<struct<kind:int,s:int,e:int,pattern:int,base:boolean>>"


def find(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``spans``, all candidates of the whole text (null: none)."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("pattern", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "s", "e", "pattern", "base"), c, strict=True)) for c in candidates(t)] if (t := x.as_py()) else [] for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(spans, kind)], names=[*keep, "spans"])

    rows = docs.select(*keep, text_col)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}spans {SPAN}")


def reliabilities(kinds: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(posterior, accuracies): the chance that a candidate of each vote pattern is personal
    data, and each labeler's chance to be right where it votes.

    Expectation-maximisation of a model in which labelers are right independently of each
    other and where they don't vote tell nothing; a kind has a share of true candidates of
    its own. Labelers are taken to be better than chance, or for and against could change
    places.
    """
    right = np.full(votes.shape[1], 0.7)
    share = np.full(kinds.max(initial=0) + 1, 0.5)
    post = np.zeros(len(n))
    for _ in range(rounds):
        odds = np.log(right / (1 - right))
        score = np.log(share / (1 - share))[kinds] + ((votes == 1) * odds).sum(1) - ((votes == 2) * odds).sum(1)
        post = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        agree = np.where(votes == 1, post[:, None], np.where(votes == 2, 1 - post[:, None], 0.0))
        cast = (votes > 0) * n[:, None]
        right = np.clip(((agree * n[:, None]).sum(0) + 7) / (cast.sum(0) + 10), 0.55, 0.99)
        share = np.clip((np.bincount(kinds, weights=n * post, minlength=len(share)) + 1) / (np.bincount(kinds, weights=n, minlength=len(share)) + 2), 0.01, 0.99)
    return post, right


def span_classifier(kinds: np.ndarray, votes: np.ndarray, length: np.ndarray, n: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Probabilities of a logistic regression on kind, votes and length, fitted to the
    estimated labels weighted by how often each pattern occurs."""
    x = np.concatenate([np.eye(len(KINDS))[kinds], *(np.eye(3)[votes[:, j]] for j in range(1, votes.shape[1])), np.eye(4)[length]], axis=1)
    w, weight = np.zeros(x.shape[1]), n / max(n.sum(), 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - label)) + 1e-4 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def learn(found: DataFrame) -> list[int]:
    """The vote patterns whose spans are accepted. Counts cover every candidate; there are
    at most a few thousand patterns, whatever the corpus."""
    counts = found.select(F.explode("spans").alias("c")).groupBy("c.pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()
    if not len(counts):
        return []
    parts = [_unpacked(int(p)) for p in counts["pattern"]]
    kinds, votes, length = np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), np.array([p[2] for p in parts])
    n = counts["n"].to_numpy(float)
    label, _ = reliabilities(kinds, votes, n)
    sure = span_classifier(kinds, votes, length, n, label)
    return [int(p) for p, q in zip(counts["pattern"], sure, strict=True) if q >= ACCEPT]


def _text(spans: Column) -> Column:
    """kind:start:end of the spans by start, then kind."""
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"))))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", name(c["kind"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts and digest of the base spans, and all spans with the added ones, which
    may be of kinds without an exact pattern (secrets).

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows
    repeating an id are searched on their own. Without any candidate nothing is learnt.
    """
    found = stored(find(docs.select(id_col, text_col), [id_col], text_col), "spans")
    accepted = learn(found)
    base = F.filter("spans", lambda c: c["base"])
    every = F.filter("spans", lambda c: c["base"] | c["pattern"].isin(accepted)) if accepted else base
    count = lambda k: F.size(F.filter("spans", lambda c: c["base"] & (c["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(id_col, *map(count, range(EXACT)), F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"), _text(every).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every base and accepted span of the text replaced by its kind in angle
    brackets. Of overlapping spans the earliest wins, then the longest; what the others cover
    beyond it goes too. Null texts stay null. The texts are searched twice, once to learn from
    all candidates and once to replace, so that no text is shuffled or stored."""
    with Scratch(docs.sparkSession) as scratch:
        accepted = frozenset(learn(scratch.stored(find(docs.select(text_col), [], text_col), "spans")))

    def clean(text: str) -> str:
        out, at = [], 0
        for kind, s, e, pattern, exact in sorted(candidates(text), key=lambda c: (c[1], -c[2], c[0])):
            if (exact or pattern in accepted) and e > at:
                out += [text[at : max(s, at)], f"<{KINDS[kind].upper()}>" if s >= at else ""]
                at = e
        return "".join(out) + text[at:]

    names, where = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if (t := x.as_py()) is None else clean(t) for x in batch.column(where)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == where else c for i, c in enumerate(batch.columns)], names=names)

    return docs.mapInArrow(run, docs.schema)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
