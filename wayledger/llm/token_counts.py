"""Token counts of a BPE tokenizer file by rank-synchronous merging of ragged arrays.

Texts are normalised and cut into pre-tokens as the file says. Pre-tokens that a worker
has not met are merged together: all of them lie end to end in one symbol array, and in
each step every sequence applies its own lowest-ranked pair. What survives is counted. Pre-tokens
of more than LONG bytes, which would take a round for each of their ranks, are merged alone.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Pre-tokens a worker remembers; it forgets all of them beyond this, so memory is bounded.
REMEMBERED = 1 << 19
NONE = np.iinfo(np.int64).max
#: Bytes of a pre-token up to which it is merged together with others, a rank a round.
LONG = 256

# Where the tokenizer library and this interpreter's tables differ. Lower case of
# letters that are newer than the tables, and unassigned characters that the tables take for
# letters.
NEWER_LOWER = (("\uA7CB", "\u0264"), ("\uA7DC", "\u019B"))
NO_LETTERS = "\U00032808\U0003285C\U00032988\U0003D808\U0003D85C\U0003D988\U0003E808\U0003E85C\U0003E988\U0003F808\U0003F85C\U0003F988"
HAS_NO_LETTER = regex.compile(f"[{NO_LETTERS}]")


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else from 256 on."""
    shown = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class Merger:
    """A tokenizer file's rules as arrays."""

    def __init__(self, spec: dict):
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        sym = byte_symbols()
        self.inner = np.array([vocab[sym[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[sym[b] + self.suffix] for b in range(256)], np.int64)
        self.rank_of = dict(zip(self.keys.tolist(), self.rank.tolist(), strict=True))
        # Which symbols of one byte a rule brings together: the last of its left part, the first
        # of its right part. With a word's end such a symbol is another one.
        units = {v: k for k, v in enumerate([*self.inner.tolist(), *self.last.tolist()])}
        self.number = np.zeros(max(vocab.values()) + 1, np.int64)
        self.number[list(units)] = list(units.values())
        self.joins = np.zeros((len(units), len(units)), bool)
        end = lambda x: units[vocab[x[-1 - len(self.suffix) :] if self.suffix and x.endswith(self.suffix) else x[-1]]]
        begin = lambda x: units[vocab[x if self.suffix and len(x) == 1 + len(self.suffix) and x.endswith(self.suffix) else x[0]]]
        for x, y in pairs:
            self.joins[end(x), begin(y)] = True
        splits = [p for p in spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]]) if p["type"] == "Split"]
        pattern = splits[0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.split_odd = regex.compile(pattern.replace(r"\p{L}", rf"[\p{{L}}--[{NO_LETTERS}]]"), regex.V1)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"] and not t["normalized"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, int] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def cuts(self, sym: np.ndarray) -> np.ndarray:
        """Whether a symbol can never be joined with the next one: no rule's left part ends in
        the one's character while its right part begins with the other's. What stands on
        either side of such a place is merged on its own."""
        return ~self.joins[self.number[sym[:-1]], self.number[sym[1:]]]

    def count(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token.

        Pre-tokens of up to LONG bytes are merged together, a rank a round. A longer one is cut
        where no rule joins, and what is still long is merged one pair at a time, by a heap of
        the pairs: the time grows with its length, not with the square of it.
        """
        size = [len(t.encode()) for t in tokens]
        out = np.zeros(len(tokens), np.int64)
        short = [i for i, n in enumerate(size) if n <= LONG]
        if short:
            out[short] = self._together([self._symbols(tokens[i]) for i in short])
        for i in (i for i, n in enumerate(size) if n > LONG):
            sym = self._symbols(tokens[i])
            parts = np.split(sym, np.flatnonzero(self.cuts(sym)) + 1)
            low = [p for p in parts if len(p) <= LONG]
            out[i] = (int(self._together(low).sum()) if low else 0) + sum(self._one(p) for p in parts if len(p) > LONG)
        return out

    def _symbols(self, token: str) -> np.ndarray:
        data = np.frombuffer(token.encode(), np.uint8)
        sym = self.inner[data]
        if len(sym):
            sym[-1] = self.last[data[-1]]
        return sym

    def _one(self, sym: np.ndarray) -> int:
        """Surviving symbols of one sequence: of the pairs that wait the one with the lowest rank,
        the leftmost of equals, is joined and makes two new pairs."""
        s, n = sym.tolist(), len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = np.append(self.ranks(sym[:-1], sym[1:]), NONE)
        heap = [(r, i) for i, r in enumerate(rank.tolist()) if r < NONE]
        heapq.heapify(heap)
        now, left = rank.tolist(), n
        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            j = after[i]
            s[i], after[i] = int(self.made[r]), after[j]
            now[j] = NONE
            left -= 1
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0:
                    now[k] = self.rank_of.get(s[k] << 32 | s[after[k]], NONE) if after[k] >= 0 else NONE
                    if now[k] < NONE:
                        heapq.heappush(heap, (now[k], k))
        return left

    def _together(self, symbols: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(x) for x in symbols], np.int64)
        sym = np.concatenate(symbols) if len(n) else np.zeros(0, np.int64)
        seq = np.repeat(np.arange(len(n)), n)
        out = n.copy()
        while len(sym) > 1:
            pair = np.where(seq[1:] == seq[:-1], self.ranks(sym[:-1], sym[1:]), NONE)
            pair = np.append(pair, NONE)
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(pair, first)
            live = best < NONE
            if not live.any():
                break
            # Finished sequences leave; the rest apply their own lowest rank everywhere.
            size = np.diff(np.append(first, len(seq)))
            keep = np.repeat(live, size)
            sym, seq, pair = sym[keep], seq[keep], pair[keep]
            lowest = np.repeat(best[live], size[live])
            hit = pair == lowest
            # Overlapping hits (a run of one symbol) are taken from the left, every other.
            run = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
            where = np.flatnonzero(hit)
            begin = run[np.searchsorted(run, where, side="right") - 1]
            where = where[(where - begin) % 2 == 0]
            sym[where] = self.made[lowest[where]]
            stay = np.ones(len(sym), bool)
            stay[where + 1] = False
            sym, seq = sym[stay], seq[stay]
            out[np.unique(seq)] = np.bincount(seq)[np.unique(seq)]
        return out

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens: NFC, white space runs to one space, lower case by character, split."""
        text = unicodedata.normalize("NFC", text)
        if text.isascii():
            return self.split.findall(text.lower())
        for upper, lower in NEWER_LOWER:
            text = text.replace(upper, lower)
        # str.lower() writes a word-final sigma differently; the file's rule is by character.
        text = text.replace("Σ", "σ").lower()
        return (self.split_odd if HAS_NO_LETTER.search(text) else self.split).findall(text)

    def __call__(self, texts: list[str]) -> list[int]:
        base, split = [], []
        for t in texts:
            parts = self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t]
            base.append(len(parts) - 1)
            split.append([p for part in parts for p in self.pieces(part)])
        new = list({p for pieces in split for p in pieces} - self.known.keys())
        if new:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                new = list({p for pieces in split for p in pieces})
            self.known.update(zip(new, self.count(new).tolist(), strict=True))
        known = self.known
        return [b + sum(map(known.__getitem__, pieces)) for b, pieces in zip(base, split, strict=True)]


@lru_cache(maxsize=2)
def _of_file(raw: bytes) -> Merger:
    return Merger(json.loads(raw))


def merger(path: str) -> Merger:
    return _of_file(Path(path).read_bytes())


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", *, limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``).

    A null text counts as empty. The special strings of the file are one token each where
    they stand in a text; no begin or end token is added. Every row is counted on its own, so
    repeated rows and ids make no difference; an empty table gives no rows; columns with the
    names of the new ones are replaced. The file is read once, by the driver, and its contents
    (which don't grow with the data) go with the tasks. Nothing is shuffled.
    """
    raw = Path(path).read_bytes()

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        rules = _of_file(raw)
        out: list[int] = []
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size > 1 << 20:
                out += rules(held)
                held, size = [], 0
        return pd.Series(out + rules(held), dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("n_tokens", tokens(text))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")
