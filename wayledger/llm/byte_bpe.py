"""Byte-level BPE encoding and decoding with automata.

Encoding: a text is a BPE encoding exactly if each two neighbouring tokens alone encode to
themselves. That makes the merges a finite-state transducer: a state is the last whole token
and the bytes of the next one so far, and it may take a token only beside one it is
compatible with. It reads several such paths at once, determinised while it reads: a state of
the machine is the set of paths that are still possible, each with the tokens that it holds
back. What all paths share is emitted at once, so the lookahead is bounded by the longest
token, and a sequence of any length takes time in proportion to it.

Decoding: tokens are mapped to bytes, and an incremental UTF-8 machine, whose transitions are
tabulated by token, says after every block of ids where the last whole character ends.
"""

from __future__ import annotations

import base64
import gc
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: States, token pairs and encoded pieces a worker remembers. Beyond it forgets all states and
#: pairs, and of the pieces those that it hasn't met since the last time.
STATES, PAIRS, REMEMBERED = 1 << 18, 1 << 18, 1 << 17
#: Longer tokens of a path that are tried one by one; a path with more is kept.
LOOK = 8
#: Characters of a piece that is remembered, and ids that are decoded at a time.
SHORT, BLOCK = 64, 1 << 16
START, NONE, LOW = -1, 1 << 62, (1 << 32) - 1


def _contents(path: str) -> bytes:
    return Path(path).read_bytes()


def vocabulary(raw: bytes) -> list[bytes]:
    """The bytes of each id of a file of lines "base64 rank"."""
    pairs = [line.split() for line in raw.splitlines() if line.strip()]
    out = [b""] * (max((int(n) for _, n in pairs), default=-1) + 1)
    for word, n in pairs:
        out[int(n)] = base64.b64decode(word)
    return out


class Transducer:
    """The encoder of a vocabulary, determinised as texts come."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.rank = tokens, {t: i for i, t in enumerate(tokens) if t}
        self.split = regex.compile(pattern)
        # The trie of the tokens in byte order: node * 256 + byte -> node; the token that ends at a
        # node; and the run of tokens (by place in ``order``) that begin with a node's bytes.
        self.child: dict[int, int] = {}
        self.at, self.first, self.last = [-1], [0], [0]
        self.order = [self.rank[t] for t in sorted(self.rank)]
        for place, i in enumerate(self.order):
            node = 0
            for b in tokens[i]:
                step = self.child.get(node << 8 | b)
                if step is None:
                    step = self.child[node << 8 | b] = len(self.at)
                    self.at.append(-1)
                    self.first.append(place)
                    self.last.append(place)
                node = step
                self.last[node] = place
            self.at[node] = i
        self.pairs: dict[int, bool] = {}
        self.leads: dict[int, bool] = {}
        self.edges: dict = {}
        # Pieces with their ids: those met lately, and those met before them.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """Begin with the starting state alone. A state is a flat tuple of its paths, each as
        last token and node in one number, with the tokens that the path holds back."""
        self.names: dict[tuple, int] = {}
        self.paths: list[tuple] = []
        self.steps: dict[int, int | tuple[int, tuple]] = {}
        self.start = self._state((self._path(START, 0), ()))

    @staticmethod
    def _path(last: int, node: int) -> int:
        return (last + 1) << 32 | node

    def merged(self, raw: bytes, until: int = 1) -> list[bytes]:
        """The rule itself, for the few bytes of a token: merge the pair of the lowest rank,
        the leftmost of equals, until none is left or ``until`` parts are."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > until:
            ranks = [self.rank.get(a + b, NONE) for a, b in zip(parts[:-1], parts[1:], strict=True)]
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, word: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at a side of a token while it is put together, from its outermost byte
        on, each with the rank of the merge that takes it up. None if the token doesn't encode
        to itself, or if a part of it has a higher rank than the whole."""
        key = word if side else (word,)
        if key in self.edges:
            return self.edges[key]
        out: list | None = [(word, NONE)]
        if len(word) > 1:
            parts = self.merged(word, 2)
            rank, inner = self.rank[word], None
            if len(parts) == 2 and all(self.rank[p] < rank for p in parts) and self._edge(parts[1 - side], 1 - side) is not None:
                inner = self._edge(parts[side], side)
            out = None if inner is None else [*inner[:-1], (inner[-1][0], rank), (word, NONE)]
        self.edges[key] = out
        return out

    def _fits(self, before: int, token: int) -> bool:
        """The token may follow: both encode to themselves, alone and side by side."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
            self.edges.clear()
        good = self.pairs[self._path(before, token)] = self._side_by_side(before, token)
        return good

    def _goes_on(self, before: int, node: int) -> bool:
        """Whether any longer token that begins with the node's bytes may follow the token."""
        if before == START:
            return True
        own = self.at[node] >= 0
        if self.last[node] - self.first[node] > LOOK:  # surely one of so many
            return True
        if len(self.leads) > PAIRS:
            self.leads.clear()
        pairs, high, good = self.pairs, (before + 1) << 32, False
        for token in self.order[self.first[node] + own : self.last[node] + 1]:
            fits = pairs.get(high | token)
            if fits if fits is not None else self._fits(before, token):
                good = True
                break
        self.leads[high | node] = good
        return good

    def _side_by_side(self, before: int, token: int) -> bool:
        """Run the merges at the border of two tokens: does one cross it before the symbols that
        it would take are taken up on their own side? Of equal ranks the left one goes first."""
        right = self.tokens[token]
        if before == START:
            return self.merged(right) == [right]
        left = self.tokens[before]
        a, b = self._edge(left, 1), self._edge(right, 0)
        if a is None or b is None:
            return self.merged(left + right) == [left, right]
        i = j = 0
        while True:
            (x, takes_x), (y, takes_y) = a[i], b[j]
            cross = self.rank.get(x + y, NONE)
            if cross < takes_x and cross <= takes_y and cross != NONE:
                return False
            if takes_x == NONE and takes_y == NONE:
                return True
            if takes_x <= takes_y:
                i += 1
            else:
                j += 1

    def _state(self, paths: tuple) -> int:
        state = self.names.get(paths)
        if state is None:
            state = self.names[paths] = len(self.paths)
            self.paths.append(paths)
        return state

    def _end(self, state: int) -> tuple:
        """What is left to emit where a piece ends: the tokens of the path without open bytes. A
        piece that is a token as a whole is that token, whatever the merges give."""
        paths = self.paths[state]
        first = paths[0]
        if first >> 32 == START + 1 and first and self.at[first] >= 0:
            return (self.at[first],)
        return paths[-1] if not paths[-2] & LOW else ()

    def _step(self, state: int, byte: int) -> int | tuple[int, tuple]:
        """A transition that has not been met: the next state, with tokens if it emits any. Paths
        stay in the order of their open bytes, the longest first; the one without comes last."""
        reached, whole = [], None
        child, at, pairs, leads = self.child, self.at, self.pairs, self.leads
        paths = iter(self.paths[state])
        for path, held in zip(paths, paths, strict=True):
            node = path & LOW
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            high = path - node
            goes_on = leads.get(high | to)
            if goes_on if goes_on is not None else self._goes_on((high >> 32) - 1, to):
                reached += high | to, held
            token = at[to]
            if token >= 0 and whole is None:
                fits = pairs.get(high | token)
                if fits if fits is not None else self._fits((high >> 32) - 1, token):
                    whole = (token + 1) << 32, (*held, token)
        if whole is not None:
            reached += whole
        one, shared = reached[1], len(reached[1])
        for held in reached[3::2]:
            if not shared:
                break
            n = 0
            while n < shared and n < len(held) and held[n] == one[n]:
                n += 1
            shared = n
        if not shared:
            return self._state(tuple(reached))
        reached[1::2] = [held[shared:] for held in reached[1::2]]
        return self._state(tuple(reached)), one[:shared]

    def encode_piece(self, raw: bytes) -> list[int]:
        if len(self.paths) > STATES:
            self._forget()
        state, out, steps = self.start, [], self.steps
        for byte in raw:
            known = steps.get(state << 8 | byte)
            if known is None:
                if len(self.paths) > 2 * STATES:  # within one long piece
                    open_paths = self.paths[state]
                    self._forget()
                    state, steps = self._state(open_paths), self.steps
                known = steps[state << 8 | byte] = self._step(state, byte)
            if known.__class__ is int:
                state = known
            else:
                state, emitted = known
                out += emitted
        return out + list(self._end(state))

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, pieces = self.known, self.split.findall(text)
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > REMEMBERED:
                self.known, self.older = {}, known
                known = self.known
            older = self.older
            for i, piece in enumerate(pieces):
                if out[i] is None:
                    ids = known.get(piece) or older.get(piece)
                    if ids is None:
                        ids = self._bytes(self.encode_piece(piece.encode()))
                    if len(piece) <= SHORT:
                        known[piece] = ids
                    out[i] = ids
        return b"".join(out)


@contextmanager
def _uncollected() -> Iterator[None]:
    """States and pieces hold no cycles, so looking through all of them for some is left out."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def utf8_steps() -> np.ndarray:
    """next state by state and byte: 0 between characters, 1 to 3 that many bytes to come, 4 to 7
    after a first byte that narrows the second (E0, ED, F0, F4), 8 ill-formed."""
    step = np.full((9, 256), 8, np.uint8)
    step[0, :0x80] = 0
    for first, last, state in ((0xC2, 0xDF, 1), (0xE1, 0xEF, 2), (0xF1, 0xF3, 3), (0xE0, 0xE0, 4), (0xED, 0xED, 5), (0xF0, 0xF0, 6), (0xF4, 0xF4, 7)):
        step[0, first : last + 1] = state
    for state, first, last, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        step[state, first : last + 1] = to
    return step


class Vocabulary:
    """Token bytes, and what each token does to the UTF-8 machine from each of its states."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        step, size = utf8_steps(), np.array([len(t) for t in tokens], np.int64)
        data, first = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size
        self.after = np.repeat(np.arange(9, dtype=np.uint8)[None], len(tokens), 0)
        for j in range(int(size.max(initial=0))):
            long = np.flatnonzero(size > j)
            self.after[long] = step[self.after[long], data[first[long] + j][:, None]]


class Decoder:
    """Decodes ids block by block; text comes out up to the last whole character.

    ``valid`` turns false at the first ill-formed sequence or unknown id. Ill-formed bytes
    become U+FFFD in the text and stay as they are in the bytes; unknown ids have no bytes.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.state, self.held, self.valid = vocab, 0, b"", True

    def _advance(self, ids: np.ndarray) -> None:
        after, state = self.vocab.after, self.state
        odd = np.flatnonzero(after[ids, 0] != 0)
        i, n = 0, len(ids)
        while i < n:
            if state == 0:  # on to the next token that leaves the state between characters
                j = int(np.searchsorted(odd, i))
                if j == len(odd):
                    break
                i = int(odd[j])
            state = int(after[ids[i], state])
            if state == 8:
                self.valid = False
                break
            i += 1
        self.state = state

    def push(self, ids: np.ndarray) -> tuple[bytes, str]:
        """The bytes of these ids, and the characters that they complete."""
        known = ids < len(self.vocab.tokens)
        if not known.all():
            self.valid, ids = False, ids[known]
        raw = b"".join(map(self.vocab.tokens.__getitem__, ids.tolist()))
        if self.valid:
            self._advance(ids)
        data = self.held + raw
        whole = len(data)
        if self.valid and self.state:  # back to the first byte of the open character
            whole -= 1
            while data[whole] & 0xC0 == 0x80:
                whole -= 1
        self.held = data[whole:]
        return raw, data[:whole].decode("utf-8", "replace")

    def finish(self) -> str:
        """What is left of a character that never ended."""
        left, self.valid = self.held, self.valid and self.state == 0
        self.held = b""
        return left.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _transducer(raw: bytes, pattern: str) -> Transducer:
    return Transducer(vocabulary(raw), pattern)


@lru_cache(maxsize=2)
def _vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(vocabulary(raw))


def _decoded(vocab: Vocabulary, ids: bytes | None) -> tuple[bytes, bool]:
    """(bytes, whether they are well-formed) of one row, block by block."""
    decoder, out = Decoder(vocab), []
    numbers = np.frombuffer((ids or b"")[: len(ids or b"") // 4 * 4], "<u4")
    for lo in range(0, len(numbers), BLOCK):
        out.append(decoder.push(numbers[lo : lo + BLOCK])[0])
    decoder.finish()
    return b"".join(out), decoder.valid


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of every whole text, little-endian unsigned 32-bit integers end to
    end, and their number ``n_tokens``. With ``decoded_col`` the ids are decoded again in the
    same pass, into that column and ``valid``, as ``decode`` has them.

    ``path`` is a file of ranks, ``pattern`` cuts a text into pieces that are encoded on their
    own. A null text is empty and has no ids. Rows are encoded one by one, so repeated rows
    and ids make no difference; an empty table gives no rows; columns with the names of the
    new ones are replaced. The driver reads the file once; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    raw = _contents(path)
    back = decoded_col is not None

    @F.pandas_udf("struct<ids: binary, data: binary, valid: boolean>")
    def coded(texts: pd.Series) -> pd.DataFrame:
        with _uncollected():
            coder = _transducer(raw, pattern)
            ids = [coder.encode(t) if t else b"" for t in texts]
            data = [_decoded(_vocabulary(raw), x) for x in ids] if back else [(None, None)] * len(ids)
        return pd.DataFrame({"ids": ids, "data": [x for x, _ in data], "valid": [v for _, v in data]}, dtype=object)

    # Not to be computed again for each use of the column.
    out = docs.withColumn("_coded", coded.asNondeterministic()(F.col(text_col))).withColumn(ids_col, F.col("_coded.ids"))
    out = out.withColumn("n_tokens", (F.octet_length(ids_col) / 4).cast("long"))
    if back:
        out = out.withColumn(decoded_col, F.col("_coded.data")).withColumn("valid", F.col("_coded.valid"))
    return out.drop("_coded")


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of their ids, and ``valid``: whether they are UTF-8 and all ids known.

    Null and empty ids give no bytes. Unknown ids give no bytes and make a row invalid.
    """
    raw = _contents(path)

    @F.pandas_udf("struct<data: binary, valid: boolean>")
    def text(ids: pd.Series) -> pd.DataFrame:
        vocab = _vocabulary(raw)
        return pd.DataFrame([_decoded(vocab, x) for x in ids], columns=["data", "valid"])

    return rows.withColumn("_decoded", text(F.col(ids_col))).withColumn(out_col, F.col("_decoded.data")).withColumn("valid", F.col("_decoded.valid")).drop("_decoded")


def decode_stream(vocab: Vocabulary, blocks: Iterator[np.ndarray]) -> Iterator[str]:
    """The text of blocks of ids, each as far as it has come."""
    decoder = Decoder(vocab)
    for ids in blocks:
        yield decoder.push(ids)[1]
    yield decoder.finish()


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded_col="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
