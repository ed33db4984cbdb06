"""Byte-level BPE by prefix dynamic programming.

Each prefix of a byte string has exactly one token that can end its encoding:
a token that fits behind the encoding of the shorter prefix, which for BPE
means that the two neighbours, encoded together, stay as they are. Keeping
that last token for every prefix makes an append exact (nothing before it
changes) and lets an edit stop as soon as the table is in step again.

Spark deals out the texts; a task splits some hundred of them by the pattern,
fills the tables of all matches that it doesn't know yet side by side, and
remembers the encodings. Long matches get a table of their own.

A null text is an empty one; an empty text has no tokens. Texts of any length
are encoded whole. Repeated rows each have their row; an empty table gives
none. Only the id and the text column are read, so further columns of any name
don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import releasing

#: Encodings of matches that a worker remembers before it starts afresh.
REMEMBERED = 1 << 17
#: Matches of up to so many bytes are worked out side by side; texts taken together.
SHORT, TOGETHER = 64, 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Ranks of byte strings, and which tokens may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.known: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The definition of BPE: join the neighbours of least rank until none can be joined."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    @cached_property
    def halves(self) -> dict[int, tuple[int, int]]:
        """The two tokens that a token is joined from; a token of several bytes that no joining gives is missing."""
        return self._history[0]

    @cached_property
    def joined(self) -> dict[int, int]:
        """The token that two neighbours (left << 32 | right) become; only pairs that joining can bring about."""
        return self._history[1]

    @cached_property
    def _history(self) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
        halves: dict[int, tuple[int, int]] = {}
        joined: dict[int, int] = {}
        for rank in sorted(self.tokens):
            data = self.tokens[rank]
            for cut in range(len(data) - 1, 0, -1):
                left, right = self.ranks.get(data[:cut]), self.ranks.get(data[cut:])
                if left is None or right is None or (cut > 1 and left not in halves) or (len(data) - cut > 1 and right not in halves):
                    continue
                if self._apart(left, right, halves, joined):
                    halves[rank], joined[left << 32 | right] = (left, right), rank
                    break
        return halves, joined

    @staticmethod
    def _apart(left: int, right: int, halves: dict, joined: dict) -> bool:
        """Undo the two tokens' joins from the last to the first; they stay apart if at no time the tokens at their border would have joined sooner.

        Of equal ranks the join further left comes first.
        """
        before = 1 << 40
        while joined.get(left << 32 | right, 1 << 40) >= before:
            made_left, made_right = (left if left in halves else -1), (right if right in halves else -1)
            if made_left > made_right:
                before, left = made_left, halves[left][1]
            elif made_right >= 0:
                before, right = made_right + 1, halves[right][0]
            else:
                return True
        return False

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their bytes are encoded together."""
        known = self.known.get(left << 32 | right)
        if known is None:
            if len(self.known) >= 4 * REMEMBERED:
                self.known.clear()
            made = all(len(self.tokens[t]) == 1 or t in self.halves for t in (left, right))
            known = self.known[left << 32 | right] = made and self._apart(left, right, self.halves, self.joined)
        return known


class Prefixes:
    """The last token of every prefix of a byte string that can grow and be edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _last(self, end: int) -> int:
        """The token that ends the encoding of data[:end]; only one fits, so the order of trial is free."""
        vocabulary, data, last = self.vocabulary, self.data, self.last
        get, known, fits = vocabulary.ranks.get, vocabulary.known, vocabulary.fits
        # Most often the token before has grown by a byte.
        grown = end - 1 - len(vocabulary.tokens[last[end - 1]]) if end > 1 else 0
        for start in (grown, *range(max(0, end - vocabulary.longest), end)):
            token = get(data[start:end])
            if token is not None:
                if start == 0:
                    return token
                left = last[start]
                fit = known.get(left << 32 | token)
                if fit or fit is None and fits(left, token):
                    return token
        raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        """Exact: the last tokens of earlier prefixes stay as they are."""
        done = len(self.data)
        self.data += more
        for end in range(done + 1, len(self.data) + 1):
            self.last.append(self._last(end))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]; gives how many prefixes were worked out anew.

        Behind the change, as many equal last tokens in a row as the longest
        token has bytes settle all the rest.
        """
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        same, work = 0, 0
        for end in range(start + 1, len(self.data) + 1):
            if same >= self.vocabulary.longest:
                self.last += old[end - shift :]
                break
            self.last.append(self._last(end))
            work += 1
            same = same + 1 if end - shift > stop and self.last[end] == old[end - shift] else 0
        return work

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[self.last[end]])
        return out[::-1]


class Tables:
    """The prefix tables of many short byte strings at once, over the vocabulary as arrays.

    Tokens are numbered by rank. Nodes of a trie of the tokens are the prefixes
    in order; sorted arrays give a node's child by a byte, and the token that
    two neighbours become.
    """

    PAD = 256

    def __init__(self, vocabulary: Vocabulary):
        self.ids = sorted(vocabulary.tokens)
        number = {t: i for i, t in enumerate(self.ids)}
        made = [i for i in self.ids if len(vocabulary.tokens[i]) == 1 or i in vocabulary.halves]
        prefixes = sorted({vocabulary.tokens[i][:n] for i in made for n in range(1, len(vocabulary.tokens[i]) + 1)} | {b""})
        place = {p: i for i, p in enumerate(prefixes)}
        # A node's children, as sorted numbers of (node, byte); the root is the least prefix, 0.
        self.child = np.array([place[p[:-1]] << 9 | p[-1] for p in prefixes[1:]] + [1 << 60], dtype=np.int64)
        order = np.argsort(self.child, kind="stable")
        self.child, self.below = self.child[order], np.append(np.arange(1, len(prefixes)), 0)[order].astype(np.int32)
        self.inner = np.zeros(len(prefixes), dtype=bool)
        self.inner[self.child[:-1] >> 9] = True
        self.token = np.full(len(prefixes), -1, dtype=np.int32)
        for i in made:
            self.token[place[vocabulary.tokens[i]]] = number[i]
        first = self.child[self.child < 1 << 9]
        self.root = np.full(self.PAD + 1, -1, dtype=np.int32)
        self.root[first] = self.below[: len(first)]
        size = len(self.ids)
        self.size = np.array([len(vocabulary.tokens[i]) for i in self.ids], dtype=np.int32)
        self.born, self.head, self.tail = np.full(size, -1, dtype=np.int64), np.arange(size), np.arange(size)
        for i, (a, b) in vocabulary.halves.items():
            self.born[number[i]], self.head[number[i]], self.tail[number[i]] = number[i], number[a], number[b]
        pairs = sorted((number[k >> 32] * size + number[k & 0xFFFFFFFF], number[i]) for k, i in vocabulary.joined.items())
        self.pair, self.whole = (np.array([p[c] for p in pairs] + [1 << 60], dtype=np.int64) for c in (0, 1))
        self.seen, self.verdict = np.full(1 << 20, -1, dtype=np.int64), np.zeros(1 << 20, dtype=bool)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As ``Vocabulary._apart``, for arrays."""
        out, at, before = np.zeros(len(left), dtype=bool), np.arange(len(left)), np.full(len(left), 1 << 60)
        while len(at):
            key = left * len(self.ids) + right
            spot = np.searchsorted(self.pair, key)
            sooner = (self.pair[spot] == key) & (self.whole[spot] < before)
            a, b = self.born[left], self.born[right]
            whole = (a < 0) & (b < 0)
            out[at[whole & ~sooner]] = True
            go = ~(sooner | whole)
            at, left, right, a, b = at[go], left[go], right[go], a[go], b[go]
            before = np.where(a > b, a, b + 1)
            left, right = np.where(a > b, self.tail[left], left), np.where(a > b, right, self.head[right])
        return out

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * len(self.ids) + right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out = self.verdict[slot]
        new = np.flatnonzero(self.seen[slot] != key)
        if len(new):
            out[new] = self.verdict[slot[new]] = self._apart(left[new].astype(np.int64), right[new].astype(np.int64))
            self.seen[slot[new]] = key[new]
            # Two new keys in one slot: the last key and the last verdict are of one row, as both are written in order.
        return out

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) << 9 | byte
        spot = np.searchsorted(self.child, key)
        return np.where(self.child[spot] == key, self.below[spot], -1)

    def last(self, pieces: list[bytes]) -> np.ndarray:
        """A row a piece: the last token of every prefix, -1 beyond its end."""
        width = max(map(len, pieces))
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width).astype(np.int16)
        flat[np.arange(width) >= np.array([len(p) for p in pieces])[:, None]] = self.PAD
        last = np.full((len(pieces), width + 1), -1, dtype=np.int32)
        for start in range(width):
            rows = np.flatnonzero(flat[:, start] != self.PAD)
            node = self.root[flat[rows, start]]
            for end in range(start + 1, width + 1):
                if end > start + 1:
                    node = self._next(node, flat[rows, end - 1])
                some = node >= 0
                rows, node = rows[some], node[some]
                token = self.token[node]
                free = np.flatnonzero((token >= 0) & (last[rows, end] < 0))
                if start and len(free):
                    free = free[self.fits(last[rows[free], start], token[free])]
                last[rows[free], end] = token[free]
                deeper = self.inner[node]
                rows, node = rows[deeper], node[deeper]
                if not len(rows):
                    break
        return last

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Each piece's ids, read back from its table."""
        last, end, at = self.last(pieces), np.array([len(p) for p in pieces]), np.arange(len(pieces))
        if (last[at, end] < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            token = last[at, end]
            steps.append((at, token))
            end = end - self.size[token]
            at, end = at[end > 0], end[end > 0]
        row, token = np.concatenate([a for a, _ in steps[::-1]]), np.concatenate([t for _, t in steps[::-1]])
        order = np.argsort(row, kind="stable")
        ids = list(map(self.ids.__getitem__, token[order].tolist()))
        ends = np.cumsum(np.bincount(row, minlength=len(pieces))).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]


class Codec:
    """Encodes texts match by match of a split pattern, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary, self.matches = Vocabulary(ranks), regex.compile(pattern).findall
        self.names = {i: str(i) for i in self.vocabulary.tokens}
        self.known: dict[str, tuple[int, ...]] = {}

    @cached_property
    def tables(self) -> Tables:
        return Tables(self.vocabulary)

    def _learn(self, pieces: set[str]) -> None:
        """Work out the encodings of matches that aren't known yet."""
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = pieces
        short: list[list[tuple[str, bytes]]] = [[] for _ in range(4)]
        for piece in new:
            data = piece.encode("utf-8")
            whole = self.vocabulary.ranks.get(data)
            if whole is not None:
                self.known[piece] = (whole,)
            elif len(data) > SHORT:
                self.known[piece] = tuple(Prefixes(self.vocabulary, data).ids())
            else:
                short[(len(data) > 8) + (len(data) > 12) + (len(data) > 20)].append((piece, data))
        for some in short:
            for at in range(0, len(some), 1 << 15):
                part = some[at : at + (1 << 15)]
                self.known.update(zip((p for p, _ in part), self.tables.encode([d for _, d in part])))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; the matches that are new in any of them are worked out first, side by side."""
        matches = list(map(self.matches, texts))
        self._learn(set().union(*matches))
        for pieces in matches:
            yield list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


_codecs: dict[tuple, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One for each worker and vocabulary, so that what it remembers outlives a task."""
    key = (shared.value["digest"], pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value["ranks"], pattern)
    return _codecs[key]


def _share(spark, path: str):
    ranks = load_ranks(path)
    digest = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast({"ranks": ranks, "digest": digest})


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: each whole text's token ids, and the bytes that they decode to."""
    shared = _share(docs.sparkSession, path)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared, pattern)
        for b in batches:
            for at in range(0, len(b), TOGETHER):
                some = b.iloc[at : at + TOGETHER]
                ids = list(codec.encode_all([t or "" for t in some["text"]]))
                yield pd.DataFrame({"doc_id": some["doc_id"], "ids": ids, "decoded": [codec.decode(x) for x in ids]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(releasing(work), f"doc_id {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, without sending the ids anywhere."""
    shared = _share(docs.sparkSession, path)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared, pattern)
        name, sha = codec.names.__getitem__, hashlib.sha256
        for b in batches:
            texts, rows = [t or "" for t in b["text"]], []
            for at in range(0, len(b), TOGETHER):
                for ids in codec.encode_all(texts[at : at + TOGETHER]):
                    rows.append((len(ids), sha(" ".join(map(name, ids)).encode()).hexdigest(), sha(codec.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield out.assign(doc_id=b["doc_id"].to_numpy())

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(releasing(work), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerloom.llm.common import table

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
