"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece of text (a match of the split pattern) is encoded by halves: each half is encoded recursively, down to halves that
are tokens (single bytes always are), and two encoded neighbours are joined at their boundary. Joining re-encodes the two
tokens at the boundary and doubles that window until both its ends are stable. Stability is proved by pairs: a
token sequence is the encoding of its bytes exactly when every two neighbouring tokens, encoded alone, come out as the
same two tokens (until a first merge across some boundary, the merges on both sides of it run as they would for that
pair alone, so a merge that crosses it in the whole would cross it in the pair). Joining is therefore associative,
halves may be encoded in any order, and long pieces need no quadratic work. That a half which is a token encodes to
that token holds for every token that merges to itself; ``Encoder`` tests each token when it first matters. The pattern
fixes the boundaries of pieces, so up the rest of a document's tree neighbours are joined by concatenation. Decoding
concatenates token bytes up the same kind of tree.

Defined cases: a null or empty text encodes to no ids and decodes to no bytes. Special tokens are never made; their
strings are ordinary text. Repeated rows are encoded one by one; an empty table gives an empty result. Ids travel as
binary: little-endian unsigned 32-bit integers. An id that the vocabulary doesn't hold is an error.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows, once

#: Remembered pieces, halves and token pairs of a worker, each cleared when full. Longer halves than HALF bytes aren't kept.
MEMO, HALF = 250_000, 24


class Encoder:
    """Encodes pieces by the ranks of a vocabulary. ``joins`` counts the joins of halves."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.pairs: dict[int, list[int]] = {}
        self.halves: dict[bytes, list[int]] = {}
        self.joins = 0

    def merge(self, window: bytes) -> list[int]:
        """A window's encoding: pairs merge, lowest rank first and leftmost among equals."""
        ranks = self.ranks
        parts = [window[i : i + 1] for i in range(len(window))]
        none = 1 << 60
        pair = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            parts[i] += parts.pop(i + 1)
            pair.pop(i)
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def pair(self, a: int, b: int) -> list[int]:
        """The encoding of the joint bytes of two tokens."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.token[a] + self.token[b])
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokens a, b are the encoding of their joint bytes."""
        return self.pair(a, b) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours."""
        self.joins += 1
        if not left or not right:
            return left + right
        window, width = self.pair(left[-1], right[0]), 1
        if window == [left[-1], right[0]]:  # stable already, and so are the pairs beside it
            return left + right
        while True:
            l, r = max(0, len(left) - width), min(len(right), width)
            if (l == 0 or self.fits(left[l - 1], window[0])) and (r == len(right) or self.fits(window[-1], right[r])):
                return left[:l] + window + right[r:]
            width *= 2
            window = self.merge(b"".join(map(self.token.__getitem__, left[max(0, len(left) - width) :] + right[:width])))

    def half(self, part: bytes) -> list[int]:
        """The encoding of any bytes, joined from its halves."""
        known = self.halves.get(part)
        if known is not None:
            return known
        rank = self.ranks.get(part)
        if rank is not None and self.merge(part) == [rank]:
            known = [rank]
        else:
            middle = len(part) // 2
            known = self.join(self.half(part[:middle]), self.half(part[middle:]))
        if len(part) <= HALF:
            if len(self.halves) >= MEMO:
                self.halves.clear()
            self.halves[part] = known
        return known

    def piece(self, piece: bytes) -> list[int]:
        """A match of the pattern: one token if it is one, else its halves joined."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.half(piece) if piece else []


def concatenated(parts: list[bytes]) -> bytes:
    """Neighbours that need no re-encoding, joined up a tree of runs of 4096."""
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + 4096]) for i in range(0, len(parts), 4096)]
    return parts[0] if parts else b""


def read_ranks(path: str) -> bytes:
    """A rank file's content; it has a fixed size, known before the run."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def tool(content: bytes, pattern: str):
    """A function from a text to its ids, and the bytes of each id; both share one vocabulary."""
    encoder, memo = Encoder(parse_ranks(content)), {}
    split = regex.compile(pattern)

    def packed(piece: str) -> bytes:
        made = encoder.piece(piece.encode("utf-8", "surrogatepass"))
        out = struct.pack(f"<{len(made)}I", *made)
        if len(piece) <= 2 * HALF:
            if len(memo) >= MEMO:
                memo.clear()
            memo[piece] = out
        return out

    def ids(text: str | None) -> bytes:
        get = memo.get
        return concatenated([get(p) or packed(p) for p in split.findall(text)]) if text else b""

    return ids, encoder.token


def decoded(token: dict[int, bytes], ids: bytes | None) -> bytes:
    return concatenated([token[i] for i in np.frombuffer(ids or b"", dtype="<u4").tolist()])


def encode(df: DataFrame, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """Struct ``row`` (as given) and struct ``out`` with the binary column ``ids``."""
    content = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        ids, _ = once("bpe.encode", (ranks_path, pattern, len(content.value)), lambda: tool(content.value, pattern))
        return lambda a: [pa.array(map(ids, a["text"].to_pylist()), pa.binary())]

    return map_rows(df, {"text": text_col}, make, T.StructType([T.StructField("ids", T.BinaryType())]))


def decode(df: DataFrame, ids_col: str, ranks_path: str) -> DataFrame:
    """Struct ``row`` (as given) and struct ``out`` with the binary column ``decoded``."""
    content = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        token = once("bpe.decode", (ranks_path, len(content.value)), lambda: {i: b for b, i in parse_ranks(content.value).items()})
        return lambda a: [pa.array([decoded(token, ids) for ids in a["ids"].to_pylist()], pa.binary())]

    return map_rows(df, {"ids": ids_col}, make, T.StructType([T.StructField("decoded", T.BinaryType())]))


def encode_and_decode(df: DataFrame, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """``encode`` and ``decode`` of its ids, ``out`` with both columns, in one worker: each after the other takes two workers a task,
    and either may hold the tables of both."""
    content = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        ids, token = once("bpe.encode", (ranks_path, pattern, len(content.value)), lambda: tool(content.value, pattern))

        def call(a):
            made = [ids(t) for t in a["text"].to_pylist()]
            return [pa.array(made, pa.binary()), pa.array([decoded(token, i) for i in made], pa.binary())]

        return call

    return map_rows(df, {"text": text_col}, make, T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]))
