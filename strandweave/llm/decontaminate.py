"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of ``WINDOW`` consecutive words of a benchmark item, or a whole item that has fewer. Patterns
of one length form a searcher: a table of shifts, indexed by a hash of the block of two words at the window's end, says
how far the search may jump, so positions that no pattern can cover are never looked at. Where the shift is zero, the
block's hash picks a bucket of patterns with that suffix, a hash of the whole window those worth comparing, and comparing all
words confirms an occurrence. One-word patterns use blocks of one word.

Words are maximal runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. The
benchmark's words are numbered, and patterns are places in one array of numbers, so the tables stay small: 6 MB of
item text in 10-word windows take some 180 MB, built once in a worker process and kept for its later tasks.

Defined cases: a null or empty text has no words and no hits; a null or empty item, or one without words,
has no windows; items with a null id are left out, or, with ``nameless``, their windows are hits that name no item;
repeated items count once by id; a window that several items share belongs to all of them; an empty benchmark hits
nothing. The benchmark goes to the workers in blocks of at most ``BLOCK_BYTES`` of item text (or one item), and each block
makes one pass over the documents without a shuffle, so memory is bounded however large the benchmark is.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, once

WINDOW = 10
#: Bytes of item text whose patterns one pass over the documents holds in each task.
BLOCK_BYTES = 6_000_000

OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def word_table() -> bytes:
    """Bytes of words stay (A-Z in lower case), all others become blanks."""
    keep = lambda b: b >= 0x80 or chr(b).isalnum()
    return bytes(ord(chr(b).lower()) if keep(b) and b < 0x80 else b if keep(b) else 0x20 for b in range(256))


def words_of(text: str | None, table: bytes) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(table).split() if text else []


#: Odd multipliers of the block hash and of the window hash.
FIRST, SECOND, STEP = 0x9E3779B1, 0x85EBCA77, 0x100000001B3
LOW = (1 << 64) - 1


class Searcher:
    """Wu-Manber search for patterns of one length (in words): ``starts`` in the array ``flat`` of word numbers (from 1;
    0 is a word that no item has), each of the item in ``owner``."""

    def __init__(self, length: int, flat: np.ndarray, starts: np.ndarray, owner: np.ndarray):
        self.m, self.flat, self.block = length, flat, min(2, length)
        self.default = length - self.block + 1
        ends = np.arange(self.block, length + 1)
        self.bits = max(10, int(starts.size * 8 - 1).bit_length()) if starts.size < 1 << 21 else 24
        shift = np.full(1 << self.bits, min(255, self.default), np.uint8)
        for j in ends:
            at = self.key(flat[starts + j - 2] if self.block == 2 else 0, flat[starts + j - 1])
            np.minimum.at(shift, at, np.uint8(min(255, length - j)))
        self.shift = shift.tobytes()
        window = np.zeros(len(starts), np.uint64)
        for j in range(length):
            window = window * np.uint64(STEP) + flat[starts + j].astype(np.uint64)
        order = np.lexsort((owner, window, at))
        self.starts, self.owner, self.window, at = starts[order].astype(np.int32), owner[order].astype(np.int32), window[order], at[order]
        used, first = np.unique(at, return_index=True)
        self.used, self.first = used, np.r_[first, len(at)]

    def key(self, a, b):
        """The place of a block in the table of shifts."""
        return ((a * FIRST + b * SECOND) >> 9) & ((1 << self.bits) - 1)

    def bucket(self, at: int, own: list[int]):
        """The items that have the window ``own``, whose block hashes to ``at``."""
        k = int(np.searchsorted(self.used, at))
        if k == len(self.used) or self.used[k] != at:
            return []
        h = 0
        for w in own:
            h = (h * STEP + w) & LOW
        low, high = int(self.first[k]), int(self.first[k + 1])
        part = self.window[low:high]
        i, j = (int(np.searchsorted(part, np.uint64(h), side)) for side in ("left", "right"))
        found = []
        for p in range(low + i, low + j):
            s = int(self.starts[p])
            if self.flat[s : s + self.m].tolist() == own:
                found.append(int(self.owner[p]))
        return found

    def search(self, words: list[bytes], number: dict[bytes, int]):
        """Yield (start, owners) of every occurrence."""
        n, m, get, shift, two, mask = len(words), self.m, number.get, self.shift, self.block == 2, (1 << self.bits) - 1
        at = m - 1
        while at < n:
            b = get(words[at], 0)
            key = (((get(words[at - 1], 0) * FIRST if two else 0) + b * SECOND) >> 9) & mask
            jump = shift[key]
            if not jump and b:
                own = [get(w, 0) for w in words[at - m + 1 : at + 1]]
                if all(own) and (found := self.bucket(key, own)):
                    yield at - m + 1, found
            at += jump or 1


class Patterns:
    """The searchers of one block of items, one for each length of pattern."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.table = word_table()
        self.number: dict[bytes, int] = {}
        self.names = [i for i, _ in items]
        flat, starts, owner, at = [], {}, {}, 0
        for k, (_, text) in enumerate(items):
            words = words_of(text, self.table)
            if not words:
                continue
            flat.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64))
            m = min(window, len(words))
            starts.setdefault(m, []).append(np.arange(at, at + len(words) - m + 1))
            owner.setdefault(m, []).append(np.full(len(words) - m + 1, k))
            at += len(words)
        array = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        self.tools = [Searcher(m, array, np.concatenate(starts[m]), np.concatenate(owner[m])) for m in sorted(starts)]

    def find(self, text: str | None) -> tuple[int, list[int], list[int], set[str]]:
        """Number of words, starts and stops of all occurrences, and the ids of their items."""
        words = words_of(text, self.table)
        starts, stops, ids = [], [], set()
        for tool in self.tools:
            for at, owners in tool.search(words, self.number):
                starts.append(at)
                stops.append(at + tool.m)
                ids.update(owners)
        return len(words), starts, stops, {self.names[k] for k in ids} - {None}


def merged(starts: np.ndarray, stops: np.ndarray) -> list[dict]:
    """The union of half-open spans, as disjoint spans in order."""
    out: list[dict] = []
    for s, e in sorted(zip(starts, stops, strict=True)):
        if out and s <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], e)
        else:
            out.append({"start": s, "stop": e})
    return out


def blocks_of(benchmark: DataFrame, item: str, text: str, limit: int, nameless: bool = False) -> list[list[tuple[str | None, str]]]:
    """The benchmark in blocks of at most ``limit`` bytes of text (or one item), brought to the driver one at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).filter("t is not null" if nameless else "i is not null and t is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    count = max(1, -(-2 * total // limit)) if total > limit else 1
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k) if count > 1 else rows
        yield [(r["i"], r["t"]) for r in part.collect()]


def find_contamination(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, nameless: bool = False) -> DataFrame:
    """Every row with what of it occurs in the benchmark: structs ``row`` (as given) and ``out`` (n_words; spans, the
    disjoint word ranges hit; items, the ids with occurring windows, as strings)."""
    spark = docs.sparkSession
    out, first = docs, True
    for items in blocks_of(benchmark, item_col, item_text, block_bytes, nameless):
        shipped, mark = spark.sparkContext.broadcast(items), uuid.uuid4().hex  # at most block_bytes of text

        def make(shipped=shipped, mark=mark):
            patterns = once("decontaminate", mark, lambda: Patterns(shipped.value, window))

            def call(a):
                total, spans, items = [], [], []
                was = a["was"].to_pylist() if "was" in a else [None] * len(a["text"])
                for text, old in zip(a["text"].to_pylist(), was, strict=True):
                    n, starts, stops, ids = patterns.find(text)
                    if old:
                        starts += [s["start"] for s in old["spans"]]
                        stops += [s["stop"] for s in old["spans"]]
                        ids |= set(old["items"])
                    total.append(n)
                    spans.append(merged(starts, stops) if starts else [])
                    items.append(sorted(ids))
                return [pa.array(v, f) for v, f in zip((total, spans, items), (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string())), strict=True)]

            return call

        if first:
            out, first = map_rows(out, {"text": text_col}, make, OUT), False
        else:
            out = map_rows(out.withColumn("text", F.col("row")[text_col]), {"text": "text", "was": "out"}, make, OUT).select("row.row", "out")
    return out


def hit_words(spans):
    """How many words disjoint spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
