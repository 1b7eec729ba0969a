"""Substring dedup by seed and extend.

A window is ``WINDOW`` consecutive words. Seeds are winnowed anchors: of the word groups of ``SEED_WORDS`` words within each
window the one of least hash, so two equal windows share their anchor at the same place. Documents are joined on
anchors without ever listing pairs: an anchor's occurrences meet one representative, the document of least id. An
occurrence is extended both ways as far as any window around the anchor can reach and compared with the
representative's surroundings; where they are equal, every window around the anchor recurs in a smaller
document. Occurrences that differ (at the ends of a repeat, or with other neighbours) are settled exactly: their
windows, and the representative's, are grouped by a 128-bit window hash with the least document id of each.
Neighbouring windows found join into maximal repeats of at least ``WINDOW`` words, and those words are removed.

Surroundings and windows are compared by two independent 64-bit hashes each (anchor and surroundings; two window
hashes).

Defined cases: null and empty texts and texts of under ``WINDOW`` words keep all their words; rows with a null id
neither lose words nor cause others to; rows that repeat an id count as the same document, so they don't
remove each other's words; ids must be whole numbers (else a TypeError at the call); windows are judged on the input, not on what is left; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from .common import forget, map_rows, release, small_batches, whole_numbers, written

WINDOW, SEED_WORDS = 13, 4
#: Bytes that are hashed together; longer words than LONG_WORD bytes are hashed one by one.
CHUNK, LONG_WORD = 1 << 19, 64
#: Odd multipliers of the hash families.
FAMILY = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)

OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("kept", T.StringType()),
        T.StructField("n_kept", T.LongType()),
    ]
)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(FAMILY[2])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(FAMILY[3])
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of words and word runs of many texts at once; keeps powers of the multipliers."""

    def __init__(self, window: int, seed: int):
        self.window, self.seed = window, seed
        self.reach = window - seed
        self.up: list[np.ndarray] = []
        self.powers(CHUNK + 1)

    def powers(self, n: int) -> None:
        self.up, self.down = [], []
        for a in FAMILY[:2]:
            for out, base in ((self.up, a), (self.down, pow(a, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                out.append(np.multiply.accumulate(steps))

    def runs(self, h: np.ndarray, family: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the values start to stop (exclusive) for each pair, whatever stands before them."""
        if len(h) + 1 > len(self.up[0]):
            self.powers(2 * len(h) + 2)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[family][: len(h)], out=total[1:])
        return mix((total[stop] - total[start]) * self.down[family][start])

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and stop of every word of UTF-8 bytes."""
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        turn = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
        start, stop = turn[::2], turn[1::2]
        h = np.empty(len(start), np.uint64)
        bounds = np.searchsorted(start, np.arange(0, len(data) + CHUNK, CHUNK))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a < b:  # words that start in one chunk
                low, high = start[a], min(stop[b - 1], start[a] + 2 * CHUNK)
                part = data[low:high].astype(np.uint64) + np.uint64(1)
                h[a:b] = self.runs(part, 0, start[a:b] - low, np.minimum(stop[a:b] - low, len(part))) + (stop[a:b] - start[a:b]).astype(np.uint64)
        for i in np.flatnonzero(stop - start > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(data[start[i] : stop[i]].tobytes())
        return mix(h), start, stop

    def anchors(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word group, and for every window the place of its anchor (the first of least hash)."""
        n = len(h) - self.seed + 1
        g = h[:n]
        for k in range(1, self.seed):
            g = g * np.uint64(FAMILY[0]) + h[k : k + n]
        g = mix(g)
        size = self.reach + 1
        count = n - size + 1
        least, at = g[:count].copy(), np.arange(count)
        for k in range(1, size):
            other = g[k : k + count]
            less = other < least
            np.copyto(least, other, where=less)
            np.copyto(at, np.arange(k, k + count), where=less)
        return g, at

    def surroundings(self, h: np.ndarray, at: np.ndarray, first: np.ndarray | int, last: np.ndarray | int) -> np.ndarray:
        """Hash of each anchor's words with all that any window around it can hold, cut at the text's ends."""
        start, stop = np.maximum(at - self.reach, first), np.minimum(at + self.seed + self.reach, last)
        cut = ((at - start) * 64 + (stop - at)).astype(np.uint64)
        return mix(self.runs(mix(h), 1, start, stop) + cut * np.uint64(FAMILY[0]))

    def window_hashes(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stop = at + self.window
        return self.runs(h, 0, at, stop), self.runs(mix(h ^ np.uint64(FAMILY[1])), 1, at, stop)

    def texts(self, texts: list[str | None]):
        """Groups of texts of some CHUNK bytes: (numbers of the texts, hashes of all words, text of each word counted
        within the group, first word of each text, all windows' starts that lie within a text)."""
        numbers, parts, size = [], [], 0
        for i, t in enumerate([*texts, None]):
            if i < len(texts) and t:
                numbers.append(i)
                parts.append(t.encode("utf-8", "surrogatepass"))
                size += len(parts[-1]) + 1
            if parts and (size >= CHUNK or i == len(texts)):
                h, start, _ = self.words(np.frombuffer(b" ".join(parts), np.uint8))
                ends = np.cumsum([len(p) + 1 for p in parts])
                bounds = np.r_[0, np.searchsorted(start, ends)]
                if len(h) >= self.window:
                    owner = np.repeat(np.arange(len(parts)), np.diff(bounds))
                    s = np.arange(len(h) - self.window + 1)
                    yield np.array(numbers), h, owner, bounds, s[owner[s] == owner[s + self.window - 1]]
                numbers, parts, size = [], [], 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def seeds(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(anchor, doc, around, met): each document's anchors with their surroundings, repeats left out.

    Of equal surroundings in one Arrow batch only the document of least id goes on as an occurrence; the others have
    ``met`` a smaller document already, and a spread key instead of the anchor. So a group of copies, however
    large, is reduced before it is exchanged.
    """

    def run(batches):
        forget("substrings")
        tool = Hasher(window, seed)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            parts: list[tuple] = []
            for numbers, h, owner, bounds, inside in tool.texts(b.column(1).to_pylist()):
                g, at = tool.anchors(h)
                at = np.unique(at[inside])
                who = owner[at]
                parts.append((g[at], ids[numbers][who], tool.surroundings(h, at, bounds[who], bounds[who + 1])))
            if not parts:
                continue
            a, d, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((d, s))
            a, d, s = a[order], d[order], s[order]
            fresh = np.r_[True, (np.diff(d) != 0) | (s[1:] != s[:-1])]
            a, d, s = a[fresh], d[fresh], s[fresh]
            lead = np.r_[True, s[1:] != s[:-1]]
            a = np.where(lead, a, mix(s ^ (d.view(np.uint64) * np.uint64(FAMILY[0]))))
            yield pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(d), pa.array(signed(s)), pa.array(~lead)], names=["anchor", "doc", "around", "met"])

    small_batches(docs.sparkSession)
    return docs.filter("doc is not null").select("doc", "text").mapInArrow(run, "anchor long, doc long, around long, met boolean")


def open_windows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(w1, w2, doc): the hashes of all windows whose anchor is in the document's list ``open``."""

    def run(batches):
        forget("substrings")
        tool = Hasher(window, seed)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            lists = b.column(2)
            wanted, sizes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False)
            owners = np.repeat(np.arange(len(ids)), sizes)
            keys = np.sort(mix(wanted ^ (owners.astype(np.uint64) * np.uint64(FAMILY[0]))))
            for numbers, h, owner, _, inside in tool.texts(b.column(1).to_pylist()):
                g, at = tool.anchors(h)
                who = numbers[owner[inside]]
                own = mix(g[at[inside]] ^ (who.astype(np.uint64) * np.uint64(FAMILY[0])))
                place = np.searchsorted(keys, own)
                hit = (place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] == own) if len(keys) else np.zeros(len(own), bool)
                w1, w2 = tool.window_hashes(h, inside[hit])
                d = ids[who[hit]]
                keep = np.unique(mix(w1 ^ (d.view(np.uint64) * np.uint64(FAMILY[0]))), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(signed(w1[keep])), pa.array(signed(w2[keep])), pa.array(d[keep])], names=["w1", "w2", "doc"])

    return docs.select("doc", "text", "open").mapInArrow(run, "w1 long, w2 long, doc long")


def both(w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    """One number for the two hashes of a window, used within a document only."""
    return mix(w1 * np.uint64(FAMILY[1]) + w2)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """Every row with its repeats: structs ``row`` (as given) and ``out`` (n_words; spans, the maximal word ranges
    removed; kept, the remaining words joined by blanks; n_kept)."""
    spark = docs.sparkSession
    whole_numbers(docs, id_col)
    slim = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc"), docs[f"`{text_col}`"].alias("text"))

    # Seed: anchors of two documents or more, with the representative's surroundings. The grouping is partly done before its
    # exchange, and both sides of the join are plain exchanges, so that AQE can split the rows of an anchor that is everywhere.
    occurrences = seeds(slim, window, seed)
    shared = written(
        occurrences.filter("not met")
        .groupBy("anchor")
        .agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min_by("around", "doc").alias("model"), F.min("around").alias("lo"), F.max("around").alias("hi"))
        .filter("first < last")
        .select("anchor", "first", "model", (F.col("lo") != F.col("hi")).alias("differ"))
    )
    release(spark)
    same = (F.col("doc") > F.col("first")) & (F.col("around") == F.col("model"))
    met = occurrences.join(shared, "anchor", "left").select("doc", F.when(F.col("met") | same, F.col("around")).alias("c"), F.when(~F.col("met") & ~same & F.col("differ"), F.col("anchor")).alias("o"))
    by_doc = written(met.filter("c is not null or o is not null").groupBy("doc").agg(F.collect_set("c").alias("covered"), F.collect_set("o").alias("open")))
    del occurrences, shared, met
    release(spark)

    # Extend what differs: windows with the least document that has them, by the same two steps. The windows are read twice and stay
    # on the executors' disks meanwhile (lost ones are computed again): they need no files in the shared folder, for each of which a task
    # starts several processes (chmod), and these share the whole memory of its JVM until they run.
    windows = open_windows(slim.join(by_doc.filter("size(open) > 0").select("doc", "open"), "doc"), window, seed).persist(StorageLevel.DISK_ONLY)
    try:
        least = written(windows.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("w1", "w2", "first"))
        again = windows.join(least, ["w1", "w2"]).filter("doc > first")
        found = written(again.groupBy("doc").agg(F.collect_list(F.struct("w1", "w2")).alias("windows")))
    finally:
        windows.unpersist()
    del windows, least, again
    release(spark)

    def make():
        tool = Hasher(window, seed)

        def judge(text, covered, listed):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if not covered and not listed:
                words = raw.split()
                return len(words), [], b" ".join(words).decode("utf-8", "surrogatepass"), len(words)
            h, start, stop = tool.words(np.frombuffer(raw, np.uint8))
            if len(h) < window:
                words = raw.split()
                return len(words), [], b" ".join(words).decode("utf-8", "surrogatepass"), len(words)
            g, at = tool.anchors(h)
            hit = np.zeros(len(at), bool)
            if covered:
                hit |= np.isin(signed(tool.surroundings(h, at, 0, len(h))), np.array(covered, np.int64))
            if listed:
                w1, w2 = tool.window_hashes(h, np.arange(len(at)))
                own = both(np.array([x["w1"] for x in listed], np.int64).view(np.uint64), np.array([x["w2"] for x in listed], np.int64).view(np.uint64))
                hit |= np.isin(both(w1, w2), own)
            edge = np.zeros(len(h) + 1, np.int64)
            starts = np.flatnonzero(hit)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            spans = [{"start": int(a), "stop": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)]
            stay = ~gone
            kept = b" ".join([raw[a:b] for a, b in zip(start[stay].tolist(), stop[stay].tolist(), strict=True)])
            return len(h), spans, kept.decode("utf-8", "surrogatepass"), int(stay.sum())

        def call(a):
            rows = [judge(*x) for x in zip(a["text"].to_pylist(), a["covered"].to_pylist(), a["windows"].to_pylist(), strict=True)]
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string(), pa.int64())
            return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

        return call

    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].cast("long").alias("doc"))
    joined = packed.join(by_doc.select("doc", "covered"), "doc", "left").join(found, "doc", "left").withColumn("text", F.col("row")[text_col])
    done = map_rows(joined, {"text": "text", "covered": "covered", "windows": "windows"}, make, OUT)
    return done.select("row.row", "out")
