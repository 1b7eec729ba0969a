"""SimHash near-duplicates by similarity: operator 2 with wide fingerprints and an exact check.

Two texts are near copies if their sets of ``SHINGLE``-word shingles have a Jaccard similarity of NUM / DEN or more. Texts
of equal set form a class, and only classes are compared. A class has a SimHash fingerprint of 128 bits. Classes
similar at 0.8 differ in 19.4 of them on average (standard deviation 4.1; fewer if they are more similar), others in
64 (5.7), so all within ``WHOLE`` bits, and ``HALF`` of the first 64, are candidates: a pair at just 0.8 is missed
about once in 100,000 times.

The first vantage point of the search is the empty set: a set's distance to it is its size, and by the triangle bound similar
sets lie in rings whose sizes differ by a factor of DEN / NUM at most. Classes are dealt into blocks of neighbouring
rings, and a block queries itself and the blocks across its upper boundary that the bound leaves. Within a task the
fingerprints are dealt into rings of their Hamming distance to vantage points drawn from them, level by level, and a
ring meets only rings within ``WHOLE`` of its own (``groups_of``). At so wide a radius that keeps clusters apart but prunes
little among unrelated fingerprints, whose distances all lie near 64: the search stays quadratic within a ring's reach; the
README has figures.

A task of the search gives back which classes hang together by candidates, as a spanning forest, never all pairs. In each
of these groups the candidates are then checked on whole shingle sets, nearest first, and only between classes not
joined yet, until none is left: no similar candidate pair is lost, and no unchecked one joins two texts. Groups too large
for a task are checked in pairs of pieces.

Defined cases: words are those of ``simhash``; texts of fewer than five words have one shingle; texts without words (null
and empty ones too) have the empty set and form one class; a null id takes part but names a component only if
all its ids are null (the name is then null); an empty table gives an empty result. Shingles, sets and texts are
compared by 64 bits of hash each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_rows
from .components import components
from .simhash import SEED, bits_of, hashes_of

SHINGLE = 5
#: The similarity as a fraction, so that no rounding decides.
NUM, DEN = 4, 5
#: Most differing bits of a candidate: in the first 64, and in all 128.
HALF, WHOLE = 22, 36
#: Classes of a block of the search, and shingles of a piece of a group that is checked.
BLOCK, PIECE = 8_000, 4_000_000
#: Rings grow by this factor. There are some 1000 of them at most, whatever the data.
RING = 1.02
#: A tile of the comparison: rows and columns.
TILE = (16, 4096)
#: The tree of vantage points: pairs that are compared without a further level, most levels, rings that make a band, and
#: rows that a vantage point is chosen from.
LEAF, LEVELS, BAND, POINTS = 4_000_000, 3, 6, 24
#: Up to so many texts are picked out by broadcast hashes (16 MB), more by an exchange.
FEW = 1_000_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles."""
    return np.unique(hashes_of(text, size))


def second(hashes: np.ndarray) -> np.ndarray:
    """Another 64 bits for each hash."""
    x = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def describe(text: str | None, size: int = SHINGLE) -> tuple[int, int, int, int]:
    """Name of the text's class, both halves of its fingerprint, and the set's size."""
    own = shingles(text, size)
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63), bits_of(own, ties=True), bits_of(second(own), ties=True), len(own)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both)


def candidates(f: np.ndarray, g: np.ndarray, rows: slice, cols: slice) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of candidates between two runs of fingerprints (halves ``f`` and ``g``)."""
    low = np.bitwise_count(f[rows, None] ^ f[None, cols])
    r, c = np.nonzero(low <= HALF)
    if len(r):
        keep = low[r, c] + np.bitwise_count(g[rows][r] ^ g[cols][c]) <= WHOLE
        r, c = r[keep], c[keep]
    return r + rows.start, c + cols.start


def apart(f: np.ndarray, g: np.ndarray, v: int) -> np.ndarray:
    """Differing bits from fingerprint ``v``."""
    return np.bitwise_count(f ^ f[v]).astype(np.int64) + np.bitwise_count(g ^ g[v])


def vantage_point(f: np.ndarray, g: np.ndarray, rows: np.ndarray) -> int:
    """Of some of the rows the one whose distances to them spread most."""
    few = rows[:: max(1, len(rows) // POINTS)]
    return int(few[np.argmax([apart(np.r_[f[v], f[few]], np.r_[g[v], g[few]], 0).var() for v in few])])


def groups_of(size: np.ndarray, f: np.ndarray, g: np.ndarray, split: int | None = None) -> np.ndarray:
    """For each class the least place of the group that candidates join it to. Rows are sorted by size; with ``split``,
    rows before it meet only rows from it on.

    Rows fall into bands of rings around a vantage point, and a band meets those that the triangle bound leaves; each such
    pair of bands is dealt by a vantage point of its own, down to small ones, which are compared.
    """
    label = np.arange(len(size))

    def walk(rows: np.ndarray, cols: np.ndarray | None, depth: int) -> None:
        """``cols`` None: all pairs of the rows. Both are sorted by size."""
        many = len(rows) * (len(rows) if cols is None else len(cols))
        if not many:
            return
        if many <= LEAF or depth >= LEVELS:
            compare(label, size, f, g, rows, cols)
            return
        v = vantage_point(f, g, rows)
        near = apart(f, g, v)
        band, far = near[rows] // BAND, near[rows if cols is None else cols]
        for k in np.unique(band).tolist():
            mine, low, high = rows[band == k], k * BAND - WHOLE, k * BAND + BAND - 1 + WHOLE
            if cols is None:
                walk(mine, None, depth + 1)
                walk(mine, rows[(far >= (k + 1) * BAND) & (far <= high)], depth + 1)
            else:
                walk(mine, cols[(far >= low) & (far <= high)], depth + 1)

    places = np.arange(len(size))
    walk(places if split is None else places[:split], None if split is None else places[split:], 0)
    return label


def compare(label: np.ndarray, all_sizes: np.ndarray, all_f: np.ndarray, all_g: np.ndarray, rows: np.ndarray, cols: np.ndarray | None) -> None:
    """Join the labels of all candidates between rows and cols (None: among the rows), tile by tile."""
    held = rows if cols is None else np.concatenate([rows, cols])
    split, last = None if cols is None else len(rows), len(rows)
    size, f, g = all_sizes[held], all_f[held], all_g[held]
    for a in range(0, last, TILE[0]):
        b = min(last, a + TILE[0])
        start = a if split is None else split
        reach = size[b - 1] * DEN // NUM
        if split is None:
            stop = int(np.searchsorted(size, reach, "right"))
        else:
            start += int(np.searchsorted(size[split:], -(-size[a] * NUM // DEN)))
            stop = split + int(np.searchsorted(size[split:], reach, "right"))
        for c in range(start, stop, TILE[1]):
            x, y = candidates(f, g, slice(a, b), slice(c, min(stop, c + TILE[1])))
            fits = (NUM * np.maximum(size[x], size[y]) <= DEN * np.minimum(size[x], size[y])) & (label[held[x]] != label[held[y]])
            if fits.any():
                join(label, label[held[x[fits]]], label[held[y[fits]]])


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite labels pairwise; every row then has the least label of its group."""
    root: dict[int, int] = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for x, y in np.unique(np.stack([a, b], 1), axis=0).tolist():
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    move = np.arange(len(label))
    for x in root:
        move[x] = find(x)
    label[:] = move[label]


def links_in(names: np.ndarray, sets: list[np.ndarray], f: np.ndarray, g: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Checked links (a, b) that join all similar candidates of a group; with ``side``, those between the sides."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    names, f, g, sets = names[order], f[order], g[order], [sets[i] for i in order]
    side = None if side is None else side[order]
    size = np.array([len(s) for s in sets])
    label, out = np.arange(len(sets)), []
    for i in range(len(sets)):
        stop = int(np.searchsorted(size, size[i] * DEN // NUM, "right"))
        _, js = candidates(f, g, slice(i, i + 1), slice(i + 1, stop)) if stop > i + 1 else (None, np.zeros(0, np.int64))
        if side is not None:
            js = js[side[js] != side[i]]
        js = js[label[js] != label[i]]
        if len(js) > 1:
            js = js[np.argsort(np.bitwise_count(f[js] ^ f[i]) + np.bitwise_count(g[js] ^ g[i]), kind="stable")]
        while len(js):
            j, js = js[0], js[1:]
            if similar(sets[i], sets[j]):
                out.append((int(names[i]), int(names[j])))
                label[label == label[j]] = label[i]
                js = js[label[js] != label[i]]
    return out


@dataclass
class Blocks:
    """Which block a class is in, and which later blocks hold sets that its own can be similar to."""

    first: dict[int, tuple[int, int]]  # ring: first block, number of blocks
    reach: np.ndarray  # block: last block it queries

    @classmethod
    def of(cls, rings: list[tuple[int, int, int, int]], most: int) -> Blocks:
        """``rings``: (ring, count, least size, greatest size) in order. Small rings share a block, large ones have several."""
        first, low, high, held = {}, [], [], 0
        for ring, count, least, greatest in rings:
            if not low or count > most or held + count > most:
                n = max(1, -(-count // most))
                first[ring] = (len(low), n)
                low += [least] * n
                high += [greatest] * n
                held = count if n == 1 else most
            else:
                first[ring] = (len(low) - 1, 1)
                high[-1], held = greatest, held + count
        return cls(first, np.searchsorted(np.array(low, np.int64), np.array(high, np.int64) * DEN // NUM, "right") - 1)

    def of_rows(self, ring: np.ndarray, f: np.ndarray) -> np.ndarray:
        kinds, at = np.unique(ring, return_inverse=True)
        start, n = (np.array(x, np.int64) for x in zip(*[self.first[int(k)] for k in kinds], strict=True))
        return start[at] + (f % n[at].astype(np.uint64)).astype(np.int64)


def ring_of(size):
    return F.floor(F.log(F.greatest(size, F.lit(1))) / float(np.log(RING))).cast("int")


def candidate_groups(classes: DataFrame, block: int) -> DataFrame:
    """(a, b): enough edges to join all classes that candidates join. ``classes``: name, f, g, size."""
    spark = classes.sparkSession
    placed = classes.select("name", "f", "g", "size", ring_of(F.col("size")).alias("ring"))
    rings = placed.groupBy("ring").agg(F.count("*"), F.min("size"), F.max("size")).orderBy("ring").collect()  # some 1000 rows at most
    plan = spark.sparkContext.broadcast(Blocks.of([tuple(r) for r in rings], block))

    def deal(batches):
        """Each row once for every pair of blocks that its own block is part of."""
        reach = plan.value.reach
        for b in batches:
            if not b.num_rows:
                continue
            own = plan.value.of_rows(b.column(4).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            from_ = np.searchsorted(reach, np.arange(len(reach)))  # the first block that queries each
            count = reach[own] - from_[own] + 1
            at = np.repeat(np.arange(len(own)), count)
            other = from_[own][at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            mine = own[at]
            for s in range(0, len(at), 50_000):
                part = at[s : s + 50_000]
                lo, hi, up = np.minimum(mine, other)[s : s + 50_000], np.maximum(mine, other)[s : s + 50_000], (mine > other)[s : s + 50_000]
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(part)) for i in range(4)), pa.array(lo), pa.array(hi), pa.array(up)], names=["name", "f", "g", "size", "lo", "hi", "up"])

    def within(group: pa.Table) -> pa.Table:
        name, f, g, size, up = (group.column(c).to_numpy() for c in ("name", "f", "g", "size", "up"))
        order = np.lexsort((size, up))
        name, f, g, size, up = name[order], f[order].view(np.uint64), g[order].view(np.uint64), size[order].astype(np.int64), up[order]
        label = groups_of(size, f, g, None if group.column("lo")[0].as_py() == group.column("hi")[0].as_py() else int((~up).sum()))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": name[moved], "b": name[label[moved]]})

    dealt = placed.mapInArrow(deal, "name long, f long, g long, size int, lo long, hi long, up boolean")
    return dealt.groupBy("lo", "hi").applyInArrow(within, "a long, b long")


def checked(members: DataFrame, texts: DataFrame, size: int, piece: int) -> DataFrame:
    """(a, b): checked links that join all similar candidates. ``members``: name, th, f, g, size, root (the group);
    ``texts``: th and text of all documents."""
    total = members.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = members.select("th").distinct()
    held = texts.join(F.broadcast(wanted) if total[0] <= FEW else wanted, "th", "left_semi").dropDuplicates(["th"])
    # Groups too large for a task are cut into pieces; there are at most sum(size) / piece of them.
    large = members.groupBy("root").agg(F.sum("size").alias("all")).filter(F.col("all") > piece).select("root", F.ceil(2 * F.col("all") / piece).cast("int").alias("pieces"))
    buckets = max(1, int(-(-2 * total[1] // piece)))
    dealt = members.join(F.broadcast(large), "root", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    mine = F.pmod(F.xxhash64("name"), "pieces").cast("int")
    bucket = F.when(F.col("pieces") == 1, F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.col("root"))
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.select("name", "th", "f", "g", "root", (F.col("pieces") > 1).alias("cut"), bucket.alias("bucket"), F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine")

    def within(group: pa.Table) -> pa.Table:
        name, f, g, root, mine = (group.column(c).to_numpy() for c in ("name", "f", "g", "root", "mine"))
        apart = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
        sets = [shingles(t, size) for c in group.column("text").chunks for t in c.to_pylist()]
        order = np.argsort(root, kind="stable")
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            out += links_in(name[own], [sets[i] for i in own], f[own].view(np.uint64), g[own].view(np.uint64), mine[own] if apart else None)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return dealt.join(held, "th").drop("th").groupBy("cut", "bucket", "lo", "hi").applyInArrow(within, "a long, b long")


def classes_of(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """One row for each class: name, f, g, size, th (hash of one of its texts), best (its first row: nulls last, then by id,
    then by th) and many (whether several rows are equal to that in id and text)."""

    def make():
        def call(a):
            got = [describe(t, size) for t in a["text"].to_pylist()]
            return [pa.array([x[i] for x in got], pa.int32() if i == 3 else pa.int64()) for i in range(4)]

        return call

    out = T.StructType([*[T.StructField(n, T.LongType()) for n in ("name", "f", "g")], T.StructField("size", T.IntegerType())])
    slim = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    rows = map_rows(slim, {"text": "text"}, make, out).select(F.col("row.id").alias("id"), F.xxhash64("row.text").alias("th"), "out.*")
    each = rows.groupBy("name", "id", "th").agg(*[F.min(c).alias(c) for c in ("f", "g", "size")], F.count("*").alias("n"))
    best = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    return each.groupBy("name").agg(*[F.min(c).alias(c) for c in ("f", "g", "size", "th")], F.min(best).alias("best"), (F.min_by("n", best) > 1).alias("many"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """One row for each class: its columns (see ``classes_of``) and component, the name of its component's first class."""
    classes = cut(classes_of(docs, id_col, text_col, size))
    groups = components(candidate_groups(classes, block)).select(F.col("a").alias("name"), F.col("b").alias("root"))
    groups = cut(groups.union(groups.select(F.col("root").alias("name"), "root").distinct()))
    members = cut(classes.select("name", "th", "f", "g", "size").join(groups, "name"))
    texts = docs.select(F.xxhash64(docs[f"`{text_col}`"]).alias("th"), docs[f"`{text_col}`"].alias("text"))
    linked = components(checked(members, texts, size, piece)).select(F.col("a").alias("name"), F.col("b").alias("component"))
    return classes.join(linked, "name", "left").withColumn("component", F.coalesce("component", "name"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """Every distinct (doc_id, text) with component_id, the least id that links reach: doc_id, th, component_id."""
    found = near_classes(docs, id_col, text_col, size, block, piece)
    names = found.groupBy("component").agg(F.min("best.id").alias("component_id"))
    by_class = found.join(names, "component").select(F.col("name"), "component_id")

    def make():
        return lambda a: [pa.array([xxhash.xxh64_intdigest(shingles(t, size).tobytes(), SEED) - (1 << 63) for t in a["text"].to_pylist()], pa.int64())]

    slim = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    rows = map_rows(slim, {"text": "text"}, make, T.StructType([T.StructField("name", T.LongType())])).select(F.col("row.id").alias("doc_id"), "out.name")
    return rows.join(by_class, "name").select("doc_id", F.col("name").alias("class"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """The rows of ``docs`` of which each component keeps one: that of least id (null last), then of least hash of the text;
    of rows equal in both, that of least hash over all columns."""
    found = near_classes(docs, id_col, text_col, size, block, piece)
    first = found.groupBy("component").agg(F.min("best").alias("best"), F.min_by("many", "best").alias("many"))
    first = cut(first.select(F.col("best.id").alias("_id"), F.col("best.th").alias("_th"), F.col("many").alias("_many")))
    th = F.xxhash64(docs[f"`{text_col}`"])
    same = docs[f"`{id_col}`"].eqNullSafe(first["_id"]) & (th == first["_th"])
    kept = docs.join(first.filter("not _many"), same, "left_semi")
    if not first.filter("_many").limit(1).count():
        return kept
    packed = docs.join(first.filter("_many"), same, "left_semi").select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    packed = packed.select("row", F.xxhash64("row").alias("h"), F.col("row")[id_col].alias("id"), F.xxhash64(F.col("row")[text_col]).alias("th"))
    return kept.unionByName(packed.groupBy("id", "th").agg(F.min_by("row", "h").alias("row")).select("row.*"))
