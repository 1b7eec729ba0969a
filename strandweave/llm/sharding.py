"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (text_crc32, doc_id, arrival number), so equal texts stand together and every row has a place
of its own; a group of copies, however large, can be cut anywhere. The splitters are found by counting: each
round sums the exact bytes and rows in up to ``BINS`` bins of every key interval that still holds a boundary,
and refines only the bins in which a boundary falls, until each boundary is within ``tolerance`` of its
target or between two neighbouring rows. Each shard is cut into ``pieces`` the same way, so a task sorts a
piece and never a shard. The rows are then exchanged once, by piece, and numbered within it; the exact row
counts below each splitter turn that number into the shard's slot.

Defined cases: a null text has size 1 (0 bytes plus 1) and crc32 0; a null doc_id sorts before all others;
repeated rows keep their own places by arrival number; an empty table gives an empty result; fewer rows than
shards leave shards empty. No shard's bytes differ from the mean by more than twice the tolerance plus
the largest rows next to its two boundaries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_numbers

TOP_BITS = 12
BINS = 256
LOWEST = -(2**63)
#: A piece should hold at most so many rows, and so many bytes of carried text; pieces grow in number and not in size.
PIECE_ROWS, PIECE_BYTES = 2_000_000, 2_000_000_000
#: Intervals counted in one job, so that at most CELLS * BINS rows are on the driver at once.
CELLS = 2000


@dataclass
class Cell:
    """A key interval that holds boundaries: ``level`` is the key part that varies between lo and hi (inclusive)."""

    level: int
    prefix: tuple
    lo: int
    hi: int
    below_bytes: int
    below_rows: int
    targets: list[int] = field(default_factory=list)

    @property
    def shift(self) -> int:
        s = 0
        while (self.hi >> s) - (self.lo >> s) >= (1 << TOP_BITS if self.level == 0 and not self.below_rows and self.hi - self.lo == 2**32 - 1 else BINS):
            s += 1
        return s


def splitter(level: int, prefix: tuple, value: int) -> tuple[int, int, int]:
    """The smallest whole key with this prefix and this value."""
    while level > 0 and value > 2**63 - 1:
        level, value, prefix = level - 1, prefix[-1] + 1, prefix[:-1]
    return (*prefix, value, *[LOWEST] * (2 - level))


def keyed(df: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """crc, id, arrival number and size of every row, written once to the shared checkpoint folder."""
    text, doc = df[f"`{text_col}`"], df[f"`{id_col}`"]
    rows = df.select(
        doc.alias("doc_id"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("k0"),
        F.coalesce(doc.cast("long"), F.lit(LOWEST)).alias("k1"),
        (F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1).alias("size"),
        F.struct(*[df[f"`{c}`"] for c in carry], F.lit(0).alias("_")).alias("carried"),
    ).withColumn("k2", F.monotonically_increasing_id())
    return cut(rows if carry else rows.drop("carried"))


def counted(rows: DataFrame, cells: list[Cell]) -> dict[int, list]:
    """Per cell its bins in key order: (bin, bytes, rows, least key, greatest key, least next key, greatest next key).

    At most len(cells) * BINS rows (or 2 ** TOP_BITS in the first round) come to the driver.
    """
    spark = rows.sparkSession
    if len(cells) == 1 and cells[0].level == 0:
        c = cells[0]
        inside = rows.filter(F.col("k0").between(c.lo, c.hi)).select(F.lit(0).alias("cell"), "k0", "k1", "k2", "size", F.lit(0).alias("level"), F.lit(c.lo).alias("lo"), F.lit(c.shift).alias("sh"))
    else:
        listed = []
        for i, c in enumerate(cells):
            p = [*c.prefix, c.lo][:3] + [LOWEST] * (2 - c.level)
            q = [*c.prefix, c.hi][:3] + [2**63 - 1] * (2 - c.level)
            first, last = p[0] >> (32 - TOP_BITS), q[0] >> (32 - TOP_BITS)
            listed += [(top, i, c.level, c.lo, c.shift, *p, *q) for top in range(first, last + 1)]
        small = spark.createDataFrame(listed, "top int, cell int, level int, lo long, sh int, p0 long, p1 long, p2 long, q0 long, q1 long, q2 long")
        key, low, high = F.struct("k0", "k1", "k2"), F.struct(F.col("p0").alias("k0"), F.col("p1").alias("k1"), F.col("p2").alias("k2")), F.struct(F.col("q0").alias("k0"), F.col("q1").alias("k1"), F.col("q2").alias("k2"))
        # ``small`` has one row for each open interval: at most shards * pieces rows.
        inside = rows.withColumn("top", F.shiftright("k0", 32 - TOP_BITS).cast("int")).join(F.broadcast(small), "top").filter((key >= low) & (key <= high))
    k = F.when(F.col("level") == 0, F.col("k0")).when(F.col("level") == 1, F.col("k1")).otherwise(F.col("k2"))
    nxt = F.when(F.col("level") == 0, F.col("k1")).otherwise(F.col("k2"))
    made = inside.withColumn("k", k).withColumn("nxt", nxt).withColumn("bin", F.expr("shiftright(k, sh) - shiftright(lo, sh)"))
    got = made.groupBy("cell", "bin").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("k").alias("k_lo"), F.max("k").alias("k_hi"), F.min("nxt").alias("n_lo"), F.max("nxt").alias("n_hi")).collect()
    out: dict[int, list] = {i: [] for i in range(len(cells))}
    for r in sorted(got, key=lambda r: (r["cell"], r["bin"])):
        out[r["cell"]].append(tuple(r)[1:])
    return out


def find_splitters(rows: DataFrame, targets: list[int], total_bytes: int, total_rows: int, tolerance: int) -> list[tuple]:
    """For each target (bytes that should lie below) a tuple (key, bytes below, rows below), in order."""
    done: dict[int, tuple] = {}
    cells = [Cell(0, (), 0, 2**32 - 1, 0, 0, list(range(len(targets))))] if total_rows else []
    while cells:
        bins = {}
        for a in range(0, len(cells), CELLS):
            bins |= {a + i: b for i, b in counted(rows, cells[a : a + CELLS]).items()}
        opened: list[Cell] = []
        for i, c in enumerate(cells):
            below_b, below_n = c.below_bytes, c.below_rows
            left = list(c.targets)
            for _, b, n, k_lo, k_hi, n_lo, n_hi in bins[i]:
                inner = []
                for t in [t for t in left if targets[t] <= below_b + b]:
                    left.remove(t)
                    down, up = targets[t] - below_b, below_b + b - targets[t]
                    if n > 1 and min(down, up) > tolerance:
                        inner.append(t)
                    elif down <= up:
                        done[t] = (splitter(c.level, c.prefix, k_lo), below_b, below_n)
                    else:
                        done[t] = (splitter(c.level, c.prefix, k_hi + 1), below_b + b, below_n + n)
                if inner and k_lo < k_hi:
                    opened.append(Cell(c.level, c.prefix, k_lo, k_hi, below_b, below_n, inner))
                elif inner:
                    opened.append(Cell(c.level + 1, (*c.prefix, k_lo), n_lo, n_hi, below_b, below_n, inner))
                below_b, below_n = below_b + b, below_n + n
        cells = opened
    return [done[t] for t in sorted(done)]


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, tolerance_share: float = 0.0005, pieces: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """Give every row its shard and slot: doc_id, size, text_crc32, shard, slot and, if asked, struct ``carried``.

    ``tolerance_share`` is the tolerated error of a boundary as a share of a shard's mean bytes.
    """
    whole_numbers(df, id_col)
    rows = keyed(df, id_col, text_col, carry or [])
    totals = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    spark = df.sparkSession
    needed = max(-(-totals["n"] // (shards * PIECE_ROWS)), -(-totals["b"] // (shards * PIECE_BYTES)) if carry else 1)
    pieces = pieces or max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2 // shards, needed, 1)
    parts = shards * pieces
    wanted = [round(totals["b"] * j / parts) for j in range(1, parts)]
    found = find_splitters(rows, wanted, totals["b"], totals["n"], max(1, int(totals["b"] / shards * tolerance_share)))
    # Rows below each piece's first key, and from it the place of the piece within its shard.
    starts = [0] + [n for _, _, n in found] if found else [0] * parts
    offsets = [(p, starts[p] - starts[p // pieces * pieces]) for p in range(parts)]
    keys = [k for k, _, _ in found]
    tops = {}
    for top in range(1 << TOP_BITS):
        tops[top] = [0, []]
    for k in keys:
        tops[min(k[0] >> (32 - TOP_BITS), (1 << TOP_BITS) - 1)][1].append(k)
    seen = 0
    for top in range(1 << TOP_BITS):
        tops[top][0], seen = seen, seen + len(tops[top][1])
    # A splitter past the last key of its top bin belongs to every row of the next bins; it is counted in ``seen`` above.
    first = spark.createDataFrame([(t, b, [tuple(k) for k in ks]) for t, (b, ks) in tops.items()], "top int, base int, cuts array<struct<k0:long,k1:long,k2:long>>")
    places = spark.createDataFrame(offsets, "piece int, offset long")
    # Both tables have a fixed number of rows (2 ** TOP_BITS, and shards * pieces).
    dealt = (
        rows.withColumn("top", F.shiftright("k0", 32 - TOP_BITS).cast("int"))
        .join(F.broadcast(first), "top")
        .withColumn("piece", F.col("base") + F.size(F.expr("filter(cuts, c -> c <= struct(k0, k1, k2))")))
        .join(F.broadcast(places), "piece")
    )
    from pyspark.sql import Window

    order = Window.partitionBy("piece").orderBy("k0", "k1", "k2")
    out = dealt.withColumn("slot", F.row_number().over(order).cast("long") - 1 + F.col("offset"))
    return out.select(
        "doc_id",
        "size",
        F.col("k0").alias("text_crc32"),
        F.floor(F.col("piece") / pieces).cast("int").alias("shard"),
        "slot",
        *(["carried"] if carry else []),
    )
