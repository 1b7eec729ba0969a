"""Assembly graph operators on segments (name, len, cov, seq) and half-edges (v1, e1, v2, e2, overlap).

Half-edges are symmetric: each link stands in both directions. A link leaves end e1 of v1 (true: the tail) and enters
end e2 of v2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.sequences import reverse_complement


#: Steps of a round of pruning that share a checkpoint.
PEELS = 3


def symmetric(links: DataFrame) -> DataFrame:
    """Both directions of every link, once; of repeated links the greatest overlap."""
    back = links.select(F.col("v2").alias("v1"), F.col("e2").alias("e1"), F.col("v1").alias("v2"), F.col("e1").alias("e2"), "overlap")
    return links.select("v1", "e1", "v2", "e2", "overlap").union(back).groupBy("v1", "e1", "v2", "e2").agg(F.max("overlap").alias("overlap"))


def known_only(links: DataFrame, segments: DataFrame) -> DataFrame:
    """Links of which both segments exist."""
    names = segments.select("name")
    return links.join(names.withColumnRenamed("name", "v1"), "v1", "left_semi").join(names.withColumnRenamed("name", "v2"), "v2", "left_semi").select(links.columns)


def remove_vertices(segments: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = gone.select("name")
    left = links.join(names.withColumnRenamed("name", "v1"), "v1", "left_anti").join(names.withColumnRenamed("name", "v2"), "v2", "left_anti")
    return segments.join(names, "name", "left_anti"), left.select(links.columns)


def connected_components(segments: DataFrame, links: DataFrame) -> DataFrame:
    """name, component: the least name that links reach.

    Alternating star contraction: each round links neighbours to the least of their neighbourhood and so shortens
    distances by half or more; the edge table is checkpointed every round, and nothing is collected.
    """
    edges = checkpointed(links.select(F.greatest("v1", "v2").alias("a"), F.least("v1", "v2").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == mark:
            break
        mark = tuple(now)
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
    return segments.select("name").join(edges.withColumnRenamed("a", "name"), "name", "left").select("name", F.coalesce("b", "name").alias("component"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder named by spark.checkpoint.dir; a temporary one only in plain local mode."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        told = sc.getConf().get("spark.checkpoint.dir")
        if not told and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not told:
            import tempfile

            told = tempfile.mkdtemp(prefix="strandweave-")
        sc.setCheckpointDir(told)
    # A checkpointed plan carries its constraints along, and those of a union of its own halves may name columns that it
    # no longer has; planned without them, it has none to carry.
    conf = df.sparkSession.conf
    before = conf.get(CONSTRAINTS)
    conf.set(CONSTRAINTS, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(CONSTRAINTS, before)


CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def component_weights(segments: DataFrame, components: DataFrame) -> DataFrame:
    """component, weight: the sum of len * cov."""
    return segments.join(components, "name").groupBy("component").agg(F.sum(F.col("len") * F.col("cov")).alias("weight"))


def top_components(weights: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """Components by falling weight, places ``first`` up to ``last`` (exclusive; None: one place)."""
    last = first + 1 if last is None else last
    return weights.orderBy(F.desc("weight"), "component").limit(last).withColumn("place", F.row_number().over(Window.orderBy(F.desc("weight"), "component")) - 1).filter(F.col("place") >= first)


def components_to_max(weights: DataFrame, share: float) -> DataFrame:
    """Components of at least ``share`` of the heaviest one's weight."""
    most = weights.agg(F.max("weight").alias("most"))
    return weights.crossJoin(F.broadcast(most)).filter(F.col("weight") >= share * F.col("most")).drop("most")


def components_to_total(weights: DataFrame, share: float) -> DataFrame:
    """The heaviest components until they hold ``share`` of all weight; at least one."""
    total = weights.agg(F.sum("weight").alias("all"))
    ahead = F.sum("weight").over(Window.orderBy(F.desc("weight"), "component").rowsBetween(Window.unboundedPreceding, -1))
    placed = weights.withColumn("ahead", F.coalesce(ahead, F.lit(0.0)))
    return placed.crossJoin(F.broadcast(total)).filter((F.col("ahead") < share * F.col("all")) | (F.col("ahead") == 0)).drop("ahead", "all")


def average_depth(segments: DataFrame) -> DataFrame:
    return segments.agg((F.sum(F.col("cov") * F.col("len")) / F.sum("len")).alias("depth"))


def purge_by_depth(segments: DataFrame, share: float) -> DataFrame:
    """Segments of at least ``share`` of the mean depth."""
    return segments.crossJoin(F.broadcast(average_depth(segments))).filter(F.col("cov") >= share * F.col("depth")).drop("depth")


def prune_terminal(segments: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take away contigs with a bare end until there is none. A checkpointed round peels ``PEELS`` contigs off a chain."""
    links, before = checkpointed(links), -1
    segments = checkpointed(segments)
    names = segments.select("name")
    while True:
        for _ in range(PEELS):
            names = known_only(links, names).groupBy(F.col("v1").alias("name")).agg(F.count_distinct("e1").alias("ends")).filter("ends = 2").select("name").join(names, "name", "left_semi")
        names = checkpointed(names)
        after = names.count()
        if after == before or after == 0:
            return segments.join(names, "name", "left_semi"), known_only(links, names)
        before = after


def prune_unaligned(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """Segments that some read path holds."""
    return segments.join(counts.select(F.explode("path").alias("s")).select(F.col("s.n").alias("name")), "name", "left_semi")


def paths_in_graph(paths: DataFrame, segments: DataFrame, links: DataFrame, key: str = "pid") -> DataFrame:
    """key, ok: every contig exists and all neighbours are linked. ``paths`` has ``key`` and ``path``."""
    steps = paths.select(key, F.explode("path").alias("s")).select(key, F.col("s.n").alias("name"))
    bad_v = steps.join(segments.select("name"), "name", "left_anti").select(key)
    used = paths.select(key, F.explode(P.links(F.col("path"))).alias("l")).select(key, "l.*")
    bad_l = used.join(links.select("v1", "e1", "v2", "e2"), ["v1", "e1", "v2", "e2"], "left_anti").select(key)
    bad = bad_v.union(bad_l).distinct().withColumn("bad", F.lit(True))
    return paths.join(bad, key, "left").select(key, F.col("bad").isNull().alias("ok"))


def circular(paths: DataFrame, links: DataFrame, key: str = "cid") -> DataFrame:
    """key, path, circular: whether the last step links back to the first."""
    found = paths.filter(F.size("path") > 0).withColumn("l", P.closing_link(F.col("path"))).select(key, "l.*")
    closed = found.join(links.select("v1", "e1", "v2", "e2"), ["v1", "e1", "v2", "e2"], "left_semi").select(key, F.lit(True).alias("c"))
    return paths.join(closed, key, "left").select(key, "path", F.coalesce("c", F.lit(False)).alias("circular"))


def fully_covered(paths: DataFrame, segments: DataFrame, key: str = "cid") -> DataFrame:
    """key, full: the path's contigs are all those of the graph."""
    n = segments.agg(F.count("*").alias("total"))
    own = paths.select(key, F.explode("path").alias("s")).join(segments.select(F.col("name").alias("sn")), F.col("s.n") == F.col("sn")).groupBy(key).agg(F.count_distinct("sn").alias("own"))
    return paths.select(key).join(own, key, "left").crossJoin(F.broadcast(n)).select(key, (F.coalesce("own", F.lit(0)) == F.col("total")).alias("full"))


def branching_ends(links: DataFrame) -> DataFrame:
    return links.groupBy("v1", "e1").agg(F.count("*").alias("n")).filter("n >= 2").select(F.col("v1").alias("name"), F.col("e1").alias("e"), "n")


def single_copy(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Contigs with fewer than two links on both ends."""
    return segments.select("name").join(branching_ends(links).select("name"), "name", "left_anti")


def self_loops(links: DataFrame) -> DataFrame:
    return links.filter("v1 = v2 and e1 and not e2").select(F.col("v1").alias("name"))


def end_links(segments: DataFrame, links: DataFrame) -> DataFrame:
    """name, tail, head: the sorted far ends of both ends' links."""
    far = F.array_sort(F.collect_list(F.struct(F.col("v2").alias("n"), F.col("e2").alias("e"))))
    of = lambda e, name: links.filter(F.col("e1") == e).groupBy(F.col("v1").alias("name")).agg(far.alias(name))
    none = F.array().cast("array<struct<n:string,e:boolean>>")
    return segments.select("name").join(of(True, "tail"), "name", "left").join(of(False, "head"), "name", "left").select("name", F.coalesce("tail", none).alias("tail"), F.coalesce("head", none).alias("head"))


def parallel_vertices(segments: DataFrame, links: DataFrame) -> DataFrame:
    """members: groups of contigs whose ends have the same links, either way round."""
    ends = end_links(segments, links)
    key = F.struct(F.least("tail", "head").alias("a"), F.greatest("tail", "head").alias("b"))
    return ends.groupBy(key.alias("k")).agg(F.array_sort(F.collect_list("name")).alias("members")).filter(F.size("members") > 1).select("members")


def palindromic_repeats(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Contigs that equal their reverse complement and whose ends have the same links or a link to their own end."""
    same = segments.filter(F.col("seq") == reverse_complement(F.col("seq"))).select("name")
    ends = end_links(same, links.join(same.withColumnRenamed("name", "v1"), "v1", "left_semi"))
    own = links.filter("v1 = v2 and e1 = e2").select(F.col("v1").alias("name")).distinct().withColumn("own", F.lit(True))
    return ends.join(own, "name", "left").filter((F.col("tail") == F.col("head")) | F.col("own")).select("name")


def split_palindromes(segments: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links without the doubled ones of simple palindromes, and the names of the others.

    A contig that equals its reverse complement can be read either way, so its links stand at both ends. With two
    neighbours each end keeps one (the head the first by name, the tail the second); with one neighbour nothing changes;
    any other such contig is a repeat to be corrected in paths.
    """
    same = palindromic_repeats(segments, links)
    ends = checkpointed(end_links(segments.join(same, "name", "left_semi"), links.join(same.withColumnRenamed("name", "v1"), "v1", "left_semi")))
    many = lambda n: (F.size("tail") == n) & (F.size("head") == n)
    pair = ends.filter(many(2)).select("name", "tail")
    gone = pair.select(F.col("name").alias("v1"), F.explode(F.array(F.struct(F.lit(False).alias("e1"), F.get("tail", F.lit(1)).alias("to")), F.struct(F.lit(True).alias("e1"), F.get("tail", F.lit(0)).alias("to")))).alias("x")).select("v1", "x.e1", F.col("x.to.n").alias("v2"), F.col("x.to.e").alias("e2"))
    both = gone.union(gone.select("v2", "e2", "v1", "e1")).distinct()
    return links.join(both, ["v1", "e1", "v2", "e2"], "left_anti").select(links.columns), ends.filter(~many(2) & ~many(1)).select("name")


def trim_overlaps(segments: DataFrame, links: DataFrame, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Cut a uniform overlap off: half of it (rounded down) from each head, the rest from each tail; links overlap no
    more. Overlap 0 changes nothing; a contig not longer than the overlap is an error."""
    if overlap == 0:
        return segments, links
    head = overlap // 2
    short = F.col("len") <= overlap
    cut = F.when(short, F.raise_error(F.concat(F.lit("contig shorter than the overlap: "), F.col("name")))).otherwise(F.col("len") - overlap)
    return segments.withColumn("seq", F.substring(F.col("seq"), F.lit(head + 1), F.col("len") - overlap)).withColumn("len", cut.cast("int")), links.withColumn("overlap", F.lit(0))


def rename(segments: DataFrame, links: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``names`` maps ``name`` to ``new_name``; other contigs keep theirs."""
    out = segments.join(names, "name", "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")
    a = names.select(F.col("name").alias("v1"), F.col("new_name").alias("a"))
    b = names.select(F.col("name").alias("v2"), F.col("new_name").alias("b"))
    moved = links.join(a, "v1", "left").join(b, "v2", "left").withColumn("v1", F.coalesce("a", "v1")).withColumn("v2", F.coalesce("b", "v2"))
    return out.select(segments.columns), moved.select(links.columns)


def numbered(segments: DataFrame) -> DataFrame:
    """name, new_name: contigs numbered by name."""
    return segments.select("name", F.row_number().over(Window.orderBy("name")).cast("string").alias("new_name"))


def duplicate(segments: DataFrame, links: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies of contigs. ``groups`` has name, copy (0: the contig itself) and factor of its depth.

    Copy k of a contig is named name__copyK; a copy links to the same copy of a neighbour that is copied too, and to
    every neighbour that isn't.
    """
    new = F.when(F.col("copy") == 0, F.col("name")).otherwise(F.concat("name", F.lit("__copy"), F.col("copy").cast("string")))
    made = segments.join(groups, "name", "left").withColumn("copy", F.coalesce("copy", F.lit(0))).withColumn("cov", F.col("cov") * F.coalesce("factor", F.lit(1.0))).withColumn("name", new)
    a = groups.select(F.col("name").alias("v1"), F.col("copy").alias("ca"))
    b = groups.select(F.col("name").alias("v2"), F.col("copy").alias("cb"))
    name = lambda v, c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, F.col(v)).otherwise(F.concat(F.col(v), F.lit("__copy"), F.col(c).cast("string")))
    linked = links.join(a, "v1", "left").join(b, "v2", "left").filter("ca is null or cb is null or ca = cb").withColumn("v1", name("v1", "ca")).withColumn("v2", name("v2", "cb"))
    return made.select(segments.columns), linked.select(links.columns)


def break_contigs(segments: DataFrame, links: DataFrame, breaks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut contigs after positions (``breaks``: name, pos from 1). Parts are named name_1, name_2, … and linked without
    overlap; outer links go to the first and last part."""
    cuts = breaks.join(segments.select("name", "len"), "name").filter("pos >= 1 and pos < len").select("name", "pos").distinct()
    ends = cuts.union(segments.join(cuts.select("name"), "name", "left_semi").select("name", F.col("len").alias("pos")))
    order = Window.partitionBy("name").orderBy("pos")
    parts = ends.withColumn("from", F.coalesce(F.lag("pos").over(order), F.lit(0))).withColumn("k", F.row_number().over(order)).withColumn("many", F.count("*").over(Window.partitionBy("name")))
    pieces = parts.join(segments.drop("len"), "name")
    named = F.concat("name", F.lit("_"), F.col("k").cast("string"))
    made = pieces.withColumn("len", (F.col("pos") - F.col("from")).cast("int")).withColumn("seq", F.substring(F.col("seq"), F.col("from") + 1, F.col("pos") - F.col("from"))).withColumn("name", named)
    whole = segments.join(cuts.select("name"), "name", "left_anti")
    count = parts.filter("k = many").select("name", "many")
    inner = parts.filter("k < many").select(F.concat("name", F.lit("_"), F.col("k").cast("string")).alias("v1"), F.lit(True).alias("e1"), F.concat("name", F.lit("_"), (F.col("k") + 1).cast("string")).alias("v2"), F.lit(False).alias("e2"), F.lit(0).alias("overlap"))
    both = inner.union(inner.select("v2", "e2", "v1", "e1", "overlap"))

    def outer(rows: DataFrame, v: str, e: str) -> DataFrame:
        got = rows.join(count.select(F.col("name").alias(v), "many"), v, "left")
        last = F.when(F.col(e), F.col("many")).otherwise(F.lit(1))
        return got.withColumn(v, F.when(F.col("many").isNull(), F.col(v)).otherwise(F.concat(F.col(v), F.lit("_"), last.cast("string")))).drop("many")

    moved = outer(outer(links.select("v1", "e1", "v2", "e2", "overlap"), "v1", "e1"), "v2", "e2")
    return whole.select(segments.columns).unionByName(made.select(segments.columns)), moved.select("v1", "e1", "v2", "e2", "overlap").union(both)


def add_inner_edges(segments: DataFrame, links: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New links between positions inside contigs (``edges``: n1, e1, pos1, n2, e2, pos2; positions from 1 on the forward
    strand). A walk that leaves n1 forward (e1) breaks it after pos1, one that leaves it backward before pos1, and
    likewise for the contig that is entered."""
    at1 = edges.select(F.col("n1").alias("name"), F.when(F.col("e1"), F.col("pos1")).otherwise(F.col("pos1") - 1).alias("pos"))
    at2 = edges.select(F.col("n2").alias("name"), F.when(F.col("e2"), F.col("pos2") - 1).otherwise(F.col("pos2")).alias("pos"))
    breaks = at1.union(at2).distinct()
    made, linked = break_contigs(segments, links, breaks)
    # Which part begins or ends at a position: one more than the breaks before it.
    real = breaks.join(segments.select("name", "len"), "name").filter("pos >= 1 and pos < len").select("name", "pos").distinct()

    def part(rows: DataFrame, n: str, e: str, pos: str, leaving: bool) -> DataFrame:
        last_before = F.col("pos") < F.col(pos)
        got = rows.join(real.withColumnRenamed("name", n), n, "left").groupBy(*rows.columns).agg(F.sum(F.when(last_before, 1).otherwise(0)).alias("k"), F.count("pos").alias("b"))
        new = F.when(F.col("b") == 0, F.col(n)).otherwise(F.concat(F.col(n), F.lit("_"), (F.col("k") + 1).cast("string")))
        return got.withColumn(n, new).drop("k", "b")

    done = part(part(edges, "n1", "e1", "pos1", True).select(edges.columns), "n2", "e2", "pos2", False)
    new = done.select(F.col("n1").alias("v1"), "e1", F.col("n2").alias("v2"), (~F.col("e2")).alias("e2"), F.lit(0).alias("overlap"))
    return made, symmetric(linked.union(new))


def merge_unbranched(segments: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join runs of contigs that are linked one to one. Lengths add up less overlaps, coverage is weighted by own bases,
    and parts and names follow the run from its lesser end.

    Runs are found by pointer doubling (checkpointed rounds); only links inside runs take part.
    """
    alone = links.groupBy("v1", "e1").agg(F.count("*").alias("n"), F.first("v2").alias("v2"), F.first("e2").alias("e2"), F.first("overlap").alias("overlap")).filter("n = 1").drop("n")
    back = alone.select(F.col("v1").alias("v2"), F.col("e1").alias("e2"), F.col("v2").alias("v1"), F.col("e2").alias("e1"))
    facing = checkpointed(alone.join(back, ["v1", "e1", "v2", "e2"], "left_semi").filter("v1 <> v2"))
    if facing.limit(1).count() == 0:
        return segments, links
    comp = connected_components(segments.join(facing.select(F.col("v1").alias("name")), "name", "left_semi"), facing)
    # A run is walked on the driver's side of a task: one group holds the links of one run.
    rows = facing.join(comp.withColumnRenamed("name", "v1"), "v1")

    def walk(group):
        import pandas as pd

        nxt = {(a, b): (c, d, o) for a, b, c, d, o in zip(group["v1"], group["e1"], group["v2"], group["e2"], group["overlap"], strict=True)}
        names = sorted({a for a, _ in nxt})
        ends = sorted((a, not b) for a, b in nxt if (a, not b) not in nxt)  # outward ends
        start = (ends[0][0], not ends[0][1]) if ends else (names[0], True)
        path, over, seen, now = [], [], set(), start
        while now[0] not in seen:
            path.append(now)
            seen.add(now[0])
            if now not in nxt:
                break
            v, e, o = nxt[now]
            over.append(int(o))
            now = (v, not e)
        over = over[: len(path) - 1]
        return pd.DataFrame({"run": [group["component"].iloc[0]] * len(path), "k": range(len(path)), "name": [n for n, _ in path], "e": [e for _, e in path], "over": [0, *over]})

    placed = checkpointed(rows.groupBy("component").applyInPandas(walk, "run string, k int, name string, e boolean, over int"))
    own = placed.join(segments, "name")
    oriented = F.when(F.col("e"), F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    piece = F.substring(oriented, F.col("over") + 1, F.col("len"))
    base = F.col("len") - F.col("over") + F.when(F.col("over") > 0, 1).otherwise(0)
    made = own.groupBy("run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), "_").alias("name"),
        F.sum(F.col("len") - F.col("over")).cast("int").alias("len"),
        (F.sum(F.col("cov") * base) / F.sum(base)).alias("cov"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", piece.alias("s")))), lambda x: x["s"]), "").alias("seq"),
    )
    lasts = placed.join(placed.groupBy("run").agg(F.max("k").alias("last")), "run")
    # The run's tail is where it leaves its last contig; its head is where it enters its first.
    tails = lasts.filter("k = last").select("run", "name", F.col("e").alias("end"), F.lit(True).alias("re"))
    heads = lasts.filter("k = 0").select("run", "name", (~F.col("e")).alias("end"), F.lit(False).alias("re"))
    outward = tails.union(heads).join(made.select("run", F.col("name").alias("new")), "run")
    inside = placed.select("name")
    a = outward.select(F.col("name").alias("v1"), F.col("end").alias("e1"), F.col("new").alias("n1"), F.col("re").alias("r1"))
    b = outward.select(F.col("name").alias("v2"), F.col("end").alias("e2"), F.col("new").alias("n2"), F.col("re").alias("r2"))
    rest = links.join(facing.select("v1", "e1"), ["v1", "e1"], "left_anti")
    moved = rest.join(a, ["v1", "e1"], "left").join(b, ["v2", "e2"], "left")
    out = moved.select(F.coalesce("n1", "v1").alias("v1"), F.coalesce("r1", "e1").alias("e1"), F.coalesce("n2", "v2").alias("v2"), F.coalesce("r2", "e2").alias("e2"), "overlap")
    # A run that closes on itself has no bare end; its closing link stays as a loop.
    closed = lasts.filter("k = last").join(facing, (F.col("name") == F.col("v1")) & (F.col("e") == F.col("e1"))).join(made.select("run", F.col("name").alias("new")), "run").select(F.col("new").alias("v1"), F.lit(True).alias("e1"), F.col("new").alias("v2"), F.lit(False).alias("e2"), "overlap")
    loops = closed.union(closed.select("v2", "e2", "v1", "e1", "overlap"))
    kept = segments.join(inside, "name", "left_anti").select("name", "len", "cov", "seq")
    return kept.unionByName(made.select("name", "len", "cov", "seq")), out.union(loops)


def subgraph_around(segments: DataFrame, links: DataFrame, baits: DataFrame, budget: int) -> DataFrame:
    """name, quota: contigs that a walk from a bait reaches before ``budget`` bases are used up; a step costs the
    contig's length less the overlap. Rounds keep each contig's greatest quota until none grows."""
    best = checkpointed(segments.join(baits.select("name"), "name", "left_semi").select("name", F.lit(float(budget)).alias("quota")))
    before = None
    while True:
        step = best.join(links, best["name"] == links["v1"]).join(segments.select(F.col("name").alias("to"), "len"), F.col("v2") == F.col("to"))
        reached = step.select(F.col("to").alias("name"), (F.col("quota") - F.col("len") + F.col("overlap")).alias("quota")).filter("quota > 0")
        best = checkpointed(best.union(reached).groupBy("name").agg(F.max("quota").alias("quota")))
        now = tuple(best.agg(F.count("*"), F.sum("quota")).first())
        if now == before:
            return best
        before = now


def no_leak(paths: DataFrame, links: DataFrame, key: str = "pid") -> DataFrame:
    """key, closed: whether all links of a path's contigs, but for its two outer ends, stay among its contigs."""
    n = F.size("path")
    steps = paths.select(key, "path", n.alias("n"), F.posexplode("path").alias("i", "s")).select(key, "i", "n", F.col("s.n").alias("v1"), F.col("s.e").alias("e"), F.transform("path", lambda x: x["n"]).alias("names"))
    sides = steps.select(key, "names", "v1", F.explode(F.array(F.struct(F.col("e").alias("e1"), (F.col("i") == F.col("n") - 1).alias("outer")), F.struct((~F.col("e")).alias("e1"), (F.col("i") == 0).alias("outer")))).alias("x")).select(key, "names", "v1", "x.e1", "x.outer").filter("not outer")
    leaks = sides.join(links.select("v1", "e1", "v2"), ["v1", "e1"]).filter(~F.array_contains("names", F.col("v2"))).select(key).distinct().withColumn("leak", F.lit(True))
    return paths.join(leaks, key, "left").select(key, F.col("leak").isNull().alias("closed"))


def reached(links: DataFrame, starts: DataFrame) -> DataFrame:
    """name, e, hops: contig ends that walks from ``starts`` (name, e: leaving by end e) enter and leave again, with the
    least number of links. Rounds of joins keep only newly reached ends."""
    seen = checkpointed(starts.select("name", "e", F.lit(0).alias("hops")).distinct())
    front, hops = seen, 0
    while front.limit(1).count():
        hops += 1
        step = front.join(links, (F.col("name") == F.col("v1")) & (F.col("e") == F.col("e1"))).select(F.col("v2").alias("name"), (~F.col("e2")).alias("e")).distinct()
        front = checkpointed(step.join(seen.select("name", "e"), ["name", "e"], "left_anti").withColumn("hops", F.lit(hops)))
        seen = checkpointed(seen.unionByName(front))
    return seen


def in_between(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Contigs on some walk from a contig of ``left`` to one of ``right`` (both: name, e, the end or way by which the walk
    leaves left and arrives at right). Tags spread to them."""
    ahead = reached(links, left).filter("hops > 0").select("name", "e")
    back = reached(links, right.select("name", (~F.col("e")).alias("e"))).filter("hops > 0").select("name", (~F.col("e")).alias("e"))
    ends = left.select("name").union(right.select("name"))
    return ahead.join(back, ["name", "e"], "left_semi").select("name").distinct().join(ends, "name", "left_anti")


def sequential_repeats(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Contigs that a walk can enter again from their own tail: repeats in a row or in a circle. name, hops of the least
    such walk."""
    # Only contigs that branch on both ends can repeat in a row; each is searched for from its own tail.
    both = branching_ends(links).groupBy("name").agg(F.count_distinct("e").alias("k")).filter("k = 2").select(F.col("name").alias("v1")).join(segments.select(F.col("name").alias("v1")), "v1", "left_semi")
    loops = both.join(links.filter("e1"), "v1").select(F.col("v1").alias("origin"), F.col("v2").alias("name"), (~F.col("e2")).alias("e"), F.lit(1).alias("hops"))
    seen = checkpointed(loops.distinct())
    front, hops = seen, 1
    while front.limit(1).count():
        hops += 1
        step = front.join(links, (F.col("name") == F.col("v1")) & (F.col("e") == F.col("e1"))).select("origin", F.col("v2").alias("name"), (~F.col("e2")).alias("e")).distinct()
        front = checkpointed(step.join(seen.select("origin", "name", "e"), ["origin", "name", "e"], "left_anti").withColumn("hops", F.lit(hops)))
        seen = checkpointed(seen.unionByName(front))
    return seen.filter((F.col("origin") == F.col("name")) & F.col("e")).groupBy("name").agg(F.min("hops").alias("hops"))
