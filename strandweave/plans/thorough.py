"""The two commands as Spark programs: estimate variants and proportions, and simulate reads."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import alignments as AL
from ..operators import bins as B
from ..operators import conflicts as C
from ..operators import graph as G
from ..operators import model as M
from ..operators import pangenome as PG
from ..operators import readpaths as R
from ..operators import resample as RS
from ..operators import search as SE
from ..operators import simulate as SI
from ..operators import variants as V
from ..sources import readers, writers


#: A solution of at most this support isn't fitted again, and isn't made the result.
LEAST_SUPPORT = 0.05
#: Chains of the posterior, each a task of its own.
CHAINS = 4


@dataclass
class Options:
    graph: str = ""
    alignment: str = ""
    output: str = ""
    fixed_variants: str | None = None
    candidate_variants: str | None = None
    start: str = "random"
    use_align_cov: bool = False
    decay: float = 20.0
    min_valid_search: int = 500
    max_valid_search: int = 10_000
    max_traversals: int = 30_000
    max_unique: int = 200
    max_uncover: float = 0.001
    criterion: str = "BIC"
    bootstrap: int = 100
    bootstrap_threshold: float = 0.95
    seed: int = 12345
    topology: str = "all"
    composition: str = "all"
    size_ratio: float = 0.0
    min_output_share: float = 0.0
    min_read_identity: float = 0.992
    min_record_identity: float = 0.99
    min_align_len: int = 5000
    min_align_counts: int = -1
    graph_component: tuple[int, int | None] = (0, None)
    purge_share: float = 0.001
    prune_terminal: bool = False
    merge_contigs: bool = False
    keep_unaligned: bool = False
    check_conflicts: str = "ignore"
    min_consensus_reads: int = 5
    gmm_max_std: float = 50.0
    mcmc: int = 0
    burn: int = 1000
    previous: str = "terminate"
    output_alignment: bool = False
    depth_goal: float = 300.0


@dataclass
class Solution:
    """One set of variants that replicates chose. Log-likelihood and criterion are those of a refit to all data, or None where
    there was none; then the proportions are the replicates' means. ``stds`` is empty for a single replicate."""

    cids: tuple[int, ...]
    support: float
    props: dict[int, float]
    loglik: float | None = None
    criterion: float | None = None
    stds: list[float] = field(default_factory=list)


@dataclass
class Result:
    options: Options
    segments: DataFrame
    links: DataFrame
    counts: DataFrame
    variants: DataFrame
    groups: DataFrame
    props: dict[int, float]
    loglik: float
    criterion: float
    members: dict[int, list[int]] = field(default_factory=dict)
    best: dict[int, float] = field(default_factory=dict)
    raw: tuple[int, ...] = ()
    raw_props: dict[int, float] = field(default_factory=dict)
    solutions: list[Solution] = field(default_factory=list)
    eligible: bool = True
    replicates: list[tuple[int, int, float]] = field(default_factory=list)
    posterior: dict[int, float] = field(default_factory=dict)

    @property
    def support(self) -> list[tuple[str, float]]:
        return [(",".join(map(str, sorted(s.cids))), s.support) for s in self.solutions]


def cells_of(spark: SparkSession, variants: DataFrame, subs: DataFrame, reads: DataFrame, segments: DataFrame, links: DataFrame) -> M.Cells:
    held = subs.select("path").distinct().withColumn("cid", F.xxhash64(P.to_gaf(F.col("path"))))
    de = G.checkpointed(B.describe(V.measured(held, segments, links)))
    counted = reads.withColumn("n", F.lit(1).cast("long"))
    placed = G.checkpointed(B.placed_lengths(de, counted))
    return M.gather(B.usable(B.cells(placed, de, counted)), subs, variants)


def thorough(spark: SparkSession, o: Options) -> Result:
    """Graph and alignment files in, variants with proportions and support out; result tables go to ``o.output``."""
    if o.output:
        prepare(spark, o)
    segments, links, _ = readers.read_gfa(spark, o.graph) if not o.graph.endswith(".fastg") else (*readers.read_fastg(spark, o.graph), None)
    segments, links = G.checkpointed(segments.drop("attrs")), G.checkpointed(links)
    comp = G.checkpointed(G.connected_components(segments, links))
    best = G.top_components(G.component_weights(segments, comp), *o.graph_component).select("component")
    segments = segments.join(comp.join(best, "component", "left_semi").select("name"), "name", "left_semi")
    links = G.known_only(links, segments)
    if o.merge_contigs:
        segments, links = G.merge_unbranched(G.checkpointed(segments), G.checkpointed(links))
    records = readers.read_alignments(spark, o.alignment, o.min_record_identity)
    graph_len = segments.agg(F.sum("len").alias("graph_len"))
    identity, length = o.min_read_identity, o.min_align_len
    if identity < 0 or length < 0:
        got = AL.auto_identity(AL.by_read(records), graph_len.first()[0] * o.depth_goal, 5000 if length < 0 else length, 0.95 if identity < 0 else identity, id_end=None if identity < 0 else 1e-5).first()
        identity, length = (0.95 if identity < 0 else identity) + got["id_adj"], (5000 if length < 0 else length) + got["ln_adj"]
    records = G.checkpointed(AL.filter_reads(records, length, identity))
    if o.output and o.output_alignment:
        writers.write_lines(writers.gaf_lines(records), f"{o.output}/filtered.gaf", one=False)
    if o.check_conflicts != "ignore":
        conflicts(spark, o, records, segments, links)
    least = o.min_align_counts if o.min_align_counts >= 0 else AL.auto_counts(records, graph_len).first()[0]
    rows = records.select("record_id", P.canonical(F.col("path")).alias("path"), F.col("p_align_len").alias("len"), P.to_gaf(P.canonical(F.col("path"))).alias("pid"))
    if o.use_align_cov:
        cov = R.coverage(R.count_paths(rows))
        segments = segments.drop("cov").join(cov, "name", "left").withColumn("cov", F.coalesce("cov", F.lit(1e-8))).select("name", "len", "cov", "seq")
    segments = G.checkpointed(G.purge_by_depth(segments, o.purge_share))
    links = G.checkpointed(G.known_only(links, segments))
    if o.prune_terminal or o.topology == "circular":
        segments, links = G.prune_terminal(segments, links)
    counts = R.count_paths(rows)
    ok = G.paths_in_graph(counts.withColumn("pid", P.to_gaf(F.col("path"))), segments, links).filter("ok").select("pid")
    reads = G.checkpointed(rows.join(ok, "pid", "left_semi"))
    counts = G.checkpointed(R.supported(R.count_paths(reads), least).select("path", "n"))
    if not counts.limit(1).count():
        raise ValueError("no supported read path")
    if not o.keep_unaligned:
        segments = G.checkpointed(G.prune_unaligned(segments, counts))
        links = G.checkpointed(G.known_only(links, segments))
    reads = G.checkpointed(reads.join(counts.select("path"), "path", "left_semi"))

    # Candidates: the user's first, then the search's in the order of their first walk.
    user = user_variants(spark, o, links)
    saved = f"{o.output}/candidates.parquet" if o.output else ""
    if o.previous == "resume" and saved and filesystem(spark, saved)[0].exists(filesystem(spark, saved)[1]):
        searched = readers.load_candidates(spark, saved)
    else:
        longest = reads.agg(F.max("len")).first()[0]
        s = SE.Settings(force_circular=o.topology == "circular", uni_chromosome=o.composition == "single", decay=o.decay, longest_alignment=longest, start=o.start, seed=o.seed)
        searched = SE.search(spark, segments, links, counts, s, o.min_valid_search, o.max_valid_search, o.max_traversals, o.max_unique, o.max_uncover)
        if saved:
            writers.save_candidates(searched, saved)
    merged = V.merge_candidates(user, searched.select("path", F.lit("search").alias("source"), F.col("first").alias("ord")))
    measured = V.measured(G.circular(merged, links), segments, links).join(merged.select("cid", "source"), "cid")
    kept = G.checkpointed(V.size_filter(V.sizes(measured).join(merged.select("cid", "source"), "cid"), o.size_ratio))
    if o.output:
        ids = searched.select("path", F.col("first").alias("sid")).join(merged.select("path", "cid"), "path").join(kept.select("cid"), "cid", "left_semi")
        table(ids.select("sid", "cid").orderBy("sid"), f"{o.output}/sid.to.cid.tab")
    variants = G.checkpointed(measured.join(kept.select("cid", "size"), "cid"))
    longest = reads.agg(F.max("len")).first()[0]
    subs = G.checkpointed(V.sub_paths(variants, longest, counts))
    groups = G.checkpointed(V.unidentifiable(subs, variants))
    stand_in = variants.join(groups.filter("cid = representative").select("cid"), "cid", "left_semi")
    own = G.checkpointed(subs.join(stand_in.select("cid"), "cid", "left_semi"))
    fixed = frozenset(r["cid"] for r in variants.filter("source = 'user_fixed'").select("cid").collect())
    cells = cells_of(spark, stand_in, own, reads, segments, links)
    fit = cells.select(o.criterion, fixed)
    members: dict[int, list[int]] = {}
    for r in groups.collect():
        members.setdefault(r["representative"], []).append(r["cid"])
    chosen = dict(zip(fit.cids, map(float, fit.props), strict=True))
    out = Result(o, segments, links, counts, variants.select("cid", "path", "circular", "size", "source"), groups, M.split_merged(fit, members), fit.loglik, fit.criterion(o.criterion), members, chosen, tuple(sorted(chosen)), chosen)
    if o.bootstrap:
        support(spark, out, cells, fit, reads, own, fixed)
        out.props = M.split_merged(M.Fit(list(out.best), list(out.best.values()), 0.0, 0), members)
    if o.mcmc:
        # Candidates of the best solution only; the chains are tasks of one job.
        few = cells.only(sorted(out.best))
        draws = M.chains(spark, few, o.mcmc, o.burn, CHAINS, o.seed)
        out.posterior = dict(zip(few.cids, draws, strict=True))
    if o.output:
        write_results(spark, out, reads)
    return out


def conflicts(spark: SparkSession, o: Options, records: DataFrame, segments: DataFrame, links: DataFrame) -> None:
    """Look for windows in which more reads break off than chance allows. With ``error`` such windows stop the run; with
    ``add`` the jumped-over links are added inside the contigs, and graph and table are written for a new alignment."""
    ends = AL.sort_records(records).select("query_name", "go_r", F.get("path", F.lit(0))["n"].alias("first_n"), F.get("path", F.lit(0))["e"].alias("first_e"), F.element_at("path", -1)["n"].alias("last_n"), F.element_at("path", -1)["e"].alias("last_e"), "p_len", "p_start", "p_end")
    found = G.checkpointed(C.sites(ends, segments))
    total = found.count()
    if not total:
        return
    bins = segments.agg(F.sum(C.window_count(F.col("len")))).first()[0]
    limit = max(o.min_consensus_reads, C.max_load_threshold(spark, bins, total, seed=o.seed))
    loads = C.most_loaded(C.window_loads(found, segments), limit)
    if not loads.limit(1).count():
        return
    edges = G.checkpointed(C.candidate_edges(found, C.breakpoints(found, o.gmm_max_std), limit))
    if o.check_conflicts == "add" and o.output:
        edges.coalesce(1).write.mode("overwrite").option("header", "true").option("sep", "\t").csv(f"{o.output}/conflict_edges.tab")
        segs, new = G.add_inner_edges(segments, links, edges.drop("reads"))
        writers.write_lines(writers.gfa_lines(G.checkpointed(segs), G.checkpointed(new)), f"{o.output}/add_conflicts.gfa")
        raise ValueError(f"alignments conflict with the graph; align again to {o.output}/add_conflicts.gfa")
    raise ValueError(f"alignments conflict with the graph: over {limit} reads break off in one window")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as one of its own: outputs may lie in any store that Spark reaches."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def prepare(spark: SparkSession, o: Options) -> None:
    files, place = filesystem(spark, o.output)
    if o.previous == "terminate" and files.exists(place) and len(files.listStatus(place)):
        raise FileExistsError(f"{o.output} isn't empty; choose resume or overwrite")
    files.mkdirs(place)
    out = files.create(filesystem(spark, f"{o.output}/options.yaml")[1], True)
    try:
        out.write(bytearray("".join(f"{k}: {v!r}\n" for k, v in sorted(asdict(o).items())), "utf-8"))
    finally:
        out.close()


def table(df: DataFrame, path: str) -> None:
    """A small table as one tab-separated file in the folder ``path``."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").option("sep", "\t").csv(path)


def user_variants(spark: SparkSession, o: Options, links: DataFrame) -> DataFrame:
    """path, source, ord of the user's files; paths are rolled to their unit and made canonical, each kept once."""
    out = spark.createDataFrame([], "path array<struct<n:string,e:boolean>>, source string, ord long")
    for path, source in ((o.fixed_variants, "user_fixed"), (o.candidate_variants, "user")):
        if path:
            got = readers.read_user_paths(spark, path).select(P.roll(F.col("path")).alias("path"), "ord").withColumn("cid", F.col("ord"))
            ring = G.circular(got, links).join(got.select("cid", "ord"), "cid")
            out = out.unionByName(ring.select(F.when(F.col("circular"), P.canonical_circular(F.col("path"))).otherwise(P.canonical(F.col("path"))).alias("path"), F.lit(source).alias("source"), "ord"))
    return out


def replicate_fits(spark: SparkSession, out: Result, cells: M.Cells, numbered: DataFrame, described: DataFrame, subs: DataFrame, fixed: frozenset[int], reps: range) -> list[tuple[int, int, float]]:
    """(rep, cid, prop) of replicates ``reps``: each draws as many records as there are, bins the lengths it drew by the
    sub-paths it drew, leaves out cells in which no read can start, and selects its model. All of them in one job; a
    replicate's cells are a row for each bin and sub-path, and each fit is one group."""
    o = out.options
    drawn = RS.bootstrap(numbered.select("idx"), len(reps), o.seed, reps.start).join(numbered, "idx")
    reads = G.checkpointed(drawn.groupBy("rep", "path", "len").agg(F.sum("n").alias("n")))
    own = G.checkpointed(reads.select("rep", "path").distinct().join(described, "path"))
    placed = G.checkpointed(B.placed_lengths(own, reads, ("rep",)))
    rows = B.usable(B.cells(placed, own, reads, ("rep",))).select("rep", P.to_gaf(F.col("path")).alias("pid"), "num_matched", "num_possible_x")
    freq: dict = {}
    for r in subs.select("cid", P.to_gaf(F.col("path")).alias("pid"), "freq").collect():  # as in ``gather``
        freq.setdefault(r["pid"], {})[r["cid"]] = r["freq"]
    cids, sizes, kind, Model = cells.cids, cells.sizes, o.criterion, M.Cells

    def refit(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf[pdf["pid"].isin(freq.keys())].sort_values(["pid", "num_possible_x"])
        f = np.array([[freq[p].get(i, 0) for i in cids] for p in pdf["pid"]], float).reshape(len(pdf), len(cids))
        c = Model(pdf["num_matched"].to_numpy(float), pdf["num_possible_x"].to_numpy(float), f, sizes, cids)
        fit = c.select(kind, fixed) if len(pdf) else None
        if fit is None:
            return pd.DataFrame({"rep": [], "cid": [], "prop": []})
        return pd.DataFrame({"rep": [int(pdf["rep"].iloc[0])] * len(fit.cids), "cid": fit.cids, "prop": fit.props})

    got = rows.groupBy("rep").applyInPandas(refit, "rep int, cid int, prop double")
    return sorted((r["rep"], r["cid"], r["prop"]) for r in got.collect())  # a row for each replicate and variant


def support(spark: SparkSession, out: Result, cells: M.Cells, fit: M.Fit, reads: DataFrame, subs: DataFrame, fixed: frozenset[int]) -> None:
    """Bootstrap until the planned replicates are done, or no solution can reach the wanted support any more; then
    judge the solutions on all data. The best supported one becomes the result."""
    o = out.options
    numbered = G.checkpointed(RS.numbered(reads.select("record_id", "path", "len"), "record_id"))
    held = subs.select("path").distinct().withColumn("cid", F.xxhash64(P.to_gaf(F.col("path"))))
    described = G.checkpointed(B.describe(V.measured(held, out.segments, out.links)))
    step = max(8, spark.sparkContext.defaultParallelism)
    chosen: dict[int, dict[int, float]] = {}
    for start in range(1, o.bootstrap + 1, step):
        for rep, cid, prop in replicate_fits(spark, out, cells, numbered, described, subs, fixed, range(start, min(o.bootstrap + 1, start + step))):
            chosen.setdefault(rep, {})[cid] = prop
        done, out.eligible = RS.last_useful([tuple(sorted(chosen[r])) for r in sorted(chosen)], o.bootstrap, o.bootstrap_threshold)
        if not out.eligible:
            chosen = {r: chosen[r] for r in sorted(chosen)[:done]}
            break
    out.replicates = [(r, c, p) for r in sorted(chosen) for c, p in sorted(chosen[r].items())]
    out.solutions = judged(out, cells, fit, [chosen[r] for r in sorted(chosen)])
    if out.solutions and out.solutions[0].cids != out.raw and out.solutions[0].support > LEAST_SUPPORT:
        out.best = out.solutions[0].props


def judged(out: Result, cells: M.Cells, fit: M.Fit, replicates: list[dict[int, float]]) -> list[Solution]:
    """The solutions of replicates, best supported first (the raw result first among equals). Those of some support are
    fitted again to all data if the bootstrap came to its end; of the others the replicates' means stand."""
    import numpy as np

    seen: dict[int, int] = {}
    for props in replicates:
        for c, _ in sorted(props.items(), key=lambda x: (-x[1], x[0])):
            seen.setdefault(c, len(seen))
    held: dict[tuple[int, ...], list[list[float]]] = {}
    for props in replicates:
        cids = tuple(sorted(props))
        held.setdefault(cids, []).append([props[c] for c in cids])
    order = sorted(held, key=lambda c: (-len(held[c]), c != out.raw, sorted(seen[x] for x in c)))
    made = []
    for i, cids in enumerate(order):
        values = np.array(held[cids])
        s = Solution(cids, len(values) / len(replicates), dict(zip(cids, values.mean(0).tolist(), strict=True)), stds=values.std(0, ddof=1).tolist() if len(values) > 1 else [])
        again = fit if cids == out.raw else cells.fit(list(cids)) if out.eligible and (s.support > LEAST_SUPPORT or not i) else None
        if again is not None:
            s.props, s.loglik, s.criterion = dict(zip(again.cids, map(float, again.props), strict=True)), again.loglik, again.criterion(out.options.criterion)
        made.append(s)
    return made


def final_rows(r: Result, fids: dict[int, int]) -> tuple[list[tuple], list[tuple]]:
    """Rows (solution, support, log-likelihood, criterion, deviations) and (solution, fid, prop) of the final table. A raw
    result that no replicate chose comes last, with support 0."""
    text = lambda x: "*" if x is None else f"{x:.4f}"
    listed = list(r.solutions)
    if not any(s.cids == r.raw for s in listed):
        listed.append(Solution(r.raw, 0.0 if r.solutions else 1.0, r.raw_props, r.loglik, r.criterion))
    width = len(str(len(listed)))
    rows = [(f"{i + 1:0{width}d}", s.support, text(s.loglik), text(s.criterion), ",".join(f"{x:.4f}" for x in s.stds) or ",".join("*" * len(s.cids))) for i, s in enumerate(listed)]
    return rows, [(f"{i + 1:0{width}d}", fids[c], float(p)) for i, s in enumerate(listed) for c, p in s.props.items()]


def write_results(spark: SparkSession, r: Result, reads: DataFrame) -> None:
    """Tables, sequences and the pangenome graph of a result."""
    o = r.options
    order = {c: i + 1 for i, c in enumerate(dict.fromkeys([*[c for s in r.solutions for c in s.cids], *r.raw, *sorted(r.props)]))}
    fids = spark.createDataFrame(list(order.items()), "cid int, fid int")
    table(writers.variant_info(fids, r.variants, r.groups), f"{o.output}/variants.info.tab")
    numbered = G.checkpointed(RS.numbered(r.counts.select("path"), "path").select("path", "idx"))
    longest = r.counts.agg(F.max(F.size("path"))).first()[0]
    measured = V.measured(r.variants, r.segments, r.links)
    subs = V.sub_paths(measured, int(longest) * int(r.segments.agg(F.max("len")).first()[0]), r.counts).join(fids, "cid")
    named = numbered.select(P.to_gaf(F.col("path")).alias("path"), F.col("idx").alias("rp_id"))
    info = writers.readpath_info(r.counts, subs, sorted(order.values())).join(named, "path")
    table(info.select("rp_id", *[c for c in info.columns if c != "rp_id"]).orderBy("rp_id"), f"{o.output}/readpath.information.tab")
    writers.record_ids(numbered, reads).orderBy("rp_id").write.mode("overwrite").option("header", "true").option("sep", "\t").csv(f"{o.output}/readpath.record_ids.tab")
    rows, shares = final_rows(r, order)
    sol = spark.createDataFrame(rows, f"solution string, BOOTSTRAP_SUPPORT double, LOGLIKELIHOOD string, {o.criterion} string, FREQ_STD_OF_BOOTSTRAP string")
    made = writers.result_table(sol, spark.createDataFrame(shares, "solution string, fid int, prop double"), sorted(order.values()))
    table(made.select(F.col("solution").alias("SOLUTIONS"), *[c for c in made.columns if c not in ("solution", "FREQ_STD_OF_BOOTSTRAP")], "FREQ_STD_OF_BOOTSTRAP").orderBy("SOLUTIONS"), f"{o.output}/final.result.tab")
    if r.replicates:
        reps = spark.createDataFrame([(a, order[b], c) for a, b, c in r.replicates], "rep int, fid int, prop double")
        table(writers.replicate_table(reps, sorted(order.values())).orderBy("rep"), f"{o.output}/bootstraps.replicates.tab")
    # A file for each chosen variant with all that can't be told from it.
    listed = sorted((c for c, p in r.best.items() if p >= o.min_output_share), key=lambda c: (order[c], c))
    uid, held = 0, []
    for place, c in enumerate(listed):
        for sub, member in enumerate(sorted(r.members[c])):
            uid += 1
            held.append((member, place, sub, len(r.members[c]), uid, float(r.best[c])))
    if held:
        files = spark.createDataFrame(held, "cid int, place int, sub int, many int, uid int, prop double")
        own = r.variants.join(files.select("cid"), "cid", "left_semi").select("cid", "path", "circular")
        lines = writers.variant_fasta(V.path_sequence(own, r.segments, r.links).join(files, "cid").join(fids, "cid", "left"))
        lines.repartition("file").sortWithinPartitions("file", "sub").select("file", "value").write.mode("overwrite").partitionBy("file").text(f"{o.output}/variants")
    best = spark.createDataFrame([(c, float(p)) for c, p in r.props.items() if p >= o.min_output_share], "cid int, prop double")
    chosen = r.variants.join(best.select("cid"), "cid", "left_semi").select("cid", "path", "circular")
    seqs = V.path_sequence(chosen, r.segments, r.links).join(best, "cid").join(fids, "cid")
    labelled = seqs.select(F.format_string("variant.%d freq=%.4f len=%d", "fid", "prop", F.length("seq")).alias("label"), "seq")
    writers.write_lines(writers.fasta_lines(labelled), f"{o.output}/variants.fasta")
    blocks = G.checkpointed(PG.colinear_blocks(chosen, best, r.segments))
    segs, links = PG.pangenome_graph(blocks, chosen, best, r.segments, r.links)
    segs, links = G.checkpointed(segs), G.checkpointed(links)
    named = PG.renamed(blocks, chosen).groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("vid", F.col("new").alias("n"), "e"))), lambda x: F.struct(x["n"].alias("n"), x["e"].alias("e"))).alias("path"))
    walks = named.join(best, "cid").join(chosen.select("cid", "circular"), "cid").select(F.concat(F.lit("variant"), F.col("cid").cast("string")).alias("label"), "path", "circular", "prop")
    writers.write_lines(writers.gfa_lines(segs, links, walks), f"{o.output}/pangenome.gfa")


def simulate(spark: SparkSession, graph: str, variant_file: str, props: list[float], technology: str = "ont", bases: int = 1_000_000, gaf: str | None = None, fasta: str | None = None, seed: int = 12345) -> DataFrame:
    """Alignment records of simulated reads; written as GAF and FASTA where paths are given."""
    if abs(sum(props) - 1) > 1e-6:
        raise ValueError("proportions must add up to 1")
    segments, links, _ = readers.read_gfa(spark, graph)
    paths = readers.read_user_paths(spark, variant_file).select((F.row_number().over(Window.orderBy("ord")) - 1).alias("cid"), "path")
    variants = V.measured(G.circular(paths, links), segments, links)
    shares = spark.createDataFrame(list(enumerate(map(float, props))), "cid int, prop double")
    mean, std = SI.LENGTHS[technology] if technology in SI.LENGTHS else map(float, technology.split(","))
    reads = G.checkpointed(SI.simulate(spark, variants, shares, SI.read_lengths(spark, mean, std, bases, seed), seed))
    if gaf:
        writers.write_lines(writers.gaf_lines(reads), gaf, "gzip" if gaf.endswith(".gz") else None, one=False)
    if fasta:
        own = reads.select(F.col("record_id").alias("cid"), "path", F.lit(False).alias("circular"), "p_start", "p_align_len", "query_name")
        seqs = V.path_sequence(own, segments, links).join(own, "cid")
        writers.write_lines(writers.fasta_lines(seqs.select(F.col("query_name").alias("label"), F.substring(F.col("seq"), F.col("p_start") + 1, F.col("p_align_len")).alias("seq"))), fasta)
    return reads
