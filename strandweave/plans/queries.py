"""Registered queries: every operator over the adapted tables, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import sequences as S
from ..functions import stats as T
from ..operators import alignments as AL
from ..operators import bins as B
from ..operators import conflicts as C
from ..operators import graph as G
from ..operators import model as M
from ..operators import readpaths as R
from ..operators import resample as RS
from ..operators import search as SE
from ..operators import statistics as ST
from ..operators import variants as V
from ..sources import writers as W
from . import adapters as A
from .sql import canon, gaf, query, rev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

Q = P.to_gaf
LONGEST = 6000
EM_ROUNDS = 3


def register(name: str, oracle: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = query(oracle)
        return f

    return keep


class Parts:
    """What the queries on variants and models share within one call; each part is computed once and cut in the
    checkpoint folder when it is first asked for."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    @cached_property
    def reads(self) -> DataFrame:
        return G.checkpointed(A.reads(self.spark, self.d))

    @cached_property
    def links(self) -> DataFrame:
        return G.checkpointed(A.links_of(self.reads))

    @cached_property
    def contigs(self) -> DataFrame:
        return G.checkpointed(A.contigs(self.spark, self.d))

    @cached_property
    def paths(self) -> DataFrame:
        return G.checkpointed(R.count_paths(self.reads))

    @cached_property
    def supported(self) -> DataFrame:
        return G.checkpointed(R.supported(self.paths, 3))

    @cached_property
    def ringed(self) -> DataFrame:
        return G.circular(A.variants(self.spark, self.d), self.links)

    @cached_property
    def measured(self) -> DataFrame:
        return G.checkpointed(V.measured(self.ringed, self.contigs, self.links))

    @cached_property
    def sizes(self) -> DataFrame:
        return V.sizes(self.measured)

    @cached_property
    def every_sub(self) -> DataFrame:
        """All runs of variants that an alignment can span."""
        return G.checkpointed(V.sub_paths(self.measured, LONGEST))

    @cached_property
    def subs(self) -> DataFrame:
        """Those that are supported read paths."""
        return G.checkpointed(V.sub_paths(self.measured, LONGEST, self.supported))

    @cached_property
    def described(self) -> DataFrame:
        """Ranges of the observed sub-paths of all variants."""
        held = self.subs.select("path").distinct().withColumn("cid", F.xxhash64(Q(F.col("path"))))
        return G.checkpointed(B.describe(V.measured(held, self.contigs, self.links)))

    @cached_property
    def lengths(self) -> DataFrame:
        return self.reads.select(P.canonical(F.col("path")).alias("path"), (F.col("len") / 4).cast("int").alias("len"), F.lit(1).cast("long").alias("n"))

    @cached_property
    def cells(self) -> DataFrame:
        return B.cells(G.checkpointed(B.placed_lengths(self.described, self.lengths)), self.described, self.lengths)

    @cached_property
    def likelihood(self) -> DataFrame:
        props = self.sizes.select("cid", F.lit(1 / 25).alias("prop"))
        return M.log_likelihood(B.usable(self.cells), self.subs, self.sizes, props)

    @cached_property
    def model_cells(self) -> M.Cells:
        alone = V.unidentifiable(self.subs, self.sizes).filter("cid = representative").select("cid")
        sized = G.checkpointed(self.sizes.join(alone, "cid"))
        return M.gather(B.usable(self.cells), self.subs.join(sized.select("cid"), "cid"), sized)


# --- read paths ---


@register("read_paths_supported", f"SELECT {gaf('p')} AS path, n, support FROM sup")
def read_paths_supported(spark, d):
    return R.supported(R.count_paths(A.reads(spark, d)), 3).select(Q(F.col("path")).alias("path"), "n", "support")


@register("read_path_counts", f"SELECT {gaf('p')} AS path, n FROM pc")
def read_path_counts(spark, d):
    return R.count_paths(A.reads(spark, d)).select(Q(F.col("path")).alias("path"), "n")


@register("read_path_records", f"SELECT {gaf('p')} AS path, array_to_string(list(read ORDER BY read), ',') AS record_ids, count(*) AS n FROM cp GROUP BY p")
def read_path_records(spark, d):
    got = R.with_records(A.reads(spark, d).withColumnRenamed("read", "record_id"))
    return got.select(Q(F.col("path")).alias("path"), F.array_join("record_ids", ",").alias("record_ids"), "n")


@register("longest_read_path", "SELECT max(len(p))::INT AS steps FROM pc")
def longest_read_path(spark, d):
    return R.longest(R.count_paths(A.reads(spark, d)))


@register("contig_coverage_from_paths", "SELECT s.n AS name, sum(c) + 1e-8 AS cov FROM (SELECT unnest(p) AS s, n AS c FROM pc) GROUP BY 1")
def contig_coverage_from_paths(spark, d):
    return R.coverage(R.count_paths(A.reads(spark, d)))


@register("contig_coverage_from_graph", "SELECT name, greatest(cov, 1e-8) AS cov FROM sg")
def contig_coverage_from_graph(spark, d):
    return A.contigs(spark, d).select("name", F.greatest("cov", F.lit(1e-8)).alias("cov"))


@register(
    "read_start_index",
    f"""WITH b AS (SELECT p, n FROM sup UNION SELECT {rev('p')}, n FROM sup),
    h AS (SELECT p[1:k] AS sub, p, n FROM b, unnest(range(1, len(p))) AS r(k))
    SELECT {gaf('sub')} AS sub, count(*) AS n_paths, sum(n)::BIGINT AS n_reads FROM h GROUP BY sub""",
)
def read_start_index(spark, d):
    got = R.start_index(R.supported(R.count_paths(A.reads(spark, d)), 3).select("path", "n"))
    return got.groupBy("sub").agg(F.count("*").alias("n_paths"), F.sum("n").alias("n_reads")).select(Q(F.col("sub")).alias("sub"), "n_paths", "n_reads")


@register(
    "read_middle_index",
    f"""WITH b AS (SELECT p, n FROM sup WHERE len(p) > 2 UNION SELECT {rev('p')}, n FROM sup WHERE len(p) > 2),
    h AS (SELECT DISTINCT p[i : i + k - 1] AS sub, p, n FROM b, unnest(range(2, len(p))) AS r(i), unnest(range(1, len(p) - 1)) AS q(k) WHERE i + k - 1 < len(p))
    SELECT {gaf('sub')} AS sub, count(*) AS n_paths, sum(n)::BIGINT AS n_reads FROM h GROUP BY sub""",
)
def read_middle_index(spark, d):
    got = R.middle_index(R.supported(R.count_paths(A.reads(spark, d)), 3).select("path", "n"))
    return got.groupBy("sub").agg(F.count("*").alias("n_paths"), F.sum("n").alias("n_reads")).select(Q(F.col("sub")).alias("sub"), "n_paths", "n_reads")


# --- alignments ---


def records(spark, d) -> DataFrame:
    """A line as an alignment record with query positions."""
    w = Window.partitionBy("read").orderBy("k")
    ends = F.sum(F.col("len") + F.col("gap")).over(w)
    return A.lines(spark, d).select(
        F.col("read").alias("query_name"), (F.col("k") - 1).cast("long").alias("record_id"), F.col("k"), F.col("len").alias("p_align_len"), F.col("ident").alias("identity"),
        (ends - F.col("len") - F.col("gap")).cast("int").alias("q_start"), (ends - F.col("gap")).cast("int").alias("q_end"), "n", "e", "row",
    )


@register("read_identity_filter", "SELECT read AS query, sum(len)::BIGINT AS align_len, round(sum(len * ident) / sum(len), 9) AS identity FROM rec GROUP BY read HAVING sum(len) >= 5000 AND sum(len * ident) / sum(len) >= 0.995")
def read_identity_filter(spark, d):
    got = AL.by_read(records(spark, d), "row").filter("p_align_len >= 5000 and p_identity >= 0.995")
    # DuckDB rounds the multiple, Spark the decimal digits; they differ where the product falls on a half.
    return got.select(F.col("query_name").alias("query"), "p_align_len", (F.round(F.col("p_identity") * 1e9) / 1e9).alias("identity")).withColumnRenamed("p_align_len", "align_len")


@register("record_identity_filter", "SELECT read AS query, k, ident AS identity FROM rec WHERE ident >= 0.994")
def record_identity_filter(spark, d):
    return records(spark, d).filter("identity >= 0.994").select(F.col("query_name").alias("query"), F.col("k").cast("long").alias("k"), "identity")


@register("record_order", "SELECT read AS query, k, row_number() OVER (PARTITION BY read ORDER BY q_start, q_end, k) - 1 AS go_r FROM rec")
def record_order(spark, d):
    return AL.sort_records(records(spark, d)).select(F.col("query_name").alias("query"), F.col("k").cast("long").alias("k"), F.col("go_r").cast("long").alias("go_r"))


@register("record_gaps", "WITH x AS (SELECT read AS query, k, lead(q_start) OVER (PARTITION BY read ORDER BY q_start, q_end, k) - q_end AS g FROM rec) SELECT query, k, g AS gap FROM x WHERE g IS NOT NULL")
def record_gaps(spark, d):
    return AL.with_gaps(records(spark, d)).filter("gap is not null").select(F.col("query_name").alias("query"), F.col("k").cast("long").alias("k"), "gap")


@register("read_blocks")
def read_blocks(spark, d):
    got = AL.find_blocks(records(spark, d), 5000, 0.995)
    return got.select(F.col("query_name").alias("query"), F.col("block").cast("long").alias("block"), "len", F.round("ident", 9).alias("ident"), F.array_join(F.transform("records", lambda r: r.cast("string")), ",").alias("records"))


ORACLE["read_blocks"] = query(
    """WITH RECURSIVE o AS (
  SELECT read, len, ident, row_number() OVER w - 1 AS go_r, lead(q_start) OVER w - q_end AS gap FROM rec WINDOW w AS (PARTITION BY read ORDER BY q_start, q_end, k)
), el AS (
  SELECT read, go_r * 2 AS i, (len + least(coalesce(gap, 0), 0))::DOUBLE AS l, ident::DOUBLE AS d, go_r AS r FROM o
  UNION ALL SELECT read, go_r * 2 + 1, gap::DOUBLE, 0.0, NULL FROM o WHERE gap > 0
), nb AS (SELECT read, l, d, r, row_number() OVER (PARTITION BY read ORDER BY i) AS j FROM el
), f AS (
  SELECT read, j, l, d, r, 1 AS b, l AS bl, l * d AS bs FROM nb WHERE j = 1
  UNION ALL
  SELECT nb.read, nb.j, nb.l, nb.d, nb.r,
    CASE WHEN f.bl = 0 OR f.bs + nb.d * nb.l >= 0.995 * (f.bl + nb.l) THEN f.b ELSE f.b + 1 END,
    CASE WHEN f.bl = 0 OR f.bs + nb.d * nb.l >= 0.995 * (f.bl + nb.l) THEN f.bl ELSE 0 END + nb.l,
    CASE WHEN f.bl = 0 OR f.bs + nb.d * nb.l >= 0.995 * (f.bl + nb.l) THEN f.bs ELSE 0 END + nb.d * nb.l
  FROM f JOIN nb ON nb.read = f.read AND nb.j = f.j + 1
), g AS (SELECT *, sum(l) OVER q AS tl, sum(l * d) OVER q AS ts, min(CASE WHEN l >= 10 THEN j END) OVER q AS a, max(CASE WHEN l >= 10 THEN j END) OVER q AS z FROM f WINDOW q AS (PARTITION BY read, b)
), kept AS (SELECT read, b, sum(l) AS len, sum(l * d) / sum(l) AS ident, array_to_string(list(r ORDER BY j) FILTER (r IS NOT NULL), ',') AS records
  FROM g WHERE tl >= 5000 AND ts >= 0.995 AND j BETWEEN a AND z GROUP BY read, b)
SELECT read AS query, row_number() OVER (PARTITION BY read ORDER BY b) AS block, len::BIGINT AS len, round(ident, 9) AS ident, coalesce(records, '') AS records FROM kept"""
)


@register(
    "auto_min_identity",
    """WITH rd AS (SELECT read, sum(len)::BIGINT AS l, sum(len * ident) / sum(len) AS i FROM rec GROUP BY read),
    gr AS (SELECT i * 0.0005::DOUBLE AS id_adj, j * 500 AS ln_adj FROM range(88) a(i), range(4) b(j)),
    s AS (SELECT id_adj, ln_adj, sum(CASE WHEN l > 5000.0 + ln_adj AND rd.i > 0.95::DOUBLE + id_adj THEN l ELSE 0 END)::BIGINT AS total FROM gr, rd GROUP BY ALL)
    SELECT id_adj, ln_adj, abs(total - 20000000.0::DOUBLE) AS diff, total FROM s ORDER BY diff, id_adj, ln_adj LIMIT 1""",
)
def auto_min_identity(spark, d):
    return AL.auto_identity(AL.by_read(records(spark, d), "row"), 2e7, ln_end=2000).withColumn("ln_adj", F.col("ln_adj").cast("long"))


@register(
    "auto_min_counts",
    """SELECT greatest(3, ceil(b / (g * (-ln(1 - i) * (3 + m / 16000))) + 1))::BIGINT AS min_counts FROM
    (SELECT avg(len) AS m, sum(ident * len) / sum(len) AS i, sum(len) AS b FROM rec), (SELECT sum(len) AS g FROM sg)""",
)
def auto_min_counts(spark, d):
    return AL.auto_counts(records(spark, d), A.contigs(spark, d).agg(F.sum("len").alias("graph_len")))


# --- graph ---


@register("half_edges", "SELECT v1, e1, v2, e2, overlap, support FROM he")
def half_edges(spark, d):
    return A.contig_links(spark, d)


@register("symmetric_links", "SELECT v1, e1, v2, e2, max(overlap) AS overlap FROM (SELECT v1, e1, v2, e2, overlap FROM he WHERE v1 <= v2 UNION ALL SELECT v2, e2, v1, e1, overlap FROM he WHERE v1 <= v2) GROUP BY ALL")
def symmetric_links(spark, d):
    return G.symmetric(A.contig_links(spark, d).filter("v1 <= v2").select("v1", "e1", "v2", "e2", "overlap"))


@register("connected_components", "SELECT name, component FROM comp")
def connected_components(spark, d):
    return G.connected_components(A.supplier_contigs(spark, d), A.supplier_links(spark, d))


def weights(spark, d):
    s = A.supplier_contigs(spark, d)
    return G.component_weights(s, G.connected_components(s, A.supplier_links(spark, d)))


@register("component_weights", "SELECT component, round(weight, 4) AS weight FROM cw")
def component_weights(spark, d):
    return weights(spark, d).select("component", F.round("weight", 4).alias("weight"))


@register("component_top3", "SELECT component, round(weight, 4) AS weight, place FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, component) - 1 AS place FROM cw) WHERE place < 3")
def component_top3(spark, d):
    return G.top_components(weights(spark, d), 0, 3).select("component", F.round("weight", 4).alias("weight"), F.col("place").cast("long").alias("place"))


@register("component_cutoff_max", "SELECT component, round(weight, 4) AS weight FROM cw WHERE weight >= 0.01 * (SELECT max(weight) FROM cw)")
def component_cutoff_max(spark, d):
    return G.components_to_max(weights(spark, d), 0.01).select("component", F.round("weight", 4).alias("weight"))


@register(
    "component_cutoff_total",
    """SELECT component, round(weight, 4) AS weight FROM (SELECT *, coalesce(sum(weight) OVER (ORDER BY weight DESC, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
    sum(weight) OVER () AS total FROM cw) WHERE ahead < 0.99 * total OR ahead = 0""",
)
def component_cutoff_total(spark, d):
    return G.components_to_total(weights(spark, d), 0.99).select("component", F.round("weight", 4).alias("weight"))


@register("average_depth", "SELECT round(sum(cov * len) / sum(len), 9) AS depth FROM ss")
def average_depth(spark, d):
    return G.average_depth(A.supplier_contigs(spark, d)).select(F.round("depth", 9).alias("depth"))


@register("purge_by_depth", "SELECT name FROM ss WHERE cov >= 0.97 * (SELECT sum(cov * len) / sum(len) FROM ss)")
def purge_by_depth(spark, d):
    return G.purge_by_depth(A.supplier_contigs(spark, d), 0.97).select("name")


TERMINAL_ROUNDS = 12


def _terminal_sql() -> str:
    parts, now = [], "t0"
    parts.append("t0 AS (SELECT name FROM ss)")
    for i in range(1, TERMINAL_ROUNDS + 1):
        parts.append(
            f"t{i} AS (SELECT a.name FROM t{i - 1} a JOIN (SELECT v1, count(DISTINCT e1) AS n FROM hs WHERE v1 IN (SELECT name FROM t{i - 1}) AND v2 IN (SELECT name FROM t{i - 1}) GROUP BY v1) x ON a.name = x.v1 WHERE x.n = 2)"
        )
    return "WITH " + ", ".join(parts) + f" SELECT name FROM t{TERMINAL_ROUNDS}"


@register("prune_terminal", _terminal_sql())
def prune_terminal(spark, d):
    return G.prune_terminal(A.supplier_contigs(spark, d), A.supplier_links(spark, d))[0].select("name")


@register("prune_unaligned", "SELECT name FROM sg WHERE name IN (SELECT s.n FROM (SELECT unnest(p) AS s FROM sup WHERE n >= 100))")
def prune_unaligned(spark, d):
    return G.prune_unaligned(A.contigs(spark, d), R.supported(R.count_paths(A.reads(spark, d)), 3).filter("n >= 100")).select("name")


@register("remove_vertices", "SELECT v1, e1, v2, e2 FROM he WHERE v1 NOT IN (SELECT name FROM sg WHERE len > 2000) AND v2 NOT IN (SELECT name FROM sg WHERE len > 2000)")
def remove_vertices(spark, d):
    s = A.contigs(spark, d)
    return G.remove_vertices(s, A.contig_links(spark, d), s.filter("len > 2000"))[1].select("v1", "e1", "v2", "e2")


@register(
    "path_in_graph",
    f"""WITH l AS (SELECT p, p[i].n AS a, p[i].e AS b, p[i + 1].n AS c, NOT p[i + 1].e AS x FROM pc, unnest(range(1, len(p))) AS r(i)),
    bad AS (SELECT DISTINCT l.p FROM l ANTI JOIN he ON l.a = he.v1 AND l.b = he.e1 AND l.c = he.v2 AND l.x = he.e2)
    SELECT {gaf('pc.p')} AS path, bad.p IS NULL AS ok FROM pc LEFT JOIN bad ON pc.p = bad.p""",
)
def path_in_graph(spark, d):
    x = Parts(spark, d)
    pc = x.paths.withColumn("pid", Q(F.col("path")))
    return G.paths_in_graph(pc.select("pid", "path"), x.contigs, x.links).select(F.col("pid").alias("path"), "ok")


CIRC = "SELECT cid, p, EXISTS (SELECT 1 FROM he WHERE v1 = p[len(p)].n AND e1 = p[len(p)].e AND v2 = p[1].n AND e2 = (NOT p[1].e)) AS circular FROM va"


@register("circular_paths", f"SELECT cid, {gaf('p')} AS path, circular FROM ({CIRC})")
def circular_paths(spark, d):
    return G.circular(A.variants(spark, d), A.contig_links(spark, d)).select("cid", Q(F.col("path")).alias("path"), "circular")


@register("fully_covered", "SELECT cid, len(list_distinct(list_transform(p, lambda x: x.n))) = (SELECT count(*) FROM sg) AS \"full\" FROM va")
def fully_covered(spark, d):
    return G.fully_covered(A.variants(spark, d), A.contigs(spark, d))


@register("branching_ends", "SELECT v1 AS name, e1 AS e, count(*) AS n FROM hs GROUP BY ALL HAVING count(*) >= 2")
def branching_ends(spark, d):
    return G.branching_ends(A.supplier_links(spark, d))


@register("single_copy_vertices", "SELECT name FROM ss WHERE name NOT IN (SELECT v1 FROM hs GROUP BY v1, e1 HAVING count(*) >= 2)")
def single_copy_vertices(spark, d):
    return G.single_copy(A.supplier_contigs(spark, d), A.supplier_links(spark, d))


@register("self_loops", "SELECT v1 AS name FROM he WHERE v1 = v2 AND e1 AND NOT e2")
def self_loops(spark, d):
    return G.self_loops(A.contig_links(spark, d))


@register(
    "parallel_vertices",
    """WITH t AS (SELECT v1 AS name, list({'n': v2, 'e': e2} ORDER BY v2, e2) AS x FROM hs WHERE e1 GROUP BY v1),
    h AS (SELECT v1 AS name, list({'n': v2, 'e': e2} ORDER BY v2, e2) AS x FROM hs WHERE NOT e1 GROUP BY v1),
    z AS (SELECT ss.name, coalesce(t.x, []) AS a, coalesce(h.x, []) AS b FROM ss LEFT JOIN t ON ss.name = t.name LEFT JOIN h ON ss.name = h.name)
    SELECT array_to_string(list(name ORDER BY name), ',') AS members FROM z GROUP BY CASE WHEN a <= b THEN a ELSE b END, CASE WHEN a <= b THEN b ELSE a END HAVING count(*) > 1""",
)
def parallel_vertices(spark, d):
    return G.parallel_vertices(A.supplier_contigs(spark, d), A.supplier_links(spark, d)).select(F.array_join("members", ",").alias("members"))


@register(
    "palindromic_repeats",
    """WITH t AS (SELECT v1 AS name, list({'n': v2, 'e': e2} ORDER BY v2, e2) AS x FROM he WHERE e1 GROUP BY v1),
    h AS (SELECT v1 AS name, list({'n': v2, 'e': e2} ORDER BY v2, e2) AS x FROM he WHERE NOT e1 GROUP BY v1)
    SELECT sg.name FROM sg LEFT JOIN t ON sg.name = t.name LEFT JOIN h ON sg.name = h.name
    WHERE seq = reverse(translate(seq, 'ACGT', 'TGCA')) AND (coalesce(t.x, []) = coalesce(h.x, []) OR sg.name IN (SELECT v1 FROM he WHERE v1 = v2 AND e1 = e2))""",
)
def palindromic_repeats(spark, d):
    return G.palindromic_repeats(A.contigs(spark, d), A.contig_links(spark, d))


@register("trim_overlaps", "SELECT name, len - 55 AS len, substr(seq, 28, len - 55) AS seq FROM sg")
def trim_overlaps(spark, d):
    return G.trim_overlaps(A.contigs(spark, d), A.contig_links(spark, d), 55)[0].select("name", "len", "seq")


@register("rename_vertices", "WITH m AS (SELECT name, row_number() OVER (ORDER BY name)::VARCHAR AS new FROM ss) SELECT a.new AS v1, e1, b.new AS v2, e2 FROM hs JOIN m a ON v1 = a.name JOIN m b ON v2 = b.name")
def rename_vertices(spark, d):
    s = A.supplier_contigs(spark, d)
    return G.rename(s, A.supplier_links(spark, d).select("v1", "e1", "v2", "e2", "overlap"), G.numbered(s))[1].select("v1", "e1", "v2", "e2")


@register(
    "duplicate_vertices",
    """WITH g AS (SELECT name, k AS copy FROM sg, range(3) r(k) WHERE len <= 1500),
    j AS (SELECT he.*, a.copy AS ca, b.copy AS cb FROM he LEFT JOIN g a ON v1 = a.name LEFT JOIN g b ON v2 = b.name WHERE a.copy IS NULL OR b.copy IS NULL OR a.copy = b.copy)
    SELECT v1 || CASE WHEN coalesce(ca, 0) > 0 THEN '__copy' || ca ELSE '' END AS v1, e1, v2 || CASE WHEN coalesce(cb, 0) > 0 THEN '__copy' || cb ELSE '' END AS v2, e2 FROM j""",
)
def duplicate_vertices(spark, d):
    s = A.contigs(spark, d)
    groups = s.filter("len <= 1500").select("name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("copy"), F.lit(1 / 3).alias("factor"))
    return G.duplicate(s, A.contig_links(spark, d).select("v1", "e1", "v2", "e2", "overlap"), groups)[1].select("v1", "e1", "v2", "e2")


@register(
    "break_contigs",
    """WITH b AS (SELECT name, pos FROM sg, (VALUES (400), (900), (1800)) v(pos) WHERE pos < len),
    e AS (SELECT name, pos FROM b UNION SELECT name, len FROM sg WHERE name IN (SELECT name FROM b)),
    p AS (SELECT name, pos, coalesce(lag(pos) OVER w, 0) AS f, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY name ORDER BY pos))
    SELECT p.name || '_' || k AS name, (pos - f)::INT AS len, substr(seq, f + 1, pos - f) AS seq FROM p JOIN sg ON p.name = sg.name
    UNION ALL SELECT name, len, seq FROM sg WHERE name NOT IN (SELECT name FROM b)""",
)
def break_contigs(spark, d):
    s = A.contigs(spark, d)
    breaks = s.select("name", F.explode(F.array(F.lit(400), F.lit(900), F.lit(1800))).alias("pos"))
    return G.break_contigs(s, A.contig_links(spark, d), breaks)[0].select("name", "len", "seq")


@register("merge_unbranched")
def merge_unbranched(spark, d):
    s, links = A.supplier_contigs(spark, d), A.supplier_links(spark, d).select("v1", "e1", "v2", "e2", "overlap")
    return G.merge_unbranched(s, links)[0].select("name", "len", F.round("cov", 6).alias("cov"), F.length("seq").alias("seq_len"))


@register(
    "subgraph_around",
    """WITH RECURSIVE q(name, quota) AS (
      SELECT name, 2500.0::DOUBLE FROM ss WHERE name IN (SELECT min(name) FROM ss)
      UNION SELECT hs.v2, q.quota - ss.len + hs.overlap FROM q JOIN hs ON q.name = hs.v1 JOIN ss ON ss.name = hs.v2 WHERE q.quota - ss.len + hs.overlap > 0)
    SELECT name, max(quota) AS quota FROM q GROUP BY name""",
)
def subgraph_around(spark, d):
    s = A.supplier_contigs(spark, d)
    return G.subgraph_around(s, A.supplier_links(spark, d), s.agg(F.min("name").alias("name")), 2500)


# --- paths and sequences ---


@register("gaf_roundtrip", f"SELECT {gaf('p')} AS path, {gaf('p')} AS again FROM pc")
def gaf_roundtrip(spark, d):
    p = R.count_paths(A.reads(spark, d)).select(Q(F.col("path")).alias("path"))
    return p.select("path", Q(P.parse_gaf(F.col("path"))).alias("again"))


def bandage_sql(p: str) -> str:
    return f"array_to_string(list_transform({p}, lambda x: x.n || CASE WHEN x.e THEN '+' ELSE '-' END), ',')"


@register("bandage_repr", f"SELECT cid, {bandage_sql('p')} || CASE WHEN circular THEN '(circular)' ELSE '' END AS repr, {gaf('p')} AS again FROM ({CIRC})")
def bandage_repr(spark, d):
    v = G.circular(A.variants(spark, d), A.contig_links(spark, d)).select("cid", P.to_bandage(F.col("path"), F.col("circular")).alias("repr"))
    return v.select("cid", "repr", Q(P.parse_bandage(F.col("repr"))).alias("again"))


def rot_min(p: str) -> str:
    both = [f"list_transform(range(1, len({x}) + 1), lambda i: list_concat({x}[i:], {x}[1 : i - 1]))" for x in (p, "rp")]
    return f"list_min(list_concat({both[0]}, {both[1]}))"


@register("canonical_circular", f"SELECT cid, {gaf('c')} AS path FROM (SELECT cid, {rot_min('p')} AS c FROM (SELECT cid, p, {rev('p')} AS rp FROM va))")
def canonical_circular(spark, d):
    return A.variants(spark, d).select("cid", Q(P.canonical_circular(F.col("path"))).alias("path"))


@register("canonical_strand", f"SELECT cid, p <= {rev('p')} AS strand FROM va")
def canonical_strand(spark, d):
    return A.variants(spark, d).select("cid", P.canonical_strand(F.col("path"), F.lit(False)).alias("strand"))


@register("canonical_variant", f"SELECT cid % 5 AS grp, array_to_string(list({gaf('c')} ORDER BY c), ';') AS parts FROM (SELECT cid, {rot_min('p')} AS c FROM (SELECT cid, p, {rev('p')} AS rp FROM va)) GROUP BY cid % 5")
def canonical_variant(spark, d):
    v = A.variants(spark, d).groupBy((F.col("cid") % 5).alias("grp")).agg(F.collect_list("path").alias("parts"))
    return v.select("grp", F.array_join(F.transform(P.canonical_variant(F.col("parts")), Q), ";").alias("parts"))


@register("palindrome_corrected", f"SELECT cid, {gaf('c')} AS path FROM (SELECT cid, list_transform(p, lambda x: {{'n': x.n, 'e': x.e OR x.n IN ('c1', 'c3')}}) AS c FROM va)")
def palindrome_corrected(spark, d):
    return A.variants(spark, d).select("cid", Q(P.fix_palindromes(F.col("path"), F.array(F.lit("c1"), F.lit("c3")))).alias("path"))


@register("reverse_paths", f"SELECT cid, {gaf(rev('p'))} AS path FROM va")
def reverse_paths(spark, d):
    return A.variants(spark, d).select("cid", Q(P.reverse_path(F.col("path"))).alias("path"))


@register(
    "roll_paths",
    f"""WITH u AS (SELECT {gaf('p')} AS path, p FROM pc UNION ALL SELECT {gaf('list_concat(p, p)')}, list_concat(p, p) FROM pc WHERE n >= 20),
    k AS (SELECT path, p, (SELECT min(d) FROM range(1, len(p) + 1) r(d) WHERE p[d + 1 :] = p[1 : len(p) - d]) AS d FROM u)
    SELECT path, {gaf('p[1 : d]')} AS unit FROM k""",
)
def roll_paths(spark, d):
    pc = R.count_paths(A.reads(spark, d))
    both = pc.select("path").union(pc.filter("n >= 20").select(F.concat("path", "path")))
    return both.select(F.col("path").alias("p")).select(Q(F.col("p")).alias("path"), Q(P.roll(F.col("p"))).alias("unit"))


@register("reverse_complement", "SELECT name, reverse(translate(seq, 'ATGCRMYKHBDVatgcrmykhbdv', 'TACGYKRMDVHBtacgykrmdvhb')) AS rc FROM ss")
def reverse_complement(spark, d):
    return A.supplier_contigs(spark, d).select("name", S.reverse_complement(F.col("seq")).alias("rc"))


@register("iupac_expand", "SELECT p_partkey AS id, CASE upper(substr(p_name, 1, 1)) WHEN 'A' THEN 'A' WHEN 'C' THEN 'C' WHEN 'G' THEN 'G' WHEN 'T' THEN 'T' WHEN 'R' THEN 'AG' WHEN 'Y' THEN 'CT' WHEN 'M' THEN 'AC' WHEN 'K' THEN 'GT' WHEN 'S' THEN 'CG' WHEN 'W' THEN 'AT' WHEN 'H' THEN 'ACT' WHEN 'B' THEN 'CGT' WHEN 'V' THEN 'ACG' WHEN 'D' THEN 'AGT' WHEN 'N' THEN 'ACGT' END AS bases FROM part")
def iupac_expand(spark, d):
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.bases_of(F.substring("p_name", 1, 1)).alias("bases"))


@register(
    "cigar_ops",
    """WITH c AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity::INT || '=' || l_suppkey || 'X' || l_linenumber || 'D' AS cg FROM lineitem)
    SELECT o, n, p, s, cg, array_to_string(regexp_extract_all(cg, '([0-9]+)([MIDNSHPX=])', 2), '') AS ops, list_sum(list_transform(regexp_extract_all(cg, '([0-9]+)([MIDNSHPX=])', 1), lambda x: x::BIGINT))::BIGINT AS bases FROM c""",
)
def cigar_ops(spark, d):
    li = A.table(spark, d, "lineitem")
    cg = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("="), F.col("l_suppkey").cast("string"), F.lit("X"), F.col("l_linenumber").cast("string"), F.lit("D"))
    c = li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), cg.alias("cg")).withColumn("x", S.cigar_ops(F.col("cg")))
    return c.select("o", "n", "p", "s", "cg", F.array_join(F.transform("x", lambda v: v["op"]), "").alias("ops"), F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v["len"]).alias("bases"))


ORF = """WITH fr AS (SELECT name, f, list_transform(range(f + 1, length(seq) + 1, 3), lambda i: substr(seq, i, 3)) AS c FROM ss, range(3) r(f)),
  cd AS (SELECT name, f, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS i FROM fr),
  st AS (SELECT name, f, x, i, x IN ('TAA', 'TAG', 'TGA') AS stop, x IN ('ATG', 'ATC', 'ATA', 'ATT', 'GTG', 'TTG') AS start FROM cd),
  sg2 AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY name, f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM st),
  o AS (SELECT name, f, g, min(CASE WHEN start THEN i END) AS a, max(i) AS z, bool_or(stop) AS closed, max(CASE WHEN stop THEN i END) AS e FROM sg2 GROUP BY name, f, g),
  l AS (SELECT name, f, g, CASE WHEN closed THEN (e - a) * 3 ELSE (z - a + 1) * 3 END AS n, closed FROM o WHERE a IS NOT NULL),
  k AS (SELECT name, f, list(n::INT ORDER BY g) AS ns, sum(n) AS t FROM l WHERE NOT closed OR n >= 200 GROUP BY name, f),
  w AS (SELECT ss.name, f, coalesce(ns, []) AS ns, coalesce(t, 0) AS t FROM ss CROSS JOIN range(3) r(f) LEFT JOIN k USING (name, f))
  SELECT name, array_to_string(arg_min(ns, {'t': -t, 'f': f}), ',') AS orfs FROM w GROUP BY name"""


@register("orf_lengths", ORF)
def orf_lengths(spark, d):
    return A.supplier_contigs(spark, d).select("name", F.array_join(S.orf_lengths(F.col("seq")).cast("array<string>"), ",").alias("orfs"))


@register("fastg_names", "SELECT 'EDGE_' || name || '_length_' || len || '_cov_' || round(cov, 1)::VARCHAR AS label FROM sg")
def fastg_names(spark, d):
    s = A.contigs(spark, d)
    return s.select(S.fastg_name(F.col("name"), F.col("len"), F.round("cov", 1)).alias("label"))


@register("merge_history", f"SELECT cid, array_to_string(list_transform(p, lambda x: x.n), '_') AS history, {gaf(rev('p'))} AS backward, array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.n))), ',') AS names FROM va")
def merge_history(spark, d):
    p = F.col("path")
    return A.variants(spark, d).select("cid", P.history_text(p).alias("history"), Q(P.history_negate(p)).alias("backward"), F.array_join(P.history_names(p), ",").alias("names"))


LENS = """lens AS (SELECT x.k, x.i, x.n, sg.len, coalesce(he.overlap, 0) AS ov FROM (
    SELECT k, p, len(p) AS n, i, p[i].n AS a, p[i].e AS b, p[i % len(p) + 1].n AS c, NOT p[i % len(p) + 1].e AS f FROM src, unnest(range(1, len(p) + 1)) AS r(i)) x
  JOIN sg ON x.a = sg.name LEFT JOIN he ON he.v1 = x.a AND he.e1 = x.b AND he.v2 = x.c AND he.e2 = x.f),
  meas AS (SELECT k, n, (sum(len) - sum(CASE WHEN i < n THEN ov ELSE 0 END))::BIGINT AS full_len,
    CASE WHEN n < 3 THEN 0 ELSE greatest(sum(CASE WHEN i > 1 AND i < n THEN len ELSE 0 END) - sum(CASE WHEN i > 1 AND i < n - 1 THEN ov ELSE 0 END), 0) END::BIGINT AS inner_len,
    sum(CASE WHEN i = n THEN ov ELSE 0 END)::BIGINT AS closing,
    sum(CASE WHEN i = 1 THEN len - ov ELSE 0 END)::BIGINT AS left_free, (sum(CASE WHEN i = n THEN len ELSE 0 END) - sum(CASE WHEN i = n - 1 THEN ov ELSE 0 END))::BIGINT AS right_free FROM lens GROUP BY k, n)"""


@register("path_lengths", f"WITH src AS (SELECT p AS k, p FROM pc), {LENS} SELECT {gaf('k')} AS path, full_len, inner_len FROM meas")
def path_lengths(spark, d):
    x = Parts(spark, d)
    m = V.measured(x.paths.withColumn("cid", F.xxhash64(Q(F.col("path")))), x.contigs, x.links)
    return m.select(Q(F.col("path")).alias("path"), V.full_length().alias("full_len"), V.inner_length().alias("inner_len"))


SEQS = f"""WITH src AS (SELECT cid AS k, p FROM va), {LENS}, ci AS ({CIRC}),
  pc2 AS (SELECT k, i, CASE WHEN ci.p[i].e THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END AS s, lens.len AS ln, ov, n, ci.circular AS c FROM lens JOIN ci ON ci.cid = k JOIN sg ON sg.name = ci.p[i].n)
  SELECT k AS cid, string_agg(substr(s, 1, ln - CASE WHEN i = n AND NOT c THEN 0 ELSE ov END), '' ORDER BY i) AS seq FROM pc2 GROUP BY k"""


@register("path_sequences", SEQS)
def path_sequences(spark, d):
    x = Parts(spark, d)
    return V.path_sequence(x.ringed, x.contigs, x.links)


# --- variants ---


MEASURED = f"""src AS (SELECT cid AS k, p FROM va), {LENS}, ci AS ({CIRC}),
  vz AS (SELECT k AS cid, full_len - CASE WHEN circular THEN closing ELSE 0 END AS size, circular FROM meas JOIN ci ON ci.cid = k)"""


@register("variant_sizes", f"WITH {MEASURED} SELECT cid, size, circular FROM vz")
def variant_sizes(spark, d):
    return Parts(spark, d).sizes.select("cid", "size", "circular")


@register("size_filter", f"WITH {MEASURED} SELECT cid, size FROM vz WHERE size >= 0.5 * (SELECT max(size) FROM vz) OR cid < 2")
def size_filter(spark, d):
    v = Parts(spark, d).sizes.withColumn("source", F.when(F.col("cid") < 2, "user_fixed").otherwise("search"))
    return V.size_filter(v, 0.5).select("cid", "size")


@register(
    "merged_candidates",
    f"""WITH c AS (SELECT {gaf('pt')} AS path, CASE WHEN cid < 3 THEN 0 WHEN cid < 6 THEN 1 ELSE 2 END AS r, cid AS o, pt FROM (SELECT cid, {canon('p')} AS pt FROM va)),
    u AS (SELECT * FROM c UNION ALL SELECT path, 2, o + 100, pt FROM c WHERE o < 4),
    f AS (SELECT path, pt, min({{'r': r, 'o': o}}) AS m FROM u GROUP BY path, pt)
    SELECT row_number() OVER (ORDER BY m.r, m.o, pt) - 1 AS cid, path, CASE m.r WHEN 0 THEN 'user_fixed' WHEN 1 THEN 'user' ELSE 'search' END AS source FROM f""",
)
def merged_candidates(spark, d):
    v = A.variants(spark, d).select(P.canonical(F.col("path")).alias("path"), F.when(F.col("cid") < 3, "user_fixed").when(F.col("cid") < 6, "user").otherwise("search").alias("source"), F.col("cid").alias("ord"))
    again = v.filter("ord < 4").select("path", F.lit("search").alias("source"), (F.col("ord") + 100).alias("ord"))
    got = V.merge_candidates(v.filter("ord < 6"), v.filter("ord >= 6").union(again))
    return got.select(F.col("cid").cast("long").alias("cid"), Q(F.col("path")).alias("path"), "source")


def sub_sql() -> str:
    """Runs of variants that an alignment of LONGEST bases can span, canonical, with counts."""
    turns = 12
    return f"""{MEASURED},
  st AS (SELECT k, i, lens.n, len, ov, ci.p[i] AS s, ci.circular AS c FROM lens JOIN ci ON ci.cid = k),
  ext AS (SELECT k, n, c, t * n + i AS j, s, len, CASE WHEN t * n + i = 1 THEN 0 ELSE lag(ov) OVER (PARTITION BY k ORDER BY t * n + i) END AS po FROM st, range({turns}) r(t) WHERE c OR t = 0),
  ag AS (SELECT k, n, max(j) AS m, list(s ORDER BY j) AS p, list(len - coalesce(po, 0) ORDER BY j) AS adds FROM ext GROUP BY k, n),
  ru AS (SELECT k, p[i : i + w - 1] AS pt FROM ag, unnest(range(1, n + 1)) AS a(i), unnest(range(1, least(m - i + 2, 12))) AS b(w)
    WHERE i + w - 1 <= m AND (w <= 2 OR list_sum(adds[i + 1 : i + w - 2]) <= {LONGEST} - 2)),
  vs AS (SELECT k AS cid, {canon('pt')} AS p, count(*)::INT AS freq FROM ru GROUP BY 1, 2)"""


SUB = sub_sql()


@register("variant_subpath_counts", f"WITH {SUB} SELECT cid, {gaf('vs.p')} AS path, freq FROM vs JOIN sup ON vs.p = sup.p")
def variant_subpath_counts(spark, d):
    return Parts(spark, d).subs.select("cid", Q(F.col("path")).alias("path"), "freq")


@register("variant_all_subpaths", f"WITH {SUB} SELECT cid, {gaf('vs.p')} AS path, freq FROM vs")
def variant_all_subpaths(spark, d):
    return Parts(spark, d).every_sub.select("cid", Q(F.col("path")).alias("path"), "freq")


OBS = f"{SUB}, ob AS (SELECT cid, vs.p, freq, sup.n FROM vs JOIN sup ON vs.p = sup.p)"


@register(
    "unidentifiable_groups",
    f"""WITH {OBS}, fp AS (SELECT cid, list({{'p': {gaf('p')}, 'f': freq}} ORDER BY {gaf('p')}) AS f FROM ob GROUP BY cid)
    SELECT vz.cid, min(vz.cid) OVER (PARTITION BY f, size) AS representative FROM vz LEFT JOIN fp ON vz.cid = fp.cid""",
)
def unidentifiable_groups(spark, d):
    x = Parts(spark, d)
    return V.unidentifiable(x.subs, x.sizes)


@register("sub_path_variants", f"WITH {OBS} SELECT {gaf('p')} AS path, array_to_string(list(cid || ':' || freq ORDER BY cid), ',') AS variants FROM ob GROUP BY p")
def sub_path_variants(spark, d):
    got = V.from_variants(Parts(spark, d).subs)
    return got.select(Q(F.col("path")).alias("path"), F.array_join(F.transform(F.map_entries("variants"), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"].cast("string"))), ",").alias("variants"))


@register("uncovered_read_paths", f"WITH {SUB} SELECT {gaf('sup.p')} AS path, n FROM sup WHERE p NOT IN (SELECT p FROM vs)")
def uncovered_read_paths(spark, d):
    x = Parts(spark, d)
    return R.uncovered(x.supported, x.every_sub).select(Q(F.col("path")).alias("path"), "n")


@register("coverage_ratio", f"WITH {SUB} SELECT sum(CASE WHEN p NOT IN (SELECT p FROM vs) THEN n ELSE 0 END) / sum(n) AS uncovered_ratio FROM sup")
def coverage_ratio(spark, d):
    x = Parts(spark, d)
    return R.coverage_ratio(x.supported, x.every_sub)


@register("indispensable_variants", f"WITH {OBS} SELECT DISTINCT cid FROM (SELECT min(cid) AS cid FROM ob GROUP BY p HAVING count(*) = 1)")
def indispensable_variants(spark, d):
    return V.indispensable(Parts(spark, d).subs)


# --- bins and model ---


LENS2 = LENS.replace("lens AS", "lens2 AS").replace("FROM src", "FROM src2").replace("FROM lens ", "FROM lens2 ").replace("meas AS", "meas2 AS")
BINS = f"""{OBS}, src2 AS (SELECT DISTINCT p AS k, p FROM ob), {LENS2},
  de AS (SELECT k AS p, n AS steps, full_len, inner_len, left_free, right_free, CASE WHEN n > 1 THEN inner_len + 2 ELSE 1 END AS lo, full_len AS hi FROM meas2
    WHERE CASE WHEN n > 1 THEN inner_len + 2 ELSE 1 END <= full_len),
  rl AS (SELECT p, trunc(len / 4)::INT AS len FROM cp),
  cu AS (SELECT lo AS b FROM de UNION SELECT hi + 1 FROM de),
  ra AS (SELECT b AS lo, lead(b) OVER (ORDER BY b) - 1 AS hi FROM cu),
  bi AS (SELECT row_number() OVER (ORDER BY lo)::INT AS bin_id, lo, hi FROM ra WHERE hi IS NOT NULL AND EXISTS (SELECT 1 FROM rl WHERE len BETWEEN lo AND hi))"""
CELLS = f"""{BINS}, ma AS (SELECT bin_id, rl.p, count(*) AS num_matched FROM rl JOIN de ON rl.p = de.p JOIN bi ON rl.len BETWEEN bi.lo AND bi.hi GROUP BY ALL),
  bl AS (SELECT bin_id, len, count(*) AS c FROM rl JOIN bi ON rl.len BETWEEN bi.lo AND bi.hi GROUP BY ALL),
  xx AS (SELECT ma.bin_id, ma.p, num_matched, c, CASE WHEN steps = 1 THEN full_len - len + 1 ELSE (len - (inner_len + 2) + 1)
    - greatest(len - (inner_len + 2) + 1 - left_free, 0) - greatest(len - (inner_len + 2) + 1 - right_free, 0) END AS x FROM ma JOIN de ON ma.p = de.p JOIN bl ON bl.bin_id = ma.bin_id),
  ce AS (SELECT bin_id, p, first(num_matched) AS num_matched, sum(x * c) / sum(c) AS num_possible_x FROM xx GROUP BY bin_id, p)"""


@register("sub_path_ranges", f"WITH {BINS} SELECT {gaf('p')} AS path, lo, hi, left_free, right_free FROM de WHERE steps > 1")
def sub_path_ranges(spark, d):
    return Parts(spark, d).described.filter("steps > 1").select(Q(F.col("path")).alias("path"), "lo", "hi", "left_free", "right_free")


@register("length_bins", f"WITH {BINS} SELECT bin_id, lo, hi FROM bi")
def length_bins(spark, d):
    x = Parts(spark, d)
    return B.length_bins(x.described, x.lengths)


@register("bin_cells", f"WITH {CELLS} SELECT bin_id, {gaf('p')} AS path, num_matched, round(num_possible_x, 6) AS num_possible_x FROM ce")
def bin_cells(spark, d):
    return Parts(spark, d).cells.select("bin_id", Q(F.col("path")).alias("path"), "num_matched", F.round("num_possible_x", 6).alias("num_possible_x"))


@register("bin_usable_cells", f"WITH {CELLS} SELECT bin_id, {gaf('p')} AS path, num_matched FROM ce WHERE num_possible_x >= 1")
def bin_usable_cells(spark, d):
    return B.usable(Parts(spark, d).cells).select("bin_id", Q(F.col("path")).alias("path"), "num_matched")


LIKE = f"""{CELLS}, uc AS (SELECT * FROM ce WHERE num_possible_x >= 1), wt AS (SELECT p, sum(freq / 25.0::DOUBLE) AS w FROM ob GROUP BY p), tl AS (SELECT sum(size / 25.0::DOUBLE) AS t FROM vz),
  ll AS (SELECT sum(num_matched * ln(num_possible_x * w / t)) AS loglik, sum(num_matched)::BIGINT AS n FROM uc JOIN wt ON uc.p = wt.p, tl)"""


@register("loglik_at_uniform", f"WITH {LIKE} SELECT round(loglik, 4) AS loglik, n FROM ll")
def loglik_at_uniform(spark, d):
    return Parts(spark, d).likelihood.select(F.round("loglik", 4).alias("loglik"), "n")


@register("aic_bic", f"WITH {LIKE} SELECT round(2 * 25 - 2 * loglik, 4) AS aic, round(ln(n) * 25 - 2 * loglik, 4) AS bic FROM ll")
def aic_bic(spark, d):
    return Parts(spark, d).likelihood.select(F.round(T.aic(F.col("loglik"), F.lit(25)), 4).alias("aic"), F.round(T.bic(F.col("loglik"), F.lit(25), F.col("n")), 4).alias("bic"))


def _em_sql() -> str:
    parts = [f"{CELLS}, oo AS (SELECT p, sum(num_matched)::DOUBLE AS x FROM ce WHERE num_possible_x >= 1 GROUP BY p)"]
    parts.append("rt AS (SELECT ob.cid, ob.p, ob.freq / vz.size::DOUBLE AS a, oo.x FROM ob JOIN vz ON ob.cid = vz.cid JOIN oo ON ob.p = oo.p)")
    parts.append("w0 AS (SELECT cid, 1.0::DOUBLE / count(*) OVER () AS w FROM (SELECT DISTINCT cid FROM rt))")
    parts.append("tx AS (SELECT sum(x) AS t FROM oo WHERE p IN (SELECT p FROM rt))")
    for i in range(1, EM_ROUNDS + 1):
        parts.append(f"p{i} AS (SELECT rt.cid, p, x, w * a AS r FROM rt JOIN w{i - 1} USING (cid)), z{i} AS (SELECT p, sum(r) AS z FROM p{i} GROUP BY p), w{i} AS (SELECT cid, sum(x * r / z) / (SELECT t FROM tx) AS w FROM p{i} JOIN z{i} USING (p) GROUP BY cid)")
    return "WITH " + ", ".join(parts) + f", pr AS (SELECT cid, w / size AS v FROM w{EM_ROUNDS} JOIN vz USING (cid)) SELECT cid, round(v / sum(v) OVER (), 9) AS prop FROM pr"


@register("em_proportions", _em_sql())
def em_proportions(spark, d):
    x = Parts(spark, d)
    observed = B.usable(x.cells).groupBy("path").agg(F.sum("num_matched").cast("double").alias("x"))
    got = M.em_steps(observed, x.subs, x.sizes, EM_ROUNDS)
    return got.select("cid", F.round("prop", 9).alias("prop"))


def model_cells(spark, d) -> M.Cells:
    return Parts(spark, d).model_cells


@register("fitted_proportions")
def fitted_proportions(spark, d):
    c = model_cells(spark, d)
    fit = c.fit(c.cids)
    return spark.createDataFrame([(int(x), round(float(p), 6), round(fit.loglik, 4)) for x, p in zip(fit.cids, fit.props, strict=True)], "cid int, prop double, loglik double")


@register("selected_model")
def selected_model(spark, d):
    fit = model_cells(spark, d).select("BIC")
    return spark.createDataFrame([(int(x), round(float(p), 6), round(fit.criterion("BIC"), 4)) for x, p in zip(fit.cids, fit.props, strict=True)], "cid int, prop double, bic double")


@register("mcmc_means")
def mcmc_means(spark, d):
    c = model_cells(spark, d)
    walk = M.metropolis

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for chain in b.column(0).to_pylist():
                draws = walk(c, 400, 200, chain)
                yield pa.RecordBatch.from_arrays([pa.array([chain] * len(c.cids), pa.int64()), pa.array(c.cids, pa.int32()), pa.array(draws.mean(0)), pa.array(draws.std(0))], names=["chain", "cid", "m", "s"])

    got = spark.range(0, 4, 1, 4).mapInArrow(run, "chain long, cid int, m double, s double")
    return got.groupBy("cid").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.avg("s"), 6).alias("std"))


# --- resampling ---

DRAW = "('0x' || substr(md5('12345:' || rep || ':' || idx), 1, 12))::BIGINT"


@register("bootstrap_weights", f"WITH t AS (SELECT count(*) AS total FROM orders), s AS (SELECT rep, idx, total FROM range(3) r(rep0), t, unnest(range(total)) u(idx), LATERAL (SELECT rep0 + 1 AS rep)) SELECT rep::INT AS rep, {DRAW} % total AS idx, count(*) AS n FROM s GROUP BY ALL")
def bootstrap_weights(spark, d):
    n = A.table(spark, d, "orders").count()
    return RS.bootstrap(spark.range(n).withColumnRenamed("id", "idx"), 3)


@register("jackknife_sample", "WITH s AS (SELECT rep, idx FROM range(1, 3) r(rep), (SELECT DISTINCT o_custkey AS idx FROM orders)), o AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY md5('12345:' || rep || ':' || idx), idx) AS k FROM s) SELECT rep::INT AS rep, idx FROM o WHERE k > 10")
def jackknife_sample(spark, d):
    return RS.jackknife(A.table(spark, d, "orders").select(F.col("o_custkey").alias("idx")).distinct(), 2, 10)


SOLVED = "rp2 AS (SELECT DISTINCT o_custkey % 40 AS rep, c_nationkey % 4 AS cid FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders))"


def solved(spark, d) -> DataFrame:
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    mean = o.agg((F.avg("o_totalprice") * 1.9).alias("m"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).crossJoin(F.broadcast(mean)).filter(F.col("o_totalprice") > F.col("m")).select((F.col("o_custkey") % 40).alias("rep"), (F.col("c_nationkey") % 4).alias("cid")).distinct()


@register("bootstrap_support", f"WITH {SOLVED}, s AS (SELECT rep, array_to_string(list(cid ORDER BY cid), ',') AS solution FROM rp2 GROUP BY rep) SELECT solution, count(*) / sum(count(*)) OVER () AS support FROM s GROUP BY solution")
def bootstrap_support(spark, d):
    return RS.support(solved(spark, d))


@register("replicate_spread", "SELECT c_nationkey AS cid, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std FROM customer GROUP BY 1")
def replicate_spread(spark, d):
    return RS.spread(A.table(spark, d, "customer").select(F.col("c_nationkey").alias("cid"), F.col("c_acctbal").alias("prop"))).select("cid", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("first_seen_ids", "SELECT cid, row_number() OVER (ORDER BY place, cid) AS fid FROM (SELECT c_nationkey AS cid, min(c_custkey) AS place FROM customer GROUP BY 1)")
def first_seen_ids(spark, d):
    return RS.first_seen(A.table(spark, d, "customer").select(F.col("c_nationkey").alias("cid"), F.col("c_custkey").alias("place"))).withColumn("fid", F.col("fid").cast("long"))


# --- conflicts ---


def conflict_records(spark, d) -> DataFrame:
    rec = records(spark, d)
    return rec.select("query_name", (F.col("k") - 1).alias("go_r"), F.col("n").alias("first_n"), F.col("e").alias("first_e"), F.col("n").alias("last_n"), F.col("e").alias("last_e"), F.lit(1000).alias("p_len"), (F.col("p_align_len") % 400).alias("p_start"), (F.lit(1000) - F.col("p_align_len") % 300).alias("p_end"))


SITES = """cr AS (SELECT read, k - 1 AS go_r, count(*) OVER (PARTITION BY read) AS m, rec.n, rec.e, rec.len AS pl FROM rec),
  si AS (SELECT cr.read AS query_name, go_r - 1 AS go_from, go_r AS go_to, true AS is_to, cr.n AS v, cr.e, (CASE WHEN cr.e THEN pl % 400 + 1 ELSE sg.len - pl % 400 END)::INT AS site, sg.len FROM cr JOIN sg ON cr.n = sg.name WHERE go_r > 0
    UNION ALL SELECT cr.read, go_r, go_r + 1, false, cr.n, cr.e, (CASE WHEN cr.e THEN sg.len - pl % 300 ELSE pl % 300 + 1 END)::INT, sg.len FROM cr JOIN sg ON cr.n = sg.name WHERE go_r < m - 1)"""


@register("conflict_sites", f"WITH {SITES} SELECT query_name, go_from, go_to, is_to, v, e, site FROM si")
def conflict_sites(spark, d):
    got = C.sites(conflict_records(spark, d), A.contigs(spark, d))
    return got.select("query_name", F.col("go_from").cast("long").alias("go_from"), F.col("go_to").cast("long").alias("go_to"), "is_to", "v", "e", "site")


LOADS = f"""{SITES}, wb AS (SELECT v, site, len, greatest(ceil((len - 50) / 40.0), 0)::INT AS lastw FROM si),
  wn AS (SELECT v, CASE WHEN site - 1 < 50 THEN [0] ELSE (
      CASE WHEN CASE WHEN site - 1 >= len - 50 THEN lastw ELSE (site - 1) // 40 END > greatest(0, ceil((site - 50) / 40.0))::INT
      THEN range(greatest(0, ceil((site - 50) / 40.0))::INT, CASE WHEN site - 1 >= len - 50 THEN lastw ELSE (site - 1) // 40 END + 1)
      ELSE [CASE WHEN site - 1 >= len - 50 THEN lastw ELSE (site - 1) // 40 END] END) END AS b FROM wb),
  lo AS (SELECT v, x AS bin, count(*) AS n FROM (SELECT v, unnest(b) AS x FROM wn) GROUP BY ALL),
  al AS (SELECT name AS v, unnest(range(greatest(ceil((len - 50) / 40.0), 0)::INT + 1)) AS bin FROM sg),
  ld AS (SELECT al.v, al.bin, coalesce(lo.n, 0) AS n FROM al LEFT JOIN lo ON al.v = lo.v AND al.bin = lo.bin)"""


@register("window_conflicts", f"WITH {LOADS} SELECT v, bin::BIGINT AS bin, n FROM ld")
def window_conflicts(spark, d):
    s = A.contigs(spark, d)
    return C.window_loads(C.sites(conflict_records(spark, d), s), s).select("v", F.col("bin").cast("long").alias("bin"), "n")


@register("conflict_max_load", f"WITH {LOADS} SELECT v, max(n) AS max_load FROM ld GROUP BY v HAVING max(n) > 5")
def conflict_max_load(spark, d):
    s = A.contigs(spark, d)
    return C.most_loaded(C.window_loads(C.sites(conflict_records(spark, d), s), s), 5)


@register("max_load_threshold")
def max_load_threshold(spark, d):
    s = A.contigs(spark, d)
    n = s.agg(F.sum(C.window_count(F.col("len")))).first()[0]
    found = C.sites(conflict_records(spark, d), s).count()
    return spark.createDataFrame([(C.max_load_threshold(spark, n, found),)], "load int")


@register("gmm_breakpoints")
def gmm_breakpoints(spark, d):
    return C.breakpoints(C.sites(conflict_records(spark, d), A.contigs(spark, d)))


@register("conflict_edges")
def conflict_edges(spark, d):
    found = C.sites(conflict_records(spark, d), A.contigs(spark, d))
    return C.candidate_edges(found, C.breakpoints(found), 5)


# --- pangenome ---


def best_props(variants: DataFrame) -> DataFrame:
    return variants.select("cid", (1 / (F.col("cid") + 1)).alias("prop"))


BEST = f"bv AS (SELECT cid, p, circular FROM ({CIRC})), bp AS (SELECT cid, 1.0::DOUBLE / (cid + 1) AS prop FROM bv)"
#: A block table that SQL can state too: every step of a variant is its own block, shared by equal contig names.
FIXED = "fb AS (SELECT cid, vid, dense_rank() OVER (ORDER BY n) - 1 AS block_id, 0 AS pos, e FROM (SELECT cid, i - 1 AS vid, p[i].n AS n, p[i].e AS e FROM bv, unnest(range(1, len(p) + 1)) AS r(i)))"


def fixed_blocks(variants: DataFrame) -> DataFrame:
    steps = variants.select("cid", F.posexplode("path").alias("vid", "s")).select("cid", "vid", F.col("s.n").alias("n"), F.col("s.e").alias("e"))
    return steps.select("cid", "vid", (F.dense_rank().over(Window.orderBy("n")) - 1).alias("block_id"), F.lit(0).alias("pos"), "e")


@register("variant_index", f"WITH {BEST} SELECT cid, i - 1 AS vid, p[i].n AS n, p[i].e AS e, CASE WHEN circular OR i < len(p) THEN i % len(p) ELSE -1 END AS next_vid, CASE WHEN circular OR i > 1 THEN (i - 2 + len(p)) % len(p) ELSE -1 END AS prev_vid FROM bv, unnest(range(1, len(p) + 1)) AS r(i)")
def variant_index(spark, d):
    from ..operators import pangenome as PG

    long = lambda c: F.coalesce(c, F.lit(-1)).cast("long").alias(c)
    return PG.index(Parts(spark, d).ringed).select("cid", long("vid"), "n", "e", long("next_vid"), long("prev_vid"))


@register("vertex_copy_distribution", "SELECT name, max(c) AS max_copies, count(*) AS n_variants FROM (SELECT s.n AS name, cid, count(*) AS c FROM (SELECT cid, unnest(p) AS s FROM va) GROUP BY ALL) GROUP BY name")
def vertex_copy_distribution(spark, d):
    from ..operators import pangenome as PG

    return PG.copy_distribution(A.variants(spark, d))


@register("colinear_blocks")
def colinear_blocks(spark, d):
    from ..operators import pangenome as PG

    x = Parts(spark, d)
    return PG.colinear_blocks(G.checkpointed(x.ringed), best_props(x.ringed), x.contigs)


@register(
    "coverage_division",
    f"""WITH {BEST}, st AS (SELECT cid, i - 1 AS vid, p[i].n AS n, p[i].e AS e FROM bv, unnest(range(1, len(p) + 1)) AS r(i)),
    fb AS (SELECT cid, vid, n, e::INT AS block_id FROM st), h AS (SELECT n, block_id, sum(prop) AS p FROM fb JOIN bp USING (cid) GROUP BY ALL)
    SELECT n AS name, block_id, round(p / sum(p) OVER (PARTITION BY n), 9) AS share FROM h""",
)
def coverage_division(spark, d):
    from ..operators import pangenome as PG

    own = Parts(spark, d).ringed
    blocks = fixed_blocks(own).withColumn("block_id", F.col("e").cast("int"))
    return PG.coverage_division(blocks, own, best_props(own)).select("name", "block_id", F.round("share", 9).alias("share"))


@register(
    "renamed_copies",
    f"""WITH {BEST}, st AS (SELECT cid, i - 1 AS vid, p[i].n AS n, p[i].e AS e FROM bv, unnest(range(1, len(p) + 1)) AS r(i)),
    f AS (SELECT n, e, min({{'c': cid, 'v': vid}}) AS f FROM st GROUP BY n, e), k AS (SELECT n, e, row_number() OVER (PARTITION BY n ORDER BY f) AS k FROM f)
    SELECT cid, vid, CASE WHEN k = 1 THEN n ELSE n || '_copy' || k END AS new FROM st JOIN k USING (n, e)""",
)
def renamed_copies(spark, d):
    from ..operators import pangenome as PG

    own = Parts(spark, d).ringed
    blocks = fixed_blocks(own).withColumn("block_id", F.col("e").cast("int"))
    return PG.renamed(blocks, own).select("cid", F.col("vid").cast("long").alias("vid"), "new")


@register(
    "pangenome_edges",
    f"""WITH {BEST}, l AS (SELECT p[i].n AS v1, p[i].e AS e1, p[i % len(p) + 1].n AS v2, NOT p[i % len(p) + 1].e AS e2 FROM bv, unnest(range(1, len(p) + 1)) AS r(i) WHERE circular OR i < len(p)),
    o AS (SELECT l.v1, l.e1, l.v2, l.e2, coalesce(he.overlap, 0) AS overlap FROM l LEFT JOIN he ON l.v1 = he.v1 AND l.e1 = he.e1 AND l.v2 = he.v2 AND l.e2 = he.e2)
    SELECT v1, e1, v2, e2, max(overlap) AS overlap FROM (SELECT * FROM o UNION ALL SELECT v2, e2, v1, e1, overlap FROM o) GROUP BY ALL""",
)
def pangenome_edges(spark, d):
    from ..operators import pangenome as PG

    x = Parts(spark, d)
    return PG.pangenome_graph(fixed_blocks(x.ringed), x.ringed, best_props(x.ringed), x.contigs, x.links)[1]


@register("pangenome_segments", f"WITH {BEST} SELECT name, len, round(cov, 6) AS cov FROM sg WHERE name IN (SELECT s.n FROM (SELECT unnest(p) AS s FROM bv))")
def pangenome_segments(spark, d):
    from ..operators import pangenome as PG

    x = Parts(spark, d)
    return PG.pangenome_graph(fixed_blocks(x.ringed), x.ringed, best_props(x.ringed), x.contigs, x.links)[0].select("name", "len", F.round("cov", 6).alias("cov"))


@register(
    "block_table",
    f"""WITH {BEST}, st AS (SELECT cid, i - 1 AS vid, p[i].n AS n, p[i].e AS e, CASE WHEN i < len(p) THEN p[i + 1].n END AS n2, CASE WHEN i < len(p) THEN NOT p[i + 1].e END AS e2 FROM bv, unnest(range(1, len(p) + 1)) AS r(i)),
    ad AS (SELECT st.cid, vid, st.n, st.e, (sg.len - coalesce(he.overlap, 0))::BIGINT AS adds, dense_rank() OVER (ORDER BY st.n) AS b FROM st JOIN sg ON sg.name = st.n LEFT JOIN he ON he.v1 = st.n AND he.e1 = st.e AND he.v2 = st.n2 AND he.e2 = st.e2),
    po AS (SELECT *, coalesce(sum(adds) OVER (PARTITION BY cid ORDER BY vid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + vid * 100 AS ahead FROM ad),
    fu AS (SELECT b, row_number() OVER (ORDER BY min({{'c': cid, 'v': vid}})) AS block FROM ad GROUP BY b)
    SELECT block, cid AS variant, ahead + 1 AS "start", ahead + adds AS "end", adds AS real_len FROM po JOIN fu USING (b)""",
)
def block_table(spark, d):
    from ..operators import pangenome as PG

    # Every step is its own stretch here: positions of neighbours in a one-cell block never differ by one.
    x = Parts(spark, d)
    return PG.block_table(fixed_blocks(x.ringed), x.ringed, x.contigs, x.links, gap=100).withColumn("block", F.col("block").cast("long"))


# --- small statistics, lookups and tables ---


@register("weighted_mean_std", "WITH m AS (SELECT n_regionkey AS g, sum(c_acctbal * c_custkey) / sum(c_custkey) AS mu FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT g, round(any_value(mu), 6) AS mean, round(sqrt(sum(c_custkey * (c_acctbal - mu) * (c_acctbal - mu)) / sum(c_custkey)), 6) AS std FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN m ON g = n_regionkey GROUP BY g")
def weighted_mean_std(spark, d):
    rows = A.table(spark, d, "customer").join(A.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("g"), F.col("c_acctbal").alias("x"), F.col("c_custkey").alias("w"))
    return ST.weighted(rows, "g", "x", "w").select("g", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("gcd_of_sizes", "SELECT c AS grp, g AS gcd FROM (SELECT l_partkey % 50 AS c, list_reduce(list((l_quantity * 6)::BIGINT), lambda a, b: gcd(a, b)) AS g FROM lineitem GROUP BY 1)")
def gcd_of_sizes(spark, d):
    li = A.table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("grp")).agg(F.collect_set((F.col("l_quantity") * 6).cast("long")).alias("v"))
    return li.select("grp", T.gcd_of(F.col("v")).alias("gcd"))


@register("harmony_weights", "SELECT s_suppkey AS id, round(pow(s_suppkey + 1, 0.5) / sum(pow(s_suppkey + 1, 0.5)) OVER (PARTITION BY s_nationkey), 9) AS weight FROM supplier")
def harmony_weights(spark, d):
    return A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round(T.harmony_weights((F.col("s_suppkey") + 1).cast("double"), 0.5, "s_nationkey"), 9).alias("weight"))


@register("breakpoint_lookup", "WITH b AS (SELECT list(DISTINCT o_custkey ORDER BY o_custkey) AS x FROM orders) SELECT c_custkey AS seek, len(list_filter(x, lambda v: v <= c_custkey)) - 1 AS idx, c_custkey - x[len(list_filter(x, lambda v: v <= c_custkey))] AS gap FROM customer, b")
def breakpoint_lookup(spark, d):
    seeks = A.table(spark, d, "customer").select(F.col("c_custkey").alias("seek"))
    return T.floor_in(seeks, "seek", A.table(spark, d, "orders"), "o_custkey")


@register(
    "transition_counts",
    """WITH s AS (SELECT name, seq, unnest(range(1, len - 2)) AS i FROM ss)
    SELECT substr(seq, i, 3) AS kmer, substr(seq, i + 3, 1) AS base, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY substr(seq, i, 3)), 9) AS share FROM s GROUP BY 1, 2""",
)
def transition_counts(spark, d):
    return ST.transitions(A.supplier_contigs(spark, d), 3).select("kmer", "base", F.col("n").cast("long").alias("n"), F.round("share", 9).alias("share"))


@register(
    "path_offsets",
    f"""WITH src AS (SELECT cid AS k, p FROM va), {LENS}
    SELECT k AS cid, i - 1 AS vid, coalesce(sum(len - ov) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lens""",
)
def path_offsets(spark, d):
    from ..operators import simulate as SI

    got = SI.offsets(Parts(spark, d).measured).select("cid", F.posexplode("starts").alias("vid", "start"))
    return got.select("cid", F.col("vid").cast("long").alias("vid"), "start")


@register("copy_numbers", "SELECT cid, n, e, count(*) AS copies FROM (SELECT cid, s.n AS n, s.e AS e FROM (SELECT cid, unnest(p) AS s FROM va)) GROUP BY ALL")
def copy_numbers(spark, d):
    return A.variants(spark, d).select("cid", F.explode("path").alias("s")).select("cid", "s.n", "s.e").groupBy("cid", "n", "e").agg(F.count("*").alias("copies"))


@register("lost_subpaths", f"WITH {SUB} SELECT {gaf('p')} AS path FROM (SELECT DISTINCT p FROM vs WHERE cid < 10 EXCEPT SELECT DISTINCT p FROM vs WHERE cid >= 10)")
def lost_subpaths(spark, d):
    every = Parts(spark, d).every_sub
    return every.filter("cid < 10").select("path").subtract(every.filter("cid >= 10").select("path")).select(Q(F.col("path")).alias("path"))


@register("shared_contigs", "SELECT name FROM (SELECT s.n AS name FROM (SELECT cid, unnest(p) AS s FROM va) WHERE cid < 5 INTERSECT SELECT s.n FROM (SELECT cid, unnest(p) AS s FROM va) WHERE cid >= 5)")
def shared_contigs(spark, d):
    steps = A.variants(spark, d).select("cid", F.explode("path").alias("s")).select("cid", F.col("s.n").alias("name"))
    return steps.filter("cid < 5").select("name").intersect(steps.filter("cid >= 5").select("name"))


@register(
    "variants_info",
    f"""WITH {OBS}, fp AS (SELECT cid, list({{'p': {gaf('p')}, 'f': freq}} ORDER BY {gaf('p')}) AS f FROM ob GROUP BY cid),
    g AS (SELECT vz.cid, min(vz.cid) OVER (PARTITION BY f, size) AS r FROM vz LEFT JOIN fp ON vz.cid = fp.cid),
    u AS (SELECT r AS cid, array_to_string(list(cid ORDER BY cid), ',') AS u FROM g WHERE cid <> r GROUP BY r)
    SELECT CASE WHEN vz.cid < 5 THEN (vz.cid + 1)::VARCHAR ELSE '*' END AS "FID", vz.cid AS "CID", coalesce(u, '*') AS "Unidentifiable_to_cid", len(ci.p)::INT AS "CONTIGS", size AS "BASES",
      {bandage_sql('ci.p')} || CASE WHEN ci.circular THEN '(circular)' ELSE '' END AS "PATH" FROM vz JOIN ci ON vz.cid = ci.cid LEFT JOIN u ON u.cid = vz.cid""",
)
def variants_info(spark, d):
    x = Parts(spark, d)
    fids = x.sizes.filter("cid < 5").select("cid", (F.col("cid") + 1).alias("fid"))
    return W.variant_info(fids, x.sizes, V.unidentifiable(x.subs, x.sizes))


@register(
    "readpath_information",
    f"""WITH {OBS} SELECT {gaf('sup.p')} AS path, {', '.join(f"coalesce(max(CASE WHEN cid = {c} THEN freq END), 0) AS fid_{c + 1}" for c in range(25))}, any_value(sup.n) AS num_reads
    FROM sup LEFT JOIN ob ON ob.p = sup.p GROUP BY sup.p""",
)
def readpath_information(spark, d):
    x = Parts(spark, d)
    held = x.subs.select((F.col("cid") + 1).alias("fid"), "path", "freq")
    return W.readpath_info(x.supported.select("path", "n"), held, list(range(1, 26)))


@register("replicate_table", f"""SELECT c_mktsegment AS rep, {', '.join(f'coalesce(round(avg(CASE WHEN c_nationkey = {k} THEN c_acctbal END), 6), 0) AS fid_{k}' for k in range(25))} FROM customer GROUP BY 1""")
def replicate_table(spark, d):
    c = A.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("rep"), F.col("c_nationkey").alias("fid")).agg(F.round(F.avg("c_acctbal"), 6).alias("prop"))
    return W.replicate_table(c, list(range(25)))


@register(
    "final_result",
    f"""WITH {SOLVED}, s AS (SELECT rep, array_to_string(list(cid ORDER BY cid), ',') AS solution FROM rp2 GROUP BY rep), t AS (SELECT solution, count(*) / sum(count(*)) OVER () AS support FROM s GROUP BY solution),
    f AS (SELECT s.solution, r.cid, count(*) / 100.0::DOUBLE AS prop FROM s JOIN rp2 r ON s.rep = r.rep GROUP BY ALL)
    SELECT t.solution, t.support, {', '.join(f"coalesce(printf('%.4f', max(CASE WHEN cid = {k} THEN prop END)), '-') AS fid_{k}" for k in range(4))} FROM t JOIN f ON t.solution = f.solution GROUP BY 1, 2""",
)
def final_result(spark, d):
    rows = solved(spark, d)
    named = rows.groupBy("rep").agg(F.array_join(F.array_sort(F.collect_list("cid")), ",").alias("solution"))
    props = rows.join(named, "rep").groupBy("solution", F.col("cid").alias("fid")).agg((F.count("*") / 100.0).alias("prop"))
    return W.result_table(RS.support(rows), props, [0, 1, 2, 3])


@register("gfa_segment_lines", "SELECT concat_ws(chr(9), 'S', name, seq, 'LN:i:' || len, 'RC:i:' || trunc(len * cov)::BIGINT) AS value FROM sg")
def gfa_segment_lines(spark, d):
    return W.gfa_lines(A.contigs(spark, d), A.contig_links(spark, d)).filter("part = 1").select("value")


@register("fasta_lines", "SELECT name, '>' || name || chr(10) || array_to_string(list_transform(range(0, (len + 69) // 70), lambda i: substr(seq, i * 70 + 1, 70)), chr(10)) AS value FROM sg")
def fasta_lines(spark, d):
    return W.fasta_lines(A.contigs(spark, d).select(F.col("name").alias("label"), "seq")).select(F.col("key").alias("name"), "value")


@register("walks")
def walks(spark, d):
    x = Parts(spark, d)
    got = SE.search(spark, x.contigs, x.links, x.supported.select("path", "n"), SE.Settings(longest_alignment=LONGEST))
    return got.select(Q(F.col("path")).alias("path"), "circular", "n", "first")


@register("simulated_reads")
def simulated_reads(spark, d):
    from ..operators import simulate as SI

    v = Parts(spark, d).measured
    n = v.count()
    props = v.select("cid", (F.lit(1.0) / n).alias("prop"))
    return SI.simulate(spark, v, props, SI.read_lengths(spark, 3000, 1500, 500_000)).select("record_id", Q(F.col("path")).alias("path"), "p_start", "p_end", "p_len", "cid")
