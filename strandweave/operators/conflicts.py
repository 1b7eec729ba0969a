"""Alignment conflicts: where the records of one read break off, counted in overlapping windows of each contig."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, STEP = 50, 40


def window_count(length: Column, size: int = SIZE, step: int = STEP) -> Column:
    return (F.greatest(F.ceil((length - size) / step), F.lit(0)) + 1).cast("int")


def windows_of(base: Column, length: Column, size: int = SIZE, step: int = STEP, every: bool = False) -> Column:
    """Numbers (from 0) of the windows that hold a position (from 1). The last window ends at the contig's end.

    A position in the first window is given to that window only, unless ``every`` is set.
    """
    b = base - 1
    last = window_count(length, size, step) - 1
    start = F.when(b >= length - size, last).otherwise(F.floor(b / step)).cast("int")
    least = F.greatest(F.lit(0), F.ceil((b - size + 1) / step)).cast("int")
    many = F.when(start > least, F.sequence(least, start)).otherwise(F.array(start))
    return many if every else F.when(b < size, F.array(F.lit(0))).otherwise(many)


def sites(records: DataFrame, segments: DataFrame) -> DataFrame:
    """read, go_from, go_to, is_to, v, e, site: starts of all but a read's first record, ends of all but its last.

    ``records``: query_name, go_r (place in the read), first_n, first_e, last_n, last_e, p_len, p_start, p_end. Sites count
    from 1 on the forward strand.
    """
    n = F.count("*").over(Window.partitionBy("query_name"))
    rows = records.withColumn("many", n)
    lens = segments.select(F.col("name").alias("v"), "len")
    to = rows.filter("go_r > 0").select("query_name", (F.col("go_r") - 1).alias("go_from"), F.col("go_r").alias("go_to"), F.lit(True).alias("is_to"), F.col("first_n").alias("v"), F.col("first_e").alias("e"), F.col("p_start").alias("off"))
    frm = rows.filter("go_r < many - 1").select("query_name", F.col("go_r").alias("go_from"), (F.col("go_r") + 1).alias("go_to"), F.lit(False).alias("is_to"), F.col("last_n").alias("v"), F.col("last_e").alias("e"), (F.col("p_len") - F.col("p_end")).alias("off"))
    both = to.union(frm).join(lens, "v")
    forward = F.when(F.col("is_to") == F.col("e"), F.col("off") + 1).otherwise(F.col("len") - F.col("off"))
    return both.select("query_name", "go_from", "go_to", "is_to", "v", "e", forward.cast("int").alias("site"), "len")


def window_loads(found: DataFrame, segments: DataFrame, every: bool = False) -> DataFrame:
    """v, bin, n: conflicts in every window, zeros included."""
    counted = found.select("v", F.explode(windows_of(F.col("site"), F.col("len"), every=every)).alias("bin")).groupBy("v", "bin").agg(F.count("*").alias("n"))
    all_bins = segments.select(F.col("name").alias("v"), F.explode(F.sequence(F.lit(0), window_count(F.col("len")) - 1)).alias("bin"))
    return all_bins.join(counted, ["v", "bin"], "left").select("v", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def most_loaded(loads: DataFrame, over: int = 0) -> DataFrame:
    return loads.groupBy("v").agg(F.max("n").alias("max_load")).filter(F.col("max_load") > over)


def fullest(rng: np.random.Generator, bins: int, balls: int) -> int:
    """Load of the fullest bin when each ball falls into any of the bins alike. Where balls outnumber the bins, the bins' loads are
    drawn (they are multinomial), so the time follows the lesser of the two numbers."""
    if balls > bins:
        return int(rng.multinomial(balls, np.full(bins, 1 / bins)).max())
    return int(np.unique(rng.integers(0, bins, balls), return_counts=True)[1].max(initial=0))


def max_load_threshold(spark, bins: int, balls: int, simulations: int = 100_000, alpha: float = 0.001, seed: int = 12345) -> int:
    """The load that the fullest of ``bins`` windows exceeds by chance in under ``alpha`` of the simulations."""
    if simulations * alpha < 10:
        raise ValueError("too few simulations for this alpha")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            loads = [fullest(np.random.default_rng([seed, i]), bins, balls) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(loads, pa.int32())], names=["load"])

    counts = spark.range(simulations).mapInArrow(run, "load int").groupBy("load").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.orderBy("load").rowsBetween(Window.unboundedPreceding, -1))
    row = counts.withColumn("ahead", F.coalesce(ahead, F.lit(0))).filter(F.col("ahead") >= simulations * (1 - alpha)).agg(F.min("load")).first()
    return row[0] if row[0] is not None else counts.agg(F.max("load")).first()[0]


class Mixture:
    """One-dimensional normal mixture with one deviation for all components, whole-numbered means and equal means
    merged; the number of components is the one of least BIC."""

    def __init__(self, tol: float = 1e-6, most: int = 100, max_std: float = 50.0):
        self.tol, self.most, self.max_std = tol, most, max_std
        self.means = self.weights = np.zeros(0)
        self.std = 0.0

    @staticmethod
    def _log_parts(x: np.ndarray, means: np.ndarray, std: float, weights: np.ndarray) -> np.ndarray:
        s = max(std, 1e-3)
        return np.log(weights) - 0.5 * ((x[:, None] - means) / s) ** 2 - np.log(s * np.sqrt(2 * np.pi))

    @staticmethod
    def _norm(parts: np.ndarray) -> np.ndarray:
        top = parts.max(1, keepdims=True)
        return top + np.log(np.exp(parts - top).sum(1, keepdims=True))

    def fit(self, values, counts=None) -> Mixture:
        """``counts`` says how often each value occurs. Every number of components up to that of distinct values is tried."""
        x, c = np.asarray(values, float), np.ones(len(values)) if counts is None else np.asarray(counts, float)
        x, back = np.unique(x, return_inverse=True)
        c = np.bincount(back, c)
        n = c.sum()
        start = float(np.sqrt((c * (x - (c * x).sum() / n) ** 2).sum() / n))
        best = np.inf
        for k in range(1, len(x) + 1):
            means = np.unique(np.quantile(x, (np.arange(k) + 0.5) / k, method="nearest"))
            std, weights, last = min(start, self.max_std), np.full(len(means), 1 / len(means)), -np.inf
            for _ in range(self.most):
                parts = self._log_parts(x, means, std, weights)
                norm = self._norm(parts)
                now = float((c * norm[:, 0]).sum())
                r = np.exp(parts - norm) * c[:, None]
                share = r.sum(0)
                alive = share > 1e-12
                r, share = r[:, alive], share[alive]
                moved = np.round(r.T @ x / share)
                means = np.unique(moved)
                r = np.stack([r[:, moved == m].sum(1) for m in means], 1)
                std = min(float(np.sqrt((r * (x[:, None] - means) ** 2).sum() / n)), self.max_std)
                weights = r.sum(0) / n
                if abs(now - last) < self.tol:
                    break
                last = now
            loglik = float((c * self._norm(self._log_parts(x, means, std, weights))[:, 0]).sum())
            score = -2 * loglik + 2 * len(means) * np.log(n)
            if score < best - 1e-9:
                best, self.means, self.std, self.weights = score, means, std, weights
        return self

    def predict(self, values) -> np.ndarray:
        return self._log_parts(np.asarray(values, float), self.means, self.std, self.weights).argmax(1)


def breakpoints(found: DataFrame, max_std: float = 50.0) -> DataFrame:
    """v, site, mean: each contig's conflict sites and the cluster mean they belong to. A contig's distinct sites with
    their counts form one group, so a group is at most as large as the contig is long."""
    counted = found.groupBy("v", "site").agg(F.count("*").alias("n"))

    def cluster(pdf):
        import pandas as pd

        m = Mixture(max_std=max_std).fit(pdf["site"], pdf["n"])
        return pd.DataFrame({"v": pdf["v"], "site": pdf["site"], "mean": m.means[m.predict(pdf["site"])].astype(int)})

    return counted.groupBy("v").applyInPandas(cluster, "v string, site int, mean int")


def candidate_edges(found: DataFrame, means: DataFrame, least: int) -> DataFrame:
    """n1, e1, pos1, n2, e2, pos2, reads: links that at least ``least`` reads jump over, by clustered positions."""
    placed = found.join(means, ["v", "site"])
    frm = placed.filter(~F.col("is_to")).select("query_name", "go_from", "go_to", F.col("v").alias("n1"), F.col("e").alias("e1"), F.col("mean").alias("pos1"))
    to = placed.filter("is_to").select("query_name", "go_from", "go_to", F.col("v").alias("n2"), F.col("e").alias("e2"), F.col("mean").alias("pos2"))
    pair = frm.join(to, ["query_name", "go_from", "go_to"])
    flip = F.struct("n1", "pos1") > F.struct(F.col("n2").alias("n1"), F.col("pos2").alias("pos1"))
    side = lambda a, b: F.when(flip, b).otherwise(a)
    std = pair.select(
        side(F.col("n1"), F.col("n2")).alias("n1"), side(F.col("e1"), ~F.col("e2")).alias("e1"), side(F.col("pos1"), F.col("pos2")).alias("pos1"),
        side(F.col("n2"), F.col("n1")).alias("n2"), side(F.col("e2"), ~F.col("e1")).alias("e2"), side(F.col("pos2"), F.col("pos1")).alias("pos2"), "query_name",
    )
    return std.groupBy("n1", "e1", "pos1", "n2", "e2", "pos2").agg(F.count_distinct("query_name").alias("reads")).filter(F.col("reads") >= least)
