"""Proportions of variants: likelihood, expectation-maximisation, backward selection."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed


def log_likelihood(cells: DataFrame, freqs: DataFrame, sizes: DataFrame, props: DataFrame) -> DataFrame:
    """loglik, n: one row. cells: bin_id, path, num_matched, num_possible_x; freqs: cid, path, freq; props: cid, prop."""
    total = props.join(sizes, "cid").agg(F.sum(F.col("prop") * F.col("size")).alias("t"))
    weight = freqs.join(props, "cid").groupBy("path").agg(F.sum(F.col("prop") * F.col("freq")).alias("w"))
    got = cells.join(weight, "path").crossJoin(F.broadcast(total))
    return got.agg(F.sum(F.col("num_matched") * F.log(F.col("num_possible_x") * F.col("w") / F.col("t"))).alias("loglik"), F.sum("num_matched").alias("n"))


def em_steps(observed: DataFrame, freqs: DataFrame, sizes: DataFrame, steps: int) -> DataFrame:
    """cid, prop after a fixed number of EM steps from equal base shares, in DataFrame operations only.

    With base shares w_v = p_v L_v / sum and rates a = freq / L the likelihood is that of a mixture, so a step is two
    joins and two sums. ``observed`` has path and x (reads in usable cells).
    """
    sizes = checkpointed(sizes.select("cid", "size"))
    observed = checkpointed(observed)
    rates = checkpointed(freqs.join(sizes, "cid").join(observed, "path").select("cid", "path", (F.col("freq") / F.col("size")).alias("a"), "x"))
    n = rates.select("cid").distinct().agg(F.count("*").alias("k"))
    w = rates.select("cid").distinct().crossJoin(F.broadcast(n)).select("cid", (1 / F.col("k")).alias("w"))
    all_x = observed.join(rates.select("path").distinct(), "path", "left_semi").agg(F.sum("x").alias("total"))
    for _ in range(steps):
        part = rates.join(w, "cid").select("cid", "path", "x", (F.col("w") * F.col("a")).alias("r"))
        norm = part.groupBy("path").agg(F.sum("r").alias("z"))
        w = part.join(norm, "path").groupBy("cid").agg(F.sum(F.col("x") * F.col("r") / F.col("z")).alias("s")).crossJoin(F.broadcast(all_x)).select("cid", (F.col("s") / F.col("total")).alias("w"))
        w = checkpointed(w)  # one row for each variant
    p = w.join(sizes.select("cid", "size"), "cid").select("cid", (F.col("w") / F.col("size")).alias("p"))
    return p.crossJoin(F.broadcast(p.agg(F.sum("p").alias("all")))).select("cid", (F.col("p") / F.col("all")).alias("prop"))


class Fit:
    """A fitted model: proportions by cid, log-likelihood and criteria."""

    def __init__(self, cids: list[int], props: np.ndarray, loglik: float, n: int):
        self.cids, self.props, self.loglik, self.n = cids, props, loglik, n

    def criterion(self, kind: str) -> float:
        k = len(self.cids)
        return 2 * k - 2 * self.loglik if kind == "AIC" else math.log(max(self.n, 1)) * k - 2 * self.loglik


class Cells:
    """The aggregated cells of a model in memory: one row for each bin and sub-path, so their number depends on the
    variants and not on the reads."""

    def __init__(self, x: np.ndarray, possible: np.ndarray, freq: np.ndarray, sizes: np.ndarray, cids: list[int]):
        self.x, self.possible, self.freq, self.sizes, self.cids = x, possible, freq, sizes, cids

    def only(self, cids: list[int]) -> Cells:
        """The same cells for fewer variants; cells that none of them has go."""
        at = [self.cids.index(c) for c in cids]
        keep = self.freq[:, at].sum(1) > 0
        return Cells(self.x[keep], self.possible[keep], self.freq[keep][:, at], self.sizes[at], list(cids))

    def fit(self, cids: list[int], most: int = 5000, tol: float = 1e-11) -> Fit | None:
        """EM to convergence; None if some observed cell can't come from these variants."""
        at = [self.cids.index(c) for c in cids]
        f, size = self.freq[:, at], self.sizes[at]
        if (f.sum(1) == 0).any():
            return None
        a = f / size
        w = np.full(len(at), 1 / len(at))
        last = -np.inf
        for _ in range(most):
            r = a * w
            z = r.sum(1)
            now = float((self.x * np.log(z)).sum())
            if now - last < tol * max(1.0, abs(now)) and now >= last:
                break
            last = now
            w = (self.x[:, None] * r / z[:, None]).sum(0) / self.x.sum()
        p = w / size
        p /= p.sum()
        loglik = float((self.x * np.log(self.possible * (f @ p) / (size @ p))).sum())
        return Fit(list(cids), p, loglik, int(self.x.sum()))

    def select(self, kind: str = "BIC", fixed: frozenset[int] = frozenset(), zero: float = 1e-6) -> Fit:
        """Backward selection: drop variants of no share, then the single drop that lowers the criterion most, until
        none does. Variants that alone explain an observed cell, and fixed ones, stay."""
        now = self.fit(self.cids)
        while True:
            gone = {c for c, p in zip(now.cids, now.props, strict=True) if p < zero and c not in fixed}
            rest = [c for c in now.cids if c not in gone]
            if not gone or not rest or (new := self.fit(rest)) is None:
                break
            now = new
        while len(now.cids) > 1:
            tries = [t for c in now.cids if c not in fixed and (t := self.fit([d for d in now.cids if d != c])) is not None]
            best = min(tries, key=lambda t: (t.criterion(kind), t.cids), default=None)
            if best is None or best.criterion(kind) >= now.criterion(kind):
                return now
            now = best
        return now


def gather(cells: DataFrame, freqs: DataFrame, sizes: DataFrame) -> Cells:
    """Bring aggregated cells to the driver (see ``Cells`` for their bound)."""
    own = {r["cid"]: float(r["size"]) for r in sizes.select("cid", "size").collect()}
    cids = sorted(own)
    f: dict = {}
    for r in freqs.select("cid", "path", "freq").collect():
        f.setdefault(tuple(tuple(s) for s in r["path"]), {})[r["cid"]] = r["freq"]
    rows = [r for r in cells.select("path", "num_matched", "num_possible_x").collect() if tuple(tuple(s) for s in r["path"]) in f]
    rows.sort(key=lambda r: (tuple(tuple(s) for s in r["path"]), r["num_possible_x"]))
    freq = np.array([[f[tuple(tuple(s) for s in r["path"])].get(c, 0) for c in cids] for r in rows], float).reshape(len(rows), len(cids))
    return Cells(np.array([r["num_matched"] for r in rows], float), np.array([r["num_possible_x"] for r in rows], float), freq, np.array([own[c] for c in cids]), cids)


def split_merged(fit: Fit, groups: dict[int, list[int]]) -> dict[int, float]:
    """A representative's share in equal parts over the variants it stands for."""
    return {c: float(p) / len(groups[r]) for r, p in zip(fit.cids, fit.props, strict=True) for c in groups[r]}


def metropolis(cells: Cells, steps: int, burn: int, chain: int, seed: int = 12345, width: float = 0.15) -> np.ndarray:
    """Draws of proportions under a flat Dirichlet prior: random walk in log ratios, seeded by the chain's number."""
    rng = np.random.default_rng([seed, chain])
    k = len(cells.cids)
    y = rng.normal(0, 0.1, k)

    def density(y: np.ndarray) -> tuple[float, np.ndarray]:
        p = np.exp(y - y.max())
        p /= p.sum()
        rate = cells.possible * (cells.freq @ p) / (cells.sizes @ p)
        # the Jacobian of the log-ratio map turns the flat prior into the product of shares; y's own scale is held by a
        # weak normal
        return float((cells.x * np.log(np.maximum(rate, 1e-300))).sum() + np.log(np.maximum(p, 1e-300)).sum() - 0.5 * y.mean() ** 2), p

    now, p = density(y)
    out = []
    for i in range(burn + steps):
        new_y = y + rng.normal(0, width, k)
        new, new_p = density(new_y)
        if np.log(rng.random()) < new - now:
            y, now, p = new_y, new, new_p
        if i >= burn:
            out.append(p)
    return np.array(out)


def chains(spark, cells: Cells, steps: int, burn: int, count: int, seed: int = 12345) -> list[float]:
    """Mean proportions over ``count`` chains, each walked by a task of its own. Only means leave the tasks."""
    walk, shipped = metropolis, spark.sparkContext.broadcast(cells)  # a row for each bin and sub-path

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for chain in b.column(0).to_pylist():
                means = walk(shipped.value, steps, burn, chain, seed).mean(0)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(means)), pa.int32()), pa.array(means)], names=["i", "m"])

    got = spark.range(0, count, 1, count).mapInArrow(run, "i int, m double").groupBy("i").agg(F.avg("m").alias("m"))
    return [r["m"] for r in sorted(got.collect())]
