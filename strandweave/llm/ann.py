"""Approximate nearest neighbours by inner product: score-aware (anisotropic) quantisation with exact reranking.

A vector is cut into parts of ``PART`` dimensions and each part is replaced by one of 16 centres: a four-bit code. For
an inner product the part of the error that is parallel to the vector matters more than the part across it, so codes and
centres minimise ``ETA`` times the squared parallel residual plus the squared orthogonal residual (codes by coordinate
descent over the parts, centres by solving each part's normal equations). A query's products with all centres form
tables; two codes share a byte, so a scan adds one table entry for each byte. The best ``RERANK`` of each block by
that sum are scored exactly on the original vectors in double precision, and so is every row whose sum lies within
``SLACK`` standard errors of the scan (measured on those first rows) below the last place: dense groups lose no neighbours.

Every row is indexed. Rows are dealt into blocks of about ``BLOCK_ROWS`` and queries into blocks of about
``BLOCK_QUERIES`` by a hash of their id, and each pair of blocks is one task of bounded size, so hot vectors or labels
make no task larger. Codebooks are fitted on at most ``SAMPLE`` rows (a documented bound on the sample).

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those
whose length differs from the commonest (the shortest among equals); rows that repeat an id count as one, with the
vector that sorts first; a query's own id is no candidate; with fewer candidates than ``top`` all are returned; ties
go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, whole_numbers

PART, CENTRES = 2, 16
SAMPLE, ROUNDS, SWEEPS, SEED = 8000, 8, 2, 5
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 8192
TOP, RERANK, SLACK = 20, 160, 3.0
#: A threshold T for scores of unit vectors gives the weight (d - 1) * T^2 / (1 - T^2) of parallel errors.
THRESHOLD = 0.25


def eta_of(dims: int) -> float:
    return max(1.0, (dims - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def parts_of(x: np.ndarray) -> np.ndarray:
    """(rows, parts, PART) with zeros in places beyond the vector."""
    short = -x.shape[1] % (2 * PART)
    return np.pad(x, ((0, 0), (0, short))).reshape(len(x), -1, PART)


def assign(p: np.ndarray, centres: np.ndarray, eta: float, sweeps: int = SWEEPS) -> np.ndarray:
    """Codes that minimise the score-aware loss, part by part."""
    n, m, _ = p.shape
    norm2 = np.maximum((p**2).sum((1, 2)), 1e-30)
    codes = np.empty((n, m), np.int64)
    par = np.empty((n, m))
    for j in range(m):
        d = ((p[:, j, None, :] - centres[j][None]) ** 2).sum(2)
        codes[:, j] = d.argmin(1)
        par[:, j] = ((p[:, j] - centres[j][codes[:, j]]) * p[:, j]).sum(1)
    total = par.sum(1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - par[:, j]
            r = p[:, j, None, :] - centres[j][None]
            along = (r * p[:, j, None, :]).sum(2)
            loss = (r**2).sum(2) + (eta - 1) * (rest[:, None] + along) ** 2 / norm2[:, None]
            codes[:, j] = loss.argmin(1)
            par[:, j] = along[np.arange(n), codes[:, j]]
            total = rest + par[:, j]
    return codes


def fit_codebooks(x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Centres (parts, CENTRES, PART) and eta, from sample vectors."""
    p = parts_of(x.astype(float))
    n, m, _ = p.shape
    eta = eta_of(x.shape[1])
    rng = np.random.default_rng(SEED)
    pick = rng.choice(n, CENTRES, replace=n < CENTRES)
    centres = np.stack([p[pick, j] for j in range(m)])
    norm2 = np.maximum((p**2).sum((1, 2)), 1e-30)
    for turn in range(rounds):
        weight = 1.0 if turn < rounds // 2 else eta  # plain clusters first
        codes = assign(p, centres, weight, 0 if weight == 1 else 1)
        par = np.stack([((p[:, j] - centres[j][codes[:, j]]) * p[:, j]).sum(1) for j in range(m)], 1)
        total = par.sum(1)
        for j in range(m):
            rest = total - par[:, j]
            want = rest + (p[:, j] ** 2).sum(1)
            for c in range(CENTRES):
                own = codes[:, j] == c
                if not own.any():
                    centres[j, c] = p[rng.integers(n), j]
                    continue
                q, s = p[own, j], (weight - 1) / norm2[own]
                a = own.sum() * np.eye(PART) + (q * s[:, None]).T @ q
                centres[j, c] = np.linalg.solve(a, q.sum(0) + ((s * want[own])[:, None] * q).sum(0))
            par[:, j] = ((p[:, j] - centres[j][codes[:, j]]) * p[:, j]).sum(1)
            total = rest + par[:, j]
    return centres, eta


def encode(x: np.ndarray, centres: np.ndarray, eta: float, step: int = 4096) -> np.ndarray:
    """Packed codes: a byte for two parts."""
    out = [assign(parts_of(x[a : a + step].astype(float)), centres, eta) for a in range(0, len(x), step)]
    codes = np.concatenate(out) if out else np.zeros((0, len(centres)), np.int64)
    return (codes[:, 0::2] + CENTRES * codes[:, 1::2]).astype(np.uint8)


def scan(queries: np.ndarray, packed: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Approximate products (queries, rows): table entries added up over the bytes."""
    lut = np.einsum("qmd,mcd->qmc", parts_of(queries), centres).astype(np.float32)
    two = (lut[:, 1::2, :, None] + lut[:, 0::2, None, :]).reshape(len(queries), -1, CENTRES * CENTRES)
    out = np.zeros((len(queries), len(packed)), np.float32)
    for b in range(packed.shape[1]):
        out += two[:, b].take(packed[:, b].astype(np.intp), axis=1)
    return out


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, packed: np.ndarray, centres: np.ndarray, top: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block the ``top`` best after exact reranking: query ids, ids, exact scores. ``ids`` rise."""
    out = []
    step = max(1, 8_000_000 // max(1, len(ids)))
    for a in range(0, len(q), step):
        part, own = q[a : a + step], q_ids[a : a + step]
        rough = scan(part, packed, centres)
        same = np.searchsorted(ids, own)
        hit = np.flatnonzero((same < len(ids)) & (ids[np.minimum(same, len(ids) - 1)] == own))
        rough[hit, same[hit]] = -np.inf
        keep = min(rerank, len(ids))
        best = np.sort(np.argpartition(-rough, keep - 1, axis=1)[:, :keep], axis=1)
        exact = np.einsum("qrd,qd->qr", x[best].astype(float), part.astype(float))
        near = np.take_along_axis(rough, best, 1)
        exact[np.isneginf(near)] = -np.inf
        error = np.where(np.isneginf(near), 0, exact - np.where(np.isneginf(near), 0, near))
        # Rows whose sum is no further below the last place than the scan's error are scored exactly too.
        last = -np.partition(-exact, min(top, keep) - 1, axis=1)[:, min(top, keep) - 1]
        least = last - error.mean(1) - SLACK * error.std(1)
        more = rough >= least[:, None]
        np.put_along_axis(more, best, False, 1)
        for i in range(len(part)):
            extra = np.flatnonzero(more[i])
            place = np.concatenate([best[i][~np.isneginf(near[i])], extra])
            score = (x[place] * part[i]).sum(1)  # one way of adding up, so that equal vectors tie
            first = np.lexsort((place, -score))[:top]
            out.append((np.full(len(first), own[i]), ids[place[first]], score[first]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def usable(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, v) that take part."""
    sound = rows.filter("vec_id is not null and v is not null and size(v) > 0").filter(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    )
    sizes = sound.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return sound.filter(F.size("v") == (sizes[0]["d"] if sizes else 0))


def search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id and score of each query row's nearest rows. ``is_query`` is a condition on ``id_col``."""
    spark = rows.sparkSession
    whole_numbers(rows, id_col)
    given = usable(rows.select(rows[f"`{id_col}`"].cast("long").alias("vec_id"), rows[f"`{vector_col}`"].cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")))
    counts = given.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("q")).first()
    blocks, q_blocks = max(1, -(-counts["n"] // BLOCK_ROWS)), max(1, -(-(counts["q"] or 0) // BLOCK_QUERIES))
    sample = [r["v"] for r in given.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = spark.sparkContext.broadcast(fit_codebooks(np.array(sample, float)))  # a few kB for each 64 dimensions

    def index(batches):
        centres, eta = books.value
        for b in batches:
            v = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
            packed = encode(v, centres, eta)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in packed], pa.binary()), b.column(2)], names=["vec_id", "v", "code", "asks"])

    small_batches(spark)
    indexed = given.select("vec_id", "v", "asks").mapInArrow(index, "vec_id long, v array<double>, code binary, asks boolean")
    place = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    q_place = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).cast("int")
    slim = F.col("v").cast("array<double>")
    candidates = indexed.select("vec_id", slim.alias("v"), "code", F.lit(False).alias("asks"), place.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"))
    queries = given.filter("asks").select("vec_id", slim.alias("v"), F.lit(None).cast("binary").alias("code"), "asks", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), q_place.alias("q_block"))

    def within(group: pa.Table) -> pa.Table:
        centres, _ = books.value
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)

        def vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Rows by id; of repeated ids the vector that sorts first."""
            ids = t.column("vec_id").to_numpy()
            v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")
            if len(np.unique(ids)) < len(ids):
                order = np.lexsort((*v.T[::-1], ids))
                order = order[np.r_[True, np.diff(ids[order]) != 0]]
            return ids[order], v[order], order

        rows, wants = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
        if not rows.num_rows or not wants.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, x, order = vectors(rows)
        packed = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)[order]
        q_ids, q, _ = vectors(wants)
        a, b, s = nearest(q_ids, q, ids, x, packed, centres, top, rerank)
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    found = candidates.unionByName(queries).groupBy("block", "q_block").applyInArrow(within, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
