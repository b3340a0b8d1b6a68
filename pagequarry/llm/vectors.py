"""Clustering of vectors around centroids in exact integers, with Hamerly's bounds.

Every vector keeps one upper bound on the distance to its own centroid and one lower bound on the distance to any other.
When centroids move, the upper bound grows by its own centroid's drift and the lower one shrinks by the largest drift of the
others. Where the upper bound is below the lower one, or below half the distance from the own centroid to the next one, the
assignment stands. Else the distance to the own centroid is worked out, and, if that doesn't settle it, all distances are, in
integers. Bounds are doubles, widened by SLACK beyond any rounding, and decide only strict cases; ties are always settled by
integers, for the smaller number.

Vectors and bounds are one table, rewritten a round without a shuffle, so a lost executor costs its tasks only; tables of
earlier rounds are deleted as soon as the next one is written. Sums by centroid are added up in each task. Only centroids,
a parameter's number of rows, are collected and shipped.

Left out: vectors of another length, null ones, and those with a null, infinite or NaN component. Components beyond 131,071
in size are clamped to it, so that squared distances fit a long. A repeated row is a vector of its own; a null vec_id is
hashed as the empty id. Where fewer vectors than centroids are kept, there are as many centroids as vectors; equal ones
stay apart, and the later of two equal centroids is left without vectors. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import remove, shared_dir, stage

DIMENSIONS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
LIMIT = (1 << 27) - 1
#: Relative widening of bounds, some thousand times the error of the sums behind them.
SLACK = 1e-9
ROWS = 8192


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (bytes of little-endian 32-bit integers, floor(scale * x)) of the vectors that count."""
    x = F.col("embedding")
    whole = (F.size(x) == dimensions) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(e.cast("double") * scale))).cast("int"))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"vec_id": part["vec_id"], "v": [np.asarray(a, dtype="<i4").tobytes() for a in part["v"]]})

    packed = vectors.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("string"), v.alias("v")).mapInPandas(pack, "vec_id string, v binary")
    return packed.withColumn("vec_id", F.col("vec_id").cast(vectors.schema["vec_id"].dataType))


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors of the smallest hashes of seed and vec_id; ties by their components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = rows.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([np.frombuffer(r["v"], dtype="<i4") for r in found], dtype=np.int64)


def matrix(column, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<i4").reshape(-1, dimensions).astype(np.int64)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of v to all centroids."""
    out = np.empty((len(v), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        d = v - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class Geometry:
    """What a round knows of the centroids: how far each moved, the farthest move of the others, half the way to the next."""

    def __init__(self, before: np.ndarray, now: np.ndarray):
        self.now = now
        self.drift = np.sqrt(np.einsum("ij,ij->i", now - before, now - before).astype(float)) * (1 + SLACK)
        other = np.where(np.eye(len(now), dtype=bool), -1.0, self.drift[None, :])
        self.others = np.maximum(other.max(axis=1), 0.0)
        apart = np.sqrt(squared(now, now).astype(float))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 * (1 - SLACK)

    def assign(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cluster and bounds of rows against the centroids as they are now, and which rows took a full scan."""
        own, upper, lower = own.copy(), (upper + self.drift[own]) * (1 + SLACK), np.maximum((lower - self.others[own]) * (1 - SLACK), 0.0)
        bar = np.maximum(lower, self.half[own])
        open_ = np.flatnonzero(~(upper < bar))
        if len(open_):
            d = v[open_] - self.now[own[open_]]
            upper[open_] = np.sqrt(np.einsum("ij,ij->i", d, d).astype(float)) * (1 + SLACK)
            open_ = open_[~(upper[open_] < bar[open_])]
        if len(open_):
            all_ = squared(v[open_], self.now)
            best = all_.argmin(axis=1)  # the first of equal ones
            own[open_] = best
            upper[open_] = np.sqrt(all_[np.arange(len(best)), best].astype(float)) * (1 + SLACK)
            all_[np.arange(len(best)), best] = np.iinfo(np.int64).max
            lower[open_] = np.sqrt(all_.min(axis=1).astype(float)) * (1 - SLACK) if len(self.now) > 1 else np.inf
        scanned = np.zeros(len(v), dtype=bool)
        scanned[open_] = True
        return own, upper, lower, scanned


_STATE = "vec_id string, v binary, cluster int, upper double, lower double, scanned boolean"


def assigned(rows: DataFrame, geometry: Geometry, dimensions: int = DIMENSIONS, first: bool = False) -> DataFrame:
    """Rows (vec_id as text, v and, unless first, cluster and bounds) with cluster and bounds by the centroids of geometry."""
    shared = rows.sparkSession.sparkContext.broadcast(geometry)  # k centroids

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for whole in parts:
            for i in range(0, len(whole), ROWS):
                part = whole.iloc[i : i + ROWS]
                n = len(part)
                own = np.zeros(n, dtype=np.int64) if first else part["cluster"].to_numpy(dtype=np.int64)
                upper, lower = (np.full(n, np.inf), np.zeros(n)) if first else (part["upper"].to_numpy(), part["lower"].to_numpy())
                own, upper, lower, scanned = g.assign(matrix(part["v"], dimensions), own, upper, lower)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "v": part["v"].to_numpy(), "cluster": own, "upper": upper, "lower": lower, "scanned": scanned})

    return rows.mapInPandas(run, _STATE)


def moved_centroids(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at its vectors' mean, rounded down; where it has none, as it was. Sums are made in each task."""
    k, dimensions = centroids.shape

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((k, dimensions), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for whole in parts:
            for i in range(0, len(whole), ROWS):
                part = whole.iloc[i : i + ROWS]
                v, own = matrix(part["v"], dimensions), part["cluster"].to_numpy()
                for j in np.unique(own):
                    total[j] += v[own == j].sum(axis=0)
                    n[j] += int((own == j).sum())
        yield pd.DataFrame({"cluster": np.arange(k)[n > 0], "n": n[n > 0], "total": list(total[n > 0])})

    sums = rows.select("v", "cluster").mapInPandas(add, "cluster int, n long, total array<long>")
    parts = sums.select("cluster", "n", F.posexplode("total").alias("place", "x"))
    totals = parts.groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in totals.collect():  # k * dimensions rows
        out[r["cluster"], r["place"]] = int(r["x"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, v, cluster, upper, lower, scanned) of the vectors that count after `rounds` moves, and the centroids."""
    kind = vectors.schema["vec_id"].dataType
    spark, at = vectors.sparkSession, f"{shared_dir(vectors.sparkSession)}/vectors-{uuid.uuid4().hex}"
    quantised(vectors, dimensions, scale).withColumn("vec_id", F.col("vec_id").cast("string")).write.parquet(f"{at}/start")
    rows = spark.read.schema("vec_id string, v binary").parquet(f"{at}/start")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.selectExpr("vec_id", "v", "0 cluster", "0D upper", "0D lower", "false scanned").withColumn("vec_id", F.col("vec_id").cast(kind)), centroids
    before = centroids
    for r in range(rounds + 1):
        assigned(rows, Geometry(before, centroids), dimensions, first=r == 0).write.parquet(f"{at}/{r}")
        remove(spark, f"{at}/{r - 1}" if r else f"{at}/start")
        rows = spark.read.schema(_STATE).parquet(f"{at}/{r}")
        if r < rounds:
            before, centroids = centroids, moved_centroids(rows, centroids)
    return rows.withColumn("vec_id", F.col("vec_id").cast(kind)), centroids


def digest(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of clustered rows."""
    spark, kind = rows.sparkSession, rows.schema["vec_id"].dataType
    shared = spark.sparkContext.broadcast(centroids)

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for part in parts:
            d = matrix(part["v"], c.shape[1]) - c[part["cluster"].to_numpy()] if len(part) else np.zeros((0, 1), dtype=np.int64)
            yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "cluster": part["cluster"].to_numpy(), "distance": np.einsum("ij,ij->i", d, d)})

    found = stage(rows.select(F.col("vec_id").cast("string"), "v", "cluster").mapInPandas(measure, "vec_id string, cluster int, distance long"), "vectors-found")
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    most = (1 << 63) - 1
    facts = [(j, min(sums.get(j, 0), most), min(sum(sums.values()), most), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(F.col("vec_id").cast(kind), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
