"""Centroid clustering of integer vectors by partial-distance search.

Components become integers, so all sums are exact and the result is the same however rows are dealt. Each round is one pass over the staged vectors: a task adds up squared differences a few dimensions at a time, those of high variance first, and gives a centroid up once its sum is strictly above the best so far; what survives all dimensions is compared. Tasks hand on one sum a centroid and dimension; only the new centroids come to the driver.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import released, stage, unstage

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
STEP = 8  # dimensions that are added before a centroid is given up or kept
PLAIN = 1 << 27  # components up to here keep 64 squared differences within 64 bits; larger ones are summed as Python integers
FAR = 1 << 62  # components beyond are taken as this
LONG = (1 << 63) - 1  # distances beyond are returned as this


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its nearest centroid, the smaller of equally near ones, and the squared distance. Columns stand in the order in which they are added."""
    x, c = (a if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= PLAIN else a.astype(object) for a in (x, centroids))
    rows = np.arange(len(x))
    heads = np.stack([((x[:, :STEP] - own[:STEP]) ** 2).sum(1) for own in c], 1)
    to = heads.argmin(1)  # the first guess, measured in full
    best = heads[rows, to] + ((x[:, STEP:] - c[to, STEP:]) ** 2).sum(1)
    for k, own in enumerate(c):
        left = rows[(to != k) & (heads[:, k] <= best)]
        sums = heads[left, k]
        for at in range(STEP, x.shape[1], STEP):
            sums = sums + ((x[left, at : at + STEP] - own[at : at + STEP]) ** 2).sum(1)
            stays = sums <= best[left]
            left, sums = left[stays], sums[stays]
            if not len(left):
                break
        nearer = (sums < best[left]) | ((sums == best[left]) & (k < to[left]))
        left, sums = left[nearer], sums[nearer]
        best[left], to[left] = sums, k
    return to, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _order(kept: DataFrame, dims: int) -> np.ndarray:
    """Dimensions by falling variance; the order costs or saves time, the result is the same in any."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares, n = np.zeros(dims), np.zeros(dims), 0
        for b in batches:
            x = _matrix(b.column(0), dims).astype(np.float64)
            total, squares, n = total + x.sum(0), squares + (x * x).sum(0), n + len(x)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(dims), pa.int32()), "n": pa.array(np.full(dims, n), pa.int64()), "s": total, "q": squares})

    sums = kept.select("v").mapInArrow(run, "dim int, n long, s double, q double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    variance = {r.dim: r.q / max(r.n, 1) - (r.s / max(r.n, 1)) ** 2 for r in sums.collect()}
    return np.array(sorted(range(dims), key=lambda d: (-variance.get(d, 0.0), d)))


def _moved(kept: DataFrame, centroids: list[list[int]], order: np.ndarray) -> list[list[int]]:
    """Each centroid at the floor of its vectors' mean; one without vectors stays."""
    dims, around = len(order), np.array(centroids, np.int64)[:, order]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(around), dims), object), np.zeros(len(around), np.int64)
        for b in batches:
            x = _matrix(b.column(0), dims)
            to, _ = nearest(x[:, order], around)
            if np.abs(x).max(initial=0) > PLAIN:
                x = x.astype(object)
            for k in np.unique(to):
                sums[k] += x[to == k].sum(0)
                counts[k] += (to == k).sum()
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "k": pa.array(np.repeat(some, dims), pa.int32()),
                "dim": pa.array(np.tile(np.arange(dims), len(some)), pa.int32()),
                "n": pa.array(np.repeat(counts[some], dims), pa.int64()),
                "s": pa.array([decimal.Decimal(int(s)) for s in sums[some].ravel()], pa.decimal128(38, 0)),
            }
        )

    added = kept.select("v").mapInArrow(run, "k int, dim int, n long, s decimal(38,0)").groupBy("k", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = [list(c) for c in centroids]
    for r in added.collect():
        out[r.k][r.dim] = int(r.s) // r.n
    return out


def _assigned(kept: DataFrame, centroids: list[list[int]], order: np.ndarray) -> DataFrame:
    around = np.array(centroids, np.int64)[:, order]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to, far = nearest(_matrix(b.column(1), len(order))[:, order], around)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(to, pa.int32()), pa.array([min(int(d), LONG) for d in far], pa.int64())], names=["id", "cluster", "distance"])

    return kept.mapInArrow(run, "id long, cluster int, distance long")


def clustered(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row per vector of ``dims`` components, none of them null or non-finite.

    Components are floor(scale * x). The first centroids are the ``k`` vectors with the least SHA-256 of ``seed:id`` in hex, null ids last, those of one id by their components; fewer vectors are fewer centroids. Other vectors, null and empty ones among them, give no row; repeated rows each count and give a row; of equally near centroids the smaller number holds; no vectors give no rows; other columns are ignored. Integers beyond 2^62 are taken as 2^62, distances and inertias that don't fit a long as the greatest long.
    """
    spark = rows.sparkSession
    v = F.col(vector_col).cast("array<double>")
    fine = (F.size(v) == dims) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = F.transform(v, lambda e: F.greatest(F.least(F.floor(e * float(scale)), F.lit(FAR)), F.lit(-FAR)))
    kept = stage(rows.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v")), "integer-vectors")
    token = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    centroids = [list(r.v) for r in kept.orderBy(token.asc_nulls_last(), "v").limit(k).collect()]
    if not centroids:
        return kept.select("id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    order = _order(kept, dims)
    for _ in range(rounds):
        centroids = _moved(kept, centroids, order)
    out = stage(_assigned(kept, centroids, order), "clusters")
    unstage(spark, kept)
    inertia = {r.cluster: int(r.d) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole_inertia = min(sum(inertia.values()), LONG)
    told = [(c, min(d, LONG), whole_inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in inertia.items()]
    return out.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, any_value(x) AS x, min([list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), k]) AS near FROM v, c{r} GROUP BY rid)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS c FROM (SELECT near[2] AS k, dim, sum(e) AS s, count(*) AS n FROM (SELECT near, unnest(x) AS e, generate_subscripts(x, 1) AS dim FROM a{r}) GROUP BY near[2], dim) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(CAST(m{r}.c AS BIGINT[]), c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.k = m{r}.k)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: CAST(floor({SCALE} * e) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, x) - 1 AS BIGINT) AS k, x AS c FROM v QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, x) <= {CENTROIDS}),
{(',' + chr(10)).join(steps)}
SELECT v.vec_id, CAST(near[2] AS INTEGER) AS cluster, CAST(near[1] AS BIGINT) AS distance, CAST(sum(near[1]) OVER (PARTITION BY near[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(near[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN v ON v.rid = a.rid JOIN c{ROUNDS} AS c ON c.k = near[2]
"""


ORACLE = _oracle()
