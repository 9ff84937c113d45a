"""Approximate nearest neighbours by a forest of random-projection trees.

The forest is fitted on a bounded sample: each tree has its own orthonormal directions, one a level, and each node splits at the median of what the sample holds there. Every vector is then put in its leaf of every tree. A query searches all trees through one priority queue of nodes, ordered by the squared distance to the node's cell so far, until the leaves that it took hold its budget of vectors; directions of a tree are orthogonal, so that distance is a true lower bound. Vectors meet queries leaf by leaf, cut into blocks of bounded size on both sides, and the candidates are ranked by their exact cosine.

The budget, as a multiple of all vectors, is calibrated: the least with which the nearest of sampled queries, known by brute force over the sample, are found with the wanted recall. More vectors than the sample holds need a smaller multiple, not a greater one.
"""

from __future__ import annotations

import dataclasses
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlake.llm.common import released, stage

NEIGHBOURS = 5
TREES = 8
SAMPLE = 32_768  # vectors that the forest is fitted on, about
ASKED = 256  # of these the queries that calibrate the budget
RECALL = 0.97  # of their neighbours that the budget must find
LEAF = 16  # vectors of the sample in a leaf, at least
DEPTH = 11  # levels of a tree, at most
WIDE = 1024  # vectors in a leaf on average that are worth another level
ROW_BLOCK, QUERY_BLOCK = 32_768, 4096  # vectors and queries that meet in a task, about
CLOSE = 1e-9  # scores this near to the last place are computed one by one before they are ranked
SEED = 12


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Each is first divided by its greatest component, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


@dataclasses.dataclass(frozen=True)
class Tree:
    """directions: one a level; cuts: thresholds of the nodes, level by level, node n's children being 2n + 1 and 2n + 2."""

    directions: np.ndarray
    cuts: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for along in self.directions:
            node = 2 * node + 1 + (x @ along > self.cuts[node])
        return node - len(self.cuts)


def grown(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    dims = sample.shape[1]
    directions = np.linalg.qr(rng.normal(size=(dims, dims)))[0].T[:depth]
    cuts, groups = [], [sample]
    for along in directions:
        split = []
        for own in groups:
            p = own @ along
            cut = float(np.median(p)) if len(p) else 0.0
            cuts.append(cut)
            split += [own[p <= cut], own[p > cut]]
        groups = split
    return Tree(directions, np.array(cuts))


@dataclasses.dataclass(frozen=True)
class Forest:
    """trees; sizes: vectors in each leaf, tree after tree."""

    trees: list[Tree]
    sizes: np.ndarray | None = None

    @property
    def leaves_each(self) -> int:
        return len(self.trees[0].cuts) + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """For each row its leaf in every tree, numbered through all trees."""
        return np.stack([t.leaves(x) + i * self.leaves_each for i, t in enumerate(self.trees)], 1)

    def search(self, q: np.ndarray) -> Iterator[int]:
        """Leaves by rising distance of the query to what is known of their cells, out of one queue for all trees."""
        inner = self.leaves_each - 1
        offsets = [(t.directions @ q).tolist() for t in self.trees]
        cuts = [t.cuts for t in self.trees]
        queue = [(0.0, i, 0, 0) for i in range(len(self.trees))]
        while queue:
            far, tree, node, level = heapq.heappop(queue)
            while node < inner:
                over = offsets[tree][level] - cuts[tree][node]
                other = 2 * node + 1 + (over <= 0)
                heapq.heappush(queue, (far + over * over, tree, int(other), level + 1))
                node, level = 4 * node + 3 - int(other), level + 1
            yield tree * self.leaves_each + node - inner

    def within(self, q: np.ndarray, budget: float) -> list[int]:
        """The leaves that the search takes until they hold ``budget`` vectors, counted once a tree; empty ones are left out."""
        out, held = [], 0
        for leaf in self.search(q):
            if self.sizes[leaf]:
                out.append(leaf)
                held += int(self.sizes[leaf])
                if held >= budget:
                    break
        return out


def fitted(sample: np.ndarray, total: int, k: int) -> tuple[Forest, float]:
    """A forest for ``total`` vectors, and the budget as a multiple of their number.

    A sample that holds everything calibrates on the very vectors it will search.
    """
    rng = np.random.default_rng(SEED)
    depth = max(0, min(DEPTH, sample.shape[1], int(np.log2(max(1, len(sample) / LEAF))), max(4, int(np.log2(max(1, total / WIDE))))))
    forest = Forest([grown(sample, depth, rng) for _ in range(TREES)])
    own = forest.leaves(sample)
    sizes = np.bincount(own.ravel(), minlength=TREES * forest.leaves_each)
    met = []
    for i in range(min(ASKED, len(sample))):
        scores = sample @ sample[i]
        scores[i] = -np.inf
        best = np.argsort(-scores)[: min(k, len(sample) - 1)]
        order = list(forest.search(sample[i]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        held = np.cumsum(sizes[order])
        met += held[place[own[best]].min(1)].tolist()  # what the queue had taken when it came to each neighbour
    share = float(np.quantile(met, RECALL, method="higher")) / len(sample) if met else float(TREES)
    return forest, share


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(rows: np.ndarray, lengths: np.ndarray, ids: list[list[int | None]], query: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[float, int | None]]:
    """The k best (score, id) of a block for one query; ``scores`` are rough, those that may matter are computed anew, each by itself, so that a pair's score never depends on its block."""
    last = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
    some = np.flatnonzero(scores >= last - CLOSE)
    exact = (rows[some] * query).sum(1) / (lengths[some] * np.sqrt((query * query).sum()))
    pairs = [(s, i) for s, n in zip(exact.tolist(), some.tolist(), strict=True) for i in ids[n]]
    return sorted(pairs, key=lambda p: (-p[0], p[1] is None, p[1]))[:k]


def neighbours(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, id, score): for each row of ``queries`` the ``k`` rows of largest cosine that the forest finds, itself left out; equal scores by the smaller id.

    ``queries`` are rows of ``rows``: a row's own id is no candidate of it. Vectors that are null, empty, zero or hold null or non-finite components take no part, on either side; shorter vectors count as continued by zeros. Of equal vectors the k + 1 smallest ids are searched for, which is as many as a result can hold; equal queries are searched once. Null ids are candidates, after all others of their score; queries of a null id have no row that is their own. Repeated rows are candidates once and queries as often as they occur. With fewer candidates than ``k`` all are returned; without any, or without queries, no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    # Single precision stays single where vectors are stored and shuffled; all is computed in double.
    kind = "float" if rows.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "double"

    def fine(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast(f"array<{kind}>")
        known = (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
        # -0.0 + 0.0 is 0.0, so that equal vectors have equal keys.
        return df.filter(F.coalesce(known, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda e: e + F.lit(0.0).cast(kind)).alias("v")).withColumn("h", F.xxhash64("v"))

    # Of a crowd of equal vectors each task keeps its k + 1 smallest ids before anything is shuffled.
    few = fine(rows).distinct().withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy(F.col("id").asc_nulls_last()))).filter(F.col("n") <= k + 1)
    points = few.groupBy("h", "v").agg(F.collect_list("id").alias("ids"), F.max(F.col("id").isNull()).alias("odd"))
    points = points.select("h", "v", F.when(F.col("odd"), F.concat("ids", F.array(F.lit(None).cast("long")))).otherwise(F.col("ids")).alias("ids"))
    points = stage(points.withColumn("key", F.monotonically_increasing_id()), "distinct-vectors")
    asked = stage(fine(queries), "queries")
    size = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    ddl = "query_id long, rank int, id long, score double"
    if not size.n:
        return spark.createDataFrame([], ddl)
    total, dims = size.n, size.dims
    padded = F.concat("v", F.array_repeat(F.lit(0.0).cast(kind), dims - F.size("v"))).alias("v")
    points = points.select("key", padded, "ids")
    # A share of the keys' hashes, so that no task sends more than its share of the sample.
    share = min(1.0, SAMPLE / total)
    chosen = points.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(2 * SAMPLE).toArrow()
    forest, budget = fitted(unit(_vectors(chosen.column(0).combine_chunks())), total, k)

    @released
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaves = forest.leaves(unit(_vectors(b.column(1))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(leaves.astype(np.int32)), pa.list_(pa.int32()))], names=["key", "v", "ids", "leaves"])

    placed = stage(points.mapInArrow(index, f"key long, v array<{kind}>, ids array<long>, leaves array<int>"), "leaves")
    sizes = np.zeros(len(forest.trees) * forest.leaves_each, np.int64)
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # no more rows than leaves
        sizes[r.leaf] = r["count"]
    forest, most = dataclasses.replace(forest, sizes=sizes), budget * total

    @released
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                taken = [forest.within(q, most) for q in unit(_vectors(b.column(1)))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(taken, pa.list_(pa.int32()))], names=["key", "v", "leaves"])

    distinct = asked.select("h", "v").distinct().withColumn("key", F.monotonically_increasing_id())
    distinct = stage(distinct, "distinct-queries")
    searched = stage(distinct.select("key", padded).mapInArrow(search, f"key long, v array<{kind}>, leaves array<int>"), "searches")
    visits = {r.leaf: r["count"] for r in searched.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}
    blocks = [(int(leaf), -(-int(sizes[leaf]) // ROW_BLOCK), -(-n // QUERY_BLOCK)) for leaf, n in visits.items()]
    if not blocks:
        return spark.createDataFrame([], ddl)
    cut = F.broadcast(spark.createDataFrame(blocks, "leaf int, row_parts int, query_parts int"))
    part = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    have = placed.select("key", "v", "ids", F.explode("leaves").alias("leaf")).join(cut, "leaf").select("leaf", part("row_parts").alias("a"), every("query_parts").alias("b"), "v", "ids")
    want = searched.select("key", "v", F.explode("leaves").alias("leaf")).join(cut, "leaf").select("leaf", every("row_parts").alias("a"), part("query_parts").alias("b"), "key", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids, scores = [], [], []
        if left.num_rows and right.num_rows:
            x, q = (_vectors(t.column("v").combine_chunks()) for t in (left, right))
            owners = left.column("ids").to_pylist()
            # Scaled by powers of two, which is exact, so that squares neither overflow nor vanish.
            x, q = (np.ldexp(m, -np.frexp(np.abs(m).max(1))[1][:, None]) for m in (x, q))
            lengths = np.sqrt((x * x).sum(1))
            ux, uq = (x / lengths[:, None]).T.copy(), unit(q)
            for at in range(0, len(q), 64):
                rough = uq[at : at + 64] @ ux
                for j, key in enumerate(right.column("key").slice(at, 64).to_pylist()):
                    for s, i in _best(x, lengths, owners, q[at + j], rough[j], k + 1):
                        keys.append(key)
                        ids.append(i)
                        scores.append(s)
        return pa.table({"key": pa.array(keys, pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    found = have.groupBy("leaf", "a", "b").cogroup(want.groupBy("leaf", "a", "b")).applyInArrow(meet, "key long, id long, score double")
    # The same pair comes from every tree in which it met, with the same score.
    ranked = found.groupBy("key", "id").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    top = ranked.withColumn("n", nth).filter(F.col("n") <= k + 1).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("found"))
    answers = distinct.join(top, "key").select("h", "v", "found")
    others = F.filter("found", lambda e: ~e["id"].eqNullSafe(F.col("query_id")) | F.col("query_id").isNull())
    out = asked.select(F.col("id").alias("query_id"), "h", "v").join(answers, ["h", "v"]).select("query_id", F.posexplode(F.slice(others, 1, k)))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("id"), F.col("col.score").alias("score"))
