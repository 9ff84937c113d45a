"""Exact nearest vectors by cosine, without comparing all with all.

Vectors lie in the cell of their nearest pivot, with their distance to it. By the triangle inequality a cell can hold nothing nearer to a query than the query's distance to the pivot less the cell's radius, and a vector nothing nearer than the difference of both distances. A query first meets the nearest cells that hold enough vectors; the last place it fills there bounds what is worth meeting in the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.operators.staged import settled

PIVOTS = 512  # at most; about the root of the number of vectors
ROW_BLOCK, QUERY_BLOCK = 32_768, 4096  # vectors and queries that meet in a task, about
ROUNDING = 1e-7  # by which distances of unit vectors are loosened: chords near 0 lose half their digits


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _fine(df: DataFrame, name: str, v: str) -> tuple[DataFrame, DataFrame]:
    """(vectors that have a direction, zero vectors), each (name, v); null ones and those with null or non-finite components take no part."""
    x = F.col(v).cast("array<double>")
    sound = (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    own = df.filter(F.coalesce(sound, F.lit(False))).select(name, x.alias("v"))
    some = F.exists("v", lambda e: e != 0)
    return own.filter(some), own.filter(~some)


def _met(placed: DataFrame, asked: DataFrame, sizes: dict[int, int], k: int, digits: int, kinds: tuple[str, str], block: int) -> DataFrame:
    """placed (cell, far, id, v), asked (query, v, cells, near, bound) -> (query, id, score, seen): the k best of each meeting, and a row without id that says how many vectors were compared."""
    spark = placed.sparkSession
    visits = {r.cell: r["count"] for r in asked.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}  # no more rows than pivots
    parts = [(c, max(1, -(-sizes[c] // ROW_BLOCK)), -(-n // block)) for c, n in visits.items()]
    cut = F.broadcast(spark.createDataFrame(parts, "cell int, rows int, queries int"))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    have = placed.join(cut, "cell").select("cell", part("id", "rows").alias("a"), every("queries").alias("b"), "far", "id", "v")
    turns = asked.select("query", "v", "bound", F.explode(F.arrays_zip("cells", "near")).alias("e")).select("query", "v", "bound", F.col("e.cells").alias("cell"), F.col("e.near").alias("near"))
    want = turns.join(cut, "cell").select("cell", every("rows").alias("a"), part("query", "queries").alias("b"), "query", "v", "bound", "near")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, ids, scores, seen = [], [], [], []
        if left.num_rows and right.num_rows:
            x, far, names = _unit(_matrix(left.column("v").combine_chunks())), left.column("far").to_numpy(), left.column("id").to_pylist()
            q, near, bound = _unit(_matrix(right.column("v").combine_chunks())), right.column("near").to_numpy(), right.column("bound").to_numpy()
            for n in range(len(q)):
                some = np.flatnonzero(np.abs(far - near[n]) <= bound[n])
                rows.append(n)
                ids.append(None)
                scores.append(None)
                seen.append(len(some))
                s = np.round((x[some] * q[n]).sum(1), digits)
                if len(s) > k:
                    keep = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                    some, s = some[keep], s[keep]
                for score, name in sorted(((-a, names[b]) for a, b in zip(s.tolist(), some.tolist(), strict=True)))[:k]:
                    rows.append(n)
                    ids.append(name)
                    scores.append(-score)
                    seen.append(0)
        return pa.table({"query": right.column("query").combine_chunks().take(pa.array(rows, pa.int64())), "id": pa.array(ids, left.schema.field("id").type), "score": pa.array(scores, pa.float64()), "seen": pa.array(seen, pa.int64())})

    return settled(have.groupBy("cell", "a", "b").cogroup(want.groupBy("cell", "a", "b")).applyInArrow(meet, f"query {kinds[0]}, id {kinds[1]}, score double, seen long"))


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def meetings(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame | None:
    """(query, id, score, seen) of all meetings of vectors and queries that have a direction; None if there are none of one side."""
    kinds = queries.schema["query"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    own, asks = settled(_fine(vectors, "id", "v")[0]), settled(_fine(queries, "query", "q")[0])
    n = own.count()
    if not n or asks.isEmpty():
        return None
    dims = own.agg(F.max(F.size("v"))).first()[0]
    padded = F.concat("v", F.array_repeat(F.lit(0.0), dims - F.size("v"))).alias("v")
    most = max(1, min(PIVOTS, int(n**0.5)))
    # A share of the ids' hashes, so that no task sends more than its share.
    chosen = own.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, 2 * most / n) * (1 << 30)) + 1).select(padded).limit(4 * PIVOTS).toArrow()
    pivots = _unit(_matrix(chosen.column(0).combine_chunks()))[:most] if chosen.num_rows else np.eye(1, dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _apart(_unit(_matrix(b.column(1))), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=["id", "v", "cell", "far"])

    placed = settled(own.select("id", padded).mapInArrow(place, f"id {kinds[1]}, v array<double>, cell int, far double"))
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}
    numbers = np.array(sorted(cells))
    sizes, low, high = (np.array([cells[c][f] for c in numbers.tolist()]) for f in ("n", "low", "high"))

    def bounds(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance to each pivot, what lies nearest in its cell at best)."""
        d = _apart(_unit(v), pivots[numbers])
        return d, np.maximum(0.0, np.maximum(d - high, low - d))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            taken, near = [], []
            for d, least in zip(*bounds(_matrix(b.column(1))), strict=True) if b.num_rows else ():
                order = np.lexsort((d, least))
                stop = int(np.searchsorted(sizes[order].cumsum(), k)) + 1
                taken.append(numbers[order[:stop]])
                near.append(d[order[:stop]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(taken, pa.list_(pa.int32())), pa.array(near, pa.list_(pa.float64()))], names=["query", "v", "cells", "near"])

    asked = settled(asks.select("query", padded).mapInArrow(first, f"query {kinds[0]}, v array<double>, cells array<int>, near array<double>"))
    count = dict(zip(numbers.tolist(), sizes.tolist(), strict=True))
    found = _met(placed, asked.withColumn("bound", F.lit(4.0)), count, k, digits, kinds, block)
    # A rounded score may stand for one half a place lower.
    last = _best(found.filter("id is not null"), k).groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("last"))
    reach = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("last") - 10.0**-digits))) + ROUNDING, F.lit(4.0))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            taken, near = [], []
            met, reach_ = b.column("cells").to_pylist(), b.column("bound").to_numpy()
            for n, (d, least) in enumerate(zip(*bounds(_matrix(b.column("v"))), strict=True) if b.num_rows else ()):
                some = np.flatnonzero((least <= reach_[n] + ROUNDING) & ~np.isin(numbers, met[n]))
                taken.append(numbers[some])
                near.append(d[some])
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("v"), b.column("bound"), pa.array(taken, pa.list_(pa.int32())), pa.array(near, pa.list_(pa.float64()))], names=["query", "v", "bound", "cells", "near"])

    again = asked.join(last, "query", "left").select("query", "v", "cells", reach.alias("bound"))
    again = settled(again.mapInArrow(others, f"query {kinds[0]}, v array<double>, bound double, cells array<int>, near array<double>"))
    if again.filter(F.size("cells") > 0).isEmpty():
        return found
    return found.unionByName(_met(placed, again, count, k, digits, kinds, block))


def search(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """vectors (id, v), queries (query, q), names of either without repeats -> (query, id, score, rank): the ``k`` largest cosines, rounded, equal ones by id.

    A zero vector has cosine 0 with all. Vectors that are null, empty or hold null or non-finite components take no part on either side; shorter ones count as continued by zeros.
    """
    (own, flat), (asks, none) = _fine(vectors, "id", "v"), _fine(queries, "query", "q")

    def flatly(of: DataFrame, ids: DataFrame) -> DataFrame:
        """Each of ``of`` with the first k ids, at 0."""
        first = [F.lit(r.id) for r in ids.orderBy("id").limit(k).collect()]
        kind = vectors.schema["id"].dataType.simpleString()
        return of.select("query", F.explode(F.array(*first).cast(f"array<{kind}>")).alias("id"), F.lit(0.0).alias("score"))

    # The first zero vectors for all queries, the first of all vectors for zero queries.
    parts = [flatly(asks, flat.select("id")), flatly(none, own.select("id").unionByName(flat.select("id")))]
    met = meetings(vectors, queries, k, digits, block)
    found = parts[0].unionByName(parts[1])
    return _best(found if met is None else found.unionByName(met.filter("id is not null").select("query", "id", "score")), k).select("query", "id", "score", "rank")
