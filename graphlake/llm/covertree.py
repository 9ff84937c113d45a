"""Embedding near-duplicates by dual traversal of cover trees.

Vectors of unit length are compared by chord length, so cosine >= c becomes distance <= sqrt(2 - 2c). The top of the tree is grown over all vectors, a level at a time: a node of more than BLOCK vectors gets pivots, a net of halved radius over a bounded sample of its own vectors, each vector goes to its nearest pivot, and the child's covering radius is measured over all that came. Pairs of nodes descend the same levels: children of a surviving pair survive if their centres are no further apart than both radii and the threshold, so what is pruned holds no link. Pairs of the nodes that are left, each of bounded size, are dealt to tasks; a task builds the two cover trees, again with halving radii, and walks pairs of nodes: a pair beyond the two covering radii plus the threshold is dropped, a pair within it is taken as a whole, all others are split, down to single vectors, which are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import few_rows, stage
from graphlake.llm.components import components

BLOCK = 8192  # vectors of a node that is not split any further, at most
SAMPLE = 4096  # vectors of a node that its pivots are chosen from, about, by a hash
FAN = 64  # pivots of a node, at most
LEVELS = 30  # beyond, what is still too large is sliced by a hash; its slices keep the node's radius, so nothing is lost
SALTS = 16  # parts that the members of one component are dealt to when it gets its name
TILE = 512  # rows of a matrix of distances that is held at once
SLACK = 1e-6  # vectors this close are not split further; chord lengths near 0 lose half their digits
ROUNDING = 1e-7  # by which bounds are loosened; pairs in between are compared


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Each is first divided by its greatest component, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chord lengths between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of a the index of its nearest in b and the distance."""
    to, far = np.zeros(len(a), np.int64), np.zeros(len(a))
    for k in range(0, len(a), TILE):
        d = distances(a[k : k + TILE], b)
        to[k : k + TILE] = own = d.argmin(1)
        far[k : k + TILE] = d[np.arange(len(d)), own]
    return to, far


def net(x: np.ndarray, radius: float, step: int = 256) -> np.ndarray:
    """Indexes of a net: points over ``radius`` apart that cover all others within it."""
    left, centres = np.arange(len(x)), []
    while left.size:
        head, tail = left[:step], left[step:]
        d = distances(x[head], x[head])
        new: list[int] = []
        for i in range(len(head)):
            if not new or d[i, new].min() > radius:
                new.append(i)
        centres.append(head[new])
        left = tail[(distances(x[tail], x[head[new]]) > radius).all(1)] if tail.size else tail
    return np.concatenate(centres) if centres else np.zeros(0, np.int64)


def pivots(x: np.ndarray, most: int) -> np.ndarray:
    """The finest of the nested nets of halving radii that has at most ``most`` points; if the next is too fine, its first points join."""
    chosen, radius = np.zeros(min(1, len(x)), np.int64), 2.0
    for _ in range(40):
        radius /= 2
        inner = np.concatenate([chosen, np.setdiff1d(np.arange(len(x)), chosen)])
        finer = inner[net(x[inner], radius)]
        if len(finer) >= most:
            return finer[:most]
        if len(finer) == len(x):
            return finer
        chosen = finer
    return chosen


def cover(x: np.ndarray, radius: float, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A net as ``net`` makes it, and for each point a centre within the radius and its distance, out of the same distances."""
    left, centres = np.arange(len(x)), []
    to, far, base = np.zeros(len(x), np.int64), np.zeros(len(x)), 0
    while left.size:
        head, tail = left[:step], left[step:]
        d = distances(x[head], x[head])
        new: list[int] = []
        for i in range(len(head)):
            if not new or d[i, new].min() > radius:
                new.append(i)
        centres.append(head[new])
        to[head], far[head] = base + d[:, new].argmin(1), d[:, new].min(1)
        near, gap = nearest(x[tail], x[head[new]])
        hit = gap <= radius
        to[tail[hit]], far[tail[hit]] = base + near[hit], gap[hit]
        left, base = tail[~hit], base + len(new)
    return np.concatenate(centres), to, far


class Node:
    """A centre, its descendants, and their greatest distance from it; a leaf is one vector, or equal ones. Children are made when they are first asked for."""

    __slots__ = ("_kids", "_x", "centre", "level", "own", "radius")

    def __init__(self, x: np.ndarray, own: np.ndarray, centre: int, radius: float, level: float) -> None:
        self._x, self.own, self.centre, self.radius, self.level, self._kids = x, own, centre, radius, level, None

    @property
    def kids(self) -> list[Node]:
        if self._kids is None:
            self._kids = []
            if len(self.own) > 1 and self.radius > SLACK:
                level, order = min(self.level, self.radius) / 2, np.concatenate([[self.centre], self.own[self.own != self.centre]])
                centres, to, far = cover(self._x[order], level)
                if len(centres) > 1:  # else rounding: nothing could be told apart
                    by = np.argsort(to, kind="stable")
                    for k, part in enumerate(np.split(by, np.searchsorted(to[by], np.arange(1, len(centres))))):
                        self._kids.append(Node(self._x, order[part], int(order[centres[k]]), float(far[part].max()), level))
        return self._kids


class Pairs:
    """Links found so far: how many other vectors each vector of a block pair is linked to, and who is joined."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, cosine: float) -> None:
        self.x, self.weight, self.cosine, self.limit = x, weight, cosine, float(np.sqrt(2 - 2 * cosine))
        self.links, self.least = np.zeros(len(x), np.int64), np.arange(len(x))

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Vectors at a and b belong together: ``least`` keeps for each the least that it is joined with."""
        while True:
            x, y = self.least[a], self.least[b]
            if not (apart := x != y).any():
                return
            np.minimum.at(self.least, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(up := self.least[self.least], self.least):
                self.least = up

    def edges(self) -> list[tuple[int, int]]:
        own = np.flatnonzero(self.least != np.arange(len(self.least)))
        return list(zip(own.tolist(), self.least[own].tolist(), strict=True))

    def _whole(self, a: Node, b: Node) -> None:
        """Every vector of a is linked with every one of b (or with every other of a)."""
        if a is b:
            self.links[a.own] += self.weight[a.own].sum() - self.weight[a.own]
        else:
            self.links[a.own] += self.weight[b.own].sum()
            self.links[b.own] += self.weight[a.own].sum()
        every = a.own if a is b else np.concatenate([a.own, b.own])
        self._join(np.full(len(every), every[0]), every)

    def _compare(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of vectors, exactly."""
        for k in range(0, len(i), 1 << 14):
            a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            hit = np.einsum("nd,nd->n", self.x[a], self.x[b]) / np.sqrt(np.einsum("nd,nd->n", self.x[a], self.x[a]) * np.einsum("nd,nd->n", self.x[b], self.x[b])) >= self.cosine
            a, b = a[hit], b[hit]
            np.add.at(self.links, a, self.weight[b])
            np.add.at(self.links, b, self.weight[a])
            self._join(a, b)

    def _exact(self, a: Node, b: Node) -> None:
        """Both nodes are leaves, of one vector or of vectors that rounding can't tell apart; a tile of them at a time."""
        for k in range(0, len(a.own), TILE):
            i, j = (m.ravel() for m in np.meshgrid(a.own[k : k + TILE], b.own, indexing="ij"))
            keep = i < j if a is b else slice(None)
            self._compare(i[keep], j[keep])

    def walk(self, a: Node, b: Node) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a is b and not a.kids:
                if len(a.own) > 1:
                    (self._whole if 2 * a.radius <= self.limit - ROUNDING else self._exact)(a, a)
                continue
            every = b.kids or [b]
            radii, at = np.array([n.radius for n in every]), self.x[[n.centre for n in every]]
            lone = np.array([len(n.own) == 1 for n in every])
            mine = a.kids or [a]
            for k in range(0, len(mine), TILE):
                part = mine[k : k + TILE]
                d = distances(self.x[[n.centre for n in part]], at)
                reach = np.array([n.radius for n in part])[:, None] + radii[None, :]
                near = d <= reach + self.limit + ROUNDING
                if a is b:
                    near = np.triu(near, k)
                    own = np.arange(len(part))
                    near[own, own + k] = True
                    d[own, own + k] = 0.0
                i, j = np.nonzero(near)
                within = (d + reach)[i, j] <= self.limit - ROUNDING
                lone_part = np.array([len(n.own) == 1 for n in part])
                single = lone[j] & lone_part[i]
                if a is b:
                    single &= i + k != j
                single_i, single_j = i[single], j[single]
                self._compare(np.array([part[t].own[0] for t in single_i.tolist()], np.int64), np.array([every[t].own[0] for t in single_j.tolist()], np.int64))
                for p, q, w in zip(i[~single].tolist(), j[~single].tolist(), within[~single].tolist(), strict=True):
                    m, n = part[p], every[q]
                    if w:
                        if m is not n or len(m.own) > 1:
                            self._whole(m, n)
                    elif m is n or m.kids or n.kids:
                        todo.append((m, n))
                    else:
                        self._exact(m, n)


def linked(vectors: np.ndarray, weight: np.ndarray, first: np.ndarray, second: np.ndarray | None, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links between the vectors at ``first`` and at ``second``, or within ``first`` if that is None: each vector's number of them, and edges that join what they join."""
    x = unit(vectors)
    found, roots = Pairs(x, weight, cosine), []
    for own in (first, second):
        if own is not None:
            centre = own[int(np.argmax(x[own] @ x[own].mean(0)))]
            roots.append(Node(x, own, int(centre), float(nearest(x[own], x[[centre]])[1].max()), 4.0))
    if second is None:
        found.walk(roots[0], roots[0])
    elif float(distances(x[[roots[0].centre]], x[[roots[1].centre]])[0, 0]) <= roots[0].radius + roots[1].radius + found.limit + ROUNDING:
        found.walk(*roots)
    return found.links, found.edges()


VECTOR = "k1 long, k2 long, v array<double>, n long, node string, far double"


def _split(placed: DataFrame, big: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """placed (as VECTOR), big (node, size) of it -> the pivots (parent, node, centre) of the big nodes, and their vectors placed anew."""
    side = F.broadcast(big) if few_rows(big) else big
    sampled = placed.join(side, "node").filter(F.pmod(F.xxhash64(F.lit(level), "k1", "k2"), F.greatest(F.lit(1), F.floor(F.col("size") / SAMPLE))) == 0)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        node, most = group["node"].iloc[0], int(min(FAN, max(2, -(-2 * int(group["size"].iloc[0]) // BLOCK))))
        x = unit(np.stack(group.sort_values(["k1", "k2"])["v"].to_numpy()).astype(np.float64))
        centres = x[pivots(x, most)] if level < LEVELS else x[:1]
        if len(centres) == 1:  # nothing to tell them by: slices
            centres = np.repeat(centres, -(-int(group["size"].iloc[0]) // BLOCK), axis=0)
        return pd.DataFrame({"parent": node, "node": [f"{node}/{k}" for k in range(len(centres))], "at": range(len(centres)), "centre": list(centres)})

    chosen = stage(sampled.select("node", "size", "k1", "k2", "v").groupBy("node").applyInPandas(choose, "parent string, node string, at long, centre array<double>"), "pivots")
    # Pivots travel with the vectors of their node, first in each slice of it, so no task needs those of other nodes.
    salts = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("long")
    rows = placed.join(side, "node").select("node", F.pmod(F.xxhash64("k1", "k2", F.lit(level)), salts).alias("salt"), F.lit(1).alias("kind"), "k1", "k2", "v", "n")
    lead = chosen.join(big.withColumnRenamed("node", "parent"), "parent").select(F.col("parent").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("at").alias("k1"), F.lit(0).cast("long").alias("k2"), F.col("centre").alias("v"), F.lit(0).cast("long").alias("n"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                node, salt, kind = keys[lo]
                part = b.slice(lo, hi - lo)
                v = part.column(5).flatten().to_numpy().reshape(hi - lo, -1)
                if (node, salt) != at:
                    at, centres = (node, salt), []
                if kind == 0:
                    centres.append(v)
                else:
                    c = np.concatenate(centres)
                    if len(c) > 1 and (c[0] == c[1:]).all():
                        to = part.column(3).to_numpy() % len(c)
                        far = distances(unit(v), c[:1])[:, 0]
                    else:
                        to, far = nearest(unit(v), c)
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (3, 4, 5, 6)), pa.array([f"{node}/{t}" for t in to.tolist()]), pa.array(far)], names=["k1", "k2", "v", "n", "node", "far"])
                lo = hi

    key = ["node", "salt", "kind", "k1"]
    return chosen, rows.unionByName(lead).repartition("node", "salt").sortWithinPartitions(*key).mapInArrow(place, VECTOR)


def _node_pairs(classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(placed, pairs): the vectors of ``classes`` in nodes of at most BLOCK, and the pairs (a, b) of nodes, a = b among them, that may hold a link. Vectors of different lengths start in different nodes."""
    limit = float(np.sqrt(2 - 2 * cosine))
    placed = classes.select("k1", "k2", "v", "n", F.col("dims").cast("string").alias("node"), F.lit(4.0).alias("far"))
    nodes = stage(placed.groupBy("node").agg(F.count("*").alias("size")).withColumn("centre", F.lit(None).cast("array<double>")).withColumn("radius", F.lit(4.0)), "nodes")
    pairs = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    level = 0
    while not (big := nodes.filter(F.col("size") > BLOCK).select("node", "size")).isEmpty():
        chosen, moved = _split(placed, big, level)
        side = F.broadcast(big.select("node")) if few_rows(big) else big.select("node")
        placed = stage(moved.unionByName(placed.join(side, "node", "left_anti").select("k1", "k2", "v", "n", "node", "far")), "placed-vectors")
        measured = placed.groupBy("node").agg(F.count("*").alias("size"), F.max("far").alias("radius"))
        new = chosen.join(measured, "node").select("parent", "node", "size", "centre", "radius")
        kids = stage(new.unionByName(nodes.join(side, "node", "left_anti").select(F.col("node").alias("parent"), "node", "size", "centre", "radius")), "nodes")
        one, two = (kids.select(F.col("parent").alias(p), F.col("node").alias(f"{p}_node"), F.col("centre").alias(f"{p}_centre"), F.col("radius").alias(f"{p}_radius")) for p in "ab")
        dot = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
        met = (F.col("a_node") == F.col("b_node")) | (apart <= F.col("a_radius") + F.col("b_radius") + limit + ROUNDING)
        both = pairs.join(one, "a").join(two, "b").filter((F.col("a") != F.col("b")) | (F.col("a_node") <= F.col("b_node")))
        pairs = stage(both.filter(met).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "node-pairs")
        nodes = kids.drop("parent")
        level += 1
    return placed, pairs


def _links(classes: DataFrame, cosine: float) -> DataFrame:
    """(k1, k2, links) of classes, to be summed, and (k1, k2, b1, b2) of classes that are joined; staged."""
    placed, pairs = _node_pairs(classes, cosine)
    turns = pairs.select(F.col("a").alias("node"), "a", "b").unionByName(pairs.filter("a <> b").select(F.col("b").alias("node"), "a", "b"))
    dealt = placed.join(turns, "node").select("a", "b", "node", "k1", "k2", "v", "n")

    def match(group: pd.DataFrame) -> pd.DataFrame:
        one, two = group["a"].iloc[0], group["b"].iloc[0]
        node = group["node"].to_numpy()
        second = np.flatnonzero(node == two) if one != two else None
        links, edges = linked(np.stack(group["v"].to_numpy()).astype(np.float64), group["n"].to_numpy(), np.flatnonzero(node == one), second, cosine)
        k1, k2 = group["k1"].to_numpy(), group["k2"].to_numpy()
        some = np.flatnonzero(links)
        u, v = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64)
        none = lambda n: [None] * n
        return pd.DataFrame(
            {
                "k1": np.r_[k1[some], k1[u]].astype(np.int64),
                "k2": np.r_[k2[some], k2[u]].astype(np.int64),
                "links": pd.array([*links[some].tolist(), *none(len(u))], "Int64"),
                "b1": pd.array([*none(len(some)), *k1[v].tolist()], "Int64"),
                "b2": pd.array([*none(len(some)), *k2[v].tolist()], "Int64"),
            }
        )

    return stage(dealt.groupBy("a", "b").applyInPandas(match, "k1 long, k2 long, links long, b1 long, b2 long"), "vector-links")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of ``rows``.

    n_links counts the other rows whose cosine with this one is ``cosine`` or more, repeats included; component_id is the least id that links reach; kept: it is this row's. Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own component; finite ones of any size are compared. Vectors of different lengths don't link. Rows of one id are rows of their own. No rows give no rows; other columns are ignored. Equal vectors are one class: they are compared once and counted by their number.
    """
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.size("v") > 0
    fine &= ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
    own = own.withColumn("ok", F.coalesce(fine, F.lit(False)))
    # Two hashes of 64 bits name a class.
    key = [F.when(F.col("ok"), F.xxhash64(F.lit(k), "v")).alias(f"k{k}") for k in (1, 2)]
    own = own.select("id", "ok", "v", F.when(F.col("ok"), F.size("v")).alias("dims"), *key)
    classes = stage(own.filter("ok").groupBy("k1", "k2").agg(F.first("v").alias("v"), F.first("dims").alias("dims"), F.min("id").alias("first"), F.count("*").alias("n")), "vector-classes")
    found = _links(classes, cosine)
    links = found.filter("links is not null").groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    pair = lambda a, b: F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))
    roots = components(found.filter("links is null").select(pair("k1", "k2").alias("u"), pair("b1", "b2").alias("v")))
    named = classes.select("k1", "k2", "first", "n", pair("k1", "k2").alias("node")).join(roots, "node", "left").join(links, ["k1", "k2"], "left")
    named = stage(named.select("k1", "k2", "first", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vector-roots")
    # A component may hold most classes, so its members are dealt by salt when they get its name.
    joined = named.filter("root is not null")
    least = joined.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    labels = joined.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(least, ["root", "salt"]).select("k1", "k2", "component_id", "n_links")
    labels = labels.unionByName(named.filter("root is null").select("k1", "k2", F.col("first").alias("component_id"), "n_links"))
    out = own.filter("ok").select("id", "k1", "k2").join(labels, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = own.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM e
      WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""
