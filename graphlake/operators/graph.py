"""Graph operators as loops of joins. Frontiers are distinct and written to the shared folder, so lineage stays one round long and nothing is collected; what a later round no longer reads is deleted."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from graphlake.config import LIMITS
from graphlake.functions.scalars import live_at
from graphlake.operators.staged import dropped, settled, shuffled


def reach(edges: DataFrame, seeds: DataFrame, depth: int = LIMITS.depth, reverse: bool = False) -> DataFrame:
    """edges (src, dst), seeds (seed) -> (seed, node, hops): what each seed reaches in at most ``depth`` hops, itself not, with the fewest hops."""
    step = edges.select(F.col("dst").alias("a"), F.col("src").alias("b")) if reverse else edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")).distinct()
    front = seen
    for k in range(1, depth + 1):
        new = front.join(step, front.node == step.a).select("seed", F.col("b").alias("node")).distinct()
        front = settled(new.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("hops > 0")


def impact(edges: DataFrame, seeds: DataFrame, depth: int = LIMITS.depth) -> DataFrame:
    """What calls a seed, directly or not."""
    return reach(edges, seeds, depth, reverse=True)


def live(rows: DataFrame, rels: list[str] | None = None, at: object = None) -> DataFrame:
    """Rows of the given relations that are valid at a time; None asks for all."""
    kept = rows.filter(F.col("rel").isin(rels)) if rels else rows
    return kept if at is None else kept.filter(live_at(F.lit(at)))


def incident(edges: DataFrame, ids: DataFrame, direction: str = "out", rels: list[str] | None = None, at: object = None) -> DataFrame:
    """ids (id) -> (of, edge columns): the edges that leave ("out") or reach ("in") each of them."""
    end = {"out": "src", "in": "dst"}[direction]
    return live(edges, rels, at).join(ids.select(F.col("id").alias("of")).distinct(), F.col("of") == F.col(end)).select("of", *edges.columns)


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 1, direction: str = "out", rels: list[str] | None = None, most: int = 256, nodes: DataFrame | None = None, at: object = None) -> DataFrame:
    """(seed, node, hops, truncated): the subgraph's nodes with the seed, at most ``most`` by hops and name.

    With nodes (node, valid_from, valid_to) only live ones are seeds or walked to; with ``at`` edges and nodes are those valid then.
    """
    kept = live(edges, rels, at)
    forth, back = kept.select("src", "dst"), kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    used = {"out": forth, "in": back, "both": forth.unionByName(back)}[direction]
    if nodes is not None:
        alive = live(nodes, at=at).select(F.col("node").alias("dst")).distinct()
        used = used.join(alive, "dst", "left_semi")
        seeds = seeds.join(alive, F.col("seed") == F.col("dst"), "left_semi")
    found = reach(used, seeds, depth).unionByName(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")))
    n = F.count("*").over(Window.partitionBy("seed"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("hops", "node"))
    return found.withColumn("truncated", n > most).withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def walked_edges(edges: DataFrame, found: DataFrame, depth: int = 1, direction: str = "out", rels: list[str] | None = None, at: object = None) -> DataFrame:
    """found, as of ``neighbours`` -> (seed, src, dst): the edges that were followed, those to nodes that were cut or are not live among them."""
    kept, at_node = live(edges, rels, at).select("src", "dst"), found.filter(F.col("hops") < depth).select("seed", "node")
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    parts = [at_node.join(kept, F.col("node") == F.col(end)).select("seed", "src", "dst") for end in ends]
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def _ranked(new: DataFrame) -> DataFrame:
    """new (seed, node, up) -> with rank: the order of the paths of one length from a seed, which is that of the paths before the last step, by their rank ``up``, then of the last node."""
    return new.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("up", "node")).cast("long"))


def paths_from(edges: DataFrame, seeds: DataFrame, depth: int = LIMITS.path_depth, rels: list[str] | None = None, nodes: DataFrame | None = None, at: object = None) -> DataFrame:
    """seeds (seed) -> (src, dst, path): the least of the shortest paths from each seed to all that it reaches within ``depth``, itself included; ``rels``, ``nodes`` and ``at`` as in ``neighbours``.

    The walk keeps a path as its rank among the seed's paths of that length and the rank of the path that it continues. A round's new rows meet what was seen where their seed is, in one shuffle. Paths are put together afterwards in one pass (``_written_out``).
    """
    step, seeds = live(edges, rels, at).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), seeds.select("seed").distinct()
    if nodes is not None:
        alive = live(nodes, at=at).select("node").distinct()
        step = step.join(alive, F.col("b") == F.col("node"), "left_semi")
        seeds = seeds.join(alive, F.col("seed") == F.col("node"), "left_semi")
    step, no = settled(step), F.lit(None).cast("long")
    front = settled(seeds.select("seed", F.col("seed").alias("node"), no.alias("up"), F.lit(1).cast("long").alias("rank"), F.lit(0).alias("hops")))
    seen = front
    for k in range(1, depth + 1):
        new = front.join(shuffled(step), F.col("node") == F.col("a")).select("seed", F.col("b").alias("node"), F.col("rank").alias("up"), F.lit(k).alias("hops"))
        both = new.unionByName(seen.select("seed", "node", no.alias("up"), "hops")).repartition("seed")
        least = both.groupBy("seed", "node").agg(F.min("up").alias("up"), F.min("hops").alias("hops")).filter(F.col("hops") == k)
        front = settled(_ranked(least).select(front.columns))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return _written_out(seen).select(F.col("seed").alias("src"), F.col("node").alias("dst"), "path")


def _written_out(walked: DataFrame) -> DataFrame:
    """walked (seed, node, up, rank, hops), ranks from 1 without gaps in each length -> (seed, node, path).

    One shuffle brings a seed's rows together, in the order of length and rank; a task keeps the nodes and ``up`` of one seed at a time, some 16 bytes for each node that it reaches, and looks a path up from its end, a whole batch at a time.
    """
    node = walked.schema["node"].dataType
    schema = StructType([walked.schema["seed"], walked.schema["node"], StructField("path", ArrayType(node))])
    rows = walked.select("seed", "node", "up", "rank", "hops").repartition("seed").sortWithinPartitions("seed", "hops", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, levels, parts = None, [], []
        for b in batches:
            seeds, hops = b.column("seed"), b.column("hops").to_numpy()
            ends = np.flatnonzero((hops[1:] != hops[:-1]) | pc.not_equal(seeds[1:], seeds[:-1]).to_numpy(zero_copy_only=False)) + 1
            for start, end in itertools.pairwise([0, *ends.tolist(), b.num_rows] if b.num_rows else []):
                if (now := seeds[start].as_py()) != seed:
                    seed, levels, parts = now, [], []
                k, nodes, ups = int(hops[start]), b.column("node")[start:end], pc.fill_null(b.column("up")[start:end], 0).to_numpy()
                if k > len(levels):
                    levels.append((pa.concat_arrays([n for n, _ in parts]), np.concatenate([u for _, u in parts])))
                    parts = []
                parts.append((nodes, ups))
                steps, at = [nodes], ups
                for n, u in reversed(levels):
                    steps.append(n.take(pa.array(at - 1)))
                    at = u[at - 1]
                n = end - start
                across = np.arange(n * (k + 1)).reshape(k + 1, n)[::-1].T.ravel()
                path = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (k + 1), pa.int32()), pa.concat_arrays(steps).take(pa.array(across)))
                yield pa.RecordBatch.from_arrays([seeds[start:end], nodes, path], names=["seed", "node", "path"])

    return rows.mapInArrow(run, schema)


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = LIMITS.path_depth, rels: list[str] | None = None, nodes: DataFrame | None = None, at: object = None) -> DataFrame:
    """pairs (src, dst) -> (src, dst, path): the nodes of a shortest directed path, the least of them in the order of its nodes; no row if there is none within ``depth``.

    Two frontiers meet in the middle: one walks forth from each distinct source, one back from each distinct target, and in each round the smaller one takes a step. A path of the length reached so far has a node on both frontiers. No paths are carried: forth a node keeps the rank of the least path to it (as of ``paths_from``), back the least next node. The front that has fewer rows a seed is dealt to the open pairs, so that only what belongs to a pair meets; of those nodes the least rank decides. Pairs that have met are followed no further, and the paths of those that did are put together at the end. ``rels``, ``nodes`` and ``at`` as in ``neighbours``.
    """
    step = live(edges, rels, at).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    pairs = pairs.select("src", "dst").distinct()
    if nodes is not None:
        alive = live(nodes, at=at).select("node").distinct()
        # A path's first node is a source, which is live too.
        step = step.join(alive, F.col("b") == F.col("node"), "left_semi").join(alive, F.col("a") == F.col("node"), "left_semi")
        pairs = pairs.join(alive, F.col("src") == F.col("node"), "left_semi").join(alive, F.col("dst") == F.col("node"), "left_semi")
    step, pairs = settled(step), settled(pairs)
    found = pairs.filter("src = dst").select("src", "dst", F.array("src").alias("path"))
    open_ = settled(pairs.filter("src <> dst"))
    ends = ("src", "dst")
    start = lambda end: open_.select(F.col(end).alias("seed"), F.col(end).alias("node")).distinct()
    # forth: (seed, node, up, rank) of each length, back: (seed, node, next)
    sides = [[settled(start("src").withColumn("rank", F.lit(1).cast("long")))], [settled(start("dst"))]]
    seeds = sizes = [s[0].count() for s in sides]
    met = []
    wanted = lambda k: sides[k][-1].join(open_.select(F.col(ends[k]).alias("seed")).distinct(), "seed", "left_semi")
    for _ in range(depth):
        side = 0 if sizes[0] <= sizes[1] else 1
        known = functools.reduce(DataFrame.unionByName, [f.select("seed", "node") for f in sides[side]])
        if side == 0:
            new = wanted(0).join(shuffled(step), F.col("node") == F.col("a")).select("seed", F.col("b").alias("node"), "rank").groupBy("seed", "node").agg(F.min("rank").alias("up"))
            new = _ranked(new.join(shuffled(known), ["seed", "node"], "left_anti"))
        else:
            new = wanted(1).join(shuffled(step), F.col("node") == F.col("b")).select("seed", F.col("a").alias("node"), F.col("b").alias("next")).groupBy("seed", "node").agg(F.min("next").alias("next"))
            new = new.join(shuffled(known), ["seed", "node"], "left_anti")
        sides[side].append(settled(new))
        forth, back = sides[0][-1].select(F.col("seed").alias("src"), "node", "rank"), sides[1][-1].select(F.col("seed").alias("dst"), "node")
        if sizes[0] * seeds[1] < sizes[1] * seeds[0]:
            both = open_.join(shuffled(forth), "src").join(shuffled(back), ["dst", "node"])
        else:
            both = open_.join(shuffled(back), "dst").join(shuffled(forth), ["src", "node"])
        least = both.groupBy("src", "dst").agg(F.min("rank").alias("rank"))
        hit = settled(least.withColumn("forth", F.lit(len(sides[0]) - 1)).withColumn("back", F.lit(len(sides[1]) - 1)))
        met.append(hit)
        before, open_ = open_, settled(open_.join(hit, ["src", "dst"], "left_anti"))
        dropped(before)
        sizes = [wanted(k).count() for k in (0, 1)]
        if not min(sizes):
            break
    return found.unionByName(_joined(met, sides)) if met else found


def _joined(met: list[DataFrame], sides: list[list[DataFrame]]) -> DataFrame:
    """met (src, dst, rank, forth, back): pairs with the rank of the path to where they met, and the lengths of both halves -> (src, dst, path), by one step of the halves at a time."""
    kind = sides[0][0].schema["node"].dataType.simpleString()
    rows = functools.reduce(DataFrame.unionByName, met).withColumn("path", F.array().cast(f"array<{kind}>"))
    for k in range(len(sides[0]) - 1, -1, -1):
        level = sides[0][k] if k else sides[0][0].withColumn("up", F.lit(0).cast("long"))
        level = level.select(F.col("seed").alias("src"), "rank", "node", "up")
        # Halves of k steps begin here; longer ones have come to their k-th node.
        now = rows.filter(F.col("forth") >= k).join(shuffled(level), ["src", "rank"]).select("src", "dst", F.col("up").alias("rank"), "forth", "back", F.concat(F.array("node"), "path").alias("path"))
        rows = settled(rows.filter(F.col("forth") < k).select(now.columns).unionByName(now))
    for k in range(len(sides[1]) - 1, 0, -1):
        level = sides[1][k].select(F.col("seed").alias("dst"), F.col("node").alias("at"), "next")
        now = rows.filter(F.col("back") >= k).withColumn("at", F.element_at("path", -1)).join(shuffled(level), ["dst", "at"])
        now = now.select("src", "dst", "rank", "forth", "back", F.concat("path", F.array("next")).alias("path"))
        rows = settled(rows.filter(F.col("back") < k).select(now.columns).unionByName(now))
    return rows.select("src", "dst", "path")


def shortest_path(edges: DataFrame, src: object, dst: object, depth: int = LIMITS.path_depth) -> DataFrame:
    """One row (path) for one pair; no row if there is none within ``depth``."""
    kind = edges.schema["src"].dataType.simpleString()
    pair = edges.sparkSession.createDataFrame([(src, dst)], f"src {kind}, dst {kind}")
    return shortest_paths(edges, pair, depth).select("path")


# ---- components ----


#: A node of more edges than this, and than a ten-thousandth of all, is a hub: there are at most 20 000 of them.
HUB = 100_000


def _with_low(rows: DataFrame, low: DataFrame, hub: int) -> DataFrame:
    """rows (u, v) with their u's m; rows of hubs, which would meet in one task, get it from a broadcast."""
    hubs = F.broadcast(low.filter(F.col("n") > hub).select("u", "m"))
    others = rows.join(hubs.select("u"), "u", "left_anti").join(low.filter(F.col("n") <= hub).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(others)


def _star_round(edges: DataFrame, hub: int) -> DataFrame:
    """edges (u > v): larger neighbours move to a node's least neighbour, then all others to each node's least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    large = _with_low(both.filter("v > u"), low, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_low(large, low, hub).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def weak_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the least node of each weakly connected component, for all nodes of an edge.

    Star rounds halve the length of paths, so their number grows with its logarithm; raises if ``rounds`` don't suffice.
    """
    edges = settled(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    now = settled(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == mark or not state.n:
            break
        mark = state
        before, now = now, settled(_star_round(now, max(HUB, 2 * state.n // 10_000)))
        dropped(before)
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _trim(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) whose ends both have an edge in and an edge out: others lie on no cycle."""
    outs, ins = edges.select(F.col("src").alias("n")).distinct(), edges.select(F.col("dst").alias("n")).distinct()
    alive = settled(outs.join(ins, "n", "left_semi"))
    out = settled(edges.join(alive.withColumnRenamed("n", "src"), "src", "left_semi").join(alive.withColumnRenamed("n", "dst"), "dst", "left_semi"))
    dropped(alive)
    return out


def _compressed(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, segments, members, rings): chains of nodes with one edge in and one out become one edge each.

    segments (src, dst, last): the edge that stands for a chain, named by its last node; members (node, last): a chain's nodes; rings (node, label): chains without an end. Pointers to the end double their reach each round.
    """
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outs"), F.min("dst").alias("to"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins"))
    inner = settled(outs.join(ins, "node").filter("ins = 1 and outs = 1").select("node"))
    chain = settled(outs.join(inner, "node", "left_semi").select("node", "to", F.col("node").alias("last"), F.col("node").alias("low")).join(inner.select(F.col("node").alias("to"), F.lit(True).alias("more")), "to", "left").select("node", "to", "last", "low", F.coalesce("more", F.lit(False)).alias("more")))
    for _ in range(max(1, inner.count().bit_length() + 1)):
        if chain.filter("more").isEmpty():
            break
        ahead = chain.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("last").alias("last2"), F.col("low").alias("low2"), F.col("more").alias("more2"))
        met = chain.filter("more").join(ahead, "to").select("node", F.col("to2").alias("to"), F.col("last2").alias("last"), F.least("low", "low2").alias("low"), F.col("more2").alias("more"))
        before, chain = chain, settled(chain.filter("not more").select("node", "to", "last", "low", "more").unionByName(met))
        dropped(before)
    # What still goes on after so many rounds goes round in a ring, all of which its pointers have seen.
    rings = chain.filter("more").select("node", F.col("low").alias("label"))
    ended = chain.filter("not more").select("node", "to", "last")
    kept = edges.join(inner.select(F.col("node").alias("src")), "src", "left_anti")
    entry = kept.join(ended.select(F.col("node").alias("dst"), "to", "last"), "dst", "left").select("src", F.coalesce("to", "dst").alias("dst"), "last")
    entry = settled(entry)
    segments = entry.filter("last is not null")
    return settled(entry.filter("src <> dst").select("src", "dst").distinct()), segments, ended.select("node", "last"), rings


def _pivot_sets(edges: DataFrame) -> DataFrame:
    """(node, forth, back): what the node of most edges in and out reaches, and what reaches it, both walked in the same rounds."""
    outs, ins = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o")), edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    pivot = outs.join(ins, "node").orderBy(F.desc(F.col("o") * F.col("i")), "node").select("node").limit(1)
    step = settled(edges.select(F.lit(0).alias("way"), F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.lit(1).alias("way"), F.col("dst").alias("a"), F.col("src").alias("b"))))
    front = settled(pivot.select("node", F.explode(F.array(F.lit(0), F.lit(1))).alias("way")))
    seen = front
    while not front.isEmpty():
        new = front.join(step, (F.col("node") == F.col("a")) & (front.way == step.way)).select(F.col("b").alias("node"), step.way).distinct()
        front = settled(new.join(seen, ["node", "way"], "left_anti"))
        seen = seen.unionByName(front)
    out = settled(seen.groupBy("node").agg((F.min("way") == 0).alias("forth"), (F.max("way") == 1).alias("back")))
    dropped(step, seen)
    return out


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, label): each node with the least node that reaches it."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    labels = settled(nodes.select("node", F.col("node").alias("label"), F.lit(True).alias("moved")))
    while True:
        low = edges.join(labels.filter("moved").select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("low"))
        less = F.coalesce(F.col("low") < F.col("label"), F.lit(False))
        before, labels = labels, settled(labels.drop("moved").join(low, "node", "left").select("node", F.when(less, F.col("low")).otherwise(F.col("label")).alias("label"), less.alias("moved")))
        dropped(before)
        if labels.filter("moved").isEmpty():
            return labels.select("node", "label")


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti").join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti")


def _within(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges whose ends are in the same part (node, part); nodes without a part are one."""
    one = edges.join(parts.select(F.col("node").alias("src"), F.col("part").alias("p")), "src", "left")
    return one.join(parts.select(F.col("node").alias("dst"), F.col("part").alias("q")), "dst", "left").filter(F.col("p").eqNullSafe(F.col("q"))).select("src", "dst")


def _core(left: DataFrame, n: int) -> list[DataFrame]:
    """(node, label) tables of the strong components of a graph of ``n`` edges. While a pivot's component is large, it is found by its forward and backward sets, and what they part is parted; then by colours, whose roots are pivots all at once."""
    found, big = [], True
    while n:
        if big:
            sets = _pivot_sets(left)
            done = sets.filter("forth and back").select("node")
            least = done.agg(F.min("node").alias("label"), F.count("*").alias("size")).first()
            found.append(done.select("node", F.lit(least.label).alias("label")))
            rest = _within(_without(left, done), sets.select("node", F.when(F.col("forth"), 1).otherwise(2).alias("part")))
            big = least.size * 10 > n
        else:
            colour = _coloured(left)
            own = settled(_within(left, colour.withColumnRenamed("label", "part")))
            front = done = colour.filter("node = label")
            while not front.isEmpty():
                back = own.join(front.select(F.col("node").alias("dst"), "label"), "dst").select(F.col("src").alias("node"), "label").distinct()
                front = settled(back.join(done, ["node", "label"], "left_anti"))
                done = done.unionByName(front)
            done = settled(done)
            found.append(done)
            rest = _without(own, done)
        left, n = _shrunk(rest)
    return found


def _shrunk(edges: DataFrame) -> tuple[DataFrame, int]:
    """Trimmed as long as a twentieth or more goes each time, and the number of edges."""
    left = settled(edges)
    n = left.count()
    while n:
        before, left = left, _trim(left)
        dropped(before)
        m = left.count()
        if m * 20 > n * 19:
            return left, m
        n = m
    return left, n


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, label): nodes of strongly connected components of two or more; label is the component's least node.

    Ends are trimmed and chains compressed in turn, so long paths and trees go in a number of rounds that grows with the logarithm of their length; forward and backward sets of pivots part what is left. Then chains whose two ends lie in one component join it, the last compressed first.
    """
    left, n = _shrunk(edges.filter("src <> dst").select("src", "dst").distinct())
    levels, parts = [], []
    while n:
        left, segments, members, rings = _compressed(left)
        levels.append((segments, members))
        parts.append(rings)
        left, m = _shrunk(left)
        if m * 20 > n * 19:
            n = m
            break
        n = m
    parts += _core(left, n)
    nothing = edges.select(F.col("src").alias("node"), F.col("src").alias("label")).limit(0)
    labels = settled(functools.reduce(DataFrame.unionByName, parts, nothing))
    for segments, members in reversed(levels):
        # A chain from a node back to itself makes a component of a node that may have had none.
        at = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))  # noqa: E731, B023
        ends = segments.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
        hit = settled(ends.filter("src = dst or src_label = dst_label").select("src", "last", F.coalesce("src_label", "src").alias("label")))
        new = hit.select(F.col("src").alias("node"), "label").unionByName(members.join(hit.select("last", "label"), "last").select("node", "label"))
        labels = settled(labels.unionByName(new).distinct())
    named = labels.groupBy("label").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    return labels.join(named, "label").select("node", F.col("least").alias("label"))


def cycles(edges: DataFrame, most: int = LIMITS.cycles) -> DataFrame:
    """(label, size, members): the largest cycles first; members in order."""
    return strong_components(edges).groupBy("label").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")).orderBy(F.desc("size"), "label").limit(most)


def tiers(edges: DataFrame) -> DataFrame:
    """(node, tier): the longest path to a sink; edges within a cycle are left out, so that members of a cycle are ranked by what lies below it.

    Nodes are peeled off from the sinks on. What is kept for each node is how many of its edges lead to nodes that still stand, and the greatest tier met so far; a round joins the nodes that fell last to the edges that enter them and adds to a log, which is worked into that table once it has grown to half of it. Only if nodes are left that nothing peels are their cycles looked for. Each round peels a node or more, or raises.
    """
    edges = settled(edges.select("src", "dst").distinct())
    left = settled(edges.filter("src <> dst"))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    opened = lambda e: e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("open"))
    base = settled(opened(left).withColumn("up", F.lit(0)))
    size, log, grown = base.count(), [], 0
    front = settled(nodes.join(base, "node", "left_anti").select("node", F.lit(0).alias("tier")))
    fallen, kept = [front], [front]

    def standing() -> DataFrame:
        """The table with its log worked in, without what has fallen."""
        if not log:
            return base
        sums = functools.reduce(DataFrame.unionByName, log).groupBy("node").agg(F.sum("n").alias("n"), F.max("up").alias("high"))
        return base.join(sums, "node", "left").select("node", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.greatest("up", F.coalesce("high", F.lit(0))).alias("up")).filter("open > 0")

    while True:
        while not front.isEmpty():
            hits = left.join(front, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), (F.max("tier") + 1).alias("up"))
            now = hits.join(standing().select("node", "open", F.col("up").alias("high")), "node")
            now = settled(now.select("node", "n", F.greatest("up", "high").alias("up"), (F.col("open") - F.col("n")).alias("left")))
            log.append(now.select("node", "n", "up"))
            front = now.filter("left = 0").select("node", F.col("up").alias("tier"))
            fallen.append(front)
            grown += now.count()
            if 2 * grown > size or len(log) >= 16:
                before = [base, *log[:-1], *kept]
                base, done = settled(standing()), settled(functools.reduce(DataFrame.unionByName, fallen[:-1]))
                dropped(*before)
                size, log, grown, fallen, kept = base.count(), [], 0, [done, front], [done, now]
        base, log, grown = settled(standing()), [], 0
        if base.isEmpty():
            return functools.reduce(DataFrame.unionByName, fallen)
        stuck = _within(left.join(base.select(F.col("node").alias("src")), "src", "left_semi"), base.select("node", F.lit(1).alias("part")))
        loops = settled(strong_components(stuck))
        if loops.isEmpty():
            raise RuntimeError("nodes are left that neither fall nor lie on a cycle")
        inside = _within(stuck.join(loops.select(F.col("node").alias("src")), "src", "left_semi"), loops.select("node", F.col("label").alias("part")))
        left = settled(stuck.join(inside, ["src", "dst"], "left_anti"))
        base = settled(base.select("node", "up").join(opened(left), "node", "left").select("node", F.coalesce("open", F.lit(0)).alias("open"), "up"))
        front = settled(base.filter("open = 0").select("node", F.col("up").alias("tier")))
        fallen.append(front)
        base = settled(base.filter("open > 0"))
        size = base.count()
