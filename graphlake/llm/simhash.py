"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its segments. Manhattan distance between two such vectors never exceeds the Hamming distance of the fingerprints, so a range join on a unit grid of these vectors finds every pair within the wanted distance. Each fingerprint visits the grid points within half the distance (rounded up) of its own; two fingerprints in range share such a point, and one point, picked by a rule that both know, handles the pair. Points that more than CROWDED fingerprints visit are not handled as they are: those fingerprints meet again on a grid of twice as many segments, up to FINEST, where what is still crowded is dealt to tasks by pairs of slices. Within a task, segments are split in two once more before fingerprints are compared exactly.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import few_rows, released, stage
from graphlake.llm.components import components

CROWDED = 1 << 15  # visits of a grid point that one task handles, at most
FINEST = 16  # segments of the finest grid
SALTS = 16  # parts that the members of one component are dealt to when it gets its name
BRUTE = 1 << 20  # pairs that are compared without another split


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint: a bit is 1 if more than half of the shingles' XXH64 have it. Null or no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - size + 1
    if n <= 1:
        return digest(joined, seed)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    first, last = (ends - lens)[:n].tolist(), ends[size - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[k : k + 65536], last[k : k + 65536], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, *more: Column) -> DataFrame:
    """(id, fp) and the long columns ``more``: fp is the fingerprint's 64 bits as a signed long."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["id", "fp", *b.schema.names[2:]])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more)
    kind = docs.schema[id_col].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, fp long" + "".join(f", {c} long" for c in own.columns[2:]))


def _counts(fps: np.ndarray, parts: int) -> np.ndarray:
    width = 64 // parts
    mask = np.uint64((1 << width) - 1)
    return np.stack([np.bitwise_count((fps >> np.uint64(width * i)) & mask) for i in range(parts)], axis=1).astype(np.int16)


def _ball(dims: int, radius: int) -> list[tuple[int, ...]]:
    return [d for d in itertools.product(range(-radius, radius + 1), repeat=dims) if sum(map(abs, d)) <= radius]


def _pairs(a: np.ndarray, b: np.ndarray, distance: int, parts: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of fingerprints of a and b within the distance; same: b is a, and each pair is wanted once."""
    if a.size * b.size <= BRUTE or parts > 32:
        step = max(1, BRUTE // max(1, b.size))
        for k in range(0, a.size, step):
            i, j = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= distance)
            keep = (i + k < j) if same else slice(None)
            yield a[k : k + step][i[keep]], b[j[keep]]
        return
    cells = []
    for x in (a, b):
        c = _counts(x, parts)
        order = np.lexsort(c.T)
        c = c[order]
        cut = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]).any(1)])
        cells.append((c[cut], np.split(x[order], cut[1:])))
    (ca, ga), (cb, gb) = cells
    for i in range(len(ga)):
        near = np.flatnonzero(np.abs(cb - ca[i]).sum(1) <= distance)
        for j in near[near >= i] if same else near:
            yield from _pairs(ga[i], gb[j], distance, 2 * parts, same and i == j)


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, ...]:
    """The grid point that handles cells a and b: from the lesser, half of the way, coordinate by coordinate."""
    a, b = sorted((tuple(map(int, a)), tuple(map(int, b))))
    left, out = sum(abs(x - y) for x, y in zip(a, b, strict=True)) // 2, []
    for x, y in zip(a, b, strict=True):
        step = min(left, abs(x - y))
        left -= step
        out.append(x + (step if y > x else -step))
    return tuple(out)


def _links_at(point: tuple[int, ...], fps: np.ndarray, distance: int, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    c = _counts(fps, dims)
    if fps.size <= 1000:  # the visit of one point by few: compare, then ask who handles the pairs found
        i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance, 1))
        keep = np.fromiter((_middle(c[x], c[y]) == point for x, y in zip(i, j, strict=True)), bool, i.size) if i.size else slice(0)
        yield fps[i[keep]], fps[j[keep]]
        return
    order = np.lexsort(c.T)
    c, fps = c[order], fps[order]
    cut = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]).any(1)])
    cells, groups = c[cut], np.split(fps, cut[1:])
    for i in range(len(groups)):
        for j in range(i, len(groups)):
            if np.abs(cells[i] - cells[j]).sum() <= distance and _middle(cells[i], cells[j]) == point:
                yield from _pairs(groups[i], groups[j], distance, 2 * dims, i == j)


class Forest:
    """Union-find whose roots are least members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def edges(self) -> tuple[list[int], list[int]]:
        own = [x for x in self.up if self.root(x) != x]
        return own, [self.root(x) for x in own]


def _grid(segments: int, reach: int) -> tuple[Column, Column, int]:
    """A fingerprint's own point, packed; the moves to the points it visits; the base of the packing."""
    width = 64 // segments
    base, point = width + 2 * reach + 1, F.lit(0).cast("long")
    for i in range(segments):
        part = F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1))
        point = point + (F.bit_count(part) + reach).cast("long") * F.lit(base**i)
    return point, F.array(*[F.lit(sum(x * base**i for i, x in enumerate(d))).cast("long") for d in _ball(segments, reach)]), base


def _matched(visits: DataFrame, distance: int, segments: int) -> DataFrame:
    """visits (fp, point, one, two) -> edges (u, v): the task's spanning forest of the links of each (point, one, two)."""
    reach = -(-distance // 2)
    base = 64 // segments + 2 * reach + 1

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, at, held = Forest(), None, []

        def close() -> None:
            if at is None:
                return
            mine = np.unique(np.concatenate(held).view(np.uint64))
            point = tuple(at[0] // base**i % base - reach for i in range(segments))
            for a, b in _links_at(point, mine, distance, segments):
                for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True):
                    forest.join(x, y)

        for b in batches:
            own, keys = b.column(0).to_numpy(), np.stack([b.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3)], axis=1)
            cut = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
            for k, lo in enumerate(cut):
                hi = cut[k + 1] if k + 1 < len(cut) else len(keys)
                if (key := tuple(keys[lo].tolist())) != at:
                    close()
                    at, held = key, []
                held.append(own[lo:hi])
        close()
        u, v = forest.edges()
        for k in range(0, len(u), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 10_000], pa.int64()), pa.array(v[k : k + 10_000], pa.int64())], names=["u", "v"])

    key = ["point", "one", "two"]
    return visits.select("fp", *key).repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long")


def fingerprint_links(fps: DataFrame, distance: int = 4, segments: int = 4) -> DataFrame:
    """``fps`` (fp, distinct, staged) -> edges (u, v) that connect every two fingerprints within ``distance`` bits: the tasks' spanning forests, not all pairs.

    A pair is found at the middle point of its cells; if that is crowded, both visit it and meet again on the finer grid, so none is lost.
    """
    reach, found, left = -(-distance // 2), [], fps
    while True:
        own, moves, _ = _grid(segments, reach)
        visits = left.select("fp", own.alias("own")).select("fp", "own", F.explode(moves).alias("move")).select("fp", (F.col("own") + F.col("move")).alias("point"))
        cells = left.groupBy(own.alias("own")).agg(F.count("*").alias("n"))
        counts = cells.select("n", "own", F.explode(moves).alias("move")).groupBy((F.col("own") + F.col("move")).alias("point")).agg(F.sum("n").alias("n"))
        crowded = stage(counts.filter(F.col("n") > CROWDED).select("point", F.ceil(2 * F.col("n") / CROWDED).cast("int").alias("slices")), "crowded-points")
        one = visits.select("fp", "point", F.lit(0).alias("one"), F.lit(0).alias("two"))
        if crowded.isEmpty():
            found.append(_matched(one, distance, segments))
            break
        side = F.broadcast(crowded) if few_rows(crowded) else crowded
        found.append(_matched(one.join(side, "point", "left_anti"), distance, segments))
        hot = visits.join(side, "point")
        if segments >= FINEST:
            slice_ = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
            turns = hot.select("fp", "point", slice_.alias("slice"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
            pairs = turns.select("fp", "point", F.least("slice", "other").alias("one"), F.greatest("slice", "other").alias("two"))
            found.append(_matched(pairs, distance, segments))
            break
        left, segments = stage(hot.select("fp").distinct(), "crowded-fingerprints"), 2 * segments
    return reduce(DataFrame.unionByName, found)


def _own(docs: DataFrame, id_col: str, text_col: str, size: int, *more: Column) -> DataFrame:
    return stage(with_fingerprints(docs, id_col, text_col, size, *more), "fingerprints")


def _roots(own: DataFrame, distance: int) -> DataFrame:
    """(fp, root) of the fingerprints that have a link."""
    fps = stage(own.select("fp").distinct(), "distinct-fingerprints")
    return components(fingerprint_links(fps, distance)).select(F.col("node").alias("fp"), "root")


def _named(per: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """``per`` (fp, name) -> (fp, least): the least name of each fingerprint's component. A component may hold most of all rows, so its members are dealt by salt when they get its name."""
    joined = stage(per.join(roots, "fp", "left"), "rooted")
    alone = joined.filter("root is null").select("fp", F.col(name).alias("least"))
    linked = joined.filter("root is not null")
    least = linked.groupBy("root").agg(F.min(name).alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return alone.unionByName(linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"]).select("fp", "least"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component_id): documents whose fingerprints are joined by links of at most ``distance`` bits share the least id.

    Null and empty texts have fingerprint zero and link like any other; texts of any length are read whole. Repeated rows give repeated rows; a null id takes part, but is never the least unless its group has none other. An empty table gives no rows; other columns are ignored.
    """
    own = _own(docs, id_col, text_col, size)
    per = own.groupBy("fp").agg(F.min("id").alias("first"))
    return own.join(_named(per, _roots(own, distance), "first").withColumnRenamed("least", "component_id"), "fp").select("id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """One row of each group of linked documents, with all its columns: that with the least id (null ids last), on ties the least hash of id and text, then of the whole row.

    Rows are told apart by id and text together, so of two unlike texts under one id neither stands for the other, and rows without an id are weighed like all others. Of rows repeated as they are one stays. Null and empty texts are one group; texts of any length are read whole. An empty table gives no rows; columns of any name stay as they are. The rows that go are broadcast up to a checked number, so that texts aren't shuffled, else joined.
    """
    keys = [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)) for k in (1, 2)]
    own = _own(docs, id_col, text_col, size, *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    name = F.struct(F.col("id").isNull().alias("none"), "id", "k0", "k1")
    rows = own.groupBy("id", "fp", "k0", "k1").agg(F.count("*").alias("n"))
    per = rows.groupBy("fp").agg(F.min(name).alias("first"))
    roots = _roots(own, distance)
    joined = stage(per.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    leaders = joined.groupBy("root").agg(F.min("first").alias("l")).select("l.k0", "l.k1", F.lit(True).alias("leads"))
    marked = stage(rows.join(leaders, ["k0", "k1"], "left").filter("leads is null or n > 1").select("k0", "k1", F.col("leads").isNotNull().alias("again")), "marked")
    side = F.broadcast if few_rows(marked) else (lambda df: df)
    names = ["__k0", "__k1"]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    keyed = docs.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    held = marked.withColumnsRenamed(dict(zip(("k0", "k1"), names, strict=True)))
    kept = keyed.join(side(held), names, "left_anti").select(docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = keyed.join(side(held.filter("again").select(names)), names, "left_semi").groupBy(names).agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row"))
    return kept.unionByName(once.select("__row.*"))
