"""Queries over symbols (id, name, kind, file, line, end_line, signature, doc, exported, fan_in, fan_out, tags, container, ord) and edges (src, dst, kind)."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from graphlake.config import LIMITS
from graphlake.functions import rules
from graphlake.functions.scalars import token_estimate, xml_escape
from graphlake.operators.staged import settled


def search_score(q: Column) -> Column:
    """The first place where a query, trimmed and in lower case, is found decides, plus fan-in and export; null if it is found nowhere."""
    name = F.lower("name")
    base = F.when(name == q, 100).when(F.startswith(name, q), 70).when(F.contains(name, q), 45).when(F.array_contains("tags", q), 35)
    base = base.when(F.contains(F.lower("signature"), q), 20).when(F.contains(F.lower(F.coalesce("doc", F.lit(""))), q), 12)
    return base + F.least(F.lit(15), F.col("fan_in")) + F.when(F.col("exported"), 5).otherwise(0)


#: Letters of a gram, at most.
GRAM = 3


def _grams(text: Column, n: Column) -> Column:
    """The distinct runs of ``n`` letters of a text."""
    last = F.length(text) - n + 1
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, n))
    return F.when(last >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def searches(symbols: DataFrame, queries: DataFrame, most: int = LIMITS.search) -> DataFrame:
    """queries (query) -> (query, rank, score, symbol columns): the ``most`` best of each distinct query, as of ``search``, by an inverted index.

    The index holds the grams of three letters of names, signatures and docs, and the tags; of one or two letters only if a query has no more. A query looks up the rarest of its grams, which every text that holds it must have, and its tag; only what these give is compared. Null and blank queries give no rows.
    """
    asked = settled(queries.select(F.col("query"), F.lower(F.trim("query")).alias("q")).filter("q <> ''").distinct())
    n = F.least(F.length("q"), F.lit(GRAM))
    wanted = asked.select("query", "q", n.alias("n"), F.explode(_grams(F.col("q"), n)).alias("gram"))
    lengths = wanted.select("n").distinct()  # three rows at most
    # A mark that no gram holds keeps the fields apart.
    hay = F.concat_ws("\u0000", F.lower("name"), F.lower("signature"), F.lower("doc"))
    sizes = [r.n for r in lengths.collect()]
    grams = [_grams(hay, F.lit(k)) for k in sizes] or [F.array().cast("array<string>")]
    index = symbols.select("id", F.explode(F.flatten(F.array(*grams))).alias("gram"))
    index = settled(index.join(wanted.select("gram").distinct(), "gram", "left_semi"))
    counts = index.groupBy("gram").agg(F.count("*").alias("held"))
    held = wanted.join(counts, "gram", "left").groupBy("query", "q").agg(F.min_by("gram", F.coalesce("held", F.lit(0))).alias("gram"))
    by_gram = held.join(index, "gram").select("query", "q", "id")
    by_tag = symbols.select("id", F.explode(F.array_distinct("tags")).alias("q")).join(asked, "q").select("query", "q", "id")
    met = by_gram.unionByName(by_tag).distinct().join(symbols, "id").withColumn("score", search_score(F.col("q"))).filter("score is not null")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "ord"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= most).drop("q")


def search(symbols: DataFrame, query: str, most: int = LIMITS.search) -> DataFrame:
    if not query.strip():
        return symbols.withColumn("score", F.lit(0)).limit(0)
    return symbols.withColumn("score", search_score(F.lit(query.strip().lower()))).filter("score is not null").orderBy(F.desc("score"), "ord").limit(most)


def _ends(symbols: DataFrame, edges: DataFrame, ids: DataFrame, kind: str, given: str, wanted: str) -> DataFrame:
    hit = edges.filter(F.col("kind") == kind).join(ids.select(F.col("id").alias(given)), given)
    return hit.select(F.col(given).alias("of"), F.col(wanted).alias("id")).join(symbols, "id")


def callees(symbols: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(of, symbol columns): what each of ``ids`` calls; edges that dangle give nothing."""
    return _ends(symbols, edges, ids, "calls", "src", "dst")


def callers(symbols: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    return _ends(symbols, edges, ids, "calls", "dst", "src")


def members(symbols: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    return _ends(symbols, edges, ids, "contains", "src", "dst")


def hubs(symbols: DataFrame, most: int = 15) -> DataFrame:
    return symbols.orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "ord").limit(most)


def dead_code(symbols: DataFrame) -> DataFrame:
    """Functions and methods that nothing calls, entry points and tests not among them; components are exempt."""
    return symbols.filter(F.col("kind").isin("function", "method") & (F.col("fan_in") == 0) & ~F.col("name").rlike(rules.ENTRY_POINTS) & ~F.array_contains("tags", "test"))


#: Lines of a file that one task reads in a row; a symbol stands in every such range that it reaches into.
RANGE = 5000


def symbol_at(symbols: DataFrame, places: DataFrame, kinds: list[str] | None = None, exclude: str | None = None) -> DataFrame:
    """places (file, line, key, ...) with id: the smallest symbol around each, the first on ties; ``exclude`` names a column whose symbol is passed over.

    Both sides are dealt by file and range of lines and sorted; one sweep keeps the symbols that are open. No place meets a symbol that doesn't reach into its range, and no range is held in memory. A place without a file, a line or a symbol around it gives no row.
    """
    s = symbols.filter(F.col("kind").isin(kinds)) if kinds else symbols
    part = lambda c: F.floor((F.col(c) - 1) / RANGE)
    place = F.struct(*[F.col(c) for c in places.columns])
    s = s.filter("line is not null").withColumn("end_line", F.greatest("line", "end_line"))
    opens = s.select("file", F.explode(F.sequence(part("line"), part("end_line"))).alias("part"), F.col("line").cast("long").alias("at"), F.lit(0).alias("turn"), F.col("end_line").cast("long").alias("to"), "id", F.col("ord").alias("ord"))
    asks = places.filter("file is not null and line is not null").select("file", part("line").alias("part"), F.col("line").cast("long").alias("at"), F.lit(1).alias("turn"), place.alias("place"))
    rows = opens.unionByName(asks, allowMissingColumns=True).select("file", "part", "at", "turn", "to", "id", "ord", "place")
    rows = rows.repartition("file", "part").sortWithinPartitions("file", "part", "at", "turn")
    schema = StructType([*places.schema.fields, StructField("id", symbols.schema["id"].dataType)])
    names = schema.fieldNames()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, open_ = None, []
        for b in batches:
            place = b.column("place")
            skip = place.field(names.index(exclude)).to_pylist() if exclude else None
            took, ids = [], []
            for n, (file, part, at, turn, to, id_, ord_) in enumerate(zip(*(b.column(c).to_pylist() for c in ("file", "part", "at", "turn", "to", "id", "ord")), strict=True)):
                if (file, part) != where:
                    where, open_ = (file, part), []
                if not turn:
                    heapq.heappush(open_, (to - at, ord_, to, id_))
                    continue
                found = _smallest(open_, at)
                if found and skip and found[3] == skip[n]:
                    heapq.heappop(open_)
                    found, passed = _smallest(open_, at), found
                    heapq.heappush(open_, passed)
                if found:
                    took.append(n)
                    ids.append(found[3])
            some = place.take(pa.array(took, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.flatten(), pa.array(ids, b.schema.field("id").type)], names=names)

    return rows.mapInArrow(sweep, schema)


def _smallest(open_: list[tuple], at: int) -> tuple | None:
    """The least of the symbols that still reach to a line; those that end before it are let go once they come up."""
    while open_ and open_[0][2] < at:
        heapq.heappop(open_)
    return open_[0] if open_ else None


def find_nodes(nodes: DataFrame, text: str, most: int = 30) -> DataFrame:
    q = F.lit(text.lower())
    return nodes.filter(F.contains(F.lower("label"), q) | F.contains(F.lower(F.coalesce("subtitle", F.lit(""))), q)).orderBy("ord").limit(most)


def keywords(query: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9_]+", query.lower()) if len(w) > 2 and w not in rules.STOP_WORDS]


def within_budget(rows: DataFrame, group: list[str], order: list, cost: str, budget: int, most: int) -> DataFrame:
    """Greedy with skips: in order, a row that fits is taken, one that doesn't is passed over, until ``most`` are taken. Adds used (tokens so far) and rank.

    A prefix sum can't skip, so each group folds over its ordered rows; a group is one result's candidates, bounded by the caller.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    ordered = rows.withColumn("rank", rank)
    folded = ordered.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(cost).cast("long").alias("cost")))).alias("__rows"))
    first = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:int,used:bigint>>").alias("taken"))

    def step(s, r):  # noqa: ANN001, ANN202
        fits = (F.size(s["taken"]) < most) & (s["used"] + r["cost"] <= budget)
        used = s["used"] + r["cost"]
        return F.when(fits, F.struct(used.alias("used"), F.concat(s["taken"], F.array(F.struct(r["rank"].alias("rank"), used.alias("used")))).alias("taken"))).otherwise(s)

    taken = folded.select(*group, F.explode(F.aggregate("__rows", first, step, lambda s: s["taken"])).alias("t")).select(*group, "t.rank", "t.used")
    return ordered.join(taken, [*group, "rank"])


def context(symbols: DataFrame, edges: DataFrame, query: str, budget: int = 3000, most: int = 24) -> DataFrame:
    """The symbols that an assistant should see for a query: (id, reason, score, used, rank), seeds first, then what surrounds them, within a token budget."""
    found = [search(symbols, query, 5).withColumn("part", F.lit(0))] + [search(symbols, w, 3).withColumn("part", F.lit(k + 1)) for k, w in enumerate(keywords(query))]
    seeds = found[0]
    for f in found[1:]:
        seeds = seeds.unionByName(f)
    place = F.struct("part", -F.col("score"), "ord")
    seeds = seeds.groupBy("id").agg(F.min(place).alias("at"), F.first("container").alias("container")).orderBy("at").limit(8)
    # Eight rows at most; written once, as all that follows reads them.
    seeds = settled(seeds.withColumn("i", F.row_number().over(Window.orderBy("at")) - 1).select("id", "container", "i"))
    ids = seeds.select("id")

    def part(df: DataFrame, reason: str, score: int, cap: int | None, turn: int) -> DataFrame:
        if cap:
            df = df.withColumn("n", F.row_number().over(Window.partitionBy("of").orderBy("ord"))).filter(F.col("n") <= cap)
        return df.join(seeds.select(F.col("id").alias("of"), "i"), "of").select("id", F.lit(reason).alias("reason"), F.lit(score).alias("score"), "i", F.lit(turn).alias("turn"), "ord")

    parents = seeds.filter("container is not null").select(F.col("id").alias("of"), F.col("container").alias("id")).join(symbols, "id")
    siblings = members(symbols, edges, parents.select("id").distinct()).withColumnRenamed("of", "parent").join(parents.select("of", F.col("id").alias("parent")), "parent")
    rows = seeds.join(symbols.select("id", "ord"), "id").select("id", F.lit("seed").alias("reason"), (100 - 5 * F.col("i")).alias("score"), F.lit(-1).alias("i"), F.col("i").alias("turn"), "ord")
    for df in (part(callees(symbols, edges, ids), "callee (dependency)", 70, None, 0), part(callers(symbols, edges, ids), "caller (usage)", 55, 4, 1), part(parents, "container", 60, None, 2), part(siblings, "sibling", 40, 4, 3), part(members(symbols, edges, ids), "member", 65, 6, 4)):
        rows = rows.unionByName(df)
    # The highest score names the reason; the first place a symbol came up keeps its place among equals.
    seen = F.struct("i", "turn", "ord")
    best = rows.groupBy("id").agg(F.max("score").alias("score"), F.min_by("reason", F.struct(-F.col("score"), seen)).alias("reason"), F.min(seen).alias("seen"))
    shown = F.concat_ws(" ", "name", "signature", F.coalesce("doc", F.lit("")), "file")
    slices = best.join(symbols.select("id", "name", "kind", "file", "line", "signature", "doc", token_estimate(shown).alias("cost")), "id").withColumn("g", F.lit(0))
    return within_budget(slices, ["g"], [F.desc("score"), "seen"], "cost", budget, most).drop("g", "seen")


def prompt(slices: DataFrame, query: str) -> DataFrame:
    """The context as one text, everything from the repository escaped."""
    e = xml_escape
    row = F.concat(F.lit('  <symbol name="'), e(F.col("name")), F.lit('" kind="'), e(F.col("kind")), F.lit('" file="'), e(F.col("file")), F.lit(":"), F.col("line").cast("string"), F.lit('" reason="'), e(F.col("reason")), F.lit('">'), e(F.concat_ws(" ", "signature", "doc")), F.lit("</symbol>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", row.alias("row")))), lambda s: s["row"]), "\n")
    return slices.agg(F.concat(F.lit("<context>\n"), body, F.lit("\n</context>\n<query>"), e(F.lit(query)), F.lit("</query>")).alias("prompt"))
