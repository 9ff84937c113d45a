"""Mixing sources to target weights. DataFrame functions only.

Words are summed per source, targets are shared out by weight (none above ``cap`` times its source), and each document is emitted floor(rate) times plus once more with a probability of the rate's fraction, drawn from a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.llm.common import few_rows, stage, unused, word_count

SALTS = 32


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` (source, size) -> (source, source_size, target).

    Sources in code-point order, null last, take the weights in turn. All share ``share`` times the words of all; a target above ``cap`` times its source stops there and the rest is shared anew by weight until none is above. Filled up in order of cap / weight, that ends at one level, the largest of the levels that arise on the way. A source without words gets target 0. One row per source reaches one task.
    """
    turn, fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "turn")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("turn", F.row_number().over(turn) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / rest)
    per = per.withColumn("target", F.least("most", F.col("weight") * F.max("level").over(whole)))
    return per.select("source", "source_size", "target")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", prefix: str = "mix_") -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and copies (an int of at most ``cap``, rounded up), their names after ``prefix``.

    Null texts have size 0, texts of any length are counted whole; null sources are one source; rows of equal id, a null id among them, share their draw; columns that bear these names are replaced. An empty table gives no rows. The source table is broadcast if it is small, else joined over salted keys, as a source may hold a third of all rows.
    """
    size, source_size, target, copies = (f"{prefix}{n}" for n in ("size", "source_size", "target", "copies"))
    sized = docs.drop(source_size, target, copies).withColumn(size, word_count(F.col(text_col)))
    source, salt, right_salt = unused(sized.columns, "mix__source", "mix__salt", "mix__right")
    targets = stage(source_targets(sized.select(F.col(source_col).alias("source"), F.col(size).alias("size")), weights, share, cap), "targets")
    right = targets.select(F.col("source").alias(source), F.col("source_size").alias(source_size), F.col("target").alias(target))
    same = F.col(source_col).eqNullSafe(F.col(source))
    if few_rows(targets):
        joined = sized.join(F.broadcast(right), same)
    else:
        salted = right.withColumn(right_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS))
        joined = sized.withColumn(salt, own).join(salted, same & (F.col(salt) == F.col(right_salt))).drop(salt, right_salt)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    return joined.withColumn(copies, (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")).drop(source)


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each document as many times as drawn, with the columns of ``docs``, whatever their names."""
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    copies = mixed(docs, prefix=prefix, **options).withColumn(f"{prefix}copy", F.explode(F.sequence(F.lit(0), F.col(f"{prefix}copies"))))
    return copies.filter(F.col(f"{prefix}copy") > 0).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
t AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM s),
w AS (SELECT *, CAST([3, 1, 2][CAST(turn % 3 + 1 AS BIGINT)] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS most FROM t),
l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY most / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM l),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
             CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS draw
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
