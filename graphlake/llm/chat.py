"""Preference formatting of chats. DataFrame functions only.

Of a chosen and a rejected conversation the longest common prefix of turns is rendered once, as the prompt; what follows in either is its completion, with the spans that a loss may count: the assistant's words and the mark that ends its turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.llm.common import stage

START, END = "<|im_start|>", "<|im_end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def _render(turn: Column) -> Column:
    return F.concat(_head(turn), turn["text"], F.lit(END))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """Spans of the assistant's turns in the rendered text, in code points, as "start-end" joined by commas."""
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        size = F.length(_render(t)).cast("long")
        span = F.concat((s["at"] + F.length(_head(t))).cast("string"), F.lit("-"), (s["at"] + size).cast("string"))
        return F.struct((s["at"] + size).alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, first, step, lambda s: s["spans"]), ",")


def _turns(side: DataFrame, name: str) -> DataFrame:
    safe = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |"))  # noqa: E731  what looks like a mark is none
    row = F.struct("turn", safe("role").alias("role"), safe("text").alias("text"))
    return side.filter("pair_id is not null").groupBy("pair_id").agg(F.array_sort(F.collect_list(row)).alias(name))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """chosen and rejected: (pair_id, turn, role, text) -> a row per pair_id of both: n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.

    Turns are ordered by turn (nulls first), ties by role and text; repeated rows are repeated turns. Null roles and texts are empty. Equal conversations give empty completions, a conversation that the other begins with an empty one. Rows without a pair_id, and pairs of which one side is missing, give no row; other columns are ignored. A pair is one row, so its conversations must fit one.
    """
    pair = _turns(chosen, "a").join(_turns(rejected, "b"), "pair_id")
    short = F.least(F.size("a"), F.size("b"))
    a, b = F.col("a"), F.col("b")
    differs = lambda i: (F.get(a, i)["role"] != F.get(b, i)["role"]) | (F.get(a, i)["text"] != F.get(b, i)["text"])
    pair = pair.withColumn("n", F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), short - 1), differs)), short))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    pair = pair.select("pair_id", "n", F.slice("a", 1, F.col("n")).alias("common"), rest("a").alias("a"), rest("b").alias("b"))
    return pair.select("pair_id", F.col("n").cast("long").alias("n_common"), _text(F.col("common")).alias("prompt"), _text(a).alias("chosen"), _text(b).alias("rejected"), _mask(a).alias("chosen_mask"), _mask(b).alias("rejected_mask"))


def following(ids: DataFrame) -> DataFrame:
    """``ids`` (id, distinct, not null) -> (id, next): the next greater id, for the greatest the least.

    Ids are dealt by range and written; each range finds its own successors and gets the first id of the next range that has rows, a row a range.
    """
    spark = ids.sparkSession
    dealt = stage(ids.repartitionByRange("id").withColumn("range", F.spark_partition_id()), "id-ranges")
    firsts = sorted((r["range"], r["first"]) for r in dealt.groupBy("range").agg(F.min("id").alias("first")).collect())
    after = [(firsts[k][0], firsts[(k + 1) % len(firsts)][1]) for k in range(len(firsts))]
    bounds = spark.createDataFrame(after, f"range int, after {ids.schema['id'].dataType.simpleString()}")
    within = dealt.withColumn("within", F.lead("id").over(Window.partitionBy("range").orderBy("id")))
    return within.join(F.broadcast(bounds), "range").select("id", F.coalesce("within", "after").alias("next"))


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference data out of plain chats (conv_id, turn, role, text): chosen is each chat with a reply, rejected the same with its last reply replaced by the last reply of the next such chat, in the order of ids; after the last comes the first.

    All turns stay, those after the last reply too, so every chat with a reply makes a pair; a lone one is paired with itself. Chats without an assistant's turn, or only with ones that have no turn number, make none, nor do rows without a conv_id. Of several replies at the last turn the greatest text is the one that others get, and all of them are replaced; a null text is empty. Repeated rows stay repeated; other columns are ignored; no rows give none.
    """
    replies = conversations.filter("role = 'assistant' and conv_id is not null and turn is not null")
    last = replies.groupBy(F.col("conv_id").alias("id")).agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("m")).select("id", "m.turn", "m.text")
    other = following(last.select("id")).join(last.select(F.col("id").alias("next"), F.col("text").alias("other")), "next").select("id", "other")
    ends = last.select("id", F.col("turn").alias("last")).join(other, "id").withColumnRenamed("id", "pair_id")
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").join(ends, "pair_id")
    replaced = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.col("other")).otherwise(F.col("text"))
    return turns.select("pair_id", "turn", "role", "text"), turns.select("pair_id", "turn", "role", replaced.alias("text"))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS last FROM c WHERE role = 'assistant' GROUP BY conv_id),
w AS (SELECT l.conv_id, l.last, max(coalesce(c.text, '')) AS reply FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.last AND c.role = 'assistant' GROUP BY ALL),
e AS (SELECT conv_id, last, coalesce(lead(reply) OVER (ORDER BY conv_id), first_value(reply) OVER (ORDER BY conv_id)) AS other FROM w),
t AS (SELECT c.conv_id, c.turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS a,
             replace(coalesce(CASE WHEN turn = last AND role = 'assistant' THEN other ELSE text END, ''), '<|', '< |') AS b
      FROM c JOIN e ON c.conv_id = e.conv_id),
s AS (SELECT conv_id, 'a' AS side, turn, role, a AS text FROM t UNION ALL SELECT conv_id, 'b', turn, role, b FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role, text) AS i FROM s),
k AS (SELECT x.conv_id, coalesce(min(CASE WHEN x.role <> y.role OR x.text <> y.text THEN x.i END) - 1, count(*)) AS n_common FROM n x JOIN n y ON x.conv_id = y.conv_id AND x.i = y.i AND x.side = 'a' AND y.side = 'b' GROUP BY x.conv_id),
r AS (SELECT n.*, n_common, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown, 13 + length(role) AS head FROM n JOIN k ON n.conv_id = k.conv_id),
p AS (SELECT *, coalesce(sum(length(shown)) FILTER (i > n_common) OVER (PARTITION BY conv_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r),
g AS (SELECT conv_id, side, n_common, coalesce(string_agg(shown, '' ORDER BY i) FILTER (i <= n_common), '') AS prompt, coalesce(string_agg(shown, '' ORDER BY i) FILTER (i > n_common), '') AS rest,
             coalesce(string_agg(CAST(pos + head AS BIGINT) || '-' || CAST(pos + length(shown) AS BIGINT), ',' ORDER BY i) FILTER (i > n_common AND role = 'assistant'), '') AS mask FROM p GROUP BY ALL)
SELECT x.conv_id AS pair_id, CAST(x.n_common AS BIGINT) AS n_common, x.prompt, x.rest AS chosen, y.rest AS rejected, x.mask AS chosen_mask, y.mask AS rejected_mask FROM g x JOIN g y ON x.conv_id = y.conv_id AND x.side = 'a' AND y.side = 'b'
"""
