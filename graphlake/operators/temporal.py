"""Versioned nodes and edges: validity, evidence, retrieval and incremental change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.functions.scalars import candidate_score, live_at
from graphlake.operators import nearest


def as_of(rows: DataFrame, at: object) -> DataFrame:
    return rows.filter(live_at(F.lit(at)))


def history(rows: DataFrame, key: str = "id", start: str = "valid_from") -> DataFrame:
    """Versions by start; each ends where the next begins, the last is open."""
    at = Window.partitionBy(key).orderBy(start)
    return rows.withColumn("valid_to", F.lead(start).over(at)).withColumn("version", F.row_number().over(at))


def invalid(rows: DataFrame) -> DataFrame:
    """Rows that break the envelope's rules: facts are certain, confidence lies between 0 and 1."""
    return rows.filter(((F.col("kind") == "FACT") & (F.col("confidence") != 1.0)) | ~F.col("confidence").between(0, 1) | F.col("confidence").isNull())


def provenance_root(source: Column, model: Column, version: Column) -> Column:
    return F.concat(source, F.lit("@"), F.coalesce(model, F.lit("-")), F.lit(":"), F.coalesce(version, F.lit("-")))


def content_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def insert_new(old: DataFrame, new: DataFrame, key: str = "content_hash") -> DataFrame:
    """``old`` and what of ``new`` it lacks, once each; content of a retired version is not brought back."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(old.columns))


def net_support(evidence: DataFrame, claim: str = "claim") -> DataFrame:
    """evidence (claim, rel: SUPPORTS or CONTRADICTS, root, confidence) -> supported, contradicted and their difference.

    Of a root only the surest counts; roots are independent, so each side is 1 minus the product of doubts.
    """
    best = evidence.groupBy(claim, "rel", "root").agg(F.max("confidence").alias("c"))
    side = lambda rel: 1 - F.coalesce(F.product(F.when(F.col("rel") == rel, 1 - F.col("c"))), F.lit(1.0))
    both = best.groupBy(claim).agg(side("SUPPORTS").alias("supported"), side("CONTRADICTS").alias("contradicted"))
    return both.withColumn("net", F.col("supported") - F.col("contradicted"))


def conflicts(edges: DataFrame, claim: str = "claim") -> DataFrame:
    return edges.groupBy(claim).agg(F.count_if(F.col("rel") == "SUPPORTS").alias("supports"), F.count_if(F.col("rel") == "CONTRADICTS").alias("contradicts"))


def semantic_search(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, block: int = nearest.QUERY_BLOCK, types: list[str] | None = None, at: object = None) -> DataFrame:
    """vectors (id, v), queries (query, q) -> (query, id, score, rank): the ``k`` likeliest by cosine for each query, by id on ties.

    Exact, by pivots (``nearest``); about ``block`` queries meet a block of vectors at a time. ``types`` and ``at`` keep vectors (.., type, valid_from, valid_to) of those types that are valid then.
    """
    if types:
        vectors = vectors.filter(F.col("type").isin(types))
    if at is not None:
        vectors = vectors.filter(live_at(F.lit(at)))
    return nearest.search(vectors, queries, k, digits, block)


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def owner(fqn: Column) -> Column:
    """The file that a qualified name belongs to."""
    return F.get(F.split(fqn, "::"), F.lit(0))


def stale_beliefs(beliefs: DataFrame, live: DataFrame) -> DataFrame:
    """Beliefs (id, supporting: array) with a support that is not live."""
    need = beliefs.select("id", F.explode("supporting").alias("node"))
    return beliefs.join(need.join(live.select(F.col("id").alias("node")), "node", "left_anti").select("id").distinct(), "id", "left_semi")


def apply_changes(current: DataFrame, extracted: DataFrame, touched: DataFrame, at: float) -> DataFrame:
    """The table after files changed: versions of touched files (file) that the new extraction lacks end ``at``, those it brings begin ``at``, the rest stays as it is.

    current and extracted: (id, file, content_hash, ...), current with valid_from, valid_to.
    """
    open_ = F.col("valid_to").isNull()
    mine = touched.select("file").distinct().withColumn("__hit", F.lit(True))
    new = extracted.select("id", "content_hash").distinct().withColumn("__same", F.lit(True))
    marked = current.join(mine, "file", "left").join(new, ["id", "content_hash"], "left")
    ended = marked.withColumn("valid_to", F.when(open_ & F.col("__hit") & F.col("__same").isNull(), F.lit(at)).otherwise(F.col("valid_to"))).select(current.columns)
    fresh = extracted.dropDuplicates(["id", "content_hash"]).join(current.filter(open_).select("id", "content_hash"), ["id", "content_hash"], "left_anti").withColumn("valid_from", F.lit(at)).withColumn("valid_to", F.lit(None).cast("double"))
    return ended.unionByName(fresh.select(current.columns))


def change_report(before: DataFrame, after: DataFrame, at: float) -> DataFrame:
    return after.agg(F.count_if(F.col("valid_to") == at).alias("retired"), F.count_if(F.col("valid_from") == at).alias("added")).join(before.agg(F.count_if(F.col("valid_to").isNull()).alias("live_before")))


def judged_candidates(candidates: DataFrame) -> DataFrame:
    """candidates (task, id, evidence, verification, risk, hard_fail) ranked by score, evidence, then least risk."""
    scored = candidates.withColumn("score", candidate_score(F.col("evidence"), F.col("verification"), F.col("risk"), F.col("hard_fail")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("score"), F.desc("evidence"), "risk", "id")))


def judge_rounds(candidates: DataFrame, rounds: int = 3, threshold: float = 0.5) -> DataFrame:
    """candidates with round -> a row per task: the best of the first round that reaches ``threshold``, else the best of all if its score is above 0, else escalated."""
    best = judged_candidates(candidates.filter(F.col("round") <= rounds).withColumn("task", F.struct("task", "round"))).filter("rank = 1").select("task.*", "id", "score")
    win = F.min_by(F.struct("round", "id", "score"), F.when(F.col("score") >= threshold, F.col("round")))
    fallback = F.max_by(F.struct("round", "id", "score"), F.when(F.col("score") > 0, F.struct(F.col("score"), -F.col("round"))))
    out = best.groupBy("task").agg(win.alias("w"), fallback.alias("f"))
    state = F.when(F.col("w").isNotNull(), "won").when(F.col("f").isNotNull(), "fallback").otherwise("escalated")
    return out.select("task", state.alias("state"), F.coalesce("w", "f").alias("c")).select("task", "state", "c.round", "c.id", "c.score")


def execution_nodes(runs: DataFrame, *inputs: str) -> DataFrame:
    """Content-addressed execution nodes: equal kind and inputs are one node."""
    return runs.withColumn("node", content_hash(*inputs)).dropDuplicates(["node"])
