"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm import alignment, centroids, chat, covertree, forest, license_scan, linededup, mixing, packing, simhash, syncmer, toxicity, warc
from graphlake.llm.common import read


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(*chat.swapped_replies(read(spark, sf_dir, "conversations")))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer.fingerprints_with_edits(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(toxicity.fold() != 0))
    return toxicity.scored(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(toxicity.fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = simhash.simhash_components(read(spark, sf_dir, "documents"))
    return own.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "place")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return forest.neighbours(rows, rows.filter(F.col("vec_id") % 50 == 0)).withColumnRenamed("id", "vec_id")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_cover_tree": op1_cover_tree, "op2_license_scan": op2_license_scan, "op3_preferences": op3_preferences, "op4_syncmers": op4_syncmers, "op5_packing": op5_packing, "op6_mixing": op6_mixing, "op7_toxicity": op7_toxicity, "op8_line_dedup": op8_line_dedup, "op9_simhash": op9_simhash, "op10_warc": op10_warc, "op11_centroids": op11_centroids, "op12_forest": op12_forest, "op13_alignment": op13_alignment}


def oracle_sql() -> dict[str, str]:
    return {"op1_cover_tree": covertree.ORACLE, "op2_license_scan": license_scan.ORACLE, "op3_preferences": chat.ORACLE, "op6_mixing": mixing.ORACLE, "op8_line_dedup": linededup.ORACLE, "op10_warc": warc.ORACLE, "op11_centroids": centroids.ORACLE}
