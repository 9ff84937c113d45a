"""The corpus pipeline: toxic documents go, common lines go, one document of each near-duplicate group stays, sources are mixed to their targets, and what is left is packed into sequences.

Each stage is a function of (spark, docs, sf_dir) that applies one operator to all rows it gets; ``run`` writes each stage's rows as Parquet in the shared folder and reads them again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm import linededup, mixing, packing, simhash, toxicity
from graphlake.llm.common import read, stage, unstage, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted on the labels of four folds of five calls toxic go.

    Null texts are scored as empty ones, texts of any length whole; repeated rows go or stay together, rows of one id each by its own text; null ids are scored but never learned from; an empty table gives none; columns of any name stay as they are.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").filter(toxicity.fold() != 0))
    return toxicity.ordinary(docs, model)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose key ten documents or more hold go; n_chars, if there is one, follows the text.

    Documents that lose all their lines stay, empty, as do null texts; a repeated row counts each time; null ids count like others; texts of any length are read whole; an empty table gives none; other columns stay as they are.
    """
    n_lines, n_dropped = unused(docs.columns, "n_lines", "n_dropped")
    out = linededup.dedup_lines(docs, n_lines=n_lines, n_dropped=n_dropped)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints, of shingles of five words, are linked by at most four differing bits, one stays: that with the least id, null ids last.

    Rows are told apart by id and text, so repeats of an id with unlike texts both stay, and rows without an id are weighed too; null and empty texts are one group; ties, repeated rows, long texts, empty tables and clashing names as in ``simhash.keep_first``.
    """
    return simhash.keep_first(docs, size=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its draw say.

    Null sources are one source, the last; null and empty texts weigh nothing but are drawn too; rows of one id, null among them, share their draw; texts of any length are counted whole; an empty table gives none; columns of any name stay as they are.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its sequence and place; a document that was mixed in twice is packed twice.

    Null and empty texts are their end token; long texts are cut, none is shortened; ids may be null or repeated; equal lengths are packed in the order of rows; an empty table gives none; other columns are ignored.
    """
    return packing.packed(docs).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and a tokenizer have no SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written, and deleted once the next has read it."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, apply in STAGES[:-1]:
        docs, old = stage(apply(spark, docs, sf_dir), name.replace(" ", "-")), before
        if old is not None:
            unstage(spark, old)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written by now
    unstage(spark, docs)
    return out
