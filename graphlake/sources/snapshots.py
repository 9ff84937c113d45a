"""Results and snapshots as partitioned tables."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, *parts: str) -> None:
    """Replace only the partitions (repo_id, hash) that ``df`` brings."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def load(spark: SparkSession, path: str, **parts: str) -> DataFrame:
    """The partitions asked for; others aren't listed."""
    df = spark.read.parquet(path)
    for k, v in parts.items():
        df = df.filter(F.col(k) == v)
    return df


def cached(spark: SparkSession, path: str, *parts: str) -> DataFrame:
    """Which partitions there are."""
    return spark.read.parquet(path).select(*parts).distinct()


def archives(spark: SparkSession, path: str, max_bytes: int = 400_000) -> DataFrame:
    """(hash, rel, content, length): the files of tar archives, one archive a snapshot that is named by its file. An archive is unpacked by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                    for f in tar:
                        if f.isfile() and f.size <= max_bytes:
                            row = [name.rsplit("/", 1)[-1].split(".")[0]], [f.name.removeprefix("./")], [tar.extractfile(f).read()], [f.size]
                            yield pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1]), pa.array(row[2], pa.binary()), pa.array(row[3], pa.int64())], names=["hash", "rel", "content", "length"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar*").load(path)
    return found.select("path", "content").mapInArrow(run, "hash string, rel string, content binary, length long")


def has(spark: SparkSession, path: str, **parts: str) -> bool:
    return not load(spark, path, **parts).limit(1).isEmpty()


def drop(spark: SparkSession, path: str, **parts: str) -> bool:
    """Delete a partition's folder; whether there was one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "".join(f"/{k}={v}" for k, v in parts.items()))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
