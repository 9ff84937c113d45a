"""Tables that a loop writes between its rounds, in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's own setting: an action's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: An application's temporary folder.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder, on a single machine only."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="graphlake-"))
    return path.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written: its lineage ends there, and a lost executor costs nothing that lies before. What it shuffled is deleted at once, not when the driver's memory fills."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/graphlake/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    Of what comes out of a written table Spark knows the compressed size alone; exploded, it can be a hundred times that, and the driver would hold it.
    """
    return df.hint("merge")


def dropped(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
