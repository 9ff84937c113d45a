"""What the symbol graph shuffles is made once and goes when it has been used."""

import time

import duckdb
from pyspark.sql import functions as F

from graphlake.operators import resolve
from graphlake.operators.staged import settled
from graphlake.plans import code  # noqa: F401  it adds its queries
from graphlake.plans.tables import QUERIES

DATA = "/root/testdata/sf0.001"


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    out = settled(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n")))
    for _ in range(100):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 7


def test_calls_are_resolved_once_for_edges_and_degrees(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(resolve, "settled", lambda df: plans.append(df.columns) or settled(df))
    run, sql = QUERIES["index_symbols"]
    out = run(spark, DATA)
    assert ["src", "dst", "n"] in plans
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    db = duckdb.connect()
    for t in ("part", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(db.execute(sql).fetchall())
