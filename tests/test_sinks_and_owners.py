"""Streams into tables, sessions, owners, and specialists that fail."""

import pytest
from pyspark.sql import functions as F

from graphlake.operators import extract, swarm, temporal, timeline
from graphlake.sources import files as src
from graphlake.sources import snapshots
from graphlake.streaming.live import sessions, versions, versions_sink

ROW = "id string, file string, content_hash string, at double"


def state(df):
    return {(r.id, r.content_hash, r.valid_from, r.valid_to) for r in df.collect()}


def test_batches_of_versions_rewrite_only_their_files(spark, tmp_path):
    path = str(tmp_path / "versions")
    write = versions_sink(path, buckets=8)
    write(spark.createDataFrame([], ROW), 0)
    write(spark.createDataFrame([("f", "a.py", "f1", 1.0), ("g", "a.py", "g1", 1.0), ("x", "b.py", "x1", None)], ROW), 1)
    second = spark.createDataFrame([("f", "a.py", "f2", 2.0)], ROW)
    for _ in range(2):  # a repeated batch, and an epoch that never came
        write(second, 3)
        assert state(versions(spark, path)) == {("f", "f1", 1.0, 2.0), ("g", "g1", 1.0, 2.0), ("f", "f2", 2.0, None), ("x", "x1", 1.0, None)}
    touched = spark.read.parquet(path).filter("epoch = 3").select("bucket").distinct().count()
    assert touched == 1
    with pytest.raises(ValueError, match="time"):
        write(spark.createDataFrame([("f", "a.py", "f3", None)], ROW), 4)


def test_versions_come_in_by_a_stream(spark, tmp_path):
    spark.createDataFrame([("f", "a.py", "f1", 1.0), ("x", "b.py", "x1", 1.0)], ROW).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROW).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(versions_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "at")).start()
    q.processAllAvailable()
    q.stop()
    assert state(versions(spark, str(tmp_path / "out"))) == {("f", "f1", 1.0, None), ("x", "x1", 1.0, None)}


def test_sessions_end_after_a_gap(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "user_id int, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    assert sorted((r.user_id, r.events) for r in sessions(events).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_owners(spark):
    texts = spark.createDataFrame([("# all\n*  @a @b\n\nsrc/ @c\nbare\n",)], "text string")
    assert sorted((r.pattern, r.owner) for r in src.code_owners(texts).collect()) == [("*", "@a"), ("*", "@b"), ("src/", "@c")]
    owned = spark.createDataFrame([("m@x", "m", "a.py", 1), ("n@x", "n", "a.py", 3), ("n@x", "n", "b.py", 1)], "email string, name string, file string, commits long")
    assert [(r.email, r.commits) for r in src.who_owns(owned, spark.createDataFrame([("a.py",)], "file string")).collect()] == [("n@x", 3), ("m@x", 1)]


def test_saving_replaces_only_what_it_brings(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "repo string, n int")
    snapshots.save(rows(("a", 1), ("b", 2)), path, "repo")
    snapshots.save(rows(("b", 3)), path, "repo")
    assert {(r.repo, r.n) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    assert {r.repo for r in snapshots.cached(spark, path, "repo").collect()} == {"a", "b"}


def test_nodes_and_first_event(spark):
    runs = spark.createDataFrame([("k", 1), ("k", 1), ("k", 2)], "kind string, n int")
    assert temporal.execution_nodes(runs, "kind", "n").count() == 2
    assert timeline.baseline(runs).first().asDict() == {"category": "FEATURE_INTRODUCED", "subject": "", "n": 3}


def test_a_specialist_that_fails_leaves_the_others(spark):
    def broken(issues, symbols, edges):
        return issues.select("no such column")

    def works(issues, symbols, edges):
        return issues.select(F.lit("test").alias("agent"), "title")

    issues = spark.createDataFrame([("Use of eval()",)], "title string")
    with pytest.warns(UserWarning, match="broken failed"):
        out = swarm.findings(issues, issues, issues, {"broken": broken, "works": works})
    assert [(r.agent, r.agent_ord) for r in out.collect()] == [("test", 1)]
    assert swarm.advised(out).first().advice == "cover"


def test_block_ends_and_remarks():
    lines = ["// one", "/** Two.", " * three */", "a() {", "  b() {", "  }", "}", "c;", "d() { }", "{"]
    assert extract.brace_ends(lines) == [7, 7, 7, 7, 6, 9, 9, 9, 9, 10]
    assert [doc() for doc in extract._remarks(lines, True)][3] == "Two. three"
    assert extract.indent_ends(["a", " b", "", "  c", " d", "e"]) == [5, 4, 6, 4, 5, 6]
