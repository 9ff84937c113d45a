"""Golden cases of versions, evidence and timelines."""

import pytest
from pyspark.sql import functions as F

from graphlake.operators import fleet, temporal, timeline


def test_noisy_or(spark):
    rows = [("same", "SUPPORTS", "r", 0.8), ("same", "SUPPORTS", "r", 0.8), ("two", "SUPPORTS", "r", 0.8), ("two", "SUPPORTS", "s", 0.8), ("both", "SUPPORTS", "r", 0.9), ("both", "CONTRADICTS", "s", 0.6), ("sure", "SUPPORTS", "r", 1.0)]
    got = {r.claim: r.net for r in temporal.net_support(spark.createDataFrame(rows, "claim string, rel string, root string, confidence double")).collect()}
    assert got == {"same": pytest.approx(0.8), "two": pytest.approx(0.96), "both": pytest.approx(0.3), "sure": 1.0}


def test_changes_keep_history(spark):
    schema = "id string, file string, content_hash string, valid_from double, valid_to double"
    old = spark.createDataFrame([("f", "a.py", "f1", 100.0, None), ("g", "a.py", "g1", 100.0, None), ("x", "b.py", "x1", 100.0, None)], schema)
    new = spark.createDataFrame([("f", "a.py", "f1"), ("h", "a.py", "h1")], "id string, file string, content_hash string")
    out = temporal.apply_changes(old, new, spark.createDataFrame([("a.py",)], "file string"), 200.0)
    live = lambda t: {r.id for r in temporal.as_of(out, t).collect()}
    assert live(250.0) == {"f", "h", "x"} and live(150.0) == {"f", "g", "x"} and out.filter("id = 'f'").count() == 1
    gone = temporal.apply_changes(old, new.limit(0), spark.createDataFrame([("a.py",)], "file string"), 200.0)
    assert {r.id for r in temporal.as_of(gone, 250.0).collect()} == {"x"}
    beliefs = spark.createDataFrame([("b1", ["f", "g"]), ("b2", ["x"])], "id string, supporting array<string>")
    assert [r.id for r in temporal.stale_beliefs(beliefs, temporal.as_of(out, 250.0)).collect()] == ["b1"]
    assert temporal.insert_new(out.select("content_hash"), spark.createDataFrame([("g1",), ("n",), ("n",)], "content_hash string")).count() == out.count() + 1


def test_judge_rounds(spark):
    rows = [("win", 1, "a", 0.8, 1.0, 1.0, False), ("hard", 1, "a", 1.0, 1.0, 0.0, True), ("hard", 2, "b", 1.0, 1.0, 0.0, True), ("low", 1, "a", 0.5, 0.5, 0.0, False), ("low", 2, "b", 0.6, 0.5, 0.0, False)]
    df = spark.createDataFrame(rows, "task string, round int, id string, evidence double, verification double, risk double, hard_fail boolean")
    got = {r.task: (r.state, r.id) for r in temporal.judge_rounds(df).collect()}
    assert got == {"win": ("won", "a"), "hard": ("escalated", None), "low": ("fallback", "b")}


def test_cosine_search_and_envelopes(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, v array<double>")
    got = temporal.semantic_search(v, spark.createDataFrame([(1, [1.0, 0.0])], "query int, q array<double>"), 2).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "b"] and got[0].score == 1.0
    bad = temporal.invalid(spark.createDataFrame([("FACT", 1.0), ("FACT", 0.9), ("BELIEF", 0.5), ("BELIEF", 1.5)], "kind string, confidence double"))
    assert sorted(r.confidence for r in bad.collect()) == [0.9, 1.5]


def test_selection_of_commits(spark):
    days = [0, 10, 31, 40, 61, 62]
    df = spark.createDataFrame([("r", (1000 + d) * timeline.DAY, i, f"h{i}", ["tag: v1"] if d == 40 else []) for i, d in enumerate(days)], "repo string, ts long, seq long, hash string, refs array<string>")
    seqs = lambda x: sorted(r.seq for r in x.collect())
    assert seqs(timeline.periodic(df, timeline.MONTHLY)) == [0, 2, 4, 5]
    assert seqs(timeline.adaptive(df)) == [0, 2, 3, 4, 5] and seqs(timeline.every(df, 4)) == [0, 4]
    prev = {r.hash: r.previous for r in timeline.with_previous(df, df.filter("seq = 1")).collect()}
    assert prev["h2"] == "h1" and prev["h1"] is None and prev["h3"] is None


def test_events_and_fleet(spark):
    symbols = spark.createDataFrame([("s", "IApi", "class", "added"), ("t", "x", "interface", "removed")], "id string, name string, kind string, change string")
    files = spark.createDataFrame([("src/a", "added"), ("README", "added")] + [(f"o{i}", "removed") for i in range(6)], "id string, change string")
    edges = spark.createDataFrame([("added",)] * 11, "change string")
    got = {(r.category, r.subject, r.n) for r in timeline.events(symbols, files, edges).collect()}
    assert got == {("API_CHANGED", "", 1), ("MODULE_EXTRACTED", "src", 1), ("MODULE_EXTRACTED", "README", 1), ("REFACTOR", "", 6), ("DEPENDENCY_ADDED", "", 11)}
    repos = spark.createDataFrame([("1", "org/Lib", ["app"], 1), ("2", "app", ["lib", "app"], 2), ("3", "x/lib", [], 3)], "id string, name string, deps array<string>, created_at long")
    assert {(r.source, r.target, r.dep) for r in fleet.links(repos).collect()} == {("1", "2", "app"), ("2", "3", "lib")}


def test_streaming_churn(spark, tmp_path):
    from graphlake.streaming.live import churn_stream

    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 05:00:00"), ("b", "2024-01-20 00:00:00")], "file string, t string").select("file", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file string, ts timestamp").parquet(str(tmp_path / "in"))
    q = churn_stream(stream, "1 day", "1 day").writeStream.outputMode("complete").format("memory").queryName("churn_out").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.file, r.commits) for r in spark.sql("select file, commits from churn_out").collect()} == {("a", 2), ("b", 1)}
