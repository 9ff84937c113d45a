"""An index computes what is asked of it, and edits are applied where the texts are."""

import duckdb
import pytest
from pyspark.sql import functions as F

from graphlake.operators import fix, index, lines
from graphlake.plans import code  # noqa: F401  it adds its queries
from graphlake.plans.tables import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["index_scores", "fix_run"])
def test_issues_need_no_symbols(spark, monkeypatch, name):
    def never(files):
        raise AssertionError("symbols were extracted, but only issues asked for")

    monkeypatch.setattr(index.extract, "extracted", never)
    run, sql = QUERIES[name]
    db = duckdb.connect()
    for t in ("part", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert sorted(map(tuple, run(spark, DATA).collect())) == sorted(db.execute(sql).fetchall())


def test_edits_are_applied_to_texts(spark):
    texts = {"a.ts": "console.log(1)\nx\n// TODO: y\nz", "b.ts": "x\ntry {} catch (e) {}\nconsole.log(2)", "c.ts": "// TODO\nconsole.log(3)", "d.ts": "plain\n", "e.ts": "", "f.bin": None}
    files = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(texts.items())], "rel string, text string, ord int")
    edits = fix.merged(lines.lines(files.filter("text is not null")))
    after = fix.applied(files, edits)
    assert after.columns == files.columns
    assert {r.rel: r.text for r in after.collect()} == texts | {"a.ts": "x\nz", "b.ts": "x\ntry {} catch (e) { /* intentionally ignored */ }", "c.ts": ""}
    many = spark.createDataFrame([("m.ts", "\n".join("console.log(1)" if k % 3 == 0 else f"x{k}" for k in range(3000)), 0)], "rel string, text string, ord int")
    assert fix.applied(many, fix.merged(lines.lines(many))).first().text == "\n".join(f"x{k}" for k in range(3000) if k % 3)


def test_a_fix_run_empties_a_file_of_debug_output_alone(spark):
    files = spark.createDataFrame([("src/a.ts", ".ts", "typescript", "console.log(1)", 1, 0), ("src/b.ts", ".ts", "typescript", "x", 1, 1)], "rel string, ext string, language string, text string, loc int, ord long")
    run = index.fixed(files)
    assert {r.rel: r.loc for r in run.after.files.select("rel", F.col("loc")).collect()} == {"src/a.ts": 0, "src/b.ts": 1}
    assert [(r.file, r.title, r.change) for r in run.evolution.issues.collect()] == [("src/a.ts", "Leftover debug output", "resolved")]
