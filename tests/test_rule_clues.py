"""Rules on tables of mostly clean texts: texts without a clue are not split, and no hit is lost for it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from graphlake.functions import rules
from graphlake.operators import lines
from graphlake.plans import tables

# A line for each alternative of each rule's pattern, in its shortest or oddest form.
HITS = {
    "Use of eval()": ["eval(", "x=eval \t ("],
    "Shell/process execution": ["xchild_processx", "os.system(", "subprocess.call(", "subprocess.run(", "subprocess.Popen("],
    "Possible hardcoded secret": ["PassWord='abcdef'", 'secret \t:  "abcdef\'', "api_key=\"abcdef'", "API-KEY:'abcdef'", "apikey='......x'", "ToKeN = 'a b c d e'"],
    "Hardcoded local URL": ["http://localhost", "https://127.0.0.1:80", "https://me@localhost/x"],
    "Raw HTML injection sink": ["dangerouslySetInnerHTML", "xinnerHTML  ="],
    "Possible SQL string concatenation": ["select  x+", "SeLeCt a from b where c = +", "query(`${", "QUERY( ' x ${"],
    "Leftover debug output": ["console.log", "x console.debug(", "print(", "   print("],
    "debugger statement": ["debugger", "(debugger)"],
    "Empty catch block": ["catch(){}", "} catch (e)  {  }"],
    "TODO/FIXME marker": ["TODO", "FIXME", "a HACK b", "XXX!"],
    "Suppressed checker": ["@ts-ignore", "@ts-nocheck", "# type: ignore", "x-eslint-disable-line"],
    "Untyped `any`": [":any", "x as  any"],
}
NEAR = ["", "medieval (", "my val", "spring +", "a = b: c", "say: 'it'", "many", "catch", "HTML =", "x print(", "subprocess.", "debuggers", "localhost", "token=''"]
TEXTS = [*(t for title, ts in HITS.items() if title != "Untyped `any`" for t in ts), *NEAR]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("texts"))
    texts = [*TEXTS, *(f"clean\n{t}\nclean" for t in TEXTS), *(f"{t}\n" for t in TEXTS), *(f"\n\n{t}" for t in TEXTS), "\n".join(TEXTS), "\n".join(["TODO"] * 9), "select\nx +", "eval\n(", "clean " * 50, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_each_hit_holds_a_clue(spark):
    assert list(HITS) == [r[0] for r in rules.LINE_RULES] and {*rules.LINE_CLUES, rules.SECRET} == {*HITS}
    for title, pattern, *_ in rules.LINE_RULES:
        df = spark.createDataFrame([(t,) for t in HITS[title]], "text string")
        assert df.filter(F.col("text").rlike(pattern)).count() == df.filter(rules.clue(F.col("text"), title)).count() == len(HITS[title])


def test_rules_of_some_files_ask_no_others(spark):
    files = spark.createDataFrame([("a.ts", "so many"), ("b.TSX", "x: any"), ("c.py", "x: any"), ("many", "x: any")], "rel string, text string")
    assert {r.rel for r in lines.suspects(files).collect()} == {"a.ts", "b.TSX"}
    assert {(r.file, r.title) for r in lines.rule_hits(lines.lines(lines.suspects(files))).collect()} == {("b.TSX", "Untyped `any`")}


@pytest.mark.parametrize("name", ["rule_hits", "dimension_scores"])
def test_queries_equal_their_sql(spark, folder, name):
    f, sql = tables.QUERIES[name]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in f(spark, folder).collect()) == sorted(db.sql(sql).fetchall())


@pytest.mark.parametrize("name", ["rule_hits", "dimension_scores"])
def test_clean_texts_are_not_split_into_lines(spark, folder, name):
    plan = tables.QUERIES[name][0](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and "Contains(text" in plan[plan.index("posexplode") :]
