"""Queries over source files of three languages that are rendered from parts: classes, methods, arrow functions, docs, branches that only look like ones, all ways to import, equal names in many files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.operators import extract, resolve
from graphlake.operators import lines as text_lines
from graphlake.operators.graph import settled
from graphlake.plans.tables import of, table
from graphlake.sources import files as src

PER_FILE = 40

SCRIPT_HEAD = 'import base{g}, {{ one as first{g}, two }} from "./other";\nimport * as all{g} from "../m{m}/f{n}";\n'
SCRIPT_PARTS = [
    '/** Part {k}. */\nexport class Part{k} {{\n  run(a) {{\n    const s = "if (x) {{ && }}"; // if (y) {{\n    if (a && a.ok) {{ return s; }}\n    return a ? `{{${{a || 1}}` : 2;\n  }}\n}}\n',
    'export const part{k} = (a) => {{\n  for (const x of a) {{ while (x) {{ }} }}\n  return /[{{"]if/.test(a);\n}};\n',
    "// Says {k}.\nfunction part{k}(a) {{ // }}\n  switch (a) {{ case 1: return '}}'; case 2: return \"{{\"; default: return a ?? a?.b; }} }}\n",
    "async function part{k}(a, b = 1) {{\n  try {{ do {{ part{before}(a) }} while (b) }} catch (e) {{ }}\n}}\n",
]
PYTHON_HEAD = "import os.path as p{g}\nfrom ..m{m}.f{n} import part{n}, helper as other\n"
PYTHON_PARTS = [
    "# Holds {k}.\nclass Part{k}(Base):\n    def run(self):\n        return helper(self)\n\n    def _own(self):\n        pass\n",
    "def part{k}(a):\n    if a:\n        return helper(a)\n",
    "async def _part{k}(a):\n\n    return a\n",
    "\ndef helper(x):\n    return x\n",
]


def _rendered(template: str, **values: Column) -> Column:
    """A template with its fields filled in; doubled braces are plain ones."""
    out, rest = [], template.replace("{{", "\u0001").replace("}}", "\u0002")
    plain = lambda t: F.lit(t.replace("\u0001", "{").replace("\u0002", "}"))
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [plain(head), values[name].cast("string")]
    return F.concat(*out, plain(rest))


def _files(spark: SparkSession, sf_dir: str, head: str, parts: list[str], path: str) -> DataFrame:
    """(rel, text, ord): a file of each 40 parts, a part's text by its id."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("k"), F.floor(k / PER_FILE).cast("long").alias("g"))
    texts = [_rendered(t, k=F.col("k"), before=F.col("k") - 1) for t in parts]
    text = F.element_at(F.array(*texts), (F.col("k") % len(parts) + 1).cast("int"))
    own = p.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda s: s["t"]), "").alias("text"))
    values = {"g": F.col("g"), "m": (F.col("g") + 1) % 7, "n": F.col("g") + 1}
    return src.with_language(own.select(_rendered(path, m=F.col("g") % 7, g=F.col("g")).alias("rel"), F.concat(_rendered(head, **values), "text").alias("text"), F.col("g").alias("ord")))


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, SCRIPT_HEAD, SCRIPT_PARTS, "lib/m{m}/f{g}.ts")


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, PYTHON_HEAD, PYTHON_PARTS, "lib/m{m}/f{g}.py")


def _sql_parts(parts: list[str], ext: str) -> str:
    """pt (k, g, file, kind, line): where each part's text begins."""
    lengths = ", ".join(str(t.count("\n")) for t in parts)
    return f"""pt AS (SELECT p_partkey AS k, p_partkey // {PER_FILE} AS g, 'lib/m' || (p_partkey // {PER_FILE} % 7) || '/f' || (p_partkey // {PER_FILE}) || '{ext}' AS file, p_partkey % 4 AS kind,
CAST(3 + coalesce(sum([{lengths}][p_partkey % 4 + 1]) OVER (PARTITION BY p_partkey // {PER_FILE} ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS line FROM part)"""


#: kind of text, prefix of the name, kind, first and last line from the text's, signature, doc, exported, in the class, complexity
SCRIPT_ROWS = """(0, 'Part', 'class', 1, 7, 'export class Part' || k, 'Part ' || k || '.', true, false, NULL), (0, 'run', 'method', 2, 6, 'run(a)', NULL, false, true, 5),
(1, 'part', 'function', 0, 3, '(a) =>', NULL, true, false, 3), (2, 'part', 'function', 1, 2, 'function part' || k || '(a)', 'Says ' || k || '.', false, false, 3),
(3, 'part', 'function', 0, 2, 'async function part' || k || '(a, b = 1)', NULL, false, false, 3)"""
SQL_SCRIPT = f"""{_sql_parts(SCRIPT_PARTS, '.ts')},
sy AS (SELECT k, g, file, CASE WHEN prefix = 'run' THEN 'run' ELSE prefix || k END AS name, v.kind, line + a AS line, line + b AS end_line, signature, doc, exported, inside, complexity,
  CASE WHEN inside THEN file || '#Part' || k || '@' || (line + 1) END AS container
  FROM pt, LATERAL (SELECT * FROM (VALUES {SCRIPT_ROWS}) t(text_kind, prefix, kind, a, b, signature, doc, exported, inside, complexity) WHERE text_kind = pt.kind) v)"""


@of(f"WITH {SQL_SCRIPT} SELECT file, name, kind, line, end_line, signature, CAST(doc AS VARCHAR) AS doc, exported, container, CAST(complexity AS INT) AS complexity FROM sy")
def script_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, methods, arrow and other functions, with what only looks like braces and branches among them."""
    symbols = resolve.symbols_of(settled(extract.extracted(script_files(spark, sf_dir))))
    return symbols.select("file", "name", "kind", "line", "end_line", "signature", "doc", "exported", "container", "complexity")


@of(f"""WITH {SQL_SCRIPT} SELECT a.file || '#' || a.name || '@' || a.line AS src, b.file || '#' || b.name || '@' || b.line AS dst, 'calls' AS kind FROM sy a JOIN sy b ON b.k = a.k - 1 AND a.k % 4 = 3 AND a.g = b.g
UNION ALL SELECT container, file || '#run@' || line, 'contains' FROM sy WHERE inside""")
def script_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = settled(script_files(spark, sf_dir))
    return resolve.symbol_graph(files, settled(extract.extracted(files)))[1].select("src", "dst", "kind")


@of(f"""WITH f AS (SELECT DISTINCT p_partkey // {PER_FILE} AS g FROM part)
SELECT 'lib/m' || (g % 7) || '/f' || g || '.ts' AS file, local, imported, path FROM f, LATERAL (VALUES ('base' || g, 'default', './other'), ('first' || g, 'one', './other'), ('two', 'two', './other'), ('all' || g, '*', '../m' || ((g + 1) % 7) || '/f' || (g + 1))) v(local, imported, path)""")
def script_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default, renamed, plain and star imports."""
    return extract.extracted(script_files(spark, sf_dir)).select("file", F.explode("imports").alias("i")).select("file", "i.*")


PYTHON_ROWS = """(0, 'Part', 'class', 1, 6, 'class Part' || k || '(Base)', 'Holds ' || k || '.', true), (0, 'run', 'method', 2, 4, 'def run(self)', NULL, true), (0, '_own', 'method', 5, 6, 'def _own(self)', NULL, false),
(1, 'part', 'function', 0, 2, 'def part' || k || '(a)', NULL, true), (3, 'helper', 'function', 1, 2, 'def helper(x)', NULL, true)"""


@of(f"""WITH {_sql_parts(PYTHON_PARTS, '.py')}, n AS (SELECT g, max(k) AS top FROM pt GROUP BY g)
SELECT file, CASE WHEN prefix IN ('Part', 'part') THEN prefix || k ELSE prefix END AS name, v.kind, CAST(line + a AS INT) AS line, signature, CAST(doc AS VARCHAR) AS doc, exported
FROM pt JOIN n ON n.g = pt.g, LATERAL (SELECT * FROM (VALUES {PYTHON_ROWS}) t(text_kind, prefix, kind, a, b, signature, doc, exported) WHERE text_kind = pt.kind) v
UNION ALL SELECT file, '_part' || k, 'function', line, 'def _part' || k || '(a)', NULL, false FROM pt WHERE kind = 2""")
def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = resolve.symbols_of(settled(extract.extracted(python_files(spark, sf_dir))))
    return symbols.select("file", "name", "kind", "line", "signature", "doc", "exported")


@of(f"""WITH f AS (SELECT DISTINCT p_partkey // {PER_FILE} AS g FROM part)
SELECT 'lib/m' || (g % 7) || '/f' || g || '.py' AS file, local, imported, path FROM f, LATERAL (VALUES ('p' || g, '*', 'os.path'), ('part' || (g + 1), 'part' || (g + 1), '..m' || ((g + 1) % 7) || '.f' || (g + 1)), ('other', 'helper', '..m' || ((g + 1) % 7) || '.f' || (g + 1))) v(local, imported, path)""")
def python_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(python_files(spark, sf_dir)).select("file", F.explode("imports").alias("i")).select("file", "i.*")


@of(f"""WITH f AS (SELECT DISTINCT p_partkey // {PER_FILE} AS g FROM part)
SELECT 'lib/m' || (a.g % 7) || '/f' || a.g || '.py' AS source, 'lib/m' || (b.g % 7) || '/f' || b.g || '.py' AS target, '..m' || (b.g % 7) || '.f' || b.g AS spec FROM f a JOIN f b ON b.g = a.g + 1""")
def python_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative imports of modules; the names that they bring are no modules."""
    files = settled(python_files(spark, sf_dir))
    return resolve.import_graph(files, src.imports(files)).filter(~F.col("spec").rlike(r"\.(part[0-9]+|helper)$"))


@of(f"""WITH f AS (SELECT DISTINCT p_partkey // {PER_FILE} AS g FROM part), d AS (SELECT g, 'pkg/d' || (g % 5) AS dir, 'pkg/d' || (g % 5) || '/g' || g || '.go' AS file FROM f)
SELECT a.file AS source, b.file AS target, 'example.org/repo/pkg/d' || (b.g % 5) AS spec FROM d a JOIN d b ON b.g % 5 = (a.g + 1) % 5""")
def go_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file imports the next directory, whose path is the longest suffix that is one of the repository; and two packages from outside."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / PER_FILE).cast("long").alias("g")).distinct()
    text = _rendered('package x\nimport (\n  "fmt"\n  a "example.org/repo/pkg/d{n}"\n)\nimport "os"\n', n=(F.col("g") + 1) % 5)
    files = settled(src.with_language(p.select(_rendered("pkg/d{d}/g{g}.go", d=F.col("g") % 5, g=F.col("g")).alias("rel"), text.alias("text"), F.col("g").alias("ord"))))
    return resolve.import_graph(files, src.imports(files))


@of(f"""WITH {_sql_parts(PYTHON_PARTS, '.py')}, h AS (SELECT *, line + 1 AS ln FROM pt WHERE kind = 3), own AS (SELECT g, max(ln) AS ln FROM h GROUP BY g),
c AS (SELECT file, g, file || '#run@' || (line + 2) AS src FROM pt WHERE kind = 0 UNION ALL SELECT file, g, file || '#part' || k || '@' || line FROM pt WHERE kind = 1),
last AS (SELECT file, max(ln) AS ln FROM h GROUP BY file ORDER BY file DESC LIMIT 1)
SELECT src, coalesce(c.file || '#helper@' || own.ln, (SELECT file || '#helper@' || ln FROM last)) AS dst FROM c LEFT JOIN own ON own.g = c.g""")
def own_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that every file defines several times: the last definition of the file is meant, and without one the last exported anywhere."""
    files = settled(python_files(spark, sf_dir))
    edges = resolve.symbol_graph(files, settled(extract.extracted(files)))[1]
    # A definition is a reference too, so a helper that is defined again seems to call the last.
    return edges.filter("kind = 'calls' and contains(dst, '#helper@') and not contains(src, '#helper@')").select("src", "dst")


#: Patterns and whether a loop of them reads some word in two ways.
PATTERNS = [
    (r"^(a+)+$", True), (r"[a-z]+-\d+", False), (r"(\w+\s?)*$", True), (r"(ab)*", False), (r"(a|[ab])+x", True), (r"(\w+,)*\w+", False), (r"(x+x+)+y", True), (r"^(?:[0-9]{2,4};)+$", False), (r"(.*)*=", True), (r"a{3}b{2,}", False),
]
SQL_BAD = ", ".join(str(k) for k, (_, bad) in enumerate(PATTERNS) if bad)


@of(f"""WITH h AS (SELECT 'lib/p' || (p_partkey // 200) || '.js' AS file, CAST(2 * row_number() OVER (PARTITION BY p_partkey // 200 ORDER BY p_partkey) AS INT) AS line, p_partkey % {len(PATTERNS)} AS kind FROM part)
SELECT file, line FROM h WHERE kind IN ({SQL_BAD}) QUALIFY row_number() OVER (PARTITION BY file ORDER BY line) <= 10""")
def unsafe_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern literals, each after a line that only speaks of one."""
    k = F.col("p_partkey")
    pattern = F.element_at(F.array(*[F.lit(p) for p, _ in PATTERNS]), (k % len(PATTERNS) + 1).cast("int"))
    line = F.concat(F.lit("const s = '/(a+)+/'; // /(a+)+/\nconst r"), k.cast("string"), F.lit(" = /"), pattern, F.lit("/;"))
    rows = table(spark, sf_dir, "part").select(F.floor(k / 200).cast("string").alias("g"), k.alias("k"), line.alias("t"))
    text = rows.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda s: s["t"]), "\n").alias("text"))
    files = text.select(F.concat(F.lit("lib/p"), "g", F.lit(".js")).alias("rel"), F.lit(".js").alias("ext"), "text")
    return text_lines.unsafe_patterns(files).select("file", "line")
