"""Symbols, references and imports out of source texts. Parsing keeps state from line to line, so it runs in Python, a batch of files at a time; the rest is joins."""

from __future__ import annotations

import ast
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphlake.config import LIMITS
from graphlake.functions import rules
from graphlake.operators.script import script

SYMBOLS = "array<struct<name:string,kind:string,line:int,end_line:int,signature:string,doc:string,exported:boolean,container:string,complexity:int>>"
REFS = "array<struct<name:string,line:int>>"
IMPORTS = "array<struct<local:string,imported:string,path:string>>"

#: Text -> symbols and imports, and maybe references.
Extractor = Callable[[str], tuple[list[dict], ...]]
_registry: dict[str, Extractor] = {}


def register(extensions: list[str], extractor: Extractor) -> None:
    """An extractor for files of these extensions; the first registration of an extension holds. Without references of its own, every name before a parenthesis is one."""
    for e in extensions:
        _registry.setdefault(e, extractor)


def _remark(line: str, script: bool) -> str | None:
    """What a comment line says; None if it is code."""
    t = line.strip()
    if not script:
        return t[1:].removeprefix(" ") if t.startswith("#") else None
    if t.startswith(rules.REMARK_STARTS) or t.endswith("*/"):
        return re.sub(rules.REMARK_LEAD, "", t.removesuffix("*/")).strip()
    return None


def _remarks(lines: list[str], script: bool) -> Iterator[Callable[[], str | None]]:
    """For each line, a function that gives the text of the comment that ends right above it: the comment lines since the last line of code, or since the last that opens a block comment."""
    said: list[str] = []

    def text() -> str | None:
        doc = " ".join(filter(None, said)).strip()
        return doc[: LIMITS.doc_chars] if len(doc) > 2 else None

    for line in lines:
        yield text
        words = _remark(line, script)
        if words is None or (script and line.strip().startswith("/**")):
            said.clear()
        if words is not None:
            said.append(words)


def brace_ends(lines: list[str]) -> list[int]:
    """The last line (from 1) of the braces that open at or after each line, for all lines in one pass: a line waits until a brace opens, then until the depth is back at what it was before the line. Without an end within ``block_lines`` it is the line itself."""
    ends, depth = list(range(1, len(lines) + 1)), 0
    unopened: list[tuple[int, int]] = []
    opened: list[tuple[int, int]] = []  # a heap, the deepest first
    for i, line in enumerate(lines):
        unopened.append((-depth, i))
        if "{" in line:
            for start in unopened:
                heapq.heappush(opened, start)
            unopened.clear()
        depth += line.count("{") - line.count("}")
        while opened and -opened[0][0] >= depth:
            _, start = heapq.heappop(opened)
            if i - start < LIMITS.block_lines:
                ends[start] = i + 1
    return ends


def indent_ends(lines: list[str]) -> list[int]:
    """The last line (from 1) before each line's indentation is met again, for all lines in one pass."""
    ends, around = [len(lines)] * len(lines), []
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        width = len(line) - len(line.lstrip())
        while around and around[-1][0] >= width:
            ends[around.pop()[1]] = i
        around.append((width, i))
    return ends


def complexity(body: str) -> int:
    """1 and one for each branch: if, for, while, do, catch, case, ?:, && and ||. Strings and comments are not told apart."""
    return 1 + len(re.findall(rules.BRANCH, body))


def _symbol(name: str, kind: str, line: int, end: int, signature: str, doc: str | None, exported: bool, container: str | None, branches: int | None = None) -> dict:
    return {
        "name": name, "kind": kind, "line": line, "end_line": end, "signature": signature,
        "doc": doc, "exported": exported, "container": container, "complexity": branches,
    }


def _listed(names: str) -> list[tuple[str, str]]:
    """(imported, local) of a list of names with or without other names for them; a star is none."""
    parts = [re.split(rules.RENAMED, x.strip()) for x in names.split(",") if x.strip()]
    return [(p[0], p[-1]) for p in parts if p != ["*"]]


def _bound(path: str, *pairs: tuple[str, str | None]) -> list[dict]:
    return [{"local": local, "imported": imported, "path": path} for imported, local in pairs if local]


def _script_declaration(raw: str, react: bool, in_class: bool) -> tuple[str, str, str] | None:
    """(kind, name, signature) of what a line declares."""
    t = raw.strip()
    if m := re.match(rules.SCRIPT_TYPE, t):
        return m[1], m[2], re.sub(r"\s*\{.*$", "", t)
    if m := re.match(rules.SCRIPT_FUNCTION, t):
        return "function", m[1], f"function {m[1]}{m[2]}"
    if m := re.match(rules.SCRIPT_CONST, t):
        return "component" if react and m[1][0].isupper() else "function", m[1], re.sub(r"\s*=>.*$", " =>", t)[: LIMITS.signature_chars]
    if in_class and (m := re.match(rules.SCRIPT_METHOD, raw)) and m[1] not in rules.NO_METHODS:
        return "method", m[1], m[1] + m[2]
    return None


def script_lines(text: str) -> tuple[list[dict], list[dict]]:
    """Symbols and imports of a script by its lines alone, for texts that are no whole files: a class holds what lies before its end, the latest one counts."""
    lines, out, imports = text.split("\n"), [], []
    ends, react = brace_ends(lines), "react" in text
    owner, until = None, 0
    for n, (raw, doc) in enumerate(zip(lines, _remarks(lines, True), strict=True), 1):
        t = raw.strip()
        if found := _script_declaration(raw, react, n <= until):
            kind, name, signature = found
            end, method = ends[n - 1], kind == "method"
            branches = None if kind in ("class", "interface") else complexity("\n".join(lines[n - 1 : end]))
            out.append(_symbol(name, kind, n, end, signature, doc(), method or t.startswith("export"), owner if method else None, branches))
            if kind == "class":
                owner, until = name, end
        if m := re.match(rules.SCRIPT_IMPORT, t):
            imports += _bound(m[4], ("default", m[1]), ("*", m[3]), *_listed(m[2] or ""))
    return out, imports


def python(text: str) -> tuple[list[dict], list[dict]]:
    """Symbols and imports of a Python module, by its lines."""
    lines, out, imports = text.split("\n"), [], []
    ends = indent_ends(lines)
    owner, until = None, 0
    for n, (raw, doc) in enumerate(zip(lines, _remarks(lines, False), strict=True), 1):
        t, end = raw.strip(), ends[n - 1]
        if m := re.match(rules.PYTHON_CLASS, t):
            owner, until = m[1], end
            out.append(_symbol(m[1], "class", n, end, t.removesuffix(":"), doc(), not m[1].startswith("_"), None))
        elif m := re.match(rules.PYTHON_DEF, raw):
            within = owner if m[1] and n <= until else None
            out.append(_symbol(m[2], "method" if within else "function", n, end, f"def {m[2]}{m[3]}", doc(), not m[2].startswith("_"), within))
        if m := re.match(rules.PYTHON_FROM, t):
            imports += _bound(m[1], *_listed(m[2]))
        elif m := re.match(rules.PYTHON_IMPORT, t):
            imports += _bound(m[1], ("*", m[2] or m[1].split(".")[0]))
    return out, imports


register(rules.SCRIPTS, script)
register([".py"], python)


def references(text: str) -> list[dict]:
    """Every name of two letters or more before a parenthesis, definitions included."""
    lines = enumerate(text.split("\n"), 1)
    return [{"name": m[1], "line": n} for n, line in lines for m in re.finditer(rules.CALLED, line) if len(m[1]) >= 2]


#: Files whose rows a task holds as Python objects at once.
SLICE = 32


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most: what is made of a batch in Python is many times its bytes, and Spark's batches grow with the input."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def extracted(files: DataFrame) -> DataFrame:
    """files (rel, ext, text) -> (file, symbols, refs, imports, error); a text that can't be read gives an error, not a failure."""
    known = dict(_registry)
    ddl = f"file string, symbols {SYMBOLS}, refs {REFS}, imports {IMPORTS}, error string"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for rel, ext, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = {"file": rel, "symbols": [], "refs": [], "imports": [], "error": None}
                try:
                    row["symbols"], row["imports"], *refs = known[ext](text)
                    row["refs"] = refs[0] if refs else references(text)
                except Exception as e:  # noqa: BLE001
                    row["error"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    used = files.filter(F.col("text").isNotNull() & F.col("ext").isin(list(known))).select("rel", "ext", "text")
    return used.mapInArrow(run, ddl)


NODES = "array<struct<id:string,type:string,name:string,fqn:string,path:string,body_sig:string>>"
EDGES = "array<struct<rel:string,src:string,dst:string>>"


def python_facts(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of a Python module by its syntax tree: file, functions, classes, methods, dependencies; what contains, defines, calls and imports what."""
    from graphlake.functions.scalars import stable_id

    tree = ast.parse(text)
    nodes, edges, functions = [], [], {}

    def node(kind: str, name: str, fqn: str, body: list | None = None) -> str:
        key = f"{kind.lower()}:{fqn}"
        sig = hashlib.sha256("\n".join(ast.unparse(x) for x in body).encode()).hexdigest()[:16] if body is not None else None
        nodes.append({"id": stable_id(key), "type": kind, "name": name, "fqn": fqn, "path": path, "body_sig": sig})
        return nodes[-1]["id"]

    def edge(rel: str, src: str, dst: str) -> None:
        if {"rel": rel, "src": src, "dst": dst} not in edges:
            edges.append({"rel": rel, "src": src, "dst": dst})

    top = node("File", path, path)
    callable_ = ast.FunctionDef | ast.AsyncFunctionDef
    bodies: list[tuple[str, ast.AST]] = []
    for item in tree.body:
        if isinstance(item, callable_):
            functions[item.name] = node("Function", item.name, f"{path}::{item.name}", item.body)
            edge("CONTAINS", top, functions[item.name])
            bodies.append((functions[item.name], item))
        elif isinstance(item, ast.ClassDef):
            owner = node("Class", item.name, f"{path}::{item.name}", item.body)
            edge("CONTAINS", top, owner)
            for sub in item.body:
                if isinstance(sub, callable_):
                    method = node("Method", sub.name, f"{path}::{item.name}.{sub.name}", sub.body)
                    edge("DEFINES", owner, method)
                    bodies.append((method, sub))
    for item in ast.walk(tree):
        if isinstance(item, ast.Import | ast.ImportFrom):
            for name in [a.name for a in item.names] if isinstance(item, ast.Import) else [item.module or "."]:
                dep = stable_id(f"dependency:{name}")
                if all(n["id"] != dep for n in nodes):
                    node("Dependency", name, name)
                edge("IMPORTS", top, dep)
    for caller, body in bodies:
        for item in ast.walk(body):
            if isinstance(item, ast.Call) and isinstance(item.func, ast.Name) and item.func.id in functions:
                edge("CALLS", caller, functions[item.func.id])
    return nodes, edges


def python_graph(files: DataFrame) -> DataFrame:
    """files (rel, text) -> (file, nodes, edges, error)."""
    ddl = f"file string, nodes {NODES}, edges {EDGES}, error string"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for rel, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    nodes, edges = python_facts(rel, text)
                    rows.append({"file": rel, "nodes": nodes, "edges": edges, "error": None})
                except (SyntaxError, ValueError) as e:
                    rows.append({"file": rel, "nodes": [], "edges": [], "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("rel", "text").mapInArrow(run, ddl)
