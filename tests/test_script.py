import pytest

from graphlake.operators.script import Source, script

TEXT = """import def, { a as b, type c } from './x';
import * as ns from "y"; import type { Z } from 'z'
import './side';
/** Adds. */
export async function add<T>(a: number, b?: { x: string }): Promise<{ y: number }> {
  if (a && b || "if (x) { && }".length) { // if && {
    return helper(`t ${ call(`in ${deep(1)} {`) } }`) ? 1 : b ?? a;
  }
  const r = /[/{"']if(x)/g.test(a) ;
  do { x.y.run?.(); } while (a);
  switch (a) { case 1: break; default: }
  try { new Foo(bar()) } catch (e) { return a / b / c }
}
// trailing doc
// last doc
export default class Big extends Base<Foo> {
  name = "x"; // note
  constructor(private a: string) { super(a); }
  get size() { return 1 }
  /* does it */
  async run(x: number, cb: (n: number) => void): Promise<void> {
    const inner = (q) => q > 1 ? go(q) : 2;
    for (const z of x) while (z) {}
  }
  static make = () => { return new Big("a") }
}
interface Shape { area(): number; name?: string }
export const Arrow = async ({ a, b }: Props): Promise<void> => {
  await a.b.c(1);
};
const one = x => x + 1
const two = (y) =>
  y
    .map(one)
    .filter(z => z)
const notFn = (1 + 2)
let obj = { method(a) { return a || 1 }, other: function named() {} };
(function iife() {})();
const el = <div onClick={() => don(1)}>don't {x ? 'a' : "b"}</div>
function last() {}
"""


def test_symbols_calls_and_imports():
    symbols, imports, calls = script(TEXT)
    got = [(s["kind"], s["name"], s["line"], s["end_line"], s["doc"], s["exported"], s["container"], s["complexity"]) for s in symbols]
    assert got == [
        ("function", "add", 5, 13, "Adds.", True, None, 8),
        ("class", "Big", 16, 26, "last doc", True, None, None),
        ("method", "run", 21, 24, "does it", False, "Big", 4),
        ("function", "inner", 22, 22, None, False, None, 2),
        ("interface", "Shape", 27, 27, None, False, None, None),
        ("function", "Arrow", 28, 30, None, True, None, 1),
        ("function", "one", 31, 31, None, False, None, 1),
        ("function", "two", 32, 35, None, False, None, 1),
        ("method", "method", 37, 37, None, False, None, 2),
        ("function", "last", 40, 40, None, False, None, 1),
    ]
    assert [s["signature"] for s in symbols][:3] == ["export async function add<T>(a: number, b?:", "export default class Big extends Base<Foo>", "async run(x: number, cb: (n: number) => void): Promise<void>"]
    assert [(i["local"], i["imported"], i["path"]) for i in imports] == [("def", "default", "./x"), ("b", "a", "./x"), ("c", "c", "./x"), ("ns", "*", "y"), ("Z", "Z", "z")]
    assert [(c["name"], c["line"]) for c in calls] == [("helper", 7), ("call", 7), ("deep", 7), ("test", 9), ("run", 10), ("bar", 12), ("go", 22), ("c", 29), ("map", 34), ("filter", 35), ("don", 39)]
    assert [s["kind"] for s in script("import React from 'react';\nfunction View() {}\nconst use = () => 1;")[0]] == ["component", "function"]


def test_code_stands_where_the_text_does():
    s = Source(TEXT)
    assert len(s.code) == len(TEXT) and [k for k, c in enumerate(TEXT) if c == "\n"] == [k for k, c in enumerate(s.code) if c == "\n"]
    assert [p for _, p in s.patterns] == ["[/{\"']if(x)"]


@pytest.mark.parametrize("text", ["", "`", "`${", "`${`", "'", '"\\', "/*", "//", "/", "}}}", "(((", "a = /[", "class", "class A", "function f(", "const a = (", "import {a from 'x", "x = `${a}${`", "{" * 5000])
def test_broken_texts_are_read_to_their_end(text):
    assert len(Source(text).code) == len(text)
    script(text)
