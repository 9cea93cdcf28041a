"""The scanner of scripts: what is code and what only looks like it, spans, nesting and relations."""

import gc
import random

from weftgraph.operators import scripts

SOURCE = r'''
import React, { useState } from 'react';
import * as all from "./all"; // import x from 'no'
/* class Comment { } */
export * from './again';
const s = "class Str { m() {} }", re = /function bad\(\) {/g, d = a / b / c;
const tpl = `class T { ${ call1(`inner ${deep()} }`) } function no() {}`;
export default abstract class Box<T extends Base> extends lib.Base<T> implements A, B<C> {
  static #count = 0;
  private x: { a: string } = { a: 'q' };
  handler = async (e: Event): Promise<void> => { this.go(e); };
  constructor(private a: string, b = foo(1)) { super(a); init(b); }
  get size(): number { return this.items.length ? one() : two(); }
  static async *walk<T>(x: T): AsyncIterable<{ v: T }> {
    for (const y of x) { if (y && ok(y)) yield y; }
    function helper() { return new Other(nested()); }
  }
  abstract nobody(): void;
  #secret() { return /}/.test("}"); }
  'quoted'() { }
}
interface Shape extends One, Two<X> { area(): number; }
export const enum Color { Red, Green }
type Fn = (a: string) => { b: number };
type Union =
  | 'a'
  | 'b';
export const add = (a: number, b: number): number => a + plus(b);
const curry = a => b => call3(a, b), other = async function named() { hidden(); };
var later = async x => {
  await x.then(function () { cb(); });
};
export default function main(args) { add(1, 2); all.run(); lazy(import('./lazy')); const q = require("./req"); }
let notfn = call4();
if (a) { function inIf() {} }
'''


def test_symbols_with_spans_and_parents():
    found = [(r["start_line"], r["end_line"], r["kind"], r["name"], r["parent"]) for r in scripts._symbols("f", SOURCE)]
    assert found == [
        (8, 21, "class", "Box", None), (11, 11, "method", "handler", "Box"), (12, 12, "method", "constructor", "Box"), (13, 13, "method", "size", "Box"), (14, 17, "method", "walk", "Box"),
        (16, 16, "function", "helper", "walk"), (19, 19, "method", "#secret", "Box"), (22, 22, "interface", "Shape", None), (23, 23, "enum", "Color", None), (24, 24, "type_alias", "Fn", None),
        (25, 27, "type_alias", "Union", None), (28, 28, "function", "add", None), (29, 29, "function", "curry", None), (30, 32, "function", "later", None), (33, 33, "function", "main", None), (35, 35, "function", "inIf", None),
    ]
    by_name = {r["name"]: r for r in scripts._symbols("f", SOURCE)}
    assert by_name["Box"]["bases"] == ["lib.Base"] and by_name["Box"]["interfaces"] == ["A", "B"] and by_name["Shape"]["bases"] == ["One", "Two"]
    assert by_name["walk"]["is_static"] and by_name["walk"]["is_async"] and by_name["later"]["is_async"] and by_name["handler"]["is_async"] and not by_name["size"]["is_async"]
    assert by_name["#secret"]["visibility"] == "private" and by_name["walk"]["complexity"] == 4 and by_name["size"]["complexity"] == 2


def test_relations_are_those_of_code():
    found = {(r["source"], r["relation"], r["target"]) for r in scripts._relations("f", SOURCE)}
    calls = {("handler", "go"), ("constructor", "init"), ("size", "one"), ("size", "two"), ("walk", "ok"), ("helper", "Other"), ("helper", "nested"), ("#secret", "test"), ("add", "plus"), ("curry", "call3"), ("later", "then"), ("later", "cb"), ("main", "add"), ("main", "run"), ("main", "lazy")}
    assert {(s, t) for s, r, t in found if r == "CALLS"} == calls
    assert {t for _, r, t in found if r == "IMPORTS"} == {"react", "./all", "./again", "./lazy", "./req"}
    assert {(s, r, t) for s, r, t in found if r in ("EXTENDS", "IMPLEMENTS")} == {("Box", "EXTENDS", "lib.Base"), ("Box", "IMPLEMENTS", "A"), ("Box", "IMPLEMENTS", "B"), ("Shape", "EXTENDS", "One"), ("Shape", "EXTENDS", "Two")}


def test_any_text_has_an_end():
    r = random.Random(1)
    pieces = ["{", "}", "(", ")", "`", "${", "'", '"', "/", "class A ", "function f", "=>", "const x = ", "<", ">", "\n", " ", "a", "b(", ";", "/*", "*/", "//", ":", "?", "import 'x'", "\\"]
    for _ in range(2000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(60)))
        last = text.count("\n") + 1
        assert all(1 <= x["start_line"] <= x["end_line"] <= last for x in scripts._symbols("f", text))
        scripts._relations("f", text)
    for text in ("(" * 50_000, "`${" * 20_000, "<" * 20_000, "class A<" * 5000, "a<" * 20_000, "/*" * 30_000, "const x = (" * 5000, ""):
        assert len(scripts._symbols("f", text)) <= 1


def test_brackets_match():
    found = scripts.tokens("a(b[c], {d: `x${e}y`})")
    pair = scripts.matched(found)
    text = ["".join(t.text for t in found[k : p + 1]) for k, p in enumerate(pair) if p > k]
    assert text[0].startswith("(b[c]") and text[0].endswith("})") and text[1] == "[c]" and len(text) == 4


def test_a_plain_stretch_is_read_at_once(monkeypatch):
    class Reader:
        calls = 0

        def __getattr__(self, name):
            Reader.calls += 1
            return getattr(token, name)

    token = scripts.TOKEN
    monkeypatch.setattr(scripts, "TOKEN", Reader())
    code = 'a.b({x: "}", y: \'`\'}); // `\n/* / ` */ f(1.5 => c)\n' * 200
    found = scripts.tokens(code + "`x${ {y: `z${w}`} }\n`/2\n" + code)
    assert len(found) == 400 * 21 + 15 and Reader.calls <= 8
    assert [t.text for t in found if t.text[:1] in "`}" and t.kind == "text"] == ["`x", "`z", "}`", "}\n`"]
    assert found[-1].last == 802 and sum(t.text == "b" for t in found) == 400


def test_names_and_marks_are_no_objects():
    code = 'a.b({x: "}", y: 1.5}, c => d); // e\n' * 500
    gc.collect()
    before = len(gc.get_objects())
    scanner = scripts.Scanner(code)
    held = len(gc.get_objects()) - before
    assert len(scanner.pair) == 500 * 19 and held <= 2 * 500 + 100  # those of texts and numbers
    assert len(list(scanner.walk(names=True))) == 500 * 6 and not list(scanner.walk(names=False))


def test_lines_and_kinds_of_odd_tokens():
    found = scripts.tokens("#x # \u00e9a \u0663\n\n/* \n */ 'p\\\nq' \"${ `r\n${s}${t}` ?? ...u?.v // w\n/x\"/g / 2")
    assert [(t.kind[0], t.text, t.first, t.last) for t in found] == [
        ("n", "#x", 1, 1), ("m", "#", 1, 1), ("m", "\u00e9", 1, 1), ("n", "a", 1, 1), ("n", "\u0663", 1, 1), ("t", "'p\\\nq'", 4, 5), ("m", '"', 5, 5), ("n", "$", 5, 5), ("m", "{", 5, 5),
        ("t", "`r\n", 5, 6), ("m", "{", 6, 6), ("n", "s", 6, 6), ("m", "}", 6, 6), ("t", "}", 6, 6), ("m", "{", 6, 6), ("n", "t", 6, 6), ("m", "}", 6, 6), ("t", "}`", 6, 6),
        ("m", "??", 6, 6), ("m", "...", 6, 6), ("n", "u", 6, 6), ("m", "?.", 6, 6), ("n", "v", 6, 6), ("m", "/", 7, 7), ("n", "x", 7, 7), ("m", '"', 7, 7), ("r", "/g /", 7, 7), ("n", "2", 7, 7),
    ]
