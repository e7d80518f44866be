import json
import random
import tomllib

import pytest

from symweave.llm import sources as s
from symweave.llm.syntax import lexing

JAVA = r'''package a.b; import static java.util.List.*; import java.util.*;
/** doc { */ @FunctionalInterface public interface F<T extends Comparable<? super T> & Runnable> extends A<T>, B { int X = 1, Y[] = {1,2,}; default <R> R map(Function<? super T, ? extends R> f) throws E { return f.apply(null); } }
enum E implements I { A(1) { @Override int f() { return 2; } }, B, ; private final int v; E(int v) { this.v = v; } static { g("x\nA"); } }
record P<T>(int x, @NonNull T y) implements Q { P { if (x < 0) throw new X("neg" + x); } } public sealed abstract class S permits C, D {} non-sealed class D extends S {}
@interface Ann { String value() default "a"; int[] n() default {1, 2}; }
class Z<T> { int a[][] = new int[3][], b = 1; int[] c = new int[]{1,2}; Map<String, List<Integer>> m = new HashMap<>();
 synchronized void f(final int x, String... s) throws A, B { for (int k = 0, l = 1; k < 10 && l > 2; k++, l--) { continue; } for (;;) break; for (final var e : list) use(e); lbl: while (true) { break lbl; } do { i++; } while (i < 3);
 if (a) b(); else if (c) d(); else { e(); } switch (x) { case 1: case 2: f(); break; default: g(); } int y = switch (s) { case "a", "b" -> 1; case "c" -> { yield 2; } default -> throw new X(); };
 try (var r = open(); s2) { } catch (A | B e) { } finally { } synchronized (this) { } assert x > 0 : "m"; Runnable q = () -> {}; Function<I,I> h = v -> v + 1; z = (int) -1; boolean o2 = o instanceof String t && !t.isEmpty(); a >>= 2; int sh = a >> 2 >>> 3 << 1;
 new Thread() { public void run() {} }.start(); Supplier<List<String>> sup = ArrayList<String>::new; char ch = '\''; double dd = 1e10 + .5 + 1. + 0x1p3; String tb = """
   { "quoted" \""" (
   """; foo(a < b, c > d); }
}'''
RUST = r'''#![allow(dead_code)]
use std::{collections::{HashMap, *}, io::{self, Read as R}}; pub(crate) use crate::a::b as c;
#[derive(Debug)] pub struct A<'a, T: 'a + Clone + ?Sized, const N: usize> where T: Fn(i32) -> i32, for<'b> &'b T: X<Y = Z> { pub x: &'a mut T, y: [u8; N], z: Box<dyn Fn(&str) -> Result<(), E> + Send + 'static> }
struct U; struct V(pub i32); enum E { A, B(i32), C { x: u8 }, D = 4, } unsafe impl<T> Send for A<'_, T, 3> {}
trait T2<X>: Clone where X: Copy { const C: i32; type Item: Debug; fn f(&self) -> Self::Item; fn g(self: &Rc<Self>, mut x: i32) -> impl Iterator<Item = u8> + '_ { x } }
macro_rules! mm { ($x:expr, $($y:tt)*) => { $x + 1 }; } extern "C" { fn c(x: *const u8, ...) -> i32; }
fn main() -> Result<(), Box<dyn std::error::Error>> { let mut y: Vec<_> = Vec::<i32>::new(); let Some(z) = opt else { return Err("x".into()); }; let [a, .., c] = arr;
 if x == 5 && y > 3 { } else if let Some(v) = f() { g(v); } else { } 'outer: loop { break 'outer; } match x { 0 => {} 1 | 2 => println!("{}", x), 3..=5 if y => 7, n @ 6..=9 => n, Foo::Bar { a, b: (c, _) } => a, _ => unreachable!(), }
 let d = move || -> i32 { 5 }; v.iter().map(|x| x * 2).filter(|&&x| x > 1).collect::<Vec<_>>()?; let s = &x[1..]; let u = a as u8 as char; unsafe { g() }; let bs = b"x\x00"; let raw = r#"a"} b"#; let st = S { x: 1, ..y }; vec![1; 3]; let k = "multi {
line"; /* a /* nested { */ b */ let lt: &'static str = "x"; Ok(()) }
'''
VALID = {
    "java": [JAVA, "", "  \n", "// only a comment", "/* { */", ";", "package x;"], "rust": [RUST, "\ufeff#!/usr/bin/env run\nfn f() {}", "#![a]", "", "//! doc\n", "fn f() { if x { return 1 } 5 }"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}', "[]", ' "s" ', "0", '{"a":1,"a":2}'],
    "toml": ["", "# c\n", 'a = 1\nb.c = "x"\n"q r" = \'l\'\n[t]\n[[u.v]]\nd = 1979-05-27T07:32:00Z\nf = [1, 2, # c\n [3.0, "]"],\n]\ni = { a = 1, b = [true] }\n', 'm = """\nx = [\n"""\nl = \'\'\'\n[\n\'\'\'\n', "3.14 = inf\n"],
}
INVALID = {
    "java": ["class A {", "class A { void f() { int x = ; } }", "class A { void f() { g(1 } }", "class A { void f() { x } }", "class A { int x }", "<<<<<<< HEAD\nclass A {}", "class A { String s = \"x; }", "/* open", "class A {} }", "fn main() {}", '{"a": 1}', "class A { void f() { if (x { } } }", "class A { int x = 09; }", "class { }", "class A { void f() { return 1 } }", "class A { }", 'class A { String s = """ x """; }'],
    "rust": ["fn f() {", "fn f( { }", "fn f() { let x = ; }", "fn f() { let x 5; }", "struct A { x: }", "class A {}", "fn f() { x y }", "/* /* */", "fn f() -> { }", '"open', "=======\nfn f() {}", "fn f() { match x { 1 > 2 } }", "let x = 1;"],
    "json": ["", "{", "[1,]", "{'a': 1}", '{"a" 1}', "01", "NaN", '"a\nb"', '"\\x"', "[1] 2", "﻿{}", "// c\n{}"],
    "toml": ["a", "a = ", "a = 1 b = 2", "[a", "a = [1, 2", 'a = "x', "a = {\nb = 1\n}", "= 1", "a = 01", "[[a]", "a b = 1", "<<<<<<< x\n"],
}


def valid(text, language):
    return s.parses(lexing.whole_file(lexing.chunk_map(text, language, True)), language)


@pytest.mark.parametrize("language", s.LANGUAGES)
def test_grammars(language):
    assert [t for t in VALID[language] if not valid(t, language)] == []
    assert [t for t in INVALID[language] if valid(t, language)] == []


@pytest.mark.parametrize("language", ["json", "toml"])
def test_against_the_standard_library(language):
    rng = random.Random(4)
    bases = [t for t in VALID[language] if len(t) > 20]
    for _ in range(1500):
        t = list(rng.choice(bases))
        for _ in range(rng.randrange(1, 3)):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice(["", t[i] * 2, rng.choice('[]{},"=.1a \n')])
        text = "".join(t)
        try:
            json.loads(text, parse_constant=lambda c: 1 / 0) if language == "json" else tomllib.loads(text)
            known = True
        except (ValueError, ZeroDivisionError) as e:
            # Keys and tables that are given twice, and dates that don't exist, aren't a matter of grammar.
            known = None if any(w in str(e) for w in ("overwrite", "twice", "range", "immutable", "Cannot", "mutate", "must be in", "Duplicate", "day is")) else False
        if known is not None:
            assert valid(text, language) == known, text


def test_chunks_change_nothing(spark):
    cases = [(i, lang, t) for i, (lang, t) in enumerate((lang, t) for table in (VALID, INVALID) for lang in table for t in table[lang])]
    files = spark.createDataFrame(cases, "doc_id long, language string, text string")
    expected = {i: valid(t, lang) for i, lang, t in cases}
    for chunk, span in ((1, 3), (40, 2), (7, 1000), (s.CHUNK, s.SPAN)):
        rows = s.checked_files(files.union(files) if chunk == 40 else files, chunk, span).collect()
        assert {r.doc_id: r.valid for r in rows} == expected and len(rows) == len(expected)


def test_files_rates_and_edges(spark, at):
    docs = spark.createDataFrame(
        [(1, "source", "r", "a/A.java", "class A {}"), (2, "source", "r", "a/B.JAVA", "class"), (3, "source", "r", "x.py", "("), (4, "source", "r", None, "("), (5, "log", "r", "c.json", "("), (6, "source", "r", "e.json", None), (7, "source", "q", "f.rs", "fn f() {}\n" * 20_000)],
        "doc_id long, doc_kind string, repo string, file_path string, text string",
    )
    extensions = spark.createDataFrame([(".java", "java"), ("rs", "rust"), ("json", "json"), ("py", "python")], "extension string, language string")
    files = s.source_files(docs, extensions)
    assert {r.doc_id: r.valid for r in s.checked_files(files).collect()} == {1: True, 2: False, 6: False, 7: True}
    diagnostics = spark.createDataFrame([("r", "java_parse_error ", ".\\a\\b.java"), ("r", "JAVA_PARSE_ERROR", "a/A.java"), ("r", "OTHER", "e.json"), ("r", "JAVA_PARSE_ERROR", None)], "repo string, kind string, file_path string")
    summaries = spark.createDataFrame([("r", "java", "1", 3, at(1)), ("r", "java", "2", 1, at(2)), ("z", "rust", "3", 0, at(1)), ("r", "json", "4", None, at(1))], "repo string, language string, request_id string, files_failed long, finished_at timestamp_ntz")
    got = {(r.repo, r.language): (r.n_files, r.n_invalid, r.n_reported, r.n_reported_invalid, r.files_failed, r.invalid_share) for r in s.invalid_rates(docs, extensions, diagnostics, summaries).collect()}
    assert got == {("r", "java"): (2, 1, 2, 1, 1, 0.5), ("r", "json"): (1, 1, 0, 0, None, 1.0), ("q", "rust"): (1, 0, 0, 0, None, 0.0), ("z", "rust"): (0, 0, 0, 0, 0, None)}
    assert s.checked_files(files.limit(0)).collect() == []


DEPTH = 5_000
DEEP = {
    "java": [
        "class A { int x = %s1%s; }" % ("(" * DEPTH, ")" * DEPTH), "class A { void f() { %s %s } }" % ("if (a) {" * DEPTH, "}" * DEPTH),
        "class A { void f() { if (a) b(); %s else c(); } }" % ("else if (a) b(); " * DEPTH), "class A { int x = %s1%s; }" % ("f(a, b -> " * DEPTH, ")" * DEPTH), "class A { int x = %s 1; }" % ("- " * DEPTH),
    ],
    "rust": [
        "fn f() { let x = %s1%s; }" % ("(" * DEPTH, ")" * DEPTH), "fn f() { %s %s }" % ("if a {" * DEPTH, "}" * DEPTH), "fn f() { if a { b(); } %s else { c(); } }" % ("else if a { b(); } " * DEPTH),
        "fn f() { let x = %s1%s; }" % ("f(a, |b| " * DEPTH, ")" * DEPTH), "fn f() -> %su8%s { 1 }" % ("Vec<" * 1000, ">" * 1000), "mod a { " * DEPTH + "}" * DEPTH,
    ],
}


@pytest.mark.parametrize("language", DEEP)
def test_deep_files(language):
    for text in DEEP[language]:
        assert valid(text, language), text[:60]
        assert not valid(text + "}", language), text[:60]
    deep = "(" * DEPTH + "%s" + ")" * DEPTH
    around = "class A { int x = %s; }" if language == "java" else "fn f() { let x = %s; }"
    assert valid(around % (deep % "1"), language) and not valid(around % (deep % "1 1"), language)


def test_long_lines(spark):
    """One line in many tasks: its chunks begin within strings, comments and code."""
    n = 4000
    inside = {
        "json": ("[" + ",".join('"a,b;\\u0041 c"' for _ in range(n)) + ", 1]", ", 1]", ", 1,]"), "toml": ("a = [" + ", ".join("'x, y; z', \"p, q\"" for _ in range(n)) + "] # c, d", "] # c", "]] # c"),
        "java": ("class A { " + "int a = 1, b; String s = \"x, y; z\"; char c = ','; " * n + "} // e, f; g(", "} //", " //"), "rust": ("fn f() { " + "g(1, \"x, y; z\", ','); " * n + "} // e, f; g(", "} //", " //"),
    }
    rows = [(i, lang, text.replace(old, new) if wrong else text) for i, (lang, (text, old, new), wrong) in enumerate((lang, v, w) for lang, v in inside.items() for w in (False, True))]
    found = s.checked_files(spark.createDataFrame(rows, "doc_id long, language string, text string"), 500, 8).collect()
    assert {r.doc_id: r.valid for r in found} == {i: valid(t, lang) for i, lang, t in rows} == {i: not i % 2 for i in range(8)}


@pytest.mark.parametrize("language", s.LANGUAGES)
def test_joining_is_associative(language):
    rng = random.Random(9)
    for text in VALID[language] + INVALID[language]:
        ends = [i + 1 for i, c in enumerate(text[:-1]) if c == "\n" or c in ",;" and text[i + 1] != "'"]
        cuts = [0, *sorted(rng.sample(ends, min(len(ends), 6))), len(text)]
        pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        maps = [lexing.chunk_map(t, language, not i, i > 0 and not pieces[i - 1].endswith("\n")) for i, t in enumerate(pieces)]
        while len(maps) > 1:
            at = rng.randrange(len(maps) - 1)
            maps[at : at + 2] = [lexing.join(maps[at], maps[at + 1], language == "rust", not at)]
        assert s.parses(lexing.whole_file(maps[0]), language) == valid(text, language), text


def test_ten_thousand_levels():
    n = 10_000
    assert valid("[" * n + "]" * n, "json") and not valid("[" * n + "]" * (n - 1), "json") and valid("a = " + "[" * n + "{b = 1}, 2" + "]" * n, "toml")
    assert not valid("a = " + "[" * n + "]" * (n + 1), "toml") and not valid("a = " + "[" * n + "b" + "]" * n, "toml") and not valid('{"a":' * n + "1" + "}" * (n - 1) + "]", "json")
    assert valid("class A { int x = %s1%s; }" % ("(" * n, ")" * n), "java") and valid("fn f() { let x = %s1%s; }" % ("(" * n, ")" * n), "rust")
