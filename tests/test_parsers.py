import random
import signal

import pytest

from codeloom.sources.parsers import BY_EXTENSION, parse
from codeloom.sources.parsers.base import node_id


def shape(path, source):
    g = parse(path, source)
    name = {n[0]: n[1] for n in g.nodes}
    nodes = [(n[1], n[2], n[5]) for n in g.nodes if n[2] != "file"]
    edges = {(name.get(a), k, name.get(b)) for a, b, k, *_ in g.edges}
    return nodes, edges, g


def test_python():
    nodes, edges, g = shape("src/a.py", 'import os, sys as s\nfrom .u import f as g, h\nfrom __future__ import x\nclass A(B, m.C):\n    """Doc."""\n    async def run(self):\n        def inner():\n            pass\n        return outer(self.x().y())\n\nlam = lambda: z()\n')
    assert ("os", "import", 1) in nodes and not any(n[0] == "sys" for n in nodes)
    assert {(".u.f"), (".u.h")} <= {n[0] for n in nodes} and "__future__.x" not in {n[0] for n in nodes}
    assert ("run", "method", 6) in nodes and ("inner", "method", 7) in nodes
    assert {("A", "inherits", "B"), ("run", "calls", "outer"), ("run", "calls", "y"), ("run", "calls", "x"), ("a.py", "calls", "z")} <= edges
    assert not any(e[2] == "C" for e in edges)
    assert next(n for n in g.nodes if n[1] == "A")[7] == "Doc." and next(n for n in g.nodes if n[1] == "B")[10]
    assert g.nodes[0][:4] == (node_id("src/a.py", "__file__", 0, 0), "a.py", "file", "src/a.py")


def test_python_columns_are_bytes():
    g = parse("a.py", "x = 'é'; f()\n")
    call = next(n for n in g.nodes if n[2] == "call")
    assert call[0] == node_id("a.py", "call:f", 1, 10)
    assert [n[2] for n in parse("a.py", "def (:\n").nodes] == ["file"]


def test_chained_and_repeated_names_have_ids_of_their_own():
    for path, result in (("a.js", ""), ("a.java", "void ")):
        g = parse(path, f"class A {{ {result}m() {{ x.f().f(); }} }}")
        calls = [n[0] for n in g.nodes if n[2] == "call"]
        assert len(calls) == len(set(calls)) == 2
    g = parse("a.js", "function mul(){};function mul(){};")
    assert len({n[0] for n in g.nodes if n[1] == "mul"}) == 2


def test_typescript():
    nodes, edges, _ = shape("x.ts", """import { a } from "./utils";
export abstract class Dog<T> extends Animal implements P { static n = make(3);
  constructor(private a: string) { super(a); this.run(); }
  async speak<T>(x: number): Promise<void> { return helper(x => y(x)); }
  handler = () => { go(); }
}
interface I { f(): void }
const mk = (n: string): Dog => new Dog(n);
const f2 = async function() { await t(`a ${q("}")} b`); };
const o = { key: () => k1(), [c]: () => k2(), meth(a) { k3(); } };
useEffect(() => { cb(1); });
function plain(a = d()) { return /re\\/x(/.test(a) }
""")
    kinds = {n[0]: n[1] for n in nodes}
    assert kinds["./utils"] == "import" and kinds["Dog"] == "class" and kinds["speak"] == kinds["handler"] == kinds["key"] == kinds["meth"] == kinds["constructor"] == "method"
    assert kinds["mk"] == kinds["f2"] == kinds["plain"] == "function" and "I" not in kinds and "P" not in kinds and "x" not in kinds
    assert {("Dog", "inherits", "Animal"), ("Dog", "calls", "make"), ("speak", "calls", "y"), ("handler", "calls", "go"), ("f2", "calls", "q"), ("key", "calls", "k1"), ("x.ts", "calls", "k2"), ("x.ts", "calls", "cb"), ("plain", "calls", "d"), ("plain", "calls", "test")} <= edges
    assert ("mk", "calls", "Dog") not in edges


def test_go():
    nodes, edges, _ = shape("m.go", """package m
import (
  "os"
  a "x/y"
)
func (d *Dog) Speak(n int) (string, error) { fmt.Println(helper(n)); return "", nil }
type Dog struct { Animal
 name string `json:"x"` }
type Alias = Dog
func (u Unknown) X() {}
func Map[T any](x []T) T { return f(x) }
""")
    kinds = {n[0]: n[1] for n in nodes}
    assert kinds == {"os": "import", "x/y": "import", "Speak": "method", "Println": "call", "helper": "call", "Dog": "class", "Animal": "class", "X": "method", "Map": "function", "f": "call"}
    assert {("Dog", "contains", "Speak"), ("Dog", "inherits", "Animal"), ("Speak", "calls", "helper"), ("Map", "calls", "f")} <= edges and not any(e[2] == "X" for e in edges)


def test_rust():
    nodes, edges, _ = shape("m.rs", """use std::{fs::{self, File as F}, io::*};
pub struct Dog { name: String }
trait Speak { fn hi(&self) -> i32 { go(1) } fn no(&self); }
impl Speak for Dog { fn hi<'a>(&'a self) -> i32 { self.x(); T::new(2); println!("{}", bad(1)); helper('a', r#"x("# ) } }
impl std::fmt::Debug for Dog { fn show(&self) {} }
mod inner { pub(crate) async fn f() { v.collect::<Vec<_>>() } }
""")
    names = [n[0] for n in nodes]
    assert {"std::fs", "std::fs::File", "std::io::*", "std::fmt::Debug"} <= set(names) and "bad" not in names and "no" not in names
    assert {("Dog", "inherits", "Speak"), ("Dog", "inherits", "std::fmt::Debug"), ("Dog", "contains", "hi"), ("Speak", "contains", "hi"), ("hi", "calls", "new"), ("hi", "calls", "helper"), ("f", "calls", "collect")} <= edges
    assert ("f", "function", 6) in nodes


def test_java():
    nodes, edges, _ = shape("A.java", """package a.b;
import java.util.List;
import static com.foo.Bar.*;
@Ann(x = 1)
public class Dog<T> extends Animal implements Speak, Cmp<Dog>, a.Q {
  private int x = init(3);
  public Dog(String n) { super(n); run(); }
  public <T> List<T> speak(int a) throws E { this.go(); return new ArrayList<>(a).size(); }
}
interface I extends J { default int g() { return h(); } }
enum Color { RED; int v() { return 1; } }
record P(int x) implements I { int s() { return x(); } }
""")
    kinds = {n[0]: n[1] for n in nodes}
    assert kinds["java.util.List"] == kinds["com.foo.Bar.*"] == "import" and kinds["ArrayList"] == kinds["size"] == "call" and kinds["speak"] == kinds["v"] == kinds["s"] == "method"
    assert {("Dog", "inherits", "Animal"), ("Dog", "inherits", "Speak"), ("I", "inherits", "J"), ("P", "inherits", "I"), ("Dog", "calls", "init"), ("speak", "calls", "go"), ("g", "calls", "h")} <= edges
    assert not {"Cmp", "Q", "E"} & set(kinds)


BROKEN = """import os
def ok(a):
    '''Doc.'''
    return helper(a)

def bad(x:
    y = = 3
    return other(y)

class Dog(Animal):
    def speak(self):
        self.run()
        if True
            wag()
    def sit(self):
        return os.getcwd()

def empty():
print("x")
"""


def test_python_with_errors_keeps_what_can_be_read():
    nodes, edges, _ = shape("x.py", BROKEN)
    assert {("ok", "function", 2), ("Dog", "class", 10), ("speak", "method", 11), ("sit", "method", 15)} <= set(nodes)
    assert {("ok", "calls", "helper"), ("Dog", "inherits", "Animal"), ("speak", "calls", "run"), ("sit", "calls", "getcwd")} <= edges
    assert ("os", "import", 1) in nodes
    for text in ("(", "\0", "def f(", "\n\n'''", ")" * 50, "x = (\n" * 40, "\tif\n  else:\n" * 30):
        assert parse("x.py", text).nodes


@pytest.mark.parametrize("source", ["class A extends B<C { void m(){ n(); } }", f"class A extends B<{','.join(f'T{i}' for i in range(300))}> implements C {{ void m(){{ n(); }} }}"])
def test_angles_that_never_close_or_hold_much(source):
    for extension in (".java", ".ts", ".rs", ".go"):
        parse("x" + extension, source)
    nodes, edges, _ = shape("A.java", source)
    assert ("A", "class", 1) in nodes and ("m", "calls", "n") in edges
    assert ("A", "inherits", "C") in edges or "implements" not in source


@pytest.fixture
def time_limit():
    def stop(*_):
        raise TimeoutError("a parser doesn't end")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(120)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


@pytest.mark.parametrize("extension", sorted(set(BY_EXTENSION) - {".py"}))
def test_no_text_makes_a_parser_fail(extension, time_limit):
    r = random.Random(extension)
    pieces = ["class", "function", "fn", "func", "impl", "for", "{", "}", "(", ")", "<", ">", "=>", "`", "${", "'", '"', "/", "//", "/*", "*/", "\n", "x", "new", "import", "use", "::", ";", "=", "@", "#", "type", "struct", "record", "é", "\\", "async", "extends", "implements", "permits", "interface", "class A extends B<", "enum", "trait", "pub", "throws", ":", ",", ".", "0"]
    for _ in range(10_000):
        text = " ".join(r.choice(pieces) for _ in range(r.randint(0, 40)))
        parse("x" + extension, text)


def test_many_comparisons_are_read_in_time_that_grows_with_them(time_limit):
    for extension in (".java", ".ts", ".rs"):
        parse("x" + extension, "class A { int f() { return g(" + "a < b, " * 30_000 + "c); } }")
