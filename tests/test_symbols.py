import ast

import pytest

from triage.operators import chunks as ch
from triage.operators import symbols as sy
from triage.functions.vectors import embedder

SAMPLES = {
    "calc.py": '''import os
from typing import List

class Calculator:
    """A simple calculator."""

    def add(self, a, b):
        return a + b

def standalone_function():
    return 1
''',
    "hard.py": '''"""Module text
def not_a_function():
    pass
"""
class Outer(
    Base,
):
    x = """
def hidden(): pass
"""

    def first(self, a,
              b=")"):
        # comment

        def closure():
            \'\'\'Doc of
            closure.\'\'\'
            return {
    "k": [1,
2]}
        return closure

# between
    class Nested:
        async def go(self): pass

    @property
    def prop(self):
        if self.x:
            return "#"
        return '"' "'"


@decorator(
    1)
def tail():
    "one"
    try:
        import late
    except ImportError: late = None
    return late
VALUE = tail()
''',
    "tabs.py": "class T:\n\tdef a(self):\n\t\tif 1:\n\t\t\tpass\n\n\tdef b(self):\n\t\tpass\n",
    "empty.py": "",
}


def expected(source):
    """Symbols by Python's own parser."""
    out = []

    def walk(node, cls):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                out.append((child.name, child.name, "class", None, child.lineno, child.end_lineno))
                walk(child, child.name)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{cls}.{child.name}" if cls else child.name
                kind = "method" if cls else "function"
                out.append((child.name, name, kind, cls, child.lineno, child.end_lineno))
                walk(child, cls)
            else:
                walk(child, cls)

    walk(ast.parse(source), None)
    return sorted(out, key=lambda s: s[4])


def test_python_symbols_equal_the_parser(make_files):
    rows = sy.extract(make_files(SAMPLES)).orderBy("path", "pos").collect()
    for path, source in SAMPLES.items():
        got = [(r.name, r.qualified_name, r.kind, r.parent, r.start_line, r.end_line)
               for r in rows if r.path == path]
        assert got == expected(source), path


def test_docstrings(make_files):
    docs = {r.qualified_name: r.docstring for r in sy.extract(make_files(SAMPLES)).collect()}
    assert docs["Calculator"] == "A simple calculator."
    assert docs["Calculator.add"] is None
    assert docs["Outer.closure"] == "Doc of\n            closure."
    assert docs["tail"] == "one"


BRACES = {
    "w.ts": '''import x from "./x";
/* class Hidden {
*/
export class W {
  constructor(private name: string) {
    this.name = name; // }
  }
  async load(a: number): Promise<void> {
    if (a) {
      return await go("{");
    }
  }
  one() { return 1; }
}
function helper(x) {
  return { a: x };
}
''',
    "J.java": '''package a;
public class J {
    private int n = f(3);
    public int get() {
        return n;
    }
    static class Inner {
        void reset() { }
        List<String> all(int a, String b) throws X {
            foo(a);
            return bar(b);
        }
    }
    abstract void q();
}
''',
    "g.go": "package main\ntype G struct {\n\tn int\n}\nfunc (g *G) Get() int {\n\treturn g.n\n}\nfunc Make() int {\n\treturn 1\n}\n",
}


def test_brace_languages(make_files):
    rows = sy.extract(make_files(BRACES)).collect()
    got = {(r.path, r.qualified_name, r.kind, r.start_line, r.end_line) for r in rows}
    assert got == {
        ("w.ts", "W", "class", 4, 14), ("w.ts", "W.constructor", "method", 5, 7),
        ("w.ts", "W.load", "method", 8, 12), ("w.ts", "W.one", "method", 13, 13),
        ("w.ts", "helper", "function", 15, 17),
        ("J.java", "J", "class", 2, 15), ("J.java", "J.get", "method", 4, 6),
        ("J.java", "Inner", "class", 7, 13), ("J.java", "Inner.reset", "method", 8, 8),
        ("J.java", "Inner.all", "method", 9, 12), ("J.java", "J.q", "method", 14, 14),
        ("g.go", "G", "class", 2, 4), ("g.go", "Get", "function", 5, 7), ("g.go", "Make", "function", 8, 10),
    }


def test_chunks(make_files):
    f = make_files({"app.py": 'def greet():\n    """Say hello."""\n    return "hi"\n', "x.md": "no"})
    rows = ch.build_chunks(f, sy.extract(f)).collect()
    assert [r.chunk_id for r in rows] == ["app.py::greet@1"]
    assert rows[0].embedding_text == (
        'File: app.py\nSymbol: greet (function)\nDocstring: Say hello.\n'
        'Code:\ndef greet():\n    """Say hello."""\n    return "hi"')


def test_chunk_body_is_whole_unless_a_bound_is_given(make_files):
    body = "def f():\n" + "".join(f"    x = {i}\n" for i in range(400))
    f = make_files({"a.py": body})
    text = ch.build_chunks(f, sy.extract(f)).first().embedding_text
    assert text.split("Code:\n", 1)[1] == body.rstrip("\n")
    short = ch.build_chunks(f, sy.extract(f), max_body_chars=1500).first().embedding_text
    assert short.split("Code:\n", 1)[1] == body[:1500]


def test_chunk_ids_of_overloads_differ(make_files):
    f = make_files({"a.py": "def f():\n    return 1\n\ndef f():\n    return 2\n"})
    assert sorted(r.chunk_id for r in ch.build_chunks(f, sy.extract(f)).collect()) == ["a.py::f@1", "a.py::f@4"]


def test_all_symbols_and_embedder(spark):
    df = spark.createDataFrame([("a", [(1, "x"), (2, "y")])], "path string, symbols array<struct<start:int,name:string>>")
    assert [(r.path, r.name) for r in sy.all_symbols(df).collect()] == [("a", "x"), ("a", "y")]
    with pytest.raises(ValueError):
        embedder("nothing")
