import ast
import random
import re

import pytest
from pyspark.sql import functions as F

from sedimenta import queries
from sedimenta.operators import units as u
from sedimenta.queries import QUERIES
from sedimenta.schemas import SOURCE_FILES

SOURCE = '''
"""Module."""
import os, numpy as np
from . import sibling
from pkg.mod import thing as other

def free(a, /, b, *args, c=1, **kw):
    # a comment
    def nested(x):
        return inner(x)
    return p(q(1)) + self.x.y() + h()() + d[0]()

async def skipped():
    pass

if True:
    def conditional():
        pass

import sys

class K:
    class Inner:
        def deep(self):
            pass
    @property
    def name(self):
        return 'é' + np.mean(f"{g('a')}")
    @name.setter
    def name(self, value):
        store(value); store(value)
'''


def test_units_of_one_file():
    unit = u.parse_units(SOURCE)
    assert unit["parse_ok"]
    assert [(m["class"], m["name"], m["params"], m["repeated"]) for m in unit["methods"]] == [
        (None, "free", ["b"], False), ("K", "name", ["self"], False), ("K", "name", ["self", "value"], False),
    ]
    calls = [[(c["context"], c["name"], c["expression"]) for c in m["calls"]] for m in unit["methods"]]
    assert calls[0] == [
        (None, "inner", "inner(x)"), (None, "p", "p(q(1))"), (None, "q", "q(1)"), (None, "h", "h()"),
    ]
    assert calls[2] == [(None, "store", "store(value)")] * 2
    assert [(i["kind"], i["module"], i["level"], i["name"], i["alias"]) for i in unit["imports"]] == [
        ("import", None, 0, "os", None), ("import", None, 0, "numpy", "np"), ("import", None, 0, "sys", None),
        ("from", None, 1, "sibling", None), ("from", "pkg.mod", 0, "thing", "other"),
    ]


def test_offsets_count_characters_or_bytes():
    text = "def f():\n    return 'é' + np.mean(1)"
    by_character, by_byte = (u.find_calls(text, b)[0] for b in (False, True))
    start = text.index("np.mean")
    assert (by_character["start_offset"], by_character["end_offset"], by_character["lineno"]) == (start, len(text), 1)
    assert by_byte["start_offset"] == start + 1 and by_byte["expression"] == "np.mean(1)"


def test_call_texts_are_rendered_alone():
    text = ast.unparse(ast.parse('''def f(x):
    """Doc with 'quotes'."""
    return f"{g('a', h("b"))}" + k("""two
lines""", *x, **y) + (lambda: m((yield)))(n(i for i in x))'''))
    rendered = {ast.unparse(n) for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    assert {c["expression"] for c in u.find_calls(text)} == rendered


def test_faults_keep_the_file():
    assert u.parse_units("def (:")["parse_error"] == "SyntaxError"
    assert not u.parse_units("a\x00b")["parse_ok"]
    deep = "x = " + "(" * 150 + "1" + ")" * 150
    assert u.parse_units(deep)["methods"] == [] and u.parse_units("")["parse_ok"] and u.parse_units(None)["parse_ok"]


def test_each_content_is_parsed_once_and_every_file_kept(spark):
    rows = [("r", f"v{i}", "a.py", SOURCE) for i in range(3)] + [
        ("r", "v0", "bad.py", "def (:"), ("r", "v0", "none.py", None), ("r", "v0", "empty.py", ""),
    ]
    files = spark.createDataFrame(rows, SOURCE_FILES)
    units = u.extract_units(files).persist()
    assert units.count() == 3
    status = u.parse_status(u.file_versions(files), units).collect()
    found = {(r.branch, r.path): (r.parse_ok, r.parse_error, r.n_methods, r.n_imports) for r in status}
    assert len(status) == 6
    assert found["v2", "a.py"] == (True, None, 3, 5)
    assert found["v0", "bad.py"] == (False, "SyntaxError", 0, 0)
    assert found["v0", "none.py"] == (False, "Unreadable", 0, 0)
    assert found["v0", "empty.py"] == (True, None, 0, 0)
    statements = [r.statement for r in u.extract_imports(units).orderBy("import_ord").collect()]
    assert statements == [
        "import os", "import numpy as np", "import sys", "from None import sibling", "from pkg.mod import thing as other",
    ]
    methods = u.extract_functions(units)
    assert u.free_functions(methods).count() == 1 and u.class_methods(methods).count() == 2
    calls = u.extract_calls(methods)
    assert calls.count() == 8
    assert calls.where(F.col("context") == "np").select("name", "expression").collect()[0].name == "mean"


@pytest.mark.parametrize(
    "query",
    ["call_offsets", "extract_calls", "extract_functions", "extract_methods", "method_params", "extract_imports",
     "render_imports", "parse_status", "import_kinds", "call_offsets_behind_text", "change_records_empty_release"],
)
def test_parsed_units_do_not_pass_through_the_driver(spark, query):
    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for join in re.findall(r"(?m)^.*\bBroadcastHashJoin\b.*$", plan):
        assert not re.search(r"content_sha|unit_sha|old_sha|new_sha", join), join


def test_mapped_files_do_not_pass_through_the_driver(spark):
    sides = queries._mapped_sides(spark, "/root/testdata/sf0.001", renames=True)
    assert "Broadcast" not in sides._jdf.queryExecution().executedPlan().toString()


def test_fields_of_methods_to_hand_over(spark):
    """what is not read is not handed over, and faults end a file as before."""
    files = spark.createDataFrame([("r", "v1", "a.py", SOURCE), ("r", "v1", "b.py", "def (:")], SOURCE_FILES)
    whole = {r.content_sha: r for r in u.extract_units(files).collect()}
    for r in u.extract_units(files, methods=("class", "content")).collect():
        old = whole[r.content_sha]
        assert (r.parse_ok, r.parse_error, r.imports) == (old.parse_ok, old.parse_error, old.imports)
        assert [m.asDict() for m in r.methods] == [{"class": m["class"], "content": m.content} for m in old.methods]


def test_equal_functions_are_rendered_once(monkeypatch):
    """versions share functions; decorators, depth and comments are part of what is equal."""
    texts = ["@a\ndef f(x):\n  return  x # y\n", "@b\ndef f(x):\n  return  x # y\n", "class A:\n  @a\n  def f(x):\n    return  x\n  def f(x): return '''\n  '''\n"]
    texts += ["import os\n\n\n" + t for t in texts] + [t.replace("\n", "\r\n") for t in texts]
    want = [[m["content"] for m in u.parse_units(t)["methods"]] for t in texts]
    calls, plain, known = [], ast.unparse, {}
    monkeypatch.setattr(ast, "unparse", lambda node: calls.append(node) or plain(node))
    assert [[m["content"] for m in u.parse_units(t, lambda text: [], known)["methods"]] for t in texts] == want
    assert want == [[plain(n) for _, n in u._functions(ast.parse(t))] for t in texts]
    assert len(calls) == len(known) + 4 == 8


def test_texts_are_put_together_from_blocks():
    lines = [
        "class A:\n", "    def f(self): return h(1)\n", "    def g(self):\n        return 2\n", "x = 1\n", "if y:\n", "    z = 1\n", "else:\n",
        "@d\n", "    @d\n", "def f(a): return g(a)\n", '"""\n', "class B: x = {1:\n", "    2}\n", "import os\n", "from a import b as c\n", "  # c\n",
        "\tdef t(): pass\n", '    "doc"\n', "\\\n", "try:\n", "except E: pass\n", "async def u(): pass\n", "(\n", "    class C:\n",
        "        def n(self): pass\n", "    else: pass\n", "    import k\n", "\r\n",
    ]
    rng, known = random.Random(3), {}
    blocks, fine = u.Blocks(known), 0
    for _ in range(20_000):
        text = "".join(rng.choices(lines, k=rng.randint(1, 8)))
        want = u.parse_units(text)
        assert u.parse_units(text, blocks=blocks, known=known) == want, text
        fine += want["parse_ok"]
    assert fine > 500


def test_a_new_version_of_a_file_parses_what_changed(monkeypatch):
    method = "    def m{}(self):\n        return g({})\n\n"
    text = "import os\n\n\nclass A(B):\n" + "".join(method.format(i, i) for i in range(50)) + "\ndef free(x):\n    return x\n"
    blocks, known = u.Blocks({}), {}
    first = u.parse_units(text, known=known, blocks=blocks)
    parsed, real = [], ast.parse
    monkeypatch.setattr(u.ast, "parse", lambda source: parsed.append(source) or real(source))
    calls_of = lambda rendered: []
    u.parse_units(text.replace("g(7)", "g(8)"), calls_of, known, blocks)
    assert len(parsed) == 1 and "g(8)" in parsed[0] and len(parsed[0]) < 100 and len(first["methods"]) == 51
