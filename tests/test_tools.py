"""Composite questions and facts from source text."""

import pytest
from pyspark.sql import functions as F

from spangraph.functions import extract
from spangraph.operators import diff, resolution, search, structure, tools


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


EDGE = "src string, dst string, type string"


def test_context_and_chain(spark):
    n = spark.createDataFrame([("a", "A"), ("b", "B"), ("File:f", "f")], "id string, name string")
    e = spark.createDataFrame([("a", "b", "CALLS"), ("a", "b", "CALLS"), ("a", "File:f", "CALLS"), ("b", "a", "IMPORTS"), ("a", "b", "CONTAINS")], EDGE)
    ids = spark.createDataFrame([("a",)], "id string")
    got = tools.context(n, e, ids, types=["CALLS", "IMPORTS"])
    assert rows(got, "direction", "type", "n", "neighbours") == [("incoming", "IMPORTS", 1, ["b"]), ("outgoing", "CALLS", 2, ["b", "File:f"])]
    with pytest.raises(ValueError):
        tools.context(n, e, ids, types=["MEMBER_OF"])
    assert rows(tools.chain(e, spark.createDataFrame([("b",)], "id string"), 2), "id", "depth") == [("a", 1)]
    with pytest.raises(ValueError):
        tools.chain(e, ids, 4)


def test_detect_changes(spark):
    sym = spark.createDataFrame([("f", "x.py", 0, 5), ("g", "x.py", 7, 9)], "id string, file string, start_line long, end_line long")
    h = spark.createDataFrame([("h1", "x.py", 5, 6), ("h2", "y.py", 1, 1)], "hunk_id string, file string, start_line long, end_line long")
    steps = spark.createDataFrame([("f", f"p{k}") for k in range(5)], "id string, process string")
    e = spark.createDataFrame([("g", "f", "CALLS")], EDGE)
    changed, unmapped = tools.detect_changes(h, sym, steps, e)
    assert rows(changed, "id", "processes", "callers", "risk") == [("f", 5, 1, "CRITICAL")] and rows(unmapped) == [("h2",)]


def test_circles(spark):
    e = spark.createDataFrame([("a", "b", "IMPORTS"), ("b", "c", "IMPORTS"), ("c", "a", "IMPORTS"), ("c", "d", "IMPORTS"), ("s", "s", "IMPORTS"), ("d", "c", "CALLS")], EDGE)
    assert rows(tools.circular(e)) == [("c", ["a", "b", "c"]), ("s", ["s"])]


def test_statement_reach(spark):
    dep = spark.createDataFrame([("f", 0, 1)], "fn_id string, src_block int, dst_block int")
    blocks = spark.createDataFrame([("f", 0, 1, 2, "one"), ("f", 1, 3, 4, "two three"), ("f", 2, 5, 6, "four")], "fn_id string, block int, start_line long, end_line long, callees string")
    calls = spark.createDataFrame([("f", f"id:{n}", n) for n in ("one", "two", "four")], "fn_id string, callee string, name string")
    start = spark.createDataFrame([("f", 1)], "fn_id string, line long")
    assert rows(tools.statement_reach(dep, blocks, start, calls), "callee") == [("id:one",), ("id:two",)]


def test_routes_groups_and_importers(spark):
    n = spark.createDataFrame([("Route:r", "Route"), ("Route:q", "Route")], "id string, label string")
    e = spark.createDataFrame([("h", "Route:r", "HANDLES_ROUTE"), ("c", "Route:r", "FETCHES")], EDGE)
    assert rows(tools.route_map(n, e)) == [("Route:q", [], []), ("Route:r", ["h"], ["c"])]
    calls = spark.createDataFrame([("p2", "p1", "CALLS"), ("c2", "c1", "CALLS")], EDGE)
    links = spark.createDataFrame([("c1", "p2"), ("", "p1")], "from_symbol string, to_symbol string")
    got = tools.group_impact(calls, links, spark.createDataFrame([("p1",)], "id string"))
    assert rows(got, "id", "depth", "crossed") == [("c1", 0, True), ("c2", 1, True), ("p2", 1, False)]
    imp = spark.createDataFrame([("b", "a", "IMPORTS"), ("c", "b", "IMPORTS"), ("d", "b", "IMPORTS")], EDGE)
    assert rows(tools.importers(imp, spark.createDataFrame([("a",)], "id string"), hub=1), "id", "depth", "hub") == [("a", 0, False), ("b", 1, True), ("c", 2, False), ("d", 2, False)]


def test_augment_prefers_the_exact_name(spark):
    n = spark.createDataFrame([("a", "run", "x"), ("b", "runner", "x"), ("c", "other", "x"), ("File:f", "f", "f")], "id string, name string, file_path string")
    e = spark.createDataFrame([("c", "a", "CALLS"), ("File:f", "a", "CALLS"), ("a", "b", "CALLS")], EDGE)
    r = search.augment(n, e, "run").collect()
    assert [(x.id, x.callers, x.n_callers, x.callees) for x in r] == [("a", ["c", "File:f"], 2, ["b"])]
    assert [x.id for x in search.augment(n, e, "runn").collect()] == ["b"]


def test_reuse_and_shadows(spark):
    n = spark.createDataFrame([("a", "h1"), ("b", "h2")], "id string, content_hash string")
    emb = spark.createDataFrame([("a", "h1"), ("b", "old")], "node_id string, content_hash string")
    kept, missing = diff.reusable(n, emb)
    assert rows(kept, "node_id") == [("a",)] and rows(missing, "id") == [("b",)]
    got = rows(diff.shadow_candidates(spark.createDataFrame([("src/a.ts",)], "file string")), "shadow")
    assert ("src/a.js",) in got and ("src/a/index.ts",) in got and ("src/a.ts",) not in got


def test_function_flow_graphs_and_entry_points(spark):
    f = spark.createDataFrame([("a", "x", 4), ("b", "x", 9), ("c", "x", 9)], "id string, file string, start_line long")
    c = spark.createDataFrame([("f1", "x", 5), ("f2", "x", 10)], "fn_id string, file string, start_line long")
    assert rows(resolution.function_cfgs(f, c)) == [("a", "f1")]
    p = spark.createDataFrame([("p", "e", "x"), ("q", "z", "y")], "process string, entry string, file string")
    h = spark.createDataFrame([("r1", "e", "w"), ("r2", None, "y"), ("r3", "other", "x")], "target string, handler string, file string")
    assert rows(structure.entry_point_links(p, h), "process", "target") == [("p", "r1"), ("q", "r2")]
    n = spark.createDataFrame([("v", "Variable", {"scope": "block"}), ("w", "Variable", {"scope": "block"}), ("m", "Const", None)], "id string, label string, props map<string,string>")
    e = spark.createDataFrame([("File:f", "v", "DEFINES"), ("File:f", "w", "DEFINES"), ("g", "w", "ACCESSES")], EDGE)
    assert rows(structure.prune_locals(n, e), "id") == [("m",), ("w",)]


def test_python_functions(spark):
    code = "class A:\n    def f(self, x):\n        # note\n        if x and x > 1 or x:\n            return [y for y in x if y]\n        for z in x:\n            try:\n                pass\n            except E:\n                pass\n\n        def g():\n            return 1 if 2 else 3\n\nasync def h(): pass\n"
    df = spark.createDataFrame([("a.py", code), ("b.py", "def ("), ("c.py", None), ("d.py", "")], "path string, text string")
    got = rows(extract.python_functions(df), "name", "start_line", "complexity", "sloc")
    assert got == [("A.f", 1, 8, 10), ("A.f.g", 11, 2, 2), ("h", 14, 1, 1)]


def test_response_shapes(spark):
    js = "return res.json({ id, 'full-name': a(b, {x: 1}), total: 3 });\nreturn res.status(404).json({ error: 'no' });\nreturn NextResponse.json({ error: m, code: 1 }, { status: 500 })"
    df = spark.createDataFrame([("a", js), ("b", "none"), ("c", None)], "path string, text string")
    assert rows(extract.response_keys(df)) == [("a", ["id", "full-name", "total"], ["error", "code"])]


def test_middleware_and_constants(spark):
    df = spark.createDataFrame([("m1", "export default chain([a, b ])"), ("m2", "export default withA(withB(handler))"), ("m3", "export default function x() {}")], "path string, text string")
    assert dict(rows(df.select("path", extract.middleware_chain(F.col("text")).alias("c")))) == {"m1": ["a", "b"], "m2": ["withA", "withB"], "m3": []}
    src = spark.createDataFrame([("p", "export const BASE = '/api'\nconst BASE = '/other'\nV: str = \"v1\"\n")], "path string, text string")
    known = extract.constants(src)
    assert dict(rows(known, "name", "value")) == {"BASE": "/api", "V": "v1"}
    ex = spark.createDataFrame([(1, "p", ["BASE", "'/'", "V"]), (2, "p", ["BASE", "gone"])], "expr_id int, path string, operands array<string>")
    assert rows(extract.fold_operands(ex, known)) == [(1, "/api/v1")]
