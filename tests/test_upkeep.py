"""Queue, progress, sinks, service roots, names, budgets, communities and renames on small fixtures."""

import pytest
from pyspark.sql import functions as F

from spangraph import sources
from spangraph.operators import graph, resolution, routes, search, tools
from spangraph.streaming import ChangeQueue, Progress

EDGE = "src string, dst string, type string, reason string"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_queue_waits_but_not_for_ever_and_gives_up_counting():
    now = [0.0]
    q = ChangeQueue(debounce=1.0, most=3, clock=lambda: now[0])
    q.add("b")
    q.add("a", priority=5)
    assert q.take() is None
    for now[0] in (0.9, 1.8):
        q.add("b")
        assert q.take() is None
    now[0] = 2.1  # longer than the longest wait
    q.add("c")
    assert q.take() == ["a", "b", "c"] and q.take() is None
    q.add("d")
    now[0] = 9.0
    assert q.take() is None  # one batch is active
    q.done(failed=["a"])
    now[0] = 20.0
    assert q.take() == ["a", "d"]
    q.done()
    for p in "wxyz":
        q.add(p)
    now[0] = 30.0
    assert q.take() == ["*"]
    q.done(failed=["*"])
    now[0] = 40.0
    assert q.take() == ["*"]


def test_progress_of_a_stream(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        q = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        import time

        for _ in range(100):
            if any(e["event"] == "complete" for e in listener.events):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    kinds = [e["event"] for e in listener.events]
    assert kinds[0] == "started" and kinds[-1] == "complete" and sum(e.get("rows", 0) for e in listener.events) == 5


def test_dependence_is_written_apart(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "BasicBlock"), ("f", "Function")], "id string, label string")
    edges = spark.createDataFrame([("b", "c", "CDG"), ("b", "c", "CFG"), ("f", "g", "CALLS")], "src string, dst string, type string")
    n, e = sources.write_dependence(nodes, edges, f"{tmp_path}/pdg")
    assert rows(n, "id") == [("f",)] and rows(e, "type") == [("CALLS",)]
    assert rows(spark.read.parquet(f"{tmp_path}/pdg/edges"), "type") == [("CDG",), ("CFG",)] and spark.read.parquet(f"{tmp_path}/pdg/blocks").count() == 1


def test_services_and_thrift(spark):
    files = spark.createDataFrame([("a/pay/package.json", ""), ("a/pay/src/x.ts", ""), ("package.json", ""), ("b/go.mod", "")], "path string, text string")
    assert rows(sources.service_roots(files)) == [("a/pay", "pay"), ("b", "b")]
    text = "namespace java shop.v1\n// service Old { void gone() }\nservice Cart { /* x() */ i32 add(1: i32 n, 2: string s) throws (1: Bad e),\n void drop() }\nservice Empty {}"
    t = spark.createDataFrame([("x.thrift", text), ("y.thrift", "service A { void b() }"), ("z.txt", text), ("n.thrift", None)], "path string, text string")
    assert rows(sources.thrift_contracts(t)) == [("x.thrift", "thrift::shop.v1.Cart/add"), ("x.thrift", "thrift::shop.v1.Cart/drop"), ("y.thrift", "thrift::A/b")]


def test_type_references_are_strict(spark):
    refs = spark.createDataFrame([(1, "A", "in"), (2, "B", "in"), (3, "f", "in"), (4, "m.C", "in"), (5, "A.C", "in"), (6, "m.D", "in"), (7, "none", "in"), (8, "W", "in")], "ref int, name string, scope string")
    bindings = spark.createDataFrame([("A", "in", "A1", "Class", "local"), ("A", "out", "A2", "Class", "local"), ("B", "out", "B1", "Class", "local"), ("B", "out", "B2", "Class", "import"), ("f", "in", "f1", "Function", "local"), ("f", "out", "f2", "Class", "local"), ("W", "in", "W1", "Class", "wildcard")], "name string, scope string, id string, label string, origin string")
    scopes = spark.createDataFrame([("in", ["in", "out"])], "scope string, ancestors array<string>")
    defs = spark.createDataFrame([("C1", "m.C", "Class"), ("x", "m.C", "Function"), ("D1", "m.D", "Class"), ("D2", "m.D", "Enum"), ("AC", "A.C", "Class")], "id string, qualified_name string, label string")
    assert rows(resolution.type_references(refs, bindings, scopes, defs)) == [(1, "A1"), (4, "C1")]


def test_ownership_is_reconciled(spark):
    spans = spark.createDataFrame([("C", "f", 0, 100), ("D", "f", 10, 20), ("E", "g", 0, 9), ("m", "f", 12, 13), ("n", "f", 50, 51)], "id string, file string, start_line int, end_line int")
    edges = spark.createDataFrame([("C", "m", "HAS_METHOD"), ("D", "m", "HAS_METHOD"), ("E", "m", "HAS_METHOD"), ("E", "n", "HAS_PROPERTY"), ("C", "n", "HAS_PROPERTY"), ("C", "n", "CALLS")], "src string, dst string, type string")
    kept, dropped = resolution.reconcile_ownership(edges, spans)
    assert rows(kept, "src", "dst") == [("C", "n"), ("D", "m")] and rows(dropped, "src", "dst") == [("C", "m"), ("E", "m"), ("E", "n")]


def test_rename_preview(spark):
    defs = spark.createDataFrame([("f", "load", "a.py", 1, 4), ("g", "read", "a.py", 9, 4), ("h", "read", "z.py", 1, 1)], "id string, name string, file string, line int, col int")
    refs = spark.createDataFrame([("f", "b.py", 3, 7), ("f", "a.py", 5, 2), ("f", "a.py", 5, 2), ("g", "a.py", 6, 1)], "target string, file string, line int, col int")
    edits, clashes = resolution.rename_preview("f", "read", defs, refs)
    assert [tuple(r) for r in edits.collect()] == [("a.py", 1, 4, "load", "read"), ("a.py", 5, 2, "load", "read"), ("b.py", 3, 7, "load", "read")] and rows(clashes, "id") == [("g",)]


def test_projection_without_guesses_small_and_large(spark):
    e = [(f"filler{i}", h, "CALLS", "import-resolved") for i in (0, 1) for h in ("hubA", "hubB")]
    for reason, n in (("import-resolved", 5), ("name-guess", 4)):
        edges = spark.createDataFrame([*e, ("filler0", "filler1", "CALLS", reason), ("leaf", "hubA", "CALLS", "import-resolved")], EDGE)
        nodes = spark.createDataFrame([(x, "Function") for x in ("filler0", "filler1", "hubA", "hubB", "leaf", *map(str, range(20)))], "id string, label string")
        got, large = graph.community_projection(nodes, edges, large=10)
        assert large and got.count() == n
        got, large = graph.community_projection(nodes, edges)
        assert not large and got.count() == n + 1


def test_modularity_and_names(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")], "src string, dst string")
    m = spark.createDataFrame([(i, "one" if i in "abc" else "two") for i in "abcxyz"], "id string, community string")
    assert graph.modularity(e, m).first().modularity == pytest.approx(2 * (3 / 7 - (7 / 14) ** 2))
    assert graph.modularity(e.limit(0), m).first().modularity == 0.0
    nodes = spark.createDataFrame([("a", "src/cart/a.ts"), ("b", "src/cart/b.ts"), ("c", "src/x/c.ts"), ("x", None), ("y", "top.ts")], "id string, file_path string")
    assert rows(graph.community_labels(m, nodes)) == [("one", "cart"), ("two", "two")]
    assert [graph.process_budget(n) for n in (0, 199, 204, 205, 5000)] == [20, 20, 20, 21, 500]


def test_trace_leaves_tests_out(spark):
    nodes = spark.createDataFrame([("a", "src/a.ts"), ("t", "test/t.test.ts"), ("b", "src/b.ts"), ("c", "src/c.ts"), ("z", "src/z.ts")], "id string, file_path string")
    edges = spark.createDataFrame([("a", "t", "CALLS"), ("t", "z", "CALLS"), ("a", "b", "HAS_METHOD"), ("b", "c", "CALLS"), ("c", "z", "CALLS"), ("a", "z", "IMPORTS")], "src string, dst string, type string")
    assert tools.trace(nodes, edges, "a", "z").first().path == ["a", "b", "c", "z"]
    assert tools.trace(nodes, edges, "a", "z", with_tests=True).first().path == ["a", "t", "z"]
    r = tools.trace(nodes, edges, "a", "z", depth=2).first()
    assert not r.found and r.hops == 2


def test_answers_fit_their_budget(spark):
    df = spark.createDataFrame([(i, "x" * 10, None) for i in range(20)], "k int, t string, empty string")
    kept, cut = tools.fit_budget(df, ["k"], 30)
    n = kept.count()
    assert cut and 0 < n < 20 and [r.k for r in kept.orderBy("k").collect()] == list(range(n))
    assert tools.fit_budget(df, ["k"], 10_000)[1] is False
    assert tools.compact_lines(df.limit(1), "rows").first().line == "k=0 t=xxxxxxxxxx"
    assert rows(tools.schema_rows({"t": df}))[0] == ("t", 0, "k", "int")


def test_search_over_several_indexes(spark):
    nodes = spark.createDataFrame([("1", "parser", None, "x", "Function", "f"), ("2", "other", "a parser of rows", "y y y", "Function", "f"), ("3", "none", None, None, "Class", "g"), ("4", "Parser", "parser parser", "parser", "Class", "g")], "id string, name string, description string, content string, label string, file_path string")
    edges = spark.createDataFrame([("2", "1", "CALLS"), ("4", "1", "CALLS"), ("4", "1", "CALLS")], "src string, dst string, type string")
    hits = {r.id: r.best_field for r in search.bm25_indexes(nodes, "id", {"name": 1.0, "description": 1.0, "content": 1.0}, ["PARSER"]).collect()}
    assert set(hits) == {"1", "2", "4"} and hits["1"] == "name" and hits["2"] == "description"
    got = tools.query(nodes, edges, ["parser"], limit=2)
    assert sorted(r["rank"] for r in got.collect()) == [1, 2] and tools.query(nodes, edges, ["parser"]).filter("id = '1'").first().n_callers == 2
    fused = tools.query(nodes, edges, ["parser"], semantic=spark.createDataFrame([("3", 1)], "id string, rank int"))
    assert "3" in {r.id for r in fused.collect()} and tools.query(nodes, edges, ["absent"]).count() == 0


def test_mounts_nest_and_end(spark):
    r = spark.createDataFrame([("a", "users", "/:id"), ("b", "free", "x"), ("c", "users", None)], "id string, router string, path string")
    m = spark.createDataFrame([("users", "api", "/users/"), ("api", "root", "v1"), ("users", "admin", "/adm")], "child string, parent string, prefix string")
    assert rows(routes.mounted(r.filter("path is not null"), m)) == [("a", "/adm/:id"), ("a", "/v1/users/:id"), ("b", "/x")]
    loop = spark.createDataFrame([("users", "users", "/u")], "child string, parent string, prefix string")
    assert routes.mounted(r, loop, max_depth=3).filter("id = 'a'").count() == 0


def test_fetches_meet_routes_by_their_first_literal_segment(spark):
    urls = ["/a/1", "/[param]/x", "/[param]/[param]", "/a/b/c/d", "/[param]/b/c", "/", "/z", "/[param]/y/x"]
    paths = ["/a/[id]", "/[t]/x", "/a/[...rest]", "/[t]/b/[[...rest]]", "/[...all]", "/", "/[[...opt]]", "/q/y/[z]", "/a/x"]
    f = spark.createDataFrame([(u,) for u in urls], "url string")
    r = spark.createDataFrame([(p,) for p in paths], "route string")
    every = f.crossJoin(r).filter(routes.url_matches(F.col("url"), F.col("route")))  # a small fixture only
    got = rows(routes.match_fetches(f, r), "url", "route")
    assert got == rows(every, "url", "route") and len(got) > 20


def test_augmentation_falls_back_to_text_and_orders_by_cohesion(spark):
    nodes = spark.createDataFrame([("1", "load_rows", "reads a table", "f"), ("2", "x", "table of rows", "f"), ("3", "reader", None, "g")], "id string, name string, description string, file_path string")
    edges = spark.createDataFrame([("2", "1", "CALLS"), ("3", "1", "CALLS")], "src string, dst string, type string")
    steps = spark.createDataFrame([("1", "p"), ("1", "q"), ("2", "p")], "id string, process string")
    cohesion = spark.createDataFrame([("1", 0.2), ("2", 0.9)], "id string, cohesion double")
    got = {r.id: (r.n_callers, r.processes, r.place) for r in search.augment(nodes, edges, "table", steps=steps, cohesion=cohesion).collect()}
    assert got == {"1": (2, ["p", "q"], 2), "2": (0, ["p"], 1)}
    assert {r.id for r in search.augment(nodes, edges, "x").collect()} == {"2"} and {r.id for r in search.augment(nodes, edges, "eade").collect()} == {"3"} and search.augment(nodes, edges, "...").count() == 0


def test_scratch_is_emptied(spark):
    from pathlib import Path

    from spangraph import runtime

    with runtime.scratch():
        df = runtime.materialise(spark.range(3), "x")
        path = Path(runtime._written[-1][1].removeprefix("file://"))
        assert df.count() == 3 and path.exists()
    assert not path.exists()
