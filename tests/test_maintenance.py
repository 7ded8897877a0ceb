"""Upkeep of an index, guards on taint and routes in code."""

from pyspark.sql import functions as F

from spangraph.functions import extract
from spangraph.operators import maintenance as mt
from spangraph.operators import pdg


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def test_groups_and_drift(spark):
    files = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", None), ("d", "h")], "file string, group string")
    changed = spark.createDataFrame([("a",), ("c",), ("new",)], "file string")
    assert rows(mt.resolution_groups(files, changed)) == [("a",), ("b",), ("c",), ("new",)]
    old = spark.createDataFrame([("k", ["x", "y"]), ("gone", ["z"]), ("e", ["1"])], "key string, values array<string>")
    new = spark.createDataFrame([("k", ["y", "x"]), ("n", []), ("e", ["2"])], "key string, values array<string>")
    assert rows(mt.config_drift(old, new)) == [("e", "changed"), ("gone", "removed"), ("n", "added")]
    n = spark.createDataFrame([("Class", "a"), ("File", "a"), ("Route", "z")], "label string, file_path string")
    assert rows(mt.touched_labels(n, changed)) == [("Class",), ("File",)]
    assert mt.keeps_derived(changed.limit(0)) and not mt.keeps_derived(changed)


def test_modes_and_status(spark):
    assert mt.embedding_mode(None, 0, 10) == "off" and mt.embedding_mode("on", 0, 10) == "full" and mt.embedding_mode(None, 5, 10) == "incremental"
    assert mt.embedding_mode("on", 5, 60_000) == "off" and mt.embedding_mode("on", 5, 60_000, cap=0) == "incremental" and mt.embedding_mode("off", 5, 1) == "off"
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "repo string, commit_id string")
    assert dict(rows(mt.staleness(spark.createDataFrame([("a", "1"), ("b", "1")], cur.schema), cur))) == {"a": "fresh", "b": "stale", "c": "never"}
    st = spark.createDataFrame([("a", "x", "ok"), ("b", "x", "ok"), ("b", "y", "timeout"), ("b", "z", "skipped")], "repo string, stage string, status string")
    assert rows(mt.completeness(st)) == [("a", True, []), ("b", False, ["suppressed-stage", "timeout"])]


def test_probe_links_and_texts(spark):
    n = spark.createDataFrame([("a", {"kind": "aspect"}), ("b", None)], "id string, props map<string,string>")
    e = spark.createDataFrame([("a", "b", "ADVISED_BY"), ("a", "b", "CALLS")], "src string, dst string, type string")
    assert rows(mt.probe(n, e, "ADVISED_BY", ["kind"])) == [("a", "b", "aspect", None)]
    s = spark.createDataFrame([("C:x", "m", "p.X")], "id string, module string, qualified_name string")
    c = spark.createDataFrame([("F:conf", "m", ["p.X", "p.Y"]), ("F:o", "other", ["p.X"])], "id string, module string, names array<string>")
    assert rows(mt.config_links(s, c), "src", "dst") == [("F:conf", "C:x")]
    t = spark.createDataFrame([("Class", "A", "x.py", " ", "class A:\n    pass")], "l string, n string, p string, d string, c string")
    assert t.select(mt.embedding_text(*map(F.col, "lnpdc")).alias("x")).first().x == "Class A\nin x.py\nclass A:\n    pass"
    assert t.select(mt.declaration_only(F.col("c")).alias("x")).first().x == "class A"


def test_guards_stop_taint_on_their_branch_only(spark):
    cfg = spark.createDataFrame([("f", 0, 1, "cond-true"), ("f", 0, 2, "cond-false"), ("f", 1, 3, "seq"), ("f", 2, 3, "seq")], "fn_id string, src_block int, dst_block int, kind string")
    blocks = spark.createDataFrame([("f", b, b + 1, b + 1) for b in range(4)], "fn_id string, block int, start_line long, end_line long")
    cond = spark.createDataFrame([("f", 0, "T", ["sql"])], "fn_id string, block int, label string, kinds array<string>")
    safe = pdg.guarded_lines(pdg.control_dependence(cfg), cond, blocks)
    assert rows(safe, "line", "kinds") == [(2, ["sql"])]
    flows = spark.createDataFrame([("f", "v", 1, 2), ("f", "v", 1, 3)], "fn_id string, variable string, def_line long, use_line long")
    src = spark.createDataFrame([("f", 1, ["sql"])], "fn_id string, line long, kinds array<string>")
    snk = spark.createDataFrame([("f", 2, "sql"), ("f", 3, "sql")], "fn_id string, line long, kind string")
    assert rows(pdg.taint_within(flows, src, snk, safe), "sink_line") == [(3,)]
    facts = spark.createDataFrame([("f", 1, "constant")], "fn_id string, line long, fact string")
    assert pdg.taint_within(pdg.refine_values(flows, facts), src, snk, safe).count() == 0


def test_routes_in_code(spark):
    files = [
        ("a.py", "router = APIRouter(prefix='/v1')\n@router.get('/x/{id}')\ndef f(): pass\n@router.post(\"/y\")"), ("urls.py", "urlpatterns = [path('items/<int:id>/', view)]"),
        ("C.java", "@RequestMapping(\"/api\")\nclass C { @GetMapping(\"/a\") void f() {} @PostMapping(value = \"b\") void g() {} }"), ("m.go", "v := r.Group(\"/g\")\nv.GET(\"/h\", h)"), ("s.ts", "app.get('/z', h); other.get('/no', h)"), ("n.txt", "app.get('/q')"), ("e.py", None),
    ]
    got = rows(extract.framework_routes(spark.createDataFrame(files, "path string, text string")), "path", "method", "url")
    assert got == [("C.java", "GET", "/api/a"), ("C.java", "POST", "/api/b"), ("a.py", "GET", "/v1/x/{id}"), ("a.py", "POST", "/v1/y"), ("m.go", "GET", "/g/h"), ("s.ts", "GET", "/z"), ("urls.py", "*", "/items/<int:id>")]
