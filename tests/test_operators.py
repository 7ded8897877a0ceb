"""Operators on small literal inputs, many of them the cases that the reference pins, and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from spangraph.functions import codecs, text
from spangraph.functions.vectors import cosine_distance
from spangraph.operators import contracts, diff, graph, hierarchy, impact, mining, pdg, quality, resolution, routes, score, search, structure, windows


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first().x


EDGE = "src string, dst string, type string"


# ---- graph


def test_bfs_depths_caps_and_cycles(spark):
    e = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("a", "d", "CALLS"), (None, "a", "CALLS")], EDGE)
    a = spark.createDataFrame([("a",)], "id string")
    got, partial = graph.bfs(e, a, max_depth=9)
    assert rows(got) == [("a", 0), ("b", 1), ("c", 2), ("d", 1)] and not partial
    assert rows(graph.bfs(e, a, up=True, max_depth=1)[0]) == [("a", 0), ("c", 1)]
    got, partial = graph.bfs(e, a, max_depth=1, row_cap=1)
    assert rows(got) == [("a", 0), ("b", 1)] and partial
    assert graph.bfs(e.limit(0), a)[0].count() == 1


def test_components_against_brute_force(spark):
    rnd = random.Random(2)
    pairs = [(f"n{rnd.randrange(12):02}", f"n{rnd.randrange(12):02}") for _ in range(22)]
    reach = {n: {n} for p in pairs for n in p}
    for _ in range(12):
        for a, b in pairs:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = sorted((n, max(m for m in reach[n] if n in reach[m])) for n in reach)
    got = graph.components(spark.createDataFrame([(a, b, "X") for a, b in pairs], EDGE))
    assert rows(got, "id", "component") == want
    closed = rows(graph.closure(spark.createDataFrame([(a, b, "X") for a, b in pairs], EDGE)))
    assert {(a, b) for a, b in closed if a != b} == {(a, b) for a in reach for b in reach[a] if a != b}


def _line(spark, n, *, cycle=False):
    """``src, dst, type`` of n nodes in a row."""
    return spark.createDataFrame([(f"n{i:03}", f"n{(i + 1) % n:03}", "X") for i in range(n if cycle else n - 1)], EDGE)


def test_closure_of_a_long_line(spark):
    n = 70
    assert rows(graph.closure(_line(spark, n)), "src", "dst") == [(f"n{a:03}", f"n{b:03}") for a in range(n) for b in range(a + 1, n)]


def test_components_of_a_long_cycle(spark):
    n = 106
    assert rows(graph.components(_line(spark, n, cycle=True)), "id", "component") == [(f"n{i:03}", f"n{n - 1:03}") for i in range(n)]


def test_bfs_without_a_depth(spark):
    got, partial = graph.bfs(_line(spark, 12), spark.createDataFrame([("n000",)], "id string"), max_depth=None)
    assert rows(got) == [(f"n{i:03}", i) for i in range(12)] and not partial


def test_shortest_path_and_none(spark):
    e = spark.createDataFrame([("a", "c", "X"), ("a", "b", "X"), ("b", "z", "X"), ("c", "z", "X")], EDGE)
    r = graph.shortest_path(e, "a", "z").first()
    assert (r.found, r.hops, r.path) == (True, 2, ["a", "b", "z"])
    r = graph.shortest_path(e, "a", "nowhere").first()
    assert (r.found, r.hops) == (False, 2)


def test_walks_and_edge_unique_paths(spark):
    e = spark.createDataFrame([("a", "b", "X"), ("b", "a", "X")], EDGE)
    a = spark.createDataFrame([("a",)], "id string")
    assert graph.paths(e, a, 1, 3).count() == 3 and graph.paths(e, a, 1, 3, edge_unique=True).count() == 2


@pytest.mark.parametrize("pairs, members, want", [
    ([("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("a", "x"), ("b", "y")], "abcd", 12 / 14),
    ([("a", "b"), ("b", "c"), ("c", "a"), ("a", "x")], "abc", 6 / 7), ([("a", "b")], "ab", 1.0), ([], "a", 1.0),
])
def test_cohesion(spark, pairs, members, want):
    e = spark.createDataFrame(pairs, "src string, dst string")
    m = spark.createDataFrame([(c, 1) for c in members], "id string, community int")
    assert graph.cohesion(e, m).first().cohesion == pytest.approx(want)


def test_flows_leave_out_guessed_edges(spark):
    schema = EDGE + ", reason string, confidence double"
    base = [("h", "v", "CALLS", "resolved", 0.9), ("v", "p", "CALLS", "resolved", 0.9)]
    entry = spark.createDataFrame([("h", 1.0)], "id string, score double")
    assert [r.steps for r in graph.flows(spark.createDataFrame(base, schema), entry).collect()] == [["h", "v", "p"]]
    guess = [base[0], ("v", "p", "CALLS", "name-guess", 0.5)]
    assert graph.flows(spark.createDataFrame(guess, schema), entry).count() == 0


def test_label_propagation_finds_two_cliques(spark):
    e = [(a, b) for g in ("abc", "xyz") for a in g for b in g if a < b] + [("c", "x")]
    got = dict(rows(graph.communities(spark.createDataFrame([(a, b, "X") for a, b in e], EDGE))))
    assert len({got[c] for c in "abc"}) == 1 and len({got[c] for c in "yz"}) == 1


def test_cascade_delete(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("c", "c", "X")], EDGE)
    nn, ee = graph.cascade_delete(n, e, spark.createDataFrame([("a",)], "id string"))
    assert rows(nn) == [("b",), ("c",)] and rows(ee) == [("b", "c", "X"), ("c", "c", "X")]


# ---- windows, mining, scores


def test_greedy_partners_are_the_either_end_window(spark):
    rnd = random.Random(7)
    pairs = sorted({tuple(sorted(rnd.sample("abcdefghij", 2))) for _ in range(40)})
    data = [(a, b, rnd.randrange(3, 7), rnd.choice([0.5, 0.75])) for a, b in pairs]
    used, want = {}, []
    for a, b, n, s in sorted(data, key=lambda r: (-r[2], -r[3], r[0], r[1])):
        if used.get(a, 0) < 2 or used.get(b, 0) < 2:
            want.append((a, b, n, s))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    got = mining.keep_top_partners(spark.createDataFrame(data, "file_a string, file_b string, change_count int, strength double"), 2)
    assert rows(got) == sorted(want)


def test_co_change_history(spark):
    commits = [("c0", f) for f in ("api", "client", "util", "other")] + [(f"c{k}", f) for k in range(1, 5) for f in ("api", "client")] + [("c5", "util"), ("c6", "api")]
    commits += [("big", f"f{k}") for k in range(51)] + [(None, "api"), ("c7", None), ("c0", "api")]
    df = spark.createDataFrame(commits, "commit_id string, file string")
    assert rows(mining.co_change_pairs(df)) == [("api", "client", 5, 1.0)]
    missing = mining.missing_partners(mining.co_change_pairs(df), spark.createDataFrame([("api",)], "file string"))
    assert [(r.partner, r.with_files) for r in missing.collect()] == [("client", ["api"])]


def test_risk_ladder(spark):
    cases = [("upstream", 0, 0, 0, 0, "UNKNOWN"), ("downstream", 0, 0, 0, 0, "LOW"), ("upstream", 30, 0, 0, 30, "CRITICAL"), ("upstream", 1, 5, 0, 1, "CRITICAL"), ("upstream", 15, 0, 0, 15, "HIGH"), ("upstream", 5, 0, 0, 5, "MEDIUM"), ("upstream", 1, 0, 0, 1, "LOW")]
    df = spark.createDataFrame(cases, "d string, a int, p int, m int, i int, want string")
    for incomplete in (False, True):
        for r in df.select("want", impact.risk(F.col("d"), F.col("a"), F.col("p"), F.col("m"), F.col("i"), F.lit(incomplete)).alias("got")).collect():
            assert r.got == ("UNKNOWN" if incomplete and r.want in ("LOW", "MEDIUM") else r.want)


def test_entry_points(spark):
    df = spark.createDataFrame([("handleLogin", True, 1, 4, 6.0), ("getUser", False, 0, 4, 1.2), ("plain", False, 3, 4, 1.0), ("main", False, 0, 0, 0.0)], "n string, e boolean, a int, b int, want double")
    for r in df.select("want", score.entry_point(F.col("n"), F.col("e"), F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == pytest.approx(r.want)


def test_quality_presets(spark):
    n = spark.createDataFrame([("god", "god", 13, 60, False, "src/a.ts", 1, None), ("idle", "idle", 1, 5, False, "src/a.ts", 2, None), ("t", "t", 1, 5, False, "tests/a.ts", 3, None), ("main", "main", 1, 5, False, "src/b.ts", 4, None)], "id string, name string, complexity int, sloc int, is_exported boolean, file_path string, start_line int, entry_point_id string")
    e = spark.createDataFrame([("god", f"x{k}", "CALLS") for k in range(8)] + [("x1", "god", "CALLS")], EDGE)
    assert rows(quality.god_functions(n, e), "id", "fan_out") == [("god", 8)]
    assert rows(quality.dead_code(n, e, ["CALLS"], ["HANDLES_ROUTE"]), "id") == [("idle",)]
    inject = spark.createDataFrame([("c", "p1", "INJECTS"), ("c", "p2", "INJECTS"), ("c", "p3", "INJECTS"), ("c", "m", "HAS_METHOD"), ("m", "p1", "CALLS"), ("p2", "pm", "HAS_METHOD"), ("pm", "im", "METHOD_IMPLEMENTS"), ("m", "im", "CALLS")], EDGE)
    assert rows(quality.unused_injections(inject)) == [("c", "p3")]


# ---- search and text


def test_rrf(spark):
    kw = spark.createDataFrame([("a", 1), ("b", 2)], "key string, rank int")
    sem = spark.createDataFrame([("b", 1), ("c", 2), ("b", 3)], "key string, rank int")
    got = {r.key: r for r in search.rrf(kw, sem, "key").collect()}
    assert got["b"].score == pytest.approx(1 / 62 + 1 / 61 + 1 / 63) and got["b"].rank == 1 and got["a"].score == pytest.approx(1 / 61)
    merged, failed = search.hybrid(lambda: kw, lambda: 1 / 0, "key")
    assert [r.key for r in merged.orderBy("rank").collect()] == ["a", "b"] and list(failed) == ["semantic"]
    assert search.rrf(kw.limit(0), sem.limit(0), "key").count() == 0


def test_bm25_prefers_the_rarer_and_shorter(spark):
    docs = spark.createDataFrame([(1, "cache"), (2, "cache other words here"), (3, "parser cache"), (4, None), (5, "")], "id int, t string")
    got = {r.id: r.score for r in search.bm25(docs, "id", "t", ["Cache", "parser"]).collect()}
    assert set(got) == {1, 2, 3} and got[3] > got[1] > got[2]


def test_cosine_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 5.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r.x for r in df.select(cosine_distance(F.col("a"), F.col("b")).alias("x")).collect()] == pytest.approx([0.0, 1.0, 1.0])


def test_best_chunks_and_sums(spark):
    df = spark.createDataFrame([("n", 0, 0.3), ("n", 1, 0.1), ("m", 0, 0.2)], "node string, chunk_index int, distance double")
    assert rows(windows.best_per_key(df, "node", "distance", ["chunk_index"], 1), "node", "chunk_index") == [("n", 1)]
    hits = spark.createDataFrame([("f", "a", 4.0), ("f", "b", 3.0), ("f", "c", 2.0), ("f", "d", 1.0)], "file string, id string, score double")
    assert [(r.score, r.ids) for r in windows.summed_best(hits, "file", "score", "id").collect()] == [(9.0, ["a", "b", "c"])]


def test_text_functions(spark):
    df = spark.createDataFrame([("ERP审批流程",), ("审 批",), ("x 审批 y",), (None,)], "t string")
    assert [r.x for r in df.select(text.cjk_bigrams(F.col("t")).alias("x")).collect()] == ["ERP 审批 批流 流程", "审 批", "x 审批 y", None]
    assert one(spark, text.longest_identifier(F.col("t")), t="if (fooBar.baz == quxQuz)") == "fooBar"
    assert one(spark, text.longest_identifier(F.col("t")), t="a b") is None
    for budget in range(0, 12):
        want = "aé😀b€"
        while len(want.encode()) > budget:
            want = want[:-1]
        assert one(spark, text.utf8_cut(F.col("t"), budget), t="aé😀b€") == want
    docs = spark.createDataFrame([(1, "x" * 2500), (2, "short"), (3, None), (4, ""), (5, "y" * 1201)], "id int, t string")
    got = rows(text.char_chunks(docs, "id", "t"), "id", "chunk_index", "start_offset", "end_offset")
    assert got == [(1, 0, 0, 1200), (1, 1, 1080, 2280), (1, 2, 2160, 2500), (2, 0, 0, 5), (4, 0, 0, 0), (5, 0, 0, 1200), (5, 1, 1080, 1201)]
    g = text.grep(spark.createDataFrame([(1, "a(b\nA(B\r\nzz")], "id int, t string"), "id", "t", "a(b", literal=True, ignore_case=True)
    assert rows(g) == [(1, 1, "a(b"), (1, 2, "A(B")]


def test_codecs(spark):
    hops = F.array(F.struct(F.lit("a").alias("name"), F.lit(3).alias("line"), F.lit(True).alias("via_call")), F.struct(F.lit("b c").alias("name"), F.lit(4).alias("line"), F.lit(False).alias("via_call")))
    df = spark.range(1)
    r = df.select(codecs.encode_path(hops, F.lit("sql")).alias("x")).select("x", codecs.decode_path(F.col("x")).alias("d")).first()
    assert r.x == "1;sql|a:3:c|~" and r.d.cut and r.d.hops[0].via_call and r.d.kind == "sql"
    for bad in ("", "2|a:1", "1|a", "1|~|a:1", "1a:1"):
        assert one(spark, codecs.decode_path(F.col("t")), t=bad) is None
    assert one(spark, codecs.decode_reaching(F.col("t")), t="x|1:3:4;bad;5:6").pairs == [(3, 4), (5, 6)]
    assert one(spark, codecs.decode_reaching(F.col("t")), t="x").name == "x"
    assert df.select(codecs.encode_summary(F.array(F.lit(0), F.lit(5))).alias("x")).first().x == "1|r:21"
    assert one(spark, codecs.decode_summary(F.col("t")), t="1|k:z|r:21") == [0, 5]
    want = 0x811C9DC5
    for b in "a\nß".encode():
        want = ((want ^ b) * 0x01000193) % 2**32
    assert df.select(codecs.fnv1a(F.array(F.lit("ß"), F.lit("a"))).alias("x")).first().x == f"{want:08x}"


# ---- contracts, routes, differences


@pytest.mark.parametrize("raw, want", [
    ("http::get::/a/b/", "http::GET::/a/b"), ("http::x", "http::x"), ("grpc::Auth.Svc/Login", "grpc::auth.svc/Login"), ("grpc::/x", "grpc::/x"), ("thrift::User", "thrift::user"), ("topic:: A ", "topic::a"),
    ("lib::ReAct", "lib::react"), ("include::./A\\b//C.h", "include::a/b/c.h"), ("plain", "plain"), ("custom::A", "custom::A"),
])
def test_contract_ids(spark, raw, want):
    assert one(spark, contracts.normalise(F.col("t")), t=raw) == want


def contract_rows(spark, data):
    full = [(c, c.split("::")[0], role, repo, svc, f"{repo}:{c}", "f", "s", conf, "{}") for c, role, repo, svc, conf in data]
    return spark.createDataFrame(full, "contract_id string, type string, role string, repo string, service string, symbol_uid string, file_path string, symbol_name string, confidence double, meta string")


def test_contract_matching(spark):
    c = contract_rows(spark, [
        ("http::GET::/a", "provider", "p", None, 0.9), ("http::*::/b", "provider", "p", None, 0.9), ("http::get::/a/", "consumer", "c", None, 0.8), ("http::POST::/b", "consumer", "c", None, 0.8),
        ("http::*::/a", "consumer", "p", None, 0.8), ("http::*::/a", "consumer", "d", None, 0.8), ("http::GET::/{param}", "provider", "p", None, 1.0), ("http::GET::/{param}", "consumer", "c", None, 1.0),
        ("grpc::com.User/Get", "provider", "p", None, 0.9), ("grpc::User/*", "consumer", "c", None, 0.7), ("thrift::a.Svc/m", "provider", "p", None, 0.9), ("thrift::b.Svc/m", "provider", "q", None, 0.9),
        ("thrift::Svc/m", "consumer", "c", None, 0.9), ("thrift::Svc/*", "consumer", "c", None, 0.9), ("lib::x", "provider", "m", "one", 0.9), ("lib::x", "consumer", "m", "two", 0.9),
    ])
    exact = contracts.exact_links(c, param_only=True)
    assert rows(exact, "contract_id", "from_repo", "to_repo") == [("http::*::/a", "d", "p"), ("http::POST::/b", "c", "p"), ("http::get::/a/", "c", "p"), ("lib::x", "m", "m")]
    wild = contracts.wildcard_links(c)
    assert rows(wild, "contract_id", "to_repo", "confidence") == [("grpc::User/*", "p", 0.7)]
    left = rows(contracts.unmatched(c, exact.unionByName(wild), param_only=True), "role", "contract_id")
    assert ("consumer", "thrift::Svc/m") in left and ("consumer", "http::GET::/{param}") not in left and ("provider", "http::GET::/a") not in left


def test_contract_dedupe_fills_from_the_poorer_row(spark):
    schema = "contract_id string, repo string, symbol_uid string, file_path string, symbol_name string, service string, confidence double, meta string, seq int"
    df = spark.createDataFrame([("x", "r", "", "f", "", "svc", 0.9, '{"source":"manifest"}', 1), ("x", "r", "u", "g", "n", None, 0.5, "{}", 2)], schema)
    r = contracts.dedupe_contracts(df, ["contract_id", "repo"], "seq").first()
    assert (r.symbol_uid, r.file_path, r.symbol_name, r.service, r.confidence) == ("u", "g", "n", "svc", 0.9)


def test_service_roots(spark):
    f = spark.createDataFrame([("a/b/c.ts",), ("a/x.ts",), ("z.ts",)], "file string")
    r = spark.createDataFrame([("a", "A"), ("a/b", "B")], "root string, service string")
    assert dict(rows(contracts.service_of(f, r).fillna("-"))) == {"a/b/c.ts": "B", "a/x.ts": "A", "z.ts": "-"}


@pytest.mark.parametrize("raw, want", [
    ("`/api/x/${id}`", "/api/x/[param]"), ("${base}/api/x?y=1", "/api/x"), ("${a}${b}/api/x", "/api/x"), ("${a}api/x", None), ("/api/upload.php", "/api/upload"), ("/api/a+b", None), ("api/x", None),
    ("${base}/${id}", None), ("/api/x${q ? `?a=${b}` : ''}", "/api/x"), ("${p}//host/x", None), ("/api/${a/b}/x${c}/y", "/api/[param]/x[param]/y"), ("/", "/"), ("", None), (None, None), ("${x}", None), ("/f(x)", None), ("/${a}x${b}", "/[param]x"),
])
def test_fetch_urls(spark, raw, want):
    assert one(spark, routes.fetch_url(F.col("t")), t=raw) == want


@pytest.mark.parametrize("fetch, route, want", [("/a/1", "/a/[id]", True), ("/a/1/2", "/a/[id]", False), ("/a/1/2", "/a/[...rest]", True), ("/a", "/a/[[...rest]]", True), ("/b/1", "/a/[...rest]", False), ("/[param]/x", "/a/x", True)])
def test_route_matching(spark, fetch, route, want):
    df = spark.createDataFrame([(fetch, route)], "url string, route string")
    assert df.select(routes.url_matches(F.col("url"), F.col("route")).alias("x")).first().x is want
    assert (routes.match_fetches(df.select("url"), df.select("route")).count() == 1) is want


def test_route_functions(spark):
    assert one(spark, routes.route_path(F.col("a"), F.col("b")), a="//x//y/", b="/p/") == "/p/x/y" and one(spark, routes.route_path(F.col("a")), a=" ") == "/"
    assert one(spark, routes.route_method(F.col("a")), a=" get ") == "GET" and one(spark, routes.route_method(F.col("a")), a="resource") is None
    assert one(spark, routes.nextjs_route(F.col("a")), a="src/app/(admin)/api/x/route.ts") == "/api/x" and one(spark, routes.nextjs_route(F.col("a")), a="pages/api/y/index.ts") == "/api/y"
    assert one(spark, routes.nextjs_route(F.col("a")), a="app/home/route.ts") is None
    for matcher, route, want in (("/a/:path*", "/a/b", True), ("/a/:path*", "/ab", False), ("/(a|b)/.*", "/b/x", True), ("/a", "/a/b", False)):
        assert one(spark, routes.matcher_hits(F.col("r"), F.col("m")), r=route, m=matcher) is want


@pytest.mark.parametrize("path, expo, php", [
    ("app/(tabs)/home.tsx", "/home", None), ("src\\app\\users\\[id].ts", "/users/[id]", None), ("app/index.tsx", "/", None), ("app/a/index.tsx", "/a", None), ("app/users+api.ts", "/users", None), ("app/_layout.tsx", None, None),
    ("app/+html.tsx", None, None), ("app/x.d.ts", None, None), ("api/upload.php", None, "/api/upload"), ("api/v1/next_sign.php", None, "/api/v1/next_sign"), ("api/db_config.php", None, None), ("api/contest.php", None, "/api/contest"),
    ("api/_x.php", None, None), ("src/api/x.php", None, None), (None, None, None), ("", None, None),
])
def test_file_routes(spark, path, expo, php):
    assert one(spark, routes.expo_route(F.col("p")), p=path) == expo and one(spark, routes.php_route(F.col("p")), p=path) == php


def test_shape_check_leaves_error_keys_out(spark):
    r = spark.createDataFrame([("/o", ["id"], ["error"]), ("/n", None, None)], "route string, response_keys array<string>, error_keys array<string>")
    c = spark.createDataFrame([("/o", "f", ["id", "error", "x"], 1), ("/o", "g", ["id"], 2), ("/n", "h", ["y"], 1)], "route string, consumer string, keys array<string>, fetches int")
    assert rows(routes.shape_check(r, c), "consumer", "missing", "confidence") == [("f", ["x"], "high"), ("g", [], "low")]
    assert dict(rows(routes.api_impact(r, c), "route", "risk")) == {"/o": "MEDIUM", "/n": "LOW"}


def test_definition_diff(spark):
    schema = "file string, key string, label string, owner string, name string, signature string, param_count int, is_exported boolean, text string"
    d = lambda k, name, sig="(a)", n=1, ex=True, body="": ("f", k, "Function", None, name, sig, n, ex, f"def {name}{body}")
    old = spark.createDataFrame([d("sig", "sig"), d("vis", "vis"), d("body", "body"), d("gone", "gone", "(q, r, s)", body="#"), d("was", "was", "(z)"), d("same", "same")], schema)
    new = spark.createDataFrame([d("sig", "sig", "(b)"), d("vis", "vis", ex=False), d("body", "body", body="!"), d("now", "now", "(z)"), d("extra", "extra", "()", 0, body="?"), d("same", "same")], schema)
    got = {(r.change, r.name, r.old_name, r.breaking) for r in diff.definition_diff(old, new).collect()}
    assert got == {("SignatureChanged", "sig", None, True), ("VisibilityChanged", "vis", None, True), ("BodyChanged", "body", None, False), ("Removed", "gone", None, True), ("Renamed", "now", "was", True), ("Added", "extra", None, False)}


def test_escalation_and_collapse():
    assert diff.must_write_all(50, 60, 100) and not diff.must_write_all(49, 90, 100) and not diff.must_write_all(60, 50, 100)
    assert diff.collapsed(40, 101) and not diff.collapsed(40, 100)


# ---- hierarchies and programs


def test_c3(spark):
    h = [("D", "B", 0), ("D", "C", 1), ("B", "A", 0), ("C", "A", 0), ("X", "A", 0), ("X", "B", 1), ("L", "L2", 0), ("L2", "L", 0)]
    df = spark.createDataFrame(h, "type string, parent string, position int")
    got = {r.type: r.mro for r in hierarchy.mro_c3(df).collect()}
    assert got["D"] == ["D", "B", "C", "A"] and got["X"] is None and got["L"] is None
    bf = rows(hierarchy.mro_breadth_first(df).filter("type = 'D'"), "position", "ancestor")
    assert bf == [(1, "B"), (2, "C"), (3, "A")]


def test_injection_counts_against_brute_force(spark):
    rnd = random.Random(5)
    up = {("A", "B"), ("B", "C"), ("C", "D"), ("X", "B"), ("L", "M"), ("M", "L")}
    over = {"A": "ABCD", "B": "BCD", "C": "CD", "D": "D", "X": "XBCD", "L": "LM", "M": "LM", "Z": "Z"}
    ids, kinds, q = [f"i{k}" for k in range(12)], [*over, None], ["p", "q", None]
    few = {k: rnd.choices(kinds, k=2) for k in ids}  # several consumers want the same, so they share their providers
    c = [(rnd.choice([*ids, None]), rnd.choice("BCDLZ"), rnd.choice(q)) for _ in range(14)] + [(i, w, None) for i in ids[:6] for w in few[ids[0]]] + [("only", "Z", "self"), ("lonely", "W", None)]
    p = [(rnd.choice([*ids, None]), rnd.choice(kinds), rnd.choice(q)) for _ in range(30)] + [("only", "Z", "self")]
    pairs = {(a, b) for a, w, x in c for b, t, y in p if None not in (a, b, w, t) and a != b and w in over[t] and x in (None, y)}
    want = sorted((a, len(bs), min(bs)) for a in {a for a, _ in pairs} for bs in [[b for s, b in pairs if s == a]])
    consumers = spark.createDataFrame([(*x, 0.8) for x in c], "id string, wanted string, qualifier string, confidence double")
    providers = spark.createDataFrame(p, "id string, type string, qualifier string")
    parents = spark.createDataFrame([(*x, 0) for x in up], "type string, parent string, position int")
    assert rows(hierarchy.injections(consumers, providers, parents), "src", "dst") == sorted(pairs)
    assert rows(hierarchy.injection_counts(consumers, providers, parents)) == want
    assert any(a == b for a, *_ in c for b, *_ in p) and any(len([x for x in c if x[0] == a]) > 1 for a in ids)


def test_injection_counts_leave_out_the_consumer_itself_where_it_is_first(spark):
    consumers = spark.createDataFrame([(i, "T", None, 0.8) for i in "abd"], "id string, wanted string, qualifier string, confidence double")
    providers = spark.createDataFrame([(i, "T", None) for i in "abc"], "id string, type string, qualifier string")
    parents = spark.createDataFrame([], "type string, parent string, position int")
    assert rows(hierarchy.injection_counts(consumers, providers, parents)) == [("a", 2, "b"), ("b", 2, "a"), ("d", 3, "a")]
    assert rows(hierarchy.injection_counts(consumers, providers.filter("id = 'a'"), parents)) == [("b", 1, "a"), ("d", 1, "a")]


def brute_dominators(out, start):
    nodes = set(out) | {n for ns in out.values() for n in ns}
    def reach(skip):
        seen, stack = set(), [start] if start != skip else []
        while stack:
            x = stack.pop()
            if x not in seen and x != skip:
                seen.add(x)
                stack += out.get(x, [])
        return seen
    full = reach(None)
    return {n: {d for d in full if n not in reach(d)} for n in full}, nodes


def test_dominators_and_control_dependence_against_brute_force(spark):
    rnd = random.Random(11)
    data, graphs = [], {}
    for k in range(12):
        n = rnd.randrange(3, 9)
        edges = {(i, i + 1) for i in range(n - 1)} | {(rnd.randrange(n), rnd.randrange(n)) for _ in range(4)}
        graphs[f"f{k}"] = {a: [b for x, b in edges if x == a] for a in range(n)}
        data += [(f"f{k}", a, b, "seq") for a, b in edges]
    cfg = spark.createDataFrame(data, "fn_id string, src_block int, dst_block int, kind string")
    facts = {}
    for r in pdg.block_facts(cfg).collect():
        facts.setdefault(r.fn_id, {})[r.block] = r
    cd = {}
    for r in pdg.control_dependence(cfg).collect():
        cd.setdefault(r.fn_id, set()).add((r.src_block, r.dst_block))
    for fn, out in graphs.items():
        dom, _ = brute_dominators(out, 0)
        for b, ds in dom.items():
            if b:
                d, strict = facts[fn][b].idom, ds - {b}
                assert d in strict and strict == dom[d] | {d} - {b}
        full, _ = pdg.with_exit(out)
        back = {}
        for a, ns in full.items():
            for n in ns:
                back.setdefault(n, []).append(a)
        post, _ = brute_dominators(back, pdg.EXIT)
        want = {(a, x) for a in out for b in out[a] for x in post if x != pdg.EXIT and x in post[b] | {b} and (x not in post[a] - {a})}
        assert cd.get(fn, set()) == want


def test_reaching_definitions_in_a_loop(spark):
    cfg = spark.createDataFrame([("f", 0, 1, ""), ("f", 1, 2, ""), ("f", 2, 1, ""), ("f", 1, 3, "")], "fn_id string, src_block int, dst_block int, kind string")
    acc = spark.createDataFrame([("f", 0, 0, 1, "x", "def"), ("f", 1, 0, 2, "x", "use"), ("f", 2, 0, 3, "x", "def"), ("f", 3, 0, 4, "x", "use"), ("g", 0, 0, 1, "y", "def"), ("g", 0, 1, 2, "y", "use")], "fn_id string, block int, seq int, line long, variable string, kind string")
    got = rows(pdg.reaching_definitions(cfg, acc), "fn_id", "def_line", "use_line")
    assert got == [("f", 1, 2), ("f", 1, 4), ("f", 3, 2), ("f", 3, 4), ("g", 1, 2)]


def test_taint_stops_at_its_sanitizer_only_for_its_kinds(spark):
    flows = spark.createDataFrame([("f", "v", 1, 2), ("f", "v", 2, 3), ("f", "v", 3, 2)], "fn_id string, variable string, def_line long, use_line long")
    src = spark.createDataFrame([("f", 1, ["sql", "xss"])], "fn_id string, line long, kinds array<string>")
    snk = spark.createDataFrame([("f", 3, "sql"), ("f", 3, "xss")], "fn_id string, line long, kind string")
    san = spark.createDataFrame([("f", 2, ["sql"])], "fn_id string, line long, kinds array<string>")
    assert rows(pdg.taint_within(flows, src, snk, san), "kind", "hops") == [("xss", 2)]


# ---- structure and resolution


def test_folders(spark):
    n, e = structure.folder_tree(spark.createDataFrame([("a/b/c.ts",), ("a/d.ts",), ("e.ts",)], "path string"))
    assert rows(n, "id") == [("File:a/b/c.ts",), ("File:a/d.ts",), ("File:e.ts",), ("Folder:a",), ("Folder:a/b",)]
    assert rows(e, "src", "dst") == [("Folder:a", "File:a/d.ts"), ("Folder:a", "Folder:a/b"), ("Folder:a/b", "File:a/b/c.ts")]


def test_markdown(spark):
    doc = "# A\r\ntext\n## B\n### C\n## D [x](../y.md) [z](http://h/) [s](#q)\n"
    df = spark.createDataFrame([("d/m.md", doc), ("y.md", "none"), ("n.md", None)], "path string, text string")
    assert rows(structure.markdown_sections(df).fillna(0), "line", "end_line", "parent_line") == [(1, 6, 0), (3, 4, 1), (4, 4, 3), (5, 6, 1)]
    assert rows(structure.markdown_links(df), "file", "target") == [("d/m.md", "y.md")]


def test_small_extractors(spark):
    df = spark.createDataFrame([("b.ts", "{ name: 'q', description: 'second' }"), ("a.ts", "{ name: 'q', description: `first` }")], "path string, text string")
    assert rows(structure.tool_definitions(df)) == [("q", "first", "a.ts")]
    q = spark.createDataFrame([("f", "User", "find"), ("f", "User", "find"), ("f", "Gone", "all")], "file string, model string, method string")
    n = spark.createDataFrame([("Interface:User", "Interface", "User"), ("Class:User", "Class", "User")], "id string, label string, name string")
    assert rows(structure.orm_queries(q, n, ["Class", "Interface", "CodeElement"]), "model", "target") == [("Gone", "CodeElement:Gone"), ("User", "Class:User")]
    t = contracts.topics(spark.createDataFrame([("f", "bus.send('Orders'); bus.subscribe('mail')")], "file string, text string"))
    assert rows(t, "role", "contract_id") == [("consumer", "topic::mail"), ("provider", "topic::orders")]


def test_reference_edges(spark):
    ref = spark.createDataFrame([("a", "b", "call", 1, 1), ("a", "b", "call", 1, 1), ("a", "b", "call", 2, 1), ("a", "b", "write", 3, 1), ("a", "b", "import-use", 4, 1), (None, "b", "call", 5, 1)], "caller string, target string, kind string, line int, col int")
    assert resolution.reference_edges(ref).count() == 3 and rows(resolution.reference_edges(ref, collapse=True), "type") == [("ACCESSES",), ("CALLS",)]
    inherits = spark.createDataFrame([("a", "b", "inherits", 1, 1)], ref.schema)
    assert resolution.reference_edges(inherits).first().type == "EXTENDS" and resolution.reference_edges(inherits, older=True).first().type == "INHERITS"


def test_mro_of_a_long_line(spark):
    n = 70
    up = _line(spark, n).select(F.col("src").alias("type"), F.col("dst").alias("parent"), F.lit(0).alias("position"))
    assert rows(hierarchy.mro_breadth_first(up).filter("type = 'n000'"), "position", "ancestor") == [(i, f"n{i:03}") for i in range(1, n)]


def test_enclosing_of_deep_scopes_and_cycles(spark):
    n = 70
    deep = [(f"s{i}", f"s{i + 1}" if i + 1 < n else None, "function" if i + 1 == n else "block", f"o{i}") for i in range(n)]
    loop = [("c0", "c1", "block", "x"), ("c1", "c2", "block", "x"), ("c2", "c3", "block", "x"), ("c3", "c1", "block", "x"), ("self", "self", "block", "x")]
    scopes = spark.createDataFrame(deep + loop, "scope string, parent string, kind string, owner string")
    start = spark.createDataFrame([("r1", "s0"), ("r2", "c0"), ("r3", "c2"), ("r4", "self")], "ref string, scope string")
    assert rows(resolution.enclosing(scopes, start, F.col("kind") == "function")) == [("r1", f"o{n - 1}")]


def test_taint_across_many_calls(spark):
    n = 40
    calls = _line(spark, n).select(F.col("src").alias("fn"), F.lit(0).alias("param"), F.col("dst").alias("callee"), F.lit(0).alias("callee_param"))
    entries = spark.createDataFrame([("in", "n000", 0)], "source string, fn string, param int")
    sinks = spark.createDataFrame([(f"n{n - 1:03}", 0, "sql", "out")], "fn string, param int, kind string, sink string")
    assert rows(pdg.taint_across(entries, calls, sinks), "source", "sink", "depth") == [("in", "out", n - 1)]


def test_enclosing_and_lexical(spark):
    scopes = spark.createDataFrame([("s1", None, "module", "m"), ("s2", "s1", "function", "f"), ("s3", "s2", "block", None)], "scope string, parent string, kind string, owner string")
    start = spark.createDataFrame([("r1", "s3"), ("r2", "s1")], "ref string, scope string")
    assert rows(resolution.enclosing(scopes, start, F.col("kind") == "function")) == [("r1", "f")]
    up = spark.createDataFrame([("s3", ["s3", "s2", "s1"])], "scope string, ancestors array<string>")
    b = spark.createDataFrame([("x", "s1", "outer", 0), ("x", "s2", "inner", 0)], "name string, scope string, id string, rank int")
    assert rows(resolution.lexical_lookup(spark.createDataFrame([("r", "x", "s3")], "ref string, name string, scope string"), b, up)) == [("r", "inner")]


def test_hunks_touch_symbols_of_their_file_only(spark):
    sym = spark.createDataFrame([("f1", "lib/a.py", 0, 1), ("f2", "src/mylib/a.py", 0, 1), ("f3", "lib/a.py", 40, 4000)], "id string, file string, start_line long, end_line long")
    h = spark.createDataFrame([("h1", "lib/a.py", 1, 1), ("h2", "lib/a.py", 3999, 9000), ("h3", "lib/a.py", 2, 39)], "hunk_id string, file string, start_line long, end_line long")
    assert rows(resolution.overlapping(h, sym)) == [("h1", "f1"), ("h2", "f3")]


def test_prefix_destination_and_pairs(spark):
    p = spark.createDataFrame([("/w/r/x",), ("/w/r2/x",)], "path string")
    assert dict(rows(resolution.longest_prefix(p, spark.createDataFrame([("/w",), ("/w/r",)], "root string")))) == {"/w/r/x": "/w/r", "/w/r2/x": "/w"}
    pub = spark.createDataFrame([("p", "kafka", "t"), ("q", "kafka", None)], "id string, broker string, address string")
    con = spark.createDataFrame([("c", "kafka", "t"), ("d", "kafka", None)], "id string, broker string, address string")
    assert rows(resolution.destination_links(pub, con), "publisher", "consumer") == [("p", "c")]
    e = spark.createDataFrame([("File:a", "Function:b", "X"), ("File:a", "Odd:b", "X"), ("comm_1", "Function:b", "X")], EDGE)
    labels = spark.createDataFrame([("File",), ("Function",), ("Community",)], "label string")
    ok = spark.createDataFrame([("File", "Function")], "from_label string, to_label string")
    assert dict(rows(resolution.boundary_pairs(e, labels, ok), "from_label", "problem")) == {"File": "unknown label", "Community": "undeclared"}


def test_fan_out_cap(spark):
    n = spark.createDataFrame([("u1", "b", 0.9), ("u2", "a", 0.9), ("u3", "c", 1.0)], "neighbor_uid string, contract_id string, confidence double")
    kept, dropped = impact.cap_fan_out(n, 2)
    assert rows(kept, "neighbor_uid") == [("u2",), ("u3",)] and rows(dropped, "neighbor_uid") == [("u1",)]
