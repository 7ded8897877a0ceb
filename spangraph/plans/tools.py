"""Composite questions, name resolution, upkeep and facts from text, over the code nodes and over the graph of the tables.

The code graph of the current nodes: a file defines its symbols, a function calls the classes and
methods of its file, a class has the methods within its lines, and a route is handled by its entry point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..functions import codecs, extract
from ..operators import contracts as co
from ..operators import diff as df
from ..operators import graph as g
from ..operators import impact as im
from ..operators import maintenance as mt
from ..operators import pdg
from ..operators import resolution as rs
from ..operators import routes as ro
from ..operators import search as se
from ..operators import structure as st
from ..operators import taint as ta
from ..operators import tools as to
from ..runtime import materialise, table, working_path
from .graph import _TRADE, _trade
from .program import CFG_SQL, _cfg
from .program import ORACLE as PROGRAM
from .projection import CURRENT_SQL, SUPPLIES_SQL, contains, current_nodes, supplies

SYMBOLS = ["Function", "Method", "Class", "Interface"]


def _file():
    return F.concat_ws("/", "repo", "file_path")


def _symbols(s, d) -> DataFrame:
    n = current_nodes(s, d).filter(F.col("label").isin(SYMBOLS) & F.col("repo").isNotNull() & F.col("file_path").isNotNull())
    return n.select("id", "label", "name", _file().alias("file"), "file_path", "repo", "start_line", "end_line", "content", "is_exported")


def _code_edges(s, d) -> DataFrame:
    n = materialise(_symbols(s, d), "symbols")
    e = lambda df, a, b, t: df.select(a.alias("src"), b.alias("dst"), F.lit(t).alias("type"))
    of = lambda label, p: n.filter(F.col("label").isin(label)).select("file", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "start_line", "end_line")])
    calls = of(["Function"], "a").join(of(["Method", "Class"], "b"), "file")
    has = of(["Class"], "a").join(of(["Method"], "b"), "file").filter("b_start_line between a_start_line and a_end_line")
    handled = current_nodes(s, d).filter("label = 'Route' and entry_point_id is not null")
    out = e(n, F.concat(F.lit("File:"), "file"), F.col("id"), "DEFINES").unionByName(e(calls, F.col("a_id"), F.col("b_id"), "CALLS"))
    return out.unionByName(e(has, F.col("a_id"), F.col("b_id"), "HAS_METHOD")).unionByName(e(handled, F.col("entry_point_id"), F.col("id"), "HANDLES_ROUTE"))


_CODE = f"""{CURRENT_SQL},
sym as (select id, label, name, repo || '/' || file_path as file, file_path, repo, start_line, end_line, content, is_exported from cur
        where label in ('Function', 'Method', 'Class', 'Interface') and repo is not null and file_path is not null),
code_(src, dst, type) as (
  select 'File:' || file, id, 'DEFINES' from sym union all
  select a.id, b.id, 'CALLS' from sym a join sym b using (file) where a.label = 'Function' and b.label in ('Method', 'Class') union all
  select a.id, b.id, 'HAS_METHOD' from sym a join sym b using (file) where a.label = 'Class' and b.label = 'Method' and b.start_line between a.start_line and a.end_line union all
  select entry_point_id, id, 'HANDLES_ROUTE' from cur where label = 'Route' and entry_point_id is not null)"""


# ---- composite questions


def context_symbols(s, d):
    """What surrounds every symbol: three neighbours a direction and relation type, with the number there are."""
    c = to.context(current_nodes(s, d).select("id", "name"), materialise(_code_edges(s, d), "code-edges"), _symbols(s, d), per_type=3)
    return c.select("id", "direction", "type", "n", F.array_join("neighbours", ">").alias("neighbours"))


def chain_callers(s, d):
    """Callers of every class and method, one or two calls away."""
    return to.chain(_code_edges(s, d), _symbols(s, d).filter("label in ('Class', 'Method')"), 2)


def _hunks(s, d) -> DataFrame:
    """A changed stretch at the first line of every class, and one far behind its file's end."""
    c = _symbols(s, d).filter("label = 'Class' and start_line is not null")
    near = c.select(F.concat(F.lit("near:"), "id").alias("hunk_id"), "file", "start_line", (F.col("start_line") + 1).alias("end_line"))
    return near.unionByName(c.select(F.concat(F.lit("far:"), "id").alias("hunk_id"), "file", (F.col("end_line") + 1_000_000).alias("start_line"), (F.col("end_line") + 1_000_001).alias("end_line")))


def _changes(s, d) -> tuple[DataFrame, DataFrame]:
    n = materialise(_symbols(s, d), "symbols")
    steps = n.select("id", F.col("repo").alias("process")).unionByName(n.select("id", F.col("label").alias("process")))
    return to.detect_changes(_hunks(s, d), n.filter("start_line is not null and end_line is not null"), steps, _code_edges(s, d))


def changed_symbols(s, d):
    """The symbols that changed lines touch, with processes, callers and risk."""
    return _changes(s, d)[0]


def untouched_hunks(s, d):
    return _changes(s, d)[1]


def route_map(s, d):
    r = to.route_map(current_nodes(s, d), _code_edges(s, d))
    return r.select("route", F.array_join("handlers", ">").alias("handlers"), F.size("consumers").alias("consumers"))


def tool_map(s, d):
    """Tools with the symbols that handle them: every class as a tool of its methods."""
    tools = _symbols(s, d).filter("label = 'Class'").select("id", "name", F.lit("Tool").alias("label"))
    e = _code_edges(s, d).filter("type = 'HAS_METHOD'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("HANDLES_TOOL").alias("type"))
    return to.tool_map(tools, e).select("tool", "name", F.array_join("handlers", ">").alias("handlers"))


def importers(s, d):
    """Who imports the nations of region 0, at any distance, hubs marked."""
    files = table(s, d, "nation").filter("n_regionkey = 0").select(F.concat(F.lit("N"), "n_nationkey").alias("id"))
    return to.importers(_trade(s, d).withColumn("type", F.lit("IMPORTS")), files, hub=10)


def circular_imports(s, d):
    c = to.circular(_trade(s, d).withColumn("type", F.lit("IMPORTS")))
    return c.select("component", F.array_join("members", ">").alias("members"))


def group_impact(s, d):
    """Upstream of every part and, where it is linked to another part's supplier, beyond the link."""
    links = table(s, d, "part").filter("p_size = 1").select(F.concat(F.lit("Supplier:"), F.col("p_partkey") % 10).alias("to_symbol"), F.concat(F.lit("Part:"), "p_partkey").alias("from_symbol"))
    anchors = table(s, d, "part").select(F.concat(F.lit("Part:"), "p_partkey").alias("id"))
    r = to.group_impact(supplies(s, d), links, anchors, max_depth=1)
    return r.groupBy("anchor", "crossed").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def augmented_names(s, d):
    """What surrounds the symbols whose name contains a word."""
    r = se.augment(current_nodes(s, d), _code_edges(s, d), "arser", symbols=20)
    return r.select("id", "name", "n_callers", "n_callees", F.array_join("callers", ">").alias("callers"), F.array_join("callees", ">").alias("callees"))


def query_symbols(s, d):
    """The answer to a search: each term's best symbols by file, with what defines and calls them."""
    r = to.query(current_nodes(s, d), _code_edges(s, d), ["parser", "cache"], limit=50)
    return r.select("id", "rank", "n_callers", F.round("score", 6).alias("score"))


# ---- positions, names and owners


def path_tails(s, d):
    p = F.col("file_path")
    tail = F.regexp_extract("file_path", r"([^/]+/[^/]+)$", 1)
    rows = current_nodes(s, d).filter("file_path is not null")
    return rows.select("id", rs.path_ends_with(p, tail).alias("whole"), rs.path_ends_with(p, F.expr("substring(file_path, 3)")).alias("cut"), rs.path_ends_with(p, p).alias("same"))


def longest_roots(s, d):
    """The deepest folder with at least two files that holds each scanned file."""
    files = table(s, d, "why_ignored_result").filter("repo is not null and path is not null").select(F.concat_ws("/", "repo", "path").alias("path")).distinct()
    parts = F.split("path", "/")
    up = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("root"))
    return rs.longest_prefix(files, up.groupBy("root").count().filter("count > 1").select("root"))


def enclosing_owner(s, d):
    """The region around each order's customer, up the tree of places."""
    e = contains(s, d).filter("dst not like 'Order:%'").select(F.col("dst").alias("scope"), F.col("src").alias("parent"))
    scopes = e.withColumn("kind", F.substring_index("scope", ":", 1)).withColumn("owner", F.concat(F.lit("def:"), "scope"))
    start = table(s, d, "orders").select(F.col("o_orderkey").alias("ref"), F.concat(F.lit("Customer:"), "o_custkey").alias("scope"))
    return rs.enclosing(scopes, start, F.col("kind") == "Region")


def lexical_names(s, d):
    """Each customer's segment, bound by its nation where a rich customer lives there, else by the world."""
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ident = lambda t, k: F.concat(F.lit(f"{t}:"), k)
    ref = c.select(F.col("c_custkey").alias("ref"), F.col("c_mktsegment").alias("name"), ident("Customer", "c_custkey").alias("scope"))
    scopes = c.select(ident("Customer", "c_custkey").alias("scope"), F.array(ident("Customer", "c_custkey"), ident("Nation", "c_nationkey"), ident("Region", "n_regionkey"), F.lit("World:0")).alias("ancestors"))
    bound = c.filter("c_acctbal > 9000").select(F.col("c_mktsegment").alias("name"), ident("Nation", "c_nationkey").alias("scope"), ident("Customer", "c_custkey").alias("id"), F.lit(0).alias("rank"))
    world = c.select(F.col("c_mktsegment").alias("name")).distinct().select("name", F.lit("World:0").alias("scope"), F.concat(F.lit("world:"), "name").alias("id"), F.lit(1).alias("rank"))
    return rs.lexical_lookup(ref, bound.unionByName(world), scopes)


def registry_names(s, d):
    """Definitions of every section's and route's name."""
    n = current_nodes(s, d).filter("name is not null")
    found = rs.registry_lookup(n.filter("label in ('Class', 'Interface')").select(F.col("id").alias("ref"), F.col("name").alias("qualified_name")), n.filter("label in ('Function', 'Method')").select(F.col("name").alias("qualified_name"), "id"))
    return found


def ownership(s, d):
    n = _symbols(s, d).filter("name is not null")
    owner = F.concat_ws("#", "file", "name")
    members = n.filter("label = 'Method'").join(n.filter("label = 'Class'").select("file", owner.alias("owner")), "file").select("id", "owner", F.when(F.col("is_exported"), "method").when(~F.col("is_exported"), "property").alias("kind"))
    return rs.ownership_edges(members, n.filter("label = 'Class'").select("id", owner.alias("qualified_name")))


def import_edges(s, d):
    """Every file imports the one file whose path ends like its own path without the first folder."""
    files = table(s, d, "why_ignored_result").filter("path is not null").select(F.col("path").alias("file")).distinct()
    imports = files.select("file", F.regexp_replace("file", r"^[^/]*/", "").alias("tail"), F.col("file").contains("core").alias("deferred"), F.col("file").endswith(".ts").alias("type_only"))
    paths = table(s, d, "why_ignored_result").filter("path is not null").select(F.concat(F.lit("root/"), F.regexp_replace("path", r"^[^/]*/", "")).alias("path")).distinct()
    resolved = rs.suffix_lookup(paths, imports.select("tail").distinct())
    return rs.import_edges(imports, resolved)


def destinations(s, d):
    """Suppliers publish to their nation's segment, customers consume theirs; unknown addresses join nothing."""
    p = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("broker"), F.when(F.col("s_acctbal") > 0, "BUILDING").alias("address"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("broker"), F.col("c_mktsegment").alias("address"))
    return rs.destination_links(p, c).groupBy("publisher", "broker", "address").agg(F.count("*").alias("consumers"))


def function_cfgs(s, d):
    """Functions with the flow graph that starts one line further."""
    n = _symbols(s, d).filter("label = 'Function' and start_line is not null")
    return rs.function_cfgs(n.select("id", "file", "start_line"), n.select(F.concat(F.lit("cfg:"), "id").alias("fn_id"), "file", (F.col("start_line") + 1).alias("start_line")))


def older_references(s, d):
    """Edges of references by the older kinds."""
    kind = F.when(F.col("l_returnflag") == "R", "inherits").when(F.col("l_returnflag") == "A", "uses").otherwise("call")
    ref = table(s, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("caller"), F.concat(F.lit("P"), "l_partkey").alias("target"), kind.alias("kind"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("col"))
    return rs.reference_edges(ref, older=True).groupBy("type").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


# ---- structure


def orm_queries(s, d):
    """Every file asks for the models that its methods are named like."""
    n = current_nodes(s, d).filter("name is not null")
    q = n.filter("label in ('Method', 'Function') and file_path is not null").select(_file().alias("file"), F.col("name").alias("model"), F.lit("find").alias("method"))
    return st.orm_queries(q, n.select("id", "label", "name"), ["Class", "Interface", "Function"])


def tool_definitions(s, d):
    text = F.concat(F.lit("tool({ name: '"), "name", F.lit("', description: `"), F.coalesce("description", F.lit("")), F.lit("` })"))
    files = current_nodes(s, d).filter("name rlike '^[A-Za-z0-9_-]+$' and not coalesce(description, '') rlike '[`\"\\']'").select(F.col("id").alias("path"), text.alias("text"))
    return st.tool_definitions(files)


def entry_point_links(s, d):
    """Files as processes, routes as targets by entry point, and by file where they have none."""
    n = current_nodes(s, d)
    p = n.filter("label = 'File' and file_path is not null").select(F.concat(F.lit("proc:"), "id").alias("process"), F.col("id").alias("entry"), _file().alias("file"))
    handler = F.when(F.length("id") % 2 == 0, F.col("entry_point_id"))
    return st.entry_point_links(p, n.filter("label = 'Route' and file_path is not null").select(F.col("id").alias("target"), handler.alias("handler"), _file().alias("file")))


def kept_locals(s, d):
    """Nodes without those that nothing but their file touches, block-scoped ones standing for locals."""
    n = current_nodes(s, d).withColumn("props", F.when(F.col("label").isin("Method", "Class"), F.create_map(F.lit("scope"), F.lit("block"))))
    return st.prune_locals(n, _code_edges(s, d), labels=("Method", "Class")).groupBy("label").agg(F.count("*").alias("n"))


# ---- contracts


def link_dedupe(s, d):
    """Links between routes and their files, each found several times."""
    r = current_nodes(s, d).filter("label = 'Route'").select(F.col("id").alias("contract_id"), "repo", F.col("name").alias("to_symbol"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    links = r.select(
        "contract_id", F.lit("http").alias("type"), F.when(F.col("k") == 3, "manifest").otherwise("exact").alias("match_type"), (F.col("k") / 10).alias("confidence"), F.lit("client").alias("from_repo"), F.lit(None).cast("string").alias("from_service"),
        F.lit("f").alias("from_symbol"), F.col("repo").alias("to_repo"), F.lit(None).cast("string").alias("to_service"), F.when(F.col("k") < 3, F.col("to_symbol")).alias("to_symbol"),
    )
    return co.dedupe_links(links).select("contract_id", "match_type", "confidence", "degraded")


def fan_out_kept(s, d):
    """The 50 suppliers with the highest balance among all, as neighbours under a cap."""
    n = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("neighbor_uid"), F.floor(F.col("s_acctbal") / 1000).alias("confidence"), F.concat(F.lit("c"), "s_nationkey").alias("contract_id"))
    return im.cap_fan_out(n, 50)[0]


def fan_out_dropped(s, d):
    n = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("neighbor_uid"), F.floor(F.col("s_acctbal") / 1000).alias("confidence"), F.concat(F.lit("c"), "s_nationkey").alias("contract_id"))
    return im.cap_fan_out(n, 50)[1]


def noisy_contracts(s, d):
    path = F.regexp_replace(F.substring_index("content", " ", -1), r"\{\w+\}", "{param}")
    r = current_nodes(s, d).filter("label = 'Route'").select("id", F.concat(F.lit("http::GET::"), path).alias("c"), F.concat(F.lit("http::GET::/"), F.regexp_replace("name", r"\W", ""), F.lit("/")).alias("e"))
    return r.select("id", co.noisy(F.col("c"), ["/section/{param}"], True).alias("listed"), co.noisy(F.lit("http::GET::/{param}/{param}/"), None, True).alias("open"), co.noisy(F.col("e"), ["/x"]).alias("other"))


# ---- upkeep


def shadow_paths(s, d):
    files = table(s, d, "why_ignored_result").filter("path is not null").select(F.col("path").alias("file")).distinct()
    return df.shadow_candidates(files).join(files.withColumnRenamed("file", "shadow"), "shadow", "left_semi").select("file", "shadow")


def regrouped_files(s, d):
    """The files of the folders that a file excluded by a rule lies in."""
    r = table(s, d, "why_ignored_result").filter("repo is not null and path is not null")
    group = F.when(F.col("path").contains("/"), F.concat_ws("/", "repo", F.regexp_replace("path", r"/[^/]*$", "")))
    files = r.select(F.concat_ws("/", "repo", "path").alias("file"), group.alias("group")).distinct()
    return mt.resolution_groups(files, r.filter("excluded_by is not null").select(F.concat_ws("/", "repo", "path").alias("file")))


def drifted_config(s, d):
    """How the keys that routes respond with differ between their first and their current version."""
    v = table(s, d, "nodes").filter("label = 'Route' and id is not null and response_keys is not null")
    old = v.groupBy(F.col("id").alias("key")).agg(F.min_by("response_keys", F.struct("indexed_at", F.to_json("response_keys"))).alias("values"))
    new = v.groupBy(F.col("id").alias("key")).agg(F.max_by("response_keys", F.struct("indexed_at", F.to_json("response_keys"))).alias("values"))
    return mt.config_drift(old.filter("length(key) % 5 <> 0"), new.filter("length(key) % 5 <> 1"))


def touched_labels(s, d):
    n = current_nodes(s, d).filter("file_path is not null")
    changed = n.filter("label = 'Route'").select(F.col("file_path").alias("file"))
    return mt.touched_labels(n, changed)


def stale_repos(s, d):
    """Repositories by whether the commit before the last delivery is the current one."""
    c = table(s, d, "commits").filter("repo is not null and commit_id is not null")
    now = c.groupBy("repo").agg(F.max(F.struct("committed_at", "commit_id")).alias("m")).select("repo", "m.commit_id")
    then = c.filter("loaded_at < timestamp_ntz'2026-01-01 00:00:00' or length(repo) % 3 = 0").groupBy("repo").agg(F.max(F.struct("committed_at", "commit_id")).alias("m")).select("repo", "m.commit_id")
    return mt.staleness(then, now)


def run_completeness(s, d):
    r = table(s, d, "embed_runs")
    return mt.completeness(r.select((F.col("run_id") % 4).alias("repo"), F.lit("embed").alias("stage"), F.coalesce("status", F.lit("timeout")).alias("status"))).select("repo", "complete", F.array_join("flags", ",").alias("flags"))


def relation_probe(s, d):
    n = current_nodes(s, d).select("id", "props")
    return mt.probe(n, _code_edges(s, d), "CALLS", ["lang"], limit=100_000_000)


def embedding_texts(s, d):
    n = current_nodes(s, d)
    t = mt.embedding_text(F.col("label"), F.col("name"), F.col("file_path"), F.col("description"), F.substring("name", 1, 3))
    return n.select("id", F.md5(t).alias("text"), F.md5(mt.declaration_only(F.col("content"))).alias("declared"))


# ---- facts from text


def facts_digest(s, d):
    """The digest of each order's line flags."""
    facts = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat("l_returnflag", F.lit(":"), "l_linenumber")).alias("f"))
    return facts.select("l_orderkey", codecs.fnv1a(F.col("f")).alias("digest"))


def middleware_chains(s, d):
    text = F.concat(F.lit("export default chain(["), F.array_join(F.coalesce("middleware", F.array().cast("array<string>")), ", "), F.lit(", logged])(handler)"))
    r = current_nodes(s, d).filter("label = 'Route'").select("id", text.alias("t"))
    return r.select("id", F.array_join(extract.middleware_chain(F.col("t")), ">").alias("chain"))


def folded_constants(s, d):
    """Sums of a constant of each file and a literal."""
    files = current_nodes(s, d).filter("label in ('Function', 'Method') and name rlike '^[A-Za-z_]+$'").select(F.col("id").alias("path"), F.concat(F.lit("export const BASE = '/"), "name", F.lit("';\nconst OTHER = \"x\";")).alias("text"))
    known = extract.constants(files)
    e = files.select(F.col("path").alias("expr_id"), "path", F.array(F.lit("BASE"), F.lit("'/v1'"), F.when(F.length("path") % 2 == 0, F.lit("OTHER")).otherwise("MISSING")).alias("operands"))
    return extract.fold_operands(e, known)


def declared_routes(s, d):
    """Routes that a made-up framework file of each route declares."""
    r = current_nodes(s, d).filter("label = 'Route'").select("id", F.lower(F.substring_index("content", " ", 1)).alias("m"), F.substring_index("content", " ", -1).alias("p"))
    f = r.filter("m in ('get', 'post', 'put', 'patch', 'delete')").select(F.concat("id", F.lit(".py")).alias("path"), F.concat(F.lit("router = APIRouter(prefix='/api')\n@router."), "m", F.lit("('"), "p", F.lit("')")).alias("text"))
    return extract.framework_routes(f).select("path", "framework", "method", "url")


def mounted_routes(s, d):
    """Routes behind one or two mounts, and those that a class inherits."""
    r = current_nodes(s, d).filter("label = 'Route'").select("id", "repo", F.substring_index("content", " ", -1).alias("path"))
    mounts = r.select("repo").distinct().select(F.col("repo").alias("child"), F.lit("app").alias("parent"), F.concat(F.lit("/"), "repo").alias("prefix")).unionByName(s.createDataFrame([("app", "root", "/api/")], "child string, parent string, prefix string"))
    return ro.mounted(r.select("id", F.col("repo").alias("router"), "path"), mounts)


def file_routes(s, d):
    files = table(s, d, "why_ignored_result").filter("path is not null").select("path").distinct()
    p = F.col("path")
    php = F.concat(F.lit("api/"), F.regexp_replace(p, r"\.\w+$", ".php"))
    return files.select("path", ro.expo_route(F.concat(F.lit("app/"), p)).alias("screen"), ro.php_route(php).alias("php"))


# ---- flow graphs


def block_idoms(s, d):
    """The immediate dominator of every block."""
    f = pdg.block_facts(_cfg(s, d)).filter("position is not null")
    return f.select("fn_id", "block", "idom")


def statement_reach(s, d):
    """Parts of the lines that depend on an order's first line, each line depending on the next."""
    li = table(s, d, "lineitem").select(F.concat(F.lit("Order:"), "l_orderkey").alias("fn_id"), F.col("l_linenumber").alias("block"), F.concat(F.lit("p"), "l_partkey").alias("p"))
    dep = li.select("fn_id", F.col("block").alias("src_block"), (F.col("block") + 1).alias("dst_block"))
    blocks = li.groupBy("fn_id", "block").agg(F.array_join(F.array_sort(F.collect_set("p")), " ").alias("callees")).withColumns({"start_line": F.col("block"), "end_line": F.col("block")})
    calls = li.select("fn_id", F.concat(F.lit("Part:"), "p").alias("callee"), F.col("p").alias("name")).distinct()
    start = li.select("fn_id").distinct().withColumn("line", F.lit(3))
    return to.statement_reach(dep, blocks, start, calls).groupBy("fn_id").agg(F.count("*").alias("n"), F.min("callee").alias("first_callee"))


def bfs_capped(s, d):
    """Layers below the world with at most 100 new nodes each."""
    return g.bfs(contains(s, d), s.createDataFrame([("World:0",)], "id string"), max_depth=4, row_cap=100)[0]


def semantic_nodes(s, d):
    """The nearest labels by their best vector."""
    e = table(s, d, "embeddings")
    anchor = e.orderBy("vec_id").limit(1).first().embedding
    near = se.semantic_nodes(e.withColumnRenamed("vec_id", "chunk_index"), "label", "embedding", list(anchor), 8, max_distance=2.0)
    return near.select("label", "chunk_index", F.round("distance", 6).alias("distance"))


def definition_changes(s, d):
    """How the definitions of each file differ between their first and their current version."""
    v = table(s, d, "nodes").filter("label in ('Function', 'Method') and id is not null and name is not null and repo is not null and file_path is not null")
    fields = ["name", "is_exported", "complexity", "content"]
    pick = lambda f: v.groupBy("id").agg(f(F.struct("indexed_at", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields], "label", "repo", "file_path")).alias("v"))

    def shaped(rows: DataFrame) -> DataFrame:
        x = F.col
        return rows.select(
            F.concat_ws("/", "v.repo", "v.file_path").alias("file"), x("id").alias("key"), x("v.label").alias("label"), F.lit("").alias("owner"), x("v.name").alias("name"), F.concat("v.name", F.lit("/"), "v.complexity").alias("signature"),
            F.lit(0).alias("param_count"), (x("v.is_exported") == "true").alias("is_exported"), x("v.content").alias("text"),
        )

    old, new = pick(F.min).filter("length(id) % 7 <> 0"), pick(F.max).filter("length(id) % 7 <> 1")
    changes = df.definition_diff(shaped(old), shaped(new))
    return changes.filter("change in ('SignatureChanged', 'VisibilityChanged', 'BodyChanged')").groupBy("file", "change").agg(F.count("*").alias("n"), F.count(F.when(F.col("breaking"), 1)).alias("breaking"))


def _reasoned(s, d) -> DataFrame:
    return _code_edges(s, d).withColumn("reason", F.when(F.length("dst") % 4 == 0, "name-guess").otherwise("resolved"))


def community_edges(s, d):
    """The edges that communities of symbols are found on, without guessed ones; leaves only in a small projection."""
    e, large = g.community_projection(current_nodes(s, d).select("id", "label").distinct(), _reasoned(s, d), types=("CALLS", "HAS_METHOD"), large=60)
    return e.withColumn("large", F.lit(large))


def folder_modularity(s, d):
    """How much of the calls stays within repositories beyond chance."""
    e = _code_edges(s, d).filter("type = 'CALLS'").select("src", "dst").distinct()
    return g.modularity(e, _symbols(s, d).select("id", F.col("repo").alias("community"))).select(F.round("modularity", 6).alias("modularity"))


def community_names(s, d):
    """Repositories as communities, named by their commonest folder."""
    n = _symbols(s, d)
    return g.community_labels(n.select("id", F.col("repo").alias("community")), n.select("id", "file_path"))


def symbol_cards(s, d):
    """Every symbol's whole context in one row: relation types, flows, routes and typed properties."""
    n = current_nodes(s, d).select("id", "name", "label", "complexity", "sloc", "is_exported")
    m = _symbols(s, d)
    steps = m.select("id", F.col("repo").alias("process"), F.coalesce("start_line", F.lit(0)).alias("step"))
    c = to.symbol_cards(n, materialise(_code_edges(s, d), "code-edges"), steps, m, per_type=2)
    types = lambda x: F.coalesce(F.array_join(F.array_sort(F.map_keys(x)), ","), F.lit(""))
    return c.select(
        "id", types("incoming").alias("incoming"), types("outgoing").alias("outgoing"), F.concat(F.col("processes")[0]["process"], F.lit("@"), F.col("processes")[0]["step"]).alias("process"),
        F.coalesce(F.size("routes"), F.lit(0)).alias("routes"), F.col("properties")["complexity"].alias("complexity"), F.col("properties")["is_exported"].alias("exported"),
    )


def taint_findings(s, d):
    """What reaches a sink, and what a sanitizer stops, by kinds; lines stand for statements."""
    li = table(s, d, "lineitem").select(F.concat(F.lit("Order:"), "l_orderkey").alias("fn_id"), F.col("l_linenumber").cast("long").alias("line"), "l_returnflag", "l_linestatus", "l_discount").distinct()
    flows = li.select("fn_id", F.lit("v").alias("variable"), F.col("line").alias("def_line"), (F.col("line") + 1).alias("use_line"))
    role = lambda cond, name, kinds: li.filter(cond).select("fn_id", "line", F.lit(name).alias("role"), F.array(*map(F.lit, kinds)).alias("kinds"))
    matched = role("l_returnflag = 'R'", "source", ["sql", "path"]).unionByName(role("l_linestatus = 'O'", "sink", ["sql"])).unionByName(role("l_discount >= 0.08", "sanitizer", ["sql"]))
    return ta.findings(flows, matched.distinct())


def explained_paths(s, d):
    """The taint between nations in words."""
    from .program import taint_paths

    e = taint_paths(s, d).select(F.col("source").alias("src"), F.col("fn").alias("dst"), F.lit("TAINT_PATH").alias("type"), "reason")
    return ta.explain(e, limit=100_000)


def claimed_types(s, d):
    """The type that each function means by the name of a class or interface of its file."""
    n = _symbols(s, d).filter("name is not null")
    b = n.select("name", F.col("file").alias("scope"), "id", "label", F.lit("local").alias("origin"))
    t = n.filter("label in ('Class', 'Interface')").select("file", F.col("name").alias("t"))
    f = n.filter("label = 'Function'").join(t, "file").select(F.concat_ws(">", "id", "t").alias("ref"), F.col("t").alias("name"), F.col("file").alias("scope")).distinct()
    scopes = n.select(F.col("file").alias("scope"), F.array("file", "repo").alias("ancestors")).distinct()
    return rs.type_references(f, b, scopes, n.select("id", F.concat_ws(".", "repo", "name").alias("qualified_name"), "label"))


def one_owner(s, d):
    """Each method with the smallest class of its file that holds it, else the smallest of its file."""
    n = _symbols(s, d)
    every = n.filter("label = 'Class'").select(F.col("id").alias("src"), "file").join(n.filter("label = 'Method'").select(F.col("id").alias("dst"), "file"), "file").select("src", "dst", F.lit("HAS_METHOD").alias("type"))
    kept, _ = rs.reconcile_ownership(every, n.select("id", "file", "start_line", "end_line"))
    return kept.select("src", "dst")


# ---- sources and sinks, there and back


def git_log_parse(s, d):
    """The commits of each repository as the text of its log, parsed."""
    c = table(s, d, "commits").filter("repo is not null and commit_id rlike '^[A-Za-z0-9]+$' and file rlike '^[A-Za-z0-9_./-]+$'").select("repo", "commit_id", "file").distinct()
    one = c.groupBy("repo", "commit_id").agg(F.array_join(F.array_sort(F.collect_list("file")), "\r\n").alias("files"))
    logs = one.select(F.concat(F.lit(sources.MARK), "commit_id", F.lit("\n\n"), "files", F.lit("\n")).alias("log"))
    return sources.parse_git_log(logs)


def edges_by_label(s, d):
    """All edges of the code graph, written in one folder for each pair of labels and read again."""
    path = working_path(s, "edges-by-label")
    sources.write_edges_by_label(_code_edges(s, d), path)
    back = s.read.option("header", True).csv(path)
    return back.groupBy("from_label", "to_label", "type").agg(F.count("*").alias("n"), F.min("src").alias("first_src"))


def contract_registry(s, d):
    """Contracts of routes, written as a registry and read again."""
    path = working_path(s, "registry")
    r = current_nodes(s, d).filter("label = 'Route'")
    none = F.lit(None).cast("string")
    rows = r.select(F.concat(F.lit("http::"), "content").alias("contract_id"), F.lit("http").alias("type"), F.lit("provider").alias("role"), "repo", none.alias("service"), F.col("id").alias("symbol_uid"), "file_path", F.col("name").alias("symbol_name"), F.lit(0.9).alias("confidence"), F.lit("{}").alias("meta"))
    sources.write_contracts(rows, path)
    return sources.read_contracts(s, path).select("contract_id", "role", "repo", "service", "symbol_uid", "confidence")


def markdown_links(s, d):
    """Every scanned file links to itself, to the first file of its repository and to one that isn't there."""
    f = table(s, d, "why_ignored_result").filter("repo is not null and path is not null").select("repo", F.concat_ws("/", "repo", "path").alias("path")).distinct()
    f = f.join(f.groupBy("repo").agg(F.min("path").alias("first")), "repo")
    text = F.concat(F.lit("see [a](./"), F.element_at(F.split("path", "/"), -1), F.lit(") and [b](/"), "first", F.lit("#part), not [c](../none.md) or [d](https://x.y/z)"))
    return st.markdown_links(f.select("path", text.alias("text")))


def response_shapes(s, d):
    """Keys of the answers that a made-up handler of each route builds."""
    r = current_nodes(s, d).filter("label = 'Route' and size(response_keys) > 0")
    obj = lambda c: F.concat(F.lit("{ "), F.array_join(F.transform(c, lambda k: F.concat(k, F.lit(": { inner: 1 }"))), ", "), F.lit(" }"))
    bad = F.coalesce("error_keys", F.array().cast("array<string>"))
    text = F.concat(F.lit("if (!x) {\n  return res.status(404).json("), obj(F.concat(F.array(F.lit("message")), bad)), F.lit(");\n}\nreturn res.json("), obj(F.col("response_keys")), F.lit(");"))
    k = extract.response_keys(r.select(F.col("id").alias("path"), text.alias("text")))
    return k.select("path", F.array_join("response_keys", ",").alias("good"), F.array_join("error_keys", ",").alias("bad"))


def config_links(s, d):
    """Repositories as configurations that name all classes, with the symbols they mean."""
    n = _symbols(s, d).filter("name is not null")
    configs = n.filter("label = 'Class'").groupBy(F.col("repo").alias("module")).agg(F.collect_set("name").alias("names")).withColumn("id", F.concat(F.lit("cfg:"), "module"))
    return mt.config_links(n.select("id", F.col("repo").alias("module"), F.col("name").alias("qualified_name")), configs)


QUERIES = {
    f.__name__: f
    for f in [
        git_log_parse, edges_by_label, contract_registry, markdown_links, response_shapes, config_links,
        community_edges, folder_modularity, community_names, symbol_cards, taint_findings, explained_paths, claimed_types, one_owner,
        context_symbols, chain_callers, changed_symbols, untouched_hunks, route_map, tool_map, importers, circular_imports, group_impact, augmented_names, query_symbols, path_tails, longest_roots, enclosing_owner, lexical_names,
        registry_names, ownership, import_edges, destinations, function_cfgs, older_references, orm_queries, tool_definitions, entry_point_links, kept_locals, link_dedupe, fan_out_kept, fan_out_dropped, noisy_contracts, shadow_paths,
        regrouped_files, drifted_config, touched_labels, stale_repos, run_completeness, relation_probe, embedding_texts, facts_digest, middleware_chains, folded_constants, declared_routes, mounted_routes, file_routes, block_idoms,
        statement_reach, bfs_capped, semantic_nodes, definition_changes,
    ]
}

ORACLE = {
    "git_log_parse": "select commit_id, file from (select distinct repo, commit_id, file from commits where repo is not null and regexp_full_match(commit_id, '[A-Za-z0-9]+') and regexp_full_match(file, '[A-Za-z0-9_./-]+'))",
    "edges_by_label": f"with {_CODE} select split_part(src, ':', 1) as from_label, split_part(dst, ':', 1) as to_label, type, count(*) as n, min(src) as first_src from code_ group by 1, 2, 3",
    "contract_registry": f"with {CURRENT_SQL} select 'http::' || content as contract_id, 'provider' as role, repo, null as service, id as symbol_uid, 0.9::double as confidence from cur where label = 'Route'",
    "markdown_links": """with f as (select distinct repo, repo || '/' || path as path from why_ignored_result where repo is not null and path is not null), m as (select repo, min(path) as first from f group by 1)
        select path as file, first as target, 0.8::double as confidence from f join m using (repo) where path <> first""",
    "response_shapes": f"""with {CURRENT_SQL} select id as path, array_to_string(list_transform(generate_series(1, len(u)), lambda i: u[i]), ',') as good, array_to_string(e, ',') as bad
        from (select id, list_filter(response_keys, lambda x, i: list_position(response_keys, x) = i) as u, list_filter(list_prepend('message', coalesce(error_keys, [])), lambda x, i: list_position(list_prepend('message', coalesce(error_keys, [])), x) = i) as e
          from cur where label = 'Route' and len(response_keys) > 0)""",
    "config_links": f"""with {_CODE}, n as (select * from sym where name is not null), k as (select distinct repo, name from n where label = 'Class') select distinct 'cfg:' || repo as src, n.id as dst, 'CONFIGURES' as type from n join k using (repo, name)""",
    "community_edges": f"""with {_CODE}, s as (select distinct id from cur where label in ('Function', 'Method', 'Class', 'Interface')), l as (select count(*) > 60 as large from s),
        e as (select distinct least(src, dst) as src, greatest(src, dst) as dst from code_ where type in ('CALLS', 'HAS_METHOD') and length(dst) % 4 <> 0 and src <> dst and src in (from s) and dst in (from s)),
        few as (select id from (select src as id from e union all select dst from e) group by 1 having count(*) = 1) select src, dst, large from e, l where not (large and (src in (from few) or dst in (from few)))""",
    "folder_modularity": f"""with {_CODE}, e as (select distinct src, dst from code_ where type = 'CALLS'), x as (select a.repo as a, b.repo as b from e join sym a on a.id = src join sym b on b.id = dst), t as (select count(*) as m from x),
        k as (select c, count(*) as ends from (select a as c from x union all select b from x) group by 1), i as (select a as c, count(*) as inside from x where a = b group by 1)
        select round(coalesce(sum(coalesce(inside, 0)::double / m - pow(ends::double / (2 * m), 2)), 0), 6) as modularity from k left join i using (c), t""",
    "community_names": f"""with {_CODE}, f as (select repo, regexp_replace(file_path, '/?[^/]*$', '') as p from sym), n as (select repo, string_split(p, '/')[-1] as folder, count(*) as n from f where string_split(p, '/')[-1] <> '' group by 1, 2)
        select repo as community, coalesce(arg_min(folder, struct_pack(n := -n, f := folder)), repo) as label from (select distinct repo from sym) left join n using (repo) group by 1, repo""",
    "symbol_cards": f"""with {_CODE}, ids as (select distinct id from cur), o as (select src as id, string_agg(distinct type, ',' order by type) as t from code_ where dst in (from ids) group by 1), i as (select dst as id, string_agg(distinct type, ',' order by type) as t from code_ where src in (from ids) group by 1),
        h as (select d.dst as id, count(distinct r.dst) as n from code_ d join code_ r on r.type = 'HANDLES_ROUTE' and r.src = d.src where d.type = 'DEFINES' group by 1)
        select id, coalesce(i.t, '') as incoming, coalesce(o.t, '') as outgoing, repo || '@' || coalesce(sym.start_line, 0) as process, coalesce(h.n, 0)::int as routes, cur.complexity::varchar as complexity, sym.is_exported::varchar as exported
        from sym join cur using (id, repo) left join i using (id) left join o using (id) left join h using (id)""",
    "taint_findings": """with recursive li as (select distinct 'Order:' || l_orderkey as fn_id, l_linenumber as line, l_returnflag as f, l_linestatus as st, l_discount as di from lineitem),
        t(fn_id, source_line, line) as (select distinct fn_id, line, line from li where f = 'R'
          union select t.fn_id, t.source_line, t.line + 1 from t join (select distinct fn_id, line from li) x on x.fn_id = t.fn_id and x.line = t.line
            where not exists (select 1 from li c where c.fn_id = t.fn_id and c.line = t.line + 1 and c.di >= 0.08))
        select distinct t.fn_id, source_line, t.line, 'sql' as kind, (t.line - source_line)::int as hops, 'TAINTED' as edge from t join li on li.fn_id = t.fn_id and li.line = t.line and st = 'O' where t.line > source_line
        union all select distinct t.fn_id, source_line, t.line + 1, 'sql', (t.line + 1 - source_line)::int, 'SANITIZES' from t join li here on here.fn_id = t.fn_id and here.line = t.line join li c on c.fn_id = t.fn_id and c.line = t.line + 1 and c.di >= 0.08""",
    "explained_paths": PROGRAM["taint_paths"].replace("select source, fn, depth, '1;sql|' || source || ':1|' || fn || ':' || (depth + 1) || case when depth > 0 then ':c' else '' end as reason from m",
        "select source as src, fn as dst, 'sql' as kind, source || '@1 > ' || fn || '@' || (depth + 1) as hops, false as cut from m"),
    "claimed_types": f"""with {_CODE}, n as (select * from sym where name is not null), t as (select file, name, count(distinct id) as n, min(id) as id from n where label in ('Class', 'Interface') group by 1, 2)
        select distinct f.id || '>' || t.name as ref, t.id from n f join t using (file) where f.label = 'Function' and t.n = 1""",
    "one_owner": f"""with {_CODE} select c.id as src, m.id as dst from sym c join sym m using (file) where c.label = 'Class' and m.label = 'Method'
        qualify row_number() over (partition by m.id order by not coalesce(m.start_line between c.start_line and c.end_line, false), c.end_line - c.start_line nulls last, c.id) = 1""",
    "context_symbols": f"""with {_CODE}, both_ as (select src as id, 'outgoing' as direction, type, dst as other from code_ union select dst, 'incoming', type, src from code_),
        f as (select distinct b.* from both_ b join sym on sym.id = b.id join (select distinct id as other from cur) using (other)),
        r as (select *, count(*) over (partition by id, direction, type) as n, row_number() over (partition by id, direction, type order by starts_with(other, 'File:'), other) as k from f)
        select id, direction, type, n, string_agg(other, '>' order by k) as neighbours from r where k <= 3 group by all""",
    "chain_callers": f"""with recursive {_CODE}, c as (select distinct src, dst from code_ where type = 'CALLS'), w(root, id, depth) as (select id, id, 0 from sym where label in ('Class', 'Method')
        union select root, src, depth + 1 from w join c on dst = id where depth < 2) select root, id, min(depth)::int as depth from w group by 1, 2 having min(depth) > 0""",
    "changed_symbols": f"""with {_CODE}, h as (select 'near:' || id as hunk_id, file, start_line as hs, start_line + 1 as he from sym where label = 'Class' and start_line is not null),
        t as (select distinct s.id, s.repo, s.label from sym s join h on h.file = s.file and hs <= end_line and he >= start_line), c as (select dst as id, count(distinct src) as callers from code_ where type = 'CALLS' group by 1)
        select id, 2 as processes, coalesce(callers, 0) as callers, case when coalesce(callers, 0) = 0 then 'UNKNOWN' when callers >= 30 then 'CRITICAL' when callers >= 15 then 'HIGH' when callers >= 5 then 'MEDIUM' else 'LOW' end as risk
        from t left join c using (id)""",
    "untouched_hunks": f"with {_CODE} select 'far:' || id as hunk_id from sym where label = 'Class' and start_line is not null",
    "route_map": f"with {_CODE} select id as route, coalesce((select string_agg(distinct src, '>' order by src) from code_ where dst = id and type = 'HANDLES_ROUTE'), '') as handlers, 0 as consumers from cur where label = 'Route'",
    "tool_map": f"""with {_CODE} select id as tool, any_value(name) as name, coalesce(string_agg(distinct dst, '>' order by dst), '') as handlers from sym left join code_ on src = id and type = 'HAS_METHOD' where label = 'Class' group by 1""",
    "importers": f"""with recursive {_TRADE}, w(id, depth) as (select 'N' || n_nationkey, 0 from nation where n_regionkey = 0 union select src, depth + 1 from w join trade_ on dst = id where depth < 5),
        m as (select id, min(depth)::int as depth from w group by 1), k as (select dst as id, count(distinct src) as n from trade_ group by 1) select id, depth, coalesce(n, 0) > 10 as hub from m left join k using (id)""",
    "circular_imports": f"""with recursive {_TRADE}, ids as (select src as id from trade_ union select dst from trade_), reach(a, b) as (select id, id from ids union select a, dst from reach join trade_ on src = b),
        c as (select x.a as id, max(x.b) as component from reach x join reach y on x.a = y.b and x.b = y.a group by 1), g as (select component, string_agg(id, '>' order by id) as members, count(*) as n from c group by 1)
        select component, members from g where n > 1 union all select src, src from trade_ where src = dst and src in (select id from c join g using (component) where n = 1)""",
    "group_impact": f"""with {SUPPLIES_SQL}, a as (select 'Part:' || p_partkey as anchor from part), own as (select anchor, src as id from a join supplies_ on dst = anchor),
        l as (select distinct 'Supplier:' || (p_partkey % 10) as id, 'Part:' || p_partkey as far from part where p_size = 1), s as (select distinct anchor, far from own join l using (id)),
        there as (select distinct anchor, far as id from s union select distinct s.anchor, src from s join supplies_ on dst = far)
        select anchor, false as crossed, count(*) as n, min(id) as first_id from own group by 1 union all select anchor, true, count(*), min(id) from there group by 1""",
    "augmented_names": f"""with {_CODE}, c as (select distinct src, dst from code_ where type = 'CALLS'), h as (select id, name from cur where contains(name, 'arser') order by id limit 20),
        up as (select id, src as o, row_number() over (partition by id order by starts_with(src, 'File:'), src) as k from h join c on dst = id), down_ as (select id, dst as o, row_number() over (partition by id order by starts_with(dst, 'File:'), dst) as k from h join c on src = id)
        select id, name, (select count(*) from up u where u.id = h.id) as n_callers, (select count(*) from down_ u where u.id = h.id) as n_callees,
          (select string_agg(o, '>' order by k) from up u where u.id = h.id and k <= 3) as callers, (select string_agg(o, '>' order by k) from down_ u where u.id = h.id and k <= 3) as callees from h""",
    "path_tails": f"with {CURRENT_SQL} select id, contains(file_path, '/') as whole, (file_path = substring(file_path, 3) or ends_with(file_path, '/' || substring(file_path, 3))) as cut, true as same from cur where file_path is not null",
    "longest_roots": """with f as (select distinct repo || '/' || path as path from why_ignored_result where repo is not null and path is not null), p as (select path, string_split(path, '/') as s from f),
        u as (select path, array_to_string(s[1:i], '/') as root, i from (select path, s, unnest(range(1, len(s))) as i from p)), r as (select root from u group by 1 having count(*) > 1)
        select path, arg_max(root, i) as root from u join r using (root) group by 1""",
    "enclosing_owner": "select o_orderkey as ref, 'def:Region:' || n_regionkey as owner from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
    "lexical_names": """with b as (select c_nationkey as k, c_mktsegment as m, min('Customer:' || c_custkey) as id from customer where c_acctbal > 9000 group by 1, 2)
        select c_custkey as ref, coalesce(id, 'world:' || c_mktsegment) as id from customer left join b on k = c_nationkey and m = c_mktsegment""",
    "registry_names": f"""with {CURRENT_SQL}, r as (select a.id as ref, b.id from cur a join cur b using (name) where a.label in ('Class', 'Interface') and b.label in ('Function', 'Method')) select ref, id, count(*) over (partition by ref) > 1 as ambiguous from r""",
    "ownership": f"""with {_CODE}, n as (select * from sym where name is not null), p as (select m.id, m.is_exported as x, c.file || '#' || c.name as owner from n m join n c using (file) where m.label = 'Method' and c.label = 'Class')
        select distinct c.id as src, p.id as dst, case when x then 'HAS_METHOD' else 'HAS_PROPERTY' end as type from p join n c on c.label = 'Class' and c.file || '#' || c.name = owner where x is not null""",
    "import_edges": r"""with f as (select distinct path as file, regexp_replace(path, '^[^/]*/', '') as tail from why_ignored_result where path is not null), p as (select distinct 'root/' || tail as path from f),
        s as (select path, array_to_string(string_split(path, '/')[i:], '/') as tail from (select path, unnest(range(1, len(string_split(path, '/')) + 1)) as i from p)), u as (select tail, min(path) as target from s where tail in (select tail from f) group by 1 having count(*) = 1),
        e as (select 'File:' || file as src, 'File:' || target as dst, 'import' || case when contains(file, 'core') then '|deferred' else '' end || case when ends_with(file, '.ts') then '|type-only' else '' end as reason from f join u using (tail) where file <> target)
        select src, dst, 'IMPORTS' as type, reason from e qualify row_number() over (partition by src, dst order by length(reason), reason) = 1""",
    "destinations": """select s_suppkey as publisher, s_nationkey::varchar as broker, 'BUILDING' as address, count(*) as consumers from supplier join customer on c_nationkey = s_nationkey and c_mktsegment = 'BUILDING' where s_acctbal > 0 group by 1, 2""",
    "function_cfgs": f"with {_CODE}, f as (select * from sym where label = 'Function' and start_line is not null qualify count(*) over (partition by file, start_line) = 1) select id, 'cfg:' || id as fn_id from f",
    "older_references": """with r as (select distinct l_suppkey, l_partkey, l_orderkey, l_linenumber, case l_returnflag when 'R' then 'INHERITS' when 'A' then 'USES' else 'CALLS' end as type from lineitem) select type, count(*) as n, sum(l_orderkey)::bigint as lines from r group by 1""",
    "orm_queries": f"""with {CURRENT_SQL}, n as (select * from cur where name is not null), q as (select distinct concat_ws('/', repo, file_path) as file, name as model from n where label in ('Method', 'Function') and file_path is not null),
        m as (select name as model, arg_min(id, struct_pack(p := list_position(['Class', 'Interface', 'Function'], label), i := id)) as id from n where label in ('Class', 'Interface', 'Function') group by 1)
        select file, model, 'find' as method, coalesce(id, 'CodeElement:' || model) as target, 0.9::double as confidence from q left join m using (model)""",
    "tool_definitions": f"""with {CURRENT_SQL} select name, substring(coalesce(description, ''), 1, 200) as description, id as file from cur where regexp_matches(name, '^[A-Za-z0-9_-]+$') and not regexp_matches(coalesce(description, ''), '[`"'']')
        qualify row_number() over (partition by name order by id) = 1""",
    "entry_point_links": f"""with {CURRENT_SQL}, p as (select 'proc:' || id as process, id as entry, concat_ws('/', repo, file_path) as file from cur where label = 'File' and file_path is not null),
        h as (select id as target, case when length(id) % 2 = 0 then entry_point_id end as handler, concat_ws('/', repo, file_path) as file from cur where label = 'Route' and file_path is not null)
        select process, target, 0.85::double as confidence from p join h on handler = entry union select process, target, 0.85 from p join h on handler is null and p.file = h.file""",
    "kept_locals": f"""with {_CODE}, used as (select src as id from code_ where not (type = 'DEFINES' and starts_with(src, 'File:')) union select dst from code_ where not (type = 'DEFINES' and starts_with(src, 'File:')))
        select label, count(*) as n from cur where not (label in ('Method', 'Class') and id not in (select id from used where id is not null)) group by 1""",
    "link_dedupe": f"""with {CURRENT_SQL} select id as contract_id, 'exact' as match_type, 0.2::double as confidence, coalesce(name, '') = '' as degraded from cur where label = 'Route' union all select id, 'manifest', 0.3, true from cur where label = 'Route'""",
    "fan_out_kept": "select s_suppkey::varchar as neighbor_uid, floor(s_acctbal / 1000)::bigint as confidence, 'c' || s_nationkey as contract_id from supplier order by 2 desc, 3, 1 limit 50",
    "fan_out_dropped": "select s_suppkey::varchar as neighbor_uid, floor(s_acctbal / 1000)::bigint as confidence, 'c' || s_nationkey as contract_id from supplier order by 2 desc, 3, 1 offset 50",
    "noisy_contracts": rf"""with {CURRENT_SQL}, r as (select id, regexp_replace(string_split(content, ' ')[-1], '\{{\w+\}}', '{{param}}', 'g') as p, regexp_replace(name, '\W', '', 'g') as e from cur where label = 'Route')
        select id, (rtrim(p, '/') = '/section/{{param}}' or (len(list_filter(string_split(p, '/'), lambda x: x <> '')) > 0 and len(list_filter(string_split(p, '/'), lambda x: x not in ('', '{{param}}'))) = 0)) as listed, true as open, e = 'x' as other from r""",
    "shadow_paths": r"""with f as (select distinct path as file from why_ignored_result where path is not null), s as (select file, regexp_replace(file, '\.[^./]+$', '') as stem from f),
        c as (select file, stem || '.' || unnest(['ts', 'tsx', 'js', 'jsx', 'mjs', 'd.ts']) as shadow from s union all select file, stem || '/index.' || unnest(['ts', 'tsx', 'js', 'jsx']) from s) select file, shadow from c where shadow <> file and shadow in (select file from f)""",
    "regrouped_files": """with r as (select distinct repo || '/' || path as file, case when contains(path, '/') then repo || '/' || regexp_replace(path, '/[^/]*$', '') end as g, excluded_by is not null as x from why_ignored_result where repo is not null and path is not null)
        select file from r where g in (select g from r where x) union select file from r where x""",
    "drifted_config": """with v as (select id as key, response_keys as k, indexed_at as t from nodes where label = 'Route' and id is not null and response_keys is not null),
        o as (select key, arg_min(k, struct_pack(t := t, j := to_json(k)::varchar)) as k from v where length(key) % 5 <> 0 group by 1), c as (select key, arg_max(k, struct_pack(t := t, j := to_json(k)::varchar)) as k from v where length(key) % 5 <> 1 group by 1),
        b as (select coalesce(o.key, c.key) as key, case when o.key is null then 'added' when c.key is null then 'removed' when list_sort(o.k) <> list_sort(c.k) then 'changed' end as drift from o full join c on o.key = c.key) select * from b where drift is not null""",
    "touched_labels": f"with {CURRENT_SQL} select distinct label from cur where file_path in (select file_path from cur where label = 'Route')",
    "stale_repos": """with c as (select * from commits where repo is not null and commit_id is not null), n as (select repo, max(struct_pack(t := committed_at, c := commit_id)).c as now from c group by 1),
        t as (select repo, max(struct_pack(t := committed_at, c := commit_id)).c as then_ from c where loaded_at < timestamp '2026-01-01' or length(repo) % 3 = 0 group by 1)
        select repo, case when then_ is null then 'never' when then_ <> now then 'stale' else 'fresh' end as status from n left join t using (repo)""",
    "run_completeness": """with f as (select run_id % 4 as repo, case when coalesce(status, 'timeout') = 'timeout' then 'timeout' when status = 'skipped' then 'suppressed-stage' when status <> 'ok' then 'incomplete-sync' end as flag from embed_runs)
        select repo, count(flag) = 0 as complete, coalesce(string_agg(distinct flag, ',' order by flag), '') as flags from f group by 1""",
    "relation_probe": f"""with {_CODE}, p as (select id, props['lang'] as l from cur) select distinct src, dst, a.l as src_lang, b.l as dst_lang from code_ join p a on a.id = src join p b on b.id = dst where type = 'CALLS'""",
    "embedding_texts": rf"""with {CURRENT_SQL}, l as (select *, regexp_extract(content, '(?s)^(.*?)(?:\{{|:[ \t]*(?:\r?\n|$))', 1) as head from cur)
        select id, md5(concat_ws(chr(10), concat_ws(' ', label, name), case when file_path is not null then 'in ' || file_path end, case when trim(coalesce(description, ''), ' ') <> '' then trim(description, ' ') end, substring(name, 1, 3))) as text,
          case when content is not null then md5(trim(case when head <> '' then head else content end, ' ')) end as declared from l""",
    "facts_digest": r"""with f as (select l_orderkey, list(l_returnflag || ':' || l_linenumber) as f from lineitem group by 1),
        b as (select l_orderkey, list_transform(range(1, length(t) + 1), lambda i: ord(substring(t, i, 1))::bigint) as c from (select l_orderkey, array_to_string(list_sort(f), chr(10)) as t from f))
        select l_orderkey, lpad(lower(printf('%x', list_reduce(list_prepend(2166136261::bigint, c), lambda a, x: (xor(a, x)::hugeint * 16777619 % 4294967296)::bigint))), 8, '0') as digest from b""",
    "middleware_chains": f"""with {CURRENT_SQL} select id, array_to_string(list_filter(list_transform(list_concat(coalesce(middleware, []), ['logged']), lambda x: trim(x)), lambda x: x not in ('', 'function', 'async')), '>') as chain from cur where label = 'Route'""",
    "folded_constants": f"with {CURRENT_SQL} select id as expr_id, '/' || name || '/v1x' as value from cur where label in ('Function', 'Method') and regexp_matches(name, '^[A-Za-z_]+$') and length(id) % 2 = 0",
    "declared_routes": rf"""with {CURRENT_SQL}, r as (select id, string_split(content, ' ')[1] as m, string_split(content, ' ')[-1] as p from cur where label = 'Route')
        select id || '.py' as path, 'fastapi' as framework, upper(m) as method, '/api' || case when trim(p, '/') = '' then '' else '/' || regexp_replace(trim(p, '/'), '/+', '/', 'g') end as url from r where lower(m) in ('get', 'post', 'put', 'patch', 'delete')""",
    "mounted_routes": rf"""with {CURRENT_SQL}, r as (select id, repo, trim(string_split(content, ' ')[-1], '/') as p from cur where label = 'Route' and repo is not null)
        select id, '/api/' || repo || case when p = '' then '' else '/' || regexp_replace(p, '/+', '/', 'g') end as url from r""",
    "file_routes": r"""with f as (select distinct path from why_ignored_result where path is not null), s as (select path, regexp_extract(path, '([^/]*)$', 1) as file, regexp_matches(path, '\.(tsx?|jsx?)$') and not regexp_matches(path, '\.d\.tsx?$') as ok,
          coalesce(nullif(regexp_extract('app/' || path, 'app/(.+)\.(?:tsx?|jsx?)$', 1), ''), '') as inner_ from f),
        t as (select *, regexp_extract(inner_, '([^/]*)$', 1) as leaf, regexp_replace(path, '\.\w+$', '.php') as php from s)
        select path, case when ok and inner_ <> '' and not starts_with(leaf, '_') and not (starts_with(leaf, '+') and not starts_with(leaf, '+api')) then
            '/' || array_to_string(list_filter(list_transform(list_append(string_split(inner_, '/')[:-2], case when regexp_replace(leaf, '\+api$', '') = 'index' then '' else regexp_replace(leaf, '\+api$', '') end),
              lambda x: regexp_replace(x, '\([^)]+\)', '', 'g')), lambda x: x <> ''), '/') end as screen,
          case when regexp_matches(regexp_extract(php, '([^/]*)$', 1), '.\.php$') and not starts_with(regexp_extract(php, '([^/]*)$', 1), '_')
            and not list_has_any(string_split(regexp_replace(regexp_extract(php, '([^/]*)$', 1), '\.php$', ''), '_'), ['helper', 'config', 'test', 'fixture', 'mock', 'setup', 'bootstrap']) then '/api/' || regexp_replace(php, '\.php$', '') end as php from t""",
    "block_idoms": f"""with recursive {CFG_SQL}, reach(fn, b) as (select fn, 0 from la union select r.fn, c.b from reach r join cfg c on c.fn = r.fn and c.a = r.b),
        without(fn, r, b) as (select fn, b, 0 from reach where b <> 0 union select w.fn, w.r, c.b from without w join cfg c on c.fn = w.fn and c.a = w.b where c.b <> w.r),
        dom as (select x.fn, x.b as d, y.b from reach x join reach y using (fn) where x.b <> y.b and (x.b = 0 or not exists (select 1 from without w where w.fn = x.fn and w.r = x.b and w.b = y.b))),
        depth as (select fn, b, count(*) as n from dom group by 1, 2)
        select reach.fn as fn_id, reach.b as block, (select arg_max(d, coalesce(n, 0)) from dom left join depth on depth.fn = dom.fn and depth.b = dom.d where dom.fn = reach.fn and dom.b = reach.b) as idom from reach""",
    "statement_reach": """with li as (select distinct 'Order:' || l_orderkey as fn_id, l_linenumber as n, l_partkey as p from lineitem), ok as (select fn_id, n from (select distinct fn_id, n from li) where n >= 3 qualify n - 3 + 1 = row_number() over (partition by fn_id order by n) and n <= 13)
        select fn_id, count(distinct p) as n, min('Part:p' || p) as first_callee from li join ok using (fn_id, n) group by 1""",
    "bfs_capped": """with c as (select 'Customer:' || c_custkey as id, c_custkey from customer order by 1 limit 100), o as (select 'Order:' || o_orderkey as id from orders join c on o_custkey = c_custkey order by 1 limit 100)
        select 'World:0' as id, 0 as depth union all select 'Region:' || r_regionkey, 1 from region union all select 'Nation:' || n_nationkey, 2 from nation union all select id, 3 from c union all select id, 4 from o""",
    "semantic_nodes": """with a as (select embedding as e from embeddings order by vec_id limit 1), d as (select label, vec_id as chunk_index, 1 - list_cosine_similarity(embedding::double[], a.e::double[]) as distance from embeddings, a),
        b as (select * from d qualify row_number() over (partition by label order by distance, chunk_index) = 1) select label, chunk_index, round(distance, 6) as distance from b order by b.distance, label limit 8""",
    "definition_changes": """with v as (select id, coalesce(name, '') as name, coalesce(is_exported::varchar, '') as x, coalesce(complexity::varchar, '') as c, coalesce(content, '') as t, indexed_at as at_, repo || '/' || file_path as file from nodes
          where label in ('Function', 'Method') and id is not null and name is not null and repo is not null and file_path is not null),
        o as (select id, min(struct_pack(at_ := at_, name := name, x := x, c := c, t := t, file := file)) as v from v where length(id) % 7 <> 0 group by 1), n as (select id, max(struct_pack(at_ := at_, name := name, x := x, c := c, t := t, file := file)) as v from v where length(id) % 7 <> 1 group by 1),
        k as (select n.v.file as file, o.v.name || '/' || o.v.c <> n.v.name || '/' || n.v.c as sig, (o.v.x = 'true') as ox, (n.v.x = 'true') as nx, o.v.t <> n.v.t as body from o join n using (id)),
        r as (select file, case when sig then 'SignatureChanged' when ox <> nx then 'VisibilityChanged' when body then 'BodyChanged' end as change, ox, nx from k)
        select file, change, count(*) as n, count(case when ox and (change = 'SignatureChanged' or (change = 'VisibilityChanged' and not nx)) then 1 end) as breaking from r where change is not null group by 1, 2""",
}
