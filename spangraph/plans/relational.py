"""Filters, joins, aggregates, windows, limits and set operations of the graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import mining, quality
from ..operators.graph import cohesion, degree, expand, of_type, two_hop_counts, undirected
from ..operators.windows import first_n
from ..runtime import table
from .projection import CALLS_SQL, CONTAINS_SQL, CURRENT_SQL, NODES_SQL, SUPPLIES_SQL, calls, contains, current_nodes, graph_nodes, supplies


def labels_count(s: SparkSession, d: str) -> DataFrame:
    return graph_nodes(s, d).groupBy("label").agg(F.count("*").alias("n"))


def degree_hotspots(s, d):
    e = contains(s, d).unionByName(supplies(s, d))
    return degree(e).orderBy(F.desc("degree"), "id").limit(50)


def hotspots_fan_in(s, d):
    return quality.hotspots(graph_nodes(s, d), supplies(s, d), 50)


def high_fan_out(s, d):
    return quality.high_fan_out(graph_nodes(s, d), calls(s, d), 50)


def high_complexity(s, d):
    return quality.high_complexity(current_nodes(s, d), 100)


def complexity_under(s, d):
    return quality.high_complexity(current_nodes(s, d), 100, "src/")


def god_nodes(s, d):
    parts = table(s, d, "part").select(F.concat(F.lit("Part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("complexity"), F.col("p_retailprice").alias("sloc"))
    return quality.god_functions(parts, calls(s, d), 500, sloc=500, complexity=30, fan_out=10)


def dead_nodes(s, d):
    year = table(s, d, "lineitem").filter("l_shipdate >= timestamp_ntz'1995-01-01 00:00:00' and l_shipdate < timestamp_ntz'1995-02-01 00:00:00'")
    used = year.select(F.col("l_partkey").alias("p_partkey")).distinct()
    rows = table(s, d, "part").join(used, "p_partkey", "left_anti").filter(~quality.implicitly_invoked(F.col("p_name")))
    return rows.select("p_partkey", "p_name")


def dead_code(s, d):
    nodes = current_nodes(s, d).filter("label in ('Function', 'Method')")
    used = table(s, d, "nodes").select(F.lit("File:x").alias("src"), F.col("entry_point_id").alias("dst"), F.lit("CALLS").alias("type"))
    return quality.dead_code(nodes, used, ["CALLS"], ["HANDLES_ROUTE"], 500)


def _injection_edges(s, d):
    sup = table(s, d, "supplier").join(table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    every = table(s, d, "nation").select("n_regionkey", "n_nationkey")
    inject = sup.join(every, "n_regionkey").select(F.concat(F.lit("Supplier:"), "s_suppkey").alias("src"), F.concat(F.lit("Nation:"), "n_nationkey").alias("dst"), F.lit("INJECTS").alias("type"))
    urgent = table(s, d, "orders").filter("o_orderpriority = '1-URGENT' and o_totalprice > 250000").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    call = urgent.select(F.concat(F.lit("Order:"), "o_orderkey").alias("src"), F.concat(F.lit("Nation:"), "c_nationkey").alias("dst"), F.lit("CALLS").alias("type"))
    owns = table(s, d, "lineitem").select(F.concat(F.lit("Supplier:"), "l_suppkey").alias("src"), F.concat(F.lit("Order:"), "l_orderkey").alias("dst"), F.lit("HAS_METHOD").alias("type")).distinct()
    return inject.unionByName(call).unionByName(owns)


def unused_injections(s, d):
    return quality.unused_injections(_injection_edges(s, d), 500)


def file_exports_union(s, d):
    """Members one hop down, and building-segment members two hops down."""
    r = table(s, d, "region")
    n = table(s, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    one = r.join(n, "r_regionkey").select("r_name", F.col("n_name").alias("member"))
    two = r.join(n, "r_regionkey").join(table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey")
    return one.unionByName(two.select("r_name", F.col("c_name").alias("member"))).distinct()


def grouped_exports(s, d):
    """Each customer with the list of its orders."""
    return table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))


def _nation_edges(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src"))
    p = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return li.join(o, "o_orderkey").join(c, "o_custkey").join(p, "l_suppkey").select("src", "dst", "o_orderkey", "l_suppkey")


def group_edge_counts(s, d):
    return _nation_edges(s, d).groupBy("src", "dst").agg(F.count("*").alias("n"))


def inter_group_edges(s, d):
    e = _nation_edges(s, d).filter("src <> dst")
    return e.groupBy("src").agg(F.countDistinct("o_orderkey").alias("orders"), F.countDistinct("l_suppkey").alias("suppliers"))


def group_edges_in_out(s, d):
    """Edges within, out of and into the nations of ASIA."""
    asia = table(s, d, "nation").join(table(s, d, "region").filter("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey", "left_semi")
    of = lambda end: asia.select(F.col("n_nationkey").alias(end), F.lit(True).alias(f"{end}_in"))
    e = _nation_edges(s, d).join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    a, b = F.col("src_in").isNotNull(), F.col("dst_in").isNotNull()
    kind = F.when(a & b, "within").when(a & ~b, "out").when(~a & b, "in")
    return e.select(kind.alias("direction")).filter("direction is not null").groupBy("direction").agg(F.count("*").alias("n"))


def not_in_drops_null(s, d):
    """NOT IN leaves out null sources, as the reference's does."""
    docs = table(s, d, "documents").filter(~F.col("source").isin("issue", "docs_page"))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def node_predicates(s, d):
    """Prefix, infix, suffix, null and case predicates in one scan."""
    p = F.col("file_path")
    rows = current_nodes(s, d).select(
        "id", p.startswith("src/").alias("in_src"), F.coalesce(F.col("content").contains("return"), F.lit(False)).alias("returns"), p.endswith(".py").alias("python"),
        F.col("description").isNotNull().alias("described"), F.when(F.col("complexity") >= 10, "high").when(F.col("complexity") >= 5, "medium").otherwise("low").alias("level"),
        quality.is_utility_file(p).alias("utility"), quality.implicitly_invoked(F.coalesce("name", F.lit(""))).alias("implicit"),
    )
    return rows


def first_node_wins(s, d):
    return current_nodes(s, d).select("id", "label", "indexed_at", "complexity")


def node_page(s, d):
    return current_nodes(s, d).select("id", "name").orderBy("id").offset(500).limit(500)


def one_hop_names(s, d):
    e = expand(of_type(contains(s, d), "CONTAINS"), graph_nodes(s, d))
    return e.groupBy("a_label", "b_label").agg(F.count("*").alias("n"), F.max("b_name").alias("last_name"))


def undirected_neighbours(s, d):
    u = undirected(supplies(s, d).select("src", "dst"))
    return u.groupBy("src").agg(F.countDistinct("dst").alias("neighbours"))


def two_hop_chain(s, d):
    """Orders that each supplier reaches over its parts."""
    li = table(s, d, "lineitem")
    far = two_hop_counts(li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), li.select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst")))
    return far.select(F.concat(F.lit("Supplier:"), "src").alias("src"), "n")


def optional_counts(s, d):
    """Customers with the number of their orders, none included."""
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return c.join(o, "c_custkey", "left").select("c_nationkey", F.coalesce("n", F.lit(0)).alias("orders")).groupBy("c_nationkey", "orders").agg(F.count("*").alias("customers"))


def top_neighbours(s, d):
    return first_n(supplies(s, d).select("src", "dst"), ["src"], [F.asc("dst")], 3)


def symmetric_difference(s, d):
    """Parts sold in exactly one of two years."""
    of = lambda y: table(s, d, "lineitem").filter(F.year("l_shipdate") == y).select("l_partkey").distinct().withColumn("y", F.lit(y))
    both = of(1994).unionByName(of(1996))
    return both.groupBy("l_partkey").agg(F.min("y").alias("only_in"), F.count("*").alias("n")).filter("n = 1").drop("n")


def unwound_keys(s, d):
    rows = current_nodes(s, d).select("id", F.explode("response_keys").alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n"))


def cohesion_by_group(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    e = li.join(o, "l_orderkey").select(F.concat(F.lit("Customer:"), "o_custkey").alias("src"), F.concat(F.lit("Supplier:"), "l_suppkey").alias("dst")).distinct()
    m = table(s, d, "customer").select(F.concat(F.lit("Customer:"), "c_custkey").alias("id"), F.col("c_nationkey").alias("community")).unionByName(
        table(s, d, "supplier").select(F.concat(F.lit("Supplier:"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))
    )
    return cohesion(e, m).withColumn("cohesion", F.round("cohesion", 6))


def edge_digest(s, d):
    """A digest that doesn't gather the edges: sums of 32 bits of each line's hash."""
    line = F.concat_ws("|", "src", "type", "dst")
    part = F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")
    e = contains(s, d).unionByName(calls(s, d))
    return e.groupBy("type").agg(F.count("*").alias("n"), F.sum(part).alias("digest"))


def _touched(s, d):
    c = table(s, d, "commits").filter("trim(commit_id) <> '' and trim(file) <> ''")
    return c.select(F.concat_ws("@", "repo", "commit_id").alias("commit_id"), F.concat_ws(":", "repo", "file").alias("file"))


def co_change_pairs(s, d):
    p = mining.co_change_pairs(_touched(s, d))
    return p.withColumn("strength", F.round("strength", 6))


def co_change_top5(s, d):
    return mining.keep_top_partners(co_change_pairs(s, d))


def co_change_partners(s, d):
    """Every file with its partners, either direction, by count, strength and name."""
    pairs = co_change_pairs(s, d)
    files = pairs.select(F.col("file_a").alias("file")).unionAll(pairs.select(F.col("file_b").alias("file"))).distinct()
    w = Window.partitionBy("file").orderBy(F.desc("change_count"), F.desc("strength"), "partner")
    return mining.partners(pairs, files).withColumn("rank", F.row_number().over(w))


def co_change_missing(s, d):
    """Usual partners of the 300 files changed last that are not among them."""
    last = table(s, d, "commits").filter("trim(commit_id) <> '' and trim(file) <> ''").groupBy(F.concat_ws(":", "repo", "file").alias("file")).agg(F.max("committed_at").alias("t")).orderBy(F.desc("t"), "file").limit(300)
    return mining.missing_partners(co_change_pairs(s, d), last.select("file"))


_PAIRS = """
touched as (
  select distinct concat_ws('@', repo, commit_id) as commit_id, concat_ws(':', repo, file) as file
  from commits where trim(commit_id) <> '' and trim(file) <> ''),
fit as (select commit_id from touched group by 1 having count(*) <= 50),
kept as (select t.* from touched t join fit using (commit_id)),
one as (select file, count(*) as n from kept group by 1),
pairs as (
  select a.file as file_a, b.file as file_b, count(*) as change_count
  from kept a join kept b on a.commit_id = b.commit_id and a.file < b.file group by 1, 2 having count(*) >= 3),
strong as (
  select file_a, file_b, change_count, round(change_count / least(x.n, y.n), 6) as strength
  from pairs join one x on x.file = file_a join one y on y.file = file_b where change_count / least(x.n, y.n) >= 0.3),
both_ as (
  select file_a as file, file_b as partner, change_count, strength from strong union all
  select file_b, file_a, change_count, strength from strong)
"""

_NATION_EDGES = """
e as (
  select c_nationkey as src, s_nationkey as dst, o_orderkey, l_suppkey
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)
"""

_IMPLICIT = "'^(constructor|main|init|__init__)$|^__.*__$|^(test|setUp|tearDown|beforeEach|afterEach|beforeAll|afterAll)'"
_TEST = r"""'(?i)(^|/)(tests?|__tests__|__mocks__|spec|e2e)/|[._](test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.(py|go)$|Tests?\.(java|kt|cs)$'"""
_UTILITY = r"""'/(utils?|helpers?|common|shared|lib)/|/(utils|helpers)\.(ts|js)$|_(utils|helpers)\.py$'"""

QUERIES = {
    f.__name__: f
    for f in [
        labels_count, degree_hotspots, hotspots_fan_in, high_fan_out, high_complexity, complexity_under, god_nodes, dead_nodes, dead_code, unused_injections, file_exports_union, grouped_exports,
        group_edge_counts, inter_group_edges, group_edges_in_out, not_in_drops_null, node_predicates, first_node_wins, node_page, one_hop_names, undirected_neighbours, two_hop_chain,
        optional_counts, top_neighbours, symmetric_difference, unwound_keys, cohesion_by_group, edge_digest, co_change_pairs, co_change_top5, co_change_partners, co_change_missing,
    ]
}

_EXPORTS = """
select distinct r_name, n_name as member from region join nation on r_regionkey = n_regionkey union
select distinct r_name, c_name from region join nation on r_regionkey = n_regionkey join customer on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING'"""

ORACLE = {
    "labels_count": f"with {NODES_SQL} select label, count(*) as n from nodes_ group by 1",
    "degree_hotspots": f"""with {CONTAINS_SQL}, {SUPPLIES_SQL}, ends as (
        select src as id from contains_ union all select dst from contains_ union all select src from supplies_ union all select dst from supplies_)
        select id, count(*) as degree from ends group by 1 order by degree desc, id limit 50""",
    "hotspots_fan_in": f"""with {NODES_SQL}, {SUPPLIES_SQL} select id, name, count(distinct src) as callers
        from nodes_ join supplies_ on dst = id group by 1, 2 order by callers desc, name, id limit 50""",
    "high_fan_out": f"""with {NODES_SQL}, {CALLS_SQL} select id, name, count(distinct dst) as callees
        from nodes_ join calls_ on src = id group by 1, 2 order by callees desc, name, id limit 50""",
    "high_complexity": f"with {CURRENT_SQL} select id, name, complexity, sloc from cur where complexity > 0 order by complexity desc, sloc desc nulls last, name nulls first, id limit 100",
    "complexity_under": f"with {CURRENT_SQL} select id, name, complexity, sloc from cur where complexity > 0 and starts_with(file_path, 'src/') order by complexity desc, sloc desc nulls last, name nulls first, id limit 100",
    "god_nodes": f"""with {CALLS_SQL}, n as (select 'Part:' || p_partkey as id, p_name as name, p_size as complexity, p_retailprice as sloc from part where p_retailprice >= 500 and p_size >= 30)
        select id, name, complexity, sloc, count(distinct dst) as fan_out from n join calls_ on src = id group by all having count(distinct dst) >= 10
        order by complexity desc, fan_out desc, name, id limit 500""",
    "dead_nodes": f"""select p_partkey, p_name from part where not regexp_matches(p_name, {_IMPLICIT}) and p_partkey not in (
        select l_partkey from lineitem where l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '1995-02-01')""",
    "dead_code": f"""with {CURRENT_SQL} select id, name, file_path, start_line from cur where label in ('Function', 'Method') and is_exported = false
        and not exists (select 1 from nodes m where m.entry_point_id = cur.id)
        and not regexp_matches(coalesce(name, ''), {_IMPLICIT}) and not coalesce(regexp_matches(replace(file_path, chr(92), '/'), {_TEST}), false)
        order by file_path nulls first, start_line nulls first, id limit 500""",
    "unused_injections": """with i as (select distinct 'Supplier:' || s_suppkey as consumer, 'Nation:' || n.n_nationkey as provider
          from supplier join nation h on s_nationkey = h.n_nationkey join nation n on n.n_regionkey = h.n_regionkey),
        used as (select distinct 'Supplier:' || l_suppkey as consumer, 'Nation:' || c_nationkey as provider
          from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT' and o_totalprice > 250000)
        select * from i where not exists (select 1 from used u where u.consumer = i.consumer and u.provider = i.provider) order by 1, 2 limit 500""",
    "file_exports_union": _EXPORTS,
    "grouped_exports": "select o_custkey, list(o_orderkey order by o_orderkey) as orders from orders group by 1",
    "group_edge_counts": f"with {_NATION_EDGES} select src, dst, count(*) as n from e group by 1, 2",
    "inter_group_edges": f"with {_NATION_EDGES} select src, count(distinct o_orderkey) as orders, count(distinct l_suppkey) as suppliers from e where src <> dst group by 1",
    "group_edges_in_out": f"""with {_NATION_EDGES}, asia as (select n_nationkey as k from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'),
        k as (select case when src in (from asia) and dst in (from asia) then 'within' when src in (from asia) then 'out' when dst in (from asia) then 'in' end as direction from e)
        select direction, count(*) as n from k where direction is not null group by 1""",
    "not_in_drops_null": "select source, count(*) as n, sum(n_chars) as chars from documents where source not in ('issue', 'docs_page') group by 1",
    "node_predicates": f"""with {CURRENT_SQL} select id, starts_with(file_path, 'src/') as in_src, coalesce(contains(content, 'return'), false) as returns, ends_with(file_path, '.py') as python,
        description is not null as described, case when complexity >= 10 then 'high' when complexity >= 5 then 'medium' else 'low' end as level,
        coalesce(regexp_matches(lower(replace(file_path, chr(92), '/')), {_UTILITY}), false) as utility, regexp_matches(coalesce(name, ''), {_IMPLICIT}) as implicit from cur""",
    "first_node_wins": f"with {CURRENT_SQL} select id, label, indexed_at, complexity from cur",
    "node_page": f"with {CURRENT_SQL} select id, name from cur order by id limit 500 offset 500",
    "one_hop_names": f"""with {NODES_SQL}, {CONTAINS_SQL} select a.label as a_label, b.label as b_label, count(*) as n, max(b.name) as last_name
        from contains_ join nodes_ a on src = a.id join nodes_ b on dst = b.id group by 1, 2""",
    "undirected_neighbours": f"""with {SUPPLIES_SQL}, u as (select src, dst from supplies_ union all select dst, src from supplies_)
        select src, count(distinct dst) as neighbours from u group by 1""",
    "two_hop_chain": """select src, count(*) as n from (select distinct 'Supplier:' || a.l_suppkey as src, b.l_orderkey from (select distinct l_suppkey, l_partkey from lineitem) a
        join (select distinct l_partkey, l_orderkey from lineitem) b using (l_partkey)) group by 1""",
    "optional_counts": """select c_nationkey, orders, count(*) as customers from (
        select c_nationkey, c_custkey, count(o_orderkey) as orders from customer left join orders on o_custkey = c_custkey group by 1, 2) group by 1, 2""",
    "top_neighbours": f"with {SUPPLIES_SQL} select src, dst, row_number() over (partition by src order by dst) as rank from supplies_ qualify rank <= 3",
    "symmetric_difference": """select l_partkey, min(y) as only_in from (
        select distinct l_partkey, year(l_shipdate)::int as y from lineitem where year(l_shipdate) in (1994, 1996)) group by 1 having count(*) = 1""",
    "unwound_keys": f"with {CURRENT_SQL} select key, count(*) as n from (select unnest(response_keys) as key from cur) group by 1",
    "cohesion_by_group": """with e as (select distinct 'C' || o_custkey as a, 'S' || l_suppkey as b from lineitem join orders on l_orderkey = o_orderkey),
        m as (select 'C' || c_custkey as id, c_nationkey as community from customer union all select 'S' || s_suppkey, s_nationkey from supplier),
        u as (select x.community as c, y.community as o from e join m x on a = x.id join m y on b = y.id union all select y.community, x.community from e join m x on a = x.id join m y on b = y.id),
        t as (select c, count(*) as ends, count(*) filter (c = o) as internal_ends from u group by 1)
        select community, coalesce(ends, 0) as ends, coalesce(internal_ends, 0) as internal_ends, case when coalesce(ends, 0) = 0 then 1.0::double else round(internal_ends / ends, 6) end as cohesion
        from (select distinct community from m) left join t on c = community""",
    "edge_digest": f"""with {CONTAINS_SQL}, {CALLS_SQL}, e as (select * from contains_ union all select * from calls_)
        select type, count(*) as n, sum(('0x' || md5(src || '|' || type || '|' || dst)[1:8])::bigint)::bigint as digest from e group by 1""",
    "co_change_pairs": f"with {_PAIRS} select * from strong",
    "co_change_top5": f"""with {_PAIRS}, r as (select *, row_number() over (partition by e order by change_count desc, strength desc, file_a, file_b) as k
        from (select *, unnest([file_a, file_b]) as e from strong)) select distinct file_a, file_b, change_count, strength from r where k <= 5""",
    "co_change_partners": f"with {_PAIRS} select *, row_number() over (partition by file order by change_count desc, strength desc, partner) as rank from both_",
    "co_change_missing": f"""with {_PAIRS}, last as (select file from (select concat_ws(':', repo, file) as file, max(committed_at) as t from commits
          where trim(commit_id) <> '' and trim(file) <> '' group by 1 order by t desc, file limit 300)),
        f as (select * from both_ where file in (from last) and partner not in (from last))
        select partner, max(struct_pack(c := change_count, s := strength)).c as change_count, max(struct_pack(c := change_count, s := strength)).s as strength, list(distinct file order by file) as with_files
        from f group by 1 order by 2 desc, 3 desc, 1 limit 5""",
}
