"""Traversals, impact, paths, components and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import impact as im
from ..operators.search import process_cards
from ..runtime import table
from .projection import CALLS_SQL, CONTAINS_SQL, CURRENT_SQL, NODES_SQL, SUPPLIES_SQL, calls, contains, current_nodes, graph_nodes, supplies


def _one(s: SparkSession, *ids: str) -> DataFrame:
    return s.createDataFrame([(i,) for i in ids], "id string")


def bfs_downstream(s, d):
    return g.bfs(contains(s, d), _one(s, "World:0"), max_depth=4)[0]


def bfs_upstream(s, d):
    """What contains each order, at any distance."""
    orders = table(s, d, "orders").select(F.concat(F.lit("Order:"), "o_orderkey").alias("id"))
    up, _ = g.bfs(contains(s, d), orders, up=True, max_depth=4)
    return up.filter("depth > 0")


def bfs_cyclic(s, d):
    """Layers around one supplier in the undirected graph of suppliers and parts."""
    return g.bfs(g.undirected(supplies(s, d)), _one(s, "Supplier:0"), max_depth=3)[0]


def _nations(s, d):
    return table(s, d, "nation").select(F.concat(F.lit("Nation:"), "n_nationkey").alias("id"))


def impact_by_depth(s, d):
    return im.by_depth(im.impact(contains(s, d), _nations(s, d), upstream=False)[0])


def _parts(s, d):
    return table(s, d, "part").select(F.concat(F.lit("Part:"), "p_partkey").alias("id"))


def impact_risk(s, d):
    """Risk of changing a part, by the suppliers that call it and their nations and regions."""
    reached, _ = im.impact(calls(s, d), _parts(s, d), upstream=True, types=["CALLS"])
    sup = table(s, d, "supplier").select(F.concat(F.lit("Supplier:"), "s_suppkey").alias("id"), "s_nationkey")
    region = table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return im.risk_report(_parts(s, d), reached, sup.select("id", F.col("s_nationkey").alias("process")), sup.join(region, "s_nationkey").select("id", F.col("n_regionkey").alias("community")), "upstream").select("anchor", "direct", "impacted", "processes", "modules", "risk")


def impact_unknown(s, d):
    """Suppliers have no callers: unknown upstream, low downstream."""
    sup = table(s, d, "supplier").select(F.concat(F.lit("Supplier:"), "s_suppkey").alias("id"))
    out = None
    for direction in ("upstream", "downstream"):
        reached, _ = im.impact(contains(s, d), sup, upstream=direction == "upstream")
        r = im.risk_report(sup, reached, None, None, direction).select("anchor", F.lit(direction).alias("direction"), "risk", F.col("risk_note").isNotNull().alias("hedged"))
        out = r if out is None else out.unionByName(r)
    return out


def impact_page(s, d):
    return im.impact_page(im.impact(contains(s, d), _nations(s, d), upstream=False)[0], limit=30, offset=10)


def impact_ambiguous(s, d):
    """Node names with several candidates, with their number and the 20 lowest ids."""
    return im.candidates(current_nodes(s, d)).filter("candidates > 1").select("name", "id", "candidates", "rank")


def confidence_floor(s, d):
    stored = F.when(F.length("dst") % 3 == 0, F.lit(0.0)).when(F.length("dst") % 3 == 1, F.lit(0.7))
    e = contains(s, d).unionByName(supplies(s, d)).withColumn("confidence", stored)
    return e.groupBy("type", g.confidence(F.col("type"), F.col("confidence")).alias("used")).agg(F.count("*").alias("n"))


def shortest_path(s, d):
    return g.shortest_path(g.undirected(contains(s, d)), "Order:0", "Order:1", max_depth=10)


def path_1_to_5(s, d):
    p = g.paths(contains(s, d), _one(s, "World:0"), 1, 5).filter(F.forall("types", lambda t: t == "CONTAINS"))
    return p.select("id", "length", F.array_join("nodes", ">").alias("nodes"))


def path_two_hops_named(s, d):
    """Walks of one or two calls that end at a given order."""
    p = g.paths(calls(s, d), table(s, d, "supplier").select(F.concat(F.lit("Supplier:"), "s_suppkey").alias("id")), 1, 2, edge_unique=True)
    return p.filter("id = 'Order:1'").select(F.array_join("nodes", ">").alias("nodes"), "length")


def _trade(s, d):
    """Nation pairs that trade more than the average pair, as a directed graph."""
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("a"))
    p = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    n = li.join(o, "o_orderkey").join(c, "c_custkey").join(p, "s_suppkey").groupBy("a", "b").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"), F.count("*").alias("k")).first()
    return n.filter(F.col("n") * total.k * 10 > F.lit(total.t * 15)).select(F.concat(F.lit("N"), "a").alias("src"), F.concat(F.lit("N"), "b").alias("dst"), F.lit("TRADES").alias("type"))


def cycles_scc(s, d):
    return g.components(_trade(s, d))


def closure_contains(s, d):
    """Everything with all that it contains at any distance, over all CONTAINS edges."""
    return g.closure(contains(s, d))


def closure_subtypes(s, d):
    """The closure of the hierarchy of places and customers, whose leaves are customers, not orders."""
    e = contains(s, d).filter("dst not like 'Order:%'")
    return g.closure(e)


def communities(s, d):
    return g.communities(_trade(s, d))


def process_flows(s, d):
    e = _trade(s, d).withColumns({"type": F.lit("CALLS"), "reason": F.lit("resolved"), "confidence": F.lit(0.9)})
    entries = e.groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("score"))
    return g.flows(e, entries, branching=2, depth=5, max_entries=50)


def flow_steps(s, d):
    """Each user's events in order: the steps of a flow."""
    from pyspark.sql import Window

    e = table(s, d, "events")
    return e.select("user_id", "event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"))


def flow_heads(s, d):
    """Flows with their first and last step and length, users without events included (none here)."""
    f = flow_steps(s, d)
    return f.groupBy("user_id").agg(F.count("*").alias("steps"), F.min_by("event_type", "step").alias("first_type"), F.max_by("event_type", "step").alias("last_type"))


def query_process_cards(s, d):
    """The five best events of each user, an event's content with its first card only."""
    f = flow_steps(s, d).select(F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("process"), "step")
    hits = table(s, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("value").alias("score"))
    return process_cards(hits, f, per_process=5)


def entry_point_score(s, d):
    from ..operators.score import entry_point

    n = current_nodes(s, d).filter("label in ('Function', 'Method') and complexity is not null")
    return n.select("id", F.round(entry_point(F.col("name"), F.col("is_exported"), F.coalesce(F.col("sloc"), F.lit(0)) % 5, F.col("complexity") - 1), 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in [
        bfs_downstream, bfs_upstream, bfs_cyclic, impact_by_depth, impact_risk, impact_unknown, impact_page, impact_ambiguous, confidence_floor, shortest_path, path_1_to_5, path_two_hops_named,
        cycles_scc, closure_contains, closure_subtypes, communities, process_flows, flow_steps, flow_heads, query_process_cards, entry_point_score,
    ]
}

_DOWN = f"""with recursive {CONTAINS_SQL}, reach(anchor, id, depth) as (
  select 'Nation:' || n_nationkey, 'Nation:' || n_nationkey, 0 from nation union select anchor, dst, depth + 1 from reach join contains_ on src = id where depth < 3)"""
_TRADE = """n as (select c_nationkey as a, s_nationkey as b, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2),
trade_ as (select 'N' || a as src, 'N' || b as dst from n where n * (select count(*) from n) * 10 > 15 * (select sum(n) from n))"""
_ENTRY = r"'^(?i:main|init|bootstrap|start|run|setup|configure)$|^(handle|on|process|execute|perform|dispatch|trigger|fire|emit)[A-Z]|Handler$|Controller$'"
_UTILITY = r"'^(get|set|is|has|can|should|will|did)[A-Z]|^_|^(?i:format|parse|validate|convert|transform)|^(?i:log|debug|error|warn|info)$|^(to|from)[A-Z]|^(?i:encode|decode|serialize|deserialize|clone|copy|deep|merge|extend|assign|filter|map|reduce|sort|find)|Helper$|Utils?$|^(?i:utils?|helpers?)$'"

ORACLE = {
    "bfs_downstream": f"""with recursive {CONTAINS_SQL}, reach(id, depth) as (select 'World:0', 0 union select dst, depth + 1 from reach join contains_ on src = id where depth < 4)
        select id, min(depth) as depth from reach group by 1""",
    "bfs_upstream": """select 'Customer:' || o_custkey as id, 1 as depth from orders union select 'Nation:' || c_nationkey, 2 from orders join customer on o_custkey = c_custkey
        union select 'Region:' || n_regionkey, 3 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey union select 'World:0', 4 from orders""",
    "bfs_cyclic": f"""with recursive {SUPPLIES_SQL}, u as (select src, dst from supplies_ union all select dst, src from supplies_),
        reach(id, depth) as (select 'Supplier:0', 0 union select dst, depth + 1 from reach join u on src = id where depth < 3) select id, min(depth) as depth from reach group by 1""",
    "impact_by_depth": _DOWN + " select anchor, depth, count(*) as n from reach where depth > 0 group by 1, 2",
    "impact_risk": f"""with {SUPPLIES_SQL}, r as (select 'Part:' || p_partkey as anchor, count(distinct l_suppkey) as n, count(distinct s_nationkey) as processes, count(distinct n_regionkey) as modules
          from part left join lineitem on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey group by 1)
        select anchor, n as direct, n as impacted, processes, modules, case when n = 0 then 'UNKNOWN' when n >= 30 or processes >= 5 or modules >= 5 then 'CRITICAL'
          when n >= 15 or processes >= 3 or modules >= 3 then 'HIGH' when n >= 5 then 'MEDIUM' else 'LOW' end as risk from r""",
    "impact_unknown": """select 'Supplier:' || s_suppkey as anchor, direction, case direction when 'upstream' then 'UNKNOWN' else 'LOW' end as risk, direction = 'upstream' as hedged
        from supplier, (values ('upstream'), ('downstream')) v(direction)""",
    "impact_page": _DOWN + " select anchor, id, depth from reach where depth > 0 qualify row_number() over (partition by anchor, depth order by id) between 11 and 40",
    "impact_ambiguous": f"""with {CURRENT_SQL}, c as (select name, id, count(*) over (partition by name) as candidates, row_number() over (partition by name order by id) as rank from cur where name is not null)
        select * from c where candidates > 1 and rank <= 20""",
    "confidence_floor": f"""with {CONTAINS_SQL}, {SUPPLIES_SQL}, e as (select *, case length(dst) % 3 when 0 then 0.0 when 1 then 0.7 end as c from (from contains_ union all from supplies_))
        select type, (case when c > 0 then c when type = 'CALLS' then 0.9 when type = 'CONTAINS' then 0.95 else 0.5 end)::double as used, count(*) as n from e group by 1, 2""",
    "shortest_path": f"""with recursive {CONTAINS_SQL}, u as (select src, dst from contains_ union all select dst, src from contains_),
        walk(id, path, hops) as (select 'Order:0', ['Order:0'], 0 union all select dst, list_append(path, dst), hops + 1 from walk join u on src = id where hops < 8 and not list_contains(path, dst))
        select true as found, hops, path from walk where id = 'Order:1' order by hops, path limit 1""",
    "path_1_to_5": f"""with recursive {CONTAINS_SQL}, walk(id, nodes, length) as (select 'World:0', 'World:0', 0 union all select dst, nodes || '>' || dst, length + 1 from walk join contains_ on src = id where length < 5)
        select id, length, nodes from walk where length > 0""",
    "path_two_hops_named": """select distinct 'Supplier:' || a.l_suppkey || '>Part:' || a.l_partkey || '>Order:1' as nodes, 2 as length
        from lineitem a join (select distinct l_partkey from lineitem where l_orderkey = 1) b using (l_partkey)""",
    "cycles_scc": f"""with recursive {_TRADE}, ids as (select src as id from trade_ union select dst from trade_),
        reach(a, b) as (select id, id from ids union select a, dst from reach join trade_ on src = b)
        select x.a as id, max(x.b) as component from reach x join reach y on x.a = y.b and x.b = y.a group by 1""",
    "closure_contains": f"""with recursive {CONTAINS_SQL},
        reach(src, dst) as (select src, dst from contains_ union select r.src, e.dst from reach r join contains_ e on e.src = r.dst) select * from reach""",
    "closure_subtypes": f"""with recursive {CONTAINS_SQL}, e as (select src, dst from contains_ where dst not like 'Order:%'),
        reach(src, dst) as (select src, dst from e union select r.src, e.dst from reach r join e on e.src = r.dst) select * from reach""",
    "flow_steps": "select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as step from events",
    "flow_heads": """select user_id, count(*) as steps, arg_min(event_type, struct_pack(t := ts, i := event_id)) as first_type, arg_max(event_type, struct_pack(t := ts, i := event_id)) as last_type
        from events group by 1""",
    "query_process_cards": """with f as (select event_id::varchar as id, user_id as process, value as score, row_number() over (partition by user_id order by ts, event_id) as step from events)
        select process, id, step, score, true as with_content from f qualify row_number() over (partition by process order by score desc, step, id) <= 5""",
    "entry_point_score": f"""with {CURRENT_SQL} select id, round(case when complexity - 1 = 0 then 0 else (complexity - 1) / (coalesce(sloc, 0) % 5 + 1) * case when is_exported then 2 else 1 end
          * case when regexp_matches(name, {_UTILITY}) then 0.3 when regexp_matches(name, {_ENTRY}) then 1.5 else 1 end end::double, 6) as score
        from cur where label in ('Function', 'Method') and complexity is not null""",
}
