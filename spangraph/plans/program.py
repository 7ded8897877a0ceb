"""Type hierarchies, flow graphs, dependences and taint, over graphs derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import hierarchy as hi
from ..operators import pdg
from ..operators.resolution import best_candidate, evidence_score, innermost, reference_edges
from ..runtime import materialise, table
from .projection import CURRENT_SQL, contains, current_nodes


def _parents(s, d) -> DataFrame:
    """Customers extend their nation, nations their region, and regions the world."""
    e = contains(s, d).filter("dst not like 'Order:%'")
    return e.select(F.col("dst").alias("type"), F.col("src").alias("parent"), F.lit(0).alias("position"))


def mro_bfs(s, d):
    return hi.mro_breadth_first(_parents(s, d))


def mro_c3(s, d):
    return hi.mro_c3(_parents(s, d)).select("type", F.array_join("mro", ">").alias("mro"))


def dispatch_index(s, d):
    return hi.implementors(_parents(s, d)).select("super", F.size("types").alias("n"), F.element_at("types", 1).alias("first_type"))


def method_overrides(s, d):
    """Each customer's method of a name overrides that of its nation, else that of its region."""
    kinds = table(s, d, "customer").select(F.concat(F.lit("Customer:"), "c_custkey").alias("owner"), F.col("c_mktsegment").alias("name"))
    nation = table(s, d, "customer").filter("c_acctbal > 9000").select(F.concat(F.lit("Nation:"), "c_nationkey").alias("owner"), F.col("c_mktsegment").alias("name")).distinct()
    region = table(s, d, "region").select(F.concat(F.lit("Region:"), "r_regionkey").alias("owner"), F.explode(F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]))).alias("name"))
    m = kinds.unionByName(nation).unionByName(region).withColumn("id", F.concat_ws("#", "owner", "name"))
    i = table(s, d, "region").select(F.concat(F.lit("Region:"), "r_regionkey").alias("type"))
    return hi.overrides(m, _parents(s, d), i)


def injections(s, d):
    """Suppliers want anything of their region; customers provide themselves, qualified by segment."""
    region = table(s, d, "nation").select("n_nationkey", F.concat(F.lit("Region:"), "n_regionkey").alias("wanted"))
    c = table(s, d, "supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("Supplier:"), "s_suppkey").alias("id"), "wanted", F.when(F.col("s_acctbal") > 0, F.lit("BUILDING")).otherwise("MACHINERY").alias("qualifier"), F.lit(0.8).alias("confidence"))
    p = table(s, d, "customer").select(F.concat(F.lit("Customer:"), "c_custkey").alias("id"), F.concat(F.lit("Nation:"), "c_nationkey").alias("type"), F.col("c_mktsegment").alias("qualifier"))
    up = materialise(_parents(s, d).filter("type like 'Nation:%' or type like 'Region:%'"), "up")  # every round reads it again
    return hi.injection_counts(c, p, up)


def _cfg(s, d) -> DataFrame:
    """A flow graph for each order: its lines in turn; returned lines may leave, large quantities loop back."""
    li = table(s, d, "lineitem").select(F.concat(F.lit("Order:"), "l_orderkey").alias("fn_id"), "l_linenumber", "l_returnflag", "l_quantity").distinct()
    last = li.groupBy("fn_id").agg(F.max("l_linenumber").alias("last"))
    li = li.join(last, "fn_id")
    n, end = F.col("l_linenumber"), F.col("last") + 1
    nxt = li.select("fn_id", n.alias("src_block"), (n + 1).alias("dst_block"), F.when(F.col("l_returnflag") == "R", "cond-false").otherwise("seq").alias("kind"))
    out = li.filter("l_returnflag = 'R'").select("fn_id", n.alias("src_block"), end.alias("dst_block"), F.lit("cond-true").alias("kind"))
    loop = li.filter("l_quantity > 45 and l_linenumber > 1").select("fn_id", n.alias("src_block"), F.lit(1).alias("dst_block"), F.lit("loop-back").alias("kind"))
    enter = last.select("fn_id", F.lit(0).alias("src_block"), F.lit(1).alias("dst_block"), F.lit("seq").alias("kind"))
    return nxt.unionByName(out).unionByName(loop).unionByName(enter)


def block_facts(s, d):
    """Reverse post-order, dominators, post-dominators, frontiers and components of every order's graph."""
    f = pdg.block_facts(_cfg(s, d))
    return f.select("fn_id", "block", "position", "idom", "ipdom", F.array_join("frontier", ",").alias("frontier"), "component", "escape")


def control_dependence(s, d):
    return pdg.control_dependence(_cfg(s, d))


def _accesses(s, d) -> DataFrame:
    """Line n defines the part's brand as a variable and uses the last one of its size class."""
    li = table(s, d, "lineitem").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    v = F.concat(F.lit("v"), (F.col("p_size") % 3).cast("string"))
    base = li.select(F.concat(F.lit("Order:"), "l_orderkey").alias("fn_id"), F.col("l_linenumber").alias("block"), F.col("l_linenumber").cast("long").alias("line"), v.alias("variable")).distinct()
    return base.withColumns({"seq": F.lit(0), "kind": F.lit("use")}).unionByName(base.withColumns({"seq": F.lit(1), "kind": F.lit("def")}))


def reaching_defs(s, d):
    return pdg.reaching_definitions(_cfg(s, d), _accesses(s, d))


def straight_reaching_defs(s, d):
    """Reaching definitions of straight-line functions, which SQL can tell."""
    straight = _cfg(s, d).filter("kind in ('seq', 'cond-false')")
    return pdg.reaching_definitions(straight, _accesses(s, d)).select("fn_id", "variable", "def_line", "use_line")


def guard_clauses(s, d):
    blocks = table(s, d, "lineitem").select(F.concat(F.lit("Order:"), "l_orderkey").alias("fn_id"), F.col("l_linenumber").alias("block"), F.col("l_returnflag").alias("text")).distinct()
    g = pdg.guards(pdg.control_dependence(_cfg(s, d)), blocks)
    return g.select("fn_id", "guard", "text", F.array_join("guarded", ",").alias("guarded"))


def taint_within(s, d):
    """Returned lines are sources, lines shipped by the last day sinks, fully discounted ones sanitise; flows go line by line."""
    li = table(s, d, "lineitem").select(F.concat(F.lit("Order:"), "l_orderkey").alias("fn_id"), F.col("l_linenumber").cast("long").alias("line"), "l_returnflag", "l_linestatus", "l_discount").distinct()
    flows = li.select("fn_id", F.lit("v").alias("variable"), F.col("line").alias("def_line"), (F.col("line") + 1).alias("use_line"))
    src = li.filter("l_returnflag = 'R'").select("fn_id", "line", F.array(F.lit("sql"), F.lit("path")).alias("kinds"))
    snk = li.filter("l_linestatus = 'O'").select("fn_id", "line", F.lit("sql").alias("kind")).distinct()
    san = li.filter("l_discount >= 0.08").select("fn_id", "line", F.array(F.lit("sql")).alias("kinds"))
    return pdg.taint_within(flows, src, snk, san)


def taint_paths(s, d):
    """Taint of each region's first order customers along nations that trade much; the packed path of each finding."""
    t = table(s, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("fn"), F.concat(F.lit("R"), "n_regionkey").alias("source"))
    from .graph import _trade

    calls = materialise(_trade(s, d).select(F.col("src").alias("fn"), F.lit(0).alias("param"), F.col("dst").alias("callee"), F.lit(0).alias("callee_param")), "calls")
    sinks = t.select("fn", F.lit(0).alias("param"), F.lit("sql").alias("kind"), F.concat(F.lit("sink@"), "fn").alias("sink"))
    found = pdg.taint_across(t.select("source", "fn", F.lit(0).alias("param")), calls, sinks)
    hops = F.array(F.struct(F.col("source").alias("name"), F.lit(1).alias("line"), F.lit(False).alias("via_call")), F.struct(F.col("fn").alias("name"), (F.col("depth") + 1).alias("line"), (F.col("depth") > 0).alias("via_call")))
    return found.select("source", "fn", "depth", codecs.encode_path(hops, F.col("kind")).alias("reason"))


def codec_round_trip(s, d):
    """All three codecs, there and back, over every line item."""
    li = table(s, d, "lineitem")
    hops = F.array(F.struct(F.col("l_returnflag").alias("name"), F.col("l_linenumber").cast("int").alias("line"), (F.col("l_linestatus") == "F").alias("via_call")))
    pairs = F.array(F.struct(F.col("l_linenumber").cast("int").alias("def_line"), F.col("l_quantity").cast("int").alias("use_line")))
    path, reach, call = codecs.encode_path(hops, F.lit("sql")), codecs.encode_reaching(F.lower("l_linestatus"), pairs), codecs.encode_summary(F.array(F.col("l_linenumber").cast("int"), F.lit(40)))
    rows = li.select("l_returnflag", path.alias("path"), reach.alias("reach"), call.alias("call"))
    back = rows.select("path", "reach", "call", codecs.decode_path(F.col("path")).alias("p"), codecs.decode_reaching(F.col("reach")).alias("r"), codecs.decode_summary(F.col("call")).alias("c"))
    return back.groupBy("path", "reach", "call").agg(F.count("*").alias("n"), F.first(F.col("p.hops")[0]["line"]).alias("line"), F.first(F.col("r.pairs")[0]["use_line"]).alias("use_line"), F.first(F.element_at("c", 1)).alias("param"))


def reference_edges_by_kind(s, d):
    """Edges of references that stand for line items: kind by flag, caller and target by supplier and part."""
    kind = F.when(F.col("l_returnflag") == "R", "read").when(F.col("l_returnflag") == "A", "write").when(F.col("l_linestatus") == "O", "call").otherwise("import-use")
    ref = table(s, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("caller"), F.concat(F.lit("P"), "l_partkey").alias("target"), kind.alias("kind"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("col"))
    return reference_edges(ref, collapse=True).groupBy("type", "step").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


def innermost_scope(s, d):
    """The smallest symbol that holds the first line of each class."""
    n = current_nodes(s, d).filter("start_line is not null and end_line is not null")
    spans = n.filter("label in ('Class', 'Interface', 'Method', 'Function', 'File')").select(F.concat_ws("/", "repo", "file_path").alias("file"), "id", "start_line", "end_line")
    at = n.filter("label = 'Class'").select(F.col("id").alias("ref"), F.concat_ws("/", "repo", "file_path").alias("file"), F.col("start_line").alias("line"))
    return innermost(at, spans)


def candidate_choice(s, d):
    """The best supplier of each part by evidence from its line items."""
    ev = table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_linenumber").alias("scope_depth"), F.count("*").alias("n"), F.min("l_linenumber").alias("mro_depth"))
    w = F.array(F.struct(F.lit("local").alias("kind"), (F.col("n") * 0.25).alias("weight")), F.struct(F.lit("scope").alias("kind"), (F.col("scope_depth") * -0.02).alias("weight")))
    c = ev.select(F.col("l_partkey").alias("ref"), F.col("l_suppkey").alias("id"), evidence_score(w).alias("confidence"), "scope_depth", "mro_depth", F.lit(0).alias("origin"))
    return best_candidate(c).select("ref", "id", F.round("confidence", 3).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in [
        mro_bfs, mro_c3, dispatch_index, method_overrides, injections, block_facts, control_dependence, reaching_defs, straight_reaching_defs, guard_clauses, taint_within, taint_paths,
        codec_round_trip, reference_edges_by_kind, innermost_scope, candidate_choice,
    ]
}

_UP = """up as (
  select 'Customer:' || c_custkey as type, 'Nation:' || c_nationkey as p1, 'Region:' || n_regionkey as p2, 'World:0' as p3 from customer join nation on c_nationkey = n_nationkey union all
  select 'Nation:' || n_nationkey, 'Region:' || n_regionkey, 'World:0', null from nation union all select 'Region:' || r_regionkey, 'World:0', null, null from region)"""

CFG_SQL = """li as (select distinct 'Order:' || l_orderkey as fn, l_linenumber as n, l_returnflag as f, l_quantity as q from lineitem),
la as (select fn, max(n) as last_ from li group by 1),
cfg as (
  select fn, n as a, n + 1 as b, case when f = 'R' then 'cond-false' else 'seq' end as kind from li union select fn, n, last_ + 1, 'cond-true' from li join la using (fn) where f = 'R'
  union select fn, n, 1, 'loop-back' from li where q > 45 and n > 1 union select fn, 0, 1, 'seq' from la),
blocks as (select fn, a as b from cfg union select fn, b from cfg)"""
_DEPENDS = f"""{CFG_SQL}, exits as (select fn, b from blocks where (fn, b) not in (select fn, a from cfg)),
t(fn, r, b) as (select e.fn, k.b, e.b from exits e join blocks k on k.fn = e.fn and k.b <> e.b union select t.fn, t.r, c.a from t join cfg c on c.fn = t.fn and c.b = t.b where c.a <> t.r),
pd as (select x.fn, x.b as x, y.b from blocks x join blocks y using (fn) where x.b = y.b or not exists (select 1 from t where t.fn = x.fn and t.r = x.b and t.b = y.b)),
cd as (select distinct c.fn as fn_id, c.a as src_block, p.x as dst_block, case kind when 'cond-true' then 'T' when 'cond-false' then 'F' else kind end as label from cfg c join pd p on p.fn = c.fn and p.b = c.b
  where not exists (select 1 from pd q where q.fn = c.fn and q.b = c.a and q.x = p.x and q.x <> c.a))"""

ORACLE = {
    "control_dependence": f"with recursive {_DEPENDS} select * from cd",
    "guard_clauses": f"""with recursive {_DEPENDS}, b as (select distinct 'Order:' || l_orderkey as fn_id, l_linenumber as src_block, l_returnflag as text from lineitem)
        select fn_id, src_block as guard, text, array_to_string(list_sort(list_distinct(list(dst_block))), ',') as guarded from cd join b using (fn_id, src_block) group by 1, 2, 3""",
    "reaching_defs": f"""with recursive {CFG_SQL}, v as (select distinct 'Order:' || l_orderkey as fn, l_linenumber as b, 'v' || (p_size % 3) as variable from lineitem join part on l_partkey = p_partkey),
        r(fn, variable, d, b) as (select v.fn, v.variable, v.b, c.b from v join cfg c on c.fn = v.fn and c.a = v.b
          union select r.fn, r.variable, r.d, c.b from r join cfg c on c.fn = r.fn and c.a = r.b where not exists (select 1 from v where v.fn = r.fn and v.b = r.b and v.variable = r.variable))
        select r.fn as fn_id, r.variable, r.d as def_block, r.d::bigint as def_line, r.b as use_block, r.b::bigint as use_line from r join v on v.fn = r.fn and v.b = r.b and v.variable = r.variable""",
    "mro_bfs": f"with {_UP} select type, p1 as ancestor, 1 as position from up union all select type, p2, 2 from up where p2 is not null union all select type, p3, 3 from up where p3 is not null",
    "mro_c3": f"with {_UP} select type, concat_ws('>', type, p1, p2, p3) as mro from up",
    "dispatch_index": f"with {_UP}, a as (select p1 as super, type from up union all select p2, type from up where p2 is not null union all select p3, type from up where p3 is not null) select super, count(*)::int as n, min(type) as first_type from a group by 1",
    "method_overrides": """with c as (select 'Customer:' || c_custkey as o, c_mktsegment as m, 'Nation:' || c_nationkey as n, 'Region:' || n_regionkey as r from customer join nation on c_nationkey = n_nationkey),
        na as (select distinct 'Nation:' || c_nationkey as o, c_mktsegment as m, 'Region:' || n_regionkey as r from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9000)
        select c.o || '#' || c.m as src, case when na.o is not null then na.o || '#' || c.m else c.r || '#' || c.m end as dst, case when na.o is not null then 'METHOD_OVERRIDES' else 'METHOD_IMPLEMENTS' end as type
        from c left join na on na.o = c.n and na.m = c.m union all select o || '#' || m, r || '#' || m, 'METHOD_IMPLEMENTS' from na""",
    "injections": """with x as (select 'Supplier:' || s_suppkey as src, 'Customer:' || c_custkey as dst from supplier join nation a on s_nationkey = a.n_nationkey join nation b on b.n_regionkey = a.n_regionkey
          join customer on c_nationkey = b.n_nationkey and c_mktsegment = case when s_acctbal > 0 then 'BUILDING' else 'MACHINERY' end) select src, count(*) as n, min(dst) as first_dst from x group by 1""",
    "straight_reaching_defs": """with a as (select distinct 'Order:' || l_orderkey as fn_id, l_linenumber as line, 'v' || (p_size % 3) as variable from lineitem join part on l_partkey = p_partkey),
        last_ as (select 'Order:' || l_orderkey as fn_id, max(l_linenumber) as n, count(distinct l_linenumber) as k from lineitem group by 1)
        select u.fn_id, u.variable, d.line as def_line, u.line as use_line from a u join a d on u.fn_id = d.fn_id and u.variable = d.variable and d.line < u.line
        where not exists (select 1 from a m where m.fn_id = u.fn_id and m.variable = u.variable and m.line > d.line and m.line < u.line)
          and not exists (select 1 from generate_series(d.line, u.line - 1) g(x) where not exists (select 1 from lineitem l where 'Order:' || l.l_orderkey = u.fn_id and l.l_linenumber = x))""",
    "taint_within": """with recursive li as (select distinct 'Order:' || l_orderkey as fn_id, l_linenumber as line, l_returnflag as f, l_linestatus as st, l_discount as di from lineitem),
        t(fn_id, source_line, line) as (select distinct fn_id, line, line from li where f = 'R'
          union select t.fn_id, t.source_line, t.line + 1 from t join (select distinct fn_id, line from li) x on x.fn_id = t.fn_id and x.line = t.line
            where not exists (select 1 from li c where c.fn_id = t.fn_id and c.line = t.line + 1 and c.di >= 0.08))
        select distinct t.fn_id, source_line, t.line as sink_line, 'sql' as kind, (t.line - source_line)::int as hops from t join li on li.fn_id = t.fn_id and li.line = t.line and st = 'O' where t.line > source_line""",
    "taint_paths": """with recursive n as (select c_nationkey as a, s_nationkey as b, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2),
        e as (select 'N' || a as src, 'N' || b as dst from n where n * (select count(*) from n) * 10 > 15 * (select sum(n) from n)),
        t(source, fn, depth) as (select 'R' || n_regionkey, 'N' || n_nationkey, 0 from nation union select source, dst, depth + 1 from t join e on src = fn where depth < 25),
        m as (select source, fn, min(depth) as depth from t group by 1, 2)
        select source, fn, depth, '1;sql|' || source || ':1|' || fn || ':' || (depth + 1) || case when depth > 0 then ':c' else '' end as reason from m""",
    "codec_round_trip": """select '1;sql|' || l_returnflag || ':' || l_linenumber || case when l_linestatus = 'F' then ':c' else '' end as path, lower(l_linestatus) || '|1:' || l_linenumber || ':' || l_quantity::int as reach,
        '1|r:' || lower(hex((1::bigint << l_linenumber) | (1::bigint << 40))) as call, count(*) as n, min(l_linenumber)::int as line, min(l_quantity::int)::int as use_line, min(l_linenumber)::int as param from lineitem group by 1, 2, 3""",
    "reference_edges_by_kind": """with r as (select l_suppkey as a, l_partkey as b, case when l_returnflag in ('R', 'A') then 'ACCESSES' when l_linestatus = 'O' then 'CALLS' end as type,
          case l_returnflag when 'R' then 1 when 'A' then 2 end as step, l_orderkey as line, l_linenumber as col from lineitem),
        f as (select * from r where type is not null qualify row_number() over (partition by type, a, b order by line, col, step nulls last) = 1) select type, step, count(*) as n, sum(line)::bigint as lines from f group by 1, 2""",
    "innermost_scope": f"""with {CURRENT_SQL}, s as (select id, label, concat_ws('/', repo, file_path) as file, start_line, end_line from cur where start_line is not null and end_line is not null)
        select a.id as ref, arg_min(b.id, struct_pack(w := b.end_line - b.start_line, i := b.id)) as id from s a join s b on a.file = b.file and a.start_line between b.start_line and b.end_line
        where a.label = 'Class' and b.label in ('Class', 'Interface', 'Method', 'Function', 'File') group by 1""",
    "candidate_choice": """with e as (select l_partkey as ref, l_suppkey as id, max(l_linenumber) as sd, count(*) as n, min(l_linenumber) as md from lineitem group by 1, 2),
        c as (select *, round(least(greatest(n * 0.25::double + sd * -0.02::double, 0), 1), 3) as confidence from e)
        select ref, id, confidence from c qualify row_number() over (partition by ref order by confidence desc, sd, md, id) = 1""",
}
