"""Contracts, routes, differences between states, and refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contracts as co
from ..operators import diff as df
from ..operators import routes as ro
from ..operators.incremental import VersionedState, clean_hash, content_hash, current, latest
from ..operators.resolution import overlapping, suffix_lookup
from ..operators.windows import first_wins
from ..runtime import materialise, table, working_path
from ..streaming import event_windows, refresh, sessions
from .projection import CURRENT_SQL, current_nodes

# ---- contracts: routes provide http, methods grpc and functions thrift; clients of other repositories consume them


def _contracts(s, d) -> DataFrame:
    n = current_nodes(s, d).filter("file_path is not null and name is not null")
    service = F.concat_ws(".", F.get(F.split("file_path", "/"), F.lit(0)), F.get(F.split("file_path", "/"), F.lit(1)))
    bare = F.get(F.split("file_path", "/"), F.lit(1))
    method, path = F.substring_index("content", " ", 1), F.substring_index("content", " ", -1)
    r, m, f = n.filter("label = 'Route'"), n.filter("label = 'Method'"), n.filter("label = 'Function'")

    def rows(t, kind, role, repo, ident, confidence):
        return t.select(ident.alias("contract_id"), F.lit(kind).alias("type"), F.lit(role).alias("role"), repo.alias("repo"), F.lit(None).cast("string").alias("service"), F.col("id").alias("symbol_uid"), "file_path", F.col("name").alias("symbol_name"), F.lit(confidence).alias("confidence"), F.lit("{}").alias("meta"))

    own, client = F.col("repo"), F.concat(F.lit("client-"), F.col("repo"))
    out = rows(r, "http", "provider", own, F.concat(F.lit("http::"), method, F.lit("::"), path), 0.9)
    out = out.unionByName(rows(r, "http", "consumer", client, F.concat(F.lit("http::"), F.lower(method), F.lit("::"), path, F.lit("/")), 0.8))
    out = out.unionByName(rows(r.filter("cohesion is null"), "http", "consumer", client, F.concat(F.lit("http::*::"), path), 0.7))
    out = out.unionByName(rows(m, "grpc", "provider", own, F.concat(F.lit("grpc::"), service, F.lit("/"), F.col("name")), 0.95))
    out = out.unionByName(rows(m.filter("is_exported"), "grpc", "consumer", client, F.concat(F.lit("grpc::"), F.initcap(bare), F.lit("/*")), 0.6))
    out = out.unionByName(rows(m.filter("not is_exported"), "grpc", "consumer", client, F.concat(F.lit("grpc::"), F.upper(service), F.lit("/*")), 0.97))
    out = out.unionByName(rows(f, "thrift", "provider", own, F.concat(F.lit("thrift::"), service, F.lit("/"), F.col("name")), 0.9))
    return out.unionByName(rows(f, "thrift", "consumer", client, F.concat(F.lit("thrift::"), bare, F.lit("/"), F.col("name")), 0.5))


def contract_normalise(s, d):
    return _contracts(s, d).select("contract_id", co.normalise(F.col("contract_id")).alias("normalised"), co.service_wildcard(F.col("contract_id")).alias("wildcard")).distinct()


_LINK = ["contract_id", "type", "match_type", "confidence", "from_repo", "from_symbol", "to_repo", "to_symbol"]


def contract_exact(s, d):
    return co.exact_links(materialise(_contracts(s, d), "contracts")).select(*_LINK).distinct()


def contract_wildcard(s, d):
    return co.wildcard_links(materialise(_contracts(s, d), "contracts")).groupBy("contract_id", "from_repo").agg(F.count("*").alias("links"), F.countDistinct("to_symbol").alias("methods"), F.max("confidence").alias("confidence"))


def contract_unmatched(s, d):
    c = materialise(_contracts(s, d), "contracts")
    return co.unmatched(c, co.exact_links(c).unionByName(co.wildcard_links(c))).distinct()


def contract_dedupe(s, d):
    """One contract for each name of a repository's nodes, from all versions of them."""
    v = table(s, d, "nodes").filter("label in ('Function', 'Method', 'Class') and name is not null and repo is not null")
    rows = v.select(
        F.concat(F.lit("lib::"), "name").alias("contract_id"), "repo", F.col("id").alias("symbol_uid"), "file_path", F.col("description").alias("symbol_name"), F.lit(None).cast("string").alias("service"),
        F.lit("{}").alias("meta"), (F.coalesce("complexity", F.lit(0)) / 20).alias("confidence"), F.concat_ws("|", "id", F.col("indexed_at").cast("string"), "description").alias("seq"),
    )
    out = co.dedupe_contracts(rows, ["contract_id", "repo"], "seq")
    return out.select("contract_id", "repo", "symbol_uid", "symbol_name", "confidence")


# ---- routes


def _routes(s, d) -> DataFrame:
    n = current_nodes(s, d).filter("label = 'Route'")
    return n.select("id", "repo", F.substring_index("content", " ", 1).alias("method"), F.substring_index("content", " ", -1).alias("path"), "response_keys", "error_keys", "middleware", "step_count")


def route_normalise(s, d):
    r = _routes(s, d)
    url = ro.route_path(F.concat(F.lit("/"), "path", F.lit("//")), F.concat(F.lit("/api/"), F.lower(F.col("method"))))
    return r.select("id", url.alias("url"), ro.route_key(ro.route_method(F.concat(F.lit(" "), F.lower("method"))), url).alias("key"), ro.fetch_url(F.concat(F.lit("`${base}/v1"), F.regexp_replace("path", r"\{(\w+)\}", r"\${$1}"), F.lit("?x=${q}`"))).alias("fetched"))


def route_match(s, d):
    """Every route's concrete and templated fetches with the routes they match."""
    r = _routes(s, d).select("id", F.regexp_replace("path", r"\{(\w+)\}", r"[$1]").alias("route"))
    f = r.select(F.col("id").alias("fetch_id"), F.regexp_replace("route", r"\[\w+\]", "42").alias("url"))
    f = f.unionByName(r.select(F.col("id").alias("fetch_id"), F.regexp_replace("route", r"\[\w+\]", "[param]").alias("url")))
    return ro.match_fetches(f, r).select("fetch_id", "url", "id", "route")


def middleware_match(s, d):
    m = s.createDataFrame([("/section/:path*",), ("/(path|edge)/.*",), ("/index/{window}",)], "matcher string")
    r = _routes(s, d).select("id", "path")
    return r.join(F.broadcast(m), ro.matcher_hits(F.col("path"), F.col("matcher"))).select("id", "matcher")


def _consumers(s, d) -> DataFrame:
    r = _routes(s, d).select(F.col("id").alias("route"), F.concat(F.lit("client:"), "id").alias("consumer"), F.concat(F.coalesce("response_keys", F.array().cast("array<string>")), F.coalesce("middleware", F.array().cast("array<string>")), F.coalesce("error_keys", F.array().cast("array<string>"))).alias("k"), "step_count")
    reason = F.concat(F.lit("fetch-url-match|keys:"), F.array_join("k", ","), F.lit("|fetches:"), F.coalesce(F.col("step_count"), F.lit(1)).cast("string"))
    keys, n = ro.fetch_reason(reason)
    return r.select("route", "consumer", keys.alias("keys"), n.alias("fetches"))


def shape_mismatch(s, d):
    return ro.shape_check(_routes(s, d).select(F.col("id").alias("route"), "response_keys", "error_keys"), _consumers(s, d))


def api_impact(s, d):
    return ro.api_impact(_routes(s, d).select(F.col("id").alias("route"), "response_keys", "error_keys"), _consumers(s, d))


# ---- differences between the state at half time and the current one


def _states(s, d) -> tuple[DataFrame, DataFrame]:
    nodes = table(s, d, "nodes").filter("id is not null")
    t = nodes.agg(F.min("indexed_at").alias("a"), F.max("indexed_at").alias("b")).first()
    half = t.a + (t.b - t.a) / 2
    half = half.replace(microsecond=0)
    order = [F.desc_nulls_last("indexed_at"), F.asc_nulls_last("content"), F.asc_nulls_last("name"), F.asc_nulls_last("complexity")]
    return first_wins(nodes.filter(F.col("indexed_at") <= F.lit(str(half)).cast("timestamp_ntz")), ["id"], order), current_nodes(s, d)


def hash_diff(s, d):
    old, new = (x.select("id", content_hash(F.col("content"), F.col("description"), F.col("complexity")).alias("h")) for x in _states(s, d))
    return df.hash_diff(old, new, "id", "h")


def hash_diff_back(s, d):
    """The other way round: what is new now is deleted then."""
    old, new = (x.select("id", F.sha2("content", 256).alias("h")) for x in _states(s, d))
    return df.hash_diff(new, old, "id", "h")


def record_diff(s, d):
    old, new = _states(s, d)
    r = df.record_diff(old, new, "id", ["content", "description", "complexity", "is_exported"])
    return r.select("id", "change", F.array_join("columns", ",").alias("columns"))


def definition_diff(s, d):
    def defs(x):
        x = x.filter("label in ('Function', 'Method', 'Class')")
        return x.select(F.concat_ws("/", "repo", "file_path").alias("file"), F.col("id").alias("key"), "label", F.lit(None).cast("string").alias("owner"), "name", F.coalesce("description", F.lit("")).alias("signature"), F.lit(0).alias("param_count"), "is_exported", F.coalesce("content", F.lit("")).alias("text"))

    old, new = _states(s, d)
    return df.definition_diff(defs(old), defs(new)).select("file", "change", "label", "name", "breaking")


def write_set_expand(s, d):
    """Nations whose rows have to be written again when one region changes, over the edges of large orders."""
    c = table(s, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_nationkey").alias("file"))
    p = table(s, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("file"))
    o = table(s, d, "orders").filter("o_totalprice > 480000").select("o_orderkey", "o_custkey")
    e = table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), F.lit("CALLS").alias("type")).distinct()
    changed = table(s, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("file"))
    return df.write_set(e, c.unionByName(p), changed)


def write_set_all(s, d):
    """The same over the edges of all orders."""
    c = table(s, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_nationkey").alias("file"))
    p = table(s, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("file"))
    e = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), F.lit("CALLS").alias("type"))
    changed = table(s, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("file"))
    return df.write_set(e, c.unionByName(p), changed)


def subgraph_extract(s, d):
    nodes = table(s, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_nationkey").alias("file_path"))
    e = table(s, d, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("O"), "o_orderkey").alias("dst"))
    _, touch = df.subgraph(nodes, e, table(s, d, "nation").filter("n_regionkey = 3").select(F.col("n_nationkey").alias("file")))
    return touch.groupBy("src").agg(F.count("*").alias("n"))


def reconcile(s, d):
    """Stored rows are all versions: what isn't there exactly once as expected."""
    return df.reconcile(current_nodes(s, d), table(s, d, "nodes").filter("id is not null"), "id", ["name", "complexity"])


def embedding_reuse(s, d):
    """Nodes whose latest delivery still has the hash of the delivery before the last successful run's start, by run."""
    m = table(s, d, "cached_embedding_meta").filter("node_id is not null and content_hash is not null").select("node_id", clean_hash(F.col("content_hash")).alias("content_hash"), "chunk_index", "run_id")
    half = m.agg(F.max("run_id").alias("r")).first().r // 2
    now = first_wins(m.filter(F.col("run_id") > half), ["node_id"], [F.desc("run_id"), F.asc("content_hash")]).select(F.col("node_id").alias("id"), "content_hash")
    kept, missing = df.reusable(now, m.filter(F.col("run_id") <= half))
    a = kept.select(F.col("node_id").alias("id")).distinct().withColumn("state", F.lit("reused"))
    return a.unionByName(missing.select("id").withColumn("state", F.lit("missing")))


def hunk_symbol_overlap(s, d):
    """Symbols that the chunks of embeddings touch, file by file."""
    n = current_nodes(s, d).filter("label in ('Function', 'Method', 'Class') and start_line is not null and end_line is not null")
    sym = n.select("id", F.concat_ws("/", "repo", "file_path").alias("file"), "start_line", "end_line")
    h = n.filter("label = 'Class'").select(F.col("id").alias("hunk_id"), F.concat_ws("/", "repo", "file_path").alias("file"), "start_line", "end_line")
    return overlapping(h, sym)


def path_suffix_match(s, d):
    paths = table(s, d, "why_ignored_result").filter("path is not null").select("path").distinct()
    want = paths.select(F.array_join(F.slice(F.split("path", "/"), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1)), 2), "/").alias("tail"))
    return suffix_lookup(paths, want)


# ---- streams


def stream_refresh(s, d):
    """The delivery log as a stream of files into a state: the final state of every node."""
    log = table(s, d, "cached_embedding_meta")
    stream = s.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/cached_embedding_meta.parquet*")
    stream = stream.select("node_id", "cached_at", "cache_row_id", clean_hash(F.col("content_hash")).alias("content_hash"))
    state = VersionedState(s, working_path(s, "stream-state"))
    seen = working_path(s, "stream-changes")
    q = refresh(stream, state, lambda c, n, full: c.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{seen}/{n}"), key="node_id", stamp=["cached_at", "cache_row_id"], hash_="content_hash", checkpoint=working_path(s, "stream-checkpoint"), available_now=True)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    now = current(state, state.manifest(), latest(log.withColumn("content_hash", clean_hash(F.col("content_hash"))), "node_id", ["cached_at", "cache_row_id"], "content_hash"), "node_id")
    return now.select("node_id", F.col("now.cache_row_id").alias("cache_row_id"), F.col("now.content_hash").alias("content_hash"))


def events_hourly(s, d):
    w = event_windows(table(s, d, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(s, d):
    w = sessions(table(s, d, "events"), "2 hours")
    return w.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in [
        contract_normalise, contract_exact, contract_wildcard, contract_unmatched, contract_dedupe, route_normalise, route_match, middleware_match, shape_mismatch, api_impact,
        hash_diff, hash_diff_back, record_diff, definition_diff, write_set_expand, write_set_all, subgraph_extract, reconcile, embedding_reuse, hunk_symbol_overlap, path_suffix_match,
        stream_refresh, events_hourly, user_sessions,
    ]
}

_CONTRACTS = CURRENT_SQL + """,
nn as (select *, split_part(file_path, '/', 1) || '.' || split_part(file_path, '/', 2) as service, split_part(file_path, '/', 2) as bare, split_part(content, ' ', 1) as method, split_part(content, ' ', -1) as path
  from cur where file_path is not null and name is not null),
contracts(contract_id, type, role, repo, symbol, confidence, key) as (
  select 'http::' || method || '::' || path, 'http', 'provider', repo, id, 0.9, 'http::' || method || '::' || path from nn where label = 'Route' union all
  select 'http::' || lower(method) || '::' || path || '/', 'http', 'consumer', 'client-' || repo, id, 0.8, 'http::' || method || '::' || path from nn where label = 'Route' union all
  select 'http::*::' || path, 'http', 'consumer', 'client-' || repo, id, 0.7, 'http::*::' || path from nn where label = 'Route' and cohesion is null union all
  select 'grpc::' || service || '/' || name, 'grpc', 'provider', repo, id, 0.95, 'grpc::' || lower(service) || '/' || name from nn where label = 'Method' union all
  select 'grpc::' || upper(bare[1:1]) || lower(bare[2:]) || '/*', 'grpc', 'consumer', 'client-' || repo, id, 0.6, 'grpc::' || lower(bare) || '/*' from nn where label = 'Method' and is_exported union all
  select 'grpc::' || upper(service) || '/*', 'grpc', 'consumer', 'client-' || repo, id, 0.97, 'grpc::' || lower(service) || '/*' from nn where label = 'Method' and not is_exported union all
  select 'thrift::' || service || '/' || name, 'thrift', 'provider', repo, id, 0.9, 'thrift::' || lower(service) || '/' || name from nn where label = 'Function' union all
  select 'thrift::' || bare || '/' || name, 'thrift', 'consumer', 'client-' || repo, id, 0.5, 'thrift::' || lower(bare) || '/' || name from nn where label = 'Function'),
p as (select * from contracts where role = 'provider'), c as (select * from contracts where role = 'consumer'),
bare_hits as (
  select c.*, p.repo as p_repo, p.symbol as p_symbol, p.key as p_key, p.contract_id as p_id from c join p on c.type = 'thrift' and p.type = 'thrift' and ends_with(p.key, '.' || substr(c.key, 9)) and not contains(split_part(substr(c.key, 9), '/', 1), '.')
  where not exists (select 1 from p x where x.key = c.key)),
exact_ as (
  select c.contract_id, c.type, 'exact' as match_type, 1.0::double as confidence, c.repo as from_repo, c.symbol as from_symbol, p.repo as to_repo, p.symbol as to_symbol, p.contract_id as p_id
  from c join p on c.key = p.key or (c.type = 'http' and p.type = 'http' and split_part(c.key, '::', 3) = split_part(p.key, '::', 3) and (split_part(c.key, '::', 2) = '*' or split_part(p.key, '::', 2) = '*'))
  where not ends_with(c.key, '/*') and c.repo <> p.repo union all
  select contract_id, type, 'exact', 1.0, repo, symbol, p_repo, p_symbol, p_id from bare_hits where key in (select key from bare_hits group by 1 having count(distinct p_key) = 1) and repo <> p_repo),
wild_ as (
  select c.contract_id, c.type, 'wildcard' as match_type, least(c.confidence, p.confidence)::double as confidence, c.repo as from_repo, c.symbol as from_symbol, p.repo as to_repo, p.symbol as to_symbol, p.contract_id as p_id
  from c join p on c.type = 'grpc' and p.type = 'grpc' and (starts_with(p.key, rtrim(c.key, '*')) or (not contains(c.key, '.') and ends_with(split_part(p.key, '/', 1), '.' || rtrim(substr(c.key, 7), '/*'))))
  where ends_with(c.key, '/*') and c.repo <> p.repo)
"""
_ROUTES = CURRENT_SQL + ", r as (select id, repo, split_part(content, ' ', 1) as method, split_part(content, ' ', -1) as path, response_keys, error_keys, middleware, step_count from cur where label = 'Route')"
_SHAPE = _ROUTES + """, sh as (
  select id as route, 'client:' || id as consumer, step_count, list_sort(list_distinct(list_filter(coalesce(middleware, []), lambda k: not list_contains(list_concat(coalesce(response_keys, []), coalesce(error_keys, [])), k)))) as missing
  from r where response_keys is not null)"""
_STATES = CURRENT_SQL + """, half as (select date_trunc('second', min(indexed_at) + (max(indexed_at) - min(indexed_at)) / 2) as t from nodes where id is not null),
old as (select * from nodes, half where id is not null and indexed_at <= t qualify row_number() over (partition by id order by indexed_at desc nulls last, content nulls last, name nulls last, complexity nulls last) = 1)"""

ORACLE = {
    "contract_normalise": f"with {_CONTRACTS} select distinct contract_id, key as normalised, ends_with(contract_id, '/*') as wildcard from contracts",
    "contract_exact": f"with {_CONTRACTS} select distinct contract_id, type, match_type, confidence, from_repo, from_symbol, to_repo, to_symbol from exact_",
    "contract_wildcard": f"with {_CONTRACTS} select contract_id, from_repo, count(*) as links, count(distinct to_symbol) as methods, max(confidence) as confidence from wild_ group by 1, 2",
    "contract_unmatched": f"""with {_CONTRACTS}, used as (select 'consumer' as role, from_repo as repo, contract_id from (from exact_ union all from wild_) union select 'provider', to_repo, p_id from (from exact_ union all from wild_))
        select distinct role, repo, contract_id from contracts x where not exists (select 1 from used u where u.role = x.role and u.repo = x.repo and u.contract_id = x.contract_id)""",
    "contract_dedupe": """with v as (select 'lib::' || name as contract_id, repo, id as symbol_uid, description as symbol_name, coalesce(complexity, 0) / 20 as confidence,
          concat_ws('|', id, strftime(indexed_at, '%Y-%m-%d %H:%M:%S'), description) as seq, case when coalesce(description, '') not in ('', 'lib::' || name) then 4 else 0 end as rich
          from nodes where label in ('Function', 'Method', 'Class') and name is not null and repo is not null)
        select contract_id, repo, arg_max(symbol_uid, struct_pack(r := rich, s := -k)) as symbol_uid, arg_min(symbol_name, k) filter (coalesce(symbol_name, '') <> '') as symbol_name, max(confidence) as confidence
        from (select *, row_number() over (partition by contract_id, repo order by rich desc, seq) as k from v) group by 1, 2""",
    "route_normalise": f"""with {_ROUTES} select id, '/api/' || lower(method) || '/' || ltrim(path, '/') as url, method || ' /api/' || lower(method) || '/' || ltrim(path, '/') as key,
        '/v1' || regexp_replace(path, '\\{{\\w+\\}}', '[param]', 'g') as fetched from r""",
    "route_match": f"""with {_ROUTES}, t as (select id, regexp_replace(path, '\\{{(\\w+)\\}}', '[\\1]', 'g') as route from r),
        f as (select id as fetch_id, regexp_replace(route, '\\[\\w+\\]', '42', 'g') as url from t union all select id, regexp_replace(route, '\\[\\w+\\]', '[param]', 'g') from t)
        select fetch_id, url, id, route from f join t on len(str_split(url, '/')) = len(str_split(route, '/'))
          and (select bool_and(a = b or starts_with(a, '[') or starts_with(b, '[')) from (select unnest(str_split(url, '/')) as a, unnest(str_split(route, '/')) as b))""",
    "middleware_match": f"""with {_ROUTES} select id, matcher from r, (values ('/section/:path*'), ('/(path|edge)/.*'), ('/index/{{window}}')) m(matcher)
        where case when matcher like '%/:path*' then path = '/section' or starts_with(path, '/section/') when contains(matcher, '(') then regexp_full_match(path, matcher) else path = matcher end""",
    "shape_mismatch": f"with {_SHAPE} select route, consumer, missing, case when coalesce(step_count, 1) > 1 then 'low' else 'high' end as confidence from sh",
    "api_impact": f"""with {_SHAPE}, g as (select r.id as route, count(distinct consumer) as consumers, count(*) filter (len(missing) > 0) as mismatches from r left join sh on sh.route = r.id group by 1)
        select route, consumers, mismatches, case when mismatches > 0 then 'MEDIUM' else 'LOW' end as risk from g""",
    "hash_diff": f"""with {_STATES} select coalesce(o.id, n.id) as id, case when o.id is null then 'added' when n.id is null then 'deleted' else 'changed' end as change from old o full join cur n on o.id = n.id
        where o.id is null or n.id is null or o.content is distinct from n.content or o.description is distinct from n.description or o.complexity is distinct from n.complexity""",
    "hash_diff_back": f"""with {_STATES} select coalesce(o.id, n.id) as id, case when o.id is null then 'deleted' when n.id is null then 'added' else 'changed' end as change from old o full join cur n on o.id = n.id
        where o.id is null or n.id is null or o.content is distinct from n.content""",
    "record_diff": f"""with {_STATES}, j as (select coalesce(o.id, n.id) as id, case when o.id is null then 'added' when n.id is null then 'deleted' else 'changed' end as change,
          case when o.id is null or n.id is null then '' else concat_ws(',', case when o.content is distinct from n.content then 'content' end, case when o.description is distinct from n.description then 'description' end,
            case when o.complexity is distinct from n.complexity then 'complexity' end, case when o.is_exported is distinct from n.is_exported then 'is_exported' end) end as columns from old o full join cur n on o.id = n.id)
        select * from j where change <> 'changed' or columns <> ''""",
    "write_set_expand": """with e as (select distinct c_nationkey as a, s_nationkey as b from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
          where o_totalprice > 480000 and c_nationkey <> s_nationkey), ch as (select n_nationkey as k from nation where n_regionkey = 2)
        select k as file from ch union select b from e where a in (from ch) union select a from e where b in (from ch)""",
    "write_set_all": """with e as (select distinct c_nationkey as a, s_nationkey as b from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey),
          ch as (select n_nationkey as k from nation where n_regionkey = 2) select k as file from ch union select b from e where a in (from ch) union select a from e where b in (from ch)""",
    "subgraph_extract": """select 'C' || o_custkey as src, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey = 3 group by 1""",
    "reconcile": f"""with {CURRENT_SQL}, st as (select id, count(*) as n from nodes where id is not null group by 1)
        select id, 'duplicated' as problem from cur join st using (id) where n > 1""",
    "embedding_reuse": """with m as (select node_id, lower(trim(content_hash, chr(32) || chr(9) || chr(10) || chr(13))) as h, run_id from cached_embedding_meta where node_id is not null and content_hash is not null),
        half as (select max(run_id) // 2 as r from m), now_ as (select node_id, h from m, half where run_id > r qualify row_number() over (partition by node_id order by run_id desc, h) = 1)
        select node_id as id, case when exists (select 1 from m, half where m.node_id = now_.node_id and m.h = now_.h and run_id <= r) then 'reused' else 'missing' end as state from now_""",
    "hunk_symbol_overlap": f"""with {CURRENT_SQL}, s as (select id, label, concat_ws('/', repo, file_path) as file, start_line, end_line from cur where label in ('Function', 'Method', 'Class') and start_line <= end_line)
        select h.id as hunk_id, s.id from s h join s on h.file = s.file and h.start_line <= s.end_line and h.end_line >= s.start_line where h.label = 'Class'""",
    "path_suffix_match": """with p as (select distinct path, str_split(path, '/') as s from why_ignored_result where path is not null), t as (select distinct array_to_string(s[greatest(len(s) - 1, 1):len(s)], '/') as tail from p),
        x as (select path, array_to_string(s[i:], '/') as tail from (select path, s, unnest(generate_series(1, len(s))) as i from p))
        select tail, min(path) as path from x where tail in (from t) group by 1 having count(*) = 1""",
    "stream_refresh": """select node_id, cache_row_id, lower(trim(content_hash, chr(32) || chr(9) || chr(10) || chr(13))) as content_hash from cached_embedding_meta where node_id is not null
        qualify row_number() over (partition by node_id order by cached_at desc nulls last, cache_row_id desc) = 1""",
    "events_hourly": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "user_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hours then 0 else 1 end as b from events),
        s as (select user_id, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g), c as (select user_id, k, count(*) as n from s group by 1, 2)
        select user_id, count(*) as sessions, max(n) as longest from c group by 1""",
}
