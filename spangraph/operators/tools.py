"""Composite questions: what surrounds a symbol, what a diff touches, where imports run in circles, what crosses repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import check_types
from .graph import bfs, components, of_type, shortest_path
from .impact import risk
from .quality import is_test_file
from .resolution import overlapping
from .search import bm25_indexes, ranked, rrf

# The chain depths that a context may ask for.
CHAIN_DEPTHS = (1, 2, 3)


def context(nodes: DataFrame, edges: DataFrame, ids: DataFrame, *, types: list[str] | None = None, per_type: int = 30) -> DataFrame:
    """``id, direction, type, n, neighbours``: neighbours of the given symbols by direction and relation type, the first by id.

    The count is of all neighbours; files come after symbols.
    """
    e = of_type(edges, *check_types(types)) if types else edges
    want = ids.select("id").distinct()
    out = e.join(want.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("id"), F.lit("outgoing").alias("direction"), "type", F.col("dst").alias("other"))
    into = e.join(want.withColumnRenamed("id", "dst"), "dst").select(F.col("dst").alias("id"), F.lit("incoming").alias("direction"), "type", F.col("src").alias("other"))
    both = out.unionByName(into).join(nodes.select(F.col("id").alias("other"), "name"), "other").dropDuplicates(["id", "direction", "type", "other"])
    key = ["id", "direction", "type"]
    w = Window.partitionBy(*key)
    ranked = both.withColumn("n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col("other").startswith("File:"), "other")))
    top = ranked.filter(F.col("_r") <= per_type).groupBy(*key, "n").agg(F.array_sort(F.collect_list(F.struct("_r", "other", "name"))).alias("l"))
    return top.select(*key, "n", F.transform("l", lambda x: x["other"]).alias("neighbours"))


def chain(edges: DataFrame, ids: DataFrame, depth: int, up: bool = True) -> DataFrame:
    """``root, id, depth``: call layers around symbols; depths from 1 to 3 only."""
    if depth not in CHAIN_DEPTHS:
        raise ValueError(f"the depth must be one of {CHAIN_DEPTHS}")
    rows, _ = bfs(of_type(edges, "CALLS"), ids.select("id", F.col("id").alias("root")), up=up, max_depth=depth, keep=["root"])
    return rows.filter("depth > 0")


def detect_changes(hunks: DataFrame, symbols: DataFrame, steps: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The symbols that changed lines touch (``id, processes, callers, risk``), and the hunks that touch none (``hunk_id``)."""
    hits = overlapping(hunks, symbols)
    changed = hits.select("id").distinct()
    processes = changed.join(steps.select("id", "process").distinct(), "id").groupBy("id").agg(F.count("*").alias("processes"))
    calls = of_type(edges, "CALLS").select(F.col("dst").alias("id"), "src").distinct()
    callers = changed.join(calls, "id").groupBy("id").agg(F.count("*").alias("callers"))
    rows = changed.join(processes, "id", "left").join(callers, "id", "left").fillna(0, ["processes", "callers"])
    level = risk(F.lit("upstream"), F.col("callers"), F.col("processes"), F.lit(0), F.col("callers"))
    return rows.withColumn("risk", level), hunks.select("hunk_id").distinct().join(hits.select("hunk_id"), "hunk_id", "left_anti")


def circular(edges: DataFrame, type_: str = "IMPORTS") -> DataFrame:
    """``component, members``: groups of files that import one another in a circle, and files that import themselves."""
    e = of_type(edges, type_)
    parts = components(e)
    several = parts.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members")).filter(F.size("members") > 1)
    own = e.filter("src = dst").select("src").distinct().join(several.select(F.explode("members").alias("src")), "src", "left_anti")
    return several.unionByName(own.select(F.col("src").alias("component"), F.array("src").alias("members")))


def statement_reach(dependences: DataFrame, blocks: DataFrame, start: DataFrame, calls: DataFrame, max_depth: int = 10) -> DataFrame:
    """``fn_id, callee``: what is called from statements that depend on the given lines, directly or not.

    ``dependences`` has ``fn_id, src_block, dst_block``, ``blocks`` has ``fn_id, block, start_line,
    end_line, callees`` (names with spaces between), ``start`` has ``fn_id, line`` and ``calls`` has
    ``fn_id, callee, name``.
    """
    key = lambda b: F.concat_ws("#", "fn_id", b)
    at = blocks.join(start, "fn_id").filter((F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line")))
    e = dependences.select(key("src_block").alias("src"), key("dst_block").alias("dst"), F.lit("DEP").alias("type"))
    reach, _ = bfs(e, at.select(key("block").alias("id")).distinct(), max_depth=max_depth)
    hit = blocks.select("fn_id", key("block").alias("id"), F.split("callees", " ").alias("names")).join(reach.select("id"), "id", "left_semi")
    return hit.join(calls, "fn_id").filter(F.array_contains("names", F.col("name"))).select("fn_id", "callee").distinct()


def route_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``route, handlers, consumers`` of every route, by HANDLES_ROUTE and FETCHES edges."""
    r = nodes.filter("label = 'Route'").select(F.col("id").alias("route"))
    of = lambda t, n: of_type(edges, t).groupBy(F.col("dst").alias("route")).agg(F.array_sort(F.collect_set("src")).alias(n))
    rows = r.join(of("HANDLES_ROUTE", "handlers"), "route", "left").join(of("FETCHES", "consumers"), "route", "left")
    empty = F.array().cast("array<string>")
    return rows.select("route", F.coalesce("handlers", empty).alias("handlers"), F.coalesce("consumers", empty).alias("consumers"))


def group_impact(edges: DataFrame, links: DataFrame, anchors: DataFrame, max_depth: int = 3) -> DataFrame:
    """``anchor, id, depth, crossed``: upstream impact within a repository, and behind one contract link in others.

    ``links`` has ``from_symbol`` (the consumer) and ``to_symbol`` (the provider).
    """
    own, _ = bfs(edges, anchors.select("id", F.col("id").alias("anchor")), up=True, max_depth=max_depth, keep=["anchor"])
    over = links.filter("from_symbol <> '' and to_symbol <> ''").select(F.col("to_symbol").alias("id"), F.col("from_symbol").alias("far")).distinct()
    start = own.join(over, "id").select("anchor", F.col("far").alias("id")).distinct()
    there, _ = bfs(edges, start, up=True, max_depth=max_depth, keep=["anchor"])
    return own.filter("depth > 0").withColumn("crossed", F.lit(False)).unionByName(there.withColumn("crossed", F.lit(True)))


def importers(edges: DataFrame, files: DataFrame, max_depth: int = 5, hub: int = 100) -> DataFrame:
    """``id, depth, hub``: what imports the given files, at any distance; a file with over ``hub`` importers is a module hub."""
    e = of_type(edges, "IMPORTS")
    rows, _ = bfs(e, files.select("id"), up=True, max_depth=max_depth)
    n = e.select(F.col("dst").alias("id"), "src").distinct().groupBy("id").agg(F.count("*").alias("n"))
    return rows.join(n, "id", "left").select("id", "depth", (F.coalesce("n", F.lit(0)) > hub).alias("hub"))


def tool_map(tools: DataFrame, edges: DataFrame) -> DataFrame:
    """``tool, name, handlers`` of every tool (``id, name``), by HANDLES_TOOL edges."""
    by = of_type(edges, "HANDLES_TOOL").groupBy(F.col("dst").alias("tool")).agg(F.array_sort(F.collect_set("src")).alias("handlers"))
    return tools.select(F.col("id").alias("tool"), "name").join(by, "tool", "left").withColumn("handlers", F.coalesce("handlers", F.array().cast("array<string>")))


def query(nodes: DataFrame, edges: DataFrame, terms: list[str], *, k: int = 200, limit: int = 10, semantic: DataFrame | None = None) -> DataFrame:
    """The answer to a search: the best definitions, each once, with who calls them.

    ``id, name, label, file_path, score, rank, n_callers``. Names, descriptions and contents are
    searched as three indexes and a node has its best score of them; with ``semantic``
    (``id, rank``) both lists are fused by their ranks.
    """
    hits = bm25_indexes(nodes, "id", {"name": 1.0, "description": 1.0, "content": 1.0}, terms, k)
    top = ranked(hits.orderBy(F.desc("score"), "id").limit(k), [F.desc("score"), F.asc("id")])
    if semantic is None:
        best = top.filter(F.col("rank") <= limit).select("id", "score", "rank")
    else:
        best = rrf(top, semantic, "id", limit).select("id", "score", "rank")
    callers = of_type(edges, "CALLS").select(F.col("dst").alias("id"), "src").distinct().join(best.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n_callers"))
    found = best.join(nodes.select("id", "name", "label", "file_path"), "id").join(callers, "id", "left").fillna(0, ["n_callers"])
    return found.select("id", "name", "label", "file_path", "score", "rank", "n_callers")


def symbol_cards(nodes: DataFrame, edges: DataFrame, steps: DataFrame, ids: DataFrame, *, per_type: int = 30) -> DataFrame:
    """A symbol's whole context, one row each: ``id, name, label, incoming, outgoing, processes, routes, properties``.

    ``incoming`` and ``outgoing`` map a relation type to its first neighbours, ``processes`` are the
    flows (``steps``: ``id, process, step``) it is a step of, with its place, ``routes`` those that it or its
    file handles, ``properties`` the typed ones: complexity, sloc and exported as text by name.
    """
    want = ids.select("id").distinct()
    around = context(nodes.select("id", "name"), edges, want, per_type=per_type)
    side = lambda d: around.filter(F.col("direction") == d).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "neighbours")))).alias(d))
    flow = steps.join(want, "id", "left_semi").groupBy("id", "process").agg(F.min("step").alias("step"))
    flow = flow.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("process", "step"))).alias("processes"))
    handled = of_type(edges, "HANDLES_ROUTE").select(F.col("src").alias("handler"), F.col("dst").alias("route"))
    homes = want.select("id", F.col("id").alias("handler")).unionByName(of_type(edges, "DEFINES").select(F.col("dst").alias("id"), F.col("src").alias("handler")).join(want, "id", "left_semi"))
    routes = homes.join(handled, "handler").groupBy("id").agg(F.array_sort(F.collect_set("route")).alias("routes"))
    typed = [c for c in ("complexity", "sloc", "is_exported") if c in nodes.columns]
    props = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, typed)), F.array(*[F.col(c).cast("string") for c in typed])), lambda k, v: v.isNotNull())
    rows = nodes.join(want, "id", "left_semi").select("id", "name", "label", props.alias("properties"))
    for part in (side("incoming"), side("outgoing"), flow, routes):
        rows = rows.join(part, "id", "left")
    return rows.select("id", "name", "label", "incoming", "outgoing", "processes", "routes", "properties")


# The depth of a trace if none is asked for, and the greatest one.
TRACE_DEPTH, MOST_TRACE = 10, 30


def trace(nodes: DataFrame, edges: DataFrame, source: str, target: str, *, depth: int = TRACE_DEPTH, with_tests: bool = False) -> DataFrame:
    """``found, hops, path``: the shortest way by calls and methods, not through test files unless asked for."""
    e = of_type(edges, "CALLS", "HAS_METHOD")
    if not with_tests:
        bad = nodes.filter(is_test_file(F.col("file_path")) & ~F.col("id").isin(source, target)).select("id")
        for end in ("src", "dst"):
            e = e.join(bad.withColumnRenamed("id", end), end, "left_anti")
    return shortest_path(e.select("src", "dst"), source, target, max_depth=min(max(depth, 1), MOST_TRACE))


# Fixed value: bytes that count as one token of an answer.
TOKEN_BYTES = 4


def fit_budget(rows: DataFrame, order: list[str], max_tokens: int) -> tuple[DataFrame, bool]:
    """The first rows of an answer, in order, whose JSON fits a number of tokens, and whether any was left out.

    For answers that are already cut to a page: all rows are added up in one window.
    """
    size = F.octet_length(F.to_json(F.struct(*rows.columns))) + 1
    summed = rows.withColumn("_bytes", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    kept = summed.filter(F.col("_bytes") <= max_tokens * TOKEN_BYTES).drop("_bytes")
    return kept, summed.filter(F.col("_bytes") > max_tokens * TOKEN_BYTES).limit(1).count() > 0


def compact_lines(rows: DataFrame, section: str) -> DataFrame:
    """``section, line``: rows as short text, ``name=value`` pairs without those that are null or empty."""
    pairs = [F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c, t in rows.dtypes if not t.startswith(("array", "map", "struct"))]
    return rows.select(F.lit(section).alias("section"), F.concat_ws(" ", *pairs).alias("line"))


def schema_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, position, column, type`` of the given tables."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table string, position int, column string, type string")
