"""Program dependence: orders, dominance, control and data dependence of each function's flow graph, and taint.

A flow graph has ``fn_id, src_block, dst_block, kind``; block 0 is the entry. What is inherently
sequential within one function gets that function's edges as one row of arrays, many functions an
Arrow batch; what crosses functions are joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import materialise

EXIT = -1


def per_function(rows: DataFrame, lists: dict[str, list[str]], work: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Run ``work(fn_id, *lists)`` for each row; a list column is given as tuples of the named fields."""
    out = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            parts = []
            for name, fields in lists.items():
                column = batch.column(name)
                flat = column.flatten()
                values = list(zip(*(flat.field(f).to_pylist() for f in fields)))
                ends = pc.list_value_length(column).fill_null(0).to_pylist()
                at, cut = 0, []
                for n in ends:
                    cut.append(values[at : at + n])
                    at += n
                parts.append(cut)
            for fn, *own in zip(batch.column("fn_id").to_pylist(), *parts):
                made.extend(work(fn, *own))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), arrow)], schema=arrow)

    return rows.select("fn_id", *lists).mapInArrow(run, out)


def _edges(cfg: DataFrame) -> DataFrame:
    return cfg.groupBy("fn_id").agg(F.collect_list(F.struct("src_block", "dst_block", "kind")).alias("e"))


_EDGE = {"e": ["src_block", "dst_block", "kind"]}


def _graph(edges: Iterable[tuple]) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    out: dict[int, list[int]] = {0: []}
    back: dict[int, list[int]] = {0: []}
    for a, b in sorted({e[:2] for e in edges}):
        for x in (a, b):
            out.setdefault(x, [])
            back.setdefault(x, [])
        out[a].append(b)
        back[b].append(a)
    return out, back


def reverse_post_order(out: dict[int, list[int]], start: int = 0) -> list[int]:
    """Reachable blocks, each before what it leads to but for loops."""
    seen, order, stack = {start}, [], [(start, iter(out.get(start, [])))]
    while stack:
        node, rest = stack[-1]
        for n in rest:
            if n not in seen:
                seen.add(n)
                stack.append((n, iter(out.get(n, []))))
                break
        else:
            order.append(node)
            stack.pop()
    return order[::-1]


def immediate_dominators(out: dict[int, list[int]], back: dict[int, list[int]], start: int = 0) -> dict[int, int]:
    """Cooper, Harvey and Kennedy's iteration over reverse post-order; the start dominates itself."""
    order = reverse_post_order(out, start)
    at = {b: i for i, b in enumerate(order)}
    idom = {start: start}
    changed = True
    while changed:
        changed = False
        for b in order[1:]:
            known = [p for p in back[b] if p in idom]
            new = known[0]
            for p in known[1:]:
                while new != p:
                    while at[new] > at[p]:
                        new = idom[new]
                    while at[p] > at[new]:
                        p = idom[p]
            if idom.get(b) != new:
                idom[b], changed = new, True
    return idom


def dominance_frontiers(idom: dict[int, int], back: dict[int, list[int]]) -> dict[int, set[int]]:
    front: dict[int, set[int]] = {b: set() for b in idom}
    for b in idom:
        before = [p for p in back[b] if p in idom]
        if len(before) > 1:
            for p in before:
                while p != idom[b]:
                    front[p].add(b)
                    p = idom[p]
    return front


def strong_components(out: dict[int, list[int]]) -> dict[int, int]:
    """Tarjan's components without recursion; each block with the least block of its component."""
    index, low, on, stack, comp = {}, {}, set(), [], {}
    for root in sorted(out):
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        work = [(root, iter(out[root]))]
        while work:
            v, rest = work[-1]
            for n in rest:
                if n not in index:
                    index[n] = low[n] = len(index)
                    stack.append(n)
                    on.add(n)
                    work.append((n, iter(out[n])))
                    break
                if n in on:
                    low[v] = min(low[v], index[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == v:
                            break
                    for x in part:
                        comp[x] = min(part)
    return comp


def with_exit(out: dict[int, list[int]]) -> tuple[dict[int, list[int]], set[int]]:
    """The graph with one exit that every block reaches: dead ends lead there, and so does the least block of each endless loop."""
    full = {b: list(n) or [EXIT] for b, n in out.items()}
    full[EXIT] = []
    escapes: set[int] = set()
    while True:
        back: dict[int, list[int]] = {b: [] for b in full}
        for b, ns in full.items():
            for n in ns:
                back[n].append(b)
        reach = set(reverse_post_order(back, EXIT))
        lost = sorted(b for b in full if b not in reach)
        if not lost:
            return full, escapes
        comp = strong_components({b: [n for n in full[b] if n in lost] for b in lost})
        sinks = [c for c in sorted(set(comp.values())) if all(comp[n] == c for b in lost if comp[b] == c for n in full[b])]
        for c in sinks:
            full[c].append(EXIT)
            escapes.add(c)


def _reversed(full: dict[int, list[int]]) -> dict[int, list[int]]:
    back: dict[int, list[int]] = {b: [] for b in full}
    for b, ns in full.items():
        for n in ns:
            back[n].append(b)
    return back


def post_dominators(out: dict[int, list[int]]) -> dict[int, int]:
    full, _ = with_exit(out)
    return immediate_dominators(_reversed(full), full, EXIT)


def block_facts(cfg: DataFrame) -> DataFrame:
    """``fn_id, block, position, idom, ipdom, frontier, component, escape`` of every block; position and idom null where unreachable."""

    def facts(fn: str, edges: list[tuple]) -> Iterator[tuple]:
        out, back = _graph(edges)
        order = {b: i for i, b in enumerate(reverse_post_order(out))}
        idom = immediate_dominators(out, back)
        front, comp, ipdom = dominance_frontiers(idom, back), strong_components(out), post_dominators(out)
        escapes = with_exit(out)[1]
        for b in sorted(out):
            yield fn, b, order.get(b), idom.get(b) if b else None, ipdom.get(b), sorted(front.get(b, [])), comp[b], b in escapes

    return per_function(_edges(cfg), _EDGE, facts, "fn_id string, block int, position int, idom int, ipdom int, frontier array<int>, component int, escape boolean")


# How the kinds of branch edges are shown.
BRANCH = {"cond-true": "T", "true": "T", "cond-false": "F", "false": "F"}


def control_dependence(cfg: DataFrame, cap: int | None = None) -> DataFrame:
    """``fn_id, src_block, dst_block, label``: blocks that run or not by a branch of another; T, F or the kind of the branch edge.

    ``cap`` bounds the rows of one function, in the order of blocks; without it all are given.
    """

    def depend(fn: str, edges: list[tuple]) -> Iterator[tuple]:
        ipdom = post_dominators(_graph(edges)[0])
        rows = set()
        for a, b, kind in {(a, b, k or "") for a, b, k in edges}:
            x, stop = b, ipdom.get(a)
            while x is not None and x != stop and x != EXIT:
                rows.add((a, x, BRANCH.get(kind, kind)))
                x = ipdom.get(x)
        for row in sorted(rows)[:cap]:
            yield fn, *row

    return per_function(_edges(cfg), _EDGE, depend, "fn_id string, src_block int, dst_block int, label string")


def _reach(edges: list[tuple], sites: list[tuple]) -> list[tuple]:
    """(variable, def_block, def_line, use_block, use_line) of one function: one bit a definition, a worklist over blocks."""
    out, back = _graph(edges)
    by: dict[int, list[tuple]] = {}
    for block, _, line, variable, kind in sorted(sites):
        by.setdefault(block, []).append((line, variable, kind))
        out.setdefault(block, [])
        back.setdefault(block, [])
    defs = [(b, line, v) for b, here in by.items() for line, v, kind in here if kind == "def"]
    of: dict[str, int] = {}
    bit: dict[tuple, int] = {}
    for k, (b, line, v) in enumerate(defs):
        of[v] = of.get(v, 0) | 1 << k
        bit[b, line, v] = bit.get((b, line, v), 0) | 1 << k
    gen, kill, coming = {}, {}, dict.fromkeys(out, 0)
    for b, here in by.items():
        last = {v: bit[b, line, v] for line, v, kind in here if kind == "def"}
        gen[b] = sum(last.values())
        kill[b] = ~sum(of[v] for v in last)
    todo = set(out)
    order = {b: i for i, b in enumerate(reverse_post_order(out))}
    while todo:
        b = min(todo, key=lambda x: order.get(x, len(order)))
        todo.discard(b)
        leaving = coming[b] & kill.get(b, -1) | gen.get(b, 0)
        for n in out[b]:
            if leaving & ~coming[n]:
                coming[n] |= leaving
                todo.add(n)
    rows = set()
    for b, here in by.items():
        live = {v: coming[b] & bits for v, bits in of.items()}
        for line, v, kind in here:
            if kind == "def":
                live[v] = bit[b, line, v]
                continue
            bits = live.get(v, 0)
            while bits:
                at, from_, _ = defs[(bits & -bits).bit_length() - 1]
                rows.add((v, at, from_, b, line))
                bits &= bits - 1
    return sorted(rows)


def reaching_definitions(cfg: DataFrame, accesses: DataFrame) -> DataFrame:
    """``fn_id, variable, def_block, def_line, use_block, use_line``: which definition may reach which use.

    ``accesses`` has ``fn_id, block, seq, line, variable, kind`` (``def`` or ``use``) in statement order.
    """
    sites = accesses.groupBy("fn_id").agg(F.collect_list(F.struct("block", "seq", "line", "variable", "kind")).alias("a"))
    joined = sites.join(_edges(cfg), "fn_id", "left")

    def reach(fn: str, edges: list[tuple], own: list[tuple]) -> Iterator[tuple]:
        for row in _reach(edges, own):
            yield fn, *row

    lists = _EDGE | {"a": ["block", "seq", "line", "variable", "kind"]}
    return per_function(joined, lists, reach, "fn_id string, variable string, def_block int, def_line long, use_block int, use_line long")


def _taint(flows: list[tuple], sources: list[tuple], sinks: set[tuple], off: dict[int, set]) -> Iterator[tuple]:
    """(source_line, sink_line, kind, hops) of one function, by layers from each source and kind."""
    step: dict[int, set[int]] = {}
    for a, b in flows:
        step.setdefault(a, set()).add(b)
    for line, kind in sources:
        seen, layer, hops = {line}, [line], 0
        while layer:
            hops += 1
            layer = sorted({b for a in layer for b in step.get(a, ()) if b not in seen and kind not in off.get(b, ())})
            seen.update(layer)
            for b in layer:
                if (b, kind) in sinks:
                    yield line, b, kind, hops


def taint_within(flows: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """``fn_id, source_line, sink_line, kind, hops``: sources that reach a sink of a kind that nothing on the way neutralises.

    ``flows`` has ``fn_id, variable, def_line, use_line`` steps, where a use at the line of the next
    definition carries on; ``sources`` and ``sinks`` have ``fn_id, line`` and ``kinds`` or ``kind``;
    ``sanitizers`` has ``fn_id, line, kinds``. A function's facts come together in one shuffle.
    """
    none = F.lit(None).cast("string")
    rows = flows.select("fn_id", F.lit("flow").alias("what"), F.col("def_line").alias("a"), F.col("use_line").alias("b"), none.alias("kind"))
    for df, what, kind in ((sources, "source", F.explode("kinds")), (sinks, "sink", F.col("kind")), (sanitizers, "off", F.explode("kinds"))):
        rows = rows.unionByName(df.select("fn_id", F.lit(what).alias("what"), F.col("line").alias("a"), F.lit(None).cast("long").alias("b"), kind.alias("kind")))
    facts = rows.distinct().groupBy("fn_id").agg(F.collect_list(F.struct("what", "a", "b", "kind")).alias("f"), F.max(F.col("what") == "source").alias("s"), F.max(F.col("what") == "sink").alias("k"))

    def spread(fn: str, own: list[tuple]) -> Iterator[tuple]:
        off: dict[int, set] = {}
        for what, a, _, kind in own:
            if what == "off":
                off.setdefault(a, set()).add(kind)
        of = lambda w: [(a, k) for what, a, _, k in own if what == w]
        for row in _taint([(a, b) for what, a, b, _ in own if what == "flow"], sorted(of("source")), set(of("sink")), off):
            yield fn, *row

    return per_function(facts.filter("s and k").select("fn_id", "f"), {"f": ["what", "a", "b", "kind"]}, spread, "fn_id string, source_line long, sink_line long, kind string, hops int")


def taint_across(entries: DataFrame, param_calls: DataFrame, param_sinks: DataFrame, *, cap: int | None = None) -> DataFrame:
    """``source, fn, param, kind, sink, depth, confidence``: sources that reach a sink through calls, by semi-naive rounds until nothing is new.

    ``entries`` has ``source, fn, param``: tainted arguments; ``param_calls`` has ``fn, param, callee,
    callee_param``: parameters passed on; ``param_sinks`` has ``fn, param, kind, sink``.
    """
    seen = frontier = materialise(entries.select("source", "fn", "param").distinct().withColumn("depth", F.lit(0)), "across")
    calls = materialise(param_calls.select("fn", "param", "callee", "callee_param").distinct(), "across")
    for depth in count(1):
        new = frontier.join(calls, ["fn", "param"]).select("source", F.col("callee").alias("fn"), F.col("callee_param").alias("param")).distinct()
        new = materialise(new.join(seen, ["source", "fn", "param"], "left_anti").withColumn("depth", F.lit(depth)), "across")
        if not new.limit(1).count():
            break
        seen, frontier = seen.unionByName(new), new
    found = seen.join(param_sinks, ["fn", "param"]).groupBy("source", "fn", "param", "kind", "sink").agg(F.min("depth").alias("depth"))
    found = found.withColumn("confidence", F.lit(0.6))
    return found if cap is None else found.orderBy("source", "sink", "kind", "fn", "param").limit(cap)


def guards(dependences: DataFrame, blocks: DataFrame, fn_prefix: str | None = None) -> DataFrame:
    """``fn_id, guard, text, guarded``: what each condition controls."""
    rows = dependences.filter(F.col("fn_id").startswith(fn_prefix)) if fn_prefix else dependences
    b = blocks.select("fn_id", F.col("block").alias("src_block"), "text")
    return rows.join(b, ["fn_id", "src_block"]).groupBy("fn_id", F.col("src_block").alias("guard"), "text").agg(F.array_sort(F.collect_set("dst_block")).alias("guarded"))


def guarded_lines(dependences: DataFrame, conditions: DataFrame, blocks: DataFrame) -> DataFrame:
    """``fn_id, line, kinds``: lines that only run where a condition has proved a value harmless, as sanitizers for ``taint_within``.

    ``conditions`` has ``fn_id, block, label, kinds``: on the branch with that label the guarded value
    is safe for those kinds. A block counts if it depends on that branch and on no other label of it.
    """
    d = dependences.select("fn_id", F.col("src_block").alias("block"), F.col("dst_block"), "label")
    one = d.groupBy("fn_id", "block", "dst_block").agg(F.countDistinct("label").alias("n"), F.first("label").alias("label")).filter("n = 1")
    safe = one.join(conditions, ["fn_id", "block", "label"]).select("fn_id", F.col("dst_block").alias("block"), "kinds")
    lines = blocks.select("fn_id", "block", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    return lines.join(safe, ["fn_id", "block"]).select("fn_id", "line", "kinds")


def refine_values(flows: DataFrame, facts: DataFrame) -> DataFrame:
    """Flows without those whose definition is known to be a constant or a number (``fn_id, line, fact``), which carry no taint."""
    known = facts.filter("fact in ('constant', 'number', 'boolean')").select("fn_id", F.col("line").alias("def_line")).distinct()
    return flows.join(known, ["fn_id", "def_line"], "left_anti").select(*flows.columns)
