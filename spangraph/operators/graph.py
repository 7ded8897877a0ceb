"""Expansion, breadth-first layers, paths, closure, components, cohesion and flows over an edge table.

Edges have ``src, dst, type`` and possibly ``confidence`` and ``reason``. Iterative operators add
one join a round and write each round's new rows to the shared folder, so plans stay short and a
lost executor costs one round. Closure and components go on until nothing changes, however deep the
graph is. A null end of an edge joins nothing.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DEFAULT_CONFIDENCE, OTHER_CONFIDENCE
from ..runtime import materialise


def of_type(edges: DataFrame, *types: str) -> DataFrame:
    return edges.filter(F.col("type").isin(*types))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways, a self-loop once."""
    back = edges.filter("src <> dst").withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(back)


def expand(edges: DataFrame, nodes: DataFrame, to: DataFrame | None = None) -> DataFrame:
    """One hop: the edges with the columns of both end nodes under ``a_`` and ``b_``."""
    a = nodes.select(*[F.col(c).alias(f"a_{c}") for c in nodes.columns])
    to = nodes if to is None else to
    b = to.select(*[F.col(c).alias(f"b_{c}") for c in to.columns])
    return edges.join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id"))


def degree(edges: DataFrame) -> DataFrame:
    """``id, degree``: edge ends at a node, either direction."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    return ends.filter("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def fan(edges: DataFrame, by: str = "src") -> DataFrame:
    """``id, n``: distinct other ends, fan-out by src or fan-in by dst."""
    other = "dst" if by == "src" else "src"
    pairs = edges.select(F.col(by).alias("id"), F.col(other).alias("o")).distinct()
    return pairs.groupBy("id").agg(F.count("o").alias("n"))


def confidence(type_: Column, stored: Column) -> Column:
    """The stored confidence if it is over 0, else that of the relation type."""
    by_type = F.lit(OTHER_CONFIDENCE)
    for t, c in DEFAULT_CONFIDENCE.items():
        by_type = F.when(type_ == t, F.lit(c)).otherwise(by_type)
    return F.when(stored > 0, stored).otherwise(by_type)


def bfs(edges: DataFrame, anchors: DataFrame, *, up: bool = False, max_depth: int | None = 3, row_cap: int | None = None, keep: list[str] | None = None) -> tuple[DataFrame, bool]:
    """``[keep..., ]id, depth`` with the least depth of each node, anchors at depth 0; and whether it is partial.

    Without a ``max_depth`` it goes on until no level has a new node.

    ``anchors`` has ``id`` and the ``keep`` columns, by which searches stay apart. ``row_cap`` bounds
    the new nodes of a level; a level with more is cut in id order and the result is partial.
    """
    keep = keep or []
    key = [*keep, "id"]
    a, b = ("dst", "src") if up else ("src", "dst")
    step = edges.select(F.col(a).alias("id"), F.col(b).alias("next")).filter("id is not null and next is not null").distinct()
    if max_depth is None or max_depth > 1:  # every level reads them again
        step = materialise(step, "bfs-edges")
    seen = materialise(anchors.select(*key).distinct().withColumn("depth", F.lit(0)), "bfs")
    frontier, partial = seen, False
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        reached = frontier.select(*key).join(step, "id").select(*keep, F.col("next").alias("id")).distinct()
        new = reached.join(seen.select(*key), key, "left_anti").withColumn("depth", F.lit(depth))
        if row_cap is not None:
            new = new.orderBy(*key).limit(row_cap + 1)
        new = materialise(new, "bfs")
        n = new.count()
        if row_cap is not None and n > row_cap:
            new, partial = new.orderBy(*key).limit(row_cap), True
        if n == 0:
            break
        seen, frontier = seen.unionByName(new), new
    return seen, partial


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int = 10, *, tests: Column | None = None) -> DataFrame:
    """``found, hops, path``: the shortest directed path, of equally short ones the first in id order.

    Layers grow from both ends, the smaller one first, until they meet, so a path is half as long and
    a hub near one end isn't gone through by the other. Each node has the first of its equally long
    ways to its end. Without a path: the furthest node reached, as ``hops`` with the path to it and
    ``found`` false. ``tests`` is a condition on ``id`` of nodes that a path may not go through, such as test files.
    """
    step = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    if tests is not None:
        ends = step.select(F.col("dst").alias("id")).unionAll(step.select(F.col("src").alias("id"))).distinct()
        bad = ends.filter(tests).filter(~F.col("id").isin(source, target))
        for end in ("src", "dst"):
            step = step.join(bad.withColumnRenamed("id", end), end, "left_anti")
    step = materialise(step.select("src", "dst"), "path-edges")
    spark = edges.sparkSession
    done = lambda found, path: spark.createDataFrame([(found, len(path) - 1, path)], "found boolean, hops int, path array<string>")
    if source == target:
        return done(True, [source])
    layers = [[spark.createDataFrame([(x, [x])], "id string, way array<string>")] for x in (source, target)]
    sizes = [1, 1]

    def grow(side: int) -> None:
        a, b = ("dst", "src") if side else ("src", "dst")
        new = layers[side][-1].join(step.withColumnRenamed(a, "id"), "id").groupBy(F.col(b).alias("id")).agg(F.min("way").alias("w"))
        seen = layers[side][0].select("id")
        for old in layers[side][1:]:
            seen = seen.unionByName(old.select("id"))
        new = new.join(seen, "id", "left_anti").select("id", (F.concat(F.array("id"), "w") if side else F.concat("w", F.array("id"))).alias("way"))
        new = materialise(new, "path")
        sizes[side] = new.count()
        if sizes[side]:
            layers[side].append(new)

    def depth() -> int:
        return len(layers[0]) + len(layers[1]) - 2

    while depth() < max_depth and min(sizes):
        grow(int(sizes[1] < sizes[0]))
        there = layers[1][-1].select("id", F.slice("way", F.lit(2), F.size("way")).alias("rest"))
        best = layers[0][-1].join(there, "id").agg(F.min(F.concat("way", "rest")).alias("p")).first().p if min(sizes) else None
        if best is not None:
            return done(True, best)
    while sizes[0] and len(layers[0]) - 1 < max_depth:
        grow(0)
    return done(False, layers[0][-1].agg(F.min("way").alias("p")).first().p)


def two_hop_counts(first: DataFrame, second: DataFrame) -> DataFrame:
    """``src, n``: how many different ends each start reaches over two edges, for integer ids (``src, dst``).

    Far ends are gathered as bitmaps before the shuffle, so a pair that many middles join is one bit.
    """
    a = first.select("src", F.col("dst").alias("mid")).filter("src is not null and mid is not null").distinct()
    b = second.select(F.col("src").alias("mid"), "dst").filter("mid is not null and dst is not null").distinct()
    far = a.join(b, "mid").select("src", F.call_function("bitmap_bucket_number", "dst").alias("bucket"), F.call_function("bitmap_bit_position", "dst").alias("bit"))
    maps = far.groupBy("src", "bucket").agg(F.call_function("bitmap_construct_agg", "bit").alias("bits"))
    return maps.groupBy("src").agg(F.sum(F.call_function("bitmap_count", "bits")).alias("n"))


def paths(edges: DataFrame, anchors: DataFrame, min_length: int, max_length: int, *, edge_unique: bool = False) -> DataFrame:
    """``anchor, id, length, nodes, types``: all walks from the anchors, or those without a repeated edge."""
    step = edges.filter("src is not null and dst is not null").select("src", "dst", "type")
    walk = anchors.select(F.col("id").alias("anchor"), "id", F.array("id").alias("nodes"), F.array().cast("array<string>").alias("types"), F.array().cast("array<string>").alias("used"))
    out = walk.filter("false").withColumn("length", F.lit(0))
    for length in range(1, max_length + 1):
        walk = walk.join(step, walk.id == step.src)
        edge = F.concat_ws("\u0001", "src", "type", "dst")
        if edge_unique:
            walk = walk.filter(~F.array_contains("used", edge))
        walk = walk.select("anchor", F.col("dst").alias("id"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("types", F.array("type")).alias("types"), F.concat("used", F.array(edge)).alias("used"))
        if length >= min_length:
            out = out.unionByName(walk.withColumn("length", F.lit(length)))
    return out.drop("used")


def closure(edges: DataFrame) -> DataFrame:
    """``src, dst``: all pairs joined by a path of at least one edge, by semi-naive rounds."""
    step = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    seen = frontier = materialise(step, "closure")
    hop = step.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
    while True:
        new = frontier.join(hop, "dst").select("src", F.col("to").alias("dst")).distinct()
        new = materialise(new.join(seen, ["src", "dst"], "left_anti"), "closure")
        if not new.limit(1).count():
            break
        seen, frontier = seen.unionByName(new), new
    return seen


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: strongly connected components with their greatest id, by colouring.

    Each round trims nodes without an edge in or out, lets the greatest id flow along the edges
    until nothing changes, and takes from each colour what reaches its root backwards.
    """
    left = materialise(edges.select("src", "dst").filter("src is not null and dst is not null and src <> dst").distinct(), "scc")
    ids = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).filter("id is not null").distinct()
    todo, done = materialise(ids, "scc"), []
    while True:
        while True:  # trim
            inner = left.select(F.col("src").alias("id")).intersect(left.select(F.col("dst").alias("id")))
            single = materialise(todo.join(inner, "id", "left_anti"), "scc")
            if not single.limit(1).count():
                break
            done.append(single.withColumn("component", F.col("id")))
            todo = materialise(todo.join(single, "id", "left_anti"), "scc")
            gone = single.select("id")
            left = materialise(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "scc")
        if not todo.limit(1).count():
            break
        colour = todo.withColumn("colour", F.col("id"))
        while True:
            came = left.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("c"))
            new = materialise(colour.join(came, "id", "left").select("id", F.greatest("colour", "c").alias("colour"), (F.col("c") > F.col("colour")).alias("moved")), "scc")
            colour = new.select("id", "colour")
            if not new.filter("moved").limit(1).count():
                break
        a, b = (colour.select(F.col("id").alias(x), F.col("colour").alias(f"{x}_c")) for x in ("src", "dst"))
        same = materialise(left.join(a, "src").join(b, "dst").filter("src_c = dst_c").select("src", "dst"), "scc")
        roots = colour.filter("id = colour").select("id")
        reach, _ = bfs(same, roots, up=True, max_depth=None)
        part = materialise(reach.select("id").join(colour, "id").select("id", F.col("colour").alias("component")), "scc")
        done.append(part)
        todo = materialise(todo.join(part, "id", "left_anti"), "scc")
        gone = part.select("id")
        left = materialise(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "scc")
    out = done[0] if done else ids.withColumn("component", F.col("id"))
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``community, ends, internal_ends, cohesion``: share of its members' edge ends that stay inside.

    ``members`` has ``id, community``. A community without an edge has cohesion 1.
    """
    m = members.select("id", "community")
    other = m.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    ends = undirected(edges.select("src", "dst")).join(m.withColumnRenamed("id", "src"), "src").join(other, "dst", "left")
    sums = ends.groupBy("community").agg(F.count("*").alias("ends"), F.count(F.when(F.col("community") == F.col("other"), 1)).alias("internal_ends"))
    rows = m.select("community").distinct().join(sums, "community", "left").fillna(0, ["ends", "internal_ends"])
    return rows.withColumn("cohesion", F.when(F.col("ends") == 0, F.lit(1.0)).otherwise(F.col("internal_ends") / F.col("ends")))


# The reason of an edge that only a name suggests, and symbols beyond which a projection is a large one.
NAME_GUESS, LARGE = "name-guess", 10_000


def community_projection(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("CALLS", "EXTENDS", "IMPLEMENTS"), large: int = LARGE) -> tuple[DataFrame, bool]:
    """``src, dst``: the edges that communities are found on, each pair once, and whether it is a large projection.

    Edges that a name suggests are left out. Nodes without an edge take no part, in a large projection
    nodes with one neighbour neither, so leaves don't make up most of it.
    """
    symbols = nodes.filter("label in ('Function', 'Method', 'Class', 'Interface', 'Struct', 'Trait', 'Enum')").select("id")
    is_large = symbols.limit(large + 1).count() > large
    e = of_type(edges, *types).filter(F.coalesce("reason", F.lit("")) != NAME_GUESS).filter("src <> dst")
    e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    for end in ("src", "dst"):
        e = e.join(symbols.withColumnRenamed("id", end), end, "left_semi")
    e = e.select("src", "dst")
    if is_large:
        e = materialise(e, "projection")
        few = degree(e).filter("degree = 1").select("id")
        for end in ("src", "dst"):
            e = e.join(few.withColumnRenamed("id", end), end, "left_anti")
    return e.select("src", "dst"), is_large


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``modularity``: the share of edges within communities beyond what node degrees alone would give; one row.

    ``edges`` are undirected pairs, ``members`` has ``id, community``.
    """
    m = members.select("id", "community")
    ends = edges.join(m.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    inside = ends.filter("a = b").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("inside"))
    degrees = ends.select(F.explode(F.array("a", "b")).alias("community")).groupBy("community").agg(F.count("*").alias("ends"))
    total = ends.agg(F.count("*").alias("m"))
    part = F.coalesce("inside", F.lit(0)) / F.col("m") - (F.col("ends") / (2 * F.col("m"))) ** 2
    # the total is one row
    return degrees.join(inside, "community", "left").join(F.broadcast(total)).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("modularity"))


def community_labels(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``community, label``: the commonest folder of a community's files, of equally common ones the first; its name where no member has a file."""
    folder = F.element_at(F.split(F.regexp_replace("file_path", r"/?[^/]*$", ""), "/"), -1)
    named = members.join(nodes.select("id", folder.alias("folder")).filter("folder <> ''"), "id").groupBy("community", "folder").agg(F.count("*").alias("n"))
    best = named.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "folder")).alias("b"))
    return members.select("community").distinct().join(best, "community", "left").select("community", F.coalesce("b.folder", F.col("community").cast("string")).alias("label"))


def process_budget(symbols: int) -> int:
    """How many processes are looked for: a tenth of the symbols, at least 20; halves go up."""
    return max(20, int(symbols / 10 + 0.5))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``id, community`` by synchronous label propagation, ties to the least label; the reference's Leiden differs.

    A node keeps its label if it is among its neighbours' commonest ones.
    """
    both = materialise(undirected(edges.filter("src <> dst").select("src", "dst").distinct()).distinct(), "labels")
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    labels = materialise(labels, "labels")
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "community").agg(F.count("*").alias("n"))
        own = labels.select(F.col("id").alias("src"), F.col("community").alias("own"))
        ranked = votes.join(own, "src").withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), F.desc(F.col("community") == F.col("own")), "community")))
        new = materialise(ranked.filter("r = 1").select(F.col("src").alias("id"), "community", (F.col("community") != F.col("own")).alias("moved")), "labels")
        labels = new.select("id", "community")
        if not new.filter("moved").limit(1).count():
            break
    return labels


def flows(edges: DataFrame, entries: DataFrame, *, branching: int = 4, depth: int = 10, min_steps: int = 3, max_entries: int = 200) -> DataFrame:
    """``entry, steps``: call chains from ranked entry points (``id, score``), at most ``branching`` callees a step.

    Edges whose reason says that they were guessed by name, or whose confidence is under 0.5, are
    left out; a chain ends where no callee is left that it hasn't visited, or at ``depth`` steps.
    """
    calls = of_type(edges, "CALLS").filter("coalesce(reason, '') <> 'name-guess' and coalesce(confidence, 1.0) >= 0.5").select("src", "dst").filter("src <> dst").distinct()
    calls = materialise(calls.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))), "flows")
    walk = entries.orderBy(F.desc("score"), "id").limit(max_entries).select(F.col("id").alias("entry"), "id", F.array("id").alias("steps"))
    ended = []
    for _ in range(depth - 1):
        walk = materialise(walk, "flows")
        fresh = walk.join(calls, walk.id == calls.src).filter(~F.array_contains("steps", F.col("dst")))
        w = Window.partitionBy("entry", "steps").orderBy("r")
        fresh = fresh.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= branching).select("entry", F.col("dst").alias("next"), "steps")
        fresh = materialise(fresh, "flows")
        ended.append(walk.join(fresh.select("entry", "steps").distinct(), ["entry", "steps"], "left_anti").select("entry", "steps"))
        walk = fresh.select("entry", F.col("next").alias("id"), F.concat("steps", F.array("next")).alias("steps"))
        if not fresh.limit(1).count():
            break
    else:
        ended.append(walk.select("entry", "steps"))
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out.filter(F.size("steps") >= min_steps).distinct()


def cascade_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids in ``gone`` and without edges at them."""
    gone = gone.select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(*edges.columns)
