"""From references to edges: name lookup, owners, positions and evidence."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise
from .windows import first_wins

# The relation type of each kind of reference; import uses have none.
KIND_TYPE = {"call": "CALLS", "read": "ACCESSES", "write": "ACCESSES", "inherits": "EXTENDS", "type": "USES", "value": "USES", "macro": "USES"}
OLDER_KIND_TYPE = KIND_TYPE | {"inherits": "INHERITS", "uses": "USES"}


def reference_edges(references: DataFrame, *, collapse: bool = False, older: bool = False) -> DataFrame:
    """``src, dst, type, step, line, col``: one edge a place, or one a pair of ends; ``caller, target, kind, line, col`` in."""
    kinds = OLDER_KIND_TYPE if older else KIND_TYPE
    type_ = F.lit(None).cast("string")
    for k, t in kinds.items():
        type_ = F.when(F.col("kind") == k, F.lit(t)).otherwise(type_)
    step = F.when(F.col("kind") == "read", 1).when(F.col("kind") == "write", 2)
    rows = references.filter("caller is not null and target is not null").select(F.col("caller").alias("src"), F.col("target").alias("dst"), type_.alias("type"), step.alias("step"), "line", "col")
    rows = rows.filter("type is not null")
    key = ["type", "src", "dst"] if collapse else ["type", "src", "dst", "line", "col"]
    return first_wins(rows, key, [F.asc("line"), F.asc("col"), F.asc_nulls_last("step")])


def enclosing(scopes: DataFrame, start: DataFrame, wanted: Column) -> DataFrame:
    """``ref, owner``: going up from each reference's scope, the first scope whose ``kind`` is wanted.

    ``scopes`` has ``scope, parent, kind, owner``; ``start`` has ``ref, scope``. One join a level, on
    what is still unresolved. A walk that comes round to ``mark``, a scope it has passed, is in a cycle
    and ends; the mark moves up at levels that are powers of two, so every cycle is found (Brent).
    """
    table = scopes.select("scope", "parent", "owner", F.coalesce(wanted, F.lit(False)).alias("hit"))
    todo, found = materialise(start.select("ref", "scope", F.col("scope").alias("mark")), "scopes"), []
    for level in count(1):
        if not todo.limit(1).count():
            break
        at = materialise(todo.join(table, "scope"), "scopes")
        found.append(at.filter("hit").select("ref", "owner"))
        mark = F.col("parent" if level & (level - 1) == 0 else "mark")
        todo = at.filter("not hit and parent is not null and parent <> mark").select("ref", F.col("parent").alias("scope"), mark.alias("mark"))
    out = found[0] if found else start.select("ref", F.lit(None).cast("string").alias("owner")).limit(0)
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def innermost(positions: DataFrame, spans: DataFrame, *, bucket: int = 256) -> DataFrame:
    """``ref, id``: the smallest span of the same file that holds a line; both ends count.

    Spans are cut into stretches of ``bucket`` lines, so a line meets only the spans of its stretch.
    """
    cut = spans.filter("start_line <= end_line").select("file", "id", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))).alias("_b"))
    near = positions.withColumn("_b", F.floor(F.col("line") / bucket)).join(cut, ["file", "_b"]).filter((F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line")))
    best = F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "id")
    return near.groupBy("ref").agg(F.min(best).alias("b")).select("ref", "b.id")


def overlapping(hunks: DataFrame, symbols: DataFrame, *, bucket: int = 256) -> DataFrame:
    """``hunk_id, id``: symbols that a changed stretch of their file touches, last lines included.

    Both sides are cut into stretches of ``bucket`` lines and meet by file and stretch, so a file
    with many symbols isn't compared as a whole.
    """
    cut = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))))
    h = cut(hunks.filter("start_line <= end_line")).select("hunk_id", "file", "_b", F.col("start_line").alias("hs"), F.col("end_line").alias("he"))
    s = cut(symbols.filter("start_line <= end_line")).select("id", "file", "_b", "start_line", "end_line")
    return h.join(s, ["file", "_b"]).filter("hs <= end_line and he >= start_line").select("hunk_id", "id").distinct()


def path_ends_with(path: Column, tail: Column) -> Column:
    """A path that is the given one or ends in it at a segment border."""
    return (path == tail) | path.endswith(F.concat(F.lit("/"), tail))


def suffix_lookup(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """``tail, path``: the only path that ends in each wanted tail; ambiguous tails are left out."""
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    keys = paths.select("path", F.explode(tails).alias("tail")).join(wanted.select("tail").distinct(), "tail", "left_semi")
    return keys.groupBy("tail").agg(F.min("path").alias("path"), F.count("*").alias("n")).filter("n = 1").select("tail", "path")


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``path, root``: the longest root that is the path or holds it."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    hits = paths.select("path", F.explode(up).alias("root")).join(roots.select("root").distinct(), "root")
    return hits.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def evidence_score(evidence: Column) -> Column:
    """The weights of all evidence, brought into 0 to 1."""
    total = F.aggregate(F.transform(evidence, lambda e: e["weight"]), F.lit(0.0), lambda acc, w: acc + F.coalesce(w, F.lit(0.0)))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Of each reference the best candidate by confidence, scope depth, MRO depth, origin and id.

    Confidences count as equal if they agree to three decimals. (A tolerance between pairs isn't
    transitive, so it can't order a set.)
    """
    order = [F.desc(F.round("confidence", 3)), F.asc("scope_depth"), F.asc("mro_depth"), F.asc("origin"), F.asc("id")]
    return first_wins(candidates, ["ref"], order)


def registry_lookup(references: DataFrame, definitions: DataFrame, by: str = "qualified_name") -> DataFrame:
    """``ref, id``: definitions with the reference's name; names with several definitions are marked ambiguous."""
    found = references.select("ref", by).join(definitions.select(by, "id"), by)
    n = F.count("*").over(Window.partitionBy("ref"))
    return found.select("ref", "id", (n > 1).alias("ambiguous"))


def lexical_lookup(references: DataFrame, bindings: DataFrame, scopes: DataFrame) -> DataFrame:
    """``ref, id``: each reference's nearest binding of its name up the scopes, which shadows those further out.

    ``references`` has ``ref, name, scope``; ``bindings`` has ``name, scope, id, rank``; ``scopes`` has
    ``scope, ancestors`` (the scope itself first).
    """
    up = references.join(scopes.select("scope", "ancestors"), "scope").select("ref", "name", F.posexplode("ancestors").alias("distance", "at"))
    hits = up.join(bindings.select("name", F.col("scope").alias("at"), "id", "rank"), ["name", "at"])
    return first_wins(hits, ["ref"], [F.asc("distance"), F.asc("rank"), F.asc("id")]).select("ref", "id")


def ownership_edges(members: DataFrame, owners: DataFrame) -> DataFrame:
    """``src, dst, type``: HAS_METHOD and HAS_PROPERTY edges from owner to member by qualified name of the owner."""
    type_ = F.when(F.col("kind") == "method", "HAS_METHOD").when(F.col("kind") == "property", "HAS_PROPERTY")
    rows = members.join(owners.select(F.col("id").alias("src"), F.col("qualified_name").alias("owner")), "owner")
    return rows.select("src", F.col("id").alias("dst"), type_.alias("type")).filter("type is not null").distinct()


def import_edges(imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """``src, dst, type, reason``: one IMPORTS edge a pair of files; deferred and type-only imports say so."""
    reason = F.concat(F.lit("import"), F.when(F.col("deferred"), "|deferred").otherwise(""), F.when(F.col("type_only"), "|type-only").otherwise(""))
    rows = imports.join(resolved.select("tail", F.col("path").alias("target")), "tail").filter("file <> target")
    rows = rows.select(F.concat(F.lit("File:"), "file").alias("src"), F.concat(F.lit("File:"), "target").alias("dst"), F.lit("IMPORTS").alias("type"), reason.alias("reason"))
    return first_wins(rows, ["src", "dst"], [F.length("reason"), F.asc("reason")])


def destination_links(publishers: DataFrame, consumers: DataFrame) -> DataFrame:
    """``publisher, consumer, broker, address``: both ends of a destination; an unresolved address joins nothing."""
    key = ["broker", "address"]
    p = publishers.select(F.col("id").alias("publisher"), *key)
    return p.join(consumers.select(F.col("id").alias("consumer"), *key), key).select("publisher", "consumer", *key)


def function_cfgs(functions: DataFrame, cfgs: DataFrame) -> DataFrame:
    """``id, fn_id``: functions with the flow graph that starts one line further (0-based and 1-based lines), none where a line has several."""
    one = lambda df, cols: df.withColumn("_n", F.count("*").over(Window.partitionBy(*cols))).filter("_n = 1").drop("_n")
    f = one(functions.select("id", "file", (F.col("start_line") + 1).alias("line")), ["file", "line"])
    c = one(cfgs.select("fn_id", "file", F.col("start_line").alias("line")), ["file", "line"])
    return f.join(c, ["file", "line"]).select("id", "fn_id")


def boundary_pairs(edges: DataFrame, labels: DataFrame, declared: DataFrame) -> DataFrame:
    """``from_label, to_label, n, problem`` of edges whose pair of labels isn't declared; unknown labels are skipped and counted."""
    of = lambda c: F.when(F.col(c).startswith("comm_"), "Community").when(F.col(c).startswith("proc_"), "Process").otherwise(F.substring_index(F.col(c), ":", 1))
    pairs = edges.select(of("src").alias("from_label"), of("dst").alias("to_label")).groupBy("from_label", "to_label").agg(F.count("*").alias("n"))
    known = labels.select("label").distinct()
    marked = pairs.join(declared.select("from_label", "to_label", F.lit(True).alias("ok")).distinct(), ["from_label", "to_label"], "left")
    for end in ("from_label", "to_label"):
        marked = marked.join(known.select(F.col("label").alias(end), F.lit(True).alias(f"{end}_known")), end, "left")
    unknown = F.col("from_label_known").isNull() | F.col("to_label_known").isNull()
    return marked.filter("ok is null").select("from_label", "to_label", "n", F.when(unknown, "unknown label").otherwise("undeclared").alias("problem"))


# Labels that a type reference may mean, and origins of bindings that count as certain.
TYPE_LABELS = ["Class", "Protocol", "Category", "Interface", "Enum", "Struct", "Union", "Trait", "TypeAlias", "Typedef", "Record", "Delegate", "Annotation", "Template"]
CERTAIN = ["local", "import", "namespace", "reexport"]


def type_references(references: DataFrame, bindings: DataFrame, scopes: DataFrame, definitions: DataFrame) -> DataFrame:
    """``ref, id``: the one type that each reference can mean; nothing is guessed, so ambiguous ones have no row.

    ``references`` has ``ref, name, scope``, ``bindings`` has ``name, scope, id, label, origin``,
    ``scopes`` has ``scope, ancestors`` (the scope itself first), ``definitions`` has ``id,
    qualified_name, label``. The nearest scope that binds the name claims it, with types or not. A
    dotted name that no scope claims, nor its first part, is looked up as a qualified name.
    """
    up = references.join(scopes, "scope").select("ref", "name", F.posexplode("ancestors").alias("distance", "at"))
    root = F.substring_index("name", ".", 1)
    asked = up.select("ref", "distance", "at", "name", F.lit(False).alias("root")).unionByName(up.filter(root != F.col("name")).select("ref", "distance", "at", root.alias("name"), F.lit(True).alias("root")))
    hits = asked.join(bindings.select("name", F.col("scope").alias("at"), "id", "label", "origin"), ["name", "at"])
    claimed = hits.select("ref").distinct()
    near = hits.filter("not root").withColumn("first", F.min("distance").over(Window.partitionBy("ref"))).filter("distance = first")
    fit = near.filter(F.col("label").isin(TYPE_LABELS) & F.col("origin").isin(CERTAIN))
    lexical = fit.groupBy("ref").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).filter("n = 1").select("ref", "id")
    dotted = references.filter(F.col("name").contains(".")).join(claimed, "ref", "left_anti").select("ref", F.col("name").alias("qualified_name"))
    types = definitions.filter(F.col("label").isin(TYPE_LABELS)).select("qualified_name", "id").distinct()
    qualified = dotted.join(types, "qualified_name").groupBy("ref").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").select("ref", "id")
    return lexical.unionByName(qualified)


def reconcile_ownership(edges: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ownership edges with one owner a member, the smallest that holds it, and those that were dropped.

    ``edges`` has ``src, dst, type``, ``spans`` has ``id, file, start_line, end_line``. An owner in
    another file, or one that doesn't hold the member, yields to one that does; of equals the first counts.
    """
    own = edges.filter("type in ('HAS_METHOD', 'HAS_PROPERTY')")
    a = spans.select(F.col("id").alias("src"), F.col("file").alias("a_file"), F.col("start_line").alias("a_start"), F.col("end_line").alias("a_end"))
    b = spans.select(F.col("id").alias("dst"), F.col("file").alias("b_file"), F.col("start_line").alias("b_start"))
    held = own.join(a, "src", "left").join(b, "dst", "left")
    outside = ~F.coalesce((F.col("a_file") == F.col("b_file")) & F.col("b_start").between(F.col("a_start"), F.col("a_end")), F.lit(False))
    order = [F.asc(outside), F.asc_nulls_last(F.col("a_end") - F.col("a_start")), F.asc("src"), F.asc("type")]
    kept = first_wins(held, ["dst"], order).select(*edges.columns)
    return kept, own.select(*edges.columns).join(kept.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti").select(*edges.columns)


def rename_preview(definition: str, new_name: str, definitions: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file, line, col, old, new``: the places a rename writes, and ``id, file, line`` of what has the new name in a file that it touches.

    ``definitions`` has ``id, name, file, line, col``; ``references`` has ``target, file, line, col``.
    """
    own = definitions.filter(F.col("id") == definition)
    uses = references.filter(F.col("target") == definition).select("file", "line", "col", F.col("target").alias("id"))
    places = own.select("file", "line", "col", "id").unionByName(uses).distinct().join(own.select("id", F.col("name").alias("old")), "id")
    edits = places.select("file", "line", "col", "old", F.lit(new_name).alias("new"))
    clashes = definitions.filter(F.col("name") == new_name).join(edits.select("file").distinct(), "file", "left_semi")
    return edits.orderBy("file", "line", "col"), clashes.select("id", "file", "line")
