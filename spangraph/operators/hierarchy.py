"""Type hierarchies: ancestor order, linearisation, dispatch and injection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise
from .graph import closure
from .windows import first_wins


def mro_breadth_first(parents: DataFrame) -> DataFrame:
    """``type, ancestor, position``: ancestors level by level, in declaration order within a level, each once.

    ``parents`` has ``type, parent, position``.
    """
    step = materialise(parents.select("type", "parent", "position"), "mro")
    seen = frontier = materialise(
        first_wins(step.select("type", F.col("parent").alias("ancestor"), F.array("position").alias("path")), ["type", "ancestor"], [F.asc("path")]).filter("type <> ancestor"), "mro"
    )
    while True:
        hop = frontier.join(step.withColumnRenamed("type", "ancestor"), "ancestor")
        new = hop.select("type", F.col("parent").alias("ancestor"), F.concat("path", F.array("position")).alias("path")).filter("type <> ancestor")
        new = first_wins(new, ["type", "ancestor"], [F.asc("path")]).join(seen.select("type", "ancestor"), ["type", "ancestor"], "left_anti")
        new = materialise(new, "mro")
        if not new.limit(1).count():
            break
        seen, frontier = seen.unionByName(new), new
    order = Window.partitionBy("type").orderBy(F.size("path"), "path")
    return seen.select("type", "ancestor", F.row_number().over(order).alias("position"))


def c3_merge(of: str, parents: list[str], lines: list[list[str] | None]) -> list[str] | None:
    """The C3 linearisation of a type from those of its parents, in order; None for an inconsistent order."""
    if any(line is None for line in lines):
        return None
    sequences, out = [[*line] for line in lines] + [list(parents)], [of]
    while sequences := [s for s in sequences if s]:
        behind = {x for s in sequences for x in s[1:]}
        head = next((s[0] for s in sequences if s[0] not in behind), None)
        if head is None:
            return None
        out.append(head)
        sequences = [s[1:] if s[0] == head else s for s in sequences]
    return out


def mro_c3(parents: DataFrame) -> DataFrame:
    """``type, mro``: C3 order of every type, null where there is none, for a cycle or an inconsistent order.

    Types are linearised in waves: in each those whose parents all are. So every type is merged once,
    from its parents' orders, and what no wave reaches lies in a cycle or under one.
    """
    known = parents.filter("type is not null and parent is not null").groupBy("type", "parent").agg(F.min("position").alias("position"))
    todo = materialise(known.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("position", "parent"))).alias("up")), "c3")
    roots = known.select(F.col("parent").alias("type")).distinct().join(todo.select("type"), "type", "left_anti")
    ready = materialise(roots.select("type", F.array("type").alias("mro")), "c3")
    done: list[DataFrame] = []
    kinds = "type string, up array<struct<position:long,parent:string>>, got array<struct<parent:string,mro:array<string>>>"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, lines = batch.column(0).to_pylist(), []
            for of, up, got in zip(types, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                line = {g["parent"]: g["mro"] for g in got}
                order = [u["parent"] for u in up]
                lines.append(c3_merge(of, order, [line[x] for x in order]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.list_(pa.string()))], names=["type", "mro"])

    waiting = todo.select("type", "up", F.array().cast("array<struct<parent:string,mro:array<string>>>").alias("got"))
    while ready.limit(1).count():
        wave = waiting.select("type", F.explode("up.parent").alias("parent")).join(ready.select(F.col("type").alias("parent"), "mro"), "parent")
        came = wave.groupBy("type").agg(F.collect_list(F.struct("parent", "mro")).alias("came"))
        # orders that have come are kept with the types that still wait for others
        waiting = waiting.join(came, "type", "left").select("type", "up", F.concat("got", F.coalesce("came", F.array().cast("array<struct<parent:string,mro:array<string>>>"))).alias("got"))
        waiting = materialise(waiting.select(*[F.col(x.split(" ")[0]).cast(x.split(" ")[1]) for x in kinds.split(", ")]), "c3")
        whole = F.size("got") == F.size("up")
        ready = materialise(waiting.filter(whole).mapInArrow(merge, "type string, mro array<string>"), "c3")
        waiting = waiting.filter(~whole)
        done.append(ready)
    out = waiting.select("type", F.lit(None).cast("array<string>").alias("mro"))
    for d in done:
        out = out.unionByName(d)
    return out


def subtypes(parents: DataFrame) -> DataFrame:
    """``type, super``: every type with all its supertypes."""
    return closure(parents.select(F.col("type").alias("src"), F.col("parent").alias("dst"))).select(F.col("src").alias("type"), F.col("dst").alias("super"))


def implementors(parents: DataFrame) -> DataFrame:
    """``super, types``: who extends or implements each type, at any distance, once and in order."""
    return subtypes(parents).groupBy("super").agg(F.array_sort(F.collect_set("type")).alias("types"))


def overrides(methods: DataFrame, parents: DataFrame, interfaces: DataFrame) -> DataFrame:
    """``src, dst, type``: each method with the nearest ancestor's method of its name; METHOD_IMPLEMENTS where that is an interface.

    ``methods`` has ``id, owner, name``; ``interfaces`` has ``type``.
    """
    up = mro_breadth_first(parents)
    own = methods.select(F.col("id").alias("src"), F.col("owner").alias("type"), "name")
    theirs = methods.select(F.col("id").alias("dst"), F.col("owner").alias("ancestor"), "name")
    found = own.join(up, "type").join(theirs, ["ancestor", "name"])
    nearest = first_wins(found, ["src"], [F.asc("position"), F.asc("dst")])
    kinds = nearest.join(interfaces.select(F.col("type").alias("ancestor"), F.lit("METHOD_IMPLEMENTS").alias("k")).distinct(), "ancestor", "left")
    return kinds.select("src", "dst", F.coalesce("k", F.lit("METHOD_OVERRIDES")).alias("type"))


def _fits(providers: DataFrame, parents: DataFrame) -> DataFrame:
    """``type, super``: what a provider's type may be injected as, itself included."""
    self_ = providers.select("type").distinct().select("type", F.col("type").alias("super"))
    return subtypes(parents).unionByName(self_).distinct()


def injections(consumers: DataFrame, providers: DataFrame, parents: DataFrame) -> DataFrame:
    """``src, dst, confidence``: consumers with the providers whose type is the wanted one or a subtype, by qualifier if one is given.

    ``consumers`` has ``id, wanted, qualifier, confidence``, ``providers`` has ``id, type, qualifier``;
    of several findings of one pair the most confident holds, and nothing is injected into itself.
    """
    p = providers.select(F.col("id").alias("dst"), "type", F.col("qualifier").alias("p_qualifier")).join(_fits(providers, parents), "type")
    c = consumers.select(F.col("id").alias("src"), F.col("wanted").alias("super"), "qualifier", "confidence")
    found = c.join(p, "super").filter("src <> dst and (qualifier is null or qualifier = p_qualifier)")
    return found.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def injection_counts(consumers: DataFrame, providers: DataFrame, parents: DataFrame) -> DataFrame:
    """``src, n, first_dst``: of each consumer in ``injections`` the number of its providers and the first of them.

    No pair is made: consumers that want the same have the same providers, but for themselves, so these are
    gathered once for each set of wants, under its first consumer's id. Work grows with sets of wants, not with consumers.
    """
    wants = F.array_sort(F.collect_set(F.struct(F.col("wanted").alias("super"), "qualifier")))
    each = materialise(consumers.filter("id is not null and wanted is not null").groupBy(F.col("id").alias("src")).agg(wants.alias("wants")), "wants")
    sets = materialise(each.groupBy("wants").agg(F.min("src").alias("like")), "wants")
    alike = each.join(sets, "wants").select("src", "like")
    want = sets.select("like", F.inline("wants"))
    reach = materialise(want.join(_fits(providers, parents), "super").select("like", "type", "qualifier").distinct(), "reach")
    # a provider answers to its qualifier and to none
    p = providers.filter("id is not null").select(F.col("id").alias("dst"), F.col("type").alias("p_type"), F.explode(F.array_distinct(F.array(F.lit(None), "qualifier"))).alias("p_qualifier"))
    found = p.join(reach, (F.col("p_type") == F.col("type")) & F.col("p_qualifier").eqNullSafe(F.col("qualifier")))
    found = materialise(found.select("like", "dst").distinct(), "found")
    totals = materialise(found.groupBy("like").agg(F.count("*").alias("all"), F.min("dst").alias("first")), "totals")
    # a consumer among its own providers isn't counted; if it is the first, the next one is
    own = alike.join(found.select("like", F.col("dst").alias("src")), ["like", "src"]).select("src", F.lit(1).alias("own"))
    leads = alike.join(totals, "like").filter("src = first").select("like", "first")
    second = found.join(leads, "like").filter("dst <> first").groupBy("like").agg(F.min("dst").alias("second"))
    out = alike.join(totals, "like").join(own, "src", "left").join(second, "like", "left").withColumn("n", F.col("all") - F.coalesce("own", F.lit(0)))
    return out.filter("n > 0").select("src", "n", F.when(F.col("src") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("first_dst"))
