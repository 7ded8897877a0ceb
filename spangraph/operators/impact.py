"""What a change reaches, and how risky it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import bfs, confidence, of_type
from .windows import first_n, page

DEFAULT_LIMIT, AGENT_LIMIT = 100, 30


def risk(direction: Column, direct: Column, processes: Column, modules: Column, impacted: Column, incomplete: Column | None = None) -> Column:
    """The risk ladder; an incomplete count never gives a confident low or medium."""
    level = (
        F.when((direction == "upstream") & (impacted == 0), "UNKNOWN")
        .when((direct >= 30) | (processes >= 5) | (modules >= 5) | (impacted >= 200), "CRITICAL")
        .when((direct >= 15) | (processes >= 3) | (modules >= 3) | (impacted >= 100), "HIGH")
        .when((direct >= 5) | (impacted >= 30), "MEDIUM")
        .otherwise("LOW")
    )
    return level if incomplete is None else F.when(incomplete & level.isin("LOW", "MEDIUM"), "UNKNOWN").otherwise(level)


def impact(edges: DataFrame, anchors: DataFrame, *, upstream: bool = True, types: list[str] | None = None, max_depth: int = 3, min_confidence: float = 0.0, row_cap: int | None = None):
    """``anchor, id, depth`` of what each anchor reaches, without the anchor itself; and whether it is partial."""
    e = of_type(edges, *types) if types else edges
    if min_confidence > 0:
        e = e.filter(confidence(F.col("type"), F.col("confidence")) >= min_confidence)
    rows, partial = bfs(e, anchors.select("id", F.col("id").alias("anchor")), up=upstream, max_depth=max_depth, row_cap=row_cap, keep=["anchor"])
    return rows.filter("depth > 0"), partial


def by_depth(reached: DataFrame) -> DataFrame:
    return reached.groupBy("anchor", "depth").agg(F.count("*").alias("n"))


def risk_report(anchors: DataFrame, reached: DataFrame, steps: DataFrame | None, members: DataFrame | None, direction: str) -> DataFrame:
    """One row an anchor: direct, impacted, processes, modules, risk and a note where nothing calls it.

    ``steps`` has ``id, process`` and ``members`` has ``id, community``.
    """
    base = anchors.select(F.col("id").alias("anchor")).distinct()
    counts = reached.groupBy("anchor").agg(F.count(F.when(F.col("depth") == 1, 1)).alias("direct"), F.count("*").alias("impacted"))
    touched = reached.select("anchor", "id").unionByName(base.select("anchor", F.col("anchor").alias("id")))
    rows = base.join(counts, "anchor", "left")
    for table, column, name in ((steps, "process", "processes"), (members, "community", "modules")):
        if table is None:
            rows = rows.withColumn(name, F.lit(0).cast("long"))
        else:
            hit = touched.join(table.select("id", column), "id").select("anchor", column).distinct().groupBy("anchor").agg(F.count(column).alias(name))
            rows = rows.join(hit, "anchor", "left")
    rows = rows.fillna(0, ["direct", "impacted", "processes", "modules"])
    level = risk(F.lit(direction), F.col("direct"), F.col("processes"), F.col("modules"), F.col("impacted"))
    note = F.when((F.lit(direction) == "upstream") & (F.col("impacted") == 0), "no caller is known; dynamic use is not seen")
    return rows.withColumn("risk", level).withColumn("risk_note", note)


def impact_page(reached: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """The same page of every anchor's every depth."""
    return page(reached, ["anchor", "depth"], [F.asc("id")], limit, offset)


def candidates(nodes: DataFrame, window: int = 20) -> DataFrame:
    """``name, id, label, file_path, candidates, rank``: the nodes of each name, at most the ``window`` with the lowest ids, with the number there are."""
    named = nodes.filter("name is not null").select("name", "id", "label", "file_path")
    counted = named.join(named.groupBy("name").agg(F.count("*").alias("candidates")), "name")
    return first_n(counted, ["name"], [F.asc("id")], window)


def ambiguous(nodes: DataFrame, name: str, window: int = 20) -> DataFrame:
    """The candidates of one name."""
    return candidates(nodes.filter(F.col("name") == name), window).select("id", "label", "file_path", "candidates").orderBy("id")


def cap_fan_out(neighbours: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The best neighbours by confidence, then contract id, and those dropped by the cap."""
    order = [F.desc("confidence"), F.asc("contract_id"), F.asc("neighbor_uid")]
    kept = neighbours.orderBy(*order).limit(cap)
    return kept, neighbours.join(kept.select("contract_id", "neighbor_uid"), ["contract_id", "neighbor_uid"], "left_anti").orderBy(*order)
