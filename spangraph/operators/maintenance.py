"""Keeping an index up to date: what has drifted, which groups and tables a change touches, and how complete a result is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nodes beyond which vectors aren't made by default, and rows that a metadata probe returns at most.
MOST_EMBEDDED, PROBE_ROWS = 50_000, 1001


def resolution_groups(files: DataFrame, changed: DataFrame) -> DataFrame:
    """``file``: all files of the groups (``file, group``) that a changed file belongs to; files without a group stand for themselves."""
    c = changed.select("file").distinct()
    groups = files.join(c, "file", "left_semi").filter("group is not null").select("group").distinct()
    return files.join(groups, "group", "left_semi").select("file").unionByName(c).distinct()


def config_drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``key, drift``: configuration entries (``key, values`` as an array in any order) that were added, removed or changed."""
    s = stored.select("key", F.array_sort("values").alias("s"))
    c = current.select("key", F.array_sort("values").alias("c"))
    drift = F.when(F.col("s").isNull(), "added").when(F.col("c").isNull(), "removed").when(F.col("s") != F.col("c"), "changed")
    return s.join(c, "key", "full_outer").select("key", drift.alias("drift")).filter("drift is not null")


def touched_labels(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """``label``: the tables whose full-text index a change of files touches."""
    return nodes.join(changed.select(F.col("file").alias("file_path")).distinct(), "file_path", "left_semi").select("label").distinct()


def keeps_derived(changed: DataFrame) -> bool:
    """Communities and processes stay as they are if nothing has changed."""
    return changed.limit(1).count() == 0


def embedding_mode(asked: str | None, stored_vectors: int, nodes: int, cap: int = MOST_EMBEDDED) -> str:
    """``off``, ``full`` or ``incremental``: what is asked for, kept if vectors exist, and off above the cap (0 lifts it)."""
    if asked == "off" or (asked is None and not stored_vectors):
        return "off"
    if cap and nodes > cap:
        return "off"
    return "incremental" if stored_vectors else "full"


def staleness(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """``repo, status``: never indexed, stale or fresh, by the commit that was indexed last and the current one."""
    both = current.select("repo", F.col("commit_id").alias("now")).join(indexed.select("repo", F.col("commit_id").alias("then")), "repo", "left")
    return both.select("repo", F.when(F.col("then").isNull(), "never").when(F.col("then") != F.col("now"), "stale").otherwise("fresh").alias("status"))


def completeness(stages: DataFrame) -> DataFrame:
    """``repo, complete, flags``: what keeps a result of several stages (``repo, stage, status``) from being whole."""
    flag = F.when(F.col("status") == "timeout", "timeout").when(F.col("status") == "skipped", "suppressed-stage").when(F.col("status") != "ok", "incomplete-sync")
    rows = stages.select("repo", flag.alias("flag")).groupBy("repo").agg(F.array_sort(F.collect_set("flag")).alias("flags"))
    return rows.select("repo", (F.size("flags") == 0).alias("complete"), "flags")


def probe(nodes: DataFrame, edges: DataFrame, relation: str, properties: list[str], limit: int = PROBE_ROWS) -> DataFrame:
    """``src, dst`` and properties of both ends of one relation type; one row more than shown tells that there are more."""
    prop = lambda p, side: F.col(f"{side}_props")[p].alias(f"{side}_{p}")
    a, b = (nodes.select(F.col("id").alias(k), F.col("props").alias(f"{k}_props")) for k in ("src", "dst"))
    rows = edges.filter(F.col("type") == relation).select("src", "dst").distinct().join(a, "src").join(b, "dst")
    return rows.select("src", "dst", *[prop(p, side) for side in ("src", "dst") for p in properties]).orderBy("src", "dst").limit(limit)


def config_links(symbols: DataFrame, configs: DataFrame) -> DataFrame:
    """``src, dst, type``: symbols with the configuration nodes of their module that name them, by qualified name."""
    key = ["module", "qualified_name"]
    s = symbols.select(F.col("id").alias("dst"), *key)
    return configs.select(F.col("id").alias("src"), "module", F.explode("names").alias("qualified_name")).join(s, key).select("src", "dst", F.lit("CONFIGURES").alias("type")).distinct()


def embedding_text(label: Column, name: Column, path: Column, description: Column, content: Column, tail: Column | None = None) -> Column:
    """The text that a vector is made of: what a symbol is and where, what is said about it, the end of the piece before, and the piece."""
    line = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.trim(c))
    return F.concat_ws("\n", F.concat_ws(" ", label, name), F.concat(F.lit("in "), path), line(description), *([line(tail)] if tail is not None else []), content)


def declaration_only(content: Column) -> Column:
    """A definition without its body: up to the first opening brace or the colon that ends a line."""
    head = F.regexp_extract(content, r"(?s)^(.*?)(?:\{|:[ \t]*(?:\r?\n|$))", 1)
    return F.trim(F.when(head != "", head).otherwise(content))
