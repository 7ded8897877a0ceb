"""Folders, Markdown sections and links, tools, ORM queries: graph rows from paths and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import first_wins


def folder_tree(paths: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Folder and File nodes of all cumulative paths, and a CONTAINS edge from each to what it holds."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    rows = paths.select(parts.alias("p")).filter("size(p) > 0").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.size("p"))))
    kind = F.when(F.col("k") == F.size("p"), "File").otherwise("Folder")
    full = F.array_join(F.slice("p", F.lit(1), F.col("k")), "/")
    up = F.array_join(F.slice("p", F.lit(1), F.col("k") - 1), "/")
    rows = rows.select(kind.alias("label"), full.alias("file_path"), F.get("p", F.col("k") - 1).alias("name"), F.when(F.col("k") > 1, up).alias("parent")).distinct()
    ident = F.concat("label", F.lit(":"), "file_path")
    nodes = rows.select(ident.alias("id"), "label", "name", "file_path")
    edges = rows.filter("parent is not null").select(F.concat(F.lit("Folder:"), "parent").alias("src"), ident.alias("dst"), F.lit("CONTAINS").alias("type"), F.lit(1.0).alias("confidence"))
    return nodes, edges


def markdown_sections(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``file, level, heading, line, end_line, parent_line`` of every heading, lines from 1.

    A section ends before the next heading of its level or a higher one; its parent is the nearest
    heading before it of a lower level number. Both are windows over the file's headings: with six
    levels, the next and the last line of each level are running minima and maxima.
    """
    lines = files.select(F.col(path).alias("file"), F.split(F.col(text), "\r\n|\r|\n").alias("ls")).filter("ls is not null")
    lines = lines.select("file", F.size("ls").alias("n"), F.posexplode("ls").alias("k", "t"))
    heads = lines.select("file", "n", (F.col("k") + 1).alias("line"), F.length(F.regexp_extract("t", r"^(#{1,6})\s+.+$", 1)).alias("level"), F.trim(F.regexp_extract("t", r"^#{1,6}\s+(.+)$", 1)).alias("heading"))
    heads = heads.filter("level > 0")
    after = Window.partitionBy("file").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    nexts = [F.min(F.when(F.col("level") == q, F.col("line"))).over(after) for q in range(1, 7)]
    lasts = [F.max(F.when(F.col("level") == q, F.col("line"))).over(before) for q in range(1, 7)]
    rows = heads.withColumn("_n", F.array(*nexts)).withColumn("_l", F.array(*lasts))
    end = F.coalesce(F.array_min(F.slice("_n", F.lit(1), F.col("level"))) - 1, F.col("n"))
    parent = F.array_max(F.slice("_l", F.lit(1), F.col("level") - 1))
    return rows.select("file", "level", "heading", "line", end.alias("end_line"), parent.alias("parent_line"))


def markdown_links(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``file, target, confidence``: IMPORTS edges of relative links to files that exist."""
    found = files.select(F.col(path).alias("file"), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\[[^\]]*\]\(([^)\s#]+)[^)]*\)"), F.lit(1))).alias("href"))
    found = found.filter(~F.col("href").rlike(r"^([a-z][a-z0-9+.-]*:|//)"))
    folder = F.regexp_replace("file", r"[^/]*$", "")
    full = F.when(F.col("href").startswith("/"), F.substring("href", 2, 1_000_000)).otherwise(F.concat(folder, "href"))
    # resolve . and .. by going through the segments once
    walk = F.aggregate(
        F.filter(F.split(full, "/"), lambda x: (x != "") & (x != ".")), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    links = found.select("file", F.array_join(walk, "/").alias("target")).distinct().filter("file <> target")
    return links.join(files.select(F.col(path).alias("target")).distinct(), "target", "left_semi").select("file", "target", F.lit(0.8).alias("confidence"))


def tool_definitions(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``name, description, file``: tools that code defines by name and description; the first file in order wins."""
    pattern = r"name:\s*['\"]([\w-]+)['\"]\s*,\s*description:\s*[`'\"]([^`'\"]*)"
    found = files.select(F.col(path).alias("file"), F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2)).alias("d")).alias("z"))
    rows = found.select("file", F.posexplode("z").alias("k", "z")).select("file", "k", F.col("z.n").alias("name"), F.substring("z.d", 1, 200).alias("description"))
    return first_wins(rows, ["name"], [F.asc("file"), F.asc("k")]).select("name", "description", "file")


def orm_queries(queries: DataFrame, nodes: DataFrame, priority: list[str]) -> DataFrame:
    """``file, model, method, target, confidence``: each query with the model's node of the first label that has one, else a made-up id."""
    models = nodes.filter(F.col("label").isin(priority)).select(F.col("name").alias("model"), "id", F.array_position(F.array(*map(F.lit, priority)), F.col("label")).alias("p"))
    best = models.groupBy("model").agg(F.min(F.struct("p", "id")).alias("m"))
    rows = queries.select("file", "model", "method").distinct().join(best, "model", "left")
    return rows.select("file", "model", "method", F.coalesce("m.id", F.concat(F.lit("CodeElement:"), "model")).alias("target"), F.lit(0.9).alias("confidence"))


def entry_point_links(processes: DataFrame, handlers: DataFrame) -> DataFrame:
    """``process, target, confidence``: a process with the routes or tools that its entry point handles.

    ``processes`` has ``process, entry, file``; ``handlers`` has ``target, handler, file``. The file
    decides only for targets without a handler.
    """
    exact = processes.join(handlers.filter("handler is not null").select("target", F.col("handler").alias("entry")), "entry").select("process", "target")
    by_file = processes.join(handlers.filter("handler is null").select("target", "file"), "file").select("process", "target")
    return exact.unionByName(by_file).distinct().withColumn("confidence", F.lit(0.85))


def prune_locals(nodes: DataFrame, edges: DataFrame, labels: tuple[str, ...] = ("Const", "Variable", "Static")) -> DataFrame:
    """Nodes without block-scoped locals that nothing but their file's DEFINES edge touches."""
    local = nodes.filter(F.col("label").isin(*labels) & (F.coalesce(F.col("props")["scope"], F.lit("")) == "block"))
    other = edges.filter(~((F.col("type") == "DEFINES") & F.col("src").startswith("File:")))
    used = other.select(F.col("src").alias("id")).unionAll(other.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(local.join(used, "id", "left_anti").select("id"), "id", "left_anti")
