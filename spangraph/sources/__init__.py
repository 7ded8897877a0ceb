"""Sources and sinks: repository files, git history, routed edge files, contract registries."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COMMITS, CONTRACTS

MAX_FILE_BYTES = 512 * 1024
# How far back the history is read, and the mark between commits.
MAX_COMMITS, TIMEOUT_S, MARK = 2000, 15, "\u0001"


def scan_files(spark: SparkSession, root: str, ignore: str | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``path, size`` of the regular files below a folder in path order, without ``.d.ts`` files beside their source.

    Only names and sizes are read: the content column isn't selected, so it is not loaded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(base) + "/", "")
    rows = files.select(rel.alias("path"), F.col("length").alias("size")).filter(F.col("size") <= max_bytes)
    if ignore:
        rows = rows.filter(~F.col("path").rlike(ignore))
    sources = rows.filter("path rlike '\\\\.tsx?$' and not path like '%.d.ts'")
    twins = sources.select(F.regexp_replace("path", r"\.tsx?$", ".d.ts").alias("path")).distinct()
    return rows.join(twins, "path", "left_anti").orderBy("path")


def bounded_count(df: DataFrame, limit: int) -> int:
    """The number of rows, or limit + 1 if there are more."""
    return df.limit(limit + 1).count()


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of whole files."""
    return spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def git_log(spark: SparkSession, repo: str, max_commits: int = MAX_COMMITS) -> DataFrame | None:
    """``commit_id, file`` of the last non-merge commits; None without git, a repository or time."""
    call = ["git", "-C", repo, "log", f"-n{max_commits}", "--no-merges", "--no-renames", "--name-only", "--relative", f"--format={MARK}%H"]
    try:
        text = subprocess.run(call, capture_output=True, text=True, timeout=TIMEOUT_S, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None
    return parse_git_log(spark.createDataFrame([(text,)], "log string"))


def parse_git_log(logs: DataFrame, log: str = "log") -> DataFrame:
    """``commit_id, file`` of log texts: commits begin with the mark, blank lines and empty commits have no rows."""
    parts = logs.select(F.explode(F.split(F.col(log), MARK)).alias("c"))
    lines = parts.select(F.transform(F.split("c", r"\r?\n"), lambda x: F.trim(x)).alias("ls"))
    rows = lines.select(F.get("ls", F.lit(0)).alias("commit_id"), F.explode(F.slice("ls", F.lit(2), F.size("ls"))).alias("file"))
    return rows.filter("commit_id <> '' and file <> ''").select(*COMMITS.fieldNames())


def write_edges_by_label(edges: DataFrame, path: str, form: str = "csv") -> None:
    """Edges in one folder for each pair of end labels, the labels taken from the ids."""
    of = lambda c: F.when(F.col(c).startswith("comm_"), "Community").when(F.col(c).startswith("proc_"), "Process").otherwise(F.substring_index(F.col(c), ":", 1))
    flat = edges.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in edges.dtypes])
    flat.withColumns({"from_label": of("src"), "to_label": of("dst")}).write.mode("overwrite").option("header", True).partitionBy("from_label", "to_label").format(form).save(path)


def write_contracts(contracts: DataFrame, path: str) -> None:
    contracts.write.mode("overwrite").json(path)


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTRACTS).json(path)


def group_config(spark: SparkSession, text: str) -> DataFrame:
    """``repo, path, service`` of a group file: two levels of ``key: value`` lines under ``repos:``, as such files have."""
    rows, repo, within = [], None, False
    for line in text.splitlines():
        bare = line.split("#")[0].rstrip()
        if not bare.strip():
            continue
        depth, (key, _, value) = len(bare) - len(bare.lstrip()), bare.strip().partition(":")
        value = value.strip().strip("'\"")
        if depth == 0:
            within = key == "repos"
        elif within and not value:
            repo = {"repo": key, "path": None, "service": None}
            rows.append(repo)
        elif within and value and (repo is None or depth <= 2):
            rows.append({"repo": key, "path": value, "service": None})
            repo = None
        elif within and repo is not None and key in repo:
            repo[key] = value
    if not rows:
        raise ValueError("a group needs repos")
    return spark.createDataFrame([(r["repo"], r["path"], r["service"]) for r in rows], "repo string, path string, service string")


# Relation types of program dependence, which are written apart from the graph.
DEPENDENCE_TYPES = ["CFG", "CDG", "REACHING_DEF", "TAINTED", "SANITIZES", "TAINT_PATH"]


def write_dependence(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write blocks and dependence edges, edges in one folder a type, and return the rest of the graph."""
    block, dependence = F.col("label") == "BasicBlock", F.col("type").isin(DEPENDENCE_TYPES)
    nodes.filter(block).write.mode("overwrite").parquet(f"{path}/blocks")
    edges.filter(dependence).write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    return nodes.filter(~block), edges.filter(~dependence)


# Files that make their folder a service.
SERVICE_MARKS = ["package.json", "go.mod", "pom.xml", "build.gradle", "Cargo.toml", "pyproject.toml", "requirements.txt", "Dockerfile"]


def service_roots(files: DataFrame, path: str = "path") -> DataFrame:
    """``root, service``: folders with a file that marks a service; the service has the folder's name. The root folder is none."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    marked = files.filter(F.element_at(F.split(path, "/"), -1).isin(SERVICE_MARKS)).select(folder.alias("root")).filter("root <> ''").distinct()
    return marked.select("root", F.element_at(F.split("root", "/"), -1).alias("service"))


def thrift_contracts(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``file, contract_id``: methods of the services in Thrift sources, under the namespace of the file if it has one."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), r"(?s)/\*.*?\*/", " "), r"(?m)(//|#).*$", "")
    space = F.regexp_extract(plain, r"(?m)^\s*namespace\s+\S+\s+([\w.]+)", 1)
    services = F.arrays_zip(F.regexp_extract_all(plain, F.lit(r"service\s+(\w+)[^{]*\{([^}]*)\}"), F.lit(1)).alias("n"), F.regexp_extract_all(plain, F.lit(r"service\s+(\w+)[^{]*\{([^}]*)\}"), F.lit(2)).alias("b"))
    rows = files.filter(F.col(path).endswith(".thrift")).select(F.col(path).alias("file"), space.alias("s"), F.explode(services).alias("z"))
    rows = rows.select("file", F.when(F.col("s") != "", F.concat_ws(".", "s", "z.n")).otherwise(F.col("z.n")).alias("service"), F.explode(F.regexp_extract_all("z.b", F.lit(r"(\w+)\s*\([^()]*\)\s*(?:throws\s*\([^()]*\))?\s*[,;]?"), F.lit(1))).alias("method"))
    return rows.filter("method <> 'throws'").select("file", F.concat(F.lit("thrift::"), "service", F.lit("/"), "method").alias("contract_id")).distinct()
