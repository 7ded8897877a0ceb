"""Code-quality presets over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import fan, of_type

# The reference's limits, and names that are called without an edge.
GOD_SLOC, GOD_COMPLEXITY, GOD_FAN_OUT = 50, 10, 8
IMPLICIT = r"^(constructor|main|init|__init__)$|^__.*__$|^(test|setUp|tearDown|beforeEach|afterEach|beforeAll|afterAll)"
TEST_PATH = r"(?i)(^|/)(tests?|__tests__|__mocks__|spec|e2e)/|[._](test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.(py|go)$|Tests?\.(java|kt|cs)$"
UTILITY_PATH = r"/(utils?|helpers?|common|shared|lib)/|/(utils|helpers)\.(ts|js)$|_(utils|helpers)\.py$"


def limited(limit: int) -> int:
    """Preset limits lie between 20 and 500."""
    return min(max(limit, 20), 500)


def implicitly_invoked(name: Column) -> Column:
    return name.rlike(IMPLICIT)


def is_test_file(path: Column) -> Column:
    return F.coalesce(F.regexp_replace(path, r"\\", "/").rlike(TEST_PATH), F.lit(False))


def is_utility_file(path: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(path, r"\\", "/")).rlike(UTILITY_PATH), F.lit(False))


def under(path: Column, prefix: str | None) -> Column:
    """The optional path filter: everything without a prefix."""
    return F.lit(True) if not prefix else path.startswith(prefix)


def high_complexity(nodes: DataFrame, limit: int = 20, prefix: str | None = None) -> DataFrame:
    rows = nodes.filter(F.col("complexity") > 0).filter(under(F.col("file_path"), prefix))
    return rows.select("id", "name", "complexity", "sloc").orderBy(F.desc("complexity"), F.desc("sloc"), "name", "id").limit(limited(limit))


def god_functions(nodes: DataFrame, edges: DataFrame, limit: int = 20, *, sloc: int = GOD_SLOC, complexity: int = GOD_COMPLEXITY, fan_out: int = GOD_FAN_OUT) -> DataFrame:
    big = nodes.filter((F.col("sloc") >= sloc) & (F.col("complexity") >= complexity))
    rows = big.join(fan(of_type(edges, "CALLS")).withColumnRenamed("n", "fan_out"), "id").filter(F.col("fan_out") >= fan_out)
    return rows.select("id", "name", "complexity", "sloc", "fan_out").orderBy(F.desc("complexity"), F.desc("fan_out"), "name", "id").limit(limited(limit))


def hotspots(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    rows = nodes.join(fan(of_type(edges, "CALLS"), "dst").withColumnRenamed("n", "callers"), "id")
    return rows.select("id", "name", "callers").orderBy(F.desc("callers"), "name", "id").limit(limited(limit))


def high_fan_out(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    rows = nodes.join(fan(of_type(edges, "CALLS")).withColumnRenamed("n", "callees"), "id")
    return rows.select("id", "name", "callees").orderBy(F.desc("callees"), "name", "id").limit(limited(limit))


def dead_code(nodes: DataFrame, edges: DataFrame, usage: list[str], registration: list[str], limit: int = 20) -> DataFrame:
    """Callables that are not exported and that nothing uses or registers, without implicit names and test files."""
    used = of_type(edges, *usage).select(F.col("dst").alias("id")).distinct()
    registered = of_type(edges, *registration).select(F.col("src").alias("id")).distinct()
    entries = nodes.filter("entry_point_id is not null").select(F.col("entry_point_id").alias("id")).distinct()
    rows = nodes.filter("is_exported = false").join(used, "id", "left_anti").join(registered, "id", "left_anti").join(entries, "id", "left_anti")
    rows = rows.filter(~implicitly_invoked(F.coalesce("name", F.lit(""))) & ~is_test_file(F.col("file_path")))
    return rows.select("id", "name", "file_path", "start_line").orderBy("file_path", "start_line", "id").limit(limited(limit))


def unused_injections(edges: DataFrame, limit: int = 20) -> DataFrame:
    """``consumer, provider``: injected providers that no method of the consumer calls, itself, by a method or by an interface method."""
    injects = of_type(edges, "INJECTS").select(F.col("src").alias("consumer"), F.col("dst").alias("provider")).distinct()
    methods = of_type(edges, "HAS_METHOD").select(F.col("src").alias("owner"), F.col("dst").alias("method")).distinct()
    calls = of_type(edges, "CALLS").select(F.col("src").alias("caller"), F.col("dst").alias("called")).distinct()
    made = methods.join(calls, F.col("method") == F.col("caller")).select(F.col("owner").alias("consumer"), "called").distinct()
    implements = of_type(edges, "METHOD_IMPLEMENTS").select(F.col("src").alias("method"), F.col("dst").alias("called"))
    own = methods.select(F.col("owner").alias("provider"), F.col("method").alias("called"))
    targets = injects.select("provider").distinct().withColumn("called", F.col("provider")).unionByName(own)
    targets = targets.unionByName(methods.join(implements, "method").select(F.col("owner").alias("provider"), "called")).distinct()
    used = made.join(targets, "called").select("consumer", "provider").distinct()
    return injects.join(used, ["consumer", "provider"], "left_anti").orderBy("consumer", "provider").limit(limited(limit))
