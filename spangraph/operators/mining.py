"""Files that change together, by the reference's rules: commits of at most 50 files, support, strength, partners.

The subpackage for large collections has the version for baskets of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import either_end_top

# The reference's defaults.
MAX_FILES, MIN_SUPPORT, MIN_STRENGTH, TOP_PARTNERS = 50, 3, 0.3, 5


def co_change_pairs(
    commits: DataFrame, *, max_files: int = MAX_FILES, min_support: int = MIN_SUPPORT, min_strength: float = MIN_STRENGTH, indexed: DataFrame | None = None
) -> DataFrame:
    """``file_a, file_b, change_count, strength`` with file_a < file_b.

    Commits over ``max_files`` distinct files are dropped before files that aren't indexed are, so a
    sweeping commit stays one. Strength is the count over the changes of the file that changes less.
    """
    touched = commits.select("commit_id", "file").filter("commit_id is not null and file is not null").distinct()
    sized = touched.groupBy("commit_id").agg(F.count("*").alias("n")).filter(F.col("n") <= max_files)
    touched = touched.join(sized.select("commit_id"), "commit_id")
    if indexed is not None:
        touched = touched.join(indexed.select("file").distinct(), "file", "left_semi")
    changes = touched.groupBy("file").agg(F.count("*").alias("changes"))
    files = touched.groupBy("commit_id").agg(F.array_sort(F.collect_list("file")).alias("files")).filter(F.size("files") > 1)
    one = files.select("files", F.posexplode("files").alias("k", "file_a"))
    pairs = one.select("file_a", F.explode(F.slice("files", F.col("k") + 2, F.size("files"))).alias("file_b"))
    pairs = pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("change_count")).filter(F.col("change_count") >= min_support)
    a, b = (changes.select(F.col("file").alias(f"file_{x}"), F.col("changes").alias(f"n_{x}")) for x in "ab")
    scored = pairs.join(a, "file_a").join(b, "file_b").withColumn("strength", F.col("change_count") / F.least("n_a", "n_b"))
    return scored.filter(F.col("strength") >= min_strength).select("file_a", "file_b", "change_count", "strength")


def keep_top_partners(pairs: DataFrame, n: int = TOP_PARTNERS) -> DataFrame:
    """Pairs that either file keeps among its n best by count, strength and names."""
    return either_end_top(pairs, "file_a", "file_b", [F.desc("change_count"), F.desc("strength"), F.asc("file_a"), F.asc("file_b")], n)


def partners(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """``file, partner, change_count, strength`` of the given files, either direction."""
    both = pairs.select(F.col("file_a").alias("file"), F.col("file_b").alias("partner"), "change_count", "strength").unionAll(
        pairs.select(F.col("file_b").alias("file"), F.col("file_a").alias("partner"), "change_count", "strength")
    )
    return both.join(files.select("file").distinct(), "file", "left_semi")


def missing_partners(pairs: DataFrame, diff: DataFrame, n: int = 5) -> DataFrame:
    """``partner, change_count, strength, with_files``: what usually changes along with a diff and isn't in it.

    A partner of several changed files keeps its busiest pairing and lists all of them.
    """
    found = partners(pairs, diff)
    out = found.join(diff.select(F.col("file").alias("partner")).distinct(), "partner", "left_anti")
    merged = out.groupBy("partner").agg(F.max(F.struct("change_count", "strength")).alias("m"), F.array_sort(F.collect_set("file")).alias("with_files"))
    rows = merged.select("partner", "m.change_count", "m.strength", "with_files")
    return rows.orderBy(F.desc("change_count"), F.desc("strength"), "partner").limit(n)


