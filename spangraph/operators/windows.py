"""Per-group choices that the reference makes in loops, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row that comes first in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def first_n(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """Of each group the first n rows, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)


def page(df: DataFrame, group: list[str], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The same page of every group; the limit is brought into 1 to 10,000 and the offset to 0 or more."""
    limit, offset = min(max(limit, 1), 10_000), max(offset, 0)
    r = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_r", r).filter((F.col("_r") > offset) & (F.col("_r") <= offset + limit)).drop("_r")


def either_end_top(pairs: DataFrame, a: str, b: str, order: list[Column], n: int) -> DataFrame:
    """Pairs that are among the first n of at least one of their ends, which is what a greedy pass with n slots an end keeps."""
    cols = pairs.columns
    ends = pairs.select(*cols, F.explode(F.array(F.col(a), F.col(b))).alias("_end"))
    ranked = ends.withColumn("_r", F.row_number().over(Window.partitionBy("_end").orderBy(*order)))
    return ranked.filter(F.col("_r") <= n).select(*cols).distinct()


def summed_best(df: DataFrame, group: str, score: str, ident: str, n: int = 3) -> DataFrame:
    """``group, score, ids``: sum of the n best scores and their ids, best first; added up in that order."""
    top = first_n(df.select(group, score, ident), [group], [F.desc(score), F.asc(ident)], n)
    parts = F.array_sort(F.collect_list(F.struct("rank", F.col(score).alias("s"), F.col(ident).alias("i"))))
    return top.groupBy(group).agg(parts.alias("p")).select(
        group, F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x["s"]).alias(score), F.transform("p", lambda x: x["i"]).alias("ids")
    )


def best_per_key(df: DataFrame, key: str, distance: str, tie: list[str], most: int | None = None) -> DataFrame:
    """The nearest row of each key, and of these the ``most`` nearest."""
    best = first_wins(df, [key], [F.asc(distance), *[F.asc(t) for t in tie]])
    return best if most is None else best.orderBy(distance, key).limit(most)
