"""The code graph that the star-schema tables stand for, for both engines.

World contains regions, these nations, these customers, these orders; suppliers call parts and parts
call orders, as line items say. Current nodes are the latest versions in ``nodes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import first_wins
from ..runtime import table


def _id(label: str, key: str):
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        table(spark, d, t).select(_id(label, k).alias("id"), F.lit(label).alias("label"), F.col(n).alias("name"))
        for t, label, k, n in [
            ("region", "Region", "r_regionkey", "r_name"), ("nation", "Nation", "n_nationkey", "n_name"), ("customer", "Customer", "c_custkey", "c_name"),
            ("supplier", "Supplier", "s_suppkey", "s_name"), ("part", "Part", "p_partkey", "p_name"), ("orders", "Order", "o_orderkey", "o_orderpriority"),
        ]
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contains(spark: SparkSession, d: str) -> DataFrame:
    edge = lambda t, a, b: table(spark, d, t).select(a.alias("src"), b.alias("dst"), F.lit("CONTAINS").alias("type"))
    return (
        edge("region", F.lit("World:0"), _id("Region", "r_regionkey"))
        .unionByName(edge("nation", _id("Region", "n_regionkey"), _id("Nation", "n_nationkey")))
        .unionByName(edge("customer", _id("Nation", "c_nationkey"), _id("Customer", "c_custkey")))
        .unionByName(edge("orders", _id("Customer", "o_custkey"), _id("Order", "o_orderkey")))
    )


def supplies(spark: SparkSession, d: str) -> DataFrame:
    """CALLS edges from supplier to part."""
    return table(spark, d, "lineitem").select(_id("Supplier", "l_suppkey").alias("src"), _id("Part", "l_partkey").alias("dst"), F.lit("CALLS").alias("type")).distinct()


def calls(spark: SparkSession, d: str) -> DataFrame:
    sold = table(spark, d, "lineitem").select(_id("Part", "l_partkey").alias("src"), _id("Order", "l_orderkey").alias("dst"), F.lit("CALLS").alias("type")).distinct()
    return supplies(spark, d).unionByName(sold)


def current_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The version of each node that counts; of equally late ones the first in content order."""
    nodes = table(spark, d, "nodes").filter("id is not null")
    return first_wins(nodes, ["id"], [F.desc_nulls_last("indexed_at"), F.asc_nulls_last("content"), F.asc_nulls_last("name"), F.asc_nulls_last("complexity")])


NODES_SQL = """nodes_(id, label, name) as (
  select 'Region:' || r_regionkey, 'Region', r_name from region union all
  select 'Nation:' || n_nationkey, 'Nation', n_name from nation union all
  select 'Customer:' || c_custkey, 'Customer', c_name from customer union all
  select 'Supplier:' || s_suppkey, 'Supplier', s_name from supplier union all
  select 'Part:' || p_partkey, 'Part', p_name from part union all
  select 'Order:' || o_orderkey, 'Order', o_orderpriority from orders)"""

CONTAINS_SQL = """contains_(src, dst, type) as (
  select 'World:0', 'Region:' || r_regionkey, 'CONTAINS' from region union all
  select 'Region:' || n_regionkey, 'Nation:' || n_nationkey, 'CONTAINS' from nation union all
  select 'Nation:' || c_nationkey, 'Customer:' || c_custkey, 'CONTAINS' from customer union all
  select 'Customer:' || o_custkey, 'Order:' || o_orderkey, 'CONTAINS' from orders)"""

SUPPLIES_SQL = """supplies_(src, dst, type) as (
  select distinct 'Supplier:' || l_suppkey, 'Part:' || l_partkey, 'CALLS' from lineitem)"""

CALLS_SQL = SUPPLIES_SQL + """,
calls_(src, dst, type) as (
  select * from supplies_ union all
  select distinct 'Part:' || l_partkey, 'Order:' || l_orderkey, 'CALLS' from lineitem)"""

CURRENT_SQL = """cur as (
  select * from nodes where id is not null
  qualify row_number() over (partition by id order by indexed_at desc nulls last, content nulls last, name nulls last, complexity nulls last) = 1)"""
