"""Queries of the incremental operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import VersionedState, clean_hash, replay
from ..runtime import table, working_path


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "embed_runs").filter("status = 'ok' and run_id is not null").select("run_id").distinct()
    good = [r.run_id for r in runs.collect()]  # one number for each run ever made
    log = table(spark, sf_dir, "cached_embedding_meta").select(
        "run_id", "node_id", "cached_at", "cache_row_id", clean_hash(F.col("content_hash")).alias("content_hash")
    )
    state = VersionedState(spark, working_path(spark, "embed-state"))
    return replay(state, log, good, "run_id", "node_id", ["cached_at", "cache_row_id"], "content_hash")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that each successful run had to process."""
    return _changes(spark, sf_dir).select("run_id", "node_id")


def p5_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the hash that was current at the run."""
    return _changes(spark, sf_dir)


_P5 = """
with good as (select distinct run_id from embed_runs where status = 'ok' and run_id is not null),
log as (
  select m.node_id, m.cached_at, m.cache_row_id, lower(trim(m.content_hash, chr(32) || chr(9) || chr(10) || chr(13))) as h,
         (select min(g.run_id) from good g where g.run_id >= m.run_id) as at_run
  from cached_embedding_meta m where m.node_id is not null and m.run_id is not null),
seen as (
  select node_id, at_run, arg_max(struct_pack(c := cached_at, i := cache_row_id, h := h), struct_pack(c := cached_at, i := cache_row_id)) as top
  from log where at_run is not null group by node_id, at_run),
cur as (
  select node_id, at_run,
         arg_max(top, struct_pack(c := top.c, i := top.i)) over (partition by node_id order by at_run rows unbounded preceding) as now
  from seen),
chg as (select *, lag(now) over (partition by node_id order by at_run) as was from cur)
select {columns} from chg
where was is null or (now.c is distinct from was.c and (now.h is null or was.h is null or now.h <> was.h))
"""

QUERIES = {"p5_found": p5_found, "p5_changes": p5_changes}
ORACLE = {
    "p5_found": _P5.format(columns="at_run as run_id, node_id"),
    "p5_changes": _P5.format(columns="at_run as run_id, node_id, now.h as content_hash"),
}
