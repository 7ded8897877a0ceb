"""Keyword, vector and fused search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import cosine_distance
from .windows import best_per_key, first_wins

# The usual constants of BM25, and the rank constant of the fusion.
K1, B, RRF_K = 1.2, 0.75, 60


def token_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf, length`` of every document; null texts have no terms."""
    words = docs.select(F.col(key), tokens(F.col(text)).alias("w")).withColumn("length", F.size("w"))
    return words.select(key, "length", F.explode("w").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """``key, score`` of the documents with a query term, by Okapi BM25 without stemming.

    Only postings of the query's terms are made: the texts are scanned once for lengths and once for
    those terms, and nothing but them is shuffled.
    """
    terms = sorted({t.lower() for t in query})
    words = docs.select(F.col(key), tokens(F.col(text)).alias("w")).filter("w is not null")
    sized = words.select(key, F.size("w").alias("length"), F.explode(F.filter("w", lambda x: x.isin(terms))).alias("term"))
    tf = sized.groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg")).first()
    n, avg = stats.n or 0, stats.avg or 1.0
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / avg))
    scored = tf.join(F.broadcast(df), "term").select(key, "term", part.alias("s"))  # df has a row a query term
    parts = F.array_sort(F.collect_list(F.struct("term", "s")))
    return scored.groupBy(key).agg(parts.alias("p")).select(key, F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x["s"]).alias("score"))


def bm25_indexes(docs: DataFrame, key: str, fields: dict[str, float], query: list[str], k: int = 200) -> DataFrame:
    """``key, score, best_field`` of a search over several indexes, one a text column with its weight.

    Each index gives its k best, as a query of one index does, and a key has the best of its weighted
    scores; of equal ones the first field in order counts.
    """
    out = None
    for name, weight in fields.items():
        hits = bm25(docs, key, name, query).select(key, (F.col("score") * weight).alias("score"), F.lit(name).alias("best_field"))
        hits = hits.orderBy(F.desc("score"), key).limit(k)
        out = hits if out is None else out.unionByName(hits)
    return first_wins(out, [key], [F.desc("score"), F.asc("best_field")])


def cosine_topk(vectors: DataFrame, key: str, vector: str, anchor: list[float], k: int, max_distance: float = 2.0) -> DataFrame:
    """``key, distance`` of the k nearest vectors within a distance, exact."""
    point = F.array(*[F.lit(float(x)) for x in anchor])
    near = vectors.select(F.col(key), cosine_distance(F.col(vector), point).alias("distance")).filter(F.col("distance") < max_distance)
    return near.orderBy("distance", key).limit(k)


def semantic_nodes(chunks: DataFrame, node: str, vector: str, anchor: list[float], k: int, max_distance: float = 0.5) -> DataFrame:
    """The k nearest nodes, each by its best chunk: one pass instead of fetches that widen."""
    point = F.array(*[F.lit(float(x)) for x in anchor])
    near = chunks.withColumn("distance", cosine_distance(F.col(vector), point)).filter(F.col("distance") < max_distance)
    return best_per_key(near.drop(vector), node, "distance", [c for c in ("chunk_index",) if c in chunks.columns], k)


def ranked(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """The rank of each row of a result list, from 1; for lists that are already cut to a top k."""
    return df.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def rrf(keyword: DataFrame, semantic: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """``key, score, rank, in_keyword, in_semantic``: reciprocal rank fusion of two lists with ``key, rank``.

    In the keyword list a later row of a key replaces the earlier; in the semantic list each counts.
    """
    last = first_wins(keyword.select(key, "rank"), [key], [F.desc("rank")]).select(key, (1 / (RRF_K + F.col("rank"))).alias("s"), F.lit(1).alias("k"), F.lit(0).alias("v"))
    each = semantic.select(key, (1 / (RRF_K + F.col("rank"))).alias("s"), F.lit(0).alias("k"), F.lit(1).alias("v"))
    both = last.unionByName(each).groupBy(key).agg(F.sum("s").alias("score"), (F.max("k") > 0).alias("in_keyword"), (F.max("v") > 0).alias("in_semantic"))
    top = both.orderBy(F.desc("score"), key).limit(limit)
    return ranked(top, [F.desc("score"), F.asc(key)])


def hybrid(keyword, semantic, key: str, limit: int = 10) -> tuple[DataFrame | None, dict[str, str]]:
    """Fusion of two lanes given as functions; a lane that fails is empty and its error is reported."""
    failed, lanes = {}, {}
    for name, lane in (("keyword", keyword), ("semantic", semantic)):
        try:
            lanes[name] = lane()
        except Exception as e:  # a missing index must not take the other lane down
            failed[name] = str(e)
    if not lanes:
        return None, failed
    any_ = next(iter(lanes.values()))
    empty = any_.select(key, "rank").limit(0)
    return rrf(lanes.get("keyword", empty), lanes.get("semantic", empty), key, limit), failed


def process_cards(hits: DataFrame, steps: DataFrame, *, per_process: int = 10) -> DataFrame:
    """``process, id, step, score, with_content``: the best hits of each process, content with a symbol's first row only.

    ``hits`` has ``id, score``, ``steps`` has ``id, process, step``; one row an (id, process).
    """
    once = first_wins(steps.select("id", "process", "step"), ["id", "process"], [F.asc("step")])
    rows = once.join(hits.select("id", "score"), "id")
    w = Window.partitionBy("process").orderBy(F.desc("score"), "step", "id")
    rows = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_process).drop("_r")
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "process")) == 1
    return rows.withColumn("with_content", first)


def augment(nodes: DataFrame, edges: DataFrame, pattern: str, *, symbols: int = 5, neighbours: int = 3, steps: DataFrame | None = None, cohesion: DataFrame | None = None) -> DataFrame:
    """What surrounds the symbols that a pattern names: an exact name first, else a full-text search of names and descriptions, else names that contain it.

    ``id, name, file_path, callers, callees, n_callers, n_callees``; neighbours that are files come last. With
    ``steps`` (``id, process``) also ``processes``, the flows that a symbol is a step of. With ``cohesion``
    (``id, cohesion``, that of a symbol's community) also ``place``, the rank by it, which is the order of the answer.
    """
    found = nodes.filter(F.col("name") == pattern).select("id", "name", "file_path")
    if not found.limit(1).count():
        terms = [t for t in re.findall(r"[^\W_]+", pattern.lower()) if t]
        indexed = [c for c in ("name", "description") if c in nodes.columns]
        ids = bm25_indexes(nodes, "id", dict.fromkeys(indexed, 1.0), terms, symbols).orderBy(F.desc("score"), "id").limit(symbols).select("id") if terms else nodes.select("id").limit(0)
        found = nodes.join(ids, "id", "left_semi").select("id", "name", "file_path")
        if not found.limit(1).count():
            found = nodes.filter(F.col("name").contains(pattern)).select("id", "name", "file_path")
    hits = found.orderBy("id").limit(symbols)
    calls = edges.filter("type = 'CALLS'").select("src", "dst").distinct()
    out = hits
    for label, own, other in (("callers", "dst", "src"), ("callees", "src", "dst")):
        near = calls.join(hits.select(F.col("id").alias(own)), own)
        total = near.groupBy(F.col(own).alias("id")).agg(F.count("*").alias(f"n_{label}"))
        w = Window.partitionBy(own).orderBy(F.col(other).startswith("File:"), F.col(other))
        top = near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= neighbours)
        listed = top.groupBy(F.col(own).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(other).alias("o")))), lambda x: x["o"]).alias(label))
        out = out.join(listed, "id", "left").join(total, "id", "left").fillna(0, [f"n_{label}"])
    if steps is not None:
        flows = steps.join(hits.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("process")).alias("processes"))
        out = out.join(flows, "id", "left")
    if cohesion is not None:
        own = cohesion.join(hits.select("id"), "id", "left_semi").groupBy("id").agg(F.max("cohesion").alias("_c"))
        out = ranked(out.join(own, "id", "left"), [F.desc_nulls_last("_c"), F.asc("id")], "place").drop("_c")
    return out
