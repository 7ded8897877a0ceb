"""Named queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialise, table
from .chunking import current_long_texts, split_text
from .cooccurrence import pair_counts, plain_path
from .handwritten import judged_files, not_handwritten
from .lookalike import consistent, same_looking_pairs
from .mixing import mix, shares
from .neighbours import nearest, referenced_vectors
from .oracle import ORACLE  # noqa: F401
from .tokenizer import decode, encode, token_counts
from .topn import top_partners


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar vectors of other nodes with a cosine of 0.88 or more, of each referenced vector."""
    vectors = referenced_vectors(table(spark, sf_dir, "spill_vectors"), table(spark, sf_dir, "embedding_vector_spill"), table(spark, sf_dir, "cached_embedding_meta"))
    return nearest(vectors, k=5, least=0.88)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which one takes the other as one of its nearest."""
    near = p1_neighbours(spark, sf_dir)
    return near.select(F.least("id", "other").alias("vector_a"), F.greatest("id", "other").alias("vector_b")).distinct()


def p6_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all node contents over 1,200 characters, with up to 120 characters of overlap."""
    return split_text(current_long_texts(table(spark, sf_dir, "nodes"), 1200), "id", "content", "start_line").withColumnRenamed("id", "node_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that come out as more than one piece."""
    return p6_chunks(spark, sf_dir).filter("chunk_index > 0").select("node_id").distinct()


def p6_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cut text put together again from its pieces, as a digest, and whether limit and overlap were kept."""
    pieces = split_text(current_long_texts(table(spark, sf_dir, "nodes"), 1200), "id", "content", offsets=True)
    before = F.lag("end_offset").over(Window.partitionBy("id").orderBy("chunk_index"))
    pieces = pieces.withColumn("before", F.coalesce(before, F.lit(0)))
    new = F.substring("text", F.col("before") - F.col("start_offset") + 1, F.length("text"))
    parts = pieces.groupBy(F.col("id").alias("node_id")).agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", new.alias("t")))).alias("p"), (F.max(F.length("text")) <= 1200).alias("within_limit"),
        (F.max(F.col("before") - F.col("start_offset")) <= 120).alias("within_overlap"), F.min(F.col("start_offset") <= F.col("before")).alias("no_gap"),
    )
    return parts.select("node_id", F.md5(F.array_join(F.transform("p", lambda x: x["t"]), "")).alias("whole"), "within_limit", "within_overlap", "no_gap")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text back from its ids; null comes back as the empty text."""
    return decode(p7_ids(spark, sf_dir), "ids")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned files that are generated, minified, third-party or data."""
    return not_handwritten(table(spark, sf_dir, "why_ignored_result"), table(spark, sf_dir, "nodes"))


def p2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scanned file with the rule it was found by, null for hand-written ones."""
    return judged_files(table(spark, sf_dir, "why_ignored_result"), table(spark, sf_dir, "nodes"))


#: Files of a chunk: far below the limit of 50 files, so that ordinary commits too go by chunk pairs.
P3_BLOCK = 16


def p3_pairs(spark: SparkSession, sf_dir: str, max_basket: int | None = 50, **limits) -> DataFrame:
    commits = table(spark, sf_dir, "commits").select("repo", "commit_id", plain_path(F.col("file")).alias("file"))
    return pair_counts(commits, "repo", "commit_id", "file", max_basket=max_basket, block=P3_BLOCK, **limits)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files that at least 5 commits change together, 3 times as often as chance or more."""
    return p3_pairs(spark, sf_dir, min_count=5, min_lift=3.0).select(F.col("scope").alias("repo"), F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))


def p3_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, strength and lift of the pairs that reach the default option set's support and strength."""
    found = p3_pairs(spark, sf_dir, min_count=3).filter("strength >= 0.3")
    return found.select(
        F.col("scope").alias("repo"), F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"),
        F.col("count").alias("change_count"), F.round("strength", 6).alias("strength"), F.round("lift", 6).alias("lift"),
    )


def p3_sweeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a count of 5 and a lift of 3 or more over all commits, sweeping ones of any size included."""
    found = p3_pairs(spark, sf_dir, max_basket=None, min_count=5, min_lift=3.0)
    return found.select(F.col("scope").alias("repo"), F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"), F.col("count").alias("change_count"), F.round("lift", 6).alias("lift"))


def p4_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_partners(table(spark, sf_dir, "co_change_pair"), table(spark, sf_dir, "co_change_options"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top partners of each file."""
    return p4_top(spark, sf_dir).select("repo", "file_a", "file_b")


def p4_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with strength, count and rank."""
    return p4_top(spark, sf_dir).select("repo", "file_a", "file_b", "strength", "change_count", "rank")


def _mix(spark: SparkSession, sf_dir: str, short: str = "leave") -> tuple[DataFrame, DataFrame]:
    docs = token_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    return mix(materialise(docs, "sizes"), table(spark, sf_dir, "mix_targets"), short=short)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document occurs in the mix, sizes in tokens of byte_bpe_50k."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the sources reach."""
    return shares(*_mix(spark, sf_dir))


def p8_shares_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the total is lowered until all sources that have documents keep the proportions of their targets."""
    return shares(*_mix(spark, sf_dir, "shrink"))


def p9_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its consistent form."""
    return consistent(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", F.col("consistent").alias("text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same and differ in their characters."""
    docs = consistent(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    docs = docs.filter("doc_id is not null and consistent rlike '\\\\S'").select("doc_id", "look", "exact")
    return same_looking_pairs(materialise(docs, "looks"), "doc_id").distinct()


QUERIES = {
    "p1_found": p1_found, "p1_neighbours": p1_neighbours,
    "p2_found": p2_found, "p2_rules": p2_rules, "p3_found": p3_found, "p3_strength": p3_strength, "p3_sweeping": p3_sweeping, "p4_found": p4_found, "p4_ranked": p4_ranked,
    "p6_found": p6_found, "p6_chunks": p6_chunks, "p6_rebuilt": p6_rebuilt, "p7_ids": p7_ids, "p7_decoded": p7_decoded,
    "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_shares_held": p8_shares_held, "p9_found": p9_found, "p9_consistent": p9_consistent,
}
