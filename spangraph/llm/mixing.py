"""Mixing sources to target weights with whole copies of whole documents.

The mix has a total size in tokens (by default that of all documents of the listed sources). A
source's factor is what its target share of the total needs, divided by what the source has, and at
most its ``max_repeats``. Each of its documents gets the whole part of the factor as copies; the
fractional part becomes 0 or 1 by pivotal rounding: two documents with open probabilities meet, mass
moves at random from one to the other until one of them is integral, and the other stays open.

Documents meet in a tree. Its leaves are buckets of a source by a hash of the key, about BUCKET
documents each, however the rows are spread over the cluster. In a bucket neighbours in the order
of size meet, and those that stay open meet again, until one is left; all pairs of a round at once.
The open documents of a source's buckets meet in the same way in nodes of FAN_IN, again in the order
of their sizes, level by level, and the last one of a source is drawn by its probability. As it is
documents of like size that meet, the drawn size stays close to the expected one. Every document keeps
exactly its expected number of copies, and the number of copies of a source is off by less than 1.

Draws depend on the seed and the documents alone: neither partitions nor repeated tasks change the mix.

Defined results: documents without a key, without a source, of a source that isn't listed, or without
a token take no part; a source without documents or too small even at ``max_repeats`` gives all it
may. With ``short="leave"`` its missing share isn't given to others: among the sources that reach their share,
proportions are those of the targets. With ``short="shrink"`` the total is lowered until every source that has
documents reaches its share, so all of them keep the targets' proportions. Null or negative shares
and repeats count as 0; of several rows of one source the greatest values hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise

#: Documents of a source that settle together, about; and open documents that one node of the tree takes.
BUCKET, FAN_IN = 20_000, 16
#: Targets are sent to every task only while there are no more rows of them than this.
MOST_BROADCAST = 100_000
#: A probability this close to 0 or 1 is rounding.
EPS = 1e-9


def _uniform(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on two hashes and the round (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(step)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def meet(a: np.ndarray, b: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two open probabilities each after they have met: one of them is 0 or 1 now, their sum is as before."""
    both = a + b
    low = both < 1
    # below 1 one gives all it has to the other, else one takes what it lacks for 1
    first = np.where(low, u * both < b, u * (2 - both) < 1 - b)
    full = np.where(low, 0.0, 1.0)
    rest = both - full
    return np.where(first, full, rest), np.where(first, rest, full)


def settle(group: np.ndarray, p: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Probabilities after pivotal rounding within each group of neighbouring rows; at most one a group stays open."""
    p = p.astype(np.float64).copy()
    p[p < EPS], p[p > 1 - EPS] = 0.0, 1.0
    open_, step = np.flatnonzero((p > 0) & (p < 1)), 0
    while len(open_) > 1:
        g = group[open_]
        begin = np.concatenate(([True], g[1:] != g[:-1]))
        place = np.arange(len(g))
        place -= np.maximum.accumulate(np.where(begin, place, 0))
        left = np.flatnonzero((place[:-1] % 2 == 0) & ~begin[1:])
        if not len(left):
            break
        a, b = open_[left], open_[left + 1]
        p[a], p[b] = meet(p[a], p[b], _uniform(hashes[a], hashes[b], step))
        p[p < EPS], p[p > 1 - EPS] = 0.0, 1.0
        open_, step = open_[(p[open_] > 0) & (p[open_] < 1)], step + 1
    return p


def factors(docs: DataFrame, targets: DataFrame, total: float | None = None, short: str = "leave") -> DataFrame:
    """``source, target_share, max_repeats, available_docs, available_tokens, total, factor``, one row a listed source."""
    if short not in ("leave", "shrink"):
        raise ValueError("short is leave or shrink")
    share = F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share")
    targets = targets.filter("source is not null").groupBy("source").agg(share, F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    have = docs.groupBy("source").agg(F.count("*").alias("available_docs"), F.sum("n_tokens").alias("available_tokens"))
    rows = targets.join(have, "source", "left").fillna(0, ["available_docs", "available_tokens"])
    if total is None:
        total = rows.agg(F.sum("available_tokens").alias("t")).first().t or 0
    if short == "shrink":
        most = F.col("available_tokens") * F.col("max_repeats") / F.col("target_share")
        least = rows.filter("target_share > 0 and available_tokens > 0 and max_repeats > 0").agg(F.min(most).alias("t")).first().t
        total = min(total, least or 0)
    rows = rows.withColumn("total", F.lit(float(total)))
    need = F.col("target_share") * F.col("total") / F.col("available_tokens")
    return rows.withColumn("factor", F.when(F.col("available_tokens") > 0, F.least(need, F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)))


def mix(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", total: float | None = None, seed: int = 1, short: str = "leave") -> tuple[DataFrame, DataFrame]:
    """The mix (``key, source, n_tokens, copies``, copies over 0) and the factors behind it.

    ``docs`` has ``key, source, n_tokens``; ``targets`` has ``source, target_share, max_repeats``.
    """
    docs = docs.select(key, "source", "n_tokens").filter(F.col(key).isNotNull() & F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    plan = materialise(factors(docs, targets, total, short).coalesce(1), "mix-factors")
    small = plan.select("source", "factor", F.greatest(F.ceil(F.col("available_docs") / BUCKET), F.lit(1)).alias("buckets"))
    if plan.count() <= MOST_BROADCAST:
        small = F.broadcast(small)
    names = [key, "source", "n_tokens", "copies", "hash", "node", "open"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, source string, n_tokens long, copies long, hash long, node long, open double"

    shared = docs.join(small, "source").filter("factor > 0")
    shared = shared.withColumn("hash", F.xxhash64(F.lit(seed), F.col(key).cast("string")))
    whole = F.floor(F.col("factor") + EPS)
    shared = shared.withColumn("copies", whole.cast("long")).withColumn("node", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key).cast("string")), F.col("buckets").cast("long")))
    still = shared.withColumn("open", F.greatest(F.col("factor") - whole, F.lit(0.0))).select(*names)

    def settle_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by source, node and size; the last group of a batch waits for the next batch."""
        waiting: pa.Table | None = None

        def done(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
            p = settle(group, rows["open"].to_numpy(), rows["hash"].to_numpy().view(np.uint64))
            is_open = (p > 0) & (p < 1)
            copies = rows["copies"].to_numpy() + np.where(is_open, 0, np.rint(p)).astype(np.int64)
            rows = rows.set_column(names.index("copies"), "copies", pa.array(copies))
            yield from rows.set_column(names.index("open"), "open", pa.array(p, mask=~is_open)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows]).combine_chunks()
            group = _groups(rows)
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield from done(rows.slice(0, cut), group[:cut])
            waiting = rows.slice(cut)
        if waiting is not None:
            yield from done(waiting, np.zeros(len(waiting), dtype=np.int64))

    parts, level = [], 0
    while True:
        ordered = still.repartition("source", "node").sortWithinPartitions("source", "node", "n_tokens", key)
        settled = materialise(ordered.mapInArrow(settle_nodes, schema), f"mix-{level}")
        parts.append(settled.filter("open is null"))
        still, level = settled.filter("open is not null"), level + 1
        most = still.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
        if most <= 1:
            break
        # at most one document a bucket is left, a BUCKET-th of a source
        place = F.row_number().over(Window.partitionBy("source").orderBy("n_tokens", key))
        still = still.withColumn("node", F.floor((place - 1) / FAN_IN)).select(*names)
    draw = F.pmod("hash", F.lit(1 << 40)) / float(1 << 40)
    mixed = still.withColumn("copies", F.col("copies") + (draw < F.col("open")).cast("int"))
    for p in parts:
        mixed = mixed.unionByName(p)
    return mixed.filter("copies > 0").select(key, "source", "n_tokens", "copies"), plan


def _groups(rows: pa.Table) -> np.ndarray:
    """Running number of the (source, node) of sorted rows."""
    source = rows["source"].combine_chunks().dictionary_encode().indices.to_numpy()
    node = rows["node"].to_numpy()
    return np.concatenate(([0], np.cumsum((source[1:] != source[:-1]) | (node[1:] != node[:-1]))))


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """What each listed source makes up of the mix, and whether its share could be reached.

    ``share_of_total`` is measured against the total asked for, ``share_of_mix`` against the tokens
    the mix has in the end; they differ by what sources that can't reach their share leave open.
    """
    got = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    rows = plan.join(got, "source", "left").fillna(0, ["mixed_tokens", "most_copies"])
    whole = rows.agg(F.sum("mixed_tokens").alias("t")).first().t or 0
    reachable = F.col("available_tokens") * F.col("max_repeats") >= F.col("target_share") * F.col("total")
    return rows.select(
        "source", "target_share", "max_repeats", "available_docs", "available_tokens", "mixed_tokens", "most_copies",
        F.round(F.col("mixed_tokens") / F.col("total"), 6).alias("share_of_total"), F.round(F.col("mixed_tokens") / F.lit(float(whole)), 6).alias("share_of_mix"), reachable.alias("reachable"),
    )
