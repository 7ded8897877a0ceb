"""Items that appear together: pair counts and association over baskets of any size.

Every basket goes the same way: it is cut by a hash into chunks of about ``block`` items, and each
pair of chunks (a chunk with itself too) becomes a group of its own whose pairs one row of the plan
makes. A basket within the block is one chunk with one chunk pair, and the pairs of a huge one are
made by many tasks. Counts of all chunk pairs are added by one aggregation. A basket of s items
is copied s / block times, which is 2 / block of the pairs that it gives.

Thresholds are used before pairs are made where that loses nothing: c <= min(a, b), so an item
that is rarer than ``min_count`` has no pair that reaches it, and as the lift c*n/(a*b) is at most
n/max(a, b), an item in more than n/min_lift baskets has no pair that reaches ``min_lift``.

Names don't travel: a basket and an item are 128-bit hashes while baskets are put together, kept
items get exact numbers, and names are looked up for the items of the pairs that are found.

Defined results: null or blank items and null baskets are left out, an item counts once per basket,
a null scope is a scope of its own, a basket with one item counts for n and for its item only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

#: Items of a chunk: up to block**2 pairs are made by one row of the plan.
BLOCK = 128
#: A basket of more rows than this is put together in parts of about so many.
HEAVY = 10_000


def plain_path(path: Column) -> Column:
    """Single forward slashes, no ``./``: the one spelling of a path."""
    plain = F.regexp_replace(path, r"[\\/]+", "/")
    plain = F.regexp_replace(plain, r"(?<=/)(?:\./)+", "")
    plain = F.regexp_replace(plain, r"^(?:\./)+", "")
    odd = path.contains("\\") | path.contains("//") | path.contains("./")
    return F.when(odd, plain).otherwise(path)


def _key(name: str, *columns: str) -> list[Column]:
    """Two independent 64-bit hashes, ``name_1`` and ``name_2``, that tell null from empty.

    Spark takes the hash of one argument as the seed of the next, so what sets the two apart comes first.
    """
    parts = [x for c in columns for x in (F.coalesce(c, F.lit("")), F.col(c).isNull())]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"{name}_{seed}") for seed in (1, 2)]


BASKET, ITEM = ["basket_1", "basket_2"], ["item_1", "item_2"]


def _baskets(raw: DataFrame, named: DataFrame) -> DataFrame:
    """``scope, basket_1, basket_2, parts, items``: each basket's distinct items, a heavy one in several rows.

    Only the heavy baskets are looked up; there are at most (number of rows) / HEAVY of them.
    """
    heavy = raw.groupBy(*_key("basket", "scope", "basket")).agg(F.count("*").alias("rows")).filter(F.col("rows") > HEAVY)
    heavy = heavy.select(*BASKET, F.ceil(F.col("rows") / HEAVY).cast("int").alias("parts"))
    rows = named.select("scope", *_key("basket", "scope", "basket"), *_key("item", "scope", "item")).join(heavy, BASKET, "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod("item_1", "parts").cast("int"))
    group = [*BASKET, "part"]
    # all columns are grouping keys: text as an aggregate's value would make it a sort
    rows = rows.repartition(*group).select("scope", "parts", *group, *ITEM).distinct()
    rows = rows.groupBy("scope", "parts", *group).agg(F.collect_list(F.struct(*ITEM)).alias("items"))
    return materialise(rows.select("scope", *BASKET, "parts", "items"), "cooccurrence-baskets")


def _sized(baskets: DataFrame) -> DataFrame:
    """With the size of the whole basket: an ordinary one is one row, only parts of heavy ones are added up."""
    own = baskets.filter("parts = 1").withColumn("size", F.size("items").cast("long"))
    parts = baskets.filter("parts > 1")
    whole = parts.groupBy(*BASKET).agg(F.sum(F.size("items")).alias("size"))
    return own.unionByName(parts.join(whole, BASKET))


def pair_counts(
    rows: DataFrame, scope: str, basket: str, item: str, *, min_count: int = 1, min_lift: float | None = None, max_basket: int | None = None, block: int = BLOCK
) -> DataFrame:
    """Rows ``scope, item_a, item_b, count, count_a, count_b, n, strength, lift`` with item_a < item_b.

    strength is count / min(count_a, count_b), lift is count * n / (count_a * count_b).
    ``max_basket`` leaves out whole baskets that are larger, before anything is counted.
    """
    raw = rows.select(F.col(scope).cast("string").alias("scope"), F.col(basket).cast("string").alias("basket"), F.col(item).cast("string").alias("item"))
    raw = raw.filter(F.col("basket").rlike(r"\S"))
    named = raw.filter(F.col("item").rlike(r"\S"))
    kept = _sized(_baskets(raw, named))
    if max_basket is not None:
        kept = kept.filter(F.col("size") <= max_basket)
    # a basket counts once for n: by its row, or by one of its parts
    share = F.when(F.col("parts") == 1, F.lit(1.0)).otherwise(F.size("items") / F.col("size"))
    totals = kept.groupBy("scope").agg(F.round(F.sum(share)).cast("long").alias("n")).withColumnRenamed("scope", "of")
    single = kept.select("scope", *BASKET, "size", F.explode("items").alias("i")).select("scope", *BASKET, "size", "i.*")
    items = single.groupBy(*ITEM, "scope").agg(F.count("*").alias("freq")).filter(F.col("freq") >= min_count)
    items = items.join(totals, F.col("scope").eqNullSafe(F.col("of")))
    if min_lift is not None:
        items = items.filter(F.col("freq") * F.lit(min_lift) <= F.col("n"))
    items = materialise(items.select(*ITEM, "freq", "n", F.monotonically_increasing_id().alias("id")), "cooccurrence-items")

    chunks = F.ceil(F.col("size") / block).cast("int")
    used = single.join(items.select(*ITEM, "id"), ITEM).select(*BASKET, "id", chunks.alias("chunks"))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    used = used.select(*BASKET, "id", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    used = used.select(*BASKET, "id", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    groups = used.groupBy(*BASKET, "i", "j").agg(
        F.array_sort(F.collect_list(F.when(F.col("chunk") == F.col("i"), F.col("id")))).alias("left"),
        F.array_sort(F.collect_list(F.when(F.col("chunk") == F.col("j"), F.col("id")))).alias("right"),
    )
    pairs = groups.select("i", "j", "right", F.posexplode("left").alias("at", "x"))
    partners = F.when(F.col("i") == F.col("j"), F.slice("right", F.col("at") + 2, F.size("right"))).otherwise(F.col("right"))
    pairs = pairs.select("x", F.explode(partners).alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    counts = pairs.groupBy("x", "y").agg(F.count("*").alias("count")).filter(F.col("count") >= min_count)
    one = items.select(F.col("id").alias("x"), "n", F.col("freq").alias("freq_x"))
    two = items.select(F.col("id").alias("y"), F.col("freq").alias("freq_y"))
    found = counts.join(one, "x").join(two, "y")
    if min_lift is not None:
        found = found.filter(F.col("count").cast("double") * F.col("n") >= F.lit(float(min_lift)) * (F.col("freq_x") * F.col("freq_y")))
    found = materialise(found, "cooccurrence-found")

    wanted = found.select(F.col("x").alias("id")).unionAll(found.select(F.col("y").alias("id"))).distinct()
    wanted = materialise(wanted.join(items.select("id", *ITEM), "id"), "cooccurrence-wanted")
    # the semi-join is planned below the distinct where the wanted items are few enough to be sent
    names = named.select("scope", "item", *_key("item", "scope", "item")).distinct()
    names = names.join(wanted.select(*ITEM), ITEM, "left_semi").join(wanted, ITEM)
    names = materialise(names.select("id", "scope", "item"), "cooccurrence-names")
    found = found.join(names.select(F.col("id").alias("x"), "scope", F.col("item").alias("item_x")), "x").join(names.select(F.col("id").alias("y"), F.col("item").alias("item_y")), "y")
    swap = F.col("item_x") > F.col("item_y")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    found = found.select(
        "scope", pick("item_x", "item_y").alias("item_a"), pick("item_y", "item_x").alias("item_b"), "count",
        pick("freq_x", "freq_y").alias("count_a"), pick("freq_y", "freq_x").alias("count_b"), "n",
    )
    found = found.withColumn("strength", F.col("count") / F.least("count_a", "count_b"))
    return found.withColumn("lift", F.col("count").cast("double") * F.col("n") / (F.col("count_a") * F.col("count_b")))
