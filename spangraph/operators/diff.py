"""Comparison of two states: files by hash, definitions by meaning, graphs by identity, and what has to be written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# When a partial write becomes a full one, and when an index counts as collapsed.
MANY_DELETES, WRITE_SHARE = 50, 0.5
COLLAPSE_SHARE, COLLAPSE_EDGES = 0.5, 100


def hash_diff(old: DataFrame, new: DataFrame, key: str, hash_: str) -> DataFrame:
    """``key, change``: added, deleted or changed; unchanged keys have no row."""
    o = old.select(key, F.col(hash_).alias("_o"), F.lit(1).alias("_in_o"))
    n = new.select(key, F.col(hash_).alias("_n"), F.lit(1).alias("_in_n"))
    change = F.when(F.col("_in_o").isNull(), "added").when(F.col("_in_n").isNull(), "deleted").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def record_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, change, columns``: like the hash diff, with the names of the columns that differ."""
    o = old.select(key, F.struct(*columns).alias("_o"))
    n = new.select(key, F.struct(*columns).alias("_n"))
    named = [F.when(~F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}")), F.lit(c)) for c in columns]
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").otherwise("changed")
    diff = F.when(F.col("_o").isNotNull() & F.col("_n").isNotNull(), F.array_compact(F.array(*named))).otherwise(F.array().cast("array<string>"))
    return both.select(key, change.alias("change"), diff.alias("columns")).filter("change <> 'changed' or size(columns) > 0")


def _masked(text: Column, name: Column) -> Column:
    return F.replace(text, name, F.lit("\u0000"))


def definition_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``file, change, label, name, old_name, breaking, sig_from, sig_to`` of two sets of definitions.

    A definition has ``file, key, label, owner, name, signature, param_count, is_exported, text``.
    A removed and an added one are a rename if they are each other's only candidate: same label and
    owner, and the same text but for the name or the same signature with parameters.
    """
    cols = ["label", "owner", "name", "signature", "param_count", "is_exported", "text"]
    o = old.select("file", "key", *[F.col(c).alias(f"o_{c}") for c in cols], F.lit(True).alias("in_o"))
    n = new.select("file", "key", *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("in_n"))
    both = o.join(n, ["file", "key"], "full_outer")
    shown = lambda p: F.when(F.coalesce(F.col(f"{p}_owner"), F.lit("")) != "", F.concat_ws(".", f"{p}_owner", f"{p}_name")).otherwise(F.col(f"{p}_name"))
    sig = ~F.col("o_signature").eqNullSafe(F.col("n_signature"))
    kind = (
        F.when(sig, "SignatureChanged").when(F.col("o_is_exported") != F.col("n_is_exported"), "VisibilityChanged").when(~F.col("o_text").eqNullSafe(F.col("n_text")), "BodyChanged")
    )
    kept = both.filter("in_o and in_n").withColumn("change", kind).filter("change is not null")
    breaking = F.col("o_is_exported") & ((F.col("change") == "SignatureChanged") | ((F.col("change") == "VisibilityChanged") & ~F.col("n_is_exported")))
    none = F.lit(None).cast("string")
    changed = kept.select("file", "change", F.col("n_label").alias("label"), shown("n").alias("name"), none.alias("old_name"), breaking.alias("breaking"), F.when(sig, F.col("o_signature")).alias("sig_from"), F.when(sig, F.col("n_signature")).alias("sig_to"))

    gone = both.filter("in_n is null").select("file", F.col("key").alias("o_key"), *[f"o_{c}" for c in cols])
    came = both.filter("in_o is null").select("file", F.col("key").alias("n_key"), *[f"n_{c}" for c in cols])
    # equal bodies and equal signatures are two joins on values, so a file with many definitions isn't compared pair by pair
    key = lambda df, p, how: df.select(F.col("file"), F.col(f"{p}_label").alias("_l"), F.coalesce(f"{p}_owner", F.lit("")).alias("_w"), F.col(f"{p}_owner").isNull().alias("_n"), how.alias("_v"), f"{p}_key")
    body = lambda p: F.sha2(_masked(F.col(f"{p}_text"), F.col(f"{p}_name")), 256)
    signed = lambda p: F.when((F.col(f"{p}_signature") != ""), F.col(f"{p}_signature"))
    on = ["file", "_l", "_w", "_n", "_v"]
    by_body = key(gone, "o", body("o")).join(key(came, "n", body("n")), on)
    by_sig = key(gone.filter("o_param_count > 0"), "o", signed("o")).join(key(came, "n", signed("n")), on)
    pairs = by_body.unionByName(by_sig).select("file", "o_key", "n_key").distinct()
    cand = pairs.join(gone, ["file", "o_key"]).join(came, ["file", "n_key"])
    one_o = cand.groupBy("file", "o_key").count().filter("count = 1").select("file", "o_key")
    one_n = cand.groupBy("file", "n_key").count().filter("count = 1").select("file", "n_key")
    renamed = cand.join(one_o, ["file", "o_key"], "left_semi").join(one_n, ["file", "n_key"], "left_semi")
    rename_rows = renamed.select("file", F.lit("Renamed").alias("change"), F.col("n_label").alias("label"), shown("n").alias("name"), shown("o").alias("old_name"), F.col("o_is_exported").alias("breaking"), F.when(sig, F.col("o_signature")).alias("sig_from"), F.when(sig, F.col("n_signature")).alias("sig_to"))
    removed = gone.join(renamed.select("file", "o_key"), ["file", "o_key"], "left_anti")
    added = came.join(renamed.select("file", "n_key"), ["file", "n_key"], "left_anti")
    row = lambda df, change, p, b: df.select("file", F.lit(change).alias("change"), F.col(f"{p}_label").alias("label"), shown(p).alias("name"), none.alias("old_name"), b.alias("breaking"), none.alias("sig_from"), none.alias("sig_to"))
    return changed.unionByName(rename_rows).unionByName(row(removed, "Removed", "o", F.col("o_is_exported"))).unionByName(row(added, "Added", "n", F.lit(False)))


def write_set(edges: DataFrame, files: DataFrame, changed: DataFrame, graph_wide: list[str] | None = None) -> DataFrame:
    """``file``: the changed files and those one edge away; ``files`` has ``id, file``; graph-wide relation types don't carry."""
    e = edges.filter(~F.col("type").isin(graph_wide)) if graph_wide else edges
    a, b = (files.select(F.col("id").alias(x), F.col("file").alias(f"{x}_file")) for x in ("src", "dst"))
    across = e.select("src", "dst").join(a, "src").join(b, "dst").filter("src_file <> dst_file").select("src_file", "dst_file").distinct()
    c = changed.select("file").distinct()
    out = across.join(c.withColumnRenamed("file", "src_file"), "src_file").select(F.col("dst_file").alias("file"))
    back = across.join(c.withColumnRenamed("file", "dst_file"), "dst_file").select(F.col("src_file").alias("file"))
    return c.unionByName(out).unionByName(back).distinct()


def subgraph(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the given files and the edges that touch one of them."""
    own = nodes.join(files.select(F.col("file").alias("file_path")).distinct(), "file_path", "left_semi")
    ids = own.select("id").distinct()
    touch = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns))
    return own, touch.distinct()


def must_write_all(deleted: int, to_write: int, total: int) -> bool:
    """A partial write of many deletions and over half of all files is done as a full one."""
    return deleted >= MANY_DELETES and total > 0 and to_write / total > WRITE_SHARE


def collapsed(persisted: int, expected: int) -> bool:
    """An index that holds under half of the edges it should."""
    return expected > COLLAPSE_EDGES and persisted / expected < COLLAPSE_SHARE


def reconcile(expected: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, problem``: missing, unexpected, duplicated or different rows of a stored table; no row if all is well."""
    counted = stored.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.struct(*columns)).alias("_s"))
    e = expected.select(key, F.struct(*columns).alias("_e"))
    problem = (
        F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "duplicated").when(~F.col("_e").eqNullSafe(F.col("_s")), "different")
    )
    return e.join(counted, key, "full_outer").select(key, problem.alias("problem")).filter("problem is not null")


def reusable(nodes: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Embeddings whose node still has the content they were made of, and the nodes that need new ones."""
    kept = embeddings.join(nodes.select(F.col("id").alias("node_id"), "content_hash"), ["node_id", "content_hash"], "left_semi")
    missing = nodes.join(kept.select(F.col("node_id").alias("id")).distinct(), "id", "left_anti")
    return kept, missing


def shadow_candidates(added: DataFrame) -> DataFrame:
    """``file, shadow``: paths that an added file may now stand before, with another extension or as a folder's index."""
    stem = F.regexp_replace("file", r"\.[^./]+$", "")
    ends = ["ts", "tsx", "js", "jsx", "mjs", "d.ts"]
    paths = F.array(*[F.concat(stem, F.lit(f".{e}")) for e in ends], *[F.concat(stem, F.lit(f"/index.{e}")) for e in ends[:4]])
    return added.select("file", F.explode(paths).alias("shadow")).filter("shadow <> file")
