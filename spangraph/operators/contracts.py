"""Matching of provided and consumed interfaces between repositories.

A contract has ``contract_id, type, role, repo, service, symbol_uid, file_path, symbol_name,
confidence, meta``. All matching is by equality of normalised keys; wildcards are further keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import first_wins

ENDPOINT = ["repo", "service", "symbol_uid", "file_path", "symbol_name"]


def normalise(contract: Column) -> Column:
    """One spelling of a contract id, by its type."""
    kind = F.substring_index(contract, "::", 1)
    rest = F.regexp_replace(contract, r"^.*?::", "")
    method = F.upper(F.substring_index(rest, "::", 1))
    path = F.regexp_replace(F.regexp_replace(rest, r"^.*?::", ""), r"/+$", "")
    slash = F.instr(rest, "/")
    service = F.when(slash > 1, F.concat(F.lower(F.substring_index(rest, "/", 1)), F.regexp_replace(rest, r"^[^/]*", ""))).when(slash == 1, rest).otherwise(F.lower(rest))
    include = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"\\", "/"), r"^\./", ""), r"/+", "/"))
    return (
        F.when(~contract.contains("::"), contract)
        .when((kind == "http") & rest.contains("::"), F.concat(F.lit("http::"), method, F.lit("::"), path))
        .when(kind.isin("grpc", "thrift"), F.concat(kind, F.lit("::"), service))
        .when(kind == "topic", F.concat(F.lit("topic::"), F.lower(F.trim(rest))))
        .when(kind == "lib", F.concat(F.lit("lib::"), F.lower(rest)))
        .when(kind == "include", F.concat(F.lit("include::"), include))
        .otherwise(contract)
    )


def noisy(contract: Column, paths: list[str] | None = None, param_only: bool = False) -> Column:
    """Contracts that are left out of matching: listed paths, and http paths of parameters only."""
    cut = [p.rstrip("/") for p in paths or []]
    tail = F.regexp_replace(contract, r"^.*?::.*?::", "")
    three = F.size(F.split(contract, "::")) >= 3
    path = F.regexp_replace(tail, r"/+$", "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    http = contract.startswith("http::") & three & (path.isin(cut) | (F.lit(param_only) & (F.size(parts) > 0) & F.forall(parts, lambda x: x == "{param}")))
    graphql = contract.startswith("graphql::") & three & (tail.isin(cut) | F.concat(F.lit("/"), tail).isin(cut))
    return http | graphql


def service_wildcard(contract: Column) -> Column:
    return contract.rlike(r"^(grpc|thrift)::[^/]+/\*$")


def _sides(contracts: DataFrame, role: str, prefix: str) -> DataFrame:
    rows = contracts.filter(F.col("role") == role)
    return rows.select(F.col("contract_id").alias(f"{prefix}id"), F.col("type").alias(f"{prefix}type"), F.col("confidence").alias(f"{prefix}confidence"), normalise(F.col("contract_id")).alias(f"{prefix}key"), *[F.col(c).alias(f"{prefix}{c}") for c in ENDPOINT])


def _apart(df: DataFrame) -> DataFrame:
    """Ends in one repository only count if both name a service and the services differ."""
    services = (F.coalesce("c_service", F.lit("")) != "") & (F.coalesce("p_service", F.lit("")) != "") & (F.col("c_service") != F.col("p_service"))
    return df.filter((F.col("c_repo") != F.col("p_repo")) | services)


def _links(df: DataFrame, match_type: str, confidence: Column) -> DataFrame:
    return df.select(
        F.col("c_id").alias("contract_id"), F.col("c_type").alias("type"), F.lit(match_type).alias("match_type"), confidence.alias("confidence"),
        F.col("c_repo").alias("from_repo"), F.col("c_service").alias("from_service"), F.col("c_symbol_uid").alias("from_symbol"),
        F.col("p_repo").alias("to_repo"), F.col("p_service").alias("to_service"), F.col("p_symbol_uid").alias("to_symbol"), F.col("p_id").alias("provider_id"),
    )


def exact_links(contracts: DataFrame, paths: list[str] | None = None, param_only: bool = False) -> DataFrame:
    """Consumers with the providers of their key; an http consumer also matches a provider of any method, and the other way round."""
    kept = contracts.filter(~noisy(F.col("contract_id"), paths, param_only))
    c = _sides(kept.filter(~service_wildcard(F.col("contract_id"))), "consumer", "c_")
    p = _sides(kept, "provider", "p_")
    http = F.col("p_key").startswith("http::")
    path = F.regexp_replace(F.col("p_key"), r"^http::.*?::", "")
    # a provider is found by its own key and, for http, by its path under any method
    by = p.withColumn("key", F.explode(F.when(http, F.array_distinct(F.array(F.col("p_key"), F.concat(F.lit("any-method::"), path)))).otherwise(F.array("p_key"))))
    c_path = F.regexp_replace(F.col("c_key"), r"^http::.*?::", "")
    any_ = F.col("c_key").startswith("http::*::")
    wanted = F.when(any_, F.array(F.concat(F.lit("any-method::"), c_path))).when(F.col("c_key").startswith("http::"), F.array(F.col("c_key"), F.concat(F.lit("http::*::"), c_path))).otherwise(F.array("c_key"))
    found = _apart(c.withColumn("key", F.explode(wanted)).join(by, "key"))
    return _links(found, "exact", F.lit(1.0)).unionByName(_bare_thrift(c, p))


def _bare_thrift(c: DataFrame, p: DataFrame) -> DataFrame:
    """A thrift consumer without a package and without a provider of its very key matches a service that ends in its name, if only one does."""
    rest = lambda col: F.regexp_replace(F.col(col), "^thrift::", "")
    shape = r"^thrift::[^./]+/[^*].*$"
    want = c.filter(F.col("c_key").rlike(shape)).join(p.select(F.col("p_key").alias("c_key")).distinct(), "c_key", "left_anti")
    want = want.withColumn("bare", F.substring_index(rest("c_key"), "/", 1)).withColumn("method", F.regexp_replace(rest("c_key"), "^[^/]*/", ""))
    have = p.filter(F.col("p_key").rlike(r"^thrift::[^/]+/.+$") & ~F.col("p_key").endswith("/*"))
    service = F.substring_index(rest("p_key"), "/", 1)
    have = have.withColumn("method", F.regexp_replace(rest("p_key"), "^[^/]*/", "")).withColumn("bare", F.explode(_suffixes(service)))
    pairs = want.join(have, ["bare", "method"])
    one = pairs.groupBy("c_key").agg(F.countDistinct("p_key").alias("n")).filter("n = 1").select("c_key")
    return _links(_apart(pairs.join(one, "c_key", "left_semi")), "exact", F.lit(1.0))


def _suffixes(service: Column) -> Column:
    """A dotted service name and all its suffixes after a dot."""
    parts = F.split(service, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def wildcard_links(contracts: DataFrame, paths: list[str] | None = None, param_only: bool = False) -> DataFrame:
    """Consumers of a whole service with all methods of its providers; the smaller confidence of both counts.

    A name without a package also matches packaged services; a bare thrift name that matches several
    services matches none.
    """
    c = _sides(contracts.filter(service_wildcard(F.col("contract_id"))), "consumer", "c_")
    p = _sides(contracts.filter(~noisy(F.col("contract_id"), paths, param_only)), "provider", "p_")
    c = c.withColumn("kind", F.substring_index("c_key", "::", 1)).withColumn("service", F.regexp_replace(F.regexp_replace("c_key", "^.*?::", ""), r"/\*$", ""))
    p = p.filter(F.col("p_key").rlike("^.*?::[^/]*/") & ~F.col("p_key").endswith("/*"))
    whole = F.substring_index(F.regexp_replace("p_key", "^.*?::", ""), "/", 1)
    p = p.withColumn("kind", F.substring_index("p_key", "::", 1)).withColumn("whole", whole).withColumn("service", F.explode(_suffixes(whole)))
    pairs = c.join(p, ["kind", "service"]).filter((F.col("service") == F.col("whole")) | ~F.col("service").contains("."))
    several = pairs.filter("kind = 'thrift' and not contains(service, '.')").groupBy("c_key").agg(F.countDistinct("whole").alias("n")).filter("n > 1")
    found = _apart(pairs.join(several.select("c_key"), "c_key", "left_anti"))
    return _links(found, "wildcard", F.least("p_confidence", "c_confidence"))


def unmatched(contracts: DataFrame, links: DataFrame, paths: list[str] | None = None, param_only: bool = False) -> DataFrame:
    """Contracts that no link uses, by repo and id; noisy ones aren't listed."""
    kept = contracts.filter(~noisy(F.col("contract_id"), paths, param_only))
    used = links.select(F.lit("consumer").alias("role"), F.col("from_repo").alias("repo"), "contract_id").unionByName(
        links.select(F.lit("provider").alias("role"), F.col("to_repo").alias("repo"), F.col("provider_id").alias("contract_id"))
    )
    return kept.join(used.distinct(), ["role", "repo", "contract_id"], "left_anti").select("role", "repo", "contract_id")


def richness() -> Column:
    """How much a contract row says; only the order matters."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    named = has("symbol_name") & (F.col("symbol_name") != F.col("contract_id"))
    score = F.when(has("symbol_uid"), 3).otherwise(0) + F.when(has("file_path"), 2).otherwise(0) + F.when(named, 4).otherwise(0) + F.when(has("service"), 1).otherwise(0)
    return score + F.when(F.coalesce(F.get_json_object("meta", "$.source"), F.lit("")) != "manifest", 1).otherwise(0)


def dedupe_contracts(contracts: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key: each field from the richest row that has it, the greatest confidence; of equally rich rows the first."""
    fields = [c for c in contracts.columns if c not in (*key, "confidence", order)]
    ranked = contracts.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(richness()), F.asc(order))))
    filled = [F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("_r"))).alias(c) for c in fields]
    return ranked.groupBy(*key).agg(*filled, F.max("confidence").alias("confidence"))


def dedupe_links(links: DataFrame) -> DataFrame:
    """One link for each type, id, kind of match and pair of ends; the greatest confidence, degraded if the provider has no symbol."""
    key = ["type", "contract_id", "match_type", "from_repo", "from_service", "from_symbol", "to_repo", "to_service", "to_symbol"]
    best = first_wins(links, key, [F.desc("confidence")])
    return best.withColumn("degraded", F.coalesce(F.col("to_symbol"), F.lit("")) == "")


def service_of(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``file, service``: the service whose root is the longest that holds the file, by path prefixes."""
    parts = F.split("file", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    cand = files.select("file", F.explode(up).alias("root")).join(roots.select("root", "service"), "root")
    best = cand.groupBy("file").agg(F.max_by("service", F.length("root")).alias("service"))
    return files.select("file").join(best, "file", "left")


def topics(sources: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """``file, role, contract_id`` of message topics that code names: senders provide, listeners consume."""
    sends = r"(?:send|publish|produce|emit)\(\s*['\"]([\w.\-]+)['\"]"
    hears = r"(?:subscribe|consume|listen)\(\s*['\"]([\w.\-]+)['\"]|@KafkaListener\([^)]*topics\s*=\s*\"([\w.\-]+)\""
    out = None
    for role, pattern, groups in (("provider", sends, [1]), ("consumer", hears, [1, 2])):
        for g in groups:
            rows = sources.select(F.col(file).alias("file"), F.lit(role).alias("role"), F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(g))).alias("t"))
            rows = rows.filter("t <> ''").select("file", "role", normalise(F.concat(F.lit("topic::"), "t")).alias("contract_id"))
            out = rows if out is None else out.unionByName(rows)
    return out.distinct()
