"""Which calls bring, use or clean tainted values, what is kept of a function's flows, and how findings are shown.

The model is a table, so a project adds rows of its own. Call sites are matched by one join on the
language and the last part of the name; how an entry may be matched decides after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import decode_path, fnv1a
from .pdg import taint_within

# Members of request objects that hold what a client sent, by language.
SOURCES = {
    "python": (["request", "req"], ["args", "form", "json", "data", "headers", "cookies", "path_params", "query_params"]),
    "typescript": (["req", "request"], ["body", "query", "params", "headers", "cookies"]),
    "java": (["request", "req"], ["getParameter", "getHeader"]),
}
_DB = ["db", "database", "conn", "client", "pool", "stmt", "statement", "prepared"]
# Callables that must not get what a client sent: language, name, kind, arguments (none: all), how they are matched, and by what.
SINKS = [
    ("python", "system", "command-injection", [0], "module", ["os"]), ("python", "popen", "command-injection", [0], "module", ["os"]), ("python", "call", "command-injection", [0], "module", ["subprocess"]),
    ("python", "run", "command-injection", [0], "module", ["subprocess"]), ("python", "Popen", "command-injection", [0], "module", ["subprocess"]), ("python", "check_call", "command-injection", [0], "module", ["subprocess"]),
    ("python", "check_output", "command-injection", [0], "module", ["subprocess"]), ("python", "eval", "code-injection", [0], "global", []), ("python", "exec", "code-injection", [0], "global", []),
    ("python", "open", "path-traversal", [0], "global", []), ("python", "query", "sql-injection", [0], "any", []), ("python", "execute", "sql-injection", [0], "any", []),
    ("python", "executemany", "sql-injection", [0], "any", []), ("python", "executescript", "sql-injection", [0], "any", []),
    ("typescript", "exec", "command-injection", [0], "module", ["child_process"]), ("typescript", "execSync", "command-injection", [0], "module", ["child_process"]), ("typescript", "spawn", "command-injection", [0, 1], "module", ["child_process"]),
    ("typescript", "spawnSync", "command-injection", [0, 1], "module", ["child_process"]), ("typescript", "execFile", "command-injection", [0, 1], "module", ["child_process"]), ("typescript", "execFileSync", "command-injection", [0, 1], "module", ["child_process"]),
    ("typescript", "eval", "code-injection", [0], "global", []), ("typescript", "Function", "code-injection", [], "new", []), ("typescript", "readFile", "path-traversal", [0], "module", ["fs"]),
    ("typescript", "readFileSync", "path-traversal", [0], "module", ["fs"]), ("typescript", "writeFile", "path-traversal", [0], "module", ["fs"]), ("typescript", "writeFileSync", "path-traversal", [0], "module", ["fs"]),
    ("typescript", "query", "sql-injection", [0], "any", []), ("typescript", "execute", "sql-injection", [0], "any", []), ("typescript", "run", "sql-injection", [0], "receiver", _DB),
    ("typescript", "all", "sql-injection", [0], "receiver", _DB), ("typescript", "get", "sql-injection", [0], "receiver", _DB), ("typescript", "values", "sql-injection", [0], "receiver", _DB[:5]),
    ("typescript", "raw", "sql-injection", [0], "receiver", ["db", "knex", "sequelize"]), ("typescript", "send", "xss", [0], "receiver", ["res"]), ("typescript", "write", "xss", [0], "receiver", ["res"]),
    ("typescript", "render", "xss", [0, 1], "receiver", ["res"]), ("java", "readString", "path-traversal", [0], "module", ["java.nio.file.Files"]),
]
# Callables that make a value harmless for some kinds.
SANITIZERS = [
    ("typescript", "encodeURIComponent", ["xss", "path-traversal"], "global", []), ("typescript", "default", ["xss"], "module", ["escape-html"]), ("typescript", "encode", ["xss"], "module", ["he"]),
    ("typescript", "basename", ["path-traversal"], "module", ["path"]), ("typescript", "escape", ["xss"], "module", ["validator"]),
]
KINDS = ["command-injection", "code-injection", "path-traversal", "sql-injection", "xss"]

_RULE = "language string, name string, kinds array<string>, args array<int>, how string, by array<string>, role string"


def model(spark: SparkSession) -> DataFrame:
    """The shipped model: ``language, name, kinds, args, how, by, role``; about sixty rows."""
    rows = [(lang, m, KINDS, [], "receiver", objects, "source") for lang, (objects, members) in SOURCES.items() for m in members]
    rows += [(lang, name, [kind], args, how, by, "sink") for lang, name, kind, args, how, by in SINKS]
    rows += [(lang, name, kinds, [], how, by, "sanitizer") for lang, name, kinds, how, by in SANITIZERS]
    return spark.createDataFrame(rows, _RULE)


def match_sites(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """``fn_id, line, role, kinds``: call sites and member reads that an entry of the model means.

    ``sites`` has ``fn_id, line, language, name, module, receiver, is_new, shadowed, args``: the last
    part of the name, the module that it is imported from, what it is called on, whether it is a
    ``new``, whether a local name hides it, and which arguments carry values. A sanitizer is never
    matched by a bare name, since a wrong one would hide a finding.
    """
    met = sites.withColumnRenamed("args", "given").join(rules, ["language", "name"])
    bare = F.col("receiver").isNull() & F.col("module").isNull() & ~F.coalesce("shadowed", F.lit(False))
    fits = (
        F.when(F.col("how") == "module", F.array_contains("by", F.col("module")))
        .when(F.col("how") == "global", bare).when(F.col("how") == "new", bare & F.coalesce("is_new", F.lit(False)))
        .when(F.col("how") == "receiver", F.array_contains("by", F.col("receiver"))).when((F.col("how") == "any") & (F.col("role") != "sanitizer"), F.col("receiver").isNotNull())
    )
    touched = (F.col("role") != "sink") | (F.size("args") == 0) | F.arrays_overlap("args", "given")
    return met.filter(F.coalesce(fits & touched, F.lit(False))).select("fn_id", "line", "role", "kinds").distinct()


def findings(flows: DataFrame, matched: DataFrame) -> DataFrame:
    """``fn_id, source_line, line, kind, hops, edge``: TAINTED from a source to a sink, SANITIZES where a value on its way is made harmless.

    ``flows`` are def-use steps, ``matched`` what ``match_sites`` gives. A value counts as made
    harmless by the sanitizers that it reaches without another one for its kind before.
    """
    of = lambda role: matched.filter(F.col("role") == role)
    sinks = of("sink").select("fn_id", "line", F.explode("kinds").alias("kind"))
    clean = of("sanitizer").select("fn_id", "line", "kinds")
    hit = taint_within(flows, of("source").select("fn_id", "line", "kinds"), sinks, clean)
    hit = hit.select("fn_id", "source_line", F.col("sink_line").alias("line"), "kind", "hops", F.lit("TAINTED").alias("edge"))
    # a sanitizer is reached if the steps into it are: it stands as a sink at its own line, and stops what goes on from there
    at = clean.select("fn_id", F.col("line").alias("use_line")).distinct()
    into = flows.join(at, ["fn_id", "use_line"], "left_semi").select("fn_id", "variable", "def_line", (-F.col("use_line") - 1).alias("use_line"))
    ends = clean.select("fn_id", (-F.col("line") - 1).alias("line"), F.explode("kinds").alias("kind"))
    cut = taint_within(flows.select("fn_id", "variable", "def_line", "use_line").unionByName(into), of("source").select("fn_id", "line", "kinds"), ends, clean)
    cut = cut.select("fn_id", "source_line", (-F.col("sink_line") - 1).alias("line"), "kind", "hops", F.lit("SANITIZES").alias("edge"))
    return hit.unionByName(cut)


def coverage_gaps(sites: DataFrame, matched: DataFrame, flows: DataFrame) -> DataFrame:
    """``language, sites, matched, without_flows``: call sites, those that the model means, and those of functions without flow steps."""
    known = matched.select("fn_id", "line").distinct().withColumn("hit", F.lit(1))
    having = flows.select("fn_id").distinct().withColumn("flow", F.lit(1))
    rows = sites.join(known, ["fn_id", "line"], "left").join(having, "fn_id", "left")
    return rows.groupBy("language").agg(F.count("*").alias("sites"), F.count("hit").alias("matched"), F.count(F.when(F.col("flow").isNull(), 1)).alias("without_flows"))


def summaries(flows: DataFrame, params: DataFrame, returns: DataFrame, call_args: DataFrame, matched: DataFrame) -> DataFrame:
    """``fn_id, facts, digest, version``: what a caller has to know of each function.

    ``params`` has ``fn_id, param, line``, ``returns`` has ``fn_id, line``, ``call_args`` has ``fn_id,
    line, callee, arg``. The facts, sorted, are of six kinds: a parameter that is returned (r), is
    passed on (c) or reaches a sink (k), a source that is returned (g) or passed on (s), and a
    call whose result goes to a sink or is returned (cr). The version takes in the digests of the callees.
    """
    starts = params.select("fn_id", "line", F.concat(F.lit("p"), "param").alias("from"))
    starts = starts.unionByName(matched.filter("role = 'source'").select("fn_id", "line", F.lit("source").alias("from")))
    starts = starts.unionByName(call_args.select("fn_id", "line", F.concat(F.lit("call:"), "callee").alias("from"))).distinct()
    ends = returns.select("fn_id", "line", F.lit("return").alias("to"))
    ends = ends.unionByName(call_args.select("fn_id", "line", F.concat_ws(":", F.lit("arg"), "callee", "arg").alias("to")))
    ends = ends.unionByName(matched.filter("role = 'sink'").select("fn_id", "line", F.explode(F.transform("kinds", lambda k: F.concat(F.lit("sink:"), k))).alias("to"))).distinct()
    # one pass over the flows: the kinds of a source are the names of what is asked for, so nothing is cut off on the way
    wanted = F.array(F.lit("any"))
    off = starts.select("fn_id", "line", F.array().cast("array<string>").alias("kinds")).limit(0)
    step = taint_within(flows, starts.select("fn_id", "line", wanted.alias("kinds")), ends.select("fn_id", "line", F.lit("any").alias("kind")).distinct(), off)
    reach = step.select("fn_id", F.col("source_line").alias("a"), F.col("sink_line").alias("b"))
    here = starts.select("fn_id", F.col("line").alias("a"), F.col("line").alias("b")).distinct()
    pairs = reach.unionByName(here).distinct().join(starts.withColumnRenamed("line", "a"), ["fn_id", "a"]).join(ends.withColumnRenamed("line", "b"), ["fn_id", "b"])
    pairs = pairs.filter(~(F.col("from").startswith("call:") & (F.col("a") == F.col("b"))) & ~(F.col("from").startswith("call:") & F.col("to").startswith("arg:")))
    letter = (
        F.when(F.col("from").startswith("call:"), "cr").when((F.col("from") == "source") & (F.col("to") == "return"), "g").when(F.col("from") == "source", F.when(F.col("to").startswith("arg:"), "s"))
        .when(F.col("to") == "return", "r").when(F.col("to").startswith("arg:"), "c").otherwise("k")
    )
    facts = pairs.select("fn_id", letter.alias("k"), "from", "to").filter("k is not null").select("fn_id", F.concat_ws(":", "k", "from", "to").alias("fact")).distinct()
    every = params.select("fn_id").unionByName(returns.select("fn_id")).unionByName(call_args.select("fn_id")).distinct()
    own = every.join(facts.groupBy("fn_id").agg(F.array_sort(F.collect_list("fact")).alias("facts")), "fn_id", "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<string>")))
    own = own.withColumn("digest", fnv1a(F.col("facts")))
    called = call_args.select("fn_id", F.col("callee").alias("other")).distinct().join(own.select(F.col("fn_id").alias("other"), F.col("digest").alias("d")), "other")
    called = called.groupBy("fn_id").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    rows = own.join(called, "fn_id", "left")
    return rows.select("fn_id", "facts", "digest", fnv1a(F.concat(F.array(F.concat(F.lit("#"), "digest")), F.coalesce("ds", F.array().cast("array<string>")))).alias("version"))


def explain(edges: DataFrame, *, file: str | None = None, symbol: str | None = None, limit: int = 100) -> DataFrame:
    """``src, dst, kind, hops, cut``: TAINTED and TAINT_PATH edges with their path in words, by file or symbol, in order.

    ``edges`` has ``src, dst, type, reason`` with the packed path.
    """
    rows = edges.filter("type in ('TAINTED', 'TAINT_PATH')")
    if file is not None:
        rows = rows.filter(F.col("src").contains(f":{file}:") | F.col("dst").contains(f":{file}:"))
    if symbol is not None:
        rows = rows.filter((F.col("src") == symbol) | (F.col("dst") == symbol))
    p = decode_path(F.col("reason"))
    hop = lambda h: F.concat(h["name"], F.lit("@"), h["line"].cast("string"))
    return rows.select("src", "dst", p["kind"].alias("kind"), F.array_join(F.transform(p["hops"], hop), " > ").alias("hops"), p["cut"].alias("cut")).orderBy("src", "dst", "kind", "hops").limit(limit)
