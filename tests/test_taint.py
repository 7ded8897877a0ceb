"""Models of tainted calls, findings, summaries and their explanation."""

import pytest
from pyspark.sql import functions as F

from spangraph.functions import codecs
from spangraph.operators import taint

SITE = "fn_id string, line long, language string, name string, module string, receiver string, is_new boolean, shadowed boolean, args array<int>"
FLOW = "fn_id string, variable string, def_line long, use_line long"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_the_model_means_calls_by_module_receiver_global_and_new(spark):
    sites = [
        ("f", 1, "python", "args", None, "request", None, None, None), ("f", 2, "python", "system", "os", None, None, None, [0]), ("f", 3, "python", "system", "mine", None, None, None, [0]), ("f", 4, "python", "eval", None, None, None, None, [0]),
        ("f", 5, "python", "eval", None, None, None, True, [0]), ("f", 6, "typescript", "Function", None, None, True, None, [0]), ("f", 7, "typescript", "Function", None, None, False, None, [0]), ("f", 8, "python", "execute", None, "cursor", None, None, [1]),
        ("f", 9, "python", "execute", None, "cursor", None, None, [0, 1]), ("f", 10, "typescript", "send", None, "res", None, None, [0]), ("f", 11, "typescript", "send", None, "socket", None, None, [0]), ("f", 12, "typescript", "encode", "he", None, None, None, None),
        ("f", 13, "typescript", "encode", None, None, None, None, None), ("f", 14, None, "eval", None, None, None, None, [0]), (None, 15, "python", None, None, None, None, None, None),
    ]
    rules = taint.model(spark)
    got = rows(taint.match_sites(spark.createDataFrame(sites, SITE), rules), "line", "role")
    assert got == sorted([(1, "source"), (2, "sink"), (4, "sink"), (6, "sink"), (9, "sink"), (10, "sink"), (12, "sanitizer")], key=repr)
    assert rules.filter("role = 'sink'").select(F.explode("kinds")).distinct().count() == 5
    assert taint.match_sites(spark.createDataFrame([], SITE), rules).count() == 0


MATCHED = "fn_id string, line long, role string, kinds array<string>"


def test_findings_tell_what_is_stopped_and_what_goes_on(spark):
    flows = spark.createDataFrame([("f", "v", 1, 2), ("f", "v", 2, 3), ("f", "v", 1, 4), ("f", "v", 3, 5), ("g", "v", 1, 2)], FLOW)
    matched = spark.createDataFrame([("f", 1, "source", ["xss", "sql-injection"]), ("f", 2, "sanitizer", ["xss"]), ("f", 3, "sink", ["xss"]), ("f", 3, "sink", ["sql-injection"]), ("f", 4, "sink", ["xss"]), ("f", 5, "sanitizer", ["sql-injection"]), ("g", 1, "source", ["xss"])], MATCHED)
    got = rows(taint.findings(flows, matched), "fn_id", "source_line", "line", "kind", "edge")
    assert got == sorted([("f", 1, 3, "sql-injection", "TAINTED"), ("f", 1, 4, "xss", "TAINTED"), ("f", 1, 2, "xss", "SANITIZES"), ("f", 1, 5, "sql-injection", "SANITIZES")])
    sites = spark.createDataFrame([("f", 1, "ts"), ("f", 9, "ts"), ("h", 1, "py")], "fn_id string, line long, language string")
    assert rows(taint.coverage_gaps(sites, matched, flows)) == [("py", 1, 0, 1), ("ts", 2, 1, 0)]


def test_summaries_have_six_kinds_of_facts_and_follow_their_callees(spark):
    # f(p0, p1): line 1 p0, line 2 p1; p0 -> return at 5; p1 -> g at 6; source at 3 -> return at 5; call h at 7 -> return at 8; g(p0) -> sink at 2
    flows = spark.createDataFrame([("f", "a", 1, 4), ("f", "a", 4, 5), ("f", "b", 2, 6), ("f", "s", 3, 5), ("f", "s", 3, 6), ("f", "r", 7, 8), ("g", "a", 1, 2)], FLOW)
    params = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("g", 0, 1)], "fn_id string, param int, line long")
    returns = spark.createDataFrame([("f", 5), ("f", 8)], "fn_id string, line long")
    calls = spark.createDataFrame([("f", 6, "g", 0), ("f", 7, "h", 0)], "fn_id string, line long, callee string, arg int")
    matched = spark.createDataFrame([("f", 3, "source", ["xss"]), ("g", 2, "sink", ["xss"])], MATCHED)
    got = {r.fn_id: r for r in taint.summaries(flows, params, returns, calls, matched).collect()}
    assert got["f"].facts == ["c:p1:arg:g:0", "cr:call:h:return", "g:source:return", "r:p0:return", "s:source:arg:g:0"] and got["g"].facts == ["k:p0:sink:xss"]
    other = matched.withColumn("kinds", F.when(F.col("role") == "sink", F.array(F.lit("sql-injection"))).otherwise(F.col("kinds")))
    changed = {r.fn_id: r for r in taint.summaries(flows, params, returns, calls, other).collect()}
    assert changed["f"].digest == got["f"].digest and changed["f"].version != got["f"].version and changed["g"].digest != got["g"].digest


def test_explanations(spark):
    hop = lambda n, k: F.struct(F.lit(n).alias("name"), F.lit(k).alias("line"), F.lit(False).alias("via_call"))
    e = spark.createDataFrame([("Function:a.ts:f", "Function:b.ts:g", "TAINT_PATH"), ("Function:c.ts:f", "Function:c.ts:g", "TAINTED"), ("Function:a.ts:f", "x", "CALLS")], "src string, dst string, type string")
    e = e.withColumn("reason", codecs.encode_path(F.array(hop("q", 1), hop("sql", 7)), F.lit("xss")))
    assert rows(taint.explain(e, file="a.ts")) == [("Function:a.ts:f", "Function:b.ts:g", "xss", "q@1 > sql@7", False)]
    assert taint.explain(e).count() == 2 and taint.explain(e, symbol="Function:c.ts:g").count() == 1 and taint.explain(e, limit=1).count() == 1
