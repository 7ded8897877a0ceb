"""Every named query of the core against its SQL on the smallest tables, and the driver's entry points."""

import os

import pytest

from spangraph.plans import catalogue

from .conftest import DATA, same_rows

QUERIES, ORACLE = catalogue()
SMALL = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    same_rows(QUERIES[name](spark, SMALL), ORACLE[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_text_functions_read_whole_texts(spark, tmp_path):
    texts = [("a", "x" * 50 + " straddles_the_60th_character and_then_the_longest_one_of_this_whole_text_behind_it"), ("b", "a b"), ("c", None)]
    docs = spark.createDataFrame([(k, t, len(t or ""), "s") for k, t in texts], "doc_id string, text string, n_chars int, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.identifier for r in QUERIES["text_functions"](spark, str(tmp_path)).collect()}
    assert got == {"a": "and_then_the_longest_one_of_this_whole_text_behind_it", "b": None, "c": None}


def test_core_does_not_import_the_optional_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "spangraph"
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert not re.search(r"(from|import)\s+[.\w]*\bllm\b", p.read_text()), p


def test_injections_shuffle_no_pairs(spark, tmp_path):
    """300 suppliers and 2,000 customers of one region and segment are 600,000 pairs."""
    for name, sql in {
        "region": "select 0 as r_regionkey", "nation": "select 0 as n_nationkey, 0 as n_regionkey",
        "supplier": "select id as s_suppkey, 0 as s_nationkey, 1.0D as s_acctbal from range(300)",
        "customer": "select id as c_custkey, 0 as c_nationkey, 'BUILDING' as c_mktsegment from range(2000)",
        "orders": "select id as o_orderkey, id as o_custkey from range(10)",
    }.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._jvm.java.util.ArrayList()

    def shuffled():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(none, False, False, context._gateway.new_array(context._jvm.double, 0), none)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = shuffled()
    got = QUERIES["injections"](spark, str(tmp_path)).collect()
    assert len(got) == 300 and {(r.n, r.first_dst) for r in got} == {(2000, "Customer:0")}
    records = sum(n for i, n in shuffled().items() if i not in before)
    assert 300 <= records < 60_000
