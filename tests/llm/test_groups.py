"""Top N of groups, pairs of baskets and mixes against plain loops."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spangraph.llm import topn
from spangraph.llm.cooccurrence import pair_counts, plain_path
from spangraph.llm.mixing import meet, mix, settle, shares


# ---- top N


def best(rows, n):
    groups = defaultdict(list)
    for g, s, i in rows:
        groups[g].append((s, i))
    out = []
    for g, xs in groups.items():
        xs.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
        out += [(g, s, i, k + 1) for k, (s, i) in enumerate(xs[:n])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("state", [400_000, 50])
def test_top_n_with_ties_nulls_and_a_hot_group(spark, state, monkeypatch):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot"] * 5 + ["a", "b", None]), rnd.choice([1.0, 2.0, 2.0, None]), i) for i in range(5000)] + [(f"g{i % 900}", float(i % 7), i) for i in range(2000)]
    monkeypatch.setattr(topn, "STATE_ROWS", state)
    df = spark.createDataFrame(rows, "g string, score double, id long").withColumn("rank", F.lit("clash")).repartition(7)
    got = topn.top_n(df, ["g"], [("score", True), ("id", False)], 3)
    assert sorted(((r.g, r.score, r.id, r["rank"]) for r in got.collect()), key=repr) == best(rows, 3)
    assert topn.top_n(df.limit(0), ["g"], [("score", True)], 3).count() == 0 and topn.top_n(df, ["g"], [("score", True)], 0).count() == 0


def test_heap_state_is_handed_on_when_it_is_full(spark):
    import pyarrow as pa

    t = pa.RecordBatch.from_pydict({"g": ["x", "y", "x"], "s": [1.0, float("nan"), None]})
    h = topn.Heaps(["g"], [("s", True)], 1)
    h.update(t)
    assert h.take().to_pylist() == [{"g": "x", "s": 1.0}, {"g": "y", "s": pytest.approx(float("nan"), nan_ok=True)}] and h.take() is None


@pytest.mark.parametrize("state, waiting", [(400_000, 50_000), (5, 1)])
@pytest.mark.parametrize("desc", [True, False])
def test_one_order_for_nan_and_null_over_any_partitions(spark, monkeypatch, desc, state, waiting):
    monkeypatch.setattr(topn, "STATE_ROWS", state)
    monkeypatch.setattr(topn, "WAITING", waiting)
    nan, rnd = float("nan"), random.Random(9)
    rows = [(rnd.choice(["a", "b", None, "hot", "hot"]), rnd.choice([1.0, 2.0, -1.0, float("inf"), nan, None]), i) for i in range(400)] + [("few", nan, 1000), ("few", None, 1001), ("few", 0.5, 1002)]
    kind = lambda x: 2 if x is None else 1 if x != x else 0
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (kind(r[1]), (-r[1] if desc else r[1]) if kind(r[1]) == 0 else 0, r[2]))
        want += [(g, r[2], k + 1) for k, r in enumerate(own[:130])]
    for parts in (1, 4, 40):
        df = spark.createDataFrame(rows, "g string, score double, id long").repartition(parts)
        got = topn.top_n(df, ["g"], [("score", desc), ("id", False)], 130)
        assert sorted(((r.g, r.id, r["rank"]) for r in got.collect()), key=repr) == sorted(want, key=repr), parts


def test_groups_of_numbers_and_of_no_column(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2), (None, 3), (1.0, 4)], "g double, id long").repartition(3)
    assert sorted(r.id for r in topn.top_n(df, ["g"], [("id", False)], 1).collect()) == [1, 3, 4]
    assert [(r.id, r["rank"]) for r in topn.top_n(df, [], [("id", True)], 2).collect()] == [(4, 1), (3, 2)]


def test_partners_by_the_rows_own_option_set(spark):
    schema = "repo string, file_a string, file_b string, change_count long, strength double, option_set string, mined_at int"
    rows = [("r", "b", "a", 5, 0.5, "one", 1), ("r", "a", "b", 5, 0.9, "one", 2), ("r", "a", "c", 5, 0.9, "two", 1), ("r", "a", "d", 9, 0.1, "two", 1), ("r", "a", "e", 1, float("nan"), "two", 1), ("r", "a", "f", 1, 1.5, "two", 1), ("r", "a", None, 1, 0.5, "two", 1), ("r", "a", "a", 1, 1.0, "two", 1), ("r", "a", "b2", 5, 0.95, "unknown", 1), ("r", "a", "z", 1, None, "two", 9)]
    o = spark.createDataFrame([("one", 1), ("two", 3)], "option_set string, top_partners int")
    got = topn.top_partners(spark.createDataFrame(rows, schema), o)
    assert sorted((r.file_a, r.file_b, r["rank"]) for r in got.collect()) == [("a", "c", 3)]


# ---- pairs


def pairs_of(rows, max_basket=None):
    baskets, items = defaultdict(set), defaultdict(set)
    for s, b, i in rows:
        if b and b.strip() and i and i.strip():
            baskets[s, b].add(i)
    baskets = {k: v for k, v in baskets.items() if max_basket is None or len(v) <= max_basket}
    n, c, both = Counter(s for s, _ in baskets), Counter(), Counter()
    for (s, _), v in baskets.items():
        v = sorted(v)
        for i, a in enumerate(v):
            c[s, a] += 1
            for b in v[i + 1 :]:
                both[s, a, b] += 1
    return {(s, a, b): (k, c[s, a], c[s, b], n[s]) for (s, a, b), k in both.items()}


def test_pairs_of_ordinary_and_huge_baskets(spark, monkeypatch):
    from spangraph.llm import cooccurrence

    monkeypatch.setattr(cooccurrence, "HEAVY", 100)
    rnd = random.Random(3)
    rows = [(rnd.choice(["r", None]), f"b{b}", f"i{rnd.randrange(200)}") for b in range(25) for _ in range(rnd.choice([2, 5, 300]))]
    rows += [("r", None, "x"), ("r", " ", "x"), ("r", "b1", " "), ("", "b1", "i1"), ("", "b1", "i2"), (None, "b1", None)]
    df = spark.createDataFrame(rows, "scope string, basket string, item string").withColumn("count", F.lit(1))
    want = pairs_of(rows)
    got = {(r.scope, r.item_a, r.item_b): (r["count"], r.count_a, r.count_b, r.n) for r in pair_counts(df, "scope", "basket", "item", block=16).collect()}
    assert got == want
    kept = {(r.scope, r.item_a, r.item_b) for r in pair_counts(df, "scope", "basket", "item", min_count=2, min_lift=1.2, block=64).collect()}
    assert kept == {k for k, (c, a, b, n) in want.items() if c >= 2 and c * n / (a * b) >= 1.2}
    small = {(r.scope, r.item_a, r.item_b): (r["count"], r.count_a, r.count_b, r.n) for r in pair_counts(df, "scope", "basket", "item", max_basket=20).collect()}
    assert small == pairs_of(rows, 20)
    assert pair_counts(df.limit(0), "scope", "basket", "item").count() == 0


def test_paths(spark):
    df = spark.createDataFrame([("./a//b\\c",), ("a/./b",), ("././a",), ("a\\\\b",), (".a/b",), (None,)], "p string")
    assert [r.x for r in df.select(plain_path(F.col("p")).alias("x")).collect()] == ["a/b/c", "a/b", "a", "a/b", ".a/b", None]


# ---- mixes


def test_two_documents_meet_fairly():
    rng = np.random.default_rng(1)
    for x, y in [(0.3, 0.4), (0.7, 0.6), (0.5, 0.5)]:
        a, b = meet(np.full(40_000, x), np.full(40_000, y), rng.random(40_000))
        assert np.allclose(a + b, x + y) and (np.isin(a, (0.0, 1.0)) | np.isin(b, (0.0, 1.0))).all()
        assert a.mean() == pytest.approx(x, abs=0.01) and b.mean() == pytest.approx(y, abs=0.01)


def test_groups_settle_on_their_own():
    rng = np.random.default_rng(2)
    group = np.repeat(np.arange(300), rng.integers(1, 40, 300))
    p, ones = rng.choice([0.0, 0.25, 0.5, 0.9, 1.0], len(group)), np.zeros(len(group))
    for k in range(300):
        out = settle(group, p, rng.integers(0, 1 << 62, len(group)).astype(np.uint64))
        is_open = (out > 0) & (out < 1)
        assert np.bincount(group[is_open], minlength=300).max() <= 1 and np.allclose(np.bincount(group, out), np.bincount(group, p))
        ones += out
    assert abs(ones / 300 - p).max() < 0.15 and len(settle(group[:0], p[:0], np.zeros(0, np.uint64))) == 0


@pytest.mark.parametrize("bucket", [20_000, 50])
def test_the_mix_is_the_same_over_any_partitions(spark, monkeypatch, bucket):
    from spangraph.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET", bucket)
    docs = spark.createDataFrame([(i, "ab"[i % 2], 20 + i * i % 97) for i in range(2000)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    mixes = []
    for parts in (1, 4, 40):
        mixed, plan = mix(docs.repartition(parts), targets)
        mixes.append({(r.doc_id, r.copies) for r in mixed.collect()})
        got = {r.source: r.share_of_total for r in shares(mixed, plan).collect()}
        assert got["a"] == pytest.approx(0.7, abs=0.004) and got["b"] == pytest.approx(0.3, abs=0.004)
    assert mixes[0] == mixes[1] == mixes[2] and mixes[0] != {(r.doc_id, r.copies) for r in mix(docs, targets, seed=2)[0].collect()}


def test_a_lowered_total_holds_the_proportions(spark):
    docs = spark.createDataFrame([(i, "big" if i < 900 else "tiny", 50) for i in range(920)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("tiny", 0.3, 4), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in shares(*mix(docs, targets, short="shrink")).collect()}
    assert got["tiny"].mixed_tokens == 4000 and got["big"].mixed_tokens == pytest.approx(8000, abs=60) and got["none"].mixed_tokens == 0
    assert got["big"].share_of_mix == pytest.approx(2 / 3, abs=0.005) and got["tiny"].reachable and got["big"].reachable


def test_mix_reaches_its_shares_or_says_so(spark):
    rnd = random.Random(2)
    docs = [(i, "big", rnd.randrange(50, 150)) for i in range(3000)] + [(10_000 + i, "mid", rnd.randrange(50, 150)) for i in range(600)] + [(20_000 + i, "tiny", 100) for i in range(5)]
    docs += [(30_000, None, 100), (30_001, "other", 100), (30_002, "big", 0), (30_003, "big", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").repartition(40)
    t = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 3), ("tiny", 0.1, 4), ("none", 0.1, 2), (None, 0.5, 1), ("odd", None, None)], "source string, target_share double, max_repeats int")
    mixed, plan = mix(df, t)
    rows = mixed.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"big", "mid", "tiny"}
    got = {r.source: r for r in shares(mixed, plan).collect()}
    assert got["big"].share_of_total == pytest.approx(0.4, abs=0.003) and got["mid"].share_of_total == pytest.approx(0.4, abs=0.003)
    assert got["tiny"].mixed_tokens == 2000 and not got["tiny"].reachable and not got["none"].reachable and got["odd"].mixed_tokens == 0
    assert all(r.copies <= {"big": 1, "mid": 3, "tiny": 4}[r.source] for r in rows)
    factor = {r.source: r.factor for r in plan.collect()}
    for s in ("big", "mid"):
        n = sum(d[1] == s and (d[2] or 0) > 0 for d in docs)
        assert abs(sum(r.copies for r in rows if r.source == s) - n * factor[s]) < 1
    again = {(r.doc_id, r.copies) for r in mix(df, t)[0].collect()}
    assert len(again) and mix(df.limit(0), t)[0].count() == 0 and mix(df, t.limit(0))[0].count() == 0
    fixed, _ = mix(df, t, total=10_000)
    assert sum(r.copies * r.n_tokens for r in fixed.collect()) == pytest.approx(9_000 - 0, rel=0.1)
