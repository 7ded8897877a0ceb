"""Nearest vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spangraph.llm.neighbours import BITS, curve_keys, hilbert_index, nearest, referenced_vectors

SCHEMA = "id long, node long, dims int, embedding array<float>"


def test_the_curve_visits_each_cell_once_and_steps_by_one():
    bits = 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = hilbert_index(grid, bits)
    assert sorted(place) == list(range(len(grid)))
    walk = grid[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_keys_fit_and_differ_between_curves():
    x = np.random.default_rng(0).standard_normal((500, 96)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = curve_keys(x, 0), curve_keys(x, 1)
    assert (a >= 0).all() and a.max() < 1 << (6 * BITS) and (a != b).any()


def clustered(n, dims, per, noise, seed):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((n // per, dims))
    x = np.repeat(centre, per, axis=0)
    x += rng.standard_normal(x.shape) * noise * np.linalg.norm(x, axis=1)[:, None] / np.sqrt(dims)
    return (x * rng.uniform(0.1, 9, (len(x), 1))).astype(np.float32)


def brute(x, node, k, least):
    u = x.astype(float) / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    s[node[:, None] == node[None, :]] = -2
    out = set()
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), -s[i]))[:k]
        out |= {(i, int(j)) for j in order if s[i, j] >= least}
    return out


@pytest.mark.parametrize("dims, noise", [(32, 0.2), (96, 0.3)])
def test_recall(spark, dims, noise):
    x = clustered(6000, dims, 6, noise, dims)
    node = np.arange(len(x)) // 2
    df = spark.createDataFrame([(i, int(node[i]), dims, [float(v) for v in x[i]]) for i in range(len(x))], SCHEMA)
    got = {(r.id, r.other) for r in nearest(df, 5, 0.8).select("id", "other").collect()}
    want = brute(x, node, 5, 0.8)
    assert len(want) > 1000 and len(want & got) / len(want) >= 0.97 and len(want & got) / len(got) >= 0.97


@pytest.mark.parametrize("parts", [1, 8, 150])
def test_windows_reach_over_the_borders_of_partitions(spark, parts):
    from spangraph.llm import neighbours as nb

    x = clustered(3000, 32, 6, 0.2, 7)
    df = spark.createDataFrame([(i, i, 32, [float(v) for v in x[i]]) for i in range(len(x))], SCHEMA)
    settings = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        placed = nb.place_on_curves(df, {32: 1})
        order = [r.id for r in placed.select("id").orderBy("place", "id").collect()]
        near = {(order[i], order[i + d]) for i in range(len(order)) for d in (1, 2, 5, 300) if i + d < len(order)}
        # whoever stands within the reach in the order is a candidate, wherever a partition ends
        wanted = spark.createDataFrame(sorted(near), "id long, other long")
        assert nb.window_pairs(placed, 3000, -1.0).join(wanted, ["id", "other"]).distinct().select("id", "other").distinct().count() == len(near)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_seams_take_rows_from_as_many_runs_as_it_needs():
    from spangraph.llm import neighbours as nb

    runs = [(8, 0, p, 0, n) for p, n in ((10, 2000), (20, 100), (30, 700), (40, 2000))] + [(8, 1, 5, 0, 10)]
    seams = {}
    for d, c, place, first, seam, left, low, high in nb._seams(runs):
        seams.setdefault(seam, []).append((place, left, low, high))
    assert seams[1] == [(20, True, 0, 100), (10, True, 1332, 2000), (30, False, 0, 700), (40, False, 0, 68)] and len(seams) == 3


def test_near_ties_are_decided_by_exact_cosines(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(96)
    x = np.array([base] + [base + rng.standard_normal(96) * 0.001 * (1 + i / 50) for i in range(60)], dtype=np.float32)
    df = spark.createDataFrame([(i, i, 96, [float(v) for v in x[i]]) for i in range(len(x))], SCHEMA)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    rows = nearest(df, 5).collect()
    assert len(rows) == 5 * len(x) and all(abs(r.cosine - cos[r.id, r.other]) < 1e-9 for r in rows)
    ranks = {(r.id, r["rank"]): r.cosine for r in rows}
    assert all(ranks[i, k] >= ranks[i, k + 1] for i in range(len(x)) for k in range(1, 5))


def test_curves_grow_with_the_collection():
    from spangraph.llm.neighbours import curves_for

    assert [curves_for(n) for n in (0, 10, 100_000, 400_000, 1_600_000)] == [6, 6, 6, 11, 16]


def test_one_node_with_a_third_of_all_vectors_hides_nobody(spark):
    rng = np.random.default_rng(3)
    mass = rng.standard_normal(24) + rng.standard_normal((4000, 24)) * 0.02
    other = mass[::200] + rng.standard_normal((20, 24)) * 0.02
    rest = rng.standard_normal((2000, 24))
    x = np.concatenate([mass, other, rest]).astype(np.float32)
    node = np.concatenate([np.zeros(4000, int), 1 + np.arange(2020)])
    df = spark.createDataFrame([(i, int(node[i]), 24, [float(v) for v in x[i]]) for i in range(len(x))], SCHEMA)
    got = nearest(df, 3, 0.9).groupBy("id").count().filter("id < 4000")
    assert got.count() == 4000 and got.agg(F.min("count")).first()[0] == 3


def test_equal_vectors_spread_over_nodes(spark):
    df = spark.createDataFrame([(i, i % 700, 4, [1.0, 2.0, 3.0, 4.0]) for i in range(3000)], SCHEMA)
    got = nearest(df, 5, 0.88)
    assert got.groupBy("id").count().filter("count = 5").count() == 3000
    assert got.filter(F.pmod("id", F.lit(700)) == F.pmod("other", F.lit(700))).count() == 0 and got.agg(F.min("cosine")).first()[0] > 0.999


def test_odd_vectors(spark):
    ok, nan, inf = [1.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0]
    rows = [("s", 1, ok), ("s", 1, ok), ("s", 2, [1.0, 0.01]), ("s", 3, nan), ("s", 4, inf), ("s", 5, [0.0, 0.0]), ("s", 6, [1.0]), ("s", 7, None), ("s", 8, ok), ("s", None, ok), ("t", 9, [1.0, None]), ("x", 10, ok), ("t", 11, [2.0, 0.0])]
    v = spark.createDataFrame(rows, "spill_path string, vector_index long, embedding array<float>")
    s = spark.createDataFrame([("s", 2, 1), ("t", 2, 1), (None, 2, 1), ("u", None, 1)], "path string, dims int, row_count long")
    m = spark.createDataFrame([("s", k, f"n{k}") for k in (1, 2, 3, 4, 5, 6, 7)] + [("s", 1, "n1"), ("t", 9, "n9"), ("t", 11, None), ("x", 10, "n"), ("s", None, "n")], "spill_path string, vector_index long, node_id string")
    got = nearest(referenced_vectors(v, s, m), 5, 0.5)
    assert {(r.id, r.other) for r in got.collect()} == {(1, 2), (1, 11), (2, 1), (2, 11), (11, 1), (11, 2)}
    assert nearest(referenced_vectors(v.limit(0), s, m), 5, 0.5).count() == 0
