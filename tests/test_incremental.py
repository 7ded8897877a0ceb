"""The state survives failures, repeats nothing and skips nothing."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from spangraph.operators.incremental import Conflict, VersionedState, advance, clean_hash, content_hash, replay

SCHEMA = "run int, node string, at timestamp_ntz, row long, h string"
T0 = dt.datetime(2026, 1, 1)


def state(spark, tmp_path):
    return VersionedState(spark, f"file://{tmp_path}/state")


def changes(df):
    return sorted((r.node, r.h) for r in df.collect())


def run(spark, st, rows, version):
    return changes(advance(st, spark.createDataFrame(rows, SCHEMA), version, "node", ["at", "row"], "h"))


def test_new_changed_unchanged_late_and_null(spark, tmp_path):
    st = state(spark, tmp_path)
    t = lambda k: T0 + dt.timedelta(hours=k)
    assert st.version() is None
    assert run(spark, st, [(1, "a", t(1), 1, "x"), (1, "a", t(1), 2, "x"), (1, "b", t(1), 3, None), (1, None, t(1), 4, "y")], 1) == [("a", "x"), ("b", None)]
    assert run(spark, st, [(2, "a", t(2), 5, "x"), (2, "b", t(2), 6, None)], 2) == [("b", None)]  # the same hash again; null differs from null
    assert run(spark, st, [(3, "a", t(0), 7, "z"), (3, "c", None, 8, "c")], 3) == [("c", "c")]  # delivered late, and without a time
    assert run(spark, st, [], 4) == []
    assert run(spark, st, [(5, "a", t(9), 9, "new"), (5, "c", t(1), 10, "c")], 5) == [("a", "new")]
    assert st.version() == 5


def test_a_run_that_dies_before_publishing_is_repeated_as_a_whole(spark, tmp_path, monkeypatch):
    st = state(spark, tmp_path)
    run(spark, st, [(1, "a", T0, 1, "x")], 1)
    rows = [(2, "a", T0 + dt.timedelta(1), 2, "y"), (2, "b", T0, 3, "b")]

    def die(name):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(st, "publish", die)
        with pytest.raises(OSError):
            run(spark, st, rows, 2)
    assert st.version() == 1
    assert run(spark, st, rows, 2) == [("a", "y"), ("b", "b")]
    assert run(spark, st, rows, 2) == [("a", "y"), ("b", "b")]  # after publishing: the same answer, applied once


def test_an_older_run_that_is_called_again(spark, tmp_path):
    st, day = state(spark, tmp_path), dt.timedelta(1)
    one, two = [(1, "a", T0, 1, "x"), (1, "b", T0, 2, "y")], [(2, "a", T0 + day, 3, "z")]
    assert run(spark, st, one, 1) == [("a", "x"), ("b", "y")] and run(spark, st, two, 2) == [("a", "z")]
    assert run(spark, st, one, 1) == [("a", "x"), ("b", "y")] and st.version() == 2
    assert run(spark, st, two, 2) == [("a", "z")]
    assert run(spark, st, [(3, "a", T0 + 2 * day, 4, "z"), (3, "b", T0 + day, 5, "Y")], 3) == [("b", "Y")]


def test_a_number_that_is_used_for_other_records(spark, tmp_path):
    st = state(spark, tmp_path)
    run(spark, st, [(1, "a", T0, 1, "x")], 1)
    with pytest.raises(ValueError, match="other records"):
        run(spark, st, [(1, "c", T0, 9, "c")], 1)
    other = spark.createDataFrame([(1, "c", T0, 9, "c")], SCHEMA)
    go = lambda: changes(advance(st, other, 1, "node", ["at", "row"], "h", reuse="apply"))
    assert go() == [("c", "c")] and go() == [("c", "c")]
    assert run(spark, st, [(2, "c", T0 + dt.timedelta(1), 10, "c"), (2, "a", T0, 1, "x")], 2) == []


def test_two_writers(spark, tmp_path, monkeypatch):
    st, other = state(spark, tmp_path), state(spark, tmp_path)
    run(spark, st, [(1, "a", T0, 1, "x")], 1)
    publish, first = st.publish, []

    def late(manifest):
        if not first:  # another run publishes while this one is writing
            first.append(run(spark, other, [(2, "a", T0 + dt.timedelta(2), 2, "y"), (2, "b", T0, 3, "b")], 2))
        publish(manifest)

    monkeypatch.setattr(st, "publish", late)
    assert run(spark, st, [(3, "a", T0 + dt.timedelta(1), 4, "z"), (3, "b", T0 + dt.timedelta(1), 5, "B")], 3) == [("b", "B")]
    assert first == [[("a", "y"), ("b", "b")]] and sorted(st.manifest()["applied"]) == ["1", "2", "3"] and st.manifest()["number"] == 3
    with pytest.raises(Conflict):
        other.publish(other.manifest())


def test_deltas_are_put_together_and_stay_readable(spark, tmp_path):
    st = state(spark, tmp_path)
    reader = run(spark, st, [(0, k, T0, i, "0") for i, k in enumerate("abc")], 0) and st.manifest()
    for r in range(1, 11):
        assert run(spark, st, [(r, "a", T0 + dt.timedelta(r), 10 + r, str(r // 2))], r) == ([("a", str(r // 2))] if r % 2 == 0 else [])
    now = st.manifest()
    assert now["base"] and len(now["deltas"]) < 9 and st.read(reader["deltas"], spark.createDataFrame([], "node string").schema).count() == 3
    assert run(spark, st, [(1, "c", T0, 2, "0"), (1, "b", T0 + dt.timedelta(1), 99, "0")], 99) == []


def test_replay_against_a_plain_loop(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.randrange(1, 9), rnd.choice("abcdef"), T0 + dt.timedelta(hours=rnd.randrange(60)), i, rnd.choice(["x", "y", None])) for i in range(150)]
    good = [2, 3, 6, 8]
    want, before = [], {}
    for g in good:
        now = {}
        for r in rows:
            if r[0] <= g and (r[1] not in now or (r[2], r[3]) > now[r[1]][:2]):
                now[r[1]] = (r[2], r[3], r[4])
        for n, (at, _, h) in now.items():
            old = before.get(n)
            if old is None or (at != old[0] and (h is None or old[2] is None or h != old[2])):
                want.append((g, n, h))
        before = now
    got = replay(state(spark, tmp_path), spark.createDataFrame(rows, SCHEMA), good, "run", "node", ["at", "row"], "h")
    assert sorted((r.run, r.node, r.h or "") for r in got.collect()) == sorted((a, b, c or "") for a, b, c in want)


def test_no_successful_run(spark, tmp_path):
    out = replay(state(spark, tmp_path), spark.createDataFrame([], SCHEMA), [], "run", "node", ["at", "row"], "h")
    assert out.columns == ["run", "node", "h"] and out.count() == 0


def test_hashes(spark):
    df = spark.createDataFrame([(" AB\t\n", None, ""), ("ab", "", None)], "a string, b string, c string")
    rows = df.select(clean_hash(F.col("a")).alias("h"), content_hash(F.col("b"), F.col("c")).alias("c")).collect()
    assert rows[0].h == rows[1].h == "ab" and rows[0].c != rows[1].c


def test_a_stream_batch_that_is_repeated(spark, tmp_path):
    from spangraph.streaming import refresh

    folder = tmp_path / "in"
    schema = "node string, at timestamp_ntz, row long, h string"
    spark.createDataFrame([("a", T0, 1, "x"), ("b", T0, 2, "y")], schema).coalesce(1).write.parquet(str(folder))
    st, got = state(spark, tmp_path), []
    def go(check):
        stream = spark.readStream.schema(schema).parquet(str(folder))
        q = refresh(stream, st, lambda c, n, full: got.append((n, changes(c), full)), key="node", stamp=["at", "row"], hash_="h", checkpoint=f"{tmp_path}/{check}", available_now=True)
        q.awaitTermination()
    go("c1")
    shutil.rmtree(tmp_path / "c1")  # the engine forgets the batch and repeats it
    go("c2")
    assert got == [(0, [("a", "x"), ("b", "y")], False)] * 2 and st.version() == 0


def test_a_stream_with_a_new_checkpoint_and_other_records(spark, tmp_path):
    from spangraph.streaming import refresh

    schema, st, got = "node string, at timestamp_ntz, row long, h string", state(spark, tmp_path), []
    for k, rows in enumerate([[("a", T0, 1, "x")], [("c", T0, 2, "z"), ("a", T0, 1, "x")]]):
        folder = f"{tmp_path}/in{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
        q = refresh(spark.readStream.schema(schema).parquet(folder), st, lambda c, n, full: got.append((n, changes(c))), key="node", stamp=["at", "row"], hash_="h", checkpoint=f"{tmp_path}/c{k}", available_now=True)
        q.awaitTermination()
    assert got == [(0, [("a", "x")]), (0, [("c", "z")])]
