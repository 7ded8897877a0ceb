"""Processing only new or changed records, with a persisted key and hash state.

A state is a folder of delta folders and of numbered manifests. A run reads the newest manifest,
takes the greatest row of each key from the deltas it names, joins the records delivered since, writes
the keys whose row moved as one more delta, and publishes the next manifest by a rename that fails
if that number is already there. That is a compare-and-swap: of two runs that started from one manifest one
wins, and the other one starts again from the winner's. A run that dies before the rename has changed
nothing, so the next run sees the same records again and none twice; one that dies after it has finished.
Nothing that a manifest names is ever changed or deleted, so readers of older manifests are safe.

A manifest also has the ids of all runs that were applied, each with a fingerprint of what was
delivered. An id that comes again, however much later, changes nothing and gives that run's changes
again; the same id with other records is refused, or taken as a run of its own.

Defined results: a null key is no record; a null hash differs from every hash, also from another
null; a null stamp is older than any other; repeated rows count once; an empty delivery changes
nothing but still makes a manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import hadoop_path, materialise

MANIFESTS = "MANIFESTS"
#: Deltas that a state is read from; one more makes a run put them together into a new base.
MOST_DELTAS = 8
#: Delivered keys up to this number are sent to the state; with more of them the state is shuffled and joined.
MOST_BROADCAST = 200_000
#: How often a run starts again because another one was faster.
MOST_TRIES = 20


class Conflict(RuntimeError):
    """Another writer has published this manifest number."""


class VersionedState:
    """Delta folders with numbered manifests that are published by compare-and-swap.

    The rename that publishes is atomic on file systems with atomic renames (HDFS, local disks).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> dict:
        """The newest manifest: ``number, last, base, deltas, applied``."""
        fs, at = hadoop_path(self.spark, f"{self.path}/{MANIFESTS}")
        names = [int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()] if fs.exists(at) else []
        if not names:
            return {"number": 0, "last": None, "base": None, "deltas": [], "applied": {}}
        stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(at, f"{max(names):010}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> int | str | None:
        """The run that was applied last."""
        return self.manifest()["last"]

    def write(self, rows: DataFrame) -> str:
        """Write a delta without publishing it."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/delta={name}")
        return name

    def read(self, names: list[str], schema: T.StructType) -> DataFrame:
        """Rows of deltas with the ``delta`` they are of; the schema is given since a delta may have no file."""
        schema = T.StructType([*schema.fields, T.StructField("delta", T.StringType())])
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/delta={n}" for n in names])

    def publish(self, manifest: dict) -> None:
        """Publish a manifest under its number, unless that number is there already."""
        fs, at = hadoop_path(self.spark, f"{self.path}/{MANIFESTS}")
        fs.mkdirs(at)
        jvm = self.spark._jvm
        aside = jvm.org.apache.hadoop.fs.Path(at, f".{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        target = jvm.org.apache.hadoop.fs.Path(at, f"{manifest['number']:010}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, target, options)
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(target):
                raise Conflict(f"manifest {manifest['number']} is there already") from e
            raise


def clean_hash(hash_: Column) -> Column:
    """Hashes compare in lower case and without white space around them."""
    return F.lower(F.regexp_replace(hash_, r"^\s+|\s+$", ""))


def content_hash(*columns: Column) -> Column:
    """A hash of a row's content that tells null from empty text and keeps column borders."""
    parts = [F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(c.cast("string")), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def latest(rows: DataFrame, key: str, stamp: Iterable[str], hash_: str) -> DataFrame:
    """Per key the row with the greatest stamp; combined on the map side, so a hot key is no hot task."""
    fields = [*stamp, hash_]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*fields)).alias("now"))


def fingerprint(rows: DataFrame) -> str:
    """The number of rows and a sum of their hashes: the same for the same rows in any order."""
    return _print(rows.agg(*_sums(*rows.columns)).first())


def _sums(*columns: str) -> list[Column]:
    return [F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s")]


def _print(r) -> str:
    return f"{r.n}:{r.s or 0}" if r else "0:0"


def advance(state: VersionedState, delivered: DataFrame, version: int | str, key: str, stamp: list[str], hash_: str, *, reuse: str = "refuse") -> DataFrame:
    """Apply what run ``version`` delivered and return the keys that are new or changed by it.

    A key is changed if its greatest row has another first stamp column than the state's and a hash
    that is null or differs. A run that was applied before, at any time, applies nothing and returns
    its changes again. If the records are others than then, ``reuse`` says what it is: "refuse" raises
    ValueError, "apply" takes it as a run of its own.
    """
    new = materialise(latest(delivered, key, stamp, hash_), "delivered")
    return _apply(state, new, version, fingerprint(new), key, stamp[0], hash_, reuse)


def current(state: VersionedState, manifest: dict, like: DataFrame, key: str, only: DataFrame | None = None) -> DataFrame | None:
    """The greatest row ``now`` of each key as of a manifest, or None before the first; ``like`` has ``key, now``.

    With ``only`` just the keys in it: a small delivery is sent to the state, and the state isn't shuffled.
    """
    names = [*([manifest["base"]] if manifest["base"] else []), *manifest["deltas"]]
    if not names:
        return None
    rows = state.read(names, like.select(key, "now").schema)
    if only is not None:
        rows = rows.join(only.select(key), key, "left_semi")
    return rows.groupBy(key).agg(F.max("now").alias("now"))


def _apply(state: VersionedState, new: DataFrame, version: int | str, print_: str, key: str, first: str, hash_: str, reuse: str) -> DataFrame:
    """``advance`` for rows ``key, now``, one a key."""
    new = new.select(key, "now")
    schema = T.StructType([*new.schema.fields, T.StructField("changed", T.IntegerType())])
    run, again = str(version), f"{version}#{print_}"
    for _ in range(MOST_TRIES):
        manifest = state.manifest()
        applied = manifest["applied"]
        done = next((applied[n] for n in (run, again) if n in applied and applied[n]["fingerprint"] == print_), None)
        if done is None and run in applied and reuse != "apply":
            raise ValueError(f"run {run} was applied with other records")
        if done is None:
            few = int(print_.split(":")[0]) <= MOST_BROADCAST
            before = current(state, manifest, new, key, only=F.broadcast(new.select(key)) if few else None)
            if before is None:
                moved = new.withColumn("changed", F.lit(1))
            else:
                both = new.join(before.withColumnRenamed("now", "was"), key, "left").filter(F.col("was").isNull() | (F.col("now") > F.col("was")))
                other = ~F.col("now")[first].eqNullSafe(F.col("was")[first])
                differs = F.coalesce(F.col("now")[hash_] != F.col("was")[hash_], F.lit(True))
                moved = both.select(key, "now", (F.col("was").isNull() | (other & differs)).cast("int").alias("changed"))
            done = {"folder": state.write(moved), "fingerprint": print_}
            following = manifest | {"number": manifest["number"] + 1, "last": version, "deltas": [*manifest["deltas"], done["folder"]]}
            following["applied"] = applied | {again if run in applied else run: done}
            if len(following["deltas"]) > MOST_DELTAS:
                whole = current(state, following, new, key)
                following |= {"base": state.write(whole.withColumn("changed", F.lit(0))), "deltas": []}
            try:
                state.publish(following)
            except Conflict:
                continue
        return state.read([done["folder"]], schema).filter("changed = 1").select(key, F.col("now")[hash_].alias(hash_))
    raise Conflict(f"run {run} was overtaken {MOST_TRIES} times")


def replay(state: VersionedState, log: DataFrame, good_runs: list[int], run: str, key: str, stamp: list[str], hash_: str) -> DataFrame:
    """Advance a state over all successful runs of a delivery log; rows ``run, key, hash`` of the changes.

    Rows that failed or killed runs delivered count at the next successful run. The log is scanned
    once and kept by the run at which its rows count, so each run reads its own rows only, and the
    changes of all runs are read as one table.
    """
    runs = sorted(set(good_runs))
    out = T.StructType([T.StructField(run, T.IntegerType()), log.schema[key], log.schema[hash_]])
    if not runs:
        return log.sparkSession.createDataFrame([], out)
    # the first successful run from the row's own run on
    at = F.get(F.filter(F.array(*[F.lit(r) for r in runs]), lambda r: r >= F.col(run)), 0)
    counted = log.withColumn("at_run", at).filter(F.col("at_run").isNotNull() & F.col(key).isNotNull())
    counted = counted.groupBy("at_run", key).agg(F.max(F.struct(*stamp, hash_)).alias("now"))
    folder = f"{state.path}/log-{uuid.uuid4().hex}"
    counted.write.partitionBy("at_run").parquet(folder)
    by_run = log.sparkSession.read.schema(T.StructType([*counted.select(key, "now").schema.fields, T.StructField("at_run", T.IntegerType())])).parquet(folder)
    prints = {r.at_run: _print(r) for r in by_run.groupBy("at_run").agg(*_sums(key, "now")).collect()}  # one row a run
    for r in runs:
        _apply(state, by_run.filter(F.col("at_run") == r), r, prints.get(r, _print(None)), key, stamp[0], hash_, "refuse")
    applied = state.manifest()["applied"]
    run_of = F.create_map(*[F.lit(x) for r in runs for x in (applied[str(r)]["folder"], r)])
    schema = T.StructType([*counted.select(key, "now").schema.fields, T.StructField("changed", T.IntegerType())])
    rows = state.read([applied[str(r)]["folder"] for r in runs], schema).filter("changed = 1")
    return rows.select(run_of[F.col("delta")].cast("int").alias(run), key, F.col("now")[hash_].alias(hash_))
