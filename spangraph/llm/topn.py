"""Top N items within every group by a mergeable bounded heap.

The heap of a group holds its N best rows. It is an aggregate with the three steps of one: ``update``
adds rows, ``merge`` puts two heaps together, and the result is the same for any order of both.
Every task builds its heaps before the shuffle, so a group that holds a third of all rows sends
N rows a task and not its rows. Behind the shuffle the heaps of a group are merged by the same
code and their rows get their rank. A task that sees very many groups hands its heaps on when
they fill its memory; that costs rows in the shuffle and changes no result.

A heap is kept as its rows in order, and all heaps of a task as one Arrow table, so many small groups
cost one sort for thousands of rows and not a loop for each.

Defined results: rows are compared by the given columns in turn, the last of which should be a
unique identifier; with equal columns any of the equal rows is kept. Null comes last in either
direction, NaN before null, in all steps. Null is a group of its own. An empty table gives an empty
result. A column that already has the name of the rank is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of heaps that a task holds before it hands them on; merging later gives the same result.
STATE_ROWS = 400_000
#: Rows that wait before they are put into the heaps together.
WAITING = 50_000


class Heaps:
    """The N best rows of each group seen so far, as one table sorted by group and order."""

    def __init__(self, group: list[str], order: list[tuple[str, bool]], n: int):
        self.group, self.order, self.n = group, order, n
        self.kept: pa.Table | None = None
        self.waiting: list[pa.Table] = []
        self.rows = 0

    def update(self, batch: pa.RecordBatch) -> None:
        """Add rows; those of one batch are cut to N a group first."""
        best = self._best(pa.Table.from_batches([batch]))
        self.waiting.append(best)
        self.rows += best.num_rows
        # merge when as much is waiting as is kept, so that each row is sorted a few times only
        if self.rows > max(WAITING, self.size()):
            self.merge()

    def merge(self) -> None:
        """Put all heaps together."""
        if self.waiting:
            self.kept = self._best(pa.concat_tables([*([] if self.kept is None else [self.kept]), *self.waiting]))
            self.waiting, self.rows = [], 0

    def size(self) -> int:
        return 0 if self.kept is None else self.kept.num_rows

    def take(self) -> pa.Table | None:
        """All heaps; afterwards there are none."""
        self.merge()
        kept, self.kept = self.kept, None
        return kept

    def _best(self, rows: pa.Table) -> pa.Table:
        if rows.num_rows == 0 or self.n <= 0:
            return rows.slice(0, 0)
        rank, at = self.ranks(rows)
        keep = at[rank < self.n]
        return rows.take(pa.array(keep)).combine_chunks()

    def ranks(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The rank from 0 of each row within its group, and where the row stands; both in the order."""
        keys, by = [], []
        for i, g in enumerate(self.group):
            keys.append(rows[g])
            by.append((f"g{i}", "ascending"))
        for i, (c, descending) in enumerate(self.order):
            column = rows[c]
            if pa.types.is_floating(column.type):
                # 0 for numbers, 1 for NaN, 2 for null, ahead of the value, so that both come last in either direction
                kind = pc.if_else(pc.is_null(column), 2, pc.if_else(pc.fill_null(pc.is_nan(column), False), 1, 0))
                keys.append(kind)
                by.append((f"k{i}", "ascending"))
                column = pc.if_else(pc.equal(kind, 0), column, pa.scalar(0.0, column.type))
            keys.append(column)
            by.append((f"o{i}", "descending" if descending else "ascending"))
        table = pa.table(keys, names=[name for name, _ in by])
        at = pc.sort_indices(table, sort_keys=by, null_placement="at_end").to_numpy()
        first = np.zeros(len(at), dtype=bool)
        first[0] = True
        for i in range(len(self.group)):
            column = table[f"g{i}"].take(pa.array(at)).combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks)
            a, b = column.slice(1), column.slice(0, len(column) - 1)
            unequal = pc.fill_null(pc.not_equal(a, b), False)
            if pa.types.is_floating(column.type):  # NaN is one group
                unequal = pc.and_not(unequal, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
            differs = pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b)))
            first[1:] |= differs.to_numpy(zero_copy_only=False)
        place = np.arange(len(at))
        return place - np.maximum.accumulate(np.where(first, place, 0)), at


def top_n(df: DataFrame, group: list[str], order: list[tuple[str, bool]], n: int, rank: str = "rank") -> DataFrame:
    """The n best rows of each group with their rank from 1; ``order`` has (column, descending)."""
    df = df.drop(rank)
    schema = T.StructType([*df.schema.fields, T.StructField(rank, T.IntegerType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(group, order, n)
        for batch in batches:
            heaps.update(batch)
            if heaps.size() > STATE_ROWS:
                yield from heaps.take().to_batches()
        if (rest := heaps.take()) is not None:
            yield from rest.to_batches()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task has its rows sorted by group, so whole groups leave as soon as the next one has begun
        heaps, last = Heaps(group, order, n), None
        for batch in batches:
            if not batch.num_rows:
                continue
            heaps.update(batch)
            if heaps.size() > STATE_ROWS:
                heaps.merge()
                last, done = _open_group(heaps, group)
                if done.num_rows:
                    yield from _ranked(heaps, done, rank)
                heaps.kept = last
        if (rest := heaps.take()) is not None and rest.num_rows:
            yield from _ranked(heaps, rest, rank)

    heaps = df.mapInArrow(partial, df.schema)
    together = heaps.repartition(*group).sortWithinPartitions(*[F.col(g).asc_nulls_last() for g in group]) if group else heaps.repartition(1)
    return together.mapInArrow(final, schema)


def _open_group(heaps: Heaps, group: list[str]) -> tuple[pa.Table, pa.Table]:
    """The heap of the group that comes last, which may get more rows, and all other heaps."""
    kept = heaps.kept
    rank, at = heaps.ranks(kept)
    begin = int(np.flatnonzero(rank == 0)[-1])
    return kept.take(pa.array(at[begin:])).combine_chunks(), kept.take(pa.array(at[:begin])).combine_chunks()


def _ranked(heaps: Heaps, rows: pa.Table, rank: str) -> Iterator[pa.RecordBatch]:
    place, at = heaps.ranks(rows)
    out = rows.take(pa.array(at))
    yield from out.append_column(rank, pa.array((place + 1).astype(np.int32))).to_batches()


def current_pairs(pairs: DataFrame) -> DataFrame:
    """Valid mined pairs in byte order of their files, the latest mining of each.

    Left out: strength null, NaN or not in (0, 1]; a file that is null; a file paired with itself.
    With equal mined_at the greatest (strength, change_count, option_set) holds.
    """
    a, b = F.least("file_a", "file_b"), F.greatest("file_a", "file_b")
    valid = pairs.filter("file_a is not null and file_b is not null and file_a <> file_b and strength is not null and not isnan(strength) and strength > 0 and strength <= 1")
    newest = valid.select("repo", a.alias("file_a"), b.alias("file_b"), F.struct("mined_at", "strength", "change_count", "option_set").alias("m"))
    newest = newest.groupBy("repo", "file_a", "file_b").agg(F.max("m").alias("m"))
    return newest.select("repo", "file_a", "file_b", "m.strength", "m.change_count", "m.option_set")


def top_partners(pairs: DataFrame, options: DataFrame) -> DataFrame:
    """The first partners of each (repo, file_a), as many as the row's option set allows.

    A row whose option set is unknown takes part in the ranking and is never a result itself.
    """
    options = options.select("option_set", "top_partners").filter("option_set is not null").groupBy("option_set").agg(F.max("top_partners").alias("top_partners"))
    n = options.agg(F.max("top_partners").alias("n")).first().n or 0
    ranked = top_n(current_pairs(pairs), ["repo", "file_a"], [("strength", True), ("change_count", True), ("file_b", False)], n)
    return ranked.join(options, "option_set").filter("rank <= top_partners").drop("top_partners")
