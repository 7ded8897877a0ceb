"""Most similar vectors of every vector by shifted space-filling curves.

Each vector is scaled to length 1 and projected to a few random orthogonal directions; the cell of
the shifted projection gives its place on a Hilbert curve. Several such curves, each with its own
directions and shift, order all vectors; Spark range-partitions and sorts every order, and within a
partition each block of vectors is compared with a window of its neighbours in the order by one
matrix product. The rows at both ends of a partition are handed on and compared with those of the
partitions beside it, so windows reach over the borders and the number of partitions doesn't
matter. The best of each vector over all curves are merged and reranked.

Vectors travel as half-precision numbers, so a cosine from a window is off by less than ERROR. Where
that could decide (about the threshold, or about who is among the first k), the candidates are
reranked by their exact cosine in double precision.

Nothing is compared outside a window, so near neighbours are missed only if they are far apart on
every curve. A window covers a smaller part of a larger collection, so the number of curves grows
with the logarithm of the number of vectors (``curves_for``); recall is measured in the README.

Skew: the sort key ends in the vector's id, so any number of equal vectors is spread over tasks. A
node with more vectors in a stretch than a window holds would hide other nodes' vectors, so its
vectors are compared a second time, with the order that has that node left out.

Defined results: vectors that are null, of another length than asked for, with a value that is not
finite, or all zero take no part; of several rows of one id the greatest vector holds; no vector
has a vector of its own node as neighbour, and all vectors without a node count as one node. Of the
candidates that the windows give, equal cosines go to the smaller id; a window with more than k + SLACK equal
ones gives any of them, and smaller ids outside the windows are not seen, so among many equal
vectors the partners depend on the windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise

AXES, BITS = 6, 10
#: Half of the grid is this many times the typical length of a projection to either side.
SPREAD = 4.0
#: Rows compared at a time, and how far the window reaches to either side of them.
BLOCK, REACH = 512, 768
#: Rows of one curve that are held at a time; the next stretch begins 2 * REACH rows earlier.
STRETCH = 32_768
#: Two unit vectors in half precision have a cosine that is off by less than this (2 * 2**-11).
ERROR = 0.001
#: Candidates beyond k that a window keeps, so that rounding loses none of the first k.
SLACK = 3
#: Ids to rerank are sent to every task up to this number, and joined by a shuffle beyond it.
MOST_BROADCAST = 1_000_000


def curves_for(n: int) -> int:
    """Curves for n vectors: five more for each four times as many beyond 100,000, as measured for a recall of 0.95."""
    return max(6, round(6 + 2.5 * np.log2(max(n, 1) / 100_000)))


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of cells (n rows, one column an axis), by Skilling's transform."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    index = np.zeros_like(x[0])
    for i in range(n):
        x[i] ^= t
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def directions(dims: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """The random orthogonal axes and the shift of one curve; the same in every task."""
    rng = np.random.default_rng([dims, curve])
    axes = min(AXES, dims)
    return np.linalg.qr(rng.standard_normal((dims, axes)))[0].astype(np.float32), rng.random(axes).astype(np.float32)


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    """Curve places of unit vectors: half of the grid is for the projection, the other half room for the shift."""
    axes, shift = directions(unit.shape[1], curve)
    at = np.clip(unit @ axes * (np.sqrt(unit.shape[1]) / SPREAD), -1, 1)
    cells = ((at + 1) / 2 + shift) / 2 * (1 << BITS)
    return hilbert_index(np.clip(cells.astype(np.int64), 0, (1 << BITS) - 1), BITS)


def place_on_curves(vectors: DataFrame, curves: dict[int, int]) -> DataFrame:
    """``id, node, dims, embedding`` to one row a curve with the unit vector in half precision; ``curves`` by dims."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nodes, dims = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                lists = batch.column(3).take(pa.array(at))
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(at), int(d))
                wide = flat.astype(np.float64)
                norm = np.sqrt((wide * wide).sum(1))
                good = np.isfinite(wide).all(1) & (norm > 0)
                at, unit = at[good], (wide[good] / norm[good, None]).astype(np.float32)
                if not len(at):
                    continue
                half = np.ascontiguousarray(unit.astype(np.float16))
                width = half.shape[1] * 2
                offsets = pa.py_buffer(np.arange(0, (len(at) + 1) * width, width, dtype=np.int32))
                code = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(half)])
                for c in range(curves[int(d)]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), c, np.int32)), pa.array(curve_keys(unit, c)), pa.array(ids[at]), pa.array(nodes[at]), code],
                        names=["dims", "curve", "place", "id", "node", "code"],
                    )

    return vectors.mapInArrow(place, "dims int, curve int, place long, id long, node long, code binary")


def _top(sims: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the at most k + SLACK greatest values of each row that reach ``least``."""
    k = k + SLACK
    if sims.shape[1] > k:
        hits = sims >= least
        many = np.flatnonzero(hits.sum(1) > k)
        r, c = np.nonzero(hits)
        if len(many):
            single = ~np.isin(r, many)
            best = np.argpartition(-sims[many], k - 1, axis=1)[:, :k]
            r = np.concatenate((r[single], np.repeat(many, k)))
            c = np.concatenate((c[single], best.ravel()))
        return r, c
    return np.nonzero(sims >= least)


def _compare(unit: np.ndarray, node: np.ndarray, ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best pairs within the windows of one stretch of one curve."""
    n, left, right, cosine = len(ids), [], [], []

    def take(rows: np.ndarray, cols: np.ndarray) -> None:
        sims = unit[rows] @ unit[cols].T
        sims[node[rows][:, None] == node[cols][None, :]] = -2
        r, c = _top(sims, k, least)
        left.append(ids[rows[r]])
        right.append(ids[cols[c]])
        cosine.append(sims[r, c])

    every = np.arange(n)
    for s in range(0, n, BLOCK):
        take(every[s : s + BLOCK], every[max(0, s - REACH) : s + BLOCK + REACH])
    crowded, count = np.unique(node, return_counts=True)
    for h in crowded[count > REACH]:
        own, rest = np.flatnonzero(node == h), np.flatnonzero(node != h)
        place = np.searchsorted(rest, own)
        for s in range(0, len(own), 128):
            cols = rest[max(0, place[s] - REACH) : place[min(s + 128, len(own)) - 1] + REACH]
            if len(cols):
                take(own[s : s + 128], cols)
    return np.concatenate(left), np.concatenate(right), np.concatenate(cosine)


def _codes(column: pa.Array, dims: int) -> np.ndarray:
    """Half-precision vectors of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return values.view(np.float16).reshape(len(column), dims)


def _binary(half: np.ndarray) -> pa.Array:
    half = np.ascontiguousarray(half)
    offsets = np.arange(0, (len(half) + 1) * half.shape[1] * 2, half.shape[1] * 2, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(half), [None, pa.py_buffer(offsets), pa.py_buffer(half)])


_WINDOWS = "id long, other long, cosine float, dims int, curve int, place long, first long, at long, rows long, node long, code binary"
_PAIR, _STRIP = ["id", "other", "cosine"], ["id", "dims", "curve", "place", "first", "at", "rows", "node", "code"]


def _record(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    """A batch of the common schema with null for the columns that aren't given."""
    kinds = {"id": pa.int64(), "other": pa.int64(), "cosine": pa.float32(), "dims": pa.int32(), "curve": pa.int32(), "code": pa.binary()}
    names = [x.split()[0] for x in _WINDOWS.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kinds.get(c, pa.int64()))) for c in names], names=names)


class _Run:
    """The rows of one curve within one partition: pairs of its windows, and the strips at its ends."""

    def __init__(self, dims: int, curve: int, place: int, first: int, k: int, least: float):
        self.name = (dims, curve, place, first)
        self.k, self.least = k, least
        self.held: list[tuple] = []
        self.rows = self.fresh = self.seen = 0
        self.head: list[tuple] = []
        self.tail: list[tuple] = []
        self.tail_rows = 0

    def add(self, ids: np.ndarray, node: np.ndarray, half: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.seen < REACH:
            self.head.append(tuple(x[: REACH - self.seen] for x in (ids, node, half)))
        self.tail.append((ids, node, half))
        self.tail_rows += len(ids)
        while self.tail_rows - len(self.tail[0][0]) >= REACH:
            self.tail_rows -= len(self.tail.pop(0)[0])
        self.held.append((ids, node, half))
        self.seen, self.rows, self.fresh = self.seen + len(ids), self.rows + len(ids), self.fresh + len(ids)
        if self.rows >= STRETCH:
            yield self.compare(True)

    def compare(self, keep: bool) -> pa.RecordBatch:
        ids, node, half = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        a, b, s = _compare(half.astype(np.float32), node, ids, self.k, self.least)
        tail = slice(len(ids) - 2 * REACH, None) if len(ids) > 2 * REACH else slice(None)
        self.held = [(ids[tail], node[tail], half[tail])] if keep else []
        self.rows, self.fresh = len(self.held[0][0]) if keep else 0, 0
        return _record({"id": pa.array(a), "other": pa.array(b), "cosine": pa.array(s.astype(np.float32))}, len(a))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.fresh:
            yield self.compare(False)
        head, tail = ([np.concatenate([h[i] for h in part]) for i in range(3)] for part in (self.head, self.tail))
        at = np.arange(len(head[0]))
        # the last REACH rows, without those that are in the head already
        cut = min(len(tail[0]), REACH, self.seen - len(head[0]))
        if cut > 0:
            at = np.concatenate((at, np.arange(self.seen - cut, self.seen)))
            head = [np.concatenate((h, t[len(t) - cut :])) for h, t in zip(head, tail)]
        ids, node, half = head
        n = len(ids)
        names = {c: pa.array(np.full(n, v), t) for c, v, t in zip(("dims", "curve", "place", "first"), self.name, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))}
        yield _record(names | {"id": pa.array(ids), "at": pa.array(at), "rows": pa.array(np.full(n, self.seen)), "node": pa.array(node), "code": _binary(half)}, n)


def _seams(runs: list[tuple]) -> list[tuple]:
    """``dims, curve, place, first, seam, left, low, high``: which rows of which run meet at which border.

    A border takes the REACH rows before it and behind it, from as many runs as these are in.
    """
    runs, out, seam = sorted(runs), [], 0
    for i in range(1, len(runs)):
        if runs[i][:2] != runs[i - 1][:2]:
            continue
        for left, step, j in ((True, -1, i - 1), (False, 1, i)):
            need = REACH
            while need > 0 and 0 <= j < len(runs) and runs[j][:2] == runs[i][:2]:
                n = runs[j][4]
                out.append((*runs[j][:4], seam, left, max(0, n - need) if left else 0, n if left else min(n, need)))
                need, j = need - n, j + step
        seam += 1
    return out


def window_pairs(placed: DataFrame, k: int, least: float) -> DataFrame:
    """Candidates of every curve: sorted windows compared block by block, and windows over the borders of partitions."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: _Run | None = None
        for batch in batches:
            dims, curves, place, ids, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            change = np.flatnonzero((dims[1:] != dims[:-1]) | (curves[1:] != curves[:-1])) + 1
            for s, e in zip([0, *change], [*change, len(ids)]):
                if e == s:
                    continue
                if run is None or run.name[:2] != (dims[s], curves[s]):
                    if run is not None:
                        yield from run.end()
                    run = _Run(int(dims[s]), int(curves[s]), int(place[s]), int(ids[s]), k, least)
                yield from run.add(ids[s:e], node[s:e], _codes(batch.column(5).slice(s, e - s), int(dims[s])))
        if run is not None:
            yield from run.end()

    def over_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        open_ = None

        def flush() -> Iterator[pa.RecordBatch]:
            left, ids, node, half = (np.concatenate([h[i] for h in held]) for i in range(4))
            unit = half.astype(np.float32)
            rows, cols = np.flatnonzero(left), np.flatnonzero(~left)
            sims = unit[rows] @ unit[cols].T
            sims[node[rows][:, None] == node[cols][None, :]] = -2
            for x, y, m in ((rows, cols, sims), (cols, rows, sims.T)):
                r, c = _top(np.ascontiguousarray(m), k, least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[x[r]]), pa.array(ids[y[c]]), pa.array(m[r, c].astype(np.float32))], names=_PAIR)

        for batch in batches:
            seam, left, dims, ids, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            change = np.flatnonzero(seam[1:] != seam[:-1]) + 1
            for s, e in zip([0, *change], [*change, len(ids)]):
                if e == s:
                    continue
                if open_ is not None and open_ != seam[s]:
                    yield from flush()
                    held = []
                open_ = seam[s]
                held.append((left[s:e].astype(bool), ids[s:e], node[s:e], _codes(batch.column(5).slice(s, e - s), int(dims[s]))))
        if open_ is not None:
            yield from flush()

    ordered = placed.repartitionByRange("dims", "curve", "place", "id").sortWithinPartitions("dims", "curve", "place", "id")
    out = materialise(ordered.mapInArrow(compare, _WINDOWS), "neighbour-windows")
    pairs, strips = out.filter("other is not null").select(*_PAIR), out.filter("other is null").select(*_STRIP)
    run = ["dims", "curve", "place", "first"]
    # one row for each curve of each task
    seams = _seams([tuple(r) for r in strips.filter("at = 0").select(*run, "rows").collect()])
    if not seams:
        return pairs
    plan = placed.sparkSession.createDataFrame(seams, "dims int, curve int, place long, first long, seam long, left boolean, low long, high long")
    if len(seams) <= MOST_BROADCAST:
        plan = F.broadcast(plan)
    met = strips.join(plan, run).filter("at >= low and at < high").select("seam", "left", "dims", "id", "node", "code")
    met = met.repartition("seam").sortWithinPartitions("seam")
    return pairs.unionByName(met.mapInArrow(over_borders, "id long, other long, cosine float"))


def _exact(unsure: DataFrame, vectors: DataFrame) -> DataFrame:
    """``id, other, cosine`` with the cosine in double precision from the vectors as they are stored."""
    ids = materialise(unsure.select("id").unionAll(unsure.select(F.col("other").alias("id"))).distinct(), "neighbour-ids")
    few = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    own = materialise(vectors.select("id", "embedding").join(few, "id", "left_semi"), "neighbour-vectors")
    both = unsure.select("id", "other").join(own.withColumnRenamed("embedding", "a"), "id")
    both = both.join(own.select(F.col("id").alias("other"), F.col("embedding").alias("b")), "other").select("id", "other", "a", "b")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = np.diff(batch.column(2).offsets.to_numpy())
            out = np.empty(batch.num_rows)
            for d in np.unique(width):
                at = np.flatnonzero(width == d)
                a, b = (batch.column(i).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(d)) for i in (2, 3))
                out[at] = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=_PAIR)

    return both.mapInArrow(cosine, "id long, other long, cosine double")


def nearest(vectors: DataFrame, k: int = 5, least: float = -1.0, curves: int | None = None) -> DataFrame:
    """Rows ``id, other, cosine, rank``: the k best others of each vector with a cosine of ``least`` or more.

    ``vectors`` has ``id long, node long, dims int, embedding array<float>`` with one row an id and
    ``dims`` values each; only vectors of the same dims are compared. The number of curves follows
    from the number of vectors of each dims unless it is given.
    """
    sizes = {r.dims: r.n for r in vectors.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # one row a number of dims
    pairs = window_pairs(place_on_curves(vectors, {d: curves or curves_for(n) for d, n in sizes.items()}), k, least - ERROR)
    best = pairs.repartition("id").groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    mine, c = Window.partitionBy("id"), F.col("cosine")
    ranked = best.withColumn("rank", F.row_number().over(mine.orderBy(F.desc("cosine"), "other"))).filter(F.col("rank") <= 2 * (k + SLACK))
    last, next_ = (F.max(F.when(F.col("rank") == r, c)).over(mine) for r in (k, k + 1))
    ranked = ranked.withColumns({"last": last, "next": next_}).filter(F.col("last").isNull() | (c >= F.col("last") - 2 * ERROR))
    sure = (c >= least + ERROR) & (F.col("rank") <= k) & (F.col("next").isNull() | (c > F.col("next") + 2 * ERROR))
    ranked = ranked.select("id", "other", c.cast("double").alias("cosine"), "rank", sure.alias("sure"))
    ranked = materialise(ranked.withColumn("taken", F.count(F.when(F.col("sure"), 1)).over(mine)), "neighbour-ranks")
    unsure = ranked.filter("not sure")
    exact = _exact(unsure, vectors).filter(F.col("cosine") >= least).join(unsure.select("id", "other", "taken"), ["id", "other"])
    rank = (F.row_number().over(mine.orderBy(F.desc("cosine"), "other")) + F.col("taken")).cast("int")
    exact = exact.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.filter("sure").select("id", "other", "cosine", "rank").unionByName(exact.select("id", "other", "cosine", "rank"))


def referenced_vectors(vectors: DataFrame, spills: DataFrame, meta: DataFrame) -> DataFrame:
    """The vectors with their spill file's dims that a metadata row refers to, with the node as an exact number.

    ``vector_index`` is the id; it counts through all spill files.
    """
    key = ["spill_path", "vector_index"]
    spills = spills.filter("path is not null and dims > 0").groupBy(F.col("path").alias("spill_path")).agg(F.max("dims").alias("dims"))
    sized = vectors.filter("vector_index is not null and embedding is not null").join(spills, "spill_path").filter("size(embedding) = dims")
    refs = meta.filter("vector_index is not null and spill_path is not null").groupBy(*key).agg(F.min(F.coalesce("node_id", F.lit(""))).alias("name"))
    refs = materialise(refs, "neighbour-refs")
    numbers = materialise(refs.select("name").distinct().withColumn("node", F.monotonically_increasing_id()), "neighbour-nodes")
    refs = materialise(refs.join(numbers, "name").select(*key, "node"), "neighbour-numbers")
    one = sized.join(refs, key).groupBy(*key, "node", "dims").agg(F.max("embedding").alias("embedding"))
    return one.select(F.col("vector_index").alias("id"), "node", F.col("dims").cast("int").alias("dims"), F.col("embedding").cast("array<float>"))
