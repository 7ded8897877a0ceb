"""Splitting oversized texts at natural boundaries with overlap.

A text is seen as tokens (runs of white space and runs of anything else); the prefix sums of their
lengths are the sorted array of offsets at which it may be cut, and the line ends are a second such
array. A piece ends at the last line end within the limit, or, where that adds less than a quarter of
the limit to the pieces before, at the last token border if it lies further; else it
is cut hard at the limit, before a letter and its combining marks rather than within them. The next piece starts at the first line start that lies at most
``overlap`` characters back, else at the first token border there, else exactly that far back.
All places are found by binary search.

Defined results: lengths are code points; a null text has no piece, an empty text or one within
the limit has one piece that is the whole text; a line break is CR LF, LF or a lone CR; CR and LF
of one break are never parted. ``start_line`` and ``end_line`` are the lines of a piece's first and
last character, counted from the text's own first line (null counts as 0).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = np.zeros(0x3001, dtype=bool)
_SPACE[[i for i in range(0x3001) if chr(i).isspace()]] = True
CR, LF = 13, 10
_MARK = np.fromiter((unicodedata.category(chr(i))[0] == "M" for i in range(0x20000)), bool, 0x20000)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets after line breaks, and offsets at which a token begins, both sorted."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(codes)
    breaks = codes == LF
    lone = codes == CR
    lone[:-1] &= codes[1:] != LF
    lines = np.flatnonzero(breaks | lone) + 1
    space = _SPACE[np.minimum(codes, 0x3000)] & (codes <= 0x3000)
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    lengths = np.diff(np.concatenate(([0], change, [n])))
    offsets = np.cumsum(lengths)[:-1]
    return lines, offsets[~space[offsets]] if len(offsets) else offsets


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece; together they cover the text, none is longer than the limit."""
    return _pieces(text, limit, overlap, *boundaries(text)) if len(text) > limit else [(0, len(text))]


def _last(places: np.ndarray, top: int) -> int:
    k = int(np.searchsorted(places, top, side="right")) - 1
    return int(places[k]) if k >= 0 else -1


def _hard(text: str, top: int, before: int) -> int:
    """The limit itself, or a little before it where it would part a letter from its marks or CR from LF."""
    end = top
    while end - 1 > before and ord(text[end]) < len(_MARK) and _MARK[ord(text[end])]:
        end -= 1
    if ord(text[end]) < len(_MARK) and _MARK[ord(text[end])]:
        end = top  # nothing but marks
    if text[end - 1] == "\r" and text[end] == "\n" and end - 1 > before:
        end -= 1
    return end


def _pieces(text: str, limit: int, overlap: int, lines: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    n, start, end = len(text), 0, 0
    out: list[tuple[int, int]] = []
    while n - start > limit:
        top, before = start + limit, end
        line, word = _last(lines, top), _last(words, top)
        end = line if line - before >= limit // 4 else max(line, word)
        if end <= before:
            end = _hard(text, top, before)
        out.append((start, end))
        low = max(end - overlap, start + 1)
        for places in (lines, words):
            k = np.searchsorted(places, low, side="left")
            if k < len(places) and places[k] < end:
                start = int(places[k])
                break
        else:
            start = low
            if start < end and text[start - 1] == "\r" and text[start] == "\n":
                start += 1
    return [*out, (start, n)]


def split_text(df: DataFrame, key: str, text: str, first_line: str | None = None, limit: int = 1200, overlap: int = 120, offsets: bool = False) -> DataFrame:
    """Rows ``key, chunk_index, start_line, end_line, text`` of all non-null texts, with ``start_offset, end_offset`` if asked for."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    line = F.coalesce(F.col(first_line).cast("long"), F.lit(0)) if first_line else F.lit(0).cast("long")
    df = df.select(F.col(key).alias("k"), F.col(text).alias("t"), line.alias("l")).filter("t is not null")
    out = T.StructType([T.StructField(key, df.schema["k"].dataType), T.StructField("chunk_index", T.IntegerType()), T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start_offset", T.LongType()), T.StructField("end_offset", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, index, first, last, texts, spans_out, size = [], [], [], [], [], [], 0
            keys = batch.column(0)
            for i, (t, l0) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                t = t.as_py()
                breaks, words = boundaries(t) if t else (np.zeros(0, dtype=int), np.zeros(0, dtype=int))
                spans = _pieces(t, limit, overlap, breaks, words)
                for k, (a, b) in enumerate(spans):
                    row.append(i)
                    index.append(k)
                    first.append(l0 + int(np.searchsorted(breaks, a, side="right")))
                    last.append(l0 + int(np.searchsorted(breaks, max(a, b - 1), side="right")))
                    texts.append(t[a:b])
                    spans_out.append((a, b))
                    size += b - a
                    if size > 8_000_000:  # long texts make many pieces: hand them on in parts
                        yield _batch(keys, row, index, first, last, texts, spans_out, key)
                        row, index, first, last, texts, spans_out, size = [], [], [], [], [], [], 0
            if row:
                yield _batch(keys, row, index, first, last, texts, spans_out, key)

    cut_ = df.mapInArrow(cut, out)
    return cut_ if offsets else cut_.drop("start_offset", "end_offset")


def _batch(keys: pa.Array, row: list, index: list, first: list, last: list, texts: list, spans: list, key: str) -> pa.RecordBatch:
    starts, ends = zip(*spans)
    columns = [pa.array(index, pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(texts, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), *columns], names=[key, "chunk_index", "start_line", "end_line", "text", "start_offset", "end_offset"])


def current_long_texts(nodes: DataFrame, limit: int) -> DataFrame:
    """The nodes whose current version (greatest indexed_at, then the longer and greater text) is over the limit.

    Texts within the limit are not shuffled: only their length takes part in finding the current version.
    """
    size = F.length("content")
    version = F.struct("indexed_at", size.alias("size"), F.when(size > limit, F.col("content")).alias("content"), "start_line")
    newest = nodes.filter("id is not null").groupBy("id").agg(F.max(version).alias("v"))
    return newest.filter(F.col("v.size") > limit).select("id", "v.content", "v.start_line")
