"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_line(text: Column) -> Column:
    """CR, LF and TAB become spaces, as the full-text index wants it."""
    return F.regexp_replace(text, r"[\r\n\t]", " ")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def longest_identifier(pattern: Column, least: int = 3) -> Column:
    """The longest identifier of a pattern, of equally long ones the first; null if none has ``least`` letters."""
    found = F.regexp_extract_all(pattern, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    best = F.aggregate(found, F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))
    return F.when(F.length(best) >= least, best)


# Fixed value: the block of CJK unified ideographs.
CJK = "\u4e00-\u9fff"


def cjk_bigrams(text: Column) -> Column:
    """Runs of two or more CJK ideographs become overlapping pairs, parted by a space from what isn't white space beside them.

    A letter inside a run ends one pair and begins the next, so it is written twice with a space between.
    """
    other, run = f"[^{CJK}\\s\\p{{Z}}\uFEFF]", f"[{CJK}]{{2}}"
    parted = F.regexp_replace(text, f"(?<={other})(?={run})|(?<={run})(?={other})", " ")
    return F.regexp_replace(parted, f"(?<=[{CJK}])([{CJK}])(?=[{CJK}])", "$1 $1")


def char_chunks(df: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 120) -> DataFrame:
    """``key, chunk_index, start_offset, end_offset, text``: pieces of ``size`` characters, each ``overlap`` back from the last.

    The piece that reaches the end of the text is the last one; a text within the size is one piece.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    n, step = F.length("_t"), size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step))
    rows = df.select(F.col(key), F.col(text).alias("_t")).filter("_t is not null")
    rows = rows.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    start = F.col("chunk_index") * step
    end = F.least(start + size, n)
    return rows.select(key, "chunk_index", start.alias("start_offset"), end.alias("end_offset"), F.substring("_t", start + 1, end - start).alias("text"))


def line_of(text: Column, offset: Column) -> Column:
    """0-based line of a character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n")) - 1


def display_line(line: Column) -> Column:
    """Stored lines count from 0, shown ones from 1."""
    return line + 1


def grep(df: DataFrame, key: str, text: str, pattern: str, *, literal: bool = False, ignore_case: bool = False, limit: int = 50, trim: int = 200) -> DataFrame:
    """``key, line, text``: the first matching lines in key and line order, each trimmed.

    The pattern has at most 200 characters, the limit is brought into 1 to 200.
    """
    if not pattern or len(pattern) > 200:
        raise ValueError("the pattern must have 1 to 200 characters")
    expr = (r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E") if literal else pattern
    expr = ("(?i)" + expr) if ignore_case else expr
    lines = df.select(F.col(key), F.posexplode(F.split(F.col(text), "\r?\n")).alias("k", "t")).filter(F.col("t").rlike(expr))
    return lines.select(key, (F.col("k") + 1).alias("line"), F.substring("t", 1, trim).alias("text")).orderBy(key, "line").limit(min(max(limit, 1), 200))


def utf8_cut(text: Column, budget: int) -> Column:
    """The longest prefix of a text of at most ``budget`` UTF-8 bytes that ends at a character border."""
    codes = F.encode(text, "UTF-8")
    inside = lambda i: F.hex(F.substring(codes, i, 1)).between("80", "BF")  # noqa: E731  a byte that doesn't begin a character
    cut = F.lit(max(budget - 3, 0))
    for back in (2, 1, 0):
        cut = F.when(~inside(budget - back + 1), F.lit(budget - back)).otherwise(cut)
    return F.when(F.octet_length(text) <= budget, text).otherwise(F.substring(codes, F.lit(1), cut).cast("string"))


def half_up(x: Column, digits: int) -> Column:
    """Rounding of numbers that are not negative, halves up."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def branch_slug(name: Column) -> Column:
    """A branch name as a file name: separators and odd characters become single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9._-]+", "-"), r"^-+|-+$", "")
