"""Text codecs of the ``reason`` column: taint paths, reaching definitions and call summaries; and a digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Format versions, the mark of a cut path, the byte limit, and what a name and a kind may hold.
VERSION, CUT, MAX_BYTES = "1", "~", 4096
NAME, KIND = r"^[A-Za-z_$][\w$.\[\]-]*$", r"^[a-z][a-z0-9-]*$"
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193

HOPS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("via_call", T.BooleanType())]))


def encode_path(hops: Column, kind: Column | None = None, cut: Column | None = None, max_bytes: int = MAX_BYTES) -> Column:
    """``1[;kind]|name:line[:c]...[|~]``: hops up to the first that can't be written or doesn't fit."""
    head = F.lit(VERSION) if kind is None else F.concat(F.lit(VERSION), F.when(kind.rlike(KIND), F.concat(F.lit(";"), kind)).otherwise(""))
    good = lambda h: F.coalesce(h["name"].rlike(NAME) & (h["line"] >= 0), F.lit(False))
    text = lambda h: F.concat(F.lit("|"), h["name"], F.lit(":"), h["line"].cast("string"), F.when(F.coalesce(h["via_call"], F.lit(False)), ":c").otherwise(""))
    start = F.struct(head.alias("s"), F.lit(False).alias("cut"))

    def add(acc: Column, h: Column) -> Column:
        t = F.when(good(h), text(h))
        fits = t.isNotNull() & (F.length(acc["s"]) + F.length(t) <= max_bytes) & ~acc["cut"]
        return F.struct(F.when(fits, F.concat(acc["s"], t)).otherwise(acc["s"]).alias("s"), (acc["cut"] | ~F.coalesce(fits, F.lit(False))).alias("cut"))

    done = F.aggregate(hops, start, add)
    ended = done["cut"] if cut is None else (done["cut"] | cut)
    # room for the mark: hops are dropped from the end while it doesn't fit
    room = F.when(F.length(done["s"]) + 2 <= max_bytes, done["s"]).otherwise(F.regexp_replace(done["s"], r"\|[^|]*$", ""))
    return F.when(ended, F.concat(room, F.lit("|" + CUT))).otherwise(done["s"])


def decode_path(reason: Column) -> Column:
    """``struct(kind, hops, cut)`` of a well-formed path, else null."""
    ok = reason.rlike(r"^1(;[a-z][a-z0-9-]*)?(\|[A-Za-z_$][\w$.\[\]-]*:\d+(:c?)?)*(\|~)?$")
    kind = F.regexp_extract(reason, r"^1;([a-z][a-z0-9-]*)", 1)
    parts = F.filter(F.slice(F.split(reason, r"\|"), F.lit(2), F.size(F.split(reason, r"\|"))), lambda x: x != CUT)
    fields = lambda x: F.split(x, ":")
    hops = F.transform(parts, lambda x: F.struct(F.get(fields(x), 0).alias("name"), F.get(fields(x), 1).cast("int").alias("line"), (F.coalesce(F.get(fields(x), 2), F.lit("")) == "c").alias("via_call")))
    return F.when(ok, F.struct(F.when(kind != "", kind).alias("kind"), hops.alias("hops"), reason.endswith("|" + CUT).alias("cut")))


def encode_reaching(name: Column, pairs: Column) -> Column:
    """``name|1:def:use;...``; pairs with a negative or missing line are dropped, without pairs the bare name."""
    good = F.filter(pairs, lambda p: F.coalesce((p["def_line"] >= 0) & (p["use_line"] >= 0), F.lit(False)))
    body = F.array_join(F.transform(good, lambda p: F.concat(p["def_line"].cast("string"), F.lit(":"), p["use_line"].cast("string"))), ";")
    return F.when(F.size(good) > 0, F.concat(name, F.lit("|1:"), body)).otherwise(name)


def decode_reaching(reason: Column) -> Column:
    """``struct(name, pairs)``; malformed pairs are dropped, another version has no pairs."""
    name = F.substring_index(F.coalesce(reason, F.lit("")), "|", 1)
    body = F.regexp_extract(reason, r"^[^|]*\|1:(.*)$", 1)
    chunks = F.filter(F.split(body, ";"), lambda c: c.rlike(r"^\d+:\d+$"))
    pairs = F.transform(chunks, lambda c: F.struct(F.get(F.split(c, ":"), 0).cast("int").alias("def_line"), F.get(F.split(c, ":"), 1).cast("int").alias("use_line")))
    return F.struct(name.alias("name"), F.when(body != "", pairs).otherwise(F.array().cast(T.ArrayType(T.StructType([T.StructField("def_line", T.IntegerType()), T.StructField("use_line", T.IntegerType())])))).alias("pairs"))


def encode_summary(params: Column) -> Column:
    """``1|r:<hex>``: the bits of the parameters (0 to 62) that flow to the return value."""
    bits = F.aggregate(F.array_distinct(params), F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p)))
    return F.concat(F.lit("1|r:"), F.lower(F.hex(bits)))


def decode_summary(reason: Column) -> Column:
    """The parameters of a well-formed summary in order, else null; unknown segments are ignored."""
    ok = reason.rlike(r"^1(\|[^|:]+:[^|]*)*\|r:[0-9a-f]+(\|[^|:]+:[^|]*)*$")
    bits = F.conv(F.regexp_extract(reason, r"\|r:([0-9a-f]+)", 1), 16, 10).cast("long")
    places = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit(bits, i) == 1)
    return F.when(ok, places)


def fnv1a(facts: Column) -> Column:
    """32-bit FNV-1a of the sorted facts, one a line, over UTF-8 bytes, as eight hex digits."""
    text = F.array_join(F.array_sort(facts), "\n")
    codes = F.transform(F.filter(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda x: x != ""), lambda h: F.conv(h, 16, 10).cast("long"))
    step = lambda acc, b: F.pmod(acc.bitwiseXOR(b) * FNV_PRIME, F.lit(1 << 32))
    return F.lpad(F.lower(F.hex(F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), step))), 8, "0")
