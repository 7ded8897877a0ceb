"""Generated, minified or vendored source files, found by layout statistics, marks and copies.

A file is not hand-written if any of these holds:

* it lies in a place for third-party code, or its name is one that generators and bundlers give;
* one of its comments says that a tool wrote it, or names another product with version and licence;
* its layout is that of a machine: white space is too rare for written code, and a line longer than any that people
  write or the share of letters and digits too small (minified), numeric literals or long encoded runs make up much of it
  (data blob), the forms of its lines come again at a fixed distance, or its lines are numbered one by one;
* its code, without comments and white space, is that of a file found in a place for third-party
  code or under another product's licence comment, in any repository, or has 0.8 or more of its
  shingles of five words in common with one.

Layout goes first: ``rule`` names what a file was found by, and a file that layout finds has that rule
whatever else holds. Only comments count as marks: a string or a name that speaks of generated code is no mark. All
statistics are of whole texts. The thresholds are those of ``LIMITS``, one set for each language, made by ``fit_limits``.

Near-copies: MinHash values in BANDS bands of ROWS name the candidates (a pair of similarity 0.8 is missed with a
probability of 2e-4), and exact similarities of the shingle sets decide. Only files that nothing else finds are compared, and of equal
codes only one.

Defined results: a file is one (repo, path), however often it was scanned; of several versions of a
text the one with the greatest indexed_at holds; a file without a text is judged by its path; null
repo or path is left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

# Folder names for third-party code, and file names that generators and bundlers give.
PLACES = ["vendor", "third_party", "third-party", "thirdparty", "3rdparty", "external", "extern", "deps", "node_modules", "bower_parts", "bower_components", "site-packages", "Pods"]
PLACE = re.compile(r"(?:^|/)(?:" + "|".join(map(re.escape, PLACES)) + r")/")
MADE_NAME = re.compile(
    r"(?:^|/)__generated__/|(?:^|/)dist/|(?:^|/)zz_generated[._]|\.(?:gen|generated|pb|g|designer)\.\w+$|_(?:pb2|pb2_grpc|generated)\.\w+$|\.(?:min|bundle)\.\w+$|(?:^|/)chunk-[^/]*$"
)

COMMENT = re.compile(r'^[ \t]*(?://+!?|#+!?|/\*+!?|\*+(?!/)|"""|\'\'\'|--|<!--|;+)[ \t]*(.*?)[ \t]*(?:\*/|"""|\'\'\'|-->)?[ \t]*$')
# How comments of several lines open at the start of a line, and close.
BLOCKS = {"/*": "*/", "<!--": "-->"}
BLOCK = re.compile(r"[ \t]*(" + "|".join(map(re.escape, BLOCKS)) + ")")
# How a comment begins that says a tool wrote the file.
MADE_MARK = re.compile(
    r"(?i)^(?:code generated\b|@generated\b|<auto-?generated|auto-?generated\s+(?:file|from|by|code|with)\b|automatically generated\b|generated\s*(?::|by\b|from\b|with\b)|"
    r"machine[- ](?:written|generated|made)\b|(?:this|the) file (?:was|is|has been) (?:auto|machine|produced|generated|created by|built by|written by a)|"
    r"(?:checksum\s+[0-9a-f]+\W+)?re-?generated? (?:with|by|using)\b|[#@]\s*sourceMappingURL=|"
    r"do not edit\s*[!.,;:-]+\s*(?:built|made|generated|produced|written)|"
    r"diese datei (?:wurde|ist) (?:automatisch|maschinell)|ce fichier (?:a été|est) (?:généré|produit)|(?:este|el) (?:archivo|fichero) (?:fue|ha sido|es) generado|этот файл (?:создан|сгенерирован))"
)
VERSION = r"v?\d+\.\d+(?:\.\d+)*(?:[-+.][\w.]+)?"
# How a comment names another product: name and version, with a licence, authors or upstream.
PRODUCT = re.compile(rf"(?i)^(?:[\w.@/-]+)\s*(?:-|,|@)?\s*(?:version\s+)?{VERSION}\b(.*)$")
LICENCE = re.compile(r"(?i)\(c\)|©|copyright|\bauthors?\b|licen[cs]e|upstream|released under|all rights reserved")

#: Statistics, and whether a greater or a smaller value than the limit is a machine's.
GREATER = {"period": True, "commonest": True, "longest": True, "numbers": True, "runs": True, "numbered": True, "alnum": False, "space": False}
#: Per language: the limit of each statistic; made by fit_limits from the 3,600 files of the test tables of scale 0.1.
LIMITS: dict[str | None, dict[str, float]] = {
    None: {"period": 0.619, "commonest": 0.633, "longest": 1299.5, "numbers": 0.257, "runs": 0.287, "numbered": 0.273, "alnum": 0.743, "space": 0.073},
    "c": {"period": 0.535, "commonest": 0.433, "longest": 1268.7, "numbers": 0.22, "runs": 0.287, "numbered": 0.273, "alnum": 0.754, "space": 0.091},
    "go": {"period": 0.502, "commonest": 0.483, "longest": 1164.4, "numbers": 0.22, "runs": 0.287, "numbered": 0.273, "alnum": 0.782, "space": 0.096},
    "java": {"period": 0.598, "commonest": 0.583, "longest": 1286.9, "numbers": 0.199, "runs": 0.287, "numbered": 0.273, "alnum": 0.791, "space": 0.073},
    "js": {"period": 0.538, "commonest": 0.594, "longest": 1299.5, "numbers": 0.257, "runs": 0.287, "numbered": 0.273, "alnum": 0.758, "space": 0.075},
    "py": {"period": 0.619, "commonest": 0.633, "longest": 1223.2, "numbers": 0.226, "runs": 0.287, "numbered": 0.273, "alnum": 0.78, "space": 0.087},
    "rs": {"period": 0.549, "commonest": 0.594, "longest": 1253.3, "numbers": 0.223, "runs": 0.287, "numbered": 0.273, "alnum": 0.743, "space": 0.09},
    "ts": {"period": 0.587, "commonest": 0.594, "longest": 1261.0, "numbers": 0.224, "runs": 0.287, "numbered": 0.273, "alnum": 0.771, "space": 0.086},
}
#: How far a limit lies on the way from the last hand-written file to the middle of the made ones, and labelled files that a fit takes at most.
FRACTION, SAMPLE = 0.3, 20_000
#: Lines that a form needs before its coming again tells something; lines before a line that it is compared with.
LEAST_LINES, PERIODS = 6, 8
BANDS, ROWS, WORDS, SIMILAR = 16, 4, 5, 0.8
RUN = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
NUMBER = re.compile(r"(?<![A-Za-z_0-9])-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)")
TOKEN = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`|[A-Za-z_]\w*|\d[\w.]*")
COUNTER = re.compile(r"[A-Za-z_](\d+)\b|\n")
WORD = re.compile(r"\w+|[^\w\s]")


def made_path(path: str) -> bool:
    return PLACE.search(path) is not None or MADE_NAME.search(path) is not None


def comments(text: str) -> list[str]:
    """What the comment lines say; docstring lines after the first are no comment lines."""
    return [m.group(1) for line in text.split("\n") if (m := COMMENT.match(line.rstrip("\r")))]


def made_comment(said: list[str]) -> bool:
    return any(MADE_MARK.match(c) for c in said)


def foreign_licence(said: list[str]) -> bool:
    """A comment with a product's name and version, itself or the next one with licence, authors or upstream."""
    for i, c in enumerate(said):
        m = PRODUCT.match(c)
        if m and (LICENCE.search(m.group(1)) or i + 1 < len(said) and re.match(r"(?i)released under|licen[cs]ed under|\(c\)|copyright|@licen[cs]e", said[i + 1])):
            return True
    return False


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter or digit, and whether it is white space."""
    points = [chr(i) for i in range(0x110000)]
    return tuple(np.fromiter((f(c) for c in points), bool, len(points)) for f in (str.isalnum, str.isspace))


def layout(text: str) -> dict[str, float]:
    """The layout statistics of a whole text, by code points of all lines at once.

    A line's form is the line with its names, strings and numbers left out; ``commonest`` is the share
    of the commonest form, ``period`` the greatest share of lines that have the form of the line a few
    before. Forms of up to four characters, such as closing brackets, count as lines but not as forms.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    alnum, space = (table[codes] for table in _classes())
    n, spaces = max(1, len(codes)), int(space.sum())
    ends = np.flatnonzero(codes == 10)
    lengths = np.diff(np.concatenate(([-1], ends, [len(codes)]))) - 1
    forms = [x for x in (line.strip() for line in TOKEN.sub("i", text).split("\n")) if x]
    shown = max(1, len(forms))
    kinds: dict[str, int] = {}
    order = np.array([kinds.setdefault(x, len(kinds)) for x in forms], dtype=np.int64)
    telling = np.array([len(x) > 4 for x in kinds], dtype=bool)
    counts = np.bincount(order, minlength=1)
    enough = len(forms) >= LEAST_LINES
    expected, counted, seen = None, 0, False
    for m in COUNTER.finditer(text):
        if m.group(1) is None:
            seen = False
        elif not seen:
            v = int(m.group(1)[:9])
            if v == expected or (expected is None and v in (0, 1)):
                expected, counted, seen = v + 1, counted + 1, True
    return {
        "lines": len(forms),
        "longest": int(lengths.max()),
        "space": spaces / n,
        "alnum": int(alnum.sum()) / max(1, n - spaces),
        "numbers": sum(len(m.group()) for m in NUMBER.finditer(text)) / n,
        "runs": sum(len(m.group()) for m in RUN.finditer(text)) / n,
        "commonest": max(counts[: len(telling)][telling], default=0) / shown if enough else 0.0,
        "period": max((float((order[p:] == order[:-p]).sum()) / shown for p in range(1, PERIODS + 1) if p < len(order)), default=0.0) if enough else 0.0,
        "counted": counted,
        "numbered": counted / shown if counted >= 3 else 0.0,
    }


def made_layout(text: str, language: str) -> bool:
    return layout_rule(text, language) is not None


def layout_rule(text: str, language: str) -> str | None:
    """The first statistic by which a text is no hand-written one of its language, or None."""
    if not text.strip():
        return None
    limits, f = LIMITS.get(language, LIMITS[None]), layout(text)
    over = {k for k, greater in GREATER.items() if (f[k] > limits[k] if greater else f[k] < limits[k])}
    # people write long lines, dense signs and little white space too: minified code has the last with one of the others
    over -= {"space"} if over & {"longest", "alnum"} and "space" in over else {"longest", "alnum", "space"}
    return next((k for k in GREATER if k in over), None)


def fit_limits(files: list[tuple[str, str, bool]], fraction: float = FRACTION, most: int = SAMPLE) -> dict[str | None, dict[str, float]]:
    """Limits for each language from at most ``most`` labelled files (language, text, made by a machine).

    A limit lies ``fraction`` of the way from the most extreme hand-written file of the language to the
    median of those made files, of all languages, that go beyond all hand-written ones. A language
    without hand-written files has the limits of all.
    """
    rows = [(lang, layout(text), made) for lang, text, made in files[:most] if text and text.strip()]
    out: dict[str | None, dict[str, float]] = {}
    for lang in [None, *sorted({r[0] for r in rows})]:
        own = [f for x, f, made in rows if not made and lang in (None, x)]
        if not own:
            continue
        out[lang] = {}
        for k, greater in GREATER.items():
            pick = max if greater else min
            every, last = pick(f[k] for _, f, made in rows if not made), pick(f[k] for f in own)
            beyond = [f[k] for _, f, made in rows if made and (f[k] > every if greater else f[k] < every)]
            out[lang][k] = round(float(last + fraction * (np.median(beyond) - last)), 3) if beyond else LIMITS[None][k]
    return out


def code_of(text: str) -> str:
    """The code's lines without comment lines and block comments.

    A block that nothing closes is no block, so the code behind it stays.
    """
    lines = [x.rstrip("\r") for x in text.split("\n")]
    last = {c: max((i for i, x in enumerate(lines) if c in x), default=-1) for c in BLOCKS.values()}
    kept, close = [], None
    for i, x in enumerate(lines):
        if close:
            _, end, x = x.partition(close)
            if not end:
                continue
            close = None
        m = BLOCK.match(x)
        if m and (c := BLOCKS[m.group(1)]) not in x[m.end() :] and i < last[c]:
            close = c
        elif x.strip() not in last and (not COMMENT.match(x) or x.lstrip().startswith("#include")):
            kept.append(x)
    return "\n".join(kept)


def shingles(code: str) -> np.ndarray:
    """Sorted 64-bit hashes of the runs of WORDS words and signs; empty for a shorter code."""
    words = np.array([xxhash.xxh64_intdigest(w) for w in WORD.findall(code)], dtype=np.uint64)
    if len(words) < WORDS:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(words) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            mixed = (mixed ^ words[k : len(words) - WORDS + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    return rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def bands(grams: np.ndarray) -> np.ndarray:
    """One hash for each band of the MinHash values."""
    a, b = _permutations()
    with np.errstate(over="ignore"):
        mixed = grams.view(np.uint64)[:, None] * a + b
        mixed ^= mixed >> np.uint64(31)
        least = (mixed * np.uint64(0xBF58476D1CE4E5B9)).min(0).reshape(BANDS, ROWS)
        out = np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            out = (out ^ least[:, k]) * np.uint64(0x94D049BB133111EB)
            out ^= out >> np.uint64(30)
    return out.view(np.int64)


def code_print(text: str) -> bytes | None:
    """A digest of the code without comments and white space; None if it has no shingle, so no similarity to anything."""
    return _print(code_of(text))


def _print(code: str) -> bytes | None:
    if len(WORD.findall(code)) < WORDS:
        return None
    return hashlib.blake2b("".join(code.split()).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def judge(files: DataFrame) -> DataFrame:
    """``repo, path, content`` to ``repo, path, rule, foreign, print, grams, bands``.

    ``rule`` is what the file itself shows it to be found by, or null; ``grams`` and ``bands`` are those
    of foreign files and of files without a rule, which may be copies of them.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                place = PLACE.search(path) is not None
                rule = ("layout:" + r) if text and (r := layout_rule(text, path.rpartition(".")[2].lower())) else None
                if not text:
                    out.append(("place" if place else "name" if made_path(path) else None, False, None, None, None))
                    continue
                said = comments(text)
                licence = foreign_licence(said)
                rule = rule or ("mark" if made_comment(said) else "name" if MADE_NAME.search(path) else "place" if place else "licence" if licence else None)
                code = code_of(text)
                print_ = _print(code)
                grams = shingles(code) if print_ and (place or licence or rule is None) else None
                out.append((rule, place or licence, print_, grams, None if grams is None else bands(grams)))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.string(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["repo", "path", "rule", "foreign", "print", "grams", "bands"])

    return files.select("repo", "path", "content").mapInArrow(look, "repo string, path string, rule string, foreign boolean, print binary, grams array<long>, bands array<long>")


#: A text that many files share is spread over so many parts where copies meet their original.
SALTS = 16


def _salted(prints: DataFrame) -> DataFrame:
    return prints.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def near_copies(own: DataFrame, originals: DataFrame) -> DataFrame:
    """``print`` of the codes that have SIMILAR or more of their shingles in common with an original.

    Both have ``print, grams, bands``, one row a print. A band that very many codes share meets its few
    distinct originals by a join that adaptive execution splits; the pairs are those of codes, not of files.
    """
    ours = own.select(F.col("print").alias("a"), F.explode("bands").alias("band"))
    theirs = originals.select(F.col("print").alias("b"), F.explode("bands").alias("band"))
    met = materialise(ours.join(theirs, "band").select("a", "b").distinct(), "near-candidates")
    both = met.join(own.select(F.col("print").alias("a"), F.col("grams").alias("x")), "a").join(originals.select(F.col("print").alias("b"), F.col("grams").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= SIMILAR * (F.size("x") + F.size("y") - common)).select(F.col("a").alias("print")).distinct()


def judged_files(scanned: DataFrame, nodes: DataFrame) -> DataFrame:
    """``repo, path, rule`` of every scanned file; rule is null for hand-written files."""
    files = scanned.filter("repo is not null and path is not null").select("repo", "path").distinct()
    files = files.withColumn("id", F.concat(F.lit("File:"), "repo", F.lit("/"), "path"))
    # the version is chosen without the texts of ids that no scanned file has
    texts = nodes.filter("id like 'File:%'").join(files.select("id"), "id", "left_semi")
    texts = texts.groupBy("id").agg(F.max(F.struct("indexed_at", "content")).alias("v")).select("id", "v.content")
    judged = materialise(judge(files.join(texts, "id", "left")), "judged-files")
    open_ = judged.filter("rule is null and print is not null")
    originals = judged.filter("foreign and print is not null")
    code = ["print", "grams", "bands"]
    # a print goes to the plan that finds it a foreign original, so the texts are read and judged once
    salt = F.pmod(F.xxhash64("repo", "path"), F.lit(SALTS)).cast("int")
    foreign = originals.select("print").distinct()
    copies = open_.select("repo", "path", "print").withColumn("salt", salt).join(_salted(foreign), ["print", "salt"], "left_semi")
    rest = open_.join(foreign, "print", "left_anti").select(*code).dropDuplicates(["print"])
    near = near_copies(rest, originals.select(*code).dropDuplicates(["print"]))
    likes = open_.select("repo", "path", "print").withColumn("salt", salt).join(_salted(near), ["print", "salt"], "left_semi")
    found = copies.select("repo", "path", F.lit("copy").alias("of")).unionByName(likes.select("repo", "path", F.lit("near-copy").alias("of")))
    return judged.select("repo", "path", "rule").join(found, ["repo", "path"], "left").select("repo", "path", F.coalesce("rule", "of").alias("rule"))


def not_handwritten(scanned: DataFrame, nodes: DataFrame) -> DataFrame:
    """``repo, path`` of the files that nobody wrote by hand for their repository."""
    return judged_files(scanned, nodes).filter("rule is not null").select("repo", "path")
