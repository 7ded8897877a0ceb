"""One consistent form for texts that look the same but differ in their characters.

Invisible characters are deleted, characters that stand for the same letters (full and half width,
ligatures, font and presentation forms) are replaced by them, every single space becomes the plain
one, and accents are composed. What is left are letters of other scripts with the same shape. Each
word becomes a lattice: every letter that has look-alikes may be any of them. Viterbi finds the path
of the word that letter pairs of the whole collection, counted in words of one script only, make
most likely; a change of script within a word is penalised. The lattice depends on the shapes alone,
so words that look the same always come out the same, whatever letters they were written with.

Not the same, and kept apart: another case, a missing accent, another digit, letter or punctuation
mark, superscripts, fractions and circled characters, tabs and line breaks, the number of spaces,
and joined emoji.

Defined results: null stays null, an empty text stays empty; texts of any length are taken whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialise

# Letters of the same shape, Latin first, then Greek, Cyrillic, Armenian, Cherokee and phonetic letters.
SAME_SHAPE = [
    "AΑАᎪ", "BΒВᏴ", "CϹСᏟ", "DᎠ", "EΕЕᎬ", "GԌᏀ", "HΗНᎻ", "IΙІӀ", "JͿЈᎫ", "KΚКᏦ", "LԼᏞ", "MΜМᎷ", "NΝ", "OΟОՕ", "PΡРᏢ", "QԚ", "RᎡ", "SЅՏᏚ", "TΤТᎢ", "UՍ", "VѴᏙ", "WԜᎳ", "XΧХ", "YΥУҮ", "ZΖᏃ",
    "aа", "cϲс", "dԁ", "eе", "gɡց", "hһհ", "iі", "jϳј", "lӏ", "nո", "oοоօ", "pρр", "qԛզ", "sѕ", "uս", "vνѵ", "wԝ", "xх", "yу",
    "ΓГ", "ΠП", "ΦФ",
]
# Invisible characters that are no format characters (Cf), as ranges.
INVISIBLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]
# Format characters that are seen.
SEEN_FORMATS = [(0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD)]
#: Kinds of compatibility characters that look like what they stand for, wherever they occur.
ALIKE_KINDS = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
ZWJ = "‍"
SWITCH = -12.0

SHAPE = {c: group[0] for group in SAME_SHAPE for c in group}
GROUP = {group[0]: group for group in SAME_SHAPE}
# Fixed value: phonetic letters that are written for a Latin one and never meant in a word.
PHONETIC = "ɡ"


def script(c: str) -> str:
    """Latin, Greek, Cyrillic, Armenian, Cherokee or none, by the block of a base letter."""
    o = ord(c)
    if o < 0x2B0:
        return "L" if c.isalpha() else ""
    if 0x370 <= o < 0x400:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    return "A" if o < 0x590 and o >= 0x530 else "K" if 0x13A0 <= o < 0x1400 else ""


@lru_cache(maxsize=65536)
def _folded(c: str) -> str:
    """What one character stands for: itself, the same letters in plain form, a plain space, or nothing."""
    o, kind = ord(c), unicodedata.category(c)
    if c in SHAPE:  # it looks like its shape, whatever it is a variant of
        return c
    if kind == "Zs":
        return " "
    if kind == "Cf":
        return c if any(a <= o <= b for a, b in SEEN_FORMATS) else ""
    if any(a <= o <= b for a, b in INVISIBLE):
        return ""
    parts = unicodedata.decomposition(c).split()
    if parts and parts[0].startswith("<"):
        plain = [chr(int(p, 16)) for p in parts[1:]]
        letters = parts[0] == "<compat>" and (kind[0] == "L" or kind == "Nl") and all(unicodedata.category(p)[0] in "LM" for p in plain)
        if parts[0] in ALIKE_KINDS or letters:
            return "".join(map(_folded, plain))
    return c


class _Table(dict):
    """What each code point stands for, filled as characters occur."""

    def __missing__(self, code: int) -> str:
        self[code] = _folded(chr(code))
        return self[code]


_TABLE, _KEEPING = _Table(), _Table({ord(ZWJ): ZWJ})
_SHAPES = str.maketrans(SHAPE)


def _joins_emoji(text: str, i: int) -> bool:
    return 0 < i < len(text) - 1 and all(unicodedata.category(text[k]) in ("So", "Sk") or 0xFE00 <= ord(text[k]) <= 0xFE0F for k in (i - 1, i + 1))


def folded(text: str) -> str:
    """Without invisible characters and variants; decomposed."""
    if text.isascii():
        return text
    table = _TABLE
    if ZWJ in text:
        text = "".join(c if c != ZWJ or _joins_emoji(text, i) else "" for i, c in enumerate(text))
        table = _KEEPING
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


_PARTS = re.compile(r"([^\W\d_](?:[^\W\d_]|[̀-ͯ])*)")


class Reader:
    """Finds the most likely letters of look-alike lattices; a pair's score is the logarithm of its share of all pairs."""

    def __init__(self, pairs: dict[tuple[str, str], int]):
        self.pairs = pairs
        self.total = sum(pairs.values()) + 1.0
        self.known: dict[str, str] = {}
        self.seen: dict[str, str] = {}
        self.scores: dict[tuple[str, str], float] = {}
        # a letter of a rarer script can be meant only if the collection has words of that script
        used = {script(c) for pair in pairs for c in pair if len(c) == 1} | set("LGC")
        self.group = {k: "".join(c for c in g if c == k or (script(c) in used and c not in PHONETIC)) for k, g in GROUP.items()}

    def score(self, a: str, b: str) -> float:
        s = self.scores.get((a, b))
        if s is None:
            s = math.log((self.pairs.get((a, b), 0) + 0.05) / self.total)
            sa, sb = script(a) if a != "^" else "", script(b) if b != "$" else ""
            s += SWITCH if sa and sb and sa != sb else 0.0
            if len(self.scores) < 500_000:
                self.scores[a, b] = s
        return s

    def word(self, shapes: str) -> str:
        """The best path through the lattice of a word, given as first letters of its shape groups, accents left out."""
        best = {"^": (0.0, None)}
        trail = []
        for c in shapes:
            now = {}
            for letter in self.group.get(c, c):
                now[letter] = max(((s + self.score(a, letter), a) for a, (s, _) in best.items()), key=lambda x: x[0])
            trail.append(now)
            best = now
        last = max(best, key=lambda a: best[a][0] + self.score(a, "$"))
        out = []
        for now in reversed(trail):
            out.append(last)
            last = now[last][1]
        return "".join(reversed(out))

    def consistent(self, word: str) -> str:
        """A decomposed word with accents in its consistent letters."""
        done = self.seen.get(word)
        if done is not None:
            return done
        shaped = word.translate(_SHAPES)
        done = self.known.get(shaped)
        if done is None:
            bare = shaped if shaped.isalpha() else "".join(c for c in shaped if not unicodedata.combining(c))
            letters = self.word(bare) if any(c in GROUP for c in bare) else bare
            if bare is not shaped:
                rest = iter(letters)
                letters = "".join(c if unicodedata.combining(c) else next(rest) for c in shaped)
            done = letters
        if len(word) < 200:
            if len(self.seen) > 300_000:
                self.seen.clear()
                self.known.clear()
            self.seen[word] = self.known[shaped] = done
        return done

    def text(self, text: str) -> str:
        parts = _PARTS.split(folded(text))
        parts[1::2] = map(self.consistent, parts[1::2])
        return unicodedata.normalize("NFC", "".join(parts))


def letter_pairs(df: DataFrame, text: str) -> dict[tuple[str, str], int]:
    """How often letter follows letter in all words of one script; at most one row for each two letters of an alphabet.

    A word counts if all its letters, as they are stored, are of one script. Only base letters of the
    scripts that have look-alikes are counted, which bounds the table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            words: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    words.update(_PARTS.findall(folded(t)))
            for w, n in words.items():
                letters = [c for c in w if not unicodedata.combining(c)]
                scripts = {script(c) for c in letters}
                if len(scripts) == 1 and "" not in scripts:
                    pairs["^", letters[0]] += n
                    pairs[letters[-1], "$"] += n
                    for a, b in zip(letters, letters[1:]):
                        pairs[a, b] += n
        keys = list(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.string()), pa.array([pairs[k] for k in keys], pa.int64())], names=["a", "b", "n"])

    rows = df.select(text).mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return {(r.a, r.b): r.n for r in rows}


def consistent(df: DataFrame, text: str, out: str = "consistent") -> DataFrame:
    """The table with the text's consistent form as a further column, and digests of both texts.

    Adds ``out`` (string), ``look`` (digest of the consistent form) and ``exact`` (digest of the text
    as it is); columns of these names are replaced. All are null for a null text.
    """
    pairs = letter_pairs(df, text)
    df = df.drop(*[c for c in (out, "look", "exact") if c != text])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField("look", T.BinaryType()), T.StructField("exact", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(pairs)
        digest = lambda t: blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            forms = [None if t is None else reader.text(t) for t in texts]
            more = [pa.array(forms, pa.string())] + [pa.array([None if t is None else digest(t) for t in x], pa.binary()) for x in (forms, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, out, "look", "exact"])

    return df.mapInArrow(run, schema)


#: Texts of one look that are compared with one another in one group of the join.
BLOCK = 512


def same_looking_texts(docs: DataFrame) -> DataFrame:
    """``a, b`` with a < b: the digests of different texts that have one look.

    Equal texts are one row here. A look that many different texts share is cut into blocks, and each
    pair of blocks meets on its own, so no task holds a whole group.
    """
    texts = docs.select("look", "exact").distinct()
    several = texts.groupBy("look").agg(F.count("*").alias("n")).filter("n > 1").select("look", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    texts = texts.join(several, "look")
    texts = texts.withColumn("block", F.pmod(F.xxhash64("exact"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    texts = texts.select("look", "exact", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    a = texts.filter("block = i").select("look", "i", "j", F.col("exact").alias("a"))
    b = texts.filter("block = j").select("look", "i", "j", F.col("exact").alias("b"))
    pairs = a.join(b, ["look", "i", "j"]).filter("(i = j and a < b) or (i <> j and a <> b)")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def same_looking_pairs(docs: DataFrame, key: str) -> DataFrame:
    """``doc_a, doc_b`` with equal ``look`` and different ``exact``, smaller key first.

    Pairs are those of texts first; their documents are put in afterwards, by joins on the text alone.
    """
    docs = docs.select(F.col(key).alias("doc"), "look", "exact").filter("look is not null and doc is not null")
    texts = materialise(same_looking_texts(docs), "same-looking-texts")
    found = texts.join(docs.select(F.col("exact").alias("a"), F.col("doc").alias("x")), "a").join(docs.select(F.col("exact").alias("b"), F.col("doc").alias("y")), "b")
    return found.filter("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
