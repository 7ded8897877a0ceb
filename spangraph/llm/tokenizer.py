"""Encoding texts with a public byte-level BPE vocabulary by relational contraction.

A task cuts its texts into words with the vocabulary's pattern and looks up each distinct word once.
The words it has not seen before become rows (word, position, token) of a DuckDB table in the task,
one token for each byte. A recursive query joins neighbouring tokens with the merge table, finds
each word's smallest rank and contracts the leftmost pairs of that rank, until no pair of the word
is in the table. All non-overlapping occurrences of a word's smallest rank are contracted in one
step: a token made by a merge takes part only in merges of a greater rank, so the result is that of
contracting them one by one. Ordered aggregation puts the ids of a word together, and the ids of a
text are those of its words in order.

Words of any length go the same way. The recursion has one row a byte (USING KEY), which a step
replaces, so steps leave no copies. Before, a word is cut at places that no token of the vocabulary can reach over:
the bytes around them (up to REACH to either side) occur in no token. No merge crosses such a place, so
its sides contract on their own, and what is left to contract is short and often known.

Decoding is the same in reverse: token-position rows join the bytes of the tokens, and an aggregation
in the order of the positions puts each text together.

Defined results: an empty and a null text have the empty list; text that looks like a special token
is ordinary text; any text of any length is encoded as a whole. Decoding gives the exact text back;
an id that isn't in the vocabulary, or is null, becomes U+FFFD.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary files lie; a parameter of every function that reads them.
TOKENIZERS = "/opt/tokenizers"

# Fixed value: the published word pattern of the GPT-2 byte-level BPE.
WORD = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words that a worker remembers, and bytes of new words that one query contracts.
REMEMBERED, QUERY_BYTES = 300_000, 400_000
#: Bytes to either side of a place that tell whether a token can reach over it.
REACH = 3
#: Tokens of texts that one query decodes.
QUERY_TOKENS = 1_000_000

_CONTRACT = """
with recursive steps(word, pos, tok) using key (word, pos) as (
  select word, pos, tok from fresh
  union
  select word, pos, case when taken then made end
  from (
    select *, coalesce(lag(taken) over (partition by word order by pos), false) as gone
    from (
      select *, hit and (row_number() over (partition by word, hit, island order by pos)) % 2 = 1 as taken
      from (
        select *, case when hit then pos_rank - row_number() over (partition by word, hit order by pos) end as island
        from (
          select *, rank is not null and rank = min(rank) over (partition by word) as hit
          from (
            select s.word, s.pos, s.tok, s.pos_rank, m.rank, m.made
            from (
              select word, pos, tok, lead(tok) over w as next, row_number() over w as pos_rank
              from recurring.steps where tok is not null and word in (select word from steps) window w as (partition by word order by pos)) s
            left join merges m on m.a = s.tok and m.b = s.next)))))
  where taken or gone)
select word, list(tok order by pos) as ids from steps where tok is not null group by word
"""

_DECODE = """
select row, string_agg(coalesce(code, 'EFBFBD'), '' order by pos) as code
from positions left join token_bytes using (id) group by row
"""


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file: bytes without a letter of their own follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def vocabulary(name: str, folder: str) -> tuple[np.ndarray, pa.Table, dict[int, bytes]]:
    """The token of each byte, the merge table (a, b, rank, made) and the bytes of each token."""
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids, letters = model["vocab"], _byte_letters()
    single = np.array([ids[letters[b]] for b in range(256)], dtype=np.int32)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    table = pa.table({
        "a": pa.array([ids[a] for a, _ in merges], pa.int32()), "b": pa.array([ids[b] for _, b in merges], pa.int32()),
        "rank": pa.array(range(len(merges)), pa.int32()), "made": pa.array([ids[a + b] for a, b in merges], pa.int32()),
    })
    bytes_of = {c: b for b, c in letters.items()}
    texts = {i: bytes(bytes_of[c] for c in t) for t, i in ids.items() if all(c in bytes_of for c in t)}
    return single, table, texts


def _database():
    import duckdb

    # everything stays in memory: a worker has no folder of its own to spill to
    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


def reachable_contexts(tokens: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
    """Sorted codes of the bytes around all places within tokens, by how many there are to the left and to the right.

    Fewer than REACH bytes mean that the token begins or ends there.
    """
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    sizes = sorted({len(t) for t in tokens if len(t) > 1})
    for n in sizes:
        rows = np.frombuffer(b"".join(t for t in tokens if len(t) == n), dtype=np.uint8).reshape(-1, n)
        for cut in range(1, n):
            left, right = min(cut, REACH), min(n - cut, REACH)
            found.setdefault((left, right), []).append(_code([rows[:, cut - left + i] for i in range(left + right)]))
    return {k: np.unique(np.concatenate(v)) for k, v in found.items()}


def _code(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        out = out << 8 | c
    return out


class WordEncoder:
    """Encodes distinct words in one DuckDB connection of this worker process."""

    def __init__(self, name: str, folder: str):
        self.single, merges, texts = vocabulary(name, folder)
        self.contexts = reachable_contexts(list(texts.values()))
        self.db = _database()
        self.db.register("merges_in", merges)
        self.db.execute("create table merges as select * from merges_in")
        self.known: dict[str, list[int]] = {}
        self.parts: dict[bytes, list[int]] = {}

    def learn(self, words: set[str]) -> None:
        """Make sure that the words are known."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(words)
        if not new:
            return
        if len(self.parts) > REMEMBERED:
            self.parts = {}
        cut = self.cut([w.encode("utf-8") for w in new])
        fresh = list({p for ps in cut for p in ps if p not in self.parts})
        at = 0
        while at < len(fresh):
            some, size = [], 0
            while at < len(fresh) and (not some or size + len(fresh[at]) < QUERY_BYTES):
                some.append(fresh[at])
                size += len(fresh[at])
                at += 1
            self.contract(some)
        for w, ps in zip(new, cut):
            self.known[w] = self.parts[ps[0]] if len(ps) == 1 else [i for p in ps for i in self.parts[p]]

    def cut(self, coded: list[bytes]) -> list[list[bytes]]:
        """Each word cut at the places that no token reaches over."""
        whole = b"".join(coded)
        codes = np.frombuffer(whole, dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(c) for c in coded])
        n = len(codes)
        begin, end = np.repeat(ends - [len(c) for c in coded], [len(c) for c in coded]), np.repeat(ends, [len(c) for c in coded])
        at = np.arange(1, n)  # a place is named by the byte behind it
        at = at[begin[at] != at]
        crossed = np.zeros(len(at), dtype=bool)
        for (left, right), known in self.contexts.items():
            fits = np.flatnonzero(~crossed & (at - left >= begin[at]) & (at + right <= end[at]))
            own = _code([codes[at[fits] - left + i] for i in range(left + right)])
            found = np.minimum(np.searchsorted(known, own), len(known) - 1)
            crossed[fits[known[found] == own]] = True
        places = np.sort(np.concatenate((at[~crossed], ends)))
        out, start, k = [], 0, 0
        for stop in ends.tolist():
            parts = []
            while start < stop:
                parts.append(whole[start : int(places[k])])
                start, k = int(places[k]), k + 1
            out.append(parts)
        return out

    def contract(self, parts: list[bytes]) -> None:
        """Contract parts of words by the recursive query."""
        lengths = np.array([len(c) for c in parts])
        word = np.repeat(np.arange(len(parts), dtype=np.int32), lengths)
        pos = np.arange(len(word), dtype=np.int32)
        fresh = pa.table({"word": word, "pos": pos, "tok": self.single[np.frombuffer(b"".join(parts), dtype=np.uint8)]})
        self.db.register("fresh", fresh)
        done = self.db.sql(_CONTRACT).to_arrow_table()
        self.db.unregister("fresh")
        for w, ids in zip(done["word"].to_pylist(), done["ids"].to_pylist()):
            self.parts[parts[w]] = ids


class TokenDecoder:
    """Puts texts together from token ids in one DuckDB connection of this worker process."""

    def __init__(self, name: str, folder: str):
        texts = vocabulary(name, folder)[2]
        self.db = _database()
        self.db.register("bytes_in", pa.table({"id": pa.array(texts.keys(), pa.int32()), "code": [t.hex() for t in texts.values()]}))
        self.db.execute("create table token_bytes as select * from bytes_in")

    def texts(self, ids: pa.Array) -> list[str]:
        """The text of each list; null and empty lists have the empty text."""
        parents = pc.list_parent_indices(ids).to_numpy()
        flat = pa.table({"row": parents, "pos": np.arange(len(parents)), "id": ids.flatten().cast(pa.int32())})
        self.db.register("positions", flat)
        done = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("positions")
        out = [""] * len(ids)
        for row, code in zip(done["row"].to_pylist(), done["code"].to_pylist()):
            out[row] = bytes.fromhex(code).decode("utf-8", "replace")
        return out


@lru_cache(maxsize=2)
def encoder(name: str, folder: str) -> WordEncoder:
    return WordEncoder(name, folder)


@lru_cache(maxsize=2)
def decoder(name: str, folder: str) -> TokenDecoder:
    return TokenDecoder(name, folder)


@lru_cache(maxsize=1)
def word_pattern():
    import regex

    return regex.compile(WORD)


def encode(df: DataFrame, text: str, ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The table with the text column replaced by the list of its token ids."""
    df = df.drop(ids) if ids != text else df
    keep = [c for c in df.columns if c != text]
    out = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, find = encoder(name, folder), word_pattern().findall
        for batch in batches:
            for part in _by_size(batch, text):
                cut = [find(t) if t else [] for t in part.column(text).to_pylist()]
                words.learn({w for ws in cut for w in ws})
                known = words.known
                lists = [[i for w in ws for i in known[w]] for ws in cut]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lists, pa.list_(pa.int32()))], names=[*keep, ids])

    return df.select(*keep, text).mapInArrow(run, out)


def _by_size(batch: pa.RecordBatch, text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a few million bytes each; a longer text is a slice of its own."""
    yield from _slices(batch, pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist(), most)


def _slices(batch: pa.RecordBatch, sizes: list[int], most: int) -> Iterator[pa.RecordBatch]:
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(sizes) > start:
        yield batch.slice(start)


def decode(df: DataFrame, ids: str, text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The table with the id lists replaced by their text; a null list has the empty text."""
    df = df.drop(text) if text != ids else df
    keep = [c for c in df.columns if c != ids]
    out = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = decoder(name, folder)
        for batch in batches:
            for part in _slices(batch, pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_pylist(), QUERY_TOKENS):
                decoded = pa.array(read.texts(part.column(ids)), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), decoded], names=[*keep, text])

    return df.select(*keep, ids).mapInArrow(run, out)


@lru_cache(maxsize=2)
def _counter(name: str, folder: str):
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=WORD, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, count: str = "n_tokens", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The table with the text column replaced by its number of tokens, 0 for null, counted by the public library."""
    keep = [c for c in df.columns if c not in (text, count)]
    out = T.StructType([*(df.schema[c] for c in keep), T.StructField(count, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = _counter(name, folder).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode_one(t)) if t else 0 for t in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), sizes], names=[*keep, count])

    return df.select(*keep, F.col(text)).mapInArrow(run, out)
