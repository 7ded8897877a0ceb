"""Pieces, tokens, look-alikes and hand-written files."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spangraph.llm import handwritten as hw
from spangraph.llm import lookalike as la
from spangraph.llm import tokenizer as tk
from spangraph.llm.chunking import current_long_texts, pieces, split_text

# ---- pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\r\t😀é", max_size=200), st.integers(1, 40), st.integers(0, 39))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    p = pieces(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text) and all(b - a <= limit for a, b in p)
    for (a, b), (c, d) in zip(p, p[1:]):
        assert a < c <= b < d and b - c <= overlap


def test_pieces_end_at_lines_then_words_then_hard():
    lines = "".join(f"line {i} with words\n" for i in range(100))
    p = pieces(lines, 200, 40)
    assert all(lines[b - 1] == "\n" and (a == 0 or lines[a - 1] == "\n") for a, b in p[:-1])
    words = "word " * 100
    assert all(words[b - 1] == " " for _, b in pieces(words, 52, 10)[:-1])
    assert pieces("x" * 100, 40, 10) == [(0, 40), (30, 70), (60, 100)]


def test_hard_cuts_keep_letters_whole_and_no_tiny_pieces():
    marked = "e\u0301" * 100
    p = pieces(marked, 41, 10)
    assert all(marked[b] == "e" for _, b in p[:-1]) and p[-1][1] == len(marked)
    assert pieces("\u0301" * 100, 40, 10) == [(0, 40), (30, 70), (60, 100)]
    text = "w " * 50 + "x\n" + "a " * 300
    assert all(b - a > 25 for a, b in pieces(text, 100, 10)[:-1])


def test_split_text(spark):
    text = "".join(f"{i:04}\r\n" for i in range(500))
    df = spark.createDataFrame([("a", text, 10), ("b", None, 1), ("c", "", None), ("d", "short", None)], "id string, t string, start_line long").withColumn("chunk_index", F.lit("clash"))
    rows = split_text(df, "id", "t", "start_line").orderBy("id", "chunk_index").collect()
    assert [(r.id, r.text) for r in rows if r.id != "a"] == [("c", ""), ("d", "short")]
    for r in (r for r in rows if r.id == "a"):
        assert len(r.text) <= 1200 and r.text.endswith("\r\n")
        assert r.start_line == 10 + int(r.text[:4]) and r.end_line == 10 + int(r.text[-6:-2])
    with pytest.raises(ValueError):
        split_text(df, "id", "t", limit=10, overlap=10)


def test_the_current_version_is_what_is_split(spark):
    rows = [("a", "x" * 2000, 1, 0), ("a", "short", 2, 0), ("b", "x", 1, 0), ("b", "y" * 1201, 2, None), ("c", "z" * 1201, 1, 0), ("c", None, 2, 0), ("d", "w" * 1200, 1, 0), (None, "v" * 3000, 1, 0), ("b", "y" * 1201, 2, None)]
    df = spark.createDataFrame(rows, "id string, content string, indexed_at int, start_line long")
    assert [r.id for r in current_long_texts(df, 1200).collect()] == ["b"]


# ---- tokens


def test_tokens_are_the_librarys(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tk.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rnd = random.Random(1)
    texts = ["", None, " ", "<|endoftext|>", "a" * 3000, "é" * 900, " \n\n x", "It's we'll", "日本語のテキスト" * 40, "x" + "ab" * 700 + "🙂"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x2FFF), 10, 9, 0])) for _ in range(rnd.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("ids", F.lit("clash"))
    got = {r.id: r.ids for r in tk.encode(df, "text").collect()}
    for i, x in enumerate(texts):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else []), ascii(x)
    back = {r.id: r.text for r in tk.decode(tk.encode(df, "text"), "ids").collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(texts))
    sizes = {r.id: r.n_tokens for r in tk.token_counts(df.select("id", "text"), "text").collect()}
    assert all(sizes[i] == len(got[i]) for i in got)
    assert tk.encode(df.limit(0), "text").count() == 0


def test_cutting_words_changes_no_token():
    e = tk.WordEncoder("byte_bpe_50k", tk.TOKENIZERS)
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 60))) for _ in range(400)] + ["a" * n for n in range(1, 40)] + ["データの検索" * 20, "internationalizationofthewholecollection" * 9]
    words += ["".join(chr(rnd.choice([rnd.randrange(97, 123), rnd.randrange(0x3040, 0x30FF), rnd.randrange(0x430, 0x450)])) for _ in range(300)) for _ in range(20)]
    words = list(dict.fromkeys(words))
    e.learn(set(words))
    by_parts, e.parts = dict(e.known), {}
    e.contract([w.encode() for w in words])
    assert all(by_parts[w] == e.parts[w.encode()] for w in words)
    cut = e.cut([w.encode() for w in words])
    assert all(b"".join(c) == w.encode() for c, w in zip(cut, words)) and max(len(c) for c in cut) > 50


def test_long_words_are_no_cliff():
    import time

    e = tk.WordEncoder("byte_bpe_50k", tk.TOKENIZERS)
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(250)) for _ in range(1500)} | {"x" * 100_000}
    t = time.perf_counter()
    e.learn(words)
    assert time.perf_counter() - t < 20 and set(map(len, e.cut([b"x" * 100_000]))) == {1}


def test_ids_outside_the_vocabulary(spark):
    df = spark.createDataFrame([(1, [7_000_000, None, 0]), (2, None), (3, [])], "id int, ids array<int>")
    got = {r.id: r.text for r in tk.decode(df, "ids").collect()}
    assert got[1].startswith("\ufffd\ufffd") and len(got[1]) == 3 and got[2] == got[3] == ""


# ---- look-alikes

PAIRS = {("^", "a"): 9, ("a", "$"): 9}


@pytest.mark.parametrize("a, b", [
    ("café", "café"), ("page", "pаge"), ("COPY", "СОРY"), ("file", "ﬁle"), ("abc", "ａbｃ"), ("a b", "a b"), ("a b", "a　b"), ("ab", "a​b"), ("ab", "a﻿b⁠"),
    ("e‍́", "é"), ("データ", "ﾃﾞｰﾀ"), ("K", "K"), ("III", "Ⅲ"), ("ё", "ё"), ("no", "nο"), ("❤", "❤️"), ("soft", "so­ft"), ("한", "한"),
])
def test_looks_the_same(a, b):
    r = la.Reader(PAIRS)
    assert a != b and r.text(a) == r.text(b)


@pytest.mark.parametrize("a, b", [
    ("a", "A"), ("e", "é"), ("1", "2"), ("x2", "x²"), ("a b", "a  b"), ("a b", "a\tb"), ("a.", "a,"), ("l", "1"), ("O", "0"), ("1/2", "½"), ("a-b", "a–b"), ("ß", "ss"), ("(1)", "⑴"), ("a\n", "a"),
    ("\U0001f469‍\U0001f4bb", "\U0001f469\U0001f4bb"),
])
def test_looks_different(a, b):
    r = la.Reader(PAIRS)
    assert r.text(a) != r.text(b)


def test_the_tables_of_the_operator_and_of_its_sql_agree():
    from spangraph.llm.oracle import _shapes

    assert {c: g for c, g in la.SHAPE.items() if c != g} == _shapes()


@pytest.mark.parametrize("a, b", [("LOCO", "ԼՕСО"), ("HAWK", "ᎻᎪᎳᏦ"), ("go", "ɡo"), ("no", "ոօ")])
def test_rarer_scripts_look_the_same_and_their_own_words_stay(a, b):
    assert la.Reader(PAIRS).text(a) == la.Reader(PAIRS).text(b) == la.Reader({}).text(a)
    native = {("^", "ո"): 50, ("ո", "ւ"): 50, ("ւ", "մ"): 50, ("մ", "$"): 50, ("^", "a"): 50, ("a", "$"): 50}
    assert la.Reader(native).text("ում") == "ում" and la.Reader(native).text("a") == "a"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_the_form_is_stable(text):
    r = la.Reader(PAIRS)
    assert r.text(r.text(text)) == r.text(text)
    assert r.text(unicodedata.normalize("NFD", text)) == r.text(unicodedata.normalize("NFC", text))


def test_words_take_the_script_of_the_collection(spark):
    docs = [(1, "привет сорок"), (2, "copy the scope copy op top"), (3, "scоpe"), (4, None), (5, "")]
    got = {r.id: r.consistent for r in la.consistent(spark.createDataFrame(docs, "id long, text string"), "text").collect()}
    assert got[1] == docs[0][1] and got[2] == docs[1][1] and got[3] == "scope" and got[4] is None and got[5] == ""


def test_pairs_of_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(la, "BLOCK", 4)
    docs = [(i, "same" if i % 3 else "sаme") for i in range(30)] + [(100, "only"), (101, "only"), (102, None)]
    df = la.consistent(spark.createDataFrame(docs, "doc_id long, text string"), "text")
    got = [(r.doc_a, r.doc_b) for r in la.same_looking_pairs(df, "doc_id").collect()]
    assert sorted(got) == sorted((a, b) for a in range(30) for b in range(a + 1, 30) if (a % 3 == 0) != (b % 3 == 0)) and len(set(got)) == len(got)
    assert la.same_looking_pairs(df.limit(0), "doc_id").count() == 0


# ---- hand-written files

CODE = "import os\n\n# counts what is there\ndef count(rows):\n    total = 0\n    for row in rows:\n        if row is None:\n            continue\n        total += len(row)\n    return total\n\n\nclass Box:\n    def open(self, key):\n        return os.path.join(key, 'x')\n"


@pytest.mark.parametrize("path, text", [
    ("vendor/x/a.py", CODE), ("web/node_modules/x/a.js", CODE), ("a/b_pb2.py", CODE), ("a/__generated__/b.py", CODE), ("a/x.min.js", ""), ("a.py", "# Code generated by x. DO NOT EDIT.\n" + CODE), ("a.py", CODE + "# checksum 0a1b2c3d4e; regenerate with `x y`\n"),
    ("a.js", "/*! lib v1.2.3 | (c) the lib authors | lib.example */\n" + CODE), ("a.js", "/**\n * lib 2.0\n * Released under the permissive licence of lib\n */\n" + CODE), ("a.js", "!function(e,t){var n=e||{};" + "a=>b(c,1),d[e]=f;" * 80 + "}"),
    ("a.py", "X = [\n" + "".join(f"    {i}.5, {i * 7}, -{i},\n" for i in range(60)) + "]\n"), ("a.py", 'X = "' + "QmFzZTY0" * 60 + '"\n'), ("a.ts", "".join(f"export const NAME_{i} = {i};\n" for i in range(30))),
    ("a.ts", "".join(f"  do{i}(request) {{\n    return this.call('/S/do', request, 'R{i}');\n  }}\n\n" for i in range(6))),
])
def test_not_by_hand(path, text):
    said = hw.comments(text)
    assert hw.made_path(path) or hw.made_comment(said) or hw.foreign_licence(said) or hw.made_layout(text, path.rpartition(".")[2])


@pytest.mark.parametrize("path, text", [
    ("src/codegen/a.py", CODE), ("src/vendors/a.py", CODE), ("lib/external_links/a.py", CODE), ("src/bundle/a.py", CODE), ("a.py", "# Copyright (c) the repo-1 team. See LICENCE.\n" + CODE), ("a.py", "# ids are generated by the caller, do not edit the map directly\n" + CODE),
    ("a.py", 'banner = "Code generated by x. DO NOT EDIT."\n' + CODE), ("a.py", "# do not edit while a scan is running\n" + CODE), ("a.py", CODE + "NOTE = '" + "words of a long message " * 30 + "'\n" + CODE), ("a.py", CODE + "LIMITS = [1, 2, 3, 40, 500]\n"), ("a.py", ""), ("a.py", " \n"),
])
def test_by_hand(path, text):
    said = hw.comments(text)
    assert not (hw.made_path(path) or hw.made_comment(said) or hw.foreign_licence(said) or hw.made_layout(text, path.rpartition(".")[2]))


def test_copies_of_foreign_code_wherever_they_lie(spark):
    bare = CODE.replace("# counts what is there\n", "")
    scanned = spark.createDataFrame([("r", "vendor/l/x.py"), ("r", "vendor/l/x.py"), ("q", "src/y.py"), ("q", "src/z.py"), ("q", "src/none.py"), ("q", "dist/none.py"), (None, "a"), ("q", None)], "repo string, path string").withColumn("made", F.lit(1))
    nodes = [("File:r/vendor/l/x.py", CODE, 1), ("File:q/src/y.py", "old", 1), ("File:q/src/y.py", bare.replace("\n", "\r\n"), 2), ("File:q/src/z.py", CODE.replace("total", "amount"), 1), ("File:q/src/none.py", None, 1), ("Function:q/src/y.py", CODE, 9), (None, "x", 1)]
    got = hw.not_handwritten(scanned, spark.createDataFrame(nodes, "id string, content string, indexed_at int"))
    assert sorted((r.repo, r.path) for r in got.collect()) == [("q", "dist/none.py"), ("q", "src/y.py"), ("r", "vendor/l/x.py")]
    assert hw.not_handwritten(scanned.limit(0), spark.createDataFrame(nodes, "id string, content string, indexed_at int")).count() == 0


def test_layout_of_lines_over_2000_characters():
    table = "\n".join("[" + ", ".join(['"alpha"', '"beta"', '"gamma"'] * 120) + "]," for _ in range(12))
    assert min(map(len, table.split("\n"))) > 2000 and hw.layout(table)["space"] > 0.1
    assert hw.layout(table)["commonest"] == 1.0 and hw.made_layout(table, "py")
    members = "\n".join("ab + " * 450 + f"m_{i};" for i in range(1, 7))
    assert hw.layout(members)["counted"] == 6 and hw.made_layout(members, "c")
    own = "\n".join("ab + " * (450 + i) + "c;" for i in range(12))
    assert not hw.made_layout(own, "c")


def test_print_without_block_comments():
    code = "#include <a.h>\n" + "".join(f"int value_{i} = compute({i}); // why\n" for i in "abcdefgh")
    bare = hw.code_print(code)
    for head in ("/*\n * lib 1.2.3\n * Copyright X\n */\n", "/* lib 1.2.3\r\n   Copyright X\r\n#include no\r\n*/\r\n", "/* one */\n", "/**\n a **/\n", "<!-- lib\n Copyright X\n-->\n", "/* a\n b */ /* c\n d */\n"):
        assert hw.code_print(head + code) == bare, head
    assert bare and hw.code_print("/* a\n b */ int x;\n" + code) == hw.code_print("int x;\n" + code) != bare
    assert hw.code_print("/* never closed\n" + code) == bare
    assert hw.code_print(code.replace("value_c", "other")) != bare


def _words(k: int) -> str:
    rnd = random.Random(k)
    name = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    return "".join(rnd.choice([f"def {name()}({name()}):\n    return {name()} + {name()}\n", f"for {name()} in {name()}:\n    {name()}.append({name()})\n", f"if {name()} is None:\n    raise {name()}\n"]) for _ in range(60))


def test_near_copies_against_brute_force(spark):
    lib, rnd = _words(1), random.Random(5)
    files = [("File:r/vendor/l/x.py", lib), ("File:q/same.py", lib), ("File:q/one.py", lib.replace("return", "yield", 1)), ("File:q/other.py", _words(2)), ("File:q/half.py", lib[: len(lib) // 2] + _words(3)), ("File:q/tiny.py", "pass\n"), ("File:r/vendor/l/tiny.py", "pass\n")]
    lines = lib.split("\n")
    for k in range(2, 32):  # more and more lines changed, so similarities on both sides of the limit
        own = [x if rnd.random() > k / 120 else x + f"  + extra{k}" for x in lines]
        files.append((f"File:q/part{k}.py", "\n".join(own)))
    files += [(f"File:q/again{k}.py", files[2][1]) for k in range(40)]
    scanned = spark.createDataFrame([tuple(i[5:].split("/", 1)) for i, _ in files], "repo string, path string")
    got = {(r.repo, r.path): r.rule for r in hw.judged_files(scanned, spark.createDataFrame([(*f, 1) for f in files], "id string, content string, indexed_at int")).collect()}
    base, rules = set(hw.shingles(hw.code_of(lib)).tolist()), {}
    for i, text in files:
        own = set(hw.shingles(hw.code_of(text)).tolist())
        rules[tuple(i[5:].split("/", 1))] = "near-copy" if own and len(own & base) >= 0.8 * len(own | base) else None
    for key, rule in rules.items():
        want = "place" if key[1].startswith("vendor") else "copy" if key[1] == "same.py" else rule
        assert got[key] == want, key
    assert sum(r == "near-copy" for r in rules.values()) > 45 and sum(r is None for r in rules.values()) > 8


def test_limits_lie_between_hand_written_and_made():
    hand = [("py", CODE + f"x{i} = {i}\n", False) for i in range(20)]
    made = [("py", "".join(f"    {i * k}, {i}, 7, 19, 230,\n" for i in range(40)), True) for k in range(1, 9)]
    limits = hw.fit_limits(hand + made)
    last, middle = max(hw.layout(t)["numbers"] for _, t, _ in hand), min(hw.layout(t)["numbers"] for _, t, _ in made)
    assert last < limits["py"]["numbers"] < middle and limits["py"] == limits[None]
    assert hw.fit_limits([]) == {} and all(set(v) == set(hw.GREATER) for v in hw.LIMITS.values())


def test_every_file_has_one_rule(spark):
    scanned = spark.createDataFrame([("r", "vendor/a.py"), ("r", "b.py"), ("r", "b.py"), ("r", "c.py"), ("r", "d.min.js"), ("r", "e.py"), (None, "x")], "repo string, path string")
    nodes = spark.createDataFrame([("File:r/vendor/a.py", CODE, 1), ("File:r/b.py", CODE, 1), ("File:r/c.py", CODE.replace("total", "sum_of") * 2, 1), ("File:r/e.py", "# Code generated by x. DO NOT EDIT.\n" + CODE.replace("rows", "lines") * 3, 1)], "id string, content string, indexed_at int")
    got = sorted((r.path, r.rule) for r in hw.judged_files(scanned, nodes).fillna("-").collect())
    assert got == [("b.py", "copy"), ("c.py", "-"), ("d.min.js", "name"), ("e.py", "mark"), ("vendor/a.py", "place")]
