"""Files, git history, registries and configuration."""

import os
import subprocess

import pytest

from spangraph import sources
from spangraph.runtime import materialise, shared_dir


def test_scan_drops_declarations_beside_their_source(spark, tmp_path):
    for name in ("a.ts", "a.d.ts", "b.d.ts", "sub/c.py", "node_modules/x.js", "big.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x" * (2000 if name == "big.txt" else 1))
    got = [r.path for r in sources.scan_files(spark, str(tmp_path), ignore="^node_modules/", max_bytes=1000).collect()]
    assert got == ["a.ts", "b.d.ts", "sub/c.py"]
    assert sources.bounded_count(spark.range(9), 3) == 4
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in sources.read_texts(spark, str(tmp_path / "sub")).collect()}
    assert texts == {"c.py": "x"}


def test_git_log(spark, tmp_path):
    assert sources.git_log(spark, str(tmp_path / "none")) is None
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for k in range(2):
        (tmp_path / f"f{k}").write_text(str(k))
        (tmp_path / "same").write_text(str(k))
        run("add", "-A")
        run("commit", "-qm", str(k))
    got = sources.git_log(spark, str(tmp_path))
    assert sorted(r.file for r in got.collect()) == ["f0", "f1", "same", "same"] and got.select("commit_id").distinct().count() == 2


def test_edges_by_label_and_registry(spark, tmp_path):
    e = spark.createDataFrame([("File:a", "Function:b", "X"), ("comm_1", "File:a", "Y")], "src string, dst string, type string")
    sources.write_edges_by_label(e, str(tmp_path / "edges"))
    back = spark.read.option("header", True).csv(str(tmp_path / "edges"))
    assert {(r.from_label, r.to_label) for r in back.collect()} == {("File", "Function"), ("Community", "File")}
    from spangraph.model import CONTRACTS

    c = spark.createDataFrame([("http::GET::/a", "http", "provider", "r", None, "u", "f", "s", 0.5, "{}")], CONTRACTS)
    sources.write_contracts(c, str(tmp_path / "reg"))
    assert sources.read_contracts(spark, str(tmp_path / "reg")).collect() == c.collect()


def test_group_config(spark):
    got = sources.group_config(spark, "name: g\nrepos:\n  web: /w  # front\n  api:\n    path: /a\n    service: core\n")
    assert sorted((r.repo, r.path, r.service) for r in got.collect()) == [("api", "/a", "core"), ("web", "/w", None)]
    with pytest.raises(ValueError):
        sources.group_config(spark, "name: g\n")


def test_materialised_rows_lie_in_the_shared_folder(spark):
    df = materialise(spark.range(5), "rows")
    folder = shared_dir(spark).removeprefix("file:").replace("//", "/")
    assert df.count() == 5 and any(name.startswith("rows-") for name in os.listdir(folder))
