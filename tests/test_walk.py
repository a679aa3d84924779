"""Walking trees: equal to the rules over all files, and what is listed and opened."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import scan
from corpusmill.sources import walk


def write(root, files):
    for path, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_rules_over_all_files(spark, tmp_path, seed):
    r = random.Random(seed)
    names, endings = ["a", "b", "build", "src", "x.y"], ["ts", "log", "md"]
    files = {}
    for _ in range(150):
        folder = "/".join(r.choice(names) for _ in range(r.randrange(4)))
        files[f"{folder}/f{r.randrange(9)}.{r.choice(endings)}".lstrip("/")] = "text"
    rules = ["*.log", "!f1.log", "build/", "/a", "src/*", "!src/f2.ts", "**/b/*.md", "# c", "", "x.y", "f[12].ts", "!/a/b/", "a/**/f3.*"]
    for folder in {os.path.dirname(p) for p in list(files)} | {""}:
        if r.random() < 0.4 or not folder:
            files[f"{folder}/.gitignore".lstrip("/")] = "\n".join(r.sample(rules, r.randrange(1, 5)))
    files = {p: t for p, t in files.items() if not any(o.startswith(p + "/") for o in files)}
    write(tmp_path, files)
    every = spark.createDataFrame(list(files.items()), "path string, content string").withColumn("size", F.octet_length("content").cast("long"))
    expected = sorted(x.path for x in scan.classify(every, 1000, rules=scan.ignore_rules(every)).where("reason is null").collect())
    assert sorted(x.path for x in walk.read_tree(spark, str(tmp_path), ("path",)).collect()) == expected


def test_ignored_folders_are_never_listed(spark, tmp_path):
    write(tmp_path, {".gitignore": "skip/\n", "a/b/c.ts": "x", "a/skip/d/e.ts": "x", "skip/f.ts": "x", "a/.gitignore": "!skip/\n", "a/b/skip/z": "x"})
    listed = walk.read_tree(spark, str(tmp_path), ("path", "folder"), folders=True).where("folder").collect()
    assert sorted(x.path for x in listed) == ["/", "a/", "a/b/", "a/b/skip/", "a/skip/", "a/skip/d/"]


def test_filters_are_pushed_to_the_walk(spark, tmp_path, monkeypatch):
    write(tmp_path, {f"{f}/{k}.{e}": "x" * k for f in ("a/b", "a/c", "d") for k in range(20) for e in ("ts", "py")})
    found = walk.read_tree(spark, str(tmp_path), ("path", "size")).where("startswith(path, 'a/b/1') and endswith(path, '.py') and size > 11 and size <= 15 and path <> 'a/b/13.py'")
    assert sorted((x.path, x.size) for x in found.collect()) == [(f"a/b/{k}.py", k) for k in (12, 14, 15)]
    reader = walk.Reader({"path": str(tmp_path)}, ["path"])
    assert list(reader.pushFilters([walk.StringStartsWith(("path",), "a/b/1"), walk.StringEndsWith(("path",), ".py")])) == []
    listed = []
    plain = reader.listed
    monkeypatch.setattr(reader, "listed", lambda folder, layers: listed.append(folder) or plain(folder, layers))
    rows = [x for part in reader.partitions() for x in reader.read(part)]
    assert len(rows) == 11 and set(listed) == {"", "a", "a/b"}


def test_contents_and_odd_files(spark, tmp_path):
    write(tmp_path, {"t.txt": "é\n", "bin": b"a\0b", "bad": b"\xff", "empty": "", "d/e/f/g": "deep"})
    os.symlink(tmp_path / "d", tmp_path / "loop")
    rows = {x.path: (x.size, x.binary, x.content) for x in walk.read_tree(spark, str(tmp_path)).collect()}
    assert rows == {"t.txt": (3, False, "é\n"), "bin": (3, True, None), "bad": (1, False, "�"), "empty": (0, False, ""), "d/e/f/g": (4, False, "deep")}
    assert walk.read_tree(spark, str(tmp_path / "none")).count() == 0


def test_wide_and_deep_trees_are_dealt_out(spark, tmp_path):
    write(tmp_path, {f"w/{k}/x": "1" for k in range(100)} | {"n/" + "n/" * 80 + "x": "2"})
    reader = walk.Reader({"path": str(tmp_path)}, ["path"])
    parts = reader.partitions()
    assert len(parts) > 64
    paths = sorted(x[0] for p in parts for x in reader.read(p))
    assert paths == sorted([f"w/{k}/x" for k in range(100)] + ["n/" + "n/" * 80 + "x"])
