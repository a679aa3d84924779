"""Walking a folder tree as a Spark data source: ignored folders are never listed.

The driver lists the upper folders only, and only for the folders in them, until there are enough to deal out; each
partition walks its own down to the files. Ignore files are applied on the way down, the deepest rule that
matches last, so that what lies in an ignored folder is neither listed nor judged. Filters on the path's start, end or value and on the
size are pushed to the walk, where a start also decides which folders are listed; files are opened only if
the schema asks for what is in them.

The tree must be mounted on driver and executors; ``corpus.read_folder`` reads stores that only Spark reaches, without pruning.
Symbolic links are not followed. Paths are relative to the root, with forward slashes. A file that goes
meanwhile is left out; one that is no UTF-8 text has its wrong bytes replaced."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)

from corpusmill.operators.scan import ignore_regex
from corpusmill.sources.corpus import SNIFFED_BYTES

#: Columns; ``folder`` rows (with the option ``folders``) tell which folders were listed.
SCHEMA = "path string, folder boolean, size long, mtime double, binary boolean, content string"
#: Folders to deal out that the driver looks for, and partitions at most.
WANTED, MOST_PARTITIONS = 64, 4096

#: Compiled rules of one ignore file and the folder they hold for.
Layer = tuple[str, list[tuple[re.Pattern, bool]]]


@dataclass
class Slice(InputPartition):
    """Folders to walk: path, layers above it, and whether to go below it."""

    folders: list[tuple[str, list[Layer], bool]] = field(default_factory=list)


def ignored(path: str, layers: list[Layer]) -> bool:
    """Whether the last rule that matches a path (of a folder: with a slash at its end) ignores it."""
    verdict = False
    for base, rules in layers:
        rest = path[len(base) + 1 :] if base else path
        for pattern, negated in rules:
            if pattern.search(rest):
                verdict = not negated
    return verdict


def _layer(root: str, folder: str, name: str) -> list[Layer]:
    try:
        with open(os.path.join(root, folder, name), encoding="utf-8", errors="replace") as f:
            found = [x for x in map(ignore_regex, f.read().replace("\r\n", "\n").split("\n")) if x]
    except OSError:
        return []
    return [(folder, [(re.compile(regex), negated) for regex, negated in found])] if found else []


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.root, self.columns = options["path"].removeprefix("file://"), columns
        self.name, self.folders = options.get("ignore", ".gitignore"), options.get("folders", "false") == "true"
        self.starts: list[str] = []
        self.ends: list[str] = []
        self.equals: list[str] = []
        self.least, self.most = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            at = getattr(f, "attribute", None)
            if self.folders:  # their rows have no size, and are asked for as they are
                yield f
            elif isinstance(f, StringStartsWith) and at == ("path",):
                self.starts.append(f.value)
            elif isinstance(f, StringEndsWith) and at == ("path",):
                self.ends.append(f.value)
            elif isinstance(f, EqualTo) and at == ("path",):
                self.equals.append(f.value)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and at == ("size",):
                most = f.value - isinstance(f, LessThan)
                self.most = most if self.most is None else min(self.most, most)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and at == ("size",):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            else:
                yield f

    def wanted(self, folder: str) -> bool:
        """Whether paths that pass the filters may lie in a folder (path with a slash at its end)."""
        return all(folder.startswith(s) or s.startswith(folder) for s in self.starts) and all(e.startswith(folder) for e in self.equals)

    def listed(self, folder: str, layers: list[Layer]) -> tuple[list[str], list[os.DirEntry], list[Layer]]:
        """Folders and files in a folder that are not ignored, by name, and the layers that hold in it."""
        layers = layers + _layer(self.root, folder, self.name)
        below, files = [], []
        try:
            entries = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
        except OSError:
            return [], [], layers
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_dir(follow_symlinks=False):
                if self.wanted(path + "/") and not ignored(path + "/", layers):
                    below.append(path)
            elif entry.is_file(follow_symlinks=False) and not ignored(path, layers):
                files.append(entry)
        return below, files, layers

    def partitions(self) -> list[Slice]:
        deep, shallow = [("", [])], []
        while deep and len(deep) < WANTED:
            below = []
            for folder, layers in deep:
                inner, _, own = self.listed(folder, layers)
                shallow.append((folder, layers, False))
                below += [(x, own) for x in inner]
            deep = below
        every = [(folder, layers, True) for folder, layers in deep] + shallow
        n = min(MOST_PARTITIONS, len(every))
        return [Slice(every[k::n]) for k in range(n)]

    def read(self, part: Slice) -> Iterator[tuple]:
        todo = list(part.folders)
        while todo:
            folder, layers, deep = todo.pop()
            below, files, layers = self.listed(folder, layers)
            if self.folders:
                yield self.row({"path": folder + "/", "folder": True})
            if deep:
                todo += [(x, layers, True) for x in reversed(below)]
            for entry in files:
                path = f"{folder}/{entry.name}" if folder else entry.name
                if all(map(path.startswith, self.starts)) and all(map(path.endswith, self.ends)) and all(path == e for e in self.equals):
                    try:
                        yield from self.file(path, entry)
                    except OSError:
                        continue

    def file(self, path: str, entry: os.DirEntry) -> Iterator[tuple]:
        seen = entry.stat(follow_symlinks=False)
        if seen.st_size < self.least or (self.most is not None and seen.st_size > self.most):
            return
        values = {"path": path, "folder": False, "size": seen.st_size, "mtime": seen.st_mtime * 1000}
        if "binary" in self.columns or "content" in self.columns:
            with open(entry.path, "rb") as f:
                data = f.read() if "content" in self.columns else f.read(SNIFFED_BYTES)
            values["binary"] = b"\0" in data[:SNIFFED_BYTES]
            values["content"] = None if values["binary"] else data.decode("utf-8", "replace")
        yield self.row(values)

    def row(self, values: dict) -> tuple:
        return tuple(values.get(c) for c in self.columns)


class Tree(DataSource):
    """``spark.read.format("tree")`` with the options ``path``, ``ignore`` (name of ignore
    files) and ``folders`` (also a row for each folder that is listed). Give a schema with some of SCHEMA's columns to read those alone."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options), schema.names)


def read_tree(spark: SparkSession, root: str, columns: tuple[str, ...] = ("path", "size", "mtime", "binary", "content"), folders: bool = False) -> DataFrame:
    """The files below a folder that no ignore file leaves out, with some of SCHEMA's columns."""
    spark.dataSource.register(Tree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    return spark.read.format("tree").schema(", ".join(f"{c} {kinds[c]}" for c in columns)).option("path", root).option("folders", str(folders).lower()).load()
