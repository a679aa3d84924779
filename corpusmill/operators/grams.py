"""A search index of trigrams over lower-cased texts, kept in segments.

A segment holds texts in the order of their ids and, for every trigram, which of them hold it: rows of a
trigram, a block of ids and the offsets there, built within the task that reads the texts, so that no list
grows without bound and nothing but the finished lists is shuffled, once (sorted by trigram, so that a lookup
reads few pages; offsets are delta-coded by Parquet). A block that two tasks share, or that holds more than a task
keeps, has several rows for a trigram. A search takes the rarest of the trigrams that a
match must hold, intersects their lists block by block, and looks for the pattern
itself in those texts alone: few candidates are pushed to the scan as ranges of ids, which skips
the pages between them; many are joined. Patterns without a trigram read all texts.

Changed files go to a further segment, beside a list of the older ids that they replace or that are gone;
``compacted`` makes one segment of all."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import search
from corpusmill.sources.shared import delete, folders

#: Texts of a block; ids in a row within a task share blocks.
BLOCK = 4096
#: Trigrams intersected at most; texts of a page; ranges pushed to the scan at most.
RAREST, PAGE_ROWS, MOST_RANGES = 4, 64, 200
#: Pairs of a trigram and a text that a task keeps; lists that it gives back at once; ids that are broadcast at most.
MOST_HELD, LISTS, MOST_BROADCAST = 4_000_000, 20_000, 1_000_000
POSTINGS = "gram string, block long, offsets array<int>, n long"
_META, _MANY = set("\\^$.|?*+()[]{}"), set("*?{")


def literals(pattern: str) -> list[str]:
    """Strings that every match of a regular expression holds: runs of plain characters
    outside groups, classes and alternatives, without what may be repeated no times."""
    runs, run, depth, k = [], "", 0, 0
    while k < len(pattern):
        c, width, plain = pattern[k], 1, None
        if c == "\\":
            plain, width = (pattern[k + 1] if pattern[k + 1 : k + 2] and not pattern[k + 1].isalnum() else None), 2
        elif c == "[":
            end = pattern.find("]", k + 2 + pattern.startswith("^", k + 1))
            if end < 0 or "[" in pattern[k + 1 : end]:
                return []
            width = end + 1 - k
        elif c == "{":
            width = max(1, pattern.find("}", k) + 1 - k)
        elif c == "|":
            return []
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c not in _META:
            plain = c
        after = pattern[k + width : k + width + 1]
        if plain and not depth and after not in _MANY:
            run += plain
            if after == "+":
                runs, run = [*runs, run], ""
        else:
            runs, run = [*runs, run], ""
        k += width
        if depth and c == "(" and pattern.startswith("?", k):  # flags and look-around
            return []
    return [r for r in [*runs, run] if r]


def grams_of(pattern: str, regex: bool = False) -> list[str]:
    """Trigrams that every text with a match holds. Only plain ASCII ones: others may change when lowered."""
    parts = literals(pattern) if regex else [pattern]
    found = {p[k : k + 3] for p in (x.lower() for x in parts) for k in range(len(p) - 2)}
    return sorted(g for g in found if g.isascii() and "\n" not in g and "\r" not in g)


def _coded(low: str | None) -> np.ndarray:
    """The distinct trigrams of a text, three code points of 21 bits each."""
    points = np.frombuffer((low or "").encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])


def _told(codes: np.ndarray) -> list[str]:
    points = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    return [text[k : k + 3] for k in range(0, len(text), 3)]


def _postings(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at: list[int] = []
        block, n = None, 0

        def lists() -> Iterator[pa.RecordBatch]:
            if not n:
                return
            codes = np.concatenate(held)
            order = np.argsort(codes, kind="stable")
            codes, offsets = codes[order], np.repeat(np.array(at, np.int32), [len(x) for x in held])[order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            names, ends = _told(codes[first]), np.append(first, len(codes)).astype(np.int32)
            for k in range(0, len(first), LISTS):
                edge = ends[k : k + LISTS + 1]
                found = pa.ListArray.from_arrays(edge - edge[0], offsets[edge[0] : edge[-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[k : k + LISTS], pa.string()), pa.array(np.full(len(found), block, np.int64)), found, pa.array(np.diff(edge).astype(np.int64))],
                    ["gram", "block", "offsets", "n"],
                )

        for batch in batches:
            for number, low in zip(batch.column("id").to_pylist(), batch.column("low"), strict=True):
                if block != number // size or n > MOST_HELD:
                    yield from lists()
                    held, at, block, n = [], [], number // size, 0
                held.append(_coded(low.as_py()))
                at.append(number % size)
                n += len(held[-1])
        yield from lists()

    return f


class GramIndex:
    """The index in a folder that driver and executors share, always of the same block size."""

    def __init__(self, spark: SparkSession, folder: str, block: int = BLOCK):
        self.spark, self.folder, self.block = spark, folder, block

    def segments(self) -> list[int]:
        return sorted(int(x.removeprefix("segment-")) for x in folders(self.spark, self.folder) if x.startswith("segment-"))

    def _read(self, kind: str, segment: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/segment-{segment}/{kind}")

    def _live(self, segment: int) -> DataFrame | None:
        """Ids of the segment that later ones replace; null if there are none."""
        later = [self._read("dead", s).where(F.col("segment") == segment).select("id") for s in self.segments() if s > segment]
        return reduce(DataFrame.unionByName, later) if later else None

    def add(self, files: DataFrame, gone: DataFrame | None = None) -> None:
        """Files (path, content) that are new or changed, and paths of files that are gone."""
        older = self.segments()
        number = max(older, default=0) + 1
        top = f"{self.folder}/segment-{number}"
        texts = files.select(F.monotonically_increasing_id().alias("id"), "path", "content")
        texts.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.folder}/next/texts")
        stored = self.spark.read.parquet(f"{self.folder}/next/texts")
        replaced = stored.select("path") if gone is None else stored.select("path").unionByName(gone.select("path"))
        dead = [self._read("texts", s).join(replaced, "path", "left_semi").select(F.lit(s).alias("segment"), "id") for s in older]
        none = self.spark.range(0).select(F.lit(0).alias("segment"), "id")
        reduce(DataFrame.unionByName, dead, none).write.parquet(f"{self.folder}/next/dead")
        lists = stored.select("id", F.lower("content").alias("low")).mapInArrow(_postings(self.block), POSTINGS)
        # By hash, as ranges are sampled first, which makes all lists twice.
        lists.repartition("gram").sortWithinPartitions("gram", "block").write.option("parquet.writer.version", "v2").parquet(f"{self.folder}/next/postings")
        where = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p)
        # A segment that is not whole is never seen: it gets its name last.
        where(top).getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(where(f"{self.folder}/next"), where(top))

    def files(self) -> DataFrame:
        """path and content of all files in the index."""
        every = [self._candidates(s, []) for s in self.segments()]
        return reduce(DataFrame.unionByName, every).select("path", "content")

    def compacted(self, folder: str) -> GramIndex:
        """The index as one segment in another folder."""
        other = GramIndex(self.spark, folder, self.block)
        other.add(self.files())
        return other

    def _ids(self, segment: int, grams: list[str]) -> tuple[DataFrame, int]:
        """Ids of a segment's texts that hold all of the rarest of the trigrams, and how many there may be.
        The lists of a trigram in a block are one, in however many rows they are kept."""
        postings = self._read("postings", segment).where(F.col("gram").isin(grams))
        sizes = {r.gram: r.n for r in postings.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each asked trigram
        rarest = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:RAREST]
        lists = postings.where(F.col("gram").isin(rarest)).groupBy("block").agg(
            *[F.flatten(F.collect_list(F.when(F.col("gram") == g, F.col("offsets")))).alias(f"list_{k}") for k, g in enumerate(rarest)]
        )
        both = reduce(F.array_intersect, [F.col(f"list_{k}") for k in range(len(rarest))])
        met = lists.select("block", F.explode(both).alias("offset"))
        return met.select((F.col("block") * self.block + F.col("offset")).alias("id")), sizes.get(rarest[0], 0)

    def _candidates(self, segment: int, grams: list[str]) -> DataFrame:
        """id, path and content of the segment's texts that may match, replaced ones left out."""
        texts, dead = self._read("texts", segment), self._live(segment)
        if grams:
            ids, most = self._ids(segment, grams)
            ids = ids if dead is None else ids.join(dead, "id", "left_anti")
            few = [r.id for r in ids.orderBy("id").limit(MOST_RANGES * PAGE_ROWS + 1).collect()]
            runs: list[list[int]] = []
            for one in few:
                if runs and one - runs[-1][1] <= PAGE_ROWS:
                    runs[-1][1] = one
                else:
                    runs.append([one, one])
            if len(few) <= MOST_RANGES * PAGE_ROWS and len(runs) <= MOST_RANGES:
                ranges = [F.col("id").between(a, b) for a, b in runs] or [F.lit(False)]
                return texts.where(reduce(lambda a, b: a | b, ranges)).where(F.col("id").isin(few))
            return texts.join(F.broadcast(ids) if most <= MOST_BROADCAST else ids, "id", "left_semi")
        return texts if dead is None else texts.join(dead, "id", "left_anti")

    def candidates(self, pattern: str, regex: bool = False) -> DataFrame:
        """path and content of the texts in which a search looks for the pattern."""
        grams = grams_of(pattern, regex)
        return reduce(DataFrame.unionByName, [self._candidates(s, grams) for s in self.segments()]).select("path", "content")

    def hits(self, pattern: str, regex: bool = False, case_sensitive: bool = False, context: int = 0) -> DataFrame:
        """As ``search.hits`` over all files, by way of the candidates."""
        return search.hits(self.candidates(pattern, regex), pattern, regex, case_sensitive, context)

    def drop(self) -> None:
        delete(self.spark, self.folder)
