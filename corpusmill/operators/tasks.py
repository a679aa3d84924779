"""Ranking of files against many tasks in one scan.

The terms of a block of tasks, a bounded number, go to every Spark task, which makes one
automaton of them and finds all terms of all tasks in one walk over each text. What a file's counts
are worth to each task is one product of the counts with a matrix of weights; of each task only the
best files so far are kept. The files of all Spark tasks meet by task, in two steps.

Scores are those of ``rank.base_scores`` and ``rank.finished`` for each task by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators import rank

#: Tasks of a block at most, and their terms, about: the matrix of weights holds a number for each pair.
MOST_TASKS, MOST_TERMS = 256, 20_000
LIMIT = 200
#: Parts in which the files of a task meet first.
PARTS = 64
FOUND = "task int, path string, raw double, hits long, matched string"


class Wanted:
    """The terms of a block of tasks: literals in texts and in paths, and their weights."""

    def __init__(self, texts: list[str]):
        terms = [rank.task_terms(t) for t in texts]
        self.weights = [rank.term_weights(t) for t in terms]
        self.paths = [rank.path_terms(t) for t in terms]
        self.literals = sorted({t for one in [*self.weights, *self.paths] for t in one})

    def matrices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By literal and task: weights in texts, weights in paths, and whether it counts there at all."""
        number = {t: k for k, t in enumerate(self.literals)}
        shape = len(self.literals), len(self.weights)
        text, path, in_text, in_path = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool), np.zeros(shape, bool)
        for task, weights in enumerate(self.weights):
            for t, w in weights.items():
                text[number[t], task], in_text[number[t], task] = w, True
            for t in self.paths[task]:
                path[number[t], task], in_path[number[t], task] = rank.PATH_WEIGHT, True
        return text, path, in_text, in_path


def _automaton(literals: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for k, t in enumerate(literals):
        made.add_word(t, (k, len(t)))
    made.make_automaton()
    return made


def _counts(automaton: ahocorasick.Automaton, text: str) -> dict[int, int]:
    """Occurrences of each literal that do not overlap each other, from the left."""
    counts: dict[int, int] = {}
    last: dict[int, int] = {}
    for end, (k, size) in automaton.iter(text):
        if end - size >= last.get(k, -1):
            last[k] = end
            counts[k] = counts.get(k, 0) + 1
    return counts


class _Best:
    """The best files of each task so far: highest score first, then by path."""

    def __init__(self, tasks: int, limit: int):
        self.limit, self.rows = limit, [[] for _ in range(tasks)]
        self.least = np.zeros(tasks)

    def add(self, task: int, row: tuple) -> None:
        rows = self.rows[task]
        rows.append(row)
        if len(rows) >= 2 * self.limit + 100:
            self.cut(task)

    def cut(self, task: int) -> list[tuple]:
        rows = self.rows[task] = sorted(self.rows[task], key=lambda r: (-r[0], r[1]))[: self.limit]
        if len(rows) == self.limit:
            self.least[task] = rows[-1][0]
        return rows


def _found(wanted: Wanted, limit: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text_w, path_w, in_text, in_path = wanted.matrices()
        automaton = _automaton(wanted.literals) if wanted.literals else None
        best = _Best(len(wanted.weights), limit)
        for frame in frames:
            for path, low, low_path, entry in frame.itertuples(index=False):
                raw = np.full(len(wanted.weights), rank.ENTRYPOINT_WEIGHT if entry else 0, np.int64)
                ours, theirs = (_counts(automaton, x or "") if automaton else {} for x in (low, low_path))
                k, n = np.fromiter(ours, np.int64, len(ours)), np.fromiter(ours.values(), np.int64, len(ours))
                p, m = np.fromiter(theirs, np.int64, len(theirs)), np.fromiter(theirs.values(), np.int64, len(theirs))
                hits = n @ in_text[k] + m @ in_path[p]
                seen = in_text[k].sum(axis=0) + in_path[p].sum(axis=0)
                if p.size:  # a literal of both kinds is one match
                    both = np.intersect1d(k, p)
                    seen = seen - (in_text[both] & in_path[both]).sum(axis=0)
                raw += n @ text_w[k] + m @ path_w[p] + np.where(seen > 1, rank.BREADTH_WEIGHT * seen, 0)
                for task in np.flatnonzero((raw > 0) & (raw >= best.least)).tolist():
                    best.add(task, (float(raw[task]), path, int(hits[task]), tuple(k[in_text[k, task]].tolist()), tuple(p[in_path[p, task]].tolist())))
        for task in range(len(wanted.weights)):
            rows = best.cut(task)
            if rows:
                matched = [",".join(sorted({wanted.literals[i] for i in (*r[3], *r[4])})) for r in rows]
                yield pd.DataFrame({"task": task, "path": [r[1] for r in rows], "raw": [r[0] for r in rows], "hits": [r[2] for r in rows], "matched": matched})

    return f


def _blocks(tasks: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of tasks (task_id, text), in blocks that the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for row in tasks.select("task_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("task_id").toLocalIterator():
        n = len(row.text) // 4  # about a term for four characters
        if ids and (len(ids) == MOST_TASKS or size + n > MOST_TERMS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.task_id)
        texts.append(row.text)
        size += n
    if ids:
        yield ids, texts


def ranked(tasks: DataFrame, files: DataFrame, text: Column, entry: Column | None = None, limit: int = LIMIT) -> DataFrame:
    """task_id, path, raw, score (1 to 1000 of the task's best), hits and matched (terms, joined by commas):
    the best files (path and what ``text`` needs) of each task (task_id, text; one row each)."""
    rows = files.select("path", F.lower(text).alias("low"), F.lower("path").alias("low_path"), (F.lit(False) if entry is None else entry).alias("entry"))
    order = [F.desc("raw"), "path"]

    def first(found: DataFrame, *keys: str) -> DataFrame:
        return found.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= limit).drop("nth")

    out = []
    for ids, texts in _blocks(tasks):
        found = rows.mapInPandas(_found(Wanted(texts), limit), FOUND)
        found = first(first(found.withColumn("part", F.pmod(F.xxhash64("path"), PARTS)), "task", "part").drop("part"), "task")
        names = tasks.sparkSession.createDataFrame(list(enumerate(ids)), f"task int, task_id {tasks.schema['task_id'].dataType.simpleString()}")
        best = F.max("raw").over(Window.partitionBy("task"))
        score = F.greatest(F.lit(1), F.least(F.lit(1000), F.floor(F.col("raw") / best * 1000 + 0.5))).cast("long")
        out.append(found.withColumn("score", score).join(F.broadcast(names), "task").select("task_id", "path", "raw", "score", "hits", "matched"))
    if not out:
        return tasks.sparkSession.createDataFrame([], f"task_id {tasks.schema['task_id'].dataType.simpleString()}, path string, raw double, score long, hits long, matched string")
    return reduce(DataFrame.unionByName, out)
