"""Ranked lexical search with exact block skipping.

For a block of items, each document becomes a vector over the terms that the items use.
Documents are indexed in shards, each within one task: a term's posting list is
clustered by the documents' similarity (random projections of their vectors, nearest of
some members of the list) and cut into blocks, and each block has a summary, the
maximum of every coordinate over its documents. Only coordinates that an item holds
beside the list's term are kept, and a list is blocked when it is first needed.

An item takes its lists by what their terms can give at most, largest first. A document
not seen so far has none of the terms before, so what a block's summary gives for the
remaining terms bounds the score of all that is new in it: a block is skipped only if that
lies below the score of the item's 50th document so far, and the lists end where the
sum of what remains does. Both bounds are exact, and so are the results. The best so far go
from shard to shard within a task. Scores in a sixteenth of the documents are worked out
first: the 50th there is the least that any task needs to look at.

Tasks give their best documents for each item, which are merged in two steps. Statistics
(documents, terms, document frequencies) count every document.

Defined results: a null or empty text has no terms and is never found; rows of equal item
id are one item with the terms of all, a null id included; an item without terms finds
nothing; equal scores go by id, null ids last, and equal rows are found each by itself;
very long texts are read whole; other columns are ignored, whatever their names; empty
tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import Scratch, Written

TOP = 50
#: Documents of a shard and their postings at most (a document with more is a shard of its own), and documents of a block at most.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_DOCS = 4096, 2_000_000, 128
#: Distinct pairs of item and term in a block of items, about; bounds what all tasks get.
MOST_PAIRS = 50_000
#: Dimensions of the projections; one in so many documents is searched first.
DIMENSIONS, SAMPLED = 32, 16
#: Parts in which an item's candidates are merged before the last step.
MERGE_PARTS = 64

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _vectors(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, terms, counts = [], [], []
            for data in frame.pop("data"):
                words = _TERM.findall((data or b"").lower())
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                n.append(len(words))
                terms.append(np.fromiter(found, np.int32, len(found)))
                counts.append(np.fromiter(found.values(), np.int32, len(found)))
            frame["n"], frame["terms"], frame["counts"] = n, terms, counts
            yield frame

    return f


class Items:
    """A block of items over a vocabulary: their terms, the weight of each, and for each
    term all those that some item holds beside it."""

    def __init__(self, ids: list, terms: list[np.ndarray], weights: np.ndarray):
        self.ids, self.terms, self.weights = ids, terms, weights
        holders: dict[int, list[int]] = {}
        for item, one in enumerate(terms):
            for t in one.tolist():
                holders.setdefault(t, []).append(item)
        # Terms of the same items share one list, so that a long item takes no more than its own length.
        shared: dict[tuple[int, ...], np.ndarray] = {}
        self.beside = {}
        for t, own in holders.items():
            if (key := tuple(own)) not in shared:
                shared[key] = np.unique(np.concatenate([terms[i] for i in own])).astype(np.int64)
            self.beside[t] = shared[key]


class Best:
    """The best documents of an item so far."""

    def __init__(self, least: int):
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.least = least  # no lower score can be among the best

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            scores, ids, null = (np.concatenate([a, b[good]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.null, null)))
            first = np.lexsort((ids, null, -scores))[:TOP]
            self.scores, self.ids, self.null = scores[first], ids[first], null[first]
            if len(first) == TOP:
                self.least = max(self.least, int(self.scores[-1]))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Shard:
    """The index of some documents: vectors, posting lists, and their blocks."""

    def __init__(self, items: Items, ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.items, self.ids, self.null, self.lengths, self.terms, self.values = items, ids, null, lengths, terms, values
        self.starts = np.cumsum(lengths) - lengths
        docs = np.repeat(np.arange(len(ids)), lengths)
        order = np.argsort(terms, kind="stable")
        size = len(items.weights)
        self.postings = docs[order]
        sizes = np.bincount(terms, minlength=size)
        self.upto = np.concatenate([[0], np.cumsum(sizes)])
        most = np.zeros(size, np.int64)
        np.maximum.at(most, terms, values)
        self.most = most * items.weights
        self.known: dict[int, tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]] = {}
        self.room = np.zeros(size, np.int64)  # for the maxima of one block
        self.projected: np.ndarray | None = None

    def projections(self) -> np.ndarray:
        if self.projected is None:
            axes = np.random.default_rng(1).standard_normal((len(self.items.weights), DIMENSIONS), np.float32)
            out = np.zeros((len(self.ids), DIMENSIONS), np.float32)
            for a in range(0, len(self.ids), 256):  # some documents at a time bound the memory
                n = self.lengths[a : a + 256]
                at = slice(self.starts[a], self.starts[a] + n.sum())
                rows = axes[self.terms[at]] * (self.values[at] * self.items.weights[self.terms[at]]).astype(np.float32)[:, None]
                held = np.flatnonzero(n)
                if len(held):
                    out[a + held] = np.add.reduceat(rows, (np.cumsum(n) - n)[held], axis=0)
            self.projected = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)
        return self.projected

    def clustered(self, docs: np.ndarray) -> list[np.ndarray]:
        """``docs`` in blocks of similar ones: each goes to the nearest of some of them, and clusters are cut."""
        if len(docs) <= BLOCK_DOCS:
            return [docs]
        where = self.projections()[docs]
        centres = where[:: BLOCK_DOCS // 2]
        nearest = np.argmax(where @ centres.T, axis=1)
        order = np.argsort(nearest, kind="stable")
        out = []
        for one in np.split(docs[order], np.flatnonzero(np.diff(nearest[order])) + 1):
            out += [one[k : k + BLOCK_DOCS] for k in range(0, len(one), BLOCK_DOCS)]
        return out

    def blocks(self, term: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """The blocks of a term's list, and their summaries one after the other: where each starts,
        coordinates beside the term that some document of the block holds, and their maxima."""
        if term not in self.known:
            cut = self.clustered(self.postings[self.upto[term] : self.upto[term + 1]])
            beside, columns, maxima = self.items.beside[term], [], []
            for docs in cut:
                at = _ranges(self.starts[docs], self.lengths[docs])
                np.maximum.at(self.room, self.terms[at], self.values[at])
                own = beside[self.room[beside] > 0]
                columns.append(own)
                maxima.append(self.room[own])
                self.room[self.terms[at]] = 0
            starts = np.cumsum([0, *map(len, columns[:-1])])
            self.known[term] = cut, starts, np.concatenate(columns), np.concatenate(maxima)
        return self.known[term]

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of documents that hold a term each."""
        n = self.lengths[docs]
        at = _ranges(self.starts[docs], n)
        return np.add.reduceat(self.values[at] * weights[self.terms[at]], np.cumsum(n) - n)

    def search(self, terms: np.ndarray, best: Best) -> None:
        weights = self.items.weights
        terms = terms[(self.most[terms] > 0)]
        terms = terms[np.argsort(-self.most[terms], kind="stable")]
        remaining = np.cumsum(self.most[terms][::-1])[::-1]
        own = np.zeros(len(weights), np.int64)
        own[terms] = weights[terms]
        rest = own.copy()  # weights of this term and those after it
        seen = np.zeros(len(self.ids), bool)
        for k, term in enumerate(terms.tolist()):
            if remaining[k] < best.least:
                break
            cut, starts, columns, maxima = self.blocks(term)
            bounds = np.add.reduceat(maxima * rest[columns], starts)
            rest[term] = 0
            for b in np.argsort(-bounds, kind="stable").tolist():
                if bounds[b] < best.least:
                    break
                docs = cut[b][~seen[cut[b]]]
                if len(docs):
                    seen[docs] = True
                    best.add(self.scores(docs, own), self.ids[docs], self.null[docs])


def _shards(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of rows within the bounds of a shard."""
    sizes = frame["terms"].map(len).tolist()
    start, postings = 0, 0
    for k, n in enumerate(sizes):
        if k > start and (k - start == SHARD_DOCS or postings + n > SHARD_POSTINGS):
            yield frame.iloc[start:k]
            start, postings = k, 0
        postings += n
    if start < len(frame):
        yield frame.iloc[start:]


def _searched(items: Items, least: list[int], n_docs: int, n_terms: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The best documents of a task for each item."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(n) for n in least]
        for frame in frames:
            frame = frame[frame["terms"].map(len) > 0]
            for part in _shards(frame):
                null = part["doc_id"].isna().to_numpy()
                ids = part["doc_id"].fillna(0).to_numpy(np.int64)
                lengths = part["terms"].map(len).to_numpy(np.int64)
                tf = np.concatenate(part["counts"].to_list()).astype(np.int64)
                m = 100 - 50 + (50 * part["n"].to_numpy(np.int64) * n_docs) // n_terms
                values = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, lengths))
                shard = Shard(items, ids, null, lengths, np.concatenate(part["terms"].to_list()).astype(np.int64), values)
                for k, terms in enumerate(items.terms):
                    shard.search(terms, best[k])
        for k, one in enumerate(best):
            if len(one.scores):
                ids = pd.Series(one.ids, dtype="Int64").mask(one.null)
                yield pd.DataFrame({"item": k, "doc_id": ids, "score": one.scores})

    return f


def _item_blocks(items: DataFrame) -> Iterator[tuple[list, list[list[str]]]]:
    """Ids and terms of items, in blocks of about MOST_PAIRS pairs that the driver holds one at a time."""
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(f"({TERM})"))).alias("term"))
    ids, terms, pairs = [], [], 0
    for row in words.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).orderBy("item_id").toLocalIterator():
        ids.append(row.item_id)
        terms.append(row.terms)
        pairs += len(row.terms)
        if pairs >= MOST_PAIRS:
            yield ids, terms
            ids, terms, pairs = [], [], 0
    if ids:
        yield ids, terms


def _first(found: DataFrame, keys: list[str], name: str) -> DataFrame:
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    return found.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= TOP)


def _merged(found: DataFrame) -> DataFrame:
    """item, rank, doc_id and score of each item's best documents."""
    parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), MERGE_PARTS))
    return _first(_first(parts, ["item", "part"], "rank").drop("rank", "part"), ["item"], "rank")


def _search_block(docs: DataFrame, ids: list, terms: list[list[str]], scratch: Scratch) -> DataFrame:
    spark, vocabulary = docs.sparkSession, sorted({t for one in terms for t in one})
    number = {t: k for k, t in enumerate(vocabulary)}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("data"))
    made = texts.mapInPandas(_vectors({t.encode(): k for t, k in number.items()}), "doc_id long, n long, terms array<int>, counts array<int>")
    vectors = scratch(made, "vectors")
    n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block
        df[row.term] = row["count"]
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()]
    items = Items(ids, [np.array([number[t] for t in one], np.int64) for one in terms], np.array(weights, np.int64))

    def best(of: DataFrame, least: list[int]) -> DataFrame:
        return of.mapInPandas(_searched(items, least, n_docs, n_terms or 1), "item int, doc_id long, score long")

    sample = best(vectors.where(F.pmod(F.xxhash64("doc_id"), SAMPLED) == 0), [1] * len(ids))
    least = [1] * len(ids)
    for row in _merged(sample).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score")).collect():  # a row for each item
        if row.n == TOP:
            least[row["item"]] = row.score
    found = _merged(best(vectors, least))
    names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's 50 best documents."""
    with Scratch() as scratch:
        found = [Written(_search_block(docs, ids, terms, scratch), "ranked").df for ids, terms in _item_blocks(items)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


def _terms_sql(column: str) -> str:
    return f"unnest(regexp_extract_all(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}'))"


RANKED_SQL = f"""
with docs as (select doc_id, row_number() over () as row, text from documents),
words as (select row, {_terms_sql("text")} as term from docs),
lengths as (select row, count(*) as n from words group by row),
totals as (select count(*) as docs, sum(n)::bigint as terms from lengths),
wanted as (select distinct item_id, {_terms_sql("text")} as term from benchmark),
tf as (select row, term, count(*) as tf from words where term in (select term from wanted) group by all),
weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, totals group by term),
scored as (
  select item_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::bigint as score
  from wanted join weights using (term) join tf using (term) join lengths using (row), totals group by all
), placed as (
  select item_id, (row_number() over (partition by item_id order by score desc, doc_id nulls last))::int as rank, doc_id, score
  from scored join docs using (row) where score > 0
)
select item_id, rank, doc_id, score from placed where rank <= {TOP}
"""
