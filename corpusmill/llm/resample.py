"""Resampling documents towards a target distribution by importance.

Features are runs of one to three words, hashed into buckets by their CRC-32. Bucket
counts of the documents and of the target texts give each bucket a gain, an integer log
ratio; a document's weight is the sum of its features' gains, looked up in an array of
a fixed number of entries, the only thing that all tasks get. A digest of the id adds Gumbel noise, so that
the highest scores are a draw without replacement in proportion to the weights.

Checksums are worked out for all words of a batch at once, a byte of each at a time; those of
two and three words follow from them, since the checksum of joined strings is linear.

The cutoff of the draw is bracketed by a quantile sketch. Exact counts of what lies above
and inside the bracket validate it, or widen it until it holds the cutoff; only the rows
inside are sorted, over many tasks. The drawn rows are numbered by ranges of the order.

Defined results: a null or empty text has no words, no features and weight 0; letters beyond
ASCII are words' letters as they are; ties go to the smaller id, null ids last, and equal
rows are drawn each by itself; a null id has the noise of the text ``42:``; a target without
texts counts nothing; very long texts and words are taken whole; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import Scratch, Written, in_ranges

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Of the quantile sketch: ranks are off by a share of 1 / ACCURACY at most.
ACCURACY = 10_000
#: Bytes of text whose words are worked on at once (a longer text is taken whole).
BATCH_BYTES = 1 << 21
#: Longest words whose checksums are worked out side by side.
SHORT = 40

_POLYNOMIAL = 0xEDB88320  # of CRC-32


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), out >> np.uint32(1))
    return out


_CRC = _crc_table()
_LOWER = np.array([b if b >= 128 or chr(b).isalnum() else 0 for b in bytes(range(256)).lower()], np.uint8)
_ALL = np.uint32(0xFFFFFFFF)


def _stepped(state: np.ndarray, byte) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def _applied(tables: np.ndarray, base, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit numbers, given by its values for each of their four bytes."""
    out = tables[base + (x & np.uint32(255))]
    for k in (1, 2, 3):
        out = out ^ tables[base + (k * 256) + ((x >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def _zeros_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What 0 to SHORT zero bytes after it make of a checksum, and what 2^k of them do."""
    one = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    few = [one]
    for _ in range(SHORT):
        few.append(_stepped(few[-1], np.uint32(0)))
    powers = [few[1]]
    for _ in range(40):
        powers.append(_applied(powers[-1], 0, powers[-1]))
    return np.concatenate(few), powers


_FEW, _POWERS = _zeros_tables()


def _followed(crc: np.ndarray, lengths: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The checksum of a string and a space (with checksum ``crc`` without it) and a word of that length and checksum."""
    crc = ~_stepped(~crc, np.uint32(32))
    out = _applied(_FEW, np.minimum(lengths, SHORT) * 1024, crc)
    for i in np.flatnonzero(lengths > SHORT):
        x, n = crc[i : i + 1], int(lengths[i])
        for k in range(n.bit_length()):
            if n >> k & 1:
                x = _applied(_POWERS[k], 0, x)
        out[i] = x[0]
    return out ^ after


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and for every feature of them the text it is in and its checksum."""
    low = _LOWER[np.frombuffer(b"\0".join(texts), np.uint8)]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, starts, side="right")

    short = np.minimum(lengths, SHORT + 1).astype(np.uint8)
    order = np.argsort(255 - short, kind="stable")
    at, sizes = starts[order], np.bincount(short, minlength=SHORT + 2)
    longer = len(starts) - np.cumsum(sizes)  # words of more than p bytes
    state = np.full(len(starts), _ALL)
    for p in range(SHORT):
        if not (n := int(longer[p])):
            break
        state[:n] = _stepped(state[:n], low[at[:n] + p])
    one = np.empty_like(state)
    one[order] = ~state
    for i in np.flatnonzero(lengths > SHORT):
        one[i] = zlib.crc32(low[starts[i] : starts[i] + lengths[i]])

    docs, crcs, last = [doc], [one], one
    for k in (1, 2):
        last = _followed(last[:-1], lengths[k:], one[k:]) if len(one) > k else one[:0]
        same = doc[:-k] == doc[k:]
        docs.append(doc[:-k][same])
        crcs.append(last[same])
    return np.bincount(doc, minlength=len(texts)), np.concatenate(docs), np.concatenate(crcs)


def _batches(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    batch, size = [], 0
    for text in texts:
        batch.append(text or b"")
        size += len(batch[-1]) + 1
        if size >= BATCH_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _counted(buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Bucket counts of all texts of a task, a row for each bucket."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for frame in frames:
            for batch in _batches(frame["data"]):
                total += np.bincount(features(batch)[2] % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    return f


def _weighed(gains: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words, weights = [], []
            for batch in _batches(frame.pop("data")):
                n, doc, crc = features(batch)
                words.append(n)
                # Sums of integers stay exact in doubles below 2^53.
                weights.append(np.bincount(doc, gains[crc % np.uint32(len(gains))], len(batch)).astype(np.int64))
            n = np.concatenate(words) if words else np.zeros(0, np.int64)
            frame["n_words"], frame["n_features"] = n, n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            frame["weight"] = np.concatenate(weights) if weights else n
            yield frame

    return f


def _binary() -> Column:
    return F.col("text").cast("string").cast("binary").alias("data")


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: as many numbers as there are buckets."""
    counts = texts.select(_binary()).mapInPandas(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket, smoothed by one."""
    size, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1.0) * (all_s + size) / ((s + 1.0) * (all_t + size))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.float64)


def noise(seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) with u from a digest of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def order() -> list[Column]:
    """Highest scores first, ties by id; rows equal in both by number."""
    return [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("row")]


def numbered(df: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """``df`` with its place (from 1) by ``order``: within ranges of the order, and over their sizes."""
    ranges = in_ranges(df, "__range", *order())
    scratch.tables.append(ranges)
    sizes = ranges.df.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    sizes = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order()))
    return ranges.df.join(sizes, "__range").withColumn(name, F.col("__before") + within).drop("__range", "__before")


def bracket(scores: DataFrame, k: int, n: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """Bounds that hold the ``k``-th highest of ``n`` scores, and how many lie above them. The sketch's
    guesses, each four times as wide as the one before, are tried until exact counts confirm one."""
    share, margins, m = 1 - k / n, [], 2 / accuracy
    while m < 1:
        margins.append(m)
        m *= 4
    points = [p for m in margins for p in (max(0.0, share - m), min(1.0, share + m))]
    row = scores.agg(F.percentile_approx("score", points, accuracy).alias("points"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    guesses = [(row.points[2 * i], row.points[2 * i + 1]) for i in range(len(margins))] if margins else []
    for low, high in [*guesses, (row.low, row.high)]:
        above, inside = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above
    raise ValueError("fewer scores than asked for")


def drawn(scores: DataFrame, k: int, n: int, scratch: Scratch, accuracy: int = ACCURACY) -> Column:
    """Whether a row is among the ``k`` first by ``order``."""
    if not k:
        return F.lit(False)
    low, high, above = bracket(scores, k, n, accuracy)
    inside = scores.where(F.col("score").between(low, high)).select("score", "doc_id", "row")
    last = numbered(inside, "place", scratch).where(F.col("place") == k - above).first()
    same = F.col("doc_id").eqNullSafe(last.doc_id) & (F.col("row") <= last.row)
    sooner = F.col("doc_id").isNotNull() if last.doc_id is None else F.coalesce(F.col("doc_id") < last.doc_id, F.lit(False))
    return (F.col("score") > last.score) | ((F.col("score") == last.score) & (sooner | same))


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, accuracy: int = ACCURACY) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _binary())
    with Scratch() as scratch:
        made = texts.mapInPandas(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
        made = made.withColumn("score", F.col("weight") + noise(seed)).withColumn("row", F.monotonically_increasing_id())
        scores = scratch(made, "scores")
        able = scores.where(F.col("n_words") >= least_words)
        n = able.count()
        chosen = (F.col("n_words") >= least_words) & drawn(able, percent * n // 100, n, scratch, accuracy)
        columns = ["doc_id", "n_features", "weight", "score"]
        first = numbered(scores.where(chosen), "rank", scratch).select(*columns, F.col("rank").cast("long").alias("rank"))
        return Written(first.unionByName(scores.where(~chosen).select(*columns, F.lit(None).cast("long").alias("rank"))), "importance").df


def apply(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The documents whose ids are drawn, with their columns; rows that share an id share its fate."""
    ids = importance(docs, target, percent, least_words, seed).where("rank is not null").select(F.col("doc_id").alias("__id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__id"]), "left_semi")


IMPORTANCE_SQL = r"""
with table_of as (
  select list(v order by i) as crc from (select i, list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i))
), texts as (
  select 0 as side, doc_id as id, row_number() over () as row, text from documents union all select 1, item_id, row_number() over (), text from benchmark
), words as (
  select side, row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts
), runs as (
  select side, row, unnest(flatten([w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])])) as f from words
), known as (
  select f, flatten(list_transform(string_split(f, ''), lambda c: case when unicode(c) < 128 then [unicode(c)]
    when unicode(c) < 2048 then [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]
    when unicode(c) < 65536 then [224 + (unicode(c) >> 12), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)]
    else [240 + (unicode(c) >> 18), 128 + ((unicode(c) >> 12) & 63), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)] end)) as b from (select distinct f from runs)
), placed as (
  select f, xor(list_reduce(list_concat([4294967295], b::bigint[]), lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 as bucket from known, table_of
), found as (select side, row, bucket, count(*) as n from runs join placed using (f) group by all
), counts as (
  select b as bucket, coalesce(sum(n) filter (side = 0), 0)::double as s, coalesce(sum(n) filter (side = 1), 0)::double as t from range(10000) r(b) left join found on bucket = b group by b
), gains as (
  select bucket, floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000))))::bigint as gain from counts
), weights as (select row, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from found join gains using (bucket) where side = 0 group by row
), scored as (
  select id as doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from texts join words using (side, row) left join weights using (row) where side = 0
), placed_docs as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) as place, 5 * count(*) filter (n_words >= 20) over () // 100 as most from scored
)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= most then place end as rank from placed_docs
"""
