"""Exact duplicates by recipes of content-defined chunks.

A rolling hash over sixteen bytes cuts a text into chunks of about a kilobyte where its
top bits are zero, so that equal passages of different texts are cut alike. A text's
recipe is the ordered list of its chunks' identifiers, and texts are equal when their
recipes are; only recipes, a few bytes a kilobyte, are grouped and joined.

An identifier is a 64-bit key of the chunk, verified: each distinct chunk goes once from a
task (equal chunks of a task before it leaves) to the place where equal keys meet, and chunks
that differ under one key are numbered there. No task, and so no row that it moves, ever
holds a whole document after it was cut. Only if some key is shared (seldom: some hundred
keys among 10^11 chunks) are the recipes written anew with the numbers in them.

Groups of many rows are split over parts of the join that hands each row its group.

Defined results: a null text equals an empty one, whose recipe is empty; texts are compared
as bytes; among rows of equal id and text one stays; a null id is less than all others; very
long texts are cut by the same rule, at 8192 bytes at the latest; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import Scratch, Written, hot_keys, spread_join

#: Bytes of a chunk: at least (but for a text's last), about, and at most.
LEAST, ABOUT_BITS, MOST = 256, 10, 8192
KEY_BITS = 64
#: Numbered chunks that are broadcast at most: 8 MB of them.
MOST_BROADCAST = 1000

_WINDOW_STEPS = 4  # doublings: 16 bytes
#: A number for each byte value, spread by a multiplication.
_GEAR = (((np.arange(256, dtype=np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)).astype(np.uint32)


def rolling(data: bytes) -> np.ndarray:
    """The hash of the sixteen bytes that end at each position (of fewer at the start):
    the sum of their numbers, each doubled once for every byte after it."""
    out = _GEAR[np.frombuffer(data, np.uint8)]
    for k in range(_WINDOW_STEPS):
        width = 1 << k
        if width < len(out):
            out[width:] += out[:-width] << np.uint32(width)
    return out


def cuts(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end."""
    n, start, out = len(data), 0, []
    if n > LEAST:
        for end in (np.flatnonzero(rolling(data) >> np.uint32(32 - ABOUT_BITS) == 0) + 1).tolist():
            while end - start > MOST:
                start += MOST
                out.append(start)
            if end - start >= LEAST:
                start = end
                out.append(start)
    while n - start > MOST:
        start += MOST
        out.append(start)
    if start < n:
        out.append(n)
    return out


def parts(data: bytes) -> list[bytes]:
    out, start = [], 0
    for end in cuts(data):
        out.append(data[start:end])
        start = end
    return out


def _key(part: bytes, bits: int) -> int:
    """The lowest ``bits`` of the chunk's hash, as a signed 64-bit number."""
    found = xxhash.xxh3_64_intdigest(part) & ((1 << bits) - 1)
    return found - (1 << 64) if found >> 63 else found


def _recipes(bits: int, contents: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cut = [parts(data or b"") for data in frame.pop("data")]
            frame["recipe"] = [[_key(p, bits) for p in one] for one in cut]
            if contents:
                frame["contents"] = cut
            yield frame

    return f


def _distinct_parts(bits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """key and content of every chunk, once for each batch of texts."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = list(dict.fromkeys(p for data in frame["data"] for p in parts(data or b"")))
            if found:
                yield pd.DataFrame({"key": [_key(p, bits) for p in found], "content": found})

    return f


def recipes(docs: DataFrame, scratch: Scratch, key_bits: int = KEY_BITS) -> DataFrame:
    """row (a number of its own), doc_id, text_sha256 and recipe (array of longs) of
    every document. Recipes are equal if and only if the texts are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), text.cast("binary").alias("data"))
    found = texts.select("data").mapInPandas(_distinct_parts(key_bits), "key long, content binary").distinct()
    shared = scratch(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    plain = "doc_id long, text_sha256 string, recipe array<long>"
    if shared.isEmpty():
        made = texts.mapInPandas(_recipes(key_bits, contents=False), plain)
        return scratch(made.withColumn("row", F.monotonically_increasing_id()), "recipes")
    # The number of a chunk among those of its key; the first needs none.
    number = F.row_number().over(Window.partitionBy("key").orderBy("content")) - 1
    numbered = scratch(found.join(shared, "key").withColumn("number", number).where("number > 0"), "numbered")
    if numbered.count() <= MOST_BROADCAST:
        numbered = F.broadcast(numbered)
    made = texts.mapInPandas(_recipes(key_bits, contents=True), f"{plain}, contents array<binary>")
    rows = made.withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "doc_id", "text_sha256", F.posexplode_outer(F.arrays_zip("recipe", "contents")).alias("at", "part"))
    each = each.select("row", "doc_id", "text_sha256", "at", F.col("part.recipe").alias("key"), F.col("part.contents").alias("content"))
    each = each.join(numbered, ["key", "content"], "left")
    entry = F.when(F.col("at").isNotNull(), F.struct("at", "key", F.coalesce("number", F.lit(0)).cast("long").alias("number")))
    listed = each.groupBy("row", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    recipe = F.flatten(F.transform("entries", lambda e: F.array(e["key"], e["number"])))
    return scratch(listed.select("row", "doc_id", "text_sha256", recipe.alias("recipe")), "recipes")


def exact_duplicates(docs: DataFrame, key_bits: int = KEY_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document: of the rows
    of equal text that with the largest id stays."""
    with Scratch() as scratch:
        made = recipes(docs, scratch, key_bits).withColumn("digest", F.xxhash64("recipe"))
        best = F.max(F.struct("doc_id", "row"))
        groups = scratch(made.groupBy("digest", "recipe").agg(best.alias("best"), F.count("*").alias("n")), "groups")
        hot = hot_keys(groups, ["digest", "recipe"], scratch)
        joined = spread_join(made, groups, ["digest", "recipe"], "row", hot)
        result = joined.select(
            "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"
        )
        return Written(result, "exact").df


def apply(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns."""
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    both = docs.withColumn("__own", sha)
    both = both.join(kept, both["doc_id"].eqNullSafe(kept["__id"]) & (both["__own"] == kept["__sha"]), "left_semi")
    return both.dropDuplicates(["doc_id", "__own"]).drop("__own")


EXACT_SQL = """
with texts as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from texts
"""
