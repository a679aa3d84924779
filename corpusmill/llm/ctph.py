"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes marks chunk boundaries where its remainder by the
block size is the block size less one, so that an edit moves only the boundaries near
it. Each chunk gives one base-64 character of its checksum, 64 at most: the last covers
all that is left, so that signatures and their comparison are bounded whatever the text
(a run of one character may end a chunk at every byte). A fingerprint is
``block:signature:signature at twice the block``. The block size is the least of
3 * 2^k whose signature should fit 64 characters, halved while the signature is
shorter than half of that. Fingerprints are compared at equal block sizes by edit
distance (bit-parallel), and only if their signatures share a run of ``RUN``
characters (of half the shorter one, if that is less) or are equal.

Texts meet their neighbours by one range shuffle on descending id and digest, so that
rows of one id are spread too. Each task streams through its sorted range and hands on
its first and its last text; these, two a range, are paired in a second small step.

Defined results: a null text is empty, and an empty text has the fingerprint ``3::``;
equal texts have equal fingerprints and likeness 1; rows of equal id follow each other
by digest of their texts, null ids last; a single document is its own neighbour; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import Written

WINDOW, LEAST_BLOCK, MOST_CHARS, RUN = 7, 3, 64, 4
#: Documents in one range of ids, about; the number of ranges grows with the input.
RANGE_DOCS = 1024
#: Ranges at most; bounds the rows that put the ranges in order.
MOST_RANGES = 1 << 16

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def rolling(data: bytes) -> np.ndarray:
    """A hash of the seven bytes that end at each position."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = np.zeros(len(raw), np.uint32)
    for k in range(min(WINDOW, len(raw))):
        out[k:] += (raw[: len(raw) - k] + np.uint32(1)) * np.uint32(pow(2_654_435_761, k + 1, 1 << 32))
    return (out ^ (out >> np.uint32(15))) * np.uint32(2_246_822_519) >> np.uint32(3)


def _signature(data: bytes, rolled: np.ndarray, block: int) -> str:
    ends = (np.flatnonzero(rolled % np.uint32(block) == block - 1)[: MOST_CHARS - 1] + 1).tolist()
    if not ends or ends[-1] != len(data):
        ends.append(len(data))
    view, start, out = memoryview(data), 0, []
    for end in ends:
        out.append(_ALPHABET[zlib.crc32(view[start:end]) & 63])
        start = end
    return "".join(out)


def fingerprint(data: bytes) -> str:
    if not data:
        return f"{LEAST_BLOCK}::"
    block = LEAST_BLOCK
    while block * MOST_CHARS < len(data):
        block *= 2
    rolled = rolling(data)
    while True:
        one = _signature(data, rolled, block)
        if len(one) >= MOST_CHARS // 2 or block == LEAST_BLOCK:
            return f"{block}:{one}:{_signature(data, rolled, block * 2)}"
        block //= 2


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of its matrix at a time in the bits of integers."""
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        along, across = eq | down, (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(across | up)), up & across
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(along | plus)), plus & along
    return score


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    run = min(RUN, max(2, min(len(a), len(b)) // 2))
    runs = {a[k : k + run] for k in range(len(a) - run + 1)}
    if not any(b[k : k + run] in runs for k in range(len(b) - run + 1)):
        return 0.0
    return 1 - edit_distance(a, b) / max(len(a), len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: the best of the signatures of equal block size."""
    if a == b:
        return 1.0
    (size_a, *ones), (size_b, *others) = a.split(":"), b.split(":")
    left = {int(size_a) << k: s for k, s in enumerate(ones)}
    return max((_alike(s, left[size]) for k, s in enumerate(others) if (size := int(size_b) << k) in left), default=0.0)


def _pair(text: str, print_: str, following: str, next_print: str) -> tuple:
    half = len(text) // 2
    edited = (text[: len(text) - half] + following[:half]).encode("utf-8", "surrogatepass")
    other = fingerprint(edited)
    return len(text), hashlib.sha256(edited).hexdigest(), print_, other, likeness(print_, other), likeness(print_, next_print)


_NAMES = [x.split()[0] for x in RESULT.split(", ")]
#: Results, and the first and last text of a range for the step between ranges.
_RANGED = f"{RESULT}, range int, end string, text string"


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def _within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of one range: a row's next is the row after it."""
    from pyspark import TaskContext

    at, names, before = TaskContext.get().partitionId(), [*_NAMES, "range", "end", "text"], None
    blank = (None,) * 6
    for frame in frames:
        rows = []
        for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
            text = text or ""
            now = (None if pd.isna(doc) else int(doc), text, fingerprint(text.encode("utf-8", "surrogatepass")))
            if before:
                rows.append((before[0], *_pair(*before[1:], *now[1:]), at, None, None))
            else:
                rows.append((now[0], *blank, at, "first", text))
            before = now
        yield _frame(rows, names)
    if before:
        yield _frame([(before[0], *blank, at, "last", before[1])], names)


def _between(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc, text, following in zip(frame["doc_id"], frame["text"], frame["following"], strict=True):
            prints = [fingerprint(t.encode("utf-8", "surrogatepass")) for t in (text, following)]
            rows.append((None if pd.isna(doc) else int(doc), *_pair(text, prints[0], following, prints[1])))
        yield _frame(rows, _NAMES)


def compare_neighbours(docs: DataFrame, range_docs: int = RANGE_DOCS, most_ranges: int = MOST_RANGES) -> DataFrame:
    """Fingerprints of each text, of its edited text (the last half replaced by the
    start of the next document, by descending id), and their likeness."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    n_ranges = min(most_ranges, max(1, -(-texts.count() // range_docs)))
    ranged = texts.repartitionByRange(n_ranges, *keys).sortWithinPartitions(*keys, "text")
    found = Written(ranged.mapInPandas(_within, _RANGED), "ranges").df
    ends = found.where("end is not null").select("range", "end", "doc_id", "text")
    # Ranges that hold rows, in order, each with the one after it (the first after the last): a row each.
    order = Window.orderBy("range")
    known = ends.where("end = 'first'").select("range")
    after = F.coalesce(F.lead("range").over(order), F.min("range").over(Window.partitionBy()))
    pairs = known.withColumn("after", after)
    lasts = ends.where("end = 'last'").select("range", "doc_id", "text").join(pairs, "range")
    firsts = ends.where("end = 'first'").select(F.col("range").alias("after"), F.col("text").alias("following"))
    between = lasts.join(firsts, "after").select("doc_id", "text", "following").mapInPandas(_between, RESULT)
    return found.where("end is null").select(*_NAMES).unionByName(between)
