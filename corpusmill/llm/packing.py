"""Packing: hierarchical multi-length packing of tokenised documents.

Documents are tokenised and packed inside one map over the input, so nothing is
shuffled and a lost task is simply run again. Rows come in groups of a bounded
number of tokens; each group is packed by itself:

1. A document gives whole windows of the largest context size; the rest of it is
   routed to the smallest tier that holds it (256, 512, 1024 or 2048 tokens).
2. Each tier opens its windows, longest pieces first.
3. Gaps of longer windows are filled from shorter tiers, largest fitting piece
   first; when none fits, a piece is cut to close the gap.
4. A last open window becomes windows of powers of two where it can, and is padded
   only below the smallest tier.
5. Windows are dealt to step groups, each of exactly the same number of padded tokens:
   of one tier each, and what the tiers leave over at a task's end is joined, longest
   windows first, so that only a task's last group falls short. Step groups are numbered
   apart over all tasks.

Ids are those of the tokenizer file, its control string in a text included.

Defined results: a null text is an empty one and packs as its end id alone; a text longer
than a window gives windows of its own and a rest; pieces of equal length go in the order
of their documents; repeated rows are packed each; other columns are ignored; an empty
table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Id that ends each document.
END_ID = 1
#: Fixed value of the tokenizer file: its control string and that one's id.
CONTROL, CONTROL_ID = "<|endoftext|>", 50256
#: Context sizes, smallest first; all are powers of two.
TIERS = (256, 512, 1024, 2048)
#: A group is packed once it holds so many tokens; bounds a task's memory.
GROUP_TOKENS = 4_000_000
#: Documents tokenised together.
BATCH_DOCS = 2000
#: Padded tokens in a step group; a power of two.
STEP_TOKENS = 65_536

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, context_size long, step_group long"
)

#: White space other than a word's own leading space, for Arrow's regular expressions.
_BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_AWKWARD = f"{_BLANK} |^{_BLANK}|{_BLANK}$|^$|" + re.escape(CONTROL)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tokens:
    """Byte-level BPE ids of many texts at once.

    Splits before spaces that follow other characters, where this vocabulary's word
    pattern always splits too, then encodes each distinct word of the batch once.
    ``batch`` gives the vocabulary's control string its own id, ``encoding`` takes it as
    ordinary text by ``encode_ordinary``."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={CONTROL: CONTROL_ID})
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        encode = self.encoding.encode_ordinary
        awkward = pc.match_substring_regex(texts, _AWKWARD).to_numpy(zero_copy_only=False)
        whole = lambda text: np.array(self.encoding.encode(text, allowed_special="all"), np.uint32)
        out: list = [whole(t.as_py()) if odd else None for t, odd in zip(texts, awkward, strict=True)]
        easy = np.flatnonzero(~awkward)
        if not len(easy):
            return out
        parts = pc.split_pattern(texts.take(pa.array(easy)), " ")
        words = parts.flatten().dictionary_encode()
        codes, distinct = words.indices.to_numpy(), words.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " ")
        ids = np.array(encode(" " + joined[0].as_py()), np.uint32)
        stops = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(pc.binary_length(distinct).to_numpy() + 1)) + 1
        starts = np.concatenate(([0], stops[:-1]))
        first = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy())))
        length = (stops - starts)[codes]
        length[first[:-1]] = 0  # a text's first word has no space before it: encoded by itself
        at = np.concatenate(([0], np.cumsum(length)))
        flat = ids[np.arange(at[-1]) + np.repeat(starts[codes] - at[:-1], length)]
        heads = distinct.take(words.indices.take(pa.array(first[:-1]))).to_pylist()
        for i, head, a, b in zip(easy, heads, at[first[:-1]], at[first[1:]], strict=True):
            out[i] = np.concatenate((np.array(encode(head), np.uint32), flat[a:b]))
        return out


def pack_group(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows for documents of these lengths: (context size, [(document, start, length), ...])."""
    top, windows = tiers[-1], []
    shelves: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}

    def shelve(doc: int, start: int, length: int) -> None:
        shelves[next(t for t in tiers if length <= t)].append((length, doc, start))

    for doc, length in enumerate(lengths):
        full = length // top
        windows += [(top, [(doc, k * top, top)]) for k in range(full)]
        if length % top:
            shelve(doc, full * top, length % top)
    for shelf in shelves.values():
        shelf.sort()
    by_length = tiers[::-1]
    while any(shelves.values()):
        # The longest tier that still has pieces opens a window; shorter tiers fill its gap.
        size = next(t for t in by_length if shelves[t])
        window, gap = [], size
        while gap:
            fit = None
            for t in by_length:
                shelf = shelves[t]
                if t <= size and shelf and shelf[0][0] <= gap:
                    lo, hi = 0, len(shelf)
                    while lo < hi:  # the largest piece of this tier that fits
                        mid = (lo + hi) // 2
                        lo, hi = (mid + 1, hi) if shelf[mid][0] <= gap else (lo, mid)
                    fit = shelf, lo - 1
                    break
            if fit:
                length, doc, start = fit[0].pop(fit[1])
            else:  # nothing fits whole: cut the longest piece of the shortest tier
                shelf = next((shelves[t] for t in tiers if shelves[t]), None)
                if shelf is None:
                    break
                whole, doc, start = shelf.pop()
                length = gap
                shelve(doc, start + gap, whole - gap)
                own = shelves[next(t for t in tiers if whole - gap <= t)]
                own.sort()
            window.append((doc, start, length))
            gap -= length
        windows.append((size, window))
    # Only the last window can have a gap: cut it into powers of two, smallest tier padded.
    used = sum(x[2] for x in windows[-1][1]) if windows else 0
    if windows and used < windows[-1][0]:
        _, pieces = windows.pop()
        left = used
        while left:
            size = next((t for t in by_length if t <= left), tiers[0])
            take, window = min(size, left), []
            left -= take
            while take:
                doc, start, length = pieces.pop(0)
                if length > take:
                    pieces.insert(0, (doc, start + take, length - take))
                    length = take
                window.append((doc, start, length))
                take -= length
            windows.append((size, window))
    return windows


def _packer(path: str, tiers: tuple[int, ...], group_tokens: int, step_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = Tokens(path)
        # Ids of sequences and step groups are unique over tasks and gapless within one.
        sequence = step = TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in PIECES.split(", ")]
        # Rows of the windows of each padded length that no step group holds yet, and their tokens.
        waiting: dict[int, list[list[tuple]]] = {}

        def grouped(windows: list[list[tuple]]) -> list[tuple]:
            nonlocal step
            rows = [(*row, step) for window in windows for row in window]
            step += 1
            return rows

        def batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

        def flush(docs: list, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for size, pieces in pack_group([len(x) for x in ids], tiers):
                offset, total, window = 0, sum(x[2] for x in pieces), []
                padded = total if total & (total - 1) == 0 else tiers[-1]
                for doc, start, length in pieces:
                    crc = zlib.crc32(ids[doc][start : start + length].tobytes())
                    window.append((docs[doc], start, length, crc, len(ids[doc]), sequence, offset, padded, size))
                    offset += length
                sequence += 1
                held = waiting.setdefault(padded, [])
                held.append(window)
                if len(held) * padded >= step_tokens:
                    rows += grouped(held)
                    held.clear()
            yield from batch(rows)

        def close() -> Iterator[pa.RecordBatch]:
            rows, group, spent = [], [], 0
            for padded in sorted(waiting, reverse=True):
                for window in waiting[padded]:
                    group.append(window)
                    spent += padded
                    if spent >= step_tokens:
                        rows += grouped(group)
                        group, spent = [], 0
            if group:
                rows += grouped(group)
            yield from batch(rows)

        docs, ids, total = [], [], 0
        for rows in batches:
            for a in range(0, rows.num_rows, BATCH_DOCS):
                part = rows.slice(a, BATCH_DOCS)
                texts = pc.fill_null(part["text"], "")
                docs += part["doc_id"].to_pylist()
                got = [np.append(x, END_ID).astype("<u4") for x in tokens.batch(texts)]
                ids += got
                total += sum(map(len, got))
                if total >= group_tokens:
                    yield from flush(docs, ids)
                    docs, ids, total = [], [], 0
        if docs:
            yield from flush(docs, ids)
        yield from close()

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    group_tokens: int = GROUP_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece of a document in a packed sequence (columns: ``PIECES``).
    ``step_tokens`` is a power of two, at least the largest tier."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packer(tokenizer_path or default_tokenizer(), tiers, group_tokens, step_tokens), PIECES)
