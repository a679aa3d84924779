"""Chat formatting as a prefix tree.

Each turn is formatted by a template that marks turns and escapes its control strings
inside texts reversibly, and tokenised. Conversations that share their first turns
share nodes: a node's id is the digest of the chain of turns up to it. Nodes are
emitted once, depth first within their tree, with

* ``position``: of their first token within any conversation through them;
* ``start`` and ``end``: where their tokens stand in the tree, depth first;
* ``segment``: where their own segment starts (see below);
* ``attend``: intervals of the tree's tokens that hold their ancestors, besides
  the tokens from their own segment's start.

A conversation is read back from its last node alone, by the intervals that this one
attends to.

Chains of nodes that the same conversations pass through are one segment, and the
digests of the segments' heads along a path are a key whose byte order is depth first
(a segment branches only at its end). Sums along that order are worked out in two
levels, within ranges of the whole key and over them, so that a tree with a third of all
conversations is spread evenly however it branches. The turns of one conversation stream through one task in order, as
the digest over them needs.

Defined results: a null text or role is empty; turns sort by number (null first), then
role, then text, and repeated rows are turns each; rows with a null conv_id are one
conversation; very long texts are taken whole, each in the memory of the task that reads it; other columns
are ignored, whatever their names; an empty table gives an empty tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Scratch, Written, hot_keys, in_ranges, running_sum, spread_join
from corpusmill.llm.packing import Tokens, default_tokenizer

LEARNED_ROLE = "assistant"
_control = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_escaped = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_turn = re.compile(r"<s>\[INST\](.*?)\[/INST\]\n(.*)</s>\n", re.S)


def escape(text: str) -> str:
    """No control string is left: each gets one more backslash after its first character."""
    return _control.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1\2\3", text)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, what stands after it."""
    return f"<s>[INST]{escape(role)}[/INST]\n", escape(text), "</s>\n"


PATHS = "conv_id long, depth long, node binary, root binary, ids array<int>, loss_start int, loss_end int"


def _values(column: pa.Array) -> list:
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, ends = column.values.to_numpy(), column.offsets.to_pylist()  # ids are never null
    return [flat[a:b].tolist() for a, b in pairwise(ends)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*map(_values, batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema)


def _long(*names: str) -> list[tuple[str, pa.DataType]]:
    return [(n, pa.int64()) for n in names]


def _paths(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokens(tokenizer_path).encoding.encode_ordinary

        def rows() -> Iterator[tuple]:
            for conv, turns in groupby(_rows(batches), key=lambda r: r[0]):
                parent = root = b""
                for depth, (_, _, role, text) in enumerate(turns):
                    own = f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")
                    node = hashlib.sha256(parent + own).digest()[:16]
                    root = root or node
                    head, body, tail = map(encode, formatted(role, text))
                    learned = role == LEARNED_ROLE
                    yield conv, depth, node, root, head + body + tail, len(head), len(head) + len(body) * learned
                    parent = node

        schema = pa.schema(
            [*_long("conv_id", "depth"), ("node", pa.binary()), ("root", pa.binary()), ("ids", pa.list_(pa.int32())), ("loss_start", pa.int32()), ("loss_end", pa.int32())]
        )
        yield from _batches(rows(), schema)

    return run


def paths(turns: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Every turn of every conversation, formatted and tokenised, with its node (``PATHS``)."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_paths(tokenizer_path or default_tokenizer()), PATHS)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows in path order: key (heads of the segments so far) and position."""

    def rows() -> Iterator[tuple]:
        for _, turns in groupby(_rows(batches), key=lambda r: r[0]):
            key, before, position = b"", None, 0
            for _, depth, node, root, n_tokens, passing, owned in turns:
                if passing != before:
                    key, before = key + node[:8], passing
                if owned:
                    yield node, root, depth, key, position, n_tokens, passing
                position += n_tokens

    schema = pa.schema(
        [("node", pa.binary()), ("root", pa.binary()), *_long("depth"), ("key", pa.binary()), *_long("position", "n_tokens", "conversations")]
    )
    yield from _batches(rows(), schema)


def prefix_tree(walked: DataFrame) -> DataFrame:
    """The nodes of all trees: node, root, depth, conversations, position, start, end,
    segment, attend, ids, loss_start, loss_end; written. ``walked`` comes from ``paths``, written."""
    passing = walked.groupBy("node").agg(
        F.count("*").alias("conversations"), F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("owner")
    )
    owned = F.col("owner.conv_id").eqNullSafe(F.col("conv_id"))
    scratch = Scratch()
    passing = scratch(passing, "passing")
    hot = hot_keys(passing.select("node", F.col("conversations").alias("n")), ["node"], scratch)
    spine = walked.select("conv_id", "depth", "node", "root", F.size("ids").cast("long").alias("n_tokens"))
    spine = spread_join(spine, passing, ["node"], "conv_id", hot)
    spine = spine.select("conv_id", "depth", "node", "root", "n_tokens", "conversations", owned.alias("owned"))
    nodes = (
        spine.repartition("conv_id")
        .sortWithinPartitions("conv_id", "depth")
        .mapInArrow(_keyed, "node binary, root binary, depth long, key binary, position long, n_tokens long, conversations long")
    )
    ranged = in_ranges(nodes, "range", "root", "key", "depth")
    laid = scratch(running_sum(ranged.df, "root", "range", ["key", "depth"], "n_tokens", "start"), "nodes")
    ranged.drop()
    segments = scratch(laid.groupBy("root", "key").agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("n_tokens")).alias("b")), "segments")
    above = segments.where(F.octet_length("key") > 8).select(
        "root", F.col("key").alias("of"), F.explode(F.sequence(F.lit(8), F.octet_length("key") - 8, F.lit(8))).alias("n")
    )
    above = above.withColumn("key", F.substring("of", F.lit(1), F.col("n")))
    hot = hot_keys(above.groupBy("root", "key").agg(F.count("*").alias("n")), ["root", "key"], scratch)
    attend = spread_join(above.drop("n"), segments, ["root", "key"], "of", hot).groupBy("root", "of").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("attend"))
    attend = segments.select("root", "key", F.col("a").alias("segment")).join(attend.withColumnRenamed("of", "key"), ["root", "key"], "left")
    # A node's owner has a single row of it, so this join meets a node once.
    owners = passing.select("node", F.col("owner.conv_id").alias("conv_id"))
    texts = walked.select("node", "ids", "loss_start", "loss_end", "conv_id")
    contents = texts.join(owners, (texts["node"] == owners["node"]) & texts["conv_id"].eqNullSafe(owners["conv_id"])).drop(owners["node"])
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    tree = (
        laid.join(attend, ["root", "key"])
        .join(contents.select("node", "ids", "loss_start", "loss_end"), "node")
        .select(
            "node",
            "root",
            "depth",
            "conversations",
            "position",
            "start",
            (F.col("start") + F.col("n_tokens")).alias("end"),
            "segment",
            F.coalesce("attend", none).alias("attend"),
            "ids",
            "loss_start",
            "loss_end",
        )
    )
    written = Written(tree, "tree")
    for one in scratch.tables:
        one.drop()
    return written.df


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def _read(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = Tokens(tokenizer_path).encoding
        decode = lambda ids: encoding.decode_bytes(ids).decode("utf-8", "surrogatepass")

        def rows() -> Iterator[tuple]:
            for conv, turns in groupby(_rows(batches), key=lambda r: r[0]):
                whole, loss, n, loss_chars, chars, tokens = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                for _, depth, position, turns_there, ids, a, b in turns:
                    if position != tokens or depth != n or n >= turns_there:
                        raise ValueError(f"conversation {conv}: turn {n} is not where the tree says")
                    text = decode(ids)
                    role, body = map(unescape, _turn.fullmatch(text).groups())
                    whole.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    learned = unescape(decode(ids[a:b]))
                    loss.update(learned.encode("utf-8", "surrogatepass"))
                    n, loss_chars, chars, tokens = n + 1, loss_chars + len(learned), chars + len(text), tokens + len(ids)
                if n != turns_there:
                    raise ValueError(f"conversation {conv}: the tree holds {n} turns of {turns_there}")
                yield conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars, tokens

        schema = pa.schema(
            [*_long("conv_id", "n_turns"), ("turns_sha256", pa.string()), *_long("loss_chars"), ("loss_sha256", pa.string()), *_long("formatted_chars", "n_tokens")]
        )
        yield from _batches(rows(), schema)

    return run


def read_back(walked: DataFrame, tree: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Each conversation as the tree holds it (``READ``): of its last node, the tokens in
    the intervals that this one attends to and those of its own segment up to it."""
    scratch = Scratch()  # read by the result, so dropped with the driver's process
    leaves = walked.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"), F.count("*").alias("turns"))
    own = F.struct(F.col("segment").alias("a"), F.col("end").alias("b"))
    hot = hot_keys(tree.select("node", F.col("conversations").alias("n")), ["node"], scratch)
    ends = spread_join(leaves, tree.select("node", "root", "segment", "end", "attend"), ["node"], "conv_id", hot)
    spans = ends.select("conv_id", "turns", "root", F.inline(F.concat("attend", F.array(own))))
    shared = tree.where("start = segment").select("root", F.col("segment").alias("a"), F.col("conversations").alias("n"))
    hot = hot_keys(shared, ["root", "a"], scratch)
    nodes = tree.select("root", F.col("segment").alias("a"), "end", "depth", "position", "ids", "loss_start", "loss_end")
    steps = spread_join(spans, nodes, ["root", "a"], "conv_id", hot).where(F.col("end") <= F.col("b"))
    ordered = steps.select("conv_id", "depth", "position", "turns", "ids", "loss_start", "loss_end").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "depth").mapInArrow(_read(tokenizer_path or default_tokenizer()), READ)


def format_and_read(turns: DataFrame) -> DataFrame:
    walked = Written(paths(turns), "paths").df
    return read_back(walked, prefix_tree(walked))
