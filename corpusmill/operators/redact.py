"""Sensitive spans: detection by pattern, counts, and redacted text."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (id, category, pattern, group replaced). In order: an earlier one wins its span.
PATTERNS = (
    ("private_key_block", "private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("jwt_token", "token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("aws_access_key_id", "api_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github_token", "api_key", r"\bghp_[A-Za-z0-9]{36}\b"),
    ("postgres_uri_with_credentials", "uri", r"\bpostgres(?:ql)?://[^\s:@/]+:[^\s:@/]+@[^\s]+"),
    ("token_assignment", "token", r'token = "[0-9a-f]{40}"'),
    ("email", "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip_address", "ip", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
)


#: Further patterns of the sweep; where a pattern has a group, the group alone is the span.
ASSIGNED = (
    ("oauth_token_assignment", "token", r"(?i)\b(?:access|refresh|oauth)_token[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9._~+/-]{20,})"),
    ("bearer_token", "token", r"\bBearer\s+([A-Za-z0-9._~+/-]{20,}=*)"),
)
SPANS = "array<struct<start:int,end:int,id:string,category:string>>"
_MARKER = re.compile(r"‹REDACTED:[^›\n]+›")
_DENSE = re.compile(r"[A-Za-z0-9+/_-]+")


def slug(name: Column) -> Column:
    """Lower case, what is no letter or digit as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def custom_patterns(given: Iterable[str], category: str = "token") -> tuple[list[tuple[str, str, str]], list[str]]:
    """Patterns from texts like ``/body/flags`` or a bare body, numbered from 1, and the texts that are none."""
    found, wrong = [], []
    for number, one in enumerate(given, 1):
        whole = re.fullmatch(r"/(.+)/([a-zA-Z]*)", one.strip(), re.S)
        body, flags = whole.groups() if whole else (one.strip(), "")
        kept = "".join(f for f in "ims" if f in flags)
        try:
            re.compile(body)
            if not body or set(flags) - set("gimsuy"):
                raise re.error("flags")
        except re.error:
            wrong.append(one)
        else:
            found.append((f"custom_pattern_{number}", category, (f"(?{kept})" if kept else "") + body))
    return found, wrong


def _bits(text: str) -> float:
    """Entropy of the characters, in bits each."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in (text.count(c) for c in set(text)))


def _swept(text: str, patterns: list[tuple[str, str, re.Pattern]], entropy: tuple[int, float] | None) -> list[tuple[int, int, str, str]]:
    held = [(m.start(), m.end(), "", "") for m in _MARKER.finditer(text)]
    found = [(*m.span(m.lastindex or 0), name, category) for name, category, p in patterns for m in p.finditer(text)]
    if entropy:
        found += [
            (m.start(), m.end(), "~entropy_marker", "entropy_marker") for m in _DENSE.finditer(text) if m.end() - m.start() >= entropy[0] and _bits(m[0]) >= entropy[1]
        ]
    # Markers that stand keep their span: each cuts out the found spans that overlap it.
    found, k, free = sorted(found, key=lambda s: (s[0], s[0] - s[1], s[2])), 0, []
    for span in found:
        while k < len(held) and held[k][1] <= span[0]:
            k += 1
        if not (k < len(held) and held[k][0] < span[1]):
            free.append(span)
    out, cursor = [], -1
    for a, b, name, category in free:
        if a >= cursor and b > a:
            out.append((a, b, name.lstrip("~"), category))
            cursor = b
    return out


def swept(files: DataFrame, patterns=PATTERNS + ASSIGNED, entropy: tuple[int, float] | None = None) -> DataFrame:
    """Adds spans and redacted. Spans of all patterns that overlap no marker already there: the
    earliest, then longest, then first by id, skipping what starts before the last one's end.
    ``entropy`` (least length and bits a character) marks dense tokens too. A marker is followed by the line breaks
    of the text that it replaces, so that lines keep their numbers."""
    given = [(name, category, pattern) for name, category, pattern in patterns]

    @F.pandas_udf(f"struct<spans:{SPANS},redacted:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        known = [(name, category, re.compile(pattern)) for name, category, pattern in given]
        spans, after = [], []
        for text in texts:
            found = _swept(text or "", known, entropy)
            parts, done = [], 0
            for a, b, name, _ in found:
                reason = re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", name.lower()))
                parts += [text[done:a], f"‹REDACTED:{reason}›", "\n" * text.count("\n", a, b)]
                done = b
            spans.append([dict(zip(("start", "end", "id", "category"), s, strict=True)) for s in found])
            after.append("".join([*parts, text[done:]]) if text is not None else None)
        return pd.DataFrame({"spans": spans, "redacted": after})

    return files.withColumn("__swept", run(F.col("content"))).withColumns({"spans": F.col("__swept.spans"), "redacted": F.col("__swept.redacted")}).drop("__swept")


def json_redacted(rows: DataFrame, column: str, patterns=PATTERNS + ASSIGNED) -> DataFrame:
    """Every text within a JSON column redacted as by ``swept``, keys sorted; null where it is no JSON."""
    given = [(name, category, pattern) for name, category, pattern in patterns]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        known = [(name, category, re.compile(pattern)) for name, category, pattern in given]

        def clean(value: object) -> object:
            if isinstance(value, str):
                parts, done = [], 0
                for a, b, name, _ in _swept(value, known, None):
                    parts += [value[done:a], f"‹REDACTED:{name}›", "\n" * value.count("\n", a, b)]
                    done = b
                return "".join([*parts, value[done:]])
            if isinstance(value, dict):
                return {k: clean(value[k]) for k in sorted(value)}
            return [clean(v) for v in value] if isinstance(value, list) else value

        def whole(text: str | None) -> str | None:
            try:
                return json.dumps(clean(json.loads(text or "")), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):
                return None

        return texts.map(whole)

    return rows.withColumn(column, run(F.col(column)))


def reason_counts(found: DataFrame) -> DataFrame:
    """category, reason and n over the spans of ``swept``, with totals of each category
    (reason null) and of all (both null)."""
    spread = found.select(F.explode("spans").alias("s")).select("s.category", slug(F.col("s.id")).alias("reason"))
    return spread.rollup("category", "reason").agg(F.count("*").alias("n"))


def redacted(text: Column, patterns=PATTERNS) -> Column:
    """The text with every span replaced by a mark; existing marks hold nothing that a pattern fits."""
    for name, _, pattern in patterns:
        text = F.regexp_replace(text, pattern, f"‹REDACTED:{name}›")
    return text


#: What a text must hold for a pattern to fit; most texts lack most of these.
NEEDLES = {
    "private_key_block": "-----BEGIN ",
    "jwt_token": "eyJ",
    "aws_access_key_id": "AKIA",
    "github_token": "ghp_",
    "postgres_uri_with_credentials": "postgres",
    "token_assignment": 'token = "',
    "email": "@",
}


def _counting(name: str, pattern: str):
    def step(x: Column) -> Column:
        n = F.regexp_count(x["text"], F.lit(pattern)).cast("long")
        after = F.struct(F.regexp_replace(x["text"], pattern, f"‹REDACTED:{name}›").alias("text"), F.array_append(x["n"], n).alias("n"))
        none = F.struct(x["text"].alias("text"), F.array_append(x["n"], F.lit(0).cast("long")).alias("n"))
        return F.when(F.contains(x["text"], F.lit(NEEDLES[name])), after).otherwise(none) if name in NEEDLES else after

    return step


def counts(files: DataFrame, patterns=PATTERNS) -> DataFrame:
    """category and spans over all files. The steps are bound by lambdas, so that each
    pattern works once on the text that the patterns before it left."""
    steps = F.array(F.struct(F.col("content").alias("text"), F.array().cast("array<bigint>").alias("n")))
    for name, _, pattern in patterns:
        steps = F.transform(steps, _counting(name, pattern))
    categories = F.array(*[F.lit(category) for _, category, _ in patterns])
    spread = files.where("content is not null").select(F.explode(steps).alias("x")).select(F.inline(F.arrays_zip(categories.alias("category"), F.col("x.n").alias("n"))))
    return spread.groupBy("category").agg(F.sum("n").alias("spans")).where("spans > 0")
