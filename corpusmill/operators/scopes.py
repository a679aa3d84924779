"""Nested scopes of texts: declarations, headings and their ranges, and what encloses a line.

Scopes are read line by line with a stack, by the language's own sign of nesting: brackets
(outside strings and comments), indentation, or levels of headings. Every scope knows the line
of the one around it, so that the innermost scope of a line follows from a sweep: where a scope
starts it is the innermost, where it ends the nearest one around it that goes on; of a line, the last such
change decides. The sweep is one window over changes and lines of a file, without pairs of scopes
and lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.frames import pieces

SCOPES = "path string, kind string, name string, signature string, line long, last long, depth int, parent long"
#: Characters of a signature at most.
SIGNATURE = 160
#: Scopes of a frame that a task gives back at most.
GIVEN = 10_000

# Words that declare, by language, and the kind of symbol that each gives.
SCRIPT = {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum", "namespace": "module", "const": "variable", "let": "variable", "var": "variable"}
DECLARING = {
    "typescript": SCRIPT,
    "tsx": SCRIPT,
    "javascript": SCRIPT,
    "python": {"class": "class", "def": "function"},
    "go": {"func": "function", "type": "type", "const": "variable", "var": "variable"},
    "rust": {"fn": "function", "struct": "type", "enum": "enum", "trait": "interface", "type": "type", "const": "variable", "impl": "class", "mod": "module"},
    "java": {"class": "class", "interface": "interface", "record": "type", "enum": "enum"},
    "ruby": {"class": "class", "module": "module", "def": "function"},
}
#: Kinds in which a function is a method; kinds that count at the top alone.
HOLDERS, TOP_ONLY = {"class", "interface"}, {"variable"}
_MODIFIERS = ("export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "final", r"pub(?:\([a-z]+\))?", "unsafe")
_BEFORE = rf"(?:(?:{'|'.join(_MODIFIERS)})\s+)*"
_METHOD = re.compile(r"\s*(?:(?:public|private|protected|static|async|final|override|readonly|get|set)\s+)*(?:[\w<>\[\], ]+\s+)?([A-Za-z_$][\w$]*)\s*\([^;{}]*(?:\{|$)")
#: Fixed value: words before a bracket that are no method's name.
_FLOW = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "with", "match", "function", "new"}

#: A declaration on a line: kind, name, signature.
Mark = tuple[str, str, str]
#: As a row of SCOPES without its path.
Scope = list


def _declared(bare: str, words: dict[str, str], pattern: re.Pattern) -> Mark | None:
    """The declaration on a line, given without the space before it."""
    found = pattern.match(bare)
    if not found:
        return None
    word, name, other = found.groups()
    return words[word], name or other, " ".join(bare.split())[:SIGNATURE]


@cache
def _pattern(language: str) -> re.Pattern:
    words = sorted(DECLARING[language], key=len, reverse=True)
    return re.compile(rf"{_BEFORE}({'|'.join(words)})\b\*?\s*(?:\([^)]*\)\s*)?(?:<[^>]*>\s*)?(?:([A-Za-z_$][\w$]*)|([{{\[].*))")


@cache
def _starts(language: str) -> frozenset[str]:
    """First letters of declarations."""
    return frozenset(w[0] for w in (*DECLARING[language], *_MODIFIERS))


@cache
def _signs(language: str) -> re.Pattern:
    """What a line holds outside strings and comments that changes how it is read on."""
    quotes = '"' if language == "rust" else "'\"" if language in ("java", "go") else "'\"`"
    return re.compile(rf"//|/\*|[{quotes}{{}};]")


#: Where a string may end, or what it escapes.
_STRING = {q: re.compile(rf"\\.|{q}", re.S) for q in "'\"`"}


def _closed(scope: Scope, last: int, done: list[Scope]) -> None:
    scope[4] = max(last, scope[3])
    done.append(scope)


def _placed(mark: Mark, number: int, around: list[Scope]) -> Scope:
    kind = "method" if mark[0] == "function" and around and around[-1][0] in HOLDERS else mark[0]
    return [kind, mark[1], mark[2], number, number, len(around), around[-1][3] if around else None]


def by_brackets(lines: list[str], language: str) -> list[Scope]:
    """Scopes of a language with curly brackets. A declaration reaches from its line to the
    bracket that closes the first one it opens, or to the end of its statement."""
    words, done = DECLARING[language], []
    pattern, starts, next_sign = _pattern(language), _starts(language), _signs(language).search
    held: list[tuple[Scope, int]] = []  # open scopes, and the depth of brackets outside each
    waiting: tuple[Scope, int] | None = None
    depth, quote, comment = 0, "", False
    for number, line in enumerate(lines, 1):
        if not quote and not comment:
            bare = line.lstrip()
            mark = _declared(bare, words, pattern) if bare[:1] in starts else None
            if mark is None and held and held[-1][0][0] in HOLDERS and "(" in bare and (found := _METHOD.match(bare)) and found[1] not in _FLOW:
                mark = ("function", found[1], " ".join(bare.split())[:SIGNATURE])
            if mark and not (mark[0] in TOP_ONLY and depth):
                if waiting:
                    _closed(waiting[0], number - 1, done)
                waiting = (_placed(mark, number, [s for s, _ in held]), depth)
        k = 0
        while True:
            if comment:
                k = line.find("*/", k) + 2
                if k < 2:
                    break
                comment = False
            if quote:
                sign = _STRING[quote].search(line, k)
                if not sign:
                    break
                k = sign.end()
                if sign[0] == quote:
                    quote = ""
                continue
            sign = next_sign(line, k)
            if not sign:
                break
            c, k = sign[0], sign.end()
            if c == "//":
                break
            elif c == "/*":
                comment = True
            elif c == "{":
                if waiting and depth == waiting[1]:
                    held.append(waiting)
                    waiting = None
                depth += 1
            elif c == "}":
                depth = max(0, depth - 1)
                if waiting and depth < waiting[1]:
                    _closed(waiting[0], number, done)
                    waiting = None
                while held and held[-1][1] >= depth:
                    _closed(held.pop()[0], number, done)
            elif c == ";":
                if waiting and depth == waiting[1]:
                    _closed(waiting[0], number, done)
                    waiting = None
            else:
                quote = c
        if quote and quote != "`":
            quote = ""  # only template strings go over lines
    if waiting:
        _closed(waiting[0], waiting[0][3], done)
    for scope, _ in held:
        _closed(scope, len(lines), done)
    return done


def by_indent(lines: list[str], language: str = "python") -> list[Scope]:
    """Scopes of a language in which deeper lines belong to the declaration above them."""
    words, done = DECLARING[language], []
    pattern, starts = _pattern(language), _starts(language)
    held: list[tuple[Scope, int]] = []
    last = 0
    for number, line in enumerate(lines, 1):
        bare = line.lstrip()
        if not bare:
            continue
        if "\t" in line:
            line = line.expandtabs(4)
            indent = len(line) - len(line.lstrip())
        else:
            indent = len(line) - len(bare)
        closer = bare[0] in ")]}"  # ends a declaration of several lines
        while held and held[-1][1] >= indent and not closer:
            _closed(held.pop()[0], last, done)
        last = number
        if bare[0] in starts and (mark := _declared(bare, words, pattern)):
            held.append((_placed(mark, number, [s for s, _ in held]), indent))
    while held:
        _closed(held.pop()[0], last, done)
    return done


def by_levels(marks: list[tuple[int, int, str]], n: int) -> list[Scope]:
    """Sections of headings (line, level, name): each to the line before the next heading of its level or above, or to line ``n``."""
    done: list[Scope] = []
    held: list[tuple[Scope, int]] = []
    for number, level, name in marks:
        while held and held[-1][1] >= level:
            _closed(held.pop()[0], number - 1, done)
        around = [s for s, _ in held]
        held.append((["section", name, name[:SIGNATURE], number, number, len(around), around[-1][3] if around else None], level))
    while held:
        _closed(held.pop()[0], n, done)
    return done


_TITLE = re.compile(r"(#{1,6})\s+(.*)")


def _markdown(lines: list[str]) -> list[Scope]:
    marks, fenced = [], False
    for number, line in enumerate(lines, 1):
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced and line.startswith("#") and (found := _TITLE.match(line)):
            marks.append((number, len(found[1]), found[2].strip(" #")))
    return by_levels(marks, len(lines))


_HEADING = re.compile(r"h([1-6])\b[^>]*>(.*)", re.S | re.I)


def _html(pieces: list[str]) -> list[Scope]:
    """Sections of a page; its lines are what the signs ``<`` separate."""
    found = [(number, m) for number, piece in enumerate(pieces, 1) if (m := _HEADING.match(piece))]
    return by_levels([(number, int(m[1]), m[2]) for number, m in found], len(pieces))


def scopes_of(text: str, language: str) -> list[Scope]:
    """Scopes by start, outer ones first; none for a language without rules."""
    if language == "html":
        found = _html(text.split("<"))
    else:
        lines = text.replace("\r\n", "\n").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        if language == "markdown":
            found = _markdown(lines)
        elif language == "python":
            found = by_indent(lines)
        elif language in DECLARING and language != "ruby":
            found = by_brackets(lines, language)
        else:
            found = []
    return sorted(found, key=lambda s: (s[3], s[5]))


def scopes(files: DataFrame) -> DataFrame:
    """SCOPES of files (path, language, content): all of each file, outer ones before inner ones."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCOPES.split(", ")]
        for frame in pieces(frames, 1024):
            rows: list[tuple] = []
            for path, language, text in frame.itertuples(index=False):
                rows += [(path, *s) for s in scopes_of(text or "", language or "")]
                while len(rows) >= GIVEN:  # a file may have any number
                    yield pd.DataFrame(rows[:GIVEN], columns=names).astype({"parent": "Int64"})
                    del rows[:GIVEN]
            yield pd.DataFrame(rows, columns=names).astype({"parent": "Int64"})

    run: Callable = f
    return files.select("path", "language", "content").mapInPandas(run, SCOPES)


def symbols(files: DataFrame, most: int | None = None) -> DataFrame:
    """path, name and signature: one row for each file that has SCOPES, with the names and the signatures of all of them
    (of the first ``most``, if given), a line each. For what needs no more of them than their words."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames, 1024):
            found: dict[str, list] = {"path": [], "name": [], "signature": []}
            for path, language, text in zip(frame["path"], frame["language"], frame["content"], strict=True):
                if own := scopes_of(text or "", language or "")[:most]:
                    found["path"].append(path)
                    found["name"].append("\n".join([s[1] for s in own]))
                    found["signature"].append("\n".join([s[2] for s in own]))
            yield pd.DataFrame(found, dtype="object")

    run: Callable = f
    return files.select("path", "language", "content").mapInPandas(run, "path string, name string, signature string")


def innermost(points: DataFrame, found: DataFrame) -> DataFrame:
    """For each distinct (path, at) the innermost scope that holds the line: kind, name, line, last and depth; null where none does.

    ``found`` are properly nested SCOPES of their files."""
    found = found.persist()  # read three times
    # Where a scope ends, the nearest one around it that goes on; several that end together leave what goes on around the outermost.
    own = F.struct("kind", "name", "line", "last", "depth").alias("scope")
    around = found.select("path", F.col("line").alias("parent"), F.col("depth").alias("above"), F.struct("kind", "name", "line", "last", "depth").alias("outer"))
    starts = found.select("path", F.col("line").alias("at"), F.lit(1).alias("rank"), F.col("depth").alias("nth"), own)
    inner = found.select("path", "last", "depth", "parent").withColumn("above", F.col("depth") - 1)
    ends = inner.join(around, ["path", "parent", "above"], "left")
    ends = ends.select("path", (F.col("last") + 1).alias("at"), F.lit(0).alias("rank"), (-F.col("depth")).alias("nth"), F.col("outer").alias("scope"))
    asked = points.select("path", "at").distinct()
    asked = asked.select("path", "at", F.lit(2).alias("rank"), F.lit(0).alias("nth"), F.lit(None).cast(starts.schema["scope"].dataType).alias("scope"))
    before = Window.partitionBy("path").orderBy("at", "rank", "nth").rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.col("rank") < 2, F.struct("scope"))  # a null scope is a change too
    swept = starts.unionByName(ends).unionByName(asked).withColumn("now", F.last(change, ignorenulls=True).over(before))
    return swept.where("rank = 2").select("path", "at", "now.scope.*")
