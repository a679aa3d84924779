"""Diffs of two versions of files: pairing of versions, line diffs, unified text, patching.

Versions meet by one full outer join on their path; a path that goes and one that comes
with the same content are one renamed file. Only pairs that differ are compared line by line,
each in the task that holds it: what both ends share is set aside, lines that each side
holds once are anchors (their longest common ascending run), and between anchors the
shortest edit is searched with a bounded number of changes; a gap that needs more is
replaced as a whole, which is a valid diff, if not the shortest."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.frames import pieces

#: Lines shown around a change; changes searched for between two anchors.
CONTEXT, MOST_CHANGES = 3, 400
#: Fixed value: the mark below a last line without a line end.
NO_END = "\\ No newline at end of file"
PAIR = "path string, old_path string, status string, old string, new string"
HUNKS = "path string, old_path string, status string, nth long, old_first long, old_lines long, new_first long, new_lines long, content string"

#: A hunk's range of lines: a start before which both sides agree, and the edits from there.
Edit = tuple[int, int, int, int]  # old first, old end, new first, new end


def lines(text: str | None) -> list[str]:
    """Lines with their ends."""
    found = (text or "").split("\n")
    ended = [x + "\n" for x in found[:-1]]
    return ended + [found[-1]] if found[-1] else ended


def _anchors(a: list[str], b: list[str], lo_a: int, hi_a: int, lo_b: int, hi_b: int) -> list[tuple[int, int]]:
    """Lines that each side holds once, in the order of both (longest ascending run)."""
    once_a, once_b = Counter(a[lo_a:hi_a]), Counter(b[lo_b:hi_b])
    place = {x: k for k, x in enumerate(b[lo_b:hi_b], lo_b) if once_b[x] == 1}
    pairs = [(k, place[x]) for k, x in enumerate(a[lo_a:hi_a], lo_a) if once_a[x] == 1 and x in place]
    ends: list[int] = []  # smallest last place of a run of each length, and the pair there
    at: list[int] = []
    before: list[int] = []
    for n, (_, k) in enumerate(pairs):
        i = bisect_left(ends, k)
        before.append(at[i - 1] if i else -1)
        ends[i : i + 1], at[i : i + 1] = [k], [n]
    run, n = [], at[-1] if at else -1
    while n >= 0:
        run.append(pairs[n])
        n = before[n]
    return run[::-1]


def _shortest(a: list[str], b: list[str], edit: Edit, most: int) -> list[Edit]:
    """The edits of the shortest path through the grid of both sides, or the whole gap if it is longer than ``most``."""
    lo_a, hi_a, lo_b, hi_b = edit
    n, m = hi_a - lo_a, hi_b - lo_b
    far, trail = {1: 0}, []
    for d in range(min(n + m, most) + 1):
        trail.append(dict(far))
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            while x < n and x - k < m and a[lo_a + x] == b[lo_b + x - k]:
                x += 1
            far[k] = x
            if x >= n and x - k >= m:
                return _steps(trail, n, m, lo_a, lo_b)
    return [edit]


def _steps(trail: list[dict[int, int]], x: int, y: int, lo_a: int, lo_b: int) -> list[Edit]:
    out: list[Edit] = []
    for d in range(len(trail) - 1, 0, -1):
        far, k = trail[d], x - y
        k_before = k + 1 if k == -d or (k != d and far[k - 1] < far[k + 1]) else k - 1
        x_before = far[k_before]
        y_before = x_before - k_before
        x_to, y_to = (x_before, y_before + 1) if k_before == k + 1 else (x_before + 1, y_before)
        out.append((lo_a + x_before, lo_a + x_to, lo_b + y_before, lo_b + y_to))
        x, y = x_before, y_before
    return out[::-1]


def edits(a: list[str], b: list[str], most: int = MOST_CHANGES) -> list[Edit]:
    """What differs, in order: stretches of old lines and the new lines in their place."""
    found: list[Edit] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        while lo_a < hi_a and lo_b < hi_b and a[lo_a] == b[lo_b]:
            lo_a, lo_b = lo_a + 1, lo_b + 1
        while lo_a < hi_a and lo_b < hi_b and a[hi_a - 1] == b[hi_b - 1]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
        if lo_a == hi_a or lo_b == hi_b:
            if hi_a > lo_a or hi_b > lo_b:
                found.append((lo_a, hi_a, lo_b, hi_b))
        elif anchors := _anchors(a, b, lo_a, hi_a, lo_b, hi_b):
            for x, y in anchors:
                todo.append((lo_a, x, lo_b, y))
                lo_a, lo_b = x + 1, y + 1
            todo.append((lo_a, hi_a, lo_b, hi_b))
        else:
            found += _shortest(a, b, (lo_a, hi_a, lo_b, hi_b), most)
    joined: list[Edit] = []
    for e in sorted(found):
        if joined and joined[-1][1] == e[0] and joined[-1][3] == e[2]:
            e = (joined[-1][0], e[1], joined.pop()[2], e[3])
        joined.append(e)
    return joined


def _side(first: int, n: int) -> str:
    """A range of a hunk's header; an empty one names the line before it."""
    at = first + 1 if n else first
    return str(at) if n == 1 else f"{at},{n}"


def _shown(sign: str, line: str) -> str:
    return sign + line if line.endswith("\n") else f"{sign}{line}\n{NO_END}\n"


def unified(old: str | None, new: str | None, context: int = CONTEXT) -> list[tuple[int, int, int, int, str]]:
    """Hunks: first line and number of lines of both sides, and content with its header."""
    a, b, out = lines(old), lines(new), []
    found = edits(a, b)
    k = 0
    while k < len(found):
        last = k
        while last + 1 < len(found) and found[last + 1][0] - found[last][1] <= 2 * context:
            last += 1
        before = min(context, found[k][0])
        first_a, first_b = found[k][0] - before, found[k][2] - before
        end_a = min(len(a), found[last][1] + context)
        body, at = [], first_a
        for lo_a, hi_a, lo_b, hi_b in found[k : last + 1]:
            body += [_shown(" ", x) for x in a[at:lo_a]] + [_shown("-", x) for x in a[lo_a:hi_a]] + [_shown("+", x) for x in b[lo_b:hi_b]]
            at = hi_a
        body += [_shown(" ", x) for x in a[at:end_a]]
        n_a = end_a - first_a
        n_b = found[last][3] + end_a - found[last][1] - first_b
        header = f"@@ -{_side(first_a, n_a)} +{_side(first_b, n_b)} @@"
        out.append((first_a + bool(n_a), n_a, first_b + bool(n_b), n_b, f"{header}\n{''.join(body)}".removesuffix("\n")))
        k = last + 1
    return out


def patched(old: str | None, contents: list[str]) -> str:
    """The old text with hunks (their contents, in order) applied; raises where they do not fit."""
    a, out, at = lines(old), [], 0
    for content in contents:
        header, *body = content.split("\n")
        start, _, n = header.split(" ")[1][1:].partition(",")
        first = int(start) - (n != "0")
        out += a[at:first]
        at = first
        for k, line in enumerate(body):
            if line == NO_END:
                continue
            ended = k + 1 == len(body) or body[k + 1] != NO_END
            text = line[1:] + ("\n" if ended else "")
            if line[0] in " -":
                if at >= len(a) or a[at] != text:
                    raise ValueError(f"hunk does not fit at line {at + 1}")
                at += 1
            if line[0] in " +":
                out.append(text)
    return "".join(out + a[at:])


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, old_path, status, old and new of files (path, content) that differ between two
    versions: added, deleted, modified, or renamed (gone and come with the same content that is not
    empty, the first of each side by path where several have it)."""
    both = old.select("path", F.col("content").alias("old")).join(new.select("path", F.col("content").alias("new"), F.lit(True).alias("there")), "path", "full_outer")
    both = both.select("path", "old", "new", F.when(F.col("there").isNull(), "deleted").when(F.col("old").isNull(), "added").otherwise("modified").alias("status"))
    both = both.where(~F.col("old").eqNullSafe(F.col("new")))
    gone = both.where("status = 'deleted' and old <> ''").groupBy(F.sha2("old", 256).alias("digest")).agg(F.min("path").alias("old_path"))
    come = both.where("status = 'added' and new <> ''").groupBy(F.sha2("new", 256).alias("digest")).agg(F.min("path").alias("path"))
    moved = gone.join(come, "digest").select("path", "old_path")
    to = both.join(moved, "path", "left")
    to = to.select("path", "old_path", F.when(F.col("old_path").isNotNull(), "renamed").otherwise(F.col("status")).alias("status"), F.when(F.col("old_path").isNotNull(), F.col("new")).otherwise(F.col("old")).alias("old"), "new")
    return to.join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")


def hunks(pairs: DataFrame) -> DataFrame:
    """path, old_path, status, nth (from 1), both ranges and content of every hunk; a file without hunks (renamed, or empty) is one row without them."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            rows = []
            for path, old_path, status, old, new in frame.itertuples(index=False):
                found = unified(old, new)
                rows += [(path, old_path, status, k, *one) for k, one in enumerate(found, 1)] or [(path, old_path, status, None, None, None, None, None, None)]
            named = pd.DataFrame(rows, columns=[c.split()[0] for c in HUNKS.split(", ")])
            yield named.astype({c: "Int64" for c in ("nth", "old_first", "old_lines", "new_first", "new_lines")})

    return pairs.select("path", "old_path", "status", "old", "new").mapInPandas(f, HUNKS)


def text(found: DataFrame) -> DataFrame:
    """path, status, header (characters of it) and text: one unified diff for each file of ``hunks``."""
    before, after = F.coalesce("old_path", "path"), F.col("path")
    title = F.concat(F.lit("diff --git a/"), before, F.lit(" b/"), after)
    extra = (
        F.when(F.col("status") == "added", F.lit("\nnew file mode 100644"))
        .when(F.col("status") == "deleted", F.lit("\ndeleted file mode 100644"))
        .when(F.col("status") == "renamed", F.concat(F.lit("\nsimilarity index 100%\nrename from "), before, F.lit("\nrename to "), after))
        .otherwise(F.lit(""))
    )
    name = lambda gone, prefix, of: F.when(F.col("status") == gone, F.lit("/dev/null")).otherwise(F.concat(F.lit(prefix), of))
    sides = F.concat(F.lit("\n--- "), name("added", "a/", before), F.lit("\n+++ "), name("deleted", "b/", after))
    body = F.sort_array(F.collect_list(F.when(F.col("nth").isNotNull(), F.struct("nth", "content"))))
    each = found.groupBy("path", "old_path", "status").agg(body.alias("hunks"))
    header: Column = F.concat(title, extra, F.when(F.size("hunks") > 0, sides).otherwise(F.lit("")))
    whole = F.concat_ws("\n", F.col("head"), F.transform("hunks", lambda h: h["content"]))
    return each.select("path", "status", header.alias("head"), "hunks").select("path", "status", F.length("head").cast("long").alias("header"), F.concat(whole, F.lit("\n")).alias("text"))


def applied(old: DataFrame, found: DataFrame) -> DataFrame:
    """path and content after the diff ``found`` (rows of ``hunks``) on files (path, content):
    unchanged files stay, deleted ones go, renamed ones move."""
    each = F.transform(F.sort_array(F.collect_list(F.when(F.col("nth").isNotNull(), F.struct("nth", "content")))), lambda h: h["content"])
    told = found.groupBy("path", "old_path", "status").agg(each.alias("contents")).withColumn("from", F.coalesce("old_path", "path"))
    gone = told.select(F.col("from").alias("path")).distinct()
    rest = old.select("path", "content").join(gone, "path", "left_anti")
    base = old.select(F.col("path").alias("from"), F.col("content").alias("old"))
    changed = told.where("status <> 'deleted'").join(base, "from", "left").select("path", "old", "contents")

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            yield pd.DataFrame({"path": frame["path"], "content": [patched(o, list(c)) for o, c in zip(frame["old"], frame["contents"], strict=True)]})

    return rest.unionByName(changed.mapInPandas(f, "path string, content string"))
