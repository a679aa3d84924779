"""Agent transcripts: tool calls in replies, turn limits, retry counters; diffs and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = r"(?s)```tool\s*\n(.*?)```"


def tool_calls(replies: DataFrame) -> DataFrame:
    """conv_id, turn, idx, id, tool, args and error of the fenced calls in replies."""
    spread = replies.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(_BLOCK), F.lit(1))).alias("idx", "body"))
    field = lambda name: F.get_json_object("body", f"$.{name}")
    error = F.when(F.try_parse_json("body").isNull(), "INVALID_JSON").when(field("tool").isNull(), "MISSING_TOOL")
    return spread.select("conv_id", "turn", F.col("idx").cast("long").alias("idx"), field("id").alias("id"), field("tool").alias("tool"), field("args").alias("args"), error.alias("error"))


def tool_stats(calls: DataFrame) -> DataFrame:
    """tool, calls and failures; tool null for calls without one."""
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count("error").alias("failures"))


def turn_gate(turns: DataFrame, most_turns: int, most_chars: int) -> DataFrame:
    """conv_id, turn, nth, chars so far, and verdict: go, last (the final turn that may go) or stop."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    run = turns.select(
        "conv_id",
        "turn",
        F.row_number().over(order).cast("long").alias("nth"),
        F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("chars"),
    )
    verdict = F.when((F.col("nth") > most_turns) | (F.col("chars") > most_chars), "stop").when(F.col("nth") == most_turns, "last").otherwise("go")
    return run.withColumn("verdict", verdict)


def failure_counts(events: DataFrame, failed) -> DataFrame:
    """event_id, user_id and nth: running count of each user's failures."""
    bad = events.where(failed)
    return bad.select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("nth"))


def parse_diff(diffs: DataFrame) -> DataFrame:
    """diff_id, path, old_path, status, binary, hunks, additions and deletions of unified diffs (diff_id, text)."""
    sections = diffs.select("diff_id", F.explode(F.split("text", r"(?m)^(?=diff --git )")).alias("s")).where(F.col("s").startswith("diff --git "))
    get = lambda pattern: F.nullif(F.regexp_extract("s", pattern, 1), F.lit(""))
    new = F.coalesce(get(r"(?m)^\+\+\+ b/(.+)$"), get(r"(?m)^rename to (.+)$"), get(r"(?m)^diff --git a/.+ b/(.+)$"))
    old = F.coalesce(get(r"(?m)^rename from (.+)$"), get(r"(?m)^copy from (.+)$"))
    binary = F.col("s").rlike(r"(?m)^(Binary files |GIT binary patch)")
    status = (
        F.when(F.col("s").rlike(r"(?m)^new file mode"), "added")
        .when(F.col("s").rlike(r"(?m)^deleted file mode"), "deleted")
        .when(F.col("s").rlike(r"(?m)^rename from"), "renamed")
        .when(F.col("s").rlike(r"(?m)^copy from"), "copied")
        .otherwise("modified")
    )
    path = F.when(status == "deleted", get(r"(?m)^--- a/(.+)$")).otherwise(new)
    count = lambda pattern: F.regexp_count("s", F.lit(pattern)).cast("long")
    return sections.select(
        "diff_id",
        F.coalesce(path, new).alias("path"),
        old.alias("old_path"),
        status.alias("status"),
        binary.alias("binary"),
        count(r"(?m)^@@ ").alias("hunks"),
        count(r"(?m)^\+(?!\+\+ )").alias("additions"),
        count(r"(?m)^-(?!-- )").alias("deletions"),
    )


def parse_status(texts: DataFrame) -> DataFrame:
    """status_id, path and status of porcelain v2 lines (status_id, text)."""
    lines = texts.select("status_id", F.explode(F.split("text", "\n")).alias("l"))
    code, kind = F.substring("l", 3, 2), F.substring("l", 1, 1)
    status = (
        F.when(kind == "?", "untracked")
        .when(kind == "u", "conflicted")
        .when(kind == "2", "renamed")
        .when(F.contains(code, F.lit("A")), "added")
        .when(F.contains(code, F.lit("D")), "deleted")
        .otherwise("modified")
    )
    path = (
        F.when(kind == "?", F.substring("l", 3, 100_000))
        .when(kind == "1", F.regexp_extract("l", r"^1 (?:\S+ ){7}(.+)$", 1))
        .when(kind == "2", F.regexp_extract("l", r"^2 (?:\S+ ){8}([^\t]+)", 1))
        .when(kind == "u", F.regexp_extract("l", r"^u (?:\S+ ){9}(.+)$", 1))
    )
    return lines.where(F.col("l").rlike("^[12u?] ")).select("status_id", path.alias("path"), status.alias("status"))


def parse_hunks(diffs: DataFrame) -> DataFrame:
    """diff_id, path, nth, first lines and counts of both sides, and content of the hunks of
    unified diffs (diff_id, text)."""
    sections = diffs.select("diff_id", F.explode(F.split("text", r"(?m)^(?=diff --git )")).alias("s")).where(F.col("s").startswith("diff --git "))
    get = lambda pattern: F.nullif(F.regexp_extract("s", pattern, 1), F.lit(""))
    path = F.coalesce(get(r"(?m)^\+\+\+ b/(.+)$"), get(r"(?m)^--- a/(.+)$"), get(r"(?m)^diff --git a/.+ b/(.+)$"))
    parts = sections.select("diff_id", path.alias("path"), F.posexplode(F.split("s", r"(?m)^(?=@@ )")).alias("nth", "content")).where(F.col("content").startswith("@@ "))
    number = lambda k: F.coalesce(F.expr(f"try_cast(regexp_extract(content, r'^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', {k}) as bigint)"), F.lit(1))
    names = ("old_first", "old_lines", "new_first", "new_lines")
    return parts.select(
        "diff_id", "path", F.col("nth").cast("long").alias("nth"), *[number(k).cast("long").alias(n) for k, n in enumerate(names, 1)], F.regexp_replace("content", r"\n$", "").alias("content")
    )


def branch_header(texts: DataFrame) -> DataFrame:
    """status_id, branch, upstream, ahead and behind of porcelain v2 texts."""
    get = lambda pattern: F.nullif(F.trim(F.regexp_extract("text", pattern, 1)), F.lit(""))
    head = F.coalesce(get(r"(?m)^# branch\.head (.*)$"), F.lit("HEAD"))
    count = lambda pattern: F.coalesce(get(pattern).cast("long"), F.lit(0).cast("long"))
    return texts.select(
        "status_id",
        F.when(head == "(detached)", "HEAD (detached)").otherwise(head).alias("branch"),
        get(r"(?m)^# branch\.upstream (.*)$").alias("upstream"),
        count(r"(?m)^# branch\.ab \+(\d+) -\d+$").alias("ahead"),
        count(r"(?m)^# branch\.ab \+\d+ -(\d+)$").alias("behind"),
    )


def status_text(headers: DataFrame) -> DataFrame:
    """status_id and text of branch headers."""
    ahead = F.concat(F.lit("upstream: "), "upstream", F.lit(" (ahead "), "ahead", F.lit(", behind "), "behind", F.lit(")"))
    return headers.select("status_id", F.concat_ws("\n", F.concat(F.lit("branch: "), "branch"), ahead, F.lit("changes: omitted")).alias("text"))


def diff_text(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """diff_id and text of parsed diffs: a title and the hunks of each file, by path."""
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "content"))), lambda h: h["content"]), "\n")
    own = hunks.groupBy("diff_id", "path").agg(each.alias("body"))
    titled = files.join(own, ["diff_id", "path"], "left").select(
        "diff_id", F.struct("path", F.concat(F.lit("--- "), "path", F.lit(" ["), "status", F.lit("] ---\n"), F.coalesce("body", F.lit("(no textual hunks)"))).alias("x")).alias("f")
    )
    return titled.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["x"]), "\n").alias("text"))
