"""Selections under a budget: modes, priorities, constraints, the degradation ladder, patch caps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import line_range, lines_of, matches_any
from corpusmill.operators import slices

# How many ranked files are taken in each mode, and limits of a selection.
QUOTAS = (("full", 8), ("slices", 15), ("codemap_only", 30))
MOST_FILES, MOST_FULL, MOST_BYTES = 80, 10, 1_500_000
CODEMAP_TOKENS = 220


def modes(ranked: DataFrame, sizes: DataFrame, quotas=QUOTAS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, mode and priority of the first ranked files (score, raw, path); too large ones are sliced."""
    most = sum(n for _, n in quotas)
    top = ranked.orderBy(F.desc("score"), F.desc("raw"), "path").limit(most)
    nth = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("raw"), "path"))  # over the top rows alone
    upto, mode = 0, F.lit(None).cast("string")
    for name, n in reversed(quotas):
        mode = F.when(F.col("nth") <= most - upto, name).otherwise(mode)
        upto += n
    taken = top.withColumn("nth", nth).join(sizes.select("path", "size"), "path").withColumn("mode", mode)
    taken = taken.withColumn("mode", F.when((F.col("mode") == "full") & (F.col("size") > most_bytes), "slices").otherwise(F.col("mode")))
    priority = F.when(F.col("mode") == "full", "core").when(F.col("mode") == "slices", "support").otherwise("ref")
    return taken.select("path", F.col("nth").cast("long").alias("nth"), "size", "mode", priority.alias("priority"))


def suggested_modes(ranked: DataFrame, quotas=QUOTAS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, mode and priority of the first ranked files (score, raw, path, size, hint) in
    order: the mode that a review suggests while its quota lasts, else full, slices or
    codemap, whichever is first to be free; too large files are never full. Ends at the first file
    without a free mode, so no more files than all quotas together are looked at, in one task."""
    limits = dict(quotas)

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, open_ = dict(limits), True
        for batch in batches:
            rows = []
            for path, size, hint in zip(batch["path"], batch["size"], batch["hint"], strict=True):
                free = [m for m in limits if left[m] > 0 and not (m == "full" and size > most_bytes)]
                mode = hint if hint in free and hint != "codemap_only" else free[0] if free else None
                open_ = open_ and mode is not None
                if open_:
                    left[mode] -= 1
                    rows.append((path, mode, {"full": "core", "slices": "support"}.get(mode, "ref")))
            yield pd.DataFrame(rows, columns=["path", "mode", "priority"])

    top = ranked.orderBy(F.desc("score"), F.desc("raw"), "path").limit(sum(limits.values())).select("path", F.coalesce("size", F.lit(0)).alias("size"), "hint")
    return top.coalesce(1).mapInPandas(chosen, "path string, mode string, priority string")


def patch_marker(files: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: the text on what a patch cap left out; null if nothing. files: path, tokens;
    kept: path, tokens."""
    both = files.join(kept.select("path", F.col("tokens").alias("kept")), "path", "left")
    n = both.agg(F.count_if(F.col("kept").isNull()).alias("files"), F.sum(F.col("tokens") - F.coalesce("kept", F.lit(0))).alias("tokens"))
    said = F.concat(F.lit("... ‹TRUNCATED: "), "files", F.lit(" more files, ~"), "tokens", F.lit(" tokens›"))
    return n.select(F.when(F.col("tokens") > 0, said).alias("marker"))


def priority_scores(selection: DataFrame, signals: DataFrame, review: bool = False) -> DataFrame:
    """path and score from signals: path, explicit, mentioned, changed (booleans), hits, hops (null: unreachable)."""
    most = signals.agg(F.max("hits")).first()[0] or 0
    entry = F.col("path").rlike(r"(^|/)(main|index|app|routes|server|cli)(\.[^/]*)?$")
    boost = F.when(F.col("priority") == "core", 50).when(F.col("priority") == "support", 25).otherwise(0)
    hits = F.floor(F.col("hits") * 200 / most) if most else F.lit(0)
    score = (
        F.when(F.col("explicit"), 1000).otherwise(0)
        + F.when(F.col("mentioned"), 500).otherwise(0)
        + F.when(F.col("changed"), 400 if review else 100).otherwise(0)
        + F.when(entry, 300).otherwise(0)
        + hits
        + F.coalesce(F.floor(F.lit(150) / (F.col("hops") + 1)), F.lit(0))
        + boost
    )
    return selection.join(signals, "path").select("path", score.cast("long").alias("score"))


def constrained(entries: DataFrame, most_files: int = MOST_FILES, most_full: int = MOST_FULL, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Entries (path, mode, size, score) within hard limits: too large ones go, then the full
    files of least score are sliced, then the entries of least score go."""
    fine = entries.where(F.col("size") <= most_bytes)
    best = fine.where(F.col("mode") == "full").orderBy(F.desc("score"), F.desc("path")).limit(most_full).select("path", F.lit(True).alias("stays"))
    sliced = fine.join(best, "path", "left").withColumn(
        "mode", F.when((F.col("mode") == "full") & F.col("stays").isNull(), "slices").otherwise(F.col("mode"))
    )
    return sliced.select("path", "mode", "size", "score").orderBy(F.desc("score"), F.desc("path")).limit(most_files)


def with_slices(entries: DataFrame, intervals: DataFrame, most_slices: int, **limits: int) -> tuple[DataFrame, DataFrame]:
    """``constrained`` entries, and the intervals (path, first, last) of those in slices: merged
    where they touch, and joined, closest first, to ``most_slices`` a file."""
    kept = constrained(entries, **limits)
    own = intervals.join(kept.where(F.col("mode") == "slices").select("path"), "path", "left_semi")
    return kept, slices.capped(slices.merged(own), most_slices)


def files_section(entries: DataFrame, intervals: DataFrame, files: DataFrame) -> DataFrame:
    """path, mode, nth, first, last and text of what a selection shows: full files whole, of
    sliced ones a row for each interval (its lines clamped to what the file has), of others no text."""
    shown = entries.select("path", "mode").join(files.select("path", "content"), "path", "left")
    nth = F.row_number().over(Window.partitionBy("path").orderBy("first", "last")).cast("long")
    cut = shown.where(F.col("mode") == "slices").join(intervals.select("path", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), nth.alias("nth")), "path")
    text = line_range(lines_of(F.col("content")), F.col("first"), F.col("last"))
    none = F.lit(None).cast("int")
    whole = shown.where(F.col("mode") != "slices").select("path", "mode", F.lit(None).cast("long").alias("nth"), none.alias("first"), none.alias("last"), F.when(F.col("mode") == "full", F.col("content")).alias("text"))
    return whole.unionByName(cut.select("path", "mode", "nth", "first", "last", text.alias("text")))


def ladder(entries: DataFrame, budget: int) -> DataFrame:
    """ord, path, step, delta and total of the degradation steps needed to fit the budget.

    ``entries``: path, mode, score, full_tokens, slice_tokens. Steps in order: full files to
    slices, slices to codemaps, codemaps dropped, each from the least score up. A step is
    taken while no total before it fits the budget. A selection is bounded by its
    quotas, so the running sum stands in one window."""
    cost = F.when(F.col("mode") == "full", F.col("full_tokens")).when(F.col("mode") == "slices", F.col("slice_tokens")).otherwise(CODEMAP_TOKENS)
    steps = F.array(
        F.when(F.col("mode") == "full", F.struct(F.lit(1).alias("phase"), F.lit("full_to_slices").alias("step"), (F.col("slice_tokens") - F.col("full_tokens")).alias("delta"))),
        F.when(F.col("mode") != "codemap_only", F.struct(F.lit(2).alias("phase"), F.lit("slices_to_codemap").alias("step"), (F.lit(CODEMAP_TOKENS) - F.col("slice_tokens")).alias("delta"))),
        F.struct(F.lit(3).alias("phase"), F.lit("drop_codemap").alias("step"), F.lit(-CODEMAP_TOKENS).cast("long").alias("delta")),
    )
    whole = entries.agg(F.sum(cost)).first()[0] or 0
    table = entries.select("path", "score", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("path", "score", "s.*")
    order = Window.orderBy("phase", "score", "path")
    table = table.withColumn("ord", F.row_number().over(order).cast("long"))
    table = table.withColumn("total", (F.lit(whole) + F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
    # A step may raise the total, so what counts is the least total before it.
    before = F.least(F.lit(whole), F.min("total").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    table = table.withColumn("before", before)
    return table.where(F.col("before") > budget).select("ord", "path", "step", F.col("delta").cast("long").alias("delta"), "total")


#: What a selection's parts cost beside its files, and the tree at each verbosity.
TREE = ("full", "selected", "none")
SLICE_CONTEXT = (30, 20, 10)


def full_ladder(entries: DataFrame, budget: int, reserve: int = 0, fixed: int = 0, tree: dict[str, int] | None = None, verbosity: str = "full") -> DataFrame:
    """ord, path, step, reason, delta and total of all six kinds of degradation, in order:
    full files to slices, slices to codemaps, codemaps dropped (each from the least score
    up), codemap detail from complete to summary by path, slice context from 30 to 20 to 10,
    tree listing from full to selected to none. Steps are taken while the least total before
    them exceeds the budget less the reserve.

    ``entries``: path, mode, score, full_tokens, slice_tokens, detail. By the fourth kind no
    entry is left, so only steps of the tree still change the total. A selection is bounded
    by its quotas, so one window holds all steps."""
    spark, tree = entries.sparkSession, tree or {}
    fit = max(0, budget - reserve)
    path = F.col("path")
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    # Names and reasons of the steps, which a replay reads back.
    step = lambda phase, name, reason, delta: F.struct(F.lit(phase).alias("phase"), F.lit(name).alias("step"), reason.alias("reason"), delta.cast("long").alias("delta"))
    steps = F.array(
        F.when(F.col("mode") == "full", step(1, "full_to_slices", said("degrade ", path, " full->slices"), F.col("slice_tokens") - F.col("full_tokens"))),
        F.when(F.col("mode") != "codemap_only", step(2, "slices_to_codemap_only", said("degrade ", path, " slices->codemap_only"), F.lit(CODEMAP_TOKENS) - F.col("slice_tokens"))),
        step(3, "drop_codemap_only", said("drop ", path, " codemap_only"), F.lit(-CODEMAP_TOKENS)),
        F.when(F.coalesce("detail", F.lit("complete")) == "complete", step(4, "codemap_complete_to_summary", said("shrink codemap detail for ", path, " complete->summary"), F.lit(0))),
    )
    table = entries.select("path", "score", F.inline(F.filter(steps, lambda s: s.isNotNull())))
    table = table.withColumn("score", F.when(F.col("phase") == 4, 0).otherwise(F.col("score")).cast("long"))
    late = [(5, k, "shrink_slice_windows", f"shrink slice context +/-{a}->+/-{b}", 0) for k, (a, b) in enumerate(zip(SLICE_CONTEXT, SLICE_CONTEXT[1:], strict=False))]
    shown = TREE[TREE.index(verbosity) :]
    late += [(6, k, "reduce_tree_verbosity", f"reduce tree verbosity {a}->{b}", tree.get(b, 0) - tree.get(a, 0)) for k, (a, b) in enumerate(zip(shown, shown[1:], strict=False))]
    more = spark.createDataFrame(late, "phase int, score long, step string, reason string, delta long").withColumn("path", F.lit(None).cast("string"))
    cost = F.when(F.col("mode") == "full", F.col("full_tokens")).when(F.col("mode") == "slices", F.col("slice_tokens")).otherwise(CODEMAP_TOKENS)
    whole = (entries.agg(F.sum(cost)).first()[0] or 0) + fixed + tree.get(verbosity, 0)
    order = Window.orderBy("phase", "score", "path")
    table = table.unionByName(more).withColumn("ord", F.row_number().over(order).cast("long"))
    table = table.withColumn("total", (F.lit(whole) + F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
    before = F.least(F.lit(whole), F.min("total").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return table.withColumn("before", before).where(F.col("before") > fit).select("ord", "path", "step", "reason", "delta", "total")


def replayed(steps: DataFrame) -> DataFrame:
    """ord, action, path, before, after and saved of degradation rows, read from their reasons."""
    get = lambda pattern, k: F.nullif(F.regexp_extract("reason", pattern, k), F.lit(""))
    degrade, drop = r"^degrade (.+) ([a-z_]+)->([a-z_]+)$", r"^drop (.+) codemap_only$"
    detail, context, listing = r"^shrink codemap detail for (.+) complete->summary$", r"^shrink slice context (\S+)->(\S+)$", r"^reduce tree verbosity ([a-z_]+)->([a-z_]+)$"
    at = lambda pattern: F.col("reason").rlike(pattern)
    return steps.select(
        "ord",
        F.col("step").alias("action"),
        F.coalesce(get(degrade, 1), get(drop, 1), get(detail, 1)).alias("path"),
        F.when(at(drop), "codemap_only").when(at(detail), "complete").otherwise(F.coalesce(get(degrade, 2), get(context, 1), get(listing, 1))).alias("before"),
        F.when(at(detail), "summary").otherwise(F.coalesce(get(degrade, 3), get(context, 2), get(listing, 2))).alias("after"),
        F.col("delta").alias("saved"),
    )


def token_report(entries: DataFrame, sections: dict[str, int]) -> DataFrame:
    """part, name and tokens: of each file, of each section, of the files of each mode with
    their number, and in total. ``entries``: path, mode, tokens."""
    row = lambda df, part, name, tokens, n: df.select(F.lit(part).alias("part"), name.alias("name"), tokens.cast("long").alias("tokens"), n.cast("long").alias("files"))
    files = row(entries, "file", F.col("path"), F.col("tokens"), F.lit(1))
    modes = entries.groupBy("mode").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    given = entries.sparkSession.createDataFrame(sorted(sections.items()), "name string, tokens long")
    every = row(given, "section", F.col("name"), F.col("tokens"), F.lit(0)).unionByName(row(entries.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count("*").alias("n")), "section", F.lit("files"), F.col("t"), F.col("n")))
    total = row(every.agg(F.sum("tokens").alias("t"), F.sum("files").alias("n")), "total", F.lit("total"), F.col("t"), F.col("n"))
    return files.unionByName(row(modes, "mode", F.col("mode"), F.col("t"), F.col("n"))).unionByName(every).unionByName(total)


def estimated(entries: DataFrame, chars_per_token: float = 3.5) -> DataFrame:
    """path and tokens by metadata alone: the size of full files, 80 characters a line of
    slices, 120 tokens a codemap. ``entries``: path, mode, size, slices (array of first, last)."""
    spread = F.aggregate("slices", F.lit(0).cast("long"), lambda acc, s: acc + F.greatest(F.lit(1), s["last"] - s["first"] + 1))
    n = F.when(F.col("mode") == "full", F.ceil(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)) / chars_per_token)).when(F.col("mode") == "codemap_only", 120)
    return entries.select("path", n.otherwise(F.ceil(F.coalesce(spread, F.lit(0)) * 80 / chars_per_token)).cast("long").alias("tokens"))


def admitted(requests: DataFrame, most_files: int = MOST_FILES, most_full: int = MOST_FULL, most_bytes: int = MOST_BYTES) -> DataFrame:
    """session, ord, path, mode and error of requests to add files, each judged after those before it:
    a path already there is replaced and needs no further place. Requests that fail on their
    own (invalid, never included, binary, too large) never enter; the rest of a session are folded in
    order, with a state that the caps bound. requests: session, ord, path, mode, size, never, binary."""
    bad = F.trim(F.coalesce("path", F.lit(""))) == ""
    bad = bad | ~F.coalesce(F.col("mode").isin("full", "slices", "codemap_only"), F.lit(False))
    alone = (
        F.when(bad, "INVALID_SELECTION_ENTRY")
        .when(F.coalesce("never", F.lit(False)), "NEVER_INCLUDE_MATCH")
        .when(F.coalesce("binary", F.lit(False)), "BINARY_FILE_EXCLUDED")
        .when(F.col("size") > most_bytes, "FILE_TOO_LARGE")
    )
    judged = requests.withColumn("error", alone)
    columns = "session", "ord", "path", "mode", "error"

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, held = None, {}
        for batch in batches:
            errors = []
            for who, path, mode in zip(batch["session"], batch["path"], batch["mode"], strict=True):
                if who != session:
                    session, held = who, {}
                full = sum(m == "full" for p, m in held.items() if p != path) + (mode == "full")
                if path not in held and len(held) >= most_files:
                    errors.append("MAX_FILES_EXCEEDED")
                elif full > most_full:
                    errors.append("MAX_FULL_FILES_EXCEEDED")
                else:
                    errors.append(None)
                    held[path] = mode
            yield batch.assign(error=errors)[list(columns)]

    fine = judged.where("error is null").select(*columns).repartition("session").sortWithinPartitions("session", "ord")
    return fine.mapInPandas(folded, fine.schema).unionByName(judged.where("error is not null").select(*columns))


def explicit(files: DataFrame, includes: DataFrame, entrypoints: DataFrame, globs=()) -> DataFrame:
    """The files asked for by name, as an entry point, or by a glob, each once."""
    named = includes.select("path").unionByName(entrypoints.select("path"))
    if globs:
        named = named.unionByName(files.where(matches_any(F.col("path"), list(globs))).select("path"))
    return named.distinct()


def path_numbers(rows: DataFrame) -> DataFrame:
    """path (lower case) and value (whole) of the finite values of zero or more; of paths alike but for case the last by name counts."""
    fine = rows.where("value is not null and not isnan(value) and value >= 0 and value < double('infinity')")
    return fine.groupBy(F.lower("path").alias("path")).agg(F.max_by(F.floor("value"), F.struct("path", "value")).alias("value"))


def rationale(scores: DataFrame) -> DataFrame:
    """path and text on why a file was ranked: score, hits, and the boosts that it got."""
    boost = lambda name: F.when(F.col(name) > 0, F.concat(F.lit(f"{name}="), F.col(name)))
    said = F.concat_ws(
        ", ",
        F.concat(F.lit("offline score="), "score"),
        F.concat(F.lit("content_hits="), "content_hits"),
        F.concat(F.lit("path_hits="), "path_hits"),
        *[boost(b) for b in ("import_boost", "entrypoint_boost", "git_bias")],
    )
    return scores.select("path", said.alias("rationale"))


def patch_cap(files: DataFrame, hunks: DataFrame, budget: int, most_files: int) -> DataFrame:
    """path, hunks and tokens kept of patches in order of relevance: whole files while they
    fit (those without hunks by their header alone), then the longest prefix of hunks of
    the first that does not.

    files: path, relevance, header (characters); hunks: path, ord, chars. A kept file has a
    token at least, so no more than ``most_files`` rows enter the window over all."""
    sized = hunks.groupBy("path").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    every = files.join(sized, "path", "left").fillna(0, ["chars", "n"])
    top = every.orderBy(F.desc("relevance"), F.desc("chars"), "path").limit(most_files)
    tokens = F.ceil((F.col("header") + F.col("chars")) / 3.5).cast("long")
    order = Window.orderBy(F.desc("relevance"), F.desc("chars"), "path")
    run = top.withColumn("tokens", tokens).withColumn("upto", F.sum("tokens").over(order)).withColumn("nth", F.row_number().over(order))
    fits = run.where(F.col("upto") <= budget).select("path", F.col("n").alias("hunks"), "tokens", "nth")
    first = run.where(F.col("upto") > budget).orderBy("nth").limit(1).select("path", "header", (F.lit(budget) - F.col("upto") + F.col("tokens")).alias("left"), "nth")
    within = Window.partitionBy("path").orderBy("ord", "chars").rowsBetween(Window.unboundedPreceding, 0)
    part = hunks.join(first, "path").withColumn("cost", F.ceil((F.col("header") + F.sum("chars").over(within)) / 3.5).cast("long"))
    cut = part.where("cost <= left").groupBy("path", "nth").agg(F.count("*").alias("hunks"), F.max("cost").alias("tokens"))
    return fits.unionByName(cut.select("path", "hunks", "tokens", "nth")).select("path", F.col("hunks").cast("long").alias("hunks"), "tokens")


def data_flows(edges: DataFrame, selected: DataFrame, limit: int = 20) -> DataFrame:
    """src and dst of import edges between selected files."""
    both = edges.where("src <> dst").select("src", "dst").distinct()
    both = both.join(selected.select(F.col("path").alias("src")), "src", "left_semi").join(selected.select(F.col("path").alias("dst")), "dst", "left_semi")
    return both.select("src", "dst").orderBy("src", "dst").limit(limit)


def keep_first(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Rows (path, mode, priority) of the first, then those of the second with other paths."""
    rank = F.when(F.col("priority") == "core", 0).when(F.col("priority") == "support", 1).otherwise(2)
    more = second.join(first.select("path"), "path", "left_anti")
    every = first.select("path", "mode", "priority", F.lit(0).alias("source")).unionByName(more.select("path", "mode", "priority", F.lit(1).alias("source")))
    return every.orderBy("source", rank, "mode", "path").limit(limit).select("path", "mode", "priority", F.col("source").cast("long").alias("source"))


def summary(selection: DataFrame) -> DataFrame:
    """One row of counts by mode and priority, zeros kept."""
    count = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return selection.agg(*[count("mode", m) for m, _ in QUOTAS], *[count("priority", p) for p in ("core", "support", "ref")])


def last_events(events: DataFrame) -> DataFrame:
    """The state of an edited selection: the last event of each path (ord), but for removed
    ones and those before the last clear."""
    cleared = F.max(F.when(F.col("action") == "clear", F.col("ord")))
    upto = events.agg(F.coalesce(cleared, F.lit(-1))).first()[0]
    live = events.where((F.col("ord") > upto) & F.col("path").isNotNull())
    last = live.groupBy("path").agg(F.max_by(F.struct("action", "mode"), "ord").alias("e"))
    return last.where("e.action <> 'remove'").select("path", "e.mode")
