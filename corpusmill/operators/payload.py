"""Final payloads of agents: parsing, checks against the files, recovery, and what a failure leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import is_test_path

MODES, PRIORITIES = ("full", "slices", "codemap_only"), ("core", "support", "ref")
_SLICE = "array<struct<start_line:string,end_line:string,description:string,rationale:string>>"
_NOTES = "array<struct<path:string,notes:string>>"
PAYLOAD = (
    "struct<open_questions:array<struct<question:string,why_it_matters:string,default_assumption:string>>,"
    f"handoff_summary:struct<entrypoints:{_NOTES},key_modules:{_NOTES},data_flows:array<struct<name:string,notes:string>>,"
    f"config_knobs:array<struct<key:string,`where`:string,notes:string>>,tests:{_NOTES}>,"
    f"selection:array<struct<path:string,mode:string,priority:string,rationale:string,slices:{_SLICE}>>>"
)


# What is told of a payload that is wrong, and of a selection that was recovered.
NO_BLOCK, NO_OBJECT, NO_ARRAY, NO_ITEMS = "missing block", "must be an object", "must be an array", "must be a non-empty array"
BLANK, NO_COUNT, ODD_PATH = "must be a non-empty string", "must be a positive integer", "must be a valid repo-relative path"
ODD_MODE, ODD_PRIORITY = "must be one of: full, slices, codemap_only", "must be one of: core, support, ref"
LOST_SLICES, DERIVED, SEEN_TEST = "; slices unavailable during fallback", "derived from partial selection (", "test file observed in partial selection"


def repo_path(path: Column) -> Column:
    """Forward slashes, single, none at the end, without leading ``./``."""
    path = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./+", "")
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/+$", "")


def final_payloads(replies: DataFrame, fence: str = "final") -> DataFrame:
    """conv_id, payload and error (missing or malformed) of the last fenced block of each reply text."""
    blocks = F.regexp_extract_all("text", F.lit(rf"(?s)```{fence}\s*(.*?)```"), F.lit(1))
    # Each step is named before the next takes it more than once, so that texts are searched and parsed once.
    rows = replies.select("conv_id", F.col("text").isNull().alias("none"), F.get(F.reverse(blocks), F.lit(0)).alias("body"))
    rows = rows.select("conv_id", "none", "body", (F.try_parse_json("body").isNotNull() & F.trim("body").startswith("{")).alias("fine"))
    error = F.when(~F.col("none") & F.col("body").isNull(), NO_BLOCK).when(~F.col("fine"), NO_OBJECT)
    return rows.select("conv_id", F.from_json(F.when(F.col("fine"), F.col("body")), PAYLOAD).alias("payload"), error.alias("error"))


def _whole(value: Column) -> Column:
    """A positive whole number, else null."""
    return F.when(value.rlike("^[1-9][0-9]{0,8}$"), value.cast("long"))


def _issue(field: Column, wrong: Column, message: Column | str) -> Column:
    return F.when(wrong, F.struct(field.alias("field"), (F.lit(message) if isinstance(message, str) else message).alias("message")))


def _empty(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit(""))) == ""


def issues(payloads: DataFrame, files: DataFrame) -> DataFrame:
    """conv_id, field and message of all that is wrong with payloads; sound ones have no row."""
    p = F.col("payload")
    blank, kind = BLANK, NO_ARRAY

    def listed(items: Column, name: str, *fields: str) -> Column:
        """Issues of a list whose items need texts."""
        each = F.transform(
            items, lambda x, i: F.array(*[_issue(F.concat(F.lit(f"{name}["), i, F.lit(f"].{f}")), _empty(x[f]), blank) for f in fields])
        )
        return F.when(items.isNull(), F.array(_issue(F.lit(name), F.lit(True), kind))).otherwise(F.flatten(each))

    def of_entry(x: Column, i: Column) -> Column:
        at = lambda f: F.concat(F.lit("selection["), i, F.lit(f"].{f}"))
        whole = ~(_empty(x["path"]) | _empty(x["mode"]) | _empty(x["priority"]) | _empty(x["rationale"]))
        path, known = x["given"], x["mode"].isin(*MODES)
        # Checks end at the first that makes the rest pointless.
        on = whole & (path != "")

        def of_slice(s: Column, k: Column) -> Column:
            here = lambda f: F.concat(at("slices["), k, F.lit(f"].{f}"))
            a, b = _whole(s["start_line"]), _whole(s["end_line"])
            return F.array(
                _issue(here("start_line"), a.isNull(), NO_COUNT),
                _issue(here("end_line"), b.isNull(), NO_COUNT),
                _issue(here("description"), _empty(s["description"]), blank),
                _issue(here("end_line"), F.coalesce(b < a, F.lit(False)), "must be >= start_line"),
            )

        sliced = on & known & x["priority"].isin(*PRIORITIES) & (x["mode"] == "slices")
        none = F.array(F.lit(None).cast("struct<field:string,message:string>"))
        lines = F.when(sliced & (F.coalesce(F.size(x["slices"]), F.lit(0)) > 0), F.flatten(F.transform(x["slices"], of_slice))).otherwise(none)
        own = F.array(
            *[_issue(at(f), _empty(x[f]), blank) for f in ("path", "mode", "priority", "rationale")],
            _issue(at("path"), whole & (path == ""), ODD_PATH),
            _issue(at("mode"), on & ~known, ODD_MODE),
            _issue(at("priority"), on & known & ~x["priority"].isin(*PRIORITIES), ODD_PRIORITY),
            _issue(at("slices"), sliced & (F.coalesce(F.size(x["slices"]), F.lit(0)) <= 0), NO_ITEMS),
        )
        return F.concat(own, lines)

    chosen, summary = p["selection"], p["handoff_summary"]
    chosen = F.transform(chosen, lambda x: F.struct(*[x[f].alias(f) for f in ("path", "mode", "priority", "rationale", "slices")], repo_path(x["path"]).alias("given")))
    entries = F.when(p["selection"].isNull(), F.array(_issue(F.lit("selection"), F.lit(True), kind))).otherwise(F.flatten(F.transform(chosen, of_entry)))
    notes = F.concat(
        *[listed(summary[f], f"handoff_summary.{f}", "path", "notes") for f in ("entrypoints", "key_modules", "tests")],
        listed(summary["data_flows"], "handoff_summary.data_flows", "name", "notes"),
        listed(summary["config_knobs"], "handoff_summary.config_knobs", "key", "where", "notes"),
    )
    every = F.concat(
        listed(p["open_questions"], "open_questions", "question", "why_it_matters", "default_assumption"),
        F.when(summary.isNull(), F.array(_issue(F.lit("handoff_summary"), F.lit(True), NO_OBJECT))).otherwise(notes),
        entries,
    )
    whole = F.array(_issue(F.lit("final"), F.col("error").isNotNull(), F.col("error")))
    found = payloads.select("conv_id", F.explode(F.when(F.col("error").isNotNull(), whole).otherwise(every)).alias("x")).where("x is not null")
    asked = payloads.where("error is null").select("conv_id", F.posexplode("payload.selection").alias("i", "e"))
    asked = asked.select("conv_id", "i", repo_path(F.col("e.path")).alias("path")).where("path <> ''")
    absent = asked.join(files.select("path").distinct(), "path", "left_anti")
    said = absent.select("conv_id", F.concat(F.lit("selection["), "i", F.lit("].path")).alias("field"), F.concat(F.lit("path does not exist in repo: "), "path").alias("message"))
    return found.select("conv_id", "x.field", "x.message").unionByName(said)


def selections(payloads: DataFrame, wrong: DataFrame) -> DataFrame:
    """conv_id, path, mode, priority, rationale and slices of the payloads without issues."""
    sound = payloads.where("error is null").join(wrong.select("conv_id").distinct(), "conv_id", "left_anti")
    rows = sound.select("conv_id", F.explode("payload.selection").alias("e"))
    cut = F.transform("e.slices", lambda s: F.struct(_whole(s["start_line"]).alias("first"), _whole(s["end_line"]).alias("last")))
    return rows.select("conv_id", repo_path(F.col("e.path")).alias("path"), "e.mode", "e.priority", "e.rationale", F.when(F.col("e.mode") == "slices", cut).alias("slices"))


def recovered(listings: DataFrame) -> DataFrame:
    """conv_id, path, mode, priority, rationale and slices from the text of a selection's
    listing (conv_id, text: JSON with view ``files``): the first entry of each path with a
    known mode; slices without any sound range become a codemap."""
    schema = f"struct<view:string,files:array<struct<path:string,mode:string,priority:string,rationale:string,slices:{_SLICE}>>>"
    rows = listings.select("conv_id", F.from_json("text", schema).alias("x")).where("x.view = 'files'").select("conv_id", F.posexplode("x.files").alias("i", "e"))
    known = rows.where(F.col("e.mode").isin(*MODES) & ~_empty(F.col("e.path")))
    path = repo_path(F.trim("e.path"))
    first = known.groupBy("conv_id", path.alias("path")).agg(F.min_by("e", "i").alias("e"))
    rationale = F.when(_empty(F.col("e.rationale")), "recovered from the selection").otherwise(F.col("e.rationale"))
    ranges = F.transform("e.slices", lambda s: F.struct(_whole(s["start_line"]).alias("first"), _whole(s["end_line"]).alias("last")))
    ranges = F.filter(F.coalesce(ranges, F.array().cast("array<struct<first:bigint,last:bigint>>")), lambda s: s["first"] <= s["last"])
    lost = (F.col("e.mode") == "slices") & (F.size(ranges) == 0)
    return first.select(
        "conv_id",
        "path",
        F.when(lost, "codemap_only").otherwise(F.col("e.mode")).alias("mode"),
        F.when(F.col("e.priority").isin(*PRIORITIES), F.col("e.priority")).otherwise("support").alias("priority"),
        F.when(lost, F.concat(rationale, F.lit(LOST_SLICES))).otherwise(rationale).alias("rationale"),
        F.when((F.col("e.mode") == "slices") & ~lost, ranges).alias("slices"),
    )


def synthetic_summary(selection: DataFrame, entrypoints: int = 8, modules: int = 12, tests: int = 8) -> DataFrame:
    """conv_id, kind, nth, path and notes made from a partial selection (conv_id, path, mode,
    priority): entry points by name, the other files as key modules, and tests."""
    entry = F.col("path").rlike(r"(?i)(^|/)(main|index|app|server|cli)\.[^/]+$")
    rank = lambda values, c: F.array_position(F.array(*map(F.lit, values)), F.col(c))
    kinds = F.array_compact(
        F.array(
            F.when(entry, F.struct(F.lit("entrypoint").alias("kind"), F.concat(F.lit(DERIVED), "mode", F.lit(")")).alias("notes"))),
            F.when(~entry, F.struct(F.lit("module").alias("kind"), F.concat(F.lit(DERIVED), "priority", F.lit(")")).alias("notes"))),
            F.when(is_test_path(F.col("path")), F.struct(F.lit("test").alias("kind"), F.lit(SEEN_TEST).alias("notes"))),
        )
    )
    order = Window.partitionBy("conv_id", "kind").orderBy(rank(PRIORITIES, "priority"), rank(MODES, "mode"), "path")
    rows = selection.select("conv_id", "path", "mode", "priority", F.inline(kinds)).withColumn("nth", F.row_number().over(order).cast("long"))
    limit = F.when(F.col("kind") == "entrypoint", entrypoints).when(F.col("kind") == "module", modules).otherwise(tests)
    return rows.where(F.col("nth") <= limit).select("conv_id", "kind", "nth", "path", "notes")


def envelopes(messages: DataFrame, fence: str = "result") -> DataFrame:
    """conv_id, turn, id and result of the fenced results that are ok."""
    body = F.regexp_extract("text", rf"(?s)```{fence}\s*(.*?)```", 1)
    field = lambda name: F.get_json_object("body", f"$.{name}")
    return messages.select("conv_id", "turn", body.alias("body")).where((field("ok") == "true") & field("id").isNotNull()).select("conv_id", "turn", field("id").alias("id"), field("result").alias("result"))


def failure_kind(status: Column, error_type: Column) -> Column:
    """Kind of a failed request by its status, else by its type."""
    return (
        F.when(status.isin(401, 403), "auth_error")
        .when(status == 429, "rate_limit")
        .when(status >= 500, "server_error")
        .when(error_type == "timeout", "agent_timeout")
        .when(error_type == "network", "network_error")
        .otherwise("unknown_error")
    )


def process_failure_kind(message: Column, error_type: Column, exit_code: Column) -> Column:
    """Kind of a failed process by its message, then its type, then its exit code."""
    holds = lambda *words: F.lower(message).rlike("|".join(words))
    return (
        F.when(holds("unauthorized", "forbidden", "auth"), "auth_error")
        .when(holds("rate limit", "too many requests"), "rate_limit")
        .when(error_type == "timeout", "agent_timeout")
        .when((error_type == "network") | holds("network"), "network_error")
        .when(exit_code >= 2, "server_error")
        .otherwise("unknown_error")
    )


# Waits before each retry, in ms.
WAITS = {"rate_limit": (1000, 2000, 4000), "server_error": (1000,)}


def fallback(failures: DataFrame) -> DataFrame:
    """Adds strategy, retry, delay_ms and most_retries to failures (kind, retries, turns_left):
    what to do next. Unusable payloads are retried while turns are left."""
    kind, n, left = F.col("kind"), F.greatest(F.coalesce("retries", F.lit(0)), F.lit(0)), F.greatest(F.coalesce("turns_left", F.lit(0)), F.lit(0))
    payload = kind.isin("invalid_final", "missing_final")
    strategy = F.when(payload | (kind == "agent_timeout"), "hybrid").otherwise("offline")
    most, delay = F.when(payload, left), F.when(payload, F.lit(0))
    for name, waits in WAITS.items():
        most = most.when(kind == name, len(waits))
        delay = delay.when(kind == name, F.coalesce(F.get(F.array(*map(F.lit, waits)), n.cast("int")), F.lit(0)))
    retry = F.when(payload, left > 0).otherwise(n < F.coalesce(most, F.lit(0)))
    return failures.select(
        "*", strategy.alias("strategy"), retry.alias("retry"), F.when(retry, F.coalesce(delay, F.lit(0))).otherwise(0).cast("long").alias("delay_ms"), F.coalesce(most, F.lit(0)).cast("long").alias("most_retries")
    )


def usage(reports: DataFrame, by: str) -> DataFrame:
    """Tokens in and out by group; what is null, broken or below zero counts nothing."""
    whole = lambda c: F.sum(F.greatest(F.lit(0), F.coalesce(F.floor(F.when(~F.isnan(c), F.col(c))), F.lit(0)))).cast("long").alias(c)
    return reports.groupBy(by).agg(whole("tokens_in"), whole("tokens_out"))


def message_text(parts: Column) -> Column:
    """The text parts (struct type, text) of a message, joined by line breaks."""
    texts = F.transform(F.filter(parts, lambda x: (x["type"] == "text") & x["text"].isNotNull()), lambda x: x["text"])
    return F.array_join(texts, "\n")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id and text of whole conversations: each turn under its role in brackets."""
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("")), F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    each = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(each, lambda x: x["line"]), "\n").alias("text"))
