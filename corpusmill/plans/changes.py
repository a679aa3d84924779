"""Registered queries over two versions of the files, and over indexes kept up to date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import lines_of, stable_hash
from corpusmill.operators import diff, grams, transcript
from corpusmill.plans.registry import files, query, table
from corpusmill.sources.corpus import FILES_SQL
from corpusmill.sources.shared import shared_folder, written
from corpusmill.streaming import sessions, stateful

#: Files of fewer lines stay as they are in the edited version.
LEAST_LINES = 4


def edited(every: DataFrame) -> DataFrame:
    """A later version of the files (path, content), by id: a sixth each stays, loses its second line, has its
    first two swapped, gets a line (beside a new file), is deleted, or is moved."""
    parts = F.split("content", "\n")
    piece = lambda a, n=None: F.slice(parts, a, F.size(parts) if n is None else n)
    case = F.col("doc_id") % 6

    def text(*lists: Column) -> Column:
        return F.array_join(F.concat(*lists), "\n")

    line = F.array(F.concat(F.lit("inserted line "), F.col("doc_id").cast("string")))
    many = F.size(parts) >= LEAST_LINES
    content = (
        F.when(many & (case == 1), text(piece(1, 1), piece(3)))
        .when(many & (case == 2), text(piece(2, 1), piece(1, 1), piece(3)))
        .when(many & (case == 3), text(piece(1, 1), line, piece(2)))
        .otherwise(F.col("content"))
    )
    kept = every.where(case != 4).select(F.when(case == 5, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), content.alias("content"))
    born = every.where(case == 3).select(F.concat(F.lit("born/"), "path").alias("path"), F.concat(F.lit("new file "), F.col("doc_id").cast("string"), F.lit("\n")).alias("content"))
    return kept.unionByName(born)


def found_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = files(spark, sf_dir)
    return diff.hunks(diff.paired(every.select("path", "content"), edited(every)))


_EDITED_SQL = f"""{FILES_SQL}, cut as (select *, string_split(content, chr(10)) as p, doc_id % 6 as c from files),
edited as (
  select case when c = 5 then 'moved/' || path else path end as path, case when len(p) < {LEAST_LINES} then content
    when c = 1 then array_to_string(p[1:1] || p[3:], chr(10)) when c = 2 then array_to_string(p[2:2] || p[1:1] || p[3:], chr(10))
    when c = 3 then array_to_string(p[1:1] || ['inserted line ' || doc_id] || p[2:], chr(10)) else content end as content from cut where c <> 4
  union all select 'born/' || path, 'new file ' || doc_id || chr(10) from cut where c = 3
), gone as (select content, min(path) as old_path from cut where c in (4, 5) and content <> '' group by content),
come as (select content, min('moved/' || path) as path from cut where c = 5 and content <> '' group by content),
moved as (select path, old_path from gone join come using (content)),
told as (
  select path, null as old_path, 'modified' as status, 1 as hunks, case when c = 1 then 0 else 1 end as additions, case when c = 3 then 0 else 1 end as deletions
  from cut where len(p) >= {LEAST_LINES} and (c in (1, 3) or c = 2 and p[1] <> p[2])
  union all select 'born/' || path, null, 'added', 1, 1, 0 from cut where c = 3
  union all select path, null, 'deleted', case when content = '' then 0 else 1 end, 0, len(p) - case when p[-1] = '' then 1 else 0 end from cut where c in (4, 5) and path not in (select old_path from moved)
  union all select 'moved/' || path, null, 'added', case when content = '' then 0 else 1 end, len(p) - case when p[-1] = '' then 1 else 0 end, 0 from cut where c = 5 and 'moved/' || path not in (select path from moved)
  union all select path, old_path, 'renamed', 0, 0, 0 from moved
)"""


@query(f"with {_EDITED_SQL} select path, old_path, status, hunks::bigint as hunks, additions::bigint as additions, deletions::bigint as deletions from told")
def q_diff_files(spark, sf_dir):
    text = diff.text(found_hunks(spark, sf_dir)).select(F.col("path").alias("diff_id"), "text")
    return transcript.parse_diff(text).select("path", "old_path", "status", "hunks", "additions", "deletions")


@query(f"with {_EDITED_SQL} select path, hunks::bigint as hunks, (additions - deletions)::bigint as more from told where hunks > 0")
def q_diff_ranges(spark, sf_dir):
    text = diff.text(found_hunks(spark, sf_dir)).select(F.col("path").alias("diff_id"), "text")
    each = transcript.parse_hunks(text).groupBy("path")
    return each.agg(F.count("*").alias("hunks"), F.sum(F.col("new_lines") - F.col("old_lines")).alias("more"))


@query(f"with {_EDITED_SQL} select path, substr(sha256(content), 1, 12) as digest from edited")
def q_diff_applied(spark, sf_dir):
    after = diff.applied(files(spark, sf_dir).select("path", "content"), found_hunks(spark, sf_dir))
    return after.select("path", stable_hash(F.col("content")).alias("digest"))


def _marks(content: Column) -> Column:
    """Lines that start with a capital letter, as symbols named by their first word."""
    numbered = F.transform(lines_of(content), lambda x, at: F.struct(x.alias("text"), at.alias("at")))
    capital = F.filter(numbered, lambda x: x["text"].rlike("^[A-Z]"))
    return F.transform(
        capital,
        lambda x: F.struct(F.lit("heading").alias("kind"), F.regexp_extract(x["text"], "^([A-Za-z]+)", 1).alias("name"), x["text"].alias("signature"), (x["at"] + 1).cast("long").alias("line")),
    )


def _mentions(content: Column) -> Column:
    """Words after ``from``, as imports."""
    words = F.array_distinct(F.regexp_extract_all(content, F.lit("from ([a-z]+)"), F.lit(1)))
    return F.transform(words, lambda w: F.struct(w.alias("target"), F.lit(False).alias("reexport")))


def file_events(every: DataFrame) -> list[DataFrame]:
    """Three batches of events of the files, by id: first three quarters of them; then some touched, some
    changed, and the rest; then some gone, some changed and gone and back, and all others sent again."""
    case = F.col("doc_id") % 12

    def batch(n: int, rows: DataFrame, gone: bool = False, touched: Column = F.lit(0), more: Column = F.lit("")) -> DataFrame:
        content = F.concat("content", more)
        changed = rows.withColumn("content", content).withColumn("hash", stable_hash(F.col("content"))).withColumn("size", F.octet_length("content").cast("long"))
        changed = changed.withColumn("mtime", F.col("mtime") + touched).withColumn("gone", F.lit(gone)).withColumn("ord", F.lit(n).cast("long"))
        return stateful.as_events(changed, _marks(F.col("content")), _mentions(F.col("content")))

    later, edit = F.when(case.isin(0, 1), 1).otherwise(0), F.when(case == 1, F.lit("\nFinal from here")).otherwise("")
    second = batch(20, every.where(case.isin(0, 1) | (case >= 9)), touched=later, more=edit)
    again = batch(31, every.where((case < 9) & ~case.isin(2, 3)), touched=later, more=edit)
    back = batch(33, every.where(case == 3), touched=F.lit(2), more=F.lit("\nBack from there"))
    return [batch(10, every.where(case < 9)), second, batch(32, every.where(case.isin(2, 3)), gone=True).unionByName(again).unionByName(back)]


def _run_index(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Checkpoint and changes of the index after the three batches, one micro-batch each."""
    top = shared_folder(spark, "index")
    checkpoint, _ = stateful.opened(spark, f"{top}/state")
    for k, events in enumerate(file_events(files(spark, sf_dir))):
        events.write.parquet(f"{top}/events/{k}")
        stream = spark.readStream.schema(stateful.EVENTS).option("recursiveFileLookup", True).parquet(f"{top}/events")
        stateful.follow(stream, checkpoint, f"{top}/changes").awaitTermination()  # all files that have come are one batch
    return checkpoint, f"{top}/changes"


_INDEXED_SQL = f"""{FILES_SQL}, last as (
  select path, doc_id % 12 as c, mtime + case when doc_id % 12 in (0, 1) then 1 when doc_id % 12 = 3 then 2 else 0 end as mtime,
    content || case doc_id % 12 when 1 then chr(10) || 'Final from here' when 3 then chr(10) || 'Back from there' else '' end as content from files where doc_id % 12 <> 2
), parts as (select *, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) as p from last)"""


@query(
    f"""with {_INDEXED_SQL} select path, strlen(content)::bigint as size, mtime, substr(sha256(content), 1, 12) as hash,
  len(list_filter(p, lambda x: regexp_matches(x, '^[A-Z]')))::bigint as symbols,
  coalesce(list_max(list_transform(range(1, len(p) + 1), lambda k: case when regexp_matches(p[k], '^[A-Z]') then k else 0 end)), 0)::bigint as last_line,
  array_to_string(list_sort(list_distinct(regexp_extract_all(content, 'from ([a-z]+)', 1))), ',') as imports from parts"""
)
def q_state_index(spark, sf_dir):
    checkpoint, _ = _run_index(spark, sf_dir)
    held = stateful.indexed(spark, checkpoint)
    symbols = held["symbols"].groupBy("path").agg(F.count("*").alias("symbols"), F.max("line").alias("last_line"))
    imports = held["imports"].groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("imports"))
    every = held["files"].join(symbols, "path", "left").join(imports, "path", "left").fillna({"symbols": 0, "last_line": 0, "imports": ""})
    return every.select("path", "size", "mtime", "hash", "symbols", "last_line", "imports")


@query(
    f"""with {FILES_SQL}, c as (select doc_id % 12 as c from files), e as (
  select 10 as ord, 'upsert' as action from c where c < 9 union all select 20, case c when 0 then 'touch' else 'upsert' end from c where c in (0, 1) or c >= 9
  union all select 31, 'unchanged' from c where c < 9 and c not in (2, 3) union all select 32, 'delete' from c where c in (2, 3) union all select 33, 'upsert' from c where c = 3)
select ord::bigint as ord, action, count(*)::bigint as files from e group by all"""
)
def q_state_changes(spark, sf_dir):
    _, changes = _run_index(spark, sf_dir)
    return spark.read.parquet(changes).groupBy("ord", "action").agg(F.count("*").alias("files"))


@query(f"with {_INDEXED_SQL} select count(*)::bigint as files, sum(strlen(content))::bigint as bytes, max(mtime) as latest, true as current from last")
def q_state_status(spark, sf_dir):
    checkpoint, _ = _run_index(spark, sf_dir)
    return stateful.status(stateful.indexed(spark, checkpoint)["files"])


#: Patterns searched for by way of the index: (pattern, a regular expression, case counts).
PATTERNS = (("tion", False, False), ("token = ", False, True), ("Thereon", False, True), ("th[ae]+ [a-z]*ing", True, True), (r"[0-9]+\.[0-9]+\.[0-9]+", True, True))


def _searched(found: grams.GramIndex) -> DataFrame:
    every = [found.hits(p, regex, case).select(F.lit(k).cast("long").alias("k"), "path", "line", "col") for k, (p, regex, case) in enumerate(PATTERNS)]
    return reduce(DataFrame.unionByName, every)


def _searched_sql(of: str) -> str:
    place = lambda p, regex, case: (
        f"case when regexp_matches(x, '{p}') then instr(x, regexp_extract(x, '{p}', 0)) else 0 end" if regex else f"instr({'x' if case else 'lower(x)'}, '{p}')"
    )
    each = " union all ".join(f"select {k}::bigint as k, path, line, ({place(*p)})::bigint as col from each_line" for k, p in enumerate(PATTERNS))
    return f"""split as (select path, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) as p from {of}),
each_line as (select path, k as line, p[k] as x from (select path, p, unnest(range(1, len(p) + 1)) as k from split)),
found as ({each}) select k, path, line, col from found where col > 0"""


@query(f"with {FILES_SQL}, {_searched_sql('files')}")
def q_gram_search(spark, sf_dir):
    found = grams.GramIndex(spark, shared_folder(spark, "grams"))
    found.add(files(spark, sf_dir).select("path", "content"))
    return _searched(found)


@query(f"with {_EDITED_SQL}, {_searched_sql('edited')}")
def q_gram_updated(spark, sf_dir):
    every = files(spark, sf_dir)
    found = grams.GramIndex(spark, shared_folder(spark, "grams"))
    found.add(every.select("path", "content"))
    pairs = written(diff.paired(every.select("path", "content"), edited(every)).drop("old"), shared_folder(spark, "pairs"))
    gone = pairs.select(F.explode(F.array_compact(F.array(F.when(F.col("status") == "deleted", F.col("path")), "old_path"))).alias("path"))
    found.add(pairs.where("status <> 'deleted'").select("path", F.col("new").alias("content")), gone)
    return _searched(found)


#: Sessions over events: idle for a day they end; events come up to eight days late.
CAPS = sessions.Caps(files=3, full=1, bytes=60_000, turns=6, idle_ms=86_400_000)
#: Files of a batch at most, and rows of a file on average at least.
BATCH_FILES, FILE_ROWS = 32, 1000


def edit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of each user's selection, from events."""
    at = lambda k: (F.col("event_id") % k).cast("int")
    action = F.when(at(29) == 0, "clear").when(F.col("event_type") == "error", "remove").otherwise("add")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("ord"), "ts", action.alias("action"), F.concat(F.lit("f"), at(5).cast("string")).alias("path"),
        F.get(F.array(F.lit("full"), F.lit("slices"), F.lit("codemap_only"), F.lit("odd")), F.when(at(31) == 0, 3).otherwise(at(3))).alias("mode"), F.floor(F.coalesce("value", F.lit(0)) * 1000).cast("long").alias("size"),
    )
    return rows.to(spark.createDataFrame([], sessions.EVENTS).schema)


def _run_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in batches of eight days each, every tenth of them a batch late, and at last one that moves the watermark beyond all."""
    top = shared_folder(spark, "sessions")
    every = edit_events(spark, sf_dir)
    file = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 8) + (F.col("ord") % 10 == 0).cast("int")
    sizes = {r.file: r["count"] for r in every.groupBy(file.alias("file")).count().orderBy("file").collect()}  # a few for each month
    # All batches are of as many files, none of them empty, so that a trigger takes one batch.
    parts = max(1, min(BATCH_FILES, min(sizes.values(), default=0) // FILE_ROWS))
    for k in sizes:
        every.where(file == k).repartition(parts).write.parquet(f"{top}/events/{k:05d}")
    end = spark.createDataFrame([("", 0, None, None, None, None, None)], sessions.EVENTS).withColumn("ts", F.to_timestamp(F.lit("2100-01-01")))
    end.coalesce(1).write.parquet(f"{top}/events/99999")
    stream = spark.readStream.schema(sessions.EVENTS).option("maxFilesPerTrigger", parts).option("recursiveFileLookup", True).parquet(f"{top}/events")
    sessions.follow(sessions.sessions(stream, CAPS, "9 days"), f"{top}/state", f"{top}/found").awaitTermination()
    return spark.read.parquet(f"{top}/found").where("session <> ''")


_SESSIONS_SQL = f"""e as (
  select user_id::varchar as session, event_id as ord, epoch_us(ts) // 1000 as ms, case when event_id % 29 = 0 then 'clear' when event_type = 'error' then 'remove' else 'add' end as action,
    'f' || event_id % 5 as path, case when event_id % 31 = 0 then 'odd' else ['full', 'slices', 'codemap_only'][(event_id % 3 + 1)::int] end as mode, floor(coalesce(value, 0) * 1000)::bigint as size from events
), parted as (select *, sum(case when ms - before > {CAPS.idle_ms} then 1 else 0 end) over (partition by session order by ms, ord) as part
  from (select *, lag(ms) over (partition by session order by ms, ord) as before from e)),
numbered as (select *, row_number() over (partition by session, part order by ms, ord) as n from parted),
run(session, part, n, ord, ms, path, mode, error, held) as (
  select distinct session, part, 0::bigint, null::bigint, null::bigint, null::varchar, null::varchar, null::varchar, []::struct(p varchar, m varchar)[] from numbered
  union all
  select session, part, n, ord, ms, path, mode, error, case when error is not null then held when action = 'clear' then [] when action = 'remove' then list_filter(held, lambda x: x.p <> path)
    else list_append(list_filter(held, lambda x: x.p <> path), {{'p': path, 'm': mode}}) end
  from (select e.session, e.part, e.n, e.ord, e.ms, e.path, e.mode, e.action, r.held,
      case when e.n > {CAPS.turns} then 'TURN_LIMIT' when e.action = 'clear' then null
        when e.action = 'remove' then case when len(list_filter(r.held, lambda x: x.p = e.path)) = 0 then 'NOT_SELECTED' end
        when e.mode = 'odd' then 'INVALID_SELECTION_ENTRY' when e.size > {CAPS.bytes} then 'FILE_TOO_LARGE'
        when len(list_filter(r.held, lambda x: x.p = e.path)) = 0 and len(r.held) >= {CAPS.files} then 'MAX_FILES_EXCEEDED'
        when len(list_filter(r.held, lambda x: x.p <> e.path and x.m = 'full')) + case when e.mode = 'full' then 1 else 0 end > {CAPS.full} then 'MAX_FULL_FILES_EXCEEDED' end as error
    from run r join numbered e on e.session = r.session and e.part = r.part and e.n = r.n + 1)
)"""


@query(f"with recursive {_SESSIONS_SQL} select session, ord, ms as at_ms, n::int as turn, path, mode, error from run where n > 0")
def q_session_events(spark, sf_dir):
    return _run_sessions(spark, sf_dir).where("kind = 'event'").drop("kind", "held")


@query(
    f"""with recursive {_SESSIONS_SQL} select session, ms as at_ms, n::int as turn,
  '{{' || coalesce(array_to_string(list_transform(list_sort(held), lambda x: '"' || x.p || '": "' || x.m || '"'), ', '), '') || '}}' as held from run where n > 0 qualify n = max(n) over (partition by session, part)"""
)
def q_session_ends(spark, sf_dir):
    return _run_sessions(spark, sf_dir).where("kind = 'closed'").select("session", "at_ms", "turn", "held")
