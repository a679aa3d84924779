"""Registered queries of smaller parts: languages, plain scans, safe paths, slices of a selection, ranking over the index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import rank, scan, scopes, select
from corpusmill.plans.registry import _LINES_SQL, EDGES_SQL, edges, files, query, table
from corpusmill.plans.signals import _SCOPES_SQL, code_of_orders
from corpusmill.sources.corpus import FILES_SQL

#: Maps of endings by the part that uses them, and what it calls other files.
MAPS = {"walk": (text.WALK_LANGUAGES, "text"), "indexed": (text.INDEX_LANGUAGES, "text"), "pipeline": (text.PIPELINE_LANGUAGES, "text"), "summary": (text.REPO_LANGUAGES, "text"), "codemap": (text.CODEMAP_LANGUAGES, None)}
#: Endings that the documents' files get here, by id.
ENDINGS = sorted({e for known, _ in MAPS.values() for e in known} | {"png", "TSX", "lock"})


def _map_sql(known: dict[str, str], other: str | None) -> str:
    pairs = " ".join(f"when '{e}' then '{lang}'" for e, lang in known.items())
    return f"case ending {pairs}{f' else {chr(39)}{other}{chr(39)}' if other else ''} end"


@query(
    f"""with {FILES_SQL}, e as (select path || '.' || ([{', '.join(f"'{e}'" for e in ENDINGS)}])[(doc_id % {len(ENDINGS)} + 1)::int] as path, lower(([{', '.join(f"'{e}'" for e in ENDINGS)}])[(doc_id % {len(ENDINGS)} + 1)::int]) as ending from files)
select path, {', '.join(f'{_map_sql(*m)} as {name}' for name, m in MAPS.items())} from e"""
)
def q_language_maps(spark, sf_dir):
    ending = F.get(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS)).cast("int"))
    every = files(spark, sf_dir).select(F.concat("path", F.lit("."), ending).alias("path"))
    return every.select("path", *[text.language(F.col("path"), *m).alias(name) for name, m in MAPS.items()])


def odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' files, some in folders that a plain scan skips, some named like images."""
    folder = F.when(F.col("doc_id") % 9 == 0, "node_modules/").when(F.col("doc_id") % 9 == 1, "a/dist/").otherwise("")
    ending = F.when(F.col("doc_id") % 5 == 0, ".PNG").otherwise("")
    return files(spark, sf_dir).select(F.concat(folder, "path", ending).alias("path"), "size", "mtime")


_ODD_SQL = f"""{FILES_SQL}, kept as (select path || case when doc_id % 5 = 0 then '.PNG' else '' end as path, size, mtime, doc_id % 5 = 0 as image, language as known from files where doc_id % 9 > 1)"""


@query(f"with {_ODD_SQL} select path, size, mtime, known as language from kept where size <= 4000 and not image")
def q_plain_scan(spark, sf_dir):
    return scan.plain(odd_files(spark, sf_dir), 4000)[0]


@query(
    f"""with {_ODD_SQL} select count(*) filter (size <= 4000 and not image)::bigint as files, count(*) filter (size > 4000)::bigint as by_size, count(*) filter (size <= 4000 and image)::bigint as by_binary from kept"""
)
def q_plain_counts(spark, sf_dir):
    return scan.plain(odd_files(spark, sf_dir), 4000)[1]


@query(
    f"""with {FILES_SQL} select path, case doc_id % 6 when 0 then path when 1 then path when 2 then regexp_extract(path, '^(.*)/[^/]*$', 1) end as safe from files"""
)
def q_safe_paths(spark, sf_dir):
    case = F.col("doc_id") % 6
    asked = (
        F.when(case == 0, F.concat(F.lit("./a/../"), "path"))
        .when(case == 1, F.replace("path", F.lit("/"), F.lit("\\")))
        .when(case == 2, F.concat("path", F.lit("/x/../../")))
        .when(case == 3, F.concat(F.lit("/"), "path"))
        .when(case == 4, F.concat(F.lit("a/../../"), "path"))
        .otherwise(F.lit("./"))
    )
    return files(spark, sf_dir).select("path", text.safe_path(asked).alias("safe"))


@query(f"with {FILES_SQL} select path, case when doc_id % 4 < 2 then 'run-' || doc_id when doc_id % 4 = 2 then regexp_extract(path, '([^/]*)$', 1) end as run from files")
def q_run_pointers(spark, sf_dir):
    case, number = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    asked = F.when(case == 0, F.concat(F.lit("runs/run-"), number, F.lit("\n"))).when(case == 1, F.concat(F.lit("run-"), number, F.lit("/"))).when(case == 2, F.col("path")).otherwise(F.concat("path", F.lit("/..")))
    return files(spark, sf_dir).select("path", text.run_pointer(asked).alias("run"))


#: Intervals of each sliced file; with two slices at most, the first two and the last two of the merged ones are joined.
INTERVALS = ((1, 2), (3, 3), (10, 12), (30, 33), (50, 60))


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = files(spark, sf_dir)
    mode = F.get(F.array(F.lit("full"), F.lit("slices"), F.lit("codemap_only")), (F.col("doc_id") % 3).cast("int"))
    entries = every.select("path", mode.alias("mode"), "size", (F.col("doc_id") * 37 % 1009).alias("score"))
    spans = every.select("path", F.inline(F.array(*[F.struct(F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("last")) for a, b in INTERVALS])))
    return entries, spans


_ENTRIES_SQL = f"""{FILES_SQL}, fine as (select path, ['full', 'slices', 'codemap_only'][(doc_id % 3 + 1)::int] as mode, size, doc_id * 37 % 1009 as score from files where size <= 9000),
demoted as (select path, case when mode = 'full' and row_number() over (partition by mode order by score desc, path desc) > 10 then 'slices' else mode end as mode, size, score from fine),
kept as (select * from demoted order by score desc, path desc limit 60)"""


@query(f"with {_ENTRIES_SQL} select path, first::bigint as first, last::bigint as last from kept, (values (1, 12), (30, 60)) v(first, last) where mode = 'slices'")
def q_hard_slices(spark, sf_dir):
    entries, spans = _entries(spark, sf_dir)
    return select.with_slices(entries, spans, 2, most_files=60, most_full=10, most_bytes=9000)[1]


@query(
    f"""with {_ENTRIES_SQL}, {_LINES_SQL}, whole as (select path, any_value(all_lines) as x, len(any_value(all_lines)) as n from lines group by path),
s as (select k.path, mode, nth, first, last, f.content, coalesce(x, ['']) as x, coalesce(n, 0) as n from kept k join files f on f.path = k.path left join whole w on w.path = k.path
  left join (values ('slices', 1, 1, 12), ('slices', 2, 30, 60)) v(m, nth, first, last) on m = mode)
select path, mode, nth::bigint as nth, first::int as first, last::int as last,
  substr(sha256(case mode when 'full' then content when 'slices' then array_to_string(x[greatest(1, least(first, n)):greatest(greatest(1, least(first, n)), least(last, n))], chr(10)) end), 1, 12) as digest from s"""
)
def q_files_section(spark, sf_dir):
    entries, spans = _entries(spark, sf_dir)
    kept, cut = select.with_slices(entries, spans, 2, most_files=60, most_full=10, most_bytes=9000)
    return select.files_section(kept, cut, files(spark, sf_dir)).withColumn("digest", text.stable_hash(F.col("text"))).drop("text")


TASK = "Rework Order1 and line2 of the export class, then the section in part9"
_TERMS = rank.task_terms(TASK)


def _indexed_sql() -> str:
    weights, of_path = rank.term_weights(_TERMS), rank.path_terms(_TERMS)
    assert not of_path
    n = lambda t: f"sum((length(low) - length(replace(low, '{t}', ''))) // {len(t)})"
    raw, hits, seen = " + ".join(f"{w} * {n(t)}" for t, w in weights.items()), " + ".join(n(t) for t in weights), " + ".join(f"({n(t)} > 0)::int" for t in weights)
    return f"""{_SCOPES_SQL}, parts as (
  select distinct path, lower(path) as low from items union all
  select path, lower(name || chr(10) || case when kind = 'section' then name when kind = 'class' and step = 3 then 'export class ' || name || ' {{' when kind = 'class' then 'class ' || name || ':'
    when step = 3 then name || '(part) {{' else 'def ' || name || '(self):' end) from (select f.*, case when split_part(f.path, '/', 2)::bigint % 3 = 0 then 3 else 2 end as step from found f)
  union all select path, 'parts/' || l_partkey || chr(10) || 'part' || l_linenumber from (select *, 'orders/' || l_orderkey as path from lineitem)
), counted as (select path, {raw} as terms, {hits} as hits, {seen} as seen from parts group by path)
select path, (terms + case when seen > 1 then 6 * seen else 0 end)::double as raw, hits::bigint as hits from counted where terms > 0"""


@query(f"with {_indexed_sql()}")
def q_rank_indexed(spark, sf_dir):
    path, items = F.concat(F.lit("orders/"), "l_orderkey").alias("path"), table(spark, sf_dir, "lineitem")
    imports = items.select(path, F.concat(F.lit("parts/"), "l_partkey").alias("target"), F.array(F.concat(F.lit("part"), "l_linenumber")).alias("names"))
    return rank.indexed_scores(items.select("l_orderkey").distinct().select(path), scopes.symbols(code_of_orders(spark, sf_dir)), imports, _TERMS).drop("matched")


@query(
    f"""with {FILES_SQL}, {EDGES_SQL}, changed as (select path, size, doc_id from files where doc_id % 17 = 0), pairs as (
  select t.path as test_path, c.path from files t join changed c on t.doc_id in (c.doc_id + 1, c.doc_id + 2)
  union all select t.path, c.path from files t join changed c on t.doc_id = c.doc_id - 15)
select path, sum(boost)::bigint as boost, array_to_string(list_sort(list(distinct reason)), ',') as reasons, max(mode) as mode from (
  select path, 260 as boost, 'changed_file' as reason, case when size > 80000 then 'slices' else 'full' end as mode from changed
  union all select distinct src, 90, 'imports_changed_file', null from edges where dst in (select path from changed)
  union all select test_path, 75, 'tests_changed_module', null from pairs) group by path"""
)
def q_review_bias(spark, sf_dir):
    every = files(spark, sf_dir)
    changed = every.where("doc_id % 17 = 0")
    pair = lambda k: every.select((F.col("doc_id") - k).alias("id"), F.col("path").alias("test_path")).join(changed.select(F.col("doc_id").alias("id"), "path"), "id")
    tests = reduce(DataFrame.unionByName, [pair(k) for k in (1, 2, -15)]).select("test_path", "path")
    return rank.change_bias(changed.select("path"), edges(spark, sf_dir), tests, every.select("path", "size"), review=True)


