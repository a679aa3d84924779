"""The registered queries over the driver's tables, each with equal SQL for DuckDB."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import STOP_WORDS, base_name, lines_of, stable_hash, tokens
from corpusmill.operators import index, rank, redact, report, scan, search, select, slices, transcript
from corpusmill.sources.corpus import FILES_SQL, files_of_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Files whose ids and paths are broadcast at most.
MOST_BROADCAST = 100_000

TASK = "Find that handler with ThingList from src/auth/login.ts"
TERM = "tion"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of_documents(table(spark, sf_dir, "documents"))


def small(df: DataFrame) -> DataFrame:
    """The rows of a result that a limit bounds, held by the driver, so that what builds on it starts there."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _plain(value, kind):
    """A value as JSON has it, tuples as objects of their fields."""
    if isinstance(kind, T.StructType) and value is not None:
        return {f.name: _plain(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)}
    if isinstance(kind, T.ArrayType) and value is not None:
        return [_plain(v, kind.elementType) for v in value]
    return value


def spread(spark: SparkSession, sf_dir: str, how: dict[str, tuple[str, ...]], rows: list[tuple], schema: str) -> DataFrame:
    """Rows of a worked example, once for every document: its ``ids`` grow by a hundred times the
    document's id, names in ``heads`` lie in a folder of its own, those in ``tails`` end in its id."""
    kind = spark.createDataFrame([], schema).schema
    text = json.dumps([_plain(r, kind) for r in rows])
    every = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.from_json(F.lit(text), T.ArrayType(kind))))
    number = F.col("doc_id").cast("string")
    every = every.withColumns({c: F.col(c) + 100 * F.col("doc_id") for c in how.get("ids", ())} | {c: F.concat(F.lit("r"), number, F.lit("/"), c) for c in how.get("heads", ())} | {c: F.concat(c, number) for c in how.get("tails", ())})
    return every.select(*kind.names)


def spread_sql(sql: str, ids: tuple[str, ...] = (), heads: tuple[str, ...] = (), tails: tuple[str, ...] = ()) -> str:
    """The example's results for every document, named like its rows."""
    named = [f"t.{c} + 100 * d.doc_id as {c}" for c in ids] + [f"'r' || d.doc_id || '/' || t.{c} as {c}" for c in heads] + [f"t.{c} || d.doc_id as {c}" for c in tails]
    return f"select t.*{f' replace ({chr(44).join(named)})' if named else ''} from ({sql}) t, documents d"


def edges(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """Import edges by position among the files: (src, dst) paths; only those between ``among``, a few files (path), if given."""
    ids = files(spark, sf_dir).select("doc_id", "path")
    n = ids.count()
    if among is not None:
        few = F.broadcast(small(ids.join(F.broadcast(among.select("path")), "path", "left_semi")).select("doc_id", "path"))
        src, dst = few.select(F.col("doc_id").alias("a"), F.col("path").alias("src")), few.select(F.col("doc_id").alias("b"), F.col("path").alias("dst"))
        pairs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % n).alias("a"), (F.col("l_partkey") % n).alias("b")).where("a <> b")
        return pairs.join(src, "a").join(dst, "b").select("src", "dst").distinct()
    pairs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % n).alias("a"), (F.col("l_partkey") % n).alias("b")).where("a <> b").distinct()
    if n <= MOST_BROADCAST:  # ids and paths of so many files take some 10 MB
        ids = F.broadcast(ids)
    src, dst = ids.select(F.col("doc_id").alias("a"), F.col("path").alias("src")), ids.select(F.col("doc_id").alias("b"), F.col("path").alias("dst"))
    return pairs.join(src, "a").join(dst, "b").select("src", "dst")


EDGES_SQL = """edges as (
  select distinct s.path as src, d.path as dst
  from (select distinct l_orderkey % (select count(*) from documents) as a, l_partkey % (select count(*) from documents) as b
        from lineitem) p
  join files s on s.doc_id = p.a join files d on d.doc_id = p.b where p.a <> p.b
)"""

MAX_BYTES = 6000
REASON_SQL = f"""scanned as (
  select *, case when regexp_matches(path, '^(?:.*/)?es/(?:.*/)?config\\.[^/]*$') then 'never'
    when path like '%.json' then 'binary'
    when size > {MAX_BYTES} and not regexp_matches(path, '^src1/.*$') then 'size'
    when regexp_matches(path, '^src3/.*$') then 'excluded' end as reason
  from files
)"""


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.classify(files(spark, sf_dir), MAX_BYTES, ["**/es/**/config.*"], ["src1/**"], ["src3/**"], ["json"])


@query(f"with {FILES_SQL}, {REASON_SQL} select path, size, language from scanned where reason is null")
def q_scan_filter(spark, sf_dir):
    return scanned(spark, sf_dir).where("reason is null").select("path", "size", "language")


@query(f"with {FILES_SQL}, {REASON_SQL} select path, size, reason from scanned where reason is not null")
def q_excluded(spark, sf_dir):
    return scanned(spark, sf_dir).where("reason is not null").select("path", "size", "reason")


@query(f"with {FILES_SQL} select language, count(*)::bigint as files, sum(size)::bigint as bytes from files group by language")
def q_language_stats(spark, sf_dir):
    return scan.language_stats(files(spark, sf_dir))


_HINT_SQL = """case when name in ('package.json', 'index.js', 'index.ts') then 'node' when name in ('pyproject.toml', 'setup.py', 'main.py') then 'python'
  when name in ('go.mod', 'main.go') then 'go' when name in ('Cargo.toml', 'main.rs') then 'rust' when name = 'Makefile' then 'make' end"""


@query(
    f"with {FILES_SQL} select hint, count(distinct dir)::bigint as dirs from (select {_HINT_SQL} as hint, dir from "
    "(select regexp_extract(path, '([^/]*)$', 1) as name, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from files)) where hint is not null group by hint"
)
def q_repo_info(spark, sf_dir):
    return scan.build_hints(files(spark, sf_dir))


@query("select doc_id, ceil(length(text) / 3.5::double)::bigint as tokens, substr(sha256(text), 1, 12) as hash from documents")
def q_tokens_by_doc(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tokens(F.col("text")).alias("tokens"), stable_hash(F.col("text")).alias("hash"))


@query("select source, sum(ceil(length(text) / 3.5::double))::bigint as tokens, count(*)::bigint as files from documents group by source")
def q_tokens_by_source(spark, sf_dir):
    return scan.token_totals(table(spark, sf_dir, "documents").withColumnRenamed("text", "content"), "source")


_ROLLUP_SQL = """rollup_dirs as (
  select dir, count(*)::bigint as files from (
    select array_to_string(parts[1:k], '/') as dir from (
      select parts, unnest(range(1, len(parts))) as k from (select string_split(path, '/') as parts from files))) group by dir
)"""


@query(f"with {FILES_SQL}, {_ROLLUP_SQL} select dir, files from rollup_dirs")
def q_tree_rollup(spark, sf_dir):
    return scan.directory_rollup(files(spark, sf_dir))


@query(
    f"""with {FILES_SQL}, {_ROLLUP_SQL}, nodes as (
  select array_to_string(list_transform(string_split(dir, '/'), lambda x: '0' || x), '/') as key, (len(string_split(dir, '/')) - 1)::bigint as depth,
    string_split(dir, '/')[-1] || '/ [' || files || ' files]' as text from rollup_dirs
  union all
  select array_to_string(list_transform(p[1:len(p) - 1], lambda x: '0' || x), '/') || '/1' || p[-1], (len(p) - 1)::bigint, p[-1]
  from (select string_split(path, '/') as p from files)
), placed as (select row_number() over (order by key)::bigint as ord, count(*) over () as n, depth, text from nodes)
select ord, case when ord = 500 and n > 500 then 0 else depth end as depth, case when ord = 500 and n > 500 then '... ' || (n - 499) || ' more' else text end as text
from placed where ord <= 500"""
)
def q_tree_lines(spark, sf_dir):
    return scan.tree_lines(files(spark, sf_dir))


@query(
    f"""with {FILES_SQL}, rows as (
  select array_to_string(string_split(path, '/')[1:2], '/') as module, language,
    (len(string_split(content, chr(10))) - case when content = '' or content like '%' || chr(10) then 1 else 0 end)::bigint as lines from files
), per as (select module, language, count(*) as n, sum(lines) as lines from rows group by all)
select module, sum(n)::bigint as files, sum(lines)::bigint as lines,
  array_to_string(list(language || ':' || n order by n desc, language)[1:3], ',') as languages
from per group by module order by files desc, module limit 30"""
)
def q_module_map(spark, sf_dir):
    return scan.module_map(files(spark, sf_dir))


_TERMS = rank.task_terms(TASK)
_WEIGHTS = rank.term_weights(_TERMS)
_PATH_TERMS = rank.path_terms(_TERMS)
# The same list as the ranking's stop words.
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(
    f"""with t as (select distinct item_id as task_id, unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) as term from benchmark)
select task_id, term, {rank.WEIGHTS['search'] * 2}::int as weight from t where len(term) > 1 and term not in ({_STOPS})"""
)
def q_term_weights(spark, sf_dir):
    words = F.regexp_replace(F.lower("text"), "[^a-z]+", " ")  # a plain word counts as itself and as its part
    return rank.weights_of(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), words.alias("text")))


def _base_sql() -> str:
    count = lambda text, t: f"((length({text}) - length(replace({text}, '{t}', ''))) / {len(t)})::bigint"
    every = [(w, count("low", t), t) for t, w in _WEIGHTS.items()] + [(rank.PATH_WEIGHT, count("low_path", t), t) for t in _PATH_TERMS]
    total = " + ".join(f"{w} * {c}" for w, c, _ in every)
    hits = " + ".join(c for _, c, _ in every)
    matched = ", ".join(f"case when {c} > 0 then '{t}' end" for _, c, t in every)
    return f"""base as (
  select path, (terms + case when len(matched) > 1 then 6 * len(matched) else 0 end + case when entry then 40 else 0 end)::double as raw, hits,
    array_to_string(matched, ',') as matched
  from (select path, entry, ({total})::bigint as terms, ({hits})::bigint as hits,
      list_sort(list_distinct(list_filter([{matched}], lambda x: x is not null))) as matched
    from (select path, lower(path || chr(10) || content) as low, lower(path) as low_path,
      regexp_matches(path, '(^|/)(main|index|app|routes|server|cli)\\.[^/]*$') as entry from files))
  where terms + case when entry then 40 else 0 end > 0
)"""


def base_of(of: DataFrame, keep: tuple[str, ...] = (), unscored: bool = False) -> DataFrame:
    entry = F.col("path").rlike(r"(^|/)(main|index|app|routes|server|cli)\.[^/]*$")
    return rank.base_scores(of, F.concat_ws("\n", "path", "content"), _TERMS, entry, keep, unscored)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_of(files(spark, sf_dir))


@query(f"with {FILES_SQL}, {_base_sql()} select path, raw, hits, matched from base")
def q_rank_base(spark, sf_dir):
    return base(spark, sf_dir).withColumn("matched", F.array_join("matched", ","))


_BOOST_SQL = """boost as (
  select e.dst as path, sum(b.raw * 0.2::double / k) as boost
  from edges e join (select src, count(*) as k from edges group by src) f using (src) join base b on b.path = e.src group by e.dst
)"""


@query(f"with {FILES_SQL}, {EDGES_SQL}, {_base_sql()}, {_BOOST_SQL} select path, round(boost, 4) as boost from boost")
def q_rank_import_boost(spark, sf_dir):
    found = rank.import_boost(base(spark, sf_dir), edges(spark, sf_dir))
    return found.select("path", F.round("boost", 4).alias("boost"))


_BIAS_SQL = """changed as (select path from files where doc_id % 17 = 0), bias as (
  select path, sum(boost)::bigint as boost, array_to_string(list_sort(list(distinct reason)), ',') as reasons, max(mode) as mode from (
    select path, 180 as boost, 'changed_file' as reason, case when size > 80000 then 'slices' else 'full' end as mode from files where doc_id % 17 = 0
    union all
    select distinct src, 90, 'imports_changed_file', null from edges where dst in (select path from changed)
  ) group by path
)"""


def bias(spark: SparkSession, sf_dir: str, links: DataFrame | None = None) -> DataFrame:
    every = files(spark, sf_dir)
    changed = every.where("doc_id % 17 = 0").select("path")
    tests = rank.test_candidates(changed).join(every.select(F.col("path").alias("test_path")), "test_path")
    return rank.change_bias(changed, links or edges(spark, sf_dir), tests, every.select("path", "size"))


@query(f"with {FILES_SQL}, {EDGES_SQL}, {_BIAS_SQL} select path, boost, reasons, mode from bias")
def q_git_bias(spark, sf_dir):
    return bias(spark, sf_dir)


_FULL_SQL = """total as (
  select path, round(sum(raw), 6) as raw from (
    select path, raw from base union all select path, boost from boost union all select path, boost::double from bias) group by path
), ranked as (
  select path, raw, greatest(1, least(1000, floor(raw / (select max(raw) from total) * 1000 + 0.5)))::bigint as score from total where raw > 0
  order by score desc, raw desc, path limit 200
)"""
_RANKED = f"{FILES_SQL}, {EDGES_SQL}, {_base_sql()}, {_BOOST_SQL}, {_BIAS_SQL}, {_FULL_SQL}"


def ranked(spark: SparkSession, sf_dir: str, links: DataFrame | None = None) -> DataFrame:
    """The best files; ``links``: persisted edges that others use too."""
    scores = base(spark, sf_dir).select("path", "raw").persist()  # read by several parts, like the edges
    own = edges(spark, sf_dir).persist() if links is None else links
    found = small(rank.finished(scores, rank.import_boost(scores, own, distinct=False), bias(spark, sf_dir, own)))
    scores.unpersist()
    if links is None:
        own.unpersist()
    return found


@query(f"with {_RANKED} select path, raw, score from ranked")
def q_rank_full(spark, sf_dir):
    return ranked(spark, sf_dir).select("path", "raw", "score")


@query(
    f"""with {FILES_SQL}, s as (
  select path, list_filter([
    case when regexp_matches(name, '^(main|index|app|server|cli)\\.(ts|js|tsx|jsx)$') then 'framework' end,
    case when regexp_matches(path, '(^|/)(routes|controllers|handlers|api)(/|\\.)') then 'routes' end,
    case when name in ('main.py', 'app.py', '__main__.py', 'manage.py') then 'python_entry' end,
    case when name = 'main.go' then 'go_main' end, case when name in ('main.rs', 'lib.rs') then 'rust_main' end,
    case when regexp_matches(name, '^(config|settings)\\.') then 'config' end, case when content like '#!%' then 'shebang' end], lambda x: x is not null) as signs
  from (select *, regexp_extract(path, '([^/]*)$', 1) as name from files)
), t as (
  select path, signs, list_sum(list_transform(signs, lambda x: case x when 'framework' then 80 when 'routes' then 70 when 'python_entry' then 90
    when 'go_main' then 95 when 'rust_main' then 90 when 'config' then 55 else 100 end))::bigint as score from s where len(signs) > 0
) select path, score, floor(score * 100 / (select max(score) from t)::double + 0.5)::bigint as confidence, array_to_string(list_sort(signs), ',') as signs
from t order by score desc, len(t.signs) desc, path limit 64"""
)
def q_entrypoints(spark, sf_dir):
    return rank.entrypoints(files(spark, sf_dir))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = files(spark, sf_dir)
    old = every.where("doc_id % 11 <> 0").select(
        "path",
        "size",
        (F.col("mtime") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("mtime"),
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash")).alias("hash"),
    )
    ghosts = every.where("doc_id % 13 = 0").select(F.concat(F.lit("ghost/"), "doc_id").alias("path"), "size", "mtime", "hash")
    return old.unionByName(ghosts)


_STATE_SQL = """state as (
  select path, size, mtime + case when doc_id % 5 = 0 then 1 else 0 end as mtime, case when doc_id % 10 = 0 then 'x' || hash else hash end as hash
  from files where doc_id % 11 <> 0
  union all select 'ghost/' || doc_id, size, mtime, hash from files where doc_id % 13 = 0
), planned as (
  select coalesce(f.path, s.path) as path, case when f.path is null then 'delete' when s.path is null then 'upsert' when f.mtime = s.mtime then 'unchanged'
    when f.hash <> '' and f.hash = s.hash then 'touch' else 'upsert' end as action,
    f.size as fs, f.mtime as fm, f.hash as fh, s.size as ss, s.mtime as sm, s.hash as sh
  from files f full join state s on f.path = s.path
)"""


@query(f"with {FILES_SQL}, {_STATE_SQL} select path, action from planned")
def q_incremental_plan(spark, sf_dir):
    return index.plan(files(spark, sf_dir), state(spark, sf_dir))


@query(
    f"""with {FILES_SQL}, {_STATE_SQL} select path, case when action in ('touch', 'unchanged') then ss else fs end as size,
  case when action = 'unchanged' then sm else fm end as mtime, case when action in ('touch', 'unchanged') then sh else fh end as hash
from planned where action <> 'delete'"""
)
def q_index_merge(spark, sf_dir):
    return index.merged(files(spark, sf_dir), state(spark, sf_dir))


@query(f"with {FILES_SQL}, {_STATE_SQL} select action, count(*)::bigint as files from planned group by action")
def q_plan_counts(spark, sf_dir):
    return index.plan(files(spark, sf_dir), state(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("files"))


@query(
    f"""with {FILES_SQL}, {EDGES_SQL}, raw as (select src as src_path, regexp_replace(dst, '\\.[^./]*$', '') as base from edges), c as (
  select src_path, base, unnest(['', '.ts', '.py', '.go', '.rs', '.js', '/index.ts', '/index.py', '/index.go', '/index.rs', '/index.js']) as tail,
    unnest(range(11)) as pos from raw)
select src_path, base, arg_min(path, pos) as imported_path from c join files on files.path = c.base || c.tail group by src_path, base"""
)
def q_import_resolve(spark, sf_dir):
    raw = edges(spark, sf_dir).select(F.col("src").alias("src_path"), F.regexp_replace("dst", r"\.[^./]*$", "").alias("base"))
    return index.resolve_imports(raw, files(spark, sf_dir))


_LINES_SQL = """lines as (
  select path, all_lines, k as line, all_lines[k] as excerpt from (select path, all_lines, unnest(range(1, len(all_lines) + 1)) as k from (
    select path, case when p[-1] = '' then p[1:len(p) - 1] else p end as all_lines from (select path, string_split(content, chr(10)) as p from files)))
), hits as (
  select path, line, instr(lower(excerpt), 'tion')::bigint as col, excerpt, array_to_string(all_lines[greatest(1, line - 1):line - 1], '|') as before,
    array_to_string(all_lines[line + 1:line + 1], '|') as after
  from lines where contains(lower(excerpt), 'tion')
)"""


@query(
    f"with {FILES_SQL}, {_LINES_SQL} select path, line, col, excerpt from hits qualify row_number() over (partition by path order by line) <= 20 order by path, line limit 100"
)
def q_search_content(spark, sf_dir):
    return search.capped(search.hits(files(spark, sf_dir), TERM)).select("path", "line", "col", "excerpt")


@query(f"with {FILES_SQL}, {_LINES_SQL} select path, line, before, after from hits")
def q_search_context(spark, sf_dir):
    found = search.hits(files(spark, sf_dir), TERM, context=1)
    return found.select("path", "line", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query(
    f"""with {FILES_SQL}, {_LINES_SQL}, n as (select *, row_number() over (partition by path order by line) as nth from hits)
select path, count(*)::bigint as hits, array_to_string(list(line || ':' || case when length(excerpt) <= 80 then excerpt else substr(excerpt, 1, 79) || '…' end
  order by nth) filter (where nth <= 3), chr(10)) as excerpts from n group by path order by hits desc, path limit 50"""
)
def q_search_grouped(spark, sf_dir):
    return search.grouped(search.hits(files(spark, sf_dir), TERM))


@query(
    f"""with {FILES_SQL}, {_LINES_SQL}, c as (select path, count(*) as c from hits group by path), p as (select path, 1 as p from files where contains(lower(path), 'tion'))
select coalesce(c.path, p.path) as path, (coalesce(c, 0) + coalesce(p, 0))::bigint as hits from c full join p on c.path = p.path"""
)
def q_search_both(spark, sf_dir):
    return search.content_and_paths(files(spark, sf_dir), TERM)


_SYMBOLS_SQL = """marks as (
  select path, regexp_extract(excerpt, '^([A-Za-z]+)', 1) as name, line, len(all_lines)::bigint as n from lines where regexp_matches(excerpt, '^[A-Z]')
), ranges as (select path, name, line, coalesce(lead(line) over (partition by path order by line, name) - 1, n)::bigint as last from marks)"""


@query(f"with {FILES_SQL}, {_LINES_SQL}, {_SYMBOLS_SQL} select path, name, line, last from ranges")
def q_symbol_ranges(spark, sf_dir):
    return index.symbol_ranges(index.headings(files(spark, sf_dir)))


@query(
    f"""with {FILES_SQL}, {_LINES_SQL}, {_SYMBOLS_SQL} select h.path, h.line as at, r.name, r.line, r.last from hits h join ranges r on h.path = r.path and h.line between r.line and r.last
qualify row_number() over (partition by h.path, h.line order by r.last - r.line, r.line, r.name) = 1"""
)
def q_enclosing_symbol(spark, sf_dir):
    every = files(spark, sf_dir)
    points = search.hits(every, TERM).select("path", F.col("line").alias("at"))
    return index.enclosing(points, index.symbol_ranges(index.headings(every)))


_INTERVALS_SQL = """intervals as (select l_orderkey::varchar as path, (l_partkey % 200 + 1)::bigint as first, (l_partkey % 200 + 1 + floor(l_quantity / 4))::bigint as last from lineitem),
islands as (
  select path, min(first) as first, max(last) as last from (
    select *, sum(fresh) over (partition by path order by first, last rows unbounded preceding) as island from (
      select *, case when first <= max(last) over (partition by path order by first, last rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as fresh from intervals))
  group by path, island
)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("l_partkey") % 200 + 1
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("path"), first.alias("first"), (first + F.floor(F.col("l_quantity") / 4)).cast("long").alias("last")
    )


@query(f"with {_INTERVALS_SQL} select path, first, last from islands")
def q_slice_merge(spark, sf_dir):
    return slices.merged(intervals(spark, sf_dir))


@query(
    f"""with {_INTERVALS_SQL}, g as (select *, first - lag(last) over (partition by path order by first) as gap, count(*) over (partition by path) as n from islands),
k as (select *, case when gap is null or row_number() over (partition by path order by gap nulls last, first) > n - 4 then 1 else 0 end as fresh from g)
select path, min(first) as first, max(last) as last from (select *, sum(fresh) over (partition by path order by first rows unbounded preceding) as island from k) group by path, island"""
)
def q_slice_cap(spark, sf_dir):
    return slices.capped(slices.merged(intervals(spark, sf_dir)), 4)


_MODES_SQL = """modes as (
  select path, nth, size, case when nth <= 8 then 'full' when nth <= 23 then 'slices' else 'codemap_only' end as mode,
    case when nth <= 8 then 'core' when nth <= 23 then 'support' else 'ref' end as priority
  from (select r.path, f.size, row_number() over (order by score desc, raw desc, r.path)::bigint as nth from ranked r join files f on f.path = r.path) where nth <= 53
)"""


def selection(spark: SparkSession, sf_dir: str, links: DataFrame | None = None) -> DataFrame:
    return small(select.modes(ranked(spark, sf_dir, links), files(spark, sf_dir)))


@query(f"with {_RANKED}, {_MODES_SQL} select path, nth, size, mode, priority from modes")
def q_mode_quota(spark, sf_dir):
    return selection(spark, sf_dir)


@query(
    f"""with {_RANKED}, {_MODES_SQL} select count(*) filter (where mode = 'full')::bigint as "full", count(*) filter (where mode = 'slices')::bigint as slices,
  count(*) filter (where mode = 'codemap_only')::bigint as codemap_only, count(*) filter (where priority = 'core')::bigint as core,
  count(*) filter (where priority = 'support')::bigint as support, count(*) filter (where priority = 'ref')::bigint as ref from modes"""
)
def q_selection_summary(spark, sf_dir):
    return select.summary(selection(spark, sf_dir))


_HOPS_SQL = f"""reach(path, hops) as (
  select path, 0::bigint from files where doc_id % 19 = 0 union select e.dst, hops + 1 from reach join edges e on e.src = reach.path where hops < {rank.MOST_HOPS}
), hops as (select path, min(hops) as hops from reach group by path)"""


@query(f"with recursive {FILES_SQL}, {EDGES_SQL}, {_HOPS_SQL} select path, hops from hops")
def q_import_hops(spark, sf_dir):
    return rank.import_hops(files(spark, sf_dir).where("doc_id % 19 = 0"), edges(spark, sf_dir).persist())


_PRIORITY_SQL = f"""{_HOPS_SQL}, sig as (
  select m.path, m.priority, f.doc_id % 19 = 0 as explicit, f.doc_id % 23 = 0 as mentioned, f.doc_id % 17 = 0 as changed, b.hits, h.hops
  from modes m join files f on f.path = m.path left join base b on b.path = m.path left join hops h on h.path = m.path
), prio as (
  select path, (case when explicit then 1000 else 0 end + case when mentioned then 500 else 0 end + case when changed then 100 else 0 end
    + case when regexp_matches(path, '(^|/)(main|index|app|routes|server|cli)(\\.[^/]*)?$') then 300 else 0 end
    + coalesce(floor(hits * 200 / (select max(hits) from sig)::double), 0) + coalesce(floor(150 / (hops + 1)::double), 0)
    + case priority when 'core' then 50 when 'support' then 25 else 0 end)::bigint as score from sig
)"""


def measured(spark: SparkSession, sf_dir: str, chosen: DataFrame) -> DataFrame:
    """path, id, hits and tokens of the chosen files, whose number the quotas bound: one scan."""
    own = files(spark, sf_dir).join(F.broadcast(chosen.select("path")), "path", "left_semi")
    own = own.withColumns({"full_tokens": tokens(F.col("content")), "slice_tokens": tokens(F.col("content"), 7.0)})
    return small(base_of(own, ("doc_id", "full_tokens", "slice_tokens"), unscored=True).drop("raw", "matched"))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection with the score of each file and what is known of it, on edges read once."""
    links = edges(spark, sf_dir).persist()
    chosen = selection(spark, sf_dir, links)
    own = measured(spark, sf_dir, chosen)
    wanted = [r.path for r in chosen.collect()]
    hops = rank.import_hops(files(spark, sf_dir).where("doc_id % 19 = 0"), links, wanted)
    links.unpersist()
    at = lambda k: F.col("doc_id") % k == 0
    signals = own.join(hops, "path", "left").select("path", at(19).alias("explicit"), at(23).alias("mentioned"), at(17).alias("changed"), "hits", "hops")
    scored = select.priority_scores(chosen, small(signals))
    return small(chosen.join(scored, "path").join(own.select("path", "full_tokens", "slice_tokens"), "path"))


@query(f"with recursive {_RANKED}, {_MODES_SQL}, {_PRIORITY_SQL} select path, score from prio")
def q_priority(spark, sf_dir):
    return planned(spark, sf_dir).select("path", "score")


@query(
    f"""with recursive {_RANKED}, {_MODES_SQL}, {_PRIORITY_SQL}, fine as (select m.path, m.mode, m.size, p.score from modes m join prio p on p.path = m.path where m.size <= 20000)
select path, case when mode = 'full' and row_number() over (partition by mode order by score desc, path desc) > 5 then 'slices' else mode end as mode, size, score
from fine order by score desc, path desc limit 40"""
)
def q_hard_constraints(spark, sf_dir):
    entries = planned(spark, sf_dir).select("path", "mode", "size", "score")
    return select.constrained(entries, most_files=40, most_full=5, most_bytes=20_000)


_LADDER_SQL = """entry as (
  select m.path, m.mode, p.score, ceil(length(f.content) / 3.5::double)::bigint as ft, ceil(length(f.content) / 7.0::double)::bigint as st
  from modes m join prio p on p.path = m.path join files f on f.path = m.path
), steps as (
  select path, score, 1 as phase, 'full_to_slices' as step, st - ft as delta from entry where mode = 'full'
  union all select path, score, 2, 'slices_to_codemap', 220 - st from entry where mode <> 'codemap_only'
  union all select path, score, 3, 'drop_codemap', -220 from entry
), run as (
  select row_number() over (order by phase, score, path)::bigint as ord, path, step, delta::bigint as delta,
    ((select sum(case mode when 'full' then ft when 'slices' then st else 220 end) from entry)
      + sum(delta) over (order by phase, score, path rows unbounded preceding))::bigint as total from steps
)"""


@query(f"with recursive {_RANKED}, {_MODES_SQL}, {_PRIORITY_SQL}, {_LADDER_SQL} select ord, path, step, delta, total from run where total - delta > 8000 or ord > 1 qualify coalesce(min(total) over (order by ord rows between unbounded preceding and 1 preceding), total - delta) > 8000")
def q_budget_ladder(spark, sf_dir):
    return select.ladder(planned(spark, sf_dir).select("path", "mode", "score", "full_tokens", "slice_tokens"), 8000)


@query(
    """with hunks as (select l_orderkey as path, l_linenumber as ord, (l_quantity * 10)::bigint as chars from lineitem),
f as (select o_orderkey as path, floor(o_totalprice)::bigint as relevance, 60 as header from orders),
s as (select path, sum(chars)::bigint as chars, count(*) as n from hunks group by path),
r as (select path, relevance, header, coalesce(s.chars, 0) as chars, coalesce(s.n, 0) as n, ceil((header + coalesce(s.chars, 0)) / 3.5::double)::bigint as tokens
  from f left join s using (path) order by relevance desc, coalesce(s.chars, 0) desc, path limit 2000),
run as (select *, sum(tokens) over w as upto, row_number() over w as nth from r window w as (order by relevance desc, chars desc, path rows unbounded preceding)),
one as (select path, header, 20000 - upto + tokens as room from run where upto > 20000 order by nth limit 1),
part as (select h.path, ceil((o.header + sum(h.chars) over (partition by h.path order by h.ord, h.chars rows unbounded preceding)) / 3.5::double)::bigint as cost, o.room from hunks h join one o using (path))
select path, n::bigint as hunks, tokens from run where upto <= 20000
union all select path, count(*)::bigint, max(cost) from part where cost <= room group by path"""
)
def q_patch_cap(spark, sf_dir):
    hunks = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("ord"), (F.col("l_quantity") * 10).cast("long").alias("chars")
    )
    patches = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("path"), F.floor("o_totalprice").cast("long").alias("relevance"), F.lit(60).alias("header")
    )
    return select.patch_cap(patches, hunks, 20_000, 2000)


@query(f"with {_RANKED}, {_MODES_SQL} select src, dst from edges where src in (select path from modes) and dst in (select path from modes) order by src, dst limit 20")
def q_data_flows(spark, sf_dir):
    selected = selection(spark, sf_dir)
    return select.data_flows(edges(spark, sf_dir, selected), selected)


@query(
    f"""with {_RANKED}, {_MODES_SQL}, part as (select path, 'slices' as mode, 'support' as priority from files where doc_id % 97 = 0)
select path, mode, priority, source::bigint as source from (
  select path, mode, priority, 0 as source from part
  union all select path, mode, priority, 1 from modes where path not in (select path from part))
order by source, case priority when 'core' then 0 when 'support' then 1 else 2 end, mode, path limit 30"""
)
def q_merge_discovery(spark, sf_dir):
    part = files(spark, sf_dir).where("doc_id % 97 = 0").select("path", F.lit("slices").alias("mode"), F.lit("support").alias("priority"))
    return select.keep_first(part, selection(spark, sf_dir), 30)


@query(
    r"""with a as (select len(regexp_extract_all(text, 'token = "[0-9a-f]{40}"')) as t, regexp_replace(text, 'token = "[0-9a-f]{40}"', '‹REDACTED:token_assignment›', 'g') as text from documents),
b as (select t, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) as e,
  regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', '‹REDACTED:email›', 'g') as text from a),
c as (select t, e, len(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) as i from b)
select * from (select 'token' as category, sum(t)::bigint as spans from c union all select 'email', sum(e)::bigint from c union all select 'ip', sum(i)::bigint from c) where spans > 0"""
)
def q_redact_counts(spark, sf_dir):
    return redact.counts(files(spark, sf_dir))


@query(
    r"""select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, 'token = "[0-9a-f]{40}"', '‹REDACTED:token_assignment›', 'g'),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', '‹REDACTED:email›', 'g'),
  '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '‹REDACTED:ip_address›', 'g')) as digest from documents"""
)
def q_redact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(redact.redacted(F.col("text")), 256).alias("digest"))


@query(
    """select conv_id, turn, nth, chars, case when nth > 4 or chars > 3000 then 'stop' when nth = 4 then 'last' else 'go' end as verdict from (
  select conv_id, turn, row_number() over w as nth, sum(length(text)) over w::bigint as chars from conversations window w as (partition by conv_id order by turn rows unbounded preceding))""".replace(
        "sum(length(text)) over w::bigint", "(sum(length(text)) over w)::bigint"
    )
)
def q_turn_stats(spark, sf_dir):
    return transcript.turn_gate(table(spark, sf_dir, "conversations"), 4, 3000)


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id)::bigint as nth from events where event_type = 'error'")
def q_retry_counts(spark, sf_dir):
    return transcript.failure_counts(table(spark, sf_dir, "events"), F.col("event_type") == "error")


_REPLIES = [
    (1, 0, 'I look.\n```tool\n{"id": "a", "tool": "file_search", "args": {"pattern": "x"}}\n```\nthen\n```tool\n{"id": "b", "tool": "read_file"}\n```'),
    (1, 1, "no call"),
    (2, 0, '```tool\n{"id": 7}\n```'),
    (2, 1, "```tool\n{broken\n```"),
    (2, 2, '```tool\n{"id": "c", "tool": "file_search", "args": {}}\n```'),
]


@query("select tool, calls * (select count(*) from documents) as calls, failures * (select count(*) from documents) as failures from (values ('file_search', 2::bigint, 0::bigint), ('read_file', 1, 0), (null, 2, 2)) t(tool, calls, failures)")
def q_tool_stats(spark, sf_dir):
    replies = spread(spark, sf_dir, {"ids": ("conv_id",)}, _REPLIES, "conv_id long, turn long, text string")
    return transcript.tool_stats(transcript.tool_calls(replies))


_DIFF = """diff --git a/src/a.ts b/src/a.ts
index 1..2 100644
--- a/src/a.ts
+++ b/src/a.ts
@@ -1,2 +1,3 @@
 x
-y
+z
+w
diff --git a/new.md b/new.md
new file mode 100644
--- /dev/null
+++ b/new.md
@@ -0,0 +1 @@
+hi
diff --git a/old.md b/old.md
deleted file mode 100644
--- a/old.md
+++ /dev/null
@@ -1 +0,0 @@
-bye
diff --git a/from.ts b/to.ts
similarity index 100%
rename from from.ts
rename to to.ts
diff --git a/i.png b/i.png
Binary files a/i.png and b/i.png differ
"""


@query(spread_sql(
    """select * from (values (1::bigint, 'src/a.ts', null, 'modified', false, 1::bigint, 2::bigint, 1::bigint), (1, 'new.md', null, 'added', false, 1, 1, 0),
  (1, 'old.md', null, 'deleted', false, 1, 0, 1), (1, 'to.ts', 'from.ts', 'renamed', false, 0, 0, 0), (1, 'i.png', null, 'modified', true, 0, 0, 0))
  t(diff_id, path, old_path, status, "binary", hunks, additions, deletions)""", ids=('diff_id',),
))
def q_diff_parse(spark, sf_dir):
    return transcript.parse_diff(spread(spark, sf_dir, {"ids": ('diff_id',)}, [(1, _DIFF)], "diff_id long, text string"))


_STATUS = "# branch.head main\n1 .M N... 100644 100644 100644 aa bb src/a b.ts\n1 A. N... 0 1 1 aa bb n.ts\n2 R. N... 1 1 1 aa bb R100 to.ts\tfrom.ts\nu UU N... 1 1 1 1 a b c c.ts\n? u.txt"


@query(spread_sql(
    "select * from (values (1::bigint, 'src/a b.ts', 'modified'), (1, 'n.ts', 'added'), (1, 'to.ts', 'renamed'), (1, 'c.ts', 'conflicted'), (1, 'u.txt', 'untracked')) t(status_id, path, status)", ids=('status_id',),
))
def q_status_parse(spark, sf_dir):
    return transcript.parse_status(spread(spark, sf_dir, {"ids": ('status_id',)}, [(1, _STATUS)], "status_id long, text string"))


_SOURCES = [
    ("src/m.ts", "typescript", 'import a, { b } from "./a";\nexport { c } from "../c";\nconst d = require("./d");\nimport "./side";\nexport class Foo {\n  bar() {}\n}\nexport function baz() {}'),
    ("p.py", "python", "from x.y import z\nimport os\n\ndef run(a):\n    pass\n\nclass K:\n    pass\n"),
    ("m.go", "go", 'package m\nimport (\n  "fmt"\n  "a/b"\n)\nfunc (s *S) Do() {}\n'),
    ("l.rs", "rust", "use crate::a::b;\npub fn f() {}\npub struct S;\n"),
]


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, {"heads": ("path",)}, _SOURCES, "path string, language string, content string")


@query(spread_sql(
    """select * from (values ('src/m.ts', './a', false), ('src/m.ts', '../c', true), ('src/m.ts', './d', false), ('p.py', 'x.y', false), ('p.py', 'os', false),
  ('m.go', 'fmt', false), ('m.go', 'a/b', false), ('l.rs', 'crate::a::b', false)) t(src_path, target, reexport)""", heads=('src_path',),
))
def q_imports_extract(spark, sf_dir):
    return index.raw_imports(_sources(spark, sf_dir))


@query(spread_sql(
    """select * from (values ('src/m.ts', 'class', 'Foo', 5::bigint, true), ('src/m.ts', 'function', 'baz', 8, true), ('p.py', 'function', 'run', 4, false), ('p.py', 'class', 'K', 7, false),
  ('m.go', 'function', 'Do', 6, false), ('l.rs', 'function', 'f', 2, false), ('l.rs', 'class', 'S', 3, false)) t(path, kind, name, line, exported)""", heads=('path',),
))
def q_symbols_extract(spark, sf_dir):
    return index.symbols(_sources(spark, sf_dir)).select("path", "kind", "name", "line", "exported")


@query(
    f"""with {FILES_SQL}, {_LINES_SQL} select path, line, lpad(line::varchar, greatest(4, length(line::varchar))::int, ' ') || ' | ' || excerpt as text
from lines where line between 3 and 7"""
)
def q_read_lines(spark, sf_dir):
    return search.numbered_lines(files(spark, sf_dir), 3, 7)


@query(
    f"""with {FILES_SQL}, {_LINES_SQL}, a as (select path, min(line) as line, any_value(all_lines) as x from lines where contains(excerpt, 'tion') group by path)
select path, line, array_to_string(x[greatest(1, line - 8):line + 8], chr(10)) as text from a"""
)
def q_snippet(spark, sf_dir):
    return search.snippet(files(spark, sf_dir), TERM)


@query("select d.doc_id, d.source from documents d where d.doc_id in (select doc_id from labels where toxic = 1)")
def q_scope_filter(spark, sf_dir):
    chosen = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(chosen, "doc_id", "left_semi")


@query("select d.doc_id, d.source from documents d where d.doc_id not in (select doc_id from labels)")
def q_unlabelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    """with e as (select event_id as ord, user_id::varchar as path, case event_type when 'error' then 'remove' else 'add' end as action, case when event_id % 2 = 0 then 'full' else 'slices' end as mode from events)
select path, arg_max(mode, ord) as mode from e group by path having arg_max(action, ord) <> 'remove'"""
)
def q_selection_state(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.col("user_id").cast("string").alias("path"),
        F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"),
        F.when(F.col("event_id") % 2 == 0, "full").otherwise("slices").alias("mode"),
    )
    return select.last_events(events)


@query(
    f"""with {FILES_SQL}, {_LINES_SQL}, near as (select h.path, greatest(1, h.line - 3)::bigint as first, least(n, h.line + 3)::bigint as last
  from hits h join (select path, max(line) as n from lines group by path) using (path)),
islands as (
  select path, min(first) as first, max(last) as last from (
    select *, sum(fresh) over (partition by path order by first, last rows unbounded preceding) as island from (
      select *, case when first <= max(last) over (partition by path order by first, last rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as fresh from near))
  group by path, island),
g as (select *, first - lag(last) over (partition by path order by first) as gap, count(*) over (partition by path) as n from islands),
k as (select *, case when gap is null or row_number() over (partition by path order by gap nulls last, first) > n - 4 then 1 else 0 end as fresh from g)
select path, min(first) as first, max(last) as last from (select *, sum(fresh) over (partition by path order by first rows unbounded preceding) as island from k) group by path, island"""
)
def q_term_slices(spark, sf_dir):
    every = files(spark, sf_dir)
    sizes = every.groupBy("path").agg(F.max(F.size(lines_of(F.col("content")))).cast("long").alias("n"))
    return slices.for_hits(search.hits(every, TERM).select("path", "line"), sizes, context=3)


@query(f"with {FILES_SQL} select regexp_extract(path, '([^/]*)$', 1) as name, count(*)::bigint as files, max(size)::bigint as largest from files group by 1")
def q_names(spark, sf_dir):
    return files(spark, sf_dir).groupBy(base_name(F.col("path")).alias("name")).agg(F.count("*").alias("files"), F.max("size").alias("largest"))


@query(
    """select event_type, count(value)::bigint as runs, round(avg(value), 4) as average, min(value) as least, max(value) as greatest,
  quantile_disc(value, 0.95) as p95 from events group by event_type"""
)
def q_timing_stats(spark, sf_dir):
    return report.timing_stats(table(spark, sf_dir, "events"), "event_type", "value")


@query(
    f"""with {FILES_SQL} select count(*)::bigint as files, sum(size)::bigint as bytes, ceil(sum(size) / 4.0::double)::bigint as tokens,
  least(100, floor(100 * ceil(sum(size) / 4.0::double)::bigint / 5000000::double))::bigint as percent from files"""
)
def q_estimate(spark, sf_dir):
    return report.estimate(files(spark, sf_dir), 5_000_000)


@query(
    f"""with {FILES_SQL}, s as (select path, (10 * (contains(lower(path), 'src1')::int + contains(lower(path), 'util')::int)
  + regexp_matches(path, '(^|/)(main|index|app|server|cli)\\.[^/]*$')::int)::bigint as score from files)
select path, score from s where score > 0 order by score desc, path limit 12"""
)
def q_likely_files(spark, sf_dir):
    return report.likely_files(files(spark, sf_dir), ["src1", "util"])


@query(f"with {FILES_SQL}, {_LINES_SQL} select path, 5::bigint as kept, (count(*) - 5)::bigint as omitted from hits group by path having count(*) > 5")
def q_search_omitted(spark, sf_dir):
    return report.omitted(search.hits(files(spark, sf_dir), TERM), 5)


@query(f"with {FILES_SQL}, {_STATE_SQL} select f.path, s.path is not null as hit from files f left join state s on s.path = f.path and s.hash = f.hash")
def q_cache_hits(spark, sf_dir):
    return report.cached(files(spark, sf_dir), state(spark, sf_dir))


@query("select text, min(doc_id) as doc_id from documents group by text")
def q_first_of_each(spark, sf_dir):
    return report.first_of_each(table(spark, sf_dir, "documents").select("text", "doc_id"), ["text"], ["doc_id"])


@query(
    f"""with {FILES_SQL} select path, case when regexp_matches(path, '^src2/en/') then false when regexp_matches(path, '^src2/') then true
  when regexp_matches(path, '^src4/.*[.]md$') then true else false end as ignored from files"""
)
def q_ignored(spark, sf_dir):
    rules = spark.createDataFrame(
        [(0, 0, "", "^src2/.*$", False), (0, 1, "", "^src4/.*[.]md$", False), (1, 0, "src2", "^en/.*$", True)],
        "layer int, ord int, base string, regex string, negated boolean",
    )
    return scan.ignored(files(spark, sf_dir).select("path"), rules)


@query(
    """select user_id, array_to_string(list_sort(list(distinct part)), '; ') as parts from (
  select user_id, unnest([event_type, props]) as part from events) where part <> '' group by user_id"""
)
def q_distinct_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.concat_ws("; ", "event_type", "props").alias("x"))
    return report.distinct_parts(rows, "user_id", "x")


@query("select event_type, count(*)::bigint as events, sum(coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0))::bigint as k from events group by event_type")
def q_json_fields(spark, sf_dir):
    k = F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') as bigint)"), F.lit(0).cast("long"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("k"))


from corpusmill.plans import changes, more, pieces, signals  # noqa: E402, F401  (registers the rest)
