"""Further registered queries, most on literal rows with results worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.functions.text import tokens
from corpusmill.operators import index, payload, rank, redact, report, runs, scan, search, select, slices, transcript
from corpusmill.plans.registry import (
    _DIFF,
    _HINT_SQL,
    _LADDER_SQL,
    _LINES_SQL,
    _MODES_SQL,
    _PRIORITY_SQL,
    _RANKED,
    _STATE_SQL,
    _SYMBOLS_SQL,
    REASON_SQL,
    files,
    planned,
    query,
    scanned,
    selection,
    small,
    spread,
    spread_sql,
    state,
    table,
)
from corpusmill.sources.corpus import FILES_SQL
from corpusmill.sources.shared import shared_folder, written


def made(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- scans


_IGNORED = [
    (".gitignore", "# build\n*.log\n!keep.log\n/dist/\n\nvendor"),
    ("a/.gitignore", "tmp/*\n!tmp/one.txt\n!x.log  "),
    ("x.log", ""),
    ("keep.log", ""),
    ("a/x.log", ""),
    ("dist/m.js", ""),
    ("a/dist/m.js", ""),
    ("a/tmp/one.txt", ""),
    ("a/tmp/two.txt", ""),
    ("a/vendor/keep.log", ""),
    ("b/vendor.txt", ""),
]


@query(spread_sql(
    """select * from (values ('.gitignore', null), ('a/.gitignore', null), ('x.log', 'ignored'), ('keep.log', null), ('a/x.log', null), ('dist/m.js', 'ignored'), ('a/dist/m.js', 'excluded'),
  ('a/tmp/one.txt', null), ('a/tmp/two.txt', 'ignored'), ('a/vendor/keep.log', 'ignored'), ('b/vendor.txt', null)) t(path, reason)""", heads=('path',),
))
def q_ignore_files(spark, sf_dir):
    every = spread(spark, sf_dir, {"heads": ('path',)}, _IGNORED, "path string, content string").withColumn("size", F.octet_length("content").cast("long"))
    return scan.classify(every, 1000, exclude=["**/*.js"], rules=scan.ignore_rules(every)).select("path", "reason")


@query(
    f"""with {FILES_SQL}, named as (select regexp_extract(path, '^([^/]+)/', 1) as top, path from files
  qualify dense_rank() over (order by regexp_extract(path, '^([^/]+)/', 1)) <= 2),
dirs as (select distinct top, regexp_extract(path, '^([^/]+/[^/]+)/', 1) as dir from named),
kept as (select top, dir, row_number() over (partition by top order by dir) as nth from dirs)
select * from (select distinct top as path, true as folder, 1::bigint as depth, (select count(*) from kept k where k.top = named.top and nth > 2)
    + (select 2 * count(*) from named n join kept k on n.top = k.top and starts_with(n.path, k.dir || '/') where k.top = named.top and nth > 2) as omitted from named
  union all select dir, true, 2, 2 * (select count(*) from named n where starts_with(n.path, k.dir || '/')) from kept k where nth <= 2)"""
)
def q_tree_caps(spark, sf_dir):
    found = scan.capped_tree(files(spark, sf_dir), per_level=2, most_depth=2)
    return found.where("path <> ''")


@query(
    f"""with {FILES_SQL}, n as (select path, row_number() over (order by path) as nth, count(*) over () as n from files)
select nth::bigint as ord, case when nth = 41 and n > 41 then '... ' || (n - 40) || ' more' else path end as text from n where nth <= 41"""
)
def q_listing(spark, sf_dir):
    return scan.listing(files(spark, sf_dir), 40)


@query(
    f"""with {FILES_SQL}, {_LINES_SQL}, {_SYMBOLS_SQL}, m as (
  select distinct array_to_string(string_split(path, '/')[1:2], '/') as module, ['class', 'function', 'module', 'type', 'odd'][(line % 5 + 1)::int] as kind, path, line, name as signature from ranges),
r as (select *, row_number() over (partition by module order by kind <> 'module', case kind when 'class' then 1 when 'function' then 2 when 'type' then 4 when 'module' then 6 else 9 end, path, line, signature) as nth from m)
select module, nth, kind, path, line, signature from r where nth <= 3"""
)
def q_module_symbols(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("class", "function", "module", "type", "odd")))
    marks = index.headings(files(spark, sf_dir)).select("path", F.get(kinds, (F.col("line") % 5).cast("int")).alias("kind"), "line", F.col("name").alias("signature"))
    return scan.module_symbols(marks, 3)


@query(f"with {FILES_SQL} select count(distinct m)::bigint as modules, greatest(0, count(distinct m) - 5)::bigint as omitted from (select array_to_string(string_split(path, '/')[1:2], '/') as m from files)")
def q_modules_omitted(spark, sf_dir):
    return scan.omitted_modules(files(spark, sf_dir), 5)


@query(
    f"""with {FILES_SQL}, {REASON_SQL}, {_STATE_SQL}, h as (select hint, count(distinct dir) as dirs from (select {_HINT_SQL} as hint, dir from
  (select regexp_extract(path, '([^/]*)$', 1) as name, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from files)) where hint is not null group by hint)
select (select count(*) from files)::bigint as files, (select sum(size) from files)::bigint as bytes, (select string_agg(distinct language, ',' order by language) from files) as languages,
  case when (select count(*) from planned where action <> 'unchanged' and fh is distinct from sh) > 0 then 'stale' else 'fresh' end as "index",
  (select string_agg(reason || ':' || n, ',' order by reason) from (select reason, count(*) as n from scanned where reason is not null group by reason)) as reasons,
  (select string_agg(hint || ':' || dirs, ',' order by hint) from h) as hints"""
)
def q_repository(spark, sf_dir):
    every = files(spark, sf_dir)
    return scan.repository(every, state(spark, sf_dir), scanned(spark, sf_dir).where("reason is not null"), scan.build_hints(every))


@query("select g::varchar as module, count(*)::bigint as files from (select 'group' || (i % 7) || '/layer' || ((i // 7) % 5) as g from range((select count(*) from documents)) t(i)) group by g")
def q_synthetic(spark, sf_dir):
    made_up = scan.synthetic(spark, table(spark, sf_dir, "documents").count())
    return made_up.groupBy(text.module(F.col("path")).alias("module")).agg(F.count("*").alias("files"))


# --- search and paths


@query(
    f"""with {FILES_SQL} select path from files where contains(lower(path), 'util') and starts_with(path, 'src1/') and regexp_matches(path, '\\.(ts|py|md|json)$')
  and not regexp_matches(path, '^src1/de/') order by path limit 30"""
)
def q_search_paths(spark, sf_dir):
    return search.paths(files(spark, sf_dir), "UTIL", endings=[".ts", "PY", "md", "json"], exclude=["src1/de/**"], under="src1", limit=30)


@query(
    f"""with {FILES_SQL} select asked, path from (values ('src1/en'), ('src2'), ('none')) a(asked) left join files on starts_with(path, asked || '/')
union all select '.', path from files"""
)
def q_expanded(spark, sf_dir):
    return search.expanded(files(spark, sf_dir), made(spark, [("src1/en/",), ("src2",), ("none",), (".",)], "asked string"))


@query(
    f"""with {FILES_SQL} select path, regexp_matches(path, '(^|/)tests?/') or regexp_matches(lower(path), '\\.(test|spec)\\.[a-z0-9]+$') as test from files
union all select * from (values ('tests/a.py', true), ('a/Test/b.go', true), ('x.spec.rs', true), ('x.test.', false), ('latest/x.ts', false)) t"""
)
def q_test_paths(spark, sf_dir):
    more = made(spark, [(p,) for p in ("tests/a.py", "a/Test/b.go", "x.spec.rs", "x.test.", "latest/x.ts")], "path string")
    return files(spark, sf_dir).select("path").unionByName(more).select("path", text.is_test_path(F.col("path")).alias("test"))


@query(
    f"""with {FILES_SQL}, {_LINES_SQL}, m as (select path, line, list_filter(['ab', 'tion', 'zz'], lambda t: contains(lower(excerpt), t)) as m from lines)
select path, line, array_to_string(m, ',') as matched from m where len(m) > 0"""
)
def q_term_lines(spark, sf_dir):
    found = slices.term_lines(files(spark, sf_dir), [" Tion", "zz", "ab", "ab", "x"])
    return found.withColumn("matched", F.array_join("matched", ","))


# --- ranking


_PACKAGE = [
    ("package.json", '{"main": "./dist/run", "bin": {"a": "bin/a.js", "b": 7}, "exports": {".": {"import": "./lib/index.mjs", "require": ["lib/none.cjs", "./src/old"]}}}'),
    ("pkg/package.json", '{"main": "../shared/x.ts", "bin": "cli"}'),
    ("bad/package.json", "{broken"),
    ("list/package.json", "[1]"),
    *[(p, "") for p in ("dist/run.js", "dist/run/index.ts", "bin/a.js", "lib/index.mjs", "src/old/index.tsx", "shared/x.ts", "pkg/cli.py", "pkg/cli.ts")],
]


@query(spread_sql(
    """select * from (values ('dist/run/index.ts', 'package_main', 120::bigint), ('bin/a.js', 'package_bin', 110), ('lib/index.mjs', 'package_exports', 95),
  ('src/old/index.tsx', 'package_exports', 95), ('shared/x.ts', 'package_main', 120), ('pkg/cli.ts', 'package_bin', 110)) t(path, sign, confidence)""", heads=('path',),
))
def q_package_entrypoints(spark, sf_dir):
    return rank.package_entrypoints(spread(spark, sf_dir, {"heads": ('path',)}, _PACKAGE, "path string, content string"))


@query(
    f"""with {FILES_SQL}, signs as (
  select path, 'package_bin' as sign, 110 as n from files where doc_id % 3 = 0 union all select path, 'package_bin', 90 from files where doc_id % 2 = 0
  union all select path, 'package_main', 120 from files where doc_id % 5 = 0 union all select path, 'config', 55 from files where doc_id % 7 <> 0
  union all select path, 'shebang', 100 from files where doc_id % 11 = 0 union all select path, 'cli_bin_dir', 10 from files where doc_id % 4 = 0
), best as (select path, sign, max(n) as n from signs group by all), per as (select path, sum(n)::bigint as score, list_sort(list(sign)) as signs from best group by path),
top as (select * from per order by score desc, len(signs) desc, path limit 64)
select path, score, floor(score * 100 / (max(score) over ())::double + 0.5)::bigint as confidence, array_to_string(signs, ',') as signs from top"""
)
def q_evidence(spark, sf_dir):
    every = files(spark, sf_dir)
    signs = lambda rule, sign, n: every.where(rule).select("path", F.lit(sign).alias("sign"), F.lit(n).cast("long").alias("confidence"))
    one = signs("doc_id % 3 = 0", "package_bin", 110).unionByName(signs("doc_id % 2 = 0", "package_bin", 90)).unionByName(signs("doc_id % 5 = 0", "package_main", 120)).unionByName(signs("doc_id % 7 <> 0", "config", 55))
    two = signs("doc_id % 11 = 0", "shebang", 100).unionByName(signs("doc_id % 4 = 0", "cli_bin_dir", 10))
    return rank.evidence(one, two)


@query(
    f"""with {FILES_SQL}, {_LINES_SQL}, {_SYMBOLS_SQL}, parts as (
  select path, 0 as part, 0::bigint as pos, path as x from files
  union all select path, 1, line, name || chr(10) || name || ' ' || last from ranges
  union all select path, 2, 0, 'lib/' || language || chr(10) || 'A' || chr(10) || 'b' from files)
select path, substr(sha256(lower(string_agg(x, chr(10) order by part, pos, x))), 1, 12) as digest from parts group by path"""
)
def q_search_text(spark, sf_dir):
    every = files(spark, sf_dir)
    marks = index.symbol_ranges(index.headings(every)).select("path", "name", F.concat_ws(" ", "name", "last").alias("signature"), "line")
    imports = every.select("path", F.concat(F.lit("lib/"), "language").alias("target"), F.array(F.lit("A"), F.lit("b")).alias("names"))
    return rank.search_text(every, marks, imports).select("path", text.stable_hash(F.col("text")).alias("digest"))


@query(
    f"""with {FILES_SQL}, changed as (select path, regexp_replace(path, '\\.[^./]*$', '') as stem, regexp_extract(path, '(\\.[^./]+)$', 1) as ending, doc_id from files where doc_id % 17 = 0),
tests as (select regexp_replace(path, '\\.[^./]*$', '') || '.test' || regexp_extract(path, '(\\.[^./]+)$', 1) as test_path from files where doc_id % 2 = 0
  union all select 'tests/' || split_part(path, '/', 1) || '/' || regexp_extract(path, '([^/]*)\\.[^./]*$', 1) || '_' || doc_id || '.py' from files where doc_id % 5 = 0),
direct as (select stem || '.test' || ending as test_path, path from changed where doc_id % 2 = 0),
words as (select path, regexp_extract(stem, '([^/]*)$', 1) as name, list_filter(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), lambda w: len(w) > 1 and w <> 'src') as words from changed where doc_id % 2 = 1)
select test_path, path from direct union all select distinct test_path, path from words, (select distinct test_path from tests) where contains(test_path, name) and len(list_filter(words, lambda w: contains(test_path, w))) > 0"""
)
def q_tests_of(spark, sf_dir):
    every = files(spark, sf_dir)
    stem, ending = F.regexp_replace("path", r"\.[^./]*$", ""), F.regexp_extract("path", r"(\.[^./]+)$", 1)
    beside = every.where("doc_id % 2 = 0").select(F.concat(stem, F.lit(".test"), ending).alias("path"))
    apart = every.where("doc_id % 5 = 0").select(F.concat(F.lit("tests/"), F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1), F.lit("_"), "doc_id", F.lit(".py")).alias("path"))
    return rank.tests_of(every.where("doc_id % 17 = 0").select("path"), every.select("path").unionByName(beside).unionByName(apart))


_MENTIONS = "Look at SRC0\\\\FR\\\\D000000000000/main.ts first, then at src1/en/d000000000001/Util.py"


@query(f"with {FILES_SQL} select path from files where contains(lower(replace('{_MENTIONS}', chr(92), '/')), lower(path))")
def q_mentioned(spark, sf_dir):
    return rank.mentioned(files(spark, sf_dir), _MENTIONS)


@query(f"with {FILES_SQL} select path from files")
def q_changed_paths(spark, sf_dir):
    every = files(spark, sf_dir)
    odd = every.select(F.concat(F.lit(" ./"), F.replace("path", F.lit("/"), F.lit("\\")), F.lit(" ")).alias("path"))
    none = every.select(F.when(F.col("doc_id") % 2 == 0, "").alias("path"))
    return rank.changed_paths(every.select("path").unionByName(odd).unionByName(none))


# --- index


_SCRIPT = 'import def, { b as c, a } from "./x";\nimport type { T } from "./t";\nexport { z } from "./z";\nexport * from "./all";\nimport "./side";\n'


@query(spread_sql(
    "select * from (values ('m.ts', './all', '', true), ('m.ts', './t', 'T', false), ('m.ts', './x', 'a,b,def', false), ('m.ts', './z', 'z', true)) t(src_path, target, names, reexport)", heads=('src_path',),
))
def q_imported_names(spark, sf_dir):
    found = index.imported_names(spread(spark, sf_dir, {"heads": ('path',)}, [("m.ts", "typescript", _SCRIPT), ("p.py", "python", _SCRIPT)], "path string, language string, content string"))
    return found.withColumn("names", F.array_join("names", ","))


_CODE = "export class Foo {\n  async function bar() {}\n}\ndef run(a):\n  class In: pass\n"


@query(spread_sql(
    "select * from (values ('complete', 1::bigint, 'Foo'), ('complete', 2, 'bar'), ('complete', 4, 'run'), ('complete', 5, 'In'), ('summary', 1, 'Foo'), ('summary', 4, 'run')) t(detail, line, name)",
))
def q_outline(spark, sf_dir):
    code = spread(spark, sf_dir, {"heads": ('path',)}, [("m.ts", _CODE)], "path string, content string")
    of = lambda detail: index.outline(code, detail).select(F.lit(detail).alias("detail"), "line", "name")
    return of("complete").unionByName(of("summary"))


@query(spread_sql(
    "select * from (values ('export default class Foo', 'default'), ('pub fn go()', 'go'), ('class type', 'class'), ('=> 7', 'symbol'), ('static enum E', 'E')) t(signature, name)",
))
def q_symbol_names(spark, sf_dir):
    rows = spread(spark, sf_dir, {}, [("export default class Foo",), ("pub fn go()",), ("class type",), ("=> 7",), ("static enum E",)], "signature string")
    return rows.select("signature", text.symbol_name(F.col("signature")).alias("name"))


@query(spread_sql(
    "select * from (values ('a', 3::bigint, 4::bigint, 'inner', true), ('a', 8, 12, 'outer', true), ('a', 15, 25, 'tail', false)) t(path, first, last, name, contained)", heads=('path',),
))
def q_enclosing_ranges(spark, sf_dir):
    marks = spread(spark, sf_dir, {"heads": ('path',)}, [("a", "outer", 1, 14, "s1"), ("a", "inner", 2, 5, "s2"), ("a", "tail", 20, 22, "s3"), ("a", "far", 500, 900, "s4")], "path string, name string, line long, last_line long, signature string")
    spans = spread(spark, sf_dir, {"heads": ('path',)}, [("a", 3, 4), ("a", 8, 12), ("a", 15, 25), ("a", 100, 110), ("b", 1, 2)], "path string, first long, last long")
    return index.enclosing_ranges(spans, marks).select("path", "first", "last", "name", "contained")


@query(
    f"""with {FILES_SQL}, {_LINES_SQL}, {_SYMBOLS_SQL}, one as (select min(path) as path from files)
select path, hash, (select count(*) from ranges r where r.path = f.path)::bigint as symbols from files f where path in (select path from one)"""
)
def q_index_lookup(spark, sf_dir):
    every = files(spark, sf_dir)
    first = every.agg(F.min("path")).first()[0]
    marks = index.headings(every).select("path", "line", F.col("name").alias("signature"), F.lit("text").alias("kind"))
    found = index.lookup(every, marks, [first, "no/such"])
    return found.select("path", "hash", F.size("symbols").cast("long").alias("symbols"))


@query(f"with {FILES_SQL}, {_STATE_SQL} select count(*)::bigint as files, sum(size)::bigint as bytes, max(mtime) as latest, true as current from state")
def q_index_status(spark, sf_dir):
    return index.status(state(spark, sf_dir))


# --- selections


@query(
    f"""with recursive {_RANKED}, {_MODES_SQL}, {_PRIORITY_SQL}, {_LADDER_SQL}, all_steps as (
  select path, score, 1 as phase, 'full_to_slices' as step, 'degrade ' || path || ' full->slices' as reason, st - ft as delta from entry where mode = 'full'
  union all select path, score, 2, 'slices_to_codemap_only', 'degrade ' || path || ' slices->codemap_only', 220 - st from entry where mode <> 'codemap_only'
  union all select path, score, 3, 'drop_codemap_only', 'drop ' || path || ' codemap_only', -220 from entry
  union all select path, 0, 4, 'codemap_complete_to_summary', 'shrink codemap detail for ' || path || ' complete->summary', 0 from entry
  union all select null, k, 5, 'shrink_slice_windows', r, 0 from (values (0, 'shrink slice context +/-30->+/-20'), (1, 'shrink slice context +/-20->+/-10')) t(k, r)
  union all select null, k, 6, 'reduce_tree_verbosity', r, d from (values (0, 'reduce tree verbosity full->selected', -600), (1, 'reduce tree verbosity selected->none', -300)) t(k, r, d)
), run2 as (
  select row_number() over (order by phase, score, path)::bigint as ord, path, step, reason, delta::bigint as delta,
    ((select sum(case mode when 'full' then ft when 'slices' then st else 220 end) from entry) + 480 + 900 + sum(delta) over (order by phase, score, path rows unbounded preceding))::bigint as total
  from all_steps
) select * from run2 qualify coalesce(least(min(total) over (order by ord rows between unbounded preceding and 1 preceding), first_value(total - delta) over (order by ord)), total - delta) > 800"""
)
def q_full_ladder(spark, sf_dir):
    entries = planned(spark, sf_dir).select("path", "mode", "score", "full_tokens", "slice_tokens")
    return select.full_ladder(entries.withColumn("detail", F.lit(None).cast("string")), 1000, reserve=200, fixed=480, tree={"full": 900, "selected": 300, "none": 0})


_REASONS = [
    (1, "full_to_slices", "degrade a->b.ts full->slices", -5),
    (2, "drop_codemap_only", "drop x y.ts codemap_only", -220),
    (3, "codemap_complete_to_summary", "shrink codemap detail for c.ts complete->summary", 0),
    (4, "shrink_slice_windows", "shrink slice context +/-30->+/-20", 0),
    (5, "reduce_tree_verbosity", "reduce tree verbosity full->selected", -7),
    (6, "other", "else", 1),
]


@query(spread_sql(
    """select * from (values (1::bigint, 'full_to_slices', 'a->b.ts', 'full', 'slices', -5::bigint), (2, 'drop_codemap_only', 'x y.ts', 'codemap_only', null, -220),
  (3, 'codemap_complete_to_summary', 'c.ts', 'complete', 'summary', 0), (4, 'shrink_slice_windows', null, '+/-30', '+/-20', 0),
  (5, 'reduce_tree_verbosity', null, 'full', 'selected', -7), (6, 'other', null, null, null, 1)) t(ord, action, path, before, after, saved)""", ids=('ord',),
))
def q_ladder_replay(spark, sf_dir):
    return select.replayed(spread(spark, sf_dir, {"ids": ('ord',)}, _REASONS, "ord long, step string, reason string, delta long"))


@query(
    f"""with {_RANKED}, {_MODES_SQL}, t as (select m.path, m.mode, ceil(length(f.content) / 3.5::double)::bigint as tokens from modes m join files f on f.path = m.path),
s as (select 'section' as part, name, tokens, 0::bigint as files from (values ('metadata', 180::bigint), ('task', 12)) v(name, tokens) union all select 'section', 'files', sum(tokens)::bigint, count(*) from t)
select 'file' as part, path as name, tokens, 1::bigint as files from t union all select 'mode', mode, sum(tokens)::bigint, count(*) from t group by mode
union all select * from s union all select 'total', 'total', sum(tokens)::bigint, sum(files)::bigint from s"""
)
def q_token_report(spark, sf_dir):
    chosen = selection(spark, sf_dir)
    own = files(spark, sf_dir).join(F.broadcast(chosen.select("path", "mode")), "path")
    return select.token_report(small(own.select("path", "mode", tokens(F.col("content")).alias("tokens"))), {"metadata": 180, "task": 12})


@query(spread_sql(
    "select * from (values ('a', 29::bigint), ('b', 120), ('c', 69), ('d', 0)) t(path, tokens)", heads=('path',),
))
def q_estimated(spark, sf_dir):
    rows = [("a", "full", 100, None), ("b", "codemap_only", 9, None), ("c", "slices", 9, [(1, 2), (5, 5)]), ("d", "full", None, None)]
    return select.estimated(spread(spark, sf_dir, {"heads": ('path',)}, rows, "path string, mode string, size long, slices array<struct<first:long,last:long>>"))


_REQUESTS = [
    (1, 1, "a", "full", 1, False, False),
    (1, 2, "b", "full", 1, False, False),
    (1, 3, "a", "slices", 1, False, False),
    (1, 4, "b2", "full", 1, False, False),
    (1, 5, "c", "slices", 1, False, False),
    (1, 6, "a", "full", 1, False, False),
    (1, 7, " ", "full", 1, False, False),
    (1, 8, "n", "slices", 1, True, True),
    (1, 9, "i.png", "slices", 99, False, True),
    (1, 10, "big", "slices", 99, False, False),
    (2, 1, "c", "wrong", 1, None, None),
    (2, 2, "c", "full", None, None, None),
]


@query(spread_sql(
    """select * from (values (1::bigint, 1::bigint, 'a', 'full', null), (1, 2, 'b', 'full', 'MAX_FULL_FILES_EXCEEDED'), (1, 3, 'a', 'slices', null), (1, 4, 'b2', 'full', null), (1, 5, 'c', 'slices', 'MAX_FILES_EXCEEDED'),
  (1, 6, 'a', 'full', 'MAX_FULL_FILES_EXCEEDED'), (1, 7, ' ', 'full', 'INVALID_SELECTION_ENTRY'), (1, 8, 'n', 'slices', 'NEVER_INCLUDE_MATCH'), (1, 9, 'i.png', 'slices', 'BINARY_FILE_EXCLUDED'),
  (1, 10, 'big', 'slices', 'FILE_TOO_LARGE'), (2, 1, 'c', 'wrong', 'INVALID_SELECTION_ENTRY'), (2, 2, 'c', 'full', null)) t(session, ord, path, mode, error)""", ids=('session',),
))
def q_admission(spark, sf_dir):
    rows = spread(spark, sf_dir, {"ids": ('session',)}, _REQUESTS, "session long, ord long, path string, mode string, size long, never boolean, binary boolean")
    return select.admitted(rows, most_files=2, most_full=1, most_bytes=50)


@query(f"with {FILES_SQL} select path from files where doc_id % 31 = 0 or doc_id % 37 = 0 or regexp_matches(path, '^src1/.*/config\\.[^/]*$')")
def q_explicit(spark, sf_dir):
    every = files(spark, sf_dir)
    return select.explicit(every, every.where("doc_id % 31 = 0"), every.where("doc_id % 37 = 0"), ["src1/**/config.*"])


@query(spread_sql(
    "select * from (values ('a', 3::bigint), ('b', 0)) t(path, value)", heads=('path',),
))
def q_path_numbers(spark, sf_dir):
    rows = [("A", 9.5), ("a", 3.7), ("b", 0.0), ("c", -1.0), ("d", float("nan")), ("e", float("inf")), ("f", None)]
    return select.path_numbers(spread(spark, sf_dir, {"heads": ('path',)}, rows, "path string, value double"))


@query(spread_sql(
    "select * from (values ('a', 'offline score=9, content_hits=2, path_hits=0'), ('b', 'offline score=1, content_hits=0, path_hits=1, import_boost=4, git_bias=90')) t(path, rationale)", heads=('path',),
))
def q_rationale(spark, sf_dir):
    rows = [("a", 9, 2, 0, 0, 0, 0), ("b", 1, 0, 1, 4, 0, 90)]
    return select.rationale(spread(spark, sf_dir, {"heads": ('path',)}, rows, "path string, score long, content_hits long, path_hits long, import_boost long, entrypoint_boost long, git_bias long"))


@query(spread_sql(
    "select * from (values ('a', 1::bigint, 6::bigint, 'x; y; z'), ('a', 9, 9, 'w'), ('b', 1, 2, '')) t(path, first, last, description)", heads=('path',),
))
def q_slices_described(spark, sf_dir):
    rows = [("a", 1, 3, "x; y"), ("a", 4, 6, "y;  z"), ("a", 9, 9, "w"), ("b", 1, 2, "")]
    return slices.described(spread(spark, sf_dir, {"heads": ('path',)}, rows, "path string, first long, last long, description string"))


@query(spread_sql(
    "select * from (values ('a', 3::bigint, 9::bigint), ('a', 12, 14), ('b', 2, 4), ('c', 1, 2)) t(path, first, last)", heads=('path',),
))
def q_slices_for_terms(spark, sf_dir):
    body = "\n".join("needle" if k in (5, 13) else "line" for k in range(1, 21))
    every = spread(spark, sf_dir, {"heads": ('path',)}, [("a", body), ("b", "x\ny\nz\nw"), ("c", "p\nq\nr\ns")], "path string, content string")
    marks = spread(spark, sf_dir, {"heads": ('path',)}, [("a", "f", "f()", 3, 9), ("b", "g", "g()", 2, 4)], "path string, name string, signature string, line long, last_line long")
    return slices.for_terms(every, marks, ["Needle"], context=1)


# --- redaction


_SECRET_ROWS = [
    (1, "k\n-----BEGIN RSA PRIVATE KEY-----\nMII\n-----END RSA PRIVATE KEY-----\nurl=postgres://al:pw@db:5432/app"),
    (2, 'access_token="' + "Ab3" * 10 + '"\nh=Bearer ' + "Ab3" * 10),
    (3, "old=‹REDACTED:jwt_token› AKIA" + "B" * 16 + " ghp_" + "a" * 36),
    (4, "ACME-12 and acme-13"),
    (5, "hash d41d8cd98f00b204e9800998ecf8427e"),
    (6, None),
]


@query(spread_sql(
    """select * from (values (1::bigint, 2::bigint, 'k' || chr(10) || '‹REDACTED:private_key_block›' || chr(10) || chr(10) || chr(10) || 'url=‹REDACTED:postgres_uri_with_credentials›'),
  (2, 2, 'access_token="‹REDACTED:oauth_token_assignment›"' || chr(10) || 'h=Bearer ‹REDACTED:bearer_token›'), (3, 2, 'old=‹REDACTED:jwt_token› ‹REDACTED:aws_access_key_id› ‹REDACTED:github_token›'),
  (4, 2, '‹REDACTED:custom_pattern_1› and ‹REDACTED:custom_pattern_1›'), (5, 0, 'hash d41d8cd98f00b204e9800998ecf8427e'), (6, 0, null)) t(id, n, redacted)""", ids=('id',),
))
def q_redact_sweep(spark, sf_dir):
    custom, _ = redact.custom_patterns([r"/\bacme-\d+/i", "(", "x{2,1}"])
    found = redact.swept(spread(spark, sf_dir, {"ids": ('id',)}, _SECRET_ROWS, "id long, content string"), redact.PATTERNS + redact.ASSIGNED + tuple(custom))
    return found.select("id", F.size("spans").cast("long").alias("n"), "redacted")


@query(
    """select category, reason, n * (select count(*) from documents) as n from (values ('api_key', 'aws_access_key_id', 1::bigint), ('api_key', 'github_token', 1), ('api_key', null, 2), ('private_key', 'private_key_block', 1), ('private_key', null, 1),
  ('token', 'bearer_token', 1), ('token', 'oauth_token_assignment', 1), ('token', null, 2), ('uri', 'postgres_uri_with_credentials', 1), ('uri', null, 1), (null, null, 6)) t(category, reason, n)"""
)
def q_redact_reasons(spark, sf_dir):
    return redact.reason_counts(redact.swept(spread(spark, sf_dir, {"ids": ("id",)}, _SECRET_ROWS, "id long, content string")))


# --- payloads of agents


_GOOD = (
    '{"open_questions": [], "handoff_summary": {"entrypoints": [{"path": "a.ts", "notes": "n"}], "key_modules": [], "data_flows": [], "config_knobs": [], "tests": []}, '
    '"selection": [{"path": "./a.ts", "mode": "full", "priority": "core", "rationale": "r"}, '
    '{"path": "b.ts", "mode": "slices", "priority": "support", "rationale": "r", "slices": [{"start_line": 2, "end_line": 5, "description": "d"}]}]}'
)
_BAD = (
    '{"open_questions": [{"question": " ", "why_it_matters": "w", "default_assumption": "d"}], "handoff_summary": {"entrypoints": [], "key_modules": [], "data_flows": [{"name": "f"}], "config_knobs": [], "tests": 3}, '
    '"selection": [{"path": "gone.ts", "mode": "full", "priority": "core", "rationale": "r"}, {"path": "a.ts", "mode": "half", "priority": "core", "rationale": "r"}, '
    '{"path": "a.ts", "mode": "slices", "priority": "ref", "rationale": "r", "slices": [{"start_line": 9, "end_line": 3, "description": "d"}, {"start_line": 0, "end_line": 3}]}, '
    '{"path": "a.ts", "mode": "slices", "priority": "ref", "rationale": "r"}, {"mode": "full"}]}'
)
_FINALS = [(1, f"Done.\n```final\n{_BAD}\n```\nBetter:\n```final\n{_GOOD}\n```"), (2, f"```final\n{_BAD}\n```"), (3, "nothing"), (4, "```final\n[1]\n```"), (5, "```final\n{\"selection\": 1}\n```")]


def _payloads(spark, sf_dir):
    return payload.final_payloads(spread(spark, sf_dir, {"ids": ("conv_id",)}, _FINALS, "conv_id long, text string")), made(spark, [("a.ts",), ("b.ts",)], "path string")


@query(spread_sql(
    """select * from (values (2::bigint, 'open_questions[0].question', 'must be a non-empty string'), (2, 'handoff_summary.data_flows[0].notes', 'must be a non-empty string'), (2, 'handoff_summary.tests', 'must be an array'),
  (2, 'selection[0].path', 'path does not exist in repo: gone.ts'), (2, 'selection[1].mode', 'must be one of: full, slices, codemap_only'), (2, 'selection[2].slices[0].end_line', 'must be >= start_line'),
  (2, 'selection[2].slices[1].start_line', 'must be a positive integer'), (2, 'selection[2].slices[1].description', 'must be a non-empty string'), (2, 'selection[3].slices', 'must be a non-empty array'),
  (2, 'selection[4].path', 'must be a non-empty string'), (2, 'selection[4].priority', 'must be a non-empty string'), (2, 'selection[4].rationale', 'must be a non-empty string'),
  (3, 'final', 'missing block'), (4, 'final', 'must be an object'), (5, 'open_questions', 'must be an array'), (5, 'handoff_summary', 'must be an object'), (5, 'selection', 'must be an array')) t(conv_id, field, message)""", ids=('conv_id',),
))
def q_final_issues(spark, sf_dir):
    return payload.issues(*_payloads(spark, sf_dir))


@query(spread_sql(
    "select * from (values (1::bigint, 'a.ts', 'full', 'core', 'r', null), (1, 'b.ts', 'slices', 'support', 'r', '2-5')) t(conv_id, path, mode, priority, rationale, slices)", ids=('conv_id',),
))
def q_final_selection(spark, sf_dir):
    given, known = _payloads(spark, sf_dir)
    given = written(given, shared_folder(spark, "payloads"))  # read three times
    found = payload.selections(given, payload.issues(given, known))
    return found.withColumn("slices", F.array_join(F.transform("slices", lambda s: F.concat_ws("-", s["first"], s["last"])), ","))


_LISTED = (
    '{"view": "files", "files": [{"path": "./m/main.ts", "mode": "full", "priority": "core", "rationale": "x"}, {"path": "m/main.ts", "mode": "slices"}, {"path": "t/a.test.ts", "mode": "slices", "priority": "?", "slices": [{"start_line": 3, "end_line": 1}]}, '
    '{"path": "u.ts", "mode": "slices", "priority": "ref", "rationale": "y", "slices": [{"start_line": 1, "end_line": 4}]}, {"path": "v.ts", "mode": "odd"}, {"path": " "}]}'
)


def _recovered(spark, sf_dir):
    return payload.recovered(spread(spark, sf_dir, {"ids": ("conv_id",)}, [(1, _LISTED), (2, '{"view": "summary"}'), (3, "{broken")], "conv_id long, text string"))


@query(spread_sql(
    """select * from (values (1::bigint, 'm/main.ts', 'full', 'core', 'x', null), (1, 't/a.test.ts', 'codemap_only', 'support', 'recovered from the selection; slices unavailable during fallback', null),
  (1, 'u.ts', 'slices', 'ref', 'y', '1-4')) t(conv_id, path, mode, priority, rationale, slices)""", ids=('conv_id',),
))
def q_recovered(spark, sf_dir):
    return _recovered(spark, sf_dir).withColumn("slices", F.array_join(F.transform("slices", lambda s: F.concat_ws("-", s["first"], s["last"])), ","))


@query(spread_sql(
    """select * from (values (1::bigint, 'entrypoint', 1::bigint, 'm/main.ts', 'derived from partial selection (full)'), (1, 'module', 1, 't/a.test.ts', 'derived from partial selection (support)'),
  (1, 'module', 2, 'u.ts', 'derived from partial selection (ref)'), (1, 'test', 1, 't/a.test.ts', 'test file observed in partial selection')) t(conv_id, kind, nth, path, notes)""", ids=('conv_id',),
))
def q_synthetic_summary(spark, sf_dir):
    return payload.synthetic_summary(_recovered(spark, sf_dir))


@query(spread_sql(
    "select * from (values (1::bigint, 2::bigint, 'r1', '{\"n\":1}')) t(conv_id, turn, id, result)", ids=('conv_id',),
))
def q_envelopes(spark, sf_dir):
    rows = [(1, 1, "none"), (1, 2, '```result\n{"ok": true, "id": "r1", "result": {"n":1}}\n```'), (1, 3, '```result\n{"ok": false, "id": "r2"}\n```'), (1, 4, "```result\n{\n```")]
    return payload.envelopes(spread(spark, sf_dir, {"ids": ('conv_id',)}, rows, "conv_id long, turn long, text string"))


_FAILED = [(1, "rate_limit", 0, 5), (2, "rate_limit", 2, 5), (3, "rate_limit", 3, 5), (4, "server_error", 0, 0), (5, "server_error", 1, 0), (6, "agent_timeout", 0, 1), (7, "invalid_final", 3, 2), (8, "missing_final", 0, 0), (9, "auth_error", None, None)]


@query(spread_sql(
    """select * from (values (1::bigint, 'offline', true, 1000::bigint, 3::bigint), (2, 'offline', true, 4000, 3), (3, 'offline', false, 0, 3), (4, 'offline', true, 1000, 1), (5, 'offline', false, 0, 1),
  (6, 'hybrid', false, 0, 0), (7, 'hybrid', true, 0, 2), (8, 'hybrid', false, 0, 0), (9, 'offline', false, 0, 0)) t(id, strategy, retry, delay_ms, most_retries)""", ids=('id',),
))
def q_fallback(spark, sf_dir):
    return payload.fallback(spread(spark, sf_dir, {"ids": ('id',)}, _FAILED, "id long, kind string, retries long, turns_left long")).select("id", "strategy", "retry", "delay_ms", "most_retries")


@query(spread_sql(
    """select * from (values (1::bigint, 'auth_error', 'auth_error'), (2, 'rate_limit', 'rate_limit'), (3, 'server_error', 'server_error'), (4, 'agent_timeout', 'agent_timeout'), (5, 'network_error', 'network_error'), (6, 'unknown_error', 'unknown_error')) t(id, kind, process_kind)""", ids=('id',),
))
def q_failure_kinds(spark, sf_dir):
    rows = [(1, 403, None, "Forbidden", 1), (2, 429, "timeout", "Too many requests", 9), (3, 503, "network", "crash", 2), (4, None, "timeout", "slow", 3), (5, 302, "network", "x", 1), (6, None, None, "x", 1)]
    found = spread(spark, sf_dir, {"ids": ('id',)}, rows, "id long, status int, type string, message string, exit int")
    process = payload.process_failure_kind(F.col("message"), F.when(F.col("id") % 100 != 3, F.col("type")), F.col("exit"))
    return found.select("id", payload.failure_kind(F.col("status"), F.col("type")).alias("kind"), process.alias("process_kind"))


@query("select event_type, sum(greatest(0, coalesce(floor(value), 0)))::bigint as tokens_in, sum(greatest(0, coalesce(floor(-value), 0)))::bigint as tokens_out from events group by event_type")
def q_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("tokens_in"), (-F.col("value")).alias("tokens_out"))
    return payload.usage(rows, "event_type")


@query("select conv_id, substr(sha256(string_agg('[' || coalesce(role, '') || ']' || chr(10) || coalesce(text, '') || chr(10), chr(10) order by turn)), 1, 12) as digest from conversations group by conv_id")
def q_rendered(spark, sf_dir):
    return payload.rendered(table(spark, sf_dir, "conversations")).select("conv_id", text.stable_hash(F.col("text")).alias("digest"))


@query(spread_sql(
    "select * from (values (1::bigint, 'a' || chr(10) || 'b'), (2, '')) t(id, text)", ids=('id',),
))
def q_message_text(spark, sf_dir):
    rows = [(1, [("text", "a"), ("image", "x"), ("text", None), ("text", "b")]), (2, [])]
    found = spread(spark, sf_dir, {"ids": ('id',)}, rows, "id long, parts array<struct<type:string,text:string>>")
    return found.select("id", payload.message_text(F.col("parts")).alias("text"))


# --- diffs, status, runs


@query(spread_sql(
    """select * from (values (1::bigint, 'src/a.ts', 1::bigint, 1::bigint, 2::bigint, 1::bigint, 3::bigint, 4::bigint), (1, 'new.md', 1, 0, 0, 1, 1, 1), (1, 'old.md', 1, 1, 1, 0, 0, 1)) t(diff_id, path, nth, old_first, old_lines, new_first, new_lines, lines)""", ids=('diff_id',),
))
def q_diff_hunks(spark, sf_dir):
    found = transcript.parse_hunks(spread(spark, sf_dir, {"ids": ('diff_id',)}, [(1, _DIFF)], "diff_id long, text string"))
    return found.withColumn("lines", (F.size(F.split("content", "\n")) - 1).cast("long")).drop("content")


@query(spread_sql(
    """select * from (values (1::bigint, '--- i.png [modified] ---' || chr(10) || '(no textual hunks)' || chr(10) || '--- new.md [added] ---' || chr(10) || '@@ -0,0 +1 @@' || chr(10) || '+hi' || chr(10) ||
  '--- old.md [deleted] ---' || chr(10) || '@@ -1 +0,0 @@' || chr(10) || '-bye' || chr(10) || '--- src/a.ts [modified] ---' || chr(10) || '@@ -1,2 +1,3 @@' || chr(10) || ' x' || chr(10) || '-y' || chr(10) || '+z' || chr(10) || '+w' || chr(10) ||
  '--- to.ts [renamed] ---' || chr(10) || '(no textual hunks)')) t(diff_id, text)""", ids=('diff_id',),
))
def q_diff_text(spark, sf_dir):
    diffs = spread(spark, sf_dir, {"ids": ('diff_id',)}, [(1, _DIFF)], "diff_id long, text string")
    return transcript.diff_text(transcript.parse_diff(diffs), transcript.parse_hunks(diffs))


_HEADS = [(1, "# branch.oid 1\n# branch.head main\n# branch.upstream origin/main\n# branch.ab +2 -13\n1 .M x"), (2, "# branch.head (detached)\n? u"), (3, "")]


@query(spread_sql(
    """select * from (values (1::bigint, 'main', 'origin/main', 2::bigint, 13::bigint, 'branch: main' || chr(10) || 'upstream: origin/main (ahead 2, behind 13)' || chr(10) || 'changes: omitted'),
  (2, 'HEAD (detached)', null, 0, 0, 'branch: HEAD (detached)' || chr(10) || 'changes: omitted'), (3, 'HEAD', null, 0, 0, 'branch: HEAD' || chr(10) || 'changes: omitted')) t(status_id, branch, upstream, ahead, behind, text)""", ids=('status_id',),
))
def q_status_header(spark, sf_dir):
    heads = transcript.branch_header(spread(spark, sf_dir, {"ids": ('status_id',)}, _HEADS, "status_id long, text string"))
    return heads.join(transcript.status_text(heads), "status_id")


_RUN = (
    "20240102T030405-abcd1234",
    "task",
    1000,
    900,
    [("a.ts", "slices", "core", "why a", 9, {"git": 4.5, "entry": 300.0, "boost": 4.5}), ("b.ts", "codemap_only", "ref", "why b", None, None)],
    [("full_to_slices", "degrade a.ts full->slices", -50), ("drop_codemap_only", "drop c.ts codemap_only", -220), ("slices_to_codemap_only", "degrade b.ts slices->codemap_only", -30)],
    [("d.png", "binary"), ("c.ts", "never")],
)


def _record(spark, sf_dir):
    return spread(spark, sf_dir, {"tails": ("run_id",)}, [_RUN], runs.RECORD)


@query(spread_sql(
    """select * from (values ('20240102T030405-abcd1234', 'a.ts', 'slices', 'core', 9::bigint, 'why a', 'entry=300,boost=4,git=4', 'full_to_slices full->slices -50'),
  ('20240102T030405-abcd1234', 'b.ts', 'codemap_only', 'ref', null, 'why b', '', 'slices_to_codemap_only slices->codemap_only -30')) t(run_id, path, mode, priority, score, why, breakdown, degradations)""", tails=('run_id',),
))
def q_explained(spark, sf_dir):
    return runs.explained(_record(spark, sf_dir))


@query(spread_sql(
    "select * from (values ('20240102T030405-abcd1234', 'c.ts', 'never'), ('20240102T030405-abcd1234', 'd.png', 'binary')) t(run_id, path, reason)", tails=('run_id',),
))
def q_dropped(spark, sf_dir):
    return runs.dropped(_record(spark, sf_dir))


@query(spread_sql(
    "select * from (values ('20240102T030405-abcd1234', 1::bigint, 'a.ts', 'slices', 9::bigint), ('20240102T030405-abcd1234', 2, 'b.ts', 'codemap_only', null)) t(run_id, nth, path, mode, score)", tails=('run_id',),
))
def q_manifest(spark, sf_dir):
    return runs.manifest(_record(spark, sf_dir))


@query(spread_sql(
    "select * from (values ('20240102T030405-abcd1234', 1000::bigint, 900::bigint, 2::bigint, -300::bigint, true)) t(run_id, budget, estimated, files, saved, fits)", tails=('run_id',),
))
def q_run_report(spark, sf_dir):
    return runs.report(_record(spark, sf_dir))


@query(
    f"""with {FILES_SQL} select path, strftime(make_timestamp(doc_id * 100003 * 1000000), '%Y%m%dT%H%M%S') || '-' || substr(sha256(path), 1, 8) as id, true as valid, false as path_valid from files"""
)
def q_run_ids(spark, sf_dir):
    every = files(spark, sf_dir).select("path", text.run_id(F.col("path"), F.timestamp_seconds(F.col("doc_id") * 100_003)).alias("id"))
    return every.select("path", "id", text.valid_run_id(F.col("id")).alias("valid"), text.valid_run_id(F.col("path")).alias("path_valid"))


@query("select event_type as scenario, 'p95' as name, quantile_disc(value, 0.95) as value, 50::double as target from events group by event_type having quantile_disc(value, 0.95) > 50")
def q_target_misses(spark, sf_dir):
    timed = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("scenario")).agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("value"))
    targets = timed.select("scenario", F.lit("p95").alias("name"), F.lit(50.0).alias("target"))
    return runs.target_misses(timed.withColumn("name", F.lit("p95")), targets)


@query(spread_sql(
    "select * from (values ('x', '- a' || chr(10) || '- b'), ('y', '- none')) t(part, text)", heads=('part',),
))
def q_section_lists(spark, sf_dir):
    return runs.section(spread(spark, sf_dir, {"heads": ('part',)}, [("x", " b"), ("x", "a"), ("x", ""), ("y", None)], "part string, line string"), "part", "line")


@query(spread_sql(
    "select * from (values (1::bigint, 'ab,cd'), (2, '')) t(id, terms)", ids=('id',),
))
def q_slice_terms(spark, sf_dir):
    rows = spread(spark, sf_dir, {"ids": ('id',)}, [(1, [" CD", "ab", "cd ", "x"]), (2, [])], "id long, terms array<string>")
    return rows.select("id", F.array_join(text.slice_terms(F.col("terms")), ",").alias("terms"))


# --- further forms


@query(
    f"""with {FILES_SQL}, {_LINES_SQL} select path, line, instr(excerpt, regexp_extract(excerpt, 'th[ae]+ [a-z]*ing', 0))::bigint as col from lines where regexp_matches(excerpt, 'th[ae]+ [a-z]*ing')"""
)
def q_search_regex(spark, sf_dir):
    return search.hits(files(spark, sf_dir), "th[ae]+ [a-z]*ing", regex=True, case_sensitive=True).select("path", "line", "col")


@query("select event_type as tool, count(*)::bigint as calls, sum(event_id % 97)::bigint as ms, sum(user_id)::bigint as tokens from events group by rollup (event_type)")
def q_dispatch_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), (F.col("event_id") % 97).alias("ms"), F.col("user_id").alias("tokens"))
    return report.dispatch_stats(rows)


@query(spread_sql(
    "select * from (values ('a', 1::bigint, 9::bigint), ('a', 14, 15), ('b', 1, 2), ('b', 6, 6)) t(path, first, last)", heads=('path',),
))
def q_slice_gap(spark, sf_dir):
    rows = [("a", 1, 3), ("a", 6, 7), ("a", 9, 9), ("a", 14, 15), ("b", 1, 2), ("b", 6, 6)]
    return slices.merged(spread(spark, sf_dir, {"heads": ('path',)}, rows, "path string, first long, last long"), slices.budget_gap(30))


_TOKEN = "ghp_" + "a1" * 18


@query(spread_sql(
    """select * from (values (1::bigint, '{"a":["‹REDACTED:github_token›",1,null],"b":{"c":"x ‹REDACTED:github_token›","d":true}}'), (2, null), (3, '"plain"')) t(id, body)""", ids=('id',),
))
def q_json_redacted(spark, sf_dir):
    rows = [(1, f'{{"b": {{"d": true, "c": "x {_TOKEN}"}}, "a": ["{_TOKEN}", 1, null]}}'), (2, "{broken"), (3, '"plain"')]
    return redact.json_redacted(spread(spark, sf_dir, {"ids": ('id',)}, rows, "id long, body string"), "body")


@query(
    """with e as (select event_id as ord, user_id::varchar as path, case when event_id % 397 = 0 then 'clear' when event_type = 'error' then 'remove' else 'add' end as action, case when event_id % 2 = 0 then 'full' else 'slices' end as mode from events),
live as (select * from e where ord > (select coalesce(max(ord), -1) from e where action = 'clear'))
select path, arg_max(mode, ord) as mode from live group by path having arg_max(action, ord) <> 'remove'"""
)
def q_selection_clear(spark, sf_dir):
    clear = F.col("event_id") % 397 == 0
    action = F.when(clear, "clear").when(F.col("event_type") == "error", "remove").otherwise("add")
    mode = F.when(F.col("event_id") % 2 == 0, "full").otherwise("slices")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("path"), action.alias("action"), mode.alias("mode"))
    return select.last_events(rows)


@query(spread_sql(
    "select * from (values ('src', 'src/m.ts', 1::bigint, 'Foo'), ('src/m.ts', 'src/m.ts', 1, 'Foo'), ('none', null, null, null)) t(asked, path, line, name)", heads=('asked', 'path'),
))
def q_codemap(spark, sf_dir):
    code = spread(spark, sf_dir, {"heads": ("path",)}, [("src/m.ts", "export class Foo {\n  bar() {}\n}"), ("p.py", "def run(): pass")], "path string, content string")
    asked = search.expanded(code, spread(spark, sf_dir, {"heads": ("asked",)}, [("src/",), ("src/m.ts",), ("none",)], "asked string"))
    return asked.join(index.outline(code, "summary").select("path", "line", "name"), "path", "left").select("asked", "path", "line", "name")


@query(spread_sql(
    "select * from (values ('a.TSX', 'typescriptreact'), ('b.kt', 'kotlin'), ('c', 'text'), ('d.bash', 'shell'), ('e.png', 'text')) t(path, language)", heads=('path',),
))
def q_index_languages(spark, sf_dir):
    rows = spread(spark, sf_dir, {"heads": ('path',)}, [(p,) for p in ("a.TSX", "b.kt", "c", "d.bash", "e.png")], "path string")
    return rows.select("path", text.language(F.col("path"), text.INDEX_LANGUAGES).alias("language"))


@query(
    f"""with {FILES_SQL}, t as (select doc_id, ceil(size / 4.0::double)::bigint as tokens from files)
select '... ‹TRUNCATED: ' || count(*) filter (doc_id % 3 = 0) || ' more files, ~' || sum(case when doc_id % 3 = 0 then tokens when doc_id % 3 = 1 then 0 else tokens - tokens // 2 end)::bigint || ' tokens›' as marker from t"""
)
def q_patch_marker(spark, sf_dir):
    every = files(spark, sf_dir).select("path", "doc_id", F.ceil(F.col("size") / 4.0).cast("long").alias("tokens"))
    half = F.when(F.col("doc_id") % 3 == 2, F.floor(F.col("tokens") / 2)).otherwise(F.col("tokens")).cast("long")
    return select.patch_marker(every.select("path", "tokens"), every.where("doc_id % 3 <> 0").select("path", half.alias("tokens")))


@query(
    f"""with recursive {FILES_SQL}, top as (
  select path, size, case doc_id % 4 when 0 then 'full' when 1 then 'slices' when 3 then 'codemap_only' end as hint, row_number() over (order by doc_id * 37 % 1009 desc, path) as n
  from files order by doc_id * 37 % 1009 desc, path limit 53
), run(n, path, mode, f, s, c) as (
  select 0::bigint, null::varchar, 'start', 8, 15, 30 union all
  select n, path, mode, f - (mode = 'full')::int, s - (mode = 'slices')::int, c - (mode = 'codemap_only')::int from (
    select t.n, t.path, r.f, r.s, r.c, case when hint = 'full' and f > 0 and size <= 3000 then 'full' when hint = 'slices' and s > 0 then 'slices' when f > 0 and size <= 3000 then 'full' when s > 0 then 'slices' when c > 0 then 'codemap_only' end as mode
    from run r join top t on t.n = r.n + 1) where mode is not null
) select path, mode, case mode when 'full' then 'core' when 'slices' then 'support' else 'ref' end as priority from run where n > 0"""
)
def q_suggested_modes(spark, sf_dir):
    hints = F.create_map(F.lit(0), F.lit("full"), F.lit(1), F.lit("slices"), F.lit(3), F.lit("codemap_only"))
    score = F.col("doc_id") * 37 % 1009
    ranked = files(spark, sf_dir).select("path", score.alias("score"), score.cast("double").alias("raw"), "size", hints[(F.col("doc_id") % 4).cast("int")].alias("hint"))
    return select.suggested_modes(ranked, most_bytes=3000)


@query(f"with {FILES_SQL}, {_LINES_SQL} select path, count(*)::bigint as lines from lines where line between 2 and 21 group by path")
def q_strict_read(spark, sf_dir):
    first, last = search.shown_lines(2, 500, strict=True)
    return search.numbered_lines(files(spark, sf_dir), first, last).groupBy("path").agg(F.count("*").alias("lines"))
