"""Registered queries that rank for many tasks, and over the graph of imports."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.frames import pieces
from corpusmill.functions.text import stable_hash
from corpusmill.operators import rank, scopes, tasks
from corpusmill.plans.registry import _RANKED, files, query, table
from corpusmill.sources.corpus import FILES_SQL
from corpusmill.sources.shared import shared_folder
from corpusmill.sources.walk import read_tree

#: Files that each task keeps.
BEST = 20
# The same list as the ranking's stop words.
_STOPS = ", ".join(f"'{w}'" for w in rank.STOP_WORDS)


@query(
    f"""with {FILES_SQL}, low as (
  select path, lower(path || chr(10) || content) as low, regexp_matches(path, '(^|/)(main|index|app|routes|server|cli)\\.[^/]*$') as entry from files
), t as (
  select distinct item_id as task_id, unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) as term from benchmark
), terms as (select distinct term from t where len(term) > 1 and term not in ({_STOPS})),
counts as materialized (select path, term, ((length(low) - length(replace(low, term, ''))) / len(term))::bigint as n from low, terms where contains(low, term)),
scored as (
  select t.task_id, l.path, coalesce(sum(12 * n), 0) + case when count(n) > 1 then 6 * count(n) else 0 end + case when any_value(entry) then 40 else 0 end as raw,
    coalesce(sum(n), 0)::bigint as hits, coalesce(string_agg(c.term, ',' order by c.term), '') as matched
  from (select distinct task_id from t) t cross join low l left join (select task_id, path, term, n from t join counts using (term)) c on c.task_id = t.task_id and c.path = l.path group by all having raw > 0
), ranked as (select *, row_number() over (partition by task_id order by raw desc, path) as nth, max(raw) over (partition by task_id) as best from scored)
select task_id, path, raw::double as raw, greatest(1, least(1000, floor(raw / best::double * 1000 + 0.5)))::bigint as score, hits, matched from ranked where nth <= {BEST}"""
)
def q_rank_tasks(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    every = items.select(F.col("item_id").alias("task_id"), F.regexp_replace(F.lower("text"), "[^a-z]+", " ").alias("text"))
    entry = F.col("path").rlike(r"(^|/)(main|index|app|routes|server|cli)\.[^/]*$")
    return tasks.ranked(every, files(spark, sf_dir), F.concat_ws("\n", "path", "content"), entry, limit=BEST)


def code_of_orders(spark, sf_dir):
    """A source file for each order, of a language by its key: a class or heading, and in it a method or heading for each line item."""
    # Few rows of an order lie together: they are shuffled as they are, not as lists of one or two. Items are small beside
    # the work on the texts that come of them, so the number of tasks is set, not left to their bytes.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition(n, "l_orderkey")
    rows = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    key, case = F.col("l_orderkey").cast("string"), F.col("l_orderkey") % 3

    def text(top: str, after: str, before: str, between: str, end: str, last: str = "") -> Column:
        each = F.transform("items", lambda x, k: F.concat(F.lit(before), (k + 1).cast("string"), F.lit(between), x["l_partkey"].cast("string"), F.lit(end)))
        return F.concat(F.lit(top), key, F.lit(after), F.array_join(each, ""), F.lit(last))

    content = (
        F.when(case == 0, text("export class Order", " {\n", "  line", "(part) {\n    return ", ";\n  }\n", "}\n"))
        .when(case == 1, text("class Order", ":\n", "    def line", "(self):\n        return ", "\n"))
        .otherwise(text("# Order", "\n", "## line", "\npart ", "\n"))
    )
    language = F.when(case == 0, "typescript").when(case == 1, "python").otherwise("markdown")
    return rows.select(F.concat(F.lit("orders/"), key).alias("path"), language.alias("language"), content.alias("content"))


_SCOPES_SQL = """items as (
  select l_orderkey as k, 'orders/' || l_orderkey as path, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as j, case when l_orderkey % 3 = 0 then 3 else 2 end as step from lineitem
), found as (
  select path, case when k % 3 = 2 then 'section' else 'class' end as kind, 'Order' || k as name, 1 as line, any_value(step) * count(*) + case when k % 3 = 0 then 2 else 1 end as last, 0 as depth, null as parent from items group by path, k
  union all select path, case when k % 3 = 2 then 'section' else 'method' end, 'line' || j, 2 + step * (j - 1), 1 + step * j, 1, 1 from items
)"""


@query(f"with {_SCOPES_SQL} select path, kind, name, line::bigint as line, last::bigint as last, depth::int as depth, parent::bigint as parent from found")
def q_code_scopes(spark, sf_dir):
    return scopes.scopes(code_of_orders(spark, sf_dir)).drop("signature")


@query(
    f"""with {_SCOPES_SQL}, points as (select distinct 'orders/' || l_orderkey as path, 1 + l_partkey % 20 as at from lineitem)
select p.path, p.at, max_by(name, depth) as name, max_by(line, depth)::bigint as line from points p left join found f on f.path = p.path and p.at between f.line and f.last group by all"""
)
def q_code_enclosing(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("orders/"), "l_orderkey").alias("path"), (1 + F.col("l_partkey") % 20).alias("at"))
    return scopes.innermost(points, scopes.scopes(code_of_orders(spark, sf_dir))).select("path", "at", "name", "line")


_PAGES_SQL = """pieces as (select page_id::varchar as path, p, k from (select page_id, p, unnest(range(1, len(p) + 1)) as k from (select page_id, string_split(html, '<') as p from pages))),
heads as (select path, k as line, regexp_extract(p[k], '(?is)^h([1-6])\\b[^>]*>(.*)', 1)::int as level, regexp_extract(p[k], '(?is)^h([1-6])\\b[^>]*>(.*)', 2) as name, len(p) as n from pieces where regexp_matches(p[k], '(?is)^h([1-6])\\b[^>]*>')),
found as (select path, line, level, name, coalesce((select min(o.line) - 1 from heads o where o.path = h.path and o.line > h.line and o.level <= h.level), n) as last from heads h)"""


@query(
    f"""with {_PAGES_SQL} select path, name, line::bigint as line, last::bigint as last,
  (select count(*) from found o where o.path = f.path and o.line < f.line and o.last >= f.line)::int as depth, (select max(o.line) from found o where o.path = f.path and o.line < f.line and o.last >= f.line)::bigint as parent from found f"""
)
def q_page_outline(spark, sf_dir):
    return scopes.scopes(pages(spark, sf_dir)).drop("kind", "signature")


@query(
    f"""with {_PAGES_SQL}, points as (select path, k as at from pieces where contains(p[k], 'tion'))
select p.path, p.at, max_by(name, line) as name from points p left join found f on f.path = p.path and p.at between f.line and f.last group by all"""
)
def q_page_sections(spark, sf_dir):
    every = pages(spark, sf_dir)
    points = every.select("path", F.posexplode(F.split("content", "<")).alias("k", "x")).where("contains(x, 'tion')").select("path", (F.col("k") + 1).cast("long").alias("at"))
    return scopes.innermost(points, scopes.scopes(every)).select("path", "at", "name")


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"))


#: Ignore files of the documents' tree: folder and text.
IGNORES = (("", "*.md\n!config.md\n/src2/\n"), ("src1", "de/\n!de/\n/fr\n"), ("src3", "# all but English\n*\n!en/\n!en/**\n"))


def _written_tree(spark, sf_dir) -> str:
    """The documents as files of a tree with ignore files."""
    root = shared_folder(spark, "tree")
    top = root.removeprefix("file://")

    def write(frames):
        for frame in pieces(frames):
            for path, content in zip(frame["path"], frame["content"], strict=True):
                os.makedirs(os.path.dirname(f"{top}/{path}"), exist_ok=True)
                with open(f"{top}/{path}", "wb") as f:
                    f.write((content or "").encode())
            yield frame[["path"]]

    rules = spark.createDataFrame([(f"{folder}/.gitignore".lstrip("/"), text) for folder, text in IGNORES], "path string, content string")
    every = files(spark, sf_dir).select("path", "content").unionByName(rules)
    every.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return root


_WALK_SQL = f"""{FILES_SQL}, kept as (
  select path, content, size from files where (path not like '%.md' or path like '%/config.md') and not regexp_matches(path, '^src2/|^src1/fr/') and (path not like 'src3/%' or path like 'src3/en/%')
    or path like 'src3/en/%' or path like 'src1/de/%'
)"""


@query(f"with {_WALK_SQL} select path, size, substr(sha256(content), 1, 12) as hash from kept")
def q_walk_files(spark, sf_dir):
    found = read_tree(spark, _written_tree(spark, sf_dir)).where("path not like '%.gitignore'")
    return found.select("path", "size", stable_hash(F.col("content")).alias("hash"))


@query(
    f"""with {FILES_SQL}, dirs as (select distinct array_to_string(p[1:k], '/') || '/' as path from (select p, unnest(range(1, len(p))) as k from (select string_split(path, '/') as p from files)))
select path from dirs where not regexp_matches(path, '^src2/|^src1/fr/') and (path not like 'src3/%' or path = 'src3/' or path like 'src3/en/%') union all select '/'"""
)
def q_walk_folders(spark, sf_dir):
    listed = read_tree(spark, _written_tree(spark, sf_dir), ("path", "folder"), folders=True).where("folder")
    return listed.groupBy("path").agg(F.count("*").alias("times")).where("times = 1").select("path")


@query(f"with {_WALK_SQL} select path, size from kept where path like 'src1/%' and size <= 3000 and path like '%.py'")
def q_walk_pushed(spark, sf_dir):
    return read_tree(spark, _written_tree(spark, sf_dir), ("path", "size")).where("startswith(path, 'src1/') and endswith(path, '.py') and size <= 3000")
