"""URL filters with redirect equivalence, in DataFrame operations only.

Rules (host, path, verdict) fit a host and its subdomains where the url's path starts
with theirs; the longest wins. Pages are joined to rules on the suffixes of their
host, so the rules are never crossed with the pages. Redirect (meta refresh) and
canonical-link edges between urls give components, found by distributed star steps; a
page without a rule of its own is blocked if its component holds a blocked url and no
allowed one: an explicit allow takes precedence over what aliases bring.

Urls are one node if host, path and query are equal, without scheme and fragment;
relative targets are resolved by host or folder.

Defined results: a null url, or one without ``://``, has empty host and path, fits no
rule, takes no part in edges and is allowed; of rules of equal length on one page the
one with the longer host wins, then block; very long urls and pages are read whole; repeated rows are judged each; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Written, components

#: Rules of the registered query: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(column: Column) -> Column:
    """A-Z alone lower-cased."""
    return F.translate(column, _UPPER, _LOWER)


def parsed(df: DataFrame, url: str) -> DataFrame:
    """Adds host, path and node, the url's key in the graph of aliases (host, path and
    query; null without a scheme)."""
    at = F.position(F.lit("://"), F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.lit(2**31 - 1))).otherwise("")
    out = df.withColumn("rest", rest)
    out = out.withColumn("host", lower(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1)))
    out = out.withColumn("path", F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1))
    out = out.withColumn("tail", F.regexp_extract("rest", r"(?s)^[^/?#]*([^#]*)", 1))
    slash = F.when(F.col("tail").startswith("/"), "").otherwise("/")
    node = F.when(F.contains(F.col(url), F.lit("://")), F.concat("host", slash, "tail"))
    return out.withColumn("node", node).drop("rest", "tail")


#: Tags of any length; one without an end takes the rest of the page, so that no later start reads it again.
_TAGS = r"(?is)<(?:link|meta)\b[^>]*+(?:>|\z)"


def _value(tag: Column, name: str) -> Column:
    pattern = rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.trim(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]))


def edges_of(pages: DataFrame) -> DataFrame:
    """(a, b): nodes joined by a canonical link or a redirect; null where a url has no scheme."""
    linked = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", "html")
    tags = linked.select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))).alias("tag")).where(F.endswith("tag", F.lit(">")))
    for name in ("rel", "href", "http-equiv", "content"):
        tags = tags.withColumn(name, _value(F.col("tag"), name))
    canonical = F.when(F.col("rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), F.col("href"))
    refresh = F.when(lower(F.col("http-equiv")) == "refresh", F.regexp_extract("content", r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1))
    found = tags.select("url", F.regexp_replace(F.trim(F.coalesce(canonical, refresh)), "&amp;", "&").alias("to"))
    # Few pages have links: written first, so that what follows is worked out on those alone.
    found = Written(found, "links").df.where("to <> ''")
    found = parsed(found, "url").withColumn("folder", F.regexp_replace("path", r"[^/]*$", "")).withColumnRenamed("node", "a")
    to = F.col("to")
    whole = (
        F.when(F.contains(to, F.lit("://")), to)
        .when(to.startswith("//"), F.concat(F.lit("x:"), to))
        .when(to.startswith("/"), F.concat(F.lit("x://"), F.col("host"), to))
        .otherwise(F.concat(F.lit("x://"), F.col("host"), F.when(F.col("folder") == "", "/").otherwise(F.col("folder")), to))
    )
    found = parsed(found.select("a", whole.alias("whole")), "whole")
    return found.select("a", F.col("node").alias("b"))


def ruled(urls: DataFrame, rules: DataFrame, most_labels: int) -> DataFrame:
    """``urls`` (row, host, path) with the rule that wins, for those that any rule fits.
    No rule's host has over ``most_labels`` labels, so no longer suffix is tried."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - (most_labels - 1)), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    spread = urls.where("host <> ''").withColumn("rule_host", F.explode(suffixes))
    fits = spread.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    length = F.length("rule_host") + F.length("rule_path")
    best = F.max(F.struct(length.alias("n"), F.length("rule_host").alias("h"), "rule_verdict", "rule_host", "rule_path"))
    return fits.groupBy("row").agg(best.alias("rule"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and via (rule, alias or default)."""
    spark = pages.sparkSession
    given = spark.createDataFrame([(h.lower(), p, v) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string")
    most_labels = max((h.count(".") + 1 for h, *_ in rules), default=1)
    urls = parsed(pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")), "url").drop("url")
    # A url's rule depends on host and path alone: found once for each, then joined back.
    places = urls.select("host", "path").distinct().withColumn("row", F.struct("host", "path"))
    winners = ruled(places, given, most_labels).select(
        F.col("row.host").alias("host"),
        F.col("row.path").alias("path"),
        F.concat("rule.rule_host", "rule.rule_path").alias("rule"),
        F.col("rule.rule_verdict").alias("own"),
    )
    known = urls.join(winners, ["host", "path"], "left")
    edges = Written(edges_of(pages.select("url", F.col("html").cast("string").alias("html"))).distinct(), "aliases").df
    alias_of = components(edges)
    # Verdicts of rules among the members of each component; targets that are no page count too.
    members = parsed(alias_of.select("component", F.concat(F.lit("x://"), F.col("node")).alias("whole")), "whole")
    placed = members.select("host", "path").distinct().withColumn("row", F.struct("host", "path"))
    own = ruled(placed, given, most_labels).select(F.col("row.host").alias("host"), F.col("row.path").alias("path"), F.col("rule.rule_verdict").alias("own"))
    brought = (
        members.join(own, ["host", "path"])
        .groupBy("component")
        .agg(F.when(F.bool_or(F.col("own") == "allow"), "allow").otherwise("block").alias("brought"))
    )
    by_node = Written(alias_of.join(brought, "component").select("node", "brought"), "brought").df
    judged = known.join(by_node, "node", "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("own", "brought", F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("brought").isNotNull(), "alias").otherwise("default").alias("via"),
    )


def _parsed_sql(source: str, url: str, columns: str) -> str:
    """A query that adds host, path and node, as ``parsed`` does."""
    return f"""select {columns}, host, path, case when contains({url}, '://') then host || case when tail like '/%' then '' else '/' end || tail end as node from (
    select *, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path,
      regexp_extract(rest, '(?s)^[^/?#]*([^#]*)', 1) as tail
    from (select *, case when contains({url}, '://') then substr({url}, instr({url}, '://') + 3) else '' end as rest from {source}))"""


def _value_sql(name: str) -> str:
    pattern = rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\s\"''>]+))"
    return "trim(" + " || ".join(f"regexp_extract(tag, '{pattern}', {k})" for k in (1, 2, 3)) + ")"


#: The verdicts of ``judge(pages, RULES)``.
JUDGE_SQL = f"""
with recursive rules(rule_host, rule_path, rule_verdict) as (values {', '.join(repr(r) for r in RULES)}),
urls as ({_parsed_sql("(select page_id, coalesce(url, '') as url, html from pages)", "url", "page_id, url, html")}),
tags as (select url, host as own_host, node as a, regexp_replace(path, '[^/]*$', '') as folder,
  unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*>|<meta\\b[^>]*>')) as tag from urls),
links as (select *, replace(trim(case when regexp_matches({_value_sql('rel')}, '(?i)(^|\\s)canonical(\\s|$)') then {_value_sql('href')}
  when lower({_value_sql('http-equiv')}) = 'refresh' then regexp_extract({_value_sql('content')}, '(?is)url\\s*=\\s*[''"]?([^''"]+)', 1) end), '&amp;', '&') as dest from tags),
wholes as (select a, case when contains(dest, '://') then dest when dest like '//%' then 'x:' || dest when dest like '/%' then 'x://' || own_host || dest
  else 'x://' || own_host || case when folder = '' then '/' else folder end || dest end as whole from links where dest <> ''),
edges as (select a, node as b from ({_parsed_sql('wholes', 'whole', 'a')}) where a <> node),
sides as (select a, b from edges union select b, a from edges),
reach(node, seen) as (select a, a from sides union select b.b, r.seen from reach r join sides b on b.a = r.node),
named as ({_parsed_sql("(select distinct node as start, seen, 'x://' || seen as whole from reach)", 'whole', 'start, seen')}),
brought as (
  select start, case when bool_or(verdict = 'allow') then 'allow' else 'block' end as verdict from (
    select start, seen, arg_max(rule_verdict, (length(rule_host) + length(rule_path), length(rule_host))) as verdict from named
    join rules on (host = rule_host or host like '%.' || rule_host) and starts_with(path, rule_path) group by start, seen) group by start
), own as (
  select page_id, url, max((length(rule_host) + length(rule_path), length(rule_host), rule_verdict, rule_host || rule_path)) as r from urls
  join rules on (host = rule_host or host like '%.' || rule_host) and starts_with(path, rule_path) group by page_id, url
)
select u.page_id, u.host, u.path, own.r[4] as rule, coalesce(own.r[3], brought.verdict, 'allow') as verdict,
  case when own.r is not null then 'rule' when brought.verdict is not null then 'alias' else 'default' end as via
from urls u left join own on own.page_id = u.page_id and own.url = u.url left join brought on brought.start = u.node
"""
