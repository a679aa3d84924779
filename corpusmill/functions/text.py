"""Scalar functions over text and paths, as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.5

# Words that task terms leave out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "the", "this", "that", "to", "with",
)

# File endings that name a language.
LANGUAGES = {
    "ts": "typescript",
    "tsx": "tsx",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "py": "python",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "rb": "ruby",
    "php": "php",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cs": "csharp",
    "json": "json",
    "md": "markdown",
    "yaml": "yaml",
    "yml": "yaml",
    "toml": "toml",
    "sh": "shell",
}


# Endings that name a language in the stored index.
INDEX_LANGUAGES = {
    "bash": "shell",
    "c": "c",
    "cc": "cpp",
    "cpp": "cpp",
    "cs": "csharp",
    "css": "css",
    "go": "go",
    "h": "c",
    "hpp": "cpp",
    "html": "html",
    "java": "java",
    "js": "javascript",
    "json": "json",
    "jsx": "javascriptreact",
    "kt": "kotlin",
    "kts": "kotlin",
    "md": "markdown",
    "mjs": "javascript",
    "py": "python",
    "rb": "ruby",
    "rs": "rust",
    "sh": "shell",
    "sql": "sql",
    "swift": "swift",
    "toml": "toml",
    "ts": "typescript",
    "tsx": "typescriptreact",
    "txt": "text",
    "xml": "xml",
    "yaml": "yaml",
    "yml": "yaml",
}


# Endings that name a language where a tree is walked.
WALK_LANGUAGES = {
    "c": "c",
    "cpp": "cpp",
    "cs": "csharp",
    "go": "go",
    "h": "c",
    "hpp": "cpp",
    "java": "java",
    "js": "javascript",
    "json": "json",
    "kt": "kotlin",
    "md": "markdown",
    "py": "python",
    "rb": "ruby",
    "rs": "rust",
    "swift": "swift",
    "toml": "toml",
    "ts": "typescript",
    "tsx": "typescriptreact",
    "yaml": "yaml",
    "yml": "yaml",
}
#: The same in a plain scan, and in a repository's summary.
PIPELINE_LANGUAGES = WALK_LANGUAGES | {"cc": "cpp"}
REPO_LANGUAGES = WALK_LANGUAGES | {"tsx": "typescript"}
# Endings of languages whose declarations are read.
CODEMAP_LANGUAGES = {
    "c": "c",
    "cc": "cpp",
    "cjs": "javascript",
    "cpp": "cpp",
    "cs": "csharp",
    "cxx": "cpp",
    "go": "go",
    "h": "c",
    "hh": "cpp",
    "hpp": "cpp",
    "hxx": "cpp",
    "java": "java",
    "js": "javascript",
    "jsx": "javascript",
    "kt": "kotlin",
    "kts": "kotlin",
    "mjs": "javascript",
    "py": "python",
    "rb": "ruby",
    "rs": "rust",
    "swift": "swift",
    "ts": "typescript",
    "tsx": "typescript",
}


def tokens(text: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    """Estimated tokens: 0 for nothing, else characters by ratio, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(chars_per_token)).cast("long")


def stable_hash(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def truncate(text: Column, limit: int, mark: str = "…") -> Column:
    """At most ``limit`` characters, the last of them the mark if anything is cut."""
    if limit <= 0:
        return F.lit("")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - len(mark)), F.lit(mark)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def module(path: Column) -> Column:
    """The first two directories, or ``.`` at the root."""
    parts = F.split(directory(path), "/")
    return F.when(directory(path) == "", ".").otherwise(F.array_join(F.slice(parts, 1, 2), "/"))


def language(path: Column, known: dict[str, str] = LANGUAGES, other: str | None = "text") -> Column:
    """The language that a path's ending names in a map of endings, else ``other``."""
    found = F.lit(other).cast("string")
    ext = extension(path)
    for name in sorted(set(known.values())):
        found = F.when(ext.isin([e for e, lang in known.items() if lang == name]), name).otherwise(found)
    return found


def normal_path(path: Column) -> Column:
    """Forward slashes, without leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def safe_path(path: Column) -> Column:
    """The normal path with its steps up taken; null if it is absolute, empty, or leads above the root."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("held"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        held = F.when(up, F.slice(acc["held"], 1, F.greatest(F.size(acc["held"]) - 1, F.lit(0)))).otherwise(F.array_append(acc["held"], part))
        return F.struct(held.alias("held"), (acc["out"] | (up & (F.size(acc["held"]) == 0))).alias("out"))

    found = F.aggregate(parts, start, step)
    bad = path.rlike(r"^([/\\]|[A-Za-z]:)") | found["out"] | (F.size(found["held"]) == 0)
    return F.when(~bad, F.array_join(found["held"], "/"))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal (searched for as a pattern: faster than replacing it)."""
    if not term:
        return F.lit(0).cast("long")
    return F.regexp_count(text, F.lit(re.escape(term))).cast("long")


def lines_of(text: Column) -> Column:
    """Lines without their ends; a last empty one does not count."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_range(lines: Column, first: Column, last: Column) -> Column:
    """The text of the lines first to last (from 1, both included), clamped to what is there."""
    a = F.greatest(F.lit(1), F.least(first, F.size(lines)))
    b = F.greatest(a, F.least(last, F.size(lines)))
    return F.array_join(F.slice(lines, a, b - a + 1), "\n")


def glob_regex(pattern: str) -> str:
    """A Java regular expression for a path glob: ``**/`` spans any directories or none."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        elif c == "*":
            out, k = out + "[^/]*", k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "{" and "}" in pattern[k:]:
            end = pattern.index("}", k)
            out, k = out + "(?:" + "|".join(map(re.escape, pattern[k + 1 : end].split(","))) + ")", end + 1
        elif c == "[" and "]" in pattern[k:]:
            end = pattern.index("]", k)
            out, k = out + pattern[k : end + 1].replace("[!", "[^"), end + 1
        else:
            out, k = out + re.escape(c), k + 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def words_of_identifier(name: str) -> list[str]:
    """Lower-case parts of a camel, snake or dotted name, of two characters or more."""
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [w for w in re.split(r"[^a-z0-9]+", split.lower()) if len(w) > 1]


def symbol_name(signature: Column) -> Column:
    """The first identifier of a signature that is no reserved word, else its first, else ``symbol``."""
    # Reserved words of declarations.
    reserved = (
        "as", "async", "class", "const", "def", "enum", "export", "fn", "function", "from", "if", "impl", "import", "interface",
        "let", "module", "private", "protected", "pub", "public", "record", "static", "struct", "trait", "type", "use", "var",
    )
    words = F.regexp_extract_all(signature, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.coalesce(F.get(F.filter(words, lambda w: ~w.isin(*reserved)), F.lit(0)), F.get(words, F.lit(0)), F.lit("symbol"))


def is_test_path(path: Column, code_only: bool = False) -> Column:
    """Below a folder of tests, or named so by its ending; ``code_only`` takes script endings alone."""
    low = F.lower(path)
    ending = r"\.(?:test|spec)\.(?:[cm]?[jt]sx?)$" if code_only else r"\.(?:test|spec)\.[a-z0-9]+$"
    return low.rlike(r"(?:^|/)tests?/") | low.rlike(ending)


def import_names(names: Column) -> Column:
    """Imported names of a list in braces: trimmed, without ``as`` names, sorted, none empty."""
    each = F.transform(F.split(names, ","), lambda n: F.trim(F.regexp_replace(n, r"\s+as\s+.*$", "")))
    return F.array_sort(F.array_distinct(F.filter(each, lambda n: n != "")))


def slice_terms(terms: Column) -> Column:
    """Terms for slices: trimmed, lower case, two characters or more, each once, sorted."""
    each = F.transform(terms, lambda t: F.lower(F.trim(t)))
    return F.array_sort(F.array_distinct(F.filter(each, lambda t: F.length(t) >= 2)))


def run_id(root: Column, at: Column) -> Column:
    """UTC time and a digest of the root."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyyMMdd'T'HHmmss"), F.lit("-"), stable_hash(root, 8))


def valid_run_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9._-]+$") & ~value.isin(".", "..")


def largest_first(values: Column) -> Column:
    """The entries of a map from label to number: greatest value first, then by label."""
    entries = F.transform(F.map_entries(values), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("label"), e["value"].alias("value")))
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["label"].alias("label"), e["value"].alias("value")))


def run_pointer(text: Column) -> Column:
    """The run that a pointer's text names by its last path segment; null if that is no run id."""
    last = F.regexp_extract(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+$", "")), r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    return F.when(valid_run_id(last), last)
