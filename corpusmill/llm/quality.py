"""Quality rules: learned decision lists as Spark conditional expressions.

Statistics of whole texts are DataFrame expressions. Sequential covering grows
conjunctions of thresholds from labelled statistics, prunes each on rows held out,
keeps those precise enough, and emits the list as one ordered ``CASE``. Growing uses
a bounded sample of labelled rows on the driver (``most_labelled``); statistics and
verdicts cover every row, without Python on the executors.

Defined results: a null or empty text has no words and fails the base rules; rows
with a null label are not learned from; without labels the list is empty and what
passes the base rules is kept; very long texts are counted whole; repeated rows are judged each; other columns are
ignored (``judge`` keeps them in ``apply``); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import SPACE

WINDOW = 8
#: Labelled rows that rules are learned from, at most: those of least hashed id.
MOST_LABELLED = 4000
#: Precision that a rule must reach on the rows held out.
LEAST_PRECISION = 0.95
MOST_CONDITIONS, MOST_RULES, MOST_TRIES, THRESHOLDS = 3, 12, 36, 32

FEATURES = ("mean_word", "symbols_per_word", "dup_lines_share", "repeat_share", "distinct_share", "upper_share", "shouts_per_word", "bars_per_word")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words that lie in an n-word window found twice or more in the array."""

    def covered(windows: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            at = F.transform(
                s,
                lambda e, j: F.when(
                    F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)),
                    e["i"],
                ),
            )
            start = F.struct(F.lit(0).alias("sum"), F.lit(-n).alias("last"))
            step = lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(n), p - acc["last"])).alias("sum"), p.alias("last"))
            return F.aggregate(F.sort_array(F.filter(at, lambda p: p.isNotNull())), start, step)["sum"]

        keyed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(keyed, of_sorted))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))
    return F.when(F.size(words) <= n, 0).otherwise(let(hashes, covered))


def statistics(docs: DataFrame) -> DataFrame:
    """The rows with struct ``stat``: base statistics and the features of the rules."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        each = F.greatest(n, F.lit(1)).cast("double")
        chars = F.length(F.array_join(w, ""))
        dup = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("n"), F.greatest(F.size(x), F.lit(1)).alias("of")))
        return F.struct(
            n.cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            dup.alias("dup"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            (F.size(F.array_distinct(w)) / each).alias("distinct_share"),
        )

    raw = docs.withColumn("__w", let(words, of_words)).withColumn(
        "__c",
        F.struct(
            count("[#*$%&|<>]").alias("symbols"), count(r"\p{Lu}").alias("upper"), count("!").alias("shouts"), count(r"\|").alias("bars")
        ),
    )
    each = F.greatest(F.col("__w.n_words"), F.lit(1)).cast("double")
    return raw.withColumn(
        "stat",
        F.struct(
            F.col("__w.n_words").alias("n_words"),
            F.col("__w.word_chars").alias("word_chars"),
            F.col("__c.symbols").cast("long").alias("n_symbols"),
            F.col("__w.dup.n").cast("long").alias("n_dup_lines"),
            F.col("__w.n_repeat_words").alias("n_repeat_words"),
            (F.col("__w.word_chars") / each).alias("mean_word"),
            (F.col("__c.symbols") / each).alias("symbols_per_word"),
            (F.col("__w.dup.n") / F.col("__w.dup.of")).alias("dup_lines_share"),
            (F.col("__w.n_repeat_words") / each).alias("repeat_share"),
            F.col("__w.distinct_share").alias("distinct_share"),
            (F.col("__c.upper") / F.greatest(F.col("__w.word_chars"), F.lit(1))).alias("upper_share"),
            (F.col("__c.shouts") / each).alias("shouts_per_word"),
            (F.col("__c.bars") / each).alias("bars_per_word"),
        ),
    ).drop("__w", "__c")


def base_failed() -> Column:
    return (F.col("stat.n_words") < 20) | (100 * F.col("stat.n_repeat_words") > 30 * F.col("stat.n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.col(f"stat.{self.feature}")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def column(self) -> Column:
        found = self.conditions[0].column()
        for c in self.conditions[1:]:
            found = found & c.column()
        return found

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _best_condition(rows: list[dict]) -> Condition | None:
    """The threshold of greatest gain for the covered rows (those with ``bad`` set are sought)."""
    from math import log2

    bad = sum(r["bad"] for r in rows)
    if not bad or bad == len(rows):
        return None
    before, best, found = log2(bad / len(rows)), 0.0, None
    for feature in FEATURES:
        ordered = sorted((r[feature], r["bad"]) for r in rows)
        step, seen = max(1, len(ordered) // THRESHOLDS), 0
        for k in range(len(ordered) - 1):
            seen += ordered[k][1]
            at, after = ordered[k][0], ordered[k + 1][0]
            if at == after or not (k % step == 0 or ordered[k][1] != ordered[k + 1][1]):
                continue
            for above, p, n in ((False, seen, k + 1), (True, bad - seen, len(rows) - k - 1)):
                if p and (gain := p * (log2(p / n) - before)) > best + 1e-12:
                    best, found = gain, Condition(feature, above, (at + after) / 2)
    return found


def learn(rows: list[dict], least_precision: float = LEAST_PRECISION) -> list[Rule]:
    """Sequential covering over rows with the features and ``bad`` (0 or 1), in order:
    every third row is held out for pruning. A rule that is not precise enough there is
    set aside with the bad rows it covers, and the search goes on without these."""
    grow = [r for k, r in enumerate(rows) if k % 3]
    held = [r for k, r in enumerate(rows) if not k % 3]
    rules: list[Rule] = []
    tries = 0
    while len(rules) < MOST_RULES and tries < MOST_TRIES and any(r["bad"] for r in grow):
        tries += 1
        conditions: list[Condition] = []
        covered = grow
        while len(conditions) < MOST_CONDITIONS and (c := _best_condition(covered)):
            conditions.append(c)
            covered = [r for r in covered if c.holds(r)]

        def worth(k: int) -> tuple[float, int]:
            hit = [r["bad"] for r in held if all(c.holds(r) for c in conditions[:k])]
            return (sum(hit) / (len(hit) + 1), -k)  # noqa: B023

        if not conditions:
            break
        rule_conditions = tuple(conditions[: max(range(1, len(conditions) + 1), key=worth)])
        hit = [r["bad"] for r in held if all(c.holds(r) for c in rule_conditions)]
        precision = (sum(hit) + 1) / (len(hit) + 2)
        if len(hit) < 5 or sum(hit) < least_precision * len(hit):
            left = [r for r in grow if not (r["bad"] and all(c.holds(r) for c in rule_conditions))]
            if len(left) == len(grow):
                break
            grow = left
            continue
        rules.append(Rule(rule_conditions, precision))
        grow = [r for r in grow if not rules[-1].holds(r)]
        held = [r for r in held if not rules[-1].holds(r)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> list[Rule]:
    """The decision list for ``labels`` (doc_id, quality: 0 is to be rejected).

    The sample is bounded before the join, so its broadcast is too; of the rows of one
    id a single one is learned from, so that no more than the sample comes back."""
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
        .withColumn("place", F.xxhash64("doc_id"))
        .orderBy("place", "doc_id")
        .limit(most_labelled)
    )
    known = statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    # Rows that the base rules reject are left out here: as a filter in the plan it would
    # move below the join, and statistics be worked out for every document.
    wanted = F.struct(base_failed().alias("failed"), *[F.col(f"stat.{f}").alias(f) for f in FEATURES])
    each = known.select("place", "doc_id", "bad", wanted.alias("x")).groupBy("place", "doc_id", "bad").agg(F.min("x").alias("x"))
    rows = [{"bad": r["bad"], **r["x"].asDict()} for r in each.orderBy("place", "doc_id").collect()]
    return learn([r for r in rows if not r["failed"]])


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects: 0 for the base rules, null if none does."""
    found = F.when(base_failed(), F.lit(0))
    for k, rule in enumerate(rules, 1):
        found = found.when(rule.column(), F.lit(k))
    return found


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, base statistics, base_failed, kept, and rule (its number or null)."""
    return statistics(docs.select("doc_id", "text")).select(
        "doc_id",
        *[f"stat.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"),
        verdict(rules).isNull().alias("kept"),
        verdict(rules).cast("long").alias("rule"),
    )


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that are kept, with their columns."""
    judged = statistics(docs.select(F.struct("*").alias("__row"), F.col("text").alias("text")))
    return judged.where(verdict(rules).isNull()).select("__row.*")
