"""Mixing sources to target weights by a low-discrepancy source schedule.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share a budget
of words; no target exceeds a multiple of its source's size, and what lies above is
shared again by weight. Each source's documents are shuffled by a digest of their id
into one stream that repeats in epochs, cut into blocks of equal words. Slot t has
the golden-ratio point frac(t * phi), which the cumulative targets map to a source;
the n-th slot of a source takes the n-th block of its stream. What the mix takes is what
its slots reach, and nothing else. N points leave no gap of 1.9 / N or more, so that
twice as many slots as blocks reach every block; a source of many blocks has its
own after a hundredth more, and later slots are drawn for small sources alone.

Defined results: a null text has no words and is never taken; documents of equal id
are shuffled by size; rows repeated in full are taken each by itself; a very long text lies in as many
blocks as its words need; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import SPACE, WORD, Written, running_sum

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_EPOCHS = 2
BLOCK_WORDS = 1024
#: Slots in one partition of the applied mix.
PART_SLOTS = 2048
#: The golden ratio as two Fibonacci numbers in a row, so that the points stay even over all of them.
_GOLDEN, _UNIT = 956_722_026_041, 1_548_008_755_920
_LOW = 1 << 21
_CELLS, _CHUNK = 4096, 1 << 16
#: Sources of fewer blocks may need slots beyond the first hundredth over all blocks.
SMALL_QUOTA = 2048


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size (words) and further columns of every document."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n.alias("size"), *more)


def targets(sized: DataFrame) -> DataFrame:
    """source, source_no, source_size and target of every source.

    A source is capped or gets its weight times one level; ordered by cap per weight,
    the level is the largest that any row finds for itself and those after it. The
    windows run over one row per source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    return (
        totals.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.get(weights, F.col("source_no") % len(WEIGHTS)))
        .withColumn("cap", F.col("source_size") * MOST_EPOCHS)
        .withColumn("all", F.sum("source_size").over(every))
        .withColumn("above", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.lit(BUDGET) * F.col("all") - F.col("above")) / F.col("rest")).over(every))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
        .select("source", "source_no", "source_size", "target")
    )


def _point(slot: Column) -> Column:
    """slot * _GOLDEN modulo _UNIT, in two parts that fit a long."""
    t = slot % _UNIT
    return (F.floor(t / _LOW) * (_GOLDEN * _LOW % _UNIT) + (t % _LOW) * _GOLDEN) % _UNIT


def schedule(quotas: DataFrame, n_slots: int, n_drawn: int = 0) -> DataFrame:
    """slot, source_no, block: golden-ratio points through the cumulative quotas,
    ranked per source. ``quotas``: source_no, quota (blocks), upto (of it and those before).
    Slots from ``n_slots`` up to ``n_drawn`` are those of sources below SMALL_QUOTA."""
    total = F.max("upto").over(Window.partitionBy())
    ends = quotas.select(
        "source_no",
        "quota",
        F.floor((F.col("upto") - F.col("quota")) * F.lit(float(_UNIT)) / total).alias("lo"),
        F.floor(F.col("upto") * F.lit(float(_UNIT)) / total).alias("hi"),
    ).where("hi > lo")
    # An equal join on a grid of cells stands in for the range join.
    width = _UNIT // _CELLS
    cells = ends.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    spark = quotas.sparkSession
    points = (
        spark.range(max(n_slots, n_drawn))
        .withColumnRenamed("id", "slot")
        .withColumn("point", _point(F.col("slot")))
        .withColumn("cell", F.floor(F.col("point") / width))
    )
    hit = points.join(cells, "cell").where(f"point >= lo and point < hi and (slot < {n_slots} or quota < {SMALL_QUOTA})")
    hit = hit.select("slot", "source_no", "quota", F.floor(F.col("slot") / _CHUNK).alias("chunk"), F.lit(1).alias("one"))
    return running_sum(hit, "source_no", "chunk", ["slot"], "one", "block").where("block < quota").select("slot", "source_no", "block")


def _quota(block_words: int) -> Column:
    return F.ceil(F.floor("target") / block_words)


def slots(aims: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[int, int]:
    """How many slots are drawn for all sources, and for small ones."""
    blocks = aims.agg(F.sum(_quota(block_words))).first()[0] or 0
    return blocks * 101 // 100 + 64, blocks * 2 + 64


def mix(sized: DataFrame, aims: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixed stream: slot, source_no, block, row_no, epoch, first and last (words of
    the document that the block takes: first included, last not), and the columns of
    ``sized`` but its source.

    ``sized`` and ``aims`` come from ``sizes`` and ``targets`` and should be written
    tables. ``row_no`` tells repeated rows apart: the words of the source before it."""
    known = sized.where("size > 0").join(
        aims, sized["source"].eqNullSafe(aims["source"])
    )
    own = [c for c in sized.columns if c != "source"]
    known = known.select(*own, "source_no", "source_size", F.floor("target").alias("goal"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    known = known.withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    laid = running_sum(known, "source_no", "bucket", ["key", "doc_id", "size"], "size", "row_no")
    seen = laid.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1))))
    seen = seen.withColumn("a", F.col("epoch") * F.col("source_size") + F.col("row_no"))
    seen = seen.withColumn("b", F.least(F.col("a") + F.col("size"), "goal")).where("b > a")
    seen = seen.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("a") / block_words), F.floor((F.col("b") - 1) / block_words)))
    )
    pieces = seen.select(
        "source_no",
        "block",
        "row_no",
        *own,
        "epoch",
        (F.greatest("a", F.col("block") * block_words) - F.col("a")).alias("first"),
        (F.least("b", (F.col("block") + 1) * block_words) - F.col("a")).alias("last"),
    )
    quotas = aims.select("source_no", _quota(block_words).alias("quota")).withColumn(
        "upto", F.sum("quota").over(Window.orderBy("source_no"))
    )
    return pieces.join(schedule(quotas, *slots(aims, block_words)), ["source_no", "block"])


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words in the slots that reach it) of
    every document."""
    sized = Written(sizes(docs), "sizes").df
    aims = Written(targets(sized), "targets").df
    taken = mix(sized, aims).groupBy("source_no", "row_no", "doc_id", "size").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    # Rows of equal id and size are alike, so the n-th of them may get the n-th share.
    alike = Window.partitionBy("source_no", "doc_id", "size")
    taken = taken.withColumn("nth", F.row_number().over(alike.orderBy("row_no")))
    every = sized.join(aims, sized["source"].eqNullSafe(aims["source"])).drop("source")
    every = every.withColumn("nth", F.row_number().over(alike.orderBy("source_no")))
    joined = every.withColumn("id", F.coalesce("doc_id", F.lit(-1))).withColumn("no_id", F.col("doc_id").isNull())
    taken = taken.select(
        "source_no", "size", "nth", "taken", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id")
    )
    return joined.join(taken, ["source_no", "size", "nth", "id", "no_id"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def apply(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with their columns: a row for each epoch that
    takes any of a document, with the words it takes (all of them, or one run joined by
    single spaces); n_chars follows the text. The rows come in the order of the first slot
    that reaches them: a partition is a run of slots, sorted."""
    same = F.xxhash64("text")
    sized = sizes(docs.select("doc_id", "source", "text", same.alias("same")), "same")
    sized = Written(sized, "sizes").df
    aims = Written(targets(sized), "targets").df
    taken = mix(sized, aims).groupBy("source_no", "row_no", "epoch", "doc_id", "same", "size")
    n_slots, _ = slots(aims)
    taken = taken.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("slot").alias("slot"))
    at = F.struct("slot", "source_no", "epoch", "row_no").alias("__at")
    # Names of our own, so that documents may have columns of any other.
    known = lambda: (F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__no_id"))
    taken = taken.select(*known(), at, *[F.col(c).alias(f"__{c}") for c in ("source_no", "same", "size", "first", "last")])
    # A row of ``taken`` stands for one row of the documents, so equal rows are needed but once.
    numbered = aims.select(F.col("source").alias("__source"), F.col("source_no").alias("__source_no"))
    texts = docs.join(numbered, docs["source"].eqNullSafe(numbered["__source"])).select(*docs.columns, "__source_no", same.alias("__same"), *known())
    keys = ["__source_no", "__id", "__no_id", "__same"]
    both = texts.dropDuplicates(keys).join(taken, keys)
    words = F.array_remove(F.split("text", f"[{SPACE}]+"), "")
    part = F.array_join(F.slice(words, (F.col("__first") + 1).cast("int"), (F.col("__last") - F.col("__first")).cast("int")), " ")
    text = F.when((F.col("__first") == 0) & (F.col("__last") == F.col("__size")), F.col("text")).otherwise(part)
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    # Slots are even, so runs of them need no sample of the rows; the few late ones of small sources are the last run.
    part = F.floor(F.least("__at.slot", F.lit(n_slots)) / PART_SLOTS).cast("int")
    placed = out.select(*docs.columns, "__at").repartitionById(n_slots // PART_SLOTS + 1, part)
    return placed.sortWithinPartitions("__at").select(*docs.columns)


MIX_SQL = rf"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), totals as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as source_no from sized group by source
), capped as (
  select *, [5, 2, 1][(source_no % 3 + 1)::int] as weight, source_size * 2 as cap, (sum(source_size) over ())::bigint as total from totals
), levels as (
  select *, coalesce(sum(cap) over (order by cap / weight, source_no rows between unbounded preceding and 1 preceding), 0)::bigint as above,
    (sum(weight) over (order by cap / weight, source_no rows between current row and unbounded following))::bigint as rest from capped
), aims as (
  select source, source_no, source_size, least(cap::double, weight * max((1.5::double * total - above) / rest) over ()) as target from levels
), quotas as (
  select source_no, ceil(floor(target) / {BLOCK_WORDS})::bigint as quota from aims
), ends as (
  select *, (sum(quota) over (order by source_no))::bigint as upto, (sum(quota) over ())::bigint as blocks from quotas
), slots as (
  select slot, ((slot // {_LOW}) * {_GOLDEN * _LOW % _UNIT} + (slot % {_LOW}) * {_GOLDEN}) % {_UNIT} as point
  from (select unnest(range((select max(blocks) * 2 + 64 from ends))) as slot)
), scheduled as (
  select slot, source_no, quota, row_number() over (partition by source_no order by slot) - 1 as block from slots join ends
  on point >= floor((upto - quota) * {_UNIT}::double / blocks)::bigint and point < floor(upto * {_UNIT}::double / blocks)::bigint
  where slot < blocks * 101 // 100 + 64 or quota < {SMALL_QUOTA}
), laid as (
  select row_number() over () as id, doc_id, size, source_no, source_size, target, floor(target)::bigint as goal,
    coalesce(sum(size) over (partition by source_no order by md5(coalesce(doc_id::varchar, '')), doc_id, size
      rows between unbounded preceding and 1 preceding), 0)::bigint as row_no
  from sized join aims on sized.source is not distinct from aims.source
), seen as (
  select id, source_no, epoch * source_size + row_no as a, least(epoch * source_size + row_no + size, goal) as b from laid, (values (0), (1)) e(epoch)
), pieces as (
  select id, source_no, a, b, unnest(range(a // {BLOCK_WORDS}, (b - 1) // {BLOCK_WORDS} + 1)) as block from seen where b > a
), taken as (
  select id, sum(least(b, (block + 1) * {BLOCK_WORDS}) - greatest(a, block * {BLOCK_WORDS}))::bigint as taken
  from pieces join scheduled using (source_no, block) where block < quota group by id
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from laid left join taken using (id)
"""
