"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its distinct n-word shingles. Equal sets are one class, and
only class representatives are compared. A signature has ``N_VALUES`` minima of
``BITS`` bits; the distance of two is the number of minima that differ. Signatures are
split into ``CHUNKS`` chunks; by the pigeonhole principle two at distance
CHUNKS * (ERRORS + 1) - 1 or less agree in some chunk up to ERRORS minima, so every
choice of ERRORS minima to leave out of a chunk gives an index key, and all such pairs
share a key. (Five minima with one error in nine chunks: distance 17 of 45 is
guaranteed; a pair of similarity 0.8 at any distance is missed about once in 150,000.)

Pairs under a key are not enumerated. First each representative is compared on full
sets with one that leads a key (the one it shares most keys with), and components are
found (a leader of many is split over parts of a join). What a key still holds outside its largest component is unresolved: in rounds, it
is compared with members of that component and with one of the next largest, others in
each round, for as long as that resolves a tenth of it. What then is left is settled exactly:

* Within a component sets are held as their difference from that of its centre, the
  member of most links. An unresolved set close enough to the centre is linked to it.
* Any other, x, can only be linked to a y whose difference shares elements with its own:
  with g = size of the difference - (1 - s) / (1 + s) * size of the set, at least
  (g(x) + g(y)) / 2 of them, where g(x) > -g(centre) and g(y) >= g(centre). In any common
  order of the elements the first shared one then lies in a prefix of both; the order
  is by how many differences hold an element, so that prefixes are of rare ones. Prefixes are
  joined on (component, element), so that a component with a third of all documents is
  spread over its elements, and pairs that meet are confirmed on whole differences.

After that, no pair that shares a key is left unless a chain of confirmed links joins
it already.

Defined results: a null or empty text, or one of white space, has an empty set and is
linked with nothing; with fewer words than a shingle has, the whole sequence is the
one shingle; very long texts give sets of all their shingles; rows of equal id share one component; rows with a null id stay alone,
component null and kept; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import Scratch, Written, components, hot_keys, spread_join

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BITS, CHUNKS, CHUNK_VALUES, ERRORS = 16, 9, 5, 1
N_VALUES = CHUNKS * CHUNK_VALUES
#: Representatives whose signatures differ in more minima are not compared in full; a
#: similarity of 0.8 gives more about three times in ten million.
MOST_DISTANCE = 24
#: Rounds of new leaders at most; what they leave is settled exactly.
MOST_ROUNDS = 6
#: Members of the largest component that one outside is compared with in a round.
MAIN_PARTNERS = 3

_rng = np.random.default_rng(20_240_229)
_MULTIPLY = _rng.integers(1, 1 << 63, N_VALUES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, N_VALUES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct n-word shingles of each text."""
    words: list[bytes] = []
    ends = []
    for text in texts:
        # bytes.lower() changes A-Z alone; bytes.split() parts at the six ASCII white spaces.
        words += text.encode("utf-8", "surrogatepass").lower().split()
        ends.append(len(words))
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    table = np.fromiter((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in distinct), np.uint64, len(distinct))
    hashed = table[codes] if len(words) else np.zeros(0, np.uint64)
    out, start = [], 0
    for end in ends:
        own, start = hashed[start:end], end
        if len(own):
            size = min(n, len(own))
            acc = np.full(len(own) - size + 1, size, np.uint64)
            for k in range(size):
                acc = _mix(acc ^ own[k : len(own) - size + 1 + k]) + np.uint64(0x9E3779B97F4A7C15)
            own = np.unique(acc)
        out.append(own)
    return out


def signature(shingles: np.ndarray) -> bytes:
    """``N_VALUES`` minima of BITS bits, big-endian."""
    least = np.full(N_VALUES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096, None] * _MULTIPLY + _ADD
        np.minimum(least, (part >> np.uint64(8)).min(axis=0), out=least)
    return _mix(least).astype(">u2").tobytes()


def _signed(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 500):
                part = frame.iloc[a : a + 500]
                sets = shingle_sets([t or "" for t in part["text"]], n)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64"),
                        "n_shingles": [len(s) for s in sets],
                        "digest": [hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None for s in sets],
                        "signature": [signature(s) if len(s) else None for s in sets],
                    }
                )

    return run


def _sets(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 500):
                part = frame.iloc[a : a + 500]
                sets = shingle_sets([t or "" for t in part["text"]], n)
                # Another row of the same id may have no words: it has no set to link by.
                held = [(rep, s.view(np.int64)) for rep, s in zip(part["rep"], sets, strict=True) if len(s)]
                if held:
                    yield pd.DataFrame({"rep": [h[0] for h in held], "shingles": [h[1] for h in held]})

    return run


def index_keys(signature_column: str) -> Column:
    """One key per chunk and choice of the minima left out."""
    width = BITS // 8
    at = lambda k: F.substring(signature_column, k * width + 1, width)
    keys = []
    for chunk in range(CHUNKS):
        for out in range(CHUNK_VALUES):
            kept = [at(chunk * CHUNK_VALUES + k) for k in range(CHUNK_VALUES) if k != out]
            keys.append(F.xxhash64(F.lit(chunk * CHUNK_VALUES + out), *kept))
    return F.array(*keys)


def distance(a: str, b: str) -> Column:
    """Minima in which two signatures differ."""
    width = BITS // 8
    differ = [(F.substring(a, k * width + 1, width) != F.substring(b, k * width + 1, width)).cast("int") for k in range(N_VALUES)]
    return sum(differ[1:], differ[0])


def hot_sides(pairs: DataFrame, scratch: Scratch) -> dict[str, DataFrame | None]:
    """Representatives in many of the pairs (a, b), for each side."""
    return {side: hot_keys(pairs.groupBy(side).agg(F.count("*").alias("n")), [side], scratch) for side in "ab"}


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float, hot: dict[str, DataFrame | None]) -> DataFrame:
    """The pairs (a, b) of representatives whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    enough = round(similarity * 100)
    joined = spread_join(spread_join(pairs, right, ["b"], "a", hot["b"]), left, ["a"], "b", hot["a"])
    return joined.where(100 * both >= enough * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def differences(outside: DataFrame, inside: DataFrame, links: DataFrame, sets: DataFrame, hot: DataFrame | None) -> DataFrame:
    """main (a component), rep, comp (its own), inner, n (size of its set), d (the set's
    difference from that of the component's centre), centre and n_centre, for those outside
    a component and those inside it."""
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count("*").alias("degree"))
    most = F.max_by("rep", F.struct(F.coalesce("degree", F.lit(0)), -F.col("rep"))).alias("rep")
    centre = inside.join(degree, "rep", "left").groupBy("main").agg(most)
    # An id of several texts has several sets; one of them is the centre.
    centre = centre.join(sets, "rep").groupBy("main", F.col("rep").alias("centre")).agg(F.min("shingles").alias("c"))
    rows = outside.withColumn("inner", F.lit(False)).unionByName(inside.withColumn("inner", F.lit(True)))
    apart = F.concat(F.array_except("shingles", "c"), F.array_except("c", "shingles"))
    held = spread_join(rows.join(sets, "rep"), centre, ["main"], "rep", hot)
    return held.select("main", "rep", "comp", "inner", F.size("shingles").alias("n"), apart.alias("d"), "centre", F.size("c").alias("n_centre"))


def candidates(held: DataFrame, similarity: float, scratch: Scratch, hot: DataFrame | None = None) -> DataFrame:
    """main, rep_x, rep_y: pairs of different components whose prefixes meet, x outside and
    not linked to the centre."""
    percent = round(similarity * 100)
    share = (100 - percent) / (100 + percent)
    held = held.withColumn("size_d", F.size("d")).withColumn("g", F.col("size_d") - F.lit(share) * F.col("n"))
    probe = F.expr(f"not inner and {100 + percent} * size_d > {100 - percent} * (n + n_centre)")
    held = held.withColumn("probe", probe)
    held = spread_join(held, held.where("probe").select("main").distinct(), ["main"], "rep", hot)
    # The least number of elements shared with any other; a little less, for rounding: a longer prefix does no harm.
    of_centre = F.lit(-share) * F.col("n_centre")
    least = lambda g: F.greatest(F.lit(1), F.ceil(g / 2 - 1e-6))
    known = held.select("main", "rep", "comp", "n", "size_d", "g", "probe", least(F.col("g") + of_centre).alias("as_x"), least(F.col("g") - of_centre).alias("as_y"), "d")
    # Elements held once meet nothing; they only come first in the order.
    elements = held.select("main", F.explode("d").alias("element"))
    common = elements.groupBy("main", "element").agg(F.count("*").alias("holders")).where("holders > 1")
    spread = known.withColumn("element", F.explode("d")).drop("d").join(common, ["main", "element"])
    own = Window.partitionBy("main", "rep")
    alone = F.col("size_d") - F.count("*").over(own)
    placed = spread.withColumn("pos", F.row_number().over(own.orderBy("holders", "element")) + alone)
    longest = F.col("size_d") + 1 - F.when(F.col("probe"), F.least("as_x", "as_y")).otherwise(F.col("as_y"))
    prefixes = scratch(placed.where(F.col("pos") <= longest).drop("holders"), "prefixes")

    def side(rows: DataFrame, s: str) -> DataFrame:
        return rows.select("main", "element", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "comp", "n", "size_d", "g", "pos")])

    x = side(prefixes.where("probe and pos <= size_d + 1 - as_x"), "x")
    y = side(prefixes.where("pos <= size_d + 1 - as_y"), "y")
    shared = least(F.col("g_x") + F.col("g_y"))
    sizes = (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & (F.col("comp_x") != F.col("comp_y"))
    inside = (F.col("pos_x") <= F.col("size_d_x") + 1 - shared) & (F.col("pos_y") <= F.col("size_d_y") + 1 - shared)
    met = x.join(y, ["main", "element"]).where(sizes & inside)
    return met.select("main", "rep_x", "rep_y").distinct()


def settled(held: DataFrame, similarity: float, scratch: Scratch, hot: DataFrame | None) -> DataFrame:
    """The links (a, b) between ``held`` sets outside a component and those inside it, or
    others outside it, exactly but for those that a chain of links joins."""
    percent = round(similarity * 100)
    near = held.where(F.expr("not inner and rep <> centre") & ((100 + percent) * F.size("d") <= (100 - percent) * (F.col("n") + F.col("n_centre"))))
    side = lambda s: held.select("main", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "d")])
    both = candidates(held, similarity, scratch, hot).join(side("x"), ["main", "rep_x"]).join(side("y"), ["main", "rep_y"])
    whole = F.size("d_x") + F.size("d_y") - 2 * F.size(F.array_intersect("d_x", "d_y"))
    met = both.where((100 + percent) * whole <= (100 - percent) * (F.col("n_x") + F.col("n_y")))
    pairs = met.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))
    return pairs.unionByName(near.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))).distinct()


def unresolved(members: DataFrame, comps: DataFrame, turn: int) -> DataFrame:
    """key, main (the largest component under the key), rep and comp of what lies outside
    it, with ``leaders``: one of the main and one of the next largest component there, by a
    digest that differs in each turn."""
    placed = members.select("key", "rep").join(comps, "rep")
    leader = F.min_by("rep", F.xxhash64("rep", "key", F.lit(turn))).alias("leader")
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("k"), leader)
    first = F.max(F.struct("k", "comp", "leader")).alias("first")
    several = per.groupBy("key").agg(first, F.count("*").alias("n")).where("n > 1").select("key", "first")
    second = per.join(several, "key").where("comp <> first.comp").groupBy("key", "first").agg(F.max(F.struct("k", "comp", "leader")).alias("second"))
    return placed.join(second, "key").where("comp <> first.comp").select(
        "key", F.col("first.comp").alias("main"), "rep", "comp", F.array("first", "second").alias("leaders")
    )


def joined_up(comps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``comps`` (rep, comp) after further ``links`` (a, b): components of the components."""
    left = comps.select(F.col("rep").alias("a"), F.col("comp").alias("ca"))
    right = comps.select(F.col("rep").alias("b"), F.col("comp").alias("cb"))
    between = links.join(left, "a").join(right, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    now = components(between, scratch).withColumnRenamed("node", "comp")
    hot = hot_keys(comps.groupBy("comp").agg(F.count("*").alias("n")), ["comp"], scratch)
    return spread_join(comps, now, ["comp"], "rep", hot, "left").select("rep", F.coalesce("component", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (one document of each component)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = Written(
        texts.mapInPandas(_signed(shingle_words), "doc_id long, n_shingles long, digest binary, signature binary"), "signatures"
    ).df
    reps = (
        signed.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    )
    reps = Written(reps, "classes").df
    with Scratch() as scratch:
        comps = Written(linked(texts, reps, shingle_words, similarity, scratch), "components").df
    grouped = signed.join(reps.select("digest", "rep"), "digest", "left").join(comps, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id"))
    result = grouped.select("doc_id", "n_shingles", component.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def linked(texts: DataFrame, reps: DataFrame, shingle_words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(rep, comp) of the representatives that share a key with another one."""
    # Members of keys with company, with signature and size for the filters before full comparison.
    keyed = reps.select("rep", F.explode(index_keys("signature")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("leader")).where("members > 1")
    members = scratch(keyed.join(shared, "key").select("key", "rep", "leader"), "members")

    sized = reps.select("rep", "signature", "n")
    left = sized.select(F.col("rep").alias("a"), F.col("signature").alias("sa"), F.col("n").alias("na"))
    right = sized.select(F.col("rep").alias("b"), F.col("signature").alias("sb"), F.col("n").alias("nb"))

    def likely(pairs: DataFrame, hot: dict[str, DataFrame | None]) -> DataFrame:
        least = similarity * F.greatest("na", "nb") - 1e-6
        fits = (F.least("na", "nb") >= least) & (distance("sa", "sb") <= MOST_DISTANCE)
        joined = spread_join(spread_join(pairs, right, ["b"], "a", hot["b"]), left, ["a"], "b", hot["a"])
        return joined.where(fits).select("a", "b")

    wanted = members.select("rep").distinct()
    sets = scratch(
        texts.join(wanted, texts["doc_id"] == wanted["rep"]).select("rep", "text").mapInPandas(_sets(shingle_words), "rep long, shingles array<long>"),
        "sets",
    )
    # First each representative and one that leads a key, the one that it shares most keys with.
    led = members.where("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("keys"))
    star = led.groupBy(F.col("rep").alias("b")).agg(F.max_by("leader", F.struct("keys", -F.col("leader"))).alias("a"))
    star = scratch(star, "star")
    hot = hot_sides(star, scratch)
    tried = scratch(likely(star, hot), "tried")
    links = scratch(confirmed(tried, sets, similarity, hot), "links")
    comps = scratch(joined_up(wanted.withColumn("comp", F.col("rep")), links, scratch), "joined")
    outside = scratch(unresolved(members, comps, 0), "outside")
    remain = outside.select("rep").distinct().count()

    # Then rounds of new leaders, for as long as they resolve a tenth of what is left.
    for turn in range(1, MOST_ROUNDS + 1):
        if not remain:
            break
        met = outside.select("rep", "comp", F.posexplode("leaders").alias("which", "other")).where("comp <> other.comp")
        per = met.groupBy("rep", "which", F.col("other.leader").alias("leader")).agg(F.count("*").alias("keys"))
        nth = F.row_number().over(Window.partitionBy("rep", "which").orderBy(F.desc("keys"), "leader"))
        best = per.withColumn("nth", nth).where(F.col("nth") <= F.when(F.col("which") == 0, MAIN_PARTNERS).otherwise(1))
        pairs = best.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
        pairs = scratch(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        hot = hot_sides(pairs, scratch)
        pairs = scratch(likely(pairs, hot), "tried")
        found = scratch(confirmed(pairs, sets, similarity, hot), "links")
        tried, links = tried.unionByName(pairs), links.unionByName(found)
        comps = scratch(joined_up(comps, found, scratch), "joined")
        outside = scratch(unresolved(members, comps, turn), "outside")
        before, remain = remain, outside.select("rep").distinct().count()
        if 10 * remain > 9 * before:
            break

    # Last, exactly, what a key still holds outside its largest component.
    outside = scratch(outside.select("main", "rep", "comp").distinct(), "outside")
    mains = outside.groupBy("main").agg(F.count("*").alias("n"))
    sizes = comps.groupBy(F.col("comp").alias("main")).agg(F.count("*").alias("own")).join(mains, "main")
    hot = hot_keys(sizes.select("main", (F.col("own") + F.col("n")).alias("n")), ["main"], scratch)
    inside = spread_join(comps.select(F.col("comp").alias("main"), "rep"), mains.select("main"), ["main"], "rep", hot)
    inside = inside.select("main", "rep", F.col("main").alias("comp"))
    held = scratch(differences(outside, inside, links, sets, hot), "differences")
    return joined_up(comps, scratch(settled(held, similarity, scratch, hot), "more"), scratch)


def apply(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, with its columns; rows repeated in full count once."""
    kept = near_duplicates(docs, shingle_words, similarity).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi").dropDuplicates(["doc_id", "text"])


#: Components by all pairs, for ``near_duplicates(docs, 2, 0.8)``.
NEAR_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as s from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * k >= 80 * (p.n + q.n - k)),
sides as (select x, y from links union all select y, x from links),
reach(node, seen) as (select doc_id, doc_id from documents union select b.y, r.seen from reach r join sides b on b.x = r.node),
least as (select node, min(seen) as component_id from reach group by node)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join least on node = d.doc_id left join sizes on sizes.doc_id = d.doc_id
"""
