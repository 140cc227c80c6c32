"""Near-duplicates by word shingles: MinHash bands retrieve pairs, the exact Jaccard similarity of their shingle sets decides.

Only groups are wanted, so a crowded bucket isn't turned into all its pairs: every set is compared with one pivot. Sets alike to the
pivot are linked through it. The others go on to the next pivot, and Jaccard distance, being a metric, tells which of them
could still be alike to a linked one. What a set alone holds can't be shared, so the number of its other shingles bounds its
similarity to any set: most edited copies of a large group are ruled out by it without being compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import simhash
from plumbline.llm.common import connected_components, join_unique, map_texts, release, spool

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 0.00003.
BANDS, ROWS = 20, 4
WORDS, PERCENT = 5, 80
FACTORS = np.random.default_rng(7).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A bucket of more sets is crowded: it gets up to PIVOTS pivots, and what is then left is split by every other band.
CROWD, PIVOTS = 16, 4
#: Comparisons with one set that one task makes, about.
SPREAD = 4096


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of words, split as in simhash; a shorter text is one run, one without words has none."""
    parts = [np.unique(h.view(">u8").astype(np.uint64).ravel()) for h in simhash.shingle_hashes(text, words, 0)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None


def _bands(s: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 8192):
        np.minimum(least, ((s[i : i + 8192] * FACTORS) >> np.uint64(32)).min(1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(r.tobytes(), b)).view(np.int64)) for b, r in enumerate(rows)]


def _signatures(words: int) -> Callable[[list[str]], dict]:
    def work(texts: list[str]) -> dict:
        sets = [shingles(t, words) for t in texts]
        return {"sid": [_digest(s) for s in sets], "n": [len(s) for s in sets], "bands": [_bands(s) if len(s) else [] for s in sets]}

    return work


def _sets(words: int) -> Callable[[list[str]], dict]:
    def work(texts: list[str]) -> dict:
        sets = [shingles(t, words) for t in texts]
        return {"sid": [_digest(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]}

    return work


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, salt and more) with shared and total: sizes of the sections and unions of their sets. Each salt of an a is joined by itself."""
    left = pairs.select("a", "salt").distinct().join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a")
    both = pairs.join(left, ["a", "salt"]).join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select(*pairs.columns, shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("total"))


def _may_be_alike(percent: int) -> Column:
    """Whether sets of sizes x and y, with u and v shingles that other sets hold too, can share enough for a similarity of percent."""
    return F.least("u", "v") * (100 + percent) >= percent * (F.col("x") + F.col("y"))


def with_common(one: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """sid, n, bands and common, the shingles that another of the sets holds too, of the sets whose common ones suffice for a similarity of percent."""
    once = sets.select("sid", F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("holders"), F.min("sid").alias("sid")).where("holders = 1")
    counted = one.join(once.groupBy("sid").agg(F.count(F.lit(1)).alias("own")).hint("merge"), "sid", "left")
    return counted.select("sid", "n", "bands", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common")).where(F.col("common") * 100 >= percent * F.col("n"))


def _all_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of each bucket whose sizes n and common shingles allow a similarity of percent."""
    a, b = (buckets.select("key", F.col("sid").alias(s), F.col("n").alias(n), F.col("common").alias(c)) for s, n, c in ("axu", "byv"))
    return a.join(b, "key").where("a < b").where(_may_be_alike(percent)).select("a", "b").distinct()


def _crowded(buckets: DataFrame) -> DataFrame:
    """The crowded buckets with their sizes and pivots: of each the set with the least share of shingles of its own, so the text that others are copies of."""
    pivot = F.min(F.struct(((F.col("n") - F.col("common")) / F.col("n")).alias("own"), "sid"))["sid"]
    return spool(buckets.groupBy("key").agg(pivot.alias("pivot"), F.count(F.lit(1)).alias("members")).where(F.col("members") > CROWD), "crowded")


def similar_links(one: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join all sets of one (sid, bands, and n, the size) of which a band retrieves a chain of pairs with a similarity of percent or more.

    Every link is verified exactly. Between a pivot's linked and other sets all those pairs are compared that the distances to the
    pivot and the shingles they have in common with any set allow to be alike. Sets that are left over after PIVOTS pivots are compared where a second band agrees too: a pair at 0.8
    that one band retrieves is then missed with a calculated probability of 0.00005.
    """
    one = spool(with_common(one, sets, percent), "common")
    buckets = spool(one.select("sid", "n", "common", F.explode("bands").alias("key")), "buckets")
    gap, met, todo = 100 - percent, [], []  # compared pairs, and pairs that are still to be compared
    alike = F.col("shared") * 100 >= percent * F.col("total")
    for _ in range(PIVOTS):
        crowded = _crowded(buckets)
        if crowded.isEmpty():
            break
        todo.append(spool(_all_pairs(buckets.join(crowded.select("key"), "key", "left_anti"), percent), "pairs"))
        spread = F.ceil(F.col("members") / SPREAD).cast("long")
        tried = spool(join_unique(buckets, crowded.withColumn("rows", F.col("members")), "key", "rows").where("sid <> pivot").select("key", "n", "common", F.col("pivot").alias("a"), F.col("sid").alias("b"), F.pmod(F.xxhash64("sid"), spread).alias("salt")), "tried")
        found = spool(compared(tried.groupBy("a", "b").agg(F.min("salt").alias("salt")), sets), "met")
        met.append(found.where(alike).select("a", "b"))
        share = (F.col("shared") * 100 / F.col("total")).alias("share")
        placed = spool(tried.select("key", "n", "common", "a", "b").join(found.select("a", "b", share), ["a", "b"]).select("key", F.col("b").alias("sid"), "n", "common", "share"), "placed")
        rest = placed.where(F.col("share") < percent)
        ring = rest.where(F.col("share") >= percent - gap).select("key", F.col("sid").alias("a"), F.col("n").alias("x"), F.col("common").alias("u"), F.col("share").alias("outer"))
        near = placed.where(F.col("share") >= percent).select("key", F.col("sid").alias("b"), F.col("n").alias("y"), F.col("common").alias("v"), F.col("share").alias("inner"))
        todo.append(spool(ring.join(near, "key").where((F.col("inner") <= F.col("outer") + gap + 1e-9) & _may_be_alike(percent)).select("a", "b").distinct(), "across"))
        buckets = spool(rest.select("sid", "n", "common", "key"), "buckets")
    else:
        crowded = _crowded(buckets)
        todo.append(spool(_all_pairs(buckets.join(crowded.select("key"), "key", "left_anti"), percent), "pairs"))
        apart = join_unique(buckets, crowded.select("key", "members"), "key", "members").join(one.select("sid", F.explode("bands").alias("other")), "sid").where("other <> key")
        buckets = spool(apart.select("sid", "n", "common", F.xxhash64("key", "other").alias("key")), "buckets")
    todo.append(spool(_all_pairs(buckets, percent), "pairs"))
    pairs = spool(reduce(DataFrame.unionByName, todo).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("salt", F.lit(0)), "pairs")
    met.append(compared(pairs, sets).where(alike).select("a", "b"))
    return spool(reduce(DataFrame.unionByName, met), "alike")


def deduplicate(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of the smallest id of each group of near-duplicates; rows without an id stay.

    Linked are texts whose shingle sets have a Jaccard similarity of percent or more, and those that simhash.near_duplicates links.
    Work goes over distinct sets; only texts of retrieved pairs are compared. Null and blank texts are one group, of repeated rows
    of one id one stays, texts of any length are read whole, and an empty table gives an empty result.
    """
    known = docs.where(F.col(id_col).isNotNull())
    near = spool(simhash.near_duplicates(docs, id_col=id_col, text_col=text_col), "near")
    signed = spool(map_texts(known, id_col, text_col, partial(_signatures, words), [T.StructField("sid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]), "signatures")
    rows = signed.where("sid IS NOT NULL").select(id_col, "sid")
    one = spool(signed.where("sid IS NOT NULL").groupBy("sid").agg(F.min(id_col).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets")
    keys = one.select("sid", F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("sid"))
    shared = keys.where("n > 1").select("key", "n")
    met = spool(join_unique(one.select("least", "sid", F.explode("bands").alias("key")), spool(shared, "shared"), "key", "n").select(F.col("least").alias(id_col), "sid").distinct(), "met")
    # ids of pairs grow with the documents: shuffled at every size
    texts = known.select(id_col, text_col).join(met.select(id_col).distinct().hint("merge"), id_col, "left_semi")
    sets = spool(map_texts(texts, id_col, text_col, partial(_sets, words), [T.StructField("sid", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))]).select("sid", "shingles").dropDuplicates(["sid"]), "shingles")
    alike = similar_links(one.join(met.select("sid").hint("merge"), "sid", "left_semi"), sets, percent)
    placed = spool(rows.join(near.select(id_col, "component_id").distinct(), id_col).select("sid", "component_id").distinct(), "placed")
    least = placed.groupBy("sid").agg(F.min("component_id").alias("least"))
    same = placed.join(least, "sid").select(F.col("component_id").alias("a"), F.col("least").alias("b"))
    across = alike.join(least.select(F.col("sid").alias("a"), F.col("least").alias("u")), "a").join(least.select(F.col("sid").alias("b"), F.col("least").alias("v")), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    roots = connected_components(same.unionByName(across).where("a <> b"))
    first = near.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count(F.lit(1)).alias("rows"))
    kept = spool(first.join(roots.where("node <> root").select(F.col("node").alias(id_col)).hint("merge"), id_col, "left_anti"), "kept")
    release(near, signed, one, met, sets, placed)
    return simhash.keep_first(docs, kept, id_col)
