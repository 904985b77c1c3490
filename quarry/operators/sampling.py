"""Reproducible samples and splits: the order is that of a hash of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.tables import small


def order(seed: str, key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.sha1(F.concat(F.lit(seed), key.cast("string")).cast("binary"))


def group_split(rows: DataFrame, group: str, seed: str, cuts: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """Adds split; all rows of a group get the same. Groups are laid out in hash order and cut at shares of the rows.

    The running total over groups goes by ranges of the hash: totals of 256 ranges first, then within each range.
    """
    g = rows.groupBy(group).agg(F.count("*").alias("k")).withColumn("h", order(seed, group)).withColumn("range", F.left("h", F.lit(2)))
    ranges = g.groupBy("range").agg(F.sum("k").alias("t"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over 256 rows at most
    ranges = ranges.select("range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("before"), F.sum("t").over(Window.partitionBy()).alias("total"))
    g = g.join(F.broadcast(ranges), "range").withColumn("upto", F.col("before") + F.sum("k").over(Window.partitionBy("range").orderBy("h")))
    share = F.col("upto") / F.col("total")
    split = F.when(share <= cuts[0], "train").when(share <= cuts[1], "dev").otherwise("test")
    return rows.join(g.select(group, split.alias("split")), group)


def balance_errors(rows: DataFrame, group: str, kind: str, seeds: int, cuts: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """(seed, error): for each of so many seeds, how far the counts of kinds in its group split are from their shares."""
    g = rows.groupBy(group, kind).agg(F.count("*").alias("n"))
    sizes = g.groupBy(group).agg(F.sum("n").alias("k"))
    tries = rows.sparkSession.range(seeds).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("seed"))
    s = sizes.crossJoin(F.broadcast(tries)).withColumn("h", F.sha1(F.concat("seed", F.col(group).cast("string")).cast("binary"))).withColumn("range", F.left("h", F.lit(2)))
    ranges = s.groupBy("seed", "range").agg(F.sum("k").alias("t"))
    w = Window.partitionBy("seed").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over 256 rows at most
    ranges = ranges.select("seed", "range", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("before"), F.sum("t").over(Window.partitionBy("seed")).alias("total"))
    s = s.join(ranges, ["seed", "range"]).withColumn("upto", F.col("before") + F.sum("k").over(Window.partitionBy("seed", "range").orderBy("h", group)))
    share = F.col("upto") / F.col("total")
    s = s.select("seed", group, F.when(share <= cuts[0], "train").when(share <= cuts[1], "dev").otherwise("test").alias("split"))
    counts = s.join(g, group).groupBy("seed", "split", kind).agg(F.sum("n").alias("n"))
    parts = {"train": cuts[0], "dev": cuts[1] - cuts[0], "test": 1 - cuts[1]}
    wanted = g.groupBy(kind).agg(F.sum("n").alias("total")).crossJoin(F.broadcast(tries)).select("seed", kind, "total", F.explode(F.array(*(F.struct(F.lit(k).alias("split"), F.lit(v).alias("part")) for k, v in parts.items()))).alias("p"))
    both = wanted.select("seed", kind, "p.split", (F.col("total") * F.col("p.part")).alias("want")).join(counts, ["seed", "split", kind], "left")
    return both.groupBy("seed").agg(F.round(F.sum(F.abs(F.coalesce("n", F.lit(0)) - F.col("want"))), 4).alias("error"))


def best_split(rows: DataFrame, group: str, kind: str, seeds: int) -> DataFrame:
    """The group split of the seed with the smallest balance error (ties: the first by name)."""
    best = balance_errors(rows, group, kind, seeds).orderBy("error", "seed").first()
    return group_split(rows, group, best.seed if best else "s0")


def pilot(rows: DataFrame, group: str, kind: str, key: str, seed: str, n: int, kinds: int) -> DataFrame:
    """n rows, one of a group at most: n / kinds of each kind by hash order, then whatever comes first among the rest."""
    by = (order(seed, key), key)
    one = rows.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where("k = 1").drop("k")
    one = one.withColumn("k", F.row_number().over(Window.partitionBy(kind).orderBy(*by))).where(F.col("k") <= n)  # one past the nth of its kind is never among the first n
    return one.withColumn("topped_up", F.col("k") > n // kinds).drop("k").orderBy("topped_up", *by).limit(n)


def manifest(splits: DataFrame, group: str, kind: str, key: str, seed: str) -> DataFrame:
    """(split, n, n_groups, kinds, digest, seed, disjoint): what a split holds, with a digest that no order changes."""
    own = splits.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct(group).alias("n_groups"), F.bit_xor(F.conv(F.left(F.md5(F.col(key).cast("string").cast("binary")), F.lit(15)), 16, 10).cast("long")).alias("digest"))
    kinds = splits.groupBy("split", kind).agg(F.count("*").alias("n")).groupBy("split").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", kind, F.col("n").cast("string")))), ",").alias("kinds"))
    shared = splits.groupBy(group).agg(F.countDistinct("split").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    out = own.join(kinds, "split").crossJoin(F.broadcast(shared))
    return out.select("split", "n", "n_groups", "kinds", "digest", F.lit(seed).alias("seed"), (F.col("most") <= 1).alias("disjoint"))


def drifted(now: DataFrame, before: DataFrame) -> DataFrame:
    """Splits whose digest isn't the one of an earlier manifest, or that only one of the two has."""
    both = now.select("split", F.col("digest").alias("now")).join(before.select("split", F.col("digest").alias("before")), "split", "full")
    return both.where(~F.col("now").eqNullSafe(F.col("before")))


def unchanged(now: DataFrame, before: DataFrame) -> DataFrame:
    """The manifest, if no split has drifted from the earlier one; else an error when it is read."""
    bad = drifted(now, before).agg(F.array_join(F.array_sort(F.collect_list("split")), ", ").alias("bad"))
    fine = bad.select(F.when(F.col("bad") == "", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("splits differ from their manifest: "), "bad"))).alias("fine"))
    return now.crossJoin(F.broadcast(fine)).where("fine").drop("fine")


def indexed(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The first n rows by an order, with their index from 0."""
    return rows.orderBy(*by).limit(n).withColumn("index", F.row_number().over(Window.orderBy(*by)) - 1)  # over n rows


def weak_and_strong(judged: DataFrame, n_weak: int, n_strong: int) -> DataFrame:
    """(case_id, score, kind): the lowest scores up to 2, and the highest from 4 on."""
    low = judged.where("score <= 2").orderBy("score", "case_id").limit(n_weak).withColumn("kind", F.lit("failure"))
    return low.unionByName(judged.where("score >= 4").orderBy(F.desc("score"), "case_id").limit(n_strong).withColumn("kind", F.lit("success")))


def hard_cases(judged: DataFrame, kind: str, n: int, n_cheap: int = 4) -> DataFrame:
    """The weakest case of each kind in turn, n in all, then the cheapest full scores: judged (case_id, kind, score, recall, tokens)."""
    weakest = ("score", "recall", F.desc("tokens"), "case_id")
    hard = judged.withColumn("turn", F.row_number().over(Window.partitionBy(kind).orderBy(*weakest))).where(F.col("turn") <= n).orderBy("turn", *weakest).limit(n).withColumn("why", F.lit("hard"))
    cheap = judged.where("score >= 4").orderBy("tokens", "case_id").limit(n_cheap).select("*", F.lit(0).alias("turn"), F.lit("cheap").alias("why"))
    return hard.unionByName(cheap.join(hard.select("case_id"), "case_id", "left_anti").select(*hard.columns))


def round_robin(rows: DataFrame, group: str, key: str, seed: str, n: int) -> DataFrame:
    """n rows, one of each group in turn, while groups last."""
    w = Window.partitionBy(group).orderBy(order(seed, key), key)
    return rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def quota(rows: DataFrame, group: str, key: str, seed: str, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order(seed, key), key)
    return rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)


def verbatim(docs: DataFrame, items: DataFrame, block: int = 2000) -> DataFrame:
    """(doc_id, item_id) of items (item_id, text) that a document (doc_id, text) contains.

    Blocked on an item's longest inner word, which stands whole in a document too, then checked. Items of fewer than
    three words have none: they are looked for in every document, a broadcast block at a time.
    """
    split = lambda c: F.split(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), " ")
    b = items.select("item_id", F.col("text").alias("item"), split("text").alias("words"))
    inner = F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(1)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    b = b.select("item_id", "item", F.when(F.size("words") >= 3, longest).alias("w"))
    long, short = b.where("w is not null"), b.where("w is null and item is not null").select("item_id", "item")
    hits = docs.select("doc_id", F.explode(F.array_distinct(split("text"))).alias("w")).join(small(long.select("w").distinct()), "w", "left_semi").join(long.select("w", "item_id"), "w")
    out = hits.join(docs, "doc_id").join(long.select("item_id", "item"), "item_id").where(F.col("text").contains(F.col("item"))).select("doc_id", "item_id")
    n = -(-short.count() // block)
    for i in range(n):
        some = short.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(n)) == i)
        out = out.unionByName(docs.join(F.broadcast(some), F.col("text").contains(F.col("item"))).select("doc_id", "item_id"))
    return out.distinct()
