"""Reproducible splits: length order, groups of ten, edit-distance ranks, train / dev / test."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def length_ordered(df: DataFrame, text: str, key: str, task_rows: int = 1_000_000, pieces: int = 256) -> DataFrame:
    """Adds pos (from 0) in order of length, then key; null lengths and keys come first, and the order of rows with equal keys is open.

    Positions come from counts. A length of over `task_rows` rows is cut into ranges of keys, at the keys whose hash falls into one of
    count / pieces classes: some `pieces` of them however many rows there are, and the same whenever a task runs again.
    """
    sized = df.withColumn("_len", F.coalesce(F.length(text), F.lit(-1)))
    common = sized.groupBy("_len").agg(F.count("*").alias("_n")).where(F.col("_n") > task_rows)
    chosen = F.pmod(F.xxhash64(key), F.greatest(F.ceil(F.col("_n") / pieces), F.lit(1))) == 0
    cuts = sized.join(common, "_len").where(chosen).groupBy("_len").agg(F.array_sort(F.collect_set(key)).alias("_cuts"))
    # The number of cuts at or below the key, 0 for null keys and lengths without cuts.
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(key))), F.lit(0))
    placed = sized.join(cuts, "_len", "left").withColumn("_part", F.greatest(part, F.lit(0))).drop("_cuts")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_len", "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_len", "_part").agg(F.count("*").alias("_n")).select("_len", "_part", before.alias("_before"))
    ranked = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_len", "_part").orderBy(key)) - 1)
    return ranked.join(starts, ["_len", "_part"]).withColumn("pos", F.col("_before") + F.col("_rn")).drop("_len", "_part", "_before", "_rn")


def grouped(df: DataFrame, size: int = 10) -> DataFrame:
    return df.withColumn("grp", F.floor(F.col("pos") / size).cast("long"))


def distance_sums(df: DataFrame, text: str, key: str) -> DataFrame:
    """(grp, key, dist): sum of edit distances to the other rows of the group; groups have a fixed small size."""
    a = df.select("grp", F.col(key).alias("a"), F.col(text).alias("ta"))
    b = df.select("grp", F.col(key).alias("b"), F.col(text).alias("tb"))
    pairs = a.join(b, "grp").where("a < b").withColumn("d", F.levenshtein("ta", "tb"))
    both = pairs.select("grp", F.explode(F.array("a", "b")).alias(key), "d")
    return both.groupBy("grp", key).agg(F.sum("d").alias("dist"))


def ranked(df: DataFrame, text: str, key: str) -> DataFrame:
    """Adds dist and rank (from 1) within the group by distance, key, text."""
    out = df.join(distance_sums(df, text, key), ["grp", key], "left").na.fill(0, ["dist"])
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy("dist", key, text)))


def die_of(groups: int, seed: int = 32) -> list[int]:
    """A die for each group, from CPython's generator; for corpora whose number of groups fits the driver."""
    rng = random.Random(seed)
    return [rng.randint(1, 10) for _ in range(groups)]


def assigned(df: DataFrame, size: int = 10, seed: int = 32, remainder: str = "train") -> DataFrame:
    """Adds split: ranks up to 8 train; 9 and 10 dev and test, swapped where the group's die is over 5.

    The die is a hash of group and seed. Rows of short groups go to `remainder`, or away if it is "drop".
    """
    die = F.pmod(F.xxhash64("grp", F.lit(seed)), F.lit(10)) + 1
    full = F.count("*").over(Window.partitionBy("grp")) == size
    low = F.col("rank") == size - 1
    split = F.when(~full, remainder).when(F.col("rank") <= size - 2, "train").when(low == (die <= 5), "dev").otherwise("test")
    out = df.withColumn("split", split)
    return out.where("split <> 'drop'") if remainder == "drop" else out


def assigned_small(df: DataFrame, size: int = 10, seed: int = 32) -> DataFrame:
    """Rule of small corpora: in a full group four train; of six shuffled ones three dev and three test; short groups train."""
    full = F.count("*").over(Window.partitionBy("grp")) == size
    out = df.withColumn("_s", F.row_number().over(Window.partitionBy("grp", F.col("rank") > 4).orderBy(F.xxhash64("rank", "grp", F.lit(seed)))))
    return out.withColumn("split", F.when(~full | (F.col("rank") <= 4), "train").when(F.col("_s") <= 3, "dev").otherwise("test")).drop("_s")


def longest(df: DataFrame, n: int) -> DataFrame:
    """The n last rows of length order."""
    return df.orderBy(F.desc("pos")).limit(n)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key)
