"""Aggregations over scores: summaries, scopes, pivots, confusion, contingency, quartiles, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, by: str, status: str, f1: str, statuses: list[str]) -> DataFrame:
    ok = F.col(status) == "success"
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_success"), (F.count_if(ok) * 100.0 / F.count("*")).alias("success_pct"),
        F.avg(F.when(ok, F.col(f1))).alias("mean_f1"), F.median(F.when(ok, F.col(f1))).alias("median_f1"), F.avg(F.when(ok, F.col(f1)).otherwise(0.0)).alias("penalised_f1"),
        *(F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses),
    )


def summary_as_seen(df: DataFrame, by: str, status: str, f1: str, order: str) -> DataFrame:
    """place, n, success_pct, mean_f1 and median_f1 of each condition, placed from 1 as first seen in `order`; one row `<all>` if df has no column `by`."""
    known = df if by in df.columns else df.withColumn(by, F.lit("<all>"))
    first = known.groupBy(by).agg(F.min(order).alias("_first"))
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("_first"))).drop("_first")  # a row for each condition
    return summary(known, by, status, f1, []).select(by, "n", "success_pct", "mean_f1", "median_f1").join(placed, by)


def scopes(df: DataFrame, by: str, status: str, f1: str, ignored: str = "gold_error") -> DataFrame:
    """Mean F1 of successes (a), with failures as 0 but `ignored` left out (b), with all else as 0 (c)."""
    ok = F.col(status) == "success"
    return df.groupBy(by).agg(F.avg(F.when(ok, F.col(f1))).alias("f1_a"), F.avg(F.when(ok, F.col(f1)).when(F.col(status) != ignored, 0.0)).alias("f1_b"), F.avg(F.when(ok, F.col(f1)).otherwise(0.0)).alias("f1_c"))


def failure_shares(df: DataFrame, by: str, status: str, left_out: list[str]) -> DataFrame:
    n = df.where(~F.col(status).isin(left_out)).groupBy(by, status).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def delta_to(df: DataFrame, item: str, by: str, value: str, base: str | DataFrame) -> DataFrame:
    """Mean paired difference of each condition to the base, over items that have both. The base is a name, or a table of one row (base)."""
    mean = df.groupBy(item, by).agg(F.avg(value).alias("v"))
    own = mean.where(F.col(by) == base) if isinstance(base, str) else mean.join(F.broadcast(base), F.col(by) == F.col("base"), "left_semi")
    own = own.select(item, F.col("v").alias("base"))
    return mean.join(own, item).groupBy(by).agg(F.avg(F.col("v") - F.col("base")).alias("mean_delta"), F.count("*").alias("n_pairs"))


def confusion(predicted: Column, actual: Column) -> list[Column]:
    """Counts and ratios with zero guards, for agg()."""
    tp, fp, fn, tn = (F.count_if(c) for c in (predicted & actual, predicted & ~actual, ~predicted & actual, ~predicted & ~actual))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), rate(tp + tn, tp + fp + fn + tn).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall")]


def index_quartiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """Values at positions n/4, n/2 and 3n/4 of the sorted values (not interpolated), and the mean."""
    # Equal values are counted first, so a group's task holds its distinct values only.
    counts = df.groupBy(by, value).agg(F.count("*").alias("_k"))
    each = Window.partitionBy(by)
    placed = counts.withColumns({"_upto": F.sum("_k").over(each.orderBy(value)), "_n": F.sum("_k").over(each)})
    at = lambda k: F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * k / 4), F.col(value)))
    return placed.groupBy(by).agg(at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"), (F.sum(F.col(value) * F.col("_k")) / F.sum(F.when(F.col(value).isNotNull(), F.col("_k")))).alias("mean"))


def bins(value: Column, edges: list[int]) -> Column:
    """(low, high] labels; null outside."""
    out = None
    for a, b in zip(edges, edges[1:]):
        case = (value > a) & (value <= b)
        out = F.when(case, f"({a}, {b}]") if out is None else out.when(case, f"({a}, {b}]")
    return out


def contingency(df: DataFrame, klass: str, features: list[str]) -> DataFrame:
    """Share of each class that has each feature: (class, feature, share)."""
    long = df.select(klass, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("has")) for f in features))).alias("_f"))
    return long.groupBy(klass, F.col("_f.feature").alias("feature")).agg(F.avg("_f.has").alias("share"))


def multiset_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Per doc_id: sizes of both multisets and of their intersection, with precision, recall and F."""
    count = lambda d, n: d.groupBy(*keys).agg(F.count("*").alias(n))
    both = count(left, "a").join(count(right, "b"), keys, "full_outer").na.fill(0, ["a", "b"])
    sums = both.groupBy("doc_id").agg(F.sum(F.least("a", "b")).alias("matched"), F.sum("a").alias("n_pred"), F.sum("b").alias("n_gold"))
    return with_f(sums)


def with_f(sums: DataFrame) -> DataFrame:
    """Precision, recall and F from matched, n_pred and n_gold, with zero guards."""
    p, r = (F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col(c)), F.lit(0.0)) for c in ("n_pred", "n_gold"))
    return sums.withColumns({"precision": p, "recall": r}).withColumn("f", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
