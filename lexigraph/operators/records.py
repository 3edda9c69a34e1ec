"""Record operators: validation, unpivot, overrides, keyed unions and updates, duplicates, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_reasons(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds `reasons`: names of the checks that a row fails, in order."""
    return df.withColumn("reasons", F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull()))


def unpivot(df: DataFrame, key: str, columns: dict[str, str], label: str = "condition", value: str = "value") -> DataFrame:
    """(key, label, value) for each non-blank cell; `columns` maps column names to labels."""
    long = df.select(key, F.explode(F.array(*(F.struct(F.lit(name).alias(label), F.col(c).cast("string").alias(value)) for c, name in columns.items()))).alias("_c"))
    return long.select(key, f"_c.{label}", f"_c.{value}").where(F.trim(value) != "")


def chat(prompt: Column, reply: Column) -> Column:
    role = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.array(role("user", prompt), role("assistant", reply))


def add_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit("") for c in columns if c not in df.columns})


def override(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """df with `column` taken from changes (key, value) where given. Changes must have one row a key."""
    return df.join(changes.select(key, F.col("value").alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def bad_overrides(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Changes whose key doesn't occur exactly once in df, or that change nothing."""
    found = df.groupBy(key).agg(F.count("*").alias("n"), F.first(column).alias("old"))
    return changes.join(found, key, "left").where("n is null or n <> 1 or old <=> value").select(key, "value")


def first_of_each(df: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each text."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("_n = 1").drop("_n")


def union_by_precedence(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of all frames; of one key the row of the last frame wins."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_p", F.lit(i))
        out = f if out is None else out.unionByName(f)
    cols = [c for c in frames[0].columns if c != key]
    return out.groupBy(key).agg(F.max_by(F.struct(*cols), "_p").alias("_r")).select(key, "_r.*")


def positional(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Line by line; nothing if the sides differ in length. Lines come numbered from 0 by their source."""
    sizes = left.agg(F.count("*").alias("a")), right.agg(F.count("*").alias("b"))
    same = sizes[0].join(sizes[1], F.col("a") == F.col("b")).select(F.lit(True).alias("_ok"))
    joined = left.join(right.withColumnRenamed("text", "other"), order).withColumn("_ok", F.lit(True))
    return joined.join(F.broadcast(same), "_ok", "left_semi").drop("_ok")  # one row


def not_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(done.select(*keys), keys, "left_anti")


def coalesce_source(own: DataFrame, main: DataFrame, key: str, value: str, special: Column) -> DataFrame:
    """own with `value` from main by key, unless the row is special or main lacks it."""
    return own.join(main.select(key, F.col(value).alias("_main")), key, "left").withColumn(value, F.when(special | F.col("_main").isNull(), F.col(value)).otherwise(F.col("_main"))).drop("_main")


def renamed(df: DataFrame, names: dict[str, str], dropped: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed and dropped; what isn't there is passed over."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns}).drop(*(c for c in dropped if c in df.columns))


def blank_nulls(df: DataFrame) -> DataFrame:
    """Nulls of string columns become empty strings."""
    return df.na.fill("")


def present(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that df has, in their order; callers pass over the others."""
    return [c for c in columns if c in df.columns]
