"""Sinks: blocks, tables by extension, JSON, partitioned output, appends that can resume, DOT and Markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_text(*columns: str) -> Column:
    return F.concat_ws("\n", *columns)


def write_blocks(records: DataFrame, path: str, one_file: bool = True) -> None:
    """id, sentence and sbn lines with a blank line after each record."""
    out = records.select(block_text("id", "sentence", "sbn").alias("value"))
    (out.coalesce(1) if one_file else out).write.option("lineSep", "\n\n").text(path)


def write_table(df: DataFrame, path: str) -> None:
    if path.endswith((".tsv", ".csv")):
        df.write.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").option("escape", '"').csv(path)
    else:
        df.write.parquet(path)


def write_unquoted(df: DataFrame, path: str) -> None:
    """Tab-separated without quotes; a backslash escapes."""
    df.write.option("header", True).option("sep", "\t").option("quote", "").option("escape", "\\").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_json_array(df: DataFrame, path: str, indent: bool = True) -> None:
    """One JSON array in one file, in the rows' order; for exports that fit a task."""
    one = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1)
    row = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
    n = one.withColumns({"_n": row, "_all": F.count("*").over(Window.partitionBy())})
    text = F.concat(F.when(F.col("_n") == 1, "[\n").otherwise(""), F.lit("  " if indent else ""), "value", F.when(F.col("_n") == F.col("_all"), "\n]").otherwise(","))
    n.orderBy("_n").select(text.alias("value")).coalesce(1).write.text(path)


def write_each(df: DataFrame, path: str, key: str, text: str) -> None:
    """A folder for each key with the text as a file."""
    df.select(F.regexp_replace(F.col(key).cast("string"), "/", "_").alias("key"), F.col(text).alias("value")).write.partitionBy("key").text(path)


def write_partitioned(df: DataFrame, path: str, column: str) -> None:
    df.write.partitionBy(column).parquet(path)


def append_new(done_path: str, rows: DataFrame, keys: list[str]) -> None:
    """Append the rows whose keys aren't in done_path yet."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(done_path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    (rows.join(done, keys, "left_anti") if done is not None else rows).write.mode("append").parquet(done_path)


def dot_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, dot): Graphviz text of each graph; a repeated label gets -k."""
    name = lambda t, i: F.concat(t, F.lit("_"), i)
    label = F.replace("token", F.lit('"'), F.lit("'"))
    again = F.row_number().over(Window.partitionBy("doc_id", label).orderBy("ord")) - 1
    nodes = nodes.withColumn("token", F.when(again > 0, F.concat(label, F.lit("-"), again.cast("string"))).otherwise(label))
    n = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.format_string('  %s [label="%s"];', name("node_type", F.col("node_idx").cast("string")), F.replace("token", F.lit('"'), F.lit("'"))))).alias("n"))
    e = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.format_string('  %s -> %s [label="%s"];', name("src_type", F.col("src_idx").cast("string")), name("dst_type", F.col("dst_idx").cast("string")), "token"))).alias("e"))
    return n.join(e, "doc_id", "left").select("doc_id", F.concat(F.lit("digraph {\n"), F.array_join(F.concat("n", F.coalesce("e", F.array())), "\n"), F.lit("\n}")).alias("dot"))


def markdown(df: DataFrame) -> str:
    """A report table; df is a small aggregate."""
    rows = [df.columns, ["---"] * len(df.columns), *([("" if v is None else str(v)) for v in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
