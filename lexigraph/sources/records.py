"""Sources: blocks of three lines, corpus folders, tables by extension, JSON lines, id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "sentence", "sbn")])


def chunks(files: DataFrame, column: str = "value") -> DataFrame:
    """Blank-line separated chunks of whole files: (file columns, chunk_idx, lines)."""
    text = F.replace(F.col(column), F.lit("\r\n"), F.lit("\n"))
    out = files.select(*[c for c in files.columns if c != column], F.posexplode(F.split(text, r"\n[ \t]*\n")).alias("chunk_idx", "_chunk"))
    return out.withColumn("lines", F.filter(F.transform(F.split("_chunk", "\n"), lambda x: F.trim(x)), lambda x: x != "")).where(F.size("lines") > 0)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def records_of(parts: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Records (id, sentence, sbn); FAILFAST raises on chunks that aren't three lines, other modes leave them out."""
    ok = F.size("lines") == 3
    if mode == "FAILFAST":
        parts = parts.withColumn("lines", F.when(ok, F.col("lines")).otherwise(F.raise_error(F.concat(F.lit("bad block: "), F.array_join("lines", " | ")))))
    else:
        parts = parts.where(ok)
    return parts.select(F.col("lines")[0].alias("id"), F.col("lines")[1].alias("sentence"), F.col("lines")[2].alias("sbn"), *[c for c in parts.columns if c in ("file", "chunk_idx")])


def warnings_of(parts: DataFrame, preview: int = 120) -> DataFrame:
    """Chunks that aren't three lines: (chunk_idx, line_count, preview)."""
    return parts.where(F.size("lines") != 3).select("chunk_idx", F.size("lines").alias("line_count"), F.substring(F.array_join("lines", "\n"), 1, preview).alias("preview"))


def read_blocks(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return records_of(chunks(read_files(spark, path)), mode)


def last_of_each_id(records: DataFrame, id_col: str = "id", order: str = "chunk_idx") -> DataFrame:
    """The last record of each id."""
    cols = [c for c in records.columns if c != id_col]
    return records.groupBy(id_col).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r")).select(id_col, "_r.*")


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Corpus folders {lang}/{tier}/pNN/dNNNN/{lang}.{raw,drs.sbn,met}: (lang, tier, id, kind, value)."""
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    pattern = r"/([a-z]{2})/([a-z]+)/(p\d+/d\d+)/[a-z]{2}\.(raw|drs\.sbn|met)$"
    return files.where(F.col("file").rlike(pattern)).select(*(F.regexp_extract("file", pattern, i).alias(n) for i, n in enumerate(("lang", "tier", "id", "kind"), 1)), "value")


def corpus_documents(files: DataFrame) -> DataFrame:
    """One row a document: raw on one line, multi-line notation, subcorpus (incident if its metadata starts with ID)."""
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("value")))
    out = files.groupBy("lang", "tier", "id").agg(pick("raw").alias("raw"), pick("drs.sbn").alias("sbn_multiline"), pick("met").alias("met"))
    return out.select("lang", "tier", "id", F.replace("raw", F.lit("\n"), F.lit(" ")).alias("raw"), "sbn_multiline", F.when(F.col("met").startswith("ID"), "incident").otherwise("pass").alias("subcorpus"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, TSV or CSV by extension; delimited columns are strings."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").option("inferSchema", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, renamed: dict[str, str] | None = None, multi_line: bool = False) -> DataFrame:
    df = spark.read.schema(schema).json(path, multiLine=multi_line)
    return df.withColumnsRenamed(renamed) if renamed else df


def markdown_ids(spark: SparkSession, path: str, begin: str, end: str) -> DataFrame:
    """Ids written as **pX/dY** between two headings."""
    part = F.substring_index(F.substring_index("value", begin, -1), end, 1)
    return spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all(part, F.lit(r"\*\*(p\d+/d\d+)\*\*"), F.lit(1))).alias("id"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def numbered_lines(spark: SparkSession, path: str, last_field: bool = False) -> DataFrame:
    """(line_no, text) of one file, in file order; optionally each line's last tab field."""
    text = F.element_at(F.split("_line", "\t"), -1) if last_field else F.col("_line")
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), "\r?\n")).alias("line_no", "_line")).select("line_no", text.alias("text"))


def chosen(documents: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Documents whose id is in a list."""
    return documents.join(ids.select(key), key, "left_semi")


def graph_lines(files: DataFrame) -> DataFrame:
    """(file columns, chunk_idx, text): blank-line separated graphs on one line each; lines that start with # go, chunks of nothing else too."""
    parts = chunks(files)
    kept = F.filter("lines", lambda x: ~x.startswith("#"))
    return parts.withColumn("text", F.array_join(kept, "")).where(F.size(kept) > 0).drop("lines", "_chunk")


def notation_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, sbn): one text of notation a file."""
    return read_files(spark, path).select("file", F.trim("value").alias("sbn"))
