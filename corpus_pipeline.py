"""Corpus pipeline: quality classifier, language ID, near-dedup by shingles, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows
with a null id are kept where a stage can't compare them. An empty table passes through as an empty table.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm import language_id, packing, quality_pu, simhash_sets, substring_dedup
from lexigraph.llm.common import fold, marked, marks, materialize, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_pu.train(docs, labels, fold("doc_id", 5) != 0)
    return quality_pu.score(docs, model, keep=COLUMNS[1:]).where("score >= 0.3").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised: not `und`, and a score that isn't on the side of all other languages."""
    model = language_id.train(docs, fold("doc_id", 5) != 0)
    found = language_id.predict(docs, model, keep=COLUMNS[1:])
    return found.where("lang_pred <> 'und' AND lang_score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by a similarity of 0.8 or more in 5-word shingles: the one with the smallest id.

    SimHash with wide fingerprints, verified on whole sets (see simhash_sets). Rows, not ids, are grouped: of rows with one id only similar ones go, and a row with a null id stays if its group has no other.
    """
    if docs.schema["doc_id"].dataType.simpleString() == "bigint" and not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null or doc_id < 0").limit(1).count():
        rows = docs.select(*COLUMNS, F.col("doc_id").alias("row"))
    else:  # rows need a name of their own, which must stay the same when a task runs again
        rows = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "pipeline-rows")
    tied = simhash_sets.groups(rows.select("row", F.col("text").cast("string").alias("text")))
    known = tied.join(rows.select("row", "doc_id"), "row")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = known.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("component", F.col("first.row").alias("row"))
    goes = materialize(known.join(first.select("component", F.col("row").alias("stays")), "component").where("row <> stays").select("row"), "pipeline-goes")
    # Rows without the mark of one that goes pass by the shuffle.
    at = materialize(marks(goes, "row"), "pipeline-marks")
    return marked(rows, at, "row", others=True).unionByName(marked(rows, at, "row").join(goes, "row", "left_anti")).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 35 words that occur more than once; untouched texts stay as they are."""
    cut = substring_dedup.remove_repeats(docs, keep=COLUMNS[2:])
    n_chars = F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType)
    return cut.select("doc_id", F.coalesce("kept", "text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, one sequence each."""
    return packing.pack(docs)



def _ready(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [("quality", _ready(quality)), ("language", _ready(language)), ("near_duplicates", _ready(near_duplicates)), ("repeated_passages", _ready(repeated_passages)), ("packing", _ready(pack))]

#: Hashes, models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
