"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats, squeezed

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(squeezed(F.col("text"), F.col("kept")), 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_trie import encode

    out = encode(_table(spark, sf_dir, "documents"), with_decoded=True)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    out = near_vectors(_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold
    from .language_id import predict, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, F.coalesce(fold("doc_id", 5) != 0, F.lit(True)))
    return predict(docs, model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold
    from .lm_trie import train_and_score

    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    out = train_and_score(_table(spark, sf_dir, "documents"), ~held_out, min_count=1)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold
    from .quality_pu import score, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .grammar_store import new_store, read_store

    out = read_store(spark, new_store(_table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_packing, op3_exact_topk, op4_bpe_trie, op5_embedding_dedup, op6_language_id, op7_lm_trie, op8_quality_pu, op9_repair_store, op10_simhash)}

ORACLE_SQL = {
    "op3_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35),
        h AS (SELECT doc_id, s, sha256(array_to_string(w[s : s + 34], ' ')) AS k FROM p),
        r AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
        g AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 35)))) AS gone FROM r GROUP BY doc_id),
        a AS (SELECT d.doc_id, d.w, g.gone FROM d LEFT JOIN g ON d.doc_id = g.doc_id),
        i AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
        m AS (SELECT DISTINCT doc_id, unnest(gone) AS j FROM g),
        k AS (SELECT i.doc_id, string_agg(i.word, ' ' ORDER BY i.j) AS kept FROM i ANTI JOIN m ON i.doc_id = m.doc_id AND i.j = m.j GROUP BY i.doc_id)
        SELECT a.doc_id, CAST(len(a.w) AS BIGINT) AS n_words, CAST(coalesce(len(a.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM a LEFT JOIN k ON a.doc_id = k.doc_id""",
    "op5_embedding_dedup": """
        WITH RECURSIVE u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a""",
}
