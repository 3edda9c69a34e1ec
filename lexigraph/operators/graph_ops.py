"""Graph operators on DataFrames: the per-document kernels in Arrow batches, relational work as joins."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import alignment, graphs, vocab

NODES = "doc_id string, node_type string, node_idx int, token string, lemma string, pos string, sense string, comment string, ord int"
EDGES = "doc_id string, src_type string, src_idx int, dst_type string, dst_idx int, edge_type string, token string, ord int"


def _flat(records: DataFrame, schema: str, rows_of, id_col: str, text_col: str) -> DataFrame:
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[c.strip().split()[1]] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            out = [r for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in rows_of(i, s)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names)

    return records.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def _widened(df: DataFrame, columns: list[str], found, schema: str) -> DataFrame:
    """df with further columns: found(values of `columns`) gives those of a row."""
    kinds = {"string": (pa.string(), T.StringType()), "int": (pa.int32(), T.IntegerType())}
    more = [c.split() for c in schema.split(",")]
    at, names = [df.columns.index(c) for c in columns], [*df.columns, *(n for n, _ in more)]

    def run(batches):
        for batch in batches:
            out = [found(*row) for row in zip(*(batch.column(k).to_pylist() for k in at))]
            added = [pa.array(c, kinds[t][0]) for c, (_, t) in zip(zip(*out) if out else [[]] * len(more), more)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    whole = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    for name, kind in more:
        whole = whole.add(name, kinds[kind][1])
    return df.mapInArrow(run, whole)


def _graph(text):
    try:
        return graphs.parse(text or "")
    except graphs.NotationError:
        return None


def nodes(records: DataFrame, id_col: str = "id", text_col: str = "sbn") -> DataFrame:
    """Node rows of every record that parses."""

    def rows(i, text):
        g = _graph(text)
        return [(i, n[0], n[1], v.get("token"), v.get("lemma"), v.get("pos"), v.get("sense"), v.get("comment"), k) for k, (n, v) in enumerate(g.nodes.items())] if g else []

    return _flat(records, NODES, rows, id_col, text_col)


def edges(records: DataFrame, id_col: str = "id", text_col: str = "sbn", projected: bool = False) -> DataFrame:
    """Edge rows of every record that parses, optionally after repair projection."""

    def rows(i, text):
        g = _graph(text)
        g = graphs.project(g) if g and projected else g
        return [(i, a[0], a[1], b[0], b[1], kind, token, k) for k, ((a, b), (kind, token)) in enumerate(g.edges.items())] if g else []

    return _flat(records, EDGES, rows, id_col, text_col)


def statuses(records: DataFrame, id_col: str = "id", text_col: str = "sbn", strict: bool = True) -> DataFrame:
    """(id, status, penman)."""
    return _flat(records, f"{id_col} string, status string, penman string", lambda i, s: [(i, *graphs.status_of(s, strict))], id_col, text_col)


def penmans(records: DataFrame, texts: dict[str, str], strict: bool = True) -> DataFrame:
    """records with the Penman text of several columns of notation, {new column: column}; null where there is none."""
    return _widened(records, list(texts.values()), lambda *row: [graphs.status_of(s, strict)[1] for s in row], ", ".join(f"{n} string" for n in texts))


def triple_rows(penmans: DataFrame, id_col: str = "id", text_col: str = "penman") -> DataFrame:
    """(doc_id, kind, rel, a, b)."""

    def rows(i, text):
        return [(i, kind, *t) for kind, ts in zip(("instance", "attribute", "relation"), alignment.triples(text or "")) for t in ts]

    return _flat(penmans, "doc_id string, kind string, rel string, a string, b string", rows, id_col, text_col)


def upright_edges(e: DataFrame) -> DataFrame:
    """Inverse role edges between non-constants turned round; parallel edges collapse to the last one, turned ones count as later than others."""
    turn = (F.col("edge_type") == "role") & F.col("token").isin(vocab.INVERTIBLE_ROLES) & (F.col("src_type") != "constant") & (F.col("dst_type") != "constant")
    pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a)
    out = e.select("doc_id", pick("src_type", "dst_type"), pick("src_idx", "dst_idx"), pick("dst_type", "src_type"), pick("dst_idx", "src_idx"), "edge_type", F.when(turn, F.expr("substring(token, 1, length(token) - 2)")).otherwise(F.col("token")).alias("token"), "ord", turn.alias("turned"))
    key = ["doc_id", "src_type", "src_idx", "dst_type", "dst_idx"]
    return out.groupBy(*key).agg(F.max_by(F.struct("edge_type", "token"), F.struct("turned", "ord")).alias("last"), F.min("ord").alias("ord")).select(*key, "last.edge_type", "last.token", "ord")


def orphan_constants(n: DataFrame, e: DataFrame) -> DataFrame:
    used = e.where("dst_type = 'constant'").select("doc_id", F.col("dst_idx").alias("node_idx"))
    return n.where("node_type = 'constant'").join(used, ["doc_id", "node_idx"], "left_anti")


def repair_pairs(e: DataFrame) -> DataFrame:
    """(doc_id, parent, correction, conjunction) of sibling boxes."""
    link = e.where("edge_type = 'box-box-connect'")
    side = lambda token, name: link.where(F.col("token") == token).select("doc_id", F.col("src_idx").alias("parent"), F.col("dst_idx").alias(name))
    return side("CORRECTION", "correction").join(side("CONJUNCTION", "conjunction"), ["doc_id", "parent"])


def score_frame(pred: DataFrame, gold: DataFrame, key: str = "id", pred_col: str = "pred_sbn", gold_col: str = "sbn", solver: str = "exact", order: str | None = None) -> DataFrame:
    """pred with status and f1. Each distinct gold text is parsed once; gold errors come before those of predictions.

    Of several gold rows of a key the last one in `order` counts; without an order, the greatest text.
    """
    last = F.max_by(gold_col, order) if order else F.max(gold_col)
    golds = statuses(gold.groupBy(key).agg(last.alias("g")), key, "g").select(key, F.col("status").alias("gold_status"), F.col("penman").alias("gold_penman"))
    numbered = pred.withColumn(key, F.col(key).cast("string"))
    parsed = statuses(pred.select(F.col(pred_col).alias("t")).distinct(), "t", "t").select(F.col("t").alias(pred_col), F.col("status").alias("pred_status"), F.col("penman").alias("pred_penman"))
    both = numbered.join(golds, key, "left").join(parsed, pred_col, "left")
    pairs = both.where("gold_status = 'success' AND pred_status = 'success'").select("pred_penman", "gold_penman").distinct().select(F.to_json(F.struct("pred_penman", "gold_penman")).alias("pair"))

    def rows(pair, _):
        x = json.loads(pair)
        try:
            p, r, f, used = alignment.score(x["pred_penman"], x["gold_penman"], solver)
            return [(x["pred_penman"], x["gold_penman"], "success", f, used)]
        except (RecursionError, ValueError, IndexError):
            return [(x["pred_penman"], x["gold_penman"], "smatch_error", None, None)]

    scored = _flat(pairs, "pred_penman string, gold_penman string, score_status string, f1 double, solver string", rows, "pair", "pair")
    out = both.join(scored, ["pred_penman", "gold_penman"], "left")
    status = F.when(F.coalesce(F.col("gold_status"), F.lit("")) != "success", "gold_error").when(F.coalesce(F.col("pred_status"), F.lit("parse_error")) != "success", F.coalesce("pred_status", F.lit("parse_error"))).otherwise(F.coalesce("score_status", F.lit("smatch_error")))
    return out.select(*numbered.columns, status.alias("status"), "f1", "solver")


def numbered_values(triples: DataFrame) -> DataFrame:
    """Adds the ordinal of each repeated triple value, for multiset comparison."""
    return triples.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "kind", "rel", "b").orderBy("a")))


def aligned(pairs: DataFrame, left: str = "a", right: str = "b", solver: str = "exact") -> DataFrame:
    """pairs of Penman texts with matched, n_pred, n_gold and the printed alignment; sums of the counts give corpus scores (analytics.with_f).

    A null text is a graph without triples. Pairs are compared where they lie, without a shuffle.
    """

    def found(a, b):
        return alignment.compared(alignment.triples(a or ""), alignment.triples(b or ""), solver)

    return _widened(pairs, [left, right], found, "matched int, n_pred int, n_gold int, alignment string")


def aligned_lists(pairs: DataFrame, solver: str = "exact") -> DataFrame:
    """Rows (key, matched, n_pred, n_gold) of rows (key, pred, gold): both sides are structs of arrays `triples` (rel, a, b) and `concepts` (var, concept)."""

    def rows(key, both):
        x = json.loads(both)
        sides = [alignment.listed([(t["rel"], t["a"], t["b"]) for t in s.get("triples", ())], {c["var"]: c["concept"] for c in s.get("concepts", ())}) for s in (x["pred"], x["gold"])]
        return [(key, *alignment.compared(*sides, solver)[:3])]

    return _flat(pairs.select("key", F.to_json(F.struct("pred", "gold")).alias("both")), "key string, matched int, n_pred int, n_gold int", rows, "key", "both")
