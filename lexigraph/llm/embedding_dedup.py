"""Near-duplicate vectors within a label: random-hyperplane signs in several tables, exact cosine, components.

Vectors of one label that share a table's sign pattern meet; patterns grow with the number of vectors, and there are as many tables as make
the chance that a pair at the threshold meets in none at most `miss`. Tables hold ids and signs only: those that meet and differ in few enough of all
signs give closest neighbours and a spanning forest, never pairs. What is tied together is a cluster; its vectors are brought together once,
in block pairs, and every pair of a cluster whose cosine in double precision reaches the threshold links. Equal vectors of a label are one class, so
copies aren't compared with one another. Tables with over `group` vectors under one pattern tie them without comparing signs.

Null, empty or zero vectors, those with null or non-finite components, or with a null label or id
link with nothing: n_links 0 and themselves as component; vectors of different lengths don't link. Repeated ids are separate vectors for n_links and one node for
components. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, tidy
from .components import connected_components
from .pairing import Forest, by_unit, to_units, unit_ranges
from .simhash_sets import fingerprint_words, table_links

IDS = (1 << 62) - 1


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, tables * bits))


def usable(column: str):
    """Whether a vector has a direction."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def plan(vectors: int, threshold: float, miss: float) -> tuple[int, int, int]:
    """Bits of a table, tables, and the greatest number of differing signs that is verified."""
    bits = max(8, math.ceil(math.log2(max(vectors, 1))) - 8)
    differ = math.acos(threshold) / math.pi
    tables = math.ceil(math.log(miss) / math.log(1 - (1 - differ) ** bits))
    every = bits * tables
    return bits, tables, math.ceil(every * differ + 4.5 * math.sqrt(every * differ * (1 - differ)))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, miss: float = 2e-5, seed: int = 7, block: int = 1024, group: int = 4096) -> DataFrame:
    """Rows (id, n_links, component): one for each input row."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    good = rows.where(usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull())
    classes = good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # A vector that stands under two labels has a class in each; ids name classes together with the label and the length.
    classes = classes.withColumns({"cls": F.xxhash64("label", "rep", F.size("v")).bitwiseAND(F.lit(IDS)), "label_key": F.xxhash64("label")})
    classes = materialize(classes, "vector-classes")
    bits, tables, limit = plan(classes.count(), threshold, miss)

    def sign(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("v")
            size = lists.value_lengths().to_numpy()
            flat, at = lists.flatten().to_numpy(), np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                plane = made.setdefault(dim, planes(dim, tables, bits, seed))
                pick = np.flatnonzero(size == dim)
                x = flat[at[pick][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(1, keepdims=True)  # large components must not overflow
                signs = x @ plane > 0
                packed = np.zeros((len(pick), -(-bits * tables // 64) * 8), np.uint8)
                whole = np.packbits(signs, axis=1)
                packed[:, : whole.shape[1]] = whole
                sigs = pa.array([r.tobytes() for r in packed], pa.binary())
                code = signs.reshape(len(pick), tables, bits).astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
                label, cls = batch.column("label_key").to_numpy()[pick].view(np.uint64), batch.column("cls").take(pa.array(pick))
                for t in range(tables):
                    unit = mix64(mix64(label + np.uint64(t * 4096 + min(dim, 4095))) + code[:, t]) & np.uint64(IDS)
                    yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), cls, sigs], ["unit", "cls", "fp"])

    signed = classes.select("cls", "label_key", "v").mapInArrow(tidy(sign), "unit long, cls long, fp binary")

    def meet(table: pa.Table):
        unit, cls = table.column("unit").to_numpy(), table.column("cls").to_numpy()
        a, b = table_links(unit, np.arange(len(unit)), cls, fingerprint_words(table.column("fp")), limit, group, 0)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    edges = materialize(by_unit(signed, meet, "a long, b long", parts).distinct(), "vector-edges")
    clusters = connected_components(edges).where("node >= 0").select(F.col("node").alias("cls"), F.col("component").alias("cluster"))
    units = to_units(clusters, "cluster", "cls", block).select("unit", "cls", "side", "diagonal")
    units = units.join(classes.select("cls", "label_key", "copies", "v"), "cls")

    def run(table: pa.Table):
        unit = table.column("unit").to_numpy()
        cls, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
        label, side = table.column("label_key").to_numpy(), table.column("side").to_numpy()
        out_c, out_n, out_p = [], [], []
        diagonal = np.asarray(table.column("diagonal").to_numpy(zero_copy_only=False), bool)
        lists = table.column("v").combine_chunks()
        for a, b in unit_ranges(unit):
            of = lists.slice(a, b - a)
            size = of.value_lengths().to_numpy()
            x = np.zeros((b - a, int(size.max())))
            x[np.repeat(np.arange(b - a), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = of.flatten().to_numpy()
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            rows, cols = (np.arange(b - a),) * 2 if diagonal[a] else (np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1))
            forest, n = Forest(b - a), np.zeros(b - a, np.int64)
            lab, cop = label[a:b], copies[a:b]
            for c in range(0, len(rows), 256):
                r = rows[c : c + 256]
                near = x[r] @ x[cols].T >= threshold
                i, j = np.nonzero(near)
                i, j = r[i], cols[j]
                keep = (i < j) if diagonal[a] else np.ones(len(i), bool)
                keep &= (lab[i] == lab[j]) & (size[i] == size[j])
                i, j = i[keep], j[keep]
                np.add.at(n, i, cop[j])
                np.add.at(n, j, cop[i])
                forest.join(i, j)
            hit = np.flatnonzero(n)
            out_c.append(cls[a:b][hit])
            out_n.append(n[hit])
            out_p.append(cls[a:b][forest.root(np.arange(b - a))][hit])
        cat = lambda v: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([cat(out_c), cat(out_n), cat(out_p)], ["cls", "n", "root"])

    found = materialize(by_unit(units.select("unit", "label_key", "cls", "copies", "v", "side", "diagonal"), run, "cls long, n long, root long", parts, chunk=4000), "vector-links")
    discard(edges)
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    rep = classes.select("cls", "rep")
    links = found.where("cls <> root").select("cls", "root").distinct()
    links = links.join(rep, "cls").withColumnRenamed("rep", "a").join(rep.select(F.col("cls").alias("root"), F.col("rep").alias("b")), "root").select("a", "b")
    # An id that stands in several classes ties them together.
    several = good.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    ties = good.join(several, "id", "left_semi").join(classes.select("label", "v", "rep"), ["label", "v"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    parts_of = connected_components(links.unionByName(ties))
    of = classes.join(counts, "cls", "left").join(parts_of, F.col("rep") == F.col("node"), "left")
    of = of.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = good.join(of, ["label", "v"]).select("id", "n_links", "component")
    alone = rows.where(~(usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull())).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumnRenamed("id", id_col)
