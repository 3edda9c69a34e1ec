r"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits over the 3-word shingles of a text (A-Z lower-cased, words
[^\x20\x09-\x0D]+, repeats count); a bit is set if it is set in over half of the shingles' XXH64
(seed 42). Fingerprints within 3 bits of one another have one half of 32 bits within 1 bit. For each
half the ball of radius 1 is enumerated: a fingerprint stands under its half and, as a probe, under
the half with any one set bit cleared (of two halves one bit apart, one is the other with a bit
cleared). Meetings are verified on all 64 bits. Equal fingerprints are one class from the start.

No pairs are emitted: a bucket gives a spanning forest of its verified links; large buckets are cut
into block pairs (pairing.py). Components come from components.py.

Null, empty or blank text: fingerprint zero, linked like any other. One or two words: one shingle of
the whole sequence. Rows with a null id get their fingerprint, a null component and no links.
Repeated ids are one node. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices, tidy, unsent
from .components import connected_components
from .pairing import Forest, by_unit, to_units, unit_ranges

HALF = 32


def simhash(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text as an unsigned integer."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        shingles = [b" ".join(words)]
    elif size == 3:
        shingles = [b"%b %b %b" % w for w in zip(words, words[1:], words[2:])]
    else:
        shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    bits, n = np.zeros(64, np.int64), len(shingles)
    for a in range(0, n, 16_384):
        raw = b"".join([digest(s, seed) for s in shingles[a : a + 16_384]])
        part = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        for c in range(0, len(part), 255):  # sums of 255 bits fit a byte
            bits += part[c : c + 255].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Rows (id, fp long): the signed 64-bit image of each text's fingerprint."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            fp = np.array([simhash(t.as_py(), size) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    return rows.mapInArrow(tidy(run), f"id {rows.schema[0].dataType.simpleString()}, fp long").select(F.col("id").alias(id_col), "fp")


def verified_links(classes: DataFrame, radius: int = 3, block: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) within `radius` bits that connect all such pairs."""
    if radius > 3:
        raise ValueError("two segments with balls of radius 1 cover 3 bits")
    spark = classes.sparkSession
    keys = []
    for half in (0, 1):
        seg = F.shiftrightunsigned("fp", HALF) if half else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
        cleared = F.filter(F.transform(F.sequence(F.lit(0), F.lit(HALF - 1)), lambda b: F.when(F.getbit(seg, b) == 1, seg - F.call_function("shiftleft", F.lit(1).cast("long"), b))), lambda x: x.isNotNull())
        own = F.array(F.struct(seg.alias("seg"), F.lit(True).alias("own")))
        ball = F.transform(cleared, lambda x: F.struct(x.alias("seg"), F.lit(False).alias("own")))
        keys.append(classes.select("fp", F.explode(F.concat(own, ball)).alias("k")).select("fp", (F.col("k.seg") * 2 + half).alias("key"), F.col("k.own").alias("own")))
    members = keys[0].unionByName(keys[1])
    units = to_units(members, "key", "fp", block).select("unit", "fp", "own", "side", "diagonal")

    def run(table: pa.Table):
        unit = table.column("unit").to_numpy()
        fp = table.column("fp").to_numpy().view(np.uint64)
        own = np.asarray(table.column("own").to_numpy(zero_copy_only=False), bool)
        side = table.column("side").to_numpy()
        diagonal = np.asarray(table.column("diagonal").to_numpy(zero_copy_only=False), bool)
        left, right = [], []
        size = np.diff(np.append(np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1]))), len(unit)))
        start = np.cumsum(size) - size
        # Small units: compare each row with the one d places below it, for all units at once.
        small = size <= 24
        within = np.arange(len(unit)) - np.repeat(start, size)
        room, few = np.repeat(size, size), np.repeat(small, size)
        for d in range(1, int(size[small].max(initial=1))):
            i = np.flatnonzero(few & (within + d < room))
            if not len(i):
                break
            j = i + d
            ok = (own[i] | own[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= radius) & (fp[i] != fp[j])
            left.append(fp[i[ok]])
            right.append(fp[j[ok]])
        for k in np.flatnonzero(~small):
            a, b = int(start[k]), int(start[k] + size[k])
            x, o = fp[a:b], own[a:b]
            whole = bool(diagonal[a])
            rows, cols = (np.arange(b - a),) * 2 if whole else (np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1))
            forest = Forest(b - a)
            for c in range(0, len(rows), 256):
                r = rows[c : c + 256]
                near = (np.bitwise_count(x[r][:, None] ^ x[cols][None, :]) <= radius) & (o[r][:, None] | o[cols][None, :])
                i, j = np.nonzero(near)
                forest.join(r[i], cols[j])
            root = forest.root(np.arange(b - a))
            moved = x[root] != x
            left.append(x[moved])
            right.append(x[root][moved])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.uint64) for v in (left, right))
        pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy().view(np.int64)), pa.array(pair[:, 1].copy().view(np.int64))], ["a", "b"])

    return by_unit(units, run, "a long, b long", int(spark.conf.get("spark.sql.shuffle.partitions")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """Rows (id, fp long, component): one for each input row; component is the smallest id reachable, itself included."""
    found = materialize(fingerprints(docs, id_col, text_col, size), "simhash")
    classes = found.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("rep"))
    classes = materialize(classes, "simhash-classes")
    # Links join fingerprints; components are counted over the classes' smallest ids.
    links = verified_links(classes.select("fp"), radius)
    name = classes.select(F.col("fp").alias("b"), F.col("rep").alias("rep_b"))
    named = links.join(unsent(classes.select(F.col("fp").alias("a"), F.col("rep").alias("rep_a"))), "a").join(unsent(name), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # An id given to several rows ties their fingerprints together.
    ties = found.join(unsent(classes), "fp").where(F.col(id_col) > F.col("rep")).select(F.col(id_col).alias("a"), F.col("rep").alias("b"))
    shared = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")
    named = named.unionByName(ties.join(unsent(shared.select(F.col(id_col).alias("a"))), "a", "left_semi"))
    parts = connected_components(named)
    of = classes.join(unsent(parts), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = found.join(unsent(of), "fp", "left")
    return out.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component")).alias("component"))
