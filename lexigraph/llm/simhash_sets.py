r"""SimHash near-duplicates of texts by the similarity of their shingle sets: wide fingerprints, multi-index hashing, exact verification.

A text's set holds the hashes (64 bits) of its runs of `size` words (A-Z lower-cased, words [^\x20\x09-\x0D]+); a shorter
text has one run of all its words, a text without words the empty set. Similarity is |A & B| / |A | B|; two empty sets
are equal. Texts link at `share` or more. Equal sets are one class from the start.

Fingerprints. Two sets at the threshold differ in a known share of their SimHash bits. A fingerprint is cut into segments, as wide
as the number of texts asks for (so that random meetings stay few at every size) and as many as make the chance that a
pair at the threshold is within 2 bits in none of them at most `miss`.

Meetings. Each text enumerates the ball of radius 1 around each of its segments, so texts within 2 bits there meet in a
table. Shuffled is one row for each segment and its neighbours in the leading bits; the rest of the ball is enumerated where
tables are read. Complete distances are verified against the limit that `miss` allows. A table gives each text's closest neighbour and
a spanning forest, never pairs; the members of a table with more than `group` texts are tied together instead. Tables with too many rows
for a task are dealt out by the whole segment and, where that is hot, tied without being read.

Verification. What is tied together is a cluster. Within a cluster all pairs within the limit that aren't linked yet are
verified on their whole sets. Large clusters link closest neighbours first; then only pairs from different parts are left, in
tiles of bounded size, to which the cluster's largest part sends each of its members for the blocks of the others only.

Rows are told apart by a key of their own (not negative), so ids may be null or repeated. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, discard, marked, marks, materialize, mix64, slices, tidy
from .components import connected_components
from .pairing import Forest, by_unit, to_units, unit_ranges

RADIUS = 2


def plan(texts: int, share: tuple[int, int], miss: float) -> tuple[int, int, int]:
    """Bits of a segment, segments, and the greatest distance of fingerprints that is verified."""
    width = min(32, max(16, math.ceil(math.log2(max(texts, 1))) - 2))
    j = share[0] / share[1]
    differ = math.acos(2 * j / (1 + j)) / math.pi
    near = sum(math.comb(width, k) * differ**k * (1 - differ) ** (width - k) for k in range(RADIUS + 1))
    segments = math.ceil(math.log(miss) / math.log(1 - near))
    bits, tail, limit = width * segments, 1.0, -1
    while tail > miss / 4 and limit < bits:
        limit += 1
        ways = math.lgamma(bits + 1) - math.lgamma(limit + 1) - math.lgamma(bits - limit + 1)
        tail -= math.exp(ways + limit * math.log(differ) + (bits - limit) * math.log(1 - differ))
    return width, segments, limit


def fingerprint(shingles: np.ndarray, bits: int) -> bytes:
    """A bit is set if it is set in over half of the hashes; whole words of 64 bits."""
    blocks = -(-bits // 64)
    count = np.zeros(64 * blocks, np.int64)
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096]
        wide = np.stack([mix64(part + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) for k in range(blocks)], 1)
        count += np.unpackbits(wide.view(np.uint8), axis=1).reshape(len(part), -1).sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(shingles)).tobytes()


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    text = Rolling(texts, lower=True)
    h = text.at_all(size)
    out = []
    for end, n in zip(text.ends.tolist(), text.size.tolist()):
        begin = end - n
        out.append(np.unique(h[begin : end - size + 1] if n >= size else text.runs(np.arange(begin, end)[:1], n)))
    return out


def signatures(rows: DataFrame, size: int, bits: int, whole: bool = False) -> DataFrame:
    """Rows (row, digest, fp) of rows (row, text); whole: also the sets, as ascending hashes."""
    names = ["row", "digest", "fp", "shingles"][: 3 + whole]

    def run(batches):
        import xxhash

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], 3_000_000):
                sets = shingle_sets(texts[a:b], size)
                data = [s.tobytes() for s in sets]
                columns = [[xxhash.xxh3_128_digest(d) for d in data], [fingerprint(s, bits) for s in sets], data][: 2 + whole]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, pa.binary()) for x in columns)], names)

    return rows.select("row", "text").mapInArrow(tidy(run), "row long, digest binary, fp binary" + ", shingles binary" * whole)


def fingerprint_words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Fingerprints as a matrix of 64-bit words."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint64)


def _segments(words: np.ndarray, width: int, segments: int) -> np.ndarray:
    bits = np.unpackbits(words.view(np.uint8), axis=1)[:, : width * segments].reshape(len(words), segments, width)
    return bits.astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def tables(classes: DataFrame, width: int, segments: int, lead: int) -> DataFrame:
    """Rows (unit, segment, value, own, row, fp): a text's segments and their neighbours in the `lead` leading bits. A unit is a segment's place and leading bits."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row, fp = batch.column("row"), batch.column("fp")
            value = _segments(fingerprint_words(fp), width, segments)
            for s in range(segments):
                for flip in range(-1, lead):
                    v = value[:, s] ^ (1 << (width - lead + flip)) if flip >= 0 else value[:, s]
                    n = len(v)
                    yield pa.RecordBatch.from_arrays([pa.array(s << 40 | v >> (width - lead)), pa.array(np.full(n, s, np.int32)), pa.array(v), pa.array(np.full(n, flip < 0)), row, fp], ["unit", "segment", "value", "own", "row", "fp"])

    return classes.select("row", "fp").mapInArrow(tidy(run), "unit long, segment int, value long, own boolean, row long, fp binary")


def balls(own: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the row) of what each row stands under: its value and, if it is the text's own, each of the `bits` lowest bits turned."""
    at = np.flatnonzero(own)
    around = value[at][:, None] ^ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return np.concatenate((value, around.ravel())), np.concatenate((np.arange(len(value)), np.repeat(at, bits)))


def table_links(key: np.ndarray, at: np.ndarray, rows: np.ndarray, words: np.ndarray, limit: int, group: int, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) of one segment's tables: closest neighbours, a forest, and ties of large groups to a node of their own (negative)."""
    order = np.argsort(key, kind="stable").astype(np.int32)
    rank = np.empty(len(rows), np.int64)
    by_rank = np.argsort(rows, kind="stable")
    rank[by_rank] = np.arange(len(rows))
    none = np.int64(1) << 62
    best, forest = np.full(len(rows), none), Forest(len(rows))  # distance and rank of each row's closest neighbour
    ties_a, ties_b = [], []

    def meet(i: np.ndarray, j: np.ndarray, far: np.ndarray) -> None:
        np.minimum.at(best, i, far << 32 | rank[j])
        np.minimum.at(best, j, far << 32 | rank[i])
        forest.join(i, j)

    begin = 0
    while begin < len(order):  # whole keys, some 200,000 entries at once
        end = min(begin + 200_000, len(order))
        part = key[order[begin:]] if end == len(order) else key[order[begin : end + 1]]
        if end < len(order):
            last = part[-1]
            cut = int(np.searchsorted(part, last, "left"))
            end = begin + cut if cut else begin + int(np.searchsorted(key[order[begin:]], last, "right"))
        r = at[order[begin:end]]
        k = key[order[begin:end]]
        begin = end
        edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(edge, len(k)))
        for g in np.flatnonzero(size > 128).tolist():
            members = r[edge[g] : edge[g] + size[g]]
            if len(members) > group:
                ties_a.append(rows[members])
                ties_b.append(np.full(len(members), -1 - (segment << 40 | int(k[edge[g]])), np.int64))
                continue
            for c in range(0, len(members), 128):
                far = distances(words[members[c : c + 128]][:, None], words[members[c:]][None])
                i, j = np.nonzero(far <= limit)
                up = i < j
                meet(members[c + i[up]], members[c + j[up]], far[i[up], j[up]])
        small = np.repeat((size > 1) & (size <= 128), size)
        k, r = k[small], r[small]
        w = words[r]
        for d in range(1, int(size[(size > 1) & (size <= 128)].max(initial=1))):
            near = np.flatnonzero(k[d:] == k[:-d])
            far = distances(w[near], w[near + d])
            hit = np.flatnonzero(far <= limit)
            meet(r[near[hit]], r[near[hit] + d], far[hit])
    a = np.flatnonzero(best < none)
    b = by_rank[best[a] & 0xFFFFFFFF]
    closest = Forest(len(rows))
    closest.join(a, b)
    top, whole = closest.root(np.arange(len(rows))), forest.root(np.arange(len(rows)))
    more = np.flatnonzero((top == np.arange(len(rows))) & (whole != top))
    a, b = np.concatenate([*ties_a, rows[a], rows[more]]), np.concatenate([*ties_b, rows[b], rows[whole[more]]])
    a, b = np.maximum(a, b), np.minimum(a, b)
    pair = np.unique(np.stack((a, b), 1), axis=0)
    return pair[:, 0].copy(), pair[:, 1].copy()


def meetings(classes: DataFrame, count: int, width: int, segments: int, limit: int, group: int, unit_rows: int) -> DataFrame:
    """Edges (a, b) that connect all texts within `limit` bits that meet; b is negative for a tie."""
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lead = 0
    while lead < width - 4 and count * (1 + lead) >> lead > unit_rows:
        lead += 1
    sent = tables(classes, width, segments, lead)
    full = materialize(sent.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") > 4 * unit_rows).select("unit"), "similar-full")

    def run(table: pa.Table):
        unit = table.column("unit").to_numpy()
        segment, value, row = (table.column(c).to_numpy() for c in ("segment", "value", "row"))
        own, words = np.asarray(table.column("own").to_numpy(zero_copy_only=False), bool), fingerprint_words(table.column("fp"))
        for x, y in unit_ranges(unit):
            key, at = balls(own[x:y], value[x:y], width - lead if spread else 0)
            a, b = table_links(key, at, row[x:y], words[x:y], limit, group, int(segment[x]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    spread = True
    usual = by_unit(sent.join(full, "unit", "left_anti"), run, "a long, b long", parts)
    if not full.count():  # a row for each unit that is too full, most often none
        return usual.distinct()

    def single(batches):
        for batch in batches:
            if batch.num_rows:
                key, at = balls(np.asarray(batch.column("own").to_numpy(zero_copy_only=False), bool), batch.column("value").to_numpy(), width - lead)
                segment = batch.column("segment").to_numpy()[at].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(segment << 40 | key), pa.array(segment.astype(np.int32)), pa.array(key), pa.array(np.zeros(len(key), bool)), batch.column("row").take(pa.array(at)), batch.column("fp").take(pa.array(at))], batch.schema.names)

    names = "unit long, segment int, value long, own boolean, row long, fp binary"
    single_keys = sent.join(full, "unit", "left_semi").select("unit", "segment", "value", "own", "row", "fp").mapInArrow(tidy(single), names)
    hot = materialize(single_keys.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") > group).select("unit"), "similar-hot")
    tied = single_keys.join(hot, "unit", "left_semi").select(F.col("row").alias("a"), (F.lit(-1).cast("long") - F.col("unit")).alias("b"))
    spread = False
    return usual.unionByName(by_unit(single_keys.join(hot, "unit", "left_anti"), run, "a long, b long", parts)).unionByName(tied).distinct()


def alike(x: np.ndarray, y: np.ndarray, share: tuple[int, int]) -> bool:
    p, q = share
    if q * min(len(x), len(y)) < p * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)))
    return (p + q) * int((both[1:] == both[:-1]).sum()) >= p * (len(x) + len(y))


def verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of rows whose sets are similar."""

    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            keep = pa.array([alike(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), share) for s, t in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    whole = pairs.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")
    return whole.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def tile_links(share: tuple[int, int], limit: int):
    """run() for by_unit: links that connect all similar rows of different parts in a tile."""

    def run(table: pa.Table):
        unit, row, part, side = (table.column(c).to_numpy() for c in ("unit", "row", "part", "side"))
        diagonal, words = np.asarray(table.column("diagonal").to_numpy(zero_copy_only=False), bool), fingerprint_words(table.column("fp"))
        data = table.column("shingles").combine_chunks()
        for x, y in unit_ranges(unit):
            sets = [np.frombuffer(s, np.uint64) for s in data.slice(x, y - x).to_pylist()]
            size, of, w = np.array([len(s) for s in sets]), part[x:y], words[x:y]
            first: dict[int, int] = {}
            up = [first.setdefault(p, i) for i, p in enumerate(of.tolist())]

            def root(i: int) -> int:
                while up[i] != i:
                    up[i] = i = up[up[i]]
                return i

            left, right = (np.arange(y - x),) * 2 if diagonal[x] else (np.flatnonzero(side[x:y] == 0), np.flatnonzero(side[x:y] == 1))
            out: list[tuple[int, int]] = []
            for c in range(0, len(left), 128):
                i = left[c : c + 128]
                far = distances(w[i][:, None], w[right][None])
                fits = (far <= limit) & (of[i][:, None] != of[right][None]) & (share[1] * np.minimum(size[i][:, None], size[right][None]) >= share[0] * np.maximum(size[i][:, None], size[right][None]))
                if diagonal[x]:
                    fits &= i[:, None] < right[None]
                m, n = np.nonzero(fits)
                order = np.argsort(far[m, n], kind="stable")
                for g, h in zip(i[m[order]].tolist(), right[n[order]].tolist()):
                    p, q = root(g), root(h)
                    if p != q and alike(sets[g], sets[h], share):
                        up[q] = p
                        out.append((g, h))
            if out:
                a, b = row[x:y][np.array(out).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return run


def groups(rows: DataFrame, size: int = 5, share: tuple[int, int] = (4, 5), miss: float = 0.002, block: int = 512, group: int = 4096, unit_rows: int = 400_000) -> DataFrame:
    """Rows (row, component) for rows (row long, text string), row unique: the smallest row reachable over similar pairs.

    share: the threshold as a fraction. miss: the greatest chance to overlook a pair at the threshold. The others set sizes of tasks only.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = rows.count()
    width, segments, limit = plan(count, share, miss)
    sigs = materialize(signatures(rows, size, width * segments), "similar-signatures")
    classes = materialize(sigs.groupBy("digest").agg(F.min("row").alias("row"), F.min("fp").alias("fp")), "similar-classes")
    edges = materialize(meetings(classes, count, width, segments, limit, group, unit_rows), "similar-edges")
    clusters = connected_components(edges).where("node >= 0").select(F.col("node").alias("row"), F.col("component").alias("cluster"))
    clusters = materialize(clusters, "similar-clusters")
    # Only the texts of clusters are read again; a text that shares a mark with them by chance is left out by the joins.
    sets = materialize(signatures(marked(rows, marks(clusters, "row"), "row"), size, width * segments, whole=True), "similar-sets")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    large = materialize(sizes.where(F.col("n") > block).select("cluster"), "similar-large")
    plain = [F.lit(0).alias("side"), F.lit(True).alias("diagonal")]
    tiles = clusters.join(large, "cluster", "left_anti").select(F.xxhash64("cluster").alias("unit"), "row", F.col("row").alias("part"), *plain)
    links = None
    if large.count():
        inside = clusters.join(large, "cluster")
        near = edges.where("b >= 0").join(inside.select(F.col("row").alias("a")), "a", "left_semi")
        links = materialize(verified(near, sets, share), "similar-links")
        tied = connected_components(links)
        inside = inside.join(tied, F.col("row") == F.col("node"), "left").select("cluster", "row", F.coalesce("component", "row").alias("part"))
        inside = materialize(inside, "similar-inside")
        by_part = inside.groupBy("cluster", "part").agg(F.count("*").alias("n"))
        main = by_part.groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("mains"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
        dealt = inside.join(main, "cluster").withColumn("side", (F.col("part") != F.col("main")).cast("int"))
        rest = to_units(dealt.where("side = 1").select("cluster", "row", "part"), "cluster", "row", block).select("unit", "row", "part", "side", "diagonal")
        cuts = lambda n: F.greatest(F.ceil(F.col(n) / F.lit(block)), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("row", F.lit(17)), F.when(F.col("side") == 0, cuts("mains")).otherwise(cuts("others"))).cast("int")
        across = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, cuts("others")).otherwise(cuts("mains")) - 1)))
        across = across.select(F.xxhash64("cluster", F.lit("x"), F.when(F.col("side") == 0, F.struct("own", "other")).otherwise(F.struct(F.col("other").alias("own"), F.col("own").alias("other")))).alias("unit"), "row", "part", "side", F.lit(False).alias("diagonal"))
        tiles = tiles.unionByName(rest).unionByName(across)
    found = by_unit(tiles.join(sets.select("row", "fp", "shingles"), "row").select("unit", "row", "part", "side", "diagonal", "fp", "shingles"), tile_links(share, limit), "a long, b long", parts, chunk=4000)
    found = materialize(found if links is None else found.unionByName(links), "similar-found")
    tied = connected_components(found)
    of = classes.join(tied, F.col("row") == F.col("node"), "left").select("digest", F.coalesce("component", "row").alias("component"))
    out = materialize(sigs.select("row", "digest").join(of, "digest").select("row", "component"), "similar-groups")
    discard(sigs, classes, edges, clusters, sets, large, found)
    return out
