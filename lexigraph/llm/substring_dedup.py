r"""Removal of repeated word windows with a log-structured fingerprint index.

Words are [^\x20\x09-\x0D]+. A window is `window` consecutive words of a document; a word goes if a window
that covers it has the same words as a window that starts anywhere else.

Index. Every window of 35 words holds 26 grams of 10 words; the least of their hashes is the window's
anchor, so equal windows have equal anchors and neighbouring windows mostly share one. The index (FingerprintLog) is a
log-structured set of immutable runs of (anchor, count), bucketed and sorted by anchor. Each batch of documents becomes a run and
is merge-joined with the older runs, bucket by bucket and without a shuffle; runs of one level are compacted into the next. What the
joins and the batch itself repeat is verified; the other anchors are done with.

History. A log that is passed to several calls also keeps each batch's texts and anchors by row. A batch's windows are then
verified against its own and all earlier ones; the result has the rows of the new batch only.

Verification. A stretch is a maximal row of windows with one repeated anchor. Stretches are compared by
hashes of all their words; where a stretch has no equal, the windows of all stretches
of its anchor are compared one by one. Anchor and word hash together make 128 bits.

Only anchors, stretches and windows of repeated anchors are shuffled, with counts combined before the
shuffle and joined back as tables, which lets AQE split hot ones. Of the texts only those with repeats are shuffled; a bit map of
bounded size tells them from the others.

Null or empty text: no words, nothing removed. Documents under 35 words are kept whole. Whole repeated
documents lose all windowed words. Repeated ids are numbered apart and never mixed; null ids are kept.
Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TOP, Rolling, delete_path, discard, marked, marks, materialize, new_path, slices, tidy, words_of

def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each `width` neighbours; the result is width - 1 shorter."""
    have, out = 1, x
    while 2 * have <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def anchors(text: Rolling, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram hash at every position, and the anchor of the window at every position (0: no window)."""
    h = text.at_all(gram)
    anchor = np.zeros(len(h), np.uint64)
    if len(h) >= window:
        low = sliding(h, window - gram + 1, np.minimum)
        anchor[: len(h) - window + 1] = low[: len(h) - window + 1]
    anchor[text.room < window] = 0
    return h, anchor


def anchor_positions(h: np.ndarray, anchor: np.ndarray, width: int) -> np.ndarray:
    """Positions of grams that are the least in a window: each occurrence of an anchor."""
    high = sliding(np.concatenate((np.zeros(width - 1, np.uint64), anchor)), width, np.maximum)
    return np.flatnonzero((high == h) & (h != TOP))


class FingerprintLog:
    """Log-structured index: levels of immutable runs (fp long, n long), bucketed and sorted by fp.

    append() writes a run and merge-joins it with the older ones; when a level holds `fanout` runs, settle() compacts them
    into one of the next level. Runs are tables in `path`; `levels` names them. `history` holds (texts, anchors) of the batches
    that remember() has kept. drop() deletes it all.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path or new_path(spark, "fingerprints"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"fingerprints_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = [[]]
        self.history: list[tuple[str, str]] = []
        self.written = 0

    def _write(self, counts: DataFrame) -> str:
        name = f"{self.name}_{self.written:05d}"
        self.written += 1
        dealt = counts.repartition(self.buckets, "fp").sortWithinPartitions("fp")
        dealt.write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}").bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        return name

    @property
    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def hits(self, run: str, older: list[str]) -> DataFrame:
        """Column fp: what the run repeats, or holds like an older run; merge joins of sorted buckets."""
        new = self.spark.table(run)
        found = new.where("n > 1").select("fp")
        for old in older:
            found = found.unionByName(new.select("fp").hint("merge").join(self.spark.table(old).select("fp").hint("merge"), "fp"))
        return found

    def append(self, fps: DataFrame) -> DataFrame:
        """Add a batch (column fp, a row for each occurrence); a written table of the fps that it or older runs repeat (fp, distinct)."""
        older = self.runs
        run = self._write(fps.groupBy("fp").agg(F.count("*").alias("n")))
        self.levels[0].append(run)
        return materialize(self.hits(run, older).distinct(), "substring-hits")

    def settle(self) -> None:
        """Compact full levels."""
        i = 0
        while i < len(self.levels):
            if len(self.levels[i]) >= self.fanout:
                runs, self.levels[i] = self.levels[i], []
                merged = self.spark.table(runs[0])
                for r in runs[1:]:
                    merged = merged.unionByName(self.spark.table(r))
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(merged.groupBy("fp").agg(F.sum("n").alias("n"))))
                self._forget(runs)
            i += 1

    def remember(self, texts: DataFrame, anchors: DataFrame) -> None:
        """Keep a batch's texts (row, text) and anchors (row, fp) for later batches; texts without an anchor are left out."""
        where = f"{self.path}/batch-{len(self.history):05d}"
        anchors.write.option("compression", "zstd").parquet(f"{where}/anchors")
        texts.join(anchors.select("row").distinct(), "row", "left_semi").write.option("compression", "zstd").parquet(f"{where}/texts")
        self.history.append((f"{where}/texts", f"{where}/anchors"))

    def _forget(self, runs: list[str]) -> None:
        for r in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")
            delete_path(self.spark, f"{self.path}/{r}")

    def drop(self) -> None:
        self._forget(self.runs)
        self.levels, self.history = [[]], []
        delete_path(self.spark, self.path)


def occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (row long, fp long) of docs (row, text): every occurrence of an anchor."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], 3_000_000):
                text = Rolling(texts[a:b])
                h, anchor = anchors(text, window, gram)
                if not len(h):
                    continue
                pos = anchor_positions(h, anchor, window - gram + 1)
                doc = np.searchsorted(text.ends, pos, "right")
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b][doc]), pa.array(h[pos].view(np.int64))], ["row", "fp"])

    return docs.select("row", "text").mapInArrow(tidy(run), "row long, fp long")


def stretches(flagged: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows of flagged (row, old, text, fps) with their word counts and, packed, the stretches of repeated anchors."""

    def run(batches):
        empty = np.zeros(0, np.int64)
        for batch in batches:
            texts, wanted_at = batch.column("text").to_pylist(), batch.column("fps")
            for a, b in slices([len(t or "") for t in texts], 3_000_000):
                text = Rolling(texts[a:b])
                _, anchor = anchors(text, window, gram)
                every = text.at_all(window)
                lists: list[list] = [[None] * (b - a) for _ in range(5)]
                for i, (end, n) in enumerate(zip(text.ends.tolist(), text.size.tolist())):
                    if not wanted_at[a + i].is_valid:
                        continue
                    begin = end - n
                    own = anchor[begin:end]
                    wanted = wanted_at[a + i].values.to_numpy().view(np.uint64)
                    edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else empty
                    stop = np.append(edge[1:], len(own)) if len(own) else empty
                    use = np.isin(own[edge], wanted) & (own[edge] != 0)
                    edge, stop = edge[use], stop[use]
                    if len(edge):
                        lists[0][i] = own[edge].view(np.int64)
                        lists[1][i] = edge
                        lists[2][i] = stop - edge
                        lists[3][i] = text.runs(begin + edge, stop - edge + window - 1).view(np.int64)
                        lists[4][i] = [every[begin + x : begin + y].tobytes() for x, y in zip(edge.tolist(), stop.tolist())]
                kinds = [pa.list_(pa.int64())] * 4 + [pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("row", "old", "text")), pa.array(text.size), *(pa.array(x, k) for x, k in zip(lists, kinds))], ["row", "old", "text", "n_words", "fp", "start", "length", "hash", "windows"])

    return flagged.select("row", "old", "text", "fps").mapInArrow(tidy(run), "row long, old boolean, text string, n_words long, fp array<long>, start array<long>, length array<long>, hash array<long>, windows array<binary>")


def covered(table: DataFrame) -> DataFrame:
    """Rows (row, start, length) of windows (first, count) of rows that aren't old which occur again, from stretches()."""
    each = table.where("fp is not null").select("row", "old", F.explode(F.arrays_zip("fp", "start", "length", "hash", "windows")).alias("s")).select("row", "old", "s.*")
    counts = materialize(each.groupBy("fp", "hash", "length").agg(F.count("*").alias("n")), "stretches")
    again = materialize(counts.where("n > 1").drop("n"), "stretches-again")
    whole = each.where("not old").drop("windows").join(again, ["fp", "hash", "length"]).select("row", "start", "length")
    open_fps = materialize(counts.groupBy("fp").agg(F.min("n").alias("n")).where("n = 1").select("fp"), "stretches-open")
    apart = each.join(open_fps, "fp", "left_semi")

    def unpack(batches):
        for batch in batches:
            n = batch.column("length").to_numpy()
            if not len(n):
                continue
            at = np.repeat(np.arange(len(n)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hashes = np.frombuffer(b"".join(batch.column("windows").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in ("row", "old", "fp")), pa.array(batch.column("start").to_numpy()[at] + within), pa.array(hashes)], ["row", "old", "fp", "start", "win"])

    single = apart.select("row", "old", "fp", "start", "length", "windows").mapInArrow(tidy(unpack), "row long, old boolean, fp long, start long, win long")
    twice = materialize(single.groupBy("fp", "win").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "windows-again")
    some = single.where("not old").join(twice, ["fp", "win"]).select("row", "start", F.lit(1).cast("long").alias("length"))
    found = materialize(whole.unionByName(some), "substring-spans")
    discard(counts, again, open_fps, twice)
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 10, batches: int = 2, fanout: int = 2, log: FingerprintLog | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, n_words, n_removed, text, kept string), one for each input row; kept is null where nothing went (see `text`), else the kept words joined by one space.

    `text` is the row's own text. keep: further columns of docs to carry along, row by row. batches: documents are indexed in so many batches by a hash of the row.
    log: an index of earlier calls, whose windows count as occurrences too; the documents are added to it.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    kept_as = {c: f"keep_{c}" for c in keep}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(k) for c, k in kept_as.items()))
    if id_type in ("bigint", "int") and not rows.groupBy("id").count().where("count > 1 or id is null").limit(1).count():
        base = rows.withColumn("row", F.col("id").cast("long"))
    else:  # rows need a name of their own, which must stay the same when a task runs again
        base = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "substring-rows")
    fps = materialize(occurrences(base, window, gram), "substring-fps")
    index = log or FingerprintLog(spark, fanout=fanout)
    hits = []
    for b in range(batches):
        hits.append(index.append(fps.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == b)))
        index.settle()
    repeated = hits[0]
    for h in hits[1:]:
        repeated = repeated.unionByName(h)
    repeated = materialize(repeated.distinct(), "substring-repeated")
    flagged = materialize(fps.join(repeated, "fp").groupBy("row").agg(F.collect_set("fp").alias("fps")), "substring-flagged")
    at = materialize(marks(flagged, "row"), "substring-marks")
    touched = marked(base, at, "row")  # a few others are among them by chance
    sources = touched.select("row", F.lit(False).alias("old"), "text").join(flagged, "row", "left")
    for texts, anchors_of in index.history:
        past = spark.read.parquet(anchors_of).join(repeated, "fp").groupBy("row").agg(F.collect_set("fp").alias("fps"))
        sources = sources.unionByName(spark.read.parquet(texts).select("row", F.lit(True).alias("old"), "text").join(past, "row"))
    table = materialize(stretches(sources, window, gram), "substring-texts")
    if log:
        index.remember(base.select("row", "text"), fps)
    else:
        index.drop()
    discard(*hits, repeated, fps)
    spans = covered(table).groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias("spans"))

    def cut(batches):
        for batch in batches:
            removed, kept = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                if not spans:
                    removed.append(0)
                    kept.append(None)
                    continue
                words = words_of(text)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [s["start"] for s in spans], 1)
                np.add.at(edge, [s["start"] + s["length"] + window - 1 for s in spans], -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n_words"), pa.array(removed, pa.int64()), batch.column("text"), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "text", "kept"])

    done = table.where("not old").select("row", "n_words", "text").join(spans, "row", "left").mapInArrow(tidy(cut), "row long, n_words long, n_removed long, text string, kept string")
    names = ["id", "n_words", "n_removed", "text", "kept", *kept_as.values()]
    done = touched.drop("text").join(done, "row").select(names)
    spaced = squeezed(F.col("text"), F.lit(None).cast("string"))
    n_words = F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long")
    clean = marked(base, at, "row", others=True).select("id", n_words.alias("n_words"), F.lit(0).cast("long").alias("n_removed"), "text", F.lit(None).cast("string").alias("kept"), *kept_as.values())
    return clean.unionByName(done).toDF(id_col, "n_words", "n_removed", "text", "kept", *keep)


def squeezed(text, kept):
    """Column: the kept words joined by one space; for untouched rows their words likewise."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.coalesce(kept, words)
