"""Shared helpers: the cluster's shared folder, lineage cuts, word splitting and fold columns."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
#: What a worker process remembers between tasks: name -> function that empties it.
CACHES: dict[str, Callable[[], object]] = {}


def give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise, and workers live as long as the application."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def forget_others(cache: str | None) -> None:
    for name, empty in CACHES.items():
        if name != cache:
            empty()


def tidy(run: Callable, cache: str | None = None) -> Callable:
    """run(batches) for mapInArrow, without the memory that other operators left in the worker; `cache` names the one run() uses."""

    def task(batches) -> Iterator[pa.RecordBatch]:
        forget_others(cache)  # a function of the module, so the worker's own caches are meant
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches of this session hold at most so many rows: documents are long, and batches of the default 10,000 take memory several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or our own where that is unset (tests)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="lexigraph-"))
    return _OWN_DIR[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexigraph/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    The written table survives lost executors. Rows and columns are unchanged.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lexigraph_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete tables written by materialize() that no later plan reads."""
    for df in frames:
        path = getattr(df, "_lexigraph_path", None)
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unsent(df: DataFrame) -> DataFrame:
    """df as a side of a join that is sorted and merged: a table that grows with the input is never broadcast through the driver.

    Spark takes an exploded or packed table for as small as the file it is read from, so its own choice can send millions of rows.
    """
    return df.hint("merge")


def fold(column: str, parts: int) -> Column:
    """crc32 of the value as text, modulo parts; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


def words_of(text: str | None) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+ as UTF-8; bytes.split() cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches put together up to about `limit` bytes of a text column: the more text at once, the fewer distinct words."""
    held, total = [], 0
    for batch in batches:
        size = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and total + size > limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
        if batch.num_rows:
            held.append(batch)
            total += size
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def coded_words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct words of all texts (that of the empty string may be among them), each word's place among them, texts laid end to end, and each text's number of words."""
    flat = pa.array(["" if t is None else t for t in texts], pa.large_string())
    cut = pc.ascii_split_whitespace(pc.ascii_lower(flat) if lower else flat)
    coded, offsets = cut.values.dictionary_encode(), cut.offsets.to_numpy()
    code = coded.indices.to_numpy()
    empty = pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py()  # stands at the ends of texts
    if empty < 0:
        size = np.diff(offsets)
    else:
        real = code != empty
        size = np.diff(np.concatenate(([0], np.cumsum(real)))[offsets])
        code = code[real]
    digest = xxhash.xxh64_digest
    table = np.frombuffer(b"".join([digest(w, 20) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]), ">u8").astype(np.uint64)
    return table, code, size.astype(np.int64)


def hashed_words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and each text's number of words."""
    table, code, size = coded_words(texts, lower)
    return table[code], size


def marks(keys: DataFrame, key: str, bits: int = 24) -> DataFrame:
    """A bit map (place, bits) of hashes of the keys: at most 2^(bits - 6) rows, however many keys there are."""
    h = F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1 << bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return keys.select(F.shiftright(h, 6).alias("place"), bit.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits"))


def marked(rows: DataFrame, map_: DataFrame, key: str, bits: int = 24, others: bool = False) -> DataFrame:
    """The rows whose key's mark is set, all keys of the map among them; others: the remaining rows, those with a null key among them.

    The map is broadcast; its size is bounded by its making.
    """
    h = F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1 << bits))
    joined = rows.withColumn("_h", h).join(F.broadcast(map_.toDF("_place", "_bits")), F.shiftright("_h", 6) == F.col("_place"), "left")
    hit = F.coalesce(F.getbit(F.col("_bits"), F.col("_h").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return joined.where(~hit if others else hit).select(*rows.columns)


def slices(sizes: list[int], limit: int):
    """Cut range(len(sizes)) into runs of about `limit` total size, each of at least one item."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_words(text: str | None, size: int) -> list[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class Rolling:
    """Hashes of runs of words at every position of several documents laid end to end."""

    _powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __init__(self, texts: list[str | None], lower: bool = False):
        self.h, self.size = hashed_words(texts, lower)
        self.ends = np.cumsum(self.size)
        n = len(self.h)
        up, down = self._grown(n + 1)
        self.down = down
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.h * up[:n], dtype=np.uint64)))
        #: Words from each position to its document's end.
        self.room = np.repeat(self.ends, self.size) - np.arange(n)

    @classmethod
    def _grown(cls, n: int):
        if len(cls._powers[0]) < n:
            m = 1 << n.bit_length()
            cls._powers = [np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(m, b)))) for b in (BASE, INVERSE)]
        return cls._powers

    def runs(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix64((self.sums[start + length] - self.sums[start]) * self.down[start])

    def at_all(self, length: int) -> np.ndarray:
        """The hash at every position; the greatest value where the document ends before."""
        n = len(self.h)
        out = np.full(n, TOP)
        if n >= length:
            out[: n - length + 1] = mix64((self.sums[length:] - self.sums[: n - length + 1]) * self.down[: n - length + 1])
        out[self.room < length] = TOP
        return out
