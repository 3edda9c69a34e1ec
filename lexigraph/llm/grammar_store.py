"""Token-id files compressed by Re-Pair grammars.

Documents are tokenised, put in ascending order of id and written in shards. Within a shard the most
frequent pairs of neighbouring symbols are replaced by new nonterminals, round after round with a
falling count threshold (all pairs at or above it in one round; pairs are counted exactly, by sorting), until no pair occurs min_count
times. A shard stores its rules, their expansion lengths and, for each document, where its symbols
begin and how many tokens they stand for, so one document can be decoded alone. No pair crosses a
document's end.

A shard is one self-contained byte string (see encode_shard); shards are the rows of a Parquet
dataset in the shared folder, so any file system that Spark reaches will do and Spark's commit
protocol covers lost executors.

Null or empty text: the end id alone. Null ids sort first; repeated ids are kept as separate
documents, in order of a hash of their texts. An empty table gives an empty store.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gathered, materialize, new_path, slices, tidy
from .tokens import PieceEncoder, default_path

MAGIC = b"LXRP1\0\0\0"
MULTIPLIER = -7046029254386353131


def places(code: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """1 + the index in `pairs` (ascending) of the pair at each place; 0 for none. Hashed; pairs that share a slot go to another table."""
    out = np.zeros(len(code), np.int32)
    left, turn = np.arange(1, len(pairs) + 1, dtype=np.int32), 0
    bits = max(10, len(pairs).bit_length() + 3)
    while len(left):
        factor = np.int64(MULTIPLIER + 2 * turn * turn)
        slot = np.zeros(1 << bits, np.int32)
        own = ((pairs[left - 1] * factor) >> (64 - bits)) & ((1 << bits) - 1)
        slot[own] = left
        found = slot[((code * factor) >> (64 - bits)) & ((1 << bits) - 1)]
        hit = np.flatnonzero(found)
        hit = hit[pairs[found[hit] - 1] == code[hit]]
        out[hit] = found[hit]
        left, turn = left[slot[own] != left], turn + 1
        if turn == 3 and len(left):  # few are left
            at = np.searchsorted(pairs[left - 1], code)
            at[at == len(left)] = 0
            same = np.flatnonzero(pairs[left - 1][at] == code)
            out[same] = left[at[same]]
            break
    return out


def repair(ids: np.ndarray, ends: np.ndarray, first_rule: int, min_count: int = 8, shrink: int = 16):
    """Grammar of ids (documents end before the positions in `ends`).

    Returns symbols, positions of the documents' ends among them, rules of shape (n, 2) and expansion lengths.
    """
    sym = ids.astype(np.int64)
    last = np.zeros(len(sym), bool)
    last[ends - 1] = True
    rules: list[np.ndarray] = []
    n_rules, threshold = 0, None
    lengths = np.ones(first_rule, np.int64)
    while len(sym) > 1:
        code = (sym[:-1] << 32) | sym[1:]
        code[last[:-1]] = -1  # sorts first
        ranked = np.sort(code)
        edge = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        count = np.diff(np.append(edge, len(ranked)))
        pairs = ranked[edge]
        count[pairs < 0] = 0
        top = int(count.max())
        if top < min_count:
            break
        threshold = max(min_count, min(top, threshold or top) // shrink)
        pairs = pairs[count >= threshold]
        # Only places whose symbols begin and end some frequent pair are looked up.
        begins, closes = np.zeros(first_rule + n_rules, bool), np.zeros(first_rule + n_rules, bool)
        begins[pairs >> 32] = closes[pairs & 0xFFFFFFFF] = True
        may = np.flatnonzero(begins[sym[:-1]] & closes[sym[1:]])
        pair_at = np.zeros(len(sym), np.int32)
        pair_at[may] = places(code[may], pairs)
        hit = np.flatnonzero(pair_at)
        # Among overlapping hits every other one of a run is taken, from its left.
        run = np.concatenate(([True], np.diff(hit) != 1))
        begin = np.maximum.accumulate(np.where(run, hit, 0))
        hit = hit[(hit - begin) % 2 == 0]
        pair = pair_at[hit] - 1
        taken = np.zeros(len(pairs), bool)
        taken[pair] = True
        used = pairs[taken]
        new = np.column_stack((used >> 32, used & 0xFFFFFFFF))
        rules.append(new)
        lengths = np.concatenate((lengths, lengths[new[:, 0]] + lengths[new[:, 1]]))
        sym[hit] = first_rule + n_rules + (np.cumsum(taken) - 1)[pair]
        last[hit] = last[hit + 1]
        n_rules += len(used)
        stay = np.ones(len(sym), bool)
        stay[hit + 1] = False
        sym, last = sym[stay], last[stay]
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return sym, np.flatnonzero(last) + 1, table, lengths[first_rule:]


def expand(sym: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Token ids that the symbols stand for."""
    while True:
        deep = sym >= first_rule
        if not deep.any():
            return sym.astype("<u4")
        at = np.cumsum(1 + deep) - 1 - deep
        out = np.empty(len(sym) + int(deep.sum()), sym.dtype)
        out[at] = sym
        pair = rules[sym[deep] - first_rule]
        out[at[deep]] = pair[:, 0]
        out[at[deep] + 1] = pair[:, 1]
        sym = out


def _three(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _from_three(b, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    out[:, :3] = np.frombuffer(b, np.uint8, 3 * n).reshape(n, 3)
    return out.view("<u4").ravel()


def encode_shard(ids: np.ndarray, ends: np.ndarray, keys: list, first_rule: int, **options) -> bytes:
    """A shard's bytes: magic, five counts and a checksum of the body; then keys (flag and signed 64 bits),
    symbol and token end of each document (64 bits), rules and expansion lengths (32 bits), symbols (24 bits)."""
    sym, sym_ends, rules, lengths = repair(ids, ends, first_rule, **options)
    wide = first_rule + len(rules) >= 1 << 24
    body = b"".join((
        np.array([k is not None for k in keys], np.uint8).tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(),
        sym_ends.astype("<i8").tobytes(), ends.astype("<i8").tobytes(),
        rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), sym.astype("<u4").tobytes() if wide else _three(sym),
    ))
    return MAGIC + struct.pack("<5QI", len(keys), len(rules), len(sym), first_rule, int(wide), zlib.crc32(body)) + body


class Shard:
    """Reads the bytes of encode_shard()."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        n, r, s, self.first_rule, wide, crc = struct.unpack_from("<5QI", data, 8)
        body = memoryview(data)[52:]
        if zlib.crc32(body) != crc:
            raise ValueError("damaged token shard")
        flags, at = np.frombuffer(body, np.uint8, n), n
        keys = np.frombuffer(body, "<i8", n, at)
        self.keys = [int(k) if f else None for k, f in zip(keys, flags)]
        self.sym_ends = np.frombuffer(body, "<i8", n, at + 8 * n)
        self.ends = np.frombuffer(body, "<i8", n, at + 16 * n)
        at += 24 * n
        self.rules = np.frombuffer(body, "<u4", 2 * r, at).reshape(r, 2).astype(np.int64)
        self.lengths = np.frombuffer(body, "<u4", r, at + 8 * r)
        at += 12 * r
        self.symbols = (np.frombuffer(body, "<u4", s, at) if wide else _from_three(body[at:], s)).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document alone."""
        return expand(self.symbols[self.sym_ends[i - 1] if i else 0 : self.sym_ends[i]], self.rules, self.first_rule)

    def slice(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the i-th document; expansion lengths skip what lies outside."""
        sym = self.symbols[self.sym_ends[i - 1] if i else 0 : self.sym_ends[i]]
        ends = np.cumsum(np.where(sym < self.first_rule, 1, self.lengths[np.maximum(sym - self.first_rule, 0)] if len(self.lengths) else 1))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return expand(sym[a:b], self.rules, self.first_rule)[start - before : stop - before]

    def all(self) -> np.ndarray:
        """Ids of all documents: every rule is expanded once, then the symbols' expansions are put in a row."""
        ends = 4 * np.concatenate((np.arange(self.first_rule + 1), self.first_rule + np.cumsum(self.lengths, dtype=np.int64)))
        whole = np.concatenate((np.arange(self.first_rule, dtype="<u4"), expand(self.rules.ravel(), self.rules, self.first_rule)))
        table = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(whole.tobytes())])
        data = table.take(pa.array(self.symbols)).buffers()[2]
        return np.frombuffer(data or b"", "<u4")


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tokenizer: str | None = None, shard_tokens: int = 1_500_000, partition_bytes: int = 24 << 20) -> None:
    """Tokenise docs and write their shards under path in ascending order of id (a long)."""
    where = tokenizer or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(1, -(-size // partition_bytes))
    place = ("id", F.xxhash64("_text"))  # rows that share an id, or have none, are split too
    ordered = (rows.repartitionByRange(parts, *place) if parts > 1 else rows.coalesce(1)).sortWithinPartitions(*place)

    def run(batches):
        from pyspark import TaskContext

        coder = PieceEncoder.shared(where)
        first_rule = coder.tokenizer.get_vocab_size()
        end = np.uint32(end_id).tobytes()
        part, shard, keys, ids, total = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            ends = np.cumsum([len(x) // 4 for x in ids])
            data = encode_shard(np.frombuffer(b"".join(ids), "<u4"), ends, keys, first_rule)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([total], pa.int64()), pa.array([data], pa.binary())],
                ["part", "shard", "n_docs", "n_tokens", "data"],
            )

        for batch in gathered(batches, 1, 6_000_000):
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], 6_000_000):
                for key, coded in zip(names[a:b], coder.encode(texts[a:b])):
                    if total and total + len(coded) // 4 >= shard_tokens:
                        yield close()
                        shard, keys, ids, total = shard + 1, [], [], 0
                    keys.append(key)
                    ids.append(coded + end)
                    total += len(coded) // 4 + 1
        if keys:
            yield close()

    ordered.mapInArrow(tidy(run, "pieces"), "part int, shard int, n_docs long, n_tokens long, data binary").write.option("compression", "uncompressed").parquet(path)


STORE = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("data", T.BinaryType())])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, start, n_tokens, ids binary) of every document in the store; start counts the ids of all documents before it."""
    store = spark.read.schema(STORE).parquet(path)
    from pyspark.sql import Window

    # One row for each shard: sums within a part, then over the few parts.
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    shards = store.select("part", "shard", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    starts = shards.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    starts = materialize(starts, "token-starts")  # as a table of known size Spark can broadcast it, and the shards aren't shuffled

    def run(batches):
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_py())
                ids, ends = shard.all(), shard.ends
                raw = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], 4 * ends)).astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())])
                starts = np.concatenate(([0], ends[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys, pa.int64()), pa.array(base + starts, pa.int64()), pa.array(ends - starts, pa.int64()), raw], ["id", "start", "n_tokens", "ids"])

    return store.join(starts, ["part", "shard"]).select("base", "data").mapInArrow(tidy(run, "pieces"), "id long, start long, n_tokens long, ids binary")


def new_store(docs: DataFrame, **options) -> str:
    """Write a store into the shared folder; its path."""
    path = new_path(docs.sparkSession, "tokens")
    write_store(docs, path, **options)
    return path
