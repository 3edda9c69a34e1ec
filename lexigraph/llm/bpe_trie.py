"""Byte-level BPE by depth-first traversal of a trie of distinct words.

The state of a trie node is the last token of the encoding of the node's string. For a string p and
a next byte, exactly one token t that ends the longer string is compatible with the last token of
what precedes t, and it is the last token there; so states pass from parent to child and a prefix
that many words share is encoded once. A word's ids are read back from the states on its path.

The trie of each batch of new words is kept as its sorted word list: the common prefix with the
word before is the part of the path that the traversal has already visited.

Null text encodes like the empty text: no ids. Repeated and very long texts are encoded in full;
strings of added tokens in a text become their ids, as in the tokenizers library. Null and repeated
document ids pass through; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy
from .tokens import PieceEncoder, binaries, byte_of_char, default_path

class TrieBPE:
    """Merges of a tokenizer.json with a byte-level BPE model, ready for the traversal."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_of_char()
        raw = lambda s: bytes(back[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in back for c in s)}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in vocab.items()}
        for t in spec.get("added_tokens", ()):
            self.bytes_of[t["id"]] = t["content"].encode()
        # Rank 0 holds single bytes; a merged token carries the order of the merge that makes it.
        self.rank: dict[int, int] = {vocab[bytes([b])]: -1 for b in range(256) if bytes([b]) in vocab}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.merged[pair] = r
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = r, pair
        self.fits: dict[tuple[int, int], bool] = {}
        # Tokens by their bytes read backwards: node -> byte -> node; node 0 is the root.
        self.step: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for b, i in vocab.items():
            if i in self.rank and self.reachable(i):
                node = 0
                for x in reversed(b):
                    if x not in self.step[node]:
                        self.step[node][x] = len(self.step)
                        self.step.append({})
                        self.token_at.append(-1)
                    node = self.step[node][x]
                self.token_at[node] = i
        self.size = {i: len(b) for b, i in vocab.items()}

    def reachable(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as the token."""
        return token not in self.parts or (self.reachable(self.parts[token][0]) and self.reachable(self.parts[token][1]) and self.compatible(*self.parts[token], self.rank[token]))

    def compatible(self, left: int, right: int, before: int = 1 << 60) -> bool:
        """Whether no merge crosses the border of two neighbouring tokens before the merge of rank `before`.

        Both tokens are taken apart in reverse order of their merges; at each moment the two symbols at
        the border must not merge earlier than the symbol that is taken apart next was made.
        """
        merged, rank, parts = self.merged, self.rank, self.parts
        limit = before
        while True:
            r = merged.get((left, right))
            if r is not None and r < limit:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            # The later merge is undone first. Of equal ones the right one is: BPE merges from the left.
            if a > b:
                limit, left = a, parts[left][1]
            else:
                # At equal rank the border merge would have come first if it stood further left.
                limit, right = b + 1, parts[right][0]

    def encode_words(self, words) -> dict[bytes, list[int]]:
        """Ids of each distinct word."""
        out: dict[bytes, list[int]] = {}
        step, token_at, size, fits = self.step, self.token_at, self.size, self.fits
        if len(fits) > 500_000:
            fits.clear()
        path, last, ids_at, before = b"", [-1], [()], b""
        for word in sorted(words):
            # Back up to the common prefix, then go down.
            n = min(len(word), len(before))
            depth = n if word[:n] == before[:n] else next(i for i in range(n) if word[i] != before[i])
            del last[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                node, at = 0, end
                while True:
                    at -= 1
                    node = step[node].get(word[at], -1)
                    if node < 0:
                        raise ValueError(f"no encoding of {word[:end]!r}")
                    t = token_at[node]
                    if t >= 0:
                        if at == 0:
                            break
                        pair = (last[at], t)
                        ok = fits.get(pair)
                        if ok is None:
                            ok = fits[pair] = self.compatible(*pair)
                        if ok:
                            break
                    if at == 0:
                        raise ValueError(f"no encoding of {word[:end]!r}")
                last.append(t)
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= size[last[end]]
            out[word] = ids[::-1]
            before = word
        return out


class TrieEncoder(PieceEncoder):
    """PieceEncoder whose ids come from the trie; the library only splits texts into words."""

    def __init__(self, path: str, **options):
        super().__init__(path, **options)
        self.trie = TrieBPE(path)

    def encode_words(self, words: pa.Array) -> pa.Array:
        raw = words.cast(pa.large_binary()).to_pylist()
        ids = self.trie.encode_words(raw)
        return binaries([array("I", ids[w]).tobytes() for w in raw])


class ByteTable:
    """The bytes of every id of a tokenizer.json, by place; made without the merges."""

    _open: dict[str, ByteTable] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_of_char()
        of = {i: bytes(back[c] for c in s) for s, i in spec["model"]["vocab"].items() if all(c in back for c in s)}
        of |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", ())}
        self.table = pa.array([of.get(i) for i in range(max(of) + 1)], pa.large_binary())

    @classmethod
    def shared(cls, path: str) -> ByteTable:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of documents laid end to end, as UTF-8 with replacement characters."""
        raw = self.table.take(pa.array(ids))
        _, offsets, data = raw.buffers()
        at = np.frombuffer(offsets, "<i8", len(raw) + 1)[np.concatenate(([0], ends))].tolist()
        view = memoryview(data or b"")
        return [str(view[x:y], "utf-8", "replace") for x, y in zip(at, at[1:])]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_decoded: bool = False) -> DataFrame:
    """Rows (id, ids array<int>), one for each input row; with_decoded: also `decoded`, made from the ids in the same pass."""
    path = tokenizer or default_path()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        coder = TrieEncoder.shared(path)
        for batch in batches:
            lengths = [n or 0 for n in pc.binary_length(batch.column(1)).to_pylist()]
            for a, b in slices(lengths, 2_500_000):
                coded = coder.encode(batch.column(1).slice(a, b - a).to_pylist())
                ends = np.cumsum([len(x) // 4 for x in coded])
                flat = np.frombuffer(b"".join(coded), "<i4")
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype("<i4")), pa.array(flat))
                decoded = [pa.array(ByteTable.shared(path).texts(flat, ends), pa.string())] if with_decoded else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, *decoded], ["id", "ids", "decoded"][: 2 + len(decoded)])

    schema = f"id {rows.schema[0].dataType.simpleString()}, ids array<int>" + ", decoded string" * with_decoded
    return rows.mapInArrow(tidy(run, "pieces"), schema).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """Rows (id, ids, decoded): the bytes of all ids, as UTF-8 with replacement characters. Null ids decode to the empty text."""
    path = tokenizer or default_path()
    rows = coded.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        table = ByteTable.shared(path)
        for batch in batches:
            lists = batch.column(1)
            counts = [n or 0 for n in lists.value_lengths().to_pylist()]
            for a, b in slices(counts, 1_000_000):
                texts = table.texts(lists.slice(a, b - a).flatten().to_numpy(), np.cumsum(counts[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists.slice(a, b - a), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    return rows.mapInArrow(tidy(run, "pieces"), f"id {rows.schema[0].dataType.simpleString()}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
