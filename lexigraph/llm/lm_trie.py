r"""Language-model scoring with an Elias-Fano n-gram trie.

Training counts every n-gram of the training texts (A-Z lower-cased words [^\x20\x09-\x0D]+ and an end
token that also opens each text). Level 1 holds all words, by a 63-bit hash in ascending order, Elias-Fano coded; a word's
rank there is its number. Level n > 1 holds the n-grams seen at least `min_count` times, as
(parent node of level n - 1, word). A level is a few shards, ranges of such pairs; each is a file that
workers map into memory:

* pointers: where each parent's successors begin, a monotone sequence, Elias-Fano coded;
* successors: word numbers side by side in as many bits as the vocabulary asks for, ascending within a parent;
* smoothed probabilities: log10 of (count - discount) / count of context, and of each context's remaining weight,
  quantised to 16 bits.

A query reads its context's pointer and the next one and searches the successor within that range. Counts lie in files of their own;
those of n-grams serve building only. Probabilities are
interpolated: p(w | c) = kept share + weight(c) * p(w | shorter c), down to (c + 1) / (N + V + 1) for words.

Counting is combined per task with numpy and shuffled once a level, as packed blobs dealt by ranges of codes that hold even sums of
their parents' counts; a range becomes a shard. A frequent word or context may fill several ranges, so none makes a large task. The model grows with the corpus; nothing is broadcast:
shards lie in the shared folder, where workers map them (a copy is fetched first if the folder isn't a mounted one).

Null or empty text: the end token alone. Rows with a null id count as training rows. Repeated ids are
separate rows. Very long words and texts are kept whole. Extra columns are ignored. An empty table gives no rows; with no
training rows every word is unknown.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import coded_words, delete_path, gathered, new_path, slices, tidy

END = 0
LOG_STEP = 1 / 4096


# Files of arrays in the shared folder


def _plain(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def save_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays as one file that appears whole or not at all."""
    head, at, parts = {}, 0, []
    for k, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[k] = (a.dtype.str, len(a), at)
        pad = -a.nbytes % 64
        parts.append(a.tobytes() + bytes(pad))
        at += a.nbytes + pad
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    data = b"".join([len(text).to_bytes(8, "little"), text, *parts])
    path = _plain(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
    else:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(uri)
        with where.open_output_stream(path) as f:
            f.write(data)


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    path = _plain(uri)
    if not path:
        from pyarrow import fs

        where, far = fs.FileSystem.from_uri(uri)
        path = os.path.join(tempfile.mkdtemp(prefix="lm-"), "level")
        with where.open_input_stream(far) as src, open(path, "wb") as dst:
            while block := src.read(1 << 24):
                dst.write(block)
    raw = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    return {k: raw[8 + n + at : 8 + n + at + np.dtype(d).itemsize * size].view(d).view(np.ndarray) for k, (d, size, at) in head.items()}


# Elias-Fano sequences

GROUP = 64
#: Place of the k-th one bit, and of the k-th zero bit, in each byte.
ONE_AT = np.array([[next((b for b in range(8) if v >> b & 1 and bin(v & ((1 << (b + 1)) - 1)).count("1") == k + 1), 8) for k in range(8)] for v in range(256)], np.uint8)
ZERO_AT = np.array([[next((b for b in range(8) if not v >> b & 1 and bin(~v & ((1 << (b + 1)) - 1)).count("1") == k + 1), 8) for k in range(8)] for v in range(256)], np.uint8)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values below 2^bits side by side in 64-bit words."""
    out = np.zeros((len(values) * bits >> 6) + 2, np.uint64)
    if bits and len(values):
        v = values.astype(np.uint64)
        bit = np.arange(len(v), dtype=np.uint64) * np.uint64(bits)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[first]] = np.bitwise_or.reduceat(v << off, first)
        over = np.flatnonzero(off > 64 - bits)
        out[word[over] + 1] |= v[over] >> (np.uint64(64) - off[over])
    return out


def packed_at(words: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), np.uint64)
    bit = i.astype(np.uint64) * np.uint64(bits)
    word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    x, y = words[word] >> off, (words[word + 1] << (np.uint64(63) - off)) << np.uint64(1)
    return (x | y) & np.uint64((1 << bits) - 1)


def ef_build(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of non-negative integers: low bits packed, high bits in unary with a directory of bucket groups."""
    v, n = values.astype(np.uint64), len(values)
    top = int(v[-1]) if n else 0
    low_bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
    low = pack(v & np.uint64((1 << low_bits) - 1), low_bits)
    high = (v >> np.uint64(low_bits)).astype(np.int64)
    buckets = (top >> low_bits) + 1
    bits = np.zeros(-(-(n + buckets + 1) // 64) * 64 + 64, np.uint8)
    bits[high + np.arange(n)] = 1
    groups = np.arange(-(-buckets // GROUP) + 1) * GROUP
    every = np.arange(0, n, GROUP)
    return {f"{name}.ones": high[every] + every, f"{name}.low": low, f"{name}.high": np.packbits(bits, bitorder="little").view("<u8"), f"{name}.groups": np.searchsorted(high, groups).astype(np.int64), f"{name}.shape": np.array([n, low_bits, buckets], np.int64)}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.low, self.high, self.groups, self.ones = (arrays[f"{name}.{k}"] for k in ("low", "high", "groups", "ones"))
        self.n, self.bits, self.buckets = (int(x) for x in arrays[f"{name}.shape"])

    def lows(self, i: np.ndarray) -> np.ndarray:
        return packed_at(self.low, self.bits, i)

    def bucket_start(self, bucket: np.ndarray) -> np.ndarray:
        """Index of the first value whose high part is at least `bucket` (buckets in range)."""
        group = bucket // GROUP
        left = bucket - group * GROUP  # zeros still to pass
        word_at = self.groups[group] + group * GROUP  # the bit where the group starts
        word = word_at >> 6
        off = (word_at & 63).astype(np.uint64)
        bits = self.high[word] | ((np.uint64(1) << off) - np.uint64(1))  # bits before the group count as ones
        zeros = 64 - np.bitwise_count(bits).astype(np.int64)
        go = np.flatnonzero(zeros < left)
        while len(go):
            left[go] -= zeros[go]
            word[go] += 1
            bits[go] = self.high[word[go]]
            zeros[go] = 64 - np.bitwise_count(bits[go]).astype(np.int64)
            go = go[zeros[go] < left[go]]
        pos = word << 6
        rest, chunk = left.copy(), bits
        for width in (32, 16, 8):  # halve the word until the byte with the zero is left
            z = width - np.bitwise_count(chunk & np.uint64((1 << width) - 1)).astype(np.int64)
            skip = z < rest
            rest -= z * skip
            step = skip * width
            pos += step
            chunk = chunk >> step.astype(np.uint64)
        last = ZERO_AT[(chunk & np.uint64(255)).astype(np.int64), np.maximum(rest - 1, 0)]
        after = np.where(left > 0, pos + last + 1, word_at)  # just past the zero that closes the bucket before
        return after - bucket

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i: the i-th one bit, sought from the nearest sampled one on."""
        at = self.ones[i // GROUP]
        left = i % GROUP  # ones still to pass
        word = at >> 6
        bits = self.high[word] >> (at & 63).astype(np.uint64) << (at & 63).astype(np.uint64)
        ones = np.bitwise_count(bits).astype(np.int64)
        go = np.flatnonzero(ones <= left)
        while len(go):
            left[go] -= ones[go]
            word[go] += 1
            bits[go] = self.high[word[go]]
            ones[go] = np.bitwise_count(bits[go])
            go = go[ones[go] <= left[go]]
        pos = word << 6
        for width in (32, 16, 8):  # halve the word until the byte with the one is left
            k = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            skip = k <= left
            left -= k * skip
            step = skip * width
            pos += step
            bits = bits >> step.astype(np.uint64)
        pos += ONE_AT[(bits & np.uint64(255)).astype(np.int64), left]
        return ((pos - i).astype(np.uint64) << np.uint64(self.bits) | self.lows(i)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value x, or -1. Successor search by halving within the bucket of x's high part (a frequent context fills its buckets)."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        x = x.astype(np.uint64)
        bucket = (x >> np.uint64(self.bits)).astype(np.int64)
        live = np.flatnonzero(bucket < self.buckets)
        want = x[live] & np.uint64((1 << self.bits) - 1)
        low = self.bucket_start(bucket[live])
        bit = low + bucket[live]
        for _ in range(3):  # most buckets hold one or two values
            inside = (self.high[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            live, want, low, bit = live[inside], want[inside], low[inside], bit[inside]
            value = self.lows(low)
            hit = value == want
            out[live[hit]] = low[hit]
            go = value < want
            live, want, low, bit = live[go], want[go], low[go] + 1, bit[go] + 1
        high = self.bucket_start(bucket[live] + 1)
        some = low < high
        live, want, low, high = live[some], want[some], low[some], high[some]
        while len(live):
            mid = (low + high) >> 1
            value = self.lows(mid)
            hit = value == want
            out[live[hit]] = mid[hit]
            below = value < want
            low, high = np.where(below, mid + 1, low), np.where(below, high, mid)
            go = ~hit & (low < high)
            live, want, low, high = live[go], want[go], low[go], high[go]
        return out


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit code of log10 of a probability in (0, 1]; 65535 for zero."""
    return np.where(p > 0, np.clip(np.rint(-np.log10(np.maximum(p, 1e-15)) / LOG_STEP), 0, 65_000), 65_535).astype(np.uint16)


LEVELS = np.append(10.0 ** (-np.arange(65_535) * LOG_STEP), 0.0)


# Counting


def pack_counts(code: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted codes as differences of the least whole number of bytes; counts in a byte each, larger ones apart."""
    step = np.diff(code, prepend=np.int64(0)).astype("<u8")
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    big = count[count >= 255]
    return b"".join([np.array([len(code), width, len(big)], "<i8").tobytes(), step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), np.minimum(count, 255).astype(np.uint8).tobytes(), big.astype("<i8").tobytes()])


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, big = np.frombuffer(data, "<i8", 3).tolist()
    step = np.zeros((n, 8), np.uint8)
    step[:, :width] = np.frombuffer(data, np.uint8, n * width, 24).reshape(n, width)
    count = np.frombuffer(data, np.uint8, n, 24 + n * width).astype(np.int64)
    count[count == 255] = np.frombuffer(data, "<i8", big, 24 + n * width + n)
    return np.cumsum(step.view("<u8").ravel().astype(np.int64)), count


def summed(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code = code[order]
    edge = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    return code[edge], np.add.reduceat(count[order], edge) if len(edge) else np.zeros(0, np.int64)


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending 63-bit hashes of the distinct tokens, the place of every token among them, with END before and after each text, and where each text's tokens begin."""
    table, code, size = coded_words(texts, lower=True)
    unique, place = np.unique(np.concatenate((np.zeros(1, np.uint64), np.maximum(table >> np.uint64(1), 1))), return_inverse=True)  # END is 0
    size = size + 2
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.int64)
    inner = np.ones(len(out), bool)
    inner[begin] = inner[begin + size - 1] = False
    out[inner] = place[1:][code]
    return unique.view(np.int64), out, begin


class Model:
    """Mapped levels. `spec`: the vocabulary's size, N, and each level's shards (uri, first key, nodes before it) and split contexts."""

    _open: dict[str, Model] = {}

    def __init__(self, spec: dict):
        self.spec, self.total, self.words = spec, spec["total"], spec["words"]
        self.levels = [[(map_arrays(uri), base) for uri, _, base in level["shards"]] for level in spec["levels"]]
        self.first = [np.array([f for _, f, _ in level["shards"]], np.int64) for level in spec["levels"]]
        self.sets = [[EliasFano(a, "pointers" if n else "keys") for a, _ in shards] for n, shards in enumerate(self.levels)]
        # Weights of the contexts at the shards' borders: pairs that come before a shard's first one fall to the shard before.
        self.border = []
        for n, level in enumerate(spec["levels"]):
            at = {int(a["parent"][0]): int(a["weight"][0]) for a, _ in self.levels[n]} if n else {}
            at |= {k: int(quantise(np.array([w]))[0]) for k, w in level["split"].items()}
            keys = np.array(sorted(at), np.int64)
            self.border.append((keys, np.array([at[k] for k in keys.tolist()], np.uint16)))
        self.word_bits = max(1, (self.words - 1).bit_length())
        self._counts: dict[str, dict[str, np.ndarray]] = {}
        self._recent = np.array([-1], np.int64), np.array([-1], np.int64)

    @classmethod
    def opened(cls, spec: dict) -> Model:
        """One model for each worker process."""
        key = spec["name"] + str(len(spec["levels"]))
        if key not in cls._open:
            cls._open.clear()
            cls._open[key] = cls(spec)
        return cls._open[key]

    def _by_shard(self, level: int, key: np.ndarray):
        """(shard, slice) of ascending keys."""
        cut = np.searchsorted(key, self.first[level]).tolist() + [len(key)]
        for s, (a, b) in enumerate(zip(cut, cut[1:])):
            if a < b:
                yield s, slice(a, b)

    def word_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of ascending hashes; -1 for unknown words. What recent calls found is remembered up to a bound."""
        known, numbers = self._recent
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        old = known[at] == hashes
        out = np.where(old, numbers[at], -1)
        new = hashes[~old]
        if len(new):
            out[~old] = found = self._find_words(new)
            if len(known) + len(new) > 1_000_000:
                known, numbers, new, found = known[at[old]], numbers[at[old]], hashes[~old], out[~old]
            both, of = np.concatenate((known, new)), np.concatenate((numbers, found))
            order = np.argsort(both, kind="stable")
            self._recent = both[order], of[order]
        return out

    def _find_words(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        for s, pick in self._by_shard(0, hashes):
            i = self.sets[0][s].find(hashes[pick])
            out[pick] = np.where(i >= 0, i + self.levels[0][s][1], -1)
        return out

    def counts(self, level: int, node: np.ndarray) -> np.ndarray:
        """Training counts of nodes, from the files beside the shards."""
        out = np.zeros(len(node), np.int64)
        bases = np.array([b for _, b in self.levels[level]], np.int64)
        which = np.searchsorted(bases, node, "right") - 1
        for s, (uri, _, base) in enumerate(self.spec["levels"][level]["shards"]):
            pick = np.flatnonzero((which == s) & (node >= 0))
            if len(pick):
                if uri not in self._counts:
                    folder, _, name = uri.rpartition("/")
                    self._counts[uri] = map_arrays(f"{folder}-counts/{name}")
                kept, i = self._counts[uri], node[pick] - base
                n = kept["low"][i].astype(np.int64)
                big = np.flatnonzero(n == 255)
                n[big] = kept["high"][np.searchsorted(kept["at"], i[big])]
                out[pick] = n
        return out

    def successors(self, level: int, parent: np.ndarray, word: np.ndarray, values: bool = True):
        """For pairs (node of the level above, word number; -1: none): node or -1 and, with values, kept share and the context's weight."""
        out = (np.full(len(parent), -1, np.int64), np.zeros(len(parent)), np.ones(len(parent)))[: 1 + 2 * values]
        known = np.flatnonzero(parent >= 0)
        # Each distinct pair is looked up once, in order, so that neighbours touch the same pages.
        pair, back = np.unique(parent[known] * (self.words + 1) + word[known] + 1, return_inverse=True)
        parent, word = pair // (self.words + 1), pair % (self.words + 1) - 1
        node, share, weight = np.full(len(pair), -1, np.int64), np.zeros(len(pair)), np.ones(len(pair))
        # A shard begins with a pair; the pairs before the first shard's have no successors.
        for s, pick in self._by_shard(level, parent * self.words + np.maximum(word, 0)):
            arrays, base = self.levels[level][s]
            pointers, packed = self.sets[level][s], arrays["words"]
            own = parent[pick] - int(arrays["parent"][0])
            inside = np.flatnonzero((own >= 0) & (own < pointers.n - 1))
            own, wanted, at = own[inside], word[pick][inside], inside + pick.start
            new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(own))))
            # The context's range of successors, between its pointer and the next one.
            low, high = pointers.get(own[new])[of], pointers.get(own[new] + 1)[of]
            if values:
                weight[at] = LEVELS[arrays["weight"][own[new]]][of]
            live = np.flatnonzero((low < high) & (wanted >= 0))
            at, want, low, high = at[live], wanted[live].astype(np.uint64), low[live], high[live]
            while len(at):
                mid = (low + high) >> 1
                value = packed_at(packed, self.word_bits, mid)
                hit = value == want
                node[at[hit]] = mid[hit] + base
                if values:
                    share[at[hit]] = LEVELS[arrays["share"][mid[hit]]]
                below = value < want
                low, high = np.where(below, mid + 1, low), np.where(below, high, mid)
                go = ~hit & (low < high)
                at, want, low, high = at[go], want[go], low[go], high[go]
        keys, codes = self.border[level]
        if len(keys) and values:
            i = np.minimum(np.searchsorted(keys, parent), len(keys) - 1)
            same = keys[i] == parent
            weight[same] = LEVELS[codes[i[same]]]
        for whole, part in zip(out, (node, share, weight)):
            whole[known] = part[back]
        return out if values else (*out, None, None)

    def chain(self, number: np.ndarray, begin: np.ndarray, upto: int, values: bool = True):
        """Nodes of the n-grams that end at each token, for n = 1 .. upto, with their shares and weights."""
        start = np.zeros(len(number), bool)
        start[begin] = True
        node, since = number, np.arange(len(number)) - np.maximum.accumulate(np.where(start, np.arange(len(number)), 0))
        yield node, None, None
        for n in range(2, upto + 1):
            parent = np.concatenate(([-1], node[:-1]))
            parent[since < n - 1] = -1
            node, share, weight = self.successors(n - 1, parent, number, values)
            yield node, share, weight


def _blobs(docs: DataFrame, spec: dict | None, level: int, cuts: np.ndarray, held: int = 3_000_000) -> DataFrame:
    """Rows (bucket, data): counts of level `level` codes (0: word hashes; else parent node * words + word). Bucket k has the codes from cuts[k] on."""

    def run(batches):
        model = Model.opened(spec) if spec else None
        codes: list[np.ndarray] = []
        total = 0

        def flush():
            code, count = np.unique(np.concatenate(codes), return_counts=True)
            edge = [0, *np.searchsorted(code, cuts[1:]).tolist(), len(code)]
            rows = [(b, pack_counts(code[x:y], count[x:y])) for b, (x, y) in enumerate(zip(edge, edge[1:])) if y > x]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["bucket", "data"])

        for batch in gathered(batches, 0, 7_000_000):
            texts = batch.column(0).to_pylist()
            for a, b in slices([len(t or "") for t in texts], 6_000_000):
                unique, token, begin = tokens_of(texts[a:b])
                start = np.zeros(len(token), bool)
                start[begin] = True
                if not level:
                    code = unique[token[~start]]
                else:
                    number = model.word_numbers(unique)[token]
                    node = number
                    for node, _, _ in model.chain(number, begin, level, values=False):
                        pass
                    ok = np.flatnonzero(~start)
                    if level > 1:  # the parent must lie within the text
                        far = np.arange(len(number)) - np.maximum.accumulate(np.where(start, np.arange(len(number)), 0))
                        ok = ok[far[ok] >= level]
                    ok = ok[node[ok - 1] >= 0]
                    code = node[ok - 1] * model.words + number[ok]
                codes.append(code)
                total += len(code)
                if total >= held:
                    yield flush()
                    codes, total = [], 0
        if total:
            yield flush()

    return docs.mapInArrow(tidy(run), "bucket int, data binary")


POINTS = 64


def _write_level(blobs: DataFrame, spec: dict | None, uri: str, buckets: int, min_count: int, discount: float, last: bool) -> tuple[dict, int, int, np.ndarray]:
    """Sum each bucket's counts and write them as a shard: the level's shards (uri, first key, nodes before them) and split contexts, its
    nodes, the sum of counts, and points (counts before, node) at which the next level can be cut.

    The successors of a frequent context may fill several shards; its weight is then made from all of them.
    """
    words = spec["words"] if spec else 1
    word_bits = max(1, (words - 1).bit_length())

    def write(bucket: int, parts: list[bytes]):
        pairs = [unpack_counts(d) for d in parts]
        code, n = summed(np.concatenate([c for c, _ in pairs]), np.concatenate([k for _, k in pairs]))
        del pairs
        code, n = code[n >= min_count], n[n >= min_count]
        if not len(code):
            return None
        ends, left = [0, 0], [0.0, 0.0]
        if spec is None:
            arrays = ef_build(code, "keys")
        else:
            parent, word = code // words, code % words
            begin = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
            context = parent[begin]
            of = Model.opened(spec).counts(len(spec["levels"]) - 1, context)
            size = np.diff(np.append(begin, len(code)))
            share = (n - discount) / np.repeat(of, size)
            taken = np.add.reduceat(share, begin)
            ends, left = [int(context[0]), int(context[-1])], [float(taken[0]), float(taken[-1])]
            # Pointers and weights of all parents from the shard's first to its last one, those without successors among them.
            place = context - context[0]
            per_parent = np.zeros(place[-1] + 1, np.int64)
            per_parent[place] = size
            weight = np.ones(place[-1] + 1)
            weight[place] = np.maximum(1 - taken, 0)
            arrays = ef_build(np.concatenate(([0], np.cumsum(per_parent))), "pointers")
            arrays |= {"words": pack(word, word_bits), "share": quantise(share), "weight": quantise(weight), "parent": context[:1]}
        name = f"{uri}/shard-{bucket:06d}"
        save_arrays(name, arrays)
        points = [0.0]
        if not last:  # the last level is no context
            save_arrays(f"{uri}-counts/shard-{bucket:06d}", {"low": np.minimum(n, 255).astype(np.uint8), "at": np.flatnonzero(n >= 255), "high": n[n >= 255]})
            before = np.cumsum(n) - n
            mass = np.arange(POINTS) * (int(n.sum()) / POINTS)
            i = np.searchsorted(before, mass, "right") - 1
            points = (i + (mass - before[i]) / n[i]).tolist()
        return bucket, name, int(code[0]), len(code), int(n.sum()), *ends, *left, points

    names = ["bucket", "uri", "first", "n", "total", "a", "b", "taken_a", "taken_b", "points"]
    kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5, *[pa.float64()] * 2, pa.list_(pa.float64())]

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(b, []).append(d)
        for b in list(held):
            row = write(b, held.pop(b))
            if row:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

    dealt = blobs.repartition(buckets, "bucket")
    made = sorted(dealt.mapInArrow(tidy(run), "bucket int, uri string, first long, n long, total long, a long, b long, taken_a double, taken_b double, points array<double>").collect())  # a row for each shard
    base, mass, out, taken, points = 0, 0, [], {}, []
    for r in made:
        out.append((r.uri, r.first, base))
        points += [(mass + k * r.total / len(r.points), base + p) for k, p in enumerate(r.points)]
        base += r.n
        mass += r.total
        for context, x in {r.a: r.taken_a, r.b: r.taken_b}.items():
            taken.setdefault(context, []).append(x)
    split = {k: max(1 - sum(v), 0.0) for k, v in taken.items() if len(v) > 1} if spec else {}
    return {"shards": out, "split": split}, base, mass, np.array([*points, (mass, base)])


def train(docs: DataFrame, text_col: str = "text", order: int = 3, min_count: int = 2, discount: float = 0.6, shard_tokens: int = 2_000_000) -> dict:
    """Count and write the levels; the model's description. Every text counts in full; a shard is made of some `shard_tokens` tokens."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    uri = new_path(texts.sparkSession, "lm")
    buckets = max(1, -(-size // (6 * shard_tokens)))
    cuts = np.array([(k << 63) // buckets for k in range(buckets)], np.int64)  # hashes are spread evenly
    level, words, total, points = _write_level(_blobs(texts, None, 0, cuts), None, f"{uri}/level-1", buckets, 1, discount, order == 1)
    spec = {"name": uri, "words": max(words, 1), "total": total, "distinct": words, "levels": [level]}
    for n in range(1, order):
        # A parent's count bounds its successors, so cuts at even sums of counts give shards of even size.
        buckets = max(1, -(-total // shard_tokens))
        at = np.interp(np.arange(buckets) * (points[-1, 0] / buckets), points[:, 0], points[:, 1])
        cuts = np.floor(at).astype(np.int64) * spec["words"] + np.floor((at - np.floor(at)) * spec["words"]).astype(np.int64)
        level, nodes, _, points = _write_level(_blobs(texts, spec, n, cuts), spec, f"{uri}/level-{n + 1}", buckets, min_count, discount, n + 1 == order)
        if not nodes:
            break
        spec = spec | {"levels": [*spec["levels"], level]}
        if n > 1:
            delete_path(texts.sparkSession, f"{uri}/level-{n}-counts")  # words' counts serve scoring too
    return spec


def score(docs: DataFrame, spec: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, n_known, base_score, score): log10 probabilities of each text, its end included."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        model = Model.opened(spec)
        for batch in gathered(batches, 1, 7_000_000):
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], 6_000_000):
                unique, back, begin = tokens_of(texts[a:b])
                number = model.word_numbers(unique)
                count = model.counts(0, number)[back]
                base = (count + 1) / (model.total + spec["distinct"] + 1)
                p = base
                for _, share, weight in model.chain(number[back], begin, len(spec["levels"])):
                    if share is not None:
                        p = share + weight * p
                size = np.diff(np.append(begin, len(back)))
                count[begin] = 0
                logs = [np.log10(base), np.log10(np.maximum(p, 1e-300))]
                for x in logs:
                    x[begin] = 0  # the opening token isn't scored
                sums = [np.add.reduceat(x, begin) for x in (count > 0, *logs)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size - 1), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["id", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(tidy(run), f"id {rows.schema[0].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("id", id_col)


def train_and_score(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    spec = train(docs.where(is_training), text_col, **options)
    return score(docs, spec, id_col, text_col).withColumn("train_tokens", F.lit(spec["total"]).cast("long"))
