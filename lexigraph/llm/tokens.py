"""Token ids of whole texts with a published byte-level BPE, by the tokenizers library.

A text is cut at single spaces; what the library's pre-tokenizer makes of a piece that starts with
such a space doesn't depend on its neighbours unless white space meets on both sides of the cut, or
the piece holds an added token. The distinct pieces of a batch are split into words with Arrow; words are
encoded once each, by tiktoken's merges where these are proven equal and by the library's model otherwise; pieces are
remembered up to a bound. Other texts are split by the library.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES

#: A space with white space before and after it (or the end): the cut there isn't safe.
UNSAFE_CUT = re.compile(r" (?<=[\s᠎] )(?:[\s᠎]|\Z)")
#: Letters that every Unicode version counts as such, and marks that aren't letters, digits, spaces or apostrophes.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ſ]", r"[!#-&(-/:-@\[-`{-~]"
#: Pieces whose words are plain: letters (after the cut's space), marks, a line end, letters, marks.
PLAIN = rf"^(?P<a>{LETTERS}+)(?P<b>{MARKS}*)(?P<c>\n?)(?P<d>{LETTERS}*)(?P<e>{MARKS}*)$"


#: crc32 of the vocabulary files for which tests prove that FastMerges gives the library's ids.
PROVEN = {874507786}


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in shown):
        shown[b] = chr(256 + i)
    return {c: b for b, c in shown.items()}


SHOWN = {b: c for c, b in byte_of_char().items()}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def binaries(values: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype("<i8")
    return pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(values))])


class FastMerges:
    """BPE by tiktoken: of neighbouring parts those merge whose whole comes first, whichever two parts make it.

    The library's model merges only the listed parts, so both agree if no token has another split into tokens that can meet;
    tests prove this for the vocabularies in PROVEN.
    """

    def __init__(self, data: bytes):
        import tiktoken

        model, back = json.loads(data)["model"], byte_of_char()
        raw = lambda s: bytes(back[c] for c in s)
        rank = {bytes([b]): b for b in range(256)}
        for m in model["merges"]:
            rank.setdefault(b"".join(map(raw, m if isinstance(m, list) else m.split(" "))), len(rank))
        self.id_of = np.array([i for _, i in sorted((rank[raw(s)], i) for s, i in model["vocab"].items() if all(c in back for c in s) and raw(s) in rank)], "<u4")
        if len(self.id_of) != len(rank):
            raise ValueError("a vocabulary without some of its merges")
        self.coder = tiktoken.Encoding("words", pat_str=r"[^\x00]+|\x00", mergeable_ranks=rank, special_tokens={})._core_bpe

    def encode(self, words: pa.Array) -> pa.Array:
        """Ids of each word; no word holds a zero byte."""
        if not len(words):
            return binaries([])
        found = np.frombuffer(self.coder.encode_to_tiktoken_buffer("\0".join(words.to_pylist()) + "\0", set()), np.uint32)
        inner = found != 0
        ends = np.cumsum(inner)[~inner]
        ids = self.id_of[found[inner]]
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer((4 * np.concatenate(([0], ends))).astype("<i8").tobytes()), pa.py_buffer(ids.tobytes())])


class Recent:
    """A bounded memory of strings and their ids, kept as Arrow arrays. When it is full, what the last call asked for stays."""

    def __init__(self, limit: int, limit_bytes: int = 48 << 20):
        self.limit, self.limit_bytes = limit, limit_bytes
        self.forget()

    def forget(self) -> None:
        self.keys, self.values = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def get_all(self, wanted: pa.Array, make) -> pa.Array:
        """Values of all strings of `wanted`, each there once; make(array) gives those of unknown ones."""
        at = pc.index_in(wanted, value_set=self.keys)
        if not at.null_count:
            return self.values.take(at)
        unknown = at.is_null()
        new = wanted.filter(unknown)
        made = make(new)
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[unknown.to_numpy(zero_copy_only=False)] = len(self.keys) + np.arange(len(new))
        keys, values = pa.concat_arrays([self.keys, new]), pa.concat_arrays([self.values, made])
        got = values.take(pa.array(place))
        if len(keys) > self.limit or keys.nbytes + values.nbytes > self.limit_bytes:
            keys, values = wanted, got
        if len(keys) > self.limit or keys.nbytes + values.nbytes > self.limit_bytes:
            self.forget()
        else:
            self.keys, self.values = keys, values
        return got


class PieceEncoder:
    """Encodes texts as the tokenizers library does with add_special_tokens=False."""

    _open: dict = {}

    def __init__(self, path: str, max_entries: int = 350_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added_pattern = re.compile("(" + "|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")")
        with open(path, "rb") as f:
            data = f.read()
        self.fast = FastMerges(data) if zlib.crc32(data) in PROVEN else None
        self.pieces, self.heads = Recent(max_entries), Recent(max_entries // 10)

    @classmethod
    def shared(cls, path: str, **options):
        """One encoder for each worker process, kept across tasks."""
        key = (cls.__name__, path)
        if key not in cls._open:
            cls._open[key] = cls(path, **options)
        return cls._open[key]

    def encode_words(self, words: pa.Array) -> pa.Array:
        """Ids of each of some distinct words of the pre-tokenizer."""
        if self.fast and not pc.any(pc.match_substring(words, "\0")).as_py():
            return self.fast.encode(words)
        run = self.tokenizer.model.tokenize
        return binaries([array("I", [t.id for t in run(w.encode().decode("latin-1").translate(SHOWN))]).tobytes() for w in words.to_pylist()])

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a piece that the library's pre-tokenizer splits."""
        named = pa.array([piece[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)], pa.large_string()).dictionary_encode()
        return b"".join(self.encode_words(named.dictionary).take(named.indices).to_pylist())

    def encode_heads(self, heads: pa.Array) -> pa.Array:
        return binaries([self.encode_piece(h) if h else b"" for h in heads.to_pylist()])

    def encode_pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of each of some distinct pieces with the space before it."""
        fields = pc.extract_regex(pieces, pattern=PLAIN)
        plain = fields.is_valid()
        good = fields.filter(plain)
        parts = [pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), good.field("a"), pa.scalar("", pa.large_string())), *(good.field(f) for f in "bcde")]
        named = pa.concat_arrays([p.cast(pa.large_string()) for p in parts]).dictionary_encode()
        words, n = self.encode_words(named.dictionary), len(good)
        found = pc.binary_join_element_wise(*(words.take(named.indices.slice(k * n, n)) for k in range(5)), pa.scalar(b"", pa.large_binary()))
        if n == len(pieces):
            return found
        other = pieces.filter(pc.invert(plain)).to_pylist()
        order = np.empty(len(pieces), np.int64)
        order[np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(pieces))
        return pa.concat_arrays([found, binaries([self.encode_piece(" " + p) for p in other])]).take(pa.array(order))

    def whole(self, text: str) -> bytes:
        """Ids of a text that may hold added tokens and any white space."""
        parts = [p for p in self.added_pattern.split(text) if p] if self.added else [text]
        return b"".join(array("I", [self.added[p]]).tobytes() if p in self.added else self.encode_piece(p) for p in parts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null is encoded as the empty text."""
        out = [b""] * len(texts)
        safe = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if UNSAFE_CUT.search(t) or any(a in t for a in self.added):
                out[i] = self.whole(t)
            else:
                safe.append(i)
        if not safe:
            return out
        cut = pc.split_pattern(pa.array([texts[i] for i in safe], pa.large_string()), " ")
        begins = cut.offsets.to_numpy()
        flat = cut.values.dictionary_encode()
        code, pieces = flat.indices.to_numpy().copy(), flat.dictionary
        # The first piece of a text has no space before it; it is looked up apart.
        first, place = np.unique(code[begins[:-1]], return_inverse=True)
        code[begins[:-1]] = place + len(pieces)
        table = pa.concat_arrays([self.pieces.get_all(pieces, self.encode_pieces), self.heads.get_all(pieces.take(pa.array(first)), self.encode_heads)])
        taken = table.take(pa.array(code))
        _, offsets, ids = taken.buffers()
        ends = np.frombuffer(offsets, "<i8", len(taken) + 1)[begins].tolist()
        view = memoryview(ids or b"")
        for i, a, b in zip(safe, ends, ends[1:]):
            out[i] = bytes(view[a:b])
        return out


CACHES["pieces"] = PieceEncoder._open.clear
