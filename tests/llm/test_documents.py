"""Document operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import zlib
from array import array
from collections import Counter

import pytest
import xxhash
from tokenizers import Tokenizer

from lexigraph.llm import bpe_trie, common, grammar_store, packing, simhash, substring_dedup, tokens

TABLE = "/root/testdata/sf0.001/documents.parquet"
COLUMNS = "doc_id long, text string, id string, ids string, start string, row string, fp string, n_words string, key string, unit string"
LONG = " ".join(f"w{i % 977}" for i in range(12_000))
EDGE = [None, "", " \n\t", "one", "one two", "a b c", "ünï cödé  漢字\n\n x", "<|endoftext|> and <|endoftext|>", LONG, LONG, "  lead", "trail  ", "tab\t \tx", "\x1c \x1c", "a \n b", "A B C", "It's 12'th... ²½ ſ"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(TABLE).select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(EDGE)]
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], COLUMNS).repartition(3), dict(rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode_match_the_library(docs, empty, library):
    df, texts = docs
    tok = Tokenizer.from_file(tokens.default_path())
    got = {r.doc_id: r for r in bpe_trie.decode(bpe_trie.encode(df)).collect()}
    assert got.keys() == texts.keys()
    assert {r.doc_id: r for r in bpe_trie.encode(df, with_decoded=True).collect()} == got
    for k, t in texts.items():
        assert got[k].ids == library(t)
        assert got[k].decoded == tok.decode(got[k].ids, skip_special_tokens=False) == (t or "")
    assert bpe_trie.decode(bpe_trie.encode(empty)).count() == 0


def test_pieces_are_remembered_within_bounds(library):
    import random

    rnd = random.Random(11)
    alphabet = ["a", "B", "é", "Ġ", " ", "  ", "\n", "\t", "'s", "'", "12", "!", "?!", "漢", "\u0301", "²", "\xa0", "<|endoftext|>", "the", "ing", " of"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(40))) for _ in range(3000)]
    for kind in (tokens.PieceEncoder, bpe_trie.TrieEncoder):
        coder = kind(tokens.default_path(), max_entries=500)
        for a in range(0, len(texts), 300):
            assert [list(array("I", x)) for x in coder.encode(texts[a : a + 300])] == [library(t) for t in texts[a : a + 300]]
        assert len(coder.pieces.keys) <= 500


def test_fast_merges_are_the_librarys():
    """No token has a second split into tokens that can meet before it is made, so both ways of merging agree."""
    trie = bpe_trie.TrieBPE(tokens.default_path())
    vocab = {b: i for i, b in trie.bytes_of.items()}
    assert tokens.PieceEncoder(tokens.default_path()).fast
    for i, b in trie.bytes_of.items():
        for cut in range(1, len(b)) if i in trie.parts else ():
            x, y = vocab.get(b[:cut]), vocab.get(b[cut:])
            if x in trie.rank and y in trie.rank and (x, y) != trie.parts[i]:
                assert not (trie.reachable(x) and trie.reachable(y) and trie.compatible(x, y, trie.rank[i])), b


def test_pieces_are_powers_of_two_and_whole(docs, empty, library):
    df, texts = docs
    rows = packing.pack(df).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    by = {}
    for r in rows:
        assert r.length <= 1024 and r.length & (r.length - 1) == 0 and r.offset == 0 and len(r.ids) == 4 * r.length and 1 << r.bucket == r.length
        by.setdefault(r.doc_id, []).append(r)
    for k, t in texts.items():
        want = [*library(t), 0]
        pieces = sorted(by[k], key=lambda r: r.start)
        assert [i for r in pieces for i in array("I", r.ids)] == want
        assert all(r.doc_tokens == len(want) for r in pieces)
    assert packing.pack(empty).count() == 0
    assert packing.decompose(1 + 2 + 8 + 3 * 1024, 1024) == [1024, 1024, 1024, 8, 2, 1]


def test_store_round_trip(spark, docs, empty, library):
    df, texts = docs
    path = common.new_path(spark, "test-store")
    grammar_store.write_store(df, path, shard_tokens=20_000, partition_bytes=200_000)
    rows = sorted(grammar_store.read_store(spark, path).collect(), key=lambda r: r.id)
    at = 0
    assert [r.id for r in rows] == sorted(texts)
    for r in rows:
        want = [*library(texts[r.id]), 0]
        assert (r.start, r.n_tokens, list(array("I", r.ids))) == (at, len(want), want)
        at += len(want)
    assert grammar_store.read_store(spark, grammar_store.new_store(empty)).count() == 0


def test_repair_replaces_repeats_and_reads_single_documents():
    import numpy as np

    rng = np.random.default_rng(1)
    docs = [np.append(np.tile(rng.integers(1, 50, 7), int(rng.integers(0, 40))), 0) for _ in range(60)]
    ids, ends = np.concatenate(docs).astype("<u4"), np.cumsum([len(d) for d in docs])
    shard = grammar_store.Shard(grammar_store.encode_shard(ids, ends, [None, *range(59)], 100, min_count=2))
    pair = list(zip(shard.symbols.tolist(), shard.symbols[1:].tolist()))
    inner = Counter(p for i, p in enumerate(pair, 1) if i not in set(shard.sym_ends.tolist()))
    assert max(n for p, n in inner.items() if p[0] != p[1]) < 2  # pairs are counted exactly, to the end
    assert (shard.all() == ids).all() and shard.keys[0] is None and len(shard.symbols) < len(ids) / 3
    for i, d in enumerate(docs):
        assert (shard.document(i) == d).all() and (shard.slice(i, 2, 9) == d[2:9]).all()
    assert (shard.lengths == [len(grammar_store.expand(np.array([100 + r]), shard.rules, 100)) for r in range(len(shard.rules))]).all()


def brute_removed(texts, window=35):
    words = {k: common.words_of(t) for k, t in texts.items()}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out[k] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def test_repeated_windows_go(spark, docs, empty):
    df, texts = docs
    passage = " ".join(f"p{i}" for i in range(60))
    extra = {20_000: f"x y {passage} z", 20_001: f"{passage} q " + passage[5:], 20_002: "a " * 90, 20_003: "a " * 35 + "b", 20_004: passage[: passage.index(" p36")], 20_005: "ba " * 36}
    texts = texts | extra
    df = df.unionByName(spark.createDataFrame([(k, t, *["x"] * 8) for k, t in extra.items()], COLUMNS))
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, batches=3).collect()}
    for k, want in brute_removed(texts).items():
        kept = got[k].kept if got[k].kept is not None else " ".join(w.decode() for w in common.words_of(texts[k]))
        assert (got[k].n_words, got[k].n_removed, kept) == want, k
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_a_log_finds_repeats_in_earlier_batches(spark):
    passage, other = " ".join(f"p{i}" for i in range(60)), " ".join(f"o{i}" for i in range(50))
    calls = [{1: f"a {passage} b", 2: "short", 3: other}, {1: f"{passage[3:]} c", 4: None}, {5: f"x {other}", 6: f"new {passage} {other}", 7: " ".join(f"n{i}" for i in range(70))}]
    log = substring_dedup.FingerprintLog(spark, fanout=2)
    seen = {}
    for k, texts in enumerate(calls):
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, batches=1, log=log).collect()}
        seen |= {(k, i): t for i, t in texts.items()}
        want = {i: v for (c, i), v in brute_removed(seen).items() if c == k}
        assert {i: (r.n_words, r.n_removed, r.kept if r.kept is not None else " ".join(w.decode() for w in common.words_of(texts[i]))) for i, r in got.items()} == want
    assert len(log.runs) == 2 and len(log.history) == 3
    plan = log.hits(log.runs[0], log.runs[1:])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    log.drop()


def test_repeated_and_null_ids_keep_their_rows(spark):
    text = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, 50, 50), (1, 50, 50), (None, 50, 50), (None, 0, 0)], key=str)
    assert {(r.doc_id, r.component) for r in simhash.near_duplicates(df).collect()} == {(1, 1), (None, None)}
    assert packing.pack(df).groupBy("doc_id").count().count() == 2
    assert grammar_store.read_store(spark, grammar_store.new_store(df)).count() == 4


def brute_fingerprint(text):
    shingles = common.shingle_words("".join(c.lower() if c.isascii() else c for c in text or ""), 3)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps):
    ids = sorted(fps)
    up = {k: k for k in ids}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in ids}


def test_no_growing_table_of_simhash_is_broadcast(spark):
    df = spark.createDataFrame([(i, f"some words number {i % 40}") for i in range(200)], "doc_id long, text string")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    classes = simhash.fingerprints(df).select("fp").distinct()
    found = simhash.near_duplicates(df)
    assert found.count() == 200
    for frame in (found, simhash.verified_links(common.materialize(classes, "test"))):
        assert "SortMergeJoin" in plan(frame) and "Broadcast" not in plan(frame)


def test_simhash_matches_brute_force(docs, empty):
    df, texts = docs
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = {k: brute_fingerprint(t) for k, t in texts.items()}
    assert {k: r.fp % (1 << 64) for k, r in got.items()} == fps
    assert {k: r.component for k, r in got.items()} == brute_components(fps)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [16, 4096])
def test_links_of_planted_fingerprints(spark, block):
    import random

    rnd = random.Random(4)
    fps = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for _ in range(25)}
    low = rnd.getrandbits(32)
    fps |= {low | rnd.getrandbits(3) << 32 | rnd.getrandbits(2) << 61 for _ in range(80)} | {0, 1, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.verified_links(spark.createDataFrame([(f,) for f in signed], "fp long"), block=block)
    index = {f: i for i, f in enumerate(sorted(fps))}
    up = {i: i for i in index.values()}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for r in links.collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        x, y = root(index[a]), root(index[b])
        up[max(x, y)] = min(x, y)
    want = brute_components({i: f for f, i in index.items()})
    assert {i: root(i) for i in index.values()} == want


def test_digest_columns(spark):
    from lexigraph.llm import queries

    row = queries.op4_bpe_trie(spark, "/root/testdata/sf0.001").where("doc_id = 3").first()
    text = spark.read.parquet(TABLE).where("doc_id = 3").first().text
    ids = Tokenizer.from_file(tokens.default_path()).encode(text, add_special_tokens=False).ids
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and row.n_tokens == len(ids)
    row = queries.op9_repair_store(spark, "/root/testdata/sf0.001").where("doc_id = 3").first()
    assert row.ids_crc32 == zlib.crc32(array("I", [*ids, 0]).tobytes())
