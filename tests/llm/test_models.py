"""Language model against a dictionary version, classifiers on held-out rows, pipeline stages against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigraph.llm import common, language_id, lm_trie, quality_pu, queries, simhash_sets

DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string"


def brute_model(texts, order=3, min_count=2, discount=0.6):
    seqs = [[None, *(w.lower() for w in common.words_of(t)), None] for t in texts]
    grams = [Counter(tuple(s[i : i + n]) for s in seqs for i in range(1 if n == 1 else 0, len(s) - n + 1)) for n in range(1, order + 1)]
    kept = [grams[0]] + [{g: c for g, c in grams[n].items() if c >= min_count} for n in range(1, order)]
    total, distinct = sum(grams[0].values()), len(grams[0])
    weight = {}
    for n in range(1, order):
        for g, c in kept[n].items():
            weight[g[:-1]] = weight.get(g[:-1], 1.0) - (c - discount) / kept[n - 1][g[:-1]]

    def score(text):
        s = [None, *(w.lower() for w in common.words_of(text)), None]
        base = logp = 0.0
        known = 0
        for i in range(1, len(s)):
            c = grams[0].get((s[i],), 0)
            known += c > 0
            p = (c + 1) / (total + distinct + 1)
            base += math.log10(p)
            for n in range(1, min(order, i + 1)):
                ctx = tuple(s[i - n : i])
                if n > 1 and ctx not in kept[n - 1]:
                    break
                c = kept[n].get((*ctx, s[i]), 0)
                p = ((c - discount) / kept[n - 1][ctx] if c else 0) + weight.get(ctx, 1.0) * p if ctx in kept[n - 1] else p
            logp += math.log10(p)
        return len(s) - 1, known, base, logp

    return total, score


def test_lm_matches_dictionary_version(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").limit(120)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9001, None), (9002, ""), (9003, "the The THE " * 200), (9004, "unseen zzz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = [t for i, t in rows if i % 3]
    total, score = brute_model(train)
    got = {r.doc_id: r for r in lm_trie.train_and_score(df, F.col("doc_id") % 3 != 0, shard_tokens=700).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n, known, base, logp = score(t)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(logp, abs=0.002 * n)
    empty = df.limit(0)
    assert lm_trie.train_and_score(empty, F.lit(True)).count() == 0
    assert lm_trie.train_and_score(df, F.lit(False)).count() == len(rows)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 100), (1000, 10**9), (3000, 4000), (5000, 2**62)):
        v = np.unique(np.concatenate((rng.integers(0, top, n), rng.integers(0, max(top // 1000, 1), n))))
        e = lm_trie.EliasFano(lm_trie.ef_build(v, "x"), "x")
        several = np.repeat(v, rng.integers(0, 4, len(v)))  # pointers repeat where a parent has no successors
        if len(several):
            assert (lm_trie.EliasFano(lm_trie.ef_build(several, "x"), "x").get(np.arange(len(several))) == several).all()
        bits = int(v[-1]).bit_length()
        assert (lm_trie.packed_at(lm_trie.pack(v, bits), bits, np.arange(len(v))) == v.astype(np.uint64)).all()
        assert (e.find(v) == np.arange(len(v))).all() and (e.get(np.arange(len(v))) == v).all()
        q = rng.integers(0, top, 500)
        at = np.minimum(np.searchsorted(v, q), len(v) - 1)
        assert (e.find(q) == np.where(v[at] == q, at, -1)).all()


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    r = queries.op8_quality_pu(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    assert (r.predicted == r.quality).mean() > 0.93
    r = queries.op6_language_id(spark, sf).where("held_out").join(docs, "doc_id").toPandas()
    assert (r.lang_pred == r.lang).mean() > 0.97


def naive_grams(text, table):
    codes = [0, *(int(table[ord(c)]) if ord(c) < 1 << 16 else 1 for c in text.lower()), 0]
    kept = [c for i, c in enumerate(codes) if i == 0 or c or codes[i - 1]]
    return {tuple(kept[i : i + n]) for n in (1, 2, 3) for i in range(len(kept) - n + 1)}


def test_language_model_matches_a_naive_version(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").where("lang is not null and length(text) > 50").orderBy("doc_id").limit(60).collect()
    texts, langs = [r.text for r in rows], [r.lang for r in rows]
    marks, ridge = list(range(0, 60, 4)), 1e-3
    model = language_id.fit(texts, langs, marks, ridge)
    table = language_id.letter_table([texts[i] for i in marks])
    own = [naive_grams(texts[i], table) for i in marks]
    known = set().union(*own)  # n-grams that no landmark has don't count
    kernel = lambda a, b: len(a & b) / math.sqrt(max(len(a & known), 1) * max(len(b), 1))
    c = np.array([[kernel(naive_grams(t, table), m) for m in own] for t in texts])
    w = c[marks]
    assert np.allclose(model.kernel(model.presence(texts)), c, atol=1e-5)
    # Nystrom features and ridge regression in their dual form.
    square, axes = np.linalg.eigh(w)
    good = square > 1e-6 * square.max()
    phi = c @ axes[:, good] / np.sqrt(square[good])
    y = np.array([[1.0 if x == l else -1.0 for l in model.languages] for x in langs])
    naive = phi @ phi.T @ np.linalg.solve(phi @ phi.T + ridge * len(texts) * np.eye(len(texts)), y)
    assert np.allclose(model.scores(texts), naive, atol=5e-3)


def test_risk_and_prior():
    rng = np.random.default_rng(8)
    draw = lambda n, share: np.where(rng.random((n, 1)) < share, rng.normal(1.5, 1, (n, 3)), rng.normal(-1.5, 1, (n, 3)))
    for share in (0.3, 0.8):
        pos, unl = rng.normal(1.5, 1, (3000, 3)), draw(3000, share)
        prior = quality_pu.estimate_prior(pos, unl)
        assert abs(prior - share) < 0.08
        w = quality_pu.fit_pu(pos, unl, prior)
        assert ((quality_pu.with_bias(rng.normal(1.5, 1, (500, 3))) @ w > 0).mean() + (quality_pu.with_bias(rng.normal(-1.5, 1, (500, 3))) @ w < 0).mean()) / 2 > 0.97

    def risk(w, p, u, prior):
        loss = lambda z, y: 1 / (1 + math.exp(y * z))
        plus = sum(loss(x @ w, 1) for x in p) / len(p)
        minus = sum(loss(x @ w, -1) for x in u) / len(u) - prior * sum(loss(x @ w, -1) for x in p) / len(p)
        return prior * plus + minus if minus >= 0 else -minus

    for prior in (0.2, 0.95):
        p, u, w = rng.normal(1, 1, (7, 4)), rng.normal(0, 1, (9, 4)), rng.normal(0, 0.3, 4)
        slope = [(risk(w + e, p, u, prior) - risk(w - e, p, u, prior)) / 2e-6 for e in 1e-6 * np.eye(4)]
        assert np.allclose(quality_pu.pu_gradient(w, p, u, prior), slope, atol=1e-6)


def test_repeated_ids_stay_bounded(spark):
    texts = ["the same words again and again", "die gleichen Worte", "les mots"]
    rows = [(7 if i % 3 else None, texts[i % 2] if i < 250 else texts[2], ["en", "de"][i % 2] if i < 250 else "fr") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(df, F.lit(True), per_language=10)
    assert model.languages == ["de", "en", "fr"] and len(model.landmarks) <= 30
    assert {(r.text, r.lang_pred) for r in language_id.predict(df, model, keep=("text",)).distinct().collect()} == set(zip(texts, ["en", "de", "fr"]))
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_pu.train(df, labels, F.lit(True), max_rows=20)
    assert quality_pu.score(df, model).where("score between 0 and 1").count() == 300


def test_edge_rows_and_empty_tables(spark):
    rows = [(1, None, None, "s", None, "x", "y"), (2, "", "en", None, 0, "x", "y"), (None, "12 34 !", "en", "s", 7, "x", "y"), (4, "abc " * 9000, "en", "s", 1, "x", "y"), (4, "abc", "de", "s", 1, "x", "y")]
    df = spark.createDataFrame(rows, COLUMNS)
    model = language_id.train(df, F.lit(True))
    got = [(r.doc_id, r.lang_pred) for r in language_id.predict(df, model).collect()]
    assert sorted(p for _, p in got).count("und") == 3 and len(got) == 5
    labels = spark.createDataFrame([(4, 1, 0), (77, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    scored = quality_pu.score(df, quality_pu.train(df, labels, F.lit(True))).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored)
    empty = df.limit(0)
    assert language_id.predict(empty, language_id.train(empty, F.lit(True))).count() == 0
    assert quality_pu.score(empty, quality_pu.train(empty, labels.limit(0), F.lit(True))).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert corpus_pipeline.near_duplicates(spark, docs, DIR).columns == docs.columns
    groups = brute_similar({r.doc_id: shingles_of(r.text) for r in docs.collect()})
    kept = corpus_pipeline.near_duplicates(spark, docs, DIR)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in groups.items() if i == c}
    clean = corpus_pipeline.repeated_passages(spark, docs, DIR)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), DIR).columns == docs.columns, name
    pieces = corpus_pipeline.run(spark, DIR)
    assert pieces.select("doc_id").distinct().count() <= docs.count() and pieces.count() > 0


def shingles_of(text):
    return set(common.shingle_words("".join(c.lower() if c.isascii() else c for c in text or ""), 5))


def brute_similar(sets):
    """Component (smallest key) of each key over pairs at 0.8 or more."""
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("sizes", [{}, {"block": 8}, {"group": 20}, {"block": 8, "group": 20, "unit_rows": 60}])
def test_all_similar_texts_are_found(spark, sizes):
    rng = np.random.default_rng(3)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for n in (12, 60, 300):  # copies with changed words, on both sides of the threshold
        first = [f"t{n}x{i}" for i in range(n)]
        for _ in range(25):
            copy = list(first)
            for i in rng.integers(0, n, rng.integers(0, max(2, n // 25))):
                copy[i] = f"c{rng.integers(10**9)}"
            texts.append(" ".join(copy))
    texts += [None, "", " \n", "a b", "A  b", "a b c d e", "a b c d f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    got = {r.row: r.component for r in simhash_sets.groups(rows, **sizes).collect()}
    assert got == brute_similar({i: shingles_of(t) for i, t in enumerate(texts)})


def test_near_duplicates_keep_a_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text.replace("w50 ", "other ")  # 5 of 96 shingles differ
    rows = [(1, text, "en"), (1, text, "en"), (1, "something else", "de"), (7, near, "fr"), (None, near, "it"), (None, "alone here", "nl"), (None, None, None), (3, "", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    got = sorted(((r.doc_id, r.text, r.lang) for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()), key=str)
    assert got == sorted([(1, text, "en"), (1, "something else", "de"), (None, "alone here", "nl"), (3, "", None)], key=str)


def test_repeated_passages_keep_rows_apart(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"{passage} first", "en"), (1, f"{passage} second", "de"), (1, "third", "fr"), (None, f"{passage} fourth", "it"), (None, None, "nl")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text, r.lang, r.n_chars) for r in corpus_pipeline.repeated_passages(spark, docs, DIR).collect()), key=str)
    assert got == sorted([(1, "first", "en", 5), (1, "second", "de", 6), (1, "third", "fr", 5), (None, "fourth", "it", 6), (None, None, "nl", 0)], key=str)


def test_lm_query_keeps_all_ngrams(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    out = {r.doc_id: r for r in queries.op7_lm_trie(spark, DIR).collect()}
    total, score = brute_model([t for i, t in texts.items() if not out[i].held_out], min_count=1)
    assert out.keys() == texts.keys()
    for i, t in texts.items():
        n, known, base, logp = score(t)
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (n, known, total)
        assert out[i].score == pytest.approx(logp, abs=0.002 * n)


def test_plan_of_fingerprints():
    assert simhash_sets.plan(1000, (4, 5), 0.002)[:2] == (16, 8)
    for n in (10**5, 10**7, 10**10):
        width, segments, limit = simhash_sets.plan(n, (4, 5), 0.002)
        assert n < 5 << width and limit > 0.1516 * width * segments
    rng = np.random.default_rng(2)
    width, segments, limit = simhash_sets.plan(1000, (4, 5), 0.002)
    found = 0
    for _ in range(400):  # pairs at 0.8: 160 of 200 hashes
        x = rng.integers(0, 1 << 63, 200, np.uint64) * np.uint64(2) + np.uint64(1)
        y = np.concatenate((x[:178], rng.integers(0, 1 << 63, 22, np.uint64)))
        w = np.frombuffer(simhash_sets.fingerprint(x, 128) + simhash_sets.fingerprint(y, 128), np.uint64).reshape(2, -1)
        s = simhash_sets._segments(w, width, segments)
        found += (np.bitwise_count(s[0] ^ s[1]) <= 2).any() and simhash_sets.distances(w[0], w[1]) <= limit
    assert found >= 396
