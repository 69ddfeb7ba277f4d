"""Near-duplicate operators against brute force, and their odd inputs."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridwatch.llm import embedding_dedup as V
from gridwatch.llm import lz_fingerprint as L
from gridwatch.llm import simhash_dedup as S
from gridwatch.llm import substring_dedup as D
from gridwatch.llm.common import WORD, window_hash
from gridwatch.llm.components import components, spanning


def groups(n, pairs):
    pairs = list(pairs)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (300, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(41))
    assert all(got[k] == 100 for k in [*range(100, 130), 300])
    assert got[200] == got[201] == 200
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_spanning_forest_keeps_components():
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 300, 260), rng.integers(0, 300, 260)
    a, b = spanning(u, v)
    assert groups(300, zip(u, v, strict=True)) == groups(300, zip(a, b, strict=True)) and len(a) < 300


def test_window_hash_depends_on_the_window_only():
    x = np.array([5, 6, 7, 8, 9] * 9, np.uint64)
    h = window_hash(x, 20, 12345677)
    assert len(h) == 26 and len(set(h.tolist())) == 5 and h[0] == h[5] and len(window_hash(x[:19], 20, 3)) == 0


# --- SimHash --------------------------------------------------------------

def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(WORD, low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(docs):
    rows = docs.collect()
    f = np.array([plain_fingerprint(r.text) for r in rows], np.uint64)
    near = np.argwhere(np.bitwise_count(f[:, None] ^ f[None]) <= 4)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids)
    want = {ids[k]: (f"{int(f[k]):016x}", ids[g]) for k, g in enumerate(groups(len(ids), near))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(docs).collect()}
    assert got == want
    kept = {r.doc_id for r in S.simhash_dedup(docs).select("doc_id").collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_spark_hashes_shingles_alike(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("é b c d"))).first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest("é b c d".encode(), 42)


@pytest.mark.parametrize("bits", [2, 4, 5, 7])
def test_vantage_point_forest_finds_every_pair(spark, monkeypatch, bits):
    monkeypatch.setattr(S, "SHARD", 60)
    monkeypatch.setattr(S, "SPLIT", 25)
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    near = base.copy()
    for _ in range(bits + 1):
        near ^= np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
    x = np.unique(np.concatenate([base, near, base[:20] ^ np.uint64(1)]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    pairs = np.argwhere(np.bitwise_count(x[:, None] ^ x[None]) <= bits)
    want = groups(len(x), pairs)
    found = [(r.u, r.v) for r in S.fingerprint_links(df, bits).collect()]
    at = {int(v): k for k, v in enumerate(x.view(np.int64))}
    assert groups(len(x), [(at[u], at[v]) for u, v in found]) == want


def test_neighbouring_shards_of_different_block_numbers_meet(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 400)
    monkeypatch.setattr(S, "SPLIT", 100)
    rng = np.random.default_rng(11)
    # five bits, one of them in the first slice: only that slice's tree can find the pair
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    low, middle, high = (np.array([rng.choice(np.arange(a, b), n, replace=False) for _ in base], np.uint64)
                         for a, b, n in ((0, 21, 1), (21, 43, 2), (43, 64, 2)))
    near = base ^ np.bitwise_or.reduce(np.uint64(1) << np.concatenate([low, middle, high], axis=1), axis=1)
    df = spark.createDataFrame([(int(v),) for v in np.concatenate([base, near]).view(np.int64)], "fp long")
    found = {frozenset((r.u, r.v)) for r in S.fingerprint_links(df, 5).collect()}
    planted = zip(base.view(np.int64).tolist(), near.view(np.int64).tolist(), strict=True)
    assert [p for p in planted if frozenset(p) not in found] == []


def test_simhash_odd_inputs(odd_docs, spark):
    got = S.simhash_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {2, 3, 4} and {r.component_id for r in zero} == {2}
    kept = S.simhash_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 5, 6, 7]
    assert S.simhash_components(odd_docs.limit(0)).count() == 0 and S.simhash_dedup(odd_docs.limit(0)).count() == 0
    clash = odd_docs.select("doc_id", "text", F.lit(1).alias("fp"), F.lit(2).alias("component_id"), F.lit(3).alias("id"))
    assert S.simhash_components(clash).count() == 9 and S.simhash_dedup(clash).columns == clash.columns


# --- substrings -----------------------------------------------------------

def plain_dedup(rows, window=20):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        w = re.findall(WORD, text or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            gram = tuple(w[p:p + window])
            if gram in seen:
                gone[p:p + window] = [True] * window
            seen.add(gram)
        out[doc_id] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substring_dedup_equals_brute_force(docs):
    want = plain_dedup([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in D.dedup_substrings(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_cover_aligns_every_pair_of_residues():
    assert {(a - b) % D.PERIOD for a in D.COVER for b in D.COVER} == set(range(D.PERIOD))


@pytest.mark.parametrize("length", [19, 20, 21, 33])
def test_passage_at_every_alignment(spark, length):
    passage = " ".join(f"p{k}" for k in range(length))
    rows = [(k, " ".join([*(f"a{k}_{j}" for j in range(k % 14)), passage, *(f"b{k}_{j}" for j in range(5))])) for k in range(40)]
    rows.append((40, f"{passage} x {passage}"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text)
           for r in D.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_dedup(rows)


def test_substring_odd_inputs(odd_docs):
    df = odd_docs.withColumn("n_words", F.lit("old")).withColumn("__group", F.lit(1)).withColumn("keys", F.lit(2))
    out = D.dedup_substrings(df)
    assert out.columns == [*(c for c in df.columns if c != "n_words"), "n_words", "n_removed", "kept_text"]
    rows = out.collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert (by[2].n_words, by[2].kept_text) == (0, "") and (by[4].n_words, by[4].kept_text) == (0, "")
    assert by[5].n_words == 30_000 and by[5].n_removed == 30_000 - 997 - 19 + 19     # a cycle of 997 words
    assert D.dedup_substrings(df.limit(0)).count() == 0


def test_repeated_rows_count_as_an_earlier_document(spark):
    text = " ".join(f"q{k}" for k in range(25))
    got = D.dedup_substrings(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("1", 25), ("None", 25)]


# --- Lempel-Ziv -----------------------------------------------------------

def test_fingerprints_equal_brute_force(docs):
    got = {r.doc_id: r for r in L.neighbour_fingerprints(docs).collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    for (i, text), (_, other) in zip(rows, rows[1:] + rows[:1], strict=True):
        r, half = got[i], len(text) // 2
        new = text[:len(text) - half] + other[:half]
        a, b, c = L.signature(text), L.signature(new), L.signature(other)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (L.written(a), L.written(b))
        assert (r.near_edited, r.near_next) == (L.likeness(a, b), L.likeness(a, c))


def test_phrases_are_shortest_new_strings():
    assert L.phrases("aabababbb") == {"a", "ab", "aba", "b", "bb"}
    assert L.phrases("") == set()


def test_likeness_estimates_the_jaccard_index():
    a, b = {f"x{k}" for k in range(4000)}, {f"x{k}" for k in range(2000, 6000)}
    sig = [np.unique(L._hashes(sorted(s)))[:L.KEEP] for s in (a, b)]
    assert abs(L.likeness(*sig) - 1 / 3) < .12 and L.likeness(sig[0], sig[0]) == 1
    none = np.empty(0, np.uint64)
    assert L.likeness(none, none) == 1 and L.likeness(none, sig[0]) == 0


def test_fingerprint_odd_inputs(odd_docs):
    rows = L.neighbour_fingerprints(odd_docs.withColumn("range", F.lit(1)).withColumn("id", F.lit("x"))).collect()
    assert len(rows) == 9 and sum(r.doc_id is None for r in rows) == 1
    ones = [r for r in rows if r.doc_id == 1]
    assert ones[0].fingerprint == ones[1].fingerprint and 1.0 in {r.near_next for r in ones}
    assert all(r.n_chars == 0 and r.fingerprint == "" for r in rows if r.doc_id in (2, 3))
    assert L.neighbour_fingerprints(odd_docs.limit(0)).count() == 0
    nulls = odd_docs.where("doc_id is null").unionByName(odd_docs.where("doc_id = 6")).unionByName(
        odd_docs.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    assert L.neighbour_fingerprints(nulls).count() == 11
    single = L.neighbour_fingerprints(odd_docs.where("doc_id = 6")).collect()
    assert [r.near_next for r in single] == [1.0]


# --- embeddings -----------------------------------------------------------

def clustered(seed=5, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dim))
    x = np.repeat(centres, 12, axis=0) + rng.normal(size=(720, dim)) * np.tile(np.linspace(.02, .35, 12), 60)[:, None]
    return np.concatenate([x, x[:30], 3 * x[30:40]]).astype(np.float32)


def test_embedding_links_recall_and_components(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_MEMBERS", 25)
    x = clustered()
    df = spark.createDataFrame([(k, [float(c) for c in v], k % 3) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in V.embedding_components(df).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    g = y @ y.T >= .95
    np.fill_diagonal(g, False)
    counts = np.array([got[k].n_links for k in range(len(x))])
    assert (counts <= g.sum(1)).all() and counts.sum() >= .99 * g.sum() > 1000
    want = groups(len(x), np.argwhere(g))
    assert np.mean([got[k].component_id == want[k] for k in range(len(x))]) > .97
    assert all(got[k].kept == (got[k].component_id == k) for k in got)


def test_embedding_odd_inputs(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, float("nan")]), (4, [1.0, None]), (5, [1.0, 2.0]), (6, [2.0, 4.0]),
            (7, [1.0, 2.0]), (None, [1.0, 2.0]), (8, []), (9, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 3.0]), (10, [float("inf"), 1.0]),
            (11, [1e-30, 2e-30])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, node int, h1 int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in V.embedding_components(df).collect())
    assert got == [(0, 4, 5, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 4, 5, True),
                   (6, 4, 5, False), (7, 4, 5, False), (8, 0, 8, True), (9, 1, 9, True), (9, 1, 9, True), (10, 0, 10, True),
                   (11, 4, 5, False)]
    assert V.embedding_components(df.limit(0)).count() == 0
