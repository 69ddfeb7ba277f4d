"""Vector codes, byte-string dedup and the filter audit against brute force,
and their odd inputs."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwatch.llm import filter_audit as A
from gridwatch.llm import part_trie as P
from gridwatch.llm import suffix_dedup as S
from gridwatch.llm.common import WORD

# --- byte strings that occur twice ----------------------------------------


def plain_repeats(texts, length):
    seen: dict[bytes, int] = {}
    for t in texts:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen[b[k:k + length]] = seen.get(b[k:k + length], 0) + 1
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def repeats(df, **more):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(df, **more).collect()}


@pytest.fixture(scope="module")
def mixed_texts():
    rng = random.Random(1)
    words = ["alpha", "beta", "gä", "delta", "x", "yy", "zebra", "omega"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.randrange(5, 120))) for _ in range(40)]
    texts = [" ".join(rng.choice(base)[rng.randrange(20):rng.randrange(20, 600)] for _ in range(rng.randrange(5))) for _ in range(200)]
    texts += [None, "", "a" * 1000, "a" * 199, "ab" * 300, None, "é" * 250]
    return texts + [base[0] + f" tail{k}" for k in range(50)] + [base[1] * 3] * 3


@pytest.mark.parametrize("hot", [2048, 3])
def test_repeated_bytes_are_those_of_brute_force(spark, mixed_texts, monkeypatch, hot):
    """Both ways of comparing: contexts of a gram, windows of a common gram."""
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "BYTES_PER_GROUP", 20_000)
    df = spark.createDataFrame(list(enumerate(mixed_texts)), "doc_id long, text string")
    want = plain_repeats(mixed_texts, S.LENGTH)
    assert repeats(df) == dict(enumerate(want))
    assert 0.2 < sum(w[1] for w in want) / sum(w[0] for w in want) < 0.9


def test_refinement_of_buckets_finds_all_repeated_starts():
    rng = np.random.default_rng(5)
    for length in (8, 9, 16, 23, 40, 200):
        text = rng.integers(97, 99, 3000).astype(np.uint8)
        text[1000:1400] = text[200:600]
        ends = np.array([700, 1300, 3000])
        left = ends[np.searchsorted(ends, np.arange(3000), "right")] - np.arange(3000)
        raw = text.tobytes()
        starts = [k for k in range(3000) if left[k] >= length]
        seen: dict[bytes, int] = {}
        for k in starts:
            seen[raw[k:k + length]] = seen.get(raw[k:k + length], 0) + 1
        want = [k for k in starts if seen[raw[k:k + length]] > 1]
        assert S.refine(text, left, length).tolist() == want


def test_a_hot_passage_spreads_over_the_buckets(spark, monkeypatch):
    """A passage in every document, different words around it: no bucket gets
    more than its share of what the groups send."""
    monkeypatch.setattr(S, "HOT", 10)
    monkeypatch.setattr(S, "BYTES_PER_BUCKET", 4000)
    passage = " ".join(f"common{k}" for k in range(40))
    rows = [(k, f"{'%x' % (k * 7919 ** 5)} {passage} {'%x' % (k * 104729 ** 4)}") for k in range(300)]
    got = repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == dict(enumerate(plain_repeats([t for _, t in rows], S.LENGTH)))
    assert all(g[1] >= len(passage) for g in got.values())


def test_repeats_of_odd_rows(spark, odd_docs):
    out = S.remove_repeats(odd_docs.withColumn("n_bytes", F.lit("old")).withColumn("__group", F.lit(1)))
    assert set(out.columns) == {*odd_docs.columns, "__group", "n_bytes", "n_removed", "n_spans", "kept"}
    assert out.count() == odd_docs.count()
    assert S.remove_repeats(odd_docs.where("false")).count() == 0
    twice = spark.createDataFrame([(None, "x" * 400), (None, "x" * 400), (1, None), (1, "y z" * 100)], "doc_id long, text string")
    found = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in S.remove_repeats(twice).collect())
    assert found == [(0, 0, 0), (300, 300, 1), (400, 400, 1), (400, 400, 1)]
    with pytest.raises(ValueError):
        S.remove_repeats(twice, length=4)


# --- codes ------------------------------------------------------------------


def plain_codes(rows, entries=64, rounds=2):
    """rows: (id, label, vector); the contract in plain integers."""
    kept = sorted((i, [math.floor(256 * x) for x in v], label) for i, label, v in rows
                  if v is not None and all(x is not None and math.isfinite(x) for x in v))
    each = len(kept[0][1]) // 16
    part = lambda v, p: v[p * each:(p + 1) * each]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(16)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(16):
            groups: dict[int, list] = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(part(v, p), books[p])[0], []).append(part(v, p))
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, label in kept:
        found = [nearest(part(v, p), books[p]) for p in range(16)]
        error = sum(d for _, d in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
    return sorted((i, code, error, by_label[label], digest) for i, code, error, label in out)


def codes(df, **more):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in P.compress(df, **more).collect())


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("size", [1, 1e6, 1e12])
def test_codes_are_those_of_plain_integers(spark, monkeypatch, size):
    """Small values, values whose squares pass 2**53, values past 64 bits."""
    monkeypatch.setattr(P, "SUBTREE", 8)
    rng = np.random.default_rng(2)
    rows = [(k, [None, 1, 2][k % 3], [float(round(x * 4) * size / 4) for x in rng.normal(size=32)]) for k in range(200)]
    rows += [(900, 1, None), (901, 1, [float("nan")] * 32), (902, 1, [float("inf")] + [0.0] * 31), (903, None, [None] + [1.0] * 31)]
    got = codes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = plain_codes(rows)
    assert [g[:2] + g[4:] for g in got] == [w[:2] + w[4:] for w in want]
    top = 2 ** 63
    assert [g[2] for g in got] == [w[2] if w[2] < top else None for w in want]
    if size <= 1e6:
        assert [g[3] for g in got] == [w[3] for w in want]


def test_walk_gives_every_distance_once(monkeypatch):
    monkeypatch.setattr(P, "SUBTREE", 16)
    rng = np.random.default_rng(3)
    own, number, count = P.distinct(rng.integers(-3, 3, (900, 4)))
    rows = [tuple(r) for r in own.tolist()]
    assert rows == sorted(set(rows)) and count.sum() == 900 and len(own) == number.max() + 1
    book = rng.integers(-3, 3, (10, 4))
    seen = np.zeros(len(own), int)

    def leaf(a, b, d):
        seen[a:b] += 1
        assert (d == ((own[a:b, None, :] - book[None]) ** 2).sum(axis=2)).all()

    P.walk(own, book, leaf)
    assert (seen == 1).all()


def test_codes_of_odd_rows(spark):
    rows = [(1, 1, [1.0] * 16), (1, 1, [1.0] * 16), (None, 2, [2.0] * 16), (2, 1, [1.0] * 15), (3, 1, []), (4, 1, [1e300] * 16), (5, None, None)]
    got = {(r.vec_id, r.code, r.error) for r in P.compress(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x"))).collect()}
    one, third = "00" * 16, "02" * 16
    assert got == {(1, one, 0), (None, third, 0), (2, None, None), (3, None, None), (4, None, None)}
    assert P.compress(spark.createDataFrame(rows, SCHEMA).where("false")).count() == 0
    uneven = P.compress(spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0])], SCHEMA)).collect()
    assert [(r.vec_id, r.code, r.error) for r in uneven] == [(1, None, None)]
    empty = P.compress(spark.createDataFrame([(1, 1, []), (2, 1, [])], SCHEMA), label_col=None)
    assert [(r.code, r.error) for r in empty.collect()] == [("00" * 16, 0)] * 2 and "label_error" not in empty.columns


# --- filters ------------------------------------------------------------------


def plain_audit(docs, labels):
    fails = []
    for k, (i, text, lang) in enumerate(docs):
        t = text or ""
        w = re.findall(WORD, t)
        fails.append((lang or "", {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any((o or "") == t and j is not None and (i is None or j < i) for n, (j, o, _) in enumerate(docs) if n != k)},
            any(d == i and q == 1 for d, q, _ in labels if i is not None), any(d == i and x == 1 for d, _, x in labels if i is not None)))
    out = set()
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in permutations("ABCDE"):
            left = own
            for n, x in enumerate(order):
                gone = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                failing = [f for f in own if f[1][x]]
                total[x] += len(gone)
                rows.append((x, "".join(order), n + 1, len(left), len(gone), len(failing) - len(gone),
                             sum(sum(f[1].values()) == 1 for f in failing), sum(f[2] for f in gone), sum(f[3] for f in gone)))
        out |= {(part, *r[1:], total[r[0]]) for r in rows}
    return out


def test_audit_is_that_of_every_order(spark):
    rng = random.Random(4)
    pool = ["", "A B C", "plain words " * 60, " ".join(f"w{k}" for k in range(150)), "UPPER CASE " * 70, "cost $ 5", None,
            " ".join(f"v{k}" for k in range(120)) + " #"]
    docs = [(rng.choice([k, k, k, 7, None]), rng.choice(pool), rng.choice(["en", "de", None, ""])) for k in range(150)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 150, 2)] + [(7, 1, 0), (None, 1, 1), (4, 1, 1)]
    got = A.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("mask", F.lit(9)),
                  spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r) for r in got} == plain_audit(docs, labels) and len(got) == 3 * 600


def test_audit_of_odd_tables(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = A.audit(odd_docs, labels).where("filter_order = 'ABCDE'")
    want = {}
    for r in odd_docs.collect():
        want[r.lang or ""] = want.get(r.lang or "", 0) + 1
    assert {r.part: r.kept + r.removed for r in out.where("step = 1").collect()} == want
    assert A.audit(odd_docs.where("false"), labels).count() == 0
