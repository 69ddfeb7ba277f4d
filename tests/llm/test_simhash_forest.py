"""The vantage-point forest: crowded leaves, visitors, growth; which copies stay."""

import numpy as np
import pytest

from gridwatch.llm import simhash_dedup as S


def plain_groups(x, bits):
    label = np.arange(len(x))
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= bits)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        if (low == label).all():
            return label
        label = low


@pytest.mark.parametrize("bits", [4, 7])
@pytest.mark.parametrize("split", [5, 40, 10_000])
def test_crowded_leaves_and_crowds_of_visitors(spark, monkeypatch, bits, split):
    """Most fingerprints share a slice value or are one bit from it: leaves of
    many members, leaves of few members with many visitors."""
    monkeypatch.setattr(S, "SPLIT", split)
    monkeypatch.setattr(S, "SHARD", 4)
    rng = np.random.default_rng(split + bits)
    low = np.uint64((1 << 43) - 1)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    x = rng.choice(base, 900) & low | rng.integers(0, 1 << 63, 900, dtype=np.uint64) & ~low
    for part in (slice(0, 300), slice(0, 60)):
        x[part] ^= np.uint64(1) << rng.integers(0, 43, x[part].size, dtype=np.uint64)
    near = x[:400].copy()
    for _ in range(bits // 2):
        near ^= np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)
    x = np.unique(np.concatenate([x, near]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    found = S.fingerprint_links(df, bits).collect()
    at = {int(v): k for k, v in enumerate(x.view(np.int64))}
    pairs = np.array([(at[r.u], at[r.v]) for r in found])
    label = np.arange(len(x))
    while True:
        least = label.copy()
        np.minimum.at(least, pairs[:, 0], label[pairs[:, 1]])
        np.minimum.at(least, pairs[:, 1], label[pairs[:, 0]])
        if (least == label).all():
            break
        label = least
    assert (label == plain_groups(x, bits)).all()


def test_every_pair_of_neighbours_meets_in_one_leaf():
    masks, radius, rng = S.slices(), 2, np.random.default_rng(1)
    vantage = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    for mask in masks:
        levels = [b for b in range(64) if int(mask) >> b & 1]
        x = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        y = x.copy()
        for _ in range(2):
            y ^= np.uint64(1) << rng.choice(levels, 60).astype(np.uint64)
        both, met = np.concatenate([x, y]), np.zeros(60, int)
        for rows, leaf, home in S.visits(both, mask, vantage, radius):
            for r, to in zip(rows, leaf, strict=True) if not home else ():
                k = r % 60
                other = y[k] if r < 60 else x[k]
                met[k] += int(to == other & mask)
        assert (met == ((x ^ y) & mask != 0)).all()


def test_rows_per_fingerprint_do_not_depend_on_their_number():
    made = []
    for n in (50_000, 400_000):
        x = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
        crowded = S.Crowded([], S.slices(), np.uint64(0), 1, S.SPLIT)
        made.append(sum(len(c) for c, _, _ in S.cells(x, S.slices(), np.uint64(0), 1, crowded)) / n)
    assert abs(made[0] - made[1]) < .1 and made[1] < 36


def test_which_rows_stay(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(5, a, "x"), (5, b, "y"), (1, a, "z"), (None, "c d e f", "u"), (None, "c d e f", "v"), (None, b, "w"), (7, None, None), (8, "", "q")]
    kept = S.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (5, b), (None, "c d e f"), (7, None)], key=repr)
    many = spark.createDataFrame([(None, a, "x")] * 50 + [(3, b, "x")] * 50, "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.text) for r in S.simhash_dedup(many).select("doc_id", "text").collect() if r.doc_id) == [(3, b)]
    assert S.simhash_dedup(many).count() == 2
