"""The class models recomputed in plain Python from their definitions."""

import math
import random

import numpy as np

from gridwatch.llm import toxicity as T


def plain_discount(counts):
    """(discount, back-off mass, total) of a class's positive counts."""
    n1, n2, n = sum(c == 1 for c in counts), sum(c == 2 for c in counts), sum(counts)
    d = min(.98, max(.5, n1 / (n1 + 2 * n2))) if n1 else .5
    return d, d * len(counts) / n if n else 1.0, max(1, n)


def plain_ratios(texts, words):
    """texts: (text, toxic); log p(word | toxic) - log p(word | ordinary)."""
    docs = {c: {} for c in (True, False)}
    for text, toxic in texts:
        for w in set(T.expressions(text)):
            docs[toxic][w] = docs[toxic].get(w, 0) + 1
    kinds = {c: {} for c in docs}                     # different words by stem
    for c, found in docs.items():
        for w in found:
            kinds[c][w[:T.STEM]] = kinds[c].get(w[:T.STEM], 0) + 1
    every = set(docs[True]) | set(docs[False])
    uses = {}
    for w in every:
        uses[w[:T.STEM]] = uses.get(w[:T.STEM], 0) + docs[True].get(w, 0) + docs[False].get(w, 0)
    all_kinds = sum(sum(k.values()) for k in kinds.values())

    def p(w, c):
        s = w[:T.STEM]
        d, back, n = plain_discount(list(docs[c].values()))
        sd, stem_back, sn = plain_discount(list(kinds[c].values()))
        shared_stem = (kinds[True].get(s, 0) + kinds[False].get(s, 0) + .5) / (all_kinds + 1000)
        stem = max(kinds[c].get(s, 0) - sd, 0) / sn + stem_back * shared_stem
        shared_word = (docs[True].get(w, 0) + docs[False].get(w, 0) + .5) / (uses.get(s, 0) + 5)
        return max(docs[c].get(w, 0) - d, 0) / n + back * stem * shared_word

    return [math.log(p(w, True) / p(w, False)) for w in words]


def test_models_are_those_of_plain_counts(spark):
    rng = random.Random(8)
    common = [f"{s}{e}" for s in ("gran", "wort", "tabl", "x") for e in ("", "a", "ing", "ed", "s", "er")]
    rude = ["grant", "wortless", "(awful)", "Awful!"]
    texts = []
    for k in range(300):
        toxic = k % 5 == 0
        texts.append((" ".join(rng.choices(common, k=rng.randrange(0, 30)) + (rng.choices(rude, k=2) if toxic or k % 41 == 0 else [])), toxic))
    labelled = spark.createDataFrame([(t, c, k % 7 == 0) for k, (t, c) in enumerate(texts)], "text string, toxic boolean, calibrates boolean")
    counts = T.word_counts(labelled.repartition(5)).cache()
    words = [*common, "grant", "awful", "never", "granted", "wort-x", "q"]
    for columns, own in ((("toxic", "ordinary"), texts), (("toxic_fit", "ordinary_fit"), [x for k, x in enumerate(texts) if k % 7])):
        got = T.counted(counts, *columns).log_ratios(words)
        assert np.allclose(got, plain_ratios(own, words), rtol=1e-4, atol=1e-4)
    assert plain_ratios(texts, ["awful"])[0] > 1


def test_models_without_one_class(spark):
    labelled = spark.createDataFrame([("a b c", False, False), ("a b", False, False)], "text string, toxic boolean, calibrates boolean")
    got = T.counted(T.word_counts(labelled), "toxic", "ordinary").log_ratios(["a", "z"])
    assert np.allclose(got, plain_ratios([("a b c", False), ("a b", False)], ["a", "z"]), rtol=1e-4, atol=1e-4)
