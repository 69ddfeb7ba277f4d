"""Trained models by held-out accuracy, the registry and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridwatch.llm import langid as N
from gridwatch.llm import packing, registry
from gridwatch.llm import toxicity as X
from gridwatch.llm.simhash_dedup import simhash_components
from tests.llm.conftest import SF

SF1 = "/root/testdata/sf0.01"


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    net = N.BiGRU(["a", "b", "c"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    text, mask, label = rng.integers(0, 256, (7, 4)).astype(np.uint8), np.ones((7, 4)), np.array([0, 1, 2, 1])
    mask[5:, 2] = 0
    _, g = net.gradients(text, mask, label)
    for k, w in net.w.items():
        at = np.unravel_index(np.argsort(-np.abs(g[k]).ravel())[:5], w.shape)
        for i in zip(*at, strict=True):
            old, e = w[i], 1e-3
            w[i] = old + e
            up = net.gradients(text, mask, label)[0]
            w[i] = old - e
            down = net.gradients(text, mask, label)[0]
            w[i] = old
            assert abs((up - down) / (2 * e) - g[k][i]) < 2e-3 * max(1e-2, abs(g[k][i])) + 2e-5


def test_prediction_pools_every_position():
    net = N.BiGRU(["a", "b"])
    text = bytes(range(32, 127)) * 3
    whole = net.documents([text, b"x"])
    windows = [text[k:k + N.SPAN] for k in range(0, len(text), N.SPAN)]
    sums = np.zeros(2)
    for w in windows:
        p = net.forward(np.frombuffer(w, np.uint8)[:, None], np.ones((len(w), 1), np.float32))
        sums += p[:, 0].sum(axis=0)
    assert np.allclose(whole[0], sums / len(text), atol=1e-5) and np.allclose(whole.sum(axis=1), 1, atol=1e-5)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    rows = registry.QUERIES["op2_language_id"](spark, SF1).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.held_out == is_held_out(r.doc_id) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > .95


def test_language_odd_inputs(odd_docs):
    net = N.BiGRU(["de", "en"])
    rows = N.predict(odd_docs.withColumn("score", F.lit("x")), net).collect()
    assert len(rows) == 9
    assert {r.doc_id: r.lang_pred for r in rows if r.lang_pred == "und"}.keys() == {2, 3, 4, 6}
    assert all((r.score == 0) == (r.lang_pred == "und") for r in rows)
    nothing = N.identify(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert N.identify(odd_docs.limit(0)).count() == 0


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    out = registry.QUERIES["op6_toxicity"](spark, SF1)
    assert out.count() == spark.read.parquet(f"{SF1}/documents.parquet").count()
    rows = out.join(labels, "doc_id").where("held_out and toxic is not null").collect()
    assert all(r.held_out == is_held_out(r.doc_id) and r.predicted == int(r.score >= .7) for r in rows)
    bad, good = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert np.mean([r.predicted for r in bad]) > .7 and np.mean([r.predicted for r in good]) < .02
    pairs = np.array([[b.score > g.score for g in good] for b in bad])
    assert pairs.mean() > .93


def test_shared_counts_smooth_rare_words():
    words, stems = np.zeros((64, 3), np.float32), np.zeros((64, 4), np.float32)
    m = X.Model(words, stems, np.array([.5, .5]), np.array([.5, .5]))
    assert m.log_ratios(["never", "seen"]).tolist() == [0, 0]


def test_toxicity_odd_inputs(odd_docs, spark):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (2, 1, 1), (5, 0, 0), (6, None, None), (None, 1, 1), (7, 0, 0)],
                                   "doc_id long, toxic int, quality int")
    rows = X.toxicity(odd_docs.withColumn("score", F.lit(1)), labels).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert X.toxicity(odd_docs.limit(0), labels).count() == 0
    assert X.toxicity(odd_docs, labels.limit(0)).count() == 9


def test_every_labelled_row_is_counted(spark):
    ids = [k for k in range(60) if not is_held_out(k)]
    rows = [(k, f"zorg{k} " + ("vile filth " if k % 4 == 0 else "calm meadow ") + f"w{k}") for k in ids]
    rows += [(1000 + k, f"some zorg{k} thing") for k in ids]
    labels = [(k, int(k % 4 == 0)) for k in ids]
    models = []
    with pytest.MonkeyPatch.context() as patch:
        make = X.train
        patch.setattr(X, "train", lambda *a: models.append(make(*a)) or models[-1])
        out = X.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = {r.doc_id: r.score for r in out.collect()}
    names = [f"zorg{k}" for k in ids]
    assert ((models[0].log_ratios(names) > models[0].log_ratios(["zorgon"])[0]) == [k % 4 == 0 for k in ids]).all()
    assert min(got[k] for k in ids if k % 4 == 0) > max(got[k] for k in ids if k % 4)


def test_no_two_words_share_their_counts(spark):
    slot = X._digest("vile") % (1 << 21)
    alike = next(w for w in (f"calm{k}" for k in range(1 << 26)) if X._digest(w) % (1 << 21) == slot)
    ids = [k for k in range(90) if not is_held_out(k)]
    rows = [(k, "vile words" if k % 3 == 0 else f"calm meadow calm{k}x") for k in ids] + [(1000, alike), (1001, "calmness")]
    labels = [(k, int(k % 3 == 0)) for k in ids]
    out = X.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in out.collect()}
    assert got[1000] == got[1001] < .5


def test_few_labels_of_both_kinds_fit(spark):
    ids = [k for k in range(200) if not is_held_out(k) and zlib.crc32(str(k).encode()) // 3 % 5 != 0][:8]
    rows = [(k, f"{'vile filth' if n < 2 else 'calm meadow'} today n{k}") for n, k in enumerate(ids)] + [(500, "vile filth"), (501, "calm meadow")]
    labels = [(k, int(n < 2)) for n, k in enumerate(ids)]
    out = X.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in out.collect()}
    assert got[500] > got[501]


def test_logistic_separates():
    x = np.array([[0.0], [1], [2], [3]] * 20)
    w, b = X.logistic(x, (x[:, 0] > 1.5).astype(float))
    assert ((x @ w + b > 0) == (x[:, 0] > 1.5)).all()


def test_registry_covers_the_thirteen_operators():
    numbers = sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES)
    assert numbers == list(range(1, 14)) and set(registry.SQL) <= set(registry.QUERIES)


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10 ** 6, "1234 ... 5678", "en", "src0", 13), (10 ** 6 + 1, None, None, None, None)], docs.schema)
    docs = docs.unionByName(junk)
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before, docs)
    before, after = seen["language_id"]
    gone = {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()}
    assert {10 ** 6, 10 ** 6 + 1} <= gone and len(gone) < 6
    before, after = seen["simhash_near_dedup"]
    least = simhash_components(before).where("doc_id = component_id").select("doc_id")
    assert sorted(r[0] for r in least.collect()) == sorted(r.doc_id for r in after.collect())
    before, after = seen["substring_dedup"]
    assert after.count() <= before.count() and after.where("text is null or n_chars <> length(text)").count() == 0
    before, after = seen["mixing"]
    assert set(map(tuple, after.collect())) <= set(map(tuple, before.collect()))
    before, after = seen["best_fit_packing"]
    assert after.where("start = 0").count() == before.count()
    assert {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {
        r.doc_id: r.n * (len(packing.token_ids(r.text)) + 1)
        for r in before.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"sequence_id", "offset", "length"} <= set(out.columns)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
