"""Inputs that are hard by their shape: nesting, comments that outweigh the
story, values that single precision can't hold, a third of all rows equal."""

import time
import tracemalloc

import numpy as np
import pytest

from pyspark.sql import functions as F

from gridwatch.llm import chat as C
from gridwatch.llm import embedding_dedup as V
from gridwatch.llm import html_text as H
from gridwatch.llm import mixing as M
from gridwatch.llm import substring_dedup as D

STORY = "This is a paragraph of the story that goes on for quite a while, with several clauses, and says something."
REPLY = "I do not agree with this at all, and I will say so at great length, because everybody here should hear it."


@pytest.mark.parametrize("page", [
    "<article>{story}<div id='comments'>{replies}</div></article>",
    "<div class='post'>{story}</div><div class='comments'>{replies}</div>",
    "<div id='page'><div>{story}</div><section id='post-comments'><h3>9 replies</h3>{replies}</section></div>",
    "<main>{story}</main><div class='cookie-notice'>{replies}</div>",
    "<div>{story}<div class='comment-list'>{replies}</div></div>"])
@pytest.mark.parametrize("paragraphs", [1, 3])
def test_comments_are_never_the_story(page, paragraphs):
    html = page.format(story=f"<p>{STORY}</p>" * paragraphs, replies=f"<div><p>{REPLY}</p></div>" * 9)
    assert H.main_text(f"<html><body><nav><a href=/>Home</a></nav>{html}</body></html>").split("\n") == [STORY] * paragraphs


@pytest.mark.parametrize("element", ["<div>", "<article><div>", "<form>", "<div class='sidebar'>", "<b>", "<p><i>"])
def test_deep_nesting_costs_memory_in_proportion(element):
    def peak(n):
        tracemalloc.start()
        H.main_text(element * n + f"<p>{STORY}</p>")
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    begin = time.time()
    small, large = peak(5000), peak(20_000)
    assert large < 6 * small + 1e6 and large < 60e6 and time.time() - begin < 20


def test_unclosed_elements_of_a_large_page():
    begin = time.time()
    assert H.main_text("<div>" * 100_000 + f"<p>{STORY}</p>" + "</span>" * 100_000) == STORY
    assert time.time() - begin < 20


def plain_links(vectors, least=0.95):
    out = []
    for v in vectors:
        x = np.array(v, np.float64)
        x = x / np.abs(x).max()
        out.append(x / np.sqrt((x * x).sum()))
    x = np.stack(out)
    return (x @ x.T >= least).sum(1) - 1


def test_vectors_beyond_single_precision_link(spark):
    rng = np.random.default_rng(4)
    rows = [[1e200, 2e200, 3e200], [1e200, 2e200, 3e200], [1.0, 2.0, 3.0], [1e-60, 2e-60, 3e-60], [-1.0, 2.0, 3.0], [1e-300, 0.0, 1e-300]]
    rows += [(rng.normal(size=3) * 10.0 ** rng.integers(-200, 200)).tolist() for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in V.embedding_components(df).collect()}
    assert got == dict(enumerate(plain_links(rows))) and got[0] >= 3 and got[3] >= 3


def test_equal_rows_spread_over_the_groups(spark, monkeypatch):
    """2,000 equal rows: no task holds them all, and one of them keeps its words."""
    monkeypatch.setattr(D, "CHARS_PER_GROUP", 2000)
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(7, text)] * 2000 + [(k, f"own{k} " + " ".join(f"v{k}x{j}" for j in range(25))) for k in range(100, 120)]
    out = D.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = out.groupBy("doc_id", "n_removed").count().collect()
    assert {(r.doc_id, r.n_removed): r["count"] for r in got if r.doc_id == 7 and r.n_removed} == {(7, 30): 1999}
    assert out.where("n_removed = 0").count() == 21
    with pytest.raises(TypeError):
        D.dedup_substrings(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_spans_hold_the_loss_texts_of_a_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"é{k}<|im_end|>" if k % 7 == 1 else f"say {k}") for k in range(3000)]
    out = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = out.withColumn("loss", C.loss_texts()).first()
    want = [t for _, _, role, t in rows if role == "assistant"]
    assert r.round_trip and r.loss == want
    cut = [r.formatted[s.begin - 1:s.begin - 1 + s.length] for s in r.loss_spans]
    assert [c.replace("<\\|", "<|") for c in cut] == want and [s.turn for s in r.loss_spans] == list(range(1, 3000, 2))


def test_a_long_conversation_costs_in_proportion_to_its_turns(spark):
    def seconds(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                     F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("hello").alias("text"))
        begin = time.time()
        assert C.digests(C.format_conversations(rows)).first().n_turns == n
        return time.time() - begin

    seconds(100)
    assert seconds(32_000) < 15


def test_rows_that_share_an_id_or_have_none_meet_the_target(spark):
    rng = np.random.default_rng(6)
    for ids in (lambda k: None, lambda k: 7, lambda k: k % 3):
        rows = [(ids(k), " ".join(["word"] * int(rng.integers(5, 40))), source) for source in ("a", "b", "c") for k in range(400)]
        got = M.mix_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n"))
        for r in sums.collect():
            assert r.n == 400 and abs(r.taken - r.target) <= 40
        assert got.where("taken > 3 * size").count() == 0
