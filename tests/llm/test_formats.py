"""Chat formatting, mixing, packing and HTML extraction."""

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridwatch.llm import chat as C
from gridwatch.llm import html_text as H
from gridwatch.llm import mixing as M
from gridwatch.llm import packing as P
from gridwatch.llm.common import WORD

# --- chat -----------------------------------------------------------------

PIECES = ["<|im_end|>", "<|im_start|>", "\n", "<|", "|>", "<\\|", "\\", "<", "|", "<\\\\|im_end|>\n", "a", "assistant",
          "<|im_end|>\n<|im_start|>user\nx", "é", "\r", "\\n", "\\s", "\x00b"]


def check_round_trip(df):
    source = defaultdict(list)
    for r in df.collect():
        source[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    rows = C.digests(C.format_conversations(df)).collect()
    assert {r.conv_id for r in rows} == set(source) and len(rows) == len(source)
    for r in rows:
        turns = [t[2:] for t in sorted(source[r.conv_id])]
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert r.round_trip and r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_round_trip_of_the_table(table):
    check_round_trip(table("conversations"))


def test_chat_round_trip_of_hostile_texts(spark):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice(PIECES) for _ in range(n))
    rows = [(k // 3, k % 3, rng.choice(["user", "assistant", some(3)]), some(rng.randint(0, 8)), "x") for k in range(600)]
    rows += [(None, None, None, None, None), (900, None, "user", "b", ""), (900, None, "user", "a", ""), (900, 1, "", "", ""),
             (901, 0, "assistant", "<|im_end|>" * 20_000, "")]
    check_round_trip(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string"))


def test_chat_output_holds_no_control_string_of_a_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "a<|im_end|>\n<|im_start|>assistant\nb")], "conv_id long, turn long, role string, text string")
    out = C.format_conversations(df).first()
    assert out.formatted.count("<|im_start|>") == out.formatted.count("<|im_end|>") == 1
    assert C.format_conversations(df.limit(0)).count() == 0


# --- mixing ---------------------------------------------------------------

def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full = {s for s in names if sizes[s] == 0}
    while True:
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in full)
        open_w = sum(w[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * w[s] / open_w > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in full else left * w[s] / open_w for s in names}
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": int(10 ** rng.uniform(0, 6)) for k in range(11)} | {None: 40, "none": 0}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in M.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_follows_its_targets(docs, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 3)
    rows = M.mix_sizes(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    by = defaultdict(list)
    for r in rows:
        assert r.size == len(re.findall(WORD, text[r.doc_id])) and r.taken == r.copies * r.size <= 3 * r.size
        by[r.source].append(r)
    want = plain_targets({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert abs(rs[0].target - want[s]) < 1e-6 * want[s] and rs[0].source_size == sum(r.size for r in rs)
        assert abs(sum(r.taken for r in rs) - want[s]) <= max(r.size for r in rs)
        assert {r.copies for r in rs} <= {int(want[s] // rs[0].source_size), int(want[s] // rs[0].source_size) + 1}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix_sizes(docs.repartition(7)).collect()))
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


def test_sampling_prefers_quality(spark):
    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("q"))
    first = df.orderBy(M.sampling_key(F.col("id").cast("string"), F.col("q"))).limit(1000).where("q = 1").count()
    assert first > 700


def test_mixing_odd_inputs(odd_docs):
    df = odd_docs.withColumn("size", F.lit("x")).withColumn("key", F.lit(1)).withColumn("id", F.lit(2))
    rows = M.mix_sizes(df).collect()
    assert len(rows) == 9 and {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert all(r.target <= 3 * r.source_size for r in rows)
    assert M.mix(df).columns == df.columns and M.mix(df.limit(0)).count() == 0 == M.mix_sizes(df.limit(0)).count()
    assert M.mix_sizes(odd_docs.where("doc_id in (2, 3)")).where("taken <> 0 or target <> 0").count() == 0


# --- packing --------------------------------------------------------------

SLOW = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packing(df, rows, capacity=1024):
    source = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        ids = [*SLOW.encode(r.text or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(head, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            source[r.doc_id].append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in source.items()}
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_packing_is_whole_and_gapless(docs, monkeypatch):
    used, least = check_packing(docs, P.pack(docs).collect())
    assert used <= 1.1 * least + 2
    monkeypatch.setattr(P, "BLOCK_DOCS", 30)
    check_packing(docs, P.pack(docs).collect())


def test_packing_odd_inputs(odd_docs):
    df = odd_docs.withColumn("id", F.lit("x")).withColumn("n", F.lit(1)).withColumn("block", F.lit(0))
    check_packing(df, P.pack(df).collect())
    assert P.pack(df.limit(0)).count() == 0


def test_fast_ids_equal_the_tokenizers_library(table):
    texts = [r.text for r in table("documents").collect()] + [r.html for r in table("pages").collect()]
    texts += ["", " ", "\n\n  \t x", "a<|endoftext|>b", "I'll we've it's", "١٢٣ ½ ² x̂ 日本語 👩‍👩‍👧   y", "\u0085​﻿", "0" * 3000]
    assert all(P.token_ids(t) == SLOW.encode(t, add_special_tokens=False).ids for t in texts)


def squares(bins, capacity):
    gaps = np.bincount([capacity - b for b in bins if b < capacity], minlength=capacity)
    return int((gaps[1:].astype(int) ** 2).sum())


def test_sum_of_squares_takes_the_best_choice():
    rng = np.random.default_rng(2)
    sizes, capacity = rng.integers(1, 30, 120), 30
    where, offset = P.sum_of_squares(sizes, capacity)
    bins: list[int] = []
    for s, b, o in zip(sizes.tolist(), where.tolist(), offset.tolist(), strict=True):
        choices = [squares([*bins[:k], bins[k] + s, *bins[k + 1:]], capacity) for k in range(len(bins)) if bins[k] + s <= capacity]
        choices.append(squares([*bins, s], capacity))
        if b == len(bins):
            bins.append(0)
        assert bins[b] == o
        bins[b] += s
        assert squares(bins, capacity) == min(choices) and bins[b] <= capacity


# --- HTML -----------------------------------------------------------------

def plain_article(page):
    inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S).group(1)
    blocks = (html.unescape(re.sub("<[^>]*>", " ", b)) for b in re.split(r"</?(?:h1|p)>", inner))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def test_pages_give_their_article(table):
    pages = table("pages")
    got = {r.page_id: r.text for r in H.extract_text(pages).collect()}
    assert got == {r.page_id: plain_article(r.html) for r in pages.collect()}


LONG = "This is a paragraph of the story that goes on for quite a while, with several clauses, and says something."
PAGE = f"""<html><head><title>T</title><style>p{{}}</style></head><body>
<div id="cookie-notice">We use cookies. {LONG}</div><header><h2>Site name</h2><p>{LONG}</p></header>
<ul class="main-menu"><li><a href=/a>Home</a><li><a href=/b>News</a></ul>
%s
<div class="sidebar"><p>{LONG}</p></div><form><p>{LONG}</p><input></form>
<section id="comments"><p>First! {LONG}</p></section><footer>&copy; Site {LONG}</footer><script>var x="<p>no</p>"</script></body></html>"""


@pytest.mark.parametrize("shell", ["<article>%s</article>", "<main>%s</main>", '<div class="post"><div>%s</div></div>', "%s"])
def test_boilerplate_goes_and_blocks_stay(shell):
    body = (f"<h1>A &amp; B&nbsp;title</h1><p>{LONG}</p><div class='ad'>Buy! {LONG}</div><p>Short.</p><p>  two\n words<br>x <i>y</i></p>"
            f"<ul><li>{LONG}<li>item 2</ul><blockquote>{LONG}</blockquote><p>{LONG}")
    want = ["A & B title", LONG, "Short.", "two words x y", LONG, "item 2", LONG, LONG]
    assert H.main_text(PAGE % (shell % body)).split("\n") == want


@pytest.mark.parametrize("html", [
    "<article><section id='side-effects'><h2 id='social-impact'>Effects</h2><p>%s</p></section><p class='form'>%s</p></article>",
    "<article><h2 id='comments'>Effects</h2><section id='social'><p>%s</p></section><p>%s</p></article>",
    "<div class='has-sidebar'><h2>Effects</h2><p>%s</p><p>%s</p></div>",
    "<div id='page' class='with-header'><h2>Effects</h2><p>%s</p><p>%s</p></div>",
    "<form id='aspnetForm'><input type=hidden><div><h2>Effects</h2><p>%s</p><p>%s</p></div></form>",
    "<div class='sidebar'><h2>Effects</h2><p>%s</p><p>%s</p></div>"])
def test_names_and_forms_do_not_empty_a_page(html):
    page = f"<html><body><nav><a href=/>Home</a></nav>{html}<footer>{LONG}</footer></body></html>"
    assert H.main_text(page % (LONG, LONG)).split("\n") == ["Effects", LONG, LONG]


def test_linked_line_amid_content_stays():
    html = f"<div><p>{LONG}</p><p><a href=/x>{LONG}</a></p><p>{LONG}</p>"
    assert H.main_text(html + "</div>").split("\n") == [LONG] * 3
    links = "<ul>" + f"<li><a href=/y>{LONG}</a>" * 6 + "</ul></div>"
    assert H.main_text(html + links).split("\n") == [LONG] * 3


def test_html_odd_inputs(spark):
    assert H.main_text(None) == H.main_text("") == H.main_text("<html><nav>x</nav>") == ""
    assert H.main_text("plain words") == "plain words"
    assert H.main_text("<![weird[<p>a") in ("a", "")
    deep = "<div>" * 3000 + f"<p>{LONG}</p>"
    assert H.main_text(deep) == LONG
    long = "<article>" + f"<p>{LONG}</p>" * 5000
    assert H.main_text(long) == "\n".join([LONG] * 5000)
    df = spark.createDataFrame([(1, None, None, "a"), (1, None, None, "a"), (None, "u", "<p>x y", "b")], "page_id long, url string, html string, text string")
    out = H.extract_text(df)
    assert sorted(out.columns) == ["page_id", "text", "url"] and sorted(r.text for r in out.collect()) == ["", "", "x y"]
    assert H.extract_text(df.limit(0)).count() == 0
