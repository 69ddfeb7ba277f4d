"""Language ID by a bidirectional gated recurrent network over bytes (operator 2).

The network reads UTF-8 bytes in both directions, gives every position a
distribution over the learned languages, and a document's probabilities are
the mean over all its positions.  It is trained in numpy by backpropagation
through time on a bounded sample of labelled rows (``PER_LANG`` documents a
language, one passage of ``PASSAGE`` characters each); prediction reads every
whole text.  Long texts are cut into windows of ``SPAN`` bytes, as in
training, so all windows of a batch advance together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwatch.llm.common import fresh, held_out, ready, training_rows

UNDETERMINED = "und"
#: Bounds of the training sample and the network's size.
PER_LANG, PASSAGE = 400, 640
SPAN, HIDDEN, STEPS, BATCH, RATE = 64, 8, 350, 192, 0.02
#: Windows that advance together in prediction, and bytes gathered before.
ADVANCE, GATHER = 512, 1 << 21


class BiGRU:
    """Weights of both directions stacked on the first axis: ``x`` (2, 256,
    3H) byte inputs with biases, ``u`` (2, H, 3H), ``b`` (2, 1, H) inside the
    reset gate, ``o`` (2H, C) and ``c`` (C) outputs.  Gates: reset, update,
    candidate."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.classes, self.h = classes, hidden
        self.w = {
            "x": rng.normal(0, .3, (2, 256, 3 * hidden)).astype(f),
            "u": rng.normal(0, .3, (2, hidden, 3 * hidden)).astype(f),
            "b": np.zeros((2, 1, hidden), f),
            "o": rng.normal(0, .3, (2 * hidden, len(classes))).astype(f),
            "c": np.zeros(len(classes), f),
        }

    def forward(self, text: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Probabilities (SPAN, B, C) of windows ``text`` (SPAN, B)
        uint8; ``mask`` (SPAN, B) is 0 behind a window's end."""
        w, h = self.w, self.h
        span, n = text.shape
        half = np.float32(.5)
        state = np.zeros((2, n, h), np.float32)
        out = np.empty((span, n, 2 * h), np.float32)
        for t in range(span):
            back = span - 1 - t
            x = np.stack([w["x"][0][text[t]], w["x"][1][text[back]]])
            hu = state @ w["u"]
            gates = x[:, :, :2 * h] + hu[:, :, :2 * h]
            gates *= half
            np.tanh(gates, out=gates)
            gates += 1
            gates *= half
            r, z = gates[:, :, :h], gates[:, :, h:]
            inner = hu[:, :, 2 * h:] + w["b"]
            cand = np.tanh(x[:, :, 2 * h:] + r * inner)
            new = cand + z * (state - cand)
            m = np.stack([mask[t], mask[back]])[:, :, None]
            new *= m
            if keep is not None:
                keep.append((state, r, z, inner, cand, m))
            state = new
            out[t, :, :h], out[back, :, h:] = state[0], state[1]
        logits = out @ w["o"] + w["c"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        if keep is not None:
            keep.append(out)
        return logits

    def gradients(self, text: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions, and its gradient by
        backpropagation through time."""
        w, h = self.w, self.h
        keep: list = []
        p = self.forward(text, mask, keep)
        out = keep.pop()
        span, n = text.shape
        total = mask.sum()
        loss = float(-(np.log(p[:, np.arange(n), label] + 1e-9) * mask).sum() / total)
        d = p.copy()
        d[:, np.arange(n), label] -= 1
        d *= mask[:, :, None] / total
        g = {"o": np.einsum("tnh,tnc->hc", out, d), "c": d.sum(axis=(0, 1)),
             "x": np.zeros_like(w["x"]), "u": np.zeros_like(w["u"]), "b": np.zeros_like(w["b"])}
        dout = d @ w["o"].T
        carry = np.zeros((2, n, h), np.float32)
        for t in reversed(range(span)):
            back = span - 1 - t
            state, r, z, inner, cand, m = keep[t]
            carry[0] += dout[t, :, :h]
            carry[1] += dout[back, :, h:]
            carry *= m
            dz = carry * (state - cand) * z * (1 - z)
            dc = carry * (1 - z) * (1 - cand * cand)
            dr = dc * inner * r * (1 - r)
            di = dc * r
            dx = np.concatenate([dr, dz, dc], axis=2)
            dhu = np.concatenate([dr, dz, di], axis=2)
            np.add.at(g["x"][0], text[t], dx[0])
            np.add.at(g["x"][1], text[back], dx[1])
            g["u"] += state.transpose(0, 2, 1) @ dhu
            g["b"] += di.sum(axis=1, keepdims=True)
            carry = carry * z + dhu @ w["u"].transpose(0, 2, 1)
        return loss, g

    def fit(self, texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = 11) -> BiGRU:
        """Adam over windows drawn evenly from the classes; deterministic."""
        rng = np.random.default_rng(seed)
        by = [[k for k, c in enumerate(labels) if c == j and texts[k]] for j in range(len(self.classes))]
        by = [b for b in by if b]
        if len(by) < 2:
            return self
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            pick = [by[k % len(by)][rng.integers(len(by[k % len(by)]))] for k in range(BATCH)]
            text = np.zeros((SPAN, BATCH), np.uint8)
            mask = np.zeros((SPAN, BATCH), np.float32)
            for j, k in enumerate(pick):
                a = int(rng.integers(max(1, len(texts[k]) - SPAN + 1)))
                b = np.frombuffer(texts[k][a:a + SPAN], np.uint8)
                text[:len(b), j], mask[:len(b), j] = b, 1
            _, g = self.gradients(text, mask, np.array([labels[k] for k in pick]))
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = RATE * (1 - .9 * step / steps) * min(1, 1 / (norm + 1e-9))
            for k, x in g.items():
                m[k] += .1 * (x - m[k])
                v2[k] += .01 * (x * x * min(1, 1 / (norm + 1e-9)) ** 2 - v2[k])
                self.w[k] -= (rate * m[k] / (1 - .9 ** step)
                              / (np.sqrt(v2[k] / (1 - .99 ** step)) + 1e-8)).astype(np.float32)
        return self

    def _steps(self) -> dict[str, np.ndarray]:
        """The weights by gate, each gate contiguous, the sigmoids' inner and
        outer halves folded in: sigmoid(a) = (tanh(a / 2) + 1) / 2."""
        w, h, half = self.w, self.h, np.float32(.5)
        cut = {"r": slice(0, h), "z": slice(h, 2 * h), "n": slice(2 * h, 3 * h)}
        out = {f"u{k}": np.ascontiguousarray(w["u"][:, :, c]) * half for k, c in cut.items()}
        out |= {f"x{k}": np.ascontiguousarray(w["x"][:, :, c]).reshape(512, h) for k, c in cut.items()}
        return out | {"xr": out["xr"] * half, "xz": out["xz"] * half, "b": w["b"] * half}

    def positions(self, text: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """``forward`` for prediction: (C, SPAN, B), the same values."""
        s, h = self._ready, self.h
        span, n = text.shape
        at = np.concatenate([text.astype(np.intp), text[::-1].astype(np.intp) + 256], axis=1)
        state = np.zeros((2, n, h), np.float32)
        out = np.empty((2, span, n, h), np.float32)
        r, z, c, x = (np.empty((2, n, h), np.float32) for _ in range(4))
        flat = x.reshape(2 * n, h)
        half = np.float32(.5)
        for t in range(span):
            np.take(s["xr"], at[t], axis=0, out=flat, mode="clip")
            np.matmul(state, s["ur"], out=r)
            r += x
            np.tanh(r, out=r)
            r += 1
            np.matmul(state, s["un"], out=c)
            c += s["b"]
            c *= r
            np.take(s["xn"], at[t], axis=0, out=flat, mode="clip")
            c += x
            np.tanh(c, out=c)
            np.take(s["xz"], at[t], axis=0, out=flat, mode="clip")
            np.matmul(state, s["uz"], out=z)
            z += x
            np.tanh(z, out=z)
            z += 1
            z *= half
            state -= c
            state *= z
            state += c
            if mask is not None:
                state[0] *= mask[t, :, None]
                state[1] *= mask[span - 1 - t, :, None]
            out[:, t] = state
        o = self.w["o"]
        logits = out[0].reshape(-1, h) @ o[:h] + out[1, ::-1].reshape(-1, h) @ o[h:] + self.w["c"]
        p = np.ascontiguousarray(logits.T)
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p.reshape(-1, span, n)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean position probabilities (len(texts), C) of whole texts."""
        self._ready = self._steps()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        spans = -(-sizes // SPAN)
        doc = np.repeat(np.arange(len(texts)), spans)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans)
        used = np.minimum(SPAN, sizes[doc] - at * SPAN)
        grid = np.zeros((len(doc), SPAN), np.uint8)
        grid[np.arange(SPAN) < used[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
        sums = np.zeros((len(texts), len(self.classes)))
        full = used == SPAN
        for whole in (True, False):
            rows = np.flatnonzero(full == whole)
            for k in range(0, len(rows), ADVANCE):
                some = rows[k:k + ADVANCE]
                mask = None if whole else (np.arange(SPAN)[:, None] < used[some]).astype(np.float32)
                p = self.positions(np.ascontiguousarray(grid[some].T), mask)
                if mask is not None:
                    p *= mask
                np.add.at(sums, doc[some], p.sum(axis=1).T)
        return sums / np.maximum(sizes, 1)[:, None]


def train(labelled: DataFrame, text_col: str, lang_col: str, order: Column) -> BiGRU:
    """A network fitted to at most ``PER_LANG`` rows of each language, chosen
    by a hash of ``order``; null languages and empty texts don't take part."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                           F.xxhash64(order).alias("at")).where("lang is not null and length(text) > 0")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}      # one row a language
    classes = sorted(sizes)
    if not classes:
        return BiGRU([])
    # A hash sieve leaves about twice the bound of each language; the exact
    # bound is then a window over those few rows.
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2 * PER_LANG / n))])
    some = rows.where(F.pmod("at", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("at", F.xxhash64("text")))
    begin = F.pmod(F.xxhash64("at"), F.greatest(F.length("text") - PASSAGE, F.lit(1))).cast("int") + 1
    some = (some.withColumn("n", nth).where(F.col("n") <= PER_LANG)
            .select("lang", "at", F.substring("text", begin, F.lit(PASSAGE)).alias("passage")))
    sample = sorted((r["at"], r["lang"], r["passage"]) for r in some.collect())
    return BiGRU(classes).fit([r[2].encode("utf-8", "surrogatepass") for r in sample],
                              [classes.index(r[1]) for r in sample])


def predict(df: DataFrame, net: BiGRU, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` from the text alone.

    Null texts, texts without a letter, and all texts where nothing could be
    learned get ``und`` with score 0.  Other columns pass through; columns
    named like the two new ones are replaced.
    """
    ready(df.sparkSession)
    verdict = fresh("__verdict", df.columns)
    classes = [*net.classes, UNDETERMINED]

    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            best = np.full(len(texts), len(net.classes))
            score = np.zeros(len(texts))
            group: list[int] = []
            data: list[bytes] = []

            def flush() -> None:
                if group:
                    p = net.documents(data)
                    best[group], score[group] = p.argmax(axis=1), p.max(axis=1)
                    group.clear()
                    data.clear()

            held = 0
            for k, text in enumerate(texts):
                text = text.as_py()
                if text is None or not net.classes or not any(map(str.isalpha, text)):
                    continue
                group.append(k)
                data.append(text.encode("utf-8", "surrogatepass"))
                held += len(data[-1])
                if held >= GATHER:
                    flush()
                    held = 0
            flush()
            yield pa.StructArray.from_arrays(
                [pa.array([classes[k] for k in best], pa.string()), pa.array(np.clip(score, 0, 1))],
                names=["lang_pred", "score"])

    of = F.arrow_udf(label, "lang_pred string, score double")
    return (df.drop("lang_pred", "score").withColumn(verdict, of(F.col(text_col)))
            .select("*", f"{verdict}.lang_pred", f"{verdict}.score").drop(verdict))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``df`` with ``held_out``, ``lang_pred`` and ``score``; learned from the
    rows that are not held out.  A null id is not held out."""
    net = train(df.where(training_rows(id_col)), text_col, lang_col, F.col(id_col))
    return predict(df.withColumn("held_out", held_out(id_col)), net, text_col)
