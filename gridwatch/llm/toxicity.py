"""Toxicity by class-conditional Kneser-Ney models (operator 6).

Two models, one of toxic and one of ordinary labelled text, over expressions
(words without the punctuation around them).  A word's count in a class is a
continuation count, the number of documents it occurs in, less an absolute
discount estimated from the numbers of words seen once and twice.  The mass
that is left backs off to the word's stem (first ``STEM`` letters) by the
class's number of different words of that stem, and from there to stem and
word counts that both classes share, so an expression that is rare in either
class is smoothed by the same distribution.

The log-likelihood ratio is compared per word over the whole text (see
``FEATURES``); a logistic fit turns these length-normalised figures into a
score.  It is made on a sample of each class, by models that don't count the
sampled rows; documents are then scored by models that count every row.

Counts cover all labelled rows and are made and summed by Spark.  What a task
holds is a table of every different word (20 bytes each) and stem (24 bytes)
of the labelled rows, found by hash: it grows with them, and no two words share
their counts.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.llm.common import cut, held_out, ready, training_rows

STEM, THRESHOLD = 4, 0.7
#: One training row of each class in so many calibrates, or so few that both
#: classes together have about this many rows; always one at least.
CALIBRATE_ONE_IN, CALIBRATE_ROWS = 5, 20_000
#: Characters counted and scored at once.
COUNT_CHARS, SCORE_CHARS = 1 << 22, 1 << 20
#: Of the ratios of a text's words: mean, second highest, mean of the highest
#: ``TOP``, the part above ``STRONG`` (sum and mean) and above half of it
#: (mean), and how many are above; sums and means on a log or root scale.
FEATURES, TOP, STRONG = 7, 16, 2.0

_MARKS = string.punctuation + "\u00a1\u00ab\u00b7\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u2026"
COUNTS = ("toxic", "ordinary", "toxic_fit", "ordinary_fit")
_digest = xxhash.xxh3_64_intdigest


def expressions(text: str) -> list[str]:
    return [w for w in (x.strip(_MARKS) for x in text.lower().split()) if w]


def word_counts(labelled: DataFrame) -> DataFrame:
    """``(word, stem, toxic, ordinary, toxic_fit, ordinary_fit)``: hashes and in
    how many documents of each class a word occurs, and in how many of these
    that don't calibrate, over ``labelled(text, toxic, calibrates)``.  A task
    adds up its own documents before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by class, first the rows that don't calibrate
        seen: tuple[dict, dict, dict, dict] = ({}, {}, {}, {})
        held = 0

        def flush() -> pa.RecordBatch:
            words = list(set().union(*seen))
            n = [np.fromiter((c.get(w, 0) for w in words), np.int64, len(words)) for c in seen]
            out = pa.RecordBatch.from_arrays([
                pa.array(np.fromiter((_digest(w) for w in words), np.uint64, len(words)).view(np.int64)),
                pa.array(np.fromiter((_digest(w[:STEM]) for w in words), np.uint64, len(words)).view(np.int64)),
                *map(pa.array, (n[1] + n[3], n[0] + n[2], n[1], n[0]))], names=["word", "stem", *COUNTS])
            for c in seen:
                c.clear()
            return out

        for batch in batches:
            for text, kind in zip(batch.column(0), batch.column(1), strict=True):
                counts, text = seen[kind.as_py()], text.as_py()
                for w in set(expressions(text)):
                    counts[w] = counts.get(w, 0) + 1
                held += len(text)
                if held >= COUNT_CHARS:
                    yield flush()
                    held = 0
        yield flush()

    return (labelled.select("text", F.col("toxic").cast("int") + 2 * F.col("calibrates").cast("int"))
            .mapInArrow(count, "word long, stem long, " + ", ".join(f"{c} long" for c in COUNTS))
            .groupBy("word", "stem").agg(*[F.sum(c).alias(c) for c in COUNTS]))


class Model:
    """Tables in order of ``keys`` (hashes of words, of stems), class columns
    toxic and ordinary: ``words`` discounted counts / total, and the shared
    count; ``stems`` likewise, the shared count of different words and that of
    all occurrences.  What has no key counts zero."""

    def __init__(self, words: np.ndarray, stems: np.ndarray, back: np.ndarray, stem_back: np.ndarray,
                 keys: tuple[np.ndarray, np.ndarray] | None = None):
        self.words, self.stems, self.back, self.stem_back = words, stems, back, stem_back
        self.keys = keys or (np.arange(len(words), dtype=np.uint64), np.arange(len(stems), dtype=np.uint64))
        self.kinds = float(stems[:, 2].sum())
        self.fit, self.bias = np.zeros(FEATURES), 0.0

    def log_ratios(self, words: list[str]) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary)."""
        n = len(words)
        w = _found(self.keys[0], self.words, np.fromiter(map(_digest, words), np.uint64, n))
        s = _found(self.keys[1], self.stems, np.fromiter((_digest(x[:STEM]) for x in words), np.uint64, n))
        shared_stem = (s[:, 2] + .5) / (self.kinds + 1000)
        shared_word = (w[:, 2] + .5) / (s[:, 3] + 5)
        stem = s[:, :2] + self.stem_back * shared_stem[:, None]
        p = w[:, :2] + self.back * stem * shared_word[:, None]
        return np.log(p[:, 0] / p[:, 1])

    def features(self, texts: list[str]) -> np.ndarray:
        """``FEATURES`` per text; all 0 without words."""
        order: dict[str, int] = {}
        at = [[order.setdefault(w, len(order)) for w in expressions(t)] for t in texts]
        ratio = self.log_ratios(list(order)) if order else np.empty(0)
        out = np.zeros((len(texts), FEATURES))
        for k, words in enumerate(at):
            if words:
                r = ratio[words]
                n = min(TOP, len(r))
                top = np.sort(np.partition(r, len(r) - n)[len(r) - n:])
                over, half = np.clip(r - STRONG, 0, None), np.clip(r - STRONG / 2, 0, None)
                out[k] = (r.mean(), top[-min(2, n)], math.log1p(over.sum()), math.sqrt(half.mean()),
                          math.sqrt(over.mean()), math.log1p((over > 0).sum()), top.mean())
        return out


def _found(keys: np.ndarray, table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of ``table`` by key, zeros where there is none."""
    out = np.zeros((len(wanted), table.shape[1]))
    if len(keys):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        known = keys[at] == wanted
        out[known] = table[at[known]]
    return out


def _table(rows: DataFrame, key: str, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of ``rows`` in order, and their ``columns``."""
    got = rows.select(key, *[F.col(c).cast("float").alias(c) for c in columns]).toArrow()
    keys = got.column(key).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    out = np.zeros((len(keys), len(columns)), np.float32)
    for k, c in enumerate(columns):
        out[:, k] = got.column(c).to_numpy()[order]
    return keys[order], out


def _discounts(rows: DataFrame) -> tuple[list[float], list[float], list[int]]:
    """Per class of ``rows(toxic, ordinary)``: discount n1 / (n1 + 2 n2), the
    share of mass that it takes, and the total."""
    sums = [x for c in ("toxic", "ordinary") for x in (
        F.sum((F.col(c) == 1).cast("long")), F.sum((F.col(c) == 2).cast("long")),
        F.sum((F.col(c) > 0).cast("long")), F.sum(c))]
    got = [int(x or 0) for x in rows.agg(*sums).first()]
    discount, back, total = [], [], []
    for n1, n2, kinds, n in (got[:4], got[4:]):
        d = min(.98, max(.5, n1 / (n1 + 2 * n2))) if n1 else .5
        discount.append(d)
        back.append(d * kinds / n if n else 1.0)
        total.append(max(1, n))
    return discount, back, total


def _discounted(discount: list[float], total: list[int]) -> list:
    return [(F.greatest(F.col(c) - F.lit(d), F.lit(0.0)) / F.lit(float(n))).alias(c)
            for c, d, n in zip(("toxic", "ordinary"), discount, total, strict=True)]


def calibration(keys: DataFrame) -> dict[bool, tuple[int, int]]:
    """Per class of ``keys(toxic, order)``: its rows, and the hash up to which
    they calibrate."""
    out = {}
    for r in keys.groupBy("toxic").agg(F.count("*").alias("n"), F.min("order").alias("least")).collect():
        part = min(1 / CALIBRATE_ONE_IN, CALIBRATE_ROWS / 2 / r["n"])
        out[r["toxic"]] = r["n"], max(r["least"], int(part * 2 ** 64) - 2 ** 63)
    return out


def counted(words: DataFrame, toxic: str, ordinary: str) -> Model:
    """The models of two count columns of ``words``."""
    words = words.select("word", "stem", F.col(toxic).alias("toxic"), F.col(ordinary).alias("ordinary")).where("toxic + ordinary > 0")
    stems = cut(words.groupBy("stem").agg(F.sum((F.col("toxic") > 0).cast("long")).alias("toxic"),
                                          F.sum((F.col("ordinary") > 0).cast("long")).alias("ordinary"),
                                          F.sum(F.col("toxic") + F.col("ordinary")).alias("uses")))
    d, back, total = _discounts(words)
    sd, stem_back, stem_total = _discounts(stems)
    both = (F.col("toxic") + F.col("ordinary")).alias("both")
    word_keys, word_table = _table(words.select("word", *_discounted(d, total), both), "word", ["toxic", "ordinary", "both"])
    stem_keys, stem_table = _table(stems.select("stem", *_discounted(sd, stem_total), both, "uses"), "stem",
                                   ["toxic", "ordinary", "both", "uses"])
    return Model(word_table, stem_table, np.array(back), np.array(stem_back), (word_keys, stem_keys))


def train(spark: SparkSession, labelled: DataFrame, calibrating: DataFrame, sizes: dict[bool, int]) -> Model:
    """Counts over all rows of ``labelled(text, toxic, calibrates, order)``; the
    logistic fit on ``calibrating``, those of its rows that calibrate, by counts
    over the others.  ``sizes``: labelled rows of each class."""
    words = cut(word_counts(labelled))
    # copies of a row count once; few rows, as the hash bounds them
    sample = (features(spark, calibrating, counted(words, "toxic_fit", "ordinary_fit"), "text")
              .select("order", "toxic", "features").distinct().orderBy("order").limit(2 * CALIBRATE_ROWS).collect())
    y = np.array([r["toxic"] for r in sample], bool)
    x = np.array([r["features"] for r in sample], np.float64).reshape(-1, FEATURES)
    weight = np.zeros(len(y))
    for toxic, n in sizes.items():
        weight[y == toxic] = n / max(1, (y == toxic).sum())
    model = counted(words, "toxic", "ordinary")
    model.fit, model.bias = logistic(x, y.astype(np.float64), weight=weight / weight.mean() if len(y) else weight)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2,
             weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Newton's method with a small ridge, on scaled features; one class only
    leaves its share alone."""
    weight = np.ones(len(y)) if weight is None else weight
    share = ((weight * y).sum() + .5) / (weight.sum() + 1)
    if not 0 < y.sum() < len(y):
        return np.zeros(x.shape[1]), math.log(share / (1 - share))
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([(x - mean) / dev, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        g = z.T @ (weight * (p - y)) + ridge * w
        h = (z * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1, 4 / (np.abs(step).max() + 1e-9))
    return w[:-1] / dev, float(w[-1] - (w[:-1] * mean / dev).sum())


def features(spark: SparkSession, df: DataFrame, model: Model, text_col: str, out: str = "features") -> DataFrame:
    """``df`` without its text, with the features of the whole text (null: empty)."""
    shared = spark.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in batches:
            rows, texts, held = [np.zeros((0, FEATURES))], [], 0
            for text in batch:
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= SCORE_CHARS:
                    rows.append(m.features(texts))
                    texts, held = [], 0
            if texts:
                rows.append(m.features(texts))
            flat = np.concatenate(rows).reshape(-1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, FEATURES), pa.int32()), pa.array(flat))

    return df.withColumn(out, F.arrow_udf(of, "array<double>")(F.col(text_col))).drop(text_col)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic") -> DataFrame:
    """``(id_col, held_out, score, predicted)`` per row of ``df``.

    Labels come from ``labels(id_col, label_col)`` for rows that are not held
    out; a repeated label counts as toxic if any of its rows does, null labels
    and ids not at all.  Scores depend on the text alone; null and empty texts
    get that of a text with no evidence.  Without labels of both kinds every
    score is their share.  An empty table gives no rows.
    """
    spark = ready(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # joined by shuffle at every size: the labels grow with the corpus
    marks = (labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg((F.max(label_col) > 0).alias("toxic")))
    taught = rows.where(training_rows("id") & F.col("text").isNotNull()).withColumn("order", F.xxhash64("id"))
    ends = calibration(taught.select("id", "order").join(marks.hint("merge"), "id").select("toxic", "order"))
    end = F.when(F.col("toxic"), ends.get(True, (0, -2 ** 63))[1]).otherwise(ends.get(False, (0, -2 ** 63))[1])

    def labelled(part: DataFrame) -> DataFrame:
        return (part.join(marks.hint("merge"), "id")
                .select("text", "toxic", (F.col("order") <= end).alias("calibrates"), "order"))

    # only the hashes that can calibrate are joined again
    few = taught.where(F.col("order") <= max((e for _, e in ends.values()), default=-2 ** 63))
    model = train(spark, labelled(taught), labelled(few).where("calibrates"), {k: n for k, (n, _) in ends.items()})
    shared = features(spark, rows.withColumn("held_out", held_out("id")), model, "text", "f")
    logit = sum((F.get("f", F.lit(k)) * float(w) for k, w in enumerate(model.fit)), F.lit(model.bias))
    score = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(40.0)), F.lit(-40.0))))
    return (shared.withColumn("score", score)
            .select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
