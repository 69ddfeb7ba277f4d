"""Lempel-Ziv phrase fingerprints (operator 1).

A text is parsed into dictionary phrases (each the shortest one not seen
before); the fingerprint keeps the ``KEEP`` smallest hashes of the phrase
set, and two fingerprints are compared by the share of common entries among
the smallest of their union, an estimate of the phrase sets' Jaccard index.

The comparison with the next document needs neighbours in id order.  Ids are
cut into ranges at approximate quantiles (the only thing the driver holds:
one boundary and one head id per range), a range is sorted in its own task
and streamed, and the first document of the range behind follows it as a last
row.  Texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import ready, shuffle_partitions

KEEP, DIGITS = 128, 8
CHARS_PER_RANGE, MOST_RANGES = 8_000_000, 20_000

_digest = xxhash.xxh3_64_intdigest


def _parse(text: str, seen: set[str], open_: str, new: list[str]) -> str:
    """Go on parsing with the dictionary ``seen`` and the open phrase."""
    add, found = seen.add, new.append
    for ch in text:
        open_ += ch
        if open_ not in seen:
            add(open_)
            found(open_)
            open_ = ""
    return open_


def _hashes(phrases: list[str]) -> np.ndarray:
    return np.fromiter(map(_digest, phrases), np.uint64, len(phrases)) >> np.uint64(32)


def _smallest(*hashes: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate(hashes))[:KEEP]


def phrases(text: str) -> set[str]:
    seen: set[str] = set()
    _parse(text, seen, "", [])
    return seen


def signature(text: str | None) -> np.ndarray:
    return _smallest(_hashes(list(phrases(text or ""))))


def written(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; two empty signatures are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.unique(np.concatenate([a, b]))[:KEEP]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True)).sum() / len(union))


def edited(text: str, other: str) -> str:
    """``text`` with its last half replaced by the first characters of ``other``."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


class _Open:
    """A document that waits for its successor: parsed, with the state that
    its unchanged first half leaves, so the edited text parses on from there."""

    def __init__(self, doc_id: int | None, text: str):
        self.id, self.text, self.half = doc_id, text, len(text) // 2
        cut, first, rest = len(text) - self.half, [], []
        seen: set[str] = set()
        self.state = _parse(text[:cut], seen, "", first)
        self.seen = seen.copy()
        _parse(text[cut:], seen, self.state, rest)
        self.first = _hashes(first)
        self.signature = _smallest(self.first, _hashes(rest))

    def close(self, other: str, other_signature: np.ndarray) -> tuple:
        new: list[str] = []
        _parse(other[:self.half], self.seen, self.state, new)
        changed = _smallest(self.first, _hashes(new))
        digest = hashlib.sha256(edited(self.text, other).encode("utf-8", "surrogatepass")).hexdigest()
        return (self.id, len(self.text), digest, written(self.signature), written(changed),
                likeness(self.signature, changed), likeness(self.signature, other_signature))


def _position(bounds: list[int], value: Column) -> Column:
    """Number of ``bounds`` (ascending) at or below ``value``: binary search."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= value), at + step).otherwise(at))


def neighbour_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The next document is that of the next smaller id; rows with equal ids
    follow each other in the order of a hash of their texts, null ids come
    last in an order fixed by that hash, and the last document is followed by the first (a single document
    by itself).  A null text counts as empty; equal texts have equal
    fingerprints.  Extra columns are left out; an empty table gives no rows.
    """
    spark = ready(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    chars, least, nulls = rows.agg(F.sum(F.length("text")), F.min("id"), F.max(F.col("id").isNull())).first()
    ranges = min(MOST_RANGES, max(shuffle_partitions(spark), -(-(chars or 0) // CHARS_PER_RANGE)))
    bounds: list[int] = []
    if least is not None:
        marks = [k / ranges for k in range(1, ranges)]
        found = rows.agg(F.percentile_approx("id", marks, 10 * ranges)).first()[0] if marks else []
        bounds = sorted({int(x) for x in found if x > least})
    # ranges in the order of the walk: 0 holds the largest ids; rows without
    # an id come behind the smallest, dealt over ranges by a hash of the text
    rows = rows.withColumn("tie", F.xxhash64("text"))
    of_id = F.lit(len(bounds)) - _position(bounds, F.col("id")) if bounds else F.lit(0)
    behind = F.lit(len(bounds) + 1) + F.pmod(F.col("tie"), F.lit(ranges if nulls else 1))
    rows = rows.withColumn("range", F.when(F.col("id").isNull(), behind).otherwise(of_id).cast("int"))
    tops = rows.groupBy("range").agg(F.max("id").alias("top")).orderBy("range").collect()   # one row a range
    kind = df.schema[id_col].dataType.simpleString()
    out = (f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
    if not tops:
        return rows.limit(0).mapInArrow(lambda batches: iter(()), out).withColumn(id_col, F.col(id_col).cast(kind))
    before = {t["range"]: tops[k - 1]["range"] for k, t in enumerate(tops)}
    heads = spark.createDataFrame([(t["range"], t["top"], before[t["range"]]) for t in tops],
                                  "at int, top long, previous int")
    head = (rows.join(F.broadcast(heads), (F.col("range") == F.col("at")) & F.col("id").eqNullSafe(F.col("top")))
            .groupBy("previous").agg(F.min(F.struct("tie", "text")).alias("first"))
            .select(F.lit(None).cast("long").alias("id"), "first.text", F.col("previous").alias("range"),
                    F.lit(0).cast("long").alias("tie"), F.lit(True).alias("last")))
    walked = (rows.withColumn("last", F.lit(False)).unionByName(head)
              .repartitionById(len(bounds) + 1 + (ranges if nulls else 0), F.col("range"))
              .sortWithinPartitions("range", "last", F.col("id").desc_nulls_last(), "tie", "text"))

    names = [c.split()[0] for c in out.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: _Open | None = None
        for batch in batches:
            done = []
            for doc_id, text, last in zip(batch.column("id"), batch.column("text"), batch.column("last"), strict=True):
                text = text.as_py()
                if last.as_py():
                    done.append(waiting.close(text, signature(text)))
                    waiting = None
                    continue
                doc = _Open(doc_id.as_py(), text)
                if waiting is not None:
                    done.append(waiting.close(text, doc.signature))
                waiting = doc
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*done, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return walked.select("id", "text", "last").mapInArrow(walk, out).withColumn(id_col, F.col(id_col).cast(kind))
