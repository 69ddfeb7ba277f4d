"""Substring dedup with difference-cover anchors (operator 10).

A passage of ``WINDOW`` words that occurs at two places shares an aligned
anchor: positions modulo ``PERIOD`` that lie in ``COVER`` meet for every pair
of starts within the first ``PERIOD`` offsets, because every residue is a
difference of two cover entries.  Only anchors (short windows at cover
positions, 4 of 13) are compared over the whole corpus; windows that hold a
repeated anchor are then extended to their full length and compared.

Documents are dealt once into groups by their row number.  A group sends each
distinct anchor, and later each distinct candidate window, once, so a passage
that a third of all documents share costs one entry per group and no pair is
ever listed.  The three passes read one shuffle of the texts (Spark reuses
the exchange).  Windows are compared by 95 hash bits where those of all groups
meet; a group learns which of its windows to remove by 64 of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwatch.llm.common import fresh, groups_for, mix64, ready, window_hash

WINDOW = 20
#: Perfect difference set modulo 13: fixed values.
PERIOD, COVER = 13, (0, 1, 3, 9)
CHARS_PER_GROUP = 6_000_000
ANCHORS_PER_BUCKET = 1_500_000
BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class _Words:
    """The words of a group of documents, ordered by (id, text), null last."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int):
        texts = table.column(text_col).to_pylist()
        ids = table.column(id_col).to_pylist()
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0,
                                                            texts[k] or ""))
        self.ids = [ids[k] for k in self.order]
        self.words = [(texts[k] or "").encode("utf-8", "surrogatepass").split() for k in self.order]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.first = np.cumsum(self.sizes) - self.sizes
        total, digest = int(self.sizes.sum()), xxhash.xxh3_64_intdigest
        self.h = np.fromiter((digest(w) for ws in self.words for w in ws), np.uint64, total)
        self.doc = np.repeat(np.arange(len(self.words)), self.sizes)
        self.pos = np.arange(total) - np.repeat(self.first, self.sizes)
        self.left = np.repeat(self.sizes, self.sizes) - self.pos      # words from here on
        self.window = window

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the anchors and their hashes."""
        size = self.window - PERIOD + 1
        h = window_hash(self.h, size, BASE_1)
        at = np.isin(self.pos[:len(h)] % PERIOD, COVER) & (self.left[:len(h)] >= size)
        at &= np.repeat(self.sizes >= self.window, self.sizes)[:len(h)]
        at = np.flatnonzero(at)
        return at, mix64(h[at])

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 64 and the 32 hash bits of the windows that begin at ``starts``."""
        one = mix64(window_hash(self.h, self.window, BASE_1))[starts]
        two = window_hash(mix64(self.h ^ np.uint64(BASE_2)), self.window, BASE_2)[starts]
        return one, (mix64(two) >> np.uint64(33)).astype(np.int64)

    def starts(self) -> np.ndarray:
        return np.flatnonzero(self.left >= self.window)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor repeated in this group
        or named by ``repeated``."""
        at, h = self.anchors()
        if not len(at):
            return at
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        at = at[(n[back] > 1) | np.isin(h, repeated)]
        first = np.maximum(at - (PERIOD - 1), at - self.pos[at])
        step = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, at + 1, -1)
        return np.flatnonzero((np.cumsum(step[:-1]) > 0) & (self.left >= self.window))


def _later(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """True where an equal (one, two) stands at a smaller index."""
    order = np.lexsort((np.arange(len(one)), two, one))
    same = np.zeros(len(one), bool)
    a, b = one[order], two[order]
    same[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return same


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int64()))


def _longs(table: pa.Table, name: str) -> np.ndarray:
    flat = [c.flatten() for c in table.column(name).chunks]
    return np.concatenate([np.empty(0, np.int64), *(c.to_numpy(zero_copy_only=False) for c in flat)]).astype(np.int64)


def _by_bucket(part: int, buckets: int, key: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """One row per bucket of ``key``: the group's entries as lists."""
    b = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    found, n = np.unique(b, return_counts=True)
    cuts = np.concatenate([[0], np.cumsum(n)])
    return pa.table({"bucket": pa.array(found, pa.int64()),
                     "part": pa.array(np.full(len(found), part), pa.int64()),
                     **{k: _lists(v[order].astype(np.int64), cuts) for k, v in columns.items()}})


def _send_back(parts: np.ndarray, keys: np.ndarray) -> pa.Table:
    order = np.argsort(parts, kind="stable")
    found, n = np.unique(parts, return_counts=True)
    return pa.table({"part": pa.array(found, pa.int64()),
                     "keys": _lists(keys[order], np.concatenate([[0], np.cumsum(n)]))})


def _owners(table: pa.Table, name: str) -> np.ndarray:
    sizes = np.concatenate([np.empty(0, np.int64), *(
        np.diff(c.offsets.to_numpy()) for c in table.column(name).chunks)]).astype(np.int64)
    return np.repeat(table.column("part").to_numpy(), sizes)


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     window: int = WINDOW) -> DataFrame:
    """Every row of ``df`` with ``n_words``, ``n_removed`` and ``kept_text``.

    A word goes if some ``window`` consecutive words of its document that
    cover it also start earlier: in a smaller id, or earlier in the same
    document.  Windows are judged on the input.  Kept words are joined by one
    space.  Null text: no words, empty ``kept_text``.  Texts under ``window``
    words are kept whole.  Ids are integers (text ids can't be ordered here).
    Rows with equal ids count as documents in an order fixed by a hash of their
    row numbers, null ids come last in such an order; they spread over all
    groups.  ``df`` must give the same rows in the same order when it is read
    again, as a stored table does.  Extra columns pass through;
    new columns whose name is taken replace that column.  An empty table
    gives an empty table.
    """
    if window < PERIOD + 1:
        raise ValueError(f"window must be over {PERIOD} words")
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError("ids must be integers")
    spark = ready(df.sparkSession)
    df = df.drop("n_words", "n_removed", "kept_text")
    chars = df.agg(F.sum(F.length(text_col))).first()[0] or 0
    groups = groups_for(spark, chars, CHARS_PER_GROUP)
    buckets = groups_for(spark, chars // 16, ANCHORS_PER_BUCKET, least=1)
    part = fresh("__group", df.columns)
    dealt = df.withColumn(part, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    sent = "bucket long, part long, keys array<long>"

    def send_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        w = _Words(table, id_col, text_col, window)
        h = np.unique(w.anchors()[1])
        return _by_bucket(key[0].as_py(), buckets, h, keys=h)

    def repeated_anchors(table: pa.Table) -> pa.Table:
        keys, parts = _longs(table, "keys"), _owners(table, "keys")
        _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        many = n[back] > 1
        return _send_back(parts[many], keys[many])

    def send_windows(key: tuple[pa.Scalar, ...], table: pa.Table, lists: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _by_bucket(0, buckets, np.empty(0, np.uint64),
                              **{c: np.empty(0, np.int64) for c in ("keys", "more", "ids")})
        w = _Words(table, id_col, text_col, window)
        at = w.candidates(_longs(lists, "keys").view(np.uint64))
        one, two = w.windows(at)
        first = ~_later(one, two)
        top = np.iinfo(np.int64).max
        ids = np.array([top if i is None else i for i in w.ids], np.int64)[w.doc[at[first]]]
        return _by_bucket(key[0].as_py(), buckets, one[first], keys=one[first], more=two[first], ids=ids)

    def repeated_windows(table: pa.Table) -> pa.Table:
        one, two, ids = (_longs(table, c) for c in ("keys", "more", "ids"))
        parts = _owners(table, "keys")
        order = np.lexsort((parts, ids, two, one))     # equal ids: in the order of their groups
        one, two, parts = one[order], two[order], parts[order]
        again = np.zeros(len(one), bool)
        again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        return _send_back(parts[again], one[again])

    names = df.columns
    out_schema = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()),
                               T.StructField("n_removed", T.LongType()),
                               T.StructField("kept_text", T.StringType())])

    def remove(table: pa.Table, lists: pa.Table) -> pa.Table:
        kept_columns = table.select(names)
        if not table.num_rows:
            extra = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string()}
            for name, kind in extra.items():
                kept_columns = kept_columns.append_column(name, pa.array([], kind))
            return kept_columns
        w = _Words(table, id_col, text_col, window)
        at = w.starts()
        one, two = w.windows(at)
        gone = at[_later(one, two) | np.isin(one, _longs(lists, "keys").view(np.uint64))]
        step = np.zeros(len(w.h) + 1, np.int64)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + window, -1)
        keep = np.cumsum(step[:-1]) == 0
        removed = w.sizes - np.bincount(w.doc[keep], minlength=len(w.sizes))
        texts = []
        for k, ws in enumerate(w.words):
            if removed[k]:
                mask = keep[w.first[k]:w.first[k] + len(ws)]
                ws = [ws[j] for j in np.flatnonzero(mask)]
            texts.append(b" ".join(ws).decode("utf-8", "surrogatepass"))
        kept_columns = kept_columns.take(pa.array(w.order))
        for name, values in (("n_words", pa.array(w.sizes, pa.int64())),
                             ("n_removed", pa.array(removed, pa.int64())),
                             ("kept_text", pa.array(texts, pa.string()))):
            kept_columns = kept_columns.append_column(name, values)
        return kept_columns

    back = "part long, keys array<long>"
    anchors = (dealt.groupBy(part).applyInArrow(send_anchors, sent)
               .groupBy("bucket").applyInArrow(repeated_anchors, back))
    windows = (dealt.groupBy(part).cogroup(anchors.groupBy("part"))
               .applyInArrow(send_windows, "bucket long, part long, keys array<long>, more array<long>, ids array<long>")
               .groupBy("bucket").applyInArrow(repeated_windows, back))
    return dealt.groupBy(part).cogroup(windows.groupBy("part")).applyInArrow(remove, out_schema)
