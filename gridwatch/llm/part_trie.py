"""Vector compression by codebooks of vector parts, with tries (operator 11).

Vectors of integers are cut into equal parts; every part position has a
codebook that a few rounds of k-means refine.  The distances of all entries
to all parts are found by walking a trie: the distinct parts in lexicographic
order, one level per dimension.  A node holds, for every entry, the squared
distance summed over the dimensions of its prefix, so parts that share a
prefix share that sum; a leaf takes the nearest entry and adds its part, times
the number of vectors that hold it, to the entry's sums.  The walk goes depth
first and holds the sums of one path, and of one small subtree at its end.

Every round is one pass over the stored vectors.  A task walks the tries of
blocks of its rows and returns one row per entry that got parts; only these
sums are shuffled, and the codebooks (entries x dimensions numbers, whatever
the number of vectors) go back with the next pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwatch.llm.common import cut, ready

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose tries are built at once, and leaves of a subtree that is
#: walked level by level.
BLOCK, SUBTREE = 16384, 2048
#: Components this large or larger (times SCALE) aren't coded.
LARGEST = 2 ** 62
#: Below this, squared distances and their sums fit 64 bits.
NARROW = 2 ** 24


def walk(parts: np.ndarray, book: np.ndarray, leaf: Callable[[int, int, np.ndarray], None]) -> None:
    """Calls ``leaf(a, b, distances)`` for all rows a..b of ``parts`` (distinct,
    in lexicographic order), with the squared distance to every entry of ``book``."""
    depth = parts.shape[1]

    def step(sums: np.ndarray, values: np.ndarray, level: int) -> np.ndarray:
        d = values[:, None] - book[None, :, level]
        return sums + d * d

    def subtree(a: int, b: int, level: int, sums: np.ndarray) -> None:
        sums = sums[None, :]                           # one row per node of the level
        node = np.zeros(b - a, np.int64)               # of every leaf
        for k in range(level, depth):
            new = np.ones(b - a, bool)
            new[1:] = (node[1:] != node[:-1]) | (parts[a + 1:b, k] != parts[a:b - 1, k])
            at = np.flatnonzero(new)
            sums = step(sums[node[at]], parts[a + at, k], k)
            node = np.cumsum(new) - 1
        leaf(a, b, sums[node])

    todo = [(0, len(parts), 0, np.zeros(len(book), parts.dtype))]     # sums of the parent
    while todo:
        a, b, level, above = todo.pop()
        own = step(above, parts[a:a + 1, level - 1], level - 1)[0] if level else above
        if b - a <= SUBTREE:
            subtree(a, b, level, own)
            continue
        starts = [a, *(np.flatnonzero(parts[a + 1:b, level] != parts[a:b - 1, level]) + a + 1).tolist()]
        for s, e in zip(reversed(starts), [b, *reversed(starts[1:])], strict=True):
            todo.append((s, e, level + 1, own))


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, every row's number, counts."""
    if parts.dtype == object:
        order = np.array(sorted(range(len(parts)), key=lambda k: tuple(parts[k])), np.int64)
    else:
        order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    rows = parts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    return rows[new], number, np.diff(np.concatenate([np.flatnonzero(new), [len(rows)]]))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the lower of equals) and squared distance of distinct
    sorted parts."""
    code, error = np.empty(len(parts), np.int64), np.empty(len(parts), parts.dtype)

    def leaf(a: int, b: int, d: np.ndarray) -> None:
        code[a:b] = best = d.argmin(axis=1)
        error[a:b] = d[np.arange(b - a), best]

    walk(parts, book, leaf)
    return code, error


def _integers(vectors: list | np.ndarray, scale: int, narrow: bool) -> np.ndarray:
    """floor(scale * x): 64-bit where all distances fit, else exact integers."""
    if narrow:
        return np.floor(np.array(vectors, np.float64) * scale).astype(np.int64)
    out = np.empty(np.shape(vectors), object)
    for k, v in enumerate(vectors):
        out[k] = [int(np.floor(x * scale)) for x in v]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: int, edge: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, which are coded, their integer vectors), up to BLOCK rows each."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(k, BLOCK)
            vectors = rows.column("__vector")
            flat, size = vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy()
            coded = size == dim
            kept = flat[np.repeat(coded, size)].reshape(int(coded.sum()), max(dim, 0))
            most = np.abs(kept).max(axis=1, initial=0)
            small = most < LARGEST / scale
            coded[coded] = small
            yield rows, coded, _integers(kept[small], scale, max(edge, most[small].max(initial=0) * scale) < NARROW)


def _edge(books: list[np.ndarray]) -> int:
    return max((abs(int(x)) for b in books for x in b.ravel()), default=0)


def _typed(books: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    return [b.astype(x.dtype) for b in books]


def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def sums(rows: DataFrame, books: list[np.ndarray], scale: int) -> DataFrame:
    """``(part, entry, n, total)``: what one round gives every entry."""
    dim, edge = sum(b.shape[1] for b in books), _edge(books)
    each = dim // len(books)

    def one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for _, _, x in _blocks(batches, dim, scale, edge):
            for p, book in enumerate(_typed(books, x)):
                parts, _, count = distinct(x[:, p * each:(p + 1) * each])
                code, _ = nearest(parts, book)
                order = np.argsort(code, kind="stable")
                entries, first = np.unique(code[order], return_index=True)
                if len(entries):
                    n = np.add.reduceat(count[order], first)
                    total = np.add.reduceat((parts * count[:, None].astype(x.dtype))[order], first, axis=0)
                    for e, m, t in zip(entries.tolist(), n.tolist(), total.tolist(), strict=True):
                        old = found.setdefault((p, e), [0, [0] * each])
                        old[0] += m
                        old[1] = [a + int(b) for a, b in zip(old[1], t, strict=True)]
        keys = sorted(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()),
             pa.array([found[k][0] for k in keys], pa.int64()),
             pa.array([[Decimal(v) for v in found[k][1]] for k in keys], pa.list_(pa.decimal128(38, 0)))],
            names=["part", "entry", "n", "total"])

    return (rows.select("__vector").mapInArrow(one_task, "part int, entry int, n long, total array<decimal(38,0)>")
            .groupBy("part", "entry")
            .agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[k]).cast("decimal(38,0)").alias(f"d{k}") for k in range(each))))


def codebooks(rows: DataFrame, id_col: str, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """The refined codebook of every part position, as exact integers."""
    first = rows.orderBy(F.col(id_col).asc_nulls_last(), "__vector").limit(entries).select("__vector").collect()
    dim = len(first[0][0]) if first else 0
    if not first or dim % parts:
        return []
    seeds = [_integers([r[0]], scale, False)[0] for r in first
             if len(r[0]) == dim and max(map(abs, r[0]), default=0) < LARGEST / scale]
    each = dim // parts
    books = [np.array([s[p * each:(p + 1) * each] for s in seeds], object).reshape(len(seeds), each) for p in range(parts)]
    for _ in range(rounds if seeds else 0):
        for r in sums(rows, books, scale).collect():          # parts x entries rows at most
            books[r["part"]][r["entry"]] = [int(r[f"d{k}"]) // r["n"] for k in range(each)]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``(id_col, code, error, label_error, codebooks_sha256)``, one row per
    vector that is kept.

    Rows whose vector is null or holds null or non-finite components are
    dropped.  Components become floor(scale * x); codebooks begin as the parts
    of the ``entries`` vectors of the smallest ids (null ids last, equal ids by
    their vectors).  The dimension is that of the first of these.  Vectors of
    another length, or with a component at 2**62 / ``scale`` or above, are not
    coded: code and error null (all vectors, if the dimension is no multiple of
    ``parts``).  Vectors without components have the code of entry 0 and no
    error.  ``error`` is null where it exceeds 64 bits.  Labels sum with
    equal labels, null with null; without ``label_col`` that column is left out.
    Repeated rows stay; extra columns are left out, whatever their names; an
    empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    ready(df.sparkSession)
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = (df.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("__vector"))
            .where(_valid(F.col("__vector"))))
    books = codebooks(rows, "id", parts, entries, rounds, scale)
    dim, edge = sum(b.shape[1] for b in books), _edge(books)
    if not books or not len(books[0]):
        dim = -1                                      # nothing is coded
    each = max(dim, 0) // parts
    kept = T.StructType([f for f in rows.schema.fields if f.name != "__vector"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, coded, x in _blocks(batches, dim, scale, edge):
            codes = np.zeros((len(x), parts), np.uint8)
            errors = np.zeros(len(x), x.dtype)
            for p, book in enumerate(_typed(books, x) if len(x) else []):
                own, number, _ = distinct(x[:, p * each:(p + 1) * each])
                code, error = nearest(own, book)
                codes[:, p] = code[number]
                errors = errors + error[number]
            texts: list[str | None] = [None] * rows.num_rows
            found: list[int | None] = [None] * rows.num_rows
            for k, c, e in zip(np.flatnonzero(coded).tolist(), codes, errors.tolist(), strict=True):
                texts[k], found[k] = c.tobytes().hex(), int(e) if e < 2 ** 63 else None
            yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in kept.fields), pa.array(texts, pa.string()), pa.array(found, pa.int64())],
                                             names=[*kept.names, "code", "error"])

    coded = cut(rows.mapInArrow(encode, T.StructType([*kept.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])))
    digest = F.lit(books_digest(books)).alias("codebooks_sha256")
    if label_col is None:
        return coded.select(F.col("id").alias(id_col), "code", "error", digest)
    totals = coded.groupBy(F.col("label").alias("__label")).agg(
        F.expr("try_cast(sum(cast(error as decimal(38,0))) as long)").alias("label_error"))
    return (coded.join(totals, F.col("label").eqNullSafe(F.col("__label")), "left")
            .select(F.col("id").alias(id_col), "code", "error", "label_error", digest))
