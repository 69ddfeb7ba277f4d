"""Embedding near-duplicates by product quantisation (operator 3).

Coarse inverted lists over k-means centroids; in a list every vector keeps the
subspace codes of its residual and the exact size of its quantisation error.
A query visits the list of its nearest centroid and all lists whose bisecting
plane it is close to: a neighbour at the link distance r lies beyond a given
plane only if the difference has a component above the query's distance to
it, and that component has a deviation of r / sqrt(dimension); lists within
``WIDTH`` deviations are probed.  In a list, asymmetric distances come from
table look-ups of the query's subvectors; |asymmetric - true| is at most the
member's own error, so no member of a visited list is lost.  Survivors are
compared by exact cosine in double precision.

Equal vectors are one node from the start.  Large lists are cut into blocks
of members and of queries, each pair of blocks a group of its own; a group
returns link counts and a spanning forest of its links, never the pairs.

The quantiser is fitted on a sample of at most ``SAMPLE`` vectors; every
vector is indexed and every vector is a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwatch.llm.common import cut, mix64, ready
from gridwatch.llm.components import components, spanning

LEAST_COSINE, WIDTH = 0.95, 2.0
SAMPLE, MOST_LISTS, SUBSPACES, CODEWORDS, ROUNDS = 20_000, 4096, 8, 256, 8
BLOCK_MEMBERS, BLOCK_QUERIES = 4096, 256


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(
        ((c * c).sum(1) - 2 * x[k:k + 4096] @ c.T).argmin(1) for k in range(0, len(x), 4096))])


class Quantiser:
    def __init__(self, sample: np.ndarray, total: int):
        dim = sample.shape[1]
        lists = max(1, min(MOST_LISTS, math.isqrt(total) // 2, len(sample) // 16))
        self.centroids = kmeans(sample, lists, 1)
        self.parts = np.array_split(np.arange(dim), min(SUBSPACES, dim))
        rest = sample - self.centroids[nearest(sample, self.centroids)]
        words = max(1, min(CODEWORDS, len(sample) // 8))
        self.books = [kmeans(rest[:, p], words, 2 + k) for k, p in enumerate(self.parts)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error) of unit vectors."""
        home = nearest(x, self.centroids)
        rest = x - self.centroids[home]
        codes = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        wrong = sum((((rest[:, p] - b[codes[:, k]]) ** 2).sum(1)
                     for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True))), np.zeros(len(x)))
        return home, codes, np.sqrt(wrong)

    def probes(self, x: np.ndarray, home: np.ndarray, reach: float) -> np.ndarray:
        """(vector, list) that are visited, as a mask."""
        d = ((self.centroids ** 2).sum(1) - 2 * x @ self.centroids.T)
        own = d[np.arange(len(x)), home]
        lists, at = np.unique(home, return_inverse=True)
        c = self.centroids
        gaps = np.sqrt(np.maximum(1e-18, (c[lists] ** 2).sum(1)[:, None] + (c ** 2).sum(1) - 2 * c[lists] @ c.T))[at]
        return (d - own[:, None]) / (2 * gaps) <= reach

    def tables(self, x: np.ndarray, which: int) -> list[np.ndarray]:
        """Squared distances of the queries' residual subvectors to the codewords."""
        rest = x - self.centroids[which]
        return [(rest[:, p] ** 2).sum(1)[:, None] + (b ** 2).sum(1) - 2 * rest[:, p] @ b.T
                for p, b in zip(self.parts, self.books, strict=True)]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    x = np.concatenate([np.empty(0), *flat]).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _search(table: pa.Table, quantiser: Quantiser, which: int, dim: int, least: float) -> pa.Table:
    """Link counts of the queries and a spanning forest of the links."""
    query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
    x, node, n = _matrix(table.column("vector"), dim), table.column("node").to_numpy(), table.column("n").to_numpy()
    q, m = np.flatnonzero(query), np.flatnonzero(~query)
    codes = np.array([np.frombuffer(c, np.uint8) for c in table.column("codes").take(pa.array(m)).to_pylist()],
                     np.uint8).reshape(len(m), len(quantiser.parts))
    bound = (math.sqrt(2 - 2 * least) + table.column("error").to_numpy()[m] + 1e-6) ** 2
    counts = np.zeros(len(q), np.int64)
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for k in range(0, len(q), BLOCK_QUERIES):
        rows = q[k:k + BLOCK_QUERIES]
        far = np.zeros((len(rows), len(m)))
        for j, t in enumerate(quantiser.tables(x[rows], which)):
            far += t[:, codes[:, j]]
        a, b = np.nonzero(far <= bound)
        a, b = a + k, m[b]
        keep = node[q[a]] != node[b]
        a, b = a[keep], b[keep]
        near = np.concatenate([np.empty(0, bool), *(
            np.einsum("ij,ij->i", x[q[a[i:i + 65536]]], x[b[i:i + 65536]]) >= least for i in range(0, len(a), 65536))])
        a, b = a[near], b[near]
        np.add.at(counts, a, n[b])
        u, v = spanning(np.concatenate([u, node[q[a]]]), np.concatenate([v, node[b]]))
    some = counts > 0
    return pa.table({"kind": pa.array(np.repeat([0, 1], [int(some.sum()), len(u)]).astype(np.int32)),
                     "a": pa.array(np.concatenate([node[q][some], u])), "b": pa.array(np.concatenate([counts[some], v]))})


def _links_of(nodes: DataFrame, dim: int, least: float) -> DataFrame:
    """Rows (kind 0: node a has b linked rows in other nodes; kind 1: link a, b)
    for ``nodes(node, n, vector)``, vectors of ``dim`` components."""
    total = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node", F.lit(5))).limit(SAMPLE).select("vector").toArrow()    # at most SAMPLE
    quantiser = Quantiser(_matrix(sample.column("vector"), dim), total)
    reach = WIDTH * math.sqrt(2 - 2 * least) / math.sqrt(dim)
    shared = nodes.sparkSession.sparkContext.broadcast(quantiser)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            home, codes, error = shared.value.encode(_matrix(batch.column("vector"), dim))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(error)], names=[*batch.schema.names, "list", "codes", "error"])

    vectors = nodes.schema["vector"].dataType.simpleString()
    kinds = f"node long, n long, vector {vectors}, list int, codes binary, error double"
    assigned = cut(nodes.select("node", "n", "vector").mapInArrow(assign, kinds))
    blocks = np.ones(len(quantiser.centroids), np.int64)
    for which, n in assigned.groupBy("list").count().collect():                   # one row a list
        blocks[which] = -(-n // BLOCK_MEMBERS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64)
            home = batch.column("list").to_numpy(zero_copy_only=False)
            salt = (mix64(node.view(np.uint64)) >> np.uint64(8)).astype(np.int64)
            x = _matrix(batch.column("vector"), dim)
            for query in (False, True):
                row, which = (np.nonzero(shared.value.probes(x, home, reach)) if query
                              else (np.arange(len(node)), home.astype(np.int64)))
                times = blocks[which]
                row, which = np.repeat(row, times), np.repeat(which, times)
                other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                mine = salt[row] % blocks[which]
                some = batch.take(pa.array(row))
                keys = [which, *((other, mine) if query else (mine, other))]
                empty = pa.nulls(len(row), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(k.astype(np.int32)) for k in keys), pa.array(np.full(len(row), query)), some.column("node"),
                     some.column("n"), some.column("vector"), empty if query else some.column("codes"), some.column("error")],
                    names=["list", "members", "queries", "query", "node", "n", "vector", "codes", "error"])

    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _search(table, shared.value, key[0].as_py(), dim, least)

    return (assigned.mapInArrow(deal, "list int, members int, queries int, query boolean, node long, n long, "
                                      f"vector {vectors}, codes binary, error double")
            .groupBy("list", "members", "queries").applyInArrow(search, "kind int, a long, b long"))


def embedding_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                         least: float = LEAST_COSINE) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` per row of ``df``.

    ``n_links``: other rows at cosine ``least`` or above (found; see README
    for the recall).  ``component_id``: smallest id reachable by links.  Rows
    whose vector is null, empty, zero or holds null or non-finite components
    have no link and are their own component; vectors of different length
    never link.  Repeated rows link with each other; rows without an id take
    part but name no component unless they reach no id.  Extra columns are
    left out; an empty table gives no rows.
    """
    spark = ready(df.sparkSession)
    # as given: single precision stays, everything else is compared in double
    element = getattr(df.schema[vector_col].dataType, "elementType", None)
    kind = "array<float>" if isinstance(element, T.FloatType) else "array<double>"
    v = F.col("vector")
    fine = F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
                      & F.exists(v, lambda e: e != 0), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    rows = rows.select("id", "vector", fine.alias("fine"), F.xxhash64("vector").alias("h1"),
                       F.xxhash64(F.lit(9), "vector").alias("h2"))
    nodes = cut(rows.where("fine").groupBy("h1", "h2")
                .agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("vector").alias("vector"))
                .withColumn("dim", F.size("vector")).withColumn("node", F.monotonically_increasing_id()))
    found = [cut(_links_of(nodes.where(F.col("dim") == d[0]), d[0], least))
             for d in nodes.select("dim").distinct().orderBy("dim").collect()]
    names = nodes.select("h1", "h2", "low", "n", "node")
    if found:
        links = found[0]
        for f in found[1:]:
            links = links.unionByName(f)
        counts = links.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
        comp = components(links.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
        names = names.join(counts, "node", "left").join(comp, "node", "left").withColumn(
            "component", F.coalesce("component", "node"))
    else:
        names = names.withColumn("others", F.lit(0).cast("long")).withColumn("component", F.col("node"))
    names = cut(names)
    lows = names.groupBy("component").agg(F.min("low").alias("component_id"))
    names = names.join(lows, "component").select(
        "h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    good = rows.where("fine").select("id", "h1", "h2").join(names, ["h1", "h2"]).select("id", "n_links", "component_id")
    bad = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(bad).select(F.col("id").alias(id_col), "n_links", "component_id",
                                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
