"""SimHash near-duplicates over a forest of vantage-point trees (operator 8).

Fingerprints: 64 majority bits over the XXH64 values of a text's word
shingles.  Two fingerprints within ``max_bits`` have, in one of three bit
slices, at most ``max_bits // 3`` differing bits; the Hamming distance of a
slice is a metric of its own.  So each slice gets a vantage-point tree with
that smaller radius.  Every level looks at the distance to the vantage point
on a bit of its own: 0 is inside, 1 outside.  Distances on separate bits add
up, so a query that crosses to a node's other side has used up that much of
its radius, and a branch whose least distance exceeds what is left is pruned.
Of two neighbours the one that is inside where they first part visits the
other, so every pair meets once.  The leaves, one per value of a slice, are
the shards; a fingerprint lives in one of each tree and visits, at radius 1,
at most one more per level: how many rows it makes does not depend on how many
there are.  Pairs that meet are compared on all 64 bits: exact, whatever the
vantage point is.

Equal fingerprints are one node from the start.  A shard that a large group of
near copies fills is cut into blocks, and so are the visitors that come from
it; each pair of blocks is a cell of its own.  A task returns a spanning forest
of the links that it found, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import cut, fresh, groups_for, mix64, ranges, ready
from gridwatch.llm.components import components, spanning

SHINGLE, MAX_BITS, SEED = 4, 4, 42
SLICES = 3
#: Members and queries of a cell (as a square) that are compared without a tree
#: of their own.
SHARD = 128
#: Members or visitors of a shard that one cell holds.
SPLIT = 16384
#: Pairs compared at once, and entries of cells in one group.
BLOCK, ENTRIES = 1 << 18, 1_000_000
MEMBER, QUERY = 1, 2

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)       # (256, 8)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text (null or no words: 0)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    end = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(begin, end, strict=True)), np.uint64, n)
    octets = h.astype(">u8").view(np.uint8).reshape(n, 8)
    votes = [np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)]
    return int.from_bytes(np.packbits(np.concatenate(votes) * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """``df`` without its text, plus the fingerprint as a signed long."""
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return df.withColumn(out, of(F.col(text_col))).drop(text_col)


def slices() -> list[np.uint64]:
    """Bit masks of the slices: 22, 21 and 21 bits."""
    cuts = [round(64 * k / SLICES) for k in range(SLICES + 1)]
    return [np.uint64((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _distance(x: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ vantage) & mask)


def _split(x: np.ndarray, mask: np.uint64) -> tuple[np.uint64, int] | None:
    """A vantage point from ``x`` and the radius that halves ``x`` best."""
    for vantage in x[:: max(1, len(x) // 3)][:3]:
        n = np.cumsum(np.bincount(_distance(x, vantage, mask), minlength=1))
        r = int(np.argmin(np.abs(n - len(x) / 2)))
        if 0 < n[r] < len(x):
            return vantage, r
    return None


def visits(x: np.ndarray, mask: np.uint64, vantage: np.uint64, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(entries of x, the leaves they go to, is it their home)."""
    levels = [np.uint64(1 << b) for b in range(64) if int(mask) >> b & 1]
    todo = [(np.arange(len(x)), x & mask, 0, radius)]
    while todo:
        rows, leaf, level, left = todo.pop()
        yield rows, leaf, level == 0
        for k in range(level, len(levels)) if left and len(rows) else ():
            some = slice(None) if level else (x[rows] ^ vantage) & levels[k] == 0    # crosses from inside first
            todo.append((rows[some], leaf[some] ^ levels[k], k + 1, left - 1))


def _code(tree: int, leaf: np.ndarray) -> np.ndarray:
    return mix64(leaf + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def _cell(code: np.ndarray, *more: np.ndarray | int) -> np.ndarray:
    for m in more:
        code = mix64(code * np.uint64(3) + np.asarray(m).astype(np.uint64) + np.uint64(1))
    return code


class Crowded:
    """Leaves with more than ``split`` members: their numbers of blocks, and
    from which of them a leaf gets visitors."""

    def __init__(self, leaves: list[tuple[int, int, int]], masks: list[np.uint64], vantage: np.uint64, radius: int, split: int):
        self.blocks: dict[int, int] = {}
        self.feeds: dict[int, list[tuple[int, int]]] = {}
        for tree, leaf, n in leaves:
            self.blocks[int(_code(tree, np.array([leaf], np.int64).view(np.uint64))[0])] = -(-n // split)
        for tree, leaf, _ in leaves:
            x = np.array([leaf], np.int64).view(np.uint64)
            source = int(_code(tree, x)[0])
            for rows, to, home in visits(x, masks[tree], vantage, radius):
                for t in _code(tree, to) if not home and len(rows) else ():
                    self.feeds.setdefault(int(t), []).append((source, self.blocks[source]))
        self.known = np.array(sorted(self.blocks), np.uint64)
        self.fed = np.array(sorted(self.feeds), np.uint64)

    def count(self, code: np.ndarray) -> np.ndarray:
        out = np.ones(len(code), np.int64)
        for k in np.flatnonzero(np.isin(code, self.known)) if len(self.known) else ():
            out[k] = self.blocks[int(code[k])]
        return out


def cells(x: np.ndarray, masks: list[np.uint64], vantage: np.uint64, radius: int,
          crowded: Crowded) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(cell, fingerprints, role): where every fingerprint is a member, a query
    or both."""
    both, own = MEMBER | QUERY, mix64(x) >> np.uint64(17)
    for tree, mask in enumerate(masks):
        home = _code(tree, x & mask)
        n = crowded.count(home)
        block = (own % n.astype(np.uint64)).astype(np.int64)
        for rows, leaf, at_home in visits(x, mask, vantage, radius):
            code = _code(tree, leaf)
            if at_home:
                yield _cell(code, block), x, both
                for leaf_code in np.unique(code[n > 1]):          # blocks of one leaf: each pair once
                    here = np.flatnonzero(code == leaf_code)
                    for j in range(int(n[here[0]])):
                        for some, role in ((here[block[here] < j], MEMBER), (here[block[here] > j], QUERY)):
                            yield _cell(code[some], np.minimum(block[some], j), leaf_code, np.maximum(block[some], j)), x[some], role
                for leaf_code in np.unique(code[np.isin(code, crowded.fed)]):
                    here = np.flatnonzero(code == leaf_code)      # members meet every block of a crowded neighbour
                    for source, m in crowded.feeds[int(leaf_code)]:
                        for j in range(m):
                            yield _cell(code[here], block[here], np.uint64(source), j), x[here], MEMBER
                continue
            to, crowd = crowded.count(code), n[rows] > 1
            for i in range(int(to.max(initial=0))):
                plain = (to > i) & ~crowd
                yield _cell(code[plain], i), x[rows[plain]], QUERY
                hot = (to > i) & crowd
                if hot.any():
                    yield _cell(code[hot], i, home[rows[hot]], block[rows[hot]]), x[rows[hot]], QUERY


def links(members: np.ndarray, queries: np.ndarray, mask: np.uint64, radius: int,
          max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (member, query) within ``max_bits``."""
    us: list[np.ndarray] = [np.empty(0, np.uint64)]
    vs: list[np.ndarray] = [np.empty(0, np.uint64)]
    held = 0

    def compare(m: np.ndarray, q: np.ndarray) -> None:
        nonlocal held
        step = max(1, BLOCK // len(q))
        for k in range(0, len(m), step):
            i, j = np.nonzero(np.bitwise_count(m[k:k + step, None] ^ q[None, :]) <= max_bits)
            a, b = m[k + i], q[j]
            other = a != b
            us.append(a[other])
            vs.append(b[other])
            held += int(other.sum())
            if held > 4 * BLOCK:
                u, v = spanning(np.concatenate(us), np.concatenate(vs))
                us[:], vs[:], held = [u], [v], len(u)

    todo = [(members, queries)]
    while todo:
        m, q = todo.pop()
        if not len(m) or not len(q):
            continue
        s = _split(m, mask) if len(m) * len(q) > SHARD ** 2 else None
        if s is None:
            for k in range(0, len(q), BLOCK):
                compare(m, q[k:k + BLOCK])
            continue
        dm, dq = _distance(m, s[0], mask), _distance(q, s[0], mask).astype(np.int64)
        todo += [(m[dm <= s[1]], q[dq - radius <= s[1]]), (m[dm > s[1]], q[dq + radius > s[1]])]
    return spanning(np.concatenate(us), np.concatenate(vs))


def meetings(cell: np.ndarray, x: np.ndarray, role: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between members and queries of a cell."""
    order = np.argsort(cell, kind="stable")
    cell, x, role = cell[order], x[order], role[order]
    m, q = role & MEMBER > 0, role & QUERY > 0
    members, queries = x[m], x[q]
    lo, hi = (np.searchsorted(cell[m], cell[q], side) for side in ("left", "right"))
    first = np.searchsorted(cell[q], cell[q], "left")
    n = (hi - lo) * (np.searchsorted(cell[q], cell[q], "right") - first)
    us, vs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    # large cells by a tree on all bits
    large = np.flatnonzero(n > SHARD ** 2)
    for k in np.unique(first[large]):
        end = np.searchsorted(first, k, "right")
        u, v = links(members[lo[k]:hi[k]], queries[k:end], np.uint64((1 << 64) - 1), max_bits, max_bits)
        us.append(u)
        vs.append(v)
    small = np.flatnonzero((n <= SHARD ** 2) & (hi > lo))
    upto, a = np.cumsum((hi - lo)[small]), 0
    while a < len(small):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + 8 * BLOCK, "right")))
        some = small[a:b]
        one, two = members[ranges(lo[some], (hi - lo)[some])], np.repeat(queries[some], (hi - lo)[some])
        near = (np.bitwise_count(one ^ two) <= max_bits) & (one != two)
        us.append(one[near])
        vs.append(two[near])
        a = b
    return spanning(np.concatenate(us), np.concatenate(vs))


def fingerprint_links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(u, v)``: links between the distinct fingerprints ``fp`` whose
    components are those of all links at ``max_bits`` or fewer differing bits."""
    spark, radius, masks = nodes.sparkSession, max_bits // SLICES, slices()
    # the vantage point: per bit the rarer value, so that few are inside and visit
    bits = nodes.agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(1)).alias(f"b{b}") for b in range(64))).first()
    n = bits["n"]
    vantage = np.uint64(sum(1 << b for b in range(64) if n and 2 * bits[f"b{b}"] < n))
    split = SPLIT
    leaves = F.array(*[F.struct(F.lit(t).alias("tree"), F.col("fp").bitwiseAND(F.lit(int(m.view(np.int64)))).alias("leaf")) for t, m in enumerate(masks)])
    # a row per split members at most
    found = nodes.select(F.inline(leaves)).groupBy("tree", "leaf").count().where(F.col("count") > split).collect()
    crowded = Crowded([(r["tree"], r["leaf"], r["count"]) for r in found], masks, vantage, radius, split)
    groups = groups_for(spark, n * 12 * SLICES, ENTRIES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            made = [(c, y, np.full(len(c), role, np.int8)) for c, y, role in cells(x, masks, vantage, radius, crowded)]
            cell, fp, role = (np.concatenate([m[k] for m in made]) for k in range(3))
            group = (cell % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            numbers, first = np.unique(group[order], return_index=True)
            cuts = pa.array(np.concatenate([first, [len(group)]]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers), *(pa.ListArray.from_arrays(cuts, pa.array(c[order])) for c in (cell.view(np.int64), fp.view(np.int64), role))],
                names=["group", "cell", "fp", "role"])

    def search(table: pa.Table) -> pa.Table:
        cell, fp, role = (np.concatenate([c.flatten().to_numpy() for c in table.column(k).chunks]) for k in ("cell", "fp", "role"))
        u, v = meetings(cell.view(np.uint64), fp.view(np.uint64), role, max_bits)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return (nodes.select("fp").mapInArrow(deal, "group long, cell array<long>, fp array<long>, role array<tinyint>")
            .groupBy("group").applyInArrow(search, "u long, v long"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``(id_col, fingerprint, component_id)``: one row per row of ``df``.

    Fingerprints link at ``max_bits`` or fewer differing bits; component_id is
    the smallest id reachable by links.  Null or empty text: fingerprint zero,
    linked like any other.  Rows whose id is null take part, and get a null
    component only where no reachable row has an id.  Extra columns are left
    out; repeated rows stay repeated; an empty table gives no rows.
    """
    ready(df.sparkSession)
    doc = fresh("id", [id_col])
    fps = cut(fingerprints(df.select(F.col(id_col).alias(doc), F.col(text_col).alias("text")), "text", "fp", shingle))
    nodes = cut(fps.groupBy("fp").agg(F.min(doc).alias("low")))
    comp = components(fingerprint_links(nodes.select("fp"), max_bits))
    linked = cut(nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
                 .withColumn("component", F.coalesce("component", "fp")))
    lows = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    named = linked.select("fp", "component").join(lows, "component").select("fp", "component_id")
    return (fps.join(named, "fp", "left")
            .select(F.col(doc).alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` that stay, all columns: of each component one, that
    with the smallest id.

    Null ids come last.  Of rows that share the smallest id one stays, by a hash
    of the text; of those that share the text too, the least row.  Rows with
    equal ids but texts of different components are separate documents.
    """
    ready(df.sparkSession)
    names = {k: fresh(k, df.columns) for k in ("key", "digest")}
    key, digest = names["key"], names["digest"]
    of_text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col).alias(key), of_text.alias(digest), F.col(text_col).alias("text"))
    fps = cut(fingerprints(rows, "text", "fp", shingle).groupBy("fp", key, digest).agg(F.count("*").alias("copies")))
    comp = components(fingerprint_links(fps.select("fp").distinct(), max_bits)).withColumnRenamed("node", "fp")
    named = fps.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    order = F.struct(F.col(key).isNull(), F.col(key), F.col(digest), F.col("fp"), F.col("copies"))
    kept = cut(named.groupBy("component").agg(F.min(order).alias("least")).select(F.col(f"least.{key}").alias(key), f"least.{digest}", "least.copies"))
    marked = df.withColumn(digest, of_text)

    def same(keys: DataFrame) -> Column:
        return marked[id_col].eqNullSafe(keys[key]) & (marked[digest] == keys[digest])

    once = kept.where("copies = 1")
    twice = kept.where("copies > 1")
    single = marked.join(once, same(once), "left_semi").select(df.columns)
    if twice.isEmpty():
        return single
    least = (marked.join(twice, same(twice), "left_semi").groupBy(F.col(id_col).alias(key), digest)
             .agg(F.min(F.struct(*df.columns)).alias("__row")).select("__row.*"))
    return single.unionByName(least)
