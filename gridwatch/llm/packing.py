"""Best-fit packing by the sum-of-squares rule (operator 4).

A document's ids end with ``EOT``; one longer than ``CAPACITY`` is cut into
full pieces behind a first, shorter one.  A piece goes where the sum over all
gaps of (open sequences with that gap) squared becomes smallest, a new
sequence being one of the choices.  Full pieces are sequences of their own.

Token ids stay in the task that makes them: only lengths and digests are
shuffled.  Documents are dealt evenly into blocks by a hash and every block is
packed on its own, so work and memory of a task do not depend on the input's
size; a block holds thousands of pieces and leaves a handful of sequences
part-filled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import cut, ready

CAPACITY, EOT, BLOCK_DOCS = 1024, 2, 16384
TOKENIZER = "byte_bpe_50k"
#: Strings that the tokenizers library turns into special ids.
SPECIAL = ("<|endoftext|>",)

_ENCODERS: dict[str, tuple] = {}


def encoders(name: str) -> tuple:
    """The tokenizers file and the same vocabulary for tiktoken, once a worker."""
    if name not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        lines = open(public_tokenizers.path(f"{name}.tiktoken"), "rb").read().splitlines()  # noqa: SIM115
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _ENCODERS[name] = Tokenizer.from_file(public_tokenizers.path(f"{name}.json")), fast
    return _ENCODERS[name]


def token_ids(text: str, name: str = TOKENIZER) -> list[int]:
    """The ids of ``tokenizers`` for ``text``, no special tokens added.

    Ordinary text goes through the same vocabulary and merge ranks in
    tiktoken, a quarter of the time for equal ids (tested); text that holds
    the string of a special token goes through the tokenizers library itself.
    """
    slow, fast = encoders(name)
    if any(s in text for s in SPECIAL):
        return slow.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    head = (n - 1) % capacity + 1
    return [(0, head), *((k, capacity) for k in range(head, n, capacity))]


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every size, taken in the order given."""
    # open_[g]: open bins with gap g.  Placing s into gap g changes the sum of
    # squares by 2 (open_[g - s] - open_[g]) + 2; a filled bin no longer
    # counts (1 less), and a new bin has nothing to take away (1 less): the
    # two half entries at the ends say so.
    open_ = np.zeros(capacity + 1, np.float32)
    open_[0], open_[capacity] = -.5, .5
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made = 0
    for k, s in enumerate(sizes.tolist()):
        there = open_[s:]
        cost = open_[:capacity + 1 - s] - there
        cost[there <= 0] = np.inf
        g = int(cost.argmin()) + s
        if g == capacity:
            b, made = made, made + 1
        else:
            b = bins[g].pop()
            open_[g] -= 1
        where[k], offset[k] = b, capacity - g
        if g > s:
            bins[g - s].append(b)
            open_[g - s] += 1
    return where, offset


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, eot: int) -> DataFrame:
    """One row per document: id, ids and the digest of each piece."""
    kind = df.schema[id_col].dataType.simpleString()

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests = [], []
            for text in batch.column(1):
                ids = np.array([*token_ids(text.as_py() or "", tokenizer), eot], "<u4")
                n.append(len(ids))
                digests.append([zlib.crc32(ids[a:a + size].tobytes()) for a, size in cut_points(len(ids), capacity)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.list_(pa.int64()))],
                names=["id", "n", "digests"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(cut_texts, f"id {kind}, n long, digests array<long>")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
         capacity: int = CAPACITY, eot: int = EOT) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``.

    A null or empty text is the single id ``eot``.  Rows that share an id are
    separate documents; null ids are kept.  Sequences are full or end where
    the next piece did not fit; offsets are gapless from 0.  An empty table
    gives no rows.  Extra columns are left out.
    """
    ready(df.sparkSession)
    rows = cut(pieces(df, id_col, text_col, tokenizer, capacity, eot))
    blocks = max(1, -(-rows.count() // BLOCK_DOCS))
    kind = df.schema[id_col].dataType.simpleString()

    def place(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("id", "ascending"), ("n", "ascending")])
        n = table.column("n").to_numpy()
        count = -(-n // capacity)
        head = (n - 1) % capacity + 1
        # long pieces by size, then the rest in hash order: they fill the gaps
        order = np.argsort(np.where(head > 3 * capacity // 8, -head, 0), kind="stable")
        doc = np.repeat(np.arange(len(n)), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        first = piece == 0
        length = np.where(first, head[doc], capacity)
        start = np.where(first, 0, head[doc] + (piece - 1) * capacity)
        where, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        where[order], offset[order] = sum_of_squares(head[order], capacity)
        used = int(where.max()) + 1
        sequence, at = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        sequence[first], at[first] = where, offset
        sequence[~first] = used + np.arange(int((~first).sum()))
        return pa.table({
            "id": table.column("id").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()),
            "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.concat_arrays([c.flatten() for c in table.column("digests").chunks]),
            "sequence_id": pa.array((key[0].as_py() << 40) + sequence, pa.int64()), "offset": pa.array(at, pa.int64())})

    order = F.xxhash64("id", "n", "digests")
    # the rows are checkpointed, so their numbers hold when a task is repeated;
    # equal rows go to different blocks
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    packed = (rows.withColumn("order", order).withColumn("block", block)
              .groupBy("block").applyInArrow(
                  place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
    return packed.withColumnRenamed("id", id_col)
