"""Removal of every byte string that occurs twice, by bucket-pointer refinement
of suffixes (operator 12).

Suffixes that begin with the same bytes share a bucket.  A bucket is refined
by sorting its suffixes on the bucket identifiers found at a later offset: 8
bytes and the 8 behind them give buckets of 16 bytes, these and theirs give
buckets of 32, and so on to ``LENGTH``; every refinement reads the identifiers
that the one before has written, and a bucket of one suffix is finished.

Suffixes of a whole corpus don't fit in one task, so equal ones are brought
together first.  Every window of ``LENGTH`` bytes names its least gram of
``GRAM`` bytes (by hash, the first of equals); equal windows name the same gram
at the same place.  Neighbouring windows that name one gram make a *context*: the
bytes that they cover.  Documents are dealt into groups; a group sends its
grams to the gram's bucket, learns which occur again anywhere, and sends the
contexts of only these, each different one once.  The bucket task holds all
contexts of a gram and refines their suffixes: no hash decides there.

A gram that a very common passage repeats more than ``HOT`` times would fill
one task with the different surroundings of the passage.  The windows of such
a gram are dealt by 95 bits of their own hash instead, each different window
of a group once, so no task depends on how often a passage occurs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwatch.llm.common import fresh, groups_for, mix64, ranges, ready, window_hash

LENGTH, GRAM = 200, 32
#: Initial buckets of the refinement: 8 bytes read as one integer.
FIRST = 8
BYTES_PER_GROUP, BYTES_PER_GRAM_BUCKET, BYTES_PER_BUCKET = 4_000_000, 64_000_000, 16_000_000
#: Bytes of contexts that are refined at once: whole slots, a gram being in one.
SLOTS, BYTES_PER_SLICE = 1 << 14, 1_000_000
#: Occurrences from which a gram's windows are dealt by their own hash.
HOT = 2048
BASE = 0x9E3779B97F4A7C15
_NONE = np.empty(0, np.int64)


def refine(text: np.ndarray, left: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Starts whose ``length`` bytes also begin at another place of ``text``
    (uint8).  ``left``: bytes from a place to the end of its own string."""
    n = len(text)
    if not n:
        return _NONE
    first = min(FIRST, length)
    padded = np.concatenate([text, np.zeros(FIRST, np.uint8)])
    grams = np.zeros(n, np.uint64)
    for k in range(first):
        grams <<= np.uint64(8)
        grams |= padded[k:k + n]
    live = np.flatnonzero(left >= first)
    pointer = np.zeros(n, np.int64)
    have, top = first, 0
    _, found, count = np.unique(grams[live], return_inverse=True, return_counts=True)
    while True:
        pointer[live] = top + found                   # the update that later rounds read
        top += len(count)
        live = live[count[found] > 1]                 # buckets of one are finished
        if have == length:
            return live
        step = min(have, length - have)
        live = live[left[live] >= have + step]
        _, found, count = np.unique(pointer[live] * top + pointer[live + step], return_inverse=True, return_counts=True)
        have += step


class _Bytes:
    """The texts of a group of documents as one array of bytes, in the order of
    the texts: equal texts have equal places whichever row comes first."""

    def __init__(self, column: pa.ChunkedArray):
        texts = [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
        self.order = sorted(range(len(texts)), key=texts.__getitem__)
        self.joined = b"".join(texts[k] for k in self.order)
        self.sizes = np.array([len(texts[k]) for k in self.order], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.text = np.frombuffer(self.joined, np.uint8)

    def left(self) -> np.ndarray:
        return np.repeat(self.ends, self.sizes) - np.arange(len(self.text))

    def contexts(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per context: its first window's start, its last one's, its gram's hash."""
        grams = mix64(window_hash(self.text.astype(np.uint64) + np.uint64(1), gram, BASE))
        starts = np.flatnonzero(self.left()[:max(0, len(self.text) - length + 1)] >= length)
        if not len(starts):
            return _NONE, _NONE, np.empty(0, np.uint64)
        width = length - gram + 1
        # the least of `width` grams, the first of equals: hash above, place below
        low, have = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64), 1
        while 2 * have <= width:
            low, have = np.minimum(low[:-have], low[have:]), 2 * have
        named = np.minimum(low[starts], low[starts + width - have]) & np.uint64(0xFFFFFFFF)
        new = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]) | (np.diff(starts) > 1)]))
        last = np.concatenate([new[1:], [len(starts)]]) - 1
        return starts[new], starts[last], grams[named[new].astype(np.int64)]


def _lists(values: list | np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _dealt(name: str, owners: np.ndarray, part: int | None, columns: dict[str, tuple]) -> pa.Table:
    """One row per owner, columns as lists (values, type) in a stable order."""
    order = np.argsort(owners, kind="stable")
    found, n = np.unique(owners, return_counts=True)
    cuts = np.concatenate([[0], np.cumsum(n)])
    out = {name: pa.array(found, pa.int64())}
    if part is not None:
        out["part"] = pa.array(np.full(len(found), part), pa.int64())
    for column, (values, kind) in columns.items():
        values = [values[k] for k in order] if isinstance(values, list) else np.asarray(values)[order]
        out[column] = _lists(values, cuts, kind)
    return pa.table(out)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([_NONE, *(c.flatten().to_numpy(zero_copy_only=False) for c in table.column(name).chunks)]).astype(np.int64)


def _parts(table: pa.Table, name: str) -> np.ndarray:
    n = pc.fill_null(pc.list_value_length(table.column(name)), 0).to_numpy().astype(np.int64)
    return np.repeat(table.column("part").to_numpy(), n)


def _different(contexts: Iterable[bytes], n: int) -> tuple[list[bytes], np.ndarray]:
    """The different ones of ``n`` contexts in the order of their first places,
    and everyone's number; repeats aren't held."""
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(c, len(number)) for c in contexts), np.int64, n)
    return list(number), of


def _digests(text: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """95 hash bits of the windows at ``starts``: 64 and 31."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join(digest(text[s:s + length]) for s in starts), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), (both[:, 1] >> np.uint64(33)).astype(np.int64)


def _merged(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by ``length`` bytes from each of the sorted starts."""
    if not len(starts):
        return _NONE, _NONE
    new = np.concatenate([[True], np.diff(starts) > length])
    return starts[new], starts[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])] + length


def _slices(slot: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the contexts that are refined together."""
    order = np.argsort(slot, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(slot[order]) > 0])) if len(slot) else _NONE
    upto = np.concatenate([[0], np.cumsum(size[order])])
    a = 0
    for b in [*begins[1:].tolist(), len(slot)]:
        if b > a and (b == len(slot) or upto[b] - upto[a] >= BYTES_PER_SLICE):
            yield order[a:b]
            a = b


def spans_in(texts: list[bytes], once: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from, to): the repeated runs of the contexts marked ``once``;
    the others take part in the comparison only."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    starts = refine(np.frombuffer(b"".join(texts), np.uint8), np.repeat(ends, size) - np.arange(int(size.sum())), length)
    own = np.searchsorted(ends, starts, "right")
    starts, own = starts[once[own]], own[once[own]]
    # runs don't cross contexts: move these apart by `length`
    lo, hi = _merged(starts + own * length, length)
    own = np.searchsorted(ends + np.arange(len(ends)) * length, lo, "right")
    begin = (ends - size)[own] + own * length
    return own, lo - begin, hi - begin


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every row of ``df`` with ``n_bytes``, ``n_removed``, ``n_spans`` and
    ``kept`` (binary: what is left may end inside a character).

    A byte goes if some ``length`` bytes of its text that cover it begin at
    another place too, in any row, the same one included.  All occurrences go,
    judged on the input; matches never cross rows.  Null text: no bytes.  Texts
    under ``length`` bytes stay whole.  Repeated rows are separate rows, so a
    repeated text of ``length`` bytes or more goes wholly.  Ids are not used, so
    null or equal ones change nothing.  Extra columns pass through; columns
    with the names of the new ones are replaced.  An empty table gives an empty
    table.  Rows are dealt by their number: ``df`` must give the same rows in
    the same order when it is read again, as a stored table does.
    """
    if not FIRST <= gram <= length:
        raise ValueError(f"need {FIRST} <= gram <= length")
    spark = ready(df.sparkSession)
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    df = df.drop(*new)
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = groups_for(spark, total, BYTES_PER_GROUP, least=1)
    gram_buckets = max(1, -(-total // BYTES_PER_GRAM_BUCKET))
    buckets = groups_for(spark, total, BYTES_PER_BUCKET, least=1)
    part = fresh("__group", df.columns)
    dealt = df.withColumn(part, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def send_grams(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grams, n = np.unique(_Bytes(table.column(text_col)).contexts(length, gram)[2], return_counts=True)
        return _dealt("bucket", (grams % np.uint64(gram_buckets)).astype(np.int64), key[0].as_py(),
                      {"grams": (grams.view(np.int64), pa.int64()), "n": (n, pa.int32())})

    def repeated_grams(table: pa.Table) -> pa.Table:
        grams, parts = _flat(table, "grams"), _parts(table, "grams")
        _, found = np.unique(grams, return_inverse=True)
        n = np.bincount(found, weights=_flat(table, "n"))[found] if len(found) else _NONE
        again = np.flatnonzero(n > 1)
        return _dealt("part", parts[again], None, {"grams": (grams[again], pa.int64()), "hot": (n[again] > HOT, pa.bool_())})

    sent = ("bucket long, part long, at array<long>, twice array<boolean>, slot array<smallint>, context array<binary>, "
            "window array<long>, more array<int>, window_at array<long>, window_twice array<boolean>, known array<long>")

    def send_contexts(key: tuple[pa.Scalar, ...], table: pa.Table, lists: pa.Table) -> pa.Table:
        b = _Bytes(table.column(text_col))
        lo, hi, grams = b.contexts(length, gram)
        again, hot = _flat(lists, "grams").view(np.uint64), _flat(lists, "hot").astype(bool)
        common = np.isin(grams, again[hot])
        cool = np.flatnonzero(np.isin(grams, again) & ~common)
        texts, of = _different((b.joined[s:e + length] for s, e in zip(lo[cool], hi[cool], strict=True)), len(cool))
        n = np.bincount(of, minlength=len(texts))
        first = np.unique(of, return_index=True)[1]
        rest = np.ones(len(cool), bool)
        rest[first] = False
        known = [np.stack([lo[cool][rest], hi[cool][rest] + length])]
        at = cool[first]
        # windows of common grams, by their own hash
        starts = ranges(lo[common], hi[common] - lo[common] + 1)
        one, two = _digests(b.joined, starts, length)
        order = np.lexsort((starts, two, one))
        one, two, starts = one[order], two[order], starts[order]
        fresh_one = np.ones(len(one), bool)
        fresh_one[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        other = np.flatnonzero(~fresh_one)
        known.append(np.stack([starts[other], starts[other] + length]))
        head = np.flatnonzero(fresh_one)
        many = np.diff(np.concatenate([head, [len(one)]])) > 1
        known = np.concatenate(known, axis=1)
        # places of one group come in rows of their owners; known ones go along
        me = key[0].as_py() if key[0].is_valid else lists.column("part")[0].as_py()
        tables = [
            _dealt("bucket", (grams[at] % np.uint64(buckets)).astype(np.int64), me, {
                "at": (lo[at], pa.int64()), "twice": (n > 1, pa.bool_()),
                "slot": ((grams[at] // np.uint64(buckets) % np.uint64(SLOTS)).astype(np.int64), pa.int16()), "context": (texts, pa.binary())}),
            _dealt("bucket", (one[head] % np.uint64(buckets)).astype(np.int64), me, {
                "window": (one[head].view(np.int64), pa.int64()), "more": (two[head], pa.int32()),
                "window_at": (starts[head], pa.int64()), "window_twice": (many, pa.bool_())}),
            _dealt("bucket", np.full(known.size, me % buckets), me, {"known": (known.T.ravel(), pa.int64())})]
        return pa.concat_tables([t.cast(pa.schema([out_row.field(c) for c in t.column_names])) for t in tables],
                                promote_options="default").select(out_row.names)

    out_row = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("at", pa.list_(pa.int64())), ("twice", pa.list_(pa.bool_())), ("slot", pa.list_(pa.int16())),
                         ("context", pa.list_(pa.binary())), ("window", pa.list_(pa.int64())), ("more", pa.list_(pa.int32())),
                         ("window_at", pa.list_(pa.int64())), ("window_twice", pa.list_(pa.bool_())), ("known", pa.list_(pa.int64()))])

    def repeated_spans(table: pa.Table) -> pa.Table:
        parts, at = _parts(table, "context"), _flat(table, "at")
        texts, of = _different((c.as_py() for chunk in table.column("context").chunks for c in chunk.flatten()), len(at))
        n = np.bincount(of, weights=1 + _flat(table, "twice"), minlength=len(texts))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        slot, holder = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        slot[of], holder[of] = _flat(table, "slot"), np.arange(len(of))
        # a context that came twice goes wholly, the others where refinement says so
        many = np.flatnonzero(n[of] > 1)
        found = [(parts[many], at[many], at[many] + size[of[many]])]
        for numbers in _slices(slot, size):
            own, lo, hi = spans_in([texts[k] for k in numbers.tolist()], n[numbers] < 2, length)
            rows = holder[numbers[own]]
            found.append((parts[rows], at[rows] + lo, at[rows] + hi))
        # common windows
        one, two, where, owner = (_flat(table, c) for c in ("window", "more", "window_at", "window_twice"))
        owners = _parts(table, "window")
        order = np.lexsort((two, one))
        same = np.zeros(len(one), bool)
        equal = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
        same |= owner.astype(bool)
        found.append((owners[same], where[same], where[same] + length))
        known = _flat(table, "known").reshape(-1, 2)
        found.append((_parts(table, "known")[::2], known[:, 0], known[:, 1]))
        to, begins, over = (np.concatenate(c) for c in zip(*found, strict=True))
        return _dealt("part", to, None, {"begin": (begins, pa.int64()), "over": (over, pa.int64())})

    names = df.columns
    out_schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in new[:3]), T.StructField("kept", T.BinaryType())])

    def remove(table: pa.Table, spans: pa.Table) -> pa.Table:
        b = _Bytes(table.column(text_col))
        step = np.zeros(len(b.text) + 1, np.int32)
        np.add.at(step, _flat(spans, "begin"), 1)
        np.add.at(step, _flat(spans, "over"), -1)
        gone = np.cumsum(step[:-1]) > 0
        upto = np.concatenate([[0], np.cumsum(gone)])
        begin = b.ends - b.sizes
        removed = upto[b.ends] - upto[begin]
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        opens[begin[b.sizes > 0]] = gone[begin[b.sizes > 0]]     # a run ends with its text
        opened = np.concatenate([[0], np.cumsum(opens)])
        kept = [b.joined[s:e] if not r else b.text[s:e][~gone[s:e]].tobytes()
                for s, e, r in zip(begin.tolist(), b.ends.tolist(), removed.tolist(), strict=True)]
        out = table.select(names).take(pa.array(b.order, pa.int64()))
        for name, values in (("n_bytes", pa.array(b.sizes, pa.int64())), ("n_removed", pa.array(removed, pa.int64())),
                             ("n_spans", pa.array(opened[b.ends] - opened[begin], pa.int64())), ("kept", pa.array(kept, pa.binary()))):
            out = out.append_column(name, values)
        return out

    grams = (dealt.groupBy(part).applyInArrow(send_grams, "bucket long, part long, grams array<long>, n array<int>")
             .groupBy("bucket").applyInArrow(repeated_grams, "part long, grams array<long>, hot array<boolean>"))
    spans = (dealt.groupBy(part).cogroup(grams.groupBy("part")).applyInArrow(send_contexts, sent)
             .groupBy("bucket").applyInArrow(repeated_spans, "part long, begin array<long>, over array<long>"))
    return dealt.groupBy(part).cogroup(spans.groupBy("part")).applyInArrow(remove, out_schema)
