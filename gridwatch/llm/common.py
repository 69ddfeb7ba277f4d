"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.session import checkpoint_dir, ship_package

#: A word: a run of characters other than space and the controls 9 to 13.
#: ``bytes.split()`` without arguments cuts at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"

_MASK = (1 << 64) - 1


def ready(spark: SparkSession) -> SparkSession:
    """Checkpoint folder set, package importable in the Python workers."""
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder: lineage
    ends here and a lost executor costs nothing before this point."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def groups_for(spark: SparkSession, amount: int, each: int, least: int = 2) -> int:
    """How many hash groups to deal rows into: ``each`` units of work per
    group, and always ``least`` groups for every shuffle partition."""
    return max(least * shuffle_partitions(spark), -(-int(amount or 0) // each))


def fresh(base: str, taken: Iterable[str]) -> str:
    """A column name that clashes with none of ``taken``."""
    low, name = {t.lower() for t in taken}, base
    while name.lower() in low:
        name = f"{base}_{uuid.uuid4().hex[:6]}"
    return name


def fresh_folder(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def training_rows(id_col: str | Column) -> Column:
    """Documents that models may learn from: crc32(id as text) mod 3 is not 1."""
    return ~held_out(id_col)


def held_out(id_col: str | Column) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hash(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hash of every ``length`` consecutive entries of ``h``
    (uint64, wrapping), built by doubling; shorter input gives no entry."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have = None, 0
    power, size, todo = h, 1, length
    while todo:
        if todo & 1:
            # append `power` (windows of `size`) behind what `out` covers
            if out is None:
                out, have = power, size
            else:
                m = len(power) - have
                out = out[:m] * np.uint64(pow(base, size, 1 << 64)) + power[have:have + m]
                have += size
        todo >>= 1
        if todo:
            m = len(power) - size
            if m <= 0:
                power = np.empty(0, np.uint64)
            else:
                power = power[:m] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
            size *= 2
    return out[:n]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + l)``."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
