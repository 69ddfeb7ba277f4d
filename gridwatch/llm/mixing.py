"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 7).

Every source gets a share of all words by its weight, at most ``EPOCHS``
times its own size, the excess shared out again.  A target of 2.4 times the
size takes every document twice and then a weighted sample without
replacement: documents in the order of exponential keys -ln(u) / quality,
until the words that are left are used up.  DataFrame functions only.

The order within a source is never built whole.  Keys are cut into ranges of
about ``RANGE_ROWS`` documents (pre-aggregated sums, one row per range); only
the one range in which a source's budget ends is sorted.  Its last key that
fits becomes the source's threshold, which every document is compared with;
what then is left of the budget goes to the document behind the threshold, in
the same range, whose size is nearest to it (or to none).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwatch.llm.common import WORD, cut, fresh

WEIGHTS, EPOCHS, RANGE_ROWS = (5, 2, 1), 3, 2048
#: Thresholds are broadcast up to this many bytes, and joined by shuffle beyond.
BROADCAST_BYTES = 8 << 20


def words(text: str | Column) -> Column:
    """Number of words, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: str | Column) -> Column:
    """Quality weight of a text: its share of letters, 0.05 at least."""
    c = F.col(text) if isinstance(text, str) else text
    share = F.length(F.regexp_replace(c, r"\P{L}+", "")) / F.greatest(F.length(c), F.lit(1))
    return F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.05))


def sampling_key(identity: Column, quality: Column) -> Column:
    """-ln(u) / quality with u in (0, 1) from a digest of the id: the same in every run."""
    digest = F.md5(F.concat(F.lit("mix-"), identity).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0 ** 52)
    return -F.log(u) / quality


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, n_docs)`` to those plus ``target``: one row per
    source.  The set of sources at their limit is a prefix of the order by
    limit / weight, so running sums over that order give it at once."""
    everywhere = Window.partitionBy(F.lit(0))
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    by_fill = Window.partitionBy(F.lit(0)).orderBy("fill", "nth")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    t = (sizes.withColumn("nth", nth).withColumn("w", weight)
         .withColumn("most", F.col("source_size") * epochs)
         .withColumn("fill", F.col("most") / F.col("w"))
         .withColumn("all", F.sum("source_size").over(everywhere))
         .withColumn("all_w", F.sum("w").over(everywhere)))
    level = (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0))) / (
        F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("full", F.col("fill") <= level)
    t = (t.withColumn("full_size", F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everywhere))
         .withColumn("full_w", F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(everywhere)))
    open_target = F.col("w") * (F.col("all") - F.col("full_size")) / F.nullif(F.col("all_w") - F.col("full_w"), F.lit(0.0))
    return t.select("source", "source_size", "n_docs", "full",
                    F.when(F.col("full"), F.col("most").cast("double")).otherwise(open_target).alias("target"))


def thresholds(sized: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source of ``sized(source, size, key, id, row)``: target, complete
    epochs, and the key range and threshold of the fractional selection."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    t = targets(sizes, weights, epochs)
    whole = F.when(F.col("full"), F.lit(epochs)).otherwise(
        F.least(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(epochs)))
    t = cut(t.withColumn("epochs", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long"))
            .withColumn("rest", F.when(F.col("source_size") > 0,
                                       F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
            .withColumn("ranges", F.ceil(F.col("n_docs") / RANGE_ROWS)).drop("full"))
    ranged = with_thresholds(sized, t.select("source", "ranges"))
    ranged = ranged.withColumn("range", key_range("key", "ranges"))
    cells = ranged.groupBy("source", "range").agg(F.sum("size").alias("cell"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    last = (with_thresholds(cells.withColumn("upto", F.sum("cell").over(upto)), t.select("source", "rest"))
            .where(F.col("upto") > F.col("rest"))
            .groupBy("source").agg(F.min(F.struct("range", (F.col("upto") - F.col("cell")).alias("before"), "rest")).alias("b"))
            .select(F.col("source").alias("b_source"), F.col("b.range").alias("end_range"), F.col("b.before").alias("before"),
                    F.col("b.rest").alias("b_rest")))
    last = cut(last)
    inside = (ranged.join(last, ranged["source"].eqNullSafe(last["b_source"]) & (F.col("range") == F.col("end_range")))
              .select(ranged["source"], "key", "id", "row", "before", "b_rest", "size"))
    order = Window.partitionBy("source").orderBy("key", "id", "row").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(order))
    fits = F.col("upto") <= F.col("b_rest")
    left = F.col("b_rest") - F.coalesce(F.max(F.when(fits, F.col("upto"))).over(Window.partitionBy("source")), F.col("before"))
    inside = inside.withColumn("left", left).withColumn("miss", F.abs(F.col("left") - F.col("size")))
    end = inside.groupBy(F.col("source").alias("e_source")).agg(
        F.max(F.when(fits, F.struct("key", "id", "row"))).alias("e"),
        F.min(F.when(~fits & (F.col("miss") < F.col("left")), F.struct("miss", "key", "id", "row"))).alias("x"))
    out = t.join(last.select("b_source", "end_range"), F.col("source").eqNullSafe(F.col("b_source")), "left").drop("b_source")
    out = out.join(end, F.col("source").eqNullSafe(F.col("e_source")), "left")
    return cut(out.select("source", "source_size", "target", "epochs", "ranges", "end_range",
                          F.struct("e.key", "e.id", "e.row").alias("end"), F.struct("x.key", "x.id", "x.row").alias("more")))


def key_range(key: str, ranges: str) -> Column:
    """A key's range: keys are exponential, so 1 - exp(-key) is close to even."""
    return F.least(F.floor((1 - F.exp(-F.col(key))) * F.col(ranges)), F.col(ranges) - 1)


def with_thresholds(df: DataFrame, small: DataFrame) -> DataFrame:
    """``df`` joined with a per-source table (null source included): broadcast
    while that table is small in bytes, else a shuffle join that AQE may split."""
    names = {c: fresh(f"__{c}", [*df.columns, *small.columns]) for c in ("source",)}
    side = small.withColumnRenamed("source", names["source"])
    size = small.agg(F.sum(F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 128)).first()[0] or 0
    side = F.broadcast(side) if size <= BROADCAST_BYTES else side
    return df.join(side, F.col("source").eqNullSafe(F.col(names["source"]))).drop(names["source"])


def apply_thresholds(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """``sized`` with ``source_size``, ``target``, ``copies`` and ``taken``."""
    d = with_thresholds(sized, limits).withColumn("range", key_range("key", "ranges"))
    def at(c: str) -> Column:
        return F.col(f"{c}.key").isNotNull()

    mine = F.struct("key", "id", "row")
    chosen = (F.col("range") < F.col("end_range")) | (
        (F.col("range") == F.col("end_range")) & ((at("end") & (mine <= F.col("end"))) | (at("more") & (mine == F.col("more")))))
    copies = F.col("epochs") + F.coalesce(chosen, F.lit(False)).cast("long")
    return (d.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
            .drop("range", "epochs", "ranges", "end_range", "end", "more", "row"))


def sized_rows(df: DataFrame, id_col: str, source_col: str, text_col: str, *keep: Column) -> DataFrame:
    """``(keep, source, size, key, id, row)``: a row without an id has the key of
    its row number, and rows of one id are told apart by theirs."""
    row = F.monotonically_increasing_id()
    identity = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row "), row))
    return df.select(*keep, F.col(source_col).alias("source"), words(text_col).alias("size"),
                     sampling_key(identity, letter_share(text_col)).alias("key"), identity.alias("id"), row.alias("row"))


def mix_sizes(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
              weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``(id_col, source, size, source_size, target, taken, copies)`` per row.

    Sources are ordered by code point, null last (null is a source of its
    own), and take the weights in turn.  ``copies`` is complete epochs plus 1
    if selected; ``taken`` = copies x size.  Null texts have size 0; a source of
    size 0 has target 0.  Rows that share an id share a key; their row numbers
    break the tie.  A row without an id has a key of its row number.  A source
    misses its target by less than the size of one row.  An empty table gives
    no rows.
    """
    row_id = fresh("__row_id", df.columns)
    sized = cut(sized_rows(df, id_col, source_col, text_col, F.col(id_col).alias(row_id)))
    out = apply_thresholds(sized, thresholds(sized, weights, epochs))
    return out.select(F.col(row_id).alias(id_col), "source", "size", "source_size", "target", "taken", "copies")


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of ``df``, all columns, each as often as the mix takes it.
    The texts are neither shuffled nor sorted; ``df`` is read twice and must give
    the same rows in the same order, as a stored table does."""
    limits = thresholds(cut(sized_rows(df, id_col, source_col, text_col)), weights, epochs)
    row = fresh("__row", df.columns)
    rows = sized_rows(df, id_col, source_col, text_col, F.struct(*df.columns).alias(row))
    times = fresh("__times", df.columns)
    return (apply_thresholds(rows, limits).where("copies > 0")
            .select(row, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(times))
            .select(f"{row}.*"))
