"""What five document filters remove, alone and together, in every order
(operator 13).

A coalition S of filters plays the game v(S): how many documents fail at least
one of its filters.  The documents only have to be counted by the set of
filters that they fail; all 32 games follow.  The Hart-Mas-Colell potential,
P(S) = (v(S) + sum of P(S without i) over i in S) / |S|, is found by coalition
size; a filter's Shapley value is P(all) - P(all without it).  Multiplied by
|S|! everything stays an integer.  What a step of an order removes is
v(before and it) - v(before).
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwatch.llm.common import WORD
from gridwatch.operators.joins import left_join_nullable

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, r"[#$%&*|]"
ALL = (1 << len(FILTERS)) - 1


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = {"A": n < LEAST_WORDS, "B": 100 * different < LEAST_DISTINCT * n,
             "C": 100 * capitals > MOST_CAPITALS * F.length(text), "D": text.rlike(MARKS)}
    return sum((F.when(fails, _bit(k)).otherwise(0) for k, fails in tests.items()), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "lang") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by part and failed filters.

    Only a hash per text is shuffled, and documents that share it are counted
    before they meet: a text that a third of all rows repeat is a few rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text).alias("mask"))
            .groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("copies")))
    marks = labels.groupBy(F.col(id_col).alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    of_text = ["digest", "part", "mask", "good", "toxic", "noid"]
    grouped = (left_join_nullable(rows, marks, "id", "label_id", spread_by=["digest"])
               .fillna(0, ["good", "toxic"]).withColumn("noid", F.col("id").isNull())
               .groupBy(of_text).agg(F.sum("copies").alias("n"), F.min("id").alias("low"), F.min_by("copies", "id").alias("n_low")))
    lowest = F.min("low").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("lowest").isNull(), F.col("n")).when(F.col("low") == F.col("lowest"), F.col("n_low")).otherwise(0)
    counted = grouped.withColumn("lowest", lowest).withColumn("firsts", firsts)
    both = F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")),
                   F.struct((F.col("mask") + _bit("E")).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))
    return (counted.select("part", "good", "toxic", F.inline(both)).groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
                 F.sum(F.col("n") * F.col("toxic")).alias("toxic")))


def games(counts: DataFrame) -> DataFrame:
    """Per part: its documents, the three games (arrays by coalition) and the
    potentials times |S|!."""
    def game(column: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(column)).otherwise(0)) for s in range(ALL + 1)])

    out = counts.groupBy("part").agg(F.sum("n").alias("docs"), game("n").alias("v"), game("good").alias("good"), game("toxic").alias("toxic"))
    out = out.withColumn("q0", F.lit(0).cast("long"))
    for size in range(1, len(FILTERS) + 1):
        out = out.withColumns({f"q{s}": F.col("v")[s] * factorial(size - 1) + sum(F.col(f"q{s & ~(1 << i)}") for i in range(len(FILTERS)) if s >> i & 1)
                               for s in range(ALL + 1) if s.bit_count() == size})
    return out.select("part", "docs", "v", "good", "toxic", F.array(*[f"q{s}" for s in range(ALL + 1)]).alias("q"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: ``part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Null text counts as empty, null part as the empty string.  Filter E fails a
    row whose text a smaller id has; a null id is larger than all others and
    equal to other nulls, and rows of one id don't fail each other.  A document
    with several label rows is good or toxic if any says so; null labels say
    nothing.  ``shapley`` is the sum over all orders of what the filter
    removes.  Repeated rows count each; extra columns are ignored; without documents
    there is no part and no row.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    order, step = F.col("filter_order"), F.col("step")
    steps = (games(failure_counts(docs, labels, id_col, text_col, part_col))
             .withColumn("filter_order", F.explode(F.lit(orders)))
             .withColumn("step", F.explode(F.lit(list(range(1, len(FILTERS) + 1))))))
    ahead = F.substring(order, F.lit(1), step - 1)
    bit = sum(F.when(F.substring(order, step, F.lit(1)) == k, _bit(k)).otherwise(0) for k in FILTERS)
    before = sum(F.when(ahead.contains(k), _bit(k)).otherwise(0) for k in FILTERS)
    steps = steps.withColumns({"bit": bit, "before": before}).withColumn("after", F.col("before") + F.col("bit"))

    def lost(game: str) -> Column:
        return F.col(game)[F.col("after")] - F.col(game)[F.col("before")]

    return steps.select(
        "part", "filter_order", "step", (F.col("docs") - F.col("v")[F.col("after")]).alias("kept"), lost("v").alias("removed"),
        (F.col("v")[F.col("bit")] - lost("v")).alias("redundant"),
        (F.col("v")[ALL] - F.col("v")[F.lit(ALL) - F.col("bit")]).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        (F.col("q")[ALL] - len(FILTERS) * F.col("q")[F.lit(ALL) - F.col("bit")]).alias("shapley"))
