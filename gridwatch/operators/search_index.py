"""Customer snapshots stored in name order, with two small indexes.

* Ranks: rows and least key per file.  The files hold consecutive stretches of
  the name order, so the running sum of their rows says in which files a page
  lies; only these are opened and sorted, whatever the page's number.
* Trigrams: which files hold a value with a given run of three characters, per
  searched column.  A value that contains the search text contains all its
  trigrams, so files that lack one of them can't hold a match and stay
  closed; the rest are read and the exact predicate decides.

Both are relations of their own beside the data files (their folders' names
begin with ``_``, which readers of the snapshot skip).  Lookups return file
names, never rows, to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwatch.functions.params import CustomerFilter, normalise_customer_filter
from gridwatch.functions.text import contains_pattern
from gridwatch.operators.customers import customer_order, filter_customers

RANKS, TRIGRAMS = "_ranks", "_trigrams"
GRAM = 3
#: Columns that ``search`` looks in, and whether they are
#: compared in upper case.
SEARCHED = [("fullname", True), ("accountnumber", False), ("meternumber", False)]
#: Columns of other substring filters, in upper case.
CONTAINED = ["regionname", "districtname", "metermake", "metermodel"]


def _compared(column: str, upper: bool) -> Column:
    return F.upper(F.col(column)) if upper else F.col(column)


def literal_trigrams(needle: str) -> list[str]:
    """Trigrams that every value which a LIKE search for ``needle`` finds must
    hold: those of the pattern's stretches without wildcards."""
    stretches, at, pattern = [""], 0, contains_pattern(needle)
    while at < len(pattern):
        if pattern[at] == "\\" and at + 1 < len(pattern):
            at += 1
            stretches[-1] += pattern[at]
        elif pattern[at] in "%_":
            stretches.append("")
        else:
            stretches[-1] += pattern[at]
        at += 1
    return sorted({s[k:k + GRAM] for s in stretches for k in range(len(s) - GRAM + 1)})


def write_indexed_customers(customers: DataFrame, path: str, files: int | None = None) -> None:
    """Store customers in name order with their ranks and trigrams."""
    spark = customers.sparkSession
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = customers.repartitionByRange(parts, *customer_order()).sortWithinPartitions(*customer_order())
    ordered.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_name"))
    first = F.min(F.struct(F.col("fullname").isNull(), F.col("fullname"), F.col("ecgkey")))
    ranks = stored.groupBy("file").agg(F.count("*").alias("n"), first.alias("least"))
    # a row per file
    before = F.sum("n").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1))
    ranks.select("file", "n", F.coalesce(before, F.lit(0)).alias("start")).write.mode("overwrite").parquet(f"{path}/{RANKS}")
    columns = [(c, up) for c, up in [*SEARCHED, *((c, True) for c in CONTAINED)] if c in customers.columns]
    values = F.array(*[F.struct(F.lit(c).alias("column"), _compared(c, up).alias("value")) for c, up in columns])
    each = F.sequence(F.lit(1), F.length("value") - (GRAM - 1))
    grams = (stored.select("file", F.inline(values)).where(F.length("value") >= GRAM).distinct()
             .select("file", "column", F.explode(F.array_distinct(F.transform(each, lambda k: F.col("value").substr(k, F.lit(GRAM))))).alias("gram"))
             .distinct())
    (grams.repartitionByRange("column", "gram").sortWithinPartitions("column", "gram")
     .write.mode("overwrite").parquet(f"{path}/{TRIGRAMS}"))


def _files_with(spark: SparkSession, path: str, column: str, needle: str) -> DataFrame | None:
    """Files that may hold a match in a column; None: the text says nothing."""
    grams = literal_trigrams(needle)
    if not grams:
        return None
    held = spark.read.parquet(f"{path}/{TRIGRAMS}").where((F.col("column") == column) & F.col("gram").isin(grams))
    return held.groupBy("file").count().where(F.col("count") == len(grams)).select("file")


def candidate_files(spark: SparkSession, path: str, f: CustomerFilter) -> list[str] | None:
    """Names of the files that the substring filters leave; None: all."""
    f = normalise_customer_filter(f)
    wanted: list[Sequence[str]] = [[c for c, _ in SEARCHED]] if f.search else []
    needles = [f.search] if f.search else []
    for attr, column in (("region_name", "regionname"), ("district_name", "districtname"), ("meter_make", "metermake"), ("meter_model", "metermodel")):
        if getattr(f, attr):
            wanted.append([column])
            needles.append(getattr(f, attr))
    left: DataFrame | None = None
    for columns, needle in zip(wanted, needles, strict=True):
        found = [_files_with(spark, path, c, needle) for c in columns]
        if any(x is None for x in found):
            continue
        some = found[0]
        for x in found[1:]:
            some = some.unionByName(x)
        some = some.distinct()
        left = some if left is None else left.join(some, "file", "left_semi")
    return None if left is None else [r["file"] for r in left.sort("file").collect()]


def read_files(spark: SparkSession, path: str, names: list[str] | None) -> DataFrame:
    if names is None:
        return spark.read.parquet(path)
    if not names:
        return spark.read.parquet(path).limit(0)
    return spark.read.parquet(*[f"{path}/{n}" for n in names])


def search_customers(spark: SparkSession, path: str, f: CustomerFilter, meter_summary_df: DataFrame | None = None) -> DataFrame:
    """``filter_customers`` over a stored snapshot, opening only the files that
    the trigrams of its substring filters leave."""
    return filter_customers(read_files(spark, path, candidate_files(spark, path, f)), f, meter_summary_df)


def stored_page(spark: SparkSession, path: str, page: int, page_size: int) -> DataFrame:
    """Customers of one page in name order: the files it lies in are named by
    the ranks, opened and sorted; no other is."""
    f = normalise_customer_filter(CustomerFilter(page=page, page_size=page_size))
    offset = (f.page - 1) * f.page_size
    hit = (F.col("start") < offset + f.page_size) & (F.col("start") + F.col("n") > offset)
    files = spark.read.parquet(f"{path}/{RANKS}").where(hit & (F.col("n") > 0)).sort("start").collect()   # the page's files
    rows = read_files(spark, path, [r["file"] for r in files])
    skipped = files[0]["start"] if files else 0
    return rows.orderBy(*customer_order()).offset(offset - skipped if files else 0).limit(f.page_size)
