"""Stored order, trigram postings and bucketed snapshots: equal results, fewer files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gridwatch.functions.params import CustomerFilter
from gridwatch.operators import customers as C
from gridwatch.operators import search_index as X
from gridwatch.sources.buckets import BucketedSnapshot
from tests.helpers import customers


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(5)
    first, last = ["Ama", "Kofi", "Esi", "Yaw", None], ["Mensah", "Boateng", "Owusu 100%", "A_B", "Tetteh\\x"]
    rows = []
    for k in range(1200):
        name = rng.choice(first)
        rows.append({"ecgkey": f"{k:05d}", "fullname": name and f"{name} {rng.choice(last)} {k // 7:04d}", "accountnumber": f"7050{k:06d}",
                     "meternumber": rng.choice([None, f"P{k * 37 % 5000:05d}"]), "regionname": rng.choice(["Accra East", "Volta"])})
    df = customers(spark, rows)
    path = str(tmp_path_factory.mktemp("idx") / "customers")
    X.write_indexed_customers(df, path, files=30)
    return df, path


SEARCHES = ["mensah 0100", "00%", "owusu 100%", "A_B 00", "70500009", "P0123", "p0123", "zz", "x", "", "boateng\\", "tetteh\\\\x", "nobody at all", "ama%0010", "é"]


@pytest.mark.parametrize("text", SEARCHES)
def test_search_through_trigrams_equals_the_filter(spark, stored, text):
    df, path = stored
    f = CustomerFilter(search=text, region_name="acc")
    want = sorted(r["ecgkey"] for r in C.filter_customers(df, f).collect())
    got = X.search_customers(spark, path, f)
    assert sorted(r["ecgkey"] for r in got.collect()) == want and got.columns == df.columns


def test_a_narrow_search_opens_few_files(spark, stored):
    _, path = stored
    assert len(X.search_customers(spark, path, CustomerFilter(search="mensah 0100")).inputFiles()) < 12
    assert X.candidate_files(spark, path, CustomerFilter(search="nobody at all")) == []
    assert X.candidate_files(spark, path, CustomerFilter(search="a%b")) is None
    assert X.literal_trigrams("ab%cdef_gh") == ["CDE", "DEF"] and X.literal_trigrams("a\\%b") == ["A%B"]


@pytest.mark.parametrize(("page", "size"), [(1, 50), (7, 100), (24, 50), (25, 50), (3, 200), (0, 0)])
def test_a_page_opens_the_files_it_lies_in(spark, stored, page, size):
    df, path = stored
    got = X.stored_page(spark, path, page, size)
    want = C.page_rows(df, CustomerFilter(page=page, page_size=size))
    assert [r["ecgkey"] for r in got.collect()] == [r["ecgkey"] for r in want.collect()]
    assert len(got.inputFiles()) <= max(1, (size or 20) // 40 + 3) or not got.count()


def test_a_merge_rewrites_touched_buckets_only(spark, scratch):
    snap = BucketedSnapshot(spark, scratch, "meters", "k", buckets=16)
    rows = spark.range(400).select(F.concat(F.lit("m"), "id").alias("k"), F.lit(1).alias("v"))
    snap.merge(rows)
    before = snap.manifest()
    new = spark.createDataFrame([("m7", 2), ("fresh", 3)], "k string, v int")
    written = snap.merge(new)
    after = BucketedSnapshot(spark, scratch, "meters", "k", buckets=16).manifest()
    assert 1 <= len(written) <= 2 and {b for b in before if before[b] != after[b]} == set(written)
    got = {r["k"]: r["v"] for r in snap.read().collect()}
    assert got == {f"m{k}": 1 for k in range(400)} | {"m7": 2, "fresh": 3}
    assert snap.merge(new.limit(0)) == [] and snap.manifest() == after
    empty = BucketedSnapshot(spark, os.path.join(scratch, "e"), "meters", "k", buckets=4)
    empty.merge(rows.limit(0))
    assert empty.read().count() == 0 and empty.read().columns == ["k", "v"]
    empty.merge(new)
    assert empty.read().count() == 2
