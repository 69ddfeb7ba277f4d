"""Bitmap counts merge exactly; crowded tiles are split."""

import random

from pyspark.sql import functions as F

from gridwatch.operators import distinct as D
from gridwatch.operators import spatial as K
from tests.helpers import customers


def test_distinct_meters_of_districts_regions_and_the_nation(spark):
    rng = random.Random(2)
    rows = [{"ecgkey": str(k), "meternumber": rng.choice([None, *(f"M{m}" for m in range(60))]),
             "districtcode": rng.choice([None, "d1", "d2", "d3", "d4"]), "regioncode": rng.choice(["r1", "r2", None])} for k in range(500)]
    got = {(r["level"], r["code"]): (r["meters"], r["summed_meters"]) for r in D.distinct_meters(customers(spark, rows)).collect()}
    used = [r for r in rows if r["districtcode"] and r["meternumber"]]
    want = {}
    for level, column in (("district", "districtcode"), ("region", "regioncode"), ("nation", None)):
        for code in {r[column] if column else "" for r in used} - {None}:
            own = [r for r in used if column is None or r[column] == code]
            want[level, code] = (len({r["meternumber"] for r in own}), len({(r["districtcode"], r["meternumber"]) for r in own}))
    assert got == want and want["nation", ""][0] < want["nation", ""][1]
    assert D.distinct_meters(customers(spark, rows).limit(0)).count() == 0


def test_bitmaps_merge_over_buckets(spark):
    """Ordinals over several buckets of 32,768; halves merge to the whole."""
    n = 100_000
    rows = spark.range(n).select((F.col("id") * 3 % n + 1).alias("ordinal"), (F.col("id") % 7).alias("g"))
    halves = D.distinct_bitmaps(rows.where("ordinal < 60000"), ["g"]).unionByName(D.distinct_bitmaps(rows.where("ordinal > 40000"), ["g"]))
    got = {r["g"]: r["n"] for r in D.count_distinct(halves, ["g"], "n").collect()}
    assert got == {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count_distinct("ordinal").alias("n")).collect()}
    assert D.merge_bitmaps(halves, []).count() == 4


def test_ordinals_are_dense(spark):
    keys = spark.range(5000).select(F.when(F.col("id") % 10 > 0, F.concat(F.lit("k"), F.col("id") % 997)).alias("k"))
    got = D.ordinals(keys, "k").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(1, len(got) + 1)) and [r["k"] for r in got] == sorted({r["k"] for r in got})


def test_all_points_in_one_place_are_all_listed(spark):
    same = spark.range(500).select(F.col("id").cast("string").alias("ecgkey"), F.lit(-1.0).alias("geom_x"), F.lit(6.0).alias("geom_y"))
    far = same.limit(3).select(F.concat(F.lit("f"), "ecgkey").alias("ecgkey"), F.lit(100.0).alias("geom_x"), "geom_y")
    none = same.limit(2).select(F.concat(F.lit("n"), "ecgkey").alias("ecgkey"), F.lit(None).cast("double").alias("geom_x"), "geom_y")
    got = K.tile_leaves(same.unionByName(far).unionByName(none), zmin=5, zmax=9, most=10).collect()
    by_zoom = {}
    for r in got:
        by_zoom.setdefault(r["tile_z"], set()).add(r["ecgkey"])
    assert by_zoom == {9: {str(k) for k in range(500)}, 5: {r["ecgkey"] for r in far.collect()}} and len(got) == 503
