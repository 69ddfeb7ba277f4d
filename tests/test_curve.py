"""Layers along a curve: ranges cover the box, other files stay closed."""

import os
import random

from pyspark.sql import functions as F

from gridwatch.operators import curve as K


def _points(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(f"{k:05d}", rng.uniform(-4, 2), rng.uniform(4, 12)) for k in range(n)]
    rows += [("e1", 180.0, 90.0), ("e2", -180.0, -90.0), ("e3", None, 5.0), ("e4", 400.0, -400.0), ("e5", float("nan"), 6.0)]
    return spark.createDataFrame(rows, "ecgkey string, geom_x double, geom_y double")


def _inside(df, box):
    return sorted(r["ecgkey"] for r in df.collect() if r["geom_x"] is not None and r["geom_y"] is not None
                  and box[0] <= r["geom_x"] <= box[2] and box[1] <= r["geom_y"] <= box[3])


BOXES = [(-2.0, 5.0, 0.5, 8.0), (-0.001, 6.0, 0.001, 6.002), (-180.0, -90.0, 180.0, 90.0), (-4.0, 4.0, -4.0, 12.0),
         (1.0, 1.0, 0.0, 2.0), (170.0, 80.0, 190.0, 95.0), (100.0, 10.0, 101.0, 11.0)]


def test_a_box_opens_only_files_that_meet_its_ranges(spark, scratch):
    points, path = _points(spark, 6000), os.path.join(scratch, "layer")
    K.write_curve_layer(points, path, files=48)
    total = len([n for n in os.listdir(path) if n.endswith(".parquet")])
    opened = {}
    for box in BOXES:
        got = K.read_box(spark, path, *box)
        opened[box] = len(got.inputFiles())
        assert sorted(r["ecgkey"] for r in got.collect()) == _inside(points, box)
        assert got.columns == points.columns
    assert total > 40 and opened[BOXES[1]] <= 3 and opened[BOXES[0]] < total // 2 and opened[BOXES[2]] >= total - 1


def test_ranges_cover_the_box_and_little_else():
    rng = random.Random(3)
    for _ in range(40):
        x, y, w = rng.uniform(-170, 160), rng.uniform(-80, 70), 10 ** rng.uniform(-3, 1)
        box = (x, y, x + w, y + w)
        ranges = K.box_ranges(*box)
        assert 0 < len(ranges) <= K.RANGES and all(a <= b for a, b in ranges) and ranges == sorted(ranges)
        cells = [(rng.uniform(box[0], box[2]), rng.uniform(box[1], box[3])) for _ in range(50)] + [box[:2], box[2:]]
        n = 1 << K.BITS
        for px, py in cells:
            key = K.interleave(int((px + 180) / 360 * n), int((py + 90) / 180 * n))
            assert any(a <= key <= b for a, b in ranges)
        covered = sum(b - a + 1 for a, b in ranges)
        assert covered <= 4 * (w / 360 * n + 2) * (w / 180 * n + 2)


def test_keys_of_columns_and_numbers_agree(spark):
    points = _points(spark, 300)
    n = 1 << K.BITS
    clamp = lambda v: int(max(0, min(v, n - 1)))
    for r in points.where("not isnan(geom_x)").withColumn("key", K.curve_key("geom_x", "geom_y")).collect():
        want = None if r["geom_x"] is None else K.interleave(clamp((r["geom_x"] + 180) / 360 * n), clamp((r["geom_y"] + 90) / 180 * n))
        assert r["key"] == want


def test_a_crowded_cell_is_split_over_files(spark, scratch):
    path = os.path.join(scratch, "crowd")
    crowd = spark.range(4000).select(F.col("id").cast("string").alias("ecgkey"), F.lit(-1.0).alias("geom_x"), F.lit(6.0).alias("geom_y"))
    K.write_curve_layer(crowd, path, files=8)
    counts = [r["points"] for r in spark.read.parquet(f"{path}/{K.MANIFEST}").collect()]
    assert len(counts) >= 6 and max(counts) < 1200 and K.read_box(spark, path, -1.0, 6.0, -1.0, 6.0).count() == 4000
