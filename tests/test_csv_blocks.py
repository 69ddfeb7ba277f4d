"""Quoted CSV in blocks: equal to the whole-file reader, by several tasks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gridwatch.sources import csv_blocks as B
from gridwatch.sources import readers as R

SPLIT = "spark.sql.files.maxPartitionBytes"
OPEN_COST = "spark.sql.files.openCostInBytes"


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in (SPLIT, OPEN_COST)}

    def use(size):
        spark.conf.set(SPLIT, str(size))
        spark.conf.set(OPEN_COST, "0")
    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return folder


def _whole_file(spark, path, names):
    schema = ", ".join(f"`{n}` string" for n in names)
    return (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
            .schema(schema).csv(path))


def _rows(df):
    return sorted(tuple("" if v is None else v for v in r) for r in df.collect())


FIELDS = ["plain", "", 'say ""hi""', "two\nlines", "three\n\nlines", "a,b", '""', '"" ""\n,""', "é,\n\n\n\nü", "x" * 90, 'in""ch', "\n", ","]


def _export(rng, n, end="\n"):
    lines = ["k,a,b,c"]
    for k in range(n):
        cells = [rng.choice(FIELDS) for _ in range(3)]
        lines.append(",".join([str(k), *(f'"{c}"' if set(c) & set(',"\n') or rng.random() < .2 else c for c in cells)]))
    return end.join(line.replace("\n", end) for line in lines) + end


@pytest.mark.parametrize(("size", "end"), [(90, "\n"), (1000, "\n"), (200, "\r\n"), (10 ** 7, "\n")])
def test_blocks_equal_the_whole_file_reader(spark, scratch, small_splits, size, end):
    rng = random.Random(size)
    path = os.path.join(scratch, "in")
    for k in range(2):
        _write(path, f"f{k}.csv", _export(rng, 60, end))
    want = _rows(_whole_file(spark, path, ["k", "a", "b", "c"]))
    small_splits(size)
    raw = B.read_csv_blocks(spark, path, "_bad")
    assert raw.columns == ["k", "a", "b", "c", "_bad"]
    assert raw.where("_bad is not null").count() == 0
    assert _rows(raw.drop("_bad")) == want and len(want) == 120


def test_one_file_is_read_by_several_tasks(spark, scratch, small_splits):
    path = _write(scratch, "big.csv", _export(random.Random(1), 500))
    small_splits(2000)
    raw = B.read_csv_blocks(spark, os.path.join(path, "big.csv"), "_bad")
    tasks = raw.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 5 and raw.count() == 500


def test_a_record_over_many_blocks(spark, scratch, small_splits):
    long = "line\n" * 400
    path = _write(scratch, "c.csv", f'k,a\n1,x\n2,"{long}"\n3,y\n4,"{long}')       # the last quote is never closed
    small_splits(100)
    got = {r["k"]: r["a"] for r in B.read_csv_blocks(spark, path, "_bad").collect()}
    assert got["1"] == "x" and got["2"] == long and got["3"] == "y" and set(got) == {"1", "2", "3", "4"}


def test_stray_quotes_do_not_join_records(spark, scratch):
    path = _write(scratch, "s.csv", 'k,a\n1,5" pipe\n2,3" by 4"\n3,"quoted"tail\n4,end\n')
    got = {r["k"]: r["a"] for r in B.read_csv_blocks(spark, path, "_bad").collect()}
    assert set(got) == {"1", "2", "3", "4"} and got["1"] == '5" pipe' and got["2"] == '3" by 4"' and got["4"] == "end"


def test_every_file_is_read_by_its_own_header(spark, scratch):
    path = _write(scratch, "a.csv", "meter_number,event_time,event_code\nM1,2024-01-01 00:00:00+00,C1\n")
    _write(scratch, "b.csv", "event_code,event_time,meter_number\r\nC2,2024-01-02 00:00:00+00,M2\r\n")
    _write(scratch, "c.csv", "﻿event_time,meter_number,note\n2024-01-03 00:00:00+00,M3,\"x\ny\"\n")
    _write(scratch, "d.csv", "")
    loaded, rejects = R.split_events_csv(spark, path)
    assert {(r.meter_number, r.event_code, r.event_time.day) for r in loaded.collect()} == {("M1", "C1", 1), ("M2", "C2", 2), ("M3", None, 3)}
    assert rejects.count() == 0


def test_rejects_keep_their_text(spark, scratch):
    path = _write(scratch, "e.csv", 'meter_number,event_time\n1,"so\non"\n2\n,\n3,2024-01-01\n')
    loaded, rejects = R.split_events_csv(spark, path)
    assert [r.meter_number for r in loaded.collect()] == ["3"]
    got = {r.reason: r.record for r in rejects.collect()}
    assert "so\\non" in got["unreadable event_time"]
    assert any(k.startswith("malformed record") for k in got) and "missing meter_number; missing event_time" in got


def test_odd_files(spark, scratch):
    only_header = _write(os.path.join(scratch, "h"), "h.csv", "a,b\n")
    assert B.read_csv_blocks(spark, only_header, "_bad").count() == 0
    empty = _write(os.path.join(scratch, "e"), "e.csv", "")
    assert R.read_events_csv(spark, empty).count() == 0
    with pytest.raises(ValueError, match="lines must end"):
        B.read_csv_blocks(spark, _write(os.path.join(scratch, "r"), "r.csv", "a,b\r1,2\r"), "_bad")
    with pytest.raises(ValueError, match="header"):
        B.read_csv_blocks(spark, _write(os.path.join(scratch, "o"), "o.csv", 'a,"b\nc'), "_bad")


def test_line_states():
    for line, outside, inside in [("a,b", False, True), ('"a', True, False), ('a,"b', True, False), ('a"b,"c"', False, False),
                                  ('""', False, True), ('"""', True, False), ('","', False, True), ('x",y,"z', True, True), ("", False, True)]:
        assert B.ends_inside(line, False) is outside, line
        assert B.ends_inside(line, True) is inside, line
