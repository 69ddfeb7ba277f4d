"""Output schemas against the declared relations, and the remaining helpers."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from gridwatch import schemas as SC
from gridwatch.operators import summaries as S
from gridwatch.plans.refresh import Refresh, backfill_any_flags
from gridwatch.sources import fixtures as X
from gridwatch.sources.readers import read_customers, read_customers_csv
from gridwatch.sources.sinks import insert_missing
from tests.helpers import customers, events

SF = "/root/testdata/sf0.01"


def _types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def _declared(schema):
    return {f.name: f.dataType.simpleString() for f in schema.fields}


def test_csv_customers_match_declared_schema(spark, scratch):
    path = os.path.join(scratch, "c.csv")
    with open(path, "w") as fh:
        fh.write("ecgkey,meternumber\n1,M1\n")
    df = read_customers_csv(spark, path)
    assert _types(df) == _declared(SC.CUSTOMER_SCHEMA)
    df.write.parquet(os.path.join(scratch, "c"))
    assert read_customers(spark, os.path.join(scratch, "c")).count() == 1


def test_summaries_match_declared_schemas(spark):
    cust = X.customers(spark, SF)
    ev = X.tamper_events(spark, SF).withColumn("event_time", F.col("event_time").cast("timestamp"))
    as_of = datetime(2024, 2, 1)
    ms = S.meter_summary(ev, cust, as_of=as_of)
    assert _types(ms) == _declared(SC.METER_SUMMARY_SCHEMA)
    des = S.district_event_summary(cust, ms, as_of=as_of)
    assert _types(des) == _declared(SC.DISTRICT_SUMMARY_SCHEMA)
    flagged = S.with_coordinate_flags(cust, ms)
    assert set(SC.FLAG_COLUMNS) <= set(flagged.columns)


def test_checkpoint_log_matches_declared_schema(spark, scratch):
    r = Refresh(spark, os.path.join(scratch, "root"), run_id="r")
    r.register_steps()
    r.register_steps()                        # do-nothing on conflict
    cp = r.checkpoints()
    assert _types(cp) == _declared(SC.CHECKPOINT_SCHEMA)
    assert cp.count() == 4 and cp.filter("completed").count() == 0
    assert r._log().count() == 4


def test_insert_missing_keeps_existing_rows(spark):
    old = spark.createDataFrame([("a", False), ("b", True)], "step string, completed boolean")
    new = spark.createDataFrame([("a", True), ("c", False)], "step string, completed boolean")
    got = {r["step"]: r["completed"] for r in insert_missing(old, new, ["step"]).collect()}
    assert got == {"a": False, "b": True, "c": False}


def test_backfill_any_flags(spark):
    cust = customers(spark, [{"ecgkey": "1", "meternumber": "M1"}, {"ecgkey": "2", "meternumber": "M2"}])
    ev = events(spark, [{"meter_number": "M1", "event_time": "2024-01-01 00:00:00", "latitude": 1.0,
                         "longitude": 2.0}, {"meter_number": "M1", "event_time": "2024-01-02 00:00:00"}])
    got = {r["ecgkey"]: r["has_any_coordinates"] for r in backfill_any_flags(cust, ev).collect()}
    assert got == {"1": True, "2": False}


def test_lockouts_run_from_another_working_directory(tmp_path):
    """Python workers must import the package even when the caller's working
    directory is not the repository (the package is shipped with addPyFile)."""
    import subprocess
    import sys as _sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from datetime import datetime\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from gridwatch.operators.lockouts import attempt_lockouts\n"
        "df = s.createDataFrame([('u', datetime(2024, 1, 1), 1, False)], "
        "'user string, ts timestamp, attempt_id long, success boolean')\n"
        "print('RESULT', attempt_lockouts(df).collect()[0]['result'])\n" % repo)
    out = subprocess.run([_sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True,
                         timeout=300)
    assert "RESULT failed" in out.stdout, out.stderr[-2000:]
