"""Attempt lock-out counter over an audit stream of login attempts.

Rule per user, in attempt order (time, then id):
  * no live counter (none yet, expired, or cleared) -> counter starts: 1,
    expiring ``window`` after this attempt; otherwise counter + 1 (the
    expiry does not move);
  * counter > ``max_failed`` -> result ``locked`` (nothing else happens);
  * else a successful attempt clears the counter -> ``success``;
  * else -> ``failed``.

Batch form: ``attempt_lockouts``, joins and range-partitioned prefix sums, no
Python.  ``_fold`` is the rule itself, used by the stream for one micro-batch
of one user.
"""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwatch.session import checkpoint_dir

# Default limits.
DEFAULT_WINDOW = timedelta(minutes=15)
DEFAULT_MAX_FAILED = 5

RESULT_SCHEMA = ("user string, ts timestamp, attempt_id long, success boolean, "
                 "counter long, result string")


def _fold(users, ts, ok, window_us: int, max_failed: int, state: dict):
    """Sequential fold over sorted arrays; ``state`` maps user -> (count, expires)."""
    n = len(users)
    counter = np.empty(n, dtype=np.int64)
    result = np.empty(n, dtype=object)
    for i in range(n):
        u, t = users[i], ts[i]
        cnt, exp = state.get(u, (0, None))
        if exp is None or t >= exp:
            cnt, exp = 1, t + window_us
        else:
            cnt += 1
        counter[i] = cnt
        if cnt > max_failed:
            result[i] = "locked"
            state[u] = (cnt, exp)
        elif ok[i]:
            result[i] = "success"
            state.pop(u, None)
        else:
            result[i] = "failed"
            state[u] = (cnt, exp)
    return counter, result


def _as_micros(s: pd.Series) -> np.ndarray:
    return s.astype("datetime64[us]").astype("int64").to_numpy()


def _prefix(df: DataFrame, key: str, order: list[str], col: str, how: str, partitions: int) -> DataFrame:
    """Adds ``_prefix``: sum or max of ``col`` over the rows of the same
    ``key`` strictly before each row in ``order``, computed without putting a
    key in one task: rows are range-partitioned on (key, order), each
    (partition, key) piece is scanned locally, and pieces are chained by a
    small table of per-piece totals."""
    agg = F.sum if how == "sum" else F.max
    ranged = df.repartitionByRange(partitions, key, *order).withColumn("_pid", F.spark_partition_id())
    checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint(eager=True)            # fixes the piece ids for both uses below
    before = Window.partitionBy("_pid", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_loc", agg(col).over(before))
    pieces = ranged.groupBy("_pid", key).agg(agg(col).alias("_tot"))
    earlier = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.withColumn("_carry", agg("_tot").over(earlier)).select("_pid", key, "_carry")
    j = local.join(carry, ["_pid", key])
    if how == "sum":
        value = F.coalesce(F.col("_carry"), F.lit(0)) + F.coalesce(F.col("_loc"), F.lit(0))
    else:
        value = F.greatest(F.col("_carry"), F.col("_loc"))
    return j.withColumn("_prefix", value).drop("_pid", "_loc", "_carry")


def attempt_lockouts(attempts: DataFrame, window: timedelta = DEFAULT_WINDOW,
                     max_failed: int = DEFAULT_MAX_FAILED, partitions: int | None = None) -> DataFrame:
    """Per attempt: the counter value and ``locked``/``success``/``failed``.

    ``attempts`` columns: ``user``, ``ts`` (timestamp), ``attempt_id``,
    ``success`` (boolean, NULL counts as a failure).  Attempts without a user
    count as one user.

    One algorithm for every size; no user is processed in one task.  Counting
    positions p = 0, 1, … per user in attempt order, a counter that starts at
    p runs until the next restart nxt(p): the first attempt at or after
    t_p + window, or the attempt after a success with counter ≤ limit.  The
    counters actually started form the chain 0, nxt(0), nxt(nxt(0)), …, found
    by pointer doubling; a pointer that has left the user's attempts is
    finished and dropped, so every round joins fewer rows.  Each attempt's
    counter is its position minus the last chain start at or before it, plus
    one.
    """
    spark = attempts.sparkSession
    checkpoint_dir(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    window_us = int(window / timedelta(microseconds=1))
    span = F.expr(f"make_dt_interval(0, 0, 0, {window_us} / 1000000.0)")
    # the user as a never-NULL key: equal for all attempts without a user
    key = F.when(F.col("user").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("user").cast("string")))
    a = attempts.select(key.alias("u"), F.col("ts").cast("timestamp").alias("ts"),
                        F.col("attempt_id").cast("long").alias("attempt_id"),
                        F.coalesce(F.col("success").cast("boolean"), F.lit(False)).alias("success"))
    pos = (_prefix(a.withColumn("_one", F.lit(1)), "u", ["ts", "attempt_id"], "_one", "sum", parts)
           .withColumnRenamed("_prefix", "pos").drop("_one"))
    pos = pos.checkpoint(eager=True)
    # expiry restart e(p): number of the user's attempts earlier than t_p + window
    queries = pos.select("u", (F.col("ts") + span).alias("t"), F.lit(0).alias("kind"), F.col("pos").alias("qpos"),
                         F.lit(0).alias("_d"))
    data = pos.select("u", F.col("ts").alias("t"), F.lit(1).alias("kind"), F.col("pos").alias("qpos"), F.lit(1).alias("_d"))
    cnt = _prefix(queries.unionByName(data), "u", ["t", "kind", "qpos"], "_d", "sum", parts)
    expiry = cnt.filter(F.col("kind") == 0).select("u", F.col("qpos").alias("pos"), F.col("_prefix").alias("e"))
    # clearing success: a success at q clears the counter started at r when
    # q - r < limit and t_q < t_r + window; then the restart is q + 1
    succ = (pos.filter("success").select("u", F.col("pos").alias("q"), F.col("ts").alias("tq"))
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max_failed - 1))))
            .withColumn("pos", F.col("q") - F.col("k")).filter(F.col("pos") >= 0))
    starts = pos.select("u", "pos", F.col("ts").alias("tr"))
    clear = (succ.join(starts, ["u", "pos"]).filter(F.col("tq") < F.col("tr") + span)
             .groupBy("u", "pos").agg((F.min("q") + 1).alias("c")))
    n = pos.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    jump = (expiry.join(clear, ["u", "pos"], "left")
            .select("u", "pos", F.least(F.col("e"), F.coalesce(F.col("c"), F.col("e"))).alias("j"))
            .join(n, "u").filter(F.col("j") < F.col("n")).drop("n").checkpoint(eager=True))
    path = n.select("u", F.lit(0).cast("long").alias("pos")).checkpoint(eager=True)
    while not jump.isEmpty():
        step = path.join(jump, ["u", "pos"]).select("u", F.col("j").alias("pos"))
        path = path.unionByName(step).distinct().checkpoint(eager=True)
        ahead = jump.select("u", F.col("pos").alias("j"), F.col("j").alias("jj"))
        jump = jump.join(ahead, ["u", "j"]).select("u", "pos", F.col("jj").alias("j")).checkpoint(eager=True)
    marked = pos.join(path.withColumn("_start", F.col("pos")), ["u", "pos"], "left")
    owner = (_prefix(marked.withColumn("_s", F.col("_start")), "u", ["pos"], "_s", "max", parts)
             .withColumn("start", F.greatest(F.col("_prefix"), F.col("_start"))))
    counter = (F.col("pos") - F.col("start") + 1).cast("long")
    result = F.when(counter > max_failed, "locked").when(F.col("success"), "success").otherwise("failed")
    user = F.when(F.col("u") != "-", F.substring("u", 2, 2147483647))
    return owner.select(user.alias("user"), "ts", "attempt_id", "success", counter.alias("counter"), result.alias("result"))


def attempts_from_events(events: DataFrame) -> DataFrame:
    """Login attempts derived from the driver's event stream: one attempt per
    event, by user, successful for ``purchase``/``signup`` events."""
    return events.select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("attempt_id"),
        F.col("event_type").isin("purchase", "signup").alias("success"))
