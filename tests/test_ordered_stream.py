"""Ordered streams: equal to a sort, restored in the middle, and an error for what comes too late."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.streaming import ordered

RNG = random.Random(2)
SCHEMA = "k string, at long, n int, v string"


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def batches(n=4, per=60, width=50):
    """Positions that rise, each up to `width` late; nulls among the values and the keys."""
    out, at, i = [], 0, 0
    for _ in range(n):
        rows = []
        for _ in range(per):
            at += RNG.randint(0, 3)
            i += 1
            rows.append((RNG.choice(["a", "b", None]), max(0, at - RNG.randint(0, width // 2)), i, RNG.choice([None, "x"])))
        out.append(rows)
    return out


def sorted_rows(parts):
    out = []
    for k in {r[0] for p in parts for r in p}:
        mine = sorted((r for p in parts for r in p if r[0] == k), key=lambda r: (r[1], r[2]))
        out += [(*r, i + 1) for i, r in enumerate(mine)]
    return sorted(out, key=repr)


def test_equals_a_sort_and_goes_on(spark, tmp_path):
    parts, path, state, out = batches(), str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out")
    for p in parts[:2]:
        write(spark, p, path)
    first = ordered.run_in_order(stream(spark, path), ["k"], "at", 50, ("n",), state, out)
    assert sorted(map(tuple, first.collect()), key=repr) == sorted_rows(parts[:2])
    left = spark.read.parquet(out)
    # what has left is a beginning of the order, and the window behind the newest record is still held
    newest = {k: max(r[1] for p in parts[:2] for r in p if r[0] == k) for k in ("a", "b", None)}
    assert 0 < left.count() < 120 and all(r["at"] < newest[r["k"]] - 50 for r in left.collect())
    # stopped, and started again in the middle: state comes from the checkpoint
    for p in parts[2:]:
        write(spark, p, path)
    whole = ordered.run_in_order(stream(spark, path), ["k"], "at", 50, ("n",), state, out)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted_rows(parts)
    assert whole.filter(F.col("v").isNull()).count() == sum(r[3] is None for p in parts for r in p)


def test_late_records_stop_the_query(spark, tmp_path):
    path, state, out = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out")
    write(spark, [("a", 10, 1, None), ("a", 500, 2, None)], path)
    assert ordered.run_in_order(stream(spark, path), ["k"], "at", 100, ("n",), state, out).count() == 2
    write(spark, [("b", 3, 4, None), ("a", 450, 3, None)], path)  # within the window, and another key
    assert ordered.run_in_order(stream(spark, path), ["k"], "at", 100, ("n",), state, out).count() == 4
    write(spark, [("a", 9, 5, None)], path)
    with pytest.raises(Exception, match="comes after 10 has left"):
        ordered.run_in_order(stream(spark, path), ["k"], "at", 100, ("n",), state, out)


def test_idle_keys_leave_by_timer(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, [("a", 3, 1, None), ("a", 1, 2, "x")], path)
    x = ordered.in_order(stream(spark, path), ["k"], "at", 100, ("n",), idle=500)
    q = x.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(100):
            q.awaitTermination(1)
            got = spark.read.schema(x.schema).parquet(out).collect() if (tmp_path / "out").exists() else []
            if got:
                break
    finally:
        q.stop()
    assert sorted((r["at"], r["n"], r["place"]) for r in got) == [(1, 2, 1), (3, 1, 2)]
