"""Admission filter and trailing hits: batch and stream against a plain loop."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from grainfold.streaming import admission


@pytest.fixture(scope="module")
def events(spark):
    random.seed(11)
    rows, t = [], 0
    for i in range(1500):
        t += random.choice([0, 1, 1, 2, 30]) if i % 200 else 400
        rows.append((i, 0 if i % 3 == 0 else i % 7, t))  # one key holds a third of the rows
    df = spark.createDataFrame(rows, "o bigint, k bigint, s bigint")
    return df.select("o", "k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "s")


def plain(events, limit, window):
    held, out = defaultdict(deque), {}
    for r in sorted(events.collect(), key=lambda r: (r["s"], r["o"])):
        out[r["o"]] = admission._admit(r["s"] * 1_000_000, held[r["k"]], limit, window * 1_000_000)
    return out


@pytest.mark.parametrize("limit,window", [(3, 60), (1, 10), (20, 30), (60, 60)])
def test_batch(events, limit, window):
    got = {r["o"]: (r["admitted"], r["remaining"], r["retry_after"])
           for r in admission.admit(events.drop("s"), "k", "ts", "o", limit, window).collect()}
    assert got == plain(events, limit, window)


def test_hits(events):
    rows = events.collect()
    for r in admission.window_hits(events, "k", "ts", 40, spans=2).collect():
        assert r["hits"] == sum(1 for x in rows if x["k"] == r["k"] and 0 <= (r["ts"] - x["ts"]).total_seconds() <= 40)


def streamed(spark, events, path, files, **how):
    """What the stream gives for rows dealt to some files, one per trigger; ``files`` are conditions on the rows."""
    for where in files:
        events.where(where).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    name = f"admitted_{abs(hash(path))}"
    run = admission.admit_stream(stream, "k", "ts", "o", **how).writeStream.format("memory").queryName(name).outputMode("append").start()
    run.processAllAvailable()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    run.stop()
    return {r["o"]: (r["k"], r["ts"], r["admitted"], r["remaining"], r["retry_after"]) for r in spark.table(name).collect()}, state


FAR = 10_000_000  # seconds after all events


def test_stream_is_the_batch_whatever_the_order_of_arrival(spark, events, tmp_path):
    late = F.pmod(F.xxhash64("o"), F.lit(4))  # rows of one moment come in different triggers
    rows = events.where("o < 900").select("o", F.when(F.col("k") != 1, F.concat(F.lit("key "), "k")).alias("k"), "s", "ts")  # text keys and a null one
    untimed = rows.where("o < 5").select((F.col("o") + 5000).alias("o"), "k", F.lit(None).cast("bigint").alias("s"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    last = spark.createDataFrame([(9999, "end", FAR)], "o bigint, k string, s bigint").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    whole = rows.unionByName(untimed)
    # the end comes as a trigger of its own, so that the watermark passes all others
    files = [(late == i) & (F.coalesce("s", F.lit(0)) < FAR) for i in range(4)] + [F.col("s") == FAR]
    got, state = streamed(spark, whole.unionByName(last).drop("_"), str(tmp_path / "in"), files, max_requests=5, window_seconds=60, late="2 days")
    want = {r["o"]: (r["k"], r["ts"], r["admitted"], r["remaining"], r["retry_after"]) for r in admission.admit(whole, "k", "ts", "o", 5, 60).collect()}
    assert got == want and any(v[0] is None for v in got.values()) and sum(v[2] is False for v in got.values()) > 10


def test_verdicts_come_with_the_watermark_and_idle_keys_leave_no_state(spark, events, tmp_path):
    path = str(tmp_path / "in")
    ends = spark.createDataFrame([(9000 + i, 90 + i, FAR * (i + 1)) for i in range(2)], "o bigint, k bigint, s bigint").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    rows = events.unionByName(ends)
    files = [(F.col("s") < FAR) & (F.col("o") < 700), (F.col("s") < FAR) & (F.col("o") >= 700), F.col("s") == FAR, F.col("s") == 2 * FAR]
    got, state = streamed(spark, rows, path, files, max_requests=5, window_seconds=60, late="1 minute")
    want = plain(events, 5, 60)
    assert {o: v[2:] for o, v in got.items() if o < 9000} == want
    # the state counts a row for each list of a key; at the end only the event that waits is kept, keys without events in the window are gone
    assert max(state) >= 7 and state[-1] <= 2


def test_stream_hits(spark, events, tmp_path):
    path = str(tmp_path / "in")
    events.drop("s").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(events.drop("s").schema).parquet(path)
    run = admission.window_hits_stream(stream, "k", "ts", 60).writeStream.format("memory").queryName("hits").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("hits").agg(F.sum("hits")).first()[0] == 4 * events.count()
