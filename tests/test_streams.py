"""The same productions over streams of files, read to their end."""

import time

from pyspark.sql import functions as F

from ruleloom.operators.events import lifo_pairs
from ruleloom.operators.flow import Chart, Trigger, run_chart
from ruleloom.plans.dsl import m, when_all
from ruleloom.sources.messages import Messages
from ruleloom.streaming import stream

SCHEMA = "sid string, mid string, seq long, t string, v long, ts timestamp"


def source(spark, path, n=60):
    df = spark.range(n).select(F.pmod("id", F.lit(3)).cast("string").alias("sid"), F.col("id").cast("string").alias("mid"), F.col("id").alias("seq"), F.element_at(F.array(*map(F.lit, "abca")), (F.pmod(F.hash("id"), F.lit(4)) + 1).cast("int")).alias("t"), F.pmod("id", F.lit(7)).alias("v"), F.timestamp_seconds(F.col("id") * 60 + 86400).alias("ts"))
    df.coalesce(1).write.parquet(str(path / "in"))
    return spark.read.schema(SCHEMA).parquet(str(path / "in")), spark.readStream.schema(SCHEMA).parquet(str(path / "in"))


def drained(df, path, mode="append"):
    out = []
    q = df.writeStream.outputMode(mode).option("checkpointLocation", str(path / f"c{time.time_ns()}")).trigger(availableNow=True).foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(out, key=str)


def test_stateless_and_stateful_rules_agree_with_batch(spark, tmp_path):
    batch, live = source(spark, tmp_path)
    rule = when_all((m.t == "a") & (m.v > 3)).rule
    pick = lambda df: stream.matches_of(rule, Messages(df)).select("sid", "m.mid")
    assert drained(pick(live), tmp_path) == sorted(map(tuple, pick(batch).collect()), key=str)
    want = sorted(map(tuple, lifo_pairs(Messages(batch), m.t == "a", m.t == "b").collect()), key=str)
    assert drained(stream.pairs(Messages(live), m.t == "a", m.t == "b"), tmp_path) == want and want
    chart = Chart("x").state("a", Trigger("b", m.t == "a", name="one")).state("b", Trigger("c", (m.t == "b") & (m.v > 2), name="two"), Trigger("b", m.t == "c", name="stay")).state("c")
    want = sorted(map(tuple, run_chart(Messages(batch), chart, pending=False).select("sid", "nth", "from_state", "to_state", "trigger", "mid").collect()), key=str)
    assert drained(stream.chart(Messages(live), chart), tmp_path) == want and want


def test_windows_duplicates_and_sequences(spark, tmp_path):
    batch, live = source(spark, tmp_path)
    got = drained(stream.velocity(live, "sid", "ts", "10 minutes", "1 minute"), tmp_path)
    assert len(got) == 15 and all(n in (3, 4) for *_, n in got)  # the last window is not over
    twice = live.unionByName(live)
    assert len(drained(stream.first_observed(Messages(twice), "ts", "1 hour").df, tmp_path)) == 60
    pairs = stream.sequence(live.where("t = 'a'"), live.where("t = 'b'"), "sid", "ts", "30 minutes", "1 hour").select("first.mid", "second.mid")
    a, b = batch.where("t = 'a'").alias("a"), batch.where("t = 'b'").alias("b")
    want = a.join(b, F.expr("a.sid = b.sid AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTES")).select("a.mid", "b.mid")
    assert drained(pairs, tmp_path) == sorted(map(tuple, want.collect()), key=str)


def test_timers_fire_by_processing_time(spark, tmp_path):
    spark.createDataFrame([("0", "start", 1), ("1", "start", 2), ("1", "cancel", 3)], "sid string, kind string, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("sid string, kind string, seq long").parquet(str(tmp_path / "in"))
    out = []
    q = stream.deliver(stream.timers(live, 0.5), lambda b, _: out.extend(r.sid for r in b.collect()), str(tmp_path / "c")).trigger(processingTime="1 second").start()
    end = time.time() + 60
    while not out and time.time() < end and q.isActive:
        time.sleep(0.5)
    time.sleep(1)
    q.stop()
    assert out == ["0"]
