"""Breaker and bucket streams against the folds over the same calls, cut into batches; timers."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import limits
from tessera.streaming import rates

CALL = "provider string, o long, at double, ok boolean"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rates.STORE)
    yield spark
    spark.conf.set(name, before) if before else spark.conf.unset(name)


class Feed:
    """A folder that a stream reads, a file a batch; every run goes on where the last one ended."""

    def __init__(self, spark, folder, name, make):
        self.spark, self.folder, self.name, self.make, self.rows = spark, folder, name, make, []

    def give(self, calls):
        self.spark.createDataFrame(calls, CALL).coalesce(1).write.mode("append").json(f"{self.folder}/in")
        stream = self.make(self.spark.readStream.schema(CALL).option("maxFilesPerTrigger", 1).json(f"{self.folder}/in"))
        keep = lambda frame, batch: self.rows.extend((batch, *r) for r in frame.collect())
        stream.writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", f"{self.folder}/mark").start().awaitTermination()


def of_events(spark, small):
    """Users' events of which few fail, each user's in order, cut in four by time."""
    rows = spark.read.parquet(f"{small}/events.parquet").where("user_id < 12").select(F.col("user_id").cast("string").alias("provider"), F.col("event_id").alias("o"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), (F.col("event_type") != "error").alias("ok"))
    data = sorted(map(tuple, rows.collect()), key=lambda r: (r[2], r[1]))
    size = -(-len(data) // 4)
    return rows, [data[k : k + size] for k in range(0, len(data), size)]


def test_breakers_over_batches_and_restarts(rocks, small, tmp_path):
    rows, batches = of_events(rocks, small)
    feed = Feed(rocks, tmp_path, "breakers", lambda calls: rates.breaker_stream(calls, 2, 90_000.0, "o"))
    for batch in batches:
        feed.give(batch)
    last, rejected = {}, {}
    for _, provider, state, failures, n in sorted(feed.rows, key=lambda r: r[0]):
        last[provider] = ("OPEN" if state == "HALF_OPEN" else state, failures)
        rejected[provider] = rejected.get(provider, 0) + n
    want = limits.breaker_states(rows, "provider", "at", "o", 2, 90_000.0).collect()
    assert {r.provider: (r.state, r.failures, r.rejected) for r in want} == {p: (*last[p], rejected[p]) for p in last}
    assert any(r.rejected for r in want)


def test_an_open_breaker_turns_half_open_without_a_call(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, "half", lambda calls: rates.breaker_stream(calls, 2, 30.0, "o"))
    feed.give([("p", 0, 100.0, False), ("p", 1, 101.0, False), ("p", 2, 102.0, True)])
    assert {r[1:] for r in feed.rows} == {("p", "OPEN", 2, 1)}
    feed.give([("q", 3, 140.0, True)])
    feed.give([("q", 4, 141.0, True)])
    assert ("p", "HALF_OPEN", 2, 0) in {r[1:] for r in feed.rows}
    del feed.rows[:]
    feed.give([("p", 5, 150.0, False), ("p", 6, 151.0, True)])
    assert ("p", "OPEN", 3, 1) in {r[1:] for r in feed.rows}
    feed.give([("p", 7, 190.0, True)])
    assert feed.rows[-1][1:] == ("p", "CLOSED", 0, 0)


def test_buckets_over_batches_and_idle_ones(rocks, small, tmp_path):
    rows, batches = of_events(rocks, small)
    feed = Feed(rocks, tmp_path, "buckets", lambda calls: rates.bucket_stream(calls, 0.0001, 2.0, "o"))
    for batch in batches:
        feed.give(batch)
    total = {}
    for _, provider, delayed, waited, _ in feed.rows:
        a, b = total.get(provider, (0, 0.0))
        total[provider] = (a + delayed, b + waited)
    want = limits.bucket_waits(rows, "provider", "at", "o", 0.0001, 2.0).collect()
    assert {r.provider: (r.delayed, r.waited) for r in want} == {p: (a, pytest.approx(b, abs=2e-3)) for p, (a, b) in total.items()}
    assert any(r.delayed for r in want) and any(tokens == 2.0 for *_, tokens in feed.rows)


def test_the_store_must_keep_timers(spark, rows):
    with pytest.raises(ValueError, match="RocksDB"):
        rates.bucket_stream(rows([], CALL), 1.0, 1.0)
