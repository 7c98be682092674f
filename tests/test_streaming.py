import datetime as dt

from pyspark.sql import functions as F

from rollbook.operators import lifecycle
from rollbook.streaming import incremental as I


def drained(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_strikes_agree_with_the_batch_fold(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k % 3, ["dead", "live", "dead", "dead", "other"][(k * 7) % 5], t0 + dt.timedelta(minutes=k)) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, s string, t timestamp")
    df.where("minute(t) < 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("minute(t) >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = I.landed(spark, str(tmp_path / "in"), df.schema)
    out = drained(I.strike_counter(stream, "k", "s", "t"), "strikes", "update")
    last = {r.key: (r.strikes, r.deaths, r.outcomes) for r in out.groupBy("key").agg(F.max_by(F.struct("strikes", "deaths", "outcomes"), "outcomes").alias("x")).select("key", "x.*").collect()}
    batch = {str(r.k): (r.strikes, r.deaths, r.outcomes) for r in lifecycle.strike_fold(df, "k", ["t"], F.col("s")).collect()}
    assert last == batch


def test_folding_counts_deaths():
    import itertools

    import numpy as np

    for start in (0, 1):
        for outcomes in itertools.product((True, False), repeat=6):
            strikes, deaths = start, 0
            for dead in outcomes:
                strikes = strikes + 1 if dead else 0
                if strikes >= 2:
                    strikes, deaths = 0, deaths + 1
            assert I.folded(np.array(outcomes), start, 2) == (strikes, deaths)


def test_pending_queue(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    first = spark.createDataFrame([("a", "pending", t0), ("b", "pending", t0), ("c", "clear", t0)], "k string, s string, t timestamp")
    second = spark.createDataFrame([("a", "clear", t0 + dt.timedelta(hours=1)), ("b", "pending", t0 + dt.timedelta(hours=1))], first.schema)
    source = str(tmp_path / "in")
    first.coalesce(1).write.parquet(source)
    again = lambda: I.drained(I.pending_queue(I.landed(spark, source, first.schema), "k", "s", "t"), str(tmp_path / "q"))
    assert sorted((r.key, r.state) for r in again().collect()) == [("a", "waiting"), ("b", "waiting")]
    second.coalesce(1).write.mode("append").parquet(source)
    assert sorted((r.key, r.state, r.since) for r in again().collect()) == [("a", "resolved", t0), ("a", "waiting", t0), ("b", "waiting", t0)]
    spark.createDataFrame([("z", "clear", t0 + dt.timedelta(days=9))], first.schema).coalesce(1).write.mode("append").parquet(source)
    assert ("b", "expired", t0) in [(r.key, r.state, r.since) for r in again().collect()]


def test_a_wait_ends_by_its_own_time_in_whatever_batches_its_rows_come(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", "pending", t0), ("a", "pending", t0 + dt.timedelta(days=6)), ("a", "pending", t0 + dt.timedelta(days=7)), ("a", "clear", t0 + dt.timedelta(days=9)), ("b", "pending", t0), ("b", "clear", t0 + dt.timedelta(days=8))]
    df = spark.createDataFrame(rows, "k string, s string, t timestamp")
    want = [("a", "expired", 0), ("a", "resolved", 7), ("a", "waiting", 0), ("a", "waiting", 7), ("b", "expired", 0), ("b", "waiting", 0)]
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    for n in range(10):
        df.where(F.col("t") == t0 + dt.timedelta(days=n)).coalesce(1).write.mode("append").parquet(str(tmp_path / "many"))
    for source, files in (("one", 1), ("many", 1)):
        out = I.drained(I.pending_queue(I.landed(spark, str(tmp_path / source), df.schema, files), "k", "s", "t"), str(tmp_path / f"q-{source}"))
        assert sorted((r.key, r.state, (r.since - t0).days) for r in out.collect()) == want, source


def test_sessions_and_refresh_on_arrival(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0), (1, t0 + dt.timedelta(minutes=10)), (1, t0 + dt.timedelta(hours=3)), (2, t0)], "k int, t timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = I.landed(spark, str(tmp_path / "in"), df.schema)
    assert sorted((r.k, r.n) for r in drained(I.sessions(stream, "t", "k"), "sessions", "complete").collect()) == [(1, 1), (1, 2), (2, 1)]
    met = []
    I.refresh_on_arrival(stream, str(tmp_path / "checkpoint"), lambda batch, number: met.append(batch.count()))
    I.refresh_on_arrival(stream, str(tmp_path / "checkpoint"), lambda batch, number: met.append(batch.count()))
    assert met == [4]


def test_unseen_and_counts(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0), (1, t0 + dt.timedelta(hours=1)), (2, t0)], "k int, t timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = I.landed(spark, str(tmp_path / "in"), df.schema)
    assert sorted(r.k for r in drained(I.unseen(stream, ["k"], "t"), "unseen", "append").collect()) == [1, 2]
    counts = drained(I.counted(stream, "t", "k"), "counted", "complete").collect()
    assert sorted((r.k, r.n) for r in counts) == [(1, 2), (2, 1)]
