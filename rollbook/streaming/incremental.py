"""Streaming forms: what the batch operators recompute, kept up to date as files land. An addition of this library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

STRIKES = "key string, strikes int, deaths long, outcomes long"
WAITING = "key string, state string, since timestamp"
DAY_MS = 24 * 3600 * 1000


def landed(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unseen(stream: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Each key once; state is dropped when the watermark is late past it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counted(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows by tumbling window and key."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows by session and key."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def folded(dead: np.ndarray, strikes: int, limit: int) -> tuple[int, int]:
    """Strikes and further deaths after outcomes in order (dead or live), from strikes on: counts between successes."""
    island = np.cumsum(~dead)
    failed = np.bincount(island, dead, int(island[-1]) + 1 if len(island) else 1).astype(np.int64)
    failed[0] += strikes
    return int(failed[-1] % limit), int((failed // limit).sum())


def texts(values: list[str]) -> pd.Series:
    """Texts as plain objects, the only kind that every pair of pandas and Arrow versions hands over."""
    return pd.Series(values, dtype=object)


def forget_after(state: GroupState, since: pd.Timestamp, days: int) -> None:
    """Has the state time out so many days after since, by the watermark."""
    state.setTimeoutTimestamp(max(int(since.timestamp() * 1000) + days * DAY_MS, state.getCurrentWatermarkMs() + 1))


def strike_counter(stream: DataFrame, key: str, status: str, time: str, limit: int = 2, idle_days: int = 365, late: str = "1 hour") -> DataFrame:
    """strike_fold over a stream: a row for each key with every batch that has outcomes of it.

    Outcomes of a batch are applied in the order of time; others than live and dead change nothing. The state of a key is
    three numbers, forgotten after idle_days of the stream's own time without an outcome.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        strikes, deaths, n = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(frames), ignore_index=True).sort_values("time", kind="stable")
        seen = rows["status"][rows["status"].isin(("live", "dead"))]
        if len(seen):
            strikes, more = folded((seen == "dead").to_numpy(bool), strikes, limit)
            deaths, n = deaths + more, n + len(seen)
        state.update((strikes, deaths, n))
        forget_after(state, rows["time"].iloc[-1], idle_days)
        yield pd.DataFrame({"key": texts([str(key[0])]), "strikes": [strikes], "deaths": [deaths], "outcomes": [n]})

    named = stream.select(F.col(key).cast("string").alias("key"), F.col(status).alias("status"), F.col(time).alias("time")).withWatermark("time", late)
    return named.groupBy("key").applyInPandasWithState(run, STRIKES, "strikes int, deaths long, outcomes long", "update", GroupStateTimeout.EventTimeTimeout)


def pending_queue(stream: DataFrame, key: str, state: str, time: str, days: int = 7, late: str = "1 hour") -> DataFrame:
    """Keys that begin to wait (state "pending"), those that any other state resolves, and those that expire after days of the stream's own time.

    since is when the wait began. A key that has expired and is pending again begins anew. A wait that has lasted days when
    its key's next row comes has expired, whether or not the watermark said so before: batches of any size give the same.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        since = held.get[0] if held.exists else None
        out = []
        if held.hasTimedOut:
            out, since = [("expired", since)], None
        else:
            rows = pd.concat(list(frames), ignore_index=True).sort_values("time", kind="stable")
            for now, at in zip(rows["state"], rows["time"], strict=True):
                if since is not None and at.to_pydatetime() >= since + pd.Timedelta(days=days):
                    out.append(("expired", since))
                    since = None
                if now == "pending" and since is None:
                    since = at.to_pydatetime()
                    out.append(("waiting", since))
                elif now != "pending" and since is not None:
                    out.append(("resolved", since))
                    since = None
        if since is not None:
            held.update((since,))
            forget_after(held, pd.Timestamp(since), days)
        elif held.exists:
            held.remove()
        yield pd.DataFrame({"key": texts([str(key[0])] * len(out)), "state": texts([s for s, _ in out]), "since": pd.to_datetime([t for _, t in out])})

    named = stream.select(F.col(key).cast("string").alias("key"), F.col(state).alias("state"), F.col(time).alias("time")).withWatermark("time", late)
    return named.groupBy("key").applyInPandasWithState(run, WAITING, "since timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for what has landed, as a table at path; with mode update or complete the batches' rows, numbered
    as __batch, of which the last count."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    else:
        def put(batch: DataFrame, number: int) -> None:
            batch.withColumn("__batch", F.lit(number)).write.mode("append").parquet(f"{path}/out")

        q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def refresh_on_arrival(stream: DataFrame, checkpoint: str, job) -> None:
    """job(batch, batch id) for all that has landed, then the end: a scheduled incremental run."""
    stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
