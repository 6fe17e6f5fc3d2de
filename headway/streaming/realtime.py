"""Incremental twins of the consolidation operators. State is keyed and holds a value or two; the checkpoint survives restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _frame(rows: list, names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


def change_dedup(rows: DataFrame, key: tuple[str, ...], order: str, value: str, keep_hours: int = 48) -> DataFrame:
    """Streaming change-dedup: a key's first row and those whose value differs from the one before. Output: key, order, value (longs or strings as given).

    Within a micro-batch rows are taken in order; batches are taken as they come. order: epoch seconds. What is known of a
    key is forgotten once the stream is keep_hours past its last row, as keys hold a service date; rows that come later than
    that are left out.
    """
    kinds = dict(rows.dtypes)
    names, keep_ms = [*key, order, value], keep_hours * 3_600_000
    schema = ", ".join(f"{c} {kinds[c]}" for c in names)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values([order, value])
        seen, last = (True, state.get[0]) if state.exists else (False, None)
        out = []
        for o, v in zip(pdf[order].tolist(), pdf[value].tolist()):
            if not seen or v != last:
                out.append((*k, o, v))
            seen, last = True, v
        state.update((last,))
        state.setTimeoutTimestamp(max(int(pdf[order].max()) * 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield _frame(out, names)

    timed = rows.select(*names, F.timestamp_seconds(order).alias("_at")).withWatermark("_at", f"{keep_hours} hours")
    return timed.groupBy(*key).applyInPandasWithState(step, schema, f"last {kinds[value]}", "append", GroupStateTimeout.EventTimeTimeout)


def gaps(successes: DataFrame, key: str, instant: str, threshold_s: int) -> DataFrame:
    """Streaming gaps: (key, gap_start, gap_end, gap_s) once the success that ends a gap arrives."""
    kind = dict(successes.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(x for b in batches for x in b[instant].tolist()):
            if last is not None and t - last >= threshold_s:
                out.append((*k, last, t, t - last))
            last = t
        state.update((last,))
        yield _frame(out, [key, "gap_start", "gap_end", "gap_s"])

    return successes.select(key, instant).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, gap_start long, gap_end long, gap_s long", "last long", "append", GroupStateTimeout.NoTimeout)


class _Silence(StatefulProcessor):
    """A key's last success, and a timer that runs out when none has come for a while."""

    def __init__(self, names: list[str], instant: str, threshold_s: int):
        self.names, self.instant, self.threshold_s = names, instant, threshold_s

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        t = np.sort(np.concatenate([pdf[self.instant].to_numpy(np.int64) for pdf in rows]))
        if self.last.exists():
            last = self.last.get()[0]
            t = np.append(last, t[t > last])  # what is older than the last success ends no gap
        wide = np.flatnonzero(np.diff(t) >= self.threshold_s)
        self.last.update((int(t[-1]),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.threshold_s)
        yield self._rows(key, t[wide], t[wide + 1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._rows(key, [self.last.get()[0]], [None])

    def _rows(self, key, starts, ends) -> pd.DataFrame:
        out = pd.DataFrame({name: pd.Series([k] * len(starts), dtype=object) for name, k in zip(self.names, key)})
        out["gap_start"] = pd.array([int(x) for x in starts], "Int64")
        out["gap_end"] = pd.array([None if x is None else int(x) for x in ends], "Int64")
        out["gap_s"] = out["gap_end"] - out["gap_start"]
        return out

    def close(self) -> None:
        pass


def gap_alarms(successes: DataFrame, keys: tuple[str, ...], instant: str, threshold_s: int) -> DataFrame:
    """Streaming gaps that don't wait for their end: (keys, gap_start, gap_end, gap_s), with a null end and length while a gap is open.

    A key that has no success for threshold_s seconds of the clock is reported once as open, by a timer, so without any
    further input; when a success comes after all, the gap is reported with its end. Timers and last successes are in the
    stream's state and go on after a restart. With a day among the keys a city's days are told apart, and its nights too.
    """
    kinds = dict(successes.dtypes)
    successes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "gap_start bigint", "gap_end bigint", "gap_s bigint"])
    rows = successes.select(*keys, instant)
    return rows.groupBy(*keys).transformWithStateInPandas(_Silence(list(keys), instant, threshold_s), schema, "append", "ProcessingTime")


def snapshot_dedup(polls: DataFrame, key: str, instant: str, feed_ts: str) -> DataFrame:
    """Streaming dedup of snapshots against the last saved feed timestamp; 0 and null are always saved and change nothing."""
    kind = dict(polls.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t, ts in sorted((t, ts) for b in batches for t, ts in zip(b[instant].tolist(), b[feed_ts].fillna(0).astype("int64").tolist())):
            if ts == 0 or ts != last:
                out.append((*k, t, ts))
                last = ts or last
        state.update((last,))
        yield _frame(out, [key, instant, feed_ts])

    return polls.select(key, instant, feed_ts).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {instant} long, {feed_ts} long", "last long", "append", GroupStateTimeout.NoTimeout)


def poll_summary(polls: DataFrame, ts: str, key: str, watermark: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling counts by outcome; a window is emitted once the watermark has passed it."""
    n = lambda o: F.sum(F.when(F.col("outcome") == o, 1).otherwise(0)).alias(o)
    return polls.withWatermark(ts, watermark).groupBy(F.window(ts, width), key).agg(n("saved"), n("duplicate"), n("failed"), F.count("*").alias("polls"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now into a Parquet folder, and waits for it."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def isolated(batch_jobs: dict[str, object]):
    """A foreachBatch function that runs each job on the batch; one that fails doesn't keep the others from running, and the first error is raised at the end."""

    def run(df: DataFrame, epoch: int) -> None:
        errors = []
        for name, job in batch_jobs.items():
            try:
                job(df, epoch)
            except Exception as e:  # noqa: BLE001
                errors.append((name, e))
        if errors:
            raise RuntimeError(f"failed: {', '.join(n for n, _ in errors)}") from errors[0][1]

    return run


#: What a check of a schedule's version can give.
VERSION_CHECKS = "batch bigint, city string, instant bigint, md5 string, outcome string, file string, attempts int"


def version_checks(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """All checks so far (VERSION_CHECKS); those of earlier batches only, if asked."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], VERSION_CHECKS)
    rows = spark.read.schema(VERSION_CHECKS).parquet(path)
    return rows if before is None else rows.filter(F.col("batch") < before)


def version_job(path: str, fetch: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that checks the schedule versions of the ticks (city, instant) of a batch and keeps what it finds below `path`.

    fetch adds md5 (null: failed) to rows of (city, instant, attempts). A check is `unchanged` if the city's last one that
    didn't fail had the same md5, `known` if an earlier one had it (its file is used again), `new` otherwise, and `failed`
    without md5. What failed in the batch before is asked again with the next one, with one attempt more. A batch writes a
    partition of its own and reads those of earlier batches only, so one that is run again replaces what it wrote and
    changes nothing else.
    """

    def run(ticks: DataFrame, batch: int) -> None:
        spark = ticks.sparkSession
        past = version_checks(spark, path, batch)
        again = past.filter((F.col("batch") == batch - 1) & (F.col("outcome") == "failed")).select("city", "instant", (F.col("attempts") + 1).alias("attempts"))
        asked = ticks.select("city", F.col("instant").cast("long").alias("instant"), F.lit(1).alias("attempts")).unionByName(again)
        found = fetch(asked.groupBy("city", "instant").agg(F.max("attempts").alias("attempts"))).select("city", "instant", "md5", "attempts").withColumn("batch", F.lit(batch).cast("long"))
        # of what came before a city's last md5 and the first check of each md5 are enough
        good = past.filter("md5 IS NOT NULL")
        last = good.groupBy("city").agg(F.max(F.struct("instant", "md5")).alias("m")).select("city", "m.instant", "m.md5")
        firsts = good.groupBy("city", "md5").agg(F.min("instant").alias("instant"))
        known = last.unionByName(firsts).distinct().withColumn("batch", F.lit(None).cast("long")).withColumn("attempts", F.lit(None).cast("int"))
        order = Window.partitionBy("city").orderBy("instant", F.col("batch").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
        same = Window.partitionBy("city", "md5").orderBy("instant", F.col("batch").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
        rows = known.unionByName(found).withColumn("before", F.last("md5", ignorenulls=True).over(order)).withColumn("seen", F.count("*").over(same))
        outcome = F.when(F.col("md5").isNull(), "failed").when(F.col("md5") == F.col("before"), "unchanged").when(F.col("seen") > 0, "known").otherwise("new")
        file = F.when(F.col("md5").isNotNull(), F.concat_ws("/", "city", F.concat("md5", F.lit(".zip"))))
        rows = rows.withColumn("outcome", outcome).withColumn("file", file).filter("batch IS NOT NULL")
        rows.select("city", "instant", "md5", "outcome", "file", F.col("attempts").cast("int").alias("attempts")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return run
