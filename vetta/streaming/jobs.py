"""Streams: a current file index, paired events, deduplicated findings and bursts of changes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from vetta.operators.records import index_diff
from vetta.plans.tables import written

PAIRS = "agent int, event_id long, ms long"


class Pairing(StatefulProcessor):
    """Pairs each agent's ends with its latest start, as one stream in order of time does, however batches come.

    Events wait in a list until the watermark passes them; one timer, at the earliest of
    them, wakes the agent. What waits is what the watermark's delay lets be open, and a
    batch is read frame by frame. A new start replaces an open one, an end closes it, and a start
    that is older than `hours` when an end comes is forgotten.
    """

    def __init__(self, hours: int):
        self.us = hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at_us long")
        self.waiting = handle.getListState("waiting", "at_us long, event_id long, kind string")
        self.timer = handle.getValueState("timer", "ms long")

    def wake_at(self, ms: int | None) -> None:
        """Have one timer at ms, or none."""
        now = self.timer.get()[0] if self.timer.exists() else None
        if now == ms:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        if ms is None:
            self.timer.clear()
        else:
            self.timer.update((ms,))
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.timer.get()[0] if self.timer.exists() else None
        for frame in rows:
            frame = frame[frame["kind"].isin(["start", "end"])]
            if len(frame):
                self.waiting.appendList(list(zip(frame["at_us"].tolist(), frame["event_id"].tolist(), frame["kind"].tolist())))
                least = int(frame["at_us"].min()) // 1000
                first = least if first is None else min(first, least)
        self.wake_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for event in self.waiting.get():
            (due if event[0] // 1000 <= passed else later).append(tuple(event))
        at = self.open.get()[0] if self.open.exists() else None
        out = []
        for at_us, event_id, kind in sorted(due):
            if kind == "start":
                at = at_us
            elif at is not None:
                if at_us - at <= self.us:
                    out.append((key[0], event_id, (at_us - at) // 1000))
                at = None
        self.open.clear() if at is None else self.open.update((at,))
        self.waiting.put(later) if later else self.waiting.clear()
        self.timer.clear()  # it has just run out
        self.wake_at(min(e[0] for e in later) // 1000 if later else None)
        if out:
            yield pd.DataFrame(out, columns=["agent", "event_id", "ms"])

    def close(self) -> None:
        pass


def pair_events(stream: DataFrame, watermark: str = "1 hour", hours: int = 24) -> DataFrame:
    """(agent, event_id, ms) of a stream (agent, event_id, kind, at_us): ends with the latest start before them, once the watermark has passed them; later events are dropped.

    Rows of another kind only move the watermark on. Needs a state store that keeps lists, such as the RocksDB one.
    """
    timed = stream.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", watermark)
    return timed.groupBy("agent").transformWithStateInPandas(Pairing(hours), PAIRS, "Append", "EventTime")


def dedup_stream(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The first finding of each fingerprint and creator within the watermark; event time in the column at."""
    return stream.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["fingerprint", "created_by"])


def new_against_history(batch: DataFrame, batch_id: int, history: str, run: str, keys: list[str]) -> DataFrame:
    """Adds a batch's first row of each key (by at) that the history table doesn't have, and returns them. The batch's own part is written anew if it comes again."""
    spark = batch.sparkSession
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), "at").alias("r")).select("r.*")
    spark.createDataFrame([], batch.schema).write.mode("ignore").parquet(f"{history}/run=none/batch=-1")
    known = spark.read.schema(StructType([*batch.schema.fields]).add("run", "string").add("batch", "long")).parquet(history)
    known = known.where((F.col("run") != run) | (F.col("batch") < batch_id)).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    path = f"{history}/run={run}/batch={batch_id}"
    first.join(known, same, "left_anti").write.mode("overwrite").parquet(path)
    return spark.read.schema(batch.schema).parquet(path)


def run_name(checkpoint: str) -> str:
    return f"run-{zlib.crc32(checkpoint.encode()):08x}"


def start_dedup_stream(stream: DataFrame, history: str, checkpoint: str, keys: tuple[str, ...] = ("fingerprint", "created_by"), once: bool = False) -> StreamingQuery:
    """Findings that no earlier batch and no earlier run has brought: each batch is joined against the history table and extends it.

    A run is told by its checkpoint. The table is read by its key columns alone.
    """
    run = run_name(checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        new_against_history(batch, batch_id, history, run, list(keys))

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def debounce(stream: DataFrame, key: str, gap: str = "500 milliseconds", watermark: str = "10 seconds") -> DataFrame:
    """Bursts of changes of a key, as sessions with their number of changes."""
    return stream.withWatermark("at", watermark).groupBy(key, F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")


def start_index_stream(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep an index current: the last change of each path in a micro-batch goes to apply(batch, batch_id), which must give the same result if a batch comes again.

    changes: path, at, and what apply needs. A file source never tells of removals; start_merge_stream() finds those by a listing.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), "at").alias("r")).select("r.*")
        apply(latest, batch_id)

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


# --- an index of files' parts that follows a stream of changes ----------------------


def current_index(spark: SparkSession, store: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of an index: of each bucket those that the last batch wrote (the last one before `before`)."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{store}/batch=-1/bucket=-1")
    rows = spark.read.schema(f"{schema}, batch bigint, bucket int").parquet(store)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    # Partition values alone: as many rows as there are buckets in batches.
    last = rows.select("batch", "bucket").distinct().groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), ["bucket", "batch"]).where("path is not null").drop("batch", "bucket")


def merge_batch(batch: DataFrame, batch_id: int, store: str, make: Callable[[DataFrame], DataFrame], schema: str, listing: DataFrame | None = None, buckets: int = 16) -> None:
    """Brings an index up to a batch of changes (path, at, removed, mtime, size, sha256).

    The last change of a path counts. Removed paths, and with a listing (path) those that it
    no longer has, lose their rows; new or changed files get the rows of make(files), whose
    columns are the schema's; files of the same hash keep theirs with the new time and size. Only buckets of
    touched paths are written, as this batch's part, from the parts of earlier batches: a batch that comes
    again writes the same. A bucket that was touched has a row without a path, so that it is known when it is empty.
    """
    spark = batch.sparkSession
    stored = current_index(spark, store, schema, batch_id)
    latest = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), F.struct("at", "removed", "mtime", "size", "sha256")).alias("r")).select("r.*")
    known = stored.select("path", "mtime", "size", "sha256").distinct()
    touched = latest.select("path")
    here = latest.where("not removed")
    if listing is not None:
        touched = touched.union(known.select("path").join(listing.select("path"), "path", "left_anti")).distinct()
        here = here.join(listing.select("path"), "path", "left_semi")
    actions = written(index_diff(known.join(touched, "path", "left_semi"), here.select("path", "mtime", "size", "sha256")), "actions")
    place = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
    opened = written(actions.select(place.alias("bucket")).distinct(), "buckets")  # at most `buckets` rows
    stays = stored.withColumn("bucket", place).join(F.broadcast(opened), "bucket", "left_semi").drop("bucket")
    gone = actions.where(F.col("action").isin("delete", "reindex", "first_index", "touch")).select("path")
    renewed = here.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size")).join(actions.where("action = 'touch'").select("path"), "path", "left_semi")
    moved = stored.join(renewed, "path").withColumn("mtime", F.col("_mtime")).withColumn("size", F.col("_size")).select(*stored.columns)
    fresh = make(here.join(actions.where(F.col("action").isin("reindex", "first_index")).select("path"), "path", "left_semi")).select(*stored.columns)
    rows = stays.join(gone, "path", "left_anti").select(*stored.columns).unionByName(moved).unionByName(fresh).withColumn("bucket", place)
    rows.unionByName(opened, allowMissingColumns=True).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={batch_id}")


def start_merge_stream(changes: DataFrame, store: str, make: Callable[[DataFrame], DataFrame], schema: str, checkpoint: str, listing: Callable[[], DataFrame] | None = None, once: bool = False) -> StreamingQuery:
    """Keeps an index of files' parts current by merge_batch(). listing: asked anew for each batch, as a stream of files never tells of removals."""

    def each(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, store, make, schema, listing() if listing else None)

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()
