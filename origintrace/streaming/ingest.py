"""Structured Streaming jobs: idempotent ingest of late scans, the not-found queue, rate limits and sign-in lockout."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..rules import tables as R


def new_scans(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The batch's first scan of each client_uuid that the store does not have. Late scans are as welcome as any."""
    order = Window.partitionBy("client_uuid").orderBy("scanned_at", "scan_id")
    first = batch.where("client_uuid <> ''").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return first if stored is None else first.join(stored.select("client_uuid"), "client_uuid", "left_anti")


STORE_BUCKETS = 256


def ingest(scans: DataFrame, store: str, checkpoint: str, buckets: int = STORE_BUCKETS) -> StreamingQuery:
    """Appends each scan once to the store, whenever and however often it arrives.

    The store is dealt into buckets by the uuid's hash, so a replay is found by its uuid alone, whatever capture time it claims and
    whatever became of the stream's state; of the store, only the uuids of the batch's buckets are read. A scan without a capture
    time is taken to be captured when it arrives. The one write is all that changes the store: a batch that is run again
    finds its own rows and adds none. Rows lie by time inside a bucket, so their files' statistics prune dates.
    """
    spark = scans.sparkSession

    def write(batch: DataFrame, _epoch: int) -> None:
        batch = bucketed(batch, buckets).persist()
        fresh = new_scans(batch, _stored(spark, store, batch))
        fresh.repartition("uuid_bucket").sortWithinPartitions("uuid_bucket", "scanned_at").write.mode("append").partitionBy("uuid_bucket").parquet(store)
        batch.unpersist()

    return scans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucketed(batch: DataFrame, buckets: int = STORE_BUCKETS) -> DataFrame:
    """The named scans of a batch with time of arrival, capture time, and their bucket of the store."""
    arrived = batch.where("client_uuid <> ''").withColumn("synced_at", F.current_timestamp())
    return arrived.withColumn("scanned_at", F.coalesce("scanned_at", "synced_at")).withColumn("uuid_bucket", F.pmod(F.xxhash64("client_uuid"), F.lit(buckets)).cast("int"))


def _stored(spark: SparkSession, store: str, batch: DataFrame) -> DataFrame | None:
    """The store's uuids of the batch's buckets; None if nothing is stored yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    asked = [r[0] for r in batch.select("uuid_bucket").distinct().collect()]  # as many as there are buckets, at most
    return spark.read.schema("client_uuid string, uuid_bucket int").parquet(store).where(F.col("uuid_bucket").isin(asked)).select("client_uuid")


def queued_uploads(spark: SparkSession, folder: str, schema: str, files_each: int = 100) -> DataFrame:
    """A device's queue of JSON files as a stream, so many files a batch; with availableNow it is emptied in batches and stops."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(folder)


def queue_hits(results: DataFrame) -> DataFrame:
    """One row a batch and marking without a component: what the queue's table is appended with."""
    lost = results.where("result = 'not_found'")
    return lost.groupBy("normalized_input").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("scanned_at", "raw_input")).alias("first"))


def queue(hits: DataFrame) -> DataFrame:
    """The open queue: the appended rows added up."""
    return hits.groupBy("normalized_input").agg(F.sum("hits").alias("hit_count"), F.min("first").alias("f")).select("normalized_input", "hit_count", F.col("f.raw_input").alias("raw_input"), F.col("f.scanned_at").alias("created_at"))


def admit(times: list[float], log: deque, limit: int, window: float) -> list[bool]:
    """Sliding-log admission: a request is let in if fewer than limit were let in within the last `window` seconds."""
    out = []
    for t in times:
        while log and t - log[0] > window:
            log.popleft()
        ok = len(log) < limit
        if ok:
            log.append(t)
        out.append(ok)
    return out


def rate_limited(events: DataFrame, client: str, at: str, tie: str, limit: int = R.RATE_LIMIT, window: float = R.RATE_WINDOW_SECONDS) -> DataFrame:
    """events with admitted. Each task walks its clients in time order with a log of at most `limit` times, so a client with many
    events takes no more memory than another."""
    ordered = events.withColumn("_t", F.col(at).cast("double")).repartition(client).sortWithinPartitions(client, "_t", tie)

    def walk(frames):
        name, log = None, deque()
        for pdf in frames:
            out = []
            for c, t in zip(pdf[client], pdf["_t"], strict=True):
                if c != name:
                    name, log = c, deque()
                out += admit([t], log, limit, window)
            yield pdf.drop(columns="_t").assign(admitted=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", admitted boolean"
    return ordered.mapInPandas(walk, schema)


def _in_order(frames, *columns: str) -> pd.DataFrame:
    """A key's rows of one micro-batch by time and event, from however many Arrow batches they come in; the source's limits of a
    micro-batch bound them."""
    held = [pdf[["t", "event_id", *columns]] for pdf in frames]
    return pd.concat(held).sort_values(["t", "event_id"]) if held else pd.DataFrame({c: [] for c in ("t", "event_id", *columns)})


def rate_limit_stream(events: DataFrame, limit: int = R.RATE_LIMIT, window: float = R.RATE_WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """A stream (client, event_id, at) with admitted; a client's log of admitted times is its state, and goes once the watermark
    (`late` behind the newest event) has passed the window of its last one. Events later than that are not judged."""

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0]) if state.exists else deque()
        pdf = _in_order(frames)
        yield pd.DataFrame({"client": key[0], "event_id": pdf["event_id"], "admitted": admit(pdf["t"].tolist(), log, limit, window)})
        state.update((list(log),))
        state.setTimeoutTimestamp(max(int(1000 * (max(log, default=0.0) + window)), state.getCurrentWatermarkMs()) + 1)

    timed = events.withWatermark("at", late).withColumn("t", F.col("at").cast("double"))
    return timed.groupBy("client").applyInPandasWithState(step, "client string, event_id long, admitted boolean", "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def lock_steps(tries: list[tuple[float, bool]], state: tuple[int, float], after: int, seconds: float) -> tuple[list[str], tuple[int, float]]:
    """Outcome of each try (time, right password): locked while the lock holds, else ok (which clears the count) or failed (the
    after-th in a row locks for so many seconds)."""
    failed, until = state
    out = []
    for t, right in tries:
        if t < until:
            out.append("locked")
        elif right:
            failed, until = 0, 0.0
            out.append("ok")
        else:
            failed += 1
            until = t + seconds if failed >= after else until
            out.append("failed")
    return out, (failed, until)


def lockout(tries: DataFrame, user: str, at: str, right: str, tie: str, after: int = R.LOCK_AFTER, minutes: float = R.LOCK_MINUTES) -> DataFrame:
    """tries with outcome (ok, failed, locked), each user's in time order, with constant state a user."""
    ordered = tries.withColumn("_t", F.col(at).cast("double")).repartition(user).sortWithinPartitions(user, "_t", tie)

    def walk(frames):
        name, state = None, (0, 0.0)
        for pdf in frames:
            out = []
            for u, t, ok in zip(pdf[user], pdf["_t"], pdf[right], strict=True):
                if u != name:
                    name, state = u, (0, 0.0)
                one, state = lock_steps([(t, bool(ok))], state, after, minutes * 60)
                out += one
            yield pdf.drop(columns="_t").assign(outcome=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tries.schema.fields) + ", outcome string"
    return ordered.mapInPandas(walk, schema)


def lockout_stream(tries: DataFrame, after: int = R.LOCK_AFTER, minutes: float = R.LOCK_MINUTES, forget_days: float | None = None, late: str = "10 minutes") -> DataFrame:
    """A stream (user, event_id, at, ok) with outcome; state: failures so far and the lock's end. Only users with failures have
    state: a right password clears the count, and what is left is what a new user has. Failures are never forgotten otherwise,
    unless forget_days is given: then a user's state goes when none of theirs has come for so long (and later tries than `late`
    are not judged)."""

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else (0, 0.0)
        pdf = _in_order(frames, "ok")
        out, held = lock_steps(list(zip(pdf["t"].tolist(), pdf["ok"].astype(bool), strict=True)), held, after, minutes * 60)
        yield pd.DataFrame({"user": key[0], "event_id": pdf["event_id"], "outcome": out})
        if held[0] or held[1]:
            state.update(held)
            if forget_days is not None:
                state.setTimeoutTimestamp(max(int(1000 * (pdf["t"].max() + 86400 * forget_days)), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()

    timed = tries.withColumn("t", F.col("at").cast("double")) if forget_days is None else tries.withWatermark("at", late).withColumn("t", F.col("at").cast("double"))
    timeout = GroupStateTimeout.NoTimeout if forget_days is None else GroupStateTimeout.EventTimeTimeout
    return timed.groupBy("user").applyInPandasWithState(step, "user string, event_id long, outcome string", "failed long, until double", "append", timeout)


def audited(results: DataFrame) -> DataFrame:
    """The branch of results that the log records: restricted and unknown ones."""
    return results.where("result IN ('chinese', 'unknown_origin')").select(F.lit("scan.flagged").alias("action"), "scan_id", "result", "scanned_at")


def retained(events: DataFrame, by: str, at: str, n: int) -> DataFrame:
    """The newest n rows a key: bounded lists of notices, history, imports, devices."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at)))).where(F.col("_n") <= n).drop("_n")


def first_unknowns(results: DataFrame) -> DataFrame:
    """A notice for the first time a marking is not found."""
    return results.where("result = 'not_found'").groupBy("normalized_input").agg(F.min_by(F.struct("scan_id", "scanned_at"), F.struct("scanned_at", "scan_id")).alias("f")).select("normalized_input", "f.*")
