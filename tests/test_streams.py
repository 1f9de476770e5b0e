"""The streaming jobs on small files: ingest with replays, limits, lockouts, and a queue that is emptied in batches."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from origintrace.streaming import ingest

T = datetime.datetime(2024, 1, 5, 12, 0, 0)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State in two stores a batch; everything else as Spark has it, batches without data too."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def write(folder, name, rows):
    """A file that is newer than those written before, as a stream takes files by age."""
    folder.mkdir(exist_ok=True)
    age = 1_700_000_000 + 10 * len(list(folder.iterdir()))
    (folder / name).write_text("\n".join(json.dumps(r, default=str) for r in rows))
    os.utime(folder / name, (age, age))


def scan(i, uuid, day=0):
    return {"scan_id": i, "client_uuid": uuid, "scanned_at": str(T + datetime.timedelta(days=day, seconds=i))}


def test_ingest_stores_each_scan_once(spark, tmp_path):
    queue, store, state = tmp_path / "queue", str(tmp_path / "store"), str(tmp_path / "state")
    schema = "scan_id long, client_uuid string, scanned_at timestamp"
    run = lambda where=state: ingest.ingest(ingest.queued_uploads(spark, str(queue), schema, 1), store, where, 8).awaitTermination()
    write(queue, "a.json", [scan(1, "a"), scan(2, "b"), scan(1, "a"), scan(9, ""), {"scan_id": 8, "client_uuid": None, "scanned_at": str(T)}])
    write(queue, "b.json", [scan(3, "c", -40), scan(2, "b"), {"scan_id": 5, "client_uuid": "n", "scanned_at": None}])  # captured long before, a replay, and no time
    run()
    write(queue, "c.json", [scan(3, "c", -40), scan(4, "d", -400), scan(1, "a"), {"scan_id": 6, "client_uuid": "n", "scanned_at": None}])
    run()
    stored = spark.read.parquet(store)
    assert sorted(r.scan_id for r in stored.collect()) == [1, 2, 3, 4, 5] and stored.where("scanned_at is null").count() == 0
    write(queue, "d.json", [scan(1, "a", 3), scan(5, "n", 2)])  # replays that claim other days
    run(str(tmp_path / "other-state"))  # state lost: the store still knows all of them
    assert sorted(r.scan_id for r in spark.read.parquet(store).collect()) == [1, 2, 3, 4, 5]


def test_store_is_pruned_by_bucket(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = ingest.bucketed(spark.createDataFrame([(str(i), T) for i in range(20)], "client_uuid string, scanned_at timestamp"), 64)
    assert ingest._stored(spark, store, rows) is None
    rows.write.partitionBy("uuid_bucket").parquet(store)
    known = ingest._stored(spark, store, rows.where("client_uuid = '3'"))
    assert "3" in [r.client_uuid for r in known.collect()] and known.count() < 6
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "uuid_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "ReadSchema: struct<client_uuid:string>" in plan


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def finished(df, tmp_path, name):
    """The stream's rows and the rows of state that it ends with; it has to end by itself."""
    out = str(tmp_path / name)
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return df.sparkSession.read.parquet(out).collect(), query.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.fixture
def tiny_batches(spark):
    """A client's rows come in several Arrow batches."""
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_rate_limit_stream_keeps_its_log_and_lets_it_go(spark, tmp_path, tiny_batches):
    rows = [{"client": c, "event_id": 100 * k + i, "at": str(T + datetime.timedelta(seconds=20 * i + 3 * k))} for k, c in enumerate(("x", "y")) for i in range(9)]
    rows.append({"client": "z", "event_id": 999, "at": str(T + datetime.timedelta(hours=1))})
    for n in range(2):
        mine = [r for r in rows if (r["event_id"] % 100 // 5 > 0) == (n == 1)]
        write(tmp_path / "q", f"{n}.json", mine[::-1])  # not in order inside a file
    got, state = finished(ingest.rate_limit_stream(stream(spark, tmp_path / "q", "client string, event_id long, at timestamp"), limit=2, window=60.0), tmp_path, "limited")
    whole = spark.createDataFrame([(r["client"], r["event_id"], datetime.datetime.fromisoformat(r["at"])) for r in rows], "client string, event_id long, at timestamp")
    want = {r.event_id: r.admitted for r in ingest.rate_limited(whole, "client", "at", "event_id", limit=2, window=60.0).collect()}
    assert {r.event_id: r.admitted for r in got} == want and set(want.values()) == {True, False}
    assert state == 1  # only the client of the last hour has a log left


def test_lockout_stream_remembers_failures(spark, tmp_path, tiny_batches):
    tries = [(u, 10 * k + i, T + datetime.timedelta(minutes=i), u == "b" and i == 3) for k, u in enumerate(("a", "b")) for i in range(8)]
    for n in range(2):
        write(tmp_path / "q", f"{n}.json", [{"user": u, "event_id": e, "at": str(t), "ok": ok} for u, e, t, ok in tries[::-1] if e % 10 // 4 == n])
    source = lambda: stream(spark, tmp_path / "q", "user string, event_id long, at timestamp, ok boolean")
    got, state = finished(ingest.lockout_stream(source(), after=5, minutes=15), tmp_path, "locked")
    whole = spark.createDataFrame(tries, "user string, event_id long, at timestamp, ok boolean")
    want = {r.event_id: r.outcome for r in ingest.lockout(whole, "user", "at", "ok", "event_id", after=5, minutes=15).collect()}
    assert {r.event_id: r.outcome for r in got} == want and set(want.values()) == {"failed", "ok", "locked"} and state == 2
    write(tmp_path / "q", "9.json", [{"user": "c", "event_id": 99, "at": str(T + datetime.timedelta(days=40)), "ok": False}])
    got, state = finished(ingest.lockout_stream(source(), after=5, minutes=15, forget_days=30), tmp_path, "forgotten")
    assert len(got) == 17 and state == 1
