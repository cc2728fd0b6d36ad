from keyloom.operators.state import recovery_fold
from keyloom.sources import io
from keyloom.sources.catalog import Catalog
from keyloom.streaming import changelog

SF = "/root/testdata/sf0.001"


def drained(df, name, mode, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stream_reaches_the_state_of_the_batch_fold(spark, tmp_path):
    wal = Catalog(spark, SF).wal
    for part in (wal.filter("sequence % 2 = 0"), wal.filter("sequence % 2 = 1")):
        io.append_wal(part.coalesce(1), str(tmp_path / "wal"))
    # In one batch: records of a key must not come after later ones.
    out = drained(changelog.materialise(changelog.read_wal_stream(spark, str(tmp_path / "wal"))), "state", "update", spark)
    live = {r.key: (r.value, r.expire_at_ms) for r in out.collect() if r.live}
    assert live == {r.key: (r.value, r.expire_at_ms) for r in recovery_fold(wal).collect()}


def test_windows_and_counters(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts AS timestamp) AS ts", "event_type", "user_id", "value", "cast(1 AS bigint) AS delta", "event_type AS key")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    total = drained(changelog.counters(stream()), "counters", "complete", spark)
    assert {r.key: r.value for r in total.collect()} == {r.key: r["count"] for r in events.groupBy("key").count().collect()}
    n = drained(changelog.tumbling(stream(), "ts", "1 day", "60 days", "event_type"), "days", "complete", spark).groupBy().sum("n").first()[0]
    assert n == events.count()
    q = changelog.append(stream(), str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_a_restart_goes_on_where_the_last_run_ended(spark, tmp_path):
    wal = Catalog(spark, SF).wal
    read = lambda: changelog.read_wal_stream(spark, str(tmp_path / "wal"))
    for part in (wal.filter("sequence < 500"), wal.filter("sequence >= 500")):
        io.append_wal(part.coalesce(1), str(tmp_path / "wal"))
        q = changelog.append(read(), str(tmp_path / "out"), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == wal.count()


def test_state_of_ended_keys_goes(spark, tmp_path):
    schema = "shard_id int, sequence bigint, timestamp_ms bigint, op string, key string, value double, expire_at_ms bigint"
    day = 86_400_000
    batches = [
        [(0, 1, 5, "Set", "a", 1.0, None), (0, 2, 5, "Set", "b", 2.0, 5_000), (0, 3, 5, "Set", "c", 3.0, None)], [(0, 4, 10, "Del", "a", None, None)],
        [(0, 5, day, "Set", "d", 4.0, None)], [(0, 6, 2 * day, "Set", "d", 5.0, None)],
    ]
    (tmp_path / "wal").mkdir()
    q = changelog.materialise(changelog.read_wal_stream(spark, str(tmp_path / "wal"))).writeStream.format("memory").queryName("ended").outputMode("update").start()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "wal"))
        q.processAllAvailable()
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    last = {}
    for r in spark.table("ended").collect():
        last[r.key] = (r.value, r.live)
    assert last == {"a": (None, False), "b": (2.0, False), "c": (3.0, True), "d": (5.0, True)} and kept == 2
