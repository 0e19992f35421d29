"""Event-time folds: the stream gives the rows of the table, with unordered and late rows, deadlines, and a writer that is killed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import folds, stateful

NEWS = "user_id long, event_id long, ts timestamp, kind string, task long, attempt long, text boolean"


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


def times(rows, schema, spark):
    return spark.createDataFrame(rows, schema.replace("ts timestamp", "ts double")).withColumn("ts", F.timestamp_seconds(F.col("ts") + 1000))


def plain(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def test_jobs_by_the_rules(spark):
    told = [
        ("enqueue", 1, 0, False), ("enqueue", 2, 0, False), ("enqueue", 1, 0, False), ("claim", 0, 0, False), ("claim", 0, 0, False), ("beat", 1, 1, False), ("finish", 2, 1, True),
        ("finish", 1, 2, True), ("fail", 1, 1, False), ("enqueue", 1, 0, False), ("claim", 0, 0, False), ("cancel", 2, 0, False), ("beat", 2, 1, False), ("claim", 0, 0, False), ("finish", 1, 2, False),
        ("enqueue", 1, 0, False), ("claim", 0, 0, False), ("finish", 1, 3, True), ("enqueue", 1, 0, False), ("enqueue", 2, 0, False),
    ]
    rows = times([(7, i, float(i), *t) for i, t in enumerate(told)], NEWS, spark)
    out = stateful.over_table(rows, "user_id", "ts", ["event_id"], stateful.Jobs(60_000)).collect()
    assert [(r.event_id, r.action, r.task, r.attempt, r.parts) for r in sorted(out, key=lambda r: r.event_id)] == [
        (0, "queued", 1, 0, 0), (1, "queued", 2, 0, 0), (3, "claimed", 1, 1, 0), (5, "heard", 1, 1, 1), (8, "failed", 1, 1, 1), (9, "queued", 1, 1, 1), (10, "claimed", 2, 1, 0),
        (11, "cancelled", 2, 1, 0), (13, "claimed", 1, 2, 1), (14, "completed", 1, 2, 1), (15, "queued", 1, 2, 0), (16, "claimed", 1, 3, 0), (17, "completed", 1, 3, 0), (19, "queued", 2, 1, 0),
    ]


def test_a_lost_claim_runs_out(spark):
    told = [(0.0, "enqueue", 1, 0), (1.0, "claim", 0, 0), (5.0, "beat", 1, 1), (15.0, "claim", 0, 0), (16.0, "finish", 1, 1), (17.0, "finish", 1, 2)]
    rows = times([(1, i, t, k, j, a, True) for i, (t, k, j, a) in enumerate(told)], NEWS, spark)
    out = [(r.event_id, r.action, r.attempt) for r in stateful.over_table(rows, "user_id", "ts", ["event_id"], stateful.Jobs(10_000)).collect()]
    assert out == [(0, "queued", 0), (1, "claimed", 1), (2, "heard", 1), (None, "expired", 1), (3, "claimed", 2), (5, "completed", 2)]
    still = times([(1, 0, 0.0, "enqueue", 1, 0, True), (1, 1, 1.0, "claim", 0, 0, True)], NEWS, spark)
    ends = lambda until: [r.action for r in stateful.over_table(still, "user_id", "ts", ["event_id"], stateful.Jobs(10_000), until).collect()]
    assert ends(None) == ends(1_010_999) == ["queued", "claimed"] and ends(1_011_000) == ["queued", "claimed", "expired"]


def test_appends_by_the_rules(spark):
    told = [
        ("append", 1, 5, "s"), ("restart", 0, 9, "s"), ("restart", 0, None, "s"), ("append", 2, 5, "s"), ("append", 1, 5, "s"), ("append", 2, 7, "s"), ("append", 3, 0, "s"), ("restart", 0, 12, "other"),
        ("restart", 0, 4, "s"), ("restart", 0, None, "s"), ("append", 3, 1, "s"), ("restart", 0, 13, "s"), ("restart", 0, 5, "s"), ("append", 2, 8, "s"), ("append", 3, 1, "s"), ("append", 4, 1, "s"), ("restart", 0, 14, "s"),
    ]
    schema = "user_id long, event_id long, ts timestamp, kind string, fragment long, size long, identity string"
    rows = times([(3, i, float(i), *t) for i, t in enumerate(told)], schema, spark)
    out = stateful.over_table(rows, "user_id", "ts", ["event_id"], stateful.Appends(3)).collect()
    assert [(r.result, r.fragment, r.start, r.stop) for r in out] == [
        ("refused", None, None, None), ("no_checkpoint", None, None, None), ("prepared", 0, 0, 0), ("refused", None, None, None), ("appended", 1, 0, 5), ("appended", 2, 5, 12), ("refused", None, None, None), ("other_session", None, None, None),
        ("shorter", None, None, None), ("shorter", None, None, None), ("appended", 3, 12, 13), ("prepared", 2, 12, 12), ("shorter", None, None, None), ("refused", None, None, None), ("appended", 3, 12, 13), ("refused", None, None, None), ("prepared", 2, 12, 12),
    ]


def news(seed, n=240):
    rng = random.Random(seed)
    kinds = ["enqueue", "enqueue", "claim", "claim", "beat", "finish", "fail", "cancel"]
    return [(rng.randrange(3), i, 10.0 * i + rng.randrange(5), rng.choice(kinds), rng.randrange(1, 4), rng.randrange(0, 4), rng.random() < 0.5) for i in range(n)]


def test_stream_equals_table_with_unordered_and_late_rows(spark, rocksdb, tmp_path):
    rows = news(4)
    # batches by position, neighbours swapped across their borders; one row comes long after its time
    order = list(range(len(rows)))
    for border in range(40, 240, 40):
        order[border - 1], order[border] = order[border], order[border - 1]
    late = order.pop(17)
    for k in range(6):
        part = order[k * 40 : k * 40 + 40] + ([late] if k == 5 else [])
        times([rows[i] for i in part], NEWS, spark).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    close = [(k, 10_000 + k, 10_000.0, "none", 1, 0, False) for k in range(3)]
    times(close, NEWS, spark).coalesce(1).write.parquet(f"{tmp_path}/in/7")
    times([(9, 20_000, 10_001.0, "none", 1, 0, False)], NEWS, spark).coalesce(1).write.parquet(f"{tmp_path}/in/8")
    stream = spark.readStream.schema(times(close, NEWS, spark).schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stateful.over_stream(stream, "user_id", "ts", ["event_id"], stateful.Jobs(60_000), "20 seconds")
    stateful.append_batches(out, f"{tmp_path}/out", f"{tmp_path}/point").awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").select(out.columns).collect()
    kept = [r for i, r in enumerate(rows) if i != late]
    want = stateful.over_table(times(kept, NEWS, spark), "user_id", "ts", ["event_id"], stateful.Jobs(60_000), 10_980_000).select(out.columns).collect()
    assert plain(got) == plain(want) and any(r.action == "expired" for r in got)


def test_killed_between_append_and_commit(spark, rocksdb, tmp_path):
    rng = random.Random(9)
    schema = "user_id long, event_id long, ts timestamp, kind string, fragment long, size long, identity string"
    rows, at = [], [0, 0]
    for i in range(120):
        u = rng.randrange(2)
        restart = at[u] == 0 or rng.random() < 0.1
        at[u] = max(1, at[u] - 1) if restart else at[u] + 1
        rows.append((u, i, float(i), "restart" if restart else "append", at[u] - 1, None if i < 2 else 10**6, "s"))
    for k in range(4):
        times(rows[k * 30 : k * 30 + 30], schema, spark).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    times([(5, 999, 1000.0, "restart", 0, None, "s")], schema, spark).coalesce(1).write.parquet(f"{tmp_path}/in/5")
    shape = times(rows[:1], schema, spark).schema

    def run(name, after=None):
        stream = spark.readStream.schema(shape).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = stateful.over_stream(stream, "user_id", "ts", ["event_id"], stateful.Appends(1000), "0 seconds")
        stateful.append_batches(out, f"{tmp_path}/{name}", f"{tmp_path}/{name}-point", after).awaitTermination()
        return plain(spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}").where("user_id < 5").select(out.columns).collect())

    killed = []

    def kill(batch):
        if batch in (1, 3) and batch not in killed:
            killed.append(batch)
            raise RuntimeError("killed after the rows were written")

    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run("broken", kill)
    assert run("broken", kill) == run("whole") and killed == [1, 3]
    table = stateful.over_table(times(rows, schema, spark), "user_id", "ts", ["event_id"], stateful.Appends(1000))
    assert run("whole") == plain(table.collect())


def test_sessions_over_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(3), float(60 * i + rng.randrange(50))) for i in range(200) if rng.random() < 0.4]
    for k in range(4):
        times(rows[k::4], "user_id long, ts timestamp", spark).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    times([(8, 99_999.0)], "user_id long, ts timestamp", spark).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    everything = times(rows, "user_id long, ts timestamp", spark)
    stream = spark.readStream.schema(everything.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stateful.sessions_over_stream(stream, "user_id", "ts", 180, "20000 seconds")
    stateful.append_batches(out, f"{tmp_path}/out", f"{tmp_path}/point").awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").select("user_id", "first", "last", "reads").collect()
    want = folds.idle_sessions(everything, "user_id", "ts", 180).select("user_id", "first", "last", "reads").collect()
    assert plain(got) == plain(want)
