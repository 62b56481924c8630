"""Streams with timers and restarts: sessions, debouncing, expiry, backfill, mirroring, commits, activity."""

import time

import pytest
from pyspark.sql import functions as F

from stratalens.operators import vectors
from stratalens.streaming import jobs, stateful


def feed(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def until(spark, name, good, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        rows = spark.sql(f"select * from {name}").collect()
        if good(rows):
            return rows
        time.sleep(0.3)
    raise AssertionError(rows)


def test_timers_fire_without_new_input(spark, tmp_path):
    """Sessions expire, jobs become due and values go, though nothing comes in any more."""
    s, c, v = (f"{tmp_path}/{x}" for x in "scv")
    put(spark, s, [("a", 1, "open"), ("a", 2, "file"), ("a", 3, "file"), ("a", 4, "commit"), ("a", 5, "file"), ("b", 1, "file")], "session_id string, seq long, kind string")
    put(spark, c, [("j", 1), ("j", 2), ("k", 1)], "job string, seq long")
    put(spark, v, [("x", 2, "new"), ("x", 1, "old")], "key string, seq long, value string")
    queries = [
        stateful.sessions(feed(spark, s, "session_id string, seq long, kind string"), 500),
        stateful.debounced(feed(spark, c, "job string, seq long"), 400, 60_000),
        stateful.expiring(feed(spark, v, "key string, seq long, value string"), 500),
    ]
    running = [q.writeStream.format("memory").queryName(n).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp{n}").trigger(processingTime="200 milliseconds").start() for n, q in zip(("s1", "c1", "v1"), queries, strict=True)]
    try:
        rows = until(spark, "s1", lambda r: any(x.event == "expired" for x in r))
        assert [(x.event, x.files) for x in sorted((x for x in rows if x.session_id == "a"), key=lambda x: (x.seq, x.event != "staging"))] == [("staging", 0), ("committed", 2), ("refused", 2)]
        assert [(x.event, x.files) for x in rows if x.session_id == "b"] == [("staging", 0), ("expired", 1)]
        rows = until(spark, "c1", lambda r: len(r) == 2)
        assert {(x.job, x.changes) for x in rows} == {("j", 2), ("k", 1)} and all(x.waited_ms >= 400 for x in rows)
        assert [(x.value, x.event) for x in until(spark, "v1", lambda r: len(r) == 2)] == [("new", "set"), ("new", "expired")]
    finally:
        for q in running:
            q.stop()


def test_backfill_encodes_nothing_twice_and_skips_what_failed(spark, tmp_path):
    src, out, cp, calls = f"{tmp_path}/i", f"{tmp_path}/o", f"{tmp_path}/cp", f"{tmp_path}/calls"

    def encode(names):
        with open(calls, "a") as f:
            f.write("".join(f"{n}\n" for n in names))
        if "bad" in names:
            raise RuntimeError("no picture")
        return [[float(len(n))] for n in names]

    schema = "id long, name string"
    put(spark, src, [(1, "one"), (2, "bad"), (3, "three"), (3, "three")], schema)
    jobs.backfill(feed(spark, src, schema), encode, out, cp, size=3).awaitTermination()
    got = {r.id: (r.vector, r.ok) for r in jobs.outcomes(spark, out).collect()}
    assert got == {1: ([3.0], True), 2: (None, False), 3: ([5.0], True)}
    before = open(calls).read().count("\n")
    jobs.backfill(feed(spark, src, schema), encode, out, f"{tmp_path}/cp2", size=3).awaitTermination()  # from the start, as after a lost checkpoint
    assert open(calls).read().count("\n") == before
    put(spark, src, [(1, "one"), (2, "bad"), (4, "four!")], schema)
    jobs.backfill(feed(spark, src, schema), encode, out, cp, size=3).awaitTermination()
    assert open(calls).read().count("\n") == before + 1
    done = jobs.outcomes(spark, out).where("ok").select("id", "vector")
    assert {r.id for r in done.collect()} == {1, 3, 4}
    images = spark.range(1, 6).selectExpr("id", "timestamp'2020-01-01' as imported_at")
    left = vectors.missing_vectors(images, jobs.outcomes(spark, out).select("id", "vector"), images.limit(0), 10)
    assert [r.id for r in left.collect()] == [5]


def test_mirror_loop_sends_nothing_twice_after_a_restart(spark, tmp_path, monkeypatch):
    src, folder, cp, log = f"{tmp_path}/f", f"{tmp_path}/m", f"{tmp_path}/cp", f"{tmp_path}/log"
    def send(step, rows, token):
        if step == "upload" and any(k == "broken" for k, _ in rows):
            raise RuntimeError("refused")
        with open(log, "a") as f:
            f.write("".join(f"{step} {k} {d}\n" for k, d in rows))

    rows = [("local", "a", True, ["x", "y"], 1), ("local", "b", False, [], 1), ("remote", "b", True, [], 1), ("queue", "c", True, [], 1), ("remote", "c", True, [], 1), ("local", "c", True, ["x"], 1), ("local", "broken", True, [], 1), ("local", "old", True, [], 3), ("local", "old", False, [], 2)]
    put(spark, src, rows, jobs.FEED)

    class Dies:
        def __iter__(self):
            yield from ("remove", "drain")
            raise RuntimeError("the process is lost between two steps")

    lines = lambda: sorted(open(log).read().split("\n")[:-1])
    with monkeypatch.context() as m:
        m.setattr(jobs, "STEPS", Dies())
        with pytest.raises(Exception, match="between two steps"):
            jobs.mirror_loop(feed(spark, src, jobs.FEED), send, folder, cp, size=1).awaitTermination()
    assert lines() == ["drain c ", "remove b "]
    # the batch comes again under the same number and goes on with what isn't written
    jobs.mirror_loop(feed(spark, src, jobs.FEED), send, folder, cp, size=1).awaitTermination()
    assert lines() == ["album a x", "album a y", "drain c ", "remove b ", "upload a ", "upload old "]
    first = open(log).read()
    put(spark, src, [("local", "d", True, ["x"], 5), ("local", "a", True, ["x", "y", "z"], 6)], jobs.FEED)
    jobs.mirror_loop(feed(spark, src, jobs.FEED), send, folder, cp, size=1).awaitTermination()
    assert sorted(open(log).read()[len(first) :].split("\n")[:-1]) == ["album a z", "album d x", "upload d "]


def test_plan_is_applied_in_chunks_and_goes_on_after_a_failure(spark, tmp_path):
    plan = spark.createDataFrame([(i, "insert", None) for i in range(25)], "id long, action string, image_id long")
    staged = spark.createDataFrame([(i, f"n{i}") for i in range(30)], "id long, name string")
    broken = staged.withColumn("name", F.when(F.col("id") == 17, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    folder = f"{tmp_path}/c"
    with pytest.raises(Exception, match="lost"):
        jobs.apply_plan(plan, broken, folder, chunk=10)
    assert {r.id for r in jobs.committed(spark, folder).collect()} == set(range(10))
    assert jobs.apply_plan(plan, staged, folder, chunk=10) == 2 and jobs.apply_plan(plan, staged, folder, chunk=10) == 0
    assert sorted((r.id, r.name) for r in jobs.committed(spark, folder).collect()) == [(i, f"n{i}") for i in range(25)]
    assert jobs.apply_plan(plan.limit(0), staged, f"{tmp_path}/none") == 0 and jobs.committed(spark, f"{tmp_path}/none").count() == 0


def test_activity_counts_what_streams_read(spark, tmp_path):
    seen = jobs.Activity()
    spark.streams.addListener(seen)
    try:
        src = f"{tmp_path}/s"
        put(spark, src, [(i,) for i in range(7)], "id long")
        put(spark, src, [(i,) for i in range(5)], "id long")
        feed(spark, src, "id long").writeStream.format("noop").queryName("reader").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        end = time.time() + 30
        while time.time() < end and not (rows := [r for r in seen.snapshot(spark).collect() if r.name == "reader" and not r.running]):
            time.sleep(0.2)
        assert [(r.batches, r.rows, r.error) for r in rows] == [(2, 12, None)]
    finally:
        spark.streams.removeListener(seen)
