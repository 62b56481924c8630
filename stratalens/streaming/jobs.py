"""Jobs over streams that may be stopped anywhere and started again: backfill, mirroring, commits; and what is running."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from threading import Lock

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.order import numbered


def _written(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The Parquet rows below a folder, none if it isn't there yet."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# ---- backfill ---------------------------------------------------------------

OUTCOMES = "id long, vector array<double>, ok boolean"


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """(id, vector, ok) of everything that was encoded or failed."""
    return _written(spark, folder, OUTCOMES)


def backfill(images: DataFrame, encode: Callable[[list], list], folder: str, checkpoint: str, size: int = 16) -> StreamingQuery:
    """Encodes every row of the stream ``images(id, name)`` that has no outcome yet, then stops.

    Rows go to the encoder ``size`` at a time; a group that fails is tried again
    row by row, so that one bad row fails alone. Vectors and failures are added
    to ``folder``, which every batch reads first: a batch that is run again, or
    a new checkpoint, encodes nothing twice, failures included. To try those
    again, remove their folder ``ok=false``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(name: str) -> list | None:
            try:
                return encode([name])[0]
            except Exception:  # whatever the encoder raises, the row counts as failed
                return None

        for pdf in frames:
            vectors = []
            for i in range(0, len(pdf), size):
                names = pdf["name"].iloc[i : i + size].tolist()
                try:
                    vectors += encode(names)
                except Exception:
                    vectors += [one(x) for x in names]
            yield pd.DataFrame({"id": pdf["id"], "vector": vectors, "ok": [v is not None for v in vectors]})

    def batch(df: DataFrame, _: int) -> None:
        missing = df.select("id", "name").dropDuplicates(["id"]).join(outcomes(df.sparkSession, folder).select("id"), "id", "left_anti")
        missing.mapInPandas(run, OUTCOMES).write.mode("append").partitionBy("ok").parquet(folder)

    return images.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- mirroring --------------------------------------------------------------

#: The order of a round: what is gone, what waits for deletion, what is new, then albums.
STEPS = ("remove", "drain", "upload", "album")
FEED, SENT = "side string, key string, present boolean, albums array<string>, seq long", "key string, detail string, ok boolean, batch long, step string"


def newest(feed: DataFrame) -> DataFrame:
    """(side, key, present, albums, seq): the newest row of each side and key."""
    return feed.groupBy("side", "key").agg(F.max_by(F.struct("present", "albums", "seq"), "seq").alias("x")).select("side", "key", "x.*")


def actions(state: DataFrame) -> DataFrame:
    """(step, key, detail) that a newest state of both sides asks for.

    Sides are ``local``, ``remote`` and ``queue``, the durable deletions: a
    queued key that the remote has is drained, a remote one whose local row is
    gone is removed, a local one that the remote lacks is uploaded, and each
    album of a local key that the remote doesn't know of is pushed.
    """
    of = lambda side: [F.max(F.when(F.col("side") == side, F.col("present"))).alias(side), F.max(F.when((F.col("side") == side) & F.col("present"), F.col("albums"))).alias(f"{side}_albums")]
    keys = state.groupBy("key").agg(*of("local"), *of("remote"), *of("queue"))
    keys = keys.select("key", "local", "local_albums", "remote_albums", F.coalesce("remote", F.lit(False)).alias("there"), F.coalesce("queue", F.lit(False)).alias("queued"))
    none = F.array().cast("array<string>")
    step = F.when(F.col("queued") & F.col("there"), "drain").when(~F.col("local") & F.col("there"), "remove").when(F.col("local") & ~F.col("there") & ~F.col("queued"), "upload")
    one = keys.select(step.alias("step"), "key", F.lit("").alias("detail")).where("step is not null")
    new = F.array_except(F.coalesce("local_albums", none), F.coalesce("remote_albums", none))
    albums = keys.where("local and not queued").select(F.lit("album").alias("step"), "key", F.explode(new).alias("detail"))
    return one.unionByName(albums)


def mirror_loop(feed: DataFrame, send: Callable[[str, list[tuple[str, str]], str], None], folder: str, checkpoint: str, size: int = 100) -> StreamingQuery:
    """Keeps a remote copy in step with a stream of changes ``feed(side, key, present, albums, seq)``, then stops.

    Each batch folds its changes into the newest state of both sides, as a new
    snapshot, and takes the steps of :data:`STEPS` in turn. ``send(step, rows,
    token)`` gets up to ``size`` (key, detail) rows. What was sent is written
    per batch and step before the next step begins, and counts as done on the
    remote side from then on: a batch that is run again goes on with the step
    that isn't written and sends nothing of the others. Should a machine be lost
    inside a step, its rows come again under the same token, by which the
    receiver can tell. Rows whose send raised are kept as failed and come again
    with the next batch. ``folder`` goes by the checkpoint's batch numbers, so a
    new checkpoint needs a new folder.
    """

    def deliver(step: str, number: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for i in range(0, len(pdf), size):
                    part = pdf.iloc[i : i + size]
                    rows = list(part[["key", "detail"]].itertuples(index=False, name=None))
                    try:
                        send(step, rows, f"{number}-{step}-{rows[0][0]}-{len(rows)}")
                        ok = True
                    except Exception:  # whatever it raises, the rows are tried again later
                        ok = False
                    yield part[["key", "detail"]].assign(ok=ok)

        return run

    def batch(df: DataFrame, number: int) -> None:
        spark, home = df.sparkSession, f"{folder}/state"
        # snapshots are numbered by batch, so the one before is never the one being written
        older = [r["version"] for r in _written(spark, home, f"{FEED}, version long").where(F.col("version") < number).select("version").distinct().collect()]
        last = _written(spark, home, f"{FEED}, version long").where(F.col("version") == max(older, default=-1)).drop("version")
        done = _written(spark, f"{folder}/sent", SENT).where((F.col("batch") < number) & F.col("ok"))
        acted = done.where(F.col("batch") >= max(older, default=-1)).select("step", "key", "detail")
        state = newest(last.unionByName(df.select(*last.columns)))
        state = _applied(state, acted)
        state.write.mode("overwrite").parquet(f"{home}/version={number}")
        todo = actions(spark.read.schema(FEED).parquet(f"{home}/version={number}"))
        written = {r["step"] for r in _written(spark, f"{folder}/sent", SENT).where(F.col("batch") == number).select("step").distinct().collect()}
        for step in STEPS:
            if step not in written:
                # one more row says that the step is over, also where it had nothing to send
                end = spark.createDataFrame([(None, None, None)], "key string, detail string, ok boolean")
                mine = todo.where(F.col("step") == step).select("key", "detail").sortWithinPartitions("key", "detail").mapInPandas(deliver(step, number), "key string, detail string, ok boolean")
                mine.unionByName(end).write.mode("overwrite").parquet(f"{folder}/sent/batch={number}/step={step}")

    return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _applied(state: DataFrame, acted: DataFrame) -> DataFrame:
    """The state after what was sent: removed and drained keys are gone from the remote side, uploads and albums are there."""
    sums = acted.groupBy("key").agg(F.bool_or(F.col("step").isin("remove", "drain")).alias("gone"), F.bool_or(F.col("step") == "upload").alias("came"), F.collect_set(F.when(F.col("step") == "album", F.col("detail"))).alias("put"))
    remote, rest = state.where("side = 'remote'"), state.where("side <> 'remote'")
    joined = remote.join(sums, "key", "full_outer")
    after = joined.select(
        F.lit("remote").alias("side"), "key", F.coalesce(F.when(F.col("gone"), F.lit(False)).when(F.col("came"), F.lit(True)), "present", F.lit(True)).alias("present"),
        F.array_union(F.coalesce("albums", F.array().cast("array<string>")), F.coalesce("put", F.array().cast("array<string>"))).alias("albums"), F.coalesce("seq", F.lit(-1)).cast("long").alias("seq"),
    )
    return rest.unionByName(after)


# ---- commits ----------------------------------------------------------------


def apply_plan(plan: DataFrame, staged: DataFrame, folder: str, chunk: int = 200) -> int:
    """Applies a commit plan in chunks, each a snapshot of its own with an entry in the log; the number of chunks applied now.

    ``plan(id, action, image_id)``, ``staged(id, ...)``. The plan is dealt into
    chunks once, in order of id, and kept with the folder. A chunk's rows are
    written first and its log entry last, so a chunk that failed leaves nothing
    that :func:`committed` shows, and a later call goes on with it.
    """
    spark = plan.sparkSession
    try:
        dealt = spark.read.parquet(f"{folder}/plan")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        numbered(plan, "chunk", F.col("id"), first=0).withColumn("chunk", F.floor(F.col("chunk") / chunk)).write.partitionBy("chunk").parquet(f"{folder}/plan")
        dealt = spark.read.parquet(f"{folder}/plan") if not plan.isEmpty() else plan.withColumn("chunk", F.lit(0).cast("long")).limit(0)
    log = _written(spark, f"{folder}/log", "rows long, chunk long")
    todo = sorted(r["chunk"] for r in dealt.select(F.col("chunk").cast("long").alias("chunk")).distinct().join(log.select("chunk"), "chunk", "left_anti").collect())
    for k in todo:
        rows = dealt.where(F.col("chunk") == k).drop("chunk").join(staged, "id")
        rows.write.mode("overwrite").parquet(f"{folder}/rows/chunk={k}")
        spark.read.parquet(f"{folder}/rows/chunk={k}").agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{folder}/log/chunk={k}")
    return len(todo)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the chunks that the log has."""
    log = _written(spark, f"{folder}/log", "rows long, chunk long").select("chunk")
    try:
        return spark.read.parquet(f"{folder}/rows").withColumn("chunk", F.col("chunk").cast("long")).join(log, "chunk", "left_semi")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return log.limit(0)


# ---- what is running --------------------------------------------------------


class Activity(StreamingQueryListener):
    """Counts of the session's streams, by name: batches, rows, whether they run, and how they ended.

    Add it with ``spark.streams.addListener``. It keeps one entry per query, the
    newest ``most`` of those that ended.
    """

    def __init__(self, most: int = 100) -> None:
        self._lock, self._runs, self._most = Lock(), {}, most

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self._lock:
            self._runs[str(event.runId)] = {"name": event.name or str(event.id), "batches": 0, "rows": 0, "running": True, "error": None}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        with self._lock:
            if run := self._runs.get(str(event.progress.runId)):
                run["batches"] += 1
                run["rows"] += max(0, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._lock:
            if run := self._runs.get(str(event.runId)):
                run |= {"running": False, "error": event.exception}
            ended = [k for k, r in self._runs.items() if not r["running"]]
            for k in ended[: max(0, len(ended) - self._most)]:
                del self._runs[k]

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """(name, batches, rows, running, error) of the streams known so far."""
        with self._lock:
            rows = [(r["name"], r["batches"], r["rows"], r["running"], r["error"]) for r in self._runs.values()]
        return spark.createDataFrame(rows, "name string, batches long, rows long, running boolean, error string")
