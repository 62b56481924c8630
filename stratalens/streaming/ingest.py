"""Ingest and reconcile loops as Structured Streaming with explicit state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def dedup_staged(staged: DataFrame) -> DataFrame:
    """Stream of ``staged(id, sha, seq)`` -> (id, sha, duplicate_of): the first row of a content wins, across batches.

    The state of a content is the id that came first; rows of one batch are
    taken in order of seq.
    """

    def first(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        owner = state.get[0] if state.exists else int(rows["id"].iloc[0])
        if not state.exists:
            state.update((owner,))
        yield pd.DataFrame({"id": rows["id"], "sha": key[0], "duplicate_of": [None if i == owner else owner for i in rows["id"]]})

    return staged.groupBy("sha").applyInPandasWithState(first, "id long, sha string, duplicate_of long", "owner long", "append", "NoTimeout")


def open_jobs(jobs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Jobs of sessions that are still being staged; jobs after the close are no-ops. ``sessions`` is read per batch."""
    return jobs.join(sessions.where("status = 'staging'").select("session_id"), "session_id", "left_semi")


def retry_delays(failures: DataFrame) -> DataFrame:
    """Stream of ``outcomes(key, ok)`` -> (key, failures, wait_seconds): doubled per failure from 120 s up to an hour, cleared by success."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for frame in frames:
            for ok in frame["ok"]:
                n = 0 if ok else n + 1
        if n:
            state.update((n,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": [key[0]], "failures": [n], "wait_seconds": [min(120.0 * 2 ** (n - 1), 3600.0) if n else 0.0]})

    return failures.groupBy("key").applyInPandasWithState(step, "key string, failures int, wait_seconds double", "failures int", "update", "NoTimeout")


def reconcile(images: DataFrame, remote: DataFrame, mode: str = "all") -> dict[str, DataFrame]:
    """What one round has to do: uploads of live files without an asset, removals of trashed ones that have it."""
    scope = images if mode == "all" else images.where("remote_sync")
    live = scope.where("deleted_at is null and file_type <> 'raw'")
    known = remote.select("remote_id")
    return {
        "upload": live.join(known, "remote_id", "left_anti").select("id", "original_filename"),
        "remove": images.where("deleted_at is not null").join(known, "remote_id", "left_semi").select("id", "remote_id"),
    }


def drain(queue: DataFrame, send: Callable[[list], None], checkpoint: str, size: int = 100) -> StreamingQuery:
    """A durable queue as a stream: rows are sent ``size`` at a time, at least once, before a batch's offsets are committed."""

    def part(rows: Iterator) -> None:
        while chunk := list(islice(rows, size)):
            send(chunk)

    def batch(df: DataFrame, _: int) -> None:
        df.foreachPartition(part)

    return queue.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backfill(images: DataFrame, encode: Callable[[list], list], size: int = 16) -> DataFrame:
    """(id, vector) of images by a pluggable encoder, in batches of ``size``; failures come back with a null vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for i in range(0, len(pdf), size):
                part = pdf["original_filename"].iloc[i : i + size].tolist()
                try:
                    out += encode(part)
                except ValueError:
                    out += [None] * len(part)
            yield pd.DataFrame({"id": pdf["id"], "vector": out})

    return images.select("id", "original_filename").mapInPandas(run, "id long, vector array<double>")


def latest(requests: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Newest request of each key; older ones are superseded."""
    return requests.groupBy(key).agg(F.max_by(F.struct(*requests.columns), seq).alias("r")).select("r.*")


def due(changes: DataFrame, floor_minutes: int = 15, ceiling_hours: int = 24) -> DataFrame:
    """``changes(job, dirty_since, last_change, now)``: jobs quiet for the floor, or dirty for longer than the ceiling."""
    minutes = lambda a, b: (F.unix_seconds(F.col(a).cast("timestamp")) - F.unix_seconds(F.col(b).cast("timestamp"))) / 60
    return changes.where((minutes("now", "last_change") >= floor_minutes) | (minutes("now", "dirty_since") >= ceiling_hours * 60))
