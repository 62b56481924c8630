"""State with timers: sessions that close, jobs that wait for quiet, values that expire.

Timers run on processing time, so they fire in the next micro-batch after they
are due, whether or not anything came in. State is one small row per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: What ends a session, by the event that asks for it.
ENDS = {"commit": "committed", "discard": "discarded"}


def _events(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values("seq", kind="stable")


def sessions(events: DataFrame, idle_ms: int) -> DataFrame:
    """Stream of ``events(session_id, seq, kind, file)`` -> (session_id, event, files, seq), what happened to sessions.

    The first event opens a session in ``staging``. ``file`` events count its
    files, ``commit`` and ``discard`` end it, and a session without an event for
    ``idle_ms`` ends as ``expired``. What comes after an end is answered with
    ``refused`` and changes nothing; events of one batch are taken in order of seq.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, files = state.get if state.exists else (None, 0)
        out = []
        if state.hasTimedOut:
            status = "expired"
            out.append((status, files, None))
        else:
            for kind, seq in _events(frames)[["kind", "seq"]].itertuples(index=False):
                if status is None:
                    status = "staging"
                    out.append((status, files, seq))
                if status != "staging":
                    out.append(("refused", files, seq))
                elif kind in ENDS:
                    status = ENDS[kind]
                    out.append((status, files, seq))
                else:
                    files += kind == "file"
        state.update((status, files))
        if status == "staging":
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["session_id", "event", "files", "seq"]).astype({"seq": "Int64"})

    return events.groupBy("session_id").applyInPandasWithState(step, "session_id string, event string, files int, seq long", "status string, files int", "append", "ProcessingTimeTimeout")


def debounced(changes: DataFrame, quiet_ms: int, most_ms: int) -> DataFrame:
    """Stream of ``changes(job, seq)`` -> (job, changes, waited_ms): a job is due when it has been quiet, or dirty for long.

    The first change starts the wait and each further one moves the timer to
    ``quiet_ms`` after it, but never beyond ``most_ms`` after the first. Firing
    takes all changes so far together and clears the state.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        since, n = state.get if state.exists else (now, 0)
        due = state.hasTimedOut
        if not due:
            n += sum(len(f) for f in frames)
            due = now - since >= most_ms
        if due:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"job": [key[0]], "changes": [n], "waited_ms": [now - since]})
        else:
            state.update((since, n))
            state.setTimeoutDuration(max(1, min(quiet_ms, since + most_ms - now)))

    return changes.groupBy("job").applyInPandasWithState(step, "job string, changes long, waited_ms long", "since long, n long", "append", "ProcessingTimeTimeout")


def expiring(values: DataFrame, ttl_ms: int) -> DataFrame:
    """Stream of ``values(key, seq, value)`` -> (key, value, event): ``set`` by the newest seq, ``expired`` after ``ttl_ms`` without a newer one.

    An older seq than the one held changes nothing and doesn't lengthen its life.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            value = state.get[1]
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "value": [value], "event": ["expired"]})
            return
        newest = _events(frames).iloc[-1]
        now = state.getCurrentProcessingTimeMs()
        if state.exists and state.get[0] >= newest["seq"]:
            state.setTimeoutDuration(max(1, state.get[2] - now))
            return
        state.update((int(newest["seq"]), newest["value"], now + ttl_ms))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": [key[0]], "value": [newest["value"]], "event": ["set"]})

    return values.groupBy("key").applyInPandasWithState(step, "key string, value string, event string", "seq long, value string, until long", "append", "ProcessingTimeTimeout")
