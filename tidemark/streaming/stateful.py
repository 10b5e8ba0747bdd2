"""Keyed state over streams: heartbeats, anchored windows, breakers, stalls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.keyed import with_fencing

Rows = Iterator[pd.DataFrame]


def _together(parts: Rows, order: str) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable")


def accepted_heartbeats(beats: DataFrame) -> DataFrame:
    """``(worker_id, seq, hb_seq, accepted)`` of a stream of ``(worker_id, seq, hb_seq)``.

    A number that is not above every earlier one of its worker is rejected and changes nothing.
    """
    def step(key: tuple, parts: Rows, state: GroupState) -> Rows:
        rows = _together(parts, "seq")
        top = state.get[0] if state.exists else None
        marks = []
        for n in rows["hb_seq"]:
            ok = top is None or n > top
            marks.append(ok)
            top = n if ok else top
        state.update((int(top),))
        yield rows.assign(accepted=marks)[["worker_id", "seq", "hb_seq", "accepted"]]

    return beats.select("worker_id", "seq", "hb_seq").groupBy("worker_id").applyInPandasWithState(
        step, "worker_id long, seq long, hb_seq long, accepted boolean", "top long", "append", GroupStateTimeout.NoTimeout
    )


def ingested_heartbeats(beats: DataFrame, jobs: DataFrame) -> DataFrame:
    """``(worker_id, proc_id, seq, hb_seq, outcome)``: fenced, late or accepted; ``jobs`` is a static table.

    The stream form of ``keyed.ingested``: fencing by a join with the jobs, then the order of each worker's process
    by its state, the greatest number accepted.  A fenced or late heartbeat changes nothing.
    """
    def step(key: tuple, parts: Rows, state: GroupState) -> Rows:
        rows = _together(parts, "seq")
        top = state.get[0] if state.exists else None
        outcomes = []
        for n, fenced in zip(rows["hb_seq"].tolist(), rows["fenced"].tolist(), strict=True):
            late = not fenced and top is not None and n <= top
            outcomes.append("fenced" if fenced else "late" if late else "accepted")
            if outcomes[-1] == "accepted":
                top = n
        if top is not None:
            state.update((int(top),))
        yield rows.assign(outcome=outcomes)[["worker_id", "proc_id", "seq", "hb_seq", "outcome"]]

    told = with_fencing(beats, jobs).select("worker_id", "proc_id", "seq", "hb_seq", "fenced")
    kinds = dict(told.dtypes)
    return told.groupBy("worker_id", "proc_id").applyInPandasWithState(
        step, f"worker_id {kinds['worker_id']}, proc_id {kinds['proc_id']}, seq long, hb_seq long, outcome string", "top long", "append", GroupStateTimeout.NoTimeout
    )


def _anchor(times: list[int], start: int | None, n: int, window: int) -> Iterator[tuple[int, int]]:
    for t in times:
        if start is None or t - start > window:
            start, n = t, 0
        n += 1
        yield start, n


def anchored_windows(signals: DataFrame, window: int) -> DataFrame:
    """``(scope_type, scope_id, window_started_at, failure_count)`` after each micro-batch, for the scopes it touched."""
    def step(key: tuple, parts: Rows, state: GroupState) -> Rows:
        rows = _together(parts, "observed_at")
        start, n = state.get if state.exists else (None, 0)
        for start, n in _anchor(rows["observed_at"].tolist(), start, n, window):
            pass
        state.update((int(start), int(n)))
        yield pd.DataFrame([[*key, start, n]], columns=["scope_type", "scope_id", "window_started_at", "failure_count"])

    return signals.groupBy("scope_type", "scope_id").applyInPandasWithState(
        step, "scope_type string, scope_id string, window_started_at long, failure_count long", "start long, n long", "update", GroupStateTimeout.NoTimeout
    )


def breaker_machine(signals: DataFrame, window: int, cooldown: int, threshold: int, probes: int = 1) -> DataFrame:
    """``(scope_type, scope_id, at, event, src, dst)``: what breakers do with signals and probes.

    ``signals (scope_type, scope_id, observed_at, kind)``; kind is ``failure``, ``probe_request``, ``probe_success``,
    ``probe_failure`` or ``tick``.  Signals count in every state.  An open breaker goes half-open at the first
    row at or after its cooldown, with fresh probes; closes on a successful probe with a fresh count; and
    reopens on a failed one without a longer cooldown.  A request is ``allowed`` while closed, ``denied`` while open,
    and takes one of the ``probes`` while half-open (``probe_granted``) or is denied if none is left.
    Transitions are events ``transition``; of other events src and dst are the state at hand.
    """
    def step(key: tuple, parts: Rows, memory: GroupState) -> Rows:
        state, start, n, until, used = memory.get if memory.exists else ("CLOSED", None, 0, None, 0)
        out = []

        def go(to: str, at: int) -> None:
            nonlocal state
            out.append([*key, at, "transition", state, to])
            state = to

        rows = _together(parts, "observed_at")
        for at, kind in zip(rows["observed_at"].tolist(), rows["kind"].tolist(), strict=True):
            if state == "OPEN" and until <= at:
                used = 0
                go("HALF_OPEN", at)
            if kind == "failure":
                (start, n), = _anchor([at], start, n, window)
                if state == "CLOSED" and n >= threshold:
                    until = at + cooldown
                    go("OPEN", at)
            elif kind == "probe_request":
                granted = state == "HALF_OPEN" and used < probes
                used += granted
                out.append([*key, at, "probe_granted" if granted else "allowed" if state == "CLOSED" else "denied", state, state])
            elif state == "HALF_OPEN" and kind == "probe_success":
                start, n = None, 0
                go("CLOSED", at)
            elif state == "HALF_OPEN" and kind == "probe_failure":
                go("OPEN", at)
        memory.update((state, start, n, until, used))
        yield pd.DataFrame(out, columns=["scope_type", "scope_id", "at", "event", "src", "dst"])

    return signals.groupBy("scope_type", "scope_id").applyInPandasWithState(
        step, "scope_type string, scope_id string, at long, event string, src string, dst string", "state string, start long, n long, until long, used long", "append", GroupStateTimeout.NoTimeout
    )


def stalls(progress: DataFrame, delay: str, threshold_ms: int) -> DataFrame:
    """``(job_id, last_progress)`` of jobs without progress for the threshold, by event time.

    ``progress (job_id, ts timestamp)``; the watermark (``delay`` behind the newest row) drives the timers.
    """
    def step(key: tuple, parts: Rows, state: GroupState) -> Rows:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "last_progress": [last]})
            return
        newest = max(int(part["ts"].max().value // 1_000_000) for part in parts)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last,))
        state.setTimeoutTimestamp(max(last + threshold_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [], "last_progress": []})

    return progress.withWatermark("ts", delay).groupBy("job_id").applyInPandasWithState(
        step, "job_id long, last_progress long", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def once(signals: DataFrame, delay: str) -> DataFrame:
    """Each ``signal_id`` once within the watermark on ``ts``."""
    return signals.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["signal_id"])


def pressure_buckets(events: DataFrame, delay: str, window: str, threshold: int) -> DataFrame:
    """Tumbling windows of ``ts`` whose events reach the threshold, one row each."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("pressure"))
    return counted.where(F.col("pressure") >= threshold).select(F.col("window.start").alias("bucket"), "pressure")


def claim_beats(beats: DataFrame, delay: str, ttl_ms: int) -> DataFrame:
    """``(worker_id, last_beat, alive)`` after each change: the stream form of ``execution.live_claims``.

    ``beats (worker_id, seq, ts timestamp, kind)``; kind is ``beat``, ``withdraw`` or ``clear``.  A beat keeps its claim
    alive for ``ttl_ms`` of event time; a withdrawal or clearing takes it away at once; a beat after that
    begins anew.  The watermark (``delay`` behind the newest row) drives the expiry.
    """
    def step(key: tuple, parts: Rows, state: GroupState) -> Rows:
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"worker_id": [key[0]], "last_beat": [last], "alive": [False]})
            return
        rows = _together(parts, "seq")
        for at, kind in zip(rows["ts"], rows["kind"], strict=True):
            last = int(at.value // 1_000_000) if kind == "beat" else None
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + ttl_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"worker_id": [key[0]], "last_beat": pd.array([last], "Int64"), "alive": [last is not None]})

    return beats.withWatermark("ts", delay).groupBy("worker_id").applyInPandasWithState(
        step, "worker_id long, last_beat long, alive boolean", "last long", "update", GroupStateTimeout.EventTimeTimeout
    )


def split_sink(accepted: Callable[[DataFrame, int], None], rejected: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that sends accepted rows to one sink and the others to another."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        accepted(batch.where("accepted"), epoch)
        rejected(batch.where("NOT accepted"), epoch)
        batch.unpersist()

    return sink
