"""Running work: readiness before it, an adapter around it, and synthetic behaviours for fixtures."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NotReady(RuntimeError):
    """A precondition of a run does not hold; ``reasons`` names all that don't."""

    def __init__(self, reasons: list[str]):
        super().__init__(f"not ready: {', '.join(reasons)}")
        self.reasons = reasons


def when_ready(checks: dict[str, Callable[[], bool]], run: Callable[[], DataFrame]) -> DataFrame:
    """``run()`` if every check returns True; anything else, an exception too, is a reason not to run."""
    reasons = []
    for name, check in checks.items():
        try:
            fine = check() is True
        except Exception as broken:  # a check that can't tell is no yes
            fine, name = False, f"{name} ({broken})"
        if not fine:
            reasons.append(name)
    if reasons:
        raise NotReady(reasons)
    return run()


def adapted(claimed: DataFrame, transform: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What a workload makes of claimed jobs, batch by batch: ``transform`` stands between claim and commit.

    It gets and returns data frames with ``job_id`` and ``fencing_token``; ``schema`` names what it returns.  Its
    rows are staged, not committed: see ``committable``.
    """
    return claimed.mapInPandas(lambda parts: map(transform, parts), schema)


def committable(made: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows of ``made`` whose token is still the job's: work of a worker that was fenced meanwhile is left out."""
    return made.join(jobs.select("job_id", "fencing_token"), ["job_id", "fencing_token"], "left_semi")


#: The synthetic behaviours, each with what a job of it logs once before and after its steps, and at each step.
BEHAVIOURS: dict[str, tuple[list[str], list[str], list[str]]] = {
    "success_immediate": (["claimed"], [], ["heartbeat", "progress", "committed"]),
    "success_delayed": (["claimed"], ["heartbeat", "progress"], ["committed"]),
    "controlled_failure": (["claimed"], ["heartbeat", "progress"], ["failed"]),
    "heartbeat_loop": (["claimed"], ["heartbeat"], ["released"]),
    "hang": (["claimed"], ["heartbeat"], []),
    "wedged": (["claimed", "heartbeat"], [], []),
    "wedged_ignore_sigterm": (["claimed", "heartbeat"], [], ["sigterm_ignored"]),
    "wedged_spawn_child": (["claimed", "heartbeat", "child_spawned"], [], []),
    "crash": (["claimed", "heartbeat"], [], ["exited"]),
    "crash_after_stage": (["claimed", "heartbeat"], [], ["staged", "exited"]),
    "sigkill_self": (["claimed", "heartbeat"], [], ["killed"]),
    "expire_then_commit": (["claimed", "heartbeat"], [], ["lease_expired", "commit_rejected"]),
}


def behaviour_log(spark: SparkSession, specs: DataFrame) -> DataFrame:
    """``(job_id, kind, n, event)``: the log that jobs ``(job_id, kind, steps)`` leave, numbered from 1 in each job.

    Failures end halfway: at step ``steps / 2 + 1``.  An unknown kind, or fewer than one step, is an error.
    """
    c = F.col
    texts = lambda some: F.array(*map(F.lit, some)).cast("array<string>")
    kind, steps = c("kind"), c("steps")
    known = F.when(kind.isin(*BEHAVIOURS) & (steps >= 1), F.when(kind == "controlled_failure", F.floor(steps / 2) + 1).otherwise(steps)).otherwise(
        F.raise_error(F.concat(F.lit("no such behaviour: "), F.coalesce(kind, F.lit("null"))))
    )
    events = None
    for name, (first, each, last) in BEHAVIOURS.items():
        made = F.concat(texts(first), F.flatten(F.array_repeat(texts(each), known.cast("int"))), texts(last))
        events = F.when(kind == name, made) if events is None else events.when(kind == name, made)
    return specs.select("job_id", "kind", F.posexplode(F.when(known >= 1, events)).alias("n", "event")).withColumn("n", c("n") + 1)
