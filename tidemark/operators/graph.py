"""State graphs: legality of transitions, closure, shortest legal paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The states that each state may be followed by.
GRAPHS: dict[str, dict[str, list[str]]] = {
    "task": {
        "PROPOSED": ["AUTHORIZED", "REJECTED"],
        "AUTHORIZED": ["PLANNED", "PAUSED_FOR_HUMAN"],
        "PLANNED": ["EXECUTING"],
        "EXECUTING": ["VERIFYING", "PAUSED_FOR_HUMAN", "FAILED", "CANCELLED"],
        "VERIFYING": ["FINALIZED", "PAUSED_FOR_HUMAN"],
        "BLOCKED": ["EXECUTING"],
        "PAUSED_FOR_HUMAN": ["EXECUTING", "CANCELLED"],
        "REJECTED": [],
        "FAILED": [],
        "CANCELLED": [],
        "FINALIZED": [],
    },
    "job": {
        "PENDING": ["CLAIMED"],
        "CLAIMED": ["RUNNING", "PENDING", "FAILED"],
        "RUNNING": ["COMMITTING", "PENDING", "UNCERTAIN", "FAILED"],
        "COMMITTING": ["COMPLETE", "UNCERTAIN", "FAILED"],
        "UNCERTAIN": ["COMPLETE", "PENDING", "QUARANTINED"],
        "FAILED": ["PENDING", "QUARANTINED", "BLOCKED"],
        "QUARANTINED": ["PENDING"],
        "BLOCKED": ["PENDING"],
        "COMPLETE": [],
    },
    "worker": {
        "PROVISIONING": ["IDLE", "DEAD"],
        "IDLE": ["ASSIGNED", "DRAINING"],
        "ASSIGNED": ["RUNNING", "SUSPECT"],
        "RUNNING": ["IDLE", "DRAINING", "SUSPECT"],
        "SUSPECT": ["RUNNING", "DEAD"],
        "DRAINING": ["RETIRED"],
        "DEAD": [],
        "RETIRED": [],
    },
    "artifact": {
        "STAGING": ["VALIDATED", "QUARANTINED"],
        "VALIDATED": ["RELEASED", "QUARANTINED"],
        "RELEASED": ["QUARANTINED"],
        "QUARANTINED": [],
    },
    "approval": {
        "PENDING": ["APPROVED", "DENIED", "EXPIRED"],
        "APPROVED": [],
        "DENIED": [],
        "EXPIRED": [],
    },
    "checkpoint": {
        "UNVERIFIED": ["VERIFYING"],
        "VERIFYING": ["VERIFIED", "CORRUPT"],
        "VERIFIED": [],
        "CORRUPT": [],
    },
    "breaker": {
        "CLOSED": ["OPEN"],
        "OPEN": ["HALF_OPEN"],
        "HALF_OPEN": ["CLOSED", "OPEN"],
    },
}


def edges(spark: SparkSession) -> DataFrame:
    """``(entity, src, dst)``: a few dozen rows of constants."""
    rows = [(e, a, b) for e, graph in GRAPHS.items() for a, after in graph.items() for b in after]
    return spark.createDataFrame(rows, "entity string, src string, dst string")


def illegal_transitions(transitions: DataFrame, entity: str) -> DataFrame:
    """Rows of ``transitions (..., src, dst)`` whose step is no edge of the entity's graph.

    The edge table is a constant, so the anti-join is a broadcast one at every size.
    """
    legal = F.broadcast(edges(transitions.sparkSession).where(F.col("entity") == entity).select("src", "dst"))
    return transitions.join(legal, ["src", "dst"], "left_anti")


def gate_violations(transitions: DataFrame, approvals: DataFrame) -> DataFrame:
    """Steps out of a human-gated task state without an approved approval of the same task."""
    granted = approvals.where(F.col("status") == "APPROVED").select("task_id").distinct()
    return transitions.where(F.col("src") == "PAUSED_FOR_HUMAN").join(granted, "task_id", "left_anti")


def closure(spark: SparkSession) -> DataFrame:
    """``(entity, src, dst, depth, path)``: every reachable state with its shortest path.

    Of equally short paths the alphabetically first is taken.  The recursion runs over the
    constant edge table and is bounded by the number of states.
    """
    edges(spark).createOrReplaceTempView("_state_edges")
    return spark.sql(
        """
        WITH RECURSIVE walk(entity, src, dst, depth, path) AS (
          SELECT entity, src, dst, 1, concat(src, '>', dst) FROM _state_edges
          UNION ALL
          SELECT w.entity, w.src, e.dst, w.depth + 1, concat(w.path, '>', e.dst)
          FROM walk w JOIN _state_edges e ON e.entity = w.entity AND e.src = w.dst
          WHERE w.depth < 10 AND NOT array_contains(split(w.path, '>'), e.dst)
        )
        SELECT entity, src, dst, cast(min(depth) AS BIGINT) AS depth, min_by(path, struct(depth, path)) AS path
        FROM walk GROUP BY entity, src, dst
        """
    )


def shortest_path(spark: SparkSession, entity: str, src: str, dst: str) -> list[str] | None:
    """The states of the shortest legal path, ``[src]`` if it is the goal already, None without one."""
    if src == dst:
        return [src]
    found = closure(spark).where((F.col("entity") == entity) & (F.col("src") == src) & (F.col("dst") == dst)).first()
    return found["path"].split(">") if found else None
