"""Building blocks over keys: latest row, top-n, runs, anti-joins, anchored windows.

Latest-per-key uses ``max_by`` over a struct, which combines before the shuffle; windows are
used only where an order within the key is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order columns; all columns kept.

    Every order needs a tie-break as its last column.  Nulls order first.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def newest(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows of a total order; a limit below 1 gives none."""
    return df.orderBy(*order).limit(max(0, limit))


def after_cursor(df: DataFrame, id_col: str, cursor, limit: int) -> DataFrame:
    """The next batch of a keyset scan: ids above the cursor, in order."""
    rest = df if cursor is None else df.where(F.col(id_col) > F.lit(cursor))
    return top(rest, [id_col], limit)


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in ``other``; nulls are equal to nulls."""
    taken = other.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    return df.join(taken, on, "left_anti")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "attempt_number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def increasing_only(df: DataFrame, keys: list[str], seq: str, order: list[str]) -> DataFrame:
    """Adds ``accepted``: the sequence number is above every earlier one of its key.

    Comparing with the running maximum of all earlier rows is exact, as a rejected number
    never raises the maximum.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(seq).over(w)
    return df.withColumn("accepted", before.isNull() | (F.col(seq) > before))


def with_fencing(beats: DataFrame, jobs: DataFrame) -> DataFrame:
    """Adds ``fenced``: a heartbeat names a job but not its current token, or comes from another than its owner."""
    c = F.col
    current = jobs.select("job_id", c("fencing_token").alias("_token"), c("owner_worker_id").alias("_owner"))
    holds = (c("fencing_token") == c("_token")) & (c("worker_id") == c("_owner"))
    fenced = c("job_id").isNotNull() & ~F.coalesce(holds, F.lit(False))
    return beats.join(current, "job_id", "left").withColumn("fenced", fenced).drop("_token", "_owner")


def ingested(beats: DataFrame, jobs: DataFrame) -> DataFrame:
    """``(worker_id, proc_id, seq, hb_seq, outcome)``: fenced, late or accepted, in the order of ``seq``.

    Fencing comes first and leaves no trace; of the rest a number that is not above every earlier one of its worker
    and process is late.  ``beats (seq, worker_id, proc_id, job_id, fencing_token, hb_seq)``.
    """
    c = F.col
    told = with_fencing(beats, jobs)
    w = Window.partitionBy("worker_id", "proc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(~c("fenced"), c("hb_seq"))).over(w)
    outcome = F.when(c("fenced"), "fenced").when(c("hb_seq") <= before, "late").otherwise("accepted")
    return told.withColumn("outcome", outcome).select("worker_id", "proc_id", "seq", "hb_seq", "outcome")


def trailing_run(df: DataFrame, key: str, number: str, failed: Column) -> DataFrame:
    """``(key, run)``: failed rows at the end of each key's numbered history.

    The run stops at a row that did not fail and at a gap in the numbers.
    """
    known = df.where(F.col(number).isNotNull())
    back = Window.partitionBy(key).orderBy(F.desc(number))
    whole = Window.partitionBy(key)
    ranked = known.select(
        key,
        F.col(number).alias("_n"),
        F.coalesce(failed, F.lit(False)).alias("_failed"),
        F.row_number().over(back).alias("_rn"),
        F.max(number).over(whole).alias("_max"),
    )
    breaks = F.sum(F.when(~F.col("_failed") | (F.col("_n") != F.col("_max") - (F.col("_rn") - 1)), 1).otherwise(0)).over(
        Window.partitionBy(key).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    )
    return ranked.withColumn("_breaks", breaks).groupBy(key).agg(F.count_if(F.col("_breaks") == 0).alias("run"))


def since_progress(df: DataFrame, key: str, number: str, delta: str) -> DataFrame:
    """``(key, zero_progress)``: rows after the last one with a positive delta."""
    last = df.groupBy(key).agg(F.max(F.when(F.col(delta) > 0, F.col(number))).alias("_last"))
    after = F.col(number).isNotNull() & (F.col("_last").isNull() | (F.col(number) > F.col("_last")))
    return df.select(key, number).join(last, key).groupBy(key).agg(F.count_if(after).alias("zero_progress"))


def changes(df: DataFrame, keys: list[str], order: list[str], value: str, final: str) -> DataFrame:
    """Rows whose value differs from the one before, up to the first ``final`` value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    done = F.max(F.when(F.col(value) == final, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        df.withColumn("previous", F.lag(value).over(w))
        .withColumn("_done", F.coalesce(done, F.lit(0)))
        .where((F.col("_done") == 0) & ~F.col("previous").eqNullSafe(F.col(value)))
        .drop("_done")
    )


def anchored_window(df: DataFrame, keys: list[str], ts: str, window: int) -> DataFrame:
    """``(keys, window_started_at, failure_count, peak)``: counts in windows that a first event opens.

    Events up to ``window`` after the opening one count in its window; the first beyond opens
    the next.  The last window's start and count are returned, and the largest count seen.  Times that
    are null don't count.  A key's times pass through one task in their order, which holds three
    numbers of the key and one Arrow batch, however many times there are.
    """
    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", window_started_at long, failure_count long, peak long"
    names = [*keys, "window_started_at", "failure_count", "peak"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, n, peak = None, 0, 0, 0
        kinds = None

        def rows(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*[(*key, *state) for key, *state in done], strict=True)) or [()] * len(names)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            kinds = [*[batch.schema.field(i).type for i in range(len(keys))], pa.int64(), pa.int64(), pa.int64()]
            if not batch.num_rows:
                continue
            times = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            changed = np.zeros(len(times), bool)
            changed[0] = True
            for i in range(len(keys)):
                codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                changed[1:] |= codes[1:] != codes[:-1]
            edges = [*np.flatnonzero(changed).tolist(), len(times)]
            done = []
            for a, b in zip(edges, edges[1:], strict=False):
                key = tuple(batch.column(i)[a].as_py() for i in range(len(keys)))
                if key != now:
                    if now is not None:
                        done.append((now, start, n, peak))
                    now, start, n, peak = key, int(times[a]), 0, 0
                own = times[a:b]
                at = 0
                while at < len(own):
                    if own[at] - start > window:
                        start, n = int(own[at]), 0
                    end = int(np.searchsorted(own, start + window, "right"))
                    n += end - at
                    peak, at = max(peak, n), end
            yield rows(done)
        if now is not None:
            yield rows([(now, start, n, peak)])

    ordered = df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).cast("long").alias("_ts")).repartition(*keys).sortWithinPartitions(*keys, "_ts")
    return ordered.mapInArrow(run, schema)


#: Leading hex digits of a key's hash that name the range of a digest: 65,536 ranges.
DIGEST_DIGITS = 4


def digest(entries: DataFrame, by: list[str], key: Column, text: Column, digits: int = DIGEST_DIGITS) -> DataFrame:
    """``(by, digest, entries)``: SHA-256 over a whole set in a fixed order, whatever its size.

    Entries fall into ranges by the hash of their key; a range's digest is over the sorted entries' hashes, and the
    set's is over its ranges' digests in order.  No row holds more than one range, or one digest a range.
    """
    hashed = entries.select(*by, F.sha2(key.cast("string"), 256).alias("_k"), F.sha2(text, 256).alias("_h"))
    together = lambda what: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(what)), lambda s: s["h"]), ""), 256)
    ranges = hashed.groupBy(*by, F.left("_k", F.lit(digits)).alias("_r")).agg(
        together(F.struct(F.col("_k").alias("k"), F.col("_h").alias("h"))).alias("_d"), F.count(F.lit(1)).alias("_n")
    )
    return ranges.groupBy(*by).agg(together(F.struct(F.col("_r").alias("k"), F.col("_d").alias("h"))).alias("digest"), F.coalesce(F.sum("_n"), F.lit(0)).alias("entries"))
