"""Runs of equal states in ordered sequences: episodes, remaining times, transitions, horizons.

The operators take an `entity` column (a run), order columns and a state column; time runs within an entity only. A
null state is a state of its own (compared null-safe).

One entity may hold a third of all rows, so none is ordered whole: rows fall into blocks by their first order column
(BLOCK_ROWS steps of a number, a day of a date or timestamp), each block is ordered by itself, and what passes from a
block to the next (its last state, how many rows and changes it has, where an episode ends that it leaves open) is
carried over in a table of one row per block. Rows are shuffled once, by entity and block; all that follows keeps that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, BLOCK_SECONDS = 65_536, 86_400


def block_of(df: DataFrame, order: Sequence[str]) -> Column:
    """Block of a row: never falls along the order; rows without a first order value come first, NaN last, as in a sort.

    The first order column is a number, a date or a timestamp; others have no blocks of even size and are refused."""
    kind = dict(df.dtypes)[order[0]]
    c = F.col(order[0])
    if kind.startswith("timestamp"):
        at = F.floor(F.unix_timestamp(c) / BLOCK_SECONDS)
    elif kind == "date":
        at = F.unix_date(c)
    elif kind in ("float", "double"):
        at = F.when(F.isnan(c), F.lit(1 << 62)).otherwise(F.floor(c / BLOCK_ROWS))
    elif kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        at = F.floor(c / BLOCK_ROWS)
    else:
        raise ValueError(f"{order[0]} is a {kind}; the first order column must be a number, a date or a timestamp")
    return F.coalesce(at.cast("bigint"), F.lit(-(1 << 62)))


def _keyed(df: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """df with _b, the block, and _e, the entity as a struct: structs with null are equal, so that windows, groups and joins
    by (_e, _b) all agree in their partitioning."""
    return df.withColumn("_b", block_of(df, order)).withColumn("_e", F.struct(F.col(entity).alias("key")))


def numbered(df: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """Adds rn: 0-based place of a row in its entity's sequence. Rows that tie in all order columns come in any order."""
    local = _keyed(df, entity, order).withColumn("_i", F.row_number().over(Window.partitionBy("_e", "_b").orderBy(*order)) - 1)
    upto = Window.partitionBy("_e").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = local.groupBy("_e", "_b").agg(F.count("*").alias("_n")).select("_e", "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_rows"))
    return local.join(sizes, ["_e", "_b"]).withColumn("rn", (F.col("_rows") + F.col("_i")).cast("bigint")).select(*df.columns, "rn")


def _chained(df: DataFrame, entity: str, order: Sequence[str], state: str, ends: bool = False) -> DataFrame:
    """df with rn, _next and _has_next of the row after, and the number of changes up to the row in _ep; if `ends`, also with
    the places of the last row of its episode in _end and of its entity in _size."""
    w = Window.partitionBy("_e", "_b").orderBy(*order)
    i = F.row_number().over(w)
    local = (
        _keyed(df, entity, order).withColumn("_i", i - 1)
        .withColumn("_new", F.when((i > 1) & F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1))
        .withColumn("_next", F.lead(state).over(w)).withColumn("_in", F.lead(F.lit(1)).over(w))
        .withColumn("_ch", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # the block's first row counts as new in _ch; whether it is, the block before tells
    held = F.struct(F.col(state).alias("s"))
    blocks = local.groupBy("_e", "_b").agg(
        F.count("*").alias("_n"), F.sum("_new").alias("_k"), F.min(F.when((F.col("_new") == 1) & (F.col("_i") > 0), F.col("_i"))).alias("_second"),
        F.max(F.when(F.col("_i") == 0, held)).alias("_first"), F.max(F.when(F.col("_in").isNull(), held)).alias("_last"),
    )
    chain = Window.partitionBy("_e").orderBy("_b")
    upto = chain.rowsBetween(Window.unboundedPreceding, -1)
    before = F.lag("_last").over(chain)
    blocks = (
        blocks.withColumn("_same", F.when(before.isNotNull() & before["s"].eqNullSafe(F.col("_first")["s"]), 1).otherwise(0))
        .withColumn("_rows", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        .withColumn("_goes_on", F.lead("_same", 1, 0).over(chain) == 1).withColumn("_after", F.lead("_first").over(chain))
        .withColumn("_eps", F.coalesce(F.sum(F.col("_k") - F.col("_same")).over(upto), F.lit(0)) - F.col("_same"))
    )
    if ends:
        # where the block's first episode ends, if it ends here; the last one ends where the first of a later block does
        here = F.col("_rows") + F.coalesce("_second", F.when(~F.col("_goes_on"), F.col("_n"))) - 1
        later = Window.partitionBy("_e").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("_here", here).withColumn("_size", F.sum("_n").over(Window.partitionBy("_e")) - 1)
        blocks = blocks.withColumn("_tail", F.when(F.col("_goes_on"), F.last("_here", ignorenulls=True).over(later)).otherwise(F.col("_rows") + F.col("_n") - 1))
        local = local.withColumn("_till", F.max("_i").over(Window.partitionBy("_e", "_b", "_ch")))
    carried = ["_rows", "_eps", "_after"] + (["_k", "_tail", "_size"] if ends else [])
    rows = (
        local.join(blocks.select("_e", "_b", *carried), ["_e", "_b"])
        .withColumn("rn", (F.col("_rows") + F.col("_i")).cast("bigint"))
        .withColumn("_ep", (F.col("_eps") + F.col("_ch")).cast("bigint"))
        .withColumn("_has_next", F.col("_in").isNotNull() | F.col("_after").isNotNull())
        .withColumn("_next", F.when(F.col("_in").isNotNull(), F.col("_next")).otherwise(F.col("_after")["s"]))
    )
    return rows.withColumn("_end", F.when(F.col("_ch") == F.col("_k"), F.col("_tail")).otherwise(F.col("_rows") + F.col("_till"))) if ends else rows


def with_episode(df: DataFrame, entity: str, order: Sequence[str], state: str) -> DataFrame:
    """Adds rn (0-based place in the sequence) and episode_id (0-based number of the run of equal states)."""
    return _chained(df, entity, order, state).withColumn("episode_id", F.col("_ep") - 1).select(*df.columns, "rn", "episode_id")


def episodes(df: DataFrame, entity: str, order: Sequence[str], state: str, dt: float = 1.0) -> DataFrame:
    """One row per run of equal states: entity, episode_id, state, start_idx, len, duration = len * dt.

    The first and the last run count too. An empty input gives no rows.
    """
    marked = with_episode(df.select(entity, *order, state), entity, order, state)
    return marked.groupBy(entity, "episode_id", state).agg(
        F.min("rn").alias("start_idx"), F.count("*").alias("len"), (F.count("*") * F.lit(float(dt))).alias("duration")
    )


def episode_stats(eps: DataFrame, state: str) -> DataFrame:
    """Per state: number, mean, median (interpolated), population deviation, least, largest and total duration.

    The exact median keeps a state's distinct durations with their counts in one task: as many as there are lengths."""
    return eps.groupBy(state).agg(
        F.count("*").alias("n_episodes"), F.avg("duration").alias("mean_escape_time"), F.median("duration").alias("median_escape_time"),
        F.stddev_pop("duration").alias("std_escape_time"), F.min("duration").alias("min_escape_time"),
        F.max("duration").alias("max_escape_time"), F.sum("duration").alias("total_time_in_state"),
    )


def remaining_time(df: DataFrame, entity: str, order: Sequence[str], state: str, target, dt: float = 1.0) -> DataFrame:
    """Adds `remaining`: time to the end of the run at every row in the target state, this row included; null elsewhere.

    The last run ends with the data. A target that never occurs gives nulls throughout.
    """
    left = F.col("_end") - F.col("rn") + 1
    rows = _chained(df, entity, order, state, ends=True).withColumn("episode_id", F.col("_ep") - 1)
    return rows.withColumn("remaining", F.when(F.col(state) == target, left * F.lit(float(dt)))).select(*df.columns, "rn", "episode_id", "remaining")


def steps_to_change(df: DataFrame, entity: str, order: Sequence[str], state: str) -> DataFrame:
    """Adds `steps`: rows until the state changes next; 0 throughout the last run of an entity."""
    rows = _chained(df, entity, order, state, ends=True).withColumn("episode_id", F.col("_ep") - 1)
    steps = F.when(F.col("_end") == F.col("_size"), F.lit(0)).otherwise(F.col("_end") + 1 - F.col("rn")).cast("bigint")
    return rows.withColumn("steps", steps).select(*df.columns, "rn", "episode_id", "steps")


def transition_matrix(df: DataFrame, entity: str, order: Sequence[str], state: str) -> DataFrame:
    """from_state, to_state, n, p: how often a state follows another in a sequence, and its share of all that follow."""
    pairs = _chained(df.select(entity, *order, state), entity, order, state).filter("_has_next")
    counts = pairs.groupBy(F.col(state).alias("from_state"), F.col("_next").alias("to_state")).agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))


def horizon(df: DataFrame, entity: str, order: Sequence[str], error: Column, threshold: float, per_unit: float = 1.0) -> DataFrame:
    """Per entity: 0-based place of the first error above the threshold, or the sequence's length if there is none,
    divided by `per_unit` (steps in a unit of time). A null error is not above it."""
    marked = numbered(df.select(entity, *order, error.alias("_error")), entity, order)
    first = F.coalesce(F.min(F.when(F.col("_error") > threshold, F.col("rn"))), F.count("*"))
    return marked.groupBy(entity).agg((first / F.lit(float(per_unit))).alias("horizon"))


def episode_histogram(eps: DataFrame, state: str, dt: float = 1.0) -> DataFrame:
    """Per state: number of episodes by unit bins of the duration from the state's least one; a last bin of which the
    right edge is closed takes the largest duration. Bins have the width 1 whatever dt is."""
    ends = eps.groupBy(F.col(state).alias("_s")).agg(F.min("duration").alias("lo"), F.max("duration").alias("_hi"))
    rows = eps.groupBy(state, "duration").agg(F.count("*").alias("_m"))
    rows = rows.join(ends, rows[state].eqNullSafe(ends["_s"]))
    bins = F.greatest(F.ceil(F.col("_hi") - F.col("lo")), F.lit(1))
    at = F.least(F.floor(F.col("duration") - F.col("lo")), bins - 1).cast("bigint")
    return rows.groupBy(state, at.alias("bin"), "lo").agg(F.sum("_m").alias("n"))


def regime_report(df: DataFrame, entity: str, order: Sequence[str], state: str, dt: float = 1.0) -> DataFrame:
    """Statistics of every state's episodes, with the share of the total time that the state takes."""
    stats = episode_stats(episodes(df, entity, order, state, dt), state)
    total = stats.agg(F.sum("total_time_in_state").alias("total"))
    return stats.crossJoin(F.broadcast(total)).withColumn("share", F.col("total_time_in_state") / F.col("total")).drop("total")
