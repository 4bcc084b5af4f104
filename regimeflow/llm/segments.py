"""Problem 5: collapse repeated consecutive events by optimal segmentation (pruned dynamic programming).

The samples of an entity, in order of position, are cut into segments. A segment costs the weight of its samples that
differ from its most frequent symbol, plus `penalty` for its boundary; between samples farther apart than `max_gap`
a boundary is free and always set. The sum of the costs is minimal. The search is the pruned one: a start that can't
win any more, because its cost so far exceeds the best by the penalty, is dropped.

An entity may hold a third of all rows, so none goes to one task whole. Positions are cut into blocks, and two facts
keep the result exact:
- within a run of equal symbols no boundary can pay, since the cost is concave in the boundary's place; so runs, not
  samples, are searched;
- a run heavier than twice the penalty keeps its own symbol in every optimum (to relabel it costs more than two
  boundaries), so it separates what lies before it from what lies after.
Each block is solved between its first and last heavy run; what lies between those of neighbouring blocks is a piece
of its own, solved in a second step; segments that share a heavy run are then joined. Only the few rows at the ends of
blocks are ordered per entity.

A piece may reach over many blocks without a heavy run. It is cut at the blocks' ends: each part tells, for every two
symbols, the least cost of beginning in one and ending in the other; these small matrices, one for a block, are chained
to the symbols in force at the ends (a row per block is ordered per piece, not the samples), and with them as fixed
neighbours each part is searched like any other piece. A piece of more than SYMBOLS symbols is searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import arrow_groups, materialize, resolved_state, state_samples_sql, table
from ..operators.stats import lead_pairs

BLOCK = 4096
#: Below half a sample's weight, so that a single sample of another state still is an episode of its own.
EXACT_PENALTY = 0.49
MAX_GAP = 5
#: Symbols of a long piece, at most, for which costs of all pairs are chained.
SYMBOLS = 64
#: Penalty at which a few samples of another state are near-identical to their neighbours.
NEAR_PENALTY = 2.5

OUT = "entity bigint, block bigint, kind string, first_pos bigint, last_pos bigint, n bigint, symbol int, n_same bigint, join_left boolean, join_right boolean"
OUT_ARROW = pa.schema([("entity", pa.int64()), ("block", pa.int64()), ("kind", pa.string()), ("first_pos", pa.int64()), ("last_pos", pa.int64()), ("n", pa.int64()), ("symbol", pa.int32()), ("n_same", pa.int64()), ("join_left", pa.bool_()), ("join_right", pa.bool_())])


def pelt(symbols: np.ndarray, weights: np.ndarray, penalty: float) -> list[tuple[int, int]]:
    """Optimal segments [a, b) of runs given by symbol and weight; of equal costs the one with the latest start wins."""
    m = len(symbols)
    if m <= 1:
        return [(0, m)] * m
    names, codes = np.unique(symbols, return_inverse=True)
    sums = np.zeros((m + 1, len(names)))
    sums[np.arange(1, m + 1), codes] = weights
    sums = sums.cumsum(axis=0)
    total = sums.sum(axis=1)
    best, back = np.empty(m + 1), np.zeros(m + 1, dtype=int)
    best[0] = -penalty
    starts = np.zeros(1, dtype=int)
    for j in range(1, m + 1):
        cost = best[starts] + (total[j] - total[starts]) - (sums[j] - sums[starts]).max(axis=1)
        at = len(starts) - 1 - int(np.argmin(cost[::-1]))
        best[j], back[j] = cost[at] + penalty, starts[at]
        starts = np.append(starts[cost <= best[j]], j)
    cuts, j = [], m
    while j:
        cuts.append((int(back[j]), j))
        j = back[j]
    return cuts[::-1]


class Runs:
    """Runs of equal symbols in order: first and last position, samples, symbol."""

    def __init__(self, first, last, n, symbol):
        self.first, self.last, self.n, self.symbol = first, last, n, symbol

    @classmethod
    def of(cls, pos: np.ndarray, symbol: np.ndarray, max_gap: int, n=None, last=None) -> Runs:
        """Join neighbours of equal symbol; `n` and `last` are given where the input is runs already."""
        last = pos if last is None else last
        n = np.ones(len(pos), dtype=np.int64) if n is None else n
        new = np.ones(len(pos), dtype=bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (pos[1:] - last[:-1] > max_gap)
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(pos)) - 1
        return cls(pos[at], last[ends], np.add.reduceat(n, at), symbol[at])

    def part(self, a: int, b: int) -> Runs:
        return Runs(self.first[a:b], self.last[a:b], self.n[a:b], self.symbol[a:b])

    def sequences(self, max_gap: int) -> list[Runs]:
        cuts = np.flatnonzero(self.first[1:] - self.last[:-1] > max_gap) + 1
        edges = [0, *cuts.tolist(), len(self.first)]
        return [self.part(a, b) for a, b in zip(edges, edges[1:])]

    def segments(self, weight: float, penalty: float) -> list[tuple[int, int, int, int, int]]:
        """(first, last, n, symbol, n_same) of each optimal segment; of equally frequent symbols the smallest."""
        out = []
        for a, b in pelt(self.symbol, self.n * weight, penalty):
            names, codes = np.unique(self.symbol[a:b], return_inverse=True)
            count = np.bincount(codes, weights=self.n[a:b])
            k = int(count.argmax())
            out.append((int(self.first[a]), int(self.last[b - 1]), int(self.n[a:b].sum()), int(names[k]), int(count[k])))
        return out


def _solve_block(runs: Runs, weight: float, penalty: float, max_gap: int) -> list[tuple]:
    """Rows of a block: solved segments ("seg"), open runs before ("head") and after ("tail"), or all open ("through")."""
    rows: list[tuple] = []
    seqs = runs.sequences(max_gap)
    for i, seq in enumerate(seqs):
        open_left, open_right = i == 0, i == len(seqs) - 1
        heavy = np.flatnonzero(seq.n * weight > 2 * penalty)
        m = len(seq.n)
        if not len(heavy) and open_left and open_right:
            rows += [("through", *x, False, False) for x in _raw(seq, 0, m)]
            continue
        if not len(heavy) and open_left:
            lo = hi = m
        elif not len(heavy) and open_right:
            lo = hi = 0
        else:
            lo, hi = int(heavy[0]) if open_left else 0, int(heavy[-1]) + 1 if open_right else m
        pin_left, pin_right = open_left and lo < m, open_right and hi > 0
        segs = seq.part(lo, hi).segments(weight, penalty) if lo < hi else []
        rows += [("seg", *x, pin_left and k == 0, pin_right and k == len(segs) - 1) for k, x in enumerate(segs)]
        if open_left:
            rows += [("head", *x, False, False) for x in _raw(seq, 0, lo)]
            rows += [("head", *x, False, True) for x in _raw(seq, lo, lo + 1)] if pin_left else []
        if open_right:
            rows += [("tail", *x, True, False) for x in _raw(seq, hi - 1, hi)] if pin_right else []
            rows += [("tail", *x, False, False) for x in _raw(seq, hi, m)]
    return rows


def _raw(seq: Runs, a: int, b: int) -> list[tuple]:
    return [(int(seq.first[i]), int(seq.last[i]), int(seq.n[i]), int(seq.symbol[i]), int(seq.n[i])) for i in range(a, b)]


def _solve_piece(first_pos, last_pos, count, symbols, join_left, join_right, weight: float, penalty: float, max_gap: int) -> list[tuple]:
    """Segments of what lies between the heavy runs of neighbouring blocks, in order; a heavy run (a pin) marks joins only."""
    at_l, at_r = np.flatnonzero(join_left), np.flatnonzero(join_right)
    pin_l = (int(first_pos[at_l[0]]), int(last_pos[at_l[0]])) if len(at_l) else None
    pin_r = int(first_pos[at_r[0]]) if len(at_r) else None
    free = ~(join_left | join_right)
    rows = []
    for seq in Runs.of(first_pos, symbols, max_gap, count, last_pos).sequences(max_gap):
        for first, last, _, symbol, _ in seq.segments(weight, penalty):
            inside = free & (first_pos >= first) & (last_pos <= last)
            n = int(count[inside].sum())
            same = int(count[inside & (symbols == symbol)].sum())
            has_l, has_r = pin_l is not None and first <= pin_l[0] <= last, pin_r is not None and first <= pin_r <= last
            if n:
                rows.append((int(first_pos[inside][0]), int(last_pos[inside][-1]), n, symbol, same, has_l, has_r))
            elif has_l and has_r:
                rows.append((pin_l[1], pin_l[1], 0, symbol, 0, True, True))
    return rows


def end_costs(symbols: np.ndarray, weights: np.ndarray, alphabet: np.ndarray, penalty: float) -> np.ndarray:
    """Least cost of runs for each symbol in force before them (row) and at their end (column); a change just before the
    first run counts."""
    m = penalty * (1 - np.eye(len(alphabet)))
    for c, w in zip(np.searchsorted(alphabet, symbols), weights):
        m = np.minimum(m, m.min(axis=1, keepdims=True) + penalty)
        own = m[:, c].copy()
        m += w
        m[:, c] = own
    return m


PARTS = "entity bigint, piece bigint, block bigint, part int, first_pos bigint, last_pos bigint, pin_left int, pin_right int, alphabet array<int>, cost array<double>"
ENDS = "entity bigint, piece bigint, block bigint, part int, enter int, leave int, last_before bigint, first_after bigint"


def _chain(parts: pd.DataFrame, penalty: float, max_gap: int) -> pd.DataFrame:
    """Symbols in force at the ends of a piece's parts, of least cost over all; null where the neighbour part is too far or
    there is none."""
    parts = parts.sort_values(["block", "part"])
    k, n = len(parts["alphabet"].iloc[0]), len(parts)
    costs = np.stack(parts["cost"].to_list()).reshape(n, k, k)
    alphabet = np.asarray(parts["alphabet"].iloc[0])
    first, last = parts["first_pos"].to_numpy(), parts["last_pos"].to_numpy()
    cut = np.r_[True, first[1:] - last[:-1] > max_gap]
    value, back = np.zeros(k), np.zeros((n, k), dtype=int)
    if pd.notna(pin := parts["pin_left"].iloc[0]):
        value = np.where(alphabet == pin, 0.0, np.inf)
    starts = np.zeros(n, dtype=int)  # symbol at the end before a cut
    for i in range(n):
        if cut[i] and i:
            starts[i] = int(value.argmin())
            value = np.full(k, value.min())
        through = value[:, None] + costs[i]
        back[i] = through.argmin(axis=0)
        value = through.min(axis=0)
    if pd.notna(pin := parts["pin_right"].iloc[-1]):
        value = value + penalty * (alphabet != pin)
    enter, leave, at = [None] * n, [None] * n, int(value.argmin())
    for i in range(n - 1, -1, -1):
        if i < n - 1 and not cut[i + 1]:
            leave[i] = int(alphabet[at])
        at = int(back[i, at])
        if i and not cut[i]:
            enter[i] = int(alphabet[at])
        elif i:
            at = starts[i]
    keys = parts[["entity", "piece", "block", "part"]]
    before, after = pd.array([None, *last[:-1]], "Int64"), pd.array([*first[1:], None], "Int64")
    return keys.assign(enter=pd.array(enter, "Int32"), leave=pd.array(leave, "Int32"), last_before=before, first_after=after)


def _cut_long(pieced: DataFrame, weight: float, penalty: float, max_gap: int) -> DataFrame:
    """Raw rows of pieces with the number `part` of what is searched together: 0, and for long pieces the parts of blocks,
    with rows for the symbols in force at their ends."""
    cols = ["entity", "piece", "block", "part", "first_pos", "last_pos", "n", "symbol", "join_left", "join_right"]
    part = F.when(F.col("kind") == "tail", 1).when(F.col("kind") == "through", 2).otherwise(3)
    key = ["entity", "piece"]
    long = pieced.filter("kind = 'through'").select(*key).distinct()
    symbols = pieced.join(long, key, "left_semi").select(*key, "symbol").distinct()
    few = symbols.groupBy(*key).count().filter(F.col("count") <= SYMBOLS).select(*key)
    alphabet = symbols.join(few, key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list("symbol")).alias("alphabet"))
    rows = materialize(pieced.withColumn("part", part).join(alphabet, key, "left"), "pieced")
    short = rows.filter("alphabet IS NULL").withColumns({"block": F.lit(0).cast("bigint"), "part": F.lit(0)}).select(*cols)
    parts = rows.filter("alphabet IS NOT NULL")

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in arrow_groups(batches, 4):
            entity, piece, block, part, first, last, n, symbol, left, right, alphabet = cols
            free, known = ~(left | right), np.asarray(alphabet[0])
            m = end_costs(symbol[free], n[free] * weight, known, penalty)
            pins = [pa.array([int(symbol[at][0]) if at.any() else None], pa.int32()) for at in (left, right)]
            heads = [pa.array([int(c[0])], t) for c, t in ((entity, pa.int64()), (piece, pa.int64()), (block, pa.int64()), (part, pa.int32()), (first, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*heads, pa.array([int(last[-1])]), *pins, pa.array([known.tolist()], pa.list_(pa.int32())), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))],
                ["entity", "piece", "block", "part", "first_pos", "last_pos", "pin_left", "pin_right", "alphabet", "cost"],
            )

    keys = ["entity", "piece", "block", "part"]
    made = parts.select(*cols, "alphabet").repartition(*keys).sortWithinPartitions(*keys, "first_pos").mapInArrow(costs, PARTS)
    ends = materialize(made.groupBy(*key).applyInPandas(lambda pdf: _chain(pdf, penalty, max_gap), ENDS), "ends")
    heavy = F.lit(int(2 * penalty / weight) + 2).cast("bigint")

    def pin(symbol: str, pos: str, left: bool) -> DataFrame:
        place = [F.col(pos).alias("first_pos"), F.col(pos).alias("last_pos")]
        return ends.filter(F.col(symbol).isNotNull()).select(*keys, *place, heavy.alias("n"), F.col(symbol).alias("symbol"), F.lit(left).alias("join_left"), F.lit(not left).alias("join_right"))

    return short.unionByName(parts.select(*cols)).unionByName(pin("enter", "last_before", True)).unionByName(pin("leave", "first_after", False))


def segment(samples: DataFrame, penalty: float, weight: float = 1.0, max_gap: int = MAX_GAP, block: int = BLOCK) -> DataFrame:
    """Optimal segments of every entity.

    `samples` has entity BIGINT, pos BIGINT, symbol INT; more columns are ignored. Rows with a null take no part; of
    rows that repeat entity and pos the largest symbol counts, once. Result: entity, first_pos, last_pos, n (samples),
    symbol (the most frequent one), n_same (samples that have it). An empty table gives no rows.
    """

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), OUT_ARROW.types)], schema=OUT_ARROW)

    def solve(batches: Iterator[pa.RecordBatch], one, keys: int) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for cols in arrow_groups(batches, keys):
            rows += one(*cols)
            if len(rows) > 50_000:
                yield as_batch(rows)
                rows = []
        if rows:
            yield as_batch(rows)

    def block_rows(entity, at, pos, symbol) -> list[tuple]:
        head = (int(entity[0]), int(at[0]))
        return [head + r for r in _solve_block(Runs.of(pos, symbol, max_gap), weight, penalty, max_gap)]

    def piece_rows(entity, piece, block, part, *cols) -> list[tuple]:
        head = (int(entity[0]), int(block[0]) if part[0] else -1 - int(piece[0]), "piece")
        return [head + r for r in _solve_piece(*cols, weight, penalty, max_gap)]

    ordered = (
        samples.select("entity", "pos", "symbol").dropna()
        .withColumn("block", F.floor(F.col("pos") / block))
        .repartition("entity", "block")
        .groupBy("entity", "block", "pos").agg(F.max("symbol").alias("symbol"))
        .select("entity", "block", "pos", "symbol")
        .sortWithinPartitions("entity", "block", "pos")
    )
    solved = materialize(ordered.mapInArrow(lambda it: solve(it, block_rows, 2), OUT), "segments")
    inner = solved.filter("kind = 'seg' AND NOT join_left AND NOT join_right")
    edge = solved.filter("kind = 'seg' AND (join_left OR join_right)")
    raw = solved.filter("kind <> 'seg'")
    # a block with a cut ends the piece before it and begins the next
    cuts = raw.groupBy("entity", "block").agg(F.max(F.when(F.col("kind") == "through", 0).otherwise(1)).alias("cut"))
    no_raw = edge.select("entity", "block").distinct().withColumn("cut", F.lit(1))
    upto = Window.partitionBy("entity").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        cuts.unionByName(no_raw).groupBy("entity", "block").agg(F.max("cut").alias("cut"))
        .withColumn("before", F.coalesce(F.sum("cut").over(upto), F.lit(0)))
    )
    piece = F.col("before") + F.when(F.col("kind") == "tail", 1).otherwise(0)
    pieced = raw.join(cuts, ["entity", "block"]).withColumn("piece", piece)
    cols = ["first_pos", "last_pos", "n", "symbol", "join_left", "join_right"]
    keys = ["entity", "piece", "block", "part"]
    if raw.filter("kind = 'through'").head(1):
        pieced = _cut_long(pieced.select("entity", "piece", "block", "kind", *cols), weight, penalty, max_gap)
    else:
        pieced = pieced.select("entity", "piece", F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("part"), *cols)
    between = (
        pieced.select(*keys, *cols).repartition(*keys).sortWithinPartitions(*keys, "first_pos")
        .mapInArrow(lambda it: solve(it, piece_rows, 4), OUT)
    )
    w = Window.partitionBy("entity").orderBy("first_pos", F.col("kind") == "piece")
    kind, left, right = F.col("kind"), F.col("join_left"), F.col("join_right")
    # joined are a block's segment and a piece's, or those of two parts of a piece; where a part begins with a symbol that its
    # forerunner, of fixed rows only, ends with but doesn't show, the row before has another symbol
    other = (F.lag("symbol").over(w) == F.col("symbol")) & ((F.lag("kind").over(w) != kind) | (kind == "piece") & (F.lag("block").over(w) != F.col("block")))
    joined = (
        edge.unionByName(between.filter("join_left OR join_right"))
        .withColumn("linked", left & F.lag(right, 1, False).over(w) & other)
        .withColumn("at", F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(w))
        .groupBy("entity", "at").agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.sum("n").alias("n"), F.max("symbol").alias("symbol"), F.sum("n_same").alias("n_same"))
    )
    cols = ["entity", "first_pos", "last_pos", "n", "symbol", "n_same"]
    alone = inner.unionByName(between.filter("NOT join_left AND NOT join_right"))
    return alone.select(*cols).unionByName(joined.select(*cols))


def state_events(regime: DataFrame) -> DataFrame:
    state = resolved_state(F.col("state"), F.col("label"))
    return regime.select(F.col("run_id").cast("bigint").alias("entity"), F.col("t_idx").alias("pos"), state.alias("symbol"))


def episodes(regime: DataFrame, penalty: float, max_gap: int = MAX_GAP) -> DataFrame:
    """run_id, start_idx, end_idx, state, n_samples, n_same, duration of every episode; sample times are t_idx."""
    return segment(state_events(regime), penalty, max_gap=max_gap).select(
        F.col("entity").cast("int").alias("run_id"), F.col("first_pos").alias("start_idx"), F.col("last_pos").alias("end_idx"), F.col("symbol").alias("state"),
        F.col("n").alias("n_samples"), "n_same", (F.col("last_pos") - F.col("first_pos")).cast("double").alias("duration"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = episodes(table(spark, sf_dir, "regime"), EXACT_PENALTY)
    return found.filter("n_samples >= 2").select("run_id", "start_idx", "end_idx")


def p5_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(table(spark, sf_dir, "regime"), EXACT_PENALTY)


def p5_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-identical events: stretches with a few samples of another state count as one episode."""
    return episodes(table(spark, sf_dir, "regime"), NEAR_PENALTY)


def costs(found: DataFrame, penalty: float, max_gap: int = MAX_GAP) -> DataFrame:
    """(run_id, cost): what the episodes of each run cost: samples of other states, and a penalty for each boundary that no
    gap sets."""
    pairs = lead_pairs(found.select("run_id", "start_idx", "end_idx"), ["start_idx"], order="start_idx")
    paid = pairs.filter(F.col("next_start_idx") - F.col("end_idx") <= max_gap).select("run_id", F.lit(penalty).alias("c"))
    return found.select("run_id", (F.col("n_samples") - F.col("n_same")).cast("double").alias("c")).unionByName(paid).groupBy("run_id").agg(F.sum("c").alias("cost"))


def p5_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of every run's near-identical episodes; SQL has the least cost that is possible."""
    return costs(materialize(p5_smoothed(spark, sf_dir), "episodes"), NEAR_PENALTY)


_ISLANDS = f"""
WITH st AS ({state_samples_sql()}),
l AS (SELECT *, lag(state) OVER w AS ps, lag(t_idx) OVER w AS pt FROM st WINDOW w AS (PARTITION BY run_id ORDER BY t_idx)),
g AS (SELECT *, sum(CASE WHEN ps = state AND t_idx - pt <= {MAX_GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY t_idx) AS ep FROM l)
SELECT run_id, CAST(min(t_idx) AS BIGINT) AS start_idx, CAST(max(t_idx) AS BIGINT) AS end_idx, max(state) AS state, CAST(count(*) AS BIGINT) AS n_samples,
  CAST(count(*) AS BIGINT) AS n_same, CAST(max(t_idx) - min(t_idx) AS DOUBLE) AS duration FROM g GROUP BY run_id, ep"""
P5_EPISODES_SQL = _ISLANDS
P5_FOUND_SQL = f"SELECT run_id, start_idx, end_idx FROM ({_ISLANDS}) WHERE n_samples >= 2"


def _costs_sql() -> str:
    """The least cost by the plain recurrence over runs of equal state: per state, the cost with it last."""
    v = [f"v{k}" for k in (1, 2, 3, 4)]
    low = f"least({', '.join(v)})"
    step = ", ".join(f"CASE WHEN gap > {MAX_GAP} THEN {low} ELSE least(v{k}, {low} + {NEAR_PENALTY}) END + CASE WHEN state = {k} THEN 0 ELSE n END AS v{k}" for k in (1, 2, 3, 4))
    begin = ", ".join(f"CAST(CASE WHEN state = {k} THEN 0 ELSE n END AS DOUBLE) AS v{k}" for k in (1, 2, 3, 4))
    return f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT run_id, state, n_samples AS n, row_number() OVER w AS i, start_idx - lag(end_idx) OVER w AS gap
  FROM ({_ISLANDS}) WINDOW w AS (PARTITION BY run_id ORDER BY start_idx)),
r AS (SELECT run_id, i, {begin} FROM e WHERE i = 1 UNION ALL SELECT e.run_id, e.i, {step} FROM r JOIN e ON e.run_id = r.run_id AND e.i = r.i + 1)
SELECT run_id, {low} AS cost FROM r JOIN (SELECT run_id, max(i) AS i FROM e GROUP BY run_id) USING (run_id, i)"""


P5_COSTS_SQL = _costs_sql()
