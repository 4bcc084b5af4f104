"""Queries of the core operators over the given tables, and their SQL where SQL can state them.

Sums of doubles depend on the order of addition, so results made of them are rounded, in both languages alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import KEY, label_state, materialize, new_path, state_samples, state_samples_sql, table
from ..functions import systems as sy
from ..functions.vectors import normalize, state_columns
from ..operators import density, forecast, grids, hmm, lyapunov, reservoir, simulate, spectral, stats
from ..operators import episodes as ep
from ..sources import saved_files as sf
from ..sources import results, state_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": sf.p4_found, "p4_samples": sf.p4_samples, "p4_files": sf.p4_files}
SQL: dict[str, str] = {"p4_found": sf.P4_FOUND_SQL}
XS = stats.XS
EVENTS = ("user_id", ["ts", "event_id"], "event_type")
RUNS = ("run_id", ["t_idx"], "state")
#: Red noise: correlation. Horizon: error and steps of a unit. Density: radius.
RED, FAR, PER_UNIT, RADIUS = 0.5, 300.0, 10.0, 0.02


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def trajectory(spark: SparkSession, d: str) -> DataFrame:
    return stats.clean_trajectory(table(spark, d, "trajectory"))


def regime(spark: SparkSession, d: str) -> DataFrame:
    return state_samples(table(spark, d, "regime"))


def with_height(spark: SparkSession, d: str) -> DataFrame:
    """Clean samples with the orography's height of their run."""
    runs = table(spark, d, "run_info").select("run_id", "g").filter("g IS NOT NULL AND NOT isnan(g)")
    return trajectory(spark, d).join(runs, "run_id")


HEIGHT_SQL = f"(SELECT t.*, r.g FROM {stats.CLEAN_SQL} t JOIN run_info r USING (run_id) WHERE r.g IS NOT NULL AND NOT isnan(r.g))"

# ---- episodes

_EV = "SELECT user_id AS entity, event_type AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST) - 1 AS rn FROM events"
_RG = f"SELECT run_id AS entity, state, t_idx, row_number() OVER (PARTITION BY run_id ORDER BY t_idx) - 1 AS rn FROM ({state_samples_sql()})"


def _runs_sql(seq: str) -> str:
    """Rows with their episode's number."""
    return f"""(SELECT *, CAST(sum(ch) OVER (PARTITION BY entity ORDER BY rn) AS BIGINT) - 1 AS ep FROM (
      SELECT *, CASE WHEN rn > 0 AND lag(state) OVER (PARTITION BY entity ORDER BY rn) IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS ch FROM ({seq})))"""


def _episodes_sql(seq: str) -> str:
    return f"(SELECT entity, ep, state, CAST(min(rn) AS BIGINT) AS start_idx, CAST(count(*) AS BIGINT) AS len, CAST(count(*) AS DOUBLE) AS duration FROM {_runs_sql(seq)} GROUP BY ALL)"


_STATS = "CAST(count(*) AS BIGINT) AS n_episodes, round(avg(duration), 6) AS mean_escape_time, round(median(duration), 6) AS median_escape_time, round(stddev_pop(duration), 6) AS std_escape_time, min(duration) AS min_escape_time, max(duration) AS max_escape_time, sum(duration) AS total_time_in_state"


@query(f"SELECT state AS event_type, {_STATS} FROM {_episodes_sql(_EV)} GROUP BY state")
def episode_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ep.episode_stats(ep.episodes(table(spark, d, "events"), *EVENTS), "event_type"))


@query(f"SELECT CAST(entity AS INTEGER) AS run_id, ep AS episode_id, state, start_idx, len, duration FROM {_episodes_sql(_RG)}")
def episodes(spark: SparkSession, d: str) -> DataFrame:
    return ep.episodes(regime(spark, d), *RUNS)


@query(f"""SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(count(*) OVER (PARTITION BY entity, ep) - row_number() OVER (PARTITION BY entity, ep ORDER BY rn) + 1 AS DOUBLE) END AS remaining
  FROM {_runs_sql(_EV.replace("SELECT user_id", "SELECT event_id, event_type, user_id"))}""")
def remaining_time(spark: SparkSession, d: str) -> DataFrame:
    return ep.remaining_time(table(spark, d, "events"), *EVENTS, target="click").select("event_id", "remaining")


@query(f"""SELECT CAST(entity AS INTEGER) AS run_id, t_idx, CAST(CASE WHEN ep = max(ep) OVER (PARTITION BY entity) THEN 0 ELSE max(rn) OVER (PARTITION BY entity, ep) + 1 - rn END AS BIGINT) AS steps FROM {_runs_sql(_RG)}""")
def steps_to_change(spark: SparkSession, d: str) -> DataFrame:
    return ep.steps_to_change(regime(spark, d), *RUNS).select("run_id", "t_idx", "steps")


@query(f"""SELECT from_state, to_state, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS p FROM (
  SELECT from_state, to_state, count(*) AS n FROM (SELECT state AS from_state, lead(state) OVER w AS to_state, lead(1) OVER w AS has FROM ({_RG}) WINDOW w AS (PARTITION BY entity ORDER BY rn)) WHERE has = 1 GROUP BY ALL)""")
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ep.transition_matrix(regime(spark, d), *RUNS))


@query(f"""SELECT user_id, coalesce(min(CASE WHEN value > {FAR} THEN i END), count(*)) / {PER_UNIT} AS horizon FROM (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST) - 1 AS i FROM events) GROUP BY user_id""")
def prediction_horizon(spark: SparkSession, d: str) -> DataFrame:
    return ep.horizon(table(spark, d, "events"), "user_id", EVENTS[1], F.col("value"), FAR, PER_UNIT)


@query(f"""SELECT event_type, CAST(least(floor(duration - lo), greatest(ceil(hi - lo), 1) - 1) AS BIGINT) AS bin, lo, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT state AS event_type, duration, min(duration) OVER (PARTITION BY state) AS lo, max(duration) OVER (PARTITION BY state) AS hi FROM {_episodes_sql(_EV)}) GROUP BY ALL""")
def episode_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ep.episode_histogram(ep.episodes(table(spark, d, "events"), *EVENTS), "event_type")


@query(f"SELECT *, round(total_time_in_state / sum(total_time_in_state) OVER (), 6) AS share FROM (SELECT state, {_STATS} FROM {_episodes_sql(_RG)} GROUP BY state)")
def regime_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ep.regime_report(regime(spark, d), *RUNS))


# ---- statistics, grids, joins

_LONG = " UNION ALL ".join(f"SELECT '{c}' AS var, {c} AS v FROM t" for c in XS)


@query(f"""WITH t AS (SELECT {", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in XS)} FROM trajectory)
SELECT var, CAST(count(v) AS BIGINT) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(v) - min(v), 6) AS range, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(sqrt(avg(v * v)), 6) AS rms FROM ({_LONG}) GROUP BY var""")
def column_ranges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.ranges(table(spark, d, "trajectory"), XS))


@query(f"""WITH t AS {stats.CLEAN_SQL} SELECT run_id, t_idx, {", ".join(f"round(({c} - (SELECT avg({c}) FROM t)) / (SELECT stddev_pop({c}) FROM t), 6) AS {c}" for c in XS)} FROM t""")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.standardize(trajectory(spark, d), XS))


@query(f"""WITH t AS {stats.CLEAN_SQL} {" UNION ALL ".join(f"SELECT {i + 1} AS i, {j + 1} AS j, round(sum({XS[i]} * {XS[j]}), 6) AS v FROM t" for i in range(6) for j in range(i, 6))}""")
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.gram(trajectory(spark, d), [F.col(c) for c in XS]))


_ALL = [(XS[i], XS[j]) for i in range(6) for j in range(i, 6)]


@query(f"""WITH t AS {stats.CLEAN_SQL} {" UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(covar_samp({a}, {b}), 6) AS cov FROM t" for a, b in _ALL)}""")
def covariance_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Covariances that the principal components are made from."""
    row = trajectory(spark, d).agg(*(F.covar_samp(a, b).alias(f"p{k}") for k, (a, b) in enumerate(_ALL)))
    cells = F.array(*(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.round(f"p{k}", 6).alias("cov")) for k, (a, b) in enumerate(_ALL)))
    return row.select(F.inline(cells))


@query(f"""WITH c AS (SELECT var_samp(x_1) AS a, covar_samp(x_1, x_2) AS b, var_samp(x_2) AS d FROM {stats.CLEAN_SQL}),
e AS (SELECT (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS hi, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) AS lo, a + d AS s FROM c)
SELECT 1 AS mode, round(hi, 6) AS variance, round(hi / s, 6) AS share FROM e UNION ALL SELECT 2, round(lo, 6), round(lo / s, 6) FROM e""")
def eof2_variance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.eof(trajectory(spark, d), ["x_1", "x_2"], 2)[1].select("mode", "variance", "share"))


@query()
def eof_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.eof(trajectory(spark, d), XS, 3)[0].select("run_id", "t_idx", "PC1", "PC2", "PC3"))


@query()
def eof_patterns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.eof(trajectory(spark, d), XS, 6)[1])


@query(f"SELECT run_id, t_idx, {', '.join(f'round({c}, 6) AS {c}' for c in XS)} FROM {stats.CLEAN_SQL}")
def eof_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every sample again, from its scores, the patterns and the means: all six components lose nothing."""
    rows = trajectory(spark, d)
    scores, patterns = stats.eof(rows, XS, 6)
    # a row of means, and a row of the patterns as a matrix
    mean = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(XS)))
    loads = patterns.agg(*(F.array_sort(F.collect_list(F.struct("mode", c))).getField(c).alias(f"l{i}") for i, c in enumerate(XS)))
    back = [F.round(F.col(f"m{i}") + sum((F.col(f"PC{k + 1}") * F.col(f"l{i}")[k] for k in range(6)), F.lit(0.0)), 6) for i in range(6)]
    return scores.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(loads)).select(*KEY, *(F.when(b == 0, 0.0).otherwise(b).alias(c) for b, c in zip(back, XS)))


@query(f"""WITH t AS {stats.CLEAN_SQL} {" UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(covar_samp({a}, {b}), 6) AS cov FROM t" for a, b in _ALL)}""")
def eof_covariance(spark: SparkSession, d: str) -> DataFrame:
    """The covariances again, as sums over the patterns of variance and loadings."""
    patterns = stats.eof(trajectory(spark, d), XS, 6)[1]
    row = patterns.agg(*(F.sum(F.col("variance") * F.col(a) * F.col(b)).alias(f"p{k}") for k, (a, b) in enumerate(_ALL)))
    cells = F.array(*(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.round(f"p{k}", 6).alias("cov")) for k, (a, b) in enumerate(_ALL)))
    return row.select(F.inline(cells))


_COV = [f"covar_samp({a}, {b})" for a in XS for b in XS]


@query(f"""WITH t AS {stats.CLEAN_SQL} SELECT 'count' AS name, CAST(count(*) AS DOUBLE) AS v FROM t
UNION ALL SELECT 'variance', round({" + ".join(f"var_samp({c})" for c in XS)}, 6) FROM t
UNION ALL SELECT 'squared covariance', round({" + ".join(f"{c} * {c}" for c in _COV)}, 6) FROM t
UNION ALL SELECT 'greatest covariance of two scores', CAST(0 AS DOUBLE)""")
def eof_moments(spark: SparkSession, d: str) -> DataFrame:
    """What the scores of all components have in common with the samples: the sum of variances, and of squared covariances;
    and that no two scores have a covariance."""
    pcs = [f"PC{k + 1}" for k in range(6)]
    rows = stats.eof(trajectory(spark, d), XS, 6)[0]
    pairs = list(combinations(pcs, 2))
    row = rows.agg(F.count("*").cast("double").alias("n"), *(F.var_samp(c).alias(f"v_{c}") for c in pcs), *(F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs))
    v, c = [F.col(f"v_{x}") for x in pcs], [F.col(f"c_{a}_{b}") for a, b in pairs]
    squares = sum((x * x for x in v), F.lit(0.0)) + sum((2 * x * x for x in c), F.lit(0.0))
    values = {"count": F.col("n"), "variance": F.round(sum(v, F.lit(0.0)), 6), "squared covariance": F.round(squares, 6), "greatest covariance of two scores": F.round(F.greatest(*(F.abs(x) for x in c)), 6)}
    return row.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), x.alias("v")) for k, x in values.items()))))


@query(f"""WITH t AS {stats.CLEAN_SQL} {" UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(min({a}), 6) AS x_low, round(max({a}), 6) AS x_high, round(min({b}), 6) AS y_low, round(max({b}), 6) AS y_high FROM t" for a, b in combinations(XS, 2))}""")
def grid_extents(spark: SparkSession, d: str) -> DataFrame:
    """Extent of the grid of each pair of state columns, which are told by their prefix."""
    rows = trajectory(spark, d)
    pairs = list(combinations(state_columns(rows.columns), 2))
    cells = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), *(F.col(f"{n}_{c}").alias(x) for c, n, x in ((a, "lo", "x_low"), (a, "hi", "x_high"), (b, "lo", "y_low"), (b, "hi", "y_high")))) for a, b in pairs]
    return rounded(grids.extents(rows, state_columns(rows.columns)).select(F.inline(F.array(*cells))))


@query(f"""WITH p AS (SELECT x, y FROM (SELECT x_1 AS x, lead(x_1) OVER (PARTITION BY run_id ORDER BY t_idx) AS y FROM {stats.CLEAN_SQL}) WHERE y IS NOT NULL),
s AS (SELECT sum(x * x) + 1 AS a, sum(x) AS b, count(*) + 1 AS c, sum(x * y) AS p, sum(y) AS q FROM p)
SELECT CAST(1 AS DOUBLE) AS tikhonov, 1 AS i, 1 AS j, round((p * c - q * b) / (a * c - b * b), 6) AS w FROM s
UNION ALL SELECT CAST(1 AS DOUBLE), 2, 1, round((q * a - p * b) / (a * c - b * b), 6) FROM s""")
def ridge_next(spark: SparkSession, d: str) -> DataFrame:
    """Regression of the next sample of a run on this one."""
    return rounded(stats.ridge(stats.lead_pairs(trajectory(spark, d), ["x_1"]), ["x_1"], ["next_x_1"], [1.0]))


@query(SQL["ridge_next"].replace("CAST(1 AS DOUBLE) AS tikhonov, 1 AS i", "'w_out' AS matrix, 0 AS i").replace("1 AS j", "0 AS j").replace("CAST(1 AS DOUBLE), 2, 1,", "'w_out', 1, 0,").replace(" AS w FROM", " AS v FROM"))
def stored_readout(spark: SparkSession, d: str) -> DataFrame:
    """The readout of the regression of the next sample on this one, trained, stored as a network's, and read again."""
    w = stats.ridge(stats.lead_pairs(trajectory(spark, d), ["x_1"]), ["x_1"], ["next_x_1"], [1.0])
    path = new_path(spark, "network")
    out = np.array([r.w for r in w.orderBy("i").collect()])[:, None]  # two weights
    results.save_network(spark, path, reservoir.Reservoir(np.ones((1, 2)), np.zeros((1, 1)), 0.1, 1.0), out, np.ones(1), 0.9, -1.0, 1.0)
    kept = results.load_network(spark, path)
    if not np.array_equal(kept[1], out):
        raise RuntimeError("the network that was read isn't the one that was stored")
    return rounded(spark.read.parquet(f"{path}/entries").filter("matrix = 'w_out'"))


def _bin_sql(c: str, bins: int) -> str:
    return f"coalesce(CAST(floor(({c} - (SELECT min({c}) FROM t)) / nullif((SELECT max({c}) - min({c}) FROM t), 0) * {bins}) AS INTEGER), 0)"


def _hist_sql(bins: int, closed: bool, value: str | None) -> str:
    parts = []
    for a, b in combinations(XS, 2):
        x, y = _bin_sql(a, bins), _bin_sql(b, bins)
        if closed:
            x, y = f"least({x}, {bins - 1})", f"least({y}, {bins - 1})"
        parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, {x} AS bx, {y} AS \"by\"{f', {value} AS val' if value else ''} FROM t")
    mean = ", round(avg(val), 6) AS mean_value" if value else ""
    return f"SELECT var1, var2, bx, \"by\", CAST(count(*) AS BIGINT) AS n{mean} FROM ({' UNION ALL '.join(parts)}) WHERE bx < {bins} AND \"by\" < {bins} GROUP BY ALL"


@query(f"WITH t AS MATERIALIZED {stats.CLEAN_SQL} {_hist_sql(50, True, None)}")
def hist2d_closed(spark: SparkSession, d: str) -> DataFrame:
    return grids.hist2d(trajectory(spark, d), grids.all_pairs(XS), 50)


@query(f"WITH t AS MATERIALIZED (SELECT t.*, s.state FROM {stats.CLEAN_SQL} t JOIN ({state_samples_sql()}) s USING (run_id, t_idx)) {_hist_sql(40, False, 'state')}")
def hist2d_mean_open(spark: SparkSession, d: str) -> DataFrame:
    """Mean regime per cell, of samples joined with their regime by run and time."""
    return rounded(grids.hist2d_mean(trajectory(spark, d).join(regime(spark, d), ["run_id", "t_idx"]), grids.all_pairs(XS), "state", 40))



@query(f"""WITH t AS MATERIALIZED {stats.CLEAN_SQL}
SELECT a.run_id, a.t_idx, CAST(count(b.run_id) AS BIGINT) AS density FROM t a LEFT JOIN t b ON abs(a.x_1 - b.x_1) <= {RADIUS} AND abs(a.x_2 - b.x_2) <= {RADIUS} AND NOT (a.run_id = b.run_id AND a.t_idx = b.t_idx)
  AND sqrt({" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in XS)}) <= {RADIUS} GROUP BY ALL""")
def radius_density(spark: SparkSession, d: str) -> DataFrame:
    return density.radius_density(trajectory(spark, d), KEY, XS, RADIUS)


# ---- model

_SIX = sy.system("six_mode", g=None)
_G = [*XS, "g"]


@query(f"SELECT run_id, t_idx, {', '.join(f'round({e}, 9) AS dx_{i + 1}' for i, e in enumerate(sy.tendency_sql(_SIX, _G)))} FROM {HEIGHT_SQL}")
def model_tendency(spark: SparkSession, d: str) -> DataFrame:
    parts = sy.tendency(_SIX, [F.col(c) for c in _G])
    return with_height(spark, d).select("run_id", "t_idx", *(F.round(p, 9).alias(f"dx_{i + 1}") for i, p in enumerate(parts)))


@query(f"SELECT run_id, t_idx, {', '.join(f'round({e}, 9) AS j_{i + 1}_{j + 1}' for i, r in enumerate(sy.jacobian_sql(_SIX, _G)) for j, e in enumerate(r))} FROM {HEIGHT_SQL}")
def model_jacobian(spark: SparkSession, d: str) -> DataFrame:
    cells = sy.jacobian(_SIX, [F.col(c) for c in _G])
    return with_height(spark, d).select("run_id", "t_idx", *(F.round(c, 9).alias(f"j_{i + 1}_{j + 1}") for i, r in enumerate(cells) for j, c in enumerate(r)))


def _quadratic(s: sy.System) -> list[tuple[int, float, tuple[int, ...]]]:
    return [(row, c, f) for row, c, f in s.terms if len(f) == 2 and max(f) < s.dim]


def _quadratic_sql() -> str:
    s = sy.system("six_mode")
    rows = [" + ".join(["CAST(0 AS DOUBLE)", *(f"CAST({c!r} AS DOUBLE) * x_{a + 1} * x_{b + 1}" for r, c, (a, b) in _quadratic(s) if r == i)]) for i in range(s.dim)]
    return f"SELECT run_id, t_idx, {', '.join(f'round({e}, 9) AS q_{i + 1}' for i, e in enumerate(rows))} FROM {stats.CLEAN_SQL}"


@query(_quadratic_sql())
def quadratic_tendency(spark: SparkSession, d: str) -> DataFrame:
    """Quadratic part of the tendency of every sample, by terms derived from the wave modes; SQL has the model's formulas."""
    b = sy.RATIO
    terms = spectral.nonlinear_terms(spectral.triads(spectral.mode_table(spark), b), spectral.real_modes(spark, b), b).collect()  # ten terms
    rows = [[F.lit(r.v * 2 * b**3) * F.col(f"x_{r.k}") * F.col(f"x_{r.l}") for r in sorted(terms) if r.j == i] for i in range(1, 7)]
    return trajectory(spark, d).select(*KEY, *(F.round(sum(row, F.lit(0.0)), 9).alias(f"q_{i}") for i, row in enumerate(rows, 1)))


def _euler_sql(s: sy.System, dt: float, steps: int, start: str) -> str:
    new = []
    for i in range(s.dim):
        terms = "".join(f" + CAST({dt * c!r} AS DOUBLE)" + "".join(f" * y_{k + 1}" for k in f) for row, c, f in s.terms if row == i)
        new.append(f"y_{i + 1}{terms} AS y_{i + 1}")
    cols = ", ".join(f"y_{i + 1}" for i in range(s.dim))
    return f"""WITH RECURSIVE r AS (SELECT run_id, t_idx, 0 AS step, {start} FROM {stats.CLEAN_SQL}
      UNION ALL SELECT run_id, t_idx, step + 1, {", ".join(new)} FROM r WHERE step < {steps})
    SELECT run_id, t_idx, {", ".join(f"round({c}, 7) AS {c}" for c in cols.split(", "))} FROM r WHERE step = {steps}"""


def _euler(spark: SparkSession, d: str, s: sy.System, start: list[Column], dt: float, steps: int) -> DataFrame:
    y = simulate.euler_column(s, start, dt, steps)
    return trajectory(spark, d).select("run_id", "t_idx", y.alias("y")).select("run_id", "t_idx", *(F.round(F.col("y")[i], 7).alias(f"y_{i + 1}") for i in range(s.dim)))


_L63, _ROS, _L96 = sy.lorenz63(), sy.rossler(), sy.lorenz96(6)
_THREE = ["CAST(10 AS DOUBLE) * x_1", "CAST(10 AS DOUBLE) * x_2", "CAST(10 AS DOUBLE) * x_3 + 25"]


@query(_euler_sql(_L63, 0.005, 20, ", ".join(f"{e} AS y_{i + 1}" for i, e in enumerate(_THREE))))
def lorenz63_euler(spark: SparkSession, d: str) -> DataFrame:
    """Twenty Euler steps from every sample, its first three components as start."""
    return _euler(spark, d, _L63, [F.expr(e) for e in _THREE], 0.005, 20)


@query(_euler_sql(_ROS, 0.01, 20, "x_1 AS y_1, x_2 AS y_2, x_3 AS y_3"))
def rossler_euler(spark: SparkSession, d: str) -> DataFrame:
    return _euler(spark, d, _ROS, [F.col(c) for c in XS[:3]], 0.01, 20)


@query(_euler_sql(_L96, 0.005, 10, ", ".join(f"{c} AS y_{i + 1}" for i, c in enumerate(XS))))
def lorenz96_euler(spark: SparkSession, d: str) -> DataFrame:
    return _euler(spark, d, _L96, [F.col(c) for c in XS], 0.005, 10)


_NX, _NY = 4, 3
_PSI = " + ".join(
    f"{c} * " + (f"sqrt(2.0) * cos({n} * y / 0.5)" if m == 0 else f"sqrt(2.0) * cos({m} * x) * sin({n} * y / 0.5)") for c, (n, m) in zip(XS, grids.PLOT_MODES)
)


@query(f"""SELECT run_id, t_idx, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, round({_PSI}, 6) AS psi FROM (
  SELECT t.*, ix, iy, ix * (6.283185307179586 / {_NX - 1})::DOUBLE AS x, iy * (1.5707963267948966 / {_NY - 1})::DOUBLE AS y FROM {stats.CLEAN_SQL} t, range({_NX}) a(ix), range({_NY}) b(iy))""")
def streamfunction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grids.streamfunction(trajectory(spark, d), ["run_id", "t_idx"], XS, _NX, _NY))


def _coefficient_sql() -> str:
    c = sy.coefficients(g=1.0)
    return ", ".join(f"round(CAST({v!r} AS DOUBLE){' * g' if k.startswith('gamma') else ''}, 9) AS {k}" for k, v in c.items())


@query(f"SELECT run_id, {_coefficient_sql()} FROM run_info")
def spectral_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """The model's coefficients for the orography of every run."""
    c = sy.coefficients(g=1.0)
    return table(spark, d, "run_info").select("run_id", *(F.round(F.lit(v) * (F.col("g") if k.startswith("gamma") else F.lit(1.0)), 9).alias(k) for k, v in c.items()))


def _orography_sql() -> str:
    c = sy.coefficients(g=1.0)
    terms = {(1, 3): c["gammap1"], (3, 1): -c["gamma1"], (4, 6): c["gammap2"], (6, 4): -c["gamma2"]}
    return " UNION ALL ".join(f"SELECT run_id, {j} AS j, {k} AS k, round(g * CAST({v!r} AS DOUBLE), 9) AS v FROM run_info WHERE g IS NOT NULL" for (j, k), v in terms.items())


@query(_orography_sql())
def orographic_terms(spark: SparkSession, d: str) -> DataFrame:
    """Orographic terms of every run, derived from the wave modes by their integrals; SQL has them from the formulas."""
    b = sy.RATIO
    derived = spectral.orographic_terms(spectral.triads(spectral.mode_table(spark), b), spectral.real_modes(spark, b), b)
    runs = table(spark, d, "run_info").filter("g IS NOT NULL").select("run_id", "g")
    # four rows, whatever the tables hold; they go to every run
    return runs.join(F.broadcast(derived)).select("run_id", "j", "k", F.round(F.col("g") * F.col("v") * F.lit(b**3), 9).alias("v"))


@query(f"""SELECT user_id, CAST(max(n) AS INTEGER) AS n, round(sum(pow(CAST({RED} AS DOUBLE), n - i) * CASE WHEN i = 1 THEN 1.0 ELSE sqrt(CAST({1 - RED**2} AS DOUBLE)) END * v), 6) AS last FROM (
  SELECT user_id, coalesce(CASE WHEN isnan(value) THEN 0 ELSE value END, 0) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY user_id""")
def red_noise_last(spark: SparkSession, d: str) -> DataFrame:
    got = simulate.red_noise_last(table(spark, d, "events"), "user_id", EVENTS[1], "value", RED)
    return rounded(got.withColumn("n", F.col("n").cast("int")))


# ---- runs and files

def members(spark: SparkSession, d: str) -> DataFrame:
    """Runs with their settings: orography, noise (a null strength is none), whether it is red."""
    is_red = F.lower(F.trim("noise_type")).startswith("r")
    return table(spark, d, "run_info").select("run_id", "g", F.coalesce("sigma", F.lit(0.0)).alias("sigma"), F.coalesce(is_red, F.lit(False)).alias("red"), *(F.lit(v).alias(f"s_{i}") for i, v in enumerate(sy.START)))


STARTS = [f"s_{i}" for i in range(6)]


@query()
def simulate_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Twenty samples of every run from a random start with its own noise."""
    return simulate.simulate(members(spark, d), _SIX, "run_id", 20, 50, 0.002, sigma="sigma", red="red")


@query()
def simulate_rk4(spark: SparkSession, d: str) -> DataFrame:
    return simulate.simulate(members(spark, d), _SIX, "run_id", 20, 10, 0.1, scheme="rk4", start=STARTS)


@query()
def local_exponents(spark: SparkSession, d: str) -> DataFrame:
    """Exponents of every sample from the Jacobian there."""
    return rounded(lyapunov.local_exponents(with_height(spark, d), _SIX, ["run_id", "t_idx"], XS))


def _squared_trace(cells: list[list[str]]) -> str:
    return " + ".join(f"({cells[i][j]}) * ({cells[j][i]})" for i in range(6) for j in range(6))


_JAC = sy.jacobian_sql(_SIX, _G)


@query(f"SELECT run_id, t_idx, round({' + '.join(f'({_JAC[i][i]})' for i in range(6))}, 6) AS total, TRUE AS ordered, round({_squared_trace(_JAC)}, 6) AS square, TRUE AS bounded FROM {HEIGHT_SQL}")
def local_exponent_sums(spark: SparkSession, d: str) -> DataFrame:
    """Checks of every sample's exponents: their sum is the trace of the Jacobian, they are in order, and their squares sum
    up to no less than the trace of its square, which imaginary parts lower."""
    found = lyapunov.local_exponents(with_height(spark, d), _SIX, KEY, XS)
    names = [f"lambda_{i + 1}" for i in range(6)]
    cells = sy.jacobian(_SIX, [F.col(c) for c in _G])
    square = with_height(spark, d).select(*KEY, sum((cells[i][j] * cells[j][i] for i in range(6) for j in range(6)), F.lit(0.0)).alias("square"))
    total = F.round(sum((F.col(c) for c in names), F.lit(0.0)), 6).alias("total")
    ordered = F.array(*names) == F.reverse(F.array_sort(F.array(*names)))
    bounded = sum((F.col(c) * F.col(c) for c in names), F.lit(0.0)) >= F.col("square") - 1e-9
    return found.join(square, KEY).select(*KEY, total, ordered.alias("ordered"), F.round("square", 6).alias("square"), bounded.alias("bounded"))


#: Steps of 0.1: a Lyapunov time (50 units) has 500. Ten are left out as transient, exponents are over a hundred, and
#: covariant vectors settle over ten at either end. Directions are made orthogonal, and rows written, once a unit.
LYAPUNOV_TIME, TRANSIENT, LENGTH, PER_ROW = 500, 10 * 500, 100 * 500, 10


def own_starts(spark: SparkSession, d: str) -> DataFrame:
    """Members with a random start each, spread over the tasks; n is the run's planned samples, one a unit of time."""
    runs = members(spark, d).filter("run_id IS NOT NULL")
    planned = table(spark, d, "run_info").filter("run_id IS NOT NULL").groupBy("run_id").agg(F.coalesce(F.max("planned_samples"), F.lit(LYAPUNOV_TIME)).alias("n"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([simulate.random_start(3, int(k)) for k in b.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["run_id", "g", "n", *STARTS])

    spread = runs.select(F.col("run_id").cast("bigint").alias("run_id"), F.col("g").cast("double").alias("g")).join(planned, "run_id").select("run_id", "g", F.col("n").cast("bigint").alias("n"))
    spread = spread.repartition(spark.sparkContext.defaultParallelism, "run_id")
    return spread.mapInArrow(start, "run_id bigint, g double, n bigint, " + ", ".join(f"{c} double" for c in STARTS))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return lyapunov.lyapunov_steps(own_starts(spark, d), _SIX, "run_id", STARTS, TRANSIENT + LENGTH, 0.1, transient=TRANSIENT, norm_time=PER_ROW, vectors=False)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return lyapunov.covariant_series(own_starts(spark, d), _SIX, "run_id", STARTS, "n", 0.1, TRANSIENT, TRANSIENT // PER_ROW, PER_ROW)


@query()
def lyapunov_exponents(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lyapunov.final_exponents(_steps(spark, d), "run_id", 6), 5)


@query()
def lyapunov_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lyapunov.exponents(_steps(spark, d), "run_id", 6), 5)


@query()
def lyapunov_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lyapunov.ensemble_exponents(lyapunov.final_exponents(_steps(spark, d), "run_id", 6), 6), 5)


@query()
def clv_angles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lyapunov.vector_angles(_vectors(spark, d), "run_id", 6), 4)


@query()
def clv_subspaces(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lyapunov.subspace_angles(_vectors(spark, d), "run_id", 6, 2, 1), 4)


@query()
def reservoir_search(spark: SparkSession, d: str) -> DataFrame:
    """Best reservoir setting of every run with at least a hundred clean samples."""
    scores = reservoir.search(trajectory(spark, d), "run_id", XS, [0.5, 0.9], [-1.0, 0.0], [1e-6, 1e-3])
    return rounded(reservoir.best(scores, "run_id"))


@query()
def hmm_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Regimes of all samples by a hidden Markov model of three states over all components."""
    return hmm.regimes(trajectory(spark, d), XS, 3)


@query(f"""WITH f AS ({sf.WHOLE_SQL}),
c AS (SELECT file_kind, run_id, component, i, 16 * (component * sample_num + i) + 1 AS pos, hex(payload) AS h FROM f, (SELECT unnest(range(0, 6)) AS component), LATERAL (SELECT unnest(range(0, f.sample_num)) AS i) WHERE component < dims),
b AS (SELECT file_kind, run_id, component, CAST('0x' || {" || ".join(f"substr(h, pos + {2 * k}, 2)" for k in range(7, -1, -1))} AS UBIGINT) AS u FROM c),
v AS (SELECT file_kind, run_id, component, CAST(u // 9223372036854775808 AS INTEGER) AS neg, CAST((u // 4503599627370496) % 2048 AS INTEGER) AS e, CAST(u % 4503599627370496 AS BIGINT) AS m FROM b),
x AS (SELECT file_kind, run_id, component, CASE WHEN e = 2047 THEN NULL ELSE (1 - 2 * neg) * CAST(CASE WHEN e = 0 THEN m ELSE m + 4503599627370496 END AS DOUBLE) * pow(CAST(2 AS DOUBLE), greatest(e, 1) - 1075) END AS v FROM v)
SELECT file_kind, run_id, CAST(component + 1 AS INTEGER) AS component, CAST(count(v) AS BIGINT) AS n, round(sum(v), 6) AS total, round(min(v), 6) AS low, round(max(v), 6) AS high FROM x GROUP BY ALL""")
def combined_files(spark: SparkSession, d: str) -> DataFrame:
    """All dense files of a run together, by kind and component: values, their sum and extremes; SQL decodes the bytes."""
    rows = sf.samples(table(spark, d, "saved_file")).select("file_kind", "run_id", F.posexplode("x").alias("at", "v"))
    v = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    return rounded(rows.groupBy("file_kind", "run_id", (F.col("at") + 1).alias("component")).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high")))


@query(f"SELECT run_id, t_idx, {', '.join(XS)} FROM {stats.CLEAN_SQL}")
def stored_states(spark: SparkSession, d: str) -> DataFrame:
    """All clean samples, written to files of the dense format, a run's in pieces, and read again.

    A sample's place in its file is its number among the run's; t_idx is the first component."""
    folder = new_path(spark, "states")
    placed = ep.numbered(trajectory(spark, d), "run_id", ["t_idx"])
    files = state_files.write_states(placed, folder, ["t_idx", *XS], order="rn").collect()  # a row per file
    if not files:
        return trajectory(spark, d)
    back = state_files.read_states(spark, [r.path for r in files], 1 + len(XS), prefix="y")
    return back.select("run_id", F.col("y_1").cast("bigint").alias("t_idx"), *(F.col(f"y_{i + 2}").alias(c) for i, c in enumerate(XS)))


@query(f"""WITH t AS {stats.CLEAN_SQL} {" UNION ALL ".join(f"SELECT '{c}' AS var, CAST(count({c}) AS BIGINT) AS n, TRUE AS mean_fits, TRUE AS deviation_fits FROM t" for c in XS)}""")
def noise_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Whether mean and deviation of the noise on each column, in units of its strength, are 0 and 1 to five standard errors."""
    rows = trajectory(spark, d)
    noisy = forecast.with_noise(rows, XS, 0.01, KEY).select(*KEY, *(F.col(c).alias(f"n_{c}") for c in XS))
    both = rows.join(noisy, KEY).crossJoin(F.broadcast(rows.agg(*(F.stddev_pop(c).alias(f"s_{c}") for c in XS))))
    z = {c: (F.col(f"n_{c}") - F.col(c)) / (0.01 * F.col(f"s_{c}")) for c in XS}
    row = both.agg(*(f(x).alias(f"{k}_{c}") for c, x in z.items() for k, f in (("c", F.count), ("m", F.avg), ("d", F.stddev_pop))))
    fits = lambda c: ((F.abs(f"m_{c}") * F.sqrt(f"c_{c}") < 5).alias("mean_fits"), (F.abs(F.col(f"d_{c}") - 1) * F.sqrt(2 * F.col(f"c_{c}")) < 5).alias("deviation_fits"))
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("var"), F.col(f"c_{c}").alias("n"), *fits(c)) for c in XS))))


@query("SELECT DISTINCT run_id FROM run_info WHERE run_id IS NOT NULL AND run_id NOT IN (SELECT run_id FROM trajectory WHERE run_id IS NOT NULL)")
def missing_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of which no sample was kept."""
    return table(spark, d, "run_info").select("run_id").dropna().distinct().join(table(spark, d, "trajectory").select("run_id"), "run_id", "left_anti")


@query(f"""SELECT file_id, CASE k WHEN 'dataoro' THEN 'dataOro' WHEN 'ftle' THEN 'ftle' END AS file_kind, CAST(nullif(g, '') AS INTEGER) / 100.0::DOUBLE AS g, CAST(nullif(r, '') AS INTEGER) AS run_id FROM (
  SELECT file_id, regexp_extract(n, '{sf.NAME}', 1) AS k, regexp_extract(n, '{sf.NAME}', 2) AS g, regexp_extract(n, '{sf.NAME}', 3) AS r FROM (SELECT file_id, lower(file_name) AS n FROM saved_file))""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Kind, orography and run that files' names tell."""
    n = F.lower("file_name")
    part = lambda i: F.when(F.regexp_extract(n, sf.NAME, i) != "", F.regexp_extract(n, sf.NAME, i).cast("int"))
    kind = F.regexp_extract(n, sf.NAME, 1)
    return table(spark, d, "saved_file").select("file_id", F.when(kind == "dataoro", "dataOro").when(kind == "ftle", "ftle").alias("file_kind"), (part(2) / 100.0).alias("g"), part(3).alias("run_id"))


@query("SELECT run_id, 'dataOro' || CAST(floor(g * 100 + 0.5) AS INTEGER) || '_' || run_id || '.bin' AS file_name FROM run_info WHERE g IS NOT NULL AND run_id IS NOT NULL")
def run_file_names(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "run_info").filter("g IS NOT NULL AND run_id IS NOT NULL")
    return runs.select("run_id", state_files.file_name(F.lit("dataOro"), F.col("g"), F.col("run_id")).alias("file_name"))


@query(f"""SELECT run_id, part, CAST(count(*) AS BIGINT) AS n, min(t_idx) AS first_idx, max(t_idx) AS last_idx FROM (
  SELECT run_id, t_idx, CASE WHEN t_idx < 50 THEN 'washout' WHEN t_idx < 500 THEN 'train' ELSE 'test' END AS part FROM {stats.CLEAN_SQL}) GROUP BY ALL""")
def slices(spark: SparkSession, d: str) -> DataFrame:
    """Washout, training and test rows of each run, by half-open ranges of time."""
    part = F.when(F.col("t_idx") < 50, "washout").when(F.col("t_idx") < 500, "train").otherwise("test")
    return trajectory(spark, d).groupBy("run_id", part.alias("part")).agg(F.count("*").alias("n"), F.min("t_idx").alias("first_idx"), F.max("t_idx").alias("last_idx"))


@query(f"SELECT DISTINCT label, CAST(st AS INTEGER) AS state FROM (SELECT label, state AS st FROM ({state_samples_sql().replace('SELECT run_id, t_idx, max(st) AS state', 'SELECT label, max(st) AS state').replace('GROUP BY ALL', 'GROUP BY label').replace('SELECT run_id, t_idx, CASE WHEN state BETWEEN 1 AND 4 THEN state', 'SELECT run_id, t_idx, label, CASE WHEN FALSE THEN 0').replace('SELECT run_id, t_idx, state, nullif', 'SELECT run_id, t_idx, label, state, nullif').replace('SELECT run_id, t_idx, state, lower', 'SELECT run_id, t_idx, label, state, lower')}))")
def categories(spark: SparkSession, d: str) -> DataFrame:
    """Distinct labels and the state they name."""
    named = table(spark, d, "regime").filter("run_id IS NOT NULL AND t_idx IS NOT NULL").select("label", label_state(F.col("label")).alias("state"))
    return named.filter("state IS NOT NULL").distinct()


@query("SELECT vec_id, i - 1 AS i, round(CAST(embedding[i] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS v FROM (SELECT vec_id, embedding, CAST(unnest(range(1, len(embedding) + 1)) AS INTEGER) AS i FROM embeddings)")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = normalize(F.col("embedding").cast("array<double>"))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(v).alias("i", "v")).withColumn("v", F.round("v", 6))


_GRID = ([0.5, 0.9], [-1.0, 0.0], [1e-6, 1e-3])


@query()
def reservoir_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Horizon of the forecast of each run's last 20 samples, and the closed loop's exponents."""
    series = trajectory(spark, d)
    best = reservoir.best(materialize(reservoir.search(series, "run_id", XS, *_GRID), "scores"), "run_id")
    made = materialize(forecast.forecast(series, best, "run_id", XS, 20), "forecast")
    return rounded(forecast.first_exceedance(made, "run_id").join(forecast.forecast_exponents(made, "run_id", 6, 1.0), ["run_id", "realization"]), 5)


@query()
def reservoir_refined(spark: SparkSession, d: str) -> DataFrame:
    """Best setting of each run after two settings more, chosen by a Gaussian process."""
    series = trajectory(spark, d)
    scores = reservoir.search(series, "run_id", XS, *_GRID)
    return rounded(reservoir.best(forecast.refine(series, scores, "run_id", XS, _GRID[2], rounds=2), "run_id"))


@query()
def noisy_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Samples with seeded noise of a hundredth of each column's deviation."""
    return rounded(forecast.with_noise(trajectory(spark, d), XS, 0.01, ["run_id", "t_idx"]))
