"""Problem 2: percentiles of local exponents per regime state, and values far outside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import KEY, materialize, state_samples, state_samples_sql, table
from .quantiles import merge_sketches, percentiles, sketch_columns

LAMBDAS = [f"lambda_{i}" for i in range(1, 7)]
QS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
#: Samples of a day, where sketches of days are combined.
DAY = 500
#: Of the cases: how many times the distance between the 5th and 95th percentile.
FAR = 6.0


def labelled_exponents(local_exponents: DataFrame, regime: DataFrame) -> DataFrame:
    """One row per sample with a state: key, state, exponents. Re-sent rows carry the same values and count once."""
    once = local_exponents.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in LAMBDAS))
    return once.join(state_samples(regime), KEY)


def state_percentiles(labelled: DataFrame, qs: list[float] = QS) -> DataFrame:
    """(state, lambda_no, q, value, n, rank_error) of a table of labelled_exponents; `labelled` is read once."""
    parts = materialize(sketch_columns(labelled, "state", LAMBDAS, "lambda_no"), "sketches")
    nodes = (parts.agg(F.max("node")).first()[0] or 0) + 1
    merged = merge_sketches(parts, ["state", "lambda_no"], nodes)
    return percentiles(merged, ["state", "lambda_no"], qs)


def far_values(labelled: DataFrame, stats: DataFrame, times: float = FAR) -> DataFrame:
    """Values farther from their group's median than `times` the distance of its 5th and 95th percentile.

    `stats` has at most one row per state and exponent, 24 in all, so they come to the driver and become literals.
    """
    limits: dict[tuple[int, int], dict[float, float]] = {}
    for r in stats.filter(F.col("q").isin(0.05, 0.5, 0.95)).collect():
        limits.setdefault((r.state, r.lambda_no), {})[r.q] = r.value
    cases = []
    for j, c in enumerate(LAMBDAS, 1):
        v, far = F.col(c), F.lit(False)
        for (state, no), q in sorted(limits.items()):
            if no == j and None not in q.values():
                out = F.abs(v - F.lit(q[0.5])) > F.lit(times * (q[0.95] - q[0.05]))
                far = far | ((F.col("state") == state) & out)
        cases.append(F.when(v.isNotNull() & ~F.isnan(v) & far, F.lit(j)))
    some = reduce(lambda a, b: a | b, (c.isNotNull() for c in cases))
    return labelled.filter(some).select("run_id", "t_idx", F.explode(F.array_compact(F.array(*cases))).alias("lambda_no"))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = materialize(labelled_exponents(table(spark, sf_dir, "local_exponents"), table(spark, sf_dir, "regime")), "p2")
    return state_percentiles(labelled)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = materialize(labelled_exponents(table(spark, sf_dir, "local_exponents"), table(spark, sf_dir, "regime")), "p2")
    return far_values(labelled, state_percentiles(labelled))


def merged_days(labelled: DataFrame, qs: list[float] = QS, day: int = DAY) -> DataFrame:
    """(state, lambda_no, q, value, n, rank_error) from a sketch for each day (of `day` samples), kept and then combined."""
    keyed = labelled.withColumn("part", (F.floor(F.col("t_idx") / F.lit(day)) * 8 + F.col("state")).cast("int"))
    parts = materialize(sketch_columns(keyed, "part", LAMBDAS, "lambda_no"), "sketches")
    nodes = (parts.agg(F.max("node")).first()[0] or 0) + 1
    days = materialize(merge_sketches(parts, ["part", "lambda_no"], nodes), "days")  # what a day's job would leave behind
    days = days.withColumn("state", F.pmod("part", F.lit(8))).withColumn("node", F.expr("part div 8").cast("int")).drop("part")
    last = (days.agg(F.max("node")).first()[0] or 0) + 1
    return percentiles(merge_sketches(days, ["state", "lambda_no"], last), ["state", "lambda_no"], qs)


def rank_checks(labelled: DataFrame, stats: DataFrame) -> DataFrame:
    """(state, lambda_no, q, n, within): whether each value's true rank is off by no more than its bound says."""
    value = F.inline(F.array(*(F.struct(F.lit(j).alias("lambda_no"), F.col(c).alias("v")) for j, c in enumerate(LAMBDAS, 1))))
    rows = labelled.select("state", value).filter("v IS NOT NULL AND NOT isnan(v)")
    # a row per state, exponent and percentile
    met = rows.join(F.broadcast(stats.withColumnRenamed("n", "told")), ["state", "lambda_no"]).groupBy("state", "lambda_no", "q", "told", "rank_error").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("v") < F.col("value"), 1)).alias("below"), F.count(F.when(F.col("v") <= F.col("value"), 1)).alias("upto")
    )
    want, off = F.col("q") * (F.col("n") - 1), F.col("rank_error") * F.col("n") + 1
    return met.select("state", "lambda_no", "q", F.col("told").alias("n"), ((F.col("below") - off <= want) & (want <= F.col("upto") + off) & (F.col("told") == F.col("n"))).alias("within"))


def p2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles combined from the sketches of separate days, checked against all values."""
    labelled = materialize(labelled_exponents(table(spark, sf_dir, "local_exponents"), table(spark, sf_dir, "regime")), "p2")
    return rank_checks(labelled, materialize(merged_days(labelled), "merged"))


_VALUES = f"""
WITH st AS ({state_samples_sql()}),
once AS (SELECT run_id, t_idx, {", ".join(f"max({c}) AS {c}" for c in LAMBDAS)} FROM local_exponents GROUP BY ALL),
v AS (SELECT o.run_id, o.t_idx, st.state, CAST(u.no AS INTEGER) AS lambda_no, u.v FROM once o JOIN st USING (run_id, t_idx),
  LATERAL (VALUES {", ".join(f"({i}, o.{c})" for i, c in enumerate(LAMBDAS, 1))}) u(no, v)
  WHERE u.v IS NOT NULL AND NOT isnan(u.v))"""
P2_MERGED_SQL = f"""{_VALUES}
SELECT state, lambda_no, CAST(q AS DOUBLE) AS q, CAST(count(*) AS BIGINT) AS n, TRUE AS within FROM v, (VALUES {", ".join(f"({q})" for q in QS)}) p(q) GROUP BY ALL"""
P2_FOUND_SQL = f"""
WITH st AS ({state_samples_sql()}),
once AS (SELECT run_id, t_idx, {", ".join(f"max({c}) AS {c}" for c in LAMBDAS)} FROM local_exponents GROUP BY ALL),
v AS (SELECT o.run_id, o.t_idx, st.state, CAST(u.no AS INTEGER) AS lambda_no, u.v FROM once o JOIN st USING (run_id, t_idx),
  LATERAL (VALUES {", ".join(f"({i}, o.{c})" for i, c in enumerate(LAMBDAS, 1))}) u(no, v)
  WHERE u.v IS NOT NULL AND NOT isnan(u.v)),
q AS (SELECT state, lambda_no, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS w FROM v GROUP BY ALL)
SELECT v.run_id, v.t_idx, v.lambda_no FROM v JOIN q USING (state, lambda_no) WHERE abs(v.v - q.med) > {FAR} * q.w"""
