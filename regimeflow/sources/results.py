"""Results of analyses as Parquet tables: networks, exponents and covariant vectors, and settings of experiments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reservoir import Reservoir

#: Name, system, dimension, units, time step, Lyapunov time, parameters, start on the attractor.
EXPERIMENTS = (
    ("lorenz96_10", "lorenz96", 10, 1000, 0.01, 1 / 1.2, [8.0], [5.22196394, -1.51558431, -4.34570876, -0.77345849, 6.95503428, 7.29261052, -3.15761016, 1.67864043, 2.84273581, 4.49401018]),
    ("lorenz96_20", "lorenz96", 20, 1000, 0.01, 1 / 1.5, [8.0], [-0.41551129, -1.83742654, -1.41025459, 6.40579129, 6.46965049, 3.26477452, 5.87700405, -0.60882665, -3.46431662, 0.61291811, 7.92510557, 3.83353264, -3.14415806, -0.49186308, -1.31767124, -2.33572901, 2.96791844, 12.85790068, -0.0429301, 2.47473015]),
    ("lorenz63", "lorenz63", 3, 100, 0.005, 1 / 0.9, [10.0, 28.0, 8 / 3], [7.432487609628195, 10.02071718705213, 29.62297428638419]),
    ("rossler", "rossler", 3, 100, 0.01, 1 / 0.07, [0.1, 0.1, 14.0], [7.55576471, 15.53252411, 0.57289182]),
    ("six_mode", "six_mode", 6, 400, 0.1, 1 / 0.02, [], [0.74386288, 0.19322051, -0.34494619, -0.3342756, -0.11471851, 0.34287484]),
)
MODES = ("all", "angles")


def experiments(spark: SparkSession) -> DataFrame:
    """Settings of the five experiments, with the steps in a Lyapunov time."""
    rows = [(*e, int(e[5] / e[4])) for e in EXPERIMENTS]
    return spark.createDataFrame(rows, "name string, system string, dim int, units int, dt double, lyapunov_time double, parameters array<double>, start array<double>, n_lyap int")


def save_network(spark: SparkSession, path: str, r: Reservoir, w_out: np.ndarray, scale: np.ndarray, rho: float, log_sigma: float, tikhonov: float) -> None:
    """Write a trained network: its matrices as (matrix, i, j, v) without zeros, and a row of settings."""
    rows = [(name, int(i), int(j), float(m[i, j])) for name, m in (("w_in", r.w_in), ("w", r.w), ("w_out", w_out), ("scale", scale[None])) for i, j in zip(*np.nonzero(m))]
    spark.createDataFrame(rows, "matrix string, i int, j int, v double").write.mode("overwrite").parquet(f"{path}/entries")
    head = [(r.w.shape[0], w_out.shape[1], r.bias_in, r.bias_out, rho, log_sigma, tikhonov)]
    spark.createDataFrame(head, "units int, dim int, bias_in double, bias_out double, rho double, log10_sigma_in double, tikh double").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_network(spark: SparkSession, path: str) -> tuple[Reservoir, np.ndarray, np.ndarray, dict]:
    """(reservoir, readout, scale, settings) as saved. A network has some units times dim entries, so it comes whole."""
    s = spark.read.parquet(f"{path}/settings").first().asDict()
    shape = {"w_in": (s["units"], s["dim"] + 1), "w": (s["units"], s["units"]), "w_out": (s["units"] + 1, s["dim"]), "scale": (1, s["dim"])}
    m = {name: np.zeros(sh) for name, sh in shape.items()}
    for r in spark.read.parquet(f"{path}/entries").collect():
        m[r.matrix][r.i, r.j] = r.v
    return Reservoir(m["w_in"], m["w"], s["bias_in"], s["bias_out"]), m["w_out"], m["scale"][0], s


def save_vectors(path: str, steps: DataFrame, vectors: DataFrame, angles: DataFrame, key: str, norm_time: int, transient: int, mode: str = "all") -> None:
    """Write states, exponents, growth rates and, in mode "all", the covariant vectors, or in mode "angles" their angles."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
    steps.select(key, "t_idx", "t", "x", "ftle").write.mode("overwrite").parquet(f"{path}/states")
    vectors.select(key, "t_idx", "growth").write.mode("overwrite").parquet(f"{path}/growth")
    (vectors.select(key, "t_idx", "v") if mode == "all" else angles).write.mode("overwrite").parquet(f"{path}/{'vectors' if mode == 'all' else 'angles'}")
    meta = steps.sparkSession.range(1).select(F.lit(norm_time).alias("norm_time"), F.lit(transient).alias("transient"), F.lit(mode).alias("mode"))
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
