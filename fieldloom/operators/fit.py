"""Fits: series statistics, sliding regressions on spectra, weighted least squares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series_stats(series: DataFrame, values: Sequence[str], order: str) -> DataFrame:
    """name, n, mean, std (of the sample), sem, drift (slope against the ordinal times n - 1; null below three rows)."""
    rows = series.select(order, *values).withColumn("_o", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order)) - 1).cast("double"))
    long = rows.select("_o", F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("v")) for v in values])).alias("s")).select("_o", "s.*")
    n = F.count("*")
    return long.groupBy("name").agg(
        n.alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), (F.stddev_samp("v") / F.sqrt(n)).alias("sem"), F.when(n > 2, F.regr_slope("v", "_o") * (n - 1)).alias("drift")
    )


def positive(spectrum: DataFrame, k: str = "k", p: str = "p") -> DataFrame:
    return spectrum.where((F.col(k) > 0) & (F.col(p) > 0))


def slope_windows(spectrum: DataFrame, k: str = "k", p: str = "p", width: int | None = None) -> DataFrame:
    """start, slope, r2 of the straight line through each run of ``width`` points of log p against log k.

    Looks at the data for the default width, max(4, n / 8). A flat run has r2 = 1. Fewer than four points raise ValueError.
    """
    rows = positive(spectrum, k, p).select(F.col(k).alias("k"), F.log(k).alias("lk"), F.log(p).alias("lp"))
    n = rows.count()
    if n < 4:
        raise ValueError("a slope needs four points with positive k and p")
    width = min(width or max(4, n // 8), n)
    order = W.partitionBy(F.lit(0)).orderBy("k")
    frame = order.rowsBetween(0, width - 1)
    out = rows.select((F.row_number().over(order) - 1).alias("start"), F.regr_slope("lp", "lk").over(frame).alias("slope"), F.coalesce(F.regr_r2("lp", "lk").over(frame), F.lit(1.0)).alias("r2"), F.count("*").over(frame).alias("_n"))
    return out.where(F.col("_n") == width).drop("_n")


def slope_match(windows: DataFrame, target: float, r2: float = 0.9) -> DataFrame:
    """One row: steepest (start of the smallest slope, the first of equals), start, slope, r2 of the window that is nearest to ``target`` up to the steepest, well fitted ones first."""
    steepest = windows.agg(F.min(F.struct("slope", "start")).alias("s")).select(F.col("s.start").alias("steepest"))
    fit = windows.crossJoin(F.broadcast(steepest)).where("start <= steepest")
    best = fit.agg(F.min("steepest").alias("steepest"), F.min(F.struct((F.col("r2") < r2).alias("poor"), F.abs(F.col("slope") - target).alias("d"), "start", "slope", "r2")).alias("b"))
    return best.select("steepest", F.col("b.start").alias("start"), F.col("b.slope").alias("slope"), F.col("b.r2").alias("r2"))


def guide_line(spectrum: DataFrame, match: DataFrame, target: float, width: int, k: str = "k", p: str = "p") -> DataFrame:
    """k, p of the line p_a (k / k_a)^target through the matched window's middle, over a third of the points to either side."""
    order = W.partitionBy(F.lit(0)).orderBy("k")
    rows = positive(spectrum, k, p).select(F.col(k).alias("k"), F.col(p).alias("p")).withColumn("n", F.row_number().over(order) - 1)
    anchor = match.select((F.col("start") + width // 2).alias("a"))
    both = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("all")))).crossJoin(F.broadcast(anchor))
    at = rows.join(F.broadcast(anchor), F.col("n") == F.col("a")).select(F.col("k").alias("ka"), F.col("p").alias("pa"))
    third = F.floor(F.col("all") / 3)
    inside = (F.col("n") >= F.greatest(F.lit(3), F.col("a") - third)) & (F.col("n") < F.least(F.col("all"), F.col("a") + third))
    return both.where(inside).crossJoin(F.broadcast(at)).select("k", (F.col("pa") * F.pow(F.col("k") / F.col("ka"), F.lit(float(target)))).alias("p"))


def weighted_line(df: DataFrame, x: str, y: str, weight: str) -> DataFrame:
    """One row: intercept, slope and rms of y = intercept + slope x, weighted, from five sums; and sums of squares for the residual."""
    w, a, b = F.col(weight), F.col(x), F.col(y)
    s = df.agg(F.sum(w).alias("sw"), F.sum(w * a).alias("sx"), F.sum(w * b).alias("sy"), F.sum(w * a * a).alias("sxx"), F.sum(w * a * b).alias("sxy"), F.sum(w * b * b).alias("syy"))
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    s = s.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw"))
    rest = F.col("syy") - F.col("intercept") * F.col("sy") - F.col("slope") * F.col("sxy")
    return s.select("intercept", "slope", F.sqrt(F.greatest(F.lit(0.0), rest) / F.col("sw")).alias("rms"))
