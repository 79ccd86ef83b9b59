"""Power spectra of periodic lines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import col, wavenumber
from ..session import FLOW
from .correlation import whole_lines


def one_sided(f: np.ndarray) -> np.ndarray:
    """|rfft|^2 / n^2 along the last axis, doubled but at the mean and, for even n, at the highest wavenumber: it sums to the mean of f^2."""
    n = f.shape[-1]
    p = np.abs(np.fft.rfft(f, axis=-1)) ** 2 / n**2
    p[..., 1 : (n + 1) // 2] *= 2
    return p


@pandas_udf(ArrayType(DoubleType()))
def line_power(line: pd.Series) -> pd.Series:
    """Spectrum of each line; lines may differ in length."""
    return pd.Series([one_sided(np.asarray(x, float)) for x in line])


def power(df: DataFrame, line: Column | str, keys: Sequence[str]) -> DataFrame:
    """keys, k_idx, p: the mean spectrum of the lines of a group."""
    rows = df.select(*keys, F.posexplode(line_power(col(line))).alias("k_idx", "p"))
    return rows.groupBy(*keys, "k_idx").agg(F.avg("p").alias("p"))


def plane_spectrum(fluct: DataFrame, fields: Sequence[str] = tuple(FLOW), locations: DataFrame | None = None) -> DataFrame:
    """field, k_idx, p over all columns and snapshots; with ``locations`` (i, j), loc_i, loc_j too and one spectrum for each.

    Only the lines asked for are gathered and transformed, each once for all fields.
    """
    keys: list[str] = []
    if locations is not None:
        fluct = fluct.join(locations.select("i", "j").distinct(), ["i", "j"], "left_semi")
        keys = ["loc_i", "loc_j"]
    rows = whole_lines(fluct, fields).withColumnsRenamed({"i": "loc_i", "j": "loc_j"})
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("line")) for f in fields])).alias("s")).select(*keys, "s.*")
    return power(long, "line", [*keys, "field"])


def with_wavenumber(spectrum: DataFrame, nz: int, dz: float) -> DataFrame:
    return spectrum.withColumn("k", wavenumber("k_idx", nz, dz))


def total_energy(spectrum: DataFrame, keys: Sequence[str] = ("k_idx",)) -> DataFrame:
    """keys, e_total = (Pu + Pv + Pw) / 2, where all three are there."""
    parts = spectrum.where(F.col("field").isin("u", "v", "w")).groupBy(*keys).agg(F.sum("p").alias("_p"), F.count_distinct("field").alias("_n"))
    return parts.where("_n = 3").select(*keys, (F.col("_p") * 0.5).alias("e_total"))


def line_power_sql(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """The same spectrum by sums of cosines and sines, for rows (keys, k, value) of short lines of n points."""
    waves = df.select(*keys, "k", value, F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("k_idx"))
    angle = F.lit(2.0) * F.pi() * F.col("k_idx") * F.col("k") / n
    sums = waves.groupBy(*keys, "k_idx").agg(F.sum(F.col(value) * F.cos(angle)).alias("re"), F.sum(F.col(value) * F.sin(angle)).alias("im"))
    double = F.when((F.col("k_idx") >= 1) & (F.col("k_idx") < (n + 1) // 2), 2.0).otherwise(1.0)
    return sums.select(*keys, "k_idx", (double * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / float(n * n)).alias("p"))


def check_uniform(z: Sequence[float], rtol: float = 1e-4) -> float:
    """The spacing of a periodic axis; warns if it isn't uniform."""
    import warnings

    d = np.diff(np.asarray(z, float))
    if not np.allclose(d, d[0], rtol=rtol):
        warnings.warn("the spacing along z isn't uniform", stacklevel=2)
    return float(d[0])
