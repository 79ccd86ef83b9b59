"""Correlations and spectra that go on: kept sums over snapshots, to which only new snapshots are added."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checked, few
from ..operators import correlation, lines
from ..session import FLOW
from . import Checkpoint, pending
from .spans import Spans


class SpectralSums:
    """Sums over snapshots of each line's spectra, and of its cross-spectra with a reference line, under ``path``.

    Each ``add`` reads only snapshots that aren't in it yet and puts their sums in a folder of their own; more than ``most`` folders are added up into one. A go that
    was cut off is made again and counts once. Fields and reference must stay as at first, else ValueError.
    Values are taken relative to the first snapshot's mean of each field, so that no digits are lost in squares; results don't depend on it.
    """

    def __init__(self, spark: SparkSession, path: str, ref: tuple[int, int] | None = None, fields: Sequence[str] = tuple(FLOW), most: int = 16):
        self.spark, self.path, self.ref, self.fields = spark, path.rstrip("/"), ref, list(fields)
        Checkpoint(spark, f"{self.path}/settings", {"ref": list(ref) if ref else None, "fields": self.fields})
        self.sums, self.times = Spans(spark, f"{self.path}/sums", most), Spans(spark, f"{self.path}/times", most)
        self.origin = Spans(spark, f"{self.path}/origin")

    def snapshots(self) -> DataFrame:
        """t of the snapshots that the sums hold."""
        times = self.times.read()
        none = self.spark.createDataFrame([], "t long, go int")
        return (none if times is None else times).where(F.col("go") < self.sums.next()).select("t").distinct()

    def _origin(self, snap: DataFrame) -> dict[str, float]:
        if self.origin.read() is None:
            first = snap.join(F.broadcast(snap.agg(F.min("t").alias("t"))), "t", "left_semi")
            self.origin.put(first.agg(*[F.coalesce(F.avg(F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in self.fields]), 0)
        return self.origin.read().first().asDict()  # one row

    def add(self, snap: DataFrame) -> int:
        """Adds the snapshots of ``snap`` (t, i, j, k and the fields) that aren't in it, and says how many that were. Looks at the data."""
        new, _ = checked(pending(snap.select(F.col("t").cast("long").alias("t")), self.snapshots(), "t"), 0)
        if not (n := new.count()):
            return 0
        origin, go = self._origin(snap), self.sums.next()
        some = snap.join(few(new, correlation.MOST_REFERENCE), "t", "left_semi").select("t", "i", "j", "k", *[(F.col(f).cast("double") - origin[f]).alias(f) for f in self.fields])
        here, small = (None, False) if self.ref is None else correlation.reference_line(some, self.ref, self.fields)
        self.times.put(new.withColumn("go", F.lit(go)), go)
        self.sums.put(lines.line_sums(some, self.fields, here, small), go)
        self.sums.fold(lines.merged)
        self.times.fold(lambda df: df)
        return n

    def table(self) -> DataFrame:
        """A row for each line; see lines.line_sums."""
        parts = self.sums.read()
        return self.spark.createDataFrame([], lines.SCHEMA) if parts is None else lines.merged(parts)

    def correlations(self, normalize_lag: bool = False, center: str = "line") -> DataFrame:
        """fi, fj, i, j, lag, r as correlation.two_point gives of all snapshots."""
        if self.ref is None:
            raise ValueError("there is no reference line")
        if center not in ("line", "cell"):
            raise ValueError("correlations are of fluctuations: center is line or cell")
        return correlation.correlations(self.table(), self.fields, normalize_lag, center)

    def spectrum(self, center: str = "line", by_line: bool = False) -> DataFrame:
        """field, k_idx, p: as spectral.plane_spectrum gives of the fluctuations about the mean of each line ("line") or cell ("cell"), or of the values as they are (""). With ``by_line``, loc_i and loc_j too: one for each line."""
        names, keys = self.fields, ["loc_i", "loc_j"] if by_line else []
        origin = self.origin.read()
        origin = np.array([origin.first()[f] if origin is not None else 0.0 for f in names])  # one row

        def finish(i, j, nz, count, cross, ref, own, power):
            if center:
                some = slice(1) if center == "line" else slice(None)
                power[:, some] -= (np.abs(own) ** 2 / count)[:, some]
            else:  # sums are of values less their origin
                power[:, 0] += 2 * nz * origin * own[:, 0].real + count * (nz * origin) ** 2
            power[:, 1 : (nz + 1) // 2] *= 2
            waves = power.shape[1]
            columns = (np.full(power.size, i), np.full(power.size, j), np.repeat(names, waves), np.tile(np.arange(waves, dtype=np.int32), len(names)), power.ravel() / nz**2, np.full(power.size, count))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["loc_i", "loc_j", "field", "k_idx", "p", "n"])

        parts = lines.finished(self.table(), len(names), finish, "loc_i long, loc_j long, field string, k_idx int, p double, n long")
        return parts.groupBy(*keys, "field", "k_idx").agg((F.sum("p") / F.sum("n")).alias("p"))
