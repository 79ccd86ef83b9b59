"""Two-point correlations along the periodic axis."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import checked, circular_lag, few
from ..session import FLOW
from . import lines


def whole_lines(snap: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("t", "i", "j")) -> DataFrame:
    """One row for each line along k, with an array in the order of k for each field; a line is as long as the grid is deep."""
    packed = F.array_sort(F.collect_list(F.struct("k", *[F.col(f).cast("double").alias(f) for f in fields])))
    out = snap.groupBy(*keys).agg(packed.alias("_l"))
    return out.select(*keys, *[F.col(f"_l.{f}").alias(f) for f in fields])


#: Reference rows (a snapshot's point on the reference line each) up to which they are broadcast; snapshots for two_point_join.
MOST_REFERENCE, MOST_SNAPSHOTS = 500_000, 2_000


def reference_line(snap: DataFrame, ref: tuple[int, int], fields: Sequence[str], center: str = "") -> tuple[DataFrame, bool]:
    """t, k, r_<field>: the reference line of each snapshot, staged, less its mean over all ("line"), that of each k ("cell") or nothing (""); and whether it may be broadcast."""
    names = [f"r_{f}" for f in fields]
    here = snap.where((F.col("i") == ref[0]) & (F.col("j") == ref[1])).select("t", "k", *[F.col(f).cast("double").alias(n) for n, f in zip(names, fields, strict=True)])
    return _centered(here, names, center)


def _centered(here: DataFrame, names: Sequence[str], center: str) -> tuple[DataFrame, bool]:
    here, small = checked(here, MOST_REFERENCE)
    if center:
        mean = here.groupBy(*(["k"] if center == "cell" else [])).agg(*[F.avg(n).alias(f"_{n}") for n in names])
        both = here.join(F.broadcast(mean), "k") if center == "cell" else here.crossJoin(F.broadcast(mean))  # a row for each k, or one
        here = both.select("t", "k", *[(F.col(n) - F.col(f"_{n}")).alias(n) for n in names])
    return here, small


def two_point(fluct: DataFrame, ref: tuple[int, int], fields: Sequence[str] = tuple(FLOW), normalize_lag: bool = False, center: str = "", line: DataFrame | None = None) -> DataFrame:
    """fi, fj, i, j, lag, r: the mean over snapshots of the sum over z0 of fi'(ref, z0) fj'(i, j, z0 + lag), periodic in z.

    ``fluct`` has t, i, j, k and the fluctuations; or, with ``center``, the fields as they are, of which fluctuations are taken about the mean
    over snapshots and z ("line") or over snapshots ("cell"). Then no mean is computed beforehand: the reference line loses its
    own, and a sum of products with something whose mean is zero doesn't feel the other's mean.
    So all snapshots are read once, and dealt once by (i, j): a line's snapshots come
    one after the other in one task, whose cross-spectra are added up and go back once for each line. The reference's rows
    are staged, out of ``line`` if the caller has them at less cost; they are broadcast only after their number is checked. Each line's snapshots must be equally long.
    ``normalize_lag`` divides by the number of z0.
    """
    here, small = reference_line(fluct if line is None else line, ref, fields, center)
    rows = fluct.select("t", "i", "j", "k", *[F.col(f).cast("double").alias(f) for f in fields])
    return lines.line_sums(rows, fields, here, small, _inverse(fields, normalize_lag, center), CORRELATIONS)


def two_point_many(snap: DataFrame, refs: Sequence[tuple[int, int]], fields: Sequence[str] = tuple(FLOW), normalize_lag: bool = False, center: str = "line", line: DataFrame | None = None) -> DataFrame:
    """ref_i, ref_j and what two_point gives, for several reference lines at once: snapshots are read and dealt once for all. Snapshots that lack one of the lines don't count."""
    refs = list(dict.fromkeys(refs))
    at = [(F.col("i") == i) & (F.col("j") == j) for i, j in refs]
    some = (snap if line is None else line).where(reduce(Column.__or__, at))
    wide = some.groupBy("t", "k").agg(*[F.max(F.when(c, F.col(f).cast("double"))).alias(f"r{m}_{f}") for m, c in enumerate(at) for f in fields])
    names = [f"r{m}_{f}" for m in range(len(refs)) for f in fields]
    here, small = _centered(wide.dropna(), names, center)
    if len(refs) == 1:
        here = here.withColumnsRenamed({n: f"r_{n.split('_', 1)[1]}" for n in names})
    rows = snap.select("t", "i", "j", "k", *[F.col(f).cast("double").alias(f) for f in fields])
    return lines.line_sums(rows, fields, here, small, _inverse(fields, normalize_lag, center, refs), f"ref_i long, ref_j long, {CORRELATIONS}", len(refs))


CORRELATIONS = "fi string, fj string, i long, j long, lag int, r double"


def _inverse(fields: Sequence[str], normalize_lag: bool, center: str, refs: Sequence[tuple[int, int]] = ()):
    """A function from a line's sums to its correlations, with each reference's place in front if ``refs`` tells them."""
    names, n = list(fields), len(fields)

    def finish(i, j, nz, count, cross, ref, own, _):
        if center:
            some = slice(1) if center == "line" else slice(None)
            cross[..., some] -= (np.conj(ref)[:, None] * own[None] / count)[..., some]
        r = np.fft.irfft(cross, n=nz, axis=-1) / count / (nz if normalize_lag else 1)
        each = max(1, len(refs))
        columns = [np.tile(np.repeat(names, n * nz), each), np.tile(np.repeat(names, nz), n * each), np.full(r.size, i), np.full(r.size, j), np.tile(np.arange(nz, dtype=np.int32), n * n * each), r.ravel()]
        places = [np.repeat([x[k] for x in refs], n * n * nz) for k in (0, 1)] if refs else []
        return pa.RecordBatch.from_arrays([pa.array(c) for c in [*places, *columns]], names=[*["ref_i", "ref_j"][: len(places)], "fi", "fj", "i", "j", "lag", "r"])

    return finish


def correlations(sums: DataFrame, fields: Sequence[str], normalize_lag: bool = False, center: str = "line") -> DataFrame:
    """fi, fj, i, j, lag, r of rows of lines.line_sums with a reference, one for each line. ``center``: see two_point."""
    return lines.finished(sums, len(fields), _inverse(fields, normalize_lag, center), CORRELATIONS)


def two_point_join(fluct: DataFrame, ref: tuple[int, int], nz: int, fields: Sequence[str] = tuple(FLOW)) -> DataFrame:
    """The same by a join of each point with its snapshot's reference line, nz products a point: for short lines."""
    pack = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in fields])
    here = fluct.where((F.col("i") == ref[0]) & (F.col("j") == ref[1])).select("t", F.col("k").alias("k0"), F.explode(pack).alias("a")).select("t", "k0", F.col("a.f").alias("fi"), F.col("a.v").alias("vi"))
    own = fluct.select("t", "i", "j", "k", F.explode(pack).alias("b")).select("t", "i", "j", "k", F.col("b.f").alias("fj"), F.col("b.v").alias("vj"))
    snaps = fluct.select(F.count_distinct("t").alias("n"))
    total = own.join(few(here, MOST_SNAPSHOTS * nz), "t").groupBy("fi", "fj", "i", "j", circular_lag(F.col("k"), F.col("k0"), nz).alias("lag")).agg(F.sum(F.col("vi") * F.col("vj")).alias("s"))
    return total.crossJoin(F.broadcast(snaps)).select("fi", "fj", "i", "j", "lag", (F.col("s") / F.col("n")).alias("r"))


def discover_fields(table: DataFrame, column: str = "fi", preferred: Sequence[str] = tuple(FLOW)) -> DataFrame:
    """field, place (from 0): the names that occur in ``column``, the preferred ones first in their order, the rest by name."""
    found = table.select(F.col(column).alias("field")).where(F.col("field").isNotNull()).distinct()
    first = F.array_position(F.array(*[F.lit(x) for x in preferred]), F.col("field")) if preferred else F.lit(0)
    order = W.orderBy(F.when(first > 0, first).otherwise(F.lit(len(preferred) + 1)), "field")  # a row for each field
    return found.withColumn("place", F.row_number().over(order) - 1)
