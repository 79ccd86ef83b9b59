"""Sums over snapshots of the spectra of lines along the periodic axis.

Rows are dealt by line and sorted, so a line's snapshots pass one after the other and
each task holds the sums of one line and a batch of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches

SCHEMA = "i long, j long, nz int, n long, cross_re array<double>, cross_im array<double>, ref_re array<double>, ref_im array<double>, own_re array<double>, own_im array<double>, power array<double>"
#: The arrays of a row of sums. Each is a sum over snapshots, so rows of one line add up.
ARRAYS = ["cross_re", "cross_im", "ref_re", "ref_im", "own_re", "own_im", "power"]


def _snapshots(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i and j, of each; values by name, snapshot and k) of whole lines of one length, from rows sorted by i, j, t, k."""
    held: list[pa.RecordBatch] = []

    def lines_of(batch: pa.RecordBatch, last: bool):
        key = np.stack([batch.column(c).to_numpy() for c in ("i", "j", "t")])
        starts = np.append(0, np.flatnonzero((np.diff(key) != 0).any(0)) + 1)
        ends = np.append(starts[1:], batch.num_rows)
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        rest = batch.slice(ends[-1] if len(ends) else 0)
        values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        length = ends - starts
        for run in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(length)) + 1) if len(starts) else []:
            a, b = starts[run[0]], ends[run[-1]]
            yield key[:2, starts[run]], values[:, a:b].reshape(len(names), len(run), -1)
        return rest

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            same = all(batch.column(c)[-1] == held[0].column(c)[0] for c in ("i", "j", "t"))
            if not same:  # else all of it is one line that goes on
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = [(yield from lines_of(whole, False))]
    if held:
        yield from lines_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0], True)


def line_sums(snap: DataFrame, fields: Sequence[str], here: DataFrame | None = None, small: bool = False, finish: Callable | None = None, schema: str = SCHEMA, references: int = 1) -> DataFrame:
    """A row for each line (i, j): nz, n (snapshots), and the sums over them of its spectra, their powers and, with ``here``, the reference's spectra and the cross-spectra with it.

    ``snap``: t, i, j, k and the fields. ``here``: t, k and r_<field>, or r0_<field>, r1_<field>, ... of several ``references``, whose cross-spectra stand one after the other; only snapshots (and k) that it has count; if it is ``small`` it is broadcast, and snap's
    only exchange is the one by line. ``finish`` makes batches of ``schema`` of a line's (i, j, nz, n, cross, ref, own, power) in the same task, instead of the row.
    """
    small_batches(snap.sparkSession)
    marks = ["r"] if references == 1 else [f"r{m}" for m in range(references)]
    names, refs = list(fields), [f"{r}_{f}" for r in marks for f in fields] if here is not None else []
    rows = snap.select("t", "i", "j", "k", *names)
    # if an earlier join was by (i, j), Spark would leave out an exchange by the same, and then split the join's parts while it runs
    line = ["i", F.struct("i", "j")]
    if small:
        rows = rows.repartition(*line).join(F.broadcast(here), ["t", "k"])
    else:
        rows = (rows if here is None else rows.join(here, ["t", "k"])).repartition(*line)
    rows = rows.sortWithinPartitions("i", "j", "t", "k").select("i", "j", "t", *refs, *names)
    n = len(names)

    def run(batches):
        at, nz, count, sums = None, 0, 0, None
        for keys, values in _snapshots(batches, refs + names):
            waves = np.fft.rfft(values, axis=-1)
            x, y = waves[: len(refs)], waves[len(refs) :]
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), keys.shape[1]]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                line = (int(keys[0, a]), int(keys[1, a]))
                if at != line:
                    if at is not None:
                        yield (finish or _row)(*at, nz, count, *sums)
                    at, nz, count, sums = line, values.shape[-1], 0, [np.zeros((len(refs), n, waves.shape[-1]), complex), 0, 0, 0]
                elif nz != values.shape[-1]:
                    raise ValueError(f"snapshots of line {line} differ in length")
                u, v = x[:, a:b], y[:, a:b]
                for f in range(len(refs)):
                    sums[0][f] += (np.conj(u[f]) * v).sum(1)
                sums[1:] = [sums[1] + u.sum(1), sums[2] + v.sum(1), sums[3] + (np.abs(v) ** 2).sum(1)]
                count += b - a
        if at is not None:
            yield (finish or _row)(*at, nz, count, *sums)

    return rows.mapInArrow(run, schema)


def _row(i, j, nz, n, cross, ref, own, power) -> pa.RecordBatch:
    flat = [a.ravel() for a in (cross.real, cross.imag, ref.real, ref.imag, own.real, own.imag, power)]
    arrays = [pa.array([i]), pa.array([j]), pa.array([nz], pa.int32()), pa.array([n])] + [pa.array([a], pa.list_(pa.float64())) for a in flat]
    return pa.RecordBatch.from_arrays(arrays, names=["i", "j", "nz", "n", *ARRAYS])


def finished(sums: DataFrame, n_fields: int, finish: Callable, schema: str) -> DataFrame:
    """What ``finish`` makes of each row of sums; see line_sums."""
    small_batches(sums.sparkSession)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield finish(*unpack(batch.slice(k, 1).to_pylist()[0], n_fields))

    return sums.select(*[c.split()[0] for c in SCHEMA.split(", ")]).mapInArrow(run, schema)


def unpack(row: dict, n: int) -> tuple:
    """i, j, nz, snapshots, cross (n, n, waves), ref, own (n, waves) and power (n, waves) of a row of sums; without a reference cross and ref are empty."""
    waves = row["nz"] // 2 + 1
    get = lambda name, *shape: (np.array(row[f"{name}_re"]) + 1j * np.array(row[f"{name}_im"])).reshape(*shape, waves)
    return row["i"], row["j"], row["nz"], row["n"], get("cross", -1, n), get("ref", -1), get("own", n), np.array(row["power"]).reshape(n, waves)


def merged(parts: DataFrame) -> DataFrame:
    """Rows of sums, one for each line: those of different snapshots added up."""

    def add(_, t):
        arrays = [pa.array([np.stack(t[c].to_numpy()).sum(0)], pa.list_(pa.float64())) for c in ARRAYS]
        first = [pa.array([t[c][0].as_py()], t.schema.field(c).type) for c in ("i", "j", "nz")]
        return pa.Table.from_arrays([*first, pa.array([sum(t["n"].to_pylist())]), *arrays], names=["i", "j", "nz", "n", *ARRAYS])

    return parts.groupBy("i", "j", "nz").applyInArrow(add, SCHEMA)
