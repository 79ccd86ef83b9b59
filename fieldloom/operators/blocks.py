"""Stencils on a structured grid in blocks with copied borders: one exchange for all axes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_batches

#: Points of a block along each index, and rows copied from its neighbours: an end's slope takes two more points.
SIZE, BORDER = 48, 2


def block_gradient(df: DataFrame, values: dict[str, Sequence[str]], indices: dict[str, str] | None = None, size: int = SIZE) -> DataFrame:
    """Adds ``<value>_d<axis>`` for the values of each axis, on a structured grid with index columns i, j, k (whole numbers, without gaps on a line) and coordinate columns.

    The slope of the parabola through a point and its two neighbours on the line, or at an end
    through the three outermost points. A point goes to its block and, near a face, to the block beyond it; each
    block then has all that its slopes need. Lines of fewer than three points raise an error, and so do two rows of one point. Nulls count as NaN.
    """
    small_batches(df.sparkSession)
    indices = indices or {"x": "i", "y": "j", "z": "k"}
    names = [indices[a] for a in indices]
    own = [F.floor(F.col(n) / size) for n in names]
    # the block itself, and one beyond each face that the point is near
    places = [F.struct(*[c.alias(f"b{m}") for m, c in enumerate(own)])]
    for m, (a, n) in enumerate(indices.items()):
        if values.get(a):
            at = F.pmod(F.col(n), F.lit(size))
            for step, near in ((-1, at < BORDER), (1, at >= size - BORDER)):
                there = F.struct(*[(c + step if x == m else c).alias(f"b{x}") for x, c in enumerate(own)])
                places.append(F.when(near, there))
    copies = df.withColumn("_to", F.explode(F.filter(F.array(*places), lambda s: s.isNotNull())))
    is_own = F.lit(True)
    for m, c in enumerate(own):
        is_own = is_own & (F.col(f"_to.b{m}") == c)
    blocks = [f"_b{m}" for m in range(len(names))]
    dealt = copies.withColumns({"_own": is_own, **{b: F.col(f"_to.b{m}") for m, b in enumerate(blocks)}}).drop("_to")
    added = [f"{v}_d{a}" for a in indices for v in values.get(a, ())]
    fields = [f for f in df.schema.fields if f.name not in added]

    def run(_, t):
        t = t.combine_chunks()
        index = [t[n].to_numpy() for n in names]
        low = [int(x.min()) for x in index]
        shape = tuple(int(x.max()) - a + 1 for x, a in zip(index, low, strict=True))
        at = tuple(x - a for x, a in zip(index, low, strict=True))
        there = np.zeros(shape, bool)
        there[at] = True
        if there.sum() != len(index[0]):
            raise ValueError("a point of the grid occurs twice")
        mine = t["_own"].to_numpy()
        t_own = t.filter(t["_own"])
        out = {}
        for m, (a, _n) in enumerate(indices.items()):
            if not values.get(a):
                continue
            fill = lambda c: _dense(t[c].to_numpy().astype(float), at, shape)
            x = np.moveaxis(fill(a), m, -1)
            ok = np.moveaxis(there, m, -1)
            need = np.zeros(shape, bool)
            need[tuple(c[mine] for c in at)] = True
            need = np.moveaxis(need, m, -1)
            for v in values[a]:
                slope = _slopes(x, np.moveaxis(fill(v), m, -1), ok, need)
                out[f"{v}_d{a}"] = np.moveaxis(slope, -1, m)[at][mine]
        columns = [t_own[f.name] for f in fields] + [pa.array(out[n]) for n in added]
        return pa.table(columns, names=[f.name for f in fields] + added)

    schema = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in added])
    return dealt.groupBy(*blocks).applyInArrow(run, schema)


def _dense(values: np.ndarray, at: tuple, shape: tuple) -> np.ndarray:
    out = np.full(shape, np.nan)
    out[at] = values
    return out


def _slopes(x: np.ndarray, f: np.ndarray, there: np.ndarray, need: np.ndarray) -> np.ndarray:
    """d f / d x along the last axis where it is needed: by the point and both neighbours, or at a line's end by the three outermost."""

    def moved(a, n, empty):
        out = np.full_like(a, empty)
        if n > 0:
            out[..., n:] = a[..., :-n]
        else:
            out[..., :n] = a[..., -n:]
        return out

    before, after = moved(there, 1, False), moved(there, -1, False)
    first, last = there & ~before, there & ~after
    short = (first & ~moved(there, -2, False)) | (last & ~moved(there, 2, False)) | (first & last)
    if (short & need).any():
        raise ValueError("a derivative needs three points on each line")

    def pick(a):
        b1, b2, a1, a2 = (moved(a, n, np.nan) for n in (1, 2, -1, -2))
        return np.where(first, a, np.where(last, b2, b1)), np.where(first, a1, np.where(last, b1, a)), np.where(first, a2, np.where(last, a, a1))

    xs, fs = pick(x), pick(f)
    total = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(3):
            a, b, c = n, (n + 1) % 3, (n + 2) % 3
            total = total + fs[a] * (2 * x - xs[b] - xs[c]) / ((xs[a] - xs[b]) * (xs[a] - xs[c]))
    return total
