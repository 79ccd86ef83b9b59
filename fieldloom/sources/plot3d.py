"""Structured grids and snapshots in little-endian Fortran records: a byte count before and after each record, i fastest."""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import FloatType, IntegerType, LongType, StructField, StructType

from ..session import SNAPSHOT_COLUMNS
from .files import TASKS, create, find, joined, open_, packed

#: Fixed value: how a snapshot's file is named.
NAME = re.compile(r"grid(\d+)\.(\d+)\.f$")
CHUNK = 500_000


def record(f) -> bytes:
    """The next record; raises AssertionError if the counts around it differ or the file ends."""
    head = f.read(4)
    assert len(head) == 4, "the file ends before a record"
    (n,) = struct.unpack("<i", head)
    body, tail = f.read(n), f.read(4)
    assert len(body) == n and len(tail) == 4, "the file ends inside a record"
    assert struct.unpack("<i", tail)[0] == n, "a record's byte counts differ"
    return body


def bounds(f, size: int, path: str) -> int:
    """Where the body of the next record, of ``size`` bytes, begins; raises AssertionError as record does."""
    head = f.read(4)
    assert len(head) == 4, "the file ends before a record"
    (n,) = struct.unpack("<i", head)
    assert n == size, f"{path} holds {n // 4} values, not {size // 4}"
    start = f.tell()
    f.seek(start + n)
    tail = f.read(4)
    assert len(tail) == 4, "the file ends inside a record"
    assert struct.unpack("<i", tail)[0] == n, "a record's byte counts differ"
    return start


def snapshot_order(path: str) -> tuple[int, int]:
    m = NAME.search(path)
    if not m:
        raise ValueError(f"no grid and time number in {path}")
    return int(m[1]), int(m[2])


@dataclass
class Part(InputPartition):
    """One of ``of`` equal parts of a file's planes."""

    path: str
    nth: int = 0
    of: int = 1


@dataclass
class Parts(InputPartition):
    """Parts that a task reads one after the other."""

    parts: list[Part]


#: Points of a part of a file.
PART = 8_000_000


class Plot3DSource(DataSource):
    """Options: section (grid or snapshots), pattern, ordinals, times, places (see sources.read_snapshots), tasks (among which small files are dealt).

    What is read is said by options, not by filters that Spark pushes down: Spark keeps what was pushed last for all that is made of one DataFrame.
    """

    @classmethod
    def name(cls) -> str:
        return "plot3d"

    def files(self) -> list[str]:
        if self.options.get("section", "snapshots") == "grid":
            return [self.options["path"]]
        found = sorted((p for p in find(self.options["path"], self.options.get("pattern", "grid*.f")) if NAME.search(p)), key=snapshot_order)
        if not found:
            raise FileNotFoundError(f"no snapshots in {self.options['path']}")
        if (text := self.options.get("times")) is not None:
            wanted = {int(x) for x in text.split(",") if x}
            found = [p for p in found if snapshot_order(p)[1] in wanted]
        if text := self.options.get("ordinals"):
            wanted = [int(x) for x in text.split(",")]
            if not all(0 <= n < len(found) for n in wanted):
                raise IndexError(f"there are {len(found)} snapshots")
            found = [found[n] for n in wanted]
        return found

    def schema(self) -> StructType:
        index = [StructField(c, IntegerType()) for c in "ijk"]
        if self.options.get("section", "snapshots") == "grid":
            return StructType([*index, *[StructField(c, FloatType()) for c in "xyz"]])
        if not (files := self.files()):
            raise FileNotFoundError(f"no snapshots of these times in {self.options['path']}")
        with open_(files[0]) as f:  # the first file's header says how many variables there are
            nvar = struct.unpack("<4i", record(f))[3]
        return StructType([StructField("grid_num", LongType()), StructField("time_num", LongType()), *index, *[StructField(c, FloatType()) for c in SNAPSHOT_COLUMNS[:nvar]]])

    def reader(self, schema: StructType) -> Plot3DReader:
        return Plot3DReader(self.files, self.options.get("section", "snapshots") == "grid", [f.name for f in schema.fields], json.loads(self.options.get("places", "{}")), int(self.options.get("tasks", TASKS)))


class Plot3DReader(DataSourceReader):
    """``files``: paths, or a function that lists them. Every task gets the reader, which so doesn't hold the list."""

    def __init__(self, files: list[str] | Callable[[], list[str]], grid: bool, names: list[str], places: dict[str, list] | None = None, tasks: int = TASKS):
        self.files, self.grid, self.names, self.tasks = files, grid, names, tasks
        places = places or {}
        self.low, self.high = ({a: places.get(a, [None, None])[n] for a in "ijk"} for n in (0, 1))  # the places that are asked for, both ends in

    def partitions(self) -> list[InputPartition]:
        files = self.files() if callable(self.files) else self.files
        if not files:
            return []
        with open_(files[0]) as f:  # files of one run are alike; another size only makes parts larger
            nx, ny, nz = struct.unpack("<3i", record(f)[:12])
        n = min(nz, -(-nx * ny * nz // PART))
        k0, k1 = self._range("k", nz)
        n = n if k1 - k0 == nz else 1
        parts = [Part(p, k, n) for p in files for k in range(n)]
        rows = (b - a for a, b in (self._range(c, m) for c, m in zip("ijk", (nx, ny, nz), strict=True)))
        size = 20 * math.prod(max(0, x) for x in rows) // n  # of five variables, as most files hold
        return [g[0] if len(g) == 1 else Parts(g) for g in packed(parts, [size] * len(parts), self.tasks, 20 * PART)]

    def _range(self, name: str, n: int) -> tuple[int, int]:
        low, high = self.low[name] or 0, n if self.high[name] is None else min(n, self.high[name] + 1)
        return max(0, low), max(0, low, high)

    def read(self, part: Part | Parts | None) -> Iterator[pa.RecordBatch]:
        if isinstance(part, Parts):
            yield from joined(b for p in part.parts for b in self._read(p))
        elif part is not None:
            yield from self._read(part)

    def _read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with open_(part.path) as f:
            head = record(f)
            nx, ny, nz = struct.unpack("<3i", head[:12])
            n = nx * ny * nz
            nvar = 3 if self.grid else struct.unpack("<4i", head)[3]
            keys = [] if self.grid else list(snapshot_order(part.path))
            width = len(self.names) - 3 - len(keys)
            assert width <= nvar, f"{part.path} has fewer variables than the first snapshot"
            start = bounds(f, 4 * nvar * n, part.path)
            (i0, i1), (j0, j1), (k0, k1) = self._range("i", nx), self._range("j", ny), self._range("k", nz)
            k0, k1 = max(k0, nz * part.nth // part.of), min(k1, nz * (part.nth + 1) // part.of)
            if i0 >= i1 or j0 >= j1:
                return
            whole = (j0, j1) == (0, ny)  # whole planes follow one another; else each plane has its own run of rows
            rows = [(k0 * ny, k1 * ny)] if whole else [(k * ny + j0, k * ny + j1) for k in range(k0, k1)]
            step = max(1, CHUNK // nx)
            spans = [(a, min(b, a + step)) for lo, b in rows for a in range(lo, b, step)]
            for some in _together(spans, step):  # no more than a chunk of the asked variables is in memory
                r = np.concatenate([np.arange(a, b) for a, b in some])
                p = (r[:, None] * nx + np.arange(i0, i1)).ravel()
                cols = [pa.array(np.full(len(p), k, np.int64)) for k in keys]
                cols += [pa.array(x.astype(np.int32)) for x in (p % nx, p // nx % ny, p // (nx * ny))]
                for v in range(width):
                    values = []
                    for a, b in some:
                        f.seek(start + 4 * (v * n + a * nx))
                        values.append(np.frombuffer(f.read(4 * (b - a) * nx), "<f4").reshape(-1, nx)[:, i0:i1])
                    cols.append(pa.array(np.concatenate(values).ravel()))
                yield pa.RecordBatch.from_arrays(cols, names=self.names)


def _together(spans: list[tuple[int, int]], most: int) -> Iterator[list[tuple[int, int]]]:
    """Spans in groups of about ``most`` rows."""
    held, n = [], 0
    for a, b in spans:
        held.append((a, b))
        n += b - a
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def write_record(f, body: bytes) -> None:
    f.write(struct.pack("<i", len(body)) + body + struct.pack("<i", len(body)))


def write_grid(path: str, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> None:
    with create(path) as f:
        write_record(f, struct.pack("<3i", *x.shape))
        write_record(f, b"".join(a.astype("<f4").ravel(order="F").tobytes() for a in (x, y, z)))


def write_snapshot(path: str, values: np.ndarray) -> None:
    """values: (nx, ny, nz, nvar)."""
    with create(path) as f:
        write_record(f, struct.pack("<4i", *values.shape))
        write_record(f, values.astype("<f4").ravel(order="F").tobytes())
