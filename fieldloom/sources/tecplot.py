"""Mesh partitions in ASCII: three header lines, node rows, and rows of four node numbers from 1."""

from __future__ import annotations

import io
import json
import re
import time
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..session import NODE_COLUMNS
from .files import TASKS, create, joined, listed, open_, packed, store

#: How a partition's file is named, and where its header says how many nodes and elements there are.
NAME = re.compile(r"tecplot_blk(\d+)_iter(\d+)\.dat$")
SIZES = re.compile(r"N\s*=\s*(\d+)\s*,\s*E\s*=\s*(\d+)")
CHUNK = 200_000


@dataclass
class Header:
    n_columns: int
    n_nodes: int
    n_elements: int


def parse_header(lines: list[str], path: str = "") -> Header:
    if len(lines) < 3 or not (m := SIZES.search(lines[1])):
        raise ValueError(f"no N=..., E=... in the header of {path}")
    if "FETETRAHEDRON" not in lines[2].upper():
        warnings.warn(f"{path} isn't a zone of tetrahedra", stacklevel=2)
    return Header(lines[0].count('"') // 2, int(m[1]), int(m[2]))


@dataclass
class Part(InputPartition):
    """A file, or with ``end`` the lines that begin in its bytes from ``start`` to before ``end``, the first of which is number ``line`` of the file."""

    path: str
    blk: int
    iter: int
    start: int = 0
    end: int | None = None
    line: int = 0
    head: Header | None = None


@dataclass
class Parts(InputPartition):
    """Parts that a task reads one after the other."""

    parts: list[Part]


#: Bytes of a part of an indexed file, and of small files that are read in one task.
PART = 32 << 20


def name_of(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def read_index(folder: str) -> dict[str, dict]:
    """What an index says of each file, by its name: size, part, before, head. Of a file that was indexed several times, the last."""
    about = {}
    for path, _ in listed(folder, "*.lines.jsonl"):
        with open_(path) as f:
            about.update((x["file"], x) for x in map(json.loads, f.read().splitlines()))
    return about


def count_lines(path: str, begin: int, end: int) -> int:
    """Line ends in the bytes from ``begin`` to before ``end``."""
    n = 0
    with open_(path) as f:
        f.seek(begin)
        while begin < end and (some := f.read(min(1 << 22, end - begin))):
            n += some.count(b"\n")
            begin += len(some)
    return n


def window(size: int, k: int, part: int = PART) -> tuple[int, int]:
    """The bytes in which line ends are counted for a file's part: a line that begins at a part's first byte has its predecessor's end one byte before."""
    a = k * part
    return max(0, a - 1), min(size, a + part) - 1 if a + part < size else size


def index_entry(path: str, size: int, counts: list[int], part: int) -> dict:
    """How many line ends stand before each part, and what the header says; a file with too few lines raises ValueError."""
    with io.TextIOWrapper(io.BufferedReader(open_(path)), encoding="utf-8") as f:
        head = parse_header([f.readline() for _ in range(3)], path)
    with open_(path) as f:
        f.seek(max(0, size - 1))
        lines = sum(counts) + (f.read(1) != b"\n")
    if lines < 3 + head.n_nodes + head.n_elements:
        raise ValueError(f"{path} has {lines} lines where its header asks for {3 + head.n_nodes + head.n_elements}")
    return {"file": name_of(path), "size": size, "part": part, "before": [sum(counts[:k]) for k in range(len(counts))], "head": asdict(head)}


def write_index(folder: str, entries: Iterator[dict]) -> int:
    """A task's entries as one file, which has its name only when it is whole."""
    name = f"{folder.rstrip('/')}/{time.time_ns():020d}-{uuid.uuid4().hex}"
    n = 0
    with create(f"{name}.part") as out:
        for n, e in enumerate(entries, 1):
            out.write(json.dumps(e).encode() + b"\n")
    s, p = store(name)
    s.move(f"{p}.part", f"{p}.lines.jsonl")
    return n


class TecplotSource(DataSource):
    """Options: section (nodes or elems), columns, iters, pattern, dtype, index (a folder of line indexes, see sources.index_partitions), tasks (among which small files are dealt).

    Iterations are said by an option, not by filters that Spark pushes down: Spark keeps what was pushed last for all that is made of one DataFrame.
    """

    @classmethod
    def name(cls) -> str:
        return "tecplot_fe"

    def columns(self) -> list[str]:
        asked = [c for c in self.options.get("columns", ",".join(NODE_COLUMNS)).split(",") if c]
        if unknown := set(asked) - set(NODE_COLUMNS):
            raise ValueError(f"no such variable: {sorted(unknown)}")
        return ["X", "Y", "Z", *[c for c in dict.fromkeys(asked) if c not in ("X", "Y", "Z")]]

    def schema(self) -> StructType:
        keys = [StructField("iter", LongType()), StructField("blk", IntegerType())]
        if self.options.get("section", "nodes") == "elems":
            return StructType([*keys, StructField("elem_idx", LongType()), *[StructField(f"n{c}", LongType()) for c in range(4)]])
        return StructType([*keys, StructField("node_idx", LongType()), *[StructField(c, DoubleType()) for c in self.columns()]])

    def reader(self, schema: StructType) -> TecplotReader:
        return TecplotReader(self.options, self.columns())


class TecplotReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.path, self.pattern = options["path"], options.get("pattern", "tecplot_blk*_iter*.dat")
        self.section, self.dtype, self.columns = options.get("section", "nodes"), options.get("dtype", "float32"), columns
        self.index, self.tasks = options.get("index"), int(options.get("tasks", TASKS))
        text = options.get("iters")
        self.iters = None if text is None else {int(x) for x in text.split(",") if x}

    def partitions(self) -> list[InputPartition]:
        parts, index = [], read_index(self.index) if self.index else {}
        for path, size in listed(self.path, self.pattern):
            if not (m := NAME.search(path)):
                warnings.warn(f"skipped {path}: no block and iteration in its name", stacklevel=2)
            elif self.iters is None or int(m[2]) in self.iters:
                parts += [(p, (p.end or size) - p.start) for p in self._parts(path, size, int(m[1]), int(m[2]), index.get(name_of(path)))]
        parts.sort(key=lambda x: (x[0].iter, x[0].blk, x[0].start))
        groups = packed([p for p, _ in parts], [n for _, n in parts], self.tasks, PART)
        return [g[0] if len(g) == 1 else Parts(_merged(g)) for g in groups]

    def _parts(self, path: str, size: int, blk: int, it: int, about: dict | None) -> list[Part]:
        """The parts of an indexed file that hold lines of the section; else the file."""
        if about is None:
            return [Part(path, blk, it)]
        if about["size"] != size:
            raise ValueError(f"{path} has changed since its lines were indexed")
        head = Header(**about["head"])
        low, high = self._section(head)
        ends = [min(about["size"], (k + 1) * about["part"]) for k in range(len(about["before"]))]
        first = [n + (k > 0) for k, n in enumerate(about["before"])]  # the number of the first line that begins in the part
        last = [*first[1:], 3 + head.n_nodes + head.n_elements]
        return [Part(path, blk, it, k * about["part"], ends[k], first[k], head) for k in range(len(first)) if first[k] < high and last[k] > low]

    def _section(self, head: Header) -> tuple[int, int]:
        """The section's first line and the one after its last."""
        nodes = 3 + head.n_nodes
        return (nodes, nodes + head.n_elements) if self.section == "elems" else (3, nodes)

    def read(self, part: Part | Parts | None) -> Iterator[pa.RecordBatch]:
        if isinstance(part, Parts):
            yield from joined(b for p in part.parts for b in self._read(p))
        elif part is not None:  # else no file is left
            yield from self._read(part)

    def _read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.end is not None:
            yield from self._read_part(part)
            return
        with io.TextIOWrapper(io.BufferedReader(open_(part.path)), encoding="utf-8") as f:
            head = parse_header([f.readline() for _ in range(3)], part.path)
            if self.section == "elems":
                for _ in range(head.n_nodes):
                    if not f.readline():
                        raise ValueError(f"{part.path} ends before its {head.n_nodes} nodes do")
            low, high = self._section(head)
            yield from self._rows(part, f, head, 0, high - low)

    def _read_part(self, part: Part) -> Iterator[pa.RecordBatch]:
        """Those lines of the section that begin in the part."""
        low, high = self._section(part.head)
        with open_(part.path) as f:
            f.seek(max(0, part.start - 1))
            raw = f.read(part.end - max(0, part.start - 1))
            while not raw.endswith(b"\n") and (more := f.read(4096)):
                cut = more.find(b"\n") + 1
                raw += more[:cut] if cut else more
        begin = raw.find(b"\n") + 1 if part.start else 0
        lines, line = raw.count(b"\n", begin) + (not raw.endswith(b"\n")), part.line
        if part.start and not begin:
            return  # inside a long line
        for _ in range(max(0, low - line)):
            begin = raw.index(b"\n", begin) + 1
        first = max(low, line)
        yield from self._rows(part, io.BytesIO(raw[begin:]), part.head, first - low, max(0, min(high, line + lines) - first))

    def _rows(self, part: Part, f, head: Header, first: int, want: int) -> Iterator[pa.RecordBatch]:
        """``want`` rows of the section, the first of which is its row ``first``, from a file that stands before it."""
        if self.section == "elems":
            names, use, kind, index = ["n0", "n1", "n2", "n3"], list(range(4)), "int64", "elem_idx"
        else:
            names, use, kind, index = self.columns, [NODE_COLUMNS.index(c) for c in self.columns], self.dtype, "node_idx"
            if max(use) >= head.n_columns:
                raise ValueError(f"{part.path} has {head.n_columns} columns, not that of {self.columns}")
        got = 0
        if want:
            try:
                for pdf in pd.read_csv(f, sep=r"\s+", header=None, nrows=want, usecols=use, dtype=kind, chunksize=CHUNK, engine="c"):
                    values = pdf[use]
                    n = len(values)
                    cols = [pa.array([part.iter] * n, pa.int64()), pa.array([part.blk] * n, pa.int32()), pa.array(range(first + got, first + got + n), pa.int64())]
                    cols += [pa.array(values[c].to_numpy().astype("int64" if self.section == "elems" else "float64")) for c in use]
                    yield pa.RecordBatch.from_arrays(cols, names=["iter", "blk", index, *names])
                    got += n
            except pd.errors.EmptyDataError:
                pass
        if got != want:
            raise ValueError(f"{part.path} has {got} rows where its header says {want}")


def _merged(parts: list[Part]) -> list[Part]:
    """Parts that follow one another in a file as one."""
    out: list[Part] = []
    for p in parts:
        if out and out[-1].path == p.path and out[-1].end == p.start:
            out[-1] = replace(out[-1], end=p.end)
        else:
            out.append(p)
    return out
