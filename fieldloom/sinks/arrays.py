"""NumPy files written by tasks: parts in parallel, as every row has a fixed size, and one task that puts them one after the other."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

#: Types that a column's values have in a file. A null raises, as none of these holds it, but for floating point, where it is NaN.
TYPES = {"bigint": "<i8", "int": "<i4", "smallint": "<i2", "tinyint": "|i1", "double": "<f8", "float": "<f4"}
COPY = 4 << 20


def header(dtype: np.dtype, shape: tuple[int, ...]) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_2_0(out, {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": shape})
    return out.getvalue()


def put_parts(df: DataFrame, columns: Sequence[str], order: Sequence[str], folder: str, common: str | None = None) -> tuple[np.dtype, list[str], int]:
    """Writes the rows of ``df``, sorted by ``order``, as raw records under ``folder``: their type, the parts in order, and how many rows there are.

    ``common``: a type for all columns, which then make up a plain matrix. A part that is written again after a failure has another name; only the names of whole ones come back.
    """
    kinds = dict(df.dtypes)
    if bad := [c for c in columns if kinds[c] not in TYPES]:
        raise ValueError(f"no fixed size: {bad}")
    dtype = np.dtype(common) if common else np.dtype([(c, TYPES[kinds[c]]) for c in columns])
    record = np.dtype([(c, common or TYPES[kinds[c]]) for c in columns])

    def run(batches):
        out, n = None, 0
        name = f"{folder}/{uuid.uuid4().hex}"
        for batch in batches:
            if batch.num_rows:
                rows = np.empty(batch.num_rows, record)
                for c in columns:
                    values = batch.column(c)
                    if values.null_count and np.dtype(record[c]).kind != "f":
                        raise ValueError(f"a null in {c}")
                    rows[c] = values.to_numpy(zero_copy_only=False)
                out = out or files.create(name)
                out.write(rows.tobytes())
                n += batch.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([name]), pa.array([n])], names=["part", "name", "n"])

    keys = [f"_o{k}" for k in range(len(order))]
    rows = df.select(*[F.col(o).alias(k) for k, o in zip(keys, order, strict=True)], *columns).repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = sorted(rows.mapInArrow(run, "part long, name string, n long").collect())  # a row for each partition
    return dtype, [p["name"] for p in parts], sum(p["n"] for p in parts)


def _copy(names: Sequence[str], out) -> None:
    for name in names:
        with files.open_(name) as f:
            while some := f.read(COPY):
                out.write(some)


def _one_task(spark: SparkSession, work) -> None:
    def run(batches):
        for pdf in batches:
            work()
            yield pdf

    spark.range(1).mapInPandas(run, "id long").collect()


def _moved(path: str, write) -> None:
    """A file that is there at once, whole: written under another name first."""
    new = f"{path}.{uuid.uuid4().hex}"
    with files.create(new) as out:
        write(out)
    store, p = files.store(path)
    store.move(files.store(new)[1], p)


def write_npy(path: str, df: DataFrame, columns: Sequence[str], order: Sequence[str], most_rows: int | None = None) -> None:
    """One .npy file: a structured array with a field for each column, by ``order``. No rows go to the driver; more than ``most_rows``, if given, raise ValueError."""
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    dtype, names, n = put_parts(df, columns, order, folder)
    try:
        if most_rows is not None and n > most_rows:
            raise ValueError(f"more than {most_rows} rows")

        def work():
            _moved(path, lambda out: (out.write(header(dtype, (n,))), _copy(names, out)))

        _one_task(df.sparkSession, work)
    finally:
        files.drop_folder(folder)


def write_npz(path: str, nodes: DataFrame, variables: Sequence[str], elems: DataFrame | None = None, order: str = "node_id", elem_order: str = "elem_idx", most_rows: int | None = None) -> None:
    """One .npz file with data (a column for each variable, doubles), var_names and, if there are elements, conn (from 0). As write_npy."""
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    try:
        members = [("data", *put_parts(nodes, variables, [order], folder, "<f8"), len(variables))]
        if elems is not None:
            members.append(("conn", *put_parts(elems, ["n0", "n1", "n2", "n3"], [elem_order], folder, "<i8"), 4))
        if most_rows is not None and max(m[3] for m in members) > most_rows:
            raise ValueError(f"more than {most_rows} rows")

        def write(out) -> None:
            with zipfile.ZipFile(_Sequential(out), "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
                for name, dtype, names, n, width in members:
                    with z.open(f"{name}.npy", "w", force_zip64=True) as member:
                        member.write(header(dtype, (n, width)))
                        _copy(names, member)
                names_ = np.array(list(variables))
                with z.open("var_names.npy", "w") as member:
                    member.write(header(names_.dtype, names_.shape) + names_.tobytes())

        _one_task(nodes.sparkSession, lambda: _moved(path, write))
    finally:
        files.drop_folder(folder)


class _Sequential(io.RawIOBase):
    """A stream that can't be gone back in, as stores of files write."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, b) -> int:
        self.out.write(b)
        return len(b)


def read_npy(spark: SparkSession, path: str, rows: int = 1_000_000) -> DataFrame:
    """row (from 0) and a column for each field of a structured array in a .npy file, or c0, c1, ... of a plain matrix or vector; ``rows`` rows a task, which reads no more than these."""
    with files.open_(path) as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        start = f.tell()
    if fortran or len(shape) > 2:
        raise ValueError(f"{path} isn't a table by rows")
    width = shape[1] if len(shape) > 1 else 1
    record = dtype if dtype.names else np.dtype([(f"c{k}", dtype) for k in range(width)])
    kinds = {"i8": "long", "i4": "int", "i2": "smallint", "i1": "byte", "f8": "double", "f4": "float"}
    schema = "row long, " + ", ".join(f"`{c}` {kinds[record[c].str[1:]]}" for c in record.names)
    todo = [(a, min(shape[0], a + rows)) for a in range(0, shape[0], rows)]

    def run(batches):
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                with files.open_(path) as f:
                    f.seek(start + int(a) * record.itemsize)
                    values = np.frombuffer(f.read(int(b - a) * record.itemsize), record)
                yield pd.DataFrame({"row": np.arange(a, b), **{c: values[c] for c in record.names}})

    return spark.createDataFrame(todo, "a long, b long").repartition(max(1, len(todo))).mapInPandas(run, schema)
