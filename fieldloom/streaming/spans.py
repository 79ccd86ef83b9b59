"""Partial results in numbered folders, folded into fewer as they grow in number."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"span=(\d+)-(\d+)$")


class Spans:
    """Folders span=<first>-<last> under ``root``, each the result of the parts of these numbers.

    A folder counts if Spark has marked it whole and no other whole one holds its numbers. So a part that is made again, after
    a failure, is overwritten or passed over, and folding writes the new folder before the old ones go: whenever it stops, each number counts once.
    Numbers must come without gaps.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = 16):
        self.spark, self.root, self.most = spark, root.rstrip("/"), most

    def _fs(self):
        path = self._path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _all(self) -> list[tuple[int, int, bool]]:
        fs, root = self._fs(), self._path(self.root)
        if not fs.exists(root):
            return []
        names = [m for s in fs.listStatus(root) if (m := _NAME.search(s.getPath().getName()))]
        return [(int(m[1]), int(m[2]), fs.exists(self._path(f"{self.root}/{m[0]}/_SUCCESS"))) for m in names]

    def whole(self) -> list[tuple[int, int]]:
        """First and last number of each folder that counts."""
        done = [(a, b) for a, b, ok in self._all() if ok]
        return sorted((a, b) for a, b in done if not any((c, d) != (a, b) and c <= a and b <= d for c, d in done))

    def next(self) -> int:
        return max((b + 1 for _, b in self.whole()), default=0)

    def folder(self, first: int, last: int) -> str:
        return f"{self.root}/span={first}-{last}"

    def put(self, df: DataFrame, number: int) -> None:
        if not any(a <= number <= b for a, b in self.whole() if a < b):
            df.write.mode("overwrite").parquet(self.folder(number, number))

    def read(self) -> DataFrame | None:
        """The rows of all folders that count, or None."""
        paths = [self.folder(a, b) for a, b in self.whole()]
        return self.spark.read.parquet(*paths) if paths else None

    def fold(self, merge: Callable[[DataFrame], DataFrame]) -> None:
        """If there are more than ``most`` folders, writes their merged rows as one and drops what it holds."""
        spans = self.whole()
        if len(spans) > self.most:
            first, last = spans[0][0], spans[-1][1]
            merge(self.read()).write.mode("overwrite").parquet(self.folder(first, last))
        whole = self.whole()
        fs = self._fs()
        for a, b, _ in self._all():
            if any((c, d) != (a, b) and c <= a and b <= d for c, d in whole):
                fs.delete(self._path(self.folder(a, b)), True)
