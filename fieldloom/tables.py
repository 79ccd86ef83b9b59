"""Tables bucketed and sorted by a key, kept in a folder and opened again by any session."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Bucketed:
    """A table at ``path`` (a URI that all executors see), bucketed and sorted by ``key``: joins and aggregates by it need no exchange of the table.

    ``path`` holds about.json, which says the key, the number of buckets and which folder has the rows now. A later session opens the same table
    with its buckets, whatever number it asks for. Another key raises ValueError; no folder and no schema, FileNotFoundError.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, schema: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        about = self._read()
        if about is None:
            if schema is None or key is None:
                raise FileNotFoundError(f"no bucketed table at {path}")
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            about = {"key": key, "buckets": n, "schema": schema, "rows": f"rows-{uuid.uuid4().hex}"}
            self._write(about)
        if key not in (None, about["key"]):
            raise ValueError(f"{path} is bucketed by {about['key']}")
        self.about, self.buckets = about, about["buckets"]
        self._declare()

    def _hadoop(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read(self) -> dict | None:
        fs, p = self._hadoop("about.json")
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/about.json").collect())) if fs.exists(p) else None

    def _write(self, about: dict) -> None:
        """Under another name first, and then renamed over the old one: a whole about.json is there at any time."""
        fs, new = self._hadoop(f".about-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(about).encode()))
        out.close()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(self._hadoop("about.json")[1]), over)

    @property
    def folder(self) -> str:
        return f"{self.path}/{self.about['rows']}"

    @property
    def name(self) -> str:
        """The table's name in the session's catalog, which follows from its folder."""
        return f"bucketed_{hashlib.sha256(self.folder.encode()).hexdigest()[:24]}"

    def _declare(self) -> None:
        fs, p = self._hadoop(self.about["rows"])
        fs.mkdirs(p)
        if not self.spark.catalog.tableExists(self.name):
            key = self.about["key"]
            self.spark.sql(f"CREATE TABLE {self.name} ({self.about['schema']}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")
        self.spark.catalog.refreshTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _put(self, df: DataFrame) -> None:
        columns = [c.split()[0].strip("`") for c in self.about["schema"].split(", ")]
        dealt = df.select(*columns).repartition(self.buckets, self.about["key"])  # a file for each bucket
        dealt.write.format("parquet").mode("append").bucketBy(self.buckets, self.about["key"]).sortBy(self.about["key"]).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def append(self, df: DataFrame, most_files: int = 16) -> None:
        """Adds rows, a file to each bucket. With over ``most_files`` files for each, on average, the table is compacted, since a read must sort a bucket's files together."""
        self._put(df)
        if self.files() > most_files * self.buckets:
            self.compact()

    def files(self) -> int:
        fs, p = self._hadoop(self.about["rows"])
        return sum(s.getPath().getName().startswith("part-") for s in fs.listStatus(p))

    def replace(self, df: DataFrame) -> None:
        """Puts other rows in the place of all; ``df`` may read the table. The old rows stay valid until the new ones are whole."""
        old, old_name = self.about, self.name
        self.about = old | {"rows": f"rows-{uuid.uuid4().hex}"}
        self._declare()
        self._put(df)
        self._write(self.about)
        self.spark.sql(f"DROP TABLE IF EXISTS {old_name}")
        fs, p = self._hadoop(old["rows"])
        fs.delete(p, True)

    def compact(self) -> None:
        """Rewrites the table as one sorted file a bucket. Files are read as such: from the bucketed table Spark would leave out the exchange, and then the buckets."""
        self.replace(self.spark.read.schema(self.table().schema).parquet(self.folder))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        fs, p = self._hadoop()
        fs.delete(p, True)
