"""Session settings and names that all parts share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Columns of a mesh partition, and of a structured snapshot (e is the temperature).
NODE_COLUMNS = ["X", "Y", "Z", "U", "V", "W", "P", "T", "rho", "mu", "beta", "cp", "kappa"]
SNAPSHOT_COLUMNS = ["u", "v", "w", "p", "e", "u_mean", "v_mean", "w_mean", "e_mean"]
#: Fields of a structured flow in long form; the temperature is named apart from the mesh's T, as names ignore case.
FLOW = ["u", "v", "w", "t_val"]


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("fieldloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def small_batches(spark: SparkSession, most: int = 32 << 20) -> None:
    """Bounds the session's Arrow batches by bytes, as rows may hold long arrays; a smaller bound stays."""
    name, jvm = "spark.sql.execution.arrow.maxBytesPerBatch", spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    if jvm.byteStringAsBytes(str(spark.conf.get(name))) > most:
        spark.conf.set(name, str(most))


def result_path(folder: str, name: str, tag: str = "") -> str:
    return f"{folder.rstrip('/')}/{name}_{tag}" if tag else f"{folder.rstrip('/')}/{name}"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one in local mode, as in tests; a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")
