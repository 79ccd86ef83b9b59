"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by digest. A batch is reduced to its
digests, sort-merge anti-joined with the index (whose side needs no exchange),
and the digests not yet known are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..tables import Bucketed
from .common import LOWER, UPPER, Stage, ascii_lower, each, read, row_key, rows_of


def text_digest(text):
    """SHA-256 of the text with A-Z lower-cased, in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """Digests seen so far: ``digest, keep_id, group_size`` (rows of the batch that brought it).

    The index lies in a folder of its ``name`` under ``folder``, or under indexes in the shared folder, and a later session opens it again by the same name.
    ``n_buckets`` should match the shuffle partitions of the jobs that ingest,
    so that a batch meets the index without moving it; that is the default of a new index.
    """

    def __init__(self, spark: SparkSession, name: str, n_buckets: int | None = None, folder: str | None = None):
        self.spark = spark
        self.rows = Bucketed(spark, f"{folder or f'{shared_dir(spark)}/indexes'}/{name}", "digest", "digest binary, keep_id long, group_size long", n_buckets)
        self.n_buckets = self.rows.buckets

    @property
    def table(self) -> str:
        """The index's name in the session's catalog."""
        return self.rows.name

    def _add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """The batch's ids and texts (doc_id, digest, n: rows of both), and what the index now says of its texts (digest, keep_id, group_size). Appends what is new."""
        stage = Stage(self.spark, "digests")
        rows = stage.put(
            docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest")).groupBy("digest", "doc_id").agg(F.count("*").alias("n")),
            "rows",
        )
        # written, as Spark would otherwise take the anti-join to the rows, of which a text may have a third
        heads = stage.put(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "heads")
        self.rows.append(heads.hint("merge").join(self.rows.table().select("digest"), "digest", "left_anti"))
        # what the index says of the batch's digests, as a plain table: the join below is then free to split, and later appends and compactions don't touch it
        found = stage.put(heads.select("digest", "group_size").hint("merge").join(self.rows.table().select("digest", "keep_id"), "digest"), "found")
        return rows, found

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicates a batch against the index and itself, and appends what is new.

        Returns one row per row of ``docs``: doc_id, keep_id, group_size (rows
        of this batch with the text), kept, digest. Of equal texts the row with
        the largest id stays, unless an earlier batch holds the text. Rows that
        repeat an id and a text count in group_size, but one alone is kept; a
        null id stays only where no row of the group has an id. Null and empty
        texts are one group. Ingesting a batch twice gives the same rows: a row
        is kept where its id is the index's keep_id. Other columns of ``docs``
        may have any name; an empty batch gives no rows.

        A digest or an id with any share of the rows is pre-aggregated before
        each exchange, and the last join has plain exchanges on both sides, so
        that adaptive execution splits a hot digest.
        """
        rows, found = self._add(docs, id_col, text_col)
        out = each(rows.hint("merge").join(found, "digest").select("doc_id", "keep_id", "group_size", "n", "digest"), "n", "copy")
        return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"), "digest")

    def compact(self) -> None:
        """Rewrites the index as one sorted file a bucket; a whole index is there at any time. Appends do so by themselves when files have grown too many."""
        self.rows.compact()

    def drop(self) -> None:
        self.rows.drop()


def new_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"digests-{uuid.uuid4().hex}")


def deduplicate(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns, whatever their names) that stay, with their columns; see DigestIndex.ingest.

    Null and empty texts count as equal, so one of them stays; a null id stays only where no equal text has an id. No rows give none.
    """
    own = new_index(spark) if index is None else index
    # a text whose id to keep came with an earlier batch has no such row here
    keys = own._add(docs)[1].select(row_key(F.col("digest"), F.col("keep_id")).alias("_key"))
    if index is None:
        own.drop()
    return rows_of(docs, text_digest(F.col("text")), keys)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a new index: doc_id, keep_id, group_size, kept, text_sha256. Nulls, ties and repeated rows: see DigestIndex.ingest."""
    index = new_index(spark)
    report = index.ingest(read(spark, sf_dir, "documents"))
    index.drop()  # the report is of staged tables
    return report.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
