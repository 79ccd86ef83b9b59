"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Each source has a weight schedule over the course of training, t from 0 to 1:
weights at breakpoints, shares linear between them. Its integral gives the
source's cumulative token demand; inverting it turns a place in the source's own
token stream into a training position, and documents are range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stage, each, read

#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def sizes(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _per_source(keyed: DataFrame, weights: Sequence[Sequence[float]], cap: float) -> DataFrame:
    """One row per source: source_size, target, and the curve of cumulative demand as arrays.

    Water-filling in closed form: sources ordered by cap over weight reach
    their caps one after the other, so prefix sums of caps and suffix sums of
    weights give the common level at once. One row per source passes through
    one task, after aggregation.
    """
    k = len(weights[0]) - 1
    src = keyed.groupBy("skey").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.expr("substr(skey, 1, 1)").desc(), "skey")
    src = src.withColumn("pick", (F.row_number().over(order) - 1) % len(weights))
    table = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in weights])
    src = src.withColumn("w", F.element_at(table, F.col("pick") + 1))
    everyone = W.partitionBy(F.lit(0))
    # shares at each breakpoint sum to 1 over the sources; constant schedules need no normalising
    if k > 1 or any(len(set(w)) > 1 for w in weights):
        src = src.select("*", *[F.sum(F.col("w")[i]).over(everyone).alias(f"_t{i}") for i in range(k + 1)])
        src = src.withColumn("s", F.array(*[F.col("w")[i] / F.col(f"_t{i}") for i in range(k + 1)])).drop(*[f"_t{i}" for i in range(k + 1)])
    else:
        src = src.withColumn("s", F.col("w"))
    parts = [(F.col("s")[i] + F.col("s")[i + 1]) / 2 / k for i in range(k)]
    total = sum(parts[1:], parts[0])
    cum = [F.lit(0.0)]
    for x in parts:
        cum.append(cum[-1] + x)
    src = src.withColumn("weight", total).withColumn("curve", F.array(*[c / total for c in cum]))
    src = src.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_level = W.orderBy(F.col("most") / F.col("weight"), "skey")
    above = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    below = by_level.rowsBetween(W.unboundedPreceding, -1)
    src = src.select(
        "*", F.sum("source_size").over(everyone).cast("double").alias("all_size"), F.coalesce(F.sum("most").over(below), F.lit(0.0)).alias("filled"), F.sum("weight").over(above).alias("open")
    )
    # the level if this source were the first below its cap: it rises up to the source that is, and falls after it
    src = src.withColumn("level", F.max((F.col("all_size") - F.col("filled")) / F.col("open")).over(everyone))
    src = src.withColumn("target", F.least("most", F.col("level") * F.col("weight")))
    return src.select("skey", "source_size", "target", "curve", F.transform("s", lambda x: x / F.col("weight")).alias("rate"))


#: Documents in a part of a source that is sorted in one place, about; and the fewest hexadecimal digits that name a part.
PART, LEAST_DIGITS = 100_000, 3


def _groups(docs: DataFrame, weights: Sequence[Sequence[float]], cap: float) -> DataFrame:
    """A row for each id, source and size: doc_id, source, size, n (documents of them), offset (of the first), source_size, target, quota, curve, rate."""
    if any(len(w) != len(weights[0]) or len(w) < 2 or min(w) < 0 or sum(w) <= 0 for w in weights):
        raise ValueError("schedules need as many weights each, two at least, none negative and not all 0")
    stage = Stage(docs.sparkSession, "mix")
    # rows that repeat an id, null or not, go as one before anything is sorted
    keyed = docs.select("doc_id", "source", sizes(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    keyed = keyed.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    keyed = stage.put(keyed, "keyed")
    rows, digits = keyed.count(), LEAST_DIGITS
    while rows > PART * 16**digits:
        digits += 1
    keyed = keyed.withColumn("part", F.substring("h", 1, digits))
    parts = stage.put(keyed.groupBy("skey", "part").agg(F.sum(F.col("size") * F.col("n")).alias("size")), "parts")
    before = W.partitionBy("skey").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("skey", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before")).join(_per_source(parts, weights, cap), "skey")
    within = W.partitionBy("skey", "part").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = keyed.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(within)).hint("merge").join(offsets, ["skey", "part"])
    return out.select("doc_id", "source", "size", "n", (F.col("before") + F.col("upto") - F.col("size") * F.col("n")).alias("offset"), "source_size", "target", F.floor("target").cast("long").alias("quota"), "curve", "rate")


def plan_mix(spark: SparkSession, docs: DataFrame, weights: Sequence[Sequence[float]] = ((1, 1), (2, 2), (3, 3)), cap: float = 3.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, offset, quota, taken, position.

    ``weights``: schedules, each the weights at equally spaced breakpoints of
    training; sources in code-point order, null last, take them in turn. The
    mix has as many words as the documents; a target stops at ``cap`` times its
    source's size and the excess goes to the others by weight until none is
    above. A source is read in the order of its documents' id digests, again
    and again, until ``quota`` (its target in whole words) is reached: ``taken`` sums
    to the quota exactly, and the document at the end counts in part. ``position`` is where
    in training (0 to 1) the document first occurs; one beyond the quota gets a
    position from 1 on. Empty and null texts have size 0, are taken 0 times, and have the position where they stand. Null ids and repeated rows
    are rows like any other. Other columns are ignored. No documents: no rows.

    A source's running sum is taken in two levels, within and over parts named by
    the leading digits of the digest; their number follows that of the documents, so that no source is in one task.
    Rows of one id, source and size are counted first and told apart last, so a null id may have any share of the rows.
    """
    rows = each(_groups(docs, weights, cap), "n", "copy").withColumn("offset", F.col("offset") + F.col("copy") * F.col("size"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    rows = rows.withColumn("full", full).withColumn("taken", F.expr("full * size + greatest(0L, least(size, quota - full * source_size - offset))").cast("long"))
    rows = rows.withColumn("position", position(F.col("offset")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "offset", "quota", "taken", "position")


def position(offset):
    """Inverse of the cumulative demand: where in training the source's stream is at ``offset`` words; past 1 beyond the quota."""
    x = offset / F.greatest(F.col("quota"), F.lit(1))
    # the segment of the curve that holds x
    seg = F.greatest(F.lit(1), F.least(F.size("curve") - 1, F.size(F.filter("curve", lambda c: c <= x))))
    h = F.lit(1.0) / (F.size("curve") - 1)
    a = (F.element_at("rate", (seg + 1).cast("int")) - F.element_at("rate", seg.cast("int"))) / (h * 2)
    b, y = F.element_at("rate", seg.cast("int")), x - F.element_at("curve", seg.cast("int"))
    root = F.sqrt(F.greatest(F.lit(0.0), b * b + a * y * 4))
    t = (seg - 1) * h + F.when(b + root > 0, y * 2 / (b + root)).otherwise(F.lit(0.0))
    return F.when(F.col("quota") <= 0, offset + 1.0).when(x >= 1, x).otherwise(F.least(t, F.lit(1.0)))


#: Parts of the rows of one id, source and size that are put in order apart.
SALTS = 256


def materialise(spark: SparkSession, docs: DataFrame, whole: bool = False, weights: Sequence[Sequence[float]] = ((1, 1), (2, 2), (3, 3)), cap: float = 3.0) -> DataFrame:
    """The mix itself, range-sorted by training position: the columns of ``docs``, whatever their names, a row for each time a document is taken.

    The last document of a source that its quota reaches ends with the quota's
    last word; ``whole``: it is taken whole or not at all, whichever is nearer to the quota
    (whole if both are). Rows of one id, source and size, null or not, share their places, in an order that follows from their hashes.
    Documents without words, null texts among them, aren't taken. No documents: no rows.

    A row stays in one struct, so texts move twice: to their places, and to their positions.
    """
    key = lambda doc_id, source, size: F.sha2(F.concat_ws("|", doc_id.cast("string"), F.lit("/"), size.cast("string"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))), 256)
    plan = _groups(docs, weights, cap).where("size > 0 AND offset < quota").withColumn("key", key(F.col("doc_id"), F.col("source"), F.col("size")))
    plan = plan.select("key", "size", "offset", "source_size", "quota", "curve", "rate")
    words = sizes(F.col("text"))
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    salt = F.pmod(hashed, F.lit(SALTS))
    # places of rows of one key: those of a salt stand together, after those of the salts before, so that a key with any share of the rows is in no single task
    salted = docs.select(key(F.col("doc_id"), F.col("source"), words).alias("key"), salt.alias("salt"), words.alias("words")).where("words > 0").groupBy("key", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = salted.withColumn("before", before).drop("n").join(plan, "key")
    row = docs.select(key(F.col("doc_id"), F.col("source"), words).alias("key"), salt.alias("salt"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), hashed.alias("hash"), words.alias("words")).where("words > 0").drop("words")
    row = row.withColumn("nth", F.row_number().over(W.partitionBy("key", "salt").orderBy("hash")) - 1)
    taken = row.hint("merge").join(plan, ["key", "salt"]).withColumn("offset", F.col("offset") + (F.col("before") + F.col("nth")) * F.col("size")).where("offset < quota")
    taken = taken.withColumn("epoch", F.explode(F.expr("sequence(0L, (quota - offset - 1) div source_size)")))
    taken = taken.withColumn("at", F.col("offset") + F.col("epoch") * F.col("source_size")).withColumn("words", F.least(F.col("size"), F.col("quota") - F.col("at")))
    if whole:
        taken = taken.where("2 * words >= size").withColumn("words", F.col("size"))
    found = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(found, F.lit(1), F.col("words").cast("int")), ""))
    out = taken.select("row", text.alias("text"), position(F.col("at")).alias("position"), F.col("row.doc_id").alias("id"))
    out = out.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "position", "id").sortWithinPartitions("position", "id")
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the order of their training positions: doc_id, size, source_size, target, taken. Nulls, ties and repeated rows: see plan_mix."""
    plan = plan_mix(spark, read(spark, sf_dir, "documents"))
    rows = Stage(spark, "plan").put(plan.select("doc_id", "size", "source_size", "target", "taken", "position"), "rows")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "position", "doc_id").sortWithinPartitions("position", "doc_id").drop("position")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS most FROM s),
f AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS all_size,
    coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
    sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM w),
l AS (SELECT *, max((all_size - filled) / free) OVER () AS level FROM f),
t AS (SELECT source, source_size, least(most, level * weight) AS target, CAST(floor(least(most, level * weight)) AS BIGINT) AS quota FROM l),
o AS (
  SELECT doc_id, size, source_size, target, quota,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS off,
    CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS full_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(full_ * size + greatest(0, least(size, quota - full_ * source_size - off)) AS BIGINT) AS taken FROM o
"""
