"""Importance resampling towards a target: documents drawn by how much likelier their n-grams are in the target than in the corpus.

N-grams fall in hashed buckets. Corpus and target are counted by bucket; a
bucket's gain is the logarithm of the two shares' ratio, in thousandths. The table of gains has
a row for each bucket and is broadcast. A document's weight is the mean gain of its
features; with Gumbel noise hashed from its id, the highest scores are a draw without
replacement in proportion to the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stage, ascii_lower, each, read

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: What stands between words, which are runs of letters and digits and of anything beyond ASCII, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def ngrams(w: Column, longest: int = 2) -> Column:
    """All runs of 1 to ``longest`` neighbours of the array, joined by one space."""
    runs = [w]
    for n in range(2, longest + 1):
        more = F.greatest(F.size(w) - (n - 1), F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), more), F.slice(w, F.lit(n), more), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(*runs)


def features(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """The columns of ``texts`` but _text, with n_words, and a row for each feature with its bucket; null for a text without words."""
    w = texts.withColumn("_w", words(F.col("_text"))).drop("_text").withColumn("n_words", F.size("_w"))
    return w.withColumn("_f", F.explode_outer(ngrams(F.col("_w"), longest))).drop("_w").withColumn("bucket", (F.crc32(F.col("_f").cast("binary")) % buckets).cast("int")).drop("_f")


def bucket_counts(texts: DataFrame, name: str, buckets: int = BUCKETS, longest: int = 2) -> DataFrame:
    """bucket, and how many features of all texts (column _text) fall in it: ``buckets`` rows at most, summed in each task first."""
    return features(texts, buckets, longest).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))


def gains(stage: Stage, corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain (thousandths of the log ratio of target to corpus share, floored, with one more for each bucket) of counts (bucket, s) and (bucket, t)."""
    both = stage.put(corpus.join(target, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "counts")
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    x = lambda c, more: F.col(c).cast("double") + float(more)
    ratio = x("t", 1) * x("all_s", buckets) / (x("s", 1) * x("all_t", buckets))
    return both.join(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a digest of seed and id; a null id has no digits."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, gain: DataFrame, buckets: int = BUCKETS, longest: int = 2) -> DataFrame:
    """doc_id, two hashes of the text, n_words, n_features, weight and rows (how many rows repeat id and text).

    ``gain`` has a row for each bucket and is broadcast; a document's features are summed where they are, before any exchange, so a long text or a
    row that is repeated very often moves as one row from each task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), F.col("text").alias("_text"))
    found = features(rows, buckets, longest).join(F.broadcast(gain), "bucket", "left")
    sums = found.groupBy("doc_id", "h1", "h2", "n_words").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("total"), F.count("*").alias("found"))
    n = F.greatest(sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(longest)), F.lit(0)), F.lit(1)).cast("long")
    of_row = sums.withColumn("n", n).withColumn("rows", F.expr("found div n"))
    mean = F.expr("(total - pmod(total, found)) div found")  # floored; repeated rows change both alike
    return of_row.select("doc_id", "h1", "h2", "n_words", F.when(F.col("n_words") > 0, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_features"), mean.alias("weight"), "rows")


def ranked(stage: Stage, rows: DataFrame, order: list[Column], count: str) -> DataFrame:
    """``rows`` with _before: the sum of ``count`` over all rows that stand before a row in ``order``, which no two rows share.

    Rows are range-partitioned and sorted, and the table is written, so a row's
    partition and place are fixed; what a partition holds is one row of a small table, and a rank is what the
    partitions before hold and what stands before in its own.
    """
    # a partition id in the upper bits, the place in it in the lower
    placed = stage.put(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    held = placed.groupBy(part.alias("_part")).agg(F.sum(count).alias("_held"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = held.select("_part", before("_held", W.orderBy("_part")).alias("_first"))  # a row for each partition
    inside = before(count, W.partitionBy("_part").orderBy("_at"))
    return placed.withColumn("_part", part).withColumn("_inside", inside).join(F.broadcast(first), "_part").withColumn("_before", F.col("_first") + F.col("_inside")).drop("_part", "_at", "_inside", "_first")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 2, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_features, weight, score and rank, all long.

    Of the documents with at least ``least_words`` words, ``percent`` of 100 are drawn, those of the highest scores; ranks count from 1, and the rest
    have none. Ties go to the smaller doc_id (null first), then to the text's hash; rows that repeat an id and a text have the same score and neighbouring ranks.
    Null and empty texts have no features and weight 0. No documents: no rows; an empty target: gains of the smoothing alone. ``target`` is a table of texts (column text); other columns of
    either are ignored.

    The corpus is read twice, to count its buckets and to weigh its documents, and neither texts nor features move; of what moves, the
    buckets' counts are as many as buckets and tasks, and the rest is a row for each document.
    """
    stage = Stage(spark, "resample")
    text = lambda df: df.select(F.col("text").alias("_text"))
    gain = stage.put(gains(stage, bucket_counts(text(docs), "s", buckets, longest), bucket_counts(text(target), "t", buckets, longest), buckets), "gains")
    scored = stage.put(weights(docs, gain, buckets, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    n = scored.where(F.col("n_words") >= least_words).agg(F.coalesce(F.floor(F.sum("rows") * percent / 100), F.lit(0)).alias("_draw"))
    order = [F.desc("score"), F.asc("doc_id"), F.asc("h1"), F.asc("h2")]
    able = ranked(stage, scored.where(F.col("n_words") >= least_words), order, "rows")
    names = ["doc_id", "n_features", "weight", "score"]
    out = able.join(F.broadcast(n)).select(*names, "rows", "_before", "_draw")
    out = out.unionByName(scored.where(F.col("n_words") < least_words).select(*names, "rows"), allowMissingColumns=True)
    rank = F.col("_before") + F.col("_copy") + 1
    return each(out, "rows", "_copy").select(*names, F.when(rank <= F.col("_draw"), rank).alias("rank"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark texts: doc_id, n_features, weight, score, rank. Nulls, ties and repeated rows: see resample."""
    return resample(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Without a built-in crc32, each distinct feature's is folded from its hex digits, low half of a byte first. The table of crc32 by half bytes.
SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (
  SELECT r, f, count(*) AS n FROM (
    SELECT r, unnest(w) AS f FROM w UNION ALL SELECT r, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) FROM w WHERE len(w) > 1) GROUP BY r, f),
bf AS (
  SELECT f, count(*) AS n FROM (
    SELECT unnest(w) AS f FROM b UNION ALL SELECT unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) FROM b WHERE len(w) > 1) GROUP BY f),
v AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
k AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 2 * octet_length(encode(f))), lambda i: CAST(strpos('0123456789ABCDEF', substr(hex(encode(f)), CAST(i + 2 - 2 * (i % 2) AS INTEGER), 1)) - 1 AS BIGINT))),
      lambda c, x: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][CAST(xor(c, x) & 15 AS INTEGER) + 1]::BIGINT)), 4294967295::BIGINT) % 10000 AS bucket
  FROM v),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bf JOIN k USING (f) GROUP BY bucket),
g AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t ON s.bucket = t.bucket),
x AS (SELECT r, CAST(sum(gain * n) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS n_features FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY r),
y AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
         coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
         CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
  FROM w LEFT JOIN x USING (r)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM y),
q AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS nth, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM z)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_words >= 20 AND nth <= 25 * n // 100 THEN nth END AS rank FROM q
"""
