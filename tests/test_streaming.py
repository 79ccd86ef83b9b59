import pytest
from pyspark.sql import functions as F

from fieldloom.streaming import Checkpoint, pending, stream_means


def test_pending(spark):
    a, b = spark.range(5).withColumnRenamed("id", "it"), spark.range(3).withColumnRenamed("id", "it")
    assert sorted(r.it for r in pending(a, b, "it").collect()) == [3, 4]


def test_checkpoint_resumes(spark, tmp_path):
    path, made = f"file://{tmp_path}/c", []

    def work(it):
        made.append(it)
        if it == 3:
            raise ValueError("no such iteration")
        return spark.range(4).withColumn("v", F.col("id") * it)

    c = Checkpoint(spark, path, {"var": "T", "coord_tol": 1e-6})
    c.run([1, 2], work)
    again = Checkpoint(spark, path, {"var": "T", "coord_tol": 1e-6})
    assert again.done() == [1, 2]
    assert again.run([1, 2, 3, 4], work, on_error="collect").keys() == {3} and made == [1, 2, 3, 4]
    assert again.read([1, 4], rows=4).groupBy("id").agg(F.avg("v").alias("v")).where("id = 2").first()["v"] == 5.0
    with pytest.raises(ValueError, match="another size"):
        again.read([1], rows=5)
    with pytest.raises(ValueError, match="no such"):
        again.run([3], work)
    with pytest.raises(ValueError, match="other settings"):
        Checkpoint(spark, path, {"var": "U", "coord_tol": 1e-6})
    with pytest.warns(UserWarning):
        Checkpoint(spark, path, {"var": "T", "coord_tol": 1e-5})
    assert Checkpoint(spark, path, {"var": "U"}, wipe=True).done() == []


def test_small_iterations_are_made_in_one_job(spark, tmp_path):
    """Neither jobs nor folders grow with the number of iterations, but with their inputs' bytes."""
    path, made, by = f"file://{tmp_path}/c", [], [1.0]

    def work(its):
        made.append(list(its))
        return spark.createDataFrame([(it,) for it in its if it != 99], "iter long").withColumn("v", F.col("iter") * by[0])

    prints = lambda new, size: spark.createDataFrame([(it, f"{it}{'x' if it in new else ''}", size) for it in range(60)], "iter long, fingerprint string, bytes long")
    c = Checkpoint(spark, path, {})
    c.run_together(range(50), work, prints=prints([], 1000))
    assert made == [list(range(50))] and c.done() == list(range(50)) and len(list((tmp_path / "c").glob("*=*"))) == 1
    assert {(r.iter, r.v) for r in c.read([3, 7]).collect()} == {(3, 3.0), (7, 7.0)} and c.read(range(50), rows=1).count() == 50
    by[0] = 10.0
    Checkpoint(spark, path, {}).run_together(range(55), work, prints=prints([4], 1000))
    assert made[1:] == [[4, 50, 51, 52, 53, 54]]
    assert {(r.iter, r.v) for r in c.read([3, 4, 54]).collect()} == {(3, 3.0), (4, 40.0), (54, 540.0)}
    c.run([4, 55], lambda it: spark.range(1).select((F.col("id") + it - 0.5).alias("v")), prints=prints([], 1000))  # one by one, in the same folder
    assert {(r.iter, r.v) for r in c.read([3, 4, 55]).collect()} == {(3, 3.0), (4, 3.5), (55, 54.5)} and c.done() == list(range(56))
    c.run_together(range(60), work, together=2, prints=prints([], 3 << 30))  # large ones
    assert made[2:] == [[56, 57], [58, 59]]
    with pytest.raises(ValueError, match="iteration 99 has no rows"):
        c.run_together([98, 99], work)
    assert 98 not in c.done()
    with pytest.raises(Exception, match="iter=98"):
        c.read([3, 98])
    assert Checkpoint(spark, path, {"v": 1}, wipe=True).done() == [] and sorted(p.name for p in (tmp_path / "c").iterdir() if p.name[0] != ".") == ["meta.json"]


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(100).withColumn("v", F.col("id") * 1.5).repartition(3).write.parquet(src)
    adapt = lambda df: df.select((F.col("id") % 7).alias("cell"), "v")
    ck = f"file://{tmp_path}/ck"
    got = stream_means(spark, src, adapt, ["cell"], ["v"], ck).collect()
    want = adapt(spark.read.parquet(src)).groupBy("cell").agg(F.avg("v").alias("v"), F.count("*").alias("n")).collect()
    assert sorted(got) == sorted(want)
    spark.range(100, 120).withColumn("v", F.col("id") * 1.5).write.mode("append").parquet(src)
    later = stream_means(spark, src, adapt, ["cell"], ["v"], ck).collect()
    assert sum(r.n for r in later) == 120
