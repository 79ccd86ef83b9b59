"""Kept operators, sums and tables: what is stored once, added to, and opened again."""

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import blocks, correlation, mesh, moments, sparse, spectral, stencil
from fieldloom.streaming import Checkpoint, stream_means, stream_moments, stream_tke
from fieldloom.streaming.spans import Spans
from fieldloom.streaming.spectra import SpectralSums
from fieldloom.tables import Bucketed

from .test_operators import FLOW, field


def files(folder):
    return sorted(p.name for p in folder.iterdir() if p.is_dir() and p.name.startswith("span="))


def test_bucketed_table_opens_again(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    t = Bucketed(spark, path, "k", "k long, v string", 3)
    for n in range(5):
        t.append(spark.range(10 * n, 10 * n + 10).selectExpr("id AS k", "cast(id AS string) AS v"), most_files=3)
    assert t.files() <= 9 and t.table().count() == 50
    spark.sql(f"DROP TABLE {t.name}")  # as after a restart, when the catalog is empty
    again = Bucketed(spark, path)
    assert again.buckets == 3 and sorted(r.k for r in again.table().collect()) == list(range(50))
    again.append(spark.range(50, 52).selectExpr("id AS k", "'x' AS v"))
    again.compact()
    assert again.table().count() == 52 and again.files() <= 3
    with pytest.raises(ValueError, match="bucketed by k"):
        Bucketed(spark, path, "v")
    with pytest.raises(FileNotFoundError):
        Bucketed(spark, f"{path}-none")
    plan = again.table().hint("merge").join(spark.range(100).hint("merge"), F.col("k") == F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the other side alone moves
    again.drop()
    assert not (tmp_path / "table").exists()


def cube(spark, n=3):
    """Six tetrahedra in each cell of n x n x n points."""
    node = lambda i, j, k: i + n * (j + n * k)
    paths = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    elems = []
    for c in np.ndindex(n - 1, n - 1, n - 1):
        for path in paths:
            at, corners = list(c), [node(*c)]
            for a in path:
                at[a] += 1
                corners.append(node(*at))
            elems.append((len(elems), *corners))
    rng = np.random.default_rng(0)
    xyz = [(node(i, j, k), i + 0.2 * rng.random(), j + 0.2 * rng.random(), k * k + 0.2 * rng.random()) for i, j, k in np.ndindex(n, n, n)]
    return spark.createDataFrame(elems, "elem_idx long, n0 long, n1 long, n2 long, n3 long"), spark.createDataFrame(xyz, "node_id long, x double, y double, z double")


def test_stored_gradient_equals_elements(spark, tmp_path):
    elems, nodes = cube(spark)
    rng = np.random.default_rng(1)
    values = spark.createDataFrame([(it, n, *map(float, rng.random(2))) for it in (3, 8) for n in range(27)], "iter long, node_id long, f double, g double")
    sparse.store(sparse.gradient_weights(elems, nodes), f"file://{tmp_path}/w", 4)
    kept = sparse.load(spark, f"file://{tmp_path}/w")
    got = sparse.apply(kept, values, ["f", "g"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Bucketed: true" in plan  # the values and the sums, not the weights
    names = [f"{v}_d{a}" for v in "fg" for a in "xyz"]
    for it in (3, 8):
        own = nodes.join(values.where(F.col("iter") == it), "node_id")
        want = {r.node_id: [r[n] for n in names] for r in mesh.scatter(mesh.tet_gradient(elems, own, ["f", "g"]), names).collect()}
        have = {r.node_id: [r[n] for n in names] for r in got.where(F.col("iter") == it).collect()}
        assert have.keys() == want.keys() and all(have[n] == pytest.approx(want[n]) for n in want)


def test_fluctuations_need_no_mean_beforehand(spark):
    _, df = field(spark, (2, 3, 6), 4)
    df = df.withColumns({f: F.col(f) + 1000.0 * (n + 1) + F.col("i") for n, f in enumerate(FLOW)})
    mean = moments.time_mean(df)
    for center, fluct in (("line", moments.fluctuations(df, moments.z_mean(mean))), ("cell", moments.fluctuations(df, mean, keys=moments.CELL))):
        want = {tuple(r)[:5]: r.r for r in correlation.two_point(fluct, (1, 0)).collect()}
        raw = correlation.two_point(df, (1, 0), center=center)
        got = {tuple(r)[:5]: r.r for r in raw.collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-8
    # snapshots that lack some lines
    part = df.where("NOT (t = 2 AND i = 0 AND j = 1)")
    want = {tuple(r)[:5]: r.r for r in correlation.two_point(moments.fluctuations(part, moments.z_mean(moments.time_mean(part))), (1, 0)).collect()}
    got = {tuple(r)[:5]: r.r for r in correlation.two_point(part, (1, 0), center="line").collect()}
    assert max(abs(got[k] - want[k]) for k in want) < 1e-8
    assert correlation.two_point(df, (7, 7), center="line").count() == 0
    with pytest.raises(Exception, match="differ in length"):
        correlation.two_point(df.where("NOT (t = 2 AND i = 0 AND j = 1 AND k = 5)"), (1, 0)).collect()


def test_snapshots_are_dealt_once(spark):
    _, df = field(spark, (2, 2, 4), 3)
    plan = correlation.two_point(df.repartition(3), (1, 0), center="line")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(i#") == 1 and plan.count("hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_lines_stay_whole_behind_a_join_that_is_split(spark):
    """A join by (i, j) that Spark turns into a broadcast while it runs no longer keeps a line's rows together."""
    snap = spark.range(4 * 6 * 40, numPartitions=8).select((F.col("id") % 40).alias("t"), F.expr("id div 40 % 2").alias("i"), F.expr("id div 80 % 2").alias("j"), F.expr("id div 160").alias("k"), *[F.rand(n).alias(c) for n, c in enumerate(FLOW)])
    snap.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/split")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20KB"}
    snap = spark.read.parquet(path)
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        fluct = moments.fluctuations(snap, moments.z_mean(moments.time_mean(snap)))
        found = correlation.two_point(fluct, (1, 0))
        assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1  # the join's own exchange isn't taken for it
        one, rows = {tuple(r)[:5]: r.r for r in found.collect()}, found.count()
        want = {tuple(r)[:5]: r.r for r in correlation.two_point_join(fluct, (1, 0), 6).select("fi", "fj", "i", "j", "lag", "r").collect()}
    finally:
        for name in conf:
            spark.conf.unset(name)
    assert rows == len(one) == len(want) == 16 * 4 * 6 and all(one[p] == pytest.approx(want[p], abs=1e-9) for p in want)


def test_lines_longer_than_a_batch(spark):
    a, df = field(spark, (1, 2, 50), 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {tuple(r)[:5]: r.r for r in correlation.two_point(df, (0, 0)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(r)[:5]: r.r for r in correlation.two_point(df, (0, 0)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_spectral_sums_go_on(spark, tmp_path):
    _, df = field(spark, (2, 2, 6), 7)
    df = df.withColumn("u", F.col("u") + 500)
    path = f"file://{tmp_path}/sums"
    added = [SpectralSums(spark, path, (1, 0), most=2).add(df.where(F.col("t") < n)) for n in (2, 2, 3, 5, 7, 7)]
    assert added == [2, 0, 1, 2, 2, 0]
    kept = SpectralSums(spark, path, (1, 0), most=2)
    assert len(files(tmp_path / "sums" / "sums")) <= 2 and sorted(r.t for r in kept.snapshots().collect()) == list(range(7))
    want = {tuple(r)[:5]: r.r for r in correlation.two_point(df, (1, 0), center="line").collect()}
    got = {tuple(r)[:5]: r.r for r in kept.correlations().collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-8
    mean = moments.time_mean(df)
    for center, fluct in (("line", moments.fluctuations(df, moments.z_mean(mean))), ("cell", moments.fluctuations(df, mean, keys=moments.CELL))):
        want = {(r.field, r.k_idx): r.p for r in spectral.plane_spectrum(fluct).collect()}
        got = {(r.field, r.k_idx): r.p for r in kept.spectrum(center).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-8
    # a go that was cut off after its times: they don't count, and it is made again
    kept.times.put(spark.createDataFrame([(9, kept.sums.next())], "t long, go int"), kept.sums.next())
    assert 9 not in {r.t for r in kept.snapshots().collect()}
    with pytest.raises(ValueError, match="other settings"):
        SpectralSums(spark, path, (0, 0))
    with pytest.raises(ValueError, match="no reference"):
        SpectralSums(spark, f"{path}-none").correlations()
    assert SpectralSums(spark, f"{path}-none").spectrum().count() == 0


def test_spans_count_each_number_once(spark, tmp_path):
    spans = Spans(spark, f"file://{tmp_path}", most=2)
    assert spans.read() is None and spans.next() == 0
    number = lambda n: spark.createDataFrame([(n,)], "n int")
    for n in range(3):
        spans.put(number(n), n)
    spans.put(number(1), 1)  # again
    whole = spans.read()
    whole.coalesce(1).write.parquet(spans.folder(0, 2))  # as if stopped before the old folders went
    assert sorted(r.n for r in spans.read().collect()) == [0, 1, 2]
    spans.put(number(2), 2)  # a part that a folded folder holds
    spans.put(number(3), 3)
    (tmp_path / "span=4-4").mkdir()  # not whole
    assert sorted(r.n for r in spans.read().collect()) == [0, 1, 2, 3] and spans.next() == 4
    spans.fold(lambda df: df)
    assert files(tmp_path) == ["span=0-2", "span=3-3", "span=4-4"]


def test_streamed_moments_go_on_after_a_restart(spark, tmp_path):
    _, df = field(spark, (2, 2, 3), 12)
    df = df.withColumns({f: F.col(f) + 1e6 for f in "uvw"})
    src, how = f"file://{tmp_path}/in", {"checkpoint": f"file://{tmp_path}/ck", "table": f"file://{tmp_path}/m", "files": 1, "most": 3}
    for some in (df.where("t < 5"), df.where("t >= 5")):
        some.repartition(4).write.mode("append").parquet(src)
        got = stream_tke(spark, src, lambda d: d, **how)
    assert len(files(tmp_path / "m")) <= 3
    want = {(r.i, r.j, r.k): (r.tke_t, r.tke_tz) for r in moments.tke(df).collect()}
    have = {(r.i, r.j, r.k): (r.tke_t, r.tke_tz) for r in got.collect()}
    assert have.keys() == want.keys() and all(have[c] == pytest.approx(want[c], rel=1e-6) for c in want)


def test_streams_without_rows(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([], "i long, v double").write.parquet(src)
    assert stream_means(spark, src, lambda d: d, ["i"], ["v"]).columns == ["i", "v", "n"] and stream_means(spark, src, lambda d: d, ["i"], ["v"]).count() == 0
    spark.createDataFrame([(1, None), (1, 2.0), (1, 4.0), (2, None)], "i long, v double").write.mode("append").parquet(src)
    got = {r.i: r.v.asDict() for r in stream_moments(spark, src, lambda d: d, ["i"], ["v"]).collect()}
    assert got == {1: {"n": 2, "mean": 3.0, "m2": 2.0}, 2: {"n": 0, "mean": 0.0, "m2": 0.0}}


def test_a_foreign_folder_is_no_checkpoint(spark, tmp_path):
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "notes.txt").write_text("keep")
    with pytest.raises(ValueError, match="isn't a checkpoint"):
        Checkpoint(spark, f"file://{tmp_path}/mine", {"a": 1})
    done = Checkpoint(spark, f"file://{tmp_path}/mine", {"a": 1}, wipe=True)
    done.run([1], lambda it: spark.range(3))
    assert Checkpoint(spark, f"file://{tmp_path}/mine", {"a": 2}, wipe=True).done() == []
    assert (tmp_path / "mine" / "notes.txt").read_text() == "keep"


@pytest.mark.parametrize("size", [3, 4, 5, 100])
def test_blocks_give_what_windows_give(spark, size):
    rng = np.random.default_rng(2)
    n = (7, 9, 11)
    axes = [np.cumsum(rng.uniform(0.1, 2, m)) for m in n]
    rows = [(i, j, k, *(float(axes[a][c]) for a, c in enumerate((i, j, k))), *map(float, rng.random(2)), f"p{i}") for i, j, k in np.ndindex(*n)]
    df = spark.createDataFrame(rows, "i long, j long, k int, x double, y double, z double, f double, g double, name string").repartition(3)
    got = {(r.i, r.j, r.k): r for r in blocks.block_gradient(df, {"x": ["f"], "y": ["f", "g"], "z": ["g"]}, size=size).collect()}
    assert len(got) == len(rows) and all(r.name == f"p{r.i}" for r in got.values())
    for axis, name, value in (("x", "i", "f"), ("y", "j", "f"), ("y", "j", "g"), ("z", "k", "g")):
        others = [c for c in "ijk" if c != name]
        for r in stencil.derivatives(df, {"d": value}, axis, others, name).collect():
            assert got[r.i, r.j, r.k][f"{value}_d{axis}"] == pytest.approx(r.d, rel=1e-9, abs=1e-9)


def test_blocks_move_once_and_tell_short_lines(spark):
    df = spark.createDataFrame([(i, j, 0, float(i), float(j), 0.0, 1.0) for i in range(5) for j in range(2)], "i int, j int, k int, x double, y double, z double, f double")
    assert blocks.block_gradient(df, {"x": ["f"]}).count() == 10
    for bad in (blocks.block_gradient(df, {"y": ["f"]}), stencil.gradient(df, ["f"])):
        with pytest.raises(Exception, match="three points"):
            bad.collect()
    with pytest.raises(Exception, match="occurs twice"):
        blocks.block_gradient(df.union(df), {"x": ["f"]}).collect()
    plan = stencil.radial_gradient(df, {"a": "f", "b": F.col("f") * 2}, (0.0, 0.0, 0.0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
