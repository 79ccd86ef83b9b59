import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom import sinks, sources
from fieldloom.session import NODE_COLUMNS
from fieldloom.sources import plot3d


def partition(folder, blk, it, nodes, elems, kind="FETETRAHEDRON", sizes=None):
    n, e = sizes or (len(nodes), len(elems))
    lines = ["VARIABLES = " + ",".join(f'"{c}"' for c in NODE_COLUMNS), f"ZONE N={n}, E={e}", f"DATAPACKING=POINT, ZONETYPE={kind}"]
    lines += [" ".join(map(str, r)) for r in nodes] + [" ".join(map(str, r)) for r in elems]
    (folder / f"tecplot_blk{blk}_iter{it}.dat").write_text("\n".join(lines) + "\n")


def rows(n, start=0.0):
    return [[start + r + c / 16 for c in range(13)] for r in range(n)]


def test_partitions_read(spark, tmp_path):
    for it in (9, 10):
        partition(tmp_path, 2, it, rows(3), [])
        partition(tmp_path, 1, it, rows(5, 10.0), [[1, 2, 3, 4], [2, 3, 4, 5]])
    (tmp_path / "tecplot_blkX_iter1.dat").write_text("other")
    nodes = sources.read_nodes(spark, str(tmp_path), ["T", "X"], iters=[10])
    assert nodes.columns == ["iter", "blk", "node_idx", "X", "Y", "Z", "T"]
    got = nodes.orderBy("blk", "node_idx").collect()
    assert [(r.iter, r.blk, r.node_idx) for r in got] == [(10, 1, n) for n in range(5)] + [(10, 2, n) for n in range(3)]
    assert got[0]["T"] == 10 + 7 / 16
    elems = sources.read_elements(spark, str(tmp_path)).where("iter = 9").collect()
    assert sorted(tuple(r)[2:] for r in elems) == [(0, 1, 2, 3, 4), (1, 2, 3, 4, 5)]
    listed = sources.list_partitions(spark, str(tmp_path)).orderBy("iter").collect()
    assert [(r.iter, [b.blk for b in r.blocks]) for r in listed] == [(9, [1, 2]), (10, [1, 2])]


@pytest.mark.parametrize("sizes", [(6, 1), (4, 3)])
def test_wrong_sizes_raise(spark, tmp_path, sizes):
    partition(tmp_path, 1, 1, rows(5), [[1, 2, 3, 4]], sizes=sizes)
    with pytest.raises(Exception, match="rows where|ends before|invalid|Integer|convert|parse"):
        sources.read_nodes(spark, str(tmp_path)).collect()
        sources.read_elements(spark, str(tmp_path)).collect()


def test_header(tmp_path):
    from fieldloom.sources.tecplot import parse_header

    with pytest.raises(ValueError, match="no N="):
        parse_header(["VARIABLES", "ZONE", "x"])
    with pytest.warns(UserWarning):
        assert parse_header(['"X","Y"', "N = 3 , E=0", "ZONETYPE=FEBRICK"]).n_columns == 2


def test_mesh_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(n, n * 0.1, n * 1.0, -n / 3, *[float(n + c) for c in range(10)]) for n in range(7)], "node_id long, " + ", ".join(f"{c} double" for c in NODE_COLUMNS))
    elems = spark.createDataFrame([(0, 0, 1, 2, 3), (1, 3, 4, 5, 6)], "elem_idx long, n0 long, n1 long, n2 long, n3 long")
    sinks.write_mesh(spark, str(tmp_path / "tecplot_blk1_iter5.dat"), nodes, NODE_COLUMNS, elems)
    back = sources.read_nodes(spark, str(tmp_path), dtype="float64").orderBy("node_idx").collect()
    assert [r["Z"] for r in back] == pytest.approx([-n / 3 for n in range(7)], rel=1e-11)
    assert [tuple(r)[3:] for r in sources.read_elements(spark, str(tmp_path)).orderBy("elem_idx").collect()] == [(1, 2, 3, 4), (4, 5, 6, 7)]
    sinks.write_mesh(spark, str(tmp_path / "points.dat"), nodes, ["X", "T"])
    assert (tmp_path / "points.dat").read_text().splitlines()[1:3] == [' ZONE T="points", I=7, F=POINT', "0 4"]
    assert sinks.exists(spark, str(tmp_path / "points.dat"))


@pytest.mark.parametrize("nz,nvar", [(4, 5), (5, 9)])
def test_plot3d(spark, tmp_path, nz, nvar):
    rng = np.random.default_rng(0)
    shape = (3, 2, nz)
    x, y, z = rng.random((3, *shape)).astype("f4")
    plot3d.write_grid(str(tmp_path / "grid.xyz"), x, y, z)
    snaps = {(1, t): rng.random((*shape, nvar)).astype("f4") for t in (9, 10, 2)}
    for (g, t), v in snaps.items():
        plot3d.write_snapshot(str(tmp_path / f"grid{g}.{t}.f"), v)
    grid = sources.read_grid(spark, str(tmp_path / "grid.xyz")).collect()
    assert all(r.x == x[r.i, r.j, r.k] and r.z == z[r.i, r.j, r.k] for r in grid) and len(grid) == x.size
    df = sources.read_snapshots(spark, str(tmp_path))
    assert df.columns[5:] == ["u", "v", "w", "p", "e", "u_mean", "v_mean", "w_mean", "e_mean"][:nvar]
    assert all(r.e == snaps[1, r.time_num][r.i, r.j, r.k, 4] for r in df.collect())
    assert {r.time_num for r in sources.read_snapshots(spark, str(tmp_path), ordinals=[2]).select("time_num").distinct().collect()} == {10}
    means = df.groupBy("i", "j", "k").agg(F.avg("u").alias("u")).withColumns({c: F.col(d).cast("double") for c, d in zip("xyz", "ijk", strict=True)})
    sinks.write_structured(spark, str(tmp_path / "mean.dat"), means, ["u"])
    lines = (tmp_path / "mean.dat").read_text().splitlines()
    assert lines[2] == f"ZONE I=3, J=2, K={nz}, F=POINT" and len(lines) == 3 + 6 * nz
    assert [float(v) for v in lines[4].split()[:3]] == [1.0, 0.0, 0.0]


def test_broken_records(spark, tmp_path):
    v = np.zeros((2, 2, 2, 5), "f4")
    path = tmp_path / "grid1.1.f"
    plot3d.write_snapshot(str(path), v)
    raw = bytearray(path.read_bytes())
    for bad in (raw[:-9], raw[:20] + b"\x01" + raw[21:]):
        path.write_bytes(bytes(bad))
        with pytest.raises(Exception, match="record"):
            sources.read_snapshots(spark, str(tmp_path)).collect()


def test_profile_and_summary(spark, tmp_path):
    sinks.write_profile(spark, str(tmp_path / "p.dat"), spark.createDataFrame([(2.0, 0.5), (1.0, 1 / 3)], "z double, value double"))
    assert (tmp_path / "p.dat").read_text() == "1 0.333333333333\n2 0.5\n"
    sinks.write_summary(spark, str(tmp_path / "s.txt"), spark.createDataFrame([(1.5, None)], "nu double, x double"))
    assert (tmp_path / "s.txt").read_text() == "nu = 1.5\nx = none\n"


def test_accumulate_over_files(spark, tmp_path):
    for n in range(7):
        plot3d.write_snapshot(str(tmp_path / f"grid1.{n}.f"), np.full((2, 3, 4, 5), float(n)))
    paths = sources.files.find(str(tmp_path), "grid*.f")

    def add(sums, path, scale):
        with sources.files.open_(path) as f:
            plot3d.record(f)
            sums["all"] += scale * np.frombuffer(plot3d.record(f), "<f4").reshape(5, 24)[0].reshape(2, 3, 4)
        sums["files"] += 1

    sums = sources.accumulate(spark, paths, lambda scale: {"all": np.zeros((2, 3, 4)), "files": np.zeros(1)}, add, 2.0, tasks=3)
    assert (sources.array_of(sums, "all") == 42).all() and sources.array_of(sums, "all").shape == (2, 3, 4) and sources.array_of(sums, "files").tolist() == [7.0]
    assert sources.accumulate(spark, [], lambda _: {"x": np.zeros(1)}, add).count() == 0


def test_text_replaces_an_older_one(spark, tmp_path):
    for n in (1, 2):
        sinks.write_profile(spark, str(tmp_path / "p.dat"), spark.createDataFrame([(0.0, float(n))], "z double, value double"))
        assert (tmp_path / "p.dat").read_text() == f"0 {n}\n"
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["p.dat"]


def test_numbers_from_0_written_as_they_are(spark, tmp_path):
    nodes = spark.createDataFrame([(n, float(n)) for n in range(4)], "node_id long, X double")
    elems = spark.createDataFrame([(0, 0, 1, 2, 3)], "elem_idx long, n0 long, n1 long, n2 long, n3 long")
    sinks.write_mesh(spark, str(tmp_path / "m.dat"), nodes, ["X"], elems, one_based=False)
    assert (tmp_path / "m.dat").read_text().splitlines()[-1] == "0 1 2 3"


def test_arrays_for_numpy(spark, tmp_path):
    nodes = spark.createDataFrame([(2, 0.5, 7), (0, 1.5, 8), (1, 2.5, 9)], "node_id long, X double, c int")
    sinks.write_npy(str(tmp_path / "a.npy"), nodes, ["X", "c"], ["node_id"])
    a = np.load(tmp_path / "a.npy")
    assert a.dtype.names == ("X", "c") and a["X"].tolist() == [1.5, 2.5, 0.5] and a["c"].dtype == np.int32
    sinks.write_npz(str(tmp_path / "b.npz"), nodes, ["X", "c"], spark.createDataFrame([(1, 0, 1, 2, 0), (0, 2, 1, 0, 1)], "elem_idx long, n0 long, n1 long, n2 long, n3 long"))
    b = np.load(tmp_path / "b.npz")
    assert b["data"].tolist() == [[1.5, 8], [2.5, 9], [0.5, 7]] and b["var_names"].tolist() == ["X", "c"] and b["conn"].tolist() == [[2, 1, 0, 1], [0, 1, 2, 0]]
    with pytest.raises(ValueError, match="more than 2 rows"):
        sinks.write_npy(str(tmp_path / "c.npy"), nodes, ["X"], ["node_id"], most_rows=2)


def test_arrays_are_written_by_tasks(spark, tmp_path):
    n = 5000
    df = spark.range(n).repartition(7).select((n - F.col("id")).alias("node_id"), (F.col("id") * 0.5).alias("a"), F.col("id").cast("int").alias("b"), F.when(F.col("id") % 2 == 0, F.col("id").cast("float")).alias("c"))
    sinks.write_npy(f"file://{tmp_path}/x.npy", df, ["a", "b", "c"], ["node_id"])
    x = np.load(tmp_path / "x.npy")
    ids = np.arange(n)[::-1]
    assert x.dtype == np.dtype([("a", "<f8"), ("b", "<i4"), ("c", "<f4")]) and (x["a"] == ids * 0.5).all() and (x["b"] == ids).all()
    assert (np.isnan(x["c"]) == (ids % 2 == 1)).all()
    back = sinks.read_npy(spark, str(tmp_path / "x.npy"), rows=999)
    assert back.rdd.getNumPartitions() == 6 and back.where("b = 4999 - row AND a = b * 0.5").count() == n
    elems = spark.range(30).repartition(3).select(F.col("id").alias("elem_idx"), *[(F.col("id") + k).alias(f"n{k}") for k in range(4)])
    sinks.write_npz(str(tmp_path / "y.npz"), df, ["a", "b"], elems)
    y = np.load(tmp_path / "y.npz")
    assert (y["data"] == np.stack([ids * 0.5, ids], 1)).all() and (y["conn"] == np.arange(30)[:, None] + np.arange(4)).all() and y["var_names"].tolist() == ["a", "b"]
    sinks.write_npy(str(tmp_path / "z.npy"), df.limit(0), ["a"], ["node_id"])
    assert np.load(tmp_path / "z.npy").shape == (0,) and sinks.read_npy(spark, str(tmp_path / "z.npy")).count() == 0
    with pytest.raises(Exception, match="a null in"):
        sinks.write_npy(str(tmp_path / "w.npy"), df.withColumn("b", F.when(F.col("b") > 3, F.col("b"))), ["b"], ["node_id"])
    with pytest.raises(ValueError, match="no fixed size"):
        sinks.write_npy(str(tmp_path / "w.npy"), df.withColumn("s", F.lit("x")), ["s"], ["node_id"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.npy", "y.npz", "z.npy"]


def test_indexed_files_are_read_in_parts(spark, tmp_path):
    rng = np.random.default_rng(5)
    for blk in (1, 2):  # lines of odd lengths
        nodes = [[f"{x:.{rng.integers(1, 12)}g}" for x in rng.standard_normal(13) * 10.0 ** rng.integers(-3, 6)] for _ in range(60 + blk)]
        partition(tmp_path, blk, 7, nodes, rng.integers(1, 60, (30 * blk, 4)).tolist())
    partition(tmp_path, 3, 7, rows(1), [])
    folder, whole = str(tmp_path), {}
    for name, read in (("nodes", lambda **k: sources.read_nodes(spark, folder, ["T"], dtype="float64", **k)), ("elems", lambda **k: sources.read_elements(spark, folder, **k))):
        whole[name] = sorted(map(tuple, read().collect()))
    for part in (61, 700, 1 << 20):
        index = sources.index_partitions(spark, folder, str(tmp_path / f"lines{part}"), part=part)
        assert sorted(map(tuple, sources.read_nodes(spark, folder, ["T"], dtype="float64", index=index).collect())) == whole["nodes"]
        assert sorted(map(tuple, sources.read_elements(spark, folder, index=index).collect())) == whole["elems"]
    index = sources.index_partitions(spark, folder, part=500)
    assert sources.index_partitions(spark, folder) == index == f"{folder}/lines"
    nodes, elems = sources.read_nodes(spark, folder, ["T"], index=index), sources.read_elements(spark, folder, index=index)
    assert nodes.rdd.getNumPartitions() > 20 and 2 <= elems.rdd.getNumPartitions() < 12  # parts of nodes alone aren't opened for elements
    assert nodes.where("iter = 8").count() == 0 and nodes.count() == len(whole["nodes"]) and sources.read_nodes(spark, folder, ["T"], [8], index=index).count() == 0
    with open(tmp_path / "tecplot_blk3_iter7.dat", "a") as f:
        f.write("\n")
    with pytest.raises(Exception, match="has changed"):
        sources.read_nodes(spark, folder, ["T"], index=index).collect()
    partition(tmp_path, 4, 7, rows(2), [], sizes=(5, 0))
    with pytest.raises(Exception, match="lines where its header"):
        sources.index_partitions(spark, folder)


def test_places_become_byte_ranges(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    shape = (5, 4, 12)
    snaps = {t: rng.random((*shape, 5)).astype("f4") for t in range(3)}
    for t, v in snaps.items():
        plot3d.write_snapshot(str(tmp_path / f"grid1.{t}.f"), v)
    cases = [({"k": (5, 5)}, None), ({"k": (3, 5), "i": (2, None)}, None), ({"i": (1, 1), "j": (2, 2)}, None), ({"j": (None, 1)}, [2]), ({"k": (99, 99)}, None), ({"i": (-3, -1)}, [0]), ({"j": (1, 1), "k": (10, 40)}, [0, 1]), (None, [1])]
    for places, times in cases:
        inside = lambda **at: all((lo is None or lo <= at[a]) and (hi is None or at[a] <= hi) for a, (lo, hi) in (places or {}).items())  # noqa: E731, B023
        want = sorted((t, i, j, k, *map(float, v[i, j, k])) for t, v in snaps.items() if times is None or t in times for i, j, k in np.ndindex(*shape) if inside(i=i, j=j, k=k))
        got = sources.read_snapshots(spark, str(tmp_path), times=times, places=places).select("time_num", "i", "j", "k", "u", "v", "w", "p", "e").collect()
        assert sorted(map(tuple, got)) == want, (places, times)
    df = sources.read_snapshots(spark, str(tmp_path))  # a filter of one use says nothing to another
    assert df.where("k = 5").count() == 60 and df.count() == 720 and df.where("i = 1").union(df.where("i > 1")).count() == 576
    # the bytes that a slice reads
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.f.close()

        def read(self, n):
            read.append(n)
            return self.f.read(n)

        def __getattr__(self, name):
            return getattr(self.f, name)

    opened = plot3d.open_
    monkeypatch.setattr(plot3d, "open_", lambda path: Counted(opened(path)))
    names = ["grid_num", "time_num", "i", "j", "k", "u", "v", "w", "p", "e"]
    reader = plot3d.Plot3DReader([str(tmp_path / "grid1.0.f")], False, names, {"k": [5, 5]})
    read.clear()
    assert sum(b.num_rows for p in [plot3d.Part(str(tmp_path / "grid1.0.f"))] for b in reader.read(p)) == 20
    assert sum(read) < 4 * 5 * 5 * 4 + 64  # one plane of five variables, and a header
    monkeypatch.setattr(plot3d, "PART", 60)  # files in parts
    reader = plot3d.Plot3DReader([str(tmp_path / "grid1.0.f")], False, names)
    parts = reader.partitions()
    assert len(parts) == 4 and sum(b.num_rows for p in parts for b in reader.read(p)) == 240
    assert sorted(k for p in parts for b in reader.read(p) for k in b.column("k").to_pylist()) == sorted(k for _, _, k in np.ndindex(*shape))


def test_many_small_files_share_tasks(spark, tmp_path, monkeypatch):
    """Neither tasks nor looks at folders grow with the number of files, and a task isn't sent their list."""
    import pickle

    from fieldloom.sources import files, tecplot

    n = 150
    for t in range(n):
        plot3d.write_snapshot(str(tmp_path / f"grid1.{t}.f"), np.full((2, 3, 4, 5), float(t)))
        partition(tmp_path, 1, t, rows(4, float(t)), [[1, 2, 3, 4]])
    folder = str(tmp_path)
    index = sources.index_partitions(spark, folder, str(tmp_path / "lines"), part=200)
    assert len(list((tmp_path / "lines").iterdir())) <= 4 * spark.sparkContext.defaultParallelism  # not one for each file
    snaps, nodes, elems = sources.read_snapshots(spark, folder), sources.read_nodes(spark, folder, ["T"]), sources.read_elements(spark, folder)
    indexed = [read(spark, folder, index=index, **how) for read, how in ((sources.read_nodes, {"variables": ["T"]}), (sources.read_elements, {}))]
    assert all(df.rdd.getNumPartitions() <= files.TASKS + 1 for df in (snaps, nodes, elems, *indexed))
    assert snaps.groupBy("time_num").agg(F.count("*").alias("n"), F.avg("u").alias("u")).where("n = 24 AND u = time_num").count() == n
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, indexed[0].collect())) and nodes.count() == 4 * n
    assert sorted(map(tuple, elems.collect())) == sorted(map(tuple, indexed[1].collect())) == [(t, 1, 0, 1, 2, 3, 4) for t in range(n)]
    looks, listed = [], files.listed
    for module in (files, tecplot):
        monkeypatch.setattr(module, "listed", lambda *a: looks.append(a) or listed(*a))
    reader = tecplot.TecplotReader({"path": folder, "index": index}, ["X", "Y", "Z"])
    assert len(reader.partitions()) <= files.TASKS + 1 and len(looks) == 2
    source = plot3d.Plot3DSource({"path": folder})
    assert len(pickle.dumps(source.reader(source.schema()))) < 2000


def test_parts_are_packed_by_size():
    from fieldloom.sources.files import packed

    assert packed(list("abc"), [1, 2, 3], 3, 1) == [["a"], ["b"], ["c"]]
    sizes = [10**6 * (n % 7) for n in range(1000)]
    for tasks, most in ((32, 1 << 40), (32, 10**7)):
        groups = packed(list(range(1000)), sizes, tasks, most)
        assert [p for g in groups for p in g] == list(range(1000))
        assert max(sum(sizes[p] for p in g) for g in groups) <= min(most, sum(sizes) / tasks) + 14 * 10**6 and len(groups) <= max(tasks, sum(sizes) // most + 2) + 1


def test_groups_that_span_batches_are_written_whole(spark, tmp_path):
    from fieldloom.plans import adapters

    df = spark.range(1000).selectExpr("id % 7 AS t", "id div 7 AS k")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("9", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            adapters._files(df, ["t"], ["k"], lambda rows, size=size: (tmp_path / f"{size}-{rows['t'][0]}").write_text(" ".join(map(str, rows["k"]))))
            assert [(tmp_path / f"{size}-{t}").read_text() for t in range(7)] == [" ".join(str(k) for k in range(143) if k * 7 + t < 1000) for t in range(7)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
