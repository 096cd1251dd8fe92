"""Closed forms, invariants and formats of the mesh engine."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions import curves, scalars
from meshloom.operators import analysis, blocks, growth, iterate, labelling, linalg, metrics, multilevel, ordering, skew, tiles, topology
from meshloom.plans import catalogue, runs
from meshloom.sources import files, generators, msh, octree
from meshloom.sources.lines import numbered_lines, write_document
from meshloom.streaming import run_log

N = 5


@pytest.fixture(scope="module")
def grid(spark):
    cells = generators.hex_grid(spark, N).persist()
    edges = topology.face_edges(topology.incidence(cells, "faces", "face")).persist()
    return cells, edges


def spread(v, stride, bits):
    return sum(((v >> b) & 1) << (stride * b) for b in range(bits))


def test_curve_keys(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(map(int, r)) for r in rng.integers(0, 1 << 21, (300, 3))]
    df = spark.createDataFrame(rows, "x long, y long, z long")
    got = df.select("x", "y", "z", curves.morton3(F.col("x"), F.col("y"), F.col("z")).alias("m"), curves.morton2(F.col("x"), F.col("y")).alias("p")).collect()
    for r in got:
        assert r.m == spread(r.x, 3, 21) + (spread(r.y, 3, 21) << 1) + (spread(r.z, 3, 21) << 2)
        assert r.p == spread(r.x, 2, 31) + (spread(r.y, 2, 31) << 1)


def test_hilbert_visits_neighbours(spark):
    k = 3
    df = spark.range(1 << (2 * k)).select((F.col("id") % (1 << k)).alias("x"), F.expr(f"id div {1 << k}").alias("y"))
    order = [(r.x, r.y) for r in df.withColumn("d", curves.hilbert2(F.col("x"), F.col("y"), k)).orderBy("d").collect()]
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(order, order[1:], strict=False))


def test_grid_topology(grid):
    cells, edges = grid
    incident = topology.incidence(cells, "faces", "face")
    assert edges.count() == 3 * N * N * (N - 1)
    assert topology.boundary_faces(incident).count() == 6 * N * N
    three = incident.union(incident.limit(1)).union(incident.limit(1))
    with pytest.raises(Exception, match="more than two"):
        topology.faces(three).collect()


def test_lattice_edges_equal_face_edges(spark, grid):
    ids = spark.range(N**3 - 7).select(F.col("id").alias("e"))
    faces = topology.face_edges(topology.incidence(generators.cells_of(ids, N), "faces", "face"))
    assert {tuple(r) for r in generators.lattice_edges(ids, N).collect()} == {tuple(r) for r in faces.collect()}


def test_global_index_is_dense(spark):
    rows = spark.range(5000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(40)).alias("k"))
    got = ordering.global_index(rows, ["k", "id"], partitions=7).collect()
    want = sorted((r.k, r.id) for r in got)
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.global_idx)] == want
    assert sorted(r.global_idx for r in got) == list(range(5000))


@pytest.mark.parametrize(("n", "p"), [(10, 3), (7, 7), (100, 9), (5, 8)])
def test_block_labels(spark, n, p):
    got = [r.label for r in ordering.block_labels(spark.range(n), ["id"], p).orderBy("id").collect()]
    assert got == [k for k in range(p) for _ in range(n // p + (k < n % p))]


def test_bfs_is_manhattan_distance_and_lexicographic(spark, grid):
    cells, edges = grid
    place = {r.e: (r.i, r.j, r.k) for r in cells.collect()}
    seeds = {0: 0, N**3 - 1: 1, N * N: 2}
    state = labelling.bfs_partition(edges, spark.createDataFrame(list(seeds.items()), "v long, label long")).collect()
    assert len(state) == N**3
    for r in state:
        best = min((sum(abs(a - b) for a, b in zip(place[r.v], place[s], strict=True)), label) for s, label in seeds.items())
        assert (r.dist, r.label) == best


def test_relaxation_and_refinement(spark, grid):
    cells, edges = grid
    v = cells.select(F.col("e").alias("v"))
    seeds = labelling.seeds_along(v, ["v"], 4)
    grown = labelling.bfs_partition(edges, seeds)
    again = iterate.relax(edges, grown)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in grown.collect()}
    fine = labelling.refined(edges, grown, 4)
    assert fine.count() == N**3 and {r.label for r in fine.select("label").distinct().collect()} <= set(range(4))


def test_unreached_vertices_stay_out(spark):
    e = spark.createDataFrame([(0, 1), (5, 6)], "u long, v long")
    s = spark.createDataFrame([(0, 0)], "v long, label long")
    assert {r.v for r in labelling.bfs_partition(e, s).collect()} == {0, 1}
    assert not iterate.is_connected(spark.createDataFrame([(0,), (1,), (5,), (6,)], "v long"), e)


@pytest.mark.parametrize("name", sorted(labelling.REGISTRY))
def test_partitioners_cover_everything(grid, name):
    cells, edges = grid
    v = cells.select(F.col("e").alias("v"))
    labels = labelling.REGISTRY[name](v, edges, ["v"], 3).persist()
    assert labels.count() == N**3 and labels.where("label is null").isEmpty()
    assert {r.label for r in labels.select("label").distinct().collect()} <= {0, 1, 2}
    q = metrics.quality(edges, labels, 3).first()
    sizes = metrics.sizes(labels, 3).collect()
    bounds = {r.label: r.boundary for r in metrics.boundaries(edges, labels, 3).collect()}
    assert q.n == N**3 == sum(r["size"] for r in sizes) and 0 < q["lambda"] <= 1
    assert all(bounds[r.label] <= r["size"] for r in sizes)


def test_pagerank_keeps_weight(grid):
    cells, edges = grid
    v = cells.select(F.col("e").alias("v"))
    total = labelling.pagerank(v, edges, rounds=4).agg(F.sum("rank")).first()[0]
    assert total == pytest.approx(1000 * N**3)


def test_seed_choices(grid):
    cells, edges = grid
    v = cells.select(F.col("e").alias("v"))
    assert labelling.downsample_seeds(v, edges, ["v"], 3).count() == 3
    assert [r.position for r in ordering.stride_samples(v, ["v"], 4).orderBy("position").collect()] == [0, 31, 62, 93]


def test_matrix_is_symmetric(grid):
    cells, _ = grid
    nodes = topology.incidence(cells.where("e < 9"), "node_tags", "node")
    a = {(r.i, r.j): r.a for r in linalg.assemble(nodes).collect()}
    assert all(a[j, i] == pytest.approx(x) for (i, j), x in a.items())
    x = {r.i: r.x for r in linalg.assemble_vector(nodes).collect()}
    y = {r.i: r.y for r in linalg.spmv(linalg.assemble(nodes), linalg.assemble_vector(nodes)).collect()}
    for i, value in y.items():
        assert value == pytest.approx(sum(k * x[j] for (p, j), k in a.items() if p == i))


def test_volumes(spark):
    corners = [F.array(*[F.lit(float(c)) for c in p]) for p in generators.CORNERS]
    assert spark.range(1).select(scalars.hex_volume(corners)).first()[0] == pytest.approx(1)
    assert spark.range(1).select(scalars.tet_volume([corners[i] for i in (0, 1, 3, 4)])).first()[0] == pytest.approx(1 / 6)


TET = """$MeshFormat
2.2 0 8
$EndMeshFormat
$Nodes
5
1 0 0 0
2 1 0 0
3 0 1 0
4 0 0 1
5 1 1 1
$EndNodes
$Elements
3
1 2 2 0 1 1 2 3
2 4 2 0 1 1 2 3 4
3 4 2 0 1 2 3 4 5
$EndElements
"""
TET4 = """$MeshFormat
4.1 0 8
$EndMeshFormat
$Nodes
1 5 1 5
3 1 0 5
1
2
3
4
5
0 0 0
1 0 0
0 1 0
0 0 1
1 1 1
$EndNodes
$Elements
2 3 1 3
2 1 2 1
1 1 2 3
3 1 4 2
2 1 2 3 4
3 2 3 4 5
$EndElements
"""


@pytest.mark.parametrize("text", [TET, TET4])
def test_msh(spark, tmp_path, text):
    (tmp_path / "two.msh").write_text(text)
    nodes, elements = msh.read_mesh(spark, str(tmp_path))
    rows = msh.element_rows(nodes, elements)
    assert msh.element_type(elements) == 4 and rows.count() == 2
    first = rows.where("e = 2").first()
    assert (first.x, first.y, first.z) == (0.25, 0.25, 0.25)
    assert [tuple(r) for r in topology.face_edges(topology.incidence(rows, "faces", "face")).collect()] == [(2, 3)]
    with pytest.raises(ValueError, match="exactly one"):
        msh.element_type(elements.where("etype = 2"))


def test_octree(spark, tmp_path):
    rec = np.zeros(2, octree.RECORD)
    rec["eid"], rec["e2e"] = [7, 9], octree.BORDER
    rec["e2e"][0, 1], rec["e2e"][1, 0], rec["e2e"][1, 2] = 9, 7, 1234
    path = tmp_path / "tree_2.bin"
    path.write_bytes(rec.tobytes())
    rows = octree.read_octree(spark, str(path))
    assert [tuple(r) for r in topology.neighbor_edges(rows, rows).collect()] == [(7, 9)]
    for name, content in (("cut.bin", b"x" * 81), ("tree_3.bin", rec.tobytes())):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(ValueError, match="number of records"):
            octree.read_octree(spark, str(tmp_path / name))


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% note\n4 4 3\n2 1\n3 1\n2 2\n")
    edges = files.matrix_edges(files.read_matrix_market(spark, str(tmp_path / "a.mtx")))
    assert {tuple(r) for r in edges.collect()} == {(1, 2), (1, 3)}
    pts = spark.createDataFrame([(0.0, 1.0, 2.0, 0), (1.0, 1.0, 2.0, 1)], "x double, y double, z double, label int")
    assert files.write_vtk(pts, str(tmp_path / "p.vtk"), scalars=("label",)) == 2
    lines = [r.value for r in numbered_lines(spark, str(tmp_path / "p.vtk")).orderBy("at").collect()]
    assert lines[3:9] == ["DATASET POLYDATA", "POINTS 2 double", "0.0 1.0 2.0", "1.0 1.0 2.0", "POINT_DATA 2", "COLOR_SCALARS colour 3"]
    assert len(lines) == 15 and all(len(x.split()) == 3 for x in lines[9:11]) and lines[11:] == ["SCALARS label long 1", "LOOKUP_TABLE default", "0", "1"]
    files.write_slices(pts, str(tmp_path / "slices"))
    assert spark.read.parquet(str(tmp_path / "slices")).count() == 2
    (tmp_path / "list.txt").write_text("a.msh\n\n b.msh\n")
    listed = files.read_file_list(spark, str(tmp_path / "list.txt"))
    assert [r.path for r in files.unprocessed(listed, listed.where("path = 'a.msh'")).collect()] == ["b.msh"]
    assert files.mesh_files(spark, str(tmp_path / "*.mtx")).first().length > 0


def test_run_log_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 4, 30), (0, 1, 4, 20), (0, 2, 8, 15)], "mesh_idx int, run_idx int, np int, BFS_labeling_time long")
    path = str(tmp_path / "log")
    files.append_run_log(rows, path)
    files.append_run_log(rows, path)
    log = files.read_run_log(spark, path)
    assert log.count() == 6 and len(log.columns) == 41
    assert analysis.best_of(log, ["np"], "BFS_labeling_time").count() == 4
    query = run_log.best_times(run_log.log_stream(spark, path)).writeStream.outputMode("complete").format("memory").queryName("best").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("best").collect()} == {(0, 4, 20, 4), (0, 8, 15, 2)}


def test_zscore_and_ranks(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [*[1] * 20, 100]] + [("b", 5.0)], "g string, v double")
    assert analysis.zscore_filter(df, ["g"], "v").count() == 21
    got = {r.v: r["rank"] for r in analysis.rank_highest(df.where("g = 'a'"), "v").collect()}
    assert got == {1.0: 19, 100.0: 20}
    z = analysis.standardise(df.where("g = 'b'"), "v").first()
    assert z.z is None


def test_walks_and_bids(spark, grid):
    cells, edges = grid
    place = {r.e: (r.i, r.j, r.k) for r in cells.collect()}
    start = spark.createDataFrame([(0, 0), (1, 62)], "walker long, v long")
    one = {r.walker: r.v for r in growth.walk_seeds(edges, start, 1).collect()}
    assert all(sum(abs(a - b) for a, b in zip(place[one[w]], place[v], strict=True)) == 1 for w, v in ((0, 0), (1, 62)))
    bids = spark.createDataFrame([(1, 0, 3), (1, 2, 3), (2, 1, 5), (3, 1, 1)], "v long, label long, dist int")
    owners = spark.createDataFrame([(1, None, None), (2, 7, 4), (3, 7, 4), (4, 7, 0)], "v long, label long, dist int")
    assert {r.v: (r.label, r.dist) for r in growth.granted(bids, owners).collect()} == {1: (0, 3), 2: (7, 4), 3: (1, 1), 4: (7, 0)}


def test_reach_stops_at_enough(spark, grid):
    _, edges = grid
    got = growth.seed_reach(edges, spark.createDataFrame([(0, 0), (124, 1)], "v long, label long"), 10).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 10, 1: 10}


def test_bidding_starts_from_all_labels(spark):
    n, parts, place = 24, 2, {v: v // 18 for v in range(24)}  # a path; the first part is larger
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "u long, v long")
    got = growth.bidding(e, spark.createDataFrame(list(place.items()), "v long, label long"), 3).collect()
    for _ in range(3):
        dist = {}
        for p in range(parts):
            own = sorted(v for v in place if place[v] == p)
            mid, limit = own[len(own) // 2], 2 * int(np.ceil(np.log2(len(own))))
            dist |= {(v, p): abs(v - mid) for v in range(n) if abs(v - mid) < limit}
        best = {v: min((dist[v, p], p) for p in range(parts) if (v, p) in dist) for v in range(n) if any((v, p) in dist for p in range(parts))}
        place = {v: best[v][1] if v in best and best[v][0] < dist.get((v, own), n) else own for v, own in place.items()}
    assert len(got) == n and {r.v: r.label for r in got} == place and list(place.values()).count(0) != 18


def test_seeds_grow_until_the_slowest_has_enough(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(19)], "u long, v long")
    got = growth.seed_reach(e, spark.createDataFrame([(0, 0), (10, 1)], "v long, label long"), 5).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 5, 1: 9}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_size_proxy_query_returns_every_vertex_once(spark):
    got = catalogue.QUERIES["size_proxy_labels"](spark, "/root/testdata/sf0.01").agg(F.count(F.lit(1)), F.count_distinct("v"), F.count("label")).first()
    assert set(got) == {spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_matrix_query_has_entries_of_all_elements(spark):
    elements = {}
    for r in catalogue._nodes(spark, "/root/testdata/sf0.001").collect():
        elements.setdefault(r.e, []).append(r.node)
    want = {(i, j) for nodes in elements.values() for i in nodes for j in nodes}
    assert {(r.i, r.j) for r in catalogue.QUERIES["coo_assembly"](spark, "/root/testdata/sf0.001").collect()} == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_totals_query_keeps_every_line(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax").collect()
    want = sorted((r[0], r[1], float(r[2]) + float(r[3]) + float(r[4])) for r in lines)
    got = sorted((r.l_orderkey, r.l_linenumber, float(r.total)) for r in catalogue.QUERIES["derived_totals"](spark, "/root/testdata/sf0.001").collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-3)


def test_a_run_from_file_to_log(spark, tmp_path):
    (tmp_path / "two.msh").write_text(TET)
    elements = runs.ordered_mesh(spark, str(tmp_path / "two.msh"))
    assert sorted(r.global_idx for r in elements.collect()) == [0, 1]
    row = runs.run_row(elements, 2, "two.msh", products=2)
    assert len(row.columns) == 41
    files.append_run_log(row, str(tmp_path / "log"))
    got = files.read_run_log(spark, str(tmp_path / "log")).first()
    assert (got.n, got.np, got.SFC_morton_partition_sizes, got.BFS_partition_boundaries, got.SFC_morton_boundary_ratio) == (2, 2, [1, 1], [1, 1], 1.0)
    assert got.BFS_matvec_time > 0 and got.parMETIS_rho_max is None
    rec = np.zeros(8, octree.RECORD)
    rec["eid"], rec["e2e"] = np.arange(8), octree.BORDER
    rec["coord"] = [(k >> 2, k >> 1 & 1, k & 1) for k in range(8)]
    for k in range(8):
        rec["e2e"][k][:3] = [k ^ 1, k ^ 2, k ^ 4]
    (tmp_path / "tree_8.bin").write_bytes(rec.tobytes())
    leaves = runs.ordered_octree(spark, str(tmp_path / "tree_8.bin"))
    row = runs.run_row(leaves, 2, "tree_8.bin").first()
    assert row.SFC_morton_partition_sizes == [4, 4] and row.SFC_morton_boundary_ratio == 1.0 and row.BFS_mat_assembly_time is None


def serial(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    return near


def distances(near, start):
    dist, layer, k = {start: 0}, [start], 0
    while layer:
        k += 1
        layer = [w for w in {w for v in layer for w in near[v]} if w not in dist]
        dist |= dict.fromkeys(layer, k)
    return dist


@pytest.fixture(scope="module")
def oversampled(grid):
    """Vertices, edges, neighbours and, for a number of parts, the seeds along the key with their distances."""
    cells, edges = grid
    v = cells.select(F.col("e").alias("v"))
    near = serial([tuple(r) for r in edges.collect()])

    def seeded(many):
        n, seeds, at = N**3, {}, 0
        for k in range(many):
            size = n // many + (k < n % many)
            seeds[k], at = at + size // 2, at + size
        return seeds, {k: distances(near, s) for k, s in seeds.items()}

    return v, edges, near, seeded


def assigned(dist, alive):
    return {v: min((dist[k][v], k) for k in alive)[1] for v in range(N**3)}


def renamed(labels, alive):
    dense = {k: i for i, k in enumerate(sorted(alive))}
    return {v: dense[k] for v, k in labels.items()}


def test_oversampling_equals_a_serial_run(oversampled):
    v, edges, near, seeded = oversampled
    parts = 4
    collect = lambda df: {r.v: r.label for r in df.collect()}
    seeds, dist = seeded(6)
    alive = set(seeds)
    for _, a, b in sorted((dist[b][seeds[a]], a, b) for a in seeds for b in seeds if a < b):
        if len(alive) > parts and a in alive and b in alive:
            alive.discard(a)
    assert collect(labelling.oversample_nearest(v, edges, ["v"], parts)) == renamed(assigned(dist, alive), alive)
    seeds, dist = seeded(12)
    alive = set(seeds)
    while len(alive) > parts:
        now = list(assigned(dist, alive).values())
        alive.discard(min(alive, key=lambda k: (now.count(k), k)))
    assert collect(labelling.oversample_drop_smallest(v, edges, ["v"], parts, 3)) == renamed(assigned(dist, alive), alive)
    seeds, dist = seeded(8)
    alive = set(seeds)
    while len(alive) > parts:
        label = assigned(dist, alive)
        load = np.array([list(label.values()).count(k) for k in seeds], float)
        cut = np.array([sum(label[x] == k and label[y] != k for x in near for y in near[x]) for k in seeds], float)
        z = abs((load - load.mean()) / load.std(ddof=1)) + (cut - cut.mean()) / cut.std(ddof=1)
        alive.discard(max(alive, key=lambda k: (round(z[k], 9), -k)))
    assert collect(labelling.oversample_drop_high_cut(v, edges, ["v"], parts)) == renamed(assigned(dist, alive), alive)
    seeds, dist = seeded(20)
    label = assigned(dist, seeds)
    ratio = {k: sum(label[x] == k and label[y] != k for x in near for y in near[x]) / max(list(label.values()).count(k), 1) for k in seeds}
    kept = sorted(sorted(seeds, key=lambda k: (ratio[k], k))[:parts])
    assert collect(labelling.drop_worst(v, edges, ["v"], parts)) == renamed(assigned(dist, kept), kept)


def test_downsampling_equals_a_serial_run(oversampled):
    v, edges, near, _ = oversampled
    seeds = {k: k * (N**3 // 8) for k in range(8)}
    dist = {k: distances(near, s) for k, s in seeds.items()}
    label = assigned(dist, seeds)
    pair = {}
    for x in near:
        for y in near[x]:
            a, b = label[x], label[y]
            if a < b:
                pair[a, b] = min(pair.get((a, b), 1 << 30), dist[a][x] + dist[b][y])
    alive = set(seeds)
    for (a, b), _ in sorted(pair.items(), key=lambda r: (r[1], r[0])):
        if len(alive) > 4 and a in alive and b in alive:
            alive.discard(a)
    got = {r.v: r.label for r in labelling.downsample_seeds(v, edges, ["v"], 4).collect()}
    assert got == {seeds[k]: i for i, k in enumerate(sorted(alive)[:4])}


def test_scrambling_is_reversible(spark):
    n = F.col("id") * 7919 + 5
    got = spark.range(1000).select(n.alias("n"), scalars.scrambled(n).alias("s"), scalars.unscrambled(scalars.scrambled(n)).alias("back")).collect()
    assert all(r.n == r.back for r in got) and len({r.s for r in got}) == 1000


def test_hot_keys_are_dealt_by_row(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 800, F.lit(900)).otherwise(F.col("id")).alias("a"), F.col("id").alias("b"))
    table = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k"))
    joined = skew.looked_up(rows, table, "a", 2000)
    assert {tuple(r) for r in joined.collect()} == {(900, i, 0, 801) if i < 800 or i == 900 else (i, i, i, 1) for i in range(2000)}
    assert "_deal" in joined._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1].split("\n")[0]  # a key of the join, so that the hot rows spread


def test_lines_are_numbered_across_splits(spark, tmp_path):
    want = [f"line {i} {'x' * (i % 50)}" for i in range(3000)]
    (tmp_path / "one.txt").write_text("\n".join(want))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(want)], "k long, line string")
    write_document(rows.repartition(5), ["k"], str(tmp_path / "parts"), 7)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        for name in ("one.txt", "parts"):
            assert spark.read.text(str(tmp_path / name)).rdd.getNumPartitions() > 5
            got = numbered_lines(spark, str(tmp_path / name)).orderBy("at").collect()
            assert [r.at for r in got] == list(range(3000)) and [r.value for r in got] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


TRIANGLES = """$MeshFormat
4.1 0 8
$EndMeshFormat
$PhysicalNames
2
1 7 "outer edge"
2 9 "plate"
$EndPhysicalNames
$Entities
2 1 1 0
1 0 0 0 0
2 1 0 0 1 5
4 0 0 0 1 0 0 2 7 -8 2 1 -2
6 0 0 0 1 1 0 1 9 1 -4
$EndEntities
$Nodes
2 4 1 4
0 1 0 1
1
0 0 0
2 6 0 3
2
3
4
1 0 0
0 1 0
1 1 0
$EndNodes
$Elements
3 4 1 4
0 1 15 1
1 1
2 6 2 2
2 1 2 3
3 2 4 3
1 4 1 1
4 1 2
$EndElements
"""


def test_blocks_of_triangles_and_entities(spark, tmp_path):
    """Lines of four whole numbers are both headers and triangles; two files at once, one of them flat."""
    (tmp_path / "a.msh").write_text(TRIANGLES)
    (tmp_path / "b.msh").write_text(TET)
    mesh = msh.Mesh(spark, str(tmp_path))
    mine = lambda df: [tuple(r)[1:] for r in df.where("path like '%a.msh'").orderBy(df.columns[1]).collect()]
    assert mine(mesh.elements()) == [(1, 15, [1]), (2, 2, [1, 2, 3]), (3, 2, [2, 4, 3]), (4, 1, [1, 2])]
    assert mine(mesh.nodes()) == [(1, 0, 0, 0), (2, 1, 0, 0), (3, 0, 1, 0), (4, 1, 1, 0)]
    assert mine(mesh.entities().orderBy("dim")) == sorted([(0, 1, [], []), (0, 2, [5], []), (1, 4, [7, -8], [1, -2]), (2, 6, [9], [-4])])
    assert mine(mesh.physical_names()) == [(1, 7, "outer edge"), (2, 9, "plate")]
    assert mesh.elements().where("path like '%b.msh'").count() == 3
    (tmp_path / "c.msh").write_text("$MeshFormat\n4.1 1 8\n$EndMeshFormat\n")
    with pytest.raises(ValueError, match="binary"):
        msh.Mesh(spark, str(tmp_path / "c.msh"))


def test_octree_is_read_in_record_splits(spark, tmp_path):
    rec = np.zeros(5000, octree.RECORD)
    rec["eid"], rec["e2e"] = np.arange(5000), octree.BORDER
    rec["e2e"][:, 3] = np.arange(5000) + 1
    (tmp_path / "tree_5000.bin").write_bytes(rec.tobytes())
    conf, limit = spark._jsc.hadoopConfiguration(), "mapreduce.input.fileinputformat.split.maxsize"
    conf.set(limit, "10000")
    try:
        assert spark.sparkContext.binaryRecords(str(tmp_path), octree.RECORD.itemsize).getNumPartitions() > 10
        got = octree.read_octree(spark, str(tmp_path)).orderBy("e").collect()
    finally:
        conf.unset(limit)
    assert [r.e for r in got] == list(range(5000)) and all(r.neigh == [None] * 3 + [r.e + 1] + [None] * 2 for r in got)


def test_matrix_market_goes_by_each_files_header(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real skew-symmetric\n%\n3 3 2\n2 1 5\n3 1 -2.5\n")
    (tmp_path / "b.mtx").write_text("%%MatrixMarket matrix array real symmetric\n3 3\n1\n2\n3\n4\n5\n6\n")
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix array integer general\n2 3\n1\n2\n3\n4\n5\n6\n")
    (tmp_path / "d.mtx").write_text("%%MatrixMarket matrix array real skew-symmetric\n4 4\n1\n2\n3\n4\n5\n6\n")
    (tmp_path / "e.mtx").write_text("%%MatrixMarket matrix coordinate complex Hermitian\n2 2 2\n1 1 4 0\n2 1 3 9\n")
    got = {}
    for r in files.read_matrix_market(spark, str(tmp_path)).collect():
        assert got.setdefault(r.path[-5], {}).setdefault((r.i, r.j), r.a) == r.a
    lower = {(1, 1): 1, (2, 1): 2, (3, 1): 3, (2, 2): 4, (3, 2): 5, (3, 3): 6}
    skew = {(2, 1): 1, (3, 1): 2, (4, 1): 3, (3, 2): 4, (4, 2): 5, (4, 3): 6}
    assert got["a"] == {(2, 1): 5, (1, 2): -5, (3, 1): -2.5, (1, 3): 2.5}
    assert got["b"] == lower | {(j, i): x for (i, j), x in lower.items()}
    assert got["c"] == {(1, 1): 1, (2, 1): 2, (1, 2): 3, (2, 2): 4, (1, 3): 5, (2, 3): 6}
    assert got["d"] == skew | {(j, i): -x for (i, j), x in skew.items()}
    assert got["e"] == {(1, 1): 4, (2, 1): 3, (1, 2): 3}


@pytest.mark.parametrize("count", [1, 4, 40])
def test_block_growth_equals_hops(spark, grid, count):
    """Blocks of any number; seeds outside the graph stay, unreached vertices don't show, ties go to the least label."""
    _, edges = grid
    more = edges.union(spark.createDataFrame([(900, 901), (901, 901), (900, 901)], "u long, v long"))
    seeds = spark.createDataFrame([(0, 3), (N**3 - 1, 1), (N * N, 2), (N * N, 9), (777, 4)], "v long, label long")
    got = blocks.bfs(more, seeds, blocks.vertex_blocks(more, blocks=count))
    assert {tuple(r) for r in got.collect()} == {(r.v, r.label, r.dist) for r in iterate.bfs(more, seeds).select("v", "label", F.col("dist").cast("long").alias("dist")).collect()}
    assert blocks.bfs(more, seeds.limit(0)).count() == 0


def test_a_scratch_scope_deletes_its_tables(spark):
    rows = spark.range(10)
    with iterate.scratch(spark) as root:
        table = iterate.written(rows, "x")
        assert table.count() == 10 and root in table.inputFiles()[0]
    kept = iterate.written(rows, "x")
    assert kept.count() == 10 and root not in kept.inputFiles()[0]
    assert not os.path.exists(root.removeprefix("file:"))


def test_random_points_are_seeded(spark):
    one, two = (generators.random_points(spark, 50, s).collect() for s in (1, 2))
    assert one == generators.random_points(spark, 50, 1).collect() != two and all(0 <= r[c] < 1 for r in one for c in "xyz")


def test_connected_list_and_csv_results(spark, tmp_path):
    found = spark.createDataFrame([("b", True), ("a", True), ("c", False)], "path string, connected boolean")
    files.write_connected_list(spark, found, str(tmp_path / "list"))
    assert [r.path for r in files.read_file_list(spark, str(tmp_path / "list")).collect()] == ["a", "b"]
    for k in range(2):
        files.append_results(spark.createDataFrame([(k, [1, 2])], "np int, sizes array<int>"), str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == [("0", "[1,2]"), ("1", "[1,2]")]


def test_the_run_cache_takes_every_file_once(spark, tmp_path):
    place = [str(tmp_path / x) for x in ("logs", "cache", "progress")]
    row = lambda k: spark.createDataFrame([(k, 1, "m.msh", 4, 10)], "mesh_idx int, run_idx int, mesh_file string, np int, n bigint")
    for k in range(2):
        files.append_run_log(row(k), place[0])
    run_log.cache_runs(spark, *place)
    run_log.cache_runs(spark, *place)
    files.append_run_log(row(2), place[0])
    run_log.cache_runs(spark, *place)
    got = spark.read.parquet(place[1])
    assert sorted(r.mesh_idx for r in got.collect()) == [0, 1, 2] and len(got.columns) == 41


def test_tiles_give_the_product_and_move_ghosts_only(spark):
    rng = np.random.default_rng(3)
    cells = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (160, 2))} - {(7, 7)})
    entries = [(i, j, float(rng.normal())) for i, j in cells if i != 5] + [(3, 4, 1.5), (3, 4, 2.0)]
    x = {i: float(rng.normal()) for i in range(38)}
    a, v = spark.createDataFrame(entries, "i long, j long, a double"), spark.createDataFrame(list(x.items()), "i long, x double")
    want = {}
    for i, j, value in entries:
        want[i] = want.get(i, 0.0) + value * x.get(j, 0.0)
    for count in (1, 3, 8):
        with tiles.tiled(a, v, count) as held:
            ghosts = held.ghosts().count()
            got = {r.i: r.y for r in held.product().collect()}
        assert got == pytest.approx(want) and (ghosts == 0) == (count == 1)
    y, took = tiles.products(a, v, 4, 3)
    assert len(took) == 3 and {r.i: r.y for r in y.collect()} == pytest.approx(want)


def test_summaries_keep_their_rank(spark):
    rows = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(1000)) * 1.0).alias("x")).union(spark.sql("select cast(null as double)"))
    for r in analysis.sketched_positions(rows, "x", [0.0, 0.1, 0.5, 0.99, 1.0], 500).collect():
        share = [0.0, 0.1, 0.5, 0.99, 1.0][r.k]
        assert r.n == 20_000 and r["rank"] >= r.n * share - r.n / 500 and rows.where(F.col("x") < r.x).count() <= r.n * share + r.n / 500


def test_multilevel_cuts_less_than_growth_and_balances(spark):
    ids = spark.range(1000).select(F.col("id").alias("e"))
    edges = iterate.written(generators.lattice_edges(ids, 10), "edges")
    v = ids.select(F.col("e").alias("v"))
    fine = multilevel.multilevel(v, edges, ["v"], 5)
    cut, grown = (metrics.edge_cut(edges, x).first()["lambda"] for x in (fine, labelling.REGISTRY["bfs"](v, edges, ["v"], 5)))
    q = metrics.quality(edges, fine, 5).first()
    assert cut < grown and q.n == 1000 and q.rho_max <= 1.15 and q.rho_min > 0.7
    assert sorted(map(tuple, fine.collect())) == sorted(map(tuple, multilevel.multilevel(v.repartition(7), edges.repartition(5), ["v"], 5).collect()))


def test_walks_are_those_of_a_loop(spark, grid):
    import struct

    xxhash = pytest.importorskip("xxhash")
    _, edges = grid
    near = serial([tuple(r) for r in edges.collect()])

    def hashed(step, walker, v):
        h = xxhash.xxh64_intdigest(struct.pack("<i", step), 42)
        for x in (walker, v):
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        return h - (1 << 64) if h >> 63 else h

    want = {w: 17 * w for w in range(6)} | {6: 10_000}
    start = spark.createDataFrame(list(want.items()), "walker long, v long")
    for k in range(5):
        want = {w: min(((hashed(7 + k, w, x), x) for x in near.get(v, ())), default=(0, v))[1] for w, v in want.items()}
    assert {r.walker: r.v for r in growth.walk_seeds(edges, start, 5).collect()} == want


def test_growth_by_seed_in_blocks_equals_hops(spark, grid, monkeypatch):
    """Apart, with enough vertices a seed, without a limit, and from a state: blocks give what hops give, also for seeds outside the graph."""
    monkeypatch.setattr(blocks, "LEAST_ARCS", 64)
    _, edges = grid
    assert blocks.block_count(edges) > 1
    more = edges.union(spark.createDataFrame([(900, 901), (901, 901), (900, 901)], "u long, v long"))
    inside = spark.createDataFrame([(0, 3), (N**3 - 1, 1), (N * N, 2)], "v long, label int")
    outside = inside.union(spark.createDataFrame([(777, 4), (900, 5)], "v long, label int"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    for seeds, enough in ((inside, 40), (inside, 1), (outside, 40), (outside, 1 << 60)):
        got, hops = blocks.seed_reach(more, seeds, enough), growth.seed_reach(more, seeds, enough)
        assert rows(got) == rows(hops) and got.dtypes == hops.dtypes
    state = iterate.bfs(more, outside).select("v", "label", F.when(F.col("label") == 3, F.col("dist") + 3).otherwise(F.col("dist")).alias("dist"))
    got, hops = blocks.relax(more, state), iterate.relax(more, iterate.written(state))
    assert rows(got) == rows(hops) and got.dtypes == hops.dtypes
    with blocks.dealt(more) as graph:
        near = graph.grow(outside.where("label <> 2").withColumn("dist", F.lit(0)), apart=True, limit={1: 0, 3: 4, 4: 1, 5: 1})
    hops = [(v, k, d) for v, k, d in rows(growth.seed_reach(more, outside, 1 << 60)) if d <= {1: 0, 3: 4, 4: 1, 5: 1}.get(k, -1)]
    assert rows(near) == hops


def test_rounds_of_growth_do_not_follow_hops(spark, monkeypatch):
    """On a path, growth of every kind that counts hops takes a few rounds."""
    made, add = [], iterate.Layers.add
    monkeypatch.setattr(iterate.Layers, "add", lambda self, df: made.append(1) or add(self, df))
    v = spark.range(60).select(F.col("id").alias("v"))
    e = v.where("v < 59").select(F.col("v").alias("u"), (F.col("v") + 1).alias("v"))
    seeds = spark.createDataFrame([(0, 0), (20, 1)], "v long, label long")
    assert {r.v: r.dist for r in labelling.bfs_partition(e, seeds).collect()} == {k: min(k, abs(k - 20)) for k in range(60)} and len(made) < 8
    made.clear()
    assert labelling.oversample_nearest(v, e, ["v"], 2).count() == 60 and len(made) < 8


def test_assembly_from_elements_joins_and_sorts_nothing(spark):
    """A node that an element lists twice counts twice, as in assembly from incidences; neither it nor the product sorts a matrix."""
    cells = spark.createDataFrame([(0, [0, 1, 2]), (1, [1, 2, 3]), (2, [4, 4, 0])], "e long, node_tags array<long>")
    nodes = topology.incidence(cells, "node_tags", "node")
    made = linalg.assemble_elements(cells)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, linalg.assemble(nodes).collect()))
    plan = linalg.spmv(made, linalg.assemble_vector(nodes))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_multilevel_writes_few_tables_and_agrees_in_quality_by_either_way(spark, monkeypatch):
    """Coarse levels in one task, or all of them as tables; parts that nothing joins and vertices without edges keep a label."""
    import os

    ids = spark.range(300).select(F.col("id").alias("e"))
    edges = iterate.written(generators.lattice_edges(ids.where("e < 290 and e % 97 <> 5"), 7), "edges")
    v = ids.select(F.col("e").alias("v"))
    root = spark.conf.get("spark.checkpoint.dir") + "/meshloom"
    before = len(os.listdir(root))
    fine = multilevel.multilevel(v, edges, ["v"], 2, 1)
    assert fine.count() == 300 and len(os.listdir(root)) - before < 20
    monkeypatch.setattr(multilevel, "SMALL", 0)
    tables = multilevel.multilevel(v, edges, ["v"], 2, 1)
    for found in (fine, tables):
        q = metrics.quality(edges, found, 2).first()
        assert q.n == 300 and q.rho_max <= 1.15 and metrics.edge_cut(edges, found).first()["lambda"] < 0.3


def test_components_of_blocks_equal_hops(spark, monkeypatch):
    """Components that cross blocks, lie inside one, or are a vertex; all hops inside blocks take no round."""
    monkeypatch.setattr(blocks, "block_count", lambda edges: 5)
    v = spark.range(300).select(F.col("id").alias("v"))
    edges = iterate.written(spark.sql("select id as u, id + step as v from range(260) cross join (select explode(array(7, 1)) step) where case when step = 7 then id % 7 in (2, 5) and id < 240 else id % 50 < 3 end"))
    assert sorted(map(tuple, blocks.connected_components(v, edges).collect())) == sorted(map(tuple, iterate.connected_components(v, edges).collect()))
    chain = spark.range(3000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in blocks.connected_components(spark.range(3001).select(F.col("id").alias("v")), chain).collect()} == {0}


def test_copurchase_is_joined_once(spark):
    """What reads the edges of parts several times reads a table."""
    v, e = catalogue.fx.copurchase(spark, "/root/testdata/sf0.001")
    assert all("/copurchase-" in f for x in (v, e) for f in x.inputFiles()) and e.count() > 0


def test_tasks_follow_incidences(spark, grid, monkeypatch):
    """A task holds a bounded number of incidences, and pairs of elements are those of a loop, for a node of many elements too."""
    monkeypatch.setattr(topology, "PER_TASK", 50)
    cells, _ = grid
    incident = topology.incidence(cells, "node_tags", "node").union(spark.range(9).select((F.col("id") * 13).alias("e"), F.lit(-1).cast("long").alias("node")))
    rows = [tuple(r) for r in incident.collect()]
    assert topology.tasks_for(incident) == -(-len(rows) // 50)
    at = {}
    for e, node in rows:
        at.setdefault(node, []).append(e)
    assert sorted(map(tuple, topology.node_edges(incident).collect())) == sorted({(u, v) for l in at.values() for u in l for v in l if u < v})
    labels = cells.select(F.col("e").alias("v"), (F.col("e") % 7).alias("label"))
    assert {r.node: r.owner for r in topology.node_owners(incident, labels).collect()} == {n: min(e % 7 for e in l) for n, l in at.items()}
    nodes = incident.select("node").distinct().select("node", (F.col("node") * 2).alias("x"))
    sums = {}
    for e, node in rows:
        sums.setdefault(e, []).append(2.0 * node)
    assert all(abs(r.x - sum(sums[r.e]) / len(sums[r.e])) < 1e-9 for r in topology.node_means(incident, nodes, ["x"]).collect())
