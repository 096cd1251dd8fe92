"""One query per operator of the catalogue, over the derived fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.functions import curves, scalars
from meshloom.operators import analysis, blocks, growth, iterate, labelling, linalg, metrics, multilevel, ordering, rounds, tiles, topology
from meshloom.sources import files, generators, msh
from meshloom.sources.lines import numbered_lines
from meshloom.sources.tables import load

from . import fixtures as fx
from . import runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# --- curves, order, labels -------------------------------------------------


@query
def morton_key_points(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.with_morton(fx.points(spark, sf)).select("v", "morton")


@query
def sfc_order_points(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.global_index(ordering.with_morton(fx.points(spark, sf)), ["morton", "v"]).select("v", "global_idx")


def _sfc(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.block_labels(ordering.with_morton(fx.points(spark, sf)), ["morton", "v"], fx.PARTS)


@query
def sfc_block_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _sfc(spark, sf).select("v", "label")


@query
def sfc_floor_labels(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.floor_labels(ordering.with_morton(fx.points(spark, sf)), ["morton", "v"], 7).select("v", "label")


@query
def part_mid_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.mid_seeds(_sfc(spark, sf), ["morton", "v"]).select("label", "v")


@query
def part_centroid_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.centroid_seeds(_sfc(spark, sf), "v")


@query
def stride_samples(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.stride_samples(ordering.with_morton(fx.points(spark, sf)), ["morton", "v"], 16).select("position", "v")


@query
def rank_compressed_morton(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates replaced by their rank among all axes' values; axis order z, y, x."""
    long = fx.points(spark, sf).select("v", F.expr("stack(3, 0, x, 1, y, 2, z) as (axis, val)"))
    ranked = ordering.global_index(long, ["val", "v", "axis"], "r")
    wide = ranked.groupBy("v").agg(*[F.max(F.when(F.col("axis") == k, F.col("r"))).alias(f"r{k}") for k in range(3)])
    return wide.select("v", curves.morton3(F.col("r2"), F.col("r1"), F.col("r0")).alias("morton"))


@query
def min_gap_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """Least positive gap between adjacent values of each axis."""
    long = fx.points(spark, sf).select(F.expr("stack(3, 'x', x, 'y', y, 'z', z) as (axis, val)"))
    return ordering.least_gaps(long, "axis", "val", "spacing")


@query
def hilbert2d_index(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 64).alias("x"), (F.col("p_size") % 64).cast("long").alias("y"))
    return p.select("p_partkey", curves.hilbert2(F.col("x"), F.col("y"), 6).alias("d"))


@query
def morton2d_index(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    return p.select("p_partkey", curves.morton2(F.col("p_partkey") % 65536, F.col("p_size").cast("long")).alias("morton"))


@query
def quantize_variants(spark: SparkSession, sf: str) -> DataFrame:
    """19 levels with offset 1 in the cube."""
    p = fx.points(spark, sf)
    box = p.agg(*curves.bounds())
    return p.crossJoin(F.broadcast(box)).select("v", *[curves.quantize(F.col(c), F.col("low"), F.col("high"), 19, 1).alias(f"q{c}") for c in "xyz"])


@query
def weighted_blocks(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("v"), F.col("o_custkey").alias("w"))
    return ordering.weighted_blocks(o, ["v"], F.col("w"), fx.PARTS).select("v", "label")


@query
def x_slices(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.points(spark, sf)
    box = p.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return p.crossJoin(F.broadcast(box)).select("v", scalars.slice_of(F.col("x"), F.col("low"), F.col("high"), 6).alias("label"))


@query
def redistribute_index(spark: SparkSession, sf: str) -> DataFrame:
    """Rows renumbered by a scrambled label and the curve."""
    labelled = ordering.with_morton(fx.points(spark, sf)).withColumn("label", F.col("v") % 5)
    return ordering.redistribute(labelled, ["morton", "v"]).select("v", "label", "new_idx")


@query
def approximate_splitters(spark: SparkSession, sf: str) -> DataFrame:
    """Seven splitters that cut the order values into eight parts, interpolated between places of the global order."""
    q = analysis.at_positions(load(spark, sf, "orders"), "o_totalprice", [k / 8 for k in range(1, 8)])
    return q.select(F.col("k").cast("long").alias("k"), F.round("o_totalprice", 4).alias("value"))


@query
def sketched_splitters(spark: SparkSession, sf: str) -> DataFrame:
    """The same splitters from merged summaries, each with whether its rank is within n / 1000 of the place asked for."""
    q = analysis.sketched_positions(load(spark, sf, "orders"), "o_totalprice", [k / 8 for k in range(1, 8)])
    return q.select(F.col("k").cast("long").alias("k"), "n", (F.abs(F.col("rank") - F.col("n") * (F.col("k") + 1) / 8) <= F.col("n") / 1000 + 1).alias("within"))


# --- topology -----------------------------------------------------------------


def _faces(spark: SparkSession, sf: str) -> DataFrame:
    return topology.incidence(fx.cells(spark, sf), "faces", "face")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return topology.incidence(fx.cells(spark, sf), "node_tags", "node")


@query
def face_edges(spark: SparkSession, sf: str) -> DataFrame:
    return topology.face_edges(_faces(spark, sf))


@query
def boundary_faces(spark: SparkSession, sf: str) -> DataFrame:
    return topology.boundary_faces(_faces(spark, sf)).select("e", F.concat_ws(",", F.transform("face", lambda x: x.cast("string"))).alias("face"))


@query
def node_edges(spark: SparkSession, sf: str) -> DataFrame:
    return topology.node_edges(_nodes(spark, sf))


@query
def octree_edges(spark: SparkSession, sf: str) -> DataFrame:
    cells = fx.octree_cells(spark, sf)
    return topology.neighbor_edges(cells, cells)


@query
def element_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids by joining node tags to node coordinates."""
    w = fx.width(spark, sf)
    q = w + 1
    nodes = spark.range(q**3).select(F.col("id").alias("node"), F.expr(f"id div {q * q}").alias("x"), F.expr(f"(id div {q}) % {q}").alias("y"), F.expr(f"id % {q}").alias("z"))
    return topology.node_means(_nodes(spark, sf), nodes, list("xyz"))


@query
def vertex_degree(spark: SparkSession, sf: str) -> DataFrame:
    return topology.degrees(*fx.copurchase(spark, sf))


@query
def csr_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return topology.csr_offsets(*fx.copurchase(spark, sf))


@query
def adjacency_list(spark: SparkSession, sf: str) -> DataFrame:
    return topology.adjacency(fx.copurchase(spark, sf)[1])


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v, e = fx.lattice(spark, sf)
    return e, iterate.written(fx.key_labels(v), "labels")


@query
def ghost_counts(spark: SparkSession, sf: str) -> DataFrame:
    return topology.ghosts(*_labelled(spark, sf)).groupBy("part", "owner").agg(F.count(F.lit(1)).alias("ghosts"))


@query
def scatter_map(spark: SparkSession, sf: str) -> DataFrame:
    return topology.scatter_map(*_labelled(spark, sf))


@query
def node_owner_index(spark: SparkSession, sf: str) -> DataFrame:
    _, labels = _labelled(spark, sf)
    return topology.node_owners(_nodes(spark, sf), labels)


@query
def distinct_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(spark, sf).agg(F.countDistinct("node").alias("nodes"))


@query
def element_volume_tet5(spark: SparkSession, sf: str) -> DataFrame:
    """Volumes of unit lattice cells, stretched by the order's price along x."""
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("e"), F.col("o_totalprice").alias("s"))
    corners = [F.array(F.lit(float(a)) * F.col("s"), F.lit(float(b)), F.lit(float(c))) for a, b, c in generators.CORNERS]
    return o.select("e", F.round(scalars.hex_volume(corners), 4).alias("volume"))


# --- metrics ----------------------------------------------------------------------


@query
def partition_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.sizes(_labelled(spark, sf)[1], fx.PARTS + 1)


@query
def partition_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.boundaries(*_labelled(spark, sf), fx.PARTS)


@query
def partition_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = metrics.quality(*_labelled(spark, sf), fx.PARTS)
    return q.select("n", *[F.round(c, 9).alias(c) for c in q.columns[1:]])


@query
def edge_cut_lambda(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.edge_cut(*_labelled(spark, sf)).select("edges", "cut", F.round("lambda", 9).alias("lambda"))


@query
def face_entry_lambda(spark: SparkSession, sf: str) -> DataFrame:
    e, labels = _labelled(spark, sf)
    return metrics.face_entry_lambda(e, labels, 24 * labels.count()).select(F.round("lambda", 9).alias("lambda"))


@query
def part_loads_sends(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.loads_and_sends(*_labelled(spark, sf), fx.PARTS)


@query
def pair_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pair_cuts(*_labelled(spark, sf))


@query
def inside_edges(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.inside_edges(*_labelled(spark, sf))


# --- iterative --------------------------------------------------------------------


def _grown(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v, e = fx.lattice(spark, sf)
    e = iterate.written(e, "edges")
    return e, labelling.bfs_partition(e, fx.block_seeds(v))


@query
def bfs_distances(spark: SparkSession, sf: str) -> DataFrame:
    return _grown(spark, sf)[1].select("v", F.col("dist").cast("long").alias("dist"))


@query
def bfs_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _grown(spark, sf)[1].select("v", "label")


@query
def block_grown_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Growth by blocks along the vertices' order; only their borders are exchanged."""
    v, e = fx.lattice(spark, sf)
    return blocks.bfs(iterate.written(e, "edges"), fx.block_seeds(v))


@query
def multilevel_labels(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return multilevel.multilevel(v, iterate.written(e, "edges"), ["v"], fx.PARTS)


@query
def bfs_refined_labels(spark: SparkSession, sf: str) -> DataFrame:
    e, grown = _grown(spark, sf)
    return labelling.refined(e, grown, fx.PARTS).select("v", "label", F.col("dist").cast("long").alias("dist"))


@query
def bfs_layer_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return labelling.layer_sizes(_grown(spark, sf)[1]).select("label", F.col("dist").cast("long").alias("dist"), "n", "total")


@query
def seed_pair_distance(spark: SparkSession, sf: str) -> DataFrame:
    return labelling.seed_distances(*_grown(spark, sf))


@query
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of customers linked to the next customer with the same nation and segment among keys 7 apart."""
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("v"), "c_nationkey")
    e = c.alias("a").join(c.alias("b"), (F.col("b.v") == F.col("a.v") + 7) & (F.col("a.c_nationkey") % 5 == F.col("b.c_nationkey") % 5)).select(F.col("a.v").alias("u"), F.col("b.v").alias("v"))
    return blocks.connected_components(c, iterate.written(e, "edges"))


@query
def pagerank_15(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.copurchase(spark, sf)
    return labelling.pagerank(v, e).select("v", F.round("rank", 4).alias("rank"))


@query
def pagerank_labels(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return rounds.pagerank_labels(v, iterate.written(e), fx.block_seeds(v)).select("v", "label")


@query
def pagerank_covered_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Five rounds after every vertex has a label."""
    v, e = fx.lattice(spark, sf)
    return rounds.pagerank_labels(v, iterate.written(e), fx.block_seeds(v), 1e8, 1.2, 5).select("v", "label")


@query
def two_pass_weighted_labels(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return labelling.two_pass(iterate.written(e), fx.block_seeds(v), fx.PARTS).select("v", "label")


@query
def oversample_merge_labels(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return labelling.merge_pairs(v, iterate.written(e), ["v"], fx.PARTS)


@query
def oversample_drop_labels(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return labelling.drop_worst(v, iterate.written(e), ["v"], fx.PARTS).select("v", "label")


@query
def oversample_nearest_labels(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return labelling.oversample_nearest(v, iterate.written(e), ["v"], fx.PARTS)


@query
def oversample_drop_smallest_labels(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return labelling.oversample_drop_smallest(v, iterate.written(e), ["v"], fx.PARTS)


@query
def oversample_drop_high_cut_labels(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return labelling.oversample_drop_high_cut(v, iterate.written(e), ["v"], fx.PARTS)


@query
def stretch_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A hop of a part costs log2(its size) + 1."""
    v, e = fx.lattice(spark, sf)
    return rounds.stretch_growth(iterate.written(e), fx.block_seeds(v)).select("v", "label")


@query
def stretch_cut_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A hop of a part costs its cut edges and its frontier."""
    v, e = fx.lattice(spark, sf)
    return rounds.cut_growth(iterate.written(e), fx.block_seeds(v)).select("v", "label")


@query
def ordered_growth_labels(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return rounds.stealing_growth(iterate.written(e), fx.block_seeds(v), "ordered").select("v", "label")


@query
def noised_growth_labels(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return rounds.stealing_growth(iterate.written(e), fx.block_seeds(v), "noised").select("v", "label")


@query
def capped_fill_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Size proxies up to the ideal size; the others join the label whose inside edges gain most."""
    v, e = fx.lattice(spark, sf)
    e, n = iterate.written(e), v.count()
    return rounds.fill(v, e, growth.size_proxy(e, fx.block_seeds(v), n, fx.PARTS, 5, n // fx.PARTS))


@query
def downsampled_seeds(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return labelling.downsample_seeds(v, iterate.written(e), ["v"], fx.PARTS)


@query
def rebalanced_labels(spark: SparkSession, sf: str) -> DataFrame:
    e, grown = _grown(spark, sf)
    return rounds.rebalanced(e, grown)


@query
def seed_reach_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Distances from each of three seeds on its own, over the whole lattice."""
    v, e = fx.lattice(spark, sf)
    return blocks.seed_reach(iterate.written(e), fx.block_seeds(v, 3), 1 << 60).select("v", "label", F.col("dist").cast("long").alias("dist"))


@query
def size_proxy_labels(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    e = iterate.written(e)
    return rounds.fill(v, e, growth.size_proxy(e, fx.block_seeds(v), v.count(), fx.PARTS))


@query
def stop_when_ideal_labels(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return rounds.stop_when_ideal(v, iterate.written(e), fx.block_seeds(v), fx.PARTS)


@query
def walked_seeds(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return growth.walk_seeds(iterate.written(e), fx.block_seeds(v).select(F.col("label").alias("walker"), "v"), 5)


@query
def bidding_labels(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return growth.bidding(iterate.written(e), fx.key_labels(v))


@query
def label_propagation_labels(spark: SparkSession, sf: str) -> DataFrame:
    v, e = fx.lattice(spark, sf)
    return rounds.label_propagation(v, iterate.written(e), fx.PARTS, ["v"])


@query
def run_part_figures(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run over the lattice of orders: sizes and boundaries by part, read from its row of the metrics log."""
    cells = fx.cells(spark, sf).select("e", *[(F.col(a) + 0.5).alias(b) for a, b in zip("ijk", "xyz", strict=True)], "node_tags", "faces")
    row = runs.run_row(runs.ordered(cells), fx.PARTS, sf, products=1)
    arrays = {"sfc_size": "SFC_morton_partition_sizes", "sfc_boundary": "SFC_morton_partition_boundaries", "bfs_size": "BFS_partition_sizes", "bfs_boundary": "BFS_partition_boundaries"}
    return row.select(F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("k"), *arrays.values()).select(F.col("k").cast("long").alias("label"), *[F.get(c, F.col("k")).cast("long").alias(n) for n, c in arrays.items()])


# --- linear algebra ---------------------------------------------------------------


@query
def coo_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return linalg.assemble_elements(fx.cells(spark, sf)).select("i", "j", F.round("a", 6).alias("a"))


@query
def spmv_once(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    return linalg.spmv(linalg.assemble_elements(fx.cells(spark, sf)), linalg.assemble_vector(nodes)).select("i", F.round("y", 5).alias("y"))


@query
def spmv_tiled(spark: SparkSession, sf: str) -> DataFrame:
    """The same product over row tiles, between which only ghost entries move."""
    nodes = _nodes(spark, sf)
    matrix = iterate.written(linalg.assemble_elements(fx.cells(spark, sf)), "matrix")  # read thrice
    with tiles.tiled(matrix, linalg.assemble_vector(nodes), fx.PARTS) as held:
        y = iterate.written(held.product(), "product")
    return y.select("i", F.round("y", 5).alias("y"))


# --- run-log analysis -------------------------------------------------------------


@query
def best_of_runs(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.best_of(fx.runs(spark, sf), ["mesh_idx", "np"], "time")


@query
def best_per_mesh_first(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.best_first(fx.runs(spark, sf), ["mesh_idx"], ["time", "np", "run_idx"])


def _best(spark: SparkSession, sf: str) -> DataFrame:
    return fx.runs(spark, sf).groupBy("mesh_idx", "np").agg(F.min("time").alias("time"))


@query
def ideal_scaling(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.ideal_scaling(_best(spark, sf), ["mesh_idx"]).select("mesh_idx", "np", "time", F.round("ideal", 6).alias("ideal"))


@query
def relative_speedup(spark: SparkSession, sf: str) -> DataFrame:
    best = _best(spark, sf)
    ours, other = best.where("mesh_idx = 0").select("np", "time"), best.where("mesh_idx = 1").select("np", "time")
    return analysis.speedup(ours, other, ["np"]).select("np", F.round("speedup", 9).alias("speedup"))


@query
def zscore_filter(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.zscore_filter(fx.runs(spark, sf), ["np"], "time", 1.5)


@query
def standardise_sample(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return analysis.standardise(s, "c_acctbal").select("c_custkey", F.round("z", 6).alias("z"))


@query
def rank_max_ties(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.rank_highest(load(spark, sf, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "rank")


@query
def array_max_min_ratio(spark: SparkSession, sf: str) -> DataFrame:
    n, q = F.count("l_quantity"), F.col("l_quantity")
    return load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.max(q) / n, 9).alias("top"), F.round(F.min(q) / n, 9).alias("low"))


@query
def distribution_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = analysis.summary(fx.runs(spark, sf), ["np"], "time")
    return s.select("np", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in s.columns[1:]])


@query
def best_by_value(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.best_by_value(fx.runs(spark, sf), ["mesh_idx"], "time")


@query
def runs_before_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.before_cutoff(fx.runs(spark, sf), 4)


@query
def graph_connected(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the lattice is one component: number of components and of vertices."""
    v, e = fx.lattice(spark, sf)
    return blocks.connected_components(v, iterate.written(e)).agg(F.countDistinct("component").alias("components"), F.count(F.lit(1)).alias("vertices"))


@query
def scaling_series(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.series(_best(spark, sf), ["mesh_idx"], "np", "time")


@query
def min_over_files(spark: SparkSession, sf: str) -> DataFrame:
    """Least of the groups' greatest index less one."""
    top = fx.runs(spark, sf).groupBy("mesh_idx").agg((F.max("run_idx") - 1).alias("m"))
    return top.agg(F.min("m").alias("cutoff"))


@query
def derived_totals(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_quantity") + F.col("l_extendedprice") + F.col("l_tax"), 4).alias("total"))


@query
def grain_process_count(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").agg(F.expr("count(*) div 800").alias("processes"))


@query
def scientific_notation(spark: SparkSession, sf: str) -> DataFrame:
    """Prices moved off the ties, on which engines round differently."""
    return load(spark, sf, "orders").select("o_orderkey", scalars.scientific(F.floor("o_totalprice") + F.lit(0.3).cast("double")).alias("text"))


@query
def trailing_numbers(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/a_b/mesh_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit(".bin")).otherwise(F.lit("")))
    return load(spark, sf, "part").select("p_partkey", scalars.trailing_number(path).alias("count"))


@query
def bit_helpers(spark: SparkSession, sf: str) -> DataFrame:
    """Bit tricks over every key; those undefined for zero are null."""
    n = F.col("p_partkey")
    return load(spark, sf, "part").select(
        "p_partkey", scalars.floor_log2(n).cast("long").alias("log2"), scalars.is_power_of_two(n).alias("power"), scalars.next_power_of_two(n).cast("long").alias("next"), scalars.previous_power_of_two(n).alias("previous"),
        scalars.to_binary(n, 24).alias("bits"), scalars.from_binary(scalars.to_binary(n, 24)).alias("back"), scalars.unscrambled(scalars.scrambled(n)).alias("unscrambled"),
    )


@query
def stretch_increment(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", F.round(scalars.stretch(F.col("p_size")), 9).alias("step"))


@query
def remaining_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels left after a deletion, compacted."""
    kept = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("label")).exceptAll(load(spark, sf, "region").select((F.col("r_regionkey") * 3).cast("long").alias("label")))
    return kept.select("label", (F.dense_rank().over(W.orderBy("label")) - 1).cast("long").alias("new"))


@query
def expression_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios as text, as a metrics log holds them."""
    b = metrics.boundaries(*_labelled(spark, sf), fx.PARTS)
    return b.select("label", F.concat_ws("/", F.col("boundary").cast("string"), F.lit("1000")).alias("expr"))


@query
def square_grid_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees of an 8-neighbour grid with about as many cells as there are orders."""
    n = int(load(spark, sf, "orders").count() ** 0.5)
    e = generators.square_grid(spark, n, True)
    return topology.degrees(spark.range(n * n).select(F.col("id").alias("v")), e).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


# --- mesh and matrix files ------------------------------------------------------------


def _mesh_document(spark: SparkSession, sf: str, version: str) -> str:
    """The orders lattice as a mesh of hexahedra, written in parts."""
    cells, path = fx.cells(spark, sf), iterate.new_path(spark, "mesh")
    q = fx.width(spark, sf) + 1
    tags = cells.select(F.explode("node_tags").alias("node_tag")).distinct()
    place = [F.expr(f"node_tag div {q * q}"), F.expr(f"(node_tag div {q}) % {q}"), F.expr(f"node_tag % {q}")]
    nodes = tags.select("node_tag", *[x.cast("double").alias(c) for x, c in zip(place, "xyz", strict=True)])
    msh.write_mesh(nodes, cells.select(F.col("e").alias("element_tag"), F.lit(5).alias("etype"), "node_tags"), path, version)
    return path


@query
def mesh_scan_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of a mesh of blocks (MSH 4.1), a row per corner."""
    found = msh.Mesh(spark, _mesh_document(spark, sf, "4.1")).elements()
    return found.select("element_tag", F.col("etype").cast("long").alias("etype"), F.posexplode("node_tags").alias("at", "node_tag")).withColumn("at", F.col("at").cast("long"))


@query
def mesh_scan_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of a flat mesh (MSH 2.2)."""
    return msh.Mesh(spark, _mesh_document(spark, sf, "2.2")).nodes().drop("path")


@query
def mesh_read_order_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A mesh file read, ordered along the curve and cut in equal blocks: the driver of mesh runs up to its labels."""
    elements = runs.ordered_mesh(spark, _mesh_document(spark, sf, "4.1"))
    return ordering.block_labels(elements.select(F.col("e").alias("v"), "global_idx"), ["global_idx"], fx.PARTS).select("v", "label")


@query
def vtk_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the VTK document of the orders lattice with the cells' labels as scalars."""
    cells, path = fx.cells(spark, sf), iterate.new_path(spark, "vtk")
    q = fx.width(spark, sf) + 1
    tags = cells.select(F.explode("node_tags").alias("node_tag")).distinct()
    place = [F.expr(f"node_tag div {q * q}"), F.expr(f"(node_tag div {q}) % {q}"), F.expr(f"node_tag % {q}")]
    points = tags.select("node_tag", *[x.cast("double").alias(c) for x, c in zip(place, "xyz", strict=True)])
    labels = fx.key_labels(cells.select(F.col("e").alias("v")))
    labelled = cells.join(labels, cells.e == labels.v).select(F.col("e").alias("cell"), F.lit(5).alias("etype"), "node_tags", "label")
    files.write_vtk(points, path, order=("node_tag",), colour=None, cells=labelled, cell_scalars=("label",))
    return numbered_lines(spark, path).select("at", "value")


@query
def matrix_market_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Part adjacency written as a symmetric coordinate file and read back by its header."""
    _, e = fx.copurchase(spark, sf)
    path = iterate.new_path(spark, "matrix")
    n = e.agg(F.max("v")).first()[0]
    head = spark.createDataFrame([(0, 0, 0, f"%%MatrixMarket matrix coordinate pattern symmetric\n% parts\n{n} {n} {e.count()}")], "section int, u long, v long, line string")
    body = e.select(F.lit(1).alias("section"), "u", "v", F.concat_ws(" ", F.col("v").cast("string"), F.col("u").cast("string")).alias("line"))
    files.write_document(head.union(body), ["section", "u", "v"], path)
    return files.read_matrix_market(spark, path).drop("path")
