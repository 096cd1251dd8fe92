"""Graph partitioners.

Deterministic throughout: ties go to the lower label, so labels don't depend on
the partitioning of the tables.  Seed-level choices (p or p * p rows) are made on
the driver, everything per vertex in DataFrames."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks, growth, metrics, multilevel, rounds
from .blocks import distances as bfs
from .iterate import fixpoint, held, new_path, relax, symmetric, written
from .ordering import block_labels, mid_seeds, stride_samples
from .topology import labelled_arcs

#: Size bands over the ideal size and the adjustment of distances in each.  Fixed values.
HEAVY = ((3.2, 6), (2.5, 5), (2.0, 4), (1.7, 3), (1.5, 2), (1.2, 1))
LIGHT = ((0.2, -4), (0.4, -3), (0.6, -2), (0.8, -1))


def seeds_along(vertices: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """(v, label): the middle vertex of each equal block along ``keys``."""
    return mid_seeds(block_labels(vertices, keys, parts), keys).select("v", "label")


def bfs_partition(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(v, label, dist) of multi-source growth."""
    return bfs(edges, seeds)


def size_adjustment(size: Column, ideal: int) -> Column:
    """Distance added to a label's vertices by its size; cut-offs are whole numbers."""
    out = None
    for factor, by in HEAVY:
        test = size >= F.lit(int(factor * ideal))
        out = F.when(test, by) if out is None else out.when(test, by)
    for factor, by in LIGHT:
        out = out.when(size <= F.lit(int(factor * ideal)), by)
    return out.otherwise(0)


def refined(edges: DataFrame, state: DataFrame, parts: int) -> DataFrame:
    """One size-aware round after growth: distances move by the size of their label, then relax again."""
    n = state.count()
    sizes = state.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    moved = state.join(F.broadcast(sizes), "label").select("v", "label", F.greatest(F.lit(0), F.col("dist") + size_adjustment(F.col("size"), n // parts)).cast("int").alias("dist"))
    return blocks.relax(edges, written(moved))


def _weighted_arcs(edges: DataFrame) -> DataFrame:
    """(src, dst, k): arcs with the degree of their source."""
    arcs = symmetric(edges)
    return arcs.join(arcs.groupBy("src").agg(F.count(F.lit(1)).alias("k")), "src")


def pagerank(vertices: DataFrame, edges: DataFrame, weight: float = 1000.0, rounds: int = 15, damping: float = 1.0, every: int = 5) -> DataFrame:
    """(v, rank): rank' = d * sum(rank / degree) + (1 - d) / n, a fixed number of rounds.

    Arcs lie by source and vertices by key, as do the ranks, so a round shuffles the shares only."""
    vertices = written(vertices.select("v"), "vertices")  # read by the count, the first ranks and what is kept
    n = vertices.count()
    now = vertices.select("v", F.lit(float(weight)).alias("rank"))
    with held(_weighted_arcs(edges), "src") as arcs, held(vertices.select(F.col("v").alias("w")), "w") as own:
        for k in range(1, rounds + 1):
            sent = now.join(arcs, now.v == arcs.src).groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("rank") / F.col("k")).alias("got"))
            now = own.join(sent, own.w == sent.v, "left").select(F.col("w").alias("v"), (F.lit(damping) * F.coalesce("got", F.lit(0.0)) + F.lit((1 - damping) / max(n, 1))).alias("rank"))
            if k % every == 0 or k == rounds:
                now = written(now, "ranks")
    return now


def pagerank_labels(vertices: DataFrame, edges: DataFrame, seeds: DataFrame, weight: float = 10000.0, threshold: float = 1.05, after_coverage: int | None = None) -> DataFrame:
    """(v, label, value): a vertex takes the label of the greatest incoming weight per degree,
    if it has none yet or that weight exceeds its own by ``threshold``.

    Rounds end when none changes a vertex, or ``after_coverage`` rounds after every
    vertex has a label.  The shares that a vertex gets for a label are added in
    ascending order, so that rounding doesn't depend on the partitioning; a list of
    them is as long as a vertex has neighbours, which meshes bound."""
    start = vertices.join(seeds, "v", "left").select("v", "label", F.when(F.col("label").isNotNull(), F.lit(float(weight))).otherwise(F.lit(0.0)).alias("value"), F.lit(True).alias("changed"))
    left = after_coverage

    def covered(s: DataFrame) -> bool:
        nonlocal left
        if left is None or (left == after_coverage and not s.where("label is null").isEmpty()):
            return False
        left -= 1
        return left < 0

    def step(s: DataFrame) -> DataFrame:
        sent = s.where("label is not null").join(arcs, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), "label", (F.col("value") / F.col("k")).alias("share"), F.lit(None).cast("double").alias("own"))
        every = sent.union(s.select("v", "label", F.lit(None).cast("double"), F.col("value"))).repartition(parts, "v")  # one shuffle for both groupings
        sums = every.groupBy("v", "label").agg(F.sort_array(F.collect_list("share")).alias("shares"), F.max("own").alias("own"))
        offer = F.when(F.size("shares") > 0, F.struct(F.aggregate("shares", F.lit(0.0), lambda x, y: x + y).alias("got"), (-F.col("label")).alias("low")))
        both = sums.groupBy("v").agg(F.max(offer).alias("b"), F.max(F.when(F.col("own").isNotNull(), F.struct("label", "own"))).alias("m"))
        take = F.col("b").isNotNull() & (F.col("m.label").isNull() | (F.col("b.got") > threshold * F.col("m.own")))
        return both.select("v", F.when(take, -F.col("b.low")).otherwise(F.col("m.label")).alias("label"), F.when(take, F.col("b.got")).otherwise(F.col("m.own")).alias("value"), take.alias("changed"))

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with held(_weighted_arcs(edges), "src") as arcs:
        return fixpoint(start, step, covered)


def weighted_growth(edges: DataFrame, seeds: DataFrame, step_of: DataFrame) -> DataFrame:
    """Growth in which a hop costs the ``step`` of its label: least (cost, label), by relaxation."""
    return relax(edges, seeds.select("v", "label", F.lit(0.0).alias("dist")), written(step_of.select("label", F.col("step").cast("double").alias("step"))))


def two_pass(edges: DataFrame, seeds: DataFrame, parts: int, by: str = "size") -> DataFrame:
    """Plain growth sets each label's step, (size / ideal)^(1/3) or (cut / greatest cut)^(1/2); weighted growth follows."""
    first = written(bfs(edges, seeds).select("v", "label"))
    if by == "size":
        ideal = first.count() / parts
        steps = first.groupBy("label").agg((F.pow(F.count(F.lit(1)) / F.lit(ideal), 1 / 3)).alias("step"))
    else:
        cuts = metrics.loads_and_sends(edges, first, parts)
        top = cuts.agg(F.max("sends").alias("top"))
        steps = cuts.crossJoin(F.broadcast(top)).select("label", F.greatest(F.lit(0.05), F.sqrt(F.try_divide("sends", "top"))).alias("step"))
    steps = steps.select("label", F.round("step", 6).alias("step"))
    return rounds.weighted_growth(edges, seeds, steps)


def relabelled(labels: DataFrame, keep: dict[int, int]) -> DataFrame:
    """Labels mapped through a small table."""
    table = labels.sparkSession.createDataFrame(sorted(keep.items()), "label long, new long")
    return labels.join(F.broadcast(table), "label").select("v", F.col("new").alias("label"))


def merge_pairs(vertices: DataFrame, edges: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Grow p + ceil(log2 p) parts, then merge the pair with the longest common boundary
    whose joint size stays below twice the ideal (failing that, the longest), until p remain
    or no two parts touch."""
    more = parts + math.ceil(math.log2(max(parts, 2)))
    grown = written(bfs(edges, seeds_along(vertices, keys, more)).select("v", "label"))
    size = {r["label"]: r["size"] for r in metrics.sizes(grown, more).collect()}  # one row per part
    cut = {(r["a"], r["b"]): r["cut"] for r in metrics.pair_cuts(edges, grown).collect()}  # at most a row per pair of parts
    to = {k: k for k in size}
    ideal = sum(size.values()) / parts
    for _ in range(more - parts):
        order = sorted(cut, key=lambda p: (-cut[p], p))
        pick = next((p for p in order if size[p[0]] + size[p[1]] < 2 * ideal), order[0] if order else None)
        if pick is None:
            break
        a, b = pick
        to = {k: a if v == b else v for k, v in to.items()}
        size[a] += size.pop(b)
        joined: dict[tuple[int, int], int] = {}
        for (x, y), k in cut.items():
            x, y = (a if x == b else x), (a if y == b else y)
            if x != y:
                joined[min(x, y), max(x, y)] = joined.get((min(x, y), max(x, y)), 0) + k
        cut = joined
    dense = {old: i for i, old in enumerate(sorted(set(to.values())))}
    return relabelled(grown, {k: dense[v] for k, v in to.items()})


def drop_worst(vertices: DataFrame, edges: DataFrame, keys: list[str], parts: int, factor: int = 5) -> DataFrame:
    """Grow ``factor`` * p parts, drop all but the p with the least cut per vertex, and grow from those seeds again."""
    many = parts * factor
    seeds = written(seeds_along(vertices, keys, many))
    grown = written(bfs(edges, seeds).select("v", "label"))
    rows = metrics.loads_and_sends(edges, grown, many).collect()  # one row per part
    kept = sorted(sorted(rows, key=lambda r: (r["sends"] / max(r["load"], 1), r["label"]))[:parts], key=lambda r: r["label"])
    dense = {r["label"]: i for i, r in enumerate(kept)}
    return bfs(edges, relabelled(seeds, dense))


def downsample_seeds(vertices: DataFrame, edges: DataFrame, keys: list[str], parts: int, factor: int = 2) -> DataFrame:
    """(v, label): from ``factor`` * p seeds, the first of the closest pair is dropped again and again until p remain.

    Pairs are those whose regions touch; if none is left, the lowest labels stay."""
    seeds = stride_samples(vertices, keys, parts * factor).select("v", F.col("position").alias("label"))
    state = written(bfs(edges, seeds))
    pairs = seed_distances(edges, state).collect()  # neighbouring seeds only
    alive = {r["label"] for r in seeds.collect()}
    for r in sorted(pairs, key=lambda r: (r["distance"], r["a"], r["b"])):
        if len(alive) <= parts:
            break
        if r["a"] in alive and r["b"] in alive:
            alive.discard(r["a"])
    dense = {k: i for i, k in enumerate(sorted(alive)[:parts])}
    return relabelled(seeds, dense)


def seed_distances(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(a, b, distance): least dist(u) + dist(v) over the cut edges of each pair of labels."""
    s = state.select("v", "label", "dist")
    u, v = s.select(F.col("v").alias("u"), F.col("label").alias("lu"), F.col("dist").alias("du")), s.select("v", F.col("label").alias("lv"), F.col("dist").alias("dv"))
    both = edges.join(u, "u").join(v, "v").where("lu <> lv")
    return both.groupBy(F.least("lu", "lv").alias("a"), F.greatest("lu", "lv").alias("b")).agg(F.min(F.col("du") + F.col("dv")).cast("long").alias("distance"))


def layer_sizes(state: DataFrame) -> DataFrame:
    """(label, dist, n, total): vertices per layer and their running sum."""
    layers = state.groupBy("label", "dist").agg(F.count(F.lit(1)).alias("n"))
    return layers.withColumn("total", F.sum("n").over(W.partitionBy("label").orderBy("dist")))


def rebalance(edges: DataFrame, labels: DataFrame, parts: int, rounds: int = 5) -> DataFrame:
    """Boundary vertices of large parts move to their smallest neighbouring part.

    Synchronous: of a part's candidates, those whose hash falls below the share
    that its excess makes of them move, so that it isn't emptied in one round."""
    now = labels.select("v", "label")
    for k in range(rounds):
        now = written(now)
        sizes = metrics.sizes(now, parts)
        ls, ld = sizes.select(F.col("label").alias("ls"), F.col("size").alias("ss")), sizes.select(F.col("label").alias("ld"), F.col("size").alias("sd"))
        arcs = labelled_arcs(edges, now).where("ls <> ld").join(F.broadcast(ls), "ls").join(F.broadcast(ld), "ld").where("ss > sd + 1")
        best = arcs.groupBy("src", "ls", "ss").agg(F.min(F.struct("sd", "ld")).alias("m"))
        wanted = best.groupBy("ls").agg(F.count(F.lit(1)).alias("k"))
        share = (F.col("ss") - F.col("m.sd")) / (2 * F.col("k"))
        moved = best.join(wanted, "ls").where(F.pmod(F.xxhash64(F.lit(k), F.col("src")), F.lit(1000)) < share * 1000).select(F.col("src").alias("v"), F.col("m.ld").alias("new"))
        now = now.join(moved, "v", "left").select("v", F.coalesce("new", "label").alias("label"))
    return written(now)


def label_propagation(vertices: DataFrame, edges: DataFrame, parts: int, keys: list[str], rounds: int = 4) -> DataFrame:
    """Curve blocks, smoothed by majority moves and balanced, without levels."""
    labels = written(block_labels(vertices, keys, parts).select("v", "label"))
    for _ in range(rounds):
        votes = labelled_arcs(edges, labels).groupBy("src", "ls", "ld").agg(F.count(F.lit(1)).alias("k"))
        best = votes.groupBy("src", "ls").agg(F.max(F.struct(F.col("k"), (F.col("ld") == F.col("ls")).cast("int").alias("stay"), (-F.col("ld")).alias("low"))).alias("m"))
        labels = written(labels.join(best.select(F.col("src").alias("v"), (-F.col("m.low")).alias("new")), "v", "left").select("v", F.coalesce("new", "label").alias("label")))
    return rebalance(edges, labels, parts, 2)


def nearest(reach: DataFrame, alive: set[int]) -> DataFrame:
    """(v, label): the nearest seed among ``alive`` (a label per part), the lower label on ties."""
    kept = reach.where(F.col("label").isin(sorted(alive)))
    return kept.groupBy("v").agg(F.min(F.struct("dist", "label")).alias("m")).select("v", "m.label")


def _dense(labels: DataFrame, alive: set[int]) -> DataFrame:
    return relabelled(labels, {k: i for i, k in enumerate(sorted(alive))})


def oversample_nearest(vertices: DataFrame, edges: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Grow p + floor(log2 p) seeds over the whole graph, drop the first of the closest pair until p remain,
    and give every vertex to the nearest that stays."""
    many = parts + int(math.log2(parts))
    seeds = written(seeds_along(vertices, keys, many))
    reach = written(blocks.seed_reach(edges, seeds, 1 << 62))
    other = seeds.select("v", F.col("label").alias("b"))
    pairs = reach.join(F.broadcast(other), "v").where("label < b").select(F.col("label").alias("a"), "b", "dist").collect()  # a row per pair of seeds
    alive = set(range(many))
    for r in sorted(pairs, key=lambda r: (r["dist"], r["a"], r["b"])):
        if len(alive) > parts and r["a"] in alive and r["b"] in alive:
            alive.discard(r["a"])
    return _dense(nearest(reach, alive), alive)


class Owned:
    """Vertices in folders by owner, each with its ordered candidates; an owner's vertices can be handed on without reading the others'."""

    def __init__(self, reach: DataFrame) -> None:
        """``reach``: (v, label, dist) of every seed that reaches a vertex; the nearest one owns it, the lower label on ties."""
        self.spark, self.rounds, self.dead = reach.sparkSession, 0, []
        self.root = new_path(self.spark, "owned")
        self.folders: dict[int, list[str]] = {}
        self.sizes: dict[int, int] = {}
        near = F.transform(F.array_sort(F.collect_list(F.struct("dist", "label"))), lambda x: x["label"])  # the seeds that reach a vertex
        self._file(reach.groupBy("v").agg(near.alias("candidates")).withColumn("owner", F.get("candidates", F.lit(0))))

    def _file(self, rows: DataFrame) -> None:
        path = f"{self.root}/{self.rounds}"
        self.rounds += 1
        rows.write.partitionBy("owner").parquet(path)
        placed = self.spark.read.schema("v long, candidates array<long>, owner long").parquet(path)
        for r in placed.groupBy("owner").count().collect():  # a row per part
            self.sizes[r["owner"]] = self.sizes.get(r["owner"], 0) + r["count"]
            self.folders.setdefault(r["owner"], []).append(f"{path}/owner={r['owner']}")

    def of(self, owner: int) -> DataFrame:
        return self.spark.read.schema("v long, candidates array<long>").parquet(*self.folders[owner])

    def drop(self, owner: int) -> None:
        """Hands an owner's vertices to their next candidates that are still there; those without one are left out (owner -1)."""
        self.dead.append(owner)
        if self.sizes.pop(owner, 0):
            gone = F.array(*[F.lit(x).cast("long") for x in self.dead])
            rest = F.filter("candidates", lambda x: ~F.array_contains(gone, x))
            self._file(self.of(owner).withColumn("candidates", rest).withColumn("owner", F.coalesce(F.get("candidates", F.lit(0)), F.lit(-1).cast("long"))))
            self.folders.pop(owner)
            self.sizes.pop(-1, None)

    def labels(self, alive: set[int]) -> DataFrame:
        """(v, label) of the vertices that have an owner."""
        out = None
        for k in sorted(alive & set(self.folders)):
            mine = self.of(k).select("v", F.lit(k).cast("long").alias("label"))
            out = mine if out is None else out.union(mine)
        return out


def oversample_drop_smallest(vertices: DataFrame, edges: DataFrame, keys: list[str], parts: int, factor: int = 10) -> DataFrame:
    """From ``factor`` * p seeds the smallest part is deleted again and again; its vertices go to the next nearest seed.

    Seeds grow until each has 3 * (n div p) vertices, further if one of the vertices wasn't
    reached.  A deletion reads and writes the deleted part's vertices alone, and the smallest
    part has at most its share of them."""
    n = vertices.count()
    seeds = written(seeds_along(vertices, keys, parts * factor))
    owned = Owned(blocks.seed_reach(edges, seeds, 3 * (n // parts)).withColumn("label", F.col("label").cast("long")))
    alive = set(range(parts * factor))
    while len(alive) > parts:
        smallest = min(alive, key=lambda k: (owned.sizes.get(k, 0), k))
        alive.discard(smallest)
        owned.drop(smallest)
    return rounds.fill(vertices, edges, written(_dense(owned.labels(alive), alive)))


def oversample_drop_high_cut(vertices: DataFrame, edges: DataFrame, keys: list[str], parts: int, factor: int = 2) -> DataFrame:
    """From ``factor`` * p seeds the part with the greatest |z(size)| + z(cut) is deleted again and again."""
    many = parts * factor
    seeds = written(seeds_along(vertices, keys, many))
    reach = written(blocks.seed_reach(edges, seeds, 1 << 62))
    alive = set(range(many))
    while len(alive) > parts:
        rows = metrics.loads_and_sends(edges, written(nearest(reach, alive)), many).collect()  # a row per part
        size, cut = ({r["label"]: z for r, z in zip(rows, _standard([r[c] for r in rows]), strict=True)} for c in ("load", "sends"))
        alive.discard(max(alive, key=lambda k: (round(abs(size[k]) + cut[k], 9), -k)))
    return _dense(nearest(reach, alive), alive)


def _standard(values: list[int]) -> list[float]:
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((x - mean) ** 2 for x in values) / max(len(values) - 1, 1))
    return [(x - mean) / spread if spread else 0.0 for x in values]


#: Partitioners by name: (vertices, edges, keys, parts) -> (v, label).
REGISTRY: dict[str, Callable[[DataFrame, DataFrame, list[str], int], DataFrame]] = {
    "sfc": lambda v, e, k, p: block_labels(v, k, p).select("v", "label"),
    "bfs": lambda v, e, k, p: bfs(e, seeds_along(v, k, p)).select("v", "label"),
    "bfs_refined": lambda v, e, k, p: refined(e, written(bfs(e, seeds_along(v, k, p))), p).select("v", "label"),
    "pagerank": lambda v, e, k, p: rounds.pagerank_labels(v, e, seeds_along(v, k, p)).select("v", "label"),
    "two_pass": lambda v, e, k, p: two_pass(e, seeds_along(v, k, p), p).select("v", "label"),
    "size_proxy": lambda v, e, k, p: rounds.fill(v, e, growth.size_proxy(e, seeds_along(v, k, p), v.count(), p)),
    "stop_when_ideal": lambda v, e, k, p: rounds.stop_when_ideal(v, e, seeds_along(v, k, p), p),
    "bidding": lambda v, e, k, p: growth.bidding(e, block_labels(v, k, p)),
    "merge_pairs": merge_pairs,
    "drop_worst": lambda v, e, k, p: drop_worst(v, e, k, p).select("v", "label"),
    "pagerank_covered": lambda v, e, k, p: rounds.pagerank_labels(v, e, seeds_along(v, k, p), 1e8, 1.2, 5).select("v", "label"),
    "stretch": lambda v, e, k, p: rounds.stretch_growth(e, seeds_along(v, k, p)).select("v", "label"),
    "stretch_cut": lambda v, e, k, p: rounds.cut_growth(e, seeds_along(v, k, p)).select("v", "label"),
    "capped_fill": lambda v, e, k, p: rounds.fill(v, e, growth.size_proxy(e, seeds_along(v, k, p), v.count(), p, 5, v.count() // p)),
    "ordered": lambda v, e, k, p: rounds.stealing_growth(e, seeds_along(v, k, p), "ordered").select("v", "label"),
    "noised": lambda v, e, k, p: rounds.stealing_growth(e, seeds_along(v, k, p), "noised").select("v", "label"),
    "oversample_nearest": oversample_nearest,
    "oversample_drop_smallest": oversample_drop_smallest,
    "oversample_drop_high_cut": oversample_drop_high_cut,
    "multilevel": lambda v, e, k, p: multilevel.multilevel(v, e, k, p),
    "label_propagation": lambda v, e, k, p: rounds.label_propagation(v, e, p, k),
}
