"""A multilevel partitioner: coarsen by heavy-edge matching, grow parts over the coarsest graph, refine on the way back.

A level is two tables: vertices (v, weight, key) and edges (u, v, weight).  Vertices are
matched when each is the other's best neighbour, so a round needs no locks and its result
doesn't depend on how tables are dealt; merged vertices keep the least key.  On every
level, from the coarsest one on, boundary vertices move to the neighbouring part that
holds most of their edge weight, if that part has room; moves go up in label in one round
and down in the next, so that no pair of vertices swaps for ever.

On large levels a turn of refinement is one shuffle of votes: what a vertex wants is written beside its
label, and moves follow from it and from sums by part.  A coarse graph of at most ``SMALL`` rows is
handled by one task, with the same rules; the graph that was given never is.

Defined results: every vertex gets one label below ``parts``; vertices without edges stay
where the curve puts them; edges to themselves are ignored; the result is the same on
every run.  It claims no parity with an external partitioner."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import distances as bfs
from .blocks import relaxed
from .iterate import held, written
from .ordering import mid_seeds, weighted_blocks

COARSEST = 60  # vertices a part, about
ROOM = 1.1  # of the ideal size
TURNS = 4  # of refinement a level
SMALL = 1 << 20  # vertices and edges of a coarse graph that one task handles, no more than a block of growth holds


def _arcs(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")
    return edges.union(back)


def matched(vertices: DataFrame, edges: DataFrame, heaviest: int, turn: int) -> DataFrame:
    """(v, into): every vertex with the one it becomes, itself or, of a matched pair, the lesser.

    A vertex prefers its heaviest edge, then the lighter neighbour, then by a hash of the
    pair; pairs heavier than ``heaviest`` aren't made, so that parts can still be balanced."""
    weight = lambda c, out: vertices.select(F.col("v").alias(c), F.col("weight").alias(out))
    arcs = _arcs(edges).join(weight("u", "wu"), "u").join(weight("v", "wv"), "v").where(F.col("wu") + F.col("wv") <= heaviest)
    mixed = F.xxhash64(F.lit(turn), F.least("u", "v"), F.greatest("u", "v"))
    best = written(arcs.groupBy("u").agg(F.max(F.struct("weight", (-F.col("wv")).alias("light"), mixed.alias("mixed"), "v")).alias("m")).select("u", F.col("m.v").alias("v")), "choices")
    mutual = best.join(best.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_semi")
    return vertices.select("v").join(mutual.select(F.col("u").alias("v"), F.least("u", "v").alias("into")), "v", "left").select("v", F.coalesce("into", "v").alias("into"))


def contracted(vertices: DataFrame, edges: DataFrame, into: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the next level."""
    to = lambda c, out: into.select(F.col("v").alias(c), F.col("into").alias(out))
    merged = vertices.join(into, "v").groupBy(F.col("into").alias("v")).agg(F.sum("weight").alias("weight"), F.min("key").alias("key"))
    ends = edges.join(to("u", "a"), "u").join(to("v", "b"), "v").where("a <> b")
    fewer = ends.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("weight").alias("weight"))
    return written(merged, "level-vertices"), written(fewer, "level-edges")


def refined(vertices: DataFrame, edges: DataFrame, labels: DataFrame, parts: int, turns: int = TURNS) -> DataFrame:
    """``labels`` after boundary moves that lower the cut or relieve a part that is too large, none of which overfills a part.

    A vertex's row meets the votes of its neighbours, summed by label: a list of them is at most as long as there are parts."""
    shuffled = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = written(vertices.join(labels, "v").select("v", F.col("weight").alias("mass"), "label"), "level-labels")
    with held(_arcs(edges), "u") as arcs:
        for turn in range(turns):
            sizes = {r["label"]: r["size"] for r in now.groupBy("label").agg(F.sum("mass").alias("size")).collect()}  # a row per part
            most = ROOM * sum(sizes.values()) / parts
            size = lambda label: F.get(F.lit([sizes.get(k, 0) for k in range(parts)]), label.cast("int"))
            sent = now.join(arcs, now.v == arcs.u).select(arcs.v.alias("v"), "label", F.col("weight").alias("w"), F.lit(None).cast("long").alias("mass"))
            votes = sent.union(now.select("v", "label", F.lit(0).cast("long"), "mass")).repartition(shuffled, "v").groupBy("v", "label").agg(F.sum("w").alias("w"), F.max("mass").alias("mass"))
            own = F.col("mass").isNotNull()
            each = votes.groupBy("v").agg(
                F.max("mass").alias("mass"), F.max(F.when(own, F.col("label"))).alias("label"), F.max(F.when(own, F.col("w"))).alias("stays"),
                F.collect_list(F.when(~own, F.struct("label", "w"))).alias("others"),
            )
            here = size(F.col("label"))

            def fits(x):
                there, gain = size(x["label"]), x["w"] - F.col("stays")
                worth = (gain > 0) | (gain == 0) & (here > there + F.col("mass")) | (here > most) & (there < here - 2 * F.col("mass"))
                upward = x["label"] > F.col("label") if turn % 2 == 0 else x["label"] < F.col("label")
                return upward & worth & (there + F.col("mass") <= most)

            best = F.array_max(F.transform(F.filter("others", fits), lambda x: F.struct((x["w"] - F.col("stays")).alias("gain"), (-size(x["label"])).alias("room"), (-x["label"]).alias("low"))))
            wishes = written(each.select("v", "mass", "label", (-best["low"]).alias("wish")), "wishes")
            wanted = {r["wish"]: r["mass"] for r in wishes.where("wish is not null").groupBy("wish").agg(F.sum("mass").alias("mass")).collect()}  # a row per part
            share = [min(1.0, (most - sizes.get(k, 0)) / wanted[k]) if k in wanted else 0.0 for k in range(parts)]  # if more want to come than fit, a hash decides
            moves = F.col("wish").isNotNull() & (F.pmod(F.xxhash64(F.lit(turn), "v"), F.lit(1000)) < 900 * F.get(F.lit(share), F.col("wish").cast("int")))
            now = wishes.select("v", "mass", F.when(moves, F.col("wish")).otherwise(F.col("label")).alias("label"))
    return now.select("v", "label")


class _Level:
    """A coarse graph within one task: vertices are numbers, edges a < b with weights."""

    def __init__(self, weight: np.ndarray, rank: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        self.weight, self.rank, self.a, self.b, self.w, self.n = weight, rank, a, b, w, len(weight)
        self.src, self.dst, self.by = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])

    def matched(self, heaviest: int, turn: int) -> np.ndarray:
        """What every vertex becomes, see ``matched``."""
        ok = self.weight[self.src] + self.weight[self.dst] <= heaviest
        src, dst, by = self.src[ok], self.dst[ok], self.by[ok]
        mixed = _mixed(turn, np.minimum(src, dst), np.maximum(src, dst))
        order = np.lexsort((dst, mixed, -self.weight[dst], by, src))
        last = order[np.append(src[order][1:] != src[order][:-1], True)[: len(order)]]
        best = np.full(self.n, -1)
        best[src[last]] = dst[last]
        every = np.arange(self.n)
        mutual = (best >= 0) & (best[best] == every)
        return np.where(mutual, np.minimum(every, best), every)

    def contracted(self, into: np.ndarray) -> tuple[_Level, np.ndarray]:
        """The next level, and the place of every vertex in it."""
        kept, place = np.unique(into, return_inverse=True)
        weight, rank = np.zeros(len(kept), np.int64), np.full(len(kept), self.n * 2)
        np.add.at(weight, place, self.weight)
        np.minimum.at(rank, place, self.rank)
        a, b = np.minimum(place[self.a], place[self.b]), np.maximum(place[self.a], place[self.b])
        apart = a < b
        pairs, at = np.unique(a[apart] * len(kept) + b[apart], return_inverse=True)
        w = np.zeros(len(pairs), np.int64)
        np.add.at(w, at, self.w[apart])
        return _Level(weight, np.argsort(np.argsort(rank)), pairs // max(len(kept), 1), pairs % max(len(kept), 1), w), place

    def grown(self, parts: int) -> np.ndarray:
        """Labels by growth from the middles of blocks along the curve; a vertex that no seed reaches keeps its block's."""
        order = np.argsort(self.rank)
        before = np.cumsum(self.weight[order]) - self.weight[order]
        block = np.zeros(self.n, np.int64)
        block[order] = np.minimum(before * parts // max(int(self.weight.sum()), 1), parts - 1)
        keys = np.full(self.n, 1 << 62)
        for k in range(parts):
            mine = order[block[order] == k]
            if len(mine):
                keys[mine[len(mine) // 2]] = k
        by_tail = np.argsort(self.src, kind="stable")
        offsets = np.append(0, np.cumsum(np.bincount(self.src, minlength=self.n)))
        relaxed(offsets, self.dst[by_tail], keys, parts, np.flatnonzero(keys < 1 << 62), (1 << 62) - 1)
        return np.where(keys < 1 << 62, keys % parts, block)

    def refined(self, label: np.ndarray, parts: int, turns: int) -> np.ndarray:
        """See ``refined``."""
        for turn in range(turns):
            sizes = np.bincount(label, self.weight, parts).astype(np.int64)
            most = ROOM * int(sizes.sum()) / parts
            pair, at = np.unique(self.src * parts + label[self.dst], return_inverse=True)
            w = np.bincount(at, self.by, len(pair)).astype(np.int64)
            u, other = pair // parts, pair % parts
            stays = np.zeros(self.n, np.int64)
            same = other == label[u]
            stays[u[same]] = w[same]
            gain, mass, here, there = w - stays[u], self.weight[u], sizes[label[u]], sizes[other]
            worth = (gain > 0) | (gain == 0) & (here > there + mass) | (here > most) & (there < here - 2 * mass)
            upward = other > label[u] if turn % 2 == 0 else other < label[u]
            ok = np.flatnonzero(upward & worth & (there + mass <= most))
            order = ok[np.lexsort((-other[ok], -there[ok], gain[ok], u[ok]))]
            best = order[np.append(u[order][1:] != u[order][:-1], True)[: len(order)]]
            wanted = np.bincount(other[best], mass[best], parts)
            share = np.minimum(1.0, (most - sizes) / np.maximum(wanted, 1))
            moves = best[_mixed(turn, u[best], u[best]) % 1000 < 900 * share[other[best]]]
            label = label.copy()
            label[u[moves]] = other[moves]
        return label


def _mixed(turn: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a pair, not negative."""
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def _small(vertices: DataFrame, edges: DataFrame, parts: int, heaviest: int, turns: int) -> DataFrame:
    """(v, label) of a coarse graph of at most ``SMALL`` rows: the levels below it, growth and refinement, in one task."""

    def solve(held: pa.Table, told: pa.Table) -> pa.Table:
        held = held.sort_by("v")
        names = held.column("v").to_numpy()
        rank = np.empty(len(names), np.int64)
        rank[held.append_column("_at", pa.array(np.arange(len(names)))).sort_by([("key", "ascending"), ("v", "ascending")]).column("_at").to_numpy()] = np.arange(len(names))
        ends = [np.searchsorted(names, told.column(c).to_numpy()) for c in "uv"] if told.num_rows else [np.zeros(0, np.int64)] * 2
        w = told.column("weight").to_numpy() if told.num_rows else ends[0]
        level, above = _Level(held.column("weight").to_numpy(), rank, np.minimum(*ends), np.maximum(*ends), w), []
        while level.n > COARSEST * parts:
            coarser, place = level.contracted(level.matched(heaviest, len(above)))
            if coarser.n > 0.95 * level.n:
                break
            above.append((level, place))
            level = coarser
        label = level.refined(level.grown(parts), parts, 4 * turns)
        for level, place in reversed(above):
            label = level.refined(label[place], parts, turns)
        return pa.table({"v": pa.array(names, pa.int64()), "label": pa.array(label, pa.int64())})

    one = lambda t: t.withColumn("_all", F.lit(0)).groupBy("_all")
    rows = vertices.select(F.col("v").cast("long").alias("v"), "weight", "key"), edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "weight")
    found = one(rows[0]).cogroup(one(rows[1])).applyInArrow(solve, "v long, label long")
    return written(found.select(F.col("v").cast(vertices.schema["v"].dataType).alias("v"), "label"), "level-labels")


def multilevel(vertices: DataFrame, edges: DataFrame, keys: list[str], parts: int, turns: int = TURNS) -> DataFrame:
    """(v, label) of vertices (v, keys ...); the first key orders the curve along which the coarsest graph's seeds lie."""
    v = written(vertices.select("v", F.lit(1).cast("long").alias("weight"), F.col(keys[0]).alias("key")), "level-vertices")
    e = written(edges.where("u <> v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("weight")), "level-edges")
    n = count = v.count()
    heaviest, levels, rows = max(2, n // (COARSEST * parts) * 2), [], None
    while count > COARSEST * parts and (rows is None or rows > SMALL):
        into = written(matched(v, e, heaviest, len(levels)), "level-map")
        coarser = contracted(v, e, into)
        fewer = coarser[0].count()
        if fewer > 0.95 * count:
            break
        levels.append((v, e, into))
        (v, e), count = coarser, fewer
        rows = count + e.count()
    if rows is not None and rows <= SMALL:
        labels = _small(v, e, parts, heaviest, turns)
    else:
        blocks = written(weighted_blocks(v, ["key", "v"], F.col("weight"), parts).select("v", "label", "key"), "level-blocks")
        grown = bfs(e, mid_seeds(blocks, ["key", "v"]).select("v", "label"))
        lost = blocks.join(grown, "v", "left_anti").select("v", "label")  # no seed reaches them
        labels = refined(v, e, grown.select("v", "label").union(lost), parts, 4 * turns)
    for v, e, into in reversed(levels):
        coarse = labels.select(F.col("v").alias("into"), "label")
        labels = refined(v, e, into.join(coarse, "into").select("v", "label"), parts, turns)
    return labels
