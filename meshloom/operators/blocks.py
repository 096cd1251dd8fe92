"""Growth over blocks of vertices: a block is relaxed to rest in one task, and only its border is exchanged.

Vertices are dealt to blocks along an order, so that few arcs leave a block.  A block
holds its arcs in compressed rows inside one table row.  What other blocks have offered
to it are messages to its border vertices; all that happens inside a block follows from
its seeds and its messages.  A round therefore recomputes only blocks that got messages in
the last one, and writes only offers of vertices that these messages improved.  Rounds
follow the number of blocks that shortest paths cross, not the number of hops.

Along the vertices' names a block is a range of names, so that it is looked up in the list
of the ranges' ends and no arc is joined to anything.  Edges and messages travel as packed
columns, a row for each block that a task sends to.

Defined results: seeds outside the graph are kept as they are; a vertex that no seed
reaches is absent; of several labels at the same distance the least wins; an edge to
itself or a repeated one changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .iterate import Layers, symmetric, written
from .iterate import connected_components as hop_components
from .ordering import weighted_blocks
from .skew import looked_up

PACKED = "block long, vertices binary, offsets binary, heads binary, out_place binary, out_head binary, out_block binary"
BODY = pa.schema([("block", pa.int64()), ("body", pa.binary())])
STATE = "v long, label long, dist long"
_STATE = pa.schema([("v", pa.int64()), ("label", pa.int64()), ("dist", pa.int64())])
ARCS_PER_BLOCK, LEAST_ARCS = 1 << 21, 1 << 17
_FAR = np.int64(1 << 62)
_NEVER = 1 << 40  # a limit that no distance reaches
FIRST_LIMIT = 16  # of growth until labels have enough, doubled until they do
_HELD = 1 << 18  # rows that a task collects before it packs them


def block_count(edges: DataFrame) -> int:
    """Blocks of at most ``ARCS_PER_BLOCK`` arcs on average, and enough of them for all tasks if they get ``LEAST_ARCS`` each."""
    parts, arcs = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * edges.count()
    return max(-(-arcs // ARCS_PER_BLOCK), min(parts, -(-arcs // LEAST_ARCS)), 1)


def vertex_blocks(edges: DataFrame, order: list[str] | None = None, positions: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """(v, block): blocks of about equal numbers of arcs along the vertices' names, or along ``order``, columns of ``positions`` (v, ...).

    A vertex is never split."""
    degrees = symmetric(edges).groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    if positions is not None:
        degrees = degrees.join(positions, "v")
    return weighted_blocks(degrees, order or ["v"], F.col("degree"), blocks or block_count(edges)).select("v", F.col("label").alias("block"))


def name_ranges(edges: DataFrame) -> np.ndarray:
    """Ascending first names of all blocks but the lowest, which hold about equal numbers of arcs."""
    blocks = block_count(edges)
    if blocks == 1:
        return np.zeros(0, np.int64)
    ends = edges.select(F.explode(F.array("u", "v")).alias("x"))
    cuts = ends.agg(F.percentile_approx("x", [k / blocks for k in range(1, blocks)], F.lit(max(10_000, 50 * blocks)))).first()[0]  # a name per block
    return np.unique(np.array(cuts or [], np.int64))


def _bodies(block: np.ndarray, columns: np.ndarray) -> pa.RecordBatch:
    """(block, body): ``columns`` (a row per column) cut by block."""
    order = np.argsort(block, kind="stable")
    names, first = np.unique(block[order], return_index=True)
    cut = np.split(columns[:, order], first[1:], axis=1) if len(names) else []
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary())], schema=BODY)


def _columns(table: pa.Table, width: int) -> np.ndarray:
    """The rows of bodies as one array, a row per column."""
    rows = [np.frombuffer(x.as_buffer(), np.int64).reshape(width, -1) for x in table.column("body")]
    return np.concatenate(rows, axis=1) if rows else np.zeros((width, 0), np.int64)


def _packer(deal: Callable[[np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of long columns (of doubles, their bits) as bodies, packed many rows at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append(np.stack([x.view(np.int64) if pa.types.is_floating(c.type) else x.astype(np.int64) for x, c in zip(columns, batch.columns, strict=True)]))
            rows += batch.num_rows
            if rows >= _HELD:
                yield deal(np.concatenate(held, axis=1))
                held, rows = [], 0
        if rows:
            yield deal(np.concatenate(held, axis=1))

    return pack


def _packed_by(ranges: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    def pack(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        u, v = _columns(table, 2)
        inside = np.searchsorted(ranges, v, "right") == block
        src, dst = np.concatenate([u, v[inside]]), np.concatenate([v, u[inside]])
        return _compressed(block, src, dst, np.searchsorted(ranges, dst, "right"))

    return pack


def _packed_arcs(table: pa.Table) -> pa.Table:
    return _compressed(table.column("block")[0].as_py(), *_columns(table, 3))


def _compressed(block: int, src: np.ndarray, dst: np.ndarray, to: np.ndarray) -> pa.Table:
    """A block's row from its arcs; places of vertices are numbers below their count."""
    vertices, place = np.unique(src, return_inverse=True)
    near, far = np.flatnonzero(to == block), np.flatnonzero(to != block)
    near = near[np.argsort(place[near], kind="stable")]
    offsets = np.append(0, np.cumsum(np.bincount(place[near], minlength=len(vertices))))
    held = [vertices, offsets, np.searchsorted(vertices, dst[near]), place[far], dst[far], to[far]]
    kinds = [np.int64, np.int32, np.int32, np.int32, np.int64, np.int64]
    names = [c.split()[0] for c in PACKED.split(", ")]
    return pa.table([pa.array([block], pa.int64()), *[pa.array([np.ascontiguousarray(x, k).tobytes()], pa.binary()) for x, k in zip(held, kinds, strict=True)]], names=names)


def _compressed_arcs(held: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertices, heads' names, offsets) of a block's row: all arcs of its vertices, sorted by tail."""
    get = lambda c, kind: np.frombuffer(held.column(c)[0].as_buffer(), kind)
    vertices, offsets = get("vertices", np.int64), get("offsets", np.int32).astype(np.int64)
    tail = np.concatenate([np.repeat(np.arange(len(vertices)), np.diff(offsets)), get("out_place", np.int32)])
    head = np.concatenate([vertices[get("heads", np.int32)], get("out_head", np.int64)])
    return vertices, head[np.argsort(tail, kind="stable")], np.append(0, np.cumsum(np.bincount(tail, minlength=len(vertices))))


def relaxed(offsets: np.ndarray, heads: np.ndarray, keys: np.ndarray, step: int, fresh: np.ndarray, most: int) -> None:
    """Brings ``keys`` to rest in place, from the vertices ``fresh``: a neighbour's key is at most ``step`` more, unless that exceeds ``most``."""
    while len(fresh):
        size = offsets[fresh + 1] - offsets[fresh]
        at = np.repeat(offsets[fresh] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        offer, to = np.repeat(keys[fresh] + step, size), heads[at]
        better = (offer < keys[to]) & (offer <= most)
        offer, to = offer[better], to[better]
        np.minimum.at(keys, to, offer)
        fresh = np.unique(to)


class _Block:
    """A block with its messages (v, dist, label, and whether they are of the last round)."""

    def __init__(self, held: pa.Table, told: pa.Table, last: int, apart: bool) -> None:
        kinds = {"vertices": np.int64, "offsets": np.int32, "heads": np.int32, "out_place": np.int32, "out_head": np.int64, "out_block": np.int64}
        empty = np.zeros(0, np.int64)
        for c, kind in kinds.items():
            setattr(self, c, np.frombuffer(held.column(c)[0].as_buffer(), kind) if held.num_rows else empty)
        self.offsets = self.offsets.astype(np.int64)
        rounds = told.column("round").to_numpy()
        sizes = np.array([len(x.as_buffer()) // 24 for x in told.column("body")], np.int64)
        self.v, self.dist, self.label = _columns(told, 3)
        self.fresh = np.repeat(rounds == last, sizes)
        self.apart = apart
        if len(self.vertices):
            self.place = np.minimum(np.searchsorted(self.vertices, self.v), len(self.vertices) - 1)
            self.known = self.vertices[self.place] == self.v
        else:
            self.place, self.known = np.zeros(len(self.v), np.int64), np.zeros(len(self.v), bool)

    def states(self, before: Callable[[int], int], now: Callable[[int], int]) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, int, int]]:
        """(labels, step, keys before the last round's messages, keys now, greatest keys then and now); apart: of every label in turn.

        A key is distance * step + the label's rank."""
        labels, rank = np.unique(self.label[self.known], return_inverse=True)
        v, dist, fresh = self.place[self.known], self.dist[self.known], self.fresh[self.known]
        for k in range(len(labels)) if self.apart else range(min(1, len(labels))):
            mine = np.flatnonzero(rank == k) if self.apart else np.arange(len(v))
            step, own = (1, labels[k : k + 1]) if self.apart else (len(labels), labels)
            key = dist[mine] * step + (0 if self.apart else rank[mine])
            was, most = before(int(own[0])), now(int(own[0]))
            old, keys = ~fresh[mine], np.full(len(self.vertices), _FAR)
            np.minimum.at(keys, v[mine][old], key[old])
            relaxed(self.offsets, self.heads, keys, step, np.flatnonzero(keys < _FAR), (was + 1) * step - 1)
            then = keys.copy()
            np.minimum.at(keys, v[mine][~old], key[~old])
            start = keys < then if was == most else keys < _FAR
            relaxed(self.offsets, self.heads, keys, step, np.flatnonzero(start), (most + 1) * step - 1)
            yield own, step, then, keys, (was + 1) * step - 1, (most + 1) * step - 1

    def strangers(self) -> np.ndarray:
        """(v, label, dist), a row per column, of messages to vertices without arcs: the least of each (and of each label, apart)."""
        lost = ~self.known
        v, label, dist = self.v[lost], self.label[lost], self.dist[lost]
        order = np.lexsort((dist, label, v) if self.apart else (label, dist, v))
        rows = np.stack([v, label, dist])[:, order]
        same = (rows[0, 1:] == rows[0, :-1]) & ((rows[1, 1:] == rows[1, :-1]) | (not self.apart))
        return rows[:, np.append(True, ~same)[: rows.shape[1]]]


class Dealt:
    """A graph in blocks; ``grow`` may be called any number of times."""

    def __init__(self, held: DataFrame, ranges: np.ndarray | None, blocks: DataFrame | None) -> None:
        self.held, self.ranges, self.blocks = held, ranges, blocks
        self.spark = held.sparkSession

    def _messages(self, state: DataFrame) -> DataFrame:
        """(block, body) of (v, label, dist); what lies in no block goes to one that no vertex has, or is out of its block's graph."""
        rows = state.select(F.col("v").cast("long").alias("v"), F.col("dist").cast("long").alias("dist"), F.col("label").cast("long").alias("label"))
        if self.blocks is None:
            ranges = self.ranges
            return rows.mapInArrow(_packer(lambda x: _bodies(np.searchsorted(ranges, x[0], "right"), x)), "block long, body binary")
        rows = rows.join(self.blocks, "v", "left").select(F.coalesce("block", F.lit(-1)).cast("long").alias("block"), "v", "dist", "label")
        return rows.mapInArrow(_packer(lambda x: _bodies(x[0], x[1:])), "block long, body binary")

    def grow(self, state: DataFrame, apart: bool = False, limit: int | dict[int, int] | None = None, enough: int | None = None) -> DataFrame:
        """(v, label, dist): the least (dist, label) that a vertex gets if neighbours are a hop of 1 apart, from ``state`` (v, label, dist).

        ``apart``: the least distance of every label instead.  ``limit``: no vertex is reached at more than
        that distance, which may be given by label with ``apart``.  ``enough``: growth apart ends with the first distance
        within which every label has that many vertices, if there is one."""
        layers, steps = Layers(self.spark, "messages"), 0
        new = layers.add(self._messages(state))
        reach = lambda x: (lambda label: x.get(label, -1)) if isinstance(x, dict) else (lambda label: _NEVER if x is None else x)
        most = FIRST_LIMIT if enough is not None else limit
        total = 0
        while True:
            while layers.rows:
                steps += 1
                new = layers.add(self._offers(new.select("block").distinct(), layers, apart, reach(most), reach(most)))
            if enough is None:
                break
            sizes = self._sizes(layers, reach(most), enough).collect()  # a row per label
            reached, far = sum(r["n"] for r in sizes), max((_NEVER if r["far"] is None else r["far"] for r in sizes), default=0)
            if far <= most or reached == total:  # all have enough, or there is no more
                most = min(far, most)
                break
            most, total = 2 * most, reached
            new = layers.add(self._offers(None, layers, apart, reach(most // 2), reach(most)))
        return self._rows(layers, apart, reach(most), f"grown-{steps}-rounds")

    def _offers(self, active: DataFrame | None, layers: Layers, apart: bool, was: Callable[[int], int], most: Callable[[int], int]) -> DataFrame:
        last = layers.rounds - 1

        def border(held: pa.Table, told: pa.Table) -> pa.Table:
            """Offers of a block to vertices of others, the least one to each."""
            if not (held.num_rows and told.num_rows):
                return BODY.empty_table()
            block, out = _Block(held, told, last, apart), []
            for labels, step, then, keys, low, high in block.states(was, most):
                key = keys[block.out_place]
                offer = np.where(key < _FAR, key + step, _FAR)
                send = np.flatnonzero((offer <= high) & ((key < then[block.out_place]) | (offer > low)))
                order = send[np.lexsort((offer[send], block.out_head[send]))]
                head = block.out_head[order]
                first = order[np.append(True, head[1:] != head[:-1])[: len(order)]]
                out.append(np.stack([block.out_block[first], block.out_head[first], offer[first] // step, labels[offer[first] % step]]))
            if not sum(x.shape[1] for x in out):
                return BODY.empty_table()
            every = np.concatenate(out, axis=1)
            return pa.Table.from_batches([_bodies(every[0], every[1:])])

        now, told = self.held, layers.table()
        if active is not None:
            now, told = (x.join(F.broadcast(active), "block", "left_semi") for x in (now, told))  # active: a row per block at most
        return now.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(border, "block long, body binary")

    def _sizes(self, layers: Layers, most: Callable[[int], int], enough: int) -> DataFrame:
        """(label, n, far): the vertices that a label has reached, and the first distance within which it has ``enough``, or null."""

        def counted(held: pa.Table, told: pa.Table) -> pa.Table:
            out = []
            if told.num_rows:
                block = _Block(held, told, -1, True)
                for labels, _, _, keys, _, high in block.states(most, most):
                    dist, n = np.unique(keys[keys <= high], return_counts=True)
                    out.append(np.stack([np.full(len(n), labels[0]), dist, n]))
                lost = block.strangers()
                out.append(np.stack([lost[1], lost[2], np.ones(lost.shape[1], np.int64)]))
            return pa.table(list(np.concatenate([np.zeros((3, 0), np.int64), *out], axis=1)), names=["label", "dist", "n"])

        rows = self.held.groupBy("block").cogroup(layers.table().groupBy("block")).applyInArrow(counted, "label long, dist long, n long")
        layer = rows.groupBy("label", "dist").agg(F.sum("n").alias("n"))
        within = layer.withColumn("within", F.sum("n").over(W.partitionBy("label").orderBy("dist")))  # a row per layer
        return within.groupBy("label").agg(F.sum("n").alias("n"), F.min(F.when(F.col("within") >= enough, F.col("dist"))).alias("far"))

    def _rows(self, layers: Layers, apart: bool, most: Callable[[int], int], name: str) -> DataFrame:
        def reached(held: pa.Table, told: pa.Table) -> pa.Table:
            """(v, label, dist) of the block's reached vertices; those without arcs as they came."""
            if not told.num_rows:
                return _STATE.empty_table()
            block, out = _Block(held, told, -1, apart), []
            for labels, step, _, keys, _, high in block.states(most, most):
                got = np.flatnonzero(keys <= high)
                out.append(np.stack([block.vertices[got], labels[keys[got] % step], keys[got] // step]))
            every = np.concatenate([*out, block.strangers()], axis=1)
            return pa.table(list(every), schema=_STATE)

        return written(self.held.groupBy("block").cogroup(layers.table().groupBy("block")).applyInArrow(reached, STATE), name)


@contextmanager
def dealt(edges: DataFrame, blocks: DataFrame | None = None) -> Iterator[Dealt]:
    """``edges`` (u, v) in blocks that the executors keep; ``blocks``: (v, block), see ``vertex_blocks``, else ranges of names."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = None
    if blocks is None:
        ranges = name_ranges(edges)

        def deal(ends: np.ndarray) -> pa.RecordBatch:
            """Edges to the block of either end; that end comes first."""
            a, b = np.searchsorted(ranges, ends, "right")
            across = a != b
            return _bodies(np.concatenate([a, b[across]]), np.concatenate([ends, ends[::-1, across]], axis=1))

        sent = edges.where("u <> v").select("u", "v").mapInArrow(_packer(deal), "block long, body binary")
        packed = sent.groupBy("block").applyInArrow(_packed_by(ranges), PACKED)
    else:
        blocks = written(blocks, "vertex-blocks")
        of = lambda c, out: blocks.select(F.col("v").alias(c), F.col("block").alias(out))
        arcs = symmetric(edges).where("src <> dst").join(of("src", "block"), "src").join(of("dst", "to"), "dst").select("block", "src", "dst", "to")
        sent = arcs.mapInArrow(_packer(lambda x: _bodies(x[0], x[1:])), "block long, body binary")
        packed = sent.groupBy("block").applyInArrow(_packed_arcs, PACKED)
    held = packed.repartition(parts, "block").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield Dealt(held, ranges, blocks)
    finally:
        held.unpersist()


def bfs(edges: DataFrame, seeds: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(v, label, dist): the lexicographic minimum of (distance, label) over the seeds (v, label), as ``iterate.bfs`` finds it hop by hop.

    ``blocks``: (v, block), see ``vertex_blocks``."""
    with dealt(edges, blocks) as held:
        return held.grow(seeds.select("v", "label", F.lit(0).alias("dist")))


def relax(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(v, label, dist) after relaxation to rest with hops of 1, as ``iterate.relax`` finds it hop by hop; types are those of ``state``."""
    with dealt(edges) as held:
        return _typed(held.grow(state), state, "dist")


def seed_reach(edges: DataFrame, seeds: DataFrame, enough: int) -> DataFrame:
    """(v, label, dist) of every seed separately, until each has reached ``enough`` vertices or all it can.

    All seeds grow on until the slowest has enough, so the result holds up to vertices times seeds rows."""
    every = enough > 2 * edges.count() + seeds.count()  # more than there are
    with dealt(edges) as held:
        return _typed(held.grow(seeds.select("v", "label", F.lit(0).alias("dist")), apart=True, enough=None if every else enough), seeds)


def distances(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``bfs`` with the types of ``seeds`` and whole distances."""
    return _typed(bfs(edges, seeds), seeds)


def _typed(grown: DataFrame, like: DataFrame, *more: str) -> DataFrame:
    kind = {c: like.schema[c].dataType for c in ("v", "label", *more)}
    return grown.select(*[F.col(c).cast(kind.get(c, "int")).alias(c) for c in ("v", "label", "dist")])


def _least(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least vertex of each vertex's component: roots are hung under lesser ones and paths halved, on arcs that still join two."""
    root = np.arange(n)
    while True:
        a, b = root[src], root[dst]
        apart = a != b
        if not apart.any():
            return root
        src, dst, a, b = src[apart], dst[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component): the least vertex of each component, as ``iterate.connected_components`` finds it hop by hop; vertices of ``vertices`` only.

    A block finds its own components in one task.  Only they and the arcs between blocks are left
    to joins: a graph of border vertices' components, which is as large as the border at most."""
    kind = vertices.schema["v"].dataType
    with dealt(edges.select(*[F.col(c).cast("long").alias(c) for c in "uv"])) as graph:

        def local(held: pa.Table) -> pa.Table:
            """(v, component, heads) of a block's vertices; heads: neighbours in other blocks."""
            get = lambda c, kind: np.frombuffer(held.column(c)[0].as_buffer(), kind)
            v, offsets, out_place = get("vertices", np.int64), get("offsets", np.int32), get("out_place", np.int32)
            n = len(v)
            keys = _least(n, np.repeat(np.arange(n), np.diff(offsets)), get("heads", np.int32))
            order = np.argsort(out_place, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(out_place, minlength=n))).astype(np.int32)
            heads = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(get("out_head", np.int64)[order], pa.int64()))
            return pa.table({"v": pa.array(v, pa.int64()), "component": pa.array(v[keys], pa.int64()), "heads": heads})

        own = written(graph.held.groupBy("block").applyInArrow(local, "v long, component long, heads array<long>"), "block-components")
    border = own.where(F.size("heads") > 0)
    arcs = border.select("component", F.explode("heads").alias("v")).distinct()
    across = arcs.join(border.select("v", F.col("component").alias("other")), "v").where("component < other").select(F.col("component").alias("u"), F.col("other").alias("v")).distinct()
    across = written(across, "component-edges")
    ends = across.select(F.explode(F.array("u", "v")).alias("v")).distinct()
    joined = hop_components(ends, across).select(F.col("v").alias("component"), F.col("component").alias("least"))
    sizes = own.groupBy("component").agg(F.count(F.lit(1)).alias("k")).join(joined, "component", "left").select("component", "k", F.coalesce("least", "component").alias("least"))
    whole = looked_up(own.select("v", "component"), sizes, "component", own.count()).select("v", "least")  # one component may hold all vertices
    return vertices.select("v").join(whole, "v", "left").select("v", F.coalesce("least", "v").cast(kind).alias("component"))
