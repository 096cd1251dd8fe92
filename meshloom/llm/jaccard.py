"""N-gram Jaccard join: exact components of texts whose shingle sets overlap enough.

Two sets with Jaccard similarity t or more differ in at most
``(1 - t) / (1 + t) * (|x| + |y|)`` elements.  Sizes are covered by windows such
that any pair that can link shares one; in a window the hash space is cut into
more ranges than a pair can differ in, so two linked sets agree entirely on some
range.  The sum of a range's hashes is therefore a key that linked sets share and
that a passage, however common, hardly ever produces on its own.  Sets that share
keys form blocks, and every block is joined by signature trees
(``signature_tree``).  Nothing is sampled: no linked pair is lost.

The sets of a key are compared by sketches first.  A sketch is a bitmap of a
quarter of the hash space; bits that one set has alone bound its difference from
below, so no pair that links is ruled out.  A key's sets are first held against
one of them: those that may link to it need no pairs among themselves.

No task holds a whole hot group.  A key that very many sets of one task share
makes one block of them without comparison, and only one of them is posted, marked:
whatever else holds that key joins the block.  The other keys' groups beyond ``GROUP`` sets are dealt in pieces around a common
pivot; sets far from it meet every piece.  A block too large for one task is dealt
in chunks: chunks are joined in themselves, then through representatives (in
chunks again while these are many), and what is still apart from a block's largest
component meets every chunk.  Blocks are only ever made too large, never too small.

Defined results: null, empty and wordless texts have no shingles and are their
own component; fewer than ``width`` words make one shingle; equal sets are one
class, whatever their texts; rows that repeat a doc_id, or have none, are linked
like any other rows; a component without any doc_id has a null component_id; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators.skew import looked_up

from .bloom import possible as maybe
from .components import components
from .signature_tree import Forest, cross_join, self_join
from .storage import materialize
from .textops import U, mixed, released, slices, text_buffer, words

WIDTH, PERCENT = 5, 80
CHUNK = 4096
WEIGHT = 1 << 22  # elements of a chunk
GROUP = 2048
SHARED = 256  # sets of one run of postings that make a key a block
POSTINGS = 1 << 20
REPRESENTATIVES = 8
SKETCH_BITS = 1 << 15
_ODD = mixed(np.arange(11, 11 + 64, dtype=U)) | U(1)


def shingle_sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, at = text_buffer(batch.column(batch.schema.get_field_index("text")))
    _, _, h, offsets = words(data, at)
    n = max(0, len(h) - width + 1)
    rolled = np.zeros(n, U)
    for k in range(width):
        rolled += h[k : k + n] * _ODD[k]
    rolled = mixed(rolled)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            yield mixed((h[a:b] * _ODD[: b - a]).sum(dtype=U, keepdims=True) + _ODD[32 + b - a : 33 + b - a])
        else:
            yield np.zeros(0, U)


class Windows:
    """Size windows and their numbers of ranges; made on demand as sizes grow."""

    def __init__(self, percent: int) -> None:
        self.percent, self.low, self.high, self.ranges, self.slack, self.bounds = percent, [1], [], [], [], []

    def _grow(self) -> None:
        low = self.low[-1]
        following = max(low + 1, low * 3 // 2)
        high = 100 * (following - 1) // self.percent
        differ = (100 - self.percent) * (following - 1 + high) // (100 + self.percent)
        slack = 0
        while differ:
            m = differ + 1 + slack
            empty = m * np.exp(-low / m)
            if slack >= empty + 3 * np.sqrt(empty) or slack > 2 * differ:
                break
            slack += max(1, differ // 64)
        m = differ + 1 + slack
        self.low.append(following)
        self.high.append(high)
        self.ranges.append(m)
        self.slack.append(slack)
        self.bounds.append(np.array([(j << 64) // m for j in range(1, m)], dtype=U))

    def of(self, n: int) -> list[int]:
        while self.low[-1] <= n:
            self._grow()
        k = int(np.searchsorted(self.low, n, "right")) - 1
        return [j for j in range(max(0, k - 3), k + 1) if n <= self.high[j]]


def set_keys(own: np.ndarray, windows: Windows) -> np.ndarray:
    """Keys of which any linked set shares at least one."""
    total = np.zeros(len(own) + 1, U)
    np.cumsum(mixed(own + _ODD[60]), out=total[1:])
    keys = []
    for k in windows.of(len(own)):
        cut = np.concatenate(([0], np.searchsorted(own, windows.bounds[k]), [len(own)]))
        full = np.flatnonzero(cut[1:] > cut[:-1])
        sums = total[cut[full + 1]] - total[cut[full]]
        keys.append(mixed(sums + (full.astype(U) + U(1)) * _ODD[61] + _ODD[62:63] * U(k + 1)))
        if windows.ranges[k] - len(full) > windows.slack[k]:  # the shared range may be an empty one: a prefix instead
            prefix = len(own) - -(-windows.percent * len(own) // 100) + 1
            keys.append(mixed(own[:prefix] + _ODD[63:] * U(k + 1)))
    return np.concatenate(keys)


def signature(own: np.ndarray) -> int:
    """63 bits that name a set; -1 for the empty one."""
    if not len(own):
        return -1
    total = mixed(own).sum(dtype=U, keepdims=True) + _ODD[59:60] * U(len(own))
    return int(mixed(total)[0] >> U(1))


def sketch(own: np.ndarray) -> bytes:
    """A bitmap of the quarter of the elements whose hash is lowest in the hash space, of bounded length."""
    bits = min(SKETCH_BITS, max(64, 1 << (max(1, 3 * len(own) // 4) - 1).bit_length()))
    on = own[: np.searchsorted(own, U(1 << 62))] & U(bits - 1)
    flags = np.zeros(bits, np.uint8)
    flags[on.astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _folded(maps: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, the longer ones folded to the shortest."""
    least = min(len(m) for m in maps) // 8
    out = np.empty((len(maps), least), U)
    for i, m in enumerate(maps):
        row = np.frombuffer(m, U)
        while len(row) > least:
            row = row[: len(row) // 2] | row[len(row) // 2 :]
        out[i] = row
    return out


def possible(na: np.ndarray, ma: np.ndarray, nb: np.ndarray, mb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes na, nb with sketches ma, mb may be similar enough; never False for those that are.

    A bit that only one set has stands for an element that the other lacks."""
    need = -(-percent * (na + nb) // (100 + percent))
    return (np.bitwise_count(ma & ~mb).sum(-1, dtype=np.int64) <= na - need) & (np.bitwise_count(mb & ~ma).sum(-1, dtype=np.int64) <= nb - need)


def _group_edges(n: np.ndarray, maps: np.ndarray, percent: int, pivot: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the possible pairs of one group, and the sets that can't link to the pivot."""
    forest = Forest(len(n))
    near = possible(n[pivot], maps[pivot], n, maps, percent)
    near[pivot] = True
    for i in np.flatnonzero(near).tolist():
        forest.join(pivot, i)
    far = np.flatnonzero(~near)
    for i in far.tolist():  # the pivot's component needs no pairs of its own
        for j in np.flatnonzero(possible(n[i], maps[i], n, maps, percent)).tolist():
            forest.join(i, j)
    return [(i, r) for i, r in enumerate(forest.roots().tolist()) if i != r], far


def _pack(keys: np.ndarray, sigs: np.ndarray, bits: int) -> bytes:
    """Postings of one bucket: 40 bits of each key beyond the bucket's, and its set by place in a table."""
    table, at = np.unique(sigs, return_inverse=True)
    wide = 4 if len(table) > 1 << 16 else 2
    short = ((keys << U(bits)) >> U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return np.array([len(keys), len(table), wide], np.int64).tobytes() + table.tobytes() + short.tobytes() + at.astype(f"<u{wide}").tobytes()


def _pack_block(sigs: np.ndarray) -> bytes:
    """Sets that are one block without comparison."""
    return np.array([-1, len(sigs), 0], np.int64).tobytes() + sigs.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m, wide = np.frombuffer(blob, np.int64, 3).tolist()
    table = np.frombuffer(blob, np.int64, m, 24)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 24 + 8 * m).reshape(n, 5)
    return keys.view("<u8").reshape(-1), table[np.frombuffer(blob, f"<u{wide}", n, 24 + 8 * m + 5 * n)]


def _describe(width: int):
    """Each row's size, name and sketch beside all its columns but the text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part, width))
                names = np.array([signature(x) for x in sets], np.int64)
                kept = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(np.array([len(x) for x in sets], np.int64)), pa.array(names, mask=names < 0), pa.array([sketch(x) for x in sets], pa.binary())], [*kept, "n", "sig", "sketch"]
                )

    return run


def _shared(k: np.ndarray, s: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted postings in which a key of very many sets keeps one of them, marked (~), and the blocks these sets make."""
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(first, len(k)))
    hot = np.flatnonzero(size > many)
    if not len(hot):
        return k, s, []
    table, at = np.unique(s, return_inverse=True)
    forest, keep = Forest(len(table)), np.ones(len(k), bool)
    for h in hot.tolist():
        one, *others = at[first[h] : first[h] + size[h]].tolist()
        for x in others:
            forest.join(one, x)
        keep[first[h] + 1 : first[h] + size[h]] = False
    roots = forest.roots()
    s = s.copy()
    s[first[hot]] = ~table[roots[at[first[hot]]]]
    order = np.argsort(roots, kind="stable")
    cuts = np.flatnonzero(np.append(True, roots[order][1:] != roots[order][:-1]))
    return k[keep], s[keep], [table[x] for x in np.split(order, cuts[1:]) if len(x) > 1]


def _post(bits: int, width: int, percent: int, shared: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, keys, sigs, held, seen = Windows(percent), [], [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            k, s = np.concatenate(keys), np.concatenate(sigs)
            order = np.argsort(k, kind="stable")
            k, s, blocks = _shared(k[order], s[order], shared)
            for block in blocks:
                yield pa.RecordBatch.from_arrays([pa.array([int(block[0]) & ((1 << bits) - 1)], pa.int32()), pa.array([_pack_block(block)])], ["bucket", "payload"])
            edge = [0, *np.searchsorted(k, np.array([(j << 64) >> bits for j in range(1, 1 << bits)], dtype=U)).tolist(), len(k)]
            full = [j for j in range(1 << bits) if edge[j + 1] > edge[j]]
            for j in full:
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([_pack(k[edge[j] : edge[j + 1]], s[edge[j] : edge[j + 1]], bits)])], ["bucket", "payload"])

        for batch in batches:
            for part in slices(batch):
                for own in shingle_sets(part, width):
                    name = signature(own)
                    if name >= 0 and name not in seen:
                        seen.add(name)
                        keys.append(set_keys(own, windows))
                        sigs.append(np.full(len(keys[-1]), name))
                        held += len(keys[-1])
                if held > POSTINGS:
                    yield from flush()
                    keys, sigs, held = [], [], 0
                    if len(seen) > 1 << 18:
                        seen = set()
        if held:
            yield from flush()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """(gid, sig, root): the sets of every key that two sets share; keys with the same sets are one group.

    A root says that the sets are one block without comparison: sets that a run made a
    block, and all that share a key with a marked set, which stands for a block of the
    run it comes from, whatever that set is like itself."""
    postings, sigs, roots = [], [], []
    for blob in table.column("payload").to_pylist():
        n, m, _ = np.frombuffer(blob, np.int64, 3).tolist()
        if n < 0:
            sigs.append(np.frombuffer(blob, np.int64, m, 24))
            roots.append(np.full(m, sigs[-1].min()))
        else:
            postings.append(_unpack(blob))
    keys, s = (np.concatenate(x) for x in zip(*postings, strict=True)) if postings else (np.zeros(0, U), np.zeros(0, np.int64))
    marked = s < 0
    s = np.where(marked, ~s, s)
    order = np.lexsort((~marked, s, keys))  # the marked one of equal postings first
    keys, s, marked = keys[order], s[order], marked[order]
    keep = np.append(True, (keys[1:] != keys[:-1]) | (s[1:] != s[:-1]))[: len(keys)]
    keys, s, marked = keys[keep], s[keep], marked[keep]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    size = np.diff(np.append(first, len(keys)))
    sure = np.logical_or.reduceat(marked, first) if len(first) else np.zeros(0, bool)
    gid = mixed(np.add.reduceat(mixed(s.astype(U)), first) + _ODD[58] * size.astype(U)) if len(first) else np.zeros(0, U)
    met = []
    for chosen in (np.flatnonzero((size > 1) & ~sure), np.flatnonzero((size > 1) & sure)):
        chosen = chosen[np.unique(gid[chosen], return_index=True)[1]]
        met.append((chosen, np.repeat(first[chosen] - (np.cumsum(size[chosen]) - size[chosen]), size[chosen]) + np.arange(size[chosen].sum())))
    (plain, at), (blocks, held) = met
    sigs = [s[at], *sigs, s[held]]
    roots = np.concatenate([np.zeros(len(at), np.int64), *roots, np.repeat(s[first[blocks]], size[blocks])])
    gids = np.zeros(len(roots), U)
    gids[: len(at)] = np.repeat(gid[plain], size[plain])
    return pa.table({"gid": gids.view(np.int64), "sig": np.concatenate(sigs).astype(np.int64), "root": pa.array(roots, mask=np.arange(len(roots)) < len(at))})


PAIRS = "a long, b long, gid long"


def _pairs(a: list[int], b: list[int | None], gid: list[int | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(gid, pa.int64())], ["a", "b", "gid"])


def _near(percent: int):
    """Edges (a, b) from groups (gid, piece, pivot, sig, n, sketch), sorted by gid and piece; far sets as (a, null, gid).

    Only a group dealt in pieces has its pivot marked and tells which sets are far from it."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int | None] = []
        g: list[int | None] = []
        for (gid, _), held in _units(batches, ["gid", "piece"]):
            sigs, at = np.unique(np.array(held["sig"], np.int64), return_index=True)
            if len(sigs) < 2:
                continue
            marked = [s for s, p in zip(held["sig"], held["pivot"], strict=True) if p]
            n = np.array([held["n"][i] for i in at], np.int64)
            pivot = int(np.searchsorted(sigs, marked[0])) if marked else int(np.argsort(n, kind="stable")[len(n) // 2])
            edges, far = _group_edges(n, _folded([held["sketch"][i] for i in at]), percent, pivot)
            for i, j in edges:
                a.append(int(sigs[i]))
                b.append(int(sigs[j]))
            for i in far if marked else ():
                a.append(int(sigs[i]))
                b.append(None)
            g.extend([gid] * (len(a) - len(g)))
            if len(a) > 1 << 16:
                yield _pairs(a, b, g)
                a, b, g = [], [], []
        if a:
            yield _pairs(a, b, g)

    return run


def _far(percent: int):
    """Edges from far sets (side 0) to the sets of a piece (side 1) of their group."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (gid, _, _), held in _units(batches, ["gid", "piece", "fringe"]):
            side = np.array(held["side"])
            far, whole = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(far) and len(whole):
                n, maps, forest = np.array(held["n"], np.int64), _folded(held["sketch"]), Forest(len(side))
                for i in far.tolist():
                    for j in whole[possible(n[i], maps[i], n[whole], maps[whole], percent)].tolist():
                        forest.join(i, j)
                found = [(held["sig"][i], held["sig"][r]) for i, r in enumerate(forest.roots().tolist()) if i != r]
                yield _pairs([x for x, _ in found], [y for _, y in found], [gid] * len(found))

    return run


def _possible_edges(met: DataFrame, sets: DataFrame, percent: int, group: int, parts: int) -> DataFrame:
    """(a, b) that connect all pairs of a group (gid, sig, root) whose sketches allow a link, and all sets to their root; ``sets`` has sig, n, sketch."""
    rooted = met.where("root is not null and sig <> root").select(F.col("sig").alias("a"), F.col("root").alias("b"))
    met = met.where("root is null").select("gid", "sig")
    sizes = materialize(met.groupBy("gid").agg(F.count(F.lit(1)).alias("k"), F.min("sig").alias("middle")).where(F.col("k") > group), "jaccard-crowded")
    some = not sizes.isEmpty()
    dealt = met.withColumns({"piece": F.lit(0).cast("long"), "pivot": F.lit(False)})
    if some:
        total = met.count()
        crowded = materialize(looked_up(met, sizes, "gid", total).withColumn("pieces", F.ceil(F.col("k") / group)), "jaccard-dealt")
        own = crowded.where("sig <> middle").select("gid", "sig", F.pmod(F.xxhash64("sig"), F.col("pieces")).alias("piece"), F.lit(False).alias("pivot"))
        pivots = sizes.select("gid", F.col("middle").alias("sig"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("k") / group) - 1)).alias("piece"), F.lit(True).alias("pivot"))
        free = dealt.join(sizes.select("gid"), "gid", "left_anti").select("gid", "sig", "piece", "pivot")
        dealt = free.union(own).union(pivots)
    drawn = dealt.join(sets, "sig").repartition(parts, "gid", "piece").sortWithinPartitions("gid", "piece", "sig")
    near = materialize(drawn.mapInArrow(_near(percent), PAIRS), "jaccard-near")
    if not some:
        return near.select("a", "b").union(rooted)
    far = materialize(near.where("b is null").select("gid", F.col("a").alias("sig")).distinct(), "jaccard-far")
    fringes = materialize(far.groupBy("gid").agg(F.count(F.lit(1)).alias("many")).withColumn("fringes", F.ceil(F.col("many") / group)).join(sizes, "gid").select("gid", "k", "fringes"), "jaccard-fringes")
    found = near.where("b is not null").select("a", "b").union(rooted)
    if fringes.isEmpty():
        return found
    every = looked_up(crowded.select("gid", "sig", "pieces"), fringes, "gid", total)
    whole = every.select("gid", "sig", F.pmod(F.xxhash64("sig"), F.col("pieces")).alias("piece"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("fringes") - 1)).alias("fringe"), F.lit(1).alias("side"))
    apart = every.join(far, ["gid", "sig"]).select(
        "gid", "sig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64(F.lit(7), F.col("sig")), F.col("fringes")).alias("fringe"), F.lit(0).alias("side")
    )
    units = whole.union(apart).join(sets, "sig").repartition(parts, "gid", "piece", "fringe").sortWithinPartitions("gid", "piece", "fringe", "sig")
    return found.union(units.mapInArrow(_far(percent), PAIRS).select("a", "b"))


def _active_sets(width: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, sigs, sets = [], [], []
                for name, own in zip(part.column("_name").to_pylist(), shingle_sets(part, width), strict=True):
                    if len(own):
                        names.append(name)
                        sigs.append(signature(own))
                        sets.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sigs, pa.int64()), pa.array(sets, pa.binary())], ["_name", "sig", "members"])

    return run


def _units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Consecutive rows with equal ``keys``, across batches."""
    now, held = None, None
    for batch in batches:
        columns = batch.to_pydict()
        for i, key in enumerate(zip(*(columns[k] for k in keys), strict=True)):
            if key != now:
                if held:
                    yield now, held
                now, held = key, {c: [] for c in columns}
            for c, values in columns.items():
                held[c].append(values[i])
    if held:
        yield now, held


def _resolve(percent: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block, chunk), held in _units(batches, ["block", "chunk"]):
            sets = [np.frombuffer(x, U) for x in held["members"]]
            sigs = np.array(held["sig"], np.int64)
            same = lambda x: pa.array(np.full(len(sigs), x))
            yield pa.RecordBatch.from_arrays([same(block), same(chunk), same(held["chunks"][0]), same(held["per"][0]), pa.array(sigs), pa.array(sigs[self_join(sets, percent)])], ["block", "chunk", "chunks", "per", "sig", "comp"])

    return run


def _resolved(sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """The component of each set (block, chunk, chunks, per, sig, members) within its chunk."""
    return sets.repartition(parts, "block", "chunk").sortWithinPartitions("block", "chunk", "sig").mapInArrow(_resolve(percent), "block long, chunk long, chunks long, per long, sig long, comp long")


def _cross(percent: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _units(batches, ["block", "chunk", "fringe"]):
            side = np.array(held["side"])
            order = np.argsort(side, kind="stable")
            split = int((side == 0).sum())
            if not 0 < split < len(side):
                continue
            sets = [np.frombuffer(held["members"][i], U) for i in order]
            known, sigs = np.array(held["comp"], np.int64)[order], np.array(held["sig"], np.int64)[order]
            found = cross_join(sets[:split], sets[split:], known, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(sigs[[a for a, _ in found]]), pa.array(sigs[[b for _, b in found]])], ["a", "b"])

    return run


def _leaders(level: DataFrame, k: int) -> DataFrame:
    """Representatives of the largest component of every chunk, dealt in chunks of their own."""
    more = F.least(F.lit(REPRESENTATIVES), F.col("per").cast("int") / 4).cast("int")
    counted = level.groupBy("block", "chunk", "comp").agg(F.count(F.lit(1)).alias("k"), F.max("chunks").alias("chunks"), F.max("per").alias("per"), F.sort_array(F.collect_set(F.when(F.pmod("sig", F.lit(16)) == 0, F.col("sig")))).alias("some"))
    best = counted.groupBy("block", "chunk").agg(F.max_by(F.struct("comp", "some", "chunks", "per"), F.struct("k", "comp")).alias("m")).select("block", "m.*")
    chosen = best.select("block", "per", F.explode(F.slice(F.array_union(F.array("comp"), "some"), 1, more + 1)).alias("sig"), F.ceil(F.col("chunks") * (more + 1) / F.col("per")).alias("chunks"))
    return chosen.select("block", "chunks", "per", "sig", F.pmod(F.xxhash64(F.lit(k), F.col("sig")), F.col("chunks")).alias("chunk"))


def _joined_blocks(sets: DataFrame, several: bool, percent: int, parts: int) -> DataFrame:
    """(sig, comp) for the sets (block, chunk, chunks, per, sig, members); ``several`` tells whether a block has more chunks than one."""
    if several:
        sets = materialize(sets, "jaccard-sets")  # read several times below
    local = materialize(_resolved(sets, percent, parts), "jaccard-local")
    if not several:
        return local.select("sig", "comp")
    large, apart = sets.where("chunks > 1").select("block", "chunk", "sig", "members"), local.where("chunks > 1")
    edges, level, k = apart.select(F.col("sig").alias("a"), F.col("comp").alias("b")), apart, 0
    while not level.isEmpty():
        k += 1
        met = large.select("block", "sig", "members").join(_leaders(level, k), ["block", "sig"])
        met = materialize(_resolved(met, percent, parts), "jaccard-leaders")
        edges, level = edges.union(met.select("sig", "comp")), met.where("chunks > 1")
    edges = materialize(edges, "jaccard-edges")
    state = materialize(_labelled(apart.select("block", "chunk", "chunks", "per", "sig"), edges), "jaccard-labelled")
    counted = state.groupBy("block", "comp").agg(F.count(F.lit(1)).alias("k"), F.max("chunks").alias("chunks"), F.max("per").alias("per"))
    main = counted.groupBy("block").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), (F.sum("k") - F.max("k")).alias("loose"), F.max("chunks").alias("chunks"), F.max("per").alias("per")).where("loose > 0")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    main = main.select("block", "main", "chunks", F.ceil(F.col("loose") / F.col("per")).alias("groups"), every.alias("chunk"))  # a row per chunk, so that a block's sets don't meet
    state = materialize(state.select("block", "chunk", "sig", "comp").join(main, ["block", "chunk"]), "jaccard-state")
    carried = large.join(state, ["block", "chunk", "sig"])
    whole = carried.select("block", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("fringe"), F.lit(1).alias("side"), "sig", "comp", "members")
    fringe = carried.where("comp <> main").select("block", every.alias("chunk"), F.pmod(F.xxhash64(F.lit(7), F.col("sig")), F.col("groups")).alias("fringe"), F.lit(0).alias("side"), "sig", "comp", "members")
    more = whole.union(fringe).repartition(parts, "block", "chunk", "fringe").sortWithinPartitions("block", "chunk", "fringe", "sig").mapInArrow(_cross(percent), "a long, b long")
    done = _labelled(apart.select("sig"), materialize(edges.union(more), "jaccard-edges-all"))
    return local.where("chunks = 1").select("sig", "comp").union(done.select("sig", "comp"))


def _labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges)
    return nodes.join(found, nodes.sig == found.node, "left").select(*nodes.columns, F.coalesce("root", "sig").alias("comp"))


def jaccard_components(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, chunk: int = CHUNK, group: int = GROUP, shared: int = SHARED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``carry``, n_shingles, sig, comp, component_id per row.

    ``sig`` names the row's set and ``comp`` its component (both null without words);
    component_id is the least doc_id reachable by links."""
    text = docs.select("doc_id", *carry, "text", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("_name"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in text.schema.fields if f.name != "text")
    own = materialize(text.mapInArrow(_describe(width), f"{kept}, n long, sig long, sketch binary"), "jaccard-own")
    elements = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(6, (elements >> 21).bit_length())  # every bucket of a run repeats the names of its sets, so no more buckets than memory asks for
    met = text.select("text").mapInArrow(_post(bits, width, percent, shared), "bucket int, payload binary").groupBy("bucket").applyInArrow(_meet, "gid long, sig long, root long")
    met = materialize(met, "jaccard-groups")
    least = own.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.coalesce(F.min("doc_id").cast("long"), F.min("_name")).alias("_name"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    least = materialize(least, "jaccard-classes")
    blocks = components(_possible_edges(met, least.select("sig", "n", "sketch"), percent, group, parts))
    placed = materialize(least.join(blocks, least.sig == blocks.node).select("sig", "_name", "n", F.col("root").alias("block")), "jaccard-placed")
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("weight"))
    per = F.greatest(F.lit(min(chunk, 64)), F.least(F.lit(chunk), F.floor(F.lit(WEIGHT) * F.col("k") / F.col("weight")))).cast("long")
    sizes = materialize(sizes.select("block", "k", per.alias("per"), F.ceil(F.col("k") / per).alias("chunks")), "jaccard-sizes")
    dealt = looked_up(placed.select("block", "sig", "_name"), sizes, "block", placed.count())
    dealt = materialize(dealt.select("block", F.pmod(F.xxhash64("sig"), F.col("chunks")).alias("chunk"), "chunks", "per", "sig", "_name"), "jaccard-reps")
    wanted = maybe(text.where("doc_id is not null").select("_name", "text"), dealt, "_name")
    nameless = text.where("doc_id is null").select("_name", "text").distinct()  # repeated texts without an id meet once
    wanted = wanted.union(nameless.join(dealt.select("_name"), "_name", "left_semi"))
    # equal rows may bring a set twice, which the join links like any other
    sets = wanted.mapInArrow(_active_sets(width), "_name long, sig long, members binary").join(dealt, ["_name", "sig"]).select("block", "chunk", "chunks", "per", "sig", "members")
    linked = _joined_blocks(sets, not sizes.where("chunks > 1").isEmpty(), percent, parts).distinct()
    named = materialize(least.select("sig", "least", "rows").join(linked, "sig", "left").select("sig", F.coalesce("comp", "sig").alias("comp"), "least", "rows"), "jaccard-named")
    lowest = named.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k"))
    mapping = looked_up(named.select("sig", "comp", "rows"), lowest, "comp", named.count())
    mapping = materialize(mapping.select("sig", F.col("rows").alias("k"), "comp", "component_id"), "jaccard-components")
    rows = own.select("doc_id", *carry, F.col("n").alias("n_shingles"), "sig")
    found = looked_up(rows.where("sig is not null"), mapping, "sig", own.count()).drop("k")
    return found.unionByName(rows.where("sig is null").select("*", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id")))
