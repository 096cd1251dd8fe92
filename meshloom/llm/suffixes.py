"""Removal of repeated passages by distributed prefix doubling over sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else.  Suffixes are ranked by names of their prefixes: the name of a prefix of
2h bytes is the pair of the names at offsets 0 and h, Spark shuffles and sorts
these pairs at growing h, and suffixes whose pair is unique drop out.

Ranking every byte would shuffle each text a hundred times, so suffixes are
sampled so that no repeat is missed.  A start s of a string is represented by its
*anchor*: of the first ``span`` places from s on, the one whose next few bytes hash
lowest.  The anchor is chosen by bytes of the string alone, so equal strings have
theirs at the same place.  Starts with one anchor are consecutive, a *cell*; all
their strings contain the ``core`` bytes from the anchor on.

1. Cells whose first half core is unique drop out, h = core / 2.
2. The others are ranked by the pair of half cores, then by the bytes from the
   cell's first start to the end of its last string.  If these are repeated, so is
   every string of the cell; if the core is unique, none is.
3. What is left are cells at the edge of a repeat.  They, and one cell of each other
   kind with the same core, are sorted by that core with the bytes they span, and a
   task ranks the strings of each core.  A core of very many kinds could fill a task:
   its strings are shuffled and ranked one by one, by the pair of their halves,
   h = length / 2.

Names are 64-bit hashes, used in pairs.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing;
rows that repeat a text, or a whole row, are places of their own, so that copies of
``length`` bytes or more lose every byte; rows need no doc_id; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .storage import materialize, remove
from .textops import _BASE, _INVERSE, _VALUE, U, _powers, mixed, released, slices, text_buffer

LENGTH = 400
SEGMENT = 1 << 21
_PLACE = U((1 << 22) - 1)
_ODD = mixed(np.arange(301, 309, dtype=U)) | U(1)
MOST_BITS = 1 << 30
KINDS = 1 << 14  # of cells with one core that a task ranks


class Names:
    """Names of the substrings of one buffer."""

    def __init__(self, data: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
        self.total = np.zeros(len(data) + 1, U)
        np.cumsum(_VALUE[data] * up[: len(data)], out=self.total[1:])
        self.down = down

    def __call__(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mixed((self.total[start + size] - self.total[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        """Names of all substrings of ``size`` bytes."""
        n = len(self.total) - size
        return mixed((self.total[size:] - self.total[:n]) * self.down[:n])


def lowest(keys: np.ndarray, span: int) -> np.ndarray:
    """The minimum of every ``span`` consecutive keys."""
    n = len(keys) - span + 1
    padded = np.full(-(-len(keys) // span) * span, ~U(0))
    padded[: len(keys)] = keys
    tiles = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(tiles, axis=1).reshape(-1)
    return np.minimum(ahead[:n], behind[span - 1 : span - 1 + n])


class Sampler:
    """Cells of texts for strings of ``length`` bytes."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.core = max(2, length * 36 // 100)
        self.span = length - self.core + 1
        self.gram = min(16, self.core)
        self.up = self.down = np.ones(1, U)

    def names(self, data: np.ndarray) -> Names:
        if len(self.up) <= len(data):
            n = max(len(data) + 1, SEGMENT + self.length)
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return Names(data, self.up, self.down)

    def pieces(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Index of the first text, place of its first byte in it, bytes and offsets; a long text comes in overlapping segments."""
        if len(at) == 2 and len(data) > SEGMENT:
            for lo in range(0, len(data) - self.length + 1, SEGMENT):
                part = data[lo : lo + SEGMENT + self.length - 1]
                yield 0, lo, part, np.array([0, len(part)], np.int64)
        elif len(data) >= self.length:
            yield 0, 0, data, at

    def cells(self, names: Names, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first start, last start and anchor of every cell."""
        n = int(at[-1])
        keys = names.every(self.gram)
        keys = (keys & ~_PLACE) | np.arange(len(keys), dtype=U)
        anchor = (lowest(keys, self.span)[: n - self.length + 1] & _PLACE).astype(np.int64)
        long = np.flatnonzero(np.diff(at) >= self.length)
        steps = np.zeros(n + 2, np.int32)
        np.add.at(steps, at[long], 1)
        np.add.at(steps, at[long + 1] - self.length + 1, -1)
        valid = np.cumsum(steps[: n - self.length + 2]) > 0  # one more than there are starts: False
        begins = valid[:-1].copy()
        begins[1:] &= ~valid[:-2] | (anchor[1:] != anchor[:-1])
        begins[at[long]] = True
        ends = valid[:-1] & (~valid[1:] | np.append(begins[1:], True))
        lo, hi = np.flatnonzero(begins), np.flatnonzero(ends)
        return np.searchsorted(at, lo, "right") - 1, lo, hi, anchor[lo]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``lo`` on, ``size`` of them."""
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _found(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """Bytes, names, the columns at1 and at2 by cell, first place in the text, first and last start, anchor and place's name of the cells of each piece of text."""
    sampler = Sampler(length)
    for batch in batches:
        for part in slices(batch):
            at1, at2 = (part.column(c).to_numpy() for c in ("at1", "at2"))
            for _, base, data, at in sampler.pieces(*text_buffer(part.column("text"))):
                names = sampler.names(data)
                text, lo, hi, anchor = sampler.cells(names, at)
                shift = base - at[text]
                yield data, names, at1[text], at2[text], shift, lo, hi, anchor, _place(at1[text], at2[text], lo + shift)


def _marked_in(place: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    bit = place >> U(64 - bits)
    return np.flatnonzero((table[bit >> U(3)] >> (bit & U(7)).astype(np.uint8)) & 1)


def _cells(length: int):
    """Cells (at1, at2, run, r0, r1, g, place) of texts (at1, at2, text).

    A run is 1,024 times its first start and the number of starts after it."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = Sampler(length).core
        half = core // 2
        for _, names, at1, at2, shift, lo, hi, anchor, place in _found(batches, length):
            whole = mixed(names(lo, hi - lo + length) + (hi - lo).astype(U) * _ODD[0])
            runs = ((lo + shift) << 10) + (hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(at1), pa.array(at2), pa.array(runs), _signed(names(anchor, half)), _signed(names(anchor + half, core - half)), _signed(whole), _signed(place)], ["at1", "at2", "run", "r0", "r1", "g", "place"])

    return run


def _spans(length: int, bits: int, table):
    """The marked cells with their bytes: (r0, r1, at1, at2, lo, bytes)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, flags = Sampler(length).core, np.frombuffer(table.value, np.uint8)
        half = core // 2
        for data, names, at1, at2, shift, lo, hi, anchor, place in _found(batches, length):
            marked = _marked_in(place, bits, flags)
            for on in np.array_split(marked, -(-len(marked) // 2048)) if len(marked) else ():
                size = hi[on] - lo[on] + length
                offsets = np.zeros(len(on) + 1, np.int32)
                np.cumsum(size, out=offsets[1:])
                held = pa.Array.from_buffers(pa.binary(), len(on), [None, pa.py_buffer(offsets), pa.py_buffer(data[_spread(lo[on], size)])])
                yield pa.RecordBatch.from_arrays([_signed(names(anchor[on], half)), _signed(names(anchor[on] + half, core - half)), pa.array(at1[on]), pa.array(at2[on]), pa.array((lo + shift)[on]), held], ["r0", "r1", "at1", "at2", "lo", "bytes"])

    return run


def _strings(length: int, bits: int, table):
    """The strings of the marked cells: (at1, at2, run, r0, r1), the names of their halves."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, half = np.frombuffer(table.value, np.uint8), length // 2
        for _, names, at1, at2, shift, lo, hi, _, place in _found(batches, length):
            on = _marked_in(place, bits, flags)
            own = np.repeat(on, hi[on] - lo[on] + 1)
            s = _spread(lo[on], hi[on] - lo[on] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(at1[own]), pa.array(at2[own]), pa.array((s + shift[own]) << 10), _signed(names(s, half)), _signed(names(s + half, length - half))], ["at1", "at2", "run", "r0", "r1"])

    return run


def _same_core(length: int):
    """Runs (at1, at2, run) of repeated strings among spans sorted by core."""

    def ranked(rows: pa.Table, sampler: Sampler) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        held = rows.column("bytes").combine_chunks().cast(pa.large_binary())
        at = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
        data, at = np.frombuffer(held.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
        names, size = sampler.names(data), np.diff(at) - length + 1
        s, own = _spread(at[:-1], size), np.repeat(np.arange(len(size)), size)
        r0, r1 = (rows.column(c).to_numpy() for c in ("r0", "r1"))
        core = np.cumsum(np.append(False, (r0[1:] != r0[:-1]) | (r1[1:] != r1[:-1])))
        name = mixed(names(s, length) + core[own].astype(U) * _ODD[4])
        _, which, count = np.unique(name, return_inverse=True, return_counts=True)
        on = np.flatnonzero(count[which] > 1)
        first = np.append(True, (on[1:] != on[:-1] + 1) | (own[on[1:]] != own[on[:-1]]))[: len(on)]
        begin = on[first]
        more = np.diff(np.append(np.flatnonzero(first), len(on))) - 1
        start = rows.column("lo").to_numpy()[own[begin]] + s[begin] - at[own[begin]]
        return pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().take(pa.array(own[begin])) for c in ("at1", "at2")] + [pa.array((start << 10) + more)], ["at1", "at2", "run"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, held = Sampler(length), None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            r0, r1 = (held.column(c).to_numpy() for c in ("r0", "r1"))
            last = np.flatnonzero((r0 != r0[-1]) | (r1 != r1[-1]))
            if len(last) and held.nbytes > SEGMENT:  # the last core may go on
                yield ranked(held.slice(0, int(last[-1]) + 1), sampler)
                held = held.slice(int(last[-1]) + 1)
        if held is not None and held.num_rows:
            yield ranked(held, sampler)

    return run


def _place(at1: np.ndarray, at2: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A name of a start's place."""
    return mixed(at1.view(U) * _ODD[1] + at2.view(U) * _ODD[2] + start.view(U) * _ODD[3])


def _flags(bits: int):
    """Bytes (of, value) of the bit table of places."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.unique(batch.column("place").to_numpy().view(U) >> U(64 - bits))
            of, first = np.unique(where >> U(3), return_index=True)
            if len(of):
                yield pa.RecordBatch.from_arrays([_signed(of), pa.array(np.bitwise_or.reduceat(np.left_shift(1, (where & U(7)).astype(np.int64)), first))], ["of", "value"])

    return run


def covered(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as maximal runs; intervals that touch are one run."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > reach[:-1])
    return lo[new], reach[np.append(new[1:], True)]


def _removed(length: int):
    """Figures of texts (doc_id, text, runs) after the bytes of strings that start in the runs are removed."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            found = batch.column("runs")
            n, gone, spans, kept, begins, ends = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own, digest, last = data[a:b], hashlib.sha256(), 0
                runs = np.array(found[i].values.to_numpy() if found[i].is_valid else (), np.int64)
                start, end = covered(runs >> 10, (runs >> 10) + (runs & 1023) + length) if len(runs) else (runs, runs)
                for x, y in zip(start.tolist(), end.tolist(), strict=True):
                    digest.update(own[last:x])
                    last = y
                digest.update(own[last:])
                n.append(b - a)
                gone.append(int((end - start).sum()))
                spans.append(len(start))
                kept.append(digest.hexdigest())
                begins.append(start.tolist())
                ends.append(end.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string()), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"],
            )

    return run


def _names(text: Column) -> list[Column]:
    """Two names of a row: of its doc_id and text."""
    return [F.xxhash64(F.lit(k), "doc_id", text).alias(f"at{k}") for k in (1, 2)]


RANKED = "at1 long, at2 long, run long, r0 long, r1 long, g long, place long"


def _among(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of the rows whose keys are in ``wanted``, a table on its own, so that Spark can split a hot key of the rows in the join."""
    return rows.select("at1", "at2", "run", *keys).join(wanted.select(*keys), keys, "left_semi").select("at1", "at2", "run")


def _marked(places: DataFrame) -> tuple[int, object]:
    """A broadcast bit table of places, at most MOST_BITS / 8 bytes, and the number of bits of a place."""
    bits = max(12, min(MOST_BITS, 16 * places.count()).bit_length() - 1)
    table = np.zeros(1 << (bits - 3), np.uint8)
    merged = places.mapInArrow(_flags(bits), "of long, value long").groupBy("of").agg(F.bit_or("value").alias("value"))
    for batch in merged.toArrow().to_batches():
        table[batch.column("of").to_numpy()] = batch.column("value").to_numpy()
    return bits, places.sparkSession.sparkContext.broadcast(table.tobytes())


def repeated_starts(docs: DataFrame, length: int, kinds_of_core: int = KINDS) -> DataFrame:
    """Runs (at1, at2, run) of starts of strings that also start elsewhere; ``docs`` has at1, at2, text."""
    spark, texts = docs.sparkSession, docs.select("at1", "at2", "text")
    ranked = materialize(texts.mapInArrow(_cells(length), RANKED), "suffix-ranked")
    again = materialize(ranked.groupBy("r0").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("r0"), "suffix-again")
    found = bloom.possible(ranked, again, "r0")
    kinds = materialize(found.groupBy("r0", "r1", "g").agg(F.count(F.lit(1)).alias("k"), F.min("place").alias("place")), "suffix-kinds")
    settled = [materialize(_among(found, kinds.where("k > 1"), ["r0", "r1", "g"]), "suffix-whole")]
    remove(spark, ranked)
    edges = kinds.groupBy("r0", "r1").agg(F.count(F.lit(1)).alias("kinds"), F.min("k").alias("least")).where("kinds > 1 and least = 1")
    places = materialize(kinds.join(edges.select("r0", "r1", (F.col("kinds") > kinds_of_core).alias("crowded")), ["r0", "r1"]).select("place", "crowded"), "suffix-open")
    remove(spark, kinds)
    few, many = places.where("not crowded"), places.where("crowded")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = texts.mapInArrow(_spans(length, *_marked(few)), "r0 long, r1 long, at1 long, at2 long, lo long, bytes binary")
    settled.append(spans.repartition(parts, "r0", "r1").sortWithinPartitions("r0", "r1").mapInArrow(_same_core(length), "at1 long, at2 long, run long"))
    if not many.isEmpty():
        strings = materialize(texts.mapInArrow(_strings(length, *_marked(many)), "at1 long, at2 long, run long, r0 long, r1 long"), "suffix-strings")
        twice = materialize(strings.groupBy("r0", "r1").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("r0", "r1"), "suffix-twice")
        settled.append(_among(strings, twice, ["r0", "r1"]))
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def without_repeats(docs: DataFrame, *, length: int = LENGTH, kinds_of_core: int = KINDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs (starts, ends) per row."""
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *_names(F.col("text")))
    starts = repeated_starts(named, length, kinds_of_core)
    spans = starts.groupBy("at1", "at2").agg(F.collect_list("run").alias("runs"))
    spans = materialize(spans, "suffix-spans")
    sifted = bloom.told(named, spans, "at1", "_maybe")
    none = F.array().cast("array<bigint>")
    clean = sifted.where("not _maybe").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), none.alias("starts"), none.alias("ends"))
    kind = dict(docs.dtypes)["doc_id"]
    held = sifted.where("_maybe").select("doc_id", "text", "at1", "at2").join(spans, ["at1", "at2"], "left").select("doc_id", "text", "runs")
    return clean.union(held.mapInArrow(_removed(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<bigint>, ends array<bigint>"))
