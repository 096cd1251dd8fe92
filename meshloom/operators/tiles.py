"""Sparse matrix-vector products over row tiles: a product moves ghost entries of the vector and nothing else.

Rows are dealt to blocks along their order.  A block's row of the table holds its tile in
compressed rows, with columns numbered by place in the block's own entries and, after
them, its ghosts, the entries that other blocks own; it also holds its part of the vector
and the list of its entries that others need.  The table is kept by block, so that a
product shuffles only (block, place, value) of ghosts.

Defined results: an entry of the vector that is missing is 0; a row without entries has
no value; entries at one place are added; the matrix is square over the names of rows."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import _bodies, _columns, _packer
from .iterate import written
from .ordering import block_labels

TILE = "block long, names binary, offsets binary, columns binary, entries binary, x binary, send_to binary, send_from binary, send_place binary"
GHOST = "block long, place long, x double"
ENTRIES_PER_TILE = 1 << 21  # about; a task holds a tile and its packed entries


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, np.int64).tobytes()], pa.binary())


def _of(table: pa.Table, column: str, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(table.column(column)[0].as_buffer(), kind)


def _tile(firsts: np.ndarray, entries: pa.Table, own: pa.Table) -> pa.Table:
    """A block's tile from its packed entries (i, j, a), the first names of all blocks, and its part of the vector (i, x); ghosts come last, in the order of (owner, name)."""
    block = (entries if entries.num_rows else own).column("block").slice(0, 1)
    names, x = own.column("i").to_numpy(), own.column("x").to_numpy()
    order = np.argsort(names, kind="stable")
    names, x = names[order], x[order]
    i, j, a = _columns(entries, 3)
    owner, a = np.searchsorted(firsts, j, "right") - 1, a.view(np.float64)
    outside = owner != block[0].as_py()
    ghosts, place = np.unique(j[outside], return_inverse=True)  # owners hold ranges of names, so this is the order of owners too
    ghosts = np.stack([np.searchsorted(firsts, ghosts, "right") - 1, ghosts])
    column = np.searchsorted(names, j)
    column[outside] = len(names) + place
    row = np.searchsorted(names, i)
    by = np.lexsort((column, row))
    offsets = np.searchsorted(row[by], np.arange(len(names) + 1))
    empty = _longs(np.zeros(0))
    held = {"names": _longs(names), "offsets": _longs(offsets), "columns": _longs(column[by]), "entries": pa.array([a[by].astype("<f8").tobytes()], pa.binary()), "x": pa.array([x.astype("<f8").tobytes()], pa.binary())}
    return pa.table({"block": block} | held | {"send_to": _longs(ghosts[0]), "send_from": _longs(ghosts[1]), "send_place": empty})


def _wants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, to, name, place): what each tile needs of other blocks; the place is the ghost's number in the tile that asks."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for k in range(table.num_rows):
            one = table.slice(k, 1)
            owner, name, n = _of(one, "send_to"), _of(one, "send_from"), len(_of(one, "names"))
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.full(len(owner), one.column("block")[0].as_py())), pa.array(name), pa.array(np.arange(n, n + len(owner)))], ["block", "to", "name", "place"])


def _supplied(tile: pa.Table, wants: pa.Table) -> pa.Table:
    """A tile that knows which of its entries go where."""
    place = np.searchsorted(_of(tile, "names"), wants.column("name").to_numpy())
    sent = {"send_to": _longs(wants.column("to").to_numpy()), "send_from": _longs(place), "send_place": _longs(wants.column("place").to_numpy())}
    return pa.table({c: tile.column(c) for c in tile.column_names if c not in sent} | sent).select([c.split()[0] for c in TILE.split(", ")])


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for k in range(table.num_rows):
            one = table.slice(k, 1)
            yield pa.RecordBatch.from_arrays([pa.array(_of(one, "send_to")), pa.array(_of(one, "send_place")), pa.array(_of(one, "x", "<f8")[_of(one, "send_from")])], ["block", "place", "x"])


def _product(tile: pa.Table, ghosts: pa.Table) -> pa.Table:
    names, offsets, columns, x = _of(tile, "names"), _of(tile, "offsets"), _of(tile, "columns"), _of(tile, "x", "<f8")
    every = np.zeros(max(len(x), int(columns.max(initial=-1)) + 1))
    every[: len(x)] = x
    every[ghosts.column("place").to_numpy()] = ghosts.column("x").to_numpy()
    full = np.flatnonzero(np.diff(offsets) > 0)
    terms = _of(tile, "entries", "<f8") * every[columns]
    return pa.table({"i": names[full], "y": np.add.reduceat(terms, offsets[full]) if len(full) else np.zeros(0)})


class Tiles:
    """A matrix in tiles with its vector; ``product`` may be taken any number of times."""

    def __init__(self, held: DataFrame) -> None:
        self.held = held

    def ghosts(self) -> DataFrame:
        """(block, place, x): the entries that a product moves."""
        return self.held.mapInArrow(_sent, GHOST)

    def product(self) -> DataFrame:
        """(i, y)."""
        return self.held.groupBy("block").cogroup(self.ghosts().groupBy("block")).applyInArrow(_product, "i long, y double")


@contextmanager
def tiled(matrix: DataFrame, vector: DataFrame, blocks: int) -> Iterator[Tiles]:
    """Tiles of ``matrix`` (i, j, a) with ``vector`` (i, x), rows in ``blocks`` equal blocks along their names, or more if tiles would hold more than ``ENTRIES_PER_TILE`` entries."""
    blocks = max(blocks, -(-matrix.count() // ENTRIES_PER_TILE))
    parts = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = matrix.select("i").union(matrix.select(F.col("j").alias("i"))).union(vector.select("i")).distinct()
    own = written(block_labels(every, ["i"], blocks, "block").join(vector.select("i", "x"), "i", "left").select("i", "block", F.coalesce("x", F.lit(0.0)).alias("x")), "tile-rows")
    low = {r["block"]: r["low"] for r in own.groupBy("block").agg(F.min("i").alias("low")).collect()}  # a row per block
    firsts = np.array([low[k] for k in sorted(low)], np.int64)  # blocks are numbered from 0 along the names
    entries = matrix.select("i", "j", F.col("a").cast("double").alias("a")).mapInArrow(_packer(lambda x: _bodies(np.searchsorted(firsts, x[0], "right") - 1, x)), "block long, body binary")
    tiles = written(entries.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(lambda e, o: _tile(firsts, e, o), TILE), "tiles")
    wants = tiles.select("block", "names", "send_to", "send_from").mapInArrow(_wants, "block long, to long, name long, place long")
    supplied = tiles.groupBy("block").cogroup(wants.groupBy("block")).applyInArrow(_supplied, TILE)
    held = supplied.repartition(parts, "block").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield Tiles(held)
    finally:
        held.unpersist()


def products(matrix: DataFrame, vector: DataFrame, blocks: int, times: int = 200) -> tuple[DataFrame, list[float]]:
    """y = A x ``times`` times over tiles, as a benchmark: y and the seconds of every product; only the last one is written."""
    took: list[float] = []
    with tiled(matrix, vector, blocks) as tiles:
        for k in range(times):
            began = time.perf_counter()
            product = tiles.product()
            if k == times - 1:
                out = written(product, "product")
            else:
                product.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
    return out, took
