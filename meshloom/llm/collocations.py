"""Collocations of each language: phrases scored against the parts of their weakest cut.

Count-min sketches go first.  Every task adds its n-grams to a table of counters,
tables are merged by sums, and a counter never says less than the true count of an
n-gram that it stands for.  Words and pairs are sketched first; longer n-grams are
sketched only where all their pairs may be frequent, so tables keep little noise.
Then one more pass counts exactly, by text, the n-grams whose counters reach the
threshold: all frequent ones are among them.  Counters stop at the first number that
their type can't hold, far beyond the threshold, so merging can't wrap.

The merged tables are reduced to a bit a counter and broadcast: at most ``MOST_CELLS``
bits for each of two hashes.  With more text than that table separates, more rare
n-grams are counted exactly than need be, and results stay the same.

Defined results: a null text is empty, a null language is ``und``; rows that repeat a
text count again; ties of score go to the greater count, then to the lesser phrase;
doc_id and other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .textops import FOLD, U, mixed, released, slices, text_buffer, words

LEAST, LONGEST, TOP, COVERED = 30, 4, 2000, 80
ROWS = 2
BLOCK = 1 << 14
MOST_CELLS = 1 << 27
SLICE = 2 << 20
IS_STOP = np.zeros(256, bool)
IS_STOP[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
IS_WORD = ~IS_STOP
IS_WORD[[0x20, 0x09]] = False
_ODD = mixed(np.arange(401, 441, dtype=U)) | U(1)


def _seed(lang: str) -> np.uint64:
    return U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Grams:
    """The n-grams of a run of texts: ``start[n]`` has their first words, ``name[n]`` their hashes."""

    def __init__(self, part: pa.RecordBatch) -> None:
        self.data, at = text_buffer(part.column("text"))
        self.begin, self.end, h, offsets = words(self.data, at, IS_WORD)
        self.langs = part.column("lang").to_pylist()
        self.text = np.repeat(np.arange(len(self.langs)), np.diff(offsets))
        stops = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum(IS_STOP[self.data], out=stops[1:])
        piece = stops[self.begin]
        self.joined = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])  # to the next word
        seeds = {x: _seed(x) for x in set(self.langs)}
        self.seed = np.array([seeds[x] for x in self.langs], U)[self.text]
        self.h = h
        self.words = np.diff(offsets)

    def names(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all n-grams of n words."""
        count = max(0, len(self.h) - n + 1)
        whole = np.ones(count, bool)
        for k in range(n - 1):
            whole &= self.joined[k : k + count]
        first = np.flatnonzero(whole)
        total = self.seed[first] * _ODD[n]
        for k in range(n):
            total += self.h[first + k] * _ODD[10 + k]
        return first, mixed(total)

    def phrases(self, first: np.ndarray, n: int) -> pa.Array:
        """The n-grams' words in lower case with single spaces between."""
        at = (first[:, None] + np.arange(n)).reshape(-1)
        size = self.end[at] - self.begin[at] + 1
        stop = np.cumsum(size)
        source = np.repeat(self.begin[at] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
        out = FOLD[self.data[np.minimum(source, len(self.data) - 1)]]
        out[stop - 1] = 0x20
        last = stop.reshape(-1, n)[:, -1]
        keep = np.ones(len(out), bool)
        keep[last - 1] = False
        offsets = np.zeros(len(first) + 1, np.int64)
        offsets[1:] = last - np.arange(1, len(first) + 1)
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out[keep]))


def cells(names: np.ndarray, row: int, width: int) -> np.ndarray:
    """The counters of n-grams in one row of a sketch of 2 ** width counters."""
    return mixed(names * _ODD[30 + row] + _ODD[20 + row]) >> U(64 - width)


class Seen:
    """Merged sketches as bits, by n: those of words and pairs serve as a sieve for longer n-grams."""

    def __init__(self, tables: list[tuple[tuple[int, ...], int, object]]) -> None:
        self.of = {n: (width, np.frombuffer(bits.value, np.uint8).reshape(ROWS, -1)) for orders, width, bits in tables for n in orders}

    def _may(self, names: np.ndarray, n: int) -> np.ndarray:
        width, bits = self.of[n]
        may = np.ones(len(names), bool)
        for row in range(ROWS):
            at = cells(names, row, width)
            may &= (bits[row][at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 > 0
        return may

    def frequent(self, grams: Grams, orders: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, first words and hashes of n-grams that the sketches so far don't rule out."""
        pair = np.zeros(len(grams.h) + 1, bool)
        if 2 in self.of and max(orders) > 2:
            first, names = grams.names(2)
            pair[first[self._may(names, 2)]] = True
        for n in orders:
            first, names = grams.names(n)
            if n > 2 and 2 in self.of:
                may = np.ones(len(first), bool)
                for k in range(n - 1):
                    may &= pair[first + k]
                first, names = first[may], names[may]
            if n in self.of:
                may = self._may(names, n)
                first, names = first[may], names[may]
            yield n, first, names


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    for batch in batches:
        for part in slices(batch, size=SLICE):
            yield Grams(part)


def _kind(least: int) -> type:
    return np.uint8 if least <= 255 else np.uint32


def _sketch(orders: list[int], width: int, least: int, before: list):
    """Blocks (block, counters) of a task's sketch; row r starts at block r * 2 ** width / BLOCK."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, seen = _kind(least), Seen(before)
        most = np.iinfo(kind).max
        table = np.zeros((ROWS, 1 << width), kind)
        for grams in _parts(batches):
            for _, _, names in seen.frequent(grams, orders):
                for row in range(ROWS):
                    at = np.sort(cells(names, row, width).astype(np.uint32))
                    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
                    count = np.diff(np.append(first, len(at)))
                    table[row][at[first]] = np.minimum(table[row][at[first]].astype(np.int64) + count, most).astype(kind)
        size = min(BLOCK, 1 << width)
        for block, counters in enumerate(table.reshape(-1, size)):
            if counters.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counters.tobytes()])], ["block", "counters"])

    return run


def _merge(least: int):
    """The counters of a block as bits: whether their sum reaches the threshold."""

    def run(held: pa.Table) -> pa.Table:
        kind = _kind(least)
        total = 0
        for x in held.column("counters"):
            total = np.minimum(total + np.frombuffer(x.as_buffer(), kind).astype(np.int64), np.iinfo(kind).max)
        return pa.table({"block": held.column("block").slice(0, 1), "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()])})

    return run


def sketched(texts: DataFrame, orders: list[int], width: int, least: int, before: list) -> tuple[tuple[int, ...], int, object]:
    """The orders, width and broadcast bits of the merged sketch of the texts (lang, text)."""
    context = texts.sparkSession.sparkContext
    # as many tables as cores: a table is as large whatever its task reads
    blocks = texts.coalesce(context.defaultParallelism).mapInArrow(_sketch(orders, width, least, before), "block int, counters binary")
    merged = blocks.groupBy("block").applyInArrow(_merge(least), "block int, bits binary").toArrow()  # at most ROWS * MOST_CELLS bits
    size = max(1, min(BLOCK, 1 << width) // 8)
    bits = np.zeros(ROWS * max(1, (1 << width) // 8), np.uint8)
    for block, held in zip(merged.column("block").to_pylist(), merged.column("bits"), strict=True):
        bits[block * size : (block + 1) * size] = np.frombuffer(held.as_buffer(), np.uint8)
    return tuple(orders), width, context.broadcast(bits.tobytes())


def _exact(orders: list[int], tables: list):
    """(lang, k, phrase, f) of n-grams that may be frequent, by run of texts; phrase is null for the number of words of a language."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(tables)
        for grams in _parts(batches):
            langs = pa.array(grams.langs, pa.string())
            totals = pa.table({"lang": langs, "f": grams.words}).group_by("lang").aggregate([("f", "sum")])
            none = pa.nulls(len(totals), pa.large_string())
            yield pa.RecordBatch.from_arrays([totals.column("lang").combine_chunks(), pa.array(np.ones(len(totals), np.int32)), none, totals.column("f_sum").combine_chunks()], ["lang", "k", "phrase", "f"])
            for n, first, names in seen.frequent(grams, orders):
                _, one, count = np.unique(names, return_index=True, return_counts=True)
                for lo in range(0, len(one), 1 << 16):
                    some = first[one[lo : lo + (1 << 16)]]
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(grams.text[some])), pa.array(np.full(len(some), n, np.int32)), grams.phrases(some, n), pa.array(count[lo : lo + (1 << 16)])], ["lang", "k", "phrase", "f"])

    return run


def frequent_grams(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, k, phrase, f): n-grams of up to ``longest`` words that occur ``least`` times, and rows of words by language with a null phrase."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    width = min(MOST_CELLS, max(1 << 12, size // 64)).bit_length()
    width = min(MOST_CELLS.bit_length() - 1, width)
    tables: list = []
    for orders in ([1, 2], list(range(3, longest + 1))):
        if orders:
            tables.append(sketched(texts, orders, width, least, tables))
    counted = texts.mapInArrow(_exact(list(range(1, longest + 1)), tables), "lang string, k int, phrase string, f long").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return materialize(counted.where(F.col("phrase").isNull() | (F.col("f") >= least)), "collocation-grams")


def scored(grams: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of phrases of two words and more, by the lowest-scoring of their cuts."""
    parts = F.split("phrase", " ")
    cuts = grams.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    joined = lambda at, n: F.array_join(F.slice(parts, at, n), " ")
    cuts = cuts.withColumns({"_left": joined(F.lit(1), F.col("cut")), "_right": joined(F.col("cut") + 1, F.col("k") - F.col("cut"))})
    known = grams.where("phrase is not null")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l")), ["lang", "_left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r")), ["lang", "_right"])
    score = F.expr("cast((cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r) as long)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "k", "a", "m.l", "m.r", "m.score")


def unsubsumed(candidates: DataFrame, covered: int) -> DataFrame:
    """Candidates that no longer candidate contains with ``covered`` hundredths of their occurrences."""
    parts = F.split("phrase", " ")
    longer = candidates.where("k > 2").select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("n"))
    longer = longer.select("lang", "a", parts.alias("w"), "n", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("n") + 1)).alias("at"))
    inside = longer.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("phrase")).agg(F.max("a").alias("_most"))
    kept = candidates.join(inside, ["lang", "phrase"], "left")
    return kept.where(F.col("_most").isNull() | (F.col("_most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered)).drop("_most")


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    grams = frequent_grams(docs, least=least, longest=longest)
    candidates = materialize(scored(grams), "collocation-scores")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = unsubsumed(candidates, covered).withColumn("_deal", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "_deal")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = grams.where("phrase is null").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
