"""SimHash fingerprints and the permuted block tables that search them.

A text's terms are its word pairs (the word itself if there is but one).  Each
term's 256-bit hash votes on every bit with the term's weight,
``1 + floor(log2(count))``; a bit is set where the votes for it prevail.  The
likeness of two fingerprints is the share of equal bits.

Defined results: a null text counts as an empty one; a text without words has
the zero fingerprint; rows with equal doc_id follow each other in order of their
text; a null doc_id comes last; a single document is its own next one; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import U, mixed, text_buffer, words

BITS = 256
_LANES = mixed(np.arange(101, 101 + BITS // 64, dtype=U))
_PAIR = mixed(np.arange(7, 9, dtype=U)) | U(1)
RUN_BYTES = 1 << 20


def fingerprints(texts: pa.Array) -> np.ndarray:
    """(n, BITS / 8) bytes."""
    data, at = text_buffer(texts)
    _, _, h, offsets = words(data, at)
    pairs = mixed(h[:-1] * _PAIR[0] + h[1:] * _PAIR[1]) if len(h) > 1 else np.zeros(0, U)
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b == a:
            continue
        terms, count = np.unique(pairs[a : b - 1] if b - a > 1 else h[a:b], return_counts=True)
        votes, weight = np.zeros(BITS, np.int64), 0
        level = np.frexp(count)[1]  # 1 + floor(log2(count))
        for k in np.unique(level).tolist():
            own = terms[level == k]
            for x in range(0, len(own), 4096):
                bits = np.unpackbits(mixed(own[x : x + 4096, None] + _LANES).view(np.uint8), axis=1)
                votes += k * bits.sum(0, dtype=np.int32)
            weight += k * len(own)
        out[i] = np.packbits(2 * votes > weight)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(x ^ y).sum(1, dtype=np.int64) / BITS


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _emit(rows: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
    """Results of ``rows``, each edited with its successor; ``following`` succeeds the last."""
    own = [t for _, t in rows]
    after = [*own[1:], following]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(own, after, strict=True)]
    marks = fingerprints(pa.array([*own, following], pa.string()))
    changed = fingerprints(pa.array(edited, pa.string()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in rows], pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([m.tobytes().hex() for m in marks[:-1]]), pa.array([m.tobytes().hex() for m in changed]), pa.array(likeness(marks[:-1], changed)), pa.array(likeness(marks[:-1], marks[1:])),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, with the first row of the following range last (``ahead``)."""
    rows: list[tuple[int | None, str]] = []
    size, at, closed = 0, None, False
    for batch in batches:
        for doc_id, text, part, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "ahead")), strict=True):
            if part != at:
                at, closed, rows, size = part, False, [], 0
            if closed:
                continue
            if rows and (ahead or size >= RUN_BYTES):
                yield _emit(rows, text)
                rows, size = [], 0
            closed = bool(ahead)
            if not closed:
                rows.append((doc_id, text))
                size += len(text)


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, per row of ``docs``.

    Ranges of doc_id, descending, are found on the ids alone; each range also gets
    the first row of the one after it, so that every text meets its successor in
    one shuffle of the texts."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    ids = docs.select(key.alias("key")).repartitionByRange(parts, F.desc("key"))
    ranges = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("high")).collect()  # one row per range
    if not ranges:
        return spark.createDataFrame([], RESULT)
    lows, highs = (F.array(*[F.lit(r[c]) for r in ranges]) for c in ("low", "high"))
    n = len(ranges)
    part = F.size(F.filter(lows, lambda x: x > F.col("key"))).alias("part")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key")).withColumn("part", part)
    before = F.struct(F.pmod(F.col("part") - 1, F.lit(n)).alias("part"), F.lit(1).alias("ahead"))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("ahead"))
    to = F.when(F.array_contains(highs, F.col("key")), F.array(own, before)).otherwise(F.array(own))
    dealt = rows.withColumn("to", F.explode(to)).select("doc_id", "text", "key", "to.part", "to.ahead")
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "ahead", F.desc("key"), "text").mapInArrow(_chained, RESULT)


def _words32(mark: Column) -> Column:
    return F.array(*[F.conv(F.substring(mark, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(BITS // 32)])


def near_pairs(marks: DataFrame, radius: int) -> DataFrame:
    """(a, b, distance) of all pairs of distinct ``fingerprint`` values within ``radius`` bits.

    The hex digits are cut into ``radius + 2`` blocks.  Within the radius at least
    two blocks are equal, so a table for each pair of blocks, keyed by both, finds
    every pair; fingerprints of equal documents meet once."""
    blocks = radius + 2
    digits = BITS // 4
    if blocks > digits:
        raise ValueError("the radius leaves no block of a digit")
    edge = [digits * k // blocks for k in range(blocks + 1)]
    cut = lambda k: F.substring("fingerprint", edge[k] + 1, edge[k + 1] - edge[k])
    tables = F.array(*[F.concat(F.lit(f"{i}.{j}."), cut(i), cut(j)) for i, j in combinations(range(blocks), 2)])
    keyed = marks.select("fingerprint").where("fingerprint is not null").distinct().select("fingerprint", _words32(F.col("fingerprint")).alias("w"), F.explode(tables).alias("key"))
    a = keyed.select(F.col("fingerprint").alias("a"), F.col("w").alias("wa"), "key")
    b = keyed.select(F.col("fingerprint").alias("b"), F.col("w").alias("wb"), "key")
    distance = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return a.join(b, "key").where("a < b").select("a", "b", distance.alias("distance")).where(F.col("distance") <= radius).distinct()
