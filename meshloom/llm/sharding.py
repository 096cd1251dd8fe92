"""Vector bin packing of documents into shards.

Bytes, words and rows are balanced jointly.  The items are groups of equal
texts; the group goes where the dot product of its demand and the shard's
residual capacity is highest, large groups first.

The driver packs a bounded number of items: a group with at least
``1 / (HEAVY * shards)`` of any total is an item of its own, and there are at
most ``3 * HEAVY * shards`` of those; the others are bundled by a hash of their
text into ``BUNDLES`` items that keep equal texts together.  A group beyond
``1 / PIECE`` of a shard is split into pieces by doc_id, since a key that holds
a third of all rows fits no shard.

Defined results: a null text counts as an empty one; rows that repeat a doc_id
are rows of their own; other columns are ignored; an empty table gives an empty
result.  Slots number a shard's rows from 0 without gaps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialize

SHARDS, OVERHEAD = 24, 8
HEAVY, BUNDLES, PIECE = 32, 1 << 14, 2
SLOT_ROWS = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"


def pack(demand: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; ``demand`` has a row per item and a column per dimension.

    Demands and residuals are shares of a shard's fair part.  Shards that would
    overflow in the first dimension are passed over while another has room."""
    total = demand.sum(0)
    share = demand * shards / np.where(total > 0, total, 1)
    residual = np.ones((shards, demand.shape[1]))
    out = np.zeros(len(demand), np.int64)
    for i in np.argsort(-share.max(1), kind="stable"):
        score = residual @ share[i]
        room = (residual >= share[i]).all(1)
        if not room.any():
            room = residual[:, 0] >= share[i, 0]
        if not room.any():  # the law on bytes decides once nothing fits
            score, room = residual[:, 0], np.ones(shards, bool)
        k = int(np.argmax(np.where(room, score, -np.inf)))
        out[i] = k
        residual[k] -= share[i]
    return _evened(share[:, 0], out, shards)


def _evened(size: np.ndarray, out: np.ndarray, shards: int) -> np.ndarray:
    """Moves or swaps items between the fullest and the emptiest shard while that narrows the first dimension."""
    load = np.bincount(out, size, shards)
    for _ in range(40 * shards):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        if gap < 1e-4:
            break
        a, b = np.flatnonzero(out == hi), np.flatnonzero(out == lo)
        if not len(a):
            break
        order = b[np.argsort(size[b], kind="stable")]
        small = np.concatenate(([0.0], size[order]))
        want = size[a] - gap / 2  # of the partner, for an exact halving
        at = np.clip(np.searchsorted(small, want), 1, len(small)) - 1
        near = np.stack([at, np.minimum(at + 1, len(small) - 1)])
        moved = size[a] - small[near]
        off = np.where((moved > 0) & (moved < gap), np.abs(moved - gap / 2), np.inf)
        r, c = np.unravel_index(int(off.argmin()), off.shape)
        if not np.isfinite(off[r, c]):
            break
        out[a[c]] = lo
        if near[r, c]:
            out[order[near[r, c] - 1]] = hi
        load = np.bincount(out, size, shards)
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, tokens, text_crc32, law, shard, slot, grown_shard per row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    sized = materialize(
        docs.select(
            "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("tokens"),
            F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64(text).alias("key"),
        ),
        "shard-sizes",
    )
    n, size, tokens = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    part = 1 / (HEAVY * shards)
    groups = sized.groupBy("key").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    biggest = F.greatest(F.col("size") / max(size, 1), F.col("tokens") / max(tokens, 1), F.col("n") / max(n, 1))
    heavy = materialize(
        groups.where(biggest >= part).select("key", F.ceil(biggest * shards * PIECE).cast("long").alias("pieces")).withColumn(
            "pieces", F.when(F.col("pieces") <= PIECE, F.lit(1)).otherwise(F.col("pieces"))
        ),
        "shard-heavy",
    )
    # a proven bound: at most 3 * HEAVY * shards rows
    dealt = sized.join(F.broadcast(heavy), "key", "left").select(
        "doc_id", "size", "tokens", "text_crc32",
        F.when(F.col("pieces").isNull(), F.pmod("key", F.lit(BUNDLES))).otherwise(F.col("key")).alias("item"),
        F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).cast("long").alias("piece"),
    )
    dealt = materialize(dealt, "shard-dealt")
    items = dealt.groupBy("item", "piece").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).orderBy("piece", "item").toPandas()
    items["shard"] = pack(items[["size", "tokens", "n"]].to_numpy(np.float64), shards)
    items["parts"] = -(-items["n"] // SLOT_ROWS)
    placed = spark.createDataFrame(items[["item", "piece", "shard", "parts"]], "item long, piece long, shard int, parts long")
    rows = dealt.join(F.broadcast(placed), ["item", "piece"]).withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.col("parts")))
    counts = rows.groupBy("shard", "item", "piece", "part").agg(F.count(F.lit(1)).alias("k"))
    base = counts.withColumn("base", F.sum("k").over(W.partitionBy("shard").orderBy("piece", "item", "part").rowsBetween(W.unboundedPreceding, 0)) - F.col("k"))
    base = materialize(base.drop("k", "shard"), "shard-bases")
    inside = W.partitionBy("item", "piece", "part").orderBy("doc_id", "size", "text_crc32")
    return rows.join(base, ["item", "piece", "part"]).select(
        "doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.row_number().over(inside) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
