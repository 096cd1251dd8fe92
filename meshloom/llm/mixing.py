"""Mixing sources to target weights by Sainte-Lague apportionment.

Equal-token blocks are seats and sources are parties.  The highest quotients
``votes / (2 n - 1)`` win, which gives integer block quotas per source; within a
source the same rule hands its blocks to hash shards in proportion to their
words.  Each shard then fills its quota with documents in a seeded order.
Everything is DataFrame expressions: no Python runs on the executors.

Defined results: a null or empty text has size 0 and nothing is taken from it;
a null source is a source of its own, last in order; repeated rows are separate
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
SEED = 20240607
CAP = 3


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def seeded(key: str, seed: int) -> Column:
    """31 bits of an MD5, the same in every SQL engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def sainte_lague(parties: DataFrame, votes: str, seats: str, order: list[str], within: list[str], out: str) -> DataFrame:
    """Adds ``out``: the seats each row wins among the rows of its group.

    ``seats`` is constant in a group.  Only seats whose quotient can lie near the
    last winning one become rows: a divisor slightly too large gives a safe lower
    bound for every party, one slightly too small an upper bound, so at most about
    three candidates a party are ranked and the cost doesn't follow the seats.
    """
    group = W.partitionBy(*within) if within else W.partitionBy()
    bounded = (
        parties.withColumn("_all", F.sum(votes).over(group).cast("double"))
        .withColumn("_parties", F.count(F.lit(1)).over(group))
        .withColumn(
            "_low",
            F.when(
                (F.col(seats) * 2 > F.col("_parties")) & (F.col("_all") > 0),
                F.greatest(F.lit(0), F.floor(F.col(votes) * (F.col(seats) - F.col("_parties") / 2) / F.col("_all") + 0.5) - 1),
            ).otherwise(F.lit(0)).cast("long"),
        )
        .withColumn(
            "_high",
            F.when(
                F.col("_all") > 0,
                F.when(F.col(votes) > 0, F.floor(F.col(votes) * (F.col(seats) + F.col("_parties") / 2) / F.col("_all") + 0.5) + 1).otherwise(F.lit(0)),
            ).otherwise(F.lit(0)).cast("long"),
        )
        .withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    )
    keys = [*within, *order]
    candidates = bounded.where("_high > _low").select(
        *keys, "_left", F.col(votes).alias("_votes"), F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_n")
    ).withColumn("_quotient", F.col("_votes") / (2 * F.col("_n") - 1))
    ranked = candidates.withColumn(
        "_rank", F.row_number().over(group.orderBy(F.desc("_quotient"), *[F.asc_nulls_last(c) for c in order], "_n"))
    )
    won = ranked.where(F.col("_rank") <= F.col("_left")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    left, right = bounded.alias("l"), won.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return left.join(right, same, "left").select(
        *[F.col(f"l.{c}") for c in parties.columns], (F.col("l._low") + F.coalesce(F.col("r._won"), F.lit(0))).alias(out)
    )


def source_targets(sized: DataFrame) -> DataFrame:
    """Per source: size, weight and target, with targets capped at CAP times the size.

    The capped shares are a water level: sources in order of cap / weight fill
    first, and the level is the first one that no longer exceeds the next cap.
    """
    everything = W.partitionBy()
    per = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", (F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1)
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_ratio", F.lit(CAP) * F.col("source_size") / F.col("weight"))
    )
    rising = everything.orderBy("_ratio", F.asc_nulls_last("source"))
    level = (F.col("_total") - F.coalesce(F.sum(F.lit(CAP) * F.col("source_size")).over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(
        rising.rowsBetween(0, W.unboundedFollowing)
    )
    return (
        per.withColumn("_level", level)
        .withColumn("_water", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
        .select(
            "source", "source_size", "_total",
            F.least(F.lit(CAP) * F.col("source_size").cast("double"), F.coalesce(F.col("_water") * F.col("weight"), F.lit(0.0))).alias("target"),
        )
    )


def row_hash() -> Column:
    return F.xxhash64("doc_id", F.coalesce("source", F.lit("\0")), "text")


def mix(docs: DataFrame, *, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """row, doc_id, source, size, source_size, target, taken for every row of ``docs``.

    ``row`` is a hash of id, source and text that equal rows alone share."""
    row = row_hash()
    sized = materialize(docs.select(row.alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sized).withColumn("seats", F.round(F.col("_total") / block_words).cast("long"))
    quotas = (
        sainte_lague(targets, "target", "seats", ["source"], [], "blocks")
        .withColumn("words", F.least(F.col("blocks") * block_words, F.col("source_size") * CAP))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)))
        .select(
            "source", "source_size", "target", "whole",
            (F.col("words") - F.col("whole") * F.col("source_size")).alias("rest"),
            F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("shards"),
        )
    )
    quotas = materialize(quotas, "mix-quotas")  # a few rows: its file size lets Spark broadcast it
    q, d = quotas.alias("q"), sized.alias("d")
    dealt = d.join(q, F.col("d.source").eqNullSafe(F.col("q.source"))).select(
        "d.row", "d.doc_id", "d.source", "d.size", "q.source_size", "q.target", "q.whole", "q.rest",
        F.pmod(seeded("d.doc_id", seed), F.col("q.shards")).alias("shard"), seeded("d.doc_id", seed + 1).alias("place"),
    )
    shards = dealt.groupBy("source", "shard", "rest").agg(F.sum("size").alias("shard_size")).withColumn(
        "seats", F.round(F.col("rest") / block_words).cast("long")
    )
    shard_quotas = materialize(
        sainte_lague(shards, "shard_size", "seats", ["shard"], ["source"], "blocks").select(
            "source", "shard", F.least(F.col("blocks") * block_words, F.col("shard_size")).alias("quota")
        ),
        "mix-shards",
    )
    a, b = dealt.alias("a"), shard_quotas.alias("b")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.shard") == F.col("b.shard"))).select("a.*", "b.quota")
    before = F.sum("size").over(W.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return joined.withColumn("_before", before).select(
        "row", "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("_before")))).cast("long").alias("taken"),
    )
