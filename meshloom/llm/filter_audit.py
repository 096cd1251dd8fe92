"""What every order of a set of filters removes, from one count of filter masks.

A document's mask has a bit for each filter that it fails.  Counts of masks by part
are summed over the subsets of every mask (a subset-zeta transform): the entry of a
set of masks' bits then counts the documents that fail no filter outside of it, which
are the survivors of the filters outside.  A step of an order is the difference of
two neighbouring subsets, so that no order is ever run.

Defined results: a null text is empty, a null part the empty string; a label counts
if any row of its document has it; a document without an id has no label, is no copy
and makes none; rows that repeat an id are documents of their own, and copies of the
same least id are all kept; other columns are ignored; an empty table has no parts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"


def text_rules(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    capitals = F.length(F.regexp_replace(text, r"[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, rules: dict[str, Column], part: Column, copies: bool = True) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail; ``rules`` refer to a column text without nulls.

    With ``copies`` the bit after the rules' means that a smaller doc_id has the same text."""
    held = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(rules.values())), F.lit(0))
    names = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(5), "text").alias("h2")] if copies else []
    masked = held.select("doc_id", "part", bits.alias("mask"), *names)
    # rows without an id are dealt by place, as they find no label
    deal = F.when(F.col("doc_id").isNull(), F.spark_partition_id() + 1).otherwise(0).alias("_deal")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    per_id = masked.groupBy("doc_id", deal, *[c for c in masked.columns if c != "doc_id"]).agg(F.count(F.lit(1)).alias("n"))
    judged = per_id.join(known.withColumn("_deal", F.when(F.col("good") < 0, 1).otherwise(0)), ["doc_id", "_deal"], "left").na.fill(0, ["good", "toxic"])
    if copies:
        # at most one id of a text is its first; the join's keys are unique but for repeated rows, which were counted
        first = masked.where("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("_first"))
        judged = judged.join(first, ["doc_id", "h1", "h2"], "left")
        copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
        judged = judged.withColumn("mask", F.col("mask") + F.when(copy, 1 << len(rules)).otherwise(0))
    return judged.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def zeta_bit(counts: Column, k: int) -> Column:
    """One round of the transform: every index that has bit ``k`` gains the entry of the index without it."""
    bit = F.lit(1 << k)
    return F.transform(counts, lambda c, s: c + F.when(s.bitwiseAND(bit) > 0, F.get(counts, s - bit)).otherwise(0))


def steps(counts: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of ``letters`` and step, from counts of masks."""
    k, full = len(letters), (1 << len(letters)) - 1
    kinds = ("n", "good", "toxic")
    by_mask = [F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(full + 1)]).alias(c) for c in kinds]
    sums = counts.groupBy("part").agg(*by_mask)
    for b in range(k):  # a projection a bit, so that the expression doesn't double
        sums = sums.select("part", *[zeta_bit(F.col(c), b).alias(c) for c in kinds])
    alive = sums.select("part", *[F.reverse(c).alias(c) for c in kinds])  # the entry of a set now stands at its complement: the filters applied
    removed = lambda c, s, f: F.get(c, s) - F.get(c, s.bitwiseOR(f))
    # a subset of so many filters stands before a given one in size! * (k - 1 - size)! orders
    orders_before = F.array(*[F.lit(factorial(size) * factorial(k - 1 - size)) for size in range(k)])
    without = lambda f: F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(f) == 0)
    share = lambda f: F.aggregate(without(f), F.lit(0).cast("long"), lambda total, s: total + F.get(orders_before, F.bit_count(s)) * removed(F.col("n"), s, f))
    flags = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    alive = alive.withColumn("shapley", F.transform(flags, share))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    each = alive.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    place = lambda i: F.instr(F.lit(letters), F.substring(F.col("filter_order"), i, F.lit(1))) - 1
    set_of = lambda upto: F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i <= upto), F.lit(0), lambda s, i: s.bitwiseOR(F.call_function("shiftleft", F.lit(1), place(i))))
    each = each.select("*", place(F.col("step")).alias("which"), set_of(F.col("step")).alias("after")).withColumn("flag", F.call_function("shiftleft", F.lit(1), F.col("which")))
    before, flag = F.col("after") - F.col("flag"), F.col("flag")
    gone = removed(F.col("n"), before, flag)
    return each.select(
        "part", "filter_order", "step", F.get(F.col("n"), F.col("after")).alias("kept"), gone.alias("removed"),
        (removed(F.col("n"), F.lit(0), flag) - gone).alias("redundant"),
        removed(F.col("n"), F.lit(full) - flag, flag).alias("unique_fails"),
        removed(F.col("good"), before, flag).alias("good_lost"), removed(F.col("toxic"), before, flag).alias("toxic_lost"),
        F.get(F.col("shapley"), F.col("which")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, *, part: str = "source") -> DataFrame:
    """Every order of the text rules A to D and of E, the copies of smaller ids, by ``part``."""
    return steps(mask_counts(docs, labels, text_rules(F.col("text")), F.col(part).cast("string")), "ABCDE")
