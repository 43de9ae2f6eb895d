"""Sets of diffs as bits, so that work on many diffs is done once for up to 64 of them.

A mask is a row (..., word, bits): bit i of bits stands for diff number 64 * word + i.
A class that many diffs reach is a row for each 64 of them, and sets are joined by
bit_or, which combines before a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkripple.operators.iterate import kept


#: So many diffs are sent to all tasks, so that rows aren't dealt out by diff to be numbered or named.
FEW_DIFFS = 50_000


def numbered(diffs: DataFrame) -> DataFrame:
    """(diff_id, number) of distinct diffs, written; numbers follow one another within what a task holds, so masks are dense."""
    own = kept(diffs.select("diff_id").distinct().withColumn("number", F.monotonically_increasing_id()))
    return F.broadcast(own) if own.count() <= FEW_DIFFS else own


def masked(rows: DataFrame, numbers: DataFrame, *by: str) -> DataFrame:
    """rows(diff_id, by) as masks (by, word, bits)."""
    own = rows.select("diff_id", *by).join(numbers, "diff_id")
    bit = F.expr("shiftleft(1L, cast(number & 63 AS int))")
    return own.groupBy(*by, F.shiftright("number", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def merged(masks: DataFrame, *by: str) -> DataFrame:
    """masks (by, word, bits) with one row for each by and word."""
    return masks.groupBy(*by, "word").agg(F.bit_or("bits").alias("bits"))


def without(masks: DataFrame, held: DataFrame, *by: str) -> DataFrame:
    """masks less the bits of held, both one row for each by and word."""
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("held", F.lit(0).cast("long"))))
    return masks.join(held.withColumnRenamed("bits", "held"), [*by, "word"], "left").select(*by, "word", rest.alias("bits")).filter("bits <> 0")


def of_diffs(masks: DataFrame, numbers: DataFrame, *by: str) -> DataFrame:
    """masks (by, word, bits) as rows (diff_id, by)."""
    each = F.expr("explode(filter(sequence(0, 63), i -> getbit(bits, i) = 1))")
    rows = masks.select(*by, "word", each.alias("i")).select(*by, (F.shiftleft("word", 6) + F.col("i")).alias("number"))
    return rows.join(numbers, "number").select("diff_id", *by)


def reached(links: DataFrame | Callable[[DataFrame], DataFrame], seen: DataFrame, frontier: DataFrame, depth: int, target: Callable[[Column], Column]) -> DataFrame | None:
    """Masks (fqn, word, bits, hop) of what links(target, fqn) lead to from frontier(target, word, bits) within depth steps and seen(fqn, word, bits) lacks.

    Links that are made as they are needed are a function of the hop's frontier. Each bit is found at its first hop only, so all hops together write each once; a
    hop reads the links once, however many diffs there are.
    """
    found = None
    for hop in range(1, depth + 1):
        own = links(frontier) if callable(links) else links
        step = merged(own.join(frontier, "target").select("fqn", "word", "bits"), "fqn")
        new = kept(without(step, seen, "fqn").withColumn("hop", F.lit(hop)))
        if hop < depth and new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        if hop < depth:
            seen = merged(seen.unionByName(new.drop("hop")), "fqn")
            frontier = merged(new.select(target(F.col("fqn")).alias("target"), "word", "bits"), "target")
    return found
