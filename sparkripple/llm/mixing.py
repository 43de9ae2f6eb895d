"""Mixing of sources to target weights.

Method: pivotal dependent rounding. A source's documents all carry the same
expected number of copies, target / size; the fractional parts are paired and a
random transfer of word mass makes one of each pair integral, so the words of a
source are kept while every document keeps its probability. Documents are dealt
into buckets of bounded size, each bucket leaves one fractional residual, and
residuals of FAN buckets are combined in turn until one is left for a source:
a reduction tree of grouped Spark stages. The last residual is taken in part.

Rows of equal id, source, size and content hash are counted first, then dealt as
that many documents, so repeated ids and rows without one spread over all
buckets. The randomness comes from hashes of these and of the number among such
equals, so reruns agree however the input is partitioned. Null texts have no
words and are never taken; a null source is a source of its own, ordered last.
Repeated rows are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkripple.llm.common import carried, cut, n_words, restored

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
BUCKET_DOCS = 4096
FAN = 64
#: More equal rows than this are dealt in runs of so many, by several tasks.
RUN = 4096
#: Sources up to this many go to all executors (some hundred bytes each); beyond, the join is by shuffle.
BROADCAST_SOURCES = 20_000
ROWS = "doc_id string, source string, size long, content long, source_size long, target double, whole long, part double, mark long, bucket long"


def ranked(sources: DataFrame) -> DataFrame:
    """sources with their rank from 0 by code point, null last; sorted in ranges, so no task has all."""
    order = F.col("source").asc_nulls_last()
    placed = cut(sources.repartitionByRange(order).sortWithinPartitions(order).withColumns({"task": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    # One number per shuffle partition, as many as the cluster's setting says.
    starts, before = {}, 0
    for r in placed.groupBy("task").agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect():
        starts[r["task"]] = before
        before += r["n"]
    start = F.element_at(F.lit([starts.get(t, 0) for t in range(max(starts, default=0) + 1)]), F.col("task") + 1)
    return placed.withColumn("rank", start + F.col("at")).drop("task", "at")


def targets(counted: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per source: n_docs, source_size, target; counted is (source, size, n), n documents of that size.

    Resharing what targets lose at their cap by weight ends where every target is
    min(cap, level * weight) for one level. The level rises from equal shares by
    one aggregate a round, until no further source is at its cap.
    """
    per = ranked(counted.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    level, capped = 0.0, -1
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        now = per.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if now[0] == capped or not now[2]:
            break
        # Whole numbers up to here, so the level doesn't depend on the order of sums.
        capped, level = now[0], (total - now[1]) / now[2]
    return per.select("source", "n_docs", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mixed_bits(ids: np.ndarray, level: int) -> np.ndarray:
    """Well mixed 64-bit values of the ids, others at every level."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def pivot(sizes: list[int], parts: list[float], draws: list[float]) -> tuple[list[float], int | None]:
    """Round the parts to 0 or 1 by pairwise transfers of words; the index of the one left fractional, if any."""
    eps = 1e-9
    held = None
    for i, size in enumerate(sizes):
        if not size or parts[i] <= eps or parts[i] >= 1 - eps:
            parts[i] = float(bool(size) and parts[i] > 0.5)
            continue
        if held is None:
            held = i
            continue
        j, s, t = held, sizes[held], size
        up = min((1 - parts[j]) * s, parts[i] * t)
        down = min(parts[j] * s, (1 - parts[i]) * t)
        moved = up if draws[i] * (up + down) < down else -down
        parts[j] += moved / s
        parts[i] -= moved / t
        open_ones = []
        for k in (j, i):
            if eps < parts[k] < 1 - eps:
                open_ones.append(k)
            else:
                parts[k] = float(parts[k] > 0.5)
        held = open_ones[0] if open_ones else None
    return parts, held


def rounded(level: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        bits = mixed_bits(group["mark"].to_numpy(dtype=np.int64), level)
        order = np.lexsort((group["size"].to_numpy(), bits))
        group = group.iloc[order].reset_index(drop=True)
        draws = (mixed_bits(bits[order].view(np.int64), level + 100) >> np.uint64(11)) / float(1 << 53)
        parts, held = pivot(group["size"].tolist(), group["part"].tolist(), draws.tolist())
        group["part"] = parts
        group["open"] = np.arange(len(group)) == (-1 if held is None else held)
        return group

    return run


def dealt(counted: DataFrame) -> DataFrame:
    """counted with a row per document, mark a hash that tells equal ones apart."""
    keys = ["doc_id", "source", "size", "content"]
    few = counted.filter(F.col("n") <= RUN).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    runs = counted.filter(F.col("n") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN)))).repartition(*keys, "run")
    first = F.col("run") * RUN
    many = runs.withColumn("k", F.explode(F.sequence(first, F.least(first + RUN, "n") - 1))).drop("run")
    return few.unionByName(many).withColumn("mark", F.xxhash64("doc_id", "size", "content", "k")).drop("n", "k")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, content: Column | None = None) -> DataFrame:
    """One row per document: size, content, source_size, target, taken (words), whole (full copies), part (of one more copy).

    content is a number that tells documents of one id, source and size apart, 0 for all unless given.
    """
    content = F.lit(0) if content is None else content
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size"), content.cast("long").alias("content"))
    counted = cut(sizes.groupBy("doc_id", "source", "size", "content").agg(F.count(F.lit(1)).alias("n")))
    sizes = dealt(counted)
    per = cut(targets(counted, weights, most))
    n_sources, largest = per.agg(F.count(F.lit(1)), F.coalesce(F.max("n_docs"), F.lit(0))).first()
    side = (F.broadcast(per) if n_sources <= BROADCAST_SOURCES else per).withColumnRenamed("source", "of")
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = (
        sizes.join(side, sizes["source"].eqNullSafe(side["of"]))
        .withColumn("copies", copies)
        .withColumn("whole", F.floor("copies"))
        .withColumn("part", F.col("copies") - F.col("whole"))
        .withColumn("bucket", F.pmod("mark", F.ceil(F.col("n_docs") / BUCKET_DOCS)))
        .withColumn("doc_id", carried())
        .select(*[c.split()[0] for c in ROWS.split(", ")])
    )
    level, buckets, settled = 0, math.ceil(largest / BUCKET_DOCS), []
    while True:
        done = cut(rows.groupBy("source", "bucket").applyInPandas(rounded(level), f"{ROWS}, open boolean"))
        if buckets <= 1:
            settled.append(done)
            break
        settled.append(done.filter(~F.col("open")))
        rows = done.filter("open").drop("open").withColumn("bucket", F.floor(F.col("bucket") / FAN))
        level, buckets = level + 1, math.ceil(buckets / FAN)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    taken = F.col("size") * F.col("whole") + F.round(F.col("size") * F.col("part")).cast("long")
    return restored(out).select("doc_id", "source", "size", "content", "source_size", "target", taken.alias("taken"), "whole", "part")


def content_hash(docs: DataFrame) -> Column:
    """A hash of all columns but maps, which Spark doesn't hash."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The documents of the mix, each as often as it is taken; a document taken in part comes whole if at least half is taken.

    Rows are told apart by a hash of their columns (but maps); wholly equal rows stand
    for each other, so the rows that come are the same whatever the input's
    partitions and whichever task runs again.
    """
    plan = mix(docs, weights, most, content_hash(docs))
    times = F.col("whole") + F.when(F.col("part") >= 0.5, 1).otherwise(0)
    plan = cut(plan.groupBy("doc_id", "source", "size", "content").agg(F.sum(times).cast("int").alias("times"), F.count(F.lit(1)).alias("n")).filter("times > 0"))
    # The documents as one column, so that none of theirs can clash with the plan's.
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")
    own = docs.select(whole, n_words("text").alias("own_size"), content_hash(docs).alias("own_content"))
    match = F.col("document.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & F.col("document.source").cast("string").eqNullSafe(F.col("source")) & (F.col("own_size") == F.col("size")) & (F.col("own_content") == F.col("content"))
    single, equal = plan.filter("n = 1"), plan.filter("n > 1")
    out = own.join(single, match).select("document", "times")
    if not equal.isEmpty():
        keys = ["doc_id", "source", "size", "content"]
        out = out.unionByName(own.join(equal, match).dropDuplicates(keys).select("document", "times"))
    copy = F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")
    return out.select("document", copy).select(*(F.col("document").getField(c).alias(c) for c in docs.columns))
