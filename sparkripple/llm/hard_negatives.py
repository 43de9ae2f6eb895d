"""Hard negatives: unlike rows that score close below a like one.

Method: blocked dense products. Anchors are taken in blocks of bounded size; a
block is broadcast and every task multiplies it with its own candidates, batch by
batch, in double precision where that is exact. First each task keeps the best
positives of every anchor, which are merged to the best of all; then, with the
scores of these, each task keeps the best negatives in the window of every anchor
and positive, merged likewise. What a task keeps is bounded by the block, and the
candidates never move: no label, vector or id has a task of its own.

A candidate is set against the worst of the best so far before anything is
sorted, ids deciding between equal scores, so crowds of equal vectors cost no more
than others.

Rows without an id, label or vector, or with null or non-finite components, take
no part; vectors of different lengths have no product and don't meet. Rows of one
id are rows of their own, an anchor is no positive of itself. Anchors without
positives, and windows without negatives, give no rows; so does an empty table.
Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkripple.llm.common import cut, shared_folder
from sparkripple.llm.vectors import is_sound, products, quantised

POSITIVES = 5
NEGATIVES = 3
#: A negative's score is from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
#: Anchors that are broadcast at once, fewer where vectors are long.
BLOCK = 8192
BLOCK_BYTES = 64 << 20
#: Rows of a block and candidates that are multiplied at once.
ROWS, COLUMNS = 1024, 2048
#: The places of a list that hold nothing yet: a score below all, an id above all.
NO_SCORE, NO_ID = -(1 << 62), (1 << 63) - 1
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
KEPT = "of long, score long, id long, row long"


class Best:
    """The k best (score, id, row) of each of so many lists: higher scores first, then smaller ids."""

    def __init__(self, lists: int, k: int):
        self.score = np.full((lists, k), NO_SCORE)
        self.id = np.full((lists, k), NO_ID)
        self.row = np.full((lists, k), NO_ID)

    def offer(self, to: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        last = self.score[to, -1]
        better = (score > last) | ((score == last) & (ids < self.id[to, -1]))
        to, score, ids, rows = to[better], score[better], ids[better], rows[better]
        if not len(to):
            return
        k = self.score.shape[1]
        lists = np.unique(to)
        to = np.concatenate([np.repeat(lists, k), to])
        score, ids, rows = (np.concatenate([held[lists].ravel(), new]) for held, new in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score, to))
        to = to[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        few = place < k
        order, to, place = order[few], to[few], place[few]
        self.score[to, place], self.id[to, place], self.row[to, place] = score[order], ids[order], rows[order]

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        """All that is held, under the names of the lists."""
        i, j = np.nonzero(self.score > NO_SCORE)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (names[i], self.score[i, j], self.id[i, j], self.row[i, j])], ["of", "score", "id", "row"])


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(vectors, labels, ids, rows) of a batch by the vectors' length, a few at first and then more at once."""
    sizes = np.array(batch.column("v").value_lengths())
    for dim in np.unique(sizes):
        part = batch.filter(pa.array(sizes == dim))
        x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), dim)
        label, ids, rows = (part.column(c).to_numpy() for c in ("label", "vec_id", "row"))
        at, step = 0, 64
        while at < len(x):
            own = slice(at, at + step)
            yield x[own], label[own], ids[own], rows[own]
            at, step = at + step, min(COLUMNS, 2 * step)


def anchor_pieces(block: dict, dim: int) -> Iterator[np.ndarray]:
    own = block["by_dim"].get(dim, ())
    for at in range(0, len(own), ROWS):
        yield own[at : at + ROWS]


def best_positives(shared, k: int):
    """Per task the k best positives of each anchor of the block, under the anchor's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = Best(len(block["row"]), k)
        for batch in batches:
            for x, label, ids, rows in pieces(batch):
                for all_of in anchor_pieces(block, x.shape[1]):
                    for value in np.unique(label):
                        own, at = all_of[block["label"][all_of] == value], np.flatnonzero(label == value)
                        if not len(own):
                            continue
                        scores = products(stacked(block, own), x[at])
                        i, j = np.nonzero((scores >= best.score[own, -1][:, None]) & (rows[at] != block["row"][own][:, None]))
                        best.offer(own[i], scores[i, j], ids[at[j]], rows[at[j]])
        yield best.batch(block["row"])

    return run


def best_negatives(shared, k: int):
    """Per task the k best negatives of each anchor and positive, under the pair's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        pair, low, high = block["pair"], block["low"], block["high"]
        best = Best(len(block["pair_names"]), k)
        for batch in batches:
            for x, label, ids, rows in pieces(batch):
                for own in anchor_pieces(block, x.shape[1]):
                    # What the least demanding window of each anchor still takes.
                    floor = np.where(pair[own] >= 0, np.maximum(low[own], best.score[pair[own], -1]), NO_ID).min(axis=1)
                    roof = high[own].max(axis=1)
                    scores = products(stacked(block, own), x)
                    i, j = np.nonzero((scores >= floor[:, None]) & (scores <= roof[:, None]) & (label != block["label"][own][:, None]))
                    found, own_i = scores[i, j], own[i]
                    for slot in range(pair.shape[1]):
                        inside = (pair[own_i, slot] >= 0) & (found >= low[own_i, slot]) & (found <= high[own_i, slot])
                        best.offer(pair[own_i[inside], slot], found[inside], ids[j[inside]], rows[j[inside]])
        yield best.batch(block["pair_names"])

    return run


def stacked(block: dict, own: np.ndarray) -> np.ndarray:
    return np.stack([block["v"][i] for i in own])


def merged(kept: DataFrame, k: int) -> DataFrame:
    """The k best of what the tasks kept, with their place from 1; a list has at most k rows of each task."""
    place = F.row_number().over(Window.partitionBy("of").orderBy(F.col("score").desc(), "id", "row"))
    return kept.withColumn("place", place).filter(F.col("place") <= k)


def block_of(anchors: list, positives: list, k: int) -> tuple[dict, dict]:
    """The block with its pairs: per anchor and place the pair's number (-1 for none) and window; and each pair's positive."""
    at = {r["row"]: i for i, r in enumerate(anchors)}
    shape = (len(anchors), k)
    pair, low, high = np.full(shape, -1), np.full(shape, NO_ID), np.full(shape, NO_SCORE)
    of = {}
    for n, p in enumerate(positives):
        spot = at[p["of"]], p["place"] - 1
        pair[spot], low[spot], high[spot] = n, -(-LOW * p["score"] // 100), HIGH * p["score"] // 100
        of[n] = (anchors[spot[0]]["vec_id"], p["id"], p["score"])
    return {"pair": pair, "low": low, "high": high, "pair_names": np.arange(len(positives))}, of


def of_block(rows: DataFrame, anchors: list, positives: int, negatives: int, path: str) -> None:
    """Write the negatives of a block of anchors, as collected, to path."""
    spark = rows.sparkSession
    sizes = np.array([len(r["v"]) for r in anchors])
    block = {"row": np.array([r["row"] for r in anchors]), "label": np.array([r["label"] for r in anchors]), "v": [np.array(r["v"], dtype=np.int64) for r in anchors], "by_dim": {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}}
    shared = spark.sparkContext.broadcast(block)
    found = merged(rows.mapInArrow(best_positives(shared, positives), KEPT), positives).collect()
    shared.destroy()
    windows, of = block_of(anchors, found, positives)
    shared = spark.sparkContext.broadcast(block | windows)
    pairs = spark.createDataFrame([(n, *x) for n, x in of.items()], "pair long, anchor_id long, positive_id long, positive_score long")
    best = merged(rows.mapInArrow(best_negatives(shared, negatives), KEPT), negatives)
    out = best.join(F.broadcast(pairs), F.col("of") == F.col("pair")).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out.write.parquet(path)
    shared.destroy()


def mine(vectors: DataFrame, anchor: Column | str = "vec_id % 50 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and the two scores, of vectors(vec_id, label, embedding) whose anchors the condition names."""
    spark: SparkSession = vectors.sparkSession
    own = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL").filter(is_sound("embedding"))
    rows = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised("embedding").alias("v"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    asked = rows.filter(anchor)
    longest = asked.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], OUT)
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, longest))))
    folder, last, n = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}", -1, 0
    while block := asked.filter(F.col("row") > last).orderBy("row").limit(size).collect():
        of_block(rows, block, positives, negatives, f"{folder}/block={n}")
        last, n = block[-1]["row"], n + 1
    return spark.read.schema(OUT).parquet(*(f"{folder}/block={i}" for i in range(n)))
