"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of
the words it holds; the document's is their noisy-or, 1 - prod(1 - p). Only
document labels train it; the sentence scores then locate the offending ones.

Features are lower-cased words and their prefixes of 4 to 6 letters, so that
inflected and glued forms share weight, hashed to HASHED values. The model is
fitted on at most about TRAIN_DOCS labelled documents chosen by a hash of their
id, one text per id: a distributed pass counts their features by label, the MOST_FEATURES of the
largest chi-square towards toxic are kept, and only the sentences that hold one
reach the driver, as feature numbers. The sampling bound is a 63-bit hash, so that
it holds at any number of labels.

Whole texts are scored. Null and empty texts have one empty sentence and so the
base score. Without a positive label all scores are 0. Repeated rows get equal
scores, extra columns are carried along whatever their names, an empty table gives
no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkripple.llm.common import cut, fold, hash63, share_bound

HASHED = 1 << 20
PREFIXES = (4, 5, 6)
MOST_FEATURES = 4096
TRAIN_DOCS = 20_000
#: Least chi-square (one degree of freedom) of a kept feature, about one chance in a million.
LEAST_CHI = 24.0
HELD_OUT = (5, 0)
#: Weight of half the squared weights in the loss.
PENALTY = 2e-2
#: Rows that are scored and handed on at a time.
ROWS = 512
#: Words whose features a task keeps at hand, some 150 bytes each.
MOST_WORDS = 1 << 17
WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[.!?\n]+")


def features(word: str) -> tuple[int, ...]:
    """Hashed ids of the word and its prefixes."""
    forms = {f"={word}"} | {word[:n] for n in PREFIXES if len(word) >= n}
    return tuple(zlib.crc32(x.encode()) % HASHED for x in forms)


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ROWS rows, so that few texts are Python's at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the features by label, over one partition."""
    seen = np.zeros((2, HASHED), dtype=np.int64)
    known: dict[str, tuple[int, ...]] = {}
    for batch in sliced(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            ids: set[int] = set()
            for word in set(words(text)):
                if word not in known:
                    if len(known) >= MOST_WORDS:
                        known.clear()
                    known[word] = features(word)
                ids.update(known[word])
            seen[int(toxic), np.fromiter(ids, dtype=np.int64, count=len(ids))] += 1
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, seen[0, at], seen[1, at])], ["feature", "clean", "toxic"])


def chosen_features(labelled: DataFrame, n_clean: int, n_toxic: int, most: int) -> list[int]:
    df = labelled.mapInArrow(count_features, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    n, both = n_clean + n_toxic, F.col("c") + F.col("t")
    expected = both * (n_toxic / n)
    chi = F.pow(F.col("t") - expected, 2) / (expected * (1 - n_toxic / n) + 1e-9)
    top = df.filter((F.col("t") > expected) & (F.col("t") >= 3) & (chi >= LEAST_CHI)).orderBy(chi.desc(), "feature").limit(most)
    return [r["feature"] for r in top.select("feature").collect()]


def sentences(text: str, weight_of: dict[int, int], known: dict[str, tuple[int, ...]]) -> tuple[list[str], list[set[int]]]:
    """The text's sentences and the kept features of each."""
    parts = SENTENCES.split(text)
    found = []
    for part in parts:
        own: set[int] = set()
        for word in words(part):
            if word not in known:
                if len(known) >= MOST_WORDS:
                    known.clear()
                known[word] = tuple(weight_of[f] for f in features(word) if f in weight_of)
            own.update(known[word])
        found.append(own)
    return parts, found


def instances(chosen: list[int]):
    """Per training document: its label, number of sentences and the kept features of the sentences that have any."""
    at = {f: i for i, f in enumerate(chosen)}

    schema = pa.schema([("toxic", pa.int32()), ("n", pa.int32()), ("lengths", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in sliced(batches):
            rows = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                parts, found = sentences(text, at, known)
                full = [sorted(x) for x in found if x]
                rows.append((int(toxic), len(parts), [len(x) for x in full], [i for x in full for i in x]))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


class Bags:
    """Training documents as bags of sentences in flat arrays."""

    def __init__(self, rows: pd.DataFrame):
        none = np.zeros(0, dtype=np.int64)
        lengths = [np.asarray(x, dtype=np.int64) for x in rows["lengths"]]
        per_doc = np.array([len(x) for x in lengths])
        self.y = rows["toxic"].to_numpy(dtype=float)
        self.bag = np.repeat(np.arange(len(self.y)), per_doc)
        self.sizes = np.concatenate([*lengths, none])
        self.sent = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.ids = np.concatenate([*(np.asarray(x, dtype=np.int64) for x in rows["ids"]), none])
        self.bare = rows["n"].to_numpy() - per_doc


def loss_and_gradient(w: np.ndarray, b: float, x: Bags) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the labels under the noisy-or with the weights' penalty, and its gradient by w, then b."""
    z = np.clip(b + np.bincount(x.sent, w[x.ids], minlength=len(x.sizes)), -30, 30)
    p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
    log_clean = np.bincount(x.bag, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(x.y)) + x.bare * np.log1p(-p0)
    doc = np.clip(-np.expm1(log_clean), 1e-9, 1)
    # d loss / d log_clean: 1 - y / doc, carried to each sentence by d log(1 - p) / dz = -p
    pull = 1 - x.y / doc
    g_sent = pull[x.bag] * p
    grad = np.append(np.bincount(x.ids, g_sent[x.sent], minlength=len(w)) + PENALTY * w, g_sent.sum() + (pull * x.bare).sum() * p0)
    loss = -(x.y * np.log(doc) + (1 - x.y) * log_clean).sum() + PENALTY * (w @ w) / 2
    n = max(1, len(x.y))
    return loss / n, grad / n


def fit(rows: pd.DataFrame, n_features: int, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of the document labels under the noisy-or."""
    x = Bags(rows)
    w, b = np.zeros(n_features), -6.0
    moments = np.zeros((2, n_features + 1))
    for step in range(1, steps + 1):
        grad = loss_and_gradient(w, b, x)[1]
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], float(np.clip(b - move[-1], -12, 2))
    return w, b


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, most: int = MOST_FEATURES) -> tuple[dict[int, float], float]:
    """The weights by hashed feature and the bias, from labelled documents outside the held-out fold."""
    n, rest = HELD_OUT
    marks = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max("toxic").alias("toxic")).filter(fold("labelled_id", n) != rest)
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(1):
        return {}, -30.0
    share = min(1.0, train_docs / sum(counts.values()))
    chosen_rows = marks.filter(hash63("labelled_id", F.lit("toxicity")) <= share_bound(share))
    # About train_docs ids and labels at most, some 20 bytes each, whatever the size of the corpus.
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text")
    labelled = texts.join(F.broadcast(chosen_rows), F.col("doc_id") == F.col("labelled_id")).select("labelled_id", "text", "toxic")
    labelled = cut(labelled)
    if not labelled.groupBy("labelled_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        # Of an id with several rows one is learnt from, so that no repeated id outgrows the bound.
        labelled = cut(labelled.groupBy("labelled_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))
    labelled = labelled.select("text", "toxic")
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(1):
        return {}, -30.0
    chosen = chosen_features(labelled, counts.get(0, 0), counts[1], most)
    rows = labelled.mapInArrow(instances(chosen), "toxic int, n int, lengths array<int>, ids array<int>").toPandas()
    if rows.empty or not rows["toxic"].any():
        return {}, -30.0
    w, b = fit(rows, len(chosen))
    return {f: float(x) for f, x in zip(chosen, w) if abs(x) > 1e-3}, b


def scorer(weights: dict[int, float], bias: float):
    ids = list(weights)
    at, w = {f: i for i, f in enumerate(ids)}, np.array([weights[f] for f in ids])
    base = float(np.log1p(-1 / (1 + np.exp(-bias))))

    def score(text: str, known: dict) -> tuple[float, list[str]]:
        """The document's score and its sentences that are likelier toxic than not."""
        parts, found = sentences(text, at, known)
        clean, bad = 0.0, []
        for part, own in zip(parts, found):
            if not own:
                clean += base
                continue
            p = 1 / (1 + float(np.exp(-np.clip(bias + w[list(own)].sum(), -30, 30))))
            clean += float(np.log1p(-min(p, 1 - 1e-12)))
            if p >= 0.5:
                bad.append(part.strip())
        return min(1.0, max(0.0, -float(np.expm1(clean)))), bad

    return score


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, sentences that offend."""
    n, rest = HELD_OUT
    weights, bias = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, known = scorer(weights, bias), {}
        for part in sliced(batches):
            got = [one(text or "", known) for text in part.column("text").to_pylist()]
            scores = [x[0] for x in got]
            own = [part.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array([x[1] for x in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "score", "predicted", "sentences"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, sentences array<string>")
    return own.select("doc_id", (fold("doc_id", n) == rest).alias("held_out"), "score", "predicted", "sentences")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns, which pass through untouched."""
    weights, bias = train(docs, labels)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, known = scorer(weights, bias), {}
        for part in sliced(batches):
            yield part.filter(pa.array([one(text or "", known)[0] < 0.5 for text in part.column(at_text).to_pylist()]))

    return docs.mapInArrow(run, docs.schema)
