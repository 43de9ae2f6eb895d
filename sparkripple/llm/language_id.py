"""Language identification by nearest centroid.

A text is a TF-IDF vector of its hashed letter n-grams of 1 to 3 (lower case,
runs of other characters as one boundary), of length one. Each language has up
to CLUSTERS centroids from spherical k-means; the language of the closest by
cosine is predicted, and the score is that cosine. A text further away than
nearly all training texts of that centroid is marked rejected.

The classifier is fitted on a sample of about TRAIN_DOCS labelled texts, or LEAST
for each language where these are more, shared equally between languages and
chosen by a 63-bit hash of doc_id, one text per id. Centroids are made by a task
per language, so every language is learnt and only its centroids reach the
driver. All texts are predicted whole. Null texts and texts without a letter are `und` with score 0,
as is all without training rows. Repeated rows get equal results, extra columns
are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkripple.llm.common import carried, cut, fold, hash63, restored, share_bound

DIMENSIONS = 8192
CLUSTERS = 4
TRAIN_DOCS = 2400
#: So many texts of a language are drawn on average, so that none is left out by chance; all of a language with fewer.
LEAST = 40
HELD_OUT = (4, 2)
REJECTED_SHARE = 0.005
#: Texts are counted in pieces of so many characters, to bound memory; their counts are summed.
PIECE = 1 << 20


@cache
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams; None if there is no letter."""
    total = np.zeros(DIMENSIONS, dtype=np.int64)
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
        codes = np.where(letter_table()[codes], codes, 0)
        codes = np.concatenate([[0], codes[(codes > 0) | (np.concatenate([[1], codes[:-1]]) > 0)], [0]])
        if not codes.any():
            continue
        two = codes[:-1] * 8191 + codes[1:]
        three = two[:-1] * 131_071 + codes[2:]
        one = codes[codes > 0]
        for grams, salt in ((one, 1), (two, 2), (three, 3)):
            total += np.bincount((grams * 0x9E3779B1 + salt * 0x85EBCA6B >> 13) % DIMENSIONS, minlength=DIMENSIONS)
    return total if total.any() else None


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Language and counts of the texts that have a letter."""
    for batch in batches:
        rows = [(lang, c.astype(np.float32).tobytes()) for lang, text in zip(batch["lang"], batch["text"]) if (c := gram_counts(text)) is not None]
        yield pd.DataFrame(rows, columns=["lang", "counts"])


def holding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one partition the number of texts that hold each n-gram, and the number of texts as n-gram -1."""
    total, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for batch in batches:
        n += len(batch)
        for counts in batch["counts"]:
            total += np.frombuffer(counts, dtype=np.float32) > 0
    at = np.flatnonzero(total)
    yield pd.DataFrame({"gram": np.append(at, -1), "n": np.append(total[at], n)})


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means by cosine, started from texts far from one another."""
    centres = [x[0]]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin(np.max(x @ np.stack(centres).T, axis=1)))])
    centroids = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def centroids_of(idf: np.ndarray, clusters: int):
    """The centroids of one language and the cosine that nearly all its texts next to each reach."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ordered = sorted(group["counts"])
        x = vectors(np.stack([np.frombuffer(c, dtype=np.float32) for c in ordered]), idf)
        centres = spherical_means(x, clusters)
        cosines = x @ centres.T
        own, best = cosines.argmax(axis=1), cosines.max(axis=1)
        limits = [float(np.quantile(best[own == j], REJECTED_SHARE)) if (own == j).any() else 0.0 for j in range(len(centres))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "j": range(len(centres)), "centre": [c.astype(np.float32).tobytes() for c in centres], "limit": limits})

    return run


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, clusters: int = CLUSTERS) -> dict | None:
    n, rest = HELD_OUT
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("lang").cast("string").alias("lang"), "text").filter(fold("doc_id", n) != rest)
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per:
        return None
    each = max(LEAST, train_docs / len(per))
    bounds = {lang: share_bound(each / count) for lang, count in per.items()}
    bound = F.element_at(F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair)), F.col("lang"))
    sample = rows.filter(hash63("doc_id", F.lit("language")) <= bound)
    # Of an id with several rows one is learnt from, so that no repeated id outgrows the bound.
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("one")).select("one.lang", "one.text")
    # From here on a text is of a fixed size, its counts, however long it is.
    sample = cut(sample.mapInPandas(counted, "lang string, counts binary"))
    held = {r["gram"]: r["n"] for r in sample.mapInPandas(holding, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    texts = held.pop(-1, 0)
    if not texts:
        return None
    with_gram = np.zeros(DIMENSIONS)
    with_gram[list(held)] = list(held.values())
    idf = (np.log((1 + texts) / (1 + with_gram)) + 1).astype(np.float32)
    found = sample.groupBy("lang").applyInPandas(centroids_of(idf, clusters), "lang string, j int, centre binary, limit double").orderBy("lang", "j").collect()
    matrix = np.stack([np.frombuffer(r["centre"], dtype=np.float32) for r in found])
    return {"idf": idf, "centroids": matrix, "names": [r["lang"] for r in found], "limits": np.array([r["limit"] for r in found])}


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    model = model or train(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    n, rest = HELD_OUT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.iloc[at : at + 128]
                counts = [None if m is None or text is None else gram_counts(text) for text in part["text"]]
                lang, score, rejected = ["und"] * len(part), np.zeros(len(part)), np.ones(len(part), dtype=bool)
                full = [i for i, c in enumerate(counts) if c is not None]
                if full:
                    near = vectors(np.stack([counts[i] for i in full]), m["idf"]) @ m["centroids"].T
                    for i, j, s in zip(full, near.argmax(axis=1), near.max(axis=1)):
                        lang[i], score[i], rejected[i] = m["names"][j], min(1.0, max(0.0, float(s))), s < m["limits"][j]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang_pred": lang, "score": score, "rejected": rejected})

    own = docs.select(carried(), "text")
    out = own.mapInPandas(run, "doc_id string, lang_pred string, score double, rejected boolean")
    return restored(out).select("doc_id", (fold("doc_id", n) == rest).alias("held_out"), "lang_pred", "score", "rejected")
