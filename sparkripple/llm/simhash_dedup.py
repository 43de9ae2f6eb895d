"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has 64 bits, each set where over half of its shingles'
XXH64 values (seed 42) have it set. Fingerprints link at MOST_BITS differing
bits or fewer. Seen as a ring of eight segments of eight bits, two linked
fingerprints have a segment from which every chain of l segments differs in at
most l * 3 / 8 bits: none in the first two, at most one in the first five. So
the first two and two of the next three are equal, which gives 24 exact keys of
32 bits per fingerprint; pairs that share one are checked against the whole
chain's budgets and then by the full Hamming distance.

Work is on distinct fingerprints, so copies cost one row each. A key shared by
more than MOST_SHARED fingerprints makes no pairs: it is split by the chain of
seven segments, whose budget of two bits leaves one of the three segments not yet
in the key equal, so three keys of 40 bits take its place. Fingerprints that share
even such a key with more than MOST_SHARED others are linked exactly by values
within one and two bits of them, in rows linear in their number. Components are
found by distributed star rewrites.

Null texts and texts without words have fingerprint 0 and link like any other.
Repeated rows and ties share a fingerprint and a component; extra columns are
carried along whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkripple.llm.common import carried, cut, own_name, restored
from sparkripple.llm.components import stars

SHINGLE = 3
SEED = 42
MOST_BITS = 3
SEGMENTS = 8
MOST_SHARED = 256
#: Shingles of a text are hashed in pieces of so many words, to bound memory.
PIECE = 1 << 16


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return signed(xxh64_intdigest(b" ".join(words), SEED))
    total, n = np.zeros(64, dtype=np.int64), len(words) - shingle + 1
    for at in range(0, n, PIECE):
        part = words[at : at + PIECE + shingle - 1]
        hashes = [xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(shingle)))]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark (a hash of the text), fp."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "mark": batch["mark"], "fp": [fingerprint(t, shingle) for t in batch["text"]]})

    return restored(docs.select(carried(), F.xxhash64("text").alias("mark"), "text").mapInPandas(run, "doc_id string, mark long, fp long"))


def mask(segments: list[int]) -> int:
    return signed(sum(0xFF << 8 * (s % SEGMENTS) for s in segments))


def keys() -> list[tuple[int, int]]:
    """(start, mask) of the 24 keys: the first two segments and two of the next three."""
    return [(i, mask([i, i + 1, i + a, i + b])) for i in range(SEGMENTS) for a, b in combinations((2, 3, 4), 2)]


def longer_keys() -> list[tuple[int, int]]:
    """(start, mask) of the three keys that take the place of each: it and one of the chain's other three segments."""
    return [(i, own | mask([s])) for i, own in keys() for s in range(i + 2, i + 7) if not own & mask([s])]


def within_budgets(start: int, a: str, b: str):
    """Every chain from start holds its proportional budget."""
    ok = F.lit(True)
    for length in range(1, SEGMENTS + 1):
        differing = F.bit_count(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(F.lit(mask(list(range(start, start + length))))))
        ok = ok & (differing <= length * MOST_BITS // SEGMENTS)
    return ok


def counted(keyed: DataFrame) -> DataFrame:
    """keyed(tag, start, key, id, fp) with n, how many share the key; those of keys of their own are left out."""
    shared = cut(keyed.groupBy("tag", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return cut(keyed.join(shared, ["tag", "key"]))


def pairs_within(own: DataFrame) -> DataFrame:
    """(a, b): linked ids that share a key which is not crowded."""
    few = own.filter(F.col("n") <= MOST_SHARED).select("tag", "key", "start", "id", "fp")
    other = few.select("tag", "key", F.col("id").alias("id_b"), F.col("fp").alias("fp_b"))
    chain = F.lit(False)
    for start in range(SEGMENTS):
        chain = chain | ((F.col("start") == start) & within_budgets(start, "fp", "fp_b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= MOST_BITS
    return few.join(other, ["tag", "key"]).filter(F.col("id") < F.col("id_b")).filter(chain).filter(near).select(F.col("id").alias("a"), F.col("id_b").alias("b"))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): ids of fingerprints (id, fp), all distinct, whose links reach all that is reachable."""
    short, long = keys(), longer_keys()
    keyed = distinct.select("id", "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for _, m in short))).alias("tag", "key"))
    own = counted(keyed.withColumn("start", F.element_at(F.lit([s for s, _ in short]), F.col("tag") + 1)))
    out = pairs_within(own)
    crowded = own.filter(F.col("n") > MOST_SHARED)
    if crowded.isEmpty():
        return out
    each = len(long) // len(short)
    split = crowded.select("id", "fp", "start", (F.col("tag") * each).alias("first"), F.explode(F.array(*map(F.lit, range(each)))).alias("k")).withColumn("tag", F.col("first") + F.col("k"))
    split = split.select("id", "fp", "start", "tag", F.col("fp").bitwiseAND(F.element_at(F.lit([m for _, m in long]), F.col("tag") + 1)).alias("key"))
    own = counted(split)
    still = own.filter(F.col("n") > MOST_SHARED).select("id", "fp").distinct()
    return out.unionByName(pairs_within(own)).unionByName(ball_links(still))


def ball_links(crowded: DataFrame) -> DataFrame:
    """All that link among crowded fingerprints, through the values near them.

    Two fingerprints at three bits or fewer have a value within one bit of one
    and two of the other. At each value the least fingerprint within one bit is
    linked with all others there: those within one bit differ from it in two
    bits at most, those within two in three.
    """
    bits = [signed(1 << i) for i in range(64)]
    near = [0, *bits]
    far = [signed((1 << i) | (1 << j)) for i, j in combinations(range(64), 2)]
    at = crowded.select("id", F.posexplode(F.transform(F.lit(near + far), lambda m: F.col("fp").bitwiseXOR(m))).alias("k", "value"))
    at = at.withColumn("close", F.col("k") < len(near))
    hub = at.filter("close").groupBy("value").agg(F.min("id").alias("a"))
    return at.join(hub, "value").filter(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"))


def components(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fp, ...) with component_id; prints must be written already, as it is read several times.

    A document without an id is in no component unless it shares one with ids.
    """
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    roots = stars(links(distinct.filter("id IS NOT NULL")))
    known = distinct.join(roots, distinct["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return prints.join(known, "fp", "left").select(*prints.columns, "component_id")


def groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    out = components(cut(fingerprints(docs)))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, that of its smallest id; documents without an id stay.

    Rows of one id are one document: of those that stay, the one whose columns (but
    maps) have the least hash is kept. Only where there are such are rows dealt by id.
    """
    found = cut(components(cut(fingerprints(docs))))
    lost_id, lost_mark, twice_id = (own_name(docs, n) for n in ("lost_id", "lost_mark", "twice_id"))
    lost = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(lost_id), F.col("mark").alias(lost_mark)).distinct()
    kept = docs.join(lost, (F.col("doc_id") == F.col(lost_id)) & (F.xxhash64("text") == F.col(lost_mark)), "left_anti")
    twice = cut(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias(twice_id)))
    if twice.isEmpty():
        return kept
    hashed = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))
    again = kept.join(twice, F.col("doc_id") == F.col(twice_id), "left_semi").select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), hashed.alias("hash"))
    again = again.groupBy("doc_id").agg(F.min_by("row", "hash").alias("row")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
    return kept.join(twice, F.col("doc_id") == F.col(twice_id), "left_anti").unionByName(again)
