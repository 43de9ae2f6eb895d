"""Packing of tokenised documents into fixed-length training sequences.

Method: minimum bin slack. Every window is filled with the multiset of remaining
lengths whose sum comes closest to the capacity, found by a subset-sum dynamic
programme over an integer used as a bitset and read back as counts per length.

Each Spark partition packs its own documents, so nothing is shuffled: a pool of
at most POOL_TOKENS ids per task is all the state there is, and a lost task is
run again from its input. Documents longer than a sequence are cut into whole
sequences as they come; only their remainders enter the pool.

Null and empty texts give the closing id alone. Repeated rows are packed as
often as they occur, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkripple.llm.common import carried, restored

CAPACITY = 2048
CLOSING_ID = 1
POOL_TOKENS = 1 << 20
SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], capacity: int) -> list[int]:
    """Take one window's lengths out of counts: the longest one, then the multiset that leaves least slack."""
    seed = max(counts)
    take(counts, seed, 1)
    room = capacity - seed
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            wider = (reach | reach << length) & ((2 << room) - 1)
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, [seed]
    for length, before in reversed(steps):
        if not before >> at & 1:
            chosen.append(length)
            take(counts, length, 1)
            at -= length
    return chosen


def take(counts: dict[int, int], length: int, n: int) -> None:
    counts[length] -= n
    if not counts[length]:
        del counts[length]


def binary_cuts(total: int) -> list[int]:
    """Powers of two that sum to total, largest first; a sequence of such a length needs no padding."""
    return [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]


class Packer:
    """Packs the documents of one task; rows() hands over what is packed so far."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.sequence = capacity, first_sequence
        self.pool: dict[int, list[tuple]] = {}
        self.pooled = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self.emit([(doc_id, start, ids[start : start + self.capacity], len(ids))])
        if rest := len(ids) - whole:
            self.pool.setdefault(rest, []).append((doc_id, whole, ids[whole:], len(ids)))
            self.pooled += rest
            if self.pooled >= POOL_TOKENS:
                self.drain(POOL_TOKENS // 4)

    def drain(self, keep: int) -> None:
        counts = {length: len(pieces) for length, pieces in self.pool.items()}
        while counts and self.pooled > keep:
            chosen = fill(counts, self.capacity)
            pieces = []
            for length in chosen:
                pieces.append(self.pool[length].pop())
                if not self.pool[length]:
                    del self.pool[length]
            self.pooled -= sum(chosen)
            if not keep and sum(chosen) < self.capacity:
                self.emit_cut(pieces)
            else:
                self.emit(pieces)

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, of in pieces:
            self.out.append((doc_id, start, len(ids), crc(ids), of, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def emit_cut(self, pieces: list[tuple]) -> None:
        """The last windows of a task that no multiset fills are cut at powers of two instead of being padded."""
        queue = list(reversed(pieces))
        for size in binary_cuts(sum(len(p[2]) for p in pieces)):
            own = []
            while size:
                doc_id, start, ids, of = queue.pop()
                if len(ids) > size:
                    queue.append((doc_id, start + size, ids[size:], of))
                    ids = ids[:size]
                own.append((doc_id, start, ids, of))
                size -= len(ids)
            self.emit(own)

    def rows(self) -> pd.DataFrame:
        out, self.out = self.out, []
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def crc(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


class Ids:
    """Text to ids of the vocabulary in a tokenizers file.

    The same vocabulary as ranks is several times faster for plain text; texts
    that hold the special token, or that the fast way refuses, go through the
    tokenizers file itself.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer_file)
        self.fast = None
        if ranks_file:
            import base64

            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and SPECIAL not in text:
            try:
                return self.fast.encode_to_numpy(text).astype(np.uint32, copy=False)
            except ValueError:  # its regular expression gives up on very long runs of white space
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def default_tokenizer() -> dict[str, str]:
    import public_tokenizers as public

    return {"tokenizer_file": public.path("byte_bpe_50k.json"), "ranks_file": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}


def pack(docs: DataFrame, tokenizer: dict[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: where it starts in its document and where it lies in its sequence."""
    files = tokenizer or default_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = Ids(**files)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity)
        end = np.array([CLOSING_ID], dtype=np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                packer.add(doc_id, np.concatenate([ids_of(text), end]))
            yield packer.rows()
        packer.drain(0)
        yield packer.rows()

    own = docs.select(carried(), F.coalesce("text", F.lit("")).alias("text"))
    return restored(own.mapInPandas(run, SCHEMA))
