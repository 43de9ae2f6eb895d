"""Token counts under a unigram model, shared through a trie.

A text's tokens are those of the best-scoring segmentation of each pre-token
into vocabulary pieces. The distinct pre-tokens of some texts at a time are made
a trie; each node's forward score, the best over the pieces that end there, is
computed once for all pre-tokens with that prefix, the nodes of a level together,
and terminals keep the token count for the texts to come.

A piece's score is -log(rank + 2), a Zipf law over the public vocabulary's order,
plus a constant cost for every token, so that fewer tokens win; ties go to fewer tokens. Single
bytes are always pieces, so no text lacks a segmentation. Pieces of every length
count: each node carries the starts from which its bytes are the beginning of some piece. Texts wait, as numbers of their
pre-tokens, until there are NEW new pre-tokens or HELD in all, and a trie is of the new ones alone; terminals are dropped
once there are MOST_TERMINALS, and pre-tokens over LONGEST bytes after each trie, which is without them: they are scored
byte by byte, trying at each end the lengths that pieces with its last two bytes have. So memory is bounded. Null and empty
texts have no tokens; repeated rows get equal counts; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkripple.llm.common import carried, restored

MOST_NODES = 600_000
MOST_TERMINALS = 500_000
LONGEST = 64
#: Texts from so many characters on are split piece by piece, without a list of all their pre-tokens.
LONG_TEXT = 1 << 20
#: So many new pre-tokens, or pre-tokens in all, are counted together.
NEW = 1 << 17
HELD = 1 << 21
TOKEN_COST = 4.0


def load_scores(ranks_file: str) -> dict[bytes, float]:
    import base64

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    scores = {piece: -math.log(rank + 2) - TOKEN_COST for piece, rank in ranks.items()}
    for byte in range(256):
        scores.setdefault(bytes([byte]), -math.log(len(ranks) + 2) - TOKEN_COST)
    return scores


class Pieces:
    """The vocabulary as a trie of numbered states, 0 its root: the states that go on come first, score is -inf where no piece ends."""

    def __init__(self, scores: dict[bytes, float]):
        prefixes = {piece[:end] for piece in scores for end in range(len(piece))}
        states = {prefix: i for i, prefix in enumerate(sorted(prefixes, key=len))}
        self.inner = len(states)
        for piece in scores:
            states.setdefault(piece, len(states))
        self.score = np.full(len(states), -math.inf)
        self.score[[states[piece] for piece in scores]] = list(scores.values())
        self.next = np.full(self.inner << 8, -1, np.int32)
        own = [(states[prefix[:-1]] << 8 | prefix[-1], state) for prefix, state in states.items() if state]
        self.next[[key for key, _ in own]] = [state for _, state in own]


class Trie:
    """Forward scores by prefix: a node is a prefix, its value the best score and token count.

    count() takes one pre-token and keeps its nodes in a dictionary; count_sorted() takes many, whose nodes are
    places in arrays, a level at a time.
    """

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        # Lengths of the pieces by their last two bytes, of any length that the vocabulary has; single bytes are always tried.
        lengths: dict[bytes, set[int]] = {}
        for piece in scores:
            lengths.setdefault(piece[-2:], {1}).add(len(piece))
        self.lengths = {tail: tuple(sorted(own)) for tail, own in lengths.items()}
        self.nodes: dict[bytes, tuple[float, int]] = {b"": (0.0, 0)}
        self.pieces: Pieces | None = None
        self.computed = 0
        self.drop()

    def drop(self) -> None:
        # Pre-tokens by number, as they come; the numbers from len(self.counts) on, of the last ones, have no count yet.
        self.terminals: dict[str, int] = defaultdict(itertools.count().__next__)
        self.counts = np.zeros(0, np.int64)
        self.settled = 0

    def extend(self, s: bytes, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        best, count = -math.inf, 0
        scores = self.scores
        for length in self.lengths.get(s[max(0, end - 2) : end], (1,)):
            if length > end:
                break
            start = end - length
            own = scores.get(s[start:end])
            if own is not None:
                before, n = path[start]
                total = before + own
                if total > best or total == best and n + 1 < count:
                    best, count = total, n + 1
        self.computed += 1
        return best, count

    def count(self, s: bytes) -> int:
        if len(s) > LONGEST:
            path = [(0.0, 0)]
            for end in range(1, len(s) + 1):
                path.append(self.extend(s, end, path))
            return path[-1][1]
        if len(self.nodes) > MOST_NODES:
            self.nodes = {b"": (0.0, 0)}
        nodes, path = self.nodes, [(0.0, 0)]
        for end in range(1, len(s) + 1):
            prefix = s[:end]
            node = nodes.get(prefix)
            if node is None:
                node = nodes[prefix] = self.extend(s, end, path)
            path.append(node)
        return path[-1][1]

    def new(self) -> int:
        """How many terminals have no count yet."""
        return len(self.terminals) - self.settled

    def count_new(self) -> np.ndarray:
        """The token count by number of all terminals, once the new ones are counted together."""
        fresh = sorted(itertools.islice(reversed(self.terminals), self.new()))
        words = [token.encode("utf-8", "replace") for token in fresh]
        number = np.fromiter(map(self.terminals.__getitem__, fresh), np.int64, len(fresh))
        short = np.fromiter(map(len, words), np.int64, len(words)) <= LONGEST
        self.counts = np.r_[self.counts, np.zeros(len(fresh), np.int64)]
        if short.any():
            self.counts[number[short]] = self.count_sorted([words[i] for i in np.flatnonzero(short)])
        for i in np.flatnonzero(~short):
            self.counts[number[i]] = self.count(words[i])
            del self.terminals[fresh[i]]
        self.settled = len(self.terminals)
        counts = self.counts
        if len(counts) >= MOST_TERMINALS:
            self.drop()
        return counts

    def count_sorted(self, words: list[bytes]) -> np.ndarray:
        """The token count of each of these sorted words, over the trie that they make, level by level."""
        pieces = self.pieces = self.pieces or Pieces(self.scores)
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.array(words, f"S{max(1, size.max())}").view(np.uint8).reshape(len(words), -1)
        # How many bytes a word shares with the one before: it is first of its nodes below.
        differ = text[1:] != text[:-1]
        shared = np.where(differ.any(1), differ.argmax(1), text.shape[1])
        shared = np.r_[-1, np.minimum(shared, np.minimum(size[1:], size[:-1]))]
        counts = np.zeros(len(words), np.int64)
        rows, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        # Of each node, one after another, its starts: the state that the bytes from there lead to, best score and token count before them.
        starts, state, before, n_before = np.array([0, 1]), np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64)
        for level in range(text.shape[1]):
            on = size[rows] > level
            rows, node = rows[on], node[on]
            head = shared[rows] <= level
            parent, byte = node[head], text[rows[head], level]
            node = np.cumsum(head) - 1
            n = starts[parent + 1] - starts[parent]
            of = np.repeat(np.arange(len(parent)), n)
            at = np.arange(len(of)) + np.repeat(starts[parent] - (np.cumsum(n) - n), n)
            led = pieces.next[state[at] << 8 | byte[of]]
            met = led >= 0
            of, at, led = of[met], at[met], led[met].astype(np.int64)
            # Single bytes are pieces, so every node has a start that leads to one.
            first = np.searchsorted(of, np.arange(len(parent)))
            total = before[at] + pieces.score[led]
            best = np.maximum.reduceat(total, first)
            least = np.minimum.reduceat(np.where(total == best[of], n_before[at] + 1, np.iinfo(np.int64).max), first)
            self.computed += len(parent)
            done = size[rows] == level + 1
            counts[rows[done]] = least[node[done]]
            # Starts that can go on, and the node's own end as a start.
            on = led < pieces.inner
            of, at, led = of[on], at[on], led[on]
            ends = np.searchsorted(of, np.arange(len(parent)), "right")
            starts = np.r_[0, ends + np.arange(1, len(parent) + 1)]
            state, before, n_before = np.insert(led, ends, 0), np.insert(before[at], ends, best), np.insert(n_before[at], ends, least)
        return counts

    def terminal(self, token: str) -> int:
        number = self.terminals[token]
        return int((self.count_new() if self.new() else self.counts)[number])


def default_files() -> dict[str, str]:
    import public_tokenizers as public

    return {"ranks_file": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}


def add(sums: np.ndarray, held: list[tuple[int, np.ndarray]], counts: np.ndarray) -> None:
    """Add to each row's sums the tokens and the number of its pre-tokens."""
    for row, numbers in held:
        sums[:, row] += counts[numbers].sum(), len(numbers)


def count_tokens(docs: DataFrame, files: dict[str, str] | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, n_pretokens."""
    files = files or default_files()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        pattern = regex.compile(files["pattern"])
        trie = Trie(load_scores(files["ranks_file"]))

        def parts(text: str) -> Iterator[list[str]]:
            if len(text) < LONG_TEXT:
                yield pattern.findall(text)
            else:
                tokens = (m[0] for m in pattern.finditer(text))
                while part := list(itertools.islice(tokens, NEW)):
                    yield part

        for batch in batches:
            sums = np.zeros((2, len(batch)), np.int64)
            held, n = [], 0
            for row, text in enumerate(batch["text"]):
                for tokens in parts(text):
                    held.append((row, np.fromiter(map(trie.terminals.__getitem__, tokens), np.int64, len(tokens))))
                    n += len(tokens)
                    if n >= HELD or trie.new() >= NEW:
                        add(sums, held, trie.count_new())
                        held, n = [], 0
            add(sums, held, trie.count_new())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": sums[0], "n_pretokens": sums[1]})

    own = docs.select(carried(), F.coalesce("text", F.lit("")).alias("text"))
    return restored(own.mapInPandas(run, "doc_id string, n_tokens long, n_pretokens long"))
