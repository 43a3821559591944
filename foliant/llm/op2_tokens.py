"""Token counts by trie-shared dynamic programming.

A text is cut into pre-tokens; the distinct ones go into a byte trie. A trie node carries the unigram forward score of its
prefix, the best over all vocabulary pieces that end there, computed once however many pre-tokens share the prefix, and the
piece count of that best path; terminal nodes give the counts. Documents are never shuffled: a worker's trie starts anew
when it reaches NODES, which bounds its memory and changes no count.

The vocabulary is a public byte-level one, given by path. It has no probabilities; a piece of rank r gets the Zipf score
-log(r + 1), less a constant so that a longer path costs more.
"""

from __future__ import annotations

import base64
import functools
import math
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from foliant.scale import read_table, ship

#: Pre-tokens: contractions, letters, digits and other signs, each with a leading space, then white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NODES = 2_000_000
#: Longer pre-tokens are scored in an array of their own, outside the trie.
TRIE_BYTES = 64
PIECE_COST = 2.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def load_vocabulary(path: str) -> dict[bytes, float]:
    """Piece -> score, from lines of a base64 piece and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): -math.log(int(b) + 1) - PIECE_COST for a, b in map(bytes.split, f)}


class CountTrie:
    """Forward scores and piece counts of byte strings, shared by prefix."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, int], int] = {}
        self.best, self.count = [0.0], [0]

    def forward(self, s: bytes, end: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Best (score, pieces) of s[:end], given those of its shorter prefixes; fewer pieces on ties."""
        top, n = -math.inf, 0
        get = self.scores.get
        for start in range(max(0, end - self.longest), end):
            w = get(s[start:end])
            if w is not None and best[start] > -math.inf:
                v = best[start] + w
                if v > top or (v == top and count[start] + 1 < n):
                    top, n = v, count[start] + 1
        return top, n

    def tokens(self, s: bytes) -> int:
        """Pieces of the best path of ``s``; a byte outside the vocabulary makes every byte of ``s`` a piece."""
        if len(s) > TRIE_BYTES:
            best, count = [0.0], [0]
            for end in range(1, len(s) + 1):
                v, n = self.forward(s, end, best, count)
                best.append(v)
                count.append(n)
            return count[-1] if best[-1] > -math.inf else len(s)
        node, best, count = 0, [0.0], [0]
        for end, byte in enumerate(s, 1):
            nxt = self.child.get((node, byte))
            if nxt is None:
                v, n = self.forward(s, end, best, count)
                nxt = self.child[node, byte] = len(self.best)
                self.best.append(v)
                self.count.append(n)
            node = nxt
            best.append(self.best[node])
            count.append(self.count[node])
        return count[-1] if best[-1] > -math.inf else len(s)


def _count(path: str):
    def run(batches):
        trie, pieces, known = CountTrie(load_vocabulary(path)), regex.compile(PATTERN), {}
        for b in batches:
            for at in range(0, b.num_rows, 128):
                cut = b.slice(at, 128)
                found = [Counter(pieces.findall(t)) if t else Counter() for t in cut.column(1).to_pylist()]
                for w in sorted({w for c in found for w in c if w not in known}):
                    known[w] = trie.tokens(w.encode("utf-8", "surrogatepass"))
                tokens = [sum(n * known[w] for w, n in c.items()) for c in found]
                cols = [cut.column(0), pa.array(tokens, pa.int64()), pa.array([c.total() for c in found], pa.int64()), pa.array([len(c) for c in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "n_pretokens", "n_distinct"])
                if len(trie.best) > NODES or len(known) > NODES // 4:
                    trie.clear()
                    known.clear()

    return run


def token_counts(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_distinct) for every row of (doc_id, text); the path must exist on every worker.

    Null and empty texts have no tokens; repeated rows count alike; an empty table gives no rows; other columns are not read.
    """
    ship(df.sparkSession)
    return df.select("doc_id", "text").mapInArrow(_count(vocabulary or default_vocabulary()), "doc_id long, n_tokens long, n_pretokens long, n_distinct long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
