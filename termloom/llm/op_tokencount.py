"""Token counts under a unigram vocabulary, shared over a trie of pre-tokens.

A pre-token's best segmentation maximises the sum of its tokens' log
probabilities.  The forward scores of a prefix serve every pre-token that
begins with it: distinct pre-tokens are inserted in a trie, each node is scored
once, when it is made, and terminal nodes hold the counts.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from termloom.llm.common import texts
from termloom.llm.pretokens import split

#: Nodes of a worker's trie beyond which it starts afresh (about 150 bytes each).
NODES = 1_000_000


def unigram_scores(path: str) -> dict[bytes, float]:
    """Token -> log probability from a file of ranked tokens.

    The file gives an order, no probabilities: rank r has weight 1 / (r + 1), as
    in Zipf's law.  Every single byte is made a token (the missing ones come
    last), so every text has a segmentation.
    """
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    for b in range(256):
        ranks.setdefault(bytes([b]), len(ranks))
    total = log(sum(1 / (r + 1) for r in ranks.values()))
    return {t: -log(r + 1) - total for t, r in ranks.items()}


class TokenCounter:
    """A trie of the distinct pre-tokens met so far; it lasts as long as its worker.

    A node stands for a prefix.  ``best`` and ``many`` hold its forward score, the greatest
    sum of log probabilities of a segmentation of the prefix, and the number of tokens in
    it; ``ends`` leads from a pre-token to its terminal node, where its count is thus kept.
    """

    def __init__(self, scores: dict[bytes, float], nodes: int = NODES):
        self.scores, self.most = scores, nodes
        self.longest = max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}  # node * 256 + byte -> node
        self.best, self.many, self.ends = [0.0], [0], {}

    def insert(self, word: str) -> int:
        """The number of tokens of a pre-token, scoring the prefixes that are new.

        Equal sums take the segmentation of fewer tokens.
        """
        get, longest, next_, best, many = self.scores.get, self.longest, self.next, self.best, self.many
        raw = word.encode("utf-8", "surrogatepass")
        node, path = 0, [0]
        for end, byte in enumerate(raw, 1):
            child = next_.get(node << 8 | byte)
            if child is None:
                high, few = -1e300, 0
                for at in range(max(0, end - longest), end):
                    s = get(raw[at:end])
                    if s is not None:
                        s += best[path[at]]
                        if s > high or (s == high and many[path[at]] + 1 < few):
                            high, few = s, many[path[at]] + 1
                child = next_[node << 8 | byte] = len(best)
                best.append(high)
                many.append(few)
            node = child
            path.append(node)
        self.ends[word] = node
        return many[node]

    def tokens(self, word: str) -> int:
        node = self.ends.get(word)
        return self.insert(word) if node is None else self.many[node]

    def count(self, texts_: list[str | None]) -> list[tuple[int, int]]:
        """Per text: pre-tokens and tokens.  Beyond its bound of nodes the trie starts afresh, between texts."""
        out = []
        for t in texts_:
            if len(self.best) > self.most:
                self.clear()
            pieces = split(t) if t else []
            ends, many, insert = self.ends, self.many, self.insert
            for new in set(pieces).difference(ends):
                insert(new)
            out.append((len(pieces), sum(many[ends[p]] for p in pieces)))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One table per worker process and file."""
    return TokenCounter(unigram_scores(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens)`` of each whole text.

    Null and empty texts count 0 and 0.  Rows that repeat a doc_id and null
    doc_ids are kept; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        c = counter(path)
        for b in batches:
            found = np.array(c.count(b.column(1).to_pylist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], ["doc_id", "n_pretokens", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
