"""Byte-level BPE encoding and decoding.

Encoding is by backtracking: at each position the longest token is taken from an
Aho-Corasick automaton; a token is accepted if its pair with the one before
could stand next to each other after BPE's merges, else a shorter prefix is
tried, else the last token is taken back.  Each position is given up at most
once, so the work is linear and the result equals merging by rank.  Decoding
slices one blob of token bytes by an offset table.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import small_batches, texts
from termloom.llm.pretokens import split

#: Bytes that byte-level vocabularies spell as themselves.
PRINTABLE = (range(33, 127), range(161, 173), range(174, 256))
#: Distinct pre-tokens, and pairs of tokens, that a task remembers before it starts afresh.
CACHE = 200_000
#: A batch of results is sent on once it holds so many decoded characters.
OUT_CHARS = 4 << 20


def byte_chars() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable bytes stand for
    themselves, the others for the characters from 256 on."""
    own = set(chain.from_iterable(PRINTABLE))
    rest = iter(range(256, 512))
    return {chr(b if b in own else next(rest)): b for b in range(256)}


class Bpe:
    """Tables of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_chars()
        raw = {t: bytes(byte[c] for c in t) for t in spec["model"]["vocab"]}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in vocab.items():
            self.tokens[i] = raw[t]
        self.ids = {raw[t].decode("latin-1"): i for t, i in vocab.items()}
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        # rank: the order in which merges apply; single bytes come first of all.
        self.rank = [-1] * len(self.tokens)
        self.left, self.right = list(range(len(self.tokens))), list(range(len(self.tokens)))
        self.pair: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.pair[i, j] = r
            self.rank[k], self.left[k], self.right[k] = r, i, j
        self.length = [len(t) for t in self.tokens]
        self.prefix: dict[int, int] = {}
        auto = ahocorasick.Automaton()
        for t, i in self.ids.items():
            auto.add_word(t[::-1], i)
        auto.make_automaton()
        self.auto = auto
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.sizes = np.array(self.length, np.int64)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def longest(self, word: str) -> list[int]:
        """The longest token at each position: the longest match of a reversed
        token that ends at each position of the reversed word."""
        found = [-1] * len(word)
        last = len(word) - 1
        length = self.length
        for end, token in self.auto.iter(word[::-1]):
            at = last - end
            if found[at] < 0 or length[token] > length[found[at]]:
                found[at] = token
        return found

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        got = self.prefix.get(token)
        if got is None:
            text = self.tokens[token].decode("latin-1")
            got = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
            self.prefix[token] = got
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` side by side: undo their merges, latest
        first, and see that no merge across the border would have come earlier."""
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > CACHE:
                self.fits.clear()
            got = self.fits[a, b] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        rank, pair = self.rank, self.pair
        limit = len(rank)
        while True:
            across = pair.get((a, b))
            if across is not None and across < limit:
                return False
            # The later of the two merges is undone; on equal ranks (two equal
            # tokens) the left one was made first, so the right one is undone.
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token given as latin-1 text of its bytes."""
        whole = self.ids.get(word)
        best = self.longest(word)
        out: list[int] = []
        open_end = [True] * (len(word) + 1)
        at, token, length = 0, best[0], self.length
        while at < len(word):
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if open_end[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    if at < len(word):
                        token = best[at]
                    break
                token = self.shorter(token)
                if token < 0:
                    open_end[at] = False
                    token = out.pop()
                    at -= length[token]
                    break
        return tuple(out) if whole is None or len(out) > 1 else (whole,)

    def encode(self, text: str) -> list[int]:
        """Ids of a text as the library gives them without adding special tokens;
        special tokens' own strings in the text become their ids."""
        if self.at_special and any(s in text for s in self.special):
            out: list[int] = []
            for part in self.at_special(text):
                out += [self.special[part]] if part in self.special else self._ordinary(part)
            return out
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[int]:
        words, cache = split(text), self.cache
        if len(cache) > CACHE:
            cache.clear()
        try:
            return list(chain.from_iterable(map(cache.__getitem__, words)))
        except KeyError:
            for w in set(words).difference(cache):
                cache[w] = self.encode_word(w.encode("utf-8", "surrogatepass").decode("latin-1"))
            return list(chain.from_iterable(map(cache.__getitem__, words)))

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        take = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.blob[take].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """One table set per worker process and file."""
    return Bpe(path)


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row, whole texts.

    ``path`` names the vocabulary file on every executor.  Null and empty texts
    give no ids; rows that repeat a doc_id and null doc_ids are kept; extra
    columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        bpe = vocabulary(path)
        for b in batches:
            ids = [np.array(bpe.encode(t or ""), np.int32) for t in b.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.empty(0, np.int32), *ids]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: the text that the ids spell, special tokens included.

    Bytes that are not UTF-8 become U+FFFD; null or empty ids give an empty text.
    """
    small_batches(encoded.sparkSession)

    def run(batches):
        bpe = vocabulary(path)
        for b in batches:
            column = b.column(1)
            flat = np.asarray(column.values)
            ends = np.asarray(column.offsets)
            text = [bpe.decode(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), column, pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def bpe_round_trip(docs: DataFrame, path: str, out_chars: int = OUT_CHARS) -> DataFrame:
    """``(doc_id, ids, decoded)`` for every row: ``bpe_encode`` and ``bpe_decode`` in one
    pass of the same worker, so that each task holds one set of tables and ids cross
    to Spark once.  Null and empty texts give no ids and an empty text; an empty table no rows.
    """

    def run(batches):
        bpe = vocabulary(path)
        for b in batches:
            doc_ids, ids, decoded, held = [], [], [], 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.array(bpe.encode(t.as_py() or ""), np.int32)
                doc_ids.append(d)
                ids.append(x)
                decoded.append(bpe.decode(x))
                held += len(decoded[-1])
                if held > out_chars:
                    yield _batch(doc_ids, ids, decoded)
                    doc_ids, ids, decoded, held = [], [], [], 0
            if doc_ids:
                yield _batch(doc_ids, ids, decoded)

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _batch(doc_ids: list, ids: list[np.ndarray], decoded: list[str]) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode, and sum up each row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return bpe_round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
