"""Packing of documents into training sequences by order-preserving dynamic programming.

The documents of a task, one after the other, are a line of tokens.  Sequences are windows of that line of at most
``size`` tokens, so order is kept and every token lies in one window.  Cuts may lie between documents, after a sentence,
or, where no sentence ends for ``gap`` tokens, at a place in between.  The cheapest cuts minimise padding plus a penalty for
each cut inside a document:

    cost[j] = penalty[j] + min over i of cost[i] + padding(at[j] - at[i])

Over a window of places, ``padding`` is ``size - at[j] + at[i]``, so the best ``i`` is the least
``cost[i] + at[i]`` there, which a monotone queue gives in constant time.  Windows whose length is a power of two need no padding
and are tried besides.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from termloom.llm.common import texts
from termloom.llm.op_bpe import byte_chars

SIZE, END_ID = 2048, 1
#: In tokens of padding: what a cut costs after a sentence and elsewhere inside a document; tokens without a place to cut.
AFTER_SENTENCE, ELSEWHERE, GAP = 1, 8, 32
#: Sequences of this length or more may stand unpadded in the middle of the line.
LEAST_POWER = 256
#: A task packs its line in stretches of so many tokens; texts are encoded so many characters at a time.
STRETCH, CHARS = 1 << 19, 1 << 20
#: Texts encoded at once.
TOGETHER = 256
#: Pre-tokens that a worker remembers in each of two generations.
CACHE = 500_000
#: Marks that end a sentence.
ENDS = ".!?…。！？।؟"
#: Where a long text may be parted: blanks that the vocabulary drops.
BLANKS = " \n\t\r"


#: Letters of Latin-1 in lower case.
LATIN = "a-zß-öø-ÿ"
#: Fixed value: how the vocabulary splits text in lower case, as far as its letters are those.
_split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^ \t\n\r\f\v{LATIN}0-9]+").findall
_known = re.compile(rf"[!-~{LATIN}]+").fullmatch


class Encoder:
    """The tokenizers library over pre-tokens, each encoded once.

    The vocabulary drops white space and merges within pre-tokens only, so a text's ids are those of its pre-tokens one after the
    other.  Texts are split here where all their letters are Latin-1's and no special token's mark occurs; the library takes
    others whole.  Pre-tokens are remembered in two generations of bounded size.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.bytewise = {b: c for c, b in byte_chars().items()}
        self.new: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        vocab = self.library.get_vocab()
        spelt = [self.library.encode(c, add_special_tokens=False).tokens for c in ENDS]
        marks = {t[0] for t in spelt if len(t) == 1}
        ends = [i for t, i in vocab.items() if t in marks or re.fullmatch(r"[.!?]+[\"')\]]*</w>", t)]
        self.ends_sentence = np.zeros(max(vocab.values()) + 2, bool)
        self.ends_sentence[ends] = True

    def learn(self, found: set[str]) -> None:
        """Put the ids of these pre-tokens into the newer generation; None where one is beyond the split above."""
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        old, new, tokenize = self.old, self.new, self.model.tokenize
        for s in found.difference(new):
            if s in old:
                new[s] = old[s]
            elif not _known(s):
                new[s] = None
            else:
                spelt = s if s.isascii() else s.encode().decode("latin-1").translate(self.bytewise)
                new[s] = array("i", [t.id for t in tokenize(spelt)]).tobytes()

    def ids(self, parts: list[str]) -> list[bytes]:
        """Of each part of a text, the ids as 32-bit numbers."""
        split = [[] if any(s in p for s in self.special) else _split(p.lower()) for p in parts]
        self.learn(set(chain.from_iterable(split)))
        get, out = self.new.__getitem__, []
        for part, found in zip(parts, split, strict=True):
            try:
                out.append(b"".join(map(get, found)) if found else self.whole(part))
            except TypeError:
                out.append(self.whole(part))
        return out

    def whole(self, part: str) -> bytes:
        return np.array(self.library.encode(part, add_special_tokens=False).ids, np.int32).tobytes() if part else b""

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text, special tokens' own strings included, as the library gives them; then the end id."""
        return self.encode_all([text])[0]

    def encode_all(self, given: list[str]) -> list[np.ndarray]:
        """``encode`` for each text, a bounded number of characters at a time."""
        out: list[list[bytes]] = [[] for _ in given]
        held, of, chars = [], [], 0
        for i, text in enumerate(given):
            at = 0
            while at < len(text):
                to = at + CHARS
                if to < len(text):
                    # Up to the last blank, or the next one where a word is longer than that.
                    to = max(text.rfind(c, at + 1, to) for c in BLANKS)
                    to = to if to > 0 else min((p for c in BLANKS if (p := text.find(c, at + CHARS)) >= 0), default=len(text))
                part = text[at:to] if at or to < len(text) else text
                at = to
                held.append(part)
                of.append(i)
                chars += len(part)
                if chars > CHARS:
                    for k, ids in zip(of, self.ids(held), strict=True):
                        out[k].append(ids)
                    held, of, chars = [], [], 0
        for k, ids in zip(of, self.ids(held), strict=True):
            out[k].append(ids)
        end = np.array([END_ID], np.int32).tobytes()
        return [np.frombuffer(b"".join([*x, end]), np.int32) for x in out]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def padding(length: int, size: int = SIZE) -> int:
    return 0 if length & (length - 1) == 0 else size - length


def places(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Where a line of tokens may be cut, in ascending order from 0, and the penalty of each place.

    ``ends``: whether a token ends a sentence, by id; ``stops``: where documents end in the line.
    """
    after = np.flatnonzero(ends[ids]) + 1
    at = np.union1d(np.concatenate([[0], after]), stops)
    wide = np.flatnonzero(np.diff(at) > gap)
    if len(wide):
        more = [np.arange(at[i] + gap, at[i + 1], gap) for i in wide]
        free = np.concatenate(more)
        at = np.union1d(at, free)
    else:
        free = np.empty(0, np.int64)
    penalty = np.full(len(at), AFTER_SENTENCE, np.int64)
    penalty[np.isin(at, free)] = ELSEWHERE
    penalty[np.isin(at, stops)] = 0
    penalty[0] = 0
    return at, penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> tuple[list[int], list[int]]:
    """``(cost, before)`` of each place: the least cost of windows that end there, and where the last one starts."""
    n = len(at)
    index = np.full(int(at[-1]) + 1, -1, np.int64)
    index[at] = np.arange(n)
    powers: list[list[int]] = []
    step = LEAST_POWER
    while step < size:
        back = at - step
        powers.append(np.where(back >= 0, index[np.maximum(back, 0)], -1).tolist())
        step *= 2
    spots, costs = at.tolist(), penalty.tolist()
    cost, before = [0] * n, [0] * n
    # The queue: keys ascending, with places; what lies before ``head`` has left.
    keys, who, head = [], [], 0
    key = last = 0
    for j, (here, extra, *shorter) in enumerate(zip(spots, costs, *powers, strict=True)):
        if not j:
            continue
        # The place before enters: those in the queue that are no better never win again.
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            who.pop()
        keys.append(key)
        who.append(last)
        least = here - size
        while spots[who[head]] < least:
            head += 1
        i = who[head]
        c = keys[head] - least
        for k in shorter:
            if k >= 0 and cost[k] < c:
                c, i = cost[k], k
        cost[j] = c = c + extra
        before[j] = i
        key, last = c + here, j
    return cost, before


def windows(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, size: int, final: bool) -> list[int]:
    """Ends of the windows of a line.  Unless ``final``, what comes after the last one is left for the next stretch."""
    at, penalty = places(ids, ends, stops, min(GAP, max(1, size // 16)))
    cost, before = best_cuts(at, penalty, size)
    total = len(ids)
    near = int(np.searchsorted(at, total - size, "left"))
    if final:
        # The rest may be one padded window or several whose lengths are powers of two.
        def rest(j: int) -> tuple[int, int]:
            r = total - int(at[j])
            return cost[j] + (min(size - r, ELSEWHERE * (r.bit_count() - 1)) if r & (r - 1) else 0), -j
        j = min(range(near, len(at)), key=rest)
    else:
        j = min(range(near, len(at)), key=lambda j: (cost[j], -j))
    tail, cut = [], int(at[j])
    r = total - cut
    if final and r:
        if r & (r - 1) and size - r <= ELSEWHERE * (r.bit_count() - 1):
            tail.append(total)
        else:
            for k in reversed(range(r.bit_length())):
                if r >> k & 1:
                    cut += 1 << k
                    tail.append(cut)
    out = []
    while j:
        out.append(int(at[j]))
        j = before[j]
    return out[::-1] + tail


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``: one row for each piece of a document.

    Each task packs its own rows in their order, stretch by stretch, so nothing is shuffled and a task holds one stretch
    and one document at a time; what the last window of a stretch leaves begins the next one.  The end of a task's line is one
    padded sequence, or several whose lengths are powers of two where that is cheaper.

    Null and empty texts are the end id alone.  Rows that repeat a doc_id and null doc_ids are kept, each with pieces of its
    own; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path)
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, np.ndarray, int]] = []  # document, its ids, and how many are packed already
        waiting = 0

        def stretch(final: bool):
            nonlocal number, held, waiting
            line = np.concatenate([ids[start:] for _, ids, start in held])
            stops = np.cumsum([len(ids) - start for _, ids, start in held])
            columns: list[list] = [[] for _ in range(7)]
            d, begin = 0, 0
            for end in windows(line, enc.ends_sentence, stops, size, final):
                offset = 0
                while offset < end - begin:
                    doc, ids, start = held[d]
                    length = min(len(ids) - start, end - begin - offset)
                    row = (doc, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), number, offset)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                    offset += length
                    start += length
                    held[d] = (doc, ids, start)
                    d += start == len(ids)
                begin = end
                number += 1
            held = held[d:]
            waiting = sum(len(ids) - start for _, ids, start in held)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for at in range(0, len(b), TOGETHER):
                part = b.slice(at, TOGETHER)
                encoded = enc.encode_all([t or "" for t in part.column(1).to_pylist()])
                for doc, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                    held.append((doc, ids, 0))
                    waiting += len(ids)
                    if waiting >= STRETCH:
                        yield stretch(False)
        if held:
            yield stretch(True)

    return texts(docs).mapInArrow(run, SCHEMA)
