"""Passages of over 50 words that documents share, whatever their bytes.

Words are what stands between ASCII white space.  Every WORDS words in a row have an
anchor: the CORE words inside them whose hash is least, as the byte strings of
``op_suffixdedup`` have.  Documents meet on anchors; runs that agree as a whole are
settled by that, and only where a run is not are the windows at its anchor compared.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import discard, durable
from termloom.llm.rolling import BLOCK, anchors, mix, rolling

WORDS, CORE = 51, 8

_U = np.uint64
_SPACE = re.compile(rb"[\x09-\x0d ]")
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, a block of bytes at a time; blocks end at white space."""
    one, _ = rolling()
    out, at = [np.zeros(0, _U)], 0
    while at < len(data):
        space = _SPACE.search(data, at + BLOCK)
        end = space.start() if space else len(data)
        b = np.frombuffer(data, np.uint8, end - at, at)
        at = end
        solid = _SOLID[b]
        edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
        first, last = edge[::2], edge[1::2]
        if len(b) <= one.size:
            sums = one.window(one.prefix(b), first, last)
        elif len(edge):
            # A word longer than the table goes round it; any other has the same sum as above.
            letters = b[solid]
            begin = np.cumsum(last - first) - (last - first)
            place = np.arange(len(letters)) - np.repeat(begin, last - first)
            sums = np.add.reduceat(one.symbol[letters] * one.up[place % one.size], begin)
        else:
            continue
        out.append(mix(sums + (last - first).astype(_U)))
    return np.concatenate(out)


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = rolling()
    return one.summed(words | _U(1)), two.summed(mix(words * _U(0xD6E8FEB86659FD93)) | _U(1))


def word_runs(words: np.ndarray):
    """Runs of windows of WORDS words with one anchor: arrays ``start, count, h, whole``.  Of those in a block
    that agree as a whole, as where a few words go round and round, the first is given."""
    one, two = rolling()
    wide = WORDS - CORE + 1
    for base in range(0, len(words) - WORDS + 1, BLOCK):
        p1, p2 = _sums(words[base : base + BLOCK + WORDS - 1])
        core = mix((p1[CORE:] - p1[:-CORE]) * one.down[: len(p1) - CORE])
        start, end, anchor = anchors(core, wide)
        whole = mix(one.window(p1, start, end + WORDS - 1)) ^ mix(two.window(p2, start, end + WORDS - 1))
        whole = mix(whole + (end - start).astype(_U) * _U(1_000_003) + (anchor - start).astype(_U))
        h, count, order = core[anchor], end - start, np.sort(whole)
        if (order[1:] == order[:-1]).any():
            first = np.sort(np.unique(whole, return_index=True)[1])
            start, count, h, whole = start[first], count[first], h[first], whole[first]
        yield start + base, count, h, whole


_RUN = "h long, whole long, doc_id long, th long, start int, count int"
_RUN_NAMES = [c.split()[0] for c in _RUN.split(", ")]


def _dealt(batches):
    """All runs of the documents ``(doc_id, text, th)``."""
    for b in batches:
        parts, row = [], 0
        for text in b.column(1).to_pylist():
            for start, count, h, whole in word_runs(word_hashes(text.encode("utf-8", "surrogatepass"))):
                parts.append((h, whole, np.full(len(start), row), start, count))
            row += 1
        if parts:
            h, whole, row, start, count = (np.concatenate(c) for c in zip(*parts, strict=True))
            row = pa.array(row)
            cols = [pa.array(h.view(np.int64)), pa.array(whole.view(np.int64)), b.column(0).take(row), b.column(2).take(row), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, _RUN_NAMES)


def window_hashes(words: np.ndarray, start: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each of ``count`` windows from ``start`` on."""
    one, two = rolling()
    p1, p2 = _sums(words[start : start + count + WORDS - 1])
    return tuple(mix((p[WORDS:] - p[:-WORDS]) * r.down[:count]).view(np.int64) for p, r in ((p1, one), (p2, two)))


def met(d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(doc_id, text, th)`` -> each document of WORDS words or more as ``(doc_id, th)``, the texts ``th``
    known to share a passage with another document, and the runs ``(doc_id, th, start, count)`` whose windows decide on the rest.

    Copies of a text share all of it.  Of other texts, those with a run that agrees as a whole are known; where
    an anchor has a run of a text not known, one of each different run there goes on.
    """
    dealt = durable(d.mapInArrow(_dealt, _RUN))
    long = durable(dealt.filter("start = 0").select("doc_id", "th"))
    other = F.min("th") != F.max("th")
    again = dealt.groupBy("h").agg(other.alias("o")).filter("o").select("h")
    seen = durable(dealt.join(again, "h", "left_semi"))
    discard(dealt)
    kinds = durable(seen.groupBy("h", "whole").agg(other.alias("o"), F.min(F.struct("doc_id", "th", "start", "count")).alias("r")).select("h", "whole", "o", "r.*"))
    copies = long.groupBy("th").agg(F.count("*").alias("n")).filter("n > 1").select("th")
    known = durable(copies.unionByName(seen.join(kinds.filter("o").select("h", "whole"), ["h", "whole"], "left_semi").select("th")).distinct())
    discard(seen)
    unsettled = kinds.filter("not o").join(known, "th", "left_anti").select("h").distinct()
    return long, known, kinds.join(unsettled, "h", "left_semi").select("doc_id", "th", "start", "count")


def sharing(long: DataFrame, known: DataFrame, windows: DataFrame) -> DataFrame:
    """``(doc_id, th)`` of the documents that share a passage; ``windows`` are ``(g1, g2, th)``."""
    again = windows.groupBy("g1", "g2").agg((F.min("th") != F.max("th")).alias("o")).filter("o").select("g1", "g2")
    found = known.unionByName(windows.join(again, ["g1", "g2"], "left_semi").select("th")).distinct()
    return long.join(found, "th", "left_semi").select("doc_id", "th")
