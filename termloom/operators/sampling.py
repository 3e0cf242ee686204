"""The daily pick: a small seeded sample that is the same for all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_M = 0xFFFFFFFF


def text_seed(text: str) -> int:
    """31-polynomial hash of the UTF-16 units, modulo 2**32."""
    h = 0
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h * 31 + raw[i] + 256 * raw[i + 1]) & _M
    return h


def uniform(seed: int):
    """Numbers in [0, 1) of the mulberry32 generator, a published 32-bit mixer."""
    state = seed
    while True:
        state = (state + 0x6D2B79F5) & _M
        a = ((state ^ (state >> 15)) * (state | 1)) & _M
        a ^= (a + (((a ^ (a >> 7)) * (a | 61)) & _M)) & _M
        yield (a ^ (a >> 14)) / 4294967296


def picked_places(n: int, count: int, seed: str) -> list[int]:
    """``count`` of the places 0..n-1 drawn one after another without replacement."""
    numbers, gone = uniform(text_seed(seed)), []
    for left in range(n, max(n - count, 0), -1):
        at = int(next(numbers) * left)
        for g in sorted(gone):  # the at-th place not yet drawn
            at += g <= at
        gone.append(at)
    return gone


def daily_pick(terms: DataFrame, day: str, count: int = 5) -> DataFrame:
    """``terms`` with ``term_ord`` 0..n-1 -> the day's terms in order of ``pick``."""
    places = picked_places(terms.count(), count, day)
    which = terms.sparkSession.createDataFrame(list(zip(places, range(len(places)), strict=True)), "term_ord long, pick int")
    return terms.join(F.broadcast(which), "term_ord")


def hashed_sample(terms: DataFrame, day: str, count: int = 5) -> DataFrame:
    """A different sample that needs no row numbers: least by a hash of slug and day."""
    return terms.orderBy(F.xxhash64("slug", F.lit(day)), "slug").limit(count)
