"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Six triplets of each 5-byte window are hashed into 128 buckets.  The digest
holds two bits per bucket (which quartile its count is in), a length code and
a checksum: the sum of the hashes of the first triplet of every window.  Digests
compare by a bounded difference score.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.llm.common import durable, small_batches, texts

BUCKETS = 128
#: Offsets of the triplets in a window that ends at 0, each with a salt of its own.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
WINDOW = 5
#: Windows hashed at a time.
STRETCH = 1 << 20
#: A bucket two or more quartiles off counts more than twice one quartile.
STEP = (0, 1, 2, 6)
_TABLE = np.array(random.Random(0).sample(range(256), 256), np.uint8)
_POP = np.array([[STEP[abs((i >> s & 3) - (j >> s & 3))] for s in (0, 2, 4, 6)] for i in range(256) for j in range(256)]).sum(axis=1).reshape(256, 256)
MOST = BUCKETS * STEP[3] + 12 * 63 + 12


def _length_code(n: int) -> int:
    """Steps of about 10 %: 0 for no bytes, at most 255."""
    return 0 if n == 0 else min(255, 1 + int(np.log(n) / np.log(1.1)))


def digest(data: bytes) -> str:
    """68 hex digits: length code, checksum, then 32 bytes of quartiles.

    Under five bytes there is no window: the text is padded with zero bytes.
    """
    b = np.frombuffer(data if len(data) >= WINDOW else data.ljust(WINDOW, b"\0"), np.uint8)
    counts = np.zeros(256, np.int64)
    check = 0
    for at in range(0, len(b) - WINDOW + 1, STRETCH):
        part = b[at : at + STRETCH + WINDOW - 1]
        n = len(part) - WINDOW + 1
        for salt, offs in enumerate(TRIPLETS):
            h = np.full(n, _TABLE[salt + 1], np.uint8)
            for o in offs:
                h = _TABLE[h ^ part[WINDOW - 1 - o : WINDOW - 1 - o + n]]
            own = np.bincount(h, minlength=256)
            counts += own
            if salt == 0:
                check = (check + int(own @ np.arange(256))) & 255
    low = counts[:BUCKETS]
    q1, q2, q3 = np.sort(low)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (low > q1).astype(np.uint8) + (low > q2) + (low > q3)
    body = codes.reshape(-1, 4).astype(int) @ np.array([64, 16, 4, 1])
    return bytes([_length_code(len(data)), check, *body.tolist()]).hex()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for digests as different as can be.

    Bucket steps, plus up to 63 steps of length beyond the first (each a tenth)
    at 12 apiece, plus 12 if the checksums differ, over the greatest such sum.
    """
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    far = int(_POP[x[2:], y[2:]].sum()) + 12 * min(63, max(0, abs(int(x[0]) - int(y[0])) - 1)) + 12 * int(x[1] != y[1])
    return 1.0 - far / MOST


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first characters of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id, text: str, print_: str, following: str, next_print: str) -> tuple:
    changed = edited(text, following)
    raw = changed.encode("utf-8", "surrogatepass")
    other = digest(raw)
    return doc_id, len(text), hashlib.sha256(raw).hexdigest(), print_, other, likeness(print_, other), likeness(print_, next_print)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` of each whole text; null counts as empty."""

    def run(batches):
        for b in batches:
            prints = [digest((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document.

    The next document is the one after in ascending doc_id (nulls first; rows
    that share a doc_id in order of a hash of the text), and the first after the last.  Texts
    move once, to range partitions in that order; inside one, a row waits for its
    successor.  Only a partition's first and last text wait for the second step:
    two rows per partition, joined by partition number.  A table of one
    row is its own next; an empty table gives no rows.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    t = texts(docs)
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        t.withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("th", F.xxhash64("text"))
        # The hash, not the text: range bounds come from a sample of keys at the driver.
        .repartitionByRange(n, "doc_id", "th")
        .sortWithinPartitions("doc_id", "th", "text")
        .select("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )

    def walk(batches):
        first = before = None
        names = ["part", "edge", "text", *[c.split()[0] for c in _OUT.split(", ")]]
        for b in batches:
            done = []
            for doc_id, text, part in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                now = (doc_id, text, digest(text.encode("utf-8", "surrogatepass")), part)
                if before is None:
                    first = now
                else:
                    done.append((part, None, None, *_row(before[0], before[1], before[2], now[1], now[2])))
                before = now
            yield _batch(done, names)
        if first is not None:
            edges = [(r[3], e, r[1], r[0], None, None, r[2], None, None, None) for e, r in (("first", first), ("last", before))]
            yield _batch(edges, names)

    walked = durable(placed.mapInArrow(walk, f"part int, edge string, text string, {_OUT}"))
    columns = [c.split()[0] for c in _OUT.split(", ")]
    edges = walked.filter("edge is not null").select("part", "edge", "text", "doc_id", "fingerprint")
    # Which partition follows which: two numbers per partition, ordered in one small window.
    number = edges.filter("edge = 'last'").select("part")
    order = W.orderBy("part")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = number.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(whole)).alias("next"))
    last = edges.filter("edge = 'last'").join(after, "part").select("doc_id", "text", "fingerprint", F.col("next").alias("part"))
    first = edges.filter("edge = 'first'").select("part", F.col("text").alias("following"), F.col("fingerprint").alias("next_print"))

    def finish(batches):
        for b in batches:
            yield _batch([_row(*r) for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)], columns)

    joined = last.join(first, "part").select("doc_id", "text", "fingerprint", "following", "next_print")
    return walked.filter("edge is null").select(*columns).unionByName(joined.mapInArrow(finish, _OUT))


_TYPES = {"part": pa.int32(), "doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names)
