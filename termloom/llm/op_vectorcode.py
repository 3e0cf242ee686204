"""Vector code compression: product codes whose nearest entries are found by Orchard search.

A vector is cut into equal parts, and each part is coded by its nearest entry of that part
position's codebook.  Orchard search finds the entry: every entry keeps the others in order of
distance from it; a query stands at some entry, looks along that entry's list, jumps to the list of
whichever entry is nearer, never computes a distance twice (visited entries are marked),
and stops once the list is beyond twice the distance it has.  By the triangle inequality nothing further
can be nearer, so the result is exact.  All numbers are integers, so ties are exact too.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are whole multiples of 1 / SCALE; beyond +-LIMIT they count as +-LIMIT, so that squares stay exact.
SCALE, LIMIT = 256, 1 << 27
PARTS, ENTRIES, ROUNDS = 16, 64, 2


class Orchard:
    """The entries of one codebook, each with the others sorted by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        apart = ((self.entries[:, None, :] - self.entries[None, :, :]) ** 2).sum(2)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:] if len(entries) > 1 else np.empty((len(entries), 0), np.int64)
        # An entry that equals another may not head its own list; the list leaves out one of distance 0, which must be itself.
        for i, row in enumerate(self.order):
            at = np.flatnonzero(row == i)
            if len(at):
                row[at[0]] = np.argsort(apart[i], kind="stable")[0]
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (least index among equals) and the squared distance, of each query."""
        n, k = len(queries), len(self.entries)
        queries = queries.astype(np.int64)
        at = np.zeros(n, np.int64)
        best = ((queries - self.entries[0]) ** 2).sum(1)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        place = np.zeros(n, np.int64)
        going = np.arange(n if k > 1 else 0)
        while len(going):
            here, step = at[going], place[going]
            # sqrt(apart) > 2 sqrt(best): every later entry of the list is farther than the one we have.
            ahead = self.apart[here, step] <= 4 * best[going]
            going, here, step = going[ahead], here[ahead], step[ahead]
            entry = self.order[here, step]
            new = ~seen[going, entry]
            place[going] += 1
            rows, tried = going[new], entry[new]
            seen[rows, tried] = True
            d = ((queries[rows] - self.entries[tried]) ** 2).sum(1)
            better = (d < best[rows]) | (d == best[rows]) & (tried < at[rows])
            moved = rows[better]
            at[moved], best[moved], place[moved] = tried[better], d[better], 0
            going = going[place[going] < k - 1]
        return at, best


def whole_parts(vectors: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, x)``: integer components, filled up with zeros to one length that ``parts`` divides.

    Rows whose vector is null or holds a component that is null or not finite go.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.filter(F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(finite(x), F.lit(False))))
    held = lambda x: F.greatest(F.least(F.floor(F.least(F.greatest(x, F.lit(-1e15)), F.lit(1e15)) * SCALE), F.lit(LIMIT)), F.lit(-LIMIT))
    return rows.select("vec_id", "label", F.transform("v", held).alias("x"))


def _padded(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """The batch's last column as a matrix, short rows filled up with zeros."""
    column = batch.column(batch.num_columns - 1)
    ends, flat = np.asarray(column.offsets), np.asarray(column.values)
    sizes = np.diff(ends)
    if len(sizes) and (sizes == length).all():
        return flat[ends[0] : ends[-1]].reshape(-1, length)
    out = np.zeros((len(sizes), length), np.int64)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def _books(codebooks: np.ndarray) -> list[Orchard]:
    return [Orchard(c) for c in codebooks]


def _sums(rows: DataFrame, codebooks: np.ndarray, length: int) -> DataFrame:
    """``(part, entry, n, total array<long>)``: for each task, how many parts fell to an entry and their sum."""
    parts, k = codebooks.shape[:2]
    width = length // parts

    def run(batches):
        books = _books(codebooks)
        n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for b in batches:
            x = _padded(b, length)
            for p in range(parts):
                piece = x[:, p * width : (p + 1) * width]
                got, _ = books[p].nearest(piece)
                n[p] += np.bincount(got, minlength=k)
                np.add.at(total[p], got, piece)
        part, entry = np.nonzero(n)
        flat = pa.array(total[part, entry].reshape(-1) if width else np.empty(0, np.int64))
        ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.ListArray.from_arrays(ends, flat)], ["part", "entry", "n", "total"])

    return rows.select("x").mapInArrow(run, "part int, entry int, n long, total array<long>")


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks ``(parts, entries, width)`` of integers, or None where no row is left.

    They start as the parts of the ``entries`` least ids (null ids last, equal ids by their components; fewer
    where fewer rows are left).  Only these rows, and sums of at most ``parts * entries`` entries, reach the driver.
    """
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return None
    length = max(1, -(-longest // parts)) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    start = np.zeros((len(first), length), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["x"])] = r["x"]
    books = start.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        # Decimals cannot overflow, however many rows fall to an entry.
        totals = _sums(rows, books, length).select("part", "entry", "n", F.posexplode("total").alias("i", "t"))
        found = totals.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t")).collect()
        for r in found:
            books[r["part"], r["entry"], r["i"]] = int(r["t"]) // r["n"]
    return books


def codes(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``(vec_id, label, code, error)``: the entry of each part, two hex digits each in part order (four beyond 256
    entries), and the squared distance that the code leaves."""
    parts, k, width = codebooks.shape
    digits = 2 if k <= 256 else 4
    label = rows.schema["label"].dataType.simpleString()

    def run(batches):
        books = _books(codebooks)
        for b in batches:
            x = _padded(b, parts * width)
            found = [books[p].nearest(x[:, p * width : (p + 1) * width]) for p in range(parts)]
            at = np.stack([f[0] for f in found], axis=1).astype(">u2" if digits == 4 else "u1")
            whole = at.tobytes().hex()
            step = parts * digits
            code = [whole[i : i + step] for i in range(0, len(whole), step)]
            error = reduce(np.add, (f[1] for f in found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def decode(coded: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``(vec_id, approx array<double>)``: the vectors that the codes stand for."""
    parts, k, width = codebooks.shape
    digits = 2 if k <= 256 else 4

    def run(batches):
        for b in batches:
            raw = np.frombuffer(bytes.fromhex("".join(b.column(1).to_pylist())), ">u2" if digits == 4 else "u1").reshape(-1, parts)
            x = np.stack([codebooks[p][raw[:, p]] for p in range(parts)], axis=1).reshape(len(raw), -1) / scale
            ends = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], ["vec_id", "approx"])

    return coded.select("vec_id", "code").mapInArrow(run, "vec_id long, approx array<double>")


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` for every row with a whole vector.

    Components are ``floor(256 x)``; see ``train`` for the codebooks.  The table is read once for the first
    entries, once a round and once for the codes; each read is a scan without a shuffle, and what tasks send on is
    bounded by the codebooks.  ``label_error`` sums errors over equal labels, nulls together, at most 2^63 - 1.

    Vectors that are null, or hold null or non-finite components, go; shorter ones count as filled up with zeros to the
    longest, or to the next length that ``parts`` divides.  Empty vectors are such.  Rows that repeat an id and null ids
    are kept; extra columns are ignored; an empty table gives no rows.
    """
    rows = whole_parts(vectors, parts, id_col, vector_col, label_col)
    books = train(rows, parts, entries, rounds)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = codes(rows, books)
    per_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    per_label = per_label.select(F.col("label").alias("of"), F.least("s", F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(per_label, coded["label"].eqNullSafe(per_label["of"])).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
