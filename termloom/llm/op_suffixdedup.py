"""Exact removal of byte strings that repeat, by suffix arrays.

Every string of LENGTH bytes has an anchor: the CORE bytes inside it whose hash is
least.  Equal strings have equal anchors, so the strings are dealt out by anchor,
and what repeats is found among the few places that share one.  The strings of one
document with the same anchor form a run, kept as one longer text.  Runs that agree
as a whole are merged first; the suffixes of the different runs at an anchor are
then sorted by linear grouping (``suffixes``), with the shared core as one symbol,
and neighbours whose common prefix reaches LENGTH bytes repeat.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import passages
from termloom.llm.common import discard, durable, texts
from termloom.llm.rolling import BLOCK, anchors, mix, rolling
from termloom.llm.suffixes import suffix_array

LENGTH, CORE = 400, 256
#: Runs gathered before a task merges those that agree.
GATHER = 1 << 18
#: An anchor with more different runs than this is dealt out again, by slices of
#: SLICE neighbouring starts and by all bytes that the strings of a slice share; in a slice
#: with more strings than this, each start is counted by itself.
MANY, SLICE = 200, 8
#: Symbols that one suffix array takes before the next is begun.
SYMBOLS = 60_000

_U = np.uint64


def runs(data: bytes):
    """Runs of starts with one anchor: arrays ``start, count, anchor, h1, h2, whole``.

    ``h1, h2`` hash the anchor's core, ``whole`` the run's text with its shape.  Of
    equal least hashes the first in the window is the anchor.  Blocks of long
    texts overlap, so that every window is in one block; a run may be cut there.
    """
    one, two = rolling()
    b = np.frombuffer(data, np.uint8)
    wide = LENGTH - CORE + 1
    for base in range(0, len(b) - LENGTH + 1, BLOCK):
        part = b[base : base + BLOCK + LENGTH - 1]
        p1 = one.prefix(part)
        core = mix((p1[CORE:] - p1[:-CORE]) * one.down[: len(part) - CORE + 1])
        start, end, anchor = anchors(core, wide)
        p2 = two.prefix(part)
        h2 = two.window(p2, anchor, anchor + CORE)
        whole = mix(one.window(p1, start, end + LENGTH - 1)) ^ mix(two.window(p2, start, end + LENGTH - 1))
        whole = mix(whole + (end - start).astype(_U) * _U(1_000_003) + (anchor - start).astype(_U))
        yield start + base, end - start, anchor + base, core[anchor], h2, whole


_RUN = "h1 long, h2 long, whole long, doc_id long, th long, start long, count int, off int, twice int"
_RUN_NAMES = [c.split()[0] for c in _RUN.split(", ")]


def _joined(doc_id: np.ndarray, th: np.ndarray, start: np.ndarray, count: np.ndarray):
    """Touching runs of starts of one document as one; input in document order."""
    new = np.ones(len(start), bool)
    new[1:] = (th[1:] != th[:-1]) | (doc_id[1:] != doc_id[:-1]) | (start[1:] != start[:-1] + count[:-1])
    first = np.flatnonzero(new)
    return first, np.add.reduceat(count, first) if len(first) else count


def _emit(parts: list[tuple], ids: list) -> pa.RecordBatch:
    """Runs gathered by a task: one of each agreeing set goes on, marked as there
    twice; where the others lie is settled here, and goes on as starts with ``off`` -1."""
    h1, h2, whole, row, th, start, count, off = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((whole, h2, h1))
    a, b, c = h1[order], h2[order], whole[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    keep, twice = order[new], (sizes > 1).astype(np.int32)
    rest = np.sort(order[np.repeat(sizes > 1, sizes)])
    first, total = _joined(row[rest], th[rest], start[rest], count[rest])
    rest = rest[first]
    doc = pa.array(ids, pa.int64())

    def both(x, y, kind):
        return pa.array(np.concatenate([x, y]).astype(kind))

    spread = mix(th[rest].view(_U) + start[rest].astype(_U)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            both(h1[keep].view(np.int64), spread, np.int64), both(h2[keep].view(np.int64), np.zeros(len(rest)), np.int64),
            both(whole[keep].view(np.int64), np.zeros(len(rest)), np.int64), doc.take(both(row[keep], row[rest], np.int64)),
            both(th[keep], th[rest], np.int64), both(start[keep], start[rest], np.int64), both(count[keep], total, np.int32),
            both(off[keep], np.full(len(rest), -1), np.int32), both(twice, np.ones(len(rest)), np.int32),
        ],
        _RUN_NAMES,
    )


def _gather(batches):
    """All runs of the documents ``(doc_id, text, th)``."""
    parts, ids, n = [], [], 0
    for b in batches:
        for doc_id, text, th in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for start, count, anchor, h1, h2, whole in runs(text.encode("utf-8", "surrogatepass")):
                row = np.full(len(start), len(ids), np.int64)
                parts.append((h1, h2, whole, row, np.full(len(start), th, np.int64), start, count, anchor - start))
                n += len(start)
            ids.append(doc_id)
            if n >= GATHER:
                yield _emit(parts, ids)
                parts, ids, n = [], [], 0
    if n:
        yield _emit(parts, ids)


_STRING = "g1 long, g2 long, core int, doc_id long, th long, start long, twice int, before binary, after binary"
_STRING_NAMES = [c.split()[0] for c in _STRING.split(", ")]
_STRING_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())


def _strings(data: bytes, run: dict, limit: int) -> list[tuple]:
    """A run's text without its core; where the anchor has many runs, by slices."""
    from xxhash import xxh64_intdigest

    start, count, anchor = run["start"], run["count"], run["start"] + run["off"]
    if run["many"] <= limit:
        return [(run["h1"], run["h2"], CORE, start, run["twice"], data[start:anchor], data[anchor + CORE : start + count + LENGTH - 1])]
    out = []
    for g in range((anchor - start - count + 1) // SLICE, (anchor - start) // SLICE + 1):
        # The slice's starts lie from anchor - g * SLICE - (SLICE - 1) to anchor - g * SLICE.
        last = min(start + count - 1, anchor - g * SLICE)
        first = max(start, anchor - g * SLICE - SLICE + 1)
        core, end = anchor - g * SLICE, anchor - g * SLICE - SLICE + 1 + LENGTH
        if first <= last:
            shared = data[core:end]
            key = [xxh64_intdigest(shared, 2 * g + s) for s in (0, 1)]
            signed = [k - (1 << 64) if k >> 63 else k for k in key]
            out.append((*signed, LENGTH - SLICE + 1, first, run["twice"], data[first:core], data[end : last + LENGTH]))
    return out


def _cut(batches, limit: int):
    """``(doc_id, text, th, wanted)`` -> the strings of the wanted runs, and with a core of 0
    the windows of the wanted runs of words, which have ``many`` 0."""
    for b in batches:
        rows, windows = [], []
        for n, (doc_id, text, th, wanted) in enumerate(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)):
            data = text.encode("utf-8", "surrogatepass")
            words = passages.word_hashes(data) if any(not run["many"] for run in wanted) else None
            for run in wanted:
                if run["many"]:
                    rows += [(*s[:3], doc_id, th, *s[3:]) for s in _strings(data, run, limit)]
                else:
                    windows.append((*passages.window_hashes(words, run["start"], run["count"]), np.full(run["count"], n)))
        cols = list(zip(*rows, strict=True)) or [()] * len(_STRING_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, _STRING_KINDS, strict=True)], _STRING_NAMES)
        if windows:
            g1, g2, at = (pa.array(np.concatenate(c)) for c in zip(*windows, strict=True))
            core, start, none = pa.array(np.zeros(len(g1), np.int32)), pa.array(np.zeros(len(g1), np.int64)), pa.nulls(len(g1), pa.binary())
            yield pa.RecordBatch.from_arrays([g1, g2, core, b.column(0).take(at), b.column(2).take(at), start, core, none, none], _STRING_NAMES)


def repeated_starts(strings: list[tuple[int, int, bytes, bytes, int]]) -> list[list[int]]:
    """Per string ``(anchor number, core length, before, after, copies)`` the starts
    whose LENGTH bytes are also elsewhere among these strings (or in a copy).

    One suffix array over all strings; the core is one symbol, so LENGTH bytes
    are LENGTH - core + 1 symbols.  Starts with those symbols equal are neighbours.
    """
    symbols: list[int] = []
    begin, owner = [], {}
    for n, (anchor, core, before, after, _) in enumerate(strings):
        begin.append(len(symbols))
        wide = LENGTH - core + 1
        symbols += before
        symbols.append(257 + anchor)
        symbols += after
        for at in range(begin[n], len(symbols) - wide + 1):
            owner[at] = n
        symbols.append(256)
    raw = np.array(symbols, np.int32).tobytes()
    out: list[list[int]] = [[] for _ in strings]
    alike: list[int] = []
    text = b""

    def close():
        if len(alike) > 1 or (alike and strings[owner[alike[0]]][4] > 1):
            for at in alike:
                out[owner[at]].append(at - begin[owner[at]])

    for at in suffix_array(symbols):
        if at in owner:
            wide = LENGTH - strings[owner[at]][1] + 1
            own = raw[4 * at : 4 * (at + wide)]
            if own != text:
                close()
                alike, text = [], own
            alike.append(at)
    close()
    return [sorted(x) for x in out]


_SPAN = "doc_id long, th long, start long, count int"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "th", "start", "count"])


def _settled(waiting: list[list]) -> list[tuple]:
    """Spans of the different strings gathered, one suffix array for all their anchors."""
    several: dict[tuple, int] = {}
    for w in waiting:
        several[tuple(w[:3])] = several.get(tuple(w[:3]), 0) + 1
    # An anchor with one string has nothing to sort.
    todo = [w for w in waiting if several[tuple(w[:3])] > 1]
    number = {k: i for i, k in enumerate(several)}
    rows = []
    for w, starts in zip(todo, repeated_starts([(number[tuple(w[:3])], w[2], w[7], w[8], 1 + w[6]) for w in todo]), strict=True):
        if starts and not w[6]:
            s = np.array(starts)
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1] + 1))
            counts = np.diff(np.append(first, len(s)))
            rows += [(w[3], w[4], w[5] + int(s[i]), int(c)) for i, c in zip(first, counts, strict=True)]
    return rows


def _sorted_out(batches):
    """Strings in order of anchor and text -> starts that repeat, as ``(doc_id, th, start, count)``.

    Equal strings follow each other: they repeat as a whole and only one is kept, so a
    task holds the different strings of an anchor and never a group of copies.
    """
    waiting: list[list] = []
    size = 0
    for b in batches:
        out: list[tuple] = []
        for row in zip(*(b.column(i).to_pylist() for i in range(len(_STRING_NAMES))), strict=True):
            last = waiting[-1] if waiting else None
            if last and row[:3] == tuple(last[:3]) and row[7:] == tuple(last[7:]):
                n = len(row[7]) + len(row[8]) + row[2] - LENGTH + 1
                out += [(*r[3:6], n) for r in (last, row) if not r[6]]
                last[6] = 1
                continue
            if size >= SYMBOLS and row[:2] != tuple(last[:2]):
                out += _settled(waiting)
                waiting.clear()
                size = 0
            waiting.append(list(row))
            size += len(row[7]) + len(row[8]) + 2
        yield _spans(out)
    if waiting:
        yield _spans(_settled(waiting))


def _finish(batches):
    """``(doc_id, text, spans, shared)`` -> spans of bytes that go, and the bytes that stay."""
    for b in batches:
        rows = []
        for doc_id, text, found, shared in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for s in sorted(found or (), key=lambda x: x["start"]):
                end = s["start"] + s["count"] - 1 + LENGTH
                if spans and s["start"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([s["start"], end])
            kept, at = [], 0
            for i, j in spans:
                kept.append(data[at:i])
                at = j
            rows.append((doc_id, len(data), [{"start": i, "end": j} for i, j in spans], b"".join([*kept, data[at:]]), bool(shared)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "spans", "kept", "shared"])


def _crowded(strings: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
    """The strings of slices with at most ``many`` of them, and the starts that repeat in all other slices.

    A slice's strings share all but the few bytes of one start's play, so in a crowded one each start stands for itself: its LENGTH bytes are
    the shared ones and what lies around them, and counting these settles it.  Nothing is sorted, partial
    sums count, and a join that can be split hands the counts back, so no task holds the strings round a passage.
    """
    sliced = F.col("core") == LENGTH - SLICE + 1
    crowd = durable(strings.filter(sliced).groupBy("g1", "g2").agg(F.count("*").alias("n")).filter(F.col("n") > many).select("g1", "g2"))
    usual = strings.join(crowd, ["g1", "g2"], "left_anti")
    n_before = F.octet_length("before")
    starts = n_before + F.octet_length("after") + F.col("core") - LENGTH
    each = strings.filter(sliced).join(crowd, ["g1", "g2"], "left_semi").select("*", F.explode(F.sequence(F.lit(0), starts)).alias("k"))
    lead = F.substring("before", F.col("k") + 1, n_before - F.col("k"))
    tail = F.substring("after", F.lit(1), LENGTH - F.col("core") - (n_before - F.col("k")))
    each = each.select("g1", "g2", lead.alias("lead"), tail.alias("tail"), "doc_id", "th", (F.col("start") + F.col("k")).alias("start"), "twice")
    key = ["g1", "g2", "lead", "tail"]
    again = each.groupBy(*key).agg(F.count("*").alias("n"), F.max("twice").alias("t")).filter("n > 1 or t = 1").select(*key)
    return usual, each.filter("twice = 0").join(again, key, "left_semi").select("doc_id", "th", "start", F.lit(1).alias("count"))


def _with_texts(docs: DataFrame, found: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Documents joined to columns gathered per document, null doc_ids included."""
    f = found.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), *columns)
    return docs.join(f, docs["doc_id"].eqNullSafe(f["d"]) & (docs["th"] == f["t"]), how)


def suffix_dedup(docs: DataFrame, many: int = MANY) -> DataFrame:
    """Per row ``doc_id, n_bytes, spans, kept, shared``: the maximal runs of bytes covered by a
    400-byte string that also starts elsewhere in the table, the other bytes, and whether the text has over 50 words
    in a row that also stand in another document, whatever their bytes and the white space between them.

    Judged on the input: every copy of a repeated string goes, overlaps count, and
    matches stay inside a document.  Null texts are empty; texts under 400 bytes
    keep all.  Rows that repeat doc_id and text are copies of each other, so all
    their strings repeat.  Null doc_ids are kept.  Extra columns are ignored; an empty
    table gives no rows.  ``kept`` is binary, since a span may cut a character.
    """
    d = texts(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("th", F.xxhash64("text"))
    dealt = durable(d.mapInArrow(_gather, _RUN))
    anchor, place = ["h1", "h2"], ["doc_id", "th", "start", "count"]
    # Anchors met more than once, by partial sums: a hot one reaches this shuffle once a task.
    again = dealt.filter("off >= 0").groupBy("h1").agg(F.count("*").alias("n"), F.max("twice").alias("t")).filter("n > 1 or t = 1").select("h1")
    # An ordinary join: adaptive execution splits an anchor that many runs share.
    seen = durable(dealt.filter("off >= 0").join(again, "h1", "left_semi").unionByName(dealt.filter("off < 0")))
    discard(dealt)
    met = seen.filter("off >= 0")
    # One of each different run at an anchor goes to the suffix array, marked if it has copies.
    kinds = durable(met.groupBy(*anchor, "whole").agg(F.min(F.struct(*place, "off")).alias("r"), F.max("twice").alias("t"), F.count("*").alias("n")))
    copied = kinds.filter("n > 1 or t = 1").select(*anchor, "whole")
    whole = met.filter("twice = 0").join(copied, [*anchor, "whole"], "left_semi").select(*place).unionByName(seen.filter("off < 0").select(*place))
    several = kinds.groupBy(*anchor).agg(F.count("*").alias("many")).filter("many > 1")
    wanted = kinds.join(several, anchor).select(*anchor, "r.*", ((F.col("n") > 1) | (F.col("t") == 1)).cast("int").alias("twice"), "many")
    wanted = wanted.select(*place, "h1", "h2", "off", "twice", "many")
    long, known, doubtful = passages.met(d)
    wanted = wanted.unionByName(doubtful.withColumn("many", F.lit(0)), allowMissingColumns=True)
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h1", "h2", "start", "count", "off", "twice", "many")).alias("wanted"))
    cut = durable(_with_texts(d, wanted, ["wanted"], "inner").select(d["doc_id"], "text", "th", "wanted").mapInArrow(partial(_cut, limit=many), _STRING))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strings, crowded = _crowded(cut.filter("core > 0"), many)
    partly = strings.repartition(n, "g1", "g2").sortWithinPartitions("g1", "g2", "core", "before", "after").mapInArrow(_sorted_out, _SPAN)
    sharing = passages.sharing(long, known, cut.filter("core = 0").select("g1", "g2", "th"))
    # A document that shares a passage has a span of no start.
    spans = whole.unionByName(partly).unionByName(crowded).unionByName(sharing.select("*", F.lit(0).alias("start"), F.lit(0).alias("count")))
    found = F.collect_list(F.when(F.col("count") > 0, F.struct("start", "count"))).alias("found")
    spans = spans.groupBy("doc_id", "th").agg(found, (F.min("count") == 0).alias("shared"))
    return (
        _with_texts(d, spans, ["found", "shared"], "left").select(d["doc_id"], "text", "found", "shared")
        .mapInArrow(_finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, shared boolean")
    )


def brute_force(texts_: list[str | None]) -> list[tuple[int, int, int, str]]:
    """``(n_bytes, n_removed, n_spans, kept_sha256)`` by counting every string: for tests."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts_]
    counts: dict[bytes, int] = {}
    for b in data:
        for i in range(len(b) - LENGTH + 1):
            counts[b[i : i + LENGTH]] = counts.get(b[i : i + LENGTH], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - LENGTH + 1):
            if counts[b[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out
