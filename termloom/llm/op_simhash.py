"""SimHash near-duplicate classes by pigeonhole blocks.

Fingerprints of 64 bits are cut into blocks.  Two that differ in at most d bits
agree on at least ``blocks - d`` whole blocks, so joining on every choice of that
many blocks finds each close pair; the Hamming distance then decides.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import P, discard, durable, small_batches, texts
from termloom.llm.components import connected_components

BITS = 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the text's word shingles as an unsigned number.

    Words are runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased.
    A bit is set where over half the shingles' XXH64 have it.  Fewer words than
    ``width`` make one shingle; no word gives 0.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxh64_intdigest(b" ".join(words), seed)
    hashes = [xxh64_intdigest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(width)), strict=False)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * n > len(hashes) else "0" for n in ones.tolist()), 2)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _layout(blocks: int) -> list[int]:
    """Masks of the blocks, as equal in width as 64 bits allow."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def close_pairs(fps: DataFrame, distance: int = 2, blocks: int = 4, pair_limit: int = 24) -> DataFrame:
    """``(u, v)``, u > v: all pairs of fingerprints that differ in at most ``distance`` (1 or 2) bits.

    ``fps``: distinct ``fp``.  Buckets of up to ``pair_limit`` fingerprints are
    compared pair by pair.  In a larger bucket, where all pairs would be quadratic,
    every member names the fingerprints one flip away.  At distance 1 a named one that is there is a
    link.  At distance 2 every member names itself too, and members that name the same are
    linked: two are within two bits of each other exactly if some fingerprint is within
    one bit of both.  A name has at most 65 members, so no group is unbounded, and the
    links are the same whatever the limit.
    """
    if distance not in (1, 2) or blocks <= distance:
        raise ValueError("distance must be 1 or 2, and less than the number of blocks")
    masks = _layout(blocks)
    kept = [sum(c) for c in combinations(masks, blocks - distance)]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(kept)])
    buckets = fps.select("fp", F.explode(keys).alias("b")).select("fp", "b.t", "b.key")
    sizes = buckets.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = durable(buckets.join(sizes, ["t", "key"]).select("t", "key", "fp", "n"))

    small = members.filter(F.col("n") <= pair_limit).drop("n")
    pairs = (
        small.alias("a")
        .join(small.alias("b"), ["t", "key"])
        .filter((F.col("a.fp") > F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance))
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    )

    large = members.filter(F.col("n") > pair_limit).select("fp").distinct()
    flips = F.array(*[F.lit(_signed(1 << i)) for i in range(BITS)], *([F.lit(0).cast("long")] if distance == 2 else []))
    named = large.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("name"))
    others = named.select(F.col("fp").alias("v"), "name") if distance == 2 else large.select(F.col("fp").alias("v"), F.col("fp").alias("name"))
    linked = named.select(F.col("fp").alias("u"), "name").join(others, "name").filter("u > v").select("u", "v")
    return pairs.union(linked).distinct()


def simhash_classes(docs: DataFrame, width: int = 3, distance: int = 2, blocks: int = 4, seed: int = 42) -> DataFrame:
    """One row per input row: ``doc_id, fp, fingerprint, component_id, n_links``.

    ``component_id`` is the least ``doc_id`` reachable through links of at most
    ``distance`` differing bits, itself included.  ``n_links`` counts the other
    fingerprints that are that close to the row's, copies not expanded.

    Null and empty texts have fingerprint zero and link like any other.  Rows
    that repeat a doc_id are each kept; a null doc_id joins its class but never
    names it unless the class has no other (then component_id is null).  Extra
    columns are ignored; an empty table gives no rows.
    """
    fps = durable(fingerprints(docs, width, seed))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = durable(close_pairs(distinct.select("fp"), distance, blocks))
    roots = connected_components(links)
    degree = links.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    labelled = (
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .join(degree, "fp", "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    classes = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(classes, "root").select("fp", "component_id", "n_links")
    return fps.join(named, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )


#: Retrieval of texts alike in their five-word shingles: bands of MinHashes.  A pair of
#: Jaccard similarity 0.8 agrees in a band with probability 1 - (1 - 0.8 ** 6) ** 20 > 0.997.
WORDS, BANDS, ROWS = 5, 20, 6
#: Of so many MinHashes a share must be equal for a pair to be compared shingle by shingle:
#: five standard deviations below 0.8.
SKETCH, LIKELY = 64, 0.55
_rng = np.random.RandomState(17)
_FACTORS = (_rng.randint(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Different hashes of the text's five-word shingles; fewer words make one, none make none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    known = {w: xxh64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    s = np.zeros(max(0, len(h) - width + 1) if width else 0, np.uint64)
    for i in range(width):
        s = _mix(s + h[i : i + len(s)] * np.uint64(2 * i + 3))
    return np.unique(s)


def _minhashes(s: np.ndarray) -> np.ndarray:
    low = np.full(len(_FACTORS), (1 << 32) - 1, np.uint64)
    for at in range(0, len(s), 1024):
        low = np.minimum(low, (_mix(s[at : at + 1024, None] * _FACTORS) >> np.uint64(32)).min(axis=0))
    return low


def _band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for column in low.reshape(BANDS, ROWS).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


#: Two parts of a large bucket meet in one task: at most about so many texts and so many shingles each.
PART_ROWS, PART_WORDS = 1024, 1 << 20
#: Shingles whose occurrences are multiplied at once.
_COLUMNS = 2048


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share, exactly."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = times > 1
    place = np.cumsum(twice) - 1
    owner, column = owner[twice[column]], place[column[twice[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(twice.sum()), _COLUMNS):
        low, high = np.searchsorted(column, (at, at + _COLUMNS))
        occurs = np.zeros((len(sets), _COLUMNS), np.float32)
        occurs[owner[low:high], column[low:high] - at] = 1
        both += occurs @ occurs.T
    return both


def _cell_links(rows: pa.Table, jaccard: float) -> pa.Table:
    """Links ``u > v`` that join different classes among the texts of two parts, one for each joining."""
    rows = rows.sort_by("own")
    own, links = rows["own"].to_numpy(), []
    classes = np.unique(rows["label"].to_numpy(), return_inverse=True)[1]
    if len(own) and classes.max() > 0:
        sets = [shingle_set(t) for t in rows["text"].to_pylist()]
        size = np.array([len(s) for s in sets])
        both = _shared(sets)
        for u in range(len(own)):
            alike = both[u] >= jaccard * (size[u] + size - both[u].astype(np.float64))
            near = np.flatnonzero(alike & (classes != classes[u]))
            for other, first in zip(*np.unique(classes[near], return_index=True), strict=True):
                v = near[first]
                links.append((max(own[u], own[v]), min(own[u], own[v])))
                classes[classes == other] = classes[u]
    return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})


def alike_pairs(
    rows: DataFrame, jaccard: float = 0.8, pair_limit: int = 24, part_rows: int = PART_ROWS, part_words: int = PART_WORDS
) -> DataFrame:
    """``(u, v)``: links between ``own`` of different texts whose five-word shingles are verified to have
    a Jaccard similarity of ``jaccard`` or more.  Their closure joins what comparing every pair of
    each bucket would.

    ``rows``: ``own, text``, where ``own`` stands for the text.  Buckets of up to ``pair_limit``
    texts are compared pair by pair.  In a larger one every text is compared with the bucket's least
    first, which makes one class of most groups of near copies.  Buckets that hold several
    classes after that are dealt into parts of bounded size, and each two parts that hold different classes meet in a task of
    their own (``_cell_links``), which returns the links that join classes.  Large classes have parts of
    their own, so the tasks are as many as pairs of parts of different classes: in proportion to a bucket that one class
    fills but for a few texts, with the square of one that many unlike texts share.  The result is the
    same whatever the limit.
    """

    def sign(batches):
        for b in batches:
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            lows = [_minhashes(s) if len(s) else None for s in sets]
            sigs = pa.array([None if x is None else x[:SKETCH].astype(np.uint32).view(np.int32) for x in lows], pa.list_(pa.int32()))
            bands = pa.array([None if x is None else _band_keys(x) for x in lows], pa.list_(pa.int64()))
            words = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), words, sigs, bands], ["own", "words", "sig", "bands"])

    signed = durable(
        rows.select("own", "text").mapInArrow(sign, "own long, words long, sig array<int>, bands array<long>").dropDuplicates(["own"])
    )
    sig = signed.select("own", "sig")
    equal = F.aggregate(F.zip_with("us", "vs", lambda a, b: (a == b).cast("int")), F.lit(0), lambda x, y: x + y)

    def verify(batches):
        for b in batches:
            same = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = shingle_set(x), shingle_set(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(both >= jaccard * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(same, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        likely = durable(
            pairs.distinct()
            .join(sig.select(F.col("own").alias("u"), F.col("sig").alias("us")), "u")
            .join(sig.select(F.col("own").alias("v"), F.col("sig").alias("vs")), "v")
            .filter(equal >= LIKELY * SKETCH).select("u", "v")
        )
        needed = likely.select(F.explode(F.array("u", "v")).alias("own")).distinct()
        found = durable(rows.select("own", "text").join(needed, "own", "left_semi").dropDuplicates(["own"]))
        sides = likely.join(found.select(F.col("own").alias("u"), F.col("text").alias("ut")), "u").join(found.select(F.col("own").alias("v"), F.col("text").alias("vt")), "v")
        links = durable(sides.select("u", "v", "ut", "vt").mapInArrow(verify, "u long, v long"))
        discard(likely, found)
        return links

    buckets = signed.select("own", "words", F.explode("bands").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n"), F.sum("words").alias("total"), F.min("own").alias("hub")).filter("n > 1")
    members = durable(buckets.join(sizes, "key"))
    small, large = members.filter(F.col("n") <= pair_limit), members.filter(F.col("n") > pair_limit)
    small = small.select("key", "own")
    pairs = small.alias("a").join(small.alias("b"), "key").filter("a.own > b.own").select(F.col("a.own").alias("u"), F.col("b.own").alias("v"))
    stars = large.filter("own <> hub").select(F.col("own").alias("u"), F.col("hub").alias("v"))
    links = verified(pairs.union(stars))

    roots = connected_components(links).select(F.col("node").alias("own"), "root")
    n_parts = lambda n, words: F.ceil(F.greatest(F.col(n) / part_rows, F.col(words) / part_words)).cast("int")
    classed = large.join(roots, "own", "left").select("key", "own", "words", F.coalesce("root", "own").alias("label"), n_parts("n", "total").alias("parts"))
    several = classed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    classed = durable(classed.join(several, "key", "left_semi"))
    if not classed.isEmpty():
        # A class that fills half a part has parts of its own, which need not meet each other; the other members share some.
        per = classed.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("words").alias("total"), F.max("parts").alias("parts"))
        fills = (F.col("parts") > 1) & ((2 * F.col("n") >= part_rows) | (2 * F.col("total") >= part_words))
        per = durable(per.select("key", "label", "n", "total", fills.alias("alone"), n_parts("n", "total").alias("p")))
        shared = per.filter("not alone").groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select("key", n_parts("n", "total").alias("q"))
        pure = F.when(F.col("alone"), F.col("label"))
        sub = F.pmod(F.xxhash64("own", F.lit("part")), F.when(F.col("alone"), F.col("p")).otherwise(F.col("q")))
        left = durable(
            classed.join(per.select("key", "label", "alone", "p"), ["key", "label"]).join(shared, "key", "left")
            .select("key", "own", "label", pure.alias("pure"), sub.alias("sub")).withColumn("part", F.xxhash64(F.col("pure").isNull(), "pure", "sub")))
        parts = durable(left.select("key", "part", "pure").distinct())
        x, y = parts.alias("x"), parts.alias("y")
        cells = x.join(y, F.col("x.key") == F.col("y.key")).filter("x.part <= y.part and not coalesce(x.pure = y.pure, false)")
        cells = cells.select(F.col("x.key").alias("key"), F.col("x.part").alias("i"), F.col("y.part").alias("j"))
        sides = cells.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part"))
        found = rows.select("own", "text").join(left.select("own").distinct(), "own", "left_semi").dropDuplicates(["own"])
        met = left.join(found, "own").join(sides, ["key", "part"]).select("key", "i", "j", "part", "own", "label", "text")
        joined = met.groupBy("key", "i", "j").applyInArrow(lambda t: _cell_links(t, jaccard), "u long, v long")
        links = durable(links.union(joined).distinct())
        discard(per, parts)
        discard(left)
    discard(members, signed, classed)
    return links


def near_dedup(docs: DataFrame, width: int = 3, distance: int = 2, blocks: int = 4, seed: int = 42, jaccard: float | None = None) -> DataFrame:
    """The rows, all columns, with one document of each near-duplicate class: that of least doc_id.

    A null doc_id counts as a number below all ids, made from the text.  Rows are
    told apart by doc_id and text: of equal ones one stays, and different texts under
    one doc_id are judged each for itself.  With ``jaccard``, texts whose five-word
    shingles are that similar are near duplicates too (``alike_pairs``).
    """
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    key = F.coalesce(F.col("doc_id").cast("long"), -(1 << 62) + F.pmod(own, F.lit(1 << 61)))
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width, seed) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["key", "own", "fp"])

    rows = durable(docs.select(key.alias("key"), own.alias("own"), F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, own long, fp long"))
    distinct = rows.select("fp").distinct()
    links = close_pairs(distinct, distance, blocks)
    if jaccard is not None:
        alike = durable(alike_pairs(docs.select(own.alias("own"), F.col("text").cast("string").alias("text")), jaccard))
        fp = durable(rows.select("own", "fp").join(alike.select(F.explode(F.array("u", "v")).alias("own")).distinct(), "own", "left_semi").distinct())
        named = alike.join(fp.select(F.col("own").alias("u"), F.col("fp").alias("a")), "u").join(fp.select(F.col("own").alias("v"), F.col("fp").alias("b")), "v")
        links = links.union(named.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct()
    roots = connected_components(durable(links))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    least = F.min(F.struct("key", "own")).alias("r")
    first = rows.groupBy("fp").agg(least).join(labelled, "fp").groupBy("root").agg(F.min("r").alias("r"))
    kept = first.select(F.col("r.key").alias(f"{P}key"), F.col("r.own").alias(f"{P}own"))
    names = [f"{P}key", f"{P}own"]
    return docs.withColumn(names[0], key).withColumn(names[1], own).join(kept, names, "left_semi").dropDuplicates(names).drop(*names)
