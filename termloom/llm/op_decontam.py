"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a window of ``SPAN`` tokens hashed at the positions a mask selects, so
tokens in the other positions may differ.  Test and training seeds join on the
hash; a hit fixes an alignment, whose overlap around the seed is then checked
token by token.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import P

SPAN = 8
#: Positions that each mask reads.  Together they hit every 13-token overlap with
#: up to two substituted tokens, wherever these are (checked over all cases in the tests).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
#: Further masks for items under 13 tokens: with MASKS, they hit every item of 8 to 12
#: tokens with as many substituted ones as it allows (1, 1, 2, 2, 2), wherever these are.
SHORT_MASKS = ((0, 2, 3, 4, 7), (0, 1, 3, 6, 7), (1, 2, 3, 4, 5))
#: An overlap counts from this many aligned tokens of which this share is equal.
OVERLAP, SIMILARITY = 13, 0.8
#: Tokens before and in all around a seed that its overlaps can reach.
BEFORE = OVERLAP - SPAN
AROUND = BEFORE + SPAN + BEFORE
#: Windows of a text that one row carries at most.
PART = 2048
#: The test side is broadcast up to so many tokens (about 100 bytes each, with its
#: alignment arrays); beyond it, the join shuffles.
BROADCAST_TOKENS = 200_000


def _tokens(text: str) -> Column:
    """Hashes of the runs of letters and digits, lower-cased."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _padded(toks: str) -> Column:
    """The tokens with nulls at both ends, so that each seed has its surroundings."""
    null = F.lit(None).cast("long")
    return F.concat(F.array_repeat(null, BEFORE), F.col(toks), F.array_repeat(null, BEFORE))


def _windows(df: DataFrame, size: int, masks: tuple, *carry: str) -> DataFrame:
    """``(*carry, chunk, part, l, s0, s1, ...)``: a row for each token window of SPAN.

    Texts are cut into parts of ``size`` windows first, so that no row of a very
    long text carries more than a part.  ``s0, s1, ...`` are the window's seeds under
    the masks; ``part`` holds the part's tokens with surroundings, ``l`` the
    window's place in it.
    """
    n = F.size("toks") - (SPAN - 1)
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")),
        lambda c: F.struct(c.alias("chunk"), F.slice("pad", c * size + 1, F.lit(size + AROUND - 1)).alias("part"), F.least(n - c * size, F.lit(size)).alias("m")),
    )
    # Outer generators: before the plain ones Catalyst drops empty arrays, computing each twice.
    cut = df.withColumn("pad", _padded("toks")).select(*carry, F.inline_outer(F.when(n > 0, chunks))).filter("m is not null")
    zipped = F.arrays_zip(*[F.slice("part", BEFORE + i + 1, F.col("m")).alias(f"t{i}") for i in range(SPAN)])
    seeds = [F.xxhash64(F.lit(m), *[F.col(f"w.t{i}") for i in mask]).alias(f"s{m}") for m, mask in enumerate(masks)]
    return cut.select(*carry, "chunk", "part", F.posexplode_outer(zipped).alias("l", "w")).select(*carry, "chunk", "part", "l", *seeds)


def _test_seeds(benchmark: DataFrame, masks: tuple) -> DataFrame:
    """``(mask, seed, hit)``: the seeds of the test items, a row for each place, with the
    tokens around it and the number of equal ones that an overlap needs."""
    n = F.size("toks")
    need = F.ceil(F.least(n, F.lit(OVERLAP)) * SIMILARITY).cast("int")
    rows = _windows(benchmark.withColumn("need", need), PART, masks, "item_id", "need")
    hit = F.struct("item_id", (F.col("chunk") * PART + F.col("l")).alias("q"), "need", F.slice("part", F.col("l") + 1, F.lit(AROUND)).alias("around"))
    both = rows.select(hit.alias("hit"), F.posexplode(F.array(*[f"s{m}" for m in range(len(masks))])).alias("mask", "seed"))
    # Items of 13 tokens or more need no further masks.
    return both.filter((F.col("mask") < len(MASKS)) | (F.col("hit.need") < math.ceil(OVERLAP * SIMILARITY)))


def _best(doc: Column, item: Column) -> Column:
    """The most equal tokens of any overlap around the seed."""
    equal = F.zip_with(doc, item, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    sums = F.transform(F.sequence(F.lit(0), F.lit(BEFORE)), lambda t: F.aggregate(F.slice(equal, t + 1, F.lit(OVERLAP)), F.lit(0), lambda x, y: x + y))
    return F.array_max(sums)


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """One row per contaminated document and test item.

    ``doc_id, item_id, shift, n_equal, item_from, item_to``: the most equal tokens in
    an overlap, the ``shift`` (document token on which item token 0 falls; of equal
    ones the least) at which it lies, and the item tokens, from and up to, that the
    seeds of all found overlaps span.

    An overlap is 13 aligned tokens around a seed, of which 80 % (11) are equal; in items
    of 8 to 12 tokens, 80 % of the item (7, 8, 8, 9, 10), of which eight in a row stand
    opposite document tokens.  Items under 8 tokens are too short to tell and
    match nothing, as do documents under 8 tokens and null texts on either side.
    Rows with a null doc_id are reported under null.  Rows that repeat give one
    row; an item_id given to several texts stands for all of them.  Extra columns are ignored.
    """
    return _contaminated(docs, benchmark, broadcast_tokens)


def _contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS, keys: tuple = ()) -> DataFrame:
    """As ``contaminated``, with a row for each value of the columns ``keys`` of ``docs`` too."""
    d = docs.select(*keys, F.col("doc_id").cast("long").alias("doc_id"), _tokens("text").alias("toks"))
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _tokens("text").alias("toks")).filter(F.size("toks") >= SPAN)
    size, least = b.agg(F.sum(F.size("toks").cast("long")), F.min(F.size("toks"))).first()
    size, masks = size or 0, MASKS + SHORT_MASKS if (least or OVERLAP) < OVERLAP else MASKS
    test = _test_seeds(b, masks)
    rows = _windows(d, PART, masks, *keys, "doc_id")
    probes = [F.struct(F.lit(m).alias("mask"), F.col(f"s{m}").alias("seed")) for m in range(len(masks))]
    if size <= broadcast_tokens:
        # The test items' different seeds, a number each, are looked up inside the scan's own stage; only windows that hit leave it.
        for m in range(len(masks)):
            seeds = test.filter(F.col("mask") == m).select(F.col("seed").alias(f"s{m}")).distinct().withColumn(f"k{m}", F.lit(True))
            rows = rows.join(F.broadcast(seeds), f"s{m}", "left")
        rows = rows.filter(F.coalesce(*[f"k{m}" for m in range(len(masks))]).isNotNull())
        probes = [F.when(F.col(f"k{m}"), p) for m, p in enumerate(probes)]
    # Windows meet the places of their seeds by an ordinary join, which can be split: no seed's places are gathered in a row.
    found = rows.select(
        *keys, "doc_id", (F.col("chunk") * PART + F.col("l")).alias("at"), F.slice("part", F.col("l") + 1, F.lit(AROUND)).alias("around"),
        F.explode(F.array_compact(F.array(*probes))).alias("p"),
    )
    places = test.select(F.struct("mask", "seed").alias("q"), "hit")
    hits = found.join(places, F.col("p") == F.col("q")).select(*keys, "doc_id", "at", "around", "hit")
    good = hits.select(*keys, "doc_id", "hit.item_id", "hit.q", "hit.need", (F.col("at") - F.col("hit.q")).alias("shift"), _best(F.col("around"), F.col("hit.around")).alias("n_equal"))
    return (
        good.filter("n_equal >= need")
        .groupBy(*keys, "doc_id", "item_id")
        .agg(F.max(F.shiftleft(F.col("n_equal").cast("long"), 40) + (1 << 39) - F.col("shift")).alias("top"), F.min("q").alias("item_from"), (F.max("q") + SPAN).alias("item_to"))
        .select(
            *keys, "doc_id", "item_id",
            ((1 << 39) - F.col("top").bitwiseAND(F.lit((1 << 40) - 1))).alias("shift"),
            F.shiftright("top", 40).alias("n_equal"),
            F.col("item_from").cast("long").alias("item_from"),
            F.col("item_to").cast("long").alias("item_to"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that hold no passage of the test items.

    Rows are told apart by doc_id and text, so that neither a null nor a repeated
    doc_id takes clean texts along.
    """
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    key = f"{P}text"
    marked = docs.select("doc_id", "text", own.alias(key))
    bad = _contaminated(marked, benchmark, keys=(key,)).select(F.col("doc_id").alias(f"{P}doc"), key).distinct()
    rows = docs.withColumn(f"{P}own", own)
    same = rows["doc_id"].cast("long").eqNullSafe(bad[f"{P}doc"]) & (rows[f"{P}own"] == bad[key])
    return rows.join(bad, same, "left_anti").drop(f"{P}own")
