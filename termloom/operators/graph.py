"""Related-term graphs: candidates, scores, symmetric top-k, checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.operators.dictionary import sent_to_all
from termloom.operators.partners import HOLDERS, SEEKERS, profiles, ranked_kinds
from termloom.operators.ranking import placed_in_group
from termloom.operators.taxonomy import UNSORTED
from termloom.sources.shared import kept, removed

MIN_RELATED, MAX_RELATED = 3, 5
#: Short terms that one step of ``refilled`` serves, and kinds of such terms.
STRETCH, STRETCH_KINDS = 524_288, 16_384
#: Terms, or links of terms, that one task takes.
ROWS = 131_072


def edges_of(terms: DataFrame) -> DataFrame:
    """``(src, dst, pos)`` from the arrays of related slugs."""
    return terms.select(F.col("slug").alias("src"), F.posexplode("related").alias("pos", "dst")).select("src", "dst", "pos")


def clean_edges(terms: DataFrame) -> DataFrame:
    """Edges to existing other terms, each once at its first place."""
    e = edges_of(terms).filter("src <> dst").groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    return e.join(terms.select(F.col("slug").alias("dst")), "dst", "left_semi").select("src", "dst", "pos")


def _best(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` best of each group: highest score, then slug."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "dst"))).filter(F.col("rank") <= k)


def tasks_over(rows: DataFrame) -> int:
    """Tasks over kept ``rows``, so that the memory of one does not grow with the table."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))


def best_pairs(terms: DataFrame, k: int = MAX_RELATED, holders: int = HOLDERS, known: DataFrame | None = None) -> DataFrame:
    """``(src, dst, score, rank)``: the best ``k`` partners of each term among all that share a
    category with it; ties go by slug.  Exact; see ``partners`` for scores, bounds and pieces of ``holders`` kinds.
    ``known``: the terms' profiles, if they are kept already."""
    p = kept(profiles(terms)) if known is None else known
    kinds = p.select("sig", "cats", "feats").distinct()
    # One more than wanted, as a term is among its own kind's partners.
    ranked = ranked_kinds(kinds.withColumn("k", F.lit(k + 1)), kinds, p.select("sig", "slug"), (SEEKERS, max(holders, 1)))
    lists = kept(ranked.groupBy("sig").agg(F.collect_list(F.struct("dst", "score")).alias("best")))
    # A kind's list goes to its terms whole, and is written out only where the terms are dealt evenly: no task sorts more than its share.
    n = tasks_over(p)
    own = p.select(F.col("slug").alias("src"), "sig").join(sent_to_all(lists), "sig").select("src", "best").repartition(n, "src")
    return _best(own.select("src", F.inline("best")).filter("src <> dst").select("src", "dst", "score"), "src", k)


def fill(terms: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Terms with under three links take their best candidates until they have five.

    No term looks at another's list here, so all fill at once.  A term that is short has at
    most two links, so of its seven best candidates at least five are new.
    """
    own = clean_edges(terms)
    have = terms.select(F.col("slug").alias("src")).join(own.groupBy("src").agg(F.count("*").alias("n")), "src", "left").fillna(0, ["n"])
    short = have.filter(F.col("n") < MIN_RELATED)
    best = best_pairs(terms, MAX_RELATED + MIN_RELATED - 1, known=known).drop("rank").join(short, "src").join(own, ["src", "dst"], "left_anti")
    new = _best(best, "src", MAX_RELATED).filter(F.col("rank") <= MAX_RELATED - F.col("n")).select("src", "dst", (F.col("rank") + 1_000_000).alias("pos"))
    return own.unionByName(new)


def mutual_top(best: DataFrame, tasks: int | None = None) -> DataFrame:
    """Symmetric links by sets: those of ``best_pairs`` that are among both ends' best.  Both directions of a pair meet in one of ``tasks``.

    Never exceeds k and does not depend on order, but may leave a term short of three;
    ``reconcile`` gives the order-dependent lists.
    """
    back = best.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rank").alias("back_rank"))
    if tasks:
        best, back = best.repartition(tasks, "src", "dst"), back.repartition(tasks, "src", "dst")
    return best.join(back, ["src", "dst"]).select("src", "dst", "score", "rank")


def reciprocated(terms: DataFrame, links: DataFrame) -> DataFrame:
    """``(src, dst, pos)``: every one-way link is answered or dropped, term after term in input order.

    A term asks, at its turn, each one-way partner for a link back.  A list with room (under
    five) accepts; otherwise the term drops its own link.  What a list accepts follows
    from ranks, with no fold over the terms: before its owner's turn it takes the first
    askers that fit; at that turn it loses the links that were refused to the owner; after
    it, the first later askers that fit what is then free.  Only the last depends on other lists,
    by how many of them refused the owner.  Each round bounds that number from both sides and settles every asker whose
    answer is the same at either bound; in any case the earliest list that is open is settled.  A round is one join
    over the links still open, and only chains of links to ever earlier terms on which room really hangs need many.
    """
    order = terms.select("slug", "term_ord")
    e = links.select("src", "dst", "pos").join(order.select(F.col("slug").alias("src"), F.col("term_ord").alias("at")), "src").join(
        order.select(F.col("slug").alias("dst"), F.col("term_ord").alias("turn")), "dst")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("answered"))
    e = kept(e.join(back, ["src", "dst"], "left").withColumn("answered", F.coalesce("answered", F.lit(False))))
    room = e.groupBy(F.col("src").alias("dst")).agg((MAX_RELATED - F.count("*")).alias("room"))
    asks = e.filter("not answered").join(room, "dst", "left").withColumn("room", F.coalesce("room", F.lit(MAX_RELATED)))
    early = F.col("at") < F.col("turn")
    asks = asks.withColumn("early", early)
    # A list never takes more than five, so later places need no number.
    nth = F.row_number().over(W.partitionBy("dst", "early").orderBy("at"))
    first = asks.select("src", "dst", "early", "at").withColumn("nth", nth).filter(F.col("nth") <= MAX_RELATED).select("src", "dst", "nth")
    asks = kept(asks.join(first, ["src", "dst"], "left").withColumn("nth", F.coalesce("nth", F.lit(1 << 30))))
    # Room that is left on a list after its early askers; its owner's refused links are added to it.
    taken = asks.filter("early").groupBy("dst").agg(F.greatest(F.least(F.count("*"), F.max("room")), F.lit(0)).alias("took"))
    asks = kept(asks.join(taken, "dst", "left").withColumn("left", F.col("room") - F.coalesce("took", F.lit(0))).drop("took"))
    done = asks.filter("early").select("src", "dst", (F.col("nth") <= F.col("room")).alias("ok"))
    opened = asks.filter("not early")
    n_asks = kept(asks.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("asked")))
    done, opened = kept(done), kept(opened.join(n_asks, "dst", "left").fillna(0, ["asked"]))
    while opened.limit(1).count():
        settled = done.groupBy(F.col("src").alias("dst")).agg(F.count_if("ok").alias("took"), F.count_if(~F.col("ok")).alias("refused"))
        state = opened.join(settled, "dst", "left").fillna(0, ["took", "refused"])
        # An owner gets back at least the links refused so far, at most those not accepted so far.
        yes, no = F.col("nth") <= F.col("left") + F.col("refused"), F.col("nth") > F.col("left") + F.col("asked") - F.col("took")
        state = kept(state.withColumn("ok", F.when(yes, True).when(no, False)).drop("took", "refused"))
        before = done, opened
        done = kept(done.unionByName(state.filter("ok IS NOT NULL").select("src", "dst", "ok")))
        opened = kept(state.filter("ok IS NULL").drop("ok"))
        removed(*before, state)
    own = e.join(done, ["src", "dst"], "left").filter("answered or ok").select("src", "dst", F.col("pos").cast("long").alias("pos"))
    pushed = done.filter("ok").join(order.select(F.col("slug").alias("src"), "term_ord"), "src")
    return own.unionByName(pushed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("term_ord") + 2_000_000).cast("long").alias("pos")))


def _served(members: pa.Table, lists: pa.Table) -> pa.Table:
    """Serve ``members`` in input order, each with the first candidates of its kind that have room.

    Ends at the first member whose list ends before it has enough though the kind has more candidates.  The last row
    holds, without a partner, the last member served.  Names stay in Arrow's buffers; terms are numbers here.
    """
    flat = members["links"].combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    names = pc.unique(pa.chunked_array([*members["slug"].chunks, *lists["dst"].chunks, flat.flatten()], pa.string()))
    number = lambda c: np.asarray(pc.index_in(c, value_set=names), np.int64)
    own, other, links = number(members["slug"]), number(lists["dst"]), number(flat.flatten())
    ends = np.asarray(pc.list_value_length(flat)).cumsum()
    size = np.zeros(len(names), np.int64)
    size[other] = np.asarray(lists["z"])
    size[own] = np.asarray(members["z"])
    size = size.tolist()
    kinds = pc.unique(pa.chunked_array([*members["sig"].chunks, *lists["sig"].chunks], pa.string()))
    kind, of = (np.asarray(pc.index_in(t["sig"], value_set=kinds), np.int64) for t in (members, lists))
    order = np.lexsort((np.asarray(lists["rank"]), of))
    cuts, ranked = np.searchsorted(of[order], np.arange(len(kinds) + 1)).tolist(), other[order]
    whole = np.ones(len(kinds), bool)
    whole[of] = np.asarray(lists["whole"])
    first = list(cuts[:-1])
    gained: dict[int, list[int]] = {}
    at, turns = np.asarray(members["at"]), np.argsort(np.asarray(members["at"]), kind="stable")
    src, dst, when, nth, last = [], [], [], [], None
    for t in turns.tolist():
        me, k = int(own[t]), int(kind[t])
        i, to = first[k], cuts[k + 1]
        while i < to and size[ranked[i]] >= MAX_RELATED:
            i += 1
        first[k] = i
        need, picks = MIN_RELATED - size[me], []
        mine = {me, *links[ends[t - 1] if t else 0 : ends[t]].tolist(), *gained.get(me, ())} if need > 0 else ()
        while len(picks) < need and i < to:
            one = int(ranked[i])
            if size[one] < MAX_RELATED and one not in mine:
                picks.append(one)
            i += 1
        if len(picks) < need and not whole[k]:
            break
        for n, one in enumerate(picks):
            size[me] += 1
            size[one] += 1
            gained.setdefault(one, []).append(me)
            src.append(me)
            dst.append(one)
            when.append(int(at[t]))
            nth.append(n)
        last = int(at[t])
    name = lambda c: names.take(pa.array([*c, None], pa.int64()))
    return pa.table({"src": name(src), "dst": name(dst), "at": pa.array([*when, last], pa.int64()), "n": pa.array([*nth, 0], pa.int32())})


def refilled(terms: DataFrame, links: DataFrame, stretch: int = STRETCH, stretch_kinds: int = STRETCH_KINDS, known: DataFrame | None = None) -> DataFrame:
    """Terms with under three links take, in input order, their best candidates that still have room;
    both ends gain the link.

    What a term takes depends on what every earlier one took, so short terms are served in input order, a stretch of bounded
    size at a time.  Before each stretch all lists and their room are brought up to date by joins, and each *kind* in
    it gets one ranked list of the terms with room, long enough for all its members: terms that tie share a list and take
    the next free places of it one after the other.  A task then serves the stretch; it holds at most ``stretch`` terms of
    at most ``stretch_kinds`` kinds, three candidates for each term and 32 for each kind.  If other kinds have used up a list that was cut, the stretch ends there and the
    next one begins with a fresh list.  So steps are the number of short terms over ``stretch`` (over ``stretch_kinds`` where all are of different kinds), ties or not, and every step
    serves at least one term.
    """
    p = kept((profiles(terms) if known is None else known).join(terms.select("slug", F.col("term_ord").cast("long").alias("at")), "slug"))
    kinds = kept(p.select("sig", "cats", "feats").distinct())
    now, gained, served = links.select("src", "dst"), None, None
    while True:
        size = now.groupBy(F.col("src").alias("slug")).agg(F.count("*").cast("int").alias("z"), F.collect_list("dst").alias("links"))
        state = kept(p.select("slug", "at", "sig").join(size, "slug", "left").select(
            "slug", "at", "sig", F.coalesce("z", F.lit(0)).alias("z"), F.when(F.col("z") < MIN_RELATED, F.col("links")).otherwise(F.array().cast("array<string>")).alias("links")))
        short = state.filter(F.col("z") < MIN_RELATED)
        short = short if served is None else short.filter(F.col("at") > served)
        # Where the first kind too many begins.
        over = short.groupBy("sig").agg(F.min("at").alias("at")).orderBy("at").limit(stretch_kinds + 1).agg(F.when(F.count("*") > stretch_kinds, F.max("at"))).first()[0]
        short = short if over is None else short.filter(F.col("at") < over)
        members = kept(short.orderBy("at").limit(stretch)).withColumn("links", F.coalesce("links", F.array().cast("array<string>")))
        if not members.limit(1).count():
            break
        room = state.filter(F.col("z") < MAX_RELATED)
        wanted = members.groupBy("sig").agg((MIN_RELATED * F.count("*") + 32).cast("int").alias("k"))
        holders = kinds.join(room.select("sig").distinct(), "sig", "left_semi")
        lists = ranked_kinds(kinds.join(wanted, "sig"), holders, room.select("sig", "slug"))
        n = W.partitionBy("sig")
        lists = lists.join(wanted, "sig").withColumn("whole", F.count("*").over(n) < F.col("k")).join(room.select(F.col("slug").alias("dst"), "z"), "dst")
        one = lambda d, *c: d.select(F.lit(0).alias("one"), *c).groupBy("one")
        picks = kept(
            one(members, "at", "slug", "sig", "z", "links").cogroup(one(lists, "sig", "rank", "dst", "z", "whole"))
            .applyInArrow(lambda m, c: _served(m, c), "src string, dst string, at long, n int"))
        served = picks.agg(F.max("at")).first()[0]
        new = picks.filter("src IS NOT NULL")
        both = new.select("src", "dst", (F.col("at") * 8 + F.col("n") + (1 << 40)).alias("pos")).unionByName(
            new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("at") * 8 + (1 << 40)).alias("pos")))
        before, gained = gained, kept(both if gained is None else gained.unionByName(both))
        removed(*([before] if before is not None else []), picks, state)
        now = links.select("src", "dst").unionByName(gained.select("src", "dst"))
    removed(kinds, p)
    return links if gained is None else links.unionByName(gained)


def reconcile(terms: DataFrame, links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(src, dst, pos)``: the order-dependent passes over all terms: answer or drop one-way links
    (``reciprocated``), refill terms under three (``refilled``), keep five.
    ``known``: the terms' profiles, if they are kept already."""
    done = refilled(terms, kept(reciprocated(terms, links)), known=known)
    place = F.row_number().over(W.partitionBy("src").orderBy("pos", "dst"))
    return done.withColumn("place", place).filter(F.col("place") <= MAX_RELATED).select("src", "dst", (F.col("place") - 1).alias("pos"))


def asymmetric(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(src, dst)``: edges without their reverse, each once.  Both directions of a pair meet in one of ``tasks``."""
    onward = F.coalesce(F.col("src") <= F.col("dst"), F.lit(True))
    pair = edges.select(
        F.when(onward, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(onward, F.col("dst")).otherwise(F.col("src")).alias("b"),
        onward.alias("onward"), F.coalesce(F.col("src") >= F.col("dst"), F.lit(False)).alias("back"))
    pair = pair.repartition(tasks, "a", "b") if tasks else pair
    ways = pair.groupBy("a", "b").agg(F.bool_or("onward").alias("onward"), F.bool_or("back").alias("back")).filter("onward <> back")
    return ways.select(F.when(F.col("onward"), F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("onward"), F.col("b")).otherwise(F.col("a")).alias("dst"))


def undirected(edges: DataFrame, ord_cols: tuple[str, ...] = ("src_ord", "pos"), tasks: int | None = None) -> DataFrame:
    """Each pair once, in the direction that comes first; no self links.  Both directions of a pair meet in one of ``tasks``."""
    pair = edges.filter("src <> dst").withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    pair = pair.repartition(tasks, "a", "b") if tasks else pair
    first = F.min(F.struct(*ord_cols, "src", "dst"))
    return pair.groupBy("a", "b").agg(first.alias("f")).select("f.src", "f.dst")


def grouped(terms: DataFrame) -> DataFrame:
    """``(slug, term_ord, grp)``; no subcategory counts as unsorted."""
    return terms.select("slug", "term_ord", F.coalesce(F.when(F.col("subcategory") != "", F.col("subcategory")), F.lit(UNSORTED)).alias("grp"))


def inner_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges inside a group: ``(grp, src, dst, pos)``; self links included."""
    a = nodes.select(F.col("slug").alias("src"), "grp")
    b = nodes.select(F.col("slug").alias("dst"), "grp")
    return edges.join(a, "src").join(b, ["dst", "grp"]).select("grp", "src", "dst", "pos")


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links that each term receives inside its group, 0 included."""
    n = inner_edges(nodes, edges).groupBy(F.col("dst").alias("slug")).agg(F.count("*").alias("inbound"))
    return nodes.join(n, "slug", "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))


def degree(edges: DataFrame) -> DataFrame:
    """Ends of edges at each node."""
    return edges.select(F.explode(F.array("src", "dst")).alias("slug")).groupBy("slug").agg(F.count("*").alias("degree"))


def largest_subgraph(edges: DataFrame, k: int = 20) -> DataFrame:
    """Edges between the ``k`` nodes of highest degree."""
    top = degree(edges).orderBy(F.desc("degree"), "slug").limit(k).select("slug")
    return edges.join(F.broadcast(top.withColumnRenamed("slug", "src")), "src", "left_semi").join(F.broadcast(top.withColumnRenamed("slug", "dst")), "dst", "left_semi")


def circular_layout(nodes: DataFrame, radius: float = 100.0) -> DataFrame:
    """Each group's terms on a circle in input order, the first at the top."""
    n = nodes.groupBy("grp").agg(F.count("*").alias("n"))
    placed = placed_in_group(nodes, ["grp"], [F.floor(F.col("term_ord") / 65536)], ["term_ord"], "i").join(n, "grp")
    angle = 2 * F.pi() * (F.col("i") - 1) / F.col("n") - F.pi() / 2
    return placed.select("slug", "grp", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))
