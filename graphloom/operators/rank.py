"""Longest-path ranks by contraction, some cycle by pointer doubling, and the places of the diagram.

An entity that depends on nothing has rank 0, any other one more than the deepest
that it depends on. A node is known by base and edges: its rank is the greatest of
its base and of w + rank(to) over its edges. A round
1. ranks the nodes without edges, and turns edges to them into bases;
2. takes the nodes with one edge, whose ranks are max(base, w + rank(to)). Such functions
   compose, so a chain of them is followed by doubling, and edges into the chain go to
   its end at once. These nodes are ranked last, from their chains' ends.
A chain of n nodes takes log n steps, a graph whose nodes have two and more edges each a
round for each rank, and no paths are enumerated. A round without a node of the first kind
has met a cycle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round_half_up
from ..sources.store import dropped, written
from .edges import drawable

# Fixed values of the drawing.
ROW_HEIGHT, NODE_HEIGHT, NODE_GAP, PADDING, CHAR_WIDTH, MIN_NODE_WIDTH, LEGEND_HEIGHT, MIN_WIDTH = 86, 26, 26, 28, 7.3, 78, 34, 320


def _apart(table: DataFrame) -> DataFrame:
    """A side of a join that grows with the graph: it is shuffled. Else each round would send it through the driver while it still fits a broadcast."""
    return table.hint("merge")


#: A remainder of so many edges at most is walked on the driver; a larger one is doubled over.
WALKED = 1 << 17


def _doubled(table: DataFrame, steps: int, join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """join(table, table), so many times; each result is a written table."""
    for _ in range(steps):
        after = written(join(table, table))
        dropped(table)
        table = after
    return table


def cycle_of(ways: DataFrame) -> DataFrame:
    """nth, id of the cycle with the least id among ways (id, to), one way out of every node; it begins there, and is a written table.

    After as many doublings as n has bits every node has jumped onto a cycle, so the places that are
    jumped to are the nodes of cycles; the least id on the way is then the name of its cycle."""
    ways = written(ways.select("id", "to"))
    steps = ways.count().bit_length()
    low = lambda c: F.least("low", F.col(c))

    def jump(x: DataFrame, y: DataFrame) -> DataFrame:
        far = y.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("low").alias("far_low"))
        return x.join(_apart(far), "to").select("id", F.col("far").alias("to"), low("far_low").alias("low"))

    jumped = _doubled(written(ways.select("id", "to", F.col("id").alias("low"))), steps, jump)
    on = written(jumped.join(_apart(jumped.select(F.col("to").alias("id")).distinct()), "id", "left_semi"))
    name = on.agg(F.min("low")).first()[0]
    mine = ways.join(_apart(on.where(F.col("low") == name).select("id")), "id", "left_semi")

    def walk(x: DataFrame, y: DataFrame) -> DataFrame:
        far = y.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("len").alias("more"))
        return x.join(_apart(far), "to", "left").select("id", F.coalesce("far", "to").alias("to"), (F.col("len") + F.coalesce("more", F.lit(0))).alias("len"))

    # The way out of the first node is cut, so that all others walk to it and stop there.
    rest = _doubled(written(mine.where(F.col("id") != name).select("id", "to", F.lit(1).cast("long").alias("len"))), steps, walk)
    length = on.where(F.col("low") == name).count()
    first = ways.sparkSession.createDataFrame([(0, name)], "nth long, id string")
    out = written(first.unionByName(rest.select((length - F.col("len")).alias("nth"), "id")))
    for t in (ways, jumped, on, rest):
        dropped(t)
    return out


def find_cycle(left: DataFrame) -> list[str]:
    """Some cycle among edges (from, to) of which every `from` has one more step to go: the names that a report shows."""
    ways = left.groupBy(F.col("from").alias("id")).agg(F.min("to").alias("to"))
    if left.limit(WALKED + 1).count() > WALKED:
        nodes = [r["id"] for r in cycle_of(ways).orderBy("nth").toLocalIterator()]
        return [*nodes, nodes[0]]
    known = {r[0]: r[1] for r in ways.collect()}
    at, trail, seen = min(known), [], {}
    while at not in seen:
        seen[at] = len(trail)
        trail.append(at)
        at = known[at]
    return [*trail[seen[at] :], at]


def _chains(single: DataFrame) -> tuple[DataFrame, bool]:
    """single (id, base, to, w), followed to the end of each chain, and whether all chains end. A written table."""
    steps = single.count().bit_length()
    for _ in range(steps + 1):
        on = single.select(F.col("id").alias("to"), F.col("base").alias("more"), F.col("to").alias("far"), F.col("w").alias("far_w"))
        if single.join(_apart(on.select("to")), "to", "left_semi").isEmpty():
            return single, True
        joined = single.join(_apart(on), "to", "left")
        after = written(joined.select("id", F.greatest("base", F.col("w") + F.coalesce("more", F.lit(0))).alias("base"), F.coalesce("far", "to").alias("to"), (F.col("w") + F.coalesce("far_w", F.lit(0))).alias("w")))
        dropped(single)
        single = after
    return single, False


def _cyclic(edges: DataFrame, ranked: list[DataFrame], chained: list[DataFrame]) -> ValueError:
    """Names a cycle of the graph's own edges, among the nodes that no rank can be given to: each of these has a way to another."""
    known = _resolved(_one(ranked), chained).select("id") if ranked else None
    if known is not None:
        for end in ("from", "to"):
            edges = edges.join(_apart(known.withColumnRenamed("id", end)), end, "left_anti")
    return ValueError("the asserted graph contains a cycle and cannot be ranked: " + " → ".join(find_cycle(written(edges.select("from", "to")))))


def _resolved(out: DataFrame, chained: list[DataFrame]) -> DataFrame:
    """Ranks (id, rank) with those of chains: a chain ends in a node that was ranked later than it was taken out."""
    for single in reversed(chained):
        ends = single.join(_apart(out.select(F.col("id").alias("to"), "rank")), "to")
        more = written(out.unionByName(ends.select("id", F.greatest("base", F.col("w") + F.col("rank")).alias("rank"))))
        dropped(out)
        dropped(single)
        out = more
    return out


#: Rounds that take off the nodes without edges only: most graphs are not deeper.
PEELED = 3


def rank_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """id, rank. Raises for an entity that was not read, and for a cycle, which it names."""
    unread = [r[0] for r in entities.where("not sources_read").select("id").orderBy("id").limit(20).collect()]
    if unread:
        raise ValueError("cannot rank an entity whose sources were not read: " + ", ".join(unread))
    nodes = written(entities.select("id", F.lit(0).alias("base")).distinct())
    asserted = written(drawable(edges, entities).select("from", "to").distinct())
    left = written(asserted.withColumn("w", F.lit(1)))
    ranked, chained, rounds = [], [], 0
    while not nodes.isEmpty():
        ready = written(nodes.join(_apart(left.select(F.col("from").alias("id")).distinct()), "id", "left_anti").select("id", F.col("base").alias("rank")))
        if ready.isEmpty():
            raise _cyclic(asserted, ranked, chained)
        ranked.append(ready)
        known = ready.select(F.col("id").alias("to"), "rank")
        based = left.join(_apart(known), "to").groupBy(F.col("from").alias("id")).agg(F.max(F.col("w") + F.col("rank")).alias("more"))
        rest = nodes.join(_apart(ready.select("id")), "id", "left_anti").join(_apart(based), "id", "left")
        nodes2 = written(rest.select("id", F.greatest("base", F.coalesce("more", F.lit(0))).alias("base")))
        left2 = written(left.join(_apart(known.select("to")), "to", "left_anti"))
        rounds += 1
        if rounds <= PEELED:
            for t in (nodes, left):
                dropped(t)
            nodes, left = nodes2, left2
            continue
        alone = left2.groupBy(F.col("from").alias("id")).agg(F.count("*").alias("n"), F.max("to").alias("to"), F.max("w").alias("w")).where("n = 1")
        single, ends = _chains(written(nodes2.join(_apart(alone), "id").select("id", "base", "to", "w")))
        if not ends:
            raise _cyclic(asserted, ranked, chained)
        chained.append(single)
        to = single.select(F.col("id").alias("to"), F.col("base").alias("more"), F.col("to").alias("far"), F.col("w").alias("far_w"))
        moved = written(left2.join(_apart(single.select(F.col("id").alias("from"))), "from", "left_anti").join(_apart(to), "to", "left"))
        based = moved.where("more is not null").groupBy(F.col("from").alias("id")).agg(F.max(F.col("w") + F.col("more")).alias("raised"))
        nodes3 = written(nodes2.join(_apart(single.select("id")), "id", "left_anti").join(_apart(based), "id", "left").select("id", F.greatest("base", F.coalesce("raised", F.lit(0))).alias("base")))
        left3 = written(moved.select("from", F.coalesce("far", "to").alias("to"), (F.col("w") + F.coalesce("far_w", F.lit(0))).alias("w")).groupBy("from", "to").agg(F.max("w").alias("w")))
        for t in (nodes, left, nodes2, left2, moved):
            dropped(t)
        nodes, left = nodes3, left3
        if len(ranked) == GATHERED:  # so that the plan does not grow with the rounds
            ranked = [_one(ranked)]
    dropped(asserted)
    return _resolved(_one(ranked), chained) if ranked else nodes.select("id", F.col("base").alias("rank"))


#: Tables of ranks that are held side by side before they are written as one.
GATHERED = 16


def _one(tables: list[DataFrame]) -> DataFrame:
    out = written(reduce(lambda x, y: x.unionByName(y), tables)) if len(tables) > 1 else tables[0]
    for t in tables if len(tables) > 1 else ():
        dropped(t)
    return out


def node_width(ident: Column) -> Column:
    return F.greatest(F.lit(MIN_NODE_WIDTH), round_half_up(F.length(ident) * F.lit(CHAR_WIDTH).cast("double") + 22).cast("int"))


def layout(ranks: DataFrame) -> DataFrame:
    """id, rank, x, y, w, h, and the canvas' width and height, for ranks (id, rank). Rank 0 is at the bottom."""
    sized = ranks.withColumn("w", node_width(F.col("id")))
    rows = sized.groupBy("rank").agg((F.sum("w") + (F.count("*") - 1) * NODE_GAP).alias("row_width"))
    canvas = rows.agg((F.greatest(F.lit(MIN_WIDTH), F.max("row_width")) + 2 * PADDING).alias("width"), F.max("rank").alias("max_rank"))
    before = Window.partitionBy("rank").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum(F.col("w") + NODE_GAP).over(before), F.lit(0))).join(rows, "rank").crossJoin(F.broadcast(canvas))  # one row
    left = round_half_up((F.col("width") - F.col("row_width")) / F.lit(2.0))
    height = (F.col("max_rank") + 1) * ROW_HEIGHT + 2 * PADDING - (ROW_HEIGHT - NODE_HEIGHT) + LEGEND_HEIGHT
    return placed.select(
        "id",
        "rank",
        (left + F.col("before")).cast("long").alias("x"),
        (F.lit(PADDING) + (F.col("max_rank") - F.col("rank")) * ROW_HEIGHT).cast("long").alias("y"),
        F.col("w").cast("long").alias("w"),
        F.lit(NODE_HEIGHT).cast("long").alias("h"),
        F.col("width").cast("long").alias("width"),
        height.cast("long").alias("height"),
    )
