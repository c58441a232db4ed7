"""Tables in the shared folder, key sharing, and connected components.

What is kept between jobs is written to the folder that the session names in
spark.checkpoint.dir, which every executor reads; a lost executor costs a
task, not the table. Nothing here is collected: the driver sees counts, and the
few most common keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import dropped, shared_folder
from . import words as W


def saved(df: DataFrame) -> DataFrame:
    """df as a written table: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: The most common keys are told apart by a count over one row in so many; which ones they are decides the plan and no result.
HOT_SHARE, HOT_SEEN, HOT_KEYS = 64, 16, 1024


def hot_keys(members: DataFrame) -> list[int]:
    """Up to HOT_KEYS keys that hold some thousand rows or more."""
    some = members.where(F.pmod(F.xxhash64("key", "id"), F.lit(HOT_SHARE)) == 0).groupBy("key").agg(F.count("*").alias("seen"))
    return [r[0] for r in some.where(F.col("seen") >= HOT_SEEN).orderBy(F.desc("seen"), "key").limit(HOT_KEYS).collect()]


def shared_keys(members: DataFrame) -> DataFrame:
    """members (key long, id long, n long) with each key's first member as pivot and pivot_n; keys of one id are left out.

    The rows of a key pass in order of id and are never held together. Those of the most common keys stay where
    they are: only their first member is found, by partial aggregates, and sent to them."""
    members = members.select("key", "id", "n")
    hot = hot_keys(members)
    rest = _streamed(members.where(~F.col("key").isin(hot)) if hot else members)
    if not hot:
        return rest
    there = members.where(F.col("key").isin(hot))
    first = there.groupBy("key").agg(F.min(F.struct("id", "n")).alias("first"), F.max("id").alias("last")).where("first.id < last")
    return rest.unionByName(there.join(F.broadcast(first), "key").select("key", "id", "n", F.col("first.id").alias("pivot"), F.col("first.n").alias("pivot_n")))


def _streamed(members: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_id = None  # of the row before
        pivot = pivot_n = None  # of the last key
        told = False  # whether the pivot's own row has gone out
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, n = (np.asarray(batch.column(i)) for i in range(3))
            fresh = np.empty(len(key), dtype=bool)
            fresh[0] = last_key is None or key[0] != last_key
            fresh[1:] = key[1:] != key[:-1]
            again = np.zeros(len(key), dtype=bool)
            again[1:] = ~fresh[1:] & (ids[1:] == ids[:-1])
            again[0] = not fresh[0] and ids[0] == last_id
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
            at = np.maximum(start, 0)
            p = np.where(start >= 0, ids[at], pivot if pivot is not None else 0)
            pn = np.where(start >= 0, n[at], pivot_n if pivot_n is not None else 0)
            keep = ~fresh & (ids != p) & ~again
            own = np.zeros(len(key), dtype=bool)  # the pivots of keys with other members
            own[at[keep & (start >= 0)]] = True
            out = np.flatnonzero(keep | own)
            cols = [key[out], ids[out], n[out], p[out], pn[out]]
            carried = np.flatnonzero(keep & (start < 0))
            if len(carried) and not told:
                k = carried[0]
                cols = [np.insert(c, 0, v) for c, v in zip(cols, (key[k], pivot, pivot_n, pivot, pivot_n), strict=True)]
            told = bool(own[at[-1]]) if start[-1] >= 0 else told or bool(len(carried))
            pivot, pivot_n, last_key, last_id = p[-1], pn[-1], key[-1], ids[-1]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "id", "n", "pivot", "pivot_n"])

    dealt = members.repartition(parts(members), "key").sortWithinPartitions("key", "id", "n")
    return dealt.mapInArrow(run, "key long, id long, n long, pivot long, pivot_n long")


def components(links: DataFrame) -> DataFrame:
    """id, root: for each id in links (a, b) the smallest id that it reaches. A written table.

    Each round takes every node's smallest smaller neighbour as its parent, links its other smaller
    neighbours to that parent, and lets every node skip to its parent's parent."""
    edges = saved(links.select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("p")).where("c <> p").distinct())
    while True:
        parent = edges.groupBy("c").agg(F.min("p").alias("p"))
        small = parent.select(F.col("c"), F.col("p").alias("m"))
        rest = edges.join(small, "c").where("p > m").select(F.col("p").alias("c"), F.col("m").alias("p"))
        above = parent.select(F.col("c").alias("p"), F.col("p").alias("q"))
        jump = parent.join(above, "p", "left").select("c", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved"))
        after = saved(jump.unionByName(rest.withColumn("moved", F.lit(True))).groupBy("c", "p").agg(F.max("moved").alias("moved")))
        dropped(edges)
        if not after.where("moved").limit(1).count():
            roots = after.select("p").distinct().select(F.col("p").alias("id"), F.col("p").alias("root"))
            out = saved(after.select(F.col("c").alias("id"), F.col("p").alias("root")).unionByName(roots))
            dropped(after)
            return out
        edges = after.select("c", "p")
        edges._saved_at = after._saved_at


def joined_further(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (id, root) after more links (a, b) between any ids; those that roots does not know may be new. A written table."""
    root_of = lambda name: roots.select(F.col("id").alias(name), F.col("root").alias(f"{name}_root"))
    between = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    further = components(between)
    known = roots.join(further.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    out = saved(known.unionByName(further.join(roots.select("id"), "id", "left_anti")))
    dropped(further)
    return out


#: Members of a key that are still in different components: up to so many are held against each other as pairs.
FEW = 16


def linked(members: DataFrame, fetch: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], crowd: Callable[[DataFrame], DataFrame], least_percent: int, marks: list[str], likely: str = "true") -> DataFrame:
    """id, root over all verified pairs that share a key; the pairs that are looked at are linear in the members.

    First members of a key are held against the key's first member. Of a key with few members that are still in
    different components then, all such pairs are. The members of other such keys go to crowd, each once.
    least_percent: 100 x the smaller n must be that many percent of the larger n at least.
    fetch takes a table of ids, all that share a key, and returns one with what verify needs of each.
    verify takes pairs (a, b) and that table, and returns those pairs that are links.
    crowd takes a table of ids and returns a written table of links (a, b) that connect whatever is linked among them.
    marks are columns of fetch's table; likely is a condition on x_<mark> and y_<mark> of the pairs past the first members."""
    rows = saved(shared_keys(members))
    ids = saved(rows.select("id").distinct())
    held = saved(fetch(ids))
    dropped(ids)
    fits = F.expr(f"100 * least(x_n, y_n) >= {least_percent} * greatest(x_n, y_n)")
    star = rows.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("x_n"), F.col("pivot_n").alias("y_n"))
    first = saved(verify(star.where(fits).select("a", "b").distinct(), held))
    roots = components(first)
    # The first member has met all others. Those that are all of one component need no more.
    label = saved(rows.where("id <> pivot").distinct().join(roots, "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root")))
    dropped(rows)
    mixed = label.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many")).where("low < high")
    mixed = saved(mixed.select("key", (F.col("many") <= FEW).alias("few")))
    left = saved(label.join(sized(mixed), "key"))
    dropped(label)
    few = left.where("few").join(held.select("id", *marks), "id")
    x, y = (few.select("key", F.col("id").alias(name), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "root", *marks)]) for name, side in (("a", "x"), ("b", "y")))
    second = saved(verify(x.join(y, "key").where("a > b and x_root <> y_root").where(fits).where(likely).select("a", "b").distinct(), held))
    many = saved(left.where("not few").select("id").distinct())
    further = crowd(many) if many.limit(1).count() else None
    out = joined_further(roots, second.unionByName(further) if further is not None else second)
    for t in (mixed, left, first, second, many, further, roots, held):
        if t is not None:
            dropped(t)
    return out


#: A key's members come in a pseudo-random order. Each meets the first NEAR before it, and the KEPT that are most like it go on
#: (each of the first CLOSE goes on with all before it). Bits of 120 in which the SimHashes of a pair may differ: among the
#: first CLOSE, and past them; and below which a member counts as a copy of one of the first NEAR.
CLOSE, NEAR, KEPT, LOOSE, TIGHT, COPY = 8, 128, 3, 48, 38, 10
#: The same for members whose sizes make a SimHash vague.
VAGUE = 58
#: Bits of SimHash by which the members past the first NEAR are told apart in the next round.
STEP_BITS = 8
#: A mark is 120 bits of SimHash, two numbers, of which the second ends in an 8-bit code of the size.
_CODE = 0xFF
SIZE_STEP = 1.1


def size_code(n: np.ndarray) -> np.ndarray:
    """Sizes within a fifth of each other have codes that differ by 3 at most."""
    return np.minimum(np.log(np.maximum(n, 1)) / np.log(SIZE_STEP), _CODE).astype(np.uint64)


def marks_of(sim: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sim[:, 0], sim[:, 1] & ~np.uint64(_CODE) | size_code(n)


_FAR, _SHORT = 255, 1 << 9


def gaps(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In how many bits the marks x and y differ; _FAR where their sizes forbid a link. Both broadcast against each other."""
    code = np.uint64(_CODE)
    out = np.bitwise_count(x[0] ^ y[0]) + np.bitwise_count((x[1] ^ y[1]) & ~code)
    cx, cy = (x[1] & code).astype(np.int16), (y[1] & code).astype(np.int16)
    return np.where(np.abs(cx - cy) <= 3, out, np.uint8(_FAR))


class Group:
    """The first NEAR members of a key, in order: ids, and marks. Members that repeat an id are one."""

    def __init__(self):
        self.ids, self.m0, self.m1 = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def take(self, ids: np.ndarray, m0: np.ndarray, m1: np.ndarray) -> None:
        room = NEAR - len(self.ids)
        if room > 0:
            self.ids, self.m0, self.m1 = (np.concatenate([have, more[:room]]) for have, more in ((self.ids, ids), (self.m0, m0), (self.m1, m1)))

    def meet(self, ids: np.ndarray, m0: np.ndarray, m1: np.ndarray, place: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (a, b, gap) of members at the given places with earlier ones, and which members are past the first NEAR and like none of them."""
        some_a, some_b, some_d, late = [], [], [], []
        for at in range(0, len(ids), 4096):
            part = slice(at, at + 4096)
            d = gaps((m0[part, None], m1[part, None]), (self.m0[None, :], self.m1[None, :]))
            p = place[part, None]
            d[np.arange(len(self.ids))[None, :] >= p] = _FAR
            short = (m1[part] & np.uint64(_CODE)).astype(np.int64) <= low
            most = np.where(p[:, 0] < CLOSE, LOOSE, TIGHT)
            most[short] = VAGUE
            good = d <= most[:, None]
            if d.shape[1] > KEPT:
                far = (p[:, 0] >= CLOSE) & (good.sum(axis=1) > KEPT)
                if far.any():
                    bar = np.partition(d[far], KEPT - 1, axis=1)[:, KEPT - 1]
                    good[far] &= d[far] <= bar[:, None]
            x, y = np.nonzero(good)
            some_a.append(ids[part][x])
            some_b.append(self.ids[y])
            some_d.append(d[x, y] + _SHORT * short[x])
            late.append((place[part] >= NEAR) & (d.min(axis=1, initial=_FAR) > COPY))
        a, b, d, late = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (some_a, some_b, some_d, late))
        return np.maximum(a, b), np.minimum(a, b), d, late.astype(bool)


#: Groups of up to so many members, NEAR at most, are compared together, about so many pairs at a time.
TOGETHER, PAIRS = 64, 1 << 18


def _groups_met(ids: np.ndarray, m0: np.ndarray, m1: np.ndarray, start: np.ndarray, size: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a, b, gap) of many whole groups, each `size` rows from `start`: what Group.meet gives for one group after the other."""
    start, size = start[size > 1], size[size > 1]
    edge = np.concatenate([[0], np.cumsum(size * (size - 1) // 2)])
    cuts = np.unique(np.searchsorted(edge, np.arange(0, edge[-1] + PAIRS, PAIRS)))
    code = (m1 & np.uint64(_CODE)).astype(np.int16)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        n = size[lo:hi]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(start[lo:hi], n)
        row = np.repeat(np.arange(len(place)), place)  # each member once for every one before it
        y = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(place) - place, place)
        x = first[row] + place[row]
        near = np.abs(code[x] - code[y]) <= 3
        row, x, y = row[near], x[near], y[near]
        d = np.bitwise_count(m0[x] ^ m0[y]) + np.bitwise_count((m1[x] ^ m1[y]) & ~np.uint64(_CODE))
        short = code[x] <= low
        good = d <= np.where(short, VAGUE, np.where(place[row] < CLOSE, LOOSE, TIGHT))
        row, x, y, d, short = row[good], x[good], y[good], d[good], short[good]
        order = np.lexsort((d, row))  # of a member past the first CLOSE only the nearest go on, and what is as near as the last of them
        row, x, y, d, short = row[order], x[order], y[order], d[order], short[order]
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
        many = np.diff(np.append(begin, len(row)))
        bar = np.repeat(d[begin + np.minimum(many, KEPT) - 1], many)
        stay = (place[row] < CLOSE) | (d <= bar)
        a, b = ids[x[stay]], ids[y[stay]]
        yield np.maximum(a, b), np.minimum(a, b), d[stay] + _SHORT * short[stay]


MET = "a long, b long, gap int, key long, id long, m0 long, m1 long"


def _met(pairs: list[list[np.ndarray]], late: list[list[np.ndarray]]) -> pa.RecordBatch:
    empty = np.zeros(0, np.int64)
    pairs, late = [np.concatenate([empty, *x]) for x in pairs], [np.concatenate([empty, *[y.view(np.int64) for y in x]]) for x in late]
    n, k = len(pairs[0]), len(late[0])
    cols = [pa.array(np.concatenate([x, np.zeros(k, np.int64)]), pa.int64(), mask=np.arange(n + k) >= n) for x in pairs]
    cols += [pa.array(np.concatenate([np.zeros(n, np.int64), x]), pa.int64(), mask=np.arange(n + k) < n) for x in late]
    cols[2] = cols[2].cast(pa.int32())
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", "gap", "key", "id", "m0", "m1"])


def _streamed_pairs(low: int):
    """Rows (key, mixed, id, m0, m1) in order of key, mixed and id: gives pairs, and the members past the first NEAR of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, seen, group = None, None, 0, Group()  # the last key and id, and how many members the key had
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            m0, m1 = (np.asarray(batch.column(i)).view(np.uint64) for i in (3, 4))
            fresh = np.append(now is None or key[0] != now or ids[0] != last, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))
            last_id = ids[-1]
            key, ids, m0, m1 = (x[fresh] for x in (key, ids, m0, m1))  # a row that repeats stands behind its like
            last = last_id
            if not len(key):
                continue
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            carried = now is not None and key[0] == now
            out, late = ([], [], []), ([], [], [], [])
            # Whole groups of up to TOGETHER members are compared all at once.
            whole = np.append(size[:-1] <= TOGETHER, False) & ~(carried & (np.arange(len(size)) == 0))
            for met in _groups_met(ids, m0, m1, start[whole], size[whole], low):
                for held, x in zip(out, met, strict=True):
                    held.append(x)
            for g in np.flatnonzero(~whole):
                s, e = int(start[g]), int(start[g] + size[g])
                if not (carried and g == 0):
                    group, seen = Group(), 0
                group.take(ids[s:e], m0[s:e], m1[s:e])
                if seen or e - s > 1:
                    *met, over = group.meet(ids[s:e], m0[s:e], m1[s:e], np.arange(seen, seen + e - s), low)
                    for held, x in zip(out, met, strict=True):
                        held.append(x)
                    for held, x in zip(late, (key, ids, m0, m1), strict=True):
                        held.append(x[s:e][over])
                seen += e - s
            now = key[-1]
            yield _met(out, late)

    return run


def _first_members(hot: DataFrame) -> dict[int, Group]:
    """The first NEAR members of each of the most common keys: each task tells its own first ones, then those of all are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows > 1 << 18:
                held = cut(held)
        if held is not None:
            yield from cut(held).combine_chunks().to_batches()

    def cut(table: pa.Table) -> pa.Table:
        key, mixed, ids = (np.asarray(table.column(i).combine_chunks()) for i in range(3))
        order = np.lexsort((ids, mixed, key))
        k, i = key[order], ids[order]
        order = order[np.append(True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]))[: len(k)]]
        k = key[order]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
        place = np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))
        return table.take(pa.array(order[place < NEAR]))

    some = hot.mapInArrow(run, hot.schema)
    merged = some.repartition(parts(hot), "key").sortWithinPartitions("key", "mixed", "id").mapInArrow(run, hot.schema)  # NEAR rows a key and task
    table = merged.toArrow()
    out: dict[int, Group] = {}
    key, mixed, ids, m0, m1 = (np.asarray(table.column(i).combine_chunks()) for i in range(5))
    order = np.lexsort((ids, mixed, key))
    edge = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[: len(order)])
    for low, high in zip(edge, np.append(edge[1:], len(order)), strict=True):
        at = order[low:high]
        group = out[int(key[at[0]])] = Group()
        group.take(ids[at], m0[at].view(np.uint64), m1[at].view(np.uint64))
    return out


def _placed_pairs(groups: dict[int, Group], low: int):
    """Rows of the most common keys, in any order: the same as _streamed_pairs gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, mixed, ids = (np.asarray(batch.column(i)) for i in range(3))
            m0, m1 = (np.asarray(batch.column(i)).view(np.uint64) for i in (3, 4))
            order = np.argsort(key, kind="stable")
            edge = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[: len(order)])
            out, late = ([], [], []), ([], [], [], [])
            for start, stop in zip(edge, np.append(edge[1:], len(order)), strict=True):
                at = order[start:stop]
                group = groups[int(key[at[0]])]
                nth = {int(x): k for k, x in enumerate(group.ids)}
                place = np.array([nth.get(int(x), NEAR) for x in ids[at]])
                *met, over = group.meet(ids[at], m0[at], m1[at], place, low)
                for held, x in zip(out, met, strict=True):
                    held.append(x)
                for held, x in zip(late, (key, ids, m0, m1), strict=True):
                    held.append(x[at][over])
            yield _met(out, late)

    return run


#: In how many bits the SimHashes of a pair may differ that has met under so many keys: of long members, and of short ones.
#: A pair that has met under more goes on. (Of links hardly one in a hundred meets once only, of other pairs nine of ten do.)
AGREE = ((1, 24, 48), (2, 47, 58))


def likely_pairs(members: DataFrame, short: int = 0, done: Callable[[], None] | None = None) -> DataFrame:
    """Pairs (a, b), a > b, of members (key long, id long, m0 long, m1 long) that share a key; a written table, linear in the members.

    Each member of a key meets the key's first NEAR members in a pseudo-random order, by their marks; those KEPT that differ least
    are pairs, if they differ in few bits and their sizes allow a similarity of 0.8 (of members shorter than `short` in
    up to VAGUE bits); AGREE says which of these pairs go on. Members past the first NEAR that are no copies of one of these go to a further round, under the
    key and STEP_BITS more bits of their SimHash, until no key has more. These bounds leave pairs out: this is a start that puts
    copies together, and other_pairs compares all that it has not brought into one component. The rows of a key stream through
    a task; those of the most common keys stay where they are, and the first NEAR members are sent to them. Both give the same pairs.
    done is called when members are read no more."""
    low = int(size_code(np.array([short]))[0]) if short else -1
    tables, rows = [], members.select("key", "id", "m0", "m1")
    for step in range(120 // STEP_BITS):
        order = ["key", F.xxhash64("key", "id").alias("mixed"), "id", "m0", "m1"]  # made where it is needed: a third less is shuffled
        hot = hot_keys(rows)
        rest = rows.where(~F.col("key").isin(hot)) if hot else rows
        met = rest.repartition(parts(members), "key").select(*order).sortWithinPartitions("key", "mixed", "id").mapInArrow(_streamed_pairs(low), MET)
        if hot:
            there = rows.where(F.col("key").isin(hot)).select(*order)
            met = met.unionByName(W.small_batches(there).mapInArrow(_placed_pairs(_first_members(there), low), MET))
        tables.append(saved(met))
        if done and not step:
            done()
        late = tables[-1].where("id is not null")
        if not late.limit(1).count():
            break
        half, at = ("m0", STEP_BITS * step) if STEP_BITS * step < 64 else ("m1", STEP_BITS * step - 56)
        bits = F.expr(f"shiftrightunsigned({half}, {at}) & {(1 << STEP_BITS) - 1}")
        rows = late.select(F.xxhash64("key", F.lit(step), bits).alias("key"), "id", "m0", "m1")
    pairs = tables[0]
    for table in tables[1:]:
        pairs = pairs.unionByName(table)
    told = pairs.where("a is not null").groupBy("a", "b").agg(F.min("gap").alias("gap"), F.count("*").alias("keys"))
    most = F.lit(_SHORT * 2)  # with more keys in common
    for keys, long, brief in reversed(AGREE):
        most = F.when(F.col("keys") == keys, F.when(F.col("gap") < _SHORT, long).otherwise(_SHORT + brief)).otherwise(most)
    out = saved(told.where(F.col("gap") <= most).select("a", "b"))
    for table in tables:
        dropped(table)
    return out


#: other_pairs: in how many bits of SimHash a pair may differ that has met under so many keys (or more, in the last row): of 184 if
#: both members are long, and of 120 if one is short: no bound, as these have few runs, and GRAMS holds for them.
MET_UNDER = ((1, 72, 120), (2, 80, 120), (3, 80, 120))
BITS_MOST, SHORT_MOST = MET_UNDER[-1][1:]
#: Members of less than so many code points have no such bound: their first mark is of their code points (op8_lines.letters).
TINY = 22
#: The third mark of a short member is of its pairs of adjacent code points (op8_lines.grams). By a pair's larger size code: in how
#: many bits these differ at most if a fifth of the code points is edited; the code points themselves differ in half as many.
GRAMS = 4 * np.floor((np.ceil(SIZE_STEP ** (np.arange(260) + 1)) - 1) / 5)
#: The keys are dealt to so many rounds, one shuffle each; members of a key with more than CROWD are dealt to cells.
ROUNDS, CROWD = 8, 1 << 13
#: Cells of more members than this are compared as tables of so many entries, others as a list of pairs.
_TABLE_LEAST, _TABLE_MOST = 64, 1 << 19


def _distinct_roots(low: int):
    """Rows (cell, late, id, root, m0, m1, m2) in order of cell, late, size code and id: gives a, b, gap of pairs within a cell.

    A member that is not late meets all before it whose size allows a link. A late one meets all that are not late, of which one
    cell has one size, and of its own size those with a greater id. Late ones stream by; pairs of one root are no news."""
    far, tiny = np.uint64(_CODE), int(size_code(np.array([TINY]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # what is not late of the last cell
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(c) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            known = len(held[0]) if held is not None else 0
            cell, late, ids, root = cols[:4]
            marks = [c.view(np.uint64) for c in cols[4:]]
            code = (marks[1] & far).astype(np.int64)
            nth = np.cumsum(np.append(0, cell[1:] != cell[:-1]))
            begin = np.searchsorted(nth, nth)
            place = nth * 1024 + late * 512 + code
            low_at = np.where(late == 0, np.maximum(begin, np.searchsorted(place, place - 3)), begin)
            high_at = np.where(late == 0, np.arange(len(cell)), np.searchsorted(place, nth * 1024 + 512))
            size = np.searchsorted(nth, nth, side="right") - begin
            out = []

            def told(x: np.ndarray, y: np.ndarray) -> None:
                one = np.bitwise_count(marks[0][x] ^ marks[0][y])  # noqa: B023
                gap = one + np.bitwise_count((marks[1][x] ^ marks[1][y]) & ~far)  # noqa: B023
                third = np.bitwise_count(marks[2][x] ^ marks[2][y])  # noqa: B023
                least, top = np.minimum(code[x], code[y]), np.maximum(code[x], code[y])  # noqa: B023
                short = least <= low
                gap = np.where(short, np.where(least < tiny, np.uint8(0), gap), gap + third)
                good = (gap <= np.where(short, SHORT_MOST, BITS_MOST)) & ((top > low) | (third <= GRAMS[top]))
                good &= ~short | (top >= tiny) | (2 * one.astype(np.int16) <= GRAMS[top])
                good &= (root[x] != root[y]) & (np.abs(code[x] - code[y]) <= 3)  # noqa: B023
                good &= (late[x] == 0) | (code[x] != code[y]) | (ids[x] < ids[y])  # noqa: B023
                a, b = ids[x[good]], ids[y[good]]  # noqa: B023
                out.append((np.maximum(a, b), np.minimum(a, b), gap[good].astype(np.int32) + _SHORT * short[good]))  # noqa: B023

            few = known + np.flatnonzero(size[known:] <= _TABLE_LEAST)
            many = high_at[few] - low_at[few]
            edge = np.concatenate([[0], np.cumsum(many)])
            for lo, hi in _cuts(edge, _TABLE_MOST):
                n = many[lo:hi]
                x = np.repeat(few[lo:hi], n)
                told(x, np.repeat(low_at[few[lo:hi]] - np.cumsum(n) + n, n) + np.arange(len(x)))
            at = known
            while at < len(cell):
                if size[at] <= _TABLE_LEAST:
                    at += int(np.argmax(size[at:] > _TABLE_LEAST)) if (size[at:] > _TABLE_LEAST).any() else len(cell) - at
                    continue
                end = min(int(begin[at] + size[at]), at + max(1, _TABLE_MOST // int(size[at])))
                lo, hi = int(low_at[at:end].min()), int(high_at[at:end].max())
                gap = np.bitwise_count(marks[2][at:end, None] ^ marks[2][None, lo:hi])
                brief, most = code[at:end] <= low + 3, np.full(end - at, BITS_MOST)
                most[brief] = np.where(code[at:end] <= low, GRAMS[code[at:end] + 3], 64)[brief]  # told looks closer at these
                if not brief.all():
                    wide = np.bitwise_count(marks[0][at:end, None] ^ marks[0][None, lo:hi])
                    wide += np.bitwise_count((marks[1][at:end, None] ^ marks[1][None, lo:hi]) & ~far)
                    gap[~brief] += wide[~brief]
                x, y = np.nonzero(gap <= most[:, None])
                x, y = x + at, y + lo
                mine = (y >= low_at[x]) & (y < high_at[x])
                told(x[mine], y[mine])
                at = end
            stays = (nth == nth[-1]) & (late == 0)
            held = [c[stays] for c in cols]
            if out:
                a, b, gap = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(gap, pa.int32())], names=["a", "b", "gap"])

    return run


def _cuts(edge: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows, of about `most` pairs each, where edge holds how many pairs come before each row."""
    cuts = np.unique(np.append(np.searchsorted(edge, np.arange(0, edge[-1], most)), len(edge) - 1))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def other_pairs(members: DataFrame, short: int) -> DataFrame:
    """Pairs (a, b), a > b, of members (id, root, m0, m1, m2, keys) of different roots; a written table.

    All members that share a key are compared, whatever its size: those whose sizes allow a similarity of 0.8 and whose SimHashes
    differ in no more bits than MET_UNDER and GRAMS say are pairs (it is a short pair if one has less than `short` code points). Nothing else decides. A key with more than CROWD members is dealt to cells: those of one size
    code and a part of the ids are held, and all that these may meet stream by. So memory is bounded, and no task has a whole key;
    the comparisons of a key grow with the square of its members."""
    low, tables = int(size_code(np.array([short]))[0]), []
    keyed = lambda keys: members.select(F.explode(keys).alias("key"), "id", "root", "m0", "m1", "m2")
    rows = keyed("keys")
    some = rows.where(F.pmod(F.xxhash64("key", "id"), F.lit(HOT_SHARE)) == 0).groupBy("key").agg((F.count("*") * HOT_SHARE).alias("n"))
    crowds = saved(some.where(F.col("n") > CROWD).select("key", F.ceil(F.col("n") / CROWD).cast("int").alias("parts")))
    own, code = F.pmod(F.xxhash64("id"), F.col("parts")), F.expr(f"cast(m1 & {_CODE} as int)")
    for k in range(ROUNDS):
        now = keyed(F.expr(f"filter(keys, k -> pmod(k, {ROUNDS}) = {k})"))  # before they are rows of their own
        cells = now.join(sized(crowds), "key", "left_anti").select(F.col("key").alias("cell"), F.lit(0).alias("late"), "id", "root", "m0", "m1", "m2")
        dealt = now.join(sized(crowds), "key").withColumn("size", F.explode(F.sequence(code, code + 3))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        late = ((F.col("size") != code) | (F.col("part") != own)).cast("int")
        cells = cells.unionByName(dealt.select(F.xxhash64("key", "size", "part").alias("cell"), late.alias("late"), "id", "root", "m0", "m1", "m2"))
        order = ["cell", "late", F.expr(f"m1 & {_CODE}"), "id"]
        tables.append(saved(cells.repartition(parts(members), "cell").sortWithinPartitions(*order).mapInArrow(_distinct_roots(low), "a long, b long, gap int")))
    pairs = tables[0]
    for table in tables[1:]:
        pairs = pairs.unionByName(table)
    told = pairs.groupBy("a", "b").agg(F.min("gap").alias("gap"), F.count("*").alias("keys"))
    most = F.lit(_SHORT * 2)
    for keys, long, brief in reversed(MET_UNDER[:-1]):
        most = F.when(F.col("keys") == keys, F.when(F.col("gap") < _SHORT, long).otherwise(_SHORT + brief)).otherwise(most)
    out = saved(told.where(F.col("gap") <= most).select("a", "b"))
    for table in (crowds, *tables):
        dropped(table)
    return out


_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Within it Spark removes a query's shuffle files as soon as the query has ended; what is needed later is written."""
    before = spark.conf.get(_CLEANED, "false")
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANED, before)


#: Rows of a few numbers that may be broadcast: some tens of MB at most.
BROADCAST_ROWS = 1 << 20


def sized(table: DataFrame) -> DataFrame:
    """A written table as the side of a join: broadcast if its count allows it, and dealt out like the other if not."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


BLOOM_BITS = 26


def bloom(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2^26 bits over the column id: false only for ids that are not there. Its size does not grow."""
    where = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << BLOOM_BITS)) for k in range(2)]
    bits = ids.select(F.explode(F.array(*where)).alias("bit"))
    words = bits.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), dtype=np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def bloom_bits(column: str = "doc_id") -> list:
    """The two columns that tell maybe() where to look."""
    return [F.pmod(F.xxhash64(F.col(column).cast("long"), F.lit(k)), F.lit(1 << BLOOM_BITS)).cast("int").alias(f"bit{k}") for k in range(2)]


def maybe(bitmap: np.ndarray, *bits: np.ndarray) -> np.ndarray:
    out = np.ones(len(bits[0]), dtype=bool)
    for b in bits:
        out &= (bitmap[b >> 6] >> (b & 63)) & 1 == 1
    return out


def bit_of(x: np.ndarray, k: int) -> np.ndarray:
    return (W.mix(x ^ W.SIM_SEEDS[k]) & np.uint64((1 << 26) - 1)).astype(np.int64)


def bitmap_of(need: DataFrame) -> np.ndarray:
    """2^26 bits over the column id, by the hash that the scan of lines uses too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(0)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([bit_of(x, k) for k in range(2)]))], names=["bit"])

    bits = need.select("id").mapInArrow(run, "bit long")
    words = bits.groupBy(F.expr("cast(shiftright(bit, 6) as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(1 << 20, dtype=np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out
