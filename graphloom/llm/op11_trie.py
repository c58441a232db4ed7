"""Conversation prefix trie: LCP-aware external mergesort, nodes from an open-path stack.

A turn is a token of 20 bytes: the MD5 of role and text, and the text's length. A
conversation's key is the tokens of its turns, one after the other, so byte order of
keys is an order of sequences in which a prefix stands before what it begins, and the
members of a trie node stand together. Texts themselves are read once and never move.

1. Runs. Tasks sort their conversations by (key, conv_id) in runs of bounded size. A
   run is cut at range bounds, and each piece is front-coded: how many turns a key
   shares with the one before it, and the tokens behind those. The pieces are what is
   shuffled. Bounds come from a sample; they decide which task does what and no result,
   and as conv_id is part of them, a range is bounded however often a sequence repeats.
2. Merge. A range's pieces go through a loser tree whose entries carry their LCP with
   what left the tree last: a longer LCP wins unseen, and tokens are compared only behind
   an equal one, so turns that are shared are not compared again.
3. Stack. The merged stream gives each conversation with its LCP. An open-path stack
   closes the nodes below the LCP, which are finished, and opens the new ones. Nodes on
   the paths of a range's first and last key may go on in other ranges: these two paths
   are all that a range hands up.
4. Paths of FAN ranges are stitched by the same stack, then those of FAN such groups, until
   one is left. So the root's millions of members cost their sums only.

A node whose parent was open in its range gets the parent's conv_id by a join on (range,
parent), so that a node with very many children is never one key of a join. The ids of
conversations that end in a node which was open go out as text in chunks, and one rolling
SHA-256 for each such node reads them in order.

Defined results. Rows without conv_id take no part. Null roles and texts are empty, a null
turn stands first; rows of one conversation with the same turn stand in the order of their
tokens. c % 5 keeps the sign of c. Repeated rows are turns of their own. An empty table has
no nodes. Other columns are ignored. Limits: a conversation is one value of 20 bytes a turn,
and its path, with those that share it, is held by the task that closes it.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .linking import dropped, parts, saved

#: Bytes of a token; of keys in a run; of keys in a range; of ids in a chunk.
TOKEN, RUN_BYTES, RANGE_BYTES, CHUNK_BYTES = 20, 16 << 20, 32 << 20, 1 << 16
#: Sampled keys for each range; ranges, or groups of them, whose paths are stitched in one task.
SAMPLES, FAN = 16, 64
_NONE = (1 << 63) - 1
_ROOT = b"\0" * 16

OUT = "kind int, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, node binary, up binary, parent_conv_id long, place long, nth long, same int, first_ids binary, first_stats array<long>, last_ids binary, last_stats array<long>"
NODE, PATHS, IDS = 0, 1, 2
_FIELDS = [part.split(" ", 1) for part in OUT.split(", ")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def turns(conversations: DataFrame) -> DataFrame:
    """family, c, turn, token: a family is the five conversations that may share a beginning."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    token = F.concat(digest, F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0")))
    c = F.col("conv_id").cast("long")
    return conversations.where("conv_id is not null").select((c - c % 5).alias("family"), c.alias("c"), F.col("turn").cast("long").alias("turn"), token.alias("token"))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, c, token) in order, a family's base first: gives each conversation's rebuilt key."""
    family = now = None
    base: list[bytes] = []
    taken: list[bytes] = []
    skip = at = 0
    for batch in batches:
        ids, keys = [], []
        for f, c, token in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if c != now:
                if now is not None:
                    ids.append(now)
                    keys.append(b"".join(taken))
                if f != family:
                    family, base = f, []
                now, at = c, 0
                skip = zlib.crc32(str(c).encode()) % 9
                taken = [] if c == f else base[:skip]
            if c == f:
                if at < 8:
                    base.append(token)
                taken.append(token)
            elif at >= skip:
                taken.append(token)
            at += 1
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["conv_id", "key"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(taken)], pa.binary())], names=["conv_id", "key"])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and key of every rebuilt conversation."""
    rows = turns(conversations)
    rows = rows.repartition(parts(rows), "family").sortWithinPartitions("family", F.col("c") != F.col("family"), "c", F.asc_nulls_first("turn"), "token")
    return W.small_batches(rows.select("family", "c", "token")).mapInArrow(_rebuild, "conv_id long, key binary")


def shared_turns(a: bytes, b: bytes) -> int:
    """How many tokens two keys begin with alike, by one subtraction of numbers as long as the shorter."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return (n - (differ.bit_length() + 7) // 8) // TOKEN


def _bounds(keys: DataFrame) -> list[tuple[bytes, int]]:
    """The first (key, conv_id) of every range but the first one."""
    rows, size = keys.agg(F.count("*"), F.sum(F.octet_length("key") + 16)).first()
    ranges = max(parts(keys), -(-(size or 0) // RANGE_BYTES))
    every = max(1, rows // (SAMPLES * ranges))
    some = keys.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select("key", "conv_id").toArrow().to_pydict()
    some = sorted(zip(some["key"], some["conv_id"], strict=True))
    return [some[len(some) * k // ranges] for k in range(1, ranges)] if len(some) >= ranges else some[1:]


def _runs(bounds: list[tuple[bytes, int]]):
    """Sorted runs of (conv_id, key), cut at the bounds: gives front-coded pieces."""

    def cut(held: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        held.sort()
        edges = [0, *[bisect_left(held, b) for b in bounds], len(held)]
        for place, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            if low == high:
                continue
            before, shared, rest, sizes = b"", [], [], []
            for key, _ in held[low:high]:
                lcp = shared_turns(before, key)
                shared.append(lcp)
                rest.append(key[lcp * TOKEN :])
                sizes.append(len(rest[-1]))
                before = key
            arrays = [[place], [[c for _, c in held[low:high]]], [shared], [sizes], [b"".join(rest)]]
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.large_binary()]
            yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], names=["place", "ids", "shared", "sizes", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for c, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((key, c))
                size += len(key) + 64
                if size >= RUN_BYTES:
                    yield from cut(held)
                    held, size = [], 0
        yield from cut(held)

    return run


class Run:
    """One piece of a run; its head is a key, its conversation, and its LCP with what went before."""

    def __init__(self, ids, shared, sizes, rest):
        self.ids, self.shared, self.sizes, self.rest = ids, shared, sizes, rest
        self.at, self.read, self.key, self.lcp, self.conv = -1, 0, b"", 0, 0

    def step(self) -> bool:
        self.at += 1
        if self.at == len(self.ids):
            return False
        size = self.sizes[self.at]
        self.lcp, self.conv = self.shared[self.at], self.ids[self.at]
        self.key = self.key[: self.lcp * TOKEN] + self.rest[self.read : self.read + size]
        self.read += size
        return True


def _first(a: Run | None, b: Run | None) -> tuple[Run | None, Run | None]:
    """Winner and loser. Both LCPs are with the same key, the last that went out; the loser's is then with the winner."""
    if a is None or b is None:
        return (a, b) if b is None else (b, a)
    if a.lcp != b.lcp:
        return (a, b) if a.lcp > b.lcp else (b, a)
    x, y, o = a.key, b.key, a.lcp * TOKEN
    while (u := x[o : o + TOKEN]) == (v := y[o : o + TOKEN]) and u:
        o += TOKEN
    if (u, a.conv) > (v, b.conv) if u == v else u > v:
        a, b = b, a
    b.lcp = o // TOKEN
    return a, b


def merged(runs: list[Run]) -> Iterator[Run]:
    """Heads in order of (key, conv_id), with their LCP to the head before: a loser tree."""
    runs = [r for r in runs if r.step()]
    if not runs:
        return
    n = 1 << max(0, (len(runs) - 1).bit_length())
    losers: list[Run | None] = [None] * n
    leaf = {id(r): n + k for k, r in enumerate(runs)}
    level: list[Run | None] = runs + [None] * (n - len(runs))
    while len(level) > 1:
        half, after = len(level) // 2, []
        for k in range(half):
            winner, losers[half + k] = _first(level[2 * k], level[2 * k + 1])
            after.append(winner)
        level = after
    top = level[0]
    while top is not None:
        yield top
        node = leaf[id(top)] >> 1
        ahead = top if top.step() else None
        while node:
            ahead, losers[node] = _first(ahead, losers[node])
            node >>= 1
        top = ahead


class Node:
    """A trie node as far as it was seen: sums leave out children that are still open."""

    __slots__ = ("low", "n", "kids", "leaves", "saved", "size", "ends", "rows")

    def __init__(self, size: int, low: int = _NONE, n: int = 0, kids: int = 0, leaves: int = 0, saved: int = 0):
        self.low, self.n, self.kids, self.leaves, self.saved, self.size = low, n, kids, leaves, saved, size
        self.ends: list[int] = []  # conversations that end here, in this range
        self.rows: list[int] = []  # finished children, as numbers of rows

    def add(self, x: Node) -> None:
        self.low, self.n, self.kids, self.leaves, self.saved = min(self.low, x.low), self.n + x.n, self.kids + x.kids, self.leaves + x.leaves, self.saved + x.saved
        self.rows += x.rows

    def numbers(self) -> list[int]:
        return [self.size, self.low, self.n, self.kids, self.leaves, self.saved]


_NUMBERS = 6


class Stack:
    """The open path of one range (or group of ranges), its finished nodes, and the path of its first key."""

    def __init__(self, place: int, hashed: bool):
        self.place, self.hashed = place, hashed  # hashed: the ends of finished nodes are known here
        self.open: list[Node] = []
        self.same = 0  # so many open nodes, from the root down, hold the first key too
        self.first: list[Node] = []  # nodes that hold the first key and are closed, from the deepest up
        self.rows: list[list] = []  # conv_id, depth, n, kids, leaves, saved, ends, parent, depth of an open parent on the first path, on the last path
        self.names: list[bytes] = []  # of finished nodes, where ends are not known

    def finish(self, node: Node, depth: int, parent: Node | None, name: bytes = b"") -> None:
        leaves = node.leaves if node.kids else 1
        total = node.saved + (node.n - 1) * node.size
        me = len(self.rows)
        for k in node.rows:
            self.rows[k][7] = node.low
        ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if self.hashed else None
        self.rows.append([node.low, depth, node.n, node.kids, leaves, total, ends, None, None])
        self.names.append(name)
        if parent is not None:
            parent.low, parent.n, parent.kids, parent.leaves, parent.saved = min(parent.low, node.low), parent.n + node.n, parent.kids + 1, parent.leaves + leaves, parent.saved + total
            parent.rows.append(me)

    def close(self, depth: int, names: list[bytes] | None = None) -> None:
        """Close what is deeper than depth (-1: all); names: of the open path."""
        while len(self.open) > depth + 1:
            node, at = self.open.pop(), len(self.open)
            if at < self.same:
                self.first.append(node)
                self.same = at
            else:
                self.finish(node, at, self.open[-1] if self.open else None, names[at] if names else b"")


def _ids(key: bytes) -> list[bytes]:
    """A name for each node on a key's path, the root first."""
    out = [_ROOT]
    for o in range(0, len(key), TOKEN):
        out.append(hashlib.md5(out[-1] + key[o : o + TOKEN]).digest())
    return out


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], _ARROW[kind]) for name, kind in _FIELDS], names=[name for name, _ in _FIELDS])


def _told(stack: Stack, first: list[bytes], last: list[bytes], place_of_nodes: int | None) -> Iterator[pa.RecordBatch]:
    """The finished nodes of a stack; those whose parent stayed open carry its name."""
    for path, names in ((list(reversed(stack.first)), first), (stack.open, last)):
        base = stack.same if path is not stack.open else 0
        for k, node in enumerate(path):
            for row in node.rows:
                stack.rows[row][8] = names[base + k]
    names = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "parent_conv_id", "up")
    for low in range(0, len(stack.rows), 4096):
        yield _batch([dict(zip(names, r, strict=True)) | {"kind": NODE, "node": name or None, "place": place_of_nodes} for r, name in zip(stack.rows[low : low + 4096], stack.names[low : low + 4096], strict=True)])


def _paths(stack: Stack, first: list[bytes], last: list[bytes]) -> dict:
    """What a range hands up: the first key's path (open nodes, then closed ones) and the rest of the last key's."""
    one = [*stack.open[: stack.same], *reversed(stack.first)]
    two = stack.open[stack.same :]
    return {
        "kind": PATHS, "place": stack.place, "same": stack.same,
        "first_ids": b"".join(first), "first_stats": [x for n in one for x in n.numbers()],
        "last_ids": b"".join(last[stack.same :]), "last_stats": [x for n in two for x in n.numbers()],
    }


def _chunks(name: bytes, place: int, ends: list[int]) -> Iterator[dict]:
    held, size, nth = [], 0, 0
    for c in ends:
        held.append(str(c))
        size += len(held[-1]) + 1
        if size >= CHUNK_BYTES:
            yield {"kind": IDS, "node": name, "place": place, "nth": nth, "ends": ",".join(held)}
            held, size, nth = [], 0, nth + 1
    if held:
        yield {"kind": IDS, "node": name, "place": place, "nth": nth, "ends": ",".join(held)}


def _range(place: int, runs: list[Run]) -> Iterator[pa.RecordBatch]:
    stack, start, last = Stack(place, True), None, b""
    for head in merged(runs):
        key, depth = head.key, len(head.key) // TOKEN
        if start is None:
            start, lcp = key, -1
        else:
            lcp = head.lcp
        stack.close(lcp)
        for d in range(lcp + 1, depth + 1):
            stack.open.append(Node(int.from_bytes(key[d * TOKEN - 4 : d * TOKEN]) if d else 0))
        if lcp < 0:
            stack.same = depth + 1
        top = stack.open[-1]
        top.n += 1
        top.low = min(top.low, head.conv)
        top.ends.append(head.conv)
        last = key
    if start is None:
        return
    first, now = _ids(start), _ids(last)
    yield from _told(stack, first, now, place)
    yield _batch([_paths(stack, first, now)])
    for path, names, base in ((list(reversed(stack.first)), first, stack.same), (stack.open, now, 0)):
        for k, node in enumerate(path):
            for row in _chunks(names[base + k], place, node.ends):
                yield _batch([row])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of runs in order of range: merges each range's and gives its nodes, paths and ids."""
    place, runs = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            p = batch.column(0)[k].as_py()
            if p != place:
                if runs:
                    yield from _range(place, runs)
                place, runs = p, []
            ids, shared, sizes = (batch.column(i)[k].values.to_pylist() for i in (1, 2, 3))
            runs.append(Run(ids, shared, sizes, batch.column(4)[k].as_py()))
    if runs:
        yield from _range(place, runs)


def _split(ids: bytes) -> list[bytes]:
    return [ids[k : k + 16] for k in range(0, len(ids), 16)]


def _nodes(stats: list[int]) -> list[Node]:
    return [Node(*stats[k : k + _NUMBERS]) for k in range(0, len(stats), _NUMBERS)]


def _stitch(final: bool):
    """Paths in order of (group, place): gives each group's finished nodes, and its own two paths unless it is the last."""

    def done(stack: Stack, first: list[bytes], names: list[bytes]) -> Iterator[pa.RecordBatch]:
        if final:
            stack.same = 0  # nothing stands before the first key or behind the last
            closed = list(reversed(stack.first))
            stack.first = []
            shared = len(first) - len(closed)
            for k in range(len(closed) - 1, -1, -1):
                stack.finish(closed[k], shared + k, closed[k - 1] if k else stack.open[shared - 1], first[shared + k])
            stack.close(-1, names)
            yield from _told(stack, [], [], None)
        else:
            yield from _told(stack, first, names, None)
            yield _batch([_paths(stack, first, names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = stack = None
        first: list[bytes] = []
        names: list[bytes] = []  # of the stack's open path
        for batch in batches:
            for row in batch.to_pylist():
                one, two = _nodes(row["first_stats"]), _nodes(row["last_stats"])
                one_ids, two_ids, same = _split(row["first_ids"]), _split(row["last_ids"]), row["same"]
                if row["group"] != group:
                    if stack is not None:
                        yield from done(stack, first, names)
                    group, stack, first = row["group"], Stack(row["group"], False), one_ids
                    stack.open, stack.same, stack.first = one[:same], same, list(reversed(one[same:]))
                    stack.open += two
                    names = one_ids[:same] + two_ids
                    continue
                lcp = 0  # of nodes, the root being the first
                while lcp < min(len(names), len(one_ids)) and names[lcp] == one_ids[lcp]:
                    lcp += 1
                stack.close(lcp - 1, names)
                for have, more in zip(stack.open, one, strict=False):
                    have.add(more)
                del names[lcp:]
                stack.open += one[lcp:same]
                names += one_ids[lcp:same]
                below = max(lcp, same)
                for k in range(len(one) - 1, below - 1, -1):  # the first key's path ends within this range
                    stack.finish(one[k], k, one[k - 1] if k > below else stack.open[below - 1], one_ids[k])
                stack.close(same - 1, names)
                del names[same:]
                stack.open += two
                names += two_ids
        if stack is not None:
            yield from done(stack, first, names)

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, ends) in order: one rolling SHA-256 for each node."""
    now, state = None, None
    for batch in batches:
        out = []
        for node, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = node, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], names=["node", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "sha"])


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations; its columns are NAMES."""
    keys = saved(rebuilt(conversations))
    bounds = _bounds(keys)
    pieces = keys.mapInArrow(_runs(bounds), "place int, ids array<long>, shared array<int>, sizes array<int>, rest binary")
    pieces = pieces.repartition(max(parts(keys), len(bounds) + 1), "place").sortWithinPartitions("place")
    ground = saved(pieces.mapInArrow(_merge, OUT))
    dropped(keys)
    level, groups, above = ground, len(bounds) + 1, []
    while True:
        groups = -(-groups // FAN)
        paths = level.where(F.col("kind") == PATHS).select(F.expr(f"cast(floor(place / {FAN}.0) as long)").alias("group"), "place", "same", "first_ids", "first_stats", "last_ids", "last_stats")
        paths = paths.repartition(min(groups, parts(paths)), "group").sortWithinPartitions("group", "place")
        level = saved(paths.mapInArrow(_stitch(groups == 1), OUT))
        above.append(level)
        if groups == 1:
            break
    upper = above[0]
    for table in above[1:]:
        upper = upper.unionByName(table)
    upper = upper.where(F.col("kind") == NODE)
    ids = ground.where(F.col("kind") == IDS).select("node", "ends", "place", "nth")
    sha = ids.repartition(parts(ids), "node").sortWithinPartitions("node", "place", "nth").select("node", "ends").mapInArrow(_digest, "node binary, sha string")
    low = upper.select(F.col("node").alias("up"), F.col("conv_id").alias("above"))
    shown = [F.coalesce("parent_conv_id", "above").alias(n) if n == "parent_conv_id" else F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias(n) if n == "ends_sha256" else F.col(n) for n in NAMES]
    top = upper.drop("ends").join(sha.select("node", F.col("sha").alias("ends")), "node", "left").join(low, "up", "left").select(*shown)
    nodes = ground.where(F.col("kind") == NODE)
    inner = nodes.where("up is null").withColumn("above", F.lit(None).cast("long")).select(*shown)
    known = nodes.where("up is not null").select("place", "up").distinct().join(low, "up").select("place", "up", "above")
    edge = nodes.where("up is not null").join(known, ["place", "up"]).select(*shown)
    return inner.unionByName(edge).unionByName(top)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 of a string in SQL: the reflected polynomial of zlib, eight steps a byte.
_CRC = "xor(list_reduce(list_prepend(4294967295, [ascii(x)::bigint for x in string_split(c::varchar, '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda s, k: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295)"

SQL = f"""
with rows_ as (
  select conv_id c, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) tok, strlen(coalesce(text, '')) size,
         row_number() over (partition by conv_id order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 pos
  from conversations where conv_id is not null),
convs as (select c, {_CRC} % 9 h from (select distinct c from rows_)),
made as (
  select convs.c, r.pos, tok, size from convs join rows_ r on r.c = convs.c - convs.c % 5 and r.pos < h
  union all select convs.c, r.pos, tok, size from convs join rows_ r on r.c = convs.c and r.pos >= h),
seqs as (select convs.c, coalesce(list(tok order by pos) filter (tok is not null), []) toks, coalesce(list(size order by pos) filter (tok is not null), []) sizes from convs left join made on made.c = convs.c group by convs.c),
steps as (select c, unnest(range(len(toks) + 1)) depth, toks, sizes from seqs),
paths as (select c, depth, array_to_string(toks[1:depth], ',') path, array_to_string(toks[1:depth - 1], ',') up, coalesce(sizes[depth], 0) size, len(toks) = depth as here from steps),
nodes as (select path, depth, min(up) up, min(c) conv_id, count(*) n_convs, max(size) size, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (here), '')) ends_sha256 from paths group by path, depth),
kids as (select up path, count(*) n_children from nodes where depth > 0 group by up),
full_ as (select nodes.*, coalesce(n_children, 0) n_children from nodes left join kids on kids.path = nodes.path),
sums as (
  select p.path, p.depth, sum((w.n_convs - 1) * w.size) saved_tokens, sum(case when w.n_children = 0 then 1 else 0 end) n_leaves
  from full_ w join paths p on p.c = w.conv_id and p.depth <= w.depth group by p.path, p.depth)
select f.conv_id, f.depth, u.conv_id parent_conv_id, f.n_convs, f.n_children, s.n_leaves::bigint n_leaves, s.saved_tokens::bigint saved_tokens, f.ends_sha256
from full_ f join sums s on s.path = f.path and s.depth = f.depth left join nodes u on f.depth > 0 and u.path = f.up and u.depth = f.depth - 1
"""
