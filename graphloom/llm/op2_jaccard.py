"""N-gram Jaccard join with a token-group matrix.

Documents of one shingle set are one class, found by a 128-bit fingerprint of
the set; one document stands for it. The representatives are partitioned into
groups of about GROUP similar documents (by a minimum hash of their shingles
and their size), and each group keeps the union of its tokens.

A query document's overlap with any member is at most its overlap with the
group's union, so a group that bounds below the needed overlap is never opened.
Which groups can qualify at all follows from necessary tokens: of n tokens in
the global order (rare ones first) the first n - ceil(0.8 n) + 1 must hold one
that the partner's first tokens hold too, and of two sets of like size nearly
half of them. Opened groups are verified member by
member on exact intersection sizes.

Documents are first held against the group of the first document that shares a
necessary token. Then the matrix (necessary token x group) tells how many such
tokens each document shares with each group that has other components than its
own, and groups whose bound is too low stay closed. No link between components
is lost; pairs inside a component that is already connected are not looked for, so
a group of thousands of near copies costs a pass over it, not its square.

Shingles are told apart by 64-bit hashes. Defined results: a null or wordless
text has the empty set and is its own component; a row without an id takes its
class's component, null if it has none. Rows that share an id are one document.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .linking import bloom, bloom_bits, components, dropped, joined_further, maybe, parts, saved, shared_keys, sized

SHINGLE = 5
PERCENT = 80
GROUP = 64
#: Sizes within a group differ by this factor at most, so that a group's sizes say whether a query can match.
SIZE_BAND = 1.12
QUERIES_PER_TASK_GROUP = 256
#: Frequent shingles that the global order knows as such; any order is right, this one is fast.
FREQUENT = 1 << 20


def _sets(part: pa.RecordBatch, width: int):
    """(document index, hash) of all distinct shingles, and each document's number of them."""
    raw, offsets = W.flat(part.column(part.schema.get_field_index("text")))
    starts, ends, per = W.spans(raw, offsets, W.NOT_SPACE)
    docs, values = W.unique_per_doc(*W.shingles(W.word_hashes(raw, starts, ends), per, width))
    return docs, values, np.bincount(docs, minlength=part.num_rows)[: part.num_rows]


def _per_doc(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    edge = np.concatenate([[0], np.cumsum(counts)])
    return total[edge[1:]] - total[edge[:-1]]


def _sketch(width: int):
    """Rows of kind 0: a document's id, fingerprint and set size. Of kind 1: a frequent shingle and a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, most=2 << 20):
                docs, values, counts = _sets(part, width)
                one = _per_doc(W.mix(values), counts)
                two = _per_doc(W.mix(values ^ np.uint64(0x5851F42D4C957F2D)), counts)
                token, many = np.unique(values, return_counts=True)
                often = many >= 2
                token, many = token[often], many[often]
                n, m = part.num_rows, len(token)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([0, 1], [n, m]), pa.int32()),
                        pa.concat_arrays([part.column(0).cast(pa.int64()), pa.array(W.signed(token))]),
                        pa.array(np.concatenate([W.signed(one), np.zeros(m, np.int64)])),
                        pa.array(np.concatenate([W.signed(two), np.zeros(m, np.int64)])),
                        pa.array(np.concatenate([counts, many]).astype(np.int64)),
                    ],
                    names=["kind", "id", "fp1", "fp2", "n"],
                )

    return run


def _prefixes(width: int, percent: int, token: np.ndarray, rank: np.ndarray):
    """Each document's first tokens in the global order, and the minimum hash of all its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                docs, values, counts = _sets(part, width)
                start = np.cumsum(counts) - counts
                least = np.zeros(len(counts), dtype=np.uint64)
                if len(values):
                    least[counts > 0] = np.minimum.reduceat(W.mix(values ^ np.uint64(0x2545F4914F6CDD1D)), start[counts > 0])
                order_key = values >> np.uint64(1)
                if len(token):
                    at = np.minimum(np.searchsorted(token, values), len(token) - 1)
                    known = token[at] == values
                    order_key[known] = np.uint64(1 << 63) | rank[at[known]]
                order = W.by_doc(docs, order_key)
                docs, values = docs[order], values[order]
                size = counts - -(-counts * percent // 100) + (counts > 0)
                first = np.cumsum(counts) - counts
                keep = np.arange(len(docs)) - first[docs] < size[docs]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(W.signed(least)), W.lists(W.signed(values[keep]), size, pa.int64())], names=["id", "n", "least", "prefix"])

    return run


def _tokens(width: int, bitmap: np.ndarray):
    """All tokens, ascending, of documents that may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = maybe(bitmap, np.asarray(batch.column(2)), np.asarray(batch.column(3)))
            batch = batch.filter(pa.array(asked))
            for part in W.slices(batch):
                _, values, counts = _sets(part, width)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), W.lists(W.signed(values), counts, pa.int64())], names=["id", "tokens"])

    return run


def _open(percent: int):
    """Rows (grp, salt, role, id, tokens) in order of group and role: members first, then queries; gives edges (a, b).

    A query's edge goes to one member that it links to; other members that it links to are joined to that one, once
    for the group. So there are no more edges than queries and members, and the components are those of all links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, ready, joined = None, [], [], None, []

        def top(k: int) -> int:
            while joined[k] != k:
                joined[k] = k = joined[joined[k]]
            return k

        for batch in batches:
            out_a, out_b = [], []
            group, salt, role, doc = (np.asarray(batch.column(i)) for i in range(4))
            lists = batch.column(4)
            edge, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
            for i in range(batch.num_rows):
                if (group[i], salt[i]) != now:
                    now, ids, held, ready = (group[i], salt[i]), [], [], None
                mine = flat[edge[i] : edge[i + 1]]
                if role[i] == 0:
                    ids.append(doc[i])
                    held.append(mine.copy())
                    continue
                if not held:
                    continue
                if ready is None:
                    size = np.array([len(h) for h in held])
                    every = np.concatenate(held)
                    order = np.argsort(every, kind="stable")
                    ready = (every[order], np.repeat(np.arange(len(held)), size)[order], size, np.array(ids))
                    joined[:] = range(len(held))
                union, owner, size, members = ready
                low = np.searchsorted(union, mine)
                hit = low < len(union)
                hit[hit] = union[low[hit]] == mine[hit]
                # At most so many of the query's tokens are in any member: is that enough for the smallest?
                if (100 + percent) * int(hit.sum()) < percent * (len(mine) + int(size.min())):
                    continue
                low = low[hit]
                many = np.searchsorted(union, mine[hit], side="right") - low
                place = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                both = np.bincount(owner[place], minlength=len(size))
                link = (100 + percent) * both >= percent * (len(mine) + size)
                link &= members != doc[i]
                found = np.flatnonzero(link).tolist()
                if found:
                    out_a.append(doc[i])
                    out_b.append(members[found[0]])
                for k in found[1:]:
                    x, y = top(found[0]), top(k)
                    if x != y:
                        joined[y] = x
                        out_a.append(members[k])
                        out_b.append(members[found[0]])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def jaccard_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    W.small_batches(source)
    sketch = saved(source.mapInArrow(_sketch(width), "kind int, id long, fp1 long, fp2 long, n long"))
    sets = sketch.where("kind = 0").select(F.col("id").alias("doc_id"), "fp1", "fp2", "n")
    often = sketch.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where("n >= 4").orderBy(F.desc("n"), "id").limit(FREQUENT).select("id").toArrow()
    token = often.column(0).to_numpy().astype(np.int64).view(np.uint64)
    rank = np.arange(len(token), 0, -1).astype(np.uint64)
    order = np.argsort(token)
    classes = saved(sets.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("id")))
    firsts = source.where("text <> ''").mapInArrow(_prefixes(width, percent, token[order], rank[order]), "id long, n long, least long, prefix array<long>")
    first_ids = saved(classes.select("id").where("id is not null").distinct())
    stand = saved(firsts.where("n > 0").join(sized(first_ids), "id", "left_semi"))
    # Groups of similar documents: by the minimum hash of all tokens and a band of sizes, in as many parts as keep them small.
    keyed = stand.select("id", "n", F.xxhash64("least", F.floor(F.log("n") / np.log(SIZE_BAND))).alias("first"))
    many = keyed.groupBy("first").agg(F.ceil(F.count("*") / group).alias("shares"))
    groups = saved(keyed.join(many, "first").select("id", "n", F.xxhash64("first", F.pmod(F.xxhash64("id"), "shares")).alias("grp")))
    spans = groups.groupBy("grp").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    rows = saved(shared_keys(stand.select(F.explode("prefix").alias("key"), "id", "n")))
    # Of two sets the one whose prefix ends first in the order overlaps the other in the shared part of the prefixes and
    # beyond its own prefix at most, where it has ceil(p n) - 1 tokens; p / (1 + p) of both sizes are needed.
    behind = lambda n: f"cast(ceil({n} * {percent} / 100.0) as long) - 1"
    bound = lambda low, high: f"100 * {high} >= {percent} * x_n and 100 * x_n >= {percent} * {low} and {100 + percent} * (shared + greatest({behind('x_n')}, {behind(high)})) >= {percent} * (x_n + {low})"

    def verify(pairs: DataFrame) -> DataFrame:
        """pairs: (id, grp). The links between the document and members of the group."""
        asked = saved(pairs)
        shares = asked.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES_PER_TASK_GROUP).alias("shares"))
        inside = saved(groups.select("id", "grp").join(shares, "grp"))
        opened = inside.select("id", "grp", F.explode(F.sequence(F.lit(0), F.col("shares").cast("int") - 1)).alias("salt"), F.lit(0).alias("role"))
        queries = asked.join(shares, "grp").select("id", "grp", F.pmod(F.xxhash64("id"), "shares").cast("int").alias("salt"), F.lit(1).alias("role"))
        places = saved(opened.unionByName(queries))
        coded = source.select("doc_id", "text", *bloom_bits()).where("doc_id is not null and text <> ''").mapInArrow(_tokens(width, bloom(places.select("id").distinct())), "id long, tokens array<long>")
        sent = coded.join(sized(places), "id").select("grp", "salt", "role", "id", "tokens")
        out = saved(sent.repartition(parts(sent), "grp", "salt").sortWithinPartitions("grp", "salt", "role").mapInArrow(_open(percent), "a long, b long"))
        for t in (asked, inside, places):
            dropped(t)
        return out

    star = rows.where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("shared"), F.min("n").alias("x_n"), F.min("pivot_n").alias("y_n")).where(bound("y_n", "y_n"))
    first = verify(star.select("id", F.col("pivot").alias("other")).join(groups.select(F.col("id").alias("other"), "grp"), "other").select("id", "grp").distinct())
    roots = components(first)
    label = rows.join(roots, "id", "left").join(groups.select("id", "grp"), "id").select("key", "id", "n", "grp", F.coalesce("root", "id").alias("root"))
    label = saved(label)
    mixed = label.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = saved(label.join(mixed, "key", "left_semi"))
    # Two documents of sizes x and y share at least `least` necessary tokens, if they link; so one that they share is not
    # among the least - 1 most frequent ones of the first, and those need not be looked up.
    often = left.groupBy("key").agg(F.count("*").alias("often"))
    place = Window.partitionBy("id").orderBy(F.desc("often"), "key")  # a document's own necessary tokens
    probes = left.join(often, "key").select("key", "id", "n", "grp", "root", F.row_number().over(place).alias("place"))
    matrix = left.groupBy("key", F.col("grp").alias("y_grp")).agg(F.min("root").alias("y_low"), F.max("root").alias("y_high")).join(spans.withColumnRenamed("grp", "y_grp"), "y_grp")
    least = f"ceil({percent} * (n + low) / {100 + percent}.0) - ceil({percent} * greatest(n, high) / 100.0) + 1"
    met = probes.join(matrix, "key").where(f"grp >= y_grp and (y_low <> root or y_high <> root) and 100 * high >= {percent} * n and 100 * n >= {percent} * low and place >= {least}")
    second = verify(met.select("id", F.col("y_grp").alias("grp")).distinct())
    for t in (rows, label, left, groups, stand, first_ids):
        dropped(t)
    all_roots = joined_further(roots, second)
    named = saved(classes.join(all_roots, "id", "left").select("fp1", "fp2", "n", F.coalesce("root", "id").alias("root")))
    out = saved(sets.join(named, ["fp1", "fp2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id")))
    for t in (sketch, classes, named, first, second, roots, all_roots):
        dropped(t)
    return out


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of the documents that are the smallest id of their component."""
    gone = saved(jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct())
    return docs.select(*columns).join(sized(gone), "doc_id", "left_anti").select(*columns)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH RECURSIVE
     d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
     s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(list_slice(ws, i, i + 4)) AS g
           FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM d WHERE len(ws) > 0)),
     n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
     r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
     m AS (SELECT x, min(y) AS root FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.x = d.doc_id
"""
