"""Substring dedup: paragraph MinHash banding, exact Jaccard, clusters of removals.

Two kinds of text units take part.

Paragraphs are lines of MIN_WORDS words or more, as sets of five-word shingles.
MinHash values in bands, tuned to a recall of RECALL at the similarity, bring
paragraphs together. A joined pair is a link when its exact Jaccard similarity
is 0.8 or more; connected paragraphs are a cluster. All paragraphs of a band are held
against its first one. Those that are in different clusters then are held against each
other, if they are few and their SimHashes over shingles differ in SIM_MOST bits at most;
if they are many (copies of one original that are less like each other, or unlike
paragraphs around a common passage), op2_jaccard's exact join links them, group by group.
Nothing depends on the place of a row.

Passages that stand inside larger paragraphs begin anywhere, so cuts must follow
the content: of every ANCHOR consecutive word positions the one with the least
hash of its next three words is an anchor, and the PASSAGE words from an anchor on
are a unit. Any passage of ANCHOR + PASSAGE - 1 words or more (50) that stands in two
texts has a unit in common; equal units are a cluster (their one band is the
whole unit, their Jaccard similarity 1).

A cluster counts if it reaches two documents. Its first occurrence by (doc_id,
position) stays, all others are removals.

Units are told apart by 64-bit hashes; A-Z compare as a-z. Defined results: null,
empty and short texts have no units; rows without an id take no part; rows that
share an id are the same document, and what repeats only within a document
is no removal. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .linking import bit_of, bitmap_of, dropped, linked, maybe, saved, sized
from .op2_jaccard import jaccard_components

SHINGLE = 5
PERCENT = 80
MIN_WORDS = 25
RECALL = 0.98
ROWS = 4
#: Two sets of Jaccard similarity 0.8 differ in 19 of the 128 bits, give or take 4.
SIM_MOST = 44
ANCHOR, PASSAGE = 24, 27


def tune(percent: int = PERCENT, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of `rows` values that brings a pair of the similarity together with the recall."""
    bands, miss = 1, 1 - (percent / 100) ** rows
    while 1 - miss**bands < recall:
        bands += 1
    return bands


def _lines(raw: np.ndarray, offsets: np.ndarray):
    """Words of a slice; each full line's document, first word, number of words and first word within the document."""
    begin, end, per = W.spans(raw, offsets, W.NOT_SPACE)
    words = W.word_hashes(raw, begin, end)
    edge = np.union1d(offsets[:-1], np.flatnonzero(raw == 10) + 1)
    _, first, count = np.unique(np.searchsorted(edge, begin, side="right"), return_index=True, return_counts=True)
    doc_first = np.cumsum(per) - per
    doc = np.searchsorted(offsets, begin[first], side="right") - 1
    long = count >= MIN_WORDS
    return words, begin, end, doc_first, doc[long], first[long], count[long]


def _sets(words: np.ndarray, first: np.ndarray, count: np.ndarray):
    """Distinct shingles of paragraphs: (paragraph, value), how many, and a hash of the set."""
    grams = W.runs(words, SHINGLE)
    n = count - SHINGLE + 1
    which = np.repeat(np.arange(len(first)), n)
    place = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    which, values = W.unique_per_doc(which, grams[place])
    size = np.bincount(which, minlength=len(first))[: len(first)]
    total = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(values), dtype=np.uint64)])
    edge = np.concatenate([[0], np.cumsum(size)])
    return which, values, size, edge, W.mix(total[edge[1:]] - total[edge[:-1]] + size.astype(np.uint64))


def _paragraphs(bands: int, rows: int):
    """Places of paragraphs with their class; the band keys with the first of each class in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                words, _, _, doc_first, doc, first, count = _lines(*W.flat(part.column(1)))
                if not len(first):
                    continue
                _, values, size, edge, cls = _sets(words, first, count)
                keys = []
                for b in range(bands):
                    key = np.full(len(first), b, dtype=np.uint64)
                    for r in range(rows):
                        seed = W.mix(np.array([b * rows + r + 1], dtype=np.uint64))[0]
                        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(W.mix(values ^ seed), edge[:-1]))
                    keys.append(key)
                _, once = np.unique(cls, return_index=True)
                none = np.ones(len(first), dtype=bool)
                none[once] = False
                sizes = np.where(none, 0, bands)
                flat = np.stack(keys, axis=1)[~none].ravel()
                ids = part.column(0).take(pa.array(doc)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(first - doc_first[doc], pa.int64()), pa.array(count, pa.int64()), pa.array(W.signed(cls)), pa.array(size, pa.int64()), W.lists(W.signed(flat), sizes, pa.int64())],
                    names=["doc_id", "start", "words", "id", "n", "bands"],
                )

    return run


def _tokens(bitmap: np.ndarray):
    """id, shingles and SimHash of the classes that may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                words, _, _, _, _, first, count = _lines(*W.flat(part.column(0)))
                if not len(first):
                    continue
                which, values, size, _, cls = _sets(words, first, count)
                once = np.zeros(len(first), dtype=bool)
                once[np.unique(cls, return_index=True)[1]] = True
                once &= maybe(bitmap, *[bit_of(cls, k) for k in range(2)])
                tokens, n = values[once[which]], size[once]
                sim = W.simhash(tokens, n)
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(cls[once])), W.lists(W.signed(tokens), n, pa.int64()), *[pa.array(W.signed(sim[:, k])) for k in range(2)]], names=["id", "tokens", "s0", "s1"])

    return run


def _texts(bitmap: np.ndarray):
    """doc_id (the class) and text of the paragraphs whose class may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                raw, offsets = W.flat(part.column(0))
                words, begin, end, _, _, first, count = _lines(raw, offsets)
                if not len(first):
                    continue
                _, _, _, _, cls = _sets(words, first, count)
                _, once = np.unique(cls, return_index=True)
                once = once[maybe(bitmap, *[bit_of(cls[once], k) for k in range(2)])]
                data = raw.tobytes()
                texts = [data[a:b].decode() for a, b in zip(begin[first[once]].tolist(), end[first[once] + count[once] - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(cls[once])), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            xe, ye, xv, yv = np.asarray(x.offsets), np.asarray(y.offsets), np.asarray(x.values), np.asarray(y.values)
            same = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                a, b = xv[xe[i] : xe[i + 1]].view(np.uint64), yv[ye[i] : ye[i + 1]].view(np.uint64)
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                both = int((a[at] == b).sum())
                same[i] = 100 * both >= percent * (len(a) + len(b) - both)
            kept = batch.filter(pa.array(same))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return run


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """At i, the least of the n values from i on."""
    out, width = values, 1
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(values) - n + 1], out[n - width : n - width + len(values) - n + 1]) if len(values) >= n else values[:0]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passage units: key (a hash of the words), id (the document) and n (the first word's position)."""
    for batch in batches:
        for part in W.slices(batch):
            raw, offsets = W.flat(part.column(1))
            begin, end, per = W.spans(raw, offsets, W.NOT_SPACE)
            if len(begin) < PASSAGE:
                continue
            words = W.word_hashes(raw, begin, end)
            first = np.cumsum(per) - per
            doc = np.repeat(np.arange(len(per)), per)
            place = np.arange(len(doc)) - first[doc]
            grams = W.runs(words, 3)
            packed = (grams & ~np.uint64((1 << 28) - 1)) | np.arange(len(grams), dtype=np.uint64)
            best = least_of(packed, ANCHOR)
            inside = place[: len(best)] + ANCHOR + 2 <= per[doc[: len(best)]]
            anchor = np.unique(best[inside] & np.uint64((1 << 28) - 1)).astype(np.int64)
            anchor = anchor[place[anchor] + PASSAGE <= per[doc[anchor]]]
            units = W.runs(words, PASSAGE)[anchor]
            ids = part.column(0).take(pa.array(doc[anchor])).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(units)), ids, pa.array(place[anchor], pa.int64())], names=["key", "id", "n"])


def paragraph_roots(source: DataFrame, places: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id, root: the paragraph classes of places (id, n, bands) that have links, and the smallest class that each reaches."""
    members = places.select(F.explode("bands").alias("key"), "id", "n")

    def fetch(need: DataFrame) -> DataFrame:
        tokens = source.select("text").mapInArrow(_tokens(bitmap_of(need)), "id long, tokens array<long>, s0 long, s1 long")
        return tokens.join(need, "id", "left_semi").groupBy("id").agg(*[F.first(c).alias(c) for c in ("tokens", "s0", "s1")])

    def verify(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
        both = pairs.join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long")

    def crowd(ids: DataFrame) -> DataFrame:
        found = source.select("text").mapInArrow(_texts(bitmap_of(ids)), "doc_id long, text string").join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        texts = saved(found.groupBy("doc_id").agg(F.first("text").alias("text")))
        out = saved(jaccard_components(texts, SHINGLE, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
        dropped(texts)
        return out

    return linked(members, fetch, verify, crowd, percent, ["s0", "s1"], f"{W.SIM_BITS} <= {SIM_MOST}")


def repeated_passages(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """doc_id, start and words (of the unit, in words), cluster_id, kept_doc (the document whose copy stays), removed."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text <> ''")
    places = saved(W.small_batches(source).mapInArrow(_paragraphs(tune(percent, recall), ROWS), "doc_id long, start long, words long, id long, n long, bands array<long>"))
    roots = paragraph_roots(source, places, percent)
    placed = saved(places.select("doc_id", "start", "words", "id").join(sized(roots), "id", "left").select("doc_id", "start", "words", F.coalesce("root", "id").alias("cluster_id")))
    first = saved(placed.groupBy("cluster_id").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last"))
    paragraphs = placed.join(sized(first), "cluster_id").select(
        "doc_id", "start", "words", "cluster_id", F.col("first.doc_id").alias("kept_doc"), ((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))).alias("removed")
    )
    windows = saved(source.mapInArrow(_windows, "key long, id long, n long"))
    shared = saved(windows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("first"), F.max("id").alias("last")).where("first.id < last"))
    passages = windows.join(sized(shared), "key").distinct().select(
        F.col("id").alias("doc_id"), F.col("n").alias("start"), F.lit(PASSAGE).cast("long").alias("words"), F.col("key").alias("cluster_id"), F.col("first.id").alias("kept_doc"), ((F.col("id") != F.col("first.id")) | (F.col("n") != F.col("first.n"))).alias("removed")
    )
    out = saved(paragraphs.unionByName(passages))
    for t in (places, roots, placed, first, windows, shared):
        dropped(t)
    return out


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with a unit that stands in another document too: doc_id, n_units, n_removed,
    removed_words (positions under any removal) and kept_docs, the documents whose copies stay instead."""
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = found.groupBy("doc_id").agg(
        F.count("*").alias("n_units"),
        F.count_if("removed").alias("n_removed"),
        F.array_sort(F.collect_set(F.when(F.col("removed"), F.struct("start", (F.col("start") + F.col("words")).alias("stop"))))).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("kept_doc")))).alias("kept_docs"),
    )
    start = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        "spans",
        start,
        lambda a, x: F.struct(F.greatest(a["reach"], x["stop"]).alias("reach"), (a["total"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(a["reach"], x["start"]))).alias("total")),
    )["total"]
    return spans.select("doc_id", "n_units", "n_removed", covered.alias("removed_words"), "kept_docs")
