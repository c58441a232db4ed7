"""Benchmark decontamination by a prefix-filtered set join.

Every window of `window` consecutive words of a benchmark item (or the whole
item, when it is shorter) is a set of word shingles. All of a window's
shingles must occur in a document that contains it, so at full containment one
prefix token is necessary: the window's rarest shingle, by a count over the
whole corpus. Documents are joined with prefix tokens only; a joined position
then has to leave room for the window (length bound) at the token's offset
(positional bound), and the words there are compared one by one, as 64-bit hashes. Equal
windows of the benchmark are one window, so one that many items repeat is compared once.

The benchmark side is held by every task, in blocks of at most
`block_windows` windows. A benchmark that is larger is worked off block by
block, each with its own scan, and the blocks' hits are merged by document, so
what is broadcast never exceeds the bound.

Defined results. Null or wordless text: no words, not contaminated. Items
that are null, wordless or without an id take no part. Repeated rows give
repeated result rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 1 << 19
_BITS = 20
FOUND = "n_words long, covered array<int>, item_ids array<long>"


def _scan(batch: pa.RecordBatch):
    raw, offsets = W.flat(batch.column(batch.schema.get_field_index("text")))
    starts, ends, per = W.spans(raw, offsets, W.ALNUM)
    return W.word_hashes(raw, starts, ends), per


class Windows:
    """One block of the benchmark as flat arrays: each distinct window's words, length and items."""

    def __init__(self, rows: list[tuple[int, str]], window: int, shingle: int):
        texts = pa.array([t for _, t in rows], pa.large_string())
        raw, offsets = W.flat(texts)
        starts, ends, per = W.spans(raw, offsets, W.ALNUM)
        words = W.word_hashes(raw, starts, ends)
        first = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
        at, size, item = [], [], []
        for k, (item_id, _) in enumerate(rows):
            n = int(per[k])
            if n:
                many = max(1, n - window + 1)
                at.append(first[k] + np.arange(many))
                size.append(np.full(many, min(n, window)))
                item.append(np.full(many, item_id))
        self.words = words
        at, size, item = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (at, size, item))
        # Equal windows are one, with all the items that have it.
        whole = np.zeros((len(at), window + 1), dtype=np.uint64)
        whole[:, window] = size
        for k in range(window):
            inside = k < size
            whole[inside, k] = words[at[inside] + k]
        _, once, which = np.unique(whole, axis=0, return_index=True, return_inverse=True)
        self.at, self.size = at[once], size[once]
        owners = np.unique(np.stack([which.reshape(-1), item], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        self.owner, self.owner_begin = owners[:, 1], np.searchsorted(owners[:, 0], np.arange(len(once) + 1))
        self.shingle = shingle
        self.widths = sorted({min(int(s), shingle) for s in set(self.size.tolist())})

    def tokens(self) -> dict[int, np.ndarray]:
        """By shingle width, the distinct shingles of the windows of that width."""
        out = {}
        for width in self.widths:
            mine = np.minimum(self.size, self.shingle) == width
            grams = W.runs(self.words, width)
            places = np.concatenate([self.at[mine] + k for k in range(int((self.size[mine] - width).max()) + 1)])
            ends = np.concatenate([self.at[mine] + self.size[mine] - width] * (int((self.size[mine] - width).max()) + 1))
            out[width] = np.unique(grams[places[places <= ends]])
        return out

    def choose(self, counts: dict[tuple[int, int], int]) -> dict[int, tuple]:
        """By width: sorted prefix tokens, where each one's windows begin in a list, that list, and offsets."""
        out = {}
        for width in self.widths:
            mine = np.flatnonzero(np.minimum(self.size, self.shingle) == width)
            grams = W.runs(self.words, width)
            known = np.unique(grams)
            rarity = np.array([counts.get((width, int(x)), 0) for x in W.signed(known)], dtype=np.int64)
            many = int((self.size[mine] - width).max()) + 1
            best = np.full(len(mine), np.iinfo(np.int64).max)
            offset = np.zeros(len(mine), dtype=np.int64)
            for k in range(many):
                fits = k <= self.size[mine] - width
                place = np.where(fits, self.at[mine] + k, self.at[mine])
                count = rarity[np.searchsorted(known, grams[place])]
                better = fits & (count < best)
                best[better], offset[better] = count[better], k
            token = grams[self.at[mine] + offset]
            order = np.argsort(token, kind="stable")
            token, mine, offset = token[order], mine[order], offset[order]
            unique, begin = np.unique(token, return_index=True)
            out[width] = (unique, np.append(begin, len(token)), mine, offset)
        return out


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _BITS, dtype=bool)
    out[(tokens & W.U64((1 << _BITS) - 1)).astype(np.int64)] = True
    return out


def _present(grams: np.ndarray, tokens: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the grams that are among the sorted tokens, and which token each is."""
    maybe = np.flatnonzero(bitmap[(grams & W.U64((1 << _BITS) - 1)).astype(np.int64)])
    if not len(maybe) or not len(tokens):
        return maybe[:0], maybe[:0]
    which = np.minimum(np.searchsorted(tokens, grams[maybe]), len(tokens) - 1)
    sure = tokens[which] == grams[maybe]
    return maybe[sure], which[sure]


def _count(tokens: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {w: np.zeros(len(t), dtype=np.int64) for w, t in tokens.items()}
        maps = {w: _bitmap(t) for w, t in tokens.items()}
        for batch in batches:
            for part in W.slices(batch):
                hashes, _ = _scan(part)
                for width, known in tokens.items():
                    _, which = _present(W.runs(hashes, width), known, maps[width])
                    totals[width] += np.bincount(which, minlength=len(known))
        for width, known in tokens.items():
            seen = np.flatnonzero(totals[width])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), width), pa.int32()), pa.array(W.signed(known[seen]), pa.int64()), pa.array(totals[width][seen], pa.int64())], names=["width", "token", "n"])

    return run


def _search(block: Windows, chosen: dict[int, tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = {w: _bitmap(c[0]) for w, c in chosen.items()}
        for batch in batches:
            for part in W.slices(batch):
                yield _one(part, maps)

    def _one(part: pa.RecordBatch, maps: dict) -> pa.RecordBatch:
        hashes, per = _scan(part)
        edge = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
        cover = np.zeros(len(hashes) + 1, dtype=np.int32)
        pairs = []
        for width, (tokens, begin, windows, offsets) in chosen.items():
            places, which = _present(W.runs(hashes, width), tokens, maps[width])
            many = begin[which + 1] - begin[which]
            step, low = 1 << 20, 0
            reach = np.cumsum(many)
            while low < len(places):  # so many candidates at once at most, but for one token's own
                high = max(low + 1, int(np.searchsorted(reach, (reach[low - 1] if low else 0) + step, side="right")))
                n = many[low:high]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                entry = np.repeat(begin[which[low:high]], n) + inner
                place = np.repeat(places[low:high], n)
                low = high
                window = windows[entry]
                size = block.size[window]
                doc = np.searchsorted(edge, place, side="right") - 1
                start = place - offsets[entry]
                fits = (start >= edge[doc]) & (start + size <= edge[doc + 1])
                window, size, doc, start = window[fits], size[fits], doc[fits], start[fits]
                same = np.ones(len(window), dtype=bool)
                for k in range(int(size.max()) if len(size) else 0):
                    left = np.flatnonzero(same & (k < size))
                    same[left] = hashes[start[left] + k] == block.words[block.at[window[left]] + k]
                window, size, doc, start = window[same], size[same], doc[same], start[same]
                np.add.at(cover, start, 1)
                np.add.at(cover, start + size, -1)
                met = np.unique(np.stack([doc, window], axis=1), axis=0)
                n = np.diff(block.owner_begin)[met[:, 1]]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                pairs.append(np.unique(np.stack([np.repeat(met[:, 0], n), block.owner[np.repeat(block.owner_begin[met[:, 1]], n) + inner]], axis=1), axis=0))
        hit = np.cumsum(cover[:-1]) > 0
        at = np.flatnonzero(hit)
        doc_of = np.searchsorted(edge, at, side="right") - 1
        n_hit = np.bincount(doc_of, minlength=len(per))[: len(per)]
        found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        n_items = np.bincount(found[:, 0], minlength=len(per))[: len(per)]
        return pa.RecordBatch.from_arrays(
            [*part.columns[:-1], pa.array(per, pa.int64()), W.lists((at - edge[doc_of]).astype(np.int32), n_hit, pa.int32()), W.lists(found[:, 1], n_items, pa.int64())],
            names=[*part.schema.names[:-1], "n_words", "covered", "item_ids"],
        )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, covered (positions of hit words), item_ids (of items with an occurring window).

    docs needs doc_id and text, benchmark item_id and text. The columns named in carry stand before these."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    # A window takes at least two bytes of text, so a block's bytes bound its windows and what the driver holds.
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // (block_windows * 8)))
    carry = ["doc_id"] if carry is None else carry
    source = docs.select(F.struct(*carry).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Row identity is needed only to merge the blocks of one row.
    ident = F.lit("") if blocks == 1 else F.sha2(F.concat_ws("|", F.to_json("row"), "text"), 256)
    source = source.withColumn("row_id", ident)
    kinds = f"row {source.schema['row'].dataType.simpleString()}, row_id string, {FOUND}"
    out = None
    W.small_batches(source)
    for k in range(blocks):
        rows = [(r[0], r[1]) for r in (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items).collect()]
        block = Windows(rows, window, shingle)
        tokens = block.tokens()
        scan = source.select("text").where("text <> ''")
        counted = scan.mapInArrow(_count(tokens), "width int, token long, n long").groupBy("width", "token").agg(F.sum("n").alias("n")).collect() if tokens else []
        chosen = block.choose({(r[0], r[1]): r[2] for r in counted})
        part = source.select("row", "row_id", "text").mapInArrow(_search(block, chosen), kinds)
        out = part if out is None else out.unionByName(part)
    if blocks > 1:
        merged = out.groupBy("row_id").agg(F.first("row").alias("row"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
        copies = source.groupBy("row_id").count()
        out = merged.join(copies, "row_id").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).drop("i", "count")
    return out.select("row.*", "n_words", "covered", "item_ids")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        F.size("covered").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("covered") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of the documents without any hit word, in one pass and without a join."""
    return decontaminate(docs, benchmark, carry=columns).where("size(covered) = 0").select(*columns)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
     b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM benchmark),
     w AS (SELECT item_id, list_slice(ws, i, i + least(10, len(ws)) - 1) AS win
           FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
     sizes AS (SELECT DISTINCT len(win) AS n FROM w),
     g AS (SELECT doc_id, i, n, list_slice(ws, i, i + n - 1) AS win
           FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
     m AS (SELECT g.doc_id, g.i, g.n, w.item_id FROM g JOIN w ON g.win = w.win),
     h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
     t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
