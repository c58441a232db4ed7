"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The vocabulary comes from a SentencePiece model file and is never trained
here. A Unigram model's log scores are used as they are. The scores of a BPE
model are merge ranks, no logarithms; for it the pieces' log scores follow
Zipf's law by rank, ln(1 / (rank + 1)) - ln(H).

Text is cut where no piece can reach across (before a white-space marker that
follows anything else; around line ends, if no piece has one), so the best
segmentation of a text is that of its chunks. Equal chunks are segmented once
for a while: the distinct ones of a batch run through the trie side by side,
one lane each, and long ones alone. The best path's ties go to the longest last
piece. A character without a piece costs the least score less 10 and becomes
its bytes' pieces (or the unknown piece, if the vocabulary has none for bytes).

Defined results. A null or empty text has no pieces and decodes to the empty
text. The marker character U+2581 in a text counts as a space, as it does in
SentencePiece; only such texts do not come back unchanged. Repeated rows give
repeated result rows; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

#: Fixed values of the model file's format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1
MARK = "▁"
UNKNOWN_PENALTY = 10.0

LANE_BYTES = 48
CACHE_CHUNKS = 200_000
_VALUE = W.mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind} in a model file")


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: list[int]
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        pieces, scores, kinds, model, prefix, trim, charsmap = [], [], [], UNIGRAM, True, True, b""
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    x = dict(_fields(value))
                    pieces.append(x.get(1, b"").decode())
                    scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                    kinds.append(x.get(3, NORMAL))
                elif number == 2:
                    model = dict(_fields(value)).get(3, UNIGRAM)
                elif number == 3:
                    x = dict(_fields(value))
                    prefix, trim, charsmap = bool(x.get(3, 1)), bool(x.get(4, 1)), x.get(2, b"")
        if charsmap or trim:
            raise ValueError("only models without text normalisation are supported")
        out = np.array(scores, dtype=np.float32)
        if model != UNIGRAM:
            ranks = [i for i, k in enumerate(kinds) if k == NORMAL]
            # Pieces without a merge (single characters) come last in a BPE vocabulary and in rank.
            total = math.log(sum(1 / (r + 1) for r in range(len(ranks))))
            for r, i in enumerate(ranks):
                out[i] = -math.log(r + 1) - total
        return cls(pieces, out, kinds, prefix)


class Trie:
    """A double-array trie over UTF-8 bytes; the marker stands as a space.

    next(node, b) is base[node] + b if check there is node, else there is no such way."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        self.unknown, words, self.plain = 0, {}, [b""] * len(v.pieces)
        least = 0.0
        for i, (piece, kind) in enumerate(zip(v.pieces, v.kinds, strict=True)):
            if kind == BYTE:
                b = int(piece[3:5], 16)
                self.byte_ids[b], self.plain[i] = i, bytes([b])
            elif kind == UNKNOWN:
                self.unknown, self.plain[i] = i, " ⁇ ".encode()
            elif kind in (NORMAL, USER_DEFINED):
                self.plain[i] = piece.replace(MARK, " ").encode()
                words[self.plain[i]] = i
                least = min(least, float(v.scores[i]))
        self.scores = v.scores
        self.unknown_score = np.float32(least - UNKNOWN_PENALTY)
        self.dummy_prefix = v.dummy_prefix
        self.has_bytes = bool((self.byte_ids >= 0).all())
        self.cut_spaces = not any(b" " in w.lstrip(b" ") for w in words)
        self.cut_lines = not any(b"\n" in w for w in words)
        self._build(words)

    def _build(self, words: dict[bytes, int]) -> None:
        tree: list[dict[int, int]] = [{}]
        final = {}
        for w, i in words.items():
            node = 0
            for b in w:
                nxt = tree[node].get(b)
                if nxt is None:
                    nxt = tree[node][b] = len(tree)
                    tree.append({})
                node = nxt
            final[node] = i
        size = 4 * len(tree) + 8192
        base, check, piece = (np.full(size, fill, dtype=np.int32) for fill in (0, -1, -1))
        taken = np.zeros(size, dtype=bool)
        place, reached = np.zeros(len(tree), dtype=np.int64), {}
        taken[0], check[0] = True, -2
        for node in range(len(tree)):  # a child always has a larger number than its parent
            at = place[node]
            piece[at] = final.get(node, -1)
            if not tree[node]:
                continue
            kids = np.array(sorted(tree[node]), dtype=np.int64)
            low = reached.get(len(kids), 1)  # below, nodes of so many children hardly find room
            while True:
                if low + 8192 > len(taken):
                    base, check, piece = np.pad(base, (0, size)), np.pad(check, (0, size), constant_values=-1), np.pad(piece, (0, size), constant_values=-1)
                    taken = np.pad(taken, (0, size))
                room = ~taken[low : low + 4096]
                for k in kids[1:] - kids[0]:
                    room &= ~taken[low + k : low + k + 4096]
                found = int(room.argmax())
                if room[found] and low + found >= kids[0]:
                    break
                low = max(low + 4096, int(kids[0]))
            reached[len(kids)] = low + found if len(kids) == 1 else max(low, low + found - 512)
            base[at] = low + found - kids[0]
            taken[base[at] + kids] = True
            check[base[at] + kids] = at
            for k in kids.tolist():
                place[tree[node][k]] = base[at] + k
        used = int(place.max()) + 257
        self.base, self.check, self.piece = (np.pad(x, (0, max(0, used - len(x))), constant_values=fill)[:used] for x, fill in ((base, 0), (check, -1), (piece, -1)))

    def alone(self, chunk: bytes) -> list[int]:
        """The best segmentation of one chunk."""
        base, check, piece, scores = self.base, self.check, self.piece, self.scores
        n = len(chunk)
        best: list = [None] * (n + 1)
        back: list = [None] * (n + 1)
        best[0] = np.float32(0)
        for i in range(n):
            here = best[i]
            if here is None:
                continue
            b = chunk[i]
            width = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            node, single = 0, False
            for j in range(i, n):
                nxt = base[node] + chunk[j]
                if nxt >= len(check) or check[nxt] != node:
                    break
                node = nxt
                p = piece[node]
                if p >= 0:
                    score = here + scores[p]
                    single |= j + 1 - i == width
                    if best[j + 1] is None or score > best[j + 1]:
                        best[j + 1], back[j + 1] = score, (i, int(p))
            if not single:
                score = here + self.unknown_score
                if best[i + width] is None or score > best[i + width]:
                    best[i + width], back[i + width] = score, (i, -1)
        out: list[int] = []
        while n:
            i, p = back[n]
            if p >= 0:
                out.append(p)
            elif self.has_bytes:
                out.extend(int(self.byte_ids[b]) for b in reversed(chunk[i:n]))
            else:
                out.append(self.unknown)
            n = i
        return out[::-1]

    def side_by_side(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best segmentations of chunks of 1 to LANE_BYTES bytes: (lane, id) in text order, and lanes with an unknown character."""
        n, most = len(start), int(size.max())
        grid = np.zeros((most + 1, n), dtype=np.int64)
        for k in range(most):
            grid[k] = raw[np.minimum(start + k, len(raw) - 1)]
        best = np.full((most + 1, n), -np.inf, dtype=np.float32)
        back = np.zeros((most + 1, n), dtype=np.int32)
        ids = np.full((most + 1, n), -1, dtype=np.int32)
        best[0] = 0
        for i in range(most):
            lanes = np.flatnonzero((size > i) & (best[i] > -np.inf))
            if not len(lanes):
                continue
            lead = grid[i, lanes]
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(n, dtype=bool)
            live, node, here = lanes, np.zeros(len(lanes), dtype=np.int64), best[i, lanes]
            for j in range(i, most):
                nxt = self.base[node] + grid[j, live]
                ok = (self.check[nxt] == node) & (size[live] > j)
                if not ok.all():
                    live, nxt, here, width = live[ok], nxt[ok], here[ok], width[ok]
                if not len(live):
                    break
                node = nxt
                p = self.piece[node]
                has = np.flatnonzero(p >= 0)
                if len(has):
                    lane, which = live[has], p[has]
                    score = here[has] + self.scores[which]
                    single[lane[width[has] == j + 1 - i]] = True
                    better = score > best[j + 1, lane]
                    lane = lane[better]
                    best[j + 1, lane], back[j + 1, lane], ids[j + 1, lane] = score[better], i, which[better]
            rest = lanes[~single[lanes]]
            if len(rest):
                lead = grid[i, rest]
                to = i + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
                score = best[i, rest] + self.unknown_score
                better = score > best[to, rest]
                to, rest = to[better], rest[better]
                best[to, rest], back[to, rest], ids[to, rest] = score[better], i, -1
        at, lane = size.astype(np.int64), np.arange(n)
        lanes_out, ids_out = [], []
        unknown = np.zeros(n, dtype=bool)
        while len(lane):
            p = ids[at, lane]
            unknown[lane[p < 0]] = True
            lanes_out.append(lane)
            ids_out.append(p)
            at = back[at, lane].astype(np.int64)
            going = at > 0
            at, lane = at[going], lane[going]
        lanes_all, ids_all = np.concatenate(lanes_out[::-1]), np.concatenate(ids_out[::-1])
        order = np.argsort(lanes_all, kind="stable")
        return lanes_all[order], ids_all[order], unknown

    def inserted(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts with the model's prefix space."""
        if not self.dummy_prefix:
            return raw, offsets
        full = (np.diff(offsets) > 0).astype(np.int64)
        return np.insert(raw, offsets[:-1][full > 0], 32).astype(np.uint8), offsets + np.concatenate([[0], np.cumsum(full)])

    def chunks(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the chunks, and how many each document has."""
        cut = np.zeros(len(raw) + 1, dtype=bool)
        if self.cut_spaces:
            space = raw == 32
            cut[1:-1] |= space[1:] & ~space[:-1]
        if self.cut_lines:
            line = raw == 10
            cut[:-1] |= line
            cut[1:] |= line
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        if not len(raw):
            edges = edges[:0]
        starts, ends = edges[:-1], edges[1:]
        return starts, ends, np.diff(np.searchsorted(starts, offsets))


class Encoder:
    """Segments batches; keeps the segmentations of at most CACHE_CHUNKS chunks, then begins anew."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self._empty()

    def _empty(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.begin = np.zeros(1 << 14, dtype=np.int64)
        self.count = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _store(self, hashes: list[int], flat: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.known)
        while len(self.begin) < n + len(hashes):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        while len(self.ids) < self.used + len(flat):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[n : n + len(hashes)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(hashes)] = counts
        self.used += len(flat)
        self.known.update(zip(hashes, range(n, n + len(hashes)), strict=True))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each document has."""
        t = self.trie
        raw, offsets = t.inserted(raw, offsets)
        starts, ends, per = t.chunks(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[raw] * W._powers("base", W._BASE, len(raw)), out=total[1:])
        hashes = W.mix((total[ends] - total[starts]) * W._powers("inverse", W._INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > CACHE_CHUNKS:
            self._empty()
        listed = unique.tolist()
        get = self.known.get
        where = np.array([get(h, -1) for h in listed], dtype=np.int64)
        new = np.flatnonzero(where < 0)
        if len(new):
            self._learn(raw, starts[first[new]], ends[first[new]], [listed[k] for k in new])
            where[new] = [self.known[listed[k]] for k in new]
        which = where[inverse]
        n = self.count[which]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ids = self.ids[np.repeat(self.begin[which], n) + inner]
        edge = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(per)])]
        return ids, np.diff(edge)

    def _learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: list[int]) -> None:
        size = end - start
        order = np.argsort(size, kind="stable")
        group: list[np.ndarray] = []
        alone = order[size[order] > LANE_BYTES].tolist()
        short = order[size[order] <= LANE_BYTES]
        for low, high in ((0, 6), (6, 9), (9, 13), (13, 20), (20, LANE_BYTES)):
            mine = short[(size[short] > low) & (size[short] <= high)]
            group += [mine[k : k + 16384] for k in range(0, len(mine), 16384)]
        for mine in group:
            if len(mine):
                lane, ids, unknown = self.trie.side_by_side(raw, start[mine], size[mine])
                alone += mine[unknown].tolist()
                keep = ~unknown[lane]
                counts = np.bincount(lane[keep], minlength=len(mine))[~unknown]
                self._store([hashes[k] for k in mine[~unknown]], ids[keep], counts)
        for k in alone:
            ids = self.trie.alone(raw[start[k] : end[k]].tobytes())
            self._store([hashes[k]], np.array(ids, dtype=np.int32), np.array([len(ids)]))


class Decoder:
    """Turns ids into text, a batch at once."""

    def __init__(self, trie: Trie):
        self.flat = np.frombuffer(b"".join(trie.plain), dtype=np.uint8)
        self.size = np.array([len(p) for p in trie.plain], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.dummy_prefix = trie.dummy_prefix

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts and their n + 1 offsets."""
        n = self.size[ids]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        raw = self.flat[np.repeat(self.begin[ids], n) + inner]
        offsets = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        if self.dummy_prefix and len(raw):
            first = offsets[:-1][np.diff(offsets) > 0]
            first = first[raw[first] == 32]
            gone = np.zeros(len(raw) + 1, dtype=np.int64)
            gone[first + 1] = 1
            raw, offsets = np.delete(raw, first), offsets - np.cumsum(gone)[offsets]
        return raw, offsets


def _encode(trie: Trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(trie), Decoder(trie)
        mark = MARK.encode()
        for batch in batches:
            for part in W.slices(batch, most=1 << 20):
                raw, offsets = W.flat(part.column(1))
                source, edges = raw, offsets
                if mark in raw.tobytes():
                    source, edges = W.flat(pa.array([(x or "").replace(MARK, " ") for x in part.column(1).to_pylist()], pa.large_string()))
                ids, counts = encoder.encode(source, edges)
                back, ends = decoder.decode(ids, counts)
                lengths = np.diff(offsets)
                alike = np.diff(ends) == lengths
                if len(back) == len(raw) and alike.all():
                    wrong = np.flatnonzero(back != raw)
                    alike[np.searchsorted(offsets, wrong, side="right") - 1] = False
                else:
                    for k in np.flatnonzero(alike):
                        alike[k] = bool((back[ends[k] : ends[k + 1]] == raw[offsets[k] : offsets[k + 1]]).all())
                yield pa.RecordBatch.from_arrays([part.column(0), W.lists(ids, counts, pa.int32()), pa.array(alike)], names=["row", "ids", "round_trip"])

    return run


def encode(docs: DataFrame, path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id by default), ids array<int>, and whether they decode to the very text."""
    trie = Trie(Vocabulary.load(path or model_path()))
    source = docs.select(F.struct(*(carry or ["doc_id"])).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = f"row {source.schema['row'].dataType.simpleString()}, ids array<int>, round_trip boolean"
    return W.small_batches(source).mapInArrow(_encode(trie), kinds).select("row.*", "ids", "round_trip")


def decode(coded: DataFrame, path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id by default) and the text of the column ids; null ids give the empty text."""
    trie = Trie(Vocabulary.load(path or model_path()))
    source = coded.select(F.struct(*(carry or ["doc_id"])).alias("row"), F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(trie)
        for batch in batches:
            col = batch.column(1)
            counts = np.diff(np.asarray(col.offsets))
            raw, offsets = decoder.decode(np.asarray(col.flatten()), counts)
            text = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.string())], names=["row", "text"])

    return W.small_batches(source).mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, text string").select("row.*", "text")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(1)
        offsets, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4")
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64()), batch.column(2)], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_pieces, ids_crc32 (unsigned, of little-endian unsigned 32-bit ids), round_trip."""
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids", "round_trip").mapInArrow(_digest, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
