"""Token ids in files of range-coded blocks.

Ids are coded by an adaptive context-mixing range coder. Order 0 is the frequency of
every id in the segment, which its header holds. Orders 1 and 2 are hashed tables that
predict the next id from the last one and from the last two, each with a confidence.
An id's probability is the mixture of the three: both predictions get the weights that
they have earned so far at their confidences, the rest goes to order 0. One step of the
range coder codes the id. All state is integer, and what is divided in floating point is
exact there, so a block decodes alike wherever it is read.

A block holds BLOCK ids, begins from the same state as any other of its segment (the
header's frequencies, empty tables, fixed weights), and carries the CRC-32 of its ids.
That makes blocks independent lanes: all blocks of a segment are coded side by side, one
id of each at a time.

File format. A dataset is a folder of rows, one for each segment: `part` and
`segment` (their order is the order of the documents), `doc_ids`, `counts`
(ids of each document, the end id included) and `data`. `data` is the magic
GLT2, the number of blocks, the bytes of the frequency table, that table (deflated: how
many ids, the ids' differences, their frequencies), three 32-bit numbers for each block
(ids, CRC-32, 16-bit words), and then all blocks' words; numbers are little-endian.
Documents never cross segments. The rows lie in Parquet files, whose commit protocol
makes a lost executor harmless.

The tokenizer sees whole texts, unless its file says that it never joins over white space
(`apart`): then each distinct run of non-space is encoded once for a while, found again by
a 64-bit hash of its bytes.

Defined results. A null or empty text is the end id alone. Rows without an id
come first, equal ids in the order of their texts. Other columns are ignored.
A damaged block raises an error that names it. Ids must be below 2^18.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .linking import parts, shared_folder

MAGIC = b"GLT2"
BLOCK = 2048
#: A segment takes documents until it has so many ids. A step over few lanes takes hardly less time than one over many.
SEGMENT_IDS = 6 << 20
END_ID = 1
MOST_ID = (1 << 18) - 1
CACHE_CHUNKS = 1_500_000
_CUT = "\x01"

_U = np.uint64
#: Bits of the prediction tables' sizes, of the order-0 frequencies' total, and of the weights' total.
_T1, _T2, _P0, _PW = 9, 11, 19, 9
_ALL, _LEAST0 = 1 << _PW, 8  # order 0 keeps this weight at least
#: The coder's window: 52 bits of which the upper 16 leave, so that any quotient is exact in a double.
_MASK, _LOWEST, _OUT = _U((1 << 52) - 1), _U(1 << 36), _U(36)
_S16, _TOTAL = _U(16), _U(_P0 + _PW)


class Frequencies:
    """Order 0: what part of 2^19 each id has, and which id each of these parts belongs to."""

    def __init__(self, ids: np.ndarray, share: np.ndarray):
        self.ids, self.share = ids, share
        self.of = np.zeros(int(ids[-1]) + 2, dtype=np.uint32)
        self.of[ids] = share
        self.below = (np.cumsum(self.of) - self.of).astype(np.uint32)
        self.symbol = np.repeat(ids, share).astype(np.int32)
        self.most = np.int32(len(self.of) - 1)  # stands for any id above those that occur

    @classmethod
    def counted(cls, ids: np.ndarray) -> Frequencies:
        n = np.bincount(ids)
        present = np.flatnonzero(n)
        share = n[present] * ((1 << _P0) - len(present)) // len(ids) + 1
        share[share.argmax()] += (1 << _P0) - share.sum()
        return cls(present, share)

    def packed(self) -> bytes:
        numbers = np.concatenate([[len(self.ids)], np.diff(self.ids, prepend=0), self.share])
        return zlib.compress(numbers.astype("<u4").tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> Frequencies:
        numbers = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
        n = numbers[0]
        return cls(np.cumsum(numbers[1 : n + 1]), numbers[n + 1 :])


class _Mixer:
    """Predictions and weights of all lanes; what a block begins with is the same for each."""

    def __init__(self, lanes: int):
        self.n = np.int32(lanes)
        self.lane = np.arange(lanes, dtype=np.int32)
        self.t1 = np.zeros(lanes << _T1, dtype=np.int32)  # 18 bits of id, and the confidence above
        self.t2 = np.zeros(lanes << _T2, dtype=np.int32)
        self.base1, self.base2 = self.lane << _T1, self.lane << _T2
        self.last = np.zeros(lanes, dtype=np.int32)
        self.before = np.zeros(lanes, dtype=np.int32)
        # How often order 2 is right, and order 1 where order 2 is not, of 2^16: by both confidences and whether they agree.
        context = np.arange(32)
        right2 = np.array([0, 12000, 30000, 45000])[context >> 2 & 3]
        right1 = np.where(context < 16, np.array([0, 4000, 10000, 16000])[context & 3], 0)
        self.right2, self.right1 = (np.repeat(r, lanes).astype(np.int32) for r in (right2, right1))

    def look(self) -> None:
        self.at1 = self.base1 + (self.last * np.int32(-1640531535) >> 32 - _T1 & (1 << _T1) - 1)
        self.at2 = self.base2 + ((self.last * np.int32(668265261) ^ self.before * np.int32(374761393)) >> 32 - _T2 & (1 << _T2) - 1)
        e1, e2 = self.t1.take(self.at1), self.t2.take(self.at2)
        self.p1, self.p2, self.c1, self.c2 = e1 & MOST_ID, e2 & MOST_ID, e1 >> 18, e2 >> 18
        self.agree = self.p1 == self.p2
        self.context = ((self.agree << 4) + (self.c2 << 2) + self.c1) * self.n + self.lane
        self.r1, self.r2 = self.right1.take(self.context), self.right2.take(self.context)
        w2 = np.minimum(self.r2 >> 16 - _PW, _ALL - _LEAST0)
        w1 = np.minimum(self.r1 >> 16 - _PW, _ALL - _LEAST0 - w2)
        self.w0 = (_ALL - w1 - w2).astype(np.uint32)
        self.w1, self.w2 = w1.astype(np.uint32) << _P0, w2.astype(np.uint32) << _P0

    def interval(self, ids: np.ndarray, zero: Frequencies) -> tuple[np.ndarray, np.ndarray]:
        """Where each lane's id begins in the mixture's 2^28, and how much of it is its own."""
        self.hit1, self.hit2 = ids == self.p1, ids == self.p2
        begin = self.w0 * zero.below.take(ids) + self.w1 * (self.p1 < ids) + self.w2 * (self.p2 < ids)
        return begin, self.w0 * zero.of.take(ids) + self.w1 * self.hit1 + self.w2 * self.hit2

    def learn(self, ids: np.ndarray) -> None:
        """ids came, for which interval was asked last."""
        self.right2[self.context] = self.r2 + (self.hit2 * np.int32(65535) - self.r2 >> 5)
        self.right1[self.context] = self.r1 + ((self.hit1 > self.hit2) * np.int32(65535) - self.r1 >> 5)
        new = ids | 1 << 18
        for table, at, p, c, hit in ((self.t1, self.at1, self.p1, self.c1, self.hit1), (self.t2, self.at2, self.p2, self.c2, self.hit2)):
            kept = np.where(hit, np.minimum(c + 1, 3), c - 1)
            table[at] = np.where(kept > 0, p | kept << 18, new)
        self.before, self.last = self.last, ids


def encode_blocks(ids: np.ndarray, zero: Frequencies) -> list[np.ndarray]:
    """ids: steps x lanes. The 16-bit words of each lane."""
    steps, lanes = ids.shape
    cap = 2 * steps + 16
    out = np.zeros(lanes * cap, dtype=np.uint16)
    pos = np.arange(lanes) * cap
    low, rng = np.zeros(lanes, dtype=_U), np.full(lanes, _MASK, dtype=_U)
    mixer = _Mixer(lanes)

    def carried(low: np.ndarray) -> None:
        over = np.flatnonzero(low > _MASK)
        if len(over):
            low[over] &= _MASK
            at = pos[over] - 1
            while len(at):  # a carry runs through words that are full
                out[at] += 1
                at = at[out[at] == 0] - 1

    for step in range(steps):
        now = ids[step]
        mixer.look()
        begin, own = mixer.interval(now, zero)
        unit = rng >> _TOTAL
        low += unit * begin
        rng = unit * own
        carried(low)
        short = np.flatnonzero(rng < _LOWEST)
        while len(short):
            x = low[short]
            out[pos[short]] = x >> _OUT
            low[short] = x << _S16 & _MASK
            rng[short] <<= _S16
            pos[short] += 1
            short = short[rng[short] < _LOWEST]
        mixer.learn(now)
    low += _LOWEST - _U(1)  # one word that lies in the interval whatever follows it
    carried(low)
    out[pos] = low >> _OUT
    return [out[k * cap : e] for k, e in enumerate(pos + 1)]


def decode_blocks(words: list[np.ndarray], steps: int, zero: Frequencies) -> np.ndarray:
    """steps x lanes ids. Lanes of fewer ids end in any."""
    lanes = len(words)
    size = np.array([len(w) for w in words])
    begin = np.cumsum(size + 4) - size - 4
    flat = np.zeros(int(size.sum()) + 4 * lanes + 1, dtype=_U)
    for b, w in zip(begin, words, strict=True):
        flat[b : b + len(w)] = w
    pos, last = begin + 3, len(flat) - 2
    code = flat[begin] << _OUT | flat[begin + 1] << _U(20) | flat[begin + 2] << _U(4) | flat[begin + 3] >> _U(12)
    rng = np.full(lanes, _MASK, dtype=_U)
    mixer = _Mixer(lanes)
    ids = np.zeros((steps, lanes), dtype=np.int32)
    for step in range(steps):
        mixer.look()
        unit = rng >> _TOTAL
        target = np.minimum(code.astype(np.float64) / unit.astype(np.float64), (1 << _P0 + _PW) - 1).astype(np.uint32)
        p1, p2 = np.minimum(mixer.p1, zero.most), np.minimum(mixer.p2, zero.most)
        low1 = mixer.w0 * zero.below.take(p1) + mixer.w2 * (mixer.p2 < mixer.p1)
        low2 = mixer.w0 * zero.below.take(p2) + mixer.w1 * (mixer.p1 < mixer.p2)
        high1 = low1 + mixer.w0 * zero.of.take(p1) + mixer.w1 + mixer.w2 * mixer.agree
        high2 = low2 + mixer.w0 * zero.of.take(p2) + mixer.w2 + mixer.w1 * mixer.agree
        past1, past2 = target >= high1, target >= high2
        rest = target - mixer.w1 * past1 - mixer.w2 * past2
        now = zero.symbol.take(np.minimum(rest.astype(np.float64) / mixer.w0, (1 << _P0) - 1).astype(np.int32))
        now = np.where((target >= low1) & ~past1, p1, now)
        now = np.where((target >= low2) & ~past2, p2, now)
        start, own = mixer.interval(now, zero)
        code -= unit * start
        rng = unit * own
        short = np.flatnonzero(rng < _LOWEST)
        while len(short):
            at = pos[short]
            code[short] = (code[short] << _S16 | (flat[at] & _U(0xFFF)) << _U(4) | flat[at + 1] >> _U(12)) & _MASK
            rng[short] <<= _S16
            pos[short] = np.minimum(at + 1, last)
            short = short[rng[short] < _LOWEST]
        ids[step] = now
        mixer.learn(now)
    return ids


def pack(ids: np.ndarray) -> bytes:
    """A segment's data."""
    if len(ids) and int(ids.max()) > MOST_ID:
        raise ValueError(f"id {int(ids.max())} is above {MOST_ID}")
    many = -(-len(ids) // BLOCK)
    if not many:
        return MAGIC + struct.pack("<II", 0, 0)
    zero = Frequencies.counted(ids)
    table = zero.packed()
    steps = min(BLOCK, len(ids))
    grid = np.full(many * steps, ids[-1], dtype=np.int32)
    grid[: len(ids)] = ids
    words = encode_blocks(np.ascontiguousarray(grid.reshape(many, steps).T), zero)
    little = ids.astype("<u4")
    heads = [(len(x := little[k * BLOCK : (k + 1) * BLOCK]), zlib.crc32(x.tobytes()), len(w)) for k, w in enumerate(words)]
    return b"".join([MAGIC, struct.pack("<II", many, len(table)), table, *[struct.pack("<III", *h) for h in heads], *[w.astype("<u2").tobytes() for w in words]])


def unpack(data: bytes, name: str = "segment") -> np.ndarray:
    """The ids of a segment's data; an error names a block that does not match its checksum."""
    if data[:4] != MAGIC:
        raise ValueError(f"{name}: not a file of token blocks")
    many, table = struct.unpack_from("<II", data, 4)
    heads = np.frombuffer(data, "<u4", 3 * many, 12 + table).reshape(many, 3)
    flat = np.frombuffer(data, "<u2", -1, 12 + table + 12 * many)
    if int(heads[:, 2].sum()) != len(flat):
        raise ValueError(f"{name}: {len(flat)} words where {int(heads[:, 2].sum())} belong")
    if not many:
        return np.zeros(0, dtype=np.int64)
    try:
        zero = Frequencies.unpacked(data[12 : 12 + table])
    except zlib.error as e:
        raise ValueError(f"{name}: the table of frequencies is damaged") from e
    heads = heads.astype(np.int64)
    edge = np.concatenate([[0], np.cumsum(heads[:, 2])])
    ids = decode_blocks([flat[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], int(heads[:, 0].max()), zero)
    out = []
    for k in range(many):
        block = ids[: heads[k, 0], k].astype("<u4")
        if zlib.crc32(block.tobytes()) != heads[k, 1]:
            raise ValueError(f"{name}: block {k} does not match its checksum")
        out.append(block)
    return np.concatenate(out)


#: Normalizers that see no further than a run of non-space and the marks on its letters.
_LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}
#: Pre-tokenizers after which no token holds white space.
_PARTS = {"WhitespaceSplit", "Whitespace", "BertPreTokenizer"}


def apart(tokenizer: dict) -> bool:
    """Whether, by its file, a tokenizer's ids of a text are those of its runs of non-space, one after the other."""

    def steps(x: dict | None, inner: str) -> list[dict]:
        return [] if x is None else [y for z in x[inner] for y in steps(z, inner)] if x["type"] == "Sequence" else [x]

    def one_space(x: dict) -> bool:
        return x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " "

    normal, cut = steps(tokenizer.get("normalizer"), "normalizers"), steps(tokenizer.get("pre_tokenizer"), "pretokenizers")
    if not cut or not all(x["type"] in _LOCAL or one_space(x) for x in normal):
        return False
    if any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] for t in tokenizer.get("added_tokens") or []):
        return False
    if cut[0]["type"] != "Split":
        return cut[0]["type"] in _PARTS
    pattern = cut[0]["pattern"].get("Regex")
    # Only what matches stays, and nothing that can match white space is in the pattern: letters, digits, and sets without \s.
    if pattern is None or cut[0]["behavior"] != "Removed" or not cut[0]["invert"]:
        return False
    plain = re.sub(r"\[\^\\s[^\]]*\]|\\p\{[LNPSM]\}", "", pattern)
    return re.fullmatch(r"[A-Za-z0-9'|+*?\[\]]*", plain) is not None


_SLOTS = 22  # bits of the table of known runs, which is half full at most


class _Tokens:
    """Ids of batches of texts. Of a tokenizer that never joins over white space each distinct run is encoded once for a while."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; idle threads of a pool take CPU time
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.apart = apart(json.loads(self.t.to_str()))
        self._empty()

    def _empty(self) -> None:
        self.keys, self.nth = np.zeros(1 << _SLOTS, dtype=np.uint64), np.zeros(1 << _SLOTS, dtype=np.int32)
        self.flat, self.sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        self.start = np.zeros(0, dtype=np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short texts: joined by a character that is a token of its own, and cut at that token."""
        if any(_CUT in x for x in texts) or len(cut := self._encode([_CUT])[0]) != 1:
            out = self._encode(texts)
            return np.array([i for x in out for i in x], dtype=np.int32), np.array([len(x) for x in out], dtype=np.int64)
        flat, sizes = [], []
        for ids in self._encode([f" {_CUT} ".join([*texts[low : low + 100], ""]) for low in range(0, len(texts), 100)]):
            ids = np.array(ids, dtype=np.int32)
            at = np.flatnonzero(ids == cut[0])
            flat.append(np.delete(ids, at))
            sizes.append(np.diff(at, prepend=-1) - 1)
        sizes = np.concatenate(sizes)
        if len(sizes) != len(texts):
            raise ValueError("the tokenizer joins over white space")
        return np.concatenate(flat), sizes

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each known run, -1 of others."""
        at = (hashes >> _U(64 - _SLOTS)).astype(np.int64)
        held = self.keys.take(at)
        out = np.where(held == hashes, self.nth.take(at), -1)
        open_ = np.flatnonzero((held != hashes) & (held != 0))
        while len(open_):  # the slot has another run: look further
            at[open_] = at[open_] + 1 & (1 << _SLOTS) - 1
            held = self.keys[at[open_]]
            same = held == hashes[open_]
            out[open_[same]] = self.nth[at[open_[same]]]
            open_ = open_[~same & (held != 0)]
        return out

    def _add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        for k, h in enumerate(hashes.tolist(), len(self.sizes)):
            at = h >> 64 - _SLOTS
            while self.keys[at]:
                at = at + 1 & (1 << _SLOTS) - 1
            self.keys[at], self.nth[at] = h, k
        self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
        self.start = np.cumsum(self.sizes) - self.sizes

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.apart:
            out = self._encode([x or "" for x in texts.to_pylist()])
            return np.array([i for x in out for i in x], dtype=np.int64), np.array([len(x) for x in out], dtype=np.int64)
        raw, offsets = W.flat(texts)
        begin, end, per = W.spans(raw, offsets, W.NOT_SPACE)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[raw] * W._powers("base", W._BASE, len(raw)), out=total[1:])
        hashes = W.mix((total[end] - total[begin]) * W._powers("inverse", W._INVERSE, len(raw) + 1)[begin] + (end - begin).astype(np.uint64))
        hashes |= _U(1)  # nought is an empty slot
        which = self._known(hashes)
        new = np.flatnonzero(which < 0)
        if len(new):
            unique, first = np.unique(hashes[new], return_index=True)
            if len(self.sizes) + len(unique) > CACHE_CHUNKS:
                self._empty()
                unique, first = np.unique(hashes, return_index=True)
                new = np.arange(len(hashes))
            if len(unique) > CACHE_CHUNKS:  # one very long text
                out = self._encode([x or "" for x in texts.to_pylist()])
                return np.array([i for x in out for i in x], dtype=np.int64), np.array([len(x) for x in out], dtype=np.int64)
            data = raw.tobytes()
            self._add(unique, *self._runs([data[a:b].decode() for a, b in zip(begin[new[first]].tolist(), end[new[first]].tolist(), strict=True)]))
            which = self._known(hashes)
        n = self.sizes.take(which)
        edge = np.concatenate([[0], np.cumsum(n)])
        out = self.flat.take(np.repeat(self.start.take(which) - edge[:-1], n) + np.arange(edge[-1]))
        return out, np.diff(edge[np.concatenate([[0], np.cumsum(per)])])


_SHARED: dict[str, _Tokens] = {}


def shared_tokens(path: str) -> _Tokens:
    """One for each worker process, so that what one task has learned serves the next."""
    if path not in _SHARED:
        _SHARED[path] = _Tokens(path)
    return _SHARED[path]


_VALUE = W.mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    return np.insert(ids, np.cumsum(counts), end_id)


def _pack(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = shared_tokens(path), TaskContext.get().partitionId()
        docs, counts, ids, total, segment = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            nonlocal docs, counts, ids, total, segment
            d, c = pa.concat_arrays(docs), np.concatenate(counts)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), d),
                    W.lists(c, np.array([len(c)]), pa.int64()),
                    pa.array([int(c.sum())], pa.int64()),
                    pa.array([pack(np.concatenate(ids))], pa.binary()),
                ],
                names=["part", "segment", "doc_ids", "counts", "n_ids", "data"],
            )
            docs, counts, ids, total, segment = [], [], [], 0, segment + 1
            return out

        for batch in batches:
            for piece in W.slices(batch):
                got, n = tokens.ids(piece.column(1))
                docs.append(piece.column(0))
                counts.append(n + 1)
                ids.append(with_end(got, n, end_id))
                total += len(ids[-1])
                if total >= SEGMENT_IDS:
                    yield row()
        if docs:
            yield row()

    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of docs (doc_id, text), by the tokenizer file at path, in ascending order of doc_id."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = W.small_batches(source).repartitionByRange(parts(source), "doc_id").sortWithinPartitions("doc_id", "text")
    kinds = "part int, segment int, doc_ids array<long>, counts array<long>, n_ids long, data binary"
    dealt.mapInArrow(_pack(path or tokenizer_path(), end_id), kinds).write.option("compression", "uncompressed").parquet(folder)


def _unpack(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, segment, docs, counts, _, data = (c[k] for c in batch.columns)
                ids = unpack(data.as_buffer().to_pybytes(), f"part {part}, segment {segment}").astype("<u4")
                n = np.asarray(counts.values)
                edge = np.concatenate([[0], np.cumsum(n)])
                if digest:
                    raw = ids.tobytes()
                    told = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.int64())
                else:
                    told = W.lists(ids.astype(np.int32), n, pa.int32())
                rows = len(n)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * rows, pa.int32()), pa.array([segment.as_py()] * rows, pa.int32()), docs.values, pa.array(edge[:-1], pa.int64()), pa.array(n, pa.int64()), told], names=["part", "segment", "doc_id", "inner", "n_tokens", "told"])

    return run


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, and ids array<int> (with digest: ids_crc32 instead), from the files alone."""
    files = spark.read.parquet(folder)
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    segments = files.select("part", "segment", before(Window.partitionBy("part").orderBy("segment")).alias("within"))
    heads = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("above"))  # one row a part
    starts = segments.join(heads, "part").select("part", "segment", (F.col("above") + F.col("within")).alias("base"))
    rows = files.mapInArrow(_unpack(digest), f"part int, segment int, doc_id long, inner long, n_tokens long, told {'long' if digest else 'array<int>'}")
    out = rows.join(starts, ["part", "segment"])
    return out.select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", F.col("told").alias("ids_crc32" if digest else "ids"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/graphloom/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_tokens(spark, folder, digest=True)
