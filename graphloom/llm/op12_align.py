"""Cross-tokenizer alignment: an event sweep over the ends of two tokenizers' tokens.

Each text is read as a space and the text, in UTF-8. Tokenizer A (byte-level BPE) gets
that string, tokenizer B (pieces with byte fallback) the text, to which it adds the space
itself. The tokens of both cover the same bytes, so an end offset is all that the sweep
has to know of a token, and the ends of a row of tokens follow from their ids, as a
token's bytes are in the vocabulary.

1. Events. A task encodes texts and gives blocks of end events: document, side, offset of
   the block's first byte, token ids. Encoding goes word by word (see Encoder), so
   equal words are encoded once a worker, and long texts never as a whole.
2. Sweep. The union of both sides' events is dealt out by document and sorted by offset
   within partitions. A machine passes over the stream: its state is the tokens behind the
   last offset where both sides end, and running sums. At such an offset a group closes.
   Between two neighbouring ends of either side lies one link, the tokens that cover it.
3. Counts. The sweep counts its links' id pairs, pre-aggregated in every task and then
   summed. The most frequent pairs, PAIRS_MOST at most, go to the tasks that look up the
   documents' links; links of rarer pairs are joined with the counts instead. Nothing is left out.

A document is told by doc_id and two hashes of its text. Rows that repeat one of both
alike are swept once and count as many times as they are there.

Defined results. Null and empty texts, and texts of which either side's bytes are not the
very text (a U+2581 in it, say), have no tokens: zeros, and '' for groups_sha256. A null
doc_id is a document's like any other. An empty table gives no rows. Other columns are
ignored. A stretch of text without a single space between other characters is encoded as
a whole, in memory.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .linking import parts, saved

#: Tokens of an event block; tokens that are swept at once in a long document.
BLOCK, SWEEP = 4096, 1 << 18
#: Words whose ids a worker keeps; distinct pairs a task counts before it tells; pairs whose counts go to every task.
WORDS_KEPT, PAIRS_HELD, PAIRS_MOST = 400_000, 1 << 20, 4 << 20
#: Code points with the property White_Space, and four more that some libraries count among them.
_WHITE = r"\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
#: Single spaces beside other white space or at an end: without such, all spaces are cuts.
_BESIDE = re.compile(f"[{_WHITE}] | [{_WHITE}]|^ | $")
#: Fixed value: the pieces of byte-level pre-tokenizers.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point all Unicode versions agree on what is a letter or a number.
_SETTLED = "\u0530"

KEY = ["doc_id", "h1", "h2"]
PART, PAIR = 0, 1
SWEPT = "kind int, doc_id long, h1 long, h2 long, copies long, n_a long, n_b long, n_groups long, n_links long, sha string, a binary, b binary, pair long, n long"
_SWEPT = [f.split(" ") for f in SWEPT.split(", ")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _paths() -> tuple[str, str]:
    from public_tokenizers import path

    return path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def _byte_level() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def by_ranks(held: dict):
    """A faster encoder for words in settled code points, from a tokenizer's own file; None where it might differ.

    It merges the pair with the least rank, as the file's merges do if their results have rising ids and every longer
    token is the result of one."""
    import tiktoken

    model, pre = held["model"], held["pre_tokenizer"] or {}
    plain = held["normalizer"] is None and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    byte, added = _byte_level(), {t["content"] for t in held["added_tokens"]}
    vocabulary = {t: k for t, k in model["vocab"].items() if t not in added}
    made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if made != sorted(set(made)) or made[:1] == [-1] or len(made) + 256 != len(vocabulary) or not all(c in vocabulary for c in byte):
        return None
    ranks = {bytes(byte[c] for c in t): k for t, k in vocabulary.items()}
    return tiktoken.Encoding("own", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Both tokenizers of a worker, and the ids of the words that it has met.

    A single space between two characters that are no white space begins a new piece of A's pre-tokenizer, and no
    piece of B's vocabulary has a marker behind another character. So a text's ids are those of its words, one
    after the other."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.one = Tokenizer.from_file(path_a)
        self.one.encode_special_tokens = True
        self.two = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = _byte_level()
        vocabulary = self.one.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.two.id_to_piece(k) for k in range(self.two.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.two.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.fast = by_ranks(json.loads(self.one.to_str()))
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        self.a: dict[str, bytes] = {}
        self.b: dict[str, bytes] = {}
        self.spoilt: set[str] = set()  # words whose ids do not give their bytes

    def learn(self, words: list[str]) -> None:
        """Ids of words that are not known yet."""
        if len(self.a) > WORDS_KEPT:
            self.a, self.b, self.spoilt = {}, {}, set()
        new = [w for w in dict.fromkeys(words) if w not in self.a]
        for low in range(0, len(new), 1024):
            some = new[low : low + 1024]
            slow = [w for w in some if self.fast is None or max(w, default="") >= _SETTLED]
            ones = dict(zip(slow, (e.ids for e in self.one.encode_batch([" " + w for w in slow], add_special_tokens=False)), strict=True))
            twos = self.two.encode(some, num_threads=1)
            for w, y in zip(some, twos, strict=True):
                x, want = ones.get(w), b" " + w.encode()
                if x is None:
                    x = self.fast.encode_ordinary(" " + w)
                self.a[w], self.b[w] = array("H", x).tobytes(), array("H", y).tobytes()
                if b"".join([self.bytes_a[k] for k in x]) != want or b"".join([self.bytes_b[k] for k in y]) != want:
                    self.spoilt.add(w)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides' ids; None where they do not give the text."""
        words = [text] if not self.by_word else _CUT.split(text) if _BESIDE.search(text) else text.split(" ")
        try:
            a = b"".join(map(self.a.__getitem__, words))
        except KeyError:
            self.learn(words)
            a = b"".join(map(self.a.__getitem__, words))
        if self.spoilt and not self.spoilt.isdisjoint(words):
            return None
        return np.frombuffer(a, dtype=np.uint16), np.frombuffer(b"".join(map(self.b.__getitem__, words)), dtype=np.uint16)


_HELD: dict[tuple[str, str], Encoder] = {}


def encoder(path_a: str, path_b: str) -> Encoder:
    if (path_a, path_b) not in _HELD:
        _HELD[path_a, path_b] = Encoder(path_a, path_b)
    return _HELD[path_a, path_b]


def _events(path_a: str, path_b: str):
    """Blocks of end events, and for every row a mark at offset -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, pack = encoder(path_a, path_b), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys, start, side, blocks = [], [], [], []
            for k in range(batch.num_rows):
                keys.append(k)
                start.append(-1)
                side.append(0)
                blocks.append(b"")
                text = batch.column(3)[k].as_py()
                both = tool.ids(text) if text else None
                for s, ids in enumerate(both or ()):
                    size = tool.size_b if s else tool.size_a
                    at = 0
                    for low in range(0, len(ids), BLOCK):
                        part = ids[low : low + BLOCK]
                        keys.append(k)
                        start.append(at)
                        side.append(s)
                        blocks.append(pack.compress(part.tobytes()))
                        at += int(size[part].sum())
            rows = pa.array(keys, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in range(3)], pa.array(start, pa.int64()), pa.array(side, pa.int32()), pa.array(blocks, pa.binary())], names=[*KEY, "start", "side", "ids"])

    return run


def _digits() -> tuple[np.ndarray, np.ndarray]:
    """Every id's decimal digits with a place behind them, and how many places it takes."""
    ids = np.arange(1 << 16)
    many = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 5))
    out = np.zeros((1 << 16, 6), dtype=np.uint8)
    for k in range(5):
        own = many > k
        out[own, k] = 48 + ids[own] // 10 ** (many[own] - 1 - k) % 10
    return out, many + 1


_DIGITS, _PLACES = _digits()


def ends_of(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.cumsum(size[ids])


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of each link on both sides, by place; and the offsets where both sides end. Both begin at 0 and end alike."""
    reach = int(ends_a[-1]) + 1 if len(ends_a) else 1
    one, two = np.zeros(reach, dtype=bool), np.zeros(reach, dtype=bool)
    one[ends_a] = True
    two[ends_b] = True
    every = np.flatnonzero(one | two)
    left = (np.cumsum(one) - one)[every]
    right = (np.cumsum(two) - two)[every]
    return left, right, np.flatnonzero(one & two)


def told(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, common: np.ndarray) -> bytes:
    """a1,a2|b1;a3|b2,b3; with a separator behind the last group too."""
    of_a, of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    upto_a, upto_b = (np.cumsum(np.bincount(of, minlength=len(common))) for of in (of_a, of_b))
    at_a = np.arange(len(a)) + np.append(0, upto_b)[of_a]
    at_b = np.arange(len(b)) + upto_a[of_b]
    ids, mark = np.empty(len(a) + len(b), dtype=np.uint16), np.full(len(a) + len(b), 44, dtype=np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[upto_a - 1]] = 124
    mark[at_b[upto_b - 1]] = 59
    text, places = _DIGITS[ids], _PLACES[ids]
    text[np.arange(len(ids)), places - 1] = mark
    return text[np.arange(6) < places[:, None]].tobytes()


class Sweep:
    """The machine's state in one document."""

    def __init__(self, key: tuple, sizes: tuple[np.ndarray, np.ndarray]):
        self.key, self.copies, self.sizes = key, 0, sizes
        self.held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.waits, self.wait_for = 0, SWEEP
        self.sha = None
        self.last: tuple[int, int] | None = None

    def take(self, start: int, side: int, ids: bytes, unpack) -> None:
        if start < 0:
            self.copies += 1
        elif self.last != (start, side):  # a row that repeats has the same blocks
            self.last = (start, side)
            self.held[side].append(np.frombuffer(unpack(ids), dtype=np.uint16))
            self.waits += len(self.held[side][-1])

    def pass_over(self) -> tuple[dict, np.ndarray] | None:
        """Closes all groups that have ended: a row of sums and ids, and the links' id pairs."""
        a, b = (np.concatenate(side) if side else np.zeros(0, dtype=np.uint16) for side in self.held)
        ends_a, ends_b = ends_of(a, self.sizes[0]), ends_of(b, self.sizes[1])
        if not len(a) or not len(b):
            return None
        reach = min(ends_a[-1], ends_b[-1])
        common = np.intersect1d(ends_a[: np.searchsorted(ends_a, reach, "right")], ends_b[: np.searchsorted(ends_b, reach, "right")], assume_unique=True)
        if not len(common):
            return None
        na, nb = (int(np.searchsorted(ends, common[-1], "right")) for ends in (ends_a, ends_b))
        self.held = ([a[na:]] if na < len(a) else [], [b[nb:]] if nb < len(b) else [])
        self.waits = len(a) - na + len(b) - nb
        a, b, ends_a, ends_b = a[:na], b[:nb], ends_a[:na], ends_b[:nb]
        text = told(a, b, ends_a, ends_b, common)
        if self.sha is None:
            self.sha = hashlib.sha256()
        else:
            self.sha.update(b";")
        self.sha.update(text[:-1])
        left, right, _ = links_of(ends_a, ends_b)
        return {"n_a": na, "n_b": nb, "n_groups": len(common), "n_links": len(left), "a": a.tobytes(), "b": b.tobytes()}, a[left].astype(np.int64) << 16 | b[right]


class Pairs:
    """Counts of id pairs in a task; what is held is bounded."""

    def __init__(self):
        self.wait, self.many = [], 0
        self.code, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, code: np.ndarray, copies: int) -> None:
        if copies == 1:
            self.wait.append(code)
            self.many += len(code)
        else:
            self._merge(*np.unique(code, return_counts=True), copies)
        if self.many > 2 * PAIRS_HELD:
            self.settle()

    def _merge(self, code: np.ndarray, n: np.ndarray, copies: int = 1) -> None:
        code, at = np.unique(np.concatenate([self.code, code]), return_inverse=True)
        n = np.bincount(at, np.concatenate([self.n, n * copies]), len(code)).astype(np.int64)
        self.code, self.n = code, n

    def settle(self) -> None:
        if self.wait:
            self._merge(*np.unique(np.concatenate(self.wait), return_counts=True))
            self.wait, self.many = [], 0

    def told(self) -> pa.RecordBatch:
        self.settle()
        k = len(self.code)
        cols = {"kind": np.full(k, PAIR), "pair": self.code, "n": self.n}
        self.code, self.n = self.code[:0], self.n[:0]
        return pa.RecordBatch.from_arrays([pa.array(cols[c], _ARROW[kind]) if c in cols else pa.nulls(k, _ARROW[kind]) for c, kind in _SWEPT], names=[c for c, _ in _SWEPT])


def _sweep(path_a: str, path_b: str):
    """Event blocks in order of document and offset: gives documents' parts, and pair counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, unpack, pairs = encoder(path_a, path_b), zstandard.ZstdDecompressor().decompress, Pairs()
        sizes, now, out = (tool.size_a, tool.size_b), None, []

        def step(last: bool) -> None:
            found = now.pass_over()
            row, code = found or ({"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "a": b"", "b": b""}, None)
            if code is not None:
                pairs.add(code, now.copies)
            if found or last:
                sha = (now.sha.hexdigest() if now.sha else "") if last else None
                out.append(dict(zip(KEY, now.key, strict=True)) | row | {"kind": PART, "copies": now.copies, "sha": sha})

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], _ARROW[kind]) for c, kind in _SWEPT], names=[c for c, _ in _SWEPT])
            out.clear()
            return batch

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for k, (key, start, side) in enumerate(zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if now is None or key != now.key:
                    if now is not None:
                        step(True)
                    now = Sweep(key, sizes)
                now.take(start, side, batch.column(5)[k].as_py(), unpack)
                if now.waits > now.wait_for:
                    step(False)
                    now.wait_for = SWEEP + 2 * now.waits
            yield flushed()
            if len(pairs.code) > PAIRS_HELD:
                yield pairs.told()
        if now is not None:
            step(True)
        yield flushed()
        yield pairs.told()

    return run


def swept(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A written table: the documents' parts (kind PART), and the tasks' counts of id pairs (kind PAIR)."""
    one, two = (own or known for own, known in zip((path_a, path_b), _paths() if not (path_a and path_b) else ("", ""), strict=True))
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    events = W.small_batches(source).mapInArrow(_events(one, two), "doc_id long, h1 long, h2 long, start long, side int, ids binary")
    dealt = events.repartition(parts(docs), *KEY).sortWithinPartitions(*KEY, "start", "side")
    return saved(dealt.mapInArrow(_sweep(one, two), SWEPT))


def pair_counts(table: DataFrame) -> DataFrame:
    """pair (A's id x 2^16 + B's id), n (links that hold it), best (no pair of the same B id has more). A written table."""
    counts = saved(table.where(F.col("kind") == PAIR).groupBy("pair").agg(F.sum("n").alias("n")))
    side = F.col("pair").bitwiseAND(65535)
    best = counts.groupBy(side.alias("b")).agg(F.max("n").alias("most"))  # as many rows as B has ids at most
    return saved(counts.withColumn("b", side).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _common(counts: DataFrame) -> tuple[pa.Table, int | None]:
    """The pairs that go to every task, and the count from which on a pair is one of them (None: all are)."""
    classes = sorted(counts.groupBy(F.floor(F.log2("n")).alias("k")).count().collect(), reverse=True)  # 63 rows at most
    taken, least = 0, None
    for k, many in classes:
        if taken + many > PAIRS_MOST:
            least = 1 << int(k) + 1
            break
        taken += many
    rows = counts if least is None else counts.where(F.col("n") >= least)
    return rows.toArrow(), least


class Known:
    """Counts of pairs, by binary search."""

    def __init__(self, table: pa.Table):
        code, n, best = (np.asarray(table.column(c).combine_chunks()) if c != "best" else table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("pair", "n", "best"))
        order = np.argsort(code)
        self.code, self.n, self.best = code[order].astype(np.uint32), n[order], best[order]

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs, and which are there."""
        code = code.astype(np.uint32)
        if not len(self.code):
            return np.zeros(len(code), dtype=np.int64), np.zeros(len(code), dtype=bool)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return at, self.code[at] == code


def _pairs_of(a: bytes, b: bytes, tool: Encoder) -> np.ndarray:
    x, y = np.frombuffer(a, dtype=np.uint16), np.frombuffer(b, dtype=np.uint16)
    left, right, _ = links_of(ends_of(x, tool.size_a), ends_of(y, tool.size_b))
    return x[left].astype(np.int64) << 16 | y[right]


def _score(path_a: str, path_b: str, known: Known, cold: bool):
    """Parts (key, a, b): the sums over links of known pairs; cold: the links of the others instead, counted by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path_a, path_b)
        for batch in batches:
            rows, code, many, best, total = [], [], [], [], []
            for k in range(batch.num_rows):
                pair = _pairs_of(batch.column(3)[k].as_py(), batch.column(4)[k].as_py(), tool)
                at, there = known.find(pair)
                if cold:
                    pair, n = np.unique(pair[~there], return_counts=True)
                    rows.append(np.full(len(pair), k))
                    code.append(pair)
                    many.append(n)
                else:
                    at = at[there]
                    best.append(int(known.best[at].sum()) if len(at) else 0)
                    total.append(int(known.n[at].sum()) if len(at) else 0)
            keys = [batch.column(i) for i in range(3)]
            if cold:
                at = pa.array(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64))
                last = [pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64), pa.int64()) for x in (code, many)]
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in keys], *last], names=[*KEY, "pair", "many"])
            else:
                yield pa.RecordBatch.from_arrays([*keys, pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=[*KEY, "n_best", "count_sum"])

    return run


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of docs."""
    one, two = (own or known for own, known in zip((path_a, path_b), _paths() if not (path_a and path_b) else ("", ""), strict=True))
    table = swept(docs, one, two)
    counts = pair_counts(table)
    common, least = _common(counts)
    known = Known(common)
    mine = table.where(F.col("kind") == PART)
    ids = W.small_batches(mine).select(*KEY, "a", "b")
    sums = ids.mapInArrow(_score(one, two, known, False), "doc_id long, h1 long, h2 long, n_best long, count_sum long")
    if least is not None:
        rare = ids.mapInArrow(_score(one, two, known, True), "doc_id long, h1 long, h2 long, pair long, many long").join(counts.where(F.col("n") < least), "pair")
        rare = rare.groupBy(*KEY).agg(F.sum(F.when(F.col("best"), F.col("many")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("many")).alias("count_sum"))
        sums = sums.unionByName(rare)
    plain = ["n_a", "n_b", "n_groups", "n_links"]
    rows = mine.select(*KEY, "copies", "sha", *plain, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    rows = rows.unionByName(sums.select(*KEY, F.lit(None).cast("long").alias("copies"), F.lit(None).cast("string").alias("sha"), *[F.lit(0).cast("long").alias(c) for c in plain], "n_best", "count_sum"))
    rows = rows.groupBy(*KEY).agg(F.max("copies").alias("copies"), *[F.sum(c).alias(c) for c in [*plain, "n_best", "count_sum"]], F.max("sha").alias("groups_sha256"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", *plain, "n_best", "count_sum", "groups_sha256")


def groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, ids_a, ids_b of every group, in order of nth within part: parts of a long document follow each other."""
    one, two = (own or known for own, known in zip((path_a, path_b), _paths() if not (path_a and path_b) else ("", ""), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(one, two)
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(i)[k].as_py(), dtype=np.uint16) for i in (1, 2))
                ends_a, ends_b = ends_of(a, tool.size_a), ends_of(b, tool.size_b)
                *_, common = links_of(ends_a, ends_b)
                many = [np.bincount(np.searchsorted(common, ends), minlength=len(common)) for ends in (ends_a, ends_b)]
                which = pa.array(np.full(len(common), k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), pa.array(np.arange(len(common))), *[W.lists(x.astype(np.int32), n, pa.int32()) for x, n in zip((a, b), many, strict=True)]], names=["doc_id", "nth", "ids_a", "ids_b"])

    return swept(docs, one, two).where((F.col("kind") == PART) & (F.col("n_a") > 0)).select("doc_id", "a", "b").mapInArrow(run, "doc_id long, nth long, ids_a array<int>, ids_b array<int>")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
