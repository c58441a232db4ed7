"""Vectorised word scanning over whole Arrow batches of text.

Every function works on one flat byte buffer that holds many documents, so
the cost of a batch is a fixed number of numpy passes and no loop over
documents. Hashes are 64 bits wide: word hashes come from a random value per
byte and odd powers, so equal words have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that are scanned at once; a larger document makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch: a batch of texts or token lists stays at a few MB on both sides of the pipe.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

U64 = np.uint64


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to BATCH_ROWS rows and BATCH_BYTES; smaller settings stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        held = (conf.get(name, None) or "").rstrip("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            conf.set(name, str(most))
    return df


_STEP = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A value for each byte; A-Z share those of a-z, which lower-cases for free.
BYTE_VALUE = mix((np.arange(256, dtype=U64) + U64(1)) * _STEP)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]

_POWER: dict[str, np.ndarray] = {}
_BASE, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)


def _powers(name: str, base: int, n: int) -> np.ndarray:
    held = _POWER.get(name)
    if held is None or len(held) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        held = np.full(size, U64(base), dtype=U64)
        held[0] = U64(1)
        held = np.multiply.accumulate(held)
        _POWER[name] = held
    return held[:n]


def table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A lookup by byte of what belongs to a word."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Words are runs of anything but ASCII white space.
NOT_SPACE = ~table([(9, 13), (32, 32)])
#: Words are runs of a-z, A-Z, 0-9 and all bytes of non-ASCII characters.
ALNUM = table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 byte offsets of a string array; a null is empty."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    base = int(offsets[0]) if len(texts) else 0
    end = int(offsets[-1]) if len(texts) else 0
    raw = np.frombuffer(data, dtype=np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
    return raw, offsets - base


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, and whole rows."""
    _, offsets = flat(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and how many words each document has."""
    n = len(raw)
    word = np.zeros(n + 2, dtype=bool)
    word[1:-1] = inside[raw]
    begin = word[1:] & ~word[:-1]  # at i: byte i is a word's first
    stop = ~word[1:] & word[:-1]  # at i: byte i is the first behind a word
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    joined = cut[word[cut] & word[cut + 1]]  # a document ends in a word and the next begins with one
    begin[joined] = True
    stop[joined] = True
    starts = np.flatnonzero(begin[: n + 1])
    ends = np.flatnonzero(stop[: n + 1])
    per = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, per


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, blind to the case of A-Z."""
    total = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(BYTE_VALUE[raw] * _powers("base", _BASE, len(raw)), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers("inverse", _INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(U64))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """At i, a hash of the n hashes from i on; n - 1 fewer than there are hashes."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U64)
    out = np.zeros(len(hashes) - n + 1, dtype=U64)
    for k in range(n):
        out = out * U64(0xC2B2AE3D27D4EB4F) + hashes[k : k + len(out)]
    return mix(out)


def shingles(hashes: np.ndarray, per: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each shingle of n words its document's index and its hash, in text order.

    A document of 1 to n - 1 words has one shingle, all its words."""
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    doc = np.repeat(np.arange(len(per)), per)
    whole = runs(hashes, n)
    place = np.arange(len(doc)) - first[doc]
    keep = (place + n <= per[doc])[: len(whole)]
    short = np.flatnonzero((per > 0) & (per < n))
    docs, values = doc[: len(whole)][keep], whole[keep]
    if len(short):
        extra = np.empty(len(short), dtype=U64)
        for i, d in enumerate(short):
            h = U64(per[d])
            for x in hashes[first[d] : first[d] + per[d]]:
                h = U64((int(h) * 0x9FB21C651E98DF25 + int(x)) & 0xFFFFFFFFFFFFFFFF)
            extra[i] = h
        docs, values = np.concatenate([docs, short]), np.concatenate([values, mix(extra)])
        order = np.argsort(docs, kind="stable")
        docs, values = docs[order], values[order]
    return docs, values


def by_doc(docs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by document, then value."""
    if len(docs) and int(docs[-1]) < 1 << 16 and int(docs.max()) < 1 << 16:  # numpy sorts 16-bit keys by radix
        order = np.argsort(values)
        return order[np.argsort(docs[order].astype(np.uint16), kind="stable")]
    return np.lexsort((values, docs))


def unique_per_doc(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values, ascending within the document."""
    order = by_doc(docs, values)
    docs, values = docs[order], values[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    return docs[new], values[new]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array of consecutive runs of `values`."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


#: SimHash: seeds of its words, and a table that spreads eight bits over the eight bytes of a number.
SIM_SEEDS = [U64(x) for x in (0x8CB92BA72F3D8DD7, 0xABE1F4D5C3B7A691)]
WIDE_SEEDS = [*SIM_SEEDS, U64(0xD6E8FEB86659FD93)]
_OCTET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(U64)[:, 0]


def simhash(hashes: np.ndarray, n: np.ndarray, seeds: list = SIM_SEEDS) -> np.ndarray:
    """A 64-bit word by each seed for each run of n hashes: the majority of each bit. A run of none has zeros."""
    return np.packbits(bit_votes(hashes, n, seeds) > 0, axis=1, bitorder="little").view(U64)


def bit_votes(hashes: np.ndarray, n: np.ndarray, seeds: list) -> np.ndarray:
    """For each run of n hashes and each bit of each seed, how many more of them have it set than not.

    A sum of numbers from the table counts eight bits at once; sums run over pieces of up to 255 hashes, which
    no byte overflows."""
    out = np.zeros((len(n), 64 * len(seeds)), dtype=np.int32)
    own = np.flatnonzero(n)
    n = n[own]
    pieces = -(-n // 255)
    whole = np.cumsum(pieces) - pieces
    start = np.repeat(np.cumsum(n) - n, pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(whole, pieces))
    for k, seed in enumerate(seeds if len(own) else []):
        octets = mix(hashes ^ seed).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            counts = np.add.reduceat(_OCTET[octets[:, b]], start).view(np.uint8).reshape(-1, 8)
            counts = np.add.reduceat(counts, whole, axis=0, dtype=np.int32) if len(start) > len(own) else counts.astype(np.int32)
            out[own, 64 * k + 8 * b : 64 * k + 8 * b + 8] = 2 * counts - n[:, None]
    return out


#: On the JVM: in how many bits the SimHashes x and y differ.
SIM_BITS = "bit_count(x_s0 ^ y_s0) + bit_count(x_s1 ^ y_s1)"
