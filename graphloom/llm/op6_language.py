"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time. It
reads a text in segments of SEGMENT bytes, one pass from either end, labels
every byte with a distribution over the learned languages, and pools the
distributions of a document's letters into the document's probabilities: the
largest is the score. All segments of all texts are labelled, so a long text
is read whole; only the recurrent state begins anew with each segment.

Training takes a bounded sample of labelled rows: at most about
`rows_per_language` rows of each language, drawn by a hash of id and text, and
`segments_per_row` segments of each, which are cut out before they leave the
executors; of the `languages_most` most common values of lang (256; ties by name). The
held-out quarter of the documents never takes part.

Defined results. A null text, or one without a letter, is `und` with score 0.
With nothing to learn from, every document is `und` with score 0. Rows with a
null lang are predicted, not learned from. Repeated rows give repeated result
rows; other columns are ignored. Ties between languages go to the first by
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

SEGMENT = 64
HIDDEN = 12
ROWS_PER_LANGUAGE = 400
SEGMENTS_PER_ROW = 8
LANES = 2048
STEPS = 300
#: The pipeline lets go of documents that score less than this.
REJECT_BELOW = 0.35
_LETTER = W.table([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_PAD = 32


class Network:
    """Weights of both directions, and the languages in order of name.

    For each direction: x, a row of 3 x H gate inputs for each byte, and u, the H x 3H recurrent weights.
    The gates' sigmoids are written as 0.5 + 0.5 tanh, with the half of the argument inside the weights."""

    def __init__(self, languages: list[str], hidden: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        n = len(languages)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            self.p[f"c{d}"] = np.zeros(hidden)  # bias inside the reset product
            self.p[f"o{d}"] = rng.normal(0, 0.3, (hidden, n))
        self.p["bias"] = np.zeros(n)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def direction(self, d: str, ids: np.ndarray, keep: bool):
        """States after each byte of ids (time x lanes), in reading order of the direction; keep: what training needs."""
        h, p = self.hidden, self.p
        x, u, c = p[f"x{d}"], p[f"u{d}"], p[f"c{d}"]
        tables = [np.ascontiguousarray(x[:, k * h : k * h + h]) for k in range(3)]
        mats = [np.ascontiguousarray(u[:, k * h : k * h + h]) for k in range(3)]
        state = np.zeros((ids.shape[1], h), dtype=np.float32)
        for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
            row = ids[t]
            r = state @ mats[0]
            r += tables[0].take(row, axis=0)
            np.tanh(r, out=r)
            r *= 0.5
            r += 0.5
            z = state @ mats[1]
            z += tables[1].take(row, axis=0)
            np.tanh(z, out=z)
            z *= 0.5
            z += 0.5
            inner = state @ mats[2]
            inner += c
            n = r * inner
            n += tables[2].take(row, axis=0)
            np.tanh(n, out=n)
            before = state
            state = before - n
            state *= z
            state += n
            yield (t, state, before, r, z, n, inner) if keep else (t, state)

    def label(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities: time x lanes x languages."""
        out = np.empty((*ids.shape, len(self.languages)), dtype=np.float32)
        for t, s in self.direction("f", ids, False):
            np.matmul(s, self.p["of"], out=out[t])
        for t, s in self.direction("b", ids, False):
            out[t] += s @ self.p["ob"]
        out += self.p["bias"]
        out -= out.max(axis=2, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=2, keepdims=True)
        return out

    def gradients(self, ids: np.ndarray, weight: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross entropy of every position, through the whole segment in both directions."""
        h, p = self.hidden, self.p
        tape = {d: {x[0]: x[1:] for x in self.direction(d, ids, True)} for d in "fb"}
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        steps, lanes = ids.shape
        error = np.empty((steps, lanes, len(self.languages)), dtype=np.float32)
        for t in range(steps):
            y = tape["f"][t][0] @ p["of"] + tape["b"][t][0] @ p["ob"] + p["bias"]
            y = np.exp(y - y.max(axis=1, keepdims=True))
            y /= y.sum(axis=1, keepdims=True)
            y[np.arange(lanes), target] -= 1
            error[t] = y * weight[t][:, None]
        error /= max(1.0, float(weight.sum()))
        grad["bias"] = error.sum(axis=(0, 1))
        for d in "fb":
            u, c = p[f"u{d}"], p[f"c{d}"]
            flow = np.zeros((lanes, h), dtype=np.float32)
            order = range(steps - 1, -1, -1) if d == "f" else range(steps)
            for t in order:
                state, before, r, z, n, inner = tape[d][t]
                grad[f"o{d}"] += state.T @ error[t]
                flow = flow + error[t] @ p[f"o{d}"].T
                dn = flow * (1 - z) * (1 - n * n)
                dz = flow * (before - n) * 2 * z * (1 - z)
                dr = dn * inner * 2 * r * (1 - r)
                back = np.concatenate([dr, dz, dn * r], axis=1)
                grad[f"u{d}"] += before.T @ back
                grad[f"c{d}"] += (dn * r).sum(axis=0)
                np.add.at(grad[f"x{d}"], ids[t], np.concatenate([dr, dz, dn], axis=1))
                flow = flow * z + back @ u.T
        return grad

    def train(self, ids: np.ndarray, weight: np.ndarray, target: np.ndarray, steps: int = STEPS, batch: int = 192, rate: float = 0.03, seed: int = 11) -> None:
        """Adam over random batches of segments; languages are drawn alike often."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(target == k) for k in range(len(self.languages))]
        by = [x for x in by if len(x)]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(x, max(1, batch // len(by))) for x in by])
            g = self.gradients(ids[:, pick], weight[:, pick], target[pick])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * min(1.0, 3.0 * (1 - step / (steps + 1)) + 0.03)
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's first byte and the index of its document."""
    size = np.diff(offsets)
    many = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), many)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    return offsets[:-1][doc] + inner * SEGMENT, doc


def lanes_of(raw: np.ndarray, offsets: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bytes of the segments, time x lanes; spaces stand behind a text's end."""
    place = start[None, :] + np.arange(SEGMENT)[:, None]
    inside = place < offsets[1:][doc][None, :]
    return np.where(inside, raw[np.minimum(place, len(raw) - 1)], _PAD)


def fit(docs: DataFrame, languages_most: int = 256, rows_per_language: int = ROWS_PER_LANGUAGE, segments_per_row: int = SEGMENTS_PER_ROW, hidden: int = HIDDEN) -> Network | None:
    """Train on the rows of docs (text, lang; doc_id serves only to draw rows); None if there are none with a letter."""
    known = docs.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages_most).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, rows_per_language / n))])
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    many = F.ceil(F.octet_length("text") / SEGMENT)
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(segments_per_row - 1)), lambda k: F.pmod(F.xxhash64("doc_id", "text", k), many)))
    cut = known.where(drawn & (many > 0)).select("lang", F.col("text").cast("binary").alias("raw"), F.explode(places).alias("k"))
    cut = cut.select("lang", F.substring("raw", F.col("k") * SEGMENT + 1, F.lit(SEGMENT)).alias("piece"))
    rows = sorted((r["lang"], bytes(r["piece"])) for r in cut.limit(2 * rows_per_language * segments_per_row * len(counts)).collect())
    languages = sorted(counts)
    pieces = [(lang, np.frombuffer(piece.ljust(SEGMENT, b" "), dtype=np.uint8)) for lang, piece in rows]
    pieces = [(lang, piece) for lang, piece in pieces if _LETTER[piece].any()]
    parts, targets = [p for _, p in pieces], [languages.index(lang) for lang, _ in pieces]
    if not parts:
        return None
    ids = np.stack(parts, axis=1)
    net = Network(languages, hidden)
    net.train(ids, _LETTER[ids].astype(np.float32), np.array(targets))
    return net


def predict_batches(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, most=1 << 20):
                yield one(part)

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        k = part.schema.get_field_index("text")
        letter = part.column(part.schema.get_field_index("has_letter")).to_numpy(zero_copy_only=False).astype(bool)
        raw, offsets = W.flat(part.column(k))
        lang, score = np.full(part.num_rows, "und", dtype=object), np.zeros(part.num_rows)
        if net is not None and len(raw):
            total = np.zeros((part.num_rows, len(net.languages)))
            start, doc = segments(raw, offsets)
            for low in range(0, len(start), LANES):
                s, d = start[low : low + LANES], doc[low : low + LANES]
                ids = lanes_of(raw, offsets, s, d)
                y = net.label(ids)
                y *= _LETTER[ids][:, :, None]
                edge = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                total[d[edge]] += np.add.reduceat(y.sum(axis=0, dtype=np.float64), edge, axis=0)
            mass = total.sum(axis=1)
            told = letter & (mass > 0)
            best = total.argmax(axis=1)
            lang[told] = np.array(net.languages, dtype=object)[best[told]]
            score[told] = np.clip(total[told, best[told]] / mass[told], 0, 1)
        rest = [c for i, c in enumerate(part.columns) if part.schema.names[i] not in ("text", "has_letter")]
        names = [n for n in part.schema.names if n not in ("text", "has_letter")]
        return pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network | None, carry: list[str]) -> DataFrame:
    """The carried columns of docs, lang_pred and score."""
    source = docs.select(F.struct(*carry).alias("row"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    kinds = f"row {source.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    return W.small_batches(source).mapInArrow(predict_batches(net), kinds).select("row.*", "lang_pred", "score")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, net, ["doc_id"]).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The documents in one of the learned languages, with a score of REJECT_BELOW or more."""
    net = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, net, columns).where((F.col("lang_pred") != "und") & (F.col("score") >= REJECT_BELOW)).select(*columns)
