"""Documents in canonical form, part by part: rows are rendered by tasks and sorted by range, and the driver passes them on.

A document is a JSON object with an indent of two. Its lists of rows may be as long as tables are: each
row is a text of its own, made where the row is, and the driver reads the sorted parts one after the other
into a file, a digest or a comparison. It holds a part at a time. What is compared with a text that the driver has is
compared by digests of parts first, so that only parts that differ are sent. A text that is longer than the driver's memory is a
Document: its lists are tables, and two such are compared by tasks, row by row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import dropped, written


def value_text(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def rendered(rows: DataFrame, keys: list[str], shape: Callable[[dict], dict] | None = None) -> DataFrame:
    """text: the rows as they stand in a list of a document, in the order of the keys. shape changes a row first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = value_text(shape(row) if shape else row)
                out.append("    " + text.replace("\n", "\n    "))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["text"])

    return rows.orderBy(*keys).mapInArrow(run, "text string")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def parted(texts: DataFrame) -> DataFrame:
    """part, nth, text of rendered rows in order; and for each part a row of nth -1: the characters and the digest of its rows, joined. A written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state, nth, chars = TaskContext.get().partitionId(), hashlib.sha256(), 0, 0
        names = ["part", "nth", "chars", "sha", "text"]
        for batch in batches:
            n = batch.num_rows
            if n:
                body = (",\n" if nth else "") + ",\n".join(batch.column(0).to_pylist())
                state.update(body.encode())
                chars += len(body)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(nth, nth + n), pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), batch.column(0)], names=names)
                nth += n
        if nth:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (-1, pa.int32()), (chars, pa.int64()), (state.hexdigest(), pa.string()), (None, pa.string()))], names=names)

    return written(texts.mapInArrow(run, "part int, nth int, chars long, sha string, text string"))


def pieces(sections: Iterable[tuple[str, object]], beside: str | None = None) -> Iterator[str]:
    """The document of sections (name, value or table of texts) in pieces. A table is read part by part.

    With a text beside it, a part whose digest is that of the text's characters at its place is taken from there, and not read."""
    at = None if beside is None else 0  # how far both are the same

    def told(piece: str) -> str:
        nonlocal at
        if at is not None:
            at = at + len(piece) if beside.startswith(piece, at) else None
        return piece

    yield told("{")
    for n, (name, value) in enumerate(sections):
        yield told(("," if n else "") + f"\n  {json.dumps(name, ensure_ascii=False)}: ")
        if not isinstance(value, DataFrame):
            yield told(value_text(value).replace("\n", "\n  "))
            continue
        empty = True
        if at is None:
            for row in value.toLocalIterator():
                yield ("[\n" if empty else ",\n") + row["text"]
                empty = False
        else:
            held = parted(value)
            try:
                for part, chars, sha in held.where("nth = -1").orderBy("part").select("part", "chars", "sha").collect():  # a row for each part
                    yield told("[\n" if empty else ",\n")
                    empty = False
                    same = None if at is None else beside[at : at + chars]
                    if same is not None and len(same) == chars and _sha(same) == sha:
                        yield told(same)
                        continue
                    for k, row in enumerate(held.where((F.col("part") == part) & (F.col("nth") >= 0)).orderBy("nth").select("text").toLocalIterator()):
                        yield told((",\n" if k else "") + row["text"])
            finally:
                dropped(held)
        yield told("[]" if empty else "\n  ]")
    yield told("\n}\n")


@dataclass
class Document:
    """A text by sections, each a name with a value or with a table (pos, text) of a list's rows; end is what stands behind them.

    A text that is no document any more is one as well: rows may be any text, and end too."""

    sections: list[tuple[str, object]]
    end: str = "\n}\n"

    def with_section(self, name: str, value: object) -> Document:
        return Document([(n, value if n == name else v) for n, v in self.sections], self.end)

    def head(self) -> str:
        """The text with all lists empty."""
        shown = [self.title(k) + ("[]" if isinstance(v, DataFrame) else value_text(v).replace("\n", "\n  ")) for k, (_, v) in enumerate(self.sections)]
        return "{" + "".join(shown) + self.end

    def title(self, k: int) -> str:
        return ("," if k else "") + f"\n  {json.dumps(self.sections[k][0], ensure_ascii=False)}: "

    def tables(self) -> dict[str, DataFrame]:
        return {name: v for name, v in self.sections if isinstance(v, DataFrame)}

    def pieces(self, section: int = 0, row: int = 0) -> Iterator[str]:
        """The text from the line of a section's title on, or of a row of it; rows are read a few at a time."""
        if not section and not row:
            yield "{"
        for k in range(section, len(self.sections)):
            value, at = self.sections[k][1], row if k == section else 0
            if not at:
                yield self.title(k).lstrip(",\n") if k == section and k else self.title(k)
            if not isinstance(value, DataFrame):
                yield value_text(value).replace("\n", "\n  ")
                continue
            some = value.where(F.col("pos").between(at, at + _WINDOW - 1)).orderBy("pos").collect()
            if not some and not at:
                yield "[]"
                continue
            first = at
            while some:
                for r in some:
                    yield ("[\n" if r["pos"] == 0 else "" if r["pos"] == first else ",\n") + r["text"]
                at += _WINDOW
                some = value.where(F.col("pos").between(at, at + _WINDOW - 1)).orderBy("pos").collect()
            yield "\n  ]"
        yield self.end


#: Rows of a document that the driver reads at a time, around the first one that differs.
_WINDOW = 16


def numbered(texts: DataFrame) -> DataFrame:
    """pos, text of rendered rows: their places from 0 on. A written table; the driver sees a number for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(nth, nth + n), pa.int64()), batch.column(0)], names=["part", "nth", "text"])
            nth += n

    spark = texts.sparkSession
    held = written(texts.mapInArrow(run, "part int, nth long, text string"))
    before, total = [], 0
    for r in held.groupBy("part").count().orderBy("part").collect():  # a row for each part
        before.append((r["part"], total))
        total += r["count"]
    starts = F.broadcast(spark.createDataFrame(before, "part int, start long"))
    return held.join(starts, "part").select((F.col("nth") + F.col("start")).alias("pos"), "text")


def document(sections: Iterable[tuple[str, object]]) -> Document:
    """The document of sections (name, value or table of rendered rows)."""
    return Document([(name, numbered(v) if isinstance(v, DataFrame) else v) for name, v in sections])


def _place(expected: Document, actual: Document) -> tuple[int, int] | None:
    """The section and the row of the first difference between two documents."""
    for k, (x, y) in enumerate(zip(expected.sections, actual.sections, strict=False)):
        a, b = x[1], y[1]
        if x[0] != y[0] or isinstance(a, DataFrame) != isinstance(b, DataFrame):
            return k, 0
        if not isinstance(a, DataFrame):
            if value_text(a) != value_text(b):
                return k, 0
            continue
        told = lambda rows, name: rows.select("pos", F.sha2("text", 256).alias(name))
        at = told(a, "x").join(told(b, "y"), "pos", "full_outer").where("not (x <=> y)").agg(F.min("pos")).first()[0]
        if at is not None:
            return k, at
    if len(expected.sections) != len(actual.sections) or expected.end != actual.end:
        return min(len(expected.sections), len(actual.sections)), 0
    return None


def document_difference(expected: Document, actual: Document) -> tuple[int, str] | None:
    """What first_difference tells of the documents' texts. Rows are compared by tasks; the driver reads those around the first difference."""
    found = _place(expected, actual)
    if found is None:
        return None
    section, row = found
    tables = [v if isinstance(v, DataFrame) else None for _, v in expected.sections]
    # Three lines stand before it, and the end of the line before belongs to the place: so many rows and sections are read again.
    if row > 4:
        row -= 4
    else:
        row, lines = 0, 0
        while section and lines < 5:
            section -= 1
            row = 0
            if tables[section] is None:
                lines += value_text(expected.sections[section][1]).count("\n") + 1
            else:
                n = tables[section].count()
                row = max(0, n - 4) if n > 4 else 0
                lines += n + 2
    line = _lines_before(expected, section, row)
    return first_difference(expected.pieces(section, row), actual.pieces(section, row), line)


def _lines_before(doc: Document, section: int, row: int) -> int:
    """Ends of lines before a section's title, or a row of it."""
    rows = lambda df: df.agg(F.coalesce(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1), F.lit(0))).first()[0]
    total = 0 if not section and not row else 1  # that of the brace
    for name, value in doc.sections[:section]:
        if isinstance(value, DataFrame):
            n = rows(value)
            total += n + 2 if n else 1
        else:
            total += value_text(value).count("\n") + 1
    return total + (rows(doc.sections[section][1].where(F.col("pos") < row)) + 1 if row else 0)


def digest(parts: Iterable[str]) -> str:
    state = hashlib.sha256()
    for part in parts:
        state.update(part.encode())
    return "sha256:" + state.hexdigest()


def write(parts: Iterable[str], path: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.writelines(parts)


def lines_of(parts: Iterable[str]) -> Iterator[str]:
    """Lines of a text in pieces, as split at every newline."""
    held = ""
    for part in parts:
        *whole, held = (held + part).split("\n")
        yield from whole
    yield held


def _split(text: str) -> Iterator[str]:
    """Lines of a text, without a copy of all of them."""
    start = 0
    while (stop := text.find("\n", start)) >= 0:
        yield text[start:stop]
        start = stop + 1
    yield text[start:]


def first_difference(expected: Iterable[str], actual: str | Iterable[str], line: int = 0) -> tuple[int, str] | None:
    """Line and context of the first line in which a text in pieces and a text differ; up to three lines stand before it.

    line: how many lines were alike before both."""
    before: list[str] = []
    end = "<end of file>"
    there = _split(actual) if isinstance(actual, str) else lines_of(actual)
    for at, want in enumerate(chain(lines_of(expected), [None]), line + 1):
        have = next(there, None)
        if want is None and have is None:
            return None
        if want != have:
            told = [f"  {x}" for x in before] + [f"- expected:  {end if want is None else want}", f"+ committed: {end if have is None else have}"]
            return at, "\n".join(told)
        before = [*before, want][-3:]
    return None


def unlike(left: DataFrame, right: DataFrame) -> DataFrame:
    """text, extra of rows of two lists of rendered rows that are not in both alike often: how many more are on the left."""
    count = lambda df, n: df.groupBy("text").agg(F.sum(F.lit(n)).alias("extra"))
    return count(left, 1).unionByName(count(right, -1)).groupBy("text").agg(F.sum("extra").alias("extra")).where("extra <> 0")
