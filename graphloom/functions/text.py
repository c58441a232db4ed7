"""Text, hash and number expressions that the parsers, sinks and the diagram share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once, however often `of` names it and in whatever lambda."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def trimmed(text: Column) -> Column:
    """Without white space (the six characters of \\s) on either side."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def full(text: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(text != "", F.lit(False))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def unquoted(text: Column) -> Column:
    """Without one quotation mark on either side."""
    return F.regexp_replace(text, r"""^['"]|['"]$""", "")


def line_of(text: Column, key: Column) -> Column:
    """The line on which `key =` begins, counted from 1; null unless there is exactly one such place.

    White space before the key belongs to the match, so blank lines above it do too, and the first of
    them is what is reported."""
    quoted = F.concat(F.lit("\\Q"), key, F.lit("\\E"))
    pattern = F.concat(F.lit('(?m)^\\s*(?:"'), quoted, F.lit('"|'), quoted, F.lit(")\\s*="))
    before = F.substring(text, F.lit(1), F.regexp_instr(text, pattern) - 1)
    return F.when(F.regexp_count(text, pattern) == 1, F.size(F.split(before, "\n", -1)))


_BARE = "[A-Za-z0-9_-]+"
_MARK = "\x01"


def bare_key_lines(text: Column) -> Column:
    """What line_of says of every bare key of a TOML text, as a map: one pass marks all places, whatever the number of keys.

    The text must not hold the control character of the mark; TOML does not allow it."""
    marked = F.regexp_replace(text, rf'(?m)^\s*(?:"({_BARE})"|({_BARE}))\s*=', f"{_MARK}$1$2{_MARK}$0")
    keys = lambda x: F.filter(F.split(x, _MARK, -1), lambda _, k: k % 2 == 1)  # noqa: E731  # they stand between two marks
    found = F.flatten(F.transform(lines(marked), lambda x, i: F.transform(keys(x), lambda k: F.struct(k.alias("key"), (i + 1).alias("line")))))
    alone = lambda rows: F.filter(rows, lambda r, i: F.coalesce(F.get(rows, i - 1)["key"] != r["key"], F.lit(True)) & F.coalesce(F.get(rows, i + 1)["key"] != r["key"], F.lit(True)))
    return F.map_from_entries(bound(F.sort_array(found), alone))


def line_of_key(text: Column, known: Column, key: Column) -> Column:
    """line_of, by the map of bare_key_lines as far as that goes."""
    return F.when(key.rlike(rf"^{_BARE}\z"), F.try_element_at(known, key)).otherwise(line_of(text, key))


def git_blob_sha(content: Column) -> Column:
    """The id that git gives to a file of these bytes."""
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary"), F.lit(b"\x00"), content))


def escape_xml(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def encode_path(path: Column) -> Column:
    """Each path segment percent-encoded, a space as %20."""
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")


def round_half_up(x: Column) -> Column:
    """To the next integer, halves toward positive infinity."""
    return F.floor(x + F.lit(0.5))


def number(x: Column) -> Column:
    """A number in plain digits (no exponent, however large), without a trailing .0."""
    x = x.cast("double")
    whole = (F.abs(x) < F.lit(9e15)) & (x == F.floor(x))
    plain = F.regexp_replace(x.cast("string").cast("decimal(38,20)").cast("string"), "0+$", "")
    return F.when(whole, x.cast("long").cast("string")).when((F.abs(x) >= F.lit(1e7)) & (F.abs(x) < F.lit(9e15)), plain).otherwise(F.regexp_replace(x.cast("string"), r"\.0$", ""))


def json_string(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', 1)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
