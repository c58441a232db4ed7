"""One repository against a published index: what it publishes, what it needs, and what could not be told."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import full
from ..operators import index, resolve
from .collect import listing_notes, parse_manifests, sources

#: Formats that an inspection reads and does not resolve, in the order in which its note lists them.
UNRESOLVED_FORMATS = ["cluster-toml", "cluster-lock", "version-pin", "taskfile"]


@dataclass
class Report:
    repo: str
    root: str
    url: str
    schema_version: int
    entries: int
    publishes: DataFrame
    requires: DataFrame
    notes: list[str]


def inspect_repo(root: str, manifests: DataFrame, published: DataFrame, url: str = "", schema_version: int = 1) -> Report:
    """manifests (repo, path, content) of one checkout; published: the ownership index, with ord."""
    label = root.rstrip("/").rsplit("/", 1)[-1] or root
    facts, failed = parse_manifests(manifests)
    publishes = index.publishes(facts).select("coordinate", "kind", "where").orderBy("coordinate", "where")
    wants = index.distinct_requires(index.requires(facts)).select("coordinate", "kind", "where")
    requires = resolve.resolve_against(wants, published, ["ord"]).select("coordinate", "kind", "where", "repo", "matched", "contested").orderBy("coordinate", "kind", "where")
    notes = [r[0] for r in failed.select("message").unionByName(listing_notes(manifests.select("repo", "path", F.lit(False).alias("truncated"))).select("message")).orderBy("message").collect()]
    present = {r[0] for r in sources(facts).select("format").distinct().collect()}
    unread = [f for f in UNRESOLVED_FORMATS if f in present]
    if unread:
        notes.append(f"read but not resolved here: {', '.join(unread)}; a coordinate alone does not tell what they ask for")
    return Report(label, root, url, schema_version, published.count(), publishes, requires, notes)


def report_lines(publishes: DataFrame, requires: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines of the three sections: published, resolved, not in the index. An empty repository is unknown too."""
    known = full(F.col("repo"))
    via = F.when(F.col("matched") == F.col("coordinate"), "").otherwise(F.concat(F.lit("  via "), F.col("matched")))
    contest = F.when(F.col("contested"), "  ** CONTESTED **").otherwise("")
    one = publishes.select(F.format_string("  %s  [%s]  %s", "coordinate", "kind", "where").alias("line"), "coordinate", "where")
    two = requires.where(known).select(F.concat(F.format_string("  %s  %s  [%s]", "repo", "coordinate", "kind"), via, contest).alias("line"), "coordinate", "where")
    three = requires.where(~known).select(F.format_string("  %s  [%s]  %s", "coordinate", "kind", "where").alias("line"), "coordinate", "where")
    return one, two, three


def format_report(report: Report) -> str:
    texts = [[r[0] for r in d.orderBy("coordinate", "where").collect()] for d in report_lines(report.publishes, report.requires)]
    out = [f"{report.repo}  ({report.root})", f"resolved against {report.url} — schema v{report.schema_version}, {report.entries} coordinates", ""]
    for title, none, rows in zip(("publishes", "depends on, resolved", "not in the published index"), ("(nothing)", "(nothing in the published index)", "(none)"), texts, strict=True):
        out += [f"{title} ({len(rows)})", *(rows or [f"  {none}"]), ""]
    out.pop()
    if report.notes:
        out += ["", "notes", *[f"  {n}" for n in report.notes]]
    return "\n".join(out)
