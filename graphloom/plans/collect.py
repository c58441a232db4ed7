"""Manifests to facts, and a roster to a sources lock."""

from __future__ import annotations

import datetime
import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_name, capped_dirs, classify, select_manifests, unexamined_by_repo
from ..functions.text import git_blob_sha
from ..functions.toml import toml_json
from ..operators import extract
from ..schemas import FORMATS, MAX_DEPTH, SCHEMA_VERSION
from ..sources.store import written

Facts = dict[str, DataFrame]
_TOML = {"cargo", "cluster-toml", "cluster-lock"}


def _facts(fmt: str, toml: Column | None) -> Column:
    text = F.col("text")
    return {
        "cargo": lambda: extract.cargo(text, toml),
        "gomod": lambda: extract.gomod(text),
        "npm": lambda: extract.npm(text),
        "server-json": lambda: extract.server_json(text),
        "cluster-toml": lambda: extract.cluster_toml(text, toml),
        "cluster-lock": lambda: extract.cluster_lock(toml),
        "version-pin": lambda: extract.version_pin(base_name(F.col("path")), text),
        "taskfile": lambda: extract.taskfile(text),
        "workflow": lambda: extract.workflow(text),
    }[fmt]()


def parse_manifests(manifests: DataFrame, formats: list[str] = FORMATS) -> tuple[Facts, DataFrame]:
    """(facts by format, notes) of manifests (repo, path, content).

    Facts tables have repo, path, blob, format, facts; contents go no further. A text that does not parse is a
    note (repo, path, message) and no row; a version pin that is none is neither. Only a format's own files reach
    its parser, and no content is read for a path that is no manifest."""
    chosen = manifests.withColumn("format", classify(F.col("path"))).where("format is not null")
    facts, notes = {}, []
    for fmt in formats:
        rows = chosen.where(F.col("format") == fmt)
        rows = rows.select("repo", "path", git_blob_sha(F.col("content").cast("binary")).alias("blob"), "format", F.decode(F.col("content").cast("binary"), "UTF-8").alias("text"))
        if fmt in _TOML:
            rows = rows.withColumn("toml", toml_json("text"))
        # A row of its own for the facts: conditions on them, and whatever explodes them, are not pushed below the parser, which would run once for each.
        parsed = rows.select("*", F.explode(F.array(_facts(fmt, F.col("toml.json") if fmt in _TOML else None))).alias("facts"))
        facts[fmt] = parsed.where("facts is not null").select("repo", "path", "blob", "format", "facts")
        if fmt in ("npm", "server-json") or fmt in _TOML:
            why = F.col("toml.error") if fmt in _TOML else F.lit("not valid JSON")
            notes.append(parsed.where("facts is null and text is not null").select("repo", "path", F.concat(F.col("path"), F.lit(f": {fmt} parse failed — "), why).alias("message")))
    unread = chosen.where("content is null").select("repo", "path", F.concat(F.col("path"), F.lit(": unreadable")).alias("message"))
    return facts, reduce(lambda a, b: a.unionByName(b), notes, unread)


def settled(facts: Facts) -> Facts:
    """The same facts as written tables: whatever reads them, and however often, each manifest is parsed once."""
    return {fmt: written(table) for fmt, table in facts.items()}


def listing_notes(files: DataFrame) -> DataFrame:
    """repo, message about what a listing (repo, path, truncated) could not cover."""
    cut = files.where("truncated").select("repo", F.lit("file listing was truncated by the API — this scan is incomplete").alias("message")).distinct()
    deep = capped_dirs(files).select("repo", F.concat("dir", F.lit(f": holds a manifest below the depth cap ({MAX_DEPTH})")).alias("message"))
    return cut.unionByName(deep)


def route(roster: DataFrame, visibility: DataFrame, remote: bool = False, include_private: bool = False) -> DataFrame:
    """The roster with visibility and what happens to each entry: read, private, restricted or no-checkout."""
    seen = roster.join(visibility.select("github", "visibility"), "github", "left").withColumn("visibility", F.coalesce("visibility", F.lit("restricted")))
    shut = F.col("visibility") != "public"
    return seen.withColumn("outcome", F.when(shut & F.lit(not include_private), "restricted").when(shut, "private").when(F.lit(remote) | F.col("checkout").isNotNull(), "read").otherwise("no-checkout"))


def lock_repos(routed: DataFrame, files: DataFrame) -> DataFrame:
    """The lock's repositories: slug, github, visibility, on_map, read, unexamined (of those that were read)."""
    out = routed.join(unexamined_by_repo(files).withColumnRenamed("repo", "slug"), "slug", "left")
    read = F.col("outcome").isin("read", "private")
    return out.select("slug", "github", "visibility", "on_map", read.alias("read"), F.when(read, F.coalesce("unexamined", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("unexamined")).orderBy("slug")


@dataclass
class Lock:
    """A collection: the roster's repositories, facts by format, and the header."""

    repos: DataFrame
    facts: Facts
    private_inclusive: bool = False
    collected_at: str = ""
    note: str = "Generated. Declarations read from each repository's own manifests, each with the git id of the file parsed."


@dataclass
class Collection:
    lock: Lock
    notes: DataFrame
    routed: DataFrame


def collect(roster: DataFrame, visibility: DataFrame, manifests: DataFrame, listing: DataFrame | None = None, remote: bool = False, include_private: bool = False, collected_at: str | None = None) -> Collection:
    """Read a roster's repositories: manifests (repo, path, content), and listing (repo, path, truncated) if it has more."""
    routed = route(roster, visibility, remote, include_private)
    readable = routed.where(F.col("outcome").isin("read", "private")).select(F.col("slug").alias("repo"))
    files = (listing if listing is not None else manifests.select("repo", "path", F.lit(False).alias("truncated"))).join(readable, "repo", "left_semi")
    facts, failed = parse_manifests(manifests.join(readable, "repo", "left_semi"))
    notes = failed.select("repo", "message").unionByName(listing_notes(files)).orderBy("repo", "message")
    private = not routed.where("outcome = 'private'").isEmpty()
    at = collected_at or datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    return Collection(Lock(lock_repos(routed, files), facts, private, at), notes, routed)


def sources(facts: Facts) -> DataFrame:
    """The header of every source (repo, path, blob, format), in the lock's order."""
    return reduce(lambda a, b: a.unionByName(b), [f.select("repo", "path", "blob", "format") for f in facts.values()]).orderBy(F.concat_ws("/", "repo", "path"))


def lock_document(lock: Lock) -> dict:
    """The lock as one document, on the driver: it is a file that people review."""
    rows = [(f"{r['repo']}/{r['path']}", r.asDict(True)) for f in lock.facts.values() for r in f.collect()]
    return {
        "schema_version": SCHEMA_VERSION,
        "collected_at": lock.collected_at,
        "private_inclusive": lock.private_inclusive,
        "note": lock.note,
        "repos": [r.asDict(True) for r in lock.repos.orderBy("slug").collect()],
        "sources": [r for _, r in sorted(rows, key=lambda x: x[0])],
    }


def serialize(document: dict) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False) + "\n"


def canonical_lock_bytes(document: dict) -> str:
    """The lock without the moment of collection, which is no part of what it claims."""
    return serialize({k: v for k, v in document.items() if k != "collected_at"})


def canonical_lock_digest(document: dict) -> str:
    return "sha256:" + hashlib.sha256(canonical_lock_bytes(document).encode()).hexdigest()


def load_lock(spark: SparkSession, text: str) -> Lock:
    """A lock from its document. Fields that a source leaves out are null, lists and flags have their empty values."""
    from ..schemas import DDL, struct

    doc = json.loads(text)
    repos = [{"unexamined": []} | r for r in doc["repos"]]
    facts = {}
    for fmt in FORMATS:
        rows = [(s["repo"], s["path"], s.get("blob"), fmt, json.dumps(_shaped(s["facts"], fmt))) for s in doc["sources"] if s["format"] == fmt]
        table = spark.createDataFrame(rows, "repo string, path string, blob string, format string, raw string")
        kind = struct(fmt)
        facts[fmt] = table.withColumn("facts", F.from_json("raw", kind)).drop("raw")
    assert set(DDL) == set(FORMATS)
    return Lock(spark.createDataFrame([tuple(r.get(c) for c in struct("lock_repo").names) for r in repos], struct("lock_repo")), facts, doc.get("private_inclusive", False), doc.get("collected_at", ""), doc.get("note", ""))


def _shaped(facts: dict, fmt: str) -> dict:
    if fmt == "cargo" and isinstance(facts.get("package"), str):
        facts = facts | {"package": {"name": facts["package"], "version": None}}
    lists = {"cargo": ["publishes", "workspaceMembers", "deps"], "gomod": ["publishes", "requires", "replaces"], "npm": ["publishes", "deps"]}
    return {k: [] for k in lists.get(fmt, [])} | facts
