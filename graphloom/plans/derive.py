"""A sources lock to a map: the derivation, and reading one entity out of it.

The map is a bundle of tables with a header; it is one document only at the sink.
Choices that the contract leaves open are listed under DECISIONS in the README.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import index, resolve
from ..schemas import COUPLINGS, EDGE_KINDS, RESERVED_EDGE_KINDS, RESOLUTION, SCHEMA_PATH, SCHEMA_VERSION, struct
from ..sources.store import written
from . import canonical
from .collect import Lock, settled, sources


def schema_url(origin: str) -> str:
    return urljoin(origin, SCHEMA_PATH)


BOUNDARY = {
    "authored": {"fields": ["authored", "links"], "meaning": "stated by a maintainer"},
    "derived": {"fields": ["derived", "edges", "weak_edges", "unresolved", "ownership"], "meaning": "read from a manifest"},
}


@dataclass
class SiteMap:
    header: dict
    entities: DataFrame
    edges: DataFrame
    weak_edges: DataFrame
    unresolved: DataFrame
    ownership: DataFrame
    resolution: DataFrame
    edge_kinds: dict = field(default_factory=lambda: dict(EDGE_KINDS))


def entity_assembly(repos: DataFrame, counts: DataFrame, projects: DataFrame, edges: DataFrame) -> DataFrame:
    """One entity for each repository of the lock, with what is authored and what is derived. Asserted edges only."""
    depends, depended = E.couplings(edges, "from", "to"), E.couplings(edges, "to", "from")
    none = F.expr(f"cast(array() as {COUPLINGS})")
    out = repos.join(counts.withColumnRenamed("repo", "slug"), "slug", "left").join(projects, "slug", "left")
    out = out.join(depends.select(F.col("id").alias("slug"), F.col("couplings").alias("a")), "slug", "left").join(depended.select(F.col("id").alias("slug"), F.col("couplings").alias("b")), "slug", "left")
    return out.select(
        F.col("slug").alias("id"),
        F.when(F.col("authored").isNotNull(), "project").otherwise("repository").alias("kind"),
        F.col("github").alias("repo"),
        F.col("visibility").alias("repo_visibility"),
        F.col("read").alias("sources_read"),
        F.coalesce("manifests", F.lit(0)).cast("int").alias("manifests_read"),
        F.coalesce("unexamined", F.array().cast("array<string>")).alias("unexamined"),
        "authored",
        F.struct(F.coalesce("a", none).alias("depends_on"), F.coalesce("b", none).alias("depended_on_by")).alias("derived"),
        F.coalesce("links", F.expr("cast(array() as array<struct<label:string,href:string>>)")).alias("links"),
    )


def derive(lock: Lock, origin: str, site: dict, projects: DataFrame | None = None) -> SiteMap:
    """The map of a lock. Equal locks give equal maps; nothing else is read."""
    spark = lock.repos.sparkSession
    projects = projects if projects is not None else spark.createDataFrame([], struct("project"))
    lock = replace(lock, facts=settled(lock.facts))
    claims = index.publishes(lock.facts, executables=True)
    owned = written(index.build_ownership(claims))
    declared = written(index.declarations(lock.facts))
    repos = lock.repos.select("slug", "github")
    resolved = written(resolve.resolve_all(declared, owned, lock.facts, repos))
    entities0 = lock.repos.select(F.col("slug").alias("id"), F.col("visibility").alias("repo_visibility"))
    every = written(E.redact(resolve.to_edges(resolved), entities0, lock.private_inclusive))
    strong = every.where(resolve.is_exact(F.col("resolved_by")))
    weak = every.where(~resolve.is_exact(F.col("resolved_by")))
    counts = sources(lock.facts).groupBy("repo").agg(F.count("*").alias("manifests"))
    entities = entity_assembly(lock.repos, counts, projects, strong)
    parsed = index.declaration_counts(declared).first()
    header = {
        "$schema": schema_url(origin),
        "schema_version": SCHEMA_VERSION,
        "note": "Generated from what repositories declare themselves. Do not edit.",
        "collected_at": lock.collected_at,
        "private_inclusive": lock.private_inclusive,
        "site": site,
        "boundary": BOUNDARY,
        "declarations": {"parsed": parsed[0], "distinct": parsed[1]},
        "edge_kinds": dict(EDGE_KINDS),
        "reserved_edge_kinds": dict(RESERVED_EDGE_KINDS),
    }
    rules = spark.createDataFrame(RESOLUTION, struct("resolution"))
    return SiteMap(header, entities, strong, weak, resolve.unresolved(resolved, repos), owned.where("kind <> 'executable-name'"), rules)


_EVIDENCE = ["table", "line", "input", "bundle", "wire", "metaKey"]


def _edge(row: dict) -> dict:
    """Locators that an edge's format does not have are left out; fields that may be null stay."""
    at = row["evidence"]
    return row | {"evidence": {k: at[k] for k in ("repo", "path", "format")} | {k: at[k] for k in _EVIDENCE if at[k] is not None}}


def _ordered(edges: DataFrame) -> list[dict]:
    keys = ["from", "to", "kind", "resolved_by", "evidence.repo", "evidence.path", "evidence.line", "detail", "version", "rev"]
    return [_edge(r.asDict(True)) for r in edges.orderBy(*keys).collect()]


def document(graph: SiteMap) -> dict:
    """The map as one document, on the driver: the artifact that is served."""
    rows = lambda df, *keys: [r.asDict(True) for r in df.orderBy(*keys).collect()]
    head = dict(graph.header)
    tail = {k: head.pop(k) for k in ("declarations", "edge_kinds", "reserved_edge_kinds")}
    return head | {
        "entities": rows(graph.entities, "id"),
        "edges": _ordered(graph.edges),
        "weak_edges": _ordered(graph.weak_edges),
        "unresolved": rows(graph.unresolved, "from", "want", "via"),
        "ownership": rows(graph.ownership, "coordinate", "kind", "repo", "where"),
        **tail,
        "resolution": {r["rule"]: {"confidence": r["confidence"], "how": r["how"]} for r in graph.resolution.orderBy("rule").collect()},
    }


_EDGE_ORDER = ["from", "to", "kind", "resolved_by", "evidence.repo", "evidence.path", "evidence.line", "detail", "version", "rev"]
#: The lists of a map, each with the order of its rows.
LISTS = {"entities": ["id"], "edges": _EDGE_ORDER, "weak_edges": _EDGE_ORDER, "unresolved": ["from", "want", "via"], "ownership": ["coordinate", "kind", "repo", "where"]}


def map_lists(graph: SiteMap) -> dict[str, DataFrame]:
    """The lists of a map as tables of rendered rows, in order."""
    return {name: canonical.rendered(getattr(graph, name), keys, _edge if keys is _EDGE_ORDER else None) for name, keys in LISTS.items()}


def _sections(graph: SiteMap) -> list[tuple[str, object]]:
    head = dict(graph.header)
    tail = {k: head.pop(k) for k in ("declarations", "edge_kinds", "reserved_edge_kinds")}
    rules = {r["rule"]: {"confidence": r["confidence"], "how": r["how"]} for r in graph.resolution.orderBy("rule").collect()}
    return [*head.items(), *map_lists(graph).items(), *tail.items(), ("resolution", rules)]


def map_pieces(graph: SiteMap, beside: str | None = None) -> Iterator[str]:
    """The map's text in pieces: its lists are never whole on the driver. beside: a text that it is compared with."""
    return canonical.pieces(_sections(graph), beside)


def map_document(graph: SiteMap) -> canonical.Document:
    """The map's text as written tables of rows."""
    return canonical.document(_sections(graph))


def map_text(graph: SiteMap) -> str:
    return "".join(map_pieces(graph))


def slice_for(graph: SiteMap, slug: str, origin: str) -> dict:
    """One entity as a document of its own, with the rules that its edges cite and the coordinates that it publishes."""
    rows = lambda df, *keys: [r.asDict(True) for r in df.orderBy(*keys).collect()]

    def groups(df: DataFrame) -> list[dict]:
        return [{"project": r["project"], "kinds": list(r["kinds"]), "edges": [_edge(e.asDict(True)) for e in r["edges"]]} for r in df.collect()]

    mine = graph.entities.where(F.col("id") == slug).collect()
    return {
        "$schema": schema_url(origin),
        "schema_version": graph.header["schema_version"],
        "note": f"A single entity from {graph.header['site']['url']}/.well-known/site-map.json, with the rules its edges cite and the coordinates it publishes. Generated — do not edit.",
        "collected_at": graph.header["collected_at"],
        "entity": mine[0].asDict(True) if mine else None,
        "depends_on": groups(E.dependencies_of(graph.edges, slug)),
        "depended_on_by": groups(E.dependents_of(graph.edges, slug)),
        "weak_edges": _ordered(E.weak_for(graph.weak_edges, slug)),
        "unresolved": rows(E.unresolved_for(graph.unresolved, slug), "from", "want", "via"),
        "ownership": rows(graph.ownership.where(F.col("repo") == slug), "coordinate", "kind", "where"),
        "resolution": {r["rule"]: {"confidence": r["confidence"], "how": r["how"]} for r in E.cited_rules(graph.edges, graph.weak_edges, slug, graph.resolution).orderBy("rule").collect()},
    }
