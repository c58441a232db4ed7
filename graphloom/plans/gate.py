"""The gate: is a published map exactly its lock's derivation, and does it disclose nothing it must not?"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import edges as E
from ..schemas import AUTHORED_VISIBILITY, CONFIDENCE, EDGE_KINDS, ENTITY_KINDS, FORMATS, LINK_LABELS, NEVER_NULL, REPO_VISIBILITY, RESOLVES_FROM, SCHEMA_VERSION, STATUS, TABLES, struct
from . import canonical
from .collect import Lock, load_lock
from .derive import SiteMap, derive, map_document, map_pieces


@dataclass
class Verdict:
    ok: bool
    reason: str | None
    message: str


def unknown_keys(raw: Column, kind: T.StructType) -> Column:
    """The keys of a JSON object that its type does not have; readers drop them in silence."""
    return F.array_except(F.json_object_keys(raw), F.array(*[F.lit(n) for n in kind.names]))


def _issues(rows: DataFrame, key: Column, checks: list[tuple[str, Column, str]]) -> DataFrame:
    """path and message of every check (field, holds, message) that does not hold; null does not hold."""
    found = [F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.concat_ws(".", key, F.lit(name)).alias("path"), F.lit(message).alias("message"))) for name, holds, message in checks]
    return rows.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("i.*")


def edge_issues(edges: DataFrame, name: str = "edges") -> DataFrame:
    c = F.col
    key = F.concat_ws(".", F.lit(name), c("from"), c("to"))
    return _issues(
        edges,
        key,
        [
            ("from", F.length("from") > 0, "must not be empty"),
            ("to", F.length("to") > 0, "must not be empty"),
            ("kind", c("kind").isin(list(EDGE_KINDS)), "is no edge kind"),
            ("resolved_by", F.length("resolved_by") > 0, "must not be empty"),
            ("resolves_from", c("resolves_from").isin(RESOLVES_FROM), "is none of the values"),
            ("redacted", c("redacted").isNotNull(), "is missing"),
            ("evidence", c("evidence").isNotNull(), "is missing"),
            ("evidence.line", c("evidence.line").isNull() | (c("evidence.line") >= 1), "must be 1 or more"),
        ],
    )


def entity_issues(entities: DataFrame) -> DataFrame:
    c = F.col
    kinds_full = lambda side: F.forall(c(f"derived.{side}"), lambda x: (F.size(x["kinds"]) > 0) & F.forall(x["kinds"], lambda k: k.isin(list(EDGE_KINDS))))
    authored = c("authored").isNull()
    return _issues(
        entities,
        F.concat_ws(".", F.lit("entities"), c("id")),
        [
            ("id", F.length("id") > 0, "must not be empty"),
            ("kind", c("kind").isin(ENTITY_KINDS), "is no entity kind"),
            ("repo_visibility", c("repo_visibility").isin(REPO_VISIBILITY), "is no visibility"),
            ("sources_read", c("sources_read").isNotNull(), "is missing"),
            ("manifests_read", c("manifests_read") >= 0, "must be 0 or more"),
            ("unexamined", c("unexamined").isNotNull(), "is missing"),
            ("authored", (c("kind") != "project") | ~authored, "a project entity must carry its authored block"),
            ("authored.status", authored | c("authored.status").isin(STATUS), "is no status"),
            ("authored.visibility", authored | c("authored.visibility").isin(AUTHORED_VISIBILITY), "is no visibility"),
            ("links", F.forall("links", lambda x: x["label"].isin(LINK_LABELS) & (F.length(x["href"]) > 0)), "has a bad label or an empty address"),
            ("derived.depends_on", kinds_full("depends_on"), "has a coupling without kinds"),
            ("derived.depended_on_by", kinds_full("depended_on_by"), "has a coupling without kinds"),
        ],
    )


def ownership_issues(ownership: DataFrame) -> DataFrame:
    c = F.col
    return _issues(ownership, F.concat_ws(".", F.lit("ownership"), c("coordinate")), [("coordinate", F.length("coordinate") > 0, "must not be empty"), ("repo", c("repo").isNotNull(), "is missing"), ("contested", c("contested").isNotNull(), "is missing")])


def header_issues(spark: SparkSession, header: dict) -> DataFrame:
    """Version, moment, address and counts of the header."""
    site, counts = header.get("site") or {}, header.get("declarations") or {}
    row = (header.get("schema_version"), header.get("collected_at"), site.get("url"), site.get("name"), counts.get("parsed"), counts.get("distinct"))
    rows = spark.createDataFrame([row], "schema_version int, collected_at string, url string, name string, parsed long, distinct long")
    c = F.col
    return _issues(
        rows,
        F.lit("header"),
        [
            ("schema_version", c("schema_version") == SCHEMA_VERSION, f"must be {SCHEMA_VERSION}"),
            ("collected_at", c("collected_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?Z$") & F.try_to_timestamp("collected_at").isNotNull(), "is no RFC 3339 moment"),
            ("site.url", F.expr("try_parse_url(url, 'PROTOCOL')").isNotNull(), "is no address"),
            ("site.name", F.length("name") > 0, "must not be empty"),
            ("declarations.parsed", c("parsed") >= 0, "must be 0 or more"),
            ("declarations.distinct", c("distinct") >= 0, "must be 0 or more"),
        ],
    )


def dangling_issues(edges: DataFrame, name: str, edge_kinds: list[str], resolution: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    kinds = spark.createDataFrame([(k,) for k in edge_kinds], "kind string")
    return E.dangling(edges, kinds, resolution).select(F.concat_ws(".", F.lit(name), "field").alias("path"), F.concat(F.col("value"), F.lit(" is not described in the document")).alias("message"))


_LISTS = {"entities": "entity", "edges": "edge", "weak_edges": "edge", "unresolved": "unresolved", "ownership": "ownership"}
_HEADER = ["$schema", "schema_version", "note", "collected_at", "private_inclusive", "site", "boundary", "declarations", "edge_kinds", "reserved_edge_kinds", "resolution"]


def load_map(spark: SparkSession, doc: dict, lists: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables of a map's lists, issues of shape): missing and unknown keys, at the top and in every row.

    lists: tables (pos, text) of the rows of lists that doc has empty."""
    shape = [(k, "is missing") for k in [*_HEADER, *_LISTS] if k not in doc] + [(k, "is no key of the contract") for k in doc if k not in _HEADER and k not in _LISTS]
    tables, found = {}, [spark.createDataFrame(shape, "path string, message string")]
    for name, kind in _LISTS.items():
        if name in (lists or {}):
            raw = lists[name].select(F.col("pos").alias("ord"), F.col("text").alias("raw"))
        else:
            raw = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(doc.get(name) or [])], "ord int, raw string")
        tables[name] = raw.select("ord", F.from_json("raw", struct(kind)).alias("r")).select("ord", "r.*")
        extra = raw.select("ord", F.explode(unknown_keys(F.col("raw"), struct(kind))).alias("key"))
        found.append(extra.select(F.concat_ws(".", F.lit(name), F.col("ord").cast("string"), "key").alias("path"), F.lit("is no key of the contract").alias("message")))
    rules = [(k, (v or {}).get("confidence"), (v or {}).get("how")) for k, v in (doc.get("resolution") or {}).items()]
    tables["resolution"] = spark.createDataFrame(rules, struct("resolution"))
    found.append(_issues(tables["resolution"], F.concat_ws(".", F.lit("resolution"), "rule"), [("confidence", F.col("confidence").isin(CONFIDENCE), "is no confidence")]))
    assert set(_LISTS.values()) <= set(TABLES)
    return tables, reduce(lambda a, b: a.unionByName(b), found)


def schema_issues(spark: SparkSession, doc: dict, lists: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, path and message of everything in which the document breaks the contract); lists as in load_map."""
    tables, shape = load_map(spark, doc, lists)
    kinds = list(doc.get("edge_kinds") or {})
    found = [shape, header_issues(spark, doc), entity_issues(tables["entities"]), ownership_issues(tables["ownership"])]
    for name in ("edges", "weak_edges"):
        found += [edge_issues(tables[name], name), dangling_issues(tables[name], name, kinds, tables["resolution"])]
    return tables, reduce(lambda a, b: a.unionByName(b), found)


def _shape(value, kind: T.DataType, path: str, solid: set[str], field: str = "") -> list[tuple[str, str]]:
    """path and message of everything in which a JSON value is not of the type. solid: fields, from the facts on, that are never null."""
    if isinstance(kind, T.StructType):
        if value is None and field and field not in solid:
            return []
        if not isinstance(value, dict):
            return [(path, "must be an object")]
        known = {f.name: f.dataType for f in kind}
        found = [(f"{path}.{k}", "is no key of the contract") for k in value if k not in known] + [(f"{path}.{k}", "is missing") for k in known if k not in value]
        return found + [i for k, t in known.items() if k in value for i in _shape(value[k], t, f"{path}.{k}", solid, f"{field}.{k}".strip("."))]
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            return [(path, "must be a list")]
        return [i for n, v in enumerate(value) for i in _shape(v, kind.elementType, f"{path}.{n}", solid | {field}, field)]
    if isinstance(kind, T.BooleanType):
        return [] if isinstance(value, bool) else [(path, "must be true or false")]
    if value is None:
        return [(path, "must not be null")] if field in solid else []
    good = isinstance(value, str) if isinstance(kind, T.StringType) else isinstance(value, int) and not isinstance(value, bool)
    return [] if good else [(path, f"must be a {'text' if isinstance(kind, T.StringType) else 'whole number'}")]


def lock_types() -> dict[str, T.StructType]:
    """The types of a lock's parts, as tasks take them along."""
    return {name: struct(name) for name in ("lock_header", "lock_repo", "source", *FORMATS)}


def lock_issues(document: dict, types: dict[str, T.StructType] | None = None) -> list[tuple[str, str]]:
    """path and message of everything in which a lock breaks the contract: its own fields, its repositories, and every
    source by its format. Nothing may be unknown, missing or of another type."""
    types = types or lock_types()
    head = types["lock_header"]
    found = [(k, "is no key of the contract") for k in document if k not in head.names and k not in ("repos", "sources")]
    found += [(k, "is missing") for k in [*head.names, "repos", "sources"] if k not in document]
    found += [i for f in head if f.name in document for i in _shape(document[f.name], f.dataType, f.name, {f.name}, f.name)]
    for n, repo in enumerate(document.get("repos") or []):
        found += _shape(repo, types["lock_repo"], f"repos.{n}", set(types["lock_repo"].names))
        if isinstance(repo, dict) and repo.get("visibility") not in REPO_VISIBILITY:
            found.append((f"repos.{n}.visibility", "is no visibility"))
    for n, source in enumerate(document.get("sources") or []):
        fmt = source.get("format") if isinstance(source, dict) else None
        if fmt not in FORMATS:
            found.append((f"sources.{n}.format", "is no format"))
            continue
        found += _shape({k: v for k, v in source.items() if k != "facts"}, types["source"], f"sources.{n}", {"repo", "path", "format"})
        found += _shape(source["facts"], types[fmt], f"sources.{n}.facts", set(NEVER_NULL[fmt])) if "facts" in source else [(f"sources.{n}.facts", "is missing")]
    return found


def lock_table_issues(locks: DataFrame) -> DataFrame:
    """lock, path, message of everything in which the locks (lock, text) break the contract, whatever their number: each lock
    is read by a task. A text that is no JSON object has one issue, at its root."""
    types = lock_types()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    document = json.loads(text) if text is not None else None
                except ValueError:
                    document = None
                found = lock_issues(document, types) if isinstance(document, dict) else [("<root>", "must be an object")]
                out += [(name, path, message) for path, message in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["lock", "path", "message"])

    return locks.select(F.col("lock").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lock string, path string, message string")


def _parsed(text: str):
    """A JSON value and no message, or the message alone."""
    try:
        return json.loads(text), None
    except ValueError as error:
        return None, str(error)


def _unparsed(rows: DataFrame) -> str | None:
    """The message of the first row (pos, text) that is not one JSON value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrong = [(pos, told) for pos, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (told := _parsed(text)[1]) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in wrong], pa.int64()), pa.array([r[1] for r in wrong], pa.string())], names=["pos", "message"])

    found = rows.select("pos", "text").mapInArrow(run, "pos long, message string").agg(F.min(F.struct("pos", "message")).alias("m")).first()["m"]
    return None if found is None else f"row {found['pos']}: {found['message']}"


def _read(graph: str | canonical.Document) -> tuple[object, dict[str, DataFrame], str | None]:
    """A map's value, without the lists that are tables; these; and a message if it is no JSON."""
    if isinstance(graph, str):
        doc, wrong = _parsed(graph)
        return doc, {}, wrong
    doc, wrong = _parsed(graph.head())
    lists = graph.tables()
    for name, rows in lists.items():
        told = None if wrong else _unparsed(rows)
        wrong = wrong or told and f"{name}, {told}"
    return doc, lists, wrong


def check_graph(spark: SparkSession, lock_text: str, graph_text: str | canonical.Document, origin: str, site: dict, projects: DataFrame | None = None) -> Verdict:
    """The first of these that applies: lock-unparseable, graph-unparseable, schema, divergent, privacy, or none.

    A lock has to be JSON only: what it leaves out has its empty value, as the derivation reads it (lock_issues is stricter)."""
    _, wrong = _parsed(lock_text)
    if wrong is not None:
        return Verdict(False, "lock-unparseable", f"the lock is not valid JSON: {wrong}")
    return judge(lambda: derive(load_lock(spark, lock_text), origin, site, projects), spark, graph_text)


def judge(expected: Callable[[], SiteMap], spark: SparkSession, graph: str | canonical.Document) -> Verdict:
    """The verdict on a map beside the map that it should be: its lists are compared row by row as tasks render them.

    A map that is a document is read by tasks as well; only the rows around its first difference come to the driver."""
    doc, lists, wrong = _read(graph)
    if wrong is not None:
        return Verdict(False, "graph-unparseable", f"the map is not valid JSON: {wrong}")
    if not isinstance(doc, dict):
        return Verdict(False, "schema", "the map does not satisfy the published contract.\n\n  <root>: must be an object\n")
    tables, issues = schema_issues(spark, doc, lists)
    worst = issues.orderBy("path", "message").limit(1).collect()
    if worst:
        more = issues.count() - 1
        return Verdict(False, "schema", f"the map does not satisfy the published contract.\n\n  {worst[0]['path']}: {worst[0]['message']}\n" + (f"  …and {more} more\n" if more else ""))
    if isinstance(graph, str):
        at = canonical.first_difference(map_pieces(expected(), graph), graph)
    else:
        at = canonical.document_difference(map_document(expected()), graph)
    if at:
        return Verdict(False, "divergent", f"the map is not the derivation of the lock.\n\n  First difference at line {at[0]}:\n{at[1]}\n")
    plain = lambda name: tables[name].drop("ord")
    leaks = [r[0] for r in E.privacy_violations(plain("edges"), plain("weak_edges"), plain("entities")).orderBy("message").collect()]
    if leaks:
        return Verdict(False, "privacy", "the map discloses detail about a repository that is not public.\n" + "\n".join(f"  {m}" for m in leaks))
    shut = plain("entities").where("repo_visibility <> 'public'").count()
    return Verdict(True, None, f"{plain('edges').count()} edges derive exactly from the lock; {shut} non-public endpoints carry no detail")


def _restricted(ids: list[str]):
    """Rows (pos, text) of entities: those of the given ids are written anew, as restricted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                row = json.loads(text)
                out.append("    " + canonical.value_text(row | {"repo_visibility": "restricted"}).replace("\n", "\n    ") if row["id"] in ids else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["pos", "text"])

    return run


def verdicts(lock: Lock, origin: str, site: dict) -> DataFrame:
    """made, reason, entities: what the gate says of a lock's own map, and of one map broken in each of the ways that it tells apart."""
    spark = lock.repos.sparkSession
    graph = derive(lock, origin, site)
    own = map_document(graph)
    edges, entities = own.tables()["edges"], own.tables()["entities"]
    first, same = json.loads(edges.where("pos = 0").first()["text"]), lambda: graph
    # A map that tells what it must not, and is what was derived all the same: only the last check can find it.
    secret = own.with_section("entities", entities.mapInArrow(_restricted([first["from"], first["to"]]), "pos long, text string"))
    shut = F.when(F.col("id").isin(first["from"], first["to"]), "restricted").otherwise(F.col("repo_visibility"))
    leaky = lambda: replace(graph, entities=graph.entities.withColumn("repo_visibility", shut))
    made = [
        ("unchanged", judge(same, spark, own)),
        ("bad lock", check_graph(spark, "{", own, origin, site)),
        ("bad map", judge(same, spark, replace(own, end=""))),
        ("other shape", judge(same, spark, own.with_section("schema_version", 2))),
        ("edge dropped", judge(same, spark, own.with_section("edges", edges.where("pos > 0").select((F.col("pos") - 1).alias("pos"), "text")))),
        ("secret told", judge(leaky, spark, secret)),
    ]
    n = entities.count()
    return spark.createDataFrame([(name, v.reason or "ok", n) for name, v in made], "made string, reason string, entities long")
