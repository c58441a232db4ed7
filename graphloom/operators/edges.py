"""Edges after resolution: redaction, audits, groups, slices, and what the diagram draws.

Lookups of visibility and confidence are joins with tables of entities and
rules. They are left joins whose misses are made explicit, each in its own
operator: a missing entity is not public, a missing rule has the weakest
confidence of the reader that asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, json_string

_DETAIL = ["detail", "version", "rev"]


def endpoint_visibility(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """edges with both_public: false when either end is not public or is no entity."""
    seen = entities.select("id", (F.col("repo_visibility") == "public").alias("open"))
    a, b = seen.select(F.col("id").alias("from"), F.col("open").alias("from_open")), seen.select(F.col("id").alias("to"), F.col("open").alias("to_open"))
    out = edges.join(a, "from", "left").join(b, "to", "left")
    return out.withColumn("both_public", F.coalesce(F.col("from_open") & F.col("to_open"), F.lit(False))).drop("from_open", "to_open")


def redact(edges: DataFrame, entities: DataFrame, private_inclusive: bool = False) -> DataFrame:
    """Edges with an end that is not public keep their ends, kind and rule; what else they say is taken out.

    It is the one place where published edges are made. An artifact that includes private ones is left whole."""
    if private_inclusive:
        return edges
    told = endpoint_visibility(edges, entities)
    for name in [*_DETAIL, "resolves_via"]:
        told = told.withColumn(name, F.when(F.col("both_public"), F.col(name)))
    told = told.withColumn("evidence", F.when(F.col("both_public"), F.col("evidence")).otherwise(F.col("evidence").withField("path", F.lit(None).cast("string"))))
    return told.withColumn("redacted", ~F.col("both_public")).select(edges.columns)


def privacy_violations(edges: DataFrame, weak_edges: DataFrame, entities: DataFrame) -> DataFrame:
    """message of everything that is disclosed about a repository that is not public."""
    every = edges.unionByName(weak_edges)
    shut = endpoint_visibility(every, entities).where("not both_public")
    named = F.concat(F.col("from"), F.lit(" -> "), F.col("to"), F.lit(" ("), F.col("kind"), F.lit(")"))
    fields = [F.when(F.col(n).isNotNull(), F.concat(named, F.lit(f" discloses {n}: "), json_string(F.col(n)))) for n in _DETAIL]
    fields.append(F.when(F.col("evidence.path").isNotNull(), F.concat(named, F.lit(" discloses evidence.path: "), F.col("evidence.path"))))
    leaks = shut.select(F.explode(F.filter(F.array(*fields), lambda m: m.isNotNull())).alias("message"))
    claims = entities.where("repo_visibility <> 'public' and sources_read")
    return leaks.unionByName(claims.select(F.concat(F.col("id"), F.lit(" is "), F.col("repo_visibility"), F.lit(" but the lock claims its manifests were read")).alias("message")))


def strict_privacy_violations(edges: DataFrame, weak_edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Stricter than the gate: also an override's path, the matched coordinate, any locator, and a wrong redacted flag."""
    shut = endpoint_visibility(edges.unionByName(weak_edges), entities).where("not both_public")
    locators = ["table", "line", "input", "bundle", "wire", "metaKey"]
    found = [F.when(F.col(n).isNotNull(), F.lit(n)) for n in ("resolves_via", "matched")] + [F.when(F.col(f"evidence.{n}").isNotNull(), F.lit(f"evidence.{n}")) for n in locators] + [F.when(~F.col("redacted"), F.lit("redacted"))]
    return shut.select("from", "to", "kind", F.explode(F.filter(F.array(*found), lambda m: m.isNotNull())).alias("field"))


def group_edges(edges: DataFrame, side: str, order: list[str] | None = None) -> DataFrame:
    """By the project on a side (`to` or `from`): project, its sorted distinct kinds, and its edges in document order.

    order: the columns that give the document's order. Groups are ordered as in a dictionary, blind to case at first."""
    order = order or ["from", "to", "kind", "resolved_by"]
    inner = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*edges.columns).alias("edge"))))
    grouped = edges.groupBy(F.col(side).alias("project")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.transform(inner, lambda x: x["edge"]).alias("edges"))
    return grouped.orderBy(F.expr("project COLLATE UNICODE"), "project")


def dependencies_of(edges: DataFrame, slug: str) -> DataFrame:
    return group_edges(edges.where(F.col("from") == slug), "to")


def dependents_of(edges: DataFrame, slug: str) -> DataFrame:
    return group_edges(edges.where(F.col("to") == slug), "from")


def couplings(edges: DataFrame, side: str, other: str) -> DataFrame:
    """For each entity on a side: an array of (project, kinds), projects in order. One pass for all entities."""
    pairs = edges.groupBy(F.col(side).alias("id"), F.col(other).alias("project")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("project", "kinds"))).alias("couplings"))


def weak_for(weak_edges: DataFrame, slug: str) -> DataFrame:
    return weak_edges.where((F.col("from") == slug) | (F.col("to") == slug))


def unresolved_for(unresolved: DataFrame, slug: str) -> DataFrame:
    return unresolved.where(F.col("from") == slug)


def _confidence(edges: DataFrame, resolution: DataFrame) -> DataFrame:
    return edges.join(F.broadcast(resolution.select(F.col("rule").alias("resolved_by"), F.col("confidence").alias("stated"))), "resolved_by", "left")  # a vocabulary: as long as there are rules


def slice_confidence(edges: DataFrame, resolution: DataFrame) -> DataFrame:
    """edges with the confidence of their rule; by-name where the rule is not in the document."""
    return _confidence(edges, resolution).withColumn("confidence", F.coalesce("stated", F.lit("by-name"))).drop("stated")


def drawn_confidence(edges: DataFrame, resolution: DataFrame) -> DataFrame:
    """edges with the confidence a line is drawn in: convention for anything that is not exact or by-name."""
    return _confidence(edges, resolution).withColumn("confidence", F.when(F.col("stated").isin("exact", "by-name"), F.col("stated")).otherwise("convention")).drop("stated")


def cited_rules(edges: DataFrame, weak_edges: DataFrame, slug: str, resolution: DataFrame) -> DataFrame:
    """The rules that a slice's edges cite."""
    mine = edges.where((F.col("from") == slug) | (F.col("to") == slug)).unionByName(weak_for(weak_edges, slug))
    return resolution.join(mine.select(F.col("resolved_by").alias("rule")).distinct(), "rule", "left_semi")


def drawable(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges between two different entities of the map."""
    ids = entities.select("id")
    out = edges.where("`from` <> `to`").join(ids.withColumnRenamed("id", "from"), "from", "left_semi")
    return out.join(ids.withColumnRenamed("id", "to"), "to", "left_semi")


def one_line_each(edges: DataFrame) -> DataFrame:
    """The first edge of each (from, to, kind) in drawing order: by the three run together, then by rule."""
    rest = [c for c in edges.columns if c not in ("from", "to", "kind")]
    first = F.min_by(F.struct(*rest), F.struct("resolved_by", F.col("evidence.path")))
    return edges.groupBy("from", "to", "kind").agg(first.alias("e")).select("from", "to", "kind", "e.*", F.concat("from", "to", "kind").alias("draw_key"))


def weak_only(weak_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """Weak edges that no asserted edge repeats."""
    return weak_edges.join(edges.select("from", "to", "kind").distinct(), ["from", "to", "kind"], "left_anti")


def dangling(edges: DataFrame, edge_kinds: DataFrame, resolution: DataFrame) -> DataFrame:
    """Edges whose kind is not described (edge_kinds: kind) or whose rule is not declared: which, and the value."""
    kinds = edges.select("kind").join(edge_kinds.select("kind"), "kind", "left_anti").select(F.lit("kind").alias("field"), F.col("kind").alias("value"))
    rules = edges.select(F.col("resolved_by").alias("rule")).join(resolution.select("rule"), "rule", "left_anti").select(F.lit("resolved_by").alias("field"), F.col("rule").alias("value"))
    return kinds.unionByName(rules)


def first_difference(expected: Column, actual: Column) -> Column:
    """struct(line, context) of the first line in which two texts differ; null if none does. Three lines stand before it."""
    both = F.struct(F.split(expected, "\n", -1).alias("a"), F.split(actual, "\n", -1).alias("b"))

    def told(texts: Column) -> Column:
        a, b = texts["a"], texts["b"]
        # Texts of unlike length differ behind the shorter one's end, if not before: zipping fills it with nulls.
        at = F.array_position(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: ~z["x"].eqNullSafe(z["y"])), F.lit(True)).cast("int")
        return F.struct(a.alias("a"), b.alias("b"), at.alias("at"))

    def shown(t: Column) -> Column:
        a, b, at = t["a"], t["b"], t["at"]
        before = F.transform(F.slice(a, F.greatest(at - 3, F.lit(1)), F.least(at - 1, F.lit(3))), lambda x: F.concat(F.lit("  "), x))
        end = F.lit("<end of file>")
        last = F.array(F.concat(F.lit("- expected:  "), F.coalesce(F.get(a, at - 1), end)), F.concat(F.lit("+ committed: "), F.coalesce(F.get(b, at - 1), end)))
        return F.when(at > 0, F.struct(at.alias("line"), F.array_join(F.concat(before, last), "\n").alias("context")))

    return bound(bound(both, told), shown)
