"""Declared coordinates to repositories: equi-joins only.

A longest-prefix match is an equi-join too: a module path is exploded into its
prefixes at slashes, and the longest that is owned wins. First-match rules are
decided by an explicit order of claims, so equal inputs give equal results however
they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from ..schemas import RESOLUTION
from ..sources.store import written


def first_claims(ownership: DataFrame, order: list[str] | None = None) -> DataFrame:
    """For each (kind, coordinate) the first claim's repository, and whether any claim is contested."""
    by = F.struct(*(order or ["repo", "where"]))
    return ownership.groupBy("kind", "coordinate").agg(F.min_by("repo", by).alias("repo"), F.bool_or("contested").alias("contested"), F.min_by("contested", by).alias("first_contested"))


def resolve_exact(wants: DataFrame, ownership: DataFrame, order: list[str] | None = None) -> DataFrame:
    """wants (kind, coordinate, ...) with repo, matched and contested; null and false where no claim is."""
    claims = first_claims(ownership, order).select("kind", "coordinate", "repo", "contested")
    out = wants.join(claims, ["kind", "coordinate"], "left")
    return out.withColumn("matched", F.when(F.col("repo").isNotNull(), F.col("coordinate"))).withColumn("contested", F.coalesce("contested", F.lit(False)))


def prefixes(path: Column) -> Column:
    """The path and all its prefixes that end before a slash."""
    return bound(F.split(path, "/"), lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def resolve_prefix(wants: DataFrame, ownership: DataFrame, kind: str = "go-module-path", order: list[str] | None = None) -> DataFrame:
    """Distinct coordinates of wants of the kind, with the longest owned prefix: coordinate, repo, matched, contested.

    Each distinct coordinate is looked up once, however many declare it."""
    distinct = wants.where(F.col("kind") == kind).select("coordinate").distinct()
    claims = first_claims(ownership.where(F.col("kind") == kind), order).select(F.col("coordinate").alias("prefix"), "repo", F.col("first_contested").alias("contested"))
    hits = distinct.select("coordinate", F.explode(prefixes(F.col("coordinate"))).alias("prefix")).join(claims, "prefix")
    best = F.max_by(F.struct("repo", F.col("prefix").alias("matched"), "contested"), F.length("prefix"))
    return hits.groupBy("coordinate").agg(best.alias("b")).select("coordinate", "b.*")


def resolve_against(wants: DataFrame, ownership: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Exact first; what is left of module paths by longest prefix."""
    exact = resolve_exact(wants, ownership, order)
    deep = resolve_prefix(exact.where("repo is null"), ownership, order=order).select("coordinate", F.lit("go-module-path").alias("kind"), *[F.col(n).alias(f"p_{n}") for n in ("repo", "matched", "contested")])
    out = exact.join(deep, ["kind", "coordinate"], "left")
    pick = [F.coalesce("repo", "p_repo").alias("repo"), F.coalesce("matched", "p_matched").alias("matched"), F.when(F.col("repo").isNotNull(), F.col("contested")).otherwise(F.coalesce("p_contested", F.lit(False))).alias("contested")]
    return out.select(*[c for c in exact.columns if c not in ("repo", "matched", "contested")], *pick)


def resolve_url(wants: DataFrame, repos: DataFrame) -> DataFrame:
    """wants (want, ...) whose coordinate is owner/repo, with the roster's slug as repo; no index is consulted."""
    known = repos.groupBy(F.lower("github").alias("key")).agg(F.min("slug").alias("repo"))
    return wants.join(known, F.lower(wants["want"]) == known["key"], "left").drop("key")


def resolve_name(wants: DataFrame, repos: DataFrame) -> DataFrame:
    """wants with the repository of which the coordinate's last segment is the slug or the name."""
    names = repos.select(F.col("slug").alias("key"), F.col("slug").alias("repo"), F.lit(0).alias("r")).unionByName(repos.select(F.element_at(F.split("github", "/"), -1).alias("key"), F.col("slug").alias("repo"), F.lit(1).alias("r")))
    first = names.groupBy("key").agg(F.min_by("repo", F.struct("r", "repo")).alias("repo"))
    return wants.withColumn("key", F.element_at(F.split("want", "/"), -1)).join(first, "key", "left").drop("key")


#: Cells that the dispatchers of an event are dealt into, and tasks that all cells are dealt to.
CELLS, CELL_TASKS = 32, 128


def resolve_events(listens: DataFrame, dispatches: DataFrame, repos: DataFrame) -> DataFrame:
    """listens (from, want: the event, ...) with each repository that dispatches the event as `to`.

    The edge runs from the listener to the dispatcher. A dispatch that names its target counts for that
    target only; one to a target not known at read time counts for every listener, as a convention."""
    sent = dispatches.select(F.col("repo").alias("to"), F.col("d.event").alias("event"), F.lower(F.concat_ws("/", "d.owner", "d.repo")).alias("target"), F.col("d.owner").isNotNull().alias("named"))
    me = repos.select(F.col("slug").alias("from"), F.lower("github").alias("self"))
    # A listener's own address rides along, so both kinds of dispatch are equi-joins.
    who = listens.join(me, "from", "left")
    named = who.join(sent.where("named").select("to", F.col("event").alias("want"), F.col("target").alias("self")).distinct(), ["want", "self"]).withColumn("rule", F.lit("dispatch-target"))
    # Events are few and pairs are many: the dispatchers of an event are dealt into cells, and every cell meets all its listeners in a task of its own.
    unnamed = sent.where("not named").select("to", F.col("event").alias("want")).distinct().withColumn("cell", F.pmod(F.xxhash64("to"), F.lit(CELLS)).cast("int"))
    spread = lambda df: df.repartition(CELL_TASKS, "want", "cell")  # noqa: E731  # a given number, as sizes say nothing of the pairs
    cells = F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell")
    loose = spread(who.select("*", cells)).join(spread(unnamed), ["want", "cell"]).drop("cell").withColumn("rule", F.lit("dispatch-event"))
    return named.unionByName(loose).where(F.col("to") != F.col("from")).drop("self")


_CONFIDENCE = {rule: confidence for rule, confidence, _ in RESOLUTION}


def resolve_all(declared: DataFrame, ownership: DataFrame, facts: dict[str, DataFrame], repos: DataFrame) -> DataFrame:
    """Declarations with to, matched and the rule that identified the target; `to` is null where none did.

    ownership has the executables' claims too. Each rule reads both tables anew, so they are written first."""
    declared, ownership = written(declared), written(ownership)
    index_rules = ["crate-name", "go-module-path", "npm-package-name", "mcp-server-name", "oci-identifier", "executable-name"]
    keep = [c for c in declared.columns if c != "rule"]
    by_index = declared.where(F.col("rule").isin(index_rules)).withColumnsRenamed({"rule": "kind0"})
    wants = by_index.withColumnsRenamed({"kind": "edge_kind", "kind0": "kind"}).withColumn("coordinate", F.col("want"))
    found = resolve_against(wants, ownership).withColumnRenamed("repo", "to")
    found = found.withColumnsRenamed({"kind": "rule", "edge_kind": "kind"})
    # Names come after the index: images and tools that nothing in the index claims.
    missed = found.where(F.col("to").isNull() & F.col("rule").isin("oci-identifier", "executable-name")).drop("to", "matched", "contested", "coordinate")
    named = resolve_name(missed, repos).withColumnRenamed("repo", "to")
    named = named.withColumn("rule", F.when(F.col("to").isNull(), F.col("rule")).when(F.col("rule") == "oci-identifier", "image-name").otherwise("tool-name")).withColumn("matched", F.when(F.col("to").isNotNull(), F.col("to")))
    rest = found.where(F.col("to").isNotNull() | ~F.col("rule").isin("oci-identifier", "executable-name")).drop("contested", "coordinate")
    cols = [*keep, "rule", "to", "matched"]
    null = F.lit(None).cast("string")
    urls = resolve_url(declared.where(F.col("rule").isin("git-url", "github-ref", "release-url")), repos).withColumnRenamed("repo", "to").withColumn("matched", null)
    wires = resolve_name(declared.where("rule = 'bundle-name'"), repos).withColumnRenamed("repo", "to").withColumn("matched", F.col("to"))
    out = [rest.select(cols), named.select(cols), urls.select(cols), wires.select(cols)]
    tenancy = declared.where("rule = 'tenancy-key'")
    if "cluster-toml" in facts:
        host = facts["cluster-toml"].agg(F.min("repo").alias("to"))  # the first repository, by name, with a cluster file
        out.append(tenancy.crossJoin(F.broadcast(host)).withColumn("matched", null).select(cols))
    else:
        out.append(tenancy.withColumn("to", null).withColumn("matched", null).select(cols))
    listens = declared.where("rule = 'dispatch-target'")
    if "workflow" in facts:
        sent = facts["workflow"].select("repo", F.explode("facts.dispatches").alias("d"))
        heard = resolve_events(listens.drop("rule"), sent, repos).withColumn("matched", null)
        silent = listens.join(heard.select("from", "want").distinct(), ["from", "want"], "left_anti").withColumn("to", null).withColumn("matched", null)
        out += [heard.select(cols), silent.select(cols)]
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def to_edges(resolved: DataFrame) -> DataFrame:
    """Resolved declarations between two repositories as edges, not yet redacted; a repository's own are none."""
    return resolved.where("to is not null and `from` <> `to`").select(
        "from", "to", "kind", F.col("rule").alias("resolved_by"), "matched", "resolves_from", "resolves_via", "detail", "version", "rev", F.lit(False).alias("redacted"), "evidence"
    )


def is_exact(rule: Column) -> Column:
    return rule.isin([r for r, c in _CONFIDENCE.items() if c == "exact"])


def owner_of(rule: Column, want: Column) -> Column:
    """The owner that a coordinate names, in lower case; null if it names none."""
    owner = (
        F.when(rule == "go-module-path", F.regexp_extract(want, r"^github\.com/([^/]+)/", 1))
        .when(rule == "npm-package-name", F.regexp_extract(want, r"^@([^/]+)/", 1))
        .when(rule == "oci-identifier", F.regexp_extract(want, r"^[^/]+/([^/]+)/", 1))
        .when(rule.isin("git-url", "github-ref", "release-url"), F.regexp_extract(want, r"^([^/:]+)/[^/]+$", 1))
    )
    return F.nullif(F.lower(owner), F.lit(""))


def unlisted(rule: Column) -> Column:
    """Whether the rule's coordinates belong to no public registry."""
    return rule.isin("mcp-server-name", "executable-name", "bundle-name", "tenancy-key", "dispatch-target")


def scoped(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """rows (rule, want, ...) with in_scope: whether a coordinate that leads nowhere is a gap of the map.

    It is one if it names an owner of the roster, or belongs to no public registry; all others are third parties' and
    are counted only."""
    owners = repos.select(F.lower(F.substring_index("github", "/", 1)).alias("owner"), F.lit(True).alias("ours")).where("owner <> ''").distinct()
    told = rows.withColumn("owner", owner_of(F.col("rule"), F.col("want"))).join(owners, "owner", "left")
    return told.withColumn("in_scope", unlisted(F.col("rule")) | F.coalesce("ours", F.lit(False))).drop("owner", "ours")


def unresolved(resolved: DataFrame, repos: DataFrame) -> DataFrame:
    """from, want, via (the rule that was tried), reason."""
    gaps = scoped(resolved.where("to is null"), repos).where("in_scope")
    reason = (
        F.when(F.col("rule") == "dispatch-target", "no workflow dispatches this event to it")
        .when(F.col("rule").isin("git-url", "github-ref", "release-url"), "no repository of this address is on the roster")
        .when(F.col("rule") == "tenancy-key", "no repository has a cluster file")
        .otherwise("no repository declares to publish it")
    )
    return gaps.select("from", "want", F.col("rule").alias("via"), reason.alias("reason")).distinct()
