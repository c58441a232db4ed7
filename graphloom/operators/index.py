"""What repositories publish and what they declare: the two sides of the central join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import escapes_root
from ..functions.text import bound, full
from ..schemas import EVIDENCE, TENANCY_KEY

Facts = dict[str, DataFrame]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def publishes(facts: Facts, executables: bool = False) -> DataFrame:
    """repo, where, coordinate, kind of everything that manifests publish; with executables, launch commands too."""
    one = lambda fmt, what, kind: facts[fmt].select("repo", F.col("path").alias("where"), F.explode(what).alias("coordinate"), F.lit(kind).alias("kind"))
    null = F.lit(None).cast("string")
    parts = [f.limit(0).select("repo", F.col("path").alias("where"), null.alias("coordinate"), null.alias("kind")) for f in facts.values()][:1]
    if "cargo" in facts:
        parts.append(one("cargo", "facts.publishes", "crate-name"))
    if "gomod" in facts:
        parts.append(one("gomod", F.when(full(F.col("facts.module")), F.array("facts.module")), "go-module-path"))
    if "npm" in facts:
        parts.append(one("npm", "facts.publishes", "npm-package-name"))
    if "server-json" in facts:
        parts.append(one("server-json", F.when(full(F.col("facts.name")), F.array("facts.name")), "mcp-server-name"))
        parts.append(one("server-json", F.filter("facts.packages.identifier", full), "oci-identifier"))
        if executables:
            parts.append(one("server-json", F.array_distinct(F.transform("facts.commands", lambda c: F.element_at(F.split(c["command"], "/"), -1))), "executable-name"))
    return _union(parts)


def build_ownership(claims: DataFrame) -> DataFrame:
    """claims (repo, where, coordinate, kind) with `contested`: whether another repository claims the same coordinate of the kind.

    Whether two repositories claim a coordinate is min <> max, which is aggregated before the shuffle: no set is
    gathered, and a coordinate that a third of all repositories claim is one row of the side that is joined back."""
    several = claims.groupBy("kind", "coordinate").agg((F.min("repo") != F.max("repo")).alias("contested"))
    return claims.join(several, ["kind", "coordinate"]).select("coordinate", "kind", "repo", "where", "contested")


_LOCATORS = ["table", "line", "input", "bundle", "wire", "metaKey"]
_COLUMNS = ["from", "want", "rule", "kind", "detail", "version", "rev", "resolves_from", "resolves_via", "evidence"]


def _declare(df: DataFrame, rule: str, kind: str, want: Column, fmt: str, detail: Column | None = None, version: Column | None = None, rev: Column | None = None, source: Column | None = None, via: Column | None = None, **where: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    at = {n: where.get(n, F.lit(None)) for n in _LOCATORS}
    evidence = F.struct(F.col("repo").alias("repo"), F.col("path").alias("path"), F.lit(fmt).alias("format"), *[c.alias(n) for n, c in at.items()]).cast(EVIDENCE)
    values = {
        "from": F.col("repo"),
        "want": want,
        "rule": F.lit(rule),
        "kind": F.lit(kind),
        "detail": want if detail is None else detail,
        "version": null if version is None else version,
        "rev": null if rev is None else rev,
        "resolves_from": F.lit("published") if source is None else source,
        "resolves_via": null if via is None else via,
        "evidence": evidence,
    }
    return df.select(*[values[n].cast("string").alias(n) if n != "evidence" else evidence.alias(n) for n in _COLUMNS])


def _from_path(path: Column, manifest: Column) -> Column:
    return F.when(path.isNull(), "published").when(escapes_root(manifest, path), "path-outside-repo").otherwise("path-in-repo")


GITHUB_URL = r"github\.com[:/]([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+?)(?:\.git)?(?:[/#?].*)?$"


def github_of(url: Column) -> Column:
    """owner/repo of a repository's URL; null for another host's."""
    return F.nullif(F.regexp_extract(url, GITHUB_URL, 1), F.lit(""))


def declarations(facts: Facts) -> DataFrame:
    """Everything that manifests declare to depend on, one row for each declaration.

    from, want (the coordinate), rule (how it is looked up first), kind (of edge), detail, version, rev,
    resolves_from, resolves_via and evidence. Indirect module requirements are no declarations of their own."""
    parts = []
    each = lambda fmt, what: facts[fmt].select("repo", "path", F.explode(what).alias("d"), "facts")
    c = F.col
    if "cargo" in facts:
        d = each("cargo", "facts.deps")
        where = {"table": c("d.table"), "line": c("d.line")}
        override = {"source": _from_path(c("d.path"), c("path")), "via": c("d.path")}
        parts.append(_declare(d.where("d.git is null"), "crate-name", "library", F.coalesce("d.package", "d.name"), "cargo", version=c("d.version"), **override, **where))
        parts.append(_declare(d.where("d.git is not null"), "git-url", "library", F.coalesce(github_of(c("d.git")), "d.git"), "cargo", detail=c("d.git"), version=c("d.version"), rev=c("d.rev"), **override, **where))
    if "gomod" in facts:
        # The first local replacement of each path, as one map of the file.
        swaps = F.filter("facts.replaces", lambda r: r["local"])
        first = lambda rows: F.filter(rows, lambda r, i: (i == 0) | (F.get(rows, i - 1)["path"] != r["path"]))  # noqa: E731  # they are sorted by path and line
        swapped = bound(swaps, lambda rows: F.map_from_entries(F.transform(first(rows), lambda r: F.struct(r["path"], r["with"]))))
        direct = facts["gomod"].select("repo", "path", swapped.alias("swapped"), F.filter("facts.requires", lambda r: ~r["indirect"]).alias("direct"))
        d = direct.select("repo", "path", "swapped", F.explode("direct").alias("d"))
        local = F.try_element_at("swapped", "d.path")
        parts.append(_declare(d, "go-module-path", "library", c("d.path"), "gomod", version=c("d.version"), source=_from_path(local, c("path")), via=local, line=c("d.line")))
    if "npm" in facts:
        d = each("npm", "facts.deps")
        local = F.nullif(F.regexp_extract("d.spec", r"^(?:file|link|workspace):(.*)$", 1), F.lit(""))
        source = F.when(c("d.spec").startswith("workspace:"), "path-in-repo").when(c("d.spec").rlike("^(?:file|link):"), _from_path(F.coalesce(local, F.lit(".")), c("path"))).otherwise("published")
        parts.append(_declare(d, "npm-package-name", "library", c("d.name"), "npm", version=c("d.spec"), source=source, via=F.when(c("d.spec").rlike("^(?:file|link|workspace):"), local), table=c("d.table")))
    if "server-json" in facts:
        d = each("server-json", "facts.requiredDeps")
        parts.append(_declare(d, "mcp-server-name", "protocol", c("d.server"), "server-json", version=c("d.minimumVersion"), source=F.lit("unknown"), metaKey=c("d.metaKey")))
        parts.append(_declare(facts["server-json"].where("facts.declaresCloisterTenancy"), "tenancy-key", "tenancy", F.lit(TENANCY_KEY), "server-json", source=F.lit("unknown"), metaKey=F.lit(TENANCY_KEY)))
    if "cluster-toml" in facts:
        d = each("cluster-toml", F.filter("facts.inputs", lambda i: i["ref"].isNotNull()))
        parts.append(_declare(d, "github-ref", "composition", F.coalesce(F.concat_ws("/", F.nullif("d.owner", F.lit("")), "d.repo"), c("d.ref")), "cluster-toml", detail=c("d.ref"), version=c("d.version"), rev=c("d.rev"), input=c("d.key"), line=c("d.line")))
        b = each("cluster-toml", "facts.bundles")
        image = F.regexp_replace("d.image", r"(?:@[^/]*|:[^/:]*)$", "")
        parts.append(_declare(b.where("d.image is not null"), "oci-identifier", "artifact", image, "cluster-toml", detail=c("d.image"), bundle=c("d.name")))
        parts.append(_declare(b.where("d.entryPoint is not null"), "executable-name", "artifact", F.element_at(F.split("d.entryPoint", "/"), -1), "cluster-toml", detail=c("d.entryPoint"), bundle=c("d.name")))
        w = each("cluster-toml", F.filter("facts.wires", lambda x: x["to"].isNotNull()))
        parts.append(_declare(w, "bundle-name", "protocol", c("d.to"), "cluster-toml", detail=F.concat_ws(" -> ", "d.from", "d.to"), source=F.lit("unknown"), wire=c("d.binding")))
    if "cluster-lock" in facts:
        d = each("cluster-lock", F.filter("facts.inputs", lambda i: i["oci"]["identifier"].isNotNull()))
        parts.append(_declare(d, "oci-identifier", "artifact", c("d.oci.identifier"), "cluster-lock", version=c("d.oci.version"), rev=c("d.rev"), input=c("d.key")))
    if "version-pin" in facts:
        parts.append(_declare(facts["version-pin"], "executable-name", "artifact", c("facts.tool"), "version-pin", version=c("facts.version")))
    if "taskfile" in facts:
        d = each("taskfile", "facts.releaseRepos")
        parts.append(_declare(d, "release-url", "artifact", F.concat_ws("/", "d.owner", "d.repo"), "taskfile"))
    if "workflow" in facts:
        d = each("workflow", "facts.listensFor")
        parts.append(_declare(d, "dispatch-target", "event", c("d"), "workflow", source=F.lit("unknown")))
    return _union(parts)


def declaration_counts(declared: DataFrame) -> DataFrame:
    """parsed: declarations read; distinct: coordinates they name."""
    return declared.agg(F.count("*").alias("parsed"), F.count_distinct("want").alias("distinct"))


def requires(facts: Facts) -> DataFrame:
    """repo, where, coordinate, kind of what an inspection of one repository looks up: direct, and by coordinate only."""
    known = {k: facts[k] for k in ("cargo", "gomod", "npm", "server-json") if k in facts}
    rows = declarations(known).where(F.col("rule").isin("crate-name", "go-module-path", "npm-package-name", "mcp-server-name"))
    return rows.select(F.col("from").alias("repo"), F.col("evidence.path").alias("where"), F.col("want").alias("coordinate"), F.col("rule").alias("kind"))


def distinct_requires(rows: DataFrame) -> DataFrame:
    """One row for each (repo, kind, coordinate, where)."""
    return rows.distinct()
