"""Predicates and labels of repository paths, roster strings and roots, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MAX_DEPTH, RECURSIVE_MANIFESTS, ROOT_MANIFESTS, SKIP_DIRS, UNPARSED

PIN = r"^\.[a-z0-9][a-z0-9-]*-version$"
WORKFLOW = r"^\.github/workflows/[^/\n]+\.ya?ml$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_names(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def closed_off(path: Column) -> Column:
    """Whether a directory on the way is never searched: a skipped name or a dot-directory."""
    return F.exists(dir_names(path), lambda d: d.isin(SKIP_DIRS) | d.startswith("."))


def _named(base: Column, names: dict[str, str]) -> Column:
    return reduce(lambda c, kv: c.when(base == kv[0], kv[1]), list(names.items())[1:], F.when(base == next(iter(names)), next(iter(names.values()))))


def classify(path: Column) -> Column:
    """The manifest format of a path, or null. The first rule that applies decides."""
    base = base_name(path)
    at_root = F.coalesce(_named(base, ROOT_MANIFESTS), F.when(base.rlike(PIN), "version-pin"))
    open_way = ~closed_off(path) & (depth(path) <= MAX_DEPTH)
    return F.when(path.rlike(WORKFLOW), "workflow").when(open_way, F.coalesce(_named(base, RECURSIVE_MANIFESTS), F.when(depth(path) == 0, at_root)))


def is_unexamined(path: Column) -> Column:
    """A root file of a format that is known to declare couplings and has no parser."""
    return path.isin(UNPARSED) & classify(path).isNull()


def is_capped(path: Column) -> Column:
    """A manifest that lies too deep to be read, on a way that is open."""
    return base_name(path).isin(list(RECURSIVE_MANIFESTS)) & (depth(path) > MAX_DEPTH) & ~closed_off(path)


def dir_path(path: Column) -> Column:
    return F.array_join(dir_names(path), "/")


def select_manifests(files: DataFrame) -> DataFrame:
    """repo, path and format of the files (repo, path) that are read."""
    return files.select("repo", "path", classify(F.col("path")).alias("format")).where("format is not null")


def unexamined_by_repo(files: DataFrame) -> DataFrame:
    return files.where(is_unexamined(F.col("path"))).groupBy("repo").agg(F.array_sort(F.collect_set("path")).alias("unexamined"))


def capped_dirs(files: DataFrame) -> DataFrame:
    """repo and dir: where manifests lie below the depth that is searched."""
    return files.where(is_capped(F.col("path"))).select("repo", dir_path(F.col("path")).alias("dir")).distinct()


def is_local_replacement(target: Column) -> Column:
    return target.startswith("./") | target.startswith("../") | target.startswith("/") | target.rlike(r"^[A-Za-z]:[\\/]")


def parse_roots(value: Column) -> Column:
    """The non-empty trimmed parts of a PATH-like string; empty for null."""
    return F.coalesce(F.filter(F.transform(F.split(value, ":"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def expand_home(path: Column, home: str) -> Column:
    """A leading ~/ stands for the home directory."""
    return F.when(path.startswith("~/"), F.concat(F.lit(home.rstrip("/") + "/"), F.substr(path, F.lit(3)))).otherwise(path)


def entry_from_github(github: Column, slug: Column | None = None, on_map: Column | None = None) -> Column:
    """A roster entry from owner/repo; anything else raises."""
    parts = F.split(github, "/")
    good = (F.size(parts) == 2) & (parts[0] != "") & (parts[1] != "")
    bad = F.raise_error(F.concat(F.lit('roster entry must be "owner/repo", got '), F.to_json(F.struct(github.alias("github"))))).cast("string")
    owner = F.when(good, parts[0]).otherwise(bad)
    name = F.get(parts, F.lit(1))
    return F.struct(
        F.coalesce(slug if slug is not None else F.lit(None).cast("string"), name).alias("slug"),
        owner.alias("owner"),
        name.alias("repo"),
        F.concat_ws("/", owner, name).alias("github"),
        F.coalesce(on_map if on_map is not None else F.lit(True), F.lit(True)).alias("on_map"),
        F.lit(None).cast("string").alias("checkout"),
    )


def escapes_root(manifest: Column, target: Column) -> Column:
    """Whether a relative target, from the manifest's directory, leads outside the repository. Absolute ones do."""
    steps = F.concat(dir_names(manifest), F.split(target, "/"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("low"))

    def walk(a: Column, s: Column) -> Column:
        at = F.when(s == "..", a["at"] - 1).when(s.isin("", "."), a["at"]).otherwise(a["at"] + 1)
        return F.struct(at.alias("at"), F.least(a["low"], at).alias("low"))

    return target.startswith("/") | target.rlike(r"^[A-Za-z]:[\\/]") | (F.aggregate(steps, start, walk)["low"] < 0)
