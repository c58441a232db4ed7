"""Where manifests come from: checkouts on a file system, prefetched listings, a published index, a roster.

There is no live HTTP connector: a listing that was fetched is a dataset of
(repo, status, path, type, sha, truncated), and everything after it is the same.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import classify, dir_names, expand_home
from ..functions.text import git_blob_sha
from ..schemas import MAX_DEPTH, SKIP_DIRS, struct

#: Headers of an anonymous listing request; there is never an authorisation among them.
API_HEADERS = {"Accept": "application/vnd.github+json", "X-GitHub-Api-Version": "2022-11-28"}


def api_headers(user_agent: str = "graphloom") -> dict[str, str]:
    return API_HEADERS | {"User-Agent": user_agent}


def is_walked(path: Column) -> Column:
    """Whether a walk of a checkout reaches the file: no skipped or dot-directory on the way but .github and
    .github/workflows themselves, and not deeper than one level past the depth that is searched."""
    dirs = dir_names(path)
    place = F.array_join(dirs, "/")
    open_way = ~F.exists(dirs, lambda d: d.isin(SKIP_DIRS) | d.startswith("."))
    return (open_way & (F.size(dirs) <= MAX_DEPTH + 1)) | place.isin(".github", ".github/workflows")


def walk_checkout(root: str) -> list[str]:
    """Relative paths of a checkout's files, in order. What cannot be listed is passed over; links are not files."""
    found = []
    for top, dirs, names in os.walk(root):
        rel = os.path.relpath(top, root).replace(os.sep, "/")
        at = "" if rel == "." else rel + "/"
        deep = 0 if rel == "." else rel.count("/") + 1
        ours = (".github", ".github/workflows")
        dirs[:] = sorted(d for d in dirs if deep <= MAX_DEPTH and (at + d in ours or not (d in SKIP_DIRS or d.startswith("."))) and not os.path.islink(os.path.join(top, d)))
        found += [at + n for n in names if os.path.isfile(os.path.join(top, n)) and not os.path.islink(os.path.join(top, n))]
    return sorted(found)


def read_checkouts(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """repo, path, content of the walked files of checkouts on the driver's disk, by repository.

    Only manifests are read; other files have a null content, and so has a manifest that cannot be read. (Spark's
    own file listing passes over dot-files, and version pins and workflows are such.) Repositories by the million come
    as a table of manifests instead."""
    paths = [(repo, p) for repo, root in sorted(roots.items()) for p in walk_checkout(root)]
    files = spark.createDataFrame(paths, "repo string, path string")
    bodies = []
    for repo, path in files.where(classify(F.col("path")).isNotNull()).collect():
        try:
            with open(os.path.join(roots[repo], path), "rb") as f:
                bodies.append((repo, path, bytearray(f.read())))
        except OSError:
            continue
    return files.join(spark.createDataFrame(bodies, struct("manifest")), ["repo", "path"], "left")


def with_blob(files: DataFrame) -> DataFrame:
    """files (repo, path, content) with the git id of the very bytes that are parsed."""
    return files.withColumn("blob", git_blob_sha(F.col("content")))


def blob_lookup(files: DataFrame, listing: DataFrame) -> DataFrame:
    """files (repo, path) with the listing's sha as blob; null where the listing has none."""
    return files.join(listing.select("repo", "path", F.col("sha").alias("blob")), ["repo", "path"], "left")


def visibility(status: Column) -> Column:
    """public or restricted from the anonymous probe's status; any other failure raises."""
    failed = F.raise_error(F.concat(F.lit("listing failed with status "), status.cast("string"))).cast("string")
    return F.when(status == 404, "restricted").when(status.between(200, 299), "public").otherwise(failed)


def remote_listing(tree: DataFrame) -> DataFrame:
    """repo, path, sha, truncated of the files (blobs) of a prefetched tree listing."""
    return tree.where("type = 'blob'").select("repo", "path", "sha", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def decode_contents(rows: DataFrame) -> DataFrame:
    """repo, path, content from base64 bodies of a contents listing; a body that is no text raises."""
    body = F.coalesce(F.col("body"), F.raise_error(F.lit("a body without content")).cast("string"))
    return rows.select("repo", "path", F.unbase64(F.regexp_replace(body, r"\s", "")).alias("content"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The ownership index of a published map; a document without one raises."""
    doc = spark.read.option("multiLine", True).option("wholetext", True).text(path)
    parsed = doc.select(F.parse_json("value").alias("v"))
    rows = F.try_variant_get("v", "$.ownership", "array<variant>")
    rows = F.when(rows.isNull(), F.raise_error(F.lit("no ownership index in the document")).cast("array<variant>")).otherwise(rows)
    one = lambda name, kind: F.try_variant_get("o", f"$.{name}", kind).alias(name)
    listed = parsed.select(F.posexplode(rows).alias("ord", "o"), F.try_variant_get("v", "$.schema_version", "int").alias("schema_version"))
    return listed.select("ord", "schema_version", one("coordinate", "string"), one("kind", "string"), one("repo", "string"), one("where", "string"), one("contested", "boolean"))


def resolve_checkouts(roster: DataFrame, roots: list[str], existing: DataFrame, home: str = "/root") -> DataFrame:
    """The roster with each entry's first existing checkout: its slug under all roots in order, then its repository's name.

    existing (path): directories that hold a .git."""
    spark = roster.sparkSession
    ranked = spark.createDataFrame(list(enumerate(roots)), "root_rank int, root string").withColumn("root", expand_home(F.col("root"), home))
    names = roster.select("slug", F.explode(F.array(F.struct(F.lit(0).alias("r"), F.col("slug").alias("n")), F.struct(F.lit(1).alias("r"), F.col("repo").alias("n")))).alias("name"))
    tried = names.crossJoin(F.broadcast(ranked)).select("slug", "name.r", "root_rank", F.concat_ws("/", F.regexp_replace("root", "/+$", ""), "name.n").alias("path"))
    first = tried.join(existing.select("path").distinct(), "path", "left_semi").groupBy("slug").agg(F.min_by("path", F.struct("r", "root_rank")).alias("found"))
    return roster.drop("checkout").join(first, "slug", "left").withColumnRenamed("found", "checkout").orderBy("slug")
