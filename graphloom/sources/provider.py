"""Repositories as a data source: one partition a repository, and what is in it is read by the task.

A provider lists a repository's files, tells the git id of one, and reads one. Three are here: a
checkout; answers of a listing that were fetched before, with plain bodies; and such answers with
bodies in base64, as a credential gets them. Another one is a class with the same three methods,
named as "module:Class".

    spark.dataSource.register(RepositorySource)
    spark.read.format("repositories").option("path", folder).option("kind", "checkout").load()

gives repo, path, blob, truncated, content of every file: blob and content only of manifests, and
no content of those that cannot be read. The folder holds one folder for each repository and is on a
file system that the driver and all tasks see; the driver lists its names and opens nothing.
"""

from __future__ import annotations

import base64
import hashlib
import importlib
import json
import os
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import classify
from .listing import walk_checkout

SCHEMA = "repo string, path string, blob string, truncated boolean, content binary"


def local_path(folder: str) -> str:
    """A file system's path of a folder; of another scheme it is none."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"a folder of repositories must be on a file system that all tasks see: {folder}")
    return folder.removeprefix("file://")


class Checkout:
    """A repository's working tree."""

    def __init__(self, folder: str):
        self.folder = folder

    def list_paths(self) -> tuple[list[str], bool]:
        return walk_checkout(self.folder), False

    def read(self, path: str) -> bytes:
        with open(os.path.join(self.folder, path), "rb") as f:
            return f.read()

    def blob_sha(self, path: str) -> str | None:
        try:
            body = self.read(path)
        except OSError:
            return None
        return hashlib.sha1(b"blob %d\0" % len(body) + body).hexdigest()


class Prefetched:
    """Answers that were fetched before: tree.json, and a file for each body under its encoded path."""

    def __init__(self, folder: str):
        self.folder = folder
        with open(os.path.join(folder, "tree.json"), encoding="utf-8") as f:
            answer = json.load(f)
        status = answer.get("status", 200)
        if not 200 <= status <= 299:
            raise OSError(f"listing failed with status {status}")
        self.truncated = bool(answer.get("truncated"))
        self.blobs = {n["path"]: n.get("sha") for n in answer.get("tree") or [] if n.get("type") == "blob"}

    def list_paths(self) -> tuple[list[str], bool]:
        return sorted(self.blobs), self.truncated

    def blob_sha(self, path: str) -> str | None:
        return self.blobs.get(path)

    def read(self, path: str) -> bytes:
        with open(os.path.join(self.folder, "bodies", quote(path, safe="")), "rb") as f:
            return f.read()


class Contents(Prefetched):
    """The same with bodies as answers of the contents request."""

    def read(self, path: str) -> bytes:
        content = json.loads(super().read(path)).get("content")
        if not isinstance(content, str):
            raise OSError("a body without content")
        return base64.b64decode(content)


KINDS = {"checkout": Checkout, "prefetched": Prefetched, "contents": Contents}
_MANIFESTS = frozenset("Cargo.toml go.mod package.json server.json cluster.toml cluster.lock.toml Taskfile.yml".split())


def provider_of(kind: str):
    if ":" not in kind:
        return KINDS[kind]
    module, name = kind.split(":")
    return getattr(importlib.import_module(module), name)


def may_be_read(path: str) -> bool:
    """Whether a path may be a manifest; which ones are is decided by functions.paths.classify."""
    base = path.rsplit("/", 1)[-1]
    return base in _MANIFESTS or base.endswith("-version") or path.startswith(".github/workflows/")


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.kind = local_path(options["path"]), options.get("kind", "checkout")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in sorted(os.listdir(self.folder)) if not name.startswith("_")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name = partition.value
        source = provider_of(self.kind)(os.path.join(self.folder, name))
        paths, truncated = source.list_paths()
        for path in paths:
            blob = body = None
            if may_be_read(path):
                try:
                    body = source.read(path)
                    blob = source.blob_sha(path)
                except OSError:
                    body = None
            yield unquote(name), path, blob, truncated, body


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repositories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader(dict(self.options))


def read_repositories(spark: SparkSession, folder: str, kind: str = "checkout") -> DataFrame:
    """repo, path, blob, truncated, content of a folder of repositories; blob and content of manifests only."""
    spark.dataSource.register(RepositorySource)
    rows = spark.read.format("repositories").option("path", folder).option("kind", kind).load()
    ours = classify(F.col("path")).isNotNull()
    return rows.select("repo", "path", F.when(ours, F.col("blob")).alias("blob"), "truncated", F.when(ours, F.col("content")).alias("content"))


def write_repositories(files: DataFrame, folder: str, kind: str = "checkout") -> None:
    """files (repo, path, content) as a folder that read_repositories reads. A repository's files go through one task, one at a time."""
    base = local_path(folder)

    def put(path: str, body: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + ".part", "wb") as f:
            f.write(body)
        os.replace(path + ".part", path)  # a task that is tried again leaves the same file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, []
        for batch in batches:
            for repo, path, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if repo != now:
                    finish(now, tree)
                    now, tree = repo, []
                at = os.path.join(base, quote(repo, safe=""))
                if kind == "checkout":
                    put(os.path.join(at, path), body)
                    continue
                tree.append({"path": path, "type": "blob", "sha": hashlib.sha1(b"blob %d\0" % len(body) + body).hexdigest()})
                told = json.dumps({"content": base64.encodebytes(body).decode()}).encode() if kind == "contents" else body
                put(os.path.join(at, "bodies", quote(path, safe="")), told)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])
        finish(now, tree)

    def finish(repo: str | None, tree: list[dict]) -> None:
        if repo is not None and kind != "checkout":
            put(os.path.join(base, quote(repo, safe=""), "tree.json"), json.dumps({"status": 200, "tree": tree, "truncated": False}).encode())

    dealt = files.select("repo", "path", F.col("content").cast("binary").alias("content")).repartition("repo").sortWithinPartitions("repo", "path")
    dealt.mapInArrow(run, "files long").agg(F.sum("files")).collect()  # one number
