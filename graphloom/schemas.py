"""Row types and vocabularies. Nothing here reads or computes anything.

The names of formats, tables, kinds and enumerated values are fixed values of the
document contract and of the file formats; they are listed as they stand there.
"""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1
SCHEMA_PATH = "/schema/v1/site-map.json"

# What edges mean. The enumeration of kinds is the keys, never restated.
EDGE_KINDS = {
    "library": "linked or imported at build time from a declared dependency",
    "artifact": "a pinned executable or image consumed at run time",
    "protocol": "an RPC or wire coupling between running processes",
    "composition": "a published file of the target, pinned at an exact commit",
    "tenancy": "declares itself mountable under the target's hosting contract",
    "event": "reacts to a repository_dispatch event the target sends",
}
RESERVED_EDGE_KINDS = {
    "schema": "data-at-rest schema shared through a stored artifact",
    "lineage": "derivation identity carried by content hashes across versions",
}

# Enumerations of the contract.
STATUS = ["experimental", "active", "stable", "dormant", "archived"]
LINK_LABELS = ["site", "source", "docs", "writing"]
AUTHORED_VISIBILITY = ["public", "mixed"]
RESOLVES_FROM = ["published", "path-in-repo", "path-outside-repo", "unknown"]
ENTITY_KINDS = ["project", "repository"]
REPO_VISIBILITY = ["public", "restricted"]
CONFIDENCE = ["exact", "convention", "by-name"]
FORMATS = ["cargo", "gomod", "npm", "server-json", "cluster-toml", "cluster-lock", "version-pin", "taskfile", "workflow"]

# Which files are manifests.
SKIP_DIRS = ["node_modules", "target", "dist", "build", "vendor", "testdata", "fixtures", "out", "coverage"]
MAX_DEPTH = 4
RECURSIVE_MANIFESTS = {"Cargo.toml": "cargo", "go.mod": "gomod", "package.json": "npm"}
ROOT_MANIFESTS = {"server.json": "server-json", "cluster.toml": "cluster-toml", "cluster.lock.toml": "cluster-lock", "Taskfile.yml": "taskfile"}
UNPARSED = [".vigil.toml", "compatibility.json"]
CARGO_TABLES = ["dependencies", "dev-dependencies", "build-dependencies"]
NPM_TABLES = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
TENANCY_KEY = "art.cloister/v1"

#: How a target was identified, by rule. `exact` rules make edges, all others weak edges.
RESOLUTION = [
    ("crate-name", "exact", "the crate's name is one that a repository's Cargo.toml publishes"),
    ("go-module-path", "exact", "the module path, or its longest prefix at a slash, is one that a go.mod declares"),
    ("npm-package-name", "exact", "the package's name is one that a package.json declares"),
    ("mcp-server-name", "exact", "the server's name is one that a server.json declares"),
    ("oci-identifier", "exact", "the image identifier is one that a server.json lists among its packages"),
    ("executable-name", "exact", "the executable's name is a launch command that a server.json declares"),
    ("git-url", "exact", "the dependency names the repository's URL"),
    ("github-ref", "exact", "the pinned reference names the repository"),
    ("release-url", "exact", "the download URL names the repository"),
    ("dispatch-target", "exact", "a workflow dispatches the event to the listening repository by name"),
    ("dispatch-event", "convention", "a workflow dispatches an event of the name listened for, to a target not named"),
    ("tenancy-key", "convention", "the server declares the hosting contract that the repository's cluster file serves"),
    ("image-name", "by-name", "the image's last path segment is a repository's name"),
    ("tool-name", "by-name", "the tool's name is a repository's name"),
    ("bundle-name", "by-name", "the wire's end is a bundle of a repository's name"),
]

DDL = {
    "cargo": "package STRUCT<name:STRING,version:STRING>, publishes ARRAY<STRING>, workspaceMembers ARRAY<STRING>, deps ARRAY<STRUCT<name:STRING,table:STRING,package:STRING,version:STRING,git:STRING,rev:STRING,tag:STRING,branch:STRING,path:STRING,line:INT>>",
    "gomod": "module STRING, publishes ARRAY<STRING>, requires ARRAY<STRUCT<path:STRING,version:STRING,indirect:BOOLEAN,line:INT>>, replaces ARRAY<STRUCT<path:STRING,version:STRING,with:STRING,withVersion:STRING,local:BOOLEAN,line:INT>>",
    "npm": "name STRING, version STRING, publishes ARRAY<STRING>, deps ARRAY<STRUCT<name:STRING,table:STRING,spec:STRING>>",
    "server-json": "name STRING, version STRING, repositoryUrl STRING, publishes ARRAY<STRING>, packages ARRAY<STRUCT<registryType:STRING,identifier:STRING,version:STRING>>, remotes ARRAY<STRUCT<type:STRING>>, commands ARRAY<STRUCT<metaKey:STRING,transport:STRING,command:STRING>>, declaresCloisterTenancy BOOLEAN, requiredDeps ARRAY<STRUCT<metaKey:STRING,server:STRING,minimumVersion:STRING,purpose:STRING>>",
    "cluster-toml": "clusterName STRING, bundles ARRAY<STRUCT<name:STRING,kind:STRING,tier:STRING,image:STRING,entryPoint:STRING,workerdServiceName:STRING>>, wires ARRAY<STRUCT<from:STRING,to:STRING,binding:STRING,transport:STRING>>, inputs ARRAY<STRUCT<key:STRING,ref:STRING,owner:STRING,repo:STRING,path:STRING,rev:STRING,version:STRING,line:INT>>",
    "cluster-lock": "schema STRING, cluster STRING, inputs ARRAY<STRUCT<key:STRING,owner:STRING,repo:STRING,path:STRING,rev:STRING,resolved:STRING,sha256:STRING,oci:STRUCT<identifier:STRING,version:STRING,digest:STRING>>>",
    "version-pin": "tool STRING, version STRING",
    "taskfile": "releaseRepos ARRAY<STRUCT<owner:STRING,repo:STRING>>",
    "workflow": "listensFor ARRAY<STRING>, dispatches ARRAY<STRUCT<event:STRING,owner:STRING,repo:STRING,line:INT>>",
}
#: The fields of facts that are never null; other texts and numbers may be, lists and flags never are.
NEVER_NULL = {
    "cargo": ["package.name", "deps.name", "deps.table"],
    "gomod": ["requires.path", "requires.version", "requires.line", "replaces.path", "replaces.with", "replaces.line"],
    "npm": ["deps.name", "deps.table"],
    "server-json": ["commands.metaKey", "commands.transport", "commands.command", "requiredDeps.metaKey", "requiredDeps.server"],
    "cluster-toml": ["inputs.key"],
    "cluster-lock": ["inputs.key"],
    "version-pin": ["tool", "version"],
    "taskfile": ["releaseRepos.owner", "releaseRepos.repo"],
    "workflow": ["dispatches.event", "dispatches.line"],
}
EVIDENCE = "STRUCT<repo:STRING,path:STRING,format:STRING,table:STRING,line:INT,input:STRING,bundle:STRING,wire:STRING,metaKey:STRING>"
COUPLINGS = "ARRAY<STRUCT<project:STRING,kinds:ARRAY<STRING>>>"
AUTHORED = "STRUCT<name:STRING,domain:STRING,status:STRING,visibility:STRING,question:STRING,primitive:STRING,description:STRING,relationships:ARRAY<STRUCT<project:STRING,verb:STRING>>>"
LINKS = "ARRAY<STRUCT<label:STRING,href:STRING>>"
TABLES = {
    "manifest": "repo STRING, path STRING, content BINARY",
    "lock_header": "schema_version INT, note STRING, collected_at STRING, private_inclusive BOOLEAN",
    "source": "repo STRING, path STRING, blob STRING, format STRING",
    "lock_repo": "slug STRING, github STRING, visibility STRING, on_map BOOLEAN, read BOOLEAN, unexamined ARRAY<STRING>",
    "roster": "slug STRING, owner STRING, repo STRING, github STRING, on_map BOOLEAN, checkout STRING",
    "edge": f"`from` STRING, `to` STRING, kind STRING, resolved_by STRING, matched STRING, resolves_from STRING, resolves_via STRING, detail STRING, version STRING, rev STRING, redacted BOOLEAN, evidence {EVIDENCE}",
    "entity": f"id STRING, kind STRING, repo STRING, repo_visibility STRING, sources_read BOOLEAN, manifests_read INT, unexamined ARRAY<STRING>, authored {AUTHORED}, derived STRUCT<depends_on:{COUPLINGS},depended_on_by:{COUPLINGS}>, links {LINKS}",
    "ownership": "coordinate STRING, kind STRING, repo STRING, `where` STRING, contested BOOLEAN",
    "unresolved": "`from` STRING, want STRING, via STRING, reason STRING",
    "resolution": "rule STRING, confidence STRING, how STRING",
    "project": f"slug STRING, authored {AUTHORED}, links {LINKS}",
}

#: What each list of the map is for; a test holds its keys against the map's array columns.
COLLECTIONS = {
    "entities": "one for each repository: what its maintainers state, apart from what its manifests say",
    "edges": "couplings whose target was identified exactly, with the file and rule they come from",
    "weak_edges": "couplings a source declares whose target was matched by a name or a convention only",
    "unresolved": "declarations that were parsed and lead to no repository, with the reason",
    "ownership": "every coordinate that a repository declares to publish; what exact rules look up",
}


def endpoints(service: str, topology: str) -> list[tuple[str, bool, str]]:
    """(path, canonical, what) of the served surfaces of a deployment; exactly one is canonical."""
    return [
        ("/.well-known/site-map.json", True, "the whole map"),
        (SCHEMA_PATH, False, "the contract as JSON Schema"),
        ("/graph.json", False, "an alias of the map, byte for byte"),
        ("/projects.json", False, "authored records with their derived dependencies"),
        (f"/.well-known/{service}.json", False, "the service descriptor"),
        ("/openapi.json", False, "the HTTP surface as OpenAPI"),
        (f"/schema/v1/{topology}-topology.json", False, "a topology schema for the map"),
        ("/projects/<slug>.json", False, "one entity with all that is needed to read it"),
    ]


def struct(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL.get(name) or TABLES[name])
