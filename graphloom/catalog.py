"""The graph operators as queries over the driver's tables, and SQL that each is held against.

The SQL is written from what an operator means on these tables; where texts are
parsed, it is written from the rows that the texts were made of.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import workload as W
from .functions import paths as P
from .functions import text as X
from .operators import edges as E
from .operators import index, rank, resolve
from .plans import canonical, collect, delta, diagram, inspect
from .plans import gate as G
from .schemas import COLLECTIONS, EDGE_KINDS, endpoints
from .sources import listing, provider
from .sources.store import shared_folder, written
from .streaming import upsert

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


t = W.table
c = F.col

# ---------------------------------------------------------------- sources, sinks, paths


@query("blob_sha", "SELECT doc_id, sha1(concat('blob ', strlen(text), chr(0), text)) AS blob FROM documents")
def blob_sha(spark, d):
    return t(spark, d, "documents").select("doc_id", X.git_blob_sha(c("text").cast("binary")).alias("blob"))


@query("contents_decode", "SELECT 'd' || doc_id AS repo, sha256(text) AS sha FROM documents")
def contents_decode(spark, d):
    rows = t(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("repo"), F.lit("f").alias("path"), F.base64(c("text").cast("binary")).alias("body"))
    return listing.decode_contents(rows).select("repo", F.sha2("content", 256).alias("sha"))


@query("visibility_probe", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'restricted' ELSE 'public' END AS visibility FROM nation")
def visibility_probe(spark, d):
    status = F.when(c("n_nationkey") % 4 == 0, 404).otherwise(200 + c("n_nationkey"))
    return t(spark, d, "nation").select("n_nationkey", listing.visibility(status).alias("visibility"))


@query("endpoints", "SELECT * FROM (VALUES ('/.well-known/site-map.json', true), ('/schema/v1/site-map.json', false), ('/graph.json', false), ('/projects.json', false), ('/.well-known/svc.json', false), ('/openapi.json', false), ('/schema/v1/topo-topology.json', false), ('/projects/<slug>.json', false)) AS t(path, canonical)")
def endpoint_table(spark, d):
    return spark.createDataFrame(endpoints("svc", "topo"), "path string, canonical boolean, what string").select("path", "canonical")


@query("collections", "SELECT unnest(['entities', 'edges', 'weak_edges', 'unresolved', 'ownership']) AS name")
def collections(spark, d):
    return spark.createDataFrame([(k,) for k in COLLECTIONS], "name string")


@query("classify_paths", f"WITH {W.PATHS_SQL} SELECT repo, path, format, CAST(depth AS INT) AS depth FROM classed WHERE format IS NOT NULL")
def classify_paths(spark, d):
    return P.select_manifests(W.paths(spark, d)).withColumn("depth", P.depth(c("path")))


@query("unexamined_configs", f"WITH {W.PATHS_SQL} SELECT repo, string_agg(DISTINCT path, ',' ORDER BY path) AS unexamined FROM classed WHERE path IN ('.vigil.toml', 'compatibility.json') GROUP BY repo")
def unexamined_configs(spark, d):
    return P.unexamined_by_repo(W.paths(spark, d)).select("repo", F.array_join("unexamined", ",").alias("unexamined"))


@query("capped_dirs", f"WITH {W.PATHS_SQL} SELECT DISTINCT repo, list_aggregate(dirs, 'string_agg', '/') AS dir FROM classed WHERE depth > 4 AND NOT shut AND base IN ('Cargo.toml', 'go.mod', 'package.json')")
def capped_dirs(spark, d):
    return P.capped_dirs(W.paths(spark, d))


@query("walked_paths", f"""WITH {W.PATHS_SQL} SELECT repo, count(*) AS walked FROM classed
    WHERE (NOT shut AND depth <= 5) OR list_aggregate(dirs, 'string_agg', '/') IN ('.github', '.github/workflows') GROUP BY repo""")
def walked_paths(spark, d):
    return W.paths(spark, d).where(listing.is_walked(c("path"))).groupBy("repo").agg(F.count("*").alias("walked"))


@query("local_replacements", """SELECT t, (t LIKE './%' OR t LIKE '../%' OR t LIKE '/%' OR regexp_matches(t, '^[A-Za-z]:[\\\\/]')) AS local
    FROM (SELECT DISTINCT CASE p_size % 6 WHEN 0 THEN './p' WHEN 1 THEN '../p' WHEN 2 THEN '/p' WHEN 3 THEN 'C:\\p' WHEN 4 THEN 'd:/p' ELSE 'x.org/p' END || p_partkey AS t FROM part)""")
def local_replacements(spark, d):
    k = c("p_size") % 6
    head = F.when(k == 0, "./p").when(k == 1, "../p").when(k == 2, "/p").when(k == 3, "C:\\p").when(k == 4, "d:/p").otherwise("x.org/p")
    rows = t(spark, d, "part").select(F.concat(head, "p_partkey").alias("t")).distinct()
    return rows.select("t", P.is_local_replacement(c("t")).alias("local"))


@query("roster_entries", "SELECT 'n' || n_nationkey AS slug, 'o' || n_regionkey AS owner, n_name AS repo, 'o' || n_regionkey || '/' || n_name AS github, n_nationkey % 2 = 0 AS on_map FROM nation")
def roster_entries(spark, d):
    rows = t(spark, d, "nation")
    entry = P.entry_from_github(F.concat(F.lit("o"), "n_regionkey", F.lit("/"), "n_name"), F.concat(F.lit("n"), "n_nationkey"), c("n_nationkey") % 2 == 0)
    return rows.select(entry.alias("e")).select("e.slug", "e.owner", "e.repo", "e.github", "e.on_map")


@query("search_roots", "SELECT c_custkey, '/home/u/' || c_custkey || ',/b' AS roots FROM customer")
def search_roots(spark, d):
    roots = P.parse_roots(F.concat(F.lit("~/"), "c_custkey", F.lit(": :/b ::")))
    return t(spark, d, "customer").select("c_custkey", F.array_join(F.transform(roots, lambda r: P.expand_home(r, "/home/u")), ",").alias("roots"))


@query("checkouts", """SELECT 's' || s_suppkey AS slug, CASE WHEN s_suppkey % 3 = 0 THEN '/a/s' || s_suppkey WHEN s_suppkey % 3 = 1 THEN '/b/s' || s_suppkey WHEN s_suppkey % 2 = 0 THEN '/a/r' || s_suppkey END AS checkout FROM supplier""")
def checkouts(spark, d):
    k = c("s_suppkey")
    rows = t(spark, d, "supplier")
    roster = rows.select(F.concat(F.lit("s"), k).alias("slug"), F.lit("o").alias("owner"), F.concat(F.lit("r"), k).alias("repo"), F.concat(F.lit("o/r"), k).alias("github"), F.lit(True).alias("on_map"), F.lit(None).cast("string").alias("checkout"))
    there = F.array(F.when(k % 3 == 0, F.concat(F.lit("/a/s"), k)), F.when(k % 3 <= 1, F.concat(F.lit("/b/s"), k)), F.when(k % 2 == 0, F.concat(F.lit("/a/r"), k)), F.concat(F.lit("/c/s"), k))
    return listing.resolve_checkouts(roster, ["/a", "/b"], rows.select(F.explode(there).alias("path")).where("path is not null")).select("slug", "checkout")


@query("roster_routing", """SELECT 'n' || n_nationkey AS slug, CASE WHEN n_nationkey % 5 = 4 THEN 'restricted' WHEN n_nationkey % 4 = 0 THEN 'restricted' ELSE 'public' END AS visibility,
    CASE WHEN n_nationkey % 5 = 4 OR n_nationkey % 4 = 0 THEN 'restricted' WHEN n_nationkey % 3 = 0 THEN 'read' ELSE 'no-checkout' END AS outcome FROM nation""")
def roster_routing(spark, d):
    k = c("n_nationkey")
    rows = t(spark, d, "nation").select(F.concat(F.lit("n"), k).alias("slug"), F.concat(F.lit("o/"), k).alias("github"), F.when(k % 3 == 0, "/x").alias("checkout"), k.alias("k"))
    seen = rows.where("k % 5 <> 4").select("github", F.when(c("k") % 4 == 0, "restricted").otherwise("public").alias("visibility"))
    return collect.route(rows, seen).select("slug", "visibility", "outcome")


# ---------------------------------------------------------------- extractors


@query("gomod_requires", """SELECT 'o' || l_orderkey AS repo, string_agg('example.com/p' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') || '/n' || l_linenumber || 's' || l_suppkey || ' v1.0.' || l_suppkey || CASE WHEN l_returnflag = 'R' THEN ' i' ELSE '' END, ','
        ORDER BY 'example.com/p' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') || '/n' || l_linenumber || 's' || l_suppkey) AS requires FROM lineitem GROUP BY l_orderkey""")
def gomod_requires(spark, d):
    show = F.transform("facts.requires", lambda r: F.concat(r["path"], F.lit(" "), r["version"], F.when(r["indirect"], " i").otherwise("")))
    return W.facts_of("gomod", spark, d).select("repo", F.array_join(show, ",").alias("requires"))


@query("gomod_replaces", """SELECT 'o' || l_orderkey AS repo, string_agg('example.com/p' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') || '/n' || l_linenumber || 's' || l_suppkey || CASE WHEN l_partkey % 2 = 1 THEN ' ../q - true' ELSE ' example.com/q v2 false' END, ','
        ORDER BY 'example.com/p' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') || '/n' || l_linenumber || 's' || l_suppkey) AS replaces FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey""")
def gomod_replaces(spark, d):
    show = F.transform("facts.replaces", lambda r: F.concat_ws(" ", r["path"], r["with"], F.coalesce(r["withVersion"], F.lit("-")), r["local"].cast("string")))
    return W.facts_of("gomod", spark, d).where("size(facts.replaces) > 0").select("repo", F.array_join(show, ",").alias("replaces"))


@query("npm_deps", """SELECT 'c' || o_custkey AS repo, '@x/c' || o_custkey AS name, string_agg('@x/o' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN ' devDependencies' ELSE ' dependencies' END || ' ^' || o_orderkey, ',' ORDER BY '@x/o' || o_orderkey) AS deps
    FROM orders GROUP BY o_custkey""")
def npm_deps(spark, d):
    show = F.transform("facts.deps", lambda x: F.concat_ws(" ", x["name"], x["table"], x["spec"]))
    return W.facts_of("npm", spark, d).select("repo", "facts.name", F.array_join(show, ",").alias("deps"))


@query("cargo_deps", """SELECT 's' || l_suppkey AS repo, string_agg('p' || l_partkey || ' ' || CASE WHEN l_partkey % 3 = 0 THEN '0.2 https://github.com/x/p' || l_partkey || ' abc' WHEN l_partkey % 5 = 0 THEN 'real-p' || l_partkey || ' 3' ELSE '1.0' END, ',' ORDER BY 'p' || l_partkey) AS deps,
        max(n)::INT AS last_line FROM (SELECT *, 5 + row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity = 50)) GROUP BY l_suppkey""")
def cargo_deps(spark, d):
    show = F.transform("facts.deps", lambda x: F.concat_ws(" ", x["name"], x["package"], x["version"], x["git"], x["rev"]))
    lines = F.array_max(F.transform("facts.deps", lambda x: x["line"]))
    return W.facts_of("cargo", spark, d).select("repo", F.array_join(show, ",").alias("deps"), lines.alias("last_line"))


@query("server_facts", """SELECT 's' || s_suppkey AS repo, 'io.x/s' || s_suppkey AS name, 'io.x/s' || s_suppkey || ',ghcr.io/x/s' || s_suppkey AS publishes, 'run-s' || s_suppkey AS command, 'io.x/n' || s_nationkey || ' 2 data' AS needs, s_nationkey % 2 = 0 AS tenant FROM supplier""")
def server_facts(spark, d):
    needs = F.transform("facts.requiredDeps", lambda x: F.concat_ws(" ", x["server"], x["minimumVersion"], x["purpose"]))
    return W.facts_of("server-json", spark, d).select("repo", "facts.name", F.array_join("facts.publishes", ",").alias("publishes"), F.array_join("facts.commands.command", ",").alias("command"), F.array_join(needs, ",").alias("needs"), c("facts.declaresCloisterTenancy").alias("tenant"))


@query("cluster_facts", """SELECT 'n' || s_nationkey AS repo, string_agg('b' || s_suppkey || '=ghcr.io/x/s' || s_suppkey || ':1', ',' ORDER BY 'b' || s_suppkey) AS bundles, string_agg('b' || s_suppkey || '>n', ',' ORDER BY 'b' || s_suppkey || 'n') AS wires,
        'region x r' || min(n_regionkey) || ' server.json 0abcdef 1,short' AS inputs FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey""")
def cluster_facts(spark, d):
    bundles = F.transform("facts.bundles", lambda b: F.concat(b["name"], F.lit("="), b["image"]))
    wires = F.transform("facts.wires", lambda w: F.concat(w["from"], F.lit(">"), w["to"]))
    inputs = F.transform("facts.inputs", lambda i: F.concat_ws(" ", i["key"], i["owner"], i["repo"], i["path"], i["rev"], i["version"]))
    return W.facts_of("cluster-toml", spark, d).select("repo", F.array_join(bundles, ",").alias("bundles"), F.array_join(wires, ",").alias("wires"), F.array_join(inputs, ",").alias("inputs"))


@query("cluster_lock_facts", "SELECT 'n' || n_nationkey AS repo, 'v1' AS schema, 'bare,region x r' || n_regionkey || ' 0abcdef ghcr.io/x/r' || n_regionkey AS inputs FROM nation")
def cluster_lock_facts(spark, d):
    inputs = F.transform("facts.inputs", lambda i: F.concat_ws(" ", i["key"], i["owner"], i["repo"], i["rev"], i["oci"]["identifier"]))
    return W.facts_of("cluster-lock", spark, d).select("repo", "facts.schema", F.array_join(inputs, ",").alias("inputs"))


@query("workflow_facts", """SELECT 'u' || user_id AS repo, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (WHERE value > 90), '') AS listens,
        CASE WHEN user_id % 5 = 0 THEN '' ELSE min(event_type) || CASE WHEN user_id % 3 = 0 THEN '' ELSE ' x u' || (user_id + 1) END END AS sends FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def workflow_facts(spark, d):
    sends = F.transform("facts.dispatches", lambda x: F.concat_ws(" ", x["event"], x["owner"], x["repo"]))
    return W.facts_of("workflow", spark, d).select("repo", F.array_join("facts.listensFor", ",").alias("listens"), F.array_join(sends, ",").alias("sends"))


@query("release_downloads", """SELECT 'c' || o_custkey AS repo, string_agg(DISTINCT 'o' || (o_orderkey % 7) || '/r' || (o_orderkey % 5), ',' ORDER BY 'o' || (o_orderkey % 7) || '/r' || (o_orderkey % 5)) AS repos FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey""")
def release_downloads(spark, d):
    from .operators.extract import taskfile

    k = c("o_orderkey")
    line = F.concat(F.lit("  - curl https://github.com/o"), k % 7, F.lit("/r"), k % 5, F.when(k % 3 == 0, F.lit("/releases/download/v1/x")).otherwise("/releases/tag/v1"))
    texts = W._joined(t(spark, d, "orders"), "o_custkey", ["o_orderkey"], line).select(F.concat(F.lit("c"), "o_custkey").alias("repo"), taskfile(c("body")).alias("f"))
    return texts.where("size(f.releaseRepos) > 0").select("repo", F.array_join(F.transform("f.releaseRepos", lambda r: F.concat_ws("/", r["owner"], r["repo"])), ",").alias("repos"))


@query("version_pins", """SELECT 't' || p_partkey AS tool, CASE WHEN p_size % 4 = 0 THEN 'v1.' || p_size WHEN p_size % 4 = 1 THEN p_size || '.2-rc.1' ELSE CAST(p_size AS VARCHAR) END AS version FROM part WHERE p_size % 4 < 3""")
def version_pins(spark, d):
    from .operators.extract import version_pin

    k = c("p_size") % 4
    body = F.when(k == 0, F.concat(F.lit(" v1."), "p_size", F.lit("\n"))).when(k == 1, F.concat("p_size", F.lit(".2-rc.1\n"))).when(k == 2, c("p_size").cast("string")).otherwise("latest")
    return t(spark, d, "part").select(version_pin(F.concat(F.lit(".t"), "p_partkey", F.lit("-version")), body).alias("f")).where("f is not null").select("f.*")


@query("key_lines", """SELECT 's' || s_suppkey AS slug, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(1 + s_suppkey % 7 AS INT) END AS line FROM supplier""")
def key_lines(spark, d):
    k = c("s_suppkey").cast("int")
    body = F.concat(F.repeat(F.lit("x\n"), k % 7), F.concat(F.lit('"s'), k, F.lit('" = 1\n')), F.when(k % 3 == 0, F.concat(F.lit("\n\n s"), k, F.lit(" = 2"))).otherwise(F.concat(F.lit("ss"), k, F.lit(" = 2"))))
    return t(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("slug"), X.line_of(body, F.concat(F.lit("s"), k)).alias("line"))


@query("parse_failures", "SELECT 'c' || c_custkey AS repo, 'package.json: npm parse failed — not valid JSON' AS message FROM customer WHERE c_custkey % 10 = 0")
def parse_failures(spark, d):
    k = c("c_custkey")
    rows = t(spark, d, "customer").select(F.concat(F.lit("c"), k).alias("repo"), F.lit("package.json").alias("path"), F.when(k % 10 == 0, F.lit('{"name": ')).otherwise('{"name": "x"}').cast("binary").alias("content"))
    return collect.parse_manifests(rows, ["npm"])[1].select("repo", "message")


# ---------------------------------------------------------------- ownership, declarations, resolution


@query("ownership_index", f"""WITH own AS ({W.OWNERSHIP_SQL}), n AS (SELECT coordinate, count(DISTINCT repo) AS n FROM own GROUP BY coordinate)
    SELECT coordinate, kind, repo, "where", n > 1 AS contested FROM own JOIN n USING (coordinate)""")
def ownership_index(spark, d):
    return index.build_ownership(W.claims(spark, d))


@query("published_coordinates", """SELECT 's' || s_suppkey AS repo, 'io.x/s' || s_suppkey AS coordinate, 'mcp-server-name' AS kind FROM supplier UNION ALL SELECT 's' || s_suppkey, 'ghcr.io/x/s' || s_suppkey, 'oci-identifier' FROM supplier
    UNION ALL SELECT 's' || s_suppkey, 'run-s' || s_suppkey, 'executable-name' FROM supplier UNION ALL SELECT DISTINCT 's' || l_suppkey, 's' || l_suppkey, 'crate-name' FROM lineitem WHERE l_quantity = 50
    UNION ALL SELECT DISTINCT 'c' || o_custkey, '@x/c' || o_custkey, 'npm-package-name' FROM orders UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'example.com/o' || l_orderkey, 'go-module-path' FROM lineitem""")
def published_coordinates(spark, d):
    facts = {f: W.facts_of(f, spark, d) for f in ("server-json", "cargo", "npm", "gomod")}
    return index.publishes(facts, executables=True).select("repo", "coordinate", "kind")


@query("required_coordinates", """SELECT DISTINCT 'o' || l_orderkey AS repo, 'example.com/p' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') || '/n' || l_linenumber || 's' || l_suppkey AS coordinate, 'go-module-path' AS kind FROM lineitem WHERE l_returnflag <> 'R'
    UNION ALL SELECT DISTINCT 's' || l_suppkey, CASE WHEN l_partkey % 5 = 0 THEN 'real-p' ELSE 'p' END || l_partkey, 'crate-name' FROM lineitem WHERE l_quantity = 50 AND l_partkey % 3 <> 0
    UNION ALL SELECT 'c' || o_custkey, '@x/o' || o_orderkey, 'npm-package-name' FROM orders UNION ALL SELECT 's' || s_suppkey, 'io.x/n' || s_nationkey, 'mcp-server-name' FROM supplier""")
def required_coordinates(spark, d):
    facts = {f: W.facts_of(f, spark, d) for f in ("server-json", "cargo", "npm", "gomod")}
    return index.distinct_requires(index.requires(facts)).select("repo", "coordinate", "kind")


# A replacement goes by path: where an order has the same path twice, the first one's local replacement counts for both.
@query("declared_overrides", """WITH r AS (SELECT 'o' || l_orderkey AS "from", 'example.com/p' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') || '/n' || l_linenumber || 's' || l_suppkey AS want, l_linestatus = 'O' AND l_partkey % 2 = 1 AS swapped, l_returnflag FROM lineitem),
        p AS (SELECT "from", want, bool_or(swapped) AS away FROM r GROUP BY "from", want)
    SELECT r."from", r.want, CASE WHEN away THEN 'path-outside-repo' ELSE 'published' END AS resolves_from, CASE WHEN away THEN '../q' END AS resolves_via FROM r JOIN p ON r."from" = p."from" AND r.want = p.want WHERE l_returnflag <> 'R'""")
def declared_overrides(spark, d):
    return index.declarations({"gomod": W.facts_of("gomod", spark, d)}).select("from", "want", "resolves_from", "resolves_via")


@query("declaration_counts", f"WITH decl AS ({W.DECLARED_SQL}) SELECT count(*) AS parsed, count(DISTINCT want) AS \"distinct\" FROM decl")
def declaration_counts(spark, d):
    return index.declaration_counts(W.wants(spark, d))


@query("resolve_exact", f"""WITH own AS ({W.OWNERSHIP_SQL}), decl AS ({W.DECLARED_SQL}), f AS (SELECT coordinate, min(repo) AS repo, count(DISTINCT repo) > 1 AS contested FROM own GROUP BY coordinate)
    SELECT d."from", d.want, f.repo, coalesce(f.contested, false) AS contested FROM decl d LEFT JOIN f ON d.want = f.coordinate""")
def resolve_exact(spark, d):
    wants = W.wants(spark, d).select("from", c("want").alias("coordinate"), F.lit("crate-name").alias("kind"))
    return resolve.resolve_exact(wants, index.build_ownership(W.claims(spark, d))).select("from", c("coordinate").alias("want"), "repo", "contested")


_URL = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
_PREFIX = f"""urls AS (SELECT DISTINCT {_URL} AS u FROM pages), own AS (SELECT DISTINCT coordinate, repo FROM (SELECT string_split(u, '/')[1] AS coordinate, 'h' AS repo FROM urls
    UNION ALL SELECT string_split(u, '/')[1] || '/' || string_split(u, '/')[2], 's' FROM urls WHERE len(string_split(u, '/')) > 2 AND length(string_split(u, '/')[2]) % 2 = 0))"""


def _url_paths(spark, d):
    return t(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("u")).distinct()


@query("resolve_prefix", f"""WITH {_PREFIX} SELECT u AS coordinate, max_by(coordinate, length(coordinate)) AS matched, max_by(repo, length(coordinate)) AS repo
    FROM urls JOIN own ON u = coordinate OR starts_with(u, coordinate || '/') GROUP BY u""")
def resolve_prefix(spark, d):
    urls = _url_paths(spark, d)
    parts = F.split("u", "/")
    deep = urls.where((F.size(parts) > 2) & (F.length(parts[1]) % 2 == 0)).select(F.concat_ws("/", parts[0], parts[1]).alias("coordinate"), F.lit("s").alias("repo"))
    own = urls.select(parts[0].alias("coordinate"), F.lit("h").alias("repo")).unionByName(deep).distinct().select("coordinate", F.lit("go-module-path").alias("kind"), "repo", F.lit("go.mod").alias("where"), F.lit(False).alias("contested"))
    wants = urls.select(c("u").alias("coordinate"), F.lit("go-module-path").alias("kind"))
    return resolve.resolve_against(wants, own).where("repo is not null").select("coordinate", "matched", "repo")


@query("resolve_url", """SELECT 'c' || o_custkey AS "from", 'o' || (o_orderkey % 3) || '/N' || (o_orderkey % 40) AS want, CASE WHEN o_orderkey % 40 < 25 AND o_orderkey % 3 = 0 THEN 'n' || (o_orderkey % 40) END AS repo FROM orders""")
def resolve_url(spark, d):
    k = c("o_orderkey")
    wants = t(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("from"), F.concat(F.lit("o"), k % 3, F.lit("/N"), k % 40).alias("want"))
    repos = t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("slug"), F.concat(F.lit("o0/n"), "n_nationkey").alias("github"))
    return resolve.resolve_url(wants, repos).select("from", "want", "repo")


@query("github_urls", """SELECT p_partkey, CASE WHEN p_size % 5 < 4 THEN 'o' || p_size || '/p' || p_partkey END AS repo FROM part""")
def github_urls(spark, d):
    k, who = c("p_size") % 5, F.concat(F.lit("o"), "p_size", F.lit("/p"), "p_partkey")
    url = F.when(k == 0, F.concat(F.lit("https://github.com/"), who)).when(k == 1, F.concat(F.lit("git@github.com:"), who, F.lit(".git"))).when(k == 2, F.concat(F.lit("ssh://git@github.com/"), who, F.lit(".git/"))).when(k == 3, F.concat(F.lit("https://github.com/"), who, F.lit("/tree/x"))).otherwise(F.concat(F.lit("https://example.org/"), who))
    return t(spark, d, "part").select("p_partkey", index.github_of(url).alias("repo"))


@query("resolve_name", """SELECT 'ghcr.io/x/s' || p_partkey AS want, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey) THEN 's' || p_partkey END AS repo FROM part""")
def resolve_name(spark, d):
    repos = t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("slug"), F.concat(F.lit("o/r"), "s_suppkey").alias("github"))
    return resolve.resolve_name(t(spark, d, "part").select(F.concat(F.lit("ghcr.io/x/s"), "p_partkey").alias("want")), repos).select("want", "repo")


_EVENT = """l AS (SELECT DISTINCT user_id AS u, event_type AS e FROM events WHERE value > 90 AND user_id IS NOT NULL), s AS (SELECT user_id AS u, min(event_type) AS e FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING user_id % 5 <> 0)"""


@query("resolve_events", f"""WITH {_EVENT} SELECT 'u' || l.u AS "from", 'u' || s.u AS "to", l.e AS want, CASE WHEN s.u % 3 = 0 THEN 'dispatch-event' ELSE 'dispatch-target' END AS rule
    FROM l JOIN s ON l.e = s.e AND l.u <> s.u AND (s.u % 3 = 0 OR s.u + 1 = l.u)""")
def resolve_events(spark, d):
    facts = W.facts_of("workflow", spark, d)
    listens = facts.select(c("repo").alias("from"), F.explode("facts.listensFor").alias("want"))
    repos = facts.select(c("repo").alias("slug"), F.concat(F.lit("x/"), "repo").alias("github"))
    return resolve.resolve_events(listens, facts.select("repo", F.explode("facts.dispatches").alias("d")), repos).select("from", "to", "want", "rule")


@query("unresolved_declarations", """SELECT DISTINCT 's' || s_suppkey AS "from", 'io.x/n' || s_nationkey AS want, 'mcp-server-name' AS via, 'no repository declares to publish it' AS reason FROM supplier""")
def unresolved_declarations(spark, d):
    facts = collect.settled({f: W.facts_of(f, spark, d) for f in ("server-json", "gomod")})
    repos = facts["server-json"].select(c("repo").alias("slug"), F.concat(F.lit("x/"), "repo").alias("github"))
    declared = written(index.declarations(facts).where("rule in ('mcp-server-name', 'go-module-path')"))
    found = resolve.resolve_all(declared, written(index.build_ownership(index.publishes(facts, True))), {}, repos)
    return resolve.unresolved(found, repos)


@query("third_party_scope", """SELECT count(*) FILTER (WHERE m = 0) AS kept, count(*) FILTER (WHERE m <> 0) AS third_party FROM (SELECT o_orderkey % 3 AS m FROM orders)""")
def third_party_scope(spark, d):
    wants = t(spark, d, "orders").select(F.concat(F.lit("github.com/Own"), c("o_orderkey") % 3, F.lit("/x/y")).alias("want"), F.lit("go-module-path").alias("rule"))
    repos = t(spark, d, "region").select(F.lit("own0/r").alias("github"))
    return resolve.scoped(wants, repos).agg(F.count_if("in_scope").alias("kept"), F.count_if(~c("in_scope")).alias("third_party"))


@query("escaping_paths", """SELECT p_partkey, p_size % 5 >= 3 AS outside FROM part""")
def escaping_paths(spark, d):
    k = c("p_size") % 5
    target = F.when(k == 0, "./x").when(k == 1, "../y/../z").when(k == 2, "b/../../c").when(k == 3, "../../q").otherwise("/abs")
    return t(spark, d, "part").select("p_partkey", P.escapes_root(F.lit("a/Cargo.toml"), target).alias("outside"))


# ---------------------------------------------------------------- edges


@query("edges", f'WITH {W.EDGES_SQL} SELECT "from", "to", kind, resolved_by, want AS matched FROM edges')
def edges(spark, d):
    return W.edges(spark, d).select("from", "to", "kind", "resolved_by", "matched")


_EDGES = f"WITH {W.EDGES_SQL}, {W.ENTITIES_SQL}, {W.RESOLUTION_SQL}"
_OPEN = """SELECT e.*, coalesce(a.repo_visibility = 'public' AND b.repo_visibility = 'public', false) AS open FROM edges e LEFT JOIN ent a ON e."from" = a.id LEFT JOIN ent b ON e."to" = b.id"""


def _both(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Asserted edges, and weak ones: those whose target was not identified by its coordinate."""
    return every.where("resolved_by = 'crate-name'"), every.where("resolved_by <> 'crate-name'")


@query("redacted_edges", f'{_EDGES} SELECT "from", "to", kind, NOT open AS redacted, CASE WHEN open THEN want END AS detail, CASE WHEN open THEN \'Cargo.toml\' END AS path FROM ({_OPEN})')
def redacted_edges(spark, d):
    return E.redact(W.edges(spark, d), W.entities(spark, d)).select("from", "to", "kind", "redacted", "detail", c("evidence.path").alias("path"))


@query("privacy_violations", f"""{_EDGES}, shut AS (SELECT * FROM ({_OPEN}) WHERE NOT open)
    SELECT "from" || ' -> ' || "to" || ' (' || kind || ') discloses ' || x AS message FROM shut, (SELECT unnest(['detail', 'version', 'evidence.path']) AS f), LATERAL (SELECT CASE f WHEN 'detail' THEN 'detail: "' || want || '"' WHEN 'version' THEN 'version: "1"' ELSE 'evidence.path: Cargo.toml' END AS x)
    UNION ALL SELECT id || ' is restricted but the lock claims its manifests were read' FROM ent WHERE repo_visibility <> 'public' AND sources_read""")
def privacy_violations(spark, d):
    return E.privacy_violations(*_both(W.edges(spark, d)), W.entities(spark, d))


@query("strict_privacy", f"""{_EDGES}, shut AS (SELECT * FROM ({_OPEN}) WHERE NOT open) SELECT f AS field, count(*) AS n FROM shut, (SELECT unnest(['matched', 'evidence.table', 'evidence.line']) AS f) GROUP BY f""")
def strict_privacy(spark, d):
    every = E.redact(W.edges(spark, d), W.entities(spark, d))
    return E.strict_privacy_violations(*_both(every), W.entities(spark, d)).groupBy("field").agg(F.count("*").alias("n"))


@query("dependencies_of", f"""WITH {W.EDGES_SQL} SELECT "to" AS project, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n, min(want) AS first_detail FROM edges WHERE "from" = 's7' GROUP BY "to" """)
def dependencies_of(spark, d):
    return _grouped(E.dependencies_of(W.edges(spark, d), "s7"))


@query("dependents_of", f"""WITH {W.EDGES_SQL} SELECT "from" AS project, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n, min(want) AS first_detail FROM edges WHERE "to" = 's7' GROUP BY "from" """)
def dependents_of(spark, d):
    return _grouped(E.dependents_of(W.edges(spark, d), "s7"))


def _grouped(df: DataFrame) -> DataFrame:
    return df.select("project", F.array_join("kinds", ",").alias("kinds"), F.size("edges").cast("long").alias("n"), F.array_min("edges.detail").alias("first_detail"))


@query("couplings", f"""WITH {W.EDGES_SQL}, p AS (SELECT "from" AS id, "to" AS project, string_agg(DISTINCT kind, '+' ORDER BY kind) AS kinds FROM edges GROUP BY 1, 2) SELECT id, string_agg(project || ':' || kinds, ',' ORDER BY project) AS couplings FROM p GROUP BY id""")
def couplings(spark, d):
    show = F.transform("couplings", lambda x: F.concat(x["project"], F.lit(":"), F.array_join(x["kinds"], "+")))
    return E.couplings(W.edges(spark, d), "from", "to").select("id", F.array_join(show, ",").alias("couplings"))


@query("weak_for", f"""WITH {W.EDGES_SQL} SELECT "from", "to", want AS detail FROM edges WHERE resolved_by <> 'crate-name' AND ("from" = 's7' OR "to" = 's7')""")
def weak_for(spark, d):
    return E.weak_for(W.edges(spark, d).where("resolved_by <> 'crate-name'"), "s7").select("from", "to", "detail")


@query("unresolved_for", f"""WITH own AS ({W.OWNERSHIP_SQL}), decl AS ({W.DECLARED_SQL}) SELECT want FROM decl WHERE "from" = 's7' AND want NOT IN (SELECT coordinate FROM own)""")
def unresolved_for(spark, d):
    gaps = W.wants(spark, d).join(W.claims(spark, d).select(c("coordinate").alias("want")), "want", "left_anti")
    return E.unresolved_for(gaps, "s7").select("want")


@query("slice_confidence", f"""{_EDGES} SELECT coalesce(confidence, 'by-name') AS confidence, count(*) AS n FROM edges LEFT JOIN res ON resolved_by = rule GROUP BY 1""")
def slice_confidence(spark, d):
    return E.slice_confidence(W.edges(spark, d), W.resolution(spark)).groupBy("confidence").agg(F.count("*").alias("n"))


@query("drawn_confidence", f"""{_EDGES} SELECT CASE WHEN confidence IN ('exact', 'by-name') THEN confidence ELSE 'convention' END AS confidence, count(*) AS n FROM edges LEFT JOIN res ON resolved_by = rule GROUP BY 1""")
def drawn_confidence(spark, d):
    return E.drawn_confidence(W.edges(spark, d), W.resolution(spark)).groupBy("confidence").agg(F.count("*").alias("n"))


@query("cited_rules", f"""{_EDGES} SELECT DISTINCT rule FROM res JOIN edges ON rule = resolved_by WHERE "from" = 's7' OR "to" = 's7'""")
def cited_rules(spark, d):
    return E.cited_rules(*_both(W.edges(spark, d)), "s7", W.resolution(spark)).select("rule")


@query("drawable_edges", f"""{_EDGES} SELECT "from", "to", kind, resolved_by FROM edges WHERE "from" IN (SELECT id FROM ent) AND "to" IN (SELECT id FROM ent)""")
def drawable_edges(spark, d):
    return E.drawable(W.edges(spark, d), W.entities(spark, d)).select("from", "to", "kind", "resolved_by")


@query("drawn_lines", f"""WITH {W.EDGES_SQL} SELECT "from", "to", kind, min(resolved_by) AS resolved_by, "from" || "to" || kind AS draw_key FROM edges GROUP BY "from", "to", kind""")
def drawn_lines(spark, d):
    return E.one_line_each(W.edges(spark, d)).select("from", "to", "kind", "resolved_by", "draw_key")


@query("weak_only", f"""WITH {W.EDGES_SQL} SELECT w."from", w."to", w.kind FROM edges w WHERE w.resolved_by <> 'crate-name' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.resolved_by = 'crate-name' AND e."from" = w."from" AND e."to" = w."to" AND e.kind = w.kind)""")
def weak_only(spark, d):
    every = W.edges(spark, d)
    return E.weak_only(every.where("resolved_by <> 'crate-name'"), every.where("resolved_by = 'crate-name'")).select("from", "to", "kind")


@query("dangling_references", f"""{_EDGES} SELECT 'kind' AS field, kind AS value, count(*) AS n FROM edges WHERE kind = 'protocol' GROUP BY kind UNION ALL SELECT 'resolved_by', resolved_by, count(*) FROM edges WHERE resolved_by NOT IN (SELECT rule FROM res) GROUP BY resolved_by""")
def dangling_references(spark, d):
    kinds = spark.createDataFrame([(k,) for k in EDGE_KINDS if k != "protocol"], "kind string")
    return E.dangling(W.edges(spark, d), kinds, W.resolution(spark)).groupBy("field", "value").agg(F.count("*").alias("n"))


@query("text_differences", """SELECT doc_id, CAST(1 + doc_id % 3 AS INT) AS line FROM documents WHERE len(string_split(text, chr(10))) > doc_id % 3 AND string_split(text, chr(10))[1 + doc_id % 3] <> '#'""")
def text_differences(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "text", (c("doc_id") % 3).cast("int").alias("k"))
    other = F.array_join(F.transform(X.lines(c("text")), lambda x, i: F.when(i == c("k"), "#").otherwise(x)), "\n")
    return rows.select("doc_id", E.first_difference(c("text"), other).alias("x")).where("x is not null").select("doc_id", "x.line")


@query("difference_context", """SELECT doc_id, '- expected:  ' || string_split(text, chr(10))[1] || chr(10) || '+ committed: #' AS context FROM documents WHERE text <> '' AND string_split(text, chr(10))[1] <> '#'""")
def difference_context(spark, d):
    rows = t(spark, d, "documents").where("text <> ''")
    other = F.regexp_replace("text", r"\A[^\n]*", "#")
    return rows.select("doc_id", E.first_difference(c("text"), other).alias("x")).where("x is not null").select("doc_id", "x.context")


_LINES = "string_split(text, chr(10))"


@query("difference_behind_lines", f"""SELECT doc_id, list_aggregate(list_concat(list_transform(list_slice(l, greatest(1, k - 3), k - 1), lambda x: '  ' || x), list_value('- expected:  ' || l[k], '+ committed: #')), 'string_agg', chr(10)) AS context
    FROM (SELECT doc_id, {_LINES} AS l, CAST(1 + doc_id % 6 AS INT) AS k FROM documents) WHERE len(l) >= k AND l[k] <> '#'""")
def difference_behind_lines(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "text", (c("doc_id") % 6).cast("int").alias("k"))
    other = F.array_join(F.transform(X.lines(c("text")), lambda x, i: F.when(i == c("k"), "#").otherwise(x)), "\n")
    return rows.select("doc_id", E.first_difference(c("text"), other).alias("x")).where("x is not null").select("doc_id", "x.context")


@query("contested_coordinates", f"""WITH own AS ({W.OWNERSHIP_SQL}) SELECT coordinate, count(DISTINCT repo) AS repos FROM own GROUP BY coordinate HAVING count(DISTINCT repo) > 1""")
def contested_coordinates(spark, d):
    owned = index.build_ownership(W.claims(spark, d)).where("contested")
    return owned.groupBy("coordinate").agg(F.count_distinct("repo").alias("repos"))


@query("blob_lookup", f"WITH {W.PATHS_SQL} SELECT repo, path, CASE WHEN length(path) % 3 > 0 THEN md5(path) END AS blob FROM paths")
def blob_lookup(spark, d):
    files = W.paths(spark, d)
    known = files.where(F.length("path") % 3 > 0).select("repo", "path", F.md5("path").alias("sha"))
    return listing.blob_lookup(files, known)


@query("listing_notes", f"""WITH {W.PATHS_SQL} SELECT DISTINCT repo, list_aggregate(dirs, 'string_agg', '/') || ': holds a manifest below the depth cap (4)' AS message FROM classed WHERE depth > 4 AND NOT shut AND base IN ('Cargo.toml', 'go.mod', 'package.json')
    UNION ALL SELECT DISTINCT repo, 'file listing was truncated by the API — this scan is incomplete' FROM paths WHERE repo LIKE '%7'""")
def listing_notes(spark, d):
    return collect.listing_notes(W.paths(spark, d).withColumn("truncated", c("repo").endswith("7")))


@query("lock_repos", f"""WITH {W.PATHS_SQL}, u AS (SELECT repo, string_agg(DISTINCT path, ',' ORDER BY path) AS unexamined FROM paths WHERE path IN ('.vigil.toml', 'compatibility.json') GROUP BY repo)
    SELECT 'r' || s_suppkey AS slug, CASE WHEN s_suppkey % 4 = 0 THEN 'restricted' ELSE 'public' END AS visibility, s_suppkey % 4 > 0 AS read, CASE WHEN s_suppkey % 4 > 0 THEN coalesce(unexamined, '') ELSE '' END AS unexamined
    FROM supplier LEFT JOIN u ON repo = 'r' || s_suppkey""")
def lock_repos(spark, d):
    k = c("s_suppkey")
    roster = t(spark, d, "supplier").select(F.concat(F.lit("r"), k).alias("slug"), F.concat(F.lit("o/r"), k).alias("github"), F.lit(True).alias("on_map"), F.lit("/x").alias("checkout"), k.alias("k"))
    seen = roster.select("github", F.when(c("k") % 4 == 0, "restricted").otherwise("public").alias("visibility"))
    return collect.lock_repos(collect.route(roster, seen), W.paths(spark, d)).select("slug", "visibility", "read", F.array_join("unexamined", ",").alias("unexamined"))


@query("entity_assembly", f"""{_EDGES}, a AS (SELECT "from" AS id, count(DISTINCT "to") AS n FROM edges GROUP BY 1), b AS (SELECT "to" AS id, count(DISTINCT "from") AS n FROM edges GROUP BY 1), m AS (SELECT 's' || l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT ent.id, CASE WHEN CAST(substr(ent.id, 2) AS INT) % 2 = 0 THEN 'project' ELSE 'repository' END AS kind, CAST(coalesce(m.n, 0) AS INT) AS manifests_read, CAST(coalesce(a.n, 0) AS INT) AS depends, CAST(coalesce(b.n, 0) AS INT) AS depended
    FROM ent LEFT JOIN a ON a.id = ent.id LEFT JOIN b ON b.id = ent.id LEFT JOIN m ON m.id = ent.id""")
def entity_assembly(spark, d):
    from .plans.derive import entity_assembly as assemble
    from .schemas import AUTHORED, LINKS

    repos = W.entities(spark, d).select(c("id").alias("slug"), F.concat(F.lit("o/"), "id").alias("github"), c("repo_visibility").alias("visibility"), c("sources_read").alias("read"), F.array().cast("array<string>").alias("unexamined"))
    counts = t(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("repo")).agg(F.count("*").alias("manifests"))
    authored = F.from_json(F.lit('{"name": "x", "status": "active", "visibility": "public", "relationships": []}'), AUTHORED)
    projects = repos.where(F.substr("slug", F.lit(2)).cast("int") % 2 == 0).select("slug", authored.alias("authored"), F.expr(f"cast(array() as {LINKS})").alias("links"))
    out = assemble(repos, counts, projects, W.edges(spark, d))
    return out.select("id", "kind", "manifests_read", F.size("derived.depends_on").alias("depends"), F.size("derived.depended_on_by").alias("depended"))


@query("contract_entities", """SELECT 'entities.n' || n_nationkey || '.' || f AS path, m AS message FROM nation, (VALUES ('kind', 'is no entity kind', 3), ('repo_visibility', 'is no visibility', 4), ('authored', 'a project entity must carry its authored block', 5), ('manifests_read', 'must be 0 or more', 7)) AS v(f, m, k) WHERE n_nationkey % k = 0 AND (f <> 'kind' OR n_nationkey % 5 <> 0)""")
def contract_entities(spark, d):
    from .schemas import struct

    k = c("n_nationkey")
    kinds = {f.name: f.dataType for f in struct("entity").fields}
    values = {
        "id": F.concat(F.lit("n"), k),
        "kind": F.when(k % 5 == 0, "project").when(k % 3 == 0, "other").otherwise("repository"),
        "repo_visibility": F.when(k % 4 == 0, "open").otherwise("public"),
        "sources_read": F.lit(True),
        "manifests_read": F.when(k % 7 == 0, -1).otherwise(0),
        "unexamined": F.array(),
        "derived": F.struct(F.array().alias("depends_on"), F.array().alias("depended_on_by")),
        "links": F.array(F.struct(F.lit("docs").alias("label"), F.lit("x").alias("href"))),
    }
    return G.entity_issues(t(spark, d, "nation").select(*[values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()]))


# ---------------------------------------------------------------- ranks, places, contract, reports, stream


def _fk_graph(spark, d):
    """Customers and suppliers depend on their nation, a nation on its region."""
    nation, region = t(spark, d, "nation"), t(spark, d, "region")
    cust, supp = t(spark, d, "customer"), t(spark, d, "supplier")
    name = lambda k, col: F.concat(F.lit(k), c(col)).alias("id")
    ids = region.select(name("r", "r_regionkey")).unionByName(nation.select(name("n", "n_nationkey"))).unionByName(supp.select(name("s", "s_suppkey"))).unionByName(cust.select(name("c", "c_custkey")))
    link = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), c(x)).alias("from"), F.concat(F.lit(b), c(y)).alias("to"))
    links = link(nation, "n", "n_nationkey", "r", "n_regionkey").unionByName(link(supp, "s", "s_suppkey", "n", "s_nationkey")).unionByName(link(cust, "c", "c_custkey", "n", "c_nationkey"))
    links = links.unionByName(cust.where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("from"), F.concat(F.lit("c"), c("c_custkey") - 1).alias("to")))
    return ids.withColumn("sources_read", F.lit(True)), links


_RANKS = """g AS (SELECT 'n' || n_nationkey AS f, 'r' || n_regionkey AS t FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
        UNION ALL SELECT 'c' || c_custkey, 'c' || (c_custkey - 1) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey - 1 IN (SELECT c_custkey FROM customer)),
    ids AS (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || c_custkey FROM customer),
    w(id, d) AS (SELECT id, 0 FROM ids UNION SELECT g.f, w.d + 1 FROM w JOIN g ON g.t = w.id), ranks AS (SELECT id, max(d)::INT AS rank FROM w GROUP BY id)"""


@query("ranks", f"WITH RECURSIVE {_RANKS} SELECT id, rank FROM ranks")
def ranks(spark, d):
    return rank.rank_entities(*_fk_graph(spark, d))


@query("layout", f"""WITH RECURSIVE {_RANKS}, w2 AS (SELECT id, rank, greatest(78, CAST(floor(length(id) * 7.3::DOUBLE + 22.5) AS BIGINT)) AS w FROM ranks),
    rw AS (SELECT rank, sum(w) + (count(*) - 1) * 26 AS rw FROM w2 GROUP BY rank), cv AS (SELECT greatest(320, max(rw)) + 56 AS width, max(rank) AS top FROM rw)
    SELECT id, rank, CAST(floor((width - rw) / 2.0 + 0.5) + coalesce(sum(w + 26) OVER (PARTITION BY rank ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x, CAST(28 + (top - rank) * 86 AS BIGINT) AS y,
           CAST(w AS BIGINT) AS w, CAST(26 AS BIGINT) AS h, CAST(width AS BIGINT) AS width, CAST((top + 1) * 86 + 56 - 60 + 34 AS BIGINT) AS height FROM w2 JOIN rw USING (rank), cv""")
def layout(spark, d):
    return rank.layout(rank.rank_entities(*_fk_graph(spark, d)))


@query("diagram_boxes", f"""WITH RECURSIVE {_RANKS}, w2 AS (SELECT id, rank, greatest(78, CAST(floor(length(id) * 7.3::DOUBLE + 22.5) AS BIGINT)) AS w FROM ranks),
    rw AS (SELECT rank, sum(w) + (count(*) - 1) * 26 AS rw FROM w2 GROUP BY rank), cv AS (SELECT greatest(320, max(rw)) + 56 AS width, max(rank) AS top FROM rw),
    l AS (SELECT id, CAST(floor((width - rw) / 2.0 + 0.5) + coalesce(sum(w + 26) OVER (PARTITION BY rank ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x, 28 + (top - rank) * 86 AS y, w FROM w2 JOIN rw USING (rank), cv)
    SELECT id, '    <g class="node"><rect class="node-box" x="' || x || '" y="' || y || '" width="' || w || '" height="26" /><text class="node-label" x="' || (x + w // 2) || CASE WHEN w % 2 = 1 THEN '.5' ELSE '' END || '" y="' || (y + 14) || '">' || id || '</text></g>' AS line FROM l""")
def diagram_boxes(spark, d):
    return diagram.boxes(rank.layout(rank.rank_entities(*_fk_graph(spark, d))))


@query("edge_paths", """SELECT l_orderkey, l_linenumber, 'M' || (l_partkey + 39) || ' ' || (l_suppkey + 26) || ' C' || (l_partkey + 39) || ' ' || m || ' ' || (l_linenumber + 39) || ' ' || m || ' ' || (l_linenumber + 39) || ' ' || l_orderkey AS d
    FROM (SELECT *, CASE WHEN (l_suppkey + 26 + l_orderkey) % 2 = 0 THEN CAST((l_suppkey + 26 + l_orderkey) // 2 AS VARCHAR) ELSE CAST((l_suppkey + 26 + l_orderkey) // 2 AS VARCHAR) || '.5' END AS m FROM lineitem)""")
def edge_paths(spark, d):
    place = lambda x, y: F.struct(c(x).cast("long").alias("x"), c(y).cast("long").alias("y"), F.lit(78).cast("long").alias("w"), F.lit(26).cast("long").alias("h"))
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", place("l_partkey", "l_suppkey").alias("a"), place("l_linenumber", "l_orderkey").alias("b"))
    return rows.select("l_orderkey", "l_linenumber", diagram.edge_path(c("a"), c("b")).alias("d"))


@query("escaped_pages", """SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS sha FROM pages""")
def escaped_pages(spark, d):
    return t(spark, d, "pages").select("page_id", F.sha2(X.escape_xml(c("html")), 256).alias("sha"))


@query("encoded_paths", "SELECT DISTINCT p_type, replace(p_type, ' ', '%20') || '/a%2Bb' AS path FROM part")
def encoded_paths(spark, d):
    return t(spark, d, "part").select("p_type", X.encode_path(F.concat("p_type", F.lit("/a+b"))).alias("path")).distinct()


@query("legend", "SELECT * FROM (VALUES ('exact', 28), ('by-name', 185), ('convention', 314)) AS t(style, x)")
def legend(spark, d):
    rows = spark.createDataFrame([(i, s, label) for i, (s, label) in enumerate(diagram.KEY)], "ord int, style string, label string")
    return diagram.legend_offsets(rows).select("style", c("x").cast("int").alias("x"))


@query("contract_edges", f"""WITH {W.EDGES_SQL} SELECT 'edges.' || "from" || '.' || "to" || '.' || CASE WHEN k = 0 THEN 'kind' ELSE 'evidence.line' END AS path, CASE WHEN k = 0 THEN 'is no edge kind' ELSE 'must be 1 or more' END AS message
    FROM (SELECT *, CAST(substr(want, 2) AS BIGINT) AS n, unnest([0, 1]) AS k FROM edges) WHERE (k = 0 AND n % 11 = 0) OR (k = 1 AND n % 13 = 0)""")
def contract_edges(spark, d):
    n = c("evidence.line")
    rows = W.edges(spark, d).withColumn("kind", F.when(n % 11 == 0, "lineage").otherwise(c("kind"))).withColumn("evidence", c("evidence").withField("line", F.when(n % 13 == 0, 0).otherwise(n)))
    return G.edge_issues(rows)


@query("contract_keys", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'extra' ELSE '' END AS unknown FROM events""")
def contract_keys(spark, d):
    from pyspark.sql.types import StructType

    raw = F.when(c("event_id") % 3 == 0, F.lit('{"coordinate": "a", "extra": 1}')).otherwise(F.lit('{"coordinate": "a", "repo": "b"}'))
    return t(spark, d, "events").select("event_id", F.array_join(G.unknown_keys(raw, StructType.fromDDL("coordinate string, kind string, repo string")), ",").alias("unknown"))


@query("inspect_lines", f"""WITH own AS ({W.OWNERSHIP_SQL}), f AS (SELECT coordinate, min(repo) AS repo, count(DISTINCT repo) > 1 AS contested FROM own GROUP BY coordinate), decl AS (SELECT DISTINCT want FROM ({W.DECLARED_SQL}))
    SELECT CASE WHEN f.repo IS NULL THEN '  ' || want || '  [crate-name]  Cargo.toml' ELSE '  ' || f.repo || '  ' || want || '  [crate-name]' || CASE WHEN contested THEN '  ** CONTESTED **' ELSE '' END END AS line FROM decl LEFT JOIN f ON want = coordinate""")
def inspect_lines(spark, d):
    owned = index.build_ownership(W.claims(spark, d))
    wants = W.wants(spark, d).select(c("want").alias("coordinate"), F.lit("crate-name").alias("kind"), F.lit("Cargo.toml").alias("where")).distinct()
    _, known, unknown = inspect.report_lines(owned, resolve.resolve_against(wants, owned))
    return known.select("line").unionByName(unknown.select("line"))


@query("newest_sources", """SELECT user_id, event_type, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events WHERE user_id IS NOT NULL) WHERE n = 1""")
def newest_sources(spark, d):
    rows = t(spark, d, "events").where("user_id is not null").select(c("user_id").alias("repo"), c("event_type").alias("path"), c("event_id").alias("seq"), F.sha1("props").alias("blob"))
    return upsert.newest(rows).select(c("repo").alias("user_id"), c("path").alias("event_type"), "seq")


@query("running_places", """SELECT s_nationkey, s_suppkey, CAST(coalesce(sum(length('s' || s_suppkey)) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x FROM supplier""")
def running_places(spark, d):
    before = Window.partitionBy("s_nationkey").orderBy("s_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    return t(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.coalesce(F.sum(F.length(F.concat(F.lit("s"), "s_suppkey"))).over(before), F.lit(0)).cast("long").alias("x"))


# ---------------------------------------------------------------- whole graphs, documents, providers


@query("ranks_deep", """SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, count(*) FILTER (WHERE p IS NOT NULL) OVER (PARTITION BY g ORDER BY c_custkey) AS rank
    FROM (SELECT c_custkey, c_nationkey AS g, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p FROM customer)""")
def ranks_deep(spark, d):
    """Each customer depends on the one before it in its nation, and on the nation's first: chains as long as nations are large."""
    rows = _ring(spark, d)
    first = rows.groupBy("nation").agg(F.min("id").alias("to"))
    edges = rows.where("before is not null").select(c("id").alias("from"), c("before").alias("to")).unionByName(rows.join(first, "nation").where("id <> to").select(c("id").alias("from"), "to"))
    return rank.rank_entities(rows.select("id", F.lit(True).alias("sources_read")), edges).select("id", c("rank").cast("long").alias("rank"))


def _ring(spark, d):
    ident = F.concat(F.lit("c"), F.lpad(c("c_custkey").cast("string"), 9, "0"))
    rows = t(spark, d, "customer").select(c("c_nationkey").alias("nation"), ident.alias("id"))
    return rows.withColumn("before", F.lag("id").over(Window.partitionBy("nation").orderBy("id")))


@query("cycle_steps", """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS nth, 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id FROM customer
    WHERE c_nationkey = (SELECT c_nationkey FROM customer ORDER BY c_custkey LIMIT 1)""")
def cycle_steps(spark, d):
    """The customers of each nation are a ring; the cycle with the least customer, step by step."""
    rows = _ring(spark, d)
    after = rows.where("before is not null").select(c("before").alias("id"), c("id").alias("to"))
    ends = rows.groupBy("nation").agg(F.max("id").alias("id"), F.min("id").alias("to")).where("id <> to").select("id", "to")
    return rank.cycle_of(after.unionByName(ends)).select("nth", "id")


_PROVIDED = """SELECT 'n' || n_nationkey AS repo, path, sha1(concat('blob ', strlen(body), chr(0), body)) AS blob, sha256(body) AS content_sha FROM (
    SELECT n_nationkey, unnest(['Cargo.toml', '.tool-version']) AS path, unnest(['[package]' || chr(10) || 'name = "n' || n_nationkey || '"' || chr(10) || '# ' || coalesce(k, '') || chr(10), '1.' || n_nationkey]) AS body
    FROM nation LEFT JOIN (SELECT c_nationkey, string_agg(c_custkey, ' ' ORDER BY c_custkey) AS k FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey)"""


def _provided(spark, d):
    """repo, path, content: two manifests for each nation, one of which names all its customers."""
    keys = t(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: k.cast("string")), " ").alias("k"))
    rows = t(spark, d, "nation").join(keys, c("n_nationkey") == c("c_nationkey"), "left")
    cargo = F.concat(F.lit('[package]\nname = "n'), "n_nationkey", F.lit('"\n# '), F.coalesce("k", F.lit("")), F.lit("\n"))
    files = F.array(F.struct(F.lit("Cargo.toml").alias("path"), cargo.alias("body")), F.struct(F.lit(".tool-version").alias("path"), F.concat(F.lit("1."), "n_nationkey").alias("body")))
    return rows.select(F.concat(F.lit("n"), "n_nationkey").alias("repo"), F.explode(files).alias("f")).select("repo", "f.path", c("f.body").cast("binary").alias("content"))


def _read_back(spark, d, kind):
    folder = f"{shared_folder(spark)}/graphloom/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"
    provider.write_repositories(_provided(spark, d), folder, kind)
    return provider.read_repositories(spark, folder, kind).where("content is not null").select("repo", "path", "blob", F.sha2("content", 256).alias("content_sha"))


@query("provider_checkouts", _PROVIDED)
def provider_checkouts(spark, d):
    return _read_back(spark, d, "checkout")


@query("provider_prefetched", _PROVIDED)
def provider_prefetched(spark, d):
    return _read_back(spark, d, "prefetched")


def _small_lock(spark, d):
    """A lock of all suppliers, whose servers need those of their nations."""
    own = W.texts_of("server-json", spark, d).select("repo", "path", c("text").cast("binary").alias("content"))
    nations = t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("repo"), F.lit("server.json").alias("path"), F.to_json(F.struct(F.concat(F.lit("io.x/n"), "n_nationkey").alias("name"))).cast("binary").alias("content"))
    facts = collect.parse_manifests(own.unionByName(nations), ["server-json"])[0]
    true, none = F.lit(True), F.array().cast("array<string>")
    repos = facts["server-json"].select(c("repo").alias("slug"), F.concat(F.lit("x/"), "repo").alias("github"), F.lit("public").alias("visibility"), true.alias("on_map"), true.alias("read"), none.alias("unexamined"))
    return collect.Lock(repos, facts, False, "2024-01-01T00:00:00Z")


_SITE = {"name": "x", "url": "https://example.com", "describes": "y"}


@query("gate_verdicts", """SELECT unnest(['unchanged', 'bad lock', 'bad map', 'other shape', 'edge dropped', 'secret told']) AS made, unnest(['ok', 'lock-unparseable', 'graph-unparseable', 'schema', 'divergent', 'privacy']) AS reason, n AS entities
    FROM (SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS n)""")
def gate_verdicts(spark, d):
    """The map of all suppliers and nations, and what the gate says of it and of five changes to it."""
    return G.verdicts(_small_lock(spark, d), "https://example.com", _SITE)


@query("canonical_sources", """SELECT count(*) AS sources, sum(octet_length(encode(row_text))) AS bytes FROM (
    SELECT '    {' || chr(10) || '      "repo": "' || repo || '",' || chr(10) || '      "path": "server.json",' || chr(10) || '      "format": "server-json"' || chr(10) || '    }' AS row_text
    FROM (SELECT 's' || s_suppkey AS repo FROM supplier))""")
def canonical_sources(spark, d):
    """The sources of the lock as lines of a canonical document: how many, and their bytes."""
    rows = t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("repo"), F.lit("server.json").alias("path"), F.lit("server-json").alias("format"))
    told = canonical.rendered(rows, ["repo", "path"])
    return told.agg(F.count("*").alias("sources"), F.sum(F.octet_length("text")).alias("bytes"))


@query("lock_table_issues", """SELECT 'o' || o_orderkey AS lock, path, message FROM orders, (VALUES (0, 'note', 'is missing'), (1, 'repos.0.read', 'must be true or false'), (2, 'sources.0.format', 'is no format'), (3, 'sources.0.facts.deps.0.name', 'must be a text'), (3, 'sources.0.facts.extra', 'is no key of the contract')) AS v(k, path, message)
    WHERE o_orderkey % 5 = k""")
def lock_table_issues(spark, d):
    """A lock for each order, four of five of them broken in some way."""
    none = '"table": "dependencies", ' + ", ".join(f'"{n}": null' for n in ("package", "version", "git", "rev", "tag", "branch", "path", "line"))
    k = c("o_orderkey") % 5
    pick = lambda at, bad, good: F.when(k == at, F.lit(bad)).otherwise(F.lit(good))
    text = F.concat(
        F.lit('{"schema_version": 1, '), pick(0, "", '"note": "n", '), F.lit('"collected_at": "x", "private_inclusive": false, "repos": [{"slug": "o'), "o_orderkey", F.lit('", "github": "x/y", "visibility": "public", "on_map": true, "read": '), pick(1, '"yes"', "true"),
        F.lit(', "unexamined": []}], "sources": [{"repo": "a", "path": "Cargo.toml", "blob": null, "format": '), pick(2, '"odd"', '"cargo"'),
        F.lit(', "facts": {"package": null, "publishes": [], "workspaceMembers": [], '), pick(3, '"extra": 1, ', ""), F.lit('"deps": [{"name": '), pick(3, "7", '"p"'), F.lit(f', {none}}}]}}}}]}}'),
    )
    return G.lock_table_issues(t(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("lock"), text.alias("text")))


# ---------------------------------------------------------------- derivation of changes


def _rederived(spark, d):
    """A state that was derived from all manifests and then followed a change."""
    base, later, gone, roster = W.changed_cargo(spark, d)
    state = delta.state_of(spark, f"{shared_folder(spark)}/graphloom/{spark.sparkContext.applicationId}/state-{uuid.uuid4().hex}")
    delta.advance(state, base, roster=roster)
    return state, delta.advance(state, later, gone)


@query("rederived_edges", f"""WITH {W.CHANGED_CARGO_SQL}, f AS (SELECT crate, min(repo) AS repo FROM own GROUP BY crate)
    SELECT d.repo AS "from", f.repo AS "to", d.want AS matched, 'library' AS kind FROM declared d JOIN f ON d.want = f.crate WHERE d.repo <> f.repo""")
def rederived_edges(spark, d):
    return delta.edges(_rederived(spark, d)[0]).select("from", "to", "matched", "kind")


@query("edge_changes", f"""WITH {W.CHANGED_CARGO_SQL}, f AS (SELECT crate, min(repo) AS repo FROM own GROUP BY crate),
    before AS (SELECT d.repo AS "from", 's' || s AS "to", 's' || s AS matched FROM deps d JOIN supplier ON s_suppkey = s),
    after AS (SELECT d.repo AS "from", f.repo AS "to", d.want AS matched FROM declared d JOIN f ON d.want = f.crate WHERE d.repo <> f.repo)
    SELECT 'gone' AS what, * FROM (SELECT * FROM before EXCEPT SELECT * FROM after) UNION ALL SELECT 'new', * FROM (SELECT * FROM after EXCEPT SELECT * FROM before)""")
def edge_changes(spark, d):
    change = _rederived(spark, d)[1]
    own = lambda df: df.select("from", "to", "matched").distinct()  # noqa: E731  # lines of a manifest move, and with them its edges' evidence
    gone, new = own(change.edges_gone), own(change.edges_new)
    return gone.exceptAll(new).select(F.lit("gone").alias("what"), "*").unionByName(new.exceptAll(gone).select(F.lit("new").alias("what"), "*"))
