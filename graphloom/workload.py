"""The star-schema tables as inputs of the graph operators, and the operators as queries over them.

Queries run over whole tables, but for those on claims, Cargo texts and edges: a
supplier publishes the parts of which it shipped fifty at once (l_quantity = 50,
about 2% of lineitem), as the SQL that they are held against says. Manifests are written from rows of lineitem,
customer, supplier and nation, so that what a parser must find is known from the
tables themselves and can be held against SQL that never sees the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------- tables of a graph

OWNERSHIP_SQL = """SELECT DISTINCT 'p' || l_partkey AS coordinate, 'crate-name' AS kind, 's' || l_suppkey AS repo, 'Cargo.toml' AS "where"
                   FROM lineitem WHERE l_quantity = 50"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier publishes the parts of which it shipped fifty at once."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select("l_partkey", "l_suppkey").distinct()
    return rows.select(F.concat(F.lit("s"), "l_suppkey").alias("repo"), F.lit("Cargo.toml").alias("where"), F.concat(F.lit("p"), "l_partkey").alias("coordinate"), F.lit("crate-name").alias("kind"))


DECLARED_SQL = """SELECT DISTINCT 's' || (o_custkey % 100) AS "from", 'p' || l_partkey AS want FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""


def wants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, a hundred to a repository, want the parts that they ordered."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return rows.select(F.concat(F.lit("s"), F.col("o_custkey") % 100).alias("from"), F.concat(F.lit("p"), "l_partkey").alias("want")).distinct()


EDGES_SQL = f"""own AS ({OWNERSHIP_SQL}), decl AS ({DECLARED_SQL}),
    first AS (SELECT coordinate, min(repo) AS repo FROM own GROUP BY coordinate),
    edges AS (SELECT d."from", f.repo AS "to", d.want,
                     CASE WHEN CAST(substr(d.want, 2) AS BIGINT) % 3 = 0 THEN 'artifact' WHEN CAST(substr(d.want, 2) AS BIGINT) % 3 = 1 THEN 'library' ELSE 'protocol' END AS kind,
                     CASE WHEN CAST(substr(d.want, 2) AS BIGINT) % 5 = 0 THEN 'tool-name' WHEN CAST(substr(d.want, 2) AS BIGINT) % 7 = 0 THEN 'gone' ELSE 'crate-name' END AS resolved_by
              FROM decl d JOIN first f ON d.want = f.coordinate WHERE d."from" <> f.repo)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from, to, kind, resolved_by, and the rest of an edge's columns, of wants that a first claim resolves."""
    from .operators.index import build_ownership
    from .operators.resolve import resolve_exact
    from .schemas import EVIDENCE

    owned = build_ownership(claims(spark, sf_dir))
    found = resolve_exact(wants(spark, sf_dir).select("from", F.col("want").alias("coordinate"), F.lit("crate-name").alias("kind")), owned)
    n = F.substr("coordinate", F.lit(2)).cast("long")
    null = F.lit(None).cast("string")
    evidence = F.struct(F.col("from").alias("repo"), F.lit("Cargo.toml").alias("path"), F.lit("cargo").alias("format"), F.lit("dependencies").alias("table"), n.cast("int").alias("line"), *[null.alias(x) for x in ("input", "bundle", "wire", "metaKey")]).cast(EVIDENCE)
    return found.where("repo is not null and `from` <> repo").select(
        "from",
        F.col("repo").alias("to"),
        F.when(n % 3 == 0, "artifact").when(n % 3 == 1, "library").otherwise("protocol").alias("kind"),
        F.when(n % 5 == 0, "tool-name").when(n % 7 == 0, "gone").otherwise("crate-name").alias("resolved_by"),
        "matched",
        F.lit("published").alias("resolves_from"),
        null.alias("resolves_via"),
        F.col("coordinate").alias("detail"),
        F.lit("1").alias("version"),
        null.alias("rev"),
        F.lit(False).alias("redacted"),
        evidence.alias("evidence"),
    )


ENTITIES_SQL = """ent AS (SELECT 's' || s_suppkey AS id, CASE WHEN s_nationkey % 4 = 0 THEN 'restricted' ELSE 'public' END AS repo_visibility, s_nationkey % 8 = 0 AS sources_read
                   FROM supplier WHERE s_suppkey % 10 <> 3)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers but for those of a last digit are entities; a fourth of the nations is not public."""
    rows = table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 3")
    return rows.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 4 == 0, "restricted").otherwise("public").alias("repo_visibility"), (F.col("s_nationkey") % 8 == 0).alias("sources_read"))


RESOLUTION_ROWS = [("crate-name", "exact", "-"), ("tool-name", "by-name", "-"), ("never", "convention", "-")]
RESOLUTION_SQL = "res AS (SELECT * FROM (VALUES ('crate-name', 'exact'), ('tool-name', 'by-name'), ('never', 'convention')) AS t(rule, confidence))"


def resolution(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESOLUTION_ROWS, "rule string, confidence string, how string")


# ------------------------------------------------------------- paths and manifests

_DIRS = ["src", "vendor", "pkg", ".git", "packages", ".github", "workflows", "target", "a", "b"]
_NAMES = ["Cargo.toml", "go.mod", "package.json", "server.json", "cluster.toml", "cluster.lock.toml", "Taskfile.yml", ".tool-version", "ci.yml", "README.md", ".vigil.toml", "compatibility.json", "ci.yaml", ".x-Version"]


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo and path: paths made up from the keys of lineitem's rows, none to six directories deep."""
    a, b = F.col("l_orderkey"), F.col("l_partkey")
    dirs = F.array(*[F.lit(d) for d in _DIRS])
    names = F.array(*[F.lit(n) for n in _NAMES])
    deep = (a % 7).cast("int")
    way = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.get(dirs, ((a * k + b) % 10).cast("int")))
    special = F.when((a + b) % 11 == 0, F.concat(F.lit(".github/workflows/"), F.get(names, (b % 14).cast("int"))))
    path = F.concat_ws("/", F.concat(F.when(deep > 0, F.slice(way, F.lit(1), deep)).otherwise(F.array().cast("array<string>")), F.array(F.get(names, (b % 14).cast("int")))))
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("r"), F.col("l_suppkey")).alias("repo"), F.coalesce(special, path).alias("path")).distinct()


PATHS_SQL = f"""paths AS (SELECT DISTINCT 'r' || l_suppkey AS repo,
    CASE WHEN (l_orderkey + l_partkey) % 11 = 0 THEN '.github/workflows/' || (list_value({", ".join(f"'{n}'" for n in _NAMES)}))[1 + l_partkey % 14]
         ELSE list_aggregate(list_append(list_slice(list_transform(range(1, 7), lambda k: (list_value({", ".join(f"'{d}'" for d in _DIRS)}))[1 + (l_orderkey * k + l_partkey) % 10]), 1, l_orderkey % 7),
                             (list_value({", ".join(f"'{n}'" for n in _NAMES)}))[1 + l_partkey % 14]), 'string_agg', '/') END AS path FROM lineitem),
    parts AS (SELECT repo, path, string_split(path, '/')[-1] AS base, list_slice(string_split(path, '/'), 1, -2) AS dirs FROM paths),
    told AS (SELECT *, len(dirs) AS depth,
        len(list_filter(dirs, lambda d: d IN ('node_modules', 'target', 'dist', 'build', 'vendor', 'testdata', 'fixtures', 'out', 'coverage') OR starts_with(d, '.'))) > 0 AS shut FROM parts),
    classed AS (SELECT *, CASE WHEN depth = 2 AND dirs[1] = '.github' AND dirs[2] = 'workflows' AND (ends_with(base, '.yml') OR ends_with(base, '.yaml')) THEN 'workflow'
        WHEN shut OR depth > 4 THEN NULL WHEN base = 'Cargo.toml' THEN 'cargo' WHEN base = 'go.mod' THEN 'gomod' WHEN base = 'package.json' THEN 'npm' WHEN depth > 0 THEN NULL
        WHEN base = 'server.json' THEN 'server-json' WHEN base = 'cluster.toml' THEN 'cluster-toml' WHEN base = 'cluster.lock.toml' THEN 'cluster-lock' WHEN base = 'Taskfile.yml' THEN 'taskfile'
        WHEN regexp_matches(base, '^\\.[a-z0-9][a-z0-9-]*-version$') THEN 'version-pin' END AS format FROM told)"""


def _joined(rows: DataFrame, by: str, order: list[str], line) -> DataFrame:
    """One text for each group: the lines of its rows, in order."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))


def gomod_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A go.mod for each order: a block of its parts, indirect where returned; replaced where open, locally where odd."""
    rows = table(spark, sf_dir, "lineitem")
    line = F.concat(F.lit("\texample.com/p"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"), F.lit("/n"), "l_linenumber", F.lit("s"), "l_suppkey", F.lit(" v1.0."), "l_suppkey", F.when(F.col("l_returnflag") == "R", " // indirect").otherwise(""))
    swap = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("\nreplace example.com/p"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"), F.lit("/n"), "l_linenumber", F.lit("s"), "l_suppkey", F.when(F.col("l_partkey") % 2 == 1, F.lit(" => ../q")).otherwise(F.lit(" => example.com/q v2"))))
    body = _joined(rows, "l_orderkey", ["l_linenumber"], line)
    swaps = _joined(rows.where("l_linestatus = 'O'"), "l_orderkey", ["l_linenumber"], swap).withColumnRenamed("body", "swaps")
    both = body.join(swaps, "l_orderkey", "left")
    return both.select(F.concat(F.lit("o"), "l_orderkey").alias("repo"), F.lit("go.mod").alias("path"), F.concat(F.lit("module example.com/o"), "l_orderkey", F.lit("\n\n// parts\nrequire (\n"), "body", F.lit("\n)\nexclude (\n\texample.com/x v1\n)\n"), F.coalesce("swaps", F.lit(""))).alias("text"))


def npm_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package.json for each customer with orders: an order is a dependency, finished ones for development."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    dep = lambda some: F.map_from_entries(F.array_sort(F.collect_list(F.when(some, F.struct(F.concat(F.lit("@x/o"), "o_orderkey").alias("k"), F.concat(F.lit("^"), "o_orderkey").alias("v"))))))
    done = F.col("o_orderstatus") == "F"
    docs = rows.groupBy("o_custkey").agg(dep(~done).alias("dependencies"), dep(done).alias("devDependencies"))
    return docs.select(F.concat(F.lit("c"), "o_custkey").alias("repo"), F.lit("package.json").alias("path"), F.to_json(F.struct(F.concat(F.lit("@x/c"), "o_custkey").alias("name"), F.lit("1.0.0").alias("version"), "dependencies", "devDependencies")).alias("text"))


def cargo_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Cargo.toml for each supplier: the parts it shipped fifty of, every third by git, every fifth renamed."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select("l_suppkey", "l_partkey").distinct()
    p = F.col("l_partkey").cast("string")
    spec = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit('{ git = "https://github.com/x/p'), p, F.lit('", rev = "abc", version = "0.2" }'))).when(F.col("l_partkey") % 5 == 0, F.concat(F.lit('{ package = "real-p'), p, F.lit('", version = "3" }'))).otherwise('"1.0"')
    body = _joined(rows, "l_suppkey", ["l_partkey"], F.concat(F.lit("p"), p, F.lit(" = "), spec))
    return body.select(F.concat(F.lit("s"), "l_suppkey").alias("repo"), F.lit("Cargo.toml").alias("path"), F.concat(F.lit('[package]\nname = "s'), "l_suppkey", F.lit('"\nversion = "1.0.0"\n\n[dependencies]\n'), "body", F.lit("\n")).alias("text"))


CHANGED_CARGO_SQL = """deps AS (SELECT DISTINCT 'c' || o_custkey AS repo, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    own AS (SELECT CASE WHEN s_suppkey % 50 = 5 THEN 's' || (s_suppkey - 1) WHEN s_suppkey % 50 = 3 THEN 't' || s_suppkey ELSE 's' || s_suppkey END AS crate, 's' || s_suppkey AS repo FROM supplier),
    declared AS (SELECT repo, 's' || s AS want FROM deps WHERE CAST(substr(repo, 2) AS BIGINT) % 20 > 1
                 UNION ALL SELECT DISTINCT repo, 's1' FROM deps WHERE CAST(substr(repo, 2) AS BIGINT) % 20 = 1)"""


def changed_cargo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Manifests, those that arrive later, files that go later (repo, path), and the roster.

    A supplier publishes a crate; a customer depends on those of the suppliers that it ordered from. Later, of
    each fifty suppliers one renames its crate and one publishes its neighbour's too; of twenty customers one goes and one keeps one dependency."""
    suppliers, lines = table(spark, sf_dir, "supplier").select("s_suppkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    deps = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()
    head = lambda name: F.concat(F.lit('[package]\nname = "'), name, F.lit('"\n'))
    row = lambda repo, text: [repo.alias("repo"), F.lit("Cargo.toml").alias("path"), text.cast("binary").alias("content")]
    s, c = F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("c"), "o_custkey")
    body = _joined(deps, "o_custkey", ["l_suppkey"], F.concat(F.lit("s"), "l_suppkey", F.lit(' = "1"')))
    base = suppliers.select(*row(s, head(s))).unionByName(body.select(*row(c, F.concat(head(c), F.lit("[dependencies]\n"), "body", F.lit("\n")))))
    renamed = F.when(F.col("s_suppkey") % 50 == 3, F.concat(F.lit("t"), "s_suppkey")).otherwise(F.concat(F.lit("s"), F.col("s_suppkey") - 1))
    fewer = body.where("o_custkey % 20 = 1").select(*row(c, F.concat(head(c), F.lit('[dependencies]\ns1 = "1"\n'))))
    later = suppliers.where("s_suppkey % 50 in (3, 5)").select(*row(s, head(renamed))).unionByName(fewer)
    gone = body.where("o_custkey % 20 = 0").select(c.alias("repo"), F.lit("Cargo.toml").alias("path"))
    roster = base.select(F.col("repo").alias("slug"), F.concat(F.lit("o/"), "repo").alias("github"))
    return base, later, gone, roster


def server_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server.json for each supplier, which needs its nation's server."""
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nations: a fixed table of 25 rows
    text = F.format_string(
        '{"name": "io.x/s%d", "version": "1.%d", "packages": [{"registryType": "oci", "identifier": "ghcr.io/x/s%d", "version": "1"}, {"registryType": "npm"}], "remotes": [{"type": "sse"}], "_meta": {"x/transports": {"stdio": {"command": "run-s%d"}, "http": {}}, "x/required-deps": {"io.x/n%d": {"minimum-version": "2", "purpose": "data"}}%s}}',
        "s_suppkey", "s_nationkey", "s_suppkey", "s_suppkey", "s_nationkey", F.when(F.col("s_nationkey") % 2 == 0, ', "art.cloister/v1": null').otherwise(""),
    )
    return rows.select(F.concat(F.lit("s"), "s_suppkey").alias("repo"), F.lit("server.json").alias("path"), text.alias("text"))


def cluster_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster.toml for each nation: its suppliers are bundles, wired to the nation; its region is an input."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey")
    k = F.col("s_suppkey").cast("string")
    bundle = F.concat(F.lit('[[bundles]]\nname = "b'), k, F.lit('"\n[bundles.external]\nimage = "ghcr.io/x/s'), k, F.lit(':1"\nentryPoint = "/bin/run-s'), k, F.lit('"\n[[wires]]\nfrom = "b'), k, F.lit('"\nto = "n"\nbinding = "W'), k, F.lit('"'))
    body = _joined(rows, "s_nationkey", ["s_suppkey"], bundle)
    both = body.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit('[metadata]\nname = "n'), "s_nationkey", F.lit('"\n'), "body", F.lit('\n[inputs.region]\nref = "github://x/r'), "n_regionkey", F.lit('/server.json@0abcdef"\nversion = "1"\n[inputs.short]\nnote = "r"\n'))
    return both.select(F.concat(F.lit("n"), "s_nationkey").alias("repo"), F.lit("cluster.toml").alias("path"), text.alias("text"))


def lock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    text = F.concat(F.lit('schema = "v1"\ncluster = "n'), "n_nationkey", F.lit('"\n[inputs.region]\nref = "github://x/r'), "n_regionkey", F.lit('/server.json@0abcdef"\nresolved = "https://h/'), "n_regionkey", F.lit('"\nsha256 = "00"\noci = { identifier = "ghcr.io/x/r'), "n_regionkey", F.lit('", version = "1", digest = "d" }\n[inputs.bare]\nref = "github://x/y/z@12345g"\n'))
    return rows.select(F.concat(F.lit("n"), "n_nationkey").alias("repo"), F.lit("cluster.lock.toml").alias("path"), text.alias("text"))


def workflow_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workflow for each user of events: listens for what it did with a value above 90, dispatches what it did first."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value").where("user_id is not null")
    per = rows.groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(F.col("value") > 90, F.col("event_type")))).alias("heard"), F.min("event_type").alias("sent"))
    listed = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("    types: ["), F.array_join(F.transform("heard", lambda e: F.concat(F.lit("'"), e, F.lit("'"))), ", "), F.lit("]\n"))).otherwise(F.concat(F.lit("\n    types:\n"), F.array_join(F.transform("heard", lambda e: F.concat(F.lit("      - "), e, F.lit("\n"))), "")))
    target = F.when(F.col("user_id") % 3 == 0, F.lit("${TARGET}")).otherwise(F.concat(F.lit("x/u"), F.col("user_id") + 1))
    gap = F.when(F.col("user_id") % 5 == 0, F.lit("\n\n\n\n\n\n")).otherwise(F.lit("\n"))
    text = F.concat(F.lit("on:\n  repository_dispatch:\n"), listed, F.lit("jobs:\n      # gh api repos/x/none/dispatches -f event_type=never\n      gh api repos/"), target, F.lit("/dispatches \\"), gap, F.lit("        -f event_type="), "sent", F.lit("\n"))
    return per.select(F.concat(F.lit("u"), "user_id").alias("repo"), F.lit(".github/workflows/ci.yml").alias("path"), text.alias("text"))


def texts_of(fmt: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return {"gomod": gomod_texts, "npm": npm_texts, "cargo": cargo_texts, "server-json": server_texts, "cluster-toml": cluster_texts, "cluster-lock": lock_texts, "workflow": workflow_texts}[fmt](spark, sf_dir)


def facts_of(fmt: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.collect import parse_manifests

    rows = texts_of(fmt, spark, sf_dir).select("repo", "path", F.col("text").cast("binary").alias("content"))
    return parse_manifests(rows, [fmt])[0][fmt]
