"""The derivation's own contract, the gate's verdicts under mutation, ranks, the picture, inspection, slices and the stream."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import edges, extract, rank
from graphloom.plans import canonical, collect, derive, diagram, gate, inspect
from graphloom.schemas import COLLECTIONS, EDGE_KINDS, endpoints, struct
from graphloom.sources import listing, provider
from graphloom.streaming import upsert

ORIGIN, SITE = "https://example.com", {"name": "x", "url": "https://example.com", "describes": "y"}
FILES = [
    ("alpha", "Cargo.toml", '[package]\nname = "alpha"\n[dependencies]\nbeta-crate = "1"\nserde = "1"\n'),
    ("alpha", ".tool-version", "1.2"),
    ("alpha", ".github/workflows/w.yml", "on:\n  repository_dispatch:\n    types: [built, lost]\n"),
    ("alpha", ".vigil.toml", "x = 1"),
    ("beta", "Cargo.toml", '[package]\nname = "beta-crate"\n[dependencies]\ngamma = { git = "https://github.com/o/gamma.git", rev = "abc" }\n'),
    ("beta", "server.json", '{"name": "io.beta", "_meta": {"x/transports": {"stdio": {"command": "tool"}}}}'),
    ("beta", ".github/workflows/w.yml", "gh api repos/o/alpha/dispatches -f event_type=built\n"),
    ("gamma", "go.mod", "module github.com/o/gamma\nrequire github.com/o/none v1\nrequire github.com/else/x v1\n"),
    ("secret", "go.mod", "module example.com/secret\n"),
]


@pytest.fixture(scope="module")
def lock(spark):
    manifests = spark.createDataFrame([(r, p, t.encode()) for r, p, t in FILES], "repo string, path string, content binary")
    roster = spark.createDataFrame([(s, "o", s, f"o/{s}", True, "/x") for s in ("alpha", "beta", "gamma", "secret")], struct("roster"))
    seen = spark.createDataFrame([("o/alpha", "public"), ("o/beta", "public"), ("o/gamma", "public")], "github string, visibility string")
    return collect.collect(roster, seen, manifests, collected_at="2024-01-01T00:00:00Z")


@pytest.fixture(scope="module")
def graph(lock):
    return derive.derive(lock.lock, ORIGIN, SITE)


def test_collection(lock):
    repos = {r["slug"]: r for r in lock.lock.repos.collect()}
    assert repos["alpha"]["unexamined"] == [".vigil.toml"] and not repos["secret"]["read"] and repos["secret"]["visibility"] == "restricted"
    assert {r["repo"] for r in collect.sources(lock.lock.facts).collect()} == {"alpha", "beta", "gamma"}


def test_derivation(graph):
    got = {(e["from"], e["to"], e["kind"], e["resolved_by"]) for e in graph.edges.collect()}
    assert got == {("alpha", "beta", "library", "crate-name"), ("alpha", "beta", "artifact", "executable-name"), ("alpha", "beta", "event", "dispatch-target"), ("beta", "gamma", "library", "git-url")}
    gaps = {(u["from"], u["want"]) for u in graph.unresolved.collect()}
    assert gaps == {("alpha", "lost"), ("gamma", "github.com/o/none")}  # third parties are counted, not listed
    assert derive.document(graph)["declarations"]["parsed"] == 8
    assert derive.map_text(graph) == derive.map_text(graph)


def test_minimal_lock_derives_one_edge(spark):
    facts = lambda name, deps: {"package": name, "publishes": [name], "workspaceMembers": [], "deps": deps}
    repos = [{"slug": s, "github": f"o/{s}", "visibility": "public", "on_map": True, "read": True} for s in ("alpha", "beta")]
    text = json.dumps({"schema_version": 1, "collected_at": "2024-01-01T00:00:00Z", "private_inclusive": False, "repos": repos, "sources": [{"repo": "alpha", "path": "Cargo.toml", "blob": None, "format": "cargo", "facts": facts("alpha", [{"name": "beta-crate", "version": "1"}])}, {"repo": "beta", "path": "Cargo.toml", "blob": None, "format": "cargo", "facts": facts("beta-crate", [])}]})
    doc = derive.document(derive.derive(collect.load_lock(spark, text), ORIGIN, SITE))
    assert doc["$schema"] == "https://example.com/schema/v1/site-map.json" and len(doc["entities"]) == 2
    assert [(e["from"], e["to"]) for e in doc["edges"]] == [("alpha", "beta")]
    _, issues = gate.schema_issues(spark, doc)
    assert issues.collect() == []


def test_gate(spark, lock, graph):
    lock_text, text = collect.serialize(collect.lock_document(lock.lock)), derive.map_text(graph)
    check = lambda a, b: gate.check_graph(spark, a, b, ORIGIN, SITE)
    assert check(lock_text, text).ok
    assert check("{", text).reason == "lock-unparseable"
    assert check(lock_text, "[").reason == "graph-unparseable"
    doc = json.loads(text)

    def changed(**by):
        return collect.serialize(doc | by)

    assert check(lock_text, changed(edges=doc["edges"][1:])).reason == "divergent"
    assert check(lock_text, changed(schema_version=2)).reason == "schema"
    assert check(lock_text, changed(extra=1)).reason == "schema"
    assert check(lock_text, changed(edges=[doc["edges"][0] | {"kind": "lineage"}])).reason == "schema"
    assert check(lock_text, changed(edges=[doc["edges"][0] | {"resolved_by": "nothing"}])).reason == "schema"
    assert check(lock_text, changed(entities=[doc["entities"][0] | {"kind": "project"}])).reason == "schema"
    assert "First difference at line" in check(lock_text, changed(note="other")).message


def test_strict_lock(lock):
    import copy

    doc = json.loads(collect.serialize(collect.lock_document(lock.lock)))
    assert gate.lock_issues(doc) == []
    at = {s["format"]: n for n, s in enumerate(doc["sources"])}

    def broken(change):
        other = copy.deepcopy(doc)
        change(other)
        return gate.lock_issues(other)

    n = at["gomod"]
    assert broken(lambda d: d.pop("note")) == [("note", "is missing")]
    assert broken(lambda d: d.update(extra=1)) == [("extra", "is no key of the contract")]
    assert broken(lambda d: d["sources"][n].update(format="gradle")) == [(f"sources.{n}.format", "is no format")]
    assert broken(lambda d: d["sources"][n].pop("blob")) == [(f"sources.{n}.blob", "is missing")]
    assert broken(lambda d: d["sources"][n]["facts"].update(more=1)) == [(f"sources.{n}.facts.more", "is no key of the contract")]
    assert broken(lambda d: d["sources"][n]["facts"].update(requires=None)) == [(f"sources.{n}.facts.requires", "must be a list")]
    assert broken(lambda d: d["sources"][n]["facts"].update(replaces=[{"path": None, "version": None, "with": "x", "withVersion": None, "local": 1, "line": "3"}])) == [
        (f"sources.{n}.facts.replaces.0.path", "must not be null"), (f"sources.{n}.facts.replaces.0.local", "must be true or false"), (f"sources.{n}.facts.replaces.0.line", "must be a whole number")]
    assert broken(lambda d: d["repos"][0].update(visibility="secret")) == [("repos.0.visibility", "is no visibility")]


def test_private_detail_is_taken_out(spark, graph):
    from graphloom.operators import edges as E

    people = graph.entities.select("id", F.when(F.col("id") == "gamma", "restricted").otherwise("public").alias("repo_visibility"), F.col("sources_read"))
    raw = graph.edges
    assert E.privacy_violations(raw, raw.limit(0), people).count() > 1
    safe = E.redact(raw, people)
    assert [r["message"] for r in E.privacy_violations(safe, safe.limit(0), people).collect()] == ["gamma is restricted but the lock claims its manifests were read"]
    assert {(r["from"], r["redacted"]) for r in safe.collect()} == {("alpha", False), ("beta", True)}


def test_digest_ignores_the_moment_only(lock):
    doc = collect.lock_document(lock.lock)
    assert collect.canonical_lock_digest(doc) == collect.canonical_lock_digest(doc | {"collected_at": "later"})
    assert collect.canonical_lock_digest(doc) != collect.canonical_lock_digest(doc | {"note": "other"})


def test_slices(graph):
    one = derive.slice_for(graph, "alpha", ORIGIN)
    assert [g["project"] for g in one["depends_on"]] == ["beta"] and one["depends_on"][0]["kinds"] == ["artifact", "event", "library"]
    assert set(one["resolution"]) == {"crate-name", "executable-name", "dispatch-target"} and one["entity"]["id"] == "alpha"
    assert derive.slice_for(graph, "nobody", ORIGIN)["entity"] is None


def test_ranks_and_picture(spark, graph):
    with pytest.raises(ValueError, match="not read"):
        rank.rank_entities(graph.entities, graph.edges)
    graph = derive.SiteMap(**{**graph.__dict__, "entities": graph.entities.where("sources_read")})
    assert {r["id"]: r["rank"] for r in rank.rank_entities(graph.entities, graph.edges).collect()} == {"alpha": 2, "beta": 1, "gamma": 0}
    svg = diagram.render(graph)
    assert svg == diagram.render(graph) and svg.count('class="edge edge--exact"') == 5 and "3 repositories, 4 established couplings and 0 not" in svg
    loop = graph.edges.unionByName(graph.edges.where("resolved_by = 'git-url'").withColumn("from", F.lit("gamma")).withColumn("to", F.lit("alpha")))
    with pytest.raises(ValueError, match="alpha → beta → gamma → alpha"):
        rank.rank_entities(graph.entities, loop)


def _plain_ranks(edges, nodes):
    out = {}

    def of(n):
        stack = [n]
        while stack:
            at = stack[-1]
            wait = [t for t in edges.get(at, ()) if t not in out]
            if wait:
                stack += wait
            else:
                out[at] = max((out[t] + 1 for t in edges.get(at, ())), default=0)
                stack.pop()

    for n in nodes:
        of(n)
    return out


def _ranked(spark, nodes, pairs):
    entities = spark.createDataFrame([(n, True) for n in nodes], "id string, sources_read boolean")
    return rank.rank_entities(entities, spark.createDataFrame(pairs, "from string, to string"))


@pytest.fixture
def rounds(monkeypatch):
    """Counts the tables that ranks write."""
    seen, plain = [], rank.written
    monkeypatch.setattr(rank, "written", lambda df: seen.append(1) or plain(df))
    return seen


def test_ranks_of_graphs(spark):
    import random

    draw = random.Random(3)
    for n, many in ((1, 0), (40, 60), (60, 59), (30, 200)):
        nodes = [f"n{k:03}" for k in range(n)]
        pairs = sorted({tuple(sorted(draw.sample(nodes, 2), reverse=True)) for _ in range(many)}) if n > 1 else []
        ways = {}
        for a, b in pairs:
            ways.setdefault(a, []).append(b)
        got = {r["id"]: r["rank"] for r in _ranked(spark, nodes, pairs).collect()}
        assert got == _plain_ranks(ways, nodes)


def test_ranks_of_a_deep_chain(spark, rounds):
    """3000 nodes in a chain that branches now and then: rounds follow its bits, not its depth."""
    n = 3000
    pairs = [(f"n{k:05}", f"n{k - 1:05}") for k in range(1, n)] + [(f"n{k:05}", f"n{k - 500:05}") for k in (700, 2999)]
    got = {r["id"]: r["rank"] for r in _ranked(spark, [f"n{k:05}" for k in range(n)], pairs).collect()}
    assert got == {f"n{k:05}": k for k in range(n)} and len(rounds) < 60


@pytest.mark.parametrize("walked", [1 << 17, 0])
def test_cycles(spark, monkeypatch, walked):
    monkeypatch.setattr(rank, "WALKED", walked)
    ring = [(f"n{k:04}", f"n{(k + 1) % 700:04}") for k in range(700)]
    other = [("x1", "x2"), ("x2", "x1"), ("t2", "t1"), ("t1", "n0005"), ("end", "x1")]
    for pairs in (ring + other, [*ring, ("n0003", "n0001"), ("n0003", "sink"), ("up", "n0003"), ("up", "sink")], [("a", "b"), ("b", "a")]):
        nodes = sorted({x for p in pairs for x in p})
        with pytest.raises(ValueError, match="cycle") as failed:
            _ranked(spark, nodes, pairs)
        path = str(failed.value).split(": ")[1].split(" → ")
        assert path[0] == path[-1] and len(set(path)) == len(path) - 1 and set(zip(path, path[1:], strict=False)) <= set(pairs)


def test_inspection(spark):
    files = [("r", "go.mod", "module example.com/me\nrequire (\n\texample.com/lib/sub v1\n\texample.com/none v1\n)\n"), ("r", "Taskfile.yml", ""), ("r", "package.json", "{")]
    manifests = spark.createDataFrame([(r, p, t.encode()) for r, p, t in files], "repo string, path string, content binary")
    published = spark.createDataFrame([(0, "example.com/lib", "go-module-path", "lib", "go.mod", True)], "ord int, coordinate string, kind string, repo string, `where` string, contested boolean")
    text = inspect.format_report(inspect.inspect_repo("/x/r/", manifests, published, "file:///i"))
    assert "  lib  example.com/lib/sub  [go-module-path]  via example.com/lib  ** CONTESTED **" in text
    assert "not in the published index (1)\n  example.com/none  [go-module-path]  go.mod" in text
    assert "package.json: npm parse failed" in text and "read but not resolved here: taskfile" in text


def test_checkouts_and_index_are_read(spark, tmp_path):
    for name in ("Cargo.toml", ".github/workflows/a.yml", ".git/config", "vendor/go.mod", ".go-version", "a/b/c/d/e/go.mod", "a/b/c/d/e/f/go.mod", "a b/package.json"):
        (tmp_path / "c" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / name).write_text("x")
    got = {r["path"]: r["content"] for r in listing.read_checkouts(spark, {"r": str(tmp_path / "c")}).collect()}
    assert set(got) == {"Cargo.toml", ".github/workflows/a.yml", ".go-version", "a/b/c/d/e/go.mod", "a b/package.json"}
    assert got["a/b/c/d/e/go.mod"] is None and got[".go-version"] == b"x"  # too deep to be read
    (tmp_path / "i.json").write_text('{"schema_version": 1, "ownership": [{"coordinate": "a", "kind": "k", "repo": "r", "where": null, "contested": false}]}')
    assert [(r["ord"], r["coordinate"], r["contested"]) for r in listing.read_index(spark, str(tmp_path / "i.json")).collect()] == [(0, "a", False)]
    (tmp_path / "j.json").write_text('{"schema_version": 1}')
    with pytest.raises(Exception, match="no ownership index"):
        listing.read_index(spark, str(tmp_path / "j.json")).collect()


def test_numbers_have_no_exponent(spark):
    """The places of a picture of very many nodes: x above ten million."""
    told = {10049171.0: "10049171", 10042931.5: "10042931.5", 123456789012.25: "123456789012.25", -40000000.5: "-40000000.5", 2e15: "2000000000000000", 7.0: "7", 0.1: "0.1", 0.0: "0"}
    rows = spark.createDataFrame([(x,) for x in told], "x double")
    assert {r[0]: r[1] for r in rows.select("x", text.number(F.col("x"))).collect()} == told


def test_git_ids(spark):
    from graphloom.functions.text import git_blob_sha

    rows = spark.createDataFrame([(b"",), (b"hello\n",)], "c binary").select(git_blob_sha(F.col("c")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["e69de29bb2d1d6434b8b29ae775ad8c2e48c5391", "ce013625030ba8dba906f756967f9e9ca394464a"]


def test_bad_listing_and_roster_raise(spark):
    with pytest.raises(Exception, match="status 500"):
        spark.range(1).select(listing.visibility(F.lit(500))).collect()
    from graphloom.functions.paths import entry_from_github

    with pytest.raises(Exception, match="owner/repo"):
        spark.range(1).select(entry_from_github(F.lit("a/b/c"))).collect()


def test_vocabularies():
    assert set(COLLECTIONS) == set(gate._LISTS) and sum(x[1] for x in endpoints("a", "b")) == 1
    assert len(EDGE_KINDS) == 6 and "Authorization" not in listing.api_headers()


def test_stream_of_sources(spark, tmp_path):
    def put(name, *rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("repo", "path", "content", "seq"), r, strict=True))) for r in rows))

    def run():
        q = upsert.start_upserts(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "ck"))
        q.awaitTermination()
        return {(r["repo"], r["path"]): (r["content"], r["seq"]) for r in upsert.state_table(spark, str(tmp_path / "state")).collect()}

    put("1.json", ("a", "go.mod", "x", 1), ("a", "go.mod", "y", 2))
    assert run() == {("a", "go.mod"): ("y", 2)}
    put("2.json", ("a", "go.mod", "late", 1), ("b", "go.mod", "z", 1))
    assert run() == {("a", "go.mod"): ("y", 2), ("b", "go.mod"): ("z", 1)}


def test_gate_reads_a_lock_as_the_derivation_does(spark):
    """A lock without notes and most fields is one, a map that is no object breaks the contract, and strictness is its own operator."""
    repos = [{"slug": s, "github": f"o/{s}", "visibility": "public", "on_map": True, "read": True} for s in ("alpha", "beta")]
    facts = lambda name, deps: {"package": name, "publishes": [name], "workspaceMembers": [], "deps": deps}
    sources = [{"repo": "alpha", "path": "Cargo.toml", "blob": None, "format": "cargo", "facts": facts("alpha", [{"name": "beta-crate", "version": "1"}])}, {"repo": "beta", "path": "Cargo.toml", "blob": None, "format": "cargo", "facts": facts("beta-crate", [])}]
    lock_text = json.dumps({"schema_version": 1, "collected_at": "2024-01-01T00:00:00Z", "private_inclusive": False, "repos": repos, "sources": sources})
    text = derive.map_text(derive.derive(collect.load_lock(spark, lock_text), ORIGIN, SITE))
    assert gate.check_graph(spark, lock_text, text, ORIGIN, SITE).ok
    assert gate.lock_issues(json.loads(lock_text))
    verdict = gate.check_graph(spark, lock_text, "[]", ORIGIN, SITE)
    assert verdict.reason == "schema" and "<root>" in verdict.message
    assert gate.check_graph(spark, lock_text, text + "x", ORIGIN, SITE).reason == "graph-unparseable"
    assert gate.check_graph(spark, lock_text, text + "\n", ORIGIN, SITE).reason == "divergent"


def test_documents_in_pieces(spark, graph, tmp_path):
    text = derive.map_text(graph)
    assert text == collect.serialize(derive.document(graph))
    canonical.write(derive.map_pieces(graph), str(tmp_path / "map.json"))
    assert (tmp_path / "map.json").read_text() == text
    assert canonical.digest(derive.map_pieces(graph)) == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    whole = spark.createDataFrame([("x",)], "x string")
    for change in (lambda t: t, lambda t: t[:-1], lambda t: t + "more\n", lambda t: t.replace("alpha", "alphb", 3), lambda t: "", lambda t: t.replace("\n", "\r\n", 1)):
        made = change(text)
        told = whole.select(edges.first_difference(F.lit(text), F.lit(made)).alias("d")).first()["d"]
        assert canonical.first_difference(derive.map_pieces(graph), made) == (None if told is None else (told["line"], told["context"]))
    rows = derive.map_lists(graph)
    assert canonical.unlike(rows["edges"], rows["edges"]).isEmpty()
    assert canonical.unlike(rows["edges"], rows["edges"].limit(1)).count() == rows["edges"].count() - 1


def test_providers_give_equal_tables(spark, tmp_path):
    files = [(r, p, t.encode()) for r, p, t in FILES] + [("odd name/é", "Cargo.toml", b"\xff"), ("odd name/é", ".github/workflows/a.yaml", b""), ("odd name/é", "deep/a/b/go.mod", b"module x"), ("odd name/é", "README.md", b"x")]
    df = spark.createDataFrame(files, "repo string, path string, content binary")
    told = []
    for kind in ("checkout", "prefetched", "contents"):
        provider.write_repositories(df, f"file://{tmp_path}/{kind}", kind)
        told.append(sorted(map(tuple, provider.read_repositories(spark, f"file://{tmp_path}/{kind}", kind).collect()), key=str))
    assert told[0] == told[1] == told[2] and len(told[0]) == len(files)
    by = {(r, p): (blob, body) for r, p, blob, _, body in told[0]}
    assert by["odd name/é", "README.md"] == (None, None) and by["odd name/é", "Cargo.toml"][1] == b"\xff"
    assert by["alpha", ".tool-version"][0] == hashlib.sha1(b"blob 3\x001.2").hexdigest()
    facts, _ = collect.parse_manifests(provider.read_repositories(spark, f"file://{tmp_path}/prefetched", "prefetched").select("repo", "path", "content"))
    assert facts["cargo"].where("repo in ('alpha', 'beta')").count() == 2 and facts["gomod"].where("repo = 'odd name/é'").count() == 1
    (tmp_path / "prefetched" / "alpha" / "bodies" / "Cargo.toml").unlink()
    gone = provider.read_repositories(spark, f"{tmp_path}/prefetched", "prefetched").where("repo = 'alpha' and path = 'Cargo.toml'").first()
    assert gone["content"] is None
    with pytest.raises(ValueError, match="file system"):
        provider.local_path("s3://x/y")


def test_locks_in_a_table(spark):
    good = {"schema_version": 1, "note": "n", "collected_at": "x", "private_inclusive": False, "repos": [], "sources": []}
    texts = [json.dumps(good), "{", "[]", None, json.dumps(good | {"more": 1}), json.dumps({k: v for k, v in good.items() if k != "repos"})]
    df = spark.createDataFrame([(str(k), t, 1) for k, t in enumerate(texts)], "lock string, text string, path int")
    got = sorted(map(tuple, gate.lock_table_issues(df).collect()))
    want = [(str(k), *i) for k, t in enumerate(texts) for i in (gate.lock_issues(json.loads(t)) if t and t[0] == "{" and len(t) > 1 else [("<root>", "must be an object")])]
    assert got == sorted(want) and len(got) == 5
    assert gate.lock_table_issues(df.limit(0)).collect() == []


def test_blocks_of_a_module_file_take_linear_time(spark):
    for text, want in (("require (\n a v1\n)\n" * 10_000, (10_000, 0)), (")\n" * 10_000, (0, 0)), ("replace (\n" + " a => ../b\n" * 10_000 + ")\n", (0, 10_000))):
        row = spark.createDataFrame([(text,)], "text string").select(extract.gomod(F.col("text")).alias("f")).select(F.size("f.requires"), F.size("f.replaces"))
        began = time.time()
        assert tuple(row.first()) == want and time.time() - began < 20


def test_rounds_of_ranks_send_no_tables_through_the_driver(spark, monkeypatch):
    """Tables of the graph's size are shuffled in every round, also while they are small enough to be broadcast."""
    plans, write = [], rank.written
    monkeypatch.setattr(rank, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    single = spark.createDataFrame([(f"n{i}", 0, f"n{i - 1}", 1) for i in range(1, 6)], "id string, base int, to string, w int")
    chains, ends = rank._chains(single)
    assert ends and {(r["id"], r["to"], r["w"]) for r in chains.collect()} == {(f"n{i}", "n0", i) for i in range(1, 6)}
    assert plans and not any("BroadcastExchange" in p for p in plans)


def test_pairs_of_one_event_are_many_tasks(spark):
    """An event that everyone listens for and dispatches: all pairs are found, dealt by cells of its dispatchers."""
    from graphloom.operators import resolve

    names = [f"u{i}" for i in range(100)]
    listens = spark.createDataFrame([(n, "e") for n in names], "from string, want string")
    sent = spark.createDataFrame([(n, ("e", None, None)) for n in names], "repo string, d struct<event: string, owner: string, repo: string>")
    repos = spark.createDataFrame([(n, f"x/{n}") for n in names], "slug string, github string")
    found = resolve.resolve_events(listens, sent, repos).select("from", "to", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["from"], r["to"]) for r in found) == sorted((a, b) for a in names for b in names if a != b)
    assert len({r["task"] for r in found}) > 8


def test_parts_that_are_the_same_are_compared_without_being_sent(spark, monkeypatch):
    table = canonical.rendered(spark.range(400).selectExpr("id", "concat('é', id) as name").repartition(3), ["id"])
    none = canonical.rendered(spark.range(0).selectExpr("id"), ["id"])
    sections = [("a", {"x": 1}), ("rows", table), ("none", none), ("z", [1])]
    text = "".join(canonical.pieces(sections))
    broken = [text.replace("é7\"", "e7\""), text.replace("é399", "é39"), text[:-300], text[:900], "", text + "x", text.replace('"x": 1', '"x": 2'), text.replace("[]", "[ ]")]
    for other in broken:
        assert other != text
        assert canonical.first_difference(canonical.pieces(sections, other), other) == canonical.first_difference(canonical.pieces(sections), other) is not None
    assert "".join(canonical.pieces(sections, text)) == text
    monkeypatch.setattr(type(table), "toLocalIterator", lambda *_: pytest.fail("rows were sent"))
    assert canonical.first_difference(canonical.pieces(sections, text), text) is None


def test_documents_are_compared_by_tasks(spark, graph, monkeypatch):
    """Maps as tables of rows: their texts, first differences and verdicts are those of the texts, and no list comes to the driver."""
    table = canonical.rendered(spark.range(400).selectExpr("id", "concat('é', id) as name").repartition(3), ["id"])
    none = canonical.rendered(spark.range(0).selectExpr("id"), ["id"])
    doc = canonical.document([("a", {"x": 1}), ("rows", table), ("none", none), ("z", [1]), ("few", table.limit(2))])
    text = "".join(doc.pieces())
    assert text == "".join(canonical.pieces([("a", {"x": 1}), ("rows", table), ("none", none), ("z", [1]), ("few", table.limit(2))]))
    rows = doc.tables()["rows"]
    changed = lambda at, new: rows.select("pos", F.when(F.col("pos") == at, new).otherwise(F.col("text")).alias("text"))
    others = [doc.with_section("rows", changed(k, "    {\n      \"id\": 1\n    }")) for k in (0, 5)]
    others += [doc.with_section("rows", rows.where(f"pos < {k}")) for k in (3, 399)] + [doc.with_section("rows", changed(77, "7,\n8"))]
    others += [doc.with_section("none", rows.where("pos < 1")), doc.with_section("few", rows.where("pos < 0"))]
    others += [canonical.Document(doc.sections, ""), canonical.Document(doc.sections[:4])]
    for other in others:
        assert canonical.document_difference(doc, other) == canonical.first_difference([text], "".join(other.pieces())) is not None
    assert canonical.document_difference(doc, doc) is None
    own, text = derive.map_document(graph), derive.map_text(graph)
    edges_, entities = own.tables()["edges"], own.tables()["entities"]
    made = [own, own.with_section("edges", edges_.where("pos > 0").select((F.col("pos") - 1).alias("pos"), "text")), own.with_section("schema_version", 9)]
    made.append(own.with_section("entities", entities.mapInArrow(gate._restricted(["alpha"]), "pos long, text string")))
    monkeypatch.setattr(type(table), "toLocalIterator", lambda *_: pytest.fail("rows were sent"))
    told = [gate.judge(lambda: graph, spark, m) for m in made]
    monkeypatch.undo()
    assert told == [gate.judge(lambda: graph, spark, "".join(m.pieces())) for m in made] and [t.reason for t in told] == [None, "divergent", "schema", "divergent"]
    broken = own.with_section("edges", edges_.select("pos", F.when(F.col("pos") == 1, "{").otherwise(F.col("text")).alias("text")))
    assert {gate.judge(lambda: graph, spark, m).reason for m in (broken, canonical.Document(own.sections, ""))} == {"graph-unparseable"}
