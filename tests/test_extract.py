"""Expected facts were written from the formats' rules; each case has a near miss that must stay silent."""

import pytest
from pyspark.sql import functions as F

from graphloom.plans.collect import parse_manifests


@pytest.fixture(scope="module")
def facts(spark):
    def run(path, text):
        rows = spark.createDataFrame([("r", path, text.encode())], "repo string, path string, content binary")
        parsed, notes = parse_manifests(rows)
        found = [r for f in parsed.values() for r in f.select("format", "blob", F.to_json("facts").alias("j"), "facts").collect()]
        return (found[0]["facts"].asDict(True) if found else None), [r["message"] for r in notes.collect()]

    return run


def test_gomod(facts):
    text = "module example.com/a\n\nrequire example.com/x v1.0.0 // indirect\nrequire (\n\texample.com/b v1.2.3\n\t// only a comment\n\tlonely\n)\nreplace example.com/b => ../b\nreplace (\n\texample.com/c v1 => example.com/d v2\n\tbad => x => y\n)\nexclude (\n\texample.com/z v9\n)\nretract (\n\tv1\n)\nrequire ( // no opener\nexample.com/never v1\n"
    got, notes = facts("go.mod", text)
    assert got["module"] == "example.com/a" and notes == []
    assert [(r["path"], r["version"], r["indirect"], r["line"]) for r in got["requires"]] == [("example.com/b", "v1.2.3", False, 5), ("example.com/x", "v1.0.0", True, 3)]
    assert [(r["path"], r["version"], r["with"], r["withVersion"], r["local"]) for r in got["replaces"]] == [("example.com/b", None, "../b", None, True), ("example.com/c", "v1", "example.com/d", "v2", False)]


def test_cargo(facts):
    text = '[package]\nname = "a"\nversion.workspace = true\n\n[dependencies]\nb = "1"\n\nc = { git = "https://github.com/o/c", rev = "abc", version = "0.2" }\n[dev-dependencies]\nb = { path = "../b" }\n[workspace]\nmembers = ["z", "y"]\n[workspace.dependencies]\nd = { package = "real", version = "3" }\n[target.\'cfg(unix)\'.build-dependencies]\ne = "4"\n'
    got, _ = facts("sub/Cargo.toml", text)
    deps = {(d["name"], d["table"]): d for d in got["deps"]}
    assert got["package"] == {"name": "a", "version": None} and got["workspaceMembers"] == ["y", "z"]
    assert deps["b", "dependencies"]["line"] is None  # the key stands twice
    c = deps["c", "dependencies"]
    assert (c["version"], c["rev"], c["line"]) == ("0.2", "abc", 7)  # the blank line above belongs to the match
    assert deps["d", "workspace.dependencies"]["package"] == "real"
    assert deps["e", "target.cfg(unix).build-dependencies"]["version"] == "4"
    assert [d["name"] for d in got["deps"]] == ["b", "b", "c", "d", "e"]


def test_npm(facts):
    got, _ = facts("package.json", '{"name": "p", "private": true, "dependencies": {"b": "^1", "a": {"x": 1}}, "optionalDependencies": {"a": "2"}, "other": {"z": "1"}}')
    assert got["publishes"] == ["p"] and [(d["name"], d["table"], d["spec"]) for d in got["deps"]] == [("a", "dependencies", None), ("a", "optionalDependencies", "2"), ("b", "dependencies", "^1")]
    got, _ = facts("package.json", '{"name": ""}')
    assert got["publishes"] == [] and got["deps"] == []


def test_server(facts):
    text = '{"name": "n", "packages": [{"identifier": "ghcr.io/x"}, {"registryType": "npm"}], "_meta": {"k/transports": {"stdio": {"command": "run"}, "http": {"command": 1}}, "k/required-deps": {"o": {"minimum-version": "2"}}, "k/required": {"no": {}}, "art.cloister/v1": null}}'
    got, _ = facts("server.json", text)
    assert got["publishes"] == ["n", "ghcr.io/x"] and [c["command"] for c in got["commands"]] == ["run"]
    assert [(d["server"], d["minimumVersion"], d["purpose"]) for d in got["requiredDeps"]] == [("o", "2", None)] and got["declaresCloisterTenancy"] is True
    assert facts("server.json", '{"_meta": {"art.cloister/v2": {}}}')[0]["declaresCloisterTenancy"] is False


def test_cluster(facts):
    text = '[metadata]\nname = "c"\n[[bundles]]\nname = "b"\n[bundles.deployment]\nimage = "ghcr.io/o/b:1"\n[[wires]]\nfrom = "b"\nto = "d"\n[inputs.one]\nref = "github://o/r/p/server.json@abcdef1"\n[inputs.two]\nref = "github://o/r/p@abcdef"\n'
    got, _ = facts("cluster.toml", text)
    assert [(i["key"], i["owner"], i["path"], i["rev"], i["line"]) for i in got["inputs"]] == [("one", "o", "p/server.json", "abcdef1", None), ("two", None, None, None, None)]
    assert got["bundles"][0]["image"] == "ghcr.io/o/b:1" and got["wires"][0]["to"] == "d"
    got, _ = facts("cluster.lock.toml", 'schema = "s"\n[inputs.a]\nref = "github://o/r/p@abcdef1"\noci = { identifier = "i", version = "1", digest = "d" }\n[inputs.b]\nresolved = "x"\n')
    assert [(i["key"], i["repo"], i["resolved"], i["oci"]) for i in got["inputs"]] == [("a", "r", None, {"identifier": "i", "version": "1", "digest": "d"}), ("b", None, "x", None)]


@pytest.mark.parametrize(("name", "text", "want"), [(".go-version", " v1.2.3\n", ("go", "v1.2.3")), (".a-b-version", "1.2-rc.1", ("a-b", "1.2-rc.1")), (".go-version", "latest", None), (".go-version", "1.2.", None)])
def test_pins(facts, name, text, want):
    got, notes = facts(name, text)
    assert (got and (got["tool"], got["version"])) == want and notes == []


def test_taskfile(facts):
    got, _ = facts("Taskfile.yml", "x: github.com/o/r/releases/download/v1 y github.com/a/b/releases/download github.com/o/r/releases/download github.com/no/no/releases/tag")
    assert [(r["owner"], r["repo"]) for r in got["releaseRepos"]] == [("a", "b"), ("o", "r")]


def test_workflow(facts):
    text = "on:\n  repository_dispatch:\n    types: [a, 'b', \"c\"]\n  other:\n  repository_dispatch:\n\n    types:\n      - one\n      - 'two'\n      # ends the list\n      - three\n  repository_dispatch:\n    branches: x\n    types: [never]\njobs:\n  gh api repos/o/r/dispatches \\\n\n\n\n\n    -f event_type=near\n  # gh api repos/o/q/dispatches -f event_type=no\n  gh api repos/${T}/dispatches -f event_type=dyn\n  gh api repos/o/far/dispatches\n\n\n\n\n\n    event_type=far\n"
    got, _ = facts(".github/workflows/a.yml", text)
    assert got["listensFor"] == ["a", "b", "c", "one", "two"]
    assert [(x["event"], x["owner"], x["repo"]) for x in got["dispatches"]] == [("dyn", None, None), ("near", "o", "r")]


@pytest.mark.parametrize(("path", "text"), [("Cargo.toml", "a = "), ("package.json", "{"), ("server.json", "nope"), ("cluster.toml", "[x"), ("cluster.lock.toml", "=")])
def test_what_does_not_parse_is_a_note(facts, path, text):
    got, notes = facts(path, text)
    assert got is None and len(notes) == 1 and notes[0].startswith(f"{path}: ") and "parse failed" in notes[0]


def test_empty_texts(facts):
    assert facts("go.mod", "")[0] == {"module": None, "publishes": [], "requires": [], "replaces": []}
    assert facts(".github/workflows/x.yaml", "")[0] == {"listensFor": [], "dispatches": []}
    assert facts("node_modules/package.json", '{"name": "x"}') == (None, [])


def test_a_manifest_is_parsed_once(spark):
    """Conditions on facts and explosions of them are not pushed below the parser, which would run again for each."""
    from graphloom.operators import index

    rows = spark.createDataFrame([("r", "go.mod", b"module a\nrequire example.com/b v1\n")], "repo string, path string, content binary")
    gomod = parse_manifests(rows, ["gomod"])[0]
    for table in (gomod["gomod"].where("size(facts.replaces) = 0"), index.declarations(gomod)):
        assert table.count() == 1
        assert table._jdf.queryExecution().optimizedPlan().toString().count("|exclude|retract") == 1


def test_lines_of_bare_keys_in_one_pass_are_those_of_each_key(spark):
    """What line_of finds for each key by itself, whatever stands around it; and many keys in one manifest take no square of time."""
    import random
    import time

    from graphloom.functions.text import bare_key_lines, line_of, line_of_key

    rng = random.Random(5)
    bits = ["a", "b", '"a"', '"b"', "a-b", "ab", " ", "\n", "\n\n", "=", " = ", "#", "\r\n", "\u2028", "\t", '"a b"', ".", "a = 1\n", "[a]\n", "x.y*z", "'a'"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    keys = ["a", "b", "a-b", "ab", "a b", "x.y*z", "", "a\n"]
    rows = spark.createDataFrame([(t, k) for t in texts for k in keys], "t string, k string")
    told = rows.select("t", "k", line_of("t", F.col("k")).alias("one"), line_of_key("t", bare_key_lines("t"), F.col("k")).alias("all"))
    assert told.where("one is not null").count() > 500
    assert told.where("not (one <=> all)").count() == 0

    many = "[dependencies]\n" + "".join(f'dependency-{i} = "1"\n' for i in range(12000))
    start = time.time()
    facts = parse_manifests(spark.createDataFrame([("r", "Cargo.toml", many.encode())], "repo string, path string, content binary"), ["cargo"])[0]["cargo"]
    deps = facts.select(F.explode("facts.deps").alias("d")).select("d.*")
    assert deps.where("line <> 2 + cast(substring(name, 12) as int)").count() == 0 and deps.where("line is null").count() == 0
    assert time.time() - start < 40
