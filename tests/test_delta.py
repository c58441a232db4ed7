"""Derivation of changes against full derivations of the same manifests."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.operators import index, resolve
from graphloom.plans import collect, delta
from graphloom.schemas import FORMATS
from graphloom.sources.store import shared_folder

EDGE = ["from", "to", "kind", "resolved_by", "matched", "resolves_from", "resolves_via", "detail", "version", "rev", "evidence"]
ROSTER = [(s, f"o/{s}") for s in ("alpha", "beta", "gamma", "delta", "host")]
FILES = {
    ("alpha", "Cargo.toml"): '[package]\nname = "alpha"\n[dependencies]\nbeta-crate = "1"\nserde = "1"\ngamma = { git = "https://github.com/o/Gamma.git", rev = "abc" }\n',
    ("alpha", ".tool-version"): "1.2",
    ("alpha", ".github/workflows/w.yml"): "on:\n  repository_dispatch:\n    types: [built, lost]\n",
    ("beta", "Cargo.toml"): '[package]\nname = "beta-crate"\n',
    ("beta", "server.json"): '{"name": "io.beta", "_meta": {"x/transports": {"stdio": {"command": "tool"}}, "art.cloister/v1": null}}',
    ("beta", ".github/workflows/w.yml"): "gh api repos/o/alpha/dispatches -f event_type=built\n",
    ("gamma", "go.mod"): "module example.com/gamma\nrequire example.com/deep/a/b/c v1\nrequire github.com/else/x v1\n",
    ("delta", "go.mod"): "module example.com/deep\n",
    ("delta", "package.json"): '{"name": "@o/delta", "dependencies": {"@o/none": "1"}}',
    ("host", "cluster.toml"): '[metadata]\nname = "h"\n[[bundles]]\nname = "b"\n[bundles.external]\nimage = "ghcr.io/o/alpha:1"\nentryPoint = "/bin/tool"\n[[wires]]\nfrom = "b"\nto = "beta"\nbinding = "W"\n',
}


def manifests(spark, files):
    return spark.createDataFrame([(r, p, None if t is None else t.encode()) for (r, p), t in files.items()], "repo string, path string, content binary")


def roster(spark, rows):
    return spark.createDataFrame(rows, "slug string, github string")


def rows(df):
    return sorted(str(r) for r in df.collect())


def full(spark, files, repos):
    """Edges, gaps and ownership of a derivation from nothing."""
    formats = sorted({f for _, p in files for f in FORMATS if f == {"Cargo.toml": "cargo", "go.mod": "gomod"}.get(p)} if all(p in ("Cargo.toml", "go.mod") for _, p in files) else FORMATS)
    facts, _ = collect.parse_manifests(manifests(spark, files), formats)
    facts = collect.settled(facts)
    owned = index.build_ownership(index.publishes(facts, executables=True))
    found = resolve.resolve_all(index.declarations(facts), owned, facts, repos)
    return rows(resolve.to_edges(found).select(EDGE)), rows(resolve.unresolved(found, repos)), rows(owned)


def kept(state):
    return rows(delta.edges(state).select(EDGE)), rows(delta.unresolved(state)), rows(delta.ownership(state))


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"


def test_each_kind_of_change_equals_a_full_derivation(spark, folder):
    files, repos = dict(FILES), list(ROSTER)
    state = delta.state_of(spark, folder, 4)
    delta.advance(state, manifests(spark, files), roster=roster(spark, repos))
    assert kept(state) == full(spark, files, roster(spark, repos)) and kept(state)[0]
    steps = [
        (
            {
                ("beta", "Cargo.toml"): '[package]\nname = "renamed"\n',  # a claim goes: alpha's edge with it
                ("delta", "go.mod"): "module example.com/deep/a\n",
                ("host", "go.mod"): "module example.com/deep/a/b\n",  # a longer prefix
                ("beta", ".github/workflows/w.yml"): "gh api repos/${T}/dispatches -f event_type=built\ngh api repos/${T}/dispatches -f event_type=lost\n",
            },
            [],
            None,
        ),
        (
            {("alpha", "cluster.toml"): '[metadata]\nname = "a"\n', ("host", "package.json"): "{broken", ("delta", "package.json"): None},  # another host
            [("beta", "Cargo.toml"), ("beta", "never.toml")],
            [*ROSTER[:2], ("gamma", "p/moved"), ("beta2", "o/beta"), ("tool", "o/tool")],
        ),
    ]
    for arrived, gone, listed in steps:
        repos = listed or repos
        files |= arrived
        files = {k: v for k, v in files.items() if k not in gone}
        away = spark.createDataFrame(gone, "repo string, path string") if gone else None
        delta.advance(state, manifests(spark, arrived), away, roster(spark, listed) if listed else None)
        assert kept(state) == full(spark, files, roster(spark, repos)), arrived
    assert kept(delta.state_of(spark, folder, 4)) == kept(state)


def test_only_what_depends_on_a_change_is_resolved_again(spark, folder):
    files = {(f"r{i:02}", "Cargo.toml"): f'[package]\nname = "c{i}"\n[dependencies]\nc{(i + 1) % 40} = "1"\n' for i in range(40)}
    state = delta.state_of(spark, folder, 16)
    delta.advance(state, manifests(spark, files), roster=roster(spark, [(r, f"o/{r}") for r, _ in files]))
    change = delta.advance(state, manifests(spark, {("r05", "Cargo.toml"): '[package]\nname = "other"\n[dependencies]\nc6 = "1"\n'}))
    assert rows(change.changed) == ["Row(repo='r05', path='Cargo.toml')"]
    assert {r["repo"] for r in change.affected.collect()} == {"r04", "r05"}
    assert [(r["from"], r["to"]) for r in change.edges_gone.collect()] == [("r04", "r05")] and change.edges_new.count() == 0  # c6 is declared in the same place
    written = {name: sum(v == 1 for (n, _), v in state.at.items() if n == name) for name in state.tables}
    assert written["facts-cargo"] == 1 and written["offers"] <= 2 and written["lookups"] <= 4 and written["resolved"] <= 2
    # A further claim of a coordinate, behind the first: contested now, but no edge leads elsewhere.
    change = delta.advance(state, manifests(spark, {("r39", "Cargo.toml"): '[package]\nname = "c20"\n[dependencies]\nc0 = "1"\n'}))
    assert {r["repo"] for r in change.affected.collect()} == {"r38", "r39"}
    assert {r["contested"] for r in delta.ownership(state).where("coordinate = 'c20'").collect()} == {True}


def test_what_stays_and_what_is_odd(spark, folder):
    state = delta.state_of(spark, folder, 4)
    delta.advance(state, manifests(spark, {}))
    assert delta.edges(state).count() == 0
    delta.advance(state, manifests(spark, FILES), roster=roster(spark, ROSTER))
    before = kept(state)
    none = spark.createDataFrame([(None, "Cargo.toml"), ("x", None), ("no", "Cargo.toml"), ("alpha", "README.md")], "repo string, path string")
    twice = manifests(spark, FILES)
    change = delta.advance(state, twice.unionByName(twice).unionByName(spark.createDataFrame([(None, "go.mod", b"module x\n"), ("x", None, b"")], twice.schema)), none, roster(spark, ROSTER))
    assert change.changed.count() == change.affected.count() == change.edges_new.count() == change.edges_gone.count() == 0 and kept(state) == before


def test_a_lost_epoch_is_done_again(spark, folder):
    state = delta.state_of(spark, folder, 4)
    base = {k: t for k, t in FILES.items() if k[1] in ("Cargo.toml", "go.mod")}
    delta.advance(state, manifests(spark, base), roster=roster(spark, ROSTER))
    before = kept(state)
    lost = delta.state_of(spark, folder, 4)
    lost.commit = lambda epoch: None  # the job goes down before the last write
    delta.advance(lost, manifests(spark, {("beta", "Cargo.toml"): '[package]\nname = "lost"\n'}))
    again = delta.state_of(spark, folder, 4)
    assert again.epoch == 0 and kept(again) == before
    changed = {("delta", "go.mod"): "module example.com/other\n"}
    delta.advance(again, manifests(spark, changed))
    assert kept(again) == full(spark, base | changed, roster(spark, ROSTER))


def test_differing_compares_ids(spark, folder):
    base = {k: t for k, t in FILES.items() if k[1] in ("Cargo.toml", "go.mod")}
    state = delta.state_of(spark, folder, 4)
    delta.advance(state, manifests(spark, base))
    now = {k: v for k, v in base.items() if k[0] != "gamma"} | {("alpha", "Cargo.toml"): "x = 1\n", ("new", "go.mod"): "module n\n", ("new", "README.md"): "x"}
    from graphloom.functions.text import git_blob_sha

    listing = manifests(spark, now).withColumn("blob", git_blob_sha(F.col("content")))
    to_read, gone = delta.differing(state, listing)
    assert {(r[0], r[1]) for r in to_read.collect()} == {("alpha", "Cargo.toml"), ("new", "go.mod")} and [tuple(r) for r in gone.collect()] == [("gamma", "go.mod")]


def test_random_changes(spark, folder):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(8)]

    def one(kind):
        deps = rng.sample(names, 3)
        if kind == "Cargo.toml":
            return f'[package]\nname = "{rng.choice(names)}"\n[dependencies]\n' + "".join(f'{d} = "1"\n' for d in deps)
        return f"module m/{'/'.join(rng.choice(names) for _ in range(rng.randint(1, 2)))}\n" + "".join(f"require m/{d}/{rng.choice(names)} v1\n" for d in deps)

    places = [(f"r{i}", kind) for i in range(12) for kind in ("Cargo.toml", "go.mod")]
    repos = roster(spark, [(f"r{i}", f"o/r{i}") for i in range(12)])
    files = {p: one(p[1]) for p in places[:16]}
    state = delta.state_of(spark, folder, 4)
    delta.advance(state, manifests(spark, files), roster=repos)
    for _ in range(2):
        arrived = {p: one(p[1]) for p in rng.sample(places, 4)}
        gone = [p for p in rng.sample(sorted(files), 2) if p not in arrived]
        files = {k: v for k, v in (files | arrived).items() if k not in gone}
        delta.advance(state, manifests(spark, arrived), spark.createDataFrame(gone, "repo string, path string"))
        assert kept(state) == full(spark, files, repos)


def test_only_declarations_under_moved_keys_are_resolved_again(spark, folder, monkeypatch):
    """Of a manifest that stays, not its other declarations; and its edges are those of a full derivation."""
    files = {("a", "Cargo.toml"): '[package]\nname = "a"\n[dependencies]\nb = "1"\nc = "1"\nnone = "1"\n', ("b", "Cargo.toml"): '[package]\nname = "b"\n', ("c", "Cargo.toml"): '[package]\nname = "c"\n'}
    repos, asked, resolved = roster(spark, [(r, f"o/{r}") for r in "abc"]), [], delta._resolved
    monkeypatch.setattr(delta, "_resolved", lambda declared, *rest: asked.append(sorted(r[0] for r in declared.select("want").collect())) or resolved(declared, *rest))
    state = delta.state_of(spark, folder, 3)
    delta.advance(state, manifests(spark, files), roster=repos)
    later = {("c", "Cargo.toml"): '[package]\nname = "none"\n'}
    change = delta.advance(state, manifests(spark, later))
    assert asked == [["b", "c", "none"], ["c", "none"]]
    assert kept(state) == full(spark, files | later, repos)
    assert [(r["from"], r["to"], r["matched"]) for d in (change.edges_gone, change.edges_new) for r in d.collect()] == [("a", "c", "c"), ("a", "c", "none")]
