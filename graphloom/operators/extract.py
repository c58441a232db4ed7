"""One expression for each manifest format: text in, typed facts out.

Facts say what a file declares, never what that means for the graph. The line
formats are folds and filters over the array of a file's lines, and the JSON
formats are reads of a variant, so a table of manifests keeps one row for each file
and is neither exploded nor shuffled. TOML texts are turned into JSON first
(functions.toml), and read like the others.

Arrays are sorted as the contract says; what its sort keys leave open keeps the
order of the file where that is known, and else the next field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import is_local_replacement
from ..functions.text import bare_key_lines, bound, full, line_of, line_of_key, lines, trimmed, unquoted
from ..schemas import CARGO_TABLES, DDL, NPM_TABLES, TENANCY_KEY

_STRINGS = "array<string>"


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _sorted(rows: Column, keys: list[str], names: list[str]) -> Column:
    """An array of structs in the order of the keys, with the named fields."""
    ordered = F.sort_array(F.transform(rows, lambda x: F.struct(*[x[k].alias(f"k{i}") for i, k in enumerate(keys)], x.alias("x"))))
    return F.transform(ordered, lambda o: F.struct(*[o["x"][n].alias(n) for n in names]))


def _facts(fmt: str, ok: Column, **fields: Column) -> Column:
    """The facts of a format as its declared type; null where the text could not be read."""
    return F.when(ok, F.struct(*[c.alias(n) for n, c in fields.items()])).cast(f"struct<{_type(fmt)}>")


def _type(fmt: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(DDL[fmt]).simpleString()[len("struct<") : -1]


# ---------------------------------------------------------------- line formats


#: What a line is for the blocks of a go.mod: a letter for each opener, c for a lone closing parenthesis, a dot for others.
_OPENERS = {"require": "r", "replace": "p", "exclude": "e", "retract": "t"}


def _gomod_states(marks: Column) -> Column:
    """For every line one letter: a dot outside of blocks, c and o for lines that close and open, R P E T inside a block.

    A block runs from an opener to the next closing line, and openers inside it are lines like any other. So
    closing lines cut the marks, one string of a letter a line, into stretches; the first opener of a stretch and what
    follows it are a block. Each step passes over the string once."""

    def state(stretch: Column) -> Column:
        cut = lambda k: F.regexp_extract(stretch, r"^(\.*)([rpet])(.*)$", k)
        return F.when(stretch.rlike("[rpet]"), F.concat(cut(1), F.lit("o"), F.repeat(F.translate(cut(2), "rpet", "RPET"), F.length(cut(3))))).otherwise(stretch)

    return F.split(F.array_join(F.transform(F.split(marks, "c", -1), state), "c"), "", -1)


def _gomod_rows(text: Column) -> Column:
    """The directives of a go.mod in the order of the file: kind, body (without comment), indirect, line."""
    opener = r"^(require|replace|exclude|retract)\s*\($"
    numbered = F.transform(lines(text), lambda x, i: F.struct(x.alias("x"), trimmed(x).alias("t"), (i + 1).alias("n")))

    def mark(row: Column) -> Column:
        kind = F.translate(F.substring(F.regexp_replace(row["t"], "^re(p|q|t)", "$1"), 1, 1), "qpte", "rpte")
        return F.when(row["t"] == ")", "c").when(row["t"].endswith("(") & row["t"].rlike(opener), kind).otherwise(".")

    def row(line: Column, state: Column) -> Column:
        starts = lambda word: line["t"].startswith(word) & line["t"].rlike(rf"^{word}\s")
        single = F.when(starts("replace"), "replace").when(starts("require"), "require")
        kind = F.when(state == ".", single).when(state == "R", "require").when(state == "P", "replace")
        noted = line["x"].contains("//")
        plain = F.when(noted, trimmed(F.regexp_replace(line["t"], "//.*$", ""))).otherwise(line["t"])
        body = F.when(state == ".", trimmed(F.regexp_extract(plain, r"^(?:require|replace)\s+(.+)$", 1))).otherwise(plain)
        return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), body.alias("body"), (noted & line["x"].rlike(r"//\s*indirect")).alias("indirect"), line["n"].cast("int").alias("line")))

    def directives(rows: Column) -> Column:
        states = _gomod_states(F.array_join(F.transform(rows, mark), ""))
        return bound(states, lambda known: F.transform(rows, lambda r, i: row(r, F.get(known, i))))

    return F.filter(bound(numbered, directives), lambda r: r["body"] != "")  # a line that says nothing is null


def gomod(text: Column) -> Column:
    """go.mod: the module, its requirements and its replacements, single or in blocks."""
    spaced = lambda c: F.when(c.rlike(r"[\t\n\x0B\f\r]"), F.regexp_replace(c, r"\s", " ")).otherwise(c)
    words = lambda c: F.filter(F.split(spaced(c), " "), lambda w: w != "")  # noqa: E731  # a split at one character compiles no pattern

    def told(rows: Column) -> Column:
        named = F.transform(F.filter(rows, lambda r: r["kind"] == "require"), lambda r: F.struct(words(r["body"]).alias("w"), r["indirect"].alias("indirect"), r["line"].alias("line")))
        requires = F.transform(F.filter(named, lambda r: F.size(r["w"]) >= 2), lambda r: F.struct(r["w"][0].alias("path"), r["w"][1].alias("version"), r["indirect"].alias("indirect"), r["line"].alias("line")))
        sides = F.transform(F.filter(rows, lambda r: r["kind"] == "replace"), lambda r: F.struct(F.split(r["body"], "=>", -1).alias("s"), r["line"].alias("line")))
        halves = F.transform(F.filter(sides, lambda r: F.size(r["s"]) == 2), lambda r: F.struct(words(r["s"][0]).alias("l"), words(r["s"][1]).alias("r"), r["line"].alias("line")))
        replaces = F.transform(
            F.filter(halves, lambda h: (F.size(h["l"]) > 0) & (F.size(h["r"]) > 0)),
            lambda h: F.struct(
                h["l"][0].alias("path"),
                F.get(h["l"], F.lit(1)).alias("version"),
                h["r"][0].alias("with"),
                F.get(h["r"], F.lit(1)).alias("withVersion"),
                is_local_replacement(h["r"][0]).alias("local"),
                h["line"].alias("line"),
            ),
        )
        return F.struct(
            _sorted(requires, ["path", "line"], ["path", "version", "indirect", "line"]).alias("requires"),
            _sorted(replaces, ["path", "line"], ["path", "version", "with", "withVersion", "local", "line"]).alias("replaces"),
        )

    module = F.nullif(F.regexp_extract(text, r"(?m)^module\s+(\S+)", 1), F.lit(""))

    def facts(rows: Column) -> Column:
        return _facts("gomod", text.isNotNull(), module=module, publishes=F.when(module.isNull(), _empty(_STRINGS)).otherwise(F.array(module)), requires=rows["requires"], replaces=rows["replaces"])

    return bound(bound(_gomod_rows(text), told), facts)


def taskfile(text: Column) -> Column:
    """Taskfile.yml: the repositories whose release downloads it names."""
    urls = F.regexp_extract_all(text, F.lit(r"github\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)/releases/download"), F.lit(1))
    repos = F.transform(F.array_sort(F.array_distinct(urls)), lambda c: F.struct(F.split(c, "/")[0].alias("owner"), F.split(c, "/")[1].alias("repo")))
    return _facts("taskfile", text.isNotNull(), releaseRepos=repos)


def version_pin(file_name: Column, text: Column) -> Column:
    """A .<tool>-version file; null when the name or the text is no pin."""
    name = F.regexp_extract(file_name, r"^\.([a-z0-9][a-z0-9-]*)-version$", 1)
    version = trimmed(text)
    good = (name != "") & version.rlike(r"^v?[0-9]+(?:\.[0-9]+)*(?:[-+][0-9A-Za-z.-]+)?$")
    return _facts("version-pin", good, tool=name, version=version)


def workflow(text: Column) -> Column:
    """A workflow: the dispatched events it listens for, and those that it dispatches. Comment lines count for nothing."""
    plain = F.transform(lines(text), lambda x: F.when(x.rlike(r"^\s*#"), "").otherwise(x))
    return bound(plain, lambda rows: _facts("workflow", text.isNotNull(), listensFor=_listens(rows), dispatches=_dispatches(rows)))


def _listens(rows: Column) -> Column:
    """The names of events that the lines listen for, sorted."""
    inline, block, item = r"^\s*types:\s*\[(.*)\]\s*$", r"^\s*types:\s*$", r"^\s*-\s*(.+?)\s*$"
    first_true = lambda flags: F.array_position(flags, F.lit(True)).cast("int")

    def heard(at: Column) -> Column:
        """Event names of the listener whose line is `at`, counted from 1."""
        near = F.slice(rows, at + 1, 7)
        stop = first_true(F.transform(near, lambda x: x.rlike(inline) | x.rlike(block) | ((trimmed(x) != "") & ~x.rlike(r"^\s*types:"))))
        line = F.get(near, stop - 1)
        listed = F.filter(F.transform(F.split(F.regexp_extract(line, inline, 1), ","), lambda n: unquoted(trimmed(n))), lambda n: n != "")
        below = F.slice(rows, at + stop + 1, F.greatest(F.size(rows), F.lit(1)))
        end = first_true(F.transform(below, lambda x: ~x.rlike(item)))
        run = F.when(end > 0, F.slice(below, 1, F.greatest(end - 1, F.lit(0)))).otherwise(below)
        names = F.transform(run, lambda x: unquoted(F.regexp_extract(x, item, 1)))
        return F.when(line.rlike(inline), listed).when(line.rlike(block), names).otherwise(_empty(_STRINGS))

    number = F.sequence(F.lit(1), F.size(rows))
    listeners = F.filter(number, lambda i: F.get(rows, i - 1).rlike(r"^\s*repository_dispatch:\s*$"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(listeners, heard))))


def _dispatches(rows: Column) -> Column:
    """The dispatches of the lines, each with its literal target if it has one."""
    number = F.sequence(F.lit(1), F.size(rows))
    target, event = r"gh\s+api\s+repos/(\S+?)/dispatches", r"event_type=([A-Za-z0-9._-]+)"
    senders = F.filter(number, lambda i: F.get(rows, i - 1).rlike(target))

    def sent(i: Column) -> Column:
        near = F.filter(F.slice(rows, i, 6), lambda x: x.rlike(event))
        to = F.regexp_extract(F.get(rows, i - 1), target, 1)
        literal = r"^([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+)$"
        part = lambda k: F.when(to.rlike(literal), F.regexp_extract(to, literal, k))
        return F.struct(F.regexp_extract(F.get(near, F.lit(0)), event, 1).alias("event"), part(1).alias("owner"), part(2).alias("repo"), i.alias("line"))

    dispatches = F.filter(F.transform(senders, sent), lambda d: d["event"].isNotNull())
    keyed = F.transform(dispatches, lambda d: F.struct(F.concat(d["event"], F.coalesce(d["repo"], F.lit(""))).alias("key"), *[d[n].alias(n) for n in ("event", "owner", "repo", "line")]))
    return _sorted(keyed, ["key", "line"], ["event", "owner", "repo", "line"])


# ---------------------------------------------------------------- JSON formats


def _entries(doc: Column, path: str) -> Column:
    """(key, value) of an object in a variant; empty for anything else."""
    return F.coalesce(F.map_entries(F.try_variant_get(doc, path, "map<string,variant>")), _empty("array<struct<key:string,value:variant>>"))


def _items(doc: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(doc, path, "array<variant>"), _empty("array<variant>"))


def _text(doc: Column, path: str) -> Column:
    """A string at the path; null for anything else."""
    value = F.try_variant_get(doc, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(doc, path, "string"))


def _any(doc: Column, path: str) -> Column:
    """Any scalar at the path, as text."""
    return F.try_variant_get(doc, path, "string")


def npm(text: Column) -> Column:
    """package.json: its name and every dependency table."""
    doc = F.try_parse_json(text)
    deps = F.concat(*[F.transform(_entries(doc, f"$.{t}"), _npm_dep(t)) for t in NPM_TABLES])
    name = _any(doc, "$.name")
    return _facts("npm", doc.isNotNull(), name=name, version=_any(doc, "$.version"), publishes=F.when(full(name), F.array(name)).otherwise(_empty(_STRINGS)), deps=_sorted(deps, ["name", "table"], ["name", "table", "spec"]))


def _npm_dep(table: str):
    return lambda e: F.struct(e["key"].alias("name"), F.lit(table).alias("table"), _text(e["value"], "$").alias("spec"))


def server_json(text: Column) -> Column:
    """server.json: the server's name, what it publishes, how it is launched and what it needs."""
    doc = F.try_parse_json(text)
    meta = _entries(doc, "$._meta")

    def under(suffix: str, row) -> Column:
        return F.flatten(F.transform(F.filter(meta, lambda m: m["key"].endswith(suffix)), lambda m: F.transform(_entries(m["value"], "$"), lambda e: row(m["key"], e))))

    commands = F.filter(
        under("/transports", lambda key, e: F.struct(key.alias("metaKey"), e["key"].alias("transport"), _text(e["value"], "$.command").alias("command"))),
        lambda c: c["command"].isNotNull(),
    )
    commands = F.transform(commands, lambda c: F.struct(F.concat(c["command"], c["transport"]).alias("both"), *[c[n].alias(n) for n in ("metaKey", "transport", "command")]))
    needs = under(
        "/required-deps",
        lambda key, e: F.struct(key.alias("metaKey"), e["key"].alias("server"), _any(e["value"], "$['minimum-version']").alias("minimumVersion"), _text(e["value"], "$.purpose").alias("purpose")),
    )
    packages = _items(doc, "$.packages")
    name = _any(doc, "$.name")
    listed = F.filter(F.transform(packages, lambda p: _text(p, "$.identifier")), lambda i: i.isNotNull())
    return _facts(
        "server-json",
        doc.isNotNull(),
        name=name,
        version=_any(doc, "$.version"),
        repositoryUrl=_any(doc, "$.repository.url"),
        publishes=F.concat(F.when(full(name), F.array(name)).otherwise(_empty(_STRINGS)), listed),
        packages=F.transform(packages, lambda p: F.struct(_any(p, "$.registryType").alias("registryType"), _any(p, "$.identifier").alias("identifier"), _any(p, "$.version").alias("version"))),
        remotes=F.transform(_items(doc, "$.remotes"), lambda r: F.struct(_any(r, "$.type").alias("type"))),
        commands=_sorted(commands, ["both", "metaKey"], ["metaKey", "transport", "command"]),
        declaresCloisterTenancy=F.exists(meta, lambda m: m["key"] == TENANCY_KEY),
        requiredDeps=_sorted(needs, ["server", "metaKey"], ["metaKey", "server", "minimumVersion", "purpose"]),
    )


# ---------------------------------------------------------------- TOML formats; json: the text as JSON


def cargo(text: Column, json: Column) -> Column:
    """Cargo.toml: the package, the workspace and every dependency table, platform-gated ones too."""
    return bound(F.try_parse_json(json), lambda doc: F.when(doc.isNotNull(), bound(bare_key_lines(text), lambda known: _cargo(text, doc, known))))


def _cargo(text: Column, doc: Column, known: Column) -> Column:
    def dep(table: Column):
        def row(e: Column) -> Column:
            v = e["value"]
            version = F.coalesce(_text(v, "$"), _any(v, "$.version"))
            rest = [_any(v, f"$.{n}").alias(n) for n in ("git", "rev", "tag", "branch", "path")]
            return F.struct(e["key"].alias("name"), table.alias("table"), _any(v, "$.package").alias("package"), version.alias("version"), *rest, line_of_key(text, known, e["key"]).alias("line"))

        return row

    tables = []
    for t in CARGO_TABLES:
        tables.append(F.transform(_entries(doc, f"$['{t}']"), dep(F.lit(t))))
        tables.append(F.transform(_entries(doc, f"$.workspace['{t}']"), dep(F.lit(f"workspace.{t}"))))
        tables.append(F.flatten(F.transform(_entries(doc, "$.target"), _gated(t, dep))))
    name = _any(doc, "$.package.name")
    members = F.array_sort(F.transform(_items(doc, "$.workspace.members"), lambda m: _any(m, "$")))
    return _facts(
        "cargo",
        doc.isNotNull(),
        package=F.when(full(name), F.struct(name.alias("name"), _text(doc, "$.package.version").alias("version"))),
        publishes=F.when(full(name), F.array(name)).otherwise(_empty(_STRINGS)),
        workspaceMembers=members,
        deps=_sorted(F.concat(*tables), ["name", "table"], ["name", "table", "package", "version", "git", "rev", "tag", "branch", "path", "line"]),
    )


def _gated(table: str, dep):
    return lambda section: F.transform(_entries(section["value"], f"$['{table}']"), dep(F.concat(F.lit("target."), section["key"], F.lit(f".{table}"))))


_REF = r"^github://([^/]+)/([^/]+)/(.+?)@([0-9a-f]{7,40})$"


def _ref(ref: Column) -> list[Column]:
    return [F.when(ref.rlike(_REF), F.regexp_extract(ref, _REF, k)).alias(n) for k, n in ((1, "owner"), (2, "repo"), (3, "path"), (4, "rev"))]


def _null_as_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("null"))


def cluster_toml(text: Column, json: Column) -> Column:
    """cluster.toml: bundles, the wires between them, pinned inputs."""
    doc = F.try_parse_json(json)
    bundles = F.transform(
        _items(doc, "$.bundles"),
        lambda b: F.struct(
            *[_any(b, f"$.{n}").alias(n) for n in ("name", "kind", "tier")],
            F.coalesce(_any(b, "$.external.image"), _any(b, "$.deployment.image")).alias("image"),
            _any(b, "$.external.entryPoint").alias("entryPoint"),
            _any(b, "$.workerdServiceName").alias("workerdServiceName"),
        ),
    )
    wires = F.transform(
        _items(doc, "$.wires"),
        lambda w: F.struct(F.concat(_null_as_text(_any(w, "$.from")), _null_as_text(_any(w, "$.to"))).alias("both"), *[_any(w, f"$.{n}").alias(n) for n in ("from", "to", "binding", "transport")]),
    )
    inputs = F.transform(
        _entries(doc, "$.inputs"),
        lambda e: F.struct(e["key"].alias("key"), _text(e["value"], "$.ref").alias("ref"), *_ref(_text(e["value"], "$.ref")), _text(e["value"], "$.version").alias("version"), line_of(text, F.lit("ref")).alias("line")),
    )
    return _facts(
        "cluster-toml",
        doc.isNotNull(),
        clusterName=_any(doc, "$.metadata.name"),
        bundles=_sorted(bundles, ["name"], ["name", "kind", "tier", "image", "entryPoint", "workerdServiceName"]),
        wires=_sorted(wires, ["both"], ["from", "to", "binding", "transport"]),
        inputs=_sorted(inputs, ["key"], ["key", "ref", "owner", "repo", "path", "rev", "version", "line"]),
    )


def cluster_lock(json: Column) -> Column:
    """cluster.lock.toml: what each input resolved to."""
    doc = F.try_parse_json(json)
    oci = lambda v: F.when(F.try_variant_get(v, "$.oci", "variant").isNotNull(), F.struct(*[_any(v, f"$.oci.{n}").alias(n) for n in ("identifier", "version", "digest")]))
    inputs = F.transform(
        _entries(doc, "$.inputs"),
        lambda e: F.struct(e["key"].alias("key"), *_ref(_text(e["value"], "$.ref")), _text(e["value"], "$.resolved").alias("resolved"), _text(e["value"], "$.sha256").alias("sha256"), oci(e["value"]).alias("oci")),
    )
    return _facts("cluster-lock", doc.isNotNull(), schema=_any(doc, "$.schema"), cluster=_any(doc, "$.cluster"), inputs=_sorted(inputs, ["key"], ["key", "owner", "repo", "path", "rev", "resolved", "sha256", "oci"]))
