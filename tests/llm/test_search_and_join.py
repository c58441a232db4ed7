import itertools
import random

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import linking, op1_nearest, op2_jaccard, op9_decontaminate, op10_passages, registry


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, data, name):
    oracle.same(registry.QUERIES[name](spark, data), oracle.connection(data), registry.SQL[name])


# ------------------------------------------------------------------ nearest neighbours


def test_recall_and_order(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    got = op1_nearest.op1_nearest(spark, data).collect()
    rows = sorted((r["vec_id"], r["embedding"]) for r in table.collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    best = set()
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        best |= {(ids[q], i) for i in ids[np.lexsort((ids, -s))[:5]]}
    assert len(best & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(best)
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r["query_id"], r["rank"])), key=lambda r: r["query_id"]):
        own = list(own)
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)


def test_recall_of_a_full_chunk():
    """A chunk of the size that production scans, with clusters and near copies, reranked as in production: recall against brute force."""
    rng = np.random.default_rng(9)
    n, dim = op1_nearest.CHUNK, 64
    x = rng.normal(size=(n, dim)) + 2 * rng.normal(size=(200, dim))[rng.integers(0, 200, n)]
    x[::7] = x[1::7][: len(x[::7])] + 0.05 * rng.normal(size=(len(x[::7]), dim))
    asked = np.arange(0, n, 50)
    units = op1_nearest._units(x)
    q = op1_nearest.Quantiser(dim).fit(units[1][:: n // 4096])
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(i, min(n, i + 2000))), pa.array(list(x[i : i + 2000]))], names=["vec_id", "v"]) for i in range(0, n, 2000)]
    out = list(op1_nearest._scan(q, asked, x[asked], op1_nearest.K, op1_nearest.RERANK)(iter(batches)))
    got = {}
    for b in out:
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got.setdefault(i, set()).add(v)
    exact = units[0][asked] @ units[0].T
    exact[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-exact, axis=1, kind="stable")[:, : op1_nearest.K]
    recall = np.mean([len(got[i] & set(w.tolist())) / op1_nearest.K for i, w in zip(asked.tolist(), want, strict=True)])
    print("recall of a full chunk", recall)
    assert recall >= 0.9


@pytest.mark.parametrize("case", ["tight clusters", "common part", "few heavy dimensions", "far from the sample"])
def test_rows_that_codes_cannot_tell_apart(case):
    """Every nearest row is found where a four-bit code is the same, or nearly so, for more rows than are reranked."""
    rng = np.random.default_rng(3)
    n, dim = 6000, 32
    x = rng.normal(size=(n, dim))
    sample = x
    if case == "tight clusters":
        sample = x = rng.normal(size=(12, dim))[rng.integers(0, 12, n)] + 1e-3 * x
    elif case == "common part":
        sample = x = x + 100
    elif case == "few heavy dimensions":
        sample = x = x * np.where(np.arange(dim) < 3, 50, 1)
    else:
        x = np.abs(x) + np.where(np.arange(dim) < 8, 30, 0)
    asked = np.arange(0, n, 50)
    q = op1_nearest.Quantiser(dim).fit(op1_nearest._units(sample)[1][:2000])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(list(x))], names=["vec_id", "v"])
    (out,) = op1_nearest._scan(q, asked, x[asked], op1_nearest.K, op1_nearest.RERANK)(iter([batch]))
    got = set(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    unit = op1_nearest._units(x)[0]
    exact = (unit[asked, None, :] * unit[None]).sum(axis=2)
    exact[np.arange(len(asked)), asked] = -np.inf
    want = {(i, j) for i, e in zip(asked.tolist(), exact, strict=True) for j in np.lexsort((np.arange(n), -e))[: op1_nearest.K].tolist()}
    assert got == want, len(got & want) / len(want)


def test_blocks_and_dimensions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4 if i % 3 else 2).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = table.where("vec_id % 5 = 0")
    one = sorted(map(tuple, op1_nearest.nearest(table, asked).collect()))
    many = sorted(map(tuple, op1_nearest.nearest(table, asked, block_values=20).collect()))
    assert len(one) == 24 * 5 and [r[:3] for r in one] == [r[:3] for r in many]
    assert all((q % 3 == 0) == (v % 3 == 0) for q, _, v, _ in one)


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, rank int"
    rows = [(0, [1.0, 0.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0, 0.0], 1), (3, [1.0, None, 0.0], 1), (4, [float("nan"), 1.0, 0.0], 1), (5, [float("inf"), 1.0, 0.0], 1), (6, [2.0, 0.0, 0.0], 1), (6, [2.0, 0.0, 0.0], 1), (7, [0.0, 1.0, 0.0], 1), (8, [1.0, 1.0], 1), (None, [1.0, 0.0, 0.0], 1)]
    rows += [(100 + i, [3.0, 0.0, 0.0], 1) for i in range(50)]
    table = spark.createDataFrame(rows, schema)
    got = op1_nearest.nearest(table, table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [6, 100, 101, 102, 103]
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == [0, 6, 101, 102, 103]
    few = op1_nearest.nearest(table.where("vec_id in (0, 7)"), table.where("vec_id = 0")).collect()
    assert [(r["vec_id"], r["rank"]) for r in few] == [(7, 1)]
    none = spark.createDataFrame([], schema)
    assert op1_nearest.nearest(none, none).collect() == []


# ------------------------------------------------------------------ n-gram Jaccard


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_against_brute_force(spark):
    rng = random.Random(4)
    pool = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(pool) for _ in range(60)]
    rows, i = [], 0
    for _ in range(12):
        base = [rng.choice(pool) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 30)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(pool)
            rows.append((i, " ".join(w + (passage if rng.random() < 0.3 else []))))
            i += 1
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op2_jaccard.jaccard_components(table, group=4).collect()}
    assert got == brute_components(rows)
    shuffled = op2_jaccard.jaccard_components(table.repartition(7, F.rand(1)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shuffled.collect()} == got


def test_jaccard_odd_rows(docs, empty):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in op2_jaccard.jaccard_components(docs).collect()]
    by = {i: (n, c) for i, n, c in got}
    assert by[4] == (0, 4) and by[5] == (0, 5) and by[6] == (0, 6) and by[1][1] == by[2][1] == 1 and by[10] == (1, 9)
    assert sum(1 for i, _, _ in got if i == 9) == 2 and by[None][1] is None
    assert op2_jaccard.jaccard_components(empty).collect() == []


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(200, k) for k in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    got = {r["id"]: r["root"] for r in linking.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: r for i, r in root.items() if any(a != b and i in (a, b) for a, b in links)}


# ------------------------------------------------------------------ decontamination


def test_decontamination_odd_rows(spark, docs, empty):
    items = spark.createDataFrame([(1, "one two THREE", "x"), (2, None, "x"), (3, "", "x"), (None, "no id at all", "x"), (10, "one two three", "x"), (4, "brown fox jumps over the lazy dog while seven wizards box", "x")], "item_id long, text string, covered string")
    got = {r["doc_id"]: (r["n_words"], sorted(r["covered"]), sorted(r["item_ids"])) for r in op9_decontaminate.decontaminate(docs, items).collect()}
    assert got[9] == (3, [0, 1, 2], [1, 10]) and got[10] == got[9] and got[4] == (0, [], []) and got[None] == (4, [], [])
    assert got[1][2] == [4] and len(got[1][1]) == 4 * 11
    blocks = op9_decontaminate.decontaminate(docs, items, block_windows=8)
    assert sorted((r["doc_id"] or 0, r["n_words"], sorted(r["covered"])) for r in blocks.collect()) == sorted((r["doc_id"] or 0, r["n_words"], sorted(r["covered"])) for r in op9_decontaminate.decontaminate(docs, items).collect())
    assert op9_decontaminate.decontaminate(empty, items).collect() == []
    nothing = op9_decontaminate.decontaminate(docs, items.limit(0)).collect()
    assert len(nothing) == docs.count() and all(r["covered"] == [] for r in nothing)
    assert {r["doc_id"] for r in op9_decontaminate.clean(docs, items, ["doc_id", "text", "key"]).collect()} == {4, 5, 6, 7, 8, 11, 12, None}


def test_repeated_windows_of_a_benchmark(spark):
    """Items that share their windows, and one that repeats a window within itself."""
    w = [f"w{k}" for k in range(30)]
    items = [(i, " ".join(w[:12])) for i in range(40)] + [(50, " ".join(w[2:12] * 3)), (51, "w1 w2"), (52, "w1 w2"), (53, " ".join(w[5:15]))]
    rows = [(1, " ".join(w)), (2, " ".join(w[:11])), (3, "x w1 w2 y w1 w2"), (4, " ".join(w[2:12] + w[2:12]))]
    found = op9_decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (sorted(r["covered"]), sorted(r["item_ids"])) for r in found.collect()}
    for i, text in rows:
        v, cover, ids = text.split(), set(), set()
        for item, body in items:
            b = body.split()
            for k in range(max(1, len(b) - 9)):
                part = b[k : k + 10]
                for p in range(len(v) - len(part) + 1):
                    if v[p : p + len(part)] == part:
                        cover |= set(range(p, p + len(part)))
                        ids.add(item)
        assert got[i] == (sorted(cover), sorted(ids)), i


# ------------------------------------------------------------------ passages


def test_every_repeated_passage_is_caught(spark):
    rng = random.Random(9)
    pool = [f"w{k}" for k in range(5000)]
    make = lambda n: [rng.choice(pool) for _ in range(n)]
    passages = [make(51) for _ in range(20)]
    rows, planted = [], {}
    for i in range(120):
        w = make(rng.randint(20, 300))
        if i % 3 == 0:
            k = i % 20
            at = rng.randrange(len(w))
            w[at:at] = passages[k]
            planted.setdefault(k, []).append(i)
        rows.append((i, " ".join(w)))
    found = op10_passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i for docs in planted.values() if len(docs) > 1 for i in docs}
    assert {r["doc_id"] for r in found} == want
    firsts = {min(d) for d in planted.values() if len(d) > 1}
    assert {r["doc_id"] for r in found if r["removed"]} == want - firsts


def test_near_paragraphs_are_a_cluster(spark, docs, empty):
    rng = random.Random(3)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    near = list(base)
    near[60] = "other"
    far = [f"v{rng.randrange(9999)}" for _ in range(120)]
    table = spark.createDataFrame([(3, " ".join(base)), (1, "short\n" + " ".join(near)), (2, " ".join(far)), (4, None)], "doc_id long, text string")
    found = op10_passages.repeated_passages(table).where("words = 120").collect()
    assert {(r["doc_id"], r["kept_doc"], r["removed"]) for r in found} == {(1, 1, False), (3, 1, True)}
    odd = {r["doc_id"] for r in op10_passages.repeated_passages(docs).collect()}
    assert odd == {1, 2, 3}
    assert op10_passages.repeated_passages(empty).collect() == []


def test_every_further_occurrence_is_a_removal(spark):
    rng = random.Random(12)
    make = lambda n: [f"w{rng.randrange(9999)}" for _ in range(n)]
    passage, alone = make(60), make(60)
    rows = [(7, make(90) + passage + make(70) + passage + make(90) + alone + make(80) + alone), (3, make(200) + passage + make(90) + passage + make(80)), (9, passage + make(200)), (5, make(200))]
    found = op10_passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    units = {}
    for r in found:
        units.setdefault(r["cluster_id"], []).append((r["doc_id"], r["start"], r["kept_doc"], r["removed"]))
    w, whole = dict(rows), 0
    for got in units.values():
        i, n, _, _ = min(got)
        places = sorted((j, k) for j in w for k in range(len(w[j]) - 26) if w[j][k : k + 27] == w[i][n : n + 27])
        assert len(places) == 5 and sorted(got) == [(j, k, i, (j, k) != (i, n)) for j, k, _, _ in sorted(got)] and {x[:2] for x in got} <= set(places)
        whole += len(got) == 5  # a unit at the passage's edge may be an anchor in some of its places only
    assert whole


def test_large_group_of_near_paragraphs(spark):
    """A thousand near copies, each with edits of its own, against brute force; other paragraphs share a passage only."""
    rng = random.Random(8)
    make = lambda n: [f"w{rng.randrange(20000)}" for _ in range(n)]
    base, common = make(120), make(40)
    rows = [(0, base)]
    for i in range(1, 1001):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            w[rng.randrange(len(w))] = f"own{i}x{rng.randrange(99)}"
        rows.append((i, w))
    rows += [(2000 + i, make(80) + common) for i in range(200)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    near = {i for i in sets if jaccard(sets[0], sets[i]) >= 0.8}
    assert len(near) == 1001
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(6)
    found = op10_passages.repeated_passages(table).where("words = 120").collect()
    assert {(r["doc_id"], r["kept_doc"], r["removed"]) for r in found} == {(i, 0, i > 0) for i in near} and len({r["cluster_id"] for r in found}) == 1


@pytest.mark.parametrize("common", [0.0, 0.3, 0.5, 0.75])
def test_recall_at_each_share_of_common_shingles(spark, common):
    """Pairs of similarity just above 0.8 whose paragraphs share a passage with all others, against all pairs."""
    rng = random.Random(13)
    make = lambda n: [f"w{rng.randrange(50000)}" for _ in range(n)]
    passage, rows = make(int(104 * common)), []
    for i in range(60):
        w = make(104 - len(passage)) + passage
        near = list(w)
        for k in rng.sample(range(2, 100), 2):
            near[k] = f"own{i}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(near))]
    want = brute_components(rows)
    for parts in (1, 5) if common == 0.5 else (5,):
        source = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        places = linking.saved(source.select("doc_id", "text").mapInArrow(op10_passages._paragraphs(op10_passages.tune(), op10_passages.ROWS), "doc_id long, start long, words long, id long, n long, bands array<long>"))
        roots = {r["id"]: r["root"] for r in op10_passages.paragraph_roots(source, places).collect()}
        got = {r["doc_id"]: roots.get(r["id"], r["id"]) for r in places.collect()}
        linked = [i for i in range(60) if want[2 * i][1] == want[2 * i + 1][1]]
        found = sum(got[2 * i] == got[2 * i + 1] for i in linked)
        assert len(linked) >= 40 and found >= 0.95 * len(linked)
        assert all((got[a] == got[b]) <= (want[a][1] == want[b][1]) for a, b in itertools.combinations(want, 2))


def test_bands_reach_the_recall():
    b = op10_passages.tune(80, 0.97, 4)
    assert 1 - (1 - 0.8**4) ** b >= 0.97 > 1 - (1 - 0.8**4) ** (b - 1)
