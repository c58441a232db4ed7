"""The prefix trie against a plain one in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import oracle
import pytest

from graphloom.llm import op11_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, key string, place int, id long, token binary"


def plain(rows):
    """The contract, word for word, over rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            token = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest() + len((text or "").encode()).to_bytes(4)
            own[c].append(((turn is not None, turn or 0), token, (role or "", text or "")))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        size = len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * size + sum(saved[k] for k in kids[node])
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if made[c] == node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def sown(n, words, longest, seed=5):
    draw = random.Random(seed)
    rows = []
    for c in range(-7, n):
        for t in range(draw.randint(1, longest)):
            rows.append((c, t, draw.choice(["user", "assistant", None]) if t else "user", "long " * 30 + "é" if draw.random() < 0.05 else draw.choice(words)))
    return rows


def odd():
    """Null ids, turns, roles and texts, repeated rows, tied turns, one very long conversation, a turnless rebuilt one."""
    rows = [(None, 0, "user", "no id"), (3, None, None, None), (3, 0, "user", ""), (3, 0, "user", ""), (4, 1, "a", "x"), (4, 1, "b", "x"), (9001, 0, "user", "only"), (9007, 1, "", "")]
    return rows + [(9100, t, "user", f"turn {t}") for t in range(3000)] + [(9101, t, "user", f"turn {t}") for t in range(3000)]


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "k", 1, 2, b"t") for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in T.trie(df).select(*T.NAMES).collect()), key=str)


@pytest.mark.parametrize("fan, run, chunk", [(64, 16 << 20, 1 << 16), (2, 3000, 40)])
def test_equals_the_plain_trie(spark, monkeypatch, fan, run, chunk):
    monkeypatch.setattr(T, "FAN", fan)
    monkeypatch.setattr(T, "RUN_BYTES", run)
    monkeypatch.setattr(T, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(T, "RANGE_BYTES", 1000)
    rows = sown(150, ["a", "b", "c"], 6) + odd()
    assert found(spark, rows) == plain(rows)


def test_copies_fill_several_ranges(spark, monkeypatch):
    """A sequence of a third of all conversations, and a first turn of all of them, go over many ranges."""
    monkeypatch.setattr(T, "RANGE_BYTES", 1000)
    monkeypatch.setattr(T, "FAN", 3)
    rows = [(5 * c, t, "user", f"{t}" if c % 3 == 0 or t == 0 else f"{c} {t}") for c in range(300) for t in range(4)]
    assert found(spark, rows) == plain(rows)


def test_empty_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 0, "user", "x")]) == plain([(1, 0, "user", "x")])


def test_loser_tree_gives_lcps():
    draw = random.Random(1)
    keys = sorted((b"".join(bytes([draw.choice(b"xyz")]) * T.TOKEN for _ in range(draw.randint(0, 6))), c) for c in range(200))
    runs = []
    for k in range(7):
        mine, before, shared, rest = keys[k::7], b"", [], []
        for key, _ in mine:
            shared.append(T.shared_turns(before, key))
            rest.append(key[shared[-1] * T.TOKEN :])
            before = key
        runs.append(T.Run([c for _, c in mine], shared, [len(r) for r in rest], b"".join(rest)))
    out = [(r.key, r.conv, r.lcp) for r in T.merged(runs)]
    assert [(k, c) for k, c, _ in out] == keys
    assert [lcp for _, _, lcp in out[1:]] == [T.shared_turns(a, b) for (a, _), (b, _) in zip(keys, keys[1:], strict=False)]


def test_query_equals_its_sql(spark, data):
    oracle.same(T.op11_trie(spark, data), oracle.connection(data), T.SQL)
