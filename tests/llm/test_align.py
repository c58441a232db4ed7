"""Token alignment against plain loops over whole texts, encoded without words or a cache."""

import hashlib
from collections import Counter

import pytest

from graphloom.llm import op12_align as A

NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = A._paths()
    first = Tokenizer.from_file(one)
    first.encode_special_tokens = True
    return A.encoder(one, two), first, sentencepiece.SentencePieceProcessor(model_file=two)


def whole(tools, text):
    """Ids of both sides, of the text as a whole; None if they do not give its bytes."""
    tool, first, second = tools
    if not text:
        return None
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    want = b" " + text.encode()
    return (a, b) if b"".join(tool.bytes_a[k] for k in a) == want == b"".join(tool.bytes_b[k] for k in b) else None


def plain(tools, rows):
    tool = tools[0]
    made = []
    for doc_id, text in rows:
        both = whole(tools, text)
        if both is None:
            made.append((doc_id, [], [], [], ""))
            continue
        spans = []
        for ids, table in zip(both, (tool.bytes_a, tool.bytes_b), strict=True):
            at, out = 0, []
            for k in ids:
                out.append((at, at + len(table[k]), k))
                at += len(table[k])
            spans.append(out)
        links = [(x, y) for lo, hi, x in spans[0] for lo2, hi2, y in spans[1] if lo < hi2 and lo2 < hi] if len(spans[0]) < 400 else None
        if links is None:  # the same by walking along both
            links, j = [], 0
            for lo, hi, x in spans[0]:
                while spans[1][j][1] <= lo:
                    j += 1
                k = j
                while k < len(spans[1]) and spans[1][k][0] < hi:
                    links.append((x, spans[1][k][2]))
                    k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        told, low = [], 0
        for cut in cuts:
            told.append("|".join(",".join(str(k) for lo, hi, k in side if lo >= low and hi <= cut) for side in spans) if len(spans[0]) < 400 else None)
            low = cut
        sha = hashlib.sha256(";".join(told).encode()).hexdigest() if None not in told else None
        made.append((doc_id, *both, links, sha, len(cuts)))
    counts = Counter(link for row in made for link in row[3])
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for row in made:
        links = row[3]
        out.append((row[0], len(row[1]), len(row[2]), row[5] if links else 0, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), row[4]))
    return out


def same(found, want):
    order = lambda r: str(r[:7])
    found, want = sorted(map(tuple, found), key=order), sorted(want, key=order)
    assert [r[:7] for r in found] == [r[:7] for r in want]
    assert [f[7] for f, w in zip(found, want, strict=True) if w[7] is not None] == [w[7] for w in want if w[7] is not None]


TEXTS = [
    "plain words of a text", "  two  spaces   and tabs\t\tand\n\nlines \n of it ", "\n starts with one", "ends with two  ", "a  ", " ", "<s> </s> <|endoftext|> <unk> [INST]", "a▁b ▁ c", "über straße 東京 é́ \U0001f600\U0001f468‍\U0001f469",
    "don't you'll WE'RE 1234567 3.14 x_y__z", "no\xa0break　wide em \x85 \x1c x\x1d y", "\x00 nul \x07", "x" * 3000, "ab " * 3000, "one\r\ntwo\r\n", "l'été n'est pas",
]


def odd():
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    return rows + [(100, None), (101, ""), (None, "no id at all"), (0, TEXTS[0]), (0, TEXTS[0]), (0, "another text of it"), (102, TEXTS[0])]


@pytest.mark.parametrize("block, sweep, held, most", [(4096, 1 << 18, 1 << 20, 4 << 20), (7, 40, 50, 30)])
def test_equals_plain_loops(spark, tools, monkeypatch, block, sweep, held, most):
    for name, value in (("BLOCK", block), ("SWEEP", sweep), ("PAIRS_HELD", held), ("PAIRS_MOST", most)):
        monkeypatch.setattr(A, name, value)
    df = spark.createDataFrame([(i, t, "s", 1, b"x") for i, t in odd()], "doc_id long, text string, h1 string, copies int, pair binary").repartition(3)
    same(A.align(df).select(*NAMES).collect(), plain(tools, odd()))


def test_query_equals_plain_loops(spark, data, tools):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    same(A.op12_align(spark, data).select(*NAMES).collect(), plain(tools, rows))


def test_empty(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_decode_to_the_text(spark, tools):
    tool = tools[0]
    df = spark.createDataFrame([(1, "straße of words\n and 東京 more"), (2, None)], "doc_id long, text string")
    rows = A.groups(df).orderBy("nth").collect()
    sides = [b"".join(b"".join(table[k] for k in r[name]) for r in rows) for name, table in (("ids_a", tool.bytes_a), ("ids_b", tool.bytes_b))]
    assert sides == [" straße of words\n and 東京 more".encode()] * 2
    for r in rows:
        assert b"".join(tool.bytes_a[k] for k in r["ids_a"]) == b"".join(tool.bytes_b[k] for k in r["ids_b"])


def test_words_give_the_ids_of_whole_texts(tools, data):
    import random

    import pyarrow.parquet as pq

    tool, draw = tools[0], random.Random(7)
    assert tool.fast is not None and tool.by_word
    texts = [t for t in pq.read_table(f"{data}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    for kind in ("ab 'st\n ", "é ñ1\t.  ", "\x1c\xa0 x東\u2009", "<|endoftext|> ▁s", "".join(map(chr, range(32, 0x2100, 7)))):
        texts += ["".join(draw.choice(kind) for _ in range(draw.randint(1, 40))) for _ in range(1500)]
    for text in texts:
        want, got = whole(tools, text), tool.ids(text)
        assert (want is None) == (got is None) and (want is None or (want[0] == got[0].tolist() and want[1] == got[1].tolist())), text
