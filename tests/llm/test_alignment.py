"""Cross-tokenizer alignment against the libraries' own tokens of whole texts, with plain loops."""

import hashlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import alignment
from tests.oracle import SF

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tools():
    return alignment.Aligner(*alignment.default_paths())


def plain(tools, text):
    """A's and B's ids with byte ranges, the groups as text, and all links; Nones without tokens."""
    if not text:
        return None
    a, b = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
    spell = lambda ids, bytes_of: b"".join(bytes_of[i] for i in ids)
    if spell(a, tools.a_bytes) != b" " + text.encode() or spell(b, tools.b_bytes) != b" " + text.encode():
        return None
    ends = []
    for ids, bytes_of in ((a, tools.a_bytes), (b, tools.b_bytes)):
        at, mine = 0, []
        for i in ids:
            mine.append((at, at + len(bytes_of[i]), i))
            at += len(bytes_of[i])
        ends.append(mine)
    cuts = sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]})
    said, links, low, i, j = [], [], 0, 0, 0
    for high in cuts:
        i2 = next(k for k in range(i, len(ends[0])) if ends[0][k][1] == high) + 1
        j2 = next(k for k in range(j, len(ends[1])) if ends[1][k][1] == high) + 1
        mine = [ends[0][i:i2], ends[1][j:j2]]
        said.append("|".join(",".join(str(x[2]) for x in side) for side in mine))
        links += [(x[2], y[2]) for x in mine[0] for y in mine[1] if x[0] < y[1] and y[0] < x[1]]
        low, i, j = high, i2, j2
    return len(a), len(b), said, links


def brute(tools, docs):
    found = [(i, plain(tools, t)) for i, t in docs]
    count = Counter(p for _, f in found if f for p in f[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for i, f in found:
        if f is None:
            yield (i, 0, 0, 0, 0, 0, 0, "")
        else:
            yield (i, f[0], f[1], len(f[2]), len(f[3]), sum(count[p] == most[p[1]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30))
def test_groups_and_overlaps(a, b):
    ends = lambda x: [sum(x[: i + 1]) for i in range(len(x))]
    a, b = ends(a), ends(b)
    last = max(a[-1], b[-1])
    a, b = sorted({*a, last}), sorted({*b, last})
    got = alignment.groups(a, b)
    cuts = sorted({*a} & {*b})
    assert [a[g[1] - 1] for g in got] == cuts == [b[g[3] - 1] for g in got]
    links = [p for g in got for p in alignment.overlaps(a, b, g)]
    assert links == sorted((i, j) for i in range(len(a)) for j in range(len(b)) if (a[i - 1] if i else 0) < b[j] and (b[j - 1] if j else 0) < a[i])


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab thing'sé\n\t\x00 ​　<0x41>|endoftext▁ 12ü漢😀."), max_size=40))
def test_stretches_give_the_whole_texts_tokens(tools, text):
    block = alignment._Block(tools)
    block.add([1], [text])
    want = plain(tools, text)
    got = block.docs[0]
    assert got[1:6] == ((0, 0, 0, 0, "") if want is None else (want[0], want[1], len(want[2]), len(want[3]), hashlib.sha256(";".join(want[2]).encode()).hexdigest()))


def test_odd_rows_equal_brute_force(spark, tools):
    rows = [
        (1, "plain words here"), (1, "plain words here"), (None, "No id, <|endoftext|> and <s>."), (2, None), (3, ""), (4, " "), (5, "a▁b"), (6, "x" * 30_000), (7, "word\n\n  indented \t tab "),
        (8, "so many words of one kind " * 20_000), (9, "漢字かな 😀 nul\x00 byte"), (10, "tail  "),
    ]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, block int, pair int")
    got = alignment.alignments(df).select(*COLUMNS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(tools, rows)))
    assert alignment.alignments(df.limit(0)).count() == 0


def test_table_equals_brute_force(spark, tools):
    from plumbline.llm.queries import op12_alignment

    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = op12_alignment(spark, SF).select(*COLUMNS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(tools, docs)))
