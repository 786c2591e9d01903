"""The conversation trie against plain lists of turns."""

import hashlib
import random
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import conversations
from plumbline.llm.conversations import Path, ZFastTrie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            held[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in held.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    for p, who in members.items():
        ends = ",".join(str(c) for c in who if len(built[c]) == len(p))
        yield (who[0], len(p), members[p[:-1]][0] if p else None, len(who), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())


def same(spark, rows):
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int, rank int")
    got = conversations.prefix_trie(df).select(*COLUMNS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=25), st.integers(1, 5))
def test_trie_counts_all_prefixes(words, batch):
    """Each letter is a turn; its key is the prefix itself."""
    number: dict = {}
    key = lambda p: number.setdefault(p, len(number))
    trie = ZFastTrie()
    for at in range(0, len(words), batch):
        distinct = {}
        for c, w in enumerate(words[at : at + batch], at):
            if w:
                path = Path(0, [key(w[:d]) for d in range(len(w) + 1)], [1] * len(w), list(range(len(w) + 1)))
                name = (0, len(w), path.keys[-1])
                old = distinct.get(name)
                distinct[name] = (path, (1, c, 2, 3)) if old is None else (old[0], conversations.combined(old[1], (1, c, 2, 3)))
        trie.insert(distinct)
    for node in trie.handles.values():
        assert node.parent.end == node.top < node.end
    got = {(d, k): (u, sums) for d, k, u, size, reach, sums in trie.expanded()}
    want = {}
    for c, w in enumerate(words):
        for d in range(1, len(w) + 1):
            n = want.get((d, key(w[:d])), (key(w[: d - 1]), (0, c, 0, 0)))
            want[d, key(w[:d])] = (n[0], conversations.combined(n[1], (1, c, 2, 3)))
    assert got == want


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 260), 300, 417, 1001, 1002]:
        if c in (200, 17):
            continue
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["a", "bb", "", None, "c c"])))
    same(spark, rows + rows[:20])


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (5, None, "user", "first"), (5, None, None, None), (5, -1, "user", "x"), (5, 3, "b", "tie"), (5, 3, "a", "tie"), (5, 3, "a", "tie"), (-7, 0, "user", "minus"), (9, 1, "user", "long " * 50_000)]
    same(spark, rows)
    same(spark, [(c, t, "user", "same") for c in range(700) for t in range(7)])
    assert conversations.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_long_conversation_and_full_tries(spark, monkeypatch):
    monkeypatch.setattr(conversations, "STRETCH", 8)
    monkeypatch.setattr(conversations, "TRIE_TURNS", 50)
    monkeypatch.setattr(conversations, "LIST_IDS", 7)
    rng = random.Random(2)
    long = [(3, t, "user", rng.choice("ab")) for t in range(100)]
    rows = long + [(c, t, "user", x[3]) for c in (8, 9, 12) for t, x in enumerate(long[: 8 * c])] + [(c, t, "user", "a") for c in range(100, 180) for t in range(c % 9)]
    same(spark, rows)
