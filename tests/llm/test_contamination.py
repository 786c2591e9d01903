"""Benchmark decontamination against brute force."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import contamination
from plumbline.llm.contamination import Windows, words_of

DOCS = "doc_id long, text string, items int, uid int"
ITEMS = "item_id string, text string, doc_id int"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    words = plain_words(text)
    hit, named = set(), set()
    for item, body in items:
        own = plain_words(body)
        size = min(len(own), window)
        for at in range(len(own) - size + 1) if own else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[at : at + size]:
                    hit |= set(range(i, i + size))
                    named |= {item} - {None}
    return len(words), hit, sorted(named)


def pieces(items):
    return [(item, b" ".join(words_of(text)).decode()) for item, text in items if words_of(text)]


@settings(max_examples=150, deadline=None)
@given(st.text("abAÉ. ", max_size=60), st.lists(st.tuples(st.sampled_from(["1", "2", "10", None]), st.text("abAÉ. ", max_size=30)), max_size=5), st.integers(1, 4))
def test_scan_equals_brute_force(text, items, window):
    n, runs, named = Windows(pieces(items), window).scan(text)
    assert (n, {w for a, b, *_ in runs for w in range(a, b)}, named) == brute(text, items, window)
    assert all(plain_words(text[start:end]) == plain_words(text)[a:b] for a, b, start, end in runs)
    assert all(x[1] < y[0] for x, y in zip(runs, runs[1:]))


def test_digest_of_odd_rows(spark):
    passage = "The quick brown fox jumps over 13 lazy dogs, and SLEEPS well today."
    long = "filler " * 200_000
    items = [("9", passage, 1), ("10", passage, 1), ("9", passage, 1), (None, "null id words", 1), ("7", None, 1), ("8", "", 1), ("6", "...", 1), ("5", "Two-Words", 1), ("a", "one " * 3000 + "tail of it", 1)]
    docs = [
        (1, passage, 0, 0), (1, passage, 0, 0), (None, "x " + passage.upper(), 0, 0), (2, None, 0, 0), (3, "", 0, 0), (4, long + passage + long, 0, 0), (5, "two words; two\nwords", 0, 0),
        (6, "null id words", 0, 0), (7, "quick brown fox jumps over 13 lazy dogs", 0, 0), (8, "a" * 500_000, 0, 0), (9, "one " * 2500 + "tail", 0, 0),
    ]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    sha = lambda *ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    n = len(plain_words(passage))
    want = [
        (1, n, n, 2, sha("10", "9"), True), (1, n, n, 2, sha("10", "9"), True), (None, n + 1, n, 2, sha("10", "9"), True), (2, 0, 0, 0, sha(), False), (3, 0, 0, 0, sha(), False),
        (4, 400_000 + n, n, 2, sha("10", "9"), True), (5, 4, 4, 1, sha("5"), True), (6, 3, 3, 0, sha(), True), (7, 8, 0, 0, sha(), False), (8, 1, 0, 0, sha(), False), (9, 2501, 2501, 1, sha("a"), True),
    ]
    assert sorted(map(str, contamination.contamination_digest(d, b).collect())) == sorted(map(str, [_row(w) for w in want]))
    assert contamination.contamination_digest(d.limit(0), b).count() == 0
    assert {(r.n_hit, r.contaminated) for r in contamination.contamination_digest(d, b.limit(0)).collect()} == {(0, False)}
    # Several automata of few bytes find the same as one.
    whole = contamination.contamination(d, b).collect()
    parted = contamination.contamination(d, b, max_bytes=5000).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parted))


def _row(values):
    from pyspark.sql import Row

    return Row(**dict(zip(("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), values)))
