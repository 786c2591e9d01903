"""Mixing, embeddings, search, near-duplicates, quality and the pipeline against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import embeddings, mixing, quality, queries, simhash, topk
from plumbline.llm.common import components
from tests.oracle import SF, compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_parity(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name])


def groups_of(n, linked):
    root = list(range(n))
    for _ in range(n):
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    return root


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (7, 7)], "u long, v long")).collect()}
    root = groups_of(200, edges)
    assert got == {i: root[i] for e in edges for i in e if e[0] != e[1]}


def test_mix_is_near_its_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 60)), "abc"[min(2, int(rng.integers(0, 6)))]) for i in range(3000)]
    rows += [(9001, None, None), (9001, None, None), (None, "x y", "a"), (9002, "big " * 2000, "b")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows)
    total = sum(r.size for r in out)
    assert sum({r.source: r.target for r in out}.values()) == pytest.approx(total)
    for source in "abc":
        mine = [r for r in out if r.source == source]
        taken, target = sum(r.copies * r.size for r in mine), mine[0].target
        assert target <= 3 * mine[0].source_size + 1e-6 and abs(taken - target) <= 2 * max(r.size for r in mine) + 0.01 * target
        assert all(0 <= r.copies <= 3 and r.copies in (math.floor(target / r.source_size), math.ceil(target / r.source_size)) for r in mine)
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert Counter((r.doc_id, r.copies) for r in out) == Counter((r.doc_id, r.copies) for r in again)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_mix_of_repeated_ids_and_clashing_columns(spark):
    rows = [(None, None, "a", 1, 2, "x", 0)] * 300 + [(7, "one two", "a", 1, 2, "x", 0)] * 300 + [(8, "three", "b", 1, 2, "x", 0)] * 10 + [(9, "four", None, 1, 2, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, rank int, lot string, source_key int")
    out = mixing.mix(df, keep=("text", "rank", "lot")).collect()
    assert len(out) == len(rows) and Counter((r.doc_id, r.text, r["rank"], r.lot) for r in out) == Counter((r[0], r[1], r[4], r[5]) for r in rows)
    for source in "ab":
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= 3 and {r.source_size for r in mine} == {sum(r.size for r in mine)}
    seven = Counter(r.copies for r in out if r.doc_id == 7)
    rate = next(r.target / r.source_size for r in out if r.doc_id == 7)
    assert set(seven) <= {math.floor(rate), math.ceil(rate)}
    assert Counter((r.doc_id, r.copies) for r in mixing.mix(df).collect()) == Counter((r.doc_id, r.copies) for r in out)


VECTOR = "vec_id long, embedding array<float>, label int, v string, least long"


def vectors(spark, seed=0, n=160):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 6))
    rows = [(i, [float(np.float32(x)) for x in base[rng.integers(12)] * rng.uniform(0.5, 2) + rng.normal(0, 0.15, 6)], int(rng.integers(2)), "x", 1) for i in range(n)]
    rows += [(500, rows[0][1], rows[0][2], "x", 1), (501, None, 0, None, None), (502, [0.0] * 6, 0, "", 0), (503, [float("nan")] * 6, 0, "", 0), (504, rows[1][1], None, "", 0), (505, [1.0, None, 1.0], 0, "", 0), (506, [1.0, 2.0], 0, "", 0), (507, [], 0, "", 0)]
    return spark.createDataFrame(rows, VECTOR), rows


@pytest.mark.parametrize("cell", [8, 2048])
def test_embedding_links(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings, "CELL", cell)
    df, rows = vectors(spark)
    good = lambda v: v and None not in v and all(map(math.isfinite, v)) and any(v)
    cos = lambda a, b: np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b))
    linked = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and good(a[1]) and good(b[1]) and len(a[1]) == len(b[1]) and a[2] is not None and a[2] == b[2] and cos(a[1], b[1]) >= 0.93]
    root, n = groups_of(len(rows), linked), Counter(i for i, _ in linked)
    want = {r[0]: (n[i], rows[root[i]][0], root[i] == i) for i, r in enumerate(rows)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.embedding_groups(df).collect()}
    assert got == want and linked
    assert embeddings.embedding_groups(df.limit(0)).count() == 0


def test_embeddings_of_one_direction_come_apart(spark, monkeypatch):
    """Different vectors of one direction, more than a cell holds: all link with all."""
    monkeypatch.setattr(embeddings, "CELL", 8)
    rows = [(i, [1.0 * i, 2.0 * i, -1.0 * i], 1) for i in range(1, 61)] + [(100 + i, [1.0, 0.0, float(i)], 1) for i in range(3)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i] == (59, 1) for i in range(1, 61)) and got[100] == (0, 100)


@pytest.mark.parametrize("kind, labels", [("string", ["a.b", "a.c", "a", "", "0.1.2"]), ("double", [0.5, 0.25, 0.125, -1.5, 1e300]), ("int", [1, 2, 3, 12, 123])])
def test_labels_of_any_kind_stay_apart(spark, monkeypatch, kind, labels):
    """Equal and near vectors under labels that hold dots, and under a null label."""
    monkeypatch.setattr(embeddings, "CELL", 6)
    monkeypatch.setattr(embeddings, "LOT", 4)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 4))
    rows = [(i, [float(x) for x in base[rng.integers(3)] + rng.integers(0, 2) * rng.normal(0, 0.05, 4)], [*labels, None][rng.integers(6)]) for i in range(150)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_groups(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    linked = [(i, j) for i, _, a in rows for j, _, b in rows if i < j and a is not None and a == b and unit[i] @ unit[j] >= 0.93]
    root = groups_of(150, linked)
    n = Counter(x for pair in linked for x in pair)
    assert got == {i: (n[i], root[i]) for i in range(150)}


def test_nested_cells_cover_their_points(spark, monkeypatch):
    """Radii cover all points below a node, and the descent drops no pair of cells that holds a link."""
    monkeypatch.setattr(embeddings, "CELL", 6)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(10, 5))
    rows = [(i, "r", [float(x) for x in base[rng.integers(10)] + rng.normal(0, 0.1, 5)], 1) for i in range(300)]
    points = embeddings.cells(spark.createDataFrame(rows, "uid long, root string, v array<double>, n_rows long"))
    nodes, deepest = embeddings.tree(points)
    held = [(r.cell, np.array(r.v) / np.linalg.norm(r.v)) for r in points.collect()]
    assert max(Counter(c for c, _ in held).values()) <= 6 and deepest > 1
    for n in nodes.collect():
        centre = np.array(n.centre) / np.linalg.norm(n.centre)
        assert all(np.linalg.norm(v - centre) <= n.radius + 1e-7 for c, v in held if c == n.node or c.startswith(n.node + "."))
    pairs = {(r.left, r.right) for r in embeddings.cell_pairs(nodes, deepest, 0.93).collect()}
    assert all((min(a, b), max(a, b)) in pairs for a, x in held for b, y in held if x @ y >= 0.93)
    assert len(pairs) < len({c for c, _ in held}) ** 2 / 4


@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(1, 60))
@settings(max_examples=40, deadline=None)
def test_dual_traversal_is_exact(seed, n, m):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 3))
    a, b = (centres[rng.integers(4, size=k)] + rng.normal(0, 0.2, (k, 3)) for k in (n, m))
    i, j = embeddings.dual_traversal(a, b, 0.93)
    cos = (a @ b.T) / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None])
    clear = np.abs(cos - 0.93) > 1e-12
    got = np.zeros_like(clear)
    got[i, j] = True
    assert (got == (cos >= 0.93))[clear].all() and len(set(zip(i.tolist(), j.tolist()))) == len(i)


@pytest.mark.parametrize("block", [16, 1024])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    df, rows = vectors(spark)
    ints = {r[0]: [math.floor(1024 * x) for x in r[1]] for r in rows if r[1] is not None and None not in r[1] and all(map(math.isfinite, r[1]))}
    want = set()
    for q in (i for i in ints if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:10])}
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_fingerprint_by_hand():
    import xxhash

    for text in ("a B c d e b c d", "one two", "ÀÉ x\ty\x0bz  w", "w"):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\x0b", " ").split(" ")
        words = [w for w in words if w]
        parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("distance", [1, 3, 5, 7])
def test_near_pairs(spark, distance):
    rng = np.random.default_rng(distance)
    codes = {int(x) for x in rng.integers(-(2**63), 2**63, 25)} | {0, -1}
    for c in list(codes):
        for flips in (1, 2, 3, 4, 5, 6):
            for b in rng.choice(64, flips, replace=False):
                c ^= -(1 << 63) if b == 63 else 1 << int(b)
            codes.add(c)
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {(a, b) for a in codes for b in codes if a < b and bits(a, b) <= distance}
    assert {tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(c,) for c in codes], "fp long"), distance).collect()} == want


def test_simhash_groups(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, rng.integers(0, 50, 120))) for _ in range(30)]
    texts += [t + " tail" for t in texts[:15]] + texts[:5] + ["", " ", None]
    ids = [*range(100, 100 + len(texts) - 1), None]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp string")
    prints = [simhash.fingerprint(t or "") for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and (prints[i] ^ prints[j]).bit_count() <= 3]
    root = groups_of(len(texts), linked)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_digest(df).collect())
    assert got == sorted((str(i), f"{p:016x}", ids[root[n]]) for n, (i, p) in enumerate(zip(ids, prints)))
    assert simhash.simhash_digest(df.limit(0)).count() == 0


def shingle_sets(texts, size=5):
    words = [t.lower().split() for t in texts]
    return [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in words]


def test_similar_groups(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 150)) for _ in range(25)]
    for t in texts[:20]:
        words = t.split()
        texts.append(" ".join([*words[:60], "other", *words[61:]]))  # similar: 5 shingles of 146 differ
        texts.append(" ".join([*words[:90], *(f"n{x}" for x in range(60))]))  # half of it: not similar
    texts += [t.upper() for t in texts[:4]] + texts[5:8] + ["", " ", None, "two words", "two other"]
    ids = [*range(500, 500 + len(texts) - 2), 500, None]
    got = simhash.similar_groups(spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids))), "doc_id long, text string, node string")).collect()
    sets = shingle_sets([t or "" for t in texts])
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    root = groups_of(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])])
    assert len(set(root)) < len(texts) - 20
    want = sorted((str(i), str(ids[r])) for i, r in zip(ids, root))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want
    assert {r.component_id for r in got} == {r.doc_id for r in got if r.kept}
    assert simhash.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_groups_recall(spark):
    """Against brute force on whole tables: no pair below the similarity, and at least nine in ten of those above it."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    sets = dict(zip((r.doc_id for r in rows), shingle_sets([r.text for r in rows])))
    holders = {}
    for i, s in sets.items():
        for h in s:
            holders.setdefault(h, []).append(i)
    shared = Counter((a, b) for held in holders.values() for n, b in enumerate(held) for a in held[:n])
    linked = {(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}
    empty = [i for i, s in sets.items() if not s]
    index = {i: n for n, i in enumerate(sorted(sets))}
    back = sorted(sets)
    root = groups_of(len(back), [(index[a], index[b]) for a, b in linked] + [(index[empty[0]], index[i]) for i in empty])
    part = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all(root[index[i]] == root[index[c]] for i, c in part.items())
    assert sum(part[a] == part[b] for a, b in linked) >= 0.9 * len(linked)


@pytest.mark.parametrize("edit", ["appended", "truncated", "replaced"])
def test_similar_groups_finds_every_pair(spark, edit):
    """Copies at a similarity of 0.8 to 0.9, by kind of edit: all are linked to their originals, with ids or without, and no others."""
    rng = np.random.default_rng(8)
    texts = []
    for n in [50] * 60 + [200] * 60 + [1000] * 20:
        words = [f"w{x}" for x in rng.integers(0, 5000, n)]
        cut = int((n - 4) * rng.uniform(0.12, 0.2))
        if edit == "appended":
            copy = words + [f"x{x}" for x in rng.integers(0, 5000, int(cut * 1.2))]
        elif edit == "truncated":
            copy = words[:-cut]
        else:
            copy = list(words)
            for at in range(2, 2 + 5 * max(1, cut // 11), 5):
                copy[at] = "x"
        texts += [" ".join(words), " ".join(copy)]
    sets = shingle_sets(texts)
    similar = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert sum(similar) > 80
    rows = [(n, t) for n, t in enumerate(texts)]
    part = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [part[2 * n + 1] == 2 * n for n in range(len(similar))] == similar


@pytest.mark.parametrize("base", [True, False])
def test_similar_groups_of_many_edits(spark, base):
    """Copies of one text with two edits each: all like the text, few like one another; ids null, repeated or given."""
    rng = np.random.default_rng(11)
    words = [f"w{x}" for x in rng.integers(0, 9000, 150)]
    texts = [" ".join(words)] * base
    for i in range(60):
        copy = list(words)
        for at in rng.choice(150, 2 if i % 3 else 3, replace=False):
            copy[at] = f"e{rng.integers(1 << 30)}"
        texts.append(" ".join(copy))
    ids = [None if i % 7 == 3 else 40 if i % 11 == 5 else 100 + i for i in range(len(texts))]
    sets = shingle_sets(texts)
    root = groups_of(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    order = lambda i: (ids[i] is None, ids[i] or 0)
    least = {r: min((i for i in range(len(texts)) if root[i] == r), key=order) for r in set(root)}
    got = simhash.similar_groups(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(ids[i]), str(ids[least[root[i]]])) for i in range(len(texts)))
    assert sum(r.kept for r in got) == len(set(root))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip(ids, texts)] + [(None, texts[0], "en", "s", 1)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_near_duplicates(spark, docs, SF).count() == len(set(root))


def test_machine_uses_the_identity():
    m = quality.Machine(seed=3)
    m.w[:] = np.random.default_rng(0).normal(size=m.w.shape)
    i, x = np.array([3, 9, 40, quality.BUCKETS]), np.array([0.5, -1.0, 2.0, 0.3])
    slow = m.bias[0] + sum(m.w[a] * b for a, b in zip(i, x)) + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    margin = lambda m: m.margins(i, x, np.array([0]))[0][0]
    assert margin(m) == pytest.approx(slow)
    again = quality.Machine.load(m.dump())
    assert margin(again) == pytest.approx(slow, abs=1e-4)


def test_scores_of_many_texts_are_those_of_each(monkeypatch):
    texts = ["", "one", "Two words! " * 40, "x" * 10_000, "a 1 | b\n" * 30, " \n", "é😀 ÀB"] * 3
    m = quality.Machine(seed=5)
    m.w[:] = np.random.default_rng(1).normal(size=m.w.shape)
    each = [float(m.scores([t])[0]) for t in texts]
    for together in (1, 50, 10**6):
        monkeypatch.setattr(quality, "TOGETHER", together)
        assert m.scores(texts).tolist() == pytest.approx(each)
    assert m.scores([]).tolist() == []


def brute_fit(rows, y, seed=42):
    """The machine's fit, row by row and pair by pair of features."""
    m = quality.Machine()
    stats = np.array([r[2] for r in rows])
    m.mean, m.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    share = np.clip(y.mean(), 0.01, 0.99)
    m.bias[0] = math.log(share / (1 - share))
    rng, past_w, past_v = np.random.default_rng(seed), np.full(m.w.shape, 1e-4), np.full(m.v.shape, 1e-4)
    for _ in range(quality.PASSES):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), quality.STEP_ROWS):
            chosen, errors = order[at : at + quality.STEP_ROWS], []
            gw, gv = np.zeros(m.w.shape), np.zeros(m.v.shape)
            touched = set()
            for r in chosen:
                i, x = m.row(*rows[r])
                margin = m.bias[0] + m.w[i] @ x + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
                errors.append(1 / (1 + math.exp(-margin)) - y[r])
                for a in range(len(i)):
                    gw[i[a]] += errors[-1] / len(chosen) * x[a]
                    gv[i[a]] += errors[-1] / len(chosen) * x[a] * sum(m.v[i[b]] * x[b] for b in range(len(i)) if b != a)
                    touched.add(int(i[a]))
            t = sorted(touched)
            gw[t] += 1e-6 * m.w[t]
            gv[t] += 1e-5 * m.v[t]
            past_w[t] += gw[t] ** 2
            past_v[t] += gv[t] ** 2
            m.w[t] -= quality.RATE * gw[t] / np.sqrt(past_w[t])
            m.v[t] -= quality.RATE / 5 * gv[t] / np.sqrt(past_v[t])
            m.bias[0] -= quality.RATE * 0.1 * np.mean(errors)
    return m


def test_fit_equals_pairs_of_features():
    texts = ["good words here", "bad! bad! 99", "calm plain text of words", "!!! $$ 7 7 7", "more good words"]
    rows = [(*quality.words_and_shapes(t), quality.statistics(t)) for t in texts]
    y = np.array([1.0, 0.0, 1.0, 0.0, 1.0])
    fast, slow = quality.Machine(), brute_fit(rows, y)
    fast.fit(rows, y)
    assert fast.w == pytest.approx(slow.w, abs=1e-9) and fast.v == pytest.approx(slow.v, abs=1e-9) and fast.bias[0] == pytest.approx(slow.bias[0])


def test_quality_takes_one_row_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(0, f"text {i}", "x") for i in range(50)] + [(i, "good text" if i % 2 else "!! 99", "x") for i in range(2, 20)], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] * 2, "doc_id long, quality int, toxic int")
    assert quality.quality_scores(docs, labels).count() == 68

def test_quality_on_held_out_rows(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.9 and np.mean([r.predicted == r.quality for r in rows]) > 0.85


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "x", 5), (1, "", 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.quality_scores(docs, none).collect()] == pytest.approx([0.5] * 3, abs=0.2)
    assert quality.quality_scores(docs.limit(0), none).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**9, "pwd: 'g7Kq-99zL!pw3' for all of us", "en", None, 5)], docs.schema))
    columns = list(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == columns and docs.count() > 0, name
        if name == "near_duplicates":
            assert docs.count() < before.count() and docs.groupBy("doc_id").count().where("count > 1").isEmpty()
            kept = {r.doc_id for r in docs.collect()}
            groups = simhash.similar_groups(before).collect()
            assert kept == {r.doc_id for r in groups if r.kept} and docs.count() == len({r.component_id if r.component_id is not None else r.text_hash for r in groups})
        if name == "secrets":
            assert docs.count() == before.count()
            assert not [r for r in docs.collect() if r.text and "g7Kq" in r.text]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
