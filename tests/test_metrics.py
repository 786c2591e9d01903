"""Metrics against brute force, with ties, and the corpus, model and streaming operators."""

import json
import math
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import boosting, corpus, evalset, features, metrics, models, prefix
from plumbline.sources import readers
from plumbline.streaming import jobs


def brute(y, s):
    order = sorted(set(s), reverse=True)
    ap, last, best = 0.0, 0.0, (0.0, 0.5)
    for t in order:
        tp, n = sum(b for a, b in zip(s, y) if a >= t), sum(a >= t for a in s)
        p, r = tp / n, tp / sum(y)
        ap, last = ap + (r - last) * p, r
        f1 = 2 * p * r / (p + r) if p + r else 0.0
        best = max(best, (f1, -t)) if best[0] != 0.0 or f1 else best
    wins = sum((a > c) + (a == c) / 2 for a, b in zip(s, y) if b for c, d in zip(s, y) if not d)
    return ap, wins / (sum(y) * (len(y) - sum(y)))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_ranking_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    y, s = (rng.random(120) < 0.2).astype(int).tolist(), np.round(rng.random(120), 1).tolist()
    y[0], y[1] = 1, 0
    got = metrics.ranking(metrics.curve(spark.createDataFrame(list(zip(s, y)), "s double, y int"), "s", "y")).first()
    ap, auc = brute(y, s)
    assert got.average_precision == pytest.approx(ap) and got.roc_auc == pytest.approx(auc)


def test_perfect_and_constant(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.1, 0)], "s double, y int")
    got = metrics.ranking(metrics.curve(df, "s", "y")).first()
    assert (got.average_precision, got.roc_auc, got.best_f1, got.best_threshold) == (1.0, 1.0, 1.0, 0.8)
    flat = metrics.ranking(metrics.curve(df.withColumn("s", F.lit(0.5)), "s", "y")).first()
    assert flat.average_precision == pytest.approx(2 / 3) and flat.roc_auc == 0.5


def test_running_sums_equal_plain_window(spark):
    rng = np.random.default_rng(3)
    values = sorted(set(np.round(rng.normal(size=800), 2).tolist()))
    df = spark.createDataFrame([("a" if i % 5 else "b", v, i) for i, v in enumerate(values)], "k string, v double, n long")
    got = {(r.k, r.v): r.cum_n for r in prefix.running_sums(df, ["k"], "v", ["n"], 16).collect()}
    for key in "ab":
        total = 0
        for k, v, n in sorted(df.where(F.col("k") == key).collect(), key=lambda r: -r.v):
            total += n
            assert got[k, v] == total


def test_calibration_bins_keep_boundaries(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (0.1, 1), (0.30000000000000004, 0)], "p double, y int")
    rows = {r.bin: r["count"] for r in metrics.calibration_bins(df, "p", "y").collect()}
    assert len(rows) == 10 and sum(rows.values()) == 4
    assert rows[0] == 2 and rows[9] == 1 and rows[3] == 1


def test_platt_recovers_and_refuses(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=1500)
    y = (rng.random(1500) < 1 / (1 + np.exp(-(1.5 * m - 0.5)))).astype(int)
    a, b = metrics.platt_fit(spark.createDataFrame(list(zip(m.tolist(), y.tolist())), "m double, y int"), "m", "y")
    p = 1 / (1 + np.exp(-(a * m + b)))
    assert abs((p - y).sum()) < 1e-4 and abs(((p - y) * m).sum()) < 1e-4
    with pytest.raises(ValueError):
        metrics.platt_fit(spark.createDataFrame([(0.1, 1)], "m double, y int"), "m", "y")


@pytest.mark.parametrize(("a", "b", "kappa"), [([1, 0, 1, 0], [1, 0, 1, 0], 1.0), ([1, 1, 0, 0], [1, 0, 1, 0], 0.0), ([1, 0], [0, 1], -1.0), ([1, 1], [1, 1], None)])
def test_kappa(spark, a, b, kappa):
    assert evalset.cohens_kappa(spark.createDataFrame(list(zip(a, b)), "a int, b int"), "a", "b").first().kappa == kappa


def test_split_is_disjoint_stratified_and_seeded(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "id long, y int")
    first = {r.id: r.split for r in corpus.stratified_split(df, "id", "y").collect()}
    assert first == {r.id: r.split for r in corpus.stratified_split(df.orderBy(F.rand(1)), "id", "y").collect()}
    assert first != {r.id: r.split for r in corpus.stratified_split(df, "id", "y", seed=7).collect()}
    assert len(first) == 2000
    for y in (0, 1):
        sizes = [sum(s == n for i, s in first.items() if int(i % 10 == 0) == y) for n in ("train", "val", "calib", "test")]
        assert sizes == [int(x * (200 if y else 1800)) for x in (0.7, 0.1, 0.1, 0.1)]


def test_eval_gate(spark):
    df = spark.createDataFrame([("id-1", "x" * 40, 1, "chat", "url"), ("id-1", "short", 2, "??", None)], "id string, text string, label int, source string, url string")
    rows = df.select(evalset.row_problems(F.col("id"), F.col("text"), F.col("label"), F.col("source"), F.col("url"), ["chat"]).alias("p")).collect()
    assert [len(r.p) for r in rows] == [0, 4]
    assert evalset.repeated_ids(df, "id", "text").count() == 1
    made = evalset.next_ids(spark.createDataFrame([("b",), ("a",)], "t string"), "t", spark.createDataFrame([("id-holdout-0007",)], "id string"), "id", "id-holdout-")
    assert [r.id for r in made.orderBy("t").collect()] == ["id-holdout-0008", "id-holdout-0009"]


def test_sources_and_appeals(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.IntegerType())])
    (tmp_path / "items.jsonl").write_text('{"id": "a", "label": 1}\n\nnot json\n{"id": "b", "label": 0}\n')
    items, bad = readers.read_eval_items(spark, str(tmp_path / "items.jsonl"), schema)
    assert sorted(r.id for r in items.collect()) == ["a", "b"] and bad.count() == 1
    assert readers.read_appeals(spark, str(tmp_path / "none"), schema).count() == 0
    assert readers.read_appeals(spark, str(tmp_path / "items.jsonl"), schema).count() == 2
    raw = spark.createDataFrame([("some text", "c" * 3000, "  ")], "text string, comment string, contact string")
    row = evalset.appeals(raw, "text", "comment", "contact", "v1").first()
    assert len(row.comment) == 2000 and row.contact is None and row.reviewed is False
    assert row.report_id == evalset.appeals(raw, "text", "comment", "contact", "v1").first().report_id
    (tmp_path / "c.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n')
    assert readers.read_csv_corpus(spark, str(tmp_path / "c.csv"), "id int, text string").first().text == 'two\nlines, "quoted"'
    assert len(readers.fingerprints(spark, str(tmp_path / "c.csv")).first().sha256) == 64


def test_streams_equal_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"id": f"{i}-{j}", "text": "t" * (j * 20), "correction": "fp" if j % 2 else None, "reviewed": j == 0}) for j in range(5)) + "\nbroken{\n")
    schema = "id string, text string, correction string, reviewed boolean"
    stream = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", 1).json(str(source))
    score = lambda df: df.select("id", F.when(F.length("text") < 30, "too_short").alias("reject"), F.length("text").alias("score"))
    run = lambda: jobs.score_stream(stream, score, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    for n in (15, 15, 20):  # a restart without new files repeats nothing, one with a new file adds its rows
        if n == 20:
            (source / "9.json").write_text("\n".join(json.dumps({"id": f"9-{j}", "text": "x" * 40}) for j in range(5)))
        run()
        batch = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(str(source))
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
        assert {r.id: r.score for r in rows} == {r.id: r.score for r in score(batch).collect()} and len(rows) == n
        assert all(str(r.rejected).lower() == str(r.reject is not None).lower() for r in rows)
    (source / "9.json").unlink()
    jobs.append_stream(stream, f"{tmp_path}/appeals", f"{tmp_path}/state2").awaitTermination()
    assert readers.read_appeals(spark, f"{tmp_path}/appeals", T._parse_datatype_string(schema)).count() == 15
    jobs.queue_stream(stream, "queue", f"{tmp_path}/state3").awaitTermination()
    assert {(r.correction, r.n, r.unreviewed) for r in spark.table("queue").collect()} == {("unknown", 9, 6), ("fp", 6, 6)}


def test_nearest_is_exact(spark, monkeypatch):
    """Neighbours of sparse rows over several blocks, ties and equal rows included."""
    monkeypatch.setattr(models, "BLOCK", 16)
    rng = np.random.default_rng(5)
    dense = np.round(rng.normal(size=(70, 6)), 1) * (rng.random((70, 6)) < 0.6)
    dense[3] = dense[4]
    rows = [(n, np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist()) for n, v in enumerate(dense)]
    got = models.nearest(spark.createDataFrame(rows, "a long, i array<int>, v array<double>"), 5).collect()
    away = ((dense[:, None] - dense[None]) ** 2).sum(2)
    near = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        near.setdefault(r.a, []).append(r.b)
    assert len(near) == 70
    for a, held in near.items():
        others = sorted(away[a][b] for b in range(70) if b != a)[:5]
        assert len(held) == 5 and a not in held and [away[a][b] for b in held] == pytest.approx(others)


@pytest.mark.parametrize("unit", [True, False])
def test_indexed_neighbours_are_exact(spark, monkeypatch, unit):
    """Rows like texts: an index serves most of them with few comparisons, negative weights, rows without terms, copies and ties included."""
    monkeypatch.setattr(models, "BLOCK", 64)
    monkeypatch.setattr(models, "INDEX_SHARE", 2)
    rng = np.random.default_rng(11)
    dense = np.zeros((300, 400))
    for n in range(300):
        own = rng.choice(8, 3) if n % 5 else rng.choice(400, 6)  # common terms
        topic = 8 + 12 * (n % 30) + rng.choice(12, 8, replace=False)
        dense[n, own], dense[n, topic] = 0.2, rng.integers(1, 4, 8) / 2
    dense[7], dense[8], dense[9] = dense[6], 0.0, -dense[6]
    if unit:
        dense /= np.maximum(np.sqrt((dense * dense).sum(1)), 1e-12)[:, None]
    rows = [(n, np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist()) for n, v in enumerate(dense)]
    got = models.nearest(spark.createDataFrame(rows, "a long, i array<int>, v array<double>"), 5, index_from=0).collect()
    away = np.round(((dense[:, None] - dense[None]) ** 2).sum(2), 9)
    want = {(a, b, rank) for a in range(300) for rank, b in enumerate([b for b in np.argsort(away[a], kind="stable") if b != a][:5], 1)}
    assert {(r.a, r.b, r["rank"]) for r in got} == want
    compared = {r.a: r.compared for r in got}
    assert len(compared) == 300 and sum(c < 299 for c in compared.values()) > 150 and max(compared.values()) == 299


@pytest.mark.parametrize("small", [2, 20, 45])
def test_oversample_balances_between_neighbours(spark, small):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist(), int(i < small)) for i in range(100)]
    vector = {i: np.array(v) for i, v, _ in rows}
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    out = models.oversample(df, "id", "v", "y").collect()
    assert len(out) == 100 - 2 * small
    each = [sum(r.id == i for r in out) for i in range(small)]
    assert max(each) - min(each) <= 1
    for r in out:
        near = sorted((b for b in range(small) if b != r.id), key=lambda b: ((vector[r.id] - vector[b]) ** 2).sum())[:5]
        on = []
        for b in near:
            line = vector[b] - vector[r.id]
            t = float((np.array(r.v) - vector[r.id]) @ line / (line @ line))
            on.append(-1e-9 <= t <= 1 and np.allclose(vector[r.id] + t * line, r.v))
        assert r.y == 1 and any(on)
    assert sorted(map(str, out)) == sorted(map(str, models.oversample(df, "id", "v", "y").collect()))
    assert models.oversample(df.where("y = 0"), "id", "v", "y").count() == models.oversample(df.limit(0), "id", "v", "y").count() == 0


def spam(n):
    rng = np.random.default_rng(n)
    good, bad, both = "calm river stone garden", "cheap prize winner now", "the and of to with it"
    make = lambda words: " ".join(rng.choice((words + " " + both).split(), 12))
    return [(make(bad if i % 4 == 0 else good), int(i % 4 == 0)) for i in range(n)]


@pytest.mark.parametrize("name", ["logistic", "svm", "oversampled"])
def test_baselines_separate(spark, name):
    df = spark.createDataFrame(spam(160), "text string, y int")
    scorer = models.FITS[name](df, "text", "y", 200)
    row = models.compare({name: scorer}, df, "y").first()
    assert row.roc_auc > 0.97 and row.best and row.passed
    out = scorer.transform(df).select("margin", "p", "y").collect()
    assert all(r.p == pytest.approx(1 / (1 + math.exp(-r.margin)), abs=1e-6) for r in out)
    assert np.mean([(r.p >= 0.5) == (r.y == 1) for r in out]) > 0.9


@pytest.mark.parametrize("loss, cost", [("logistic", 1.0), ("squared_hinge", 0.5)])
def test_linear_fits_equal_independent_ones(spark, loss, cost):
    """The same penalised loss by plain gradient descent on the weights of ``tfidf``."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate([*spam(80), (None, 0), ("", 1)])], "id int, text string, y int")
    known = models.term_weights(df.drop("id"), "text", 50, 1)
    rows = models.prepared(df, "y", known)
    scorer = models.linear(rows, "y", known, loss, cost)
    weights = {(r.id, r.term): r.weight for r in features.tfidf(df, "id", "text", 1, max_terms=50).collect()}
    x = np.array([[weights.get((i, t), 0.0) for t in known.terms] for i in range(82)])
    y = np.array([r.y for r in df.orderBy("id").collect()])
    w = np.where(y == 1, 82 / (2 * y.sum()), 82 / (2 * (82 - y.sum())))
    z, beta, b = 2.0 * y - 1, np.zeros(x.shape[1]), 0.0
    for _ in range(30_000):
        m = z * (x @ beta + b)
        slope = cost * w * z * (-1 / (1 + np.exp(m)) if loss == "logistic" else -2 * np.maximum(0, 1 - m))
        beta, b = beta - 0.01 * (x.T @ slope + beta), b - 0.01 * slope.sum()
    assert scorer.coefficients == pytest.approx(beta, abs=3e-3) and scorer.intercept == pytest.approx(b, abs=3e-3)
    margins = {r.text: r.margin for r in scorer.transform(df).collect()}
    assert margins[None] == margins[""] == pytest.approx(scorer.intercept)
    assert all(margins[r.text] == pytest.approx(x[r.id] @ scorer.coefficients + scorer.intercept) for r in df.collect())


def test_boosting_ranks(spark):
    df = spark.createDataFrame(spam(120), "text string, y int")
    assert models.compare({"boosting": models.fit_boosting(df, "text", "y", 50, 5)}, df, "y").first().roc_auc > 0.95


def test_boosting_equals_sparks_trees(spark, n=700, rounds=22):
    """Margins of Spark's own gradient-boosted trees, which take dense time, on rows with noise (so many that no two splits are equally good); rows without terms included. Rows take up their margins on the way."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(n)
    noisy = [(t if rng.random() > 0.05 else None, y if rng.random() > 0.1 else 1 - y) for t, y in spam(n)]
    df = spark.createDataFrame(noisy, "text string, y int")
    known = models.term_weights(df, "text", 50, 1)
    rows = models.prepared(df, "y", known)
    held = spark.createDataFrame([(Vectors.sparse(len(known.terms), list(zip(r._i, r._v))), r.y, r._w, r.text) for r in rows.collect()], ["x", "y", "w", "text"])
    want = GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=rounds, stepSize=0.1, maxDepth=3, seed=42).fit(held).transform(held)
    got = models.fit_boosting(df, "text", "y", 50, rounds).transform(df).collect()
    margins = {r.text: r.margin for r in got}
    assert all(margins[r.text] == pytest.approx(2 * r.rawPrediction[1], abs=1e-5) for r in want.collect()) and len({round(m, 6) for m in margins.values()}) > 20


def test_boosting_sums_the_same_in_any_order(spark):
    df = spark.createDataFrame(spam(300), "text string, y int")
    trees = [models.fit_boosting(df.repartition(p, "text"), "text", "y", 50, 4).trees for p in (1, 5)]
    assert all(np.array_equal(a.term, b.term) and np.array_equal(a.leaf, b.leaf) for a, b in zip(*trees))


def test_boosting_of_one_class_and_of_no_terms(spark):
    for rows in ([("aa bb", 1)] * 5, [("aa", 1), ("bb", 0), (None, 0), ("", 1)]):
        df = spark.createDataFrame(rows, "text string, y int")
        out = models.fit_boosting(df, "text", "y", 50, 3).transform(df).collect()
        assert len({r.margin for r in out}) == 1 and (out[0].p > 0.5) == (rows[0][0] == "aa bb")


def test_svm_averages_its_folds(spark):
    df = spark.createDataFrame(spam(120), "text string, y int")
    scorer = models.fit_svm(df, "text", "y", 100)
    each = [{r.text: r.p for r in part.transform(df).collect()} for part in scorer.parts]
    assert len(each) == 3
    for r in scorer.transform(df).collect():
        assert r.p == pytest.approx(np.mean([e[r.text] for e in each]))


def test_scorer_of_ones_own(spark):
    scorer = models.BatchScorer(lambda: lambda texts: [len(t) - 3.0 for t in texts], "text")
    got = scorer.transform(spark.createDataFrame([("abc", 1), (None, 0)], "text string, y int")).collect()
    assert [(r.margin, round(r.p, 6)) for r in got] == [(0.0, 0.5), (-3.0, round(1 / (1 + math.exp(3)), 6))]


def test_appeals_never_train(spark):
    appeals = spark.createDataFrame([("a", "t", "fp", 1)], "report_id string, text string, correction string, y int")
    for fit in models.FITS.values():
        with pytest.raises(ValueError, match="never train"):
            fit(appeals, "text", "y")


def test_model_frame_keeps_forbidden_columns_out(spark):
    df = spark.createDataFrame([(1, "Title", "two words and more here", 1, "x"), (2, "A", None, 0, "y")], "id long, title string, body string, y int, secret string")
    kept, short = corpus.model_frame(df, "id", ["title", "body"], "y", {"secret"})
    assert [tuple(r) for r in kept.collect()] == [(1, "Title\ntwo words and more here", 1, 6)] and short.first().text == "A"
    with pytest.raises(ValueError):
        corpus.model_frame(df, "id", ["title", "secret"], "y", {"secret"})


def test_splits_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, None, "train"), (3, "c", "test")], "id long, text string, split string")
    readers.write_splits(df, f"{tmp_path}/s")
    assert sorted((r.id, r.text) for r in readers.read_split(spark, f"{tmp_path}/s", "train", "text").collect()) == [(1, "a"), (2, "")]
    assert readers.read_split(spark, f"{tmp_path}/s", "none", "text").count() == 0


def test_recalibration_and_ledger(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=1500)
    y = (rng.random(1500) < 1 / (1 + np.exp(-(1.5 * m - 0.5)))).astype(int)
    df = spark.createDataFrame(list(zip(m.tolist(), y.tolist())), "m double, y int")
    rows = {r.fit: r for r in metrics.recalibrated(df, "m", "y", 1.0, 3.0).collect()}
    assert rows["refit"].mean_p == pytest.approx(y.mean(), abs=1e-6) and rows["given"].mean_p == pytest.approx(np.mean(1 / (1 + np.exp(-(m + 3)))))
    ledger = spark.createDataFrame([("abc",)], "split_checksum string")
    metrics.evaluated_once(ledger, "other")
    metrics.evaluated_once(ledger, "abc", force=True)
    with pytest.raises(ValueError):
        metrics.evaluated_once(ledger, "abc")


def test_calibration_report(spark):
    """After a fit, the error is that of an independent fit's bins."""
    rng = np.random.default_rng(6)
    p = rng.random(800)
    y = (rng.random(800) < p**2).astype(int)
    rows = {r.stage: r for r in metrics.calibration_report(spark.createDataFrame(list(zip(p.tolist(), y.tolist())), "p double, y int"), "p", "y").collect()}
    m, a, b = np.log(p / (1 - p)), 1.0, 0.0
    for _ in range(60):
        q = 1 / (1 + np.exp(-(a * m + b)))
        w = q * (1 - q)
        h = np.array([[(w * m * m).sum(), (w * m).sum()], [(w * m).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, [((q - y) * m).sum(), (q - y).sum()])
    q = 1 / (1 + np.exp(-(a * m + b)))
    bins = np.ceil(q * 10).astype(int)
    ece = sum(abs(q[bins == k].mean() - y[bins == k].mean()) * (bins == k).mean() for k in set(bins))
    assert rows["after"].ece == pytest.approx(ece) and rows["after"].brier == pytest.approx(((q - y) ** 2).mean()) and rows["before"].brier == pytest.approx(((p - y) ** 2).mean())


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    values = {"a": np.round(rng.normal(size=300), 1), "b": np.array([1.0, 1.0, 5.0]), None: np.array([2.5])}
    rows = [(k, float(v)) for k, held in values.items() for v in held] + [("a", None), ("c", None)]
    got = {r.k: r for r in metrics.percentiles(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()}
    assert set(got) == set(values)
    for k, held in values.items():
        assert [got[k].p50, got[k].p95, got[k].p99] == pytest.approx(np.percentile(held, [50, 95, 99])) and got[k]["mean"] == pytest.approx(held.mean())


def test_unknown_fields(spark):
    df = spark.createDataFrame([('{"a": 1, "z": 2}',), ("{}",), ("broken",)], "line string")
    assert [r.u for r in df.select(evalset.unknown_fields(F.col("line"), ["a"]).alias("u")).collect()] == [["z"], [], None]


def test_a_full_record_on_a_stream_equals_the_batch(spark, tmp_path):
    """Composition, evidence, hits and spans; a text with a decomposed letter, a rejected one, null."""
    from plumbline.operators import dims, scoring

    rows = [(1, "Pay the registration fee now, cafe\u0301 job.\nNo salary of the kind is told here.\nWrite to a@gmail.com today please."), (2, "short"), (3, None), (4, "Plain words about an honest job in the town.\nNothing else is asked of you at all.")]
    spark.createDataFrame(rows, "k int, t string").write.parquet(f"{tmp_path}/in")
    schema = "k int, t string"
    margin = lambda t: F.length(t) - F.length(F.replace(t, F.lit("fee"), F.lit("")))
    score = lambda df: scoring.score_documents(df, "k", "t", dims.lexicon(spark), lambda t: F.lit(0.3), advisory=False, margin=margin)
    jobs.score_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), score, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    batch = {r.k: r for r in score(spark.read.schema(schema).parquet(f"{tmp_path}/in")).collect()}
    names = [c for c in next(iter(batch.values())).asDict()]
    assert {r.k: str([r[c] for c in names]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {k: str([r[c] for c in names]) for k, r in batch.items()}
    first = batch[1]
    assert "caf\u00e9" in first.analysed and {h.feature_id for h in first.hits} == {"email_free_provider", "payment_request_id"}
    for h in first.hits:
        assert first.analysed[h.start : h.end] in ("a@gmail.com", "registration fee")
    assert first.evidence[0].text.startswith("Pay the") and first.evidence[0].delta == 3.0
    assert [first.analysed[s.start : s.end] for s in first.spans] == ["registration fee", "a@gmail.com"]
    assert batch[2].reject == "too_short" and batch[2].hits is None and batch[3].reject == "nothing_given" and [h.feature_id for h in batch[4].hits] == ["email_absent"]


def test_ordered_hash_is_that_of_the_whole_list(spark, monkeypatch):
    monkeypatch.setattr(prefix, "PIECE", 7)
    rows = [("a", i) for i in range(100, 0, -1)] + [("b", None), ("c", 5), ("c", None), ("c", 5), (None, 3), (None, 12), ("a", -4)]
    got = {r.split: (r.n, r.hash) for r in prefix.ordered_hash(spark.createDataFrame(rows, "split string, id long"), "split", "id").collect()}
    import hashlib

    for k in ("a", "b", "c", None):
        mine = [i for s, i in rows if s == k]
        text = ",".join(str(i) for i in sorted(i for i in mine if i is not None))
        assert got[k] == (len(mine), hashlib.sha256(text.encode()).hexdigest())
    assert prefix.ordered_hash(spark.createDataFrame([], "split string, id long"), "split", "id").count() == 0


def test_eval_set_gate_and_report(spark):
    schema = "id string, text string, label int, channel string, a int, b int, synthetic boolean"
    body = "A text that is long enough to be judged by two."
    rows = [("1", body, 1, "chat", 1, 1, False), ("2", body.upper(), 0, "mail", 0, 1, False), ("2", "short", 2, None, None, 1, False), (None, body + "!", None, "pigeon", 0, 0, None), ("5", body + "?", 1, "chat", 1, 1, True)]
    df = spark.createDataFrame(rows, schema)
    found = evalset.validate_eval_set(df, "id", "text", "label", ["id", "label"], {"channel": ["chat", "mail"]}, 7, 0.9)
    got = sorted((r.level, r.problem, r.item, r.n) for r in found.where("item IS NOT NULL").collect())
    assert got == [("advice", "text of 1", "2", 1), ("advice", "text too short", "2", 1), ("error", "label is not 0 or 1", "2", 1), ("error", "repeated id", "2", 2)]
    loose = {(r.level, r.problem, r.n) for r in found.where("item IS NULL").collect()}
    assert loose == {("error", "missing required field id", 1), ("error", "missing required field label", 1), ("error", "label is not 0 or 1", 1), ("advice", "channel outside its vocabulary: pigeon", 1), ("advice", "more items are needed", 2), ("advice", "share of positives is far from its target", 2)}
    assert not evalset.passes(found) and evalset.passes(found, lenient=True)
    assert evalset.passes(evalset.validate_eval_set(df.where("id = '1'"), "id", "text", "label", ["id"], {}, 1, 1.0))
    report = evalset.annotation_report(df, "label", "a", "b", "synthetic", ["channel"]).first()
    assert (report.is_synthetic, report.n_items, report.n_positive, report.n_negative, report.n_double, report.n_disagreements) == (True, 5, 2, 1, 3, 1)
    assert report.channel == {"chat": 2, "mail": 1, "null": 1, "pigeon": 1} and report.rate == pytest.approx(0.4)
    assert report.kappa == evalset.cohens_kappa(df.where("NOT coalesce(synthetic, false)"), "a", "b").first().kappa
    none = evalset.annotation_report(df.limit(0), "label", "a", "b", "synthetic", ["channel"]).first()
    assert none.n_items == 0 and none.kappa is None and none.channel == {}


def test_folds_are_fitted_in_shared_passes(spark, monkeypatch):
    """Each fold's model is the one that its own rows alone give, and all folds are asked for at once."""
    df = spark.createDataFrame(spam(90), "text string, y int")
    known = models.term_weights(df, "text", 40, 1)
    rows = models.prepared(df, "y", known)
    fold = F.pmod(F.xxhash64("text"), F.lit(3))
    rng, width = np.random.default_rng(1), len(known.terms) + 1
    points = {m: rng.normal(size=width) for m in range(3)}
    for m, (value, gradient) in models.sums_at(rows, "y", "squared_hinge", points, fold).items():
        alone, slope = models.sums_of(rows.where(fold != m), "y", "squared_hinge", points[m])
        assert value == pytest.approx(alone) and gradient == pytest.approx(slope)
    passes, asked = [], models.sums_at
    monkeypatch.setattr(models, "sums_at", lambda *a: passes.append(set(a[3])) or asked(*a))
    models.linear_folds(rows, "y", known, "squared_hinge", 0.5, 3, fold)
    assert passes[0] == {0, 1, 2} and len(passes) < sum(map(len, passes))


def test_terms_of_rows_are_counted_without_moving(spark):
    """A row's terms are counted where it is read; repeated keys, null keys and marks change nothing."""
    rows = [(1, "Été été x ÉTÉ_2 naïve"), (1, "été naïve"), (2, None), (3, "..."), (None, "a bb cc"), (None, "bb cc"), (4, "ab " * 200_000), (5, "été \U0001d4d0\U0001d4d1 b‍c")]
    df = spark.createDataFrame(rows, "id int, text string")
    want = {}
    for key, text in rows:
        words = [w.translate(str.maketrans(features._FROM, features._TO)) for w in re.findall("[\\ẃ‍]+", (text or "").lower()) if len(w) > 1]
        for term in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            want[key, term] = want.get((key, term), 0) + 1
    got = features.term_counts(df, "id", "text").collect()
    assert {(r.id, r.term): r.tf for r in got} == want and len(got) == len(want)
    per = {}
    for (_, term), tf in want.items():
        df_, cf = per.get(term, (0, 0))
        per[term] = df_ + 1, cf + tf
    for key, n in (("id", None), ("id", 3)):
        known = features.vocabulary(df, "text", key, min_df=1, max_terms=n or 100).collect()
        assert [(r.term, r.df, r.cf) for r in known] == [(t, *per[t]) for t in sorted(per, key=lambda t: (-per[t][1], t))][:n]
    unique = df.where("id > 1")
    for frame in (features.row_counts(unique, "id", "text"), features.TermWeights("text", min_df=1).fit(unique).transform(unique)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_chunks_hold_bounded_texts(monkeypatch):
    monkeypatch.setattr(features, "CHUNK", 10)
    assert list(features.chunks(pa.array(["aaaa", "bbbb", "cccc", "d" * 50, "e", ""]))) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(features.chunks(pa.array([], pa.string()))) == []


def test_weights_of_repeated_keys_are_those_of_their_texts_together(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc"), (2, "aa cc"), (None, "bb"), (None, "cc cc"), (3, None)], "id int, text string")
    together = {1: ["aa", "bb", "aa", "aa bb", "bb aa", "bb", "cc", "bb cc"], 2: ["aa", "cc", "aa cc"], None: ["bb", "cc", "cc", "cc cc"]}
    held = {t for terms in together.values() for t in terms}
    idf = {t: math.log(7 / (1 + sum(t in terms for terms in together.values()))) + 1 for t in held}
    raw = {(k, t): (1 + math.log(terms.count(t))) * idf[t] for k, terms in together.items() for t in set(terms)}
    norm = {k: math.sqrt(sum(w * w for (o, _), w in raw.items() if o == k)) for k in together}
    got = {(r.id, r.term): r.weight for r in features.tfidf(df, "id", "text", min_df=1).collect()}
    assert got == pytest.approx({(k, t): w / norm[k] for (k, t), w in raw.items()})


def test_blocks_of_many_rows_are_large(spark):
    """A row is copied once for each block, so their number bounds what is shuffled."""
    got = [r.n for r in spark.createDataFrame([(n,) for n in (1, 600, 5000, 25_000, 200_000)], "of long").select(models.blocks_of(F.col("of")).alias("n")).collect()]
    assert got == [1, 3, 8, 13, 98]


def test_distances_of_pieces_are_those_of_whole_rows(monkeypatch):
    rng = np.random.default_rng(5)
    side = lambda n: pd.DataFrame([{"i": np.sort(rng.choice(40, m, replace=False)), "v": rng.random(m)} for m in rng.integers(0, 20, n)])
    x, y = side(17), side(23)
    monkeypatch.setattr(models, "DENSE", 5)
    assert np.abs(models.dots(x, y) - models.distances(*models.densely(x, y))).max() <= 1e-9


def test_closest_rows_are_those_of_whole_distances(monkeypatch):
    """Terms of many rows and of few, ties, copies, rows without terms, and sides of which one row is on both, in small pieces."""
    rng = np.random.default_rng(8)
    made = lambda n, at: pd.DataFrame([{"a": at + j, "i": i, "v": np.round(rng.random(len(i)), 1)} for j, m in enumerate(rng.integers(0, 9, n)) for i in [np.unique(np.concatenate([rng.integers(0, 4, m), rng.integers(4, 300, m)]))]])
    x, y = made(40, 0), made(60, 100)
    y = pd.concat([y, x[10:30], y[:7].assign(a=range(200, 207))]).sort_values("a", ignore_index=True)
    for cells, products in ((100_000, 100_000), (200, 7)):
        monkeypatch.setattr(models, "CELLS", cells)
        monkeypatch.setattr(models, "PRODUCTS", products)
        for k in (1, 5, 500):
            away, want = models.distances(*models.densely(x, y)), set()
            for r, key in enumerate(x["a"]):
                want |= {(r, int(c), away[r, c]) for c in [c for c in np.argsort(away[r], kind="stable") if y["a"][c] != key][:k]}
            got = {(int(r), int(c), float(d)) for part in models.closest(x, y, k) for r, c, d in zip(*part)}
            assert {g[:2] for g in got} == {w[:2] for w in want} and sorted(g[2] for g in got) == pytest.approx(sorted(w[2] for w in want), abs=2e-9)


def test_closest_rows_work_on_shared_terms_only():
    """Rows of 50 of 50,000 terms: nearly no pair shares one, and terms that rows don't share cost nothing."""
    rng = np.random.default_rng(9)
    side = lambda at: pd.DataFrame({"a": range(at, at + 3000), "i": [np.sort(rng.choice(50_000, 50, replace=False)) for _ in range(3000)], "v": [rng.random(50) for _ in range(3000)]})
    x, y = side(0), side(3000)
    began = time.time()
    assert sum(len(part[0]) for part in models.closest(x, y, 5)) == 15_000
    assert time.time() - began < 8


def test_blocks_hold_so_many_entries(spark):
    rows = [(1000, 10), (100_000, 14_000_000), (20_000, 80_000_000), (600, 0)]
    got = [r.n for r in spark.createDataFrame(rows, "of long, held long").select(models.blocks_of(F.col("of"), F.col("held")).alias("n")).collect()]
    assert got == [4, 8, 40, 3]


def test_synthetic_rows_of_many_terms(spark):
    """The work on a synthetic row is that of its terms, not of their square."""
    rng = np.random.default_rng(6)
    rows = [(n, sorted(rng.choice(20_000, 4000, replace=False).tolist()), rng.random(4000).tolist(), int(n < 20)) for n in range(320)]
    df = spark.createDataFrame(rows, "a long, _i array<int>, _v array<double>, y int").repartition(4)
    began = time.time()
    out = models.synthetic(df, "a", "y", 3).collect()
    assert len(out) == 280 and all(r.y == 1 and list(r._i) == sorted(set(r._i)) and len(r._i) == len(r._v) for r in out)
    assert time.time() - began < 30


def jobs_of(spark, name, run):
    """What ``run`` gives, and how many jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")


def test_one_task_grows_the_trees_of_many_jobs(spark, monkeypatch):
    """To the last digit, without a job for each level of a tree; with several blocks, and rows and terms that are in none."""
    rng = np.random.default_rng(3)
    texts = [(None if rng.random() < 0.05 else t, y if rng.random() > 0.2 else 1 - y) for t, y in spam(400)]
    df = spark.createDataFrame(texts, "text string, y int").repartition(3)
    known = models.term_weights(df, "text", 60, 1)
    rows = models.prepared(df, "y", known)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 90)
    monkeypatch.setattr(boosting, "PIECE", 50)
    grow = lambda: boosting.boosted(rows, "y", len(known.terms) + 2, 12)
    trees, jobs = jobs_of(spark, "one task", grow)
    assert jobs < 12
    monkeypatch.setattr(boosting, "ONE_TASK", 0)
    others = grow()
    assert len(trees) == len(others) == 12 and any((t.term >= 0).all() for t in trees)
    assert all(np.array_equal(getattr(a, c), getattr(b, c)) for a, b in zip(trees, others) for c in ("term", "bin", "most", "leaf"))


def test_sums_of_splits_are_exact():
    """Sums of many terms together are beyond a double's whole numbers; those of each term aren't."""
    n, width = 2**15, 400
    ends = {t: np.array([0.5]) for t in range(width)}
    bins = boosting.Bins(ends, width)
    total = np.array([2.0**50 + 1, 2.0**51 + 1])
    g, w = np.zeros(2 * width), np.zeros(2 * width)
    g[1::2], w[1::2] = 1 + np.arange(width), 2.0**30 + n
    g[2 * 390 + 1] = -(2.0**49) + 3
    gain, term, at, gl, wl, *_ = boosting.split(bins, 0, width, total, g, w)
    assert (term, at, gl, wl) == (390, 0, 2.0**50 + 1 + 2.0**49 - 3, 2.0**51 + 1 - 2.0**30 - n)


@pytest.mark.parametrize("loss, folds", [("logistic", 1), ("squared_hinge", 3)])
def test_one_task_fits_what_many_jobs_do(spark, monkeypatch, loss, folds):
    rows = [*spam(150), (None, 0), ("", 1)]
    df = spark.createDataFrame(rows, "text string, y int").repartition(3)
    known = models.term_weights(df, "text", 60, 1)
    rows = models.prepared(df, "y", known)
    fold = F.pmod(F.xxhash64("text"), F.lit(folds)) if folds > 1 else None
    monkeypatch.setattr(models, "PIECE", 40)
    fit = lambda: models.fit_folds(rows, "y", known, loss, 1.0, folds, fold)
    one, jobs = jobs_of(spark, f"one task {loss}", fit)
    assert jobs < 6
    monkeypatch.setattr(models, "ONE_TASK", 0)
    many = fit()
    assert len(one) == len(many) == folds
    for a, b in zip(one, many):
        assert a.coefficients == pytest.approx(b.coefficients, abs=2e-3) and a.intercept == pytest.approx(b.intercept, abs=2e-3)
    assert models.fit_folds(rows.limit(0), "y", known, loss, 1.0, folds, fold)[0].intercept == 0


@pytest.mark.parametrize("most", [models.ONE_TASK, 0])
def test_baselines_weigh_their_rows_once(spark, monkeypatch, most):
    """Side by side or one by one, those on the same terms read one table; each is the model that it is alone."""
    monkeypatch.setattr(models, "ONE_TASK", most)
    df = spark.createDataFrame(spam(120), "text string, y int")
    made, prepared = [], models.prepared
    monkeypatch.setattr(models, "prepared", lambda *a: made.append(a) or prepared(*a))
    monkeypatch.setitem(models.FITS, "boosting", lambda *a, **b: models.fit_boosting(*a, rounds=4, **b))
    both = models.fit_baselines(df, "text", "y")
    assert list(both) == list(models.NAMES) and len(made) == 2
    alone = models.fit_logistic(df, "text", "y")
    assert both["logistic"].coefficients == pytest.approx(alone.coefficients, abs=2e-3) and len(both["boosting"].trees) == 4


def test_model_rows_are_made_once(spark):
    from plumbline.plans.catalog import _model_rows

    for rows in _model_rows(spark, "/root/testdata/sf0.001"):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
