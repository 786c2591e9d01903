"""Every registered query of the library: parity with DuckDB, or rows."""

import shutil

import pytest

from plumbline.plans.catalog import QUERIES, SQL
from tests.oracle import SF, compare

#: Fitted models, at their production size: the checks are those of their results, on the tables with labels enough.
LARGER = SF.replace("sf0.001", "sf0.01")


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_linear_baselines(spark):
    """Each ranks well, the best is the one of highest average precision, and the gate is what it says."""
    rows = QUERIES["f10_comparison"](spark, LARGER).collect()
    assert [r.model for r in rows if r.best] == [max(rows, key=lambda r: r.average_precision).model] and {r.model for r in rows} == {"logistic", "svm", "boosting", "oversampled"}
    assert all(r.roc_auc > 0.5 and r.passed == (r.average_precision >= 0.8) for r in rows)


def test_top_terms_raise_the_margin(spark):
    rows = QUERIES["e4_top_terms"](spark, LARGER).collect()
    assert len(rows) == 20 and all(r.weight > 0 for r in rows) and [r.weight for r in rows] == sorted((r.weight for r in rows), reverse=True)


def test_oversampled_vectors_balance(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    small = rows.where("label = 0").count()
    out = QUERIES["f7_oversample"](spark, SF).collect()
    assert len(out) == abs(rows.count() - 2 * small) and len({r.dims for r in out}) == 1


def test_calibration_improves(spark):
    before, after = sorted(QUERIES["k6_calibrated"](spark, LARGER).collect(), key=lambda r: r.stage, reverse=True)
    assert after.brier <= before.brier and after.passed == (after.ece <= 0.05 and after.ece <= before.ece)


def test_sentences_lie_end_to_end(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["x11_sentences"](spark, SF).collect()
    assert len(rows) == len(texts) and all((r.n_sentences > 0) == bool(texts[r.doc_id].strip()) for r in rows)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["r7a_salary_candidates", "r12_rule_hits"])
def test_parity_at_word_boundaries(spark, tmp_path, name):
    """Letters with accents belong to words on both sides: after an amount, before a salary word, a number of years or a negation."""
    texts = ["the 4886 paè x", "the 4886 pa x", "é the 4886", "éthe 4886", "the 4886 /\xa0year x", "the of the x5 é7 and 12", "nonà of the 8", "the " + "9" * 30, "the " + "9" * 18 + " daily", "thé 5000k", "the 50ké"]
    spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    shutil.rmtree(tmp_path / "made")
    compare(spark, QUERIES[name], SQL[name], str(tmp_path))


def test_parity_of_references(spark, tmp_path):
    """Names without a semicolon, numbers and names that aren't among the tables' common ones are decoded on both sides."""
    texts = ["a &amp b &amp", "&ampx &copy2024", "&notit; &notin; &nosuch;", "&#65;&#x42 &#128; &#0; &#xffff; &#99999999999999999999;", "&hellip;&CounterClockwiseContourIntegral;", "&amp;lt; &&& &;"]
    spark.createDataFrame([(i, "http://a", t) for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    shutil.rmtree(tmp_path / "made")
    compare(spark, QUERIES["t9_extract_page_text"], SQL["t9_extract_page_text"], str(tmp_path))


def test_records_weigh_all_sentences(spark, tmp_path):
    """What a sentence adds counts wherever it stands in its text, on both sides; a sentence of no effect doesn't stand before it."""
    plain = [f"A plain line, number {i}, on a job." for i in range(40)]
    texts = ["\n".join([*plain, "With the truth of the month.", "Then pay it.", *plain[:3]]), "\n".join(["In this line stands one.", *plain, "Here are three: this, that, then."]), "\n".join(plain), "One line of more than thirty characters alone."]
    spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    shutil.rmtree(tmp_path / "made")
    got = {r.doc_id: r.evidence for r in QUERIES["c7_record"](spark, str(tmp_path)).collect()}
    assert got == {0: "40:250,0:0,1:0,2:0,3:0", 1: "41:200,0:50,1:0,2:0,3:0", 2: "0:0,1:0,2:0,3:0,4:0", 3: ""}
    compare(spark, QUERIES["c7_record"], SQL["c7_record"], str(tmp_path))


def test_nearest_has_all_classes(spark):
    """Each labelled vector has its neighbours, not those of one class alone."""
    labels = {r.vec_id: r.label for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.label is not None}
    rows = QUERIES["f7_nearest"](spark, SF).collect()
    assert {r.a for r in rows} == {v for v, n in labels.items() if list(labels.values()).count(n) > 1} and all(labels[r.a] == labels[r.b] for r in rows)
