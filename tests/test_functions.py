"""Golden rows and invariants of text, mention, phrase and rule operators."""

import html
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import spans as sp
from plumbline.functions import text as tx
from plumbline.operators import dims, explain, extract, fixed, phrases, rules, scoring


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


@pytest.mark.parametrize("text", ["a@b.co and x.y@z.org", "😀 a@b.co", "", "none here", "a@b.co"])
def test_spans_match_python(spark, text):
    got = one(spark, text, sp.find_spans(F.col("t"), extract.EMAIL).alias("s"))["s"]
    assert [(s.text, s.start, s.end) for s in got] == [(m[0], m.start(), m.end()) for m in re.finditer(r"[a-z.]+@[a-z]+(?:\.[a-z]+)+", text)]
    assert all(text[s.start : s.end] == s.text for s in got)


@pytest.mark.parametrize("text", ["a​b\x07c", "x" * 250 + " tail", "plain", "", "y" * 230 + "é" * 205 + "!"])
def test_sanitize_keeps_length(spark, text):
    row = tx.sanitize(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert len(row.sanitized) == len(text)
    assert not re.search("[​\x07]", row.sanitized)
    assert not re.search(r"(?s)(\S)\1{200}", row.sanitized)


def test_sanitize_null_and_nfc(spark):
    df = spark.createDataFrame([(None,), ("é",)], "t string")
    assert [r.sanitized for r in tx.sanitize(df, "t", compose=True).collect()] == ["", "é"]


def test_desegment(spark):
    got = one(spark, "knowJavaScript wellBut 20 yearsExperience at1st #EMAIL_a1b2# iPhone5", tx.desegment(F.col("t")).alias("x")).x
    assert got == "knowJavaScript well But 20 years Experience at 1st #EMAIL_a1b2# iPhone5"


def test_clean_text(spark):
    got = one(spark, "<p>A&amp;amp;B</p>\r\n\r\n\r\n\r\n  x  y  ", tx.clean_text(F.col("t")).alias("a"), tx.clean_text(F.col("t"), entities="all").alias("b"))
    assert got.a == got.b == "A&B\n\nx y"


@pytest.mark.parametrize("page", ["<nav>menu</nav><article><p>One</p><p>Two &amp; x</p></article>tail", "<script>x<y</script>Body<br/>line", "", "<div>a</div><div>b</div>"])
def test_html(spark, page):
    got = one(spark, page, tx.html_to_text(F.col("t")).alias("x")).x
    body = re.sub(rf"(?is)<({'|'.join(tx.DROPPED)})[^>]*>.*?</\1>", " ", page)
    if m := re.search(r"(?is)<(article|main)[^>]*>(.*?)</\1>", body):
        body = m[2]
    body = re.sub(r"(?i)</(p|div|li|tr|h[1-6]|br|section|article)>|<br\s*/?>", "\n", body)
    body = html.unescape(re.sub(r"<[^>]+>", " ", body))
    assert got == "\n".join(x.strip() for x in re.sub(r"[ \t]+", " ", body).split("\n") if x.strip())


@pytest.mark.parametrize(("domain", "label"), [("jobs.acme.co.uk", "acme"), ("acme.com", "acme"), ("a.b.acme.org", "acme"), ("localhost", "localhost")])
def test_registrable_label(spark, domain, label):
    assert one(spark, domain, tx.registrable_label(F.col("t")).alias("x")).x == label


@pytest.mark.parametrize(("url", "host"), [("http://u:p@Acme.com:80/x?y", "acme.com"), ("www.acme.com/x", "www.acme.com"), ("https://a.b#c", "a.b")])
def test_url_host(spark, url, host):
    assert one(spark, url, tx.url_host(F.col("t")).alias("x")).x == host


@pytest.mark.parametrize(("text", "n"), [("One is here. Two is here.", 2), ("Ask for min. three years. Then go.", 2), ("Costs 9.000.000 now! Really?", 2), ("Line one\nLine two\n\nLine three", 3), ("PT. Maju is a firm.", 1), ("", 0)])
def test_sentences(spark, text, n):
    got = one(spark, text, tx.sentences(F.col("t")).alias("s")).s
    assert len(got) == n
    assert all(text[s.start : s.end] == s.text for s in got)


def test_benefit_framing(spark):
    lexicon = dims.lexicon(spark)
    texts = [("we pay the registration fee for you",), ("a registration fee is due",), ("free training, but a registration fee is due",), ("the registration fee will be waived",), ("preregistration feeling",)]
    df = spark.createDataFrame([(i, t) for i, (t,) in enumerate(texts)], "k int, t string")
    assert sorted(r.k for r in phrases.match_phrases(df, "k", "t", lexicon).collect()) == [1, 2]


def test_score_rounds_half_even_and_is_monotone(spark):
    df = spark.createDataFrame([(0.375,), (0.385,), (0.0,), (1.0,)], "p double")
    assert [r.s for r in df.select(scoring.score(F.col("p"), F.lit(0.0)).alias("s")).collect()][:1] == [62]
    assert dims.check_weights() is None
    with pytest.raises(ValueError):
        dims.check_weights({**dims.WEIGHTS, "email_absent": 0.2})
    with pytest.raises(ValueError):
        dims.check_columns(["text", "label"], {"label"})


def test_occlusion_blames_the_trigger(spark):
    df = spark.createDataFrame([(1, "A good offer for all. Send the registration fee today. We wait for you."), (2, "Just one sentence here.")], "k int, t string")
    for native in (True, False):
        rows = explain.occlusion(df, "k", "t", lambda t: F.contains(t, F.lit("fee")).cast("double"), native=native).collect()
        assert {r.k for r in rows} == {1}
        assert rows[0].sent_no == 1 and rows[0].delta == 1.0 and rows[0].polarity == "risk"


def test_highlight_drops_overlaps(spark):
    spans = "array(struct(%s))"
    row = spark.sql("SELECT array(named_struct('start',5,'end',9)) a, array(named_struct('start',7,'end',12), named_struct('start',0,'end',4), named_struct('start',3,'end',3)) b")
    got = row.select(scoring.highlight(F.col("a"), F.col("b")).alias("x")).first().x
    assert [(s.start, s.end) for s in got] == [(0, 4), (5, 9)], spans


def test_lookup_prefers_the_longest(spark):
    names = spark.createDataFrame([("base", 1, True), ("north", 2, False), ("far north", 3, False)], "name string, amount bigint, fallback boolean")
    df = spark.createDataFrame([(1, "In the Far North."), (2, "northern"), (3, None)], "k int, t string")
    assert {r.k: r.amount for r in dims.lookup(df, "k", "t", names).collect()} == {1: 3, 2: 1, 3: 1}
    assert {r.k: r.amount for r in dims.lookup(df, "k", "t", names.where("NOT fallback")).collect()} == {1: 3, 2: None, 3: None}
    assert dims.lookup(df, "k", "t", names.limit(0)).count() == 3
    with pytest.raises(ValueError):
        dims.lookup(df, "k", "t", spark.range(dims.MAX_ROWS + 1).selectExpr("string(id) AS name", "id AS amount", "false AS fallback"))


def test_sentences_equal_python(spark):
    """Offsets of every document's sentences, by Python's own pattern engine."""
    guards = "".join(rf"(?<!\b{re.escape(a)}\.)" for a in tx.ABBREVIATIONS)
    boundary = re.compile(rf"(?i)(?:{guards}(?<=[.!?])\s+(?!\d))|\n+")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", tx.sentences(F.col("text")).alias("s")).collect()
    more = ["Call min. 3 times. Then 4. 5 left! \n\n End", "PT. Maju e.g. this. ok", " \n . ", "a.b. c"]
    rows += spark.createDataFrame([(t,) for t in more], "text string").select("text", tx.sentences(F.col("text")).alias("s")).collect()
    for r in rows:
        want, at = [], 0
        for m in [*boundary.finditer(r.text), None]:
            piece = r.text[at : m.start() if m else len(r.text)]
            if body := piece.strip():
                start = at + len(piece) - len(piece.lstrip())
                want.append((start, start + len(body)))
            at = m.end() if m else 0
        assert [(s.start, s.end) for s in r.s] == want


def test_protected_terms(spark):
    text = "goodjQueryskills BigQueryusers PowerShell7 TensorFlow2Keras endStart"
    assert one(spark, text, tx.desegment(F.col("t")).alias("x")).x == "goodjQueryskills BigQueryusers PowerShell7 TensorFlow2 Keras end Start"


def test_large_lexicon_equals_small(spark):
    rows = [("en", "g", 1.0, p, 0.5) for p in ("alpha beta", "beta", "c-d e", "x.y", "gamma", "no such words", "!?", "a a")]
    texts = [(1, "Alpha beta, C-D e; x.y"), (2, "alphabeta xbeta gamma."), (3, None), (4, "c d e beta beta"), (None, "beta"), (None, "gamma, really !? a a a"), (5, "xa a")]
    df = spark.createDataFrame(texts, "k int, t string")
    many = rows + [("en", "m", 1.0, f"zq {i}", 0.1) for i in range(20_000)]
    hits = [sorted(map(str, ((r.k, r.phrase, r.start, r.end) for r in phrases.match_phrases(df, "k", "t", dims.lexicon(spark, held)).collect()))) for held in (rows, many)]
    want = [(1, "alpha beta", 0, 10), (1, "beta", 6, 10), (1, "c-d e", 12, 17), (1, "x.y", 19, 22), (2, "gamma", 16, 21), (4, "beta", 6, 10), (None, "beta", 0, 4), (None, "gamma", 0, 5), (None, "!?", 14, 16), (None, "a a", 17, 20)]
    assert hits[0] == hits[1] == sorted(map(str, want))


@settings(max_examples=300, deadline=None)
@given(st.text("ab .,_é", max_size=30), st.lists(st.text("ab .é", min_size=1, max_size=5), min_size=1, max_size=5, unique=True))
def test_phrase_automaton_equals_patterns(text, wanted):
    """The first match of each phrase between characters that aren't part of a word."""
    got = {h["phrase"]: h["start"] for h in phrases.PhraseBook([("en", "g", p, 1.0) for p in wanted], framing=False).hits(text, None, False)}
    want = {p: m.start() for p in wanted if (m := re.search(rf"(?<!\w){re.escape(p)}(?!\w)", text))}
    assert got == want


def by_pattern(page):
    """The page's text by patterns alone, as it is defined."""
    page = re.sub(rf"(?ais)<({'|'.join(tx.DROPPED)})[^>]*>.*?</\1>", " ", page)
    if (m := re.search(r"(?ais)<(article|main)[^>]*>(.*?)</\1>", page)) and m[2]:
        page = m[2]
    page = re.sub(r"(?ai)</(p|div|li|tr|h[1-6]|br|section|article)>|<br\s*/?>", "\n", page)
    page = re.sub(r"[ \t\xa0]+", " ", html.unescape(re.sub(r"(?s)<[^>]+>", " ", page)))
    return "\n".join(x for x in (y.strip(" \r") for y in page.split("\n")) if x)


_BITS = st.sampled_from(["<script>", "</script>", "<SCRIPT src='a>b'>", "<nav", "<navx>", "</nav>", "<article class=x>", "</article>", "<main>", "</MAIN>", "<p>", "</p>", "<br >", "<", ">", "text ", "&amp;", "&nbsp", "\n", " \r\n", "<style>", "</style >", "é", "<>", "<header>", "</header>"])


@settings(max_examples=500, deadline=None)
@given(st.lists(_BITS, max_size=25).map("".join))
def test_page_text_equals_patterns(page):
    assert tx.page_text(page, html.unescape) == by_pattern(page)


@settings(max_examples=300, deadline=None)
@given(st.text("a@b. _-c", max_size=40))
def test_addresses_equal_the_plain_pattern(text):
    plain = [m[0] for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    local = r"[A-Za-z0-9._%+-]"
    assert fixed.EMAIL.startswith(rf"(?:(?<!{local})|\G){local}++@")
    found, at = [], 0  # Python has no \G: the place where the last match ended is tried first
    held = re.compile(fixed.EMAIL.replace(rf"(?:(?<!{local})|\G)", ""))
    started = re.compile(fixed.EMAIL.replace(r"|\G", ""))
    while m := held.match(text, at) or started.search(text, at):
        found.append(m[0])
        at = m.end()
    assert found == plain


@pytest.mark.parametrize("n", [1, 7, 40])
def test_highlight_and_outside_of_equal_loops(spark, n):
    rng = random.Random(n)
    rows = []
    for k in range(60):
        spans = [[(a, a + rng.randint(0, 9)) for a in (rng.randint(0, 3 * n) for _ in range(rng.randint(0, n)))] for _ in range(2)]
        rows.append((k, *([("x", a, b) for a, b in s] for s in spans)))
    kind = "array<struct<text:string,start:int,end:int>>"
    df = spark.createDataFrame(rows, f"k int, a {kind}, b {kind}")
    got = {r.k: r for r in df.select("k", scoring.highlight(F.col("a"), F.col("b")).alias("h"), sp.outside_of(F.col("a"), F.col("b")).alias("o")).collect()}
    for k, a, b in rows:
        kept = []
        for held in (a, b):
            for _, start, end in sorted(held, key=lambda s: (s[1], -s[2])):
                if end > start and not any(o[0] < end and start < o[1] for o in kept):
                    kept.append((start, end))
        assert [(s.start, s.end) for s in got[k].h] == sorted(kept)
        outside = [(s, e) for _, s, e in a if not any(c <= s and e <= d for _, c, d in b)]
        assert sorted((s.start, s.end) for s in got[k].o) == sorted(outside)


def test_hostile_texts_take_seconds(spark):
    """A domain of 50,000 labels; 100,000 matches, sentences, phrases, amounts; unclosed tags; runs without an end."""
    many = 100_000
    rows = [
        ("domain", "x@a" + ".a" * 50_000), ("mails", "a@b.co " * many), ("run", "a" * 1_000_000), ("sentences", "So it is. " * many), ("blanks", "a" + " " * many + "b. " + " " * many + "."), ("phrases", "idiot token password " * (many // 3)),
        ("amounts", "gaji rp 1.000.000 " * (many // 10)), ("long amount", "1" + ",000" * 100_000), ("tags", "<script>" * many), ("brackets", "<" * 1_000_000), ("opened", "<script" * many), ("main", "<main>" * many + "<nav>"),
    ]
    df = spark.createDataFrame(rows, "k string, t string")
    began = time.time()
    text = F.col("t")
    found = df.select("k", F.size(extract.emails(text)).alias("mails"), F.size(tx.sentences(text)).alias("sentences"), F.length(tx.html_to_text(text)).alias("page"), F.size(extract.urls(text)).alias("urls"), F.size(sp.find_spans(text, rules.amount_pattern(rules.Settings()))).alias("amounts"))
    got = {r.k: r for r in found.collect()}
    assert got["domain"].mails == 1 and got["mails"].mails == many and got["sentences"].sentences == many and got["run"].mails == 0
    hits = {r.k for r in phrases.match_phrases(df, "k", "t", dims.lexicon(spark)).select("k").distinct().collect()}
    assert hits == {"phrases"}
    scored = scoring.score_documents(df, "k", "t", dims.lexicon(spark), lambda t: F.lit(0.5)).collect()
    assert {r.reject for r in scored} == {"too_long"}
    assert time.time() - began < 120


def test_plain_prose_is_cheap(spark):
    """Places without a seam or a sentence's end aren't tried against every protected term or abbreviation."""
    df = spark.createDataFrame([("quite plain words of prose " * 250_000,)], "t string")
    one(spark, "warm", tx.desegment(F.col("t")).alias("x"))
    began = time.time()
    assert df.select((tx.desegment(F.col("t")) == F.col("t")).alias("same")).first().same
    parted = time.time()
    assert df.select(F.size(F.split("t", tx.sentence_boundary(), -1)).alias("n")).first().n == 1
    assert parted - began < 8 and time.time() - parted < 4


@pytest.mark.parametrize("text,parted", [("fooBar JavaScriptFoo iPhone7Plus", "foo Bar JavaScriptFoo iPhone7 Plus"), ("#EMAIL_a1B2#x1 a1\tB2b\nPhDmySQLServer9", "#EMAIL_a1B2#x 1 a 1\tB2b\nPhDmySQLServer 9"), ("", ""), ("ab", "ab")])
def test_seams_in_words_with_terms(spark, text, parted):
    assert one(spark, text, tx.desegment(F.col("t")).alias("x")).x == parted
