"""Golden rows of the rules by locale, the readers of locale files, and salaries against an independent version."""

import json
import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import dims, extract, fixed, rules, scoring
from plumbline.sources import dimensions

LEXICON_EN = """
version: "1.0.0"
groups:
  payment:
    weight_multiplier: 1.0
    phrases:
      - {text: "registration fee", weight: 0.90}   # asked for often
      - {text: "Starter Kit", weight: 0.5}
  urgency:
    weight_multiplier: 0.5
    phrases:
      - {text: "act now", weight: 0.8}
      # - {text: "left out", weight: 0.8}
      - {text: 'today only'}
"""
LEXICON_ID = """
groups:
  payment:
    weight_multiplier: 2.0
    phrases:
      - {text: "biaya pendaftaran", weight: 0.9}
"""
WAGES_EN = {"_meta": {"fallback": 1000, "fallback_label": "national"}, "regions": {"north shire": 2000, "shire": 1500}, "aliases": {"fog city": "north shire", "lost": "nowhere"}}
WAGES_ID = {"_meta": {"national_median_fallback": 3_000_000}, "provinces": {"pulau jauh": 4_000_000}, "city_aliases": {}}


@pytest.fixture(scope="module")
def locales(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("locales")
    for name, text in (("en.yaml", LEXICON_EN), ("id.yaml", LEXICON_ID), ("en.json", json.dumps(WAGES_EN, indent=1)), ("id.json", json.dumps(WAGES_ID))):
        (root / name).write_text(text)
    paths = lambda kind: {code: f"{root}/{code}.{kind}" for code in ("en", "id")}
    lexicon, wages = dimensions.read_locales(spark, paths("yaml"), paths("json"))
    return lexicon, wages, root


def test_readers_of_locales(spark, locales):
    lexicon, wages, root = locales
    assert {tuple(r) for r in lexicon.collect()} == {
        ("en", "payment", "registration fee", 0.9), ("en", "payment", "starter kit", 0.5), ("en", "urgency", "act now", 0.4), ("en", "urgency", "today only", 0.25), ("id", "payment", "biaya pendaftaran", 1.0),
    }
    assert {tuple(r) for r in wages.collect()} == {
        ("en", "fog city", 2000, False, 1), ("en", "north shire", 2000, False, 2), ("en", "shire", 1500, False, 2), ("en", "national", 1000, True, 3), ("id", "pulau jauh", 4_000_000, False, 2), ("id", "national median", 3_000_000, True, 3),
    }
    assert dimensions.read_lexicon(spark, f"{root}/none.yaml", "en").count() == dimensions.read_wages(spark, f"{root}/none.json", "en").count() == 0


BLOCKS = """
groups:
  payment:
    phrases:
    - text: registration fee
      weight: 0.90
    - text: "Starter Kit"
      weight: .5
    weight_multiplier: 1
  "urgency": {weight_multiplier: 0.5, phrases: [{text: act now, weight: 0.8}, {text: today
      only}]}
"""


def test_lexicons_of_any_shape(spark, locales, tmp_path):
    """Blocks, flows and lines hold the same; what isn't a lexicon is an error, not an empty one."""
    pytest.importorskip("yaml")
    (tmp_path / "blocks.yaml").write_text(BLOCKS)
    want = {tuple(r) for r in locales[0].where("locale = 'en'").collect()}
    assert {tuple(r) for r in dimensions.read_lexicon(spark, str(tmp_path / "blocks.yaml"), "en").collect()} == want
    for text in ("", "version: 1", "groups:", "groups: {a: {phrases: []}}", "groups: {a: }"):
        assert list(dimensions.entries(dimensions.loaded(text))) == []
    for text in ("- a", "groups: [a]", "groups: {a: [b]}", "groups: {a: {phrases: b}}", "groups: {a: {phrases: [b]}}", "groups: {a: {phrases: [{weight: 1}]}}", "groups: {a: {phrases: [{text: b, weight: much}]}}", "groups: {a: {weight_multiplier: true, phrases: [{text: b}]}}"):
        with pytest.raises(ValueError, match="lexicon|phrase"):
            list(dimensions.entries(dimensions.loaded(text)))


def test_lines_of_a_lexicon():
    """Without a YAML library: the same from lines, and an error for any other shape."""
    yaml = pytest.importorskip("yaml")
    for text in (LEXICON_EN, LEXICON_ID):
        assert list(dimensions.entries(dimensions.lines(text))) == list(dimensions.entries(yaml.safe_load(text)))
    for text in (BLOCKS, "groups:\n  a:\n    phrases: [b]", "- a", "groups: {}", "groups:\n  a:\n    phrases:\n      - b"):
        with pytest.raises(ValueError, match="isn't understood"):
            dimensions.lines(text)


def scored(spark, locales, texts):
    lexicon, wages, _ = locales
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("locale", dims.detect_language(F.col("t")))
    wide = rules.evaluate_rules(extract.extract_mentions(df, "t"), "k", "t", lexicon, rules.SETTINGS, locale="locale", wages=wages)
    return wide.orderBy("k").collect()


CASES = [
    ("Write to jobs@gmail.com and trash@mailinator.com", {"email_free_provider": 0.55}),
    ("Write to trash@mailinator.com or jobs@gmail.com", {"email_free_provider": 0.95}),
    ("Write to hr@acme.co.uk please", {}),
    ("No way to reach us is named here", {"email_absent": 0.55}),
    ("Call 0812-3456-7890 for the job", {"email_absent": 0.35}),
    ("See https://acme.example/jobs for all", {}),
    ("See https://linktr.ee/acme for all", {}),
    ("See https://bit.ly/x for all", {"email_absent": 0.35, "url_shortener": 0.65}),
    ("See https://bit.ly/x and https://acme.example for all", {"url_shortener": 0.45}),
    ("See https://bit.ly/x and https://linktr.ee/acme for all", {"url_shortener": 0.65}),
    ("PT Maju Jaya Abadi, hr@other.com", {"email_domain_mismatch": 0.60}),
    ("PT Maju Jaya Abadi, hr@majujaya.com", {}),
    ("PT Maju Jaya Abadi, hr@mja.co.id", {}),
    ("PT Maju Jaya Abadi, hr@abadi-group.com", {}),
    ("Daftar via telegram", {"email_absent": 0.55, "contact_messaging_only": 0.75}),
    ("Chat https://wa.me/62811 now", {"contact_messaging_only": 0.35}),
    ("Chat https://wa.me/62811 or hr@acme.com now", {}),
    ("Chat https://wa.me/62811 or acme@gmail.com now", {"contact_messaging_only": 0.35, "email_free_provider": 0.55}),
    ("Interview via telegram, interview via chat, hubungi admin", {"email_absent": 0.55, "contact_messaging_only": 1.0}),
    ("Write to #EMAIL_ab12# via telegram https://bit.ly/x", {}),
    ("Fresh graduate, pengalaman minimal 5 tahun, hr@acme.com", {"qualification_conflict": 0.65}),
    ("Entry level; at least 12 years, or 3 years of experience; hr@acme.com", {"qualification_conflict": 0.85}),
    ("This is not entry level; 4 years of experience; hr@acme.com", {}),
    ("No experience; 1 year of work; hr@acme.com", {}),
    ("You pay a registration fee and a starter kit; hr@acme.com", {"payment_request_id": 0.95}),
    ("There is no registration fee; hr@acme.com", {}),
    ("Free training, but a registration fee is due; hr@acme.com", {"payment_request_id": 0.9}),
    ("The registration fee will be waived; hr@acme.com. Act now, today only", {"risk_phrase_score_id": 0.55}),
    ("Lowongan kerja untuk anda: biaya pendaftaran 50rb, hr@acme.com", {"payment_request_id": 1.0}),
    ("Lowongan kerja untuk anda: biaya pendaftaran ditanggung perusahaan, hr@acme.com", {}),
    ("Data entry, salary $9,000 per month and you have the hr@acme.com", {"salary_implausible_vs_umk": 1.0}),
    ("Data entry, salary $25 per hour and you have the hr@acme.com", {"salary_implausible_vs_umk": round(0.4 + 0.6 * (4333 / 1000 - 2.5) / 2.5, 4)}),
    ("Data entry in Fog City, salary $25 per hour and you have the hr@acme.com", {}),
    ("Senior manager, salary $5,000 and you have the hr@acme.com", {}),
    ("Data entry, salary 100k per year and you have the hr@acme.com", {"salary_implausible_vs_umk": 1.0}),
    ("Gaji 9jt untuk kurir dengan motor, hr@acme.com", {"salary_implausible_vs_umk": round(0.4 + 0.6 * (3 - 2.5) / 2.5, 4)}),
    ("Gaji Rp9.000.000 per bulan untuk kurir dengan motor di Pulau Jauh, hr@acme.com", {}),
    ("Lowongan dengan gaji 2,5 juta sampai 90 juta untuk kurir, hr@acme.com", {}),
]


def test_golden_rows(spark, locales):
    rows = scored(spark, locales, [t for t, _ in CASES])
    for row, (text, want) in zip(rows, CASES):
        got = {f: row[f].severity for f in fixed.FEATURES if row[f].severity > 0}
        assert got == pytest.approx(want), (text, got)
        for f in fixed.FEATURES:
            if row[f].severity > 0 and row[f].start is not None and f not in ("qualification_conflict", "salary_implausible_vs_umk"):
                assert text[row[f].start : row[f].end].lower() == row[f].evidence.split(",")[0].split(" +")[0].lower()
    redacted = rows[[t for t, _ in CASES].index("Write to #EMAIL_ab12# via telegram https://bit.ly/x")]
    assert [f for f in fixed.FEATURES if not redacted[f].available] == ["email_free_provider", "email_absent", "email_domain_mismatch", "contact_messaging_only", "url_shortener"]


def test_missing_resources_are_not_clean(spark, locales):
    lexicon, wages, _ = locales
    df = extract.extract_mentions(spark.createDataFrame([(1, "gaji 9jt yang dan untuk")], "k int, t string").withColumn("locale", F.lit("id")), "t")
    row = rules.evaluate_rules(df, "k", "t", lexicon.where("locale = 'en'"), rules.SETTINGS, locale="locale", wages=wages.where("locale = 'en'")).first()
    for f in ("salary_implausible_vs_umk", "payment_request_id", "risk_phrase_score_id"):
        assert row[f].available is False and row[f].severity == 0.0 and row[f].evidence is None


def test_vector_hits_and_contributions(spark, locales):
    """The fixed order, the fixed weights and the placeholder points."""
    lexicon, wages, _ = locales
    text = "Data entry, no experience, 3 years of experience, salary $9,000. You pay a registration fee. Act now via telegram https://bit.ly/x"
    df = spark.createDataFrame([(1, text)], "k int, t string").withColumn("locale", F.lit("en"))
    wide = rules.evaluate_rules(extract.extract_mentions(df, "t"), "k", "t", lexicon, rules.SETTINGS, locale="locale", wages=wages)
    vector = [0.0, 0.35, 0.0, 0.75, 0.45, 0.65, 0.7, 0.4, 0.9]  # "years of experience" rules an entry level out
    assert wide.select(rules.vector_of().alias("v")).first().v == pytest.approx(vector)
    long = rules.outcomes(wide, "k")
    assert rules.rule_vector(long, "k").first().vector == pytest.approx(vector) and all(rules.rule_vector(long, "k").first().mask)
    part = scoring.contribution(wide, "k").first()
    weights = [0.04, 0.01, 0.04, 0.08, 0.02, 0.03, 0.07, 0.06, 0.10]
    assert part.shift == pytest.approx(sum(v * w for v, w in zip(vector, weights)))
    assert part.contributions == pytest.approx({f: v * w for f, v, w in zip(fixed.FEATURES, vector, weights) if v})
    hits = rules.rule_hits(wide, "k", advisory=False).orderBy("rank").collect()
    points = [12.0, 8.0, 14.0, 16.0, 12.0, 10.0, 15.0, 15.0, 18.0]
    assert [(r.feature_id, r.contribution) for r in hits] == sorted(((f, round(v * p, 2)) for f, v, p in zip(fixed.FEATURES, vector, points) if v), key=lambda x: -x[1])
    assert [r.tier for r in hits] == ["high" if r.severity >= 0.7 else "med" if r.severity >= 0.4 else "low" for r in hits]
    idle = rules.rule_hits(wide, "k").collect()
    assert {r.contribution for r in idle} == {0.0} and [r.feature_id for r in sorted(idle, key=lambda r: r["rank"])][0] == "payment_request_id"
    dims.check_weights()
    assert sum(fixed.WEIGHTS.values()) == pytest.approx(fixed.MAX_SHIFT) and set(fixed.PLACEHOLDER_POINTS) == set(fixed.FEATURES)


def test_records_by_locale(spark, locales):
    lexicon, wages, _ = locales
    texts = ["Lowongan kerja untuk anda dengan gaji 90jt untuk kurir, kirim ke hr@gmail.com", "short", "The salary is $90,000 a month for data entry, and you will have it: hr@acme.com", "." * 40, None]
    df = spark.createDataFrame([(i, t, "id" if i == 2 else None) for i, t in enumerate(texts)], "k int, t string, asked string")
    rows = scoring.score_documents(df, "k", "t", lexicon, lambda t: F.lit(0.1), advisory=False, wages=wages, requested="asked").orderBy("k").collect()
    assert [r.reject for r in rows] == [None, "too_short", None, "not_analysable", "nothing_given"]
    assert [r.locale for r in rows][:1] == ["id"] and rows[2].locale == "id"
    assert rows[0].fired == ["email_free_provider", "salary_implausible_vs_umk"] and rows[0].score == round((1 - (0.1 + 0.55 * 0.04 + 0.07)) * 100)
    assert all(r.score is None and r.shift is None and r.fired is None for r in rows if r.reject)
    asked = scoring.score_documents(df.drop("asked"), "k", "t", lexicon, lambda t: F.lit(0.1), advisory=False, wages=wages).orderBy("k").collect()
    assert asked[2].locale == "en" and asked[2].fired == ["salary_implausible_vs_umk"]


def test_ties_of_languages(spark):
    rows = spark.createDataFrame([("the yang",), ("yang dan untuk",), ("the job and salary",), ("",), (None,)], "t string")
    assert [r.x for r in rows.select(dims.detect_language(F.col("t")).alias("x")).collect()] == ["en", "id", "en", "en", "en"]


@pytest.mark.parametrize(("text", "locale", "value"), [("$4,500", "en", 4500), ("5k", "en", 5000), ("1.5 million", "en", 1_500_000), ("9 juta", "id", 9_000_000), ("Rp9.000.000", "id", 9_000_000), ("4,5 juta", "id", 4_500_000), ("1.2.3", "en", None), ("750rb", "id", 750_000)])
def test_amounts(spark, text, locale, value):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(rules.amount(F.col("t"), rules.SETTINGS[locale].dot_is_thousands).alias("x")).first().x == value


def python_salaries(text, s):
    """Candidate salaries by Python's own engine."""
    low = text.lower()
    compiled = {n: re.compile(getattr(fixed, n).replace("(?iU)", "(?i)")) for n in ("PER_HOUR", "PER_DAY", "PER_WEEK", "PER_YEAR", "SALARY_WORDS", "COST_WORDS")}
    if not compiled["SALARY_WORDS"].search(low):
        return []
    pattern = re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), rules.amount_pattern(s)).replace("(?iU)", "(?i)")
    out = []
    for m in re.finditer(pattern, low):
        window = low[max(0, m.start() - 60) : m.end()]
        pay, cost = compiled["SALARY_WORDS"].search(window), compiled["COST_WORDS"].search(window)
        if not pay or cost and cost.start() > pay.start():
            continue
        fragment = m[0].strip()
        unit = re.search(rf"({'|'.join(sorted(fixed.UNITS, key=len, reverse=True))})\s*$", fragment)
        digits = re.sub(r"[^\d.,]", "", fragment[: unit.start()] if unit else fragment).strip(" .,")
        digits = digits.replace(".", "").replace(",", ".") if s.dot_is_thousands else digits.replace(",", "")
        try:
            value = int(float(digits) * (fixed.UNITS[unit[1]] if unit else 1))
        except ValueError:
            continue
        tail = low[m.start() : m.end() + 25]
        for name, change in (("PER_HOUR", lambda v: int(v * 173.33)), ("PER_DAY", lambda v: v * 22), ("PER_WEEK", lambda v: v * 4), ("PER_YEAR", lambda v: int(v / 12))):
            if compiled[name].search(tail):
                value = change(value)
                break
        if s.floor <= value <= s.ceiling:
            out.append((value, m.start(), m.end()))
    return out


@pytest.mark.parametrize("code", ["en", "id"])
def test_salaries_equal_python(spark, code):
    import random

    rng = random.Random(7)
    parts = ["salary", "gaji", "fee of", "deposit", "pay us", "biaya", "$", "Rp", "9", "4,500", "9.000.000", "4,5", "25", "100", "k", "jt", " juta", "million", "per hour", "/hari", "weekly", "per annum", "pa", "per bulan", "and", ".", "\n", "1.2.3", "20000", "usd", "é"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(3, 30))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.lower("t").alias("low")).select("t", rules.salaries(rules.SETTINGS[code]).alias("s")).collect()
    assert sum(len(r.s) for r in rows) > 150
    for r in rows:
        assert [(c.amount, c.start, c.end) for c in r.s] == python_salaries(r.t, rules.SETTINGS[code]), r.t


def test_amounts_beyond_a_bigint_are_none(spark):
    """Long runs of digits are no salaries, and stop nothing: neither as they are, nor by hour, day or week."""
    texts = ["salary " + "9" * 30, "salary 123,456,789,012,345,678,901", "salary " + "9" * 400, *("salary " + "9" * 18 + per for per in (" per hour", " daily", " weekly", " per year"))]
    rows = spark.createDataFrame([(t,) for t in texts], "low string").select(F.size(rules.salaries(rules.SETTINGS["en"])).alias("n"))
    assert [r.n for r in rows.collect()] == [0] * len(texts)
