"""The registered queries of the library, each with the DuckDB SQL for its rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import spans as sp
from plumbline.functions import text as tx
from plumbline.operators import corpus, dims, evalset, explain, extract, features, fixed, metrics, models, phrases, rules, scoring
from plumbline.sources.readers import scratch, spread, written
from plumbline.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MARKER_WORDS = ["the ", " der ", " les ", " que "]
NAMES = [("base", 1300, True), ("the", 1500, False), ("and the", 1800, False), ("des", 1600, False), ("der", 1700, False)]
PHONE = r"\+\d \(\d{3}\) \d{3}-\d{4}"
SOURCES = ["src0", "src1", "src2", "src3"]
AUDIT = ["idiot", "license", "token", "!!", "###", "table"]
#: The rules' inputs, chosen to meet the tables' invented words.
SETTINGS = rules.Settings(
    free=("example",), disposable=(), shorteners=("blog.tionsh.example.net",), aggregators=("thther.example.org",), telegram=("thatin", "vonder"), whatsapp=("rewh", "quela"), chat_hiring=("ononst",), anonymous=("inoran", "derund"),
    no_experience=("of the", "and the", "sur la", "de los"), years=r"(?i)\b(\d{1,2})\b", salary_words=r"(?i)\b(the|and|les|une|und|los)\b", cost_words=r"(?i)\b(of|by|des|der|que)\b", senior=("hethe",), entry=("with", "avec"),
)
#: Addresses, in SQL.
_EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
COMPANY = r"\bThe[ \t]+[A-Z][A-Za-z]*"
PATTERNS = extract.Patterns(phone=PHONE, company=COMPANY)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "pages"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a label; ``y`` is 1 for low quality and ``p`` a score from their length."""
    y = read(spark, d, "labels").select("doc_id", (1 - F.col("quality")).alias("y"))
    p = F.least(F.col("n_chars") / F.lit(4000.0), F.lit(1.0))
    return docs(spark, d).select("doc_id", "n_chars", "text", "source", p.alias("p")).join(y, "doc_id")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


LABELLED = "WITH l AS (SELECT d.doc_id, d.n_chars, d.text, d.source, least(d.n_chars / 4000.0::DOUBLE, 1.0::DOUBLE) AS p, 1 - b.quality AS y FROM documents d JOIN labels b USING (doc_id))"
CURVE = LABELLED + """, t AS (SELECT p AS threshold, sum(y)::BIGINT AS pos, count(*) AS n FROM l GROUP BY p),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged, sum(pos) OVER () AS total_pos, sum(n) OVER () AS total FROM t WINDOW w AS (ORDER BY threshold DESC)),
k AS (SELECT *, tp / flagged AS prec, tp / total_pos AS rec FROM c)"""
CONTROL_SQL = tx.CONTROL.replace("'", "''")

# --- text -------------------------------------------------------------------------------------------------------


@query(rf"""SELECT doc_id, (length(text) - length(regexp_replace(text, '{CONTROL_SQL}', '', 'g')))::INTEGER AS removed,
length(regexp_replace(text, '[^\pL\pN]', '', 'g'))::INTEGER AS meaningful, length(regexp_replace(text, '[^\pL\pN]', '', 'g')) >= 20 AS analysable FROM documents""")
def t1_sanitize(spark, d):
    return tx.sanitize(docs(spark, d), "text").select("doc_id", "removed", "meaningful", "analysable")


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\pL\pN]', '', 'g'))::INTEGER AS meaningful FROM documents")
def t2_meaningful_chars(spark, d):
    return docs(spark, d).select("doc_id", tx.meaningful_chars(F.col("text")).alias("meaningful"))


@query("SELECT doc_id, CASE WHEN length(text) < 30 THEN 'too_short' WHEN length(text) > 20000 THEN 'too_long' END AS reason FROM documents")
def t3_length_gate(spark, d):
    return docs(spark, d).select("doc_id", tx.reject_reason(F.col("text")).alias("reason"))


def _entities_sql(x: str) -> str:
    # The named ones are those that the tables hold besides XML's five.
    for name, char in (("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


@query(rf"""WITH a AS (SELECT doc_id, regexp_replace({_entities_sql(_entities_sql("text"))}, '<[^>]{{1,200}}>', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '{tx.INVISIBLE}', ' ', 'g'), '\r\n?', chr(10), 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t\f\x0b]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM b)
SELECT doc_id, trim(regexp_replace(t, '(?m)^ +| +$', '', 'g'), ' ' || chr(10)) AS clean FROM c""")
def t4_clean_text(spark, d):
    return docs(spark, d).select("doc_id", tx.clean_text(F.col("text"), fused=False).alias("clean"))


def _seams_sql(x: str) -> str:
    fused = "regexp_replace({}, '([a-z])([A-Z][a-z])', '\\1 \\2', 'g')"
    x = fused.format(fused.format(x))  # twice: what a match took can begin the next
    return f"regexp_replace(regexp_replace({x}, '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Z][a-z])', '\\1 \\2', 'g')"


_KEPT_SQL = "|".join([tx.REDACTION, *(f"(?i:{p})" for p in sorted(tx.PROTECTED, key=len, reverse=True))])


@query(f"""WITH k AS (SELECT doc_id, string_split_regex(text, '{_KEPT_SQL}') AS ps, regexp_extract_all(text, '{_KEPT_SQL}') AS hs FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, len(ps) + 1), lambda i: {_seams_sql("ps[i]")} || coalesce(hs[i], '')), '') AS parted FROM k""")
def t6_desegment(spark, d):
    return docs(spark, d).select("doc_id", tx.desegment(F.col("text")).alias("parted"))


@query("SELECT doc_id, concat_ws(chr(10), nullif(trim(lang), ''), nullif(trim(regexp_replace(source, '([a-z])([0-9])', '\\1 \\2', 'g')), '')) AS doc FROM documents")
def t7_build_document(spark, d):
    return docs(spark, d).select("doc_id", tx.build_document([F.col("lang"), F.col("source")]).alias("doc"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::INTEGER AS n_words, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) < 5 AS degenerate FROM documents")
def t8_word_count(spark, d):
    return docs(spark, d).select("doc_id", tx.word_count(F.col("text")).alias("n_words")).withColumn("degenerate", F.col("n_words") < 5)


def _page_sql() -> str:
    body = "html"
    for tag in tx.DROPPED:
        body = rf"regexp_replace({body}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return rf"""WITH a AS (SELECT page_id, {body} AS b FROM pages),
m AS (SELECT page_id, coalesce(nullif(regexp_extract(b, '(?is)<article[^>]*>(.*?)</article>', 1), ''), nullif(regexp_extract(b, '(?is)<main[^>]*>(.*?)</main>', 1), ''), b) AS b FROM a),
s AS (SELECT page_id, regexp_replace(regexp_replace(b, '(?i)</(p|div|li|tr|h[1-6]|br|section|article)>|<br\s*/?>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g') AS b FROM m),
e AS (SELECT page_id, regexp_replace({_entities_sql("b")}, '[ \t\x{{a0}}]+', ' ', 'g') AS b FROM s),
p AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x, ' ' || chr(13))), lambda x: x <> ''), chr(10)) AS page_text FROM e)"""


def _unescaped_sql(x: str) -> str:
    """HTML's references, all of them and each once: numbers, names, and names without a semicolon by the longest one that HTML knows so."""
    quoted = lambda t: t.replace("'", "''")
    names = "MAP {" + ", ".join(f"'{quoted(n)}': '{quoted(c)}'" for n, c in html5.items()) + "}"
    bare = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
    # Windows' characters stand for 80 to 9f, as HTML has it; what no text may hold is left out.
    western = "MAP {" + ", ".join(f"{n}: '{quoted(bytes([n]).decode('cp1252', 'ignore') or chr(n))}'" for n in range(0x80, 0xA0)) + "}"
    banned = "n BETWEEN 1 AND 8 OR n BETWEEN 14 AND 31 OR n BETWEEN 127 AND 159 OR n BETWEEN 64976 AND 65007 OR n = 11 OR n & 65534 = 65534"
    number = "TRY_CAST(CASE WHEN h[3] IN ('x', 'X') THEN '0x' || right('0000000' || regexp_extract(h, '0*([0-9a-fA-F]*);?$', 1), greatest(7, length(regexp_extract(h, '0*([0-9a-fA-F]*);?$', 1)))) ELSE regexp_extract(h, '([0-9]+);?$', 1) END AS BIGINT)"
    code = f"""list_transform([coalesce({number}, 1114112)], lambda n: CASE WHEN n = 13 THEN chr(13) WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533)
 WHEN n BETWEEN 128 AND 159 THEN ({western})[n::INTEGER] WHEN {banned} THEN '' ELSE chr(n::INTEGER) END)[1]"""
    named = f"""coalesce(({names})[h[2:]], CASE WHEN regexp_matches(h, '^&(?:{bare})') THEN ({names})[regexp_extract(h, '^&({bare})', 1)] || regexp_replace(h, '^&(?:{bare})', '') END, h)"""
    pattern = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
    return f"""list_transform([{x}], lambda whole: array_to_string(list_transform(list_zip(string_split_regex(whole, '{pattern}'), regexp_extract_all(whole, '{pattern}')),
 lambda z: list_transform([z], lambda y: y[1] || coalesce(list_transform([y[2]], lambda h: CASE WHEN h[2] = '#' THEN {code} ELSE {named} END)[1], ''))[1]), ''))[1]"""


@query(_page_sql().replace(_entities_sql("b"), _unescaped_sql("b")) + " SELECT * FROM p")
def t9_extract_page_text(spark, d):
    return pages(spark, d).select("page_id", tx.html_to_text(F.col("html")).alias("page_text"))


@query(_page_sql() + f""", g AS (SELECT page_id, page_text AS t, list_filter(string_split(page_text, chr(10)), lambda x: x <> '') AS ls FROM p)
SELECT page_id, CASE WHEN length(t) < 200 THEN 'too_short' WHEN length(t) > 8000 THEN 'too_long_for_one_ad'
 WHEN len(list_filter({sql_list(MARKER_WORDS)}, lambda m: contains(lower(t), m))) = 0 THEN 'no_job_ad_markers'
 WHEN list_sum(list_transform(ls, lambda x: length(x))) < 15 * len(ls) THEN 'looks_like_navigation' ELSE '' END AS reason FROM g""")
def t10_page_gate(spark, d):
    page = pages(spark, d).select("page_id", tx.html_to_text(F.col("html")).alias("t"))
    return page.select("page_id", tx.page_gate(F.col("t"), MARKER_WORDS).alias("reason"))


@query(r"SELECT page_id, trim(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/') <> '' AS redirected FROM pages")
def t11_redirected_to_root(spark, d):
    root = F.regexp_replace("url", r"^([^:]+://[^/?#]*).*$", "$1/")
    return pages(spark, d).select("page_id", tx.redirected_to_root(F.col("url"), root).alias("redirected"))


@query(r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS text_key FROM documents")
def t12_dup_key(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.text_key(F.col("text"))).alias("text_key"))


@query(r"""WITH a AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 220 THEN substr(t, 1, 220) || '…' ELSE t END AS excerpt FROM a""")
def t13_excerpt(spark, d):
    return docs(spark, d).select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


@query(rf"SELECT doc_id, regexp_matches(text, '{tx.REDACTION}') AS redacted FROM documents")
def t14_redaction_markers(spark, d):
    return docs(spark, d).select("doc_id", tx.has_redaction(F.col("text")).alias("redacted"))


# --- mentions ---------------------------------------------------------------------------------------------------


def _spans_sql(regex: str) -> str:
    return rf"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '{regex}') AS h, string_split_regex(text, '{regex}') AS p FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(h) + 1)) AS i, h, p FROM m WHERE len(h) > 0),
y AS (SELECT doc_id, i, (list_sum(list_transform(p[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda s: length(s))), 0))::BIGINT AS s, length(h[i]) AS n FROM x)
SELECT doc_id, string_agg(s || ':' || (s + n), ',' ORDER BY i) AS spans FROM y GROUP BY doc_id"""


def _spans(spark, d, regex: str) -> DataFrame:
    found = docs(spark, d).select("doc_id", sp.find_spans(F.coalesce("text", F.lit("")), regex).alias("s"))
    return found.where(F.size("s") > 0).select("doc_id", sp.spelled(F.col("s")).alias("spans"))


_URL_SQL = extract.URL.replace("'", "''").replace('\\"', '"')


@query(_spans_sql(_EMAIL_SQL))
def x0_email_spans(spark, d):
    return _spans(spark, d, extract.EMAIL)


@query(_spans_sql(PHONE))
def x3_phone_spans(spark, d):
    return _spans(spark, d, PHONE)


@query(rf"""WITH m AS (SELECT page_id, 'See ' || url || '.' || chr(10) || html AS t FROM pages),
h AS (SELECT page_id, regexp_extract_all(t, '{_URL_SQL}') AS us, string_split_regex(t, '{_URL_SQL}') AS ps FROM m),
x AS (SELECT page_id, unnest(range(1, len(us) + 1)) AS i, us, ps FROM h),
s AS (SELECT page_id, i, regexp_replace(us[i], '[.,;:!?)]+$', '') AS u, (list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(us[1:i - 1], lambda p: length(p))), 0))::BIGINT AS a FROM x)
SELECT page_id, string_agg(a || ':' || (a + length(u)) || ':' || u, ' ' ORDER BY i) AS links FROM s GROUP BY page_id""")
def x2_links(spark, d):
    text = F.concat(F.lit("See "), F.col("url"), F.lit(".\n"), F.col("html"))
    found = pages(spark, d).select("page_id", extract.urls(text).alias("u"))
    return found.select("page_id", F.array_join(F.transform("u", lambda s: F.concat_ws(":", s["start"], s["end"], s["text"])), " ").alias("links"))


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL_SQL}'))::INTEGER AS n_emails, len(regexp_extract_all(text, '(?i)(?:https?://|www\.)[^\s]+'))::INTEGER AS n_urls FROM documents")
def x1_mentions(spark, d):
    found = extract.extract_mentions(docs(spark, d), "text")
    return found.select("doc_id", F.size("emails").alias("n_emails"), F.size("urls").alias("n_urls"))


@query(_spans_sql(tx.REDACTION))
def x5_redaction_spans(spark, d):
    return _spans(spark, d, tx.REDACTION)


@query(_spans_sql(COMPANY).replace("SELECT doc_id, string_agg", "SELECT doc_id, first(company) AS company, string_agg").replace("SELECT doc_id, i, (", "SELECT doc_id, i, h[1] AS company, ("))
def x4_companies(spark, d):
    found = extract.extract_mentions(docs(spark, d), "text", PATTERNS).where("company IS NOT NULL")
    return found.select("doc_id", sp.spelled(F.col("companies")).alias("spans"), "company")


@query(r"SELECT doc_id, substr(trim(regexp_extract(text, '[^\n]*\S[^\n]*')), 1, 120) AS title FROM documents")
def x6_title(spark, d):
    return docs(spark, d).select("doc_id", extract.title(F.col("text")).alias("title"))


HOST_SQL = r"regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', ''), '^[^/?#]*'), '^.*@', ''), ':\d*$', '')"
_SUFFIX_SQL = "|".join(s.replace(".", r"\.") for s in tx.SUFFIXES)


@query(rf"""WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages),
r AS (SELECT page_id, host, CASE WHEN regexp_matches(host, '\.({_SUFFIX_SQL})$') THEN regexp_replace(host, '\.({_SUFFIX_SQL})$', '') ELSE regexp_replace(host, '\.[^.]*$', '') END AS rest FROM h)
SELECT page_id, host, string_split(rest, '.')[-1] AS label FROM r""")
def x8_registrable_label(spark, d):
    host = tx.url_host(F.col("url"))
    return pages(spark, d).select("page_id", host.alias("host"), tx.registrable_label(host).alias("label"))


@query(rf"SELECT page_id, {HOST_SQL} AS host FROM pages")
def x9_url_host(spark, d):
    return pages(spark, d).select("page_id", tx.url_host(F.col("url")).alias("host"))


@query(r"""SELECT doc_id, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS form,
array_to_string(list_transform(string_split_regex(lower(text), '\s+'), lambda w: regexp_extract(w, '^\pL')), '') AS acronym FROM documents""")
def x10_match_form(spark, d):
    return docs(spark, d).select("doc_id", tx.match_form(F.col("source")).alias("form"), tx.acronym(F.col("text")).alias("acronym"))


@query()
def x11_sentences(spark, d):
    found = docs(spark, d).select("doc_id", tx.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    return found.select("doc_id", F.size("s").alias("n_sentences"), F.md5(sp.spelled(F.col("s"))).alias("offsets"))


# --- language and dimensions ------------------------------------------------------------------------------------


def _votes_sql() -> str:
    votes = ", ".join(f"len(list_filter({sql_list(ms)}, lambda m: contains(low, m))) AS {lang}" for lang, ms in dims.MARKERS.items())
    case = " ".join(f"WHEN {lang} > greatest({', '.join(o for o in dims.MARKERS if o != lang)}) THEN '{lang}'" for lang in dims.MARKERS)
    return f"WITH t AS (SELECT doc_id, lang AS given, ' ' || lower(text) || ' ' AS low FROM documents), v AS (SELECT doc_id, given, {votes} FROM t), w AS (SELECT doc_id, given, CASE {case} ELSE 'en' END AS vote FROM v)"


@query(_votes_sql() + " SELECT doc_id, vote FROM w")
def l1_language_vote(spark, d):
    return docs(spark, d).select("doc_id", dims.detect_language(F.col("text"), dims.MARKERS).alias("vote"))


@query(_votes_sql() + " SELECT doc_id, CASE WHEN given IN ('en', 'de') THEN given WHEN vote IN ('en', 'de') THEN vote ELSE 'en' END AS locale FROM w")
def l2_resolve_locale(spark, d):
    return docs(spark, d).select("doc_id", dims.resolve_locale(F.col("lang"), dims.detect_language(F.col("text"), dims.MARKERS), ["en", "de"], "en").alias("locale"))


@query("""WITH n(name, amount) AS (VALUES ('the', 1500), ('and the', 1800), ('des', 1600), ('der', 1700)),
h AS (SELECT doc_id, name, amount, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS r FROM documents JOIN n
  ON contains(lower(text), name) AND regexp_matches(lower(text), '(^|[^\\pL\\pN_])' || name || '([^\\pL\\pN_]|$)'))
SELECT d.doc_id, coalesce(name, 'base') AS name, coalesce(amount, 1300)::BIGINT AS amount FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id AND r = 1""".replace("\\\\", "\\"))
def l4_dimension_lookup(spark, d):
    names = spark.createDataFrame(NAMES, "name string, amount bigint, fallback boolean")
    return dims.lookup(docs(spark, d), "doc_id", "text", names)


def _lexicon_sql() -> str:
    rows = ", ".join(f"('{g}', '{p}', least({w}::DOUBLE * {m}::DOUBLE, 1.0::DOUBLE))" for _, g, m, p, w in dims.LEXICON)
    return rf"WITH x(grp, phrase, weight) AS (VALUES {rows}), h AS (SELECT doc_id, grp, phrase, weight FROM documents JOIN x ON contains(lower(text), phrase) AND regexp_matches(lower(text), '(^|[^\pL\pN_])' || phrase || '([^\pL\pN_]|$)'))"


@query(_lexicon_sql() + " SELECT doc_id, grp, phrase, round(weight, 6) AS weight FROM h")
def l5_phrase_hits(spark, d):
    hits = phrases.match_phrases(docs(spark, d), "doc_id", "text", dims.lexicon(spark), framing=False)
    return hits.select("doc_id", "grp", "phrase", r6("weight").alias("weight"))


_BOUND = r"[^\pL\pN\pM\p{Pc}]"
_SQ = lambda parts: "|".join(parts).replace("'", "''")


def _framed_sql(table: str = "documents", text: str = "text") -> str:
    """``hits``: each phrase of the lexicon once per document, at its first place without a benefit around it."""
    rows = ", ".join(f"('{g}', '{p}', least({w}::DOUBLE * {m}::DOUBLE, 1.0::DOUBLE))" for _, g, m, p, w in dims.LEXICON)
    return rf"""x(grp, phrase, weight) AS (VALUES {rows}),
ph AS (SELECT doc_id, lower({text}) AS low, grp, phrase, weight, string_split(lower({text}), phrase) AS ps FROM {table} JOIN x ON contains(lower({text}), phrase)),
po AS (SELECT doc_id, low, grp, phrase, weight, (list_sum(list_transform(ps[1:i], lambda p: length(p))) + (i - 1) * length(phrase))::BIGINT AS s FROM (SELECT *, unnest(range(1, len(ps))) AS i FROM ph)),
pc AS (SELECT *, s + length(phrase) AS e, string_split_regex(substr(low, greatest(s - {fixed.BENEFIT_WINDOW}, 0) + 1, least(s, {fixed.BENEFIT_WINDOW})), '\b(?:{_SQ(fixed.CLAUSE_WORDS)})\b|[.;!?\n]')[-1] AS clause FROM po
  WHERE (s = 0 OR regexp_matches(substr(low, s, 1), '{_BOUND}')) AND (s + length(phrase) = length(low) OR regexp_matches(substr(low, s + length(phrase) + 1, 1), '{_BOUND}'))),
hits AS (SELECT doc_id, grp, phrase, weight, min(s) AS s, min(e) AS e FROM pc
  WHERE NOT regexp_matches(clause, '(^|{_BOUND})(?:{_SQ(fixed.BENEFIT_BEFORE)})({_BOUND}|$)') AND NOT regexp_matches(substr(low, e + 1, {fixed.BENEFIT_WINDOW}), '^\s*(?:{_SQ(fixed.BENEFIT_AFTER)})({_BOUND}|$)') GROUP BY ALL)"""


@query(f"WITH {_framed_sql()} SELECT doc_id, grp, phrase, s::INTEGER AS start, e::INTEGER AS \"end\" FROM hits")
def l6_benefit_framing(spark, d):
    hits = phrases.match_phrases(docs(spark, d), "doc_id", "text", dims.lexicon(spark))
    return hits.select("doc_id", "grp", "phrase", "start", "end")


@query(_lexicon_sql() + " SELECT doc_id, grp, phrase FROM h")
def l5_large_lexicon(spark, d):
    """A lexicon of 50,000 phrases more, of which no text holds any: the plan and the result are those of a small one."""
    many = spark.range(50_000).select(F.lit("en").alias("locale"), F.lit("many").alias("grp"), F.concat(F.lit("zq "), F.md5(F.col("id").cast("string"))).alias("phrase"), F.lit(0.1).alias("weight"))
    hits = phrases.match_phrases(docs(spark, d), "doc_id", "text", dims.lexicon(spark).unionByName(many), framing=False)
    return hits.select("doc_id", "grp", "phrase")


@query(rf"""WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages)
SELECT page_id, CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'free' WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'disposable'
 WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'shortener' END AS class FROM h""")
def l7_host_class(spark, d):
    return pages(spark, d).select("page_id", rules.domain_class(tx.url_host(F.col("url")), dict(dims.HOST_CLASSES)).alias("class"))


# --- rules and scores -------------------------------------------------------------------------------------------


def _evaluated(spark, d, keep: tuple[str, ...] = ()) -> DataFrame:
    mentions = extract.extract_mentions(docs(spark, d).select("doc_id", "text", *keep), "text", PATTERNS).withColumn("minimum", F.lit(40).cast("bigint"))
    return rules.evaluate_rules(mentions, "doc_id", "text", dims.lexicon(spark), SETTINGS)


def _any_sql(low: str, values: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({low}, '{v}')" for v in values) + ")"


def _java_sql(pattern: str) -> str:
    return pattern.replace("(?iU)", "(?i)").replace("'", "''")


_QUOTED = "|".join(f"[{t}]" if len(t) == 1 else t.replace("$", "[$]") for t in SETTINGS.currency)
_UNITS = "|".join(sorted(fixed.UNITS, key=len, reverse=True))
_MONEY = rf"(?:(?:{_QUOTED})\s*)?"
_AMOUNTS = rf"(?i)(?:{_MONEY}(?:\d{{1,3}}(?:,\d{{3}})+(?:\.\d{{1,2}})?|\d{{1,4}}(?:\.\d{{1,3}})?)\s*(?:{_UNITS})\b|{_MONEY}\d{{1,3}}(?:,\d{{3}})+(?:\.\d{{1,2}})?|(?:{_QUOTED})\s*\d{{1,4}}(?:[.,]\d{{1,2}})?|\d{{4,}})"
_UNIT_CASE = "CASE regexp_extract(lower(f), '(" + _UNITS + ")\\s*$', 1) " + " ".join(f"WHEN '{u}' THEN {v}::DOUBLE" for u, v in fixed.UNITS.items()) + " ELSE 1.0::DOUBLE END"
#: Candidate salaries by the same fixed patterns: ``pay(doc_id, amount)``.
PAY_SQL = rf"""am AS (SELECT doc_id, low, regexp_extract_all(low, '{_AMOUNTS}') AS h, string_split_regex(low, '{_AMOUNTS}') AS p FROM (SELECT doc_id, lower(text) AS low FROM documents) WHERE regexp_matches(low, '{_java_sql(SETTINGS.salary_words)}')),
ax AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM am WHERE len(h) > 0),
ay AS (SELECT doc_id, low, h[i] AS f, (list_sum(list_transform(p[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda s: length(s))), 0))::BIGINT AS s FROM ax),
az AS (SELECT *, substr(low, greatest(s - 60, 0) + 1, s + length(f) - greatest(s - 60, 0)) AS w, substr(low, s + 1, length(f) + 25) AS tail FROM ay),
aw AS (SELECT *, length(regexp_extract(w, '(?s)^.*?(?:{_java_sql(SETTINGS.salary_words)})')) - length(regexp_extract(w, '{_java_sql(SETTINGS.salary_words)}')) AS at_pay, regexp_matches(w, '{_java_sql(SETTINGS.salary_words)}') AS has_pay,
  length(regexp_extract(w, '(?s)^.*?(?:{_java_sql(SETTINGS.cost_words)})')) - length(regexp_extract(w, '{_java_sql(SETTINGS.cost_words)}')) AS at_cost, regexp_matches(w, '{_java_sql(SETTINGS.cost_words)}') AS has_cost,
  trunc(TRY_CAST(replace(trim(regexp_replace(regexp_replace(lower(trim(f)), '({_UNITS})\s*$', ''), '[^\d.,]', '', 'g'), ' .,'), ',', '') AS DOUBLE) * {_UNIT_CASE})::BIGINT AS raw FROM az),
pay AS (SELECT doc_id, amount FROM (SELECT doc_id, CASE WHEN regexp_matches(tail, '{_java_sql(fixed.PER_HOUR)}') THEN trunc(raw * 173.33::DOUBLE)::BIGINT WHEN regexp_matches(tail, '{_java_sql(fixed.PER_DAY)}') THEN raw * 22
  WHEN regexp_matches(tail, '{_java_sql(fixed.PER_WEEK)}') THEN raw * 4 WHEN regexp_matches(tail, '{_java_sql(fixed.PER_YEAR)}') THEN trunc(raw / 12.0::DOUBLE)::BIGINT ELSE raw END AS amount FROM aw WHERE has_pay AND (NOT has_cost OR at_cost <= at_pay)) WHERE amount BETWEEN 100 AND 100000)"""

def _worded(low: str, digits: bool = False) -> str:
    """The text for RE2, whose word characters, blanks and digits are ASCII's: each other one of Unicode's is put as one of ASCII's, so offsets stay."""
    x = f"regexp_replace({low}, '\\p{{Nd}}', '0', 'g')" if digits else low
    x = f"regexp_replace({x}, '[^\\x00-\\x7f\\p{{Z}}\\p{{S}}\\p{{P}}\\p{{No}}\\p{{C}}]|\\p{{Pc}}|[\\x{{200c}}\\x{{200d}}]', '_', 'g')"
    return f"regexp_replace({x}, '[\\x0b\\x{{85}}\\p{{Z}}]', ' ', 'g')"


#: The same with the word boundaries of the rules' patterns, which are Unicode's ("pa" isn't a word in "paè"), and without an error where an amount exceeds a bigint.
EXACT_PAY_SQL = rf"""am AS (SELECT doc_id, low, wd, td, regexp_extract_all(td, '{_AMOUNTS}') AS h, string_split_regex(td, '{_AMOUNTS}') AS p FROM (SELECT doc_id, lower(text) AS low, {_worded("lower(text)")} AS wd, {_worded("lower(text)", digits=True)} AS td FROM documents) WHERE regexp_matches(wd, '{_java_sql(SETTINGS.salary_words)}')),
ax AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM am WHERE len(h) > 0),
ay AS (SELECT doc_id, low, wd, td, length(h[i]) AS n, (list_sum(list_transform(p[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda s: length(s))), 0))::BIGINT AS s FROM ax),
az AS (SELECT *, substr(low, s + 1, n) AS f, substr(wd, greatest(s - 60, 0) + 1, s + n - greatest(s - 60, 0)) AS w, substr(td, s + 1, n + 25) AS tail FROM ay),
aw AS (SELECT *, length(regexp_extract(w, '(?s)^.*?(?:{_java_sql(SETTINGS.salary_words)})')) - length(regexp_extract(w, '{_java_sql(SETTINGS.salary_words)}')) AS at_pay, regexp_matches(w, '{_java_sql(SETTINGS.salary_words)}') AS has_pay,
  length(regexp_extract(w, '(?s)^.*?(?:{_java_sql(SETTINGS.cost_words)})')) - length(regexp_extract(w, '{_java_sql(SETTINGS.cost_words)}')) AS at_cost, regexp_matches(w, '{_java_sql(SETTINGS.cost_words)}') AS has_cost,
  TRY_CAST(trunc(TRY_CAST(replace(trim(regexp_replace(regexp_replace(lower(trim(f)), '({_UNITS})\s*$', ''), '[^\d.,]', '', 'g'), ' .,'), ',', '') AS DOUBLE) * {_UNIT_CASE}) AS BIGINT) AS raw FROM az),
pay AS (SELECT doc_id, amount FROM (SELECT doc_id, CASE WHEN regexp_matches(tail, '{_java_sql(fixed.PER_HOUR)}') THEN TRY_CAST(trunc(raw * 173.33::DOUBLE) AS BIGINT) WHEN regexp_matches(tail, '{_java_sql(fixed.PER_DAY)}') THEN TRY_CAST(raw::HUGEINT * 22 AS BIGINT)
  WHEN regexp_matches(tail, '{_java_sql(fixed.PER_WEEK)}') THEN TRY_CAST(raw::HUGEINT * 4 AS BIGINT) WHEN regexp_matches(tail, '{_java_sql(fixed.PER_YEAR)}') THEN trunc(raw / 12.0::DOUBLE)::BIGINT ELSE raw END AS amount FROM aw WHERE has_pay AND (NOT has_cost OR at_cost <= at_pay)) WHERE amount BETWEEN 100 AND 100000)"""
_LABEL_SQL = f"string_split(CASE WHEN regexp_matches(dom, '\\.({_SUFFIX_SQL})$') THEN regexp_replace(dom, '\\.({_SUFFIX_SQL})$', '') ELSE regexp_replace(dom, '\\.[^.]*$', '') END, '.')[-1]"
#: The nine rules on documents, which hold no links: ``o(doc_id, ord, feature_id, severity, available)``. Severity is 0 where not available.
OUTCOMES_SQL = rf"""{_framed_sql()}, {PAY_SQL},
em AS (SELECT doc_id, i, {_LABEL_SQL} AS label FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL_SQL}')) AS a, generate_subscripts(regexp_extract_all(text, '{_EMAIL_SQL}'), 1) AS i, lower(string_split(a, '@')[-1]) AS dom FROM documents)),
es AS (SELECT doc_id, count(*) AS n, bool_or(label NOT IN ('example')) AS formal, bool_or(label IN ('example')) AS free FROM em GROUP BY doc_id),
co AS (SELECT doc_id, unnest(regexp_extract_all(text, '{COMPANY}')) AS c FROM documents),
cb AS (SELECT doc_id, regexp_replace(c, '^\s*\S+\s+', '') AS b FROM co),
mm AS (SELECT em.doc_id, em.i, bool_or(contains(regexp_replace(lower(b), '[^a-z0-9]', '', 'g'), label) OR contains(label, regexp_replace(lower(b), '[^a-z0-9]', '', 'g')) OR label = lower(b[1]) OR (length(b) >= 4 AND contains(label, lower(b)))) AS fits
  FROM em JOIN cb ON cb.doc_id = em.doc_id WHERE label NOT IN ('example') GROUP BY ALL),
ms AS (SELECT doc_id, bool_or(NOT fits) AS stranger FROM mm GROUP BY doc_id),
q AS (SELECT doc_id, list_filter({sql_list(SETTINGS.no_experience)}, lambda p: contains(lower(text), p) AND NOT regexp_matches(substr(lower(text), greatest(strpos(lower(text), p) - 41, 0) + 1, least(strpos(lower(text), p) - 1, 40)), '\b(bukan|tidak|not|non)\s*$')) AS free,
  list_max(list_filter(list_transform(regexp_extract_all(lower(text), '\b(\d{{1,2}})\b'), lambda y: y::INTEGER), lambda y: y >= 2)) AS years FROM documents),
py AS (SELECT doc_id, min(amount) / 40.0::DOUBLE AS multiple FROM pay GROUP BY doc_id),
gs AS (SELECT doc_id, round(1 - product(CASE WHEN grp = 'payment' THEN 1 - weight ELSE 1 END), 4) AS payment, round(1 - product(CASE WHEN grp <> 'payment' THEN 1 - weight ELSE 1 END), 4) AS other FROM hits GROUP BY doc_id),
b AS (SELECT d.doc_id, regexp_matches(text, '{tx.REDACTION}') AS red, coalesce(es.n, 0) > 0 AS mail, coalesce(formal, false) AS formal, coalesce(es.free, false) AS free, coalesce(stranger, false) AS stranger, regexp_matches(text, '{PHONE}') AS phone, lower(text) AS low, q.free AS easy, years, multiple, payment, other,
  CASE WHEN NOT {_any_sql("lower(text)", SETTINGS.senior)} AND {_any_sql("lower(text)", SETTINGS.entry)} THEN 2.5::DOUBLE ELSE 6.0::DOUBLE END AS bound
  FROM documents d LEFT JOIN es ON es.doc_id = d.doc_id LEFT JOIN ms ON ms.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id LEFT JOIN py ON py.doc_id = d.doc_id LEFT JOIN gs ON gs.doc_id = d.doc_id),
w AS (SELECT doc_id, red, CASE WHEN free THEN 0.55::DOUBLE ELSE 0 END AS f0, CASE WHEN mail THEN 0.0::DOUBLE WHEN phone THEN 0.35 ELSE 0.55 END AS f1, CASE WHEN stranger THEN 0.6::DOUBLE ELSE 0 END AS f2,
  CASE WHEN formal OR NOT ({_any_sql("low", SETTINGS.telegram)} OR {_any_sql("low", SETTINGS.whatsapp)}) THEN 0.0::DOUBLE ELSE least(CASE WHEN {_any_sql("low", SETTINGS.telegram)} THEN 0.75::DOUBLE ELSE 0.35::DOUBLE END
    + (CASE WHEN {_any_sql("low", SETTINGS.chat_hiring)} THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {_any_sql("low", SETTINGS.anonymous)} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 1.0::DOUBLE) END AS f3,
  CASE WHEN len(easy) > 0 AND years IS NOT NULL THEN round(least(0.35::DOUBLE + 0.1::DOUBLE * (years - 2), 0.85::DOUBLE), 4) ELSE 0 END AS f4, 0.0::DOUBLE AS f5,
  CASE WHEN multiple >= bound THEN round(least(0.4::DOUBLE + 0.6::DOUBLE * (multiple - bound) / bound, 1.0::DOUBLE), 4) ELSE 0 END AS f6, coalesce(other, 0) AS f7, coalesce(payment, 0) AS f8 FROM b),
o AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{f}' AS feature_id, {f'CASE WHEN red THEN 0 ELSE f{i} END' if i in (0, 1, 2, 3, 5) else f'f{i}'}::DOUBLE AS severity, {'NOT red' if i in (0, 1, 2, 3, 5) else 'true'} AS available FROM w" for i, f in enumerate(fixed.FEATURES))})"""


#: What differs where word boundaries are Unicode's: salaries, years, negations and clauses.
_BOUNDARIES = (
    (PAY_SQL, EXACT_PAY_SQL), ("list_transform(regexp_extract_all(lower(text), '\\b(", f"list_transform(regexp_extract_all({_worded('lower(text)')}, '\\b("),
    ("NOT regexp_matches(substr(lower(text), greatest(", f"NOT regexp_matches(substr({_worded('lower(text)')}, greatest("), ("string_split_regex(substr(low, greatest(", f"string_split_regex(substr({_worded('low')}, greatest("),
)


def _exact(sql: str) -> str:
    """SQL on the rules' outcomes with Unicode's word boundaries, as the rules' patterns have them."""
    for ascii_only, whole in _BOUNDARIES:
        sql = sql.replace(ascii_only, whole)
    return sql


EXACT_OUTCOMES_SQL = _exact(OUTCOMES_SQL)


def _rule(name: str):
    """One rule's severities on all documents."""
    return lambda spark, d: _evaluated(spark, d).select("doc_id", F.col(f"{name}.severity").alias("severity"))


for _name, _feature in (
    ("r1_free_provider", "email_free_provider"), ("r2_email_absent", "email_absent"), ("r3_domain_mismatch", "email_domain_mismatch"), ("r4_messaging_only", "contact_messaging_only"), ("r6_qualification_conflict", "qualification_conflict"),
    ("r7_salary", "salary_implausible_vs_umk"), ("r8_payment", "payment_request_id"), ("r9_risk_phrases", "risk_phrase_score_id"),
):
    QUERIES[_name], SQL[_name] = _rule(_feature), f"WITH {EXACT_OUTCOMES_SQL if _name == 'r7_salary' else OUTCOMES_SQL} SELECT doc_id, severity FROM o WHERE feature_id = '{_feature}'"


@query(rf"""WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages) SELECT page_id, CASE WHEN host = 'blog.tionsh.example.net' THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END AS severity FROM h""")
def r5_url_shortener(spark, d):
    found = extract.extract_mentions(pages(spark, d).select("page_id", "url"), "url")
    return found.select("page_id", rules.url_shortener(SETTINGS).alias("o")).select("page_id", F.col("o.severity").alias("severity"))


#: Chat hosts among the pages' invented ones.
LINK_SETTINGS = replace(SETTINGS, telegram_hosts=("blog.ththan.example.net",), whatsapp_hosts=("blog.tiontion.example.com",))


def _in_sql(names: tuple[str, ...]) -> str:
    return f"list_has_any(hosts, {sql_list(names)})"


def _other_sql(names: tuple[str, ...]) -> str:
    return f"len(list_filter(hosts, lambda h: h NOT IN ({', '.join(repr(n) for n in names)}))) > 0"


_INFORMAL = LINK_SETTINGS.shorteners + LINK_SETTINGS.aggregators + LINK_SETTINGS.whatsapp_hosts + LINK_SETTINGS.telegram_hosts


@query(rf"""WITH t AS (SELECT a.page_id, concat_ws(' ', a.url, b.url, a.html) AS text, list_filter([{HOST_SQL.replace("(url)", "(a.url)")}, {HOST_SQL.replace("(url)", "(b.url)")}], lambda h: h IS NOT NULL) AS hosts, lower(text) AS low,
  regexp_matches(a.html, '{_EMAIL_SQL}') AS mail, regexp_matches(text, '{tx.REDACTION}') AS red FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id + 1),
c AS (SELECT *, {_in_sql(LINK_SETTINGS.telegram_hosts)} OR {_any_sql("low", LINK_SETTINGS.telegram)} AS telegram, {_in_sql(LINK_SETTINGS.whatsapp_hosts)} OR {_any_sql("low", LINK_SETTINGS.whatsapp)} AS whatsapp, {_other_sql(_INFORMAL)} AS formal FROM t)
SELECT page_id, CASE WHEN red OR mail OR {_other_sql(LINK_SETTINGS.shorteners)} THEN 0.0::DOUBLE ELSE 0.35::DOUBLE END AS absent,
CASE WHEN red OR formal OR NOT (telegram OR whatsapp) THEN 0.0::DOUBLE ELSE round(CASE WHEN telegram THEN 0.75::DOUBLE ELSE 0.35::DOUBLE END + CASE WHEN {_any_sql("low", LINK_SETTINGS.chat_hiring)} THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN {_any_sql("low", LINK_SETTINGS.anonymous)} THEN 0.1::DOUBLE ELSE 0 END, 6) END AS messaging,
CASE WHEN red OR NOT {_in_sql(LINK_SETTINGS.shorteners)} THEN 0.0::DOUBLE WHEN {_other_sql(LINK_SETTINGS.shorteners + LINK_SETTINGS.aggregators)} THEN 0.45::DOUBLE ELSE 0.65::DOUBLE END AS shortener FROM c""")
def r2_r4_r5_linked_pages(spark, d):
    """The rules on links, on texts that hold some: a page with its own address and that of the next page."""
    own = pages(spark, d).select("page_id", "url", "html")
    following = own.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    text = own.hint("merge").join(following.hint("merge"), "page_id", "left").select("page_id", F.concat_ws(" ", "url", "next_url", "html").alias("text"))
    found = extract.extract_mentions(text, "text").withColumn("low", F.lower("text"))
    severity = lambda o, name: r6(o(LINK_SETTINGS)["severity"]).alias(name)
    return found.select("page_id", severity(rules.email_absent, "absent"), severity(rules.contact_messaging_only, "messaging"), severity(rules.url_shortener, "shortener"))


@query(f"WITH {EXACT_PAY_SQL} SELECT doc_id, count(*)::INTEGER AS candidates, min(amount)::BIGINT AS lowest FROM pay GROUP BY doc_id")
def r7a_salary_candidates(spark, d):
    found = docs(spark, d).select("doc_id", F.lower("text").alias("low")).select("doc_id", rules.salaries(SETTINGS).alias("s")).where(F.size("s") > 0)
    return found.select("doc_id", F.size("s").alias("candidates"), F.array_min("s")["amount"].alias("lowest"))


@query(_lexicon_sql() + " SELECT doc_id, grp, round(1 - product(1 - weight), 6) AS score, count(*) AS n FROM h GROUP BY doc_id, grp")
def r8_phrase_group(spark, d):
    hits = phrases.match_phrases(docs(spark, d), "doc_id", "text", dims.lexicon(spark), framing=False)
    return phrases.group_scores(hits, "doc_id").select("doc_id", "grp", r6("score").alias("score"), "n")


@query(f"WITH {EXACT_OUTCOMES_SQL} SELECT doc_id, string_agg(CASE WHEN available THEN round(severity * 10000)::INTEGER::VARCHAR ELSE 'null' END, ',' ORDER BY ord) AS vector, string_agg(available::VARCHAR, ',' ORDER BY ord) AS mask FROM o GROUP BY doc_id")
def r11_rule_vector(spark, d):
    wide = _evaluated(spark, d)
    mask = F.array(*(F.col(f)["available"].cast("string") for f in fixed.FEATURES))
    return wide.select("doc_id", F.array_join(F.transform(rules.vector_of(), lambda x: F.round(x * 10000).cast("int").cast("string")), ",", "null").alias("vector"), F.array_join(mask, ",").alias("mask"))


_POINTS_SQL = "p(feature_id, points) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in fixed.PLACEHOLDER_POINTS.items()) + ")"
_WEIGHTS_SQL = "p(feature_id, weight) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in fixed.WEIGHTS.items()) + ")"


@query(f"""WITH {EXACT_OUTCOMES_SQL}, {_POINTS_SQL}, c AS (SELECT doc_id, ord, feature_id, severity, round(severity * points, 2) AS contribution FROM o JOIN p USING (feature_id) WHERE available AND severity > 0)
SELECT doc_id, feature_id, contribution, CASE WHEN severity >= 0.7::DOUBLE THEN 'high' WHEN severity >= 0.4::DOUBLE THEN 'med' ELSE 'low' END AS tier, row_number() OVER (PARTITION BY doc_id ORDER BY contribution DESC, severity DESC, ord)::INTEGER AS rank FROM c""")
def r12_rule_hits(spark, d):
    return rules.rule_hits(_evaluated(spark, d), "doc_id", advisory=False).select("doc_id", "feature_id", "contribution", "tier", "rank")


@query(f"WITH {EXACT_OUTCOMES_SQL}, {_WEIGHTS_SQL} SELECT doc_id, round(coalesce(sum(severity * weight), 0), 6) AS shift, count(feature_id) FILTER (severity > 0)::INTEGER AS n_fired FROM o JOIN p USING (feature_id) GROUP BY doc_id")
def c1_contributions(spark, d):
    return scoring.contribution(_evaluated(spark, d), "doc_id").select("doc_id", r6("shift").alias("shift"), F.size("contributions").alias("n_fired"))


@query("SELECT doc_id, round_even((1 - least(n_chars / 8000.0::DOUBLE, 1.0::DOUBLE)) * 100, 0)::INTEGER AS score FROM documents")
def c2_score(spark, d):
    p = F.least(F.col("n_chars") / F.lit(8000.0), F.lit(1.0))
    return docs(spark, d).select("doc_id", scoring.score(p, F.lit(0.3)).alias("score"))


@query("""WITH s AS (SELECT lang, round_even((1 - least(n_chars / 8000.0::DOUBLE, 1.0::DOUBLE)) * 100, 0) AS score FROM documents)
SELECT lang, CASE WHEN score < 40 THEN 'high_risk' WHEN score >= 70 THEN 'low_risk' ELSE 'medium_risk' END AS band, count(*) AS n FROM s GROUP BY ALL""")
def c4_label(spark, d):
    p = F.least(F.col("n_chars") / F.lit(8000.0), F.lit(1.0))
    return docs(spark, d).groupBy("lang", scoring.label(scoring.score(p, F.lit(0.0))).alias("band")).agg(F.count("*").alias("n"))


def length_scorer(text: Column) -> Column:
    return F.least(F.length(text) / F.lit(8000.0), F.lit(1.0))


#: A record per document, from the rules' outcomes: ``rec(doc_id, reject, shift, score, band, summary)``.
RECORD_SQL = f"""{EXACT_OUTCOMES_SQL}, {_WEIGHTS_SQL},
sh AS (SELECT doc_id, {" + ".join(["0.0::DOUBLE", *(f"sum(CASE WHEN ord = {i} THEN severity * weight ELSE 0 END)" for i in range(len(fixed.FEATURES)))])} AS shift, coalesce(string_agg(feature_id, '; ' ORDER BY ord) FILTER (severity > 0), '') AS names FROM o JOIN p USING (feature_id) GROUP BY doc_id),
rj AS (SELECT doc_id, CASE WHEN length(text) < 30 THEN 'too_short' WHEN length(text) > 20000 THEN 'too_long' WHEN length(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) < 20 THEN 'not_analysable' END AS reject, least(length(text) / 8000.0::DOUBLE, 1.0::DOUBLE) AS pm FROM documents),
sc AS (SELECT doc_id, reject, CASE WHEN reject IS NULL THEN shift END AS shift, names, CASE WHEN reject IS NULL THEN round_even((1 - least(greatest(pm + least(greatest(shift, 0.0::DOUBLE), 0.45::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)) * 100, 0)::INTEGER END AS score FROM rj JOIN sh USING (doc_id)),
bd AS (SELECT *, CASE WHEN score < 40 THEN 'high_risk' WHEN score >= 70 THEN 'low_risk' WHEN score IS NOT NULL THEN 'medium_risk' END AS band FROM sc),
rec AS (SELECT doc_id, reject, round(shift, 6) AS shift, score, band, CASE WHEN band IS NULL THEN NULL WHEN names = '' THEN 'Assessed as ' || band || '; no rule fired.' ELSE 'Assessed as ' || band || ': ' || names || '.' END AS summary FROM bd)"""


def _scored_rows(rows: DataFrame, spark: SparkSession) -> DataFrame:
    rows = rows.withColumn("minimum", F.lit(40).cast("bigint"))
    return scoring.score_documents(rows, "doc_id", "text", dims.lexicon(spark), length_scorer, SETTINGS, advisory=False, patterns=PATTERNS, minimum="minimum", margin=_th_margin, split=_lines)


def _scored(spark, d) -> DataFrame:
    return _scored_rows(docs(spark, d), spark)


def _records(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "reject", r6("shift").alias("shift"), "score", "band", "summary")


@query(f"WITH {RECORD_SQL} SELECT * FROM rec")
def c7_score_documents(spark, d):
    return _records(_scored(spark, d))


_IDIOT = r"(?i)\bidiot\b[^\n]*"


@query(f"""WITH m AS ({_spans_sql(_EMAIL_SQL).replace("WITH m AS", "WITH m1 AS").replace("FROM m WHERE", "FROM m1 WHERE").replace("SELECT doc_id, string_agg(s || ':' || (s + n), ',' ORDER BY i) AS spans FROM y GROUP BY doc_id", "SELECT doc_id, 0 AS kind, i, s, s + n AS e FROM y")}),
k AS ({_spans_sql(_IDIOT).replace("SELECT doc_id, string_agg(s || ':' || (s + n), ',' ORDER BY i) AS spans FROM y GROUP BY doc_id", "SELECT doc_id, 1 AS kind, i, s, s + n AS e FROM y")}),
f AS (SELECT * FROM m UNION ALL SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = k.doc_id AND m.s < k.e AND k.s < m.e))
SELECT doc_id, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM f GROUP BY doc_id""")
def c8_highlight(spark, d):
    raw = F.coalesce("text", F.lit(""))
    spans = scoring.highlight(extract.emails(raw), sp.find_spans(raw, _IDIOT, F.contains(F.lower(raw), F.lit("idiot"))))
    return docs(spark, d).select("doc_id", spans.alias("s")).where(F.size("s") > 0).select("doc_id", sp.spelled(F.col("s")).alias("spans"))


def _lines(text: Column) -> Column:
    """Sentences that end at new lines only."""
    return sp.find_spans(text, r"[^\n]+")


def _th_margin(t: Column) -> Column:
    return (F.length(t) - F.length(F.replace(t, F.lit("th"), F.lit("")))) * F.lit(0.25)


@query(r"""WITH m AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ps FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, ps, length(text) - length(replace(text, 'th', '')) AS base FROM m WHERE len(ps) >= 2),
z AS (SELECT doc_id, i, ps[i] AS s, length(ps[i]) >= 12 AS ok, sum(CASE WHEN length(ps[i]) >= 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM x),
w AS (SELECT doc_id, i - 1 AS sent_no, CASE WHEN nth <= 12 THEN (length(s) - length(replace(s, 'th', ''))) * 0.25::DOUBLE ELSE 0.0::DOUBLE END AS delta FROM z WHERE ok)
SELECT doc_id, sent_no::INTEGER AS sent_no, round(delta, 4) AS delta, CASE WHEN delta > 0 THEN 'risk' ELSE 'safe' END AS polarity FROM w
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY abs(delta) DESC, sent_no) <= 5""")
def e1_occlusion(spark, d):
    return explain.occlusion(docs(spark, d), "doc_id", "text", _th_margin, split=_lines).select("doc_id", "sent_no", "delta", "polarity")


@query(SQL["e1_occlusion"])
def e1_occlusion_rows(spark, d):
    """The same with the variants as rows, the way that a Python scorer gets them."""
    return explain.occlusion(docs(spark, d), "doc_id", "text", _th_margin, split=_lines, native=False).select("doc_id", "sent_no", "delta", "polarity")


#: ``e1_occlusion`` with all sentences scored.
_EVERY_SENTENCE_SQL = SQL["e1_occlusion"].replace("CASE WHEN nth <= 12 THEN (length(s) - length(replace(s, 'th', ''))) * 0.25::DOUBLE ELSE 0.0::DOUBLE END AS delta", "(length(s) - length(replace(s, 'th', ''))) * 0.25::DOUBLE AS delta")


@query(f"""WITH {EXACT_OUTCOMES_SQL}, {_POINTS_SQL}, rj AS (SELECT doc_id, length(text) BETWEEN 30 AND 20000 AND length(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) >= 20 AS ok FROM documents),
hc AS (SELECT doc_id, ord, feature_id, severity, round(severity * points, 2) AS contribution FROM o JOIN p USING (feature_id) WHERE available AND severity > 0),
hs AS (SELECT doc_id, string_agg(feature_id || ':' || CASE WHEN severity >= 0.7::DOUBLE THEN 'high' WHEN severity >= 0.4::DOUBLE THEN 'med' ELSE 'low' END, ',' ORDER BY contribution DESC, severity DESC, ord) AS hits FROM hc GROUP BY doc_id),
un AS (SELECT doc_id, string_agg(feature_id, ',' ORDER BY ord) FILTER (NOT available) AS unassessed FROM o GROUP BY doc_id),
ev AS (SELECT doc_id, string_agg(sent_no || ':' || round(delta * 100)::INTEGER, ',' ORDER BY abs(delta) DESC, sent_no) AS evidence FROM ({_EVERY_SENTENCE_SQL}) GROUP BY doc_id)
SELECT rj.doc_id, CASE WHEN ok THEN coalesce(hits, '') END AS hits, CASE WHEN ok THEN coalesce(unassessed, '') END AS unassessed, CASE WHEN ok THEN coalesce(evidence, '') ELSE '' END AS evidence
FROM rj LEFT JOIN hs USING (doc_id) LEFT JOIN un USING (doc_id) LEFT JOIN ev USING (doc_id)""")
def c7_record(spark, d):
    """What each record rests on: rules that fired, rules that couldn't be judged, sentences by effect."""
    rows = _scored(spark, d)
    hits = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["feature_id"], h["tier"])), ",")
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["sent_no"], F.round(e["delta"] * 100).cast("int"))), ",")
    return rows.select("doc_id", hits.alias("hits"), F.array_join("unassessed", ",").alias("unassessed"), evidence.alias("evidence"))


# --- corpus -----------------------------------------------------------------------------------------------------


@query("""SELECT count(*) AS n_rows, count_if(quality + toxic = 1)::BIGINT AS n_positive, count_if(quality + toxic NOT IN (0, 1))::BIGINT AS n_bad_label,
array_to_string(list_filter(['unknown columns: toxic', CASE WHEN count_if(quality + toxic NOT IN (0, 1)) > 0 THEN 'label outside 0 and 1' END, CASE WHEN count(*) <> 17880 THEN 'row count' END], lambda x: x IS NOT NULL), ';') AS problems FROM labels""")
def p1_validate(spark, d):
    rows = read(spark, d, "labels").withColumn("y", F.col("quality") + F.col("toxic")).select("doc_id", "y", "toxic")
    out = corpus.validate_source(rows, ["doc_id", "y"], "y", rows=17_880)
    return out.select("n_rows", F.col("n_positive").cast("bigint").alias("n_positive"), "n_bad_label", F.array_join("problems", ";").alias("problems"))


@query(r"""WITH c AS (SELECT doc_id, quality, concat_ws(chr(10), nullif(trim(lang), ''), nullif(trim(regexp_replace(source, '([a-z])([0-9])', '\1 \2', 'g')), '')) AS text FROM documents JOIN labels USING (doc_id)),
w AS (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::INTEGER AS n_words FROM c) SELECT doc_id, text, quality::INTEGER AS quality, n_words, n_words >= 3 AS kept FROM w""")
def p2_model_frame(spark, d):
    rows = docs(spark, d).join(read(spark, d, "labels"), "doc_id")
    kept, short = corpus.model_frame(rows, "doc_id", ["lang", "source"], "quality", {"toxic", "n_chars"}, min_words=3)
    return kept.withColumn("kept", F.lit(True)).unionByName(short.withColumn("kept", F.lit(False)))


SPLIT_SQL = """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) AS rank, count(*) OVER (PARTITION BY quality) AS n FROM labels),
s AS (SELECT doc_id, quality, CASE WHEN rank <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN rank <= round_even(n * 0.8::DOUBLE, 0) THEN 'val' WHEN rank <= round_even(n * 0.9::DOUBLE, 0) THEN 'calib' ELSE 'test' END AS split FROM r)"""


def _split(spark, d) -> DataFrame:
    return corpus.stratified_split(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query(SPLIT_SQL + " SELECT doc_id, split FROM s")
def p3_stratified_split(spark, d):
    return _split(spark, d).select("doc_id", "split")


@query(SPLIT_SQL + """, t AS (SELECT * FROM s UNION ALL SELECT doc_id, quality, 'test' FROM s WHERE doc_id % 50 = 0)
SELECT split, count(*) AS n, round(avg(quality::DOUBLE), 6) AS rate, (SELECT count(*) FROM (SELECT doc_id FROM t GROUP BY doc_id HAVING count(DISTINCT split) > 1)) AS overlap,
abs(avg(quality::DOUBLE) - (SELECT avg(quality::DOUBLE) FROM t)) > 0.005::DOUBLE AS off FROM t GROUP BY split""")
def p4_split_sound(spark, d):
    """Splits with a flaw on purpose: some rows are in the test split besides."""
    split = _split(spark, d)
    flawed = split.unionByName(split.where("doc_id % 50 = 0").withColumn("split", F.lit("test")))
    return corpus.split_soundness(flawed, "doc_id", "quality").select("split", "n", r6("rate").alias("rate"), "overlap", "off")


@query(SPLIT_SQL + " SELECT split, count(*) AS n, substr(sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)), 1, 16) AS checksum FROM s GROUP BY split")
def p5_checksum(spark, d):
    return corpus.split_checksum(_split(spark, d), "doc_id")


@query(SPLIT_SQL + " SELECT split, count(*) AS n, bit_xor(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT) AS fingerprint FROM s GROUP BY split")
def p5_fingerprint(spark, d):
    return corpus.split_fingerprint(_split(spark, d), "doc_id")


@query(LABELLED + r""", w AS (SELECT y, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n_words FROM l)
SELECT count(*) AS n, round(avg(y::DOUBLE), 6) AS rate, floor(quantile_cont(n_words, 0.5))::BIGINT AS p50_words, floor(quantile_cont(n_words, 0.95))::BIGINT AS p95_words,
floor(quantile_cont(n_words, 0.5) * 1.35::DOUBLE)::BIGINT AS p50_tokens, round((1 - avg(y::DOUBLE)) / avg(y::DOUBLE), 6) AS pos_weight FROM w""")
def p6_prep_report(spark, d):
    rows = labelled(spark, d).select("y", tx.word_count(F.col("text")).alias("n_words"))
    return corpus.prep_report(rows, "y", "n_words").select("n", r6("rate").alias("rate"), "p50_words", "p95_words", "p50_tokens", r6("pos_weight").alias("pos_weight"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def p7_sample(spark, d):
    return corpus.sample_rows(docs(spark, d).select("doc_id"), "doc_id", 100)


@query(rf"SELECT count(*) AS n, round(avg(regexp_matches(text, '{_EMAIL_SQL}')::INTEGER::DOUBLE), 6) AS with_email, round(avg(regexp_matches(text, '{tx.REDACTION}')::INTEGER::DOUBLE), 6) AS with_redaction FROM documents")
def p8_contact_rates(spark, d):
    return extract.contact_rates(docs(spark, d), "text").select("n", r6("with_email").alias("with_email"), r6("with_redaction").alias("with_redaction"))


# --- features and models ----------------------------------------------------------------------------------------

TERMS = rf"""WITH ws AS (SELECT doc_id, regexp_extract_all(translate(lower(text), '{features._FROM}', '{features._TO}'), '[\pL\pN\pM_]{{2,}}') AS w FROM documents),
t AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM ws),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
v AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM c GROUP BY term HAVING count(*) >= 3 ORDER BY cf DESC, term LIMIT {features.MAX_TERMS})"""


@query(TERMS + " SELECT doc_id, term, tf FROM c")
def f1_term_counts(spark, d):
    return features.term_counts(docs(spark, d), "doc_id", "text").select("doc_id", "term", "tf")


@query(TERMS + " SELECT term, df, cf FROM v")
def f2_vocabulary(spark, d):
    return features.vocabulary(docs(spark, d), "text", "doc_id")


@query(TERMS + """, w AS (SELECT doc_id, term, (1 + ln(tf::DOUBLE)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN v USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def f3_tfidf(spark, d):
    return features.tfidf(docs(spark, d), "doc_id", "text").select("doc_id", "term", r6("weight").alias("weight"))


@query(SQL["f3_tfidf"])
def f4_term_weights(spark, d):
    """What the fits are given: the weights of ``f3_tfidf``, by the fitted model's own state."""
    model = features.TermWeights("text").fit(docs(spark, d))
    rows = features.named_weights(model, model.transform(docs(spark, d)), "doc_id")
    return rows.select("doc_id", "term", r6("weight").alias("weight"))


@query("WITH p AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality) SELECT label, n, round((SELECT sum(n) FROM p) / (2 * n)::DOUBLE, 6) AS balanced FROM p")
def f9_class_weights(spark, d):
    return corpus.class_weights(read(spark, d, "labels"), "quality").select("label", "n", r6("balanced").alias("balanced"))


@query(LABELLED + f", x AS (SELECT y, unnest(list_filter({sql_list(AUDIT)}, lambda t: contains(lower(text), t))) AS term FROM l) SELECT term, count(*) AS docs, round(avg(y::DOUBLE), 6) AS rate FROM x GROUP BY term")
def f11_term_audit(spark, d):
    y = read(spark, d, "labels").select("doc_id", (1 - F.col("quality")).alias("y"))
    return features.term_audit(docs(spark, d), "doc_id", "text", y, "y", AUDIT).select("term", "docs", r6("rate").alias("rate"))


def _model_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = labelled(spark, d).select("doc_id", "text", F.col("y").cast("int").alias("y"))
    # Written: a fit reads its rows several times, and each time they would be joined and ranked anew.
    rows = written(corpus.stratified_split(rows, "doc_id", "y").select("text", "y", "split"), "split")
    return rows.where("split <> 'test'").drop("split"), rows.where("split = 'test'").drop("split")


def _fitted(name: str):
    """One baseline at its production size, fitted on all but the test split and measured there."""

    def run(spark, d):
        train, test = _model_rows(spark, d)
        return models.compare({name: models.FITS[name](train, "text", "y")}, test, "y")

    return run


for _name, _model in (("f4_logistic", "logistic"), ("f5_svm", "svm"), ("f6_boosting", "boosting"), ("f7_oversampled_logistic", "oversampled")):
    QUERIES[_name] = _fitted(_model)


@query()
def f10_comparison(spark, d):
    """The four baselines at their production size side by side, with the best and the gate."""
    train, test = _model_rows(spark, d)
    return models.compare(models.fit_baselines(train, "text", "y"), test, "y")


@query()
def f7_oversample(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("label") == 0, 1).otherwise(0).alias("y"))
    return models.oversample(rows, "vec_id", "embedding", "y").select("vec_id", "y", F.size("embedding").alias("dims"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b)::INTEGER AS rank FROM d QUALIFY rank <= 5""")
def f7_nearest(spark, d):
    """Neighbours inside each class, for all classes."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("a"), F.sequence(F.lit(0), F.size("embedding") - 1).alias("i"), F.col("embedding").cast("array<double>").alias("v"), "label")
    return models.nearest(rows, within="label").select("a", "b", "rank")


@query(TERMS + """, w AS (SELECT doc_id, term, (1 + ln(tf::DOUBLE)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN v USING (term)),
x AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)),
k AS (SELECT doc_id, coalesce(sum(w * w), 0) AS s FROM documents JOIN (SELECT doc_id FROM labels WHERE quality = 0) USING (doc_id) LEFT JOIN x USING (doc_id) GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.w * y.w) AS dot FROM x JOIN x AS y USING (term) GROUP BY ALL),
d AS (SELECT k.doc_id AS a, o.doc_id AS b, round(greatest(k.s + o.s - 2 * coalesce(dot, 0), 0), 9) AS d FROM k JOIN k AS o ON k.doc_id <> o.doc_id LEFT JOIN p ON p.a = k.doc_id AND p.b = o.doc_id)
SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b)::INTEGER AS rank FROM d QUALIFY rank <= 5""")
def f7_text_neighbours(spark, d):
    """Neighbours of poor documents among themselves by the weights of ``f3_tfidf``."""
    poor = docs(spark, d).hint("merge").join(read(spark, d, "labels").where("quality = 0").select("doc_id").hint("merge"), "doc_id")
    weights = features.TermWeights("text").fit(docs(spark, d)).transform(poor)
    rows = written(weights.select(F.col("doc_id").alias("a"), F.col("_i").alias("i"), F.col("_v").alias("v")), "poor")
    return models.nearest(rows).select("a", "b", "rank")


# --- metrics and calibration ------------------------------------------------------------------------------------


def _curve(spark, d) -> DataFrame:
    return metrics.curve(labelled(spark, d), "p", "y")


#: A Platt fit by plain Newton steps: ``ab(a, b)`` for the margins ``m(p, y, m)``. Fits in SQL and in Spark meet at the optimum only.
PLATT_SQL = LABELLED.replace("WITH", "WITH RECURSIVE", 1) + """, m AS (SELECT p, y, ln(greatest(least(p, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) / (1 - greatest(least(p, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE))) AS m FROM l),
z AS (SELECT avg(m) AS mean, stddev_pop(m) AS spread, avg(y::DOUBLE) AS rate FROM m), s AS (SELECT (m - mean) / spread AS x, y FROM m, z),
newton(i, a, b) AS (SELECT 0, 0.0::DOUBLE, ln(rate / (1 - rate)) FROM z UNION ALL
  SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT i, a, b, sum((q - y) * x) AS ga, sum(q - y) AS gb, sum(q * (1 - q) * x * x) AS haa, sum(q * (1 - q) * x) AS hab, sum(q * (1 - q)) AS hbb
    FROM (SELECT i, a, b, x, y, 1 / (1 + exp(-(a * x + b))) AS q FROM newton, s WHERE i < 20) GROUP BY ALL)),
ab AS (SELECT a / spread AS a, b - a * mean / spread AS b FROM newton, z WHERE i = 20)"""


@query(PLATT_SQL + " SELECT round(a, 4) AS a, round(b, 4) AS b, round(avg(-ln(CASE WHEN y = 1 THEN 1 / (1 + exp(-(a * m + b))) ELSE 1 - 1 / (1 + exp(-(a * m + b))) END)), 6) AS loss FROM ab, m GROUP BY ab.a, ab.b")
def k1_platt(spark, d):
    """The fitted curve, and the mean loss of its probabilities."""
    rows = labelled(spark, d).select(metrics.to_margin(F.col("p")).alias("m"), "y")
    a, b = metrics.platt_fit(rows, "m", "y")
    p = metrics.platt_apply(F.col("m"), a, b)
    return rows.agg(F.round(F.lit(a), 4).alias("a"), F.round(F.lit(b), 4).alias("b"), r6(F.avg(-F.ln(F.when(F.col("y") == 1, p).otherwise(1 - p)))).alias("loss"))


@query(LABELLED + " SELECT doc_id, round(1 / (1 + exp(-(0.5::DOUBLE * ln(greatest(least(p, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) / (1 - greatest(least(p, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE))) - 1))), 6) AS p FROM l")
def k2_platt_apply(spark, d):
    return labelled(spark, d).select("doc_id", r6(metrics.platt_apply(metrics.to_margin(F.col("p")), 0.5, -1.0)).alias("p"))


@query(LABELLED + " SELECT round(avg(pow(p - y, 2)), 6) AS brier FROM l")
def k4_brier(spark, d):
    return labelled(spark, d).agg(r6(metrics.brier(F.col("p"), F.col("y"))).alias("brier"))


@query(LABELLED + """, b AS (SELECT i AS bin, i / 10.0::DOUBLE AS lo, (i + 1) / 10.0::DOUBLE AS hi FROM range(10) t(i))
SELECT bin::INTEGER AS bin, count(p) AS "count", round(avg(p), 6) AS mean_p, round(avg(y::DOUBLE), 6) AS rate FROM b LEFT JOIN l ON (p > lo OR (bin = 0 AND p = 0)) AND p <= hi GROUP BY bin""")
def k5_ece_bins(spark, d):
    return metrics.calibration_bins(labelled(spark, d), "p", "y").select("bin", "count", r6("mean_p").alias("mean_p"), r6("rate").alias("rate"))


@query(CURVE + " SELECT round(min(CASE WHEN prec >= 0.2 THEN threshold END), 6) AS threshold FROM k")
def k7_thr_precision(spark, d):
    return metrics.threshold_for_precision(_curve(spark, d), 0.2).select(r6("threshold").alias("threshold"))


@query(CURVE + " SELECT round(max(CASE WHEN rec >= 0.95 THEN threshold END), 6) AS threshold FROM k")
def k8_thr_recall(spark, d):
    return metrics.threshold_for_recall(_curve(spark, d)).select(r6("threshold").alias("threshold"))


@query(CURVE + ", b AS (SELECT min(CASE WHEN prec >= 0.16 THEN threshold END) AS h, max(CASE WHEN rec >= 0.95 THEN threshold END) AS w FROM k) SELECT round_even((1 - h) * 100, 0)::INTEGER AS high_below, round_even((1 - w) * 100, 0)::INTEGER AS low_from FROM b")
def k9_fit_bands(spark, d):
    return metrics.fit_bands(_curve(spark, d), 0.16, 0.95).select("high_below", "low_from")


@query(LABELLED + ", x AS (SELECT CASE WHEN p >= 0.6 THEN 'high_risk' WHEN p < 0.2 THEN 'low_risk' ELSE 'medium_risk' END AS band, y FROM l) SELECT n.band, count(y) AS n, coalesce(sum(y), 0)::BIGINT AS positives FROM (VALUES ('high_risk'), ('medium_risk'), ('low_risk')) n(band) LEFT JOIN x USING (band) GROUP BY n.band")
def k11_bands(spark, d):
    return metrics.bands(labelled(spark, d), "p", "y", 0.6, 0.2)


@query(CURVE + " SELECT round(threshold, 6) AS threshold, tp::BIGINT AS tp, flagged::BIGINT AS flagged, round(prec, 6) AS prec, round(rec, 6) AS rec FROM k")
def m1_pr_curve(spark, d):
    return _curve(spark, d).select(r6("threshold").alias("threshold"), "tp", "flagged", r6("precision").alias("prec"), r6("recall").alias("rec"))


RANKING = CURVE + """, f AS (SELECT *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) AS f1, total - total_pos AS tn, (flagged - n) - (tp - pos) AS above FROM k)
SELECT round(sum(pos * prec) / max(total_pos), 6) AS average_precision, round(sum(pos * (tn - above - (n - pos) / 2.0::DOUBLE)) / (max(total_pos) * max(tn)), 6) AS roc_auc,
round(max(f1), 6) AS best_f1, round(arg_max(threshold, (f1, -threshold)), 6) AS best_threshold FROM f"""


@query(RANKING)
def m2_m3_m4_ranking(spark, d):
    out = metrics.ranking(_curve(spark, d))
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query(LABELLED + """ SELECT count_if(p >= 0.5 AND y = 1)::BIGINT AS tp, count_if(p >= 0.5 AND y = 0)::BIGINT AS fp, count_if(p < 0.5 AND y = 1)::BIGINT AS fn, count_if(p < 0.5 AND y = 0)::BIGINT AS tn,
round(avg((CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END)::DOUBLE), 6) AS accuracy, round(greatest(avg(y::DOUBLE), 1 - avg(y::DOUBLE)), 6) AS majority FROM l""")
def m5_confusion(spark, d):
    return metrics.confusion(labelled(spark, d), F.col("p"), F.col("y"), 0.5).select("tp", "fp", "fn", "tn", r6("accuracy").alias("accuracy"), r6("majority").alias("majority"))


@query(LABELLED + """, m AS (SELECT 'length' AS model, p AS score, y FROM l UNION ALL SELECT 'constant', 0.5::DOUBLE, y FROM l),
t AS (SELECT model, score, sum(y) AS pos, count(*) AS n FROM m GROUP BY ALL), c AS (SELECT model, pos, sum(pos) OVER w / sum(n) OVER w AS prec, sum(pos) OVER (PARTITION BY model) AS tot FROM t WINDOW w AS (PARTITION BY model ORDER BY score DESC))
SELECT model, round(sum(pos * prec) / max(tot), 6) AS average_precision FROM c GROUP BY model""")
def m6_m9_ablation(spark, d):
    rows = labelled(spark, d).select("y", F.col("p").alias("length"), F.lit(0.5).alias("constant"))
    return metrics.ablation(rows, "y", ["length", "constant"]).select("model", r6("average_precision").alias("average_precision"))


@query(LABELLED + """, e AS (SELECT CASE WHEN p >= 0.5 AND y = 0 THEN 'fp' WHEN p < 0.5 AND y = 1 THEN 'fn' END AS kind, doc_id, p FROM l)
SELECT kind, doc_id, round(p, 6) AS p FROM e WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'fp' THEN -p ELSE p END, doc_id) <= 10""")
def m7_top_errors(spark, d):
    return metrics.top_errors(labelled(spark, d), "doc_id", "p", "y", 0.5).select("kind", "doc_id", r6("p").alias("p"))


@query('SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY event_type')
def m8_percentiles(spark, d):
    return metrics.percentiles(read(spark, d, "events"), "value", ["event_type"]).select("event_type", *(r6(c).alias(c) for c in ("p50", "p95", "p99", "mean")))


@query(f"""WITH {OUTCOMES_SQL} SELECT feature_id, count_if(severity > 0)::BIGINT AS fired, coalesce(sum(CASE WHEN severity > 0 THEN 1 - quality END), 0)::BIGINT AS fired_pos,
round(sum(CASE WHEN severity > 0 THEN 1 - quality END) / nullif(count_if(severity > 0), 0)::DOUBLE, 6) AS precision FROM o JOIN labels USING (doc_id) GROUP BY feature_id""")
def m11_rule_behaviour(spark, d):
    y = read(spark, d, "labels").select("doc_id", (1 - F.col("quality")).alias("y"))
    return metrics.rule_behaviour(rules.outcomes(_evaluated(spark, d), "doc_id"), y, "doc_id", "y").select("feature_id", "fired", "fired_pos", r6("precision").alias("precision"))


@query(f"""WITH {OUTCOMES_SQL}, {_WEIGHTS_SQL}, c AS (SELECT doc_id, count_if(severity > 0) AS n_fired, sum(severity * weight) AS shift FROM o JOIN p USING (feature_id) GROUP BY doc_id)
SELECT (1 - quality)::BIGINT AS y, count(*) AS n, round(avg(n_fired::DOUBLE), 6) AS mean_fired, count_if(n_fired > 0)::BIGINT AS any_fired, round(avg(shift), 6) AS mean_shift FROM c JOIN labels USING (doc_id) GROUP BY 1""")
def m11_class_behaviour(spark, d):
    y = read(spark, d, "labels").select("doc_id", (1 - F.col("quality")).cast("bigint").alias("y"))
    rows = scoring.contribution(_evaluated(spark, d), "doc_id").select("doc_id", F.size("contributions").alias("n_fired"), "shift")
    return metrics.class_behaviour(rows, y, "doc_id", "y").select("y", "n", r6("mean_fired").alias("mean_fired"), "any_fired", r6("mean_shift").alias("mean_shift"))


@query(f"""WITH {OUTCOMES_SQL}, g AS (SELECT feature_id, avg((severity > 0)::INTEGER::DOUBLE) AS fire_rate, abs(coalesce(avg(CASE WHEN quality = 0 THEN available::INTEGER::DOUBLE END) - avg(CASE WHEN quality = 1 THEN available::INTEGER::DOUBLE END), 0)) AS gap FROM o JOIN labels USING (doc_id) GROUP BY feature_id)
SELECT feature_id, round(fire_rate, 6) AS fire_rate, CASE WHEN fire_rate < 0.05 THEN 'absent' WHEN fire_rate > 0.95 THEN 'constant' WHEN gap > 0.03 THEN 'unsafe' ELSE 'derivable' END AS verdict FROM g""")
def m13_learnability(spark, d):
    y = read(spark, d, "labels").select("doc_id", (1 - F.col("quality")).alias("y"))
    return metrics.learnability(rules.outcomes(_evaluated(spark, d), "doc_id"), y, "doc_id", "y").select("feature_id", r6("fire_rate").alias("fire_rate"), "verdict")


@query(LABELLED + """ SELECT 0.5::DOUBLE AS threshold, count_if(p >= 0.5 AND y = 1)::BIGINT AS tp, count_if(p >= 0.5 AND y = 0)::BIGINT AS fp, count_if(p < 0.5 AND y = 1)::BIGINT AS fn, count_if(p < 0.5 AND y = 0)::BIGINT AS tn,
round(count_if(p >= 0.5 AND y = 1) / greatest(count_if(p >= 0.5), 1)::DOUBLE, 4) AS precision, round(count_if(p >= 0.5 AND y = 1) / greatest(count_if(y = 1), 1)::DOUBLE, 4) AS recall FROM l""")
def k10_stats_at(spark, d):
    return metrics.stats_at(labelled(spark, d), F.col("p"), F.col("y"), 0.5)


@query(PLATT_SQL + """, f AS (SELECT 'given' AS fit, 1 / (1 + exp(-(0.5::DOUBLE * m - 1))) AS p FROM m UNION ALL SELECT 'refit', 1 / (1 + exp(-(a * m + b))) FROM m, ab)
SELECT fit, round(avg(p), 6) AS mean_p, round(min(p), 5) AS min_p, round(max(p), 5) AS max_p FROM f GROUP BY fit""")
def k12_recalibrated(spark, d):
    rows = labelled(spark, d).select(metrics.to_margin(F.col("p")).alias("m"), "y")
    return metrics.recalibrated(rows, "m", "y", 0.5, -1.0).select("fit", r6("mean_p").alias("mean_p"), F.round("min_p", 5).alias("min_p"), F.round("max_p", 5).alias("max_p"))


@query(SPLIT_SQL + """, c AS (SELECT split, substr(sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)), 1, 16) AS checksum FROM s GROUP BY split),
e AS (SELECT checksum FROM c WHERE split = 'val' UNION ALL SELECT substr(sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)), 1, 16) FROM s WHERE split = 'test' AND doc_id <> (SELECT min(doc_id) FROM s WHERE split = 'test'))
SELECT split, checksum IN (SELECT checksum FROM e) AS refused FROM c""")
def m14_evaluated_once(spark, d):
    """A ledger knows the validation split, and a test split that lacks one row: only the first is refused."""
    split = _split(spark, d)
    first = split.where("split = 'test'").agg(F.min("doc_id").alias("first"))
    lacking = split.where("split = 'test'").join(F.broadcast(first), F.col("doc_id") != F.col("first"))  # one row
    sums = corpus.split_checksum(split, "doc_id")
    ledger = sums.where("split = 'val'").unionByName(corpus.split_checksum(lacking.drop("first"), "doc_id"))
    return metrics.refused(sums, ledger.select(F.col("checksum").alias("split_checksum")))


# --- evaluation data and appeals --------------------------------------------------------------------------------


@query(f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 30 THEN 'text too short' END, CASE WHEN source NOT IN ('src0', 'src1', 'src2', 'src3') THEN 'unknown source' END], lambda x: x IS NOT NULL), ';') AS problems FROM documents""")
def v1_row_problems(spark, d):
    found = evalset.row_problems(F.col("doc_id"), F.col("text"), F.lit(1), F.col("source"), F.col("lang"), SOURCES)
    return docs(spark, d).select("doc_id", F.array_join(found, ";").alias("problems"))


@query("""WITH k AS (SELECT event_id, list_sort(list_filter(json_keys(props), lambda k: k NOT IN ('page'))) AS unknown FROM events) SELECT event_id, array_to_string(unknown, ',') AS unknown FROM k WHERE len(unknown) > 0""")
def v2_unknown_fields(spark, d):
    found = read(spark, d, "events").select("event_id", evalset.unknown_fields(F.col("props"), ["page"]).alias("unknown")).where(F.size("unknown") > 0)
    return found.select("event_id", F.array_join("unknown", ",").alias("unknown"))


@query("SELECT 'id-' || lpad((row_number() OVER (ORDER BY source, lang) + (SELECT max(doc_id) FROM documents))::VARCHAR, 4, '0') AS id, source FROM (SELECT DISTINCT source, lang FROM documents)")
def v9_next_ids(spark, d):
    new = docs(spark, d).select("source", F.concat_ws(",", "source", "lang").alias("k")).distinct()
    old = docs(spark, d).select(F.concat(F.lit("id-"), F.col("doc_id").cast("string")).alias("id"))
    return evalset.next_ids(new, "k", old, "id", "id-").select("id", "source")


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1")
def v3_repeated_ids(spark, d):
    return evalset.repeated_ids(read(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn")


@query(r"WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS first_id FROM documents) SELECT doc_id, first_id FROM k WHERE doc_id > first_id")
def v4_duplicate_text(spark, d):
    return evalset.duplicate_texts(docs(spark, d), "doc_id", "text")


@query("""WITH a AS (SELECT count(*) AS n, avg((quality = toxic)::INTEGER::DOUBLE) AS o, avg((quality = 1)::INTEGER::DOUBLE) AS x, avg((toxic = 1)::INTEGER::DOUBLE) AS y FROM labels)
SELECT n, round(o, 6) AS agreement, round((o - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))), 6) AS kappa FROM a""")
def v6_kappa(spark, d):
    return evalset.cohens_kappa(read(spark, d, "labels"), "quality", "toxic").select("n", r6("agreement").alias("agreement"), r6("kappa").alias("kappa"))


@query("SELECT 'source' AS field, source AS value, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang")
def v7_histograms(spark, d):
    return evalset.histograms(docs(spark, d), ["source", "lang"])


@query("SELECT coalesce(event_type, 'unknown') AS correction, count(*) AS n, count_if(value > 50)::BIGINT AS unreviewed FROM events GROUP BY ALL")
def a2_review_queue(spark, d):
    return evalset.review_queue(read(spark, d, "events"), "event_type", F.col("value") <= 50)


@query("SELECT count(*) AS n, coalesce(bool_or(contains(text, '###')), false) AS blocked FROM documents")
def v5_taint(spark, d):
    rows = docs(spark, d).withColumn("synthetic", F.contains("text", F.lit("###")))
    return evalset.taint(rows, "synthetic").crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).select("n", "blocked")


@query("""WITH a AS (SELECT count(*) AS n, avg(quality::DOUBLE) AS rate FROM labels)
SELECT n, round(rate, 6) AS rate, array_to_string(list_filter([CASE WHEN n < 100000000 THEN 'too few items' END, CASE WHEN abs(rate - 0.5) > 0.15 THEN 'unbalanced' END], lambda x: x IS NOT NULL), ';') AS advice FROM a""")
def v8_advice(spark, d):
    return evalset.advice(read(spark, d, "labels"), "quality", 100_000_000, 0.5).select("n", r6("rate").alias("rate"), F.array_join("advice", ";").alias("advice"))


_ITEMS_SQL = "i AS (SELECT documents.doc_id, text, source, lang, quality, toxic, contains(text, '###') AS synthetic FROM documents LEFT JOIN labels USING (doc_id))"


def _items(spark, d) -> DataFrame:
    y = read(spark, d, "labels").select("doc_id", "quality", "toxic")
    rows = docs(spark, d).hint("merge").join(y.hint("merge"), "doc_id", "left")
    return rows.select("doc_id", "text", "source", "lang", "quality", "toxic", F.contains("text", F.lit("###")).alias("synthetic"))


@query(rf"""WITH {_ITEMS_SQL}, u AS (SELECT doc_id, min(text) AS text FROM i GROUP BY doc_id),
k AS (SELECT doc_id, lower(trim(regexp_replace(text, '[\s\x{{85}}\x{{a0}}\p{{Z}}]+', ' ', 'g'))) AS key FROM u), m AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key), n AS (SELECT count(*) AS n, count_if(quality = 1)::BIGINT AS positive FROM i),
p AS (SELECT 'error' AS level, 'missing required field quality' AS problem, doc_id::VARCHAR AS item, 1::BIGINT AS n FROM i WHERE quality IS NULL
UNION ALL SELECT 'error', 'label is not 0 or 1', doc_id::VARCHAR, 1 FROM i WHERE quality IS NULL OR quality NOT IN (0, 1)
UNION ALL SELECT 'advice', 'text too short', doc_id::VARCHAR, 1 FROM i WHERE length(trim(text)) < 30
UNION ALL SELECT 'advice', 'source outside its vocabulary: ' || source, doc_id::VARCHAR, 1 FROM i WHERE source NOT IN ('src0', 'src1', 'src2')
UNION ALL SELECT 'advice', 'lang outside its vocabulary: ' || lang, doc_id::VARCHAR, 1 FROM i WHERE lang NOT IN ('en', 'de')
UNION ALL SELECT 'error', 'repeated id', doc_id::VARCHAR, count(*) FROM i GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'advice', 'text of ' || first, doc_id::VARCHAR, 1 FROM k JOIN m USING (key) WHERE doc_id > first
UNION ALL SELECT 'advice', 'more items are needed', NULL, 100000000 - n FROM n WHERE n < 100000000
UNION ALL SELECT 'advice', 'share of positives is far from its target', NULL, positive FROM n WHERE n > 0 AND abs(positive / n::DOUBLE - 0.01) > 0.15)
SELECT * FROM p""")
def v8_validate(spark, d):
    """All problems and advice of the documents as an evaluation set."""
    return evalset.validate_eval_set(_items(spark, d), "doc_id", "text", "quality", ["doc_id", "text", "quality"], {"source": ["src0", "src1", "src2"], "lang": ["en", "de"]}, 100_000_000, 0.01)


@query(rf"""WITH {_ITEMS_SQL}, b AS (SELECT * FROM i WHERE NOT synthetic AND quality IS NOT NULL AND toxic IS NOT NULL),
g AS (SELECT count(*) AS n_double, count_if(quality <> toxic)::BIGINT AS n_disagreements, avg((quality = toxic)::INTEGER::DOUBLE) AS seen, avg((quality = 1)::INTEGER::DOUBLE) AS pa, avg((toxic = 1)::INTEGER::DOUBLE) AS pb FROM b),
x AS (SELECT bool_or(synthetic) AS is_synthetic, count(*) AS n_items, count_if(quality = 1)::BIGINT AS n_positive, count_if(quality = 0)::BIGINT AS n_negative FROM i)
SELECT is_synthetic, n_items, n_positive, n_negative, round(n_positive / n_items::DOUBLE, 6) AS rate, n_double, n_disagreements, round((seen - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa,
  (SELECT string_agg(v || ':' || n, ',' ORDER BY v) FROM (SELECT coalesce(source, 'null') AS v, count(*) AS n FROM i GROUP BY v)) AS sources, (SELECT string_agg(v || ':' || n, ',' ORDER BY v) FROM (SELECT coalesce(lang, 'null') AS v, count(*) AS n FROM i GROUP BY v)) AS langs
FROM x, g""")
def v7_annotation_report(spark, d):
    found = evalset.annotation_report(_items(spark, d), "quality", "quality", "toxic", "synthetic", ["source", "lang"])
    said = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return found.select("is_synthetic", "n_items", "n_positive", "n_negative", r6("rate").alias("rate"), "n_double", "n_disagreements", r6("kappa").alias("kappa"), said("source").alias("sources"), said("lang").alias("langs"))


@query(r"""SELECT doc_id, length(text) AS n, substr(text, 1, 2000) AS comment, nullif(trim(substr(source, 1, 200)), '') AS contact, false AS reviewed FROM documents""")
def a1_appeals(spark, d):
    raw = docs(spark, d).select("doc_id", F.col("text").alias("body"), F.col("text").alias("comment"), F.col("source").alias("contact"))
    out = evalset.appeals(raw, "body", "comment", "contact", "v1")
    return out.select("doc_id", F.length("body").cast("bigint").alias("n"), "comment", "contact", "reviewed")


@query("""WITH m(locale) AS (SELECT DISTINCT lang FROM documents), x(locale) AS (VALUES ('en'))
SELECT m.locale, x.locale IS NOT NULL AS usable, CASE WHEN x.locale IS NULL THEN 'lexicon,wages' ELSE 'wages' END AS missing FROM m LEFT JOIN x USING (locale)""")
def l3_capabilities(spark, d):
    langs = docs(spark, d).select("lang").distinct()
    none = spark.createDataFrame([], "locale string, amount int")
    return dims.capabilities(langs, dims.lexicon(spark), none).select("locale", "usable", F.array_join("missing", ",").alias("missing"))


@query(f"WITH {OUTCOMES_SQL} SELECT doc_id, count(DISTINCT feature_id) AS n_features FROM o GROUP BY doc_id")
def l9_one_outcome_per_feature(spark, d):
    return rules.outcomes(_evaluated(spark, d), "doc_id").groupBy("doc_id").agg(F.count_distinct("feature_id").alias("n_features"))


@query(LABELLED + """, t AS (SELECT p AS score, sum(y) AS pos, count(*) AS n FROM l GROUP BY p), c AS (SELECT pos, sum(pos) OVER w / sum(n) OVER w AS prec, sum(pos) OVER () AS tot, sum(n) OVER () AS n FROM t WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(pos * prec) / max(tot) - max(tot) / max(n), 6) AS excess, sum(pos * prec) / max(tot) - max(tot) / max(n) < 0.10 AS sound FROM c""")
def m10_confound(spark, d):
    return metrics.confound(labelled(spark, d), "p", "y").select(r6("excess").alias("excess"), "sound")


@query(LABELLED + """, s AS (SELECT 'length' AS model, p AS score, y FROM l UNION ALL SELECT 'constant', 0.3::DOUBLE, y FROM l)
SELECT model, CASE WHEN max(score) = min(score) OR max(y) = min(y) THEN NULL ELSE count_if(score >= 0.5 AND y = 1) END::DOUBLE AS tp, CASE WHEN max(score) = min(score) OR max(y) = min(y) THEN NULL ELSE count_if(score >= 0.5 AND y = 0) END::DOUBLE AS fp FROM s GROUP BY model""")
def m12_before_after(spark, d):
    rows = labelled(spark, d)
    long = rows.select(F.lit("length").alias("model"), F.col("p").alias("score"), "y").union(rows.select(F.lit("constant"), F.lit(0.3), "y"))
    return metrics.at_half(long).select("model", *(F.col(c).cast("double").alias(c) for c in ("tp", "fp")))


@query(LABELLED + """, m AS (SELECT 'length' AS model, p AS score, y FROM l UNION ALL SELECT 'constant', 0.5::DOUBLE, y FROM l),
t AS (SELECT model, score, sum(y) AS pos, count(*) AS n FROM m GROUP BY ALL), c AS (SELECT model, pos, sum(pos) OVER w / sum(n) OVER w AS prec, sum(pos) OVER (PARTITION BY model) AS tot FROM t WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
a AS (SELECT model, sum(pos * prec) / max(tot) AS ap FROM c GROUP BY model) SELECT model, round(ap - (SELECT ap FROM a WHERE model = 'constant'), 6) AS delta FROM a""")
def m15_deltas(spark, d):
    rows = labelled(spark, d).select("y", F.col("p").alias("length"), F.lit(0.5).alias("constant"))
    return metrics.deltas(metrics.ablation(rows, "y", ["length", "constant"]), "constant").select("model", r6("delta").alias("delta"))


@query(LABELLED + """, b AS (SELECT CASE WHEN p = 0 THEN 0 ELSE ceil(p * 10)::INTEGER - 1 END AS bin, avg(p) AS mp, avg(y::DOUBLE) AS r, count(*) AS n FROM l GROUP BY 1)
SELECT round(sum(abs(mp - r) * n) / sum(n), 4) AS ece, round(max(abs(mp - r)), 4) AS mce FROM b""")
def k5_calibration_error(spark, d):
    return metrics.calibration_error(metrics.calibration_bins(labelled(spark, d), "p", "y")).select(F.round("ece", 4).alias("ece"), F.round("mce", 4).alias("mce"))


@query(PLATT_SQL + """, f AS (SELECT 'before' AS stage, p, y FROM m UNION ALL SELECT 'after', 1 / (1 + exp(-(a * m + b))), y FROM m, ab),
b AS (SELECT stage, CASE WHEN p = 0 THEN 0 ELSE ceil(p * 10)::INTEGER - 1 END AS bin, avg(p) AS mp, avg(y::DOUBLE) AS r, count(*) AS n FROM f GROUP BY ALL),
e AS (SELECT stage, sum(abs(mp - r) * n) / sum(n) AS ece, max(abs(mp - r)) AS mce FROM b GROUP BY stage), q AS (SELECT stage, avg(pow(p - y, 2)) AS brier FROM f GROUP BY stage)
SELECT stage, round(brier, 5) AS brier, round(ece, 5) AS ece, round(mce, 5) AS mce, ece <= 0.05 AND ece <= (SELECT ece FROM e WHERE stage = 'before') AS passed FROM e JOIN q USING (stage)""")
def k6_calibration_report(spark, d):
    """Before and after the fit."""
    out = metrics.calibration_report(labelled(spark, d).select("p", "y"), "p", "y")
    return out.select("stage", *(F.round(c, 5).alias(c) for c in ("brier", "ece", "mce")), "passed")


@query(SQL["k6_calibration_report"].replace("round(brier, 5)", "round(brier, 6)").replace("round(ece, 5)", "round(ece, 6)").replace("round(mce, 5) AS mce, ", ""))
def k6_calibrated(spark, d):
    out = metrics.calibration_report(labelled(spark, d).select("p", "y"), "p", "y")
    return out.select("stage", r6("brier").alias("brier"), r6("ece").alias("ece"), "passed")


@query(LABELLED + " SELECT doc_id, round(ln(greatest(least(p, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) / (1 - greatest(least(p, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE))), 6) AS margin FROM l")
def k3_margin(spark, d):
    return labelled(spark, d).select("doc_id", r6(metrics.to_margin(F.col("p"))).alias("margin"))


@query("SELECT doc_id, least(greatest(n_chars / 1000.0::DOUBLE - 1, -0.45::DOUBLE), 0.45::DOUBLE) AS shift, round(n_chars / 128.0::DOUBLE * 100, 2) AS points FROM documents")
def c3_c5_points_and_shift(spark, d):
    return docs(spark, d).select("doc_id", scoring.clip_shift(F.col("n_chars") / 1000.0 - 1).alias("shift"), scoring.points(F.col("n_chars") / 128.0, advisory=False).alias("points"))


@query(_lexicon_sql() + """, g AS (SELECT doc_id, string_agg(DISTINCT grp, '; ' ORDER BY grp) AS hits FROM h GROUP BY doc_id)
SELECT doc_id, CASE WHEN hits IS NULL THEN 'Assessed as ' || lang || '; no rule fired.' ELSE 'Assessed as ' || lang || ': ' || hits || '.' END AS summary FROM documents LEFT JOIN g USING (doc_id)""")
def c6_summary(spark, d):
    rows = phrases.with_hits(docs(spark, d).select("doc_id", "lang", "text"), "text", dims.lexicon(spark), framing=False)
    return rows.select("doc_id", scoring.summary(F.col("lang"), F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["grp"])))).alias("summary"))


@query()
def e4_top_terms(spark, d):
    train, _ = _model_rows(spark, d)
    scorer = models.fit_logistic(train, "text", "y")
    return explain.top_terms(scorer.terms.terms, scorer.coefficients.tolist(), spark, 20)


@query(LABELLED + """, m AS (SELECT 'length' AS model, p AS score, y FROM l UNION ALL SELECT 'constant', 0.5::DOUBLE, y FROM l),
t AS (SELECT model, score, sum(y)::BIGINT AS pos, count(*) AS n FROM m GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged, sum(pos) OVER q AS tot, sum(n) OVER q AS total FROM t WINDOW w AS (PARTITION BY model ORDER BY score DESC), q AS (PARTITION BY model)),
r AS (SELECT model, sum(pos * (tp / flagged)) / max(tot) AS ap, sum(pos * (total - tot - ((flagged - n) - (tp - pos)) - (n - pos) / 2.0::DOUBLE)) / (max(tot) * max(total - tot)) AS auc FROM c GROUP BY model)
SELECT printf('| %s | %.4f | %.4f |', model, ap, auc) AS line FROM r""")
def s9_metrics_table(spark, d):
    from plumbline.sources.readers import metrics_table

    rows = labelled(spark, d).select("y", F.col("p").alias("length"), F.lit(0.5).alias("constant"))
    return metrics_table(metrics.ablation(rows, "y", ["length", "constant"]))


@query(SPLIT_SQL + """, c AS (SELECT split, count(*) AS n, sum(quality)::BIGINT AS positives, substr(sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)), 1, 16) AS checksum FROM s GROUP BY split)
SELECT '{"seed":42,"splits":{' || string_agg('"' || split || '":{"n":' || n || ',"positives":' || positives || ',"checksum":"' || checksum || '"}', ',' ORDER BY split) || '}}' AS manifest FROM c""")
def s3_manifest(spark, d):
    from plumbline.sources.readers import manifest

    split = _split(spark, d).withColumn("words", F.lit(1))
    return manifest(split, corpus.split_report(split, "quality", "words"), corpus.split_checksum(split, "doc_id"), 42)


@query("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)")
def s11_aligned(spark, d):
    from plumbline.sources.readers import aligned

    return aligned(docs(spark, d).select("doc_id"), read(spark, d, "labels").select("doc_id", "quality"), "doc_id")[0]


# --- streaming --------------------------------------------------------------------------------------------------


@query(SQL["c7_score_documents"])
def g1_stream_scoring(spark, d):
    """All documents scored as a stream; the records are read back from its sink."""
    root = scratch(spark, "stream")
    table = read(spark, d, "documents")
    stream = spark.readStream.schema(table.schema).parquet(f"{d}/documents.parquet*")  # a file or a folder of them
    stream = stream.repartition(spark.sparkContext.defaultParallelism)  # the table may be one row group, and so one task
    jobs.score_stream(stream, lambda rows: _records(_scored_rows(rows, spark)), f"{root}/scored", f"{root}/state").awaitTermination()
    return spark.read.schema("doc_id long, reject string, shift double, score int, band string, summary string").parquet(f"{root}/scored").drop("rejected")


# --- the flagship -----------------------------------------------------------------------------------------------


@query(_lexicon_sql() + rf""", s AS (SELECT doc_id, 1 - product(1 - weight) AS p FROM h GROUP BY doc_id),
c AS (SELECT lang, regexp_matches(text, '{_EMAIL_SQL}') OR regexp_matches(text, '{PHONE}') AS contact, round_even((1 - coalesce(p, 0)) * 100, 0) AS score FROM documents LEFT JOIN s USING (doc_id))
SELECT lang, contact, CASE WHEN score < 40 THEN 'high_risk' WHEN score >= 70 THEN 'low_risk' ELSE 'medium_risk' END AS band, count(*) AS n FROM c GROUP BY ALL""")
def flagship(spark, d):
    """Which documents carry contact details or flagged phrases, and what band their score gives."""
    raw = F.coalesce("text", F.lit(""))
    rows = phrases.with_hits(docs(spark, d).select("doc_id", "lang", "text"), "text", dims.lexicon(spark), framing=False)
    contact = (F.contains(raw, F.lit("@")) & F.regexp_like(raw, F.lit(extract.EMAIL))) | F.regexp_like(raw, F.lit(PHONE))
    rows = rows.select("lang", contact.alias("contact"), phrases.saturated(F.transform("hits", lambda h: h["weight"])).alias("p"))
    return rows.groupBy("lang", "contact", scoring.label(scoring.score(F.coalesce("p", F.lit(0.0)), F.lit(0.0))).alias("band")).agg(F.count("*").alias("n"))
