"""Text cleaning, normalisation, HTML reduction and URL parts, as column expressions."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from plumbline.functions.spans import find_spans, scan

#: Limits and character sets that results depend on.
MIN_CHARS, MAX_CHARS, MIN_MEANINGFUL, LONGEST_RUN = 30, 20_000, 20, 200
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{200b}-\x{200d}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}]"
INVISIBLE = r"[\x{a0}\x{200b}-\x{200d}\x{feff}\x{2060}]"
REDACTION = r"#(?:EMAIL|URL|PHONE)_[0-9a-fA-F]+#"
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg", "iframe")
PAGE_MIN, PAGE_MAX, LINE_MIN = 200, 8000, 15
SUFFIXES = ("co.id", "or.id", "go.id", "ac.id", "sch.id", "web.id", "my.id", "net.id", "biz.id", "desa.id", "ponpes.id", "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "com.sg", "com.my", "co.jp", "com.br")
ABBREVIATIONS = (
    "min", "maks", "max", "no", "hal", "dll", "dsb", "dkk", "yth", "sdr", "sdri", "tgl", "jl", "pt", "cv", "ud", "tlp", "telp", "hp", "wa",
    "a.n", "u.p", "mr", "mrs", "ms", "dr", "prof", "inc", "ltd", "co", "vs", "etc", "e.g", "i.e",
)
EXCERPT = 220
#: CamelCase terms that are words, not fused ones; a parameter of ``desegment``.
PROTECTED = (
    "JavaScript", "TypeScript", "CoffeeScript", "ActionScript", "VBScript", "NodeJS", "AngularJS", "BackboneJS", "EmberJS", "ReactJS", "jQuery", "ASPNet", "DotNet", "JavaBeans",
    "JavaServer", "JavaFX",
    "PostgreSQL", "MySQL", "NoSQL", "MongoDB", "SQLite", "MariaDB", "DynamoDB", "BigQuery", "GraphQL", "RabbitMQ", "ElasticSearch", "OpenStack", "VMware",
    "PowerPoint", "SharePoint", "QuickBooks", "WordPress", "WooCommerce", "SalesForce", "NetSuite", "MailChimp", "HubSpot", "ZenDesk", "PayPal", "GitHub", "GitLab", "BitBucket",
    "StackOverflow", "LinkedIn", "YouTube", "FaceBook", "InDesign", "PhotoShop", "AutoCAD", "SolidWorks", "MatLab",
    "iPhone", "iPad", "iPod", "iOS", "iMac", "MacBook", "macOS", "iTunes", "iCloud",
    "eCommerce", "eBay", "eLearning", "eMail", "DevOps", "PhD", "MBA", "CPA", "JavaScripts", "WiFi", "PowerShell", "TensorFlow", "PyTorch",
)

#: Tags that end a line, all tags, what a page's own text stands in, and blanks.
_BLOCK_END = re.compile(r"(?ai)</(?:p|div|li|tr|h[1-6]|br|section|article)>|<br\s*/?>")
_TAG, _ARTICLE, _BLANKS = re.compile(r"<[^>]+>"), re.compile(r"(?ai)<(article|main)"), re.compile("[ \t\xa0]+")
_XML = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def meaningful_chars(text: Column) -> Column:
    """Letters and digits of a text."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


_CONTROL = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", CONTROL))
_LONG_RUN = re.compile(rf"([^ \t\n\x0b\x0c\r])\1{{{LONGEST_RUN},}}")


def clean_one(text: str) -> tuple[str, int, int]:
    """A text in canonical composition, without control characters and long runs; how many of the former there were, and of the latter."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text, removed = _CONTROL.subn(" ", text)
    return *_LONG_RUN.subn(lambda m: m[0][:LONGEST_RUN] + " " * (len(m[0]) - LONGEST_RUN), text), removed


def composed(df: DataFrame, text: str) -> DataFrame:
    """Adds ``sanitized``, ``removed`` and ``runs`` of ``clean_one``: a pass over Arrow batches of the rows as they are, since Spark has no function for composition."""
    at, names = df.columns.index(text), [*df.columns, "sanitized", "removed", "runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [clean_one(t or "") for t in batch.column(at).to_pylist()]
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names)

    added = [StructField("sanitized", StringType()), StructField("removed", IntegerType()), StructField("runs", IntegerType())]
    return df.mapInArrow(run, StructType([*df.schema.fields, *added]))


@F.pandas_udf(StringType())
def unescaped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All HTML entities decoded; use it behind a test for an ampersand."""
    for part in parts:
        yield part.map(lambda t: None if t is None else html.unescape(t))


def entities_of(text: Column) -> Column:
    """All HTML entities decoded. Only texts with an ampersand go to Python: a worker gets nulls for the others."""
    return F.coalesce(unescaped(F.when(F.contains(text, F.lit("&")), text)), text)


def xml_entities(text: Column) -> Column:
    """The five entities of XML, decoded by replacement."""
    for name, char in _XML:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def sanitize(df: DataFrame, text: str, compose: bool = False) -> DataFrame:
    """Adds ``sanitized``, ``removed``, ``meaningful``, ``runs`` and ``analysable``; the text keeps its length.

    Control, bidirectional and zero-width characters become blanks, and of longer runs of one character LONGEST_RUN
    stay, then blanks. With ``compose``, texts that hold other than ASCII are composed first, and offsets refer to that.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    if compose:
        return composed(df, text).withColumn("meaningful", meaningful_chars(F.col("sanitized"))).withColumn("analysable", F.col("meaningful") >= MIN_MEANINGFUL)
    plain = F.regexp_replace(raw, CONTROL, " ")
    long_run = rf"(?s)([^\s])\1{{{LONGEST_RUN},}}"
    hits = F.regexp_extract_all(plain, F.lit(long_run), F.lit(0))
    cut = F.transform(hits, lambda h: F.rpad(F.substring(h, 1, LONGEST_RUN), F.length(h), F.lit(" ")))
    gaps = F.split(plain, long_run, -1)
    woven = F.array_join(F.concat(F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), cut, lambda g, c: F.array(g, c))), F.array(F.element_at(gaps, -1))), "")
    whole = F.when(F.size(hits) > 0, woven).otherwise(plain)
    out = df.withColumns({"sanitized": whole, "removed": F.length(raw) - F.length(F.regexp_replace(raw, CONTROL, "")), "runs": F.size(hits)})
    return out.withColumn("meaningful", meaningful_chars(F.col("sanitized"))).withColumn("analysable", F.col("meaningful") >= MIN_MEANINGFUL)


def reject_reason(text: Column, url: Column | None = None) -> Column:
    """Why an input can't be scored, or null: exactly one of text and URL, and the length limits."""
    has_url = F.lit(False) if url is None else url.isNotNull()
    return F.when(text.isNull() & ~has_url, "nothing_given").when(text.isNotNull() & has_url, "text_and_url").when(F.length(text) < MIN_CHARS, "too_short").when(F.length(text) > MAX_CHARS, "too_long")


def desegment(text: Column, protected: tuple[str, ...] = PROTECTED) -> Column:
    """Parts fused words at lower-to-Upper-lower and letter-to-digit seams, outside protected terms and markers.

    Terms and markers hold no white space, so only the words that have a seam are looked at for them.
    """
    kept = "|".join([REDACTION, *(f"(?i:{p})" for p in sorted(protected, key=len, reverse=True))])
    seams = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?<=[a-z])(?=[A-Z][a-z])", " "), r"(?<=[a-z])(?=\d)|(?<=\d)(?=[A-Z][a-z])", " ")

    def parted(word: Column) -> Column:
        return woven(F.transform(F.split(word, kept, -1), seams), F.regexp_extract_all(word, F.lit(f"({kept})"), F.lit(0)))

    if not all(p.isalnum() for p in protected):  # a pattern may match white space
        return parted(text)
    return woven(F.split(text, _SEAMED, -1), F.transform(F.regexp_extract_all(text, F.lit(_SEAMED), F.lit(0)), parted))


#: A run without white space that has a seam.
_SEAMED = r"(?<!\S)\S*?(?:[a-z][A-Z][a-z]|[a-z]\d|\d[A-Z][a-z])\S*+"


def woven(pieces: Column, hits: Column) -> Column:
    """Pieces with the hits between them, of which there is one fewer."""
    return F.array_join(F.flatten(F.zip_with(pieces, hits, lambda p, h: F.array(p, F.coalesce(h, F.lit(""))))), "")


def clean_text(text: Column, entities: str = "all", fused: bool = True) -> Column:
    """The corpus cleaner: entities (twice; ``entities`` "xml" takes five of them, natively), tags, broken apostrophes, invisible characters, seams, blanks, lines."""
    text = F.coalesce(text, F.lit(""))
    if entities == "all":
        text = entities_of(entities_of(text))
    elif entities == "xml":
        text = xml_entities(xml_entities(text))
    text = F.regexp_replace(text, r"<[^>]{1,200}>", " ")
    text = F.regexp_replace(text, r"(?<=[A-Za-z])\x{fffd}(?=[a-z])", "'")
    text = F.regexp_replace(F.replace(text, F.lit("�"), F.lit(" ")), INVISIBLE, " ")
    text = F.regexp_replace(text, r"\r\n?", "\n")
    if fused:
        text = desegment(text)
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\f\x0b]+", " "), r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(text, r"(?m)^ +| +$", ""), F.lit(" \n"))


def build_document(fields: list[Column], fused: bool = True) -> Column:
    """The fields, cleaned, without empty ones, one to a line."""
    return F.array_join(F.filter(F.array(*(clean_text(f, fused=fused) for f in fields)), lambda x: x != ""), "\n")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+", -1), lambda w: w != ""))


def without_elements(page: str, names: tuple[str, ...] = DROPPED) -> str:
    """The page with a blank for each of the elements, from its opening tag to the first closing tag of its kind; one without a closing tag stays.

    One pass: opening tags are met from the left, and for each kind the closing tags are gone through once.
    """
    kinds = "|".join(names)
    closing: dict[str, list[tuple[int, int]]] = {n: [] for n in names}
    for m in re.finditer(rf"(?ai)</({kinds})>", page):
        closing[m[1].lower()].append(m.span())
    at = dict.fromkeys(names, 0)
    out, done, bracket = [], 0, -1
    opening = re.compile(rf"(?ai)<({kinds})")
    m = opening.search(page)
    while m:
        if bracket < m.end():
            bracket = page.find(">", m.end())
        if bracket < 0:
            break
        kind = m[1].lower()
        ends, i = closing[kind], at[kind]
        while i < len(ends) and ends[i][0] <= bracket:
            i += 1
        at[kind] = i
        start = m.end()
        if i < len(ends):
            out += [page[done : m.start()], " "]
            done = start = ends[i][1]
        m = opening.search(page, start)
    return "".join(out) + page[done:]


def page_text(page: str, entities: Callable[[str], str]) -> str:
    """A page as text: some elements go with their content, an article is preferred, blocks end in new lines. Linear in the page."""
    page = without_elements(page)
    if m := _first_article(page):
        page = m
    page = _BLOCK_END.sub("\n", page)
    last = page.rfind(">") + 1  # behind it no tag ends, so none is looked for
    page = entities(_TAG.sub(" ", page[:last]) + page[last:])
    lines = (x.strip(" \r") for x in _BLANKS.sub(" ", page).split("\n"))
    return "\n".join(x for x in lines if x)


def _first_article(page: str) -> str:
    """What the first article or main element that is closed holds."""
    ends = {"article": 0, "main": 0}
    low_ends = {k: [m.start() for m in re.finditer(rf"(?ai)</{k}>", page)] for k in ends}
    bracket = -1
    for m in _ARTICLE.finditer(page):
        if bracket < m.end():
            bracket = page.find(">", m.end())
        if bracket < 0:
            break
        kind = m[1].lower()
        i = ends[kind]
        while i < len(low_ends[kind]) and low_ends[kind][i] <= bracket:
            i += 1
        ends[kind] = i
        if i < len(low_ends[kind]):
            return page[bracket + 1 : low_ends[kind][i]]
    return ""


def html_to_text(html_page: Column, entities: str = "all") -> Column:
    """A page as text (see ``page_text``), in Arrow batches; null is empty. ``entities`` "xml" decodes XML's five alone."""
    decode = html.unescape if entities == "all" else _five

    @F.pandas_udf(StringType())
    def reduced(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: page_text(t, decode))

    return reduced(F.coalesce(html_page, F.lit("")))


def _five(text: str) -> str:
    for name, char in _XML:
        text = text.replace(name, char)
    return text


def page_gate(text: Column, markers: list[str]) -> Column:
    """Why a page's text isn't one advertisement, or an empty string."""
    low = F.lower(text)
    found = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x != "")
    short = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) < F.size(lines) * LINE_MIN
    return F.when(F.length(text) < PAGE_MIN, "too_short").when(F.length(text) > PAGE_MAX, "too_long_for_one_ad").when(~found, "no_job_ad_markers").when(short, "looks_like_navigation").otherwise("")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def redirected_to_root(requested: Column, final: Column) -> Column:
    """True where a deep link ended at the site's front page."""
    return (F.trim(url_path(requested), F.lit("/")) != "") & (F.trim(url_path(final), F.lit("/")) == "")


def text_key(text: Column) -> Column:
    """Texts that differ only in case and white space have one key."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def excerpt(text: Column, size: int = EXCERPT) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(flat)


def url_host(url: Column) -> Column:
    """Host of a URL, with or without a scheme: no user, port, path or query."""
    bare = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_extract(bare, r"^[^/?#]*", 0)
    return F.regexp_replace(F.regexp_replace(bare, r"^.*@", ""), r":\d*$", "")


def email_domain(address: Column) -> Column:
    return F.lower(F.substring_index(address, "@", -1))


def registrable_label(domain: Column) -> Column:
    """The label that someone registered: the last but one, or but two before a suffix of two parts."""
    suffix = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
    low = F.lower(domain)
    rest = F.when(F.regexp_like(low, F.lit(rf"\.({suffix})$")), F.regexp_replace(low, rf"\.({suffix})$", "")).otherwise(F.regexp_replace(low, r"\.[^.]*$", ""))
    return F.element_at(F.split(rest, r"\.", -1), -1)


def match_form(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def acronym(value: Column) -> Column:
    """The first letters of a name's words, in lower case; words that begin otherwise give none."""
    words = F.split(F.lower(value), r"\s+", -1)
    return F.array_join(F.transform(words, lambda w: F.regexp_extract(w, r"^\p{L}", 0)), "")


def sentence_boundary(abbreviations: tuple[str, ...] = ABBREVIATIONS) -> str:
    # What few places pass is asked first: looking back for every abbreviation is dear.
    guards = "".join(rf"(?<!\b{a.replace('.', chr(92) + '.')}\.)" for a in abbreviations)
    return rf"(?i)(?:(?<=[.!?])(?=\s){guards}\s+(?!\d))|\n+"


def sentences(text: Column) -> Column:
    """``array<struct<text,start,end>>`` of trimmed sentences, with offsets into the text."""
    boundary = sentence_boundary()
    breaks = F.concat(F.transform(F.regexp_extract_all(text, F.lit(boundary), F.lit(0)), F.length), F.array(F.lit(0)))
    pairs = F.zip_with(F.split(text, boundary, -1), breaks, lambda p, b: F.struct(p.alias("piece"), F.coalesce(b, F.lit(0)).alias("gap")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        left = F.regexp_replace(x["piece"], r"^\s+", "")
        begin = at + F.length(x["piece"]) - F.length(left)
        body = F.regexp_replace(left, r"(?<!\s)\s++$", "")
        return at + F.length(x["piece"]) + x["gap"], F.struct(body.alias("text"), begin.alias("start"), (begin + F.length(body)).alias("end"))

    return F.filter(scan(pairs, F.lit(0), step, "struct<text:string,start:int,end:int>"), lambda s: s["text"] != "")


def has_redaction(text: Column) -> Column:
    return F.regexp_like(text, F.lit(REDACTION))


def redactions(text: Column) -> Column:
    return find_spans(text, REDACTION, F.contains(text, F.lit("_")) & F.contains(text, F.lit("#")))
