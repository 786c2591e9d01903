"""Deterministic rules over mentions and phrases; each feature fires, is clean, or isn't assessed. All are expressions on the row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.spans import find_spans
from plumbline.operators import fixed
from plumbline.operators.dims import minimum_wage
from plumbline.operators.fixed import FEATURES, PLACEHOLDER_POINTS
from plumbline.operators.phrases import group_scores, match_phrases, saturated, with_hits


@dataclass(frozen=True)
class Settings:
    """Inputs of the rules. Those of salaries depend on the locale: ``SETTINGS`` has one for each."""

    free: tuple[str, ...] = fixed.FREE_PROVIDERS
    disposable: tuple[str, ...] = fixed.DISPOSABLE_PROVIDERS
    shorteners: tuple[str, ...] = fixed.SHORTENERS
    aggregators: tuple[str, ...] = fixed.AGGREGATORS
    telegram_hosts: tuple[str, ...] = fixed.TELEGRAM_HOSTS
    whatsapp_hosts: tuple[str, ...] = fixed.WHATSAPP_HOSTS
    telegram: tuple[str, ...] = fixed.TELEGRAM_PHRASES
    whatsapp: tuple[str, ...] = fixed.WHATSAPP_PHRASES
    chat_hiring: tuple[str, ...] = fixed.CHAT_HIRING
    anonymous: tuple[str, ...] = fixed.ANONYMOUS
    no_experience: tuple[str, ...] = fixed.NO_EXPERIENCE
    years: str = fixed.YEARS
    salary_words: str = fixed.SALARY_WORDS
    cost_words: str = fixed.COST_WORDS
    senior: tuple[str, ...] = fixed.LOCALES["en"]["senior"]
    entry: tuple[str, ...] = fixed.LOCALES["en"]["entry"] + fixed.LOCALES["en"]["roles"]
    currency: tuple[str, ...] = fixed.LOCALES["en"]["currency"]
    dot_is_thousands: bool = False
    floor: int = fixed.LOCALES["en"]["floor"]
    ceiling: int = fixed.LOCALES["en"]["ceiling"]
    payment_group: str = "payment"


def settings_of(code: str, base: Settings = Settings()) -> Settings:
    """Settings with the salary inputs of one locale."""
    known = fixed.LOCALES[code]
    return replace(base, senior=known["senior"], entry=known["entry"] + known["roles"], **{k: known[k] for k in ("currency", "dot_is_thousands", "floor", "ceiling")})


SETTINGS = {code: settings_of(code) for code in fixed.LOCALES}
#: What only the salary rule reads.
_PLAIN = {k: getattr(Settings(), k) for k in ("salary_words", "cost_words", "senior", "entry", "currency", "dot_is_thousands", "floor", "ceiling")}


def listed(value: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(value.isin(*names), F.lit(False)) if names else F.lit(False)


def any_in(low: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in phrases), F.lit(False))


def outcome(severity: Column, evidence: Column, available: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """A rule's result; what isn't available has severity 0, no evidence and no span."""
    ok = F.coalesce(available, F.lit(False))
    fired = ok & (severity > 0)
    place = [F.when(fired, c).cast("int").alias(n) for n, c in (("start", F.lit(None) if start is None else start), ("end", F.lit(None) if end is None else end))]
    return F.struct(F.when(ok, F.coalesce(severity, F.lit(0.0))).otherwise(0.0).alias("severity"), ok.alias("available"), F.when(fired, evidence).alias("evidence"), *place)


def spanned(severity: Column, span: Column, available: Column) -> Column:
    return outcome(severity, span["text"], available, span["start"], span["end"])


def domain_class(domain: Column, classes: dict[str, str]) -> Column:
    """Class of a host or of a parent domain of it."""
    parts = F.split(domain, r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    table = F.create_map(*(F.lit(x) for kv in classes.items() for x in kv))
    return F.get(F.filter(F.transform(parents, lambda p: F.try_element_at(table, p)), lambda c: c.isNotNull()), F.lit(0))


def provider(email: Column) -> Column:
    return tx.registrable_label(tx.email_domain(email["text"]))


def corporate(s: Settings) -> Column:
    return F.filter("emails", lambda e: ~listed(provider(e), s.free + s.disposable))


def email_free_provider(s: Settings) -> Column:
    """0.95 for a disposable provider, 0.55 for a free one; the first such address in the text counts."""
    first = F.get(F.filter("emails", lambda e: listed(provider(e), s.free + s.disposable)), F.lit(0))
    return spanned(F.when(listed(provider(first), s.disposable), fixed.DISPOSABLE).when(first.isNotNull(), fixed.FREE).otherwise(0.0), first, ~F.col("has_redaction"))


def shortened(url: Column, s: Settings) -> Column:
    return listed(tx.url_host(url["text"]), s.shorteners)


def email_absent(s: Settings) -> Column:
    """0.35 without an address or an ordinary link but with some other route, 0.55 with none. An aggregator is an ordinary link here."""
    ordinary = F.exists("urls", lambda u: ~shortened(u, s))
    route = (F.size("urls") > 0) | (F.size("phones") > 0)
    return outcome(F.when((F.size("emails") > 0) | ordinary, 0.0).when(route, fixed.NO_ADDRESS).otherwise(fixed.NO_ROUTE), F.lit("no address"), ~F.col("has_redaction"))


def email_domain_mismatch(s: Settings) -> Column:
    """0.60 where a corporate address fits none of the companies named; fits are generous."""

    def fits(e: Column, c: Column) -> Column:
        label = F.lower(provider(e))
        # The legal form, the first word, is no part of the name.
        bare = F.when(F.contains(c["text"], F.lit(" ")), F.regexp_replace(c["text"], r"^\s*\S+\s+", "")).otherwise(c["text"])
        name = tx.match_form(bare)
        words = F.filter(F.transform(F.split(bare, r"\s+", -1), tx.match_form), lambda w: F.length(w) >= 4)
        return (name == "") | (label == "") | F.contains(name, label) | F.contains(label, name) | (label == tx.acronym(bare)) | F.exists(words, lambda w: F.contains(label, w))

    strangers = F.filter(corporate(s), lambda e: ~F.exists("companies", lambda c: fits(e, c)))
    hit = (F.size("companies") > 0) & (F.size(strangers) > 0)
    return spanned(F.when(hit, fixed.MISMATCH).otherwise(0.0), F.get(strangers, F.lit(0)), ~F.col("has_redaction"))


def channel(hosts: tuple[str, ...], phrases: tuple[str, ...]) -> Column:
    """Where a text leads to a chat: a link to one of the hosts before the first of the phrases it holds; null if it doesn't."""
    link = F.get(F.filter("urls", lambda u: listed(tx.url_host(u["text"]), hosts)), F.lit(0))
    low = F.col("low")
    said = F.get(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p)), F.lit(0))
    start = F.instr(low, said) - 1
    phrase = F.when(said.isNotNull(), F.struct(said.alias("text"), start.alias("start"), (start + F.length(said)).alias("end")))
    return F.coalesce(link, phrase)


def contact_messaging_only(s: Settings) -> Column:
    """Chat as the only route: Telegram before WhatsApp, more with chat hiring or a recruiter without a name."""
    low = F.col("low")
    informal = s.shorteners + s.aggregators + s.whatsapp_hosts + s.telegram_hosts
    formal = (F.size(corporate(s)) > 0) | F.exists("urls", lambda u: ~listed(tx.url_host(u["text"]), informal))
    telegram, whatsapp = channel(s.telegram_hosts, s.telegram), channel(s.whatsapp_hosts, s.whatsapp)
    base = F.when(telegram.isNotNull(), fixed.TELEGRAM).when(whatsapp.isNotNull(), fixed.WHATSAPP).otherwise(0.0)
    more = F.when(any_in(low, s.chat_hiring), fixed.CHAT_BOOST).otherwise(0.0) + F.when(any_in(low, s.anonymous), fixed.ANONYMOUS_BOOST).otherwise(0.0)
    return spanned(F.when(formal | (base == 0), 0.0).otherwise(F.least(base + more, F.lit(1.0))), F.coalesce(telegram, whatsapp), ~F.col("has_redaction"))


def url_shortener(s: Settings) -> Column:
    """0.45 for a shortened link beside an ordinary one, 0.65 without; an aggregator is neither."""
    first = F.get(F.filter("urls", lambda u: shortened(u, s)), F.lit(0))
    ordinary = F.exists("urls", lambda u: ~listed(tx.url_host(u["text"]), s.shorteners + s.aggregators))
    return spanned(F.when(first.isNotNull() & ordinary, fixed.SHORT_AND_OTHER).when(first.isNotNull(), fixed.SHORT_ONLY).otherwise(0.0), first, ~F.col("has_redaction"))


def qualification_conflict(s: Settings) -> Column:
    """No experience asked for, and years of it: min(0.35 + 0.10 (years - 2), 0.85) from two years on."""
    low = F.col("low")
    at = lambda p: F.instr(low, p) - 1
    before = lambda p: F.substring(low, F.greatest(at(p) - fixed.NEGATION_WINDOW, F.lit(0)) + 1, F.least(at(p), F.lit(fixed.NEGATION_WINDOW)))
    free = F.filter(F.array(*map(F.lit, s.no_experience)), lambda p: F.contains(low, p) & ~F.regexp_like(before(p), F.lit(fixed.NEGATION)))
    asked = find_spans(low, s.years, F.size(free) > 0)
    counted = F.transform(asked, lambda m: F.struct(F.regexp_extract(m["text"], r"\d{1,2}", 0).cast("int").alias("years"), (-m["start"]).alias("first"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text")))
    most = F.array_max(F.filter(counted, lambda m: m["years"] >= fixed.MIN_YEARS))
    hit = (F.size(free) > 0) & most.isNotNull()
    said = F.when(F.size(free) > 0, most)
    return outcome(F.when(hit, F.round(F.least(0.35 + 0.10 * (said["years"] - fixed.MIN_YEARS), F.lit(0.85)), 4)).otherwise(0.0), F.concat_ws(" / ", F.get(free, F.lit(0)), said["text"]), F.lit(True), said["start"], said["end"])


def amount_pattern(s: Settings) -> str:
    """Amounts by the locale's separators: with a unit, grouped, after a currency, or of four digits and more, in this order."""
    quoted = "|".join(rf"\Q{t}\E" for t in s.currency) or "rp"
    units = "|".join(sorted(fixed.UNITS, key=len, reverse=True))
    group, point = (r"\.", ",") if s.dot_is_thousands else (",", r"\.")
    grouped, bare = rf"\d{{1,3}}(?:{group}\d{{3}})++(?:{point}\d{{1,2}})?", rf"\d{{1,4}}(?:{point}\d{{1,3}})?"
    money = rf"(?:(?:{quoted})\s*)?"
    return rf"(?iU)(?:{money}(?:{grouped}|{bare})\s*(?:{units})\b|{money}{grouped}|(?:{quoted})\s*\d{{1,4}}(?:[.,]\d{{1,2}})?|\d{{4,}})"


def amount(fragment: Column, dot_is_thousands: bool) -> Column:
    """A written amount as a number: separators by locale, units of thousands and millions, cut to a whole; null if it is none, or one beyond a bigint."""
    units = "|".join(sorted(fixed.UNITS, key=len, reverse=True))
    low = F.lower(F.trim(fragment))
    unit = F.regexp_extract(low, rf"({units})\s*$", 1)
    digits = F.trim(F.regexp_replace(F.regexp_replace(low, rf"({units})\s*$", ""), r"[^\d.,]", ""), F.lit(" .,"))
    plain = F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if dot_is_thousands else F.replace(digits, F.lit(","), F.lit(""))
    table = F.create_map(*(F.lit(x) for kv in fixed.UNITS.items() for x in kv))
    return (plain.try_cast("double") * F.coalesce(F.try_element_at(table, unit), F.lit(1.0))).try_cast("bigint")


def monthly(value: Column, tail: Column) -> Column:
    """An amount per month, by the first of hour, day, week and year that the text after it names; null beyond a bigint."""
    has = lambda regex: F.regexp_like(tail, F.lit(regex))
    per = F.when(has(fixed.PER_HOUR), (value * fixed.HOURS).try_cast("bigint")).when(has(fixed.PER_DAY), F.try_multiply(value, F.lit(fixed.DAYS))).when(has(fixed.PER_WEEK), F.try_multiply(value, F.lit(fixed.WEEKS)))
    return per.when(has(fixed.PER_YEAR), (value / fixed.MONTHS).cast("bigint")).otherwise(value)


def salaries(s: Settings) -> Column:
    """Candidate salaries ``(amount, start, end)`` per month: a salary word near, no cost word after it, within bounds."""
    low = F.col("low")

    def candidate(m: Column) -> Column:
        from_ = F.greatest(m["start"] - fixed.SALARY_WINDOW, F.lit(0))
        window = F.substring(low, from_ + 1, m["end"] - from_)
        salary, cost = F.regexp_instr(window, F.lit(s.salary_words)), F.regexp_instr(window, F.lit(s.cost_words))
        value = monthly(amount(m["text"], s.dot_is_thousands), F.substring(low, m["start"] + 1, m["end"] - m["start"] + fixed.SALARY_TAIL))
        return F.struct(F.when((salary > 0) & (cost <= salary), value).alias("amount"), m["start"].alias("start"), m["end"].alias("end"))

    found = F.when(F.regexp_like(low, F.lit(s.salary_words)), F.transform(find_spans(low, amount_pattern(s)), candidate))
    return F.filter(F.coalesce(found, F.expr("cast(array() as array<struct<amount:bigint,start:int,end:int>>)")), lambda c: c["amount"].between(s.floor, s.ceiling))


def entry_level(s: Settings) -> Column:
    """Said to need no experience, or by nature; a senior's word rules it out."""
    return ~any_in(F.col("low"), s.senior) & any_in(F.col("low"), s.entry)


def salary_implausible_vs_umk(s: Settings) -> Column:
    """How far the lowest salary found reaches a multiple of the region's ``minimum``; without a minimum, not assessed."""
    lowest = F.array_min(salaries(s))
    limit = F.when(entry_level(s), fixed.ENTRY_MULTIPLE).otherwise(fixed.GENERAL_MULTIPLE)
    multiple = F.when(F.col("minimum") > 0, lowest["amount"] / F.col("minimum")).otherwise(0.0)
    severity = F.when(lowest.isNotNull() & (multiple >= limit), F.round(F.least(0.4 + 0.6 * (multiple - limit) / limit, F.lit(1.0)), 4)).otherwise(0.0)
    return outcome(severity, lowest["amount"].cast("string"), F.col("minimum").isNotNull(), lowest["start"], lowest["end"])


def phrase_rule(mine: Column) -> Column:
    """The saturating score of hits; evidence is the three heaviest and how many more, and the span that of the heaviest."""
    heavy = F.array_sort(F.transform(mine, lambda h: F.struct((-h["weight"]).alias("w"), h["start"].alias("start"), h["phrase"].alias("phrase"), h["end"].alias("end"))))
    top = F.array_join(F.transform(F.slice(heavy, 1, 3), lambda h: h["phrase"]), ", ")
    first = F.get(heavy, F.lit(0))
    more = F.when(F.size(heavy) > 3, F.concat(F.lit(" +"), F.size(heavy) - 3)).otherwise("")
    return outcome(F.round(saturated(F.transform(mine, lambda h: h["weight"])), 4), F.concat(top, more), F.col("has_lexicon"), first["start"], first["end"])


def payment_request_id(s: Settings) -> Column:
    return phrase_rule(F.filter("hits", lambda h: h["grp"] == s.payment_group))


def risk_phrase_score_id(s: Settings) -> Column:
    return phrase_rule(F.filter("hits", lambda h: h["grp"] != s.payment_group))


#: One owner for each feature; more can be given to ``evaluate_rules``.
RULES: dict[str, Callable[[Settings], Column]] = {
    f.__name__: f
    for f in (email_free_provider, email_absent, email_domain_mismatch, contact_messaging_only, qualification_conflict, url_shortener, salary_implausible_vs_umk, risk_phrase_score_id, payment_request_id)
}


def evaluate_rules(
    df: DataFrame, key: str, text: str, lexicon: DataFrame, settings: Settings | dict[str, Settings] = Settings(), rules: dict[str, Callable[[Settings], Column]] | None = None, locale: str | None = None, wages: DataFrame | None = None
) -> DataFrame:
    """Adds one struct ``(severity, available, evidence, start, end)`` per feature to documents with mentions.

    With ``locale``, a column, phrases are those of the row's locale, ``settings`` may differ by locale, and ``wages`` gives each row its
    minimum; without, all phrases count, and a ``minimum`` column is used if there is one. Rows are extended in place: no shuffle.
    """
    out = with_hits(df, text, lexicon, locale=locale).withColumn("low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    if wages is not None:
        if locale is None:
            raise ValueError("wages are looked up by locale")
        out = minimum_wage(out, text, wages, locale)
    if "minimum" not in out.columns:
        out = out.withColumn("minimum", F.lit(None).cast("bigint"))

    def applied(rule: Callable[[Settings], Column]) -> Column:
        if isinstance(settings, Settings):
            return rule(settings)
        if rule is not salary_implausible_vs_umk and len({replace(s, **_PLAIN) for s in settings.values()}) == 1:
            return rule(next(iter(settings.values())))  # the locale makes no difference to this rule
        made = {code: rule(s) for code, s in settings.items()}
        cases = reduce(lambda c, kv: c.when(F.col(locale) == kv[0], kv[1]), list(made.items())[1:], F.when(F.col(locale) == next(iter(made)), next(iter(made.values()))))
        return cases.otherwise(outcome(F.lit(0.0), F.lit(None).cast("string"), F.lit(False)))

    return out.withColumns({name: applied(rule) for name, rule in (rules or RULES).items()})


def outcomes(wide: DataFrame, key: str, order: tuple[str, ...] = FEATURES) -> DataFrame:
    """Long form: ``key, ord, feature_id, severity, available, evidence, start, end``."""
    names = ("severity", "available", "evidence", "start", "end")
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(f).alias("feature_id"), *(F.col(f)[n].alias(n) for n in names)) for i, f in enumerate(order)))
    return wide.select(key, F.inline(rows))


def vector_of(order: tuple[str, ...] = FEATURES) -> Column:
    """Severities of a wide row in the fixed order; null where not assessed."""
    return F.array(*(F.when(F.col(f)["available"], F.col(f)["severity"]) for f in order))


def rule_vector(long: DataFrame, key: str, order: tuple[str, ...] = FEATURES) -> DataFrame:
    """``key, vector, mask``: severities in the fixed order (null: not assessed) and availability."""
    entries = F.sort_array(F.collect_list(F.struct("ord", F.when(F.col("available"), F.col("severity")).alias("s"), "available")))
    return long.groupBy(key).agg(entries.alias("e")).select(key, F.transform("e", lambda x: x["s"]).alias("vector"), F.transform("e", lambda x: x["available"]).alias("mask"))


def hits_of(advisory: bool = True, weights: dict[str, float] = PLACEHOLDER_POINTS, order: tuple[str, ...] = FEATURES) -> Column:
    """What fired on a wide row, as an array by contribution and severity, with ``tier``, evidence and span; in advisory mode contributions are 0."""
    tier = lambda s: F.when(s >= 0.7, "high").when(s >= 0.4, "med").otherwise("low")
    worth = lambda f: F.lit(0.0) if advisory else F.round(F.col(f)["severity"] * F.lit(float(weights.get(f, 0.0))), 2)

    def entry(i: int, f: str) -> Column:
        held = F.col(f)
        fields = [(-worth(f)).alias("minus"), (-held["severity"]).alias("least"), F.lit(i).alias("ord"), F.lit(f).alias("feature_id"), worth(f).alias("contribution"), held["severity"].alias("severity"), tier(held["severity"]).alias("tier")]
        return F.struct(*fields, *(held[n].alias(n) for n in ("evidence", "start", "end")))

    return F.array_sort(F.array_compact(F.array(*(F.when(F.col(f)["available"] & (F.col(f)["severity"] > 0), entry(i, f)) for i, f in enumerate(order)))))


def rule_hits(wide: DataFrame, key: str, advisory: bool = True, weights: dict[str, float] = PLACEHOLDER_POINTS, order: tuple[str, ...] = FEATURES) -> DataFrame:
    """``hits_of`` each wide row as rows, with ``rank``. The hits of a row are sorted inside the row; nothing is shuffled."""
    fired = F.posexplode_outer(hits_of(advisory, weights, order)).alias("at", "h")
    return wide.select(key, fired).where("at IS NOT NULL").select(key, "h.ord", "h.feature_id", "h.severity", "h.contribution", "h.tier", "h.evidence", (F.col("at") + 1).alias("rank"))


def phrase_groups(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    return group_scores(match_phrases(df, key, text, lexicon), key)

