"""Text functions as Column expressions: normal forms, vocabulary tests, seasons, dates, labels.

Word limits are ASCII look-arounds throughout, because Java's `\\b` also sees accented letters as word characters.
`normalized` expects compatibility-composed text (NFKC); `compatible` brings a column into that form.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vocabulary and place names.
STATES = (
    "alabama|alaska|arizona|arkansas|california|colorado|connecticut|delaware|florida|georgia|hawaii|idaho|illinois|indiana|iowa|kansas|kentucky|louisiana|maine|maryland|massachusetts|michigan|minnesota|mississippi|missouri|montana|nebraska|nevada|new hampshire|new jersey|new mexico|new york|north carolina|north dakota|ohio|oklahoma|oregon|pennsylvania|rhode island|south carolina|south dakota|tennessee|texas|utah|vermont|virginia|washington|west virginia|wisconsin|wyoming|district of columbia"
)
STATE_CODES = "al|ak|az|ar|ca|co|ct|de|fl|ga|hi|id|il|in|ia|ks|ky|la|me|md|ma|mi|mn|ms|mo|mt|ne|nv|nh|nj|nm|ny|nc|nd|oh|ok|or|pa|ri|sc|sd|tn|tx|ut|vt|va|wa|wv|wi|wy|dc"
ELSEWHERE = "canada|toronto|vancouver|montreal|europe|emea|asia|india|united kingdom|uk|australia|global"
OPPORTUNITY = "intern(?:ship)?|co[- ]?op|new[- ]?grad|early[- ]?career"
APPLICATION = "apply|application|applications|career|careers|greenhouse|lever|workday|ashby"
NOISE = "webinar|conference|meetup|workshop|resume review|office hours|hackathon"
SENIOR = "senior|staff|principal|manager"
LEGAL_FORMS = "incorporated|inc|llc|ltd|limited|corporation|corp|company|co"
SEASONS = (("spring", "spring"), ("summer", "summer"), ("fall", "fall|autumn"), ("winter", "winter"))
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
CITIZENS, NO_SPONSOR, LOCKED = "🇺🇸", "🛂", "🔒"

BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value is computed once however often `then` names it: it is a lambda's argument."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def word(pattern: str) -> str:
    """The pattern between ASCII word limits, in either case."""
    return f"(?i){BEFORE}(?:{pattern}){AFTER}"


def found(text: Text, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(col(text), pattern, group), F.lit(""))


def spaced(text: Text) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def named_of(*names: Column) -> Column:
    """The names that are neither null nor empty, as an array. A filter would do, but what it is given isn't compiled."""
    return F.array_remove(F.array(*(F.coalesce(n, F.lit("")) for n in names)), "")


def says(low: Column | None, *words: str) -> Column:
    """Whether a lower-case text holds one of the words: what a pattern in either case can't do without, at little cost."""
    return F.lit(True) if low is None else reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))


# --- normal forms (F1-F5) ---


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _nfkc(rows: pd.Series) -> pd.Series:
    form = lambda v: v if v is None else unicodedata.normalize("NFKC", v)
    return rows.map(lambda row: row if row is None else [part if part is None else [form(v) for v in part] for part in row])


def compatible(frame: DataFrame, *columns: str) -> DataFrame:
    """The columns (text or arrays of text) in Unicode's form NFKC. Only rows that hold a character beyond ASCII leave the
    JVM, as an array of their columns, so whatever characters a text holds, it comes back in its place."""
    listed = {c: isinstance(frame.schema[c].dataType, T.ArrayType) for c in columns}
    beyond = F.regexp_like(F.concat_ws("", *columns), F.lit(r"[^\x00-\x7F]"))
    packed = F.array(*(F.col(c) if many else F.array(c) for c, many in listed.items()))
    staged = frame.withColumn("__nfkc", _nfkc(F.when(beyond, packed)))
    form = lambda i, many: F.get("__nfkc", F.lit(i)) if many else F.get(F.get("__nfkc", F.lit(i)), F.lit(0))
    made = {c: F.when(F.col("__nfkc").isNull(), F.col(c)).otherwise(form(i, many)) for i, (c, many) in enumerate(listed.items())}
    return staged.withColumns(made).drop("__nfkc")


def normalized(text: Text) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(text)), "&", " and "), r"[^\p{L}\p{N}]+", " "))


def company_form(company: Text) -> Column:
    return F.trim(F.regexp_replace(normalized(company), rf"{BEFORE}(?:{LEGAL_FORMS})$", ""))


def role_form(role: Text) -> Column:
    steps = ((rf"{BEFORE}(?:summer|spring|fall|winter)\s+20[0-9]{{2}}{AFTER}", " "), (rf"{BEFORE}internships?{AFTER}", "intern"), (rf"{BEFORE}engineering{AFTER}", "engineer"))
    return spaced(reduce(lambda c, s: F.regexp_replace(c, *s), steps, normalized(role)))


def tokens(text: Text) -> Column:
    """Distinct words of a normal form."""
    return F.array_distinct(F.filter(F.split(col(text), " "), lambda t: t != ""))


def jaccard(left: Column, right: Column) -> Column:
    """Of two token sets; 0 if both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / union)


def fingerprint_of(company: Text, role: Text, locations: Text, season: Text, year: Text, board: Text, job_id: Text) -> Column:
    """SHA-256 over normal forms (company and role given as such); null without company, role or year. Places count in sorted order."""
    places = F.array_join(F.array_sort(F.transform(col(locations), normalized)), "|")
    blank = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    both = col(board).isNotNull() & col(job_id).isNotNull()
    material = F.concat_ws("\x1f", col(company), col(role), F.coalesce(places, F.lit("")), blank(season), blank(year), F.when(both, blank(board)).otherwise(""), F.when(both, blank(job_id)).otherwise(""))
    return F.when((col(company) != "") & (col(role) != "") & col(year).isNotNull(), F.sha2(material, 256))


def fingerprint(company: Text, role: Text, locations: Text, season: Text, year: Text, board: Text, job_id: Text) -> Column:
    """As `fingerprint_of`, from company and role as they are written."""
    return fingerprint_of(company_form(company), role_form(role), locations, season, year, board, job_id)


# --- vocabulary (P1-P5, F11-F16, F25) ---


def in_us(place: Text) -> Column:
    p = col(place)
    named = F.regexp_like(p, F.lit(word(rf"united states|u\.?s\.?a?\.?|remote[- ]?us|us[- ]?remote|{STATES}")))
    # A dotted form ends before a letter only where a word limit lies: after its last letter.
    return named | F.regexp_like(p, F.lit(rf"(?i)(?<=[A-Za-z0-9_]),\s?(?:{STATE_CODES}){AFTER}"))


def geography(locations: Text) -> Column:
    """allowed (a place in the US), rejected (all elsewhere) or ambiguous."""
    places = col(locations)
    elsewhere = F.forall(places, lambda p: F.regexp_like(p, F.lit(word(ELSEWHERE))))
    return F.when(F.coalesce(F.size(places), F.lit(0)) < 1, "ambiguous").when(F.exists(places, in_us), "allowed").when(elsewhere, "rejected").otherwise("ambiguous")


def review_reasons(company: Text, role: Text, url: Text, locations: Text, confidence: Text, least: float = 0.85, where: Column | None = None) -> Column:
    """where: the places' geography, if the plan has it already."""
    unclear = (F.coalesce(F.size(col(locations)), F.lit(0)) > 0) & ((geography(locations) if where is None else where) == "ambiguous")
    tests = (("missing_company", col(company).isNull()), ("missing_role", col(role).isNull()), ("missing_application_url", col(url).isNull()), ("ambiguous_geography", unclear), ("low_confidence", col(confidence) < least))
    return named_of(*(F.when(t, F.lit(name)) for name, t in tests))


def relevance(text: Text, has_job_url: Column, has_url: Column) -> Column:
    """struct(disposition, reason)."""
    has = lambda pattern: F.coalesce(F.regexp_like(col(text), F.lit(word(pattern))), F.lit(False))
    opening, applies = has(OPPORTUNITY), has(APPLICATION) | has_job_url
    outcomes = (
        (has(SENIOR) & ~opening, "irrelevant", "excluded_role_type"),
        (has(NOISE) & ~opening & ~applies, "irrelevant", "event_noise"),
        (~opening & ~applies & has_url, "irrelevant", "non_job_url_only"),
        (~opening & ~applies, "irrelevant", "no_opportunity_signal"),
        (opening & applies, "relevant", "role_and_application_signal"),
    )
    pair = lambda d, r: F.struct(F.lit(d).alias("disposition"), F.lit(r).alias("reason"))
    return reduce(lambda other, o: F.when(o[0], pair(*o[1:])).otherwise(other), reversed(outcomes), pair("ambiguous", "partial_opportunity_signal"))


def season_of(text: Text, low: Column | None = None) -> Column:
    """low: a lower-case text that holds this one, if the plan has it; the patterns are sought only where it has their words."""
    return F.coalesce(*(F.when(says(low, *names.split("|")) & F.regexp_like(col(text), F.lit(word(f"(?:{names})(?:20[0-9]{{2}})?"))), F.lit(season)) for season, names in SEASONS))


def year_beside(text: Text, low: Column | None = None) -> Column:
    """A year next to a season."""
    at = found(text, rf"(?i){BEFORE}(?:spring|summer|fall|autumn|winter)[\s-]*(20[0-9]{{2}}){AFTER}", 1).cast("int")
    return F.when(says(low, *(n for _, names in SEASONS for n in names.split("|"))), at)


def year_alone(text: Text) -> Column:
    """The first 20xx that isn't part of a longer number, nor said to be a number (№ 2030) and no year."""
    return found(text, r"(?<![0-9])(20[0-9]{2})(?![0-9])(?<![#№] ?20[0-9]{2})", 1).cast("int")


def year_of(text: Text) -> Column:
    """A year next to a season, else the first 20xx that isn't part of a longer number."""
    return F.coalesce(year_beside(text), year_alone(text))


def unaddressed(text: Text) -> Column:
    """The text without its web addresses."""
    return F.regexp_replace(col(text), r"(?i)https?://[^\s<>\"']+", " ")


def context_hint(path: Text) -> Column:
    """An off-season file speaks of 2026 and takes no season from its surroundings."""
    return F.when(F.regexp_like(F.coalesce(col(path), F.lit("")), F.lit("(?i)offseason")), "2026").otherwise("")


def posted_at(text: Text, captured: Text) -> Column:
    """'Mon D' in the year of capture, or the year before if that lies over 31 days ahead. Days beyond the month roll over."""
    pattern = rf"(?i){BEFORE}({'|'.join(MONTHS)})[a-z]*\s+([0-9]{{1,2}}){AFTER}"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(col(text), pattern, 1))).cast("int")
    day = F.regexp_extract(col(text), pattern, 2).try_cast("int")
    at = lambda y: F.to_timestamp(F.date_add(F.make_date(y, month, F.lit(1)), day - 1))
    year = F.year(col(captured))
    late = at(year) > col(captured) + F.expr("INTERVAL 31 DAYS")
    return F.when(month > 0, F.when(late, at(year - 1)).otherwise(at(year)))


def sponsorship(text: Text) -> Column:
    return F.when(F.contains(col(text), F.lit(CITIZENS)), "us_citizenship_required").when(F.contains(col(text), F.lit(NO_SPONSOR)), "does_not_offer").otherwise("unknown")


def employment_type(text: Text, low: Column | None = None) -> Column:
    """low: as for `season_of`."""
    has = lambda pattern, *words: says(low, *words) & F.regexp_like(col(text), F.lit(word(pattern)))
    return F.when(has("co[- ]?op", "op"), "co_op").when(has("intern(?:ship)?", "intern"), "internship").when(has("new[- ]?grad|early[- ]?career", "grad", "career"), "new_grad")


def work_mode(locations: Text, text: Text) -> Column:
    everything = F.lower(F.concat_ws("\n", F.coalesce(col(locations), F.array().cast("array<string>")), F.coalesce(col(text), F.lit(""))))
    has = lambda pattern: F.regexp_like(everything, F.lit(word(pattern)))
    return F.when(has("hybrid"), "Hybrid").when(has("remote|telecommut(?:e|ing)|work from home|wfh|remote[- ]?(?:us|usa|united states)"), "Remote").when(has("on[ -]?site|in[ -]?office"), "On-site")


# --- labels and excerpts (F6, F24, F26, F27, F36, T5) ---

EMPLOYMENT = (("internship", "Internship", 1, "internship-feed"), ("co_op", "Co-op", 2, "co-op-feed"), ("new_grad", "New Grad", 3, "new-grad-feed"))


def _employment(kind: Text, field: int, other) -> Column:
    return reduce(lambda rest, e: F.when(col(kind) == e[0], F.lit(e[field])).otherwise(rest), reversed(EMPLOYMENT), F.lit(other))


def employment_label(kind: Text) -> Column:
    return _employment(kind, 1, "Uncategorized")


def employment_order(kind: Text) -> Column:
    return _employment(kind, 2, 99)


def feed_key(kind: Text) -> Column:
    return _employment(kind, 3, "uncategorized-feed")


def humanized(slug: Text) -> Column:
    """Dashes and humps as spaces, each word with a capital; the rest of a word stays as it is."""
    humps = spaced(F.regexp_replace(F.regexp_replace(col(slug), "[-_]+", " "), "([a-z])([A-Z])", "$1 $2"))
    # A word may start within a run as well, after a character that is no ASCII letter, digit or underscore.
    starts = F.regexp_extract_all(humps, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(starts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def clipped(text: Text, length: int) -> Column:
    """At most `length` characters, the last an ellipsis if something is cut."""
    return F.when(F.length(col(text)) <= length, col(text)).otherwise(F.concat(F.rtrim(F.substring(col(text), 1, length - 1)), F.lit("…")))


def one_line(text: Text, length: int = 180) -> Column:
    """The first sentence without the lead-in 'about the role', or null."""
    body = F.regexp_replace(spaced(text), r"(?i)^(?:about the role|about this role|the role)\s*[:\-–]?\s*", "")
    return clipped(F.nullif(F.trim(F.coalesce(found(body, r"^(.+?[.!?])(?:\s|$)", 1), body)), F.lit("")), length)


def date_label(at: Text) -> Column:
    return F.date_format(col(at), "MMM d, yyyy")


def season_year(season: Text, year: Text) -> Column:
    s, y = col(season), col(year).cast("string")
    return F.when(s.isNotNull() & y.isNotNull(), F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)), F.lit(" "), y)).otherwise(F.coalesce(s, y))


def sponsorship_label(status: Text) -> Column:
    s = col(status)
    return F.when(s == "does_not_offer", "Does not offer").when(s == "us_citizenship_required", "US citizenship required").when(s == "offers", "Offers sponsorship").when(s != "unknown", s)
