"""Scalar functions on text, as columns: trimming, normal forms, identifiers, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank, tab, line feed, return, vertical tab and NUL: what trimming removes.
WS = " \t\n\r\x0b\x00"
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: str | Column) -> Column:
    return F.btrim(F.coalesce(col(c), F.lit("")), F.lit(WS))


def rtrim_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\n\r\x0B\x00.]+\z", "")


def blank(c: str | Column) -> Column:
    return trim(c) == ""


def falsy_null(c: str | Column) -> Column:
    """NULL for a null, an empty text or '0', so that coalesce takes the first that says something."""
    return F.when(~F.coalesce(col(c), F.lit("")).isin("", "0"), col(c))


def first_said(*columns: str | Column) -> Column:
    return F.coalesce(*[falsy_null(c) for c in columns], F.lit(""))


def norm_text(c: str | Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(trim(c)), "[^a-z0-9]+", " "))


def first_author(c: str | Column) -> Column:
    return F.when(F.size(col(c)) > 0, norm_text(F.try_element_at(col(c), F.lit(1)))).otherwise("")


def normalize_isbn(c: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^0-9Xx]", "")


def extract_doi(c: str | Column) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), DOI, 0)


def extract_year(c: str | Column) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"\b(19|20)\d{2}\b", 0)


def extract_year_wide(c: str | Column) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"\b(1\d{3}|20\d{2}|2100)\b", 0)


def significant_words(c: str | Column) -> Column:
    """Distinct words of four bytes and more, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(trim(c)), r"(?U)\W+"), lambda w: F.octet_length(w) >= 4))


def fingerprint(doi: str, isbn: str, title: str, authors: str, year: str) -> Column:
    joined = F.concat_ws("|", trim(doi), trim(isbn), trim(title), trim(F.try_element_at(F.coalesce(col(authors), F.array().cast("array<string>")), F.lit(1))), trim(year))
    return F.translate(joined, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def looks_like_bibtex(c: str | Column) -> Column:
    return col(c).rlike(r"@\w+\s*\{") & F.lower(col(c)).contains("title")


def looks_like_ris(c: str | Column) -> Column:
    return col(c).rlike(r"(?m)^\s*TY\s*-\s*")


def classify_input(c: str | Column) -> Column:
    """bibtex, ris, doi, isbn, url or text; an identifier counts anywhere in the text and before addresses."""
    text = trim(c)
    return (
        F.when(looks_like_bibtex(text), "bibtex")
        .when(looks_like_ris(text), "ris")
        .when(text.rlike(DOI), "doi")
        .when(normalize_isbn(text).rlike(r"^(97[89])?\d{9}[\dXx]$"), "isbn")
        .when(text.rlike(r"(?i)^[a-z][a-z0-9+.-]*://\S+$"), "url")
        .otherwise("text")
    )


def safe_url(c: str | Column) -> Column:
    text = trim(c)
    return F.when(F.lower(F.try_parse_url(text, F.lit("PROTOCOL"))).isin("http", "https"), text).otherwise("")


def is_video_host(c: str | Column) -> Column:
    host = F.lower(F.coalesce(F.try_parse_url(col(c), F.lit("HOST")), F.lit("")))
    return host.contains("youtube.com") | host.contains("youtu.be")


def html_to_text(c: str | Column, limit: int) -> Column:
    """Tags off, white space collapsed, at most limit characters (the reader's excerpt)."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]*>", ""), r"\s+", " ")
    return F.substring(trim(plain), 1, limit)


def split_list(c: str | Column) -> Column:
    """The entries of a comma list, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), trim), lambda x: x != "")


def choose_isbn(numbers: str | Column) -> Column:
    """Of a list of book numbers as found the first that has thirteen digits, else the first that has ten, else ''."""
    bare = F.transform(F.coalesce(col(numbers), F.array().cast("array<string>")), lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9Xx]", ""))
    first = lambda n: F.get(F.filter(bare, lambda x: F.length(x) == n), 0)
    return F.coalesce(first(13), first(10), F.lit(""))


def is_stale(c: str | Column, days: int, now: Column) -> Column:
    moment = F.try_to_timestamp(trim(c))
    return moment.isNull() | (moment < now - F.make_dt_interval(F.lit(days)))


def valid_month(c: str | Column) -> Column:
    return col(c).rlike(r"^\d{4}-(0[1-9]|1[0-2])$")


def ticket_date(c: str | Column) -> Column:
    """A text of the shape of a date, else NULL; the calendar is not asked."""
    text = trim(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)


def free_text_query(c: str | Column) -> Column:
    """A request stripped of its polite frame: eight patterns, repeated until nothing changes.

    A round that changes anything takes out a word at least, so as many rounds as the text has words reach the fixpoint; rounds after it cost a comparison.
    """
    start = F.btrim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))

    def strip(text: Column) -> Column:
        for p in REQUEST_FRAMES:
            text = F.regexp_replace(text, p, "")
        return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))

    first = F.struct(start.alias("text"), F.lit(False).alias("done"))
    step = lambda s, _: F.when(s["done"], s).otherwise(F.struct(strip(s["text"]).alias("text"), (strip(s["text"]) == s["text"]).alias("done")))
    return F.aggregate(F.sequence(F.lit(0), F.size(F.split(start, " "))), first, step)["text"]


# The frames of requests for citations.
REQUEST_FRAMES = [
    r"(?iU)^\s*(?:please\s+)?(?:i\s+need|i\s+want|i'd\s+like|i\s+am\s+looking\s+for|looking\s+for|help\s+me\s+(?:with|write))(?:\s+please)?\s+(?:to\s+)?(?:get|have|obtain|find|write|build|make|create|format)?\s+(?:a|an|the|my)?\s+",
    r"(?iU)^\s*(?:can|could)\s+you\s+(?:please\s+)?(?:give|provide|send|format|write|get)\s+me\s+(?:a|an|the|my)?\s*",
    r"(?iU)\b(?:chicago|apa|mla|harvard|ieee|turabian)\s*(?:manual\s+of\s+style|manual|style|edition)?\s*(?:\d{1,4})?\s*(?:citation|reference|bibliography|bibliographic\s+entry)\s+for\s+(?:a|an|the)?\s*",
    r"(?iU)\b(?:chicago|apa|mla)\s+\d{2,4}\s+citation\s+for\s+(?:a|an|the)?\s*",
    r"(?iU)\b(?:citation|reference|bibliography)\s+for\s+(?:a|an|the)?\s*",
    r"(?iU)\s+the\s+movie\s*$",
    r"(?iU)\s+the\s+film\s*$",
    r"(?iU)\s+a\s+film\s*$",
]


def html_escape(c: str | Column) -> Column:
    out = col(c)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def clock(seconds: str | Column) -> Column:
    """Minutes and seconds of a countdown, begun seconds counted whole."""
    whole = F.greatest(F.lit(0), F.ceil(col(seconds))).cast("int")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("int"), whole % 60)


def etag(name: str | Column, size: str | Column, modified: str | Column) -> Column:
    return F.substring(F.md5(F.concat(col(name), F.lit("|"), col(size).cast("string"), F.lit("|"), col(modified).cast("string"))), 1, 16)
