"""Whether extracted metadata can be trusted: confidence, consistency of titles and authors, grounding on the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import col, first_said, significant_words, trim

# Prefixes and fragments of model names, and the order of preference.
CHAT_PREFIXES = ("gpt-", "o1", "o3", "o4")
CHAT_EXCLUDES = ("audio", "transcribe", "tts", "whisper", "embedding", "moderation", "image", "vision", "realtime", "search", "omni-moderation")
PREFERRED = ["gpt-5", "gpt-5-latest", "gpt-4.1", "gpt-4.1-latest", "o3", "gpt-4o", "o4-mini", "gpt-4o-mini"]
FAMILY_SCORES = [("gpt-5", 1000), ("gpt-4.1", 900), ("o3", 850), ("gpt-4o", 800), ("o4", 760), ("o1", 700), ("gpt-4", 650)]
PENALTIES = [("mini", 120), ("nano", 220), ("preview", 20)]


def low_confidence(record: Column, raw: Column) -> Column:
    """No identifier and no title with year; or a title without any longer word of an input that holds no identifier."""
    bare = (trim(record["isbn"]) == "") & (trim(record["doi"]) == "") & ~((trim(record["title"]) != "") & (trim(record["year"]) != ""))
    words = F.filter(F.split(F.lower(trim(raw)), r"\W+"), lambda w: F.octet_length(w) > 3)
    title = F.lower(trim(record["title"]))
    strange = (F.coalesce(raw, F.lit("")) != "") & ~F.coalesce(raw, F.lit("")).rlike(r"\b(?:10\.\d{4,9}/|97[89]\d{10})\b") & (F.size(words) > 0) & ~F.exists(words, lambda w: title.contains(w))
    return record.isNull() | bare | strange


def titles_consistent(a: str | Column, b: str | Column, authors_match: Column) -> Column:
    x, y = F.lower(trim(a)), F.lower(trim(b))
    wx, wy = significant_words(a), significant_words(b)
    n = F.size(F.array_intersect(wx, wy))
    return (x == "") | (y == "") | x.contains(y) | y.contains(x) | (n >= 2) | ((n == 1) & ((F.size(wx) == 1) | (F.size(wy) == 1) | authors_match))


def authors_consistent(a: str | Column, b: str | Column) -> Column:
    x, y = F.coalesce(col(a), F.array().cast("array<string>")), F.coalesce(col(b), F.array().cast("array<string>"))
    parts = F.filter(F.flatten(F.transform(x, lambda n: F.split(F.lower(trim(n)), r"(?U)\W+"))), lambda p: F.octet_length(p) > 2)
    blob = F.lower(F.array_join(y, " "))
    return (F.size(x) == 0) | (F.size(y) == 0) | (F.size(parts) == 0) | F.exists(parts, lambda p: blob.contains(p))


def isbn_answer_matches(title: Column, authors: Column, answer_title: Column, answer_authors: Column) -> Column:
    said = (trim(title) != "") | (F.size(authors) > 0)
    agree = authors_consistent(authors, answer_authors)
    titles = (trim(title) == "") | (trim(answer_title) == "") | titles_consistent(title, answer_title, agree)
    return said & titles & ((F.size(authors) == 0) | (F.size(answer_authors) == 0) | agree)


def grounded(record: Column, page: Column) -> Column:
    """The record without identifiers that the page does not hold; NULL if nothing of it is on the page. Short pages prove nothing."""
    text = F.lower(F.coalesce(page, F.lit("")))
    digits = F.regexp_replace(text, "[^0-9Xx]", "")
    doi, isbn = trim(record["doi"]), F.regexp_replace(F.coalesce(record["isbn"], F.lit("")), "[^0-9Xx]", "")
    has_doi, has_isbn = (doi != "") & text.contains(F.lower(doi)), (F.length(isbn) >= 10) & digits.contains(isbn)
    words = F.filter(F.split(F.lower(trim(record["title"])), r"(?U)\W+"), lambda w: F.length(w) > 4)
    has_title = (trim(record["title"]) != "") & ((F.size(words) == 0) | F.exists(words, lambda w: text.contains(w)))
    surname = lambda a: F.try_element_at(F.split(F.lower(trim(F.substring_index(a, ",", 1))), r"\s+"), F.lit(-1))
    has_author = F.exists(F.coalesce(record["authors"], F.array().cast("array<string>")), lambda a: (F.length(surname(a)) >= 3) & text.contains(surname(a)))
    short = F.octet_length(trim(text)) < 200
    cleaned = record.withField("doi", F.when(short | has_doi, record["doi"]).otherwise("")).withField("isbn", F.when(short | has_isbn, record["isbn"]).otherwise(""))
    return F.when(short | has_doi | has_isbn | has_title | has_author, cleaned)


def merge_candidates(primary: Column, secondary: Column, url: Column) -> Column:
    """Field by field the first that says something; authors from the first that has any."""
    names = ("title", "year", "publisher", "journal", "volume", "issue", "pages", "doi", "isbn", "notes")
    out = {n: first_said(primary[n], secondary[n]) for n in names}
    out["type"] = F.when(F.coalesce(primary["type"], F.lit("")).isin("", "0"), F.coalesce(secondary["type"], F.lit("website"))).otherwise(primary["type"])
    out["url"] = F.when(F.coalesce(primary["url"], F.lit("")).isin("", "0"), F.coalesce(secondary["url"], url)).otherwise(primary["url"])
    empty = F.array().cast("array<string>")
    out["authors"] = F.when(F.coalesce(F.size(primary["authors"]), F.lit(0)) > 0, primary["authors"]).otherwise(F.coalesce(secondary["authors"], empty))
    order = ("type", "title", "authors", "year", "publisher", "journal", "volume", "issue", "pages", "doi", "isbn", "url", "notes")
    return F.struct(*[out[n].alias(n) for n in order])


def trace_summary(kind: Column, trace: Column) -> Column:
    """By which step an input was resolved: the last successful one."""
    name = F.when(trim(kind) != "", F.upper(trim(kind)))
    won = F.coalesce(F.try_element_at(F.filter(F.coalesce(trace, F.array()), lambda t: t["status"] == "success"), F.lit(-1))["step"], F.lit(""))
    return (
        F.when(won != "", F.concat(F.coalesce(name, F.lit("INPUT")), F.lit(" resolved via "), won, F.lit(".")))
        .when(F.coalesce(F.size(trace), F.lit(0)) > 0, F.concat(F.coalesce(name, F.lit("INPUT")), F.lit(" parsed with partial/low-confidence metadata.")))
        .otherwise(F.coalesce(F.concat(name, F.lit(" parsed.")), F.lit("Parsed.")))
    )


def is_chat_model(name: Column) -> Column:
    n = F.lower(trim(name))
    known = F.lit(False)
    for p in CHAT_PREFIXES:
        known = known | n.startswith(p)
    for x in CHAT_EXCLUDES:
        known = known & ~n.contains(x)
    return known


def model_rank(name: Column) -> Column:
    """Sorts names: the preferred ones in order, then families less their penalties; the smallest is recommended."""
    n = F.lower(trim(name))
    place = F.array_position(F.array(*[F.lit(p) for p in PREFERRED]), n)
    score = F.lit(500)
    for prefix, points in reversed(FAMILY_SCORES):
        score = F.when(n.startswith(prefix), points).otherwise(score)
    for part, points in PENALTIES:
        score = score - F.when(n.contains(part), points).otherwise(0)
    return F.when(place > 0, F.struct(F.lit(0).alias("group"), place.cast("int").alias("at"))).otherwise(F.struct(F.lit(1).alias("group"), (-score).cast("int").alias("at")))
