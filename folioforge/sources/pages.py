"""Web pages: meta tags, title, text, numbers, and one record of them in order of trust."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.text import col, extract_year, first_said, html_to_text, is_video_host, normalize_isbn, trim

PAGE_TEXT_LIMIT, READER_TEXT_LIMIT = 12_000, 20_000


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html.unescape(x))


def _pattern(attribute: str, name: str) -> str:
    quoted = "".join("\\" + c if c in ".:-_" and c != "_" else c for c in name)
    return rf"""(?i)<meta[^>]*{attribute}\s*=\s*["']{quoted}["'][^>]*content\s*=\s*["']([^"']+)["'][^>]*>"""


def meta(page: str | Column, attribute: str, name: str) -> Column:
    """Content of the first such tag; name must come before content; '' if there is none."""
    return unescape(trim(F.regexp_extract(F.coalesce(col(page), F.lit("")), _pattern(attribute, name), 1)))


def meta_all(page: str | Column, attribute: str, name: str) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(page), F.lit("")), F.lit(_pattern(attribute, name)), F.lit(1))
    return F.filter(F.transform(found, trim), lambda x: ~x.isin("", "0"))


def title_tag(page: str | Column) -> Column:
    return unescape(trim(F.regexp_extract(F.coalesce(col(page), F.lit("")), r"(?is)<title>(.*?)</title>", 1)))


def page_text(page: str | Column) -> Column:
    return html_to_text(page, PAGE_TEXT_LIMIT)


def isbn13s(page: str | Column) -> Column:
    """Distinct 13-digit book numbers, plain ones first."""
    text = F.coalesce(col(page), F.lit(""))
    plain = F.regexp_extract_all(text, F.lit(r"\b(97[89]\d{10})\b"), F.lit(1))
    dashed = F.transform(F.regexp_extract_all(text, F.lit(r"\b(97[89](?:[- ]\d+){3}[- ]\d)\b"), F.lit(1)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.array_distinct(F.concat(plain, F.filter(dashed, lambda x: F.length(x) == 13)))


def page_record(page: str | Column, url: str | Column) -> Column:
    """Candidate struct of a page: tags for scholars before sharing tags before the name, the title tag last."""
    c = {n: meta(page, "name", f"citation_{n}") for n in ("title", "journal_title", "doi", "volume", "issue", "firstpage", "lastpage", "publisher", "publication_date", "date")}
    scholarly = (c["title"] != "") | (c["journal_title"] != "") | (c["doi"] != "")
    names = meta_all(page, "name", "citation_author")
    author = first_said(meta(page, "name", "author"), meta(page, "property", "article:author"))
    published = first_said(meta(page, "itemprop", "datePublished"), meta(page, "property", "article:published_time"), c["publication_date"], c["date"])
    fields = {
        "type": F.when(is_video_host(url), "video").when(scholarly, "article").otherwise("website"),
        "title": first_said(c["title"], meta(page, "property", "og:title"), meta(page, "name", "title"), title_tag(page)),
        "authors": F.when(F.size(names) > 0, F.transform(names, lambda x: x)).when(author != "", F.array(trim(author))).otherwise(F.array().cast("array<string>")),
        "year": extract_year(published), "publisher": first_said(c["publisher"], meta(page, "property", "og:site_name")), "journal": c["journal_title"], "volume": c["volume"], "issue": c["issue"],
        "pages": F.concat(c["firstpage"], F.when(c["lastpage"] != "", F.concat(F.lit("-"), c["lastpage"])).otherwise("")),
        "doi": c["doi"], "isbn": normalize_isbn(meta(page, "name", "citation_isbn")), "url": F.coalesce(col(url), F.lit("")), "notes": F.lit(""),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])
