"""Citations in three styles, as one column expression each; a style's parts are NULL where empty and concat_ws leaves them out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import rtrim_dots, safe_url, trim

# Kinds of records folded to four.
TYPES = {"article": ["article", "journalarticle", "conferencepaper", "inproceedings", "preprint", "report"], "book": ["book", "monograph"], "video": ["video", "film", "movie", "podcast"], "website": ["website", "webpage", "blogpost", "blog-post"]}
# Particles of family names.
PARTICLES = ["da", "de", "del", "della", "der", "di", "du", "la", "le", "st.", "st", "van", "von"]
_FAMILY = r"(?i)^(?:(.*?)\s)??((?:(?:" + "|".join(p.replace(".", r"\.") for p in PARTICLES) + r")\s)*\S+)$"
# Styles and their labels.
STYLES = {"apa": "APA", "mla": "MLA", "chicago18": "Chicago 18"}


def said(c: Column) -> Column:
    return F.when(c != "", c)


def authors_of(column: str = "authors") -> Column:
    return F.filter(F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), trim), lambda x: ~x.isin("", "0"))


def joined(names: Column, before_last: str) -> Column:
    n = F.size(names)
    many = F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(before_last), F.try_element_at(names, F.lit(-1)))
    return F.when(n == 0, "").when(n == 1, F.try_element_at(names, F.lit(1))).otherwise(many)


def sentence(c: Column) -> Column:
    text = trim(c)
    return F.when(text == "", "").otherwise(F.concat(rtrim_dots(text), F.lit(".")))


def trim_title(c: Column) -> Column:
    return trim(rtrim_dots(c))


def fold_type(column: str = "type") -> Column:
    kind = F.lower(trim(column))
    out = F.when(kind == "", "other")
    for name, kinds in TYPES.items():
        out = out.when(kind.isin(kinds), name)
    return out.otherwise(kind)


def invert_name(author: Column) -> Column:
    """Family name first, particles with it; names that hold a comma stay."""
    squeezed = trim(F.regexp_replace(author, r"(?U)\s+", " "))
    given, family = F.regexp_extract(squeezed, _FAMILY, 1), F.regexp_extract(squeezed, _FAMILY, 2)
    return F.when(author.contains(",") | (family == ""), author).when(given == "", family).otherwise(F.concat(family, F.lit(", "), given))


def chicago_authors(column: str = "authors") -> Column:
    names = authors_of(column)
    turned = F.when(F.size(names) > 0, F.concat(F.array(invert_name(F.try_element_at(names, F.lit(1)))), F.slice(names, 2, 1_000_000))).otherwise(names)
    return joined(turned, ", and ")


def identifier_link(doi: str = "doi", url: str = "url") -> Column:
    bare = F.ltrim(F.regexp_replace(trim(doi), r"(?i)^(https?://)?(dx\.)?doi\.org/", ""))
    bare = F.regexp_replace(bare, "^/+", "")
    link = safe_url(url)
    return F.when(trim(doi) != "", sentence(F.concat(F.lit("https://doi.org/"), bare))).when(link != "", sentence(link)).otherwise("")


def accessed_line(column: str = "accessed_at") -> Column:
    """Dates as year-month-day (with a time or without) or day.month.year are written out; any other text stands as it is."""
    raw = trim(column)
    date = F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")), F.try_to_timestamp(raw, F.lit("dd.MM.yyyy")), F.try_to_timestamp(F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), raw)))
    return F.when(raw == "", "").otherwise(sentence(F.concat(F.lit("Accessed "), F.coalesce(F.date_format(date, "MMMM d, yyyy"), raw))))


def _pages(include_pages: bool) -> Column:
    return trim("pages") if include_pages else F.lit("")


def _after(prefix: str, c: Column, suffix: str = "") -> Column:
    """The text with its frame, or '' if empty."""
    return F.when(c == "", "").otherwise(F.concat(F.lit(prefix), c, F.lit(suffix)))


def _line(*parts: Column) -> Column:
    return trim(F.concat_ws(" ", *[said(p) for p in parts]))


def apa(include_pages: bool = True) -> Column:
    title, journal = trim("title"), trim("journal")
    in_journal = F.concat(journal, _after(", ", trim("volume")), _after("(", trim("issue"), ")"), _after(", ", _pages(include_pages)), F.lit("."))
    return _line(
        _after("", joined(authors_of(), ", & "), "."),
        _after("(", trim("year"), ")."),
        F.when(F.lower(trim("type")) == "video", _after("", title, " [Video].")).otherwise(_after("", title, ".")),
        F.when(journal != "", in_journal).otherwise(_after("", trim("publisher"), ".")),
        F.when(trim("doi") != "", _after("https://doi.org/", trim("doi"))).otherwise(trim("url")),
    )


def mla(include_pages: bool = True) -> Column:
    journal = trim("journal")
    in_journal = F.concat(journal, _after(", vol. ", trim("volume")), _after(", no. ", trim("issue")), _after(", ", trim("year")), _after(", pp. ", _pages(include_pages)), F.lit("."))
    imprint = _line(_after("", trim("publisher"), ","), _after("", trim("year"), "."))
    return _line(
        _after("", joined(authors_of(), ", and "), "."),
        _after('"', trim("title"), '."'),
        F.when(journal != "", in_journal).otherwise(imprint),
        F.when(trim("doi") != "", _after("doi:", trim("doi"), ".")).otherwise(_after("", trim("url"), ".")),
    )


def chicago18(include_pages: bool = True) -> Column:
    kind, title, journal = fold_type(), trim("title"), trim("journal")
    article = (kind == "article") | (journal != "")
    website = (kind == "website") | (~article & (trim("url") != "") & ~kind.isin("book", "video"))
    quoted = _after('"', trim_title(title), '."')
    imprint = F.concat_ws(", ", said(trim("publisher")), said(trim("year")))
    volume = trim("volume")
    in_journal = F.concat(journal, F.when((journal != "") & (volume != ""), " ").otherwise(""), volume, _after(", no. ", trim("issue")), _after(" (", trim("year"), ")"), _after(": ", _pages(include_pages)))
    venue = (
        F.when(article, sentence(F.when(in_journal == "", imprint).otherwise(in_journal)))
        .when(website, _line(sentence(F.concat_ws(", ", F.coalesce(said(journal), said(trim("publisher"))), said(trim("year")))), accessed_line()))
        .otherwise(sentence(imprint))
    )
    return _line(
        sentence(chicago_authors()),
        F.when(article | website, quoted).otherwise(sentence(trim_title(title))),
        F.when(kind == "video", "Video.").otherwise(""),
        venue,
        identifier_link(),
    )


FORMATTERS: dict[str, Callable[[bool], Column]] = {"apa": apa, "mla": mla, "chicago18": chicago18}


def normalize_style(c: str | Column) -> Column:
    text = F.lower(trim(c))
    return F.when(text.isin("chicago", "chicago18"), "chicago18").when(text.isin(*STYLES), text).otherwise("apa")


def citation(style: str, include_pages: bool = True) -> Column:
    return FORMATTERS["chicago18" if style == "chicago" else style](include_pages)


def citation_cache(include_pages: bool = True) -> Column:
    parts = [(s, FORMATTERS[s](include_pages)) for s in STYLES] + [("chicago", chicago18(include_pages))]
    return F.create_map(*[x for s, c in parts for x in (F.lit(s), c)])


def is_on(c: str | Column, case_sensitive: bool = False) -> Column:
    """Whether a stored setting is on: anything but 0, false, no and off."""
    text = trim(c)
    return ~(text if case_sensitive else F.lower(text)).isin("0", "false", "no", "off")
