"""Stored answers of catalogues and indexes (JSON lines) to candidate records, and the order in which they are believed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import extract_doi, extract_year, extract_year_wide, first_said, normalize_isbn, trim

_NAMES = ("type", "title", "authors", "year", "publisher", "journal", "volume", "issue", "pages", "doi", "isbn", "url", "notes")


def _candidate(**fields: Column) -> Column:
    empty = {n: (F.array().cast("array<string>") if n == "authors" else F.lit("")) for n in _NAMES}
    return F.struct(*[F.coalesce(c, empty[n]).alias(n) for n, c in (empty | fields).items()])


def _names(c: Column) -> Column:
    return F.filter(c, lambda x: x != "")


def _first(c: Column) -> Column:
    return F.try_element_at(c, F.lit(1))


CROSSREF = "message struct<title:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>,publisher:string,`container-title`:array<string>,volume:string,issue:string,page:string,DOI:string,URL:string>"


def crossref(answer: str) -> Column:
    m = F.from_json(answer, CROSSREF)["message"]
    names = _names(F.transform(m["author"], lambda a: F.btrim(F.concat(trim(a["family"]), F.lit(", "), trim(a["given"])), F.lit(" ,"))))
    year = _first(_first(m["issued"]["date-parts"])).cast("string")
    return _candidate(type=F.lit("article"), title=first_said(_first(m["title"])), authors=names, year=year, publisher=m["publisher"], journal=first_said(_first(m["container-title"])), volume=m["volume"], issue=m["issue"], pages=m["page"], doi=m["DOI"], url=m["URL"])


OPENALEX = "title string, type string, doi string, publication_year string, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<landing_page_url:string,source:struct<display_name:string,host_organization_name:string>>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>"
# Kinds of works.
OPENALEX_TYPES = {"book": "book", "book-chapter": "book", "monograph": "book", "dissertation": "other"}


def openalex(answer: str) -> Column:
    w = F.from_json(answer, OPENALEX)
    first, last = trim(w["biblio"]["first_page"]), trim(w["biblio"]["last_page"])
    kind = F.lower(F.coalesce(w["type"], F.lit("")))
    mapped = F.lit("article")
    for name, own in OPENALEX_TYPES.items():
        mapped = F.when(kind == name, own).otherwise(mapped)
    place = w["primary_location"]
    return _candidate(type=mapped, title=w["title"], authors=_names(F.transform(w["authorships"], lambda a: trim(a["author"]["display_name"]))), year=w["publication_year"], publisher=place["source"]["host_organization_name"], journal=place["source"]["display_name"], volume=trim(w["biblio"]["volume"]), issue=trim(w["biblio"]["issue"]), pages=F.concat(first, F.when((last != "") & (last != first), F.concat(F.lit("-"), last)).otherwise("")), doi=extract_doi(w["doi"]), url=place["landing_page_url"])


SCHOLAR = "title string, year string, venue string, authors array<struct<name:string>>, journal struct<name:string,volume:string,pages:string>, publicationVenue struct<publisher:string>, externalIds struct<DOI:string>"


def semantic_scholar(answer: str) -> Column:
    p = F.from_json(answer, SCHOLAR)
    journal = trim(p["journal"]["name"])
    return _candidate(type=F.lit("article"), title=trim(p["title"]), authors=_names(F.transform(p["authors"], lambda a: trim(a["name"]))), year=p["year"], publisher=trim(p["publicationVenue"]["publisher"]), journal=F.when(journal != "", journal).otherwise(trim(p["venue"])), volume=trim(p["journal"]["volume"]), pages=trim(p["journal"]["pages"]), doi=trim(p["externalIds"]["DOI"]))


OPEN_LIBRARY = "title string, publish_date string, url string, authors array<struct<name:string>>, publishers array<struct<name:string>>"


def open_library(answer: str, isbn: str | Column) -> Column:
    b = F.from_json(answer, OPEN_LIBRARY)
    return _candidate(type=F.lit("book"), title=b["title"], authors=_names(F.transform(b["authors"], lambda a: trim(a["name"]))), year=extract_year_wide(b["publish_date"]), publisher=first_said(_first(b["publishers"])["name"]), isbn=F.col(isbn) if isinstance(isbn, str) else isbn, url=b["url"])


def title_searches(title: Column, author: Column) -> Column:
    """What to ask a library for a title, the strictest first: the exact title with the author, the exact title, the words; nothing for a blank title."""
    t = trim(title)
    exact = F.concat(F.lit('"'), t, F.lit('"'))
    asked = F.when(author != "", F.array(F.concat(exact, F.lit(" "), author), exact, F.concat(t, F.lit(" "), author))).otherwise(F.array(exact, t))
    return F.when(t != "", asked).otherwise(F.array().cast("array<string>"))


CATALOGUE = "pnx struct<display:struct<title:array<string>,type:array<string>,creator:array<string>,creationdate:array<string>,publisher:array<string>,identifier:array<string>>,addata:struct<au:array<string>,date:array<string>,isbn:array<string>,btitle:array<string>,pub:array<string>,doi:array<string>>>"


def library_catalogue(answer: str, url: str) -> Column:
    d = F.from_json(answer, CATALOGUE)["pnx"]
    show, add = d["display"], d["addata"]
    authors = F.array_distinct(_names(F.transform(F.coalesce(add["au"], show["creator"]), lambda a: trim(F.regexp_replace(a, r"\$\$Q.*$", "")))))
    isbn = F.try_element_at(_names(F.transform(F.coalesce(add["isbn"], show["identifier"]), normalize_isbn)), F.lit(1))
    kind = F.when(F.lower(F.coalesce(_first(show["type"]), F.lit("book"))) == "book", "book").otherwise("website")
    return _candidate(type=kind, title=trim(F.coalesce(_first(show["title"]), _first(add["btitle"]))), authors=authors, year=extract_year(first_said(_first(add["date"]), _first(show["creationdate"]))), publisher=trim(first_said(_first(add["pub"]), _first(show["publisher"]))), doi=trim(_first(add["doi"])), isbn=isbn, url=F.col(url), notes=F.lit("Metadata extracted from the catalogue's permalink."))


def believe(df: DataFrame, key: str, providers: list[tuple[str, str]]) -> DataFrame:
    """key, provider, candidate, trace: the first provider in order whose candidate has a title; the trace ends there.

    providers: (name, column of candidate structs); a null candidate is no answer.
    """
    steps, winner, chosen = [], None, None
    for name, c in providers:
        has = trim(F.col(c)["title"]) != ""
        has = F.coalesce(has, F.lit(False))
        step = F.struct(F.lit(name).alias("step"), F.when(has, "success").otherwise("no_result").alias("status"))
        steps.append(step)
        winner = F.when(has, F.lit(name)) if winner is None else F.coalesce(winner, F.when(has, F.lit(name)))
        chosen = F.when(has, F.col(c)) if chosen is None else F.coalesce(chosen, F.when(has, F.col(c)))
    order = F.array(*[F.lit(n) for n, _ in providers])
    upto = F.when(F.col("provider").isNull(), F.lit(len(providers))).otherwise(F.array_position(order, F.col("provider")).cast("int"))
    return df.select(F.col(key), winner.alias("provider"), chosen.alias("candidate"), F.array(*steps).alias("steps")).withColumn("trace", F.slice("steps", F.lit(1), upto)).drop("steps")


def best_titled(query: Column, results: Column) -> Column:
    """Of at most five results the first whose title holds six in ten of the query's longer words, else the first."""
    words = F.filter(F.split(F.lower(query), r"(?U)\W+"), lambda w: F.length(w) > 3)
    need = F.greatest(F.lit(1), F.floor(F.size(words) * 0.6).cast("int"))
    fits = F.filter(results, lambda r: (F.size(words) > 0) & (F.size(F.filter(words, lambda w: F.lower(r["title"]).contains(w))) >= need))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.try_element_at(results, F.lit(1)))
