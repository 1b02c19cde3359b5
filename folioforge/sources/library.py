"""Records of a remote reference library: items to records and back, collections to projects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import extract_year, falsy_null, first_said, normalize_isbn, trim
from folioforge.schemas import REMOTE_ITEM

# Kinds of items.
ITEM_TYPES = {"journalarticle": "article", "conferencepaper": "article", "book": "book", "booksection": "book", "videorecording": "video", "film": "video"}
TRANSLATED_TYPES = {"journalArticle": "article", "conferencePaper": "article", "magazineArticle": "article", "newspaperArticle": "article", "preprint": "article", "book": "book", "bookSection": "book", "thesis": "other", "report": "other", "webpage": "website", "blogPost": "website", "videoRecording": "video"}
REMOTE_TYPES = {"article": "journalArticle", "book": "book", "video": "videoRecording"}


def _cases(c: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def parse_item(text: str | Column) -> Column:
    return F.from_json(text, REMOTE_ITEM)


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def item_record(item: str) -> Column:
    """Record of an item; creators of all roles, 'Last, First' with its comma even without a first name."""
    i, d = F.col(item), F.col(item)["data"]
    name = lambda c: trim(F.coalesce(falsy_null(c["name"]), trim(F.concat(_or_empty(c["lastName"]), F.lit(", "), _or_empty(c["firstName"])))))
    authors = F.filter(F.transform(F.filter(F.coalesce(d["creators"], F.array()), lambda c: c.isNotNull()), name), lambda x: x != "")
    fields = {
        "type": _cases(F.lower(_or_empty(d["itemType"])), ITEM_TYPES, "other"), "title": _or_empty(d["title"]), "authors": authors, "year": extract_year(d["date"]),
        "publisher": first_said(d["publisher"], d["libraryCatalog"]), "journal": first_said(d["publicationTitle"], d["bookTitle"]), "volume": _or_empty(d["volume"]), "issue": _or_empty(d["issue"]), "pages": _or_empty(d["pages"]),
        "doi": _or_empty(d["DOI"]), "isbn": normalize_isbn(d["ISBN"]), "url": _or_empty(d["url"]), "accessed_at": _or_empty(d["accessDate"]), "notes": trim(F.concat(F.lit("Imported from Zotero. "), _or_empty(d["extra"]))),
        "origin_provider": F.lit("zotero"), "origin_external_id": _or_empty(i["key"]), "zotero_item_key": _or_empty(i["key"]), "zotero_version": i["version"], "project_external_keys": F.coalesce(d["collections"], F.array().cast("array<string>")),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def translated_authors(creators: Column) -> Column:
    """Authors only, 'Last, First' without a loose comma, single names as they are."""
    kept = F.filter(creators, lambda c: F.coalesce(c["creatorType"], F.lit("author")).isin("", "author"))
    first, last = (lambda c: trim(c["firstName"])), (lambda c: trim(c["lastName"]))
    name = lambda c: F.when((last(c) != "") | (first(c) != ""), F.btrim(F.concat(last(c), F.when(first(c) != "", F.concat(F.lit(", "), first(c))).otherwise("")), F.lit(" \t,"))).otherwise(trim(c["name"]))
    return F.filter(F.transform(kept, name), lambda x: x != "")


def is_weak_stub(record: Column) -> Column:
    """Nothing but a title of a page."""
    empty = [trim(record[f]) == "" for f in ("year", "publisher", "notes", "doi", "isbn")]
    test = F.coalesce(F.size(record["authors"]), F.lit(0)) <= 0
    for e in empty:
        test = test & e
    return test & F.lower(_or_empty(record["type"])).isin("website", "", "other")


def remote_payload(collections: Column) -> Column:
    """Item data to send of a record's columns; only construction, nothing is sent."""
    names = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), trim), lambda x: x != "")
    split = lambda a: F.split(a, ",", 2)
    creators = F.transform(names, lambda a: F.struct(F.lit("author").alias("creatorType"), F.when(a.contains(","), trim(F.try_element_at(split(a), F.lit(2)))).alias("firstName"), F.when(a.contains(","), trim(F.try_element_at(split(a), F.lit(1)))).alias("lastName"), F.when(~a.contains(","), a).alias("name")))
    kind = _cases(F.lower(_or_empty(F.col("type"))), REMOTE_TYPES, "document")
    only = lambda test, c: F.when(test, _or_empty(F.col(c)))
    article, book, video = kind == "journalArticle", kind == "book", kind == "videoRecording"
    fields = {
        "itemType": kind, "title": _or_empty(F.col("title")), "creators": creators, "date": _or_empty(F.col("year")), "url": _or_empty(F.col("url")), "accessDate": _or_empty(F.col("accessed_at")),
        "collections": F.array_distinct(F.filter(collections, lambda x: ~x.isin("", "0"))), "publicationTitle": only(article, "journal"), "volume": only(article, "volume"), "issue": only(article, "issue"), "pages": only(article, "pages"),
        "DOI": only(article, "doi"), "publisher": only(article | book, "publisher"), "ISBN": only(book, "isbn"), "numPages": only(book, "pages"), "studio": only(video, "publisher"),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def collection_project(key: Column, name: Column, parent: Column) -> Column:
    """Project of a collection, named by its key where it has no name."""
    return F.struct(F.when(trim(name) != "", trim(name)).otherwise(F.concat(F.lit("Collection "), trim(key))).alias("name"), F.lit("zotero").alias("external_provider"), trim(key).alias("external_id"), trim(parent).alias("parent_collection"))
