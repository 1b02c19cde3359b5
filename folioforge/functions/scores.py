"""Scores of records and pairs of records, as columns; weights are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import blank, first_author, normalize_isbn, trim

# Fields that count one point each for survival.
SURVIVAL_FIELDS = ["title", "year", "publisher", "journal", "volume", "issue", "pages", "doi", "isbn", "url", "notes"]


def _d(x: float) -> Column:
    return F.lit(float(x))


def _if(test: Column, weight: float) -> Column:
    return F.when(test, _d(weight)).otherwise(_d(0))


def has_items(c: str) -> Column:
    return F.coalesce(F.size(F.col(c)), F.lit(0)) > 0


def _quality_tests() -> list[tuple[Column, float, str]]:
    # Weights and reasons.
    return [
        (~blank("title"), 0.2, "has title"), (has_items("authors"), 0.15, "has authors"), (~blank("year"), 0.15, "has year"),
        (~blank("doi") | ~blank("isbn"), 0.2, "has persistent identifier"), (~blank("publisher") | ~blank("journal"), 0.1, "has source venue"), (~blank("notes"), 0.1, "has notes"),
    ]


def quality_score() -> Column:
    total = _d(0.2)
    for test, weight, _ in _quality_tests():
        total = total + _if(test, weight)
    return F.round(F.least(_d(1), F.greatest(_d(0), total)), 3)


def quality_reason() -> Column:
    return F.concat_ws(", ", *[F.when(test, reason) for test, _, reason in _quality_tests()])


def survival_score() -> Column:
    total = F.least(_d(2), F.when(has_items("authors"), F.size("authors")).otherwise(0) * _d(0.5))
    for f in SURVIVAL_FIELDS:
        total = total + _if(~blank(f), 1)
    return total + _if(~blank("zotero_item_key"), 1.5) + _if(trim("origin_provider") == "zotero", 0.5)


def citation_issues(citation: Column) -> Column:
    return F.array_compact(F.array(F.when(F.coalesce("title", F.lit("")) == "", "Missing title"), F.when(F.coalesce("year", F.lit("")) == "", "Missing year"), F.when(citation == "", "Empty citation output")))


def duplicate_signal(similarity: Column, left: str = "l_", right: str = "r_") -> Column:
    """struct(likely, score, title_similarity, reasons) of a pair whose fields carry the prefixes."""

    def same(f) -> Column:
        a, b = f(left), f(right)
        return (a != "") & (a == b)

    year = same(lambda p: trim(f"{p}year"))
    # Weights and reasons.
    parts = [
        (same(lambda p: trim(F.lower(f"{p}doi"))), 1.0, "same DOI"), (same(lambda p: normalize_isbn(f"{p}isbn")), 1.0, "same ISBN"), (same(lambda p: trim(f"{p}zotero_item_key")), 1.0, "same Zotero key"),
        (similarity >= 0.97, 0.7, "very similar title"), ((similarity >= 0.9) & (similarity < 0.97), 0.45, "similar title"), (year, 0.2, "same year"), (same(lambda p: first_author(f"{p}authors")), 0.2, "same first author"),
    ]
    total = _d(0)
    for test, weight, _ in parts:
        total = total + _if(test, weight)
    likely = (total >= 0.8) | ((similarity >= 0.9) & year)
    return F.struct(likely.alias("likely"), F.round(F.least(_d(1), total), 3).alias("score"), F.round(similarity, 3).alias("title_similarity"), F.array_compact(F.array(*[F.when(t, r) for t, _, r in parts])).alias("reasons"))
