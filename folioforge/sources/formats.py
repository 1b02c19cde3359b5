"""Pasted bibliographic formats to candidate records: BibTeX and RIS."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import extract_year, first_said, normalize_isbn, trim
from folioforge.schemas import CANDIDATE

_EMPTY = {f.name: ([] if f.name == "authors" else "") for f in CANDIDATE}
_WS = " \t\n\r\x0b\x00"
_YEAR = re.compile(r"\b(19|20)\d{2}\b")
_ENTRY = re.compile(r"@(\w+)\s*\{.*?\}", re.DOTALL)
_KEY = re.compile(r"(\w+)\s*=\s*")


def _isbn(text: str) -> str:
    return re.sub(r"[^0-9Xx]", "", text)


def _said(*values: str) -> str:
    return next((v for v in values if v and v != "0"), "")


def _value(text: str, at: int) -> int | None:
    """End of the braced or quoted value that begins at a position; nothing if it does not close."""
    if text[at : at + 1] == '"':
        m = re.compile(r'"(?:\\.|[^"])*"', re.DOTALL).match(text, at)
        return m.end() if m else None
    if text[at : at + 1] != "{":
        return None
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if depth == 0:
            return k + 1
    return None


def bibtex_fields(text: str) -> dict[str, str]:
    """Braced and quoted fields of the whole text, later ones of a name overwriting earlier ones."""
    fields, at = {}, 0
    while m := _KEY.search(text, at):
        end = _value(text, m.end())
        if end is None:
            at = m.end()
            continue
        fields[m[1].lower()] = html.unescape(text[m.end() : end].strip(_WS).strip('{}"' + _WS))
        at = end
    return fields


def parse_bibtex(text: str | None) -> dict | None:
    """The first entry's kind with the fields of the whole text; nothing without an entry."""
    entry = _ENTRY.search(text or "")
    if not entry:
        return None
    f = bibtex_fields(text)
    kind = entry[1].lower()
    year = f.get("year", "")
    names = [n.strip(_WS) for n in re.split(r"\s+and\s+", f.get("author", ""), flags=re.IGNORECASE)]
    found = {
        "type": kind if kind in ("article", "inproceedings", "book", "misc") else "other", "title": f.get("title", ""), "authors": [n for n in names if n], "year": m[0] if (m := _YEAR.search(year)) else year,
        "publisher": f.get("publisher", ""), "journal": _said(f.get("journal", ""), f.get("booktitle", "")), "volume": f.get("volume", ""), "issue": _said(f.get("number", ""), f.get("issue", "")),
        "pages": f.get("pages", ""), "doi": f.get("doi", ""), "isbn": _isbn(f.get("isbn", "")), "url": f.get("url", ""),
    }
    return _EMPTY | found


#: The same line for columns.
_RIS_LINE = r"(?U)^\s*([A-Z0-9]{2})\s*-\s*(.*)\s*$"
_TAG = re.compile(r"^\s*([A-Z0-9]{2})\s*-\s*(.*)\s*$")
# Kinds of records by tag.
RIS_TYPES = {"book": "book", "jour": "article", "jfull": "article", "video": "video"}


def parse_ris(text: str | None) -> dict | None:
    """Tagged lines to a record; nothing without one."""
    tags: dict[str, list[str]] = {}
    for line in re.split(r"\r\n|[\n\x0b\f\r\x85\u2028\u2029]", text or ""):
        if m := _TAG.match(line):
            tags.setdefault(m[1], []).append(m[2].strip(_WS))
    if not tags:
        return None
    first = lambda *names: _said(*[tags.get(n, [""])[0] for n in names])
    year = _YEAR.search(first("PY", "Y1"))
    last = tags.get("EP", [""])[0]
    found = {
        "type": RIS_TYPES.get(tags.get("TY", [""])[0].lower(), "other"), "title": first("TI", "T1"), "authors": [a for a in tags.get("AU", []) + tags.get("A1", []) if a not in ("", "0")], "year": year[0] if year else "",
        "publisher": first("PB", "CY"), "journal": first("JO", "T2"), "volume": tags.get("VL", [""])[0], "issue": tags.get("IS", [""])[0], "pages": tags.get("SP", [""])[0] + (f"-{last}" if last else ""),
        "doi": first("DO", "M3"), "isbn": _isbn(tags.get("SN", [""])[0]), "url": first("UR", "L1"),
    }
    return _EMPTY | found


def ris_record(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the record of the tagged lines of a column, by columns; NULL without one. The same as parse_ris()."""
    tagged = F.transform(F.split(F.col(column), r"\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"), lambda x: F.struct(F.regexp_extract(x, _RIS_LINE, 1).alias("tag"), trim(F.regexp_extract(x, _RIS_LINE, 2)).alias("value")))
    lines = df.withColumn("_tagged", F.filter(tagged, lambda x: x["tag"] != ""))
    every = lambda name: F.transform(F.filter("_tagged", lambda x: x["tag"] == name), lambda x: x["value"])
    one = lambda name: F.coalesce(F.get(every(name), 0), F.lit(""))
    kind, own = F.lower(one("TY")), F.lit("other")
    for name, known in RIS_TYPES.items():
        own = F.when(kind == name, known).otherwise(own)
    fields = {
        "type": own, "title": first_said(one("TI"), one("T1")), "authors": F.filter(F.concat(every("AU"), every("A1")), lambda x: ~x.isin("", "0")), "year": extract_year(first_said(one("PY"), one("Y1"))),
        "publisher": first_said(one("PB"), one("CY")), "journal": first_said(one("JO"), one("T2")), "volume": one("VL"), "issue": one("IS"), "pages": F.concat(one("SP"), F.when(one("EP") != "", F.concat(F.lit("-"), one("EP"))).otherwise("")),
        "doi": first_said(one("DO"), one("M3")), "isbn": normalize_isbn(one("SN")), "url": first_said(one("UR"), one("L1")),
    }
    return lines.withColumn(out, F.when(F.size("_tagged") > 0, F.struct(*[v.alias(k) for k, v in fields.items()]))).drop("_tagged")


def _records(parse):
    @F.pandas_udf(CANDIDATE)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [parse(t) or dict.fromkeys(_EMPTY) for t in texts]
        return pd.DataFrame(rows, columns=list(_EMPTY))

    return run


bibtex_udf = _records(parse_bibtex)
