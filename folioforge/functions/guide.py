"""Reading guides: missing sections appended, sections split, natural order of names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import trim

# The sections of a guide.
SECTIONS = ("Key claims", "Methods / approach", "Limitations")


def complete_guide(summary: Column, *lists: Column) -> Column:
    """The summary with a headed list for each section that it lacks and that has items."""
    raw = F.coalesce(summary, F.lit(""))
    text = F.when(trim(raw) == "", "").otherwise(F.regexp_replace(raw, r"[ \t\n\r\x0B\x00]+\z", ""))
    for title, items in zip(SECTIONS, lists, strict=True):
        clean = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), trim), lambda x: x != "")
        bullets = F.array_join(F.transform(clean, lambda x: F.concat(F.lit("- "), F.regexp_replace(x, r"(?U)\s+", " "))), "\n\n")
        there = text.rlike(rf"(?i)(^|\n)\s{{0,3}}#{{2,6}}\s+{re.escape(title)}\s*(\n|$)")
        text = F.when(there | (F.size(clean) == 0), text).otherwise(F.concat(text, F.lit(f"\n\n## {title}\n\n"), bullets))
    return text


def natural_key(c: Column) -> Column:
    """Sorts names by their letters, capitals alike, and runs of digits by value."""
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 20, "0")).otherwise(x))
