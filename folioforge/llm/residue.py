"""Template residue and error-page text.

Normalised lines are counted by host over all different texts and those that recur subtracted, whatever they say, but
for the evidence itself: error pages recur as well. A text whose residual holds error, placeholder, filler or
script-required evidence and no text beside it is residue. A title is residue if it is nothing else. Real texts that
speak of such things keep a residual of their own and stay.

Scale: lines are counted by a hash, with partial counts before the shuffle, so that a host that holds a third of all
records only adds partial counts. Only the lines of texts with evidence, a few in a hundred, meet the recurrent ones.

Defined cases: null or blank texts and titles are no residue; a repeated record is found as often as its id is
distinct (ids once); extra columns are ignored; very long texts are read whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.webtext import _SEPARATED, FURNISHING, evidence, host_of, is_content, is_notice_title, line_key, recurrent_lines, shape
from folioforge.runtime import cut, join_small, table

_SITE = re.compile(r"\s+(?:[-–—|:])\s+(?:[A-Z][\w’'&.]*\s*){1,4}$")


def title_is_residue(title: str | None) -> bool:
    """The whole title, or what remains beside a site's name."""
    bare = (title or "").strip()
    if not bare:
        return False
    forms = {bare, _SITE.sub("", bare)}
    if " | " in bare:
        forms.update(bare.split(" | "))
    for form in forms:
        kind = evidence(form)
        if kind and (kind != "filler" or len(form.split()) <= 12) and (kind != "notice" or is_notice_title(shape(form))):
            return True
    return bool(re.fullmatch(r"(?:test|asdf|qwerty|title|xxx+|tbd|todo)[\W\d]*", shape(bare)))


def body_lines(text: str | None) -> list[tuple[str, str]]:
    """The non-blank lines of a text that holds evidence, each with its kind: evidence, prose, furniture, or other; none of a text without evidence."""
    lines = [bare for line in (text or "").split("\n") if (bare := line.strip())]
    told = [bool(evidence(x)) for x in lines]
    if not any(told):
        return []

    def kind(line: str) -> str:
        if is_content(line):
            return "prose"
        return "other" if len(line.split()) >= 5 and not _SEPARATED.search(line) and not FURNISHING.search(line) else "furniture"

    return [("evidence" if e else kind(x), x) for e, x in zip(told, lines, strict=True)]


_SCHEMA = pa.schema([("source_id", pa.int64()), ("host", pa.string()), ("kind", pa.string()), ("line", pa.string())])


def _lines(batches):
    for batch in batches:
        out: list[tuple] = []
        for i, title, host, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if title_is_residue(title):
                out.append((i, host, "title", None))
            out.extend((i, host, kind, x) for kind, x in body_lines(text) if kind != "furniture")
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, _SCHEMA, strict=True)], schema=_SCHEMA)


def residue(sources: DataFrame) -> DataFrame:
    """source_id, part ('title' or 'body') of each residue."""
    recurrent = cut(recurrent_lines(sources.filter(F.trim("body_text") != "")))
    rows = cut(sources.select(F.col("id").cast("long").alias("source_id"), "title", host_of(F.col("url")).alias("host"), "body_text").mapInArrow(_lines, "source_id long, host string, kind string, line string"))
    text = rows.filter(F.col("kind").isin("prose", "other")).select("source_id", "host", line_key(F.col("line")).alias("key")).distinct()
    asked = text.withColumn("at", F.explode(F.array("host", F.lit("*"))))
    met = join_small(asked, recurrent.select(F.col("host").alias("at"), "key", F.lit(1).alias("known")), ["at", "key"])
    residual = met.groupBy("source_id", "key").agg(F.max("known").alias("known")).filter("known is null").select("source_id").distinct()
    bodies = rows.filter(F.col("kind") == "evidence").select("source_id").distinct().join(residual, "source_id", "left_anti")
    titles = rows.filter(F.col("kind") == "title").select("source_id").distinct()
    return bodies.select("source_id", F.lit("body").alias("part")).unionByName(titles.select("source_id", F.lit("title").alias("part")))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return residue(table(spark, directory, "sources")).select("source_id").distinct()


QUERIES = {"p7_found": p7_found}
SQL: dict[str, str] = {}
