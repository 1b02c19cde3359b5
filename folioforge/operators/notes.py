"""Notes on spans of text: clean projection, overlaps, re-anchoring, insertion, highlight pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.markup import realign_udf
from folioforge.functions.text import trim

SCOPES = ("body", "reading_guide")
BIN = 1024


def clean_note(df: DataFrame) -> DataFrame:
    """Offsets at least 0, scope one of two, labels trimmed without blanks, ids positive; repeats in lists stay once."""
    labels = F.array_distinct(F.filter(F.transform(F.coalesce("tag_labels", F.array().cast("array<string>")), trim), lambda x: ~x.isin("", "0")))
    ids = F.array_distinct(F.filter(F.coalesce("project_ids", F.array().cast("array<bigint>")), lambda x: x > 0))
    return df.select(
        "id", "source_id", F.when(F.col("note_scope").isin(*SCOPES), F.col("note_scope")).otherwise("body").alias("note_scope"), F.coalesce("quote_text", F.lit("")).alias("quote_text"),
        F.greatest(F.lit(0), F.coalesce("start_offset", F.lit(0))).alias("start_offset"), F.greatest(F.lit(0), F.coalesce("end_offset", F.lit(0))).alias("end_offset"), F.coalesce("note_text", F.lit("")).alias("note_text"),
        labels.alias("tag_labels"), ids.alias("project_ids"), "created_at", "updated_at",
    )


def _spans(df: DataFrame, p: str) -> DataFrame:
    """Spans that are none of length 0, a row for each bin of the text they touch."""
    spans = df.filter(F.col("end_offset") > F.col("start_offset")).select("source_id", "note_scope", (F.col("id") if "id" in df.columns else F.lit(None)).alias(f"{p}_id"), F.col("start_offset").alias(f"{p}_start"), F.col("end_offset").alias(f"{p}_end"))
    return spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / BIN), F.floor((F.col(f"{p}_end") - 1) / BIN))))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_id, b_id, source_id, note_scope of spans that overlap (touching ones do not), a_id < b_id.

    Spans are dealt into bins of the text, so that a source with very many notes is joined piece by piece; a pair
    is reported in the bin where the later of its two begins.
    """

    pairs = _spans(a, "a").join(_spans(b, "b"), ["source_id", "note_scope", "bin"])
    meets = (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start")) & (F.col("a_id") < F.col("b_id"))
    return pairs.filter(meets & (F.col("bin") == F.floor(F.greatest("a_start", "b_start") / BIN))).select("a_id", "b_id", "source_id", "note_scope")


def realigned(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """id, source_id, status (ok, fixed, lost, skipped), new_start, new_end of the notes on bodies; a missing source is skipped."""
    body = notes.filter(F.col("note_scope") == "body").join(sources.select(F.col("id").alias("source_id"), "body_text"), "source_id", "left")
    done = body.withColumn("r", realign_udf("body_text", "start_offset", "end_offset", "quote_text"))
    return done.select("id", "source_id", "r.status", "r.new_start", "r.new_end")


def insertable(new: DataFrame, sources: DataFrame, existing: DataFrame) -> DataFrame:
    """New notes with a reason each why it cannot be stored, or '': source, scope, range, texts, overlap with a stored note of another id.

    Spans meet in bins of the text, as in overlaps().
    """
    known = sources.select(F.col("id").alias("source_id"), F.length(F.coalesce("body_text", F.lit(""))).alias("size"))
    hit = _spans(new, "a").join(_spans(existing, "b"), ["source_id", "note_scope", "bin"]).filter("a_start < b_end and a_end > b_start and not a_id <=> b_id")
    hit = hit.select(F.col("a_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    rows = new.join(known, "source_id", "left").join(hit, "id", "left")
    reason = (
        F.when(F.col("size").isNull(), "source not found")
        .when(~F.col("note_scope").isin(*SCOPES), "invalid scope")
        .when(F.col("end_offset") <= F.col("start_offset"), "invalid range")
        .when((F.col("note_scope") == "body") & (F.col("end_offset") > F.col("size")), "range exceeds text")
        .when((trim("quote_text") == "") | (trim("note_text") == ""), "texts required")
        .when(F.col("hit"), "overlaps")
        .otherwise("")
    )
    return rows.withColumn("reason", reason).drop("size", "hit")


def pieces(text: Column, spans: Column) -> Column:
    """The text cut at the bounds of spans (structs of start_offset, end_offset): array of (start, end, text, highlighted)."""
    n = F.length(text)
    clip = lambda x: F.least(F.greatest(x, F.lit(0)), n)
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n), F.flatten(F.transform(spans, lambda s: F.array(clip(s["start_offset"]), clip(s["end_offset"])))))))
    cut = F.transform(F.slice(edges, F.lit(1), F.greatest(F.size(edges) - 1, F.lit(0))), lambda a, i: F.struct(a.alias("a"), F.get(edges, i + 1).alias("b")))
    return F.transform(cut, lambda p: F.struct(p["a"].alias("start"), p["b"].alias("end"), F.substring(text, p["a"] + 1, p["b"] - p["a"]).alias("text"), F.exists(spans, lambda s: (s["start_offset"] <= p["a"]) & (s["end_offset"] >= p["b"])).alias("highlighted")))
