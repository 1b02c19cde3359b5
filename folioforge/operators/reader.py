"""The reader's bookkeeping around a synthesis: dossiers, queries, candidates, grounding, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import trim

EXCERPT, REFRESH_DAYS, PREVIEW, MOST_QUERIES, MOST_CANDIDATES = 4000, 30, 180, 4, 5
# Verdicts and texts of the notes of caution.
VERDICTS = ("read", "skim", "ignore")
DOWNGRADED = "Grounding validation downgraded confidence; review evidence before full read."
EMPTY_REASON = "Not enough grounded evidence to make a stronger recommendation."


def dossier() -> Column:
    """What a synthesis is given of a record."""
    return F.struct(*["id", "type", "title", "authors", "year", "publisher", "journal", "doi", "isbn", "url", "notes", "provenance_summary", "lookup_trace", "ai_summary", "ai_claims", "ai_methods", "ai_limitations"], F.substring(F.coalesce("body_text", F.lit("")), 1, EXCERPT).alias("body_excerpt"), "body_fetched_at")


def readiness_caution(now: Column) -> Column:
    """No body, or one fetched over REFRESH_DAYS ago; NULL if there is nothing to say. A missing date is not stale."""
    label = F.when(trim("title") != "", trim("title")).otherwise(F.concat(F.lit("source #"), F.col("id").cast("string")))
    empty = trim(F.substring(F.coalesce("body_text", F.lit("")), 1, EXCERPT)) == ""
    stale = F.col("body_fetched_at") < now - F.make_dt_interval(F.lit(REFRESH_DAYS))
    return F.when(empty, F.concat(F.lit("No body text cached for "), label, F.lit("; synthesis may rely mostly on metadata."))).when(stale, F.concat(F.lit("Cached body text is stale for "), label, F.lit("; consider refreshing source text.")))


def queries(context: Column, titles: Column) -> Column:
    """The context, then each title alone and with the context; distinct without regard to case, at most four."""
    c = trim(context)
    parts = F.flatten(F.transform(F.filter(F.transform(titles, trim), lambda t: t != ""), lambda t: F.when(c != "", F.array(t, F.concat(c, F.lit(" "), t))).otherwise(F.array(t))))
    every = F.concat(F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>")), parts)
    lowered = F.transform(every, F.lower)
    first = F.filter(F.transform(every, lambda q, i: F.when(F.array_position(lowered, F.lower(q)) == i + 1, q)), lambda q: q.isNotNull())
    return F.slice(first, 1, MOST_QUERIES)


def candidate_key(url: Column, title: Column, year: Column) -> Column:
    u, t = F.lower(trim(url)), F.lower(trim(title))
    return F.when(u != "", F.concat(F.lit("url:"), u)).when(t != "", F.concat(F.lit("title:"), t, F.lit("|"), trim(year))).otherwise("")


def candidate_url(url: Column, doi: Column) -> Column:
    return F.when(trim(url) != "", trim(url)).when(trim(doi) != "", F.concat(F.lit("https://doi.org/"), trim(doi))).otherwise("")


def ground(syntheses: DataFrame, valid: str = "valid_ids", column: str = "synthesis") -> DataFrame:
    """The synthesis with references cut to valid ids: ungrounded claims and evidence dropped and counted, read lowered to skim.

    valid is an array column of ids. Claims without a valid id stay if an outside candidate has an address.
    """
    s = F.col(column)
    ids = lambda xs: F.filter(F.coalesce(xs, F.array().cast("array<bigint>")), lambda i: (i > 0) & F.array_contains(F.col(valid), i))
    outside = F.exists(F.coalesce(s["external_candidates"], F.array()), lambda c: trim(c["url"]) != "")
    claims = F.transform(F.coalesce(s["claims"], F.array()), lambda c: F.struct(c["text"].alias("text"), ids(c["source_ids"]).alias("source_ids"), c["strength"].alias("strength"), (F.coalesce(F.size(c["source_ids"]), F.lit(0)) > 0).alias("had")))
    bad_claims = F.size(F.filter(claims, lambda c: (F.size(c["source_ids"]) == 0) & (c["had"] | ~outside)))
    kept_claims = F.transform(F.filter(claims, lambda c: (F.size(c["source_ids"]) > 0) | outside), lambda c: F.struct(c["text"].alias("text"), c["source_ids"].alias("source_ids"), c["strength"].alias("strength")))
    evidence = F.coalesce(s["evidence"], F.array())
    good_evidence = F.filter(evidence, lambda e: F.coalesce((e["source_id"] > 0) & F.array_contains(F.col(valid), e["source_id"]), F.lit(False)))
    bad_evidence = F.size(evidence) - F.size(good_evidence)
    verdict = F.when(s["verdict"].isin(*VERDICTS), s["verdict"]).otherwise("skim")
    lowered = (bad_claims + bad_evidence > 0) & (verdict == "read")
    notes = F.array_compact(F.array(F.when(bad_claims > 0, F.concat(bad_claims.cast("string"), F.lit(" claim reference(s) were dropped because they could not be grounded to selected sources."))), F.when(bad_evidence > 0, F.concat(bad_evidence.cast("string"), F.lit(" evidence reference(s) were dropped due to invalid source ids.")))))
    return syntheses.withColumns({
        "verdict": F.when(lowered, "skim").otherwise(verdict), "verdict_reason": F.when(lowered, DOWNGRADED).otherwise(trim(F.coalesce(s["verdict_reason"], F.lit(EMPTY_REASON)))), "claims": kept_claims, "evidence": good_evidence,
        "bad_claims": bad_claims, "bad_evidence": bad_evidence, "cautions": F.concat(F.coalesce(s["cautions"], F.array().cast("array<string>")), notes),
        "connections": F.transform(F.coalesce(s["connections"], F.array()), lambda c: F.struct(ids(c["source_ids"]).alias("source_ids"), c["relation"].alias("relation"), c["note"].alias("note"))),
    })


def synthesis_sources(column: str = "reader_synthesis") -> Column:
    """Distinct positive ids that a synthesis refers to, in order of mention."""
    s = F.col(column)
    empty = F.array().cast("array<bigint>")
    claims = F.flatten(F.transform(F.coalesce(s["claims"], F.array()), lambda c: F.coalesce(c["source_ids"], empty)))
    evidence = F.transform(F.coalesce(s["evidence"], F.array()), lambda e: e["source_id"])
    links = F.flatten(F.transform(F.coalesce(s["connections"], F.array()), lambda c: F.coalesce(c["source_ids"], empty)))
    return F.array_distinct(F.filter(F.concat(claims, evidence, links), lambda i: i > 0))


def history(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest syntheses with verdict and preview; broken JSON counts as empty; the limit is between 1 and 50."""
    get = lambda path: F.try_variant_get(F.try_parse_json("output_json"), path, "string")
    preview = F.substring(trim(F.coalesce(get("$.synthesis.why_now"), get("$.synthesis.verdict_reason"))), 1, PREVIEW)
    rows = runs.filter(F.col("run_type") == "reader_synthesis").select("id", "created_at", F.coalesce(get("$.synthesis.verdict"), F.lit("skim")).alias("verdict"), preview.alias("preview"))
    return rows.distinct().orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(50, limit)))
