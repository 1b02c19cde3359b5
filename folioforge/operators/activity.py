"""Work sessions, tickets and month grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import trim, valid_month

# Kinds of sessions and bounds.
SESSION_TYPES = ("work", "short_break", "long_break")
MIN_SECONDS, MAX_SECONDS, CYCLE = 30, 14_400, 4


def session_type(c: str = "type") -> Column:
    kind = F.lower(trim(c))
    return F.when(kind.isin(*SESSION_TYPES), kind).otherwise("work")


def session_seconds(c: str = "duration_sec") -> Column:
    return F.least(F.greatest(F.col(c), F.lit(MIN_SECONDS)), F.lit(MAX_SECONDS))


def session_notes(c: str = "notes", most: int = 20_000) -> Column:
    """Line ends folded, at most so many bytes (a character cut in two goes), trailing white space off."""
    text = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\r\n|\r", "\n")
    short = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    return F.regexp_replace(F.when(F.octet_length(text) > most, F.regexp_replace(short, "�+$", "")).otherwise(text), r"[ \t\n\r\x0B\x00]+\z", "")


def day_stats(sessions: DataFrame, now: Column) -> DataFrame:
    """completed_count, focused_minutes, abandoned_count of the work sessions since the day began; the day is the session zone's."""
    today = sessions.filter(F.col("started_at") >= F.date_trunc("day", now))
    work = F.col("type") == "work"
    return today.agg(
        F.count(F.when(F.col("completed") & work, 1)).alias("completed_count"),
        F.round(F.coalesce(F.sum(F.when(F.col("completed") & work, F.col("duration_sec"))), F.lit(0)) / 60).cast("int").alias("focused_minutes"),
        F.count(F.when(F.col("abandoned") & work, 1)).alias("abandoned_count"),
    )


def cycle_replay(sessions: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """id, cycle_index after each session and the phase that follows: completed work counts up, a completed long break resets.

    Running sums over all sessions in two levels, within days and over the days' totals, so that only one row a day
    passes through a single task.
    """
    kind = session_type()
    rows = sessions.select("id", "started_at", F.to_date("started_at").alias("day"), kind.alias("kind"), (F.col("completed") & (kind == "work")).cast("int").alias("w"), (F.col("completed") & (kind == "long_break")).alias("reset"))
    within = Window.partitionBy("day").orderBy("started_at", "id")
    rows = rows.withColumn("w_day", F.sum("w").over(within))
    rows = rows.withColumn("r_day", F.max(F.when(F.col("reset"), F.col("w_day"))).over(within))
    days = rows.groupBy("day").agg(F.sum("w").alias("total"), F.max(F.when(F.col("reset"), F.col("w_day"))).alias("last"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("w_before", F.coalesce(F.sum("total").over(before), F.lit(0)))
    days = days.withColumn("r_before", F.coalesce(F.max(F.col("w_before") + F.col("last")).over(before), F.lit(0))).select("day", "w_before", "r_before")
    done = rows.join(days, "day").withColumn("at", F.col("w_before") + F.col("w_day")).withColumn("base", F.coalesce(F.col("w_before") + F.col("r_day"), F.col("r_before")))
    index = F.col("at") - F.col("base")
    follows = F.when(F.col("w") == 1, F.when(index >= cycle, "long_break").otherwise("short_break")).otherwise("idle")
    return done.select("id", index.cast("int").alias("cycle_index"), follows.alias("next_phase"))


def nest(parents: DataFrame, items: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Parents with their items as an ordered array of structs, empty where there are none."""
    listed = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("items"))
    joined = parents.join(listed, key, "left")
    return joined.withColumn("items", F.coalesce("items", F.array().cast(listed.schema["items"].dataType)))


def month_add(month: Column, n: Column | int) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), n), "yyyy-MM")


def month_spine(start: Column, months: Column) -> Column:
    first = F.to_date(F.concat(start, F.lit("-01")))
    return F.transform(F.sequence(first, F.add_months(first, months - 1), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))


def window_months(raw: Column) -> Column:
    number = F.coalesce(F.regexp_extract(raw.cast("string"), r"^\s*[+-]?\d+", 0).try_cast("bigint"), F.lit(0))
    return F.least(F.greatest(number, F.lit(12)), F.lit(60)).cast("int")


def normalize_filled(filled: DataFrame, rows: DataFrame) -> DataFrame:
    """row_id, months: valid months, distinct and sorted, of rows that exist and have any. filled: row_id, months; rows: id."""
    months = F.array_sort(F.array_distinct(F.filter("months", valid_month)))
    kept = filled.join(rows.select(F.col("id").alias("row_id")).distinct(), "row_id", "left_semi")
    return kept.select("row_id", months.alias("months")).filter(F.size("months") > 0)


def normalize_rows(saved: DataFrame, defaults: DataFrame) -> DataFrame:
    """Saved rows (pos, id, section, label, tooltip) whole and first of their id, missing default rows after the last of their section."""
    whole = saved.select("pos", *[trim(c).alias(c) for c in ("id", "section", "label", "tooltip")]).filter((F.col("id") != "") & (F.col("section") != "") & (F.col("label") != ""))
    first = whole.groupBy("id").agg(F.min(F.struct("pos", "section", "label", "tooltip")).alias("r")).select("id", "r.*")
    tips = defaults.select("id", F.col("tooltip").alias("tip"))
    kept = first.join(tips, "id", "left").select("id", "section", "label", F.coalesce(F.when(F.col("tooltip") != "", F.col("tooltip")), "tip", F.lit("")).alias("tooltip"), F.col("pos").cast("double").alias("at"), F.lit(-1).alias("nth"))
    ends = kept.groupBy("section").agg(F.max("at").alias("end"))
    top = kept.agg(F.coalesce(F.max("at"), F.lit(-1.0)).alias("top"))
    missing = defaults.join(kept.select("id"), "id", "left_anti").join(ends, "section", "left").crossJoin(F.broadcast(top))
    added = missing.select("id", "section", "label", F.coalesce("tooltip", F.lit("")).alias("tooltip"), F.coalesce(F.col("end"), F.col("top") + 1).alias("at"), F.col("pos").cast("int").alias("nth"))
    return kept.unionByName(added)


def toggle_month(months: Column, month: Column) -> Column:
    return F.when(F.array_contains(months, month), F.array_remove(months, month)).otherwise(F.array_sort(F.array_append(months, month)))


def section_breaks(rows: DataFrame, order: str = "at") -> DataFrame:
    """Whether a row opens a section: it differs from the row before. rows are a document's, few."""
    w = Window.partitionBy(*(["document_id"] if "document_id" in rows.columns else [F.lit(0)])).orderBy(order)
    return rows.withColumn("opens", ~F.col("section").eqNullSafe(F.lag("section").over(w)))
