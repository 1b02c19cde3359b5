"""Changes to stored tables, copy on write: upserts, link sets, cascades, guarded updates, appends.

Every function takes frames and returns the new frame; a caller writes it beside the old and swaps. Repeated keys in
a payload are settled before the join (the last by the order given), so no join multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import trim
from folioforge.operators.dedupe import first_by
from folioforge.runtime import cut


def upsert(existing: DataFrame, changes: DataFrame, key: str | list[str], order: str | None = None) -> DataFrame:
    """Rows of changes in place of those of equal key; of repeated changes the last by order."""
    keys = [key] if isinstance(key, str) else key
    new = first_by(changes, keys, F.desc(order)).drop(order) if order else changes
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def save_records(existing: DataFrame, payload: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Payload fields over stored ones, else the default; fields that the payload leaves NULL keep what is stored."""
    fields = [c for c in existing.columns if c != "id"]
    given = [c for c in fields if c in payload.columns]
    p = payload.select("id", *[F.col(c).alias(f"p_{c}") for c in given])
    both = existing.join(p, "id", "full_outer")
    preset = defaults or {}
    value = {c: [*([F.col(f"p_{c}")] if c in given else []), F.col(c), *([preset[c]] if c in preset else [])] for c in fields}
    return both.select("id", *[F.coalesce(*v).alias(c) for c, v in value.items()]).select(existing.columns)


def replace_links(links: DataFrame, wanted: DataFrame, left: str = "source_id", right: str = "project_id") -> DataFrame:
    """The link sets of the given left ids become their wanted lists: distinct positive ids."""
    right_type = links.schema[right].dataType
    new = wanted.select(left, F.explode(F.array_distinct(F.filter("ids", lambda x: x > 0))).alias(right)).withColumn(right, F.col(right).cast(right_type))
    return links.join(wanted.select(left), left, "left_anti").select(left, right).unionByName(new)


def delete_cascade(gone: DataFrame, parent: DataFrame, children: dict[str, DataFrame], loosened: dict[str, DataFrame], key: str = "source_id") -> dict[str, DataFrame]:
    """Parent and children without the ids of gone (column id); in loosened tables the key becomes NULL."""
    ids = gone.select("id").distinct()
    out = {"parent": parent.join(ids, "id", "left_anti")}
    for name, child in children.items():
        out[name] = child.join(ids.withColumnRenamed("id", key), key, "left_anti").select(child.columns)
    for name, child in loosened.items():
        marked = child.join(ids.select(F.col("id").alias(key), F.lit(True).alias("gone_")), key, "left")
        out[name] = marked.withColumn(key, F.when(F.col("gone_").isNull(), F.col(key))).select(child.columns)
    return out


def get_or_create(existing: DataFrame, wanted: DataFrame, on: str = "external_id") -> DataFrame:
    """id and name of each wanted key; present ones are renamed, new ones numbered after the largest id in order of key.

    New ids are drawn by range-partitioned counts, not in one task.
    """
    wanted = wanted.filter(F.col(on) != "").groupBy(on).agg(F.max("name").alias("name"))
    found = wanted.join(existing.groupBy(on).agg(F.min("id").alias("id")), on, "left")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = found.filter("id is null").select(on, "name")
    ranged = cut(fresh.repartitionByRange(on).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = counts.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(on))
    numbered = ranged.withColumn("own", own).join(F.broadcast(before), "part")
    new = numbered.crossJoin(F.broadcast(top)).select(on, "name", (F.col("top") + F.col("before") + F.col("own")).alias("id"))
    return found.filter("id is not null").select(on, "name", "id").unionByName(new)


def upsert_vectors(existing: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Vectors (id, input_text, embedding) in place of those of equal id; a blank input or an empty vector changes nothing."""
    usable = changes.filter((trim("input_text") != "") & (F.size("embedding") > 0))
    return upsert(existing, usable, "id", order)


def append_log(log: DataFrame, entries: DataFrame, kind: str, payload: list[str]) -> DataFrame:
    """The log with a row an entry (source_id, input_text and the payload columns): numbered after the largest id, payload as JSON."""
    rows = entries.select(F.lit(kind).alias("run_type"), "source_id", "input_text", F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("output_json"), "created_at")
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = rows.withColumn("n", F.monotonically_increasing_id() + 1).crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("n"))
    return log.unionByName(numbered.select(*log.columns))


def start_sessions(sessions: DataFrame, starts: DataFrame, sources: DataFrame) -> DataFrame:
    """Sessions with the started ones (id, task_label, source_id, type, duration_sec, started_at) added, open; a source that does not exist becomes NULL."""
    known = sources.select(F.col("id").alias("source_id"), F.lit(True).alias("known_")).distinct()
    new = starts.join(known, "source_id", "left").withColumn("source_id", F.when(F.col("known_"), F.col("source_id")))
    given = {"completed": F.lit(False), "abandoned": F.lit(False), "notes": F.lit(""), "ended_at": F.lit(None)}
    kinds = dict(sessions.dtypes)
    return sessions.unionByName(new.select(*[(given[c] if c in given else F.col(c)).cast(kinds[c]).alias(c) for c in sessions.columns]))


def autosave_notes(sessions: DataFrame, drafts: DataFrame) -> DataFrame:
    """Notes of open sessions as drafted (id, notes, saved_at; the last counts); ended ones stay as they are."""
    new = first_by(drafts, ["id"], F.desc("saved_at")).select("id", F.col("notes").alias("draft_"))
    joined = sessions.join(new, "id", "left")
    return joined.select(*[F.when(F.col("ended_at").isNull(), F.coalesce("draft_", "notes")).otherwise(F.col("notes")).alias(c) if c == "notes" else F.col(c) for c in sessions.columns])


def toggle_items(items: DataFrame, tickets: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with their done flag as patched (id, done, at; the last counts), and tickets touched at the time of the last patch of an item."""
    last = first_by(patches, ["id"], F.desc("at")).select("id", F.col("done").alias("done_"), F.col("at").alias("at_"))
    joined = items.join(last, "id", "left")
    touched = joined.filter("at_ is not null").groupBy(F.col("ticket_id").alias("id")).agg(F.max("at_").alias("touched_"))
    changed = joined.select(*[F.coalesce("done_", "done").alias(c) if c == "done" else F.col(c) for c in items.columns])
    parents = tickets.join(touched, "id", "left").select(*[F.coalesce("touched_", "updated_at").alias(c) if c == "updated_at" else F.col(c) for c in tickets.columns])
    return changed, parents


def by_name(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted names with the id of the smallest project of that name, capitals or not; NULL where there is none."""
    ids = existing.groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("id"))
    return wanted.withColumn("k", F.lower(trim("name"))).join(ids, "k", "left").drop("k")


def finish_sessions(sessions: DataFrame, finishes: DataFrame, now: Column) -> DataFrame:
    """Open sessions named in finishes (id, abandoned, notes) end now; ended ones stay as they are; NULL notes keep what was saved."""
    f = first_by(finishes, ["id"], F.lit(1)).select("id", F.col("abandoned").alias("f_abandoned"), F.col("notes").alias("f_notes"), F.lit(True).alias("f_"))
    rows = sessions.join(f, "id", "left")
    ends = F.coalesce(F.col("f_"), F.lit(False)) & F.col("ended_at").isNull()
    changed = {"completed": ~F.col("f_abandoned"), "abandoned": F.col("f_abandoned"), "notes": F.coalesce("f_notes", "notes"), "ended_at": now}
    return rows.select(*[F.when(ends, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in sessions.columns])


def fill_defaults(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    return settings.unionByName(defaults.join(settings.select("key"), "key", "left_anti"))


def markdown_mirror() -> Column:
    """A record as a small document."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # The labels, in their order.
    labels = [("Type", "type"), ("Authors", None), ("Year", "year"), ("Journal", "journal"), ("Publisher", "publisher"), ("Volume", "volume"), ("Issue", "issue"), ("Pages", "pages"), ("DOI", "doi"), ("ISBN", "isbn"), ("URL", "url"), ("Accessed At", "accessed_at"), ("Updated", "updated_at")]
    authors = F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", ", "")
    lines = [F.concat(F.lit("# "), F.when(text("title") != "", text("title")).otherwise("Untitled Source")), F.lit(""), F.concat(F.lit("- ID: "), text("id"))]
    lines += [F.concat(F.lit(f"- {label}: "), text(c) if c else authors) for label, c in labels]
    return F.concat_ws("\n", *lines, F.lit(""), F.lit("## Notes"), F.lit(""), text("notes"), F.lit(""), F.lit("## Raw Input"), F.lit(""), text("raw_input"), F.lit(""))


def write_mirrors(df: DataFrame, path: str) -> None:
    """One document a record, as rows of a table by id; a file each would be too many at scale."""
    df.select("id", markdown_mirror().alias("markdown")).write.mode("overwrite").parquet(path)


def staged_names(media: DataFrame) -> DataFrame:
    """archive_path, staged_name of media (path, content): safe names, equal contents of a name staged once, others numbered in order of path."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    stem = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]*$", "")
    safe = F.btrim(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    rows = media.select("path", F.when(safe == "", "image").otherwise(safe).alias("base"), extension.alias("ext"), F.sha2("content", 256).alias("h"))
    once = rows.groupBy("base", "ext", "h").agg(F.min("path").alias("first"))
    once = once.withColumn("n", F.row_number().over(Window.partitionBy("base", "ext").orderBy("first")) - 1)
    name = F.concat("base", F.when(F.col("n") > 0, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""), F.lit("."), F.col("ext"))
    return rows.join(once, ["base", "ext", "h"]).select(F.col("path").alias("archive_path"), name.alias("staged_name"))


def persist_syntheses(sources: DataFrame, syntheses: DataFrame) -> DataFrame:
    """Each synthesis (ids, synthesis, created_at) into the records of its ids; of several the newest."""
    new = first_by(syntheses.select(F.explode(F.array_distinct("ids")).alias("id"), "synthesis", "created_at"), ["id"], F.desc("created_at")).select("id", "synthesis")
    joined = sources.join(new, "id", "left")
    return joined.select(*[F.coalesce("synthesis", c).alias(c) if c == "reader_synthesis" else F.col(c) for c in sources.columns])


def suggestions(items: Column, most: int = 15) -> Column:
    """Proposed items trimmed, blanks and repeats out, at most so many."""
    return F.slice(F.array_distinct(F.filter(F.transform(items, trim), lambda x: x != "")), 1, most)
