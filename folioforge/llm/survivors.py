"""Best representative of each duplicate group: skyline selection over records, fields filled layer by layer.

Each record of a group is a point: recency, trust (the smaller id, entered earlier) and completeness. Completeness is
a criterion a field: whether its value is usable, for notes how long it is. The skyline are the records that no
other equals or exceeds in all criteria; without it, the next layer is the skyline of the rest. Each field is filled
from the first layer that holds a usable value, by a lexicographic policy: worth (length of notes), recency, trust.

With a criterion a field the winner of every field lies in the first layer, as a record that dominates it would win
instead; deeper layers are then searched only if a usable value is left, which the count of filled fields tells.
completeness="count" takes the number of usable fields as one criterion: then a record with the latest value of a field may be
dominated by fuller ones, fields are filled from layers below, and not always with the value wanted here.

Scale: one shuffle a layer. Points are one row a record; each partition first reduces its own to local skylines, so that a group
that holds a third of all records arrives as a few points a partition. The policy is an aggregation with partial maxima.

Defined cases: a null updated_at is the oldest; ties go to the smallest id; a repeated id counts once (its
policy-best value); fields without a usable value give no row; empty tables give none; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.records import work_groups
from folioforge.runtime import cut, table

MAX_LAYERS = 1000
FIELDS = ("doi", "isbn", "notes", "zotero_item_key")


def trimmed(c: str) -> Column:
    return F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")


def usable(field: str) -> Column:
    if field == "doi":
        return F.col("doi").rlike(r"10\.[0-9]{4,9}/\S")
    if field == "isbn":
        digits = F.regexp_replace("isbn", "[^0-9]", "")
        total = F.aggregate(F.transform(F.split(digits, ""), lambda x, i: F.coalesce(x.try_cast("int"), F.lit(0)) * (F.lit(1) + (i % 2) * 2)), F.lit(0).cast("long"), lambda a, x: a + x)
        return (F.length(digits) == 13) & (total % 10 == 0)
    if field == "notes":
        return trimmed("notes") != ""
    return F.col("zotero_item_key").rlike(r"\A[A-Z0-9]{8}\z")


def worth(field: str) -> Column:
    return F.length(trimmed("notes")).cast("long") if field == "notes" else F.lit(1).cast("long")


_POINT = pa.schema([("group_id", pa.int64()), ("source_id", pa.int64()), ("recency", pa.int64()), ("total", pa.int64()), *((f, pa.int64()) for f in FIELDS)])
_POINT_SQL = "group_id long, source_id long, recency long, total long, " + ", ".join(f"{f} long" for f in FIELDS)


def criteria(row: tuple, by_field: bool) -> tuple:
    """What a point (group, id, recency, total, worth by field) is held against others by; more is better."""
    own = tuple(-1 if x is None else x for x in row[4:]) if by_field else (row[3],)
    return (row[2], -row[1], *own)


def _skyline(by_field: bool):
    """Rows sorted by group, recency and total falling, id rising, so that what dominates a row comes before it."""

    def run(batches):
        key, kept_criteria = None, []
        for batch in batches:
            kept: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    key, kept_criteria = row[0], []
                own = criteria(row, by_field)
                if not any(all(x >= y for x, y in zip(other, own, strict=True)) for other in kept_criteria):
                    kept_criteria.append(own)
                    kept.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True) if kept else [[]] * len(_POINT), _POINT, strict=True)], schema=_POINT)

    return run


def skyline(points: DataFrame, by_field: bool = True) -> DataFrame:
    """The undominated points of each group; of points alike in all criteria one."""
    order = ["group_id", F.desc("recency"), F.desc("total"), "source_id"]
    local = points.select(*_POINT.names).sortWithinPartitions(*order).mapInArrow(_skyline(by_field), _POINT_SQL)
    return local.repartition("group_id").sortWithinPartitions(*order).mapInArrow(_skyline(by_field), _POINT_SQL)


def fill(layer: DataFrame) -> DataFrame:
    """group_id, field, source_id: the policy's choice of each field with a usable value in the layer."""
    values = layer.select("group_id", "source_id", "recency", F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in FIELDS]), F.array(*FIELDS))).alias("field", "worth")).filter("worth is not null")
    best = values.groupBy("group_id", "field").agg(F.max(F.struct("worth", "recency", (-F.col("source_id")).alias("minus"))).alias("m"))
    return best.select("group_id", "field", (-F.col("m.minus")).alias("source_id"))


def survivors(groups: DataFrame, records: DataFrame, completeness: str = "field") -> DataFrame:
    """group_id, field, source_id: the record whose value of the field survives. groups: id, group_id; records: id, updated_at and the fields."""
    by_field = completeness == "field"
    moment = F.coalesce(F.expr("unix_micros(cast(updated_at as timestamp))"), F.lit(-(1 << 62)))
    rows = records.select(F.col("id").cast("long").alias("source_id"), moment.alias("recency"), *[F.when(usable(f), worth(f)).alias(f) for f in FIELDS])
    total = sum(F.coalesce(F.col(f), F.lit(-1)) if by_field else F.col(f).isNotNull().cast("long") for f in FIELDS)
    points = cut(groups.select("group_id", F.col("id").alias("source_id")).join(rows, "source_id").withColumn("total", total).select(*_POINT.names))
    wanted = points.groupBy("group_id").agg(*[F.max(F.col(f).isNotNull().cast("int")).alias(f) for f in FIELDS]).agg(*[F.sum(f) for f in FIELDS]).first()
    left = sum(x or 0 for x in wanted)
    layer = skyline(points, by_field)
    chosen = cut(fill(layer))
    left -= chosen.count()
    depth = 1
    while left > 0:  # fields that the layers so far leave empty
        if depth == MAX_LAYERS:
            raise RuntimeError(f"{left} fields empty after {depth} layers")
        points = cut(points.join(layer.select("group_id", "source_id"), ["group_id", "source_id"], "left_anti"))
        layer = skyline(points, by_field)
        more = cut(fill(layer).join(chosen, ["group_id", "field"], "left_anti"))
        chosen, left, depth = chosen.unionByName(more), left - more.count(), depth + 1
    return chosen


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    sources = table(spark, directory, "sources")
    return survivors(cut(work_groups(sources)), sources)


def p5_records(spark: SparkSession, directory: str) -> DataFrame:
    """One record a group, its four fields from the surviving sources."""
    sources = table(spark, directory, "sources")
    kept = survivors(cut(work_groups(sources)), sources)
    values = sources.select(F.col("id").cast("long").alias("source_id"), F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in FIELDS]), F.array(*FIELDS))).alias("field", "value"))
    return kept.join(values, ["source_id", "field"]).groupBy("group_id").pivot("field", list(FIELDS)).agg(F.min("value"))


QUERIES = {"p5_found": p5_found, "p5_records": p5_records}
SQL: dict[str, str] = {}
