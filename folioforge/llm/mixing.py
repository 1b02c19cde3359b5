"""Mixing sources to target weights by pivotal dependent rounding.

Sizes are counted in tokens. With the targets renormalised over the sources that hold text, the default size of
the mix is the largest at which every source can meet its share within its cap; a larger size may be asked for,
then capped sources fall short and the others keep their size. Each text of a source gets the same number of
copies, whole ones at once and the fraction by rounding: two texts of a source with open fractions trade mass in
tokens, at odds that keep every expectation, until one is whole. Each partition ends with one open text a source;
these go through a reduction tree of FAN_IN partitions a step to the last, which is drawn.

Scale: tokens are counted in one scan and written; sizes are pre-aggregated; only a row a target reaches the driver
(mix_targets is small and fixed). The tree moves a row a partition and source. A source that holds a third of all
rows is spread over all partitions. Rows are dealt by a hash of their id into as many partitions as their number asks for
and draws are hashes of ids, so that a task run again, or another cluster, gives the same copies.

Defined cases: null or empty texts have 0 tokens and get the whole copies alone; sources without a target (also null
ones) get no copies and are left out; targets without text report 0; a null or negative target counts as 0, a null cap
as 1; repeated rows are rounded one by one; extra columns are ignored; without text or targets the mix is empty.
"""

from __future__ import annotations

import math

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.tokenize import VOCABULARIES, count_tokens
from folioforge.runtime import cut, table

FAN_IN = 32
ROWS_A_PART = 20_000
#: Targets are read to the driver and broadcast; more than these are refused.
MOST_TARGETS = 100_000
SEED = 17


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, float]:
    """Copies a text of each source, as a fraction."""
    open_ = {s: (t, max(0, r)) for s, t, r in targets if sizes.get(s, 0) > 0 and t > 0 and r > 0}
    whole = sum(t for t, _ in open_.values())
    if not open_:
        return {}
    if total is None:
        total = min(r * sizes[s] * whole / t for s, (t, r) in open_.items())
    return {s: min(float(r), total * t / whole / sizes[s]) for s, (t, r) in open_.items()}


_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64()), ("copies", pa.int64()), ("open", pa.float64())])
_ROWS = "doc_id long, source string, n_tokens long, copies long, open double"


def _draw(seed: int, *ids: int) -> float:
    return xxhash.xxh64_intdigest(repr(ids), seed) / 2**64


def trade(a: float, wa: int, b: float, wb: int, draw: float) -> tuple[float, float]:
    """Move mass between fractions a and b of weights wa and wb until one is whole; the total a*wa+b*wb and both expectations stay."""
    up, down = min((1 - a) * wa, b * wb), min(a * wa, (1 - b) * wb)
    if draw * (up + down) < down:
        a, b = (1.0 if up == (1 - a) * wa else a + up / wa), (0.0 if up == b * wb else b - up / wb)
    else:
        a, b = (0.0 if down == a * wa else a - down / wa), (1.0 if down == (1 - b) * wb else b + down / wb)
    return a, b


def _round(seed: int, last: bool):
    """Settle the open fractions of a partition; at most one a source stays open (none if last)."""

    def run(batches):
        held: dict[str, list] = {}
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = list(row)
                doc, source, weight, _, share = row
                if share <= 0 or share >= 1 or weight <= 0:
                    out.append([doc, source, weight, row[3] + (share >= 1), 0.0])
                    continue
                other = held.pop(source, None)
                if other is None:
                    held[source] = row
                    continue
                other[4], row[4] = trade(other[4], other[2], share, weight, _draw(seed, other[0], doc))
                for x in (other, row):
                    if x[4] <= 0 or x[4] >= 1:
                        out.append([x[0], x[1], x[2], x[3] + (x[4] >= 1), 0.0])
                    else:
                        held[source] = x
            yield _batch(out)
        rest = [[d, s, w, c + (last and _draw(seed, d) < p), 0.0 if last else p] for d, s, w, c, p in held.values()]
        yield _batch(rest)

    return run


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _ARROW, strict=True)], schema=_ARROW)


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, folder: str = VOCABULARIES, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, copies, n_tokens) of the texts in the mix, and the report a target."""
    counted = cut(count_tokens(documents, folder=folder))
    if targets.count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    wanted = [(r["source"], max(0.0, r["target_share"] or 0.0), 1 if r["max_repeats"] is None else r["max_repeats"]) for r in targets.filter(F.col("source").isNotNull()).collect()]
    sizes = {r[0]: r[1] for r in counted.groupBy("source").agg(F.sum("n_tokens")).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").collect()}
    copies = plan(sizes, wanted, total)
    spark = documents.sparkSession
    rates = spark.createDataFrame([(s, int(math.floor(c)), c - math.floor(c)) for s, c in copies.items()], "source string, copies long, open double")
    parts = max(1, math.ceil(counted.count() / ROWS_A_PART))
    dealt = counted.join(F.broadcast(rates), "source").select("doc_id", "source", "n_tokens", "copies", "open").repartition(parts, "doc_id").sortWithinPartitions("source", "doc_id", "n_tokens")
    rows = cut(dealt.mapInArrow(_round(seed, False), _ROWS))
    settled, open_ = rows.filter("open = 0"), rows.filter("open > 0")
    while True:
        parts = -(-parts // FAN_IN)
        step = cut(open_.repartition(parts, F.pmod(F.xxhash64("doc_id"), F.lit(parts))).sortWithinPartitions("source", "doc_id", "n_tokens").mapInArrow(_round(seed + parts, parts == 1), _ROWS))
        settled, open_ = settled.unionByName(step.filter("open = 0")), step.filter("open > 0")
        if parts == 1:
            break
    chosen = settled.filter("copies > 0").select("doc_id", "source", "copies", "n_tokens")
    used = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mix_tokens"), F.max("copies").alias("most_copies"))
    have = spark.createDataFrame(list(sizes.items()), "source string, source_tokens long")
    report = targets.filter(F.col("source").isNotNull()).join(F.broadcast(have), "source", "left").join(used, "source", "left")
    whole = used.agg(F.sum("mix_tokens").alias("whole"))
    report = report.crossJoin(F.broadcast(whole)).select("source", "target_share", "max_repeats", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce(F.col("mix_tokens") / F.col("whole"), F.lit(0.0)), 9).alias("actual_share"))
    return chosen, report


def p9_mix(spark: SparkSession, directory: str) -> DataFrame:
    return mix(table(spark, directory, "documents"), table(spark, directory, "mix_targets"))[0]


def p9_report(spark: SparkSession, directory: str) -> DataFrame:
    return mix(table(spark, directory, "documents"), table(spark, directory, "mix_targets"))[1]


QUERIES = {"p9_mix": p9_mix, "p9_report": p9_report}
SQL: dict[str, str] = {}
