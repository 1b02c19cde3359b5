"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.nested import dewey_nodes, dewey_values, flat_table
from folioforge.runtime import table

COLUMNS = ["lookup_trace", "raw_input", "ai_claims"]


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return dewey_nodes(table(spark, directory, "sources"), "id", COLUMNS).select(F.col("record_id").alias("source_id"), "path", "parent_path")


def _dotted(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ".")


def p1_tables(spark: SparkSession, directory: str) -> DataFrame:
    """The flat tables in one frame: a row per object with its table's name, its Dewey label and parent label as text, and its scalar members."""
    nodes = dewey_nodes(table(spark, directory, "sources"), "id", COLUMNS, members=True)
    return nodes.select(F.col("record_id").alias("source_id"), F.col("schema_path").alias("table_name"), _dotted("label").alias("label"), _dotted("parent_label").alias("parent_label"), F.to_json("members").alias("members"))


def p1_values(spark: SparkSession, directory: str) -> DataFrame:
    """What is no object: members, elements of arrays, plain texts, nulls and empty arrays, each with the label of its object. With p1_tables it holds the records whole."""
    found = dewey_values(table(spark, directory, "sources"), "id", COLUMNS)
    return found.select(F.col("record_id").alias("source_id"), F.col("schema_path").alias("table_name"), _dotted("label").alias("label"), _dotted("parent_label").alias("parent_label"), "path", "kind", "value")


def p1_steps(spark: SparkSession, directory: str) -> DataFrame:
    """The flat table of lookup steps, a column a member."""
    nodes = dewey_nodes(table(spark, directory, "sources"), "id", ["lookup_trace"], members=True)
    return flat_table(nodes, "lookup_trace[]", ["step", "status", "detail"]).select(F.col("record_id").alias("source_id"), "path", "step", "status", "detail")


QUERIES = {"p1_found": p1_found, "p1_tables": p1_tables, "p1_values": p1_values, "p1_steps": p1_steps}
SQL = {
    "p1_steps": """
WITH t AS (SELECT id, lookup_trace, unnest(range(len(lookup_trace))) AS i FROM sources)
SELECT id AS source_id, 'lookup_trace[' || i || ']' AS path, lookup_trace[i + 1].step AS step, lookup_trace[i + 1].status AS status, lookup_trace[i + 1].detail AS detail
FROM t WHERE lookup_trace[i + 1] IS NOT NULL
"""
}
