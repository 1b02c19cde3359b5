"""Nested records to related flat tables, by Dewey labels.

Every object below the chosen columns gets a label, the ordinals on its way down from the record
(column, member or element positions). Parents are found by truncating labels and paths; the path
without array positions is the schema path, which names the flat table the object belongs to.

Defined cases: null columns, empty arrays and texts that are no complete JSON hold no object; a text
nested deeper than the C parser allows is parsed without recursion; of members of one name in one object
the last holds; repeated records yield repeated rows; extra columns are ignored; a record with a null id
keeps the null id; lone surrogates in a member's name become U+FFFD.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BOM = "﻿"
_OPENS = ("{", "[", '"')
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.ASCII)
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_INVALID = object()


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _flat_parse(text: str) -> object:
    """JSON without recursion, for texts nested deeper than the C parser follows; _INVALID if text is none."""
    root: list = []
    stack: list[list] = [["top", root, None]]  # kind, container, pending key
    pos, expect = 0, "value"
    space = re.compile(r"[ \t\r\n]*")
    while True:
        pos = space.match(text, pos).end()
        kind, box, _ = stack[-1]
        if expect == "next" and kind == "top":
            return root[0] if pos == len(text) else _INVALID
        if pos >= len(text):
            return _INVALID
        c = text[pos]
        if expect == "next":
            if c == ",":
                expect, pos = "key" if kind == "object" else "value", pos + 1
            elif c == ("}" if kind == "object" else "]"):
                stack.pop()
                pos += 1
            else:
                return _INVALID
            continue
        if expect in ("key", "first key"):
            if c == "}" and expect == "first key":
                stack.pop()
                pos, expect = pos + 1, "next"
                continue
            m = _STRING.match(text, pos)
            if not m:
                return _INVALID
            stack[-1][2] = json.loads(m[0])
            pos = space.match(text, m.end()).end()
            if text[pos : pos + 1] != ":":
                return _INVALID
            pos, expect = pos + 1, "value"
            continue
        if expect == "first value" and c == "]":
            stack.pop()
            pos, expect = pos + 1, "next"
            continue
        if c in "{[":
            value: object = {} if c == "{" else []
            opened, pos, after = ["object" if c == "{" else "array", value, None], pos + 1, "first key" if c == "{" else "first value"
        else:
            opened, after = None, "next"
            if m := _STRING.match(text, pos) or _NUMBER.match(text, pos):
                value = json.loads(m[0])
                pos = m.end()
            else:
                word = next((w for w in ("true", "false", "null") if text.startswith(w, pos)), None)
                if word is None:
                    return _INVALID
                value, pos = {"true": True, "false": False, "null": None}[word], pos + len(word)
        if kind == "object":
            box[stack[-1][2]] = value
        else:
            box.append(value)
        if opened:
            stack.append(opened)
        expect = after


def parse_text(text: str) -> object:
    """What a complete JSON text of an object, an array or a string encodes; _INVALID for any other text."""
    bare = text.strip()
    while bare.startswith(_BOM) or bare.endswith(_BOM):
        bare = bare.strip(_BOM).strip()
    if not bare.startswith(_OPENS) or bare[-1] not in '}]"':
        return _INVALID
    try:
        return json.loads(bare, parse_constant=_no_constant)
    except RecursionError:
        return _flat_parse(bare)
    except ValueError:
        return _INVALID


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode() if any("\ud800" <= c <= "\udfff" for c in text) else text


def walk(column: str, ordinal: int, value: object) -> Iterator[tuple[list[int], int, str, int, str, dict]]:
    """Each object below value: label, length of the parent's label, path, length of the parent's path, schema path, scalar members."""
    todo = [(value, [ordinal], 0, column, 0, column)]
    while todo:
        at, label, above, path, above_path, schema = todo.pop()
        while isinstance(at, str):
            inner = parse_text(at) if len(at) > 1 else _INVALID
            if inner is _INVALID:
                break
            at = inner
        if isinstance(at, dict):
            yield label, above, path, above_path, schema, at
            children = [(v, [*label, i], len(label), f"{path}.{k}", len(path), f"{schema}.{k}") for i, (k, v) in enumerate(at.items()) if isinstance(v, (dict, list, str))]
        elif isinstance(at, list):
            children = [(v, [*label, i], above, f"{path}[{i}]", above_path, f"{schema}[]") for i, v in enumerate(at) if isinstance(v, (dict, list, str))]
        else:
            continue
        todo.extend(reversed(children))


def leaves(column: str, ordinal: int, value: object) -> Iterator[tuple[list[int], int, str, int, str, str, str | None]]:
    """Each value below value that is no object: label, length of the nearest object's label, path, length of its path, schema path, kind, text.

    Texts that stand for what they encode are opened as by walk(). With the objects of walk() the leaves hold all of value.
    """
    todo = [(value, [ordinal], 0, column, 0, column)]
    while todo:
        at, label, above, path, above_path, schema = todo.pop()
        while isinstance(at, str):
            inner = parse_text(at) if len(at) > 1 else _INVALID
            if inner is _INVALID:
                break
            at = inner
        if isinstance(at, dict):
            todo.extend(reversed([(v, [*label, i], len(label), f"{path}.{k}", len(path), f"{schema}.{k}") for i, (k, v) in enumerate(at.items())]))
        elif isinstance(at, list) and at:
            todo.extend(reversed([(v, [*label, i], above, f"{path}[{i}]", above_path, f"{schema}[]") for i, v in enumerate(at)]))
        else:
            kind = "array" if isinstance(at, list) else "null" if at is None else "boolean" if isinstance(at, bool) else "text" if isinstance(at, str) else "number"
            yield label, above, path, above_path, schema, kind, at if kind == "text" else None if kind in ("array", "null") else json.dumps(at)


_LEAVES = pa.schema([("record_id", pa.int64()), ("label", pa.list_(pa.int32())), ("parent_len", pa.int32()), ("path", pa.string()), ("parent_path_len", pa.int32()), ("schema_path", pa.string()), ("kind", pa.string()), ("value", pa.string())])
_NODES = pa.schema([("record_id", pa.int64()), ("label", pa.list_(pa.int32())), ("parent_len", pa.int32()), ("path", pa.string()), ("parent_path_len", pa.int32()), ("schema_path", pa.string()), ("members", pa.map_(pa.string(), pa.string()))])


def _scalar(value: object) -> str | None:
    if value is None or isinstance(value, (dict, list)):
        return None
    return _clean(value) if isinstance(value, str) else json.dumps(value)


#: Letters of paths and ordinals of labels after which a batch is handed on, so that deep records stay within memory.
FLUSH = 4_000_000


def _flatten(columns: list[str], structured: list[bool], members: bool, values: bool = False):
    schema = _LEAVES if values else _NODES

    def batch_of(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cells, f.type) for cells, f in zip(out, schema, strict=True)], schema=schema)

    def rows_of(record: int | None, column: str, ordinal: int, value: object) -> Iterator[tuple]:
        if values:
            for label, above, path, above_path, schema_path, kind, text in leaves(column, ordinal, value):
                yield record, label, above, _clean(path), above_path, _clean(schema_path), kind, None if text is None else _clean(text)
        else:
            for label, above, path, above_path, schema_path, at in walk(column, ordinal, value):
                yield record, label, above, _clean(path), above_path, _clean(schema_path), [(_clean(m), _scalar(v)) for m, v in at.items() if not isinstance(v, (dict, list))] if members else None

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[list] = [[] for _ in schema]
            held = 0
            for k, column in enumerate(columns):
                for record, text in zip(ids, batch.column(k + 1).to_pylist(), strict=True):
                    if text is None:
                        continue
                    value = text
                    if structured[k]:
                        try:
                            value = json.loads(text)
                        except RecursionError:
                            value = _flat_parse(text)
                    for row in rows_of(record, column, k, value):
                        for cells, cell in zip(out, row, strict=True):
                            cells.append(cell)
                        held += len(row[3]) + len(row[1])
                        if held > FLUSH:
                            yield batch_of(out)
                            out, held = [[] for _ in schema], 0
            yield batch_of(out)

    return run


def _sent(df: DataFrame, key: str, columns: list[str], objects_only: bool) -> tuple[DataFrame, list[bool]]:
    """Key and columns as JSON or text; with objects_only, of the texts only those that can hold an object leave the JVM."""
    kinds = dict(zip(df.columns, (f.dataType for f in df.schema.fields), strict=True))
    structured = [not isinstance(kinds[c], T.StringType) for c in columns]
    picked = []
    for c, nested in zip(columns, structured, strict=True):
        text = F.to_json(F.col(c), {"ignoreNullFields": "false"}) if nested else F.col(c)
        picked.append((F.when(text.rlike(r"\{|u007[bB]"), text) if objects_only else text).alias(c))
    sent = df.select(F.col(key).cast("long").alias("record_id"), *picked).filter(F.coalesce(*[F.col(c) for c in columns]).isNotNull())
    return sent, structured


F_LABEL, F_PATH = "slice(label, 1, parent_len)", "substr(path, 1, parent_path_len)"


def dewey_nodes(df: DataFrame, key: str, columns: list[str], members: bool = False) -> DataFrame:
    """One row per object below the columns: record_id, label, parent_label, path, parent_path, schema_path, members.

    Strings, structs, arrays and maps may be given; only texts that can hold an object leave the JVM.
    label and parent_label are Dewey labels (lists of ordinals); parents come from truncating label and path.
    members, if asked for, holds the scalar members as text.
    """
    sent, structured = _sent(df, key, columns, True)
    schema = "record_id long, label array<int>, parent_len int, path string, parent_path_len int, schema_path string, members map<string,string>"
    nodes = sent.mapInArrow(_flatten(columns, structured, members), schema)
    return nodes.select("record_id", "label", F.expr(F_LABEL).alias("parent_label"), "path", F.expr(F_PATH).alias("parent_path"), "schema_path", "members")


def dewey_values(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per value below the columns that is no object, with the label of the object it belongs to: members, elements of arrays, plain texts, nulls and empty arrays.

    record_id, label, parent_label, path, parent_path, schema_path, kind (text, number, boolean, null, array), value. A column
    that is null gives no row.
    """
    sent, structured = _sent(df, key, columns, False)
    schema = "record_id long, label array<int>, parent_len int, path string, parent_path_len int, schema_path string, kind string, value string"
    found = sent.mapInArrow(_flatten(columns, structured, False, True), schema)
    return found.select("record_id", "label", F.expr(F_LABEL).alias("parent_label"), "path", F.expr(F_PATH).alias("parent_path"), "schema_path", "kind", "value")


def flat_table(nodes: DataFrame, schema_path: str, columns: list[str]) -> DataFrame:
    """The flat table of a schema path, with a column for each of the scalar members named."""
    own = nodes.filter(F.col("schema_path") == schema_path)
    return own.select("record_id", "label", "parent_label", "path", "parent_path", *[F.col("members")[c].alias(c) for c in columns])


def flat_tables(nodes: DataFrame, schema_paths: list[str]) -> dict[str, DataFrame]:
    """The flat table of each schema path, its scalar members still in one map column."""
    return {p: nodes.filter(F.col("schema_path") == p).select("record_id", "label", "parent_label", "path", "parent_path", "members") for p in schema_paths}
