"""Dewey-labelled flattening against a recursive walk, and its defined cases."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.operators.nested import _INVALID, _flat_parse, dewey_nodes, dewey_values, flat_table, flat_tables, leaves, parse_text, walk

SCHEMA = "id long, trace array<struct<step:string,status:string,detail:string>>, raw string, claims array<string>"


def brute(column, value):
    """Paths of objects and their nearest enclosing object, recursively."""
    out = []

    def go(v, path, parent):
        if isinstance(v, str):
            inner = parse_text(v) if len(v) > 1 else _INVALID
            if inner is not _INVALID:
                go(inner, path, parent)
        elif isinstance(v, dict):
            out.append((path, parent))
            for k, x in v.items():
                go(x, f"{path}.{k}", path)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                go(x, f"{path}[{i}]", parent)

    go(value, column, "")
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"path": F.lit("x"), "record_id": F.lit(9), "label": F.lit("y")})
    return dewey_nodes(df, "id", ["trace", "raw", "claims"], **kw)


def test_nested_encodings_nulls_and_repeats(spark):
    deep = json.dumps({"a": [None, {"b": json.dumps({"c": json.dumps([{"d": {}}])})}]})
    rows = [
        (1, [("s", "ok", '{"p": {"q": 1}}'), None, ("s", None, None)], json.dumps(deep), ["plain", None, ' \ufeff {"x": [1, {"y": []}]} ', "{broken", "{}"]),
        (1, [], "[1, 2]", []),
        (2, None, None, None),
        (None, None, "{}", None),
    ]
    got = sorted((r.record_id, r.path, r.parent_path) for r in found(spark, rows).collect() if r.record_id)
    want = [(1, "trace[0]", ""), (1, "trace[0].detail", "trace[0]"), (1, "trace[0].detail.p", "trace[0].detail"), (1, "trace[2]", "")]
    want += [(1, p, q) for p, q in brute("raw", json.dumps(deep))] + [(1, "claims[2]", ""), (1, "claims[2].x[1]", "claims[2]"), (1, "claims[4]", "")]
    assert got == sorted(want)
    assert [r.path for r in found(spark, rows).filter("record_id is null").collect()] == ["raw"]


def test_parents_by_truncated_labels_and_tables(spark):
    nodes = found(spark, [(7, None, '{"a": {"b": [{"c": {}}, {}]}, "t": 1.5}', None)], members=True)
    by_label = {tuple(r.label): r for r in nodes.collect()}
    for r in by_label.values():
        if r.parent_label:
            assert by_label[tuple(r.parent_label)].path == r.parent_path and tuple(r.label[: len(r.parent_label)]) == tuple(r.parent_label)
    tables = flat_tables(nodes, ["raw", "raw.a.b[]"])
    assert tables["raw.a.b[]"].count() == 2 and tables["raw"].first().members == {"t": "1.5"}


def test_empty_table_and_very_deep_text(spark):
    assert found(spark, []).count() == 0
    depth = 4_000
    assert found(spark, [(1, None, '{"a":' * depth + "1" + "}" * depth, None)]).count() == depth


json_values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(min_size=1, max_size=3), x, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(json_values)
def test_walk_equals_recursion_and_flat_parser_equals_json(value):
    text = json.dumps(value)
    assert sorted((p, p[:n]) for _, _, p, n, _, _ in walk("raw", 1, text)) == brute("raw", text)
    assert _flat_parse(text) == json.loads(text)
    assert _flat_parse(text + "x") is _INVALID
    assert _flat_parse("[" + text) is _INVALID


def opened(value):
    """value with every text that stands for what it encodes replaced by it."""
    while isinstance(value, str) and len(value) > 1 and (inner := parse_text(value)) is not _INVALID:
        value = inner
    if isinstance(value, dict):
        return {k: opened(v) for k, v in value.items()}
    return [opened(v) for v in value] if isinstance(value, list) else value


def rebuilt(objects, values):
    """A column's value from the labels of its objects and values: (label, path) and (label, path, kind, text)."""
    at = {}
    for label, path in objects:
        at[tuple(label)] = ({}, path)
    for label, path, kind, text in values:
        at[tuple(label)] = ([] if kind == "array" else None if kind == "null" else text if kind == "text" else json.loads(text), path)
    for label in [k for k in at]:
        for n in range(1, len(label)):
            at.setdefault(label[:n], ([], None))
    paths = {k: p for k, (_, p) in at.items()}
    for label in sorted(at, key=lambda x: (-len(x), x)):
        if paths[label] is None:  # an array: its path is that of an element without the position
            inner = min(k for k in at if len(k) == len(label) + 1 and k[:-1] == label)
            paths[label] = paths[inner][: paths[inner].rindex("[")]
    for label in sorted(at):
        if len(label) > 1:
            above = at[label[:-1]][0]
            above.append(at[label][0]) if isinstance(above, list) else above.__setitem__(paths[label][len(paths[label[:-1]]) + 1 :], at[label][0])
    return at[min(at)][0]


@settings(max_examples=150, deadline=None)
@given(json_values)
def test_objects_and_values_hold_the_whole_record(value):
    objects, values = [(x[0], x[2]) for x in walk("raw", 1, value)], [(x[0], x[2], x[5], x[6]) for x in leaves("raw", 1, value)]
    assert rebuilt(objects, values) == opened(value)


def test_values_of_arrays_and_plain_texts_are_kept(spark):
    df = spark.createDataFrame([(1, [("s", None, '["a"]')], '{"t": ["a", "b"], "n": [1, null], "e": [], "o": {}}', ["plain", None]), (2, None, "text", None), (3, None, None, None)], SCHEMA).withColumns({"value": F.lit("x"), "kind": F.lit(9)})
    got = {(r.record_id, r.path, tuple(r.parent_label), r.kind, r.value) for r in dewey_values(df, "id", ["trace", "raw", "claims"]).collect()}
    want = {(1, "trace[0].step", (0, 0), "text", "s"), (1, "trace[0].status", (0, 0), "null", None), (1, "trace[0].detail[0]", (0, 0), "text", "a")}
    want |= {(1, "raw.t[0]", (1,), "text", "a"), (1, "raw.t[1]", (1,), "text", "b"), (1, "raw.n[0]", (1,), "number", "1"), (1, "raw.n[1]", (1,), "null", None), (1, "raw.e", (1,), "array", None)}
    want |= {(1, "claims[0]", (), "text", "plain"), (1, "claims[1]", (), "null", None), (2, "raw", (), "text", "text")}
    assert got == want and dewey_values(df.limit(0), "id", ["raw"]).count() == 0
    steps = flat_table(dewey_nodes(df, "id", ["trace"], members=True), "trace[]", ["step", "detail"]).collect()
    assert [(r.record_id, r.path, r.step, r.detail) for r in steps] == [(1, "trace[0]", "s", '["a"]')]


def test_what_is_no_json():
    for text in ("NaN", "{a: 1}", "[1,]", '{"a":1} x', "12", "null", "[NaN]", "", '"open', "[Infinity]"):
        assert parse_text(text) is _INVALID
        assert _flat_parse(text) is _INVALID or text in ("12", "null")
