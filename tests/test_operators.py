"""Operators against brute force on small frames."""

import datetime as dt
import io
import itertools
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions.guide import complete_guide, natural_key
from folioforge.functions.similarity import ratio
from folioforge.functions.text import norm_text
from folioforge import runtime
from folioforge.operators import activity, dedupe, graphs, notes, reader, store, vectors
from folioforge.operators.graphs import components
from folioforge.plans import intake
from folioforge.sources import archives, formats, library, pages, providers
from folioforge.streaming.sessions import focus_by_window


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300), (1, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs_and_without_end(spark, monkeypatch):
    monkeypatch.setattr(graphs, "HUB", 3)
    monkeypatch.setattr(graphs, "HUB_SHARE", 0.1)
    edges = [(0, k) for k in range(1, 60)] + [(k, k + 100) for k in range(1, 60)] + [(500, 501), (501, 502)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {x: 0 if x < 400 else 500 for e in edges for x in e}
    with pytest.raises(RuntimeError):
        components(df, rounds=1)


def test_a_side_is_broadcast_only_within_its_bounds(spark):
    side = spark.createDataFrame([(k, "x" * 100, [k]) for k in range(50)], "id long, t string, l array<long>")
    big = spark.range(100)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(runtime.join_small(big, side, "id")) and "broadcast" not in plan(runtime.join_small(big, side, "id", rows=10))
    assert runtime.join_small(big, side.limit(0), "id").count() == 100


def test_logs_vectors_sessions_and_items(spark):
    log = spark.createDataFrame([(7, "a", 1, "i", "{}", dt.datetime(2024, 1, 1))], "id long, run_type string, source_id long, input_text string, output_json string, created_at timestamp")
    entries = spark.createDataFrame([(2, "q", "v", dt.datetime(2024, 2, 1)), (None, "r", None, None)], "source_id long, input_text string, verdict string, created_at timestamp")
    rows = store.append_log(log, entries, "digest", ["verdict"]).orderBy("id").collect()
    assert len({r.id for r in rows}) == 3 and min(r.id for r in rows) == 7 and [r.output_json for r in rows[1:]] == ['{"verdict":"v"}', '{"verdict":null}']
    have = spark.createDataFrame([(1, "t", [1.0])], "id long, input_text string, embedding array<double>")
    new = spark.createDataFrame([(1, " ", [2.0], 1), (1, "u", [], 2), (2, "w", [3.0], 1), (2, "x", [4.0], 2)], "id long, input_text string, embedding array<double>, at int")
    assert {(r.id, r.input_text) for r in store.upsert_vectors(have, new, "at").collect()} == {(1, "t"), (2, "x")}
    sessions = spark.createDataFrame([(1, "l", 5, "work", 10, True, False, "n", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)), (2, "l", 5, "work", 10, False, False, "n", dt.datetime(2024, 1, 1), None)], "id long, task_label string, source_id long, type string, duration_sec int, completed boolean, abandoned boolean, notes string, started_at timestamp, ended_at timestamp")
    starts = spark.createDataFrame([(3, "s", 9, "work", 60, dt.datetime(2024, 3, 1))], "id long, task_label string, source_id long, type string, duration_sec int, started_at timestamp")
    started = {r.id: r for r in store.start_sessions(sessions, starts, spark.createDataFrame([(5,)], "id long")).collect()}
    assert started[3].source_id is None and started[3].ended_at is None and started[3].notes == "" and started[1].source_id == 5
    drafts = spark.createDataFrame([(1, "late", 1), (2, "one", 1), (2, "two", 2)], "id long, notes string, saved_at int")
    assert {r.id: r.notes for r in store.autosave_notes(sessions, drafts).collect()} == {1: "n", 2: "two"}
    items = spark.createDataFrame([(1, 10, False), (2, 10, True), (3, 11, False)], "id long, ticket_id long, done boolean")
    tickets = spark.createDataFrame([(10, dt.datetime(2024, 1, 1)), (11, dt.datetime(2024, 1, 1))], "id long, updated_at timestamp")
    patches = spark.createDataFrame([(1, False, dt.datetime(2024, 2, 1)), (1, True, dt.datetime(2024, 2, 2))], "id long, done boolean, at timestamp")
    changed, touched = store.toggle_items(items, tickets, patches)
    assert {r.id: r.done for r in changed.collect()} == {1: True, 2: True, 3: False} and {r.id: r.updated_at.month for r in touched.collect()} == {10: 2, 11: 1}
    projects = spark.createDataFrame([(4, "e4", "old")], "id long, external_id string, name string")
    wanted = spark.createDataFrame([(f"e{k}", f"n{k}") for k in range(4, 40)] + [("", "x")], "external_id string, name string")
    made = {r.external_id: r.id for r in store.get_or_create(projects, wanted).collect()}
    assert made["e4"] == 4 and sorted(made.values()) == list(range(4, 40)) and [k for k in sorted(made) if k != "e4"] == sorted((k for k in made if k != "e4"), key=made.get)
    assert store.get_or_create(projects, wanted.filter("external_id = 'e4'")).count() == 1


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8 if i % 7 else 5)]) for i in range(150)] + [(200, [0.0] * 8), (201, None), (202, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)

    def cos(a, b):
        n = min(len(a), len(b))
        a, b = np.array(a[:n]), np.array(b[:n])
        norm = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
        return float(a @ b / norm) if norm > 0 else 0.0

    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.top_k(df.filter("vec_id % 20 = 0"), df, 4).collect()}
    for q, v in rows:
        if q % 20 == 0 and v is not None:
            order = sorted((x for x in rows if x[1] is not None), key=lambda x: (-round(cos(v, x[1]), 12), x[0]))
            assert [got[q, k + 1] for k in range(4)] == [x[0] for x in order[:4]]
    pair = spark.createDataFrame([([1.0, 2.0, 9.0], [2.0, 1.0])], "a array<double>, b array<double>")
    assert abs(pair.select(vectors.cosine("a", "b").alias("c")).first().c - 0.8) < 1e-12


def sources(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    titles = ["deep rivers of the north", "deep rivers of the northh", "on quiet markets", "On Quiet Markets!", "", "a wholly other thing"]
    rows = [(i, titles[rng.integers(6)], [["Doe, J", "Roe, R", ""][rng.integers(3)]], ["1999", "2000", ""][rng.integers(3)], ["10.1/a", "10.1/B", "", "", ""][rng.integers(5)], ["97801", "", ""][rng.integers(3)], ["K1", "", "", ""][rng.integers(4)], dt.datetime(2024, 1, 1) + dt.timedelta(days=int(rng.integers(20)))) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "id long, title string, authors array<string>, year string, doi string, isbn string, zotero_item_key string, created_at timestamp"), rows


def test_duplicate_groups_equal_nested_loop(spark):
    df, rows = sources(spark)
    norm = {r.id: (r.t, r.a) for r in df.select("id", norm_text("title").alias("t"), dedupe.first_author("authors").alias("a")).collect()}
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, q in itertools.combinations(sorted(rows, key=lambda r: (r[7], r[0]), reverse=True), 2):
        s = ratio(norm[p[0]][0], norm[q[0]][0])
        same = lambda k: p[k].strip().lower() == q[k].strip().lower() != ""  # noqa: B023, E731
        if same(4) or same(5) or same(6) or (same(3) and s >= 0.9) or (norm[p[0]][1] == norm[q[0]][1] != "" and s >= 0.97):
            x, y = sorted((find(p[0]), find(q[0])))
            parent[y] = x
    want = {i: find(i) for i in parent}
    want = {i: g for i, g in want.items() if list(want.values()).count(g) > 1}
    assert {r.id: r.group_id for r in dedupe.duplicate_groups(df).collect()} == want


def test_registered_scan_groups_by_all_rules(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [
        (1, "deep rivers of the north", ["Doe, J"], "1999", "10.1/a", "", "", day), (2, "another thing altogether", ["Roe, R"], "2001", "10.1/A", "", "", day),
        (3, "deep rivers of the northh", ["Poe, E"], "1999", "", "", "", day), (4, "on quiet markets", ["Moe, M"], "", "", "", "", day), (5, "On Quiet Markets!", ["Moe, M"], "", "", "", "", day), (6, "on quiet markets", ["Loe, L"], "", "", "", "", day),
    ]
    df = spark.createDataFrame(rows, "id long, title string, authors array<string>, year string, doi string, isbn string, zotero_item_key string, created_at timestamp")
    others = {"origin_provider", "publisher", "journal", "volume", "issue", "pages", "url", "notes", "raw_input", "body_text", "body_source", "type", "accessed_at"}
    df.withColumns({c: F.lit("") for c in others}).write.parquet(str(tmp_path / "sources.parquet"))
    found = {r.id: r.group_id for r in intake.QUERIES["dedupe_scan_components"](spark, str(tmp_path)).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    kept = {r.group_id: r["size"] for r in intake.QUERIES["dedupe_scan_keep"](spark, str(tmp_path)).collect()}
    assert kept == {1: 3, 4: 2}


def test_similar_titles_in_blocks_equal_nested_loop(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = ["what the harbours of nerereltor tell us", "on the map of bribegrucka and its dialects", "a wholly other thing"]
    titles = sorted({"".join(c for k, c in enumerate(b) if k not in set(rng.integers(0, len(b), rng.integers(0, 4)))) for b in base for _ in range(15)})
    rows = [(i, t, i * 7 % 11) for i, t in enumerate(titles)]
    classes = spark.createDataFrame([("1999", t, i, c) for i, t, c in rows] + [("2001", "on the map", 99, 1)], "k string, t string, rep long, created long")
    order = lambda p, q: (p, q) if (p[2], p[0]) > (q[2], q[0]) else (q, p)
    for block in (4, 1500):
        monkeypatch.setattr(dedupe, "BLOCK", block)
        for least in (0.9, 0.97):
            want = {(p[0], q[0]) for p, q in (order(*x) for x in itertools.combinations(rows, 2)) if ratio(p[1], q[1]) >= least}
            got = [tuple(r) for r in dedupe.near_titles(classes, least).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_merge_fills_blanks_and_notes(spark):
    cols = [*dedupe.MERGED, "zotero_item_key", "notes", "origin_provider"]
    base = dict.fromkeys(cols, "")
    rows = [base | {"id": 1, "title": "T", "notes": "n1", "authors": ["a"]}, base | {"id": 2, "title": "U", "year": "2000", "notes": "n2", "authors": ["b", "a"]}, base | {"id": 3, "year": "1999", "notes": "has n2 inside? n2", "authors": None, "zotero_item_key": "K"}]
    df = spark.createDataFrame([{**r, "created_at": dt.datetime(2024, 1, r["id"])} for r in rows], "id long, " + ", ".join(f"{c} string" for c in cols) + ", authors array<string>, created_at timestamp")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, group_id long")
    keep = spark.createDataFrame([(1, 3, 1, 1.0)], "group_id long, size long, keep_id long, keep_score double")
    m = dedupe.merge_groups(groups, df, keep).first()
    assert (m.id, m.title, m.year, m.zotero_item_key, m.authors) == (1, "T", "2000", "K", ["a", "b"])
    assert m.notes == "n1\n\nMerged from source #2:\nn2\n\nMerged from source #3:\nhas n2 inside? n2"


def test_overlaps_equal_nested_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(3)), "body", int(a), int(a + rng.integers(0, 2500))) for i, a in enumerate(rng.integers(0, 6000, 80))] + [(900, 7, "body", 0, 10), (901, 7, "body", 10, 20)]
    n = spark.createDataFrame(rows, "id long, source_id long, note_scope string, start_offset int, end_offset int")
    want = {(min(p[0], q[0]), max(p[0], q[0])) for p, q in itertools.combinations(rows, 2) if p[1] == q[1] and p[3] < q[4] and p[4] > q[3] and p[4] > p[3] and q[4] > q[3]}
    got = [(r.a_id, r.b_id) for r in notes.overlaps(n, n).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pieces_and_insertable(spark):
    df = spark.createDataFrame([("abcdef", [(1, 3), (2, 5), (4, 99)])], "t string, s array<struct<start_offset:int,end_offset:int>>")
    p = df.select(notes.pieces(F.col("t"), F.col("s")).alias("p")).first().p
    assert [(x.text, x.highlighted) for x in p] == [("a", False), ("b", True), ("c", True), ("d", True), ("e", True), ("f", True)]
    s = spark.createDataFrame([(1, "hello world")], "id long, body_text string")
    old = spark.createDataFrame([(1, "body", 0, 3)], "source_id long, note_scope string, start_offset int, end_offset int")
    new = spark.createDataFrame([(1, 1, "body", 2, 5, "q", "n"), (2, 1, "body", 3, 5, "q", "n"), (3, 9, "body", 0, 1, "q", "n"), (4, 1, "x", 0, 1, "q", "n"), (5, 1, "body", 5, 5, "q", "n"), (6, 1, "body", 3, 99, "q", "n"), (7, 1, "body", 4, 6, " ", "n")], "id long, source_id long, note_scope string, start_offset int, end_offset int, quote_text string, note_text string")
    assert {r.id: r.reason for r in notes.insertable(new, s, old).collect()} == {1: "overlaps", 2: "", 3: "source not found", 4: "invalid scope", 5: "invalid range", 6: "range exceeds text", 7: "texts required"}


def test_store(spark):
    kv = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    changes = spark.createDataFrame([("b", "3", 1), ("b", "4", 2), ("c", "5", 1)], "key string, value string, at int")
    assert sorted(map(tuple, store.upsert(kv, changes, "key", "at").collect())) == [("a", "1"), ("b", "4"), ("c", "5")]
    projects = spark.createDataFrame([(4, "x", "Old")], "id long, external_id string, name string")
    wanted = spark.createDataFrame([("x", "New"), ("z", "Z"), ("y", "Y"), ("", "no")], "external_id string, name string")
    assert {r.external_id: (r.name, r.id) for r in store.get_or_create(projects, wanted).collect()} == {"x": ("New", 4), "y": ("Y", 5), "z": ("Z", 6)}
    sessions = spark.createDataFrame([(1, False, False, "n", None), (2, True, False, "m", dt.datetime(2024, 1, 1))], "id long, completed boolean, abandoned boolean, notes string, ended_at timestamp")
    ends = spark.createDataFrame([(1, True, None), (2, True, "x")], "id long, abandoned boolean, notes string")
    once = store.finish_sessions(sessions, ends, F.lit("2024-02-02").cast("timestamp"))
    assert [(r.id, r.abandoned, r.notes) for r in once.orderBy("id").collect()] == [(1, True, "n"), (2, False, "m")]
    assert store.finish_sessions(once, ends, F.lit("2025-02-02").cast("timestamp")).exceptAll(once).count() == 0


def test_reader(spark):
    q = spark.createDataFrame([(" c ", ["T", "t", " ", "U", "V"])], "c string, t array<string>")
    assert q.select(reader.queries(F.col("c"), F.col("t")).alias("q")).first().q == ["c", "T", "c T", "U"]
    s = spark.createDataFrame([({"verdict": "read", "claims": [{"text": "a", "source_ids": [1, 9]}, {"text": "b", "source_ids": [9]}, {"text": "c", "source_ids": []}], "evidence": [{"source_id": 9}, {"source_id": 1}], "cautions": ["x"]}, [1])], "synthesis struct<verdict:string,verdict_reason:string,claims:array<struct<text:string,source_ids:array<bigint>,strength:string>>,evidence:array<struct<source_id:bigint,method:string,quotes:array<string>>>,connections:array<struct<source_ids:array<bigint>,relation:string,note:string>>,cautions:array<string>,external_candidates:array<struct<url:string>>>, valid_ids array<bigint>")
    g = reader.ground(s).first()
    assert (g.verdict, g.verdict_reason, len(g.claims), len(g.evidence), g.bad_claims, g.bad_evidence, len(g.cautions)) == ("skim", reader.DOWNGRADED, 1, 1, 2, 1, 3)


def test_cycle_replay_over_days(spark):
    t = dt.datetime(2024, 1, 1, 22)
    rows = [(i, k, c, t + dt.timedelta(hours=i)) for i, (k, c) in enumerate([("work", True)] * 4 + [("long_break", True), ("work", True), ("work", False), ("short_break", True), ("long_break", False), ("WORK ", True)])]
    df = spark.createDataFrame(rows, "id long, type string, completed boolean, started_at timestamp")
    got = {r.id: (r.cycle_index, r.next_phase) for r in activity.cycle_replay(df).collect()}
    assert [got[i] for i in range(10)] == [(1, "short_break"), (2, "short_break"), (3, "short_break"), (4, "long_break"), (0, "idle"), (1, "short_break"), (1, "idle"), (1, "idle"), (1, "idle"), (2, "short_break")]


def test_formats(spark):
    b = formats.parse_bibtex('@Article{k, title = {A {Deep} B}, author={X Y AND Z, W}, year={c. 1999}, note=bare, number="3", isbn={978-0}}\n@book{l, title="Later"}')
    assert (b["type"], b["title"], b["authors"], b["year"], b["issue"], b["isbn"]) == ("article", "Later", ["X Y", "Z, W"], "1999", "3", "9780")
    assert formats.parse_bibtex("none") is None and formats.parse_ris(None) is None
    r = formats.parse_ris("TY  - JOUR\r\nT1  - T\nA1  - B, C\nY1  - 2001/02\nSP  - 1\n")
    assert (r["type"], r["title"], r["authors"], r["year"], r["pages"]) == ("article", "T", ["B, C"], "2001", "1")
    df = spark.createDataFrame([("@misc{a, title={x}}",), (None,)], "t string")
    assert [x.r.title if x.r else None for x in df.select(formats.bibtex_udf("t").alias("r")).collect()] == ["x", None]


def test_ris_by_columns_equals_the_parser(spark):
    texts = ["TY  - JOUR\r\nT1  - T\nA1  - B, C\nAU  - \nAU  - D\nY1  - 2001/02\nSP  - 1\nEP  - 9\nSN  - 1234-567X", "ty - x", "", None, "  TY  - book\u2028TI  - One\x85TI  - Two\nPY  - n.d.\nDO  - \nM3  - 10.1/x\nUR  - 0\nL1  - u", "TI  -\nT1  - late \nPB  - \nCY  - Town"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string")
    got = {r.id: r.r and r.r.asDict() for r in formats.ris_record(df, "t", "r").collect()}
    for k, t in enumerate(texts):
        want = formats.parse_ris(t)
        assert (got[k] is None) == (want is None) and (want is None or all(want[f] == got[k][f] for f in got[k])), (t, want, got[k])
    assert formats.ris_record(df.limit(0), "t", "r").count() == 0


def test_pages(spark):
    html = '<title>Site</title><meta name="citation_title" content="A &amp; B"><meta name="citation_author" content="X"><meta name="citation_author" content="Y"><meta name="citation_date" content="2003/1"><meta content="no" name="author"><meta name="citation_firstpage" content="5">'
    df = spark.createDataFrame([(html, "https://a.b")], "h string, u string")
    r = df.select(pages.page_record("h", "u").alias("r")).first().r
    assert (r.type, r.title, r.authors, r.year, r.pages) == ("article", "A & B", ["X", "Y"], "2003", "5")
    assert df.select(pages.title_tag("h").alias("t")).first().t == "Site"
    n = spark.createDataFrame([("9780631140481 and 978-0-631-14048-1 or 979-1-2-34-5",)], "h string")
    assert n.select(pages.isbn13s("h").alias("x")).first().x == ["9780631140481"]


def test_providers_and_library(spark):
    row = ('{"message":{"title":["T"],"author":[{"given":"A","family":"B"},{"given":"","family":"C"}],"issued":{"date-parts":[[2001,2]]},"container-title":["J"],"DOI":"10.1/x"}}', '{"title":"O","type":"book-chapter","publication_year":1999,"authorships":[{"author":{"display_name":"N"}}],"biblio":{"first_page":"1","last_page":"1"},"doi":"https://doi.org/10.5555/abc"}', None)
    df = spark.createDataFrame([(1, *row), (2, None, row[1], None), (3, None, None, None)], "id long, c string, o string, s string").select("id", F.when(F.col("c").isNotNull(), providers.crossref("c")).alias("c"), F.when(F.col("o").isNotNull(), providers.openalex("o")).alias("o"), F.when(F.col("s").isNotNull(), providers.semantic_scholar("s")).alias("s"))
    got = {r.id: r for r in providers.believe(df, "id", [("crossref", "c"), ("openalex", "o"), ("semantic_scholar", "s")]).collect()}
    assert got[1].candidate.authors == ["B, A", "C"] and got[1].candidate.year == "2001" and len(got[1].trace) == 1
    assert (got[2].provider, got[2].candidate.type, got[2].candidate.pages, got[2].candidate.doi, len(got[2].trace)) == ("openalex", "book", "1", "10.5555/abc", 2)
    assert got[3].provider is None and len(got[3].trace) == 3
    item = spark.createDataFrame([('{"key":"K","data":{"itemType":"book","title":"T","creators":[{"lastName":"Li"},{"name":"Org"}],"date":"May 2001","ISBN":"978-0"}}',)], "t string").select(library.parse_item("t").alias("i")).select(library.item_record("i").alias("r")).first().r
    assert (item.authors, item.year, item.isbn, item.type) == (["Li,", "Org"], "2001", "9780", "book")
    c = spark.createDataFrame([([("author", "", "", "Li"), ("editor", "x", "", "Ed"), (None, "Solo", None, None)],)], "c array<struct<creatorType:string,name:string,firstName:string,lastName:string>>")
    assert c.select(library.translated_authors(F.col("c")).alias("a")).first().a == ["Li", "Solo"]


def _tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark, tmp_path):
    files = {"a/main.tex": b"\\documentclass{x}\\begin{document}Hi \\input{part} \\include{a/main}\\end{document}", "a/part.tex": "caf\xe9".encode("latin-1"), "../evil.tex": b"no", "notes.txt": b"x"}
    (tmp_path / "one.tar.gz").write_bytes(_tar(files))
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("b.tex", "only")
    (tmp_path / "three.bin").write_bytes(b"PK\x03\x04 broken")
    rows = {r.path.rsplit("/", 1)[1]: r for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert rows["one.tar.gz"].main_file == "a/main.tex" and "Hi" in rows["one.tar.gz"].text and "café" in rows["one.tar.gz"].text and "no" not in rows["one.tar.gz"].text
    assert (rows["two.zip"].format, rows["two.zip"].text) == ("zip", "only") and rows["three.bin"].text == ""
    kinds = spark.read.format("binaryFile").load(str(tmp_path)).select(archives.archive_format(F.col("content")).alias("k"))
    assert sorted(r.k for r in kinds.collect()) == ["tar.gz", "zip", "zip"]


def test_figures_and_staging(spark):
    tex = "\\begin{figure}[t]\\includegraphics[w]{img/A}\\caption{A \\emph{plot}}\\end{figure} \\includegraphics{none}"
    out = archives.substitute_figures(tex, "m/main.tex", {"m/img/a.png": b""})
    assert "![A *plot*](m/img/a.png)" in out and "Caption: A *plot*" in out and "includegraphics" not in out
    assert archives.substitute_figures(tex, "m/main.tex", {}) == tex
    media = spark.createDataFrame([("x/my fig.PNG", b"1"), ("y/my fig.png", b"2"), ("z/my fig.png", b"1"), ("q/___.eps", b"3")], "path string, content binary")
    assert {r.archive_path: r.staged_name for r in store.staged_names(media).collect()} == {"x/my fig.PNG": "my_fig.png", "y/my fig.png": "my_fig-1.png", "z/my fig.png": "my_fig.png", "q/___.eps": "image.eps"}


def test_guides_and_natural_order(spark):
    df = spark.createDataFrame([(" s\n\n## KEY CLAIMS\n\n- a ", ["b"], [" m\n1 ", "", None], None)], "s string, c array<string>, m array<string>, l array<string>")
    got = df.select(complete_guide(F.col("s"), F.col("c"), F.col("m"), F.col("l")).alias("g")).first().g
    assert got == " s\n\n## KEY CLAIMS\n\n- a\n\n## Methods / approach\n\n- m 1"
    names = spark.createDataFrame([("x10",), ("X9",), ("x1a",)], "n string")
    assert [r.n for r in names.orderBy(natural_key(F.col("n"))).collect()] == ["x1a", "X9", "x10"]


def test_stream_counts_a_session_once(spark, tmp_path):
    rows = [(1, "work", True, 60, dt.datetime(2024, 1, 1, 9)), (1, "work", True, 60, dt.datetime(2024, 1, 1, 9)), (2, "WORK ", True, 30, dt.datetime(2024, 1, 1, 10)), (3, "work", False, 30, dt.datetime(2024, 1, 1, 11)), (4, "work", True, 5, dt.datetime(2024, 2, 1))]
    schema = "id long, type string, completed boolean, duration_sec int, started_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = focus_by_window(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("focus").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.completed_count, r.focused_seconds) for r in spark.sql("select * from focus order by window_start").collect()] == [(2, 90), (1, 5)]
