import datetime as dt
import itertools
import random
import time

import numpy as np
import pytest

from folioforge.functions.similarity import common_length, ratio
from folioforge.operators import dedupe

WS = b" \t\n\r\x0b\x00"


def plain(notes: list[tuple[int, bytes]]) -> bytes:
    """Notes appended as the library does it, the whole text read for each."""
    text = notes[0][1]
    for i, note in notes[1:]:
        note = note.strip(WS)
        if note and note not in text:
            text = text.rstrip(WS) + b"\n\nMerged from source #%d:\n" % i + note
    return text


def test_a_group_of_many_notes_is_merged_in_proportion(spark):
    draw = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ha", "be", "ko", "lu") for b in ("rbo", "ren", "sti") for c in ("ur", "a", "el", "in", "ost")]
    notes = ["first  \n"] + [draw.choice(["", " TODO ", "cf. draft", "There is little reason to believe that " + " ".join(draw.choices(words, k=40))]) for _ in range(19_999)]
    notes[15_000] = notes[40] + "\n\nMerged from source #"
    cols = [*dedupe.MERGED, "zotero_item_key", "origin_provider"]
    rows = [dict.fromkeys(cols, "") | {"id": i, "notes": n, "authors": [f"a{i % 7}"], "created_at": dt.datetime(2024, 1, 1)} for i, n in enumerate(notes, 1)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} string" for c in cols) + ", notes string, authors array<string>, created_at timestamp")
    groups = df.selectExpr("id", "1L as group_id").localCheckpoint()
    keep = spark.createDataFrame([(1, len(rows), 1, 1.0)], "group_id long, size long, keep_id long, keep_score double")
    began = time.time()
    merged = dedupe.merge_groups(groups, df, keep).select("notes", "authors").first()
    took = time.time() - began
    assert merged.notes.encode() == plain([(i, n.encode()) for i, n in enumerate(notes, 1)])
    assert len(merged.authors) == 7
    assert took < 60, took


@pytest.mark.parametrize("gram, step", [(12, 16), (2, 3), (1, 2)])
def test_appended_notes_equal_a_search_of_the_whole_text(monkeypatch, gram, step):
    for name, value in (("GRAM", gram), ("STEP", step), ("LONG", gram + step - 1)):
        monkeypatch.setattr(dedupe, name, value)
    draw = random.Random(gram)
    for _ in range(1500):
        notes: list[tuple[int, bytes]] = []
        for _ in range(draw.randint(1, 25)):
            kind = draw.random()
            if kind < 0.4 or not notes:
                text = bytes(draw.choice(b"ab \n#") for _ in range(draw.randint(0, draw.choice([3, 12, 60]))))
            elif kind < 0.7:
                at = draw.randint(0, len(so_far := plain(notes)))
                text = so_far[at : at + draw.randint(1, 60)]
            else:
                text = draw.choice([b"Merged from source", b" source #1", "für – ü".encode(), b"a" * draw.randint(1, 50), b" " + notes[-1][1] + b"\n"])
            notes.append((draw.randint(1, 99), text))
        assert dedupe.appended(notes) == plain(notes)


def test_letters_in_common_equal_a_nested_loop(monkeypatch):
    monkeypatch.setattr(dedupe, "FEW", 0)
    monkeypatch.setattr(dedupe, "ROWS", 5)
    draw = random.Random(9)
    base = ["".join(draw.choices("aabcdeeinrst 019", k=draw.choice([4, 30, 33, 200]))) for _ in range(12)]
    a, b = (["".join(c for c in draw.choice(base) if draw.random() > 0.06) for _ in range(60)] + ["", "ö ß"] for _ in range(2))
    shared = lambda p, q: sum(min(p.count(c), q.count(c)) for c in dedupe.LETTERS)
    size = lambda t: sum(t.count(c) for c in dedupe.LETTERS)
    for levels, least in itertools.product((2, 16), (0.9, 0.97)):
        monkeypatch.setattr(dedupe, "LEVELS", levels)
        for x, y in ((a, b), (a, a)):
            want = {(i, j) for i, p in enumerate(x) for j, q in enumerate(y) if (x is not y or i < j) and 2 * shared(p, q) >= least * (size(p) + size(q)) - 1e-9}
            got = [tuple(map(int, r)) for r in dedupe.can_reach(x, y, least)]
            assert len(got) == len(set(got)) and set(got) == want


def test_similar_titles_of_a_full_year_in_time(spark):
    draw = np.random.default_rng(3)
    words = ["".join(draw.choice(list("aeiorstn"), 6)) for _ in range(400)]
    titles = sorted({" ".join(draw.choice(words, 8)) for _ in range(3000)})
    edited = [t.replace(" ", "", 1) + "e" for t in titles[::10]]
    rows = [("1999", t, i, i) for i, t in enumerate([*titles, *edited])]
    began = time.time()
    got = {tuple(r) for r in dedupe.near_titles(spark.createDataFrame(rows, "k string, t string, rep long, created long"), 0.9).collect()}
    took = time.time() - began
    assert {(len(titles) + k, 10 * k) for k in range(len(edited))} <= got
    assert all(ratio(rows[p][1], rows[q][1]) >= 0.9 for p, q in got)
    assert took < 60, took


def test_common_letters_by_definition():
    def simple(a: str, b: str) -> int:
        found = [(-n, i, j) for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]]
        if not found:
            return 0
        n, i, j = min(found)
        return -n + simple(a[:i], b[:j]) + simple(a[i - n :], b[j - n :])

    draw = random.Random(2)
    for _ in range(1500):
        a = "".join(draw.choices("abc ", k=draw.randint(0, 14)))
        b = "".join(draw.choices("abc ", k=draw.randint(0, 14))) if draw.random() < 0.5 else "".join(c for c in a if draw.random() > 0.2)
        assert common_length(a, b) == simple(a, b)
        for least in (0.5, 0.9, 0.97):
            assert (ratio(a, b, least) >= least) == (ratio(a, b) >= least)
