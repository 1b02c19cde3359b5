"""Text problems: scans, web pages, residue, tokens, mixing, quality."""

import json
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import boilerplate, mixing, quality, residue, scans, tokenize
from folioforge.llm.webtext import evidence, is_content

SOURCES = "id long, title string, journal string, authors array<string>, url string, body_source string, body_text string"
CLASH = ["word", "kind", "source_id", "line_no", "host", "key", "recurs", "n_tokens", "copies", "open", "known", "docs", "part", "salt", "size"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def src(spark, rows):
    names = [f.split()[0] for f in SOURCES.split(", ")]
    return clashing(spark.createDataFrame([tuple({"body_source": "html", **r}.get(n) for n in names) for r in rows], SOURCES))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_trie_and_automaton_are_complete():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    trie = scans.build_trie(words)
    for _ in range(60):
        asked = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 7)))
        for k in (0, 1, 2, 3):
            assert sorted(scans.intersect(trie, asked, k)) == [w for w in words if distance(asked, w) <= k]


def test_misreadings():
    for seen, true in (("rnore", "more"), ("sepai-ated", "separated"), ("ha\\'e", "have"), ("toclay", "today"), ("es†imated", "estimated"), ("qiiesti0ned", "questioned")):
        assert scans.plausible(scans.misread_cost(seen, true), seen)
    assert not scans.plausible(scans.misread_cost("more", "core"), "more")


PROSE = "The harbour was measured in every season before the readers could be examined and the well-known measure remains without a border."


def test_scan_lines(spark):
    trusted = [{"id": i, "body_source": "txt", "body_text": PROSE + " the harbours measured before"} for i in range(5)]
    page = "\n".join(["12    ON THE QUIET HARBOUR", "The harbour was rneasured in eve-", "ry season before the well-", "known measure remains with¬", "- 13 -", "\fON THE QUIET HARBOUR", "out a bordcr and tlie readers."])
    rows = [*trusted, {"id": 50, "title": "On the quiet harbour", "body_source": "pdf_ocr", "body_text": page}, {"id": 51, "body_source": "pdf_ocr", "body_text": None}, {"id": 52, "body_source": "pdf_ocr", "body_text": " \n "}, {"id": 53, "body_source": "pdf_ocr+ai_cleaned", "body_text": PROSE}]
    got = {(r.source_id, r.line_no, r.kind) for r in scans.diagnose(src(spark, rows)).collect()}
    assert got == {(50, 1, "running"), (50, 2, "chars"), (50, 2, "hyphen"), (50, 4, "hyphen"), (50, 5, "running"), (50, 6, "running"), (50, 7, "chars")}
    fixed = {r.source_id: r.text for r in scans.repair(src(spark, rows)).collect()}
    assert fixed[50] == "The harbour was measured in every season before the well-known measure remains without a border and the readers."
    assert fixed[51] is None and fixed[52] == "" and fixed[53] == PROSE


def test_scans_of_nothing(spark):
    assert scans.diagnose(src(spark, [])).count() == 0
    assert scans.diagnose(src(spark, [{"id": 1, "body_source": "pdf_ocr", "body_text": "some words"}])).count() == 0


@pytest.mark.parametrize("line", ["404 Not Found", "Please enable JavaScript to view this page.", "{{title}}", "Abstract: [INSERT body HERE]", "Lorem ipsum dolor sit amet consectetur", "undefined", "Seite nicht gefunden", "TBD TBD TBD", "Your text here. Your text here."])
def test_evidence(line):
    assert evidence(line) and not is_content(line)


@pytest.mark.parametrize("line", ["A page that says 404 is, for the school, a record of a quiet loss.", 'The label "Access denied" was measured in 78 of the notations.', "Designers filled the edition with lorem ipsum until the measures came.", "Introduction"])
def test_no_evidence(line):
    assert not evidence(line)


def test_residue(spark):
    menu = "Home\nAbout us\nSearch by keyword, author or DOI"
    rows = [
        {"id": 1, "title": "Page not found", "body_text": PROSE}, {"id": 2, "title": "Error 404 and other sample manuscripts, Tefotinene", "body_text": PROSE}, {"id": 3, "title": "Preface", "body_text": menu + "\n404 Not Found"},
        {"id": 4, "title": "Preface", "body_text": menu}, {"id": 5, "title": None, "body_text": None}, {"id": 6, "title": "", "body_text": " \n"}, {"id": 7, "title": "{{doi}} - Tidewell Library", "body_text": ""}, {"id": 8, "title": "T", "body_text": PROSE + "\n404 Not Found"},
        {"id": 8, "title": "T", "body_text": PROSE}, {"id": 9, "title": "Access denied: the network of harbours, Gubiduma", "body_text": "null\nnull"}, {"id": 10, "title": "x", "body_text": "lorem ipsum dolor sit amet " * 20_000},
        *[{"id": 20 + i, "title": "x", "body_text": menu + "\n" + PROSE} for i in range(6)],
    ]
    got = {(r.source_id, r.part) for r in residue.residue(src(spark, rows)).collect()}
    assert got == {(1, "title"), (3, "body"), (7, "title"), (9, "body"), (10, "body")}
    assert residue.residue(src(spark, [])).count() == 0


def test_what_recurs_on_a_host_is_subtracted_whatever_it_says(spark):
    """A sentence that stands on all pages of a host saves no error page; the same sentence on one page of another host does."""
    sentence = "The Quillmere Press has published the records of the harbour and its readers since the year of 1871."
    own = lambda k: f"Case {'abcdefgh'[k]} of the harbour was measured before the readers of the market could be examined."
    pages = [{"id": 1 + k, "title": "A quiet title", "url": "https://a.test/x", "body_text": f"{sentence}\n{own(k)}"} for k in range(5)]
    rows = [*pages, {"id": 20, "title": "A quiet title", "url": "https://a.test/y", "body_text": f"{sentence}\n404 Not Found"}, {"id": 21, "title": "A quiet title", "url": "https://b.test/y", "body_text": f"{own(6)}\n404 Not Found"}]
    rows += [{"id": 30 + k, "title": "A quiet title", "url": "https://c.test/y", "body_text": f"{own(7)}\n404 Not Found"} for k in range(9)]  # copies of one text make nothing recur
    assert {(r.source_id, r.part) for r in residue.residue(src(spark, rows)).collect()} == {(20, "body")}


def page(i, rng):
    sentence = lambda: f"The {rng.choice(['harbour', 'reader', 'market'])} of case {rng.randint(1, 10**6)} was measured before the readers could be examined."
    lines, want = [], []
    for text, drop in [("Home", 1), ("Login", 1), ("Skip to content", 1), ("We use cookies to improve your experience. Accept all", 1), ("A quiet title of things", 0), (sentence(), 0), ("Introduction", 0), (sentence(), 0), ("Advertisement", 1), ("- " + sentence(), 0), ("Figure 2. Quiet readers, 1999", 0), (sentence(), 0), ("© 2020 Quillmere Press. All rights reserved.", 1), ("Contact us", 1)]:
        if rng.random() < 0.85:
            lines.append(text)
            if drop:
                want.append(len(lines))
            if rng.random() < 0.3:
                lines.append("")
    return {"id": i, "title": "A quiet title of things", "body_text": "\n".join(lines)}, [(i, k) for k in want]


def test_field_finds_furnishing_of_pages_it_was_not_trained_on(spark):
    rng = random.Random(1)
    made = [page(i, rng) for i in range(160)]
    df = src(spark, [p for p, _ in made] + [{"id": 900, "title": None, "body_text": None}, {"id": 901, "title": "t", "body_text": "Home\n404 Not Found\nLogin"}, {"id": 902, "title": "", "body_text": " "}])
    pages = boilerplate.pages_with_recurrence(df).cache()
    w, t = boilerplate.fit(pages, 160, 40)
    got = {(r.source_id, r.line_no) for r in pages.mapInArrow(boilerplate._decode(w, t, 160), "source_id long, line_no int").collect()}
    want = {x for _, k in made for x in k}
    assert len(got & want) / len(want) > 0.98 and len(got & want) / len(got) > 0.98 and not any(i >= 900 for i, _ in got)


def test_headings_are_told_by_where_they_stand():
    rng = random.Random(3)
    pages = [(["Menu", PROSE.split("\n")[0], f"{k}. What came of it", PROSE.split("\n")[0], rng.choice(["More to read", PROSE.split("\n")[0]]), "More to read"]) for k in range(boilerplate.HEADING_TIMES)]
    assert boilerplate.headings(pages) == {"what came of it"}
    assert boilerplate.headings([]) == frozenset() == boilerplate.headings([["Menu"]] * 50)


def test_no_label_is_a_feature():
    """Lines that label() tells apart by cue words or captions alone look the same to the field but for their words."""
    for a, b in (("Figure 2. Quiet readers, 1999", "Number 2. Quiet readers, 1999"), ("All rights reserved by the press of the harbour and its readers.", "Old rights observed by the press of the harbour and its readers.")):
        one, two = (set(boilerplate.features([x], None, {}, 10)[1][0].tolist()) for x in (a, b))
        assert {x for x in one ^ two if x < boilerplate._HASHED} == set()


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        score, t = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        paths = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        total = lambda p: sum(score[i, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert abs(total(boilerplate.viterbi(score, t)) - max(map(total, paths))) < 1e-9
    assert boilerplate.viterbi(np.zeros((0, 2)), np.zeros((2, 2))) == []


RANKS = tokenize.read_ranks()


def test_streamed_tokens_equal_the_whole(monkeypatch):
    machine = tokenize.Transducer(RANKS)
    whole = machine.encoding.encode_ordinary
    monkeypatch.setattr(tokenize, "CHUNK", 64)
    monkeypatch.setattr(tokenize, "LONG_PIECE", 64)
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "a", "the", "ing", "1", "23", "-", "==", "é", "'s", "'ll", "<|endoftext|>", "你好", " ", "🙂", "aaaa", " (", "\r\n"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 300)))
        ids = machine.encode(text)
        assert ids == whole(text) and "".join(tokenize.decode_stream(iter(ids), RANKS)) == text
    for text in ("a" * 20_000, "=" * 9999 + "-" * 9999, "x" + " " * 20_000 + "y", "".join(rng.choice("aeinrst") for _ in range(20_000)), "".join(rng.choice(string.printable) for _ in range(20_000))):
        assert machine.encode(text) == whole(text)


def test_long_pieces_are_read_in_windows(monkeypatch):
    machine = tokenize.Transducer(RANKS)
    whole = machine.encoding.encode_ordinary
    monkeypatch.setattr(tokenize, "CHUNK", 256)
    monkeypatch.setattr(tokenize, "LONG_PIECE", 64)
    rng = random.Random(12)
    run = lambda: rng.choice(["你好世界", "aeinrst", "!?='-*", "0123456789", " ", "\n", "é", "'s", "🙂", " \n\t"])
    for _ in range(60):
        text = "".join("".join(rng.choice(signs) for _ in range(rng.choice([1, 2, 5, 700, 3000]))) for signs in (run() for _ in range(rng.randint(1, 9))))
        assert machine.encode(text) == whole(text)
        assert not machine.tail and not machine.head and machine.run is None


def test_memory_is_bounded_in_texts_without_a_blank():
    machine, rng, most, count = tokenize.Transducer(RANKS), random.Random(1), 0, 0
    block = "".join(rng.choice("的一是不了人我在有他这为之大来以个中上们") for _ in range(tokenize.CHUNK))
    for k in range(60):  # 12 MB
        count += len(machine.feed(block[k:] + block[:k]))
        most = max(most, len(machine.tail) * 4 + len(machine.head))
    count += len(machine.finish())
    assert most < 8 * tokenize.CHUNK and count > tokenize.CHUNK


def test_tokens_of_rows(spark):
    df = clashing(spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, " \n"), (1, "Hello world"), (5, "<|endoftext|>")], "doc_id long, text string").withColumn("ids", F.lit(1)))
    got = sorted((r.doc_id, r.ids) for r in tokenize.encode(df).collect())
    assert got[0] == got[1] and got[0][1] and got[2][1] == [] and got[3][1] == [] and got[4][1] and len(got[5][1]) > 1 and 50256 not in got[5][1]
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(f"{tokenize.VOCABULARIES}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    assert got[5][1] == public.encode("<|endoftext|>", add_special_tokens=False).ids
    assert tokenize.encode(df.limit(0)).count() == 0


def test_trades_keep_the_total():
    rng = random.Random(2)
    for _ in range(500):
        a, b, wa, wb = rng.random(), rng.random(), rng.randint(1, 900), rng.randint(1, 900)
        x, y = mixing.trade(a, wa, b, wb, rng.random())
        assert abs(x * wa + y * wb - a * wa - b * wb) < 1e-6 and (x in (0.0, 1.0) or y in (0.0, 1.0)) and -1e-9 <= min(x, y) and max(x, y) <= 1 + 1e-9
    ups = [mixing.trade(0.3, 10, 0.6, 20, rng.random())[0] for _ in range(20_000)]
    assert abs(sum(ups) / len(ups) - 0.3) < 0.01


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(5, 40), "abc"[min(2, i % 7)]) for i in range(900)] + [(2000, None, "a"), (2001, "", "b"), (2002, "lost text", None), (2003, "other", "zz"), (2000, None, "a")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string")).repartition(7)
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.2, 2), ("c", 0.2, 1), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(df, targets)
    r = {x.source: x for x in report.collect()}
    assert r["none"].mix_tokens == 0 and all(r[s].most_copies <= r[s].max_repeats for s in r)
    for s, share in (("a", 5 / 9), ("b", 2 / 9), ("c", 2 / 9)):
        assert abs(r[s].actual_share - share) < 0.01
    again = mixing.mix(df, targets)[0]
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))
    bounded = {x.source: x for x in mixing.mix(df, targets, total=10**9)[1].collect()}
    assert all(bounded[s].mix_tokens == bounded[s].source_tokens * bounded[s].max_repeats for s in "abc")
    assert mixing.mix(df.limit(0), targets)[0].count() == 0 and mixing.mix(df, targets.limit(0))[0].count() == 0


def test_a_mix_is_the_same_however_the_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_PART", 7)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["quiet", "harbour", "of", "readers"]) for _ in range(rng.randint(1, 30))), rng.choice("ab")) for i in range(120)]
    targets = spark.createDataFrame([("a", 0.8, 3), ("b", 0.2, 2)], "source string, target_share double, max_repeats int")
    mixes = [{tuple(r) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n), targets)[0].collect()} for n in (1, 5)]
    assert mixes[0] == mixes[1] and mixes[0]
    with pytest.raises(ValueError):
        monkeypatch.setattr(mixing, "MOST_TARGETS", 1)
        mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), targets)


def test_quality(spark):
    common = spark.createDataFrame([("en", w, k) for k, w in enumerate("the of and a in to is was that it for as with were by be not this before".split())], "lang string, word string, word_rank int")
    prose = "the measure of the harbour was not what it was before and it is still with us"
    rows = [(1, prose), (2, "- careful dialect\n- informal river\n- early instrument\n- printed interview"), (3, None), (4, ""), (5, " \n\t"), (6, "reform " * 80), (7, "h2ozF+eloT2X6BcvWGZRnBWJEuZwi/OmtCz7ecKxR9YEnGziseNTOyA5Nf"), (8, prose + ":\n- one\n- two\n" + prose), (1, prose), (9, "word; " * 60_000), (10, "Short text."), (11, "| a | b | c |\n|---|---|---|\n| x | 1 | 2 |")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    stats = quality.text_statistics(df, common)
    assert sorted(r.doc_id for r in stats.filter(quality.not_prose()).collect()) == [2, 6, 7, 9, 11]
    s = {r.doc_id: r for r in stats.collect()}
    assert s[3].words == s[4].words == s[5].words == 0 and s[3].common_share is None and s[6].top_ngram_share == 1.0 and s[1].words == 17 and s[8].dup_line_share == 0
    assert quality.text_statistics(df.limit(0), common).count() == 0 and quality.text_statistics(df, common.limit(0)).count() == len(rows)
    assert json.dumps(s[1].asDict())


def test_repeated_paragraphs_are_found(spark, tmp_path):
    one = "The river was known to the people of the north and they gave it a name."
    other = "It was in the spring of that year that the first boats came to the harbour with salt."
    rows = [(1, f"{one}\n\n{other}"), (2, "\n\n".join([one, other] * 3)), (3, f"{one}\n\n{other}\n\n{one}"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("en", w, k) for k, w in enumerate("the was to of and they it a in that first with".split())], "lang string, word string, word_rank int").write.parquet(str(tmp_path / "common_words.parquet"))
    assert [r.doc_id for r in quality.QUERIES["p10_found"](spark, str(tmp_path)).collect()] == [2]
    got = {r.doc_id: tuple(r)[1:] for r in quality.QUERIES["p10_repetition"](spark, str(tmp_path)).collect()}
    assert got[2][1] == round(1 - 2 / 6, 6) and got[3][1] == round(1 - 2 / 3, 6) and got[1][:2] == (0.0, 0.0) and got[4] == (None,) * 4


def test_candidates_at_any_distance(spark, monkeypatch):
    vocab = spark.createDataFrame([("met", 9), ("rnet", 3), ("mct", 4), ("unrelated", 5)], "word string, docs long")
    asked = spark.createDataFrame([("rnct",)], "word string")
    want = {(c, cost) for c, cost in (("met", 0.6), ("rnet", 0.3), ("mct", 0.3))}
    for words in (50_000, 1):
        monkeypatch.setattr(scans, "SHARD_WORDS", words)
        assert {(r.candidate, round(r.cost, 1)) for r in scans.candidates(asked, vocab).collect()} == want
