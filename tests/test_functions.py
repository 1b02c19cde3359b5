"""Scalar functions on hand-derived cases."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions import citations as C
from folioforge.functions import scores as S
from folioforge.functions import text as T
from folioforge.functions.latex import tex_to_text
from folioforge.functions.markup import align, blocks, plain_text, realign
from folioforge.functions.similarity import at_most, common_length, ratio
from folioforge.operators import activity as A
from folioforge.operators import checks as K

RECORD = "type string, title string, authors array<string>, year string, publisher string, journal string, volume string, issue string, pages string, doi string, isbn string, url string, accessed_at string, notes string, zotero_item_key string, origin_provider string"


def record(spark, **kw):
    row = {f.split()[0]: "" for f in RECORD.split(", ")} | {"authors": []} | kw
    return spark.createDataFrame([row], RECORD)


def one(df, c):
    return df.select(c.alias("x")).first().x


def value(spark, fn, text):
    return one(spark.createDataFrame([(text,)], "t string"), fn("t"))


@pytest.mark.parametrize(
    ("style", "want"),
    [
        ("apa", "Doe, Jane, & Roe, Rick. (2020). On Things. J. Test, 12(3), 1-9. https://doi.org/10.1000/xyz"),
        ("mla", 'Doe, Jane, and Roe, Rick. "On Things." J. Test, vol. 12, no. 3, 2020, pp. 1-9. doi:10.1000/xyz.'),
        ("chicago18", 'Doe, Jane, and Roe, Rick. "On Things." J. Test 12, no. 3 (2020): 1-9. https://doi.org/10.1000/xyz.'),
    ],
)
def test_article_citations(spark, style, want):
    r = record(spark, type="article", authors=["Doe, Jane", "Roe, Rick"], year="2020", title="On Things", journal="J. Test", volume="12", issue="3", pages="1-9", doi="10.1000/xyz")
    assert one(r, C.citation(style)) == want


@pytest.mark.parametrize(("style", "want"), [("apa", "Ludwig van Beethoven. (1999). Letters.. Pub."), ("mla", 'Ludwig van Beethoven. "Letters.." Pub, 1999.'), ("chicago18", "van Beethoven, Ludwig. Letters. Pub, 1999.")])
def test_book_citations(spark, style, want):
    assert one(record(spark, type="book", authors=["Ludwig van Beethoven"], year="1999", title="Letters.", publisher="Pub"), C.citation(style)) == want


def test_citation_edges(spark):
    for style in C.FORMATTERS:
        assert one(record(spark, authors=None), C.citation(style)) == ""
        assert one(record(spark, authors=["", "0", None]), C.citation(style)) == ""
    assert "[Video]." in one(record(spark, type=" VIDEO ", title="T"), C.apa())
    assert one(record(spark, type="website", title="T", url="https://a.b/c", accessed_at="2024-01-05"), C.chicago18()) == '"T." Accessed January 5, 2024. https://a.b/c.'
    assert one(record(spark, type="website", title="T", accessed_at="last May"), C.chicago18()) == '"T." Accessed last May.'
    assert one(record(spark, title="T", doi="HTTPS://DX.DOI.ORG/10.1/x"), C.identifier_link()) == "https://doi.org/10.1/x."
    assert one(record(spark, url="javascript:alert(1)"), C.identifier_link()) == ""
    assert one(record(spark, pages="1-2", journal="J"), C.apa(include_pages=False)) == "J."
    assert [value(spark, C.normalize_style, x) for x in ("Chicago", "xyz", " MLA ")] == ["chicago18", "apa", "mla"]


def test_scores(spark):
    full = {n: "x" for n in ("title", "year", "publisher", "journal", "volume", "issue", "pages", "doi", "isbn", "url", "notes", "zotero_item_key")} | {"authors": ["a"] * 9, "origin_provider": "zotero"}
    assert one(record(spark, **full), S.quality_score()) == 1.0 and one(record(spark), S.quality_score()) == 0.2 and one(record(spark), S.quality_reason()) == ""
    assert one(record(spark, **full), S.survival_score()) == 15.0


@pytest.mark.parametrize(
    ("left", "right", "similarity", "likely", "score"),
    [
        ({"doi": "10.1/A"}, {"doi": "10.1/a "}, 0.0, True, 1.0), ({}, {}, 0.98, False, 0.7), ({"authors": ["Doe"]}, {"authors": ["DOE "]}, 0.98, True, 0.9),
        ({"authors": ["D"], "year": "1"}, {"authors": ["D"], "year": "2"}, 0.93, False, 0.65), ({"year": "1"}, {"year": "1"}, 0.93, True, 0.65), ({"authors": ["D"], "year": "1"}, {"authors": ["D"], "year": "1"}, 0.1, False, 0.4),
    ],
)
def test_duplicate_rules(spark, left, right, similarity, likely, score):
    names = ("title", "authors", "year", "doi", "isbn", "zotero_item_key")
    pick = lambda d, p: record(spark, **d).select(*[F.col(n).alias(p + n) for n in names])
    s = pick(left, "l_").crossJoin(pick(right, "r_")).select(S.duplicate_signal(F.lit(similarity)).alias("s")).first().s
    assert (s.likely, s.score) == (likely, score)


def test_text_functions(spark):
    assert value(spark, T.normalize_isbn, "978–0–631–14048–1") == "9780631140481"
    assert value(spark, T.norm_text, "  The Étude: No. 1 ") == "the tude no 1"
    cases = {"https://example.org/10.1000/abc": "doi", "call 0415 123 456": "isbn", "https://example.org/x": "url", "@article{a, title={b}}": "bibtex", "x\n TY  - JOUR": "ris", "hello": "text", None: "text"}
    assert {k: value(spark, T.classify_input, k) for k in cases} == cases
    assert value(spark, T.ticket_date, "2024-13-45") == "2024-13-45" and value(spark, T.ticket_date, "soon") is None
    assert value(spark, T.free_text_query, "Can you please give me a Chicago 18 citation for the Seventh Seal the movie") == "Seventh Seal"
    assert value(spark, T.split_list, " a, ,b ,") == ["a", "b"] and value(spark, T.safe_url, "ftp://x/y") == ""
    assert value(spark, T.html_escape, "<a href=\"x\">'&'</a>") == "&lt;a href=&quot;x&quot;&gt;&#039;&amp;&#039;&lt;/a&gt;"
    assert value(spark, T.significant_words, "Ça über alles und the War") == ["über", "alles"]
    assert one(spark.range(1), T.clock(F.lit(61.2))) == "01:02"


def test_sessions_and_months(spark):
    df = spark.createDataFrame([("WORK ", 10, "a\r\nb  "), ("foo", 99999, None)], "type string, duration_sec int, notes string")
    rows = df.select(A.session_type().alias("t"), A.session_seconds().alias("d"), A.session_notes().alias("n")).collect()
    assert [tuple(r) for r in rows] == [("work", 30, "a\nb"), ("work", 14400, "")]
    assert one(spark.createDataFrame([("é" * 15,)], "notes string"), A.session_notes(most=21)) == "é" * 10
    assert [one(spark.range(1), A.window_months(F.lit(x))) for x in ("5", "100", "abc", "24x")] == [12, 60, 12, 24]
    assert one(spark.range(1), A.month_spine(F.lit("2024-11"), F.lit(4))) == ["2024-11", "2024-12", "2025-01", "2025-02"]
    toggled = spark.createDataFrame([(["2024-01"],)], "m array<string>")
    assert one(toggled, A.toggle_month(F.col("m"), F.lit("2024-01"))) == [] and one(toggled, A.toggle_month(F.col("m"), F.lit("2023-01"))) == ["2023-01", "2024-01"]


def test_month_rows(spark):
    saved = spark.createDataFrame([(0, "a", "S", "A", ""), (1, "a", "S", "again", ""), (2, "", "S", "x", ""), (3, "b", "T", "B", "tip b")], "pos int, id string, section string, label string, tooltip string")
    defaults = spark.createDataFrame([(0, "a", "S", "A", "tip a"), (1, "c", "S", "C", None), (2, "d", "U", "D", None)], "pos int, id string, section string, label string, tooltip string")
    rows = A.normalize_rows(saved, defaults).orderBy("at", "nth").collect()
    assert [(r.id, r.tooltip) for r in rows] == [("a", "tip a"), ("c", ""), ("b", "tip b"), ("d", "")]
    assert [r.opens for r in A.section_breaks(A.normalize_rows(saved, defaults)).orderBy("at", "nth").collect()].count(True) >= 3
    filled = spark.createDataFrame([("a", ["2024-02", "2024-13", "2024-01", "2024-02"]), ("z", ["2024-01"]), ("b", ["x"])], "row_id string, months array<string>")
    assert [tuple(r) for r in A.normalize_filled(filled, saved).collect()] == [("a", ["2024-01", "2024-02"])]


def test_markup():
    assert plain_text("# Head #\n\nsome **bold** and `c**d` [x **y**](http://a.b)\nmore\n- item\n1. num\n> quote\n```\ncode  \n```") == "Head\nsome bold and c**d x y more\nitem\nnum\nquote\ncode  "
    assert plain_text("just\r\ntext ") == "just\ntext " and plain_text(None) == ""
    assert [b["kind"] for b in blocks("## a\n\nb\n\n3. c")] == ["heading2", "paragraph", "ordered"]
    assert align("ab cd ab", 5, 7, "ab") == (6, 8) and align("abcab", 1, 2, "ab") == (0, 2) and align("x", 0, 1, " ") is None
    assert realign("ab cd ab", 0, 2, "ab") == ("ok", 0, 2) and realign("ab cd ab", 5, 7, "ab") == ("fixed", 6, 8) and realign("ab", 0, 2, "zz") == ("lost", 0, 2) and realign(None, 0, 2, "a") == ("skipped", 0, 2)
    assert realign("a😀bc", 2, 3, "b")[0] == "ok"


def test_tex():
    text = tex_to_text("\\documentclass{a} % c\n\\title{T \\& U}\n\\begin{document}\n\\maketitle\n\\section{One} Hello\\footnote{n} \\emph{w} --- ``q'' \\cite{k} 5\\% % gone\n\\begin{figure}x\\end{figure}\\begin{enumerate}\\item a \\item b\\end{enumerate}\\end{document} after")
    assert text.startswith("# T & U\n\n# One\n\n Hello (n) *w* — “q” (k) 5%") and "1. a\n2. b" in text and "after" not in text and "gone" not in text
    assert tex_to_text(None) == "" and tex_to_text("plain") == "plain"
    nested = "\\begin{itemize}\\item one \\begin{enumerate}\\item[x] in\\end{enumerate}\\item two\\end{itemize}"
    assert tex_to_text(nested) == "- one\n\n1. in\n- two"
    cases = {"a\\\\[2pt]b": "a\nb", "\\href{http://a.b/\\_c}{\\textbf{t}}": "[**t**](http://a.b/_c)", "\\citep[see][p. 2]{k,l}": "(k,l)", "\\foo[o]{kept} \\bar x": "kept x", "\\begin{center}c\\end{center}": "centerccenter", "\\label{x}y~z": "y z", "{\\it a}": "a", "\\begin{equation*}x\\begin{equation}y\\end{equation}\\end{equation*}z": "z", "\\section[s]{Two \\emph{w}}": "# Two *w*", "a\\,b \\, c": "ab \\, c", "\\begin{figure}open": "figureopen", "{" * 500 + "x" + "}" * 500: "x", "\\emph{" * 300 + "x" + "}" * 300: None}
    for tex, want in cases.items():
        assert want is None or tex_to_text(tex) == want, tex


def test_similarity():
    assert common_length("world", "word") == 4 and ratio("", "a") == 0.0 and ratio("abc", "abc") == 1.0
    for a, b in (("abcd", "dcba"), ("hello there", "help there"), ("aaa", "aab")):
        assert ratio(a, b) <= at_most(a, b) <= 1


def test_checks(spark):
    rec = F.struct(F.lit("Deep Rivers").alias("title"), F.array(F.lit("Doe, Jane")).alias("authors"), F.lit("2001").alias("year"), F.lit("10.1/x").alias("doi"), F.lit("").alias("isbn"))
    assert one(spark.range(1), K.grounded(rec, F.lit("short"))).doi == "10.1/x"
    assert one(spark.range(1), K.grounded(rec, F.lit("zzz " * 80))) is None
    assert one(spark.range(1), K.grounded(rec, F.lit("zzz " * 80 + "jane doe"))).doi == ""
    names = spark.createDataFrame([("gpt-4o-mini",), ("gpt-4o",), ("gpt-4-audio",), ("o1-preview",), ("gpt-9",)], "n string")
    assert [r.n for r in names.filter(K.is_chat_model(F.col("n"))).orderBy(K.model_rank(F.col("n"))).collect()] == ["gpt-4o", "gpt-4o-mini", "o1-preview", "gpt-9"]
    trace = spark.createDataFrame([([("a", "success"), ("b", "no_result"), ("c", "success")],)], "t array<struct<step:string,status:string>>")
    assert one(trace, K.trace_summary(F.lit("doi"), F.col("t"))) == "DOI resolved via c." and one(spark.range(1), K.trace_summary(F.lit(""), F.lit(None).cast("array<struct<step:string,status:string>>"))) == "Parsed."
    a, b = F.array(F.lit("Doe, Jane")), F.array(F.lit("Jane DOE"))
    assert one(spark.range(1), K.isbn_answer_matches(F.lit("Deep Rivers"), a, F.lit("Rivers, deep and wide"), b)) and not one(spark.range(1), K.isbn_answer_matches(F.lit("Deep Rivers"), a, F.lit("Other"), F.array(F.lit("X Y"))))
