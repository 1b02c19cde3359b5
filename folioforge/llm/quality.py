"""Per-document text quality statistics, and by combined rules the texts that are lists, tables or junk.

words: runs of signs other than white space (blank, tab, line feed, return, vertical tab, form feed).
mean_word_len: signs a word. symbol_ratio: share of signs that are neither letter, digit nor white space.
punct_line_share: share of non-blank lines that end in . ! ? … : ; " ” » or ). common_share: the largest share,
over the languages given, of words that, stripped of signs at both ends, are frequent words of the language;
the language is not taken from the row, where it is often wrong. dup_line_share and dup_para_share: share of
non-blank lines and paragraphs that repeat an earlier one. top_ngram_share: share of the signs of words covered by
the most frequent run of one to four words, if it comes at least three times. prose_share: share of signs in
lines that hold three words and more, frequent words among them and not mostly figures.

Scale: one scan without a shuffle; the frequent words are a fixed table of a few KB. Memory is that of one text.

Defined cases: null, empty and blank texts have 0 words and null shares and are never found; repeated rows yield
repeated rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import functools
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.runtime import cached, table

_SPACE = " \t\n\r\x0b\x0c"
_SYMBOL = regex.compile(r"[^\p{L}\p{N} \t\n\r\x0b\x0c]")
_STRIP = regex.compile(r"^[^\p{L}]+|[^\p{L}]+$")
_ENDS = tuple(".!?…:;\"”»)")
_PARAGRAPH = regex.compile(r"\n[ \t\r]*\n")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("words", pa.int64()), *((c, pa.float64()) for c in ("mean_word_len", "symbol_ratio", "punct_line_share", "common_share", "dup_line_share", "dup_para_share", "top_ngram_share", "prose_share"))])
SCHEMA = "doc_id long, words long, mean_word_len double, symbol_ratio double, punct_line_share double, common_share double, dup_line_share double, dup_para_share double, top_ngram_share double, prose_share double"


def _repeated(parts: list[str]) -> float:
    return 1 - len(set(parts)) / len(parts) if parts else 0.0


def _top_ngram(words: list[str]) -> float:
    """Share of the words' signs under the most frequent run of 1 to 4 words, of those that come three times and more."""
    total = sum(map(len, words))
    runs = Counter(words)
    best = max((times * len(w) for w, times in runs.items() if times >= 3), default=0)
    for n in range(2, 5):  # a longer run comes no more often than its parts
        longer = Counter(zip(words, words[1:], strict=False)) if n == 2 else Counter(tuple(words[k : k + n]) for k in starts if k + n <= len(words))
        again = {run for run, times in longer.items() if times >= 3}
        if not again:
            break
        best = max(best, *(longer[run] * sum(map(len, run)) for run in again))
        firsts = {run[0] for run in again}
        starts = [k for k, w in enumerate(words) if w in firsts and tuple(words[k : k + n]) in again]
    return min(total, best) / total


@cached(1 << 15)
def _is_symbol(sign: str) -> bool:
    return bool(_SYMBOL.match(sign))


def known_words(common: list[frozenset[str]]):
    """A function from a word as typed to a bit for each list that holds it stripped of signs, and a bit above these if it holds a figure."""
    bits: dict[str, int] = {}
    for k, words in enumerate(common):
        for w in words:
            bits[w] = bits.get(w, 0) | 1 << k
    figure = 1 << len(common)

    @cached(1 << 16)
    def look(word: str) -> int:
        bare = word if word.isalpha() else _STRIP.sub("", word)
        return bits.get(bare.lower(), 0) | (figure if any(map(str.isdigit, word)) else 0)

    return look


def statistics(text: str | None, common: list[frozenset[str]], look=None) -> tuple:
    spaced = functools.reduce(lambda t, c: t.replace(c, " "), _SPACE.replace(" ", "").replace("\n", ""), text or "")
    by_line = [[w for w in line.split(" ") if w] for line in spaced.split("\n")]
    words = [w for own in by_line for w in own]
    if not words:
        return (0, *[None] * 8)
    look = look or known_words(common)
    figure = 1 << len(common)
    lines = [x.strip(_SPACE) for x in text.split("\n")]
    lines = [x for x in lines if x]
    paragraphs = [p for p in (x.strip(_SPACE) for x in _PARAGRAPH.split(text)) if p] if "\n" in text else [text]
    times: Counter = Counter()
    signs = prose = 0
    for line, own_words in zip(lines, filter(None, by_line), strict=True):
        own = Counter(map(look, own_words))
        for k, v in own.items():
            times[k] += v
        n = len(own_words)
        hits = n - own[0] - own[figure]
        signs += len(line)
        if n >= 3 and hits >= 0.15 * n and sum(v for k, v in own.items() if k & figure) < 0.4 * n:
            prose += len(line)
    shares = [sum(v for k, v in times.items() if k >> lang & 1) for lang in range(len(common))]
    symbols = sum(n for sign, n in Counter(text).items() if _is_symbol(sign))
    return (len(words), sum(map(len, words)) / len(words), symbols / len(text), sum(x.endswith(_ENDS) for x in lines) / len(lines), max(shares, default=0) / len(words), _repeated(lines), _repeated(paragraphs), _top_ngram([w.lower() for w in words]), prose / signs)


def _measure(common: list[list[str]]):
    def run(batches):
        sets = [frozenset(c) for c in common]
        look = known_words(sets)
        for batch in batches:
            rows = [(i, *statistics(t, sets, look)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_SCHEMA), _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def text_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """The statistics of each document. common_words (lang, word, word_rank) is a small fixed table and is read to the driver."""
    common = [sorted(r[0]) for r in common_words.filter(F.col("word").isNotNull()).groupBy("lang").agg(F.collect_set("word")).orderBy("lang").select("collect_set(word)").collect()]
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measure(common), SCHEMA)


def not_prose() -> F.Column:
    """Combined rules: mostly lines without a language's frequent words, or hardly any in the whole; or one run of words throughout; or hardly a letter; or mostly paragraphs that repeat others."""
    few = F.col("words") < 4
    return (F.col("words") > 0) & (
        (~few & (F.col("prose_share") < 0.5))
        | ((F.col("words") >= 25) & (F.col("common_share") < 0.2))
        | ((F.col("words") >= 6) & (F.col("top_ngram_share") > 0.6) & (F.col("common_share") < 0.5))
        | (F.col("symbol_ratio") > 0.4)
        | (F.col("mean_word_len") > 25)
        | (~few & (F.col("dup_line_share") > 0.8) & (F.col("punct_line_share") < 0.5))
        | (~few & (F.col("dup_para_share") > 0.5))
    )


def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    stats = text_statistics(table(spark, directory, "documents"), table(spark, directory, "common_words"))
    return stats.filter(not_prose()).select("doc_id")


def p10_stats(spark: SparkSession, directory: str) -> DataFrame:
    stats = text_statistics(table(spark, directory, "documents"), table(spark, directory, "common_words"))
    return stats.select("doc_id", "words", *(F.round(c, 6).alias(c) for c in ("mean_word_len", "symbol_ratio", "punct_line_share", "common_share")))


def p10_repetition(spark: SparkSession, directory: str) -> DataFrame:
    """The statistics on repetition and prose, which p10_stats does not hold."""
    stats = text_statistics(table(spark, directory, "documents"), table(spark, directory, "common_words"))
    return stats.select("doc_id", *(F.round(c, 6).alias(c) for c in ("dup_line_share", "dup_para_share", "top_ngram_share", "prose_share")))


QUERIES = {"p10_found": p10_found, "p10_stats": p10_stats, "p10_repetition": p10_repetition}
SQL = {
    "p10_stats": r"""
WITH d AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\x0b\x0c]+'), lambda w: w <> '') AS ws,
         list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda l: l <> '') AS ls
  FROM documents),
common AS (SELECT lang, list(word) AS cw FROM common_words GROUP BY lang),
shares AS (
  SELECT doc_id, max(len(list_filter(ws, lambda w: list_contains(cw, lower(regexp_replace(regexp_replace(w, '^[^\p{L}]+', ''), '[^\p{L}]+$', '')))))) AS hits
  FROM d, common GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS words,
  CASE WHEN len(ws) > 0 THEN round(list_sum(list_transform(ws, lambda w: length(w))) / len(ws), 6) END AS mean_word_len,
  CASE WHEN len(ws) > 0 THEN round((length(text) - length(regexp_replace(text, '[^\p{L}\p{N} \t\n\r\x0b\x0c]', '', 'g'))) / length(text), 6) END AS symbol_ratio,
  CASE WHEN len(ws) > 0 THEN round(len(list_filter(ls, lambda l: right(l, 1) IN ('.', '!', '?', '…', ':', ';', '"', '”', '»', ')'))) / len(ls), 6) END AS punct_line_share,
  CASE WHEN len(ws) > 0 THEN round(hits / len(ws), 6) END AS common_share
FROM d JOIN shares USING (doc_id)
"""
}
