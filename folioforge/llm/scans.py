"""Noise in text from scanned pages: page furniture, words broken across lines, misread words.

Words that stand in no trusted vocabulary are looked up by intersecting the Levenshtein automaton of the word
with a trie of the vocabulary, so that every word within the distance is a candidate; candidates are ranked by
the cost of the misreadings that explain them, then by how often they follow the word before (context) and by
frequency. Then furniture is removed, broken words are joined and lines reflowed into paragraphs. Running heads are the
record's own title, journal and people, what recurs in a text, and the wordings that the scans themselves show to be heads.

Scale: the vocabulary (words of at least MIN_DOCS trusted texts) is broadcast only when its counted rows are
within the bound of join_small, else joined by shuffle. For the candidate search up to SHARD_WORDS of it are broadcast,
each task builds the tries of the lengths it needs, and the words looked up are dealt once; a larger vocabulary is
sharded by length and hash, and words go to every shard within the distance. Pairs of words are counted only for those
of which several candidates are as good.

Defined cases: null, empty or blank texts yield no rows and keep their (null or blank) text; repeated records
yield repeated work but distinct rows per id and line; a null title, journal or author list only removes that
evidence; extra columns are ignored; a very long text is read whole.
"""

from __future__ import annotations

import bisect
import difflib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.runtime import cached, cut, join_small, table

MIN_DOCS = 3
MAX_EDITS = 3
SHARD_WORDS = 50_000

# What a scanner's reading shows in place of the true letters.
MISREADINGS = [
    ("rn", "m"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("i-", "r"), ("\\'", "v"), ("m", "in"), ("m", "rn"), ("m", "ni"),
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("9", "g"), ("8", "b"), ("†", "t"), ("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"),
    ("c", "e"), ("e", "c"), ("f", "e"), ("á", "a"), ("í", "i"), ("l", "i"), ("i", "l"), ("|", "l"), ("!", "l"), ("d", "cl"), ("h", "li"), ("n", "ri"), ("w", "vv"), ("u", "ii"),
]
#: Wordings are running heads of their own if so many scans, and that share of all, hold them, and that share of these more than once.
HEAD_DOCS, HEAD_SHARE, HEAD_TWICE = 5, 0.001, 0.2

_ODD = re.compile(r"[^\W\d_][0-9†|]|[0-9†|][^\W\d_]|[ſﬀﬁﬂ†]")
_BREAK = re.compile(r"([^\W\d_]+(?:[^\s\W]|[-†'\\])*)([-‐¬\xad])$")
_PAGE = r"(?:\d{1,5}|[ivxlc]{1,7})"
_BARE = re.compile(rf"^\W*(?:(?:page|p\.|pp\.|seite|página|s\.)\s*)?{_PAGE}(?:\s*(?:of|von|de|sur|/)\s*\d{{1,5}})?\W*$", re.IGNORECASE)
_LEAD = re.compile(rf"^\W*{_PAGE}(?:\s*\|\s*|\s+/\s+|\s{{3,}})(?=\S)", re.IGNORECASE)
_TAIL = re.compile(rf"(?:\s*\|\s*|\s+/\s+|\s{{3,}})(?:p\.\s*)?{_PAGE}\W*$", re.IGNORECASE)
_VOL = re.compile(r",?\s*vol\.\s*\S+.*$", re.IGNORECASE)
_ROMAN = re.compile(r"[ivxlc]+$", re.IGNORECASE)
_EDGES = " \t\r\f.,;:!?()[]{}\"“”„«»‹›‘’—–…*<>=/+&%#§"


_PLAIN = str.maketrans("01569†ſ", "olsbgts")
_HEADING = re.compile(r"\W*(?:\d+|[IVXLC]+|[A-Z])[.)]?\s")


def _fold(text: str) -> str:
    """Words in lower case, with letters in place of the signs read for them."""
    return " ".join(re.findall(r"[^\W_]+", text.translate(_PLAIN).casefold()))


class Known:
    """Texts that lines are held against, sorted for prefixes and indexed by word."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = sorted({x for x in texts if x})
        self.by_word: dict[str, list[int]] = {}
        for k, x in enumerate(self.texts):
            for w in set(x.split()):
                self.by_word.setdefault(w, []).append(k)

    def resembles(self, core: str) -> bool:
        """core is the beginning of a known text, or nearly so; only texts that hold half of its words are compared letter by letter."""
        if len(core) < 4:
            return False
        at = bisect.bisect_left(self.texts, core)
        if at < len(self.texts) and self.texts[at].startswith(core):
            return True
        if len(core) < 8:
            return False
        words = core.split()
        shared: dict[int, int] = {}
        for w in words:
            for k in self.by_word.get(w, ()):
                shared[k] = shared.get(k, 0) + 1
        for k, n in shared.items():
            if 2 * n >= len(words):
                for d in (0, 2):
                    if difflib.SequenceMatcher(None, core, self.texts[k][: len(core) + d], autojunk=False).ratio() >= 0.85:
                        return True
        return False


def furniture(lines: list[str], known: list[str]) -> set[int]:
    """Positions of the lines that are only a running header, a running footer or a page number."""
    found, cores = set(), {}
    names = Known(known)
    filled = [k for k, line in enumerate(lines) if line.strip()]
    if not filled:
        return found
    width = sorted(len(lines[k]) for k in filled)[len(filled) // 2]
    for k in filled:
        bare = lines[k].strip()
        if bare[-1] not in ".,;:?!" and _BARE.match(bare) and any(c.isalnum() for c in bare) and (any(c.isdigit() for c in bare) or len(bare) < 12):
            found.add(k)
            continue
        core = _LEAD.sub("", bare, count=1)
        numbered = core != bare
        short = _TAIL.sub("", core, count=1) if bare[-1].isalnum() else core
        numbered |= short != core
        title = _VOL.sub("", short)
        numbered |= title != short and numbered
        text = _fold(title)
        if not text:
            continue
        if numbered and len(bare) <= 2 * width:
            found.add(k)
        elif (bare[-1] != "." or len(bare.split()) > 3 or re.search(r"\b[A-Z]\.$", bare)) and names.resembles(text):
            found.add(k)
        if k in found or (bare[-1] not in ".,;:?!-‐¬\xad" and not _HEADING.match(bare)):
            cores.setdefault(text, []).append(k)
    for text, at in cores.items():  # what recurs under the same words
        if len(at) > 1 and len(text) > 3:
            found.update(at)
    single = {k for at in cores.values() for k in at} - found
    for n, k in enumerate(filled):  # at the edge of a page, a line that ends early and not as a sentence does
        if k in single and lines[k].lstrip("\f")[0] not in " \t" and len(lines[k].strip()) < 0.8 * width and not re.search(r"[^\W\d_]{3}[.;,] ", lines[k]):
            before, after = filled[n - 1] if n else None, filled[n + 1] if n + 1 < len(filled) else None
            if before is None or after is None or before in found or after in found or "\f" in lines[k] or "\f" in lines[after]:
                found.add(k)
    return found


def running_heads(scans: DataFrame) -> list[str]:
    """Wordings of short lines that stand more than once in a good share of the scans that hold them: heads no field of the record names.

    HEAD_SHARE of all scans hold each, so that what reaches the driver is a few thousand wordings at most, at any size.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col("line")), r"[^\p{L}\s]+", " "), r"\s+", " "))
    lines = scans.select("id", F.explode(F.split("body_text", "\n")).alias("line")).filter(~F.col("line").rlike(r"[.,;:?!\-‐¬\u00ad]\s*$")).select("id", plain.alias("wording"))
    lines = lines.filter((F.length("wording") > 3) & (F.size(F.split("wording", " ")) <= 6))
    held = lines.groupBy("id", "wording").agg(F.count("*").alias("n")).groupBy("wording").agg(F.count("*").alias("docs"), F.sum((F.col("n") > 1).cast("int")).alias("twice"))
    least = max(HEAD_DOCS, HEAD_SHARE * scans.count())
    return sorted(r.wording for r in held.filter((F.col("docs") >= least) & (F.col("twice") >= HEAD_TWICE * F.col("docs"))).collect())


def _title_words(*texts: str | None) -> set[str]:
    return {w for t in texts if t for w in re.findall(r"[^\W\d_]+", t.lower())}


@cached(1 << 16)
def _pieces(raw: str) -> tuple[str, ...]:
    """The words of what stands between blanks."""
    found = []
    for piece in re.split(r"’|(?<!\\)'", raw) if "’" in raw or "'" in raw else (raw,):
        word = piece.strip(_EDGES).lstrip("-").lower()
        if len(word) > 1 and any(c.isalpha() for c in word) and not _ROMAN.match(word) and "@" not in word and "://" not in word:
            found.append(word)
    return tuple(found)


def _tokens(line: str) -> list[str]:
    return [w for raw in line.split() for w in _pieces(raw)]


def analyse(text: str, title: str | None, journal: str | None, authors: list[str] | None, heads: list[str] = ()):
    """Furniture lines, words by line with the word before each, and line ends inside a word with the first piece of the next line of text and the word before."""
    lines = text.split("\n")
    people = [_fold(a) for a in authors or [] if a] + [_fold(" ".join(reversed(a.split(",", 1)))) for a in authors or [] if a and "," in a]
    drop = furniture(lines, [_fold(x) for x in (title or "", journal or "", *heads)] + people)
    own = _title_words(title, journal, *(authors or []))
    body = [k for k, line in enumerate(lines) if line.strip() and k not in drop]
    words, breaks, cut_left, cut_right = [], [], set(), set()
    for at, k in enumerate(body[:-1]):
        bare = lines[k].rstrip()
        m = bare[-1] in "-‐¬\xad" and _BREAK.search(bare.split()[-1])
        if not m:
            continue
        nxt = lines[body[at + 1]].split(maxsplit=1)[0]
        left, right = lines[k].split()[-1][:-1].lstrip(_EDGES).lower(), nxt.rstrip(_EDGES).lower()
        left = re.split(r"’|(?<!\\)'", left)[-1]
        if left and right[:1].isalnum() or right[:1] in "†ſ":
            breaks.append((k, m[2], left, right, body[at + 1], (["", *_tokens(" ".join(lines[k].split()[:-1]))])[-1]))
            cut_left.add(k)
            cut_right.add(body[at + 1])
    for k in body:
        line = lines[k].split()
        line = line[1 if k in cut_right else 0 : len(line) - (k in cut_left)]
        found = _tokens(" ".join(line))
        words.extend((k, w, p) for p, w in zip(["", *found], found, strict=False) if w not in own)
    return lines, drop, words, breaks


_ROWS = "source_id long, line_no int, kind string, word string, compound string, lead string, rest string, next_no int, before string"
_ARROW = pa.schema([("source_id", pa.int64()), ("line_no", pa.int32()), ("kind", pa.string()), ("word", pa.string()), ("compound", pa.string()), ("lead", pa.string()), ("rest", pa.string()), ("next_no", pa.int32()), ("before", pa.string())])


def _analyse_batches(heads: list[str]):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, text, title, journal, authors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text or not text.strip():
                    continue
                _, drop, words, breaks = analyse(text, title, journal, authors, heads)
                out.extend((i, k + 1, "running", None, None, None, None, None, None) for k in drop)
                out.extend((i, k + 1, "word", w, None, None, None, None, p) for k, w, p in dict.fromkeys(words))
                out.extend((i, k + 1, "break" if sign == "-" or sign == "‐" else "sign", left + right, f"{left}-{right}", left, right, nxt + 1, p) for k, sign, left, right, nxt, p in breaks)
            yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out, strict=True) if out else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)

    return run


def vocabulary(texts: DataFrame, column: str = "body_text", min_docs: int = MIN_DOCS) -> DataFrame:
    """word, docs: the words of all trusted texts, compounds whole and in parts, that stand in at least min_docs of them."""
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower(F.col(column)), r"[^\p{L}-]+"))).alias("word"))
    counted = words.filter(F.length("word").between(1, 40)).groupBy("word").agg(F.count("*").alias("docs"))
    parts = counted.withColumn("part", F.explode(F.array_distinct(F.concat(F.array("word"), F.split("word", "-")))))
    return parts.filter(F.col("part") != "").groupBy(F.col("part").alias("word")).agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)


def build_trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def intersect(trie: dict, word: str, edits: int) -> list[str]:
    """All words of the trie within the edit distance of word: the automaton's states, one bit a position, walk down the trie."""
    masks: dict[str, int] = {}
    for i, c in enumerate(word):
        masks[c] = masks.get(c, 0) | 1 << i
    final = 1 << len(word)
    start = tuple((1 << j + 1) - 1 for j in range(edits + 1))
    found, todo = [], [(trie, start)]
    while todo:
        node, state = todo.pop()
        for c, child in node.items():
            if c == "":
                if state[-1] & final:
                    found.append(child)
                continue
            mask = masks.get(c, 0)
            low = (state[0] & mask) << 1
            new = [low]
            for j in range(1, edits + 1):
                low = (state[j] & mask) << 1 | state[j - 1] | state[j - 1] << 1 | low << 1
                new.append(low)
            if low:
                todo.append((child, tuple(new)))
    return found


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _seen, _true in MISREADINGS:
    _BY_FIRST.setdefault(_seen[0], []).append((_seen, _true))


def misread_cost(seen: str, true: str) -> float:
    """Least cost of reading true as seen: 0.3 a known misreading, 1 any other edit."""
    n, m = len(seen), len(true)
    best = [[9.0] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            at = best[i][j]
            if at >= 9.0:
                continue
            if i < n and j < m:
                step = at + (seen[i] != true[j])
                if step < best[i + 1][j + 1]:
                    best[i + 1][j + 1] = step
            if i < n:
                best[i + 1][j] = min(best[i + 1][j], at + 1)
                for a, b in _BY_FIRST.get(seen[i], ()):
                    if seen.startswith(a, i) and true.startswith(b, j):
                        best[i + len(a)][j + len(b)] = min(best[i + len(a)][j + len(b)], at + 0.3)
            if j < m:
                best[i][j + 1] = min(best[i][j + 1], at + 1)
    return best[n][m]


def plausible(cost: float, word: str) -> bool:
    """A known misreading explains it; or the word holds signs no word has and little else differs."""
    return cost < 1.0 or bool(_ODD.search(word)) and cost <= 1.7


_FOUND = pa.schema([("word", pa.string()), ("candidate", pa.string()), ("cost", pa.float64()), ("docs", pa.int64())])


def _matches(word: str, tries, docs: dict[str, int], edits: int) -> list[tuple]:
    near = [(word, c, misread_cost(word, c), docs[c]) for trie in tries if trie for c in intersect(trie, word, edits)]
    return [x for x in near if plausible(x[2], word)]


def _look_up(known, edits: int):
    """Words against a broadcast vocabulary: a trie a length, built when the first word asks for it."""

    def run(batches):
        docs: dict[str, int] = known.value
        by_length: dict[int, list[str]] = {}
        for w in docs:
            by_length.setdefault(len(w), []).append(w)
        tries: dict[int, dict | None] = {}
        for batch in batches:
            rows: list[tuple] = []
            for word in batch.column(0).to_pylist():
                sizes = range(max(1, len(word) - edits), len(word) + edits + 1)
                for n in sizes:
                    if n not in tries:
                        tries[n] = build_trie(by_length[n]) if n in by_length else None
                rows.extend(_matches(word, [tries[n] for n in sizes], docs, edits))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, _FOUND, strict=True)], schema=_FOUND)

    return run


def candidates(words: DataFrame, vocab: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """word, candidate, cost, docs: all vocabulary words that plausibly were misread as word, found by trie and automaton.

    Every shard is searched up to the full distance, so what is found depends neither on the shards nor on other candidates.
    """
    spark = words.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = vocab.count()
    sql = "word string, candidate string, cost double, docs long"
    if size <= SHARD_WORDS:
        known = spark.sparkContext.broadcast({r.word: r.docs for r in vocab.select("word", "docs").collect()})
        return words.select("word").repartition(salts).mapInArrow(_look_up(known, edits), sql)
    split = -(-size // SHARD_WORDS)
    left = vocab.select("word", "docs", F.length("word").alias("size"), F.pmod(F.xxhash64("word"), F.lit(split)).alias("part"))
    right = words.select("word", F.explode(F.sequence(F.greatest(F.lit(1), F.length("word") - edits), F.length("word") + edits)).alias("size")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(split - 1).cast("long"))))

    def search(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(known) and len(asked):
            trie, docs = build_trie(known["word"].tolist()), dict(zip(known["word"], known["docs"], strict=True))
            for word in asked["word"]:
                rows.extend(_matches(word, [trie], docs, edits))
        return pd.DataFrame(rows, columns=["word", "candidate", "cost", "docs"])

    keys = ["size", "part"]
    return left.repartition(max(salts, split), *keys).groupBy(*keys).cogroup(right.repartition(max(salts, split), *keys).groupBy(*keys)).applyInPandas(search, sql)


def _scans(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("body_source").startswith("pdf_ocr"))


def _flag(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """column_known: whether the word in the column is in the vocabulary."""
    asked = known.select(F.col("word").alias("asked_"), F.lit(True).alias(f"{column}_known"))
    out = join_small(df.withColumnRenamed(column, "asked_"), asked, "asked_").withColumnRenamed("asked_", column)
    return out.withColumn(f"{column}_known", F.coalesce(f"{column}_known", F.lit(False)))


def study(sources: DataFrame) -> dict[str, DataFrame]:
    """All that is found out about the scans: furniture, misread words with their candidates, words torn by line ends."""
    trusted = sources.filter(~F.col("body_source").startswith("pdf_ocr") & F.col("body_text").isNotNull())
    vocab = cut(vocabulary(trusted))
    sent = _scans(sources).select(F.col("id").cast("long"), "body_text", "title", "journal", "authors")
    rows = cut(sent.mapInArrow(_analyse_batches(running_heads(sent)), _ROWS))

    words = rows.filter(F.col("kind") == "word").select("source_id", "line_no", "word", "before")
    words = join_small(words, vocab.select("word"), "word", "left_anti")
    parts = words.select("source_id", "line_no", "word", "before", F.posexplode_outer(F.when(F.col("word").contains("-"), F.split("word", "-"))).alias("n", "part"))
    parts = _flag(parts, "part", vocab).groupBy("source_id", "line_no", "word", "before").agg(F.bool_and(F.col("part_known") & F.col("part").isNotNull()).alias("all_known"))
    unknown = parts.filter(~F.col("all_known")).select("source_id", "line_no", "word", "before")

    ends = rows.filter(F.col("kind").isin("break", "sign")).select("source_id", "line_no", "kind", "word", "compound", "lead", "rest", "next_no", "before")
    for c in ("word", "compound", "lead", "rest"):
        ends = _flag(ends, c, vocab)
    own = (F.col("kind") == "break") & ~F.col("word_known") & (F.col("compound_known") | F.col("lead_known") & F.col("rest_known"))
    ends = cut(ends.withColumn("own", own))
    torn = ends.filter(~F.col("word_known") & ~F.col("own"))
    joined = torn.filter(F.length("lead") >= 3).select(F.col("compound").alias("word"), "before")
    asked = cut(unknown.select("word", "before").unionByName(torn.select("word", "before")).unionByName(joined).distinct())
    found = cut(candidates(asked.select("word").distinct(), vocab))
    best = cut(in_context(asked, found, trusted))

    torn = torn.join(best.select("word", "before", F.col("candidate").alias("whole"), F.col("cost").alias("whole_cost")), ["word", "before"], "left").join(best.select(F.col("word").alias("compound"), "before", F.col("candidate").alias("joined"), F.col("cost").alias("joined_cost")), ["compound", "before"], "left")
    kept = F.col("joined").contains("-") & (F.coalesce("joined_cost", F.lit(9.0)) <= F.coalesce("whole_cost", F.lit(9.0))) & (F.col("kind") == "break")
    torn = torn.withColumn("kept", F.coalesce(kept, F.lit(False))).withColumn("truth", F.when(F.col("kept"), F.col("joined")).otherwise(F.col("whole")))
    return {"rows": rows, "ends": ends, "torn": torn, "mended": unknown.join(best, ["word", "before"])}


def in_context(asked: DataFrame, found: DataFrame, trusted: DataFrame) -> DataFrame:
    """word, before, candidate, cost: of the candidates as good as the best by cost, the one that most often follows the word before in trusted texts, then the most frequent."""
    least = found.groupBy("word").agg(F.min("cost").alias("least"))
    close = found.join(least, "word").filter(F.col("cost") <= F.col("least") + 0.05).select("word", "candidate", "cost", "docs")
    open_ = close.join(close.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").select("word"), "word")
    several = cut(open_.select("candidate").distinct())
    tokens = F.filter(F.split(F.lower("body_text"), r"[^\p{L}-]+"), lambda w: w != "")
    texts = trusted.select(tokens.alias("t")).filter(F.size("t") > 1)
    pairs = texts.select(F.explode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("before"), F.slice("t", 2, F.size("t") - 1).alias("candidate"))).alias("p")).select("p.before", "p.candidate")
    pairs = join_small(pairs, several, "candidate", "left_semi").groupBy("before", "candidate").agg(F.count("*").alias("pairs"))
    ranked = asked.join(close, "word").join(pairs, ["before", "candidate"], "left")
    pick = F.max(F.struct(F.coalesce("pairs", F.lit(0)).alias("pairs"), (-F.col("cost")).alias("minus"), "docs", "candidate"))
    return ranked.groupBy("word", "before").agg(pick.alias("p")).select("word", "before", "p.candidate", (-F.col("p.minus")).alias("cost"))


def damaged_lines(s: dict[str, DataFrame]) -> DataFrame:
    """source_id, line_no, kind of what was found out."""
    hits = s["mended"].select("source_id", "line_no", F.lit("chars").alias("kind"))
    torn = s["torn"]
    in_lead = ~F.expr("startswith(truth, lead)")
    misread = torn.filter(F.col("truth").isNotNull()).select("source_id", F.when(in_lead, F.col("line_no")).otherwise(F.col("next_no")).alias("line_no"), F.lit("chars").alias("kind"))
    whole = s["ends"].filter(F.col("word_known") & ~F.col("own")).select("source_id", "line_no", F.lit("hyphen").alias("kind"))
    whole = whole.unionByName(torn.filter(~F.col("kept")).select("source_id", "line_no", F.lit("hyphen").alias("kind")))
    running = s["rows"].filter(F.col("kind") == "running").select("source_id", "line_no", "kind")
    return running.unionByName(hits).unionByName(misread).unionByName(whole).distinct()


def diagnose(sources: DataFrame) -> DataFrame:
    """source_id, line_no, kind: one row a damaged line and kind of damage."""
    return damaged_lines(study(sources))


def reflow(text: str, drop: set[int], joins: dict[int, bool], words: dict[tuple[int, str], str]) -> str:
    """Paragraphs of a scan: furniture out, words mended, torn words joined (with their hyphen if it is their own), lines run on."""
    out: list[str] = []
    tie, gap = "", False
    for k, line in enumerate(text.split("\n"), 1):
        if k in drop:
            continue
        bare = line.strip()
        if not bare:
            gap = True
            continue
        fresh = line.lstrip("\f").startswith("  ") or bool(_HEADING.match(bare)) and len(bare) < 40 and bare[-1] not in ".,;-"
        mended = []
        for raw in bare.split():
            word = raw.strip(_EDGES).lower()
            new = words.get((k, word))
            if new and word:
                at = raw.lower().find(word)
                new = new.capitalize() if raw[at : at + 1].isupper() else new
                raw = raw[:at] + new + raw[at + len(word) :]
            mended.append(raw)
        piece = " ".join(mended)
        ended = not out or out[-1][-1:] in ".!?:”\"" or fresh
        if tie == "":
            if out and not fresh and not (gap and ended):
                out[-1] += " " + piece
            else:
                out.append(piece)
        else:
            out[-1] += piece
        tie, gap = "", fresh and bool(_HEADING.match(bare)) and not line.startswith("  ")
        if k in joins:
            out[-1] = out[-1] if joins[k] else out[-1][:-1]
            tie = "-"
    return "\n\n".join(out)


def _reflow_batches(batches):
    for batch in batches:
        ids, texts = [], []
        for i, text, drop, joins, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(i)
            texts.append(None if text is None else reflow(text, set(drop or ()), {x["line_no"]: x["own"] for x in joins or ()}, {(x["line_no"], x["word"]): x["candidate"] for x in words or ()}))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["source_id", "text"])


def repair(sources: DataFrame) -> DataFrame:
    """source_id, text of each scan: continuous paragraphs. What is gathered is bounded by a document."""
    s = study(sources)
    per = lambda df, c: df.groupBy("source_id").agg(F.collect_list(F.struct(*[x for x in df.columns if x != "source_id"])).alias(c))
    running = s["rows"].filter(F.col("kind") == "running").groupBy("source_id").agg(F.collect_list("line_no").alias("furniture"))
    kept = s["torn"].select("source_id", "line_no", "kept")
    joins = s["ends"].join(kept, ["source_id", "line_no"], "left").select("source_id", "line_no", (F.col("own") | F.coalesce("kept", F.lit(False))).alias("own"))
    halves = s["torn"].filter("truth is not null and not startswith(truth, lead) and length(truth) > length(rest)")
    lead = halves.select("source_id", "line_no", F.concat("lead", F.lit("-")).alias("word"), F.expr("concat(left(truth, length(truth) - length(rest)), '-')").alias("candidate"))
    mended = s["mended"].groupBy("source_id", "line_no", "word").agg(F.max("candidate").alias("candidate"))
    texts = _scans(sources).select(F.col("id").cast("long").alias("source_id"), "body_text")
    joined = texts.join(running, "source_id", "left").join(per(joins, "joins"), "source_id", "left").join(per(mended.unionByName(lead), "words"), "source_id", "left")
    return joined.select("source_id", "body_text", "furniture", "joins", "words").mapInArrow(_reflow_batches, "source_id long, text string")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return diagnose(table(spark, directory, "sources"))


def p2_repaired(spark: SparkSession, directory: str) -> DataFrame:
    return repair(table(spark, directory, "sources"))


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
SQL: dict[str, str] = {}
