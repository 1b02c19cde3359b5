"""Page boilerplate mixed with main content: a linear-chain conditional random field over the lines of a page.

A body holds the text of the page's leaf blocks, one a line, without tags; what a line looks like, its words, its
neighbours, position and recurrence over the corpus stand in for ancestor tags. The field is trained by gradient
ascent on about SAMPLE_PAGES pages (a documented bound; those of smallest hash, none over SAMPLE_LETTERS letters)
and decodes every page by Viterbi. The pages of the sample are labelled by distant evidence that is no feature of the
field: sentences told from furnishing by cue words, agreement with the record's title, captions, and headings by where
lines of one wording stand over the sample: within articles and never below their last sentence, as furniture does.

Scale: one scan with a join of recurring lines; the weights are a few KB. Line recurrence is counted over all
different pages, pre-aggregated by hash of the line before its shuffle, and used as a share of the pages. Only the
pages of the sample reach the driver.

Defined cases: null, empty and blank bodies yield no rows; a body of which the field keeps no line of several words yields none
either; a repeated record yields its lines as often as it is repeated; a null title only removes that evidence; very
long bodies are decoded whole; extra columns are ignored; on an empty table the field stays untrained and yields nothing.
"""

from __future__ import annotations

import difflib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.webtext import _ENDED, _SEPARATED, FURNISHING, evidence, is_content, line_key
from folioforge.runtime import cached, cut, join_small, table

SAMPLE_PAGES, SAMPLE_LETTERS = 600, 50_000
BUCKETS = 2048
EPOCHS = 250
RECURS = 4
HEADING_TIMES = 30

_NUMBERED = re.compile(r"^(?:\d+(?:\.\d+)*[.)]?|(?:[IVX]+|[A-Z])[.)])\s+")
_CAPTION = re.compile(r"^(?:figure|fig\.|table|abbildung|tabelle|tableau|figura|tabla|plate|map|chart)\s+[\dIVX]+\s*[.:]", re.IGNORECASE)
_BULLET = re.compile(r"^\s*(?:[-–•*·‣]|\(?\d+[.)])\s+")
_FLAGS = ["bias", "ended", "separated", "bullet", "numbered", "upper", "at_sign", "digits", "url", "gap_before", "gap_after", "ended_before", "ended_after", "below_first", "above_last", "recurs", "recurs_1000", "recurs_100", "lone", "lone_above", "lone_below", "shared_1", "shared_2", "shared_3", "shared_first"]
_SIZES = [1, 2, 3, 4, 6, 9, 14, 25, 60]
_PLACES = [0, 1, 2, 4, 8]
_AT = {name: k for k, name in enumerate(_FLAGS)}
_SIZE, _BEFORE, _AFTER = (len(_FLAGS) + k * (len(_SIZES) + 2) for k in range(3))
_TOP, _END = (len(_FLAGS) + 3 * (len(_SIZES) + 2) + k * (len(_PLACES) + 1) for k in range(2))
_HASHED = _END + len(_PLACES) + 1
WIDTH = _HASHED + BUCKETS
PER_LINE = 30


def _words(line: str) -> list[str]:
    return re.findall(r"[^\W\d_]+|[©▾☰↑«»|·>@]", line.lower())


def near_title(line: str, title: str) -> bool:
    if not title or not line:
        return False
    a, b = line.casefold(), title.casefold()
    if a == b:
        return True
    if abs(len(a) - len(b)) > 0.5 * max(len(a), len(b)) or len(a.split()) < 4:
        return False
    x, y = set(re.findall(r"\w+", a)), set(re.findall(r"\w+", b))
    if len(x & y) < 0.4 * min(len(x), len(y)):
        return False
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.75 or len(x & y) >= 0.8 * max(len(x), len(y))


def own_title(texts: list[str], title: str | None, prose: list[bool], recurs: list[int]) -> int | None:
    """Which line is the page's own title: the first that resembles the record's, else, above the prose, the first that looks like one and recurs on no other pages."""
    near = next((k for k, x in enumerate(texts) if near_title(x, title or "")), None)
    if near is not None or True not in prose:
        return near
    above = texts[: prose.index(True)]
    return next((k for k, x in enumerate(above) if not recurs[k] and len(x.split()) >= 5 and not re.search(r"[.!:;…]$", x) and not FURNISHING.search(x) and not _SEPARATED.search(x) and " / " not in x and not evidence(x)), None)


@cached(1 << 14)
def _look(text: str) -> tuple[int, bool, list[int], list[int], frozenset[str]]:
    """Of a line by itself: words, whether it ends as a sentence does, feature indices of its look and of its words, and its words as a set."""
    n, tokens = len(text.split()), _words(text)
    ended = bool(_ENDED.search(text))
    on = [("ended", ended), ("separated", n > 2 and bool(_SEPARATED.search(text))), ("bullet", bool(_BULLET.match(text))), ("numbered", bool(_NUMBERED.match(text))), ("upper", text.isupper()), ("at_sign", "@" in text), ("digits", any(map(str.isdigit, text))), ("url", "://" in text)]
    hashed = [_HASHED + zlib.crc32(w.encode()) % BUCKETS for w in dict.fromkeys([*tokens[:5], *tokens[-2:]])]
    if n <= 4:
        hashed.append(_HASHED + zlib.crc32(("=" + " ".join(tokens)).encode()) % BUCKETS)
    return n, ended, [_AT[name] for name, f in on if f], hashed, frozenset(re.findall(r"\w+", text.casefold()))


_BINS = [sum(n > s for s in _SIZES) for n in range(_SIZES[-1] + 2)]
_PLACE = [sum(n > x for x in _PLACES) for n in range(_PLACES[-1] + 2)]


def features(lines: list[str], title: str | None, recurs: dict[int, int], pages: int) -> tuple[list[int], np.ndarray, list[bool]]:
    """Numbers of the non-blank lines, their feature indices (padded with WIDTH), and which of them are long sentences.

    recurs gives the pages that hold a line, of all pages. Nothing of label() is a feature.
    """
    at = [k for k, x in enumerate(lines) if x.strip()]
    looks = [_look(x) if len(x) < 80 else _look.function(x) for x in (lines[k].strip() for k in at)]
    count = len(at)
    long_ = [x[0] >= 8 and x[1] for x in looks]
    first = long_.index(True) if True in long_ else count
    last = count - 1 - long_[::-1].index(True) if True in long_ else -1
    bins = [_BINS[min(x[0], len(_BINS) - 1)] for x in looks]
    titled = frozenset(re.findall(r"\w+", (title or "").casefold()))
    edge = len(_SIZES) + 1
    rows = []
    shared_yet = False
    for k, (n, ended, look, hashed, own) in enumerate(looks):
        share = recurs.get(at[k], 0) / pages
        row = [0, _SIZE + bins[k], _BEFORE + (bins[k - 1] if k else edge), _AFTER + (bins[k + 1] if k + 1 < count else edge), _TOP + _PLACE[min(k, len(_PLACE) - 1)], _END + _PLACE[min(count - 1 - k, len(_PLACE) - 1)], *look]
        if k:
            row += [_AT["gap_before"]] * (at[k] - at[k - 1] > 1) + [_AT["ended_before"]] * long_[k - 1]
        if k + 1 < count:
            row += [_AT["gap_after"]] * (at[k + 1] - at[k] > 1) + [_AT["ended_after"]] * long_[k + 1]
        row += [_AT["below_first"]] * (k > first) + [_AT["above_last"]] * (k < last)
        if share:
            row += [_AT["recurs"]] + [_AT["recurs_1000"]] * (share > 0.001) + [_AT["recurs_100"]] * (share > 0.01)
        else:
            row += [_AT["lone"]] + [_AT["lone_above"]] * (k < first and n >= 4 and not ended) + [_AT["lone_below"]] * (k > last)
        if titled and n > 2 and (both := len(own & titled) / max(len(own), len(titled))) >= 0.3:
            row.append(_AT["shared_1" if both < 0.5 else "shared_2" if both < 0.75 else "shared_3"])
            if both >= 0.5 and not shared_yet:
                row.append(_AT["shared_first"])
                shared_yet = True
        row = (row[: PER_LINE - 8] + hashed)[:PER_LINE]
        rows.append(row + [WIDTH] * (PER_LINE - len(row)))
    return at, np.array(rows, dtype=np.int32).reshape(count, PER_LINE), long_


def wording(line: str) -> str:
    """A short line without its number, figures made alike; nothing for a longer one."""
    bare = _NUMBERED.sub("", line.strip())
    return re.sub(r"\d+", "#", bare.casefold()) if len(bare.split()) <= 6 else ""


def headings(pages: list[list[str]]) -> frozenset[str]:
    """Wordings of the sample's lines that are headings: that stand mostly between sentences of an article and never below the last."""
    every, inside, below = Counter(), Counter(), Counter()
    for lines in pages:
        prose = [k for k, x in enumerate(lines) if is_content(x)]
        if prose:
            for k, x in enumerate(lines):
                if x.strip() and (w := wording(x)):
                    every[w] += 1
                    inside[w] += prose[0] < k < prose[-1]
                    below[w] += k > prose[-1]
    return frozenset(w for w, n in every.items() if n >= HEADING_TIMES and not below[w] and inside[w] >= 0.5 * n)


def label(lines: list[str], title: str | None, recurs: dict[int, int], known: frozenset[str]) -> list[int]:
    """1 for each non-blank line of main content, for the pages of the sample only; known are the wordings of headings."""
    at = [k for k, x in enumerate(lines) if x.strip()]
    texts = [lines[k].strip() for k in at]
    prose = [is_content(x) for x in texts]
    mine = own_title(texts, title, prose, [recurs.get(k, 0) for k in at])
    if not any(prose):
        return [0] * len(at)
    return [int(prose[k] or k == mine or bool(_CAPTION.match(x)) or wording(x) in known and any(prose[k + 1 :])) for k, x in enumerate(texts)]


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (WIDTH + 1, 2) and transitions (2, 2) that maximise the conditional likelihood, by Adam on all pages at once."""
    w, t = np.zeros((WIDTH + 1, 2)), np.zeros((2, 2))
    pages = [p for p in pages if len(p[1])]
    if not pages:
        return w, t
    n, longest = len(pages), max(len(y) for _, y in pages)
    x, y, mask = np.full((n, longest, PER_LINE), WIDTH, dtype=np.int32), np.zeros((n, longest), dtype=np.int64), np.zeros((n, longest), dtype=bool)
    for i, (a, b) in enumerate(pages):
        x[i, : len(b)], y[i, : len(b)], mask[i, : len(b)] = a, b, True
    lines = mask.nonzero()
    flat, truth = x[lines], np.eye(2)[y[lines]]
    both = mask[:, 1:] & mask[:, :-1]
    seen = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    total = len(flat)
    for step in range(1, epochs + 1):
        score = np.zeros((n, longest, 2))
        score[lines] = w[flat].sum(1)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0]
        for k in range(1, longest):
            alpha[:, k] = np.logaddexp(alpha[:, k - 1, :1] + t[0], alpha[:, k - 1, 1:] + t[1]) + score[:, k]
        for k in range(longest - 2, -1, -1):
            ahead = score[:, k + 1] + beta[:, k + 1]
            beta[:, k] = np.where(mask[:, k + 1, None], np.logaddexp(t[:, 0] + ahead[:, :1], t[:, 1] + ahead[:, 1:]), 0.0)
        z = np.logaddexp(*np.moveaxis(alpha[:, 0] + beta[:, 0], 1, 0))
        p = np.exp(alpha + beta - z[:, None, None])[lines]
        miss = truth - p
        gw = np.stack([np.bincount(flat.ravel(), weights=np.repeat(miss[:, c], PER_LINE), minlength=WIDTH + 1) for c in (0, 1)], axis=1)
        pair = np.exp(alpha[:, :-1, :, None] + t + (score + beta)[:, 1:, None, :] - z[:, None, None, None])
        gt = seen - (pair * both[:, :, None, None]).sum((0, 1))
        for j, (param, grad) in enumerate(((w, gw / total - 1e-5 * w), (t, gt / total - 1e-5 * t))):
            m[j] = 0.9 * m[j] + 0.1 * grad
            v[j] = 0.999 * v[j] + 0.001 * grad**2
            param += 0.1 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        w[WIDTH] = 0
    return w, t


def viterbi(score: np.ndarray, t: np.ndarray) -> list[int]:
    (t00, t01), (t10, t11) = t.tolist()
    rows = score.tolist()
    if not rows:
        return []
    a, b = rows[0]
    back = []
    for s0, s1 in rows[1:]:
        from0, from1 = a + t00 < b + t10, a + t01 < b + t11
        back.append((from0, from1))
        a, b = (b + t10 if from0 else a + t00) + s0, (b + t11 if from1 else a + t01) + s1
    state = int(b > a)
    out = [state]
    for pair in reversed(back):
        state = int(pair[state])
        out.append(state)
    return out[::-1]


def pages_with_recurrence(sources: DataFrame) -> DataFrame:
    """source_id, title, body_text, recurs: the pages, with the number of different pages for each of their lines that recurs."""
    pages = sources.filter(F.col("body_source").startswith("html") & (F.trim("body_text") != "")).select(F.col("id").cast("long").alias("source_id"), "title", "body_text")
    keys = F.transform(F.split("body_text", "\n"), lambda x: F.when(F.trim(x) != "", line_key(x)))
    lines = pages.select("source_id", F.xxhash64("body_text").alias("body"), F.posexplode(keys).alias("at", "key")).filter("key is not null")
    often = cut(lines.select("key", "body").distinct().groupBy("key").agg(F.count("*").alias("docs")).filter(F.col("docs") >= RECURS))
    marked = join_small(lines.select("source_id", "at", "key"), often, "key", "inner").groupBy("source_id").agg(F.map_from_entries(F.collect_set(F.struct("at", "docs"))).alias("recurs"))
    return pages.join(marked, "source_id", "left")


def _decode(w: np.ndarray, t: np.ndarray, pages: int):
    def run(batches):
        for batch in batches:
            ids: list[int] = []
            numbers: list[int] = []
            for i, title, text, recurs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, x, long_ = features(text.split("\n"), title, dict(recurs or ()), pages)
                kept = viterbi(w[x].sum(1), t)
                if not any(k and p for k, p in zip(kept, long_, strict=True)):
                    continue
                drop = [a + 1 for a, k in zip(at, kept, strict=True) if not k]
                numbers.extend(drop)
                ids.extend([i] * len(drop))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], ["source_id", "line_no"])

    return run


def examples(sample: list[tuple], pages: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of pages (title, text, recurs)."""
    known = headings([text.split("\n") for _, text, _ in sample])
    found = []
    for title, text, recurs in sample:
        lines, often = text.split("\n"), dict(recurs or ())
        found.append((features(lines, title, often, pages)[1], np.array(label(lines, title, often, known))))
    return found


def fit(pages: DataFrame, total: int, bound: int = SAMPLE_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Train on about bound pages, at most twice as many: those of lowest hash."""
    share = min(1.0, bound / max(1, total))
    sample = pages.filter((F.length("body_text") <= SAMPLE_LETTERS) & (F.pmod(F.xxhash64("source_id"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("title", "body_text", "recurs").limit(2 * bound).collect()
    return train(examples([tuple(r) for r in sample], total))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    pages = cut(pages_with_recurrence(table(spark, directory, "sources")))
    total = pages.count()
    w, t = fit(pages, total)
    return pages.mapInArrow(_decode(w, t, total), "source_id long, line_no int")


QUERIES = {"p6_found": p6_found}
SQL: dict[str, str] = {}
