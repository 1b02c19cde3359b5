"""Near-duplicate records with small edits: vantage-point trees over Hamming fingerprints.

Each record has several views: its title whole, cut after each of a ladder of word counts (titles are cut off), and
each of these less one word (words are lost, added or mangled); its identifier; a one-word title beside each name.
The fingerprint of a view is 128 bits: 96 for the counts of its letters, each in a cyclic code in which counts that
differ by one differ in one bit, and 32 parities of its pairs of letters. One letter added, lost or swapped moves the
letters by RADIUS at most and the pairs by PAIRED, moved words move neither, and a word that differs more is left out by one
of the views; views of different titles lie 19 bits apart give or take 4, so that balls of RADIUS reach few branches
and the triangle bound prunes.

All views of all records lie in one vantage-point tree. Its top levels are built from a sample (SAMPLE records, a
documented bound) and end in shards; every view is routed to its shard, and copied to each shard before it whose
boundary its ball overlaps, so that no close pair is lost between shards. In a shard the tree goes on to leaves of LEAF,
and all its views search it at once. Pairs within the radii are exact; there is no other source of candidates. They
are then checked on the fields themselves and grouped by connected components.

Where more than DENSE records have one and the same view, the search gives no pairs but the members of that cell, its
neighbours among them. Each member is first held against the cell's first one; then those that did not come into the cell's
largest group are held against all others of the cell. So no pair outside one group stays untested, and a third of all
records that record one work costs a test each.

Scale: records with equal fields are one row throughout. A view is 32 bytes in one shuffle, times the copies (about 1.2
a level of shards); shards are sized by SHARD, and one that stays larger, as when a third of all records
have one view, is dealt into blocks, of which each pair is searched by itself. What reaches the driver is the sample and
the tokens that more than COMMON of the records hold, at most a few thousand at any size.

Defined cases: null fields are missing evidence; a blank, generic or meaningless title alone never links; empty
tables give empty results; repeated ids are one record (smallest of its values); extra columns are ignored; very long
titles are read whole, with views in proportion to their words.
"""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.residue import title_is_residue
from folioforge.operators.graphs import components
from folioforge.runtime import cached, cut, join_small, table

RADIUS, PAIRED = 1, 6
LEAST = 16
SHARD = 1_000_000
LEAST_SHARDS = 8
LEAF = 64
SAMPLE = 4096
COMMON = 0.001
RARE_SHARE = 0.004
BLOCK = 2000
DENSE = 64

# Titles that many works share.
GENERIC = frozenset("book review|book reviews|review|reviews|editorial|introduction|einleitung|preface|foreword|vorwort|conclusion|conclusions|correspondence|letters|letter|notes|notes and comments|comments|abstract|contents|index|appendix|obituary|news|announcements|acknowledgements|references|bibliography|avant propos|introducción|prólogo|reseña|compte rendu|rezension|nachruf|titelei|front matter|back matter|untitled".split("|"))
_ROMANS = {r: i + 1 for i, r in enumerate("i ii iii iv v vi vii viii ix x".split())} | {w: i + 1 for i, w in enumerate("one two three four five six".split())} | {w: i + 1 for i, w in enumerate("first second third fourth fifth sixth".split())}
_KINDS = [("reply", r"\b(?:reply|antwort|réponse|respuesta) (?:to|auf|à|a)\b|\brejoinder\b"), ("response", r"\ba (?:response|reply|comment)\s*$|\bresponse to\b|\bcomments? on\b"), ("review", r"^\W*(?:a )?review of\b|\brezension\b|\bcompte rendu\b|\(review\)"), ("erratum", r"^\W*(?:errat(?:um|a)|corrigend(?:um|a)|corrections?|addend(?:um|a)|berichtigung)\b"), ("index", r"^\W*index to\b"), ("supplement", r"\bsupplement(?:ary material)?\s*$")]
_KINDS = [(k, re.compile(p)) for k, p in _KINDS]
_PART = re.compile(r"[,:;(\s–—-]*\b(?:volume|vol|part|pt|teil|band|bd|tome|parte|partie|tomo)\b\.?\s*(\d{1,3}|[ivx]{1,4}|one|two|three|four|five|six)\b\)?")
_EDITION = re.compile(r"[,:;(\s–—-]*\b(?:(\d{1,2})(?:st|nd|rd|th)|(second|third|fourth|fifth|sixth)|(\d{1,2})\.?)\s*(?:,?\s*(?:revised|rev\.?|enlarged)\s*)?(?:edition|ed\b\.?|auflage|aufl\b\.?|édition|edición)\)?|\b(?:revised|new|enlarged) edition\b")
_NOTES = re.compile(r"\[(?:pdf|abstract|html|full text|online|epub|preprint|electronic resource|book)\]?|\((?:preprint|pdf|online|abstract|draft|in press)\)|/ with maps\b|: a study\s*$|\bpsdf\b")
_DOI = re.compile(r"10\.\d{4,9}/\S+")
_STOP = frozenset("the of and a an in on to from for with without is its us about how und der die das von in des den zu le la les de du et un une el los las y en del al por para was were are at by as what who".split())


def fold(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text.casefold()).replace("ß", "ss").replace("&", " and ")
    return "".join(c for c in plain if not unicodedata.combining(c))


def normal_doi(doi: str | None) -> tuple[str, str]:
    """The identifier, if whole, and its last part by which incomplete ones compare."""
    text = re.sub(r"\s+", "", (doi or "").casefold())
    m = _DOI.search(text)
    whole = re.sub(r"\.(?:pre|v\d+|preprint)$", "", m[0].rstrip(".,;)")) if m else ""
    tail = whole.partition("/")[2] if whole else text
    return whole, tail if len(tail) >= 6 and "." in tail and re.search(r"[a-z].*\.|\d", tail) and not tail.startswith(("10.", "http", "doi")) else ""


def normal_title(title: str | None) -> tuple[str, str]:
    """The plain words of the title without decorations, and the signature of what makes it a work of its own."""
    text = fold(title or "")
    marks = []
    text = _NOTES.sub(" ", text)
    for kind, pattern in _KINDS:
        if pattern.search(text):
            marks.append(kind)
            text = pattern.sub(" ", text)
    for m in _PART.finditer(text):
        marks.append(f"part {_ROMANS.get(m[1], m[1])}")
    text = _PART.sub(" ", text)
    for m in _EDITION.finditer(text):
        number = m[1] or (_ROMANS.get(m[2]) if m[2] else None) or m[3] or "new"
        marks.append(f"edition {number}")
    text = _EDITION.sub(" ", text)
    return " ".join(re.findall(r"[^\W_]+", text)), " ".join(sorted(set(marks)))


def name_tokens(authors: list[str] | None) -> list[str]:
    found: dict[str, None] = {}
    for a in authors or []:
        for w in re.findall(r"[^\W\d_]+", fold(a or "")):
            if len(w) >= 4:
                found[w.replace("oe", "o").replace("ae", "a").replace("ue", "u")] = None
    return list(found)


def year_of(year: str | None) -> int | None:
    m = re.search(r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)", year or "")
    return int(m[0]) if m else None


def prepare(title: str | None, authors: list[str] | None, year: str | None, doi: str | None) -> tuple:
    """What comparisons need of a record, made once: plain title ('' for residue), marks, whether generic, names, whole and last part of the identifier, year."""
    plain, marks = normal_title(title)
    residue = title_is_residue(title)
    words = [w for w in plain.split() if w not in _STOP]
    generic = residue or len(words) < 2 or plain in GENERIC
    return ("" if residue else plain, marks, generic, name_tokens(authors), *normal_doi(doi), year_of(year))


_PREPARED = pa.schema([("id", pa.int64()), ("plain", pa.string()), ("marks", pa.string()), ("generic", pa.bool_()), ("names", pa.list_(pa.string())), ("whole", pa.string()), ("tail", pa.string()), ("year", pa.int32()), ("same", pa.string())])
_PREPARED_SQL = "id long, plain string, marks string, generic boolean, names array<string>, whole string, tail string, year int, same string"
_FIELDS = _PREPARED.names[1:-1]


def _prepare(batches):
    for batch in batches:
        rows = [(i, *prepare(*x)) for i, *x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows = [(*r, xxhash.xxh128_hexdigest(repr(r[1:]))) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_PREPARED), _PREPARED, strict=True)], schema=_PREPARED)


def _tokens(plain: str, names: list[str]) -> list[str]:
    return [*(f"t{w}" for w in set(plain.split()) if len(w) >= 3 and w not in _STOP), *(f"n{w}" for w in set(names))]


def _count_tokens(batches):
    for batch in batches:
        found: Counter = Counter()
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.update(_tokens(*row))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "n"])


def common_tokens(records: DataFrame, total: int) -> dict[str, float]:
    """Share of the records that hold each token, of those that COMMON of them and more hold: as many as tokens a record / COMMON at most."""
    counted = records.select("plain", "names").mapInArrow(_count_tokens, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n / total for r in counted.filter(F.col("n") >= COMMON * total).collect()}


_LETTERS = 24
_BUCKET = {c: k for k, c in enumerate("etaoinsrhldcumgpbfkvwyzj")} | {"q": 18, "x": 22}
#: Cyclic code of counts: neighbours differ in one bit.
_CYCLE = np.array([0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000], dtype=np.uint64)
_PAIR_BITS = np.uint64(0xFFFFFFFF)
_LETTER_BITS = np.uint64(0xFFFFFFFF00000000)


@cached(1 << 16)
def _word_code(word: str) -> tuple[bytes, int]:
    """Letter counts (modulo 256) and parities of the letter pairs of a word."""
    counts, pairs = [0] * _LETTERS, 0
    for c in word:
        k = _BUCKET.get(c)
        counts[zlib.crc32(c.encode("utf-8", "replace")) % _LETTERS if k is None else k] += 1
    padded = f"^{word}$"
    for k in range(len(padded) - 1):
        pairs ^= 1 << zlib.crc32(padded[k : k + 2].encode("utf-8", "replace")) % 32
    return bytes(x & 255 for x in counts), pairs


def _encode(counts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the fingerprints of views, from their letter counts and pair parities."""
    codes = _CYCLE[counts & 7]
    low, high = np.zeros(len(counts), dtype=np.uint64), pairs.astype(np.uint64)
    for k in range(16):
        low |= codes[:, k] << np.uint64(4 * k)
    for k in range(16, _LETTERS):
        high |= codes[:, k] << np.uint64(4 * k - 32)
    return low, high


def ladder(n: int) -> list[int]:
    """Word counts after which titles of n words are cut: n, and those of a ladder common to all titles that lie between half of n and n."""
    steps, k, by = [], 2, 1
    while k < n:
        if 2 * (k + by - 1) >= n - 1:
            steps.append(k)
        k += by
        if k >= 8 * by:
            by *= 2
    return [*steps, n]


def content_words(plain: str) -> list[str]:
    words = plain.split()
    return [w for w in words if w not in _STOP and not w.isdigit()] or words


def views(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record, low and high of each view of titles of the given words."""
    found: list[list[np.ndarray]] = [[], [], []]
    by_size: dict[int, list[int]] = {}
    for k, own in enumerate(words):
        if own:
            by_size.setdefault(len(own), []).append(k)

    def put(at: np.ndarray, counts: np.ndarray, pairs: np.ndarray, keep: np.ndarray) -> None:
        low, high = _encode(counts[keep], pairs[keep])
        for box, values in zip(found, (at[keep], low, high), strict=True):
            box.append(values)

    for n, whose in by_size.items():
        step = max(1, 300_000 // n)
        for start in range(0, len(whose), step):
            at = np.array(whose[start : start + step])
            coded = [_word_code(w) for k in at for w in words[k]]
            counts = np.frombuffer(b"".join(c for c, _ in coded), dtype=np.uint8).reshape(len(at), n, _LETTERS)
            pairs = np.array([p for _, p in coded], dtype=np.uint32).reshape(len(at), n)
            sizes = np.array([len(w) for k in at for w in words[k]], dtype=np.int32).reshape(len(at), n)
            sums, parities, lengths = np.cumsum(counts, 1, dtype=np.uint8), np.bitwise_xor.accumulate(pairs, 1), np.cumsum(sizes, 1)
            for k in ladder(n):
                put(at, sums[:, k - 1], parities[:, k - 1], np.full(len(at), True) if k == n else lengths[:, k - 1] >= LEAST)
                if k >= 4 or k == n == 3:
                    less = (sums[:, k - 1, None] - counts[:, :k]).reshape(-1, _LETTERS)
                    put(np.repeat(at, k), less, (parities[:, k - 1, None] ^ pairs[:, :k]).ravel(), ((lengths[:, k - 1, None] - sizes[:, :k]) >= LEAST).ravel())
    return tuple(np.concatenate(box) if box else np.zeros(0, dtype=t) for box, t in zip(found, (np.int64, np.uint64, np.uint64), strict=True))  # type: ignore[return-value]


def record_views(plain: list[str], generic: list[bool], names: list[list[str]], tails: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record, low and high of each view: of titles that stand for themselves, of other titles beside a name, of identifiers."""
    at, low, high = views([[] if g else content_words(p) for p, g in zip(plain, generic, strict=True)])
    beside = [(k, n) for k, (p, g) in enumerate(zip(plain, generic, strict=True)) if g and p and p not in GENERIC for n in names[k]]
    by_name, name_low, name_high = views([["".join(plain[k].split()) + n] for k, n in beside])
    whose = np.array([k for k, t in enumerate(tails) if t], dtype=np.int64)
    hashed = np.frombuffer(b"".join(xxhash.xxh128_digest(t) for t in tails if t), dtype=np.uint64).reshape(-1, 2)
    return np.concatenate([at, np.array([k for k, _ in beside], dtype=np.int64)[by_name], whose]), np.concatenate([low, name_low, hashed[:, 0]]), np.concatenate([high, name_high, hashed[:, 1]])


def distance(low: np.ndarray, high: np.ndarray, to_low: np.uint64, to_high: np.uint64) -> np.ndarray:
    """Hamming distance of the letters."""
    return np.bitwise_count(low ^ to_low) + np.bitwise_count((high ^ to_high) & _LETTER_BITS)


def _vantage(low: np.ndarray, high: np.ndarray, tries: int) -> tuple[np.uint64, np.uint64, int] | None:
    """The vantage point and radius that leave the least to compare, that is few points in reach of both sides; none if no point splits them."""
    best = None
    step = max(1, len(low) // 512)
    some_low, some_high = low[::step], high[::step]
    for j in range(tries):
        k = (2 * j + 1) * len(low) // (2 * tries)
        upto = np.cumsum(np.bincount(distance(some_low, some_high, low[k], high[k]), minlength=4 * _LETTERS + 2 * RADIUS + 1)) / len(some_low)
        inner = upto[RADIUS : 4 * _LETTERS + RADIUS]
        work = inner * upto[2 * RADIUS : 4 * _LETTERS + 2 * RADIUS] + (1 - inner) * (1 - upto[: 4 * _LETTERS]) + 9 * ((inner <= 0.1) | (inner >= 0.9))
        at = int(work.argmin())
        if 0 < inner[at] < 1 and (best is None or work[at] < best[0]):
            best = (work[at], low[k], high[k], at + RADIUS)
    return best and best[1:]


def close_pairs(low: np.ndarray, high: np.ndarray, own: np.ndarray, agree) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the radii of which one at least is the shard's own, once each.

    The tree of the own points and the search by all points go down together: a branch takes along the points whose
    ball reaches it. agree(a, b) tells which pairs further evidence admits.
    """
    first: list[np.ndarray] = []
    second: list[np.ndarray] = []
    every = np.arange(len(low))
    todo = [(every[own], every)]
    while todo:
        points, asking = todo.pop()
        if not len(points) or not len(asking):
            continue
        split = _vantage(low[points], high[points], 4 if len(points) > 512 else 1) if len(points) > LEAF else None
        if split:
            d = distance(low[points], high[points], split[0], split[1])
            inner = d <= split[2]
            if inner.any() and not inner.all():
                reach = distance(low[asking], high[asking], split[0], split[1])
                todo.append((points[inner], asking[reach <= split[2] + RADIUS]))
                todo.append((points[~inner], asking[reach > split[2] - RADIUS]))
                continue
        step = max(1, 2_000_000 // len(points))
        for start in range(0, len(asking), step):
            q = asking[start : start + step]
            near = np.flatnonzero(np.bitwise_count(low[q][:, None] ^ low[points]) <= RADIUS)  # the frequent letters tell most apart
            a, b = q[near // len(points)], points[near % len(points)]
            kept = ((a < b) | ~own[a]) & (distance(low[a], high[a], low[b], high[b]) <= RADIUS)
            a, b = a[kept], b[kept]
            kept = (np.bitwise_count((high[a] ^ high[b]) & _PAIR_BITS) <= PAIRED) & agree(a, b)
            first.append(a[kept])
            second.append(b[kept])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(first) if first else none, np.concatenate(second) if second else none


class TopTree:
    """The top levels of the tree, built from a sample: routes views to shards, and copies across the boundaries they overlap."""

    def __init__(self, low: np.ndarray, high: np.ndarray, shards: int, blocks) -> None:
        self.shards: list[int] = []  # blocks of each shard
        self.root = self._grow(low, high, shards, len(low), blocks)

    def _grow(self, low, high, shards: int, whole: int, blocks):
        split = _vantage(low, high, 16) if shards > 1 and len(low) > 1 else None
        inner = distance(low, high, split[0], split[1]) <= split[2] if split else None
        if inner is None or inner.all() or not inner.any():
            self.shards.append(blocks(len(low) / max(1, whole)))
            return len(self.shards) - 1
        return (*split, self._grow(low[inner], high[inner], -(-shards // 2), whole, blocks), self._grow(low[~inner], high[~inner], shards // 2, whole, blocks))

    def route(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, shards, and whether the shard is the view's own."""
        out: list[tuple[np.ndarray, int, bool]] = []
        every = np.arange(len(low))
        todo = [(self.root, every, every[:0])]
        while todo:
            node, mine, copied = todo.pop()
            if isinstance(node, int):
                out += [(mine, node, True), (copied, node, False)]
                continue
            to_low, to_high, middle, left, right = node
            d, e = distance(low[mine], high[mine], to_low, to_high), distance(low[copied], high[copied], to_low, to_high)
            across = mine[(d > middle) & (d <= middle + RADIUS)]
            todo.append((left, mine[d <= middle], np.concatenate([copied[e <= middle + RADIUS], across])))
            todo.append((right, mine[d > middle], copied[e > middle - RADIUS]))
        return np.concatenate([x for x, _, _ in out]), np.concatenate([np.full(len(x), s, dtype=np.int32) for x, s, _ in out]), np.concatenate([np.full(len(x), o) for x, _, o in out])


def fact(marks: str, generic: bool, tail: str, year: int | None) -> int:
    """Year, marks, whether generic and a hash of the identifier in one number; what pairs may be told apart by without their fields."""
    return (year or 0) | (zlib.crc32(marks.encode()) & 4095) << 12 | int(generic) << 24 | ((xxhash.xxh32_intdigest(tail) | 1) << 25 if tail else 0)


def may_agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """False where no exact test on the fields can accept the pair: unless identifiers are equal, years lie apart or one is a part, reply or edition that the other is not."""
    a, b = x & 4095, y & 4095
    near = (abs(a - b) <= 1) | (a == 0) | (b == 0)
    alike = (x >> 12 & 4095 == y >> 12 & 4095) | (x >> 24 & 1 == 1) | (y >> 24 & 1 == 1)
    return near & alike | (x >> 25 == y >> 25) & (x >> 25 != 0)


_VIEW = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("fact", pa.int64()), ("own", pa.bool_())])
_VIEW_SQL = "key long, id long, low long, high long, fact long, own boolean"


def _key(shard: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return shard.astype(np.int64) << 40 | one.astype(np.int64) << 20 | two


def _route(tree: TopTree):
    """Rows a view and shard; in a shard of several blocks, a row for each pair of blocks with the view's own."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            plain, marks, generic, names, tails, years = (batch.column(c).to_pylist() for c in ("plain", "marks", "generic", "names", "tail", "year"))
            facts = np.array([fact(*x) for x in zip(marks, generic, tails, years, strict=True)], dtype=np.int64)
            at, low, high = record_views(plain, generic, names, tails)
            for start in range(0, max(1, len(at)), 200_000):
                part = slice(start, start + 200_000)
                view, shard, own = tree.route(low[part], high[part])
                whose = at[part][view]
                blocks = np.array(tree.shards, dtype=np.int64)[shard]
                mine = _block(ids[whose], blocks)
                again = np.repeat(np.arange(len(view)), blocks)
                other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                key = _key(shard[again], np.minimum(mine[again], other), np.maximum(mine[again], other))
                cells = (key, ids[whose][again], low[part][view][again].view(np.int64), high[part][view][again].view(np.int64), facts[whose][again], own[again])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _VIEW, strict=True)], schema=_VIEW)

    return run


def _block(ids: np.ndarray, blocks) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.asarray(blocks, dtype=np.uint64)).astype(np.int64)


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64())])
_FOUND_SQL = "a long, b long, cell long"


def _pairs(rows: pa.Table, blocks: int) -> pa.RecordBatch:
    """The close pairs (a, b) of one shard or of one pair of its blocks, and the members (cell, a) of its dense cells."""
    ids, low, high, facts = (rows.column(c).to_numpy() for c in ("id", "low", "high", "fact"))
    low, high, own = low.view(np.uint64), high.view(np.uint64), rows.column("own").to_numpy()
    key = rows.column("key")[0].as_py()
    across = (key >> 20 & 0xFFFFF) != (key & 0xFFFFF)
    side = _block(ids, blocks)
    _, first, view, count = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    view = view.ravel()
    dense = (count > DENSE)[view]
    at = np.flatnonzero(~dense | (first[view] == np.arange(len(view))))  # of a dense cell one stands for all

    def agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = at[x], at[y]
        kept = (ids[x] != ids[y]) & may_agree(facts[x], facts[y])
        return (kept & (side[x] != side[y]) if across else kept) | dense[x] | dense[y]

    a, b = (at[x] for x in close_pairs(low[at], high[at], own[at], agree))
    hot = dense[a] | dense[b]
    both = np.unique(np.stack([np.minimum(ids[a], ids[b])[~hot], np.maximum(ids[a], ids[b])[~hot]], axis=1), axis=0)
    order = np.argsort(view, kind="stable")
    ends = np.searchsorted(view[order], np.arange(len(count))), np.searchsorted(view[order], np.arange(len(count)) + 1)
    members = lambda v: ids[order[ends[0][v] : ends[1][v]]]
    name = lambda v: xxhash.xxh64_intdigest(low[first[v]].tobytes() + high[first[v]].tobytes()) - (1 << 63)
    cells = [(name(v), members(v)) for v in np.flatnonzero(count > DENSE) if own[first[v]]]
    cells += [(name(view[x]), members(view[y])) for p, q in zip(a[hot], b[hot], strict=True) for x, y in ((p, q), (q, p)) if dense[x]]
    cell = np.concatenate([np.full(len(m), c, dtype=np.int64) for c, m in cells]) if cells else np.zeros(0, dtype=np.int64)
    member = np.concatenate([m for _, m in cells]) if cells else np.zeros(0, dtype=np.int64)
    nothing = lambda n: pa.nulls(n, pa.int64())
    columns = [pa.concat_arrays([pa.array(both[:, 0], pa.int64()), pa.array(member, pa.int64())]), pa.concat_arrays([pa.array(both[:, 1], pa.int64()), nothing(len(member))]), pa.concat_arrays([nothing(len(both)), pa.array(cell, pa.int64())])]
    return pa.RecordBatch.from_arrays(columns, schema=_FOUND)


def _search(shards: list[int]):
    """Batches sorted by key: the pairs of each key; rows of a key may go on in the next batch."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            return _pairs(pa.Table.from_batches(held), shards[held[0].column("key")[0].as_py() >> 40])

        for batch in batches:
            keys = batch.column("key").to_numpy()
            ends = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for start, end in zip(ends, ends[1:], strict=False):
                if end > start:
                    if held and held[-1].column("key")[0].as_py() != keys[start]:
                        yield flush()
                        held = []
                    held.append(batch.slice(start, end - start))
        if held:
            yield flush()

    return run


def top_tree(records: DataFrame, total: int) -> TopTree:
    """The top levels, from about SAMPLE records (the bound; those of lowest hash, none over 1,000 letters), sized by all."""
    share = min(1.0, SAMPLE / max(1, total))
    sample = records.filter((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))) & (F.length("plain") <= 1000)).select("plain", "generic", "names", "tail").limit(2 * SAMPLE).collect()
    _, low, high = record_views(*([r[k] for r in sample] for k in range(4)))
    rows = len(low) / share
    whole = np.unique(np.stack([low, high], axis=1), axis=0)
    tree = TopTree(whole[:, 0], whole[:, 1], max(LEAST_SHARDS, math.ceil(rows / SHARD)), lambda _: 1)
    if len(low):
        _, shard, own = tree.route(low, high)
        loads = np.bincount(shard[own], minlength=len(tree.shards)) / len(low) * rows
        tree.shards = [max(1, math.ceil(x / (2 * SHARD))) for x in loads]
    return tree


def candidates(records: DataFrame, total: int) -> DataFrame:
    """a, b, cell: pairs of ids that have a view within the radii, and ids (a) of the dense cells."""
    tree = top_tree(records, total)
    tasks = sum(b * (b + 1) // 2 for b in tree.shards)
    routed = records.select("id", "plain", "marks", "generic", "names", "tail", "year").mapInArrow(_route(tree), _VIEW_SQL)
    return routed.repartition(4 * tasks, "key").sortWithinPartitions("key").mapInArrow(_search(tree.shards), _FOUND_SQL).distinct()


def open_pairs(cells: DataFrame, links: DataFrame) -> DataFrame:
    """a, b: the pairs of each cell (cell, id) that the links leave in different groups; members of a cell's largest group are not paired with each other."""
    grouped = cells.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    grouped = cut(grouped)
    sizes = grouped.groupBy("cell", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("cell").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("others")).filter("others > 0")
    blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    known = join_small(grouped, most.select("cell", "main", blocks("all").alias("ys"), blocks("others").alias("xs")), "cell", "inner")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = known.filter("root <> main").select("cell", F.col("id").alias("p"), F.col("root").alias("p_root"), block("xs").alias("x"), every("ys").alias("y"))
    two = known.select("cell", F.col("id").alias("q"), F.col("root").alias("q_root"), every("xs").alias("x"), block("ys").alias("y"))
    return one.join(two, ["cell", "x", "y"]).filter("p_root <> q_root").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _grams(plain: str) -> Counter:
    joined = plain.replace(" ", "")
    return Counter(joined[i : i + 3] for i in range(len(joined) - 2))


def _near(a: str, b: str) -> bool:
    return a == b or abs(len(a) - len(b)) <= 1 and len(a) > 4 and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.79


def authors_agree(a: list[str], b: list[str], weight) -> float | None:
    """Share of the rarer side's names found, nearly spelt, on the other; none if a side has no names."""
    if not a or not b:
        return None
    short, long_ = (a, b) if sum(map(weight, a)) <= sum(map(weight, b)) else (b, a)
    whole = sum(map(weight, short))
    exact = set(long_)
    return sum(weight(x) for x in short if x in exact or any(_near(x, y) for y in long_)) / whole if whole else None


def same_work(one: tuple, two: tuple, weight, rare=lambda word: False) -> bool:
    """Whether two prepared records record one work, on the fields themselves; the cheap tests come first.

    weight gives the rarity of a name, rare tells whether few titles hold a word: titles that share such a word may
    differ more.
    """
    p1, m1, g1, n1, w1, s1, y1 = one
    p2, m2, g2, n2, w2, s2, y2 = two
    if w1 and w2 and w1 != w2:
        return False
    equal = bool(s1 and s1 == s2)
    near_year = y1 is None or y2 is None or abs(y1 - y2) <= 1
    if not near_year and (not equal or g1 or g2):
        return False
    if g1 or g2:
        if equal:
            agree = authors_agree(n1, n2, weight)
            return agree is None or agree >= 0.5
        if not (g1 and g2 and p1 == p2 != "" and p1 not in GENERIC):
            return False
        return (authors_agree(n1, n2, weight) or 0) >= 0.8
    if m1 != m2:
        return False
    x, y = set(p1.split()), set(p2.split())
    if len(x & y) < 0.3 * min(len(x), len(y)):
        return False
    x, y = _grams(p1), _grams(p2)
    common, c1, c2 = sum((x & y).values()), sum(x.values()), sum(y.values())
    if not c1 or not c2:
        return False
    dice, within = 2 * common / (c1 + c2), common / min(c1, c2)
    if equal:
        return dice >= 0.45 or within >= 0.7
    alike, close = dice >= 0.78 or within >= 0.9 and min(c1, c2) >= 12, dice >= 0.6 or within >= 0.75 and min(c1, c2) >= 12
    if not close:
        return False
    shared = any(len(w) > 5 and rare(w) for w in set(p1.split()) & set(p2.split()))
    if not alike and not shared:
        return False
    agree = authors_agree(n1, n2, weight)
    if agree is None:
        return dice >= (0.72 if shared else 0.82 if y1 == y2 is not None else 0.92) or shared and within >= 0.85 and min(c1, c2) >= 12
    return agree >= (0.45 if alike else 0.75) or dice >= 0.95 and agree >= 0.3


def _verify(common: dict[str, float]):
    def weight(token: str) -> float:
        return math.log(1 + 1 / common.get("n" + token, COMMON))

    def rare(word: str) -> bool:
        return common.get("t" + word, 0.0) <= RARE_SHARE

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            one = zip(*(batch.column(f"{c}_a").to_pylist() for c in _FIELDS), strict=True)
            two = zip(*(batch.column(f"{c}_b").to_pylist() for c in _FIELDS), strict=True)
            kept = [(i, j) for i, j, x, y in zip(a, b, one, two, strict=True) if same_work(x, y, weight, rare)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in kept], pa.int64()), pa.array([p[1] for p in kept], pa.int64())], ["a", "b"])

    return run


def work_groups(sources: DataFrame) -> DataFrame:
    """id, group_id: the records of each work entered more than once; group_id is the smallest id."""
    fields = ["title", "authors", "year", "doi"]
    sent = sources.select(F.col("id").cast("long").alias("id"), *fields).filter("id is not null")
    prepared = cut(sent.mapInArrow(_prepare, _PREPARED_SQL))
    records = cut(prepared.groupBy("same").agg(F.min(F.struct("id", *_FIELDS)).alias("r"), F.countDistinct("id").alias("n")).select("same", "r.*", "n"))
    total = records.count()
    common = common_tokens(records, total)
    sides = [records.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in _FIELDS]) for s in ("a", "b")]
    tested = lambda pairs: pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_verify(common), "a long, b long")
    found = cut(candidates(records, total))
    cells = found.filter("cell is not null").select("cell", F.col("a").alias("id"))
    pairs = found.filter("cell is null").select("a", "b")
    if cells.isEmpty():
        edges = tested(pairs)
    else:
        star = join_small(cells, cells.groupBy("cell").agg(F.min("id").alias("a")), "cell", "inner").filter("a <> id").select("a", F.col("id").alias("b"))
        first = cut(tested(pairs.unionByName(star).distinct()))
        edges = first.unionByName(tested(open_pairs(cells, first)))
    alone = F.col("generic") & (F.col("tail") == "") & (F.col("plain").isin("", *GENERIC) | (F.size("names") == 0))
    copied = records.filter((F.col("n") > 1) & ~alone).select("same", F.col("id").alias("rep"))
    copies = prepared.select("id", "same").join(copied, "same").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    linked = components(edges.unionByName(copies))
    return linked.select(F.col("node").alias("id"), F.col("root").alias("group_id"))


def pairs_in_groups(members: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """first, second: all pairs of different values of each group, smaller first. Large groups are dealt into blocks, so that no task holds more than two of them."""
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = join_small(members, cut(sizes.filter("blocks > 1")), group).withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64(value), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = dealt.select(group, F.col(value).alias(first), F.col("mine").alias("x"), every.alias("y"))
    two = dealt.select(group, F.col(value).alias(second), every.alias("x"), F.col("mine").alias("y"))
    return one.join(two, [group, "x", "y"]).filter(F.col(first) < F.col(second)).select(first, second)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return pairs_in_groups(cut(work_groups(table(spark, directory, "sources"))), "group_id", "id", "id_a", "id_b")


QUERIES = {"p3_found": p3_found}
SQL: dict[str, str] = {}
