"""The library's own duplicate scan and merge: five equal-key rules, groups, the record to keep, the merged record.

Two records are likely duplicates if identifier, book number or external key agree, or the year agrees and titles
are at least 0.90 alike, or the first author agrees and titles are at least 0.97 alike. Each rule joins on a key.
Equal keys link every record to the first of its class (no pairs within a class); titles are compared once a class
of equal titles. Pairs are oriented newest first.

Titles of one key (a year may hold very many) are dealt into blocks of BLOCK; for each pair of blocks the letters that two
titles can have in common at most are counted by matrix operations, and only the few pairs that can reach the
threshold are compared letter by letter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.scores import duplicate_signal, survival_score
from folioforge.functions.similarity import ratio, title_similarity
from folioforge.functions.text import WS, first_author, norm_text, normalize_isbn, trim
from folioforge.operators.graphs import components
from folioforge.runtime import cut

BLOCK = 1500
#: Rows of a block that are compared at once, how often a letter is counted for itself, and the pairs up to which neither is worth the while.
ROWS, LEVELS, FEW = 250, 16, 2500
LETTERS = " abcdefghijklmnopqrstuvwxyz0123456789"
FIELDS = ["id", "title", "authors", "year", "doi", "isbn", "zotero_item_key", "created_at"]


def _rank() -> F.Column:
    """Sorts newest first, the larger id first among equals."""
    return F.struct(F.col("created_at").alias("created"), F.col("id").alias("i"))


def exact_links(sources: DataFrame) -> DataFrame:
    """left_id, right_id, rule: each record whose key is not its own alone, with the newest record of that key."""
    keys = {"doi": trim(F.lower("doi")), "isbn": normalize_isbn("isbn"), "key": trim("zotero_item_key")}
    keyed = sources.select("id", "created_at", F.explode(F.create_map(*[x for k, c in keys.items() for x in (F.lit(k), c)])).alias("rule", "value")).filter("value <> ''")
    newest = keyed.groupBy("rule", "value").agg(F.max(_rank()).alias("first"), F.count("*").alias("n")).filter("n > 1").select("rule", "value", F.col("first.i").alias("left_id"))
    return keyed.join(newest, ["rule", "value"]).filter("id <> left_id").select("left_id", F.col("id").alias("right_id"), "rule")


def letter_counts(titles: list[str]) -> np.ndarray:
    signs = np.frombuffer("".join(titles).encode("ascii", "replace"), dtype=np.uint8)
    rows = np.repeat(np.arange(len(titles)), np.array([len(t) for t in titles], dtype=np.int64))
    return np.bincount(128 * rows + signs, minlength=128 * len(titles)).reshape(len(titles), 128)[:, [ord(c) for c in LETTERS]].astype(np.int32)


def _levels(x: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A column for each letter and each number up to most of it: whether a title has the letter so often. Products of two such rows count the letters shared."""
    return np.concatenate([x[:, k, None] >= np.arange(1, most[k] + 1) for k in range(len(LETTERS))], 1).astype(np.float32)


def can_reach(a: list[str], b: list[str], least: float) -> np.ndarray:
    """Positions (in a, in b) of pairs that share letters enough for the threshold, in any order; if b is a, each pair once, the smaller position first.

    Both sides are ordered by length, so that rows of a meet only the b of lengths near enough. Letters beyond LEVELS in a title
    are bounded by their sum; the pairs that are left are counted exactly.
    """
    x = letter_counts(a)
    y = x if a is b else letter_counts(b)
    if len(a) * len(b) <= FEW:
        pairs = np.argwhere(2 * np.minimum(x[:, None], y).sum(2) >= least * (x.sum(1)[:, None] + y.sum(1)) - 1e-9)
        return pairs[pairs[:, 0] < pairs[:, 1]] if a is b else pairs
    by_x, by_y = (np.argsort(n, kind="stable") for n in (x.sum(1), y.sum(1)))
    x, y = x[by_x], y[by_y]
    long_x, long_y = x.sum(1, dtype=np.int64), y.sum(1, dtype=np.int64)
    most = np.minimum(np.minimum(x.max(0, initial=0), y.max(0, initial=0)), LEVELS)
    more_x, more_y = (np.maximum(n - LEVELS, 0).sum(1, dtype=np.int64).astype(np.float32) for n in (x, y))
    in_x, in_y = _levels(x, most), _levels(y, most).T.copy()
    found = [np.zeros((0, 2), dtype=np.int64)]
    for at in range(0, len(x), ROWS):
        to = min(at + ROWS, len(x))
        low = np.searchsorted(long_y, long_x[at] * least / (2 - least) - 1e-6, "left")
        high = np.searchsorted(long_y, long_x[to - 1] * (2 - least) / least + 1e-6, "right")
        low = max(low, at) if a is b else low
        if low >= high:
            continue
        shared = in_x[at:to] @ in_y[:, low:high]
        if more_x[at:to].any() and more_y[low:high].any():
            shared += np.minimum.outer(more_x[at:to], more_y[low:high])
        near = least / 2 * (1 - 1e-6)  # numbers of 32 bits are rounded
        shared -= (long_x[at:to, None] * near - 0.01).astype(np.float32)
        i, j = np.nonzero(shared >= (long_y[low:high] * near).astype(np.float32))
        i, j = i + at, j + low
        exact = 2 * np.minimum(x[i], y[j]).sum(1, dtype=np.int64) >= least * (long_x[i] + long_y[j]) - 1e-9
        found.append(np.stack([by_x[i[exact]], by_y[j[exact]]], 1))
    pairs = np.concatenate(found)
    if a is b:
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], 1), axis=0)
    return pairs


def _compare(least: float):
    def run(batches):
        held: list = [None, []]
        out: list[tuple[int, int]] = []

        def flush() -> None:
            rows = held[1]
            left, right = ([r for r in rows if r[3] != 1], [r for r in rows if r[3] == 1])
            within = not right and all(r[3] == 2 for r in rows)
            right = left if within else right
            if len(rows) < 2 or not right:
                return
            titles = [r[0] for r in left]
            for i, j in can_reach(titles, titles if within else [r[0] for r in right], least).tolist():
                p, q = left[i], right[j]
                if (p[2], p[1]) < (q[2], q[1]):
                    p, q = q, p
                if p[1] != q[1] and ratio(p[0], q[0], least) >= least:
                    out.append((p[1], q[1]))

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["left_id", "right_id"])
            out.clear()
            return made

        for batch in batches:
            for key, t, rep, created, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != held[0]:
                    flush()
                    held = [key, []]
                held[1].append((t, rep, created, side))
            yield batch_of()
        flush()
        yield batch_of()

    return run


def near_titles(classes: DataFrame, least: float) -> DataFrame:
    """left_id, right_id of classes (k, t, rep, created) whose titles are at least so alike under one key."""
    sizes = classes.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    rows = classes.join(sizes, "k").withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    key = F.concat_ws("\x1f", "k", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    dealt = rows.select(key.alias("key"), "t", "rep", "created", side.alias("side")).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_compare(least), "left_id long, right_id long")


def similar_links(sources: DataFrame) -> DataFrame:
    """left_id, right_id, rule: pairs of classes of equal titles by their newest records, and the other records of a class with it."""
    rows = sources.select("id", "created_at", norm_text("title").alias("t"), trim("year").alias("year"), first_author("authors").alias("author")).filter("t <> ''")
    found = None
    for rule, key, least in (("year", "year", 0.90), ("author", "author", 0.97)):
        keyed = rows.filter(F.col(key) != "").withColumnRenamed(key, "k").select("id", "created_at", "t", "k")
        classes = keyed.groupBy("k", "t").agg(F.max(_rank()).alias("first"))
        classes = classes.select("k", "t", F.col("first.i").alias("rep"), F.expr("unix_micros(cast(first.created as timestamp))").alias("created"))
        links = near_titles(classes, least).withColumn("rule", F.lit(rule))
        same = keyed.join(classes.select("k", "t", "rep"), ["k", "t"]).filter("id <> rep").select(F.col("rep").alias("left_id"), F.col("id").alias("right_id"), F.lit(rule).alias("rule"))
        both = links.unionByName(same)
        found = both if found is None else found.unionByName(both)
    return found


def scored_links(sources: DataFrame) -> DataFrame:
    """left_id, right_id, likely, score, title_similarity, reasons of all links of the five rules."""
    links = exact_links(sources).unionByName(similar_links(sources)).select("left_id", "right_id").distinct()
    left = sources.select(*[F.col(c).alias(f"l_{c}") for c in FIELDS])
    right = sources.select(*[F.col(c).alias(f"r_{c}") for c in FIELDS])
    rows = links.join(left, F.col("left_id") == F.col("l_id")).join(right, F.col("right_id") == F.col("r_id"))
    rows = rows.withColumn("signal", duplicate_signal(title_similarity(norm_text("l_title"), norm_text("r_title"), 0.0)))
    return rows.select("left_id", "right_id", "signal.*")


def duplicate_groups(sources: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """id, group_id: members of each group of two and more; group_id is the smallest id."""
    links = links if links is not None else exact_links(sources).unionByName(similar_links(sources))
    return components(links, "left_id", "right_id").select(F.col("node").alias("id"), F.col("root").alias("group_id"))


def keep_choice(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """group_id, size, keep_id, keep_score: the member of the highest survival score; ties go to the newest, then the larger id.

    (A depth-first visit would settle ties in visiting order, which begins with the newest member.)
    """
    rows = groups.join(sources.select("id", "created_at", survival_score().alias("score")), "id")
    return rows.groupBy("group_id").agg(F.count("*").alias("size"), F.max(F.struct("score", "created_at", "id")).alias("best")).select("group_id", "size", F.col("best.id").alias("keep_id"), F.round("best.score", 2).alias("keep_score"))


#: Written: length of its grams and distance of their places, and the length from which a text holds a gram of every remainder.
GRAM, STEP = 12, 16
LONG = GRAM + STEP - 1
BLANKS = WS.encode()
MERGED = ["title", "year", "publisher", "journal", "volume", "issue", "pages", "doi", "isbn", "url", "accessed_at", "raw_input"]


class Written:
    """A growing text (bytes) that tells what it contains, without reading it again for each question.

    Of the text the grams at every STEP-th place are kept. An occurrence of a longer text holds all its grams of one
    remainder of places, so the rarest of these says where it can begin. Shorter texts are named first (short), and
    met letter by letter as the text grows.
    """

    def __init__(self, text: bytes, short: set[bytes]) -> None:
        self.text, self.places, self.indexed, self.met = bytearray(), {}, 0, set()
        self.short: dict[int, set[bytes]] = {}
        for t in short:
            self.short.setdefault(len(t), set()).add(t)
        self.add(text)

    def add(self, more: bytes) -> None:
        before = len(self.text)
        self.text += more
        for n, wanted in self.short.items():
            start = max(0, before - n + 1)
            part = bytes(memoryview(self.text)[start:])
            self.met.update(wanted.intersection(part[i : i + n] for i in range(len(part) - n + 1)))
        for at in range(self.indexed, len(self.text) - GRAM + 1, STEP):
            self.places.setdefault(bytes(self.text[at : at + GRAM]), []).append(at)
            self.indexed = at + STEP

    def __contains__(self, text: bytes) -> bool:
        if len(text) < LONG:
            return text in self.met
        for offset in range(STEP):
            rarest = None
            for at in range(offset, len(text) - GRAM + 1, STEP):
                found = self.places.get(text[at : at + GRAM])
                if found is None:
                    break
                if rarest is None or len(found) < len(rarest[0]):
                    rarest = found, at
            else:
                places, at = rarest
                if any(p >= at and self.text.startswith(text, p - at) for p in places):
                    return True
        return False


def appended(notes: list[tuple[int, bytes]]) -> bytes:
    """The first of the notes (id, text) and those of the others that what is written so far does not contain, each under the id of its record. What is contained once stays so: each text is looked for once."""
    kept = notes[0][1]
    later: dict[bytes, int] = {}
    for i, note in notes[1:]:
        later.setdefault(note.strip(BLANKS), i)
    later.pop(b"", None)
    so_far = Written(kept.rstrip(BLANKS), {t for t in later if len(t) < LONG})
    start = len(so_far.text)
    for text, i in later.items():
        if text not in so_far:
            so_far.add(b"\n\nMerged from source #%d:\n" % i + text)
    return bytes(so_far.text) if len(so_far.text) > start else kept


def _append(batches):
    held: list = [None, []]
    for batch in batches:
        out: list[tuple[int, bytes]] = []
        for group, i, note in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != held[0]:
                if held[1]:
                    out.append((held[0], appended(held[1])))
                held = [group, []]
            held[1].append((i, note))
        yield _noted(out)
    if held[1]:
        yield _noted([(held[0], appended(held[1]))])


def _noted(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["group_id", "notes"])


def merge_groups(groups: DataFrame, sources: DataFrame, keep: DataFrame) -> DataFrame:
    """The kept record of each group with blanks filled from the dropped ones in order of id, authors united, notes appended unless contained, external key adopted.

    A field is an aggregate (the first non-blank by order), so no group is gathered but for its authors and notes; notes are appended in time proportional to their length.
    """
    rows = groups.join(keep.select("group_id", "keep_id"), "group_id").join(sources, "id").withColumn("ord", F.when(F.col("id") == F.col("keep_id"), F.lit(-1)).otherwise(F.col("id")))
    firsts = [F.coalesce(F.min(F.when(trim(f) != "", F.struct("ord", F.col(f).alias("v")))).getField("v"), F.lit("")).alias(f) for f in [*MERGED, "zotero_item_key"]]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("authors", F.array().cast("array<string>")).alias("a")))), lambda x: x["a"])
    merged = rows.groupBy("group_id", F.col("keep_id").alias("id")).agg(*firsts, F.array_distinct(F.flatten(listed)).alias("authors"))
    notes = rows.select("group_id", "ord", "id", F.coalesce("notes", F.lit("")).cast("binary").alias("n")).repartition("group_id").sortWithinPartitions("group_id", "ord", "n", "id")
    notes = notes.select("group_id", "id", "n").mapInArrow(_append, "group_id long, notes binary").select("group_id", F.col("notes").cast("string").alias("notes"))
    return merged.join(notes, "group_id")


def scan(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups, and the choice of each, written once."""
    groups = cut(duplicate_groups(sources))
    return groups, keep_choice(groups, sources)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_first("created_at"), F.desc("id"))


def first_by(df: DataFrame, keys: list[str], *order: F.Column) -> DataFrame:
    """The first row a key by the order given."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn_ = 1").drop("rn_")
