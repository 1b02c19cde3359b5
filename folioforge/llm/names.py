"""Variant spellings of names typed by people: canonical rewritings, exploded and joined.

Each distinct name is rewritten by rules: case, accents and transliterated umlauts folded, titles and roles dropped,
order of parts, nicknames, initials, legal forms and abbreviations of organisations, and every deletion of one
letter (two names within one edit or swap share one). Equal forms link. A link is scored by the rarity of its
rewriting: a form attested by more than SELDOM of the names that attest the other is a name of its own and no misspelling (FEW
spellings are always few); an initial links
only if one person of the surname bears it, or, if the surname so spelt has no bearer, if the bearers one letter away
have one given name and only one spelling of the surname, of all that meet, is attested by many.

Scale: works on distinct names, never on their occurrences. Forms are hashes; each group of equal forms links to its
best attested member only (a star), so nothing is gathered or paired within a group; stars are merged by
connected components. What reaches the driver is the list of given names, at most 2 / GIVEN_SHARE tokens.

Defined cases: null, blank and anonymous entries ('et al.', 'Anonymous', digits) name nobody and never link; repeated
names are one; an empty table gives no pairs; extra columns are ignored; very long names are folded whole.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.records import pairs_in_groups
from folioforge.operators.graphs import components
from folioforge.runtime import cut, table

GIVEN_SHARE = 0.001
GIVEN_LEAST = 8
OWN_NAME = 0.5
FEW = 2
SELDOM = 0.25

# Given names and their familiar forms.
NICKNAMES = """alexander: alex sasha; andrea: andy; andrew: andy drew; anthony: tony; anton: toni; barbara: barb; beatrice: bea trixie; benjamin: ben; catherine: cathy kate; charles: charlie chuck; christopher: chris kit; daniel: dan danny; david: dave; dorothy: dot dolly; edward: ed ned ted; elizabeth: betty beth liz; frederick: fred fritz; gregory: greg; henry: hank harry; isabel: bella izzy; jacob: jake; james: jamie jim; jennifer: jen jenny; johanna: hanna; john: jack johnny; jonathan: jon; joseph: joe; katherine: kate kathy; kenneth: ken; lawrence: larry; leopold: leo; margaret: maggie meg peggy; matthew: matt; michael: mick mike; nicholas: nick; nikolai: kolya; patricia: pat trish; patrick: paddy pat; peter: pete; philip: phil; rebecca: becky; richard: dick rick; robert: bob rob; ronald: ron; samuel: sam; stephen: steve; susan: sue susie; teresa: tess; theodore: ted theo; thomas: tom; timothy: tim; viktor: vic; walter: walt; william: bill will"""
# Words by which an organisation is told, with their abbreviations.
ORGANISATION = {"institute": "inst", "university": "univ uni", "department": "dept dep", "museum": "mus", "society": "soc", "consortium": "cons", "association": "assoc assn", "academy": "acad", "college": "coll", "centre": "center ctr cent", "laboratory": "lab labs", "library": "lib libr", "archive": "arch archives", "foundation": "found fdn", "committee": "comm cttee", "council": "", "office": "", "group": "grp", "agency": "", "ministry": "min", "school": "sch", "faculty": "fac", "press": "", "survey": "surv", "project": "proj", "team": "", "network": "", "commission": "", "board": "", "bureau": "", "company": "co", "studies": "stud", "research": "res", "history": "hist", "science": "sci sciences", "national": "natl nat", "international": "intl int"}
_EXPAND = {short: full for full, shorts in ORGANISATION.items() for short in shorts.split()}
_TELLING = {w for w in ORGANISATION if w not in ("studies", "research", "history", "science", "national", "international", "school", "min")} - {"press"} | {"press"}
_LEGAL = frozenset("inc ltd llc gmbh ag plc corp ev sa bv co the of for and in at f fur für".split())
_NOBODY = frozenset("anonymous|anon|et al|etal|unknown|unbekannt|n n|nn|n a|na|none|null|various|various authors|others|and others|author|authors|staff|editor|editors|ed|eds|u a|s n|sn|no author|not available|tba|tbd|anonyme|anónimo|undefined|nan|author unknown|verfasser unbekannt|collective".split("|"))
_ROLES = re.compile(r"(?i:\((?:eds?|hrsg|hg|dir|trans|coord|comp)\.?\))|\b(?i:dr|prof|professor|mr|mrs|ms|sir|dame|rev|hon)\.\s*(?:med\.|phil\.)?|,\s*(?i:jr|sr|ph\.?d|m\.?d|esq|iii?|iv)\.?$|\s+(?:Jr|Sr|III|Ph\.?D|Esq)\.?$|\b(?i:eds?|hrsg)\.\s*$")
_PARTICLES = frozenset("van von de del der den la le di da dos das ten ter af zu zum al el du des della vom vna vno dle".split())
_FORMAL: dict[str, list[str]] = {}
for _entry in NICKNAMES.split(";"):
    _full, _shorts = _entry.strip().split(":")
    _FORMAL.setdefault(_full, []).insert(0, _full)
    for _s in _shorts.split():
        _FORMAL.setdefault(_s, []).append(_full)


def fold(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L"))
    return "".join(c for c in plain if not unicodedata.combining(c))


def flat(word: str) -> str:
    """Folded letters only, transliterated umlauts like plain vowels."""
    return re.sub(r"[^a-z]", "", fold(word).lower()).replace("oe", "o").replace("ae", "a").replace("ue", "u")


def plain(word: str) -> str:
    """Folded letters only."""
    return re.sub(r"[^a-z]", "", fold(word).lower())


def deletions(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) > 3 else {word}


def organisation(name: str) -> tuple[str, str] | None:
    """The canonical word list of an organisation, and the same words as typed but folded; nothing for a person."""
    words = [w for w in re.findall(r"[a-z]+", fold(name).lower()) if w]
    full = [_EXPAND.get(w, w) for w in words]
    if not any(w in _TELLING for w in full) or len(full) < 2:
        return None
    if "," in name and not any(w in _TELLING for w in full[:1]) and len(full) == 2:
        return None
    kept = sorted((w.replace("oe", "o").replace("ae", "a").replace("ue", "u"), w) for w in full if w not in _LEGAL and len(w) > 1)
    return " ".join(x for x, _ in kept), " ".join(w for _, w in kept)


def names_nobody(name: str | None) -> bool:
    words = re.findall(r"[^\W\d_]+", (name or "").lower())
    return not words or " ".join(words) in _NOBODY or len("".join(words)) < 3


def person(name: str, given: frozenset[str]) -> list[tuple[str, str, str, str]]:
    """Readings of a person's name, likeliest first: surname with particles, given name (or ''), initials, surname as typed but folded."""
    text = " ".join(_ROLES.sub(" ", name).replace(" ,", ",").split())
    text = re.sub(r",(?=\S)", ", ", text).strip(" ,;")
    if not text:
        return []

    def particles(words: list[str]) -> tuple[list[str], list[str]]:
        own = [w for w in words if flat(w) in _PARTICLES and not re.fullmatch(r"[A-Z]\.?", w)]
        return own, [w for w in words if w not in own]

    def short(w: str) -> bool:
        return bool(re.fullmatch(r"(?:[^\W\d_]\.?-?){1,3}", w)) and (w.isupper() or "." in w or len(w) == 1) and not (len(w) > 1 and w.islower())

    def reading(last: list[str], first: list[str]) -> tuple[str, str, str, str] | None:
        surname = "".join(flat(w) for w in last)
        initials = "".join(flat(w)[:1] if not short(w) else re.sub(r"[^a-z]", "", fold(w).lower()) for w in first)
        long_ = [plain(w) for w in first if not short(w) and len(plain(w)) > 1]
        return (surname, long_[0] if long_ else "", initials, "".join(plain(w) for w in last)) if len(surname) > 1 else None

    if "," in text:
        last, _, first = text.partition(",")
        own, rest = particles(first.replace(",", " ").split())
        found = [reading([*own, *last.split()], rest)]
        return [x for x in found if x]
    words = text.split()
    if len(words) == 1:
        return [(flat(words[0]), "", "", plain(words[0]))] if len(flat(words[0])) > 3 else []
    if short(words[-1]) and not short(words[0]):
        own = words[:-1]
        while len(own) > 1 and short(own[-1]):
            own = own[:-1]
        found = [reading(own, words[len(own) :])]
        return [x for x in found if x]
    at = next((k for k, w in enumerate(words) if k and flat(w) in _PARTICLES and not short(w)), None)
    if at and at < len(words) - 1:
        straight = reading(words[at:], words[:at])
    else:
        straight = reading(words[-1:], words[:-1])
    if at == 0 or flat(words[0]) in _PARTICLES:
        turned = reading(words[:-1], words[-1:])
    else:
        turned = reading(words[:1], words[1:]) if len(words) == 2 else None
    if turned and straight:
        first_known, last_known = plain(words[0]) in given, plain(words[-1]) in given
        if (last_known and not first_known) or flat(words[0]) in _PARTICLES:
            return [turned, straight]
        if first_known and not last_known or short(words[0]):
            return [straight]
        return [straight, turned]
    return [x for x in (straight, turned) if x]


def formal(given: str, beside: dict[str, int]) -> list[str]:
    """The names a familiar form stands for. A form that goes with half as many surnames as its formal name is a name of its own."""
    meant = [f for f in _FORMAL.get(given, [given]) if f == given or beside.get(given, 0) < max(4, OWN_NAME * beside.get(f, 0))]
    return meant or [given]


_H = xxhash.xxh64_intdigest


def _hash(*parts: str) -> int:
    return _H("\x1f".join(parts)) - (1 << 63)


def _given_tokens(batches):
    for batch in batches:
        a, b = [], []
        for name in batch.column(0).to_pylist():
            if names_nobody(name) or organisation(name):
                continue
            words = [plain(w) for w in re.findall(r"[^\W\d_]+", _ROLES.sub(" ", name))]
            words = [w for w in words if len(w) > 2 and w not in _PARTICLES]
            if len(words) == 2:
                a += words
                b += words[::-1]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["token", "beside"])


_KEYS = pa.schema([("name", pa.string()), ("kind", pa.string()), ("pk", pa.int64()), ("rank", pa.int32()), ("surname", pa.string()), ("given", pa.string()), ("initials", pa.string()), ("raw", pa.string())])
_KEYS_SQL = "name string, kind string, pk long, rank int, surname string, given string, initials string, raw string"


def _readings(given: frozenset[str], counts: dict[str, int]):
    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for name in batch.column(0).to_pylist():
                if names_nobody(name):
                    continue
                if org := organisation(name):
                    rows.append((name, "org", _hash("o", org[0]), 0, org[0], "", "", org[1]))
                    continue
                rank = 0
                for surname, first, initials, raw in person(name, given):
                    if first:
                        for f in formal(first, counts):
                            rows.append((name, "person", _hash("p", surname, f), rank, surname, f, initials, raw))
                            rank += 1
                    elif initials:
                        rows.append((name, "initials", _hash("i", surname, initials), rank, surname, "", initials, raw))
                        rank += 1
                    else:
                        rows.append((name, "single", _hash("s", surname), rank, surname, "", "", raw))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 8, _KEYS, strict=True)], schema=_KEYS)

    return run


def _misspellings(known: frozenset[str]):
    """Forms of each key under which a key one letter away meets it: kind, surname, given, initials -> pk, form, rule."""

    def run(batches):
        for batch in batches:
            pks, forms, rules = [], [], []
            for pk, kind, surname, given, initials, raws in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found: list[tuple[int, str]] = []
                if kind == "person":
                    spelt = set().union(*(deletions(x) for x in {surname, *raws}))
                    found += [(_hash("ds", d, given), "surname") for d in spelt]
                    found += [(_hash("dg", surname, d), "known" if given in known else "given") for d in deletions(given)]
                elif kind in ("initials", "single"):
                    spelt = set().union(*(deletions(x) for x in {surname, *raws}))
                    found += [(_hash("d" + kind[0], d, initials), "short") for d in spelt]
                elif kind == "org":
                    words, typed = surname.split(), [r.split() for r in raws]
                    for k, w in enumerate(words):
                        if w not in ORGANISATION:
                            spelt = set().union(*(deletions(x) for x in {w, *(t[k] for t in typed)}))
                            found += [(_hash("do", " ".join(words[:k] + words[k + 1 :]), d), "org") for d in spelt]
                pks += [pk] * len(found)
                forms += [f for f, _ in found]
                rules += [r for _, r in found]
            yield pa.RecordBatch.from_arrays([pa.array(pks, pa.int64()), pa.array(forms, pa.int64()), pa.array(rules, pa.string())], ["pk", "form", "rule"])

    return run


def _surname_forms(batches):
    """surname, raw, g and more -> the same and the forms under which surnames one letter away meet, by initial."""
    for batch in batches:
        at, forms = [], []
        for k, (surname, raw, g) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("surname", "raw", "g")), strict=True)):
            own = {_hash("n", d, g) for d in deletions(surname) | deletions(raw)}
            at += [k] * len(own)
            forms += own
        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at, pa.int32())).columns, pa.array(forms, pa.int64())], [*batch.schema.names, "form"])


def near_bearers(lone: DataFrame, full: DataFrame) -> DataFrame:
    """own, root: initials whose surname nobody bears as spelt, with the bearers one letter away if these have one given name.

    lone has own, surname, raw, initials, attested; full has root, surname, raw, g, middle, meant, attested.
    """
    lone = lone.withColumn("g", F.substring("initials", 1, 1)).mapInArrow(_surname_forms, "own long, surname string, raw string, initials string, attested long, g string, form long")
    full = full.mapInArrow(_surname_forms, "root long, surname string, raw string, g string, middle string, meant string, attested long, form long")
    spelt = full.groupBy("form", F.col("surname").alias("theirs"), "middle").agg(F.min("meant").alias("lo"), F.max("meant").alias("hi"), F.min("root").alias("root"), F.max("attested").alias("many"))  # a row a spelling and second initial
    met = lone.join(spelt, "form").select("own", "initials", "attested", "theirs", "middle", "lo", "hi", "root", "many").distinct()
    met = cut(met.filter((F.least("attested", "many") <= FEW) & ((F.length("initials") == 1) | (F.col("middle") == "") | (F.substring("initials", 2, 1) == F.col("middle")))))
    middle, strong = F.when(F.col("middle") != "", F.col("middle")), F.when(F.col("many") > FEW, F.col("root"))
    exact = (F.length("initials") > 1) & (F.col("middle") != "")
    picked = met.groupBy("own").agg(F.min("lo").alias("lo_"), F.max("hi").alias("hi_"), F.min(F.when(exact, F.col("lo"))).alias("exact_lo"), F.max(F.when(exact, F.col("hi"))).alias("exact_hi"), F.min(middle).alias("m"), F.max(middle).alias("n"), F.min(strong).alias("s"), F.max(strong).alias("t"))
    picked = picked.withColumn("one", F.when(F.coalesce("exact_lo", "lo_") == F.coalesce("exact_hi", "hi_"), F.coalesce("exact_lo", "lo_")))
    picked = picked.filter(F.col("one").isNotNull() & (F.coalesce("m", F.lit("")) == F.coalesce("n", F.lit(""))) & (F.coalesce("s", F.lit(0)) == F.coalesce("t", F.lit(0)))).select("own", "one")
    return met.join(picked, "own").filter("lo = one and hi = one").select("own", "root").distinct()


def name_clusters(sources: DataFrame, column: str = "authors") -> DataFrame:
    """name, cluster: each name that names somebody; equal clusters name one person or organisation."""
    names = cut(sources.select(F.explode(column).alias("name")).filter(F.trim("name") != "").distinct())
    total = names.count()
    beside = names.mapInArrow(_given_tokens, "token string, beside string").distinct().groupBy("token").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in beside.filter(F.col("token").isin(*_FORMAL) | (F.col("n") >= max(GIVEN_LEAST, GIVEN_SHARE * total))).collect()}
    given = frozenset(t for t, n in counts.items() if n >= max(GIVEN_LEAST, GIVEN_SHARE * total)) | frozenset(_FORMAL)
    read = cut(names.mapInArrow(_readings(given, counts), _KEYS_SQL))

    # one reading a name: the one most names attest, then the likeliest
    attested = read.groupBy("pk").agg(F.countDistinct("name").alias("support"), F.sum("rank").alias("doubt"))
    scored = read.join(attested, "pk").withColumn("met", F.when(F.col("support") > 1, F.col("support")).otherwise(0))
    best = scored.groupBy("name").agg(F.max(F.struct("met", F.when(F.col("met") > 0, -F.col("doubt")).otherwise(-F.col("rank")).alias("likely"), "pk", "kind", "surname", "given", "initials", "raw")).alias("r"))
    best = cut(best.select("name", "r.pk", "r.kind", "r.surname", "r.given", "r.initials", "r.raw"))
    keys = cut(best.groupBy("pk", "kind", "surname", "given").agg(F.count("*").alias("support"), F.min("initials").alias("initials"), F.array(F.min("raw"), F.max("raw")).alias("raws")))
    spelt = cut(best.filter("kind <> 'org'").groupBy("surname").agg(F.count("*").alias("attested")))

    # misspellings: each key to the best attested of those one letter away
    known = frozenset(given)
    forms = keys.select("pk", "kind", "surname", "given", "initials", "raws").mapInArrow(_misspellings(known), "pk long, form long, rule string")
    own = keys.join(spelt, "surname", "left").select("pk", F.when(F.col("kind").isin("initials", "single"), F.greatest("support", "attested")).otherwise(F.col("support")).alias("support"))
    forms = forms.join(own, "pk")
    met = cut(forms.withColumn("well", (F.col("rule") == "known").cast("int")))
    top = met.groupBy("form").agg(F.max(F.struct("support", "well", "pk")).alias("top"), F.count("*").alias("n")).filter("n > 1").select("form", F.col("top.pk").alias("root"), F.col("top.support").alias("best"))
    weak = met.filter("rule <> 'known'").join(top, "form").filter((F.col("pk") != F.col("root")) & (F.col("support") <= F.greatest(F.lit(FEW), SELDOM * F.col("best"))))
    roots = cut(components(weak.select("pk", "root"), "pk", "root").withColumnRenamed("node", "pk"))
    placed = best.join(roots, "pk", "left").withColumn("root", F.coalesce("root", "pk"))
    placed = cut(placed)

    # initials: to the one person of the surname that bears them
    full = placed.filter("kind = 'person'").select("root", "surname", F.substring("given", 1, 1).alias("g"), F.substring("initials", 2, 1).alias("middle"))
    bearers = full.groupBy("surname", "g", "root").agg(F.max(F.col("middle")).alias("middle")).groupBy("surname", "g", "middle").agg(F.count("*").alias("n"), F.min("root").alias("root"))
    short = placed.filter("kind = 'initials'").select("pk", "surname", "initials").distinct()
    joined = short.withColumn("g", F.substring("initials", 1, 1)).join(bearers, ["surname", "g"])  # a row a second initial, however many bear the surname
    exact = F.substring("initials", 2, 1) == F.col("middle")
    loose = (F.length("initials") == 1) | (F.col("middle") == "")
    fits = lambda test, c: F.when(test, F.col(c))
    chosen = joined.groupBy("pk").agg(F.sum(fits(exact, "n")).alias("exacts"), F.min(fits(exact, "root")).alias("exact"), F.sum(fits(loose, "n")).alias("looses"), F.min(fits(loose, "root")).alias("loose"))
    chosen = chosen.select("pk", F.when(F.col("exacts") == 1, F.col("exact")).when(F.col("exacts").isNull() & (F.col("looses") == 1), F.col("loose")).alias("bearer"), F.lit(True).alias("met"))
    linked = placed.join(chosen, "pk", "left")

    # initials of a surname nobody bears as spelt: to the bearers one letter away
    lone = placed.filter("kind = 'initials'").join(chosen, "pk", "left_anti").join(spelt, "surname").select(F.col("root").alias("own"), "surname", "raw", "initials", "attested").distinct()
    meant = keys.select(F.col("pk").alias("root"), F.col("given").alias("meant"))
    borne = placed.filter("kind = 'person'").join(meant, "root").join(spelt, "surname").select("root", "surname", "raw", F.substring("given", 1, 1).alias("g"), F.substring("initials", 2, 1).alias("middle"), "meant", "attested").distinct()
    merged = components(near_bearers(lone, borne), "own", "root").select(F.col("node").alias("at"), F.col("root").alias("whole"))
    several = (F.col("kind") == "initials") & F.col("met").isNotNull() & F.col("bearer").isNull()
    linked = linked.withColumn("at", F.when(several, F.xxhash64("name")).otherwise(F.coalesce("bearer", "root"))).join(cut(merged), "at", "left")
    return linked.select("name", F.coalesce("whole", "at").alias("cluster"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return pairs_in_groups(cut(name_clusters(table(spark, directory, "sources"))), "cluster", "name", "name_a", "name_b")


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
