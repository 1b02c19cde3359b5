"""Lines of web text: what a line evidently is, and how often it recurs."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.runtime import cached, cut

# Filler words of typesetters.
FILLER = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
# Words that stand alone where a value was never filled in.
STUBS = frozenset("undefined null nan none tbd tba tbc todo xxx xxxx asdf asdfasdf jkl qwerty test testing foo bar baz placeholder n/a untitled example sample dummy".split())
# Cues of error pages, refusals and notices that scripts or cookies are required.
NOTICES = [
    r"(please |you need to |you must |veuillez |bitte |por favor,? ?)?(enable|activate|allow|turn on|activer|activez|aktivieren|active|habilite|activar)( sie)? (javascript|scripts?|scripting|cookies)",
    r"(javascript|cookies|scripts?|scripting) (is|are|must be|has to be|need to be|ist|sind|est|está)\b", r"javascript (required|disabled|is required)", r"this (site|page|app) requires (scripts|javascript|cookies)",
    r"your browser is not supported", r"reload \S+ after", r"if this takes too long", r"loading\W*$", r"please wait\b", r"just a moment", r"one moment", r"checking your browser", r"please complete the security check",
    r"verify (that )?you are( a)? human", r"to continue, type the characters", r"are you a robot", r"attention required", r"redirecting\b", r"you are being redirected", r"sie werden weitergeleitet", r"weiterleitung",
    r"(http )?(error|fehler|erreur)( code)?:? ?#", r"(error|fehler|erreur|server error|internal server error)\W*$", r"#:? (not found|forbidden|unauthorized|bad gateway|bad request|gone|internal server error|service (temporarily )?unavailable|gateway time-?out|too many requests|nicht gefunden|page introuvable|access denied|error)", r"(page|seite|página) (not found|nicht gefunden|no encontrada|introuvable|unavailable)", r"page introuvable",
    r"not found\W*$", r"sorry, (the|this) page", r"oops\b", r"the requested (url|resource|page)", r"the page you (requested|were looking for|are looking for)", r"la page demandée", r"die angeforderte seite", r"la página solicitada",
    r"access (to this \w+ )?(is |has been |was )?denied", r"zugriff verweigert", r"acc(è|e)s (refusé|interdit)", r"acceso denegado", r"you (do not|don.t) have (access|permission)", r"forbidden\W*$", r"unauthorized\W*$",
    r"your ip address has been", r"your session has expired", r"session (has )?(expired|timed out)", r"(service|server) (temporarily )?(unavailable|error)", r"we are down for", r"(we are )?(down|closed) for (scheduled )?maintenance", r"under (construction|maintenance)", r"site under", r"an? (unexpected |internal |unknown )?error (has )?occurred", r"une erreur est survenue", r"ein (unerwarteter )?fehler ist aufgetreten", r"se ha producido un error", r"something went wrong", r"bad gateway", r"gateway time-?out",
    r"you must (sign|log) in", r"(sign|log) in to continue", r"please (sign|log) in", r"this content is (only )?(available|restricted)", r"(subscribe|sign in|log in) to (read|continue|view)", r"captcha\b", r"user name\W*$", r"password\W*$", r"forgot (your )?password", r"request id\b", r"incident #", r"reference ##", r"bitte wenden sie sich",
    r"too many requests", r"enable javascript", r"this page (could|can) ?not be", r"connection (timed out|refused)", r"stack trace", r"at \w+ ?\([\w:./ #]*\)", r"(fatal|parse|syntax) error", r"warning: ", r"traceback", r"file not found", r"no encontrado", r"nicht gefunden", r"introuvable",
]
# Cues of texts that were to be replaced.
STANDINS = [
    r"your (\w+ )?(text|title|content|name|abstract)( goes)? here", r"(text|title|content|abstract|description) (goes |to be )?here", r"hier steht ihr (text|titel)", r"(votre texte|votre titre) ici", r"(su|tu) (texto|título) aquí", r"this is a placeholder", r"content coming soon", r"coming soon", r"\(?(no title|untitled|ohne titel|sans titre|sin título|no abstract|no content)\)?\W*$", r"untitled (document|page|article)\W*$", r"new (document|page|article)( ?\(?#\)?)?\W*$", r"document ?#\W*$", r"(article |page )?(title|text|abstract) placeholder", r"placeholder\b", r"\[object object\]", r"title[ _]goes[ _]here", r"sample (text|page)\W*$", r"(insert|enter|add|type) (your )?(text|title|name|abstract|content)", r"titel hier", r"título aquí",
]
_NOTICE = re.compile(r"\W*(?:" + "|".join(NOTICES) + ")", re.IGNORECASE)
_STANDIN = re.compile(r"\W*(?:" + "|".join(STANDINS) + ")", re.IGNORECASE)
_NAME = r"[A-Za-z][\w. -]{0,40}"
PLACEHOLDER = re.compile(rf"\{{\{{[\s\w.|-]{{1,60}}\}}\}}|\$\{{{_NAME}\}}|#\{{{_NAME}\}}|<%=?\s*{_NAME}\s*%>|<<\s*{_NAME}\s*>>|\[\[\s*{_NAME}\s*\]\]|%%{_NAME}%%|@@{_NAME}@@|__[A-Za-z][\w.]{{0,40}}?__|\[(?:INSERT|ENTER|ADD|YOUR)\b[^\]]{{0,60}}\]|\{{{_NAME}\}}", re.IGNORECASE)
# Words that frame placeholders in a template.
_FRAME = re.compile(r"\b(?:abstract|keywords?|section|title|doi|author|authors|received|accepted|date|dear|journal|summary|thank you for your submission|to|by|of|in|the|p|br|div|span|h1|h2|volume|issue|hello|hi)\b", re.IGNORECASE)
_SEPARATED = re.compile(r"(?:\S(?:\s[|»›·•>/]\s|\s{2,}|\t)\S.*?){2}")
_ENDED = re.compile(r"[.!?…:;]['\"”“»)’]*$")
# Cues of consent notices, offers and legal lines around an article.
FURNISHING = re.compile(r"cookies?\b|privacy|datenschutz|impressum|we and our partners|continuing to browse|stores small files|all rights reserved|©|copyright \S+ by|registered imprint|newsletter|mailing list|issn\b|powered by|last updated|follow us|table-of-contents alert|terms (of use|and conditions)|your email|new issues by email", re.IGNORECASE)


def shape(line: str) -> str:
    """The line in lower case without the particulars of numbers."""
    return re.sub(r"\d+", "#", " ".join(line.split())).lower()


def line_key(line: Column) -> Column:
    """The same normal form for columns, hashed, with host names made alike."""
    plain = F.regexp_replace(F.lower(F.trim(line)), r"\d+", "#")
    plain = F.when(plain.rlike(r"\.[a-z]{2}"), F.regexp_replace(plain, r"\b(?:[a-z0-9-]+\.)+[a-z]{2,}\b", "@")).otherwise(plain)
    return F.xxhash64(F.regexp_replace(plain, r"\s+", " "))


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z]+://(?:www\.)?([^/:?#]+)", 1), F.lit(""))


def is_filler(line: str) -> bool:
    words = re.findall(r"[^\W\d_]+", line.lower())
    if not words:
        return False
    if len(words) >= 4 and sum(w in FILLER for w in words) >= 0.7 * len(words) and sum(w not in _COMMON for w in words) >= 0.6 * len(words):
        return True
    return all(w in STUBS or w == "object" for w in words) or len(words) >= 2 and set(words) <= STUBS | {"jkl", "asdf"}


_POINTS = ".,;:!?()\"'“”‘’[]"
_COMMON = frozenset(("in", "do", "et", "est", "non", "sed", "id", "ut", "ex", "sit", "qui", "a"))
_FILLS = FILLER | STUBS | {"object", "jkl", "asdf"}
_TELLING = _FILLS - _COMMON
_MARKS = ("{", "<", "[", "%%", "@@", "__")
#: Which beginnings of lines a notice or stand-in may go on from; most lines are told apart by these.
_BEGINS = regex.compile(r"\W*(?:" + "|".join(NOTICES + STANDINS) + ")", regex.IGNORECASE)


@cached(1 << 15)
def _may_begin(start: str) -> bool:
    return _BEGINS.match(start, partial=True) is not None


def evidence(line: str) -> str:
    """notice, placeholder or filler if the line is nothing else; else nothing."""
    bare = line.strip()
    words = bare.lower().split()
    if not words:
        return ""
    if any(m in bare for m in _MARKS) and PLACEHOLDER.search(bare):
        rest = _FRAME.sub(" ", PLACEHOLDER.sub(" ", bare))
        if len(re.findall(r"[^\W\d_]{2,}", rest)) <= 3:
            return "placeholder"
    if (words[0].strip(_POINTS) in _FILLS or not words[0].isalpha() or not _TELLING.isdisjoint(words)) and is_filler(bare):
        return "filler"
    if len(words) <= 30 and _may_begin(shape(bare[:12])[:6]):
        form = shape(bare)
        if _STANDIN.match(form):
            return "filler"
        if _NOTICE.match(form):
            return "notice"
    return ""


def is_notice_title(form: str) -> bool:
    """A notice and at most three words more; a real title that begins like one goes on."""
    m = _NOTICE.match(form)
    return bool(m) and "," not in form[m.end() :] and len(form[m.end() :].split()) <= 3


def is_content(line: str) -> bool:
    """Prose: some words that end as a sentence does, and no separators or cues of furnishing."""
    bare = line.strip()
    words = bare.split()
    if len(words) < 4 or FURNISHING.search(bare) and len(words) < 30 and len(words) - len(bare.split(".")) < 25 and not re.match(r"\W*(?:the|a|an|one|readers who|of course|in )\b", bare, re.IGNORECASE):
        return False
    if _SEPARATED.search(bare) or len(words) < 12 and not _ENDED.search(bare):
        return False
    return not evidence(bare)


def recurrent_lines(sources: DataFrame, least: int = 3, share: float = 0.01, hosts: int = 3) -> DataFrame:
    """host, key: lines that recur among the different texts of a host: in least of them, and that share of them; host '*' for lines that recur on so many hosts.

    Sentences are counted once for all texts with the same sentences, so that copies of an article under other menus make none recur.
    """
    lines = F.split("body_text", "\n")
    sentence = lambda x: x.rlike(r"[.!?…][\"”»)]?\s*$") & (F.size(F.split(F.trim(x), r"\s+")) >= 6)
    texts = sources.select(host_of(F.col("url")).alias("host"), lines.alias("lines"), F.xxhash64("body_text").alias("body"), F.xxhash64(F.array_sort(F.array_distinct(F.filter(lines, sentence)))).alias("said"))
    keyed = texts.select("host", "body", "said", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(line_key(x).alias("key"), sentence(x).alias("sentence"))))).alias("line"))
    counted = cut(keyed.select("host", "line.key", F.when(F.col("line.sentence"), F.col("said")).otherwise(F.col("body")).alias("text")).distinct().groupBy("host", "key").agg(F.count("*").alias("docs")).filter(F.col("docs") >= 2))
    whole = texts.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    own = counted.filter(F.col("docs") >= least).join(whole, "host").filter(F.col("docs") >= share * F.col("texts")).select("host", "key")
    return own.unionByName(counted.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= hosts).select(F.lit("*").alias("host"), "key"))
