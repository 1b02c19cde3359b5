"""Listings, citations and scores of the library's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import citations as C
from folioforge.functions import scores, text
from folioforge.functions.guide import complete_guide
from folioforge.operators.dedupe import newest_first
from folioforge.operators.notes import clean_note
from folioforge.operators.store import markdown_mirror
from folioforge.plans import sql as Q
from folioforge.runtime import join_small, table


def list_sources_newest(spark: SparkSession, d: str) -> DataFrame:
    return newest_first(table(spark, d, "sources").select("id", "title", "created_at"))


def list_projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").select("id", "name", F.coalesce("description", F.lit("")).alias("description")).orderBy("name", "id")


def source_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Point lookup by key; the equality reaches the scan."""
    return table(spark, d, "sources").filter(F.col("id") == 1002).select("id", "title", "year", "doi")


def projects_for_sources(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "source_project").distinct()
    names = table(spark, d, "projects").select(F.col("id").alias("project_id"), "name")
    listed = join_small(links, names, "project_id", "inner").groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "project_id"))), lambda x: x["name"]), "; ").alias("projects"))
    return listed


def note_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_notes").filter(F.col("note_scope") == "body").groupBy("source_id").agg(F.count("*").alias("notes"))


def home_listing(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").select("id", "title", "authors", "doi", "isbn", "notes", "url")
    said = [F.when(F.col(c) != "", F.col(c)) for c in ("title", "doi", "isbn", "notes")]
    names = F.array_join(C.authors_of(), ", ")
    rows = s.join(projects_for_sources(spark, d).withColumnRenamed("source_id", "id"), "id", "left").join(note_counts(spark, d).withColumnRenamed("source_id", "id").withColumnRenamed("notes", "note_count"), "id", "left")
    haystack = F.concat_ws(" ", said[0], F.when(names != "", names), *said[1:], F.col("projects"))
    link = F.when(text.trim("doi") != "", C.identifier_link()).otherwise(text.safe_url("url"))
    return rows.select("id", haystack.alias("haystack"), F.coalesce("note_count", F.lit(0)).cast("bigint").alias("note_count"), F.when(F.coalesce("note_count", F.lit(0)) == 1, "1 note").otherwise(F.concat(F.coalesce("note_count", F.lit(0)).cast("string"), F.lit(" notes"))).alias("note_label"), link.alias("link"))


def text_and_collection_filter(spark: SparkSession, d: str) -> DataFrame:
    """Records whose text holds a term in any case and that lie in a collection."""
    inside = table(spark, d, "source_project").filter(F.col("project_id") == 3).select(F.col("source_id").alias("id")).distinct()
    s = table(spark, d, "sources").join(inside, "id", "left_semi")
    return s.filter(F.contains(F.lower(F.concat_ws(" ", "title", "notes")), F.lower(text.trim(F.lit(" Harbour "))))).select("id", "title")


def notes_public(spark: SparkSession, d: str) -> DataFrame:
    n = clean_note(table(spark, d, "source_notes"))
    return n.select("id", "source_id", "note_scope", "start_offset", "end_offset", F.array_join("tag_labels", "|").alias("tags"), F.array_join(F.transform("project_ids", lambda x: x.cast("string")), ",").alias("projects"))


def theme_clusters(spark: SparkSession, d: str) -> DataFrame:
    label = text.trim(F.coalesce(text.falsy_null("journal"), text.falsy_null("publisher"), F.lit("general")))
    s = table(spark, d, "sources").select(label.alias("label"), "id", "created_at")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.max(F.struct("created_at", "id"))["id"].alias("newest_id"), F.min("id").alias("first_id"))


def digest_input(spark: SparkSession, d: str) -> DataFrame:
    return newest_first(table(spark, d, "sources").select("id", "title", "year", "journal", "created_at")).limit(15)


def _citations(style: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "sources").select("id", C.citation(style).alias("citation"))

    return run


def bibliography_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the bibliography in the order of their letters, capitals alike; empty ones left out. The file is written by a sorted text sink."""
    lines = table(spark, d, "sources").select(C.apa().alias("citation")).filter("citation <> ''")
    return lines.groupBy("citation").agg(F.count("*").alias("times")).orderBy(F.lower("citation"), "citation")


def citation_cache_size(spark: SparkSession, d: str) -> DataFrame:
    cache = C.citation_cache(include_pages=False)
    return table(spark, d, "sources").select("id", F.explode(cache).alias("style", "citation")).select("id", "style", F.length("citation").cast("bigint").alias("n"))


def quality_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", scores.quality_score().alias("score"), scores.quality_reason().alias("reason"))


def survival_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", scores.survival_score().alias("score"))


def citation_qa(spark: SparkSession, d: str) -> DataFrame:
    issues = scores.citation_issues(C.apa())
    return table(spark, d, "sources").select("id", F.array_join(issues, "; ").alias("issues"), (F.size(issues) == 0).alias("pass"))


def fold_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").groupBy(C.fold_type().alias("kind")).agg(F.count("*").alias("n"))


def body_preview(spark: SparkSession, d: str) -> DataFrame:
    b = F.coalesce("body_text", F.lit(""))
    cut = F.substring(b, 1, 1200)
    shown = F.concat(cut, F.when(F.octet_length(b) > F.length(cut), "\n[truncated]").otherwise(""))
    excerpt = F.coalesce(text.falsy_null("provenance_summary"), text.falsy_null("notes"), b)
    short = F.when(F.length(excerpt) > 220, F.concat(F.substring(excerpt, 1, 220), F.lit("..."))).otherwise(excerpt)
    return table(spark, d, "sources").select("id", F.md5(shown).alias("preview_md5"), F.length(shown).cast("bigint").alias("preview_len"), F.md5(short).alias("excerpt_md5"))


def picker_labels(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(text.trim("title") != "", text.trim("title")).otherwise(F.concat(F.lit("Source #"), F.col("id").cast("string")))
    author = F.coalesce(F.try_element_at(C.authors_of(), F.lit(1)), F.lit(""))
    year = text.trim("year")
    hint = F.when((author != "") & (year != ""), F.concat(author, F.lit(" ("), year, F.lit(")"))).otherwise(F.concat(author, year))
    return table(spark, d, "sources").select("id", title.alias("label"), hint.alias("hint"))


def embedding_input(spark: SparkSession, d: str) -> DataFrame:
    parts = ["year", "publisher", "journal", "ai_summary", "doi", "isbn", "url", "provenance_summary", "notes", "raw_input"]
    joined = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", ", ""), *[F.coalesce(p, F.lit("")) for p in parts])
    return table(spark, d, "sources").select("id", F.md5(text.trim(joined)).alias("input_md5"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", text.fingerprint("doi", "isbn", "title", "authors", "year").alias("fingerprint"))


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    raw = "raw_input"
    return table(spark, d, "sources").select("id", text.normalize_isbn("isbn").alias("isbn"), text.extract_doi("doi").alias("doi"), text.extract_year(raw).alias("year"), text.extract_year_wide("year").alias("year_wide"))


def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", text.norm_text("title").alias("norm_title"), text.first_author("authors").alias("norm_author"))


def significant_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", F.array_join(F.array_distinct(F.filter(F.split(text.norm_text("title"), " "), lambda w: F.octet_length(w) >= 4)), " ").alias("words"))


def accessed_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", C.accessed_line().alias("accessed"))


def safe_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", text.safe_url("url").alias("url"), text.is_video_host("url").alias("video"))


def body_text_plain(spark: SparkSession, d: str) -> DataFrame:
    t = text.html_to_text("body_text", 12_000)
    return table(spark, d, "sources").select("id", F.length(t).cast("bigint").alias("n"), F.md5(t).alias("text_md5"))


def body_clean(spark: SparkSession, d: str) -> DataFrame:
    """Text before it is reformatted: control signs and trailing blanks off, four and more line ends to three."""
    t = F.regexp_replace(F.coalesce("body_text", F.lit("")), r"\r\n|\r", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"[ \t]+\n", "\n")
    t = F.regexp_replace(text.trim(t), r"\n{4,}", "\n\n\n")
    edited = F.when(F.col("body_source").contains("manual_edit"), F.col("body_source")).when(F.col("body_source") != "", F.concat("body_source", F.lit("+manual_edit"))).otherwise("manual_edit")
    return table(spark, d, "sources").select("id", F.length(t).cast("bigint").alias("n"), F.md5(t).alias("text_md5"), (F.length(t) > 120_000).alias("truncated"), edited.alias("label_after_edit"))


def unsynced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").filter(text.blank("zotero_item_key")).select("id")


def guides_complete(spark: SparkSession, d: str) -> DataFrame:
    plain = F.filter(F.coalesce("ai_claims", F.array().cast("array<string>")), lambda x: ~x.rlike(r"^\s*[\[{]"))
    g = complete_guide(F.col("ai_summary"), plain, F.col("ai_methods"), F.col("ai_limitations"))
    return table(spark, d, "sources").select("id", F.length(g).cast("bigint").alias("n"), F.md5(g).alias("guide_md5"))


def markdown_mirrors(spark: SparkSession, d: str) -> DataFrame:
    m = markdown_mirror()
    return table(spark, d, "sources").withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")).select("id", F.length(m).cast("bigint").alias("n"), F.md5(m).alias("mirror_md5"))


def guide_sections(spark: SparkSession, d: str) -> DataFrame:
    """Headed sections of a reading guide."""
    raw = text.trim(F.regexp_replace(F.coalesce("ai_summary", F.lit("")), r"\r\n|\r", "\n"))
    parts = F.filter(F.split(raw, r"\n##\s+"), lambda x: x != "")
    s = table(spark, d, "sources").filter(F.contains(raw, F.lit("\n## "))).select("id", F.posexplode(parts).alias("pos", "part")).filter("pos > 0")
    cut = F.regexp_replace("part", r"^\s+", "")
    return s.select("id", "pos", text.trim(F.substring_index(cut, "\n", 1)).alias("heading"), F.length(text.trim(F.when(F.contains(cut, F.lit("\n")), F.regexp_replace(cut, r"^[^\n]*\n", "")).otherwise(""))).cast("bigint").alias("body_len"))


QUERIES = {f.__name__: f for f in (list_sources_newest, list_projects, source_lookup, projects_for_sources, note_counts, home_listing, text_and_collection_filter, notes_public, theme_clusters, digest_input, bibliography_text, citation_cache_size, quality_score, survival_score, citation_qa, fold_types, body_preview, picker_labels, embedding_input, fingerprints, identifiers, norm_text, significant_words, accessed_dates, safe_urls, body_text_plain, body_clean, unsynced, guides_complete, markdown_mirrors, guide_sections)}
QUERIES |= {f"citations_{s}": _citations(s) for s in C.STYLES}

_T = {c: Q.trim(c) for c in ("title", "journal", "publisher", "year", "volume", "issue", "pages", "doi", "url")}
_A = Q.authors()
_APA_JOURNAL = f"{_T['journal']} || {Q.after(', ', _T['volume'])} || {Q.after('(', _T['issue'], ')')} || {Q.after(', ', _T['pages'])} || '.'"
APA = Q.line(Q.after("", Q.joined(_A, ", & "), "."), Q.after("(", _T["year"], ")."), f"CASE WHEN lower({Q.trim('type')}) = 'video' THEN {Q.after('', _T['title'], ' [Video].')} ELSE {Q.after('', _T['title'], '.')} END", f"CASE WHEN {_T['journal']} <> '' THEN {_APA_JOURNAL} ELSE {Q.after('', _T['publisher'], '.')} END", f"CASE WHEN {_T['doi']} <> '' THEN 'https://doi.org/' || {_T['doi']} ELSE {_T['url']} END")
_MLA_JOURNAL = f"{_T['journal']} || {Q.after(', vol. ', _T['volume'])} || {Q.after(', no. ', _T['issue'])} || {Q.after(', ', _T['year'])} || {Q.after(', pp. ', _T['pages'])} || '.'"
MLA = Q.line(Q.after("", Q.joined(_A, ", and "), "."), Q.after('"', _T["title"], '."'), f"CASE WHEN {_T['journal']} <> '' THEN {_MLA_JOURNAL} ELSE {Q.line(Q.after('', _T['publisher'], ','), Q.after('', _T['year'], '.'))} END", f"CASE WHEN {_T['doi']} <> '' THEN 'doi:' || {_T['doi']} || '.' ELSE {Q.after('', _T['url'], '.')} END")
KIND = f"(CASE WHEN lower({Q.trim('type')}) = '' THEN 'other' " + " ".join(f"WHEN lower({Q.trim('type')}) IN ({', '.join(repr(x) for x in kinds)}) THEN '{k}'" for k, kinds in C.TYPES.items()) + f" ELSE lower({Q.trim('type')}) END)"
SAFE_URL = f"(CASE WHEN regexp_matches({_T['url']}, '^(?i:https?)://[^\\s]+$') THEN {_T['url']} ELSE '' END)"
LINK = f"(CASE WHEN {_T['doi']} <> '' THEN {Q.sentence(f"'https://doi.org/' || ltrim(regexp_replace({_T['doi']}, '^(https?://)?(dx\\.)?doi\\.org/', '', 'i'), '/')")} WHEN {SAFE_URL} <> '' THEN {Q.sentence(SAFE_URL)} ELSE '' END)"
_DATE = f"coalesce(try_strptime({Q.trim('accessed_at')}, '%Y-%m-%d'), try_strptime({Q.trim('accessed_at')}, '%d.%m.%Y'), CASE WHEN regexp_matches({Q.trim('accessed_at')}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}') THEN try_cast({Q.trim('accessed_at')} AS TIMESTAMP) END)"
ACCESSED = f"(CASE WHEN {Q.trim('accessed_at')} = '' THEN '' ELSE {Q.sentence(f"'Accessed ' || coalesce(strftime({_DATE}, '%B %-d, %Y'), {Q.trim('accessed_at')})")} END)"
_PARTICLES = "|".join(p.replace(".", "\\.") for p in C.PARTICLES)


def _chicago() -> str:
    article, website = f"({KIND} = 'article' OR {_T['journal']} <> '')", f"({KIND} = 'website' OR ({_T['journal']} = '' AND {KIND} NOT IN ('article', 'book', 'video') AND {_T['url']} <> ''))"
    squeezed = f"trim(regexp_replace(n[1], '\\s+', ' ', 'g'), {Q.WS})"
    turned = f"(CASE WHEN len(n) = 0 THEN n ELSE list_concat([CASE WHEN contains(n[1], ',') THEN n[1] ELSE regexp_replace({squeezed}, '^(?:(.*?)\\s)??((?:(?:{_PARTICLES})\\s)*\\S+)$', '\\2, \\1', 'i') END], n[2:]) END)"
    fixed = f"(CASE WHEN len(n) = 0 THEN n ELSE list_concat([regexp_replace(({turned})[1], ', $', '')], n[2:]) END)"
    title = f"trim({Q.rtrim_dots(_T['title'])}, {Q.WS})"
    imprint = f"concat_ws(', ', nullif({_T['publisher']}, ''), nullif({_T['year']}, ''))"
    inside = f"({_T['journal']} || CASE WHEN {_T['journal']} <> '' AND {_T['volume']} <> '' THEN ' ' ELSE '' END || {_T['volume']} || {Q.after(', no. ', _T['issue'])} || {Q.after(' (', _T['year'], ')')} || {Q.after(': ', _T['pages'])})"
    site = f"concat_ws(', ', coalesce(nullif({_T['journal']}, ''), nullif({_T['publisher']}, '')), nullif({_T['year']}, ''))"
    venue = f"CASE WHEN {article} THEN {Q.sentence(f"CASE WHEN {inside} = '' THEN {imprint} ELSE {inside} END")} WHEN {website} THEN {Q.line(Q.sentence(site), ACCESSED)} ELSE {Q.sentence(imprint)} END"
    whole = Q.line(Q.sentence(Q.joined("n", ", and ")), f"CASE WHEN {article} OR {website} THEN {Q.after('"', title, '."')} ELSE {Q.sentence(title)} END", f"CASE WHEN {KIND} = 'video' THEN 'Video.' ELSE '' END", venue, LINK)
    return f"WITH a AS (SELECT *, {_A} AS n0 FROM sources), b AS (SELECT * EXCLUDE (n), {fixed} AS n FROM (SELECT *, n0 AS n FROM a)) SELECT id, {whole} AS citation FROM b"


_FIRST = f"(CASE WHEN len(authors) > 0 THEN {Q.norm('authors[1]')} ELSE '' END)"
_AGENT = {"quality": [(f"{_T['title']} <> ''", 0.2, "has title"), ("len(coalesce(authors, [])) > 0", 0.15, "has authors"), (f"{_T['year']} <> ''", 0.15, "has year"), (f"({_T['doi']} <> '' OR {Q.trim('isbn')} <> '')", 0.2, "has persistent identifier"), (f"({_T['publisher']} <> '' OR {_T['journal']} <> '')", 0.1, "has source venue"), (f"{Q.trim('notes')} <> ''", 0.1, "has notes")]}
_ADD = " + ".join(f"(CASE WHEN {t} THEN {w}::DOUBLE ELSE 0 END)" for t, w, _ in _AGENT["quality"])
_SURVIVE = " + ".join(f"(CASE WHEN {Q.trim(f)} <> '' THEN 1.0::DOUBLE ELSE 0 END)" for f in scores.SURVIVAL_FIELDS)
SURVIVAL = f"(least(2.0::DOUBLE, len(coalesce(authors, [])) * 0.5::DOUBLE) + {_SURVIVE} + (CASE WHEN {Q.trim('zotero_item_key')} <> '' THEN 1.5::DOUBLE ELSE 0 END) + (CASE WHEN {Q.trim('origin_provider')} = 'zotero' THEN 0.5::DOUBLE ELSE 0 END))"
_PROJECTS = "SELECT source_id, string_agg(name, '; ' ORDER BY name, project_id) AS projects FROM (SELECT DISTINCT source_id, project_id FROM source_project) l JOIN projects p ON p.id = l.project_id GROUP BY source_id"
_FOLDED = "replace(replace(coalesce({0}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_C = {c: f"coalesce({c}, '')" for c in ("title", "type", "year", "journal", "publisher", "volume", "issue", "pages", "doi", "isbn", "url", "accessed_at", "notes", "raw_input")}
_MIRROR = "concat_ws(chr(10), '# ' || CASE WHEN {title} <> '' THEN {title} ELSE 'Untitled Source' END, '', '- ID: ' || id, '- Type: ' || {type}, '- Authors: ' || array_to_string(list_transform(coalesce(authors, []), lambda x: coalesce(x, '')), ', '), '- Year: ' || {year}, '- Journal: ' || {journal}, '- Publisher: ' || {publisher}, '- Volume: ' || {volume}, '- Issue: ' || {issue}, '- Pages: ' || {pages}, '- DOI: ' || {doi}, '- ISBN: ' || {isbn}, '- URL: ' || {url}, '- Accessed At: ' || {accessed_at}, '- Updated: ' || coalesce(strftime(updated_at, '%Y-%m-%d %H:%M:%S'), ''), '', '## Notes', '', {notes}, '', '## Raw Input', '', {raw_input}, '')".format(**_C)


def _section(text: str, title: str, items: str) -> str:
    clean = f"list_filter(list_transform(coalesce({items}, []), lambda x: {Q.trim('x')}), lambda x: x <> '')"
    quoted = title.replace("/", "\\/")
    return f"(CASE WHEN regexp_matches({text}, '(?i)(^|\\n)\\s{{0,3}}#{{2,6}}\\s+{quoted}\\s*(\\n|$)') OR len({clean}) = 0 THEN {text} ELSE {text} || chr(10) || chr(10) || '## {title}' || chr(10) || chr(10) || array_to_string(list_transform({clean}, lambda x: '- ' || regexp_replace(x, '\\s+', ' ', 'g')), chr(10) || chr(10)) END)"


_GUIDE = f"""WITH a AS (SELECT id, ai_methods, ai_limitations, list_filter(coalesce(ai_claims, []), lambda x: NOT regexp_matches(x, '^\\s*[\\[{{]')) AS claims, CASE WHEN {Q.trim('ai_summary')} = '' THEN '' ELSE rtrim(ai_summary, {Q.WS}) END AS t FROM sources),
    b AS (SELECT *, {_section('t', 'Key claims', 'claims')} AS u FROM a), c AS (SELECT *, {_section('u', 'Methods / approach', 'ai_methods')} AS v FROM b), e AS (SELECT id, {_section('v', 'Limitations', 'ai_limitations')} AS g FROM c) SELECT id, length(g) AS n, md5(g) AS guide_md5 FROM e"""
SQL = {
    "guides_complete": _GUIDE,
    "markdown_mirrors": f"SELECT id, length({_MIRROR}) AS n, md5({_MIRROR}) AS mirror_md5 FROM sources",
    "list_sources_newest": "SELECT id, title, created_at FROM sources",
    "list_projects": "SELECT id, name, coalesce(description, '') AS description FROM projects",
    "source_lookup": "SELECT id, title, year, doi FROM sources WHERE id = 1002",
    "projects_for_sources": _PROJECTS,
    "note_counts": "SELECT source_id, count(*) AS notes FROM source_notes WHERE note_scope = 'body' GROUP BY source_id",
    "home_listing": f"""WITH p AS ({_PROJECTS}), n AS (SELECT source_id, count(*) AS c FROM source_notes WHERE note_scope = 'body' GROUP BY 1)
        SELECT id, concat_ws(' ', nullif(title, ''), nullif(array_to_string({_A}, ', '), ''), nullif(doi, ''), nullif(isbn, ''), nullif(notes, ''), projects) AS haystack, coalesce(c, 0) AS note_count,
        CASE WHEN coalesce(c, 0) = 1 THEN '1 note' ELSE coalesce(c, 0)::VARCHAR || ' notes' END AS note_label, CASE WHEN {_T['doi']} <> '' THEN {LINK} ELSE {SAFE_URL} END AS link
        FROM sources s LEFT JOIN p ON p.source_id = s.id LEFT JOIN n ON n.source_id = s.id""",
    "text_and_collection_filter": "SELECT id, title FROM sources WHERE id IN (SELECT source_id FROM source_project WHERE project_id = 3) AND contains(lower(concat_ws(' ', title, notes)), 'harbour')",
    "notes_public": f"""SELECT id, source_id, CASE WHEN note_scope IN ('body', 'reading_guide') THEN note_scope ELSE 'body' END AS note_scope, greatest(0, coalesce(start_offset, 0)) AS start_offset, greatest(0, coalesce(end_offset, 0)) AS end_offset,
        coalesce(array_to_string((WITH u AS (SELECT unnest(list_transform(coalesce(tag_labels, []), lambda x: {Q.trim('x')})) AS v, generate_subscripts(coalesce(tag_labels, []), 1) AS i) SELECT list(v ORDER BY i) FROM (SELECT v, min(i) AS i FROM u WHERE v NOT IN ('', '0') GROUP BY v)), '|'), '') AS tags,
        coalesce(array_to_string((WITH u AS (SELECT unnest(coalesce(project_ids, [])) AS v, generate_subscripts(coalesce(project_ids, []), 1) AS i) SELECT list(v::VARCHAR ORDER BY i) FROM (SELECT v, min(i) AS i FROM u WHERE v > 0 GROUP BY v)), ','), '') AS projects FROM source_notes""",
    "theme_clusters": f"SELECT trim({Q.first_said('journal', 'publisher', "'general'")}, {Q.WS}) AS label, count(*) AS n, arg_max(id, (created_at, id)) AS newest_id, min(id) AS first_id FROM sources GROUP BY 1",
    "digest_input": "SELECT id, title, year, journal, created_at FROM sources ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 15",
    "bibliography_text": f"SELECT citation, count(*) AS times FROM (SELECT {APA} AS citation FROM sources) WHERE citation <> '' GROUP BY citation",
    "quality_score": f"SELECT id, round(least(1.0::DOUBLE, 0.2::DOUBLE + {_ADD}), 3) AS score, concat_ws(', ', {', '.join(f"CASE WHEN {t} THEN '{r}' END" for t, _, r in _AGENT['quality'])}) AS reason FROM sources",
    "survival_score": f"SELECT id, {SURVIVAL} AS score FROM sources",
    "citation_qa": f"SELECT id, concat_ws('; ', CASE WHEN coalesce(title, '') = '' THEN 'Missing title' END, CASE WHEN coalesce(year, '') = '' THEN 'Missing year' END, CASE WHEN {APA} = '' THEN 'Empty citation output' END) AS issues, coalesce(title, '') <> '' AND coalesce(year, '') <> '' AND {APA} <> '' AS pass FROM sources",
    "fold_types": f"SELECT {KIND} AS kind, count(*) AS n FROM sources GROUP BY 1",
    "body_preview": f"""WITH b AS (SELECT *, coalesce(body_text, '') AS b, {Q.first_said('provenance_summary', 'notes', 'body_text')} AS e FROM sources), c AS (SELECT *, substr(b, 1, 1200) || CASE WHEN strlen(b) > length(substr(b, 1, 1200)) THEN chr(10) || '[truncated]' ELSE '' END AS s FROM b)
        SELECT id, md5(s) AS preview_md5, length(s) AS preview_len, md5(CASE WHEN length(e) > 220 THEN substr(e, 1, 220) || '...' ELSE e END) AS excerpt_md5 FROM c""",
    "picker_labels": f"SELECT id, CASE WHEN {_T['title']} <> '' THEN {_T['title']} ELSE 'Source #' || id END AS label, CASE WHEN coalesce(({_A})[1], '') <> '' AND {_T['year']} <> '' THEN ({_A})[1] || ' (' || {_T['year']} || ')' ELSE coalesce(({_A})[1], '') || {_T['year']} END AS hint FROM sources",
    "embedding_input": "SELECT id, md5(" + Q.trim("concat_ws(chr(10), coalesce(title, ''), array_to_string(list_transform(coalesce(authors, []), lambda x: coalesce(x, '')), ', '), " + ", ".join(f"coalesce({c}, '')" for c in ("year", "publisher", "journal", "ai_summary", "doi", "isbn", "url", "provenance_summary", "notes", "raw_input")) + ")") + ") AS input_md5 FROM sources",
    "fingerprints": f"SELECT id, translate(concat_ws('|', {_T['doi']}, {Q.trim('isbn')}, {_T['title']}, {Q.trim('authors[1]')}, {_T['year']}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS fingerprint FROM sources",
    "identifiers": f"SELECT id, {Q.isbn('isbn')} AS isbn, regexp_extract(coalesce(doi, ''), '(?i)10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+') AS doi, regexp_extract(coalesce(raw_input, ''), '\\b(19|20)\\d{{2}}\\b') AS year, regexp_extract(coalesce(year, ''), '\\b(1\\d{{3}}|20\\d{{2}}|2100)\\b') AS year_wide FROM sources",
    "norm_text": f"SELECT id, {Q.norm('title')} AS norm_title, {_FIRST} AS norm_author FROM sources",
    "significant_words": f"WITH w AS (SELECT id, unnest(string_split({Q.norm('title')}, ' ')) AS w, generate_subscripts(string_split({Q.norm('title')}, ' '), 1) AS i FROM sources), u AS (SELECT id, w, min(i) AS i FROM w WHERE strlen(w) >= 4 GROUP BY id, w), j AS (SELECT id, string_agg(w, ' ' ORDER BY i) AS words FROM u GROUP BY id) SELECT s.id, coalesce(words, '') AS words FROM sources s LEFT JOIN j ON j.id = s.id",
    "accessed_dates": f"SELECT id, {ACCESSED} AS accessed FROM sources",
    "safe_urls": f"SELECT id, {SAFE_URL} AS url, regexp_matches(coalesce(url, ''), '(?i)^[a-z]+://[^/]*(youtube\\.com|youtu\\.be)') AS video FROM sources",
    "body_text_plain": f"WITH t AS (SELECT id, substr({Q.trim("regexp_replace(regexp_replace(coalesce(body_text, ''), '<[^>]*>', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')")}, 1, 12000) AS t FROM sources) SELECT id, length(t) AS n, md5(t) AS text_md5 FROM t",
    "body_clean": f"""WITH a AS (SELECT id, body_source, regexp_replace(regexp_replace({_FOLDED.format('body_text')}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[ \\t]+\\n', chr(10), 'g') AS t FROM sources), b AS (SELECT id, body_source, regexp_replace({Q.trim('t')}, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS t FROM a)
        SELECT id, length(t) AS n, md5(t) AS text_md5, length(t) > 120000 AS truncated, CASE WHEN contains(body_source, 'manual_edit') THEN body_source WHEN body_source <> '' THEN body_source || '+manual_edit' ELSE 'manual_edit' END AS label_after_edit FROM b""",
    "unsynced": f"SELECT id FROM sources WHERE {Q.trim('zotero_item_key')} = ''",
    "guide_sections": f"""WITH r AS (SELECT id, {Q.trim(_FOLDED.format('ai_summary'))} AS raw FROM sources), p AS (SELECT id, list_filter(regexp_split_to_array(raw, '\\n##\\s+'), lambda x: x <> '') AS ps FROM r WHERE contains(raw, chr(10) || '## ')),
        e AS (SELECT id, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS pos FROM p), c AS (SELECT id, pos, regexp_replace(part, '^\\s+', '') AS cut FROM e WHERE pos > 0)
        SELECT id, pos::INTEGER AS pos, {Q.trim("string_split(cut, chr(10))[1]")} AS heading, length({Q.trim("CASE WHEN contains(cut, chr(10)) THEN regexp_replace(cut, '^[^\\n]*\\n', '') ELSE '' END")}) AS body_len FROM c""",
    "citations_apa": f"SELECT id, {APA} AS citation FROM sources",
    "citations_mla": f"SELECT id, {MLA} AS citation FROM sources",
    "citations_chicago18": _chicago(),
}
_BARE = "SELECT * REPLACE ('' AS pages) FROM sources"
SQL["citation_cache_size"] = f"WITH apa AS (SELECT id, length({APA}) AS n FROM ({_BARE})), mla AS (SELECT id, length({MLA}) AS n FROM ({_BARE})), ch AS (SELECT id, length(citation) AS n FROM ({_chicago().replace('FROM sources)', f'FROM ({_BARE}))')})) SELECT id, 'apa' AS style, n FROM apa UNION ALL SELECT id, 'mla', n FROM mla UNION ALL SELECT id, 'chicago18', n FROM ch UNION ALL SELECT id, 'chicago', n FROM ch"
