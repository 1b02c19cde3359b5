"""Intake of pasted and imported records, duplicate scan and merge, vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from folioforge.functions import text
from folioforge.operators import checks as K
from folioforge.operators import dedupe as D
from folioforge.operators import vectors as V
from folioforge.plans import bibliography as B
from folioforge.plans import sql as Q
from folioforge.runtime import cut, join_small, table
from folioforge.sources import formats, library

QUERY_STEP = 20


def input_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", text.classify_input("raw_input").alias("kind"))


def bibtex_records(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").filter(text.looks_like_bibtex("raw_input")).select("id", formats.bibtex_udf("raw_input").alias("r"))
    return s.select("id", "r.type", "r.title", F.array_join("r.authors", "; ").alias("authors"), "r.year", "r.doi")


def ris_records(spark: SparkSession, d: str) -> DataFrame:
    s = formats.ris_record(table(spark, d, "sources").filter(text.looks_like_ris("raw_input")).select("id", "raw_input"), "raw_input", "r")
    return s.select("id", "r.type", "r.title", F.array_join("r.authors", "; ").alias("authors"), "r.year")


def _items(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").select("id", "raw_input", library.parse_item("raw_input").alias("item")).filter("item.key is not null and item.data is not null")
    return s.select("id", "item", library.item_record("item").alias("r"))


def item_records(spark: SparkSession, d: str) -> DataFrame:
    r = _items(spark, d)
    return r.select("id", "r.type", "r.title", F.array_join("r.authors", "; ").alias("authors"), "r.year", "r.doi", "r.notes", "r.zotero_item_key", F.array_join("r.project_external_keys", ",").alias("collections"))


def import_match(spark: SparkSession, d: str) -> DataFrame:
    """Items with the stored record they repeat: by external key first, else by fingerprint; of several the oldest."""
    items = _items(spark, d).select("id", F.col("r.zotero_item_key").alias("key"), F.struct("r.*").alias("r"))
    fp = lambda p: text.fingerprint(f"{p}doi", f"{p}isbn", f"{p}title", f"{p}authors", f"{p}year")
    items = items.select("id", "key", fp("r.").alias("fp"))
    s = table(spark, d, "sources").select("id", "created_at", text.trim("zotero_item_key").alias("key"), fp("").alias("fp"))
    oldest = F.min(F.struct("created_at", "id"))["id"]
    by_key = s.filter("key <> ''").groupBy("key").agg(oldest.alias("key_id"))
    by_fp = s.groupBy("fp").agg(oldest.alias("fp_id"))
    m = items.join(by_key, "key", "left").join(by_fp, "fp", "left")
    return m.select("id", F.coalesce("key_id", "fp_id").alias("existing_id"), F.coalesce("key_id", "fp_id").isNotNull().alias("duplicate"))


def collection_links(spark: SparkSession, d: str) -> DataFrame:
    """Items to projects by the external keys of collections."""
    c = _items(spark, d).select("id", F.explode("r.project_external_keys").alias("external_id"))
    p = table(spark, d, "projects").filter("external_id <> ''").groupBy("external_id").agg(F.min("id").alias("project_id"))
    return join_small(c, p, "external_id").groupBy("id").agg(F.count("*").alias("collections"), F.count("project_id").alias("known"))


def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    """Stored records filled from the item pasted for them."""
    names = ("type", "title", "authors", "year", "publisher", "journal", "volume", "issue", "pages", "doi", "isbn", "url", "notes")
    s = table(spark, d, "sources").select("id", F.struct(*names).alias("p")).join(_items(spark, d).select("id", "r"), "id", "left")
    m = s.select("id", K.merge_candidates(F.col("p"), F.col("r"), F.lit("")).alias("m"))
    return m.select("id", "m.type", "m.title", F.array_join("m.authors", "; ").alias("authors"), "m.year", "m.publisher", "m.doi")


def low_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    return s.select("id", K.low_confidence(F.struct("title", "year", "doi", "isbn"), F.col("raw_input")).alias("low"))


def grounded_records(spark: SparkSession, d: str) -> DataFrame:
    """Records against their own body as the page."""
    s = table(spark, d, "sources").select("id", K.grounded(F.struct("title", "authors", "year", "doi", "isbn"), F.col("body_text")).alias("g"))
    return s.select("id", F.col("g").isNotNull().alias("kept"), F.coalesce("g.doi", F.lit("")).alias("doi"), F.coalesce("g.isbn", F.lit("")).alias("isbn"))


def consistency(spark: SparkSession, d: str) -> DataFrame:
    """Stored titles and authors against those of the pasted item."""
    s = table(spark, d, "sources").select("id", "title", "authors").join(_items(spark, d).select("id", F.col("r.title").alias("t2"), F.col("r.authors").alias("a2")), "id")
    agree = K.authors_consistent("authors", "a2")
    return s.select("id", agree.alias("authors_match"), K.titles_consistent("title", "t2", agree).alias("titles_match"))


def trace_summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", K.trace_summary(text.classify_input("raw_input"), F.col("lookup_trace")).alias("summary"))


def trace_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The provider that answered, in the order in which they are believed."""
    order = F.array(F.lit("crossref"), F.lit("openalex"), F.lit("semantic_scholar"))
    steps = F.transform(F.filter(F.coalesce("lookup_trace", F.array()), lambda t: t["status"] == "success"), lambda t: t["step"])
    return table(spark, d, "sources").select("id", F.coalesce(F.try_element_at(F.filter(order, lambda p: F.array_contains(steps, p)), F.lit(1)), F.lit("")).alias("provider"))


def free_text_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").filter(text.classify_input("raw_input") == "text").select("id", text.free_text_query("raw_input").alias("query"))


def dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    return D.exact_links(table(spark, d, "sources"))


def dedupe_similar(spark: SparkSession, d: str) -> DataFrame:
    return D.similar_links(table(spark, d, "sources"))


def dedupe_scored(spark: SparkSession, d: str) -> DataFrame:
    return D.scored_links(table(spark, d, "sources")).select("left_id", "right_id", "likely", "score", "title_similarity", F.array_join("reasons", "; ").alias("reasons"))


def dedupe_components(spark: SparkSession, d: str) -> DataFrame:
    """Groups by equal identifiers, numbers and keys."""
    s = table(spark, d, "sources")
    return D.duplicate_groups(s, D.exact_links(s))


def dedupe_keep(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    return D.keep_choice(cut(D.duplicate_groups(s, D.exact_links(s))), s)


def dedupe_scan_components(spark: SparkSession, d: str) -> DataFrame:
    """Groups by all five rules, similar titles among them."""
    return D.duplicate_groups(table(spark, d, "sources"))


def dedupe_scan_keep(spark: SparkSession, d: str) -> DataFrame:
    return D.scan(table(spark, d, "sources"))[1]


def dedupe_merge(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    groups = cut(D.duplicate_groups(s))
    m = D.merge_groups(groups, s, D.keep_choice(groups, s))
    return m.select("group_id", "id", "title", "year", "doi", F.size("authors").alias("authors"), F.length("notes").alias("notes_len"), "zotero_item_key")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Sources numbered by id stand for the vectors' records where ids meet."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("doc_source"))


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to the first one, with their documents."""
    e = table(spark, d, "embeddings")
    best = V.top_k(e.filter("vec_id = 0"), e, 10)
    return best.join(_documents(spark, d), "vec_id", "left").select("vec_id", F.round("score", 6).alias("score"), "rank", "doc_source")


def similar_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id 20 divides against all: the five nearest, itself among them."""
    e = table(spark, d, "embeddings")
    return V.top_k(e.filter(F.col("vec_id") % QUERY_STEP == 0), e, 5).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def claim_links_top3(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    best = V.top_k(e.filter(F.col("vec_id") % QUERY_STEP == 0), e, 3)
    return best.select(F.col("query_id").alias("claim_id"), F.col("vec_id").alias("source_id"), "rank", F.round("score", 6).alias("confidence"))


def claim_lines(spark: SparkSession, d: str) -> DataFrame:
    """Non-empty lines of drafts, the claims that are linked."""
    t = table(spark, d, "documents").filter("source = 'claim_drafts'").select("doc_id", F.posexplode(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r]"), text.trim), lambda x: x != "")).alias("pos", "claim"))
    return t.groupBy("doc_id").agg(F.count("*").alias("claims"), F.max(F.length("claim")).cast("bigint").alias("longest"))


QUERIES = {f.__name__: f for f in (input_classify, bibtex_records, ris_records, item_records, import_match, collection_links, candidate_merge, low_confidence, grounded_records, consistency, trace_summaries, trace_cascade, free_text_queries, dedupe_exact, dedupe_similar, dedupe_scored, dedupe_components, dedupe_keep, dedupe_scan_components, dedupe_scan_keep, dedupe_merge, semantic_topk, similar_sources, claim_links_top3, claim_lines)}
_RAW = Q.trim("raw_input")
_KIND = f"(CASE WHEN regexp_matches({_RAW}, '@\\w+\\s*\\{{') AND contains(lower({_RAW}), 'title') THEN 'bibtex' WHEN regexp_matches({_RAW}, '(^|\\n)\\s*TY\\s*-') THEN 'ris' WHEN regexp_matches({_RAW}, '(?i)10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+') THEN 'doi' WHEN regexp_matches({Q.isbn(_RAW)}, '^(97[89])?\\d{{9}}[\\dXx]$') THEN 'isbn' WHEN regexp_matches({_RAW}, '^(?i:[a-z][a-z0-9+.-]*)://\\S+$') THEN 'url' ELSE 'text' END)"


def _fp(doi: str, isbn: str, title: str, author: str, year: str) -> str:
    return f"translate(concat_ws('|', {Q.trim(doi)}, {Q.trim(isbn)}, {Q.trim(title)}, {Q.trim(author)}, {Q.trim(year)}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_EXACT = f"""k AS (SELECT id, created_at, 'doi' AS rule, {Q.trim('lower(doi)')} AS v FROM sources UNION ALL SELECT id, created_at, 'isbn', {Q.isbn('isbn')} FROM sources UNION ALL SELECT id, created_at, 'key', {Q.trim('zotero_item_key')} FROM sources),
    x AS (SELECT rule, v, arg_max(id, (created_at, id)) AS left_id FROM k WHERE v <> '' GROUP BY 1, 2 HAVING count(*) > 1), links AS (SELECT left_id, id AS right_id, k.rule FROM k JOIN x ON k.rule = x.rule AND k.v = x.v WHERE id <> left_id)"""
_GROUPS = f"{_EXACT}, e AS (SELECT left_id AS a, right_id AS b FROM links UNION SELECT right_id, left_id FROM links), reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), g AS (SELECT a AS id, min(b) AS group_id FROM reach GROUP BY 1)"
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _top(k: int) -> str:
    return f"SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 12) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE {{}}) WHERE rank <= {k}"


_ITEMS = """i AS (SELECT id, raw_input::JSON AS j FROM sources WHERE json_valid(raw_input) AND CASE WHEN json_valid(raw_input) THEN json_type(raw_input) = 'OBJECT' AND json_type(raw_input, '$.key') = 'VARCHAR' AND json_type(raw_input, '$.data') = 'OBJECT' ELSE FALSE END)"""


def _listed(path: str) -> str:
    return f"(CASE WHEN json_type(j, '{path}') = 'ARRAY' THEN from_json(j -> '{path}', '[\"JSON\"]') ELSE []::JSON[] END)"


_NAME = f"CASE WHEN coalesce(c ->> '$.name', '') NOT IN ('', '0') THEN c ->> '$.name' ELSE {Q.trim("coalesce(c ->> '$.lastName', '') || ', ' || coalesce(c ->> '$.firstName', '')")} END"
_ITEM_AUTHORS = f"list_filter(list_transform(list_filter({_listed('$.data.creators')}, lambda c: json_type(c) = 'OBJECT'), lambda c: {Q.trim(_NAME)}), lambda x: x <> '')"
_ITEM_TYPE = "CASE " + " ".join(f"WHEN lower(j ->> '$.data.itemType') = '{k}' THEN '{v}'" for k, v in library.ITEM_TYPES.items()) + " ELSE 'other' END"


def _tag(*tags: str) -> str:
    return Q.first_said(*[f"{Q.trim(f"regexp_extract(list_filter(ls, lambda l: regexp_matches(l, '^\\s*{t}\\s*-'))[1], '^\\s*{t}\\s*-\\s*(.*)$', 1)")}" for t in tags])


def _tags(tag: str) -> str:
    return f"list_transform(list_filter(ls, lambda l: regexp_matches(l, '^\\s*{tag}\\s*-')), lambda l: {Q.trim(f"regexp_extract(l, '^\\s*{tag}\\s*-\\s*(.*)$', 1)")})"


def _words(x: str, least: int) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({Q.trim(x)}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'), lambda w: strlen(w) >= {least}))"


_WIDE = r"[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WIDE}+', ' ', 'g'))"


def _frames(x: str) -> str:
    """One round of the request frames, with classes as wide as the library's."""
    for p in text.REQUEST_FRAMES:
        wide = p.replace("(?iU)", "(?i)").replace(r"\s", _WIDE).replace("'", "''")
        x = f"regexp_replace({x}, '{wide}', '', 'g')"
    return _squeeze(x)


SQL = {
    "item_records": f"WITH {_ITEMS} SELECT id, {_ITEM_TYPE} AS type, coalesce(j ->> '$.data.title', '') AS title, array_to_string({_ITEM_AUTHORS}, '; ') AS authors, regexp_extract(coalesce(j ->> '$.data.date', ''), '\\b(19|20)\\d{{2}}\\b') AS year, coalesce(j ->> '$.data.DOI', '') AS doi, {Q.trim("'Imported from Zotero. ' || coalesce(j ->> '$.data.extra', '')")} AS notes, j ->> '$.key' AS zotero_item_key, array_to_string(list_transform({_listed('$.data.collections')}, lambda c: c ->> '$'), ',') AS collections FROM i",
    "collection_links": f"WITH {_ITEMS}, c AS (SELECT id, unnest(list_transform({_listed('$.data.collections')}, lambda c: c ->> '$')) AS x FROM i), p AS (SELECT DISTINCT external_id FROM projects WHERE external_id <> '') SELECT id, count(*) AS collections, count(external_id) AS known FROM c LEFT JOIN p ON external_id = x GROUP BY 1",
    "ris_records": f"""WITH r AS (SELECT id, regexp_split_to_array(raw_input, '\\r\\n|[\\n\\x0B\\f\\r]') AS ls FROM sources WHERE regexp_matches(raw_input, '(^|\\n)\\s*TY\\s*-'))
        SELECT id, CASE lower({_tag('TY')}) WHEN 'book' THEN 'book' WHEN 'jour' THEN 'article' WHEN 'jfull' THEN 'article' WHEN 'video' THEN 'video' ELSE 'other' END AS type, {_tag('TI', 'T1')} AS title, array_to_string(list_filter(list_concat({_tags('AU')}, {_tags('A1')}), lambda x: x NOT IN ('', '0')), '; ') AS authors, regexp_extract({_tag('PY', 'Y1')}, '\\b(19|20)\\d{{2}}\\b') AS year FROM r""",
    "consistency": f"""WITH {_ITEMS}, s AS (SELECT s.id, title, coalesce(authors, []) AS a1, coalesce(j ->> '$.data.title', '') AS t2, {_ITEM_AUTHORS} AS a2 FROM i JOIN (SELECT id, title, authors FROM sources) s ON s.id = i.id),
        w AS (SELECT *, list_filter(flatten(list_transform(a1, lambda n: regexp_split_to_array(lower({Q.trim('n')}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'))), lambda p: strlen(p) > 2) AS ps, lower(array_to_string(a2, ' ')) AS blob, lower({Q.trim('title')}) AS x, lower({Q.trim('t2')}) AS y, {_words('title', 4)} AS wx, {_words('t2', 4)} AS wy FROM s),
        m AS (SELECT *, len(a1) = 0 OR len(a2) = 0 OR len(ps) = 0 OR len(list_filter(ps, lambda p: contains(blob, p))) > 0 AS am, len(list_intersect(wx, wy)) AS n FROM w) SELECT id, am AS authors_match, x = '' OR y = '' OR contains(x, y) OR contains(y, x) OR n >= 2 OR (n = 1 AND (len(wx) = 1 OR len(wy) = 1 OR am)) AS titles_match FROM m""",
    "input_classify": f"SELECT id, {_KIND} AS kind FROM sources",
    "import_match": f"""WITH i AS (SELECT id, raw_input::JSON AS j FROM sources WHERE json_valid(raw_input) AND CASE WHEN json_valid(raw_input) THEN json_type(raw_input) = 'OBJECT' AND json_type(raw_input, '$.key') = 'VARCHAR' AND json_type(raw_input, '$.data') = 'OBJECT' ELSE FALSE END),
        a AS (SELECT id, j, CASE WHEN json_type(j, '$.data.creators') = 'ARRAY' THEN j -> '$.data.creators[0]' END AS c FROM i),
        n AS (SELECT id, j ->> '$.key' AS key, {_fp("j ->> '$.data.DOI'", Q.isbn("j ->> '$.data.ISBN'"), "j ->> '$.data.title'", "CASE WHEN coalesce(c ->> '$.name', '') <> '' THEN c ->> '$.name' WHEN c IS NULL THEN '' ELSE coalesce(c ->> '$.lastName', '') || ', ' || coalesce(c ->> '$.firstName', '') END", "regexp_extract(coalesce(j ->> '$.data.date', ''), '\\b(19|20)\\d{2}\\b')")} AS fp FROM a),
        s AS (SELECT id, created_at, {Q.trim('zotero_item_key')} AS key, {_fp('doi', 'isbn', 'title', 'authors[1]', 'year')} AS fp FROM sources),
        m AS (SELECT n.id, coalesce((SELECT arg_min(s.id, (s.created_at, s.id)) FROM s WHERE s.key <> '' AND s.key = n.key), (SELECT arg_min(s.id, (s.created_at, s.id)) FROM s WHERE s.fp = n.fp)) AS existing_id FROM n) SELECT id, existing_id, existing_id IS NOT NULL AS duplicate FROM m""",
    "trace_summaries": f"WITH t AS (SELECT id, {_KIND} AS k, list_filter(coalesce(lookup_trace, []), lambda t: t.status = 'success') AS ok, len(coalesce(lookup_trace, [])) AS n FROM sources) SELECT id, CASE WHEN len(ok) > 0 AND coalesce(ok[len(ok)].step, '') <> '' THEN upper(k) || ' resolved via ' || ok[len(ok)].step || '.' WHEN n > 0 THEN upper(k) || ' parsed with partial/low-confidence metadata.' ELSE upper(k) || ' parsed.' END AS summary FROM t",
    "trace_cascade": "WITH t AS (SELECT id, list_transform(list_filter(coalesce(lookup_trace, []), lambda t: t.status = 'success'), lambda t: t.step) AS ok FROM sources) SELECT id, CASE WHEN list_contains(ok, 'crossref') THEN 'crossref' WHEN list_contains(ok, 'openalex') THEN 'openalex' WHEN list_contains(ok, 'semantic_scholar') THEN 'semantic_scholar' ELSE '' END AS provider FROM t",
    "low_confidence": f"""WITH w AS (SELECT id, {Q.trim('isbn')} = '' AND {Q.trim('doi')} = '' AND NOT ({Q.trim('title')} <> '' AND {Q.trim('year')} <> '') AS bare, coalesce(raw_input, '') AS raw, list_filter(regexp_split_to_array(lower({_RAW}), '[^0-9A-Za-z_]+'), lambda w: strlen(w) > 3) AS ws, lower({Q.trim('title')}) AS t FROM sources)
        SELECT id, bare OR (raw <> '' AND NOT regexp_matches(raw, '\\b(?:10\\.\\d{{4,9}}/|97[89]\\d{{10}})\\b') AND len(ws) > 0 AND len(list_filter(ws, lambda w: contains(t, w))) = 0) AS low FROM w""",
    "dedupe_exact": f"WITH {_EXACT} SELECT * FROM links",
    "dedupe_components": f"WITH RECURSIVE {_GROUPS} SELECT * FROM g",
    "dedupe_keep": f"WITH RECURSIVE {_GROUPS} SELECT group_id, count(*) AS size, arg_max(s.id, ({B.SURVIVAL}, s.created_at, s.id)) AS keep_id, round(max({B.SURVIVAL}), 2) AS keep_score FROM g JOIN sources s ON s.id = g.id GROUP BY 1",
    "semantic_topk": "SELECT t.vec_id, score, rank, source AS doc_source FROM (" + _top(10).format("q.vec_id = 0") + ") t LEFT JOIN documents d ON d.doc_id = t.vec_id",
    "similar_sources": _top(5).format("q.vec_id % 20 = 0"),
    "claim_links_top3": "SELECT query_id AS claim_id, vec_id AS source_id, rank, score AS confidence FROM (" + _top(3).format("q.vec_id % 20 = 0") + ")",
    "claim_lines": f"WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r]'), lambda x: {Q.trim('x')}), lambda x: x <> '') AS ls FROM documents WHERE source = 'claim_drafts') SELECT doc_id, len(ls) AS claims, list_max(list_transform(ls, lambda x: length(x))) AS longest FROM l WHERE len(ls) > 0",
    "grounded_records": f"""WITH s AS (SELECT id, doi, isbn, lower(coalesce(body_text, '')) AS t, {Q.trim('doi')} AS d, {Q.isbn('isbn')} AS n, {Q.trim('title')} AS title, coalesce(authors, []) AS a FROM sources),
        w AS (SELECT *, regexp_replace(t, '[^0-9Xx]', '', 'g') AS digits, list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'), lambda w: length(w) > 4) AS ws, list_transform(a, lambda x: regexp_split_to_array(lower({Q.trim("split_part(x, ',', 1)")}), '\\s+')[-1]) AS names FROM s),
        h AS (SELECT *, d <> '' AND contains(t, lower(d)) AS hd, length(n) >= 10 AND contains(digits, n) AS hi, title <> '' AND (len(ws) = 0 OR len(list_filter(ws, lambda w: contains(t, w))) > 0) AS ht, len(list_filter(names, lambda x: length(x) >= 3 AND contains(t, x))) > 0 AS ha, strlen({Q.trim('t')}) < 200 AS short FROM w)
        SELECT id, short OR hd OR hi OR ht OR ha AS kept, CASE WHEN short OR hd THEN coalesce(doi, '') ELSE '' END AS doi, CASE WHEN short OR hi THEN coalesce(isbn, '') ELSE '' END AS isbn FROM h""",
    "candidate_merge": f"""WITH {_ITEMS}, r AS (SELECT id, {_ITEM_TYPE} AS type, coalesce(j ->> '$.data.title', '') AS title, {_ITEM_AUTHORS} AS authors, regexp_extract(coalesce(j ->> '$.data.date', ''), '\\b(19|20)\\d{{2}}\\b') AS year, {Q.first_said("j ->> '$.data.publisher'", "j ->> '$.data.libraryCatalog'")} AS publisher, coalesce(j ->> '$.data.DOI', '') AS doi FROM i)
        SELECT s.id, CASE WHEN coalesce(s.type, '') IN ('', '0') THEN coalesce(r.type, 'website') ELSE s.type END AS type, {Q.first_said('s.title', 'r.title')} AS title, array_to_string(CASE WHEN len(coalesce(s.authors, [])) > 0 THEN s.authors ELSE coalesce(r.authors, []) END, '; ') AS authors, {Q.first_said('s.year', 'r.year')} AS year, {Q.first_said('s.publisher', 'r.publisher')} AS publisher, {Q.first_said('s.doi', 'r.doi')} AS doi
        FROM (SELECT id, type, title, authors, year, publisher, doi FROM sources) s LEFT JOIN r ON r.id = s.id""",
    "free_text_queries": f"""WITH RECURSIVE s AS (SELECT id, 0 AS n, {_squeeze('coalesce(raw_input, $$$$)')} AS q FROM (SELECT id, raw_input FROM sources WHERE {_KIND} = 'text') UNION ALL SELECT id, n + 1, {_frames('q')} FROM s WHERE {_frames('q')} <> q)
        SELECT id, arg_max(q, n) AS query FROM s GROUP BY 1""",
}
