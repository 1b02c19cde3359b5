"""Changes to stored tables beyond upserts, provider answers in order of belief, and choices among catalogue answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import latex, text
from folioforge.operators import reader, store
from folioforge.plans import sql as Q
from folioforge.runtime import table
from folioforge.sources import providers as P


def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors, and those of documents in their place: blank texts, and texts without a language (which stand for failed embeddings), change nothing."""
    e = table(spark, d, "embeddings")
    have = e.select(F.col("vec_id").alias("id"), F.lit("stored").alias("input_text"), "embedding")
    new = table(spark, d, "documents").join(e, F.col("doc_id") == F.col("vec_id"), "left")
    new = new.select(F.col("doc_id").alias("id"), F.col("text").alias("input_text"), F.when(F.col("lang").isNotNull(), F.coalesce("embedding", F.array(F.lit(1.0).cast("float")))).otherwise(F.array().cast("array<float>")).alias("embedding"), F.lit(1).alias("at"))
    return store.upsert_vectors(have, new, "at").select("id", F.md5("input_text").alias("input_md5"), F.size("embedding").cast("bigint").alias("width"))


def log_append(spark: SparkSession, d: str) -> DataFrame:
    """The run log with a row a note, by kind."""
    log = table(spark, d, "assistant_runs")
    notes = table(spark, d, "source_notes").select("source_id", F.col("quote_text").alias("input_text"), "note_text", "note_scope", "created_at")
    both = store.append_log(log, notes, "claim_link", ["note_scope", "note_text"])
    return both.groupBy("run_type").agg(F.count("*").alias("runs"), F.count("source_id").alias("with_source"), F.count(F.when(F.get_json_object("output_json", "$.note_scope") == "body", 1)).alias("on_bodies"))


def session_start(spark: SparkSession, d: str) -> DataFrame:
    """A session started for each note; a source that does not exist is left out of it."""
    p = table(spark, d, "pomodoro_sessions")
    starts = table(spark, d, "source_notes").select((F.col("id") + 1_000_000_000).alias("id"), F.col("quote_text").alias("task_label"), F.when(F.col("note_scope") == "body", F.col("source_id")).otherwise(-F.col("source_id")).alias("source_id"), F.lit("work").alias("type"), F.lit(1500).alias("duration_sec"), F.col("created_at").alias("started_at")).distinct()
    s = store.start_sessions(p, starts, table(spark, d, "sources"))
    return s.groupBy("type", F.col("ended_at").isNull().alias("open")).agg(F.count("*").alias("sessions"), F.count("source_id").alias("with_source"))


def session_autosave(spark: SparkSession, d: str) -> DataFrame:
    """Drafts reach open sessions only."""
    p = table(spark, d, "pomodoro_sessions").distinct()
    drafts = p.select("id", F.concat(F.lit("draft "), F.coalesce("task_label", F.lit(""))).alias("notes"), F.col("started_at").alias("saved_at")).distinct()
    return store.autosave_notes(p, drafts).select("id", "notes", F.col("ended_at").isNull().alias("open"))


def ticket_touch(spark: SparkSession, d: str) -> DataFrame:
    """Line items returned count as done again, which touches their orders at the latest date."""
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("ticket_id"), (F.col("l_linestatus") == "F").alias("done"), "l_returnflag", F.col("l_shipdate").alias("at"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    patches = lines.filter("l_returnflag = 'R'").select("id", F.lit(False).alias("done"), "at")
    items, tickets = store.toggle_items(lines.select("id", "ticket_id", "done"), orders, patches)
    done = items.groupBy(F.col("ticket_id").alias("id")).agg(F.count(F.when(F.col("done"), 1)).alias("done"))
    return tickets.join(done, "id", "left").select("id", "updated_at", F.coalesce("done", F.lit(0)).alias("done"))


def chosen_isbn(spark: SparkSession, d: str) -> DataFrame:
    """Of all numbers under one trimmed title the first of thirteen digits, else of ten, in order of record."""
    s = table(spark, d, "sources").filter(text.trim("title") != "").groupBy(text.trim("title").alias("title")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("isbn", F.lit("")).alias("isbn")))), lambda x: x["isbn"]).alias("isbns"))
    return s.select("title", text.choose_isbn("isbns").alias("isbn"))


def library_searches(spark: SparkSession, d: str) -> DataFrame:
    """The searches for a title, from the strictest to the loosest."""
    first = F.coalesce(F.get(F.coalesce("authors", F.array().cast("array<string>")), 0), F.lit(""))
    return table(spark, d, "sources").select("id", F.posexplode(P.title_searches(F.col("title"), first)).alias("rank", "query"))


def provider_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Answers in the shape of three providers, made of the records' own fields, read by their mappers and believed in order.

    The first answers where there is an identifier, the second where there is an address, the third always; an answer without a title is none.
    """
    s = table(spark, d, "sources").select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "year", "journal", "publisher", "volume", "issue", "pages", "doi", "url")], F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.coalesce(text.trim(a), F.lit("")) != "").alias("authors"))
    year = F.regexp_extract("year", r"^(\d{4})$", 1)
    number = F.when(year != "", year.try_cast("int"))
    crossref = F.to_json(F.struct(F.struct(F.array("title").alias("title"), F.transform("authors", lambda a: F.struct(F.lit("").alias("given"), a.alias("family"))).alias("author"), F.struct(F.array(F.array(number)).alias("date-parts")).alias("issued"), F.array("journal").alias("container-title"), "volume", "issue", F.col("pages").alias("page"), F.col("doi").alias("DOI")).alias("message")))
    openalex = F.to_json(F.struct("title", F.lit("book-chapter").alias("type"), "doi", year.alias("publication_year"), F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"), F.struct(F.col("url").alias("landing_page_url"), F.struct(F.col("journal").alias("display_name")).alias("source")).alias("primary_location")))
    scholar = F.to_json(F.struct("title", "year", F.col("journal").alias("venue"), F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors")))
    answers = s.select("id", F.when(text.trim("doi") != "", crossref).alias("c"), F.when(text.trim("url") != "", openalex).alias("o"), scholar.alias("p"))
    found = answers.select("id", P.crossref("c").alias("crossref"), P.openalex("o").alias("openalex"), P.semantic_scholar("p").alias("semantic_scholar"))
    best = P.believe(found, "id", [(n, n) for n in ("crossref", "openalex", "semantic_scholar")])
    return best.select("id", F.coalesce("provider", F.lit("")).alias("provider"), F.coalesce("candidate.title", F.lit("")).alias("title"), F.coalesce("candidate.type", F.lit("")).alias("type"), F.coalesce("candidate.journal", F.lit("")).alias("journal"), F.size("trace").cast("bigint").alias("steps"))


def gathered_sources(spark: SparkSession, d: str) -> DataFrame:
    """What a synthesis reads: the record itself and, after it, the records it refers to, each once, the record's own rank first."""
    s = table(spark, d, "sources").filter(F.col("reader_synthesis").isNotNull())
    own = s.select(F.col("id").alias("reader_id"), F.col("id"), F.lit(0).alias("expanded"))
    more = s.select(F.col("id").alias("reader_id"), F.explode(reader.synthesis_sources()).alias("id"), F.lit(1).alias("expanded"))
    both = own.unionByName(more.join(table(spark, d, "sources").select("id").distinct(), "id", "left_semi"))
    return both.groupBy("reader_id", "id").agg(F.min("expanded").alias("expanded"))


def tex_plain(spark: SparkSession, d: str) -> DataFrame:
    """Bodies read as LaTeX."""
    t = table(spark, d, "sources").select("id", latex.tex_to_text_udf(F.coalesce("body_text", F.lit(""))).alias("t"))
    return t.select("id", F.length("t").alias("n"), F.md5("t").alias("text_md5"))


QUERIES = {f.__name__: f for f in (vector_upsert, log_append, session_start, session_autosave, ticket_touch, chosen_isbn, library_searches, provider_cascade, gathered_sources, tex_plain)}
_T = Q.trim
_CLEAN = "regexp_replace(coalesce(x, ''), '[^0-9Xx]', '', 'g')"
SQL = {
    "vector_upsert": f"""WITH n AS (SELECT doc_id AS id, text, coalesce(len(embedding), 1) AS w FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE {_T('text')} <> '' AND lang IS NOT NULL)
        SELECT id, md5(text) AS input_md5, w::BIGINT AS width FROM n UNION ALL SELECT vec_id, md5('stored'), len(embedding)::BIGINT FROM embeddings WHERE vec_id NOT IN (SELECT id FROM n)""",
    "log_append": """SELECT run_type, count(*) AS runs, count(source_id) AS with_source, count(*) FILTER (WHERE run_type = 'claim_link' AND b) AS on_bodies FROM (SELECT run_type, source_id, FALSE AS b FROM assistant_runs UNION ALL SELECT 'claim_link', source_id, note_scope = 'body' FROM source_notes) GROUP BY 1""",
    "session_start": """WITH n AS (SELECT DISTINCT id, quote_text, CASE WHEN note_scope = 'body' THEN source_id ELSE -source_id END AS s, created_at FROM source_notes), a AS (SELECT type, ended_at IS NULL AS open, source_id FROM pomodoro_sessions UNION ALL SELECT 'work', TRUE, CASE WHEN s IN (SELECT id FROM sources) THEN s END FROM n)
        SELECT type, open, count(*) AS sessions, count(source_id) AS with_source FROM a GROUP BY 1, 2""",
    "session_autosave": """SELECT id, CASE WHEN ended_at IS NULL THEN 'draft ' || coalesce(task_label, '') ELSE notes END AS notes, ended_at IS NULL AS open FROM (SELECT DISTINCT * FROM pomodoro_sessions)""",
    "ticket_touch": """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'), l AS (SELECT l.l_orderkey AS id, count(*) FILTER (WHERE l_linestatus = 'F' AND r.l_orderkey IS NULL) AS done, max(l_shipdate) FILTER (WHERE l_returnflag = 'R') AS latest FROM lineitem l LEFT JOIN r ON r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber GROUP BY 1)
        SELECT o_orderkey AS id, coalesce(latest, o_orderdate) AS updated_at, coalesce(done, 0) AS done FROM orders LEFT JOIN l ON l.id = o_orderkey""",
    "chosen_isbn": f"""WITH s AS (SELECT {_T('title')} AS title, list_transform(list(coalesce(isbn, '') ORDER BY id), lambda x: {_CLEAN}) AS xs FROM sources WHERE {_T('title')} <> '' GROUP BY 1)
        SELECT title, coalesce(list_filter(xs, lambda x: length(x) = 13)[1], list_filter(xs, lambda x: length(x) = 10)[1], '') AS isbn FROM s""",
    "library_searches": f"""WITH s AS (SELECT id, {_T('title')} AS t, coalesce(authors[1], '') AS a FROM sources), q AS (SELECT id, CASE WHEN t = '' THEN [] WHEN a <> '' THEN ['"' || t || '" ' || a, '"' || t || '"', t || ' ' || a] ELSE ['"' || t || '"', t] END AS qs FROM s)
        SELECT id, generate_subscripts(qs, 1) - 1 AS rank, unnest(qs) AS query FROM q""",
    "provider_cascade": f"""WITH s AS (SELECT id, coalesce(title, '') AS title, coalesce(journal, '') AS journal, {_T('doi')} <> '' AS c, {_T('url')} <> '' AS o, {_T('title')} <> '' AS t FROM sources)
        SELECT id, CASE WHEN NOT t THEN '' WHEN c THEN 'crossref' WHEN o THEN 'openalex' ELSE 'semantic_scholar' END AS provider, CASE WHEN NOT t THEN '' WHEN c OR o THEN title ELSE {_T('title')} END AS title,
        CASE WHEN NOT t THEN '' WHEN c THEN 'article' WHEN o THEN 'book' ELSE 'article' END AS type, CASE WHEN NOT t THEN '' WHEN c OR o THEN journal ELSE {_T('journal')} END AS journal, CASE WHEN NOT t THEN 3 WHEN c THEN 1 WHEN o THEN 2 ELSE 3 END::BIGINT AS steps FROM s""",
    "gathered_sources": """WITH r AS (SELECT id, reader_synthesis AS r FROM sources WHERE reader_synthesis IS NOT NULL), a AS (SELECT id, unnest(list_concat(list_concat(flatten(list_transform(coalesce(r.claims, []), lambda c: coalesce(c.source_ids, []))), list_transform(coalesce(r.evidence, []), lambda e: e.source_id)), flatten(list_transform(coalesce(r.connections, []), lambda c: coalesce(c.source_ids, []))))) AS v FROM r)
        SELECT reader_id, id, min(expanded) AS expanded FROM (SELECT id AS reader_id, id, 0 AS expanded FROM r UNION ALL SELECT a.id, v, 1 FROM a WHERE v > 0 AND v IN (SELECT id FROM sources)) GROUP BY 1, 2""",
}
