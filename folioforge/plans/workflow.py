"""Sessions, tickets, months, notes, runs and stored changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.functions.markup import plain_text_udf
from folioforge.operators import activity as A
from folioforge.operators import notes as N
from folioforge.operators import reader as R
from folioforge.operators import store
from folioforge.operators.dedupe import first_by
from folioforge.plans import sql as Q
from folioforge.runtime import table

NOW = "2025-12-30 15:00:00"


def _now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def session_history(spark: SparkSession, d: str) -> DataFrame:
    """The newest sessions with their record's title; the page holds at most 200."""
    p = table(spark, d, "pomodoro_sessions").distinct()
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "title")
    return p.join(s, "source_id", "left").select("id", "task_label", "type", "started_at", F.coalesce("title", F.lit("")).alias("source_title")).orderBy(F.desc("started_at"), F.desc("id")).limit(max(1, min(200, 50)))


def session_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.day_stats(table(spark, d, "pomodoro_sessions"), _now())


def session_days(spark: SparkSession, d: str) -> DataFrame:
    work = A.session_type() == "work"
    p = table(spark, d, "pomodoro_sessions").distinct()
    return p.groupBy(F.to_date("started_at").alias("day")).agg(F.count(F.when(F.col("completed") & work, 1)).alias("completed_count"), F.round(F.coalesce(F.sum(F.when(F.col("completed") & work, F.col("duration_sec"))), F.lit(0)) / 60).cast("int").alias("focused_minutes"))


def session_normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pomodoro_sessions").select("id", A.session_type().alias("type"), A.session_seconds().alias("seconds"), A.session_notes().alias("notes"), text.clock("duration_sec").alias("clock"))


def session_cycle_replay(spark: SparkSession, d: str) -> DataFrame:
    return A.cycle_replay(table(spark, d, "pomodoro_sessions").distinct())


def session_finish(spark: SparkSession, d: str) -> DataFrame:
    """All open sessions are abandoned now; ended ones stay."""
    p = table(spark, d, "pomodoro_sessions").distinct()
    f = p.select("id", F.lit(True).alias("abandoned"), F.lit(None).cast("string").alias("notes"))
    return store.finish_sessions(p, f, _now()).select("id", "completed", "abandoned", "notes", "ended_at")


def tickets_nested(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tickets, their lines as items in order."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("sort_order"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("int").alias("q"))
    n = A.nest(o, i, "id", ["sort_order", "part", "supp"], ["q"])
    return n.select("id", "status", F.size("items").cast("bigint").alias("n"), F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["sort_order"].cast("string"), x["part"].cast("string"), x["q"].cast("string"))), ",").alias("items"))


def ticket_dates(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the shape of a date, and whether an end lies before a start."""
    s = table(spark, d, "sources").select("id", text.ticket_date("accessed_at").alias("start_date"), text.ticket_date(F.concat("year", F.lit("-01-01"))).alias("end_date"))
    return s.select("id", "start_date", "end_date", (F.col("end_date") < F.col("start_date")).alias("reversed"))


def month_grid(spark: SparkSession, d: str) -> DataFrame:
    """Months of each project's window with the number of its sources created in them, and years as header spans."""
    links = table(spark, d, "source_project").distinct().join(table(spark, d, "sources").select(F.col("id").alias("source_id"), F.date_format("created_at", "yyyy-MM").alias("month")), "source_id")
    filled = links.groupBy("project_id", "month").agg(F.count("*").alias("n"))
    p = table(spark, d, "projects").select(F.col("id").alias("project_id"), F.explode(A.month_spine(F.lit("2021-01"), A.window_months(F.lit("100")))).alias("month"))
    return p.join(filled, ["project_id", "month"], "left").select("project_id", "month", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.substring("month", 1, 4).alias("year"))


def month_header(spark: SparkSession, d: str) -> DataFrame:
    spine = table(spark, d, "projects").agg(F.date_format(F.min("created_at"), "yyyy-MM").alias("start")).select(F.explode(A.month_spine(F.col("start"), F.lit(30))).alias("month"))
    return spine.groupBy(F.substring("month", 1, 4).alias("year")).agg(F.count("*").alias("months"))


def note_overlaps(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "source_notes").select("id", "source_id", "note_scope", "start_offset", "end_offset").distinct()
    return N.overlaps(n, n).distinct()


def note_realign(spark: SparkSession, d: str) -> DataFrame:
    """How many notes stand where they say, were moved, lost their quote or were passed over."""
    n = table(spark, d, "source_notes").distinct()
    return N.realigned(n, table(spark, d, "sources")).groupBy("status").agg(F.count("*").alias("notes"))


def note_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each note against its source and all other notes stored."""
    n = first_by(table(spark, d, "source_notes"), ["id"], F.desc("updated_at"), F.desc("created_at"), "source_id", "start_offset")
    return N.insertable(n, table(spark, d, "sources"), n).groupBy("reason").agg(F.count("*").alias("notes"))


def highlight_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Bodies cut at the bounds of their notes: pieces, and letters highlighted."""
    n = table(spark, d, "source_notes").filter((F.col("note_scope") == "body") & (F.col("end_offset") > F.col("start_offset"))).select("source_id", "start_offset", "end_offset").distinct()
    spans = n.groupBy("source_id").agg(F.collect_list(F.struct("start_offset", "end_offset")).alias("spans")).withColumnRenamed("source_id", "id")
    s = table(spark, d, "sources").select("id", "body_text").join(spans, "id").filter(F.length("body_text") > 0)
    p = s.select("id", F.explode(N.pieces(F.col("body_text"), F.col("spans"))).alias("p"))
    return p.groupBy("id").agg(F.count("*").alias("pieces"), F.sum(F.when(F.col("p.highlighted"), F.length("p.text")).otherwise(0)).alias("highlighted"))


def markdown_plain(spark: SparkSession, d: str) -> DataFrame:
    t = plain_text_udf("body_text")
    return table(spark, d, "sources").select("id", "body_text").withColumn("plain", t).select("id", F.length("plain").alias("n"), F.md5("plain").alias("plain_md5"))


def run_history(spark: SparkSession, d: str) -> DataFrame:
    return R.history(table(spark, d, "assistant_runs"), 20)


def run_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "assistant_runs").distinct().groupBy("run_type").agg(F.count("*").alias("runs"), F.count("source_id").alias("with_source"), F.count(F.when(F.try_parse_json("output_json").isNull(), 1)).alias("broken"))


def synthesis_references(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").filter(F.col("reader_synthesis").isNotNull())
    ids = R.synthesis_sources()
    return s.select("id", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("refs"))


def synthesis_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Syntheses grounded on their own record, if it lies in a project."""
    links = table(spark, d, "source_project").distinct()
    near = links.select(F.col("source_id").alias("id"), F.col("source_id").alias("other"))
    valid = near.groupBy("id").agg(F.collect_set("other").alias("valid_ids"))
    s = table(spark, d, "sources").filter("reader_synthesis is not null").join(valid, "id", "left").withColumn("valid_ids", F.coalesce("valid_ids", F.array().cast("array<bigint>")))
    g = R.ground(s, "valid_ids", "reader_synthesis")
    return g.select("id", "verdict", "verdict_reason", F.size("claims").cast("bigint").alias("claims"), F.size("evidence").cast("bigint").alias("evidence"), F.size("cautions").cast("bigint").alias("cautions"))


def readiness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", R.readiness_caution(_now()).alias("caution")).filter("caution is not null")


def reader_queries(spark: SparkSession, d: str) -> DataFrame:
    """Search queries of each project's newest records under the project's name as context."""
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "title", "created_at")
    top = first_by(table(spark, d, "source_project").distinct().join(s, "source_id"), ["project_id"], F.desc("created_at"), F.desc("source_id"))
    p = table(spark, d, "projects").select(F.col("id").alias("project_id"), "name").join(top, "project_id")
    return p.select("project_id", F.array_join(R.queries(F.col("name"), F.array("title")), " | ").alias("queries"))


def first_wins_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates once by key, the first that arrived."""
    s = table(spark, d, "sources").withColumn("key", R.candidate_key(R.candidate_url(F.col("url"), F.col("doi")), F.col("title"), F.col("year"))).filter("key <> ''")
    return s.groupBy("key").agg(F.min("id").alias("id"))


def settings_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Projects as keys and values: names of later projects overwrite those of equal external keys."""
    p = table(spark, d, "projects").select(F.col("external_id").alias("key"), F.col("name").alias("value"), "id").filter("key <> ''")
    old = p.select("key", F.upper("value").alias("value")).distinct()
    merged = store.upsert(first_by(old, ["key"], "value"), p, "key", "id")
    return store.fill_defaults(merged, spark.createDataFrame([("theme", "auto"), ("citation_format", "apa")], "key string, value string"))


def link_replace(spark: SparkSession, d: str) -> DataFrame:
    """Each source that is linked twice and more keeps its smallest project; a list with repeats and invalid ids is given."""
    links = table(spark, d, "source_project").distinct()
    wanted = links.groupBy("source_id").agg(F.min("project_id").alias("p"), F.count("*").alias("n")).filter("n > 1").select("source_id", F.array("p", "p", F.lit(0).cast("bigint"), F.lit(-4).cast("bigint")).alias("ids"))
    return store.replace_links(links, wanted)


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Records without a body go, with their links and notes; sessions lose their reference."""
    s, links, notes, p = (table(spark, d, t) for t in ("sources", "source_project", "source_notes", "pomodoro_sessions"))
    out = store.delete_cascade(s.filter(text.blank("body_text")), s, {"links": links, "notes": notes}, {"sessions": p})
    counted = [df.agg(F.lit(k).alias("table_name"), F.count("*").alias("n"), F.count("id" if k == "parent" else "source_id").alias("refs")) for k, df in out.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


def save_merge(spark: SparkSession, d: str) -> DataFrame:
    """Titles trimmed by a payload that leaves other fields NULL."""
    s = table(spark, d, "sources").select("id", "title", "year", "notes")
    payload = s.filter("year <> ''").select("id", text.trim("title").alias("title"), F.lit(None).cast("string").alias("year"))
    return store.save_records(s, payload, {"notes": F.lit("")})


def project_names(spark: SparkSession, d: str) -> DataFrame:
    """Wanted names with the id of the project of that name, in any case."""
    wanted = table(spark, d, "projects").select(F.upper("name").alias("name")).distinct()
    return store.by_name(table(spark, d, "projects"), wanted)


def label_union(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a source's theme list and notes, once without regard to case, the first spelling kept."""
    a = table(spark, d, "sources").select("id", F.explode("theme_labels").alias("label"), F.lit(0).alias("ord"))
    b = table(spark, d, "source_notes").select(F.col("source_id").alias("id"), F.explode("tag_labels").alias("label"), F.lit(1).alias("ord"))
    both = a.unionByName(b).select("id", text.trim("label").alias("label"), "ord").filter("label <> ''")
    return both.groupBy("id", F.lower("label").alias("key")).agg(F.min(F.struct("ord", "label"))["label"].alias("label"))


QUERIES = {f.__name__: f for f in (session_history, session_stats, session_days, session_normalized, session_cycle_replay, session_finish, tickets_nested, ticket_dates, month_grid, month_header, note_overlaps, note_realign, note_checks, highlight_pieces, markdown_plain, run_history, run_counts, synthesis_references, synthesis_grounding, readiness, reader_queries, first_wins_candidates, settings_upsert, link_replace, cascade_delete, save_merge, project_names, label_union)}
_KIND = f"(CASE WHEN lower({Q.trim('type')}) IN ('work', 'short_break', 'long_break') THEN lower({Q.trim('type')}) ELSE 'work' END)"
_SYNTH = "(SELECT s.id, reader_synthesis AS r, CASE WHEN l.source_id IS NULL THEN []::BIGINT[] ELSE [s.id] END AS v FROM sources s LEFT JOIN (SELECT DISTINCT source_id FROM source_project) l ON l.source_id = s.id WHERE reader_synthesis IS NOT NULL)"
SQL = {
    "highlight_pieces": """WITH n AS (SELECT DISTINCT source_id AS id, start_offset AS a, end_offset AS b FROM source_notes WHERE note_scope = 'body' AND end_offset > start_offset), t AS (SELECT id, length(body_text) AS len FROM sources WHERE length(body_text) > 0), c AS (SELECT n.id, least(greatest(a, 0), len) AS a, least(greatest(b, 0), len) AS b, n.a AS ra, n.b AS rb, len FROM n JOIN t ON t.id = n.id),
        e AS (SELECT id, a AS e FROM c UNION SELECT id, b FROM c UNION SELECT id, 0 FROM c UNION SELECT id, len FROM c), p AS (SELECT id, e AS s, lead(e) OVER (PARTITION BY id ORDER BY e) AS t FROM e), q AS (SELECT * FROM p WHERE t IS NOT NULL)
        SELECT id, count(*) AS pieces, coalesce(sum(CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.id = q.id AND ra <= s AND rb >= t) THEN t - s ELSE 0 END), 0)::BIGINT AS highlighted FROM q GROUP BY 1""",
    "session_history": "SELECT p.id, task_label, type, started_at, coalesce(title, '') AS source_title FROM (SELECT DISTINCT id, task_label, type, started_at, source_id FROM (SELECT DISTINCT * FROM pomodoro_sessions)) p LEFT JOIN (SELECT id, title FROM sources) s ON s.id = p.source_id ORDER BY started_at DESC, p.id DESC LIMIT 50",
    "session_stats": f"SELECT count(*) FILTER (WHERE completed AND type = 'work') AS completed_count, round(coalesce(sum(duration_sec) FILTER (WHERE completed AND type = 'work'), 0) / 60.0)::INTEGER AS focused_minutes, count(*) FILTER (WHERE abandoned AND type = 'work') AS abandoned_count FROM pomodoro_sessions WHERE started_at >= date_trunc('day', TIMESTAMP '{NOW}')",
    "session_days": f"SELECT started_at::DATE AS day, count(*) FILTER (WHERE completed AND {_KIND} = 'work') AS completed_count, round(coalesce(sum(duration_sec) FILTER (WHERE completed AND {_KIND} = 'work'), 0) / 60.0)::INTEGER AS focused_minutes FROM (SELECT DISTINCT * FROM pomodoro_sessions) GROUP BY 1",
    "session_normalized": f"SELECT id, {_KIND} AS type, least(greatest(duration_sec, 30), 14400) AS seconds, rtrim(replace(replace(coalesce(notes, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), {Q.WS}) AS notes, printf('%02d:%02d', greatest(duration_sec, 0) // 60, greatest(duration_sec, 0) % 60) AS clock FROM pomodoro_sessions",
    "session_cycle_replay": f"""WITH p AS (SELECT DISTINCT id, started_at, (completed AND {_KIND} = 'work')::INTEGER AS w, completed AND {_KIND} = 'long_break' AS reset FROM (SELECT DISTINCT * FROM pomodoro_sessions)),
        r AS (SELECT *, sum(w) OVER o AS done FROM p WINDOW o AS (ORDER BY started_at, id ROWS UNBOUNDED PRECEDING)), b AS (SELECT *, coalesce(max(CASE WHEN reset THEN done END) OVER (ORDER BY started_at, id ROWS UNBOUNDED PRECEDING), 0) AS base FROM r)
        SELECT id, (done - base)::INTEGER AS cycle_index, CASE WHEN w = 1 THEN CASE WHEN done - base >= 4 THEN 'long_break' ELSE 'short_break' END ELSE 'idle' END AS next_phase FROM b""",
    "session_finish": f"SELECT id, CASE WHEN ended_at IS NULL THEN FALSE ELSE completed END AS completed, CASE WHEN ended_at IS NULL THEN TRUE ELSE abandoned END AS abandoned, notes, coalesce(ended_at, TIMESTAMP '{NOW}') AS ended_at FROM (SELECT DISTINCT * FROM pomodoro_sessions)",
    "tickets_nested": "SELECT o_orderkey AS id, o_orderstatus AS status, count(l_orderkey) AS n, coalesce(string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR || ':' || trunc(l_quantity)::INTEGER::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, trunc(l_quantity)), '') AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "ticket_dates": f"WITH t AS (SELECT id, CASE WHEN regexp_matches({Q.trim('accessed_at')}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {Q.trim('accessed_at')} END AS start_date, CASE WHEN regexp_matches({Q.trim("year || '-01-01'")}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {Q.trim("year || '-01-01'")} END AS end_date FROM sources) SELECT *, end_date < start_date AS reversed FROM t",
    "month_grid": "WITH m AS (SELECT strftime(DATE '2021-01-01' + to_months(i::INTEGER), '%Y-%m') AS month FROM range(60) t(i)), f AS (SELECT project_id, strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM (SELECT DISTINCT source_id, project_id FROM source_project) l JOIN sources s ON s.id = l.source_id GROUP BY 1, 2) SELECT p.id AS project_id, m.month, coalesce(n, 0) AS n, substr(m.month, 1, 4) AS year FROM projects p CROSS JOIN m LEFT JOIN f ON f.project_id = p.id AND f.month = m.month",
    "month_header": "WITH b AS (SELECT date_trunc('month', min(created_at))::DATE AS b FROM projects), m AS (SELECT strftime(b + to_months(i::INTEGER), '%Y') AS year FROM b, range(30) t(i)) SELECT year, count(*) AS months FROM m GROUP BY 1",
    "note_overlaps": "WITH n AS (SELECT DISTINCT id, source_id, note_scope, start_offset, end_offset FROM source_notes WHERE end_offset > start_offset) SELECT DISTINCT a.id AS a_id, b.id AS b_id, a.source_id, a.note_scope FROM n a JOIN n b ON a.source_id = b.source_id AND a.note_scope = b.note_scope AND a.id < b.id AND a.start_offset < b.end_offset AND a.end_offset > b.start_offset",
    "note_checks": f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, created_at DESC, source_id, start_offset) AS rn FROM source_notes), r AS (
        SELECT CASE WHEN s.id IS NULL THEN 'source not found' WHEN note_scope NOT IN ('body', 'reading_guide') THEN 'invalid scope' WHEN end_offset <= start_offset THEN 'invalid range' WHEN note_scope = 'body' AND end_offset > length(coalesce(body_text, '')) THEN 'range exceeds text' WHEN {Q.trim('quote_text')} = '' OR {Q.trim('note_text')} = '' THEN 'texts required' WHEN EXISTS (SELECT 1 FROM n x WHERE x.rn = 1 AND x.id <> n.id AND x.source_id = n.source_id AND x.note_scope = n.note_scope AND x.end_offset > x.start_offset AND x.start_offset < n.end_offset AND x.end_offset > n.start_offset) THEN 'overlaps' ELSE '' END AS reason FROM n LEFT JOIN (SELECT id, body_text FROM sources) s ON s.id = n.source_id WHERE rn = 1)
        SELECT reason, count(*) AS notes FROM r GROUP BY 1""",
    "run_history": f"""WITH r AS (SELECT DISTINCT id, created_at, output_json AS j FROM assistant_runs WHERE run_type = 'reader_synthesis') SELECT id, created_at, CASE WHEN json_valid(j) THEN coalesce(j ->> '$.synthesis.verdict', 'skim') ELSE 'skim' END AS verdict,
        CASE WHEN json_valid(j) THEN substr({Q.trim("coalesce(j ->> '$.synthesis.why_now', j ->> '$.synthesis.verdict_reason')")}, 1, 180) ELSE '' END AS preview FROM r ORDER BY created_at DESC, id DESC LIMIT 20""",
    "run_counts": "SELECT run_type, count(*) AS runs, count(source_id) AS with_source, count(*) FILTER (WHERE NOT coalesce(json_valid(output_json), FALSE)) AS broken FROM (SELECT DISTINCT * FROM assistant_runs) GROUP BY 1",
    "synthesis_references": """WITH r AS (SELECT id, reader_synthesis AS r FROM sources WHERE reader_synthesis IS NOT NULL), a AS (SELECT id, list_concat(list_concat(flatten(list_transform(coalesce(r.claims, []), lambda c: coalesce(c.source_ids, []))), list_transform(coalesce(r.evidence, []), lambda e: e.source_id)), flatten(list_transform(coalesce(r.connections, []), lambda c: coalesce(c.source_ids, [])))) AS x FROM r),
        u AS (SELECT id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a), j AS (SELECT id, string_agg(v::VARCHAR, ',' ORDER BY i) AS refs FROM (SELECT id, v, min(i) AS i FROM u WHERE v > 0 GROUP BY 1, 2) GROUP BY 1) SELECT a.id, coalesce(refs, '') AS refs FROM a LEFT JOIN j USING (id)""",
    "synthesis_grounding": f"""WITH a AS (SELECT id, r, v, len(list_filter(coalesce(r.external_candidates, []), lambda c: coalesce(c.url, '') <> '')) > 0 AS outside FROM {_SYNTH}), b AS (SELECT *, list_transform(coalesce(r.claims, []), lambda c: struct_pack(had := len(coalesce(c.source_ids, [])) > 0, kept := len(list_filter(coalesce(c.source_ids, []), lambda i: list_contains(v, i))))) AS cs, list_filter(coalesce(r.evidence, []), lambda e: list_contains(v, e.source_id)) AS es FROM a),
        c AS (SELECT *, len(list_filter(cs, lambda c: c.kept = 0 AND (c.had OR NOT outside))) AS bc, len(coalesce(r.evidence, [])) - len(es) AS be, CASE WHEN r.verdict IN ('read', 'skim', 'ignore') THEN r.verdict ELSE 'skim' END AS vd FROM b)
        SELECT id, CASE WHEN bc + be > 0 AND vd = 'read' THEN 'skim' ELSE vd END AS verdict, CASE WHEN bc + be > 0 AND vd = 'read' THEN '{R.DOWNGRADED}' ELSE {Q.trim(f"coalesce(r.verdict_reason, '{R.EMPTY_REASON}')")} END AS verdict_reason, len(list_filter(cs, lambda c: c.kept > 0 OR outside)) AS claims, len(es) AS evidence, len(coalesce(r.cautions, [])) + (bc > 0)::BIGINT + (be > 0)::BIGINT AS cautions FROM c""",
    "readiness": f"""WITH l AS (SELECT id, body_text, body_fetched_at, CASE WHEN {Q.trim('title')} <> '' THEN {Q.trim('title')} ELSE 'source #' || id END AS label FROM sources), c AS (SELECT id, CASE WHEN {Q.trim("substr(body_text, 1, 4000)")} = '' THEN 'No body text cached for ' || label || '; synthesis may rely mostly on metadata.' WHEN body_fetched_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN 'Cached body text is stale for ' || label || '; consider refreshing source text.' END AS caution FROM l) SELECT * FROM c WHERE caution IS NOT NULL""",
    "reader_queries": f"""WITH t AS (SELECT project_id, source_id, title, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, source_id DESC) AS rn FROM (SELECT DISTINCT source_id, project_id FROM source_project) l JOIN sources s ON s.id = l.source_id), q AS (SELECT project_id, {Q.trim('name')} AS c, {Q.trim('title')} AS t FROM t JOIN projects p ON p.id = t.project_id WHERE rn = 1)
        SELECT project_id, concat_ws(' | ', nullif(c, ''), CASE WHEN t <> '' AND lower(t) <> lower(c) THEN t END, CASE WHEN t <> '' AND c <> '' THEN c || ' ' || t END) AS queries FROM q""",
    "first_wins_candidates": f"WITH u AS (SELECT id, title, year, CASE WHEN {Q.trim('url')} <> '' THEN {Q.trim('url')} WHEN {Q.trim('doi')} <> '' THEN 'https://doi.org/' || {Q.trim('doi')} ELSE '' END AS u FROM sources), k AS (SELECT id, CASE WHEN u <> '' THEN 'url:' || lower(u) WHEN {Q.trim('title')} <> '' THEN 'title:' || lower({Q.trim('title')}) || '|' || {Q.trim('year')} ELSE '' END AS key FROM u) SELECT key, min(id) AS id FROM k WHERE key <> '' GROUP BY 1",
    "settings_upsert": "SELECT external_id AS key, arg_max(name, id) AS value FROM projects WHERE external_id <> '' GROUP BY 1 UNION ALL VALUES ('theme', 'auto'), ('citation_format', 'apa')",
    "link_replace": "WITH l AS (SELECT DISTINCT source_id, project_id FROM source_project) SELECT source_id, min(project_id) AS project_id FROM l GROUP BY 1",
    "cascade_delete": f"WITH g AS (SELECT id FROM sources WHERE {Q.trim('body_text')} = '') SELECT 'parent' AS table_name, count(*) AS n, count(id) AS refs FROM sources WHERE id NOT IN (FROM g) UNION ALL SELECT 'links', count(*), count(source_id) FROM source_project WHERE source_id NOT IN (FROM g) UNION ALL SELECT 'notes', count(*), count(source_id) FROM source_notes WHERE source_id NOT IN (FROM g) UNION ALL SELECT 'sessions', count(*), count(CASE WHEN source_id NOT IN (FROM g) THEN source_id END) FROM pomodoro_sessions",
    "save_merge": f"SELECT id, CASE WHEN year <> '' THEN {Q.trim('title')} ELSE title END AS title, year, coalesce(notes, '') AS notes FROM sources",
    "project_names": "SELECT DISTINCT upper(name) AS name, (SELECT min(id) FROM projects q WHERE lower(q.name) = lower(p.name)) AS id FROM projects p",
    "label_union": f"WITH b AS (SELECT id, unnest(theme_labels) AS label, 0 AS ord FROM sources UNION ALL SELECT source_id, unnest(tag_labels), 1 FROM source_notes), t AS (SELECT id, {Q.trim('label')} AS label, ord FROM b) SELECT id, lower(label) AS key, arg_min(label, (ord, label)) AS label FROM t WHERE label <> '' GROUP BY 1, 2",
}
