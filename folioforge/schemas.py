"""Schemas shared by sources, operators and tests."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())

#: The record every source of bibliographic data yields.
CANDIDATE = T.StructType([T.StructField(n, _A if n == "authors" else _S) for n in ("type", "title", "authors", "year", "publisher", "journal", "volume", "issue", "pages", "doi", "isbn", "url", "notes")])
CANDIDATE_SQL = CANDIDATE.simpleString()

TRACE = T.ArrayType(T.StructType([T.StructField(n, _S) for n in ("step", "status", "detail")]))

NOTE = "id long, source_id long, note_scope string, quote_text string, start_offset int, end_offset int, note_text string, tag_labels array<string>, project_ids array<long>, created_at timestamp, updated_at timestamp"
TICKET = "id long, title string, description string, start_date date, end_date date, created_at timestamp, updated_at timestamp"
TICKET_ITEM = "id long, ticket_id long, label string, sort_order int, done boolean, created_at timestamp"
SESSION = "id long, task_label string, source_id long, type string, duration_sec int, completed boolean, abandoned boolean, notes string, started_at timestamp, ended_at timestamp"
RUN = "id long, run_type string, source_id long, input_text string, output_json string, created_at timestamp"
SETTING = "key string, value string"
MONTHS = "schemaVersion int, windowStart string, windowMonths int, rows array<struct<id:string,section:string,label:string,tooltip:string>>, filled map<string,array<string>>"
SYNTHESIS = "verdict string, verdict_reason string, why_now string, claims array<struct<text:string,source_ids:array<bigint>,strength:string>>, evidence array<struct<source_id:bigint,method:string,quotes:array<string>>>, connections array<struct<source_ids:array<bigint>,relation:string,note:string>>, open_questions array<string>, cautions array<string>, external_candidates array<struct<title:string,authors:array<string>,year:string,url:string,why_relevant:string,provider:string>>, companion_overview string, companion_deeper_context string, companion_reading_tips string"
REMOTE_ITEM = "key string, version long, data struct<itemType:string,title:string,creators:array<struct<creatorType:string,name:string,firstName:string,lastName:string>>,date:string,publisher:string,libraryCatalog:string,publicationTitle:string,bookTitle:string,volume:string,issue:string,pages:string,DOI:string,ISBN:string,url:string,accessDate:string,extra:string,dateModified:string,collections:array<string>>"
