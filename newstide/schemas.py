"""Schemas of the records that cross the engine's edges."""

from __future__ import annotations

TOPIC = "query_id string, query_num int, title string, type string, query array<string>, start_ts timestamp, end_ts timestamp"
NUGGET = "query_id string, nugget_id string, timestamp long, important int, length int, text string"
MATCH = "query_id string, update_id string, nugget_id string, match_start int, match_end int, auto_p double"
UPDATE = "query_id string, update_id string, document_id string, sentence_id int, length int, duplicate_id string, text string"
SUBMISSION = "qid int, team string, run string, stream_id string, sent_id int, ts long, conf double"
SYSTEM_UPDATE = "query_id string, system_id string, run_id string, document_id string, sentence_id int, decision long, confidence double"
