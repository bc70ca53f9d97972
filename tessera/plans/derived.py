"""The relations that queries of citations, footnotes, windows, answers, runs and ingest read, derived from the given tables.

Each is one SELECT that Spark and DuckDB both read the same way; names in braces are tables
or stand for what the two spell differently: ``{list}`` makes an array, ``{none}`` is an
empty one of strings. Whole tables and whole texts go in, so the relations grow with them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.citations import CASE_NAMES

TABLES = ("part", "events", "documents", "pages", "benchmark", "conversations", "nation", "lineitem")
_FLAT = "replace(text, chr(10), ' ')"
_QUOTED = "replace(replace(replace(text, chr(10), ' '), chr(34), ' '), chr(9), ' ')"
#: Every fourth turn is a source's chunk; a conversation has three sources.
_SOURCE, _PLACE = "CAST(conv_id * 3 + turn % 3 AS STRING)", "CAST(floor(turn / 3.0) AS INT)"
_CONV = "CAST(conv_id AS STRING)"

DERIVED: dict[str, str] = {
    "urls": "SELECT CAST(page_id AS INT) AS id, CASE page_id % 4 WHEN 0 THEN '/policy-manual/volume-' || CAST(page_id % 12 + 1 AS STRING) || '-part-' || substr('abcdefgh', CAST(page_id % 8 + 1 AS INT), 1) || '-chapter-' || CAST(page_id AS STRING) WHEN 1 THEN url WHEN 2 THEN 'https://www.uscis.gov/policy-manual/volume-7-part-B-chapter-' || CAST(page_id AS STRING) END AS url FROM {pages}",
    "cases": f"""SELECT CAST(doc_id AS INT) AS id, CASE WHEN doc_id % 13 = 0 THEN '{next(iter(CASE_NAMES))}' ELSE source END AS source_id, CASE doc_id % 3 WHEN 0 THEN 'uscis' WHEN 1 THEN 'caselaw' END AS source_type,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '' ELSE text END AS title, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS STRING) || ' F.3d ' || CAST(n_chars AS STRING) WHEN doc_id % 5 = 0 THEN '' END AS citation,
  CASE doc_id % 5 WHEN 0 THEN 'ca6' WHEN 1 THEN 'cadc' WHEN 3 THEN '' WHEN 4 THEN lang END AS court_id, CASE WHEN doc_id % 4 > 0 THEN CAST(1980 + doc_id % 40 AS STRING) || '-01-02' END AS date,
  CASE WHEN doc_id % 6 = 0 THEN '/policy-manual/volume-12-part-d-chapter-' || CAST(doc_id AS STRING) ELSE source END AS url, CASE doc_id % 4 WHEN 0 THEN {{list}}(CAST(doc_id AS INT)) WHEN 1 THEN {{list}}(3, CAST(doc_id AS INT)) WHEN 2 THEN {{list}}(1, 2, 3) END AS footnote_numbers FROM {{documents}}""",
    "titles": "SELECT CAST(p_partkey AS INT) AS id, CASE p_partkey % 5 WHEN 0 THEN 'Volume ' || CAST(p_size AS STRING) || ' - ' || p_name WHEN 1 THEN 'Part ' || upper(substr(p_name, 1, 1)) || ' - ' || p_type WHEN 2 THEN p_name WHEN 3 THEN 'See Volume ' || CAST(p_size AS STRING) END AS title FROM {part}",
    "names": "SELECT CAST(p_partkey AS INT) AS id, '_' || p_name || '  -  ' || p_brand || ': É' || p_type || '!!__' AS name FROM {part}",
    "spacing": "SELECT CAST(doc_id AS INT) AS id, '​ ' || replace(replace(text, ' ', ' \t '), 'e', 'e­') || '  ' AS line FROM {documents}",
    "dirty": "SELECT CAST(doc_id AS INT) AS id, ' ( ' || replace(replace(text, ',', ' , [ '), '.', ' ] . ') || chr(9) AS raw FROM {documents}",
    "dollars": "SELECT CAST(doc_id AS INT) AS id, '# $' || CAST(n_chars AS STRING) || chr(10) || replace(text, chr(10), chr(10) || '## ') AS md FROM {documents}",
    "statuses": "SELECT CAST(event_id AS INT) AS id, CAST(400 + event_id % 200 AS INT) AS status FROM {events}",
    "headers": "SELECT CAST(event_id AS INT) AS id, CASE event_id % 5 WHEN 0 THEN CAST(event_id % 100 AS STRING) WHEN 2 THEN 'Wed, 21 Oct 2015 07:28:00 GMT' WHEN 3 THEN '-' || CAST(event_id % 9 AS STRING) WHEN 4 THEN props END AS header FROM {events}",
    "attempts": "SELECT CAST(1 + event_id % 7 AS INT) AS attempt, CAST(5 + user_id % 3 AS INT) AS base, 60 AS maximum FROM {events}",
    "answers": f"""SELECT CAST(conv_id * 1000 + turn AS INT) AS answer_id, CASE turn % 3 WHEN 0 THEN {_FLAT} || ' [S' || CAST(turn AS STRING) || '] and [S2, S11] too [see note].' WHEN 1 THEN '[S1]x ' || {_FLAT} || ' y[S3] [S10][S2]' ELSE {_FLAT} END AS answer,
  CASE conv_id % 2 WHEN 0 THEN {{list}}('S0', 'S1', 'S2') ELSE {{list}}('S2', 'S10') END AS known FROM {{conversations}}""",
    "link_sources": "SELECT 'S' || CAST(n_nationkey AS STRING) AS label, CASE WHEN n_nationkey % 4 > 0 THEN 'https://' || n_name || '/(1)' ELSE '' END AS url, 'The ' || chr(34) || n_name || chr(34) || ' case' AS citation FROM {nation} WHERE n_nationkey < 12",
    "overlaps": "SELECT CAST(conv_id * 1000 + turn AS INT) AS id, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, CASE WHEN turn % 2 = 1 THEN coalesce(substr(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 10), '') ELSE '' END || text AS body FROM {conversations}",
    "note_lines": f"""SELECT {_CONV} AS source_id, CAST(turn AS INT) AS line_no, {_FLAT} || ' [' || CAST(turn + 1 AS STRING) || '] and [' || CAST(turn * 2 + 1 AS STRING) || '].' AS line FROM {{conversations}} WHERE conv_id % 5 > 0 OR turn % 2 = 0
  UNION ALL SELECT DISTINCT {_CONV}, 1000, '## Footnotes' FROM {{conversations}} WHERE conv_id % 7 > 0
  UNION ALL SELECT {_CONV}, CAST(2000 + turn * 2 AS INT), '[^ ' || CAST(CASE WHEN turn % 3 = 2 THEN 1 ELSE turn + 1 END AS STRING) || '] ' || CASE turn % 2 WHEN 0 THEN 'See INA 319(a).' ELSE {_FLAT} END FROM {{conversations}} WHERE conv_id % 7 > 0
  UNION ALL SELECT {_CONV}, CAST(2001 + turn * 2 AS INT), '(A) ' || {_FLAT} FROM {{conversations}} WHERE conv_id % 7 > 0 AND turn % 4 = 1""",
    "headed": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '## ' || source || chr(10) || replace(text, chr(10), chr(10) || '### of ' || lang || chr(10) || '[^ 3] ') WHEN 1 THEN replace(text, chr(10), chr(10) || '#### deep' || chr(10)) || chr(10) || '## end' || chr(10) || '[^2]' WHEN 2 THEN replace(text, '. ', chr(34) || '. ') ELSE text END AS text FROM {documents}",
    "notes": f"""SELECT CAST(conv_id * 1000 + turn AS INT) AS id, CASE turn % 5 WHEN 0 THEN 'See INA 319(a). ' || {_FLAT} WHEN 1 THEN 'See Matter of Lee, 11 I&N Dec. 649 (BIA 1966). ' || substr({_FLAT}, 1, 12) WHEN 2 THEN 'See 8 CFR 316.5(c)(1). Id.' WHEN 3 THEN 'For more information, see Form N-400 and ' || substr({_FLAT}, 1, 9) ELSE {_FLAT} END AS note FROM {{conversations}}""",
    "alert_lines": f"SELECT {_CONV} AS source_id, CAST(turn AS INT) AS line_no, CASE WHEN turn % 3 < 2 THEN '[ALERT] ' ELSE '' END || {_FLAT} AS line FROM {{conversations}}",
    "verdicts": f"""SELECT {_CONV} AS source_id, substr({_FLAT}, 1, CAST(2 + turn % 9 AS INT)) AS opening, min(CASE WHEN turn % 2 = 0 THEN 'drop' ELSE 'keep' END) AS verdict FROM {{conversations}} GROUP BY {_CONV}, substr({_FLAT}, 1, CAST(2 + turn % 9 AS INT))
  UNION ALL SELECT {_CONV}, substr({_FLAT}, 1, 30), min('keep') FROM {{conversations}} WHERE turn % 4 = 0 GROUP BY {_CONV}, substr({_FLAT}, 1, 30)""",
    "paged": "SELECT CAST(doc_id AS STRING) AS source_id, CASE doc_id % 4 WHEN 0 THEN 'No. 22-' || CAST(doc_id AS STRING) || ' Page 1' || chr(10) || replace(text, chr(10), chr(10) || '_____' || chr(10) || ' 12' || chr(12) || 'No. 22-' || CAST(doc_id AS STRING) || ' Page 2' || chr(10)) WHEN 1 THEN ' 1   ' || replace(text, '. ', '.' || chr(10) || ' 2   ') WHEN 2 THEN replace(text, chr(10), chr(12)) ELSE text END AS text FROM {documents}",
    "hits": f"SELECT CAST(conv_id AS INT) AS qid, CAST(turn + 1 AS INT) AS rank, {_SOURCE} AS source_id, {_PLACE} AS chunk_index, CAST(max({_PLACE}) OVER (PARTITION BY conv_id, turn % 3) + 1 AS INT) AS chunk_total FROM {{conversations}}",
    "hit_chunks": f"SELECT {_SOURCE} AS source_id, {_PLACE} AS chunk_index, coalesce(substr(lag(text) OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn), 20), '') || text AS text FROM {{conversations}}",
    "asked": "SELECT DISTINCT CAST(conv_id + CASE WHEN conv_id % 9 = 0 THEN 1000000 ELSE 0 END AS INT) AS qid, 'What about ' || CAST(conv_id AS STRING) || '?' AS question FROM {conversations}",
    "reach": "SELECT CAST(conv_id AS INT) AS qid, CASE WHEN turn % 4 = 3 THEN 'nowhere ' || CAST(turn AS STRING) ELSE substr(text, 3, 12) END AS anchor FROM {conversations} GROUP BY ALL",
    "records": """SELECT 'q' || CAST(event_id AS STRING) AS id, event_id % 10 = 0 AS probe, CASE WHEN event_type <> 'error' THEN props END AS answer, CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limited' ELSE 'server_error' END END AS degraded_category,
  CAST(event_id % 4 AS INT) AS citations, CASE WHEN event_id % 7 = 0 THEN {list}('S9', 'S' || CAST(user_id AS STRING)) ELSE {none} END AS unknown, CASE WHEN event_id % 11 = 0 THEN {list}('see ' || event_type) ELSE {none} END AS malformed, CASE WHEN user_id % 5 = 0 THEN {list}('S2') ELSE {none} END AS off_target_cites,
  CASE WHEN user_id % 2 = 0 THEN {list}('S1', 'S2') ELSE {none} END AS cited, CAST(5 + user_id % 4 AS INT) AS sources, CAST(event_id % 3 AS INT) AS anchors, CAST(event_id % 2 AS INT) AS anchors_in_cited, CAST(event_id % 3 AS INT) AS anchors_in_context, user_id % 6 = 0 AS refused_verbatim, user_id % 13 = 0 AS truncated,
  {list}('e' || CAST(user_id AS STRING), 'd1') AS expected_retrieved, CASE WHEN event_id % 2 = 0 THEN {list}('d1') ELSE {none} END AS expected_cited, floor(value) * 1.0e0 AS seconds, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 97 AS INT) END AS thoughts FROM {events}""",
    "config_left": "SELECT CAST(p_partkey AS STRING) AS field, CASE WHEN p_size % 5 > 0 THEN p_type END AS value FROM {part} WHERE p_partkey % 3 > 0",
    "config_right": "SELECT CAST(p_partkey AS STRING) AS field, CASE WHEN p_size % 4 > 0 THEN p_type END AS value FROM {part} WHERE p_partkey % 4 > 0",
    "run_left": "SELECT 'q' || CAST(event_id AS STRING) AS id, CAST(event_id % 3 AS INT) AS anchors_in_cited, CAST(user_id % 4 AS INT) AS off_target, CAST(event_id % 5 AS INT) AS citations, CAST(user_id AS INT) AS thought_tokens FROM {events} WHERE event_id % 4 > 0",
    "run_right": "SELECT 'q' || CAST(event_id AS STRING) AS id, CAST(event_id % 2 AS INT) AS anchors_in_cited, CAST(user_id % 3 AS INT) AS off_target, CAST(event_id % 6 AS INT) AS citations, CAST(user_id + 1 AS INT) AS thought_tokens FROM {events} WHERE event_id % 5 > 0",
    "selection": "SELECT CAST(p_partkey AS INT) AS id, CASE WHEN p_partkey % 6 > 0 THEN CAST(p_size AS BIGINT) END AS opinion_id, CASE p_partkey % 4 WHEN 0 THEN {list}(p_type) WHEN 1 THEN {none} WHEN 2 THEN {list}(p_type, p_brand) END AS barrier, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_name END AS why FROM {part}",
    "fetched": "SELECT DISTINCT CAST(l_partkey AS INT) AS id FROM {lineitem} WHERE l_partkey % 3 = 0",
    "searches": "SELECT p_brand || ' ' || p_type AS name, CAST(count(*) AS BIGINT) AS expected FROM {part} GROUP BY p_brand || ' ' || p_type",
    "search_counts": "SELECT p_brand || ' ' || p_type AS name, CAST(count(*) AS BIGINT) AS found FROM {part} WHERE p_partkey % 19 > 0 AND p_brand < 'Brand#5' GROUP BY p_brand || ' ' || p_type",
    "tagged": "SELECT CAST(doc_id AS STRING) AS source_id, CASE doc_id % 3 WHEN 0 THEN 'uscis' ELSE 'caselaw' END AS source_type, CASE doc_id % 4 WHEN 0 THEN 'delay,' || lang WHEN 1 THEN lang WHEN 2 THEN 'delayed,' || source END AS barrier, CASE doc_id % 7 WHEN 0 THEN 'bia' WHEN 1 THEN 'olc' WHEN 2 THEN lang END AS court_id, CASE doc_id % 10 WHEN 3 THEN chr(10) || ' ' WHEN 4 THEN NULL ELSE text END AS text FROM {documents}",
    "keys": "SELECT CAST(item_id AS STRING) AS id, {list}('d' || CAST(item_id AS STRING), 'd' || CAST(item_id % 7 AS STRING)) AS expected, CASE WHEN item_id % 3 = 0 THEN {none} ELSE {list}('d' || CAST(item_id % 7 AS STRING), 'e' || CAST(item_id AS STRING)) END AS acceptable FROM {benchmark}",
    "attempt_log": "SELECT CASE WHEN user_id % 17 > 0 THEN 'u' || CAST(user_id AS STRING) END AS url, CAST(event_id AS INT) AS attempt, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 200 WHEN 'click' THEN 429 WHEN 'signup' THEN CAST(400 + event_id % 120 AS INT) ELSE 503 END AS status, CASE event_id % 3 WHEN 0 THEN CAST(event_id % 50 AS STRING) WHEN 1 THEN '-3' END AS retry_after, props AS body, CASE WHEN user_id % 2 = 0 THEN 'timeout' END AS error FROM {events}",
    "scraped": "SELECT 'v' || CAST(page_id AS STRING) AS stem, 'Volume ' || CAST(page_id % 12 AS STRING) AS volume_title, CASE WHEN page_id % 3 > 0 THEN 'Part A' END AS part_title, 'Chapter ' || CAST(page_id AS STRING) AS chapter_title, url AS chapter_url, CASE WHEN page_id % 2 > 0 THEN '2024-05-06' END AS scraped_date FROM {pages}",
    "opinion_files": "SELECT 'opinion_' || CAST(page_id AS STRING) AS stem, CAST(page_id AS INT) AS id, CASE WHEN page_id % 4 > 0 THEN '/opinion/' || CAST(page_id AS STRING) || '/' END AS absolute_url FROM {pages}",
    "selected": "SELECT CAST(doc_id AS INT) AS opinion_id, source || ' v. ' || lang AS case_name, lang AS court_id, CAST(1990 + doc_id % 30 AS STRING) || '-02-03' AS date_filed, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS STRING) || ' F.3d 2' END AS citation, CASE doc_id % 3 WHEN 0 THEN {none} ELSE {list}('delay', lang) END AS barrier FROM {documents} WHERE doc_id % 3 < 2",
    "page_reports": "SELECT CAST(page_id AS INT) AS page_id, CASE page_id % 4 WHEN 0 THEN {list}('video', 'svg') WHEN 1 THEN {list}('svg', 'tag' || CAST(page_id % 6 AS STRING)) WHEN 2 THEN {list}('video', 'video') ELSE {none} END AS unhandled FROM {pages}",
    "grid": "SELECT CAST(conv_id AS STRING) || '.json' AS file, CASE WHEN conv_id % 2 = 0 THEN 8 ELSE 5 END AS k, CASE WHEN conv_id % 3 = 0 THEN 'low' ELSE 'high' END AS thinking, CASE turn % 4 WHEN 3 THEN NULL WHEN 2 THEN '' ELSE text END AS answer, CASE WHEN turn % 5 > 0 THEN CAST(turn AS INT) END AS citations, CASE WHEN turn % 3 = 0 THEN {list}('S9', 'S8') WHEN turn % 3 = 1 THEN {none} END AS unknown, CASE WHEN turn % 2 = 0 THEN {list}(role) END AS malformed FROM {conversations}",
    "question_keys": "SELECT CAST(item_id AS STRING) AS id, CAST(doc_id AS STRING) AS source_id, {list}(substr(d.text, 5, 40), CASE WHEN item_id % 3 = 0 THEN b.text ELSE substr(d.text, CAST(floor(length(d.text) / 2.0) AS INT) - 10, 40) END) AS anchors, {list}(CAST(item_id AS STRING), '-1') AS acceptable FROM {benchmark} b JOIN {documents} d ON d.doc_id = b.item_id OR d.doc_id = b.item_id + 60 WHERE item_id % 5 > 0 AND d.doc_id % 8 > 0 AND length(d.text) > 100 UNION ALL SELECT CAST(item_id AS STRING), 'nowhere', {list}(text), {list}(CAST(item_id AS STRING), '-1') FROM {benchmark} WHERE item_id % 7 = 1",
    "question_rows": "SELECT CAST(item_id AS STRING) AS id FROM {benchmark} UNION ALL SELECT CAST(item_id AS STRING) FROM {benchmark} WHERE item_id % 6 = 0",
    "key_documents": "SELECT CAST(doc_id AS STRING) AS source_id, CASE WHEN doc_id % 9 > 0 THEN text END AS text FROM {documents}",
    "key_chunks": "SELECT CAST(doc_id AS STRING) AS source_id, substr(text, 1, CAST(floor(length(text) / 2.0) AS INT)) AS text FROM {documents} WHERE doc_id % 9 > 0 UNION ALL SELECT CAST(doc_id AS STRING), substr(text, CAST(floor(length(text) / 2.0) AS INT) + 1) FROM {documents} WHERE doc_id % 9 > 0",
    "local_responses": f"""SELECT CAST(conv_id * 1000 + turn AS INT) AS id, CASE turn % 5 WHEN 0 THEN '{{{{"response":" ' || {_QUOTED} || ' [S1]. ","done":true,"eval_count":2}}}}' WHEN 1 THEN '{{{{"response":"","done":true}}}}' WHEN 2 THEN text || '{{{{' WHEN 3 THEN NULL ELSE '{{{{"response":"' || {_QUOTED} || '"}}}}' END AS response FROM {{conversations}}""",
    "responses": f"""SELECT CAST(conv_id * 1000 + turn AS INT) AS id, CASE turn % 6 WHEN 0 THEN '{{{{"candidates":[{{{{"content":{{{{"parts":[{{{{"text":"thinking","thought":true}}}},{{{{"text":"' || {_QUOTED} || ' [S1]."}}}}]}}}},"finishReason":"STOP"}}}}]}}}}' WHEN 1 THEN '{{{{"candidates":[]}}}}' WHEN 2 THEN '{{{{"candidates":[{{{{"content":{{{{"parts":[]}}}},"finishReason":"MAX_TOKENS"}}}}]}}}}' WHEN 3 THEN text || '{{{{' WHEN 4 THEN NULL
  ELSE '{{{{"candidates":[{{{{"content":{{{{"parts":[{{{{"text":"Not covered by the retrieved sources. ' || {_QUOTED} || '"}}}}]}}}},"finishReason":"MAX_TOKENS"}}}}]}}}}' END AS response FROM {{conversations}}""",
}


def duck(name: str) -> str:
    """The relation as a DuckDB subquery."""
    return "(" + DERIVED[name].format(list="list_value", none="CAST([] AS VARCHAR[])", **{t: t for t in TABLES}) + ")"


def over(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The relation over the tables of folder ``d``."""
    key = hashlib.md5(d.encode()).hexdigest()[:12]
    views = {}
    for t in TABLES:
        if "{" + t + "}" in DERIVED[name]:
            views[t] = f"tessera_{t}_{key}"
            spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(views[t])
    return spark.sql(DERIVED[name].format(list="array", none="CAST(array() AS ARRAY<STRING>)", **{t: views.get(t, t) for t in TABLES}))
