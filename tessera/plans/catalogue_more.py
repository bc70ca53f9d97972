"""Queries of folded and scored results with their DuckDB SQL: blocks, prompts, answers, placed footnotes, opinions, retrieval scores, run totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import citations as C
from tessera.functions import text as T
from tessera.operators import answers, chunking, evaluation, footnotes, ingest, markup, pages, scoring, search, windows
from tessera.operators.encoding import encoder
from tessera.plans import answering, flagship
from tessera.plans import catalogue as base
from tessera.plans.catalogue import query, table
from tessera.plans.fixtures import frame, values
from tessera.sources import readers

# ---------------------------------------------------------------- blocks, prompts, answers


def _stripped(previous: str, body: str) -> str:
    """SQL of strip_overlap."""
    n = f"list_max(list_filter(range({T.OVERLAP_MIN + 1}, least(length({body}), {T.OVERLAP_MAX}) + 1), lambda k: contains(right({previous}, {T.OVERLAP_TAIL}), left({body}, k))))"
    return f"CASE WHEN {previous} IS NULL OR {n} IS NULL THEN {body} ELSE ltrim(substr({body}, {n} + 1), ' ' || chr(10) || chr(9)) END"


_BLOCKS = f"""{base.WANT}, dd AS (SELECT qid, coalesce(min(CASE WHEN n = chunk_index THEN rank END), min(rank)) AS rank, source_id, n FROM w GROUP BY qid, source_id, n),
t AS (SELECT dd.*, text, lag(n) OVER p AS pn, lag(text) OVER p AS pt FROM dd JOIN {values("hit_chunks")} c ON c.source_id = dd.source_id AND c.chunk_index = n WINDOW p AS (PARTITION BY qid, rank, dd.source_id ORDER BY n)),
s AS (SELECT *, {_stripped("(CASE WHEN pn = n - 1 THEN pt END)", "text")} AS body FROM t),
b AS (SELECT qid, rank, source_id, coalesce(string_agg(body, chr(10) ORDER BY n) FILTER (body <> ''), '') AS text FROM s GROUP BY ALL),
e AS (SELECT b.*, o.rank AS earlier, {_stripped("o.text", "b.text")} AS cut FROM b LEFT JOIN b o ON o.qid = b.qid AND o.source_id = b.source_id AND o.rank < b.rank),
blocks AS (SELECT qid, CAST(rank AS INTEGER) AS rank, 'S' || rank AS label, source_id, coalesce(arg_max(cut, earlier) FILTER (cut <> text), any_value(text)) AS text FROM e GROUP BY qid, rank, source_id)
"""
_PROMPTS = (
    _BLOCKS
    + f""", q AS (SELECT qid, 'Question ' || qid || '?' AS question FROM {values("hits")} GROUP BY qid),
prompts AS (SELECT qid, 'SOURCES' || chr(10) || chr(10) || string_agg('[S' || rank || '] Source ' || source_id || CASE WHEN source_id = 'a' THEN ' — A > B' ELSE '' END || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'QUESTION' || chr(10) || chr(10) || any_value(question) AS prompt FROM blocks JOIN q USING (qid) GROUP BY qid)
"""
)


def _blocks(spark, d):
    return windows.source_blocks(frame(spark, "hits"), frame(spark, "hit_chunks"))


def _prompts(spark, d):
    blocks = _blocks(spark, d).withColumns({"citation": F.concat(F.lit("Source "), F.col("source_id")), "section": F.when(F.col("source_id") == "a", "A > B")})
    return windows.prompts(blocks, frame(spark, "hits").select("qid", F.concat(F.lit("Question "), F.col("qid").cast("string"), F.lit("?")).alias("question")).distinct())


_FIRST = r"regexp_extract(prompt, '\[S1\][^\n]*\n([^\n.!?]*[.!?]?)', 1)"
query("source_blocks", _BLOCKS + "SELECT * FROM blocks")(_blocks)
query("prompt", _PROMPTS + "SELECT * FROM prompts")(_prompts)
query("prompt_dry_run", _PROMPTS + "SELECT qid, CAST(length(prompt) AS BIGINT) AS chars, CAST(length(prompt) // 4 AS BIGINT) AS token_estimate FROM prompts")(lambda spark, d: evaluation.dry_run(_prompts(spark, d)))
query("extractive_answer", _PROMPTS + f"SELECT qid, trim(CASE WHEN {_FIRST} = '' THEN 'Not covered by the retrieved sources.' ELSE {_FIRST} || ' [S1]' END) AS answer, CAST(NULL AS VARCHAR) AS degraded_category FROM prompts")(
    lambda spark, d: answers.read_response(answers.extractive(_prompts(spark, d))).select("qid", "answer", "degraded_category")
)
_ANCHORS = values("reach")
query(
    "prompt_ceiling",
    _PROMPTS + f", a AS (SELECT v.qid, anchor, coalesce(bool_or(contains(text, anchor)), false) AS there FROM {_ANCHORS} v LEFT JOIN blocks b ON b.qid = v.qid GROUP BY ALL), r AS (SELECT p.qid, CAST(length(prompt) AS BIGINT) AS chars, count(anchor) AS anchors, count(*) FILTER (there) AS reachable FROM prompts p LEFT JOIN a USING (qid) GROUP BY p.qid, prompt)"
    " SELECT count(*) AS questions, CAST(sum(anchors) AS BIGINT) AS anchors, CAST(sum(reachable) AS BIGINT) AS reachable, CAST(sum(chars) AS BIGINT) AS prompt_chars, CAST(sum(chars) // count(*) // 4 AS BIGINT) AS tokens_each FROM r",
)(lambda spark, d: evaluation.ceiling_totals(evaluation.ceiling(_prompts(spark, d), _blocks(spark, d), frame(spark, "reach"))))
query(
    "answer_chain",
    _BLOCKS + rf""", p AS (SELECT qid, arg_min(text, rank) FILTER (label = 'S1') AS first, list(label ORDER BY rank) AS labels FROM blocks GROUP BY qid),
a AS (SELECT q.qid, question, labels, CASE WHEN labels IS NULL THEN NULL WHEN coalesce(regexp_extract(first, '^([^\n.!?]*[.!?]?)', 1), '') = '' THEN 'Not covered by the retrieved sources.' ELSE regexp_extract(first, '^([^\n.!?]*[.!?]?)', 1) || ' [S1]' END AS answer FROM {values("asked")} q LEFT JOIN p USING (qid))
SELECT qid, question, answer, CASE WHEN labels IS NULL THEN 'no_sources' END AS degraded_category, coalesce(labels, []) AS labels, CASE WHEN ends_with(answer, '[S1]') THEN ['S1'] ELSE [] END AS cited, coalesce(list_filter(labels, lambda x: NOT (x = 'S1' AND ends_with(answer, '[S1]'))), []) AS uncited, CAST(coalesce(ends_with(answer, '[S1]'), false) AS BIGINT) AS citations FROM a""",
)(lambda spark, d: answering.generate(frame(spark, "asked"), _about(spark, d)).select("qid", "question", "answer", "degraded_category", "labels", "cited", "uncited", "citations"))


def _about(spark, d):
    none = F.lit(None).cast("string")
    index = frame(spark, "hit_chunks").withColumns({"section": none, "source_type": none, "title": F.concat(F.lit("Source "), F.col("source_id")), "citation": none, "court_id": none, "date": none, "url": none, "footnote_numbers": F.array().cast("array<int>")})
    return answering.sources(frame(spark, "hits"), index)


@query("answer_questions")
def _answer_questions(spark, d):
    """The whole chain over the documents: chunks, vectors, search for the benchmark items, blocks, prompt, answer, citation check."""
    encode, none = encoder(), F.lit(None).cast("string")
    chunks = base.saved_chunks(spark, d)
    index = chunks.select(flagship.place_id(F.col("doc_id"), F.col("chunk_index")).alias("vec_id"), F.col("doc_id").alias("source_id"), "chunk_index", "chunk_total", "text", "section", "footnote_numbers", encode(F.col("text")).alias("embedding"))
    index = index.withColumns({"source_type": none, "title": F.concat(F.lit("Document "), F.col("source_id").cast("string")), "citation": none, "court_id": none, "date": none, "url": none})
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return answering.answer_questions(index, questions, encode)[0].select("qid", "answer", "degraded_category", "labels", "cited", "unknown", "malformed", "citations")


_LINKS = r"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (ORDER BY label) AS i FROM {sources} WHERE coalesce(url, '') <> ''),
l AS (SELECT answer_id, 0 AS i, answer AS t FROM {answers} UNION ALL
  SELECT answer_id, l.i + 1, replace(t, '[' || label || ']', chr(1) || label || chr(2) || '(<' || url || '> "' || replace(citation, '"', '''') || '")') FROM l JOIN s ON s.i = l.i + 1)
SELECT answer_id, regexp_replace(t, chr(1) || '(S\d+)' || chr(2), '[[\1]]', 'g') AS linked FROM l WHERE i = (SELECT count(*) FROM s)"""


@query("link_labels", _LINKS.format(sources=values("link_sources"), answers=values("answers")))
def _links(spark, d):
    sources = frame(spark, "link_sources").agg(F.collect_list(F.struct("label", "url", "citation")).alias("s"))
    return frame(spark, "answers").crossJoin(F.broadcast(sources)).select("answer_id", C.link_labels(F.col("answer"), F.col("s")).alias("linked"))  # one row of sources


# ---------------------------------------------------------------- placed footnotes, opinions

_KEPT = (
    base.SPLIT
    + rf""", words AS (SELECT source_id, position, list_filter(regexp_split_to_array(lower(regexp_replace({base.NOTE_SQL}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+'), lambda w: length(w) > 1 AND NOT list_contains([{base.STOP}], w)) AS w FROM notes),
judged AS (SELECT notes.*, len(w) >= 3 AS keep FROM notes JOIN words USING (source_id, position)),
maps AS (SELECT source_id, list(number) FILTER (is_first) AS known, list(number) FILTER (is_first AND keep) AS kept, map_from_entries(list((number, note)) FILTER (is_first)) AS text FROM judged GROUP BY source_id),
b AS (SELECT source_id, line_no, line, list_transform(regexp_extract_all(line, '\s*\[(\d+)\]', 1), lambda x: CAST(x AS INTEGER)) AS n, coalesce(known, []) AS known, coalesce(kept, []) AS kept, text FROM s LEFT JOIN maps USING (source_id) WHERE part = 'body'),
o AS (SELECT source_id, line_no, n, known, kept, list_concat([list_reduce(list_prepend(line, list_transform(list_distinct(list_filter(n, lambda x: NOT list_contains(kept, x))), lambda x: CAST(x AS VARCHAR))), lambda acc, x: regexp_replace(acc, '\s*\[' || x || '\]', '', 'g'))], list_transform(list_filter(n, lambda x: list_contains(kept, x)), lambda x: '[^ ' || x || '] ' || text[x])) AS lines FROM b),
placed AS (SELECT source_id, flatten(list(lines ORDER BY line_no)) AS lines, flatten(list(n ORDER BY line_no)) AS n, any_value(known) AS known, any_value(kept) AS kept FROM o GROUP BY source_id),
result AS (SELECT source_id, lines, list_sort(list_distinct(list_filter(n, lambda x: NOT list_contains(known, x)))) AS orphans, CAST(len(list_filter(n, lambda x: list_contains(kept, x))) AS BIGINT) AS n_kept, CAST(len(list_filter(n, lambda x: list_contains(known, x) AND NOT list_contains(kept, x))) AS BIGINT) AS n_dropped FROM placed)
"""
)
_CHAPTERS = (
    _KEPT
    + r""", more AS (SELECT source_id, list(number ORDER BY position) AS numbers, list('[^ ' || number || '] ' || note ORDER BY position) FILTER (keep) AS parked FROM judged WHERE NOT is_first GROUP BY source_id),
chapters AS (SELECT r.source_id, array_to_string(list_transform(list_concat(lines, coalesce(parked, [])), lambda x: regexp_replace(regexp_replace(x, '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10)) AS text, orphans AS orphan_markers, coalesce(numbers, []) AS duplicate_definitions,
  n_kept + len(coalesce(parked, [])) AS footnotes_kept, n_dropped + len(coalesce(numbers, [])) - len(coalesce(parked, [])) AS footnotes_dropped FROM result r LEFT JOIN more USING (source_id))
"""
)


@query("place_footnotes", _KEPT + "SELECT * FROM result")
def _placed(spark, d):
    body = base.parts(spark).filter("part = 'body'").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("body"))
    return footnotes.place(body.join(footnotes.note_maps(base.parsed(spark)), "source_id", "left"))


@query("place_all_footnotes", _KEPT.replace("len(w) >= 3 AS keep", "true AS keep") + "SELECT * FROM result")
def _placed_all(spark, d):
    body = base.parts(spark).filter("part = 'body'").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("body"))
    return footnotes.place(body.join(footnotes.note_maps(base.parsed(spark), keep=lambda note: F.lit(True)), "source_id", "left"))


def _chapters(spark, d):
    raw = frame(spark, "note_lines").groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return footnotes.process_chapter(raw, frame(spark, "verdicts"))


query("process_chapter", _CHAPTERS + "SELECT *, CAST([] AS VARCHAR[]) AS unreviewed_alerts FROM chapters")(_chapters)
query("footnote_keep_rate", _CHAPTERS + "SELECT count(*) AS chapters, CAST(sum(footnotes_kept) AS BIGINT) AS kept, CAST(sum(footnotes_dropped) AS BIGINT) AS dropped, round(sum(footnotes_kept) / (sum(footnotes_kept) + sum(footnotes_dropped)), 6) AS share FROM chapters")(lambda spark, d: footnotes.keep_rate(_chapters(spark, d)))
query(
    "strip_furniture",
    rf"""WITH l AS (SELECT source_id, page_no, unnest(string_split(page, chr(10))) AS line, unnest(range(len(string_split(page, chr(10))))) AS line_no FROM (SELECT source_id, unnest(string_split(text, chr(12))) AS page, unnest(range(len(string_split(text, chr(12))))) AS page_no FROM {values("paged")})),
h AS ({base.HEADS}), k AS (SELECT *, {base.KEY.format("line")} AS key, min(line_no) FILTER (regexp_matches(line, '\S')) OVER p AS first, max(line_no) FILTER (regexp_matches(line, '\S')) OVER p AS last FROM l WINDOW p AS (PARTITION BY source_id, page_no))
SELECT source_id, CAST(page_no AS INTEGER) AS page_no, CAST(line_no AS INTEGER) AS line_no, line FROM k WHERE first IS NOT NULL AND NOT regexp_matches(trim(line), '^\s*[_\-–—]{{5,}}\s*$')
  AND NOT ((line_no = first OR line_no = last) AND regexp_matches(line, '^\s*-?\s*\d{{1,3}}\s*-?\s*$'))
  AND NOT (line_no = first AND EXISTS (SELECT 1 FROM h WHERE h.source_id = k.source_id AND position = 'head' AND h.key = k.key)) AND NOT (line_no = last AND EXISTS (SELECT 1 FROM h WHERE h.source_id = k.source_id AND position = 'foot' AND h.key = k.key))""",
)(lambda spark, d: pages.strip_furniture(frame(spark, "paged")))
query("process_opinion", typed=("payloads",))(lambda spark, d: footnotes.process_opinions(frame(spark, "payloads")))

# ---------------------------------------------------------------- chunks, runs

query("chunk_marks", f"SELECT count(*) FILTER (len(footnote_numbers) > 0) AS with_footnotes, count(*) FILTER (section <> '') AS with_section FROM ({base.chunk_sql(values('headed'))})")(
    lambda spark, d: chunking.chunks(frame(spark, "headed")).agg(F.count_if(F.size("footnote_numbers") > 0).alias("with_footnotes"), F.count_if(F.col("section") != "").alias("with_section"))
)


def _grid(spark):
    q = F.struct("answer", "citations", "unknown", "malformed")
    return frame(spark, "grid").groupBy("file", F.struct("k", "thinking").alias("config")).agg(F.collect_list(q).alias("questions"), F.count_if(F.col("answer").isNotNull()).alias("totals"))


_SIZE = "coalesce(len({}), 0)"
query("grid_totals", f"SELECT count(*) FILTER (coalesce(answer, '') <> '') AS answers, CAST(sum(coalesce(citations, 0)) AS BIGINT) AS citations, CAST(sum({_SIZE.format('unknown')}) AS BIGINT) AS fabricated, CAST(sum({_SIZE.format('malformed')}) AS BIGINT) AS malformed FROM {values('grid')}")(lambda spark, d: evaluation.grid_totals(_grid(spark)))
query("shipping_run", f"SELECT file, k, thinking, count(answer) AS totals FROM {values('grid')} WHERE k = 8 AND thinking = 'low' GROUP BY ALL ORDER BY file LIMIT 1")(lambda spark, d: evaluation.shipping_run(_grid(spark), 8, "low").select("file", "config.*", "totals"))
query("question_subset", typed=("payloads",), sql="SELECT unnest(['q9', " + ", ".join(f"'{i}'" for i in evaluation.SUBSETS["controls"]) + "]) AS id")(lambda spark, d: evaluation.wanted_ids(table(spark, d, "benchmark"), ["q9", "controls", "q9"]))
query("point_lookup", "SELECT conv_id, turn, text FROM conversations WHERE (conv_id, turn) IN (SELECT conv_id, max(turn) FROM conversations GROUP BY 1)")(
    lambda spark, d: (lambda c: search.by_ids(c.withColumn("chunk_id", F.concat_ws("_", "conv_id", "turn")), c.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"))).select("conv_id", "turn", "text"))(table(spark, d, "conversations"))
)
query("document_chunks", "SELECT CAST(turn AS INTEGER) AS chunk_index, text FROM conversations WHERE conv_id = 3")(
    lambda spark, d: search.chunk_texts(table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").cast("int").alias("chunk_index"), "text"), "3")
)

# ---------------------------------------------------------------- sources

query(
    "landed_attempts",
    f"""WITH l AS (SELECT url, count(*) AS attempts, arg_max(attempt, attempt) AS last FROM {values("attempt_log")} WHERE url IS NOT NULL GROUP BY url)
SELECT l.url, attempts, CASE WHEN status = 200 THEN body END AS body, CASE WHEN status = 200 THEN NULL WHEN status IS NULL THEN coalesce(error, 'connection_error') WHEN status = 429 THEN 'rate_limited' WHEN status = 403 THEN 'forbidden' WHEN status = 404 THEN 'not_found' WHEN status >= 500 THEN 'server_error' ELSE 'client_error' END AS category,
  CASE WHEN coalesce(status, 0) <> 200 AND retry_after IS NOT NULL THEN greatest(0, TRY_CAST(retry_after AS INTEGER)) END AS wait FROM l JOIN {values("attempt_log")} a ON a.url = l.url AND a.attempt = l.last""",
)(lambda spark, d: ingest.fetched(frame(spark, "attempt_log")))
query("chapter_sidecar", f"SELECT stem AS source_id, 'uscis' AS source_type, concat_ws(' / ', volume_title, part_title, chapter_title) AS title, CAST(NULL AS VARCHAR) AS citation, CAST(NULL AS VARCHAR) AS court_id, CAST(NULL AS VARCHAR) AS date, CAST(NULL AS VARCHAR) AS barrier, chapter_url AS url, scraped_date AS retrieved FROM {values('scraped')}")(
    lambda spark, d: readers.chapter_sidecar(frame(spark, "scraped"))
)
query("opinion_sidecar", f"SELECT stem AS source_id, 'caselaw' AS source_type, case_name AS title, citation, court_id, date_filed AS date, array_to_string(barrier, ',') AS barrier, 'https://c' || absolute_url AS url FROM {values('opinion_files')} p JOIN {values('selected')} s ON p.id = s.opinion_id")(
    lambda spark, d: readers.opinion_sidecar(frame(spark, "opinion_files"), frame(spark, "selected"), "https://c")
)
query("tag_documents", f"SELECT tag, count(DISTINCT page_id) AS documents, list_sort(list(DISTINCT page_id)) AS page_ids FROM (SELECT page_id, unnest(unhandled) AS tag FROM {values('page_reports')}) GROUP BY tag")(lambda spark, d: ingest.by_tag(frame(spark, "page_reports")))
query(
    "recall_curve_k15",
    f"WITH {base._hits_sql(20)} SELECT x.qid, CAST(k AS INTEGER) AS cutoff, CASE WHEN min(h.rank) <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall FROM expected x CROSS JOIN (SELECT unnest([1,3,5,8,10,15]) AS k) LEFT JOIN h ON h.qid = x.qid AND h.label = x.source GROUP BY x.qid, k",
)(lambda spark, d: search.recall_curve(base._hits(spark, d, 20), base._expected(spark, d), scoring.cutoffs_with(15)))

_CHAPTER = (
    '<div id="guidance"><div class="field--name-body"><h2>A  title</h2><p>One <b>bold</b> , two<p>open<ul><li>a<ul><li>b</ul></ul><table><caption>Cap</caption><tr><th>h<td>1</table>'
    '<div class="alert-message"><div><p>Beware</p></div></div><hr><video></video></div></div>'
)


@query("chapter_html", typed=("payloads",))
def _chapter_html(spark, d):
    return markup.extract(spark.createDataFrame([(1, _CHAPTER), (2, "<p>no guidance"), (3, None), (4, "")], "page_id long, html string"), markup.parse_chapter)


@query("contents_table", typed=("payloads",))
def _contents(spark, d):
    part = lambda title, *chapters: f'<div class="level--3"><ul><li class="level__item--3"><a href="/p">{title}</a></li></ul><ul class="level--4">' + "".join(f'<li class="level__item--4"><a href="/{c}">{c}</a></li>' for c in chapters) + "</ul></div>"
    volume = lambda title: f'<div class="level--2"><div class="level__title"><a href="/v">{title}</a></div></div>'
    html = "<div>" + volume("Volume 1 - First") + part("Part A - Zero", "c1", "c2") + part("Part B - One", "c3") + volume("Volume 12 - Last") + part("Part D - Two", "c4") + "</div>"
    return markup.contents_table(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), {"Volume 1": ["Part A"], "Volume 12": None})


# ---------------------------------------------------------------- retrieval scores over conversations

# every conversation is a question; its turns are the ranked pool, dealt to three documents of its own
_POOL = """WITH h AS (SELECT conv_id AS qid, CAST(turn + 1 AS INTEGER) AS rank, conv_id * 3 + turn % 3 AS source_id, CAST(turn // 3 AS INTEGER) AS chunk_index, text, round(1.0::DOUBLE / (turn + 2), 9) AS score FROM conversations),
key AS (SELECT DISTINCT qid, qid * 3 + 1 AS source_id FROM h), acc AS (SELECT DISTINCT qid, qid * 3 + 2 AS source_id FROM h),
anc AS (SELECT qid, 0 AS position, substr(text, 3, 12) AS anchor FROM h WHERE rank = 2 UNION ALL SELECT qid, 1, substr(text, 2, 15) FROM h WHERE rank = 5 UNION ALL SELECT qid, 2, 'nowhere to be found' FROM h WHERE rank = 1)
"""
_FOUND = "a{c} AS (SELECT anc.qid, position, anchor, coalesce(bool_or(contains(n.text, anchor) AND n.rank = t.rank), false) AS in_chunk, coalesce(bool_or(contains(n.text, anchor)), false) AS in_window FROM anc LEFT JOIN {t} t ON t.qid = anc.qid LEFT JOIN h n ON n.qid = t.qid AND n.source_id = t.source_id AND abs(n.chunk_index - t.chunk_index) <= 1 GROUP BY ALL)"


def _pool(spark, d):
    c = table(spark, d, "conversations")
    h = c.select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).cast("int").alias("rank"), (F.col("conv_id") * 3 + F.col("turn") % 3).alias("source_id"), F.floor(F.col("turn") / 3).cast("int").alias("chunk_index"), "text", F.round(1 / (F.col("turn") + 2), 9).alias("score"))
    total = h.groupBy("source_id").agg((F.max("chunk_index") + 1).alias("chunk_total"))
    key = h.select("qid").distinct()
    anchor = lambda at, where, text: h.filter(where).select("qid", F.lit(at).alias("position"), text.alias("anchor"))
    anchors = anchor(0, "rank = 2", F.substring("text", 3, 12)).union(anchor(1, "rank = 5", F.substring("text", 2, 15))).union(anchor(2, "rank = 1", F.lit("nowhere to be found")))
    return h.drop("text").join(total, "source_id"), h.select("source_id", "chunk_index", "text"), key.select("qid", (F.col("qid") * 3 + 1).alias("source_id")), anchors, key.select("qid", (F.col("qid") * 3 + 2).alias("source_id"))


_TOP = "top AS (SELECT * FROM h WHERE rank <= 8), " + _FOUND.format(c="0", t="top")


@query(
    "score_questions",
    _POOL
    + f""", {_TOP}, n AS (SELECT qid, source_id, count(*) AS n, min(rank) AS f FROM top GROUP BY ALL), w AS (SELECT qid, max(n) AS crowding, arg_max(source_id, n * 1000 - f) AS crowded_by FROM n GROUP BY qid),
c AS (SELECT qid, count(*) AS anchors, count(*) FILTER (in_chunk) AS anchors_in_chunk, count(*) FILTER (in_window) AS anchors_in_window, coalesce(list(anchor ORDER BY position) FILTER (NOT in_window), []) AS missing_anchors FROM a0 GROUP BY qid)
SELECT k.qid, """
    + ", ".join(f"(SELECT CASE WHEN min(rank) <= {n} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM h WHERE h.qid = k.qid AND h.source_id = k.source_id) AS recall_{n}" for n in (1, 3, 8))
    + """, (SELECT coalesce(min(rank) <= 8, false) FROM h WHERE h.qid = k.qid AND h.source_id = k.source_id) AS hit, (SELECT min(rank) FROM h WHERE h.qid = k.qid AND h.source_id = k.source_id) AS first_rank, (SELECT round(max(score), 3) FROM h WHERE h.qid = k.qid) AS top_score,
  anchors, anchors_in_chunk, anchors_in_window, missing_anchors, [k.source_id] AS expected, CASE WHEN EXISTS (SELECT 1 FROM top WHERE top.qid = k.qid AND top.source_id = k.source_id) THEN [k.source_id] ELSE [] END AS found,
  (SELECT list(source_id ORDER BY rank) FROM top WHERE top.qid = k.qid AND source_id % 3 = 0) AS off_target, crowding, CAST(crowded_by AS VARCHAR) AS crowded_by, crowded_by % 3 = 0 AS crowded_off_target, (SELECT list(source_id ORDER BY rank) FROM top WHERE top.qid = k.qid) AS ranked
FROM key k JOIN c USING (qid) JOIN w USING (qid)""",
)
def _scored(spark, d):
    got = scoring.score_questions(*_pool(spark, d))
    return got.select("*", *(F.element_at("recall", F.lit(n)).alias(f"recall_{n}") for n in (1, 3, 8))).drop("recall")


def _capped_sql(cap: int) -> str:
    return f"""t{cap} AS (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY qid ORDER BY rank) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_id ORDER BY rank) AS r FROM h) WHERE r <= {cap or 10**6}), u{cap} AS (SELECT * FROM t{cap} WHERE r2 <= 8), {_FOUND.format(c=f"c{cap}", t=f"u{cap}")},
s{cap} AS (SELECT k.qid, {cap} AS cap, CASE WHEN EXISTS (SELECT 1 FROM u{cap} u WHERE u.qid = k.qid AND u.source_id = k.source_id) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall, (SELECT count(*) FROM ac{cap} a WHERE a.qid = k.qid AND in_chunk) AS anchors_in_chunk, (SELECT count(*) FROM ac{cap} a WHERE a.qid = k.qid AND in_window) AS anchors_in_window FROM key k)"""


_CAPPED = _POOL + ", " + ", ".join(map(_capped_sql, (0, *search.CAPS))) + ", cs AS (" + " UNION ALL ".join(f"SELECT * FROM s{c}" for c in (0, *search.CAPS)) + ")"
_ABOUT = "SELECT cap, round(avg(recall), 6) AS recall, CAST(sum(anchors_in_chunk) AS BIGINT) AS anchors_in_chunk, CAST(sum(anchors_in_window) AS BIGINT) AS anchors_in_window FROM cs GROUP BY cap"


def _caps(spark, d):
    hits, chunks, expected, anchors, _ = _pool(spark, d)
    return scoring.capped_scores(hits, chunks, expected, anchors)


query("capped_scores", _CAPPED + " SELECT * FROM cs")(_caps)
query("diversity_table", _CAPPED + f", m AS ({_ABOUT}) SELECT m.*, round((m.recall - z.recall) * 100, 4) AS recall_points, m.anchors_in_window - z.anchors_in_window AS window_change, m.recall > z.recall AND m.anchors_in_window < z.anchors_in_window AS trap FROM m, (SELECT * FROM m WHERE cap = 0) z")(
    lambda spark, d: scoring.diversity_table(_caps(spark, d))
)
query("headline_retrieval", _POOL + f", {_TOP}, r AS (SELECT k.qid, CASE WHEN EXISTS (SELECT 1 FROM top t WHERE t.qid = k.qid AND t.source_id = k.source_id) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM key k) SELECT count(*) AS questions, round(avg(v), 6) AS recall, count(*) FILTER (v > 0) AS hits, count(*) FILTER (v = 1) AS complete, (SELECT count(*) FROM a0) AS anchors, (SELECT count(*) FROM a0 WHERE in_window) AS anchors_in_window FROM r")(
    lambda spark, d: evaluation.headline(scoring.score_questions(*_pool(spark, d)).withColumn("recall", F.transform_keys("recall", lambda k, v: k.cast("string"))), 8)
)
