"""All queries of the library with their DuckDB SQL.

``QUERIES[name](spark, sf_dir)`` gives a DataFrame; ``ORACLE_SQL[name]`` says the
same independently. Queries without SQL are compared with brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import citations as C
from tessera.functions import substance as S
from tessera.functions import text as T
from tessera.operators import answers, chunking, evaluation, footnotes, ingest, markup, pages, search, windows
from tessera.plans import flagship
from tessera.plans.derived import DERIVED
from tessera.plans.fixtures import frame, over_tables, sql_over_tables, used, values

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries on the typed rows of ``fixtures`` with their SQL, for tests only.
CASES: dict[str, Query] = {}
CASE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, typed: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query. One that reads fixtures (by its SQL, or ``typed``) becomes a case on the typed rows, and a query over the tables if all of them can be derived."""

    def add(f: Query) -> Query:
        names = used(sql or "") | set(typed)
        (CASES if names else QUERIES)[name] = f
        if sql is not None:
            (CASE_SQL if names else ORACLE_SQL)[name] = sql
        if names and names <= set(DERIVED):

            def over(spark: SparkSession, d: str) -> DataFrame:
                with over_tables(d):
                    return f(spark, d)

            QUERIES[name] = over
            if sql is not None:
                ORACLE_SQL[name] = sql_over_tables(sql)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def saved_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The documents' chunks, made once and read back from a shared folder."""
    return flagship.chunk_table(spark, table(spark, d, "documents"))


# ---------------------------------------------------------------- documents, lines, chunks

_LINES = r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS line_no, line
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
WHERE regexp_matches(line, '\S')"""
_TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]'))"
_CHUNKS = f"""WITH RECURSIVE l AS (SELECT doc_id, line_no, CAST({_TOKENS.format("line")} AS BIGINT) AS t FROM ({_LINES})),
p AS (
  SELECT doc_id, line_no, t AS held, 0 AS chunk FROM l WHERE line_no = 0
  UNION ALL
  SELECT l.doc_id, l.line_no, CASE WHEN p.held + l.t > 220 THEN l.t ELSE p.held + l.t END, p.chunk + CASE WHEN p.held + l.t > 220 THEN 1 ELSE 0 END
  FROM p JOIN l ON l.doc_id = p.doc_id AND l.line_no = p.line_no + 1
),
c AS (SELECT p.doc_id, CAST(p.chunk AS INTEGER) AS chunk_index, count(*) AS lines, CAST(sum(l.t) AS BIGINT) AS tokens FROM p JOIN l USING (doc_id, line_no) GROUP BY ALL)
"""

query("doc_lines", _LINES)(lambda spark, d: chunking.lines(table(spark, d, "documents")))
query("token_counts", f"SELECT doc_id, CAST({_TOKENS.format('text')} AS BIGINT) AS tokens FROM documents")(lambda spark, d: chunking.token_counts(table(spark, d, "documents")))
query(
    "sentence_split",
    r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?;:])["''”’)\]]*\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS longest FROM s""",
)(lambda spark, d: chunking.sentence_stats(table(spark, d, "documents")))
query("chunk_greedy", _CHUNKS + "SELECT * FROM c")(lambda spark, d: chunking.greedy_chunks(table(spark, d, "documents")).drop("chunk_total"))
query("chunk_meta", _CHUNKS + "SELECT doc_id || '_' || chunk_index AS chunk_id, doc_id, chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS chunk_total, tokens FROM c")(lambda spark, d: chunking.chunk_positions(chunking.greedy_chunks(table(spark, d, "documents"))))
query(
    "chunk_size_stats",
    _CHUNKS + ", s AS (SELECT list_sort(list(tokens)) AS x, count(*) AS n FROM c) SELECT CAST(n AS BIGINT) AS chunks, x[n // 2 + 1] AS median, x[CAST(floor(n * 0.1) AS INTEGER) + 1] AS p10, x[CAST(floor(n * 0.9) AS INTEGER) + 1] AS p90, x[-1] AS largest, CAST(len(list_filter(x, lambda v: v > 256)) AS BIGINT) AS \"over\" FROM s",
)(lambda spark, d: chunking.size_stats(chunking.greedy_chunks(table(spark, d, "documents"))))


def chunk_sql(source: str) -> str:
    """DuckDB SQL for :func:`chunking.chunks` over a relation (doc_id, text)."""
    tok, shape = lambda c: f"CAST({_TOKENS.format(c)} AS BIGINT)", r"'^(#{2,4})\s+(.*)$'"
    return rf"""WITH RECURSIVE l AS (SELECT doc_id, i AS line_no, line, {tok("line")} AS n, regexp_extract(line, {shape}, 1) AS marks, trim(regexp_extract(line, {shape}, 2)) AS title
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM {source}) WHERE regexp_matches(line, '\S')),
p AS (SELECT *, max(line_no) FILTER (len(marks) = 2) OVER w AS p2, max(line_no) FILTER (len(marks) = 3) OVER w AS p3, max(line_no) FILTER (len(marks) = 4) OVER w AS p4 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
h AS (SELECT p.*, concat_ws(' > ', a.title, CASE WHEN p3 > coalesce(p2, -1) THEN b.title END, CASE WHEN p4 > greatest(coalesce(p2, -1), coalesce(p3, -1)) THEN c.title END) AS section FROM p
  LEFT JOIN l a ON a.doc_id = p.doc_id AND a.line_no = p2 LEFT JOIN l b ON b.doc_id = p.doc_id AND b.line_no = p3 LEFT JOIN l c ON c.doc_id = p.doc_id AND c.line_no = p4),
s AS (SELECT doc_id, line_no, unnest(x) AS piece, unnest(range(len(x))) AS k FROM (SELECT doc_id, line_no, list_filter(list_transform(string_split(regexp_replace(line, '([.!?;:])["''”’)\]]*\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS x FROM h WHERE n > {T.TOKEN_CEILING})),
w AS (SELECT doc_id, line_no, k, unnest(x) AS word, unnest(range(len(x))) AS j FROM (SELECT doc_id, line_no, k, string_split_regex(piece, '\s+') AS x FROM s WHERE {tok("piece")} > {T.TOKEN_CEILING})),
wn AS (SELECT *, {tok("word")} AS n FROM w),
r AS (SELECT doc_id, line_no, k, j, n AS held, 0 AS run FROM wn WHERE j = 0 UNION ALL
  SELECT wn.doc_id, wn.line_no, wn.k, wn.j, CASE WHEN held + wn.n > {T.TOKEN_CEILING} THEN wn.n ELSE held + wn.n END, run + CASE WHEN held + wn.n > {T.TOKEN_CEILING} THEN 1 ELSE 0 END FROM r JOIN wn ON wn.doc_id = r.doc_id AND wn.line_no = r.line_no AND wn.k = r.k AND wn.j = r.j + 1),
piece AS (SELECT doc_id, line_no, 0 AS k, 0 AS run, line AS t FROM h WHERE n <= {T.TOKEN_CEILING} UNION ALL SELECT doc_id, line_no, k, 0, piece FROM s WHERE {tok("piece")} <= {T.TOKEN_CEILING}
  UNION ALL SELECT doc_id, line_no, k, run, string_agg(word, ' ' ORDER BY j) FROM r JOIN wn USING (doc_id, line_no, k, j) GROUP BY ALL),
u AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k, run) - 1 AS INTEGER) AS i, t, {tok("t")} AS n, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY k, run) > 1 AS fragment, section, marks <> '' AND row_number() OVER (PARTITION BY doc_id, line_no ORDER BY k, run) = 1 AS opens FROM piece JOIN (SELECT doc_id, line_no, section, marks FROM h) USING (doc_id, line_no)),
a AS (SELECT doc_id, list(n ORDER BY i) AS sizes, list(opens ORDER BY i) AS opens FROM u GROUP BY doc_id),
f AS (SELECT doc_id, 0 AS i, 0 AS begun, sizes[1] AS held, false AS ends FROM a UNION ALL
  SELECT doc_id, i + 1, follows, list_sum(sizes[follows + 1:i + 2]), ends FROM (
    SELECT *, CASE WHEN NOT ends THEN begun WHEN section OR begun = i OR list_sum(sizes[back + 1:i + 1]) > {T.TOKEN_TARGET // 2} OR list_sum(sizes[back + 1:i + 2]) > {T.TOKEN_CEILING} THEN i + 1 ELSE back END AS follows FROM (
      SELECT f.doc_id, f.i, f.begun, a.sizes, a.opens[f.i + 2] AND held >= {T.MIN_FLUSH} AS section, (a.opens[f.i + 2] AND held >= {T.MIN_FLUSH}) OR held + a.sizes[f.i + 2] > {T.TOKEN_TARGET} AS ends,
        CAST(coalesce(list_max(list_filter(range(f.begun + 1, f.i + 1), lambda c: list_sum(a.sizes[c + 1:f.i + 1]) >= {T.TOKEN_OVERLAP})), f.begun + 1) AS INTEGER) AS back FROM f JOIN a ON a.doc_id = f.doc_id AND f.i + 1 < len(a.sizes)))),
c AS (SELECT doc_id, begun, i, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS chunk_total FROM (SELECT *, coalesce(lead(ends) OVER (PARTITION BY doc_id ORDER BY i), true) AS last FROM f) WHERE last),
o AS (SELECT c.doc_id, c.chunk_index, c.chunk_total, string_agg(CASE WHEN u.i = c.begun THEN '' WHEN fragment THEN ' ' ELSE chr(10) END || t, '' ORDER BY u.i) AS text, CAST(sum(n) AS BIGINT) AS tokens, arg_min(section, u.i) AS section FROM c JOIN u ON u.doc_id = c.doc_id AND u.i BETWEEN c.begun AND c.i GROUP BY ALL)
SELECT doc_id, doc_id || '_' || chunk_index AS chunk_id, chunk_index, chunk_total, text, tokens, section, list_transform(regexp_extract_all(text, '\[\^\s*(\d+)\]', 1), lambda x: CAST(x AS INTEGER)) AS footnote_numbers FROM o"""


query("chunk_full", chunk_sql("documents"))(lambda spark, d: chunking.chunks(table(spark, d, "documents")))
query("chunk_sections", chunk_sql(values("headed")))(lambda spark, d: chunking.chunks(frame(spark, "headed")))
query("flagship_retrieve")(flagship.retrieve)
query("flagship_scores")(flagship.scores)


@query("chunks_by_source", _CHUNKS + "SELECT source, CAST(count(*) AS BIGINT) AS chunks, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM c JOIN documents USING (doc_id) GROUP BY source")
def _chunks_by_source(spark, d):
    docs = table(spark, d, "documents")
    n = chunking.greedy_chunks(docs, keep=("source",)).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))
    return n.withColumn("share", F.round(F.col("chunks") / F.sum("chunks").over(Window.partitionBy()), 6))


@query("longest3_share", _CHUNKS + ", n AS (SELECT doc_id, count(*) AS k FROM c GROUP BY 1) SELECT round((SELECT sum(k) FROM (SELECT k FROM n ORDER BY k DESC, doc_id LIMIT 3)) / sum(k), 6) AS share, CAST(sum(k) AS BIGINT) AS chunks FROM n")
def _longest3(spark, d):
    n = chunking.greedy_chunks(table(spark, d, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    top = n.orderBy(F.desc("k"), "doc_id").limit(3).agg(F.sum("k").alias("top"))
    return n.agg(F.sum("k").alias("chunks")).crossJoin(top).select(F.round(F.col("top") / F.col("chunks"), 6).alias("share"), "chunks")  # one row each


@query("corpus_numbers", _CHUNKS + "SELECT CAST(count(*) AS BIGINT) AS chunks, count(DISTINCT doc_id) AS documents, count(DISTINCT CASE WHEN lang = 'en' THEN doc_id END) AS documents_en FROM c JOIN documents USING (doc_id)")
def _corpus(spark, d):
    docs = table(spark, d, "documents")
    return chunking.greedy_chunks(docs, keep=("lang",)).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.countDistinct(F.when(F.col("lang") == "en", F.col("doc_id"))).alias("documents_en"))


@query("metadata_left_join", "SELECT d.doc_id, d.source, l.quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _sidecar(spark, d):
    return ingest.with_sidecar(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


query("metadata_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda spark, d: table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti"))
query("corpus_union", "SELECT 'doc' AS kind, doc_id AS id, length(text) AS chars FROM documents UNION ALL SELECT 'item', item_id, length(text) FROM benchmark")(
    lambda spark, d: table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("chars")).unionByName(table(spark, d, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("chars")))
)

# ---------------------------------------------------------------- vector search


def _index(spark, d):
    return table(spark, d, "embeddings")


def _queries(spark, d):
    return _index(spark, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def _hits_sql(k: int, where: str = "true") -> str:
    return f"""h AS (SELECT * FROM (
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, label, score FROM (
    SELECT q.vec_id AS qid, e.vec_id, e.label, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 9) AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND {where})) WHERE rank <= {k}),
expected AS (SELECT q.vec_id AS qid, q.label AS source FROM embeddings q WHERE q.vec_id % 50 = 0)"""


def _hits(spark, d, k):
    """Hits with the label as their source."""
    return search.search(_index(spark, d), _queries(spark, d), k).join(_index(spark, d).select("vec_id", F.col("label").alias("source")), "vec_id")


def _expected(spark, d):
    return _index(spark, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("source"))


_ROUNDED = "round(score, 6) as score"
query("knn_topk", f"WITH {_hits_sql(8)} SELECT qid, rank, vec_id, round(score, 6) AS score FROM h")(lambda spark, d: search.search(_index(spark, d), _queries(spark, d)).selectExpr("qid", "rank", "vec_id", _ROUNDED))
query("knn_filtered", f"WITH {_hits_sql(8, 'e.label = 3')} SELECT qid, rank, vec_id, round(score, 6) AS score FROM h")(lambda spark, d: search.search(_index(spark, d), _queries(spark, d), where=F.col("label") == 3).selectExpr("qid", "rank", "vec_id", _ROUNDED))
_CAPPED = "c AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS w FROM h) WHERE w <= {cap})"
query("knn_cap", f"WITH {_hits_sql(20)}, {_CAPPED.format(cap=2)} SELECT qid, r2 AS rank, vec_id, label AS source FROM c WHERE r2 <= 8")(lambda spark, d: search.capped(_hits(spark, d, 20), 2, 8).select("qid", "rank", "vec_id", "source"))
query(
    "recall_curve",
    f"WITH {_hits_sql(20)} SELECT x.qid, CAST(k AS INTEGER) AS cutoff, CASE WHEN min(h.rank) <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall FROM expected x CROSS JOIN (SELECT unnest([1,3,5,8,10]) AS k) LEFT JOIN h ON h.qid = x.qid AND h.label = x.source GROUP BY x.qid, k",
)(lambda spark, d: search.recall_curve(_hits(spark, d, 20), _expected(spark, d)))
_OTHERS = "SELECT qid, vec_id, label FROM h WHERE rank > 1"
query("first_rank", f"WITH {_hits_sql(20)} SELECT x.qid, min(CASE WHEN h.rank > 1 THEN h.rank END) AS first_rank FROM expected x LEFT JOIN h ON h.qid = x.qid AND h.label = x.source GROUP BY x.qid")(lambda spark, d: search.first_rank(_hits(spark, d, 20).filter("rank > 1"), _expected(spark, d)))
query("mrr", f"WITH {_hits_sql(20)}, f AS (SELECT x.qid, min(CASE WHEN h.rank > 1 THEN h.rank END) AS r FROM expected x LEFT JOIN h ON h.qid = x.qid AND h.label = x.source GROUP BY x.qid) SELECT count(*) AS questions, count(r) AS hits, round(avg(1.0::DOUBLE / r), 6) AS mrr FROM f")(
    lambda spark, d: search.first_rank(_hits(spark, d, 20).filter("rank > 1"), _expected(spark, d)).agg(F.count(F.lit(1)).alias("questions"), F.count("first_rank").alias("hits"), F.round(F.avg(1 / F.col("first_rank")), 6).alias("mrr"))
)
query(
    "crowding",
    f"WITH {_hits_sql(8)}, n AS (SELECT qid, label, count(*) AS n, min(rank) AS f FROM h GROUP BY 1, 2) SELECT qid, max(n) AS crowding, arg_max(label, n * 1000 - f) AS crowded_by FROM n GROUP BY qid",
)(lambda spark, d: search.crowding(_hits(spark, d, 8)))
query("off_target", f"WITH {_hits_sql(8)} SELECT h.qid, h.rank, h.label AS source FROM h WHERE NOT EXISTS (SELECT 1 FROM expected x WHERE x.qid = h.qid AND x.source = h.label)")(lambda spark, d: search.off_target(_hits(spark, d, 8), _expected(spark, d)))
query(
    "diversity",
    f"WITH {_hits_sql(20)}, "
    + ", ".join(f"c{c} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS w FROM h WHERE rank > 1) WHERE w <= {c or 99}), d{c} AS (SELECT {c} AS cap, round(avg(CASE WHEN r <= 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall FROM (SELECT x.qid, min({'r2' if c else 'rank'}) AS r FROM expected x LEFT JOIN c{c} h ON h.qid = x.qid AND h.label = x.source GROUP BY x.qid))" for c in (0, 1, 2, 3))
    + " SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3",
)(lambda spark, d: search.diversity(_hits(spark, d, 20).filter("rank > 1"), _expected(spark, d)))

# ---------------------------------------------------------------- windows


def _turn_hits(spark, d):
    """Assistant turns as hits, conversations as documents."""
    c = table(spark, d, "conversations")
    total = c.groupBy("conv_id").agg((F.max("turn") + 1).cast("int").alias("chunk_total"))
    own = c.filter("role = 'assistant'").join(total, "conv_id")
    return own.select(F.col("conv_id").alias("qid"), F.col("turn").cast("int").alias("rank"), F.col("conv_id").alias("source_id"), F.col("turn").cast("int").alias("chunk_index"), "chunk_total")


@query("neighbor_window", "SELECT a.conv_id AS qid, CAST(a.turn AS INTEGER) AS rank, a.conv_id AS source_id, CAST(b.turn AS INTEGER) AS neighbor, b.text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.role = 'assistant'")
def _neighbor(spark, d):
    chunks = table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").cast("int").alias("chunk_index"), "text")
    return windows.window(_turn_hits(spark, d), chunks)


WANT = f"WITH h AS {values('hits')}, w AS (SELECT qid, rank, source_id, chunk_index, unnest(range(greatest(0, chunk_index - 1), least(chunk_total - 1, chunk_index + 1) + 1)) AS n FROM h)"
query(
    "window_dedup",
    WANT + " SELECT qid, CAST(coalesce(min(CASE WHEN n = chunk_index THEN rank END), min(rank)) AS INTEGER) AS rank, source_id, CAST(n AS INTEGER) AS neighbor FROM w GROUP BY qid, source_id, n",
)(lambda spark, d: windows.deduped_window(frame(spark, "hits")))
query("printed_window", WANT + " SELECT w.qid, w.rank, w.source_id, CAST(w.n AS INTEGER) AS neighbor, CASE WHEN w.n <> w.chunk_index THEN h.rank END AS is_result FROM w LEFT JOIN h ON h.qid = w.qid AND h.source_id = w.source_id AND h.chunk_index = w.n")(lambda spark, d: windows.printed_window(frame(spark, "hits")))
query(
    "strip_overlap",
    f"""SELECT id, CASE WHEN n IS NULL THEN body ELSE ltrim(substr(body, n + 1), ' ' || chr(10) || chr(9)) END AS body FROM (
SELECT *, list_max(list_filter(range(41, least(length(body), 800) + 1), lambda k: contains(right(previous, 1600), left(body, k)))) AS n FROM {values("overlaps")})""",
)(lambda spark, d: frame(spark, "overlaps").select("id", T.strip_overlap(F.col("previous"), F.col("body")).alias("body")))
# ---------------------------------------------------------------- anchors, answer keys


def _containment(spark, d):
    return evaluation.anchor_containment(table(spark, d, "benchmark").select(F.col("item_id").alias("anchor_id"), F.col("text").alias("anchor")), table(spark, d, "documents"))


query("anchor_containment", "SELECT item_id AS anchor_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''")(_containment)
query("anchor_elsewhere", "SELECT item_id AS anchor_id, doc_id FROM (SELECT item_id, doc_id, min(doc_id) OVER (PARTITION BY item_id) AS own FROM benchmark b JOIN documents d ON contains(d.text, b.text)) WHERE doc_id <> own")(
    lambda spark, d: (lambda found: evaluation.anchor_elsewhere(found, found.groupBy("anchor_id").agg(F.min("doc_id").alias("doc_id"))))(_containment(spark, d))
)


_KEYS = f"""WITH k AS {values("question_keys")}, r AS {values("question_rows")}, d AS (SELECT * FROM {values("key_documents")} WHERE text IS NOT NULL), c AS {values("key_chunks")},
a AS (SELECT id, source_id, unnest(anchors) AS anchor FROM k), acc AS (SELECT DISTINCT id, unnest(acceptable) AS source_id FROM k)
"""


@query(
    "validate_questions",
    _KEYS
    + """SELECT 'duplicate_id' AS problem, id, CAST(count(*) AS VARCHAR) AS detail FROM r GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'no_expected', id, '' FROM r WHERE id NOT IN (SELECT id FROM k)
UNION ALL SELECT DISTINCT 'overlap', id, source_id FROM k JOIN acc USING (id, source_id)
UNION ALL SELECT DISTINCT 'unknown_source', id, source_id FROM (SELECT id, source_id FROM k UNION SELECT id, source_id FROM acc) WHERE source_id NOT IN (SELECT source_id FROM c)
UNION ALL SELECT 'no_document', id, source_id FROM k JOIN r USING (id) WHERE source_id NOT IN (SELECT source_id FROM d)
UNION ALL SELECT 'anchor_missing', id, anchor FROM a JOIN r USING (id) JOIN d USING (source_id) WHERE NOT contains(text, anchor)
UNION ALL SELECT 'anchor_elsewhere', id, anchor || '@' || d.source_id FROM (SELECT DISTINCT * FROM a) a JOIN d ON contains(text, anchor) AND d.source_id <> a.source_id
UNION ALL SELECT 'anchor_straddles', id, anchor FROM (SELECT DISTINCT * FROM a) a JOIN d USING (source_id) WHERE contains(text, anchor) AND NOT EXISTS (SELECT 1 FROM c WHERE c.source_id = a.source_id AND contains(c.text, anchor))""",
)
def _validate(spark, d):
    """A question that is there twice carries its key twice: what is said of each of its sources and anchors is said twice."""
    keys = frame(spark, "question_keys").groupBy("id").agg(F.collect_list(F.struct("source_id", "anchors")).alias("expected"), F.first("acceptable").alias("acceptable"))
    return evaluation.validate(frame(spark, "question_rows").join(keys, "id", "left"), frame(spark, "key_documents"), frame(spark, "key_chunks"))


query(
    "validate_items",
    "SELECT 'anchor_elsewhere' AS problem, CAST(item_id AS VARCHAR) AS id, b.text || '@' || doc_id AS detail FROM benchmark b JOIN documents d ON contains(d.text, b.text) UNION ALL SELECT 'no_document', CAST(item_id AS VARCHAR), 'item ' || item_id FROM benchmark UNION ALL SELECT 'unknown_source', CAST(item_id AS VARCHAR), 'item ' || item_id FROM benchmark",
)(
    lambda spark, d: evaluation.validate(
        table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.array(F.struct(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("source_id"), F.array("text").alias("anchors"))).alias("expected"), F.array().cast("array<string>").alias("acceptable")),
        table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "text"),
        table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "text"),
    )
)
query("expected_and_acceptable", f"SELECT id, list_sort(list_intersect(expected, acceptable)) AS both_lists, list_sort(list_distinct(list_concat(expected, acceptable))) AS allowed FROM {values('keys')}")(
    lambda spark, d: frame(spark, "keys").select("id", F.array_sort(F.array_intersect("expected", "acceptable")).alias("both_lists"), F.array_sort(F.array_union("expected", "acceptable")).alias("allowed"))
)

# ---------------------------------------------------------------- scalar functions

_SAFE = r"regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), ' ', '_'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
query("safe_filename", f"SELECT p_partkey, {_SAFE.format('p_name')} AS safe FROM part")(lambda spark, d: table(spark, d, "part").select("p_partkey", T.safe_filename(F.col("p_name")).alias("safe")))
query("safe_filename_cases", f"SELECT id, {_SAFE.format('name')} AS safe FROM {values('names')}")(lambda spark, d: frame(spark, "names").select("id", T.safe_filename(F.col("name")).alias("safe")))
query("unicode_norm", r"SELECT doc_id, sha256(regexp_replace(text, '\p{Cf}', '', 'g')) AS sha FROM documents")(lambda spark, d: table(spark, d, "documents").select("doc_id", F.sha2(T.normalize_unicode(F.col("text")), 256).alias("sha")))
query("unicode_tidy_cases", rf"SELECT id, regexp_replace(regexp_replace(regexp_replace(line, '\p{{Cf}}', '', 'g'), '[ \t]{{2,}}', ' ', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS line FROM {values('spacing')}")(lambda spark, d: frame(spark, "spacing").select("id", T.tidy_spacing(T.normalize_unicode(F.col("line"))).alias("line")))
query("tidy_spacing", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS sha FROM documents")(lambda spark, d: table(spark, d, "documents").select("doc_id", F.sha2(T.tidy_spacing(F.col("text")), 256).alias("sha")))
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), ' ([,.;:)\]])', '\1', 'g'), '([(\[]) ', '\1', 'g'))"
query("clean_text_cases", f"SELECT id, {_CLEAN.format('raw')} AS clean FROM {values('dirty')}")(lambda spark, d: frame(spark, "dirty").select("id", T.clean_text(F.col("raw")).alias("clean")))
query("clean_text_pages", f"SELECT page_id, {_CLEAN.format(chr(114) + 'egexp_replace(html, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS clean FROM pages")(
    lambda spark, d: table(spark, d, "pages").select("page_id", T.clean_text(F.regexp_replace("html", "<[^>]*>", " ")).alias("clean"))
)
query("toc_label", rf"SELECT id, nullif(regexp_replace(regexp_extract(coalesce(title, ''), '^(Volume[\s\p{{Z}}]+\d+|Part[\s\p{{Z}}]+[A-Z])\b', 1), '[\s\p{{Z}}]+', ' ', 'g'), '') AS label FROM {values('titles')}")(lambda spark, d: frame(spark, "titles").select("id", T.toc_label(F.col("title")).alias("label")))
query("plain", rf"SELECT id, regexp_replace(replace(md, '$', '\$'), '(^|\n)(#+)', '\1\\\2', 'g') AS plain FROM {values('dollars')}")(lambda spark, d: frame(spark, "dollars").select("id", T.plain(F.col("md")).alias("plain")))
query("status_category", f"SELECT id, CASE status WHEN 403 THEN 'forbidden' WHEN 404 THEN 'not_found' WHEN 429 THEN 'rate_limited' ELSE CASE WHEN status >= 500 THEN 'server_error' ELSE 'client_error' END END AS category FROM {values('statuses')}")(lambda spark, d: frame(spark, "statuses").select("id", T.status_category(F.col("status")).alias("category")))
query("retry_after", f"SELECT id, CASE WHEN regexp_full_match(header, '-?[0-9]+') THEN greatest(0, TRY_CAST(header AS INTEGER)) END AS seconds FROM {values('headers')}")(lambda spark, d: frame(spark, "headers").select("id", T.retry_after(F.col("header")).alias("seconds")))


@query("backoff", f"SELECT attempt, base, CAST(least(base * pow(2, attempt - 1), maximum) AS BIGINT) AS seconds FROM {values('attempts')}")
def _backoff(spark, d):
    return frame(spark, "attempts").select("attempt", "base", T.backoff(F.col("attempt"), F.col("base"), F.col("maximum")).alias("seconds"))


# ---------------------------------------------------------------- citations

_URL = "regexp_extract(coalesce({0}, ''), '/policy-manual/volume-(\\d+)-part-([a-z])-chapter-(\\d+)', {1})"
_POLICY = f"CASE WHEN {_URL.format('url', 1)} <> '' THEN {_URL.format('url', 1)} || ' USCIS-PM ' || upper({_URL.format('url', 2)}) || '.' || {_URL.format('url', 3)} END"


def _case_of(table: dict[str, str], key: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


_COURT = f"coalesce({_case_of(C.COURTS, 'court_id')}, court_id)"
_NAME = f"coalesce({_case_of(C.CASE_NAMES, 'source_id')}, nullif(title, ''), 'Unknown case')"
_INSIDE = f"concat_ws(' ', nullif({_COURT}, ''), nullif(left(date, 4), ''))"
_CASE = f"(concat_ws(', ', {_NAME}, nullif(citation, '')) || CASE WHEN {_INSIDE} <> '' THEN ' (' || {_INSIDE} || ')' ELSE '' END)"
_SUFFIX = "CASE coalesce(len(footnote_numbers), 0) WHEN 0 THEN '' WHEN 1 THEN ', n.' || footnote_numbers[1] ELSE ', nn.' || array_to_string(footnote_numbers, ', ') END"
_CASE_COLS = ("id", "source_id", "source_type", "title", "citation", "court_id", "date", "url", "footnote_numbers")


def _row() -> dict:
    return {c: F.col(c) for c in _CASE_COLS}


query("citation_url", f"SELECT id, {_POLICY} AS cite FROM {values('urls')}")(lambda spark, d: frame(spark, "urls").select("id", C.url_citation(F.col("url")).alias("cite")))
query("citation_url_pages", f"SELECT page_id, {_POLICY} AS cite FROM (SELECT page_id, '/policy-manual/volume-' || page_id || '-part-b-chapter-' || (page_id + 1) AS url FROM pages)")(
    lambda spark, d: table(spark, d, "pages").select("page_id", C.url_citation(F.concat(F.lit("/policy-manual/volume-"), F.col("page_id").cast("string"), F.lit("-part-b-chapter-"), (F.col("page_id") + 1).cast("string"))).alias("cite"))
)
query("court_label", f"SELECT id, {_COURT} AS court FROM {values('cases')}")(lambda spark, d: frame(spark, "cases").select("id", C.court_label(F.col("court_id")).alias("court")))
query("court_label_join", f"SELECT id, {_COURT} AS court FROM {values('cases')}")(lambda spark, d: frame(spark, "cases").select("id", "court_id").join(F.broadcast(C.courts_table(spark)), "court_id", "left").select("id", F.coalesce("label", "court_id").alias("court")))
query("case_name", f"SELECT id, {_NAME} AS name FROM {values('cases')}")(lambda spark, d: frame(spark, "cases").select("id", C.case_name(F.col("source_id"), F.col("title")).alias("name")))
query("citation_case", f"SELECT id, {_CASE} AS cite FROM {values('cases')}")(lambda spark, d: frame(spark, "cases").select("id", C.case_citation(*(F.col(c) for c in ("source_id", "title", "citation", "court_id", "date"))).alias("cite")))
query("footnote_suffix", f"SELECT id, {_SUFFIX} AS suffix FROM {values('cases')}")(lambda spark, d: frame(spark, "cases").select("id", C.footnote_suffix(F.col("footnote_numbers")).alias("suffix")))
query("format_citation", f"SELECT id, CASE WHEN source_type = 'uscis' THEN coalesce({_POLICY}, nullif(title, ''), 'USCIS Policy Manual') ELSE {_CASE} END || {_SUFFIX} AS cite FROM {values('cases')}")(lambda spark, d: frame(spark, "cases").select("id", C.format_citation(_row()).alias("cite")))
query(
    "check_citations",
    rf"""WITH a AS (SELECT *, regexp_extract_all(answer, '([\p{{L}}\p{{N}}]?)\[([^\]]*)\]', 2) AS g, regexp_extract_all(answer, '([\p{{L}}\p{{N}}]?)\[([^\]]*)\]', 1) AS b, string_split_regex(answer, '\[[^\]]*\]') AS rest FROM {values("answers")}),
x AS (SELECT answer_id, known, flatten(list_transform(g, lambda s: regexp_extract_all(s, 'S\d+'))) AS l,
  list_transform(list_filter(range(1, len(g) + 1), lambda i: NOT regexp_matches(g[i], 'S\d') AND b[i] = '' AND NOT regexp_matches(coalesce(rest[i + 1], ''), '^[\p{{L}}\p{{N}}]')), lambda i: trim(g[i])) AS m FROM a)
SELECT answer_id, list_transform(list_sort(list_transform(list_distinct(list_filter(l, lambda s: list_contains(known, s))), lambda s: CAST(s[2:] AS BIGINT))), lambda n: 'S' || n) AS cited,
  list_transform(list_sort(list_transform(list_distinct(list_filter(l, lambda s: NOT list_contains(known, s))), lambda s: CAST(s[2:] AS BIGINT))), lambda n: 'S' || n) AS unknown,
  list_transform(list_sort(list_transform(list_distinct(list_filter(known, lambda s: NOT list_contains(l, s))), lambda s: CAST(s[2:] AS BIGINT))), lambda n: 'S' || n) AS uncited,
  list_sort(list_distinct(m)) AS malformed, CAST(len(list_filter(l, lambda s: list_contains(known, s))) AS BIGINT) AS citations FROM x""",
)(lambda spark, d: C.check_citations(frame(spark, "answers")))


NOTE_SQL = "note"
for _p in S.CITATION_PATTERNS:
    NOTE_SQL = f"regexp_replace({NOTE_SQL}, '{_p.replace(chr(39), chr(39) * 2)}', ' ', 'gi')"
STOP = ", ".join(f"'{w}'" for w in S.FUNCTION_WORDS)
query(
    "content_words",
    rf"""WITH w AS (SELECT id, list_filter(regexp_split_to_array(lower(regexp_replace({NOTE_SQL}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+'), lambda w: length(w) > 1 AND NOT list_contains([{STOP}], w)) AS words FROM {values("notes")})
SELECT id, words, len(words) >= 3 AS substantive FROM w""",
)(lambda spark, d: frame(spark, "notes").select("id", S.content_words(F.col("note")).alias("words"), S.is_substantive(F.col("note")).alias("substantive")))

# ---------------------------------------------------------------- footnotes, alerts, pages


def parts(spark):
    return footnotes.split_block(frame(spark, "note_lines"))


def parsed(spark):
    return footnotes.parse(parts(spark).filter("part = 'definition'"))


SPLIT = rf"""WITH l AS {values("note_lines")}, f AS (SELECT source_id, min(line_no) AS first_at FROM l WHERE regexp_matches(line, '^#+\s+Footnotes?\s*$') GROUP BY 1),
s AS (SELECT l.source_id, l.line_no, l.line, CASE WHEN first_at IS NULL OR line_no < first_at THEN 'body' WHEN line_no = first_at THEN 'heading' ELSE 'definition' END AS part FROM l LEFT JOIN f USING (source_id)),
g AS (SELECT *, sum(CASE WHEN n <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY line_no) AS pos FROM (SELECT *, regexp_extract(line, '^\[\^\s*(\d+)\]\s*(.*)$', 1) AS n FROM s WHERE part = 'definition')),
n AS (SELECT source_id, pos, CAST(max(nullif(n, '')) AS INTEGER) AS number, string_agg(CASE WHEN n <> '' THEN regexp_extract(line, '^\[\^\s*(\d+)\]\s*(.*)$', 2) ELSE trim(line) END, ' ' ORDER BY line_no) AS note FROM g WHERE pos > 0 AND trim(line) <> '' GROUP BY source_id, pos),
notes AS (SELECT source_id, CAST(pos AS BIGINT) AS position, number, note, row_number() OVER (PARTITION BY source_id, number ORDER BY pos) = 1 AS is_first FROM n),
marks AS (SELECT DISTINCT source_id, CAST(unnest(regexp_extract_all(line, '\[(\d+)\]', 1)) AS INTEGER) AS number FROM s WHERE part = 'body')
"""
query("footnote_block", SPLIT + "SELECT source_id, line_no, line, part FROM s")(lambda spark, d: parts(spark))
query("parse_footnotes", SPLIT + "SELECT * FROM notes")(lambda spark, d: parsed(spark))
query("footnote_duplicates", SPLIT + "SELECT source_id, number, note FROM notes WHERE NOT is_first")(lambda spark, d: parsed(spark).filter("not is_first").select("source_id", "number", "note"))
query("footnote_orphans", SPLIT + "SELECT * FROM marks m WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.source_id = m.source_id AND n.number = m.number)")(lambda spark, d: footnotes.orphans(parts(spark).filter("part = 'body'"), parsed(spark)))
query("footnote_unplaced", SPLIT + "SELECT source_id, number, note FROM notes n WHERE is_first AND NOT EXISTS (SELECT 1 FROM marks m WHERE n.source_id = m.source_id AND n.number = m.number)")(lambda spark, d: footnotes.unplaced(parts(spark).filter("part = 'body'"), parsed(spark)))


query(
    "alert_verdicts",
    f"""WITH l AS (SELECT source_id, line_no, starts_with(line, '[ALERT] ') AS is_alert, CASE WHEN starts_with(line, '[ALERT] ') THEN substr(line, 9) ELSE line END AS line FROM {values("alert_lines")}),
m AS (SELECT l.*, (SELECT arg_max(verdict, length(opening)) FROM {values("verdicts")} v WHERE l.is_alert AND v.source_id = l.source_id AND starts_with(l.line, v.opening)) AS verdict FROM l)
SELECT source_id, line_no, line, is_alert AND verdict IS NULL AS unreviewed FROM m WHERE NOT (is_alert AND coalesce(verdict, '') = 'drop')""",
)(lambda spark, d: footnotes.resolve_alerts(frame(spark, "alert_lines"), frame(spark, "verdicts")))
KEY = r"regexp_replace(regexp_replace(trim({0}), '\s+', ' ', 'g'), '\d+', '#', 'g')"
HEADS = rf"""WITH p AS (SELECT source_id, unnest(string_split(text, chr(12))) AS page FROM {values("paged")}), c AS (SELECT source_id, count(*) AS pages FROM p GROUP BY 1),
f AS (SELECT source_id, list_filter(string_split(page, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM p),
e AS (SELECT source_id, 'head' AS position, l[1] AS line FROM f WHERE len(l) > 0 UNION ALL SELECT source_id, 'foot', l[-1] FROM f WHERE len(l) > 0)
SELECT source_id, position, {KEY.format("line")} AS key, count(*) AS n FROM e JOIN c USING (source_id) GROUP BY source_id, position, key, pages HAVING count(*) >= greatest(3, pages * 0.35)"""
query("running_heads", HEADS)(lambda spark, d: pages.running_heads(frame(spark, "paged")))
query(
    "pleading_paper",
    rf"SELECT source_id, coalesce(avg(CASE WHEN regexp_matches(line, '^[ \t]{{0,3}}\d{{1,2}}([ \t]{{2,}}|[ \t]*$)') THEN 1 ELSE 0 END) FILTER (regexp_matches(line, '\S')), 0) > 0.3 AS pleading FROM (SELECT source_id, unnest(string_split(text, chr(10))) AS line FROM {values('paged')}) GROUP BY source_id",
)(lambda spark, d: frame(spark, "paged").select("source_id", pages.is_pleading_paper(F.col("text")).alias("pleading")))
query("head_key", f"SELECT doc_id, line_no, {KEY.format('line')} AS key FROM ({_LINES})")(lambda spark, d: chunking.lines(table(spark, d, "documents")).select("doc_id", "line_no", T.head_key(F.col("line")).alias("key")))
query("join_wrapped", r"SELECT doc_id, sha256(regexp_replace(replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10)), '-\n', '-', 'g'), chr(10), ' '), '\s{2,}', ' ', 'g')) AS sha FROM documents")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", F.sha2(T.join_wrapped(F.split("text", "\n")), 256).alias("sha"))
)
query("clean_paged", typed=("paged",))(lambda spark, d: pages.clean(frame(spark, "paged")))
query("pseudo_pages", "SELECT doc_id AS source_id, CAST(len(string_split(text, chr(10) || chr(10))) AS INTEGER) AS pages FROM documents")(lambda spark, d: pages.clean(table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.replace("text", F.lit("\n\n"), F.lit("\f")).alias("text"))).select(F.col("source_id").cast("long").alias("source_id"), "pages"))

# ---------------------------------------------------------------- markup

query("html_extract")(lambda spark, d: markup.extract(table(spark, d, "pages")))
query("html_unhandled")(lambda spark, d: markup.extract(table(spark, d, "pages")).select(F.explode("unhandled").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("pages")))
query("html_tag_counts", r"SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages) GROUP BY tag")(
    lambda spark, d: table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), 1)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
)
query("html_list_items", r"SELECT page_id, CAST(len(regexp_extract_all(html, '<li[ >]')) AS BIGINT) AS items FROM pages")(lambda spark, d: table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit("<li[ >]")).cast("long").alias("items")))


@query("xml_opinions", typed=("payloads",))
def _opinions(spark, d):
    xml = '<casebody><opinion><author>X, J.</author><p>Castr<em>acani</em> held<footnotemark>1</footnotemark> so <page-number>*9</page-number>far.</p><blockquote>quoted</blockquote><table/><footnote label="1"><p>1. A note.</p></footnote></opinion></casebody>'
    return markup.opinions(spark.createDataFrame([("o1", xml), ("o2", "<broken"), ("o3", "<casebody/>")], "source_id string, xml string"))


# ---------------------------------------------------------------- ingest

query("breaker", "WITH e AS (SELECT user_id AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, event_type = 'error' AS f FROM events), i AS (SELECT *, r - row_number() OVER (PARTITION BY key, f ORDER BY r) AS island FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY key, island ORDER BY r) AS run FROM i WHERE f) SELECT key, min(r) AS stop_at FROM n WHERE run = 3 GROUP BY key")(
    lambda spark, d: ingest.breaker(table(spark, d, "events").select(F.col("user_id").alias("key"), "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq")), F.col("event_type") == "error")
)
query("failures_by_category", "SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1")(lambda spark, d: ingest.failures_by_category(table(spark, d, "events").withColumnRenamed("event_type", "category")))
query("resume_skip", f"SELECT * FROM {values('selection')} WHERE id NOT IN (SELECT id FROM {values('fetched')})")(lambda spark, d: ingest.resume(frame(spark, "selection"), frame(spark, "fetched")))
query("search_drift", f"SELECT s.name, s.expected, c.found, s.expected IS DISTINCT FROM c.found AS drifted FROM {values('searches')} s LEFT JOIN {values('search_counts')} c USING (name)")(lambda spark, d: ingest.drift(frame(spark, "searches"), frame(spark, "search_counts")))
query("selection_incomplete", f"SELECT id FROM {values('selection')} WHERE opinion_id IS NULL OR coalesce(len(barrier), 0) = 0 OR coalesce(why, '') = ''")(lambda spark, d: ingest.incomplete(frame(spark, "selection")).select("id"))
query("manifest_join", f"SELECT f.id, s.opinion_id, s.opinion_id IS NULL AS missing FROM {values('fetched')} f LEFT JOIN {values('selection')} s USING (id)")(lambda spark, d: ingest.with_sidecar(frame(spark, "fetched"), frame(spark, "selection").select("id", "opinion_id", F.lit(1).alias("x")), "id").select("id", "opinion_id", F.col("opinion_id").isNull().alias("missing")))
query("excluded_documents", f"SELECT source_id, CASE WHEN court_id IN ('bia', 'olc') THEN 'excluded court ' || court_id ELSE 'no content' END AS reason FROM {values('tagged')} WHERE court_id IN ('bia', 'olc') OR NOT coalesce(regexp_matches(text, '\\S'), false)")(lambda spark, d: ingest.indexable(frame(spark, "tagged"))[1])
query("tag_filter", f"SELECT source_id FROM {values('tagged')} WHERE source_type = 'caselaw' AND list_contains(string_split(barrier, ','), 'delay')")(lambda spark, d: frame(spark, "tagged").filter(search.metadata_filter("caselaw", "delay")).select("source_id"))
query("tag_counts", f"SELECT barrier, count(*) AS n FROM (SELECT unnest(string_split(barrier, ',')) AS barrier FROM {values('tagged')}) GROUP BY 1")(lambda spark, d: ingest.tags(frame(spark, "tagged")))

# ---------------------------------------------------------------- answers and runs

_DEFINED = f"(SELECT *, answer IS NOT NULL AS ok FROM {values('records')} WHERE NOT probe)"
_SUMS = {"citations": "citations", "fabricated": "len(unknown)", "malformed": "len(malformed)", "off_target_cites": "len(off_target_cites)", "sources_cited": "len(cited)", "sources_shown": "sources"}


def _records(spark):
    r = frame(spark, "records")
    return r.withColumn("usage", F.when(F.col("thoughts").isNotNull(), F.create_map(F.lit("thoughtsTokenCount"), F.col("thoughts").cast("long"))))


query(
    "gen_totals",
    "SELECT count(*) AS questions, count(*) FILTER (ok) AS answered, "
    + ", ".join(f"CAST(sum(CASE WHEN ok THEN {e} ELSE 0 END) AS BIGINT) AS {n}" for n, e in _SUMS.items())
    + ", CAST(sum(anchors) AS BIGINT) AS anchors, CAST(sum(anchors_in_cited) AS BIGINT) AS anchors_in_cited, CAST(sum(anchors_in_context) AS BIGINT) AS anchors_in_context, count(*) FILTER (ok AND refused_verbatim) AS refused_verbatim, count(*) FILTER (ok AND truncated) AS truncated,"
    + " CAST(sum(len(expected_retrieved)) AS BIGINT) AS expected_retrieved, CAST(sum(len(expected_cited)) AS BIGINT) AS expected_cited, CAST(0 AS BIGINT) AS prompt_tokens, CAST(0 AS BIGINT) AS answer_tokens, CAST(sum(CASE WHEN ok THEN coalesce(thoughts, 0) ELSE 0 END) AS BIGINT) AS thought_tokens, round(sum(CASE WHEN ok THEN seconds ELSE 0 END), 1) AS seconds"
    + f" FROM {_DEFINED}",
)(lambda spark, d: evaluation.totals(_records(spark)))
query("degraded_histogram", f"SELECT degraded_category, count(*) AS n FROM {values('records')} WHERE NOT probe AND degraded_category IS NOT NULL GROUP BY 1")(lambda spark, d: evaluation.degraded(frame(spark, "records")))
query("answer_status", f"SELECT id, CASE WHEN answer IS NULL THEN 'FAIL' WHEN len(unknown) > 0 OR len(malformed) > 0 OR truncated THEN 'flag' WHEN refused_verbatim THEN 'decl' ELSE 'ok' END AS status FROM {values('records')}")(lambda spark, d: frame(spark, "records").select("id", answers.status().alias("status")))
query(
    "answer_flags",
    f"""SELECT id, list_filter([CASE WHEN len(unknown) > 0 THEN 'FABRICATED citations: ' || array_to_string(unknown, ', ') END, CASE WHEN len(malformed) > 0 THEN 'non-source citations: ' || array_to_string(malformed, ', ') END,
CASE WHEN truncated THEN 'hit maxOutputTokens, so the citation check is not trustworthy here' END, CASE WHEN refused_verbatim THEN 'used the required refusal sentence' END,
CASE WHEN len(off_target_cites) > 0 THEN 'cited ' || array_to_string(off_target_cites, ', ') || ' from a document that is neither expected nor acceptable' END,
CASE WHEN len(list_filter(expected_retrieved, lambda x: NOT list_contains(expected_cited, x))) > 0 THEN 'retrieved but never cited: ' || array_to_string(list_filter(expected_retrieved, lambda x: NOT list_contains(expected_cited, x)), ', ') END], lambda x: x IS NOT NULL) AS flags FROM {values("records")}""",
)(lambda spark, d: frame(spark, "records").select("id", answers.flags().alias("flags")))
query("run_compare", f"SELECT l.id, l.anchors_in_cited AS anchors_in_cited_left, l.off_target AS off_target_left, l.citations AS citations_left, l.thought_tokens AS thought_tokens_left, r.anchors_in_cited AS anchors_in_cited_right, r.off_target AS off_target_right, r.citations AS citations_right, r.thought_tokens AS thought_tokens_right FROM {values('run_left')} l JOIN {values('run_right')} r USING (id)")(
    lambda spark, d: evaluation.compare(frame(spark, "run_left"), frame(spark, "run_right"))
)
query("config_diff", f'SELECT coalesce(l.field, r.field) AS field, l."value" AS left_value, r."value" AS right_value FROM {values("config_left")} l FULL JOIN {values("config_right")} r ON l.field = r.field WHERE l."value" IS DISTINCT FROM r."value"')(lambda spark, d: evaluation.config_diff(frame(spark, "config_left"), frame(spark, "config_right")))
query("question_select", "SELECT CAST(item_id AS BIGINT) AS position, CAST(item_id AS VARCHAR) AS id, false AS probe FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT 1000000, 'probe', true")(
    lambda spark, d: evaluation.select_questions(table(spark, d, "benchmark").select(F.col("item_id").alias("position"), F.col("item_id").cast("string").alias("id")), spark.sql("select 0L as position, 'probe' as id"), table(spark, d, "benchmark").filter("item_id % 3 = 0").select(F.col("item_id").cast("string").alias("id")))
)
query("question_unknown", "SELECT DISTINCT id FROM (SELECT unnest(['0', 'nope', 'nope', '-7']) AS id) WHERE id NOT IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark)")(lambda spark, d: evaluation.unknown_ids(table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id")), spark.sql("select explode(array('0', 'nope', 'nope', '-7')) as id")))
_READ = f"""WITH r AS (SELECT id, CASE WHEN json_valid(response) THEN CAST(response AS JSON) END AS j FROM {values("responses")}),
c AS (SELECT id, j, json_extract(j, '$.candidates[0]') AS c FROM r),
t AS (SELECT id, j, c, trim(array_to_string(list_transform(list_filter(coalesce(CAST(json_extract(c, '$.content.parts[*]') AS JSON[]), []), lambda p: coalesce(json_extract_string(p, '$.thought'), 'false') <> 'true'), lambda p: coalesce(json_extract_string(p, '$.text'), '')), '')) AS t, coalesce(json_extract_string(c, '$.finishReason') = 'MAX_TOKENS', false) AS truncated FROM c),
k AS (SELECT *, CASE WHEN j IS NULL THEN 'bad_json' WHEN c IS NULL THEN 'no_candidate' WHEN t = '' THEN 'empty_answer' END AS degraded_category FROM t)
"""
query(
    "read_response",
    _READ + "SELECT id, CASE WHEN degraded_category IS NULL THEN t END AS answer, degraded_category, degraded_category IS NULL AND starts_with(t, 'Not covered by the retrieved sources.') AS refused_verbatim, truncated FROM k",
)(lambda spark, d: answers.read_response(frame(spark, "responses")).select("id", "answer", "degraded_category", "refused_verbatim", "truncated"))
query(
    "read_local_response",
    f"""WITH r AS (SELECT id, CASE WHEN json_valid(response) THEN CAST(response AS JSON) END AS j FROM {values("local_responses")}), t AS (SELECT id, j, trim(coalesce(json_extract_string(j, '$.response'), '')) AS t FROM r)
SELECT id, CASE WHEN j IS NOT NULL AND t <> '' THEN t END AS answer, CASE WHEN json_extract_string(j, '$.done') = 'true' THEN 'STOP' ELSE '' END AS finish, CASE WHEN j IS NULL THEN 'bad_json' WHEN t = '' THEN 'empty_answer' END AS degraded_category FROM t""",
)(lambda spark, d: answers.read_local_response(frame(spark, "local_responses")).select("id", "answer", "finish", "degraded_category"))


@query(
    "answer_scores",
    """WITH s AS (SELECT conv_id AS qid, 'S' || turn AS label, turn % 3 AS source_id, text FROM conversations), c AS (SELECT *, label IN ('S0', 'S1') AS cited FROM s),
a AS (SELECT conv_id AS qid, min(substr(text, 3, 12)) AS anchor FROM conversations WHERE turn = 1 GROUP BY 1),
x AS (SELECT a.qid, max(CASE WHEN contains(c.text, anchor) THEN 1 ELSE 0 END) AS ctx, max(CASE WHEN contains(c.text, anchor) AND cited THEN 1 ELSE 0 END) AS cit FROM a JOIN c USING (qid) GROUP BY 1),
e AS (SELECT DISTINCT qid FROM s), d AS (SELECT qid, max(CASE WHEN source_id = 1 THEN 1 ELSE 0 END) AS ret, max(CASE WHEN source_id = 1 AND cited THEN 1 ELSE 0 END) AS cit1, sum(CASE WHEN cited AND source_id NOT IN (1, 2) THEN 1 ELSE 0 END) AS off FROM c GROUP BY 1)
SELECT e.qid, CAST(CASE WHEN x.qid IS NULL THEN 0 ELSE 1 END AS BIGINT) AS anchors, CAST(coalesce(ctx, 0) AS BIGINT) AS anchors_in_context, CAST(coalesce(x.cit, 0) AS BIGINT) AS anchors_in_cited, CAST(ret AS BIGINT) AS expected_retrieved, CAST(cit1 AS BIGINT) AS expected_cited, CAST(off AS BIGINT) AS off_target_cites FROM e JOIN d USING (qid) LEFT JOIN x USING (qid)""",
)
def _scores(spark, d):
    c = table(spark, d, "conversations")
    sources = c.select(F.col("conv_id").alias("qid"), F.concat(F.lit("S"), F.col("turn").cast("string")).alias("label"), (F.col("turn") % 3).alias("source_id"), "text")
    qids = c.select(F.col("conv_id").alias("qid")).distinct()
    anchors = c.filter("turn = 1").groupBy(F.col("conv_id").alias("qid")).agg(F.min(F.substring("text", 3, 12)).alias("anchor"))
    return answers.score(qids.withColumn("cited", F.array(F.lit("S0"), F.lit("S1"))), sources, anchors, qids.withColumn("source_id", F.lit(1).cast("long")), qids.withColumn("source_id", F.lit(2).cast("long")))
