"""Queries of the operators for many queries, keys and batches, with their DuckDB SQL: block join, approximate search, prefixes, pacing, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ann, chunking, encoding, evaluation, latent, pacing, pages, prefixes, search, tiles
from tessera.plans import derived
from tessera.plans.catalogue import ORACLE_SQL, chunk_sql, query, table
from tessera.session import shared_dir
from tessera.sources import index_source
from tessera.streaming import breaker

# ---------------------------------------------------------------- nearest neighbours

query(
    "knn_all",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM e),
s AS (SELECT q.vec_id AS qid, x.vec_id, round(list_inner_product(q.v, x.v) / q.norm / x.norm, 9) AS score FROM n q JOIN n x ON q.vec_id <> x.vec_id)
SELECT qid, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM s WINDOW w AS (PARTITION BY qid ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 8""",
)(lambda spark, d: tiles.knn_join(table(spark, d, "embeddings"), table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding"), search.TOP_K, but_itself=True).withColumn("score", F.round("score", 6)))


def _asked(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def _approximate(spark, d) -> ann.Found:
    index = table(spark, d, "embeddings").select("vec_id", "embedding")
    model = ann.fit(index, search.TOP_K)
    return ann.search(spark, ann.build(index, f"{shared_dir(spark)}/index", model), model, _asked(spark, d), search.TOP_K)


query("ann_topk")(lambda spark, d: _approximate(spark, d).hits)


@query("ann_recall")
def _ann_recall(spark, d):
    index = table(spark, d, "embeddings")
    return ann.recall(_approximate(spark, d), search.search(index, _asked(spark, d)), index.count())


# ---------------------------------------------------------------- a learned encoder

#: Dimensions of the latent vectors.
DIM = 48


@query("latent_vectors")
def _latent_vectors(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", encoding.encoder(latent.encode(latent.fit(docs, DIM)))(F.col("text")).alias("embedding"))


@query("latent_recall")
def _latent_recall(spark, d):
    """Share of the documents that hold a benchmark item which are among its nearest, by the learned encoder and by the hashing one."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    expected = evaluation.anchor_containment(items.select(F.col("item_id").alias("anchor_id"), F.col("text").alias("anchor")), docs).select(F.col("anchor_id").alias("qid"), F.col("doc_id").alias("vec_id"))
    out = []
    for name, run in (("hashing", encoding.hashing), ("latent", latent.encode(latent.fit(docs, DIM)))):
        encode = encoding.encoder(run)
        hits = search.search(docs.select(F.col("doc_id").alias("vec_id"), encode(F.col("text")).alias("embedding")), items.select(F.col("item_id").alias("qid"), encode(F.col("text")).alias("embedding")), search.POOL)
        found = expected.join(hits.select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
        out.append(found.agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("found")).select(F.lit(name).alias("encoder"), F.lit(search.POOL).alias("k"), "expected", "found"))
    return out[0].unionByName(out[1])


# ---------------------------------------------------------------- longest prefix

# hosts of even pages and first folders of every third one say something about all urls of their scheme
_OPENINGS = r"""(SELECT DISTINCT regexp_extract(url, '^[a-z]+', 0) AS scheme, regexp_extract(url, '^[a-z]+://[^/]+/', 0) AS opening, 'host' AS value FROM pages WHERE page_id % 2 = 0 UNION ALL
SELECT DISTINCT regexp_extract(url, '^[a-z]+', 0), regexp_extract(url, '^[a-z]+://[^/]+/[^/]+/', 0), 'folder' FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT DISTINCT regexp_extract(url, '^[a-z]+', 0), regexp_extract(url, '^[a-z]+://[^/]+/', 0), 'again' FROM pages WHERE page_id % 5 = 0)"""


@query(
    "longest_prefix",
    f"WITH o AS (SELECT scheme, opening, min(value) AS value FROM {_OPENINGS} GROUP BY ALL) SELECT page_id, max(length(opening)) AS chars, arg_max(opening, length(opening)) AS opening, arg_max(value, length(opening)) AS value FROM pages LEFT JOIN o ON regexp_extract(url, '^[a-z]+', 0) = o.scheme AND starts_with(url, o.opening) GROUP BY page_id",
)
def _longest_prefix(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+", 0).alias("scheme"))
    cut = lambda where, regex, value: p.filter(where).select("scheme", F.regexp_extract("url", regex, 0).alias("opening"), F.lit(value).alias("value"))
    host = "^[a-z]+://[^/]+/"
    openings = cut("page_id % 2 = 0", host, "host").unionByName(cut("page_id % 3 = 0", host + "[^/]+/", "folder")).unionByName(cut("page_id % 5 = 0", host, "again"))
    return prefixes.longest_prefix(p, openings, "scheme", "url").select("page_id", F.length("opening").cast("long").alias("chars"), "opening", "value")


# ---------------------------------------------------------------- requests and their failures

PACED_KEYS, CALLS, PER_S, QUIET_S = 7, 2, 3600, 5400


@query(
    "pacer",
    f"""WITH RECURSIVE r AS (SELECT user_id % {PACED_KEYS} AS key, event_id AS seq, epoch_us(ts) AS ready, greatest({PER_S * 1_000_000 // CALLS}, CAST(floor(value * 1000000) AS BIGINT) + CASE WHEN event_type = 'error' THEN {QUIET_S * 1_000_000} ELSE 0 END) AS gap, row_number() OVER (PARTITION BY user_id % {PACED_KEYS} ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT key, seq, ready, gap, i, ready AS start FROM r WHERE i = 1 UNION ALL SELECT r.key, r.seq, r.ready, r.gap, r.i, greatest(r.ready, s.start + s.gap) FROM s JOIN r ON r.key = s.key AND r.i = s.i + 1)
SELECT key, seq, ready, start, start - ready AS waited FROM s""",
)
def _pacer(spark, d):
    own = table(spark, d, "events").select((F.col("user_id") % PACED_KEYS).alias("key"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ready"), F.floor(F.col("value") * 1_000_000).alias("took"), (F.col("event_type") == "error").alias("limited"))
    return pacing.paced(own, CALLS, PER_S, QUIET_S)


#: Slices of the log that land one after another.
SLICES = 3


@query("breaker_stream", ORACLE_SQL["breaker"])
def _breaker_stream(spark, d):
    top = shared_dir(spark)
    log = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failure"))
    first, last = log.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return spark.createDataFrame([], "key long, stop_at long")
    for i in range(SLICES):
        begin, end = first + (last - first) * i / SLICES, first + (last - first) * (i + 1) / SLICES
        inside = (F.col("ts") >= F.lit(begin)) & ((F.col("ts") < F.lit(end)) if i < SLICES - 1 else F.lit(True))
        log.filter(inside).write.mode("append").parquet(f"{top}/log/slice={i}")
        # the query ends with each slice and goes on from its checkpoint when the next has landed
        arrived = spark.readStream.schema("key long, seq long, ts timestamp, failure boolean, slice int").parquet(f"{top}/log").drop("slice")
        breaker.start(arrived, f"{top}/stops", f"{top}/checkpoint").awaitTermination()
    return spark.read.schema(breaker.STOPPED).parquet(f"{top}/stops").select("key", "stop_at")


# ---------------------------------------------------------------- the index as a transactional source


@query("index_versions", chunk_sql("documents"))
def _index_versions(spark, d):
    """Chunks published in two versions; the second is what readers see."""
    index_source.register(spark)
    path, docs = shared_dir(spark), table(spark, d, "documents")
    chunking.chunks(docs.filter("lang = 'en'")).write.format(index_source.NAME).mode("overwrite").save(path)
    chunking.chunks(docs).write.format(index_source.NAME).mode("overwrite").save(path)
    return spark.read.format(index_source.NAME).load(path)


# ---------------------------------------------------------------- pages in rows of their own


@query("clean_pages")
def _clean_pages(spark, d):
    """The pages of the derived documents, a row each, cleaned with what their documents' other pages say."""
    return pages.clean_pages(pages.pages(derived.over(spark, d, "paged")))
