"""Which documents contain which anchors verbatim, by rare word n-grams.

A word of an anchor that has white space on both sides stands as a whole word in every
document that contains the anchor; the first and the last may be cut. Windows of up to
three such inner words are the anchor's grams. One pass over the documents counts in how
many each gram occurs, the rarest becomes the anchor's seed, a second pass joins the seeds
to the documents' own grams and looks the anchor up in the texts that hold its seed. Only
grams of anchors leave a document. Seeds of up to ``BROADCAST_BYTES`` are broadcast and no
text is shuffled; beyond, seeds and grams meet by a shuffle without the texts, and only
texts that hold a seed follow.

Anchors without an inner word, at most two words or parts of them, go by their longest
part: it is joined to the distinct words of all documents on character trigrams, and the
words that contain it lead to the documents.

Null anchors, empty ones and those of white space alone match nothing; null texts contain
nothing. Repeated ids count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import shared_dir

#: Words of a gram at most, characters of a part's gram.
GRAM, CHARS = 3, 3
#: Bytes of seeds and their anchors that are broadcast at most.
BROADCAST_BYTES = 32 << 20
_WHITE = r"[\s\p{Z}]"


def saved(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    return F.filter(F.split(text, _WHITE), lambda w: w != "")


def inner_words(text: Column) -> Column:
    """Words with white space on both sides."""
    parts = F.split(text, _WHITE)
    return F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != "")


def grams(some: Column, n: int) -> Column:
    """Distinct hashes of the windows of ``n`` words; equal hashes of different windows only add texts to look into."""
    whole = F.slice(some, F.lit(1), F.greatest(F.size(some) - n + 1, F.lit(0)))
    return F.array_distinct(F.transform(whole, lambda w, i: F.xxhash64(F.lit(n), w, *(F.get(some, i + j) for j in range(1, n)))))


def _all_grams(docs: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """keep, gram of the documents, for each size that an anchor has."""
    split = docs.select(*keep, words(F.col("text")).alias("_w"))
    return split.select(*keep, F.explode(F.concat(*(grams(F.col("_w"), n) for n in sizes))).alias("gram"))


def seeds(anchors: DataFrame, docs: DataFrame, folder: str) -> tuple[DataFrame, list[int]] | None:
    """((anchor_id, anchor, gram): the rarest gram of each anchor that has one, sizes of the grams); anchors in no document are gone."""
    inner = anchors.select("anchor_id", "anchor", inner_words(F.col("anchor")).alias("_w")).withColumn("size", F.least(F.size("_w"), F.lit(GRAM))).filter("size > 0")
    of_size = F.when(F.col("size") == 1, grams(F.col("_w"), 1)).when(F.col("size") == 2, grams(F.col("_w"), 2)).otherwise(grams(F.col("_w"), GRAM))
    own = saved(inner.select("anchor_id", "anchor", "size", F.explode(of_size).alias("gram")), f"{folder}/grams")
    sizes = sorted(r[0] for r in own.select("size").distinct().collect())
    if not sizes:
        return None
    wanted = saved(own.select("gram").distinct(), f"{folder}/wanted")
    seen = _all_grams(docs, sizes).join(wanted, "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("documents"))
    # a gram that no document holds says that none contains the anchor
    counted = own.join(seen, "gram", "left").groupBy("anchor_id", "anchor").agg(F.min(F.struct(F.coalesce("documents", F.lit(0)).alias("documents"), F.col("gram"))).alias("s"))
    return saved(counted.filter("s.documents > 0").select("anchor_id", "anchor", "s.gram"), f"{folder}/seeds"), sizes


def _by_parts(anchors: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """anchor_id, doc_id of anchors without an inner word."""
    part = F.element_at(F.array_sort(F.transform(words(F.col("anchor")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    short = saved(anchors.select("anchor_id", "anchor", part.alias("part")).filter("part is not null"), f"{folder}/short")
    vocabulary = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word")).distinct()
    window = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))
    n = F.least(F.length("part"), F.lit(CHARS))
    keyed = short.select("anchor_id", "part", n.alias("n"), F.substring("part", F.lit(1), n).alias("key"))
    pieces = F.concat(*(F.when(F.length("word") >= k, window(F.col("word"), k)).otherwise(F.array().cast("array<string>")) for k in range(1, CHARS + 1)))
    inside = vocabulary.select("word", F.explode(F.array_distinct(pieces)).alias("key")).join(keyed, "key").filter(F.contains("word", "part")).select("anchor_id", "word").distinct()
    held = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(saved(inside, f"{folder}/inside"), "word").select("anchor_id", "doc_id").distinct()
    return held.join(docs.select("doc_id", "text"), "doc_id").join(short.select("anchor_id", "anchor"), "anchor_id").filter(F.contains("text", "anchor")).select("anchor_id", "doc_id")


def containment(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """anchor_id, doc_id (both long) of every document (doc_id, text) that contains an anchor (anchor_id, anchor) verbatim, once."""
    folder = shared_dir(docs.sparkSession)
    asked = anchors.select(F.col("anchor_id").cast("long").alias("anchor_id"), "anchor").filter("anchor is not null").distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    short = asked.filter(F.size(inner_words(F.col("anchor"))) == 0).filter(F.size(words(F.col("anchor"))) > 0)
    found = []
    chosen = seeds(asked, own, folder)
    if chosen:
        held, sizes = chosen
        size = held.agg(F.sum(F.octet_length("anchor") + 64)).first()[0] or 0
        if size <= BROADCAST_BYTES:
            near = _all_grams(own, sizes, "doc_id", "text").join(F.broadcast(held), "gram")
        else:
            pairs = _all_grams(own, sizes, "doc_id").join(held.hint("merge"), "gram").select("doc_id", "anchor_id", "anchor")
            near = pairs.distinct().join(own, "doc_id")
        found.append(near.filter(F.contains("text", "anchor")).select("anchor_id", "doc_id"))
    if not short.isEmpty():
        found.append(_by_parts(short, own, folder))
    if not found:
        return docs.sparkSession.createDataFrame([], "anchor_id long, doc_id long")
    return (found[0] if len(found) == 1 else found[0].unionByName(found[1])).distinct()
