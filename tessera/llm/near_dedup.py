"""Near-duplicate groups: fast similarity sketches, banding, exact verification.

A document's set is its distinct five-word shingles (words: runs without white
space, A-Z lower-cased; with fewer words the whole sequence is one shingle). The
sketch has ``BANDS * ROWS`` coordinates. In round i each shingle is thrown into a
hashed bin with a hashed value; rounds go on until every bin is filled, earlier
rounds win, and from round T on the bin is i - T for all, so 2 T rounds always
suffice. Two sketches agree in a coordinate with the sets' similarity, with
concentration as for independent samples. Documents that agree in all coordinates
of a band are candidates; with five rows in each of 48 bands a pair at similarity
0.75 is missed with a chance below 3 in a million.

Links are never listed within a bucket pair by pair. Documents with equal sets
become one class. Then, over class representatives:

1. Each bucket's leader is its most central member, the one with the most company
   in all its buckets: in a group of edited copies that is the text they come from.
   Every document is compared with the leaders of its buckets, and components are formed.
2. Of a bucket that still spans components, with ``LISTED`` documents at most, the pairs
   between components that weren't compared yet are listed; sizes and signatures drop those that
   can't be links. The documents of larger ones are joined on their shingles. No pair is
   dropped unless it can't be a link. With n shingles in a set, a link has
   ``i >= 3/7 (n_a + n_b)`` in common; c of a document's shingles are held by another
   component too, and i is at most the lesser c. A shingle is common if more than ``SMALL``
   of these documents hold it. A link either shares an uncommon shingle, which is
   found by joining the prefixes of the uncommon ones (the rarest first), with two bounds on
   i: what is left of both sets from the shingle on, as at the first that they share all of i
   still comes, and the bits in which the sets' signatures differ, which their symmetric
   difference, 1/7 (n_a + n_b) at most, must cover. Or it lies within the common ones, h of each, and then i is at most the lesser h. Pairs of that
   kind are formed within buckets. They depend on nothing but the common shingles and n, so
   one document stands for all of its component with the same ones, and few pairs are
   within the bound.

All comparisons are exact, on full sets, which move once for both sides of their pairs. Keys
with many of all rows (buckets, leaders, shingles) are dealt out to several tasks.

Defined results: null and empty texts, and texts of white space, have an empty set
and link with nothing. Rows with null doc_id link with nothing and have a null
component; they are kept. Rows with the same doc_id are one node. Every input row
gives one output row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, among, dealt, dealt_ends, dropped, gram_hashes, lower_ascii, mix64, salted, saved, scratch_dir, text_blocks
from tessera.llm.components import components

SHINGLE_WORDS, BANDS, ROWS = 5, 48, 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Holders of a shingle up to which pairs are formed among all of them.
SMALL = 128
#: Documents of a bucket up to which its pairs are listed.
LISTED = 16
#: Columns of a set's signature, 64 bits each; they travel with every shingle of a prefix, and tell small sets apart.
SIGNATURE = ("x0", "x1")

_U = np.uint64


def shingle_sets(data: np.ndarray, docs: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every document, document offsets) of a block."""
    grams, offsets, _ = gram_hashes(Words(lower_ascii(data), docs), n)
    out = [np.unique(grams[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return (np.concatenate(out) if out else grams), np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)])


def sketch(sets: np.ndarray, offsets: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """(documents, t) sketches; those of empty sets are all ones."""
    n_docs = len(offsets) - 1
    none = ~_U(0)
    state = np.full(n_docs * t, none, _U)
    size = np.diff(offsets)
    active = np.flatnonzero(size > 0)
    items, base = sets, np.repeat(np.arange(n_docs, dtype=np.int64) * t, size)
    for i in range(2 * t):
        h = mix64(items + _U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> _U(32)) * _U(t) >> _U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(state, base + bins, (h & _U(0xFFFFFFFF)) | _U(i << 32))
        open_ = (state.reshape(n_docs, t)[active] == none).any(1)
        if not open_.any():
            break
        if not open_.all():
            active = active[open_]
            keep = np.zeros(n_docs, bool)
            keep[active] = True
            use = keep[base // t]
            items, base = items[use], base[use]
    return state.reshape(n_docs, t)


def band_keys(sketches: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) hashes of band number and coordinates."""
    part = sketches.reshape(len(sketches), bands, rows)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=_U)), part.shape[:2])
    for r in range(rows):
        key = mix64(key ^ mix64(part[:, :, r] + _U(0x9E3779B97F4A7C15)))
    return key


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, part, text -> doc_id, part, n, sig, keys."""
    import xxhash

    for batch in batches:
        for lo, hi, data, docs in text_blocks(batch):
            sets, off = shingle_sets(data, docs)
            n = np.diff(off)
            keys = np.empty((hi - lo, BANDS), np.int64)
            for a in range(0, hi - lo, 2000):
                b = min(hi - lo, a + 2000)
                keys[a:b] = band_keys(sketch(sets[off[a] : off[b]], off[a : b + 1] - off[a])).view(np.int64)
            raw = memoryview(np.ascontiguousarray(sets)).cast("B") if len(sets) else memoryview(b"")
            sig = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(sig, pa.binary()), lists], ["doc_id", "part", "n", "sig", "keys"])


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, words of 64 bits): whether an odd number of shingles falls on each bit. Two of them differ in as many bits as the sets in elements at most."""
    n, bits = len(offsets) - 1, 64 * len(SIGNATURE)
    at = np.repeat(np.arange(n, dtype=np.int64) * bits, np.diff(offsets)) + (sets % _U(bits)).astype(np.int64)
    odd = np.bincount(at, minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8").reshape(n, len(SIGNATURE))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> id, n, s, signature."""
    for batch in batches:
        for lo, hi, data, docs in text_blocks(batch):
            sets, off = shingle_sets(data, docs)
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(sets.view(np.int64)))
            for a in range(0, hi - lo, 2000):  # bounds the counts of bits
                b = min(hi - lo, a + 2000)
                sig = signatures(sets[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + a, b - a), pa.array(np.diff(off[a : b + 1])), lists.slice(a, b - a), *(pa.array(sig[:, i].copy()) for i in range(len(SIGNATURE)))], ["id", "n", "s", *SIGNATURE])


def verify(pairs: DataFrame, sets: DataFrame, folder: str, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``b`` may stand in very many of them."""
    pairs = saved(pairs, f"{folder}_pairs")
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("rows"))
    rows, spread = dealt_ends(pairs, counts, ("a", "b"), pairs.count(), sets.select("id", "s"))
    joined = rows.withColumnsRenamed({"a": "id", "salt_a": "salt"}).join(spread, ["id", "salt"]).select(F.col("id").alias("a"), "b", "salt_b", F.col("s").alias("sa"))
    joined = joined.withColumnsRenamed({"b": "id", "salt_b": "salt"}).join(spread, ["id", "salt"]).select("a", F.col("id").alias("b"), "sa", F.col("s").alias("sb"))
    both = joined.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return saved(both.filter(F.lit(100).cast("long") * F.col("both") >= F.lit(percent) * (F.col("total") - F.col("both"))).select("a", "b"), f"{folder}_links")


def _most_shared(n: str, held: str) -> str:
    """SQL for the largest set that can link with one of size ``n`` with which it has ``held`` shingles in common at most."""
    return f"((100 + {PERCENT}) * {held} div {PERCENT} - {n})"


#: SQL: the signatures of a and b differ in no more bits than the sets of a link may in elements.
_ALIKE = f"{100 + PERCENT} * ({' + '.join(f'bit_count({x}_a ^ {x}_b)' for x in SIGNATURE)}) <= {100 - PERCENT} * (n_a + n_b)"


def _side(rows: DataFrame, x: str, key: str, *more: str) -> DataFrame:
    """``rows`` as side ``x`` of pairs that agree in ``key``."""
    return rows.selectExpr(key, *more, *(f"{k} as {k}_{x}" for k in ("id", "comp", "n", *SIGNATURE)))


def _rest(sets: DataFrame, buckets: DataFrame, comps: DataFrame, seen: DataFrame, folder: str) -> DataFrame:
    """Pairs (a, b) of ``buckets`` (key, salt, id) in different components that can be links, without those of ``seen`` (a, b) and some that are sure not to be."""
    own = buckets.join(comps, "id", "left").select("key", "salt", "id", F.coalesce("component", "id").alias("comp"))
    spans = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("salt").alias("salts"), F.count(F.lit(1)).alias("rows")).filter("lo < hi and rows > 2")  # a leader has been compared with one other
    mixed = saved(own.join(salted(spans, F.col("salts") > 0).select("key", "salt", "rows"), ["key", "salt"]).select("key", "id", "comp", "rows"), f"{folder}/mixed")

    # pairs of small buckets
    few = mixed.filter(F.col("rows") <= LISTED).join(sets.select("id", "n", *SIGNATURE), "id")
    listed = _side(few, "a", "key").join(_side(few, "b", "key"), "key").filter(f"id_a < id_b and comp_a <> comp_b and {100 + PERCENT} * least(n_a, n_b) >= {PERCENT} * (n_a + n_b) and {_ALIKE}")
    listed = listed.selectExpr("id_a as a", "id_b as b").distinct().join(seen.selectExpr("least(a, b) as a", "greatest(a, b) as b"), ["a", "b"], "left_anti")
    nodes = saved(mixed.filter(F.col("rows") > LISTED).groupBy("id", "comp").agg(F.collect_list("key").alias("keys")), f"{folder}/many")
    if not nodes.limit(1).count():
        return listed

    # what other components hold: c of a set's shingles; h of these are common, the others by rarity
    each = saved(sets.join(nodes.select("id", "comp"), "id").select("id", "comp", "n", F.explode("s").alias("g")), f"{folder}/shingles")
    held = each.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo < hi").select("g", "rows")
    rows, holders = dealt(each, held, "g", each.count(), "id")
    shared = rows.join(holders, ["g", "salt"])
    common = F.col("rows") > SMALL
    told = shared.groupBy("id", "n").agg(
        F.count(F.lit(1)).alias("c"),
        F.count(F.when(common, 1)).alias("h"),
        F.sort_array(F.collect_list(F.when(~common, F.struct("rows", "g")))).alias("rare"),
        F.sort_array(F.collect_list(F.when(common, F.col("g")))).alias("core"),
    )
    told = told.filter(f"{_most_shared('n', 'c')} * 100 >= {PERCENT} * n")
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * PERCENT / 100) - F.col("h"))
    prefix = F.transform(F.slice("rare", 1, F.greatest(F.lit(0), F.size("rare") - needed + 1).cast("int")), lambda x: x["g"])
    told = told.select("id", "n", "c", "h", prefix.alias("prefix"), F.struct(F.xxhash64("core"), F.hash("core"), F.size("core")).alias("core"))
    known = saved(nodes.join(told, "id").join(sets.select("id", *SIGNATURE), "id"), f"{folder}/known")

    # pairs with an uncommon shingle in common: at the first of these, what is left of both must do
    rare = known.select("id", "comp", "n", "c", *SIGNATURE, F.posexplode("prefix").alias("p", "g"))
    enough = f"{100 + PERCENT} * least(left_a, left_b) >= {PERCENT} * (n_a + n_b) and {_ALIKE}"
    rare = _side(rare, "a", "g", "c - p as left_a").join(_side(rare, "b", "g", "c - p as left_b"), "g").filter(f"id_a < id_b and comp_a <> comp_b and {enough}").selectExpr("id_a as a", "id_b as b").distinct()

    # pairs that have only common shingles in common
    top, size = _most_shared("n", "h"), lambda n: f"cast(floor(ln({n}) * 100) as int)"
    able = known.filter(f"{top} * 100 >= {PERCENT} * n").select("id", "comp", "n", "core", F.expr(top).alias("top"), F.explode("keys").alias("key"))
    able = able.groupBy("key", "comp", "n", "core").agg(F.min("id").alias("id"), F.max("top").alias("top"))
    able = saved(able, f"{folder}/common")
    total, rows = able.count(), F.count(F.lit(1)).alias("rows")
    main = able.groupBy("key", "comp").agg(rows).groupBy("key").agg(F.max(F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("rows"))
    odd, main = dealt(able, main, "key", total, "id")
    odd = odd.join(main, ["key", "salt"]).filter("comp <> main.comp")
    odd = odd.selectExpr("key", "id as id_a", "comp as comp_a", "n as n_a", "top as top_a", f"explode(sequence({size(f'ceil(n * {PERCENT} / 100)')}, {size('top')})) as size")
    others = able.selectExpr("key", f"{size('n')} as size", "id as id_b", "comp as comp_b", "n as n_b", "top as top_b")
    others, sizes = dealt(others, others.groupBy("key", "size").agg(rows), ["key", "size"], total, "id_b")
    odd = odd.join(sizes.drop("rows"), ["key", "size"])
    core = odd.join(others, ["key", "size", "salt"]).filter("comp_a <> comp_b and n_b <= top_a and n_a <= top_b").selectExpr("least(id_a, id_b) as a", "greatest(id_a, id_b) as b").distinct()
    return listed.union(rare).union(core).distinct()


def link_components(docs: DataFrame, nodes: DataFrame, folder: str) -> DataFrame:
    """(id, component) of the nodes (id, keys: band keys; each once) that have a link; ``docs`` (doc_id, text) gives their full sets."""
    flat = nodes.select("id", F.explode("keys").alias("key"))
    alike = flat.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    rows, keys = dealt(flat, alike, "key", BANDS * nodes.count(), "id")
    buckets = saved(rows.join(keys, ["key", "salt"]), f"{folder}/buckets")
    company = saved(buckets.groupBy("id").agg(F.sum("rows").alias("company")), f"{folder}/company")
    texts = among(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")), company.select("id"))
    sets = saved(texts.mapInArrow(_sets, "id long, n long, s array<long>" + "".join(f", {x} long" for x in SIGNATURE)), f"{folder}/sets")

    leaders = buckets.join(company, "id").groupBy("key").agg(F.max(F.struct("company", F.col("id"))).alias("lead"), F.max("salt").alias("salts"))
    led = buckets.join(salted(leaders, F.col("salts") > 0).select("key", "salt", F.col("lead.id").alias("lead")), ["key", "salt"])
    led_pairs = saved(led.filter("lead <> id").selectExpr("id as a", "lead as b").distinct(), f"{folder}/led")
    links = verify(led_pairs, sets, f"{folder}/leaders")
    comps = saved(components(links, f"{folder}/c1"), f"{folder}/comps1")

    pairs = saved(_rest(sets, buckets.select("key", "salt", "id"), comps, led_pairs, folder), f"{folder}/found")
    last = verify(pairs, among(sets, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), f"{folder}/rest")
    if last.limit(1).count():
        comps = saved(components(comps.selectExpr("id as a", "component as b").union(last), f"{folder}/c2"), f"{folder}/comps2")
    dropped(docs.sparkSession, *(f"{folder}/{name}" for name in ("buckets", "company", "sets", "led", "leaders_pairs", "leaders_links", "c1", "mixed", "many", "shingles", "known", "common", "found", "rest_pairs", "rest_links", "c2")))
    return comps


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id of every row of ``docs`` (doc_id, text)."""
    folder = scratch_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().alias("part"), F.col("text"))
    base = saved(rows.mapInArrow(_profile, "doc_id long, part int, n long, sig binary, keys array<long>"), f"{folder}/base")
    real = base.filter("sig is not null and doc_id is not null")
    local = real.groupBy("sig", "part").agg(F.min("doc_id").alias("m"))
    classes = local.join(local.groupBy("sig").agg(F.min("m").alias("class_id")), "sig").select("sig", "part", "class_id")
    own = saved(base.select("doc_id", "part", "n", "sig").join(classes, ["sig", "part"], "left").select("doc_id", "n", "sig", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")), f"{folder}/classes")
    others = own.filter("doc_id <> class_id").selectExpr("doc_id as id", "sig").distinct()
    nodes = real.select(F.col("doc_id").alias("id"), "sig", "keys")
    if own.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        nodes = nodes.join(others, ["id", "sig"], "left_anti").dropDuplicates(["id", "sig"])
    else:
        nodes = among(nodes, others.select("id"), "left_anti")
    nodes = nodes.select("id", "keys")
    comps = link_components(docs, nodes, folder)
    # an id that stands on rows of several classes joins them
    joined = own.filter("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    doubles = own.filter("class_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("c")).filter("b < c")
    if doubles.limit(1).count():
        comps = saved(components(comps.selectExpr("id as a", "component as b").union(joined), f"{folder}/c4"), f"{folder}/comps4")
    out = own.join(comps.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")


def op7(docs: DataFrame) -> DataFrame:
    return groups(docs)


def deduped(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays (the smallest id of its component); columns as given."""
    gone = groups(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


#: DuckDB SQL for ``op7`` by definition.
ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) end as s from w
), e as (
  select doc_id, len(s) as n, unnest(s) as g from s
), p as (
  select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), c as (
  select doc_id as d, doc_id as r from documents union select p.y, c.r from c join p on p.x = c.d
), m as (
  select d, min(r) as component_id from c group by d
)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, component_id, s.doc_id = component_id as kept,
  case when len(s.s) = 0 then s.doc_id else min(s.doc_id) over (partition by s.s) end as class_id
from s join m on m.d = s.doc_id
"""
