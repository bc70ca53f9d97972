"""Spelling variants by a symmetric-delete join.

Every word emits itself and its distinct single deletions; words that share a key are
joined and kept where their distance is exactly one (one code point inserted, deleted or
replaced). Two such words share exactly one key: the shorter word, or what is left
without the place where they differ (an equal letter beside it gives the same deletion,
which a word emits once). So a pair comes up once in each direction and nothing has to be
made distinct. A key's words are the key and what one inserted letter makes of it, so
their number is bounded by the alphabet and the key's length, not by the data.

A word's form is its near word of largest count (ties: the smallest in code-point order)
where that count is at least ``ratio`` times its own. Counts grow along forms, so forms
make no circle and a chain has at most log_ratio(largest count) steps; roots are found by
joining the roots with themselves, which doubles the steps followed each time.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, lower-cased in A-Z only. Null texts
and texts without letters give none; repeated rows count again; columns other than doc_id
and text are not looked at; an empty table gives no rows. Words are counted per task
before they meet, so neither a frequent word nor a long text is gathered anywhere.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, saved, scratch_dir

LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: The query deletes a code point of every run whose hash this divides.
EDITED = 199


def lower_a_z(c: Column) -> Column:
    """Lower-case A-Z only; ASCII strings take the fast way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def runs(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, run: every maximal run of letters of at least ``least`` code points, lower-cased."""
    each = docs.select("doc_id", F.explode(F.split("text", r"[^A-Za-zÀ-ÿ]+")).alias("run")).filter(F.length("run") >= least)
    return each.select("doc_id", lower_a_z(F.col("run")).alias("run"))


def edited(words: DataFrame, one_in: int = EDITED) -> DataFrame:
    """word: the runs, those whose hash with the document's id ``one_in`` divides without one code point; a null id never edits."""
    hashed = words.withColumn("_h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary")))
    at = F.pmod(F.col("_h"), F.length("run")).cast("int")
    return hashed.select(F.when(F.pmod(F.col("_h"), F.lit(one_in)) == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run")).alias("word"))


def counts(words: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    n = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.when(F.col("n") >= least_count, F.length("word") >= least_chars))


def near(vocabulary: DataFrame) -> DataFrame:
    """word, n, other, other_n of all pairs at distance one, in both directions; from (word, n)."""
    cut = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    keys = vocabulary.filter("word <> ''").select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), cut))).alias("key"))
    a, b = keys.alias("a"), keys.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.word") != F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1))
    return met.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))


def forms(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n_near, form, form_n of the words that have near ones; form and form_n are null where none is frequent enough."""
    best = near(vocabulary).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), F.col("other").alias("w"))).alias("best"))
    enough = -F.col("best.k") >= ratio * F.col("n")
    return best.select("word", "n_near", F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.k")).alias("form_n"))


def roots(links: DataFrame, folder: str) -> DataFrame:
    """word, root of every word that has a form; each round follows twice as many steps as the one before."""
    spark = links.sparkSession
    at, path = 0, f"{folder}/roots0"
    now = saved(links.select("word", F.col("form").alias("root")), path)
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        at, before = at + 1, path
        path = f"{folder}/roots{at}"
        now = saved(step, path)
        dropped(spark, before)
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n) without repeated words."""
    folder = scratch_dir(counted.sparkSession)
    vocabulary = saved(counted.select("word", F.col("n").cast("long").alias("n")), f"{folder}/vocabulary")
    linked = saved(forms(vocabulary, ratio), f"{folder}/forms")
    last = roots(linked.filter("form is not null"), folder)
    whole = vocabulary.join(linked, "word", "left").join(last, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op11(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return variants(counts(edited(runs(own))))


#: DuckDB SQL for ``op11``: crc32 over the bytes by its table, near words by the distance of all pairs.
ORACLE = r"""
with recursive tab as (
  select list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from (select unnest(range(256)) as i)
), r as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents
), u as (
  select doc_id, run, count(*) as k, hex(doc_id || ':' || run) as hx from r where length(run) >= 6 group by doc_id, run
), h as (
  select doc_id, run, k, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(hx), 2), lambda i: CAST((strpos('0123456789ABCDEF', substr(hx, i, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hx, i + 1, 1)) - 1 as bigint))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h from u, tab
), e as (
  select case when h % 199 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, k from h
), v as (
  select word, cast(sum(k) as bigint) as n, translate(word, 'àáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞß', '!"#$%&()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[]^_{|}') as one
  from e group by word having sum(k) >= 5 and length(word) >= 6
), p as (
  select a.word, a.n, b.word as other, b.n as other_n from v a join v b on a.word <> b.word and abs(length(a.word) - length(b.word)) <= 1 and levenshtein(a.one, b.one) = 1
), f as (
  select word, count(*) as n_near, first(other order by other_n desc, other) as best, max(other_n) as best_n, any_value(n) as n from p group by word
), l as (select word, best as form, best_n as form_n from f where best_n >= 5 * n
), c as (
  select word, form as root, 1 as step from l union all select c.word, l.form, step + 1 from c join l on l.word = c.root
), s as (select word, arg_max(root, step) as root from c group by word)
select v.word, l.form, coalesce(s.root, v.word) as root, v.n, cast(coalesce(f.n_near, 0) as bigint) as n_near, l.form_n
from v left join f on f.word = v.word left join l on l.word = v.word left join s on s.word = v.word
"""
