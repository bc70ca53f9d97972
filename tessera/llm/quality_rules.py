"""Quality rules as a short-circuit cascade, with DataFrame functions only.

:func:`statistics` counts what the rules look at, :func:`measured` times each rule on a
sample and counts what it rejects there, :func:`ordered` puts the rules that reject most
for a second of work first, and :func:`cascade` runs them as one CASE expression: a rule
is evaluated only for rows that all rules before it let pass. A row is kept if no rule
rejects it, so the order costs or saves time and never changes the verdict.

Words are ``[^\\x20\\x09-\\x0D]+``, lines are split at ``\\n`` and count where they hold a
word. Words in repeated windows: all windows of three words are hashed, the hashes with
their places in the low bits are sorted, and equal neighbours are compared by their
words; should two different windows of a text agree in the bits that are compared, that
text is counted again by the words themselves, so the count is exact.

Null texts have no words, like empty ones: all counts are 0 and the base rule rejects
them. Rows are judged one by one, so repeated rows and null ids stay as they are, and
columns other than doc_id and text are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, saved, scratch_dir

#: Rows of the sample on which rules are timed; it sets their order only.
SAMPLE_ROWS = 4_000
#: Bits of a packed window that hold its place in the text.
PLACE_BITS = 24
_WHITE, _WHITE_RE = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+"
#: Words a document needs, and the share of its words in repeated windows that it may have.
LEAST_WORDS, MOST_REPEATED = 50, 50


class Rule(NamedTuple):
    """``rejects``: a boolean Column over text and the columns of :func:`statistics`."""

    name: str
    rejects: Column


class Measure(NamedTuple):
    name: str
    seconds: float  # for a row
    rejected: float  # share of the sample's rows


def _covered(places: Column) -> Column:
    """Words under three-word windows that begin at ``places``, ascending."""
    widths = F.zip_with(places, F.slice(places, F.lit(2), F.size(places)), lambda a, b: F.least(F.lit(3).cast("long"), F.coalesce(b - a, F.lit(3).cast("long"))))
    return F.aggregate(widths, F.lit(0).cast("long"), lambda total, x: total + x)


def _by_words() -> Column:
    """Words in repeated windows, by the windows' own words."""
    at = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.struct(F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("s"), i.cast("long").alias("i")))
    windows = F.sort_array(at)
    # one binding for what the two neighbours are looked up in
    again = F.transform(F.array(windows), lambda p: F.filter(p, lambda x, i: (x["s"] == F.get(p, i - 1)["s"]) | (x["s"] == F.get(p, i + 1)["s"])))
    places = F.transform(again, lambda d: F.sort_array(F.transform(d, lambda x: x["i"])))
    return F.get(F.transform(places, _covered), F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text and, all long: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Every step is a projection of the step before, so nothing is split or sorted twice.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(_WHITE))
    words = docs.select("doc_id", "text", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WHITE_RE)).alias("_w"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_WHITE)) != "")
    counted = words.select(
        "doc_id",
        "text",
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    mask = (1 << PLACE_BITS) - 1
    whole = F.slice("_h", F.lit(1), F.greatest(F.col("n_words").cast("int") - 2, F.lit(0)))
    packed = F.transform(whole, lambda x, i: F.shiftleft(F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")))
    kept = ("doc_id", "text", "_w", "n_words", "word_chars", "n_symbols")
    placed = counted.select(*kept, F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.sort_array(packed).alias("_p"))
    kept = (*kept, "n_lines", "n_dup_lines")
    same = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), PLACE_BITS) == 0
    place = lambda x: x.bitwiseAND(F.lit(mask).cast("long"))
    paired = placed.select(*kept, "_p", F.size(F.filter("_p", lambda x, i: same(x, F.get("_p", i + 1)))).alias("_again"))
    word = lambda x, k: F.get("_w", place(x).cast("int") + k)
    differ = lambda x, y: (word(x, 0) != word(y, 0)) | (word(x, 1) != word(y, 1)) | (word(x, 2) != word(y, 2))
    at = F.sequence(F.lit(0), F.size("_p") - 2)
    clash = F.exists(at, lambda i: same(F.get("_p", i), F.get("_p", i + 1)) & differ(F.get("_p", i), F.get("_p", i + 1)))
    places = F.sort_array(F.transform(F.filter("_p", lambda x, i: same(x, F.get("_p", i - 1)) | same(x, F.get("_p", i + 1))), place))
    marked = paired.select(*kept, "_again", F.when((F.col("_again") > 0) & (F.col("n_words") <= mask), F.when(~clash, places)).alias("_places"))
    repeated = F.when((F.col("_again") == 0) & (F.col("n_words") <= mask), F.lit(0).cast("long")).when(F.col("_places").isNotNull(), _covered(F.col("_places"))).otherwise(_by_words())
    return marked.select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeated.alias("n_repeat_words"))


def base_failed() -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rules() -> list[Rule]:
    """The rules of the verdict; counts are compared as integers."""
    n, text = F.col("n_words"), F.coalesce("text", F.lit(""))
    count = lambda regex: F.regexp_count(text, F.lit(regex)).cast("long")
    return [
        Rule("base", base_failed()),
        Rule("mean_word", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 16 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n),
        Rule("repeated_lines", (F.col("n_lines") >= 3) & (100 * F.col("n_dup_lines") > 50 * F.col("n_lines"))),
        Rule("capitals", 2 * count(r"[A-Z]") > F.col("word_chars")),
        Rule("exclamations", 10 * count(r"[!?]{2,}") > 3 * n),
        Rule("digits", 2 * count(r"[0-9]") > F.col("word_chars")),
        Rule("letters", 2 * count(r"\p{L}+") < n),
        Rule("ellipses", (F.col("n_lines") >= 3) & (100 * count(r"(?m)(\.\.\.|\x{2026})[\x20\x09-\x0D]*$") > 50 * F.col("n_lines"))),
        Rule("bullets", (F.col("n_lines") >= 3) & (100 * count(r"(?m)^[\x20\x09]*[-*\x{2022}][\x20\x09]") > 90 * F.col("n_lines"))),
    ]


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows from all over the table (one more pass over it; give :func:`cascade` a sample of your own to save that)."""
    n = docs.count()
    return docs.sample(fraction=min(1.0, rows / n), seed=17) if n > rows else docs


def measured(sample: DataFrame, some: list[Rule], runs: int = 2) -> list[Measure]:
    """Seconds for a row and share rejected of each rule, over a ``sample`` that is at hand (saved, not computed anew)."""
    rows = sample.count()

    def timed(rejects: Column) -> tuple[float, int]:
        best, n = float("inf"), 0
        for _ in range(runs):
            start = time.perf_counter()
            n = sample.agg(F.count_if(rejects)).first()[0]
            best = min(best, time.perf_counter() - start)
        return best, n

    idle, _ = timed(F.length("text") < 0)
    out = []
    for rule in some:
        seconds, n = timed(rule.rejects)
        # a rule on counts alone costs next to nothing, which is not the same as nothing
        out.append(Measure(rule.name, max(seconds - idle, 1e-4) / max(rows, 1), n / max(rows, 1)))
    return out


def ordered(some: list[Rule], measures: list[Measure]) -> list[Rule]:
    """Rules by rejection per second, most first; ties by cost, then name."""
    by = {m.name: m for m in measures}
    return sorted(some, key=lambda r: (-by[r.name].rejected / by[r.name].seconds, by[r.name].seconds, r.name))


def cascade(counted: DataFrame, some: list[Rule], sample: DataFrame | None = None) -> DataFrame:
    """``counted`` (of :func:`statistics`) with failed_rule: the first rule of the cascade that rejects a row, null where none does.

    With a ``sample`` of the same columns the rules are ordered by it, else they run as given.
    """
    for rule in (chain := ordered(some, measured(sample, some)) if sample is not None else list(some)):
        if not rule.name:
            raise ValueError("a rule needs a name")
    if not chain:
        return counted.withColumn("failed_rule", F.lit(None).cast("string"))
    failed = F.when(chain[0].rejects, chain[0].name)
    for rule in chain[1:]:
        failed = failed.when(rule.rejects, rule.name)
    return counted.withColumn("failed_rule", failed)


def op12(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = f"{scratch_dir(docs.sparkSession)}/rules_sample"
    sample = saved(statistics(sample_of(own)), folder)
    judged = cascade(statistics(own), rules(), sample)
    dropped(docs.sparkSession, folder)
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(*base, base_failed().alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))


#: DuckDB SQL for all columns of ``op12``: the definitions, without an order of rules.
ORACLE = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i from d),
g as (select r, i, w, lead(w) over o as w2, lead(w, 2) over o as w3 from w window o as (partition by r order by i)),
m as (select r, i, count(*) over (partition by r, w, w2, w3) > 1 as again from g where w3 is not null),
rep as (select r, count(distinct i + k) as n from m, (select unnest([0, 1, 2]) as k) where again group by r),
ws as (select r, count(*) as n, sum(length(w)) as chars from w group by r),
l as (select r, count(*) as n, count(distinct line) as u from (select r, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
s as (
  select d.r, doc_id, text, coalesce(ws.n, 0) as n_words, cast(coalesce(chars, 0) as bigint) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(coalesce(l.n - l.u, 0) as bigint) as n_dup_lines, coalesce(l.n, 0) as n_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from d left join ws using (r) left join l using (r) left join rep using (r)
), b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    word_chars < 2 * n_words or word_chars > 16 * n_words or 10 * n_symbols > 3 * n_words or (n_lines >= 3 and 100 * n_dup_lines > 50 * n_lines)
    or 2 * len(regexp_extract_all(text, '[A-Z]')) > word_chars or 10 * len(regexp_extract_all(text, '[!?]{2,}')) > 3 * n_words
    or 2 * len(regexp_extract_all(text, '[0-9]')) > word_chars or 2 * len(regexp_extract_all(text, '\p{L}+')) < n_words
    or (n_lines >= 3 and 100 * len(regexp_extract_all(text, '(?m)(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')) > 50 * n_lines)
    or (n_lines >= 3 and 100 * len(regexp_extract_all(text, '(?m)^[\x20\x09]*[-*\x{2022}][\x20\x09]')) > 90 * n_lines) as rejected
  from s
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept from b
"""
