"""Scalar text functions as Column expressions; all stay in the JVM.

``(?U)`` makes Java's character classes Unicode-aware where the semantics need it.
Nulls give null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes of the chunker and of windows.
TOKEN_CEILING, TOKEN_TARGET, TOKEN_OVERLAP, MIN_FLUSH = 256, 220, 40, 80
OVERLAP_MIN, OVERLAP_MAX, OVERLAP_TAIL = 40, 800, 1600

TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def strip(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def safe_filename(c: Column) -> Column:
    """Lower case, spaces to underscores, only a-z, 0-9 and single inner underscores."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(c), " ", "_"), "[^a-z0-9_]", "")
    return F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_+|_+$", "")


def normalize_unicode(c: Column) -> Column:
    """Drop format characters (category Cf)."""
    return F.regexp_replace(c, r"\p{Cf}", "")


def tidy_spacing(c: Column) -> Column:
    """Runs of two and more spaces or tabs to one space; trimmed."""
    return strip(F.regexp_replace(c, "[ \\t]{2,}", " "))


def clean_text(c: Column) -> Column:
    """Collapse white space; none before ``, . ; : ) ]`` nor after ``( [``."""
    one = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(one, r" ([,.;:)\]])", "$1"), r"([(\[]) ", "$1"))


def toc_label(c: Column) -> Column:
    """``Volume N`` or ``Part X`` at the start of a heading, single-spaced; null if there is none."""
    found = F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?U)^(Volume\s+\d+|Part\s+[A-Z])\b", 1), r"(?U)\s+", " ")
    return F.when(found != "", found)


def token_count(c: Column) -> Column:
    """Words and marks of a text; null counts 0."""
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN_PATTERN)), F.lit(0))


def sentences(c: Column, keep_closers: bool = False) -> Column:
    """Array of sentences: after ``. ! ? ; :`` and closing marks, at white space. Closing marks go with the break, or stay."""
    stop, close = "[.!?;:]", r"""["'”’)\]]*"""
    marked = F.regexp_replace(c, rf"({stop}{close})\s+" if keep_closers else rf"({stop}){close}\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def heading(c: Column) -> Column:
    """struct(level, title) of a line of two to four ``#`` and white space; the title may be empty. Null for other lines."""
    shape = r"(?U)^(#{2,4})\s+(.*)$"
    marks = F.regexp_extract(c, shape, 1)
    return F.when(marks != "", F.struct(F.length(marks).alias("level"), strip(F.regexp_extract(c, shape, 2)).alias("title")))


def footnote_numbers(c: Column) -> Column:
    """Numbers of all ``[^ N]`` definitions in a text, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[\^\s*(\d+)\]"), 1), lambda n: n.cast("int"))


def head_key(c: Column) -> Column:
    """A line's shape: trimmed, white space collapsed, digits to ``#``."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"(?U)\s+", " "), r"\d+", "#")


def join_wrapped(lines: Column) -> Column:
    """An array of hard-wrapped lines as one run of prose; a line that ends in a hyphen joins without a space."""
    kept = F.filter(F.transform(lines, strip), lambda s: s != "")
    glued = F.regexp_replace(F.array_join(kept, "\n"), "-\n", "-")
    return F.regexp_replace(F.regexp_replace(glued, "\n", " "), r"(?U)\s{2,}", " ")


def plain(c: Column) -> Column:
    """Escape ``$``, and ``#`` at line starts, for a Markdown view."""
    return F.regexp_replace(F.replace(c, F.lit("$"), F.lit("\\$")), r"(?m)^(#+)", r"\\$1")


def strip_overlap(previous: Column, text: Column) -> Column:
    """Remove from ``text`` its longest prefix of 41 to 800 characters that occurs in the last 1600 of ``previous``.

    If a prefix occurs there, so do all shorter ones, so the longest is found by halving.
    """
    tail = F.substring(previous, F.greatest(F.length(previous) - OVERLAP_TAIL + 1, F.lit(1)), F.lit(OVERLAP_TAIL))
    top, least = F.least(F.length(text), F.lit(OVERLAP_MAX)), F.lit(OVERLAP_MIN + 1)
    has = lambda n: F.contains(tail, F.substring(text, F.lit(1), n))
    between = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        return F.when(acc["hi"] - acc["lo"] <= 1, acc).when(has(mid), between(mid, acc["hi"])).otherwise(between(acc["lo"], mid))

    steps = F.sequence(F.lit(1), F.lit(OVERLAP_MAX.bit_length()))
    found = F.when((top >= least) & has(least), F.aggregate(steps, between(least, top + 1), halve, lambda acc: acc["lo"]))
    return F.when(previous.isNull() | found.isNull(), text).otherwise(F.regexp_replace(F.substring(text, found + 1, F.length(text)), r"(?U)^\s+", ""))


def status_category(c: Column) -> Column:
    """Category of an HTTP status."""
    return F.when(c == 429, "rate_limited").when(c == 403, "forbidden").when(c == 404, "not_found").when(c >= 500, "server_error").otherwise("client_error")


def retry_after(c: Column) -> Column:
    """Seconds of a Retry-After header, at least 0; null if absent or no integer."""
    n = c.try_cast("int")
    return F.when(n.isNotNull(), F.greatest(n, F.lit(0)))


def backoff(attempt: Column, base: int | Column, maximum: int | Column) -> Column:
    """Doubling wait, capped."""
    wide = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(wide(base) * F.pow(F.lit(2), attempt - 1), wide(maximum)).cast("long")


def wrap(c: Column, width: int = 94) -> Column:
    """Array of lines of whole words, as many as fit into ``width`` characters; longer words stand alone. Null for null."""
    kind = "array<string>"
    last = lambda acc: F.element_at(acc, -1)
    fits = lambda acc, w: (F.size(acc) > 0) & (F.length(F.try_element_at(acc, F.lit(-1))) + 1 + F.length(w) <= width)
    step = lambda acc, w: F.when(fits(acc, w), F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.concat(last(acc), F.lit(" "), w))).otherwise(F.array_append(acc, w)).cast(kind)
    return F.aggregate(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""), F.array().cast(kind), step)
