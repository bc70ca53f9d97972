"""Longest-prefix join: which of many openings a text begins with, the longest one deciding.

Instead of trying every opening of a group on every text, a text is cut at the lengths that
its group's openings have, and the cuts are joined with the openings as equal keys. The
lengths of a group travel as one array, so a text gives one row for each length that
occurs and fits, never one for each opening. Equal openings are one key whatever they say:
the join is with distinct openings.

Lengths count code points. Of openings of equal length, that is equal openings, the
smallest value wins, null last. The empty opening is a prefix of every text; null texts, groups and
openings match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_prefix(rows: DataFrame, openings: DataFrame, group: str, text: str, opening: str = "opening", value: str = "value") -> DataFrame:
    """``rows`` with ``opening`` and ``value`` of the longest opening (group, opening, value) that ``text`` starts with; null where there is none.

    ``rows`` must not have columns of these names, nor any that begins with ``_``.
    """
    own = openings.filter(F.col(group).isNotNull() & F.col(opening).isNotNull()).groupBy(group, opening).agg(F.min(value).alias(value))
    # lengths differ far less than openings: one array for a group
    lengths = own.groupBy(F.col(group).alias("_group")).agg(F.array_sort(F.collect_set(F.length(opening))).alias("_lengths"))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    fits = F.filter("_lengths", lambda n: n <= F.length("_text"))
    cut = numbered.select("_row", F.col(group).alias("_group"), F.col(text).alias("_text")).join(lengths, "_group").select("_row", "_group", "_text", F.explode(fits).alias("_n"))
    cut = cut.select("_row", "_group", F.substring("_text", F.lit(1), F.col("_n")).alias("_opening"), "_n")
    met = cut.join(own.select(F.col(group).alias("_group"), F.col(opening).alias("_opening"), F.col(value).alias("_value")), ["_group", "_opening"])
    best = met.groupBy("_row").agg(F.max_by(F.struct("_opening", "_value"), "_n").alias("_best"))
    return numbered.join(best, "_row", "left").select(*(rows[c] for c in rows.columns), F.col("_best._opening").alias(opening), F.col("_best._value").alias(value))
