"""Footnotes and alerts: parse definitions, place them after their paragraphs, resolve alert verdicts.

The joins (:func:`parse`, :func:`marks`, :func:`orphans`, :func:`unplaced`) work on
line tables; :func:`place` folds one document's lines in its own row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.substance import is_substantive
from tessera.functions.text import normalize_unicode, strip, tidy_spacing
from tessera.operators import markup, pages
from tessera.operators.prefixes import longest_prefix

# The line shapes.
HEADING = r"^#+\s+Footnotes?\s*$"
DEFINITION = r"^\[\^\s*(\d+)\]\s*(.*)$"
MARK = r"\s*\[(\d+)\]"
ALERT = "[ALERT] "


def split_block(lines: DataFrame) -> DataFrame:
    """Adds ``part``: body before the document's first footnote heading, heading, definition after it. (source_id, line_no, line)"""
    first = lines.filter(F.col("line").rlike(HEADING)).groupBy("source_id").agg(F.min("line_no").alias("_at"))
    return lines.join(first, "source_id", "left").withColumn("part", F.when(F.col("_at").isNull() | (F.col("line_no") < F.col("_at")), "body").when(F.col("line_no") == F.col("_at"), "heading").otherwise("definition")).drop("_at")


def parse(definitions: DataFrame) -> DataFrame:
    """source_id, number, note, is_first of definition lines: continuation lines join the note above, the first of a number wins."""
    order = Window.partitionBy("source_id").orderBy("line_no")
    n = F.regexp_extract("line", DEFINITION, 1)
    grouped = definitions.withColumn("_n", n).withColumn("_g", F.sum(F.when(F.col("_n") != "", 1).otherwise(0)).over(order)).filter("_g > 0").filter(F.col("line").rlike(r"(?U)\S"))
    text = F.when(F.col("_n") != "", F.regexp_extract("line", DEFINITION, 2)).otherwise(strip(F.col("line")))
    notes = grouped.groupBy("source_id", "_g").agg(F.max(F.nullif("_n", F.lit(""))).cast("int").alias("number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))), lambda x: x["t"]), " ").alias("note"))
    rn = F.row_number().over(Window.partitionBy("source_id", "number").orderBy("_g"))
    return notes.withColumn("is_first", rn == 1).select("source_id", F.col("_g").cast("long").alias("position"), "number", "note", "is_first")


def marks(body: DataFrame) -> DataFrame:
    """source_id, line_no, position, number of every mark in body lines."""
    return body.select("source_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(r"\[(\d+)\]"), 1)).alias("position", "number")).withColumn("number", F.col("number").cast("int"))


def orphans(body: DataFrame, notes: DataFrame) -> DataFrame:
    """Marks without a definition, distinct."""
    return marks(body).join(notes.filter("is_first"), ["source_id", "number"], "left_anti").select("source_id", "number").distinct()


def unplaced(body: DataFrame, notes: DataFrame) -> DataFrame:
    """Definitions that no mark points at."""
    return notes.filter("is_first").join(marks(body), ["source_id", "number"], "left_anti").select("source_id", "number", "note")


_NOTE_MAP, _MORE = "map<int,string>", "array<struct<position:bigint,number:int,note:string,keep:boolean>>"


def note_maps(notes: DataFrame, keep: Callable[[Column], Column] = is_substantive) -> DataFrame:
    """Per document of :func:`parse` output: notes and kept (number to text), and ``more``, the repeated definitions in order.

    The predicate is evaluated once for each note, below the aggregation.
    """
    judged = notes.withColumn("keep", keep(F.col("note")))
    pick = lambda cond: F.map_from_entries(F.collect_list(F.when(cond, F.struct("number", "note"))))
    return judged.groupBy("source_id").agg(pick(F.col("is_first")).alias("notes"), pick(F.col("is_first") & F.col("keep")).alias("kept"), F.array_sort(F.collect_list(F.when(~F.col("is_first"), F.struct("position", "number", "note", "keep")))).alias("more"))


def place(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """lines, orphans, n_kept and n_dropped of (source_id, body: array<string>, notes, kept: maps of number to text).

    Kept notes follow the line that cites them, in mark order, once for each mark;
    marks without a kept note are removed with the white space before them.
    """
    before, after = mark.split(r"(\d+)")
    none = F.create_map().cast(_NOTE_MAP)
    own = docs.withColumns({"_notes": F.map_keys(F.coalesce("notes", none)), "_kept": F.coalesce("kept", none)})
    numbers = lambda line: F.transform(F.regexp_extract_all(line, F.lit(mark), 1), lambda n: n.cast("int"))
    is_kept = lambda n: F.map_contains_key("_kept", n)

    def one(line: Column) -> Column:
        gone = F.array_distinct(F.filter(numbers(line), lambda n: ~is_kept(n)))
        clean = F.aggregate(gone, line, lambda acc, n: F.regexp_replace(acc, F.concat(F.lit(before), n.cast("string"), F.lit(after)), F.lit("")))
        notes = F.transform(F.filter(numbers(line), is_kept), lambda n: F.concat(F.lit("[^ "), n.cast("string"), F.lit("] "), F.element_at("_kept", n)))
        return F.concat(F.array(clean), notes)

    every = F.flatten(F.transform("body", numbers))
    known = lambda n: F.array_contains("_notes", n)
    return own.select(
        "source_id",
        F.flatten(F.transform("body", one)).alias("lines"),
        F.array_sort(F.array_distinct(F.filter(every, lambda n: ~known(n)))).alias("orphans"),
        F.size(F.filter(every, is_kept)).cast("long").alias("n_kept"),
        F.size(F.filter(every, lambda n: known(n) & ~is_kept(n))).cast("long").alias("n_dropped"),
    )


def resolve_alerts(lines: DataFrame, verdicts: DataFrame) -> DataFrame:
    """source_id, line_no, line, unreviewed of (source_id, line_no, line) under (source_id, opening, verdict).

    The longest opening that an alert starts with decides (of equal ones the smallest verdict); drops go, the marker is
    consumed, and alerts without a verdict stay and are marked as unreviewed.
    """
    text = F.substring("line", len(ALERT) + 1, 1 << 30)
    is_alert = F.startswith("line", F.lit(ALERT))
    own = lines.withColumn("_alert", is_alert).withColumn("_text", F.when(is_alert, text).otherwise(F.col("line")))
    best = longest_prefix(own.filter("_alert").select("source_id", "line_no", F.col("_text").alias("alert")), verdicts, "source_id", "alert", value="verdict").select("source_id", "line_no", "verdict")
    out = own.join(best, ["source_id", "line_no"], "left").filter("not (_alert and coalesce(verdict, '') = 'drop')")
    return out.select("source_id", "line_no", F.col("_text").alias("line"), (F.col("_alert") & F.col("verdict").isNull()).alias("unreviewed"))


def process_chapter(raw: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cleaned text and report of raw chapters (source_id, text): alerts, block split, notes, placement, parked duplicates, spacing."""
    lines = raw.select("source_id", F.posexplode(F.split(normalize_unicode(F.col("text")), "\n")).alias("line_no", "line"))
    kept = resolve_alerts(lines, verdicts)
    parts = split_block(kept)
    notes = parse(parts.filter("part = 'definition'"))
    body = parts.filter("part = 'body'").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("body"), F.array_sort(F.collect_list(F.when(F.col("unreviewed"), F.col("line")))).alias("unreviewed_alerts"))
    joined = body.join(note_maps(notes), "source_id", "left")
    placed = place(joined).join(joined.select("source_id", "unreviewed_alerts", F.coalesce("more", F.array().cast(_MORE)).alias("more")), "source_id")
    parked = F.filter("more", lambda x: x["keep"])
    text = F.transform(F.concat("lines", F.transform(parked, lambda x: F.concat(F.lit("[^ "), x["number"].cast("string"), F.lit("] "), x["note"]))), tidy_spacing)
    return placed.select(
        "source_id",
        F.array_join(text, "\n").alias("text"),
        "unreviewed_alerts",
        F.col("orphans").alias("orphan_markers"),
        F.transform("more", lambda x: x["number"]).alias("duplicate_definitions"),
        (F.col("n_kept") + F.size(parked)).alias("footnotes_kept"),
        (F.col("n_dropped") + F.size("more") - F.size(parked)).alias("footnotes_dropped"),
    )


def keep_rate(reports: DataFrame) -> DataFrame:
    """One row of :func:`process_chapter` reports: chapters, kept, dropped and the share kept (null without notes)."""
    total = reports.agg(F.count(F.lit(1)).alias("chapters"), F.coalesce(F.sum("footnotes_kept"), F.lit(0)).cast("long").alias("kept"), F.coalesce(F.sum("footnotes_dropped"), F.lit(0)).cast("long").alias("dropped"))
    return total.withColumn("share", F.when(F.col("kept") + F.col("dropped") > 0, F.round(F.col("kept") / (F.col("kept") + F.col("dropped")), 6)))


#: Marks of opinions in XML until they are placed: digits between two private-use characters.
OPINION_MARK = "\ue000(\\d+)\ue001"
_REPORT = ("orphan_marks", "unplaced_footnotes", "footnotes_kept", "footnotes_dropped", "lines")


def process_opinions(payloads: DataFrame) -> DataFrame:
    """source_id, text, orphan_marks, unplaced_footnotes, footnotes_kept, footnotes_dropped, lines, error of raw opinions (source_id, xml_harvard, plain_text).

    XML where there is any, else page-layout text. All notes are kept; those that no mark points at follow at the
    end, by number. Without either the error is ``no_content``; XML errors are the extractor's. Rows with an error have no text.
    """
    some = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    own = payloads.select(F.col("source_id").cast("string").alias("source_id"), some("xml_harvard").alias("xml"), some("plain_text").alias("plain"))
    read = markup.opinions(own.filter("xml <> ''"))
    none = F.create_map().cast(_NOTE_MAP)
    good = read.filter("error is null").select("source_id", "body", F.coalesce("notes", none).alias("notes")).withColumn("kept", F.col("notes"))
    used = F.flatten(F.transform("body", lambda x: F.transform(F.regexp_extract_all(x, F.lit(OPINION_MARK), 1), lambda n: n.cast("int"))))
    left = good.select("source_id", "notes", F.array_sort(F.array_except(F.map_keys("notes"), used)).alias("unplaced_footnotes"))
    placed = place(good, OPINION_MARK).join(left, "source_id")
    parked = F.transform("unplaced_footnotes", lambda n: F.concat(F.lit("[^ "), n.cast("string"), F.lit("] "), F.element_at("notes", n)))
    lines = F.transform(F.concat(F.transform("lines", lambda x: F.regexp_replace(x, OPINION_MARK, " [$1]")), parked), tidy_spacing)
    xml = placed.select("source_id", lines.alias("l"), F.col("orphans").alias("orphan_marks"), "unplaced_footnotes", (F.col("n_kept") + F.size("unplaced_footnotes")).cast("long").alias("footnotes_kept"), F.col("n_dropped").alias("footnotes_dropped"))
    paged = pages.clean(own.filter("xml = '' and plain <> ''").select("source_id", F.col("plain").alias("text")))
    empty = F.array().cast("array<int>")
    text = paged.select("source_id", F.transform("lines", tidy_spacing).alias("l"), empty.alias("orphan_marks"), empty.alias("unplaced_footnotes"), F.col("footnotes").cast("long").alias("footnotes_kept"), F.lit(0).cast("long").alias("footnotes_dropped"))
    done = xml.unionByName(text).select("source_id", F.array_join("l", "\n").alias("text"), *_REPORT[:-1], F.size("l").alias("lines"), F.lit(None).cast("string").alias("error"))
    bad = read.filter("error is not null").select("source_id", "error").union(own.filter("xml = '' and plain = ''").select("source_id", F.lit("no_content")))
    return done.unionByName(bad, allowMissingColumns=True)
