"""Inline fixtures: rows for Spark, and the same rows as DuckDB VALUES. Tests run the queries on them; registered queries read the relations of the same names that ``derived`` makes of the tables."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.citations import CASE_NAMES
from tessera.plans import derived

_FIRST_CASE = next(iter(CASE_NAMES))

#: name: (schema, rows)
FIXTURES: dict[str, tuple[str, list[tuple]]] = {
    "urls": ("id int, url string", [(1, "https://www.uscis.gov/policy-manual/volume-12-part-a-chapter-1"), (2, "/policy-manual/volume-1-part-e-chapter-10"), (3, "https://www.uscis.gov/policy-manual/table-of-contents"), (4, None), (5, "/policy-manual/volume-7-part-B-chapter-2"), (6, "")]),
    "cases": (
        "id int, source_id string, source_type string, title string, citation string, court_id string, date string, url string, footnote_numbers array<int>",
        [
            (1, _FIRST_CASE, "caselaw", "Caption v. Caption", "723 F.3d 710", "ca6", "2013-07-25", None, [3]),
            (2, "opinion_10846400_joseph_ebu_v_uscis", "caselaw", "Joseph Ebu v. USCIS", None, "ca6", "2025-01-02", None, []),
            (3, "unmapped", "caselaw", "Some v. Caption", "1 F.4th 2", "zz9", None, None, [3, 4]),
            (4, "unmapped", "caselaw", None, None, None, None, None, None),
            (5, "unmapped", "caselaw", "", "", "", "", None, [1]),
            (6, "chapter", "uscis", "Volume / Part / Chapter", None, None, None, "/policy-manual/volume-12-part-d-chapter-2", [7]),
            (7, "chapter", "uscis", "Volume / Part / Chapter", None, None, None, "/other", None),
            (8, "chapter", "uscis", None, None, None, None, None, []),
            (9, "x", None, "No Type", None, "cadc", "1999", None, [1, 2, 3]),
        ],
    ),
    "titles": ("id int, title string", [(1, "Volume 12 - Citizenship and Naturalization"), (2, "Volume 1 - General"), (3, "Part I – Deferred Action"), (4, "Volume 12 - x"), (5, "Appendices"), (6, None), (7, "See Volume 12"), (8, "Part  B - Fees"), (9, "Volumes 3"), (10, "")]),
    "names": ("id int, name string", [(1, "Volume 12 - Part D: Chapter 2"), (2, "  a__b  c!!"), (3, "___"), (4, "Déjà vu"), (5, ""), (6, None), (7, "A-B_C d")]),
    "spacing": ("id int, line string", [(1, "- ​ INA 342"), (2, "a  \t b   c "), (3, " x "), (4, ""), (5, "plain"), (6, "soft­hyphen"), (7, None)]),
    "dirty": ("id int, raw string", [(1, "a ( b ) , c ;  d"), (2, "see [ 1 ] . Then"), (3, "  x\n\ty  "), (4, "ok"), (5, ""), (6, "( ( a"), (7, None)]),
    "dollars": ("id int, md string", [(1, "$1,170 and $640"), (2, "## A\ntext # no\n# B"), (3, "none"), (4, ""), (5, "a\n### b $1")]),
    "statuses": ("id int, status int", [(1, 403), (2, 404), (3, 429), (4, 500), (5, 503), (6, 599), (7, 400), (8, 418), (9, 302)]),
    "headers": ("id int, header string", [(1, "30"), (2, None), (3, "Wed, 21 Oct 2015 07:28:00 GMT"), (4, "-5"), (5, "0"), (6, "abc"), (7, "12.5")]),
    "attempts": ("attempt int, base int, maximum int", [(n, 5, 60) for n in range(1, 7)] + [(n, 15, 120) for n in range(1, 5)]),
    "answers": (
        "answer_id int, answer string, known array<string>",
        [
            (1, "Yes [S1]. Also [S2, S3] and [S9].", ["S1", "S2", "S3", "S4"]),
            (2, "It was detail[ed] in [8 CFR 316.5] and \"[s]ole procedure\" [S2][S2].", ["S1", "S2"]),
            (3, "", ["S1"]),
            (4, "No citations at all.", []),
            (5, "[S10] before [S2], [see note], [ ] and a[b]c, [S2 and INA 319]", ["S2", "S10"]),
            (6, "nested [a [S1] b] end [S12]", ["S1"]),
            (7, "[S1]x and y[S3]", ["S1", "S2"]),
        ],
    ),
    "link_sources": ("label string, url string, citation string", [("S1", "https://a/(1)", 'The "A" case'), ("S2", "", "B"), ("S10", "https://c", "C")]),
    "overlaps": (
        "id int, previous string, body string",
        [
            (1, "zzz " + "ab" * 30, "ab" * 30 + " and more"),
            (2, "nothing shared", "a text of its own that is a bit longer than forty characters"),
            (3, "x" * 10, "x" * 10),
            (4, "q" * 41, "q" * 41),
            (5, "p" * 40, "p" * 40 + " tail"),
            (6, "y" * 801, "y" * 801 + "!"),
            (7, None, "no previous text but long enough to be looked at here"),
            (8, "the end of the first chunk is here, carried over whole.", "the end of the first chunk is here, carried over whole.\nNext line"),
        ],
    ),
    "note_lines": (
        "source_id string, line_no int, line string",
        [
            ("a", 0, "First paragraph [1] and [2]."), ("a", 1, "Second [3] paragraph [9]."), ("a", 2, "## Footnotes"), ("a", 3, "[^ 1] See INA 319(a)."), ("a", 4, "[^ 2] The officer reviews residence evidence carefully."), ("a", 5, "(A) continued here"), ("a", 6, "[^ 1] A second note with number one repeated."), ("a", 7, "[^3] Third"), ("a", 8, "[^ 5] never marked"),
            ("b", 0, "No notes here."), ("b", 1, "Only body [1]."),
            ("c", 0, "# Footnote"), ("c", 1, "stray line before"), ("c", 2, "[^  3] three"), ("c", 3, ""), ("c", 4, "  more "),
        ],
    ),
    "headed": (
        "doc_id long, text string",
        [
            (1, "intro line\n## A\ntext of a\n### B\nmore [^ 3] here\n#### C\ndeep\n### D\nafter\n## E\nend"),
            (2, "## One\n" + "\n".join(f"line {i} has a few words, no more." for i in range(60)) + "\n### Two\n" + "\n".join("short" for _ in range(90)) + "\n#### Four\nx\n## Three\ny"),
            (3, "He said \"go.\" " + "word " * 300 + ". End of it; then (more.) " + "other words here. " * 90),
            (4, "##\n## \nunder an empty heading\n#### skips a level\nz\n# not a section\n##### nor this"),
            (5, None), (6, ""), (7, " \n\t\n"), (8, "[^ 1] one\n[^2] two\n[^  30] three"),
        ],
    ),
    "notes": (
        "id int, note string",
        [
            (1, "See INA 319(a). See Pub. L. 106-386 (PDF) (October 28, 2000). See Part H, Chapter 6, Widows [12 USCIS-PM H.6]."),
            (2, "The officer must weigh evidence of continuous residence before deciding."),
            (3, "See 8 CFR 316.5(c)(1)."), (4, "Id."), (5, ""), (6, "See Matter of Lee, 11 I&N Dec. 649 (BIA 1966). Applicants remain eligible while abroad."),
            (7, "For more information, see Form N-400 and the Fee Schedule webpage."), (8, "Officers should interview applicants twice."),
        ],
    ),
    "alert_lines": (
        "source_id string, line_no int, line string",
        [("d", 0, "[ALERT] USCIS has updated Volume 7 today"), ("d", 1, "Body"), ("d", 2, "[ALERT] On June 5 the court ruled"), ("d", 3, "[ALERT] Something new"), ("e", 0, "[ALERT] USCIS has updated Volume 7 today"), ("e", 1, "[ALERT] USCIS long opening here")],
    ),
    "verdicts": ("source_id string, opening string, verdict string", [("d", "USCIS has updated", "drop"), ("d", "On June 5", "keep"), ("e", "USCIS", "drop"), ("e", "USCIS long opening", "keep")]),
    "paged": (
        "source_id string, text string",
        [
            ("p1", "\f".join(f"No. 22-3053 Ebu v. USCIS Page {i}\n\nBody of page {i} ends with a hy-\nphen and goes on.\n{'1 First note text' if i == 2 else '2 Second note' if i == 3 else 'last words'}\nmore of it\n_____\n  {i}" for i in range(1, 6))),
            ("p2", "\n".join(f" {i}   pleading line {i}" for i in range(1, 20))),
            ("p3", "one page only\nwith text"),
            ("p4", "\n\n\f\n"),
        ],
    ),
    "hits": (
        "qid int, rank int, source_id string, chunk_index int, chunk_total int",
        [(1, 1, "a", 1, 4), (1, 2, "a", 2, 4), (1, 3, "b", 0, 1), (1, 4, "a", 3, 4), (2, 1, "b", 0, 1), (2, 2, "a", 0, 4), (2, 3, "a", 2, 4)],
    ),
    "hit_chunks": ("source_id string, chunk_index int, text string", [("a", 0, "alpha zero"), ("a", 1, "alpha one " + "c" * 50), ("a", 2, "c" * 50 + " alpha two"), ("a", 3, "alpha three"), ("b", 0, "beta")]),
    "records": (
        "id string, probe boolean, answer string, degraded_category string, citations int, unknown array<string>, malformed array<string>, off_target_cites array<string>, cited array<string>, sources int, anchors int, anchors_in_cited int, anchors_in_context int, refused_verbatim boolean, truncated boolean, expected_retrieved array<string>, expected_cited array<string>, seconds double, thoughts int",
        [
            ("q1", False, "a [S1]", None, 3, [], [], ["S2"], ["S1", "S2"], 8, 2, 1, 2, False, False, ["d1"], ["d1"], 1.5, 10),
            ("q2", False, None, "timeout", 0, [], [], [], [], 8, 3, 0, 1, False, False, ["d2"], [], 0.0, None),
            ("q3", False, "no", None, 0, ["S9"], ["see x"], [], [], 8, 1, 0, 0, True, True, [], [], 2.25, None),
            ("p1", True, "probe", None, 2, ["S8"], [], [], ["S1"], 8, 0, 0, 0, False, False, [], [], 3.0, 7),
            ("q4", False, "I refuse", None, 1, [], [], [], ["S1"], 5, 0, 0, 0, True, False, ["d1", "d3"], ["d3"], 4.0, 5),
            ("q5", False, None, "rate_limited", 0, [], [], [], [], 0, 1, 0, 0, False, False, [], [], 0.0, None),
            ("q6", False, None, "timeout", 0, [], [], [], [], 0, 0, 0, 0, False, False, [], [], 0.0, None),
        ],
    ),
    "config_left": ("field string, value string", [("model", "m1"), ("k", "8"), ("thinking", "low"), ("run", "1"), ("only_left", "x"), ("none", None)]),
    "config_right": ("field string, value string", [("model", "m1"), ("k", "5"), ("thinking", "low"), ("run", "2"), ("only_right", "y"), ("none", None)]),
    "run_left": ("id string, anchors_in_cited int, off_target int, citations int, thought_tokens int", [("q1", 1, 0, 3, 10), ("q2", 2, 1, 4, 0), ("q3", 0, 0, 0, 5)]),
    "run_right": ("id string, anchors_in_cited int, off_target int, citations int, thought_tokens int", [("q1", 2, 0, 2, 11), ("q3", 0, 2, 1, 5), ("q9", 1, 1, 1, 1)]),
    "selection": ("id int, opinion_id long, barrier array<string>, why string", [(1, 10, ["delay"], "x"), (2, 11, [], "x"), (3, 12, ["delay", "character"], ""), (4, None, ["delay"], "y"), (5, 13, ["financial"], None), (6, 14, None, "z")]),
    "fetched": ("id int", [(1,), (4,), (9,)]),
    "searches": ("name string, expected long", [("a", 3), ("b", 5), ("c", 0), ("d", 7)]),
    "search_counts": ("name string, found long", [("a", 3), ("b", 6), ("c", 0)]),
    "tagged": ("source_id string, source_type string, barrier string, court_id string, text string", [("s1", "caselaw", "delay, procedural", "ca2", "t"), ("s2", "caselaw", "procedural", "bia", "t"), ("s3", "uscis", None, None, "t"), ("s4", "caselaw", "character", "ca9", " \n "), ("s5", "caselaw", "delayed", "olc", "t"), ("s6", "caselaw", "delay", "cadc", None)]),
    "keys": (
        "id string, expected array<string>, acceptable array<string>",
        [("q1", ["d1", "d2"], ["d3"]), ("q2", ["d1"], ["d1"]), ("q3", ["d9"], []), ("q1", ["d2"], [])],
    ),
    "payloads": (
        "source_id string, xml_harvard string, plain_text string",
        [
            ("x1", "<casebody><opinion><author>X, J.</author><p>Held<footnotemark>2</footnotemark> so, and<footnotemark>7</footnotemark> more.</p><footnote label=\"2\"><p>2. Kept note.</p></footnote><footnote label=\"5\"><p>5. Nobody points here.</p></footnote></opinion></casebody>", "ignored"),
            ("x2", "", "One page  only\nwith te-\nxt"), ("x3", None, " \n "), ("x4", "<broken", None), ("x5", "<casebody/>", "not used"), ("x6", None, None),
        ],
    ),
    "attempt_log": (
        "url string, attempt int, status int, retry_after string, body string, error string",
        [("a", 1, 503, "7", None, None), ("a", 2, 200, None, "<p>x</p>", None), ("b", 1, 429, "30", None, None), ("c", 1, None, None, None, "timeout"), ("c", 2, None, None, None, None), ("d", 1, 404, "-3", "gone", None), (None, 1, 200, None, "lost", None)],
    ),
    "scraped": ("stem string, volume_title string, part_title string, chapter_title string, chapter_url string, scraped_date string", [("v1_a_1", "Volume 1", "Part A", "Chapter 1", "/policy-manual/volume-1-part-a-chapter-1", "2024-05-06"), ("v1_a_2", "Volume 1", None, "Chapter 2", None, None)]),
    "opinion_files": ("stem string, id int, absolute_url string", [("opinion_10_x", 10, "/opinion/10/x/"), ("opinion_11_y", 11, None), ("opinion_99_z", 99, "/opinion/99/z/")]),
    "selected": ("opinion_id int, case_name string, court_id string, date_filed string, citation string, barrier array<string>", [(10, "X v. Y", "ca2", "2001-02-03", None, ["delay", "character"]), (11, "Z v. Y", "dcd", "1999-01-01", "1 F.3d 2", []), (12, "Unfetched", "ca9", "2000-01-01", None, ["delay"])]),
    "page_reports": ("page_id int, unhandled array<string>", [(3, ["video", "svg"]), (1, ["video"]), (2, []), (1, ["video"])]),
    "asked": ("qid int, question string", [(1, "Question 1?"), (2, "Question 2?"), (3, "Nothing found?")]),
    "grid": (
        "file string, k int, thinking string, answer string, citations int, unknown array<string>, malformed array<string>",
        [("b.json", 8, "low", "a", 3, [], ["m"]), ("b.json", 8, "low", None, None, None, None), ("a.json", 8, "low", "b", 1, ["S9", "S8"], []), ("c.json", 5, "high", "", 0, [], None)],
    ),
    "reach": ("qid int, anchor string", [(1, "alpha one"), (1, "beta"), (1, "absent"), (2, "alpha zero"), (2, "QUESTION")]),
    "verdict_reports": ("source_id string, footnotes_kept long, footnotes_dropped long", [("a", 3, 1), ("b", 0, 0), ("c", 2, 2)]),
    "question_keys": (
        "id string, source_id string, anchors array<string>, acceptable array<string>",
        [("q1", "s1", ["absent", "shared"], ["s1"]), ("q1", "zz", [], ["s1"]), ("q2", "s2", ["two three", "one"], []), ("q4", "s1", ["one"], ["s9"])],
    ),
    "question_rows": ("id string", [("q1",), ("q2",), ("q2",), ("q3",), ("q4",)]),
    "key_documents": ("source_id string, text string", [("s1", "one shared text"), ("s2", "one two three shared"), ("s3", None)]),
    "key_chunks": ("source_id string, text string", [("s1", "one shared text"), ("s2", "one two"), ("s2", "three shared")]),
    "local_responses": ("id int, response string", [(1, '{"response":" Yes [S1]. ","done":true,"prompt_eval_count":4,"eval_count":2}'), (2, '{"response":"","done":true}'), (3, "oops"), (4, None), (5, '{"response":"cut"}')]),
    "responses": (
        "id int, response string",
        [
            (1, '{"candidates":[{"content":{"parts":[{"text":"thinking","thought":true},{"text":"Answer [S1]."}]},"finishReason":"STOP"}],"usageMetadata":{"promptTokenCount":5}}'),
            (2, '{"candidates":[]}'), (3, '{"candidates":[{"content":{"parts":[]},"finishReason":"MAX_TOKENS"}]}'), (4, "not json"), (5, None),
            (6, '{"candidates":[{"content":{"parts":[{"text":"Not covered by the retrieved sources. Sorry"}]},"finishReason":"MAX_TOKENS"}]}'),
        ],
    ),
}


#: Folder of the tables that :func:`frame` reads; none for the typed rows.
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


@contextlib.contextmanager
def over_tables(folder: str) -> Iterator[None]:
    """Inside, :func:`frame` gives the relations over the tables of ``folder``."""
    token = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(token)


def used(sql: str) -> set[str]:
    """The fixtures whose rows stand in ``sql``."""
    return {name for name in FIXTURES if values(name) in sql}


def sql_over_tables(sql: str) -> str:
    """``sql`` with relations over the tables in place of typed rows."""
    for name in used(sql):
        sql = sql.replace(values(name), derived.duck(name))
    return sql


def frame(spark: SparkSession, name: str) -> DataFrame:
    if folder := _FOLDER.get():
        return derived.over(spark, folder, name)
    schema, rows = FIXTURES[name]
    return spark.createDataFrame(rows, schema)


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


_KINDS = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]"}


def values(name: str) -> str:
    """A DuckDB subquery with the rows of a fixture."""
    schema, rows = FIXTURES[name]
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    body = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    cols = ", ".join(f'CAST("{n}" AS {_KINDS[k]}) AS "{n}"' for n, k in fields)
    names = ", ".join(f'"{n}"' for n, _ in fields)
    return f"(SELECT {cols} FROM (VALUES {body}) AS v({names}))"
