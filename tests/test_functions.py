"""Value cases of the scalar functions."""

import textwrap

import pytest
from pyspark.sql import functions as F

from tessera.functions import citations as C
from tessera.functions import substance as S
from tessera.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("url", "cite"),
    [
        ("https://x/policy-manual/volume-1-part-e-chapter-10", "1 USCIS-PM E.10"),
        ("https://x/policy-manual/volume-12-part-d-chapter-2", "12 USCIS-PM D.2"),
        ("https://x/policy-manual/table-of-contents", None),
        (None, None),
        ("", None),
    ],
)
def test_url_citation(spark, url, cite):
    assert one(spark, url, C.url_citation) == cite


def test_court_label(spark):
    assert one(spark, "ca8", C.court_label) == "8th Cir."
    assert one(spark, "xyz", C.court_label) == "xyz"
    assert one(spark, None, C.court_label) is None
    assert len(C.COURTS) == 18
    assert len(C.CASE_NAMES) == 26


@pytest.mark.parametrize(
    ("row", "cite"),
    [
        (("opinion_7252751_de_dandrade_v_us_dept_of_homeland_sec", "x", "367 F. Supp. 3d 174", "nysd", "2019-03-01"), "De Dandrade v. U.S. Department of Homeland Security, 367 F. Supp. 3d 174 (S.D.N.Y. 2019)"),
        (("none", "Caption", None, None, None), "Caption"),
        (("none", None, None, "ca2", None), "Unknown case (2d Cir.)"),
        (("none", "", "", "", "2001"), "Unknown case (2001)"),
    ],
)
def test_case_citation(spark, row, cite):
    cols = ("source_id", "title", "citation", "court_id", "date")
    df = spark.createDataFrame([row], ", ".join(f"{c} string" for c in cols))
    assert df.select(C.case_citation(*map(F.col, cols)).alias("r")).first().r == cite


@pytest.mark.parametrize(("numbers", "suffix"), [([3], ", n.3"), ([3, 4], ", nn.3, 4"), ([], ""), (None, "")])
def test_footnote_suffix(spark, numbers, suffix):
    assert one(spark, numbers, C.footnote_suffix, "array<int>") == suffix


def test_format_citation_is_never_empty(spark):
    schema = "source_id string, source_type string, title string, citation string, court_id string, date string, url string, footnote_numbers array<int>"
    df = spark.createDataFrame([(None,) * 8, (None, "uscis", None, None, None, None, None, [2])], schema)
    got = [r.r for r in df.select(C.format_citation({c: F.col(c) for c in df.columns}).alias("r")).collect()]
    assert got == ["Unknown case", "USCIS Policy Manual, n.2"]


@pytest.mark.parametrize(("title", "label"), [("Volume 12 - Citizenship", "Volume 12"), ("Volume 1 - x", "Volume 1"), ("Part I – Deferred", "Part I"), ("Volume 7 x", "Volume 7"), ("Appendix", None), (None, None)])
def test_toc_label(spark, title, label):
    assert one(spark, title, T.toc_label) == label


@pytest.mark.parametrize(("raw", "name"), [("Volume 12 - Part D", "volume_12_part_d"), ("  A__b ", "a_b"), ("!!", ""), ("Déjà", "dj")])
def test_safe_filename(spark, raw, name):
    assert one(spark, raw, T.safe_filename) == name


@pytest.mark.parametrize(("status", "category"), [(403, "forbidden"), (404, "not_found"), (429, "rate_limited"), (599, "server_error"), (500, "server_error"), (400, "client_error")])
def test_status_category(spark, status, category):
    assert one(spark, status, T.status_category, "int") == category


@pytest.mark.parametrize(("header", "seconds"), [("30", 30), (None, None), ("Wed, 21 Oct 2015 07:28:00 GMT", None), ("-5", 0)])
def test_retry_after(spark, header, seconds):
    assert one(spark, header, T.retry_after) == seconds


def test_backoff(spark):
    got = [r.r for r in spark.range(1, 6).select(T.backoff(F.col("id"), 5, 60).alias("r")).collect()]
    assert got == [5, 10, 20, 40, 60]


@pytest.mark.parametrize(("raw", "clean"), [("a ( b ) , c ;  d", "a (b), c; d"), (" x\n\ty ", "x y"), ("see [ 1 ] .", "see [1].")])
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, T.clean_text) == clean


def test_spacing(spark):
    assert one(spark, "- ​ INA 342 ", lambda c: T.tidy_spacing(T.normalize_unicode(c))) == "- INA 342"
    assert one(spark, "“curly” – dash", T.normalize_unicode) == "“curly” – dash"


def test_join_wrapped(spark):
    assert one(spark, ["a ben-", "eficiary", "", "  pays  more"], T.join_wrapped, "array<string>") == "a ben-eficiary pays more"


def test_head_key(spark):
    assert one(spark, " Page:  3 of 18 ", T.head_key) == one(spark, "Page: 13 of 18", T.head_key) == "Page: # of #"


def test_strip_overlap(spark):
    f = lambda prev, text: spark.createDataFrame([(prev, text)], "p string, t string").select(T.strip_overlap(F.col("p"), F.col("t")).alias("r")).first().r
    assert f("x" * 10, "x" * 10) == "x" * 10
    assert f("q" * 41, "q" * 41) == ""
    assert f("p" * 40, "p" * 40 + " tail") == "p" * 40 + " tail"
    assert f("y" * 801, "y" * 801 + "!") == "y!"
    assert f(None, "text") == "text"


@pytest.mark.parametrize(
    ("note", "kept"),
    [
        ("See INA 319(a). See Pub. L. 106-386 (PDF) (October 28, 2000). See Part H, Chapter 6, Widows [12 USCIS-PM H.6].", False),
        ("Officers should interview applicants twice.", True),
        ("See 8 CFR 316.5(c)(1).", False),
        ("Id.", False),
        ("", False),
    ],
)
def test_substance(spark, note, kept):
    assert one(spark, note, S.is_substantive) is kept


def test_check_citations(spark):
    rows = [(1, "Yes [S1], [S2 and S9], detail[ed] [8 CFR 1] [S1].", ["S1", "S2", "S3"]), (2, "", []), (3, "[S10] [S2]", ["S2", "S10"])]
    got = {r.answer_id: r for r in C.check_citations(spark.createDataFrame(rows, "answer_id int, answer string, known array<string>")).collect()}
    assert (got[1].cited, got[1].unknown, got[1].uncited, got[1].malformed, got[1].citations) == (["S1", "S2"], ["S9"], ["S3"], ["8 CFR 1"], 3)
    assert (got[2].cited, got[2].citations) == ([], 0)
    assert got[3].cited == ["S2", "S10"]


def test_link_labels(spark):
    df = spark.createDataFrame([("a [S1] [S2] [S10] [S3] [x]", [("S1", "https://u/(1)", 'The "A"'), ("S2", "", "B"), ("S10", "https://c", "see [S1]")])], "t string, s array<struct<label:string,url:string,citation:string>>")
    got = df.select(C.link_labels(F.col("t"), F.col("s")).alias("r")).first().r
    assert got == "a [[S1]](<https://u/(1)> \"The 'A'\") [S2] [[S10]](<https://c> \"see [S1]\") [S3] [x]"


def test_wrap(spark):
    texts = ["", "one", "word " * 60, "x" * 120 + " y " + "z" * 94 + " w", "a\n b\tc", None]
    for width in (10, 94):
        got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.wrap(F.col("t"), width).alias("w")).collect()
        for r in got:
            want = None if texts[r.i] is None else textwrap.wrap(" ".join(texts[r.i].split()), width, break_long_words=False, break_on_hyphens=False)
            assert r.w == want
