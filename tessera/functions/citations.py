"""Citations as Column expressions: derive them from metadata, and check them in answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Court ids and the abbreviations that citations use.
COURTS = {
    "ca2": "2d Cir.", "ca3": "3d Cir.", "ca5": "5th Cir.", "ca6": "6th Cir.", "ca7": "7th Cir.", "ca8": "8th Cir.", "ca9": "9th Cir.", "ca11": "11th Cir.",
    "cadc": "D.C. Cir.", "dcd": "D.D.C.", "mad": "D. Mass.", "mdd": "D. Md.", "nyed": "E.D.N.Y.", "nysd": "S.D.N.Y.", "nywd": "W.D.N.Y.", "oknd": "N.D. Okla.", "txwd": "W.D. Tex.", "vaed": "E.D. Va.",
}
# Normalised case names by document.
CASE_NAMES = {
    "opinion_1035207_mazen_shweika_v_dept_of_homeland_security": "Shweika v. Department of Homeland Security",
    "opinion_10846400_joseph_ebu_v_uscis": "Ebu v. USCIS",
    "opinion_1980523_gizzo_v_immigration_naturalization_service": "Gizzo v. INS",
    "opinion_2391590_rico_v_immigration_naturalization_service": "Rico v. INS",
    "opinion_4243031_seanlim_yith_v_kirstjen_nielsen": "Yith v. Nielsen",
    "opinion_4416725_emad_haroun_v_us_dept_of_homeland_security": "Haroun v. U.S. Department of Homeland Security",
    "opinion_4565506_moya_v_united_states_department_of_homeland_security": "Moya v. U.S. Department of Homeland Security",
    "opinion_4574859_northwest_immigrant_rights_project_v_united_states_citizenship_and_immigration_services": "Northwest Immigrant Rights Project v. USCIS",
    "opinion_4766320_gunay_miriyeva_v_uscis": "Miriyeva v. USCIS",
    "opinion_625607_gonzalez_v_secretary_of_department_of_homeland_security": "Gonzalez v. Secretary of Department of Homeland Security",
    "opinion_6349504_donnelly_v_carrp": "Donnelly v. CARRP",
    "opinion_7223114_rivera_v_us_citizenship_immigration_services": "Rivera v. USCIS",
    "opinion_7230471_hassan_v_johnson": "Hassan v. Johnson",
    "opinion_7231393_martinez_v_johnson": "Martinez v. Johnson",
    "opinion_7238503_iqbal_v_secretary_us_department_of_homeland_security": "Iqbal v. Secretary, U.S. Department of Homeland Security",
    "opinion_7239370_dos_reis_v_mccleary": "Dos Reis v. McCleary",
    "opinion_7245087_shawuti_v_us_citizenship_immigration_services": "Shawuti v. USCIS",
    "opinion_7252016_dilone_v_nielsen": "Dilone v. Nielsen",
    "opinion_7252103_yemer_v_us_citizenship_immigration_servs": "Yemer v. USCIS",
    "opinion_7252751_de_dandrade_v_us_dept_of_homeland_sec": "De Dandrade v. U.S. Department of Homeland Security",
    "opinion_7798290_hafils_akpovi_v_david_douglas": "Akpovi v. Douglas",
    "opinion_7798407_elvis_leonel_morfa_diaz_v_acting_secretary_department_of_homeland_security": "Morfa Diaz v. Acting Secretary, Department of Homeland Security",
    "opinion_821040_anthony_kariuki_v_tracy_tarango": "Kariuki v. Tarango",
    "opinion_8412814_aljabri_v_holder": "Aljabri v. Holder",
    "opinion_8709858_dar_v_olivares": "Dar v. Olivares",
    "opinion_9781657_muhanad_alhasani_v_secretary_united_states_department_of_homeland_sec": "Al-Hasani v. Secretary, U.S. Department of Homeland Security",
}

_URL = r"/policy-manual/volume-(\d+)-part-([a-z])-chapter-(\d+)"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def url_citation(url: Column) -> Column:
    """``12 USCIS-PM A.1`` of a chapter URL; null for other URLs and null."""
    volume, part, chapter = (F.regexp_extract(F.coalesce(url, F.lit("")), _URL, i) for i in (1, 2, 3))
    return F.when(volume != "", F.concat(volume, F.lit(" USCIS-PM "), F.upper(part), F.lit("."), chapter))


def court_label(court_id: Column) -> Column:
    """The court's abbreviation; unknown ids as they are."""
    return F.coalesce(_lookup(COURTS, court_id), court_id)


def case_name(source_id: Column, title: Column) -> Column:
    return F.coalesce(_lookup(CASE_NAMES, source_id), _some(title), F.lit("Unknown case"))


def case_citation(source_id: Column, title: Column, citation: Column, court_id: Column, date: Column) -> Column:
    """Name, reporter if any, and court and year in parentheses if any."""
    inside = F.concat_ws(" ", _some(court_label(court_id)), _some(F.substring(date, 1, 4)))
    named = F.concat_ws(", ", case_name(source_id, title), _some(citation))
    return F.when(inside != "", F.concat(named, F.lit(" ("), inside, F.lit(")"))).otherwise(named)


def footnote_suffix(numbers: Column) -> Column:
    """``, n.3`` or ``, nn.3, 4`` from an array of numbers; empty for none and null."""
    n = F.size(F.coalesce(numbers, F.array().cast("array<int>")))
    return F.when(n == 0, "").when(n == 1, F.concat(F.lit(", n."), F.array_join(numbers.cast("array<string>"), ", "))).otherwise(F.concat(F.lit(", nn."), F.array_join(numbers.cast("array<string>"), ", ")))


def format_citation(row: dict[str, Column], with_footnotes: bool = True) -> Column:
    """A chunk's citation, never null or empty, by its source type."""
    policy = F.coalesce(url_citation(row["url"]), _some(row["title"]), F.lit("USCIS Policy Manual"))
    case = case_citation(row["source_id"], row["title"], row["citation"], row["court_id"], row["date"])
    base = F.when(row["source_type"] == "uscis", policy).otherwise(case)
    return F.concat(base, footnote_suffix(row["footnote_numbers"])) if with_footnotes else base


_GROUPS = r"([\p{L}\p{N}]?)\[([^\]]*)\](?=([\p{L}\p{N}]?))"


def check_citations(answers: DataFrame) -> DataFrame:
    """cited, unknown, uncited, malformed and citations of (answer_id, answer, known: array of labels).

    Labels in any bracket group count; the text of a group without one is malformed
    unless it is glued to a letter or digit. Arrays are distinct and ordered;
    ``citations`` counts mentions of known labels with repeats.
    """
    before, inside, after = (F.regexp_extract_all("answer", F.lit(_GROUPS), i) for i in (1, 2, 3))
    zipped = F.arrays_zip(before.alias("b"), inside.alias("i"), after.alias("a"))
    labels = F.flatten(F.transform(inside, lambda x: F.regexp_extract_all(x, F.lit(r"S(\d+)"), 1)))
    known = F.transform("known", lambda k: F.substring(k, 2, 10))
    named = lambda xs: F.transform(F.array_sort(F.transform(F.array_distinct(xs), lambda x: x.cast("bigint"))), lambda x: F.concat(F.lit("S"), x.cast("string")))
    return answers.withColumns({"_z": zipped, "_l": labels, "_k": known}).select(
        "answer_id",
        named(F.array_intersect("_l", "_k")).alias("cited"),
        named(F.array_except("_l", "_k")).alias("unknown"),
        named(F.array_except("_k", "_l")).alias("uncited"),
        F.array_sort(F.array_distinct(F.transform(F.filter("_z", lambda g: ~g["i"].rlike(r"S\d") & (g["b"] == "") & (g["a"] == "")), lambda g: F.regexp_replace(g["i"], r"(?U)^\s+|\s+$", "")))).alias("malformed"),
        F.size(F.filter("_l", lambda x: F.array_contains("_k", x))).cast("long").alias("citations"),
    )


def link_labels(text: Column, sources: Column) -> Column:
    """``[S1]`` to a link with the citation as its title; ``sources``: array of struct(label, url, citation).

    Unknown labels and sources without URL stay as they are.
    """
    usable = F.filter(sources, lambda s: F.coalesce(s["url"], F.lit("")) != "")
    # private marks keep inserted text out of later replacements
    opened = F.regexp_replace(text, r"\[(S\d+)\]", "$1")
    linked = F.aggregate(
        usable,
        opened,
        lambda acc, s: F.replace(acc, F.concat(F.lit(""), s["label"], F.lit("")), F.concat(F.lit("[["), s["label"], F.lit("]](<"), s["url"], F.lit('> "'), F.replace(s["citation"], F.lit('"'), F.lit("'")), F.lit('")'))),
    )
    return F.regexp_replace(linked, "(S\\d+)", "[$1]")


def courts_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COURTS.items()), "court_id string, label string")
