"""Whether a footnote says something of its own: citation shapes and function words don't count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Citation shapes, stripped in this order, in either case.
CITATION_PATTERNS = (
    r"\bsee\s+[^\[]{0,250}?\[\d+\s+USCIS-PM[^\]]*\]",
    r"\[\d+\s+USCIS-PM[^\]]*\]",
    r"\b\d+\s+USCIS-PM\s+[A-Z][\w.()]*",
    r"\bMatter\s+of\s+[^\[]{0,90}?\d+\s+I&N\s+Dec\.[^)]*\)",
    r"\b(?:In\s+re|Petition\s+of|Application\s+of)\s+[^\[]{0,60}?\d+\s+[A-Z][\w.’' ]{1,22}\s*\d+[^)]*\)",
    r"\b[A-Z][\w'’.\-]*(?:\s+[A-Z][\w'’.\-]*)*\s+v\.\s+[^\[]{0,90}?\d+\s+[A-Z][\w.’' ]{1,22}\s*\d+[^)]*\)",
    r"\b\d+\s+F\.?\s?Supp\.?\s?\d?d?\s+\d+",
    r"\b\d+\s+I&N\s+Dec\.\s+[\d,\s]+",
    r"\bINA\s+\d+[\w().\-]*",
    r"\b\d+\s+CFR\s+(?:Part\s+)?\d+[\w().\-]*",
    r"\b\d+\s+U\.?\s?S\.?\s?C\.?\s*§*\s*\d+[\w().\-]*",
    r"\bPub\.\s*L\.\s*(?:No\.\s*)?[\d\-]+",
    r"\b\d+\s+Stat\.\s+[\d,\s]+",
    r"\b\d+\s+FR\s+[\d,\-\s]+",
    r"\bH\.R\.\s*REP\.[^.]{0,40}",
    r"\b(?:\d+\s+)?U\.S\.C\.C\.A\.N\.\s*\d+",
    r"\bch\.\s*\d+",
    r"\bTitle\s+\d+\s+of\s+the\s+Code\s+of\s+Federal\s+Regulations",
    r"\bDHS\s+Delegation\s+[\d.]+",
    r"(?:\b[A-Z][\w’'\-]*\s+){1,6}Act(?:\s+of\s+\d{4})?",
    r"\b(?:Volume|Part|Chapter|Section|Subsection|Appendix)\s+[\w\d]+(?:,\s*[^,.\[]+)*",
    r"(?:\b[A-Z][\w’'\-]*\s+){1,7}\(Form\s+[A-Z]{1,2}-\d+\w*\)",
    r"\(Form\s+[A-Z]{1,2}-\d+\w*\)",
    r"\bForm\s+[A-Z]{1,2}-\d+\w*",
    r"\bInstructions\s+for\s+Form\b",
    r"\bFee Schedule\b",
    r"\bfor\s+(?:more\s+|further\s+|additional\s+)?(?:information|guidance|discussion|details)\b",
    r"\bwebpage\b",
    r"\bAlso\s+known\s+as\b",
    r"\b(?:quoting|citing)\b",
    r"\(PDF\)",
    r"\((?:[A-Z][a-z]+ \d{1,2}, )?\d{4}\)",
    r"\bas amended\b",
    r"\bavailable at\b",
    r"\b(?:See also|See, e\.g\.,|See, for example,|But see|See generally|See|Id\.|Cf\.|Compare|accord)\b",
)
# Words that don't count.
FUNCTION_WORDS = (
    "a an the of in to at on and or also see former for more information instance example "
    "s no id cf generally compare but this that these those is are was were be been it its "
    "as by with from which who whom such under provided known additional about"
).split()
WORD_FLOOR = 3


def content_words(text: Column) -> Column:
    """The note's own words, lower-cased, in order."""
    for p in CITATION_PATTERNS:
        text = F.regexp_replace(text, "(?iU)" + p, " ")
    words = F.split(F.lower(F.regexp_replace(text, r"(?U)[^\w\s]", " ")), r"(?U)\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(FUNCTION_WORDS))


def is_substantive(text: Column) -> Column:
    return F.size(content_words(text)) >= WORD_FLOOR
