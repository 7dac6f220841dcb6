"""Regular expressions, in the dialect that Java and RE2 share (inline flags, index groups).

Fixed values: the language of statutes that the engine recognises.
"""

CHAPTER = r"^(?:CHAPTER|Chapter)\s+([IVXLCDM\dA-Z-]+)\b(?:\s*[-:.—]\s*(.*))?$"
SECTION_START = r"^(\d+[A-Z]?)\.\s*(.*)$"
BRACKET = r"^\s*\[?\(\s*([A-Za-z]+|\d+)\s*\)\s*"
BRACKET_RUN = r"^(?:\s*\[?\(\s*(?:[A-Za-z]+|\d+)\s*\)\s*)+"
BRACKET_TOKEN = r"\(\s*([A-Za-z]+|\d+)\s*\)"
FOOTNOTE_REF = r"^\s*(\d+[a-z]?)\s*\[\s*\("
FOOTNOTE_REF_RUN = r"(?i)^(?:\s*\d+[a-z]?\s*\[\s*)+"
EMPTY_FOOTNOTE_REF = r"(?i)^\s*(\d+[a-z]?)\s+\[\s*\]\s*$"
EXPLANATION = r"(?i)^(Explanation(?:\s+(?:\d+|[A-Z]\b))?\.?)\s*[-:.—]?\s*(.*)$"
PROVISO = r"(?i)^(Provided(?:\s+further)?\s+that)\b[:,]?\s*(.*)$"
ILLUSTRATION = r"(?i)^(Illustration(?:\s+\d+)?\.?)\s*[-:.—]?\s*(.*)$"
FOOTNOTE_START = r"(?i)^(\d+[a-z]?)\.\s+((?:Sub\.|Sub-sections?|Words?|Clauses?|Items?|Omtt\.|Inserted|Ins\.|Omitted|Prior to|Explanation|Proviso).+)$"
PAGE = r"^\s*(?:PAGE|<!--\s*Page)\s+(\d+)\s*(?:-->)?\s*$"
HEADING = r"^(#{1,6})\s+(.*)$"
LIST_ITEM = r"^\s*[-*+]\s+"
NUMERIC_LIST_ITEM = r"^\s*[-*+]\s+\d+\."
BOLD_LINE = r"^\*\*.*\*\*$"
POSITIONED = r"^\[x=\s*([-\d.]+)\]\s*\[y=\s*([-\d.]+)\]\s*\[font=\s*([-\d.]+)\]\s*\[bold=(True|False)\]\s*(.*)$"
PARENT_BRIDGE = r"(?i)^and\s+as\s+(?:reduced|further\s+adjusted)\s+by\b"
LOWER_ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx")
UPPER_ROMAN = tuple(x.upper() for x in LOWER_ROMAN)
BANNERS = ("Income Tax Department", "Ministry of Finance, Government of India")
DEDUCTION_MARKERS = ("Entire amount.", "Minimum of—", "Amount being minimum of—", "Compensation received.", "Amount received, as restricted", "The commuted value shall be", "Rs. 500000.")

# Mentions, one generator a kind
RELATION_KINDS = {
    "external_act": r"(?i)section\s+\d+[\w()]*\s+of\s+the\s+([A-Z][A-Za-z\s,]+(?:Act|Scheme|Rules),\s*\d{4}(?:\s*\(\d+\s+of\s+\d{4}\))?)",
    "section": r"(?i)\bsections?\s+(\d+[A-Z]?(?:\(\d+\))?(?:\([a-z]+\))?(?:\([ivx]+\))?(?:\([A-Z]+\))?(?:\s*(?:and|or|to|,)\s*\d+[A-Z]?(?:\(\d+\))?)*)",
    "subsection": r"(?i)\bsub-sections?\s*(\(\d+\)(?:\s*(?:and|or|to|,)\s*\(\d+\))*|\d+[\w()]*)",
    "clause": r"(?i)\b(?:sub-)?clauses?\s*(\([a-z0-9]+\)(?:\([ivx]+\))?(?:\([A-Z]+\))?(?:\s*(?:and|or|to|,)\s*\([a-z0-9]+\))*)",
    "item": r"(?i)\bitems?\s*(\([ivx]+\)|\([A-Z]+\)|\d+)",
    "chapter": r"(?i)\bChapter\s+([IVXLCDM\dA-Z-]+)\b",
    "part": r"(?i)\bPart\s+([A-Z](?:\s*,\s*[A-Z])*(?:\s+and\s+this\s+Part)?)",
    "schedule": r"(?i)\bSchedules?\s+([IVXLCDM\d+]+\b(?:\s*\(\s*Table:\s*Sl\.\s*Nos?\.\s*[\w\d.,\s]+\s*\))?)",
    "table": r"(?i)\b(?:Table:\s*Sl\.\s*Nos?\.\s*[\w\d.,\s]+?|\bTable\b|column\s+[A-Z]\s+of\s+the\s+said\s+Table)\b",
}

# Located references, in order of precedence: a span inside one of an earlier kind is not reported
_TAIL = r"(?:\s*(?:to|and|or|-)\s*(?:\d*\[)?(?:\(\s*)?([a-z0-9]+)\)?\]?)?"
_FIRM_TAIL = r"(?:\s*(?:to|and|or|-)\s*(?:\d*\[)?(?:\(\s*[a-z0-9]+\s*\)|\d+[a-z]?\b)\]?)?"
LOCATED_KINDS = {
    "para_schedule": r"(?i)\bparagraph\s+(\d+)(?:\s*\(\s*(\d+)\s*\)(?:\s*(?:and|or|to|,)\s*\(\s*(\d+)\s*\))?)?(?:\s+of\s+Part\s+([A-Z]))?(?:\s+of\s+Schedules?\s+([IVXLCDM\d]+)\b)?",
    "schedule": r"(?i)(?:\bPart\s+([A-Z])\s+of\s+)?\bSchedules?\s+([IVXLCDM\d]+)\b",
    "subsection": r"(?i)\bsub-?sections?\s*\(\s*(\d+[A-Za-z]?)\s*\)(?:\s*\(\s*(?:\d*\[)?([a-z0-9]+)\]?\s*\))?",
    "section": r"(?i)\bsections?\s+(\d+[A-Za-z]?)(?:\s*\(\s*(\d+[A-Za-z]?)\s*\))?(?:\s*\(\s*(?:\d*\[)?([a-z0-9]+)\]?\s*\))?(?:\s*\(\s*([ivx]+)\s*\))?",
    "clause": r"(?i)\b(?:sub-)?clauses?\s*\(\s*(?:\d*\[)?([a-z0-9]+)\]?\s*\)(?:\s*\(\s*([ivx]+)\s*\))?",
}


def located(kind: str, parity: bool) -> str:
    """The pattern of a located kind. parity: the tail also takes a bare word after to/and/or; else a number only."""
    tail = "" if kind in ("para_schedule", "schedule") else _TAIL if parity else _FIRM_TAIL
    return LOCATED_KINDS[kind] + tail


NUM_TOKEN = r"(?:\d+[A-Z]?|\([a-z0-9]+\))"
EXPRESS = rf"(?i)\b(sections?|clauses?|sub-sections?|sub-clauses?|items?)\s+({NUM_TOKEN}(?:\s*(?:,|\band\b|\bor\b|to)\s*{NUM_TOKEN})*)(?:\s+of\s+(?:section\s+)?(\d+[A-Z]?))?"
EXTERNAL = r"(?i)(?:section|clause)\s+(\d+(?:\(\d+\))?)\s+of\s+the\s+([A-Z][A-Za-z0-9\s,\(\)]+?\s*Act,\s*\d{4})"
RELATIVE = r"(?i)\b(?:under|in|of|for\s+the\s+purposes?\s+of)\s+this\s+(chapter|section|sub-section|clause|sub-clause|item)\b"

# Classifier vocabularies: (pattern on the lower-cased window, label), first hit wins
LOOKBACK60 = [
    (r"\bnotwithstanding\s+anything\s+contained\s+in\b", "overrides"),
    (r"\bsubject\s+to\b", "subject_to"),
    (r"\b(?:referred\s+to\s+in|computed\s+under|in\s+accordance\s+with|pursuant\s+to)\b", "depends_on"),
    (r"\b(?:as\s+defined\s+in|within\s+the\s+meaning\s+of)\b", "defined_in"),
]
LOOKBACK70 = [
    (r"\bnotwithstanding\s+anything\s+contained\s+in\b", "exception_to"),
    (r"\bsubject\s+to\b", "subject_to"),
    (r"\b(?:referred\s+to\s+in|computed\s+under|in\s+accordance\s+with|pursuant\s+to|specified\s+in)\b", "depends_on"),
    (r"\b(?:as\s+defined\s+in|within\s+the\s+meaning\s+of|meaning\s+assigned\s+to)\b", "defines_term"),
    (r"\b(?:manner\s+prescribed|procedure\s+under|as\s+prescribed\s+under)\b", "procedural_reference"),
    (r"\b(?:inserted\s+by|substituted\s+by|amended\s+by)\b", "amended_by_footnote"),
]

FOOTNOTE_MARKS = (
    r"(?im)\[\^[^\]]+\]|^\s*\d+\.\s+(?:Ins\.|Sub\.|Omtt\.|Subs\.|Words|Clauses|Sections|Omitted|Inserted|Substituted|Prior to)"
    r"|^\s*\d+\.\s+.*?\b(?:Act No\.|w\.e\.f\.)|\b\d+\[[^\]]+\]|#+\s*Footnotes?|<(?:fn|footnote)[^>]*>"
)
SIMPLE_HEADER = r"(?i)^(?:#+\s*)?(?:Section\s+)?(\d+[A-Z]*)\.?\s*(.*)"
