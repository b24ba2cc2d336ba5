"""Cleaning, tokens, sentences and paragraphs as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstat.functions import lexicons as lx

#: White space and word characters of Unicode, spelled out so that Java and RE2 read them alike.
SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SPACES}]"
NOT_WS = f"[^{SPACES}]"
WORD_CHARS = r"\p{L}\p{N}_"
WC = f"[{WORD_CHARS}]"
TOKEN = "[A-Za-z][A-Za-z'-]*"

_ABBR = "|".join(re.escape(a) for a in lx.ABBREVIATIONS)
_GAP = rf"[\"')\]]*{WS}+(?=[A-Z0-9(\"'])"
#: The place between two sentences: after a stop that closes no abbreviation and no initial.
SENTENCE_GAP = rf"(?<=[.!?])(?<!(?:^|{WS})(?i:{_ABBR})\.)(?<!(?:^|{WS})[A-Z]\.){_GAP}"
QUOTED = "\"[^\"]{1,120}\"|'[^']{1,120}'|“[^”]{1,120}”"


def bounded(pattern: str) -> str:
    """A pattern that begins and ends at the edge of a word."""
    return rf"(?<!{WC})(?:{pattern})(?!{WC})"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def tokens(text: Column) -> Column:
    """Words: runs of ASCII letters with inner apostrophes and hyphens."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def lower_tokens(text: Column) -> Column:
    return F.transform(tokens(text), F.lower)


def n_tokens(text: Column) -> Column:
    return count(text, TOKEN)


# The same white space, as characters to trim.
_BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def split_words(text: Column) -> Column:
    """Words between white space, of any script."""
    return F.regexp_extract_all(text, F.lit(f"({NOT_WS}+)"), F.lit(1))


def flat(text: Column) -> Column:
    """The lines of a text, stripped, as one."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != ""), " ")


def pieces(text: Column) -> Column:
    """What stands between the gaps of sentences."""
    return F.split(flat(text), SENTENCE_GAP, -1)


def sentences(text: Column, least: int = 3) -> Column:
    """Sentences of at least ``least`` words, split after stops with guards for abbreviations and initials."""
    return F.filter(pieces(text), lambda s: n_tokens(s) >= least)


def sentences_with_tokens(text: Column, least: int = 3) -> Column:
    """The same as structs ``(s, t)`` of a sentence and its words, in one pass over the words."""
    return F.filter(F.transform(pieces(text), lambda s: F.struct(s.alias("s"), tokens(s).alias("t"))), lambda p: F.size(p["t"]) >= least)


def rejoined(sentence: Column) -> Column:
    """A sentence with one space at each gap within it; such gaps are those after its abbreviations and initials."""
    return F.regexp_replace(sentence, rf"(?<=[.!?]){_GAP}", " ")


def simple_sentences(text: Column) -> Column:
    """Sentences split at a stop before a capital, without guards."""
    return F.split(F.regexp_replace(text, rf"{WS}*\n{WS}*", " "), rf"(?<=[.!?]){WS}+(?=[A-Z])", -1)


def paragraphs(text: Column, least: int = 3) -> Column:
    return F.filter(F.transform(F.split(text, rf"\n{WS}*\n", -1), strip), lambda p: n_tokens(p) >= least)


def drop_quoted(text: Column) -> Column:
    """Quoted spans of up to 120 characters give way to a space."""
    return F.regexp_replace(text, QUOTED, " ")


# What folds to what after compatibility composition. Dashes longer than a hyphen stay.
FOLDS = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "‟": '"',
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "‐": "-", "‑": "-", "−": "-", "­": "",
}
_FOLD_TABLE = str.maketrans(FOLDS)


def fold(text: str | None) -> str | None:
    return None if text is None else text if text.isascii() else unicodedata.normalize("NFKC", text).translate(_FOLD_TABLE)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: fold(t) if isinstance(t, str) else None)


def normalise(text: Column) -> Column:
    """Typographic variants folded to plain characters. Spark has no Unicode normal forms, so only rows beyond ASCII pass
    through an Arrow function."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), _nfkc(text)).otherwise(text)


# What cleaning takes out, in this order. White space and word edges are spelled out as above.
URL = rf"https?://{NOT_WS}+|www\.{NOT_WS}+"
DOI = rf"(?i)(?<!{WC})(?:doi:{WS}*)?10\.\d{{4,9}}/{NOT_WS}+"
EMAIL = rf"(?<!{WC})[{WORD_CHARS}.+-]+@[{WORD_CHARS}-]+\.[{WORD_CHARS}.]+(?<={WC})"
AUTHOR_CITE = (
    rf"\((?:[^()]*?(?<!{WC})(?:et al\.?|and|&)(?:(?<={WC})(?!{WC})|(?<!{WC})(?={WC}))[^()]*?\d{{4}}[a-z]?|[A-Z][A-Za-z'`-]+,?{WS}+\d{{4}}[a-z]?)(?:{WS}*;{WS}*[^()]*?\d{{4}}[a-z]?)*\)"
)
NUMBER_CITE = rf"\[{WS}*\d+(?:{WS}*[-,–]{WS}*\d+)*{WS}*\]"
CALLOUT = (
    rf"(?i)\(?(?<!{WC})(?:Fig(?:ure)?s?|Tables?|Schemes?|Eq(?:uation|n)?s?|Supplementary{WS}+{WC}+)\.?{WS}*S?\d+[a-zA-Z]?(?:{WS}*[-–,]{WS}*S?\d+[a-zA-Z]?)*\)?"
)
EMPTY_BRACKET = rf"\({WS}*[;,\-–—{SPACES}]*\)|\[{WS}*[;,\-–—{SPACES}]*\]"


def clean(text: Column, keep_citations: bool = False, folded: bool = False) -> Column:
    """Prose without addresses, citations, callouts and the brackets they leave; paragraphs stay."""
    t = text if folded else normalise(text)
    steps = [URL, DOI, EMAIL, *([] if keep_citations else [AUTHOR_CITE, NUMBER_CITE]), CALLOUT, EMPTY_BRACKET]
    for p in steps:
        t = F.regexp_replace(t, p, " ")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, rf"(?:(?<=\n)|\A)[^\S\n]+|[^\S\n]+(?=\n|\z)", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, rf"{WS}+([,.;:!?])", "$1")
    return strip(t)


def clean_title(title: Column, folded: bool = False) -> Column:
    """One line, without the marks of footnotes at its end."""
    t = title if folded else normalise(title)
    t = strip(F.regexp_replace(t, f"{WS}+", " "))
    return strip(F.regexp_replace(t, rf"[{SPACES}†‡§¶*★٭]+\z", ""))


def boilerplate_heading(heading: Column) -> Column:
    k = F.lower(strip(heading))
    k = strip(F.regexp_replace(k, r"[:.]+\z", ""))
    return F.regexp_replace(k, rf"\A\d+[.)]?{WS}*", "").isin(lx.BOILERPLATE_HEADINGS)


# Mark-up and what it gives way to, in this order.
MARKDOWN = [
    (r"(?s)```.*?```", " "), (r"(?s)~~~.*?~~~", " "), (r"`[^`]*`", " "), (rf"(?m)^{WS}*\|.*\|{WS}*$", " "), (rf"(?m)^{WS}{{0,3}}#{{1,6}}{WS}+.*$", " "),
    (rf"(?m)^{WS}*[-*+]{WS}+", ""), (rf"(?m)^{WS}*\d+[.)]{WS}+", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"), (r"\$[^$]*\$", " "),
]


def strip_markdown(text: Column, folded: bool = False) -> Column:
    """Prose without code, tables, headings, list marks, links, emphasis and formulas, then cleaned."""
    t = text
    for p, r in MARKDOWN:
        t = F.regexp_replace(t, p, r)
    return clean(t, folded=folded)


def excerpt(text: Column, words: int, floor: int = 0) -> Column:
    """The first words of a text; null under the floor."""
    w = split_words(text)
    return F.when(F.size(w) >= floor, F.array_join(F.slice(w, 1, words), " "))


# The signs of notation, and the lines of a page that are no argued prose.
MATH_CHARS = "=+<>∑∫∂∇√∞≈≠≤≥±×⋅→←⇒αβγδεζηθλμνξπρστφχψωΓΔΘΛΞΠΣΦΨΩ|^_{}[]\\"
_MATH = "[" + "".join("\\" + c if c in "[]\\^{}|+" else c for c in MATH_CHARS) + "]"


def math_ratio(line: Column) -> Column:
    """Share of notation among the characters of a line; 1 for a blank one."""
    return F.when(strip(line) == "", 1.0).otherwise(count(line, _MATH) / F.length(line))


def alpha_ratio(line: Column) -> Column:
    """Share of letters, digits and spaces; 0 for a blank line."""
    return F.when(strip(line) == "", 0.0).otherwise(count(line, rf"[\p{{L}}\p{{N}}{SPACES}]") / F.length(line))


PDF_TAIL = rf"(?i)\n{WS}*(?:REFERENCES?|Bibliography|ACKNOWLEDG(?:E)?MENTS?|Supporting Information|AUTHOR INFORMATION|Notes{WS}*\n)(?!{WC})"
PDF_CAPTION = rf"(?i)\A{WS}*(?:Figure|Fig\.|Table|Scheme|Eq\.?){WS}*\d+"
PDF_HEADER = (
    rf"(?i)\A{WS}*(?:https?://|doi:|DOI|Journal of|The Journal of|Langmuir|ACS |Received|Published|Accepted|Revised|Downloaded|\d+{WS}*\z|[A-Z][a-z]+ et al\.)"
)
PDF_BOILERPLATE = (
    r"(?i)this journal is|royal society of chemistry|american chemical society|all rights reserved|with permission from|reproduced from ref|adapted from ref|"
    r"copyright \d{4}|\(c\) \d{4}|downloaded (?:on|from|by)|for peer review|peer review of|creative commons|licensed under|this article is|"
    rf"published on {WC}+ \d|see https?://|(?<!{WC})doi(?!{WC})|department of|university of|school of|institute of|corresponding author|e-?mail|received:|"
    rf"accepted:|revised:|supporting information|electronic supplementary|(?<!{WC})issn(?!{WC})|(?<!{WC})vol\.? \d|(?<!{WC})pp\.? \d|cite this|citation:|author contributions|"
    r"conflicts? of interest|acknowledg"
)


def clean_pdf(text: Column, folded: bool = False) -> Column:
    """Argued prose of text taken from PDF pages: without back matter, captions, headers, notices and equations."""
    t = F.split(text, PDF_TAIL, 2).getItem(0)
    t = F.regexp_replace(t, rf"([a-z])-{WS}*\n{WS}*([a-z])", "$1$2")
    keep = F.filter(
        F.transform(F.split(t, "\n", -1), strip),
        lambda s: (F.length(s) >= 25)
        & ~(s.rlike(PDF_CAPTION) | s.rlike(PDF_HEADER) | s.rlike(PDF_BOILERPLATE))
        & (math_ratio(s) <= 0.06)
        & (alpha_ratio(s) >= 0.80),
    )
    return clean(F.array_join(keep, " "), folded=folded)
