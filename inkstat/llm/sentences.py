"""Problem 5: sentence boundaries across languages and scripts.

Method: segmentation rules. Each rule has a pattern for what stands before a place, one for what comes after, and says
break or no break. The rules of a language come first, then those all languages share; at each place where a sentence
might end the first rule that matches decides.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.llm.chars import visible_with_offsets
from inkstat.runtime import spread

STOP = ".!?。！？।؟…。"
CLOSE = "\"'”’»)」』］】）]›〉》"
_S, _C = re.escape(STOP), re.escape(CLOSE)

# A place is after the stops and the closing marks on them, a space before a closing » or ! counted in; or at a blank
# line; or at white space beside Thai letters.
# A “ closes only what „ opened.
_PLACES = r"(?:[{s}]+(?: ?[»›](?=\s|\Z|[^\w\s])|[{c}])*)|\n[^\S\n]*\n|(?<=[฀-๿\d])\s+(?=\S)"
PLACES = re.compile(_PLACES.format(s=_S, c=_C))
PLACES_LOW_QUOTE = re.compile(_PLACES.format(s=_S, c=_C + "“"))


class Rule(NamedTuple):
    breaks: bool
    before: re.Pattern[str]
    after: re.Pattern[str]


def rule(breaks: bool, before: str, after: str) -> Rule:
    return Rule(breaks, re.compile(rf"(?:{before})\Z"), re.compile(after))


_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĮŁŃŇŐŒŘŚŞŠŤŪŮŰŹŻŽΑ-ΩЀ-Я"
_LOW = "a-zß-öø-ÿāăąćčďđēęěğģīįłńňőœřśşšťūůűźżžα-ωа-џ"
_OPEN = "\"'“„«‘‚(\\[¿¡「『（《"

# Abbreviations after which a sentence goes on, whatever follows, by language.
NEVER = {
    "en": r"Dr|Prof|Mr|Mrs|Ms|St|Gen|Col|Rev|Hon|Fig|Figs|Eq|Eqs|Sect|Sects|Sec|Ch|Vol|Vols|No|Nos|Ref|Refs|pp|cf|vs|approx|e\.g|i\.e|viz|ca|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec",
    "de": r"Dr|Prof|Hr|Fr|Abb|Tab|Vgl|vgl|Bd|Nr|S|z\. ?B|d\. ?h|u\. ?a|z|bzw|ca|ggf|evtl|Kap|Gl|Abschn|St|Str|inkl|geb|vs",
    "fr": r"M|MM|Mme|Mlle|Dr|Pr|fig|figs|p|pp|p\. ?ex|env|cf|chap|éq|vol|vs",
    "es": r"Sr|Sra|Srta|Dr|Dra|Prof|fig|figs|pág|págs|p|pp|p\. ?ej|aprox|cap|ec|vol|núm|Ud|Uds|vs|c|EE",
    "ru": r"см|рис|табл|ок|напр|стр|с|гл|ср|проф|акад|доц|ул|т(?=\. ?[деп]\.)|г(?=\. [а-я])|им|п|вып|т\. ?е|и\. ?о",
    "ar": r"د|ص|أ|م|ج|ت",
    "hi": r"डॉ|श्री|प्रो|पृ|सं|कृ|ई",
}
# Abbreviations that may end a sentence: only before a capital (they need no rule where the next word is small).
BOUND = r"(?<![\w.-])"

BLANK = rule(True, r"\n[^\S\n]*\n", r"")
SHARED_FIRST = [
    rule(True, r"[฀-๿]\s+", r"\S"),
    rule(True, r"[฀-๿][^\s]*\s+|\d\s+", r"[฀-๿]"),
    rule(False, r"\s+", r""),
]
SHARED = [
    # inside a number, a name of a file, a version, an abbreviation with inner stops
    rule(False, r"\d\.", r"\d"),
    rule(False, r"\w\.", rf"[{_LOW}\d]+\.\w|[{_LOW}]{{2,4}}\b(?!\s*[{_LOW}]*\s)"),
    rule(False, rf"(?<!\d )(?<!\d\n){BOUND}[{_UP}]\.", rf"\s*[{_UP}]\."),
    # a day before its month
    rule(False, r"(?:^|[^\d.,])\d{1,2}\.", r"\s+(?:Jan|Feb|M[äa]̈?r|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez)"),
    rule(False, r"\b(?:[Aa]m|[Vv]om|[Zz]um|[Bb]is|[Ii]m|[Dd]e[rmn]|[Dd]ie|[Dd]as)\s+\d{1,3}\.", rf"\s+[{_UP}]"),
    rule(False, rf"(?:^|[\s(\"'“„«‘—-]|\.)(?<!\d )(?<!\d\n)[{_UP}]\.", rf"\s+[{_UP}][{_LOW}]"),
    # a run of stops that tapers off in mid-sentence
    rule(False, r"…|\.\.\.", rf"\s*[{_LOW}]"),
    rule(False, r"…", r"\S"),
    # after a closing quotation mark the sentence goes on with a small letter, a comma, a dash
    rule(False, rf"[{_S}] ?[{_C}“]+", rf"\s*[,;:،；，、]|\s*[—–-]\s*[{_LOW}{_UP}]|\s+[{_LOW}](?![\w]?[{_UP}\d-])"),
    rule(False, rf"[{_S}] ?[{_C}“]*", r"\s*[,;:،；，、]"),
    # full-width stops need no space
    rule(False, r"[。！？][」』”’)）]+", r"\s*と"),
    rule(False, r"[。！？]", r"[」』”’）)»]"),
    rule(True, r"[。！？][」』”’）)»]*", r""),
    rule(True, rf"[।؟][{_C}]*", r"\s|\Z|[ऀ-ॿ؀-ۿ]"),
    # sentences that begin with a small letter: pH, m-Xylene, mRNA
    rule(True, rf"(?:[{_S}])[{_C}“]*", rf"\s+(?:[{_LOW}]-?[{_UP}])"),
    # a letter in lower case goes on
    rule(False, rf"[{_S}][{_C}“]*", rf"\s+[{_LOW}]"),
    rule(True, rf"[{_S}](?: ?[{_C}“])*", rf"\s+[{_OPEN}—–-]*\s?[{_UP}\d؀-ۿऀ-ॿ぀-ヿ㐀-鿿฀-๿]"),
    rule(True, rf"[{_S}](?: ?[{_C}“])*", rf"\s*\Z|\s*\n[^\S\n]*\n"),
    rule(True, rf"[{_S}](?: ?[{_C}“])*", rf"\s+[{_OPEN}]"),
    # two sentences without a space between them
    rule(True, rf"(?:[{_LOW}\d)%]|[{_UP}\d]{{2}}|[\d\s][{_UP}])[.!?][\"”’»)]*", rf"[{_OPEN}]*[{_UP}](?:[{_LOW}]|\s|[{_UP}\d]+-\d|\d|-|\.\s+[{_UP}])"),
    rule(True, rf"[!?.][\"”»)]+", rf"[{_OPEN}]*[{_UP}]"),
    rule(True, rf"[{_LOW}]{{2}}[.!?]", r"\d+ |[\"“„«(¿¡]"),
    rule(True, rf"[{_LOW}]{{3}}[.!?]|\d [a-zA-Z]{{1,4}}[.!?]", rf"(?:pH|[a-z]-[A-Z]|[a-z]-[a-z]{{5}})"),
]
RULES = {
    # also as they read with accents of their own
    lang: [rule(False, rf"{BOUND}(?:{a}|{unicodedata.normalize('NFD', a)})\.", r"(?!\s*\n[^\S\n]*\n)\s*\S")] for lang, a in NEVER.items()
}
_ENGLISH = RULES["en"]

_SMALL = {
    "en": {"the", "of", "and", "was", "is", "were", "to", "in", "with", "for", "at"},
    "de": {"der", "die", "das", "und", "nach", "bei", "im", "wurde", "ist", "den", "für"},
    "fr": {"le", "la", "les", "et", "des", "pour", "un", "une", "est", "dans", "du"},
    "es": {"el", "la", "los", "y", "las", "se", "en", "por", "del", "una", "con"},
}


def language(text: str) -> list[str]:
    """The languages whose rules a text needs, by script and small words, the likeliest first."""
    head = text
    counts = {
        "ru": len(re.findall("[а-яё]", head)), "ar": len(re.findall("[؀-ۿ]", head)), "hi": len(re.findall("[ऀ-ॿ]", head)),
        "latin": len(re.findall("[a-zà-ÿ]", head)), "cjk": len(re.findall("[぀-ヿ㐀-鿿]", head)), "th": len(re.findall("[฀-๿]", head)),
    }
    out = [k for k in ("ru", "ar", "hi") if counts[k] > 20 or counts[k] * 4 > sum(counts.values())]
    words = re.findall(r"[a-zà-ÿ]+", head.lower())
    score = {k: sum(w in v for w in words) for k, v in _SMALL.items()}
    best = max(score, key=lambda k: score[k])
    if counts["latin"] * 3 > sum(counts.values()):
        # few small words tell nothing: then the rules of all four
        out += [k for k in sorted(score, key=lambda k: -score[k]) if score[best] < 4 or score[k] * 4 >= score[best]]
    return out or ["en"]


def _caseless_goes_on(text: str, start: int, end: int) -> bool:
    """In scripts without capitals a quotation that opens its sentence goes on to who said it; one led in by a colon
    ends with its sentence."""
    s = text[start:end].lstrip()
    if not re.search(rf"[{_S}][”」』»\"’]+\Z", s):
        return False
    return s[:1] in "“「『«\"‘" and not re.search(r"[:：]\s*[“「『«\"‘]", s)


def _before_opener(t: str, a: int, p: int) -> int:
    """The end of a place without a straight quotation mark that opens what follows: in its paragraph an even number
    of them stands before, and no white space comes after."""
    q = t.find('"', a, p)
    if q < 0 or p < len(t) and t[p].isspace() or p == len(t):
        return p
    return q if t.count('"', max(t.rfind("\n\n", 0, a), 0), q) % 2 == 0 else p


_CASELESS = re.compile(r"\s*[؀-ۿऀ-ॿ぀-ヿ㐀-鿿]")


def ends(text: str | None) -> list[int]:
    """The end of each sentence in characters of the text, closing marks counted in; none for an empty text."""
    if not text or not text.strip():
        return []
    t, at = visible_with_offsets(text)
    rules = [r for k in language(t) for r in RULES.get(k, _ENGLISH)]
    out: list[int] = []
    start = 0

    def put(end: int) -> None:
        nonlocal start
        s = t[start:end].rstrip()
        if s.strip():
            out.append(start + len(s))
        start = end

    for m in (PLACES_LOW_QUOTE if "„" in t else PLACES).finditer(t):
        p = _before_opener(t, m.start(), m.end())
        if p <= start:
            continue
        if m.group()[0] == "\n" and m.group().count("\n") > 1:
            put(m.start())
            start = p
            continue
        if m.group()[0].isspace():
            chosen = SHARED_FIRST
        else:
            chosen = rules + SHARED
            if _CASELESS.match(t, p) or (re.search("[؀-ۿऀ-ॿ぀-ヿ㐀-鿿]", t[start:p])):
                if _caseless_goes_on(t, start, p) and re.match(r"\s*\w", t[p : p + 3]) and "\n\n" not in t[p : p + 3]:
                    continue
        before = t[max(start, p - 60, 0) : p]
        for r in chosen:
            if r.before.search(before) and r.after.match(t, p):
                if r.breaks:
                    put(m.start() if m.group()[0].isspace() else p)
                break
    put(len(t))
    return [at[e - 1] + 1 for e in out]


def sentence_ends(docs: DataFrame, sources: tuple[str, ...] | None = None) -> DataFrame:
    """``(doc_id, sentence_no, end_char, sentence)`` of every text, or of the texts of some sources only.

    Null, empty and blank texts have no sentences; a row repeated as a whole counts once, and a text is split whole.
    """
    d = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    if sources:
        d = d.filter(F.lower(F.trim("source")).isin(*sources))
    d = spread(d.select("doc_id", "text"), "doc_id").dropDuplicates(["doc_id", "text"])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for i, t in zip(b["doc_id"], b["text"]):
                e = ends(t)
                if e:
                    s = [t[a:z].strip() for a, z in zip([0, *e], e)]
                    yield pd.DataFrame({"doc_id": i, "sentence_no": range(len(e)), "end_char": e, "sentence": s})

    return d.mapInPandas(run, "doc_id string, sentence_no int, end_char int, sentence string")
